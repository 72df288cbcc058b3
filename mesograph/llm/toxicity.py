"""Toxicity by a factorization machine over hashed terms.

A text's terms are its lower-cased words and the first four to eight letters of longer ones, each hashed to
``BINS`` bins and counted once. The machine adds a weight for each term and, for each pair of terms, the
product of their factor vectors, so a pair (an insult and the mention of a group) can weigh what neither
does alone. Pairs cost nothing extra: the sum over pairs is half of |sum v|^2 - sum |v|^2.

It is fitted by Adagrad on at most ``PER_CLASS`` labelled documents of each class and ``SAMPLE_BYTES`` of text. The many
terms that say nothing would be learnt by heart, so a term takes part only if the label depends on it: by itself
(chi-square of at least ``CHI``), or in a pair, by the contrast of the label's rate over the four cases of holding one, the
other, both or neither (chi-square of at least ``PAIR_CHI``; pairs of terms that ``SHARE`` of the documents or more hold, for a rarer
pair's cases are too few to be learnt from). A term that tells nothing alone so stays if it tells beside another. The
model is bounded by the sample, not by the corpus.

Defined results: null and empty texts have no terms and score the machine's offset; without labels of both
classes every score is the share of toxic labels, or 0 without any; repeated rows score alike; an
empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import fold, labelled_sample, pieces, table, utf8

FOLDS, HELD_OUT = 5, 0
PER_CLASS, SAMPLE_BYTES, BINS = 4000, 24 << 20, 1 << 20
LEAST, CHI, SHARE, PAIR_CHI, STRIPE = 5, 10.0, 0.04, 45.0, 256
FACTORS, EPOCHS, LEAST_STEPS, BATCH, RATE, PENALTY = 8, 12, 600, 64, 0.05, 2e-5
REMEMBERED = 200_000

_WORD = re.compile(r"[^\W_]+")


def bins(word: str) -> tuple[int, ...]:
    """The bins of a lower-cased word's terms."""
    found = [zlib.crc32(word.encode("utf-8", "replace")) % BINS]
    for n in range(4, 9):
        if len(word) > n:
            found.append(zlib.crc32(f"{word[:n]}*".encode("utf-8", "replace")) % BINS)
    return tuple(found)


def terms(text: str) -> list[int]:
    return sorted({b for w in set(_WORD.findall(text.lower())) for b in bins(w)})


class Machine:
    """offset; for each kept bin its weight and factors. At most the sample's terms, so it can be sent to every task."""

    def __init__(self, offset: float, kept: np.ndarray, weight: np.ndarray, factors: np.ndarray):
        self.offset, self.kept, self.weight, self.factors = offset, kept, weight, factors

    def margin(self, rows: np.ndarray) -> float:
        v = self.factors[rows]
        total = v.sum(axis=0)
        return self.offset + float(self.weight[rows].sum() + 0.5 * (total @ total - (v * v).sum()))

    def scorer(self):
        """Text to score; remembers which rows a word has, within a bound."""
        at = {int(b): i for i, b in enumerate(self.kept)}

        class Rows(dict):
            def __missing__(self, word: str) -> tuple[int, ...]:
                if len(self) >= REMEMBERED:
                    self.clear()
                found = self[word] = tuple(at[b] for b in bins(word) if b in at)
                return found

        rows = Rows()

        def score(text: str) -> float:
            found: set[int] = set()
            for w in set(_WORD.findall(text.lower())):
                if r := rows[w]:
                    found.update(r)
            return float(1 / (1 + np.exp(-np.clip(self.margin(np.array(sorted(found), dtype=np.int64)), -50, 50))))

        return score


def alone(documents: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many documents hold each bin, and its chi-square against the label."""
    count = lambda k: np.bincount(np.concatenate([np.zeros(0, dtype=np.int64), *(d for d, c in zip(documents, y, strict=True) if c == k)]), minlength=BINS).astype(float)
    toxic, clean, n1, n0 = count(1), count(0), y.sum(), (1 - y).sum()
    held = toxic + clean
    return held, len(y) * (toxic * (n0 - clean) - clean * (n1 - toxic)) ** 2 / np.maximum(held * (len(y) - held) * n1 * n0, 1e-9)


def in_pairs(documents: list[np.ndarray], y: np.ndarray, some: np.ndarray) -> np.ndarray:
    """For each of some bins the largest chi-square of a pair's contrast: rate(both) - rate(one) - rate(other) + rate(neither)."""
    at = np.full(BINS, -1, dtype=np.int64)
    at[some] = np.arange(len(some))
    x = np.zeros((len(documents), len(some)), dtype=np.float32)
    for i, d in enumerate(documents):
        x[i, (r := at[d])[r >= 0]] = 1
    n, whole = len(y), y.sum()
    held, toxic = x.sum(axis=0, dtype=float), x.T.astype(np.float32) @ y.astype(np.float32)
    p, most = whole / n, np.zeros(len(some))
    for k in range(0, len(some), STRIPE):
        part = x[:, k : k + STRIPE]
        both, both_toxic = (part.T @ x).astype(float), ((part * y[:, None].astype(np.float32)).T @ x).astype(float)
        h, t = held[k : k + STRIPE, None], toxic[k : k + STRIPE, None]
        cells = [both, h - both, held - both, n - h - held + both]
        hits = [both_toxic, t - both_toxic, toxic - both_toxic, whole - t - toxic + both_toxic]
        enough = np.minimum.reduce(cells) >= LEAST
        r = [a / np.maximum(c, 1) for a, c in zip(hits, cells, strict=True)]
        spread = p * (1 - p) * sum(1 / np.maximum(c, 1) for c in cells)
        chi = np.where(enough, (r[0] - r[1] - r[2] + r[3]) ** 2 / np.maximum(spread, 1e-12), 0)
        most[k : k + STRIPE] = chi.max(axis=1, initial=0)
    return most


def telling(documents: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Which bins are held by enough documents and tell something, alone or in a pair."""
    held, chi = alone(documents, y)
    told = chi >= CHI
    common = np.flatnonzero((held >= max(LEAST, SHARE * len(y))) & (held <= len(y) - LEAST))
    told[common] |= in_pairs(documents, y, common) >= PAIR_CHI
    return (held >= LEAST) & told


def train(documents: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> Machine:
    """``documents``: the bins of each; ``weight``: of each document in the loss."""
    kept = np.nonzero(telling(documents, y))[0]
    at = np.full(BINS, -1, dtype=np.int64)
    at[kept] = np.arange(len(kept))
    rows = [r[r >= 0] for r in (at[d] for d in documents)]
    random = np.random.default_rng(7)
    w, v, b = np.zeros(len(kept)), random.normal(0, 0.05, (len(kept), FACTORS)), float(np.log((weight * y).sum() / (weight * (1 - y)).sum()))
    gw, gv, gb = np.full(len(kept), 1e-3), np.full((len(kept), FACTORS), 1e-3), 1e-3
    for _ in range(max(EPOCHS, -(-LEAST_STEPS * BATCH // max(1, len(rows))))):
        order = random.permutation(len(rows))
        for k in range(0, len(order), BATCH):
            some = order[k : k + BATCH]
            sizes = np.array([len(rows[i]) for i in some])
            flat, ends = np.concatenate([rows[i] for i in some]), np.concatenate([[0], np.cumsum(sizes)])
            doc, vf = np.repeat(np.arange(len(some)), sizes), v[flat]
            full = np.flatnonzero(sizes)  # a text without terms has the sums 0

            def over(x: np.ndarray) -> np.ndarray:
                out = np.zeros((len(sizes), *x.shape[1:]))  # noqa: B023
                if len(full):  # noqa: B023
                    out[full] = np.add.reduceat(x, ends[full], axis=0)  # noqa: B023
                return out

            total = over(vf)
            margin = b + over(w[flat]) + 0.5 * ((total * total).sum(axis=1) - over((vf * vf).sum(axis=1)))
            error = weight[some] * (1 / (1 + np.exp(-np.clip(margin, -50, 50))) - y[some])
            db = error.mean()
            gb += db * db
            b -= RATE * db / np.sqrt(gb)
            if not len(flat):
                continue
            place = np.argsort(flat, kind="stable")
            cut = np.concatenate([[0], np.flatnonzero(np.diff(flat[place])) + 1])
            used, of = flat[place][cut], error[doc][place]
            dw = np.add.reduceat(of, cut) / len(some) + PENALTY * w[used]
            dv = np.add.reduceat(of[:, None] * (total[doc] - vf)[place], cut, axis=0) / len(some) + PENALTY * v[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            w[used] -= RATE * dw / np.sqrt(gw[used])
            v[used] -= RATE * dv / np.sqrt(gv[used])
    return Machine(b, kept, w, v)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Machine:
    rows, counts = labelled_sample(docs, labels, "toxic", FOLDS, HELD_OUT, per_class, SAMPLE_BYTES)

    @pandas_udf("array<int>")
    def hashed(texts):
        return texts.map(lambda t: terms(t.decode("utf-8", "replace")))

    known = counts.get(0) and counts.get(1)
    got = rows.select("y", hashed("text").alias("t")).toArrow().combine_chunks() if known else None
    y = got["y"].to_numpy().astype(float) if known else np.zeros(0)
    if not 0 < y.sum() < len(y):
        share = counts.get(1, 0) / sum(counts.values()) if counts else 0.0
        return Machine(float(np.log(max(share, 1e-3) / max(1 - share, 1e-3))), np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros((0, FACTORS)))
    taken = {k: (y == k).sum() for k in (0, 1)}
    weight = np.where(y == 1, counts[1] / taken[1], counts[0] / taken[0])
    # rows come in any order; the fit must not depend on it
    documents = [np.asarray(t.values, dtype=np.int64) for chunk in got["t"].chunks for t in chunk]
    order = sorted(range(len(y)), key=lambda i: (zlib.crc32(documents[i].tobytes()), y[i]))
    return train([documents[i] for i in order], y[order], (weight / weight.mean())[order])


def scores(docs: DataFrame, machine: Machine, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score, one row a document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = machine.scorer()
        for batch in pieces(batches, "text"):
            made = [score(t.decode("utf-8", "replace")) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), utf8(text).alias("text")).mapInArrow(run, "doc_id long, score double")


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scores(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
