"""Compression classifier of text quality.

Two zstandard dictionaries hold text of good and of bad labelled documents. A text is compressed in blocks with each,
the two sizes are summed over the whole text, and their difference over the larger one is its normalised
difference. That is done for two views: the text itself, and its shape, which keeps how it is written and drops which
words it has (a run of letters becomes ``a``, ``A`` (capital first) or ``U`` (all capitals), of digits ``0``; a word that
repeats the one before becomes ``=`` and a letter that counts the repeats; all else stays). A logistic curve over both
differences, fitted to labelled documents that no dictionary has seen, gives the score.

At most ``PER_CLASS`` labelled documents and ``SAMPLE_BYTES`` of text a class are learnt from: half of them, by a hash of
the id, for the dictionaries, the rest for the curve (all for both, where a half would lack a class). Every
document of the first half gives each dictionary an equal stretch, as long as fills it; the two of a view are cut to the
same size. Class frequencies come from all labels. Defined results: null text is empty; an empty text has
differences of 0; without labels of both classes every score is the share of good labels, or 0.5 without any;
repeated rows score alike; an empty table gives an empty one; other columns pass through ``keep_good``, whatever
their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import durable, fold, labelled_sample, pieces, table, utf8

FOLDS, HELD_OUT = 3, 1
#: Labelled documents, and bytes of their text, of a class that are learnt from; zstandard's level.
PER_CLASS, SAMPLE_BYTES, LEVEL = 4000, 24 << 20, 8
#: Of each view: bytes of a dictionary, the least stretch that a document gives it, bytes compressed at once.
VIEWS = {"text": (256 << 10, 1000, 1024), "shape": (64 << 10, 300, 256)}
#: Bytes added to the size that the difference is divided by, so that a few bytes decide little about a very short text.
PRIOR = 30

_RUN = re.compile(r"[^\W_]+")


def _kind(run: re.Match) -> str:
    s = run[0]
    return "0" if s.isdigit() else "U" if len(s) > 1 and s.isupper() else "A" if s[0].isupper() else "a"


def shape(text: str) -> bytes:
    out, before, repeats, known = [], None, 0, {}
    for word in text.split(" "):
        if word and word == before:
            out.append("=" + chr(97 + repeats % 26))
            repeats += 1
            continue
        before, repeats = word, 0
        if (made := known.get(word)) is None:
            made = known[word] = _RUN.sub(_kind, word)
        out.append(made)
    return " ".join(out).encode("utf-8", "replace")


def views(text: str) -> dict[str, bytes]:
    return {"text": text.encode("utf-8", "replace"), "shape": shape(text)}


def compressors(dictionaries: list[bytes]) -> list[zstandard.ZstdCompressor]:
    made = []
    for content in dictionaries:
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
    return made


def difference(data: bytes, bad: zstandard.ZstdCompressor, good: zstandard.ZstdCompressor, block: int) -> float:
    """Normalised: positive where the good dictionary compresses better."""
    of_bad = of_good = 0
    for i in range(0, len(data), block):
        part = data[i : i + block]
        of_bad += len(bad.compress(part))
        of_good += len(good.compress(part))
    return (of_bad - of_good) / (max(of_bad, of_good) + PRIOR)


def stretch(data: bytes, length: int) -> bytes:
    """A stretch from a place that the bytes themselves choose."""
    at = zlib.crc32(data) % max(1, len(data) - length + 1)
    return data[at : at + length]


def dictionaries(bad: list[bytes], good: list[bytes], size: int) -> list[bytes]:
    """Both stretches joined in an order of their own, cut to one size."""
    made = [b"".join(sorted(some, key=lambda x: (zlib.crc32(x), x))) for some in (bad, good)]
    size = min(size, *map(len, made))
    return [m[:size] for m in made]


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Slopes and offset of the logistic curve, by Newton steps on the weighted, lightly penalised likelihood."""
    design, w = np.c_[x, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    weight = weight / weight.sum()
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -50, 50)))
        slope = design.T @ (weight * (p - y)) + 1e-5 * w
        bend = (design.T * (weight * p * (1 - p))) @ design + 1e-5 * np.eye(len(w))
        w = w - np.linalg.solve(bend, slope)
    return w


class Model:
    """What scoring needs: under 700 KB, whatever it was learnt from. ``contents``: of each view the bad and the good dictionary."""

    def __init__(self, contents: dict[str, list[bytes]], weights: np.ndarray):
        self.contents, self.weights = contents, weights

    def differences(self):
        """A function from a text to the difference in each view."""
        tools = {view: compressors(pair) for view, pair in self.contents.items()}

        def run(text: str) -> list[float]:
            of = views(text)
            return [difference(of[view], *pair, VIEWS[view][2]) for view, pair in tools.items()]

        return run

    def scorer(self):
        *slopes, offset = self.weights.tolist()
        if not self.contents:
            return lambda text: 1 / (1 + np.exp(-offset))
        differences = self.differences()
        return lambda text: 1 / (1 + np.exp(-np.clip(sum(a * x for a, x in zip(slopes, differences(text), strict=True)) + offset, -50, 50)))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    rows, counts = labelled_sample(docs, labels, "quality", FOLDS, HELD_OUT, per_class, SAMPLE_BYTES)
    if not counts.get(0) or not counts.get(1):
        share = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
        return Model({}, np.array([np.log(max(share, 1e-3) / max(1 - share, 1e-3))]))
    flat = Model({}, np.array([np.log(counts[1] / counts[0])]))
    rows = durable(rows.withColumn("for_curve", F.pmod(F.xxhash64(F.lit("curve"), "doc_id"), F.lit(2)) == 1))
    found = {(r["y"], r["for_curve"]): r["n"] for r in rows.groupBy("y", "for_curve").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(found) < 4:  # a half without one of the classes: both learn from all
        rows = rows.withColumn("for_curve", F.lit(None).cast("boolean"))
        found = {(k, side): sum(n for (y, _), n in found.items() if y == k) for k in (0, 1) for side in (False, True)}
    if not all(found.values()):
        return flat
    lengths = {view: {k: max(least, -(-2 * size // found[k, False])) for k in (0, 1)} for view, (size, least, _) in VIEWS.items()}

    @pandas_udf("text binary, shape binary")
    def stretches(texts, ys):
        import pandas as pd

        made = [{view: stretch(data, lengths[view][y]) for view, data in views(t.decode("utf-8", "replace")).items()} for t, y in zip(texts, ys, strict=True)]
        return pd.DataFrame(made, columns=list(VIEWS))

    got = rows.where("for_curve is not true").select("y", stretches("text", "y").alias("s")).select("y", "s.*").collect()
    contents = {view: dictionaries(*([bytes(r[view]) for r in got if r["y"] == k] for k in (0, 1)), size) for view, (size, _, _) in VIEWS.items()}
    contents = {view: pair for view, pair in contents.items() if all(pair)}
    if not contents:
        return flat
    model = Model(contents, np.zeros(len(contents) + 1))

    @pandas_udf("array<double>")
    def differences(texts):
        of = model.differences()
        return texts.map(lambda t: of(t.decode("utf-8", "replace")))

    pairs = rows.where("for_curve is not false").select("y", differences("text").alias("x")).collect()
    x, y = np.array([r["x"] for r in pairs]), np.array([r["y"] for r in pairs], dtype=float)
    weight = np.where(y == 1, counts[1] / max(1, (y == 1).sum()), counts[0] / max(1, (y == 0).sum()))
    return Model(contents, calibrate(x, y, weight))


def scores(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score, one row a document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in pieces(batches, "text"):
            made = [float(score(t.decode("utf-8", "replace"))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), utf8(text).alias("text")).mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """The documents that score at least ``least``, with their columns."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in pieces(batches, text):
            yield batch.filter(pa.array([bool(score(t or "") >= least) for t in batch.column(text).to_pylist()]))

    return docs.mapInArrow(run, docs.schema)


def op8_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scores(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
