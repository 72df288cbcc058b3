"""Language of each word by a linear-chain conditional random field, and of each text by its words.

A word's features are the word itself (lexicon), its character 2-, 3- and 4-grams and, through the marks at
its begin and end, its prefixes and suffixes of up to three letters, hashed to ``BINS`` bins. Feature weights and
the transitions between languages are learnt together by gradient ascent on the likelihood, whose
expectations come from forward-backward. Labelled, a text's words get posterior probabilities of
each language, so a passage in another language gets labels of its own; the text's language is
the one with the largest share of the posteriors.

Forward-backward runs over blocks of ``BLOCK`` words at once: each block yields its transfer matrix, the
matrices are chained per text, then all blocks are solved inside. Very long texts go through in chunks of
``CHUNK`` words, chained the same way, so memory doesn't grow with the longest text.

Learning takes at most ``PER_LANGUAGE`` texts of each language, chosen by a hash of the id, and at most ``SAMPLE_BYTES`` of
text in all, an equal part for each language (but one text always); of each text at most ``SPANS`` spans of up to
``LONGEST`` words from hashed places. A text bears one label, so its words alone would teach no switch: spans of all
languages are shuffled and joined, one to four to a sequence, and steps between languages are learnt where
they meet. All languages are learnt; the model has 512 KB a language. Defined results: a text without a letter (null and empty texts too) is ``und`` with score 0; without any language to learn
every text is ``und``; words over 24 letters are known by their first and last twelve; ties go to the first
language by name; repeated rows are labelled alike; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, fold, join_groups, pieces, table, utf8

FOLDS, HELD_OUT = 4, 2
PER_LANGUAGE, SAMPLE_BYTES, SPANS, LONGEST, JOINED, BINS = 250, 16 << 20, 8, 40, 4, 1 << 17
BLOCK, CHUNK, WIDTH, REMEMBERED = 64, 1 << 17, 24, 150_000
ROUNDS, RATE, PENALTY, STAY, HOLD = 20, 0.3, 1e-4, 0.95, 1e-3

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def feature_bins(some: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of the words, their bins) for the words of each length: all features of a word in a row."""
    short = [w if len(w) <= WIDTH else w[: WIDTH // 2] + w[-WIDTH // 2 :] for w in some]
    codes = np.array(short, dtype=f"<U{WIDTH}").view(np.uint32).reshape(-1, WIDTH).astype(np.uint64)
    length = np.fromiter(map(len, short), dtype=np.int64, count=len(short))
    for n in np.unique(length):
        places = np.nonzero(length == n)[0]
        marked = np.ones((len(places), n + 2), dtype=np.uint64)
        marked[:, 1:-1] = codes[places, :n]
        marked[:, -1] = 2
        found = []
        for size in (2, 3, 4, n + 2):  # the last is the word itself
            if size > n + 2:
                continue
            h = np.full((len(places), n + 3 - size), 1469598103934665603 + int(size), dtype=np.uint64)
            for k in range(size):
                h = (h ^ marked[:, k : k + n + 3 - size]) * np.uint64(1099511628211)
            found.append(h)
        h = np.concatenate(found, axis=1)
        yield places, ((h ^ (h >> np.uint64(29))) % np.uint64(BINS)).astype(np.int64)


class Field:
    """Languages, weights (bins x languages, float32) and log transitions: BINS * 4 bytes a language, whatever was learnt from."""

    def __init__(self, languages: list[str], weights: np.ndarray, steps: np.ndarray):
        self.languages, self.weights, self.steps = languages, weights, steps

    def emissions(self, some: list[str]) -> np.ndarray:
        out = np.zeros((len(some), len(self.languages)), dtype=np.float32)
        for places, bins in feature_bins(some):
            total = np.zeros((len(places), len(self.languages)), dtype=np.float32)
            for k in range(bins.shape[1]):
                total += self.weights[bins[:, k]]
            out[places] = total
        return out


def _blocks(potentials: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Potentials laid out as (blocks, BLOCK, languages), which places are words, each text's first block and number of blocks."""
    count = -(-lengths // BLOCK)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    place = np.arange(len(potentials)) - np.repeat(start, lengths) + np.repeat(first * BLOCK, lengths)
    laid = np.ones((int(count.sum()) * BLOCK, potentials.shape[1]))
    laid[place] = potentials
    real = np.zeros(len(laid), dtype=bool)
    real[place] = True
    return laid.reshape(-1, BLOCK, potentials.shape[1]), real.reshape(-1, BLOCK), first, count


def _norm(x: np.ndarray, axis) -> np.ndarray:
    return x / np.maximum(x.sum(axis=axis, keepdims=True), 1e-300)


def _transfer(laid: np.ndarray, real: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Each block's matrix from the language before it to that of its last word."""
    n = steps.shape[0]
    out = np.broadcast_to(np.eye(n), (len(laid), n, n)).copy()
    for t in range(BLOCK):
        on = real[:, t]
        if not on.any():
            break
        out[on] = _norm((out[on] @ steps) * laid[on, t][:, None, :], (1, 2))
    return out


def marginals(potentials: np.ndarray, lengths: np.ndarray, steps: np.ndarray, into: np.ndarray | None = None, onward: np.ndarray | None = None, pairs: np.ndarray | None = None) -> np.ndarray:
    """Posterior of each word's language, texts one after another (each of one word or more).

    ``into`` and ``onward``: messages from before the first and from after the last word of each text, uniform
    if not given. ``pairs`` gets the expected numbers of steps between the words of a text added."""
    n = steps.shape[0]
    laid, real, first, count = _blocks(potentials, lengths)
    matrices = _transfer(laid, real, steps)
    a_in, b_out = np.empty((len(laid), n)), np.empty((len(laid), n))
    a_in[first] = np.full((len(lengths), n), 1 / n) if into is None else into
    b_out[first + count - 1] = np.full((len(lengths), n), 1 / n) if onward is None else onward
    for k in range(1, int(count.max())):
        at = first[count > k] + k
        a_in[at] = _norm(np.einsum("bi,bij->bj", a_in[at - 1], matrices[at - 1]), 1)
    for k in range(int(count.max()) - 1, 0, -1):
        at = first[count > k] + k
        b_out[at - 1] = _norm(np.einsum("bij,bj->bi", matrices[at], b_out[at]), 1)
    forward = np.empty_like(laid)
    begins = np.zeros(len(laid), dtype=bool)
    begins[first] = True
    a = a_in
    for t in range(BLOCK):
        on = real[:, t][:, None]
        a = np.where(on, _norm((a @ steps) * laid[:, t], 1), a)
        forward[:, t] = a
    b = b_out
    for t in range(BLOCK - 1, -1, -1):
        on = real[:, t][:, None]
        here = laid[:, t] * b
        if pairs is not None:
            before = forward[:, t - 1] if t else a_in
            inside = real[:, t] & ~begins if t == 0 else real[:, t]
            both = before[inside][:, :, None] * steps[None] * here[inside][:, None, :]
            pairs += _norm(both, (1, 2)).sum(axis=0)
        forward[:, t] = _norm(forward[:, t] * b, 1)
        b = np.where(on, _norm(here @ steps.T, 1), b)
    return forward.reshape(-1, n)[real.reshape(-1)]


def shares(field: Field, table_of: np.ndarray, idx: np.ndarray) -> np.ndarray:
    """Mean posterior of a very long text's words, chunk by chunk."""
    steps, n = np.exp(field.steps), len(field.languages)
    potential = lambda part: np.exp((e := table_of[part].astype(float)) - e.max(axis=1, keepdims=True))
    parts = [idx[k : k + CHUNK] for k in range(0, len(idx), CHUNK)]
    through = []
    for part in parts:
        laid, real, _, _ = _blocks(potential(part), np.array([len(part)]))
        total = np.eye(n)
        for m in _transfer(laid, real, steps):
            total = _norm(total @ m, (0, 1))
        through.append(total)
    into, onward = [np.full(n, 1 / n)], [np.full(n, 1 / n)]
    for m in through[:-1]:
        into.append(_norm(into[-1] @ m, 0))
    for m in through[:0:-1]:
        onward.append(_norm(m @ onward[-1], 0))
    total = np.zeros(n)
    for part, a, b in zip(parts, into, onward[::-1], strict=True):
        total += marginals(potential(part), np.array([len(part)]), steps, a[None], b[None]).sum(axis=0)
    return total / len(idx)


def joined(texts: list[list[str]], labels: list[int]) -> tuple[list[list[str]], list[list[int]]]:
    """Sequences of one to JOINED spans of the texts, in an order drawn once, and the language of each word."""
    random = np.random.default_rng(11)
    spans = []
    for words_of, label in zip(texts, labels, strict=True):
        left = words_of
        for at in sorted(random.integers(0, max(1, len(left)), min(SPANS, 1 + len(left) // LONGEST)).tolist()):
            spans.append((left[at : at + int(random.integers(3, LONGEST + 1))], label))
    order, out, gold, k = random.permutation(len(spans)), [], [], 0
    while k < len(order):
        some = [spans[i] for i in order[k : k + int(random.integers(1, JOINED + 1))]]
        out.append([w for s, _ in some for w in s])
        gold.append([label for s, label in some for _ in s])
        k += len(some)
    return out, gold


def train(sequences: list[list[str]], gold: list[list[int]], languages: list[str]) -> Field:
    """``gold``: the language of each word of each sequence."""
    n = len(languages)
    known: dict[str, int] = {}
    idx = np.array([known.setdefault(w, len(known)) for t in sequences for w in t], dtype=np.int64)
    lengths = np.array([len(t) for t in sequences])
    label = np.concatenate([np.array(g, dtype=np.int64) for g in gold])
    # only bins that some word has are learnt
    groups = list(feature_bins(list(known)))
    used, place = np.unique(np.concatenate([bins.ravel() for _, bins in groups]), return_inverse=True)
    cuts = np.cumsum([bins.size for _, bins in groups])[:-1]
    groups = [(places, flat.reshape(bins.shape)) for (places, bins), flat in zip(groups, np.split(place, cuts), strict=True)]
    weights, steps = np.zeros((len(used), n)), np.log(np.where(np.eye(n, dtype=bool), STAY, (1 - STAY) / max(1, n - 1)))
    start, squares, step_squares = steps.copy(), np.full((len(used), n), 1e-8), np.full((n, n), 1e-8)
    seen, inside = np.zeros((n, n)), np.ones(len(label), dtype=bool)
    inside[np.concatenate([[0], np.cumsum(lengths)[:-1]])] = False
    np.add.at(seen, (label[np.flatnonzero(inside) - 1], label[inside]), 1)
    total = len(label)
    for _ in range(ROUNDS):
        table_of = np.zeros((len(known), n))
        for places, bins in groups:
            table_of[places] = weights[bins].sum(axis=1)
        e = table_of[idx]
        pairs = np.zeros((n, n))
        gap = -marginals(np.exp(e - e.max(axis=1, keepdims=True)), lengths, np.exp(steps), pairs=pairs)
        gap[np.arange(total), label] += 1
        gap /= total
        by_word = np.stack([np.bincount(idx, gap[:, k], minlength=len(known)) for k in range(n)], axis=1)
        slope = np.zeros((len(used), n))
        for places, bins in groups:
            flat = bins.ravel()
            for k in range(n):
                slope[:, k] += np.bincount(flat, np.repeat(by_word[places, k], bins.shape[1]), minlength=len(used))
        slope -= PENALTY * weights
        squares += slope * slope
        weights += RATE * slope / np.sqrt(squares)
        by_step = (seen - pairs) / total - HOLD * (steps - start)
        step_squares += by_step * by_step
        steps += RATE * by_step / np.sqrt(step_squares)
    every = np.zeros((BINS, n), dtype=np.float32)
    every[used] = weights
    return Field(languages, every, steps)


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(lang, text) of the texts that are learnt from; the bounds are the module's."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", FOLDS) != HELD_OUT))
    known = known.select("doc_id", "lang", "text")
    counts = durable(known.groupBy("lang").agg(F.count(F.lit(1)).alias("_n")))
    most = most_bytes // max(1, counts.count())
    # some more than asked for by a threshold on the hash, then exactly: few rows reach the windows
    draw = F.pmod(F.xxhash64(F.lit("lang"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    some = join_groups(known, counts, ["lang"], F.col("doc_id")).where(draw * F.col("_n") < 2 * per_language + 50)
    order = Window.partitionBy("lang").orderBy(F.xxhash64(F.lit("lang"), "doc_id"), "doc_id", "text")
    some = some.withColumns({"_rank": F.row_number().over(order), "_before": F.coalesce(F.sum(F.octet_length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    return some.where((F.col("_rank") <= per_language) & ((F.col("_rank") == 1) | (F.col("_before") <= most))).select("lang", "text")


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, most_bytes: int = SAMPLE_BYTES) -> Field | None:
    got = sample(docs, per_language, most_bytes).collect()
    languages = sorted({r["lang"] for r in got})
    rows = sorted((zlib.crc32(r["text"].encode("utf-8", "replace")), languages.index(r["lang"]), w) for r in got if (w := words(r["text"])))
    if not rows:
        return None
    return train(*joined([w for _, _, w in rows], [k for _, k, _ in rows]), languages)


class _Index(dict):
    """Word to its row in the emission table; new words wait until ``settle``."""

    def __init__(self, field: Field):
        super().__init__()
        self.field, self.new = field, []
        self.rows = np.zeros((0, len(field.languages)), dtype=np.float32)

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        self.new.append(word)
        return at

    def settle(self) -> np.ndarray:
        if self.new:
            self.rows = np.concatenate([self.rows, self.field.emissions(self.new)])
            self.new = []
        return self.rows

    def forget(self) -> None:
        if len(self) > REMEMBERED:
            self.clear()
            self.rows = self.rows[:0]


def label_words(field: Field, text: str) -> list[tuple[int, int, str, float]]:
    """(begin, end, language, posterior) of each run of words with one language: where a text switches."""
    found = list(_WORD.finditer(text))
    if not found:
        return []
    e = field.emissions([m[0].lower() for m in found]).astype(float)
    p = marginals(np.exp(e - e.max(axis=1, keepdims=True)), np.array([len(found)]), np.exp(field.steps))
    best, out = p.argmax(axis=1), []
    for i, m in enumerate(found):
        if out and best[i] == best[i - 1]:
            out[-1] = [out[-1][0], m.end(), out[-1][2], min(out[-1][3], float(p[i, best[i]]))]
        else:
            out.append([m.start(), m.end(), field.languages[best[i]], float(p[i, best[i]])])
    return [tuple(x) for x in out]


def predict(docs: DataFrame, field: Field | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score: one row a document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _Index(field) if field else None
        for batch in pieces(batches, "text", 1 << 20):
            n = batch.num_rows
            best, score = ["und"] * n, np.zeros(n)
            if field:
                idx, lengths, rows = [], [], []
                for r, raw in enumerate(batch.column("text").to_pylist()):
                    t = raw.decode("utf-8", "replace").lower()
                    if not any(map(str.isalpha, t)):
                        continue
                    if len(t) > 8 * CHUNK:
                        some = np.fromiter((index[m[0]] for m in _WORD.finditer(t)), dtype=np.int32)
                        share = shares(field, index.settle(), some)
                        best[r], score[r] = field.languages[int(share.argmax())], share.max()
                    else:
                        some = _WORD.findall(t)
                        idx += map(index.__getitem__, some)
                        lengths.append(len(some))
                        rows.append(r)
                if rows:
                    e = index.settle()[np.array(idx)].astype(float)
                    p = marginals(np.exp(e - e.max(axis=1, keepdims=True)), np.array(lengths), np.exp(field.steps))
                    share = np.add.reduceat(p, np.concatenate([[0], np.cumsum(lengths)[:-1]]), axis=0) / np.array(lengths)[:, None]
                    for r, k, s in zip(rows, share.argmax(axis=1), share.max(axis=1), strict=True):
                        best[r], score[r] = field.languages[int(k)], s
                index.forget()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(best), pa.array(np.clip(score, 0, 1))], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), utf8(text).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op5_languages(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predict(docs.select("doc_id", "text"), fit(docs))
    return out.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")
