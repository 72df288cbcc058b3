"""SentencePiece encoding and decoding by a max-plus scan over a piece lattice.

The model file's merges decide which pieces may follow each other: a path through the lattice is the
model's own encoding if and only if each two neighbouring pieces, encoded alone, stay these two (merges
go by score and then place, so what happens on either side of a pair changes nothing in it). A step between two
pieces so weighs 0 where the pair stays and minus infinity where a merge would cross it; the best path
of the lattice is the encoding, and it equals the SentencePiece library's ids.

Most texts are scanned in one go: all paths meet wherever no piece of the vocabulary holds the two
neighbouring characters, so the spans between such places are solved on their own and remembered.
Texts over ``GIANT`` characters are cut into chunks wherever they fall. A chunk's boundary states are the
pieces that reach over its edges; it yields the max-plus matrix from the states at its left edge to those at
its right edge. The matrices are combined associatively in a tree, FAN neighbours to one, level by level
in parallel; on the way back each node passes its children the states at their edges, and each chunk is then
backtraced on its own, given the states at its two edges. No task holds more than FAN matrices or some chunks.

Only model files whose settings this encoding follows are accepted (``settings``): merges, byte fallback, text as it
is, a space put before it. Defined results: null and empty text have no ids and decode to the empty text; U+2581 comes
back as a space, as in the library, and each lone surrogate or broken byte as U+FFFD; repeated rows each give a row;
an empty table gives an empty one; other columns pass through ``encode`` and ``decode``, whatever their names.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from .common import durable, fresh, pieces, sha256, table, utf8

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Characters of a text that is cut into chunks, and of a chunk; matrices that one combines; solved spans that a worker remembers.
GIANT, CHUNK, FAN, REMEMBERED = 24 << 10, 1 << 12, 64, 200_000
#: Longer spans are solved place by place and not remembered.
LONG = 64
NONE = -np.inf


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message's fields."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            n = number() if kind == 2 else {1: 8, 5: 4}[kind]
            at += n
            yield key >> 3, data[at - n : at]


def settings(model: bytes) -> dict:
    """What a model file says of its kind and its treatment of text. Field numbers are the file format's."""
    top: dict[int, bytes] = {k: v for k, v in _fields(model) if k in (2, 3)}
    trainer, normalizer = dict(_fields(top.get(2, b""))), dict(_fields(top.get(3, b"")))
    return {
        "bpe": trainer.get(3, 1) == 2,
        "byte_fallback": bool(trainer.get(35, 0)),
        "suffix_spaces": bool(trainer.get(24, 0)),
        "own_symbols": any(k in (30, 31) for k in trainer),
        "as_it_is": not normalizer.get(2),
        "space_before": bool(normalizer.get(3, 1)),
        "fewer_spaces": bool(normalizer.get(4, 1)),
        "spaces_escaped": bool(normalizer.get(5, 1)),
    }


#: What the lattice's steps rest on.
FOLLOWED = {"bpe": True, "byte_fallback": True, "suffix_spaces": False, "own_symbols": False, "as_it_is": True, "space_before": True, "fewer_spaces": False, "spaces_escaped": True}


class Vocabulary:
    """The pieces of a model file, which neighbours stay, and the spans solved so far."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        if wrong := {k: v for k, v in settings(model).items() if v != FOLLOWED[k]}:
            raise ValueError(f"a model of another kind: {wrong}")
        read = SentencePieceProcessor(model_proto=model)
        ids = range(read.vocab_size())
        special = lambda i: read.is_byte(i) or read.is_control(i) or read.is_unknown(i) or read.is_unused(i)
        self.pieces = {read.id_to_piece(i): i for i in ids if not special(i)}
        self.scores = {p: read.get_score(i) for p, i in self.pieces.items()}
        self.byte_ids = [read.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.longest = max(map(len, self.pieces))
        self.inside = {p[i : i + 2] for p in self.pieces for i in range(len(p) - 1)}
        self.spans = self._spans()
        self.ends = {p[i:] for p in self.pieces for i in range(len(p))}
        #: For each piece, whether it may follow another.
        self.follows: dict[str, dict[str, bool]] = {}
        self.pairs = 0
        self.bytes_of = [read.id_to_piece(i).replace(SPACE, " ").encode() if not special(i) else b"" for i in ids]
        for b, i in enumerate(self.byte_ids):
            self.bytes_of[i] = bytes([b])
        self.solved = _Solved(self)

    def _spans(self) -> re.Pattern:
        """Finds spans that no piece reaches out of, as far as one expression can tell: before a space,
        around a line feed, and after a word, each where the vocabulary allows it."""
        if any(a != SPACE and b == SPACE for a, b in self.inside):
            return re.compile("(?s).+")
        line = "" if any("\n" in x for x in self.inside) else "\\n"
        found = [f"{SPACE}*[^{SPACE}{line}]+", f"{SPACE}+", *([line] if line else [])]
        # a word ends after a letter; letters after which pieces go on otherwise don't count as such
        letter, more = "[^\\W\\d_]", "[^\\W_]"
        other = {a for a, b in self.inside if re.match(letter, a) and not re.match(more, b)}
        if len(other) <= 16:
            letter = f"[^\\W\\d_{re.escape(''.join(sorted(other)))}]"
            found = [f"{SPACE}*{letter}+(?!{more})", f"{SPACE}*[^{SPACE}{line}]*?{letter}(?!{more})", *found]
        return re.compile("|".join(found))

    def merged(self, text: str) -> list[str]:
        """A short text's pieces by merging: highest score first, leftmost first."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def pair(self, a: str, b: str) -> bool:
        """Whether b may follow a (a empty: b may stand alone)."""
        known = self.follows.setdefault(b, {})
        if (ok := known.get(a)) is None:
            if self.pairs >= REMEMBERED:
                self.pairs = 0
                self.follows.clear()
            self.pairs += 1
            if not a or a[-1] + b[0] not in self.inside:
                ok = len(b) == 1 or (self.pair("", b) if a else self.merged(b) == [b])
            else:
                ok = self.merged(a + b) == [a, b]
            known[a] = ok
        return ok

    def paths(self, text: str, start: int, first: str, stop: int) -> list[str | None]:
        """For each place up to ``stop`` the piece that ends there on the best path from ``start``, where
        the piece ``first`` has just ended (empty: the text's begin); None where no path ends."""
        known, pair, longest = self.pieces, self.pair, self.longest
        last: list[str | None] = [None] * (stop + 1)
        last[start] = first
        for end in range(start + 1, stop + 1):
            for begin in range(end - 1, max(start, end - longest) - 1, -1):
                before = last[begin]
                if before is None:
                    continue
                piece = text[begin:end]
                if begin < end - 1 and piece not in known:
                    continue
                if pair(before, piece):
                    last[end] = piece
                    break
        return last

    def back(self, last: list[str | None], end: int, start: int) -> list[str]:
        out = []
        while end > start:
            out.append(last[end])
            end -= len(out[-1])
        return out[::-1]

    def ids(self, parts: Iterable[str]) -> list[int]:
        out = []
        for p in parts:
            i = self.pieces.get(p)
            out += [i] if i is not None else [self.byte_ids[b] for b in p.encode("utf-8", "replace")]
        return out

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, as 32-bit integers."""
        if not text:
            return b""
        return self.between(SPACE + text.replace(" ", SPACE))

    def between(self, text: str) -> bytes:
        """The ids of a stretch between two places that no piece holds."""
        return b"".join(map(self.solved.__getitem__, self.spans.findall(text)))

    def decode(self, ids: np.ndarray) -> str:
        of = self.bytes_of
        text = b"".join([of[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


class _Solved(dict):
    """Short span to the ids of its best path; forgets all when full, so memory is bounded.

    The best path to a place depends on what stands before it alone, so a span's path is its last
    piece after the best path of the rest, and spans that begin alike share that."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary
        self.last: dict[str, str] = {}
        self.coded: dict[str, bytes] = {}

    def __missing__(self, span: str) -> bytes:
        if len(span) > LONG:
            v = self.vocabulary
            return array("i", v.ids(v.back(v.paths(span, 0, "", len(span)), len(span), 0))).tobytes()
        if len(self) >= REMEMBERED:
            self.clear()
            self.last.clear()
        self.grow(span)
        return self[span]

    def grow(self, span: str) -> str:
        """Solves a span; its last piece."""
        v, n, some = self.vocabulary, len(span), []
        ends, known, follows = v.ends, v.pieces, v.follows
        for begin in range(n - 1, -1, -1):
            piece = span[begin:]
            if piece not in ends:
                break
            if piece in known:
                some.append(piece)
        if not some or len(some[0]) > 1:
            some.insert(0, span[-1])
        for piece in reversed(some):
            rest = span[: n - len(piece)]
            before = (self.last.get(rest) or self.grow(rest)) if rest else ""
            ok = follows[piece].get(before) if piece in follows else None
            if ok or ok is None and v.pair(before, piece):
                break
        if (code := self.coded.get(piece)) is None:
            code = array("i", v.ids([piece])).tobytes()
            if len(self.coded) < REMEMBERED:
                self.coded[piece] = code
        self[span] = self.get(rest, b"") + code
        self.last[span] = piece
        return piece


_vocabularies: dict[int, Vocabulary] = {}


def vocabulary(shared) -> Vocabulary:
    """The vocabulary of a broadcast model file, built once a worker."""
    if shared.id not in _vocabularies:
        _vocabularies[shared.id] = Vocabulary(shared.value)
    return _vocabularies[shared.id]


class Shared:
    """A broadcast of the model file (its size is fixed: half a megabyte), with an id workers can keep it under."""

    def __init__(self, spark, path: str):
        from pathlib import Path

        model = Path(path).read_bytes()
        self.id, self._file = sha256(model), spark.sparkContext.broadcast(model)

    @property
    def value(self) -> bytes:
        return self._file.value


# --- chunks of giant texts -------------------------------------------------------------------------


def edge_states(v: Vocabulary, text: str, at: int) -> list[tuple[int, int]]:
    """The (begin, end) of every piece that holds the character before ``at``: what a path can have there."""
    if at == 0:
        return [(0, 0)]
    found = []
    for begin in range(max(0, at - v.longest), at):
        for end in range(at, min(len(text), begin + v.longest) + 1):
            if end - begin == 1 or text[begin:end] in v.pieces:
                found.append((begin, end))
    return found


def transfer(v: Vocabulary, text: str, left: int, right: int) -> np.ndarray:
    """The max-plus matrix of the chunk [left, right) from its left to its right states.

    From the first place that all paths cross, the rows are the same, so one scan serves them all."""
    into, out = edge_states(v, text, left), edge_states(v, text, right)
    matrix = np.full((len(into), len(out)), NONE)
    meet = next((i for i in range(max(e for _, e in into), right) if i > 0 and text[i - 1 : i + 1] not in v.inside), None)
    cut = max((i for i in range(max(0, right - 2 * v.longest), right) if meet is not None and i >= meet and text[i - 1 : i + 1] not in v.inside), default=meet)

    def leave(last: list[str | None], row: int) -> None:
        for k, (begin, end) in enumerate(out):
            if begin < len(last) and last[begin] is not None and v.pair(last[begin], text[begin:end]):
                matrix[row, k] = 0.0

    shared = None if cut is None else v.paths(text, cut, "", right)
    for row, (begin, end) in enumerate(into):
        piece = text[begin:end]
        if left and len(piece) > 1 and not v.pair("", piece):
            continue
        if cut is None:
            if end >= right:  # the piece reaches over the whole chunk
                for k, state in enumerate(out):
                    matrix[row, k] = 0.0 if state == (begin, end) else NONE
                if end > right:
                    continue
            leave(v.paths(text, end, piece, right), row)
        elif v.paths(text, end, piece, meet)[meet] is not None:
            leave(shared, row)
    return matrix


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product, which is associative."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def product(matrices: list[np.ndarray]) -> np.ndarray:
    out = matrices[0]
    for m in matrices[1:]:
        out = combine(out, m)
    return out


def choose(matrices: list[np.ndarray], first: int = 0, last: int | None = None) -> list[int]:
    """The states at the edges of neighbouring chunks on the best path, from state ``first`` before them to ``last`` behind
    them (None: the best): one more than there are matrices."""
    ahead = [np.where(np.arange(matrices[0].shape[0]) == first, 0.0, NONE)]
    for m in matrices:
        ahead.append((ahead[-1][:, None] + m).max(axis=0))
    states = [int(ahead[-1].argmax()) if last is None else last]
    for k in range(len(matrices) - 1, -1, -1):
        states.append(int((ahead[k] + matrices[k][:, states[-1]]).argmax()))
    return states[::-1]


def trace(v: Vocabulary, text: str, left: int, right: int, begin: tuple[int, int], end: tuple[int, int]) -> bytes:
    """The ids of the best path from state ``begin`` at ``left`` up to and with state ``end`` at ``right``.

    Between the first and the last place that all paths cross, the path depends on neither state."""
    if begin == end:
        return b""
    coded = lambda parts: array("i", v.ids(parts)).tobytes()
    first, last_piece = text[begin[0] : begin[1]], text[end[0] : end[1]]
    crossed = lambda i: i > 0 and text[i - 1 : i + 1] not in v.inside
    one = next((i for i in range(begin[1], end[0] + 1) if crossed(i)), None)
    if one is None:
        return coded([*v.back(v.paths(text, begin[1], first, end[0]), end[0], begin[1]), last_piece])
    two = next(i for i in range(end[0], one - 1, -1) if crossed(i))
    head = v.back(v.paths(text, begin[1], first, one), one, begin[1])
    tail = v.back(v.paths(text, two, "", end[0]), end[0], two)
    return coded(head) + v.between(text[one:two]) + coded([*tail, last_piece])


def _packed(m: np.ndarray) -> dict:
    return {"_width": m.shape[1], "_cells": (m.ravel() == 0).tolist()}


def _unpacked(x: dict) -> np.ndarray:
    return np.where(np.array(x["_cells"], dtype=bool).reshape(-1, x["_width"]), 0.0, NONE)


def _edges(found: DataFrame, most: int) -> DataFrame:
    """(_row, _k, _from, _to): the states at the edges of each chunk, from the chunks' matrices (_row, _k, _width, _cells).

    ``most``: chunks of the longest text. The tree has log(most) / log(FAN) levels."""

    @pandas_udf("struct<_width: int, _cells: array<boolean>>")
    def products(groups: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_packed(product([_unpacked(x) for x in g])) for g in groups], columns=["_width", "_cells"])

    @pandas_udf("array<int>")
    def chosen(groups: pd.Series, first: pd.Series, last: pd.Series) -> pd.Series:
        return pd.Series([choose([_unpacked(x) for x in g], int(a), None if b < 0 else int(b)) for g, a, b in zip(groups, first, last, strict=True)], dtype=object)

    levels, now = [], found
    while True:
        grouped = now.groupBy("_row", F.floor(F.col("_k") / FAN).cast("int").alias("_g")).agg(F.sort_array(F.collect_list(F.struct("_k", "_width", "_cells"))).alias("_m"))
        levels.append(grouped)
        most = -(-most // FAN)
        if most <= 1:
            break
        now = grouped.select("_row", F.col("_g").alias("_k"), products("_m").alias("_p")).select("_row", "_k", "_p._width", "_p._cells")
    states = levels.pop().select("_row", "_g", chosen("_m", F.lit(0), F.lit(-1)).alias("_states"), F.transform("_m", lambda x: x["_k"]).alias("_ks"))
    while True:
        edges = states.select("_row", F.posexplode("_ks").alias("_i", "_k"), "_states")
        edges = edges.select("_row", "_k", F.get("_states", F.col("_i")).alias("_from"), F.get("_states", F.col("_i") + 1).alias("_to"))
        if not levels:
            return edges
        below = levels.pop()
        above = edges.toDF("_r", "_h", "_from", "_to")
        states = below.join(above, (F.col("_row") == F.col("_r")) & (F.col("_g") == F.col("_h")))
        states = states.select("_row", "_g", chosen("_m", "_from", "_to").alias("_states"), F.transform("_m", lambda x: x["_k"]).alias("_ks"))


def _giants(giants: DataFrame, shared: Shared) -> DataFrame:
    """_row, ids for the rows (_row, _text) of giant texts, which are durable."""

    def chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longest = vocabulary(shared).longest
        for batch in pieces(batches, "_text"):
            for row, raw in zip(batch.column("_row").to_pylist(), batch.column("_text").to_pylist(), strict=True):
                text = SPACE + raw.decode("utf-8", "replace").replace(" ", SPACE)
                made = []
                for k, left in enumerate(range(0, len(text), CHUNK)):
                    low = max(0, left - longest)
                    right = min(len(text), left + CHUNK)
                    made.append((row, k, left - low, right - low, text[low : right + longest]))
                    if len(made) == 256 or right == len(text):
                        columns = [pa.array(c, kind) for c, kind in zip(zip(*made, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()), strict=True)]
                        yield pa.RecordBatch.from_arrays(columns, names=["_row", "_k", "_left", "_right", "_part"])
                        made = []

    def matrices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(shared)
        for batch in pieces(batches, "_part"):
            made = [transfer(v, *x) for x in zip(*(batch.column(c).to_pylist() for c in ("_part", "_left", "_right")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("_k"), pa.array([m.shape[1] for m in made], pa.int32()), pa.array([(m.ravel() == 0).tolist() for m in made], pa.list_(pa.bool_()))], names=["_row", "_k", "_width", "_cells"])

    def traced(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(shared)
        for batch in pieces(batches, "_part"):
            made = []
            for text, left, right, a, b in zip(*(batch.column(c).to_pylist() for c in ("_part", "_left", "_right", "_from", "_to")), strict=True):
                begin = edge_states(v, text, left)[a]
                made.append(trace(v, text, left, right, begin, edge_states(v, text, right)[b]))
            yield _with_ids(batch.select(["_row", "_k"]), made, "ids")

    most = giants.agg(F.max(F.octet_length("_text"))).first()[0] or 0  # at least as many as characters
    cut = giants.mapInArrow(chunks, "_row long, _k int, _left int, _right int, _part string").repartition("_row", "_k")
    found = cut.mapInArrow(matrices, "_row long, _k int, _width int, _cells array<boolean>")
    edges = _edges(found, most // CHUNK + 1).toDF("_r", "_j", "_from", "_to")
    work = cut.join(edges, (F.col("_row") == F.col("_r")) & (F.col("_k") == F.col("_j"))).select("_row", "_k", "_left", "_right", "_part", "_from", "_to")
    parts = work.mapInArrow(traced, "_row long, _k int, ids array<int>")
    return parts.groupBy("_row").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("_k", "ids"))), lambda x: x["ids"])).alias("ids"))


def _with_ids(batch: pa.RecordBatch, made: list[bytes], into: str) -> pa.RecordBatch:
    values = pa.Array.from_buffers(pa.int32(), sum(map(len, made)) // 4, [None, pa.py_buffer(b"".join(made))])
    offsets = np.zeros(len(made) + 1, dtype=np.int32)
    np.cumsum([len(x) // 4 for x in made], out=offsets[1:])
    return pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), values)], names=[*batch.schema.names, into])


def encode(docs: DataFrame, text: str = "text", model: str = MODEL, giant: int | None = None, then=None, schema: str = "") -> DataFrame:
    """The documents with ``ids``, the model's encoding of each whole text (``ids_`` where they have a column of that name).

    ``then`` may be a further step over the record batches in the same Python worker (a function of
    the batches and the vocabulary, which returns ``schema``). The texts are looked at twice: for their
    length, then to encode those that aren't giant."""
    shared, giant = Shared(docs.sparkSession, model), GIANT if giant is None else giant
    into, row, other = fresh(docs.columns, "ids", "_row", "_other")

    def after(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return then(batches, vocabulary(shared)) if then else iter(batches)

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(shared)
        made = (_with_ids(b, [v.encode(t or "") for t in b.column(text).to_pylist()], into) for b in pieces(batches, text))
        return after(made)

    kept = T.StructType([*docs.schema.fields, T.StructField(into, T.ArrayType(T.IntegerType()))])
    out = schema if then else kept
    long = F.coalesce(F.length(text), F.lit(0)) > giant
    giants = durable(docs.where(long).withColumn(row, F.monotonically_increasing_id()))
    made = _giants(giants.select(F.col(row).alias("_row"), utf8(text).alias("_text")), shared)
    solved = giants.join(made.toDF(other, into), F.col(row) == F.col(other)).select(*docs.columns, into)
    return docs.where(~long).mapInArrow(whole, out).unionByName(solved.mapInArrow(after, out) if then else solved)


def decoded(batch: pa.RecordBatch, v: Vocabulary, ids: str = "ids") -> list[str]:
    """The texts that a batch's ids stand for."""
    found = batch.column(ids)
    values, offsets = found.values.to_numpy(zero_copy_only=False), found.offsets.to_pylist()
    return [v.decode(values[a:b]) for a, b in zip(offsets, offsets[1:])]


def decode(encoded: DataFrame, into: str = "decoded", model: str = MODEL, ids: str = "ids") -> DataFrame:
    """The rows with the text that their ids stand for (a ``_`` added where they have such a column); null ids: the empty text."""
    shared = Shared(encoded.sparkSession, model)
    (into,) = fresh(encoded.columns, into)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(shared)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                some = batch.slice(k, 500)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(decoded(some, v, ids), pa.string())], names=[*some.schema.names, into])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField(into, T.StringType())]))


_DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_chars long, decoded_sha256 string, same_text boolean"


def _digests(batches: Iterable[pa.RecordBatch], v: Vocabulary) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, back = batch.column("text").to_pylist(), decoded(batch, v)
        ids = [np.asarray(x, dtype="<i4").tobytes() for x in (batch.column("ids")[i].values.to_numpy(zero_copy_only=False) for i in range(batch.num_rows))]
        columns = [batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(sha256, ids)), pa.array(map(len, back), pa.int64()), pa.array([sha256(t.encode()) for t in back]), pa.array([a == (b or "") for a, b in zip(back, texts, strict=True)])]
        yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _DIGESTS.split(", ")])


def op2_tokens(spark, sf_dir: str) -> DataFrame:
    """Per document its number of ids, their digest, and what they decode to."""
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"), then=_digests, schema=_DIGESTS)
