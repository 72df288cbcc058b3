"""SimHash near-dedup for a stated similarity: pairs of texts of Jaccard similarity 0.8 or more in word shingles.

Sixty-four SimHash bits can't tell such pairs: at similarity 0.8 two fingerprints differ in ten bits on the
average, and no posting of shared bytes is both small and certain. So here a fingerprint is as wide as it must be, over
1000 bits, each the majority of that bit in all shingles' hashes, as in the operator, and positions are half bytes. The rest is
the operator's method as well: an inverted index over positions, a tally of the positions that a pair shares, a least tally, and a
check of what passes, here of the whole shingle sets.

A posting key is three neighbouring positions with what stands there, beyond ``MANY`` texts four. There are so many that a pair at
the limit misses all its postings with a probability of at most ``MISS``; pairs above it less. ``differing`` says how often a
bit differs at the limit, by counting all votes of small sets (whose bits differ more often: four shingles and the same with a
fifth in 0.19 of all bits, large ones in 0.15), so sets of few shingles have more positions. What is linked is exact.

Keys so short are met by chance, by N / 4096 other texts in a posting. So a posting's row carries the set's size and the fingerprint's
first 192 bits, and where postings are streamed, rows that differ too much there from all others of their posting go at once. Postings
of more than ``LIMIT`` rows, and those that may go on in another partition, pass whole.

What shares a posting is known by its whole set. A set of which more than a share of 1 - similarity of the shingles stand in no other of
these sets can't be similar to any, so its rows go: an exact bound, which empties dense groups of those that are only somewhat like the rest.

Equal sets are one node and never pairs. Dense groups aren't paired with each other: rounds of links contract
them first, from each node to the likest of the few neighbours it meets most often, then one pair for each two components. What
then still shares a posting across components is compared without a cap, but not as rows of pairs: large postings are
dealt into blocks, each two blocks meet in one group, and there array operations tally the positions and bound the
overlap by bitmaps of the sets (a common shingle is a common bit, but for those that fell on one bit). Only pairs
that the bound allows are made, and checked on the sets.

Defined results: words are split at white space and A-Z lowered; a text of fewer than ``SHINGLE`` words is one shingle;
null and empty text are the empty set, like each other only; null ids never are a component's id unless all are
null; repeated rows give a row each; an empty table gives an empty one; ``one_of_each`` keeps other columns,
whatever their names. Ids are integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import postings
from .common import LOWER_TABLE, durable, join_groups, pieces, utf8, where_id
from .simhash import least_of_each

SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
#: Bits at a position; positions in a posting key, up to MANY texts and beyond. Either gives the same links.
HALF, PROBE, WIDE, MANY = 4, 3, 4, 1 << 18
#: The probability that a pair at the limit is missed.
MISS = 1e-6
#: Sets from so many shingles on have the positions of the largest, then of the middling, of the smallest sets.
SIZES = (48, 6, 0)
#: A posting of more rows isn't searched for rows that met by chance; how many bits a row carries for that.
LIMIT, CARRIED = 512, 192
#: The columns of the carried bits.
BITS = [f"bits{k}" for k in range(CARRIED // 64)]
#: Of the neighbours that a node has in its postings, how many are tried as links that contract dense groups.
TRIED = 8
#: Rounds in which dense groups are contracted before the rest is compared pair by pair.
ROUNDS = 3
#: Shingles whose bits are counted at once: the counts fit a byte.
BLOCK = 255
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Nodes of a posting in a block, and how many of them are compared with all of the other at once; bits of a bitmap for each shingle.
NODES, ROWS, DENSE = 1024, 32, 16


def _votes(n: int) -> np.ndarray:
    """How likely n shingles have 0 to n ones in a bit."""
    return np.array([math.comb(n, k) / 2**n for k in range(n + 1)])


def _apart(both: int, one: int, other: int) -> float:
    """How likely a bit differs between two sets with ``both`` common shingles and some of their own."""
    k = np.arange(both + 1)

    def ones(own: int) -> np.ndarray:  # how likely the bit is set, for each number of ones among the common shingles
        over = np.append(np.cumsum(_votes(own)[::-1])[::-1], 0.0)
        least = (both + own) // 2 + 1 - k
        return over[np.clip(least, 0, own + 1)]

    a, b = ones(one), ones(other)
    return float((_votes(both) * (a * (1 - b) + b * (1 - a))).sum())


@cache
def differing(similarity: float) -> tuple[float, ...]:
    """How often a bit differs at most in different sets of the similarity, the larger of at least SIZES shingles each.

    Counted to sizes of 64; beyond, sums of votes are normal and it falls to the angle between the sets."""
    most = {}
    for m in range(1, 65):
        pairs = [(c, x, m - c) for c in range(1, m + 1) for x in range(m - c + 1) if x + m - c and c / (m + x) >= similarity - 1e-12]
        most[m] = max((_apart(*p) for p in pairs), default=0.0)
    angle = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return tuple(max(angle, *(d for m, d in most.items() if m >= size)) for size in SIZES)


def shape(similarity: float, probe: int = PROBE) -> tuple[tuple[int, ...], int, tuple[int, int]]:
    """How many keys sets of SIZES have, how many positions a pair must share of the first's, and in how many carried bits it may
    differ, in the keys of middling sets and in those that only the smallest have."""
    keys = []
    for d in differing(similarity):
        same = (1 - d) ** (HALF * probe)
        keys.append(max(-(-CARRIED // (HALF * probe)), math.ceil(math.log(MISS) / math.log1p(-same)) if d else 1))
    n, same = keys[0] * probe, (1 - max(differing(similarity))) ** HALF
    least = max(1, math.floor(n * same - 5 * math.sqrt(n * same * (1 - same))))
    far = [math.floor(CARRIED * d + 5.5 * math.sqrt(CARRIED * d * (1 - d))) for d in differing(similarity)[1:]]
    return tuple(keys), least, (far[0], far[1])


def _hashes(words: list[bytes], size: int) -> np.ndarray:
    """The different shingles' hashes, ascending."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    last = ends[min(size, len(words)) - 1 :].tolist()
    first = [0, *(ends[: len(last) - 1] + 1).tolist()]
    hashed = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((hashed(joined[a:b], SEED) for a, b in zip(first, last, strict=True)), dtype=np.uint64, count=len(last)))


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    return _hashes(text.translate(LOWER_TABLE).split(), size)


def signature(hashes: np.ndarray, turn: np.ndarray, stretch: np.ndarray) -> np.ndarray:
    """The SimHash bits, a byte each: the majority of that bit in all hashes, of which ``turn`` and ``stretch`` make one a word
    of 64 bits. Blocks bound the memory of a very long text."""
    ones = np.zeros(64 * len(turn), dtype=np.int64)
    for k in range(0, len(hashes), BLOCK):
        x = (hashes[k : k + BLOCK, None] ^ turn) * stretch
        x ^= x >> np.uint64(32)
        x *= MIX
        x ^= x >> np.uint64(29)
        ones += np.add.reduce(np.unpackbits(x.view(np.uint8), axis=1), axis=0, dtype=np.uint8)
    return (2 * ones > len(hashes)).astype(np.uint8)


def _orders(n: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(SEED)
    return random.integers(0, 1 << 63, n, dtype=np.uint64), random.integers(0, 1 << 62, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _nodes(docs: DataFrame, size: int, n: tuple[int, ...], probe: int) -> DataFrame:
    """doc_id, node (hash of the set), n, words (the fingerprint, a key to an integer), BITS (the carried bits)."""
    width = HALF * probe

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, stretch = _orders(-(-max(n) * width // 64))
        for batch in pieces(batches, "text"):
            nodes, sizes, signed, carried = [], [], [], [np.zeros(0, dtype=np.uint8)]
            for text in batch.column("text").to_pylist():
                s = shingles(text, size)
                keys = next(k for k, least in zip(n, SIZES, strict=True) if len(s) >= least)
                used = -(-keys * width // 64)
                bits = signature(s, turn[:used], stretch[:used])
                nodes.append(xxhash.xxh64_intdigest(s.tobytes(), SEED))
                sizes.append(len(s))
                signed.append((bits[: keys * width].reshape(keys, width) @ (1 << np.arange(width))).astype(np.uint16).view(np.int16))
                carried.append(np.packbits(bits[:CARRIED]))
            values = pa.array(np.concatenate([np.zeros(0, dtype=np.int16), *signed]))
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in signed])]).astype(np.int32))
            first = np.concatenate(carried).view(np.int64).reshape(-1, len(BITS))
            columns = [batch.column("doc_id"), pa.array(np.array(nodes, dtype=np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(offsets, values)]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x.copy()) for x in first.T)], names=["doc_id", "node", "n", "words", *BITS])

    return docs.mapInArrow(run, "doc_id long, node long, n int, words array<smallint>, " + ", ".join(f"{b} long" for b in BITS))


def _keys(nodes: DataFrame) -> DataFrame:
    """(key, node, n, BITS): a row for each posting, with what it carries."""
    rows = nodes.select("node", "n", *BITS, F.posexplode("words").alias("at", "word"))
    return rows.select(F.shiftleft(F.col("at").cast("long"), 16).bitwiseOR(F.col("word").cast("long").bitwiseAND(0xFFFF)).alias("key"), "node", "n", *BITS)


def _close(key: np.ndarray, n: np.ndarray, bits: list[np.ndarray], similarity: float, far: tuple[int, int], common: int) -> np.ndarray:
    """Which rows, ordered by key, have another of their key whose size allows the similarity and that is within ``far`` carried bits
    (the second bound from the position ``common`` on); all rows of large postings."""
    most = np.where(key >> 16 < common, *far)
    begins = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(begins, len(key)))
    keep = np.repeat(size > LIMIT, size)
    at, lag = np.flatnonzero(~keep), 0
    while len(at):
        lag += 1
        at = at[at + lag < len(key)]
        at = at[key[at] == key[at + lag]]
        one, two = n[at], n[at + lag]
        some = at[np.minimum(one, two) >= similarity * np.maximum(one, two) - 1e-6]
        near = some[sum(np.bitwise_count(x[some] ^ x[some + lag]).astype(np.int64) for x in bits) <= most[some]]
        keep[near] = keep[near + lag] = True
    return keep


def _without_chance(batches: Iterable[pa.RecordBatch], similarity: float, far: tuple[int, int], common: int) -> Iterator[pa.RecordBatch]:
    """(key, node) of the rows that don't stand in their posting by chance only. The partition's first and last posting may go on
    in another one and pass whole."""
    held, passing = [np.zeros(0, dtype=x) for x in (np.int64, np.int64, np.int32, *[np.uint64] * len(BITS))], None

    def out(rows: list[np.ndarray], keep: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows[0][keep]), pa.array(rows[1][keep])], names=["key", "node"])

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy() for c in ("key", "node", "n", *BITS)]
        rows = [np.concatenate([a, b.view(a.dtype)]) for a, b in zip(held, columns, strict=True)]
        if passing is None:
            passing = rows[0][0]
        end = np.searchsorted(rows[0], rows[0][-1])  # the last posting isn't whole yet
        if len(rows[0]) - end > LIMIT:
            passing = rows[0][-1]
        done = [x[:end] for x in rows]
        if end:
            yield out(done, _close(done[0], done[2], done[3:], similarity, far, common) | (done[0] == passing))
        held = [x[end:] for x in rows]
        if held[0][0] == passing:
            yield out(held, np.ones(len(held[0]), dtype=bool))
            held = [x[:0] for x in held]
    yield out(held, np.ones(len(held[0]), dtype=bool))


def _meetings(rows: DataFrame, similarity: float, far: tuple[int, int], common: int) -> DataFrame:
    """(key, node, before), as ``postings.meetings``, without what met by chance."""
    ordered = rows.repartitionByRange("key", "node").sortWithinPartitions("key", "node")
    return durable(ordered.mapInArrow(lambda batches: postings._stream(_without_chance(batches, similarity, far, common)), "key long, node long, before long"))


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """node, found: the whole sets."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            made = [shingles(t, size).view(np.int64) for t in batch.column("text").to_pylist()]
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in made])]).astype(np.int32))
            found = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *made])))
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in made], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), found], names=["node", "found"])

    return docs.select("text").mapInArrow(run, "node long, found array<long>")


def _single(sets: DataFrame, similarity: float) -> DataFrame:
    """(node): the sets (node, found) that hold so many shingles alone that none of the others can be similar enough."""
    each = sets.select("node", F.explode("found").alias("shingle"))
    own = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("times"), F.min("node").alias("_node")).where("times = 1")
    own = own.groupBy("_node").agg(F.count(F.lit(1)).alias("own"))
    return sets.join(own, F.col("node") == F.col("_node")).where(F.col("own") > (1 - similarity) * F.size("found") + 1e-6).select("node")


def _shared(probe: int):
    """How many positions two fingerprints share."""
    zero = lambda x, i: F.when(F.shiftright(x.cast("int"), HALF * i).bitwiseAND((1 << HALF) - 1) == 0, 1).otherwise(0)
    same = F.zip_with("words_a", "words_b", lambda x, y: sum((zero(x.bitwiseXOR(y), i) for i in range(1, probe)), zero(x.bitwiseXOR(y), 0)))
    return F.aggregate(same, F.lit(0), lambda total, x: total + x)


def bitmap(hashes: np.ndarray) -> bytes:
    bits = np.zeros(1 << max(9, math.ceil(math.log2(max(1, DENSE * len(hashes))))), dtype=np.uint8)
    bits[(hashes & np.uint64(len(bits) - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def _bitmaps(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, made = batch.column("found"), []
        values, offsets = found.values.to_numpy().view(np.uint64), found.offsets.to_numpy()
        for a, b in zip(offsets, offsets[1:], strict=False):
            made.append(bitmap(values[a:b]))
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(made, pa.binary())], names=["_n", "bitmap"])


def _folded(words: np.ndarray, size: int) -> np.ndarray:
    """A bitmap brought to fewer words: the low bits of a hash tell the place, so halves lie on each other."""
    while len(words) > size:
        words = words[: len(words) // 2] | words[len(words) // 2 :]
    return words


def _allowed(maps: list[np.ndarray], n: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Which of the pairs (places a, b) may be similar enough, by an upper bound of their overlap."""
    out = np.zeros(len(a), dtype=bool)
    size = np.minimum([len(maps[i]) for i in a], [len(maps[i]) for i in b])
    for width in np.unique(size):
        at = np.flatnonzero(size == width)
        used, place = np.unique(np.concatenate([a[at], b[at]]), return_inverse=True)
        laid = np.stack([_folded(maps[i], width) for i in used])
        hidden = n[used] - np.bitwise_count(laid).sum(axis=1)  # shingles that fell on another's bit
        x, y = place[: len(at)], place[len(at) :]
        for k in range(0, len(at), step := max(1, (1 << 20) // int(width))):
            i, j, part = x[k : k + step], y[k : k + step], at[k : k + step]
            both = np.bitwise_count(laid[i] & laid[j]).sum(axis=1) + np.minimum(hidden[i], hidden[j])
            whole = n[a[part]] + n[b[part]]
            out[part] = both >= similarity / (1 + similarity) * whole - 1e-6
    return out


def _met(position: int, side: np.ndarray, node: np.ndarray, label: np.ndarray, n: np.ndarray, words: np.ndarray, maps: list[np.ndarray], similarity: float, least: int, probe: int = PROBE) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of one group that may link. A pair counts in the first posting that it shares only."""
    one, two = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if side.any() else (np.arange(len(node)),) * 2
    found = []
    for at in range(0, len(one), ROWS):  # a few rows against all columns: memory doesn't grow with the block's square
        some = one[at : at + ROWS]
        x, y = n[some][:, None], n[two][None]
        fine = (label[some][:, None] != label[two][None]) & (np.minimum(x, y) >= similarity * np.maximum(x, y) - 1e-6)
        if not side.any():
            fine &= some[:, None] < two[None]
        for k in range(min(position, words.shape[1])):
            fine &= words[some, k][:, None] != words[two, k][None]
        i, j = np.nonzero(fine)
        i, j = some[i], two[j]
        both = words[i] ^ words[j]
        tally = sum(((both >> HALF * k) & (1 << HALF) - 1 == 0).sum(axis=1) for k in range(probe))
        i, j = i[tally >= least], j[tally >= least]
        if len(i):
            fits = _allowed(maps, n, i, j, similarity)
            found.append((node[i[fits]], node[j[fits]]))
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *(a for a, _ in found)]), np.concatenate([none, *(b for _, b in found)])


def _blocks(rows: DataFrame, sketches: DataFrame, similarity: float, least: int, probe: int) -> DataFrame:
    """(a, b): pairs across labels that may link, from the open postings (key, node, label) and (node, n, words, bitmap)."""
    sizes = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / NODES).cast("int").alias("_nb"))
    dealt = join_groups(rows, durable(sizes), ["key"], F.col("node")).withColumn("_own", F.pmod(F.xxhash64("node"), F.col("_nb")).cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
    # with its own block a node meets the block, with another it is on the side of the smaller or of the larger
    dealt = dealt.select("key", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), (F.col("_own") > F.col("_other")).cast("int").alias("side"), F.col("node").alias("_node"), "label")
    dealt = dealt.join(sketches, F.col("_node") == F.col("node")).drop("_node")
    dealt = dealt.repartition("key", "_i", "_j").sortWithinPartitions("key", "_i", "_j", "node")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def solve() -> Iterator[pa.RecordBatch]:
            group = pa.Table.from_batches(held).combine_chunks()
            get = lambda c: group[c].to_numpy()
            label, side = get("label"), get("side")
            if group.num_rows < 2 or (label == label[0]).all():
                return
            words = np.stack([np.asarray(x, dtype=np.int16) for x in get("words")])
            maps = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in group["bitmap"]]
            a, b = _met(int(get("key")[0] >> 16), side, get("node"), label, get("n").astype(np.int64), words, maps, similarity, least, probe)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        last = None
        for batch in batches:
            mark = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "_i", "_j")], axis=1)
            cuts = np.flatnonzero((mark[1:] != mark[:-1]).any(axis=1)) + 1
            for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(mark)], strict=True):
                if begin == end:
                    continue
                if held and tuple(mark[begin]) != last:
                    yield from solve()
                    held = []
                held.append(batch.slice(begin, end - begin))
                last = tuple(mark[begin])
        if held:
            yield from solve()

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, size: int = SHINGLE) -> DataFrame:
    """doc_id, component_id (the least id): one row a document."""
    if not 0 < similarity <= 1 or size < 1:
        raise ValueError("similarity must be above 0 and at most 1, size at least 1")
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), utf8(text).alias("text"))
    probe = PROBE if docs.count() <= MANY else WIDE
    n, least_tally, far = shape(similarity, probe)
    made = durable(_nodes(docs, size, n, probe))
    nodes = durable(made.groupBy("node").agg(F.min("doc_id").alias("least"), *(F.first(c).alias(c) for c in ("n", "words", *BITS))))
    met = _meetings(_keys(nodes), similarity, far, n[1])
    # only small sets have positions beyond those of the largest; what is tallied all have
    nodes = nodes.select("node", "least", "n", F.slice("words", 1, n[0]).alias("words"))

    def alike(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b, ...) whose sizes and tallies allow the similarity."""
        of = lambda side: nodes.select(F.col("node").alias(f"_{side}"), F.col("n").alias(f"n_{side}"), F.col("words").alias(f"words_{side}"))
        both = pairs.join(of("a"), F.col("a") == F.col("_a")).join(of("b"), F.col("b") == F.col("_b"))
        fits = F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b") - 1e-6
        return both.where(fits).withColumn("tally", _shared(probe)).where(F.col("tally") >= least_tally).select(*pairs.columns, "tally")

    def sets_of(some: DataFrame) -> DataFrame:
        """(node, found) of the nodes ``some``, each read from its least document."""
        ids = durable(some.withColumnRenamed("node", "_node").join(nodes, F.col("_node") == F.col("node")).select("least").distinct())
        made = _sets(where_id(docs, "doc_id", ids, inside=True), size)
        # rows may repeat an id with other texts: only the nodes asked for, each once
        return durable(made.join(some.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left_semi").dropDuplicates(["node"]))

    # whole sets, once, of the nodes that share a posting
    sets = sets_of(durable(met.select("node").distinct()))
    single = durable(_single(sets, similarity)).withColumnRenamed("node", "_node")
    met = postings.meetings(durable(met.join(single, F.col("node") == F.col("_node"), "left_anti")))  # read twice
    near = met.where("before is not null").groupBy(F.col("node").alias("a"), F.col("before").alias("b")).agg(F.count(F.lit(1)).alias("times"))
    often = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("times"), "b"))
    near = durable(alike(near.withColumn("_often", often).where(F.col("_often") <= TRIED).select("a", "b")))

    def verified(pairs: DataFrame) -> DataFrame:
        of = lambda side: sets.select(F.col("node").alias(f"_{side}"), F.col("found").alias(f"s{side}"))
        both = pairs.join(of("a"), F.col("a") == F.col("_a")).join(of("b"), F.col("b") == F.col("_b"))
        shared = F.size(F.array_intersect("sa", "sb"))
        both = both.withColumn("_shared", shared).where(F.col("_shared") / (F.size("sa") + F.size("sb") - F.col("_shared")) >= similarity)
        return durable(both.select("a", "b"))

    best = near.groupBy("a").agg(F.max_by("b", F.struct("tally", "b")).alias("b"))
    labels = postings.components(verified(best))
    for _ in range(ROUNDS - 1):
        of = lambda side, to: labels.select(F.col("id").alias(f"_{side}"), F.col("component").alias(to))  # noqa: B023, E731
        rows = near.join(of("a", "x"), F.col("a") == F.col("_a"), "left").join(of("b", "y"), F.col("b") == F.col("_b"), "left")
        rows = rows.select("a", "b", "tally", F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y")).where("x <> y")
        rows = rows.groupBy(F.least("x", "y"), F.greatest("x", "y")).agg(F.max_by(F.struct("a", "b"), F.struct("tally", "a", "b")).alias("p"))
        more = verified(rows.select("p.a", "p.b"))
        if more.isEmpty():
            break
        labels = postings.merge(labels, more)
    # whatever still shares a posting across components
    still = postings.mixed(durable(postings.labelled(met, labels)))
    open_nodes = durable(still.select("node").distinct())
    if not open_nodes.isEmpty():
        mapped = sets.join(open_nodes.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left_semi").mapInArrow(_bitmaps, "_n long, bitmap binary")
        sketches = nodes.select("node", "n", "words").join(mapped, F.col("node") == F.col("_n")).drop("_n")
        rest = durable(_blocks(still, sketches, similarity, least_tally, probe).distinct())
        if not rest.isEmpty():
            labels = postings.merge(labels, verified(rest))
    linked = durable(labels.join(nodes.select("node", "least"), F.col("id") == F.col("node")).select("node", "component", "least"))
    least = durable(linked.groupBy("component").agg(F.min("least").alias("component_id")))
    by_node = join_groups(linked, least, ["component"], F.col("node")).select(F.col("node").alias("_node"), "component_id")
    by_node = durable(nodes.join(by_node, F.col("node") == F.col("_node"), "left").select("node", F.coalesce("component_id", "least").alias("component_id")))
    return made.select("doc_id", "node").join(by_node, "node").select("doc_id", "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, size: int = SHINGLE) -> DataFrame:
    """The documents that are their component's least id; rows that repeat that id give one row."""
    return least_of_each(docs, near_duplicates(docs, doc_id, text, similarity, size), doc_id)
