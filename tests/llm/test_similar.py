"""The pipeline's near duplicates: every pair of similarity 0.8, against all pairs by brute force."""

import random

import numpy as np
import pytest

from mesograph.llm import pipeline, simhash, similar


def plain_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def plain_least(rows):
    group = {i: i for i, _ in rows}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for k, (i, s) in enumerate(rows):
        for j, t in rows[k + 1 :]:
            if s == t or (s & t and len(s & t) / len(s | t) >= 0.8):
                a, b = find(i), find(j)
                group[max(a, b)] = min(a, b)
    return {i: find(i) for i in group}


@pytest.fixture(scope="module")
def near(spark):
    """Texts with copies of similarity 0.7 to 0.95, a passage that all hold, and short texts."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = [word() for _ in range(15)]
    texts = ["", None, "one two", "One  two", "a b c d e", "a b c d e f"]
    for _ in range(25):
        base = [word() for _ in range(rng.randint(60, 120))] + passage
        texts.append(" ".join(base))
        for _ in range(3):
            copy = list(base)
            for _ in range(rng.randint(1, 4)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    return spark.createDataFrame([(i, t, "a", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def test_every_similar_pair(near, docs, nothing, monkeypatch):
    want = plain_least([(r.doc_id, plain_set(r.text)) for r in near.collect()])
    got = {r.doc_id: r.component_id for r in similar.near_duplicates(near).collect()}
    assert got == want and 30 < len(set(want.values())) < len(want)
    monkeypatch.setattr(similar, "ROUNDS", 1)  # contraction changes nothing, nor do small blocks
    monkeypatch.setattr(similar, "NODES", 3)
    assert {r.doc_id: r.component_id for r in similar.near_duplicates(near).collect()} == want
    assert similar.near_duplicates(docs).count() == docs.count() and similar.near_duplicates(nothing).count() == 0


def test_stage_takes_what_fingerprints_leave(spark, near):
    want = set(plain_least([(r.doc_id, plain_set(r.text)) for r in near.collect()]).values())
    kept = pipeline.near_dedup(spark, near, "")
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == near.columns
    assert {r.doc_id for r in simhash.one_of_each(near).collect()} - want  # four bits leave more


def test_bounds_lose_nothing():
    """The bitmaps' bound is never under the overlap, whatever their sizes."""
    rng = np.random.default_rng(2)
    sets = []
    for n in (1, 3, 40, 300, 2000):
        base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        for k in range(6):
            sets.append(np.unique(np.concatenate([base[: n - n * k // 40], rng.integers(0, 1 << 63, n * k // 40, dtype=np.uint64)])))
    maps, n = [np.frombuffer(similar.bitmap(s), dtype=np.uint64) for s in sets], np.array([len(s) for s in sets])
    a, b = map(np.array, zip(*[(i, j) for i in range(len(sets)) for j in range(len(sets)) if i != j], strict=True))
    share = np.array([len(x := np.intersect1d(sets[i], sets[j])) / (len(sets[i]) + len(sets[j]) - len(x)) for i, j in zip(a, b, strict=True)])
    allowed = similar._allowed(maps, n, a, b, 0.8)
    assert allowed[share >= 0.8].all() and not allowed[share < 0.6].any() and (share >= 0.8).sum() > 20


def test_index_is_of_simhash_bits():
    """Each bit is the majority of the shingles' bits, so bits differ by the angle between two sets, and never by chance in few."""
    turn, stretch = similar._orders(20)
    rng = np.random.default_rng(5)
    sets = [rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (1, 4, 300, 600)]
    for s in sets:
        votes = sum(similar.signature(s[k : k + 1], turn, stretch).astype(int) for k in range(len(s)))
        assert (similar.signature(s, turn, stretch) == (2 * votes > len(s))).all()
    a, b = (similar.signature(x, *similar._orders(1000)) for x in (sets[3][:500], sets[3][50:]))  # 450 of 600 common
    assert abs((a != b).mean() - np.arccos(450 / np.sqrt(500 * 550)) / np.pi) < 0.01
    assert similar.differing(0.8)[2] == 0.1875  # four shingles and a fifth: a tie that one vote decides


def test_only_chance_meetings_go():
    """Whatever the batches: a row with another near it in its posting stays, in the order of the keys."""
    import pyarrow as pa

    rng = np.random.default_rng(6)
    key = np.sort(rng.integers(0, 300, 4000) << 16)
    key[1000:1900] = key[1000]  # a posting over the limit
    key = np.sort(key)
    bits, n = rng.integers(0, 1 << 63, (4000, 3), dtype=np.int64), np.full(4000, 100, dtype=np.int32)
    for k in range(0, 4000, 40):
        if key[k] == key[k + 1]:
            bits[k + 1], n[k + 1] = bits[k] ^ 0b1011, 80 if k % 80 else 79
    whole = pa.RecordBatch.from_arrays([pa.array(x) for x in (key, np.arange(4000), n, *(x.copy() for x in bits.T))], names=["key", "node", "n", *similar.BITS])
    near = {x for k in range(40, 4000, 80) if key[k] == key[k + 1] for x in (k, k + 1)}
    large = {k for k in range(4000) if (key == key[k]).sum() > similar.LIMIT} | set(np.flatnonzero((key == key[0]) | (key == key[-1])))
    for size in (7, 500, 4000):
        got = [n for b in similar._without_chance([whole.slice(k, size) for k in range(0, 4000, size)], 0.8, (20, 20), 100) for n in b.column("node").to_pylist()]
        assert got == sorted(got) and set(got) == near | large and len(near | large) < 2000


def test_only_sets_without_any_like_them_go(spark):
    """A set goes exactly if more than a fifth of its shingles stand in no other set, so no pair at the limit is lost."""
    rows = [(0, list(range(100))), (1, list(range(80)) + list(range(1000, 1020))), (2, list(range(79)) + list(range(2000, 2021))), (3, [*range(8), 3000, 3001]), (4, [5000]), (5, [])]
    sets = spark.createDataFrame(rows, "node long, found array<long>").repartition(3)
    assert {r.node for r in similar._single(sets, 0.8).collect()} == {2, 4}
    assert {r.node for r in similar._single(sets, 1.0).collect()} == {0, 1, 2, 3, 4}
