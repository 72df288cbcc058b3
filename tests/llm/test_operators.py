"""Each operator on odd rows, against brute force or a round trip."""

import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from mesograph.llm import audio, chat, languages, lines, mixing, quality, rules, simhash, tokens, toxicity

WORD = re.compile("[^\x20\x09-\x0d]+")


def collected(df):
    return [r.asDict() for r in df.collect()]


# 1: SimHash


def plain_fingerprint(text):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values, bits):
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    some = sorted(parent)
    for i, a in enumerate(some):
        for b in some[i + 1 :]:
            if (a ^ b).bit_count() <= bits:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {v: find(v) for v in some}


def test_simhash(docs, nothing):
    rows = collected(docs.select("doc_id", "text"))
    got = collected(simhash.near_duplicates(docs))
    group = plain_components({plain_fingerprint(r["text"]) for r in rows}, 4)
    least = {}
    for r in rows:
        g = group[plain_fingerprint(r["text"])]
        if r["doc_id"] is not None:
            least[g] = min(least.get(g, 1 << 60), r["doc_id"])
    want = Counter((r["doc_id"], f"{plain_fingerprint(r['text']):016x}", least.get(group[plain_fingerprint(r["text"])])) for r in rows)
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == want
    assert simhash.near_duplicates(nothing).count() == 0
    one = collected(simhash.one_of_each(docs))
    assert sorted(r["doc_id"] for r in one if r["doc_id"] is not None) == sorted(set(least.values()))
    assert set(one[0]) == set(docs.columns)


@pytest.mark.parametrize("probe", [1, 3, 4])
def test_fingerprint_components(spark, probe):
    """Dense groups, chains and strangers; the brute force compares all pairs."""
    rng = random.Random(probe)
    values = {0, (1 << 64) - 1}
    for _ in range(6):
        v = rng.getrandbits(64)
        for _ in range(25):
            values.add(v)
            v ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6)))
    center = rng.getrandbits(64)
    values |= {center ^ (1 << a) ^ (1 << b) for a, b in product(range(0, 64, 5), repeat=2)}
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    got = {r["fp"] % (1 << 64): r["label"] for r in simhash.components(df, 4, probe).collect()}
    want = plain_components(values, 4)
    by = defaultdict(set)
    for v in values:
        by[want[v]].add(got.get(v, f"alone {v}"))
    assert all(len(x) == 1 for x in by.values())
    assert len({next(iter(x)) for x in by.values()}) == len(by)


# 2: SentencePiece


@pytest.fixture(scope="module")
def vocabulary():
    return tokens.Vocabulary(open(tokens.MODEL, "rb").read())


def test_encoding_is_the_librarys(docs, nothing, vocabulary, monkeypatch):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=tokens.MODEL)
    monkeypatch.setattr(tokens, "CHUNK", 97)
    monkeypatch.setattr(tokens, "FAN", 3)  # several levels
    back = collected(tokens.decode(tokens.encode(docs, giant=100)))
    assert len(back) == docs.count()
    for r in back:
        text = r["text"] or ""
        assert list(r["ids"]) == library.encode(text)
        assert r["decoded"] == text.replace(tokens.SPACE, " ")
    assert tokens.encode(nothing).count() == 0


def test_chunks_meet_the_whole(vocabulary):
    rng = random.Random(4)
    parts = ["a", "er", " ", "th", "in", "é", "中", "1", ".", "the", "aaaa", "ation", "  ", "international", "--------"]
    v = vocabulary
    for _ in range(150):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 40)))
        size = rng.choice([1, 2, 3, 7, 20])
        whole = tokens.SPACE + text.replace(" ", tokens.SPACE)
        cuts = [(k, min(len(whole), k + size)) for k in range(0, len(whole), size)]
        matrices = [tokens.transfer(v, whole, a, b) for a, b in cuts]
        states = tokens.choose(matrices)
        found = b""
        for k, (a, b) in enumerate(cuts):
            begin = tokens.edge_states(v, whole, a)[states[k]]
            found += tokens.trace(v, whole, a, b, begin, tokens.edge_states(v, whole, b)[states[k + 1]])
        assert found == v.encode(text)
        # a tree's products and the states it hands down give the same
        half = len(matrices) // 2
        if half:
            ends = tokens.choose([tokens.product(matrices[:half]), tokens.product(matrices[half:])])
            assert tokens.choose(matrices[:half], ends[0], ends[1])[:-1] + tokens.choose(matrices[half:], ends[1], ends[2]) == states
        # combining is associative
        if len(matrices) > 2:
            a, b, c = matrices[:3]
            assert np.array_equal(tokens.combine(tokens.combine(a, b), c), tokens.combine(a, tokens.combine(b, c)))


# 3: audio


def test_audio(docs, nothing):
    for r in collected(audio.features(docs)):
        data = audio.samples(bytes(r["media"]))
        assert len(data) % 64 == 0 and len(data) >= 64
        batch = audio.loaded(bytes(r["tensors"]))
        mel = batch.column("log_mel").to_numpy_ndarray()
        assert mel.shape[1:] == (audio.FRAMES, audio.MELS) and mel.shape[0] == -(-r["n_frames"] // audio.FRAMES)
        assert np.array_equal(mel.reshape(-1, audio.MELS)[: r["n_frames"]], audio.log_mel(data))
        assert all(0 <= s["begin_s"] < s["end_s"] for s in r["segments"])
    assert audio.features(nothing).count() == 0
    assert len(audio.payload(b"")) == 64 and audio.payload(b"x" * 64) == b"x" * 64 and len(audio.payload(b"x" * 65)) == 128


def test_resampling_and_segments():
    t = np.arange(16000) / 16000
    out = audio.resample(np.sin(2 * np.pi * 440 * t).astype(np.float32), 0, 10000)
    assert np.abs(np.fft.rfft(out)).argmax() == 440
    assert np.array_equal(np.concatenate([audio.resample(out, 0, 55), audio.resample(out, 55, 300)]), audio.resample(out, 0, 300))
    loud = np.repeat(np.array([0, 0, 1, 0.5, 0.5, 0, 0.5, 1], dtype=np.float32), 1)[:, None]
    assert audio.segments(loud) == [(2, 5), (7, 8)]
    assert audio.segments(loud * 0) == []
    assert audio.log_mel(b"\x80" * 100000).std() == 0


# 4 and 8: classifiers


def labelled(spark, make, label, n=900):
    rng = random.Random(9)
    rows = [(i, *make(rng)) for i in range(n)]
    other = "quality" if label == "toxic" else "toxic"
    docs = spark.createDataFrame([(i, t, None) for i, t, _ in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows] + [(None, 1, 0), (1 << 40, None, None)], f"doc_id long, {label} int, {other} int")
    return docs, labels, {i: y for i, _, y in rows}


def test_toxicity_learns_pairs(spark, docs, nothing):
    """Neither word tells alone; both together do."""

    def make(rng):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = [rng.choice("lorem ipsum dolor sit amet".split()) for _ in range(20)] + ["insult"] * a + ["group"] * b
        rng.shuffle(words)
        return " ".join(words), int(a and b)

    some, labels, y = labelled(spark, make, "toxic")
    machine = toxicity.fit(some, labels)
    held = [r for r in collected(toxicity.scores(some, machine)) if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(held) > 100 and np.mean([(r["score"] >= 0.5) == y[r["doc_id"]] for r in held]) > 0.97
    odd = collected(toxicity.scores(docs, machine))
    assert len(odd) == docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert toxicity.scores(nothing, machine).count() == 0
    none = toxicity.fit(nothing, labels.limit(0))
    assert all(r["score"] < 0.5 for r in collected(toxicity.scores(docs, none)))


def test_quality(spark, docs, nothing):
    def make(rng):
        good = rng.random() < 0.7
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(40)]
        return (" ".join(words) + ".", 1) if good else (" ".join(w.upper() + "!!" for w in words), 0)

    some, labels, y = labelled(spark, make, "quality", 300)
    model = quality.fit(some, labels)
    held = [r for r in collected(quality.scores(some, model)) if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert len(held) > 50 and np.mean([(r["score"] >= 0.5) == y[r["doc_id"]] for r in held]) > 0.97
    assert len(collected(quality.scores(docs, model))) == docs.count()
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()
    assert quality.scores(nothing, model).count() == 0
    assert collected(quality.scores(docs, quality.fit(nothing, labels.limit(0))))[0]["score"] == 0.5
    assert quality.shape("The the The The, A1 USA") == b"A a A A, A1 U".replace(b"A1", quality.shape("A1"))


# 5: languages


def test_language_field():
    rng = np.random.default_rng(0)
    p, s = rng.random((5, 3)), rng.random((3, 3))

    def plain(p):
        out = np.zeros_like(p)
        for path in product(range(3), repeat=len(p)):
            w = s[:, path[0]].sum() * p[0, path[0]]
            for t in range(1, len(p)):
                w *= s[path[t - 1], path[t]] * p[t, path[t]]
            out[range(len(p)), path] += w
        return out / out.sum(axis=1, keepdims=True)

    got = languages.marginals(p, np.array([2, 3]), s)
    assert np.allclose(got, np.concatenate([plain(p[:2]), plain(p[2:])]))


def test_languages(spark, docs, nothing):
    rng = random.Random(2)
    words = {"a": ["then", "other", "this", "with"], "b": ["nicht", "schon", "über", "lich"]}
    rows = [(i, " ".join(rng.choice(words[k]) + rng.choice(["", "er", "s"]) for _ in range(15)), k) for i, k in enumerate("ab" * 150)]
    some = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    field = languages.fit(some)
    got = {r["doc_id"]: r for r in collected(languages.predict(some, field))}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert len(held) > 30 and all(got[i]["lang_pred"] == k for i, _, k in held)
    switched = languages.label_words(field, "then this with other nicht schon über lich")
    assert [x[2] for x in switched] == ["a", "b"] and switched[0][1] <= 20
    odd = collected(languages.predict(docs, field))
    assert len(odd) == docs.count()
    by = {r["doc_id"]: r["lang_pred"] for r in odd}
    assert by[0] == by[1] == by[3] == "und" and languages.words("²") and by[9] in ("a", "b")
    assert languages.predict(nothing, field).count() == 0
    assert {r["lang_pred"] for r in collected(languages.predict(docs, languages.fit(nothing)))} == {"und"}


def test_long_texts_in_chunks(monkeypatch):
    field = languages.train([["then", "with"] * 20, ["nicht", "schon"] * 20], [[0] * 40, [1] * 40], ["a", "b"])
    index = languages._Index(field)
    idx = np.array([index[w] for w in ["then", "nicht", "schon", "with"] * 100])
    rows = index.settle()
    e = rows[idx].astype(float)
    whole = languages.marginals(np.exp(e - e.max(axis=1, keepdims=True)), np.array([len(idx)]), np.exp(field.steps)).mean(axis=0)
    monkeypatch.setattr(languages, "CHUNK", 37)
    assert np.allclose(languages.shares(field, rows, idx), whole)


# 6: chats


def test_chat_round_trip(spark):
    template = chat.Template()
    controls = ["</s>", "[INST]", "[/INST]", "<<SYS>>", "[ROLE]", "[/ROLE]", "\\", "\\0", "\\1", "[", "<", "x", "\n", "é😀"]
    rng = random.Random(1)
    roles = ["system", "user", "assistant", "tool", "[ROLE]\\", None]
    rows = [(c, t, rng.choice(roles), None if rng.random() < 0.1 else "".join(rng.choice(controls) for _ in range(rng.randint(0, 9)))) for c in range(40) for t in range(rng.randint(1, 7))]
    rows += [(None, 0, "user", "a"), (None, None, "assistant", "b"), rows[0]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_chats(df, template).withColumn("back", chat.read_back(F.col("formatted"), template)).collect()
    want = defaultdict(list)
    for c, t, role, text in rows:
        want[c].append((-1 if t is None else t, role or "", text or ""))
    assert len(out) == len(want)
    for r in out:
        assert [(x["role"], x["text"]) for x in r["back"]] == [x[1:] for x in sorted(want[r["conv_id"]])]
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
        assert sum(s["loss"] for s in r["segments"]) == sum(x[1] == "assistant" for x in want[r["conv_id"]])
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chat_machine(spark):
    def bad(*roles):
        df = spark.createDataFrame([(1, i, r, "t") for i, r in enumerate(roles)], "conv_id long, turn long, role string, text string")
        return chat.format_chats(df).first().bad_turn

    assert bad("system", "user", "assistant", "user", "assistant") == -1
    assert bad("user", "user") == 1
    assert bad("assistant") == 0
    assert bad("user", "assistant", "tool", "assistant") == 2
    assert bad("user", "assistant", "user") == 3
    with pytest.raises(ValueError):
        chat.Template(end="[INST]")


# 7: rules


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count, marked = Counter(windows), [False] * len(words)
    for i, w in enumerate(windows):
        if count[w] > 1:
            marked[i : i + 5] = [True] * 5
    with_word = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(with_word) - len(set(with_word)), sum(marked)


def test_rules(docs, nothing):
    rows = Counter((r["doc_id"], r["text"]) for r in collected(docs.select("doc_id", "text")))
    want = Counter()
    for (i, t), n in rows.items():
        want[(i, *plain_counts(t))] += n
    got = collected(rules.judge(docs))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert Counter(tuple(r[k] for k in names) for r in got) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert rules.judge(nothing).count() == 0


def test_outliers(spark):
    rng = random.Random(5)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n))
    good = [prose(rng.randint(20, 200)) for _ in range(300)]
    bad = [" ".join(w + "***" for w in prose(50).split()) for _ in range(20)] + [prose(60).upper() for _ in range(20)]
    rows = [(i, t, "a", None) for i, t in enumerate(good + bad)] + [(1000 + i, t, "small", "group") for i, t in enumerate(bad[:3])]
    got = {r["doc_id"]: r["kept"] for r in collected(rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")))}
    assert all(got[i] for i in range(300)) and not any(got[i] for i in range(300, 340)) and not any(got[1000 + i] for i in range(3))
    assert abs(rules.chi_square(rules.chi_quantile(0.95, 5), 5) - 0.95) < 1e-9 and abs(rules.chi_quantile(0.95, 5) - 11.0705) < 1e-3


# 9: lines


def test_lines(docs, nothing):
    rows = collected(docs.select("doc_id", "text"))
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    order = lambda i: (1 << 63) - 1 if i is None else i
    held = defaultdict(set)
    for r in rows:
        for x in (r["text"] or "").split("\n"):
            held[key(x)].add(order(r["doc_id"]))
    want = Counter()
    for r in rows:
        parts = (r["text"] or "").split("\n")
        kept = [x for x in parts if len(key(x)) < 10 or min(held[key(x)]) == order(r["doc_id"])]
        want[(r["doc_id"], len(parts), len(parts) - len(kept), "\n".join(kept))] += 1
    got = lines.dedup_lines(docs)
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in collected(got)) == want
    assert sum(r[2] for r in want) > 20
    assert set(docs.columns) <= set(got.columns)
    assert lines.dedup_lines(nothing).count() == 0
    assert lines.unpack(lines.pack(11, [2, 10]), 11).tolist() == [i not in (2, 10) for i in range(11)]


def test_losers_do_not_depend_on_slices(docs, monkeypatch):
    whole = sorted(map(repr, collected(lines.dedup_lines(docs).select("doc_id", "text"))))
    monkeypatch.setattr(lines, "SLICE", 1)
    assert sorted(map(repr, collected(lines.dedup_lines(docs).select("doc_id", "text")))) == whole


# 10: mixing


def plain_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, target, free = sum(sizes.values()), {}, set(names)
    while free:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > cap * sizes[s]}
        if not over:
            return target | share
        target |= {s: cap * sizes[s] for s in over}
        free -= over
    return target


def test_mixing(docs, nothing):
    rows = collected(mixing.taken(docs))
    size = Counter()
    for r in collected(docs.select("source", "text")):
        size[r["source"]] += len(WORD.findall(r["text"] or ""))
    target = plain_targets(size)
    assert len(rows) == docs.count()
    assert Counter((r["source_size"], round(r["target"], 6)) for r in rows).keys() == {(size[s], round(float(target[s]), 6)) for s in size}
    assert all(r["taken"] == r["size"] * r["copies"] and 0 <= r["copies"] <= 3 for r in rows)
    again = collected(mixing.taken(docs))
    assert sorted(map(repr, rows)) == sorted(map(repr, again))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in rows)
    assert mixing.taken(nothing).count() == 0 and mixing.mix(nothing).count() == 0


def test_taken_words_come_near_targets(spark):
    """Within five standard deviations of independent draws."""
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.randint(1, 40)), "abcdef"[min(rng.randrange(9), 5)]) for i in range(4000)]
    got = collected(mixing.taken(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    by = defaultdict(list)
    for r in got:
        by[r["source_size"]].append(r)
    for some in by.values():
        target, rate = some[0]["target"], some[0]["target"] / some[0]["source_size"]
        spread = (rate % 1 * (1 - rate % 1) * sum(r["size"] ** 2 for r in some)) ** 0.5
        assert abs(sum(r["taken"] for r in some) - target) <= 5 * spread + 1e-6 and spread < 0.1 * target


def test_extra_copy_has_the_fractions_probability(spark):
    """Over ids and, for one document alone, over seeds; whatever else its source holds."""
    often = spark.range(20000).agg(*(F.avg(mixing.copies(F.col("id"), F.lit(r), "s")).alias(f"r{k}") for k, r in enumerate((0.3, 1.3, 2.95, 2.0, 0.0)))).first()
    assert all(abs(x - r) < 0.015 for x, r in zip(often, (0.3, 1.3, 2.95, 2.0, 0.0), strict=True)) and often[3:] == (2.0, 0.0)
    draws = spark.range(1).select(F.array(*(mixing.draw(F.lit(7), str(k)) for k in range(300))).alias("d")).first().d
    assert abs(np.mean(np.array(draws) < 0.3) - 0.3) < 0.1
    # a large document among small ones draws as it would alone
    sizes = {1: 4000} | {i: 5 for i in range(2, 22)}
    table = lambda ids: spark.createDataFrame([(i, "w " * sizes[i], s) for i in ids for s in "a"] + [(100, "w " * 9000, "b")], "doc_id long, text string, source string")
    for seed in ("x", "y", "z"):
        rows = {r["doc_id"]: r for r in collected(mixing.taken(table(sizes), seed=seed))}
        rate = rows[1]["target"] / rows[1]["source_size"]
        want = spark.range(1).select(mixing.copies(F.lit(1), F.lit(rate), seed)).first()[0]
        assert rows[1]["copies"] == want


def test_salted_join(docs, monkeypatch):
    """Beyond the bound of a broadcast the groups are salted; the result is the same."""
    plain = sorted(map(repr, collected(mixing.taken(docs))))
    monkeypatch.setattr("mesograph.llm.common.BROADCAST_ROWS", 0)
    assert sorted(map(repr, collected(mixing.taken(docs)))) == plain

