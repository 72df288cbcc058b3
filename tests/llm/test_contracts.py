"""Every query on its contract's columns over the smallest tables, against plain Python, and operators against brute force."""

import hashlib
import math
import random
import zlib
from itertools import combinations, product

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F
from test_operators import WORD, collected, labelled, plain_components, plain_counts, plain_fingerprint

from mesograph.llm import audio, chat, languages, lines, mixing, pipeline, quality, queries, rules, similar, simhash, tokens, toxicity

DATA = "/root/testdata/sf0.001"
sha = lambda b: hashlib.sha256(b).hexdigest()
fold = lambda i, m: zlib.crc32(str(i).encode()) % m


@pytest.fixture(scope="module")
def table(spark):
    return {r["doc_id"]: r for r in collected(spark.read.parquet(f"{DATA}/documents.parquet"))}


def answers(spark, name):
    rows = collected(queries.QUERIES[name](spark, DATA))
    out = {r["doc_id"]: r for r in rows}
    assert len(out) == len(rows)
    return out


def test_op1(spark, table):
    got = answers(spark, "op1_simhash")
    prints = {i: plain_fingerprint(r["text"]) for i, r in table.items()}
    group, least = plain_components(prints.values(), 4), {}
    for i in sorted(prints):
        least.setdefault(group[prints[i]], i)
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {i: (f"{p:016x}", least[group[p]]) for i, p in prints.items()}


def test_op2(spark, table, monkeypatch):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=tokens.MODEL)
    monkeypatch.setattr(tokens, "GIANT", 4000)  # many texts go through chunks
    monkeypatch.setattr(tokens, "CHUNK", 700)
    got = answers(spark, "op2_tokens")
    for i, r in table.items():
        ids = np.array(library.encode(r["text"] or ""), dtype="<i4")
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(ids), sha(ids.tobytes()))
        assert got[i]["same_text"] and got[i]["decoded_sha256"] == sha((r["text"] or "").encode())


def test_op3(spark, table):
    got = answers(spark, "op3_audio")
    for i, r in table.items():
        raw = (r["text"] or "").encode()
        data = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        g = got[i]
        assert (g["n_bytes"], g["payload_bytes"], g["payload_sha256"], g["tail_crc32"]) == (len(raw), len(data), sha(data), zlib.crc32(data[-64:]))
        assert (g["media_bytes"], g["media_sha256"]) == (44 + len(data), sha(audio.wave(data)))


@pytest.mark.parametrize(("name", "modulus", "held"), [("op4_toxicity", 5, 0), ("op8_quality", 3, 1)])
def test_scores(spark, table, name, modulus, held):
    got = answers(spark, name)
    assert set(got) == set(table)
    for i, r in got.items():
        assert r["held_out"] == (fold(i, modulus) == held) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)


def test_op5(spark, table):
    got = answers(spark, "op5_languages")
    known = {r["lang"] for r in table.values() if r["lang"]}
    for i, r in got.items():
        assert r["held_out"] == (fold(i, 4) == 2) and 0 <= r["score"] <= 1
        assert r["lang_pred"] in known if any(map(str.isalpha, table[i]["text"] or "")) else r["lang_pred"] == "und"
    right = [got[i]["lang_pred"] == r["lang"] for i, r in table.items() if got[i]["held_out"] and r["lang"] and got[i]["lang_pred"] != "und"]
    assert np.mean(right) > 0.95


def test_op7(spark, table):
    got = answers(spark, "op7_rules")
    for i, r in table.items():
        n, *rest = plain_counts(r["text"])
        failed = n < 10 or 100 * rest[-1] > 20 * n
        g = got[i]
        assert [g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"]] == [n, *rest]
        assert g["base_failed"] == failed and not (failed and g["kept"]) and (failed or g["d2"] is not None)


# the operators against brute force


def test_resampling_spectrum_and_segments_by_definition():
    rng = np.random.default_rng(5)
    data = rng.integers(0, 256, 64 * 11, dtype=np.uint8).tobytes()
    x = np.frombuffer(data, dtype=np.uint8) / 128 - 1
    reach = audio.TAPS * audio.UP
    at = (np.arange(2 * reach) - (2 * reach - 1) / 2) / audio.UP
    cut = audio.UP / audio.DOWN
    h = cut * np.sinc(cut * at) * np.hamming(2 * reach)

    def resampled(o):
        total = weight = 0.0
        for j in range(-2 * audio.TAPS + o * audio.DOWN // audio.UP, o * audio.DOWN // audio.UP + 2 * audio.TAPS):
            t = o * audio.DOWN - j * audio.UP + reach
            if 0 <= t < 2 * reach:
                weight += h[t]
                total += h[t] * (x[j] if 0 <= j < len(x) else 0)
        return total / weight

    length = -(-len(x) * audio.UP // audio.DOWN)
    frames = 1 + max(0, -(-(length - audio.FRAME) // audio.HOP))
    y = np.array([resampled(o) for o in range((frames - 1) * audio.HOP + audio.FRAME)])
    assert np.allclose(audio.resample(x.astype(np.float32), 0, len(y)), y, atol=1e-5)
    got, n = audio.log_mel(data), np.arange(audio.FRAME)
    bands = audio.bands()
    assert got.shape == (frames, audio.MELS)
    for k in range(frames):
        part = y[k * audio.HOP : k * audio.HOP + audio.FRAME] * np.hanning(audio.FRAME)
        power = np.array([abs((part * np.exp(-2j * np.pi * f * n / audio.FFT)).sum()) ** 2 for f in range(audio.FFT // 2 + 1)])
        assert np.abs(got[k] - np.log(power @ bands + 1e-6)).max() <= 1 / 64 + 1e-3
    for _ in range(50):
        mel = rng.random((40, 2))
        energy, on, want, begin = mel.sum(axis=1), False, [], 0
        low, high = energy.min(), energy.max()
        for k, e in enumerate(energy):
            if not on and e >= low + audio.OPEN * (high - low):
                on, begin = True, k
            elif on and e < low + audio.CLOSE * (high - low):
                on = False
                want.append((begin, k))
        assert audio.segments(mel) == want + [(begin, len(mel))] * on


def test_machine_by_definition():
    rng = np.random.default_rng(1)
    machine = toxicity.Machine(0.3, np.array(sorted({b for w in ("alpha", "beta", "gammas") for b in toxicity.bins(w)})), rng.normal(size=9)[:0], np.zeros((0, 2)))
    n = len(machine.kept)
    machine.weight, machine.factors = rng.normal(size=n), rng.normal(size=(n, 4))
    at = {int(b): i for i, b in enumerate(machine.kept)}
    for text in ("", "alpha", "Alpha beta alpha", "gammas beta other alpha"):
        rows = [at[b] for b in toxicity.terms(text) if b in at]
        margin = 0.3 + sum(machine.weight[i] for i in rows) + sum(machine.factors[i] @ machine.factors[j] for i, j in combinations(rows, 2))
        assert math.isclose(machine.scorer()(text), 1 / (1 + math.exp(-margin)), rel_tol=1e-9)


def test_exclusive_or_is_learnt(spark):
    """Either word, but not both: no word tells anything alone, and no sum of weights can."""

    def make(rng):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = [rng.choice("lorem ipsum dolor sit amet".split()) for _ in range(20)] + ["insult"] * a + ["group"] * b
        rng.shuffle(words)
        return " ".join(words), int(a != b)

    some, labels, y = labelled(spark, make, "toxic")
    scored = collected(toxicity.scores(some, toxicity.fit(some, labels)))
    held = [r for r in scored if fold(r["doc_id"], 5) == 0]
    assert np.mean([(r["score"] >= 0.5) == y[r["doc_id"]] for r in held]) > 0.95
    # the best additive rule, over all signs of the two weights
    texts = {r["doc_id"]: r["text"].split() for r in collected(some)}
    rules_of = [np.mean([(p * ("insult" in texts[i]) + q * ("group" in texts[i]) + c > 0) == k for i, k in y.items()]) for p, q, c in product((-2, -1, 0, 1, 2), (-2, -1, 0, 1, 2), (-2.5, -1.5, -0.5, 0.5, 1.5, 2.5))]
    assert max(rules_of) < 0.8


def test_quality_by_definition(spark):
    def make(rng):
        good = rng.random() < 0.6
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.choice([5, 40, 400]))]
        return (" ".join(words) + ".", 1) if good else (" ".join(w.upper() + "!!" for w in words), 0)

    some, labels, _ = labelled(spark, make, "quality", 200)
    model = quality.fit(some, labels)
    assert set(model.contents) == {"text", "shape"} and all(len(a) == len(b) > 0 for a, b in model.contents.values())
    got = {r["doc_id"]: r["score"] for r in collected(quality.scores(some, model))}

    def size(data, content, block):
        tool = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
        return sum(len(tool.compress(data[i : i + block])) for i in range(0, len(data), block))

    for r in collected(some)[:40]:
        margin = model.weights[-1]
        for slope, (view, (bad, good)) in zip(model.weights, model.contents.items(), strict=False):
            data, block = quality.views(r["text"])[view], quality.VIEWS[view][2]
            a, b = size(data, bad, block), size(data, good, block)
            margin += slope * (a - b) / (max(a, b) + quality.PRIOR)
        assert abs(got[r["doc_id"]] - 1 / (1 + math.exp(-max(-50, min(50, margin))))) < 0.02


def test_least_determinant_of_all_subsets(spark):
    """A small group with outliers, against every subset of three quarters of it."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 0.3, (9, 5)), rng.normal(4, 0.3, (3, 5))])
    rows = [(i, "a", "s", *map(float, v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, " + ", ".join(f"{d} double" for d in rules.DIMS))
    found, _ = rules.estimates(rules.at_levels(df))
    got = {r["level"]: r["log_det"] for r in rules.whitened(found).collect()}
    widen = rules.SHARE / rules.chi_square(rules.chi_quantile(rules.SHARE, 5), 7)
    best = min(np.linalg.slogdet(widen * np.cov(x[list(s)].T, bias=True))[1] for s in combinations(range(12), 9))
    assert set(got) == {0, 1, 2} and all(abs(d - best) < 1.0 for d in got.values())


def test_switches_are_learnt(spark):
    """Texts bear one label each; still a text of several languages is cut where they change."""
    rng = random.Random(6)
    words = {"a": ["then", "other", "this", "with", "which"], "b": ["nicht", "schon", "über", "lich", "zwar"], "c": ["donc", "chez", "leur", "sous", "mais"]}
    rows = [(i, " ".join(rng.choice(words[k]) + rng.choice(["", "er", "s"]) for _ in range(60)), k) for i, k in enumerate("abc" * 60)]
    field = languages.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert not np.allclose(field.steps, np.log(np.where(np.eye(3, dtype=bool), languages.STAY, (1 - languages.STAY) / 2)), atol=1e-3)
    right = total = 0
    for _ in range(30):
        gold = [k for _ in range(rng.randint(3, 6)) for k in [rng.choice("abc")] * rng.randint(3, 9)]
        text = " ".join(rng.choice(words[k]) + rng.choice(["", "er", "s"]) for k in gold)
        found = [k for begin, end, k, _ in languages.label_words(field, text) for _ in text[begin:end].split()]
        right, total = right + sum(a == b for a, b in zip(found, gold, strict=True)), total + len(gold)
    assert right / total > 0.97
    # marginals with the learnt steps, over all paths
    some = ["then", "schon", "chez", "leur", "with"]
    e = field.emissions(some).astype(float)
    p, s = np.exp(e - e.max(axis=1, keepdims=True)), np.exp(field.steps)
    want = np.zeros_like(p)
    for path in product(range(3), repeat=5):
        w = s[:, path[0]].sum() * p[0, path[0]] * math.prod(s[path[t - 1], path[t]] * p[t, path[t]] for t in range(1, 5))
        want[range(5), path] += w
    assert np.allclose(languages.marginals(p, np.array([5]), s), want / want.sum(axis=1, keepdims=True))


# names, other models, and empty tables

NAMES = "_keep _mix_rate _g_source _g_salt _salt rate copy _id _r _row _other _text _doc _kept doc text_hash row n_lines n_dropped bitmap ids decoded n tally _capped node component".split()


@pytest.fixture(scope="module")
def named(spark):
    rows = [(i, t, "a", s, len(t), *(f"{n}{i}" for n in NAMES)) for i, (t, s) in enumerate([("one two three four\nthis line is in both", "x"), ("other words stand here\nthis line is in both", "y"), ("", None), ("one two three four\nthis line is in both", "y")])]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES))


def test_callers_names(named, nothing):
    model = quality.Model({}, np.array([3.0]))
    made = {
        "mix": mixing.mix(named),
        "lines": lines.dedup_lines(named),
        "simhash": simhash.one_of_each(named),
        "similar": similar.one_of_each(named),
        "encode": tokens.encode(named, giant=10),
        "decode": tokens.decode(tokens.encode(named), ids="ids_"),
        "good": quality.keep_good(named, model),
    }
    for name, df in made.items():
        assert df.columns[: len(named.columns)] == named.columns, name
        rows = collected(df)
        assert rows and all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in NAMES), name
    assert {r["doc_id"]: r["n_lines_"] for r in collected(made["lines"])} == {0: 2, 1: 2, 2: 1, 3: 2}
    assert all(r["decoded_"] == r["text"] for r in collected(made["decode"]))
    assert sorted(r["doc_id"] for r in collected(made["simhash"])) == [0, 1, 2]


@pytest.mark.parametrize("k", range(5))
def test_stages_of_nothing(spark, k, table):
    empty = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    out = pipeline.STAGES[k][1](spark, empty, DATA)
    assert out.count() == 0 and (k == 4 or out.columns == empty.columns)


def test_other_models_are_refused():
    model = open(tokens.MODEL, "rb").read()
    assert tokens.settings(model) == tokens.FOLLOWED
    with pytest.raises(ValueError, match="kind"):
        tokens.Vocabulary(model + b"\x12\x02\x18\x01")  # a trainer specification that says unigram


def test_template_with_many_heads():
    with pytest.raises(ValueError, match="nine"):
        chat.Template(markers={str(k): f"{c}#" for k, c in enumerate("abcdefghij")})
