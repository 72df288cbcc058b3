"""Groups too small for an estimate of their own are judged by their language's, then by all documents'."""

import random

from mesograph.llm import rules


def test_junk_in_small_groups_goes(spark):
    rng = random.Random(5)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n))
    junk = lambda: " ".join(w + "***" for w in prose(50).split())
    rows = [(i, prose(rng.randint(20, 200)), "a", "big") for i in range(200)]
    rows += [(1000, junk(), "a", "few"), (1001, prose(60), "a", "few"), (1002, prose(90), "a", "few")]
    rows += [(2000, junk(), "rare", "few"), (2001, prose(60), "rare", "few"), (2002, junk(), None, None)]
    got = {r["doc_id"]: r for r in rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert len(got) == len(rows) and all(r["d2"] is not None for r in got.values())
    assert not any(got[i]["kept"] for i in (1000, 2000, 2002)) and all(got[i]["kept"] for i in (*range(200), 1001, 1002, 2001))
