import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, size int"


@pytest.fixture(scope="session")
def texts():
    """Odd and ordinary texts: nulls, empties, repeats, near copies, a very long one."""
    rng = random.Random(3)
    syllables = ["an", "er", "th", "on", "re", "ing", "é", "ou", "lich", "ñ"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base = prose(150)
    shared = "This passage stands in many documents. All rights reserved"
    out = [None, "", " ", "\n\n", "one", "one", "two words", "\x00", "▁ mark", "😀 中文 text", base, base, base + " end", base.replace(" ", "  "), "x" * 500]
    out += ["\n".join([prose(8), shared, prose(5), shared.upper() + "  ", prose(6)]) for _ in range(12)]
    out += [prose(rng.randint(1, 60)) for _ in range(15)]
    out += [" ".join([prose(40)] * 3), prose(9000)]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Documents with null ids, languages and sources, a repeated row, and columns that operators also make."""
    rows = [(i if i != 7 else None, t, [None, "a", "b"][i % 3], [None, "hot", "hot", "s1", "s2"][i % 5], None, "mine", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[10]], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
