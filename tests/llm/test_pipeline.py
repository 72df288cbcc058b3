"""The pipeline stage by stage against plain Python, and the queries that SQL can express against DuckDB."""

from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F
from test_operators import WORD, collected, plain_targets
from test_similar import plain_least, plain_set

from mesograph.llm import pipeline, quality, queries, tokens

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    connection = duckdb.connect()
    for p in Path(DATA).iterdir():
        connection.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = queries.QUERIES[name](spark, DATA)
    names = sorted(got.columns)
    found = connection.sql(queries.ORACLE_SQL[name])
    assert sorted(found.columns) == names
    order = [found.columns.index(n) for n in names]
    assert Counter(tuple(r[n] for n in names) for r in got.collect()) == Counter(tuple(r[i] for i in order) for r in found.fetchall())


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    before, seen = docs, {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, before, DATA)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        seen[name] = (collected(before), collected(out := spark.read.parquet(str(tmp_path / name))))
        before = out

    rows, kept = seen["quality_classifier"]
    good = {r["doc_id"] for r in collected(quality.scores(docs, quality.fit(docs, labels))) if r["score"] >= 0.5}
    assert {r["doc_id"] for r in kept} == good and 0 < len(kept) < len(rows)

    rows, kept = seen["line_dedup"]
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    held = defaultdict(set)
    for r in rows:
        for x in r["text"].split("\n"):
            held[key(x)].add(r["doc_id"])
    want = {r["doc_id"]: "\n".join(x for x in r["text"].split("\n") if len(key(x)) < 10 or min(held[key(x)]) == r["doc_id"]) for r in rows}
    assert {r["doc_id"]: r["text"] for r in kept} == want and all(r["n_chars"] == len(r["text"]) for r in kept)

    rows, kept = seen["simhash_near_dedup"]
    assert sorted(r["doc_id"] for r in kept) == sorted(set(plain_least([(r["doc_id"], plain_set(r["text"])) for r in rows]).values()))

    rows, kept = seen["mixing"]
    size = Counter()
    for r in rows:
        size[r["source"]] += len(WORD.findall(r["text"]))
    target, times = plain_targets(size), Counter(r["doc_id"] for r in kept)
    for r in rows:
        rate = target[r["source"]] / size[r["source"]] if size[r["source"]] else 0
        assert int(rate + 1e-9) <= times[r["doc_id"]] <= int(rate + 1e-9) + 1

    rows, kept = seen["sentencepiece"]
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=tokens.MODEL)
    want = Counter((r["doc_id"], tuple(library.encode(r["text"]))) for r in rows)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in kept) == want


def test_run(spark):
    import corpus_pipeline

    out = pipeline.run(spark, DATA)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "simhash_near_dedup", "mixing", "sentencepiece"]
    assert out.count() > 0 and out.where(F.size("ids") != F.col("n_tokens")).count() == 0
