import duckdb
import pytest

import corpus_pipeline
from talkledger.llm import queries

SF = "/root/testdata/sf0.001"


def test_every_operator_has_a_query():
    named = [q.split("_")[0] for q in queries.QUERIES if q.startswith("op")]
    assert sorted(named, key=lambda q: int(q[2:])) == [f"op{n}" for n in range(1, 14)]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    result = c.execute(queries.ORACLES[name])
    names = [d[0] for d in result.description]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted(repr(tuple(r)) for r in df.select(*names).collect()) == sorted(map(repr, result.fetchall()))


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, kept = docs, []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == docs.columns
            assert after.select("doc_id").exceptAll(before.select("doc_id")).count() == 0
        path = f"{tmp_path}/{len(kept)}"
        after.write.mode("overwrite").parquet(path)
        before = spark.read.parquet(path)
        kept.append(before.count())
    assert kept == sorted(kept, reverse=True) and kept[0] < docs.count() and kept[-1] > docs.count() // 2
    assert before.filter("not round_trip").count() == 0 and before.filter("n_tokens <> size(ids)").count() == 0
