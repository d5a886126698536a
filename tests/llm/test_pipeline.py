"""The pipeline against its stages' plain models."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tallyline.llm import registry


def test_queries_are_registered():
    found = __spark_entry__.queries()
    assert {int(n[2:].split("_")[0]) for n in found if n.startswith("op") and n[2].isdigit()} == set(range(1, 11)) and "pipeline" in found


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns, name
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] > counts[3] and counts[4] == counts[5]
    step = lambda i: spark.read.parquet(str(tmp_path / str(i)))
    toxic = {r.doc_id for r in registry.op2_toxicity(spark, sf).filter("predicted = 1").collect()}
    assert {r.doc_id for r in step(0).collect()} == {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").collect()} - toxic
    assert step(1).select("text").distinct().count() == step(1).count()
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert not any(i in r.text for r in step(2).collect() for i in items)
    whole = corpus_pipeline.run(spark, sf).select("doc_id", "shard", "slot").collect()
    assert sorted(whole) == sorted(step(4).select("doc_id", "shard", "slot").collect())


def test_awkward_tables(spark, sf, tmp_path):
    """Extra columns of clashing names go through; nulls, empty texts and repeated rows don't break a stage; empty tables give no rows."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    null = docs.limit(1).selectExpr("cast(null as bigint) doc_id", "cast(null as string) text", "lang", "cast(null as string) source", "n_chars")
    odd = docs.unionByName(null).unionByName(null).unionByName(docs.limit(3)).withColumns({"shard": F.lit("mine"), "hash": F.lit(1), "score": F.lit("x"), "key": F.lit("k")})
    for name, rows in (("odd", odd), ("empty", docs.limit(0))):
        rows.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        for table in ("labels", "benchmark"):
            spark.read.parquet(f"{sf}/{table}.parquet").limit(0 if name == "empty" else 10**6).write.parquet(f"{tmp_path}/{name}/{table}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").collect() == []
    out = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    plain = corpus_pipeline.run(spark, sf).select("doc_id").distinct().count()
    assert all((r.shard_input, r.hash, r.score, r.key) == ("mine", 1, "x", "k") for r in out)
    assert len({r.doc_id for r in out}) == plain  # rows without an id have no words here, so the mix takes none of them


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for table in ("pages", "documents", "embeddings"):
        con.sql(f"create view {table} as select * from '{sf}/{table}.parquet'")
    want = con.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, sf)
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    rows = lambda columns, found: sorted(tuple(str(r[columns.index(c)]) for c in order) for r in found)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(list(want.columns), want.fetchall())
