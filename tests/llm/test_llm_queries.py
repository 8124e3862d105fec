"""Registered queries of the folder against their SQL, and the stages of the pipeline."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from textward.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    want = sorted(repr(tuple(r[names.index(c)] for c in df.columns)) for r in cur.fetchall())
    assert sorted(repr(tuple(r)) for r in df.collect()) == want


def test_stages_keep_columns_and_decide_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = [(9001, None, "en", "src0", 0), (9002, "", None, None, None), (9003, "123 ...", "en", "src0", 7), (9004, docs.first().text, "en", "src1", 1)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    (_, language), (_, exact), (_, near), (_, mixing), (_, packing) = corpus_pipeline.STAGES
    spoken = language(spark, docs, SF).cache()
    assert ids - {r.doc_id for r in spoken.collect()} == {9001, 9002, 9003} and spoken.columns == docs.columns
    once = exact(spark, spoken, SF).cache()
    assert once.columns == docs.columns
    assert {r.doc_id for r in once.collect()} == {r.m for r in spoken.groupBy("text").agg(F.max("doc_id").alias("m")).collect()}
    apart = near(spark, once, SF).cache()
    assert apart.columns == docs.columns and 0 < apart.count() <= once.count()
    drawn = mixing(spark, apart, SF).cache()
    assert drawn.columns == docs.columns and 0 < drawn.count() <= apart.count()
    pieces = packing(spark, drawn, SF)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in drawn.collect()}


def test_run_is_the_stages_in_order(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and max(r.offset + r.length for r in rows) <= 2048
