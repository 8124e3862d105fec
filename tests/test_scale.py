"""Tests of the plans that keep cleaning linear: gates, partitions, what goes to Python, how often a text is scored."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from textward import rules as R, session
from textward.functions.gates import Gates
from textward.functions.sqlfuncs import register
from textward.functions.text import rule_matches
from textward.functions.unicode import may_change, normalise_states
from textward.operators.sanitize import sanitize
from textward.session import spread


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_steps_hand_texts_on_without_copies(spark):
    df = sanitize(spark.createDataFrame([("x",)], "t string"), "t")
    assert "transform(array(" not in plan(df)


def test_gates_of_more_words_than_bits(spark):
    gates = Gates(R.RULES)
    assert len(gates.tokens) > 64
    words = [w for w in gates.words if len(w) > 2]
    df = spark.createDataFrame([(w,) for w in words] + [("",), (None,)], "t string").withColumn("f", F.expr(gates.found_in("t")))
    rows = df.select("t", *[F.expr(gates.has("f", w)).alias(f"c{i}") for i, w in enumerate(words)], F.expr(gates.any_found("f")).alias("any")).collect()
    for r in rows:
        if r.t:
            assert r.any and r[f"c{words.index(r.t)}"], r.t
        else:
            assert not r.any


def test_tasks_grow_with_the_files(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    spark.range(50000).selectExpr("id", "md5(cast(id as string)) as t").coalesce(1).write.parquet(path)
    df = spark.read.parquet(path)
    size = sum(p.stat().st_size for p in (tmp_path / "t").glob("*.parquet"))
    monkeypatch.setattr(session, "TASK_BYTES", size // 40)
    assert spread(df).rdd.getNumPartitions() >= 40 and spread(df).count() == 50000


def test_spread_of_unknown_size(spark):
    rows = spark.createDataFrame(spark.sparkContext.parallelize([(1,)], 1), "id int")
    assert spread(rows).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_invisible_characters_do_not_go_to_python(spark):
    texts = ["a\u200bb", "\ufeffx", "x \u2060\u2064 y", "a\u202eb", "e\u0301", "a\u2001b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(F.expr(may_change("t"))).collect()]
    assert got == [False, False, False, False, True, True]


@pytest.mark.parametrize("n", [0, 1, 64, 65, 200])
def test_normalising_in_slices(spark, n):
    texts = [None if i % 7 == 3 else f"e\u0301{i}\u212b" for i in range(n)]
    kind = "struct<t:string,a:string,n:int>"
    rows = spark.createDataFrame([(i, (t, None, i)) for i, t in enumerate(texts)], f"id int, s {kind}").coalesce(1)
    got = rows.select("id", normalise_states(rows.schema["s"].dataType)(F.col("s")).alias("s")).orderBy("id").collect()
    assert [r.s.t for r in got] == [None if t is None else unicodedata.normalize("NFC", t) for t in texts]
    assert [r.s.a for r in got] == [None if t is None else f"e{i}A" for i, t in enumerate(texts)]


def test_sql_threat_vectors_are_gated_and_equal(spark):
    register(spark)
    texts = ["plain", "", None, "DROP TABLE x", "1 OR 1=1", "<a onclick='x'>", "SLEEP (5)", "\u0130nsert into x", "'src': 'javascript:x'", "AA BB CC DD EE FF "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plainly = [F.expr(rule_matches("t", r)).alias(r.vector) for r in R.RULES]
    rows = df.select("t", F.expr("tw_threat_vectors(t)").alias("v"), *plainly).collect()
    for r in rows:
        assert r.v == [x.vector for x in R.RULES if r[x.vector]], r.t
    assert sum(bool(r.v) for r in rows) >= 6


def test_each_text_is_scored_once(spark):
    import corpus_pipeline

    rows = [(i, "the cat sat on the mat" if i % 2 else "der Hund und die Katze", "en" if i % 2 else "de") for i in range(40)]
    out = corpus_pipeline.language(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "")
    assert plan(out).count("ArrowEvalPython") == 1 and out.count() == 40
