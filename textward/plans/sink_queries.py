"""Registered queries on the guarded sinks: write, read back, and check the log that was kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import audit as A
from ..session import new_path
from ..sources import sinks as S
from . import oracle as O
from .registry import register, table
from .table_queries import _PROPS_SQL, _TURNS_SRC, _event_log, _json_parts, json_events, turns
from .text_queries import DOCS_SQL, docs


def _at():
    return F.expr("timestamp'2024-01-01 00:00:00'")


def _status(spark: SparkSession, audit: str, n_entries: int) -> str:
    """'ok' if chains, seals and heads of the log fit, with an entry for each row."""
    ok = S.verify_audit(spark, audit).isEmpty() and S.read_log(spark, audit).count() == n_entries
    return "ok" if ok else "broken"


@register("write_text_documents", O.sanitize_sql(DOCS_SQL, "SELECT id AS doc_id, md5(t) AS text_md5, 'ok' AS status FROM {last}", "markdown"))
def write_text_documents(spark, sf):
    """Two writes to one destination, the second appended."""
    root = new_path(spark, "sink")
    d = docs(spark, sf).select("doc_id", "text", "lang")
    english = F.col("lang").eqNullSafe("en")
    for part, mode in ((d.where(english), "overwrite"), (d.where(~english), "append")):
        S.write_text(part, "text", "docs", f"{root}/audit", root=root, key="doc_id", context="markdown", mode=mode, timestamp=_at())
    data = spark.read.parquet(f"{root}/docs")
    return data.select("doc_id", F.md5("text").alias("text_md5"), F.lit(_status(spark, f"{root}/audit", data.count())).alias("status"))


@register("write_json_events", _PROPS_SQL)
def write_json_events(spark, sf):
    root = new_path(spark, "sink")
    # the id goes along in the document, since a file of JSON lines has no other columns
    df = json_events(spark, sf).withColumn("props", F.concat(F.lit('{"id":'), F.col("event_id"), F.lit(","), F.expr("substring(props, 2)")))
    reports = S.write_json_documents(df, "props", "events", f"{root}/audit", root=root, key="event_id", timestamp=_at())
    data = spark.read.text(f"{root}/events").select(F.get_json_object("value", "$.id").cast("long").alias("event_id"), F.col("value").alias("cleaned"))
    back = _json_parts(data.join(reports.select("event_id", "report"), "event_id"))
    return back.withColumn("mixed", F.when(F.col("event_id") % 2 == 0, F.col("mixed")).otherwise("17.50"))


@register("write_lines_conversations", O.sanitize_sql(_TURNS_SRC, "SELECT id // 1000000 AS conv_id, md5(string_agg(t, '|' ORDER BY id)) AS cleaned_md5, "
          "'ok' AS status FROM {last} GROUP BY 1"))
def write_lines_conversations(spark, sf):
    root = new_path(spark, "sink")
    S.write_lines(turns(spark, sf), ["conv_id"], "turn", "text", "talks", f"{root}/audit", root=root, separator="|", timestamp=_at())
    data = spark.read.parquet(f"{root}/talks")
    return data.select("conv_id", F.md5("cleaned").alias("cleaned_md5"), F.lit(_status(spark, f"{root}/audit", data.count())).alias("status"))


def _logged(spark, audit: str) -> DataFrame:
    return S.read_audit(spark, audit).groupBy("destination", "action", "threats_found").agg(
        F.count("*").alias("n"), F.sum("threat_count").alias("threats"))


@register("sanitize_only_documents", O.sanitize_sql(DOCS_SQL, """SELECT '(in-memory)' AS destination, 'sanitize_only' AS action, true AS threats_found,
    count(*) AS n, CAST(sum(len(d)) AS BIGINT) AS threats FROM {last} WHERE len(d) > 0"""))
def sanitize_only_documents(spark, sf):
    audit = f"{new_path(spark, 'sink')}/audit"
    S.sanitize_only(docs(spark, sf).select("doc_id", "text"), "text", audit, key="doc_id", timestamp=_at())
    return _logged(spark, audit)


@register("sanitize_dict_only_documents", O.sanitize_sql(DOCS_SQL, """SELECT '(in-memory-dict)' AS destination, 'sanitize_dict_only' AS action, true AS threats_found,
    count(*) AS n, CAST(sum(len(d)) AS BIGINT) AS threats FROM {last} WHERE len(d) > 0"""))
def sanitize_dict_only_documents(spark, sf):
    audit = f"{new_path(spark, 'sink')}/audit"
    record = F.struct(F.struct(F.col("text").alias("body"), F.lit(1).alias("n")).alias("inner")).alias("doc")
    S.sanitize_only(docs(spark, sf).select("doc_id", record), "doc", audit, key="doc_id", timestamp=_at())
    return _logged(spark, audit)


@register("audit_jsonl_documents", O.sanitize_sql(DOCS_SQL, """SELECT context, action, count(*) AS n, CAST(sum(len(d)) AS BIGINT) AS threats
    FROM {last} WHERE len(d) > 0 GROUP BY ALL""".replace("context, action", "'general' AS context, 'sanitize_only' AS action")))
def audit_jsonl_documents(spark, sf):
    """The log as JSON lines, read back and filtered."""
    root = new_path(spark, "sink")
    S.sanitize_only(docs(spark, sf).select("doc_id", "text"), "text", f"{root}/audit", key="doc_id", timestamp=_at())
    S.export_audit_jsonl(spark, f"{root}/audit", f"{root}/lines")
    log = A.threat_entries(S.read_audit_jsonl(spark, f"{root}/lines"))
    return log.groupBy("context", "action").agg(F.count("*").alias("n"), F.sum("threat_count").alias("threats"))


@register("audit_missing_chain", """WITH s AS (SELECT event_type AS log, count(*) AS n FROM events GROUP BY 1),
    c AS (SELECT log, n, unnest(range((n + 199) // 200)) AS node FROM s)
    SELECT log, node, CASE WHEN node % 7 = 3 OR n - node * 200 = 1 THEN 'missing' ELSE 'changed' END AS status FROM c WHERE node % 7 IN (3, 5)""")
def audit_missing_chain(spark, sf):
    """Of the chains of each log every seventh is taken out as a whole, and another seventh loses its last line; the rest stays unbroken."""
    path = new_path(spark, "log")
    made = _event_log(spark, sf)
    made.write.parquet(path)
    log = spark.read.schema(made.schema).parquet(path)
    kept = A.seals(log)
    last = log.groupBy("log", "chain").agg(F.max("seq").alias("last"))
    cut = log.where("chain % 7 <> 3").join(last, ["log", "chain"]).where("chain % 7 <> 5 OR seq < last").drop("last")
    return A.verify_seals(cut, kept).select("log", "node", "status")
