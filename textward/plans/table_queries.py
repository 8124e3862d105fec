"""Registered queries on records, lists, secrets, commands, paths, audit logs and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.expr import q
from ..functions.sqlfuncs import register as register_sql
from ..operators import audit as A
from ..operators import reconcile as Q
from ..operators.commands import COMMANDS, scan_commands
from ..operators.items import sanitize_array, sanitize_items, sanitize_lines
from ..operators.paths import check_paths
from ..operators.sanitize import sanitize
from ..operators.secrets import ENV_FILE, SECRETS, scan_secrets, secret_gate
from ..operators.structured import extract_field, sanitize_json, sanitize_record
from ..functions.paths import SYSTEM_PREFIXES
from ..rules import RULES
from . import oracle as O
from ..session import new_path
from .registry import register, table
from .seeds import COMMAND_TEXTS, PATH_TEXTS, SECRET_TEXTS, TEXTS, pick, spliced
from .text_queries import DOCS_SQL, docs

# ------------------------------------------------------------ nested records

_ORDER_TEXT = O.pick(TEXTS, "o_orderkey")
_ORDERS_SRC = (f"SELECT o_orderkey * 2 AS id, o_orderpriority || ' ' || {_ORDER_TEXT} AS raw FROM orders UNION ALL "
               f"SELECT o_orderkey * 2 + 1, 'status ' || o_orderstatus FROM orders")


@register("sanitize_record_orders", O.sanitize_sql(_ORDERS_SRC, """SELECT a.id // 2 AS o_orderkey, a.t AS notes, b.t AS status,
    o_totalprice AS price, CAST(a.n + b.n AS INTEGER) AS original_length, CAST(length(a.t) + length(b.t) AS INTEGER) AS cleaned_length,
    CAST(len(a.d) + len(b.d) AS INTEGER) AS threat_count FROM {last} a JOIN {last} b ON b.id = a.id + 1 AND a.id % 2 = 0
    JOIN orders ON o_orderkey = a.id // 2"""))
def sanitize_record_orders(spark, sf):
    text = F.concat("o_orderpriority", F.lit(" "), pick(TEXTS, "o_orderkey"))
    record = F.struct(F.struct(text.alias("notes"), F.col("o_totalprice").alias("price")).alias("inner"),
                      F.array(F.concat(F.lit("status "), F.col("o_orderstatus"))).alias("tags"))
    df = table(spark, sf, "orders").select("o_orderkey", record.alias("doc"))
    out = sanitize_record(df, "doc")
    return out.select("o_orderkey", F.col("cleaned.inner.notes").alias("notes"), F.element_at("cleaned.tags", 1).alias("status"),
                      F.col("cleaned.inner.price").alias("price"), F.col("report.original_length").alias("original_length"),
                      F.col("report.cleaned_length").alias("cleaned_length"), F.size("report.detections").alias("threat_count"))


_PROPS_SRC = (f"SELECT event_id * 2 AS id, {O.pick(TEXTS, 'event_id')} AS raw FROM events UNION ALL "
              f"SELECT event_id * 2 + 1, event_type || ' ' || {O.pick(TEXTS, '(event_id + 7)')} FROM events")
_PROPS_SQL = O.sanitize_sql(_PROPS_SRC, """SELECT event_id, a.t AS note, CASE WHEN event_id % 2 = 0 THEN b.t ELSE '17.50' END AS mixed, '{{"y":null,"AVOID":"x"}}' AS rest,
    CAST(len(a.d) + CASE WHEN event_id % 2 = 0 THEN len(b.d) ELSE 0 END AS INTEGER) AS threat_count
    FROM {last} a JOIN {last} b ON b.id = a.id + 1 AND a.id % 2 = 0 JOIN events ON event_id = a.id // 2""")


def json_events(spark, sf, root: str = "{}"):
    """Event properties with texts at several places; `mixed` is a text in one row and a number in the next."""
    note = F.to_json(F.struct(pick(TEXTS, "event_id").alias("x")))
    other = F.to_json(F.struct(F.concat(F.col("event_type"), F.lit(" "), pick(TEXTS, "__k")).alias("x")))
    value = lambda j: F.expr(f"substring({j}, 6, length({j}) - 6)")  # the JSON literal of a text
    df = table(spark, sf, "events").withColumn("__k", F.col("event_id") + 7).withColumns({"__n": note, "__o": other})
    mixed = F.when(F.col("event_id") % 2 == 0, value("__o")).otherwise("17.50")
    doc = F.concat(F.expr("left(props, length(props) - 1)"), F.lit(', "note" : '), value("__n"), F.lit(', "deep":[{"a.b":'), mixed,
                   F.lit('},null,1e3], "rest":{"y":null,"AVOID":"x"}}'))
    before, after = root.split("{}")
    return df.select("event_id", F.concat(F.lit(before), doc, F.lit(after)).alias("props"))


def _json_parts(out, at="$"):
    text = lambda path: F.expr(f"variant_get(parse_json(cleaned), '{at}{path}', 'string')")
    return out.select("event_id", text(".note").alias("note"), text(".deep[0][\"a.b\"]").alias("mixed"),
                      F.regexp_extract("cleaned", r'"rest":(\{[^}]*\})', 1).alias("rest"), F.size("report.detections").alias("threat_count"))


@register("sanitize_json_events", _PROPS_SQL)
def sanitize_json_events(spark, sf):
    return _json_parts(sanitize_json(json_events(spark, sf), "props")).withColumn("mixed", F.when(F.col("event_id") % 2 == 0, F.col("mixed")).otherwise("17.50"))


@register("sanitize_json_list_root", _PROPS_SQL)
def sanitize_json_list_root(spark, sf):
    return _json_parts(sanitize_json(json_events(spark, sf, "[{}]"), "props"), "$[0]").withColumn("mixed", F.when(F.col("event_id") % 2 == 0, F.col("mixed")).otherwise("17.50"))


@register("nesting_cap_orders", "SELECT o_orderkey, '[nesting-limit]' AS deep, o_orderstatus AS shallow FROM orders")
def nesting_cap_orders(spark, sf):
    deep = F.col("o_totalprice")
    for level in range(11):
        deep = F.struct(deep.alias("x"))
    df = table(spark, sf, "orders").select("o_orderkey", F.struct(deep.alias("d"), F.col("o_orderstatus").alias("s")).alias("doc"))
    out = sanitize_record(df, "doc")
    return out.select("o_orderkey", F.col("cleaned.d" + ".x" * 10).alias("deep"), F.col("cleaned.s").alias("shallow"))


@register("extract_field_events", """SELECT event_id, 'run "' || event_type || '"' AS command, '' AS number, '' AS missing, '' AS broken FROM events""")
def extract_field_events(spark, sf):
    doc = F.concat(F.lit('{"tool_input":{"command":"run \\"'), F.col("event_type"), F.lit('\\"","n":'), F.col("user_id"), F.lit("}}"))
    df = table(spark, sf, "events").select("event_id", doc.alias("j"), F.lit("{").alias("half"))
    return df.select("event_id", extract_field("j", "tool_input.command").alias("command"), extract_field("j", "tool_input.n").alias("number"),
                     extract_field("j", "tool_input.none.deeper").alias("missing"), extract_field("half", "a").alias("broken"))


# ---------------------------------------------------------------------- lists

_TURNS_SRC = f"SELECT conv_id * 1000000 + turn AS id, {O.spliced('text', TEXTS, '(conv_id + turn)')} AS raw FROM conversations"


def turns(spark, sf):
    return table(spark, sf, "conversations").withColumn("__k", F.col("conv_id") + F.col("turn")).select(
        "conv_id", "turn", spliced("text", TEXTS, "__k").alias("text"))


@register("sanitize_lines_conversations", O.sanitize_sql(_TURNS_SRC, """SELECT id // 1000000 AS conv_id, md5(string_agg(t, '\n---\n' ORDER BY id)) AS cleaned_md5,
    CAST(sum(n) AS BIGINT) AS original_length, CAST(sum(length(t)) + (count(*) - 1) * 5 AS BIGINT) AS cleaned_length,
    CAST(sum(len(d)) AS INTEGER) AS threat_count FROM {last} GROUP BY 1"""))
def sanitize_lines_conversations(spark, sf):
    out = sanitize_lines(turns(spark, sf), ["conv_id"], "turn", "text", separator="\n---\n")
    return out.select("conv_id", F.md5("cleaned").alias("cleaned_md5"), F.col("report.original_length").alias("original_length"),
                      F.col("report.cleaned_length").alias("cleaned_length"), F.size("report.detections").alias("threat_count"))


@register("sanitize_items_conversations", O.sanitize_sql(_TURNS_SRC, """SELECT id // 1000000 AS conv_id, md5(string_agg(t, '|' ORDER BY id)) AS cleaned_md5,
    CAST(count(*) AS INTEGER) AS n_items, CAST(sum(n) AS BIGINT) AS original_length, CAST(sum(length(t)) AS BIGINT) AS cleaned_length
    FROM {last} GROUP BY 1"""))
def sanitize_items_conversations(spark, sf):
    out = sanitize_items(turns(spark, sf), ["conv_id"], "turn", "text")
    return out.select("conv_id", F.md5(F.array_join("cleaned", "|")).alias("cleaned_md5"), F.size("cleaned").alias("n_items"),
                      F.col("report.original_length").alias("original_length"), F.col("report.cleaned_length").alias("cleaned_length"))


_HALVES = f"""SELECT doc_id * 2 AS id, text AS raw FROM documents UNION ALL
    SELECT doc_id * 2 + 1, {O.pick(TEXTS, 'doc_id')} FROM documents"""


@register("sanitize_array_documents", O.sanitize_sql(_HALVES, """SELECT id // 2 AS doc_id, string_agg(t, '|' ORDER BY id) AS cleaned,
    CAST(sum(len(d)) AS INTEGER) AS threat_count FROM {last} GROUP BY 1"""))
def sanitize_array_documents(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", F.array(F.col("text"), pick(TEXTS, "doc_id")).alias("parts"))
    return sanitize_array(df, "parts").select("doc_id", F.array_join("cleaned", "|").alias("cleaned"),
                                              F.size("report.detections").alias("threat_count"))


# -------------------------------------------------------------------- secrets

def _secret_docs(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", spliced("text", SECRET_TEXTS, "doc_id").alias("text"),
        F.concat(F.col("source"), F.when(F.col("doc_id") % 50 == 0, "/.env.local").otherwise("/a.env")).alias("path"))


_SECRET_SRC = (f"SELECT doc_id, {O.spliced('text', SECRET_TEXTS, 'doc_id')} AS t, source || CASE WHEN doc_id % 50 = 0 THEN '/.env.local' "
               "ELSE '/a.env' END AS path FROM documents")
_SECRET_HITS = " UNION ALL ".join(
    f"SELECT doc_id, {O.s(r.vector)} AS vector, {O.s(r.severity)} AS severity, unnest(regexp_extract_all(t, {O.s(r.pattern)})) AS hit FROM src"
    for r in SECRETS) + f" UNION ALL SELECT doc_id, 'env_file', 'critical', '.env' FROM src WHERE regexp_matches(string_split(path, '/')[-1], {O.s(ENV_FILE)})"


@register("scan_secrets_documents", f"WITH src AS MATERIALIZED ({_SECRET_SRC}) SELECT doc_id, vector, severity, left(ltrim(hit), 4) || '***' AS evidence FROM ({_SECRET_HITS})")
def scan_secrets_documents(spark, sf):
    return scan_secrets(_secret_docs(spark, sf), "text", "doc_id", path_col="path")


@register("secret_gate_documents", f"WITH src AS MATERIALIZED ({_SECRET_SRC}) SELECT doc_id FROM src WHERE doc_id NOT IN (SELECT doc_id FROM ({_SECRET_HITS}))")
def secret_gate_documents(spark, sf):
    return secret_gate(_secret_docs(spark, sf), "text", "path").select("doc_id")


@register("secrets_by_vector", f"WITH src AS MATERIALIZED ({_SECRET_SRC}) SELECT vector, count(*) AS n FROM ({_SECRET_HITS}) GROUP BY vector")
def secrets_by_vector(spark, sf):
    return scan_secrets(_secret_docs(spark, sf), "text", "doc_id", path_col="path").groupBy("vector").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------- commands

_CMD_SRC = f"SELECT event_id, {O.pick(COMMAND_TEXTS, 'event_id')} || ' ' || event_type AS t FROM events"


@register("scan_commands_events", f"WITH src AS MATERIALIZED ({_CMD_SRC}) SELECT category, vector, severity, count(*) AS n FROM (" + " UNION ALL ".join(
    f"SELECT {O.s(r.category)} AS category, {O.s(r.vector)} AS vector, {O.s(r.severity)} AS severity FROM src WHERE regexp_matches(t, {O.s(r.pattern)})"
    for r in COMMANDS) + ") GROUP BY ALL")
def scan_commands_events(spark, sf):
    df = table(spark, sf, "events").select(F.concat(pick(COMMAND_TEXTS, "event_id"), F.lit(" "), F.col("event_type")).alias("command"))
    return (scan_commands(df, "command").select(F.explode("warnings").alias("w")).groupBy(
        F.col("w.category").alias("category"), F.col("w.vector").alias("vector"), F.col("w.severity").alias("severity"))
        .agg(F.count("*").alias("n")))


# ---------------------------------------------------------------------- paths

_RESOLVED = {
    "notes/a.md": "/work/notes/a.md", "/work/out/b.json": "/work/out/b.json", "../escape": "/escape", "/work/../etc/passwd": "/etc/passwd",
    "/etcetera/x": "/etcetera/x", "/usr/bin/x": "/usr/bin/x", "/tmp/x": "/tmp/x", "a/./b//c": "/work/a/b/c", "/work": "/work",
    "/workshop/x": "/workshop/x", "../work/ok": "/work/ok", "/var/run/x": "/var/run/x", "/var/log/x": "/var/log/x"}
_PATH_SQL = f"""SELECT page_id, resolved, NOT system AND (resolved = '/work' OR starts_with(resolved, '/work/')) AS allowed,
    CASE WHEN system THEN 'system' WHEN resolved = '/work' OR starts_with(resolved, '/work/') THEN 'none' ELSE 'outside' END AS why FROM (
    SELECT *, {' OR '.join(f"starts_with(resolved, {O.s(p)})" for p in SYSTEM_PREFIXES)} AS system FROM (
    SELECT page_id, {O.pick(tuple(_RESOLVED[p] for p in PATH_TEXTS), 'page_id')} || '/' || page_id AS resolved FROM pages))"""


@register("check_paths_pages", _PATH_SQL)
def check_paths_pages(spark, sf):
    path = F.concat(pick(PATH_TEXTS, "page_id"), F.lit("/./x/../"), F.col("page_id").cast("string"))
    out = check_paths(table(spark, sf, "pages").select("page_id", path.alias("path")), "path", "/work")
    why = (F.when(F.col("reason").isNull(), "none").when(F.contains("reason", F.lit("system")), "system").otherwise("outside"))
    return out.select("page_id", "resolved", "allowed", why.alias("why"))


# ------------------------------------------------------------------ audit log

def _event_log(spark, sf, rows_per_chain=200) -> DataFrame:
    """A chained log per event type over all events."""
    e = table(spark, sf, "events")
    entries = e.select(
        F.col("event_type").alias("log"), "event_id",
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("timestamp"), F.lit("(in-memory)").alias("destination"),
        F.col("event_type").alias("context"), F.lit("append").alias("action"), F.length("props").alias("original_length"),
        F.length("props").alias("cleaned_length"), (F.col("event_id") % 3 == 0).alias("threats_found"),
        (F.col("event_id") % 3 == 0).cast("int").alias("threat_count"), F.array().cast(f"array<{A.DETECTION4}>").alias("detections"))
    return A.build_chain(entries, "log", ["event_id"], rows_per_chain=rows_per_chain)


def _chain_sql(select: str, rows_per_chain: int = 200) -> str:
    return f"""WITH RECURSIVE src AS MATERIALIZED (SELECT event_type AS log, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS p,
        '{{"timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00","prev_hash":"' AS head,
        '","destination":"(in-memory)","context":"' || event_type || '","action":"append","original_length":' || length(props) ||
        ',"cleaned_length":' || length(props) || ',"threats_found":' || (event_id % 3 = 0) || ',"threat_count":' ||
        CAST(event_id % 3 = 0 AS INTEGER) || ',"detections":[]}}' AS tail FROM events),
    rows AS MATERIALIZED (SELECT log, p // {rows_per_chain} AS chain, p % {rows_per_chain} + 1 AS seq, head, tail FROM src),
    walk AS (SELECT log, chain, seq, 'genesis' AS prev_hash, head || 'genesis' || tail AS line FROM rows WHERE seq = 1
        UNION ALL SELECT r.log, r.chain, r.seq, left(sha256(w.line), 16), r.head || left(sha256(w.line), 16) || r.tail
        FROM walk w JOIN rows r ON r.log = w.log AND r.chain = w.chain AND r.seq = w.seq + 1) {select}"""


@register("audit_chain_events", _chain_sql("SELECT log, chain, seq, prev_hash, md5(line) AS line_md5 FROM walk"))
def audit_chain_events(spark, sf):
    return _event_log(spark, sf).select("log", "chain", "seq", "prev_hash", F.md5("line").alias("line_md5"))


@register("audit_heads_events", _chain_sql("SELECT log, count(*) AS head_seq, left(sha256(arg_max(line, chain * 1000 + seq)), 16) AS head_hash FROM walk GROUP BY log"))
def audit_heads_events(spark, sf):
    return A.chain_heads(_event_log(spark, sf), "log")


def _tampered(log: DataFrame) -> DataFrame:
    """Change every line whose seq is a multiple of 50."""
    return log.withColumn("line", F.when(F.col("seq") % 50 == 0, F.replace("line", F.lit('"append"'), F.lit('"write"'))).otherwise(F.col("line")))


@register("audit_verify_events", """SELECT event_type AS log, CASE WHEN s > 1 AND (s - 1) % 50 = 0 THEN 'broken' ELSE 'ok' END AS status, count(*) AS n
    FROM (SELECT event_type, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) % 200 + 1 AS s FROM events) GROUP BY ALL""")
def audit_verify_events(spark, sf):
    return A.verify_chain(_tampered(_event_log(spark, sf)), ["log", "chain"]).groupBy("log", "status").agg(F.count("*").alias("n"))


@register("audit_verify_long_events", """SELECT event_type AS log, CASE WHEN p > 1 AND (((p - 2) % 200 + 1) % 50 = 0 OR p % 200 = 1) THEN 'broken' ELSE 'ok' END AS status,
    count(*) AS n FROM (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS p FROM events) GROUP BY ALL""")
def audit_verify_long_events(spark, sf):
    """Each log read as one chain, as a foreign log is: every new start within it breaks the chain, as every changed line does."""
    log = _tampered(_event_log(spark, sf)).select("log", (F.col("chain") * 200 + F.col("seq")).alias("seq"), "line")
    return A.verify_long_chains(log, ["log"]).groupBy("log", "status").agg(F.count("*").alias("n"))


@register("audit_rotate_log_events", """WITH s AS (SELECT event_type AS log, count(*) AS n FROM events GROUP BY 1),
    c AS (SELECT log, n, CASE WHEN n > 1000 THEN (n // 2) // 200 ELSE 0 END AS first FROM s)
    SELECT log, n - first * 200 AS n_kept, first AS first_chain, first * 200 AS dropped, 0 AS n_wrong FROM c""")
def audit_rotate_log_events(spark, sf):
    """Logs of many chains rotated as one, and what stays checked against the seals of the whole."""
    path = new_path(spark, "log")
    made = _event_log(spark, sf)
    made.write.parquet(path)
    log = spark.read.schema(made.schema).parquet(path)
    kept, markers = A.rotate_log(log, rows_per_chain=200, limit=1000, timestamp=F.expr(_AT))
    wrong = A.verify_retained(kept, markers, A.seals(log)).groupBy("log").agg(F.count("*").alias("n_wrong"))
    dropped = markers.select("log", F.col("chain").alias("marked"), F.get_json_object("line", "$.dropped_count").cast("long").alias("dropped"))
    out = kept.groupBy("log").agg(F.count("*").alias("n_kept"), F.min("chain").alias("first_chain")).join(dropped, "log", "left").join(wrong, "log", "left")
    return out.select("log", "n_kept", "first_chain", F.coalesce("dropped", F.lit(0)).cast("long").alias("dropped"),
                      F.coalesce("n_wrong", F.lit(0)).cast("int").alias("n_wrong"))


@register("audit_orphans_events", """SELECT event_type AS log, count(*) AS n FROM (SELECT event_type, (row_number() OVER (PARTITION BY event_type
    ORDER BY event_id) - 1) % 200 + 1 AS s FROM events) WHERE s > 1 AND (s - 1) % 50 = 0 GROUP BY ALL""")
def audit_orphans_events(spark, sf):
    return A.orphans(_tampered(_event_log(spark, sf)), ["log", "chain"]).groupBy("log").agg(F.count("*").alias("n"))


@register("audit_forks_events", _chain_sql("""SELECT log, chain, prev_hash, 2 AS n FROM walk WHERE seq % 40 = 0"""))
def audit_forks_events(spark, sf):
    log = _event_log(spark, sf)
    return A.forks(log.unionByName(log.filter("seq % 40 = 0")), ["log", "chain"]).withColumn("n", F.col("n").cast("int"))


_AT = "timestamp'2024-06-01 00:00:00'"


@register("audit_rotate_events", _chain_sql("""SELECT w.log, w.chain, w.seq - c.k + 1 AS seq, w.prev_hash, CAST(NULL AS BIGINT) AS dropped_count,
    CAST(NULL AS VARCHAR) AS dropped_tail_sha FROM walk w JOIN cnt c USING (log, chain) WHERE c.m > 150 AND w.seq > c.k
    UNION ALL SELECT w.log, w.chain, w.seq, w.prev_hash, NULL, NULL FROM walk w JOIN cnt c USING (log, chain) WHERE c.m <= 150
    UNION ALL SELECT w.log, w.chain, 1, 'genesis', c.k, left(sha256(w.line), 16) FROM walk w JOIN cnt c USING (log, chain) WHERE c.m > 150 AND w.seq = c.k
    """).replace("SELECT w.log, w.chain, w.seq - c.k", ", cnt AS (SELECT log, chain, count(*) AS m, count(*) // 2 AS k FROM walk GROUP BY ALL) SELECT w.log, w.chain, w.seq - c.k", 1))
def audit_rotate_events(spark, sf):
    out = A.rotate(_event_log(spark, sf), ["log", "chain"], limit=150, timestamp=F.expr(_AT))
    return out.select("log", "chain", "seq", F.get_json_object("line", "$.prev_hash").alias("prev_hash"),
                      F.get_json_object("line", "$.dropped_count").cast("long").alias("dropped_count"),
                      F.get_json_object("line", "$.dropped_tail_sha").alias("dropped_tail_sha"))


@register("audit_verify_rotated", """WITH s AS (SELECT event_type AS log, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 200 AS chain FROM events),
    c AS (SELECT log, chain, count(*) AS m FROM s GROUP BY ALL) SELECT status, CAST(sum(k) AS BIGINT) AS n FROM (
    SELECT 'rotated' AS status, 1 AS k FROM c WHERE m > 150 UNION ALL
    SELECT 'ok', CASE WHEN m > 150 THEN m - m // 2 ELSE m END FROM c) GROUP BY status""")
def audit_verify_rotated(spark, sf):
    log = A.rotate(_event_log(spark, sf), ["log", "chain"], limit=150, timestamp=F.expr(_AT))
    return A.verify_chain(log, ["log", "chain"]).groupBy("status").agg(F.count("*").alias("n"))


@register("audit_entries_documents", O.sanitize_sql(DOCS_SQL, """SELECT id AS doc_id, '(in-memory)' AS destination, 'markdown' AS context,
    'sanitize_only' AS action, CAST(n AS INTEGER) AS original_length, CAST(length(t) AS INTEGER) AS cleaned_length,
    CAST(len(d) AS INTEGER) AS threat_count, '2024-01-01T00:00:00.000000+00:00' AS timestamp FROM {last} WHERE len(d) > 0"""))
def audit_entries_documents(spark, sf):
    clean = sanitize(docs(spark, sf), "text", "markdown")
    return A.audit_entries(clean, "(in-memory)", "markdown", "sanitize_only", keep=("doc_id",), only_threats=True,
                           timestamp=F.expr("timestamp'2024-01-01 00:00:00'")).drop("detections", "threats_found")


@register("audit_threat_entries", _chain_sql("SELECT log, count(*) AS n FROM walk WHERE CAST(json_extract(line, '$.threats_found') AS BOOLEAN) GROUP BY log"))
def audit_threat_entries(spark, sf):
    parsed = _event_log(spark, sf).select("log", F.from_json("line", A.SCHEMA).alias("e")).select("log", "e.*")
    return A.threat_entries(parsed).groupBy("log").agg(F.count("*").alias("n"))


@register("modified_files_events", "SELECT DISTINCT user_id, event_type || '/' || (event_id % 5) AS path FROM events")
def modified_files_events(spark, sf):
    edits = table(spark, sf, "events").select("user_id", F.concat("event_type", F.lit("/"), (F.col("event_id") % 5).cast("string")).alias("path"))
    return A.modified_files(edits, "user_id", "path")


# -------------------------------------------------------------- reconciliation

@register("date_agreement_orders", """WITH a AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS date FROM orders WHERE o_orderstatus <> 'P'),
    b AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 7 = 0 AS INTEGER) AS date FROM orders),
    c AS (SELECT l_orderkey AS k, min(CAST(o_orderdate AS DATE)) AS date FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)
    SELECT k, coalesce(a.date = b.date AND b.date = c.date, false) AS passed FROM a FULL JOIN b USING (k) FULL JOIN c USING (k)""")
def date_agreement_orders(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus", F.to_date("o_orderdate").alias("date"))
    shifted = o.select("k", F.date_add("date", (F.col("k") % 7 == 0).cast("int")).alias("date"))
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k")).join(o.select("k", "date"), "k")
    third = lines.groupBy("k").agg(F.min("date").alias("date"))
    return Q.date_agreement(o.filter("o_orderstatus <> 'P'"), shifted, third, "k").select("k", "passed")


@register("list_budget_orders", """SELECT l_orderkey, CAST(k AS INTEGER) AS item_count, k <= 4 AS passed, CASE WHEN k > 4 THEN array_to_string(p, '|') END AS previews FROM (
    SELECT l_orderkey, count(*) AS k, list(left('item number ' || lpad(CAST(l_linenumber AS VARCHAR), 3, '0') || ' ' || l_returnflag, 16) || '...' ORDER BY l_linenumber, l_returnflag) AS p
    FROM lineitem GROUP BY l_orderkey)""")
def list_budget_orders(spark, sf):
    text = F.concat(F.lit("item number "), F.lpad(F.col("l_linenumber").cast("string"), 3, "0"), F.lit(" "), F.col("l_returnflag"))
    lists = (table(spark, sf, "lineitem").select("l_orderkey", text.alias("t")).groupBy("l_orderkey")
             .agg(F.array_sort(F.collect_list("t")).alias("items")))
    out = Q.list_budget(lists, "items", 4, 16)
    return out.select("l_orderkey", "item_count", "passed", F.array_join("previews", "|").alias("previews"))


@register("missing_claims_orders", """SELECT o_orderkey AS session, 'line-' || o_orderkey || '-' || i AS path FROM orders, unnest([1, 2, 3]) AS u(i)
    WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = i)""")
def missing_claims_orders(spark, sf):
    claims = table(spark, sf, "orders").select(F.col("o_orderkey").alias("session"), F.transform(
        F.array(F.lit(1), F.lit(2), F.lit(3)), lambda i: F.concat_ws("-", F.lit("line"), F.col("o_orderkey"), i)).alias("files"))
    seen = table(spark, sf, "lineitem").select(F.concat_ws("-", F.lit("line"), "l_orderkey", "l_linenumber").alias("path"))
    return Q.missing_claims(claims, "session", "files", seen)


@register("paired_coverage_events", """SELECT user_id, count(*) FILTER (event_type <> 'signup') AS project_files, count(*) FILTER (event_type = 'signup') AS lesson_files,
    CASE WHEN count(*) FILTER (event_type <> 'signup') = 0 THEN 'not applicable' WHEN count(*) FILTER (event_type = 'signup') = 0 THEN 'failed' ELSE 'passed' END AS status
    FROM events GROUP BY user_id""")
def paired_coverage_events(spark, sf):
    path = F.when(F.col("event_type") == "signup", "tasks/lessons/x.md").otherwise(F.concat(F.lit("Projects/"), F.col("event_type")))
    return Q.paired_coverage(table(spark, sf, "events").select("user_id", path.alias("path")), "user_id", "path")


@register("line_budget_documents", "SELECT doc_id, CAST(len(string_split(text, chr(10))) AS INTEGER) AS line_count, len(string_split(text, chr(10))) < 20 AS passed FROM documents")
def line_budget_documents(spark, sf):
    return Q.line_budget(table(spark, sf, "documents"), "text", 20).select("doc_id", "line_count", "passed")


@register("check_totals_documents", "SELECT source, count(*) FILTER (p) AS n_passed, count(*) FILTER (NOT p) AS n_failed, count(*) AS n_checks FROM "
          "(SELECT source, len(string_split(text, chr(10))) < 20 AS p FROM documents) GROUP BY source")
def check_totals_documents(spark, sf):
    return Q.check_totals(Q.line_budget(table(spark, sf, "documents"), "text", 20), "source")


@register("untracked_sources", "SELECT DISTINCT source AS pipeline FROM documents WHERE source NOT IN (SELECT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)")
def untracked_sources(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("source").alias("pipeline"))
    tracked = d.join(table(spark, sf, "labels").filter("toxic = 1").select("doc_id"), "doc_id")
    return Q.untracked_pipelines(d.select("pipeline").distinct(), tracked)


# -------------------------------------------------------------- SQL functions

@register("sql_functions_pages", f"""SELECT page_id, md5(regexp_replace(html, '<[^>]+>', '', 'g')) AS stripped_md5,
    left(sha256(trim(url)), 16) AS url_hash, list_filter([{', '.join(f"CASE WHEN regexp_matches(html, {O.s(O.SHORT_TOKENS if r.vector == 'rag_token_stuffing' else r.re2)}) THEN {O.s(r.vector)} END" for r in RULES)}],
    lambda x: x IS NOT NULL) AS vectors FROM pages""")
def sql_functions_pages(spark, sf):
    register_sql(spark)
    table(spark, sf, "pages").createOrReplaceTempView("tw_pages")
    return spark.sql("""SELECT page_id, md5(tw_strip_html_tags(html)) AS stripped_md5, tw_entry_hash(url) AS url_hash,
        tw_threat_vectors(html) AS vectors FROM tw_pages""")
