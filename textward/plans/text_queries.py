"""Registered queries on text: cleaning, limits, Unicode, hidden content, detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import rules as R
from ..functions import text as X
from ..functions.reports import flat_report, summary, threat_count, threats_found
from ..functions.unicode import homoglyph_ratio, nfc_column
from ..limits import Limits
from ..operators import report as RP
from ..operators.detect import detect
from ..operators.sanitize import limit_text, sanitize, sanitize_for_diary, sanitize_for_markdown
from . import oracle as O
from .registry import register, table
from .seeds import TEXTS, pick, spliced

DOCS_SQL = f"SELECT doc_id AS id, {O.spliced('text', TEXTS, 'doc_id')} AS raw FROM documents"
PAGES_SQL = "SELECT page_id AS id, html AS raw FROM pages"


def docs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with one attack text appended to each."""
    return table(spark, sf, "documents").select("doc_id", spliced("text", TEXTS, "doc_id").alias("text"), "lang", "source")


def pages(spark, sf):
    return table(spark, sf, "pages").select("page_id", "html")


def _digest(df, key):
    return df.select(key, F.md5("cleaned").alias("cleaned_md5"), F.col("report.original_length").alias("original_length"),
                     F.col("report.cleaned_length").alias("cleaned_length"), threat_count().alias("threat_count"),
                     F.array_join("report.detections.vector", ",").alias("vectors"))


def _digest_sql(key):
    return (f"SELECT id AS {key}, md5(t) AS cleaned_md5, CAST(n AS INTEGER) AS original_length, "
            "CAST(CASE WHEN blocked THEN 0 ELSE length(t) END AS INTEGER) AS cleaned_length, "
            "CAST(len(d) AS INTEGER) AS threat_count, array_to_string(list_transform(d, lambda x: x.vector), ',') AS vectors FROM {last}")


# ------------------------------------------------------------- whole cleaning

@register("threats_by_vector_pages", O.sanitize_sql(PAGES_SQL, """SELECT u.category AS category, u.vector AS vector,
    u.severity AS severity, count(*) AS n, count(DISTINCT id) AS n_pages FROM (SELECT id, unnest(d) AS u FROM {last}) GROUP BY ALL"""))
def threats_by_vector_pages(spark, sf):
    return RP.count_by_row(sanitize(pages(spark, sf), "html").select("report.detections"), "detections", "category", "vector", "severity", rows="n_pages")


@register("sanitize_pages_rendered", O.sanitize_sql(PAGES_SQL, _digest_sql("page_id"), "html"))
def sanitize_pages_rendered(spark, sf):
    return _digest(sanitize(pages(spark, sf), "html", "html"), "page_id")


@register("sanitize_documents", O.sanitize_sql(DOCS_SQL, _digest_sql("doc_id")))
def sanitize_documents(spark, sf):
    return _digest(sanitize(docs(spark, sf), "text"), "doc_id")


@register("sanitize_clean_control", O.sanitize_sql(
    "SELECT item_id AS id, text AS raw FROM benchmark", _digest_sql("item_id"), "diary"))
def sanitize_clean_control(spark, sf):
    return _digest(sanitize(table(spark, sf, "benchmark"), "text", "diary"), "item_id")


@register("detections_documents", O.sanitize_sql(DOCS_SQL, """SELECT id AS doc_id, CAST(i - 1 AS INTEGER) AS pos, u.category AS category,
    u.vector AS vector, u.severity AS severity, u.matched AS matched, u.action AS action
    FROM (SELECT id, unnest(d) AS u, generate_subscripts(d, 1) AS i FROM {last})"""))
def detections_documents(spark, sf):
    return RP.detections_table(sanitize(docs(spark, sf), "text"), "doc_id")


def _category(label: str, rules) -> None:
    @register(f"strip_{label}", O.sanitize_sql(DOCS_SQL, _digest_sql("doc_id"), rules=rules))
    def query(spark, sf):
        return _digest(sanitize(docs(spark, sf), "text", rules=tuple(rules)), "doc_id")


for _label, _rules in (("sql_injection", R.SQL), ("code_execution", R.CODE), ("xss", R.XSS), ("prompt_injection", R.PROMPT),
                       ("json_injection", R.JSON), ("encoding_evasion", R.ENCODING), ("ssrf", R.SSRF),
                       ("csv_injection", R.CSV), ("rag_poisoning", R.RAG), ("no_rules", [])):
    _category(_label, _rules)

CUSTOM = R.RULES + (R.Rule("custom", "repeated_article", "medium", r"(?i)\bthe\s+the\b", gate=(("the",),)),)


@register("custom_rule", O.sanitize_sql(DOCS_SQL, _digest_sql("doc_id"), rules=CUSTOM))
def custom_rule(spark, sf):
    return _digest(sanitize(docs(spark, sf), "text", rules=CUSTOM), "doc_id")


@register("sanitize_context_column", O.sanitize_sql(DOCS_SQL, "SELECT id AS doc_id, md5(CASE WHEN id % 2 = 0 THEN "
          "replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') "
          "ELSE t END) AS cleaned_md5 FROM {last}"))
def sanitize_context_column(spark, sf):
    df = docs(spark, sf).withColumn("where_used", F.when(F.col("doc_id") % 2 == 0, "diary").otherwise("markdown"))
    return sanitize(df, "text", context_col="where_used").select("doc_id", F.md5("cleaned").alias("cleaned_md5"))


# --------------------------------------------------------------------- limits

SMALL = Limits(max_bytes=6000, max_chars=2000)


def _limits_sql(source, lim, key):
    steps = O.Steps(source)
    steps.limits(lim)
    steps.nesting(lim)
    return steps.query(f"SELECT id AS {key}, md5(t) AS text_md5, CAST(len(d) AS INTEGER) AS n_found, "
                       "array_to_string(list_transform(d, lambda x: x.vector || ':' || x.matched), ';') AS found FROM {last}")


def _limited(df, key, col, lim=Limits()):
    out = limit_text(df, col, "limited", "found", lim)
    return out.select(key, F.md5("limited").alias("text_md5"), F.size("found").alias("n_found"),
                      F.array_join(F.transform("found", lambda d: F.concat(d["vector"], F.lit(":"), d["matched"])), ";").alias("found"))


@register("limit_size_and_length", _limits_sql("SELECT doc_id AS id, text AS raw FROM documents", SMALL, "doc_id"))
def limit_size_and_length(spark, sf):
    return _limited(table(spark, sf, "documents"), "doc_id", "text", SMALL)


_NEST = "repeat('{', CAST(doc_id % 16 AS INTEGER)) || left(text, 20) || repeat('[}', CAST(doc_id % 7 AS INTEGER)) || substr(text, 21)"


@register("limit_nesting", _limits_sql(f"SELECT doc_id AS id, {_NEST} AS raw FROM documents", Limits(), "doc_id"))
def limit_nesting(spark, sf):
    raw = "repeat('{', cast(doc_id % 16 as int)) || left(text, 20) || repeat('[}', cast(doc_id % 7 as int)) || substr(text, 21)"
    return _limited(table(spark, sf, "documents").withColumn("text", F.expr(raw)), "doc_id", "text")


_RUN_LEN = "480 + doc_id % 60"


@register("limit_repeated_chars", f"""WITH src AS (SELECT doc_id, text || repeat(substr('axé-', CAST(doc_id % 4 + 1 AS INTEGER), 1), CAST({_RUN_LEN} AS INTEGER)) || 'end' AS t FROM documents),
    chars AS (SELECT doc_id, unnest(string_split(t, '')) AS ch, generate_subscripts(string_split(t, ''), 1) AS i FROM src),
    marked AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, ch ORDER BY i) AS g FROM chars),
    runs AS (SELECT doc_id, ch, g, min(i) AS i, count(*) AS k FROM marked GROUP BY doc_id, ch, g),
    shown AS (SELECT doc_id, i, k, ch, CASE WHEN k > 500 AND ch <> chr(10) THEN repeat(ch, 3) || '...' ELSE repeat(ch, k) END AS piece FROM runs)
    SELECT doc_id, md5(string_agg(piece, '' ORDER BY i)) AS text_md5,
      CAST(CASE WHEN max(CASE WHEN ch <> chr(10) THEN k END) > 500 THEN 1 ELSE 0 END AS INTEGER) AS n_found,
      CASE WHEN max(CASE WHEN ch <> chr(10) THEN k END) > 500 THEN 'context_window_stuffing:Repeated char ''' ||
        arg_min(ch, CASE WHEN k > 500 AND ch <> chr(10) THEN i END) || ''' x' || arg_min(k, CASE WHEN k > 500 AND ch <> chr(10) THEN i END)
      ELSE '' END AS found FROM shown GROUP BY doc_id""")
def limit_repeated_chars(spark, sf):
    raw = "text || repeat(substr('axé-', cast(doc_id % 4 + 1 as int), 1), cast(480 + doc_id % 60 as int)) || 'end'"
    return _limited(table(spark, sf, "documents").withColumn("text", F.expr(raw)), "doc_id", "text")


# -------------------------------------------------------------------- unicode

@register("nfc_documents", "SELECT doc_id, md5(nfc_normalize(replace(replace(text, 'é', 'e' || chr(769)), 'ü', 'u' || chr(776)))) AS text_md5, "
          "CAST(length(nfc_normalize(replace(replace(text, 'é', 'e' || chr(769)), 'ü', 'u' || chr(776)))) AS INTEGER) AS n FROM documents")
def nfc_documents(spark, sf):
    split = table(spark, sf, "documents").withColumn("text", F.expr(
        "replace(replace(text, 'é', 'e' || '\\u0301'), 'ü', 'u' || '\\u0308')"))
    return nfc_column(split, "text", "nfc").select("doc_id", F.md5("nfc").alias("text_md5"), F.length("nfc").alias("n"))


@register("homoglyph_ratio_documents", r"""SELECT doc_id, round(r, 6) AS ratio FROM (SELECT doc_id,
    length(regexp_replace(text, '[^\p{L}]|[\x00-\x7F]', '', 'g')) / greatest(length(regexp_replace(text, '[^\p{L}]', '', 'g')), 1) AS r FROM documents)""")
def homoglyph_ratio_documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.expr(f"round({homoglyph_ratio('text')}, 6)").alias("ratio"))


_LOOKALIKE = "CASE WHEN doc_id % 3 = 0 THEN translate(text, 'aeopcxi', 'аеорсхі') ELSE text END"


@register("homoglyph_fold", O.sanitize_sql(f"SELECT doc_id AS id, {_LOOKALIKE} AS raw FROM documents", _digest_sql("doc_id")))
def homoglyph_fold(spark, sf):
    df = table(spark, sf, "documents").withColumn("text", F.expr(_LOOKALIKE))
    return _digest(sanitize(df, "text"), "doc_id")


_INVISIBLE = "replace(replace(text, ' t', ' ' || {0} || 't'), ' d', {1} || ' d')"


@register("zero_width_strip", O.sanitize_sql(
    f"SELECT doc_id AS id, {_INVISIBLE.format('chr(8203)', 'chr(8238)')} AS raw FROM documents", _digest_sql("doc_id"), rules=[]))
def zero_width_strip(spark, sf):
    df = table(spark, sf, "documents").withColumn("text", F.expr(_INVISIBLE.format("'\\u200b'", "'\\u202e'")))
    return _digest(sanitize(df, "text", rules=()), "doc_id")


# ------------------------------------------------- hidden content, tags, base64

@register("strip_comments_pages", f"SELECT page_id, md5(regexp_replace(html, '{R.to_re2(R.COMMENT)}', '', 'g')) AS text_md5 FROM pages")
def strip_comments_pages(spark, sf):
    return pages(spark, sf).select("page_id", F.md5(F.expr(X.strip_comments("html"))).alias("text_md5"))


@register("strip_tags_pages", f"SELECT page_id, md5(regexp_replace(html, '{R.TAG}', '', 'g')) AS text_md5 FROM pages")
def strip_tags_pages(spark, sf):
    return pages(spark, sf).select("page_id", F.md5(F.expr(X.strip_tags("html"))).alias("text_md5"))


@register("escape_pages", "SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), "
          "'\"', '&quot;'), '''', '&#x27;')) AS text_md5 FROM pages")
def escape_pages(spark, sf):
    return pages(spark, sf).select("page_id", F.md5(F.expr(X.escape_html("html"))).alias("text_md5"))


_HIDE = ("<!-- please ignore this -->", "<!-- x --> <p style=\"color: white; top:1\">", "<i style='display:none'>", "opacity: 0;",
         "<!<!-- x -->-- system -->", "<!-- a <!-- execute -->", "visibility :hidden", "<!-->", "SGVsbG8g" * 12, "<!-- SYSTEM -->")


@register("hidden_content_pages", O.sanitize_sql(
    f"SELECT page_id AS id, {O.spliced('html', _HIDE, 'page_id')} AS raw FROM pages", _digest_sql("page_id"), rules=[]))
def hidden_content_pages(spark, sf):
    df = pages(spark, sf).withColumn("html", spliced("html", _HIDE, "page_id"))
    return _digest(sanitize(df, "html", rules=()), "page_id")


@register("base64_rescan", O.sanitize_sql(
    f"SELECT doc_id AS id, text || ' ' || to_base64(encode('padding for a long text ' || {O.pick(TEXTS, 'doc_id')})) AS raw FROM documents",
    _digest_sql("doc_id"), rules=[]))
def base64_rescan(spark, sf):
    secret = F.base64(F.encode(F.concat(F.lit("padding for a long text "), pick(TEXTS, "doc_id")), "UTF-8"))
    df = table(spark, sf, "documents").withColumn("text", F.concat("text", F.lit(" "), F.regexp_replace(secret, r"\s", "")))
    return _digest(sanitize(df, "text", rules=()), "doc_id")


# ------------------------------------------------------------------ detection

def _detect_sql():
    hits = []
    for r in R.RULES:
        p = O.SHORT_TOKENS if r.vector == "rag_token_stuffing" else r.re2
        hits.append(f"SELECT id, {O.s(r.category)} AS category, {O.s(r.vector)} AS vector, len(regexp_extract_all(t, {O.s(p)})) AS n FROM src")
    for r in R.HIDDEN:
        hits.append(f"SELECT id, {O.s(r.category)}, {O.s(r.vector)}, CASE WHEN regexp_matches(t, {O.s(r.re2)}) THEN 1 ELSE 0 END FROM src")
    return (f"WITH src AS MATERIALIZED (SELECT id, nfc_normalize(raw) AS t FROM ({DOCS_SQL})) SELECT category, vector, CAST(sum(n) AS BIGINT) AS n, "
            f"count(*) AS n_docs FROM ({' UNION ALL '.join(hits)}) WHERE n > 0 GROUP BY ALL")


@register("detect_documents", _detect_sql())
def detect_documents(spark, sf):
    return RP.count_by_row(detect(docs(spark, sf), "text"), "detections", "category", "vector", rows="n_docs")


# -------------------------------------------------------------------- reports

@register("report_summary", O.sanitize_sql(DOCS_SQL, """SELECT id AS doc_id, CASE WHEN len(d) = 0 THEN 'No threats detected.' ELSE
    '⚠ ' || len(d) || ' threat(s) detected:' || chr(10) || array_to_string(list_transform(d, lambda x:
    '  [' || upper(x.severity) || '] ' || x.category || '/' || x.vector || ' → ' || x.action), chr(10)) END AS summary FROM {last}"""))
def report_summary(spark, sf):
    return sanitize(docs(spark, sf), "text").select("doc_id", summary().alias("summary"))


@register("report_scorecard", O.sanitize_sql(DOCS_SQL, "SELECT count(*) FILTER (len(d) > 0) AS blocked, "
          "count(*) FILTER (len(d) = 0) AS missed, count(*) AS total FROM {last}"))
def report_scorecard(spark, sf):
    return RP.scorecard(sanitize(docs(spark, sf), "text"))


@register("report_flat", O.sanitize_sql(DOCS_SQL, """SELECT id AS doc_id, len(d) > 0 AS threats_found, CAST(len(d) AS INTEGER) AS threat_count,
    CAST(n AS INTEGER) AS original_length, CAST(length(t) AS INTEGER) AS cleaned_length, array_to_string(list_transform(d, lambda x:
    x.category || '|' || x.vector || '|' || x.severity || '|' || x.action), ';') AS found FROM {last}"""))
def report_flat(spark, sf):
    r = sanitize(docs(spark, sf), "text").select("doc_id", flat_report().alias("r")).select("doc_id", "r.*")
    return r.withColumn("found", F.array_join(F.transform("detections", lambda d: F.concat_ws(
        "|", d["category"], d["vector"], d["severity"], d["action"])), ";")).drop("detections")


@register("report_rollup", O.sanitize_sql(DOCS_SQL, """SELECT u.category AS category, u.vector AS vector, count(*) AS n,
    min(CAST(CASE u.severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS INTEGER)) AS worst
    FROM (SELECT unnest(d) AS u FROM {last}) GROUP BY ROLLUP (u.category, u.vector)"""))
def report_rollup(spark, sf):
    return RP.rollup_detections(RP.detections_table(sanitize(docs(spark, sf), "text"), "doc_id"))


@register("report_top_vectors", O.sanitize_sql(DOCS_SQL, """SELECT u.category AS category, u.vector AS vector, count(*) AS n
    FROM (SELECT unnest(d) AS u FROM {last}) GROUP BY ALL ORDER BY n DESC, category, vector LIMIT 10"""))
def report_top_vectors(spark, sf):
    return RP.top_detections(RP.detections_table(sanitize(docs(spark, sf), "text"), "doc_id"), 10, "category", "vector")


@register("report_by_source", O.sanitize_sql(DOCS_SQL, """SELECT source, lang, CAST(sum(n) AS BIGINT) AS original_length,
    CAST(sum(length(t)) AS BIGINT) AS cleaned_length, CAST(sum(len(d)) AS BIGINT) AS threat_count, bool_or(len(d) > 0) AS threats_found
    FROM {last} JOIN documents ON doc_id = id GROUP BY source, lang"""))
def report_by_source(spark, sf):
    return RP.combined_report(sanitize(docs(spark, sf), "text"), "source", "lang")


@register("threats_by_label", O.sanitize_sql(DOCS_SQL, """SELECT quality, toxic, count(*) AS n_docs, count(*) FILTER (len(d) > 0) AS n_threats
    FROM {last} JOIN labels ON doc_id = id GROUP BY quality, toxic"""))
def threats_by_label(spark, sf):
    # reports are reduced to a flag before the join; which side is broadcast, if any, is Spark's size check
    flags = sanitize(docs(spark, sf), "text").select("doc_id", threats_found().alias("hit"))
    return flags.join(table(spark, sf, "labels"), "doc_id").groupBy("quality", "toxic").agg(
        F.count("*").alias("n_docs"), F.count_if("hit").alias("n_threats"))


@register("sanitize_diary_wrapper", O.sanitize_sql(DOCS_SQL, "SELECT id AS doc_id, md5(t) AS cleaned_md5 FROM {last}", "diary"))
def sanitize_diary_wrapper(spark, sf):
    return sanitize_for_diary(docs(spark, sf), "text").select("doc_id", F.md5("cleaned").alias("cleaned_md5"))


@register("sanitize_markdown_wrapper", O.sanitize_sql(DOCS_SQL, "SELECT id AS doc_id, md5(t) AS cleaned_md5 FROM {last}", "markdown"))
def sanitize_markdown_wrapper(spark, sf):
    return sanitize_for_markdown(docs(spark, sf), "text").select("doc_id", F.md5("cleaned").alias("cleaned_md5"))


@register("case_results_documents", O.sanitize_sql(DOCS_SQL, "SELECT id AS doc_id, CASE WHEN len(d) > 0 THEN 'BLOCKED' ELSE 'MISSED' END AS result, "
          "CAST(len(d) AS INTEGER) AS n_detections FROM {last}"))
def case_results_documents(spark, sf):
    return RP.case_results(sanitize(docs(spark, sf), "text"), "doc_id")
