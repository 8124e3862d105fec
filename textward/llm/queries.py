"""Registered queries of this folder, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_path
from . import decontam, exact, langid, lines, merkle, mixing, packing, partenum, sketch, suffixes, tokencount, warc, whitening
from .common import held_out, table

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out("doc_id"))
    model = langid.fit(docs.where(~F.col("held_out")))
    return docs.select("doc_id", "held_out", langid.predict(docs, model).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")


@query("op4_line_dedup", lines.PAGES_SQL)
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    out = lines.dedup_lines(pages, lines.host_of(F.col("url")), lines.html_lines(F.col("html")))
    return out.select("page_id", "host", "n_lines", "n_dropped", F.array_join("kept_lines", "\n").alias("text"))


@query("op10_source_mixing", mixing.mix_sql())
def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang", mixing.topic_of(F.col("text")).alias("topic"), mixing.n_words(F.col("text")).alias("n_tokens"))
    return mixing.mix(docs, ("source", "lang", "topic"), "n_tokens", {"source": 0.9, "lang": 0.9, "topic": 0.9})


@query("op3_exact_dedup", """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""")
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact.dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).rows
    return rows.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@query("op6_packing")
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op2_fingerprints")
def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.fingerprints(table(spark, sf_dir, "documents"))


@query("op9_token_counts")
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each document, before and after three edits to it: a cut at a quarter, an insertion in the middle, a change near the end."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.length(F.coalesce("text", F.lit("")))
    change = lambda at, removed, new: F.struct(F.floor(n * at).alias("start"), F.lit(removed).cast("long").alias("removed"), new.alias("inserted"))
    edits = F.array(change(0.25, 12, F.lit("")), change(0.5, 0, F.concat(F.lit(" edit "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))),
                    change(0.9, 7, F.lit("\nchanged, ")))
    docs = docs.withColumn("edits", edits)
    counted = tokencount.edits_counted(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, "edits")
    return docs.select("doc_id", counted.alias("c")).select("doc_id", "c.n_tokens", "c.n_tokens_edited", "c.chars_encoded",
                                                            F.size("c.tree.chars").alias("n_leaves"))


@query("op1_warc", """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
g AS (SELECT page_id, body, max(page_id) OVER (PARTITION BY body) AS keep FROM p),
h AS (SELECT *, unhex(sha1(body)) AS d FROM g)
SELECT page_id, strlen(body)::bigint AS payload_bytes,
  (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', bits + 1, 1), '' ORDER BY k) FROM (
    SELECT k, (('0x' || substr(sha1(body), 10 * (k // 8) + 1, 10))::bigint >> (35 - 5 * (k % 8)))::bigint & 31 AS bits
    FROM range(32) r(k))) AS payload_digest,
  CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> keep THEN keep END AS refers_to
FROM h""")
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    back = warc.read_warc(spark, path, "record_id string, record_type string, payload_digest string, payload_bytes long, refers_to string", verify="true")
    return back.where(F.col("record_type").isin("response", "revisit")).select(
        warc.key_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        warc.key_of(F.col("refers_to")).alias("refers_to"))


@query("op5_ngram_jaccard")
def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return partenum.joined(docs, measure=partenum.Measure(words=3, num=90, den=100, n2=2)).withColumnRenamed("id", "doc_id")


@query("op8_suffix_dedup")
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffixes.dedup_strings(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op11_merkle_manifest", merkle.MANIFEST_SQL)
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    # as decimals, since one more than the largest long is none
    n_chars = F.col("n_chars").cast("decimal(20,0)") + F.when(tampered, 1).otherwise(0)
    out = merkle.manifest(docs, received={"n_chars": n_chars.cast("decimal(20,0)")})
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@query("op12_decontamination", decontam.SCAN_SQL)
def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
