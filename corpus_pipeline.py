"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept,
and returns a DataFrame; `run` writes it as Parquet and rereads it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textward.llm import exact, langid, mixing, packing, partenum
from textward.llm.common import held_out, staged

#: least probability of the predicted language; with clean text it is close to 1
LEAST_SCORE = 0.5
#: exponent of tokens in the target weights of sources, languages and topics: close to the given mix
ALPHA = 0.9
#: share of the tokens that mixing is expected to keep, whatever cells there are
KEEP = 0.9


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: `lang` becomes the predicted language; documents without letters or without a clear language go."""
    model = langid.fit(docs.where(~held_out("doc_id")))
    # the row goes along as one value, so that no name of a column is in the way; a filter is not pushed below a generate,
    # so each text is scored once (as a plain column it would be scored for the filter and again for the result)
    known = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                        F.explode(F.array(langid.predict(docs, model))).alias("p"))
    return (known.where((F.col("p.lang_pred") != langid.UNKNOWN) & (F.col("p.score") >= LEAST_SCORE))
            .select(*[(F.col("p.lang_pred") if c == "lang" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns]))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of identical texts the row with the largest doc_id stays."""
    return exact.distinct_texts(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join on shingles of five words at 0.8: of each connected group the smallest doc_id stays."""
    return partenum.representatives(docs)


def weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights: documents are drawn with the probability of their source, language and topic."""
    # the row goes along as one value, so that columns of any name come out as they were
    wide = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), "doc_id", "source", "lang",
                       mixing.topic_of(F.col("text")).alias("topic"), mixing.n_words(F.col("text")).alias("n_tokens"))
    mixed = mixing.mix(wide, ("source", "lang", "topic"), "n_tokens", dict.fromkeys(("source", "lang", "topic"), ALPHA), keep=KEEP)
    return mixed.where("sampled").select("__row.*")


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: one row per piece of a document in a sequence of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language ID", language), ("exact dedup", exact_copies), ("n-gram Jaccard join", near_copies),
          ("mixing sources to target weights", weights), ("packing", sequences)]

#: no SQL for language scores, set joins and packing; tests/llm compares the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
