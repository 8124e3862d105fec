"""Mixing sources to target weights by iterative proportional fitting.

Documents are summed to cells (source, language, topic).  Cell weights are
raked: scaled to meet the targets of one dimension after the other, again and
again.  A document is then drawn with its cell's probability, by a hash of its
id, so that a draw can be repeated.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, missing_columns


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def topic_of(text: Column) -> Column:
    """A coarse topic by form: table, markup or noise, shouting, prose; NULL text is prose."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(t), F.lit(1))
    share = lambda pattern: F.regexp_count(t, F.lit(pattern)) / n
    return (F.when(share(r"[|]") > 0.01, "table").when(share(r"[#$%&*]") > 0.05, "noise")
            .when(share(r"[A-Z]") > 0.3, "shouting").otherwise("prose"))



def cells(docs: DataFrame, dims: Sequence[str], tokens: str) -> DataFrame:
    """Tokens of each combination; partial sums keep a hot source from being shuffled row by row.

    Sums are doubles of whole numbers, exact up to 2**53.
    """
    return docs.groupBy(*dims).agg(F.sum(tokens).cast("double").alias("tokens")).where(F.col("tokens") > 0)


def rake(cell: DataFrame, dims: Sequence[str], targets: Mapping[str, Mapping | float], rounds: int) -> DataFrame:
    """Adds `weight` to the cells: `rounds` passes over `dims`, each meeting the targets of one dimension.

    `targets[dim]` is a mapping of category to share (categories that it does
    not name get none, NULL is named None) or an exponent for tokens.  Shares
    are scaled to a sum of one over the categories that exist.  The sums are
    windows: a category of any name, NULL included, is one group.
    """
    out = cell.withColumn("weight", F.col("tokens"))
    everything = Window.partitionBy(F.lit(0))
    for dim in dims:
        per = Window.partitionBy(dim)
        want = targets[dim]
        if isinstance(want, Mapping):
            share = F.lit(0.0)
            for name, value in want.items():
                share = F.when(F.col(dim).eqNullSafe(F.lit(name)), F.lit(float(value))).otherwise(share)
        else:
            share = F.pow(F.sum("tokens").over(per), F.lit(float(want)))
        # each category counts once in the total: its share is spread over its cells
        out = out.withColumn("__s", share).withColumn("__one", F.col("__s") / F.count("*").over(per))
        out = out.withColumn(f"__target_{dim}", F.col("__s") / F.sum("__one").over(everything)).drop("__s", "__one")
    for _ in range(rounds):
        for dim in dims:
            now = F.sum("weight").over(Window.partitionBy(dim))
            out = out.withColumn("weight", F.when(now > 0, F.col("weight") * F.col(f"__target_{dim}") / now).otherwise(0.0))
    return out.drop(*[f"__target_{d}" for d in dims])


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) from the MD5 of the seed and the key as text; NULL counts as empty text."""
    word = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(word.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def scaled(cell: DataFrame, dims: Sequence[str], keep: float) -> DataFrame:
    """Adds `__c` to raked cells, the factor with sum(min(tokens, c * weight)) = keep * sum(tokens).

    The sum is the least of T + c * W over all cuts of the cells in order of
    weight / tokens, with T the tokens above the cut and W the weight below it,
    so c is the largest of (budget - T) / W.
    """
    falling = Window.partitionBy(F.lit(0)).orderBy((F.col("weight") / F.col("tokens")).desc(), *dims)
    everything = Window.partitionBy(F.lit(0))
    above = F.coalesce(F.sum("tokens").over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    below = F.sum("weight").over(falling.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    wanted = F.sum("tokens").over(everything) * F.lit(float(keep))
    return cell.withColumn("__c", F.when(below > 0, (wanted - above) / below)).withColumn("__c", F.max("__c").over(everything))


def mix(docs: DataFrame, dims: Sequence[str], tokens: str, targets: Mapping[str, Mapping | float], key: str = "doc_id",
        rounds: int = 8, seed: int = 7, keep: float | None = None) -> DataFrame:
    """Adds `probability` and `sampled` to `docs`; columns of these names are replaced.

    Probabilities are in proportion to weight / tokens of the cell.  Without
    `keep` they are scaled so that the largest is 1: no document is wanted more
    than once, and expected tokens of each category follow the targets; the
    rarest cell then sets how much of all others stays.  With `keep` that share
    of all tokens is expected to stay: cells that would be wanted more than once
    stay whole, and the others are scaled to fill the rest.  Documents without tokens have
    probability 0, hence go.  Rows with one key (repeats) share their fate.  The
    cell table is as long as there are combinations and is joined null-safely;
    Spark broadcasts it only below its size limit and splits hot cells otherwise.
    """
    missing_columns(docs, *dims, tokens, key)
    fitted = rake(cells(docs, dims, tokens), dims, targets, rounds)
    if keep is None:
        best = F.max(F.col("weight") / F.col("tokens")).over(Window.partitionBy(F.lit(0)))
        fitted = fitted.withColumn("__p", F.round(F.col("weight") / F.col("tokens") / best, 9))
    else:
        wanted = F.col("__c") * F.col("weight") / F.col("tokens")
        fitted = scaled(fitted, dims, keep).withColumn("__p", F.round(F.least(F.lit(1.0), wanted), 9))
    fitted = fitted.select(*[F.col(d).alias(f"__cell_{d}") for d in dims], "__p")
    on = None
    for d in dims:
        same = F.col(d).eqNullSafe(F.col(f"__cell_{d}"))
        on = same if on is None else on & same
    p = F.when(F.coalesce(F.col(tokens), F.lit(0)) > 0, F.coalesce(F.col("__p"), F.lit(0.0))).otherwise(0.0)
    return (docs.drop("probability", "sampled").join(fitted, on, "left").withColumn("probability", p)
            .withColumn("sampled", uniform(F.col(key), seed) < F.col("probability"))
            .drop("__p", *[f"__cell_{d}" for d in dims]))


def mix_sql(docs: str = "documents", alpha: float = 0.9, rounds: int = 8, seed: int = 7) -> str:
    """The registered query in DuckDB's words: the same rounds, one common table expression each."""
    dims = ("source", "lang", "topic")
    parts = [rf"""docs AS (
  SELECT *, CASE WHEN bars / n > 0.01 THEN 'table' WHEN marks / n > 0.05 THEN 'noise' WHEN caps / n > 0.3 THEN 'shouting' ELSE 'prose' END AS topic
  FROM (SELECT doc_id, source, lang, greatest(length(t), 1)::double AS n, length(t) - length(replace(t, '|', '')) AS bars,
      length(t) - length(regexp_replace(t, '[#$%&*]', '', 'g')) AS marks, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS caps,
      len(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))::bigint AS n_tokens
    FROM (SELECT *, coalesce(text, '') AS t FROM {docs})))""",
             "c0 AS (SELECT source, lang, topic, sum(n_tokens)::double AS tokens, sum(n_tokens)::double AS weight FROM docs "
             "GROUP BY ALL HAVING sum(n_tokens) > 0)"]
    parts += [f"t_{d} AS (SELECT {d}, s / sum(s) OVER () AS target FROM (SELECT {d}, pow(sum(tokens), {alpha}) AS s FROM c0 GROUP BY {d}))"
              for d in dims]
    k = 0
    for _ in range(rounds):
        for d in dims:
            parts.append(f"c{k + 1} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, tokens, weight * target / sum(weight) OVER (PARTITION BY c.{d}) AS weight "
                         f"FROM c{k} c JOIN t_{d} t ON c.{d} IS NOT DISTINCT FROM t.{d})")
            k += 1
    parts.append(f"cell AS (SELECT source, lang, topic, round(weight / tokens / max(weight / tokens) OVER (), 9) AS p FROM c{k})")
    return "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, d.source, d.lang, d.topic, n_tokens, coalesce(CASE WHEN n_tokens > 0 THEN p END, 0) AS probability,
  ('0x' || substr(md5('{seed}:' || coalesce(doc_id::varchar, '')), 1, 13))::bigint / 4503599627370496.0
    < coalesce(CASE WHEN n_tokens > 0 THEN p END, 0) AS sampled
FROM docs d LEFT JOIN cell c ON d.source IS NOT DISTINCT FROM c.source AND d.lang IS NOT DISTINCT FROM c.lang AND d.topic IS NOT DISTINCT FROM c.topic"""
