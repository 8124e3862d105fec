"""A sample of the registered queries against their SQL; ``check_queries.py`` runs them all."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from conftest import SF

TABLES = ("documents", "pages", "conversations", "events", "benchmark", "labels", "orders", "lineitem")
SAMPLE = ("threats_by_vector_pages", "sanitize_documents", "strip_rag_poisoning", "limit_repeated_chars", "homoglyph_fold",
          "hidden_content_pages", "base64_rescan", "sanitize_lines_conversations", "audit_chain_events", "audit_rotate_events",
          "scan_secrets_documents", "stream_threats_per_day", "threats_by_label")


def test_entry_has_rows(spark):
    assert entry_points.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry_points.queries()[name](spark, SF)
    cur = con.execute(entry_points.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    want = sorted(repr(tuple(r[names.index(c)] for c in df.columns)) for r in cur.fetchall())
    assert sorted(repr(tuple(r)) for r in df.collect()) == want
