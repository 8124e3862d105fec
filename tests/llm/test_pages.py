"""WARC archives and line dedup."""

import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from textward.llm import lines, warc


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(2)
    rows = [(i, f"http://h{i % 3}.example.com:80/p\r\n{i}?q=é", "".join(rng.choice("ab<>\r\n漢") for _ in range(rng.choice([0, 10, 3000])))) for i in range(40)]
    rows += [(100 + i, "http://copy.example.com/", "the same\r\n\r\npage") for i in range(9)]
    rows += [(200, None, None), (201, "", ""), (None, "http://x/", "no id"), (None, None, None), (100, "http://copy.example.com/", "the same\r\n\r\npage"),
             (300, "http://big.example.com/", "WARC/1.1\r\n\r\n" * 200_000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS sha1", "1 AS key", "2 AS n").repartition(3)


def test_archives_round_trip(spark, pages, tmp_path):
    path = str(tmp_path / "a")
    warc.write_warc(pages, path)
    back = warc.read_warc(spark, path, verify="true").where("record_type <> 'warcinfo'").collect()
    rows = pages.collect()
    assert len(back) == len(rows)
    keep = {}
    for r in rows:
        body = (r.html or "").encode()
        keep[body] = max(keep.get(body, -1), -1 if r.page_id is None else r.page_id)
    want = {r.page_id: (r.html or "").encode() for r in rows}
    for r in back:
        key = r.record_id.removeprefix("<urn:key:").removesuffix(">")
        key = int(key) if key else None
        if key is None:
            continue
        body = want[key]
        assert r.payload_bytes == len(body) and r.payload_digest == warc.digest_of(body)
        assert (r.record_type == "response") == (keep[body] == key)
        assert r.payload == (body if r.record_type == "response" else None)
        assert r.refers_to == (None if r.record_type == "response" else f"<urn:key:{keep[body]}>")
    files = sorted((tmp_path / "a").glob("*.warc.gz"))
    plain = b"".join(gzip.decompress(f.read_bytes()) for f in files)  # any gzip reader can read the members
    assert plain.count(b"WARC-Type: revisit") == sum(r.record_type == "revisit" for r in back)
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "a.warc").write_bytes(plain)
    again = warc.read_warc(spark, str(tmp_path / "plain"), verify="true").where("record_type <> 'warcinfo'").collect()
    assert sorted((r.record_id, r.payload_bytes, r.payload or b"") for r in again) == sorted((r.record_id, r.payload_bytes, r.payload or b"") for r in back)


def test_small_payloads_are_no_revisits(spark, pages, tmp_path):
    warc.write_warc(pages, str(tmp_path / "a"), min_bytes=100)
    assert warc.read_warc(spark, str(tmp_path / "a"), "record_type string").where("record_type = 'revisit'").count() == 0


def test_predicates_and_columns_are_pushed(spark, pages, tmp_path):
    path = str(tmp_path / "a")
    warc.write_warc(pages, path)
    df = warc.read_warc(spark, path, "record_type string, target_uri string").where((F.col("record_type") == "response") & F.col("target_uri").startswith("http://h1"))
    assert " Filter " not in df._jdf.queryExecution().executedPlan().toString()  # nothing is left to filter after the scan
    assert df.count() == sum(r.page_id is not None and r.page_id < 40 and r.page_id % 3 == 1 for r in pages.collect()) - _repeats(pages)
    inflated = []

    class Watched(warc.WarcReader):
        def fill(self, row, block):
            inflated.append(row["record_type"])
            super().fill(row, block)

    reader = Watched(warc.read_warc(spark, path, "record_type string, payload binary").schema, {"path": path})
    assert list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit")])) == []
    got = [b for p in reader.partitions() for b in reader.read(p)]
    assert sum(len(b) for b in got) == len(inflated) and set(inflated) == {"revisit"}


def _repeats(pages):
    """Rows of host h1 whose payload (here: the empty one) a larger page id has as well."""
    rows = [(r.page_id, r.html or "") for r in pages.collect() if r.page_id is not None]
    return sum(k < 40 and k % 3 == 1 and any(t == u and j > k for j, u in rows) for k, t in rows)


def test_a_wrong_digest_and_a_lost_file_are_found(spark, pages, tmp_path):
    path = tmp_path / "a"
    warc.write_warc(pages.where("page_id = 300").coalesce(1), str(path))
    (f,) = path.glob("*.warc.gz")
    data = gzip.decompress(f.read_bytes()).replace(b"sha1:" + warc.digest_of(b"WARC/1.1\r\n\r\n" * 200_000).encode(), b"sha1:" + b"A" * 32)
    second = data.index(b"WARC/1.1\r\nWARC-Type: response")
    f.write_bytes(gzip.compress(data))
    with pytest.raises(Exception, match="more than one record"):
        warc.read_warc(spark, str(path), "record_id string").collect()
    f.write_bytes(gzip.compress(data[:second]) + gzip.compress(data[second:]))
    with pytest.raises(Exception, match="does not have its digest"):
        warc.read_warc(spark, str(path), "record_id string, payload binary", verify="true").collect()
    f.unlink()
    with pytest.raises(Exception, match="lacks 1 of its files"):
        warc.read_warc(spark, str(path), "record_id string").collect()


def test_base32(spark):
    row = spark.sql("SELECT unhex(sha1('x')) AS d").select(warc.base32(F.col("d")).alias("b")).first()
    assert row.b == warc.digest_of(b"x") and hashlib.sha1(b"x").digest() == bytes(spark.sql("SELECT unhex(sha1('x')) AS d").first().d)


# ------------------------------------------------------------------ op 4

def test_lines_above_the_ratio_go_on_their_host_only(spark):
    page = lambda i, host, *text: (i, f"https://u@{host}:8080/{i}", "".join(f"<p>{t}</p>" for t in text))
    rows = [page(i, "A.com", "menu", f"own {i}", "menu", "half" if i < 2 else "rest") for i in range(4)] + [page(9, "b.com", "menu", "x"), page(10, "b.com", "menu", "y")]
    rows += [(20, None, "menu"), (21, "no url", None), (22, None, "<script>menu</script><!-- menu -->\n &nbsp; \n"), (23, "", "menu"), (23, "", "menu")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'h' AS host", "0 AS lines", "1 AS n_lines")
    out = lines.dedup_lines(df, lines.host_of(F.col("url")), lines.html_lines(F.col("html")))
    got = {(r.page_id, r.host, r.n_lines, r.n_dropped, tuple(r.kept_lines)) for r in out.collect()}
    assert {(i, "a.com", 4, 2, (f"own {i}", "half" if i < 2 else "rest")) for i in range(4)} <= got  # half the pages is not more than half
    assert {(9, "b.com", 2, 1, ("x",)), (20, "", 1, 1, ()), (21, "", 0, 0, ()), (22, "", 1, 0, ("&nbsp;",)), (23, "", 1, 1, ())} <= got
    assert out.count() == len(rows)
    spared = lines.dedup_lines(df, lines.host_of(F.col("url")), lines.html_lines(F.col("html")), min_pages=3)
    assert {(9, "b.com", 0), (20, "", 1)} <= {(r.page_id, r.host, r.n_dropped) for r in spared.collect()}
    assert lines.dedup_lines(df.limit(0), lines.host_of(F.col("url")), lines.html_lines(F.col("html"))).count() == 0
