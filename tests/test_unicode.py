import re
import unicodedata

from textward.functions.unicode import STABLE, nfc_column
from textward.operators.sanitize import sanitize


def test_stable_ranges_never_change_under_nfc():
    second = set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3))
    for cp in range(0x110000):
        parts = unicodedata.decomposition(chr(cp)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            second.add(int(parts[1], 16))
    for a, b in re.findall(r"\\x\{(\w+)\}-\\x\{(\w+)\}", STABLE):
        for cp in range(int(a, 16), int(b, 16) + 1):
            c = chr(cp)
            assert not unicodedata.combining(c) and unicodedata.normalize("NFC", c) == c and cp not in second


def test_nfc_equals_python(spark):
    texts = ["plain", "é", "e\u0301", "\u1112\u1161\u11ab", "Å\u212b", "ﬁ", "\u0958", "a\u0301\u0323", "中文", None, "привет", "\u0439\u0306"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in nfc_column(df, "t", "n").collect():
        assert r.n == (None if r.t is None else unicodedata.normalize("NFC", r.t))


def test_homoglyphs_become_ascii(spark):
    text = "раssword ﬁne café"
    row = sanitize(spark.createDataFrame([("рауmеnt",), ("crème brûlée",)], "t string"), "t").collect()
    assert row[0].cleaned == "mnt" and row[0].report.detections[0].matched == "Homoglyph ratio: 57.1%"
    assert row[1].cleaned == "crème brûlée"
    assert unicodedata.normalize("NFKD", text)
