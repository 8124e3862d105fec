"""Merkle manifest, decontamination and whitening against brute force, with NULLs, ties, repeats, long texts and empty tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from textward.llm import decontam, merkle, whitening

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# ------------------------------------------------------------------ op 11

def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def encoded(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    levels = [nodes]
    while len(nodes) > 1:
        nodes = [H(*nodes[i:i + 2]) for i in range(0, len(nodes), 2)]
        levels.append(nodes)
    return levels


def siblings(levels, i):
    out = []
    for nodes in levels[:-1]:
        out.append((i % 2 == 1, nodes[i ^ 1]) if i ^ 1 < len(nodes) else None)
        i //= 2
    return out


def manifest_of(rows):
    """Expected rows of (doc_id, source, lang, n_chars, text) rows; n_chars arrives one larger where 7 divides the id's CRC."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, H(*map(encoded, r))))
    trees = [tree([H(*map(encoded, r)) for r in groups[g]]) for g in names]
    top = tree([t[-1][0] for t in trees])
    out = []
    for k, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            proof, came = siblings(trees[k], i) + siblings(top, k), list(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None:
                came[3] += 1
            acc = H(*map(encoded, came))
            for s in proof:
                acc = H(acc) if s is None else H(s[1], acc) if s[0] else H(acc, s[1])
            root = top[-1][0]
            out.append((r[0], trees[k][0][i], trees[k][-1][0], root, H(*[s[1] for s in proof if s]), acc, acc == root))
    return sorted(out, key=str)


def manifest_rows(spark, rows):
    docs = spark.createDataFrame([(r[0], r[4], r[2], r[1], r[3], "x", 1, "y") for r in rows], DOCS + ", id string, level int, proof string")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    came = (F.col("n_chars").cast("decimal(20,0)") + F.when(tampered, 1).otherwise(0)).cast("decimal(20,0)")
    got = merkle.manifest(docs, received={"n_chars": came}).collect()
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got), key=str)


@pytest.mark.parametrize("sizes", [(1,), (1, 1), (2, 1), (37, 5, 1, 1, 16), (0, 300, 129)])
def test_manifest_equals_brute_force(spark, sizes):
    rng = random.Random(len(sizes))
    names = [None, "", "de", "en", "ß"]
    rows = [(rng.randrange(10 ** 6), rng.choice(["a", "ü", None]), names[g], rng.choice([0, 5, None, 2 ** 63 - 1]), rng.choice(["", None, "x" * 5000, "é1"]))
            for g, n in enumerate(sizes) for _ in range(n)]
    rows += rows[:3] + [(None, None, None, None, None)] * (len(sizes) > 3)
    assert manifest_rows(spark, rows) == manifest_of(rows)


def test_manifest_without_broadcasts_and_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(merkle, "LEVELS", 2)
    rows = [(i, "s", "en" if i % 3 else "de", i, f"t{i}") for i in range(200)]
    assert manifest_rows(spark, rows) == manifest_of(rows)


def test_manifest_of_nothing(spark):
    out = merkle.manifest(spark.createDataFrame([], DOCS))
    assert out.count() == 0 and out.columns == ["doc_id", "leaf", "subroot", "root", "proof", "proof_sha256", "folded_root", "verified"]


# ------------------------------------------------------------------ op 12

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def scan_of(docs, items, n=10):
    found = {}
    for item, text in items:
        w = words_of(text)
        k = min(n, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            found.setdefault(tuple(w[i:i + k]), set()).add(item)
    lengths, out = {len(k) for k in found}, []
    for key, text in docs:
        w, hit, ids = words_of(text), set(), set()
        for k in lengths:
            for i in range(len(w) - k + 1):
                if tuple(w[i:i + k]) in found:
                    hit |= set(range(i, i + k))
                    ids |= found[tuple(w[i:i + k])]
        out.append((key, len(w), len(hit), sorted(str(i) for i in ids if i is not None)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcß漢X7") for _ in range(rng.randint(1, 4))) for _ in range(40)]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "--"]) for _ in range(n))
    items = [(i, text(rng.choice([3, 9, 10, 11, 40]))) for i in range(30)] + [(30, None), (31, ""), (32, "?!"), (None, text(20)), (3, text(15))]
    items += [(33, items[4][1]), (34, "the THE The")]
    docs = [(i, text(rng.choice([0, 1, 9, 10, 60, 400])) + rng.choice(items)[1:][0].__str__().upper() + text(5)) for i in range(60)]
    docs += [(61, None), (62, ""), (63, "?"), (64, text(30_000) + items[0][1]), (65, "y" * 700_000 + " " + items[3][1]), (None, items[0][1]), docs[0]]
    return docs, items


@pytest.mark.parametrize("slice_bytes", [64 << 20, 4000])
def test_scan_equals_brute_force(spark, texts, slice_bytes):
    docs, items = texts
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = spark.createDataFrame([(*r, "a", 1) for r in docs], "doc_id long, text string, items string, n_hit int")
    got = decontam.scan(table, bench, slice_bytes=slice_bytes).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got), key=str) == scan_of(docs, items)


def test_windows_over_piece_borders(spark, texts, monkeypatch):
    monkeypatch.setattr(decontam, "PIECE", 50)
    docs, items = texts
    windows = decontam.packed(sorted((h, w, str(i)) for i, t in items if i is not None and words_of(t)
                                     for h, w in _windows_of(t)), tuple(range(1, 11)))
    filled = np.ones(1 << decontam.BITS, bool)
    want = {(k, t): row for (k, t), row in zip(docs, [scan_of([d], [i for i in items if i[0] is not None])[0] for d in docs], strict=True)}
    for key, text in docs[:30]:
        n, spans, ids = decontam.scan_text(np.frombuffer(text.encode(), np.uint8), windows, filled)
        assert (key, n, sum(s["words"] for s in spans), ids) == want[key, text]


def _windows_of(text):
    words = decontam.Words(np.frombuffer(text.encode(), np.uint8))
    k = min(10, len(words.starts))
    return [(int(h), words.window(first + i, k)) for _, first, found in words.hashes((k,)) for i, h in enumerate(found)]


def test_spans_and_documents_are_removed(spark):
    item = "one two three four five six seven eight nine ten eleven"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"Früher. {item.upper()}, später", "k"), (2, "clean text", "k"), (3, None, "k"), (4, item, None)],
                                 "doc_id long, text string, row string")
    cut = decontam.decontaminate(docs, bench)
    assert cut.columns == docs.columns
    assert {tuple(r) for r in cut.collect()} == {(1, "Früher.  , später", "k"), (2, "clean text", "k"), (3, None, "k"), (4, " ", None)}
    assert {tuple(r) for r in decontam.decontaminate(docs, bench, whole=True).collect()} == {(2, "clean text", "k"), (3, None, "k")}
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.scan(docs, none).agg(F.sum("n_hit")).first()[0] == 0
    assert decontam.scan(docs.limit(0), bench).count() == 0


# ------------------------------------------------------------------ op 13

def matrix_of(values, d, seed=3):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    full = np.zeros(d)
    full[:len(values)] = values
    v = (q * full) @ q.T
    return (v + v.T) / 2


@pytest.mark.parametrize("values,d", [([9, 8, 7, 6, 5, 4, 3, 2, 2, 2, 1], 30), ([5.0] * 12, 12), ([9, 4, 1e-3], 20), ([3.0], 1), ([], 4),
                                      (list(10.0 ** np.arange(6, -6, -1)), 20), ([5 + 1e-7 * i for i in range(12)] + [1], 40), (list(np.linspace(5, 4.9, 60)), 80)])
def test_feast_equals_eigh(spark, values, d):
    v = matrix_of(values, d)
    found, vectors = whitening.feast(spark, v, 8)
    want = np.linalg.eigvalsh(v)[::-1][:min(8, len(values))]
    assert len(found) == len(want)
    if len(want):
        assert np.abs(found - want).max() <= 1e-13 * want[0] * d
        assert np.abs(v @ vectors - vectors * found).max() <= 1e-12 * want[0]
        assert np.abs(vectors.T @ vectors - np.eye(len(found))).max() < 1e-12


def test_inertia_counts(spark):
    v = matrix_of([9, 4, 4, 2, 1], 12)
    t = whitening.tridiagonal(v)
    assert [whitening.above(t, s) for s in (10, 5, 3, 1.5, 0.5, -1)] == [0, 1, 3, 4, 5, 12]


def test_whitened_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 12)) * np.linspace(2, 0.1, 12)
    rows = [(i, [float(c) for c in r], "x", 1.0) for i, r in enumerate(x)]
    rows += [rows[0], (None, rows[1][1], None, None), (400, None, "", 0.0), (401, [None] + rows[0][1][1:], "", 0.0), (402, [float("nan")] + rows[0][1][1:], "", 0.0),
             (403, [float("inf")] + rows[0][1][1:], "", 0.0), (404, [1.0], "", 0.0), (405, [], "", 0.0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, whitened string, n double")
    got = whitening.whiten(df).collect()
    kept = [r for r in rows if r[1] is not None and len(r[1]) == 12 and all(c is not None and np.isfinite(c) for c in r[1])]
    y = np.floor(1024 * np.array([r[1] for r in kept])).astype(np.int64) + 100000
    n, sums = len(y), y.sum(0)
    centred = y - sums / n
    v = centred.T @ centred / n
    values, vectors = (a[..., ::-1] for a in np.linalg.eigh(v))
    assert len(got) == 8 * n and {r.n for r in got} == {n}
    white = centred @ vectors / np.sqrt(values)
    deviation = {(r[0], tuple(r[1])): int(d) for r, d in zip(kept, ((n * y - sums) ** 2).sum(1), strict=True)}
    assert sorted(r.deviation for r in got if r.component == 1) == sorted(deviation[r[0], tuple(r[1])] for r in kept)
    for c in range(8):
        have = np.sort(np.array([r.whitened for r in got if r.component == c + 1]))
        want = np.sort(white[:, c])
        assert min(np.abs(have - want).max(), np.abs(have + want[::-1]).max()) < 1e-9
    assert max(abs(r.explained - values[r.component - 1] / np.trace(v)) for r in got) < 1e-12
    assert {r.identity_error for r in got}.pop() < 1e-10


def test_deviations_are_exact_beyond_64_bits(spark):
    x = np.array([[0, 1 << 40], [5, 7]])
    basis = whitening.Basis(3, [1, 2], np.zeros(0), np.zeros((2, 0)), 0.0)
    assert whitening.deviations(x, basis) == [None, 14 ** 2 + 19 ** 2]


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 4, [(1, None), (2, [])], [(1, []), (2, [])]])
def test_nothing_to_whiten(spark, rows):
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and out.count() == 0


# ------------------------------------------------------------------ op 5, before full sets meet

def test_packed_signatures_come_back():
    from textward.llm import partenum
    rng = np.random.default_rng(0)
    for n in (1, 2, 5000):
        values, ids = rng.integers(0, 1 << 32, n).astype(np.uint32), rng.integers(-5, 1 << 60, n)
        got = partenum.unpack(partenum.pack(values, ids))
        assert sorted(zip(*got, strict=True)) == sorted(zip(values, ids, strict=True))


@pytest.mark.parametrize("held", [1 << 24, 10])
def test_repeated_signatures(spark, monkeypatch, held):
    from textward.llm import partenum
    monkeypatch.setattr(partenum, "HELD", held)
    rng = random.Random(4)
    rows = [(i, [rng.randrange(-2 ** 63, 2 ** 63) for _ in range(20)] + ([7, -7] if i % 2 else [])) for i in range(50)] + [(99, [])]
    got = partenum.repeated(spark.createDataFrame(rows, "id long, sigs array<long>")).collect()
    counts = {}
    for r in got:
        counts.setdefault(r.sig, []).append(r.id)
    assert sum(len(x) == 25 and sorted(x) == list(range(1, 50, 2)) for x in counts.values()) == 2
    assert held == 10 or len(counts) == 2


def test_sketches_rule_out_no_linked_sets():
    from textward.llm import partenum
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 60, 900):
        for k in {0, 1, n // 5, n}:
            a = rng.integers(0, 1 << 63, n).astype(np.uint64)
            b = np.concatenate((a[k:], rng.integers(0, 1 << 63, rng.integers(0, k + 1)).astype(np.uint64)))
            apart = len(np.setxor1d(a, b))
            assert partenum.differing_cells(partenum.sketch(a), partenum.sketch(b)) <= apart


# ------------------------------------------------------------------ op 2, fingerprints alone

def test_fingerprints_subtract_without_their_texts():
    from textward.llm import sketch
    a, b = "one\ntwo\nthree\nfour", "one\ntwo\nother\nfour\nfive"
    prints = sketch.encoded(sketch.sketches([sketch.digests(a), sketch.digests(b)]))
    only_a, only_b = sketch.recovered(*prints)
    assert set(only_a) == set(sketch.digests("three")) and set(only_b) == set(sketch.digests("other\nfive"))
    many = sketch.encoded(sketch.sketches([sketch.digests("\n".join(f"line {i}" for i in range(200)))]))[0]
    assert sketch.recovered(prints[0], many) is None
    assert [len(x) for x in sketch.recovered(prints[0], prints[0])] == [0, 0]


# ------------------------------------------------------------------ op 7, brute force

def brute_force_language(learned, text, longest=6, penalty=7.0):
    """The method written out: per word the penalties of the word, or the mean of those of its longest known n-grams."""
    counts, totals = learned
    langs = sorted(counts)
    letters = re.findall(r"[^\W\d_]{1,40}", text.lower()) if text else []
    if not any(c.isalpha() for w in letters for c in w) or not langs:
        return "und", 0.0
    cost = lambda lang, n, g: min(penalty, -np.log10(counts[lang][n][g] / totals[lang][n])) if counts[lang][n][g] else penalty
    total = np.zeros(len(langs))
    for w in letters:
        if any(counts[lang][0][w] for lang in langs):
            total += [cost(lang, 0, w) for lang in langs]
            continue
        for n in range(min(longest, len(w) + 2), 0, -1):
            padded = f" {w} " if n > 1 else w
            known = [g for g in (padded[i:i + n] for i in range(len(padded) - n + 1)) if any(counts[lang][n][g] for lang in langs)]
            if known:
                total += np.mean([[cost(lang, n, g) for lang in langs] for g in known], axis=0)
                break
    total /= len(letters)
    best = int(np.argmin(np.round(total, 5)))
    return langs[best], float(1 / (10.0 ** (total[best] - total)).sum())


def test_language_equals_brute_force(spark):
    from collections import Counter

    from textward.llm import langid
    from textward.llm.common import held_out
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("h", held_out("doc_id"))
    rows = docs.select("doc_id", "text", "lang", "h").collect()
    counts = {r.lang: [Counter() for _ in range(7)] for r in rows if not r.h and r.lang is not None and r.text is not None}
    for r in rows:
        if not r.h and r.lang is not None and r.text is not None:
            for w in langid.words_of(r.text):
                counts[r.lang][0][w] += 1
                for n in range(1, 7):
                    padded = f" {w} " if n > 1 else w
                    for i in range(len(padded) - n + 1):
                        counts[r.lang][n][padded[i:i + n]] += 1
    totals = {lang: [sum(c.values()) for c in per] for lang, per in counts.items()}
    extra = [(10 ** 6 + i, t, None, True) for i, t in enumerate([None, "", "12 3", "qqxzj", "Straßenbahnhaltestelle überqueren", "²³", "a" * 500])]
    some = [r for r in rows if r.text is None or len(r.text) < 20_000]
    got = {r.doc_id: r.p for r in spark.createDataFrame([(r.doc_id, r.text) for r in some] + [e[:2] for e in extra], "doc_id long, text string").select(
        "doc_id", langid.predict(docs.select("doc_id", "text"), langid.fit(docs.where("NOT h"))).alias("p")).collect()}
    for key, text in [(r.doc_id, r.text) for r in some] + [e[:2] for e in extra]:
        want = brute_force_language((counts, totals), text)
        assert got[key].lang_pred == want[0] and abs(got[key].score - want[1]) < 1e-3, key


def test_many_languages_need_no_long_condition(spark):
    from textward.llm import langid
    docs = spark.range(3000).selectExpr("id as doc_id", "concat('word', id % 1500) as text", "concat('l', id % 1500) as lang")
    model = langid.fit(docs)
    assert len(model.langs) == 1500


# ------------------------------------------------------------------ names that clash

def test_clashing_names_stay(spark):
    import corpus_pipeline
    from textward.llm import exact, lines, partenum
    names = ["__file", "__at", "_metadata", "__gone", "row", "p", "__p", "id", "digest", "file"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 40").selectExpr("*", *[f"concat('{n}', doc_id) AS `{n}`" for n in names])
    whole = {r.doc_id: r for r in docs.collect()}
    for out in (exact.distinct_texts(docs), partenum.representatives(docs), corpus_pipeline.language(spark, docs, SF)):
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[n] == f"{n}{r.doc_id}" and r.text == whole[r.doc_id].text for r in rows for n in names)
    pages = spark.createDataFrame([(1, "http://a/x", "<p>one</p><p>two</p>", "k", "l"), (2, "http://a/y", "<p>one</p><p>three</p>", "m", "n")],
                                  "page_id long, url string, html string, __tw_host string, __tw_drop string")
    got = lines.dedup_lines(pages, lines.host_of(F.col("url")), lines.html_lines(F.col("html"))).collect()
    assert {(r.page_id, tuple(r.kept_lines), r["__tw_host"], r["__tw_drop"]) for r in got} == {(1, ("two",), "k", "l"), (2, ("three",), "m", "n")}
