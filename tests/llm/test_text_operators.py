"""Operators on documents against brute force, with NULLs, empty and long texts, ties, repeats and empty tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from textward.llm import components, exact, langid, mixing, packing, partenum, shingles, sketch, suffixes, tokencount
from textward.llm.wordids import WordIds

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


def corpus() -> list[tuple[int | None, str | None]]:
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeéß漢") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, base = text(40), text(150).split()
    docs = [text(rng.choice([1, 2, 5, 30, 120])) for _ in range(40)] + [passage + "\n" + text(20) for _ in range(6)]
    for _ in range(25):  # near copies: linked with the base, seldom with each other
        near = list(base)
        for _ in range(rng.randint(1, 4)):
            near[rng.randrange(len(near))] = rng.choice(vocabulary) + "x"
        docs.append(" ".join(near))
    docs += [" ".join(base)] * 4 + ["", None, "   \n\t", "abc", "ABC abc", "x" * 5000, "ab" * 3000, text(4000), "123 456 !!"]
    rows = [(i, t) for i, t in enumerate(docs)]
    rng.shuffle(rows)
    return rows + [rows[3], rows[3], (None, "no id here"), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents")
    # columns whose names operators use themselves
    df = spark.createDataFrame(corpus(), "doc_id long, text string").selectExpr("*", "'x' AS id", "1L AS n", "'y' AS digest", "'z' AS part", "2 AS tail")
    df.repartition(5).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


# ------------------------------------------------------------------ op 2

def test_sketch_recovers_what_differs():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 30, 400):
        common = rng.integers(0, 1 << 63, 50).astype(np.uint64)
        a, b = (np.concatenate((common, rng.integers(0, 1 << 63, n).astype(np.uint64))) for _ in range(2))
        (only_a, only_b, cells), = sketch.differences([a], [b])
        assert set(only_a) == set(a) - set(b) and set(only_b) == set(b) - set(a)
        assert cells == sketch.CELLS if n < 2 else cells >= sketch.CELLS


def test_fingerprints_equal_brute_force(docs):
    rows = docs.select("doc_id", "text").collect()
    order = sorted(((r.doc_id, r.text or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = Counter()
    for i, (key, text) in enumerate(order):
        following = order[(i + 1) % len(order)][1]
        n = len(text) // 2
        changed = text[:len(text) - n] + following[:n]
        a, b, c = (Counter(sketch.paragraphs(t)) for t in (text, changed, following))
        near = lambda x, y: round(sum((x & y).values()) / sum((x | y).values()), 12) if x or y else 1.0
        want[key, len(text), hashlib.sha256(changed.encode()).hexdigest(), near(a, b), near(a, c)] += 1
    got = sketch.fingerprints(docs, partitions=4).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 12), round(r.near_next, 12)) for r in got) == want
    text_of = defaultdict(set)
    for r in got:
        text_of[r.fingerprint].add(r.doc_id)
    same = [r.doc_id for r in rows if r.text == next(x.text for x in rows if x.doc_id == 71)]
    assert any(set(same) <= ids for ids in text_of.values())


# ------------------------------------------------------------------ op 3

def brute_exact(rows):
    groups = defaultdict(list)
    for key, text in rows:
        groups[text or ""].append(key)
    keep = {t: max((k for k in keys if k is not None), default=None) for t, keys in groups.items()}
    return Counter((k, keep[t or ""], len(groups[t or ""])) for k, t in rows), len(groups)


@pytest.mark.parametrize("digest", [exact.sha256, lambda t: F.substring(exact.sha256(t), 1, 1), lambda t: F.unhex(F.lit("00"))])
def test_exact_dedup_also_with_colliding_digests(docs, digest):
    rows = exact.dedup(docs, digest=digest, batch_bytes=1).rows.collect()
    want, n_texts = brute_exact([(r.doc_id, r.text) for r in docs.collect()])
    assert Counter((r.id, r.keep_id, r.group_size) for r in rows) == want
    assert sum(r.kept for r in rows) == n_texts


def test_distinct_texts_keep_all_columns(docs):
    kept = exact.distinct_texts(docs)
    assert kept.columns == docs.columns
    assert sorted(r.text or "" for r in kept.collect()) == sorted({r.text or "" for r in docs.collect()})


# ------------------------------------------------------------------ op 5

def brute_components(rows, measure):
    sets = {}
    for key, text in rows:
        if key is not None:
            words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            words = [w for w in words.replace("\t", " ").replace("\n", " ").split(" ") if w]
            n = min(measure.words, len(words))
            sets[key] = {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if words else set()
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and measure.den * both >= measure.num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(s), find(k)) for k, s in sets.items()}


@pytest.mark.parametrize("measure", [partenum.Measure(words=3, num=90, den=100, n2=2), partenum.Measure()])
def test_jaccard_join_equals_all_pairs(docs, measure):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute_components(rows, measure)
    got = partenum.joined(docs, measure=measure).collect()
    assert len(got) == len(rows)
    assert all((r.n_shingles, r.component_id) == want[r.id] for r in got if r.id is not None)
    assert all(r.component_id is None for r in got if r.id is None)
    kept = partenum.representatives(docs, measure=measure)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {c for _, c in want.values()} | {None}


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(2)
    measure = partenum.Measure(num=80)
    bands = partenum.Bands(measure, 4000)
    for n in (1, 2, 5, 9, 10, 25, 60, 300, 1500):
        for _ in range(40):
            a = rng.integers(0, 1 << 63, n).astype(np.uint64)
            drop = int(rng.integers(0, n // 5 + 1))
            b = np.concatenate((a[drop:], rng.integers(0, 1 << 63, max(0, (n - drop) // 12)).astype(np.uint64)))
            both = len(np.intersect1d(a, b))
            if measure.den * both < measure.num * (len(a) + len(b) - both):
                continue
            owner, sig = partenum.signatures(np.concatenate((a, b)), np.array([len(a), len(b)]), measure, bands)
            assert set(sig[owner == 0]) & set(sig[owner == 1])


def variants(rng, base, n, first):
    """`n` texts of the words of `base` with six of them replaced, which puts them far from each other at 0.9."""
    out = []
    for i in range(n):
        words = list(base)
        for at in rng.choice(len(words), 6, replace=False):
            words[at] = f"x{first + i}y{at}"
        out.append((first + i, " ".join(words)))
    return out


@pytest.mark.parametrize("few", [0, 4, 32])
def test_groups_of_unlinked_members_make_few_candidates(spark, monkeypatch, few):
    rng = np.random.default_rng(5)
    rows = []
    for g in range(3):
        base = [f"g{g}w{i}" for i in range(120)]
        rows += variants(rng, base, 30, 1000 * g)
        off = rows[-1][1].split()  # near copies, and equal sets, of a text that is far from the hub
        rows += [(1000 * g + 500 + i, " ".join(off[:i] + ["z"] + off[i + 1:])) for i in range(0, 120, 8)]
        rows += [(1000 * g + 800 + i, " ".join(off) + " " * i) for i in range(10)]
    measure = partenum.Measure(words=3, num=90, den=100, n2=2)
    tables, real = {}, partenum.staged

    def staged(df, label):
        tables[label] = out = real(df, label)
        tables[label + " rows"] = out.count()
        return out

    monkeypatch.setattr(partenum, "FEW", few)
    monkeypatch.setattr(partenum, "HELD_PAIRS", 7)
    monkeypatch.setattr(partenum, "staged", staged)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: (r.n_shingles, r.component_id) for r in partenum.joined(docs, measure=measure).collect()}
    assert got == brute_components(rows, measure)
    # of the members whose pairs are not formed at once, the marks rule out what is far apart before it is a row
    assert tables["partenum-more rows"] <= len(rows)


def test_members_meet_by_few_of_their_differences(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(160)]
    rows = []
    for i in range(60):  # windows left out, of which members share elements; those of few words are linked to the hub
        n, at = (2 if i % 2 else 24), int(rng.integers(5, 130))
        rows.append((i, " ".join(base[:at] + [f"x{i}"] + base[at + n:])))
    measure = partenum.Measure(words=3, num=90, den=100, n2=2)
    rows_of, real = {}, partenum.staged

    def staged(df, label):
        out = real(df, label)
        rows_of[label] = out.count()
        return out

    monkeypatch.setattr(partenum, "FEW", 0)
    monkeypatch.setattr(partenum, "staged", staged)
    got = {r.id: (r.n_shingles, r.component_id) for r in partenum.joined(spark.createDataFrame(rows, "doc_id long, text string"), measure=measure).collect()}
    assert got == brute_components(rows, measure)
    assert 0 < rows_of["partenum-elements"] <= 600


def test_only_elements_that_meet_are_told():
    kinds = [(0, 0), (0, 1), (0, 3), (1,), (1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 3), (1, 2, 3), (0, 2, 3)]
    want = [(0, 0), (1, 1), (1, 1), (0,), (1, 1), (1, 1), (0, 0), (0, 0), (0, 0), (0, 0), (1, 1, 0), (1, 1, 1)]
    ids = np.array([4 * i + k for group in kinds for i, k in enumerate(group)])
    got = partenum.meeting(ids, np.cumsum([0] + [len(k) for k in kinds[:-1]]))
    assert got.tolist() == [bool(k) for group in want for k in group]


def test_signatures_are_packed_where_they_are_made(spark, docs):
    measure = partenum.Measure()
    sigs = partenum.signed(docs, "doc_id", "text", measure).where("id IS NOT NULL").select("id", "sigs")
    direct = partenum.repeated_in(docs, "doc_id", "text", measure)
    key = lambda df: sorted((r.sig, r.id) for r in df.collect())
    assert key(direct) == key(partenum.repeated(sigs))
    # one worker signs and packs, the other is behind the exchange
    assert direct._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2


def test_parities_differ_in_no_more_cells_than_sets_in_elements():
    rng = np.random.default_rng(6)
    for n in (0, 1, 5, 63, 64, 200, 1500):
        for gone, new in ((0, 0), (1, 0), (n // 10, 3), (n // 2, n)):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            b = np.unique(np.concatenate((a[gone:], rng.integers(0, 1 << 63, new).astype(np.uint64))))
            x, y = (partenum.parities(v, 1 << max(6, len(v).bit_length())) for v in (a, b))
            assert partenum.differing_bits(x, y) <= len(np.setxor1d(a, b))
            assert partenum.differing_bits(x, x) == 0


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}


def test_words_are_hashed_alike_in_any_batch():
    texts = ["A b\tC", "a B c", "", None, "ab c", "a bc", "x" * 70_000 + " y z"]
    alone = [[v.tolist() for _, v, _ in shingles.shingle_sets(pa.array([t], pa.string()), 3)][0] for t in texts]
    (_, values, sizes), = shingles.shingle_sets(pa.array(texts), 3)
    assert [x.tolist() for x in np.split(values, np.cumsum(sizes)[:-1])] == alone
    assert alone[0] == alone[1] and alone[4] != alone[5] and alone[2] == alone[3] == []


# ------------------------------------------------------------------ op 6

def test_word_ids_equal_the_tokenizer():
    words, tokenizer = WordIds(WORD_BPE, most=50), Tokenizer.from_file(WORD_BPE)
    rng = random.Random(1)
    alphabet = "aB cé́İŉǅ'’st lld_1٣²½ªµ<|>　\x85\x1c\n\t​😀Σσς-.漢\x00ÀÆſ·¨¿ǰ"
    for _ in range(1500):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14)))
        assert words.encode(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text
    assert words.encode("<|endoftext|>") == np.array([49407], "<u4").tobytes()


@pytest.mark.parametrize("window,unit", [(2048, 32), (64, 8)])
def test_packing_is_an_exact_round_trip(docs, window, unit):
    tokenizer = Tokenizer.from_file(WORD_BPE)
    want = Counter()
    for r in docs.collect():
        want[r.doc_id, tuple([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, packing.FINAL_ID])] += 1
    shape = packing.Shape(window=window, unit=unit)
    rows = packing.pack(docs, WORD_BPE, shape=shape).collect()
    assert sum(r.length for r in rows) == sum(len(ids) * n for (_, ids), n in want.items())
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for (key, ids), n in want.items():
        if n == 1 and sum(k == key for k, _ in want) == 1:
            at = 0
            for r in sorted(pieces[key], key=lambda r: r.start):
                assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes()))
                at += r.length
            assert at == len(ids)
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at == window or at < window and at & (at - 1) == 0  # nothing is padded


def test_nnls_meets_what_can_be_met():
    a = np.array([[1.0, 0, 2], [0, 1, 1]])
    assert np.allclose(a @ packing.nnls(a, np.array([5.0, 3.0])), [5, 3])
    assert packing.nnls(np.array([[1.0], [1.0]]), np.array([-1.0, -1.0])).tolist() == [0.0]
    shape = packing.Shape(window=64, unit=8)
    histogram = np.array([0, 40, 3, 0, 9, 0, 0, 5, 11])
    used = packing.repeats(histogram, shape, 0.0)
    taken = Counter(b for n, kind in used for b in kind for _ in range(n))
    assert used and all(sum(kind) == 8 for _, kind in used) and all(taken[b] <= histogram[b] for b in taken)


# ------------------------------------------------------------------ op 7

def test_language_id_on_held_out_documents(spark):
    from textward.llm.queries import QUERIES
    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = QUERIES["op7_language_id"](spark, "/root/testdata/sf0.01").collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {d for d in lang if zlib.crc32(str(d).encode()) % 5 == 0}
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) > 0.97 * len(held)
    assert len(rows) == len(lang) and all(0 <= r.score <= 1 for r in rows)


def test_language_id_of_odd_texts(spark, nothing):
    train = spark.createDataFrame([(i, t, l) for i, (t, l) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 3)]
                                  + [(90, None, "en"), (91, "ein text", None)], "doc_id long, text string, lang string")
    model = langid.fit(train)
    langs, scores = langid.predictions(model, ["the dog", "die katze", "undogged", "", None, "123 !!", "²³", "漢字", "x" * 3000])
    assert langs[:2] == ["en", "de"] and langs[3:7] == ["und"] * 4 and scores[3:7] == [0.0] * 4
    assert langs[7] in ("de", "en") and scores[7] == 0.5  # not one known letter: a tie, the first name
    assert all(0 <= s <= 1 for s in scores)
    assert langid.predictions(langid.fit(nothing), ["the dog"]) == (["und"], [0.0])


def test_words_first_then_shorter_grams(spark):
    train = spark.createDataFrame([(1, "aaa aab aac", "x"), (2, "bbb bba bbc", "y")], "doc_id long, text string, lang string")
    model = langid.fit(train)
    rows = langid._Rows(model)
    assert rows.cost[rows.of(["aaa"])[0]].tolist() == model.known(["aaa"], 0)[1][0].tolist()
    # "xaaax" has known grams of three letters at most, "zcz" of one; "qq" none
    for word, n in (("xaaax", 3), ("zcz", 1)):
        found, cost = model.known(langid.grams_of(word, n), n)
        assert found.any() and not any(model.known(langid.grams_of(word, k), k)[0].any() for k in range(n + 1, 7))
        assert np.allclose(langid.backoff(model, ["qq", word])[1], cost.mean(0))
    assert not langid.backoff(model, ["qq"]).any()


# ------------------------------------------------------------------ op 8

def brute_strings(rows, length):
    seen, out = set(), {}
    for key, text in sorted(rows):
        body = (text or "").encode()
        gone = bytearray(len(body))
        for i in range(len(body) - length + 1):
            s = body[i:i + length]
            if s in seen:
                gone[i:i + length] = b"\x01" * length
            seen.add(s)
        rest = bytes(c for c, g in zip(body, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out[key] = (len(body), sum(gone), spans, hashlib.sha256(rest).hexdigest())
    return out


@pytest.mark.parametrize("length,chunk", [(100, 50_000), (32, 50_000), (150, 7)])
def test_suffix_dedup_equals_brute_force(docs, monkeypatch, length, chunk):
    monkeypatch.setattr(suffixes, "CHUNK", chunk)
    rows = suffixes.dedup_strings(docs, length=length, partitions=3, sample_one_in=1, with_kept=True).collect()
    source = {(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None}
    want = brute_strings(list(source), length)
    for r in rows:
        if r.doc_id is not None:
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], r.doc_id
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and sum(s["to"] - s["from"] for s in r.spans) == r.n_removed
    assert len(rows) == docs.count()


def test_chunk_borders_within_a_token():
    body = bytes(random.Random(3).choices(b"ab", k=400))
    data = np.frombuffer(body + body, np.uint8)
    token, at, first, last = suffixes.anchors(data, np.array([0, 400, 800]), 100)
    assert sorted(np.concatenate([np.arange(f, e + 1) for f, e in zip(first, last, strict=True)])) == [*range(301), *range(400, 701)]
    assert all(f <= a and a + suffixes.Q <= e + 100 for a, f, e in zip(at, first, last, strict=True))


def test_multikey_order_is_a_stable_sort():
    rng = np.random.default_rng(4)
    keys = [rng.integers(0, 5, 500), rng.integers(0, 3, 500), rng.integers(0, 2, 500)]
    order, same = suffixes.multikey_order(len(keys[0]), len(keys), lambda k, rows: keys[k][rows])
    assert order.tolist() == np.lexsort(keys[::-1]).tolist()
    rows = list(zip(*(k[order] for k in keys), strict=True))
    assert same.tolist() == [i > 0 and rows[i] == rows[i - 1] for i in range(len(rows))]


# ------------------------------------------------------------------ op 9

def counter():
    return tokencount.Counter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.mark.parametrize("leaf", [1, 3, 64])
def test_edits_count_as_a_new_count_does(monkeypatch, leaf):
    monkeypatch.setattr(tokencount, "LEAF", leaf)
    count, rng = counter(), random.Random(leaf)
    pieces = ["a", "the", " ", "  ", "\n", "\n\n", "\t", "'s", "é", "12", "!", "...", "漢", "'", "re ll"]
    text = lambda n: "".join(rng.choice(pieces) for _ in range(n))
    for _ in range(400):
        body = text(rng.choice([0, 1, 5, 200]))
        tree = tokencount.build(body, count)
        for _ in range(4):
            at, removed, inserted = rng.randint(0, len(body)), rng.choice([0, 1, 3, 20]), text(rng.choice([0, 1, 3, 8]))
            want = body[:at] + inserted + body[at + removed:]
            body, _ = tokencount.edit(tree, body, at, removed, inserted, count)
            assert body == want and (tree.total if tree.n else 0) == len(count.encoding.encode_ordinary(body))


def test_small_edits_encode_little():
    count, body = counter(), "some words in a row, " * 5000
    tree = tokencount.build(body, count)
    _, encoded = tokencount.edit(tree, body, 50_000, 3, "new", count)
    assert encoded < 2000


def test_kept_trees_go_on(docs):
    edits = F.array(F.struct(F.lit(3).cast("long").alias("start"), F.lit(2).cast("long").alias("removed"), F.lit(" new ").alias("inserted")))
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    once = docs.withColumn("tree", tokencount.trees(docs, path, pattern)).withColumn("edits", edits)
    twice = once.withColumn("c", tokencount.edits_counted(once, path, pattern, "edits", tree="tree"))
    count = counter()
    for r in twice.collect():
        body = r.text or ""
        changed = body[:3] + " new " + body[5:]
        assert r.c.n_tokens == len(count.encoding.encode_ordinary(body)) and r.c.edited == changed
        assert r.c.n_tokens_edited == len(count.encoding.encode_ordinary(changed)) == sum(r.c.tree.tokens)


# ------------------------------------------------------------------ op 10

def test_raking_meets_the_targets(spark):
    rows = [(i, s, l, "t" if i % 3 else None, 10 + i % 7) for i, (s, l) in enumerate([("a", "en"), ("a", "de"), ("b", "en"), (None, "en")] * 200)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, topic string, n_tokens long")
    targets = {"source": {"a": 0.5, "b": 0.25, None: 0.25}, "lang": {"en": 0.8, "de": 0.2}, "topic": 1.0}
    dims = ("source", "lang", "topic")
    fitted = mixing.rake(mixing.cells(docs, dims, "n_tokens"), dims, targets, 40).collect()
    total = sum(r.weight for r in fitted)
    for dim in ("source", "lang"):
        for name, share in targets[dim].items():
            assert abs(sum(r.weight for r in fitted if r[dim] == name) / total - share) < 1e-6
    out = mixing.mix(docs.withColumn("probability", F.lit(9)), dims, "n_tokens", targets).collect()
    assert len(out) == len(rows) and max(r.probability for r in out) == 1
    expected = sum(r.probability * r.n_tokens for r in out)
    assert abs(sum(r.probability * r.n_tokens for r in out if r.source == "a") / expected - 0.5) < 1e-4  # after eight rounds
    drawn = sum(r.n_tokens for r in out if r.sampled)
    assert abs(drawn - expected) < 0.2 * expected


def test_categories_without_target_and_documents_without_tokens_go(spark):
    docs = spark.createDataFrame([(1, "a", "x", "t", 5), (2, "b", "x", "t", 5), (3, "a", "x", "t", 0), (4, "a", "x", "t", None)],
                                 "doc_id long, source string, lang string, topic string, n_tokens long")
    out = {r.doc_id: r.probability for r in mixing.mix(docs, ("source", "lang", "topic"), "n_tokens", {"source": {"a": 1}, "lang": 1.0, "topic": 1.0}).collect()}
    assert out == {1: 1.0, 2: 0.0, 3: 0.0, 4: 0.0}


def test_a_stray_cell_does_not_move_the_others(spark):
    rows = [(i, "abc"[min(i % 7, 2)], "xy"[i % 2], "t", 50 + i % 40) for i in range(2000)]
    stray = rows + [(2000, "stray", "z", "u", 20)]
    dims = ("source", "lang", "topic")
    schema = "doc_id long, source string, lang string, topic string, n_tokens long"
    drawn = [mixing.mix(spark.createDataFrame(r, schema), dims, "n_tokens", dict.fromkeys(dims, 0.9), keep=0.9).collect() for r in (rows, stray)]
    for out in drawn:
        assert abs(sum(r.probability * r.n_tokens for r in out) / sum(r.n_tokens for r in out) - 0.9) < 1e-6
        assert max(r.probability for r in out) <= 1
    before, after = ({r.doc_id: r.probability for r in out} for out in drawn)
    assert after[2000] == 1 and max(abs(p - after[i]) for i, p in before.items()) < 1e-3


def test_mixing_leaves_extra_columns_alone(spark):
    import corpus_pipeline
    docs = spark.range(50).selectExpr("id AS doc_id", "'a' AS source", "'x' AS lang", "'some words here' AS text", "concat('mine', id) AS topic", "-id AS n_tokens",
                                      "'p' AS probability", "'s' AS sampled")
    out = corpus_pipeline.weights(spark, docs, SF)
    assert out.columns == docs.columns and out.count() > 25 and out.exceptAll(docs).count() == 0


# ------------------------------------------------------------------ empty tables

def test_empty_tables(nothing):
    assert sketch.fingerprints(nothing).count() == 0
    assert exact.dedup(nothing).rows.count() == 0
    assert partenum.joined(nothing).count() == 0
    assert packing.pack(nothing, WORD_BPE).count() == 0
    assert suffixes.dedup_strings(nothing).count() == 0
    wide = nothing.selectExpr("*", "'t' AS topic", "1L AS n_tokens")
    assert mixing.mix(wide, ("source", "lang", "topic"), "n_tokens", {"source": 1.0, "lang": 1.0, "topic": 1.0}).count() == 0


def test_wrong_columns_are_named(nothing):
    with pytest.raises(ValueError, match="no column body"):
        exact.dedup(nothing, text="body")
