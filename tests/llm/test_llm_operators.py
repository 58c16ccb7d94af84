"""Text operators: odd inputs, brute force, round trips, held-out accuracy."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.llm import decontaminate, jaccard_join, language_id, mixing, pii, quality, secrets, substring_dedup, topk_search, toxicity
from geoloom.llm.corpus import texts

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tokens string, row_key string, score int"


def vocabulary(n, seed=0):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeats, near copies, clashing extra columns."""
    r = random.Random(1)
    words = vocabulary(400)
    body = [" ".join(r.choice(words) for _ in range(60)) for _ in range(6)]
    near = body[0].split()
    near[30] = "changed"
    rows = [
        (1, body[0], "en", "a"), (2, body[0], "en", "a"), (2, body[0], "en", "a"), (3, " ".join(near), "de", "b"), (4, body[1] + "\n\t" + body[2], None, "a"),
        (5, body[2] + " x " + body[1], "en", None), (None, body[3], "en", "c"), (None, body[3], "en", "c"), (7, None, "en", "a"), (8, "", "de", "a"), (9, "one", "en", "a"),
        (10, "One", "en", "a"), (11, " ".join(r.choice(words) for _ in range(30_000)), "en", "a"), (12, "é ü " * 20, "de", "b"), (13, "12 34 !!", "en", "a"), (-5, body[4], "en", "a"), (14, "x" * 50_000, "en", "a"),
    ]
    return spark.createDataFrame([(i, t, lang, s, None, "t", "k", 1) for i, t, lang, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, q, t) for i, q, t in [(1, 1, 0), (3, 0, 1), (4, 1, 0), (5, 0, 1), (None, 1, 0), (9, None, None), (9, 1, 0), (9, 1, 0), (11, 0, 1)]], "doc_id long, quality int, toxic int")


def word_lists(docs):
    return [(r.doc_id, (r.text or "").encode().split()) for r in texts(docs).collect()]


def test_substring_dedup_brute_force(spark, odd):
    for window, groups in ((13, 48), (3, 5)):
        rows = word_lists(odd)
        order = lambda i: (i is None, i or 0)
        first = {}
        for i, w in rows:
            for p in range(len(w) - window + 1):
                k = tuple(w[p : p + window])
                first[k] = min(first.get(k, order(i)), order(i))
        want = []
        for i, w in rows:
            gone = {q for p in range(len(w) - window + 1) if first[tuple(w[p : p + window])] < order(i) for q in range(p, p + window)}
            want.append((i, len(w), len(gone), b" ".join(x for q, x in enumerate(w) if q not in gone).decode()))
        got = [tuple(r) for r in substring_dedup.without_repeats(odd, window, group_size=200, least_groups=groups).select("doc_id", "n_words", "n_removed", "kept").collect()]
        key = lambda x: (order(x[0]), x[1:])
        assert sorted(got, key=key) == sorted(want, key=key)
    assert substring_dedup.without_repeats(odd.limit(0)).count() == 0


def test_suffix_tree_maximal_repeats():
    rng = np.random.default_rng(7)
    rows = [rng.integers(0, 2, n).tolist() for n in (0, 1, 5, 30, 41)] + [rng.integers(0, 9, 60).tolist()]
    rows += [rows[3][4:25] + rows[4][:9], rows[5], [1] * 20]
    firsts = np.cumsum([0, *map(len, rows)])
    symbols = np.array([x for r in rows for x in r], np.uint64)
    at = {int(firsts[i]) + p: (i, p) for i, r in enumerate(rows) for p in range(len(r))}
    for depth in (1, 3, 4, 6, 13):
        places = {}
        for i, r in enumerate(rows):
            for p in range(len(r)):
                for q in range(p + depth, len(r) + 1):
                    places.setdefault(tuple(r[p:q]), []).append((i, p))
        want = {}
        for text, found in places.items():
            sides = [{rows[i][p - 1] if p else (i, p) for i, p in found}, {rows[i][p + len(text)] if p + len(text) < len(rows[i]) else (i, p) for i, p in found}]
            if len(found) > 1 and min(map(len, sides)) > 1:
                want[text] = sorted(found)
        tree = substring_dedup.SuffixTree(symbols, firsts, depth)
        before = np.r_[-1, symbols[:-1].astype(np.int64)]
        before[firsts[:-1][firsts[:-1] < len(symbols)]] = -1
        got = {}
        for size, leaves in tree.maximal_repeats(before):
            i, p = at[int(leaves[0])]
            got[tuple(rows[i][p : p + size])] = sorted(at[int(x)] for x in leaves)
        assert got == want
        owner = np.repeat(np.arange(len(rows)) // 2, np.diff(firsts))
        for leaf, size in zip(tree.leaves.tolist(), tree.earlier(owner).tolist()):
            i, p = at[leaf]
            assert size == max((len(t) for t, f in places.items() if (i, p) in f and min(j // 2 for j, _ in f) < i // 2), default=0)


def brute_classes(rows, k, percent):
    low = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, w in rows:
        w = [x.translate(low) for x in w]
        sets.append({tuple(w[p : p + k]) for p in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return [(doc, len(sets[i]), least.get(find(i)) if sets[i] else doc) for i, (doc, _) in enumerate(rows)]


def test_jaccard_join_brute_force(spark, odd):
    r = random.Random(4)
    words = vocabulary(60, 2)
    base = [r.choice(words) for _ in range(80)]
    rows = []
    for i in range(60):  # a family of near copies, more of them than short lists hold
        w = list(base)
        for _ in range(i % 6):
            w[r.randrange(len(w))] = r.choice(words) + str(i)
        rows.append((100 + i, " ".join(w), "en", "a", None, "t", "k", 1))
    rows += [(200 + n, " ".join(words[:n]), "en", "a", None, "t", "k", 1) for n in range(8, 14)]
    docs = odd.union(spark.createDataFrame(rows, SCHEMA))
    for k, percent in ((3, 90), (5, 80), (1, 60)):
        got = [tuple(x) for x in jaccard_join.near_duplicates(docs, k, percent, count_links=k == 5).select("doc_id", "n_shingles", "component_id").collect()]
        want = brute_classes(word_lists(docs), k, percent)
        key = lambda x: tuple((v is None, v or 0) for v in x)
        assert sorted(got, key=key) == sorted(want, key=key)
    docs = docs.withColumn("_id", F.lit(1)).withColumn("_key", F.lit(2)).withColumn("_own", F.lit(3)).withColumn("_text", F.lit(4))
    kept = jaccard_join.one_of_each(docs, 3, 90)
    assert kept.columns == docs.columns
    ids = [x.doc_id for x in kept.collect()]
    assert 1 in ids and 2 not in ids and 7 in ids and 8 in ids and 9 in ids and 10 not in ids and ids.count(None) == 1
    assert jaccard_join.near_duplicates(docs.limit(0)).count() == 0
    assert jaccard_join.one_of_each(docs.limit(0)).count() == 0


def test_jaccard_blocks_of_long_lists(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HOT_BLOCK", 6)
    monkeypatch.setattr(jaccard_join, "HOT_LOCAL", 2)
    r = random.Random(9)
    base = vocabulary(70, 5)
    rows = [(i, " ".join(w if r.random() > 0.01 * (i % 4) else w + str(i) for w in base), "en", "a", None, "t", "k", 1) for i in range(50)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {x.doc_id: x.component_id for x in jaccard_join.near_duplicates(docs, 3, 90, count_links=False).collect()}
    assert got == {d: c for d, _, c in brute_classes(word_lists(docs), 3, 90)}


def test_secrets(spark, odd):
    lines = ["token = 'abcdefgh12' and password: short", "API_KEY=\"Zm9vYmFyMTIzNDU2\" AKIA" + "A1B2C3D4E5F6G7", "x " + "0123456789abcdef" * 2 + " Token=secret:abcdefghijk", "the identifier_of_something xK9fQ2mZr7Lp0Tw4Vb8N", "ſecret = abcdefghijk"]
    docs = odd.unionByName(spark.createDataFrame([(300 + i, t, "en", "a", None, "t", "k", 1) for i, t in enumerate(lines)], SCHEMA))
    model = secrets.fit(docs)
    got = {(r.doc_id, tuple((s["start"], s["kind"], s["end"]) for s in r.found)) for r in secrets.find_secrets(docs, model).collect()}
    for row in texts(docs).collect():
        want = []
        for kind, pattern, least, group in ((0, re.compile(secrets.ASSIGN, re.I | re.A), 8, 2), (1, re.compile(secrets.ACCESS), 16, 0), (2, re.compile(secrets.HEX), 32, 0)):
            want += [(m.start(), kind, m.end()) for m in pattern.finditer(row.text) if len(m[group]) >= least]
        assert any(doc == row.doc_id and [s for s in spans if s[1] < 3] == sorted(want) for doc, spans in got)
    # the Markov spans, by a plain walk over the same ratios
    for row in texts(docs).collect():
        want = []
        for m in re.finditer(r"[A-Za-z0-9+/_=-]{16,}", row.text):
            ratio = np.mean([model.ratio[ord(a), ord(b)] for a, b in zip("\0" + m[0], m[0])])
            base = [s for doc, spans in got if doc == row.doc_id for s in spans if s[1] < 3]
            if ratio >= model.threshold and not any(s < m.end() and m.start() < e for s, _, e in base):
                want.append((m.start(), 3, m.end()))
        assert any(doc == row.doc_id and [s for s in spans if s[1] == 3] == want for doc, spans in got)
    found = dict((d, s) for d, s in got if d == 303)
    assert [lines[3][a:b] for a, k, b in found[303] if k == 3] == ["xK9fQ2mZr7Lp0Tw4Vb8N"]
    assert secrets.find_secrets(odd.limit(0), secrets.fit(odd.limit(0))).count() == 0


def test_markov_models_know_identifiers(spark):
    model = secrets.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    ordinary = ["user_id_0000012345", "2024-01-31T12-00-00", "12345678-1234-5678-1234-567812345678", "section_2_introduction", "INVOICE_2023_00012345", "=" * 30, "getElementsByClassName"]
    random = ["xK9fQ2mZr7Lp0Tw4Vb8N", "QwZrTyPlMnBvCxKjHg", "aGVsbG8gd29ybGQgZm9v", "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY"]
    assert (model.scores(ordinary) < model.threshold).all() and (model.scores(random) >= model.threshold).all()


def accuracy(rows, score, label):
    return np.mean([(r[score] == 1) == (r[label] == 1) for r in rows])


def test_toxicity(spark, odd, labels):
    docs, known = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.toxicity_scores(docs, toxicity.fit(docs, known)).withColumn("predicted", (F.col("score") >= 0.3).cast("int")).join(known, "doc_id").where(F.crc32(F.col("doc_id").cast("string")) % 4 == 2).collect()
    assert accuracy(out, "predicted", "toxic") > 0.9
    caught = [r.predicted for r in out if r.toxic == 1]
    assert np.mean(caught) > 0.55 and np.mean([r.predicted for r in out if r.toxic == 0]) < 0.06  # a third of these toxic documents holds nothing toxic
    for some, lab in ((odd, labels), (odd, labels.limit(0)), (odd.limit(0), labels)):
        model = toxicity.fit(some, lab)
        rows = toxicity.toxicity_scores(some, model).collect()
        assert len(rows) == some.count() and all(0 <= r.score <= 1 for r in rows)
        assert toxicity.without_toxic(some, model, 1.1).count() == some.count()


def test_quality(spark, odd, labels):
    docs, known = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = quality.quality_scores(docs, quality.fit(docs, known)).withColumn("predicted", (F.col("score") >= 0.5).cast("int")).join(known, "doc_id").where(F.crc32(F.col("doc_id").cast("string")) % 3 == 1).collect()
    assert accuracy(out, "predicted", "quality") > 0.95
    for some, lab in ((odd, labels), (odd, labels.limit(0)), (odd.limit(0), labels)):
        rows = quality.quality_scores(some, quality.fit(some, lab)).collect()
        assert len(rows) == some.count() and all(0 <= r.score <= 1 for r in rows)


def test_isotonic():
    x, y = quality.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]), np.ones(4))
    assert y.tolist() == [0, 0.5, 1] and (np.diff(x) > 0).all()


def test_language(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.languages_of(docs, language_id.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").where(F.crc32(F.col("doc_id").cast("string")) % 5 == 0).collect()
    assert np.mean([r.lang_pred == r.lang for r in out]) > 0.95
    rows = language_id.languages_of(odd, language_id.fit(odd)).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in rows if r.doc_id in (7, 8, 13)} == {"und"}
    assert language_id.languages_of(odd, language_id.fit(odd.limit(0))).select("lang_pred").distinct().collect()[0][0] == "und"


def test_top_k(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 6))
    x[10] = x[20] = x[30]
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)] + [(1000, None, 0), (1001, [1.0] * 5 + [float("nan")], 0), (1002, [1.0] * 5 + [None], 0), (None, [1.0] * 6, 0), (5, [float(v) for v in x[5]], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    vectors = table.select("vec_id", topk_search.whole_numbers(F.col("embedding")).alias("v"))
    whole = np.floor(1024 * x).astype(int)
    for shard, leaf in ((8192, 128), (40, 4)):
        topk_search.SHARD, topk_search.LEAF = shard, leaf
        got = {}
        for r in topk_search.top_k(vectors, F.col("vec_id") % 10 == 0, 7).collect():
            got.setdefault(r.query_id, {})[r["rank"]] = (r.score, r.vec_id)
        ids = np.r_[np.arange(300), 5]
        every = np.r_[whole, whole[5:6]]
        assert set(got) == set(range(0, 300, 10))
        for q in got:
            best = sorted((-int(s), int(i)) for s, i in zip(every @ whole[q], ids) if i != q)[:7]
            assert [got[q][k] for k in range(1, 8)] == [(-s, i) for s, i in best]
    topk_search.SHARD, topk_search.LEAF = 8192, 128
    # components whose squares leave double precision and, in small shards, large queries
    big = np.concatenate([rng.integers(-(2 * 10**9), 2 * 10**9, (60, 2)), rng.integers(-5, 5, (60, 2)), np.array([[10**17, 3], [4 * 10**9, 2]])])
    huge = spark.createDataFrame([(i, [int(c) for c in r]) for i, r in enumerate(big)] + [(500, []), (501, [])], "vec_id long, v array<long>")
    for shard, leaf in ((8192, 128), (30, 4)):
        topk_search.SHARD, topk_search.LEAF = shard, leaf
        got = {}
        for r in topk_search.top_k(huge.where("vec_id < 120 or vec_id >= 500"), F.col("vec_id") % 10 == 0, 5).collect():
            got.setdefault(r.query_id, {})[r["rank"]] = (r.score, r.vec_id)
        for q in range(0, 120, 10):
            best = sorted((-sum(int(a) * int(b) for a, b in zip(big[i], big[q])), i) for i in range(120) if i != q)[:5]
            assert [got[q][k] for k in range(1, 6)] == [(-s, i) for s, i in best]
        assert got[500] == {1: (0, 501)}
        small = {r["rank"]: (r.score, r.vec_id) for r in topk_search.top_k(huge.where("vec_id between 60 and 120"), F.col("vec_id") == 120, 5).collect()}
        best = sorted((-sum(int(a) * int(b) for a, b in zip(big[i], big[120])), i) for i in range(60, 120))[:5]
        assert [small[k] for k in range(1, 6)] == [(-s, i) for s, i in best]
    topk_search.SHARD, topk_search.LEAF = 8192, 128
    assert topk_search.top_k(vectors.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_top_k_leaves_cells_out(spark, monkeypatch):
    """On clustered vectors most cells' boxes can't reach the k-th score of the first cell; the results stay exact."""
    monkeypatch.setattr(topk_search, "SHARD", 60)
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.02, (100, 5)) for c in rng.normal(size=(12, 5))])
    whole = np.floor(1024 * x).astype(int)
    vectors = spark.createDataFrame([(i, [int(c) for c in r]) for i, r in enumerate(whole)], "vec_id long, v array<long>")
    trees, boxes = topk_search.plant(vectors.withColumn("d", F.size("v")))
    cells = len(boxes[5].cell)
    assert cells > 12 and trees.selectExpr("sum(shards)").first()[0] >= cells
    known = vectors.where("vec_id % 10 = 0").selectExpr("vec_id", "v", "size(v) as d", "0L as block")
    every = whole @ whole[::10].T
    least = {int(i): int(np.sort(np.delete(every[:, n], i))[-5]) for n, i in enumerate(range(0, 1200, 10))}
    known = known.join(spark.createDataFrame(list(least.items()), "vec_id long, least long"), "vec_id")
    sent = topk_search.visits(known, boxes, 0, cells).count()
    assert sent < 0.6 * 120 * cells
    got = {(r.query_id, r["rank"]): (r.score, r.vec_id) for r in topk_search.top_k(vectors, F.col("vec_id") % 10 == 0, 5).collect()}
    for n, q in enumerate(range(0, 1200, 10)):
        best = sorted((-int(s), i) for i, s in enumerate(every[:, n]) if i != q)[:5]
        assert [got[q, k] for k in range(1, 6)] == [(-s, i) for s, i in best]


def test_median_cells_of_equal_vectors():
    """Vectors that are all alike share a cell, which is then split by a hash; one vector makes no cells."""
    assert len(set(topk_search.Cells.fit(np.ones((64, 3), np.int64), 8).cell(np.ones((64, 3), np.int64)))) == 1
    assert topk_search.Cells.fit(np.arange(3)[None], 8).cell(np.arange(6).reshape(2, 3)).tolist() == [0, 0]
    spread = topk_search.Cells.fit(np.arange(64)[:, None], 8).cell(np.arange(64)[:, None])
    assert np.bincount(spread).tolist() == [8] * 8


def test_decontamination(spark, odd, monkeypatch):
    r = random.Random(3)
    words = vocabulary(300, 7)
    items = [(i, " ".join(r.choice(words) for _ in range(n))) for i, n in enumerate([3, 5, 16, 40, 90, 200])] + [(90, None), (91, ""), (None, "a b c d e f"), (3, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts_in = {i: t for i, t in items if i is not None and t}
    rows = []
    for n, (i, t) in enumerate(texts_in.items()):
        pad = [r.choice(words) for _ in range(2000)]
        rows += [(500 + 10 * n, " ".join(pad[:700]) + " " + t.upper() + " " + " ".join(pad[700:])), (501 + 10 * n, t), (502 + 10 * n, " ".join(t.split()[: max(1, len(t.split()) // 2)]))]
    docs = odd.unionByName(spark.createDataFrame([(i, t, "en", "a", None, "t", "k", 1) for i, t in rows], SCHEMA))
    want = set()
    for doc in texts(docs).collect():
        w = doc.text.lower().split()
        for i, t in texts_in.items():
            x = t.split()
            k = min(5, len(x))
            s, d = ({tuple(v[p : p + k]) for p in range(len(v) - k + 1)} for v in (x, w))
            if 100 * len(s & d) >= 80 * len(s):
                want.add((doc.doc_id, i, len(s & d), len(s)))
    got = [tuple(x) for x in decontaminate.contained_items(docs, bench).collect()]
    assert set(got) == want and len(got) == len(want)
    clean = decontaminate.without_contaminated(docs, bench)
    assert clean.columns == docs.columns and clean.count() == docs.count() - len({d for d, *_ in want})
    assert decontaminate.contained_items(docs, bench.limit(0)).count() == 0
    assert decontaminate.contained_items(docs.limit(0), bench).count() == 0
    # blocks of a few shingles, one after another
    monkeypatch.setattr(decontaminate, "BLOCK", 20)
    assert len(list(decontaminate._blocks(bench, 5))) > 1
    assert sorted(tuple(x) for x in decontaminate.contained_items(docs, bench).collect()) == sorted(got)
    assert sorted(map(str, decontaminate.without_contaminated(docs, bench).collect())) == sorted(map(str, clean.collect()))


def test_surrogates(spark, odd):
    lines = [
        "Mrs. Anna Smith (anna.smith@mail.example.com, +1 (212) 555-0187) met Mr. Smith at 10.20.30.40.", "ANNA.SMITH@MAIL.EXAMPLE.COM or anna.smith@mail.example.com; call +1 212 555 0187",
        "card 4111 1111 1111 1111 and 4111111111111111, ssn 123-45-6789", "Иван пишет с иван@почта.рф", "nothing here 12",
    ]
    docs = odd.unionByName(spark.createDataFrame([(600 + i, t, "en", "a", None, "t", "k", 1) for i, t in enumerate(lines)], SCHEMA)).withColumn("n_entities", F.lit("old"))
    out = pii.with_surrogates(docs, "key")
    rows = {r.doc_id: r for r in out.collect()}
    assert out.count() == docs.count() and rows[7].text is None and rows[7].n_entities == 0
    for i in range(4):
        assert not re.search(r"(?i)anna\.smith|Anna|555-0187|555 0187|10\.20\.30\.40|4111|123-45-6789|иван@", rows[600 + i].text)
    assert rows[604].text == lines[4]
    mail = re.findall(r"[\w.]+@[\w.]+", rows[600].text)[0]
    again = re.findall(r"[\w.]+@[\w.]+", rows[601].text)
    assert again == [mail.upper(), mail]
    digits = lambda t: re.sub(r"\D", "", t)
    assert digits(re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", rows[600].text)[0]) == digits(re.search(r"\+1 \d{3} \d{3} \d{4}", rows[601].text)[0])
    cards = re.findall(r"\d{16}|\d{4}(?: \d{4}){3}", rows[602].text)
    assert digits(cards[0]) == digits(cards[1])
    luhn = sum(int(c) if i % 2 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(digits(cards[0])))
    assert luhn % 10 == 0
    assert re.match(r"^Mrs\. [A-Z][a-z]+ [A-Z][a-z]+ \(", rows[600].text) and rows[600].text.split()[1] in pii.GIVEN["latin"]["f"]
    other = {r.doc_id: r.text for r in pii.with_surrogates(docs, "other key").collect()}
    assert other[600] != rows[600].text


def test_surrogates_of_names_and_accounts(spark):
    lines = ["Mr Smith, Dr Smith, Mr John Smith and Dr John SMITH", "Mr Иванов und Frau Παπαδοπούλου; Mr Пётр Иванов", "GB82 WEST 1234 5698 7654 32 or GB82WEST12345698765432"]
    docs = spark.createDataFrame([(i, t, 1, 2, 3, 4, 5, 6) for i, t in enumerate(lines)], "doc_id long, text string, _found int, _key int, _own int, _text int, _id int, _put int")
    out = pii.with_surrogates(docs)
    assert out.columns == [*docs.columns, "n_entities"]
    rows = {r.doc_id: r for r in out.collect()}
    assert all(tuple(r)[2:8] == (1, 2, 3, 4, 5, 6) for r in rows.values())
    a, b, c, d = (re.split(r", | and ", rows[0].text))
    family = a.split()[1]
    assert family != "Smith" and b == f"Dr {family}" and c.split()[2] == family and d.split()[1:] == [c.split()[1], family.upper()] and c.split()[1] in pii.GIVEN["latin"]["m"]
    m = re.fullmatch(r"Mr ([А-Яа-яё]+) und Frau ([Α-Ωα-ωάέήίόύώ]+); Mr ([А-Яа-яё]+) ([А-Яа-яё]+)", rows[1].text)
    assert m and m[4] == m[1] and m[1] != "Иванов" and m[3] in pii.GIVEN["cyrillic"]["m"]
    one, two = rows[2].text.split(" or ")
    account = one.replace(" ", "")
    assert account == two != "GB82WEST12345698765432" and int("".join(str(int(x, 36)) for x in account[4:] + account[:4])) % 97 == 1
    assert pii.with_surrogates(docs.limit(0)).count() == 0


def test_names_that_differ_in_case(spark):
    """Columns in another case are the operator's own ones: replaced where it makes them, read where it takes them."""
    docs = spark.createDataFrame([(1, "write to amy.holt@mail.example", "en", "a", "mine", 9)], "Doc_ID long, Text string, lang string, source string, Topic string, N_Entities int")
    out = pii.with_surrogates(docs)
    assert out.columns == ["Doc_ID", "Text", "lang", "source", "Topic", "n_entities"]
    row = out.first()
    assert row.n_entities == 1 and "amy.holt" not in row.Text and row.Topic == "mine"
    mixed = mixing.sample_to_targets(docs, rate=1.0)
    assert sorted(mixed.columns) == sorted([*docs.columns, "n_tokens", "probability"]) and [r.Topic for r in mixed.collect()] == ["mine"]


def test_surrogate_key_of_the_session(spark):
    docs = spark.createDataFrame([(1, "write to amy.holt@mail.example")], "doc_id long, text string")
    assert pii.session_key(spark) == "geoloom"
    spark.conf.set("geoloom.pii.key", "other")
    assert pii.session_key(spark) == "other"
    spark.conf.unset("geoloom.pii.key")
    assert pii.with_surrogates(docs, "other").first().text != pii.with_surrogates(docs).first().text


def test_surrogates_stay_distinct(spark):
    entities = spark.createDataFrame([("ssn", f"{i:03d}") for i in range(600)], "kind string, name string")
    rows = pii.dictionary(entities.where("name < '300'"), "k").collect()
    assert len({r.surrogate for r in rows}) == len(rows) == 300
    assert not {r.surrogate for r in rows} & {r.name for r in rows}


def test_mixing(spark, odd):
    clash = odd.withColumn("topic", F.lit("own")).withColumn("_source", F.lit(1)).withColumn("_topic", F.lit(2)).withColumn("_lang", F.lit(3))
    for docs in (odd, clash):
        out = mixing.sample_to_targets(docs, rate=0.9)
        rows = out.collect()
        assert set(out.columns) == {*docs.columns, "topic", "n_tokens", "probability"} and rows
        assert all(0 < r.probability <= 1 and r.n_tokens > 0 for r in rows)
        assert mixing.sample_to_targets(docs.limit(0)).count() == 0
    assert {r.topic for r in rows} == {"own"} and {(r._source, r._topic, r._lang) for r in rows} == {(1, 2, 3)}
    cells = spark.createDataFrame([("a", "x", 900), ("a", "y", 100), ("b", "x", 50), ("b", "y", 950)], "source string, lang string, tokens long")
    share = lambda m, s: spark.createDataFrame(list(s.items()), f"{m} string, share double")
    targets = {"source": share("source", {"a": 0.3, "b": 0.7}), "lang": share("lang", {"x": 0.5, "y": 0.5})}
    raked = mixing.rake(cells, targets)
    rate = mixing.feasible_rate(raked)
    got = raked.collect()
    want = np.array([[900.0, 100], [50, 950]])
    for _ in range(200):
        want *= (np.array([0.3, 0.7]) * 2000 / want.sum(1))[:, None]
        want *= np.array([0.5, 0.5]) * 2000 / want.sum(0)
    assert np.allclose([r.weight for r in sorted(got, key=lambda r: (r.source, r.lang))], want.ravel())
    assert abs(max(rate * r.weight / r.tokens for r in got) - 1) < 1e-9
    assert all(abs(r.target - r.reached) < 1e-9 for r in mixing.reached_shares(raked, targets, rate).collect())
    assert any(abs(r.target - r.reached) > 1e-3 for r in mixing.reached_shares(raked, targets, 1.0).collect())


def test_mixing_reaches_its_targets(spark):
    cells = mixing.mix_cells(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).cache()
    targets = {m: mixing.smoothed_shares(cells, m, p) for m, p in (("source", 0.0), ("lang", 0.5), ("topic", 0.5))}
    raked = mixing.rake(cells, targets)
    assert all(abs(r.target - r.reached) < 1e-3 for r in mixing.reached_shares(raked, targets, mixing.feasible_rate(raked)).collect())


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    rows = out.collect()
    assert set(docs.columns) <= set(out.columns) and 0 < len(rows) < docs.count()
    ids = [r.doc_id for r in rows]
    assert len(set(ids)) == len(ids)
    hits = {r.doc_id for r in decontaminate.contained_items(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert not hits & set(ids)


def test_pipeline_stages_on_odd_input(spark, odd, labels, tmp_path):
    """Every stage, by the pipeline's own functions, on nulls, repeats, empty and long texts, clashing columns, and on no rows."""
    import corpus_pipeline

    docs = odd.withColumn("_id", F.lit("i")).withColumn("_key", F.lit("k"))
    body = odd.where("doc_id = 4").first().text
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, body), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for some in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, some, str(tmp_path))
            assert out.columns == docs.columns, name
            kept = out.collect()
            assert len(kept) <= some.count()
            assert all(r._id == "i" and r._key == "k" for r in kept)
            if name == "benchmark_decontamination" and kept:
                assert {r.doc_id for r in some.collect()} - {r.doc_id for r in kept} == {4, 5}  # document 5 holds the two halves of 4
        name, stage = corpus_pipeline.STAGES[-1]
        assert set(docs.columns) <= set(stage(spark, some, str(tmp_path)).columns)


def test_digests(spark):
    from geoloom.llm.queries import ORACLES, QUERIES

    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) == 10
    row = QUERIES["op1_secrets"](spark, SF).where("spans = ''").first()
    assert row.base_sha256 == hashlib.sha256(b"").hexdigest()
    assert zlib.crc32(b"1") % 4 == spark.range(1).select(F.crc32(F.lit("1")) % 4).first()[0]


@pytest.mark.parametrize("block", [4_000, 6])
def test_links_of_a_family_are_all_counted(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "HOT_BLOCK", block)
    r = random.Random(12)
    base = vocabulary(90, 7)
    rows = [(i, " ".join(w if r.random() > 0.01 * (i % 4) else w + str(i) for w in base), "en", "a", None, "t", "k", 1) for i in range(30)]
    docs = spark.createDataFrame(rows, SCHEMA)
    lists = dict(word_lists(docs))
    sets = {d: frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) for d, w in lists.items()}
    want = {d: len({t for t in sets.values() if t != s and 100 * len(s & t) >= 90 * len(s | t)}) for d, s in sets.items()}
    assert max(want.values()) > jaccard_join.PAIRWISE
    assert {x.doc_id: x.n_links for x in jaccard_join.near_duplicates(docs, 3, 90).collect()} == want


def test_hub_pairs_are_dealt_to_copies(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HUB_PAIRS", 3)
    r = random.Random(11)
    base = vocabulary(90, 6)
    rows = [(i, " ".join(w if r.random() > 0.008 * (i % 4) else w + str(i) for w in base), "en", "a", None, "t", "k", 1) for i in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {x.doc_id: x.component_id for x in jaccard_join.near_duplicates(docs, 3, 90, count_links=False).collect()}
    assert got == {d: c for d, _, c in brute_classes(word_lists(docs), 3, 90)}
