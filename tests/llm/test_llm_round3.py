"""Whitening, Merkle manifest and SimHash: brute force, SQL, odd inputs."""

import hashlib
import re

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from geoloom.llm import merkle, simhash, whitening

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, place long, fingerprint string, Pos int"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeats, and extra columns with names that operators use."""
    rows = [
        (1, "a b c d", "en", "s", 7), (2, "a b c d", "en", "s", 7), (2, "a b c d", "en", "s", 7), (None, "A  b\tC d", "en", None, None), (None, None, None, None, None),
        (3, "", "", "s", 0), (4, "one", "", "s", 3), (5, "x y", None, "+", 3), (-6, "word " * 40_000, "fr", "s", 200_000), (7, "é ü ß", "é", "s", 5), (8, "a b c d", "en", "s", 8), (9, "a b c d e", "en", "s", 9),
    ]
    return spark.createDataFrame([(*r, "t", 1, "f", 2) for r in rows], SCHEMA)


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, n_chars):
    return H("".join(map(field, (r.doc_id, r.source, r.lang, n_chars, r.text))))


def brute_manifest(rows, arity):
    def levels(h):
        out = [h]
        while len(out[-1]) > 1:
            out.append([H("".join(out[-1][i : i + arity])) for i in range(0, len(out[-1]), arity)])
        return out

    langs = {}
    for r in rows:
        langs.setdefault(r.lang, []).append(r)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    for x in order:
        langs[x].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.n_chars)))
    trees = {x: levels([leaf(r, r.n_chars) for r in langs[x]]) for x in order}
    top = levels([trees[x][-1][0] for x in order])
    out = []
    for k, x in enumerate(order):
        for p, r in enumerate(langs[x]):
            steps, at = [], p
            for tree, start in ((trees[x], p), (top, k)):
                at = start
                for level in tree[:-1]:
                    run = at // arity * arity
                    steps.append(("".join(level[run:at]), "".join(level[at + 1 : run + arity])))
                    at //= arity
            h = leaf(r, None if r.n_chars is None else r.n_chars + 1)
            for a, b in steps:
                h = H(a + h + b)
            out.append((r.doc_id, leaf(r, r.n_chars), trees[x][-1][0], top[-1][0], "".join(a + b for a, b in steps), h))
    return out


def key(row):
    return tuple((v is not None, v if v is not None else 0) for v in row)


def test_merkle_brute_force(spark, odd, monkeypatch):
    many = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"), F.when(F.col("id") % 3 == 0, "en").when(F.col("id") % 100 == 1, F.col("id").cast("string")).alias("lang"), F.lit("s").alias("source"), F.col("id").alias("n_chars"))
    for docs, arity, span in ((odd, 2, 10), (odd, 3, 1), (many, 2, 3), (many, 3, 10)):
        monkeypatch.setattr(merkle, "SPAN", span)
        got = merkle.manifest(docs, {"n_chars": F.col("n_chars") + 1}, arity=arity, spread=4)
        got = got.select("doc_id", "leaf", "subroot", "root", merkle.siblings(F.col("proof")), merkle.folded(F.col("leaf_now"), F.col("proof")), merkle.folded(F.col("leaf"), F.col("proof"))).collect()
        assert all(r[6] == r[3] for r in got)
        assert sorted((tuple(r)[:6] for r in got), key=key) == sorted(brute_manifest(docs.collect(), arity), key=key)


def test_merkle_small_tables(odd):
    assert merkle.manifest(odd.limit(0)).count() == 0
    one = merkle.manifest(odd.where("doc_id = 7")).collect()
    assert len(one) == 1 and one[0].leaf == one[0].subroot == one[0].root and one[0].proof == []


def test_merkle_sql(spark):
    db = duckdb.connect()
    db.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    assert sorted(map(tuple, merkle.op12_merkle(spark, SF).collect())) == sorted(db.execute(merkle.OP12_SQL).fetchall())


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(prints, threshold):
    """Index of the first of each one's component."""
    a, root = np.array(prints, np.uint64), list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i] ^ a[:i]) <= threshold):
            x, y = find(i), find(int(j))
            root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(a))]


def test_fingerprints_brute_force(spark, odd, monkeypatch):
    monkeypatch.setattr(simhash, "SHINGLES", 1000)
    for docs in (odd, spark.read.parquet(f"{SF}/documents.parquet")):
        rows = docs.select("doc_id", "text").collect()
        got = simhash.fingerprints(docs).collect()
        order = lambda r: (r[0] is not None, r[0] or 0, r[1])
        assert sorted(((r.doc_id, r.fingerprint % 2**64) for r in got), key=order) == sorted(((r.doc_id, brute_fingerprint(r.text)) for r in rows), key=order)


def test_codes_are_perfect():
    for block, (n, _, radius) in enumerate(simhash.BLOCKS):
        pattern, excess, starts, _ = simhash._errors(block, 0)
        assert (np.diff(starts) == 1).all() and len(pattern) == sum(map(len, np.split(pattern, starts[1:-1]))) and excess.max() == 0
        assert np.bitwise_count(pattern).max() == radius and n == simhash.BLOCKS[block][0]


@pytest.mark.parametrize("threshold,blocks,full", [(2, 1, 1 << 29), (2, 2, 1 << 29), (2, 1, 300), (2, 3, 20), (2, 4, 1), (0, 1, 50), (1, 2, 5), (3, 1, 500)])
def test_links_brute_force(spark, threshold, blocks, full):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 64, 30, dtype=np.uint64)
    prints = set(centres.tolist()) | {0, 2**64 - 1, 1, 3, 2**63}
    for c in centres[:20].tolist():
        for _ in range(8):
            near = c
            for b in rng.choice(64, rng.integers(1, 5), replace=False).tolist():
                near ^= 1 << b
            prints.add(near)
            c = near if rng.random() < 0.3 else c
    prints = sorted(prints)
    want = brute_classes(prints, threshold)
    table = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fingerprint long")
    at = {p: i for i, p in enumerate(prints)}
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in simhash.links(table, threshold, blocks, full).collect():
        x, y = find(at[r.a % 2**64]), find(at[r.b % 2**64])
        root[max(x, y)] = min(x, y)
    assert [find(i) for i in range(len(prints))] == want and len(set(want)) < len(prints) or threshold == 0


def test_simhash_odd_input(odd):
    rows = odd.select("doc_id", "text").collect()
    ids = sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0))
    classes = brute_classes([brute_fingerprint(r.text) for r in ids], 2)
    want = sorted(((r.doc_id, ids[c].doc_id) for r, c in zip(ids, classes)), key=str)
    assert sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(odd).collect()), key=str) == want
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def matrices():
    rng = np.random.default_rng(5)
    for d in (1, 2, 7, 40):
        a = rng.standard_normal((d, 3 * d))
        yield a @ a.T / d
        yield np.eye(d)
        yield a[:, :2] @ a[:, :2].T
        q, _ = np.linalg.qr(a[:, :d])
        v = q * np.repeat(rng.random(-(-d // 3)), 3)[:d] @ q.T
        yield (v + v.T) / 2


def test_feast_and_inertia():
    for v in matrices():
        values = np.linalg.eigvalsh(v)
        assert all(whitening.inertia(v, s) == (values < s).sum() for s in np.linspace(0.013, 1.1, 7) * values.max())
        for m in (1, 8, 30):
            got, axes = [], []
            for low, high, count in whitening.intervals(v, m):
                e, u = whitening.feast(v, low, high, count)
                assert np.abs(v @ u - u * e).max() < 1e-12 * max(1, values.max())
                got += e[::-1].tolist()
            want = values[::-1][:m]
            want = want[want > 1e-12 * values.max()]
            assert np.allclose(got[: len(want)], want, rtol=1e-11)
    v = next(matrices())
    with pytest.raises(ArithmeticError):
        whitening.feast(v, 0.0, float(v[0, 0]) / 2, 1)


def check_whitened(x, rows, components=8):
    n, s = len(x), [sum(c) for c in zip(*x)]
    z = np.array([[n * a - b for a, b in zip(r, s)] for r in x], object)
    f = z.astype(float) / n
    values, axes = np.linalg.eigh(f.T @ f / n)
    keep = [i for i in np.argsort(-values)[:components] if values[i] > 1e-9 * values.max()]
    want = f @ axes[:, keep] / np.sqrt(values[keep])
    got = np.zeros(want.shape)
    for r in rows:
        got[r.vec_id, r.component - 1] = r.whitened
        exact = int((z[r.vec_id] ** 2).sum())
        assert r.deviation == (exact if exact < 2**63 else None) and r.n == n
        assert abs(r.explained / (values[keep][r.component - 1] / values.sum()) - 1) < 1e-10 and r.identity_error < 1e-9
    assert len(rows) == want.size
    if len(keep) < 2 or np.diff(values[keep]).max() < -1e-3 * values.max():  # ties may turn
        assert np.allclose(got * np.sign((got * want).sum(0)), want, atol=1e-8)


def test_whitening_brute_force(spark):
    rng = np.random.default_rng(11)
    flat = lambda m: [[int(v) for v in r] for r in m]
    spread = rng.standard_normal((60, 12)) * np.geomspace(4000, 20, 12)
    for x, m in ((flat(spread + 100_000), 8), (flat(spread[:5]), 8), (flat(spread[:, :3]), 8), (flat(spread * 2**40), 3), (flat(np.repeat(spread[:9], 4, 0)), 20)):
        table = spark.createDataFrame([(i, r) for i, r in enumerate(x)], "vec_id long, x array<long>").repartition(3)
        check_whitened(x, whitening.whiten(table, m).collect(), m)


def test_whitening_odd_input(spark, tmp_path):
    empty = spark.createDataFrame([], "vec_id long, x array<long>")
    assert whitening.whiten(empty).count() == 0
    for rows in ([(1, [1, 2])], [(1, [3, 4]), (2, [3, 4])], [(1, [])]):
        assert whitening.whiten(spark.createDataFrame(rows, "vec_id long, x array<long>")).count() == 0
    nan, inf = float("nan"), float("inf")
    rows = [(None, [0.5, 1.0]), (1, [0.25, -1.0]), (1, [0.25, -1.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1e30, 1.0]), (7, [1.0, 0.0]), (8, [1.0])]
    spark.createDataFrame([(*r, 9, 1) for r in rows], "vec_id long, embedding array<float>, n int, Component int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = whitening.op11_whitening(spark, str(tmp_path)).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == [(0, 1), (0, 2), (1, 1), (1, 1), (1, 2), (1, 2), (7, 1), (7, 2)]
    assert {r.n for r in got} == {4} and max(r.identity_error for r in got) < 1e-9


def test_whitening_query(spark):
    rows = whitening.op11_whitening(spark, SF).collect()
    emb = sorted(spark.read.parquet(f"{SF}/embeddings.parquet").collect(), key=lambda r: r.vec_id)
    check_whitened([[int(np.floor(1024 * float(c))) + 100_000 for c in r.embedding] for r in emb], rows)
