"""Merge tree, condensed tree and choice of clusters against Prim, sorting and recursion."""


import numpy as np
import pytest

from geoloom.operators import mergetree as mt


def prim(w):
    n = len(w)
    inside, out = [0], []
    while len(inside) < n:
        weight, u, v = min((w[i, j], min(i, j), max(i, j)) for i in inside for j in range(n) if j not in inside)
        out.append((u, v, float(weight)))
        inside.append(v if u in inside else u)
    return out


def brute(n, forest, least):
    """Merge tree by sorted edges; clusters by recursion from the top."""
    top, nodes = list(range(n)), {}
    for k, (w, u, v) in enumerate(sorted((w, u, v) for u, v, w in forest)):
        a, b = top[u], top[v]
        members = [i for i in range(n) if top[i] in (a, b)]
        nodes[n + k] = (1 / max(w, 1e-12), a, b, members)
        for i in members:
            top[i] = n + k
    size = lambda x: 1 if x < n else len(nodes[x][3])
    points = lambda x: [x] if x < n else nodes[x][3]
    clusters, left = {}, {}

    def walk(x, birth, above):
        own, inside = x, 0.0
        clusters[own] = {"parent": above, "birth": birth, "members": points(x), "kids": []}
        if above is not None:
            clusters[above]["kids"].append(own)
        while True:
            level, a, b, _ = nodes[x]
            big = [y for y in (a, b) if size(y) >= least]
            if len(big) == 2:
                inside += sum(level - birth for y in big for _ in points(y))
                for y in big:
                    walk(y, level, own)
                break
            for y in (a, b):
                if size(y) < least:
                    for i in points(y):
                        left[i] = (own, level)
                        inside += level - birth
            if not big:
                break
            x = big[0]
        clusters[own]["stability"] = inside

    for t in set(top):
        if t >= n and size(t) >= least:
            walk(t, 0.0, None)
    return clusters, left


def choose(clusters, method):
    picked = set()

    def below(c):
        kids = clusters[c]["kids"]
        worth = sum(below(k) for k in kids)
        if clusters[c]["parent"] is None:
            return 0
        if kids and (method == "leaf" or worth > clusters[c]["stability"]):
            return worth
        stack = list(kids)
        while stack:
            k = stack.pop()
            picked.discard(k)
            stack += clusters[k]["kids"]
        picked.add(c)
        return max(worth, clusters[c]["stability"])

    for c in [c for c in clusters if clusters[c]["parent"] is None]:
        below(c)
    return picked


def expected(n, clusters, left, picked):
    out = {}
    for i in range(n):
        c = left[i][0] if i in left else None
        while c is not None and c not in picked:
            c = clusters[c]["parent"]
        out[i] = c
    first = {}
    for i, c in out.items():
        first.setdefault(c, i)
    return {i: -1 if c is None else first[c] for i, c in out.items()}


def points(n):
    rng = np.random.default_rng(n)
    return np.r_[rng.normal(0, 0.3, (n // 4, 2)), rng.normal([3, 0], 0.5, (n // 4, 2)), rng.normal([3.5, 2.2], 0.3, (n // 8, 2)), rng.uniform(-4, 6, (n - n // 4 * 2 - n // 8, 2))]


@pytest.mark.parametrize("n,least,most,ties", [(200, 8, 20, False), (60, 4, 1000, True)])
def test_density_labels_by_brute_force(spark, n, least, most, ties):
    p = points(n)
    if ties:
        p = np.round(p, 0)
    forest = prim(np.sqrt(((p[:, None] - p[None]) ** 2).sum(2)))
    if ties:
        forest = forest[:20] + forest[22:]  # trees of their own
    table = spark.createDataFrame(forest, "u long, v long, weight double").repartition(3)
    pts = spark.createDataFrame([(i,) for i in range(n)], "pid long")
    clusters, left = brute(n, forest, least)
    tree, leaves = mt.merge_tree(pts, table, most)
    assert tree.count() == len(forest) and {r.size for r in tree.collect()} >= {2}
    got, where = mt.condensed(tree, leaves, least)
    got = got.collect()
    assert sorted(round(r.stability, 6) for r in got) == pytest.approx(sorted(c["stability"] for c in clusters.values()), rel=1e-6)
    assert sorted(r.size for r in got) == sorted(len(c["members"]) for c in clusters.values())
    assert {r.pid: pytest.approx(r.left_at) for r in where.collect()} == {i: v for i, (_, v) in left.items()}
    for method in ("eom", "leaf") if not ties else ("eom",):
        labels = {r.pid: r.label for r in mt.density_labels(pts, table, least, method, most).collect()}
        assert labels == expected(n, clusters, left, choose(clusters, method))
        assert len(set(labels.values())) > 2 or ties


def test_small_forests(spark):
    pts = spark.createDataFrame([(i,) for i in range(4)], "pid long")
    none = spark.createDataFrame([], "u long, v long, weight double")
    assert {r.label for r in mt.density_labels(pts, none, 2).collect()} == {-1}
    one = spark.createDataFrame([(0, 1, 1.0), (1, 2, 2.0)], "u long, v long, weight double")
    assert {r.label for r in mt.density_labels(pts, one, 2).collect()} == {-1}  # a top alone is never chosen
    with pytest.raises(ValueError):
        mt.chosen(none, "other")
