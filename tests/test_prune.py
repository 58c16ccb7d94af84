"""Redundancy, blocks and cuts against removal of edges and points one by one."""

import itertools

import numpy as np
import pytest

from geoloom.operators import prune as pr
from geoloom.operators.ranking import ends_of_paths, numbered, subtree_totals


def parts(nodes, pairs):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in pairs:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    return {x: find(x) for x in nodes}


def graphs():
    rng = np.random.default_rng(2)
    sparse = sorted({tuple(sorted(rng.choice(45, 2, replace=False).tolist())) for _ in range(52)})
    ring = [(i, i + 1) for i in range(9)] + [(0, 9), (9, 10), (10, 11), (11, 12), (10, 12), (12, 20), (20, 21)]
    star = [(5, i) for i in range(30, 40)] + [(30, 31), (32, 33)]
    dense = [(50 + i, 50 + j) for i, j in itertools.combinations(range(7), 2) if rng.random() < 0.6]
    return {"sparse": sparse, "mixed": ring + [(100 + u, 100 + v) for u, v in star] + dense}


@pytest.mark.parametrize("name", ["sparse", "mixed"])
def test_redundancy_and_cuts_by_removal(spark, name):
    pairs = graphs()[name]
    nodes = sorted({x for e in pairs for x in e})
    comp = parts(nodes, pairs)
    edges = spark.createDataFrame(pairs, "u long, v long")
    labels = spark.createDataFrame([(x, c) for x, c in comp.items()], "pid long, comp long")
    joined = lambda e, gone: (lambda p: p[e[0]] == p[e[1]])(parts(nodes, [f for f in pairs if f not in gone]))
    level = {e: 0 if not joined(e, {e}) else 1 if any(not joined(e, {e, f}) for f in pairs if f != e) else 2 for e in pairs}
    red = pr.edge_redundancy(edges, labels)
    got = red.collect()
    assert {(r.u, r.v): r.redundancy for r in got} == level and all(r.comp == comp[r.u] for r in got) and (name == "sparse" or set(level.values()) == {0, 1, 2})
    counts = {(r.comp, r.redundancy): r.n for r in pr.redundancy_histogram(red).collect()}
    assert counts == {k: sum(1 for e in pairs if (comp[e[0]], level[e]) == k) for k in {(comp[e[0]], level[e]) for e in pairs}}

    second = {}
    for x in nodes:
        left = parts([y for y in nodes if comp[y] == comp[x] and y != x], [e for e in pairs if comp[e[0]] == comp[x] and x not in e])
        sizes = sorted((sum(1 for y in left if left[y] == c) for c in set(left.values())), reverse=True)
        if len(sizes) > 1:
            second[x] = sizes[1]
    assert {r.pid: r.second for r in pr.articulation_points(edges).collect()} == second
    size = {c: sum(1 for x in nodes if comp[x] == c) for c in comp.values()}
    for least, fraction in ((1, 0.0), (3, 0.1)):
        fit = lambda x: second.get(x, 0) >= max(least, int(np.ceil(fraction * size[comp[x]])))
        best = {c: min((-second[x], x) for x in nodes if comp[x] == c and fit(x))[1] for c in {comp[x] for x in nodes if fit(x)}}
        assert {r.comp: r.pid for r in pr.vertex_cut(edges, labels, least, fraction).collect()} == best
        want = set()
        for e in (e for e in pairs if level[e] == 0):
            p = parts(nodes, [f for f in pairs if f != e])
            if min(sum(1 for y in nodes if p[y] == p[x]) for x in e) >= max(least, int(np.ceil(fraction * size[comp[e[0]]]))):
                want.add(e)
        assert {(r.u, r.v) for r in pr.balanced_bridges(edges, labels, least, fraction).collect()} == want
    some = edges.where("u % 2 = 0")
    assert {(r.u, r.v) for r in pr.balanced_bridges(edges, labels, 1, 0.0, some).collect()} == {e for e in pairs if level[e] == 0 and e[0] % 2 == 0}


def test_rooted_forest_has_intervals(spark):
    pairs = [(0, 1), (1, 2), (1, 3), (3, 4), (0, 5), (7, 8)]
    rows = {r.id: r for r in pr.rooted_forest(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert {i: r.parent for i, r in rows.items()} == {0: None, 1: 0, 2: 1, 3: 1, 4: 3, 5: 0, 7: None, 8: 7}
    assert {i: r.size for i, r in rows.items()} == {0: 6, 1: 4, 2: 1, 3: 2, 4: 1, 5: 1, 7: 2, 8: 1}
    below = lambda a: {b for b in range(6) if rows[a].first <= rows[b].first <= rows[a].last}
    assert below(1) == {1, 2, 3, 4} and below(3) == {3, 4} and below(0) == set(range(6))
    none = spark.createDataFrame([], "u long, v long")
    assert pr.rooted_forest(none).count() == 0
    with pytest.raises(ValueError):
        pr.redundancy_prune(none, 3, 1, 0.5)


def test_positions_and_pointers(spark):
    rows = spark.createDataFrame([(None,), (5,), (3,), (3,), (-1,)], "x long").repartition(3)
    assert [(r.x, r.place) for r in numbered(rows, "x").orderBy("place").collect()] == [(None, 0), (-1, 1), (3, 2), (3, 3), (5, 4)]
    assert numbered(rows.limit(0), "x").count() == 0
    chain = spark.createDataFrame([(i, i + 1, i == 19) for i in range(20)] + [(50, 51, True)], "id long, to long, final boolean")
    assert {r.id: r.to for r in ends_of_paths(chain).collect()} == {**dict.fromkeys(range(20), 20), 50: 51}
    tree = spark.createDataFrame([(i, (i - 1) // 2 if i else None, i) for i in range(15)] + [(20, None, 3)], "id long, parent long, v long")
    got = {r.id: (r.s, r.x, r.m) for r in subtree_totals(tree, s=("v", "sum"), x=("v", "bit_xor"), m=("v", "min")).collect()}
    assert got[0] == (105, 15, 0) and got[1] == (1 + 3 + 4 + 7 + 8 + 9 + 10, 1 ^ 3 ^ 4 ^ 7 ^ 8 ^ 9 ^ 10, 1) and got[20] == (3, 3, 3) and got[14] == (14, 14, 14)
