"""Wave growth against plain-Python versions of both orders."""

import itertools

import numpy as np
import pytest

from geoloom.operators import delaunay as dl, edges as ed, points as po, waves as wv


def fixture(spark):
    rng = np.random.default_rng(4)
    p = np.r_[rng.normal(0, 1, (22, 2)), rng.normal([7, 0], 0.8, (20, 2)), rng.normal([3, 8], 0.6, (18, 2)), rng.uniform(-3, 11, (20, 2))]
    pts = spark.createDataFrame([(i, [float(c) for c in x]) for i, x in enumerate(p)], "pid long, x array<double>")
    flat = po.plane(pts)
    edges = ed.measured(dl.edges_from_triangles(dl.delaunay(flat)), pts, flat).select("u", "v", "len_o")
    scores = {(r.u, r.v): (r.open_u, r.open_v) for r in wv.outer_scores(edges).collect()}
    rows = []
    for r in edges.collect():
        h = (r.u * 7 + r.v * 13) % 10
        near = h < 6
        rows.append((r.u, r.v, r.len_o, bool(r.len_o < 0.8 and near and h % 2), r.len_o < 1.9, r.len_o < 2.6 and h != 4, near, *scores[r.u, r.v]))
    return pts, spark.createDataFrame(rows, "u long, v long, len_o double, seed boolean, allowed boolean, relaxed boolean, near boolean, open_u double, open_v double"), rows, len(p)


def brute(rows, n, mild, min_edges, relaxation, selectivity, threshold, order):
    """Waves with explicit sets; ``order``: one after another, or all that are the largest among their neighbours."""
    edge = {r[:2]: r for r in rows}
    root, taken, how, seen, rejected, done, leads = list(range(n)), set(), {}, set(), set(), set(), set()

    def join(u, v):
        a, b = sorted((root[u], root[v]))
        root[:] = [a if x == b else x for x in root]

    for e, r in edge.items():
        if r[3]:
            taken.add(e)
            how[e] = ("seed", 0)
            join(*e)
    possible = {e for e, r in edge.items() if r[3] or r[4] or (r[5] and r[6])}
    inner = lambda c: [edge[e][2] for e in taken if root[e[0]] == c]
    active = {c for c in set(root) if len(inner(c)) > min_edges}
    rank = lambda c: (c in leads, len(inner(c)), root.count(c), -c)
    for wave in itertools.count(1):
        free = {c for c in active if c in leads or not any(root[p] == c for p in done)}
        if order == "one":
            leaders = {max(free, key=rank)} if free else set()
        else:
            near = {frozenset((root[a], root[b])) for a, b in possible if root[a] != root[b]}
            leaders = {c for c in free if not any(rank(d) > rank(c) for d in free if frozenset((c, d)) in near)}
        if not leaders:
            return taken, how, seen, rejected
        new, spent = {}, set()
        for c in leaders:
            q, m, t = np.percentile(inner(c), [25, 50, 75])
            iqr = max(t - q, 1e-12)
            limit = m + mild * iqr
            ok = selectivity is None or np.mean([selectivity[p] for p in range(n) if root[p] == c]) > threshold
            grew = False
            for e, (u, v, length, _, allowed, relaxed, near_, su, sv) in edge.items():
                if e in taken or c not in (root[u], root[v]):
                    continue
                seen.add(e)
                score = max(su, sv) if root[u] == root[v] else sv if root[u] == c else su
                if allowed and length <= limit:
                    kind = "automatic"
                elif relaxation is not None and allowed and not near_ and length <= limit + relaxation * score * iqr:
                    kind = "open_space"
                elif relaxed and near_ and length > limit and ok:
                    kind = "near"
                else:
                    rejected.add(e)
                    continue
                new[e] = min(kind, new.get(e, (kind,))[0]), wave
                grew = True
            if not grew:
                spent.add(c)
        for c in spent:
            done |= {p for p in range(n) if root[p] == c}
            active.discard(c)
            leads.discard(c)
        grown = {p for p in range(n) if root[p] in leaders - spent}
        old = {p for p in range(n) if root[p] in leads}
        live = {p for p in range(n) if root[p] in active}
        taken |= set(new)
        how |= new
        for e in new:
            join(*e)
        leads = {root[p] for p in grown | old}
        active = {root[p] for p in live}


@pytest.mark.parametrize("strict,relaxation,use", [(False, 0.8, False), (True, 0.8, True)])
def test_wave_growth_by_brute_force(spark, strict, relaxation, use):
    pts, edges, rows, n = fixture(spark)
    share = {i: (i * 37 % 100) / 100 for i in range(n)} if use else None
    table = spark.createDataFrame(list(share.items()), "pid long, selectivity double") if use else None
    got = wv.wave_growth(edges, pts, 0.4, 1, relaxation, table, 0.45, strict).collect()
    taken, how, seen, rejected = brute(rows, n, 0.4, 1, relaxation, share, 0.45, "one" if strict else "all")
    pairs = lambda f: {(r.u, r.v) for r in got if f(r)}
    assert pairs(lambda r: r.taken) == taken and pairs(lambda r: r.seen) == seen and pairs(lambda r: r.rejected) == rejected
    assert {(r.u, r.v): r.how for r in got if r.taken} == {e: k for e, (k, _) in how.items()}
    assert {k for k, _ in how.values()} == {"seed", "automatic", "open_space", "near"}
    if not strict:
        assert {(r.u, r.v): r.wave for r in got if r.taken} == {e: w for e, (_, w) in how.items()}


def test_wave_growth_without_large_seeds(spark):
    pts, edges, _, _ = fixture(spark)
    out = wv.wave_growth(edges.drop("open_u", "open_v"), pts, -0.5, 10_000).collect()
    assert all(r.taken == (r.wave == 0) and not r.seen for r in out)
    assert wv.wave_growth(edges.limit(0), pts, -0.5, 1).count() == 0
