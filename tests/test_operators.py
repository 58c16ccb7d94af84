"""Operators on small fixtures with known answers, and against brute force."""

import heapq
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.functions.vectors import clipped, floored, open_space, robust_ratio
from geoloom.operators import bridges, delaunay as dl, density, edges as ed, evaluate as ev, growth as gr, neighbors as nb, points as po, prune as pr, reclaim as rc, topology as tp
from geoloom.operators.components import connected_components


def edge_table(spark, pairs, lengths=None):
    rows = [(min(u, v), max(u, v), float(w), float(w)) for (u, v), w in zip(pairs, [1.0] * len(pairs) if lengths is None else lengths)]
    return spark.createDataFrame(rows, "u long, v long, len_o double, len_p double")


def point_table(spark, p, y=None):
    return spark.createDataFrame([(i, [float(c) for c in x], None if y is None else int(y[i])) for i, x in enumerate(p)], "pid long, x array<double>, y long")


def empty_circles(p, triangles):
    t = np.array(sorted(triangles))
    mid, r2 = dl.circumcircles(p, t)
    for m, r, corners in zip(mid, r2, t):
        d = ((p - m) ** 2).sum(1)
        d[corners] = np.inf
        assert (d >= r * (1 - 1e-6)).all()


@pytest.mark.parametrize("tile", [10_000, 40])
def test_delaunay_is_whole_and_empty(spark, tile):
    p = np.random.default_rng(1).random((160, 2))
    got = dl.delaunay(po.plane(point_table(spark, p)), tile).collect()
    triangles = {(r.a, r.b, r.c) for r in got}
    assert len(triangles) == len(got)
    empty_circles(p, triangles)
    sides = {s for t in triangles for s in itertools.combinations(t, 2)}
    assert len(p) - len(sides) + len(triangles) == 1  # Euler


def test_delaunay_of_a_dense_spot_in_a_sparse_plane(spark):
    rng = np.random.default_rng(8)
    p = np.r_[rng.random((150, 2)), 0.3 + 1e-3 * rng.random((120, 2)), [0.8, 0.1] + 0.02 * rng.normal(size=(130, 2))]
    flat = po.plane(point_table(spark, p))
    triangles = {(r.a, r.b, r.c) for r in dl.delaunay(flat, 12).collect()}
    assert triangles == {(r.a, r.b, r.c) for r in dl.delaunay(flat, 10_000).collect()}
    empty_circles(p, triangles)
    assert len(p) - len({s for t in triangles for s in itertools.combinations(t, 2)}) + len(triangles) == 1


def test_delaunay_degenerate(spark):
    line = point_table(spark, [(i, 2 * i) for i in range(5)])
    assert dl.delaunay(po.plane(line)).count() == 0
    assert dl.delaunay(po.plane(line.limit(0))).count() == 0
    grid = np.array([(i, j) for i in range(4) for j in range(4)], float)
    got = {(r.a, r.b, r.c) for r in dl.delaunay(po.plane(point_table(spark, grid))).collect()}
    assert len(got) == 18
    empty_circles(grid, got)
    double = point_table(spark, [(0, 0), (1, 0), (0, 1), (1, 0)])
    assert [(r.a, r.b, r.c) for r in dl.delaunay(po.plane(double)).collect()] == [(0, 1, 2)]


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (50, 50)]
    got = dict(connected_components(edge_table(spark, chain)).collect())
    assert {got[i] for i in range(41)} == {0} and got[101] == 100 and got[50] == 50
    assert connected_components(edge_table(spark, chain).limit(0)).count() == 0


def test_knn_matches_brute_force(spark):
    p = np.random.default_rng(2).normal(size=(60, 5))
    p[7] = p[3]
    got = {(r.pid, r["rank"]): r.nid for r in nb.knn(point_table(spark, p), 4).collect()}
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    for i in range(60):
        assert [got[i, k] for k in range(1, 5)] == np.lexsort((np.arange(60), d[i]))[:4].tolist()


def test_knn_skips_far_cells(spark):
    rng = np.random.default_rng(12)
    p = np.concatenate([rng.normal(size=(45, 6)) + 40 * rng.normal(size=6) for _ in range(8)])
    p[5], p[50] = p[3], 1e4
    pts = point_table(spark, p)
    got = {(r.pid, r["rank"]): (r.nid, r.dist) for r in nb.knn(pts, 7, block=16).collect()}
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    for i in range(len(p)):
        want = np.lexsort((np.arange(len(p)), d[i]))[:7]
        assert [got[i, j + 1] for j in range(7)] == [(w, pytest.approx(d[i, w])) for w in want]
    share = nb.skipped_share(pts, 7, 16)
    print(f"share of pairs of blocks skipped: {share:.2f}")
    assert share > 0.6 and len(got) == 7 * len(p)
    assert nb.knn(pts.limit(0), 3).count() == 0 and nb.knn(pts.limit(3), 5, block=1).count() == 6


def test_standardize_constant_feature(spark):
    got = {r.pid: r.x for r in po.standardize(point_table(spark, [(0, 5), (2, 5)])).collect()}
    assert got == {0: [-1.0, 0.0], 1: [1.0, 0.0]}


def test_scalars(spark):
    row = spark.range(1).select(clipped(F.lit(None).cast("double")).alias("n"), clipped(F.lit(5.0)).alias("c"), floored(F.lit(0.0)).alias("f"), robust_ratio(F.lit(3.0), F.lit(1.0), F.lit(2.0)).alias("r"), open_space(F.lit(3.0), F.lit(0.0)).alias("o"), open_space(F.lit(1.0), F.lit(3.0)).alias("h")).first()
    assert row.n is None and row.c == 2 and row.f == 1e-12 and row.r == 2 and row.o == 0 and abs(row.h - 0.5) < 1e-9


def test_two_triangles_and_a_bridge(spark):
    e = edge_table(spark, [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (2, 3)])
    assert [(r.u, r.v) for r in pr.short_path_bridges(e, 3).collect()] == [(2, 3)]
    assert pr.short_path_bridges(e, 1).count() == 7
    labels = connected_components(e).select(F.col("node").alias("pid"), F.col("component").alias("comp"))
    red = {(r.u, r.v): r.redundancy for r in pr.edge_redundancy(e, labels).collect()}
    assert red[2, 3] == 0 and red[0, 1] == 1
    assert [(r.u, r.v) for r in pr.redundancy_prune(pr.edge_redundancy(e, labels), 1, 1, 0.5).collect()] == [(2, 3)]
    assert {(r.u, r.v) for r in pr.balanced_bridges(e, labels, 2, 0.2).collect()} == {(2, 3)}
    cut = pr.vertex_cut(e, labels, min_points=2, fraction=0.2)
    assert [r.pid for r in cut.collect()] == [2]
    assert pr.without_points(e, cut).count() == 4


def test_growth_reaches_a_fixpoint_and_only_coarsens(spark):
    # a tight chain of seeds, a near point and a far one
    pairs = [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5)]
    e = edge_table(spark, pairs, [1.0, 1.1, 1.2, 1.25, 9.0])
    pts = spark.range(6).select(F.col("id").alias("pid"))
    out = {(r.u, r.v): r for r in gr.sequential_growth(e, pts, e.where("v <= 3"), 2, 4.0, 4.0).collect()}
    assert out[3, 4].accepted and not out[4, 5].accepted and out[0, 1].seed
    with pytest.raises(ValueError):
        gr.sequential_growth(e, pts, e, 1, 1.0, 1.0, mode="other")


def quarters(x):
    return np.percentile(x, [25, 50, 75])


def brute_growth(edges, points, seeds, min_edges, limit, projected, restore, mode="real"):
    """Flags of each edge by the definition: bounded restoration in large seeds, then frozen statistics and all of a round at once."""
    parent = {p: p for p in points}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def join(u, v):
        a, b = sorted((find(u), find(v)))
        parent[b] = a

    for u, v in seeds:
        join(u, v)
    inside = {}
    for u, v in seeds:
        inside[find(u)] = inside.get(find(u), 0) + 1
    active = {c for c, n in inside.items() if n > min_edges}
    large = {p for p in points if find(p) in active}
    accepted, back, virtual, seen = set(), set(), set(), {}
    if restore is not None:
        for c in active:
            q, m, r = quarters([edges[e][0] for e in seeds if find(e[0]) == c])
            back |= {e for e in edges if e not in seeds and find(e[0]) == find(e[1]) == c and edges[e][0] <= m + restore * max(r - q, 1e-12)}
    for number in itertools.count(1):
        reference = seeds | accepted | back | virtual
        stats = {}
        for c in {find(p) for p in points}:
            own = [e for e in reference if find(e[0]) == find(e[1]) == c]
            if own:
                stats[c] = quarters([edges[e][0] for e in own]), quarters([edges[e][1] for e in own])
        new, again = set(), set()
        for e, (o, f) in edges.items():
            a, b = find(e[0]), find(e[1])
            for c in sorted({a, b} & active) if a != b else ():
                (_, m, q), (_, pm, pq) = stats[c]
                seen.setdefault(e, (number, c, (o - m) / max(q - m, 1e-12), e[1] if a == c else e[0], m, q))
                if (o - m) / max(q - m, 1e-12) < limit and (f - pm) / max(pq - pm, 1e-12) < projected:
                    new.add(e)
            if restore is not None and mode != "seed_only" and a == b and a in active and e not in reference and o <= stats[a][0][1] + restore * max(stats[a][0][2] - stats[a][0][0], 1e-12):
                again.add(e)
        if not new and not again:
            added = {p for p in points if p not in large and find(p) in {find(x) for x in large}}
            return accepted, back, virtual, added, seen
        accepted |= new
        if mode == "virtual":
            virtual |= again
        else:
            back |= again
        for u, v in new:
            join(u, v)
        active = {find(c) for c in active}


def brute_frozen(edges, label, limit, projected):
    label, rounds, number = dict(label), {}, 0
    while True:
        number += 1
        best = {}
        for c in {x for x in label.values() if x >= 0}:
            touch = [e for e in edges if c in (label[e[0]], label[e[1]])]
            if not touch:
                continue
            (_, m, q), (_, pm, pq) = quarters([edges[e][0] for e in touch]), quarters([edges[e][1] for e in touch])
            for e in touch:
                outer = next((y for x, y in (e, e[::-1]) if label[x] == c and label[y] < 0), None)
                o, f = (edges[e][0] - m) / max(q - m, 1e-12), (edges[e][1] - pm) / max(pq - pm, 1e-12)
                if outer is not None and o < limit and f < projected:
                    best[outer] = min(best.get(outer, ((np.inf,), 0)), ((max(o / limit, f / projected), o, f, *e, c), c))
        if not best:
            return label, rounds
        for p, (_, c) in best.items():
            label[p], rounds[p] = c, number


def test_growth_on_all_delaunay_edges_by_brute_force(spark):
    rng = np.random.default_rng(11)
    p = np.r_[rng.normal(0, 1, (30, 2)), rng.normal(6, 0.6, (25, 2)), rng.uniform(-4, 10, (25, 2))]
    flat = po.plane(point_table(spark, p))
    edges = ed.measured(dl.edges_from_triangles(dl.delaunay(flat)), point_table(spark, np.c_[p, np.sin(p[:, 0])]), flat).collect()
    lengths = {(r.u, r.v): (r.len_o, r.len_p) for r in edges}
    cut = np.median([r.len_o for r in edges]) * 0.8
    seeds = {e for e, (o, _) in lengths.items() if o < cut and sum(e) % 4}
    table = spark.createDataFrame([(*e, *x) for e, x in lengths.items()], "u long, v long, len_o double, len_p double")
    pts = spark.range(len(p)).select(F.col("id").alias("pid"))
    seed = table.where((F.col("len_o") < cut) & ((F.col("u") + F.col("v")) % 4 != 0))
    labels = gr.components(pts, seed.select("u", "v"))
    large = gr.component_counts(labels, seed).where("n_edges > 2")
    pairs = lambda rows: {(r.u, r.v) for r in rows}
    for mode in ("real", "virtual", "seed_only"):
        rows = gr.sequential_growth(table, pts, seed, 2, 4.0, 5.0, 1.0, mode).collect()
        accepted, back, virtual, added, seen = brute_growth(lengths, range(len(p)), seeds, 2, 4.0, 5.0, 1.0, mode)
        assert pairs(r for r in rows if r.accepted) == accepted and pairs(r for r in rows if r.restored) == back and pairs(r for r in rows if r.virtual) == virtual
        assert back and (mode == "virtual") == bool(virtual)
    q25 = {i: np.percentile([lengths[e][0] for e in lengths if i in e], 25) for i in range(len(p))}
    recall = pts.withColumn("recall", F.col("pid") / 100)
    for r in (got := gr.growth_history(table, pts, seed, 2, 4.0, 5.0, 1.0, "seed_only", ed.incident_q25(table, pts), recall).collect()):
        number, comp, ratio, outer, m, q = seen[r.u, r.v]
        assert (r["round"], r.comp) == (number, comp) and r.ratio_o == pytest.approx(ratio) and r.ratio_q == pytest.approx((q25[outer] - m) / max(q - m, 1e-12))
        assert r.outer_recall == outer / 100 and r.shown_o == pytest.approx(min(max(ratio, 0), 2))
    assert len(got) == len(seen)
    state = spark.createDataFrame(gr.sequential_growth(table, pts, seed, 2, 4.0, 5.0).toPandas())
    accepted, back, _, added, _ = brute_growth(lengths, range(len(p)), seeds, 2, 4.0, 5.0, None)
    assert not back
    got = gr.growth_added_points(pts, labels, large, state)
    assert {r.pid for r in got.collect()} == added and added
    # interior restoration: edges inside a grown component that it lacks, within the scale of its seeds
    root = {i: i for i in range(len(p))}
    for u, v in sorted(seeds | accepted):
        a, b = sorted((root[u], root[v]))
        root = {k: a if x == b else x for k, x in root.items()}
    inner = {e for e in lengths if root[e[0]] == root[e[1]]} - seeds - accepted
    scale = {c: quarters([lengths[e][0] for e in seeds if root[e[0]] == c]) for c in {root[e[0]] for e in seeds}}
    bounded = {e for e in inner if root[e[0]] in scale and lengths[e][0] <= scale[root[e[0]]][1] + 1.5 * max(scale[root[e[0]]][2] - scale[root[e[0]]][0], 1e-12)}
    assert pairs(gr.interior_restoration(table, pts, seed, state, None).collect()) == inner
    interior = gr.interior_restoration(table, pts, seed, state, 1.5)
    assert pairs(interior.collect()) == bounded and bounded < inner
    want = accepted | {e for e in bounded if set(e) & added}
    assert pairs(gr.removable_edges(state, interior, got).collect()) == want > accepted
    layer = table.where("u % 2 = 0").select("u", "v")
    assert pairs(gr.removable_edges(state, interior, got, layer).collect()) == {e for e in want if e[0] % 2 == 0}

    label = {r.pid: r.label for r in gr.final_prediction(labels, seed, 2).collect()}
    want, rounds = brute_frozen(lengths, label, 2.0, 2.5)
    frozen = gr.frozen_growth(table, spark.createDataFrame(list(label.items()), "pid long, label long"), 2.0, 2.5).collect()
    assert {r.pid: r.label for r in frozen} == want and {r.pid: r.round for r in frozen if r["round"]} == rounds and max(rounds.values()) > 1


def test_gates_and_node_weights(spark):
    labels = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (3, 3), (4, 3), (5, 5)], "pid long, comp long")
    e = edge_table(spark, [(0, 1), (1, 2), (0, 2), (3, 4), (2, 3)])
    ratio = tp.triangle_edge_ratio(spark.createDataFrame([(0, 1, 2)], "a long, b long, c long"), e, labels)
    pairs = lambda t: {(r.u, r.v) for r in t.collect()}
    assert pairs(tp.triangle_gate(e, labels, ratio, 1 / 3)) == {(0, 1), (1, 2), (0, 2)}
    assert len(pairs(tp.triangle_gate(e, labels, ratio, 0.0))) == 5 and not pairs(tp.triangle_gate(e, labels, ratio, 0.5))
    ratios = spark.createDataFrame([(0, 0.4), (3, float("inf"))], "comp long, hull_ratio double")
    assert {r.comp: r.skipped for r in tp.hull_skip(ratios, 0.5).collect()} == {0: False, 3: True}
    assert not any(r.skipped for r in tp.hull_skip(ratios, 0.0).collect())
    assert {r.comp: r.weight for r in pr.node_weights(labels).collect()} == {0: 3, 3: 2, 5: 1}


def test_adjusted_information_in_blocks(spark):
    pred = spark.createDataFrame([(i % 3 if i % 5 else 0, i % 2) for i in range(60)], "y long, label long")
    values = [ev.adjusted_information(pred, block).first().ami for block in (1, 7, 4096)]
    assert max(values) - min(values) < 1e-12


def test_restoration_limits(spark):
    e = edge_table(spark, [(0, 1), (1, 2), (0, 2)], [1.0, 1.0, 5.0])
    labels = spark.createDataFrame([(0, 0), (1, 0), (2, 0)], "pid long, comp long")
    assert gr.restored(e, labels, e.where("len_o < 2"), None).count() == 1
    assert gr.restored(e, labels, e.where("len_o < 2"), 2.0).count() == 0
    assert gr.restored(e, labels, e.limit(0), 2.0).count() == 0


def test_outlier_merge_votes_with_all_edges(spark):
    p = [(0, 0), (1, 0), (0, 1), (10, 0), (11, 0), (10, 1), (2, 0), (5.2, 0), (30, 0), (12, 0)]
    pts = point_table(spark, p)
    inside = [(0, 1), (0, 2), (1, 2), (3, 4), (3, 5), (4, 5)]
    votes = [(0, 6), (1, 6), (3, 6), (1, 7), (3, 7), (4, 8), (4, 9), (5, 9), (6, 7)]
    edges = edge_table(spark, inside + votes, [float(np.hypot(*np.subtract(p[a], p[b]))) for a, b in inside + votes])
    kept = edge_table(spark, inside, [1, 1, 1.4, 1, 1, 1.4])
    labels = spark.createDataFrame([(i, 0 if i < 3 else 3 if i < 6 else -1) for i in range(10)], "pid long, label long")
    merged = lambda limit: [r.label for r in gr.outlier_merge(edges, kept, pts, labels, limit).orderBy("pid").collect()]
    # 6: two of three votes for 0; 7: a tie; 8: far; 9: near 3 by both votes
    assert merged(1.0) == [0, 0, 0, 3, 3, 3, 0, -1, -1, 3]
    assert merged(100.0) == [0, 0, 0, 3, 3, 3, 0, -1, 3, 3]
    assert [r.label for r in gr.outlier_merge(edges, kept.limit(0), pts, labels, 100.0).orderBy("pid").collect()] == [0, 0, 0, 3, 3, 3, -1, -1, -1, -1]


def test_recall_with_few_points(spark):
    near = nb.knn(point_table(spark, [(0, 0), (1, 0), (5, 5)]), 10)
    assert {r.recall for r in nb.recall(near, near, 10).collect()} == {1.0}


def test_boundary_scores_are_on_the_component_scale(spark):
    pairs = [(0, 1), (1, 2), (0, 2), (2, 3), (3, 4)]
    e = edge_table(spark, pairs, [1, 2, 3, 7, 5])
    labels = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (3, 3), (4, 4)], "pid long, comp long")
    large = spark.createDataFrame([(0,)], "comp long")
    q25 = spark.createDataFrame([(i, 10.0 + i) for i in range(5)], "pid long, q25 double")
    recall = spark.createDataFrame([(i, i / 10) for i in range(5)], "pid long, recall double")
    r = gr.boundary_scores(e, None, labels, large, q25, recall).collect()
    median, q75 = np.percentile([1, 2, 3, 7], [50, 75])
    assert [(x.u, x.v, x.comp) for x in r] == [(2, 3, 0)] and r[0].ratio == pytest.approx((7 - median) / (q75 - median)) and r[0].outer_q25 == pytest.approx((13 - median) / (q75 - median)) and r[0].outer_recall == 0.3


def test_cost_gate_keeps_clusters_and_respects_reach(spark):
    pairs = [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 6)]
    e = edge_table(spark, pairs, [1, 1, 1, 1, 1, 50])
    labels = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (3, -1), (4, -1), (5, -1), (6, -1)], "pid long, label long")
    core = spark.range(7).select(F.col("id").alias("pid"), F.lit(1.0).alias("core"))
    got = {r.pid: r.label for r in rc.cost_gate(e, labels, core, reach=2.5).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: -1, 6: -1}


def heap_claims(edges, label, core, power, penalty, reach, clip):
    """Claims by the definition: a heap in the order of cost, point, cluster and edge."""
    clusters = {c for c in label.values() if c >= 0}
    inside = {c: [w for (u, v), w in edges.items() if label[u] == label[v] == c] for c in clusters}
    avg = {c: max(np.mean(x) if x else np.median(list(edges.values())), 1e-12) for c, x in inside.items()}
    ref = {c: max(np.median([core[p] for p in label if label[p] == c]), 1e-12) for c in clusters}

    def step(e, p, c):
        ratio = max(core[p], 1e-12) / ref[c]
        return (edges[e] * (max(ratio, 1) if clip else ratio) ** power / avg[c]) ** (1 + penalty)

    heap = [(step(e, q, label[p]), q, label[p], e) for e in edges for p, q in (e, e[::-1]) if label[p] >= 0 > label[q]]
    heap, owner = [h for h in heap if h[0] <= reach], {}
    heapq.heapify(heap)
    while heap:
        cost, p, c, e = heapq.heappop(heap)
        if p in owner:
            continue
        owner[p] = c, cost, *e
        for f in edges:
            if p in f:
                q = f[0] if f[1] == p else f[1]
                if label[q] < 0 and q not in owner and cost + step(f, q, c) <= reach:
                    heapq.heappush(heap, (cost + step(f, q, c), q, c, f))
    return owner


@pytest.mark.parametrize("clip,lengths", [(False, (0.5, 1.0, 1.5)), (True, (0.0, 1.0))])
def test_cost_gate_equals_a_heap(spark, clip, lengths):
    rng = np.random.default_rng(9)
    pairs = sorted({tuple(sorted(rng.choice(70, 2, replace=False).tolist())) for _ in range(150)})
    edges = {e: float(rng.choice(lengths)) for e in pairs}
    label = {i: (0, 1, 2, -1, -1, -1, -1)[i % 7] if i < 60 else -1 for i in range(70)}
    core = {i: float(rng.choice([0.5, 1.0, 2.0])) for i in range(70)}
    want = heap_claims(edges, label, core, 0.5, 0.5, 6.0, clip)
    table = edge_table(spark, pairs, list(edges.values()))
    got = rc.cost_gate(table, spark.createDataFrame(list(label.items()), "pid long, label long"), spark.createDataFrame(list(core.items()), "pid long, core double"), reach=6.0, clip=clip).collect()
    assert {r.pid: (r.label, pytest.approx(r.cost), r.u, r.v) for r in got if r.cost is not None} == want and len(want) > 15
    assert all(r.label == label[r.pid] for r in got if r.cost is None)


def test_spanning_forest_matches_prim(spark):
    rng = np.random.default_rng(3)
    p = rng.normal(size=(30, 2))
    pts = point_table(spark, p)
    forest = density.spanning_forest(pts, spark.createDataFrame([(i, j, float(np.hypot(*(p[i] - p[j])))) for i in range(30) for j in range(i + 1, 30)], "u long, v long, weight double"))
    inside, total = {0}, 0.0
    while len(inside) < 30:
        w, j = min((np.hypot(*(p[i] - p[j])), j) for i in inside for j in set(range(30)) - inside)
        inside.add(j)
        total += w
    rows = forest.collect()
    assert len(rows) == 29 and abs(sum(r.weight for r in rows) - total) < 1e-9


@pytest.mark.parametrize("detour", [False, True])
def test_spanning_tree_joins_packed_groups(spark, detour):
    # neighbours are all of the own group; with the detour the neighbour graph is whole by heavier edges only
    rng = np.random.default_rng(6)
    p = np.r_[rng.normal(0, 0.01, (12, 2)), np.zeros((8, 2)), rng.normal(0, 0.01, (12, 2)) + [1, 0]]
    if detour:
        p = np.r_[p, [(0.5 + 0.4 * np.cos(a), 4 + np.sin(a)) for a in np.linspace(0, 6, 4)]]
    pts = point_table(spark, p)
    rows = density.spanning_tree(pts, nb.knn(pts, 6), 3).collect()
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
    core = np.sort(d, 1)[:, 3]
    w = np.maximum(d, np.maximum(core[:, None], core[None]))
    inside, total = {0}, 0.0
    while len(inside) < len(p):
        weight, j = min((w[i, j], j) for i in inside for j in set(range(len(p))) - inside)
        inside.add(j)
        total += weight
    assert len(rows) == len(p) - 1 and abs(sum(r.weight for r in rows) - total) < 1e-9
    assert connected_components(spark.createDataFrame(rows)).where("component = 0").count() == len(p)


def test_metrics(spark):
    same = spark.createDataFrame([(i, i % 3, i % 3) for i in range(12)], "pid long, y long, label long")
    assert ev.adjusted_rand(same).first().ari == 1
    assert ev.information_scores(same).first().nmi == pytest.approx(1)
    noise = same.withColumn("label", F.lit(-1).cast("long"))
    assert ev.adjusted_rand(noise).first().ari == 0
    assert ev.cluster_quality(noise).first().n_clusters == 0
    row = ev.outlier_scores(noise).first()
    assert row.tp == 8 and row.fp == 4 and row.recall == 1
    assert ev.adjusted_rand(same.withColumn("y", F.lit(None).cast("long"))).first().ari is None


def test_hard_threshold_rejects_unknown_centre(spark):
    with pytest.raises(ValueError):
        ed.hard_threshold(edge_table(spark, [(0, 1)]), "len_o", 1.0, "mode")


def test_radial_outliers_and_repaint(spark):
    p = [(0.1 * i, 0) for i in range(12)] + [(50, 50)]
    pts = point_table(spark, p, [0] * 13)
    assert [r.pid for r in bridges.radial_outliers(pts).where("outlier").collect()] == [12]
    painted = point_table(spark, p[:12], [0] * 5 + [1] + [0] * 6)
    assert {r.painted for r in bridges.repaint(painted, nb.knn(painted, 10)).collect()} == {0}


def test_first_mode_needs_two_clear_peaks(spark):
    from geoloom.operators import modes

    rng = np.random.default_rng(0)
    table = lambda x: edge_table(spark, [(i, i + 1) for i in range(len(x))], x)
    two = np.exp(np.r_[rng.normal(0, 0.15, 1000), rng.normal(2, 0.15, 1000)])
    assert 1.3 < modes.first_mode_cutoff(table(two)) < 5.5
    assert modes.first_mode_cutoff(table(np.exp(rng.normal(0, 0.2, 2000)))) is None
    assert modes.first_mode_cutoff(table(two[:39])) is None


def test_outer_hull_leaves_a_hole_out(spark):
    from geoloom.operators import topology as tp

    grid = np.array([(i, j) for i in range(5) for j in range(5)], float)
    t = dl.delaunay(po.plane(point_table(spark, grid)))
    edges = dl.edges_from_triangles(t).select("u", "v").withColumns({"len_o": F.lit(1.0), "len_p": F.lit(1.0)})
    hole = edges.where("u <> 12 and v <> 12")  # the middle point's edges are missing
    hull = {(r.u, r.v) for r in tp.outer_hull(t, edges, hole).collect()}
    rim = {(r.u, r.v) for r in dl.edges_from_triangles(t).where("n_triangles = 1").collect()}
    assert hull == rim and len(rim) == 16
    opened = hole.where("not (u = 0 and v = 1)")
    assert len({(r.u, r.v) for r in tp.outer_hull(t, edges, opened).collect()}) > 15 - 1


def test_sources(spark, tmp_path):
    import json

    from geoloom.sources import arrays

    np.savez(tmp_path / "one.npz", X=np.arange(6.0).reshape(3, 2), y_clean=np.array([0, 1, 1]))
    np.savez(tmp_path / "two.npz", X=np.ones((2, 3)))
    rows = arrays.read_npz(spark, str(tmp_path)).orderBy("dataset", "pid").collect()
    assert [(r.dataset, r.pid, r.x, r.y) for r in rows[:2]] == [("one", 0, [0.0, 1.0], 0), ("one", 1, [2.0, 3.0], 1)] and rows[-1].y is None
    (tmp_path / "one.json").write_text(json.dumps({"name": "one", "n_samples": 3, "target_range": [0.3, 0.7]}, indent=1))
    side = arrays.read_sidecars(spark, str(tmp_path / "*.json"), expected=1)
    assert side.first().dataset == "one" and side.first().n_samples == 3
    with pytest.raises(ValueError):
        arrays.read_sidecars(spark, str(tmp_path / "*.json"), expected=2)
    assert arrays.pending(spark.createDataFrame([("a",), ("b_1000d",), ("c",)], "dataset string"), spark.createDataFrame([("c",)], "dataset string")).collect()[0][0] == "a"


def test_fuzzy_memberships_sum_to_log2_k(spark):
    p = np.random.default_rng(8).normal(size=(80, 3))
    near = nb.knn(point_table(spark, p), 8)
    graph = nb.fuzzy_graph(near, 8).collect()
    assert all(0 < r.weight <= 1 + 1e-12 and r.u < r.v for r in graph)
    first = {(min(r.pid, r.nid), max(r.pid, r.nid)) for r in near.where("rank = 1").collect()}
    weight = {(r.u, r.v): r.weight for r in graph}
    assert all(abs(weight[e] - 1) < 1e-9 for e in first)
