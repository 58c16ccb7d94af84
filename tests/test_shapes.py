"""Sums over triangles, the principal plane and one-level cuts against numpy loops."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.operators import delaunay as dl, density as de, edges as ed, points as po, topology as tp


@pytest.fixture(scope="module")
def mesh(spark):
    rng = np.random.default_rng(21)
    p = np.c_[rng.random((80, 2)) * [4, 2], rng.random(80)]
    pts = spark.createDataFrame([(i, [float(c) for c in x], 0) for i, x in enumerate(p)], "pid long, x array<double>, y long")
    flat = po.plane(pts)
    triangles = spark.createDataFrame(dl.delaunay(flat).toArrow())
    edges = spark.createDataFrame(ed.measured(dl.edges_from_triangles(triangles), pts, flat).select("u", "v", "len_o", "len_p").toArrow())
    kept = edges.where("len_p < 0.75")
    labels = spark.createDataFrame([(i, 0 if x[0] < 2 else 40) for i, x in enumerate(p)], "pid long, comp long")
    rows = {(r.u, r.v): (r.len_o, r.len_p) for r in edges.collect()}
    return p, pts, flat, triangles, edges, kept, labels, [tuple(r) for r in triangles.select("a", "b", "c").collect()], rows, {(r.u, r.v) for r in kept.collect()}, {r.pid: r.comp for r in labels.collect()}


def sides(t):
    return [tuple(sorted(s)) for s in itertools.combinations(t, 2)]


def support_of(tri, rows, kept, comp):
    inside = {e: comp[e[0]] for e in rows if comp[e[0]] == comp[e[1]]}
    return {e: sum(1 for t in tri if e in sides(t) and all(f in inside for f in sides(t)) and all(f in kept for f in sides(t) if f != e)) for e in inside}


def area(a, b, c):
    s, r = b - a, c - a
    return np.sqrt(max((s @ s) * (r @ r) - (s @ r) ** 2, 0)) / 2


def test_sizes_and_areas(mesh):
    p, pts, flat, triangles, edges, _, _, tri, rows, _, _ = mesh
    for r in tp.simplex_sizes(triangles, edges).collect():
        assert (r.size_o, r.size_p) == tuple(max(rows[e][k] for e in sides((r.a, r.b, r.c))) for k in (0, 1))
    got = {(r.a, r.b, r.c): (r.area_o, r.area_p) for r in tp.triangle_areas(triangles, pts, flat).collect()}
    assert set(got) == set(tri)
    assert all(got[t] == pytest.approx((area(*p[list(t)]), area(*p[list(t), :2]))) for t in tri)


def test_support_layers_and_shapes(mesh):
    p, pts, flat, triangles, edges, kept, labels, tri, rows, kept_, comp = mesh
    want = support_of(tri, rows, kept_, comp)
    support = tp.triangle_support(triangles, kept, edges, labels)
    assert {(r.u, r.v): r.support for r in support.collect()} == want and {0, 1, 2} <= set(want.values())
    layer = {e for e, n in want.items() if n <= 1}
    for hops in (0, 1, 2):
        assert {(r.u, r.v) for r in tp.boundary_layer(support, hops).collect()} == layer
        touched = {x for e in layer for x in e}
        layer = layer | {e for e in want if touched & set(e)}
    inside = {e for e in kept_ if e in want}
    whole = [t for t in tri if all(e in inside for e in sides(t))]
    degree = {x: sum(1 for e in inside if x in e) for x in range(len(p))}
    rim = [e for e in inside if want[e] == 1 and min(degree[e[0]], degree[e[1]]) > 1]
    shape = tp.component_shape(triangles, tp.triangle_areas(triangles, pts, flat), support, kept)
    ratio = tp.triangle_edge_ratio(triangles, kept, labels)
    scores, ratios = {}, {r.comp: r.ratio for r in ratio.collect()}
    for r in shape.collect():
        own = [t for t in whole if comp[t[0]] == r.comp]
        a = sum(area(*p[list(t)]) for t in own), sum(area(*p[list(t), :2]) for t in own)
        length = [sum(rows[e][k] for e in rim if comp[e[0]] == r.comp) for k in (0, 1)]
        assert (r.n_triangles, r.area_o, r.area_p, r.rim_o, r.rim_p) == pytest.approx((len(own), *a, *length))
        assert (r.shape_o, r.shape_p) == pytest.approx(tuple(100 * np.sqrt(x) / y for x, y in zip(a, length)))
        assert ratios[r.comp] == pytest.approx(len(own) / sum(1 for e in inside if comp[e[0]] == r.comp))
        scores[r.comp] = r.shape_o
    assert set(scores) == {0, 40}
    least = sorted(scores.values())[-1]
    moments = tp.angular_moment(labels, kept, flat)
    passed = {r.pid for r in tp.eligible(labels, moments, shape, ratio, 1.1, least, 0.1).collect()}
    assert passed == {i for i in comp if scores[comp[i]] >= least} and len(passed) < len(p)
    assert tp.eligible(labels, moments, shape, ratio, 0.0, 0.0, 0.0).count() == 0


def test_principal_plane(mesh):
    p, pts, *_ = mesh
    centred = p - p.mean(0)
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    want = centred @ axes[:2].T
    got = np.array([(r.px, r.py) for r in po.principal_plane(pts).orderBy("pid").collect()])
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-8)
    loads = np.linalg.lstsq(centred, got, rcond=None)[0]
    assert all(c[np.abs(c).argmax()] > 0 for c in loads.T)


def test_density_cut(spark):
    forest = spark.createDataFrame([(0, 1, 1.0), (1, 2, 2.0), (2, 3, 5.0), (3, 4, 1.5), (5, 6, 9.0)], "u long, v long, weight double")
    pts = spark.range(7).select(F.col("id").alias("pid"))
    cut = lambda eps, least: [r.label for r in de.density_cut(pts, forest, eps, least).orderBy("pid").collect()]
    assert cut(2.0, 2) == [0, 0, 0, 1, 1, -1, -1] and cut(2.0, 3) == [0, 0, 0, -1, -1, -1, -1] and cut(10.0, 2) == [0, 0, 0, 0, 0, 1, 1]
