"""Planar Delaunay triangulation in tiles.

The plane is cut into square tiles, so small that the fullest one stays within
bounds. Each tile triangulates its own points and a halo around it; a triangle
whose circumcircle lies inside what the tile saw is final and is kept by the
tiles that own its corners. Points all of whose triangles are final are done.
The others (the hull, wide gaps, thin regions beside dense ones) go into the next
round with larger tiles: a missing triangle has only such corners, so it is among
the triangles of these points alone. The last few meet in one task. What rounds
after the first find is kept if its circumcircle holds no point of any tile.

Points are moved by a billionth of the extent, by a hash of their id, so that
co-circular points are triangulated alike in every tile; triangles that are flat
before that are left out, and collinear input has none. Points of equal coordinates are one point, the smallest id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from geoloom.sources.shared import materialise

TILE_POINTS = 2_000


def circumcircles(p: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and squared radii of triangles ``t`` over points ``p``; infinite for flat ones."""
    a, b, c = (p[t[:, i]] for i in range(3))
    b, c = b - a, c - a
    d = 2 * (b[:, 0] * c[:, 1] - b[:, 1] * c[:, 0])
    with np.errstate(all="ignore"):
        bb, cc = (b**2).sum(1), (c**2).sum(1)
        u = np.c_[(c[:, 1] * bb - b[:, 1] * cc) / d, (b[:, 0] * cc - c[:, 0] * bb) / d]
    r = (u**2).sum(1)
    r[d == 0] = np.inf
    return a + u, r


def _turn(p: np.ndarray, u: np.ndarray, v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Twice the signed area of (u, v, q)."""
    return (p[v, 0] - p[u, 0]) * (q[1] - p[u, 1]) - (p[v, 1] - p[u, 1]) * (q[0] - p[u, 0])


def _in_circle(a: np.ndarray, b: np.ndarray, c: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Is q inside the circles through counter-clockwise corners; a determinant, which flat triangles don't upset."""
    ax, ay, bx, by, cx, cy = a[:, 0] - q[0], a[:, 1] - q[1], b[:, 0] - q[0], b[:, 1] - q[1], c[:, 0] - q[0], c[:, 1] - q[1]
    return (ax * ax + ay * ay) * (bx * cy - cx * by) - (bx * bx + by * by) * (ax * cy - cx * ay) + (cx * cx + cy * cy) * (ax * by - bx * ay) > 0


def bowyer_watson(p: np.ndarray) -> np.ndarray:
    """Triangles (rows of ascending point indices) of distinct points, by insertion.

    Outside every hull edge is a ghost triangle with a corner at infinity, which a
    point beyond that edge removes, so that flat triangles at the hull aren't lost.
    """
    n = len(p)
    order = np.random.default_rng(0).permutation(np.lexsort((p[:, 1], p[:, 0])))
    if n < 3:
        return np.zeros((0, 3), int)
    i, j = order[:2]
    bend = np.array([float(_turn(p, i, j, p[k])) for k in order[2:]])
    if not bend.any():
        return np.zeros((0, 3), int)
    at = int(np.flatnonzero(np.abs(bend) > 1e-9 * np.abs(bend).max())[0])
    k = order[2 + at]
    if bend[at] < 0:
        i, j = j, i
    tri = np.array([[i, j, k], [j, i, n], [k, j, n], [i, k, n]])
    far = np.r_[p, [[0.0, 0.0]]]  # a place for the corner at infinity, which no test uses
    for x in np.delete(order, [0, 1, 2 + at]):
        q = p[x]
        bad = _in_circle(far[tri[:, 0]], far[tri[:, 1]], far[tri[:, 2]], q)
        ghost = np.flatnonzero(tri[:, 2] == n)
        bad[ghost] = _turn(p, tri[ghost, 0], tri[ghost, 1], q) > 0
        if not bad.any():
            continue
        edge = tri[bad][:, [0, 1, 1, 2, 2, 0]].reshape(-1, 2)
        code = edge[:, 0] * (n + 1) + edge[:, 1]
        edge = edge[~np.isin(code, edge[:, 1] * (n + 1) + edge[:, 0])]
        new = np.c_[edge, np.full(len(edge), x)]
        for c in (0, 1):  # the corner at infinity comes last
            turn = new[:, c] == n
            new[turn] = np.roll(new[turn], 2 - c, axis=1)
        tri = np.r_[tri[~bad], new]
    return np.sort(tri[tri[:, 2] < n], axis=1)


def _moved(table: pa.Table) -> np.ndarray:
    return np.c_[table.column("jx").to_numpy(), table.column("jy").to_numpy()]


def _triangles(q: np.ndarray):
    t = bowyer_watson(q)
    mid, r2 = circumcircles(q, t)
    return t, mid, np.sqrt(r2)


def _solid(table: pa.Table, t: np.ndarray) -> np.ndarray:
    """Triangles that aren't flat in the points' own places."""
    p = np.c_[table.column("px").to_numpy(), table.column("py").to_numpy()]
    a, b = p[t[:, 1]] - p[t[:, 0]], p[t[:, 2]] - p[t[:, 0]]
    longest = np.maximum.reduce([(a**2).sum(1), (b**2).sum(1), ((a - b) ** 2).sum(1)])
    return np.abs(a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]) > 1e-8 * longest


def delaunay(points: DataFrame, tile_points: int = TILE_POINTS) -> DataFrame:
    """Triangles ``a, b, c`` (ids, ascending) of ``points`` (``pid, px, py``).

    Rows with a null or non-finite value take no part; fewer than three points
    give no rows.
    """
    good = " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c}) AND abs({c}) < double('inf')" for c in ("px", "py"))
    points = points.select("pid", F.col("px").cast("double"), F.col("py").cast("double")).where(good).where("pid is not null")
    points = materialise(points.groupBy("px", "py").agg(F.min("pid").alias("pid")), "points")
    box = points.agg(F.min("px"), F.min("py"), F.max("px"), F.max("py"), F.count("*")).first()
    n = box[4]
    if n < 3:
        return points.sparkSession.createDataFrame([], "a long, b long, c long")
    wide_, high = box[2] - box[0], box[3] - box[1]
    span = max(wide_, high, 1e-12)
    side = max((wide_ * high * tile_points / n) ** 0.5, span * tile_points / n, 1e-12)
    shift = lambda salt: (F.pmod(F.xxhash64("pid", F.lit(salt)), F.lit(1 << 20)) / (1 << 20) - 0.5) * F.lit(1e-9 * span)
    points = points.withColumns({"jx": F.col("px") + shift(1), "jy": F.col("py") + shift(2)})
    cell = lambda size: [F.floor((F.col(c) - low) / size).alias(t) for c, low, t in (("px", box[0], "tx"), ("py", box[1], "ty"))]
    while side > 1e-7 * span and points.groupBy(*cell(side)).count().agg(F.max("count")).first()[0] > 4 * tile_points:
        side /= 4

    found = materialise(_tiled(points, box, side), "triangles")
    final, rest, later = found.where("b is not null").distinct(), points, []
    open_ = found.where("b is null").select(F.col("a").alias("pid"))
    while True:
        rest = materialise(open_.join(rest, "pid"), "open_points")
        left = rest.count()
        side = max(4 * side, (wide_ * high * tile_points / max(left, 1)) ** 0.5)
        if left <= 4 * tile_points or side > span:
            break
        more = materialise(_tiled(rest, box, side), "triangles")
        later.append(more.where("b is not null"))
        open_ = more.where("b is null").select(F.col("a").alias("pid"))

    def remaining(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        t = bowyer_watson(_moved(table))
        s = np.sort(table.column("pid").to_numpy()[t[_solid(table, t)]], axis=1) if len(t) else np.zeros((0, 3), int)
        yield pa.RecordBatch.from_pandas(pd.DataFrame({"a": s[:, 0], "b": s[:, 1], "c": s[:, 2]}), preserve_index=False)

    # a few tiles' points, or the hull of all of them
    wide = rest.coalesce(1).mapInArrow(remaining, "a long, b long, c long")
    for more in later:
        wide = wide.union(more)
    wide = wide.distinct().join(final, ["a", "b", "c"], "left_anti")
    return materialise(final.union(_empty_circles(wide, points, box, n, tile_points)), "delaunay")


def _tiled(points: DataFrame, box, side: float) -> DataFrame:
    """The final triangles that tiles of this size find, and rows with only ``a`` for points with others."""
    halo = side / 2
    place = lambda c, low, shift: F.floor((F.col(c) - low + shift) / side)
    near = [F.struct(place("px", box[0], i * halo).alias("tx"), place("py", box[1], j * halo).alias("ty")) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    seen = points.withColumn("tile", F.explode(F.array_distinct(F.array(*near)))).select("pid", "px", "py", "jx", "jy", "tile.tx", "tile.ty")

    def triangulate(key, table):
        tx, ty = (k.as_py() for k in key)
        ids, p = table.column("pid").to_numpy(), np.c_[table.column("px").to_numpy(), table.column("py").to_numpy()]
        own = (np.floor((p[:, 0] - box[0]) / side) == tx) & (np.floor((p[:, 1] - box[1]) / side) == ty)
        t, mid, r = _triangles(_moved(table)) if own.any() else (np.zeros((0, 3), int), np.zeros((0, 2)), np.zeros(0))
        low = np.array([box[0] + tx * side, box[1] + ty * side])
        inside = ((mid - r[:, None] > low - halo) & (mid + r[:, None] < low + side + halo)).all(1)
        # corners of triangles that aren't final are open
        open_ = np.zeros(len(ids), bool)
        open_[np.unique(t[~inside])] = True
        touched = np.zeros(len(ids), bool)
        touched[np.unique(t)] = True
        # hull points of what the tile saw are open too
        edge, count = np.unique(np.sort(t[:, [0, 1, 1, 2, 0, 2]].reshape(-1, 2), axis=1), axis=0, return_counts=True) if len(t) else (np.zeros((0, 2), int), np.zeros(0, int))
        open_[np.unique(edge[count == 1])] = True
        open_ |= ~touched
        some = t[inside & own[t].any(1) & _solid(table, t)] if len(t) else t  # every tile that owns a corner keeps it
        some = np.sort(ids[some], axis=1) if len(some) else np.zeros((0, 3), int)
        rest = ids[open_ & own]
        null = [None] * len(rest)
        return pa.table({
            "a": pa.array([*some[:, 0].tolist(), *rest.tolist()], pa.int64()), "b": pa.array([*some[:, 1].tolist(), *null], pa.int64()), "c": pa.array([*some[:, 2].tolist(), *null], pa.int64()),
        })

    return seen.groupBy("tx", "ty").applyInArrow(triangulate, "a long, b long, c long")


def _empty_circles(triangles: DataFrame, points: DataFrame, box, n: int, tile_points: int) -> DataFrame:
    """The triangles whose circumcircle holds no point.

    One point of each of at most 32 x 32 cells rules most circles out; the rest
    are compared with the points of the smaller cells that they touch.
    """
    span = max(box[2] - box[0], box[3] - box[1], 1e-12)
    for c in "abc":
        triangles = triangles.join(points.select(F.col("pid").alias(c), F.col("jx").alias(f"{c}x"), F.col("jy").alias(f"{c}y")), c)
    bx, by, cx, cy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"), F.col("cx") - F.col("ax"), F.col("cy") - F.col("ay")
    d, bb, cc = 2 * (bx * cy - by * cx), bx * bx + by * by, cx * cx + cy * cy
    d = F.when(d != 0, d)
    circles = triangles.select("a", "b", "c", "ax", "ay", ((cy * bb - by * cc) / d).alias("ux"), ((bx * cc - cx * bb) / d).alias("uy")).where("ux is not null")
    circles = materialise(circles.select("a", "b", "c", (F.col("ax") + F.col("ux")).alias("mx"), (F.col("ay") + F.col("uy")).alias("my"), (F.col("ux") * F.col("ux") + F.col("uy") * F.col("uy")).alias("r2")), "circles")
    within = (F.pow(F.col("jx") - F.col("mx"), 2) + F.pow(F.col("jy") - F.col("my"), 2) < F.col("r2") * (1 - 1e-13)) & ~F.col("pid").isin(F.col("a"), F.col("b"), F.col("c"))
    at = lambda c, low, size: F.floor((F.col(c) - low) / size)
    few = points.groupBy(at("jx", box[0], span / 31).alias("gx"), at("jy", box[1], span / 31).alias("gy")).agg(F.min_by(F.struct("pid", "jx", "jy"), "pid").alias("p")).select("p.*")
    circles = materialise(circles.join(F.broadcast(few), within, "left_anti"), "circles")
    size = span / min(1024, max(1, int((n / tile_points) ** 0.5)))
    last = int(span / size) + 1  # moved points may lie a little outside the box
    reach = F.sqrt("r2") * (1 + 1e-9)
    to = lambda m, low: [F.greatest(F.least(F.floor((F.col(m) + k * reach - low) / size), F.lit(last)), F.lit(-1)) for k in (-1, 1)]
    touching = circles.withColumn("gx", F.explode(F.sequence(*to("mx", box[0])))).withColumn("gy", F.explode(F.sequence(*to("my", box[1]))))
    gap = lambda m, g, low: F.greatest(F.lit(0.0), F.col(g) * size + low - F.col(m), F.col(m) - (F.col(g) + 1) * size - low)
    touching = touching.where(F.pow(gap("mx", "gx", box[0]), 2) + F.pow(gap("my", "gy", box[1]), 2) <= F.col("r2") * (1 + 1e-9))
    celled = points.select("pid", "jx", "jy", at("jx", box[0], size).alias("gx"), at("jy", box[1], size).alias("gy"))
    held = touching.join(celled, ["gx", "gy"]).where(within).select("a", "b", "c").distinct()
    return circles.join(held, ["a", "b", "c"], "left_anti").select("a", "b", "c")


def triangle_sides(triangles: DataFrame) -> DataFrame:
    """``a, b, c, u, v, w``: each triangle's three sides (u < v) and the corner across."""
    sides = F.array(*(F.struct(F.col(x).alias("u"), F.col(y).alias("v"), F.col(z).alias("w")) for x, y, z in (("a", "b", "c"), ("a", "c", "b"), ("b", "c", "a"))))
    return triangles.withColumn("s", F.explode(sides)).select("a", "b", "c", "s.u", "s.v", "s.w")


def edges_from_triangles(triangles: DataFrame) -> DataFrame:
    """Distinct sides ``u, v`` and the number of triangles on each."""
    return triangle_sides(triangles).groupBy("u", "v").agg(F.count("*").alias("n_triangles"))


def gabriel_edges(points: DataFrame, triangles: DataFrame) -> DataFrame:
    """Delaunay edges whose diametral disc holds no point: no corner across sees the edge under an obtuse angle."""
    p = points.select("pid", "px", "py")
    at = lambda c: p.select(F.col("pid").alias(c), F.col("px").alias(f"{c}x"), F.col("py").alias(f"{c}y"))
    s = triangle_sides(triangles).join(at("u"), "u").join(at("v"), "v").join(at("w"), "w")
    dot = (F.col("ux") - F.col("wx")) * (F.col("vx") - F.col("wx")) + (F.col("uy") - F.col("wy")) * (F.col("vy") - F.col("wy"))
    return s.groupBy("u", "v").agg(F.min(dot).alias("least")).where("least >= 0").select("u", "v")
