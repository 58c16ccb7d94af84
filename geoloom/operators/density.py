"""Hierarchical density baseline: mutual reachability, its minimum spanning forest, and cuts of it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from geoloom.operators.components import connected_components
from geoloom.operators.growth import components
from geoloom.operators.neighbors import BLOCK, _gaps, _matrix, cells, dealt_groups, sent_to
from geoloom.operators.points import labels_by_size
from geoloom.sources.shared import materialise


def mutual_reachability(near: DataFrame, samples: int) -> DataFrame:
    """``u, v, weight`` of the neighbour graph: the largest of the distance and both ends' distances to their ``samples``-th neighbour."""
    kth = near.where(F.col("rank") == samples)
    at = lambda c: kth.select(F.col("pid").alias(c), F.col("dist").alias(f"k{c}"))
    pair = near.select(F.least("pid", "nid").alias("u"), F.greatest("pid", "nid").alias("v"), "dist").groupBy("u", "v").agg(F.min("dist").alias("dist"))
    return pair.join(at("u"), "u").join(at("v"), "v").select("u", "v", F.greatest("dist", "ku", "kv").alias("weight"))


def spanning_forest(pts: DataFrame, edges: DataFrame) -> DataFrame:
    """Minimum spanning forest of ``u, v, weight`` by Boruvka rounds; ties go to the smaller edge.

    Every round each component takes its lightest outgoing edge and components
    join, so rounds grow with the logarithm of the number of points.
    """
    labels = materialise(pts.select("pid", F.col("pid").alias("comp")), "forest_comp")
    taken = None
    while True:
        at = lambda c, labels=labels: labels.select(F.col("pid").alias(c), F.col("comp").alias(f"c{c}"))
        out = edges.join(at("u"), "u").join(at("v"), "v").where("cu <> cv")
        best = out.select(F.explode(F.array("cu", "cv")).alias("comp"), F.struct("weight", "u", "v").alias("e"), "cu", "cv").groupBy("comp").agg(F.min_by(F.struct("e", "cu", "cv"), "e").alias("b"))
        best = materialise(best.select("b.e.u", "b.e.v", "b.e.weight", "b.cu", "b.cv").distinct(), "forest_step")
        if not best.limit(1).count():
            return taken if taken is not None else best.select("u", "v", "weight")
        new = best.select("u", "v", "weight")
        taken = materialise(new if taken is None else taken.union(new), "forest")
        merged = connected_components(best, "cu", "cv").select(F.col("node").alias("comp"), F.col("component").alias("to"))
        labels = materialise(labels.join(merged, "comp", "left").select("pid", F.coalesce("to", "comp").alias("comp")), "forest_comp")


def spanning_tree(pts: DataFrame, near: DataFrame, samples: int, block: int = BLOCK) -> DataFrame:
    """Minimum spanning tree ``u, v, weight`` of the mutual reachability of all pairs, by Boruvka rounds.

    An edge outside the neighbour graph weighs at least its ends' distances to
    their last neighbour. A component whose lightest edge in the graph is within
    that of all its points takes it; when there is none left, the others' points
    with nearer last neighbours meet all points. Ties go to edges of the graph, then to the smaller edge.
    """
    per = near.groupBy("pid").agg(F.max(F.when(F.col("rank") <= samples, F.col("dist"))).alias("core"), F.max("dist").alias("last"), F.max("rank").alias("n"))
    own = pts.where("x is not null and pid is not null")
    total = own.count()
    own = materialise(own.select("pid", "x").join(per, "pid").select("pid", "x", "core", F.when(F.col("n") < total - 1, F.col("last")).otherwise(float("inf")).alias("last")), "tree_points")
    at = lambda c: own.select(F.col("pid").alias(c), F.col("core").alias(f"k{c}"))
    pair = near.select(F.least("pid", "nid").alias("u"), F.greatest("pid", "nid").alias("v"), "dist").groupBy("u", "v").agg(F.min("dist").alias("dist"))
    edges = materialise(pair.join(at("u"), "u").join(at("v"), "v").select("u", "v", F.greatest("dist", "ku", "kv").alias("weight")), "tree_edges")
    labels = materialise(own.select("pid", F.col("pid").alias("comp")), "forest_comp")
    taken, space = edges.limit(0), None
    while True:
        of = lambda c, labels=labels: labels.select(F.col("pid").alias(c), F.col("comp").alias(f"c{c}"))
        out = edges.join(of("u"), "u").join(of("v"), "v").where("cu <> cv")
        best = out.select(F.explode(F.array("cu", "cv")).alias("comp"), F.struct("weight", "u", "v").alias("e")).groupBy("comp").agg(F.min("e").alias("e"))
        bound = own.join(labels, "pid").groupBy("comp").agg(F.min("last").alias("bound"))
        best = materialise(bound.join(best, "comp", "left").select("comp", "bound", "e.*"), "tree_best")
        sure = best.where("weight <= bound")
        if not sure.limit(1).count():
            space = space or cells(own, block)
            found = _lightest(space, own.join(labels, "pid"), best)
            sure = best.join(found, "comp", "left").select("comp", F.explode(F.array_compact(F.array(F.coalesce("e", F.when(F.col("weight").isNotNull(), F.struct("weight", "u", "v")))))).alias("e")).select("comp", "e.*")
        step = materialise(sure.select("u", "v", "weight").distinct(), "tree_step")
        if not step.limit(1).count():
            return taken
        taken = materialise(taken.union(step), "forest")
        joined = step.join(of("u"), "u").join(of("v"), "v")
        merged = connected_components(joined, "cu", "cv").select(F.col("node").alias("comp"), F.col("component").alias("to"))
        labels = materialise(labels.join(merged, "comp", "left").select("pid", F.coalesce("to", "comp").alias("comp")), "forest_comp")


def _lighter(best: np.ndarray, of: np.ndarray, q: tuple[np.ndarray, ...], t: tuple[np.ndarray, ...], centre: np.ndarray) -> None:
    """Set ``best`` (weight, u, v by component) to the lightest edges from points ``q`` to points ``t`` (``pid, comp, core, x``) of other components.

    ``of`` has the place in ``best`` of each point of ``q``, which come in the order of their components.
    """
    for i in range(0, len(of), 512):
        me, comp, core, x = (c[i : i + 512] for c in q)
        at = of[i : i + 512]
        weight = best["weight"][at]
        other = t[2] <= weight.max()
        if comp[0] == comp[-1]:
            other &= t[1] != comp[0]
        if not other.any():
            continue
        ids, comps, cores, y = (c[other] for c in t)
        z, w = x - centre, y - centre
        zz, ww = (z**2).sum(1), (w**2).sum(1)
        close = z @ w.T - ww / 2  # half of |z|^2 less the squared distance
        if comp[0] != comp[-1]:
            close[comp[:, None] == comps[None]] = -np.inf
        margin = (z.shape[1] + 8) * 2.0**-50 * (zz + ww.max()) + 1e-300
        for first in (True, False):  # where nothing bounds a component yet, the nearest point does
            if first:
                a = np.flatnonzero(np.isinf(weight) & np.isfinite(close).any(1))
                b = close[a].argmax(1)
            else:
                a, b = np.nonzero((close > -np.inf) & (close >= ((zz - weight**2) / 2 - margin)[:, None]) & (core <= weight)[:, None])
            for j in range(0, len(a), 32_768):
                m, o = a[j : j + 32_768], b[j : j + 32_768]
                gap = np.maximum(np.maximum(np.sqrt(((y[o] - x[m]) ** 2).sum(1)), core[m]), cores[o])
                u, v = np.minimum(me[m], ids[o]), np.maximum(me[m], ids[o])
                order = np.lexsort((v, u, gap, at[m]))
                order = order[np.r_[True, np.diff(at[m][order]) != 0]]
                for c, *e in zip(at[m][order].tolist(), gap[order].tolist(), u[order].tolist(), v[order].tolist()):
                    if tuple(e) < tuple(best[c].tolist()):
                        best[c] = tuple(e)
            weight = best["weight"][at]


def _lightest(space: tuple, own: DataFrame, best: DataFrame) -> DataFrame:
    """``comp, e``: each component's lightest edge (weight, u, v) to another, where it is lighter than that in ``best``.

    Points that may have one are packed into groups of neighbouring cells (``space``, of :func:`cells`), and the others
    are sent to each group once, those only whose cell may be near enough. The points of the component that asks most are groups of
    their own, which its other points aren't sent to. A task keeps one edge for each component.
    """
    placed, pivots, radius, blocks = space
    known = placed.join(own.select("pid", "comp", "core", "last"), "pid").join(best.select("comp", F.coalesce("weight", F.lit(float("inf"))).alias("most")), "comp")
    known = materialise(known, "tree_known")
    groups, of = dealt_groups(placed, pivots, blocks, BLOCK * (16 * pivots.shape[1] + 64))
    asking = known.where("last < most")
    top = asking.groupBy("comp").count().orderBy(F.desc("count"), "comp").first()
    top = top.comp if top else None
    asking = asking.withColumn("grp", of("cell", F.col("sub")) + F.when(F.col("comp") == top, 0).otherwise(groups))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                gap = _gaps(_matrix(part.column("x")), pivots)
                need, grp = gap <= (part.column("most").to_numpy()[:, None] + radius[None]) * (1 + 1e-9) + 1e-7 * (1 + gap), part.column("grp").to_numpy()
                for g in np.unique(grp).tolist():
                    cells_ = np.flatnonzero(need[grp == g].any(0))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells_), g)), pa.array(cells_)], ["grp", "part"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        grp, ready = -1, None

        def prepared() -> tuple:
            pid, comp, core, x, most = (np.concatenate(c) for c in zip(*held))
            order = np.argsort(comp, kind="stable")
            names, first, of_ = np.unique(comp[order], return_index=True, return_inverse=True)
            lightest = np.zeros(len(names), [("weight", float), ("u", np.int64), ("v", np.int64)])
            lightest["weight"] = most[order][first]
            lightest["u"] = lightest["v"] = np.iinfo(np.int64).min  # an edge of the same weight isn't lighter
            return names, of_.ravel(), lightest, tuple(c[order] for c in (pid, comp, core, x))

        def done() -> Iterator[pa.RecordBatch]:
            if ready:
                new = ready[2]["u"] > np.iinfo(np.int64).min
                yield pa.RecordBatch.from_arrays([pa.array(ready[0][new]), *(pa.array(ready[2][c][new]) for c in ("weight", "u", "v"))], ["comp", "weight", "u", "v"])

        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in ("grp", "kind", "cell")])
            cuts = np.r_[0, np.flatnonzero((np.diff(key) != 0).any(0)) + 1, batch.num_rows]
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                at, kind, cell = key[:, i].tolist()
                if at != grp:
                    yield from done()
                    grp, held, ready = at, [], None
                for part in (batch.slice(o, min(BLOCK, j - o)) for o in range(i, j, BLOCK)):
                    t = (*(part.column(c).to_numpy() for c in ("pid", "comp", "core")), _matrix(part.column("x")))
                    if kind == 0:
                        held.append((*t, part.column("most").to_numpy()))
                        continue
                    ready = ready or prepared()
                    held = []
                    _, of_, lightest, q = ready
                    gap = _gaps(q[3], pivots[cell : cell + 1])[:, 0]
                    weight = lightest["weight"][of_]
                    rows = np.flatnonzero((gap <= (weight + radius[cell]) * (1 + 1e-9) + 1e-7 * (1 + gap)) & (q[2] <= weight))
                    if len(rows):
                        _lighter(lightest, of_[rows], tuple(c[rows] for c in q), t, np.where(np.isfinite(pivots[cell]), pivots[cell], 0))
        yield from done()

    asked = materialise(asking.select("x", "most", "grp").mapInArrow(choose, "grp long, part long").distinct(), "asked_cells")
    others = sent_to(known.select("cell", "sub", "pid", "comp", "core", "x"), asked, blocks).where((F.col("grp") >= groups) | (F.col("comp") != top))
    routed = asking.select("grp", F.lit(0).alias("kind"), "cell", "pid", "comp", "core", "x", "most").unionByName(others.select("grp", F.lit(1).alias("kind"), "cell", "pid", "comp", "core", "x", F.lit(None).cast("double").alias("most")))
    found = routed.repartitionById(2 * groups, F.col("grp").cast("int")).sortWithinPartitions("grp", "kind", "cell").mapInArrow(search, "comp long, weight double, u long, v long")
    return found.groupBy("comp").agg(F.min(F.struct("weight", "u", "v")).alias("e"))


def density_cut(pts: DataFrame, forest: DataFrame, epsilon: float, min_cluster_size: int) -> DataFrame:
    """Clusters of the forest without edges over ``epsilon``; points of smaller ones are -1."""
    return labels_by_size(components(pts, forest.where(F.col("weight") <= epsilon).select("u", "v")), min_cluster_size)
