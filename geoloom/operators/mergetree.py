"""The merge tree of a spanning tree, its condensed form, and the clusters chosen from it.

The merge tree has a node for each edge, in the order of weights: the edge joins
what lighter edges have joined. A problem of too many edges is split at a weight in
its middle: components of the lighter edges become problems of their own, and stand
as single nodes in the problem of the heavier ones. Halving goes on in rounds until
problems fit into tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from geoloom.operators.components import connected_components
from geoloom.operators.ranking import ends_of_paths, numbered
from geoloom.sources.shared import materialise

PROBLEM = 50_000  # edges of one problem


def merge_tree(pts: DataFrame, forest: DataFrame, most: int = PROBLEM) -> tuple[DataFrame, DataFrame]:
    """Nodes ``node, weight, size, a, b, size_a, size_b`` of the merge tree, and ``pid, leaf``: the number of each point.

    ``forest`` has ``u, v, weight`` and no cycles; ties go to the smaller edge. Nodes are
    numbered by that order, points after them; ``a, b`` are the joined nodes or points.
    """
    edges = materialise(numbered(forest.select("weight", "u", "v"), "weight", "u", "v", name="rank"), "ranked_edges")
    n = edges.count()
    leaves = materialise(numbered(pts.select("pid"), "pid").select("pid", (F.col("place") + n).alias("leaf")), "leaves")
    at = lambda c, to: leaves.select(F.col("pid").alias(c), F.col("leaf").alias(to))
    open_ = edges.join(at("u", "a"), "u").join(at("v", "b"), "v").select("rank", "weight", "a", "b", F.lit(1).cast("long").alias("n_a"), F.lit(1).cast("long").alias("n_b"), F.lit(n - 1).cast("long").alias("problem"))
    open_ = materialise(open_, "problems")
    while True:
        sizes = open_.groupBy("problem").agg(F.count("*").alias("n"), F.percentile_approx("rank", 0.5).alias("middle")).where(F.col("n") > most)
        sizes = materialise(sizes, "large_problems")
        if not sizes.limit(1).count():
            break
        split = open_.join(sizes.select("problem", "middle"), "problem", "left").withColumn("light", F.col("rank") <= F.col("middle"))
        split = materialise(split.drop("middle"), "split")
        light = split.where("light")
        comp = materialise(connected_components(light, "a", "b"), "light_parts")
        top = light.join(comp.withColumnRenamed("node", "a"), "a").groupBy("component").agg(F.max("rank").alias("top"))
        nodes = light.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("n_a").alias("n")), F.struct(F.col("b").alias("node"), F.col("n_b").alias("n")))).alias("s")).select("s.*").distinct()
        sized = nodes.join(comp, "node").groupBy("component").agg(F.sum("n").alias("size"))
        found = materialise(comp.join(top, "component").join(sized, "component").select("node", "top", "size"), "light_tops")
        as_ = lambda c: found.select(F.col("node").alias(c), F.col("top").alias(f"top_{c}"), F.col("size").alias(f"size_{c}"))
        down = light.join(as_("a"), "a").select("rank", "weight", "a", "b", "n_a", "n_b", F.col("top_a").alias("problem"))
        # nodes of a problem that wasn't split have no light part
        up = split.where("light is null or not light").join(as_("a"), "a", "left").join(as_("b"), "b", "left")
        up = up.select("rank", "weight", F.coalesce("top_a", "a").alias("a"), F.coalesce("top_b", "b").alias("b"), F.coalesce("size_a", "n_a").alias("n_a"), F.coalesce("size_b", "n_b").alias("n_b"), "problem")
        open_ = materialise(down.unionByName(up), "problems")

    def solve(t: pa.Table) -> pa.Table:
        """Joins in the order of ranks; problems share no node."""
        order = np.argsort(t.column("rank").to_numpy())
        rank, weight, a, b, n_a, n_b = (t.column(c).to_numpy()[order].tolist() for c in ("rank", "weight", "a", "b", "n_a", "n_b"))
        parent: dict[int, int] = {}
        size = dict(zip(a + b, n_a + n_b))

        def find(x: int) -> int:
            while (y := parent.get(x, x)) != x:
                parent[x] = parent.get(y, y)
                x = y
            return x

        left, right = [], []
        for r, x, y in zip(rank, a, b):
            x, y = find(x), find(y)
            left.append(x)
            right.append(y)
            # a node that stands for a part has the number of that part's last edge, which isn't joined here
            parent[x] = parent[y] = r
            size[r] = size[x] + size[y]
        pick = lambda c: pa.array([size[x] for x in c], pa.int64())
        return pa.table({"node": pa.array(rank, pa.int64()), "weight": pa.array(weight, pa.float64()), "size": pick(rank), "a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64()), "size_a": pick(left), "size_b": pick(right)})

    tasks = max(1, -(-n // most))
    solved = open_.groupBy(F.pmod(F.xxhash64("problem"), F.lit(tasks)).alias("task")).applyInArrow(solve, "node long, weight double, size long, a long, b long, size_a long, size_b long")
    return materialise(solved, "merge_tree"), leaves


def condensed(tree: DataFrame, leaves: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Clusters ``cluster, parent, birth, size, stability`` and points ``pid, cluster, left_at`` of the condensed tree.

    Levels are 1 / weight. A node with ``least`` points starts a cluster where the one
    that it is joined with has as many, or at the top; else it goes on with its
    parent's. Points leave at the last node of ``least`` points above them; those without one have no row.
    """
    level = lambda w: 1 / F.greatest(w, F.lit(1e-12))
    kids = tree.select(F.col("node").alias("parent"), level(F.col("weight")).alias("level"), (F.col("size") >= least).alias("big_parent"), F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("size_a").alias("n"), F.col("size_b").alias("other")), F.struct(F.col("b").alias("id"), F.col("size_b").alias("n"), F.col("size_a").alias("other")))).alias("s")).select("parent", "level", "big_parent", "s.*")
    kids = materialise(kids, "merge_links")
    big = tree.where(F.col("size") >= least).select(F.col("node").alias("id"), "size", level(F.col("weight")).alias("own")).join(kids.select("id", "parent", "level", "other"), "id", "left")
    big = materialise(big.withColumn("starts", F.col("parent").isNull() | (F.col("other") >= least)), "big_nodes")
    # nodes to the start of their cluster
    flags = big.select(F.col("id").alias("parent"), F.col("starts").alias("final"))
    links = big.where("not starts").select("id", "parent").join(flags, "parent").select("id", F.col("parent").alias("to"), "final")
    own = big.where("starts").select("id", F.col("id").alias("to"))
    start = materialise(ends_of_paths(links).unionByName(own).withColumnRenamed("to", "cluster"), "cluster_starts")
    # points to the node that they leave
    small = kids.where(F.col("n") < least).join(kids.select(F.col("id").alias("parent"), F.lit(True).alias("inner")), "parent", "left")
    out = ends_of_paths(small.select("id", F.col("parent").alias("to"), (F.col("big_parent") | F.col("inner").isNull()).alias("final")))
    points = leaves.join(out.withColumnRenamed("id", "leaf"), "leaf").join(big.select(F.col("id").alias("to"), F.col("own").alias("left_at")), "to").join(start.withColumnRenamed("id", "to"), "to").select("pid", "cluster", "left_at")
    points = materialise(points, "condensed_points")
    born = big.where("starts").select(F.col("id").alias("cluster"), "size", F.coalesce("level", F.lit(0.0)).alias("birth"), F.col("parent").alias("id"))
    clusters = born.join(start.withColumnRenamed("cluster", "above"), "id", "left").select("cluster", F.col("above").alias("parent"), "birth", "size")
    clusters = materialise(clusters, "condensed_clusters")
    gone = points.groupBy("cluster").agg(F.sum("left_at").alias("s1")).join(clusters.where("parent is not null").groupBy(F.col("parent").alias("cluster")).agg(F.sum(F.col("birth") * F.col("size")).alias("s2")), "cluster", "full")
    stability = F.coalesce("s1", F.lit(0.0)) + F.coalesce("s2", F.lit(0.0)) - F.col("birth") * F.col("size")
    return clusters.join(gone, "cluster", "left").select("cluster", "parent", "birth", "size", stability.alias("stability")), points


FEW = 1_000_000  # clusters that one task chooses from


def _excess_of_mass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``cluster, label`` of all clusters ``cluster, parent, stability``: up from the leaves for their worth, down again for the topmost picks."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    t = pa.Table.from_batches(batches)
    order = np.argsort(t.column("cluster").to_numpy())  # sums in a fixed order
    cluster, parent, stability = (t.column(c).to_numpy()[order] for c in ("cluster", "parent", "stability"))
    up = np.searchsorted(cluster, parent)
    up = np.where(cluster[np.minimum(up, len(cluster) - 1)] == parent, up, -1).tolist()
    waiting = np.bincount([x for x in up if x >= 0], minlength=len(cluster)).tolist()
    inner, below, own = [n > 0 for n in waiting], [0.0] * len(up), stability.tolist()
    ready = [i for i, n in enumerate(waiting) if not n]
    for i in ready:  # grows at its end
        if up[i] >= 0:
            below[up[i]] += max(below[i], own[i]) if inner[i] else own[i]
            waiting[up[i]] -= 1
            if not waiting[up[i]]:
                ready.append(up[i])
    label = [-1] * len(up)
    for i in reversed(ready):
        label[i] = label[up[i]] if up[i] >= 0 and label[up[i]] >= 0 else i if not inner[i] or below[i] <= own[i] else -1
    label = np.array(label)
    yield pa.RecordBatch.from_arrays([pa.array(cluster[label >= 0]), pa.array(cluster[label[label >= 0]])], ["cluster", "label"])


def chosen(clusters: DataFrame, method: str = "eom", few: int = FEW) -> DataFrame:
    """``cluster, label``: the chosen cluster that each cluster belongs to; clusters outside any have no row.

    ``eom``: from the leaves up, a cluster is chosen unless its children's choices are
    worth more; up to ``few`` clusters in one task, more in as many rounds as the tree
    is deep. ``leaf``: clusters without children. Tops of trees are never chosen.
    """
    if method not in ("eom", "leaf"):
        raise ValueError(f"unknown method: {method}")
    state = materialise(clusters.where("parent is not null").select("cluster", "parent", "stability"), "choice")
    if method == "eom" and state.count() <= few:
        return materialise(state.repartition(1).mapInArrow(_excess_of_mass, "cluster long, label long"), "choices")
    parents = state.select(F.col("parent").alias("cluster")).distinct()
    inner = materialise(state.join(parents, "cluster", "left_semi"), "inner_clusters")
    done = materialise(state.join(parents, "cluster", "left_anti").select("cluster", "parent", F.col("stability").alias("worth"), F.lit(True).alias("pick")), "choices")
    while method == "eom" and inner.limit(1).count():
        waiting = inner.select("cluster").join(inner.select(F.col("parent").alias("cluster")), "cluster", "left_semi").distinct()
        ready = inner.join(waiting, "cluster", "left_anti").join(done.groupBy(F.col("parent").alias("cluster")).agg(F.sum("worth").alias("below")), "cluster")
        ready = ready.select("cluster", "parent", F.greatest("below", "stability").alias("worth"), (F.col("below") <= F.col("stability")).alias("pick"))
        done = materialise(done.unionByName(ready), "choices")
        inner = materialise(inner.join(done.select("cluster"), "cluster", "left_anti"), "inner_clusters")
    # the topmost pick on the way up, by doubling
    if method == "leaf":
        return done.select("cluster", F.col("cluster").alias("label"))
    up = done.select("cluster", F.col("parent").alias("up"), F.when(F.col("pick"), F.col("cluster")).alias("label"))
    up = materialise(up, "way_up")
    while True:
        above = up.select(F.col("cluster").alias("up"), F.col("up").alias("far"), F.col("label").alias("higher"))
        now = materialise(up.join(above, "up", "left").select("cluster", F.col("far").alias("up"), F.coalesce("higher", "label").alias("label")), "way_up")
        if not now.where("up is not null").limit(1).count():
            return now.where("label is not null").select("cluster", "label")
        up = now


def density_labels(pts: DataFrame, forest: DataFrame, least: int, method: str = "eom", most: int = PROBLEM) -> DataFrame:
    """``pid, label, level``: clusters of the condensed tree, named by their smallest point; -1 is noise; the level at which a point left."""
    tree, leaves = merge_tree(pts, forest, most)
    clusters, points = condensed(tree, leaves, least)
    mine = materialise(points.join(chosen(clusters, method), "cluster"), "chosen_points")
    named = mine.groupBy("label").agg(F.min("pid").alias("name"))
    mine = mine.join(named, "label").select("pid", "name")
    out = pts.select("pid").join(points.select("pid", F.col("left_at").alias("level")), "pid", "left").join(mine, "pid", "left")
    return out.select("pid", F.coalesce("name", F.lit(-1).cast("long")).alias("label"), "level")
