"""Cuts: short-path bridges, edge redundancy, articulation points and balanced bridges, from a rooted spanning forest.

The forest's edges, walked in both directions, form a tour of each tree; list
ranking by doubled pointers gives every arc its place in the tour, and with it each
point's parent, the interval of its subtree and its size. What is asked of subtrees
(exclusive or of labels, least and greatest place that an edge out of the tree
reaches) is summed up the forest by doubling as well. No task holds a component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from geoloom.operators.components import connected_components
from geoloom.operators.density import spanning_forest
from geoloom.operators.growth import labelled_edges
from geoloom.operators.neighbors import half_edges
from geoloom.operators.ranking import numbered, subtree_totals
from geoloom.sources.shared import materialise

FIRST, LAST = -(1 << 62), 1 << 62  # interval of a root


def short_path_bridges(edges: DataFrame, most_hops: int) -> DataFrame:
    """Edges without another path of fewer than ``most_hops`` edges between their ends.

    Paths grow by one join a hop, from each edge's own end, and keep each end that
    an edge has reached once. ``most_hops`` under 2 makes every edge a bridge.
    """
    edges = edges.select("u", "v").distinct()
    half = half_edges(edges)
    at = edges.select("u", "v", F.col("u").alias("here"))
    seen = at
    for hop in range(1, most_hops):
        step = at.join(half.select(F.col("src").alias("here"), "dst"), "here").where(~((F.col("here") == F.col("u")) & (F.col("dst") == F.col("v"))))
        step = step.select("u", "v", F.col("dst").alias("here")).distinct()
        at = step.join(seen, ["u", "v", "here"], "left_anti")
        seen = seen.union(at)
    reached = seen.where("here = v").select("u", "v").distinct()
    return edges.join(reached, ["u", "v"], "left_anti")


def rooted_forest(edges: DataFrame) -> DataFrame:
    """``id, parent, first, last, size``: a spanning forest of ``u, v``, rooted at the smallest point of each tree.

    ``first`` and ``last`` bound a point's subtree: of points of one tree, those and only
    those below it have their ``first`` between them. ``parent`` is null at a root.
    """
    edges = materialise(edges.select("u", "v").where("u <> v").distinct(), "graph")
    points = edges.select(F.explode(F.array("u", "v")).alias("pid")).distinct()
    tree = spanning_forest(points, edges.withColumn("weight", F.lit(0.0))).select("u", "v")
    roots = connected_components(tree).groupBy("component").agg(F.count("*").alias("n"))
    arcs = materialise(numbered(half_edges(tree), "src", "dst", name="arc"), "arcs")
    # around a point: the next arc out of it, or its first one again
    around = arcs.groupBy("src").agg(F.min("arc").alias("start"), F.max("arc").alias("end"))
    turned = arcs.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("arc").alias("back"))
    tour = arcs.join(turned, ["src", "dst"]).join(around.withColumnRenamed("src", "dst"), "dst")
    tour = tour.withColumn("next", F.when(F.col("back") == F.col("end"), F.col("start")).otherwise(F.col("back") + 1))
    # the tour ends where it would start again at the root
    starts = arcs.join(roots.select(F.col("component").alias("src")), "src").groupBy("src").agg(F.min("arc").alias("next")).select("next", F.lit(True).alias("stop"))
    now = tour.join(starts, "next", "left").select("arc", F.when(F.col("stop").isNull(), F.col("next")).alias("next"), F.when(F.col("stop").isNull(), 1).otherwise(0).cast("long").alias("left"))
    now = materialise(now, "tour")
    while now.where("next is not null").limit(1).count():
        ahead = now.select(F.col("arc").alias("next"), F.col("next").alias("far"), F.col("left").alias("more"))
        now = materialise(now.join(ahead, "next", "left").select("arc", F.col("far").alias("next"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left")), "tour")
    placed = materialise(arcs.join(now.select("arc", "left"), "arc").select("src", "dst", "left"), "tour_places")
    back = placed.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("left").alias("left_back"))
    # of both arcs of an edge the earlier one leads down
    down = placed.join(back, ["src", "dst"]).where(F.col("left") > F.col("left_back"))
    below = down.select(F.col("dst").alias("id"), F.col("src").alias("parent"), (-F.col("left")).alias("first"), (-F.col("left_back")).alias("last"), F.expr("(left - left_back + 1) div 2").alias("size"))
    tops = roots.select(F.col("component").alias("id"), F.lit(None).cast("long").alias("parent"), F.lit(FIRST).alias("first"), F.lit(LAST).alias("last"), F.col("n").alias("size"))
    return materialise(below.unionByName(tops), "rooted_forest")


def _outside(edges: DataFrame, forest: DataFrame) -> DataFrame:
    """Edges that aren't in the forest."""
    tree = forest.where("parent is not null").select(F.least("id", "parent").alias("u"), F.greatest("id", "parent").alias("v"))
    return edges.select("u", "v").where("u <> v").distinct().join(tree, ["u", "v"], "left_anti")


def cycle_labels(edges: DataFrame, forest: DataFrame) -> DataFrame:
    """``u, v, label``: 0 for bridges; equal labels for edges whose removal together cuts the graph.

    An edge outside the forest has a 64-bit hash as its label; a forest edge has the
    exclusive or of the labels of those whose cycle it lies on. Different labels
    agree by chance with a probability of about pairs / 2**64.
    """
    rest = materialise(_outside(edges, forest).withColumn("label", F.xxhash64("u", "v", F.lit("cycle"))), "outside")
    at = half_edges(rest, "label").groupBy(F.col("src").alias("id")).agg(F.bit_xor("label").alias("x"))
    own = forest.select("id", "parent").join(at, "id", "left").select("id", "parent", F.coalesce("x", F.lit(0)).alias("x"))
    tree = subtree_totals(own, label=("x", "bit_xor")).join(forest.select("id", "parent"), "id").where("parent is not null")
    return tree.select(F.least("id", "parent").alias("u"), F.greatest("id", "parent").alias("v"), "label").unionByName(rest)


def inside(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``comp, u, v`` of the edges with both ends in one component."""
    return labelled_edges(edges.select("u", "v"), labels).where("cu = cv").select(F.col("cu").alias("comp"), "u", "v")


def edge_redundancy(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``comp, u, v, redundancy``: edge-disjoint other paths between an edge's ends: 0, 1, or 2 for two or more."""
    own = materialise(inside(edges, labels), "inside")
    label = materialise(cycle_labels(own, rooted_forest(own)), "cycle_labels")
    alike = label.groupBy("label").agg((F.count("*") > 1).alias("shared"))
    level = F.when(F.col("label") == 0, 0).when(F.col("shared"), 1).otherwise(2)
    return own.join(label.join(alike, "label").select("u", "v", level.alias("redundancy")), ["u", "v"]).select("comp", "u", "v", "redundancy")


def redundancy_histogram(redundancy: DataFrame) -> DataFrame:
    """``comp, redundancy, n``: edges of each level in each component; 2 stands for two or more."""
    return redundancy.groupBy("comp", "redundancy").agg(F.count("*").alias("n"))


def redundancy_prune(redundancy: DataFrame, low: int, limit: int, majority: float) -> DataFrame:
    """Edges of redundancy under ``limit``, but for components where more than ``majority`` of the edges are under ``low``; both 2 at most."""
    if max(low, limit) > 2:
        raise ValueError("redundancy is told apart up to 2")
    share = redundancy.groupBy("comp").agg(F.avg((F.col("redundancy") < low).cast("double")).alias("share"))
    return redundancy.join(share.where(F.col("share") <= majority), "comp").where(F.col("redundancy") < limit).select("u", "v")


def blocks(edges: DataFrame, forest: DataFrame) -> DataFrame:
    """``id, block`` of every point but roots: the biconnected component of the edge to its parent, named by a point.

    Forest edges belong together if an edge outside the forest joins their subtrees
    side by side, or leaves the lower one's for a point that is not below the
    upper one's upper end.
    """
    rest = materialise(half_edges(_outside(edges, forest)), "outside")
    place = forest.select(F.col("id").alias("dst"), F.col("first").alias("at"))
    reach = rest.join(place, "dst").groupBy(F.col("src").alias("id")).agg(F.min("at").alias("low"), F.max("at").alias("high"))
    own = forest.join(reach, "id", "left").select("id", "parent", F.least("low", "first").alias("low"), F.greatest("high", "first").alias("high"))
    spans = materialise(subtree_totals(own, low=("low", "min"), high=("high", "max")), "spans")
    bounds = lambda c: forest.select(F.col("id").alias(c), F.col("first").alias(f"first_{c}"), F.col("last").alias(f"last_{c}"))
    across = rest.where("src < dst").join(bounds("src"), "src").join(bounds("dst"), "dst").where("last_src < first_dst or last_dst < first_src").select(F.col("src").alias("u"), F.col("dst").alias("v"))
    upper = forest.where("parent is not null").select(F.col("id").alias("parent"), "first", "last")
    along = forest.where("parent is not null").select("id", "parent").join(upper, "parent").join(spans, "id").where("low < first or high > last").select(F.col("id").alias("u"), F.col("parent").alias("v"))
    found = connected_components(across.unionByName(along)).select(F.col("node").alias("id"), F.col("component").alias("block"))
    return forest.where("parent is not null").select("id").join(found, "id", "left").select("id", F.coalesce("block", "id").alias("block"))


def articulation_points(edges: DataFrame) -> DataFrame:
    """``comp, pid, second, n``: points whose removal splits their component, with the size of the second largest part and of the component."""
    edges = materialise(edges.select("u", "v").where("u <> v").distinct(), "graph")
    forest = rooted_forest(edges)
    block = materialise(blocks(edges, forest), "blocks")
    whole = connected_components(edges).select(F.col("node").alias("pid"), F.col("component").alias("comp"))
    sizes = forest.where("parent is null").select(F.col("id").alias("comp"), F.col("size").alias("n"))
    below = forest.where("parent is not null").join(block, "id").groupBy(F.col("parent").alias("pid"), "block").agg(F.sum("size").alias("part"))
    mine = block.select(F.col("id").alias("pid"), F.col("block").alias("own"))
    apart = below.join(mine, "pid", "left").where("own is null or block <> own").select("pid", "block", "part")
    apart = materialise(apart.join(whole, "pid").join(sizes, "comp"), "parts")
    # what is left of the component on the parent's side; a root has none
    above = apart.groupBy("pid", "comp", "n").agg(F.sum("part").alias("s")).select("pid", F.lit(None).cast("long").alias("block"), (F.col("n") - 1 - F.col("s")).alias("part"), "comp", "n").where("part > 0")
    parts = materialise(apart.select("pid", "block", "part", "comp", "n").unionByName(above), "all_parts")
    top = parts.groupBy("pid").agg(F.max(F.struct("part", F.coalesce("block", F.lit(FIRST)).alias("b"))).alias("t"))
    rest = parts.join(top, "pid").where(F.coalesce("block", F.lit(FIRST)) != F.col("t.b"))
    return rest.groupBy("comp", "pid", "n").agg(F.max("part").alias("second")).select("comp", "pid", "second", "n")


def vertex_cut(edges: DataFrame, labels: DataFrame, min_points: int = 10, fraction: float = 0.2) -> DataFrame:
    """``comp, pid``: the point whose removal splits each component best.

    It counts if the second largest part has ``max(min_points, ceil(fraction * n))``
    points. The largest second part wins, then the smallest id. Components that no
    single point splits like that give no row.
    """
    least = F.greatest(F.lit(min_points), F.ceil(fraction * F.col("n")))
    fit = articulation_points(inside(edges, labels)).where(F.col("second") >= least)
    best = fit.groupBy("comp").agg(F.min(F.struct(-F.col("second"), "pid")).alias("b")).select(F.col("b.pid").alias("pid"))
    return best.join(labels.select("pid", "comp"), "pid").select("comp", "pid")


def balanced_bridges(edges: DataFrame, labels: DataFrame, min_points: int, fraction: float, removable: DataFrame | None = None) -> DataFrame:
    """``comp, u, v``: the minimum cuts of one edge that leave ``max(min_points, ceil(fraction * n))`` points on both sides.

    Cuts are those of the whole component, whichever others are made. With
    ``removable`` (``u, v``) only those edges may be cut.
    """
    own = materialise(inside(edges, labels), "inside")
    forest = rooted_forest(own)
    bridges = cycle_labels(own, forest).where("label = 0").select("u", "v")
    side = forest.where("parent is not null").select(F.least("id", "parent").alias("u"), F.greatest("id", "parent").alias("v"), F.col("size").alias("below"))
    n = labels.join(own.select(F.explode(F.array("u", "v")).alias("pid")).distinct(), "pid").groupBy("comp").agg(F.count("*").alias("n"))
    least = F.greatest(F.lit(min_points), F.ceil(fraction * F.col("n")))
    cut = own.join(bridges, ["u", "v"]).join(side, ["u", "v"]).join(n, "comp").where((F.col("below") >= least) & (F.col("n") - F.col("below") >= least))
    if removable is not None:
        cut = cut.join(removable.select("u", "v"), ["u", "v"], "left_semi")
    return cut.select("comp", "u", "v")


def without_points(edges: DataFrame, cut: DataFrame) -> DataFrame:
    """Edges that touch none of the cut points."""
    gone = cut.select("pid").distinct()
    return edges.join(gone.withColumnRenamed("pid", "u"), "u", "left_anti").join(gone.withColumnRenamed("pid", "v"), "v", "left_anti")


def contracted(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges between components as one weighted edge a pair: ``cu, cv, capacity``; :func:`node_weights` has the nodes."""
    pair = labelled_edges(edges.select("u", "v"), labels).where("cu <> cv")
    return pair.groupBy(F.least("cu", "cv").alias("cu"), F.greatest("cu", "cv").alias("cv")).agg(F.count("*").alias("capacity"))


def node_weights(labels: DataFrame) -> DataFrame:
    """``comp, weight``: the number of points that a contracted node stands for."""
    return labels.groupBy("comp").agg(F.count("*").alias("weight"))
