"""Shape of components: loops, neighbours, angles, triangles."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from geoloom.functions.vectors import quartiles
from geoloom.operators.components import connected_components
from geoloom.operators.delaunay import triangle_sides
from geoloom.operators.growth import component_counts, labelled_edges
from geoloom.operators.neighbors import half_edges


def component_topology(labels: DataFrame, edges: DataFrame, least_edges: int) -> DataFrame:
    """Edges, points, their ratio, mean degree, cycle rank and cycles per point of components with at least so many edges."""
    e, v = F.col("n_edges"), F.col("n_points")
    return component_counts(labels, edges).where(e >= least_edges).select(
        "comp", "n_edges", "n_points", (e / v).alias("edges_per_point"), (2 * e / v).alias("mean_degree"), (e - v + 1).alias("cycle_rank"), ((e - v + 1) / v).alias("cycles_per_point")
    )


def short_neighbours(labels: DataFrame, edges: DataFrame, factor: float = 1.5) -> DataFrame:
    """Per component, quartiles and mean over its points of two counts of close neighbours.

    Common: edges within the component's median nearest length. Relative: edges
    within ``factor`` times the larger nearest length of the ends. Edges are those
    with both ends inside.
    """
    inside = labelled_edges(edges, labels).where("cu = cv").withColumnRenamed("cu", "comp")
    half = half_edges(inside, "comp", "len_o")
    near = half.groupBy("src", "comp").agg(F.min("len_o").alias("near"))
    common = near.groupBy("comp").agg(F.percentile("near", F.lit(0.5)).alias("radius"))
    side = near.select(F.col("src").alias("dst"), F.col("near").alias("far_near"))
    each = half.join(near, ["src", "comp"]).join(side, "dst").join(common, "comp")
    counts = each.groupBy("comp", "src").agg(
        F.sum((F.col("len_o") <= F.col("radius")).cast("int")).alias("common"),
        F.sum((F.col("len_o") <= factor * F.greatest("near", "far_near")).cast("int")).alias("relative"),
    )
    out = counts.groupBy("comp").agg(*(a for c in ("common", "relative") for a in (quartiles(F.col(c)).alias(c[0]), F.avg(c).alias(f"{c}_mean"))))
    return out.select("comp", *(x for c in ("common", "relative") for x in (F.col(c[0])[0].alias(f"{c}_q25"), F.col(c[0])[1].alias(f"{c}_median"), F.col(c[0])[2].alias(f"{c}_q75"), f"{c}_mean")))


def angular_moment(labels: DataFrame, edges: DataFrame, flat: DataFrame, factor: float = 1.5) -> DataFrame:
    """Second angular moment of each point's close neighbours, as per-component quartiles.

    Hard: the length of the mean of exp(2i * angle) over edges within ``factor``
    times the point's nearest length. Weighted: over all edges with weights
    exp(-(length / (2 * nearest))^2). Close to 1 on a line, to 0 in a blob.
    """
    inside = labelled_edges(edges, labels).where("cu = cv").withColumnRenamed("cu", "comp")
    half = half_edges(inside, "comp", "len_o")
    near = half.groupBy("src").agg(F.min("len_o").alias("near"))
    at = lambda c, i: flat.select(F.col("pid").alias(c), F.col("px").alias(f"x{i}"), F.col("py").alias(f"y{i}"))
    each = half.join(near, "src").join(at("src", 1), "src").join(at("dst", 2), "dst")
    angle = 2 * F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1"))
    each = each.select("comp", "src", F.cos(angle).alias("c"), F.sin(angle).alias("s"), (F.col("len_o") <= factor * F.col("near")).cast("double").alias("h"), F.exp(-F.pow(F.col("len_o") / F.greatest(2 * F.col("near"), F.lit(1e-12)), 2)).alias("w"))
    point = each.groupBy("comp", "src").agg(*((F.sqrt(F.pow(F.sum(F.col(w) * F.col("c")), 2) + F.pow(F.sum(F.col(w) * F.col("s")), 2)) / F.greatest(F.sum(w), F.lit(1e-12))).alias(n) for w, n in (("h", "hard"), ("w", "weighted"))))
    out = point.groupBy("comp").agg(*(a for n in ("hard", "weighted") for a in (quartiles(F.col(n)).alias(n[0]), F.avg(n).alias(f"{n}_mean"))))
    return out.select("comp", *(x for n in ("hard", "weighted") for x in (F.col(n[0])[0].alias(f"{n}_q25"), F.col(n[0])[1].alias(f"{n}_median"), F.col(n[0])[2].alias(f"{n}_q75"), f"{n}_mean")))


def simplex_sizes(triangles: DataFrame, all_edges: DataFrame) -> DataFrame:
    """The longest side of each triangle in both spaces."""
    sides = triangle_sides(triangles).join(all_edges.select("u", "v", "len_o", "len_p"), ["u", "v"])
    return sides.groupBy("a", "b", "c").agg(F.max("len_o").alias("size_o"), F.max("len_p").alias("size_p"))


def triangle_areas(triangles: DataFrame, pts: DataFrame, flat: DataFrame) -> DataFrame:
    """Area of each triangle in the projection and in the original space (from the Gram determinant)."""
    at = lambda c: pts.select(F.col("pid").alias(c), F.col("x").alias(f"x{c}")).join(flat.select(F.col("pid").alias(c), F.col("px").alias(f"px{c}"), F.col("py").alias(f"py{c}")), c)
    t = triangles.join(at("a"), "a").join(at("b"), "b").join(at("c"), "c")
    cross = (F.col("pxb") - F.col("pxa")) * (F.col("pyc") - F.col("pya")) - (F.col("pyb") - F.col("pya")) * (F.col("pxc") - F.col("pxa"))
    s, r = F.zip_with("xb", "xa", lambda p, q: p - q), F.zip_with("xc", "xa", lambda p, q: p - q)
    dots = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: x * y), F.lit(0.0), lambda z, x: z + x)
    t = t.withColumns({"s": s, "r": r}).withColumns({"ss": dots("s", "s"), "rr": dots("r", "r"), "sr": dots("s", "r")})
    return t.select("a", "b", "c", (F.abs(cross) / 2).alias("area_p"), (F.sqrt(F.greatest(F.col("ss") * F.col("rr") - F.col("sr") * F.col("sr"), F.lit(0.0))) / 2).alias("area_o"))


def triangle_support(triangles: DataFrame, retained: DataFrame, all_edges: DataFrame, labels: DataFrame) -> DataFrame:
    """For every edge inside a component, the number of its triangles inside that component whose two other sides are retained."""
    inside = labelled_edges(all_edges.select("u", "v"), labels).where("cu = cv").select("u", "v", F.col("cu").alias("comp"))
    kept = retained.select("u", "v", F.lit(1).alias("kept"))
    sides = triangle_sides(triangles).join(inside, ["u", "v"]).join(kept, ["u", "v"], "left").fillna(0, ["kept"])
    per = sides.groupBy("a", "b", "c").agg(F.count("*").alias("n"), F.sum("kept").alias("all_kept")).where("n = 3")
    held = sides.join(per, ["a", "b", "c"]).where(F.col("all_kept") - F.col("kept") == 2).groupBy("u", "v").agg(F.count("*").alias("support"))
    return inside.join(held, ["u", "v"], "left").fillna(0, ["support"])


def boundary_layer(support: DataFrame, hops: int) -> DataFrame:
    """Edges inside a component with at most one supporting triangle, and those within ``hops`` incident layers of them."""
    layer = support.where("support <= 1").select("u", "v")
    for _ in range(hops):
        touched = layer.select(F.explode(F.array("u", "v")).alias("p")).distinct()
        more = support.select("u", "v", F.explode(F.array("u", "v")).alias("p")).join(touched, "p", "left_semi").select("u", "v")
        layer = layer.union(more).distinct()
    return layer


def component_shape(triangles: DataFrame, areas: DataFrame, support: DataFrame, retained: DataFrame) -> DataFrame:
    """Area, boundary length and 100 * sqrt(area) / length of each component in both spaces.

    A triangle counts where all its sides are retained inside the component; the
    boundary is the retained edges of support 1 between points of degree over 1.
    """
    kept = retained.select("u", "v", "len_o", "len_p").join(support, ["u", "v"])
    sides = triangle_sides(triangles).join(kept.select("u", "v", "comp"), ["u", "v"])
    whole = sides.groupBy("a", "b", "c").agg(F.count("*").alias("n"), F.min("comp").alias("comp")).where("n = 3").join(areas, ["a", "b", "c"])
    area = whole.groupBy("comp").agg(F.count("*").alias("n_triangles"), F.sum("area_o").alias("area_o"), F.sum("area_p").alias("area_p"))
    degree = half_edges(kept).groupBy("src").agg(F.count("*").alias("d")).where("d > 1").select("src")
    rim = kept.where("support = 1").join(degree.withColumnRenamed("src", "u"), "u", "left_semi").join(degree.withColumnRenamed("src", "v"), "v", "left_semi")
    length = rim.groupBy("comp").agg(F.sum("len_o").alias("rim_o"), F.sum("len_p").alias("rim_p"))
    out = area.join(length, "comp", "left")
    score = lambda a, r: F.when(F.col(r) > 0, 100 * F.sqrt(a) / F.col(r))
    return out.select("comp", "n_triangles", "area_o", "area_p", "rim_o", "rim_p", score("area_o", "rim_o").alias("shape_o"), score("area_p", "rim_p").alias("shape_p"))


def outer_hull(triangles: DataFrame, all_edges: DataFrame, retained: DataFrame) -> DataFrame:
    """Retained edges on the outside: with one triangle only, or beside a face that the outside reaches through missing edges."""
    sides = triangle_sides(triangles).withColumn("t", F.xxhash64("a", "b", "c")).select("t", "u", "v")
    on = sides.groupBy("u", "v").agg(F.count("*").alias("n"), F.min("t").alias("t1"), F.max("t").alias("t2"))
    missing = on.join(retained.select("u", "v"), ["u", "v"], "left_anti")
    faces = connected_components(missing.select("t1", "t2"), "t1", "t2")
    outside = missing.where("n = 1").select(F.col("t1").alias("node")).join(faces, "node").select("component").distinct()
    open_faces = faces.join(outside, "component").select(F.col("node").alias("t"))
    kept = retained.select("u", "v")
    beside = sides.join(open_faces, "t", "left_semi").select("u", "v").join(kept, ["u", "v"], "left_semi")
    return on.where("n = 1").select("u", "v").join(kept, ["u", "v"], "left_semi").union(beside).distinct()


def hull_ratio(retained: DataFrame, hull: DataFrame, labels: DataFrame) -> DataFrame:
    """``comp, hull_ratio``: hull edges weighted by length over the component's median, per other edge; infinite without others."""
    inside = labelled_edges(retained.select("u", "v", "len_o"), labels).where("cu = cv").withColumnRenamed("cu", "comp")
    median = inside.groupBy("comp").agg(F.percentile("len_o", F.lit(0.5)).alias("m"))
    out = inside.join(hull.withColumn("h", F.lit(1)), ["u", "v"], "left").join(median, "comp").groupBy("comp").agg(
        F.sum(F.when(F.col("h") == 1, F.col("len_o") / F.greatest("m", F.lit(1e-12))).otherwise(0.0)).alias("s"), F.sum(F.when(F.col("h").isNull(), 1).otherwise(0)).alias("n"))
    return out.select("comp", F.when(F.col("n") > 0, F.col("s") / F.when(F.col("n") > 0, F.col("n"))).otherwise(F.lit(float("inf"))).alias("hull_ratio"))


def triangle_edge_ratio(triangles: DataFrame, retained: DataFrame, labels: DataFrame) -> DataFrame:
    """``comp, ratio``: triangles with all sides retained inside a component, per retained edge (0 without triangles)."""
    inside = labelled_edges(retained.select("u", "v"), labels).where("cu = cv").select("u", "v", F.col("cu").alias("comp"))
    whole = triangle_sides(triangles).join(inside, ["u", "v"]).groupBy("a", "b", "c").agg(F.count("*").alias("n"), F.min("comp").alias("comp")).where("n = 3").groupBy("comp").agg(F.count("*").alias("t"))
    return inside.groupBy("comp").agg(F.count("*").alias("e")).join(whole, "comp", "left").select("comp", (F.coalesce("t", F.lit(0)) / F.greatest("e", F.lit(1))).alias("ratio"))


def edges_within(edges: DataFrame, labels: DataFrame, passed: DataFrame) -> DataFrame:
    """Edges both ends of which lie in components that passed a gate (``comp``)."""
    inside = labels.join(passed.select("comp"), "comp", "left_semi").select("pid")
    return edges.select("u", "v").join(inside.withColumnRenamed("pid", "u"), "u", "left_semi").join(inside.withColumnRenamed("pid", "v"), "v", "left_semi").select("u", "v")


def triangle_gate(edges: DataFrame, labels: DataFrame, ratio: DataFrame, least: float) -> DataFrame:
    """Edges between points of components with at least ``least`` triangles an edge; a component without a ratio has 0."""
    every = labels.select("comp").distinct().join(ratio, "comp", "left")
    return edges_within(edges, labels, every.where(F.coalesce("ratio", F.lit(0.0)) >= least))


def hull_skip(ratios: DataFrame, threshold: float) -> DataFrame:
    """``comp, hull_ratio, skipped``: components whose hull ratio reaches the threshold are left alone; 0 turns that off."""
    return ratios.withColumn("skipped", F.lit(threshold > 0) & (F.col("hull_ratio") >= threshold))


def eligible(labels: DataFrame, moments: DataFrame, shape: DataFrame, ratio: DataFrame, m2_max: float, shape_min: float, ratio_min: float) -> DataFrame:
    """Points of components that pass the gates: weighted moment below, shape score and triangle ratio at least; a missing measure fails."""
    ok = (
        moments.where(F.col("weighted_median") < m2_max).select("comp")
        .join(shape.where(F.col("shape_o") >= shape_min).select("comp"), "comp", "left_semi").join(ratio.where(F.col("ratio") >= ratio_min).select("comp"), "comp", "left_semi")
    )
    return labels.join(ok, "comp", "left_semi").select("pid", "comp")


def largest(counts: DataFrame, n: int = 5) -> DataFrame:
    """The n largest components by edges, then points, then the smaller id."""
    return counts.orderBy(F.desc("n_edges"), F.desc("n_points"), "comp").limit(n)
