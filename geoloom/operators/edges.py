"""Measured edges, thresholds and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from geoloom.functions.vectors import distance, floored, open_space
from geoloom.operators.neighbors import half_edges
from geoloom.operators.ranking import exact_quantiles


def measured(edges: DataFrame, pts: DataFrame, flat: DataFrame) -> DataFrame:
    """``u, v`` with lengths in the original space (``len_o``) and the projection (``len_p``) and the projected centre (``cx, cy``)."""
    at = lambda c: pts.select(F.col("pid").alias(c), F.col("x").alias(f"{c}_x")).join(flat.select(F.col("pid").alias(c), F.col("px").alias(f"{c}_px"), F.col("py").alias(f"{c}_py")), c)
    both = edges.select("u", "v").join(at("u"), "u").join(at("v"), "v")
    return both.select(
        "u", "v", distance(F.col("u_x"), F.col("v_x")).alias("len_o"),
        F.sqrt(F.pow(F.col("u_px") - F.col("v_px"), 2) + F.pow(F.col("u_py") - F.col("v_py"), 2)).alias("len_p"),
        ((F.col("u_px") + F.col("v_px")) / 2).alias("cx"), ((F.col("u_py") + F.col("v_py")) / 2).alias("cy"),
    )


def quartile_row(edges: DataFrame, column: str) -> DataFrame:
    """One row: ``q25, median, q75, iqr`` (floored) ``, mean``."""
    q = exact_quantiles(edges, column, (0.25, 0.5, 0.75))
    return q.crossJoin(F.broadcast(edges.agg(F.avg(column).alias("mean")))).select(
        F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"), floored(F.col("q")[2] - F.col("q")[0]).alias("iqr"), "mean"
    )


def hard_threshold(edges: DataFrame, column: str, limit: float, stat: str = "median", multiplicative: bool = False) -> DataFrame:
    """One row ``threshold``: centre + limit * IQR, or centre * (1 + limit)."""
    if stat not in ("median", "mean"):
        raise ValueError(f"unknown centre: {stat}")
    row = quartile_row(edges, column)
    return row.select((F.col(stat) * (1 + limit) if multiplicative else F.col(stat) + limit * F.col("iqr")).alias("threshold"))


def hard_gate(edges: DataFrame, limit: float, projected: bool = True, **how) -> DataFrame:
    """``edges`` with ``allowed``: both lengths are within their thresholds."""
    out = edges.crossJoin(F.broadcast(hard_threshold(edges, "len_o", limit, **how).withColumnRenamed("threshold", "t_o")))
    out = out.crossJoin(F.broadcast(hard_threshold(edges, "len_p", limit, **how).withColumnRenamed("threshold", "t_p")))
    ok = F.col("len_o") <= F.col("t_o")
    return out.withColumn("allowed", ok & (F.col("len_p") <= F.col("t_p")) if projected else ok).drop("t_o", "t_p")


def relaxed_gate(related: DataFrame, select: DataFrame, strict: float, relaxed: float, tau: float, mode: str = "knn_relaxed") -> DataFrame:
    """``allowed_seed`` and ``allowed_growth`` of edges with their neighbour relation.

    ``knn_relaxed``: also edges of the relation whose end is selective enough and
    that pass the relaxed gate (seeds by the less, growth by the more selective
    end); ``knn_growth_relaxed``: seeds strictly, growth by both ends;
    ``knn_global``: every edge of the relation by the relaxed gate.
    """
    if mode not in ("knn_relaxed", "knn_growth_relaxed", "knn_global"):
        raise ValueError(f"unknown gate mode: {mode}")
    side = lambda c: select.select(F.col("pid").alias(c), F.col("selectivity").alias(f"sel_{c}"))
    out = hard_gate(related, strict).withColumnRenamed("allowed", "strict")
    loose = hard_gate(related, relaxed).select("u", "v", F.col("allowed").alias("loose"))
    out = out.join(loose, ["u", "v"]).join(side("u"), "u").join(side("v"), "v")
    near = F.col("uv") | F.col("vu")
    least = F.least("sel_u", "sel_v")
    most = F.greatest(F.when(F.col("uv"), F.col("sel_u")).otherwise(0.0), F.when(F.col("vu"), F.col("sel_v")).otherwise(0.0))
    on = F.lit(tau < 1)
    if mode == "knn_global":
        seed = growth = F.col("strict") | (near & F.col("loose"))
    elif mode == "knn_relaxed":
        seed, growth = (F.col("strict") | (on & near & (x > tau) & F.col("loose")) for x in (least, most))
    else:
        seed, growth = F.col("strict"), F.col("strict") | (on & near & (least > tau) & F.col("loose"))
    return out.select("u", "v", "len_o", "len_p", seed.alias("allowed_seed"), growth.alias("allowed_growth"))


def seed_edges(gated: DataFrame, relation: str = "union") -> DataFrame:
    """``is_seed``: allowed and in the neighbour relation (``union`` or ``mutual``)."""
    if relation not in ("union", "mutual"):
        raise ValueError(f"unknown relation: {relation}")
    near = F.col("uv") | F.col("vu") if relation == "union" else F.col("uv") & F.col("vu")
    return gated.withColumn("is_seed", near & F.col("allowed"))


def top_incident(edges: DataFrame, n: int = 3) -> DataFrame:
    """``src, dst, len_o, rank``: each point's longest edges, ties to the smaller edge."""
    half = half_edges(edges, "len_o").withColumns({"u": F.least("src", "dst"), "v": F.greatest("src", "dst")})
    order = Window.partitionBy("src").orderBy(F.desc("len_o"), "u", "v")
    return half.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("src", "dst", "len_o", "rank")


def second_other_length(edges: DataFrame) -> DataFrame:
    """For each direction of an edge, the second longest other edge at its source (0 where there is none), and the open-space score of the source."""
    top = top_incident(edges, 3)
    half = half_edges(edges, "len_o")
    others = half.join(top.select("src", F.col("dst").alias("other"), F.col("len_o").alias("len_other")), "src").where(F.col("other") != F.col("dst"))
    ranked = F.row_number().over(Window.partitionBy("src", "dst").orderBy(F.desc("len_other"), F.least("src", "other"), F.greatest("src", "other")))
    second = others.withColumn("r", ranked).where("r = 2").select("src", "dst", F.col("len_other").alias("second_len"))
    return half.join(second, ["src", "dst"], "left").fillna(0.0, ["second_len"]).withColumn("open_space", open_space(F.col("len_o"), F.col("second_len")))


def length_moments(edges: DataFrame, column: str = "len_o") -> DataFrame:
    """Median, IQR, 5th and 95th percentile, mean, deviation, skewness and excess kurtosis of a length."""
    q = exact_quantiles(edges, column, (0.05, 0.25, 0.5, 0.75, 0.95))
    return q.crossJoin(F.broadcast(edges.agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"), F.skewness(column).alias("skew"), F.kurtosis(column).alias("kurtosis")))).select(
        F.col("q")[2].alias("median"), (F.col("q")[3] - F.col("q")[1]).alias("iqr"), F.col("q")[0].alias("p05"), F.col("q")[4].alias("p95"), "mean", "std", "skew", "kurtosis"
    )


def incident_q25(edges: DataFrame, pts: DataFrame) -> DataFrame:
    """25th percentile of each point's incident lengths; the global one where there is no edge."""
    per = exact_quantiles(half_edges(edges, "len_o").withColumnRenamed("src", "pid"), "len_o", (0.25,), ("pid",)).select("pid", F.col("q")[0].alias("q"))
    all_q = exact_quantiles(edges, "len_o", (0.25,)).select(F.col("q")[0].alias("all_q"))
    return pts.select("pid").join(per, "pid", "left").crossJoin(F.broadcast(all_q)).select("pid", F.coalesce("q", "all_q").alias("q25"))


def segments(edges: DataFrame, flat: DataFrame) -> DataFrame:
    """Projected end points of every edge, as a plot needs them."""
    at = lambda c, i: flat.select(F.col("pid").alias(c), F.col("px").alias(f"x{i}"), F.col("py").alias(f"y{i}"))
    return edges.select("u", "v").join(at("u", 1), "u").join(at("v", 2), "v").select("u", "v", "x1", "y1", "x2", "y2")


def log_length_histogram(edges: DataFrame, bins: int, column: str = "len_o") -> DataFrame:
    """``bin, n``: counts of ln(length) in ``bins`` equal bins, empty ones too; the last is closed on the right."""
    logs = edges.where(F.col(column) > 0).select(F.ln(column).alias("l"))
    box = logs.agg(F.min("l").alias("lo"), F.max("l").alias("hi"))
    at = F.least(F.floor((F.col("l") - F.col("lo")) / F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0) * bins), F.lit(bins - 1)).cast("int")
    got = logs.crossJoin(F.broadcast(box)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    every = edges.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(got, "bin", "left").fillna(0, ["n"])


