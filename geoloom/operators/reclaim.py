"""Noise points reclaimed by clusters through cheap paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from geoloom.functions.vectors import floored
from geoloom.operators.growth import components, labelled_edges
from geoloom.operators.neighbors import half_edges
from geoloom.sources.shared import materialise


def cluster_lengths(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``label, avg_len``: mean length of the edges inside each cluster; the global median where it has none."""
    own = labels.select("pid", F.col("label").alias("comp"))
    inside = labelled_edges(edges, own).where("cu = cv and cu >= 0").groupBy(F.col("cu").alias("label")).agg(F.avg("len_o").alias("a"))
    every = labels.where("label >= 0").select("label").distinct().crossJoin(F.broadcast(edges.agg(F.percentile("len_o", F.lit(0.5)).alias("m"))))
    return every.join(inside, "label", "left").select("label", floored(F.coalesce("a", "m")).alias("avg_len"))


def cluster_density(core: DataFrame, labels: DataFrame) -> DataFrame:
    """``label, ref_core``: median core distance of each cluster's members."""
    per = labels.where("label >= 0").join(core, "pid").groupBy("label").agg(F.percentile("core", F.lit(0.5)).alias("r"))
    return per.select("label", floored(F.col("r")).alias("ref_core"))


def relative_cost(length: Column, core: Column, ref: Column, avg: Column, density_power: float, penalty: float, clip: bool = False) -> Column:
    """Cost of a step: its length in the cluster's mean lengths, times a power of the relative core distance (at least 1 with ``clip``), to the power 1 + penalty."""
    ratio = floored(core) / ref
    return F.pow(length * F.pow(F.greatest(ratio, F.lit(1.0)) if clip else ratio, F.lit(density_power)) / avg, F.lit(1 + penalty))


def _scales(edges: DataFrame, labels: DataFrame, core: DataFrame) -> DataFrame:
    return cluster_lengths(edges, labels).join(cluster_density(core, labels), "label")


def cost_frontier(edges: DataFrame, labels: DataFrame, core: DataFrame, density_power: float = 0.5, penalty: float = 0.5, reach: float = 15.0, clip: bool = False) -> DataFrame:
    """The first steps of clusters into noise: ``u, v, pid, label, cost`` with cost within ``reach``."""
    return _frontier(edges, labels, core, _scales(edges, labels, core), density_power, penalty, reach, clip).select("u", "v", "pid", "label", "cost")


def _frontier(edges: DataFrame, labels: DataFrame, core: DataFrame, scales: DataFrame, density_power: float, penalty: float, reach: float, clip: bool) -> DataFrame:
    half = half_edges(edges, "u", "v", "len_o")
    step = half.join(labels.where("label >= 0").select(F.col("pid").alias("src"), "label"), "src").join(labels.where("label = -1").select(F.col("pid").alias("dst")), "dst")
    step = step.join(scales, "label").join(core.select(F.col("pid").alias("dst"), "core"), "dst")
    cost = relative_cost(F.col("len_o"), F.col("core"), F.col("ref_core"), F.col("avg_len"), density_power, penalty, clip)
    return step.select("u", "v", F.col("dst").alias("pid"), "label", cost.alias("cost"), "avg_len", "ref_core").where(F.col("cost") <= reach)


def cost_gate(edges: DataFrame, labels: DataFrame, core: DataFrame, density_power: float = 0.5, penalty: float = 0.5, reach: float = 15.0, clip: bool = False) -> DataFrame:
    """Labels after clusters have claimed noise points along cheapest paths: ``pid, label, cost, u, v``, the last three of the claim.

    A path's cost adds its steps' relative costs; the first claim of a point
    stands, in the order of cost, point, cluster and edge; cost over ``reach`` ends
    a path. Labels of clustered points never change. Paths only extend through noise.

    Claims are settled in rounds. In each connected part of the noise let m be the
    least cost of an open claim: a claim is settled if it costs less than m and the
    least step into its point together, for any other path comes through a point
    that costs m or more. The least one of each part always is.
    """
    if density_power < 0 or penalty < -1:
        raise ValueError("powers of the cost must not be negative")
    noise = labels.where("label = -1").select("pid")
    inner = edges.select("u", "v", "len_o").join(noise.withColumnRenamed("pid", "u"), "u", "left_semi").join(noise.withColumnRenamed("pid", "v"), "v", "left_semi")
    inner = materialise(inner, "noise_edges")
    scales = materialise(_scales(edges, labels, core), "cluster_scales")
    ways = half_edges(inner, "u", "v", "len_o").join(core.select(F.col("pid").alias("dst"), "core"), "dst")
    ways = materialise(ways.select("src", F.col("dst").alias("pid"), "u", "v", "len_o", "core"), "noise_ways")
    part = components(noise, inner.select("u", "v"))
    # a bound of the step into a point from below: its shortest edge at the most lenient scale of its part
    first = materialise(_frontier(edges, labels, core, scales, density_power, penalty, reach, clip).join(part.withColumnRenamed("comp", "part"), "pid"), "frontier")
    lenient = first.groupBy("part").agg(F.min(1 / (F.col("avg_len") * F.pow("ref_core", F.lit(density_power)))).alias("scale"))
    short = ways.groupBy("pid").agg(F.min("len_o").alias("short"), F.first("core").alias("core"))
    least = part.withColumnRenamed("comp", "part").join(lenient, "part").join(short, "pid", "left")
    step = F.pow(F.col("short") * F.pow(floored(F.col("core")), F.lit(density_power)) * F.col("scale"), F.lit(1 + penalty)) * (1 - 1e-9)
    least = materialise(least.select("pid", "part", F.coalesce(step, F.lit(float("inf"))).alias("step")), "least_steps")
    claim = ["cost", "label", "u", "v", "avg_len", "ref_core"]
    best = lambda df: df.groupBy("pid").agg(F.min(F.struct(*claim)).alias("c")).select("pid", "c.*")
    open_ = materialise(best(first.select("pid", *claim)), "open_claims")
    settled = None
    while open_.limit(1).count():
        placed = open_.join(least, "pid")
        lowest = placed.groupBy("part").agg(F.min(F.struct("cost", "pid")).alias("low"))
        sure = (F.struct("cost", "pid") == F.col("low")) | (F.col("cost") < F.col("low.cost") + F.col("step"))
        now = materialise(placed.join(lowest, "part").where(sure).select("pid", *claim), "settled_now")
        settled = materialise(now if settled is None else settled.unionByName(now), "settled")
        ahead = now.select(F.col("pid").alias("src"), F.col("cost").alias("before"), "label", "avg_len", "ref_core").join(ways, "src")
        cost = F.col("before") + relative_cost(F.col("len_o"), F.col("core"), F.col("ref_core"), F.col("avg_len"), density_power, penalty, clip)
        ahead = ahead.withColumn("cost", cost).where(F.col("cost") <= reach).select("pid", *claim)
        open_ = materialise(best(open_.unionByName(ahead).join(settled.select("pid"), "pid", "left_anti")), "open_claims")
    if settled is None:
        settled = open_
    won = settled.select("pid", F.col("label").alias("to"), "cost", "u", "v")
    return labels.join(won, "pid", "left").select("pid", F.coalesce("to", "label").alias("label"), "cost", "u", "v")
