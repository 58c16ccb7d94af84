"""Labels, features and a classifier for bridge edges."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from geoloom.functions.vectors import distance
from geoloom.operators.edges import length_moments
from geoloom.operators.neighbors import half_edges
from geoloom.operators.ranking import exact_quantiles

#: Global statistics, in the order of the feature vector.
GLOBAL = ("median", "iqr", "p05", "p95", "mean", "std", "skew", "kurtosis")


def repaint(pts: DataFrame, near: DataFrame, k: int = 10) -> DataFrame:
    """``pid, y, painted``: a point most of whose k neighbours (strictly more than half) are of one other class takes it."""
    votes = near.where(F.col("rank") <= k).join(pts.select(F.col("pid").alias("nid"), F.col("y").alias("ny")), "nid").where("ny is not null").groupBy("pid", "ny").agg(F.count("*").alias("n"))
    best = votes.where(F.col("n") * 2 > k).select("pid", "ny")
    return pts.select("pid", "y").join(best, "pid", "left").select("pid", "y", F.coalesce("ny", "y").alias("painted"))


def radial_outliers(pts: DataFrame, sigma: float = 2.0) -> DataFrame:
    """``pid, y, radius, outlier``: farther from the class centre than the class's mean radius plus ``sigma`` deviations."""
    each = pts.where("y is not null").select("y", F.posexplode("x").alias("pos", "v"))
    centre = each.groupBy("y", "pos").agg(F.avg("v").alias("m")).groupBy("y").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda t: t["m"]).alias("centre"))
    far = pts.join(centre, "y").select("pid", "y", distance(F.col("x"), F.col("centre")).alias("radius"))
    scale = far.groupBy("y").agg((F.avg("radius") + sigma * F.stddev_pop("radius")).alias("limit"))
    return far.join(scale, "y").select("pid", "y", "radius", (F.col("radius") > F.col("limit")).alias("outlier"))


def keep_or_prune(edges: DataFrame, pts: DataFrame) -> DataFrame:
    """``u, v, action``: edges between classes are to be pruned."""
    at = lambda c: pts.select(F.col("pid").alias(c), F.col("y").alias(f"y{c}"))
    return edges.select("u", "v").join(at("u"), "u").join(at("v"), "v").select("u", "v", F.when(F.col("yu") == F.col("yv"), "KEEP").otherwise("PRUNE").alias("action"))


def _least(marked: DataFrame, each: int, seed: str) -> DataFrame:
    """The ``each`` least hashes of every action and stratum, with their rank ``r``; a partition sends no more than that of each."""
    keyed = marked.select("u", "v", "action", "stratum", F.md5(F.concat_ws(":", F.lit(seed), "u", "v")).alias("h"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], list[tuple]] = {}
        for batch in batches:
            for u, v, action, stratum, h in zip(*(c.to_pylist() for c in batch.columns)):
                group = held.setdefault((action, stratum), [])
                group.append((h, u, v))
                if len(group) >= 2 * each + 1000:
                    held[action, stratum] = heapq.nsmallest(each, group)
        rows = [(u, v, *key, h) for key, group in held.items() for h, u, v in heapq.nsmallest(each, group)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()))], ["u", "v", "action", "stratum", "h"])

    few = keyed.mapInArrow(keep, "u long, v long, action string, stratum string, h string")
    # over what the partitions kept
    own = Window.partitionBy("action", "stratum").orderBy("h", "u", "v")
    return few.withColumn("r", F.row_number().over(own)).where(F.col("r") <= each)


def balanced_sample(marked: DataFrame, each: int, seed: str = "sample") -> DataFrame:
    """At most ``each`` edges of every action, in the order of a hash of the edge."""
    return _least(marked.withColumn("stratum", F.lit("other")), each, seed).select("u", "v", "action")


def _binned(rows: DataFrame, bins: int, prefix: str) -> DataFrame:
    """Counts of ``other`` in equal bins of (0, len_o] and above it."""
    at = F.least(F.ceil(F.col("other") / F.col("len_o") * bins), F.lit(bins + 1))
    return rows.groupBy("u", "v").agg(*(F.sum((at == i).cast("int")).alias(f"{prefix}{i}") for i in range(1, bins + 2)))


def bridge_features(edges: DataFrame, dim: int) -> DataFrame:
    """22 features of every edge: histograms of the lengths one and two hops away relative to its own, global length statistics, its normalised length and log1p of the dimension."""
    half = half_edges(edges, "len_o")
    own = edges.select("u", "v", "len_o")
    near = half.select(F.col("src").alias("p"), F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.col("dst").alias("q"), F.col("len_o").alias("other"))
    ends = own.select("u", "v", "len_o", F.explode(F.array("u", "v")).alias("p"))
    one = ends.join(near, "p").where("not (a = u and b = v)").select("u", "v", "len_o", "a", "b", "other", "q").distinct()
    beyond = one.where("q <> u and q <> v").select("u", "v", "len_o", F.col("q").alias("p")).distinct().join(near.drop("q"), "p").select("u", "v", "len_o", "a", "b", "other").distinct()
    two = beyond.where("not (a = u and b = v)").join(one.select("u", "v", "a", "b").distinct(), ["u", "v", "a", "b"], "left_anti")
    out = own.join(_binned(one.select("u", "v", "len_o", "a", "b", "other").distinct(), 4, "h1_"), ["u", "v"], "left").join(_binned(two, 6, "h2_"), ["u", "v"], "left")
    out = out.fillna(0, [c for c in out.columns if c.startswith("h")])
    stats = length_moments(edges)
    out = out.crossJoin(F.broadcast(stats.select(*(F.col(c).alias(f"g_{c}") for c in GLOBAL))))
    return out.withColumn("length_ratio", F.col("len_o") / F.greatest(F.col("g_median"), F.lit(1e-12))).withColumn("log_dim", F.log1p(F.lit(float(dim)))).drop("len_o")


FEATURES = [*(f"h1_{i}" for i in range(1, 6)), *(f"h2_{i}" for i in range(1, 8)), *(f"g_{c}" for c in GLOBAL), "length_ratio", "log_dim"]


def bridge_classifier(features: DataFrame, marked: DataFrame, hidden: int = 16, rounds: int = 60, seed: int = 3) -> DataFrame:
    """``u, v, action, predicted, probability, held_out`` of a small perceptron.

    It is trained on the marked edges but a quarter, chosen by a hash of the edge.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = features.join(marked, ["u", "v"]).withColumn("label", (F.col("action") == "PRUNE").cast("double")).withColumn("held_out", F.pmod(F.xxhash64("u", "v"), F.lit(4)) == 0)
    stages = [VectorAssembler(inputCols=FEATURES, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), MultilayerPerceptronClassifier(layers=[len(FEATURES), hidden, 2], maxIter=rounds, seed=seed)]
    said = Pipeline(stages=stages).fit(rows.where("not held_out")).transform(rows)
    return said.select("u", "v", "action", F.when(F.col("prediction") == 1, "PRUNE").otherwise("KEEP").alias("predicted"), vector_to_array("probability")[1].alias("probability"), "held_out")


STRATA = ("bridge", "median", "overlap", "other")  # in the order in which they make up for short ones


def strata(edges: DataFrame, pts: DataFrame, long: float = 1.5, close: float = 0.25) -> DataFrame:
    """``u, v, stratum`` of measured edges.

    ``bridge``: longer than ``long`` times the median of the edges at either end.
    ``median``: within ``close`` of the smaller of both medians. ``overlap``: an end has
    neighbours of several classes. The first that holds counts; else ``other``.
    """
    half = half_edges(edges, "len_o")
    near = half.join(pts.select(F.col("pid").alias("dst"), "y"), "dst").groupBy("src").agg(F.count_distinct("y").alias("classes"))
    middle = exact_quantiles(half, "len_o", (0.5,), ("src",)).select("src", F.col("q")[0].alias("m"))
    at = lambda c: middle.join(near, "src").select(F.col("src").alias(c), F.col("m").alias(f"m_{c}"), F.col("classes").alias(f"k_{c}"))
    low = F.least("m_u", "m_v")
    kind = (
        F.when(F.col("len_o") > long * F.greatest("m_u", "m_v"), "bridge").when(F.abs(F.col("len_o") - low) <= close * low, "median")
        .when((F.col("k_u") > 1) | (F.col("k_v") > 1), "overlap").otherwise("other")
    )
    return edges.select("u", "v", "len_o").join(at("u"), "u").join(at("v"), "v").select("u", "v", kind.alias("stratum"))


def stratified_sample(marked: DataFrame, each: int, seed: str = "sample") -> DataFrame:
    """At most ``each`` edges of every action: ``u, v, action, stratum``.

    ``marked`` has ``u, v, action, stratum``. A third of an action's edges come from each
    of the strata bridge, median and overlap, by the least hashes of the edge; what a
    stratum lacks is made up from bridge, median, overlap and other, in that order. So an
    action gets ``each`` edges if it has them. Every partition keeps ``each`` edges of
    an action and stratum at most, before they come together.
    """
    place = F.array_position(F.array(*map(F.lit, STRATA)), F.col("stratum"))
    ranked = _least(marked, each, seed).withColumn("p", place)
    first = (F.col("stratum") != "other") & (F.col("r") <= -(-each // 3))
    turn = Window.partitionBy("action").orderBy(F.when(first, 0).otherwise(1), F.when(first, F.col("r")).otherwise(0), "p", "r")
    return ranked.withColumn("t", F.row_number().over(turn)).where(F.col("t") <= each).select("u", "v", "action", "stratum")
