"""Point tables: ``pid, x (array of double), y (label)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from geoloom.operators.ranking import numbered


def points(table: DataFrame, pid: str = "vec_id", x: str = "embedding", y: str | None = "label") -> DataFrame:
    """A point table from any table with an id, a vector and perhaps a label."""
    label = F.col(y).cast("long") if y else F.lit(None).cast("long")
    return table.select(F.col(pid).cast("long").alias("pid"), F.col(x).cast("array<double>").alias("x"), label.alias("y"))


def standardize(pts: DataFrame) -> DataFrame:
    """Each feature less its mean over its population deviation; constant features become 0."""
    each = pts.select("pid", "y", F.posexplode("x").alias("pos", "v"))
    stats = each.groupBy("pos").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    # one row per feature, so its size is the dimension
    scale = stats.agg(F.array_sort(F.collect_list(F.struct("pos", "m", "s"))).alias("scale"))
    z = F.zip_with("x", "scale", lambda v, t: (v - t["m"]) / F.when(t["s"] > 0, t["s"]).otherwise(F.lit(1.0)))
    return pts.crossJoin(F.broadcast(scale)).select("pid", z.alias("x"), "y")


def plane(pts: DataFrame) -> DataFrame:
    """The first two features as ``pid, px, py``: the projection that leaves two-dimensional data alone."""
    return pts.select("pid", F.col("x")[0].alias("px"), F.col("x")[1].alias("py"))


def principal_plane(pts: DataFrame) -> DataFrame:
    """The first two principal components; each has its largest loading positive."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    centred = standardize_centre(pts)
    model = PCA(k=2, inputCol="vec", outputCol="out").fit(centred.withColumn("vec", array_to_vector("x")))
    load = model.pc.toArray()
    load = load * [1.0 if c[abs(c).argmax()] > 0 else -1.0 for c in load.T]
    component = lambda j: F.aggregate(F.zip_with("x", F.array(*(F.lit(float(v)) for v in load[:, j])), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return centred.select("pid", component(0).alias("px"), component(1).alias("py"))


def standardize_centre(pts: DataFrame) -> DataFrame:
    """Each feature less its mean."""
    stats = pts.select(F.posexplode("x").alias("pos", "v")).groupBy("pos").agg(F.avg("v").alias("m"))
    mean = stats.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda t: t["m"]).alias("mean"))
    return pts.crossJoin(F.broadcast(mean)).select("pid", F.zip_with("x", "mean", lambda v, m: v - m).alias("x"), "y")


def labels_by_size(labels: DataFrame, least: int) -> DataFrame:
    """Components of at least so many points, numbered from 0 by their id; points of others get -1."""
    big = labels.groupBy("comp").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    named = numbered(big.select("comp"), "comp", name="label")
    return labels.join(named, "comp", "left").select("pid", F.coalesce("label", F.lit(-1)).cast("long").alias("label"))
