"""Agreement of a labelling with the truth: ``pid, y, label`` tables."""

from __future__ import annotations

from math import lgamma

from pyspark.sql import DataFrame, functions as F


def contingency(pred: DataFrame) -> DataFrame:
    """``y, label, n``; noise (-1) is a class."""
    return pred.where("y is not null").groupBy("y", "label").agg(F.count("*").alias("n"))


def _pairs(n):
    return n * (n - 1) / 2


def _margins(table: DataFrame) -> DataFrame:
    a = table.groupBy("y").agg(F.sum("n").alias("ny"))
    b = table.groupBy("label").agg(F.sum("n").alias("nl"))
    return table.join(a, "y").join(b, "label").crossJoin(F.broadcast(table.agg(F.sum("n").cast("double").alias("all"))))


def adjusted_rand(pred: DataFrame) -> DataFrame:
    """One row ``ari``; 1 where both labellings are trivial in the same way, null without labelled points."""
    t = contingency(pred)
    cells = t.agg(F.sum(_pairs(F.col("n"))).alias("c"), F.sum("n").alias("m"))
    rows = t.groupBy("y").agg(F.sum("n").alias("k")).agg(F.sum(_pairs(F.col("k"))).alias("a"))
    cols = t.groupBy("label").agg(F.sum("n").alias("k")).agg(F.sum(_pairs(F.col("k"))).alias("b"))
    total = _pairs(F.col("m"))
    expected = F.when(total > 0, F.col("a") * F.col("b") / F.when(total > 0, total)).otherwise(0.0)
    most = (F.col("a") + F.col("b")) / 2
    ari = F.when(F.col("m").isNull(), None).when(most == expected, 1.0).otherwise((F.col("c") - expected) / F.when(most != expected, most - expected))
    return cells.crossJoin(rows).crossJoin(cols).select(ari.alias("ari"))


def entropies(pred: DataFrame) -> DataFrame:
    """One row with mutual information and the entropies of both labellings (nats)."""
    t = _margins(contingency(pred))
    info = t.agg(F.sum(F.col("n") / F.col("all") * F.ln(F.col("n") * F.col("all") / (F.col("ny") * F.col("nl")))).alias("mi"))
    side = lambda c, k, name: t.select(c, k, "all").distinct().agg((-F.sum(F.col(k) / F.col("all") * F.ln(F.col(k) / F.col("all")))).alias(name))
    return info.crossJoin(side("y", "ny", "hy")).crossJoin(side("label", "nl", "hl"))


def information_scores(pred: DataFrame) -> DataFrame:
    """NMI (arithmetic mean), homogeneity, completeness and V-measure; 1 for a side without entropy."""
    e = entropies(pred)
    h = F.when(F.col("hy") > 0, F.col("mi") / F.when(F.col("hy") > 0, F.col("hy"))).otherwise(1.0)
    c = F.when(F.col("hl") > 0, F.col("mi") / F.when(F.col("hl") > 0, F.col("hl"))).otherwise(1.0)
    mean = (F.col("hy") + F.col("hl")) / 2
    nmi = F.when(mean > 0, F.col("mi") / F.when(mean > 0, mean)).otherwise(1.0)
    return e.select(nmi.alias("nmi"), h.alias("homogeneity"), c.alias("completeness")).withColumn(
        "v_measure", F.when(F.col("homogeneity") + F.col("completeness") > 0, 2 * F.col("homogeneity") * F.col("completeness") / F.when(F.col("homogeneity") + F.col("completeness") > 0, F.col("homogeneity") + F.col("completeness"))).otherwise(0.0)
    )


def outlier_scores(pred: DataFrame) -> DataFrame:
    """Outliers (y > 0 against label < 0): counts, precision, recall, F1; 0 where a denominator is."""
    truth, said = F.col("y") > 0, F.col("label") < 0
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    out = pred.where("y is not null").agg(n(truth & said).alias("tp"), n(~truth & said).alias("fp"), n(truth & ~said).alias("fn"), n(~truth & ~said).alias("tn"))
    safe = lambda a, b: F.when(b > 0, a / F.when(b > 0, b)).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return out.select("tp", "fp", "fn", "tn", safe(tp, tp + fp).alias("precision"), safe(tp, tp + fn).alias("recall"), safe(2 * tp, 2 * tp + fp + fn).alias("f1"))


def cluster_quality(pred: DataFrame) -> DataFrame:
    """Number of clusters and share of noise points."""
    return pred.agg(F.count_distinct(F.when(F.col("label") >= 0, F.col("label"))).alias("n_clusters"), F.avg((F.col("label") < 0).cast("double")).alias("noise_share"))


def log_factorial(n):
    """ln(n!) of a non-negative whole column: a table below 20, Stirling's series from there."""
    small = F.element_at(F.array(*(F.lit(lgamma(i + 1)) for i in range(20))), F.least(n, F.lit(19)).cast("int") + 1)
    x = F.greatest(n, F.lit(20)).cast("double")
    series = x * F.ln(x) - x + F.ln(2 * 3.141592653589793 * x) / 2 + 1 / (12 * x) - 1 / (360 * F.pow(x, 3)) + 1 / (1260 * F.pow(x, 5))
    return F.when(n < 20, small).otherwise(series)


def adjusted_information(pred: DataFrame, block: int = 4096) -> DataFrame:
    """One row ``ami``: mutual information adjusted for chance, by the arithmetic mean of the entropies.

    The expectation is summed over all overlaps that a pair of class sizes
    allows, in blocks; pairs of equal sizes are summed once.
    """
    t = contingency(pred)
    rows = t.groupBy("y").agg(F.sum("n").alias("a")).groupBy("a").agg(F.count("*").alias("na"))
    cols = t.groupBy("label").agg(F.sum("n").alias("b")).groupBy("b").agg(F.count("*").alias("nb"))
    sizes = rows.join(cols).crossJoin(F.broadcast(t.agg(F.sum("n").alias("m"))))
    sizes = sizes.withColumns({"low": F.greatest(F.lit(1), F.col("a") + F.col("b") - F.col("m")), "high": F.least("a", "b")})
    blocks = sizes.withColumn("low", F.explode(F.sequence("low", "high", F.lit(block).cast("long"))))
    each = blocks.withColumn("n", F.explode(F.sequence("low", F.least(F.col("low") + (block - 1), F.col("high")))))
    f = log_factorial
    a, b, m, n = (F.col(c) for c in "abmn")
    log_p = f(a) + f(b) + f(m - a) + f(m - b) - f(m) - f(n) - f(a - n) - f(b - n) - f(m - a - b + n)
    expected = each.agg(F.sum(F.col("na") * F.col("nb") * n / m * F.ln(m * n / (a * b)) * F.exp(log_p)).alias("emi"))
    e = entropies(pred).crossJoin(expected)
    room = (F.col("hy") + F.col("hl")) / 2 - F.col("emi")
    return e.select(F.when(F.abs(room) < 1e-12, 1.0).otherwise((F.col("mi") - F.col("emi")) / F.when(F.abs(room) >= 1e-12, room)).alias("ami"))


def kmeans_ari(pts: DataFrame, rounds: int = 20, seed: int = 1) -> DataFrame:
    """One row ``k, ari``: how well k-means with as many clusters as there are classes finds them; points without a class take no part."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    known = pts.where("y is not null and x is not null").select("y", array_to_vector("x").alias("features"))
    k = known.agg(F.count_distinct("y")).first()[0]
    if k < 2:
        return adjusted_rand(known.select("y", F.lit(0).cast("long").alias("label"))).select(F.lit(k).alias("k"), "ari")
    found = KMeans(k=k, maxIter=rounds, seed=seed).fit(known).transform(known)
    return adjusted_rand(found.select("y", F.col("prediction").cast("long").alias("label"))).select(F.lit(k).alias("k"), "ari")
