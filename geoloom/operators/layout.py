"""A layout of the fuzzy neighbour graph in the plane, by synchronous epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from geoloom.operators.neighbors import half_edges
from geoloom.operators.ranking import numbered
from geoloom.sources.shared import materialise

#: The curve 1 / (1 + a d^2b) that fits a least distance of 0.1 and a spread of 1.
A, B = 1.576943, 0.8950609
UNIT = 1 << 30  # of coordinates and moves, which are summed as whole numbers so that their order doesn't show
REACH = 10.0  # half width of the start


def epochs_for(n: int, asked: int | None = None) -> int:
    """Epochs by the number of points: 500 under 10,000, 200 up to 22,000, then 100; or as many as are asked for."""
    return asked if asked is not None else 500 if n < 10_000 else 200 if n <= 22_000 else 100


def _fixed(x: Column) -> Column:
    return F.round(x * UNIT).cast("long")


def layout(graph: DataFrame, start: DataFrame, epochs: int | None = None, negatives: int = 5, seed: int = 42) -> DataFrame:
    """``pid, px, py``: where the points of ``start`` (``pid, px, py``) end up.

    In an epoch every point moves towards its neighbours in ``graph`` (``u, v,
    weight``), never beyond their weighted mean, and away from ``negatives`` points that
    a hash of point and epoch draws; all moves are from the coordinates that the
    epoch began with. Steps shrink to nothing in the last epoch. The same
    input gives the same layout. One written table an epoch.
    """
    box = start.agg(F.max(F.abs("px")).alias("x"), F.max(F.abs("py")).alias("y"), F.count("*").alias("n")).first()
    if not box.n:
        return start.select("pid", "px", "py")
    epochs, wide = epochs_for(box.n, epochs), max(box.x or 0.0, box.y or 0.0, 1e-12)
    now = materialise(numbered(start.select("pid", _fixed(F.col("px") / wide * REACH).alias("fx"), _fixed(F.col("py") / wide * REACH).alias("fy")), "pid", name="at"), "layout")
    pull = materialise(half_edges(graph, "weight"), "layout_edges")
    total = materialise(pull.groupBy(F.col("src").alias("pid")).agg(F.round(F.sum("weight"), 9).alias("strength")), "strengths")
    to_real = lambda c: F.col(c) / UNIT
    for epoch in range(epochs):
        step = 1 - epoch / epochs
        here = now.select("pid", to_real("fx").alias("x"), to_real("fy").alias("y"))
        there = here.select(F.col("pid").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"))
        pairs = pull.join(here.withColumnRenamed("pid", "src"), "src").join(there, "dst")
        d2 = F.pow(F.col("x") - F.col("x2"), 2) + F.pow(F.col("y") - F.col("y2"), 2)
        near = F.greatest(d2, F.lit(1e-6))
        c = F.col("weight") * 2 * A * B * F.pow(near, F.lit(B - 1)) / (1 + A * F.pow(near, F.lit(B)))
        drawn = pairs.select(F.col("src").alias("pid"), c.alias("c"), (F.col("x2") - F.col("x")).alias("dx"), (F.col("y2") - F.col("y")).alias("dy"))
        drawn = drawn.groupBy("pid").agg(F.sum(_fixed(F.col("c"))).alias("c"), F.sum(_fixed(F.col("c") * F.col("dx"))).alias("ax"), F.sum(_fixed(F.col("c") * F.col("dy"))).alias("ay"))
        draw = F.explode(F.array(*(F.pmod(F.xxhash64("at", F.lit(epoch), F.lit(j), F.lit(seed)), F.lit(box.n)) for j in range(negatives))))
        other = now.select(F.col("at").alias("drawn"), to_real("fx").alias("x2"), to_real("fy").alias("y2"))
        away = now.select("pid", "at", to_real("fx").alias("x"), to_real("fy").alias("y"), draw.alias("drawn")).where("drawn <> at").join(other, "drawn")
        r = 2 * B / ((0.001 + d2) * (1 + A * F.pow(near, F.lit(B))))
        push = lambda a, b: F.greatest(F.lit(-4.0), F.least(F.lit(4.0), r * (F.col(a) - F.col(b))))
        away = away.groupBy("pid").agg(F.sum(_fixed(push("x", "x2"))).alias("rx"), F.sum(_fixed(push("y", "y2"))).alias("ry"))
        all_ = now.join(drawn, "pid", "left").join(away, "pid", "left").join(total, "pid", "left").fillna(0, ["c", "ax", "ay", "rx", "ry", "strength"])
        hold = F.least(F.lit(1.0), 0.9 * UNIT / F.greatest(F.col("c"), F.lit(1)))
        moved = lambda f, a, r: (F.col(f) + F.round(step * hold * (F.col(a) + F.col("strength") * F.col(r))).cast("long")).alias(f)
        now = materialise(all_.select("pid", "at", moved("fx", "ax", "rx"), moved("fy", "ay", "ry")), "layout")
    return now.select("pid", to_real("fx").alias("px"), to_real("fy").alias("py"))
