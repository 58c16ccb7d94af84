"""Positions and pointers without one task for all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from geoloom.sources.shared import materialise


def numbered(rows: DataFrame, *order: str, name: str = "place") -> DataFrame:
    """``rows``, written, with their position from 0 in the order of the columns, nulls first.

    Rows are dealt by ranges and counted by range; only one count a range comes
    together. Rows that tie in the whole order get places of their own.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    dealt = materialise(dealt, "ordered").withColumns({"_range": F.shiftright("_at", 33), "_in": F.col("_at").bitwiseAND((1 << 33) - 1)})
    # one row a range
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return dealt.join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.col("_in")).drop("_range", "_in", "_at", "_start")


def ends_of_paths(links: DataFrame) -> DataFrame:
    """``id, to``: where the path of pointers from each ``id`` ends.

    ``links`` has ``id, to, final``: a pointer is final if the path ends there. Each
    round an open pointer takes on the pointer of the row that it points to, so
    rounds grow with the logarithm of the longest path. Paths have no cycles.
    """
    now = materialise(links.select("id", "to", "final"), "pointers")
    done = now.where("final")
    while True:
        going = now.where("not final")
        if not going.limit(1).count():
            return done.select("id", "to")
        ahead = going.unionByName(done).select(F.col("id").alias("to"), F.col("to").alias("far"), F.col("final").alias("far_final"))
        moved = materialise(going.select("id", "to").join(ahead, "to").select("id", F.col("far").alias("to"), F.col("far_final").alias("final")), "pointers")
        done = materialise(done.unionByName(moved.where("final")), "path_ends")
        now = moved


def subtree_totals(parents: DataFrame, **totals: tuple[str, object]) -> DataFrame:
    """Aggregates of every node's subtree, itself included.

    ``parents`` has ``id, parent`` (null at a root) and columns of values; each total
    is a column with the aggregate that sums it up (``F.sum``, ``F.min``, ``F.max``,
    ``F.bit_xor``). In round k a node that holds the total of its descendants within
    2**k takes on those of the nodes 2**k below, so rounds grow with the logarithm of
    the depth.
    """
    pair = {"sum": lambda a, b: a + F.coalesce(b, F.lit(0)), "min": lambda a, b: F.least(a, b), "max": lambda a, b: F.greatest(a, b), "bit_xor": lambda a, b: a.bitwiseXOR(F.coalesce(b, F.lit(0)))}
    now = materialise(parents.select("id", F.col("parent").alias("up"), *(F.col(c).alias(n) for n, (c, _) in totals.items())), "subtrees")
    while now.where("up is not null").limit(1).count():
        below = now.where("up is not null").groupBy(F.col("up").alias("id")).agg(*(getattr(F, f)(n).alias(f"_{n}") for n, (_, f) in totals.items()))
        above = now.select(F.col("id").alias("up"), F.col("up").alias("far"))
        out = now.join(above, "up", "left").join(below, "id", "left")
        now = materialise(out.select("id", F.col("far").alias("up"), *(pair[f](F.col(n), F.col(f"_{n}")).alias(n) for n, (_, f) in totals.items())), "subtrees")
    return now.drop("up")


SMALL = 1_000_000  # values that one task may count
GIANTS = 100_000  # groups of more than this share of all rows are searched in rounds
BINS = 1024


def exact_quantiles(rows: DataFrame, column: str, probabilities: tuple[float, ...], by: tuple[str, ...] = (), small: int = SMALL, giants: int = GIANTS) -> DataFrame:
    """``by`` and ``q``: the exact linear-interpolated quantiles of each group, as an array; one row of nulls for an empty table without ``by``.

    Up to ``small`` rows in all, and in groups that are no giants, values are
    counted in a task. Of a giant group, a round counts the values between the least
    and the greatest in bins, and goes on within the bins that hold the wanted ranks, until
    few values are left of each. Giants have over ``small`` rows and over
    1 / ``giants`` of all, so there are few; their bounds are broadcast.
    Nulls are left out. ``rows`` is read several times.
    """
    values = rows.select(*by, F.col(column).cast("double").alias("x")).where("x is not null")
    plain = F.percentile("x", F.array(*map(F.lit, probabilities))).alias("q")
    total = values.count()
    if total <= small:
        return values.groupBy(*by).agg(plain)
    keys = list(by) or ["_all"]
    keyed = values if by else values.withColumn("_all", F.lit(0))
    sizes = keyed.groupBy(*keys).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    large = materialise(sizes.where((F.col("n") > small) & (F.col("n") * giants > total)), "giant_groups")
    match = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    usual = keyed.alias("a").join(F.broadcast(large.select(*keys)).alias("b"), match("a", "b"), "left_anti").groupBy(*keys).agg(plain)
    ranks = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(p).alias("p")) for i, p in enumerate(probabilities))))
    want = large.withColumn("w", ranks).select(*keys, "n", "lo", "hi", "w.*").withColumn("at", F.col("p") * (F.col("n") - 1))
    both = F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at"))))
    open_ = materialise(want.withColumn("rank", both).select(*keys, "rank", "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside")).distinct(), "rank_bounds")
    found = None
    while True:
        few = open_.where((F.col("inside") <= small) | (F.col("lo") == F.col("hi")))
        # equal ends: the value itself; else the few values between them, sorted
        same = few.where("lo = hi").select(*keys, "rank", F.col("lo").alias("value"))
        left = keyed.alias("a").join(F.broadcast(few.where("lo < hi")).alias("b"), [*match("a", "b"), F.col("x").between(F.col("lo"), F.col("hi"))]).select(*(F.col(f"b.{k}").alias(k) for k in keys), "rank", "below", "x")
        picked = left.groupBy(*keys, "rank", "below").agg(F.sort_array(F.collect_list("x")).alias("l")).select(*keys, "rank", F.expr("element_at(l, cast(rank - below as int) + 1)").alias("value"))
        settled = materialise(same.unionByName(picked), "rank_values")
        found = settled if found is None else found.unionByName(settled)
        open_ = open_.where((F.col("inside") > small) & (F.col("lo") < F.col("hi")))
        if not open_.limit(1).count():
            break
        ranges = open_.select(*keys, "lo", "hi").distinct()
        inside = keyed.alias("a").join(F.broadcast(ranges).alias("b"), [*match("a", "b"), F.col("x").between(F.col("lo"), F.col("hi"))])
        bin_ = F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1))
        counts = inside.select(*(F.col(f"b.{k}").alias(k) for k in keys), "lo", "hi", "x", bin_.alias("bin")).groupBy(*keys, "lo", "hi", "bin").agg(F.count("*").alias("c"), F.min("x").alias("least"), F.max("x").alias("most"))
        before = Window.partitionBy(*keys, "lo", "hi").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # BINS rows at most
        counts = counts.withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0)))
        on = [*match("a", "b"), F.col("a.lo") == F.col("b.lo"), F.col("a.hi") == F.col("b.hi")]
        at = F.col("rank") - F.col("below")
        step = open_.alias("a").join(counts.alias("b"), on).where((at >= F.col("before")) & (at < F.col("before") + F.col("c")))
        open_ = materialise(step.select(*(F.col(f"a.{k}").alias(k) for k in keys), "rank", F.col("least").alias("lo"), F.col("most").alias("hi"), (F.col("below") + F.col("before")).alias("below"), F.col("c").alias("inside")), "rank_bounds")
    at = lambda edge: found.select(*(F.col(k).alias(f"{k}_") for k in keys), F.col("rank").alias("r_"), F.col("value").alias(edge))
    for edge, place in (("v_lo", F.floor("at")), ("v_hi", F.ceil("at"))):
        want = want.join(at(edge), [*(F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys), F.col("r_") == place]).drop(*(f"{k}_" for k in keys), "r_")
    value = F.col("v_lo") + (F.col("v_hi") - F.col("v_lo")) * (F.col("at") - F.floor("at"))
    out = want.withColumn("value", value).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "value"))), lambda s: s["value"]).alias("q")).unionByName(usual)
    return out.select(*by, "q")
