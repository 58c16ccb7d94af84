"""Wave growth: components grow one wave at a time, the largest first, by a mild limit of their own edges."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, functions as F

from geoloom.functions.vectors import floored, quartiles
from geoloom.operators.components import connected_components
from geoloom.operators.edges import second_other_length
from geoloom.operators.growth import components, labelled_edges
from geoloom.sources.shared import materialise


def outer_scores(edges: DataFrame) -> DataFrame:
    """``u, v, open_u, open_v``: the open-space score of each end."""
    scored = second_other_length(edges)
    side = lambda a, b, name: scored.select(F.col("src").alias(a), F.col("dst").alias(b), F.col("open_space").alias(name))
    return side("u", "v", "open_u").join(side("v", "u", "open_v"), ["u", "v"]).where("u < v")


def wave_growth(
    edges: DataFrame, pts: DataFrame, mild: float, min_edges: int, relaxation: float | None = None, selectivity: DataFrame | None = None, threshold: float = 1.0, strict: bool = False
) -> DataFrame:
    """Grow the large seed components in waves until none accepts an edge.

    ``edges`` has ``u, v, len_o`` and the flags ``seed``, ``allowed`` (passes the hard
    gate), ``relaxed`` (passes the relaxed one) and ``near`` (in the neighbour
    relation), with ``relaxation`` also ``open_u, open_v`` (:func:`outer_scores`).

    A component leads when it has more than ``min_edges`` edges, none of its points
    is done, and it is the largest (by edges, points, then the smallest member)
    of those that edges which may ever be accepted connect it with directly; with
    ``strict``, by paths. Once it leads it does so until it is done. A wave takes,
    of all edges at the leader that are not yet taken, its inner ones too,

    * allowed ones within median + mild * IQR of its taken edges (``automatic``);
    * with ``relaxation``, allowed ones not near and up to relaxation * score * IQR
      above that, by the score of the outer end, or the larger one of an inner edge (``open_space``);
    * relaxed and near ones above that (``near``); with ``selectivity`` (``pid,
      selectivity``) only of leaders whose mean is above ``threshold``.

    Components that a wave joins become one. A leader that takes nothing is done.
    All leaders take their waves at once. With ``strict`` there is one in each part
    that could ever grow together, so the result is that of growing one
    component after another; without, components far apart grow side by side,
    and those that the first would have reached later may differ.

    Returns ``u, v, taken, how`` (``seed``, as above, or null) ``, wave`` (0 for seeds)
    ``, seen`` (stood at a leader untaken) and ``rejected`` (by at least one). One written table of each kind a wave.
    """
    possible = F.col("seed") | F.col("allowed") | F.col("relaxed") & F.col("near")
    own = ["open_u", "open_v"] if relaxation is not None else []
    state = edges.select("u", "v", "len_o", "seed", "allowed", "relaxed", "near", *own, F.col("seed").alias("taken"), F.when(F.col("seed"), "seed").alias("how"), F.when(F.col("seed"), F.lit(0)).alias("wave"), F.lit(False).alias("seen"), F.lit(False).alias("rejected"))
    state = materialise(state, "wave_edges")
    labels = materialise(components(pts, state.where("seed").select("u", "v")), "wave_labels")
    parts = materialise(components(pts, state.where(possible).select("u", "v")).withColumnRenamed("comp", "part"), "wave_parts") if strict else None
    large = labelled_edges(state.where("seed"), labels).groupBy(F.col("cu").alias("comp")).agg(F.count("*").alias("n")).where(F.col("n") > min_edges)
    #: of components that may still lead
    live = materialise(large.select("comp", F.lit(False).alias("leads")), "wave_live")
    at = lambda name: F.coalesce(F.col(name), F.lit(False))
    for wave in count(1):
        sized = live.join(labels.groupBy("comp").agg(F.count("*").alias("n_points")), "comp")
        inner = labelled_edges(state.where("taken").select("u", "v", "len_o"), labels).groupBy(F.col("cu").alias("comp")).agg(F.count("*").alias("n_edges"), quartiles(F.col("len_o")).alias("q"))
        sized = sized.join(inner, "comp").withColumn("rank", F.struct("leads", "n_edges", "n_points", (-F.col("comp")).alias("first")))
        sized = materialise(sized.select("comp", "rank", "q"), "wave_sizes")
        if strict:
            where = labels.where("pid = comp").join(parts, "pid").select("comp", "part")
            best = sized.join(where, "comp").groupBy("part").agg(F.max("rank").alias("top"))
            leaders = sized.join(where, "comp").join(best, "part").where(F.col("rank") == F.col("top"))
        else:
            touch = labelled_edges(state.where(possible).select("u", "v"), labels).where("cu <> cv").select("cu", "cv").distinct()
            touch = touch.union(touch.select("cv", "cu"))
            rival = touch.join(sized.select(F.col("comp").alias("cv"), F.col("rank").alias("other")), "cv").groupBy(F.col("cu").alias("comp")).agg(F.max("other").alias("top"))
            leaders = sized.join(rival, "comp", "left").where(F.col("top").isNull() | (F.col("rank") > F.col("top")))
        leaders = leaders.select("comp", F.col("q")[1].alias("median"), floored(F.col("q")[2] - F.col("q")[0]).alias("iqr"))
        if selectivity is not None:
            mean = labels.join(selectivity.select("pid", "selectivity"), "pid").groupBy("comp").agg(F.avg("selectivity").alias("s"))
            leaders = leaders.join(mean, "comp").withColumn("selective", F.col("s") > threshold)
        else:
            leaders = leaders.withColumn("selective", F.lit(True))
        leaders = materialise(leaders, "wave_leaders")
        if not leaders.limit(1).count():
            return state.select("u", "v", "taken", "how", "wave", "seen", "rejected")
        sides = labelled_edges(state.where("not taken"), labels).withColumn("comp", F.explode(F.array_distinct(F.array("cu", "cv")))).join(leaders, "comp")
        limit = F.col("median") + mild * F.col("iqr")
        automatic = F.col("allowed") & (F.col("len_o") <= limit)
        how = F.when(automatic, "automatic")
        if relaxation is not None:
            score = F.when(F.col("cu") == F.col("cv"), F.greatest("open_u", "open_v")).when(F.col("cu") == F.col("comp"), F.col("open_v")).otherwise(F.col("open_u"))
            how = how.when(F.col("allowed") & (F.col("len_o") > limit) & (F.col("len_o") <= limit + relaxation * score * F.col("iqr")) & ~F.col("near"), "open_space")
        how = how.when(F.col("relaxed") & F.col("near") & (F.col("len_o") > limit) & F.col("selective"), "near")
        judged = sides.select("u", "v", "cu", "cv", "comp", how.alias("new"))
        judged = materialise(judged, "wave_judged")
        per = judged.groupBy("u", "v").agg(F.min("new").alias("new"), F.bool_or(F.col("new").isNull()).alias("turned_down"))
        out = state.join(per.withColumn("here", F.lit(True)), ["u", "v"], "left")
        state = materialise(out.select(
            "u", "v", "len_o", "seed", "allowed", "relaxed", "near", *own, (F.col("taken") | F.col("new").isNotNull()).alias("taken"), F.coalesce("how", "new").alias("how"),
            F.coalesce("wave", F.when(F.col("new").isNotNull(), F.lit(wave))).alias("wave"), (F.col("seen") | at("here")).alias("seen"), (F.col("rejected") | at("turned_down")).alias("rejected"),
        ), "wave_edges")
        grew = judged.where("new is not null").select("comp").distinct().withColumn("grew", F.lit(True))
        joined = judged.where("new is not null and cu <> cv").select("cu", "cv").distinct()
        merged = materialise(connected_components(joined, "cu", "cv").select(F.col("node").alias("comp"), F.col("component").alias("to")), "wave_merged")
        # a component joined by a leader leads on with it; one that takes nothing is done
        led = leaders.select("comp").join(grew, "comp", "left").select("comp", at("grew").alias("grew"), F.lit(True).alias("led"))
        now = live.join(led, "comp", "full").where("led is null or grew").join(merged, "comp", "left")
        live = materialise(now.groupBy(F.coalesce("to", "comp").alias("comp")).agg(F.bool_or(at("grew") | at("leads")).alias("leads")), "wave_live")
        labels = materialise(labels.join(merged, "comp", "left").select("pid", F.coalesce("to", "comp").alias("comp")), "wave_labels")
