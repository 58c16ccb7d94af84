"""Seed components and their growth, one bulk-synchronous round at a time."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from geoloom.functions.vectors import clipped, distance, floored, quartiles, robust_ratio
from geoloom.operators.components import connected_components
from geoloom.operators.neighbors import half_edges
from geoloom.operators.ranking import SMALL, exact_quantiles
from geoloom.sources.shared import materialise


def components(pts: DataFrame, edges: DataFrame) -> DataFrame:
    """``pid, comp`` for every point: the smallest point that ``edges`` reach, or itself."""
    found = connected_components(edges).select(F.col("node").alias("pid"), F.col("component").alias("comp"))
    return pts.select("pid").join(found, "pid", "left").select("pid", F.coalesce("comp", "pid").alias("comp"))


def labelled_edges(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``edges`` with the component of each end."""
    at = lambda c: labels.select(F.col("pid").alias(c), F.col("comp").alias(f"c{c}"))
    return edges.join(at("u"), "u").join(at("v"), "v")


def component_counts(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``comp, n_points, n_edges`` with both ends inside."""
    inside = labelled_edges(edges, labels).where("cu = cv").groupBy(F.col("cu").alias("comp")).agg(F.count("*").alias("n_edges"))
    return labels.groupBy("comp").agg(F.count("*").alias("n_points")).join(inside, "comp", "left").fillna(0, ["n_edges"])


def internal_stats(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Quartiles of each component's internal edges in both spaces."""
    inside = labelled_edges(edges, labels).where("cu = cv")
    return _stats(inside.select("len_o", "len_p", F.col("cu").alias("comp")))


def incident_stats(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Quartiles of all edges that touch a component, each once."""
    return _stats(labelled_edges(edges, labels).select("len_o", "len_p", F.explode(F.array_distinct(F.array("cu", "cv"))).alias("comp")))


def _stats(lengths: DataFrame, small: int = SMALL) -> DataFrame:
    """Up to ``small`` edges in one pass; more through the rounds of :func:`exact_quantiles`."""
    if lengths.count() <= small:
        out = lengths.groupBy("comp").agg(quartiles(F.col("len_o")).alias("o"), quartiles(F.col("len_p")).alias("p"), F.count("*").alias("n_edges"))
    else:
        lengths = materialise(lengths, "component_lengths")
        q = lambda c, name: exact_quantiles(lengths, c, (0.25, 0.5, 0.75), ("comp",), small).withColumnRenamed("q", name)
        out = q("len_o", "o").join(q("len_p", "p"), "comp").join(lengths.groupBy("comp").agg(F.count("*").alias("n_edges")), "comp")
    return out.select("comp", "n_edges", F.col("o")[0].alias("q25_o"), F.col("o")[1].alias("med_o"), F.col("o")[2].alias("q75_o"), F.col("p")[1].alias("med_p"), F.col("p")[2].alias("q75_p"))


def boundary(edges: DataFrame, labels: DataFrame, active: DataFrame) -> DataFrame:
    """Each edge between components once for every active component at its ends: ``comp`` scores it, ``outer`` is across, with its end ``outer_pid``."""
    between = labelled_edges(edges, labels).where("cu <> cv")
    side = lambda c, d: F.struct(F.col(f"c{c}").alias("comp"), F.col(f"c{d}").alias("outer"), F.col(d).alias("outer_pid"))
    sides = between.withColumn("s", F.explode(F.array(side("u", "v"), side("v", "u"))))
    return sides.select("u", "v", "len_o", "len_p", "s.comp", "s.outer", "s.outer_pid").join(active.select("comp"), "comp", "left_semi")


def growth_scores(edges: DataFrame, labels: DataFrame, active: DataFrame, reference: DataFrame, q25: DataFrame | None = None) -> DataFrame:
    """Boundary edges with their ratios to the scoring component's internal reference edges.

    With each point's ``q25`` also ``ratio_q``: that of the outer end, on the same scale.
    """
    each = boundary(edges, labels, active).join(internal_stats(reference, labels), "comp")
    ratios = [robust_ratio(F.col("len_o"), F.col("med_o"), F.col("q75_o")).alias("ratio_o"), robust_ratio(F.col("len_p"), F.col("med_p"), F.col("q75_p")).alias("ratio_p")]
    if q25 is not None:
        each = each.join(q25.select(F.col("pid").alias("outer_pid"), "q25"), "outer_pid")
        ratios.append(robust_ratio(F.col("q25"), F.col("med_o"), F.col("q75_o")).alias("ratio_q"))
    return each.select("u", "v", "comp", "outer", "outer_pid", *ratios)


def gate_classes(scores: DataFrame, limit: float, projected: float) -> DataFrame:
    """How many scored boundary sides are accepted or blocked, and by what."""
    o, p = F.col("ratio_o") < limit, F.col("ratio_p") < projected
    kind = F.when(o & p, "accepted").when(~o & p, "blocked_original").when(o & ~p, "blocked_projected").otherwise("blocked_both")
    return scores.groupBy(kind.alias("gate")).agg(F.count("*").alias("n"))


def accepted(scores: DataFrame, limit: float, projected: float) -> DataFrame:
    """Edges that either side accepts; both tests are strict."""
    return scores.where((F.col("ratio_o") < limit) & (F.col("ratio_p") < projected)).select("u", "v").distinct()


def restored(edges: DataFrame, labels: DataFrame, seeds: DataFrame, limit: float | None) -> DataFrame:
    """Edges inside a component that are no seeds and within median + limit * IQR of its seed edges; all of them without a limit."""
    inside = labelled_edges(edges, labels).where("cu = cv").join(seeds.select("u", "v"), ["u", "v"], "left_anti").withColumnRenamed("cu", "comp")
    if limit is None:
        return inside.select("u", "v")
    return inside.join(internal_stats(seeds, labels), "comp").where(F.col("len_o") <= F.col("med_o") + limit * floored(F.col("q75_o") - F.col("q25_o"))).select("u", "v")


def seed_restoration(edges: DataFrame, labels: DataFrame, active: DataFrame, seeds: DataFrame, limit: float) -> DataFrame:
    """``u, v`` of edges inside the large seed components (``active``) that are within the limit of their seeds' scale: what is restored before growth."""
    large = labels.join(active.select("comp"), "comp", "left_semi").select("pid")
    inner = edges.join(large.withColumnRenamed("pid", "u"), "u", "left_semi")
    return restored(inner, labels, seeds, limit)


def sequential_growth(edges: DataFrame, pts: DataFrame, seeds: DataFrame, min_edges: int, limit: float, projected: float, restore: float | None = None, mode: str = "real") -> DataFrame:
    """Grow seed components until no edge is accepted or restored.

    With ``restore``, edges inside the large seed components (more than
    ``min_edges`` seed edges) and within that limit of their seeds' scale are
    restored first, in every mode; they are part of the reference and the result.

    Per round, statistics are frozen: active components (large ones, or merged
    with one) score their boundary edges against their reference edges, all that
    pass are accepted at once, and components that accepted edges join become
    one. In the modes ``real`` and ``virtual``, edges inside an active component
    and within the limit of the current scale join the reference as well, for
    the next round; in ``real`` they also join the result. ``seed_only`` stops
    at what was restored first.

    Returns of all edges ``u, v, seed, accepted, restored`` (the three are the
    result) ``, virtual`` (in the reference only) and ``round``, in which growth
    first accepted or restored an edge (0: never, or before). One written table a round.
    """
    return _grown(edges, pts, seeds, min_edges, limit, projected, restore, mode)[0]


def growth_history(edges: DataFrame, pts: DataFrame, seeds: DataFrame, min_edges: int, limit: float, projected: float, restore: float | None, mode: str, q25: DataFrame, recall: DataFrame) -> DataFrame:
    """How each edge was scored when growth first saw it at a boundary.

    Returns ``u, v, round`` (from 1) ``, comp`` (of both active sides the smaller
    component) ``, ratio_o, ratio_p, ratio_q`` (the outer end's q25 on that scale)
    ``, outer_recall`` and ``shown_o, shown_q``, clipped to 0 to 2. An edge that no
    active component ever bordered on has no row. Rows are only ever added: a
    round adds the edges that have none yet.
    """
    history = _grown(edges, pts, seeds, min_edges, limit, projected, restore, mode, q25)[1]
    at = recall.select(F.col("pid").alias("outer_pid"), F.col("recall").alias("outer_recall"))
    shown = {"shown_o": clipped(F.col("ratio_o")), "shown_q": clipped(F.col("ratio_q"))}
    return history.join(at, "outer_pid", "left").withColumns(shown).select("u", "v", "round", "comp", "ratio_o", "ratio_p", "ratio_q", "outer_recall", *shown)


def _grown(edges: DataFrame, pts: DataFrame, seeds: DataFrame, min_edges: int, limit: float, projected: float, restore: float | None, mode: str, q25: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The state of all edges and, with ``q25``, their first scores."""
    if mode not in ("real", "virtual", "seed_only"):
        raise ValueError(f"unknown restoration mode: {mode}")
    labels = materialise(components(pts, seeds.select("u", "v")), "comp")
    active = materialise(component_counts(labels, seeds).where(F.col("n_edges") > min_edges).select("comp"), "active")
    state = edges.select("u", "v", "len_o", "len_p").join(seeds.select("u", "v", F.lit(True).alias("seed")), ["u", "v"], "left")
    if restore is None:
        state = state.withColumn("restored", F.lit(False))
    else:
        first = seed_restoration(edges.select("u", "v", "len_o", "len_p"), labels, active, seeds, restore).withColumn("restored", F.lit(True))
        state = state.join(first, ["u", "v"], "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    state = state.withColumns({"seed": flag("seed"), "restored": flag("restored"), "accepted": F.lit(False), "virtual": F.lit(False), "round": F.lit(0)})
    state, history = materialise(state, "growth"), None
    for number in count(1):  # flags are only ever set, so a round without a new one comes
        reference = state.where("seed or accepted or restored or virtual")
        scores = growth_scores(state, labels, active, reference, q25)
        if q25 is not None:
            scores = materialise(scores, "growth_scores")
            seen = scores.groupBy("u", "v").agg(F.min_by(F.struct("comp", "outer_pid", "ratio_o", "ratio_p", "ratio_q"), "comp").alias("s")).select("u", "v", F.lit(number).alias("round"), "s.*")
            history = materialise(seen if history is None else history.unionByName(seen.join(history, ["u", "v"], "left_anti")), "growth_history")
        out = state.join(accepted(scores, limit, projected).withColumn("_a", F.lit(True)), ["u", "v"], "left")
        if restore is not None and mode != "seed_only":
            back = labelled_edges(restored(state, labels, reference, restore), labels)
            out = out.join(back.join(active.withColumnRenamed("comp", "cu"), "cu", "left_semi").select("u", "v", F.lit(True).alias("_r")), ["u", "v"], "left")
        else:
            out = out.withColumn("_r", F.lit(None).cast("boolean"))
        kind = "virtual" if mode == "virtual" else "restored"
        fresh = flag("_a") & ~F.col("accepted") | flag("_r") & ~F.col(kind)
        other = "restored" if kind == "virtual" else "virtual"
        state = materialise(out.select("u", "v", "len_o", "len_p", "seed", (F.col("accepted") | flag("_a")).alias("accepted"), (F.col(kind) | flag("_r")).alias(kind), other, F.when(fresh & (F.col("round") == 0), F.lit(number)).otherwise(F.col("round")).alias("round"), fresh.alias("_new")), "growth")
        if not state.where("_new").limit(1).count():
            return state.select("u", "v", "seed", "accepted", "restored", "virtual", "round"), history
        state = state.drop("_new")
        pairs = labelled_edges(state.where("accepted"), labels).where("cu <> cv").select(F.col("cu").alias("u"), F.col("cv").alias("v")).distinct()
        merged = connected_components(pairs).select(F.col("node").alias("comp"), F.col("component").alias("to"))
        labels = materialise(labels.join(merged, "comp", "left").select("pid", F.coalesce("to", "comp").alias("comp")), "comp")
        active = materialise(active.join(merged, "comp", "left").select(F.coalesce("to", "comp").alias("comp")).distinct(), "active")


def interior_restoration(edges: DataFrame, pts: DataFrame, seeds: DataFrame, state: DataFrame, limit: float | None) -> DataFrame:
    """``u, v`` of edges that growth's result (``state``) leaves out and that lie inside one of its components, within the limit of its seeds' scale."""
    result = state.where("seed or accepted or restored").select("u", "v")
    labels = materialise(components(pts, result), "grown_comp")
    return restored(edges, labels, seeds, limit).join(result, ["u", "v"], "left_anti")


def boundary_scores(edges: DataFrame, pts: DataFrame, labels: DataFrame, large: DataFrame, q25: DataFrame, recall: DataFrame) -> DataFrame:
    """Per boundary edge of a large component the most lenient side and its ratio against all incident edges.

    ``outer_q25`` is the outer end's q25 as a ratio on the scoring component's
    scale, ``outer_recall`` its recall; each is the least of the sides.
    """
    each = boundary(edges, labels, large).join(incident_stats(edges, labels), "comp")
    each = each.join(q25.select(F.col("pid").alias("outer_pid"), "q25"), "outer_pid").join(recall.select(F.col("pid").alias("outer_pid"), "recall"), "outer_pid")
    each = each.withColumns({"ratio": robust_ratio(F.col("len_o"), F.col("med_o"), F.col("q75_o")), "ratio_q": robust_ratio(F.col("q25"), F.col("med_o"), F.col("q75_o"))})
    return each.groupBy("u", "v").agg(F.min_by("comp", F.struct("ratio", "comp")).alias("comp"), F.min("ratio").alias("ratio"), F.min("ratio_q").alias("outer_q25"), F.min("recall").alias("outer_recall"))


def frozen_growth_round(edges: DataFrame, labels: DataFrame, limit: float, projected: float) -> DataFrame:
    """One round in which clusters (label >= 0) claim unassigned points (-1): the best proposal of each point wins.

    A proposal's scale is all edges that touch the cluster; both ratios must be
    below their limits. The order is the larger normalised ratio, then the
    ratios, the edge and the cluster.
    """
    own = labels.select("pid", F.col("label").alias("comp"))
    stats = incident_stats(edges, own).where("comp >= 0")
    sided = labelled_edges(edges, own)
    sides = F.array(F.struct(F.col("cu").alias("comp"), F.col("cv").alias("other"), F.col("v").alias("outer")), F.struct(F.col("cv").alias("comp"), F.col("cu").alias("other"), F.col("u").alias("outer")))
    each = sided.withColumn("s", F.explode(sides)).select("u", "v", "len_o", "len_p", "s.*").where("comp >= 0 and other = -1").join(stats, "comp")
    each = each.select("u", "v", "comp", "outer", robust_ratio(F.col("len_o"), F.col("med_o"), F.col("q75_o")).alias("ratio_o"), robust_ratio(F.col("len_p"), F.col("med_p"), F.col("q75_p")).alias("ratio_p"))
    each = each.where((F.col("ratio_o") < limit) & (F.col("ratio_p") < projected))
    order = Window.partitionBy("outer").orderBy(F.greatest(F.col("ratio_o") / limit, F.col("ratio_p") / projected), "ratio_o", "ratio_p", "u", "v", "comp")
    return each.withColumn("r", F.row_number().over(order)).where("r = 1").select(F.col("outer").alias("pid"), F.col("comp").alias("label"), "ratio_o", "ratio_p")


FROZEN = 2_000_000  # edges whose rounds of frozen growth one task runs


def frozen_growth(edges: DataFrame, labels: DataFrame, limit: float, projected: float, small: int = FROZEN) -> DataFrame:
    """Rounds of :func:`frozen_growth_round` until no cluster claims a point; each round measures the clusters anew.

    Returns ``pid, label, round``: the round in which a point was claimed, 0 where
    it kept its label. Clusters never merge. There are as many rounds as the longest
    way of a cluster into the noise has steps, and each depends on all that the one
    before claimed. Up to ``small`` edges, one task runs them all; more take a few jobs a round.
    """
    edges = materialise(edges.select("u", "v", "len_o", "len_p"), "edges")
    state = labels.select("pid", F.col("label").cast("long"), F.lit(0).alias("round"))
    if edges.count() <= small:
        sided = labelled_edges(edges, state.select("pid", F.coalesce("label", F.lit(-2)).alias("comp"))).repartition(1)
        won = materialise(sided.mapInArrow(lambda b: _frozen_rounds(b, limit, projected), "pid long, to long, won int"), "claims")
        return state.join(won, "pid", "left").select("pid", F.coalesce("to", "label").alias("label"), F.coalesce("won", "round").alias("round"))
    for number in count(1):  # every round but the last assigns a point
        won = materialise(frozen_growth_round(edges, state, limit, projected).select("pid", F.col("label").alias("to")), "claims")
        if not won.limit(1).count():
            return state
        state = materialise(state.join(won, "pid", "left").select("pid", F.coalesce("to", "label").alias("label"), F.when(F.col("to").isNotNull(), F.lit(number)).otherwise(F.col("round")).alias("round")), "frozen")


def _interpolated(x: np.ndarray, p: float) -> float:
    """Quantile of ascending values as Spark's percentile has it; NaN of none."""
    if not len(x):
        return np.nan
    at = p * (len(x) - 1)
    low, high = int(np.floor(at)), int(np.ceil(at))
    return x[low] if low == high or x[low] == x[high] else (high - at) * x[low] + (at - low) * x[high]


def _frozen_rounds(batches: Iterator[pa.RecordBatch], limit: float, projected: float) -> Iterator[pa.RecordBatch]:
    """All claims ``pid, to, won`` (the round) of frozen growth over edges ``u, v, len_o, len_p, cu, cv``.

    The lengths that touch a cluster are kept in order, and a claim adds those of
    its point; a round looks only at edges from clusters to points without one.
    """
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    t = pa.Table.from_batches(batches)
    u, v, cu, cv = (t.column(c).to_numpy().astype(np.int64) for c in ("u", "v", "cu", "cv"))
    lengths = np.stack([t.column(c).to_numpy().astype(float) for c in ("len_o", "len_p")])
    known = np.stack([~t.column(c).is_null().to_numpy().astype(bool) for c in ("len_o", "len_p")])  # percentile leaves nulls out
    pids, ends = np.unique(np.r_[u, v], return_inverse=True)
    ends = ends.reshape(2, -1)
    label = np.empty(len(pids), np.int64)
    label[ends[0]], label[ends[1]] = cu, cv
    of = np.argsort(ends.ravel(), kind="stable") % len(u)  # the edges of each point
    first = np.r_[0, np.cumsum(np.bincount(ends.ravel(), minlength=len(pids)))]
    names = np.unique(label[label >= 0])
    place = np.where(label >= 0, np.searchsorted(names, label), np.where(label == -1, -1, -2))  # the cluster's position
    held = [[np.zeros(0), np.zeros(0)] for _ in names]
    scale = np.full((len(names), 2, 2), np.nan)  # median and q75 in both spaces

    def add(edge: np.ndarray, cluster: np.ndarray) -> None:
        order = np.argsort(cluster, kind="stable")
        edge, cluster = edge[order], cluster[order]
        cuts = np.r_[0, np.flatnonzero(np.diff(cluster)) + 1, len(cluster)]
        for i, j in zip(cuts[:-1], cuts[1:]):
            for k in range(2):
                new = np.sort(lengths[k, edge[i:j][known[k, edge[i:j]]]])
                had = held[cluster[i]][k]
                held[cluster[i]][k] = had = np.insert(had, np.searchsorted(had, new), new) if len(had) else new
                scale[cluster[i], k] = _interpolated(had, 0.5), _interpolated(had, 0.75)

    at = place[ends]
    both = at[0] == at[1]
    touching = [np.flatnonzero((at[k] >= 0) & (~both if k else True)) for k in range(2)]
    if any(map(len, touching)):
        add(np.concatenate(touching), np.concatenate([at[k, e] for k, e in enumerate(touching)]))
    # edges from a cluster's end to one without
    starts = [np.flatnonzero((at[k] >= 0) & (at[1 - k] == -1)) for k in range(2)]
    rim, side = np.concatenate(starts), np.repeat([0, 1], [len(e) for e in starts])
    for number in count(1):
        mine, outer = place[ends[side, rim]], ends[1 - side, rim]
        spread = scale[mine, :, 1] - scale[mine, :, 0]
        ratio = (lengths[:, rim].T - scale[mine, :, 0]) / np.where(np.isnan(spread), spread, np.maximum(spread, 1e-12))
        ok = np.flatnonzero((ratio[:, 0] < limit) & (ratio[:, 1] < projected))
        if not len(ok):
            return
        o, p = ratio[ok].T
        best = ok[np.lexsort((names[mine[ok]], v[rim[ok]], u[rim[ok]], p, o, np.maximum(o / limit, p / projected)))]
        taken, pick = np.unique(outer[best], return_index=True)  # the first of each point
        to = mine[best[pick]]
        yield pa.RecordBatch.from_arrays([pa.array(pids[taken]), pa.array(names[to]), pa.array(np.full(len(taken), number, np.int32))], ["pid", "to", "won"])
        n = first[taken + 1] - first[taken]
        edge = of[np.repeat(first[taken] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]
        point, cluster = np.repeat(taken, n), np.repeat(to, n)
        across = np.where(ends[0, edge] == point, ends[1, edge], ends[0, edge])
        fresh = np.unique(np.c_[edge, cluster][place[across] != cluster], axis=0)
        place[taken] = to
        if len(fresh):
            add(fresh[:, 0], fresh[:, 1])
        stay = place[outer] == -1
        more = place[across] == -1
        rim, side = np.r_[rim[stay], edge[more]], np.r_[side[stay], (ends[1, edge[more]] == point[more]).astype(int)]


def growth_added_points(pts: DataFrame, labels: DataFrame, large: DataFrame, state: DataFrame) -> DataFrame:
    """``pid, comp`` of points outside the large seed components (``labels, large``) that growth (``state``) brought into one of theirs."""
    final = components(pts, state.where("seed or accepted").select("u", "v"))
    started = labels.join(large.select("comp"), "comp", "left_semi").select("pid")
    active = final.join(started, "pid", "left_semi").select("comp").distinct()
    return final.join(active, "comp", "left_semi").join(started, "pid", "left_anti").select("pid", "comp")


def removable_edges(state: DataFrame, interior: DataFrame, added: DataFrame, layer: DataFrame | None = None) -> DataFrame:
    """Edges that a cut may remove: accepted ones, and edges of the interior restoration that touch a point which growth added.

    With a boundary ``layer`` (``u, v``) only those in it.
    """
    touched = interior.join(added.select(F.col("pid").alias("u")), "u", "left_semi").union(interior.join(added.select(F.col("pid").alias("v")), "v", "left_semi").select("u", "v"))
    out = state.where("accepted").select("u", "v").union(touched.select("u", "v")).distinct()
    return out if layer is None else out.join(layer.select("u", "v"), ["u", "v"], "left_semi")


def dominant_cluster(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Noise points most of whose clustered neighbours are of one cluster: more than half; ties to the smaller."""
    half = half_edges(edges)
    votes = (
        half.join(labels.where("label = -1").select(F.col("pid").alias("src")), "src")
        .join(labels.where("label >= 0").select(F.col("pid").alias("dst"), "label"), "dst").groupBy("src", "label").agg(F.count("*").alias("n"))
    )
    own = Window.partitionBy("src")
    best = votes.withColumn("all", F.sum("n").over(own)).withColumn("r", F.row_number().over(own.orderBy(F.desc("n"), "label"))).where("r = 1")
    return best.where(F.col("n") * 2 > F.col("all")).select(F.col("src").alias("pid"), "label", "n")


def outlier_merge(edges: DataFrame, kept: DataFrame, pts: DataFrame, labels: DataFrame, limit: float) -> DataFrame:
    """Labels after noise points joined their dominant cluster, if their nearest member is within median + limit * IQR of its edges.

    All ``edges`` vote for a point's cluster, since its own may have been left out
    for good reason; a cluster's scale is that of the ``kept`` edges inside it, and
    a cluster without any takes no point.
    Points within reach differ by no more than that in their distance from the
    origin, so they meet in equal or neighbouring shells of the cluster.
    """
    own = labels.select("pid", F.col("label").alias("comp"))
    stats = internal_stats(kept, own).where("comp >= 0").select(F.col("comp").alias("label"), (F.col("med_o") + limit * floored(F.col("q75_o") - F.col("q25_o"))).alias("reach"))
    shell = lambda x: F.floor(F.sqrt(F.aggregate(F.transform(x, lambda v: v * v), F.lit(0.0), lambda z, v: z + v)) / (F.greatest("reach", F.lit(1e-12)) * (1 + 1e-9)))
    voted = dominant_cluster(edges, labels).join(stats, "label").join(pts.select("pid", "x"), "pid")
    voted = voted.withColumn("shell", F.explode(F.array(*(shell("x") + F.lit(i) for i in (-1, 0, 1)))))
    members = labels.join(stats, "label").join(pts.select("pid", F.col("x").alias("mx")), "pid").select("label", shell("mx").alias("shell"), "mx")
    near = voted.join(members, ["label", "shell"]).groupBy("pid", "label", "reach").agg(F.min(distance(F.col("x"), F.col("mx"))).alias("near"))
    joined = near.where("near <= reach").select("pid", F.col("label").alias("to"))
    return labels.join(joined, "pid", "left").select("pid", F.coalesce("to", "label").alias("label"))


def final_prediction(labels: DataFrame, edges: DataFrame, min_edges: int) -> DataFrame:
    """Component ids of components with more than ``min_edges`` edges, -1 for the others' points."""
    keep = component_counts(labels, edges).where(F.col("n_edges") > min_edges).select("comp", F.col("comp").alias("label"))
    return labels.join(keep, "comp", "left").select("pid", F.coalesce("label", F.lit(-1)).cast("long").alias("label"))
