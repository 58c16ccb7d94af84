"""The clustering plan over the ``embeddings`` table, its queries, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from geoloom.operators import bridges as br, delaunay as dl, density as de, edges as ed, evaluate as ev, growth as gr, layout as ly, mergetree as mt, modes as mo, neighbors as nb, points as po, prune as pr, reclaim as rc, topology as tp, waves as wv
from geoloom.sources import results
from geoloom.sources.shared import materialise

K, LIMIT, MIN_EDGES = 50, 0.5, 2
#: Limits of growth (original, projected) and restoration at which the seeds of ``embeddings``, few and tight, do grow.
GROW, RESTORE = (12.0, 6.0), 5.0


class Clustering:
    """The tables that the stages share, each made once when first asked for.

    ``edge_set`` is ``gabriel`` or ``delaunay`` (all of its edges); ``projection``
    is ``plane`` (the first two features) or ``pca`` (of standardised features).
    """

    def __init__(self, spark: SparkSession, sf_dir: str, edge_set: str = "gabriel", projection: str = "plane"):
        if edge_set not in ("gabriel", "delaunay") or projection not in ("plane", "pca"):
            raise ValueError(f"unknown edge set or projection: {edge_set}, {projection}")
        self.spark, self.dir, self.edge_set, self.projection = spark, sf_dir, edge_set, projection

    def on_all_edges(self, projection: str = "plane") -> Clustering:
        return Clustering(self.spark, self.dir, "delaunay", projection)

    @cached_property
    def pts(self) -> DataFrame:
        return po.points(self.spark.read.parquet(f"{self.dir}/embeddings.parquet"))

    @cached_property
    def flat(self) -> DataFrame:
        return po.plane(self.pts) if self.projection == "plane" else materialise(po.principal_plane(po.standardize(self.pts)), "plane")

    @cached_property
    def triangles(self) -> DataFrame:
        return dl.delaunay(self.flat)

    @cached_property
    def edges(self) -> DataFrame:
        if self.edge_set == "delaunay":
            return self.all_edges
        return materialise(ed.measured(dl.gabriel_edges(self.flat, self.triangles), self.pts, self.flat), "edges")

    @cached_property
    def all_edges(self) -> DataFrame:
        return materialise(ed.measured(dl.edges_from_triangles(self.triangles), self.pts, self.flat), "all_edges")

    @cached_property
    def near(self) -> DataFrame:
        return materialise(nb.knn(self.pts, K), "knn")

    @cached_property
    def near_flat(self) -> DataFrame:
        return materialise(nb.knn(self.flat.select("pid", F.array("px", "py").alias("x")), 10), "knn_flat")

    @cached_property
    def related(self) -> DataFrame:
        return materialise(nb.edge_relation(self.edges, self.near), "related")

    @cached_property
    def select(self) -> DataFrame:
        return materialise(nb.selectivity(self.pts, self.edges, self.near), "selectivity")

    @cached_property
    def seeds(self) -> DataFrame:
        return materialise(ed.seed_edges(ed.hard_gate(self.related, LIMIT)), "seeds")

    @cached_property
    def seed(self) -> DataFrame:
        return self.seeds.where("is_seed").select("u", "v", "len_o", "len_p")

    @cached_property
    def labels(self) -> DataFrame:
        return materialise(gr.components(self.pts, self.seed), "seed_comp")

    @cached_property
    def large(self) -> DataFrame:
        return gr.component_counts(self.labels, self.seed).where(F.col("n_edges") > MIN_EDGES)

    @cached_property
    def pred(self) -> DataFrame:
        return materialise(gr.final_prediction(self.labels, self.seed, MIN_EDGES), "pred")

    @cached_property
    def growth(self) -> DataFrame:
        return materialise(gr.sequential_growth(self.edges, self.pts, self.seed, MIN_EDGES, *GROW, RESTORE), "growth_state")

    @cached_property
    def restored_first(self) -> DataFrame:
        return gr.seed_restoration(self.edges, self.labels, self.large, self.seed, RESTORE)

    @cached_property
    def interior(self) -> DataFrame:
        return materialise(gr.interior_restoration(self.edges, self.pts, self.seed, self.growth, None), "interior")

    @cached_property
    def kept_inside(self) -> DataFrame:
        """Result of growth with the interior restoration."""
        grown = self.growth.where("seed or accepted or restored").select("u", "v").union(self.interior)
        return materialise(grown.join(self.edges.select("u", "v", "len_o", "len_p"), ["u", "v"]), "kept_inside")

    @cached_property
    def waves(self) -> DataFrame:
        return materialise(wv.wave_growth(wave_edges(self), self.pts, -0.5, 0, 0.25), "waves")

    @cached_property
    def spanning(self) -> DataFrame:
        return materialise(de.spanning_tree(self.pts, self.near, 10), "spanning_tree")

    @cached_property
    def redundancy(self) -> DataFrame:
        return materialise(pr.edge_redundancy(self.edges, gr.components(self.pts, self.edges)), "redundancy")

    @cached_property
    def spread(self) -> DataFrame:
        """The layout of the fuzzy graph after a few epochs, from the principal plane."""
        return materialise(ly.layout(nb.fuzzy_graph(self.near), po.principal_plane(self.pts), 8), "spread")

    @cached_property
    def recall10(self) -> DataFrame:
        return nb.recall(self.near, self.near_flat, 10)

    @cached_property
    def added(self) -> DataFrame:
        return gr.growth_added_points(self.pts, self.labels, self.large, self.growth)

    @cached_property
    def truth(self) -> DataFrame:
        return self.pred.join(self.pts.select("pid", "y"), "pid")


def grown_labels(b: Clustering, limit: float = GROW[0], projected: float = GROW[1], restore: float | None = RESTORE, mode: str = "real", min_edges: int = MIN_EDGES, outliers: float | None = None) -> DataFrame:
    """Labels after the seeds: growth, components of what is retained, noise, and the outlier merge if it has a limit.

    Returns ``pid, label`` (-1: noise).
    """
    state = gr.sequential_growth(b.edges, b.pts, b.seed, min_edges, limit, projected, restore, mode)
    kept = materialise(state.where("seed or accepted or restored").select("u", "v").join(b.edges, ["u", "v"]), "retained")
    labels = materialise(gr.final_prediction(gr.components(b.pts, kept.select("u", "v")), kept, min_edges), "grown")
    return labels if outliers is None else gr.outlier_merge(b.edges, kept, b.pts, labels, outliers)


def wave_edges(b: Clustering, relaxed: float = 1.5, tau: float = 0.1) -> DataFrame:
    """Edges with what wave growth asks for: mutual neighbours as seeds, the relaxed gate by selective ends, open-space scores."""
    gates = ed.relaxed_gate(b.related, b.select, LIMIT, relaxed, tau, "knn_relaxed").select("u", "v", F.col("allowed_growth").alias("relaxed"))
    marked = ed.seed_edges(ed.hard_gate(b.related, LIMIT), "mutual").select("u", "v", "len_o", "allowed", (F.col("uv") | F.col("vu")).alias("near"), F.col("is_seed").alias("seed"))
    return materialise(marked.join(gates, ["u", "v"]).join(wv.outer_scores(b.edges), ["u", "v"]), "wave_input")


def wave_labels(b: Clustering, mild: float = -0.5, min_edges: int = 0, min_points: int = 10, relaxation: float | None = 0.25, bridges: int | None = 5, outliers: float | None = 1.0) -> DataFrame:
    """The estimator: wave growth, short-path bridges of what it took go, components of enough points, outlier merge.

    Returns ``pid, label``: the smallest point of the cluster, -1 for points of smaller components.
    """
    grown = wv.wave_growth(wave_edges(b), b.pts, mild, min_edges, relaxation).where("taken").select("u", "v").join(b.edges, ["u", "v"])
    kept = materialise(grown, "wave_taken")
    if bridges is not None:
        gone = pr.short_path_bridges(kept.select("u", "v"), bridges)
        kept = materialise(kept.join(gone, ["u", "v"], "left_anti"), "wave_kept")
    found = materialise(gr.components(b.pts, kept.select("u", "v")), "wave_components")
    big = found.groupBy("comp").agg(F.count("*").alias("n")).where(F.col("n") >= min_points).select("comp", F.col("comp").alias("label"))
    labels = materialise(found.join(big, "comp", "left").select("pid", F.coalesce("label", F.lit(-1).cast("long")).alias("label")), "wave_clusters")
    return labels if outliers is None else gr.outlier_merge(b.edges, kept, b.pts, labels, outliers)


def cluster_labels(b: Clustering) -> DataFrame:
    """The whole plan: seeds, growth with restoration, interior restoration, vertex cuts, noise, cost-gate reclaim.

    Returns ``pid, label, cost`` (-1: noise; cost of a reclaimed point's path).
    """
    state = b.growth
    grown = state.where("seed or accepted or restored").select("u", "v").join(b.edges, ["u", "v"])
    labels = materialise(gr.components(b.pts, grown.select("u", "v")), "grown_comp")
    back = gr.restored(b.edges, labels, b.seed, RESTORE)
    retained = materialise(grown.select("u", "v").union(back).distinct().join(b.edges.select("u", "v", "len_o", "len_p"), ["u", "v"]), "retained")
    cut = materialise(pr.vertex_cut(retained, labels, min_points=10, fraction=0.2), "cut_points")
    retained = pr.without_points(retained, cut)
    labels = materialise(gr.components(b.pts, retained.select("u", "v")), "final_comp")
    noise = materialise(gr.final_prediction(labels, retained, MIN_EDGES), "noise")
    return rc.cost_gate(b.edges, noise, nb.core_distance(b.near, 15)).select("pid", "label", "cost")


def write_clustering(b: Clustering, folder: str, dataset: str) -> str:
    """Edges with the flags of growth, points with their grown labels, edges by round, and the summary, as a finished run."""
    state = b.growth
    kept = materialise(state.where("seed or accepted or restored").select("u", "v").join(b.edges, ["u", "v"]), "retained")
    labels = gr.final_prediction(gr.components(b.pts, kept.select("u", "v")), kept, MIN_EDGES)
    rounds = state.where("round > 0").groupBy("round").agg(F.count_if("accepted").alias("accepted"), F.count_if("restored").alias("restored"))
    tables = {"edges": b.edges.join(state, ["u", "v"]), "points": b.pts.select("pid", "y").join(labels, "pid"), "rounds": rounds}
    return results.write_run(b.spark, folder, dataset, tables, run_summary(b).first().summary)


def run_summary(b: Clustering) -> DataFrame:
    """One row of JSON: counts of every stage and the scores of the seed labelling."""
    counts = b.truth.agg(F.count("*").alias("n_points"), F.count_distinct(F.when(F.col("label") >= 0, F.col("label"))).alias("n_clusters"))
    edges = b.seeds.agg(F.count("*").alias("n_edges"), F.sum(F.col("is_seed").cast("long")).alias("n_seed_edges"))
    row = counts.crossJoin(edges).crossJoin(ev.adjusted_rand(b.truth)).crossJoin(ev.information_scores(b.truth))
    scores = F.struct(*(F.round(c, 6).alias(c) for c in ("ari", "nmi", "homogeneity", "completeness", "v_measure")))
    return row.select(F.to_json(F.struct("n_points", "n_edges", "n_seed_edges", "n_clusters", scores.alias("scores"))).alias("summary"))


BASE_SQL = """
WITH RECURSIVE pts AS (SELECT vec_id AS pid, CAST(embedding AS DOUBLE[]) AS x, CAST(label AS BIGINT) AS y FROM embeddings),
flat AS MATERIALIZED (SELECT pid, x[1] AS px, x[2] AS py FROM pts),
gab AS MATERIALIZED (
  SELECT a.pid AS u, b.pid AS v FROM flat a JOIN flat b ON a.pid < b.pid WHERE NOT EXISTS (
    SELECT 1 FROM flat w WHERE w.pid <> a.pid AND w.pid <> b.pid AND (a.px - w.px) * (b.px - w.px) + (a.py - w.py) * (b.py - w.py) < 0)),
edges AS MATERIALIZED (
  SELECT u, v, list_distance(p.x, q.x) AS len_o, sqrt(pow(p.x[1] - q.x[1], 2) + pow(p.x[2] - q.x[2], 2)) AS len_p,
    (p.x[1] + q.x[1]) / 2 AS cx, (p.x[2] + q.x[2]) / 2 AS cy FROM gab JOIN pts p ON p.pid = u JOIN pts q ON q.pid = v),
half AS (SELECT u AS src, v AS dst, len_o, len_p FROM edges UNION ALL SELECT v, u, len_o, len_p FROM edges)"""
KNN_SQL = """,
knn AS MATERIALIZED (
  SELECT * FROM (SELECT a.pid, b.pid AS nid, CAST(row_number() OVER (PARTITION BY a.pid ORDER BY list_distance(a.x, b.x), b.pid) AS INTEGER) AS rank, list_distance(a.x, b.x) AS dist
  FROM pts a JOIN pts b ON a.pid <> b.pid) WHERE rank <= 50),
related AS MATERIALIZED (
  SELECT e.*, EXISTS (SELECT 1 FROM knn WHERE pid = u AND nid = v) AS uv, EXISTS (SELECT 1 FROM knn WHERE pid = v AND nid = u) AS vu FROM edges e),
sel AS MATERIALIZED (
  SELECT p.pid, count(h.dst) AS degree, count(k.nid) AS passed, 1 - coalesce(count(k.nid) / nullif(count(h.dst), 0), 0) AS selectivity
  FROM pts p LEFT JOIN half h ON h.src = p.pid LEFT JOIN knn k ON k.pid = h.src AND k.nid = h.dst GROUP BY p.pid)"""
SEED_SQL = KNN_SQL + """,
lim AS (SELECT median(len_o) + 0.5 * greatest(quantile_cont(len_o, 0.75) - quantile_cont(len_o, 0.25), 1e-12) AS t_o,
  median(len_p) + 0.5 * greatest(quantile_cont(len_p, 0.75) - quantile_cont(len_p, 0.25), 1e-12) AS t_p FROM edges),
seeds AS MATERIALIZED (SELECT r.*, len_o <= t_o AND len_p <= t_p AS allowed, (uv OR vu) AND len_o <= t_o AND len_p <= t_p AS is_seed FROM related r, lim),
seed AS MATERIALIZED (SELECT * FROM seeds WHERE is_seed),
sh AS (SELECT u, v FROM seed UNION SELECT v, u FROM seed),
reach AS (SELECT pid AS id, pid AS r FROM pts UNION SELECT reach.id, sh.v FROM reach JOIN sh ON sh.u = reach.r),
labels AS MATERIALIZED (SELECT id AS pid, min(r) AS comp FROM reach GROUP BY id),
le AS MATERIALIZED (SELECT e.*, a.comp AS cu, b.comp AS cv FROM edges e JOIN labels a ON a.pid = u JOIN labels b ON b.pid = v),
se AS MATERIALIZED (SELECT le.* FROM le JOIN seed USING (u, v)),
cnt AS MATERIALIZED (SELECT l.comp, count(*) AS n_points, coalesce(max(n), 0) AS n_edges FROM labels l LEFT JOIN (SELECT cu, count(*) AS n FROM se GROUP BY cu) s ON s.cu = l.comp GROUP BY l.comp),
large AS (SELECT * FROM cnt WHERE n_edges > 2),
stats AS MATERIALIZED (SELECT cu AS comp, count(*) AS n_edges, quantile_cont(len_o, 0.25) AS q25_o, median(len_o) AS med_o, quantile_cont(len_o, 0.75) AS q75_o, median(len_p) AS med_p, quantile_cont(len_p, 0.75) AS q75_p FROM se GROUP BY cu),
sides AS (SELECT u, v, len_o, len_p, cu AS comp, cv AS outer_, v AS outer_pid FROM le WHERE cu <> cv UNION ALL SELECT u, v, len_o, len_p, cv, cu, u FROM le WHERE cu <> cv),
bnd AS MATERIALIZED (SELECT s.* FROM sides s JOIN large USING (comp)),
scores AS MATERIALIZED (SELECT u, v, b.comp, outer_, (len_o - med_o) / greatest(q75_o - med_o, 1e-12) AS ratio_o, (len_p - med_p) / greatest(q75_p - med_p, 1e-12) AS ratio_p FROM bnd b JOIN stats s ON s.comp = b.comp),
istats AS (SELECT comp, count(*) AS n_edges, quantile_cont(len_o, 0.25) AS q25_o, median(len_o) AS med_o, quantile_cont(len_o, 0.75) AS q75_o, median(len_p) AS med_p, quantile_cont(len_p, 0.75) AS q75_p
  FROM (SELECT len_o, len_p, cu AS comp FROM le UNION ALL SELECT len_o, len_p, cv FROM le WHERE cu <> cv) GROUP BY comp),
pred AS MATERIALIZED (SELECT l.pid, CASE WHEN c.n_edges > 2 THEN l.comp ELSE -1 END AS label, p.y FROM labels l JOIN cnt c USING (comp) JOIN pts p USING (pid)),
inner_half AS MATERIALIZED (SELECT cu AS comp, u AS src, v AS dst, len_o FROM se UNION ALL SELECT cu, v, u, len_o FROM se),
nearest AS MATERIALIZED (SELECT comp, src, min(len_o) AS near FROM inner_half GROUP BY ALL),
tab AS (SELECT y, label, count(*) AS n FROM pred WHERE y IS NOT NULL GROUP BY ALL),
ma AS (SELECT y, sum(n) AS ny FROM tab GROUP BY y), mb AS (SELECT label, sum(n) AS nl FROM tab GROUP BY label), mt AS (SELECT CAST(sum(n) AS DOUBLE) AS m FROM tab),
plabel AS (SELECT pid, label FROM pred),
pe AS (SELECT e.u, e.v, e.len_o, e.len_p, a.label AS cu, b.label AS cv FROM edges e JOIN plabel a ON a.pid = u JOIN plabel b ON b.pid = v)"""

PRE_SQL = """,
pre AS MATERIALIZED (SELECT le.* FROM le JOIN large ON large.comp = cu JOIN stats s ON s.comp = cu WHERE cu = cv AND len_o <= med_o + 5.0 * greatest(q75_o - q25_o, 1e-12) AND NOT EXISTS (SELECT 1 FROM seed WHERE seed.u = le.u AND seed.v = le.v))"""

Query = tuple[Callable[[Clustering], DataFrame], str | None, tuple[str, ...]]
NUM = ("len_o", "len_p")


def _gate(sql: str) -> str:
    """SQL of the thresholds and both relaxed allowances."""
    return SEED_SQL + """,
loose AS (SELECT median(len_o) + 1.5 * greatest(quantile_cont(len_o, 0.75) - quantile_cont(len_o, 0.25), 1e-12) AS l_o, median(len_p) + 1.5 * greatest(quantile_cont(len_p, 0.75) - quantile_cont(len_p, 0.25), 1e-12) AS l_p FROM edges),
g AS (SELECT s.*, len_o <= l_o AND len_p <= l_p AS loose, a.selectivity AS su, b.selectivity AS sv, uv OR vu AS near FROM seeds s, loose, sel a, sel b WHERE a.pid = u AND b.pid = v)
SELECT u, v, len_o, len_p, """ + sql + " FROM g"


def _relaxed(mode: str):
    return lambda b: ed.relaxed_gate(b.related, b.select, LIMIT, 1.5, 0.1, mode)


QUERIES: dict[str, Query] = {
    "scan_points": (lambda b: b.pts.select("pid", F.size("x").alias("d"), "y"), " SELECT pid, CAST(len(x) AS INTEGER) AS d, y FROM pts", ()),
    "standardize": (
        lambda b: po.standardize(b.pts).select("pid", F.posexplode("x").alias("pos", "z")),
        """, ex AS (SELECT pid, unnest(range(0, len(x))) AS pos, unnest(x) AS v FROM pts),
st AS (SELECT pos, avg(v) AS m, stddev_pop(v) AS s FROM ex GROUP BY pos)
SELECT pid, CAST(pos AS INTEGER) AS pos, (v - m) / CASE WHEN s > 0 THEN s ELSE 1 END AS z FROM ex JOIN st USING (pos)""", ("z",)),
    "project_none": (lambda b: b.flat, " SELECT * FROM flat", ("px", "py")),
    "gabriel_edges": (lambda b: b.edges.select("u", "v"), " SELECT u, v FROM gab", ()),
    "edge_length_original": (lambda b: b.edges.select("u", "v", "len_o"), " SELECT u, v, len_o FROM edges", ("len_o",)),
    "edge_length_projected": (lambda b: b.edges.select("u", "v", "len_p"), " SELECT u, v, len_p FROM edges", ("len_p",)),
    "edge_center": (lambda b: b.edges.select("u", "v", "cx", "cy"), " SELECT u, v, cx, cy FROM edges", ("cx", "cy")),
    "edge_segments": (lambda b: ed.segments(b.edges, b.flat), " SELECT u, v, a.px AS x1, a.py AS y1, b.px AS x2, b.py AS y2 FROM edges JOIN flat a ON a.pid = u JOIN flat b ON b.pid = v", ("x1", "y1", "x2", "y2")),
    "edge_length_quartiles": (
        lambda b: ed.quartile_row(b.edges, "len_o"),
        " SELECT quantile_cont(len_o, 0.25) AS q25, median(len_o) AS median, quantile_cont(len_o, 0.75) AS q75, greatest(quantile_cont(len_o, 0.75) - quantile_cont(len_o, 0.25), 1e-12) AS iqr, avg(len_o) AS mean FROM edges",
        ("q25", "median", "q75", "iqr", "mean")),
    "edge_length_moments": (
        lambda b: ed.length_moments(b.edges),
        """ SELECT median(len_o) AS median, quantile_cont(len_o, 0.75) - quantile_cont(len_o, 0.25) AS iqr, quantile_cont(len_o, 0.05) AS p05, quantile_cont(len_o, 0.95) AS p95, avg(len_o) AS mean, stddev_pop(len_o) AS std,
avg(pow(len_o - m, 3)) / pow(avg(pow(len_o - m, 2)), 1.5) AS skew, avg(pow(len_o - m, 4)) / pow(avg(pow(len_o - m, 2)), 2) - 3 AS kurtosis FROM edges, (SELECT avg(len_o) AS m FROM edges)""",
        ("median", "iqr", "p05", "p95", "mean", "std", "skew", "kurtosis")),
    "hard_threshold": (
        lambda b: ed.hard_threshold(b.edges, "len_o", LIMIT).select(F.lit("median_iqr").alias("kind"), "threshold")
        .union(ed.hard_threshold(b.edges, "len_o", LIMIT, "mean").select(F.lit("mean_iqr"), "threshold"))
        .union(ed.hard_threshold(b.edges, "len_o", LIMIT, "median", True).select(F.lit("median_times"), "threshold"))
        .union(ed.hard_threshold(b.edges, "len_o", LIMIT, "mean", True).select(F.lit("mean_times"), "threshold")),
        """, q AS (SELECT median(len_o) AS md, avg(len_o) AS mn, greatest(quantile_cont(len_o, 0.75) - quantile_cont(len_o, 0.25), 1e-12) AS iqr FROM edges)
SELECT 'median_iqr' AS kind, md + 0.5 * iqr AS threshold FROM q UNION ALL SELECT 'mean_iqr', mn + 0.5 * iqr FROM q UNION ALL SELECT 'median_times', md * 1.5 FROM q UNION ALL SELECT 'mean_times', mn * 1.5 FROM q""", ("threshold",)),
    "hard_gate_strict": (lambda b: b.seeds.select("u", "v", "allowed"), SEED_SQL + " SELECT u, v, allowed FROM seeds", ()),
    "hard_gate_separate": (
        lambda b: ed.hard_gate(b.edges, LIMIT).select("u", "v", F.col("allowed").alias("allowed_seed")).join(ed.hard_gate(b.edges, 1.6).select("u", "v", F.col("allowed").alias("allowed_growth")), ["u", "v"]),
        """, q AS (SELECT median(len_o) AS mo, greatest(quantile_cont(len_o, 0.75) - quantile_cont(len_o, 0.25), 1e-12) AS io, median(len_p) AS mp, greatest(quantile_cont(len_p, 0.75) - quantile_cont(len_p, 0.25), 1e-12) AS ip FROM edges)
SELECT u, v, len_o <= mo + 0.5 * io AND len_p <= mp + 0.5 * ip AS allowed_seed, len_o <= mo + 1.6 * io AND len_p <= mp + 1.6 * ip AS allowed_growth FROM edges, q""", ()),
    "hard_gate_knn_relaxed": (
        _relaxed("knn_relaxed"),
        _gate("allowed OR (near AND loose AND least(su, sv) > 0.1) AS allowed_seed, allowed OR (near AND loose AND greatest(CASE WHEN uv THEN su ELSE 0 END, CASE WHEN vu THEN sv ELSE 0 END) > 0.1) AS allowed_growth"), NUM),
    "hard_gate_knn_growth_relaxed": (_relaxed("knn_growth_relaxed"), _gate("allowed AS allowed_seed, allowed OR (near AND loose AND least(su, sv) > 0.1) AS allowed_growth"), NUM),
    "hard_gate_knn_global": (_relaxed("knn_global"), _gate("allowed OR (near AND loose) AS allowed_seed, allowed OR (near AND loose) AS allowed_growth"), NUM),
    "knn_join": (lambda b: b.near, KNN_SQL + " SELECT * FROM knn", ("dist",)),
    "knn_edge_relation": (lambda b: b.related.select("u", "v", "uv", "vu"), KNN_SQL + " SELECT u, v, uv, vu FROM related", ()),
    "knn_union": (lambda b: b.related.where("uv or vu").select("u", "v"), KNN_SQL + " SELECT u, v FROM related WHERE uv OR vu", ()),
    "knn_mutual": (lambda b: b.related.where("uv and vu").select("u", "v"), KNN_SQL + " SELECT u, v FROM related WHERE uv AND vu", ()),
    "knn_selectivity": (lambda b: b.select, KNN_SQL + " SELECT * FROM sel", ("selectivity",)),
    "recall_at_10": (
        lambda b: b.recall10,
        KNN_SQL + """, kf AS (SELECT * FROM (SELECT a.pid, b.pid AS nid, row_number() OVER (PARTITION BY a.pid ORDER BY sqrt(pow(a.px - b.px, 2) + pow(a.py - b.py, 2)), b.pid) AS rank FROM flat a JOIN flat b ON a.pid <> b.pid) WHERE rank <= 10)
SELECT p.pid, count(f.nid) / 10 AS recall FROM pts p LEFT JOIN knn k ON k.pid = p.pid AND k.rank <= 10 LEFT JOIN kf f ON f.pid = k.pid AND f.nid = k.nid GROUP BY p.pid""", ("recall",)),
    "core_distance": (lambda b: nb.core_distance(b.near, 15), KNN_SQL + " SELECT pid, avg(dist) AS core FROM knn WHERE rank <= 15 GROUP BY pid", ("core",)),
    "point_q25": (
        lambda b: ed.incident_q25(b.edges, b.pts),
        " SELECT p.pid, coalesce(quantile_cont(len_o, 0.25), (SELECT quantile_cont(len_o, 0.25) FROM edges)) AS q25 FROM pts p LEFT JOIN half ON src = p.pid GROUP BY p.pid", ("q25",)),
    "top3_incident": (
        lambda b: ed.top_incident(b.edges),
        " SELECT * FROM (SELECT src, dst, len_o, CAST(row_number() OVER (PARTITION BY src ORDER BY len_o DESC, least(src, dst), greatest(src, dst)) AS INTEGER) AS rank FROM half) WHERE rank <= 3", ("len_o",)),
    "open_space_score": (
        lambda b: ed.second_other_length(b.edges).select("src", "dst", "second_len", "open_space"),
        """, o AS (SELECT a.src, a.dst, a.len_o, b.len_o AS other, row_number() OVER (PARTITION BY a.src, a.dst ORDER BY b.len_o DESC, least(b.src, b.dst), greatest(b.src, b.dst)) AS r FROM half a LEFT JOIN half b ON a.src = b.src AND a.dst <> b.dst),
s AS (SELECT src, dst, any_value(len_o) AS len_o, coalesce(max(CASE WHEN r = 2 THEN other END), 0) AS second_len FROM o GROUP BY src, dst)
SELECT src, dst, second_len, CASE WHEN second_len <= 0 THEN 0 ELSE 1 / (1 + exp(-least(greatest((ln(greatest(second_len / greatest(len_o, 1e-12), 1e-12)) - ln(3)) / 0.4054651081, -60), 60))) END AS open_space FROM s""", ("second_len", "open_space")),
    "log_length_histogram": (
        lambda b: ed.log_length_histogram(b.edges, 32),
        """, l AS (SELECT ln(len_o) AS l FROM edges WHERE len_o > 0), bx AS (SELECT min(l) AS lo, max(l) AS hi FROM l),
g AS (SELECT CAST(least(floor((l - lo) / (hi - lo) * 32), 31) AS INTEGER) AS bin, count(*) AS n FROM l, bx GROUP BY 1)
SELECT CAST(r AS INTEGER) AS bin, coalesce(n, 0) AS n FROM range(32) t(r) LEFT JOIN g ON g.bin = r""", ()),
    "seed_edges": (lambda b: b.seeds.select("u", "v", "is_seed"), SEED_SQL + " SELECT u, v, is_seed FROM seeds", ()),
    "connected_components": (lambda b: b.labels, SEED_SQL + " SELECT * FROM labels", ()),
    "component_counts": (lambda b: gr.component_counts(b.labels, b.seed), SEED_SQL + " SELECT comp, n_points, n_edges FROM cnt", ()),
    "seed_components_large": (lambda b: b.large.select("comp", "n_points", "n_edges"), SEED_SQL + " SELECT comp, n_points, n_edges FROM large", ()),
    "component_edge_stats": (lambda b: gr.internal_stats(b.seed, b.labels), SEED_SQL + " SELECT * FROM stats", ("q25_o", "med_o", "q75_o", "med_p", "q75_p")),
    "component_incident_stats": (lambda b: gr.incident_stats(b.edges, b.labels), SEED_SQL + " SELECT * FROM istats", ("q25_o", "med_o", "q75_o", "med_p", "q75_p")),
    "component_selectivity": (
        lambda b: b.labels.join(b.select, "pid").groupBy("comp").agg(F.avg("selectivity").alias("selectivity")),
        SEED_SQL + " SELECT comp, avg(selectivity) AS selectivity FROM labels JOIN sel USING (pid) GROUP BY comp", ("selectivity",)),
    "component_topology": (
        lambda b: tp.component_topology(b.labels, b.seed, 2),
        SEED_SQL + " SELECT comp, n_edges, n_points, n_edges / n_points AS edges_per_point, 2 * n_edges / n_points AS mean_degree, n_edges - n_points + 1 AS cycle_rank, (n_edges - n_points + 1) / n_points AS cycles_per_point FROM cnt WHERE n_edges >= 2",
        ("edges_per_point", "mean_degree", "cycles_per_point")),
    "component_neighbour_counts": (
        lambda b: tp.short_neighbours(b.labels, b.seed),
        SEED_SQL + """, rad AS (SELECT comp, median(near) AS radius FROM nearest GROUP BY comp),
c AS (SELECT h.comp, h.src, sum(CAST(h.len_o <= radius AS INTEGER)) AS common, sum(CAST(h.len_o <= 1.5 * greatest(a.near, b.near) AS INTEGER)) AS relative FROM inner_half h JOIN nearest a ON a.src = h.src JOIN nearest b ON b.src = h.dst JOIN rad ON rad.comp = h.comp GROUP BY ALL)
SELECT comp, quantile_cont(common, 0.25) AS common_q25, median(common) AS common_median, quantile_cont(common, 0.75) AS common_q75, avg(common) AS common_mean,
quantile_cont(relative, 0.25) AS relative_q25, median(relative) AS relative_median, quantile_cont(relative, 0.75) AS relative_q75, avg(relative) AS relative_mean FROM c GROUP BY comp""",
        tuple(f"{a}_{s}" for a in ("common", "relative") for s in ("q25", "median", "q75", "mean"))),
    "component_m2": (
        lambda b: tp.angular_moment(b.labels, b.seed, b.flat),
        SEED_SQL + """, t AS (SELECT h.comp, h.src, cos(2 * atan2(q.py - p.py, q.px - p.px)) AS c, sin(2 * atan2(q.py - p.py, q.px - p.px)) AS s, CAST(h.len_o <= 1.5 * near AS DOUBLE) AS h, exp(-pow(h.len_o / greatest(2 * near, 1e-12), 2)) AS w
FROM inner_half h JOIN nearest n ON n.src = h.src JOIN flat p ON p.pid = h.src JOIN flat q ON q.pid = h.dst),
m AS (SELECT comp, src, sqrt(pow(sum(h * c), 2) + pow(sum(h * s), 2)) / greatest(sum(h), 1e-12) AS hard, sqrt(pow(sum(w * c), 2) + pow(sum(w * s), 2)) / greatest(sum(w), 1e-12) AS weighted FROM t GROUP BY ALL)
SELECT comp, quantile_cont(hard, 0.25) AS hard_q25, median(hard) AS hard_median, quantile_cont(hard, 0.75) AS hard_q75, avg(hard) AS hard_mean,
quantile_cont(weighted, 0.25) AS weighted_q25, median(weighted) AS weighted_median, quantile_cont(weighted, 0.75) AS weighted_q75, avg(weighted) AS weighted_mean FROM m GROUP BY comp""",
        tuple(f"{a}_{s}" for a in ("hard", "weighted") for s in ("q25", "median", "q75", "mean"))),
    "boundary_edges": (lambda b: gr.boundary(b.edges, b.labels, b.large).select("u", "v", "comp", "outer"), SEED_SQL + ' SELECT u, v, comp, outer_ AS "outer" FROM bnd', ()),
    "growth_round_scores": (lambda b: gr.growth_scores(b.edges, b.labels, b.large, b.seed).drop("outer_pid"), SEED_SQL + ' SELECT u, v, comp, outer_ AS "outer", ratio_o, ratio_p FROM scores', ("ratio_o", "ratio_p")),
    "growth_gate_classes": (
        lambda b: gr.gate_classes(gr.growth_scores(b.edges, b.labels, b.large, b.seed), 1.6, 2.8),
        SEED_SQL + """ SELECT CASE WHEN ratio_o < 1.6 AND ratio_p < 2.8 THEN 'accepted' WHEN ratio_p < 2.8 THEN 'blocked_original' WHEN ratio_o < 1.6 THEN 'blocked_projected' ELSE 'blocked_both' END AS gate, count(*) AS n FROM scores GROUP BY 1""", ()),
    "seed_restoration": (lambda b: b.restored_first, SEED_SQL + PRE_SQL + " SELECT u, v FROM pre", ()),
    "growth_round0": (
        lambda b: gr.accepted(gr.growth_scores(b.edges, b.labels, b.large, b.seed.select("u", "v").union(b.restored_first).join(b.edges.select("u", "v", "len_o", "len_p"), ["u", "v"])), *GROW),
        SEED_SQL + PRE_SQL + """, rst AS (SELECT cu AS comp, median(len_o) AS mo, quantile_cont(len_o, 0.75) AS qo, median(len_p) AS mp, quantile_cont(len_p, 0.75) AS qp FROM (SELECT cu, len_o, len_p FROM se UNION ALL SELECT cu, len_o, len_p FROM pre) GROUP BY cu)
SELECT DISTINCT u, v FROM bnd JOIN rst USING (comp) WHERE (len_o - mo) / greatest(qo - mo, 1e-12) < 12 AND (len_p - mp) / greatest(qp - mp, 1e-12) < 6""", ()),
    "restore_edges": (
        lambda b: gr.restored(b.edges, b.labels, b.seed, RESTORE),
        SEED_SQL + " SELECT le.u, le.v FROM le JOIN stats s ON s.comp = cu WHERE cu = cv AND len_o <= med_o + 5.0 * greatest(q75_o - q25_o, 1e-12) AND NOT EXISTS (SELECT 1 FROM seed WHERE seed.u = le.u AND seed.v = le.v)", ()),
    "boundary_scores": (
        lambda b: gr.boundary_scores(b.edges, b.pts, b.labels, b.large, ed.incident_q25(b.edges, b.pts), b.recall10).select("u", "v", "comp", "ratio", "outer_q25", "outer_recall"),
        SEED_SQL + """, kf AS (SELECT * FROM (SELECT a.pid, b.pid AS nid, row_number() OVER (PARTITION BY a.pid ORDER BY sqrt(pow(a.px - b.px, 2) + pow(a.py - b.py, 2)), b.pid) AS rank FROM flat a JOIN flat b ON a.pid <> b.pid) WHERE rank <= 10),
rec AS (SELECT p.pid, count(f.nid) / 10 AS recall FROM pts p LEFT JOIN knn k ON k.pid = p.pid AND k.rank <= 10 LEFT JOIN kf f ON f.pid = k.pid AND f.nid = k.nid GROUP BY p.pid),
pq AS (SELECT src AS pid, quantile_cont(len_o, 0.25) AS q25 FROM half GROUP BY src),
bs AS (SELECT b.*, (len_o - med_o) / greatest(q75_o - med_o, 1e-12) AS ratio, med_o, q75_o, q25, recall FROM bnd b JOIN istats i ON i.comp = b.comp JOIN pq ON pq.pid = outer_pid JOIN rec ON rec.pid = outer_pid)
SELECT u, v, arg_min(comp, ratio) AS comp, min(ratio) AS ratio, min((q25 - med_o) / greatest(q75_o - med_o, 1e-12)) AS outer_q25, min(recall) AS outer_recall FROM bs GROUP BY u, v""", ("ratio", "outer_q25", "outer_recall")),
    "final_prediction": (lambda b: b.pred, SEED_SQL + " SELECT pid, label FROM pred", ()),
    "labels_by_size": (
        lambda b: po.labels_by_size(b.labels, 4),
        SEED_SQL + ", big AS (SELECT comp, row_number() OVER (ORDER BY comp) - 1 AS label FROM cnt WHERE n_points >= 4) SELECT pid, coalesce(label, -1) AS label FROM labels LEFT JOIN big USING (comp)", ()),
    "dominant_cluster": (
        lambda b: gr.dominant_cluster(b.edges, b.pred),
        SEED_SQL + """, vt AS (SELECT src, b.label, count(*) AS n FROM half JOIN plabel a ON a.pid = src AND a.label = -1 JOIN plabel b ON b.pid = dst AND b.label >= 0 GROUP BY ALL),
rk AS (SELECT *, sum(n) OVER (PARTITION BY src) AS total, row_number() OVER (PARTITION BY src ORDER BY n DESC, label) AS r FROM vt) SELECT src AS pid, label, n FROM rk WHERE r = 1 AND n * 2 > total""", ()),
    "outlier_merge": (
        lambda b: gr.outlier_merge(b.edges, b.seed, b.pts, b.pred, 1.0),
        SEED_SQL + """, vt AS (SELECT src, b.label, count(*) AS n FROM half JOIN plabel a ON a.pid = src AND a.label = -1 JOIN plabel b ON b.pid = dst AND b.label >= 0 GROUP BY ALL),
rk AS (SELECT *, sum(n) OVER (PARTITION BY src) AS total, row_number() OVER (PARTITION BY src ORDER BY n DESC, label) AS r FROM vt), dm AS (SELECT src AS pid, label FROM rk WHERE r = 1 AND n * 2 > total),
rc AS (SELECT cu AS label, median(pe.len_o) + 1.0 * greatest(quantile_cont(pe.len_o, 0.75) - quantile_cont(pe.len_o, 0.25), 1e-12) AS reach FROM pe JOIN seed USING (u, v) WHERE cu = cv AND cu >= 0 GROUP BY cu),
nr AS (SELECT d.pid, d.label, any_value(reach) AS reach, min(list_distance(p.x, q.x)) AS near FROM dm d JOIN rc USING (label) JOIN pts p ON p.pid = d.pid JOIN plabel m ON m.label = d.label JOIN pts q ON q.pid = m.pid GROUP BY d.pid, d.label)
SELECT p.pid, CASE WHEN n.near <= n.reach THEN n.label ELSE p.label END AS label FROM plabel p LEFT JOIN nr n USING (pid)""", ()),
    "frozen_growth_round": (
        lambda b: gr.frozen_growth_round(b.edges, b.pred, 3.0, 3.0),
        SEED_SQL + """, ps AS (SELECT comp, median(len_o) AS mo, quantile_cont(len_o, 0.75) AS qo, median(len_p) AS mp, quantile_cont(len_p, 0.75) AS qp FROM (SELECT len_o, len_p, cu AS comp FROM pe UNION ALL SELECT len_o, len_p, cv FROM pe WHERE cu <> cv) WHERE comp >= 0 GROUP BY comp),
pr AS (SELECT u, v, len_o, len_p, cu AS comp, v AS pid FROM pe WHERE cu >= 0 AND cv = -1 UNION ALL SELECT u, v, len_o, len_p, cv, u FROM pe WHERE cv >= 0 AND cu = -1),
sc AS (SELECT pid, u, v, pr.comp, (len_o - mo) / greatest(qo - mo, 1e-12) AS ratio_o, (len_p - mp) / greatest(qp - mp, 1e-12) AS ratio_p FROM pr JOIN ps ON ps.comp = pr.comp)
SELECT pid, comp AS label, ratio_o, ratio_p FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY greatest(ratio_o / 3, ratio_p / 3), ratio_o, ratio_p, u, v, comp) AS r FROM sc WHERE ratio_o < 3 AND ratio_p < 3) WHERE r = 1""", ("ratio_o", "ratio_p")),
    "contingency": (lambda b: ev.contingency(b.truth), SEED_SQL + " SELECT y, label, n FROM tab", ()),
    "ari": (
        lambda b: ev.adjusted_rand(b.truth),
        SEED_SQL + """, z AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM tab) AS c, (SELECT sum(ny * (ny - 1) / 2) FROM ma) AS a, (SELECT sum(nl * (nl - 1) / 2) FROM mb) AS b, (SELECT m * (m - 1) / 2 FROM mt) AS t)
SELECT CASE WHEN (a + b) / 2 = a * b / t THEN 1.0 ELSE (c - a * b / t) / ((a + b) / 2 - a * b / t) END AS ari FROM z""", ("ari",)),
    "information_scores": (
        lambda b: ev.information_scores(b.truth),
        SEED_SQL + """, e AS (SELECT (SELECT sum(n / m * ln(n * m / (ny * nl))) FROM tab JOIN ma USING (y) JOIN mb USING (label), mt) AS mi, (SELECT -sum(ny / m * ln(ny / m)) FROM ma, mt) AS hy, (SELECT -sum(nl / m * ln(nl / m)) FROM mb, mt) AS hl)
SELECT mi / ((hy + hl) / 2) AS nmi, mi / hy AS homogeneity, mi / hl AS completeness, 2 * (mi / hy) * (mi / hl) / (mi / hy + mi / hl) AS v_measure FROM e""", ("nmi", "homogeneity", "completeness", "v_measure")),
    "outlier_metrics": (
        lambda b: ev.outlier_scores(b.truth),
        SEED_SQL + """, o AS (SELECT count(*) FILTER (y > 0 AND label < 0) AS tp, count(*) FILTER (y <= 0 AND label < 0) AS fp, count(*) FILTER (y > 0 AND label >= 0) AS fn, count(*) FILTER (y <= 0 AND label >= 0) AS tn FROM pred)
SELECT tp, fp, fn, tn, coalesce(tp / nullif(tp + fp, 0), 0) AS "precision", coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM o""", ("precision", "recall", "f1")),
    "cluster_quality": (lambda b: ev.cluster_quality(b.truth), SEED_SQL + " SELECT count(DISTINCT label) FILTER (label >= 0) AS n_clusters, avg(CAST(label < 0 AS DOUBLE)) AS noise_share FROM pred", ("noise_share",)),
    "cluster_avg_edge": (
        lambda b: rc.cluster_lengths(b.edges, b.pred),
        SEED_SQL + """ SELECT DISTINCT p.label, greatest(coalesce(a, (SELECT median(len_o) FROM edges)), 1e-12) AS avg_len FROM plabel p LEFT JOIN (SELECT cu, avg(len_o) AS a FROM pe WHERE cu = cv GROUP BY cu) i ON i.cu = p.label WHERE p.label >= 0""", ("avg_len",)),
    "cluster_density_ref": (
        lambda b: rc.cluster_density(nb.core_distance(b.near, 15), b.pred),
        SEED_SQL + ", core AS (SELECT pid, avg(dist) AS core FROM knn WHERE rank <= 15 GROUP BY pid) SELECT label, greatest(median(core), 1e-12) AS ref_core FROM plabel JOIN core USING (pid) WHERE label >= 0 GROUP BY label", ("ref_core",)),
    "cost_gate_frontier": (
        lambda b: rc.cost_frontier(b.edges, b.pred, nb.core_distance(b.near, 15)),
        SEED_SQL + """, core AS (SELECT pid, avg(dist) AS core FROM knn WHERE rank <= 15 GROUP BY pid), rf AS (SELECT label, greatest(median(core), 1e-12) AS ref_core FROM plabel JOIN core USING (pid) WHERE label >= 0 GROUP BY label),
ca AS (SELECT DISTINCT p.label, greatest(coalesce(a, (SELECT median(len_o) FROM edges)), 1e-12) AS avg_len FROM plabel p LEFT JOIN (SELECT cu, avg(len_o) AS a FROM pe WHERE cu = cv GROUP BY cu) i ON i.cu = p.label WHERE p.label >= 0),
fs AS (SELECT u, v, v AS pid, cu AS label, len_o FROM pe WHERE cu >= 0 AND cv = -1 UNION ALL SELECT u, v, u, cv, len_o FROM pe WHERE cv >= 0 AND cu = -1),
fc AS (SELECT u, v, pid, fs.label, pow(len_o * pow(greatest(core, 1e-12) / ref_core, 0.5) / avg_len, 1.5) AS cost FROM fs JOIN core USING (pid) JOIN rf ON rf.label = fs.label JOIN ca ON ca.label = fs.label)
SELECT * FROM fc WHERE cost <= 15""", ("cost",)),
    "contracted_graph": (
        lambda b: pr.contracted(b.edges, b.labels),
        SEED_SQL + " SELECT least(cu, cv) AS cu, greatest(cu, cv) AS cv, count(*) AS capacity FROM le WHERE cu <> cv GROUP BY 1, 2", ()),
    "contracted_nodes": (lambda b: pr.node_weights(b.labels), SEED_SQL + " SELECT comp, count(*) AS weight FROM labels GROUP BY comp", ()),
    "short_path_bridges": (
        lambda b: pr.short_path_bridges(b.edges, 4),
        """, h1 AS (SELECT e.u, e.v, h.dst AS p FROM edges e JOIN half h ON h.src = e.u WHERE h.dst <> e.v),
h2 AS (SELECT DISTINCT h1.u, h1.v, h.dst AS p FROM h1 JOIN half h ON h.src = h1.p WHERE NOT (h1.p = h1.u AND h.dst = h1.v)),
h3 AS (SELECT DISTINCT h2.u, h2.v, h.dst AS p FROM h2 JOIN half h ON h.src = h2.p WHERE NOT (h2.p = h2.u AND h.dst = h2.v))
SELECT u, v FROM edges EXCEPT (SELECT u, v FROM h2 WHERE p = v UNION SELECT u, v FROM h3 WHERE p = v)""", ()),
    "mutual_reachability": (
        lambda b: de.mutual_reachability(b.near, 10),
        KNN_SQL + """, kth AS (SELECT pid, dist AS k FROM knn WHERE rank = 10), pw AS (SELECT least(pid, nid) AS u, greatest(pid, nid) AS v, min(dist) AS dist FROM knn GROUP BY 1, 2)
SELECT u, v, greatest(dist, a.k, b.k) AS weight FROM pw JOIN kth a ON a.pid = u JOIN kth b ON b.pid = v""", ("weight",)),
    "knn_repaint": (
        lambda b: br.repaint(b.pts, b.near),
        KNN_SQL + """, vt AS (SELECT k.pid, y AS ny, count(*) AS n FROM knn k JOIN pts ON pts.pid = nid WHERE rank <= 10 AND y IS NOT NULL GROUP BY ALL)
SELECT p.pid, p.y, coalesce(ny, p.y) AS painted FROM pts p LEFT JOIN vt ON vt.pid = p.pid AND n * 2 > 10""", ()),
    "radial_outliers": (
        lambda b: br.radial_outliers(b.pts),
        """, ex AS (SELECT pid, y, unnest(range(0, len(x))) AS pos, unnest(x) AS v FROM pts WHERE y IS NOT NULL), ce AS (SELECT y, pos, avg(v) AS m FROM ex GROUP BY ALL),
ra AS (SELECT pid, ex.y, sqrt(sum(pow(v - m, 2))) AS radius FROM ex JOIN ce ON ce.y = ex.y AND ce.pos = ex.pos GROUP BY pid, ex.y), sc AS (SELECT y, avg(radius) + 2 * stddev_pop(radius) AS lim FROM ra GROUP BY y)
SELECT pid, ra.y, radius, radius > lim AS outlier FROM ra JOIN sc ON sc.y = ra.y""", ("radius",)),
    "edge_keep_prune": (
        lambda b: br.keep_or_prune(b.edges, b.pts), " SELECT u, v, CASE WHEN a.y = b.y THEN 'KEEP' ELSE 'PRUNE' END AS action FROM edges JOIN pts a ON a.pid = u JOIN pts b ON b.pid = v", ()),
    "balanced_sample": (
        lambda b: br.balanced_sample(br.keep_or_prune(b.edges, b.pts), 100),
        """, kp AS (SELECT u, v, CASE WHEN a.y = b.y THEN 'KEEP' ELSE 'PRUNE' END AS action FROM edges JOIN pts a ON a.pid = u JOIN pts b ON b.pid = v)
SELECT u, v, action FROM (SELECT *, row_number() OVER (PARTITION BY action ORDER BY md5('sample:' || u || ':' || v), u, v) AS r FROM kp) WHERE r <= 100""", ()),
    "edge_strata": (
        lambda b: br.strata(b.edges, b.pts),
        """, mid AS (SELECT src, median(len_o) AS m, count(DISTINCT y) AS k FROM half JOIN pts ON pts.pid = dst GROUP BY src)
SELECT u, v, CASE WHEN len_o > 1.5 * greatest(a.m, b.m) THEN 'bridge' WHEN abs(len_o - least(a.m, b.m)) <= 0.25 * least(a.m, b.m) THEN 'median' WHEN a.k > 1 OR b.k > 1 THEN 'overlap' ELSE 'other' END AS stratum
FROM edges JOIN mid a ON a.src = u JOIN mid b ON b.src = v""", ()),
    "stratified_sample": (
        lambda b: br.stratified_sample(br.keep_or_prune(b.edges, b.pts).join(br.strata(b.edges, b.pts), ["u", "v"]), 90),
        """, mid AS (SELECT src, median(len_o) AS m, count(DISTINCT y) AS k FROM half JOIN pts ON pts.pid = dst GROUP BY src),
mk AS (SELECT u, v, CASE WHEN p.y = q.y THEN 'KEEP' ELSE 'PRUNE' END AS action, CASE WHEN len_o > 1.5 * greatest(a.m, b.m) THEN 'bridge' WHEN abs(len_o - least(a.m, b.m)) <= 0.25 * least(a.m, b.m) THEN 'median' WHEN a.k > 1 OR b.k > 1 THEN 'overlap' ELSE 'other' END AS stratum
FROM edges JOIN mid a ON a.src = u JOIN mid b ON b.src = v JOIN pts p ON p.pid = u JOIN pts q ON q.pid = v),
rk AS (SELECT *, row_number() OVER (PARTITION BY action, stratum ORDER BY md5('sample:' || u || ':' || v), u, v) AS r, CASE stratum WHEN 'bridge' THEN 1 WHEN 'median' THEN 2 WHEN 'overlap' THEN 3 ELSE 4 END AS p FROM mk),
ft AS (SELECT *, stratum <> 'other' AND r <= 30 AS own FROM rk),
tn AS (SELECT *, row_number() OVER (PARTITION BY action ORDER BY CASE WHEN own THEN 0 ELSE 1 END, CASE WHEN own THEN r ELSE 0 END, p, r) AS t FROM ft)
SELECT u, v, action, stratum FROM tn WHERE t <= 90""", ()),
    "kmeans_ari": (lambda b: ev.kmeans_ari(b.pts), None, ("ari",)),
    "bridge_features": (
        lambda b: br.bridge_features(b.edges, 64),
        """, nr AS (SELECT src AS p, least(src, dst) AS a, greatest(src, dst) AS b, dst AS q, len_o AS other FROM half),
e1 AS MATERIALIZED (SELECT DISTINCT e.u, e.v, e.len_o, a, b, other, q FROM edges e JOIN nr ON (p = e.u OR p = e.v) WHERE NOT (a = e.u AND b = e.v)),
o1 AS MATERIALIZED (SELECT DISTINCT u, v, len_o, a, b, other FROM e1),
o2 AS (SELECT DISTINCT u, v, e1.len_o, nr.a, nr.b, nr.other FROM (SELECT DISTINCT u, v, len_o, q FROM e1 WHERE q <> u AND q <> v) e1 JOIN nr ON nr.p = e1.q WHERE NOT (nr.a = u AND nr.b = v) AND NOT EXISTS (SELECT 1 FROM o1 WHERE o1.u = e1.u AND o1.v = e1.v AND o1.a = nr.a AND o1.b = nr.b)),
b1 AS (SELECT u, v, """ + ", ".join(f"count(*) FILTER (least(ceil(other / len_o * 4), 5) = {i}) AS h1_{i}" for i in range(1, 6)) + """ FROM o1 GROUP BY u, v),
b2 AS (SELECT u, v, """ + ", ".join(f"count(*) FILTER (least(ceil(other / len_o * 6), 7) = {i}) AS h2_{i}" for i in range(1, 8)) + """ FROM o2 GROUP BY u, v),
gs AS (SELECT median(len_o) AS g_median, quantile_cont(len_o, 0.75) - quantile_cont(len_o, 0.25) AS g_iqr, quantile_cont(len_o, 0.05) AS g_p05, quantile_cont(len_o, 0.95) AS g_p95, avg(len_o) AS g_mean, stddev_pop(len_o) AS g_std,
avg(pow(len_o - m, 3)) / pow(avg(pow(len_o - m, 2)), 1.5) AS g_skew, avg(pow(len_o - m, 4)) / pow(avg(pow(len_o - m, 2)), 2) - 3 AS g_kurtosis FROM edges, (SELECT avg(len_o) AS m FROM edges))
SELECT e.u, e.v, """ + ", ".join(f"coalesce({c}, 0) AS {c}" for c in [*(f"h1_{i}" for i in range(1, 6)), *(f"h2_{i}" for i in range(1, 8))]) + """, gs.*, len_o / greatest(g_median, 1e-12) AS length_ratio, ln(1 + 64.0) AS log_dim
FROM edges e LEFT JOIN b1 ON b1.u = e.u AND b1.v = e.v LEFT JOIN b2 ON b2.u = e.u AND b2.v = e.v, gs""", (*(f"g_{c}" for c in br.GLOBAL), "length_ratio", "log_dim")),
    "bridge_mlp": (lambda b: br.bridge_classifier(br.bridge_features(b.edges, 64), br.keep_or_prune(b.edges, b.pts)), None, ("probability",)),
    "cost_gate": (lambda b: rc.cost_gate(b.edges, b.pred, nb.core_distance(b.near, 15)), None, ("cost",)),
    "mst_weight": (lambda b: de.spanning_tree(b.pts, b.near, 10).agg(F.count("*").alias("n_edges"), F.sum("weight").alias("weight")), None, ("weight",)),
    "condensed_tree": (lambda b: mt.condensed(*mt.merge_tree(b.pts, b.spanning), 5)[0], None, ("birth", "stability")),
    "hdbscan_eom": (lambda b: mt.density_labels(b.pts, b.spanning, 5).select("pid", "label"), None, ()),
    "hdbscan_leaf": (lambda b: mt.density_labels(b.pts, b.spanning, 5, "leaf").select("pid", "label"), None, ()),
    "hdbscan_cut": (lambda b: de.density_cut(b.pts, de.spanning_tree(b.pts, b.near, 10), 1.3, 10), None, ()),
    "edge_redundancy": (lambda b: b.redundancy, None, ()),
    "bridges": (
        lambda b: b.redundancy.where("redundancy = 0").select("u", "v"),
        """, bs AS MATERIALIZED (SELECT e.u, e.v FROM edges e JOIN (SELECT src, count(*) AS n FROM half GROUP BY src) a ON a.src = e.u)
SELECT u, v FROM bs WHERE NOT EXISTS (WITH RECURSIVE r AS (SELECT bs.u AS p UNION SELECT h.dst FROM r JOIN half h ON h.src = r.p WHERE NOT (h.src = bs.u AND h.dst = bs.v)) SELECT 1 FROM r WHERE p = bs.v)""", ()),
    "redundancy_histogram": (lambda b: pr.redundancy_histogram(b.redundancy), None, ()),
    "redundancy_prune": (lambda b: pr.redundancy_prune(b.redundancy, 2, 1, 0.99), None, ()),
    "articulation_points": (lambda b: pr.articulation_points(b.edges), None, ()),
    "vertex_cut": (lambda b: pr.vertex_cut(b.edges, gr.components(b.pts, b.edges), min_points=2, fraction=0.0), None, ()),
    "gomory_hu_cuts": (lambda b: pr.balanced_bridges(b.seed, b.labels, 2, 0.2), None, ()),
    "ami": (
        lambda b: ev.adjusted_information(b.truth),
        SEED_SQL + """, z AS (SELECT a.ny AS a, b.nl AS b, m, unnest(range(CAST(greatest(1, a.ny + b.nl - m) AS BIGINT), CAST(least(a.ny, b.nl) AS BIGINT) + 1)) AS n FROM ma a, mb b, mt),
em AS (SELECT sum(n / m * ln(m * n / (a * b)) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(m - a + 1) + lgamma(m - b + 1) - lgamma(m + 1) - lgamma(n + 1) - lgamma(a - n + 1) - lgamma(b - n + 1) - lgamma(m - a - b + n + 1))) AS emi FROM z),
e AS (SELECT (SELECT sum(n / m * ln(n * m / (ny * nl))) FROM tab JOIN ma USING (y) JOIN mb USING (label), mt) AS mi, (SELECT -sum(ny / m * ln(ny / m)) FROM ma, mt) AS hy, (SELECT -sum(nl / m * ln(nl / m)) FROM mb, mt) AS hl)
SELECT (mi - emi) / ((hy + hl) / 2 - emi) AS ami FROM e, em""", ("ami",)),
    "largest_components": (lambda b: tp.largest(gr.component_counts(b.labels, b.seed)), SEED_SQL + " SELECT comp, n_points, n_edges FROM cnt ORDER BY n_edges DESC, n_points DESC, comp LIMIT 5", ()),
    "gate_m2": (
        lambda b: tp.angular_moment(b.labels, b.seed, b.flat).where(F.col("weighted_median") < 0.9).select("comp"),
        SEED_SQL + """, t AS (SELECT h.comp, h.src, cos(2 * atan2(q.py - p.py, q.px - p.px)) AS c, sin(2 * atan2(q.py - p.py, q.px - p.px)) AS s, exp(-pow(h.len_o / greatest(2 * near, 1e-12), 2)) AS w
FROM inner_half h JOIN nearest n ON n.src = h.src JOIN flat p ON p.pid = h.src JOIN flat q ON q.pid = h.dst), m AS (SELECT comp, src, sqrt(pow(sum(w * c), 2) + pow(sum(w * s), 2)) / greatest(sum(w), 1e-12) AS weighted FROM t GROUP BY ALL)
SELECT comp FROM m GROUP BY comp HAVING median(weighted) < 0.9""", ()),
    "bridge_base_edges": (
        lambda b: b.seed.select("u", "v").union(gr.accepted(gr.growth_scores(b.edges, b.labels, b.large, b.seed), 1.6, 2.8)).union(gr.restored(b.edges, b.labels, b.seed, 2.0)).distinct(),
        SEED_SQL + """ SELECT u, v FROM seed UNION SELECT u, v FROM scores WHERE ratio_o < 1.6 AND ratio_p < 2.8 UNION
SELECT le.u, le.v FROM le JOIN stats s ON s.comp = cu WHERE cu = cv AND len_o <= med_o + 2.0 * greatest(q75_o - q25_o, 1e-12)""", ()),
    "no_growth": (
        lambda b: b.seeds.select("u", "v", F.col("is_seed").alias("retained"), F.lit(False).alias("accepted"), F.lit(False).alias("restored")),
        SEED_SQL + " SELECT u, v, is_seed AS retained, false AS accepted, false AS restored FROM seeds", ()),
    "first_mode_seed": (lambda b: mo.first_mode_seed(b.seeds).select("u", "v", "is_seed"), None, ()),
    "outer_hull": (lambda b: tp.outer_hull(b.triangles, b.all_edges, b.edges), None, ()),
    "hull_ratio": (lambda b: tp.hull_ratio(b.edges, tp.outer_hull(b.triangles, b.all_edges, b.edges), gr.components(b.pts, b.edges)), None, ("hull_ratio",)),
    "gate_triangle_ratio": (lambda b: tp.triangle_edge_ratio(b.triangles, b.all_edges, b.labels), None, ("ratio",)),
    "gate_shape": (
        lambda b: tp.component_shape(b.triangles, tp.triangle_areas(b.triangles, b.pts, b.flat), tp.triangle_support(b.triangles, b.all_edges, b.all_edges, b.labels), b.all_edges).where("shape_o >= 12").select("comp"), None, ()),
    "eligible_points": (
        lambda b: tp.eligible(b.labels, tp.angular_moment(b.labels, b.all_edges, b.flat), tp.component_shape(b.triangles, tp.triangle_areas(b.triangles, b.pts, b.flat), tp.triangle_support(b.triangles, b.all_edges, b.all_edges, b.labels), b.all_edges), tp.triangle_edge_ratio(b.triangles, b.all_edges, b.labels), 1.0, 5.0, 0.1), None, ()),
    "cluster_labels": (cluster_labels, None, ("cost",)),
    "wave_growth": (lambda b: b.waves, None, ()),
    "wave_growth_first": (
        lambda b: b.waves.where("wave = 1").select("u", "v", "how"),
        SEED_SQL + """, mut AS (SELECT u, v, len_o FROM seeds WHERE allowed AND uv AND vu), bh AS (SELECT u, v FROM mut UNION SELECT v, u FROM mut),
br AS (SELECT pid AS id, pid AS r FROM pts UNION SELECT br.id, bh.v FROM br JOIN bh ON bh.u = br.r), bl AS MATERIALIZED (SELECT id AS pid, min(r) AS comp FROM br GROUP BY id),
loose AS (SELECT median(len_o) + 1.5 * greatest(quantile_cont(len_o, 0.75) - quantile_cont(len_o, 0.25), 1e-12) AS l_o, median(len_p) + 1.5 * greatest(quantile_cont(len_p, 0.75) - quantile_cont(len_p, 0.25), 1e-12) AS l_p FROM edges),
wo AS (SELECT a.src, a.dst, a.len_o, b.len_o AS other, row_number() OVER (PARTITION BY a.src, a.dst ORDER BY b.len_o DESC, least(b.src, b.dst), greatest(b.src, b.dst)) AS r FROM half a LEFT JOIN half b ON a.src = b.src AND a.dst <> b.dst),
ws AS (SELECT src, dst, any_value(len_o) AS len_o, coalesce(max(CASE WHEN r = 2 THEN other END), 0) AS second_len FROM wo GROUP BY src, dst),
os AS MATERIALIZED (SELECT src, dst, CASE WHEN second_len <= 0 THEN 0 ELSE 1 / (1 + exp(-least(greatest((ln(greatest(second_len / greatest(len_o, 1e-12), 1e-12)) - ln(3)) / 0.4054651081, -60), 60))) END AS score FROM ws),
we AS MATERIALIZED (SELECT s.u, s.v, s.len_o, s.allowed, uv OR vu AS near, allowed AND uv AND vu AS seed, a.comp AS cu, b.comp AS cv, ou.score AS open_u, ov.score AS open_v,
  allowed OR ((uv OR vu) AND len_o <= l_o AND len_p <= l_p AND greatest(CASE WHEN uv THEN su.selectivity ELSE 0 END, CASE WHEN vu THEN sv.selectivity ELSE 0 END) > 0.1) AS relaxed
  FROM seeds s JOIN bl a ON a.pid = s.u JOIN bl b ON b.pid = s.v JOIN sel su ON su.pid = s.u JOIN sel sv ON sv.pid = s.v JOIN os ou ON ou.src = s.u AND ou.dst = s.v JOIN os ov ON ov.src = s.v AND ov.dst = s.u, loose),
wc AS MATERIALIZED (SELECT cu AS comp, count(*) AS n_edges, median(len_o) AS med, greatest(quantile_cont(len_o, 0.75) - quantile_cont(len_o, 0.25), 1e-12) AS iqr FROM we WHERE seed GROUP BY cu),
wr AS MATERIALIZED (SELECT wc.*, row_number() OVER (ORDER BY n_edges DESC, n DESC, comp) AS place FROM wc JOIN (SELECT comp, count(*) AS n FROM bl GROUP BY comp) USING (comp)),
tc AS (SELECT cu, cv FROM we WHERE cu <> cv AND (seed OR allowed OR relaxed AND near) UNION SELECT cv, cu FROM we WHERE cu <> cv AND (seed OR allowed OR relaxed AND near)),
ld AS (SELECT * FROM wr w WHERE NOT EXISTS (SELECT 1 FROM tc JOIN wr o ON o.comp = tc.cv WHERE tc.cu = w.comp AND o.place < w.place)),
jd AS (SELECT u, v, CASE WHEN allowed AND len_o <= med - 0.5 * iqr THEN 'automatic'
  WHEN allowed AND len_o > med - 0.5 * iqr AND NOT near AND len_o <= med - 0.5 * iqr + 0.25 * iqr * CASE WHEN cu = cv THEN greatest(open_u, open_v) WHEN cu = comp THEN open_v ELSE open_u END THEN 'open_space'
  WHEN relaxed AND near AND len_o > med - 0.5 * iqr THEN 'near' END AS how FROM we JOIN ld ON comp IN (cu, cv) WHERE NOT seed)
SELECT u, v, min(how) AS how FROM jd WHERE how IS NOT NULL GROUP BY u, v""", ()),
    "wave_labels": (wave_labels, None, ()),
    "run_summary": (run_summary, None, ()),
    "two_hop_selectivity": (
        lambda b: nb.two_hop_selectivity(b.related, b.select),
        KNN_SQL + """, en AS (SELECT u, v, u AS p FROM edges UNION SELECT u, v, v FROM edges), n1 AS (SELECT * FROM en UNION SELECT en.u, en.v, h.dst FROM en JOIN half h ON h.src = p),
n2 AS (SELECT * FROM n1 UNION SELECT n1.u, n1.v, h.dst FROM n1 JOIN half h ON h.src = p), sm AS (SELECT u, v, sum(degree) AS d, sum(passed) AS n FROM n2 JOIN sel ON sel.pid = p GROUP BY u, v)
SELECT r.u, r.v, CASE WHEN d > 2 THEN 1 - (n - CAST(uv AS INTEGER) - CAST(vu AS INTEGER)) / (d - 2) ELSE 0 END AS context FROM related r JOIN sm ON sm.u = r.u AND sm.v = r.v""", ("context",)),
    "umap_layout": (lambda b: b.spread, None, ("px", "py")),
    "umap_overlap": (lambda b: nb.recall(b.near, nb.knn(b.spread.select("pid", F.array("px", "py").alias("x")), 10), 10), None, ("recall",)),
    "umap_graph": (lambda b: nb.fuzzy_graph(b.near), None, ("weight",)),
    "delaunay_2d": (lambda b: b.triangles, None, ()),
    "edges_from_triangles": (lambda b: dl.edges_from_triangles(b.triangles), None, ()),
    "simplex_size": (lambda b: tp.simplex_sizes(b.triangles, b.all_edges), None, ("size_o", "size_p")),
    "triangle_area": (lambda b: tp.triangle_areas(b.triangles, b.pts, b.flat), None, ("area_o", "area_p")),
    "triangle_support": (lambda b: tp.triangle_support(b.triangles, b.seed, b.all_edges, b.labels), None, ()),
    "boundary_layer": (lambda b: tp.boundary_layer(tp.triangle_support(b.triangles, b.all_edges, b.all_edges, b.labels), 1), None, ()),
    "component_shape": (
        lambda b: tp.component_shape(b.triangles, tp.triangle_areas(b.triangles, b.pts, b.flat), tp.triangle_support(b.triangles, b.all_edges, b.all_edges, b.labels), b.all_edges), None,
        ("area_o", "area_p", "rim_o", "rim_p", "shape_o", "shape_p")),
    "project_pca": (lambda b: po.principal_plane(b.pts), None, ("px", "py")),
    "sequential_growth": (lambda b: b.growth, None, ()),
    "growth_added_points": (lambda b: b.added, None, ()),
    "retained_edges": (lambda b: b.growth.where("seed or accepted or restored").select("u", "v"), None, ()),
    "interior_restoration": (lambda b: b.interior, None, ()),
    "removable_boundary_edges": (
        lambda b: (lambda w: gr.removable_edges(w.growth, w.interior, w.added, tp.boundary_layer(tp.triangle_support(w.triangles, w.kept_inside, w.all_edges, gr.components(w.pts, w.kept_inside)), 1)))(b.on_all_edges()), None, ()),
    "growth_history": (
        lambda b: gr.growth_history(b.edges, b.pts, b.seed, MIN_EDGES, *GROW, RESTORE, "real", ed.incident_q25(b.edges, b.pts), b.recall10), None,
        ("ratio_o", "ratio_p", "ratio_q", "outer_recall", "shown_o", "shown_q")),
    "removable_edges": (lambda b: gr.removable_edges(b.growth, b.interior, b.added), None, ()),
    "frozen_growth": (lambda b: gr.frozen_growth(b.edges, b.pred, 3.0, 3.0), None, ()),
    "triangle_gate": (lambda b: tp.triangle_gate(b.all_edges, b.labels, tp.triangle_edge_ratio(b.triangles, b.all_edges, b.labels), 0.1), None, ()),
    "hull_skip": (lambda b: tp.hull_skip(tp.hull_ratio(b.edges, tp.outer_hull(b.triangles, b.all_edges, b.edges), gr.components(b.pts, b.edges)), 0.5), None, ("hull_ratio",)),
    "all_edges_hard_gate": (lambda b: b.on_all_edges().seeds.select("u", "v", "allowed", "is_seed"), None, ()),
    "all_edges_growth": (lambda b: b.on_all_edges().growth, None, ()),
    "all_edges_restored": (lambda b: (lambda w: gr.restored(w.edges, w.labels, w.seed, 2.0))(b.on_all_edges()), None, ()),
    "all_edges_grown_labels": (lambda b: grown_labels(b.on_all_edges(), outliers=1.0), None, ()),
    "pca_grown_labels": (lambda b: grown_labels(b.on_all_edges("pca"), outliers=1.0), None, ()),
}


def rounded(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Doubles to six digits, so that the order of a sum doesn't show; no negative zero."""
    return df.select(*((F.round(c, 6) + F.lit(0.0)).alias(c) if c in columns else F.col(c) for c in df.columns))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: lambda spark, sf_dir, f=f, c=columns: rounded(f(Clustering(spark, sf_dir)), c) for name, (f, _, columns) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, (_, sql, columns) in QUERIES.items():
        if sql is not None:
            replaced = ", ".join(f'round("{c}", 6) + 0.0 AS "{c}"' for c in columns)
            out[name] = BASE_SQL + sql if not columns else f"SELECT * REPLACE ({replaced}) FROM ({(BASE_SQL + sql).strip()})"
    return out
