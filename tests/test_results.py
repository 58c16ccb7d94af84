"""Results with markers, the layout, strata and samples."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.operators import bridges as br, evaluate as ev, layout as ly, neighbors as nb, points as po
from geoloom.sources import arrays, results


def test_a_killed_write_is_redone_and_a_finished_one_skipped(spark, tmp_path):
    folder = str(tmp_path / "out")
    names = spark.createDataFrame([("a",), ("b",)], "dataset string")
    pending = lambda: sorted(r.dataset for r in arrays.pending(names, results.finished(spark, folder)).collect())
    edges = spark.createDataFrame([(0, 1), (1, 2)], "u long, v long")
    broken = edges.select("u", F.raise_error(F.lit("killed")).cast("long").alias("v"))
    assert pending() == ["a", "b"]
    with pytest.raises(Exception, match="killed"):
        results.write_run(spark, folder, "a", {"edges": edges, "points": broken})
    assert pending() == ["a", "b"]  # its edges are there, but no marker
    results.write_run(spark, folder, "a", {"edges": edges, "points": edges.limit(0)}, '{"n": 2}')
    assert pending() == ["b"]
    results.write_run(spark, folder, "b", {"edges": edges.limit(1)})
    results.write_run(spark, folder, "b", {"edges": edges.where("u = 1")})
    assert pending() == []
    got = sorted((r.dataset, r.u, r.v) for r in results.read_results(spark, folder, "edges").collect())
    assert got == [("a", 0, 1), ("a", 1, 2), ("b", 1, 2)]
    a = results.finished(spark, folder).where("dataset = 'a'").first()
    assert a.rows == {"edges": 2, "points": 0} and a.summary == '{"n": 2}'


def test_layout_keeps_neighbours_and_repeats(spark):
    rng = np.random.default_rng(3)
    p = np.concatenate([rng.normal(size=(20, 8)) + 6 * rng.normal(size=8) for _ in range(3)])
    pts = spark.createDataFrame([(i, [float(c) for c in x], 0) for i, x in enumerate(p)], "pid long, x array<double>, y long")
    near = nb.knn(pts, 8)
    graph = nb.fuzzy_graph(near, 8)
    start = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(60, 2)))], "pid long, px double, py double")
    one, two = ({r.pid: (r.px, r.py) for r in ly.layout(graph, start.repartition(k), 6).collect()} for k in (1, 3))
    assert one == two and len(one) == 60

    def overlap(flat):
        table = spark.createDataFrame([(i, list(map(float, v))) for i, v in flat.items()], "pid long, x array<double>")
        return nb.recall(near, nb.knn(table, 8), 8).agg(F.avg("recall")).first()[0]

    assert overlap(one) > 1.5 * overlap({r.pid: (r.px, r.py) for r in start.collect()})
    assert ly.layout(graph, start.limit(0), 3).count() == 0 and ly.layout(graph.limit(0), start, 1).count() == 60
    assert [ly.epochs_for(n) for n in (9_999, 10_000, 22_000, 22_001)] == [500, 200, 200, 100] and ly.epochs_for(5, 7) == 7


def test_stratified_sample_makes_up_for_short_strata(spark):
    sizes = {("KEEP", "bridge"): 2, ("KEEP", "median"): 40, ("KEEP", "overlap"): 0, ("KEEP", "other"): 40, ("PRUNE", "bridge"): 30, ("PRUNE", "median"): 30, ("PRUNE", "overlap"): 30, ("PRUNE", "other"): 5}
    rows = [(k, k + 1, a, s) for k, (a, s) in enumerate((key for key, n in sizes.items() for _ in range(n)))]
    marked = spark.createDataFrame(rows, "u long, v long, action string, stratum string").repartition(5)
    got = br.stratified_sample(marked, 12).groupBy("action", "stratum").count().collect()
    assert {(r.action, r.stratum): r["count"] for r in got} == {("KEEP", "bridge"): 2, ("KEEP", "median"): 10, ("PRUNE", "bridge"): 4, ("PRUNE", "median"): 4, ("PRUNE", "overlap"): 4}
    assert br.stratified_sample(marked, 1000).count() == len(rows)
    again = sorted(map(tuple, br.stratified_sample(marked.repartition(2), 12).collect()))
    assert again == sorted(map(tuple, br.stratified_sample(marked, 12).collect()))
    assert br.stratified_sample(marked.limit(0), 3).count() == 0


def test_kmeans_of_clear_blobs(spark):
    rng = np.random.default_rng(1)
    p = np.r_[rng.normal(0, 0.1, (20, 2)), rng.normal(9, 0.1, (20, 2))]
    table = lambda y: spark.createDataFrame([(i, [float(c) for c in x], y(i)) for i, x in enumerate(p)], "pid long, x array<double>, y long")
    assert tuple(ev.kmeans_ari(table(lambda i: i // 20)).first()) == (2, 1.0)
    assert ev.kmeans_ari(table(lambda i: 4)).first().k == 1


def test_labels_by_size(spark):
    labels = spark.createDataFrame([(i, 7 if i < 3 else 9 if i < 8 else 20 + i) for i in range(10)], "pid long, comp long")
    assert {r.pid: r.label for r in po.labels_by_size(labels, 3).collect()} == {**dict.fromkeys(range(3), 0), **dict.fromkeys(range(3, 8), 1), 8: -1, 9: -1}
