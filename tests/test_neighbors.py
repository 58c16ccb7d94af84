import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.operators import density, mergetree as mt, neighbors as nb

POINTS = "pid long, x array<double>, y long"


def _table(spark, x):
    return spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], POINTS)


def _nearest(x, k):
    gap = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(gap, np.inf)
    return [np.lexsort((np.arange(len(x)), g))[:k] for g in gap], gap


def _cases():
    rng = np.random.default_rng(3)
    lattice = rng.integers(0, 4, (300, 3)).astype(float)  # many ties
    return {
        "lattice": lattice, "equal": np.ones((150, 2)), "far": lattice * 1e-3 + 1e6, "huge": rng.normal(size=(200, 2)) * 1e20,
        "tiny": rng.normal(size=(200, 2)) * 1e-25, "scales": np.exp(rng.normal(0, 8, (250, 2))), "noise": rng.normal(size=(300, 40)),
    }


@pytest.mark.parametrize("name", _cases())
def test_knn_of_odd_spaces(spark, name):
    x = _cases()[name]
    want, gap = _nearest(x, 7)
    got = {}
    for r in nb.knn(_table(spark, x), 7, block=32).collect():
        got.setdefault(r.pid, {})[r["rank"]] = (r.nid, r.dist)
    assert all([got[i][j + 1][0] for j in range(7)] == w.tolist() for i, w in enumerate(want))
    assert all(got[i][j + 1][1] == pytest.approx(gap[i, w[j]], rel=1e-12) for i, w in enumerate(want) for j in range(7))


def test_rows_of_a_neighbour_search_stay_small(spark, monkeypatch):
    """Neither a row nor what comes out grows with the blocks: points are sent as rows, k rows a point come out."""
    sizes, sent = [], nb.materialise
    monkeypatch.setattr(nb, "materialise", lambda df, name="table": sizes.append((name, (out := sent(df, name)))) or out)
    x = np.random.default_rng(4).normal(size=(2000, 16))
    found = nb.knn(_table(spark, x), 5, block=100)
    assert found.count() == 10_000
    for name, table in sizes:
        width = F.lit(0)
        for c, kind in table.dtypes:
            width = width + (F.length(c) if kind == "binary" else F.size(c) * 8 if kind.startswith("array") else F.lit(8))
        assert (table.agg(F.max(width)).first()[0] or 0) <= 16 * 8 + 2 * 5 * 8 + 5 * 8, name


@pytest.mark.parametrize("name", ["blobs", "lattice", "noise"])
def test_spanning_tree_in_blocks(spark, name):
    """Against Prim's algorithm over all pairs, with few neighbours known, so that components are searched among all points."""
    rng = np.random.default_rng(9)
    x = {"blobs": np.concatenate([rng.normal(c, 0.3, (60, 2)) for c in ((0, 0), (5, 1), (2, 7), (9, 9))]), "lattice": rng.integers(0, 5, (150, 3)) * 1.0, "noise": rng.normal(size=(200, 20))}[name]
    _, gap = _nearest(x, 3)
    core = np.sort(gap, 1)[:, 2]
    reach = np.maximum(np.maximum(gap, core[:, None]), core[None])
    left, best, total = set(range(1, len(x))), reach[0].copy(), []
    while left:
        at = min(left, key=lambda i: best[i])
        total.append(best[at])
        left.remove(at)
        best = np.minimum(best, reach[at])
    pts = _table(spark, x)
    got = density.spanning_tree(pts, nb.knn(pts, 3, block=20), 3, block=20).collect()
    assert len(got) == len(x) - 1 and sorted(r.weight for r in got) == pytest.approx(sorted(total), rel=1e-12)
    assert all(r.u < r.v and r.weight == pytest.approx(reach[r.u, r.v], rel=1e-12) for r in got)


def test_choices_in_a_task_as_in_rounds(spark):
    """A chain of clusters that each shed a small one, and a bushy tree; the task takes no job for a level."""
    rng = np.random.default_rng(2)
    rows = [(i, i + 1 if i % 2 else i + 2 if i % 4 == 0 else i + 3, float(rng.integers(0, 9))) for i in range(1, 60)]
    rows += [(100 + i, 200 if i > 50 else 100 + i + 1 + int(rng.integers(0, 9)), float(rng.integers(0, 9))) for i in range(60)]
    up = {c: p for c, p, _ in rows}
    rows += [(p, None, 0.0) for p in set(up.values()) - set(up)]
    table = spark.createDataFrame([(c, p, 0.0, 5, s) for c, p, s in rows], "cluster long, parent long, birth double, size long, stability double")
    sc = spark.sparkContext
    sc.setJobGroup("choices", "")
    got = mt.chosen(table)
    jobs = len(sc.statusTracker().getJobIdsForGroup("choices"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    choices = lambda df: {r.cluster: r.label for r in df.collect()}
    assert choices(got) == choices(mt.chosen(table, few=0)) and len(set(choices(got).values())) > 1
    assert jobs < 10 and not mt.chosen(table.limit(0)).count()
