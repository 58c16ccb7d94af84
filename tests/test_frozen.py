import numpy as np
import pytest

from geoloom.operators import growth as gr

EDGES = "u long, v long, len_o double, len_p double"


def _claims(frozen):
    return {r.pid: (r.label, r["round"]) for r in frozen.collect()}


def test_rounds_of_frozen_growth_take_no_jobs(spark):
    """Two clusters grow towards each other along a path, one point a round each."""
    n = 40
    edges = spark.createDataFrame([(i, i + 1, 1.0 + i % 3 / 10, 1.0) for i in range(n)], EDGES)
    labels = spark.createDataFrame([(i, 0 if i < 2 else 7 if i > n - 2 else -1) for i in range(n + 1)], "pid long, label long")
    sc = spark.sparkContext
    sc.setJobGroup("frozen", "")
    got = gr.frozen_growth(edges, labels, 9.0, 9.0)
    jobs = len(sc.statusTracker().getJobIdsForGroup("frozen"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    got = _claims(got)
    assert max(r for _, r in got.values()) == 19 and all(label >= 0 for label, _ in got.values())
    assert jobs < 19


@pytest.mark.parametrize("seed", [0, 1])
def test_frozen_growth_in_a_task_as_by_jobs(spark, seed):
    """Ties, edges that are met twice, nulls, and points that are neither noise nor in a cluster."""
    rng = np.random.default_rng(seed)
    pairs = sorted({tuple(sorted(x)) for x in rng.integers(0, 60, (110, 2)).tolist()})
    rows = [(u, v, *(None if rng.random() < 0.05 else float(x) for x in rng.integers(1, 6, 2))) for u, v in pairs]
    labels = [(i, 3 * int(i / 4) if i < 12 else None if i == 20 else -2 if i == 21 else -1) for i in range(60)]
    edges, table = spark.createDataFrame(rows, EDGES), spark.createDataFrame(labels, "pid long, label long")
    got = _claims(gr.frozen_growth(edges, table, 1.5, 1.5))
    assert got == _claims(gr.frozen_growth(edges, table, 1.5, 1.5, small=0))
    assert max(r for _, r in got.values()) > 1
    assert _claims(gr.frozen_growth(edges.limit(0), table, 1.5, 1.5)) == {p: (label, 0) for p, label in labels}
