"""Exact quantiles by rounds, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.operators import growth as gr
from geoloom.operators.ranking import exact_quantiles


@pytest.mark.parametrize("small", [1_000_000, 40])
def test_exact_quantiles(spark, small):
    rng = np.random.default_rng(1)
    data = {None: rng.lognormal(0, 4, 700), 1: np.repeat([1.0, 1.0 + 1e-15, 7.0], 200), 2: rng.normal(size=9), 3: np.array([5.0])}
    rows = [(g, float(x)) for g, v in data.items() for x in v] + [(2, None), (9, None)]
    table = spark.createDataFrame(rows, "g long, x double").repartition(3)
    p = (0.0, 0.25, 0.5, 0.9, 1.0)
    got = {r.g: r.q for r in exact_quantiles(table, "x", p, ("g",), small).collect()}
    assert set(got) == set(data) and all(np.allclose(got[g], np.quantile(data[g], p), rtol=1e-15, atol=0) for g in data)
    whole = exact_quantiles(table, "x", p, (), small).collect()
    assert len(whole) == 1 and np.allclose(whole[0].q, np.quantile(np.concatenate(list(data.values())), p), rtol=1e-15, atol=0)


def test_component_statistics_by_rounds(spark):
    rng = np.random.default_rng(2)
    rows = [(i % 2, float(a), float(b)) for i, (a, b) in enumerate(rng.random((300, 2)))]
    table = spark.createDataFrame(rows, "comp long, len_o double, len_p double")
    one, many = (sorted(map(tuple, gr._stats(table, small).collect())) for small in (1000, 20))
    assert np.allclose(one, many, rtol=1e-14) and len(one) == 2
    assert exact_quantiles(table.where(F.lit(False)), "len_o", (0.5,)).first().q is None
