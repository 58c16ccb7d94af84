"""The registered queries that SQL can express, against DuckDB."""

import duckdb
import pytest

from geoloom.plans import clustering

DIR = "/root/testdata/sf0.001"
NAMES = ["standardize", "gabriel_edges", "knn_selectivity", "hard_gate_knn_relaxed", "component_m2", "growth_round_scores", "boundary_scores", "outlier_merge", "frozen_growth_round", "information_scores", "bridge_features", "short_path_bridges", "seed_restoration", "growth_round0", "edge_strata", "stratified_sample"]


@pytest.fixture(scope="module")
def base(spark):
    return clustering.Clustering(spark, DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(base, name):
    make, _, columns = clustering.QUERIES[name]
    got = clustering.rounded(make(base), columns).toPandas()
    db = duckdb.connect()
    db.execute(f"create view embeddings as select * from read_parquet('{DIR}/embeddings.parquet')")
    want = db.execute(clustering.oracle_sql()[name]).df()
    order = sorted(want.columns)
    assert sorted(got.columns) == order
    rows = lambda t: sorted(map(tuple, t[order].round(6).astype(str).to_numpy()))
    assert rows(got) == rows(want)


def test_entry_contract():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
