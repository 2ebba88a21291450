"""Every query with SQL must give the rows of its SQL, on the smallest driver tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import canonical
from wattline.plans import load_catalogue

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = load_catalogue()
HOT = ["D2_fill_both_ways", "D5_resample_hourly", "F1_lags_per_series", "F2_rolling", "F3_percent_rank_per_series",
       "F9_rolling_origin_overlapping", "F10_expanding_folds", "C3_gaps_with_equal_times", "I4_cooldown_per_rule", "J5_roc_curve_corners",
       "L13_drift_baseline", "I1_top_frequencies"]


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return connection


def compare(spark, db, name):
    got, want = QUERIES[name](spark, FOLDER).toPandas(), db.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_match_sql(spark, db, name):
    compare(spark, db, name)


@pytest.mark.parametrize("name", HOT)
def test_rows_match_sql_when_keys_are_cut(spark, db, pieces, name):
    pieces(60)
    compare(spark, db, name)


@pytest.mark.parametrize("name", ["K1_isolation_forest", "K3_demand_regressor", "K6_health_scores", "K8_efficiency_clusters",
                                  "K14_reconstruction_detector", "K16_seasonal_forecast", "L5_recursive_elimination",
                                  "L6_component_loadings", "L12_retrain_run", "K5_holdout_scores"])
def test_queries_without_sql_give_rows(spark, name):
    assert name not in ORACLES
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() == 1
