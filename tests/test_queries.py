"""Named queries against their SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry_module
from compare import differences, open_tables

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

# One query per family; every other query shares the operators behind these.
CHECKED = [
    "station_days",
    "station_file_scan",
    "saved_counts",
    "hot_thresholds",
    "climate_fact",
    "pooled_percent_ranks",
    "seasonal_counts",
    "standardised_anomaly",
    "season_anomaly_table",
    "severity_events",
    "severity_anomaly_season_year",
    "severity_series_median",
    "count_trend_line",
    "severity_mann_kendall_mean",
    "severity_series_ci",
    "representative_events",
    "count_density",
    "severity_series_curve",
]


@pytest.fixture(scope="module")
def tables():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return open_tables(SF)


def test_every_query_has_sql():
    named = set(entry_module.queries()) - set(entry_module.TEXT_QUERIES)
    assert named == set(entry_module.oracle_sql()) - set(entry_module.TEXT_SQL)
    assert set(entry_module.TEXT_SQL) <= set(entry_module.TEXT_QUERIES)


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, tables, name):
    built = entry_module.queries()[name](spark, SF)
    assert differences(built, tables, entry_module.oracle_sql()[name]) == []


def test_entry(spark):
    if not os.path.isdir(entry_module.SMOKE_DIR):
        pytest.skip("no test tables")
    rows = entry_module.entry(spark).collect()
    assert len(rows) == 70
    assert sum(r.coincidences for r in rows) == 167
