"""Physical plans: shuffles, pushed filters, join choices."""

import re

from pyspark.sql import functions as F

import pytest

from emberfall.operators import bootstrap, coincidence, distribution, joint, rows, severity, thresholds
from emberfall.plans.catalog import REGISTRY
from emberfall.workspace import materialise
from test_rows import noisy


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def flagged(spark):
    obs = rows.number_rows(rows.land_observations(noisy(spark)))
    hot = materialise(thresholds.hot_thresholds(obs, (1999, 2001), 0.5))
    wet = materialise(thresholds.wet_thresholds(obs, (1999, 2001), 0.5))
    return coincidence.flag_days(obs, hot, wet)


def depth(line):
    """How deep an operator stands in a printed plan."""
    return len(re.match(r"[ :+|-]*", line).group())


def exchanges_over(text, scanned):
    """Exchanges that the rows of a scan of the columns ``scanned`` go through before they are
    combined: those that stand above it without an aggregate between."""
    lines, found = text.splitlines(), []
    for at, line in enumerate(lines):
        if "Scan" in line and all(f"{c}#" in line for c in scanned):
            deep, above = depth(line), []
            for upper in reversed(lines[:at]):
                if depth(upper) < deep:
                    deep = depth(upper)
                    above.append(upper)
            for upper in above:
                if "Aggregate" in upper:
                    break
                if "Exchange" in upper:
                    found.append(upper.strip())
    return found


def test_the_whole_table_moves_twice(spark):
    """From observations to flags, with broadcasts off: by (ID, year), by (ID, chunk), no more."""
    off = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(off)
    spark.conf.set(off, "-1")
    try:
        obs = materialise(noisy(spark))
        whole = ["TA", "RN"]
        keys = lambda found: [re.findall(r"hashpartitioning\((\w+)#\d+L?, (\w+)#", x) for x in found]
        landing = exchanges_over(plan(rows.place_in_years(obs)), whole)
        assert keys(landing) == [[("ID", "year")]]
        numbered = rows.number_rows(rows.land_observations(obs))
        chunking = exchanges_over(plan(rows.deal_chunks(numbered, 7)), whole)
        assert keys(chunking) == [[("ID", "chunk")]]
        chunks = rows.lay_chunks(numbered, 7)
        hot = thresholds.hot_thresholds(chunks, (1999, 2001), 0.5)
        assert exchanges_over(plan(hot), ["TA"]) == []
        hot, wet = materialise(hot), materialise(thresholds.wet_thresholds(rows.home_rows(chunks), (1999, 2001), 0.5))
        flags = coincidence.flag_days(chunks, hot, wet)
        assert exchanges_over(plan(flags), whole) == []
        assert "jdate" not in "".join(re.findall(r"hashpartitioning\(.*", plan(flags)))
        assert flags.count() == obs.count()
    finally:
        spark.conf.set(off, before)


def test_all_row_windows_share_one_sort(flagged):
    text = plan(flagged)
    assert exchanges_over(text, ["TA", "RN"]) == []
    assert len(re.findall(r"Sort \[ID#\d+ ASC NULLS FIRST, chunk#\d+L? ASC NULLS FIRST, row_no", text)) == 1


def test_no_window_is_partitioned_by_station_alone(flagged):
    for keys in re.findall(r"windowspecdefinition\(([^)]*)\)", plan(flagged)):
        assert "chunk" in keys


def test_compound_days_are_filtered_in_the_scan(spark, flagged):
    days = materialise(flagged)
    text = plan(severity.severity_events(days))
    assert "EqualTo(hw_pluvial,1)" in text
    assert "jdate" not in text


def test_counts_read_two_columns_and_the_flag(spark, flagged):
    text = plan(coincidence.monthly_counts(materialise(flagged)))
    assert "ReadSchema: struct<ID:int,year:int,month:int,hw_pluvial:int>" in text


def test_no_cross_joins(spark, flagged):
    days = materialise(flagged)
    events = materialise(severity.severity_events(days).selectExpr("*", "1D AS Long", "2D AS Lat"))
    frames = [
        severity.severity_events(days),
        joint.representative_events(joint.joint_events(events)),
        distribution.histogram(events, "intensity", ["season"], 10, ["season"]),
        distribution.kde_1d(events, "intensity", ["season"], ["season"]),
        distribution.loess_curve(events, "intensity", "year_season", ["season"]),
        bootstrap.bootstrap_ci(events, "intensity", ["season"], "mean", 10),
    ]
    for frame in frames:
        assert "CartesianProduct" not in plan(frame)
        assert "BroadcastNestedLoopJoin" not in plan(frame)


def test_draws_are_never_the_broadcast_side(spark):
    df = spark.range(200).selectExpr("id % 3 AS g", "id * id % 17 AS v")
    small = bootstrap.bootstrap_ci(df, "v", ["g"], "sum", 40)
    keys = r"\[_group#\d+L?, _pick#\d+L\], \[_group#\d+L?, _pick#\d+L\]"
    assert re.search(rf"BroadcastHashJoin {keys}, LeftOuter, BuildRight", plan(small))
    rows = sorted(small.collect())
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = bootstrap.bootstrap_ci(df, "v", ["g"], "sum", 40)
        assert re.search(rf"SortMergeJoin {keys}, LeftOuter", plan(large))
        assert sorted(large.collect()) == rows
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_draws_of_one_group_use_all_tasks(spark):
    groups = spark.createDataFrame([("a", 50_000, 1)], "g string, _n long, _group int")
    used = bootstrap._draws(groups, ["g"], 200, 1).select(F.spark_partition_id().alias("p")).distinct()
    assert used.count() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_rows_of_hot_values_are_scattered(spark):
    df = spark.range(3000).selectExpr(
        "id", "IF(id % 3 = 0, 0D, id / 10D) AS RN", "CAST(id % 7 AS double) AS TA"
    )
    small = {r.id: r.P_percentile for r in severity.with_percentiles(df).collect()}
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ranked = severity.with_percentiles(df)
        assert re.search(r"SortMergeJoin \[[^\]]*RN[^\]]*, _lane#\d+\]", plan(ranked))
        assert {r.id: r.P_percentile for r in ranked.collect()} == small
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_catalog_names_are_plain():
    assert all(re.fullmatch(r"[a-z][a-z0-9_]*", name) for name in REGISTRY)
