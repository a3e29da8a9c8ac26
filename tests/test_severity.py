import datetime as dt

import pytest
from pyspark.sql import functions as F

from emberfall.operators import joint, severity

EVENT = "ID int, Long double, Lat double, year_season int, season string, date date, T_anom_rel double, P_excess_rel double"


def intensities(spark, rows):
    return spark.createDataFrame(
        rows, "ID int, season string, year_season int, intensity double"
    )


def test_events_measure_heat_rain_and_their_product(spark):
    rows = [
        (1, dt.date(2000, 12, 31), 30.0, 0.0, 2000, 12, 25.0, 20.0, 1, 50.0),
        (1, dt.date(2001, 1, 1), 10.0, 50.0, 2001, 1, 25.0, 20.0, 0, 50.0),
        (1, dt.date(2001, 1, 2), 20.0, 10.0, 2001, 1, None, 20.0, 0, 10.0),
        (1, dt.date(2001, 1, 3), None, None, 2001, 1, 25.0, None, 0, None),
    ]
    days = spark.createDataFrame(
        rows,
        "ID int, date date, TA double, RN double, year int, month int, hw_thrsld double, "
        "pl_thrsld double, hw_pluvial int, rain_ahead double",
    )
    got = severity.severity_events(days).collect()
    assert len(got) == 1
    event = got[0]
    assert (event.Tmax_percentile, event.Pmax_7day, event.intensity) == (100.0, 100.0, 100.0)
    assert (event.T_anom_rel, event.P_excess_rel) == (0.2, 4.0)
    assert (event.season, event.year_season) == ("DJF", 2001)


def test_profile_and_medians_use_positive_intensities(spark):
    df = intensities(spark, [(1, "JJA", 2000, v) for v in (0.0, 2.0, 4.0, 9.0, None)])
    row = severity.severity_profile(df, ["ID", "season"]).first()
    assert (row.mean_intensity, row.max_intensity, row.sum_intensity, row.freq) == (5.0, 9.0, 15.0, 3)
    assert severity.severity_medians(df, ["ID"]).first().median_intensity == 4.0


def test_anomaly_keeps_groups_with_recent_rows_only(spark):
    df = intensities(
        spark, [(1, "JJA", 2000, 4.0), (1, "JJA", 2024, 6.0), (2, "JJA", 2000, 1.0), (3, "JJA", 2024, 5.0)]
    )
    recent = F.col("year_season") >= 2024
    got = {r.ID: (r.recent_mean, r.base_mean, r.anomaly) for r in
           severity.severity_anomaly(df, ["ID"], recent, ~recent).collect()}
    assert got == {1: (6.0, 4.0, 2.0), 3: (5.0, None, None)}


def test_series_and_station_medians(spark):
    df = intensities(
        spark, [(1, "JJA", 2000, v) for v in (1.0, 2.0, 9.0)] + [(2, "JJA", 2000, 4.0), (3, "SON", 2000, None)]
    )
    assert severity.severity_series_mean(df).filter("season = 'JJA'").first().mean_intensity == 4.0
    assert severity.severity_series_median(df).filter("season = 'JJA'").first().mean_intensity == 3.0
    medians = severity.station_season_medians(df)
    assert {r.ID: r.annual_mean_intensity for r in medians.collect()} == {1: 2.0, 2: 4.0}
    assert {r.ID: r.intensity_ave for r in severity.mean_of_medians(medians).collect()} == {1: 2.0, 2: 4.0}


def test_matrix_averages_bin_pairs(spark):
    df = spark.createDataFrame(
        [(1, 1.0, 2.0, 95.0, 95.0, "(90,100]", "(90,100]"), (1, 1.0, 2.0, 91.0, 100.0, "(90,100]", "(90,100]"),
         (2, 1.0, 2.0, 10.0, 95.0, None, "(90,100]")],
        "ID int, Long double, Lat double, Tmax_percentile double, P_percentile double, Tmax_bin string, P_bin string",
    )
    matrix = severity.intensity_matrix(df)
    row = matrix.first()
    assert row.compound_intensity == pytest.approx((95 * 95 + 91 * 100) / 200)
    assert row.label == round(row.compound_intensity, 2)
    assert severity.matrix_stations(df, matrix).count() == 1


def test_representative_is_the_first_of_the_largest(spark):
    day = lambda d: dt.date(2001, 7, d)
    rows = [
        (1, 1.0, 2.0, 2001, "JJA", day(9), 2.0, 3.0),
        (1, 1.0, 2.0, 2001, "JJA", day(5), 3.0, 2.0),
        (1, 1.0, 2.0, 2001, "JJA", day(1), 1.0, 1.0),
        (1, 1.0, 2.0, 2001, "JJA", day(2), None, 1.0),
        (2, 1.0, 2.0, 2001, "JJA", day(4), None, 1.0),
        (2, 1.0, 2.0, 2001, "JJA", day(3), 1.0, None),
    ]
    events = joint.joint_events(spark.createDataFrame(rows, EVENT))
    got = {r.ID: r for r in joint.representative_events(events).collect()}
    assert (got[1].date, got[1].comp_int_rel, got[1].max_comb, got[1].diff) == (day(5), 6.0, 6.0, 0.0)
    assert (got[2].date, got[2].max_comb, got[2].diff) == (day(3), None, None)


def test_events_are_counted_by_season_and_period(spark):
    df = spark.createDataFrame([("JJA", "a"), ("JJA", "a"), ("SON", "b")], "season string, Period string")
    assert {(r.season, r.Period): r.event for r in joint.event_counts(df).collect()} == {
        ("JJA", "a"): 2, ("SON", "b"): 1,
    }
