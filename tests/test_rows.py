"""Row windows, thresholds and flags on small hand-made series."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from emberfall.operators import coincidence, rows, thresholds
from emberfall.workspace import materialise

SCHEMA = "ID int, date date, TA double, RN double"


def series(spark, values, start=dt.date(2001, 1, 1), station=1, dates=None):
    """One station with consecutive days unless ``dates`` are given."""
    dates = dates or [start + dt.timedelta(days=i) for i in range(len(values))]
    return spark.createDataFrame(
        [(station, d, *map(lambda v: None if v is None else float(v), pair)) for d, pair in zip(dates, values)],
        SCHEMA,
    )


def numbered(obs, first_year_max=None):
    return rows.number_rows(rows.land_observations(obs), first_year_max)


def ordered(df, column):
    return [r[column] for r in df.orderBy("ID", "date").collect()]


def test_min_run_breaks_on_null(spark):
    hot = [1, 1, None, 1, 0, 1, 1, 1]
    obs = numbered(series(spark, [(h, 0) for h in hot])).withColumn("hot", F.col("TA") == 1)
    spread = rows.spread_chunks(obs, 1, 4)
    got = rows.home_rows(rows.with_min_run(spread, "hot", 2, "run", rows.chunk_window()))
    assert ordered(got, "run") == [True, True, False, False, False, True, True, True]


def test_rolling_mean_edges(spark):
    obs = numbered(series(spark, [(i, 0) for i in range(1, 21)]))
    got = ordered(thresholds.rolling_temperature(obs, 15, chunk_rows=8), "roll_temp")
    assert got == [None] * 7 + [8.0, 9.0, 10.0, 11.0, 12.0, 13.0] + [None] * 7


def test_rolling_mean_is_null_where_a_value_is_missing(spark):
    values = [(None if i == 15 else 1, 0) for i in range(31)]
    got = ordered(thresholds.rolling_temperature(numbered(series(spark, values))), "roll_temp")
    assert [i for i, v in enumerate(got) if v is not None] == [7, 23]


def flags(spark, heat, rain, dates=None, start=dt.date(2001, 1, 1), lag=7, chunk_rows=4096):
    values = [(0, 0)] * (max(max(heat), max(rain)) + 1 if dates is None else len(dates))
    obs = numbered(series(spark, values, start, dates=dates))
    marked = obs.withColumn("x", F.col("row_no").isin(heat)).withColumn(
        "y", F.col("row_no").isin(rain)
    )
    return ordered(
        coincidence.coincidence_flags(marked, "x", "y", lag, "hit", chunk_rows), "hit"
    )


def test_lag_excludes_the_same_day(spark):
    assert sum(flags(spark, [3], [3])) == 0


def test_lag_limit_and_single_count(spark):
    assert flags(spark, [0], [7])[0] == 1
    assert sum(flags(spark, [0], [8])) == 0
    assert sum(flags(spark, [0], [1, 3])) == 1


def test_lag_counts_rows_not_days(spark):
    dates = [dt.date(2001, 1, 1), dt.date(2001, 1, 5), dt.date(2001, 1, 11)]
    assert flags(spark, [0], [2], dates=dates, lag=2) == [1, 0, 0]


def test_lag_stops_at_the_year_but_forward_max_does_not(spark):
    start = dt.date(2001, 12, 30)
    assert sum(flags(spark, [0, 1], [3], start=start)) == 0
    obs = numbered(series(spark, [(0, 0), (0, 0), (0, 0), (0, 9)], start))
    spread = rows.spread_chunks(obs, 7)
    got = rows.home_rows(
        spread.withColumn("m", rows.forward_max(F.col("RN"), 7, rows.chunk_window()))
    )
    assert ordered(got, "m") == [9.0, 9.0, 9.0, 9.0]


def test_forward_max_is_short_at_the_end(spark):
    obs = numbered(series(spark, [(0, r) for r in (5, 1, 4, 2, 3)]))
    spread = rows.spread_chunks(obs, 2, 3)
    got = rows.home_rows(
        spread.withColumn("m", rows.forward_max(F.col("RN"), 2, rows.chunk_window()))
    )
    assert ordered(got, "m") == [5.0, 4.0, 4.0, 3.0, 3.0]


def test_rate_is_null_without_events(spark):
    df = spark.createDataFrame(
        [(1, 2000, False, 0), (1, 2001, True, 1), (1, 2001, True, 0)],
        "ID int, year int, x boolean, hit int",
    )
    got = {r.year: (r.events, r.coincidences, r.ecr) for r in
           coincidence.coincidence_rate(df, "x", "hit", ["ID", "year"]).collect()}
    assert got == {2000: (0, 0, None), 2001: (2, 1, 0.5)}


def test_wet_threshold_uses_wet_days_of_the_window(spark):
    values = [(0, r) for r in (0, 0, 1, 2, 3, None)]
    obs = numbered(series(spark, values)).unionByName(
        numbered(series(spark, [(0, 100)], dt.date(2030, 1, 1)))
    )
    assert thresholds.wet_thresholds(obs, (1991, 2020)).first().pl_thrsld == 2.9


def test_late_stations_are_left_out(spark):
    obs = series(spark, [(1, 1)], dt.date(1986, 5, 1), 1).unionByName(
        series(spark, [(1, 1)], dt.date(1990, 5, 1), 2)
    )
    landed = rows.land_observations(obs)
    assert [r.ID for r in rows.number_rows(landed, 1986).collect()] == [1]
    assert [r.ID for r in rows.eligible_stations(landed, 1986).collect()] == [1]


def test_years_are_selected_after_the_rolling_mean(spark):
    start = dt.date(1990, 12, 20)
    obs = numbered(series(spark, [(10, 0)] * 40, start))
    hot = thresholds.hot_thresholds(obs, (1991, 1991)).filter("jdate = 1").first()
    assert (hot.hw_thrsld, hot.n) == (10.0, 1)


def noisy(spark, stations=3, days=900):
    """A gappy record of several stations, from hashes."""
    grid = spark.range(stations * days).select(
        (F.col("id") % stations).cast("int").alias("ID"),
        F.date_add(F.lit("1999-01-01").cast("date"), F.floor(F.col("id") / stations).cast("int")).alias("date"),
        F.pmod(F.xxhash64("id", F.lit(1)), F.lit(400)).alias("a"),
        F.pmod(F.xxhash64("id", F.lit(2)), F.lit(100)).alias("b"),
        F.pmod(F.xxhash64("id", F.lit(3)), F.lit(10)).alias("c"),
    )
    return grid.filter("c > 0").select(
        "ID",
        "date",
        F.when(F.col("a") > 3, F.col("a") / 10).alias("TA"),
        F.when(F.col("b") > 60, (F.col("b") - 60) / 1.0).otherwise(0.0).alias("RN"),
    )


@pytest.mark.parametrize("chunk_rows", [8, 31, 4096])
def test_chunks_do_not_change_results(spark, chunk_rows):
    obs = numbered(noisy(spark))
    hot = materialise(thresholds.hot_thresholds(obs, (1999, 2001), 0.5, 15, chunk_rows))
    wet = materialise(thresholds.wet_thresholds(obs, (1999, 2001), 0.5))
    flagged = coincidence.flag_days(obs, hot, wet, chunk_rows=chunk_rows)
    got = [tuple(r) for r in flagged.orderBy("ID", "date").collect()]
    assert got == brute_force(obs, hot, wet)


def brute_force(obs, hot, wet):
    """The same flags by plain loops over each station."""
    hot_of = {(r.ID, r.jdate): r.hw_thrsld for r in hot.collect()}
    wet_of = {r.ID: r.pl_thrsld for r in wet.collect()}
    by_station = {}
    for r in obs.orderBy("ID", "date").collect():
        by_station.setdefault(r.ID, []).append(r)
    out = []
    for station, days in sorted(by_station.items()):
        threshold = [hot_of.get((station, d.jdate)) for d in days]
        warm = [d.TA is not None and t is not None and d.TA > t for d, t in zip(days, threshold)]
        rainy = [d.RN > wet_of[station] for d in days]
        n = len(days)
        for i, d in enumerate(days):
            wave = warm[i] and ((i > 0 and warm[i - 1]) or (i + 1 < n and warm[i + 1]))
            ahead = any(
                rainy[j] and days[j].year == d.year for j in range(i + 1, min(i + 8, n))
            )
            out.append(
                (
                    station, d.date, d.TA, d.RN, d.jdate, d.year, d.month, i, threshold[i], wave,
                    wet_of[station], int(rainy[i]), int(wave and ahead),
                    max(x.RN for x in days[i : i + 8]),
                )
            )
    return out


def test_rolling_mean_equals_an_unchunked_window(spark):
    obs = numbered(noisy(spark))
    a = ordered(thresholds.rolling_temperature(obs, 15, chunk_rows=16), "roll_temp")
    b = ordered(thresholds.rolling_temperature(obs, 15, chunk_rows=100_000), "roll_temp")
    assert a == b


def test_rates_are_bounded_and_grow_with_the_lag(spark):
    obs = numbered(noisy(spark)).withColumn("x", F.col("TA") > 20).withColumn("y", F.col("RN") > 20)
    last = None
    for lag in (1, 3, 7):
        flagged = coincidence.coincidence_flags(obs, "x", "y", lag)
        rate = {r.ID: r.ecr for r in coincidence.coincidence_rate(flagged, "x", "coincides", ["ID"]).collect()}
        assert all(0 <= v <= 1 for v in rate.values())
        if last:
            assert all(rate[k] >= last[k] for k in rate)
        last = rate


def test_counts_keep_empty_months_and_shift_december(spark):
    fact = spark.createDataFrame(
        [(1, 2000, 12, 1), (1, 2001, 1, 1), (1, 2001, 1, 1), (1, 2001, 3, 0)],
        "ID int, year int, month int, hw_pluvial int",
    )
    monthly = coincidence.monthly_counts(fact)
    assert {(r.year, r.month): r.num_coincidence for r in monthly.collect()} == {
        (2000, 12): 1, (2001, 1): 2, (2001, 3): 0,
    }
    seasonal = {(r.year_season, r.season): (r.cdh_count, r.n_months) for r in
                coincidence.seasonal_counts(monthly).collect()}
    assert seasonal == {(2001, "DJF"): (3, 2), (2001, "MAM"): (0, 1)}


def test_fact_carries_the_station_year_rate(spark):
    fact = spark.createDataFrame(
        [(1, 2000, True, 1), (1, 2000, True, 0), (1, 2001, False, 0)],
        "ID int, year int, heatwave boolean, hw_pluvial int",
    )
    got = coincidence.with_station_year_rate(fact)
    assert sorted((r.year, r.ecr) for r in got.filter("ecr is not null").collect()) == [
        (2000, 0.5), (2000, 0.5),
    ]
    assert got.filter("year = 2001").first().ecr is None
