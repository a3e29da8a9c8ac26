import math

import pytest

from emberfall.operators import anomalies, frequency


@pytest.fixture(scope="module")
def seasonal(spark):
    rows = []
    for year, count in zip(range(1990, 1994), (1, 2, 3, 2)):
        rows.append((1, year, "JJA", count))
        rows.append((2, year, "JJA", 5))
    rows += [(1, 2000, "JJA", 6), (2, 2000, "JJA", 9), (3, 2000, "JJA", 1)]
    return spark.createDataFrame(rows, "ID int, year_season int, season string, cdh_count long")


def test_means(seasonal):
    base = {r.ID: (r.base_ave, r.cdh_sd) for r in frequency.base_means(seasonal, (1990, 1993)).collect()}
    assert base[1] == (2.0, pytest.approx(math.sqrt(2 / 3)))
    assert base[2] == (5.0, 0.0)
    target = {r.ID: r.target_ave for r in frequency.target_means(seasonal, (2000, 2001)).collect()}
    assert target == {1: 6.0, 2: 9.0, 3: 1.0}
    annual = {r.ID: r.cdh_ave for r in frequency.count_means(seasonal, ["ID"]).collect()}
    assert annual[1] == 2.8


def test_comparison_stacks_both_periods(seasonal):
    both = frequency.period_comparison(
        frequency.base_means(seasonal, (1990, 1993)),
        frequency.target_means(seasonal, (2000, 2001)),
        "old",
        "new",
    )
    assert both.filter("Period = 'old'").count() == 2
    assert both.filter("Period = 'new' and cdh_sd is null").count() == 3


def test_anomaly_needs_spread_base_and_target(seasonal):
    got = frequency.standardised_anomaly(seasonal, (1990, 1993), (2000, 2001))
    assert [r.ID for r in got.collect()] == [1]
    assert got.first().anomaly == pytest.approx(4 / math.sqrt(2 / 3))
    assert frequency.exceedance_counts(got, 2.0).first().n_gauge == 1
    ratio = frequency.exceedance_ratio(got, 9.0).first()
    assert (ratio.total_gauge, ratio.n_anom_gt2, ratio.ratio_pct) == (1, 0, 0.0)
    limits = frequency.value_limits(got, "anomaly").first()
    assert limits.low == limits.high == limits.max_abs


def test_recent_points_have_text_years(seasonal):
    row = frequency.recent_points(seasonal, (2000, 2001), "new").first()
    assert (row.year_season, row.Period) == ("2000", "new")
    assert row.cdh_ave == pytest.approx(16 / 3)


def test_totals_agree_with_the_counts(seasonal):
    totals = {r.year_season: r.total_cphw for r in frequency.regional_totals(seasonal).collect()}
    assert totals == {1990: 6, 1991: 7, 1992: 8, 1993: 7, 2000: 16}


def series(spark, target):
    rows = [("JJA", 2000 + i, v) for i, v in enumerate((1, 2, 3, 4))] + [("JJA", 2024, target)]
    return spark.createDataFrame(rows, "season string, year_season int, total long")


def test_ecdf_and_record(spark):
    row = anomalies.ecdf_rank(series(spark, 3), "total", (2000, 2003), 2024).first()
    assert (row.P_value, row.Is_Record) == (75.0, False)
    row = anomalies.ecdf_rank(series(spark, 4), "total", (2000, 2003), 2024).first()
    assert (row.P_value, row.Is_Record) == (100.0, True)


def test_anomaly_table(spark):
    row = anomalies.season_anomaly_table(series(spark, 4), "total", (2000, 2003), 2024).first()
    assert (row.target_total, row.mu, row.Record_Status) == (4, 2.5, "Record High (100%)")
    assert row.Z_score == pytest.approx(1.5 / row.sigma)


def test_return_period(spark):
    row = anomalies.return_periods(series(spark, 4), "total", 2003).first()
    tail = 0.5 * math.erfc(row.Z_score / math.sqrt(2))
    assert row.Return_Period == pytest.approx(1 / tail)
    flat = spark.createDataFrame(
        [("JJA", 2000, 1.0), ("JJA", 2001, 1.0), ("JJA", 2024, 2.0)],
        "season string, year_season int, total double",
    )
    row = anomalies.return_periods(flat, "total", 2003).first()
    assert (row.Z_score, row.Return_Period) == (None, None)
