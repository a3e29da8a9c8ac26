import math

import pytest
from pyspark.sql import functions as F

from emberfall.functions import calendar, labels, measures, special


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_seasons(spark):
    rows = [(m,) for m in (12, 1, 2, 3, 5, 6, 8, 9, 11)] + [(None,)]
    got = values(spark, calendar.season_of(F.col("m")), rows, "m int")
    assert got == ["DJF"] * 3 + ["MAM"] * 2 + ["JJA"] * 2 + ["SON"] * 2 + [None]
    rows = [(2000, 12), (2001, 1)]
    got = values(spark, calendar.season_year(F.col("y"), F.col("m")), rows, "y int, m int")
    assert got == [2001, 2001]
    names = [("DJF",), ("MAM",), ("JJA",), ("SON",)]
    assert values(spark, calendar.season_order(F.col("s")), names, "s string") == [1, 2, 3, 4]
    assert values(spark, calendar.alphabetical_season_index(F.col("s")), names, "s string") == [
        1, 3, 2, 4,
    ]


def test_periods(spark):
    got = values(
        spark, calendar.period_of(F.col("y"), 2023, ("old", "new")), [(2023,), (2024,)], "y int"
    )
    assert got == ["old", "new"]


def test_bins_are_right_closed_and_include_the_lowest(spark):
    rows = [(49.9,), (50.0,), (60.0,), (60.1,), (100.0,), (None,)]
    got = values(
        spark, measures.cut_bins(F.col("x"), (50, 60, 70, 80, 90, 100)), rows, "x double"
    )
    assert got == [None, "[50,60]", "[50,60]", "(60,70]", "(90,100]", None]


def test_map_classes(spark):
    rows = [(-0.1,), (0.0,), (1.0,), (1.5,), (6.0,), (6.1,), (None,)]
    got = values(
        spark, measures.class_breaks(F.col("x"), range(7), (0, 6)), rows, "x double"
    )
    assert got == [None, 1, 1, 2, 6, None, None]


def test_relative_measures(spark):
    rows = [(120.0, 100.0), (80.0, 100.0), (None, 100.0), (5.0, 0.0), (5.0, -1.0)]
    excess = measures.relative_excess(F.col("v"), F.col("t"))
    assert values(spark, excess, rows, "v double, t double") == [0.2, 0.0, None, None, None]
    anomaly = measures.relative_anomaly(F.col("v"), F.col("t"))
    assert values(spark, anomaly, rows, "v double, t double") == [0.2, -0.2, None, None, None]


def test_finite(spark):
    rows = [(1.0,), (None,), (float("nan"),), (float("inf"),), (float("-inf"),)]
    got = values(spark, measures.is_finite(F.col("x")), rows, "x double")
    assert got == [True, False, False, False, False]


def test_labels(spark):
    rows = [(0.0005,), (0.005,), (0.04,), (0.05,), (None,)]
    assert values(spark, labels.significance(F.col("p")), rows, "p double") == [
        "***", "**", "*", "ns", None,
    ]
    rows = [(99.0, False), (95.0, False), (90.0, False), (10.0, False), (10.0, True)]
    got = values(spark, labels.rank_label(F.col("p"), F.col("r")), rows, "p double, r boolean")
    assert got == [
        "Extremely High (>99th)",
        "Very High (>95th)",
        "High (>90th)",
        "Near Average (<90th)",
        "Record High (100%)",
    ]


def test_normal_cdf_against_erfc(spark):
    zs = [z / 4 for z in range(-40, 41)]
    got = values(spark, special.normal_cdf(F.col("z")), [(z,) for z in zs], "z double")
    for z, p in zip(zs, got):
        assert p == pytest.approx(0.5 * math.erfc(-z / math.sqrt(2)), abs=1e-14)


def student_by_integration(t, df, steps=20000):
    scale = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    h = t / steps
    f = lambda x: scale * (1 + x * x / df) ** (-(df + 1) / 2)
    inner = sum((4 if i % 2 else 2) * f(i * h) for i in range(1, steps))
    return 2 * h / 3 * (f(0) + inner + f(t))


@pytest.mark.parametrize("df", [1, 2, 3, 4, 7, 10, 37, 38])
def test_student_tail_and_quantile(spark, df):
    ts = [0.3, 1.0, 2.5, 6.0]
    got = values(
        spark, special.student_two_sided(F.col("t"), F.lit(df)), [(t,) for t in ts], "t double"
    )
    for t, p in zip(ts, got):
        assert p == pytest.approx(1 - student_by_integration(t, df), abs=1e-10)
    quantile = spark.range(1).select(special.student_quantile(0.95, F.lit(df))).first()[0]
    assert student_by_integration(quantile, df) == pytest.approx(0.95, abs=1e-7)


def test_far_tails(spark):
    z = [3.0, 5.0, 9.0, -9.0, 30.0, None]
    got = values(spark, special.normal_two_sided(F.col("z")), [(x,) for x in z], "z double")
    for x, p in zip(z[:-1], got):
        assert p == pytest.approx(math.erfc(abs(x) / math.sqrt(2)), rel=1e-10)
    assert got[2] == pytest.approx(2.2571768e-19, rel=1e-6) and got[-1] is None
    got = values(spark, special.student_two_sided(F.col("t"), F.col("d")), [(1e6, 1), (1e4, 2), (50.0, 7), (None, 3), (1.0, 0)], "t double, d int")
    assert got[0] == pytest.approx(2 / math.pi * math.atan(1e-6), rel=1e-10)
    assert got[1] == pytest.approx(1e-8, rel=1e-7)
    assert 0 < got[2] < 1e-9 and got[3:] == [None, None]


def test_quantile_has_no_ceiling(spark):
    for level, df, want in ((0.9995, 1, 1273.239), (0.999999, 1, 636619.77), (0.9999, 2, 99.9925)):
        got = spark.range(1).select(special.student_quantile(level, F.lit(df))).first()[0]
        assert got == pytest.approx(want, rel=1e-5)
