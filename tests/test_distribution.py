import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberfall.operators import distribution
from emberfall.workspace import materialise


def points(spark, groups):
    rows = [(g, float(v)) for g, values in groups.items() for v in values]
    return spark.createDataFrame(rows, "g string, v double")


def test_histogram_bins_are_centred_on_the_ends_and_closed_right(spark):
    got = distribution.histogram(points(spark, {"a": range(11)}), "v", ["g"], 5).orderBy("bin").collect()
    assert [r["count"] for r in got] == [2, 2, 3, 2, 2]
    assert [r.bin_low for r in got] + [got[-1].bin_high] == [-1.25, 1.25, 3.75, 6.25, 8.75, 11.25]
    edges = distribution.histogram(points(spark, {"a": [0, 1, 1, 2, 4]}), "v", ["g"], 3).orderBy("bin").collect()
    assert [r.bin_high for r in edges] == [1.0, 3.0, 5.0] and [r["count"] for r in edges] == [3, 1, 1]


def test_histogram_integrates_to_one_and_keeps_empty_bins(spark):
    df = points(spark, {"a": [0, 0, 1, 10], "b": [5, 5, 5]})
    got = distribution.histogram(df, "v", ["g"], 5).collect()
    assert len(got) == 10
    a = sorted((r.bin, r["count"], r.density) for r in got if r.g == "a")
    assert [c for _, c, _ in a] == [3, 0, 0, 0, 1]
    assert sum(d for _, _, d in a) * 2.5 == pytest.approx(1)
    assert [r["count"] for r in got if r.g == "b" and r.bin == 3] == [3]


def test_histogram_range_per_panel(spark):
    df = points(spark, {"a": [0, 10], "b": [100, 200]})
    got = {(r.g, r.bin): r["count"] for r in distribution.histogram(df, "v", ["g"], 2, ["g"]).collect()}
    assert got == {("a", 1): 1, ("a", 2): 1, ("b", 1): 1, ("b", 2): 1}


def test_histogram_of_one_value_and_of_one_bin(spark):
    got = distribution.histogram(points(spark, {"a": [3, 3]}), "v", ["g"], 4).orderBy("bin").collect()
    assert [r["count"] for r in got] == [2, 0, 0, 0]
    assert (got[0].bin_low, got[0].bin_high) == (pytest.approx(2.95), pytest.approx(3.05))
    one = distribution.histogram(points(spark, {"a": [3, 5]}), "v", ["g"], 1).collect()
    assert [(r.bin_low, r.bin_high, r["count"], r.density) for r in one] == [(3.0, 5.0, 2, 0.5)]


def nrd0(v):
    v = np.asarray(v)
    q25, q75 = np.quantile(v, [0.25, 0.75])
    return 0.9 * min(v.std(ddof=1), (q75 - q25) / 1.34) * len(v) ** -0.2


def test_density_close_to_the_kernel_sum(spark):
    rng = np.random.default_rng(1)
    values = {"a": rng.normal(0, 1, 300), "b": rng.exponential(2, 200)}
    got = distribution.kde_1d(points(spark, values), "v", ["g"]).collect()
    for g, v in values.items():
        bw = nrd0(v)
        rows = [r for r in got if r.g == g]
        assert len(rows) == 512
        for r in rows[::37]:
            want = np.exp(-(((r.x - v) / bw) ** 2) / 2).sum() / (len(v) * bw * math.sqrt(2 * math.pi))
            assert r.density == pytest.approx(want, abs=2e-4)


def test_density_drops_single_points_and_survives_no_spread(spark):
    got = distribution.kde_1d(points(spark, {"a": [1], "b": [2, 2, 2]}), "v", ["g"], ["g"])
    assert {r.g for r in got.collect()} == {"b"}


def test_density_2d_against_the_kernel_sum(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(0, 1, 150), rng.normal(5, 2, 150)
    df = spark.createDataFrame([("a", float(i), float(j)) for i, j in zip(x, y)], "g string, x double, y double")
    df = df.repartition(5).unionByName(spark.createDataFrame([("a", None, 1.0)], df.schema))
    got = distribution.kde_2d(df, "x", "y", ["g"], points=12).collect()
    assert len(got) == 144
    hx, hy = nrd0(x) / 0.9 * 1.06, nrd0(y) / 0.9 * 1.06
    for r in got:
        want = (np.exp(-(((r.x - x) / hx) ** 2) / 2) * np.exp(-(((r.y - y) / hy) ** 2) / 2)).sum()
        assert r.density == pytest.approx(want / (150 * 2 * math.pi * hx * hy), rel=1e-9, abs=1e-15)
    assert max(r.ndensity for r in got) == 1.0


def test_density_2d_holds_one_grid_per_group_and_part(spark, monkeypatch):
    monkeypatch.setattr(distribution, "POINTS_IN_PART", 17)
    df = spark.range(20000).select(
        (F.col("id") % 400).alias("n"),
        (F.col("id") * 7 % 31).cast("double").alias("x"),
        (F.col("id") * 11 % 37).cast("double").alias("h"),
    )
    frames = [f[f.x.notna()] for f in [df.toPandas()]]
    by_key = frames[0].sort_values("n").rename(columns={"x": "_x", "h": "_y"})
    by_key = by_key.assign(_m=1, _hx=1.0, _hy=1.0, _x_low=0.0, _x_high=31.0, _y_low=0.0, _y_high=37.0)
    cut = [by_key.iloc[a : a + 3000] for a in range(0, len(by_key), 3000)]
    emitted = list(distribution._grid_sums(["n"], 4)(iter(cut)))
    assert len(emitted) == 400 and all(len(e) == 16 for e in emitted)
    got = distribution.kde_2d(df, "x", "h", ["n"], points=4)
    assert got.count() == 400 * 16


def test_density_2d_of_one_group_uses_all_tasks(spark):
    """As many tasks as shuffles have share a group; points that repeat are one."""
    name, before = "spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions")
    x = (F.col("id") % 1_000_003).cast("double")
    pairs = spark.range(1_100_000).select(F.lit("a").alias("g"), x.alias("_x"), (x * 7 % 1009).alias("_y"))
    pairs = pairs.union(spark.range(300_000).select(F.lit("a"), F.lit(1.0), F.lit(7.0)))
    axes = "1.4e6D AS _n, 1D AS _hx, 1D AS _hy, 0D AS _x_low, 1D AS _x_high, 0D AS _y_low, 1D AS _y_high"
    groups = spark.sql(f"SELECT 'a' AS g, {axes}")
    spark.conf.set(name, "64")
    try:
        dealt = distribution._dealt_points(pairs, groups, ["g"])
        sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == 64 and sum(sizes) == 1_000_003 and max(sizes) < 3 * 1_000_003 / 64
    finally:
        spark.conf.set(name, before)


def test_density_has_one_row_per_group_until_it_is_read(spark):
    df = points(spark, {"a": range(50), "b": [1, 2, 4]})
    text = distribution.kde_1d(df, "v", ["g"])._jdf.queryExecution().executedPlan().toString()
    assert text.count("Generate") == 2 and text.index("Generate inline") < text.index("collect_list")


def test_box(spark):
    df = points(spark, {"a": [1, 2, 3, 4, 5, 100], "b": [7, 7, 7]}).withColumn("k", F.lit(1))
    got = {r.g: r for r in distribution.box_stats(df, "v", ["g"]).collect()}
    a = got["a"]
    assert (a.q25, a.median, a.q75) == (2.25, 3.5, 4.75)
    assert (a.whisker_low, a.whisker_high, a.n_outliers) == (1.0, 5.0, 1)
    assert (got["b"].whisker_low, got["b"].whisker_high) == (7.0, 7.0)
    out = distribution.box_outliers(df, "v", ["g"], ["k"]).collect()
    assert [(r.g, r.v) for r in out] == [("a", 100.0)]


def test_quantile_limits(spark):
    df = spark.range(101).selectExpr("CAST(id AS double) AS a", "CAST(id * 2 AS double) AS b")
    got = {r.measure: (r.low, r.high) for r in distribution.quantile_limits(df, ["a", "b"]).collect()}
    assert got == {"a": (1.0, 99.0), "b": (2.0, 198.0)}


def weighted_fit(x, y, at, span=0.75):
    x, y = np.asarray(x, float), np.asarray(y, float)
    d = np.abs(x - at)
    r = np.sort(d)[int(len(x) * span + 1e-5) - 1]
    w = np.where(d < r, (1 - (d / r) ** 3) ** 3, 0)
    return np.polyval(np.polyfit(x - at, y, 2, w=np.sqrt(w)), 0)


def test_local_regression_against_a_weighted_fit(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 40, 200)
    y = np.sin(x / 6) + rng.normal(0, 0.1, 200)
    df = spark.createDataFrame([("a", int(i), float(j)) for i, j in zip(x, y)], "g string, x int, y double")
    for r in distribution.loess_curve(df, "y", "x", ["g"], points=15).collect():
        assert r.fit == pytest.approx(weighted_fit(x, y, r.x), abs=1e-6)


def test_local_regression_with_few_abscissae(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 1, 3.0), ("a", 2, 5.0), ("b", 4, 7.0)], "g string, x int, y double")
    got = distribution.loess_curve(df, "y", "x", ["g"], span=1.0, points=2).collect()
    fits = {(r.g, r.i): r.fit for r in got}
    assert fits[("a", 0)] == pytest.approx(2.0)
    assert fits[("b", 0)] == 7.0


@pytest.mark.parametrize("block", [7, 4096])
def test_local_regression_over_blocks_and_ties(spark, block, monkeypatch):
    """Hot abscissae that cover many blocks, and groups of one x, beside spread ones."""
    monkeypatch.setattr(distribution, "POINTS_IN_BLOCK", block)
    rng = np.random.default_rng(5)
    groups = {
        "ties": np.repeat([0.0, 1.0, 2.5, 7.0, 9.0, 9.5], [40, 3, 1, 60, 2, 9]),
        "spread": rng.exponential(3.0, 150),
        "one": np.full(30, 4.0),
    }
    rows = [(g, float(v), float(np.cos(v / 3) + e)) for g, x in groups.items() for v, e in zip(x, rng.normal(0, 0.1, len(x)))]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = distribution.loess_curve(df, "y", "x", ["g"], points=23).collect()
    assert len(got) == 69
    for r in got:
        x = np.array([b for a, b, _ in rows if a == r.g])
        y = np.array([c for a, _, c in rows if a == r.g])
        if r.g == "one":
            assert r.fit == pytest.approx(y.mean())
        elif r.g == "spread" or len(np.unique(x[np.abs(x - r.x) < 0.999 * np.sort(np.abs(x - r.x))[int(len(x) * 0.75 + 1e-5) - 1]])) > 2:
            assert r.fit == pytest.approx(weighted_fit(x, y, r.x), abs=1e-5)


def test_local_regression_of_a_million_abscissae(spark):
    """Real-valued x: no window holds the group, and the curve is found in seconds."""
    x = (F.xxhash64("id") % 1_000_000_007 / 1e9 + 0.000001 * F.col("id")).cast("double")
    df = spark.range(1_000_000).select(F.lit("a").alias("g"), x.alias("x")).withColumn("y", F.col("x") * F.col("x") - 1)
    df = materialise(df)
    curve = distribution.loess_curve(df, "y", "x", ["g"], points=20)
    for keys in re.findall(r"windowspecdefinition\(([^)]*)\)", curve._jdf.queryExecution().executedPlan().toString()):
        assert "_block" in keys or "block" in keys or "i#" in keys
    for r in curve.collect():
        assert r.fit == pytest.approx(r.x * r.x - 1, abs=1e-6)
