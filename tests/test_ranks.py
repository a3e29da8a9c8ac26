import random
import re

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from emberfall.operators import ranks, severity


def ranked(spark, values):
    df = spark.createDataFrame([(i, v, v) for i, v in enumerate(values)], "i int, TA double, RN double")
    got = severity.with_percentiles(df)
    return [r.Tmax_percentile for r in got.orderBy("i").collect()]


def test_percent_rank_leaves_null_out(spark):
    got = ranked(spark, [1.0, None, 3.0, 3.0, 5.0])
    assert got[1] is None
    assert [got[0], got[2], got[3], got[4]] == pytest.approx([0, 100 / 3, 100 / 3, 100])


def test_a_single_value_has_no_rank(spark):
    assert ranked(spark, [4.0]) == [None]


def test_pooled_rank_equals_the_window_form_with_a_hot_value(spark):
    df = spark.range(5000).select(
        "id",
        F.when(F.col("id") % 3 == 0, 0.0)
        .when(F.col("id") % 97 == 0, F.lit(None))
        .otherwise(F.pmod(F.xxhash64("id"), F.lit(3000)) / 10.0)
        .alias("RN"),
        (F.col("id") % 7).cast("double").alias("TA"),
    )
    w = Window.partitionBy(F.col("RN").isNull()).orderBy("RN")
    want = df.withColumn("p", F.when(F.col("RN").isNotNull(), F.percent_rank().over(w) * 100))
    got = severity.with_percentiles(df)
    bad = got.join(want.select("id", "p"), "id").filter(
        ~F.col("p").eqNullSafe(F.col("P_percentile"))
    )
    assert got.count() == 5000
    assert bad.count() == 0


def test_station_rank_stays_within_the_station(spark):
    df = spark.createDataFrame(
        [(1, 1.0, 0.0), (1, 2.0, 0.0), (2, 5.0, 1.0), (2, 4.0, 2.0)], "ID int, TA double, RN double"
    )
    got = {(r.ID, r.TA): r.Tmax_percentile for r in severity.station_percent_ranks(df).collect()}
    assert got == {(1, 1.0): 0.0, (1, 2.0): 100.0, (2, 4.0): 0.0, (2, 5.0): 100.0}


def test_positions_cover_every_row_once(spark):
    df = spark.range(2000).select(
        (F.col("id") % 3).alias("g"), F.pmod(F.xxhash64("id"), F.lit(50)).alias("v")
    )
    got = ranks.value_positions(df, "v", ["g"])
    for g in range(3):
        at = 0
        for r in got.filter(F.col("g") == g).orderBy("v").collect():
            assert r.n_less == at
            at += r.n_equal
        assert at == r.n_group


@pytest.mark.parametrize("n", [1, 2, 3, 50, 1001])
def test_exact_quantiles_against_numpy(spark, n):
    rng = random.Random(n)
    values = [round(rng.gauss(0, 10), 1) for _ in range(n)]
    df = spark.createDataFrame([("a", v) for v in values] + [("a", None), ("b", 1.0)], "g string, v double")
    probs = {"q0": 0.0, "q01": 0.01, "q25": 0.25, "q50": 0.5, "q95": 0.95, "q100": 1.0}
    got = {r.g: r for r in ranks.exact_quantiles(df, "v", probs, ["g"]).collect()}
    assert got["a"].n == n
    for name, p in probs.items():
        assert got["a"][name] == pytest.approx(np.quantile(values, p), abs=1e-12)
        assert got["b"][name] == 1.0


@pytest.mark.parametrize("cuts", [4, 256])
def test_quantiles_of_many_shapes_equal_numpy(spark, cuts, monkeypatch):
    """Bit-equal whatever the cuts: spread values, hot ones, outliers, single ones."""
    monkeypatch.setattr(ranks, "CUTS", cuts)
    rng = np.random.default_rng(4)
    groups = {
        "spread": rng.normal(size=700),
        "hot": np.concatenate([np.zeros(900), rng.exponential(size=60), [1e12, -1e12]]),
        "whole": rng.integers(0, 5, 333).astype(float),
        "one": np.array([3.5]),
        "two": np.array([1.0, 2.0]),
    }
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("hot", None), ("void", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    wanted = {"a": 0.0, "b": 0.01, "c": 0.25, "d": 0.5, "e": 0.9, "f": 1.0}
    got = {r.g: r for r in ranks.exact_quantiles(df, "v", wanted, ["g"]).collect()}
    assert got.keys() == groups.keys()
    for g, values in groups.items():
        ordered = np.sort(values)
        for name, q in wanted.items():
            rank = (len(values) - 1) * q
            low = ordered[int(rank)]
            high = ordered[min(int(rank) + 1, len(values) - 1)]
            assert got[g][name] == low + (rank - int(rank)) * (high - low)
        assert got[g].n == len(values)
    pooled = ranks.exact_quantiles(df, "v", {"m": 0.5}).collect()
    everything = np.concatenate(list(groups.values()))
    assert len(pooled) == 1 and pooled[0].n == len(everything) and pooled[0].m == pytest.approx(np.median(everything))


def test_quantiles_sort_no_group(spark):
    df = spark.range(5000).selectExpr("id % 3 AS g", "CAST(id AS double) AS v")
    text = ranks.exact_quantiles(df, "v", {"m": 0.5}, ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in text
    for keys in re.findall(r"windowspecdefinition\(([^)]*)\)", text):
        assert "_cut" in keys
