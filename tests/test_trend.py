import hashlib
import math
import random
import re

import numpy as np
import pytest

from emberfall.workspace import materialise
from emberfall.operators import bootstrap, trend
from test_functions import student_by_integration


def series(spark, values, season="JJA"):
    return spark.createDataFrame(
        [(season, 2000 + i, None if v is None else float(v)) for i, v in enumerate(values)],
        "season string, year int, v double",
    )


def test_line_through_three_points(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 3.0), ("a", 3, 5.0)], "s string, x int, y double")
    row = trend.linear_trend(df, "y", "x", ["s"]).first()
    assert row.slope == pytest.approx(1.5)
    assert row.intercept == pytest.approx(1 / 3)
    assert row.r2 == pytest.approx(27 / 28)
    t = 1.5 / math.sqrt((1 / 6) / 1 / 2)
    assert row.p_value == pytest.approx(1 - student_by_integration(t, 1), abs=1e-8)


def test_trend_line_is_narrowest_at_the_mean(spark):
    rows = trend.trend_line(series(spark, [1, 3, 2, 5, 4]), "v", "year", ["season"], 5).orderBy("i").collect()
    width = [r.upper - r.lower for r in rows]
    assert width.index(min(width)) == 2
    assert rows[2].fit == pytest.approx(3.0)
    s = math.sqrt((10 - 0.8**2 * 10) / 3)
    assert width[2] / 2 == pytest.approx(3.182446305 * s / math.sqrt(5))


def kendall_by_pairs(values):
    s = sum(
        (values[j] > values[i]) - (values[j] < values[i])
        for i in range(len(values))
        for j in range(i + 1, len(values))
    )
    n = len(values)
    ties = [values.count(v) for v in set(values)]
    variance = (n * (n - 1) * (2 * n + 5) - sum(m * (m - 1) * (2 * m + 5) for m in ties)) / 18
    return s, variance


def test_mann_kendall_with_ties(spark):
    row = trend.mann_kendall(series(spark, [3, 1, 4, 4, 9]), "v", "year", ["season"]).first()
    assert row.S == 7
    assert row.varS == pytest.approx(15.6667, abs=1e-4)
    assert row.z == pytest.approx(1.51587, abs=1e-5)
    assert row.tau == pytest.approx(0.73786, abs=1e-5)
    assert row.p_value == pytest.approx(math.erfc(row.z / math.sqrt(2)), abs=1e-12)


@pytest.mark.parametrize("seed", range(4))
def test_mann_kendall_against_pairs(spark, seed):
    rng = random.Random(seed)
    values = [rng.randint(0, 12) for _ in range(60)]
    row = trend.mann_kendall(series(spark, values), "v", "year", ["season"]).first()
    s, variance = kendall_by_pairs(values)
    assert (row.S, row.varS) == (s, pytest.approx(variance))


@pytest.fixture
def many_ranges(spark):
    """Small ranges stay apart."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, before)


def test_mann_kendall_in_blocks(spark, many_ranges):
    rng = random.Random(9)
    groups = {"a": [rng.choice([1, 5, rng.randint(0, 40)]) for _ in range(120)], "b": [4, 4, 2], None: [1, 2, 2, 9, 0]}
    groups["c"] = [rng.random() for _ in range(70)]
    rows = [(g, t, float(v)) for g, values in groups.items() for t, v in enumerate(values)]
    df = spark.createDataFrame(rows + [("a", 500, None), ("a", None, 1.0)], "season string, year int, v double")
    got = {r.season: r for r in trend.mann_kendall(df, "v", "year", ["season"]).collect()}
    for g, values in groups.items():
        s, variance = kendall_by_pairs(values)
        assert (got[g].n, got[g].S, got[g].varS) == (len(values), s, pytest.approx(variance))


def test_rows_move_once_for_either_cut(spark, many_ranges):
    """Shuffled rows are at most twice the values, and a few for each pair of ranges."""
    n = 20_000
    df = materialise(spark.range(n).selectExpr("'a' AS g", "id AS t", "CAST(id * 7919 % 20011 AS double) AS v"))
    store = spark.sparkContext._jsc.sc().statusStore()
    last = max([s.stageId() for s in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None))], default=-1)
    trend.mann_kendall(df, "v", "t", ["g"]).collect()
    stages = spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None))
    written = sum(s.shuffleWriteRecords() for s in stages if s.stageId() > last)
    assert 2 * n <= written < 2 * n + 2000


def test_mann_kendall_of_one_long_group(spark, many_ranges):
    df = spark.range(200_000).selectExpr("'a' AS g", "id AS t", "CAST(id * 7919 % 200003 AS double) AS v")
    found = trend.mann_kendall(df, "v", "t", ["g"])
    windows = re.findall(r"windowspecdefinition\(([^)]*)\)", found._jdf.queryExecution().executedPlan().toString())
    assert windows and all("_block" in w or "_at" in w for w in windows)
    values = [i * 7919 % 200003 for i in range(200_000)]
    tree, s = [0] * 200_004, 0
    for n, v in enumerate(values):
        below, i = 0, v + 1
        while i:
            below, i = below + tree[i], i & (i - 1)
        s += 2 * below - n
        i = v + 1
        while i < len(tree):
            tree[i], i = tree[i] + 1, i + (i & -i)
    assert found.first().S == s


def test_mann_kendall_of_a_constant(spark):
    row = trend.mann_kendall(series(spark, [2, 2, 2]), "v", "year", ["season"]).first()
    assert (row.S, row.z, row.tau, row.p_value, row.significance) == (0, None, None, None, None)


def test_undefined_p_values(spark):
    rows = [("flat", x, 4.0) for x in range(30)] + [("two", 1, 1.1), ("two", 2, 2.3), ("one x", 1, 1.0)]
    rows += [("one x", 1, 2.0), ("one x", 1, 4.0), ("exact", 1, 1.0), ("exact", 2, 2.0), ("exact", 3, 3.0)]
    df = spark.createDataFrame(rows, "s string, x int, y double")
    got = {r.s: r for r in trend.linear_trend(df, "y", "x", ["s"]).collect()}
    assert (got["flat"].slope, got["flat"].p_value, got["flat"].r2) == (0.0, None, None)
    assert got["two"].slope == pytest.approx(1.2) and got["two"].p_value is None
    assert (got["one x"].slope, got["one x"].p_value, got["one x"].r2) == (None, None, None)
    assert (got["exact"].slope, got["exact"].p_value, got["exact"].r2) == (1.0, 0.0, 1.0)


@pytest.mark.parametrize("key", ["s", "n", "df", "t", "bit", "rank", "prefix", "one", "m", "slope", "group", "block"])
def test_group_columns_keep_their_values(spark, key):
    df = spark.createDataFrame([(7, y, float(y * y % 5)) for y in range(9)], f"{key} int, year int, v double")
    for found in (trend.linear_trend(df, "v", "year", [key]), trend.trend_line(df, "v", "year", [key], 3)):
        if key != "slope":
            assert {r[key] for r in found.collect()} == {7}
    if key != "n":
        assert {r[key] for r in trend.mann_kendall(df, "v", "year", [key]).collect()} == {7}
    assert {r[key] for r in bootstrap.bootstrap_ci(df, "v", [key], "sum", 5).collect()} == {7}


def test_bootstrap_of_a_constant(spark):
    df = spark.createDataFrame([("a", 2.0)] * 6, "g string, v double")
    row = bootstrap.bootstrap_ci(df, "v", ["g"], "sum", 50).first()
    assert (row.ci_lower, row.ci_upper) == (12.0, 12.0)


def test_bootstrap_needs_enough_finite_values(spark):
    rows = [("a", v) for v in (1.0, 2.0, 3.0, 4.0, None, float("nan"))] + [("b", float(i)) for i in range(5)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in bootstrap.bootstrap_ci(df, "v", ["g"], "mean", 50, min_n=5).collect()}
    assert (got["a"].ci_lower, got["a"].ci_upper) == (None, None)
    assert 0 <= got["b"].ci_lower < 2 < got["b"].ci_upper <= 4


def test_bootstrap_repeats_and_brackets_the_sum(spark):
    df = spark.range(400).selectExpr("'a' AS g", "id % 7 AS v")
    runs = [bootstrap.bootstrap_ci(df, "v", ["g"], "sum", 300, seed=7).first() for _ in range(2)]
    assert runs[0] == runs[1]
    total = sum(i % 7 for i in range(400))
    # 1.96 standard errors of a resampled sum of 400 values with deviation 2 are 78.
    assert runs[0].ci_lower == pytest.approx(total - 78, abs=15)
    assert runs[0].ci_upper == pytest.approx(total + 78, abs=15)


def resampled_means(values, group, replicates, seed, block_size):
    """The same draws by plain loops."""
    m1, m2 = bootstrap.MODULI
    a1, a2 = bootstrap.MULTIPLIERS
    values, out = sorted(values), []
    for replicate in range(replicates):
        drawn = []
        for block in range(0, (len(values) - 1) // block_size + 1):
            digest = hashlib.md5(f"{seed}|{group}|{replicate}|{block}".encode()).hexdigest()
            x1 = 1 + int(digest[:15], 16) % (m1 - 1)
            x2 = 1 + int(digest[16:31], 16) % (m2 - 1)
            for _ in range(min(block_size, len(values) - block * block_size)):
                pair = []
                for _ in range(2):
                    x1, x2 = x1 * a1 % m1, x2 * a2 % m2
                    pair.append((x1 - x2) % (m1 - 1))
                drawn.append(values[(pair[0] * (m1 - 1) + pair[1]) % len(values)])
        out.append(sum(drawn) / len(drawn))
    return out


@pytest.mark.parametrize("block_size", [8, 1024])
def test_bootstrap_against_plain_loops(spark, monkeypatch, block_size):
    monkeypatch.setattr(bootstrap, "BLOCK", block_size)
    df = spark.range(90).selectExpr("'a' AS g", "id % 4 AS v")
    row = bootstrap.bootstrap_ci(df, "v", ["g"], "mean", 70, seed=3).first()
    means = resampled_means([i % 4 for i in range(90)], "a", 70, 3, block_size)
    assert row.ci_lower == pytest.approx(np.quantile(means, 0.025), abs=1e-12)
    assert row.ci_upper == pytest.approx(np.quantile(means, 0.975), abs=1e-12)


def test_unknown_statistic(spark):
    with pytest.raises(ValueError):
        bootstrap.bootstrap_ci(spark.range(1), "id", [], "median")
