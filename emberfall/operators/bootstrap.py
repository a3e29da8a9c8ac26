"""Repeatable bootstrap confidence intervals.

Every replicate of a group draws from its own random stream, seeded by a hash of
(seed, group, replicate, block), so a lost task draws the same again. Values are
numbered within their group, blocks of replicates and of draws are spread over all tasks
before they are expanded, and both meet in an equi-join on group and number: a hot group is
spread like any other.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberfall.functions.measures import is_finite
from emberfall.operators.ranks import value_positions
from emberfall.workspace import materialise

# Draws of one seed, and copies of a repeated value, expanded from one row.
BLOCK = 1024
# Replicates expanded from one row.
REPLICATE_BLOCK = 64
# One md5 gives two seeds of 15 hexadecimal digits each.
HEX_DIGITS = 15
# Moduli and multipliers of L'Ecuyer's combined generator (1988).
MODULI = (2147483563, 2147483399)
MULTIPLIERS = (40014, 40692)
OUTPUTS = MODULI[0] - 1


def _blocks(count: Column, size: int) -> Column:
    """0 to the number of the last block of ``count`` items."""
    return F.sequence(F.lit(0), F.floor((count - 1) / size))


def _items(count: Column, block: Column, size: int) -> Column:
    """Item numbers of one block."""
    first = block * size
    return F.sequence(first, F.least(first + size - 1, count - 1))


def _jumps(draws: int) -> Column:
    """For each draw, the powers that take both generators to its two outputs."""
    steps, state = [], [1, 1]
    for _ in range(draws):
        jump = []
        for _ in range(2):
            state = [x * a % m for x, a, m in zip(state, MULTIPLIERS, MODULI)]
            jump += state
        steps.append(jump)
    names = ("a_1", "a_2", "b_1", "b_2")
    rows = [dict(zip(names, jump)) for jump in steps]
    kind = ", ".join(f"{name}: bigint" for name in names)
    return F.from_json(F.lit(json.dumps(rows)), f"array<struct<{kind}>>")


def _seed(digest: Column, start: int, modulus: int) -> Column:
    part = F.conv(F.substring(digest, start, HEX_DIGITS), 16, 10).cast("bigint")
    return 1 + F.pmod(part, F.lit(modulus - 1))


def _output(jump: str) -> Column:
    one = F.col("seed_1") * F.col(f"{jump}_1") % MODULI[0]
    two = F.col("seed_2") * F.col(f"{jump}_2") % MODULI[1]
    return (one - two + OUTPUTS) % OUTPUTS


def _draws(groups: DataFrame, by: list[str], replicates: int, seed: int) -> DataFrame:
    """One row per draw: group number, replicate, number of the value drawn."""
    total = F.lit(replicates)
    plan = groups.withColumn("_part", F.explode(_blocks(total, REPLICATE_BLOCK)))
    plan = plan.withColumn("_block", F.explode(_blocks(F.col("_n"), BLOCK)))
    # A fixed number: adaptive coalescing would judge the few rows before they expand.
    tasks = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plan = plan.repartition(tasks, "_group", "_part", "_block")
    plan = plan.withColumn(
        "_replicate", F.explode(_items(total, F.col("_part"), REPLICATE_BLOCK))
    )
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *by, "_replicate", "_block"))
    plan = plan.withColumn("_digest", digest).select(
        "_group",
        "_n",
        "_replicate",
        F.least(F.col("_n") - F.col("_block") * BLOCK, F.lit(BLOCK)).cast("int").alias("_items"),
        _seed(F.col("_digest"), 1, MODULI[0]).alias("seed_1"),
        _seed(F.col("_digest"), 17, MODULI[1]).alias("seed_2"),
    )
    drawn = plan.select(
        "_group",
        "_n",
        "_replicate",
        "seed_1",
        "seed_2",
        F.inline(F.slice(_jumps(BLOCK), F.lit(1), F.col("_items"))),
    )
    pick = (_output("a") * OUTPUTS + _output("b")) % F.col("_n")
    return drawn.select("_group", "_replicate", pick.alias("_pick"))


def bootstrap_ci(
    df: DataFrame,
    value: str,
    by: Sequence[str],
    stat: str = "sum",
    replicates: int = 10_000,
    seed: int = 42,
    min_n: int = 1,
    level: float = 0.95,
) -> DataFrame:
    """Percentile interval of the resampled sum or mean per group.

    Groups with fewer than ``min_n`` finite values get NULL bounds.
    """
    if stat not in ("sum", "mean"):
        raise ValueError(f"stat must be 'sum' or 'mean', not {stat!r}")
    by = list(by)
    usable = df.select(*by, F.when(is_finite(F.col(value)), F.col(value)).alias("_value"))
    positions = value_positions(usable, "_value", by)
    sizes = positions.groupBy(*by).agg(F.max("n_group").alias("_n")).filter(F.col("_n") >= min_n)
    # Any number that is a group's own, written down before it is used twice.
    groups = materialise(sizes.withColumn("_group", F.monotonically_increasing_id()), "groups")
    copies = positions.join(groups.select(*by, "_group"), by)
    copies = copies.withColumn("_block", F.explode(_blocks(F.col("n_equal"), BLOCK)))
    copies = copies.withColumn("_copy", F.explode(_items(F.col("n_equal"), F.col("_block"), BLOCK)))
    values = copies.select("_group", (F.col("n_less") + F.col("_copy")).alias("_pick"), "_value")
    values = materialise(values, "values")

    # Every number drawn exists, so left is inner; but of a left join only the values can be
    # broadcast, and their size is known from their files. The draws look small to the
    # planner, which sizes them by the few rows they expand from.
    drawn = _draws(groups, by, replicates, seed).join(values, ["_group", "_pick"], "left")
    summary = F.sum("_value") if stat == "sum" else F.avg("_value")
    resampled = drawn.groupBy("_group", "_replicate").agg(summary.cast("double").alias("_stat"))
    tail = (1 - level) / 2
    bounds = resampled.groupBy("_group").agg(
        F.percentile("_stat", F.array(F.lit(tail), F.lit(1 - tail))).alias("_bounds")
    )
    intervals = groups.join(bounds, "_group").select(
        *by,
        F.col("_bounds")[0].alias("ci_lower"),
        F.col("_bounds")[1].alias("ci_upper"),
    )
    return df.select(*by).distinct().join(intervals, by, "left")


def with_interval(series: DataFrame, intervals: DataFrame) -> DataFrame:
    """Put the interval of its season year beside every value of a series."""
    return series.join(intervals, ["year_season", "season"], "left")
