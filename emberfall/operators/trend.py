"""Trends of seasonal series: least squares and Mann-Kendall.

A series holds one row per group and time step, so a group is as long as the
record has years.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberfall.functions.labels import significance
from emberfall.functions.special import normal_two_sided, student_quantile, student_two_sided
from emberfall.workspace import materialise


def _fit(df: DataFrame, y: str, x: str, by: Sequence[str]) -> DataFrame:
    """Sums of one fit per group; inner columns start with an underscore, so that group
    columns may have any other name."""
    complete = df.filter(F.col(y).isNotNull() & F.col(x).isNotNull())
    sums = complete.groupBy(*by).agg(
        F.count("*").alias("_n"),
        F.regr_slope(y, x).alias("_slope"),
        F.regr_intercept(y, x).alias("_intercept"),
        F.regr_r2(y, x).alias("_r2"),
        F.regr_sxx(y, x).alias("_sxx"),
        F.regr_syy(y, x).alias("_syy"),
        F.greatest(
            F.lit(0.0),
            F.regr_syy(y, x) - F.regr_slope(y, x) * F.regr_sxy(y, x),
        ).alias("_sse"),
        F.avg(x).alias("_x_mean"),
        F.min(x).alias("_x_low"),
        F.max(x).alias("_x_high"),
    )
    return sums.withColumn("_df", (F.col("_n") - 2).cast("int")).withColumn(
        "_s", F.sqrt(F.when(F.col("_df") > 0, F.col("_sse") / F.col("_df")))
    )


def linear_trend(df: DataFrame, y: str, x: str, by: Sequence[str]) -> DataFrame:
    """Slope, intercept, two-sided p-value of the slope and R squared per group.

    A flat series has no p-value and no R squared (both NULL), nor has one of fewer than
    three points a p-value; with a single x there is no slope either.
    """
    error = F.col("_s") / F.sqrt("_sxx")
    t = F.try_divide(F.col("_slope"), error)
    varied = (F.col("_sxx") > 0) & (F.col("_syy") > 0)
    p = F.when(varied & (F.col("_df") >= 1), F.when(F.col("_sse") == 0, F.lit(0.0)).otherwise(
        student_two_sided(t, F.col("_df"))
    ))
    return _fit(df, y, x, by).select(
        *by,
        F.col("_slope").alias("slope"),
        F.col("_intercept").alias("intercept"),
        p.alias("p_value"),
        F.when(varied, F.col("_r2")).alias("r2"),
    )


def trend_line(
    df: DataFrame, y: str, x: str, by: Sequence[str], points: int = 80, level: float = 0.95
) -> DataFrame:
    """Fitted line on an even grid over the x range, with the confidence band of the mean."""
    fit = _fit(df, y, x, by).withColumn("_t", student_quantile(level, F.col("_df")))
    step = (F.col("_x_high") - F.col("_x_low")) / (points - 1)
    grid = fit.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn(
        "_x", F.col("_x_low") + F.col("_i") * step
    )
    offset = F.col("_x") - F.col("_x_mean")
    spread = F.sqrt(1 / F.col("_n") + F.try_divide(offset * offset, F.col("_sxx")))
    half = F.col("_t") * F.col("_s") * spread
    line = F.col("_intercept") + F.col("_slope") * F.col("_x")
    return grid.select(
        *by,
        F.col("_i").alias("i"),
        F.col("_x").alias("x"),
        line.alias("fit"),
        (line - half).alias("lower"),
        (line + half).alias("upper"),
    )


def _later_minus_lower(values: np.ndarray) -> int:
    """Sum of sign(later - earlier) over all pairs of a sequence.

    Two values compare at the highest bit in which their ranks differ: among those equal
    above that bit, each counts the earlier ones with the other bit.
    """
    rank = np.unique(values, return_inverse=True)[1]
    total = 0
    for bit in range(int(rank.max(initial=0)).bit_length()):
        above = rank >> (bit + 1)
        order = np.argsort(above, kind="stable")
        one = (rank[order] >> bit) & 1
        starts = np.flatnonzero(np.diff(above[order], prepend=-1))
        sizes = np.diff(np.append(starts, len(rank)))
        ones = np.cumsum(one) - one
        ones -= np.repeat(ones[starts], sizes)
        zeros = np.arange(len(rank)) - np.repeat(starts, sizes) - ones
        total += int(np.where(one == 1, zeros, -ones).sum())
    return total


def _of_groups(by: list[str], work: Callable[[tuple, pd.DataFrame], pd.DataFrame]):
    """Apply ``work`` to each group of a partition that is sorted by group."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, parts = None, []
        for batch in batches:
            for key, rows in batch.groupby(by, sort=False, dropna=False):
                # NULL is no equal of itself: keys are compared as text.
                if parts and str(key) != str(held):
                    yield work(held, pd.concat(parts))
                    parts = []
                held = key
                parts.append(rows)
        if parts:
            yield work(held, pd.concat(parts))

    return run


def mann_kendall(series: DataFrame, y: str, t: str, by: Sequence[str]) -> DataFrame:
    """S, its tie-corrected variance, z with continuity correction, tau and p per group.

    No pairs of rows are formed. Rows are cut into ranges of time, and pairs within one are
    counted there, in n log n; then into ranges of value, where pairs of one value range and
    different times are. What is left are pairs that differ in both ranges: they are counted
    from how many rows each pair of ranges holds. Every row moves once for either cut, and a
    task holds one range of a group.

    A series has one row per time step. A constant series has no z, tau, p-value or
    significance.
    """
    by = list(by)
    rows = series.filter(F.col(y).isNotNull() & F.col(t).isNotNull()).select(
        *by, F.col(y).cast("double").alias("_y"), F.col(t).alias("_time")
    )
    kept = rows.schema.fields
    timed = rows.repartitionByRange(*by, "_time").sortWithinPartitions(*by, "_time").withColumn("_at", F.spark_partition_id())

    def within(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        gain = np.zeros(len(part), np.int64)
        gain[0] = _later_minus_lower(part["_y"].to_numpy())
        return part.assign(_gain=gain)

    schema = T.StructType([*kept, T.StructField("_at", T.IntegerType()), T.StructField("_gain", T.LongType())])
    timed = materialise(timed.mapInPandas(_of_groups(by, within), schema), "time-ranges")
    valued = timed.repartitionByRange(*by, "_y").sortWithinPartitions(*by, "_y").withColumn("_block", F.spark_partition_id())

    def between(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["_at", "_y"], kind="stable")
        values, at = part["_y"].to_numpy(), part["_at"].to_numpy()
        starts = np.flatnonzero(np.diff(at, prepend=-1))
        sizes = np.diff(np.append(starts, len(at)))
        gain = int(part["_gain"].sum()) + _later_minus_lower(values)
        gain -= sum(_later_minus_lower(v) for v in np.split(values, starts[1:]))
        m = np.unique(values, return_counts=True)[1].astype(np.float64)
        # One row per time range; what belongs to the whole block stands in its first.
        out = pd.concat([part[by].iloc[:1]] * len(starts), ignore_index=True)
        first = np.arange(len(starts)) == 0
        out["_at"], out["_block"], out["_rows"] = at[starts], part["_block"].iloc[0], sizes
        out["_gain"] = np.where(first, gain, 0)
        out["_tie_variance"] = np.where(first, (m * (m - 1) * (2 * m + 5)).sum(), 0.0)
        out["_tie_pairs"] = np.where(first, (m * (m - 1) / 2).sum(), 0.0)
        return out

    cells = T.StructType(
        [
            *kept[: len(by)],
            T.StructField("_at", T.IntegerType()),
            T.StructField("_block", T.IntegerType()),
            T.StructField("_rows", T.LongType()),
            T.StructField("_gain", T.LongType()),
            T.StructField("_tie_variance", T.DoubleType()),
            T.StructField("_tie_pairs", T.DoubleType()),
        ]
    )
    counted = materialise(valued.mapInPandas(_of_groups(by, between), cells), "range-cells")
    # Rows of earlier times by block of values, on a full grid of a group's ranges; then those
    # of lower blocks less those of higher ones.
    wide = counted.groupBy(*by).agg(
        F.collect_set("_at").alias("_ats"), F.collect_set("_block").alias("_blocks")
    ).filter("size(_ats) > 1 AND size(_blocks) > 1")
    grid = wide.select(*by, F.explode("_ats").alias("_at"), "_blocks").select(*by, "_at", F.explode("_blocks").alias("_block"))
    # Unions, not joins: a group may be NULL.
    grid = grid.withColumn("_rows", F.lit(0).cast("long")).unionByName(counted.select(*by, "_at", "_block", "_rows"))
    grid = grid.groupBy(*by, "_at", "_block").agg(F.sum("_rows").alias("_rows"))
    earlier = Window.partitionBy(*by, "_block").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.withColumn("_past", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    along = Window.partitionBy(*by, "_at").orderBy("_block")
    lower = F.coalesce(F.sum("_past").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    higher = F.coalesce(F.sum("_past").over(along.rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    crossed = grid.select(*by, (F.col("_rows") * (lower - higher)).alias("_gain"))
    sizes = counted.unionByName(crossed, allowMissingColumns=True).groupBy(*by).agg(
        F.sum("_rows").alias("_n"),
        F.sum("_gain").alias("_gained"),
        F.sum("_tie_variance").alias("_tie_variance"),
        F.sum("_tie_pairs").alias("_tie_pairs"),
    )
    n = F.col("_n")
    pairs = n * (n - 1) / 2
    table = sizes.select(
        *by,
        "_n",
        F.col("_gained").alias("_s"),
        ((n * (n - 1) * (2 * n + 5) - F.col("_tie_variance")) / 18).alias("_variance"),
        F.sqrt(pairs * (pairs - F.col("_tie_pairs"))).alias("_tau_scale"),
    )
    z = F.try_divide(F.col("_s") - F.signum("_s"), F.sqrt("_variance"))
    tested = table.withColumn("_z", z).withColumn("_p", normal_two_sided(F.col("_z")))
    return tested.select(
        *by,
        F.col("_n").alias("n"),
        F.col("_s").alias("S"),
        F.col("_variance").alias("varS"),
        F.col("_z").alias("z"),
        F.try_divide(F.col("_s"), F.col("_tau_scale")).alias("tau"),
        F.col("_p").alias("p_value"),
        significance(F.col("_p")).alias("significance"),
    )
