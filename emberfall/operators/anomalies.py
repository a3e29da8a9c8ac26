"""Season years measured against a baseline: z-scores, ranks, return periods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberfall.functions.labels import rank_label
from emberfall.functions.special import normal_cdf


def baseline_stats(series: DataFrame, value: str, years: tuple[int, int]) -> DataFrame:
    """Mean and standard deviation per season over the baseline years."""
    return (
        series.filter(F.col("year_season").between(*years))
        .groupBy("season")
        .agg(F.avg(value).alias("mu"), F.stddev_samp(value).alias("sigma"))
    )


def ecdf_rank(series: DataFrame, value: str, years: tuple[int, int], year: int) -> DataFrame:
    """Share of baseline years at or below the value of ``year``, and whether it is a record."""
    target = series.filter(F.col("year_season") == year).select(
        "season", F.col(value).alias("_target")
    )
    base = series.filter(F.col("year_season").between(*years))
    return (
        base.join(target, "season", "left")
        .groupBy("season")
        .agg(
            (100 * F.avg((F.col(value) <= F.col("_target")).cast("double"))).alias("P_value"),
            (F.max("_target") >= F.max(value)).alias("Is_Record"),
        )
    )


def season_anomaly_table(
    series: DataFrame, value: str, years: tuple[int, int], year: int
) -> DataFrame:
    """One row per season of ``year``: total, baseline, z-score, rank and record status."""
    target = series.filter(F.col("year_season") == year).select(
        "season", F.col(value).alias("target_total")
    )
    return (
        target.join(baseline_stats(series, value, years), "season", "left")
        .join(ecdf_rank(series, value, years, year), "season", "left")
        .select(
            "season",
            "target_total",
            "mu",
            "sigma",
            F.try_divide(F.col("target_total") - F.col("mu"), F.col("sigma")).alias("Z_score"),
            "P_value",
            rank_label(F.col("P_value"), F.col("Is_Record")).alias("Record_Status"),
        )
    )


def return_periods(series: DataFrame, value: str, last_baseline_year: int) -> DataFrame:
    """z-score and normal return period of every season year after the baseline."""
    base = (
        series.filter(F.col("year_season") <= last_baseline_year)
        .groupBy("season")
        .agg(F.avg(value).alias("mu"), F.stddev_samp(value).alias("sigma"))
    )
    z = F.try_divide(F.col("obs_intensity") - F.col("mu"), F.col("sigma"))
    return (
        series.filter(F.col("year_season") > last_baseline_year)
        .select("year_season", "season", F.col(value).alias("obs_intensity"))
        .join(base, "season", "left")
        .withColumn("Z_score", z)
        .withColumn("Return_Period", F.try_divide(F.lit(1.0), 1 - normal_cdf(F.col("Z_score"))))
    )
