"""How often compound days occur: means, anomalies, totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Years = tuple[int, int]


def base_means(seasonal: DataFrame, years: Years) -> DataFrame:
    """Mean and standard deviation of seasonal counts over the base years."""
    return (
        seasonal.filter(F.col("year_season").between(*years))
        .groupBy("ID", "season")
        .agg(
            F.avg("cdh_count").alias("base_ave"),
            F.stddev_samp("cdh_count").alias("cdh_sd"),
        )
    )


def target_means(seasonal: DataFrame, years: Years) -> DataFrame:
    """Mean of seasonal counts over the target years."""
    return (
        seasonal.filter(F.col("year_season").between(*years))
        .groupBy("ID", "season")
        .agg(F.avg("cdh_count").alias("target_ave"))
    )


def count_means(seasonal: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean of seasonal counts over all years per group."""
    return seasonal.groupBy(*by).agg(F.avg("cdh_count").alias("cdh_ave"))


def recent_points(seasonal: DataFrame, years: Sequence[int], period: str) -> DataFrame:
    """Mean count of all stations in single season years, with text years for a legend."""
    return (
        count_means(seasonal.filter(F.col("year_season").isin(*years)), ["season", "year_season"])
        .withColumn("year_season", F.col("year_season").cast("string"))
        .withColumn("Period", F.lit(period))
    )


def period_comparison(
    base: DataFrame, target: DataFrame, base_label: str, target_label: str
) -> DataFrame:
    """Base and target means below each other with a period label."""
    first = base.withColumnRenamed("base_ave", "cdh_ave").withColumn("Period", F.lit(base_label))
    second = target.withColumnRenamed("target_ave", "cdh_ave").withColumn(
        "Period", F.lit(target_label)
    )
    return first.unionByName(second, allowMissingColumns=True).filter(
        F.col("cdh_ave").isNotNull()
    )


def standardised_anomaly(seasonal: DataFrame, base: Years, target: Years) -> DataFrame:
    """(target mean - base mean) / base deviation per station and season.

    Base and target means come from one shuffle. Groups without spread, without
    base years or without target years drop out.
    """
    in_base = F.col("year_season").between(*base)
    in_target = F.col("year_season").between(*target)
    means = seasonal.groupBy("ID", "season").agg(
        F.avg(F.when(in_base, F.col("cdh_count"))).alias("base_ave"),
        F.stddev_samp(F.when(in_base, F.col("cdh_count"))).alias("cdh_sd"),
        F.avg(F.when(in_target, F.col("cdh_count"))).alias("target_ave"),
    )
    return (
        means.filter(F.col("cdh_sd") != 0)
        .withColumn(
            "anomaly",
            F.try_divide(F.col("target_ave") - F.col("base_ave"), F.col("cdh_sd")),
        )
        .na.drop(how="any")
    )


def exceedance_counts(anomalies: DataFrame, limit: float = 2.0) -> DataFrame:
    """Stations per season whose anomaly is above ``limit``."""
    return (
        anomalies.filter(F.col("anomaly") > limit)
        .dropDuplicates(["ID", "season"])
        .groupBy("season")
        .agg(F.count("*").alias("n_gauge"))
    )


def exceedance_ratio(anomalies: DataFrame, limit: float = 2.0) -> DataFrame:
    """Share of stations per season whose anomaly is above ``limit``, in percent.

    Each station is reduced to one flag first, so no list of stations is gathered.
    """
    stations = anomalies.groupBy("season", "ID").agg(
        F.coalesce(F.bool_or(F.col("anomaly") > limit), F.lit(False)).alias("above")
    )
    return (
        stations.groupBy("season")
        .agg(
            F.count("*").alias("total_gauge"),
            F.count_if("above").alias("n_anom_gt2"),
        )
        .withColumn("ratio_pct", 100.0 * F.col("n_anom_gt2") / F.col("total_gauge"))
    )


def regional_totals(counts: DataFrame, count: str = "cdh_count") -> DataFrame:
    """Sum over all stations per season year and season."""
    return counts.groupBy("year_season", "season").agg(F.sum(count).alias("total_cphw"))


def value_limits(df: DataFrame, value: str) -> DataFrame:
    """Smallest, largest and largest absolute value, for a shared scale."""
    return df.agg(
        F.min(value).alias("low"),
        F.max(value).alias("high"),
        F.max(F.abs(F.col(value))).alias("max_abs"),
    )
