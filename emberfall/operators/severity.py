"""Severity of compound days and its aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberfall.functions.measures import (
    cut_bins,
    event_intensity,
    relative_anomaly,
    relative_excess,
)
from emberfall.operators.coincidence import with_season
from emberfall.operators.ranks import (
    RankTable,
    attach_percent_rank,
    exact_quantiles,
    percent_rank_tables,
)

# Fixed percentile breaks of the intensity matrix.
MATRIX_BREAKS = (50, 60, 70, 80, 90, 100)


def with_forward_percentile(
    df: DataFrame, rain_ranks: RankTable, by: Sequence[str] = ()
) -> DataFrame:
    """Add ``Pmax_7day``, the largest rain percentile of the rows ahead.

    A percentile never falls with rain, so the largest percentile ahead is the
    percentile of the largest rain ahead: one lookup instead of ranking every day
    before the window.
    """
    return attach_percent_rank(df, rain_ranks, "rain_ahead", "Pmax_7day", by)


def severity_events(days: DataFrame) -> DataFrame:
    """Compound days with pooled percentiles, intensity and relative measures.

    The percentiles rank over all days of all stations. Only compound days are
    joined to the rank tables.
    """
    ranks = percent_rank_tables(days, ["TA", "RN"])
    events = days.filter(F.col("hw_pluvial") == 1).select(
        "ID", "date", "TA", "RN", "hw_thrsld", "pl_thrsld", "rain_ahead", "year", "month"
    )
    events = attach_percent_rank(events, ranks["TA"], "TA", "Tmax_percentile")
    events = with_forward_percentile(events, ranks["RN"])
    return with_season(events).select(
        "ID",
        "date",
        "TA",
        "RN",
        "Pmax_7day",
        "hw_thrsld",
        "pl_thrsld",
        relative_excess(F.col("Pmax_7day"), F.col("pl_thrsld")).alias("P_excess_rel"),
        relative_anomaly(F.col("TA"), F.col("hw_thrsld")).alias("T_anom_rel"),
        "Tmax_percentile",
        event_intensity(F.col("Tmax_percentile"), F.col("Pmax_7day")).alias("intensity"),
        "year",
        "month",
        "season",
        "year_season",
    )


def same_day_events(days: DataFrame, breaks: Sequence[float] = MATRIX_BREAKS) -> DataFrame:
    """Compound days with percentiles per station of the day's own heat and rain, binned."""
    keep = days.select("ID", "date", "TA", "RN", "year", "hw_pluvial")
    ranks = percent_rank_tables(keep, ["TA", "RN"], ["ID"])
    events = keep.filter(F.col("hw_pluvial") == 1).drop("hw_pluvial")
    events = attach_percent_rank(events, ranks["TA"], "TA", "Tmax_percentile", ["ID"])
    events = attach_percent_rank(events, ranks["RN"], "RN", "P_percentile", ["ID"])
    return events.withColumn("Tmax_bin", cut_bins(F.col("Tmax_percentile"), breaks)).withColumn(
        "P_bin", cut_bins(F.col("P_percentile"), breaks)
    )


def with_percentiles(days: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Every day with its heat and rain percentile, over all rows or per group."""
    ranks = percent_rank_tables(days, ["TA", "RN"], by)
    ranked = attach_percent_rank(days, ranks["TA"], "TA", "Tmax_percentile", by)
    return attach_percent_rank(ranked, ranks["RN"], "RN", "P_percentile", by)


def station_percent_ranks(days: DataFrame) -> DataFrame:
    """Every day with its heat and rain percentile within the station."""
    return with_percentiles(days, ["ID"])


def pooled_percent_ranks(days: DataFrame) -> DataFrame:
    """Every day with its heat and rain percentile over all stations."""
    return with_percentiles(days)


def _binned(events: DataFrame) -> DataFrame:
    return events.filter(F.col("Tmax_bin").isNotNull() & F.col("P_bin").isNotNull())


def intensity_matrix(events: DataFrame) -> DataFrame:
    """Mean same-day intensity per pair of percentile bins; the label rounds half to even."""
    intensity = event_intensity(F.col("Tmax_percentile"), F.col("P_percentile"))
    return (
        _binned(events)
        .groupBy("P_bin", "Tmax_bin")
        .agg(F.avg(intensity).alias("compound_intensity"))
        .withColumn("label", F.bround("compound_intensity", 2))
    )


def matrix_stations(events: DataFrame, matrix: DataFrame) -> DataFrame:
    """Distinct bin pairs of every station with the matrix cell they fall in."""
    pairs = _binned(events).select("ID", "Long", "Lat", "Tmax_bin", "P_bin").distinct()
    return pairs.join(matrix, ["Tmax_bin", "P_bin"], "left")


def severity_profile(events: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean, largest and summed intensity and the number of days with positive intensity."""
    return (
        events.filter(F.col("intensity") > 0)
        .groupBy(*by)
        .agg(
            F.avg("intensity").alias("mean_intensity"),
            F.max("intensity").alias("max_intensity"),
            F.sum("intensity").alias("sum_intensity"),
            F.count("*").alias("freq"),
        )
    )


def severity_medians(events: DataFrame, by: Sequence[str]) -> DataFrame:
    """Median of positive intensities per group."""
    positive = events.filter(F.col("intensity") > 0)
    return exact_quantiles(positive, "intensity", {"median_intensity": 0.5}, by).drop("n")


def mean_intensity(events: DataFrame, by: Sequence[str], where: Column, name: str) -> DataFrame:
    """Mean intensity per group over the rows that satisfy ``where``."""
    return events.filter(where).groupBy(*by).agg(F.avg("intensity").alias(name))


def severity_anomaly(
    events: DataFrame, by: Sequence[str], recent: Column, base: Column
) -> DataFrame:
    """Recent minus base mean intensity, for the groups that have recent rows.

    Both means come from one pass: every base group without recent rows drops out,
    as it would in a left join from the recent side.
    """
    means = events.groupBy(*by).agg(
        F.count_if(recent).alias("recent_days"),
        F.avg(F.when(recent, F.col("intensity"))).alias("recent_mean"),
        F.avg(F.when(base, F.col("intensity"))).alias("base_mean"),
    )
    return (
        means.filter(F.col("recent_days") > 0)
        .drop("recent_days")
        .withColumn("anomaly", F.col("recent_mean") - F.col("base_mean"))
    )


def severity_series_median(events: DataFrame) -> DataFrame:
    """Median intensity of all stations per season year and season."""
    by = ["year_season", "season"]
    return exact_quantiles(events, "intensity", {"mean_intensity": 0.5}, by).drop("n")


def severity_series_mean(events: DataFrame) -> DataFrame:
    """Mean intensity of all stations per season year and season."""
    return events.groupBy("year_season", "season").agg(
        F.avg("intensity").alias("mean_intensity")
    )


def station_season_medians(events: DataFrame) -> DataFrame:
    """Median intensity per station, season year and season; a group is one season's days."""
    return (
        events.groupBy("ID", "year_season", "season")
        .agg(F.median("intensity").alias("annual_mean_intensity"))
        .filter(F.col("annual_mean_intensity").isNotNull())
    )


def mean_of_medians(medians: DataFrame) -> DataFrame:
    """Mean of the yearly medians per station and season."""
    return medians.groupBy("ID", "season").agg(
        F.avg("annual_mean_intensity").alias("intensity_ave")
    )
