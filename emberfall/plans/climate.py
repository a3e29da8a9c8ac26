"""Observations to the compound-day table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from emberfall.operators.coincidence import (
    coincidence_rate,
    flag_days,
    monthly_counts,
    seasonal_counts,
    with_station_year_rate,
)
from emberfall.operators.rows import home_rows, land_observations, lay_chunks, number_rows
from emberfall.operators.thresholds import hot_thresholds, wet_thresholds
from emberfall.plans.settings import STANDARD, Settings
from emberfall.sources.stations import with_coordinates
from emberfall.workspace import materialise, materialise_together


@dataclass(frozen=True)
class Thresholds:
    """Observations of the eligible stations in chunks, and their thresholds."""

    chunks: DataFrame
    hot: DataFrame
    wet: DataFrame


def number_observations(obs: DataFrame, settings: Settings = STANDARD) -> DataFrame:
    """Land observations and number the rows of the eligible stations."""
    return number_rows(land_observations(obs), settings.first_year_max)


def derive_thresholds(obs: DataFrame, settings: Settings = STANDARD) -> Thresholds:
    """Both thresholds, written so that their joins are sized from files."""
    halo = max(settings.rolling_rows // 2, settings.max_lag, settings.rows_ahead, settings.min_run - 1)
    chunks = lay_chunks(number_observations(obs, settings), halo)
    hot = hot_thresholds(
        chunks, settings.climatology, settings.hot_quantile, settings.rolling_rows
    )
    wet = wet_thresholds(home_rows(chunks), settings.climatology, settings.wet_quantile)
    hot, wet = materialise_together(hot=hot, wet=wet)
    return Thresholds(chunks, hot, wet)


def flagged_days(obs: DataFrame, settings: Settings = STANDARD) -> DataFrame:
    """All station days with their flags, not yet written."""
    t = derive_thresholds(obs, settings)
    return flag_days(
        t.chunks, t.hot, t.wet, settings.min_run, settings.max_lag, settings.rows_ahead
    )


def compound_days(obs: DataFrame, settings: Settings = STANDARD) -> DataFrame:
    """All station days with their flags, written once for the aggregates above it."""
    return materialise(flagged_days(obs, settings), "days")


def climate_fact(days: DataFrame, stations: DataFrame) -> DataFrame:
    """The fact with station-year rate and coordinates."""
    return with_coordinates(with_station_year_rate(days), stations)


def station_year_rates(obs: DataFrame, settings: Settings = STANDARD) -> DataFrame:
    """Heatwave days, compound days and their ratio per station and year."""
    return coincidence_rate(
        flagged_days(obs, settings), "heatwave", "hw_pluvial", ["ID", "year"]
    )


def season_counts(obs: DataFrame, settings: Settings = STANDARD) -> DataFrame:
    """Seasonal counts per station, the start of all frequency reports."""
    return seasonal_counts(monthly_counts(flagged_days(obs, settings)))
