"""Heat followed by heavy rain: day flags, coincidence rates, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberfall.functions.calendar import season_of, season_year
from emberfall.operators.rows import (
    CHUNK_ROWS,
    chunk_window,
    coincides_within,
    forward_max,
    home_rows,
    lay_chunks,
    spread_chunks,
    with_min_run,
)
from emberfall.operators.thresholds import chunk_thresholds


def coincidence_flags(
    numbered: DataFrame,
    event_x: str,
    event_y: str,
    max_lag: int = 7,
    name: str = "coincides",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add ``name`` (0/1): ``event_x`` holds and ``event_y`` follows in 1 to
    ``max_lag`` rows of the same station and year. A row counts once."""
    spread = spread_chunks(numbered, halo=max_lag, chunk_rows=chunk_rows)
    follows = coincides_within(F.col(event_y), max_lag, chunk_window(), F.col("year"))
    flag = F.coalesce(F.col(event_x), F.lit(False)) & follows
    return home_rows(spread.withColumn(name, flag.cast("int")))


def coincidence_rate(
    flagged: DataFrame, event_x: str, flag: str, by: list[str]
) -> DataFrame:
    """Events, coincidences and their ratio per group; NULL ratio without events."""
    events = F.coalesce(F.sum(F.col(event_x).cast("int")), F.lit(0))
    hits = F.coalesce(F.sum(flag), F.lit(0))
    return (
        flagged.groupBy(*by)
        .agg(events.alias("events"), hits.alias("coincidences"))
        .withColumn("ecr", F.try_divide(F.col("coincidences"), F.col("events")))
    )


def flag_days(
    numbered: DataFrame,
    hot: DataFrame,
    wet: DataFrame,
    min_run: int = 2,
    max_lag: int = 7,
    rows_ahead: int = 7,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Every station day with thresholds, heatwave and compound flags.

    ``numbered``: numbered rows, or rows laid in chunks with a halo as wide as the widest
    window. ``rain_ahead`` is the largest rain of the day and the ``rows_ahead`` rows after
    it, across year ends. The thresholds, the runs, the lag and the maximum take the chunks
    as they lie.
    """
    window = chunk_window()
    chunks = lay_chunks(numbered, max(max_lag, rows_ahead, min_run - 1), chunk_rows)
    days = chunks.join(chunk_thresholds(chunks, hot, wet), ["ID", "chunk"], "left")
    days = days.withColumn("hw_thrsld", F.get("hot_by_day", F.col("jdate") - 1)).drop("hot_by_day")
    spread = days.withColumn("hot", F.col("TA") > F.col("hw_thrsld")).withColumn(
        "heavy", F.col("RN") > F.col("pl_thrsld")
    )
    spread = with_min_run(spread, "hot", min_run, "heatwave", window)
    follows = coincides_within(F.col("heavy"), max_lag, window, F.col("year"))
    flagged = spread.withColumn(
        "hw_pluvial", (F.col("heatwave") & follows).cast("int")
    ).withColumn("rain_ahead", forward_max(F.col("RN"), rows_ahead, window))
    return home_rows(flagged).select(
        "ID",
        "date",
        "TA",
        "RN",
        "jdate",
        "year",
        "month",
        "row_no",
        "hw_thrsld",
        "heatwave",
        "pl_thrsld",
        F.coalesce(F.col("heavy"), F.lit(False)).cast("int").alias("extreme_precip"),
        "hw_pluvial",
        "rain_ahead",
    )


def with_station_year_rate(fact: DataFrame) -> DataFrame:
    """Put the rate of its station and year on every day.

    The rates are a small aggregate joined back, so a station year is combined
    before it is shuffled.
    """
    rates = coincidence_rate(fact, "heatwave", "hw_pluvial", ["ID", "year"])
    return fact.join(rates.select("ID", "year", "ecr"), ["ID", "year"], "left")


def monthly_counts(fact: DataFrame) -> DataFrame:
    """Compound days per station, year and month; months without any are kept."""
    return fact.groupBy("ID", "year", "month").agg(
        F.coalesce(F.sum("hw_pluvial"), F.lit(0)).alias("num_coincidence")
    )


def with_season(df: DataFrame, year: Column | None = None, month: Column | None = None) -> DataFrame:
    """Add ``season`` and ``year_season`` from year and month columns."""
    year = F.col("year") if year is None else year
    month = F.col("month") if month is None else month
    return df.withColumn("season", season_of(month)).withColumn(
        "year_season", season_year(year, month)
    )


def seasonal_counts(monthly: DataFrame) -> DataFrame:
    """Compound days per station and season year.

    ``n_months`` tells how many months stand behind a season: the first winter has
    no December, the last may have nothing else.
    """
    return (
        with_season(monthly)
        .groupBy("ID", "year_season", "season")
        .agg(F.sum("num_coincidence").alias("cdh_count"), F.count("*").alias("n_months"))
    )
