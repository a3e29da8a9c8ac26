"""Thresholds of a station: hot by day of year, heavy rain over wet days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberfall.operators.rows import (
    CHUNK_ROWS,
    chunk_window,
    home_rows,
    rolling_mean,
    spread_chunks,
)

# Thresholds are compared with ">" after averaging; this many decimals keep a
# last-bit difference of the average from deciding a comparison.
THRESHOLD_DECIMALS = 9
# Fixed value: days of the longest year.
DAYS = 366


def rolling_temperature(
    numbered: DataFrame, rows: int = 15, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Add ``roll_temp``, the centred rolling mean of TA over ``rows`` rows.

    ``numbered``: numbered rows, or rows laid in chunks with a halo of half as many.
    """
    laid = "chunk" in numbered.columns
    spread = numbered if laid else spread_chunks(numbered, halo=rows // 2, chunk_rows=chunk_rows)
    return home_rows(
        spread.withColumn("roll_temp", rolling_mean(F.col("TA"), rows, chunk_window()))
    )


def hot_thresholds(
    numbered: DataFrame,
    years: tuple[int, int] = (1991, 2020),
    quantile: float = 0.90,
    rows: int = 15,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Quantile of the rolling mean per (ID, jdate); ``n`` is the sample behind it.

    The years are selected after the rolling mean, whose frame may reach outside
    them. A group holds one value per year at most, so ``percentile`` stays small.
    """
    columns = [c for c in ("ID", "year", "jdate", "TA", "row_no", "chunk", "is_home") if c in numbered.columns]
    rolled = rolling_temperature(numbered.select(*columns), rows, chunk_rows)
    return (
        rolled.filter(F.col("year").between(*years))
        .groupBy("ID", "jdate")
        .agg(
            F.round(F.percentile("roll_temp", F.lit(quantile)), THRESHOLD_DECIMALS).alias(
                "hw_thrsld"
            ),
            F.count("roll_temp").alias("n"),
        )
    )


def wet_thresholds(
    days: DataFrame, years: tuple[int, int] = (1991, 2020), quantile: float = 0.95
) -> DataFrame:
    """Quantile of rain over wet days per station.

    Equal depths are counted before the shuffle; a station contributes at most one
    day per date of the window.
    """
    wet = days.filter((F.col("RN") > 0) & F.col("year").between(*years))
    depths = wet.groupBy("ID", "RN").agg(F.count("*").alias("times"))
    return depths.groupBy("ID").agg(
        F.round(
            F.percentile("RN", F.lit(quantile), F.col("times")), THRESHOLD_DECIMALS
        ).alias("pl_thrsld")
    )


def chunk_thresholds(chunks: DataFrame, hot: DataFrame, wet: DataFrame) -> DataFrame:
    """Both thresholds of a station beside each of its chunks: ``hot_by_day``, an array with a
    slot for each of DAYS days of the year, and ``pl_thrsld``.

    A chunk has one row here and up to thousands in the table, so this side moves to the
    chunks and not they to it; a day then reads its slot.
    """
    by_day = hot.groupBy("ID").agg(
        F.map_from_entries(F.collect_list(F.struct("jdate", "hw_thrsld"))).alias("by_day")
    )
    slots = F.transform(F.sequence(F.lit(1), F.lit(DAYS)), lambda j: F.try_element_at("by_day", j))
    arrays = by_day.select("ID", slots.alias("hot_by_day"))
    places = chunks.select("ID", "chunk").distinct()
    return places.join(arrays, "ID", "left").join(wet.select("ID", "pl_thrsld"), "ID", "left")
