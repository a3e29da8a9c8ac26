"""Daily station observations: raw files in, typed and cleaned rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberfall.functions.measures import is_finite

# Fixed values of the raw daily file: 0-based positions of the four used columns.
FILE_COLUMNS = {"date_raw": 0, "ID": 1, "TA": 11, "RN": 38}
FILE_WIDTH = 39
FILE_PATTERN = "asos*"
HEADER_MARK = "#"
# A comma with blanks around it, or a run of blanks.
SEPARATOR = r"\s*,\s*|\s+"

# Fixed sentinel values: no rain is written -9, a missing temperature -99.
NO_RAIN = -9.0
MISSING_TEMPERATURE = -99.0


def read_raw_observations(
    spark: SparkSession, path: str, sep: str = SEPARATOR, pattern: str = FILE_PATTERN
) -> DataFrame:
    """All station files under ``path`` as one scan of four text columns.

    ``sep`` is a pattern: the default takes commas and runs of blanks alike, so files with
    either layout, or with columns aligned by blanks, give the same rows. Header lines
    start with ``#``. Short lines are padded with NULL. Files stay splittable: no row is
    chosen by its position in the file.
    """
    lines = spark.read.text(path, pathGlobFilter=pattern).select(F.trim("value").alias("line"))
    cells = F.split("line", sep, FILE_WIDTH + 1)
    return lines.filter(~F.startswith("line", F.lit(HEADER_MARK)) & (F.col("line") != "")).select(
        *[F.nullif(F.trim(F.get(cells, F.lit(i))), F.lit("")).alias(name) for name, i in FILE_COLUMNS.items()]
    )


def finite_number(text: Column) -> Column:
    """Text as a number; NULL for text that is no number, ``NaN`` and infinities."""
    number = text.try_cast("double")
    return F.when(is_finite(number), number)


def rain_depth(rn: Column) -> Column:
    """Rain as a finite number or NULL; the sentinel is 0."""
    number = finite_number(rn)
    return F.when(number == NO_RAIN, F.lit(0.0)).otherwise(number)


def max_temperature(ta: Column) -> Column:
    """Temperature as a finite number; anything else and the sentinel are NULL."""
    return F.nullif(finite_number(ta), F.lit(MISSING_TEMPERATURE))


def clean_observations(raw: DataFrame) -> DataFrame:
    """Type the four raw columns. Rows without a date (footer, junk) drop out."""
    typed = raw.select(
        F.col("ID").try_cast("int").alias("ID"),
        F.try_to_date(F.col("date_raw"), "yyyyMMdd").alias("date"),
        max_temperature(F.col("TA")).alias("TA"),
        rain_depth(F.col("RN")).alias("RN"),
    )
    return typed.filter(F.col("date").isNotNull() & F.col("ID").isNotNull())


def read_observations(
    spark: SparkSession,
    path: str,
    start: str | None = None,
    end: str | None = None,
    sep: str = SEPARATOR,
    pattern: str = FILE_PATTERN,
) -> DataFrame:
    """Cleaned observations (ID, date, TA, RN), optionally bounded by date."""
    days = clean_observations(read_raw_observations(spark, path, sep, pattern))
    if start is not None:
        days = days.filter(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        days = days.filter(F.col("date") <= F.lit(end).cast("date"))
    return days
