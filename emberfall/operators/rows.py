"""Row windows over long station series.

A station may hold a large share of all rows, so no window is partitioned by
station alone. Rows are numbered per station without gathering it (numbers within
a year plus the rows of earlier years), cut into chunks of ``chunk_rows``, and the
``halo`` rows on either side of a cut are copied to the neighbouring chunk. A row
window that looks at most ``halo`` rows away is then exact on the home rows of
every chunk, whatever the calendar gaps: windows count rows, not days.

The whole table moves twice: by station and year, to number its rows, and by station and
chunk. Both layouts are written in buckets, so that every later window over chunks and
every join on either pair of keys reads them as they lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from emberfall.workspace import deal, materialise, materialise_buckets

CHUNK_ROWS = 4096


def place_in_years(obs: DataFrame) -> DataFrame:
    """Observations with calendar parts and the row's place in its year, dealt by (ID, year)."""
    days = obs.select(
        "ID",
        "date",
        "TA",
        "RN",
        F.dayofyear("date").alias("jdate"),
        F.year("date").alias("year"),
        F.month("date").alias("month"),
    )
    in_year = Window.partitionBy("ID", "year").orderBy("date", "TA", "RN")
    return deal(days, "ID", "year").withColumn("place_in_year", F.row_number().over(in_year))


def land_observations(obs: DataFrame) -> DataFrame:
    """Write observations once, with calendar parts and the row's place in its year."""
    return materialise_buckets(place_in_years(obs), ["ID", "year"], ["ID", "year"], "landed")


def station_years(landed: DataFrame) -> DataFrame:
    """Per (ID, year): rows, rows of earlier years, first year of the station."""
    sizes = landed.groupBy("ID", "year").agg(F.max("place_in_year").alias("rows_in_year"))
    earlier = Window.partitionBy("ID").orderBy("year")
    return sizes.select(
        "ID",
        "year",
        "rows_in_year",
        F.coalesce(
            F.sum("rows_in_year").over(
                earlier.rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ).alias("rows_before"),
        F.min("year").over(Window.partitionBy("ID")).alias("first_year"),
    )


def eligible_stations(landed: DataFrame, first_year_max: int) -> DataFrame:
    """Stations whose first year is at most ``first_year_max``."""
    first = landed.groupBy("ID").agg(F.min("year").alias("first_year"))
    return first.filter(F.col("first_year") <= first_year_max).select("ID")


def number_rows(landed: DataFrame, first_year_max: int | None = None) -> DataFrame:
    """Add ``row_no``, the 0-based place of a row in its station's series.

    Stations that start after ``first_year_max`` are left out when it is given.
    """
    years = station_years(landed)
    if first_year_max is not None:
        years = years.filter(F.col("first_year") <= first_year_max)
    years = materialise(years.select("ID", "year", "rows_before"), "station-years")
    return landed.join(years, ["ID", "year"]).withColumn(
        "row_no", F.col("rows_before") + F.col("place_in_year") - 1
    ).drop("rows_before", "place_in_year")


def spread_chunks(numbered: DataFrame, halo: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``chunk`` and ``is_home``; rows near a cut appear in both chunks."""
    if halo >= chunk_rows:
        raise ValueError("chunk_rows must exceed halo")
    home = F.expr(f"row_no div {chunk_rows}")
    place = F.col("row_no") % chunk_rows
    early = (place < halo) & (home > 0)
    late = place >= chunk_rows - halo
    copies = (
        F.when(early & late, F.array(home, home - 1, home + 1))
        .when(early, F.array(home, home - 1))
        .when(late, F.array(home, home + 1))
        .otherwise(F.array(home))
    )
    return numbered.withColumn("chunk", F.explode(copies)).withColumn(
        "is_home", F.col("chunk") == home
    )


def deal_chunks(numbered: DataFrame, halo: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``spread_chunks``, dealt by (ID, chunk)."""
    return deal(spread_chunks(numbered, halo, chunk_rows), "ID", "chunk")


def lay_chunks(numbered: DataFrame, halo: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Chunks written once in buckets: row windows over them need no exchange. Rows that are
    in chunks already stay as they are; their halo must be wide enough."""
    if "chunk" in numbered.columns:
        return numbered
    dealt = deal_chunks(numbered, halo, chunk_rows)
    return materialise_buckets(dealt, ["ID", "chunk"], ["ID", "chunk", "row_no"], "chunks")


def chunk_window() -> WindowSpec:
    """Rows of one chunk in series order; every row window shares this one sort."""
    return Window.partitionBy("ID", "chunk").orderBy("row_no")


def home_rows(df: DataFrame) -> DataFrame:
    """Drop the halo copies once the windows are computed."""
    return df.filter("is_home").drop("chunk", "is_home")


def rolling_mean(value: Column, rows: int, window: WindowSpec) -> Column:
    """Centred mean of ``rows`` rows; NULL at the edges and where a value is missing."""
    half = rows // 2
    frame = window.rowsBetween(-half, rows - 1 - half)
    return F.when(F.count(value).over(frame) == rows, F.avg(value).over(frame))


def forward_max(value: Column, rows_ahead: int, window: WindowSpec) -> Column:
    """Maximum over the row and the ``rows_ahead`` rows after it; short at the end."""
    return F.max(value).over(window.rowsBetween(0, rows_ahead))


def coincides_within(
    second_event: Column, lag: int, window: WindowSpec, within: Column
) -> Column:
    """True if ``second_event`` holds 1 to ``lag`` rows later with the same ``within``.

    ``within`` must not decrease along the series, so the smallest value among the
    events ahead tells whether one of them shares it.
    """
    nearest = F.min(F.when(second_event, within)).over(window.rowsBetween(1, lag))
    return F.coalesce(nearest == within, F.lit(False))


def with_min_run(df: DataFrame, flag: str, length: int, name: str, window: WindowSpec) -> DataFrame:
    """Add ``name``: the row is in a run of at least ``length`` true ``flag`` rows.

    NULL breaks a run. A row is in such a run if one of the ``length`` rows from it
    onwards ends a full stretch, so the frames stay short.
    """
    hot = F.coalesce(F.col(flag).cast("int"), F.lit(0))
    stretch = F.sum(hot).over(window.rowsBetween(-(length - 1), 0)) == length
    ended = df.withColumn("_stretch", stretch.cast("int"))
    inside = F.max("_stretch").over(window.rowsBetween(0, length - 1)) == 1
    return ended.withColumn(name, inside).drop("_stretch")
