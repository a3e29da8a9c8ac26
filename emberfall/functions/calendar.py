"""Calendar columns: seasons, season years, periods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Months of each season, in display order.
SEASONS = {"DJF": (12, 1, 2), "MAM": (3, 4, 5), "JJA": (6, 7, 8), "SON": (9, 10, 11)}


def season_of(month: Column) -> Column:
    """Season name of a month number; NULL stays NULL."""
    name = F.lit(None).cast("string")
    for season, months in SEASONS.items():
        name = F.when(month.isin(*months), F.lit(season)).otherwise(name)
    return name


def season_year(year: Column, month: Column) -> Column:
    """December counts for the winter of the next year."""
    return (year + (month == 12).cast("int")).cast("int")


def season_order(season: Column) -> Column:
    """1 to 4 in the order DJF, MAM, JJA, SON."""
    order = F.lit(None).cast("int")
    for place, name in enumerate(SEASONS, start=1):
        order = F.when(season == name, F.lit(place)).otherwise(order)
    return order


def alphabetical_season_index(season: Column) -> Column:
    """1 to 4 in alphabetical order, the place of a season on an unordered axis."""
    index = F.lit(None).cast("int")
    for place, name in enumerate(sorted(SEASONS), start=1):
        index = F.when(season == name, F.lit(place)).otherwise(index)
    return index


def period_of(year_season: Column, last_of_first: int, labels: tuple[str, str]) -> Column:
    """First label up to and including ``last_of_first``, the second after it."""
    return F.when(year_season <= last_of_first, F.lit(labels[0])).otherwise(F.lit(labels[1]))
