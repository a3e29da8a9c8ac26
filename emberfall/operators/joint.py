"""Joint heat and rain excess: one representative event per station season."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATION_SEASON = ["ID", "Long", "Lat", "year_season", "season"]


def joint_events(events: DataFrame) -> DataFrame:
    """Add ``comp_int_rel``, relative heat anomaly times relative rain excess."""
    return events.withColumn("comp_int_rel", F.col("T_anom_rel") * F.col("P_excess_rel"))


def representative_events(joint: DataFrame) -> DataFrame:
    """The event closest to the largest joint intensity of its station season.

    The largest one is itself an event, so the closest is the first of the largest;
    events without a joint intensity come last and the earliest date breaks ties.
    It is found by a combining aggregate rather than a sorted window.
    """
    payload = [c for c in joint.columns if c not in STATION_SEASON]
    closeness = F.struct(
        F.col("comp_int_rel").isNull(), -F.col("comp_int_rel"), F.col("date")
    )
    picked = joint.groupBy(*STATION_SEASON).agg(
        F.min_by(F.struct(*payload), closeness).alias("event"),
        F.max("comp_int_rel").alias("max_comb"),
    )
    return picked.select(*STATION_SEASON, "event.*", "max_comb").withColumn(
        "diff", F.abs(F.col("comp_int_rel") - F.col("max_comb"))
    )


def event_counts(joint: DataFrame) -> DataFrame:
    """Events per season and period."""
    return joint.groupBy("season", "Period").agg(F.count("*").alias("event"))
