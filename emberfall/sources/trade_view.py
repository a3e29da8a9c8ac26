"""Trade tables seen as station days, so that the chains run on them.

A nation is a station, a shipping date a day, the mean quantity the temperature
and the returned quantity the rain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def station_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ID, date, TA, RN) from lineitem, supplier and nation.

    No join is hinted: nation and supplier are broadcast while their files are
    below Spark's threshold; beyond it adaptive execution splits a hot supplier.
    Sums are combined before the shuffle on (ID, date).
    """
    lines = _table(spark, sf_dir, "lineitem")
    places = _table(spark, sf_dir, "supplier").join(
        _table(spark, sf_dir, "nation").select("n_nationkey"),
        F.col("s_nationkey") == F.col("n_nationkey"),
    )
    returned = F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))
    return (
        lines.join(places, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy(
            F.col("n_nationkey").alias("ID"),
            F.col("l_shipdate").cast("date").alias("date"),
        )
        .agg(
            F.avg("l_quantity").alias("TA"),
            F.coalesce(F.sum(returned), F.lit(0.0)).alias("RN"),
        )
    )


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(STN_ID, Long, Lat) with invented coordinates."""
    return _table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("STN_ID"),
        (F.lit(124.0) + F.lit(0.25) * F.col("n_nationkey")).alias("Long"),
        (F.lit(33.0) + F.col("n_regionkey")).alias("Lat"),
    )
