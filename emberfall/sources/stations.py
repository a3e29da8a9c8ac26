"""The station list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATION_FILE_SCHEMA = "X int, STN_ID int, Long double, Lat double"


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    """Station coordinates from a CSV with a header; its index column is dropped."""
    listed = spark.read.csv(path, header=True, schema=STATION_FILE_SCHEMA, enforceSchema=True)
    return listed.drop("X")


def with_coordinates(df: DataFrame, stations: DataFrame) -> DataFrame:
    """Left join Long and Lat by station. Spark broadcasts the list if its size allows."""
    places = stations.select(F.col("STN_ID").alias("ID"), "Long", "Lat")
    return df.join(places, "ID", "left")
