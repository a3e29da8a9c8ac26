"""Intermediate tables in the shared folder that the cluster names.

A chain that reads one frame several times writes it once as Parquet and goes on
from the written table: lineage is cut, later scans are pruned to the columns
they need, and the size of the table is known from its files, so Spark itself
decides whether joining it by broadcast is safe.
"""

from __future__ import annotations

import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"
_FALLBACK: dict[str, str] = {}
_TABLES: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder serves a ``local`` master, whose tasks all
    share it; on a cluster that would scatter the parts, so it is an error there.
    """
    folder = spark.conf.get(CHECKPOINT_SETTING, None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(
            f"set {CHECKPOINT_SETTING} to a folder that every executor of {master} can reach"
        )
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = tempfile.mkdtemp(prefix="emberfall-")
    return _FALLBACK[app]


def _application_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one intermediate table of this application."""
    return f"{_application_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once and return a scan of the written table."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialise_together(**frames: DataFrame) -> list[DataFrame]:
    """Write independent frames as concurrent jobs, so that neither waits for the
    last tasks of the other."""
    with ThreadPoolExecutor(len(frames)) as pool:
        return list(pool.map(lambda item: materialise(item[1], item[0]), frames.items()))


def deal(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by hash of ``keys`` to as many partitions as shuffles have, no fewer."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def materialise_buckets(dealt: DataFrame, keys: list[str], order: list[str], name: str = "buckets") -> DataFrame:
    """Write a frame that ``deal`` dealt by ``keys`` as one sorted file per bucket.

    Windows and joins by ``keys`` over the returned scan take its buckets as they are: no
    exchange. The table is listed in the session's catalog, but lies with the others.
    """
    spark = dealt.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    writer = dealt.write.format("parquet").bucketBy(buckets, *keys).sortBy(*order)
    writer.option("path", scratch_path(spark, name)).saveAsTable(table)
    _TABLES.setdefault(spark.sparkContext.applicationId, []).append(table)
    return spark.table(table)


def clean(spark: SparkSession) -> None:
    """Delete this application's intermediate tables, once no frame reads them any more."""
    for table in _TABLES.pop(spark.sparkContext.applicationId, []):
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(_application_folder(spark))
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
