"""Words of texts and identities of rows, as column functions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 1000
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Hand whole texts to Python in batches of at most BATCH_ROWS rows, from now on in this
    session: batches of texts are what bounds a worker's memory."""
    if not 0 < int(spark.conf.get(BATCH_SETTING)) <= BATCH_ROWS:
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# What parts words: everything ASCII but digits and letters. Splitting is a good deal
# faster than extracting.
GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, nothing else; NULL becomes empty."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    """Array of the words of a whole text: runs of digits, letters and what is not ASCII,
    A-Z lower-cased."""
    return F.array_remove(F.split(lower_ascii(text), GAPS, -1), "")


def word_count(text: Column) -> Column:
    """How many words a text has; NULL has none."""
    parts = F.split(F.coalesce(text, F.lit("")), GAPS, -1)
    return F.size(F.array_remove(parts, "")).cast("long")


def row_key(id_col: str, text_col: str) -> list[Column]:
    """Two numbers that rows share only if they share id and text, NULL or not."""
    return [
        F.xxhash64(F.col(id_col), F.col(id_col).isNull()).alias("key_id"),
        F.xxhash64(F.col(text_col), F.col(text_col).isNull()).alias("key_text"),
    ]


KEYS = ["key_id", "key_text"]


def spare_names(taken: list[str], names: list[str]) -> list[str]:
    """``names``, each with as many underscores before it as make it unlike all of ``taken``."""
    used = {c.lower() for c in taken}
    out = []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        out.append(name)
    return out
