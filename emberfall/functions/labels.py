"""Reading aids: significance stars, percentile classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def significance(p: Column) -> Column:
    """Stars at .001, .01 and .05; ``ns`` above; NULL for NULL."""
    return (
        F.when(p < 0.001, F.lit("***"))
        .when(p < 0.01, F.lit("**"))
        .when(p < 0.05, F.lit("*"))
        .when(p.isNotNull(), F.lit("ns"))
    )


def rank_label(percentile: Column, is_record: Column) -> Column:
    """Class of a percentile; a record overrides it."""
    # The class texts and their limits.
    rank = (
        F.when(percentile >= 99, F.lit("Extremely High (>99th)"))
        .when(percentile >= 95, F.lit("Very High (>95th)"))
        .when(percentile >= 90, F.lit("High (>90th)"))
        .otherwise(F.lit("Near Average (<90th)"))
    )
    return F.when(is_record.isNull(), F.lit(None)).when(
        is_record, F.lit("Record High (100%)")
    ).otherwise(rank)
