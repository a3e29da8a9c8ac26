"""Ranks and exact quantiles of large groups.

Neither gathers a group. Equal values are counted first. For ranks, the distinct values
are range-partitioned into blocks, each block is cumulated on its own and shifted by
the totals of the blocks before it. For quantiles they are cut at a sketch, and only the
cuts that hold a wanted rank are put in order.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberfall.workspace import materialise

# A value is joined by broadcast if it makes up more than 1/HOT_SHARE of all rows,
# so at most HOT_SHARE - 1 values are ever broadcast that way.
HOT_SHARE = 1000
SPREAD = 1024
# Cuts of a group's distinct values, of which a quantile needs one or two.
CUTS = 256


def value_positions(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Per group and distinct value: ``n_less``, ``n_equal`` and ``n_group``.

    NULL values do not count. The block of a value comes from the range partition
    it falls in; it is written down before it is used twice, so that a lost
    executor cannot move a value to another block.
    """
    by = list(by)
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*by, value)
        .agg(F.count("*").alias("n_equal"))
    )
    return positions_of_counts(counts, value, by)


def positions_of_counts(counts: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """``value_positions`` of values already counted: one row per group and distinct value,
    with ``n_equal``. Other columns stay."""
    by = list(by)
    others = [c for c in counts.columns if c not in (*by, value, "n_equal")]
    blocks = materialise(
        counts.repartitionByRange(*by, value).withColumn("block", F.spark_partition_id()),
        "blocks",
    )
    in_order = Window.partitionBy(*by, F.lit(0)).orderBy("block")
    totals = (
        blocks.groupBy(*by, "block")
        .agg(F.sum("n_equal").alias("in_block"))
        .select(
            *by,
            "block",
            F.coalesce(
                F.sum("in_block").over(in_order.rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0),
            ).alias("before_block"),
            F.sum("in_block").over(Window.partitionBy(*by, F.lit(0))).alias("n_group"),
        )
    )
    in_block = (
        Window.partitionBy(*by, "block")
        .orderBy(value)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return blocks.join(totals, [*by, "block"]).select(
        *by,
        value,
        *others,
        "n_equal",
        "n_group",
        (F.col("before_block") + F.coalesce(F.sum("n_equal").over(in_block), F.lit(0))).alias(
            "n_less"
        ),
    )


def percent_rank_of(n_less: Column, n_group: Column) -> Column:
    """(minimum rank - 1) / (n - 1) on the 0 to 100 scale; NULL for a single value."""
    return F.try_divide(n_less, n_group - 1) * 100


@dataclass(frozen=True)
class RankTable:
    """Percent ranks of the distinct values of one measure.

    ``table`` holds the group columns, ``value``, ``n_equal``, ``percent_rank`` and
    ``lane``, a written zero: as a literal the optimizer would take it out of the join
    keys. ``rows`` is the number of rows ranked, as a scalar of the plan.
    """

    table: DataFrame
    rows: Column


def percent_rank_tables(
    df: DataFrame, values: Sequence[str], by: Sequence[str] = ()
) -> dict[str, RankTable]:
    """Percent ranks (0 to 100) of several measures from one pass over ``df``."""
    by = list(by)
    cells = [
        F.struct(F.lit(v).alias("measure"), F.col(v).cast("double").alias("value"))
        for v in values
    ]
    long = df.select(*by, F.explode(F.array(*cells)).alias("cell")).select(*by, "cell.*")
    positions = value_positions(long, "value", ["measure", *by])
    ranked = materialise(
        positions.select(
            "measure",
            *by,
            "value",
            "n_equal",
            percent_rank_of(F.col("n_less"), F.col("n_group")).alias("percent_rank"),
            F.lit(0).alias("lane"),
        ),
        "ranks",
    )
    found = {}
    for v in values:
        table = ranked.filter(F.col("measure") == v).drop("measure")
        found[v] = RankTable(table, table.select(F.sum("n_equal")).scalar())
    return found


def attach_percent_rank(
    df: DataFrame, ranks: RankTable, value: str, name: str, by: Sequence[str] = ()
) -> DataFrame:
    """Look up the rank of ``value`` for every row; NULL values get NULL.

    A few values (days without rain) can make up most rows. Those above a fixed
    share are so few that they are broadcast; their rows are then scattered before
    the join with the remaining values.
    """
    by = list(by)
    table = ranks.table.select(
        *by,
        F.col("value").alias(value),
        "n_equal",
        F.col("lane").alias("_lane"),
        F.struct("percent_rank").alias("_found"),
    )
    is_hot = F.col("n_equal") * HOT_SHARE > ranks.rows
    hot = table.filter(is_hot).drop("n_equal", "_lane").withColumnRenamed("_found", "_hot")
    cold = table.filter(~is_hot).drop("n_equal")
    keys = [*by, value]
    done = F.col("_hot").isNotNull() | F.col(value).isNull()
    lane = F.when(done, 1 + F.pmod(F.xxhash64(*df.columns), F.lit(SPREAD))).otherwise(0)
    return (
        df.join(F.broadcast(hot), keys, "left")
        .withColumn("_lane", lane.cast("int"))
        .join(cold, [*keys, "_lane"], "left")
        .withColumn(name, F.coalesce(F.col("_hot"), F.col("_found"))["percent_rank"])
        .drop("_hot", "_found", "_lane")
    )


def exact_quantiles(
    df: DataFrame,
    value: str,
    quantiles: dict[str, float],
    by: Sequence[str] = (),
    size_as: str = "n",
) -> DataFrame:
    """Linearly interpolated quantiles, one column per entry of ``quantiles``.

    Also returns the number of values of the group, named ``size_as``. Distinct values are
    counted and cut at a sketch of their quantiles; how many values lie in each cut is counted
    exactly, and only the cuts that hold a wanted rank are put in order.
    """
    by = list(by)
    counts = df.filter(F.col(value).isNotNull())
    keys = by or ["_all"]
    if not by:
        counts = counts.withColumn("_all", F.lit(0))
    counts = materialise(counts.groupBy(*keys, value).agg(F.count("*").alias("n_equal")), "counts")
    shares = [i / CUTS for i in range(1, CUTS)]
    edges = counts.groupBy(*keys).agg(
        F.percentile_approx(value, shares, 100 * CUTS).alias("_edges"), F.sum("n_equal").alias("n_group")
    )
    cut = F.size(F.filter("_edges", lambda e: e < F.col(value)))
    placed = counts.join(edges, keys).select(*keys, value, "n_equal", "n_group", cut.alias("_cut"))
    along = Window.partitionBy(*keys).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*keys, "_cut", "n_group").agg(F.sum("n_equal").alias("_held"))
    totals = totals.withColumn("_before", F.coalesce(F.sum("_held").over(along), F.lit(0)))
    targets = {}
    for name, q in quantiles.items():
        rank = (F.col("n_group") - 1) * q
        targets |= {f"{name}_low": F.floor(rank), f"{name}_high": F.floor(rank) + 1}
    wanted = F.lit(False)
    for target in targets.values():
        wanted = wanted | ((F.col("_before") <= target) & (target < F.col("_before") + F.col("_held")))
    wanted = totals.filter(wanted).select(*keys, "_cut", "_before")
    inside = Window.partitionBy(*keys, "_cut").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    positions = placed.join(wanted, [*keys, "_cut"]).withColumn(
        "n_less", F.col("_before") + F.coalesce(F.sum("n_equal").over(inside), F.lit(0))
    )
    picks = [F.max("n_group").alias(size_as)]
    for name, target in targets.items():
        covers = (F.col("n_less") <= target) & (target < F.col("n_less") + F.col("n_equal"))
        picks.append(F.max(F.when(covers, F.col(value))).alias(name))
    found = positions.groupBy(*keys).agg(*picks)
    columns = [F.col(c) for c in by]
    for name, q in quantiles.items():
        rank = (F.col(size_as) - 1) * q
        low, high = F.col(f"{name}_low"), F.col(f"{name}_high")
        step = F.coalesce(high, low) - low
        columns.append((low + (rank - F.floor(rank)) * step).alias(name))
    return found.select(*columns, size_as)
