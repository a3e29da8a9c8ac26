"""Sharding by best fit: indivisible groups, largest first, into the tightest shard.

Documents of equal text form a group that stays together. Groups are packed by
decreasing size, each into the shard with the least remaining capacity that still holds
it (a balanced tree keeps shards in order of remaining capacity); the capacity is an
even share of all bytes, and a group that fits nowhere goes where most is left.

No task sees all groups. Large groups, those above 1/1024 of a shard's share, number at
most 1024 per shard; they are packed first, on the driver. The small rest is dealt
by digest into slices of bounded size, and each slice packs its groups into its share of
every shard's remaining capacity, again by best fit. Slots are numbered by running sums
over blocks of bounded size. Every shuffle is on digests or on (doc_id, digest) with
equal rows combined beforehand, so that neither many copies nor repeated rows gather.
"""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberfall.workspace import materialise

LARGE_PART = 1024
GROUPS_IN_SLICE = 50_000
ROWS_IN_BLOCK = 50_000


class CapacityTree:
    """Shards ordered by (remaining capacity, shard): a two-level balanced tree.

    Leaves are sorted runs of at most ``2 * width`` entries under one index of their
    largest entries; a leaf that grows beyond is cut in half, an empty one goes.
    """

    def __init__(self, entries: list[tuple[int, int]], width: int = 256) -> None:
        self.width = width
        ordered = sorted(entries)
        self.leaves = [ordered[i : i + width] for i in range(0, len(ordered), width)]
        self.tops = [leaf[-1] for leaf in self.leaves]

    def _take(self, at: int, i: int) -> tuple[int, int]:
        entry = self.leaves[at].pop(i)
        if self.leaves[at]:
            self.tops[at] = self.leaves[at][-1]
        else:
            del self.leaves[at], self.tops[at]
        return entry

    def tightest(self, size: int) -> tuple[int, int]:
        """Take out the shard with the least room for ``size``; if none has, the one with most."""
        at = bisect_left(self.tops, (size, -1))
        if at == len(self.tops):
            return self._take(at - 1, len(self.leaves[-1]) - 1)
        return self._take(at, bisect_left(self.leaves[at], (size, -1)))

    def put(self, room: int, shard: int) -> None:
        """Put a shard back with its remaining capacity."""
        if not self.leaves:
            self.leaves, self.tops = [[(room, shard)]], [(room, shard)]
            return
        at = min(bisect_left(self.tops, (room, shard)), len(self.tops) - 1)
        leaf = self.leaves[at]
        leaf.insert(bisect_left(leaf, (room, shard)), (room, shard))
        self.tops[at] = leaf[-1]
        if len(leaf) > 2 * self.width:
            self.leaves[at : at + 1] = [leaf[: self.width], leaf[self.width :]]
            self.tops[at : at + 1] = [self.leaves[at][-1], self.leaves[at + 1][-1]]


def best_fit(sizes: list[int], rooms: list[int]) -> list[int]:
    """The shard of each group; ``sizes`` in decreasing order, ``rooms`` by shard."""
    tree = CapacityTree([(room, shard) for shard, room in enumerate(rooms)])
    chosen = []
    for size in sizes:
        room, shard = tree.tightest(size)
        tree.put(room - size, shard)
        chosen.append(shard)
    return chosen


def text_size(text: Column) -> Column:
    """Bytes of the text in UTF-8 (NULL: none) plus one."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def shard_documents(
    docs: DataFrame,
    n_shards: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
    large_part: int = LARGE_PART,
) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row per row of ``docs``.

    The law is ``bytes``: shards are near equal in bytes, as far as the largest group
    allows. Slots count from 0 in each shard without gaps, in order of blocks of
    documents, then of id. A NULL text groups with the empty one. Repeated rows
    and ids keep a row and a slot each; NULL ids are kept. An empty table gives no rows.
    Other columns are not carried. ``grown_shard`` is NULL under this law.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialise(
        docs.select(
            F.col(id_col).alias("id"),
            text_size(F.col(text_col)).alias("size"),
            F.crc32(text.cast("binary")).cast("long").alias("crc"),
            F.unhex(F.substring(F.sha2(text, 256), 1, 32)).alias("digest"),
        )
        .groupBy("id", "size", "crc", "digest")
        .agg(F.count("*").alias("copies")),
        "shard-rows",
    )
    groups = materialise(
        rows.groupBy("digest").agg(F.sum(F.col("size") * F.col("copies")).alias("weight")), "shard-groups"
    )
    total, n_groups = groups.agg(F.coalesce(F.sum("weight"), F.lit(0)), F.count("*")).first()
    (n_rows,) = rows.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()
    share = -(-total // n_shards)
    large_from = share // large_part
    large = groups.filter(F.col("weight") > large_from).orderBy(F.desc("weight"), "digest").collect()
    rooms = [share] * n_shards
    chosen = best_fit([g.weight for g in large], rooms)
    for group, shard in zip(large, chosen):
        rooms[shard] -= group.weight
    small_total = max(sum(max(room, 0) for room in rooms), 1)
    n_slices = max(1, -(-n_groups // GROUPS_IN_SLICE))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        ordered = part.sort_values(["weight", "digest"], ascending=[False, True])
        own = int(ordered["weight"].sum())
        part_rooms = [max(room, 0) * own // small_total for room in rooms]
        return pd.DataFrame(
            {"digest": ordered["digest"], "shard": best_fit(ordered["weight"].tolist(), part_rooms)}
        )

    slice_of = F.pmod(F.xxhash64("digest"), F.lit(n_slices)).cast("int")
    small = groups.filter(F.col("weight") <= large_from).withColumn("slice", slice_of)
    shards = small.groupBy("slice").applyInPandas(pack, "digest binary, shard int")
    if large:
        fixed = pd.DataFrame({"digest": [bytes(g.digest) for g in large], "shard": chosen})
        shards = shards.unionByName(docs.sparkSession.createDataFrame(fixed, "digest binary, shard int"))
    n_blocks = max(1, -(-n_rows // ROWS_IN_BLOCK))
    block = F.pmod(F.xxhash64("id", "digest"), F.lit(n_blocks)).cast("int")
    dealt = materialise(
        rows.join(materialise(shards, "shard-of-group"), "digest").withColumn("block", block), "shard-dealt"
    )
    by_shard = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("shard", "block").agg(F.sum("copies").alias("held"))
    starts = counts.select("shard", "block", F.coalesce(F.sum("held").over(by_shard), F.lit(0)).alias("before"))
    in_block = (
        Window.partitionBy("shard", "block").orderBy("id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    )
    slotted = (
        dealt.withColumn("ahead", F.coalesce(F.sum("copies").over(in_block), F.lit(0)))
        .join(materialise(starts, "shard-starts"), ["shard", "block"])
        .withColumn("first", F.col("before") + F.col("ahead"))
    )
    return slotted.select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        F.explode(F.sequence("first", F.col("first") + F.col("copies") - 1)).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
