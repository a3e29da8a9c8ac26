"""SimHash near-duplicates by a hierarchical index in Gray order.

Fingerprints are sorted by their rank in the reflected Gray code, so that neighbours
share most of their bits. Runs of neighbours become nodes that keep the bits all of
them share (a mask and a pattern); runs of nodes become upper nodes. Two nodes differ at
least in the shared bits in which their patterns differ: pairs of nodes beyond the radius
are pruned with all that lies below, the others are refined down to the fingerprints.

On the cluster, distinct fingerprints are cut at quantiles of their rank into
groups; a group is one row, its numbers packed. Pairs of groups whose shared bits allow
it meet in one task each. A task returns a spanning forest of the links it finds,
never all pairs, so that a large group of near copies stays linear; components of the
forests are the components of all links. With several blocks, a pair within the radius has
a block in which it differs in at most its share of the radius: one index per block
prunes by that share, and the whole distance decides. The driver pairs up a bounded number
of upper nodes; where there are more groups than that, a join pairs the groups below them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberfall.llm import blobs
from emberfall.llm.components import components
from emberfall.llm.words import KEYS, bound_batches, row_key, spare_names
from emberfall.workspace import materialise

SEED = 42
FAN_OUT = 8
NODES_AT_ONCE = 1 << 13
CODES_IN_GROUP = 128_000
FEWEST_GROUPS = 8
#: What the driver pairs up per block: groups, or runs of groups if there are more.
UPPER_NODES = 1024
# Odd factors that turn one shingle hash into further independent ones.
LANE_FACTORS = [1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9]


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of every ``size`` consecutive words, repeats included; A-Z lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) <= size:
        spans = [(0, len(joined))]
    else:
        spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)


def fingerprint(hashes: np.ndarray, lanes: int) -> np.ndarray:
    """64 bits per lane: a bit is 1 if it is set in over half of the hashes; zero of none."""
    out = np.zeros(lanes, np.uint64)
    if not len(hashes):
        return out
    for lane in range(lanes):
        mixed = hashes
        if lane:
            mixed = hashes * np.uint64(LANE_FACTORS[lane])
            mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(LANE_FACTORS[1])
            mixed = mixed ^ (mixed >> np.uint64(29))
        count = np.zeros(64, np.int64)
        for at in range(0, len(mixed), 65536):
            part = mixed[at : at + 65536]
            bits = np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little")
            count += bits.sum(axis=0, dtype=np.int64)
        out[lane] = np.packbits(count * 2 > len(mixed), bitorder="little").view(np.uint64)[0]
    return out


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def block_of(codes: np.ndarray, block: int, blocks: int) -> np.ndarray:
    """The bits of one block, shifted to the top of 64 bits. ``codes``: one row per code."""
    lanes = codes.shape[1]
    width = 64 * lanes // blocks
    lane, at = divmod(block * width, 64)
    return (codes[:, lane] << np.uint64(at)) & np.uint64(((1 << width) - 1) << (64 - width))


def sort_keys(codes: np.ndarray, block: int, blocks: int) -> np.ndarray:
    """Gray rank of the block, ties of a narrow block spread by the other bits."""
    rank = gray_rank(block_of(codes, block, blocks))
    width = 64 * codes.shape[1] // blocks
    if width < 64:
        rest = np.bitwise_xor.reduce(codes * np.uint64(LANE_FACTORS[1]), axis=1) >> np.uint64(width)
        rank = (rank & np.uint64(((1 << width) - 1) << (64 - width))) | rest
    return rank


class GrayTree:
    """Levels of shared bits over codes sorted by Gray rank; level 0 is the codes."""

    def __init__(self, keys: np.ndarray) -> None:
        self.both, self.any = [keys], [keys]
        while len(self.both[-1]) > FAN_OUT:
            starts = np.arange(0, len(self.both[-1]), FAN_OUT)
            self.both.append(np.bitwise_and.reduceat(self.both[-1], starts))
            self.any.append(np.bitwise_or.reduceat(self.any[-1], starts))

    def level(self, at: int) -> tuple[np.ndarray, np.ndarray]:
        at = min(at, len(self.both) - 1)
        return self.both[at], self.any[at]


def apart(both_a: np.ndarray, any_a: np.ndarray, both_b: np.ndarray, any_b: np.ndarray) -> np.ndarray:
    """Fewest bits in which a code under node a differs from one under node b."""
    return np.bitwise_count((both_a & ~any_b) | (both_b & ~any_a))


def near_pairs(
    a: GrayTree, b: GrayTree, reach: int, same: bool
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of codes of a and b that differ in at most ``reach`` bits, in batches;
    of one tree with itself (``same``) each pair once."""
    top = max(len(a.both), len(b.both)) - 1

    def kept(level: int, i: np.ndarray, j: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        (both_a, any_a), (both_b, any_b) = a.level(level), b.level(level)
        near = apart(both_a[i], any_a[i], both_b[j], any_b[j]) <= reach
        if same:
            near &= i <= j
        return level, i[near], j[near]

    n_a, n_b = len(a.level(top)[0]), len(b.level(top)[0])
    stack = [kept(top, np.repeat(np.arange(n_a), n_b), np.tile(np.arange(n_b), n_a))]
    while stack:
        level, i, j = stack.pop()
        if not len(i):
            continue
        if level == 0:
            yield i, j
            continue
        if len(i) > NODES_AT_ONCE:
            stack.append((level, i[NODES_AT_ONCE:], j[NODES_AT_ONCE:]))
            i, j = i[:NODES_AT_ONCE], j[:NODES_AT_ONCE]
        step_a = FAN_OUT if level < len(a.both) else 1
        step_b = FAN_OUT if level < len(b.both) else 1
        child_a = (i[:, None] * step_a + np.arange(step_a)).repeat(step_b, axis=1).ravel()
        child_b = np.tile(j[:, None] * step_b + np.arange(step_b), (1, step_a)).ravel()
        inside = (child_a < len(a.level(level - 1)[0])) & (child_b < len(b.level(level - 1)[0]))
        stack.append(kept(level - 1, child_a[inside], child_b[inside]))


def join_forest(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Unite the ends of links in a forest of parents, in place; roots are the smallest."""
    while len(i):
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up
        root_i, root_j = parent[i], parent[j]
        open_ = root_i != root_j
        i, j, root_i, root_j = i[open_], j[open_], root_i[open_], root_j[open_]
        np.minimum.at(parent, np.maximum(root_i, root_j), np.minimum(root_i, root_j))


def hexed(codes: np.ndarray) -> list[str]:
    """Codes as hexadecimal digits, the first lane first."""
    raw = np.ascontiguousarray(codes.astype(">u8")).tobytes().hex()
    step = 16 * codes.shape[1]
    return [raw[at : at + step] for at in range(0, len(raw), step)]


def unhexed(texts: list[str], lanes: int) -> np.ndarray:
    return np.frombuffer(bytes.fromhex("".join(texts)), ">u8").astype(np.uint64).reshape(-1, lanes)


def link_groups(cells: pa.Table, lanes: int, blocks: int, radius: int) -> pa.Table:
    """A spanning forest of the links within one group or between two."""
    block = cells["block"][0].as_py()
    codes = [blobs.unpack(c)[0].reshape(-1, lanes) for c in cells["cell"].to_pylist()]
    trees = [GrayTree(block_of(c, block, blocks)) for c in codes]
    whole = np.concatenate(codes)
    parent = np.arange(len(whole))
    same = len(codes) == 1
    shift = 0 if same else len(codes[0])
    for i, j in near_pairs(trees[0], trees[-1], radius // blocks, same):
        j = j + shift
        near = np.bitwise_count(whole[i] ^ whole[j]).sum(axis=1) <= radius
        join_forest(parent, i[near], j[near])
    join_forest(parent, np.empty(0, np.int64), np.empty(0, np.int64))
    while not (parent[parent] == parent).all():
        parent = parent[parent]
    linked = np.flatnonzero(parent != np.arange(len(parent)))
    return pa.table({"u": hexed(whole[linked]), "v": hexed(whole[parent[linked]])}, schema=LINKS)


LINKS = pa.schema([("u", pa.string()), ("v", pa.string())])


def near_links(prints: DataFrame, bits: int, radius: int, blocks: int) -> DataFrame:
    """Links (u, v) between distinct fingerprints (``print``, hexadecimal) that connect
    all that differ in at most ``radius`` bits."""
    lanes = bits // 64
    n = prints.count()
    groups = max(-(-n // CODES_IN_GROUP), FEWEST_GROUPS)
    spark = prints.sparkSession

    def keyed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            codes = unhexed(part["print"].tolist(), lanes)
            for block in range(blocks):
                keys = (sort_keys(codes, block, blocks) >> np.uint64(1)).astype(np.int64)
                yield pd.DataFrame({"block": block, "key": keys})

    shares = [i / groups for i in range(1, groups)]
    cuts = (
        prints.mapInPandas(keyed, "block int, key long")
        .groupBy("block")
        .agg(F.percentile_approx("key", shares, max(10_000, 10 * groups)).alias("cuts"))
        .collect()  # at most ``blocks`` rows of ``groups - 1`` numbers
    )
    cuts = {r.block: np.array(r.cuts, np.int64) for r in cuts}

    def dealt(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            codes = unhexed(part["print"].tolist(), lanes)
            for block in range(blocks):
                keys = (sort_keys(codes, block, blocks) >> np.uint64(1)).astype(np.int64)
                at = np.searchsorted(cuts[block], keys, side="left")
                found = [(int(g), blobs.pack(codes[at == g].ravel())) for g in np.unique(at)]
                yield pd.DataFrame({"block": block, "grp": [g for g, _ in found], "cell": [c for _, c in found]})

    def gathered(cells: pa.Table) -> pa.Table:
        block, grp = cells["block"][0].as_py(), cells["grp"][0].as_py()
        codes = np.concatenate([blobs.unpack(c)[0] for c in cells["cell"].to_pylist()]).reshape(-1, lanes)
        codes = codes[np.argsort(sort_keys(codes, block, blocks), kind="stable")]
        own = block_of(codes, block, blocks)
        ends = [np.bitwise_and.reduce(own), np.bitwise_or.reduce(own)]
        return pa.table(
            {
                "block": pa.array([block], pa.int32()),
                "grp": pa.array([grp], pa.int32()),
                "both": pa.array([int(ends[0].astype(np.int64))], pa.int64()),
                "any": pa.array([int(ends[1].astype(np.int64))], pa.int64()),
                "cell": pa.array([blobs.pack(codes.ravel())], pa.binary()),
            }
        )

    index = materialise(
        prints.mapInPandas(dealt, "block int, grp int, cell binary")
        .groupBy("block", "grp")
        .applyInArrow(gathered, "block int, grp int, both long, any long, cell binary"),
        "gray-index",
    )
    run = -(-groups // UPPER_NODES)
    nodes = index.select("block", "grp", "both", "any", F.floor(F.col("grp") / run).cast("int").alias("upper"))
    uppers = nodes.groupBy("block", "upper").agg(F.bit_and("both").alias("both"), F.bit_or("any").alias("any"))
    meet = []
    for block, part in uppers.toPandas().groupby("block"):  # at most blocks x UPPER_NODES rows
        upper = part["upper"].to_numpy()
        # Spark has signed numbers only, whose bits numpy counts by absolute value.
        both, any_ = (part[c].to_numpy(np.int64).view(np.uint64) for c in ("both", "any"))
        near = apart(both[:, None], any_[:, None], both[None, :], any_[None, :]) <= radius // blocks
        a, b = np.nonzero(near & (upper[:, None] <= upper[None, :]))
        meet.append(pd.DataFrame({"block": np.int32(block), "upper_a": upper[a].astype("int32"), "upper_b": upper[b].astype("int32")}))
    if not meet:
        return spark.createDataFrame([], "u string, v string")
    units = spark.createDataFrame(pd.concat(meet), "block int, upper_a int, upper_b int")
    side = lambda s: nodes.select("block", *[F.col(c).alias(f"{c}_{s}") for c in ("upper", "grp", "both", "any")])
    differ = lambda x, y: F.col(f"both_{x}").bitwiseAND(F.bitwise_not(F.col(f"any_{y}")))
    units = units.join(side("a"), ["block", "upper_a"]).join(side("b"), ["block", "upper_b"])
    units = units.filter((F.col("grp_a") <= F.col("grp_b")) & (F.bit_count(differ("a", "b").bitwiseOR(differ("b", "a"))) <= radius // blocks))
    units = materialise(units.select("block", F.col("grp_a").alias("a"), F.col("grp_b").alias("b")), "group-pairs")
    cells = index.select("block", "grp", "cell")
    left = cells.join(units, (cells.grp == units.a) & (cells.block == units.block)).select(
        cells.block, "a", "b", "grp", "cell"
    )
    right = cells.join(
        units, (cells.grp == units.b) & (cells.block == units.block) & (units.a < units.b)
    ).select(cells.block, "a", "b", "grp", "cell")

    def work(met: pa.Table) -> pa.Table:
        return link_groups(met, lanes, blocks, radius)

    return left.union(right).groupBy("block", "a", "b").applyInArrow(work, "u string, v string")


def near_duplicates(
    docs: DataFrame,
    shingle: int = 3,
    bits: int = 64,
    radius: int = 3,
    blocks: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, key_id, key_text, fingerprint, component_id, root), one row per row of ``docs``.

    Documents are linked if their fingerprints differ in at most ``radius`` of ``bits``
    bits; the component's id is the smallest id that links reach, the row's own included.
    NULL and empty texts have the fingerprint zero and are linked like any other. NULL ids
    keep their rows and are the component's id only where there is no other. Repeated rows
    and ids keep a row each; where unrelated texts share an id, components may share their
    id too, and only ``root`` tells them apart. An empty table gives no rows. Other columns are not
    carried.
    """
    bound_batches(docs.sparkSession)
    lanes = bits // 64

    @F.pandas_udf("string")
    def printed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            codes = [fingerprint(shingle_hashes(t, shingle), lanes) for t in texts]
            yield pd.Series(hexed(np.array(codes, np.uint64).reshape(-1, lanes)), dtype="object")

    rows = docs.select(F.col(id_col).alias("row_id"), *row_key(id_col, text_col), printed(F.col(text_col)).alias("print"))
    rows = materialise(rows, "prints")
    nodes = materialise(rows.groupBy("print").agg(F.min("row_id").alias("least_id")), "print-nodes")
    links = near_links(nodes.select("print"), bits, radius, blocks)
    roots = components(links).withColumnRenamed("node", "print")
    rooted = nodes.join(roots, "print", "left").withColumn("root", F.coalesce("root", "print"))
    rooted = materialise(rooted, "rooted")
    # Written down, so that the join back is between scans and a large component can be split.
    least = materialise(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "component-ids")
    of_print = materialise(rooted.join(least, "root").select("print", "component_id", "root"), "component-of-print")
    return rows.join(of_print, "print").select(
        F.col("row_id").alias(id_col), *KEYS, F.col("print").alias("fingerprint"), "component_id", "root"
    )


def keep_one(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with the smallest id of each component of ``found``, once.

    Of rows without any id in a component, and of rows that repeat the smallest id with
    other texts, the smallest key stays.
    """
    first = F.struct(F.col(id_col).isNull().alias("void"), F.col(id_col).alias("id"), *KEYS)
    stay = found.groupBy("root").agg(F.min(first).alias("first"))
    stay = materialise(stay.select("first.key_id", "first.key_text"), "kept-rows")
    own = spare_names(docs.columns, KEYS)
    keyed = docs.select("*", *[k.alias(name) for k, name in zip(row_key(id_col, text_col), own)])
    stay = stay.select(*[F.col(k).alias(name) for k, name in zip(KEYS, own)])
    kept = keyed.join(stay, own, "left_semi")
    return kept.dropDuplicates(own).select(*[F.col(f"`{c}`") for c in docs.columns])
