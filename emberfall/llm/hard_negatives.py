"""Hard negatives by exact integer products.

Anchors and candidates meet in tiles: a block of anchors against a slice of candidates. A
tile's scores are a matrix product over 64-bit integers by Strassen's recursion: sides are
padded with zeros to even lengths, seven products of half the size replace eight, sums are
integer additions. They wrap around like the ring of integers modulo 2^64 they form, so a
score that fits into a long is exact whatever the steps between.

Two passes, since a window of negatives is known only when its positive is. In the first,
tiles hold one bucket of labels; each tile gives every anchor's heap of best rows of its own
label, and heaps of tiles merge by order. In the second, anchors carry one window per positive;
each tile gives the heap of best other-label rows within each window, and heaps merge again.
Blocks and slices are dealt by hash and bounded in rows, so a common label fills many tiles
instead of one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberfall.llm import blobs
from emberfall.workspace import materialise

SCALE = 256
LEAF = 16
LABEL_BUCKETS = 64
ANCHORS_IN_BLOCK = 2048
ROWS_IN_SLICE = 8192
COLUMNS_AT_ONCE = 1024
LONG = 2**63 - 1
HEAP = pa.schema([("anchor", pa.int64()), ("window", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b over int64, modulo 2^64, by Strassen's recursion down to ``leaf``."""
    m, k, n = a.shape[0], a.shape[1], b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    a = np.pad(a, ((0, m % 2), (0, k % 2)))
    b = np.pad(b, ((0, k % 2), (0, n % 2)))
    i, j, h = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :h], b[:j, h:], b[j:, :h], b[j:, h:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * i, 2 * h), np.int64)
    out[:i, :h] = p1 + p4 - p5 + p7
    out[:i, h:] = p3 + p5
    out[i:, :h] = p2 + p4
    out[i:, h:] = p1 - p2 + p3 + p6
    return out[:m, :n]


def scores_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a and of b (doubles with whole values), exact; beyond a
    long the nearest of +-(2^63 - 1)."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**62 and max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) < 2**62:
        return strassen(a.astype(np.int64), np.ascontiguousarray(b.T).astype(np.int64))
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(a) @ whole(b).T, -LONG, LONG).astype(np.int64)


def heap_of(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best: higher score first, then smaller id."""
    if len(ids) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= edge)
        return near[np.lexsort((ids[near], -scores[near]))][:k]
    return np.lexsort((ids, -scores))[:k]


def matrix(values: pa.Array, width: int, kind: type = np.float64) -> np.ndarray:
    """Rows of equal width; components that a shorter vector lacks are zero."""
    flat, sizes = values.flatten().to_numpy(zero_copy_only=False), values.value_lengths().to_numpy()
    out = np.zeros((len(sizes), width), kind)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), at] = flat
    return out


def usable_rows(vectors: DataFrame, label: Column, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, label, v): distinct rows that take part; v: floor(scale * x) as doubles."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    def floored(x: Column) -> Column:
        # From 2^53 on every double is whole; a scaled component stays finite.
        big = F.greatest(F.least(x * scale, F.lit(1e300)), F.lit(-1e300))
        return F.when(F.abs(big) < 2.0**53, F.floor(big).cast("double")).otherwise(big)

    return (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), v.alias("v"))
        .filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", finite))
        .select("vec_id", "label", F.transform("v", floored).alias("v"))
        .distinct()
    )


def tile_of(cells: pa.Table, side: int, width: int) -> list[np.ndarray] | None:
    """[numbers, ids, labels, vectors, windows] of one side of a tile."""
    found = [blobs.unpack(c) for s, c in zip(cells["side"].to_pylist(), cells["cell"].to_pylist()) if s == side]
    if not found:
        return None
    numbers, ids, labels, values, windows = (np.concatenate(x) for x in zip(*found))
    n = len(ids)
    return [numbers, ids, labels, values.reshape(n, width), windows.reshape(n, -1)]


def tile_scores(anchors: list[np.ndarray], data: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """(first anchor, scores of some anchors against all rows), a bounded product at a time."""
    for at in range(0, len(anchors[1]), COLUMNS_AT_ONCE):
        yield at, scores_of(anchors[3][at : at + COLUMNS_AT_ONCE], data[3])


def heap_table(found: list[tuple[int, int, np.ndarray, np.ndarray]]) -> pa.Table:
    if not found:
        return HEAP.empty_table()
    sizes = [len(ids) for _, _, ids, _ in found]
    columns = [
        np.repeat(np.array([x[0] for x in found], np.int64), sizes),
        np.repeat(np.array([x[1] for x in found], np.int64), sizes),
        np.concatenate([x[2] for x in found]),
        np.concatenate([x[3] for x in found]),
    ]
    return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=HEAP)


def positive_heaps(cells: pa.Table, k: int, width: int) -> pa.Table:
    """Each anchor's best other rows of its own label within a tile."""
    anchors, data = tile_of(cells, 0, width), tile_of(cells, 1, width)
    found = []
    if anchors and data:
        for at, scores in tile_scores(anchors, data):
            for i, row in enumerate(scores, at):
                same = np.flatnonzero((data[2] == anchors[2][i]) & (data[1] != anchors[1][i]))
                top = same[heap_of(data[1][same], row[same], k)]
                found.append((anchors[0][i], 0, data[1][top], row[top]))
    return heap_table(found)


def window_heaps(cells: pa.Table, k: int, width: int, low: int, high: int) -> pa.Table:
    """Each anchor's best other-label rows within a tile whose score is within the window of
    each of its positives: low * p <= 100 * score <= high * p."""
    anchors, data = tile_of(cells, 0, width), tile_of(cells, 1, width)
    found = []
    if anchors and data:
        for at, scores in tile_scores(anchors, data):
            for i, row in enumerate(scores, at):
                # Bounds as whole numbers, in Python's integers: no product overflows.
                bounds = {int(p): (-(-low * int(p) // 100), high * int(p) // 100) for p in anchors[4][i]}
                bounds = {p: (max(a, -LONG), min(b, LONG)) for p, (a, b) in bounds.items() if a <= b and a <= LONG and b >= -LONG}
                if not bounds:
                    continue
                least, most = min(a for a, _ in bounds.values()), max(b for _, b in bounds.values())
                other = np.flatnonzero((row >= least) & (row <= most) & (data[2] != anchors[2][i]))
                ids, values = data[1][other], row[other]
                for p, (a, b) in bounds.items():
                    inside = np.flatnonzero((values >= a) & (values <= b))
                    top = inside[heap_of(ids[inside], values[inside], k)]
                    found.append((anchors[0][i], p, ids[top], values[top]))
    return heap_table(found)


def _dealt(rows: DataFrame, blocks: dict[int, int], slices: dict[int, int], width: int, windows: int) -> DataFrame:
    """(bucket, block, slice, side, cell): anchors to every slice, rows to every block of their
    bucket. ``windows``: how many positives an anchor carries, the last repeated."""

    def deal(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids, labels, numbers, buckets, deals = (part[c].to_numpy() for c in ("vec_id", "label", "number", "bucket", "deal"))
            asks = part["asks"].to_numpy(zero_copy_only=False).astype(bool)
            values = matrix(part["v"], width)
            carried = matrix(part["positives"], windows, np.int64)
            out: dict[str, list] = {c: [] for c in ("bucket", "block", "slice", "side", "cell")}

            def send(bucket: int, block: int, slice_: int, side: int, cell: bytes) -> None:
                for c, x in zip(out, (bucket, block, slice_, side, cell)):
                    out[c].append(x)

            def cuts(where: np.ndarray, key: np.ndarray) -> Iterator[tuple[int, bytes]]:
                order = where[np.argsort(key[where], kind="stable")]
                for piece in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
                    if len(piece):
                        cell = blobs.pack(numbers[piece], ids[piece], labels[piece], values[piece].ravel(), carried[piece].ravel())
                        yield int(key[piece[0]]), cell

            for bucket in np.unique(buckets).tolist():
                n_blocks, n_slices = blocks.get(bucket, 0), slices[bucket]
                own = buckets == bucket
                if n_blocks:
                    for slice_, cell in cuts(np.flatnonzero(own), deals // 1024 % n_slices):
                        for block in range(n_blocks):
                            send(bucket, block, slice_, 1, cell)
                    for block, cell in cuts(np.flatnonzero(own & asks), deals % n_blocks):
                        for slice_ in range(n_slices):
                            send(bucket, block, slice_, 0, cell)
            yield pa.RecordBatch.from_pydict(out, schema=DEALT)

    return rows.mapInArrow(deal, "bucket int, block int, slice int, side int, cell binary")


DEALT = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("slice", pa.int32()), ("side", pa.int32()), ("cell", pa.binary())])


def _sizes(rows: DataFrame, bucket: Column) -> tuple[dict[int, int], dict[int, int]]:
    """Blocks of anchors and slices of rows by bucket; at most LABEL_BUCKETS rows come back."""
    counted = rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.count_if("asks").alias("asks")).collect()
    return (
        {r.bucket: -(-r.asks // ANCHORS_IN_BLOCK) for r in counted if r.asks},
        {r.bucket: -(-r.n // ROWS_IN_SLICE) for r in counted},
    )


def _merged(heaps: DataFrame, k: int) -> DataFrame:
    """The k best of all tiles by anchor and window."""
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "vec_id")
    return heaps.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    label: Column,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = SCALE,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components become floor(scale * x); a row's score is its inner product with the anchor.
    ``anchors`` selects anchors by the column ``vec_id``; ``label`` is taken from the input. An
    anchor's positives are its best rows of the same label and another id; its negatives, for
    each positive of score p, the best rows of another label with
    ``low * p <= 100 * score <= high * p``. Ties go to the smaller id.

    Rows with a NULL id, label or vector, or with a component that is NULL or not finite, take
    no part. Rows that repeat wholly count once; rows that share only an id stay apart, so that
    such an id may come more than once. Components that a shorter vector lacks are zero. An
    empty table, and anchors without positives or negatives, give no rows. Other columns are
    not carried.
    """
    spark = vectors.sparkSession
    rows = usable_rows(vectors, label, id_col, vector_col, scale)
    rows = rows.withColumn("asks", F.coalesce(anchors.cast("boolean"), F.lit(False)))
    rows = rows.withColumn("deal", F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 40)))
    # Numbers are written down, so that every later task sees the same.
    rows = materialise(rows.withColumn("number", F.monotonically_increasing_id()), "vectors")
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    width = rows.agg(F.max(F.size("v"))).first()[0]
    if width is None:
        return spark.createDataFrame([], empty)
    width = max(width, 1)

    bucket = F.pmod(F.xxhash64("label"), F.lit(LABEL_BUCKETS)).cast("int")
    no_windows = F.array().cast("array<long>")
    first = _dealt(rows.select("*", bucket.alias("bucket"), no_windows.alias("positives")), *_sizes(rows, bucket), width, 0)

    def best_positives(cells: pa.Table) -> pa.Table:
        return positive_heaps(cells, positives, width)

    heaps = first.groupBy("bucket", "block", "slice").applyInArrow(best_positives, "anchor long, window long, vec_id long, score long")
    best = materialise(_merged(heaps, positives), "positives")

    one = F.lit(0)
    carried = best.groupBy("anchor").agg(F.collect_list("score").alias("positives"))  # at most ``positives`` each
    asking = rows.join(carried, rows.number == carried.anchor, "left").drop("anchor")
    # An anchor without positives asks nothing; the last score fills the windows up.
    asking = asking.withColumn("asks", F.col("positives").isNotNull())
    filled = F.slice(F.concat("positives", F.array_repeat(F.element_at("positives", -1), positives)), 1, positives)
    asking = asking.withColumn("positives", F.coalesce(filled, no_windows)).withColumn("bucket", one)
    second = _dealt(asking, *_sizes(asking, one), width, positives)

    def best_negatives(cells: pa.Table) -> pa.Table:
        return window_heaps(cells, negatives, width, low, high)

    heaps = second.groupBy("bucket", "block", "slice").applyInArrow(best_negatives, "anchor long, window long, vec_id long, score long")
    met = materialise(_merged(heaps, negatives), "negatives")
    names = rows.filter("asks").select(F.col("number").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    pairs = best.select("anchor", F.col("score").alias("window"), F.col("vec_id").alias("positive_id"))
    return (
        met.join(pairs, ["anchor", "window"])
        .join(names, "anchor")
        .select(
            "anchor_id",
            "positive_id",
            "rank",
            F.col("vec_id").alias("negative_id"),
            F.col("window").alias("positive_score"),
            F.col("score").alias("negative_score"),
        )
    )
