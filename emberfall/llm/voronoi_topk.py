"""Exact top-k search by inner product as a Voronoi join.

Pivots are taken from a bounded sample of the vectors. Queries and vectors are grouped by
their nearest pivot: queries into groups, vectors into cells. A query q of a group with
pivot p lies within the group's radius u of p, so for a vector o its score differs from
<p, o> by at most u |o|. A first pass over the vectors summarises each cell (its radius and
its longest vector) and, per task and group, the best guaranteed scores <p, o> - u |o|; the
k-th best of them over all tasks bounds from below what a query of the group must reach. A
cell whose summary cannot reach a group's bound is not looked at for it; of the other
cells a vector is sent to the group only if <p, o> + u |o| reaches the bound. Each task
then solves one block of queries against one slice of vectors, and the tops of the slices
are merged.

Blocks and slices are dealt by hash of the id and bounded in rows, so neither a crowded
cell nor a common vector gathers. Scores are whole numbers: they are computed in
doubles while every sum is below 2^53, in 64-bit integers below 2^63, else in Python's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberfall.llm import blobs
from emberfall.workspace import materialise

SCALE = 256
PIVOTS = 32
PIVOT_SAMPLE = 2048
QUERIES_IN_BLOCK = 4096
ROWS_IN_SLICE = 8192
LONG = 2**63 - 1
TOPS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component, as doubles with whole values.

    Vectors that are NULL, or hold a NULL or a component that is not finite, drop out, and
    so do rows without an id.
    """
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    def floored(x: Column) -> Column:
        # From 2^53 on every double is whole.
        return F.when(F.abs(x * scale) < 2.0**53, F.floor(x * scale).cast("double")).otherwise(x * scale)

    return (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
        .filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", finite))
        .select("vec_id", F.transform("v", floored).alias("v"))
    )


def matrix(column: pd.Series, width: int) -> np.ndarray:
    """Rows of equal width; components that a shorter vector lacks are zero."""
    out = np.zeros((len(column), width))
    for i, v in enumerate(column):
        out[i, : len(v)] = v[:width]
    return out


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole inner products of the rows of a and b, exact; beyond a long the nearest long."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    if most < 2**63:
        return a.astype(np.int64) @ b.astype(np.int64).T
    x = np.vectorize(int, otypes=[object])(a)
    y = np.vectorize(int, otypes=[object])(b)
    return np.clip(x @ y.T, -LONG - 1, LONG).astype(np.int64)


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best distinct ids: higher score first, then smaller id."""
    if len(ids) > 4 * k:
        edge = np.partition(scores, len(scores) - 2 * k)[len(scores) - 2 * k]
        near = np.flatnonzero(scores >= edge)
        order = near[np.lexsort((ids[near], -scores[near]))]
        order = order[np.sort(np.unique(ids[order], return_index=True)[1])]
        if len(order) >= k:
            return order[:k]
    order = np.lexsort((ids, -scores))
    return order[np.sort(np.unique(ids[order], return_index=True)[1])][:k]


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Pivots far from each other: each next one is the farthest from those before."""
    if not len(sample):
        return sample
    chosen = [0]
    gap = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(sample)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def nearest(rows: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest pivot of each row and the distance to it."""
    square = (rows**2).sum(1)[:, None] - 2 * rows @ pivots.T + (pivots**2).sum(1)[None, :]
    cell = square.argmin(axis=1)
    return cell, np.sqrt(((rows - pivots[cell]) ** 2).sum(axis=1))


def solve(cells: pa.Table, k: int, width: int) -> pa.Table:
    """The k best vectors of one slice for every query of one block."""
    parts = {0: ([], []), 1: ([], [])}
    for side, cell in zip(cells["side"].to_pylist(), cells["cell"].to_pylist()):
        ids, values = blobs.unpack(cell)
        parts[side][0].append(ids)
        parts[side][1].append(values.reshape(len(ids), width))
    if not parts[0][0] or not parts[1][0]:
        return TOPS.empty_table()
    queries, data = ((np.concatenate(i), np.concatenate(v)) for i, v in (parts[0], parts[1]))
    found = []
    for at in range(0, len(queries[0]), 256):
        ids = queries[0][at : at + 256]
        scores = inner(queries[1][at : at + 256], data[1])
        for query, row in zip(ids, scores):
            others = np.flatnonzero(data[0] != query)
            top = others[best_of(data[0][others], row[others], k)]
            found.append(pa.table([np.full(len(top), query), data[0][top], row[top]], schema=TOPS))
    return pa.concat_tables(found)


def routed(
    vectors: DataFrame, queries: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = PIVOTS
) -> tuple[DataFrame, int] | None:
    """(grp, block, slice, side, cell) of queries (side 0) and of the vectors that can be among
    the k best of a group (side 1), and the width of a vector; None without queries."""
    rows = materialise(whole_vectors(vectors, id_col, vector_col).withColumn("asks", queries), "whole-vectors")
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    if not n:
        return None
    width = max(width, 1)
    sample = rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(PIVOT_SAMPLE).select("v").toPandas()
    points = choose_pivots(matrix(sample["v"], width), pivots)
    asking = rows.filter("asks")

    def cells(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            cell, gap = nearest(matrix(part["v"], width), points)
            yield pd.DataFrame({"grp": cell, "gap": gap})

    groups = (
        asking.select("v").mapInPandas(cells, "grp int, gap double").groupBy("grp").agg(F.count("*"), F.max("gap")).collect()
    )  # at most one row per pivot
    if not groups:
        return None
    held = np.array([g[0] for g in groups])
    blocks = np.array([-(-g[1] // QUERIES_IN_BLOCK) for g in groups])
    reach = np.array([g[2] for g in groups])
    centres = points[held]

    def bounds(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lowest and highest possible score of each row for each group."""
        middle = values @ centres.T
        slack = np.sqrt((values**2).sum(axis=1))[:, None] * reach[None, :]
        spare = 1e-9 * (np.abs(middle) + slack) + 1e-6
        return middle - slack - spare, middle + slack + spare

    def summaries(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, dict[int, float]] = {g: {} for g in range(len(held))}
        radius, norm = np.full(len(points), -1.0), np.zeros(len(points))
        for part in parts:
            values = matrix(part["v"], width)
            low, _ = bounds(values)
            ids = part["vec_id"].to_numpy()
            cell, gap = nearest(values, points)
            np.maximum.at(radius, cell, gap)
            np.maximum.at(norm, cell, np.sqrt((values**2).sum(axis=1)))
            for g, tops in best.items():
                for i in best_of(ids, low[:, g], k + 1):
                    tops[ids[i]] = max(tops.get(ids[i], -np.inf), low[i, g])
                if len(tops) > k + 1:
                    best[g] = dict(sorted(tops.items(), key=lambda x: (-x[1], x[0]))[: k + 1])
        for g, tops in best.items():
            yield pd.DataFrame({"g": g, "vec_id": list(tops), "low": list(tops.values()), "cell": -1, "norm": 0.0})
        seen = np.flatnonzero(radius >= 0)
        yield pd.DataFrame({"g": -1, "vec_id": 0, "low": radius[seen], "cell": seen, "norm": norm[seen]})

    by_group = Window.partitionBy("g").orderBy(F.desc("low"), "vec_id")
    summary = materialise(
        rows.select("vec_id", "v").mapInPandas(summaries, "g int, vec_id long, low double, cell int, norm double"), "summaries"
    )
    cell_rows = summary.filter("g < 0").groupBy("cell").agg(F.max("low").alias("radius"), F.max("norm").alias("norm")).collect()
    lowest = (
        summary.filter("g >= 0")
        .groupBy("g", "vec_id")
        .agg(F.max("low").alias("low"))
        .withColumn("rank", F.row_number().over(by_group))
        .filter(F.col("rank") <= k + 1)
        .groupBy("g")
        .agg(F.min("low").alias("low"), F.count("*").alias("n"))
        .collect()
    )  # one row per group
    needed = np.full(len(held), -np.inf)
    for r in lowest:
        if r.n > k:
            needed[r.g] = r.low
    # Cells that can reach a group's bound: by the distance between pivots' products, the
    # cell's radius and its longest vector. One row per pivot, one column per group.
    reaching = np.zeros((len(points), len(held)), bool)
    for r in cell_rows:
        middle = centres @ points[r.cell]
        slack = np.sqrt((centres**2).sum(axis=1)) * r.radius + reach * r.norm
        reaching[r.cell] = middle + slack + 1e-9 * (np.abs(middle) + slack) + 1e-6 >= needed
    slices = max(1, -(-n // ROWS_IN_SLICE))

    def dealt(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group_of = {p: g for g, p in enumerate(held.tolist())}
        for part in parts:
            # In order of slice, so that each group's share of a slice is one stretch.
            part = part.iloc[np.argsort(part["deal"].to_numpy() // 1024 % slices, kind="stable")]
            values, ids = matrix(part["v"], width), part["vec_id"].to_numpy()
            asks, deal = part["asks"].to_numpy(), part["deal"].to_numpy()
            slice_of = deal // 1024 % slices
            out = []

            def stretches(where: np.ndarray, key: np.ndarray) -> Iterator[tuple[int, bytes]]:
                for at in np.split(where, np.flatnonzero(np.diff(key[where])) + 1):
                    if len(at):
                        yield int(key[at[0]]), blobs.pack(ids[at], values[at].ravel())

            cell, _ = nearest(values, points)
            _, high = bounds(values)
            for g in range(len(held)):
                sent = np.flatnonzero(reaching[cell, g] & (high[:, g] >= needed[g]))
                for slice_, packed in stretches(sent, slice_of):
                    out += [(g, block, slice_, 1, packed) for block in range(blocks[g])]
            for p in np.unique(cell[asks]):
                g = group_of[int(p)]
                mine = np.flatnonzero(asks & (cell == p))
                mine = mine[np.argsort(deal[mine] % blocks[g], kind="stable")]
                for block, packed in stretches(mine, deal % blocks[g]):
                    out += [(g, block, slice_, 0, packed) for slice_ in range(slices)]
            yield pd.DataFrame(out, columns=["grp", "block", "slice", "side", "cell"])

    deal = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40))
    return rows.withColumn("deal", deal).mapInPandas(dealt, "grp int, block int, slice int, side int, cell binary"), width


def top_k(
    vectors: DataFrame,
    queries: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    pivots: int = PIVOTS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of every row that ``queries`` selects.

    Candidates are all rows but those with the query's own id; fewer than k are returned if
    there are fewer. Ties go to the smaller id. An id that repeats counts once: the best
    score among its rows, on either side. Void vectors (see ``whole_vectors``) take no
    part; components that a shorter vector lacks count as zero, so an empty vector scores
    zero. Empty tables give no rows. Other columns are not carried.
    """
    routes = routed(vectors, queries, k, id_col, vector_col, pivots)
    if routes is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    cells, width = routes

    def solved(met: pa.Table) -> pa.Table:
        return solve(met, k, width)

    tops = (
        cells
        .groupBy("grp", "block", "slice")
        .applyInArrow(solved, "query_id long, vec_id long, score long")
        .groupBy("query_id", "vec_id")
        .agg(F.max("score").alias("score"))
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return tops.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
