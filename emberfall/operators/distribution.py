"""Shape of a measure: histogram, densities, box statistics, local regression.

Points are reduced before anything is evaluated on a grid: to bins, to grid
weights, to distinct abscissae or to partial sums of a task. ``by`` names the
groups; ``range_by``, a part of ``by``, the groups that share an axis.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberfall.functions.measures import is_finite
from emberfall.operators.ranks import exact_quantiles, positions_of_counts
from emberfall.workspace import deal, materialise

# Fixed values of the normal reference rules for a kernel bandwidth.
RULE_1D = 0.9
RULE_2D = 1.06
IQR_TO_SD = 1.34
# The bin width of an axis of one value, and the share of a width by which a
# value may exceed an edge.
FLAT_WIDTH = 0.1
EDGE_SLACK = 1e-8
# Places in order that one window of the local regression covers.
POINTS_IN_BLOCK = 4096
# Points of one group in the 2-D density that one part of it holds: about as many bytes as
# the grid that the part becomes.
POINTS_IN_PART = 2048


def _with_range(groups: DataFrame, points: DataFrame, value: str, range_by: Sequence[str],
                low: str, high: str) -> DataFrame:
    """Add the axis range of ``value`` to every group."""
    bounds = points.groupBy(*range_by).agg(F.min(value).alias(low), F.max(value).alias(high))
    if range_by:
        return groups.join(bounds, list(range_by))
    return groups.withColumn(low, bounds.select(low).scalar()).withColumn(
        high, bounds.select(high).scalar()
    )


def histogram(
    df: DataFrame, value: str, by: Sequence[str], bins: int, range_by: Sequence[str] = ()
) -> DataFrame:
    """Equal-width bins over the axis range with counts and densities; empty bins included.

    The first bin is centred on the lowest value and the last on the highest, so the width
    is the range over ``bins - 1``. Bins are closed on the right; a value that exceeds an
    edge by rounding alone counts below it. A single bin covers the range itself. An axis
    of one value has bins of width ``FLAT_WIDTH``, the first around the value.
    """
    by = list(by)
    points = df.filter(is_finite(F.col(value))).select(*by, F.col(value).alias("_v"))
    groups = points.groupBy(*by).agg(F.count("*").alias("_n"))
    groups = _with_range(groups, points, "_v", range_by, "_low", "_high")
    reach = F.col("_high") - F.col("_low")
    width = F.when(reach == 0, F.lit(FLAT_WIDTH)).otherwise(reach / max(bins - 1, 1))
    start = F.col("_low") - F.when((reach > 0) & F.lit(bins == 1), 0.0).otherwise(F.col("_w") / 2)
    groups = groups.withColumn("_w", width).withColumn("_start", start)
    groups = materialise(groups.select(*by, "_n", "_w", "_start"), "ranges")
    place = F.ceil((F.col("_v") - F.col("_start")) / F.col("_w") - EDGE_SLACK)
    filled = (
        points.join(groups, by)
        .withColumn("bin", F.greatest(F.least(place, F.lit(bins)), F.lit(1)).cast("int"))
        .groupBy(*by, "bin")
        .agg(F.count("*").alias("_count"))
    )
    frame = groups.withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(bins))))
    count = F.coalesce(F.col("_count"), F.lit(0))
    return frame.join(filled, [*by, "bin"], "left").select(
        *by,
        "bin",
        (F.col("_start") + (F.col("bin") - 1) * F.col("_w")).alias("bin_low"),
        (F.col("_start") + F.col("bin") * F.col("_w")).alias("bin_high"),
        count.alias("count"),
        (count.cast("double") / (F.col("_n") * F.col("_w"))).alias("density"),
    )


def _spread(points: DataFrame, value: str, by: list[str]) -> DataFrame:
    """n, deviation and interquartile range of a measure per group of two or more."""
    quartiles = exact_quantiles(points, value, {"_q25": 0.25, "_q75": 0.75}, by, "_n")
    moments = points.groupBy(*by).agg(
        F.stddev_samp(value).alias("_sd"), F.max(F.abs(F.col(value))).alias("_size")
    )
    return (
        quartiles.join(moments, by)
        .withColumn("_iqr", F.col("_q75") - F.col("_q25"))
        .filter(F.col("_n") >= 2)
        .select(*by, "_n", "_sd", "_iqr", "_size")
    )


def kde_1d(
    df: DataFrame,
    value: str,
    by: Sequence[str],
    range_by: Sequence[str] = (),
    points: int = 512,
) -> DataFrame:
    """Gaussian kernel density per group on an even grid over the axis range.

    Every value is shared linearly between the two nearest of ``points`` knots,
    which reach four bandwidths beyond the axis; the kernel then runs over knots,
    so the cost on the grid does not depend on the number of rows. A group is one row by
    then: an array of weighted knots, convolved with the kernel.
    """
    by = list(by)
    last = points - 1
    values = df.filter(is_finite(F.col(value))).select(*by, value)
    spread = _spread(values, value, by)
    narrow = F.least("_sd", F.col("_iqr") / IQR_TO_SD)
    scale = (
        F.when(narrow > 0, narrow)
        .when(F.col("_sd") > 0, F.col("_sd"))
        .when(F.col("_size") > 0, F.col("_size"))
        .otherwise(F.lit(1.0))
    )
    groups = spread.withColumn("_bw", RULE_1D * scale * F.pow(F.col("_n"), F.lit(-0.2)))
    groups = _with_range(groups, values, value, range_by, "_low", "_high")
    groups = groups.withColumn("_first", F.col("_low") - 4 * F.col("_bw")).withColumn(
        "_delta", (F.col("_high") - F.col("_low") + 8 * F.col("_bw")) / last
    )
    groups = materialise(groups.select(*by, "_n", "_bw", "_low", "_high", "_first", "_delta"), "axes")

    place = (F.col(value) - F.col("_first")) / F.col("_delta")
    knot = F.floor(place).cast("int")
    shares = F.array(
        F.struct(knot.alias("_knot"), (1 - (place - knot)).alias("_weight")),
        F.struct((knot + 1).alias("_knot"), (place - knot).alias("_weight")),
    )
    weights = (
        values.join(groups, by)
        .select(*by, F.explode(shares).alias("_share"))
        .groupBy(*by, F.col("_share._knot").alias("_knot"))
        .agg(F.sum("_share._weight").alias("_weight"))
    )
    # One row per group: the kernel by distance in knots, its convolution with the weights, and
    # the grid read from that. Nothing is laid out before the sums are taken.
    knots = weights.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_knot", "_weight"))).alias("_knots"))
    scaled = "(d * _delta / _bw)"
    kernel = f"transform(sequence(0, {points}), d -> exp(-{scaled} * {scaled} / 2) / (_bw * sqrt(2 * pi())))"
    summed = f"transform(sequence(0, {points}), k -> aggregate(_knots, 0D, (s, w) -> s + w._weight * get(kern, abs(k - w._knot))))"
    summed = f"get(transform(array({kernel}), kern -> {summed}), 0)"
    x = f"(_low + (_high - _low) * i / {last})"
    spot = f"(({x} - _first) / _delta)"
    read = f"(1 - ({spot} - floor({spot}))) * get(conv, INT(floor({spot}))) + ({spot} - floor({spot})) * get(conv, INT(floor({spot})) + 1)"
    grid = f"transform(sequence(0, {last}), i -> named_struct('i', i, 'x', {x}, 'density', ({read}) / _n))"
    grid = f"get(transform(array({summed}), conv -> {grid}), 0)"
    return knots.join(groups, by).select(*by, F.expr(grid).alias("_grid")).select(*by, F.inline("_grid"))


def _grid_sums(by: list[str], points: int):
    """Sum of product kernels on the grid for the points of one task, per group."""

    def emit(key: tuple, total: np.ndarray, schema_key: list[str]) -> pd.DataFrame:
        ix, iy = np.divmod(np.arange(points * points), points)
        out = pd.DataFrame({name: [part] * len(ix) for name, part in zip(schema_key, key)})
        out["ix"], out["iy"], out["part"] = ix, iy, total.ravel()
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Rows come sorted by group, so one grid is held at a time.
        held, total = None, None
        for batch in batches:
            for key, rows in batch.groupby(by, sort=False, dropna=False):
                first = rows.iloc[0]
                gx = np.linspace(first["_x_low"], first["_x_high"], points)
                gy = np.linspace(first["_y_low"], first["_y_high"], points)
                zx = (gx[:, None] - rows["_x"].to_numpy()) / first["_hx"]
                zy = (gy[:, None] - rows["_y"].to_numpy()) / first["_hy"]
                part = (np.exp(-zx * zx / 2) * rows["_m"].to_numpy()) @ np.exp(-zy * zy / 2).T
                if held == key:
                    total += part
                    continue
                if held is not None:
                    yield emit(held, total, by)
                held, total = key, part
        if held is not None:
            yield emit(held, total, by)

    return run


def _dealt_points(pairs: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """Distinct points with their counts and their group's axes, dealt by group and part."""
    counted = pairs.groupBy(*by, "_x", "_y").agg(F.count("*").alias("_m"))
    source = counted.join(groups, by)
    part = F.pmod(F.xxhash64("_x", "_y"), F.ceil(F.col("_n") / POINTS_IN_PART))
    columns = ["_x", "_y", "_m", "_hx", "_hy", "_x_low", "_x_high", "_y_low", "_y_high"]
    return deal(source.select(*by, *columns, part.alias("_part")), *by, "_part").drop("_part")


def kde_2d(
    df: DataFrame,
    x: str,
    y: str,
    by: Sequence[str],
    range_by: Sequence[str] = (),
    points: int = 100,
) -> DataFrame:
    """Gaussian product-kernel density on a square grid; ``ndensity`` has maximum 1.

    Equal points are counted first. The kernel sum of a batch is one matrix product of two
    grid-by-points tables, so a task adds its points up in numpy and only grid sums are
    shuffled, combined by task. A group is dealt in as many parts as it has POINTS_IN_PART
    points: a task holds one grid at a time and gives one per group it meets, small groups
    have one, and a large group is shared by all tasks, however many there are. Groups
    without spread in either measure have no density and do not appear.
    """
    by = list(by)
    pairs = df.filter(is_finite(F.col(x)) & is_finite(F.col(y))).select(
        *by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")
    )
    axes = pairs.select(
        *by,
        F.explode(
            F.array(
                *[F.struct(F.lit(a).alias("_axis"), F.col(a).alias("_value")) for a in ("_x", "_y")]
            )
        ).alias("cell"),
    ).select(*by, "cell.*")
    narrow = F.least("_sd", F.col("_iqr") / IQR_TO_SD)
    rules = _spread(axes, "_value", [*by, "_axis"]).withColumn(
        "_h", RULE_2D * narrow * F.pow(F.col("_n"), F.lit(-0.2))
    )
    rules = _with_range(rules, axes, "_value", [*range_by, "_axis"], "_low", "_high")

    def of_axis(axis: str, name: str) -> Column:
        return F.max(F.when(F.col("_axis") == axis, F.col(name)))

    groups = rules.groupBy(*by).agg(
        F.max("_n").alias("_n"),
        of_axis("_x", "_h").alias("_hx"),
        of_axis("_y", "_h").alias("_hy"),
        of_axis("_x", "_low").alias("_x_low"),
        of_axis("_x", "_high").alias("_x_high"),
        of_axis("_y", "_low").alias("_y_low"),
        of_axis("_y", "_high").alias("_y_high"),
    )
    groups = materialise(groups.filter((F.col("_hx") > 0) & (F.col("_hy") > 0)), "axes")

    dealt = _dealt_points(pairs, groups, by)
    keys = [dealt.schema[c] for c in by]
    schema = T.StructType(
        [
            *keys,
            T.StructField("ix", T.IntegerType()),
            T.StructField("iy", T.IntegerType()),
            T.StructField("part", T.DoubleType()),
        ]
    )
    sums = (
        dealt.sortWithinPartitions(*by)
        .mapInPandas(_grid_sums(by, points), schema)
        .groupBy(*by, "ix", "iy")
        .agg(F.sum("part").alias("total"))
    )
    density = F.col("total") / (2 * math.pi * F.col("_n") * F.col("_hx") * F.col("_hy"))
    placed = sums.join(groups, by).select(
        *by,
        "ix",
        "iy",
        (F.col("_x_low") + (F.col("_x_high") - F.col("_x_low")) * F.col("ix") / (points - 1)).alias("x"),
        (F.col("_y_low") + (F.col("_y_high") - F.col("_y_low")) * F.col("iy") / (points - 1)).alias("y"),
        density.alias("density"),
    )
    peak = F.max("density").over(Window.partitionBy(*by))
    return placed.withColumn("ndensity", F.try_divide(F.col("density"), peak))


def _fences(df: DataFrame, value: str, by: list[str], reach: float) -> DataFrame:
    quartiles = exact_quantiles(df, value, {"q25": 0.25, "median": 0.5, "q75": 0.75}, by)
    step = reach * (F.col("q75") - F.col("q25"))
    return materialise(
        quartiles.withColumn("fence_low", F.col("q25") - step).withColumn(
            "fence_high", F.col("q75") + step
        ),
        "fences",
    )


def box_stats(df: DataFrame, value: str, by: Sequence[str], reach: float = 1.5) -> DataFrame:
    """Quartiles, whiskers to the last value within the fences, number of outliers."""
    by = list(by)
    points = df.filter(is_finite(F.col(value))).select(*by, value)
    fenced = points.join(_fences(points, value, by, reach), by)
    inside = F.col(value).between(F.col("fence_low"), F.col("fence_high"))
    kept = F.when(inside, F.col(value))
    return fenced.groupBy(*by, "q25", "median", "q75", "n").agg(
        F.least(F.min(kept), F.first("q25")).alias("whisker_low"),
        F.greatest(F.max(kept), F.first("q75")).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"),
    )


def box_outliers(
    df: DataFrame, value: str, by: Sequence[str], keep: Sequence[str], reach: float = 1.5
) -> DataFrame:
    """Rows beyond the fences of their group."""
    by = list(by)
    points = df.filter(is_finite(F.col(value))).select(*by, *keep, value)
    fenced = points.join(_fences(points, value, by, reach), by)
    inside = F.col(value).between(F.col("fence_low"), F.col("fence_high"))
    return fenced.filter(~inside).select(*by, *keep, value)


def quantile_limits(df: DataFrame, measures: Sequence[str], low: float = 0.01,
                    high: float = 0.99) -> DataFrame:
    """Two quantiles of each measure over all rows: one row per measure."""
    long = df.select(
        F.explode(
            F.array(
                *[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in measures]
            )
        ).alias("cell")
    ).select("cell.*")
    return exact_quantiles(long, "value", {"low": low, "high": high}, ["measure"])


def _cube(c: Column) -> Column:
    return c * c * c


def _near_count(n: Column, span: float) -> Column:
    """How many points of ``n`` a neighbourhood holds."""
    return F.greatest(F.least(F.floor(n * span + 1e-5), n), F.lit(1))


def _reach_ends(places: DataFrame, by: list[str], span: float) -> DataFrame:
    """(low end, high end) of every run of as many neighbouring points as a neighbourhood
    holds, one per distinct abscissa that starts one.

    The point at the far end is looked up by its place in blocks of POINTS_IN_BLOCK places:
    a block's window holds the abscissae that have places in it, and who asks for one.
    """
    near = _near_count(F.col("n_group"), span)
    far = F.col("n_less") + near - 1
    block = lambda c: F.floor(c / POINTS_IN_BLOCK)
    held = places.withColumn(
        "_block", F.explode(F.sequence(block(F.col("n_less")), block(F.col("n_less") + F.col("n_equal") - 1)))
    )
    held = held.select(
        *by, "_block", F.greatest("n_less", F.col("_block") * POINTS_IN_BLOCK).alias("_at"), F.lit(0).alias("_asks"), F.col("x").alias("_high"), F.lit(None).cast("double").alias("_low")
    )
    asked = places.filter(far < F.col("n_group")).select(
        *by, block(far).alias("_block"), far.alias("_at"), F.lit(1).alias("_asks"), F.lit(None).cast("double").alias("_high"), F.col("x").alias("_low")
    )
    along = Window.partitionBy(*by, "_block").orderBy("_at", "_asks").rowsBetween(Window.unboundedPreceding, 0)
    found = held.unionByName(asked).withColumn("_high", F.last("_high", ignorenulls=True).over(along))
    return found.filter("_asks = 1").select(*by, "_low", "_high")


def _grid_reach(places: DataFrame, by: list[str], span: float, points: int) -> DataFrame:
    """Grid points of each group and the distance to the farthest of their neighbours.

    Of all runs of neighbouring points, the nearest to a grid point is the last whose middle
    does not lie beyond it, or the first whose middle does. Runs are reduced to the last and
    the first between two grid points, so that a window holds one row per grid point.
    """
    last = points - 1
    ranges = places.groupBy(*by).agg(F.min("x").alias("_first"), F.max("x").alias("_last"))
    ranges = materialise(ranges, "x-ranges")
    ends = _reach_ends(places, by, span).join(ranges, by)
    step = (F.col("_last") - F.col("_first")) / last
    place = F.ceil(F.try_divide((F.col("_low") + F.col("_high")) / 2 - F.col("_first"), step))
    place = F.least(F.greatest(F.coalesce(place, F.lit(0)), F.lit(0)), F.lit(points)).cast("int")
    ends = ends.groupBy(*by, place.alias("i")).agg(
        F.max(F.struct("_low", "_high")).alias("_below"), F.min(F.struct("_high", "_low")).alias("_above")
    )
    grid = ranges.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points)))).join(ends, [*by, "i"], "left")
    along = Window.partitionBy(*by).orderBy("i")
    grid = grid.withColumn("_below", F.max("_below").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    grid = grid.withColumn("_above", F.min("_above").over(along.rowsBetween(1, Window.unboundedFollowing)))
    grid = grid.filter(F.col("i") < points).withColumn(
        "x0", F.col("_first") + (F.col("_last") - F.col("_first")) * F.col("i") / last
    )
    away = lambda c: F.greatest(F.col("x0") - F.col(f"{c}._low"), F.col(f"{c}._high") - F.col("x0"))
    return grid.select(*by, "i", "x0", F.least(away("_below"), away("_above")).alias("radius"))


def loess_curve(
    df: DataFrame, y: str, x: str, by: Sequence[str], span: float = 0.75, points: int = 80
) -> DataFrame:
    """Local quadratic fit with tricube weights on an even grid over the x range.

    Weights depend on x alone, so rows are first reduced to the count and the sum of y per
    distinct x. The distance that a grid point reaches comes from places in order, block by
    block; a distinct x then meets only the grid points that reach it, and their sums are
    combined before the shuffle. No window or task holds a group. A neighbourhood of two
    distinct x is fitted by a line, one of a single x by its mean.
    """
    by = list(by)
    reduced = (
        df.filter(is_finite(F.col(y)) & is_finite(F.col(x)))
        .groupBy(*by, F.col(x).cast("double").alias("x"))
        .agg(F.count("*").alias("n_equal"), F.sum(y).alias("y_sum"))
    )
    places = materialise(positions_of_counts(reduced, "x", by), "abscissae")
    grid = _grid_reach(places, by, span, points)
    spots = grid.groupBy(*by).agg(F.collect_list(F.struct("i", "x0", "radius")).alias("spots"))
    distance = lambda s: F.abs(F.col("x") - s["x0"])
    reached = F.filter(
        "spots", lambda s: (distance(s) < s["radius"] * 0.999) | (distance(s) <= s["radius"] * 0.001)
    )
    at = (
        places.join(spots, by)
        .select(*by, "x", F.col("n_equal").alias("m"), "y_sum", F.explode(reached).alias("spot"))
        .select(*by, "x", "m", "y_sum", "spot.*")
        .withColumn("distance", F.abs(F.col("x") - F.col("x0")))
    )
    d, r = F.col("distance"), F.col("radius")
    weight = (
        F.when(d <= r * 0.001, F.lit(1.0))
        .when(d < r * 0.999, _cube(1 - _cube(d / r)))
        .otherwise(F.lit(0.0))
    )
    at = at.withColumn("w", weight).filter(F.col("w") > 0)
    u = F.when(r > 0, (F.col("x") - F.col("x0")) / r).otherwise(F.lit(0.0))
    at = at.withColumn("u", u)
    powers = [F.lit(1.0)]
    for _ in range(4):
        powers.append(powers[-1] * F.col("u"))
    sums = at.groupBy(*by, "i", "x0").agg(
        F.count("*").alias("k"),
        *[F.sum(F.col("w") * F.col("m") * p).alias(f"s{j}") for j, p in enumerate(powers)],
        *[F.sum(F.col("w") * F.col("y_sum") * p).alias(f"t{j}") for j, p in enumerate(powers[:3])],
    )
    s0, s1, s2, s3, s4 = (F.col(f"s{j}") for j in range(5))
    t0, t1, t2 = (F.col(f"t{j}") for j in range(3))
    det3 = s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)
    top3 = t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2)
    line = F.try_divide(t0 * s2 - t1 * s1, s0 * s2 - s1 * s1)
    mean = t0 / s0
    fit = (
        F.when(F.col("k") >= 3, F.coalesce(F.try_divide(top3, det3), line, mean))
        .when(F.col("k") == 2, F.coalesce(line, mean))
        .otherwise(mean)
    )
    return sums.select(*by, "i", F.col("x0").alias("x"), fit.alias("fit"))
