"""Per-row measures of a compound day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def event_intensity(heat_percentile: Column, rain_percentile: Column) -> Column:
    """Product of two percentiles on the 0 to 100 scale."""
    return heat_percentile * rain_percentile / 100


def relative_excess(value: Column, threshold: Column) -> Column:
    """Part of ``value`` above the threshold, relative to it; NULL unless threshold > 0.

    ``greatest`` ignores NULL, so a NULL value is kept NULL explicitly.
    """
    above = F.greatest(value - threshold, F.lit(0.0)) / threshold
    return F.when((threshold > 0) & value.isNotNull(), above)


def relative_anomaly(value: Column, threshold: Column) -> Column:
    """Signed distance from the threshold, relative to it; NULL unless threshold > 0."""
    return F.when(threshold > 0, (value - threshold) / threshold)


def _bound(x: float) -> str:
    return f"{x:g}"


def cut_bins(value: Column, breaks: Sequence[float]) -> Column:
    """Right-closed interval label; the lowest break is included, outside is NULL."""
    label = F.lit(None).cast("string")
    pairs = list(zip(breaks[:-1], breaks[1:]))
    for low, high in reversed(pairs[1:]):
        text = f"({_bound(low)},{_bound(high)}]"
        label = F.when((value > low) & (value <= high), F.lit(text)).otherwise(label)
    low, high = pairs[0]
    return F.when(
        (value >= low) & (value <= high), F.lit(f"[{_bound(low)},{_bound(high)}]")
    ).otherwise(label)


def class_breaks(value: Column, breaks: Sequence[float], limits: tuple[float, float]) -> Column:
    """Number of the break class of a value (1-based); NULL outside the limits.

    Classes are right-closed and the lowest limit is included. Breaks at or beyond
    a limit bound no class of their own.
    """
    low, high = limits
    inner = [b for b in sorted(breaks) if low < b < high]
    number = F.lit(1)
    for b in inner:
        number = number + (value > b).cast("int")
    return F.when((value >= low) & (value <= high), number)


def is_finite(value: Column) -> Column:
    """True for a number that is neither NULL, NaN nor infinite."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
