"""Probability functions as column expressions: normal and Student tails.

They run on the few rows of a fitted series, as higher-order functions over a
generated sequence, and need no Python worker.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NORMAL_TERMS = 150
# From here on the normal tail comes from its continued fraction, not as a difference to 1.
TAIL_FROM = 3.0
TAIL_TERMS = 120
# Terms of the Student tail; used where each is less than half of the one before.
STUDENT_TAIL_TERMS = 200
QUANTILE_STEPS = 80


def _normal_density(z: Column) -> Column:
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi)


def _far_normal_tail(z: Column) -> Column:
    """P(Z > z) for z >= TAIL_FROM: density / (z + 1/(z + 2/(z + 3/...)))."""
    steps = F.sequence(F.lit(TAIL_TERMS), F.lit(1), F.lit(-1))
    return _normal_density(z) / F.aggregate(steps, z, lambda below, k: z + k / below)


def normal_cdf(z: Column) -> Column:
    """P(Z <= z): 1/2 + density(z) * sum of z^(2k+1) / (1*3*...*(2k+1))."""
    z = z.cast("double")
    start = F.struct(z.alias("term"), z.alias("total"))

    def add_term(acc: Column, k: Column) -> Column:
        term = acc["term"] * z * z / (2 * k + 1)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(NORMAL_TERMS)), start, add_term, lambda acc: acc["total"]
    )
    inside = F.lit(0.5) + _normal_density(z) * series
    return (
        F.when(z >= TAIL_FROM, 1 - _far_normal_tail(z))
        .when(z <= -TAIL_FROM, _far_normal_tail(-z))
        .when(z.isNotNull(), inside)
    )


def normal_two_sided(z: Column) -> Column:
    """P(|Z| >= |z|), exact in relative terms however far out; NULL for NULL."""
    size = F.abs(z.cast("double"))
    return F.when(size >= TAIL_FROM, 2 * _far_normal_tail(size)).when(
        size.isNotNull(), 2 * (1 - normal_cdf(size))
    )


def student_central(t: Column, df: Column) -> Column:
    """P(|T| <= |t|) for whole degrees of freedom: the finite cosine series
    (Abramowitz & Stegun 26.7.3 and 26.7.4)."""
    df = df.cast("int")
    theta = F.atan(F.abs(t) / F.sqrt(df.cast("double")))
    cos, sin = F.cos(theta), F.sin(theta)
    odd = df % 2 == 1
    first = F.when(odd, cos).otherwise(F.lit(1.0))
    count = F.when(odd, (df - 3) / 2).otherwise((df - 2) / 2).cast("int")
    steps = F.when(count > 0, F.sequence(F.lit(1), F.greatest(count, F.lit(1)))).otherwise(
        F.array().cast("array<int>")
    )

    def add_term(acc: Column, j: Column) -> Column:
        ratio = F.when(odd, 2 * j / (2 * j + 1)).otherwise((2 * j - 1) / (2 * j))
        term = acc["term"] * ratio * cos * cos
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    start = F.struct(first.alias("term"), first.alias("total"))
    series = F.aggregate(steps, start, add_term, lambda acc: acc["total"])
    odd_value = F.when(df == 1, theta).otherwise(theta + sin * series) * (2 / math.pi)
    return F.when((df >= 1) & t.isNotNull(), F.when(odd, odd_value).otherwise(sin * series))


def _far_student_tail(t: Column, df: Column) -> Column:
    """P(|T| >= |t|) as the rest of the cosine series, which sums to 1 over all its terms."""
    df = df.cast("int")
    theta = F.atan(F.abs(t) / F.sqrt(df.cast("double")))
    # The cosine far out, without the loss of cos near a right angle.
    cos = 1 / F.sqrt(1 + t * t / df)
    odd = df % 2 == 1
    first = F.floor(df / 2).cast("int")

    def ratio(j: Column) -> Column:
        return F.when(odd, 2 * j / (2 * j + 1)).otherwise((2 * j - 1) / (2 * j))

    none = F.array().cast("array<int>")
    before = F.when(first > 0, F.sequence(F.lit(1), F.greatest(first, F.lit(1)))).otherwise(none)
    start = F.aggregate(
        before,
        F.when(odd, cos).otherwise(F.lit(1.0)),
        lambda term, j: term * ratio(j) * cos * cos,
    )

    def add_term(acc: Column, k: Column) -> Column:
        term = acc["term"] * ratio(first + k) * cos * cos
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    rest = F.aggregate(
        F.sequence(F.lit(1), F.lit(STUDENT_TAIL_TERMS)),
        F.struct(start.alias("term"), start.alias("total")),
        add_term,
        lambda acc: acc["total"],
    )
    return F.sin(theta) * rest * F.when(odd, F.lit(2 / math.pi)).otherwise(F.lit(1.0))


def student_two_sided(t: Column, df: Column) -> Column:
    """P(|T| >= |t|), exact in relative terms far out; NULL for NULL or less than one
    degree of freedom."""
    t = t.cast("double")
    known = t.isNotNull() & (df >= 1)
    return F.when(known & (t * t > df), _far_student_tail(t, df)).when(
        known, 1 - student_central(t, df)
    )


def student_quantile(level: float, df: Column) -> Column:
    """t with P(|T| <= t) = level, by bisection of the angle whose tangent is t / sqrt(df):
    no level is out of reach."""
    start = F.struct(F.lit(0.0).alias("low"), F.lit(math.pi / 2).alias("high"))
    scale = F.sqrt(df.cast("double"))

    def halve(acc: Column, _: Column) -> Column:
        middle = (acc["low"] + acc["high"]) / 2
        below = student_two_sided(scale * F.tan(middle), df) > 1 - level
        return F.struct(
            F.when(below, middle).otherwise(acc["low"]).alias("low"),
            F.when(below, acc["high"]).otherwise(middle).alias("high"),
        )

    angle = F.aggregate(
        F.sequence(F.lit(1), F.lit(QUANTILE_STEPS)),
        start,
        halve,
        lambda acc: (acc["low"] + acc["high"]) / 2,
    )
    return F.when(df >= 1, scale * F.tan(angle))
