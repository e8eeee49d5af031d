"""Expressions over arrays that hold a one-dimensional profile."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _a(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(body: Callable[[Column], Column], **values: Column) -> Column:
    """``body`` of a struct of ``values``, each computed once; as plain columns they would be computed again at every use, and in every step of a lambda."""
    return F.get(F.transform(F.array(F.struct(*(v.alias(n) for n, v in values.items()))), body), F.lit(0))


def total(a) -> Column:
    return F.aggregate(_a(a), F.lit(0.0), lambda s, x: s + x)


def mean(a) -> Column:
    """Null for an empty array."""
    return let(lambda s: F.when(F.size(s["a"]) > 0, total(s["a"]) / F.size(s["a"])), a=_a(a))


def deviation(a) -> Column:
    """Population standard deviation, from the sum of squared differences to the mean."""
    squares = lambda s: F.transform(s["a"], lambda x: (x - s["m"]) * (x - s["m"]))
    return let(lambda s: let(lambda s: F.sqrt(mean(squares(s))), a=s["a"], m=mean(s["a"])), a=_a(a))


def argmax(a) -> Column:
    """Index of the first greatest element, from 0."""
    return F.array_position(_a(a), F.array_max(_a(a))) - 1


def argmin(a) -> Column:
    return F.array_position(_a(a), F.array_min(_a(a))) - 1


def share_above(a, limit) -> Column:
    limit = limit if isinstance(limit, Column) else F.lit(limit)
    return let(lambda s: F.when(F.size(s["a"]) > 0, F.size(F.filter(s["a"], lambda x: x > s["limit"])) / F.size(s["a"])), a=_a(a), limit=limit)


def adaptive_limit(a, floor: float, factor: float) -> Column:
    """The larger of ``floor`` and mean + factor x deviation."""
    return F.greatest(F.lit(floor), mean(a) + factor * deviation(a))


def differences(a) -> Column:
    """Each element minus the one before it."""
    a = _a(a)
    n = F.size(a)
    return F.when(n > 1, F.zip_with(F.slice(a, 2, n - 1), F.slice(a, 1, n - 1), lambda x, y: x - y)).otherwise(F.array().cast("array<double>"))


def moving_average(a, width: int = 11) -> Column:
    """Centred mean over ``width`` elements; beyond the ends there are zeros, and the sum is always over ``width``."""
    zeros = F.array_repeat(F.lit(0.0), width // 2)
    means = lambda s: F.transform(s["a"], lambda x, k: total(F.slice(s["padded"], k + 1, width)) / float(width))
    return let(lambda s: let(means, a=s["a"], padded=F.concat(zeros, s["a"], zeros)), a=_a(a))


def residual(a, width: int = 11) -> Column:
    """Distance of each element from the moving average."""
    return let(lambda s: F.zip_with(s["a"], moving_average(s["a"], width), lambda x, y: F.abs(x - y)), a=_a(a))


def longest_run(a, limit: float) -> Column:
    """Length of the longest run of elements above ``limit``."""
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))

    def step(s, x):
        now = F.when(x > limit, s["now"] + 1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(s["best"], now).alias("best"))

    return F.aggregate(_a(a), zero, step, lambda s: s["best"])


def peaks(a, most: int = 8, distance: int = 5) -> Column:
    """Indices (from 0) of up to ``most`` peaks, the greatest first: each takes the greatest element that is left, the first
    of equals, and blanks out all within ``distance`` of it; none that is 0 or less is a peak.
    """

    def step(s: Column, _: Column) -> Column:
        top = F.array_max(s["left"])
        at = (F.array_position(s["left"], top) - 1).cast("int")
        left = F.transform(s["left"], lambda x, k: F.when(F.abs(k - at) <= distance, 0.0).otherwise(x))
        return F.when(top > 0, F.struct(left.alias("left"), F.array_append(s["found"], at).alias("found"))).otherwise(s)

    zero = F.struct(_a(a).alias("left"), F.array().cast("array<int>").alias("found"))
    return F.when(_a(a).isNotNull(), F.aggregate(F.sequence(F.lit(1), F.lit(most)), zero, step, lambda s: s["found"]))


def window_peak(a, lo: float, hi: float) -> Column:
    """The greatest element between two shares of the array's length."""
    a = _a(a)
    first = F.floor(F.size(a) * lo).cast("int")
    return F.array_max(F.slice(a, first + 1, F.greatest(F.floor(F.size(a) * hi).cast("int") - first, F.lit(1))))
