"""Numeric column expressions: clamping, null policies, rounding and plane geometry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def num(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def clamp(x, lo: float = 0.0, hi: float = 1.0) -> Column:
    """``x`` held between ``lo`` and ``hi``.  Clear NaN with ``safe`` first: to Spark it is greater than any number."""
    return F.least(F.greatest(num(x), F.lit(lo)), F.lit(hi))


def safe(x, default: float | None = 0.0) -> Column:
    """``default`` in place of null, NaN and infinities."""
    x = num(x).cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(default).cast("double")).otherwise(x)


def span(x, lo: float, hi: float) -> Column:
    """0 at ``lo``, 1 at ``hi``, straight between and held beyond; 0 if the range is empty."""
    return F.lit(0.0) if hi <= lo else clamp((num(x) - lo) / (hi - lo))


def quotient(a, b, least: float = 1e-6) -> Column:
    """a / b, or 0 where b is within ``least`` of 0."""
    return F.when(F.abs(num(b)) <= least, 0.0).otherwise(num(a) / num(b))


def rounded(x, digits: int) -> Column:
    """Half up at ``digits`` places by floor, which all engines agree on."""
    k = float(10**digits)
    return F.floor(num(x) * k + 0.5) / k


def steps(x, *bands: tuple[float, float], otherwise) -> Column:
    """The value of the first band whose limit ``x`` does not exceed."""
    return reduce(lambda rest, b: F.when(num(x) <= b[0], F.lit(b[1])).otherwise(rest), reversed(bands), num(otherwise))


def at_least(x, *bands: tuple[float, str | float], otherwise) -> Column:
    """The value of the first band whose limit ``x`` reaches."""
    return reduce(lambda rest, b: F.when(num(x) >= b[0], F.lit(b[1])).otherwise(rest), reversed(bands), F.lit(otherwise))


def mean(*xs) -> Column:
    return reduce(lambda a, b: a + b, map(num, xs)) / float(len(xs))


def balance(a, b) -> Column:
    """1 where a and b are equal, falling to 0; 0 where they sum to nothing."""
    total = num(a) + num(b)
    return F.when(total <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1.0 - F.abs(num(a) - num(b)) / total))


def aspect_quality(ratio, target: float = 0.715, tolerance: float = 0.10) -> Column:
    return clamp(1.0 - F.abs(num(ratio) - target) / tolerance)


# -- plane geometry: a box is (x1, y1, x2, y2), a quad four points in the order TL, TR, BR, BL ---------------------------


def box_area(b) -> Column:
    x1, y1, x2, y2 = map(num, b)
    return F.greatest(F.lit(0.0), x2 - x1) * F.greatest(F.lit(0.0), y2 - y1)


def iou(a, b) -> Column:
    """Intersection over union; 0 where the union is empty."""
    cut = (F.greatest(num(a[0]), num(b[0])), F.greatest(num(a[1]), num(b[1])), F.least(num(a[2]), num(b[2])), F.least(num(a[3]), num(b[3])))
    common = box_area(cut)
    return quotient(common, box_area(a) + box_area(b) - common)


def clip_box(b, width, height) -> tuple[Column, ...]:
    return tuple(F.least(F.greatest(num(v), F.lit(0.0)), num(m)) for v, m in zip(b, (width, height, width, height), strict=True))


def expand_box(b, ratio: float) -> tuple[Column, ...]:
    """The box grown on each side by ``ratio`` of its width or height."""
    x1, y1, x2, y2 = map(num, b)
    dx, dy = (x2 - x1) * ratio, (y2 - y1) * ratio
    return x1 - dx, y1 - dy, x2 + dx, y2 + dy


def shift_box(b, dx, dy) -> tuple[Column, ...]:
    return num(b[0]) + num(dx), num(b[1]) + num(dy), num(b[2]) + num(dx), num(b[3]) + num(dy)


def centre(b) -> tuple[Column, Column]:
    return (num(b[0]) + num(b[2])) / 2.0, (num(b[1]) + num(b[3])) / 2.0


def distance(p, q) -> Column:
    dx, dy = num(p[0]) - num(q[0]), num(p[1]) - num(q[1])
    return F.sqrt(dx * dx + dy * dy)


def quad_area(q) -> Column:
    """By the shoelace formula."""
    twice = reduce(lambda a, b: a + b, (num(q[k][0]) * num(q[(k + 1) % 4][1]) - num(q[(k + 1) % 4][0]) * num(q[k][1]) for k in range(4)))
    return F.abs(twice) / 2.0


def quad_sides(q) -> tuple[Column, ...]:
    """Lengths of the top, right, bottom and left side."""
    return tuple(distance(q[k], q[(k + 1) % 4]) for k in range(4))


def quad_aspect(q) -> Column:
    """Mean width over mean height, each one at least."""
    top, right, bottom, left = quad_sides(q)
    return F.greatest(F.lit(1.0), (top + bottom) / 2.0) / F.greatest(F.lit(1.0), (right + left) / 2.0)


def corner_angle(before, at, after) -> Column:
    """Degrees at ``at`` between the directions to the other two points; 0 where one coincides."""
    ax, ay, bx, by = num(before[0]) - num(at[0]), num(before[1]) - num(at[1]), num(after[0]) - num(at[0]), num(after[1]) - num(at[1])
    size = F.sqrt(ax * ax + ay * ay) * F.sqrt(bx * bx + by * by)
    return F.when(size <= 1e-6, 0.0).otherwise(F.degrees(F.acos(clamp((ax * bx + ay * by) / size, -1.0, 1.0))))


def line_angle_gap(a, b) -> Column:
    """The smaller angle between two line directions in degrees, which repeat every 180."""
    d = F.pmod(F.abs(num(a) - num(b)), F.lit(180.0))
    return F.least(d, 180.0 - d)


def ordered_points(points: Column) -> Column:
    """An array of four structs (x, y) as TL, TR, BR, BL: least and greatest x + y, least and greatest y - x."""
    pick = lambda key, last: F.element_at(F.array_sort(F.transform(points, lambda p: F.struct(key(p).alias("k"), p.alias("p")))), -1 if last else 1)["p"]
    total, slope = (lambda p: p["x"] + p["y"]), (lambda p: p["y"] - p["x"])
    return F.array(pick(total, False), pick(slope, False), pick(total, True), pick(slope, True))
