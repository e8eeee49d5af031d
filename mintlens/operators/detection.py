"""Which candidate outlines the card: a table of candidates, ranked by column expressions.

The raster pass only says what it sees: for every quad how its sides lie on edges, where evidence ends, which colours
lie on either side.  Here each candidate gets thirteen terms, penalties and hard rules, near-equal quads count once, and
an aggregate keeps the best of each image.  The steps are written once over ``get``, which gives a field as a column, so
they serve rows of a table (``ranked``) as well as the elements of an array within a row (``ranked_pool``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays
from ..functions.arrays import let
from ..functions.math import clamp, corner_angle, distance, line_angle_gap, num, quad_area, quad_aspect, quad_sides, steps
from .candidates import ASPECT, MIN_AREA, MIN_HEIGHT, MIN_VERTICAL_SUPPORT, MIN_WIDTH, SPREAD, SUPPORT, geometry_rules, hard_rules, one_at_least, plausible_outer_box, within_outer

POINTS = tuple(f"{p}_{a}" for p in ("tl", "tr", "br", "bl") for a in "xy")
SIDES = ("left", "right", "top", "bottom")
#: What is known of a candidate: where it is, the share of its outline on edges, along each side how near the next edge is
#: (0 to 1) and how much lies deeper inside, the box of the evidence within its own box, and five colour means (L, a, b,
#: saturation, value) inside and outside its outline.
CANDIDATE = f"source string, {', '.join(f'{p} double' for p in POINTS)}, edge_share double, {', '.join(f'near_{s} array<double>, deep_{s} array<double>' for s in SIDES)}, evidence array<double>, inner array<double>, outer array<double>"

# The weight of each term in a candidate's score.
WEIGHTS = {
    "area": 0.06, "outerness": 0.05, "aspect": 0.08, "centre": 0.03, "convex": 0.04, "edges": 0.22, "rectangularity": 0.18,
    "box_fit": 0.10, "size": 0.14, "silhouette": 0.22, "colour": 0.04, "touching": 0.12, "relative": 0.10,
}
# Weights and limits of a box found by its lines, and how far a second look reaches beyond the first box.
LINE_WEIGHTS, LINE_WIDTH, LINE_HEIGHT, MARGIN = (0.42, 0.26, 0.18, 0.14), (0.12, 0.75), (0.20, 0.92), 0.18

Get = Callable[[str], Column]


def side_support(near: Column, deep: Column) -> Column:
    """How well a side lies on an edge (0 to 1): the mean of what is near, less what goes on inside, and its longest run."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("sum"), F.lit(0).alias("now"), F.lit(0).alias("best"))

    def step(t: Column, x: Column) -> Column:
        now = F.when(x >= 0.45, t["now"] + 1).otherwise(0)
        return F.struct((t["n"] + 1).alias("n"), (t["sum"] + x).alias("sum"), now.alias("now"), F.greatest(t["best"], now).alias("best"))

    support = lambda t: F.when(t["n"] > 0, clamp(0.68 * (t["sum"] / t["n"]) + 0.32 * (t["best"] / t["n"])))
    return F.coalesce(F.aggregate(F.zip_with(near, deep, lambda n, d: clamp(n * (1.0 - 0.72 * d))), zero, step, support), F.lit(0.0))


def _quad(get: Get) -> list[tuple[Column, Column]]:
    return [(get(f"{p}_x"), get(f"{p}_y")) for p in ("tl", "tr", "br", "bl")]


def _first(get: Get, width: Column, height: Column) -> dict[str, Column]:
    """The box of the quad in whole pixels, supports of the sides, and shape."""
    q = _quad(get)
    xs, ys = [p[0] for p in q], [p[1] for p in q]
    hold = lambda v, lo, hi: F.least(F.greatest(v, lo), hi)
    zero, one = F.lit(0.0), F.lit(1.0)
    x1, y1 = hold(F.floor(F.least(*xs)).cast("double"), zero, F.greatest(zero, width - 1)), hold(F.floor(F.least(*ys)).cast("double"), zero, F.greatest(zero, height - 1))
    x2, y2 = hold(F.ceil(F.greatest(*xs)).cast("double"), x1 + 1, F.greatest(x1 + one, width)), hold(F.ceil(F.greatest(*ys)).cast("double"), y1 + 1, F.greatest(y1 + one, height))
    angle = lambda a, b: F.degrees(F.atan2(b[1] - a[1], b[0] - a[0]))
    turn = [(q[(k + 1) % 4][0] - q[k][0]) * (q[(k + 2) % 4][1] - q[(k + 1) % 4][1]) - (q[(k + 1) % 4][1] - q[k][1]) * (q[(k + 2) % 4][0] - q[(k + 1) % 4][0]) for k in range(4)]
    top, right, bottom, left = quad_sides(q)
    gap = lambda a, b: F.abs(a - b) / one_at_least(F.greatest(a, b))
    margins = F.array_sort(F.array(F.least(*xs), width - F.greatest(*xs), F.least(*ys), height - F.greatest(*ys)))
    i, o = get("inner"), get("outer")
    far = lambda k: F.abs(F.get(i, F.lit(k)) - F.get(o, F.lit(k)))
    chroma = F.sqrt(far(1) * far(1) + far(2) * far(2))
    return {
        "box": F.array(x1, y1, x2, y2),
        "share": quad_area(q) / one_at_least(width * height),
        "box_width": (F.greatest(*xs) - F.least(*xs)) / one_at_least(width),
        "box_height": (F.greatest(*ys) - F.least(*ys)) / one_at_least(height),
        "aspect_ratio": quad_aspect(q),
        "angle_deviation": sum((F.abs(corner_angle(q[k - 1], q[k], q[(k + 1) % 4]) - 90.0) for k in range(1, 4)), F.abs(corner_angle(q[3], q[0], q[1]) - 90.0)) / 4.0,
        "parallel_gap": (line_angle_gap(angle(q[0], q[1]), angle(q[3], q[2])) + line_angle_gap(angle(q[0], q[3]), angle(q[1], q[2]))) / 2.0,
        "width_gap": gap(top, bottom),
        "height_gap": gap(left, right),
        "margins": F.transform(margins, lambda m: m / one_at_least(F.least(width, height))),
        "centre": clamp(1.0 - distance((sum(xs[1:], xs[0]) / 4.0, sum(ys[1:], ys[0]) / 4.0), (width / 2.0, height / 2.0)) / distance((width / 2.0, height / 2.0), (0.0, 0.0))),
        "convex": F.when((F.least(*turn) >= 0) | (F.greatest(*turn) <= 0), 1.0).otherwise(0.0),
        "edges": F.least(F.lit(1.0), get("edge_share") / 0.30),
        "colour": F.coalesce(clamp(0.42 * far(0) / 255.0 + 0.28 * chroma / 181.0 + 0.15 * far(3) / 255.0 + 0.15 * far(4) / 255.0), F.lit(0.0)),
        **{f"{s}_support": side_support(get(f"near_{s}"), get(f"deep_{s}")) for s in SIDES},
    }


def _second(get: Get, width: Column, height: Column) -> dict[str, Column]:
    """Evidence, spread of the supports, and the terms of shape."""
    left, right, top, bottom = (get(f"{s}_support") for s in SIDES)
    upright, b, e = 0.5 * (left + right), get("box"), get("evidence")
    part = lambda lo, hi: F.coalesce(clamp((e[hi] - e[lo]) / one_at_least(b[hi] - b[lo])), F.lit(0.0))
    touches = F.size(F.filter(get("margins"), lambda m: m <= 0.0035))
    mean = (left + right + top + bottom) / 4.0
    silhouette = (0.40 * left + 0.40 * right + 0.10 * top + 0.10 * bottom) * F.when(upright < MIN_VERTICAL_SUPPORT, 0.55).otherwise(1.0) * F.when((F.greatest(top, bottom) < 0.08) & (upright < 0.30), 0.75).otherwise(1.0)
    return {
        "evidence_width": part(0, 2),
        "evidence_height": part(1, 3),
        "min_support": F.least(left, right, top, bottom),
        "support_spread": F.sqrt(((left - mean) * (left - mean) + (right - mean) * (right - mean) + (top - mean) * (top - mean) + (bottom - mean) * (bottom - mean)) / 4.0),
        "touch_count": touches,
        "trapezoid": F.least(F.lit(1.0), (0.7 * get("width_gap") + 0.3 * get("height_gap")) / 0.35),
        "silhouette": clamp(silhouette),
        "aspect": steps(F.abs(get("aspect_ratio") - ASPECT), (0.03, 1.0), (0.08, 0.75), (0.14, 0.45), otherwise=0.0),
        "area": F.when(get("share") < MIN_AREA, 0.0).when(get("share") < 0.20, 0.35).when(get("share") < 0.28, 0.65).when(get("share") < 0.55, 1.0).when(get("share") < 0.75, 0.55).otherwise(0.10),
        "outerness": F.when(touches >= 3, 0.0).otherwise((0.85 * F.least(F.lit(1.0), get("share") / 0.82) + 0.15 * F.least(F.lit(1.0), F.get(get("margins"), F.lit(1)) / 0.025)) * F.when(touches == 2, 0.70).when(touches == 1, 0.92).otherwise(1.0)),
        "size": clamp(0.40 * F.least(F.lit(1.0), get("share") / MIN_AREA) + 0.25 * F.least(F.lit(1.0), get("box_width") / MIN_WIDTH) + 0.35 * F.least(F.lit(1.0), get("box_height") / MIN_HEIGHT)),
        "box_fit": F.lit(1.0),
    }


def _third(outer: Column | None) -> Callable[[Get, Column, Column], dict[str, Column]]:
    """Coverage, rectangularity, geometry, and how the candidate lies in the box that lines tell (null: none)."""

    def step(get: Get, width: Column, height: Column) -> dict[str, Column]:
        ew, eh = get("evidence_width"), get("evidence_height")
        covered = clamp(0.42 * ew + 0.42 * eh + 0.16 * F.sqrt(ew * eh))
        square = 0.42 * F.greatest(F.lit(0.0), 1.0 - get("angle_deviation") / 25.0) + 0.33 * F.greatest(F.lit(0.0), 1.0 - get("parallel_gap") / 18.0)
        square = square + 0.25 * F.greatest(F.lit(0.0), 1.0 - (get("width_gap") + get("height_gap")) / 2.0 / 0.28) - 0.18 * get("trapezoid")
        g = geometry_rules(_quad(get), width, height, get("box_width"), get("box_height"), ew, eh, covered, get("min_support"), get("support_spread"))
        b = get("box")
        o = [F.get(outer, F.lit(k)) for k in range(4)] if outer is not None else [F.lit(None).cast("double")] * 4
        w = within_outer(_quad(get), [b[k] for k in range(4)], o)
        return {
            "covered": covered, "rectangularity": clamp(square), "known_outer": o[0].isNotNull(), "plausible": F.coalesce(plausible_outer_box([b[k] for k in range(4)], width, height), F.lit(False)),
            **{n: g[n] for n in ("geometry_valid", "geometry_penalty", "geometry_reasons")}, "is_internal": w["is_internal"], "border_distance": w["border_distance"], "relative_size": w["relative_size"], "touching": w["touches"].cast("double"),
        }

    return step


def _fourth(get: Get, width: Column, height: Column) -> dict[str, Column]:
    """Hard rules and penalties."""
    least, left, right, top, bottom = get("min_support"), *(get(f"{s}_support") for s in SIDES)
    rules = hard_rules(
        get("share"), get("box_width"), get("box_height"), left, right, top, bottom, get("silhouette"), least, get("geometry_valid"), get("trapezoid"), get("angle_deviation"), get("touch_count"), get("is_internal"),
        F.when(get("known_outer"), get("relative_size")),
    )
    factor = lambda cond, value: F.when(cond, value).otherwise(1.0)
    penalty = factor(get("share") > 0.98, 0.05) * factor(get("trapezoid") > 0.55, 0.72) * factor(get("angle_deviation") > 18.0, 0.85) * factor(get("size") < 0.92, 0.88)
    penalty = penalty * factor((top < 0.08) & (bottom < 0.08) & (F.greatest(left, right) < 0.35), 0.78)
    penalty = penalty * factor(get("geometry_penalty") > 0, F.greatest(F.lit(0.02), 1.0 - get("geometry_penalty")))
    penalty = penalty * F.when(least >= SUPPORT[0], clamp(0.78 + 0.22 * F.least(F.lit(1.0), least / 0.35))).otherwise(clamp(least / SUPPORT[0]))
    penalty = penalty * factor(get("support_spread") > SPREAD[0], 0.88) * factor(get("covered") < 0.72, 0.82)
    inside = factor(get("touching") < 0.5, 0.70) * clamp(1.05 - get("border_distance"), 0.10, 1.0) * clamp(get("relative_size") / 0.82, 0.12, 1.0)
    return {"hard_rules_ok": rules["hard_rules_ok"], "hard_fail_reasons": rules["hard_fail_reasons"], "penalty": penalty * F.when(get("known_outer"), inside).otherwise(1.0), "relative": F.least(F.lit(1.0), get("relative_size"))}


def _score(get: Get, width: Column, height: Column) -> dict[str, Column]:
    """Every term by its weight, held to 0 to 1; 0 where a hard rule fails."""
    terms = [w * get(n) for n, w in WEIGHTS.items()]
    total = clamp(sum(terms[1:], terms[0]) * get("penalty"))
    return {
        "score": F.when(get("hard_rules_ok"), total).otherwise(0.0),
        "cell": F.array(*(F.floor(get(p) * 10.0 + 0.5) for p in POINTS)),
    }


def _steps(outer: Column | None):
    return (_first, _second, _third(outer), _fourth, _score)


def ranked(candidates: DataFrame, width: str | Column = "width", height: str | Column = "height", outer: Column | None = None) -> DataFrame:
    """``candidates`` (rows with the fields of CANDIDATE) with all terms, hard rules, penalty, score and cell.

    ``outer`` is the box that lines tell, an array of four, null where there is none.  A candidate without evidence or
    colours gets 0 for them; one without profiles of its sides has no support.
    """
    get = lambda n: F.col(n)
    for step in _steps(outer):
        candidates = candidates.withColumns(step(get, num(width).cast("double"), num(height).cast("double")))
    return candidates


def ranked_pool(pool: Column, fields: Sequence[str], width: Column, height: Column, outer: Column | None = None) -> Column:
    """The same over ``pool``, an array of structs with ``fields``: ranking without moving the row that holds it."""
    known = list(fields)
    for step in _steps(outer):
        made: dict[str, Column] = {}

        def wider(c: Column) -> Column:
            made.update(step(lambda n: c[n], width, height))
            return F.struct(*(c[n].alias(n) for n in known), *(v.alias(n) for n, v in made.items()))

        pool = F.transform(pool, wider)
        known = [*known, *made]
    return pool


def winners(ranked_rows: DataFrame, image: str, order: str, keep: Sequence[str] | None = None) -> DataFrame:
    """For each image the best of its candidates: winner (a struct of its row, or of the columns ``keep``), pool (distinct
    ones) and competing.

    Quads that agree to a tenth of a pixel are one, the first by ``order``.  Only candidates with a plausible box and a
    score above 0 compete; equal scores go to the first by ``order``.  An image without one keeps a row with a null
    winner.  Both aggregates combine before the shuffle, and need none where the rows lie together by ``image``; ``keep``
    keeps what isn't asked for, such as profiles, out of it.
    """
    fields = [c for c in (ranked_rows.columns if keep is None else keep) if c != image]
    shown = F.struct(*fields).alias("row")
    competes = (F.col("plausible") & (F.col("score") > 0)).alias("competes")
    rows = ranked_rows.select(image, "cell", F.struct(F.col(order).alias("order"), competes, F.col("score").alias("score"), shown).alias("c"))
    once = rows.groupBy(image, "cell").agg(F.min_by("c", F.col("c.order")).alias("c"))
    best = F.max_by(F.when(F.col("c.competes"), F.col("c.row")), F.when(F.col("c.competes"), F.struct("c.score", (-F.col("c.order")).alias("order"))))
    return once.groupBy(image).agg(best.alias("winner"), F.count(F.lit(1)).alias("pool"), F.count_if("c.competes").alias("competing"))


def winner(pool: Column) -> dict[str, Column]:
    """The same within a row: winner, offered (distinct candidates) and competing of a ranked array, in its own order."""
    cells = F.transform(pool, lambda c: c["cell"])
    once = F.filter(pool, lambda c, k: F.array_position(cells, c["cell"]) == k + 1)
    good = F.filter(once, lambda c: c["plausible"] & (c["score"] > 0))
    top = F.array_max(F.transform(good, lambda c: c["score"]))
    return {"winner": F.get(F.filter(good, lambda c: c["score"] == top), F.lit(0)), "offered": F.size(once), "competing": F.size(good)}


# -- a box from the lines that cross the image -------------------------------------------------------------------------------------
def line_peaks(columns: Column, rows: Column, width: Column, height: Column, most: int = 8) -> dict[str, Column]:
    """Places (arrays of ints) where lines may bound the card: left and right from ``columns``, top and bottom from ``rows``."""

    def within(a: Column, n: Column, lo: float, hi: float) -> Column:
        start, end = F.floor(n * lo).cast("int"), F.floor(n * hi).cast("int")
        apart = F.greatest(F.lit(8), F.floor(n / 30).cast("int"))
        found = arrays.peaks(F.slice(a, start + 1, F.greatest(end - start, F.lit(0))), most, apart)
        return F.transform(found, lambda k: k + start)

    return {"left": within(columns, width, 0.03, 0.48), "right": within(columns, width, 0.52, 0.97), "top": within(rows, height, 0.03, 0.42), "bottom": within(rows, height, 0.58, 0.97)}


def _pairs(first: Column, second: Column, profile: Column, size: Column, limits: tuple[float, float]) -> Column:
    """Structs (lo, hi, line, order) of all pairs of a place in ``first`` and one in ``second`` whose distance is in ``limits`` of ``size``."""
    at = lambda k: F.get(profile, k)

    def pair(a: Column, i: Column) -> Column:
        return F.transform(second, lambda b, j: F.struct(a.cast("double").alias("lo"), b.cast("double").alias("hi"), (at(a) + at(F.least(size.cast("int") - 1, b - 1))).alias("line"), (i * 64 + j).alias("order")))

    fits = lambda p: (p["hi"] > p["lo"]) & ((p["hi"] - p["lo"]) / size).between(*limits)
    return F.filter(F.flatten(F.transform(first, pair)), fits)


def line_box(columns, rows, width, height, most: int = 8) -> Column:
    """A struct (score, x1, y1, x2, y2) of the best box between peaks of the two profiles, null where none fits.

    A pair of places across is taken up only if its own lines and place, with the best lines down and full marks for shape
    and size, could still beat the best box so far, and so is each pair down for it; the strongest lines come first.
    Equal scores go to the first in the order of the peaks, left before right before top before bottom.
    """
    line, aspect, area, place = LINE_WEIGHTS
    none = F.struct(F.lit(-1.0).alias("score"), F.lit(0).alias("back"), *(F.lit(None).cast("double").alias(n) for n in ("x1", "y1", "x2", "y2")))

    def search(s: Column) -> Column:
        w, h, half, down = s["w"], s["h"], s["half"], s["down"]

        def shape(x: Column, y: Column) -> Column:
            return 1.0 - F.abs((x["hi"] - x["lo"]) / (y["hi"] - y["lo"]) - ASPECT) / 0.18

        def box(x: Column, y: Column) -> Column:
            size = F.greatest(F.lit(0.0), 1.0 - F.abs((x["hi"] - x["lo"]) * (y["hi"] - y["lo"]) / (w * h) - 0.22) / 0.20)
            centre = 1.0 - distance(((x["lo"] + x["hi"]) / 2.0, (y["lo"] + y["hi"]) / 2.0), (w / 2.0, h / 2.0)) / half
            score = line * clamp(0.25 * (x["line"] + y["line"])) + aspect * shape(x, y) + area * size + place * centre
            return F.struct(score.alias("score"), (-(x["order"] * 4096 + y["order"])).cast("int").alias("back"), x["lo"].alias("x1"), y["lo"].alias("y1"), x["hi"].alias("x2"), y["hi"].alias("y2"))

        def across(best: Column, x: Column) -> Column:
            # no box over this pair is nearer to the middle than the pair itself
            rest = area + place * (1.0 - F.abs((x["lo"] + x["hi"]) / 2.0 - w / 2.0) / half) + 1e-9
            can = lambda y: (shape(x, y) > 0) & (line * clamp(0.25 * (x["line"] + y["line"])) + aspect * shape(x, y) + rest >= best["score"])
            found = F.array_max(F.concat(F.array(best), F.transform(F.filter(down, can), lambda y: box(x, y))))
            return F.when(line * clamp(0.25 * (x["line"] + s["most"])) + aspect + rest >= best["score"], found).otherwise(best)

        return F.aggregate(s["across"], none, across, lambda b: F.when(b["x1"].isNotNull(), F.struct(*(b[n].alias(n) for n in ("score", "x1", "y1", "x2", "y2")))))

    def bounded(s: Column) -> Column:
        return let(search, w=s["w"], h=s["h"], half=distance((s["w"] / 2.0, s["h"] / 2.0), (0.0, 0.0)), across=s["across"], down=s["down"], most=F.coalesce(F.array_max(F.transform(s["down"], lambda p: p["line"])), F.lit(0.0)))

    def paired(s: Column) -> Column:
        strongest = F.sort_array(F.transform(_pairs(s["left"], s["right"], s["c"], s["w"], LINE_WIDTH), lambda p: F.struct(p["line"], (-p["order"]).alias("back"), p["lo"], p["hi"], p["order"])), asc=False)
        return let(bounded, w=s["w"], h=s["h"], across=strongest, down=_pairs(s["top"], s["bottom"], s["r"], s["h"], LINE_HEIGHT))

    return let(lambda s: let(paired, c=s["c"], r=s["r"], w=s["w"], h=s["h"], **line_peaks(s["c"], s["r"], s["w"], s["h"], most)), c=num(columns), r=num(rows), w=num(width).cast("double"), h=num(height).cast("double"))


def widened(box: Sequence[Column], width: Column, height: Column, ratio: float = MARGIN) -> tuple[Column, ...]:
    """The box of a second look: grown by ``ratio`` of its width and height, in whole pixels, within the image."""
    x1, y1, x2, y2 = map(num, box)
    mx, my = one_at_least(x2 - x1) * ratio, one_at_least(y2 - y1) * ratio
    hold = lambda v, most: F.least(F.greatest(F.bround(v), F.lit(0.0)), most)
    return hold(x1 - mx, width), hold(y1 - my, height), hold(x2 + mx, width), hold(y2 + my, height)


def confidence(w: Column) -> Column:
    """Trust in a winning candidate, 0 to 1."""
    return clamp(0.45 * w["score"] + 0.30 * w["silhouette"] + 0.15 * w["rectangularity"] + 0.10 * w["area"])
