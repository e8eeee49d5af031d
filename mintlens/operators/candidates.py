"""Boxes and quads that may outline a card: their shapes, the rules that they must meet, and the choice between them.

A box is (x1, y1, x2, y2), a quad four points in the order TL, TR, BR, BL, all as columns.  Whoever finds candidates
gives a row for each; these expressions then judge any number of them without Python.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.math import box_area, centre, clamp, distance, iou, num, quad_area, quad_sides
from ..functions.text import named_reasons

# A card's width over its height, and what is least asked of a candidate's share of the image.
ASPECT, MIN_AREA, MIN_WIDTH, MIN_HEIGHT, MIN_VERTICAL_SUPPORT = 0.715, 0.16, 0.32, 0.42, 0.26
# Soft limit, hard limit, penalty beyond the soft one, further penalty beyond the hard one.
TOP_BOTTOM, LEFT_RIGHT, ASPECT_OFF = (0.14, 0.24, 0.18, 0.24), (0.16, 0.26, 0.16, 0.22), (0.065, 0.14, 0.18, 0.24)
EVIDENCE, COVERED, SUPPORT, SPREAD = (0.78, 0.60, 0.22, 0.26), (0.72, 0.56, 0.12, 0.18), (0.16, 0.10, 0.28, 0.24), (0.18, 0.26, 0.14, 0.18)
# What passing the soft limit of a rule costs, and what passing the hard one costs besides.
PENALTIES = {
    "top_bottom_length_mismatch": TOP_BOTTOM[2:], "left_right_length_mismatch": LEFT_RIGHT[2:], "aspect_ratio_off": ASPECT_OFF[2:], "implausible_area": (0.15, 0.20), "bbox_too_large": (0.16, 0.18),
    "weak_evidence_coverage": EVIDENCE[2:], "oversized_vs_evidence": COVERED[2:], "low_min_side_support": SUPPORT[2:], "unbalanced_side_support": SPREAD[2:],
}


def one_at_least(x) -> Column:
    """The larger of ``x`` and 1; null stays null."""
    return F.when(num(x) >= 1.0, num(x).cast("double")).when(num(x) < 1.0, F.lit(1.0))


def box_shape(box, width, height) -> dict[str, Column]:
    """A box's area, width and height as shares of the image, its aspect and how far that is from a card's."""
    w, h = one_at_least(num(box[2]) - num(box[0])), one_at_least(num(box[3]) - num(box[1]))
    iw, ih = one_at_least(width), one_at_least(height)
    return {"area_ratio": w * h / (iw * ih), "width_ratio": w / iw, "height_ratio": h / ih, "aspect_ratio": w / h, "aspect_deviation": F.abs(w / h - ASPECT)}


def plausible_outer_box(box, width, height) -> Column:
    s = box_shape(box, width, height)
    return s["area_ratio"].between(0.12, 0.82) & (s["width_ratio"] >= max(0.38, MIN_WIDTH)) & (s["height_ratio"] >= max(0.50, MIN_HEIGHT)) & (s["aspect_deviation"] <= 0.12)


def first_box(**boxes) -> dict[str, Column]:
    """box (an array of four) and source: the first of the named boxes without a null; no source where there is none."""
    box, source = F.lit(None).cast("array<double>"), F.lit("")
    for name, b in reversed(boxes.items()):
        there = F.lit(True)
        for v in b:
            there = there & num(v).isNotNull()
        box, source = F.when(there, F.array(*(num(v).cast("double") for v in b))).otherwise(box), F.when(there, name).otherwise(source)
    return {"box": box, "source": source}


def chosen_box(projection, component, width, height, projection_inner, component_inner) -> Column:
    """Which box stands, "projection", "component" or "none": the only one there is, else by ten rules, the first that holds.

    projection_inner and component_inner say how clearly lines run along inside each box (0 to 1).
    """
    known = lambda b: num(b[0]).isNotNull() & num(b[1]).isNotNull() & num(b[2]).isNotNull() & num(b[3]).isNotNull()
    p, c = box_shape(projection, width, height), box_shape(component, width, height)
    p_ok, c_ok = plausible_outer_box(projection, width, height), plausible_outer_box(component, width, height)
    apart = distance(centre(projection), centre(component)) / one_at_least(F.least(num(width), num(height)))
    ratio = F.greatest(p["area_ratio"], c["area_ratio"]) / F.greatest(F.least(p["area_ratio"], c["area_ratio"]), F.lit(1e-6))
    smaller = F.when(c["area_ratio"] < p["area_ratio"], "component").otherwise("projection")
    pi, ci = F.coalesce(num(projection_inner), F.lit(0.0)), F.coalesce(num(component_inner), F.lit(0.0))
    return (
        F.when(~known(projection) & ~known(component), "none")
        .when(~known(projection), "component")
        .when(~known(component), "projection")
        .when(c_ok & ~p_ok, "component")
        .when(p_ok & ~c_ok, "projection")
        .when((apart <= 0.16) & (ratio >= 1.45), smaller)
        .when((iou(projection, component) >= 0.45) & (ratio >= 1.30), smaller)
        .when(c_ok & ((p["area_ratio"] > 0.52) | (p["width_ratio"] > 0.78) | (p["height_ratio"] > 0.94) | (p["aspect_deviation"] > c["aspect_deviation"] + 0.03)), "component")
        .when(ci > pi + 0.18, "component")
        .otherwise("projection")
    )


def outer_margins(quad, box, outer) -> dict[str, Column]:
    """How far the sides of a quad's box and its middle lie from those of the outer box, and its size against it: what
    ``within_outer`` judges.  As columns of a frame they are computed once, not at every use.
    """
    w, h = one_at_least(num(outer[2]) - num(outer[0])), one_at_least(num(outer[3]) - num(outer[1]))
    norm = F.least(w, h)
    margins = [(num(box[0]) - num(outer[0])) / norm, (num(outer[2]) - num(box[2])) / norm, (num(box[1]) - num(outer[1])) / norm, (num(outer[3]) - num(box[3])) / norm]
    middle = (sum((num(p[0]) for p in quad[1:]), num(quad[0][0])) / 4.0, sum((num(p[1]) for p in quad[1:]), num(quad[0][1])) / 4.0)
    return {f"margin_{n}": m for n, m in zip(("left", "right", "top", "bottom"), margins, strict=True)} | {"middle_away": distance(middle, centre(outer)) / norm, "outer_share": quad_area(quad) / one_at_least(box_area(outer))}


def within_outer(quad, box, outer, made: Mapping[str, Column] | None = None) -> dict[str, Column]:
    """How a quad (with its box) lies in the outer box: is_internal, border_distance, relative_size, touches, touch_count,
    centre_distance and the reason to reject it ("" for none).  Without an outer box it is not internal, at distance 1.
    ``made``: the frame's columns of ``outer_margins``, if it has them.
    """
    *margins, away, size = (made or outer_margins(quad, box, outer)).values()
    near = [m <= 0.12 for m in margins]
    count = sum((n.cast("int") for n in near[1:]), near[0].cast("int"))
    touches = near[0] | near[1] | near[2] | near[3]
    border = sum((F.greatest(m, F.lit(0.0)) for m in margins[1:]), F.greatest(margins[0], F.lit(0.0))) / 4.0
    inside = (margins[0] >= -0.03) & (margins[1] >= -0.03) & (margins[2] >= -0.03) & (margins[3] >= -0.03)
    internal = inside & (size < 0.72) & ~touches & (border > 0.10) & (away < 0.28)
    reason = F.when(~internal, "").when(size < 0.42, "too_small_inside_outer_bbox").when(border > 0.18, "too_far_from_outer_border").otherwise("central_internal_shape")
    none = num(outer[0]).isNull()
    return {
        "is_internal": F.when(none, False).otherwise(internal),
        "border_distance": F.when(none, 1.0).otherwise(border),
        "relative_size": F.when(none, 0.0).otherwise(clamp(size, 0.0, 2.0)),
        "touches": F.when(none, False).otherwise(touches),
        "touch_count": F.when(none, 0).otherwise(count),
        "centre_distance": F.when(~none, away),
        "rejection_reason": F.when(none, "").otherwise(reason),
    }


def area_plausibility(share) -> Column:
    """How likely a card takes that share of the image; each band holds its lower end."""
    s = num(share)
    return F.when(s < MIN_AREA, 0.0).when(s < 0.18, 0.35).when(s < 0.28, 0.75).when(s < 0.58, 1.0).when(s < 0.72, 0.55).when(s < 0.84, 0.20).otherwise(0.0)


def geometry_sides(quad, width, height) -> dict[str, Column]:
    """Lengths of a quad's sides and the share of the image that it takes, for ``geometry_ratios``."""
    sides = {f"side_{n}": x for n, x in zip(("top", "right", "bottom", "left"), quad_sides(quad), strict=True)}
    return sides | {"area_ratio": quad_area(quad) / one_at_least(num(width) * num(height))}


def geometry_ratios(sides: Mapping[str, Column]) -> dict[str, Column]:
    """The ratios that ``geometry_rules`` judges, from the columns of ``geometry_sides``."""
    top, right, bottom, left, share = sides.values()
    gap = lambda a, b: F.abs(a - b) / one_at_least(F.greatest(a, b))
    aspect = F.greatest(F.lit(1.0), (top + bottom) / 2.0) / F.greatest(F.lit(1.0), (right + left) / 2.0)
    return {"top_bottom_diff_ratio": gap(top, bottom), "left_right_diff_ratio": gap(left, right), "aspect_ratio_deviation": F.abs(aspect - ASPECT), "area_ratio": share, "area_plausibility_score": area_plausibility(share)}


def geometry_flags(ratios: Mapping[str, Column], box_width, box_height, evidence_width, evidence_height, covered, min_support, support_spread) -> dict[str, Column]:
    """soft_<rule> and hard_<rule> for each of PENALTIES: whether its limits are passed, from the columns of ``geometry_ratios``."""
    zero = lambda x: F.coalesce(num(x), F.lit(0.0))
    tb, lr, dev, share, plausible = ratios.values()
    wide, evidence = F.greatest(zero(box_width), zero(box_height)), F.least(zero(evidence_width), zero(evidence_height))
    least, spread, cover = zero(min_support), zero(support_spread), zero(covered)
    above = lambda x, t: (x > t[0], x > t[1])
    below = lambda x, t: (x < t[0], x < t[1])
    found = {
        "top_bottom_length_mismatch": above(tb, TOP_BOTTOM),
        "left_right_length_mismatch": above(lr, LEFT_RIGHT),
        "aspect_ratio_off": above(dev, ASPECT_OFF),
        "implausible_area": (plausible < 0.40, plausible <= 0.05),
        "bbox_too_large": ((wide > 0.96) & (share > 0.78), (wide > 0.985) & (share > 0.84)),
        "weak_evidence_coverage": below(evidence, EVIDENCE),
        "oversized_vs_evidence": below(cover, COVERED),
        "low_min_side_support": below(least, SUPPORT),
        "unbalanced_side_support": (spread > SPREAD[0], (spread > SPREAD[1]) & (least < 0.18)),
    }
    return {f"{kind}_{name}": flag for name, flags in found.items() for kind, flag in zip(("soft", "hard"), flags, strict=True)}


def geometry_rules(quad, width, height, box_width, box_height, evidence_width, evidence_height, covered, min_support, support_spread, ratios: Mapping[str, Column] | None = None, flags: Mapping[str, Column] | None = None) -> dict[str, Column]:
    """geometry_valid, geometry_penalty (0 to 1), geometry_reasons and the ratios that they rest on.

    The measurements beside the quad are shares: of the image that its box takes, of the box that edges bear out, and of
    a side's length that lies on edges.  What is missing counts as 0.  ``ratios`` and ``flags``: the frame's columns of
    ``geometry_ratios`` and ``geometry_flags``, if it has them; as columns they are computed once, not at every use.
    """
    v = dict(ratios or geometry_ratios(geometry_sides(quad, width, height)))
    flags = flags or geometry_flags(v, box_width, box_height, evidence_width, evidence_height, covered, min_support, support_spread)
    valid, penalty = F.lit(True), F.lit(0.0)
    for name, (light, heavy) in PENALTIES.items():
        valid = valid & ~flags[f"hard_{name}"]
        penalty = penalty + F.when(flags[f"soft_{name}"], light).otherwise(0.0) + F.when(flags[f"hard_{name}"], heavy).otherwise(0.0)
    even = clamp(0.55 * F.greatest(F.lit(0.0), 1.0 - v["top_bottom_diff_ratio"] / TOP_BOTTOM[1]) + 0.45 * F.greatest(F.lit(0.0), 1.0 - v["left_right_diff_ratio"] / LEFT_RIGHT[1]))
    reasons = named_reasons({name: flags[f"soft_{name}"] for name in PENALTIES})
    return {"geometry_valid": valid, "geometry_penalty": clamp(penalty), "geometry_reasons": reasons, "side_length_consistency_score": even, **v}


def hard_rules(area, width, height, left, right, top, bottom, silhouette, min_support, geometry_valid, trapezoid, angle, touch_count, is_internal, relative_size=None, strictness: float = 1.0) -> dict[str, Column]:
    """hard_rules_ok and hard_fail_reasons: whether a candidate competes at all.  relative_size is null without an outer box."""
    left, right, top, bottom = map(num, (left, right, top, bottom))
    size = F.lit(None).cast("double") if relative_size is None else num(relative_size)
    broken = {
        "area_too_small": num(area) < MIN_AREA,
        "width_too_small": num(width) < MIN_WIDTH,
        "height_too_small": num(height) < MIN_HEIGHT,
        "low_vertical_support": F.greatest(left, right) < MIN_VERTICAL_SUPPORT,
        "low_silhouette_support": num(silhouette) < 0.55,
        "asymmetric_border_support": F.least(left + right, top + bottom) < 0.40,
        "weak_side_bottleneck": num(min_support) < SUPPORT[1],
        "invalid_geometry": ~num(geometry_valid),
        "strong_trapezoid": num(trapezoid) > 0.50,
        "bad_angles": num(angle) > 15.0 * strictness,
        "touches_too_many_borders": num(touch_count) >= 3,
        "internal_candidate": num(is_internal),
        "too_small_vs_outer_bbox": F.coalesce(size < 0.35, F.lit(False)),
    }
    reasons = named_reasons(broken)
    return {"hard_rules_ok": reasons == "", "hard_fail_reasons": reasons}


def fallback_box(width, height, outer=None) -> dict[str, Column]:
    """box (an array of four), source and weak: the estimated outer box if it takes 0.10 to 0.78 of the image, else one
    of a card's shape in the middle, 0.68 of the height but at most 0.78 of the width.
    """
    w, h = num(width), num(height)
    tall = F.bround(h * 0.68)
    broad, most = F.bround(tall * ASPECT), F.bround(w * 0.78)
    bw, bh = F.when(broad > most, most).otherwise(broad), F.when(broad > most, F.bround(most / ASPECT)).otherwise(tall)
    cx, cy, zero = F.floor(w / 2.0), F.floor(h / 2.0), F.lit(0.0)
    middle = F.array(*(x.cast("double") for x in (F.greatest(zero, F.bround(cx - bw / 2.0)), F.greatest(zero, F.bround(cy - bh / 2.0)), F.least(w, F.bround(cx + bw / 2.0)), F.least(h, F.bround(cy + bh / 2.0)))))
    if outer is None:
        return {"box": middle, "source": F.lit("centered_conservative"), "weak": F.lit(True)}
    fits = F.coalesce((box_area(outer) / one_at_least(w * h)).between(0.10, 0.78), F.lit(False))
    return {"box": F.when(fits, F.array(*(num(v).cast("double") for v in outer))).otherwise(middle), "source": F.when(fits, "estimated_outer_bbox").otherwise("centered_conservative"), "weak": ~fits}
