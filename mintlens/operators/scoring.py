"""Scores from 1 to 10 as column expressions.  ``digits=None`` leaves a score unrounded."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.math import aspect_quality, clamp, num, rounded

# What each version of the condition score weighs, in the order preliminary, centering, edge, corner, surface.
CONDITION_WEIGHTS = {
    "v1": (0.65, 0.35),
    "v2": (0.50, 0.20, 0.30),
    "v3": (0.40, 0.20, 0.20, 0.20),
    "v4": (0.25, 0.15, 0.25, 0.20, 0.15),
}
PARTS = ("preliminary", "centering", "edge", "corner", "surface")


def _python_round(x: Column, digits: int) -> Column:
    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if pd.isna(v) else round(v, digits)).astype("float64")

    return run(x)


def shown(x: Column, digits: int | None, rounding: str = "floor") -> Column:
    """``rounding="python"`` rounds halves of the exact binary value to even, as Python does, in a pandas function."""
    if digits is None:
        return x
    return _python_round(x, digits) if rounding == "python" else rounded(x, digits)


def ten(share) -> Column:
    return 1.0 + clamp(share) * 9.0


def share(score) -> Column:
    return clamp((num(score) - 1.0) / 9.0)


def capture_parts(blur, brightness, contrast) -> dict[str, Column]:
    """What the capture score is mixed from, each 0 to 1."""
    return {"blur_component": clamp(num(blur) / 400.0), "brightness_component": clamp(1.0 - F.abs(num(brightness) - 150.0) / 150.0), "contrast_component": clamp(num(contrast) / 80.0)}


def capture(blur, brightness, contrast, digits: int | None = 2) -> Column:
    sharp, light, spread = capture_parts(blur, brightness, contrast).values()
    return shown(ten(0.50 * sharp + 0.25 * light + 0.25 * spread), digits)


def preliminary_parts(capture_score, coverage, aspect, used_fallback) -> dict[str, Column]:
    fallback = F.when(num(used_fallback).cast("boolean"), 0.20).otherwise(0.0)
    return {"capture_component": share(capture_score), "coverage_component": clamp(num(coverage) / 0.60), "aspect_component": aspect_quality(aspect), "fallback_penalty": fallback}


def preliminary(capture_score, coverage, aspect, used_fallback, digits: int | None = 2) -> Column:
    seen, cover, shape, fallback = preliminary_parts(capture_score, coverage, aspect, used_fallback).values()
    return shown(ten(0.55 * seen + 0.30 * cover + 0.15 * shape - fallback), digits)


def centering(horizontal, vertical, digits: int | None = 2) -> Column:
    return shown(ten(0.5 * clamp(horizontal) + 0.5 * clamp(vertical)), digits)


def confident_parts(score, full: float, confidence, name: str) -> dict[str, Column]:
    """A raw score out of ``full``, the confidence of its measurement, and the score of which a quarter hangs on that."""
    plain, sure = clamp(num(score) / full), clamp(confidence)
    return {f"{name}_component": plain, "confidence_component": sure, f"adjusted_{name}_component": clamp(plain * (0.75 + 0.25 * sure))}


def confident(score, full: float, confidence, digits: int | None = 2) -> Column:
    return shown(ten(confident_parts(score, full, confidence, "raw")["adjusted_raw_component"]), digits)


def edge(score, confidence, digits: int | None = 2) -> Column:
    return confident(score, 100.0, confidence, digits)


corner = edge


def surface(combined, whitening_confidence, surface_confidence, digits: int | None = 2) -> Column:
    return confident(combined, 10.0, 0.5 * clamp(whitening_confidence) + 0.5 * clamp(surface_confidence), digits)


def surface_parts(whitening, surface_score, combined, whitening_confidence, surface_confidence) -> dict[str, Column]:
    white, plain = clamp(whitening_confidence), clamp(surface_confidence)
    return {
        "whitening_component": clamp(num(whitening) / 10.0), "surface_component": clamp(num(surface_score) / 10.0), "combined_component": clamp(num(combined) / 10.0),
        "whitening_confidence": white, "surface_confidence": plain, "adjusted_component": confident_parts(combined, 10.0, 0.5 * white + 0.5 * plain, "raw")["adjusted_raw_component"],
    }


def condition(version: str, scores: Sequence, confidences: Sequence = (), digits: int | None = 2) -> dict[str, Column]:
    """The composite ``condition`` and the weight used for each part.

    ``scores`` follow PARTS; ``confidences`` belong to the parts after centering.  A part in doubt gives up to 40 % of
    its weight to the preliminary score, so the weights always sum to 1.
    """
    base = CONDITION_WEIGHTS[version]
    used: list[Column] = [F.lit(base[0]), F.lit(base[1])]
    for weight, confidence in zip(base[2:], confidences, strict=True):
        kept = weight * (0.60 + 0.40 * clamp(confidence))
        used[0] = used[0] + (weight - kept)
        used.append(kept)
    total = reduce(lambda a, b: a + b, (w * share(s) for w, s in zip(used, scores, strict=True)))
    return {"condition": shown(ten(total), digits)} | {f"weight_{p}": w for p, w in zip(PARTS, used, strict=False)}


def whitening_penalised(edge_ratio, corner_ratio, blur, contrast, capture_score, surface_score) -> Column:
    """0-10; poor captures are held against the card less, and a fine surface keeps the score from falling below 3.5."""
    doubt = F.when(num(capture_score) < 7.0, 0.50).otherwise(1.0)
    for x, limit, factor in ((blur, 150.0, 0.80), (blur, 100.0, 0.60), (contrast, 30.0, 0.85), (contrast, 20.0, 0.60)):
        doubt = doubt * F.when(num(x) < limit, factor).otherwise(1.0)
    lost = doubt * (5.0 * F.least(F.lit(1.0), num(edge_ratio) / 0.20) + 5.0 * F.least(F.lit(1.0), num(corner_ratio) / 0.25))
    score = clamp(10.0 - lost, 0.0, 10.0)
    return F.when((num(surface_score) > 8.5) & (score < 3.5), 3.5).otherwise(score)


def surface_penalised(glare, texture, dark_spots) -> Column:
    lost = 4.0 * F.least(F.lit(1.0), num(glare) / 0.03) + 3.5 * F.least(F.lit(1.0), num(texture) / 0.08) + 2.5 * F.least(F.lit(1.0), num(dark_spots) / 0.04)
    return clamp(10.0 - lost, 0.0, 10.0)
