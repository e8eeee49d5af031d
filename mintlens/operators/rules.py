"""Rule engines and bands as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Thresholds
from ..functions.math import at_least, num
from ..functions.text import joined_reasons


def _n(x) -> Column:
    """A missing measurement counts as 0."""
    return F.coalesce(num(x).cast("double"), F.lit(0.0))


def _b(x) -> Column:
    return F.coalesce(num(x).cast("boolean"), F.lit(False))


def capture_status(used_fallback, best_score, weak, confidence, coverage, blur, brightness, contrast, edge_confidence, corner_confidence, postwarp_valid, postwarp_score, retry, t: Thresholds = Thresholds()) -> dict[str, Column]:
    """analysis_status, invalid_reasons and usable_for_condition_model of a capture.

    One invalid reason makes it invalid and hides all warnings.  Coverage from the low limit up to 0.28 is neither
    invalid nor a warning.  Only captures without any finding are usable.
    """
    fallback, doubtful, valid, again = _b(used_fallback), _b(weak), _b(postwarp_valid), _b(retry)
    best, conf, cover, sharp, light, contr, edge, corner, post = map(_n, (best_score, confidence, coverage, blur, brightness, contrast, edge_confidence, corner_confidence, postwarp_score))
    mid = lambda x, lo, hi: (x >= lo) & (x < hi)
    invalid = {
        "fallback_detection": fallback & (best < t.fallback_best),
        "weak_detection": doubtful & (conf < t.weak_confidence),
        "low_coverage": cover < t.coverage_low,
        "excessive_coverage": cover > t.coverage_excess,
        "blurry_image": sharp < t.blur_low,
        "too_dark": light < t.dark,
        "too_bright": light > t.bright,
        "low_contrast": contr < t.contrast_low,
        "low_edge_confidence": edge < t.part_confidence,
        "low_corner_confidence": corner < t.part_confidence,
        "invalid_postwarp": ~valid & (post < t.postwarp_low),
    }
    warning = {
        "fallback_used": fallback & (best >= t.fallback_best),
        "weak_detection": doubtful & (conf >= t.weak_confidence),
        "weak_postwarp": (~valid & (post >= t.postwarp_low)) | (again & ~invalid["invalid_postwarp"]),
        "borderline_low_coverage": mid(cover, 0.28, 0.38),
        "borderline_high_coverage": (cover > 0.90) & ~(cover > t.coverage_excess),
        "moderate_blur": mid(sharp, t.blur_low, 120.0),
        "suboptimal_dark_brightness": mid(light, t.dark, 95.0),
        "suboptimal_high_brightness": (light > 210.0) & (light <= t.bright),
        "suboptimal_contrast": mid(contr, t.contrast_low, 30.0),
        "moderate_edge_confidence": mid(edge, t.part_confidence, t.moderate),
        "moderate_corner_confidence": mid(corner, t.part_confidence, t.moderate),
        "moderate_detection_confidence": mid(conf, t.weak_confidence, t.moderate),
        "moderate_postwarp_score": mid(post, t.postwarp_low, t.moderate),
    }
    listed = lambda rules: joined_reasons(*(F.when(c, F.lit(r)) for r, c in rules.items()))
    bad, odd = listed(invalid), listed(warning)
    status = F.when(bad != "", "invalid_capture").when(odd != "", "valid_with_warning").otherwise("valid")
    return {"analysis_status": status, "invalid_reasons": F.when(bad != "", bad).otherwise(odd), "usable_for_condition_model": status == "valid"}


#: Columns of ``captures`` in the order of ``capture_status``.
STATUS_INPUTS = ("used_fallback", "best_score", "weak", "det_conf", "coverage", "blur", "brightness", "contrast", "edge_conf", "corner_conf", "postwarp_valid", "postwarp_score", "retry")


def with_status(df: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    return df.withColumns(capture_status(*STATUS_INPUTS, t=t))


# Status of rows whose analysis ended early.
STAGE_STATUS = {"read_error": "not_evaluated", "detection_failed": "invalid_detection", "warp_failed": "warp_failed", "features_failed": "features_not_available", "exception": "exception"}


def stage_status(stage) -> Column:
    """The status of a row that stopped at ``stage``; null for rows that were analysed to the end."""
    status = F.lit(None).cast("string")
    for name, value in STAGE_STATUS.items():
        status = F.when(num(stage) == name, F.lit(value)).otherwise(status)
    return status


def capture_assessment(used_fallback, coverage, aspect, capture_score) -> Column:
    cover, ratio, score = _n(coverage), _n(aspect), _n(capture_score)
    shaped = ratio.between(0.65, 0.78)
    return (
        F.when(_b(used_fallback), "deficiente")
        .when(cover > 0.95, F.when(score >= 5.0, "mejorable").otherwise("deficiente"))
        .when(shaped & (cover >= 0.35) & (score >= 7.0), "buena")
        .when(shaped & (cover >= 0.22) & (score >= 5.0), "mejorable")
        .otherwise("deficiente")
    )


# What a capture's assessment advises.
CAPTURE_MESSAGES = {
    "fallback": "La detección usó un contorno de respaldo. Mejora el contraste contra el fondo.",
    "close": "La carta no tiene márgenes visibles. Aleja un poco la cámara para que el borde real sea visible contra un fondo oscuro.",
    "buena": "La captura es adecuada para análisis preliminar. La carta ocupa suficiente espacio y la calidad visual es razonable.",
    "mejorable": "La captura puede procesarse, pero conviene acercar más la carta, reducir reflejos o mejorar la iluminación.",
    "deficiente": "La captura no es ideal para análisis confiable. Acerca más la carta, usa mejor iluminación y un fondo más limpio.",
}


def capture_message(used_fallback, coverage, aspect, capture_score) -> Column:
    """The advice that goes with ``capture_assessment``."""
    level = capture_assessment(used_fallback, coverage, aspect, capture_score)
    text = F.lit(CAPTURE_MESSAGES["deficiente"])
    for name in ("mejorable", "buena"):
        text = F.when(level == name, CAPTURE_MESSAGES[name]).otherwise(text)
    return F.when(_b(used_fallback), CAPTURE_MESSAGES["fallback"]).when(_n(coverage) > 0.95, CAPTURE_MESSAGES["close"]).otherwise(text)


def part_label(score) -> Column:
    return at_least(score, (85.0, "good"), (70.0, "acceptable"), (50.0, "weak"), otherwise="poor")


def damped(score, confidence) -> Column:
    """A part's score, lowered where its measurement is in doubt."""
    c = num(confidence)
    return num(score) * F.when(c < 0.20, 0.85).when(c < 0.35, 0.92).otherwise(1.0)


def context_factor(weak, confidence) -> Column:
    c = _n(confidence)
    return F.when(_b(weak), 0.95).otherwise(1.0) * F.when((c > 0) & (c < 0.40), 0.96).otherwise(1.0)


def postwarp_decision(score, aspect_score, border, continuity, margins, crop_risk, t: Thresholds = Thresholds()) -> dict[str, Column]:
    """postwarp_valid, retry_recommended and the sorted reasons against a rectified card."""
    score, aspect, border, continuity, margins, crop = map(num, (score, aspect_score, border, continuity, margins, crop_risk))
    valid = (score >= t.postwarp_valid) & (aspect >= t.min_aspect) & (crop <= t.max_crop_risk) & (border >= t.min_border)
    reasons = joined_reasons(
        F.when(aspect < t.min_aspect, "implausible_rectified_aspect_ratio"),
        F.when(border < t.min_border, "weak_outer_border_visibility"),
        F.when(continuity < 0.28, "weak_outer_border_continuity"),
        F.when(margins < 0.24, "inconsistent_outer_margins"),
        F.when(crop > t.max_crop_risk, "high_crop_risk"),
    )
    return {"postwarp_valid": valid, "retry_recommended": ~valid | (score < t.postwarp_retry) | (crop > 0.55) | (continuity < 0.42), "postwarp_reasons": reasons}


def score_label(score) -> Column:
    s = num(score)
    return F.when(s.isNull(), "Sin evaluacion").otherwise(at_least(s, (9.0, "Excelente"), (8.0, "Muy buena"), (7.0, "Buena"), (5.5, "Mejorable"), otherwise="No confiable"))


def condition_band(score) -> Column:
    return at_least(score, (9.5, "mint"), (8.5, "near_mint"), (7.0, "lightly_played"), (5.0, "moderately_played"), (3.0, "heavily_played"), otherwise="damaged")


# What a band is worth of the full price.
BAND_FACTORS = {"mint": 1.00, "near_mint": 0.95, "lightly_played": 0.85, "moderately_played": 0.70, "heavily_played": 0.50, "damaged": 0.30}


def findings(parts: dict[str, object], most: int = 4) -> Column:
    """"+part" for scores of 8 and more, "-part" below 6, in the order given, the first ``most``."""
    found = [F.when(num(s) >= 8.0, F.lit("+" + p)).when(num(s) < 6.0, F.lit("-" + p)) for p, s in parts.items()]
    return F.slice(F.array_compact(F.array(*found)), 1, most)


def final_score(*versions) -> Column:
    """The first score that is there, the latest version first."""
    return F.coalesce(*map(num, versions))


# Spellings of the two labels.
DAMAGED = ("damaged", "damage", "rotas", "rota", "danada", "dañada")
UNDAMAGED = ("undamaged", "clean", "sana", "sin_danio", "sin_daño", "ok")


def normal_label(label) -> Column:
    t = F.lower(F.trim(num(label)))
    return F.when(t.isin(*DAMAGED), "damaged").when(t.isin(*UNDAMAGED), "undamaged").otherwise("unknown")


def label_target(label) -> Column:
    return F.when(num(label) == "damaged", 1).when(num(label) == "undamaged", 0)


def sample_weight(status, warned: float = 1.0, other: float = 0.5) -> Column:
    return F.when(num(status) == "valid_with_warning", warned).otherwise(other)
