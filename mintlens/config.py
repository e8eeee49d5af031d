"""Thresholds that expression builders take, with overrides from the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Thresholds:
    """Limits of the capture-status rules and of the post-warp check; every value lies in its documented range."""

    fallback_best: float = 0.50
    weak_confidence: float = 0.45
    coverage_low: float = 0.15
    coverage_excess: float = 0.99
    blur_low: float = 70.0
    dark: float = 75.0
    bright: float = 235.0
    contrast_low: float = 20.0
    part_confidence: float = 0.45
    postwarp_low: float = 0.45
    moderate: float = 0.60
    postwarp_valid: float = 0.56
    postwarp_retry: float = 0.64
    max_crop_risk: float = 0.78
    min_border: float = 0.30
    min_aspect: float = 0.35

    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ, prefix: str = "MINTLENS_") -> Thresholds:
        """Overrides from variables named after the fields; values that are no number are passed over, fractions are clamped to 0..1."""
        found = {}
        for f in fields(cls):
            value = parse_float(env.get(prefix + f.name.upper()), f.default)
            found[f.name] = min(max(value, 0.0), 1.0) if f.default <= 1 else max(value, 0.0)
        return replace(cls(), **found)


def parse_float(text: str | None, default: float) -> float:
    try:
        return float((text or "").strip())
    except ValueError:
        return default


def parse_bool(text: str | None, default: bool) -> bool:
    word = (text or "").strip().lower()
    return True if word in {"1", "true", "yes", "on", "y", "t"} else False if word in {"0", "false", "no", "off", "n", "f"} else default
