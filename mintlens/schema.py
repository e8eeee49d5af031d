"""Declared schemas: the analysed image, the wide row's leading columns and the model's inputs."""

from __future__ import annotations

SCHEMA_VERSION = "mintlens_features_v1"
SIDES, CORNERS = ("top", "bottom", "left", "right"), ("top_left", "top_right", "bottom_left", "bottom_right")

VISUAL = ("width", "height", "aspect_ratio", "area", "blur_score", "brightness_score", "contrast_score")
GEOMETRY = ("coverage_ratio", "aspect_quality")
CENTERING = ("bbox_x_min", "bbox_y_min", "bbox_x_max", "bbox_y_max", "left_margin", "right_margin", "top_margin", "bottom_margin", "horizontal_balance", "vertical_balance", "overall_centering")
EDGE = (*(f"{s}_{m}" for s in SIDES for m in ("edge_score", "anomaly_ratio", "highlight_ratio", "roughness", "mean_intensity", "std_intensity", "profile_length")), "edge_score_raw", "edge_score", "edge_confidence", "worst_side_score")
CORNER = (*(f"{c}_{m}" for c in CORNERS for m in ("corner_score", "highlight_ratio", "roughness", "mean_intensity", "std_intensity")), "corner_score_raw", "corner_score", "corner_confidence", "worst_corner_score")
SURFACE = (
    "edge_whitening_ratio", "corner_whitening_ratio", "whitening_confidence", "edge_band_width_px", "corner_patch_size_px", "glare_ratio", "texture_anomaly_ratio",
    "dark_spot_ratio", "surface_confidence", "whitening_score", "surface_score", "whitening_surface_score", "roi_width", "roi_height", "lighting_blur", "lighting_contrast", "lighting_capture",
)
POSTWARP = (
    "rectified_aspect_ratio", "rectified_aspect_ratio_deviation", "rectified_aspect_ratio_score", "outer_border_score", "outer_border_continuity_score", "margin_consistency_score",
    "crop_risk_score", "frame_coherence_score", "postwarp_score_raw", *(f"{s}_{m}" for s in SIDES for m in ("border_score", "border_peak_ratio", "border_strength", "border_continuity", "crop_risk", "texture_ratio")),
)
DETECTION = ("best_score", "detection_confidence", "used_fallback", "weak_detection", "aspect_score", "area_score", "centre_score", "rectangularity", "edge_support", "silhouette", "candidates", "competing", "second_look", *(f"{p}_{a}" for p in ("tl", "tr", "br", "bl") for a in "xy"))

FAMILIES = {"detection": DETECTION, "visual": VISUAL, "geometry": GEOMETRY, "centering": CENTERING, "edge": EDGE, "corner": CORNER, "surface": SURFACE, "postwarp": POSTWARP}

#: What the pixel pass returns: keys of the image, how far it came, and a struct of doubles for each family.
ANALYSIS = "origin string, height int, width int, stage string, error string, " + ", ".join(f"{f} struct<{', '.join(f'{n}: double' for n in names)}>" for f, names in FAMILIES.items())

# What each part score is made of, by the part's name in the wide row.
SCORE_PARTS = {
    "capture": ("blur_component", "brightness_component", "contrast_component"),
    "prelim": ("capture_component", "coverage_component", "aspect_component", "fallback_penalty"),
    "centering": ("horizontal_component", "vertical_component"),
    "edge": ("edge_component", "confidence_component", "adjusted_edge_component", *(f"{s}_edge_score" for s in SIDES)),
    "corner": ("corner_component", "confidence_component", "adjusted_corner_component", *(f"{c}_corner_score" for c in CORNERS)),
    "ws": ("whitening_component", "surface_component", "combined_component", "whitening_confidence", "surface_confidence", "adjusted_component", "edge_whitening_ratio", "corner_whitening_ratio", "glare_ratio", "texture_anomaly_ratio", "dark_spot_ratio"),
}

#: Columns of the wide row that a model reads, by prefix: 133 of them.
MODEL_FEATURES = (
    *(f"visual_{n}" for n in VISUAL), *(f"geometry_{n}" for n in GEOMETRY), *(f"centrado_{n}" for n in CENTERING), *(f"borde_{n}" for n in EDGE), *(f"esquina_{n}" for n in CORNER), *(f"superficie_{n}" for n in SURFACE),
    *(n for part, names in SCORE_PARTS.items() for n in (f"score_{part}", *(f"score_{part}_{x}" for x in names))),
)
