"""From decoded images to the wide, scored row: one pass over the pixels, then column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.math import aspect_quality, balance, clamp, iou, mean, rounded, safe, span, steps
from ..schema import ANALYSIS, CORNER, CORNERS, EDGE, FAMILIES, SCHEMA_VERSION, SCORE_PARTS, SIDES, VISUAL
from . import detection, parts, rules, scoring
from .candidates import chosen_box, fallback_box
from .flatten import flatten, leading_first


#: The raster's own columns, and what the first look adds to them.
RASTER = ("path", "height", "width", "nChannels", "data")
POOL = f"array<struct<{', '.join(x.replace(' ', ':', 1) for x in detection.CANDIDATE.split(', '))}>>"
LOOK = f"stage string, error string, small_height double, small_width double, pool {POOL}, columns array<double>, rows array<double>"
#: Trust below which a detection is weak, and below which a second look is taken; overlap from which two boxes are the same.
WEAK, LOOK_AGAIN, SAME_BOX = 0.55, 0.55, 0.8
#: What the long table of parts tells of a side and of a corner.
EDGE_PARTS, CORNER_PARTS = ("anomaly_ratio", "highlight_ratio", "roughness", "mean_intensity", "std_intensity", "profile_length"), ("highlight_ratio", "roughness", "mean_intensity", "std_intensity")
#: Bytes of rasters that leave a worker together.
RASTER_BYTES = 1 << 24


def _each(images: DataFrame, made: str, look: Callable[[dict], dict], carried: Sequence[str], rows_a_batch: int) -> DataFrame:
    """``carried`` columns and the columns ``made`` of ``look``, which gets a row's raster columns and the others; in Arrow batches.

    A batch that leaves holds ``rows_a_batch`` rows at most, and no more than RASTER_BYTES of rasters unless it is one row.
    """
    kinds = T.StructType.fromDDL(made)
    schema = T.StructType([*(images.schema[c] for c in carried), *kinds])
    types = [pa.field(f.name, to_arrow_type(f.dataType)) for f in kinds]
    names = images.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            whole = pa.RecordBatch.from_arrays(whole.columns, names)
            sizes = pc.fill_null(pc.binary_length(whole.column("data")), 0).to_pylist()
            at = 0
            while at < whole.num_rows:
                n, held = 1, sizes[at]
                while n < rows_a_batch and at + n < whole.num_rows and held + sizes[at + n] <= RASTER_BYTES:
                    held += sizes[at + n]
                    n += 1
                b = whole.slice(at, n)
                small = b.drop_columns(["data"]).to_pylist()
                found = [look(row | {"data": b.column("data")[k]}) for k, row in enumerate(small)]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carried), *(pa.array([x.get(t.name) for x in found], t.type) for t in types)], schema=pa.schema([*(b.schema.field(c) for c in carried), *types]))
                at += n

    return images.mapInArrow(run, schema)


def _raster(row: dict):
    from mintlens.pixels.filters import as_bgr

    return as_bgr(row["data"].as_buffer(), row["height"], row["width"], row["nChannels"])


def _first_look(row: dict) -> dict:
    from mintlens.pixels.measure import seen

    if row["nChannels"] is None or row["nChannels"] <= 0:
        return {"stage": "read_error"}
    try:
        return seen(_raster(row))
    except Exception as e:  # one image must not fail the others
        return {"stage": "exception", "error": f"{type(e).__name__}: {e}"}


def _second_look(row: dict) -> dict:
    from mintlens.pixels.measure import seen_again

    if row["look"] is None:
        return {"again": []}
    try:
        return {"again": seen_again(_raster(row), row["look"])}
    except Exception as e:
        return {"again": [], "failed": f"{type(e).__name__}: {e}"}


def _measure(row: dict) -> dict:
    import numpy as np
    from mintlens.pixels.measure import analyse

    out = {"origin": row["path"], "height": row["height"], "width": row["width"], "stage": row["stage"], "error": row["error"]}
    if row["stage"] == "read_error":
        return out | {"height": None, "width": None}
    if row["stage"] is not None:
        return out
    try:
        out["stage"], out["error"], found = analyse(_raster(row), np.array(row["quad"], np.float64).reshape(4, 2))
    except Exception as e:
        return out | {"stage": "exception", "error": f"{type(e).__name__}: {e}"}
    card = found.pop("card", {})
    return out | {"parts": found.pop("parts", None), "card_height": card.get("height"), "card_width": card.get("width")} | {f: {n: float(values[n]) for n in FAMILIES[f] if n in values} for f, values in found.items()}


def detected(images: DataFrame, keep: Sequence[str] = (), fallback: bool = True, rows_a_batch: int = 8) -> DataFrame:
    """The rasters with stage (null: go on), error, quad (eight numbers, in pixels of the raster) and a struct of the detection.

    One pass over the rasters offers candidates and line profiles, a row's candidates are ranked as an array of columns,
    and the box that lines tell takes part in the choice.  Where trust in the winner is below 0.55, or there is none, a
    second pass looks into its box, widened, and the better candidate stays; other rows go through it untouched.  Where
    nothing stands out a centred box is taken, or with ``fallback`` off the stage is ``detection_failed``.  Rasters move
    between Spark and its workers, but are never shuffled.
    """
    plain = images.select(*RASTER, *(F.col(c).alias(f"kept_{k}") for k, c in enumerate(keep)))
    carried = plain.columns
    d = _each(plain, LOOK, _first_look, carried, rows_a_batch)
    w, h = F.col("small_width"), F.col("small_height")
    d = d.withColumn("line_box", detection.line_box("columns", "rows", "small_width", "small_height")).drop("columns", "rows")
    box = F.when(F.col("line_box").isNotNull(), F.array(*(F.col(f"line_box.{n}") for n in ("x1", "y1", "x2", "y2"))))
    d = d.withColumn("line", box)
    fields = [x.rsplit(" ", 1)[0] for x in detection.CANDIDATE.split(", ")]
    d = d.withColumn("ranked", detection.ranked_pool(F.col("pool"), fields, w, h, F.col("line"))).drop("pool")
    d = d.withColumns(detection.winner(F.col("ranked"))).drop("ranked")
    slim = ("source", *detection.POINTS, "box", "score", "area", "aspect", "centre", "rectangularity", "edges", "silhouette")
    pick = lambda c: F.when(c.isNotNull(), F.struct(*(c[n].alias(n) for n in slim)))
    d = d.withColumn("winner", pick(F.col("winner")))
    weak = F.coalesce(detection.confidence(F.col("winner")), F.lit(0.0)) < LOOK_AGAIN
    seed = F.coalesce(F.col("winner.box"), F.col("line"))
    look = F.when(F.col("stage").isNull() & weak & seed.isNotNull(), F.array(*detection.widened([seed[k] for k in range(4)], w, h)))
    more = [*carried, "stage", "error", "small_height", "small_width", "line", "line_box", "winner", "offered", "competing"]
    d = d.withColumn("look", look).select(*more, "look")
    d = _each(d, f"again {POOL}", _second_look, [*more, "look"], rows_a_batch)
    d = d.withColumn("again", detection.ranked_pool(F.col("again"), fields, w, h, F.col("line")))
    d = d.withColumn("other", detection.winner(F.col("again"))["winner"]).drop("again")
    d = d.withColumn("other", pick(F.col("other")))
    better = F.col("other").isNotNull() & (F.col("winner").isNull() | (F.col("other.score") >= F.col("winner.score")))
    d = d.withColumn("winner", F.when(better, F.col("other")).otherwise(F.col("winner")))
    return _settled(d, w, h, fallback).select(*carried, "stage", "error", "quad", "detection")


def _settled(d: DataFrame, w: Column, h: Column, fallback: bool) -> DataFrame:
    """quad and detection of rows with winner and line box: the choice between the two, else the fallback box."""
    nothing = [F.lit(None).cast("double")] * 4
    line, own = [F.get("line", F.lit(k)) for k in range(4)], [F.get("winner.box", F.lit(k)) for k in range(4)]
    # each step is a column, as an expression it would be spelt out at every use
    d = d.withColumns({"chosen": chosen_box(line, own, w, h, nothing[0], nothing[0]), "same": F.coalesce(iou(line, own) >= SAME_BOX, F.lit(False))})
    # a candidate that passed all rules and is trusted stands, and where both tell the same box its corners are the finer ones
    trusted = F.col("same") | F.coalesce(detection.confidence(F.col("winner")) >= WEAK, F.lit(False))
    takes = (F.col("chosen") == "component") | ((F.col("chosen") == "projection") & trusted)
    d = d.withColumns({"takes": F.when(F.col("stage").isNull(), F.when(takes, "candidate").when(F.col("chosen") == "projection", "lines").otherwise("fallback"))})
    fall = fallback_box(w, h)["box"]
    corners = lambda b: F.array(b[0], b[1], b[2], b[1], b[2], b[3], b[0], b[3])
    quad = F.when(F.col("takes") == "candidate", F.array(*(F.col(f"winner.{p}") for p in detection.POINTS))).when(F.col("takes") == "lines", corners(line)).when(F.col("takes") == "fallback", corners([fall[k] for k in range(4)]))
    zoom = F.array(F.col("width") / w, F.col("height") / h)
    d = d.withColumn("quad", F.transform(quad, lambda v, k: v * zoom[k % 2]))
    if not fallback:
        d = d.withColumn("stage", F.when(F.col("takes") == "fallback", "detection_failed").otherwise(F.col("stage"))).withColumn("quad", F.when(F.col("takes") != "fallback", F.col("quad")))
    candidate, trust = F.col("takes") == "candidate", detection.confidence(F.col("winner"))
    of = lambda n: F.when(candidate, F.col(f"winner.{n}"))
    found = {
        "best_score": F.when(candidate, F.col("winner.score")).when(F.col("takes") == "lines", F.col("line_box.score")).otherwise(0.0),
        "detection_confidence": F.when(candidate, trust).when(F.col("takes") == "lines", clamp(0.45 * F.col("line_box.score"))).otherwise(0.0),
        "used_fallback": (F.col("takes") == "fallback").cast("double"),
        "aspect_score": of("aspect"), "area_score": of("area"), "centre_score": of("centre"), "rectangularity": of("rectangularity"), "edge_support": of("edges"), "silhouette": of("silhouette"),
        "candidates": F.col("offered").cast("double"), "competing": F.col("competing").cast("double"), "second_look": F.col("look").isNotNull().cast("double"),
        **{p: F.get("quad", F.lit(k)) for k, p in enumerate(detection.POINTS)},
    }
    found["weak_detection"] = ((F.col("takes") == "fallback") | (found["detection_confidence"] < WEAK)).cast("double")
    return d.withColumn("detection", F.when(F.col("quad").isNotNull(), F.struct(*(found[n].alias(n) for n in FAMILIES["detection"]))))


def measured(images: DataFrame, rows_a_batch: int = 8, keep: Sequence[str] = (), fallback: bool = True) -> DataFrame:
    """The columns ``keep``, then origin, height, width, stage, error and a struct of raw measurements for each family.

    A file that did not decode has the stage ``read_error``; an image on which a pass fails keeps a row with the stage
    ``exception`` and the message, one whose quad can't be turned to the front ``warp_failed``, one whose card can't be
    measured ``features_failed``, and the others go on.  ``detected`` says how the card is found.  Spark's
    ``arrow.maxBytesPerBatch`` bounds what a worker receives at once.
    """
    kept = [f"kept_{k}" for k in range(len(keep))]
    d = cards(images, keep, fallback, rows_a_batch)
    d = parts.families(d, F.col("card_height").cast("double"), F.col("card_width").cast("double"))
    d = d.withColumn("surface", _with("surface", lighting_blur=F.col("visual.blur_score"), lighting_contrast=F.col("visual.contrast_score")))
    typed = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name not in FAMILIES else _completed(f.name) for f in T.StructType.fromDDL(ANALYSIS)]
    return d.select(*(F.col(c).alias(name) for c, name in zip(kept, keep, strict=True)), *typed)


def _completed(family: str) -> Column:
    """A family's struct with all its fields, null where they are not measured."""
    has = {"visual": VISUAL, "edge": [n for n in EDGE if n.split("_", 1)[-1] in EDGE_PARTS], "corner": [n for n in CORNER if n.split("_", 2)[-1] in CORNER_PARTS]}.get(family)
    if has is None:
        return F.col(family)
    return F.when(F.col(family).isNotNull(), F.struct(*((F.col(f"{family}.{n}") if n in has else F.lit(None).cast("double")).alias(n) for n in FAMILIES[family]))).alias(family)


def cards(images: DataFrame, keep: Sequence[str] = (), fallback: bool = True, rows_a_batch: int = 8) -> DataFrame:
    """kept_0 and so on, stage, the families that the raster pass measures itself, and ``parts``, an array of what it sees of
    each part of the card: ``parts.long_table`` makes rows of them.
    """
    found = detected(images, keep, fallback, rows_a_batch)
    kept = [f"kept_{k}" for k in range(len(keep))]
    made = [f for f in T.StructType.fromDDL(ANALYSIS) if f.name not in ("detection", "visual", "edge", "corner")]
    ddl = ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in made)
    return _each(found, f"{ddl}, card_height int, card_width int, parts array<{parts.PART}>", _measure, [*kept, "detection"], rows_a_batch)


def _parts_look(row: dict) -> dict:
    from mintlens.pixels import measure

    if row["nChannels"] is None or row["nChannels"] <= 0:
        return {}
    try:
        return {"parts": measure.parts(_raster(row))}
    except Exception as e:  # one image must not fail the others
        return {"error": f"{type(e).__name__}: {e}"}


def card_parts(rasters: DataFrame, keep: Sequence[str] = (), rows_a_batch: int = 64) -> DataFrame:
    """``keep``, error, family, part and metrics: nine rows for each raster that shows a card and nothing else.

    A raster that can't be read gives one row without a part, with the message if there is one.
    """
    plain = rasters.select(*RASTER, *(F.col(c).alias(f"kept_{k}") for k, c in enumerate(keep)))
    kept = [f"kept_{k}" for k in range(len(keep))]
    d = _each(plain, f"error string, parts array<{parts.PART}>", _parts_look, kept, rows_a_batch)
    m = d.withColumn("m", parts.metrics(F.col("parts"))).select(*(F.col(c).alias(n) for c, n in zip(kept, keep, strict=True)), "error", F.explode_outer("m").alias("m"))
    return m.select(*keep, "error", "m.*")


def _with(block: str, **values: Column) -> Column:
    """A family's struct with fields replaced; null stays null."""
    c = F.col(block)
    for name, value in values.items():
        c = c.withField(name, value)
    return F.when(F.col(block).isNotNull(), c)


def scored(df: DataFrame) -> DataFrame:
    """Measurements completed by the scores of parts, and by the composite scores as columns of their own."""
    e, k, s, p, c, v = (lambda n, b=b: F.col(f"{b}.{n}") for b in ("edge", "corner", "surface", "postwarp", "centering", "visual"))
    band = {f"{x}_edge_score": 100.0 * (1.0 - clamp(0.45 * span(e(f"{x}_anomaly_ratio"), 0.02, 0.22) + 0.30 * span(e(f"{x}_roughness"), 2.5, 18.0) + 0.25 * span(e(f"{x}_highlight_ratio"), 0.01, 0.18))) for x in SIDES}
    flat = lambda x: F.when(k(f"{x}_std_intensity") < 8.0, span(8.0 - k(f"{x}_std_intensity"), 0.0, 8.0) * 0.20).otherwise(0.0)
    patch = {f"{x}_corner_score": 100.0 * (1.0 - clamp(0.35 * span(k(f"{x}_highlight_ratio"), 0.01, 0.20) + 0.45 * span(k(f"{x}_roughness"), 35.0, 550.0) + 0.20 * flat(x))) for x in CORNERS}
    d = df.withColumns({
        "geometry": _with("geometry", aspect_quality=aspect_quality(v("aspect_ratio"))),
        "centering": _with("centering", horizontal_balance=rounded(balance(c("left_margin"), c("right_margin")), 3), vertical_balance=rounded(balance(c("top_margin"), c("bottom_margin")), 3)),
        "edge": _with("edge", **band, edge_confidence=clamp(0.45 * span(s("lighting_blur"), 40.0, 300.0) + 0.30 * span(s("lighting_contrast"), 20.0, 70.0) + 0.25 * span(mean(*(e(f"{x}_std_intensity") for x in SIDES)), 8.0, 35.0))),
        "corner": _with("corner", **patch, corner_confidence=clamp(0.45 * span(s("lighting_blur"), 40.0, 450.0) + 0.30 * span(s("lighting_contrast"), 20.0, 70.0) + 0.25 * span(mean(*(k(f"{x}_std_intensity") for x in CORNERS)), 8.0, 35.0))),
        "surface": _with("surface", surface_score=scoring.surface_penalised(s("glare_ratio"), s("texture_anomaly_ratio"), s("dark_spot_ratio"))),
        "postwarp": _with("postwarp", rectified_aspect_ratio_deviation=F.abs(p("rectified_aspect_ratio") - 0.714), outer_border_score=mean(*(p(f"{x}_border_score") for x in SIDES)), outer_border_continuity_score=mean(*(p(f"{x}_border_continuity") for x in SIDES)), crop_risk_score=mean(*(p(f"{x}_crop_risk") for x in SIDES)), margin_consistency_score=0.5 * clamp(1.0 - F.abs(p("top_border_peak_ratio") - p("bottom_border_peak_ratio")) / 0.35) + 0.5 * clamp(1.0 - F.abs(p("left_border_peak_ratio") - p("right_border_peak_ratio")) / 0.35)),
    })
    dev = p("rectified_aspect_ratio_deviation")
    aspect = steps(dev, (0.025, 1.0), (0.055, 0.82), (0.090, 0.55), otherwise=F.greatest(F.lit(0.0), 1.0 - dev / 0.18))
    raw_edge, raw_corner = mean(*(e(f"{x}_edge_score") for x in SIDES)), mean(*(k(f"{x}_corner_score") for x in CORNERS))
    d = d.withColumns({
        "score_capture": scoring.capture(v("blur_score"), v("brightness_score"), v("contrast_score")),
        "centering": _with("centering", overall_centering=rounded((c("horizontal_balance") + c("vertical_balance")) / 2.0, 3)),
        "edge": _with("edge", edge_score_raw=raw_edge, edge_score=rules.damped(raw_edge, e("edge_confidence")), worst_side_score=F.least(*(e(f"{x}_edge_score") for x in SIDES))),
        "corner": _with("corner", corner_score_raw=raw_corner, corner_score=rules.damped(raw_corner, k("corner_confidence")), worst_corner_score=F.least(*(k(f"{x}_corner_score") for x in CORNERS))),
        "postwarp": _with("postwarp", rectified_aspect_ratio_score=aspect, frame_coherence_score=clamp(0.40 * p("outer_border_score") + 0.30 * p("outer_border_continuity_score") + 0.30 * p("margin_consistency_score"))),
    })
    d = d.withColumns({
        "surface": _with("surface", lighting_capture=F.col("score_capture"), whitening_score=scoring.whitening_penalised(s("edge_whitening_ratio"), s("corner_whitening_ratio"), s("lighting_blur"), s("lighting_contrast"), "score_capture", s("surface_score"))),
        "postwarp": _with("postwarp", postwarp_score_raw=clamp(0.24 * p("rectified_aspect_ratio_score") + 0.26 * p("outer_border_score") + 0.18 * p("outer_border_continuity_score") + 0.16 * p("margin_consistency_score") + 0.16 * (1.0 - p("crop_risk_score")))),
    })
    d = d.withColumn("surface", _with("surface", whitening_surface_score=0.55 * s("whitening_score") + 0.45 * s("surface_score")))
    done = lambda x: F.when(F.col("stage") == "done", x)  # noqa: E731  a clamped null would be the least score
    d = d.withColumns({
        "score_prelim": done(scoring.preliminary("score_capture", F.col("geometry.coverage_ratio"), v("aspect_ratio"), F.col("detection.used_fallback"))),
        "score_centering": done(scoring.centering(c("horizontal_balance"), c("vertical_balance"))),
        "score_edge": done(scoring.edge(e("edge_score"), e("edge_confidence"))),
        "score_corner": done(scoring.corner(k("corner_score"), k("corner_confidence"))),
        "score_ws": done(scoring.surface(s("whitening_surface_score"), s("whitening_confidence"), s("surface_confidence"))),
    })
    made = {
        "capture": scoring.capture_parts(v("blur_score"), v("brightness_score"), v("contrast_score")),
        "prelim": scoring.preliminary_parts("score_capture", F.col("geometry.coverage_ratio"), v("aspect_ratio"), F.col("detection.used_fallback")),
        "centering": {"horizontal_component": c("horizontal_balance"), "vertical_component": c("vertical_balance")},
        "edge": scoring.confident_parts(e("edge_score"), 100.0, e("edge_confidence"), "edge") | {f"{x}_edge_score": e(f"{x}_edge_score") for x in SIDES},
        "corner": scoring.confident_parts(k("corner_score"), 100.0, k("corner_confidence"), "corner") | {f"{x}_corner_score": k(f"{x}_corner_score") for x in CORNERS},
        "ws": scoring.surface_parts(*(s(n) for n in ("whitening_score", "surface_score", "whitening_surface_score", "whitening_confidence", "surface_confidence"))) | {n: s(n) for n in SCORE_PARTS["ws"][6:]},
    }
    digits = lambda n: 2 if n.endswith("_score") else 4 if n.endswith("_ratio") else 3
    d = d.withColumns({f"score_{part}_{n}": done(rounded(made[part][n], digits(n))) for part, names in SCORE_PARTS.items() for n in names})
    doubt = (e("edge_confidence"), k("corner_confidence"), 0.5 * clamp(s("whitening_confidence")) + 0.5 * clamp(s("surface_confidence")))
    parts = ("score_prelim", "score_centering", "score_edge", "score_corner", "score_ws")
    for n, version in ((2, "v1"), (3, "v2"), (4, "v3"), (5, "v4")):
        d = d.withColumn(f"score_condition_{version}", done(scoring.condition(version, parts[:n], doubt[: n - 2])["condition"]))
    return d


def dataset(images: DataFrame, fallback: bool = True) -> DataFrame:
    """The wide row of every image: keys, status, flat measurements and scores, the leading columns first.

    One pass decodes and measures; the names of an image travel through it, so repeated paths each keep their row.
    """
    named = images.withColumnsRenamed({"relative_path": "relative_path_from_raw", "label": "categoria_carpeta_raw"})
    d = scored(measured(named, keep=("image_id", "image_filename", "relative_path_from_raw", "categoria_carpeta_raw"), fallback=fallback))
    post = clamp(safe(F.col("postwarp.postwarp_score_raw")) * rules.context_factor("detection.weak_detection", "detection.detection_confidence"))
    decided = rules.postwarp_decision(post, *(safe(F.col(f"postwarp.{n}")) for n in ("rectified_aspect_ratio_score", "outer_border_score", "outer_border_continuity_score", "margin_consistency_score", "crop_risk_score")))
    d = d.withColumns({"postwarp_valid": decided["postwarp_valid"], "postwarp_score": post, "postwarp_retry": decided["retry_recommended"]})
    status = rules.capture_status(
        F.col("detection.used_fallback"), F.col("detection.best_score"), F.col("detection.weak_detection"), F.col("detection.detection_confidence"), rounded(F.col("geometry.coverage_ratio"), 3),
        F.col("visual.blur_score"), F.col("visual.brightness_score"), F.col("visual.contrast_score"), F.col("edge.edge_confidence"), F.col("corner.corner_confidence"), "postwarp_valid", "postwarp_score", "postwarp_retry",
    )
    ended = rules.stage_status("stage")
    d = d.withColumns({
        "analysis_status": F.coalesce(ended, status["analysis_status"]),
        "invalid_reasons": F.when(ended.isNull(), status["invalid_reasons"]).otherwise(F.col("stage")),
        "usable_for_condition_model": ended.isNull() & status["usable_for_condition_model"],
        "procesado_exito": F.col("stage") == "done",
        "capture_assessment": rules.capture_assessment(F.col("detection.used_fallback"), F.col("geometry.coverage_ratio"), F.col("visual.aspect_ratio"), "score_capture"),
        "capture_message": rules.capture_message(F.col("detection.used_fallback"), F.col("geometry.coverage_ratio"), F.col("visual.aspect_ratio"), "score_capture"),
        "edge": _with("edge", edge_label=rules.part_label(F.col("edge.edge_score"))),
        "corner": _with("corner", corner_label=rules.part_label(F.col("corner.corner_score_raw"))),
    }).withColumnsRenamed({"stage": "pipeline_stage", "height": "image_height", "width": "image_width", "centering": "centrado", "edge": "borde", "corner": "esquina", "surface": "superficie"})
    label = rules.normal_label("categoria_carpeta_raw")
    full = d.drop("origin").withColumns({"label_condition": label, "target_damaged": rules.label_target(label), "run_timestamp": F.current_timestamp(), "feature_schema_version": F.lit(SCHEMA_VERSION)})
    return leading_first(flatten(full))
