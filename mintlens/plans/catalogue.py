"""The registered queries of the card-condition library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays, math, text
from ..operators import candidates as boxes
from ..operators import flatten, pricing, profiling, ranking, rules, scoring
from ..session import compilable
from ..sources.images import with_names
from .proxies import CAPTURES_SQL, KEYS, LABELLED_SQL, PROFILES_SQL, captures, labelled, profiles, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def add(name: str, source: Callable[[SparkSession, str], DataFrame], build: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    query(name, sql)(lambda spark, d: build(source(spark, d)))


def of(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: table(spark, d, name)


# -- SQL spellings of the shared expressions -------------------------------------------------------------------------------
K = ", ".join(KEYS)


def clamp(x: str, lo: float = 0, hi: float = 1) -> str:
    return f"least(greatest({x}, {lo}::DOUBLE), {hi}::DOUBLE)"


def ten(x: str) -> str:
    return f"(1.0::DOUBLE + {clamp(x)} * 9.0::DOUBLE)"


def share(x: str) -> str:
    return clamp(f"({x} - 1.0::DOUBLE) / 9.0::DOUBLE")


def rnd(x: str, n: int) -> str:
    return f"floor(({x}) * {10**n}::DOUBLE + 0.5::DOUBLE) / {10**n}::DOUBLE"


CAP = rnd(ten(f"0.50::DOUBLE * {clamp('blur / 400.0::DOUBLE')} + 0.25::DOUBLE * {clamp('1.0::DOUBLE - abs(brightness - 150.0::DOUBLE) / 150.0::DOUBLE')} + 0.25::DOUBLE * {clamp('contrast / 80.0::DOUBLE')}"), 2)
ASPECT = clamp("1.0::DOUBLE - abs(aspect - 0.715::DOUBLE) / 0.10::DOUBLE")
PRELIM = rnd(ten(f"0.55::DOUBLE * {share('s_capture')} + 0.30::DOUBLE * {clamp('coverage / 0.60::DOUBLE')} + 0.15::DOUBLE * {ASPECT} - CASE WHEN used_fallback THEN 0.20::DOUBLE ELSE 0.0::DOUBLE END"), 2)
CENTER = rnd(ten(f"0.5::DOUBLE * {clamp('h_bal')} + 0.5::DOUBLE * {clamp('v_bal')}"), 2)


def confident(x: str, full: int, conf: str) -> str:
    return rnd(ten(f"{clamp(f'{x} / {full}.0::DOUBLE')} * (0.75::DOUBLE + 0.25::DOUBLE * {clamp(conf)})"), 2)


EDGE, CORNER = confident("edge_raw", 100, "edge_conf"), confident("corner_raw", 100, "corner_conf")
SURFACE_CONF = f"0.5::DOUBLE * {clamp('whitening_conf')} + 0.5::DOUBLE * {clamp('surface_conf')}"
COMBINED = "(0.55::DOUBLE * whitening + 0.45::DOUBLE * surface)"
SURFACE = confident(COMBINED, 10, SURFACE_CONF)
SCORED_SQL = f"WITH {CAPTURES_SQL}, s1 AS (SELECT *, {CAP} AS s_capture FROM captures), scored AS (SELECT *, {PRELIM} AS s_prelim, {CENTER} AS s_center, {EDGE} AS s_edge, {CORNER} AS s_corner, {SURFACE} AS s_surface, {SURFACE_CONF} AS s_conf FROM s1)"


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Captures with their rounded part scores, which the composites take as they are shown."""
    c = captures(spark, d).withColumn("s_capture", scoring.capture("blur", "brightness", "contrast"))
    return c.withColumns({
        "s_prelim": scoring.preliminary("s_capture", "coverage", "aspect", "used_fallback"),
        "s_center": scoring.centering("h_bal", "v_bal"),
        "s_edge": scoring.edge("edge_raw", "edge_conf"),
        "s_corner": scoring.corner("corner_raw", "corner_conf"),
        "s_surface": scoring.surface(0.55 * F.col("whitening") + 0.45 * F.col("surface"), "whitening_conf", "surface_conf"),
        "s_conf": 0.5 * math.clamp("whitening_conf") + 0.5 * math.clamp("surface_conf"),
    })


for _name, _column in (("score_capture", "s_capture"), ("score_preliminary", "s_prelim"), ("score_centering", "s_center"), ("score_edge", "s_edge"), ("score_corner", "s_corner"), ("score_surface", "s_surface")):
    add(_name, scored, lambda df, c=_column: df.select(*KEYS, F.col(c).alias("score")), f"{SCORED_SQL} SELECT {K}, {_column} AS score FROM scored")

_PARTS = {"v1": 2, "v2": 3, "v3": 4, "v4": 5}
_SCORES, _CONFS = ("s_prelim", "s_center", "s_edge", "s_corner", "s_surface"), ("edge_conf", "corner_conf", "s_conf")


def _condition(df: DataFrame, version: str) -> DataFrame:
    n = _PARTS[version]
    return df.select(*KEYS, *((math.rounded(c, 6) if k.startswith("weight") else c).alias(k) for k, c in scoring.condition(version, _SCORES[:n], _CONFS[: n - 2]).items()))


def _condition_sql(version: str) -> str:
    base = scoring.CONDITION_WEIGHTS[version]
    kept = [f"{w}::DOUBLE * (0.60::DOUBLE + 0.40::DOUBLE * {clamp(c)})" for w, c in zip(base[2:], _CONFS, strict=False)]
    first = f"{base[0]}::DOUBLE" + "".join(f" + ({w}::DOUBLE - {k})" for w, k in zip(base[2:], kept, strict=True))
    weights = [first, f"{base[1]}::DOUBLE", *kept]
    total = " + ".join(f"({w}) * {share(s)}" for w, s in zip(weights, _SCORES, strict=False))
    return f"{SCORED_SQL} SELECT {K}, {rnd(ten(total), 2)} AS condition, {', '.join(f'{rnd(w, 6)} AS weight_{p}' for w, p in zip(weights, scoring.PARTS, strict=False))} FROM scored"


for _v in _PARTS:
    add(f"condition_{_v}", scored, lambda df, v=_v: _condition(df, v), _condition_sql(_v))

_DOUBT = "CASE WHEN s_capture < 7.0 THEN 0.50::DOUBLE ELSE 1.0::DOUBLE END" + "".join(f" * CASE WHEN {x} < {limit} THEN {f}::DOUBLE ELSE 1.0::DOUBLE END" for x, limit, f in (("blur", 150, 0.8), ("blur", 100, 0.6), ("contrast", 30, 0.85), ("contrast", 20, 0.6)))
_WHITE = clamp(f"10.0::DOUBLE - ({_DOUBT}) * (5.0::DOUBLE * least(1.0::DOUBLE, edge_ratio / 0.20::DOUBLE) + 5.0::DOUBLE * least(1.0::DOUBLE, corner_ratio / 0.25::DOUBLE))", 0, 10)
add(
    "whitening_score",
    scored,
    lambda df: df.select(*KEYS, math.rounded(scoring.whitening_penalised("edge_ratio", "corner_ratio", "blur", "contrast", "s_capture", "surface"), 6).alias("score")),
    f"{SCORED_SQL} SELECT {K}, {rnd(f'CASE WHEN surface > 8.5 AND {_WHITE} < 3.5 THEN 3.5::DOUBLE ELSE {_WHITE} END', 6)} AS score FROM scored",
)
add(
    "surface_score",
    captures,
    lambda df: df.select(*KEYS, math.rounded(scoring.surface_penalised("glare", "texture", "dark_spots"), 6).alias("score")),
    f"WITH {CAPTURES_SQL} SELECT {K}, {rnd(clamp('10.0::DOUBLE - (4.0::DOUBLE * least(1.0::DOUBLE, glare / 0.03::DOUBLE) + 3.5::DOUBLE * least(1.0::DOUBLE, texture / 0.08::DOUBLE) + 2.5::DOUBLE * least(1.0::DOUBLE, dark_spots / 0.04::DOUBLE))', 0, 10), 6)} AS score FROM captures",
)

# -- status -------------------------------------------------------------------------------------------------------------------
_BAD = """[CASE WHEN used_fallback AND best_score < 0.50 THEN 'fallback_detection' END, CASE WHEN weak AND det_conf < 0.45 THEN 'weak_detection' END,
 CASE WHEN coverage < 0.15 THEN 'low_coverage' END, CASE WHEN coverage > 0.99 THEN 'excessive_coverage' END, CASE WHEN blur < 70 THEN 'blurry_image' END,
 CASE WHEN brightness < 75 THEN 'too_dark' END, CASE WHEN brightness > 235 THEN 'too_bright' END, CASE WHEN contrast < 20 THEN 'low_contrast' END,
 CASE WHEN edge_conf < 0.45 THEN 'low_edge_confidence' END, CASE WHEN corner_conf < 0.45 THEN 'low_corner_confidence' END,
 CASE WHEN NOT postwarp_valid AND postwarp_score < 0.45 THEN 'invalid_postwarp' END]"""
_ODD = """[CASE WHEN used_fallback AND best_score >= 0.50 THEN 'fallback_used' END, CASE WHEN weak AND det_conf >= 0.45 THEN 'weak_detection' END,
 CASE WHEN (NOT postwarp_valid AND postwarp_score >= 0.45) OR (retry AND NOT (NOT postwarp_valid AND postwarp_score < 0.45)) THEN 'weak_postwarp' END,
 CASE WHEN coverage >= 0.28 AND coverage < 0.38 THEN 'borderline_low_coverage' END, CASE WHEN coverage > 0.90 AND coverage <= 0.99 THEN 'borderline_high_coverage' END,
 CASE WHEN blur >= 70 AND blur < 120 THEN 'moderate_blur' END, CASE WHEN brightness >= 75 AND brightness < 95 THEN 'suboptimal_dark_brightness' END,
 CASE WHEN brightness > 210 AND brightness <= 235 THEN 'suboptimal_high_brightness' END, CASE WHEN contrast >= 20 AND contrast < 30 THEN 'suboptimal_contrast' END,
 CASE WHEN edge_conf >= 0.45 AND edge_conf < 0.60 THEN 'moderate_edge_confidence' END, CASE WHEN corner_conf >= 0.45 AND corner_conf < 0.60 THEN 'moderate_corner_confidence' END,
 CASE WHEN det_conf >= 0.45 AND det_conf < 0.60 THEN 'moderate_detection_confidence' END, CASE WHEN postwarp_score >= 0.45 AND postwarp_score < 0.60 THEN 'moderate_postwarp_score' END]"""


def _listed(x: str) -> str:
    return f"array_to_string(list_sort(list_distinct(list_filter({x}, lambda r: r IS NOT NULL))), '|')"


STATUS_SQL = f"""WITH {CAPTURES_SQL}, found AS (SELECT *, {_listed(_BAD)} AS bad, {_listed(_ODD)} AS odd FROM captures),
status AS (SELECT *, CASE WHEN bad <> '' THEN 'invalid_capture' WHEN odd <> '' THEN 'valid_with_warning' ELSE 'valid' END AS analysis_status, CASE WHEN bad <> '' THEN bad ELSE odd END AS invalid_reasons FROM found)"""


def judged(spark: SparkSession, d: str) -> DataFrame:
    return rules.with_status(captures(spark, d))


add("capture_status_distribution", judged, lambda df: df.groupBy("analysis_status").agg(F.count(F.lit(1)).alias("count"), math.rounded(F.avg(scoring.capture("blur", "brightness", "contrast")), 6).alias("mean_score")), f"{STATUS_SQL} SELECT analysis_status, count(*) AS count, {rnd(f'avg({CAP})', 6)} AS mean_score FROM status GROUP BY 1")
add("status_rules", judged, lambda df: df.select(*KEYS, "analysis_status", "invalid_reasons", "usable_for_condition_model"), f"{STATUS_SQL} SELECT {K}, analysis_status, invalid_reasons, analysis_status = 'valid' AS usable_for_condition_model FROM status")
add(
    "status_pct",
    judged,
    lambda df: df.agg(math.rounded(profiling.percent(F.col("usable_for_condition_model")), 2).alias("usable_pct"), math.rounded(100.0 - profiling.percent(F.col("usable_for_condition_model")), 2).alias("other_pct")),
    f"{STATUS_SQL} SELECT {rnd('avg(CASE WHEN analysis_status = ' + chr(39) + 'valid' + chr(39) + ' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100.0::DOUBLE', 2)} AS usable_pct, {rnd('100.0::DOUBLE - avg(CASE WHEN analysis_status = ' + chr(39) + 'valid' + chr(39) + ' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100.0::DOUBLE', 2)} AS other_pct FROM status",
)
add(
    "status_counts",
    judged,
    lambda df: df.agg(
        F.count(F.lit(1)).alias("total"), *(F.count_if(F.col("analysis_status") == s).alias(s) for s in ("valid", "valid_with_warning", "invalid_capture")),
        F.count_if("used_fallback").alias("fallback"), F.count_if("weak").alias("weak"), F.count_if("postwarp_valid").alias("postwarp_valid"),
    ),
    f"{STATUS_SQL} SELECT count(*) AS total, count(*) FILTER (analysis_status = 'valid') AS valid, count(*) FILTER (analysis_status = 'valid_with_warning') AS valid_with_warning, count(*) FILTER (analysis_status = 'invalid_capture') AS invalid_capture, count(*) FILTER (used_fallback) AS fallback, count(*) FILTER (weak) AS weak, count(*) FILTER (postwarp_valid) AS postwarp_valid FROM status",
)
add("top_reasons", judged, profiling.reason_counts, f"{STATUS_SQL} SELECT trim(r) AS reason, count(*) AS count FROM (SELECT unnest(string_split(invalid_reasons, '|')) AS r FROM status) WHERE trim(r) <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
add("sample_weight", judged, lambda df: df.groupBy("analysis_status", rules.sample_weight("analysis_status").alias("weight")).agg(F.count(F.lit(1)).alias("count")), f"{STATUS_SQL} SELECT analysis_status, CASE WHEN analysis_status = 'valid_with_warning' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS weight, count(*) AS count FROM status GROUP BY 1, 2")
add(
    "capture_assessment",
    scored,
    lambda df: df.select(*KEYS, rules.capture_assessment("used_fallback", "coverage", "aspect", "s_capture").alias("level")),
    f"{SCORED_SQL} SELECT {K}, CASE WHEN used_fallback THEN 'deficiente' WHEN coverage > 0.95 THEN CASE WHEN s_capture >= 5 THEN 'mejorable' ELSE 'deficiente' END WHEN aspect BETWEEN 0.65 AND 0.78 AND coverage >= 0.35 AND s_capture >= 7 THEN 'buena' WHEN aspect BETWEEN 0.65 AND 0.78 AND coverage >= 0.22 AND s_capture >= 5 THEN 'mejorable' ELSE 'deficiente' END AS level FROM scored",
)


def _postwarp(df: DataFrame) -> DataFrame:
    d = df.withColumn("score", math.clamp(F.col("postwarp_score") * rules.context_factor("weak", "det_conf")))
    return d.select(*KEYS, math.rounded("score", 6).alias("score"), *(c.alias(n) for n, c in rules.postwarp_decision("score", "h_bal", "best_score", "edge_conf", "corner_conf", "postwarp_score").items()))


_FACTOR = "(CASE WHEN weak THEN 0.95::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN det_conf > 0 AND det_conf < 0.40 THEN 0.96::DOUBLE ELSE 1.0::DOUBLE END)"
_VALID = "score >= 0.56 AND h_bal >= 0.35 AND postwarp_score <= 0.78 AND best_score >= 0.30"
_REASONS = _listed("[CASE WHEN h_bal < 0.35 THEN 'implausible_rectified_aspect_ratio' END, CASE WHEN best_score < 0.30 THEN 'weak_outer_border_visibility' END, CASE WHEN edge_conf < 0.28 THEN 'weak_outer_border_continuity' END, CASE WHEN corner_conf < 0.24 THEN 'inconsistent_outer_margins' END, CASE WHEN postwarp_score > 0.78 THEN 'high_crop_risk' END]")
add("postwarp_validity", captures, _postwarp, f"WITH {CAPTURES_SQL}, x AS (SELECT *, {clamp(f'postwarp_score * {_FACTOR}')} AS score FROM captures) SELECT {K}, {rnd('score', 6)} AS score, {_VALID} AS postwarp_valid, NOT ({_VALID}) OR score < 0.64 OR postwarp_score > 0.55 OR edge_conf < 0.42 AS retry_recommended, {_REASONS} AS postwarp_reasons FROM x")
add(
    "quality_labels",
    captures,
    lambda df: df.select(*KEYS, math.rounded(rules.damped("edge_raw", "surface_conf"), 6).alias("damped"), rules.part_label(rules.damped("edge_raw", "surface_conf")).alias("label")),
    f"WITH {CAPTURES_SQL}, x AS (SELECT *, edge_raw * CASE WHEN surface_conf < 0.20 THEN 0.85::DOUBLE WHEN surface_conf < 0.35 THEN 0.92::DOUBLE ELSE 1.0::DOUBLE END AS v FROM captures) SELECT {K}, {rnd('v', 6)} AS damped, CASE WHEN v >= 85 THEN 'good' WHEN v >= 70 THEN 'acceptable' WHEN v >= 50 THEN 'weak' ELSE 'poor' END AS label FROM x",
)
_FINAL = "coalesce(CASE WHEN l_partkey % 3 <> 0 THEN s_surface END, CASE WHEN l_partkey % 2 <> 0 THEN s_edge END, CASE WHEN l_partkey % 12 <> 0 THEN s_prelim END)"


def _final(df: DataFrame) -> DataFrame:
    return df.withColumn("final", rules.final_score(F.when(F.col("l_partkey") % 3 != 0, F.col("s_surface")), F.when(F.col("l_partkey") % 2 != 0, F.col("s_edge")), F.when(F.col("l_partkey") % 12 != 0, F.col("s_prelim"))))


add("score_label", scored, lambda df: _final(df).groupBy(rules.score_label("final").alias("label")).agg(F.count(F.lit(1)).alias("count")), f"{SCORED_SQL}, f AS (SELECT {_FINAL} AS x FROM scored) SELECT CASE WHEN x IS NULL THEN 'Sin evaluacion' WHEN x >= 9 THEN 'Excelente' WHEN x >= 8 THEN 'Muy buena' WHEN x >= 7 THEN 'Buena' WHEN x >= 5.5 THEN 'Mejorable' ELSE 'No confiable' END AS label, count(*) AS count FROM f GROUP BY 1")
_PLUS = ", ".join(f"CASE WHEN {c} >= 8 THEN '+{n}' WHEN {c} < 6 THEN '-{n}' END" for n, c in (("centering", "s_center"), ("edge", "s_edge"), ("corner", "s_corner"), ("surface", "s_surface"), ("capture", "s_capture")))
add(
    "findings",
    scored,
    lambda df: df.select(*KEYS, F.array_join(rules.findings({"centering": "s_center", "edge": "s_edge", "corner": "s_corner", "surface": "s_surface", "capture": "s_capture"}), ",").alias("findings")),
    f"{SCORED_SQL} SELECT {K}, array_to_string((list_filter([{_PLUS}], lambda x: x IS NOT NULL))[1:4], ',') AS findings FROM scored",
)

# -- sources, labels, projections ------------------------------------------------------------------------------------------------
add(
    "scan_path_labels",
    of("pages"),
    lambda df: with_names(df.select("page_id", F.concat(F.lit("/raw/"), F.regexp_extract("url", r"://[^/]+/(.*)$", 1)).alias("path")), "/raw").select("page_id", "label", F.col("image_filename").alias("filename"), F.lower("relative_path").rlike(r"\.(jpg|jpeg|png|webp|html)$").alias("listed")),
    "WITH r AS (SELECT page_id, regexp_extract(url, '://[^/]+/(.*)$', 1) AS rel FROM pages) SELECT page_id, CASE WHEN len(string_split(rel, '/')) >= 2 THEN lower(trim(string_split(rel, '/')[1])) ELSE 'unknown' END AS label, string_split(rel, '/')[-1] AS filename, regexp_matches(lower(rel), '\\.(jpg|jpeg|png|webp|html)$') AS listed FROM r",
)
_SPELL = "CASE doc_id % 8 WHEN 0 THEN ' Damaged ' WHEN 1 THEN 'ROTAS' WHEN 2 THEN 'dañada' WHEN 3 THEN 'undamaged' WHEN 4 THEN 'Clean' WHEN 5 THEN 'ok' WHEN 6 THEN 'other' END"
add(
    "label_normalise",
    of("documents"),
    lambda df: df.select("doc_id", rules.normal_label(F.expr(_SPELL)).alias("label")).withColumn("target", rules.label_target("label")),
    f"WITH s AS (SELECT doc_id, lower(trim({_SPELL})) AS s FROM documents), l AS (SELECT doc_id, CASE WHEN s IN ('damaged', 'damage', 'rotas', 'rota', 'danada', 'dañada') THEN 'damaged' WHEN s IN ('undamaged', 'clean', 'sana', 'sin_danio', 'sin_daño', 'ok') THEN 'undamaged' ELSE 'unknown' END AS label FROM s) SELECT doc_id, label, CASE label WHEN 'damaged' THEN 1 WHEN 'undamaged' THEN 0 END AS target FROM l",
)
add(
    "flatten_props",
    of("events"),
    lambda df: flatten.flatten(df.select("event_id", F.struct("user_id", F.from_json("props", "k INT").alias("props"), F.array("value").alias("dropped")).alias("event"))),
    "SELECT event_id, user_id AS event_user_id, CAST(json_extract(props, '$.k') AS INT) AS event_props_k FROM events",
)
add(
    "numeric_flatten",
    of("events"),
    lambda df: flatten.prefixed(df.select(F.struct("user_id", "value", "event_type", (F.col("event_id") % 2 == 0).alias("even"), F.struct(F.nullif(F.col("event_id") % 3, F.lit(0)).alias("rest")).alias("more")).alias("event")), {"event": "visual_"}),
    "SELECT CAST(user_id AS DOUBLE) AS visual_user_id, CAST(value AS DOUBLE) AS visual_value, CAST(event_id % 2 = 0 AS DOUBLE) AS visual_even, CAST(coalesce(nullif(event_id % 3, 0), 0) AS DOUBLE) AS visual_more_rest FROM events",
)
_SCANNED = "concat(CASE WHEN p_partkey % 3 = 0 THEN replace(p_name, ' ', '\u2019') WHEN p_partkey % 3 = 1 THEN upper(p_name) ELSE p_name END, CASE p_partkey % 4 WHEN 0 THEN concat(' farfetch', chr(39), 'd BASIC 7 HP 60 gone') WHEN 1 THEN '  stage 1 mr. mime! x' WHEN 2 THEN ' ho-oh PS' ELSE '' END)"
add(
    "scan_names",
    of("part"),
    lambda df: df.select("p_partkey", text.clean_scan(F.expr(_SCANNED)).alias("name")),
    f"""WITH t AS (SELECT p_partkey, string_split(trim(regexp_replace(regexp_replace({_SCANNED}, '[^\\p{{L}}\\p{{N}}''\\-\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' ') AS w FROM part),
 k AS (SELECT p_partkey, CASE WHEN len(list_filter(w, lambda x: lower(x) IN ('hp', 'ps'))) > 0 THEN w[1:list_min(list_filter(range(1, len(w) + 1), lambda i: lower(w[i]) IN ('hp', 'ps'))) - 1] ELSE w END AS w FROM t),
 g AS (SELECT p_partkey, array_to_string(list_filter(w, lambda x: len(x) > 1 AND NOT regexp_full_match(x, '\\p{{N}}+') AND lower(x) NOT IN ('basic', 'stage', 'fase', 'etapa', 'basico', 'básico')), ' ') AS n FROM k)
 SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(n, '\\p{{L}}+|[^\\p{{L}}]+'), lambda r: upper(r[1]) || lower(r[2:])), '') AS name FROM g""",
)
add(
    "model_vector_defaults",
    captures,
    lambda df: flatten.model_inputs(df.withColumns({"blur": F.nullif("blur", F.lit(0.0)), "flag": F.col("weak"), "word": F.lit("x")}), ["contrast", "blur", "flag", "word", "missing"]).groupBy().agg(*(F.count_if(F.col(c) == 0).alias(f"zero_{c}") for c in ("contrast", "blur", "flag", "word", "missing")), math.rounded(F.sum("blur"), 3).alias("sum_blur")),
    f"WITH {CAPTURES_SQL} SELECT count(*) FILTER (contrast = 0) AS zero_contrast, count(*) FILTER (coalesce(nullif(blur, 0), 0) = 0) AS zero_blur, count(*) FILTER (NOT weak) AS zero_flag, count(*) AS zero_word, count(*) AS zero_missing, {rnd('sum(blur)', 3)} AS sum_blur FROM captures",
)
add(
    "null_policy",
    captures,
    lambda df: df.select(*KEYS, math.safe(F.when(F.col("blur") == 0, F.lit(float("inf"))).when(F.col("blur") == 8, F.lit(None)).when(F.col("blur") == 16, F.lit(float("nan"))).otherwise(F.col("blur"))).alias("served"), F.when(F.col("blur") > 16, F.col("blur")).alias("trained")),
    f"WITH {CAPTURES_SQL} SELECT {K}, CASE WHEN blur > 16 THEN blur ELSE 0.0::DOUBLE END AS served, CASE WHEN blur > 16 THEN blur END AS trained FROM captures",
)
_COUNT_BY_TRUTH = "SELECT y_true, count(*) AS count FROM labelled WHERE {} GROUP BY 1"
add("filter_strict", labelled, lambda df: df.where("y_true in (0, 1) and toxic = 0").groupBy("y_true").agg(F.count(F.lit(1)).alias("count")), f"WITH {LABELLED_SQL} " + _COUNT_BY_TRUTH.format("y_true IN (0, 1) AND toxic = 0"))
add("filter_fallback", labelled, lambda df: df.where("y_true in (0, 1) and lang = 'en' and y_prob > 0.1").groupBy("y_true").agg(F.count(F.lit(1)).alias("count")), f"WITH {LABELLED_SQL} " + _COUNT_BY_TRUTH.format("y_true IN (0, 1) AND lang = 'en' AND y_prob > 0.1"))


@query("filter_choice", f"WITH {LABELLED_SQL}, n AS (SELECT min(c) AS least, count(*) AS classes FROM (SELECT y_true, count(*) AS c FROM labelled WHERE toxic = 0 GROUP BY 1)) SELECT y_true, CASE WHEN least >= 20 AND classes = 2 THEN 'strict' ELSE 'loose' END AS filter, count(*) AS count FROM labelled, n WHERE CASE WHEN least >= 20 AND classes = 2 THEN toxic = 0 ELSE true END GROUP BY ALL")
def filter_choice(spark, d):
    rows, which = profiling.choose_rows(labelled(spark, d), "y_true", F.col("toxic") == 0, F.lit(True))
    return rows.groupBy("y_true").agg(F.lit(which).alias("filter"), F.count(F.lit(1)).alias("count"))


def _counts(df: DataFrame) -> DataFrame:
    return df.agg(*(F.count(c).alias(f"n_{c}") for c in df.columns))


@query("drop_empty_columns", f"WITH {CAPTURES_SQL} SELECT count(blur) AS n_blur, count(nullif(contrast, 10.0)) AS n_contrast FROM captures")
def drop_empty_columns(spark, d):
    return _counts(flatten.drop_empty(captures(spark, d).select("blur", F.nullif("contrast", F.lit(10.0)).alias("contrast"), F.lit(None).cast("double").alias("nothing"))))


add(
    "usable_name",
    of("part"),
    lambda df: df.select("p_partkey", text.usable_name(F.when(F.col("p_partkey") % 7 == 0, "HP").when(F.col("p_partkey") % 11 == 0, "a1234").otherwise(F.col("p_name"))).alias("usable")),
    "WITH n AS (SELECT p_partkey, trim(CASE WHEN p_partkey % 7 = 0 THEN 'HP' WHEN p_partkey % 11 = 0 THEN 'a1234' ELSE p_name END) AS t FROM part), c AS (SELECT *, len(regexp_extract_all(t, '\\p{L}')) AS l, len(regexp_extract_all(t, '\\p{Nd}')) AS g FROM n) SELECT p_partkey, len(t) >= 3 AND l >= 3 AND g <= greatest(2, l) AND lower(t) NOT IN ('pokemon', 'pokémon', 'basic', 'stage', 'fase', 'hp', 'gx', 'ex', 'v') AS usable FROM c",
)
add("numeric_coercion", of("events"), lambda df: df.select("event_id", F.concat(F.when(F.col("event_id") % 3 == 0, "x").otherwise(""), F.col("user_id").cast("string")).try_cast("double").alias("number")).where("number is not null"), "SELECT event_id, TRY_CAST(concat(CASE WHEN event_id % 3 = 0 THEN 'x' ELSE '' END, user_id) AS DOUBLE) AS number FROM events WHERE TRY_CAST(concat(CASE WHEN event_id % 3 = 0 THEN 'x' ELSE '' END, user_id) AS DOUBLE) IS NOT NULL")
add("first_values", of("customer"), lambda df: df.select("c_custkey", text.first_usable(F.when(F.col("c_custkey") % 2 == 0, " "), F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")), F.col("c_name")).alias("first_text"), text.first_number(F.when(F.col("c_custkey") % 2 == 0, F.lit("true")), F.when(F.col("c_custkey") % 5 == 0, F.lit("x")), F.col("c_acctbal").cast("string")).alias("first_number")), "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE c_name END AS first_text, c_acctbal AS first_number FROM customer")

# -- profiles and metrics --------------------------------------------------------------------------------------------------------
add("value_counts_nulls", of("customer"), lambda df: profiling.value_counts(df.select(F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment")), "segment"), "SELECT nullif(c_mktsegment, 'BUILDING') AS segment, count(*) AS count FROM customer GROUP BY 1")
add("distinct_values", of("part"), lambda df: df.select("p_brand").distinct(), "SELECT DISTINCT p_brand FROM part")
add("histogram_30", of("events"), lambda df: profiling.histogram(df, "value"), "WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events) SELECT CAST(least(floor((value - lo) / ((hi - lo) / 30.0::DOUBLE)), 29) AS BIGINT) AS bin, count(*) AS count FROM events, e GROUP BY 1")
_CELLS = f"WITH {LABELLED_SQL}, c AS (SELECT count(*) FILTER (y_true = 0 AND y_pred = 0) AS tn, count(*) FILTER (y_true = 0 AND y_pred = 1) AS fp, count(*) FILTER (y_true = 1 AND y_pred = 0) AS fn, count(*) FILTER (y_true = 1 AND y_pred = 1) AS tp FROM labelled)"
add("confusion_matrix", labelled, profiling.confusion, f"{_CELLS} SELECT * FROM c")


def _all_rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(*(math.rounded(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


_M = "tp::DOUBLE / nullif(tp + fp, 0)", "tp::DOUBLE / nullif(tp + fn, 0)", "tn::DOUBLE / nullif(tn + fp, 0)"
add(
    "binary_metrics",
    labelled,
    lambda df: _all_rounded(profiling.binary_metrics(profiling.confusion(df))),
    f"{_CELLS}, m AS (SELECT *, coalesce({_M[0]}, 0) AS p, coalesce({_M[1]}, 0) AS r, coalesce({_M[2]}, 0) AS s FROM c) SELECT {rnd('(tp + tn)::DOUBLE / (tn + fp + fn + tp)', 9)} AS accuracy, {rnd('(r + s) / 2', 9)} AS balanced_accuracy, {rnd('p', 9)} AS precision, {rnd('r', 9)} AS recall, {rnd('coalesce(2 * p * r / nullif(p + r, 0), 0)', 9)} AS f1 FROM m",
)
_REPORT = f"""{_CELLS}, a AS (SELECT '0' AS label, coalesce(tn::DOUBLE / nullif(tn + fn, 0), 0) AS p, coalesce(tn::DOUBLE / nullif(tn + fp, 0), 0) AS r, tn + fp AS n FROM c
 UNION ALL SELECT '1', coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), tp + fn FROM c), b AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f FROM a),
 w AS (SELECT * FROM b UNION ALL SELECT 'macro avg', avg(p), avg(r), sum(n), avg(f) FROM b UNION ALL SELECT 'weighted avg', sum(p * n) / sum(n), sum(r * n) / sum(n), sum(n), sum(f * n) / sum(n) FROM b)
 SELECT label, {rnd('p', 9)} AS precision, {rnd('r', 9)} AS recall, {rnd('f', 9)} AS f1, CAST(n AS BIGINT) AS support FROM w"""
add("class_report", labelled, lambda df: _all_rounded(profiling.class_report(profiling.confusion(df))), _REPORT)

_HASH = "((event_id * 2654435761 + 42) % 1000003)"
_SPLIT = f"WITH h AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY {_HASH}, event_id) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events), s AS (SELECT event_id, event_type, CASE WHEN r < floor(n * 0.8) THEN 'train' ELSE 'test' END AS split, CAST(r % 5 AS BIGINT) AS fold FROM h)"


def split_events(spark: SparkSession, d: str) -> DataFrame:
    return profiling.stratified(table(spark, d, "events").select("event_id", "event_type"), "event_id", "event_type")


add("stratified_split", split_events, lambda df: df.select("event_id", "split"), f"{_SPLIT} SELECT event_id, split FROM s")
add("kfold_assign", split_events, lambda df: df.select("event_id", "fold"), f"{_SPLIT} SELECT event_id, fold FROM s")
add("split_class_counts", split_events, lambda df: df.groupBy("split", "event_type").agg(F.count(F.lit(1)).alias("count")), f"{_SPLIT} SELECT split, event_type, count(*) AS count FROM s GROUP BY 1, 2")
add("median_impute", of("events"), lambda df: profiling.median_filled(df.select("event_id", F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("value")), ["value"]).select("event_id", math.rounded("value", 9).alias("value")), f"WITH v AS (SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN value END AS value FROM events) SELECT event_id, {rnd('coalesce(value, (SELECT median(value) FROM v))', 9)} AS value FROM v")
add("percentile_90", of("events"), lambda df: profiling.quantiles(df, ["event_type"], "value", 0.9).select("event_type", math.rounded("quantile", 6).alias("p90")), f"SELECT event_type, {rnd('quantile_cont(value, 0.9)', 6)} AS p90 FROM events GROUP BY 1")
add("dataset_shape", of("lineitem"), lambda df: df.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).cast("bigint").alias("columns")), "SELECT count(*) AS rows, 11::BIGINT AS columns FROM lineitem")
# three models of fixed scores, each with its own threshold, over five folds
_CV = {"strict": 700, "even": 500, "loose": 300}
_CV_SQL = f"""WITH {LABELLED_SQL},
p AS (SELECT m.model, doc_id % 5 AS fold, y_true AS t, CASE WHEN y_prob >= m.cut / 1000::DOUBLE THEN 1 ELSE 0 END AS y FROM labelled, (VALUES {', '.join(f"('{m}', {c})" for m, c in _CV.items())}) AS m(model, cut)),
c AS (SELECT model, fold, count(*) FILTER (t = 0 AND y = 0)::DOUBLE AS tn, count(*) FILTER (t = 0 AND y = 1)::DOUBLE AS fp, count(*) FILTER (t = 1 AND y = 0)::DOUBLE AS fn, count(*) FILTER (t = 1 AND y = 1)::DOUBLE AS tp FROM p GROUP BY ALL),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END AS other FROM c),
f AS (SELECT model, fold, (tp + tn) / (tn + fp + fn + tp) AS accuracy, (recall + other) / 2 AS balanced_accuracy, precision, recall, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM r),
a AS (SELECT model, avg(accuracy) AS accuracy, avg(balanced_accuracy) AS balanced_accuracy, avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1 FROM f GROUP BY 1),
k AS (SELECT *, CAST(row_number() OVER (ORDER BY f1 DESC, recall DESC, balanced_accuracy DESC, model) AS INT) AS rank FROM a)"""


def _fold_metrics(df: DataFrame) -> DataFrame:
    models = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.lit(c / 1000.0).alias("cut")) for m, c in _CV.items())))
    p = df.select((F.col("doc_id") % 5).alias("fold"), F.col("y_true").alias("target"), "y_prob", models.alias("m"))
    return profiling.validated(p.select("fold", "target", F.col("m.model").alias("model"), (F.col("y_prob") >= F.col("m.cut")).cast("int").alias("y_pred")))


add(
    "cv_means",
    labelled,
    lambda df: _fold_metrics(df).groupBy("model").agg(*(math.rounded(F.avg(m), 9).alias(m) for m in profiling.METRICS)),
    f"{_CV_SQL} SELECT model, {', '.join(f'{rnd(m, 9)} AS {m}' for m in profiling.METRICS)} FROM a",
)
add(
    "model_ranking",
    labelled,
    lambda df: profiling.ranked_models(_fold_metrics(df)).select("rank", "model", *(math.rounded(m, 9).alias(m) for m in ("f1", "recall"))),
    f"{_CV_SQL} SELECT rank, model, {rnd('f1', 9)} AS f1, {rnd('recall', 9)} AS recall FROM k",
)

# -- matching, lookups, prices -----------------------------------------------------------------------------------------------------


@query(
    "best_candidate",
    """WITH q AS (SELECT p_partkey AS query_id, p_name AS q_name, CASE WHEN p_partkey % 20 = 0 THEN p_brand ELSE '' END AS q_set, CASE WHEN p_partkey % 30 = 0 THEN CAST(p_size AS VARCHAR) ELSE '' END AS q_number FROM part),
 c AS (SELECT p_partkey AS id, p_name AS name, p_brand AS set_name, CAST(p_size AS VARCHAR) AS number FROM part),
 s AS (SELECT query_id, id, name, CASE WHEN lower(trim(name)) = lower(trim(q_name)) THEN 10 WHEN contains(lower(name), lower(trim(q_name))) THEN 5 ELSE 0 END + CASE WHEN q_set = '' THEN 0 WHEN lower(set_name) = lower(q_set) THEN 6 WHEN contains(lower(set_name), lower(q_set)) THEN 3 ELSE 0 END + CASE WHEN q_number = '' THEN 0 WHEN number = q_number THEN 6 WHEN contains(number, q_number) OR contains(q_number, number) THEN 3 ELSE 0 END AS score FROM q JOIN c ON contains(lower(trim(name)), lower(trim(q_name))))
 SELECT query_id, id, name, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) = 1""",
)
def best_candidate(spark, d):
    return candidates(spark, d)


def candidates(spark: SparkSession, d: str, *keep: str) -> DataFrame:
    """The best catalogue row for each part, with its columns ``keep``."""
    part = table(spark, d, "part")
    number = F.col("p_size").cast("string")
    asked = part.select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("q_name"), F.when(F.col("p_partkey") % 20 == 0, F.col("p_brand")).otherwise("").alias("q_set"), F.when(F.col("p_partkey") % 30 == 0, number).otherwise("").alias("q_number"))
    return ranking.best_candidate(asked, part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("set_name"), number.alias("number"), *keep), keep)


@query(
    "fuzzy_rank",
    """WITH s AS (SELECT p_brand, p_partkey, p_name, p_type, 1.0::DOUBLE - levenshtein(p_type, p_name) / greatest(len(p_type), len(p_name), 1) AS sim, (SELECT count(*) FROM range(1, least(len(p_type), len(p_name)) + 1) t(k) WHERE p_type[1:k] = p_name[1:k]) AS pre FROM part)
 SELECT p_brand, p_partkey, floor(sim * 1000000::DOUBLE + 0.5::DOUBLE) / 1000000::DOUBLE AS similarity, CAST(pre AS INT) AS prefix, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY sim DESC, pre DESC, -abs(len(p_type) - len(p_name)) DESC, p_partkey) AS INT) AS rank FROM s""",
)
def fuzzy_rank(spark, d):
    return ranking.fuzzy_rank(table(spark, d, "part"), "p_type", "p_name", "p_partkey", ["p_brand"]).select("p_brand", "p_partkey", math.rounded("similarity", 6).alias("similarity"), "prefix", "rank")


_ACC = f"translate(lower(text), '{text.ACCENTED}', '{text.PLAIN}')"
add("name_normalise", of("documents"), lambda df: df.select("doc_id", text.normal_name("text").alias("name")), f"SELECT doc_id, trim(regexp_replace(regexp_replace({_ACC}, '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS name FROM documents")
add(
    "fallback_queries",
    of("part"),
    lambda df: df.select("p_partkey", F.posexplode(text.search_queries(text.normal_name("p_name"))).alias("n", "q")).select("p_partkey", "n", "q"),
    """WITH n AS (SELECT p_partkey, trim(regexp_replace(lower(p_name), '\\s+', ' ', 'g')) AS name FROM part), w AS (SELECT *, string_split(name, ' ')[1] AS a, string_split(name, ' ')[2] AS b FROM n),
 l AS (SELECT p_partkey, list_filter(list_concat([name, a], CASE WHEN len(a) >= 5 THEN list_transform(range(least(len(a), 14), 4, -1), lambda k: a[1:k]) ELSE [] END, CASE WHEN b IS NOT NULL THEN [a || ' ' || b] ELSE [] END), lambda q: len(q) >= 4) AS qs FROM w),
 u AS (SELECT p_partkey, unnest(qs) AS q, unnest(range(len(qs))) AS k FROM l), f AS (SELECT p_partkey, q, min(k) AS k FROM u GROUP BY 1, 2) SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY k) - 1 AS INT) AS n, q FROM f""",
)
add("dedupe_first", of("events"), lambda df: ranking.keep_first(df.select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id"), "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")


@query("union_first", "WITH u AS (SELECT 0 AS part, user_id, event_id FROM events WHERE event_type = 'click' UNION ALL SELECT 1, user_id, event_id FROM events) SELECT user_id, event_id, part FROM u QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY part, event_id) = 1")
def union_first(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    return ranking.union_first([e.where("event_type = 'click'").drop("event_type"), e.drop("event_type")], "user_id", "event_id").select("user_id", "event_id", "part")


add("early_stop_union", of("events"), lambda df: ranking.stop_early(df.select("user_id", "event_id", F.dayofmonth("ts").alias("query")), "query", 10, ["user_id"]).select("user_id", "query", "event_id"), "WITH e AS (SELECT user_id, event_id, CAST(day(ts) AS INT) AS query FROM events), n AS (SELECT user_id, query, count(*) AS c FROM e GROUP BY 1, 2), a AS (SELECT *, coalesce(sum(c) OVER (PARTITION BY user_id ORDER BY query ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM n) SELECT user_id, query, event_id FROM e JOIN a USING (user_id, query) WHERE ahead < 10")


@query("dim_lookup_default", "SELECT s_suppkey, coalesce(n_name, 'gray') AS n_name FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 3 <> 0) ON n_nationkey = s_nationkey")
def dim_lookup_default(spark, d):
    nation = table(spark, d, "nation").where("n_nationkey % 3 <> 0").withColumnRenamed("n_nationkey", "s_nationkey")
    return ranking.with_default(table(spark, d, "supplier"), nation, "s_nationkey", "n_name", "gray").select("s_suppkey", "n_name")


@query("detail_fallback", "SELECT o_orderkey, coalesce(c.c_name, 'search row') AS name, coalesce(c.c_acctbal, o_totalprice) AS amount FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 4 <> 0) c ON c_custkey = o_custkey")
def detail_fallback(spark, d):
    own = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("id"), F.lit("search row").alias("name"), F.col("o_totalprice").alias("amount"))
    detail = table(spark, d, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("amount"))
    return ranking.detailed(own, detail, "id", ["name", "amount"]).select("o_orderkey", "name", "amount")


_RATES = (("EUR", "USD", 1.25), ("EUR", "MXN", 20.5), ("EUR", "COP", 4100.0), ("USD", "EUR", 0.8))


@query("fx_convert", f"WITH r AS (SELECT * FROM (VALUES {', '.join(f'({chr(39)}{a}{chr(39)}, {chr(39)}{b}{chr(39)}, {c}::DOUBLE)' for a, b, c in _RATES)}) AS t(base, target, rate)) SELECT p_partkey, target, p_retailprice * rate AS value FROM part JOIN r ON base = CASE WHEN p_partkey % 2 = 0 THEN 'EUR' ELSE 'USD' END")
def fx_convert(spark, d):
    amounts = table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("amount"), F.when(F.col("p_partkey") % 2 == 0, "EUR").otherwise("USD").alias("currency"))
    return pricing.converted(amounts, spark.createDataFrame(_RATES, "base string, target string, rate double")).select("p_partkey", "target", "value")


_BAND_SQL = "CASE WHEN x >= 9.5 THEN 'mint' WHEN x >= 8.5 THEN 'near_mint' WHEN x >= 7 THEN 'lightly_played' WHEN x >= 5 THEN 'moderately_played' WHEN x >= 3 THEN 'heavily_played' ELSE 'damaged' END"
_FACTOR_SQL = "CASE band WHEN 'mint' THEN 1.0::DOUBLE WHEN 'near_mint' THEN 0.95::DOUBLE WHEN 'lightly_played' THEN 0.85::DOUBLE WHEN 'moderately_played' THEN 0.7::DOUBLE WHEN 'heavily_played' THEN 0.5::DOUBLE ELSE 0.3::DOUBLE END"


def _prices(df: DataFrame) -> DataFrame:
    price, key = F.col("p_retailprice"), F.col("p_partkey")
    base = pricing.price_base([F.when(key % 3 == 0, price)], [F.when(key % 3 == 1, price), F.when(key % 5 == 0, price * 2.0)], F.when(key % 4 != 0, F.lit(20.5)))
    d = df.withColumns(base)
    score = 1.0 + F.pmod(key, F.lit(91)).cast("double") / 10.0
    return d.select("p_partkey", "base_price", "base_currency", *(c.alias(n) for n, c in pricing.priced(F.col("base_price"), score, F.when(key % 7 == 0, F.lit(9.0))).items()))


add(
    "price_strategy",
    of("part"),
    _prices,
    f"WITH q AS (SELECT p_partkey, 1.0::DOUBLE + (p_partkey % 91)::DOUBLE / 10.0::DOUBLE AS x, CASE WHEN p_partkey % 3 = 0 THEN p_retailprice END AS usd, coalesce(CASE WHEN p_partkey % 3 = 1 THEN p_retailprice END, CASE WHEN p_partkey % 5 = 0 THEN p_retailprice * 2 END) AS eur, CASE WHEN p_partkey % 4 <> 0 THEN 20.5::DOUBLE END AS rate FROM part), b AS (SELECT *, coalesce(usd, eur * rate, eur) AS base_price, CASE WHEN usd IS NOT NULL THEN 'USD' WHEN eur * rate IS NOT NULL THEN 'MXN' WHEN eur IS NOT NULL THEN 'EUR' END AS base_currency, {_BAND_SQL} AS band FROM q), s AS (SELECT *, coalesce(CASE WHEN p_partkey % 7 = 0 THEN 9.0::DOUBLE END, base_price * {_FACTOR_SQL}) AS sale_price FROM b) SELECT p_partkey, base_price, base_currency, band, sale_price, sale_price * 0.75::DOUBLE AS buy_price FROM s",
)
add("condition_band", scored, lambda df: df.groupBy(rules.condition_band("s_edge").alias("band")).agg(F.count(F.lit(1)).alias("count")), f"{SCORED_SQL}, f AS (SELECT s_edge AS x FROM scored) SELECT {_BAND_SQL} AS band, count(*) AS count FROM f GROUP BY 1")


@query("anti_banned", "SELECT p_partkey, p_brand FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_partkey % 100 = 0)")
def anti_banned(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_brand")
    return part.join(part.where("p_partkey % 100 = 0").select("p_brand").distinct(), "p_brand", "left_anti").select("p_partkey", "p_brand")


@query("union_missing_columns", "SELECT event_id AS id, event_type, NULL::VARCHAR AS status FROM events UNION ALL SELECT o_orderkey, NULL, o_orderstatus FROM orders")
def union_missing_columns(spark, d):
    a = table(spark, d, "events").select(F.col("event_id").alias("id"), "event_type")
    return a.unionByName(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")), allowMissingColumns=True)


add("ttl_filter", of("events"), lambda df: pricing.live_rates(df.select("event_id", F.col("ts").alias("fetched_at")), F.lit("2024-01-10 00:00:00").cast("timestamp")).select("event_id"), "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-10 00:00:00' - INTERVAL 6 HOURS")
add(
    "variant_pick",
    of("part"),
    lambda df: df.select("p_partkey", ranking.richest_variant(F.create_map(F.lit("holo"), F.create_map(F.lit("a"), F.when(F.col("p_partkey") % 2 == 0, 1.0), F.lit("b"), F.when(F.col("p_partkey") % 3 == 0, 1.0)), F.lit("plain"), F.create_map(F.lit("a"), F.when(F.col("p_partkey") % 5 == 0, 1.0), F.lit("b"), F.lit(2.0))), ["plain", "holo", "foil"]).alias("variant")),
    "SELECT p_partkey, CASE WHEN (p_partkey % 2 = 0)::INT + (p_partkey % 3 = 0)::INT > 1 + (p_partkey % 5 = 0)::INT THEN 'holo' ELSE 'plain' END AS variant FROM part",
)
add(
    "json_fields",
    of("events"),
    lambda df: df.select("event_id", text.field(text.json_object(F.concat(F.lit("```json "), F.col("props"), F.lit(" ```"))), "$.absent", "$.k").alias("k"), text.safe_confidence(F.concat(F.lit(""), (F.col("event_id") % 3 - 0.5).cast("string"))).alias("confidence")),
    "SELECT event_id, json_extract_string(props, '$.k') AS k, least(greatest((event_id % 3)::DOUBLE - 0.5::DOUBLE, 0::DOUBLE), 1::DOUBLE) AS confidence FROM events",
)

# -- profiles as arrays --------------------------------------------------------------------------------------------------------------
_MEAN, _STD = "list_sum(p) / len(p)", "sqrt(list_sum(list_transform(p, lambda x: (x - m) * (x - m))) / len(p))"
_P = f"WITH {PROFILES_SQL}, a AS (SELECT vec_id, p, {_MEAN} AS m FROM profiles), b AS (SELECT *, {_STD} AS s FROM a)"
_MA = "list_transform(range(1, len(p) + 1), lambda k: list_sum(p[greatest(k - 5, 1):least(k + 5, len(p))]) / 11.0::DOUBLE)"
add("profile_stats", profiles, lambda df: df.select("vec_id", F.array_min("p").alias("least"), F.array_max("p").alias("most"), math.rounded(arrays.mean("p"), 6).alias("mean"), math.rounded(arrays.deviation("p"), 6).alias("std")), f"{_P} SELECT vec_id, list_min(p) AS least, list_max(p) AS most, {rnd('m', 6)} AS mean, {rnd('s', 6)} AS std FROM b")
add("profile_argmax", profiles, lambda df: df.select("vec_id", arrays.argmax("p").cast("bigint").alias("top"), arrays.argmin("p").cast("bigint").alias("bottom"), arrays.window_peak("p", 0.25, 0.75).alias("peak")), f"{_P} SELECT vec_id, CAST(list_position(p, list_max(p)) - 1 AS BIGINT) AS top, CAST(list_position(p, list_min(p)) - 1 AS BIGINT) AS bottom, list_max(p[17:48]) AS peak FROM b")
add("profile_above_threshold", profiles, lambda df: df.select("vec_id", arrays.share_above("p", arrays.adaptive_limit("p", 0.05, 1.2)).alias("share")), f"{_P} SELECT vec_id, len(list_filter(p, lambda x: x > greatest(0.05::DOUBLE, m + 1.2::DOUBLE * s))) / len(p) AS share FROM b")
add("profile_moving_avg", profiles, lambda df: df.select("vec_id", math.rounded(arrays.total(F.transform(arrays.moving_average("p"), lambda x: F.abs(x))), 5).alias("size")), f"{_P} SELECT vec_id, {rnd(f'list_sum(list_transform({_MA}, lambda x: abs(x)))', 5)} AS size FROM b")
add("profile_roughness", profiles, lambda df: df.select("vec_id", math.rounded(arrays.deviation(arrays.differences("p")), 5).alias("roughness")), f"WITH {PROFILES_SQL}, d AS (SELECT vec_id, list_transform(range(2, len(p) + 1), lambda k: p[k] - p[k - 1]) AS p FROM profiles), a AS (SELECT *, {_MEAN} AS m FROM d) SELECT vec_id, {rnd(_STD, 5)} AS roughness FROM a")
add("profile_residual", profiles, lambda df: df.select("vec_id", math.rounded(arrays.total(arrays.residual("p")), 5).alias("residual")), f"{_P}, r AS (SELECT vec_id, p, {_MA} AS q FROM b) SELECT vec_id, {rnd('list_sum(list_transform(range(1, len(p) + 1), lambda k: abs(p[k] - q[k])))', 5)} AS residual FROM r")
add(
    "longest_run",
    profiles,
    lambda df: df.select("vec_id", arrays.longest_run("p", 0.02).cast("bigint").alias("longest")),
    f"WITH {PROFILES_SQL}, e AS (SELECT vec_id, unnest(p) AS x, unnest(range(len(p))) AS k FROM profiles), g AS (SELECT vec_id, k - row_number() OVER (PARTITION BY vec_id ORDER BY k) AS island FROM e WHERE x > 0.02), n AS (SELECT vec_id, max(c) AS longest FROM (SELECT vec_id, island, count(*) AS c FROM g GROUP BY 1, 2) GROUP BY 1) SELECT vec_id, coalesce(longest, 0) AS longest FROM profiles LEFT JOIN n USING (vec_id)",
)


# -- boxes and quads -------------------------------------------------------------------------------------------------------------------
def _boxes(df: DataFrame) -> DataFrame:
    q, p, s = F.col("l_quantity"), (F.col("l_partkey") % 40).cast("double"), (F.col("l_suppkey") % 30).cast("double")
    a, b = (F.lit(0.0), F.lit(0.0), q, q + 10.0), (p, s, p + 20.0, s + 25.0)
    x, y = math.centre(b)
    return df.select(*KEYS, math.rounded(math.iou(a, b), 6).alias("iou"), x.alias("cx"), y.alias("cy"), math.rounded(math.box_area(math.clip_box(math.expand_box(b, 0.1), 50, 50)), 6).alias("clipped"))


_AREA = "greatest(0::DOUBLE, {2} - {0}) * greatest(0::DOUBLE, {3} - {1})"
_CUT = _AREA.format("greatest(0::DOUBLE, p)", "greatest(0::DOUBLE, s)", "least(q, p + 20::DOUBLE)", "least(q + 10::DOUBLE, s + 25::DOUBLE)")
_CLIP = _AREA.format(*(f"least(greatest({v}, 0::DOUBLE), 50::DOUBLE)" for v in ("(p - ((p + 20::DOUBLE) - p) * 0.1::DOUBLE)", "(s - ((s + 25::DOUBLE) - s) * 0.1::DOUBLE)", "(p + 20::DOUBLE + ((p + 20::DOUBLE) - p) * 0.1::DOUBLE)", "(s + 25::DOUBLE + ((s + 25::DOUBLE) - s) * 0.1::DOUBLE)")))
_BOX = "WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS q, (l_partkey % 40)::DOUBLE AS p, (l_suppkey % 30)::DOUBLE AS s FROM lineitem)"
add("bbox_iou", of("lineitem"), _boxes, f"{_BOX}, c AS (SELECT *, {_CUT} AS i FROM b) SELECT {K}, {rnd('CASE WHEN abs(q * (q + 10::DOUBLE) + 20::DOUBLE * 25::DOUBLE - i) <= 1e-6 THEN 0 ELSE i / (q * (q + 10::DOUBLE) + 20::DOUBLE * 25::DOUBLE - i) END', 6)} AS iou, (p + (p + 20::DOUBLE)) / 2::DOUBLE AS cx, (s + (s + 25::DOUBLE)) / 2::DOUBLE AS cy, {rnd(_CLIP, 6)} AS clipped FROM c")


def _quads(df: DataFrame) -> DataFrame:
    q, p, s = F.col("l_quantity"), (F.col("l_partkey") % 10).cast("double"), (F.col("l_suppkey") % 8).cast("double")
    quad = ((F.lit(0.0), F.lit(0.0)), (q + 60.0, p), (q + 55.0 + s, 90.0 + p), (s, F.lit(95.0)))
    point = F.array(*(F.struct(math.num(x).alias("x"), math.num(y).alias("y")) for x, y in (quad[2], quad[0], quad[3], quad[1])))
    return df.select(*KEYS, math.rounded(math.quad_area(quad), 6).alias("area"), math.rounded(math.quad_aspect(quad), 6).alias("aspect"), math.rounded(math.corner_angle(quad[3], quad[0], quad[1]), 4).alias("angle"), F.element_at(math.ordered_points(point), 2)["x"].alias("tr_x"), math.rounded(math.line_angle_gap(q * 7.0, p * 30.0), 6).alias("gap"))


_Q = "WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS q, (l_partkey % 10)::DOUBLE AS p, (l_suppkey % 8)::DOUBLE AS s FROM lineitem), c AS (SELECT *, 0::DOUBLE AS x1, 0::DOUBLE AS y1, q + 60 AS x2, p AS y2, q + 55 + s AS x3, 90 + p AS y3, s AS x4, 95::DOUBLE AS y4 FROM b)"
_D = "sqrt(({0} - {2}) * ({0} - {2}) + ({1} - {3}) * ({1} - {3}))"
_SIDES = [_D.format(*x) for x in (("x1", "y1", "x2", "y2"), ("x2", "y2", "x3", "y3"), ("x3", "y3", "x4", "y4"), ("x4", "y4", "x1", "y1"))]
add(
    "quad_metrics",
    of("lineitem"),
    _quads,
    f"{_Q} SELECT {K}, {rnd('abs(x1 * y2 - x2 * y1 + (x2 * y3 - x3 * y2) + (x3 * y4 - x4 * y3) + (x4 * y1 - x1 * y4)) / 2', 6)} AS area, {rnd(f'greatest(1, ({_SIDES[0]} + {_SIDES[2]}) / 2) / greatest(1, ({_SIDES[1]} + {_SIDES[3]}) / 2)', 6)} AS aspect, {rnd('degrees(acos((x4 * x2 + y4 * y2) / (sqrt(x4 * x4 + y4 * y4) * sqrt(x2 * x2 + y2 * y2))))', 4)} AS angle, x2 AS tr_x, {rnd('least(abs(q * 7 - p * 30) % 180, 180 - abs(q * 7 - p * 30) % 180)', 6)} AS gap FROM c",
)


# -- catalogue scans, readings and prices -----------------------------------------------------------------------------------------------
_ASKED = ((1, "green"), (2, " LEMON "), (3, ""), (4, None), (5, "a"), (6, "ee"), (7, "no such name"), (8, "small"))
_ASKED_SQL = ", ".join(f"({n}, {'NULL' if q is None else chr(39) + q + chr(39)})" for n, q in _ASKED)


@query("catalogue_search", f"SELECT query_id, p_partkey AS id, p_name AS name FROM (VALUES {_ASKED_SQL}) AS t(query_id, q) JOIN part ON trim(q) <> '' AND contains(lower(trim(p_name)), lower(trim(q)))")
def catalogue_search(spark, d):
    names = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return ranking.search(spark.createDataFrame(_ASKED, "query_id int, q_name string"), names)


@query("catalogue_exact", "SELECT min(p_partkey) OVER (PARTITION BY p_name) AS query_id, p_partkey AS id FROM part WHERE trim(p_name) <> ''")
def catalogue_exact(spark, d):
    part = table(spark, d, "part")
    one = part.groupBy("p_name").agg(F.min("p_partkey").alias("query_id"))  # a query for each name, so that no name's parts meet in pairs
    asked = one.select("query_id", F.concat(F.lit(" "), "p_name", F.lit(" ")).alias("q_name"))
    return ranking.search(asked, part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), exact=True).select("query_id", "id")


add("catalogue_lists", of("part"), lambda df: ranking.listing(df, "p_brand", "p_type", "p_size"), " UNION ALL ".join(f"SELECT '{c}' AS kind, CAST({c} AS VARCHAR) AS value, count(*) AS cards FROM part WHERE {c} IS NOT NULL GROUP BY 2" for c in ("p_brand", "p_type", "p_size")))

_PRICED = """CASE p_partkey % 8 WHEN 0 THEN '{"cardmarket": {"trend": 1.5, "low": "x", "normal": {"trend": 9}}}'
 WHEN 1 THEN '{"cardmarket": {"normal": {"trend": 1, "low": null}, "holo": {"trend": 2, "avg7": 3}}, "tcgplayer": {"holo": {"marketPrice": 4}}}'
 WHEN 2 THEN '{"cardmarket": {"reverse": {"trend": 1}, "holo": {"avg30": 2}}, "tcgplayer": 5}' WHEN 3 THEN '{"cardmarket": {"normal": {"trend": ""}, "holo": {"low": 7}}}'
 WHEN 4 THEN '{"tcgplayer": {"n": 1, "foil": {"lowPrice": 5}}, "cardmarket": {}}' WHEN 5 THEN '{"cardmarket": {"normal": {}, "other": {"low": 6}}}' WHEN 6 THEN '{}' END"""


def _market_sql(market: str) -> str:
    b, preferred = f"json_extract(j, '$.{market}')", pricing.MARKETS[market][2]
    n = [f"CASE WHEN json_type({b}, '$.{v}') = 'OBJECT' THEN len(list_filter(json_keys({b}, '$.{v}'), lambda k: coalesce(json_extract_string(j, '$.{market}.{v}.' || k), '') <> '')) ELSE -1 END" for v in preferred]
    most = f"greatest({', '.join(n)})"
    best = f"CASE WHEN {most} < 0 THEN NULL " + " ".join(f"WHEN {x} = {most} THEN json_extract({b}, '$.{v}')" for x, v in zip(n, preferred, strict=True)) + " END"
    first = f"json_extract({b}, '$.' || list_filter(json_keys({b}), lambda k: json_type(j, '$.{market}.' || k) = 'OBJECT')[1])"
    direct = ", ".join(f"'{f}'" for f in pricing.DIRECT_FIELDS)
    return f"CASE WHEN json_type({b}) <> 'OBJECT' THEN NULL WHEN list_has_any(json_keys({b}), [{direct}]) THEN {b} WHEN len(json_keys({best})) > 0 THEN {best} WHEN len(json_keys({first})) > 0 THEN {first} END"


@query(
    "market_prices",
    f"WITH s AS (SELECT p_partkey, CAST({_PRICED} AS JSON) AS j FROM part), b AS (SELECT p_partkey, {_market_sql('cardmarket')} AS c, {_market_sql('tcgplayer')} AS t FROM s) SELECT p_partkey, CASE WHEN c IS NOT NULL THEN 'EUR' END AS c_currency, "
    + ", ".join(f"TRY_CAST(json_extract_string({m[0]}, '$.{f}') AS DOUBLE) AS {f}" for m, (_, fields, _) in pricing.MARKETS.items() for f in fields) + ", CASE WHEN t IS NOT NULL THEN 'USD' END AS t_currency FROM b",
)
def market_prices(spark, d):
    found = pricing.market_prices(F.expr(_PRICED))
    one = table(spark, d, "part").select("p_partkey", *(c.alias(m) for m, c in found.items()))
    fields = (F.col(f"{m}.{f}").alias(f) for m, (_, names, _) in pricing.MARKETS.items() for f in names)
    return one.select("p_partkey", F.col("cardmarket.currency").alias("c_currency"), *fields, F.col("tcgplayer.currency").alias("t_currency"))


add("fx_rates", of("part"), lambda df: df.select("p_partkey", F.explode(text.numbers_only(F.create_map(F.lit("usd"), F.col("p_retailprice").cast("string"), F.lit("eur"), F.col("p_name"), F.lit("mxn"), F.lit(None).cast("string")))).alias("currency", "rate")), "SELECT p_partkey, 'USD' AS currency, p_retailprice AS rate FROM part")
add(
    "scan_confidence",
    of("part"),
    lambda df: df.select("p_partkey", F.transform(F.split(F.concat("p_name", F.lit("  x")), " "), lambda w, k: F.struct(w.alias("text"), (F.pmod(F.col("p_partkey") * 7 + k * 13, F.lit(60)) - 45).alias("conf"))).alias("t")).select("p_partkey", text.token_text("t").alias("text"), math.rounded(text.token_confidence("t"), 6).alias("confidence")),
    f"WITH w AS (SELECT p_partkey, string_split(p_name || '  x', ' ') AS w FROM part), t AS (SELECT p_partkey, unnest(w) AS w, unnest(range(len(w))) AS k FROM w), c AS (SELECT *, (p_partkey * 7 + k * 13) % 60 - 45 AS c FROM t WHERE w <> '') SELECT p_partkey, string_agg(w, ' ' ORDER BY k) AS text, {rnd('coalesce(avg(c) FILTER (c >= 0), -1.0::DOUBLE)', 6)} AS confidence FROM c GROUP BY 1",
)
add(
    "best_reading",
    of("part"),
    lambda df: ranking.best_reading(df.select("p_brand", F.concat("p_name", F.lit(" "), F.col("p_partkey") % 100).alias("text"), (F.col("p_size") % 5).alias("confidence"), F.col("p_partkey").alias("n")), ["p_brand"]).select("p_brand", "n", "text"),
    "WITH r AS (SELECT p_brand, p_partkey AS n, p_name || ' ' || p_partkey % 100 AS text, p_size % 5 AS confidence FROM part), s AS (SELECT *, len(regexp_extract_all(text, '\\p{L}')) AS letters, len(regexp_extract_all(text, '\\p{Nd}')) AS digits, len(replace(text, ' ', '')) AS size FROM r) SELECT p_brand, n, text FROM s QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY confidence DESC, letters / greatest(size, 1) DESC, digits, size, n) = 1",
)
_SHOWN = ("analysis_status", *KEYS, "invalid_reasons")


def _samples(df: DataFrame) -> DataFrame:
    return ranking.samples(df, F.col("usable_for_condition_model"), _SHOWN).unionByName(ranking.samples(df, F.col("analysis_status") == "invalid_capture", _SHOWN))


add("sample_rows", judged, _samples, f"{STATUS_SQL} (SELECT {', '.join(_SHOWN)} FROM status WHERE analysis_status = 'valid' ORDER BY ALL LIMIT 5) UNION ALL (SELECT {', '.join(_SHOWN)} FROM status WHERE analysis_status = 'invalid_capture' ORDER BY ALL LIMIT 5)")
add(
    "status_report",
    judged,
    lambda df: profiling.counts_map(df.withColumn("s", F.nullif("analysis_status", F.lit("valid"))), "s").select(F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("report"), "nulls"),
    f"{STATUS_SQL}, n AS (SELECT nullif(analysis_status, 'valid') AS s, count(*) AS c FROM status GROUP BY 1) SELECT string_agg(s || '=' || c, ',' ORDER BY s) AS report, CAST(coalesce(sum(c) FILTER (s IS NULL), 0) AS BIGINT) AS nulls FROM n",
)
_M = {k: "'" + v + "'" for k, v in rules.CAPTURE_MESSAGES.items()}
add(
    "capture_message",
    scored,
    lambda df: df.select(*KEYS, rules.capture_message("used_fallback", "coverage", "aspect", "s_capture").alias("message")),
    f"{SCORED_SQL} SELECT {K}, CASE WHEN used_fallback THEN {_M['fallback']} WHEN coverage > 0.95 THEN {_M['close']} WHEN aspect BETWEEN 0.65 AND 0.78 AND coverage >= 0.35 AND s_capture >= 7 THEN {_M['buena']} WHEN aspect BETWEEN 0.65 AND 0.78 AND coverage >= 0.22 AND s_capture >= 5 THEN {_M['mejorable']} ELSE {_M['deficiente']} END AS message FROM scored",
)


def _peaks_sql(most: int, distance: int) -> str:
    """Each step takes the greatest element that is left and blanks out what is near."""
    steps = ["s0 AS (SELECT vec_id, p, [] AS f FROM profiles)"]
    for k in range(most):
        at = "list_position(p, list_max(p))"
        left = f"list_transform(range(1, len(p) + 1), lambda i: CASE WHEN abs(i - {at}) <= {distance} THEN 0::DOUBLE ELSE p[i] END)"
        steps.append(f"s{k + 1} AS (SELECT vec_id, CASE WHEN list_max(p) > 0 THEN {left} ELSE p END AS p, CASE WHEN list_max(p) > 0 THEN list_append(f, CAST({at} - 1 AS VARCHAR)) ELSE f END AS f FROM s{k})")
    return f"WITH {PROFILES_SQL}, {', '.join(steps)} SELECT vec_id, array_to_string(f, ',') AS peaks FROM s{most}"


add("profile_peaks", profiles, lambda df: df.select("vec_id", F.array_join(arrays.peaks("p", 4, 5), ",").alias("peaks")), _peaks_sql(4, 5))

# -- candidates of the detector: stand-in boxes in an image of 600 x 800 -----------------------------------------------------------------
_W, _H = 600.0, 800.0
_STAND_IN = {
    "px": "CASE WHEN l_linenumber % 6 <> 0 THEN CAST(l_partkey % 150 AS DOUBLE) END", "py": "CAST(l_suppkey % 120 AS DOUBLE)", "pw": "CAST(200 AS DOUBLE) + l_quantity * CAST(7 AS DOUBLE)", "ph": "CAST(300 AS DOUBLE) + CAST(l_orderkey % 450 AS DOUBLE)",
    "cx": "CASE WHEN l_suppkey % 5 <> 0 THEN CAST(l_suppkey % 140 AS DOUBLE) END", "cy": "CAST(l_partkey % 110 AS DOUBLE)", "cw": "CAST(190 AS DOUBLE) + CAST(l_partkey % 300 AS DOUBLE)", "ch": "CAST(280 AS DOUBLE) + CAST(l_suppkey % 440 AS DOUBLE)",
    "a": "CAST(l_orderkey % 41 AS DOUBLE)", "b": "CAST(l_partkey % 37 AS DOUBLE)", "c": "CAST(l_suppkey % 31 AS DOUBLE)", "u": "CAST(l_orderkey % 17 AS DOUBLE) / CAST(16 AS DOUBLE)", "v": "CAST(l_partkey % 19 AS DOUBLE) / CAST(18 AS DOUBLE)",
}
_STAND_SQL = f"e AS (SELECT {K}, {', '.join(f'{x} AS {n}' for n, x in _STAND_IN.items())} FROM lineitem)"


def stand_ins(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(*KEYS, *(F.expr(x).alias(n) for n, x in _STAND_IN.items()))


def _box(x: str) -> tuple:
    return F.col(f"{x}x"), F.col(f"{x}y"), F.col(f"{x}x") + F.col(f"{x}w"), F.col(f"{x}y") + F.col(f"{x}h")


def _box_choice(df: DataFrame) -> DataFrame:
    p, c = _box("p"), _box("c")
    shape, seed, fall = boxes.box_shape(c, F.lit(_W), F.lit(_H)), boxes.first_box(projection=p, component=c), boxes.fallback_box(F.lit(_W), F.lit(_H) + F.col("a"), c)
    return df.select(
        *KEYS, *(math.rounded(shape[n], 6).alias(n) for n in ("area_ratio", "width_ratio", "height_ratio", "aspect_deviation")), F.coalesce(boxes.plausible_outer_box(p, F.lit(_W), F.lit(_H)), F.lit(False)).alias("plausible"),
        boxes.chosen_box(p, c, F.lit(_W), F.lit(_H), "u", "v").alias("chosen"), seed["source"].alias("seed"), seed["box"][2].alias("seed_x2"), fall["source"].alias("fallback"), *(fall["box"][k].alias(f"fallback_{k}") for k in range(4)),
    )


def _shape_sql(x: str) -> str:
    return f"{x}w * {x}h / 480000::DOUBLE AS {x}_area, {x}w / 600::DOUBLE AS {x}_width, {x}h / 800::DOUBLE AS {x}_height, abs({x}w / {x}h - 0.715::DOUBLE) AS {x}_dev"


def _ok_sql(x: str) -> str:
    return f"({x}x IS NOT NULL AND {x}_area BETWEEN 0.12 AND 0.82 AND {x}_width >= 0.38 AND {x}_height >= 0.50 AND {x}_dev <= 0.12)"


_CUT_SQL = "greatest(0::DOUBLE, least(px + pw, cx + cw) - greatest(px, cx)) * greatest(0::DOUBLE, least(py + ph, cy + ch) - greatest(py, cy))"
_FIT = "(cx IS NOT NULL AND cw * ch / (600::DOUBLE * (800::DOUBLE + a)) BETWEEN 0.10 AND 0.78)"
_TALL = "round_even((800::DOUBLE + a) * 0.68::DOUBLE, 0)"
_BROAD = f"round_even({_TALL} * 0.715::DOUBLE, 0)"
_MID = (f"round_even(300::DOUBLE - {_BROAD} / 2::DOUBLE, 0)", f"round_even(floor((800::DOUBLE + a) / 2::DOUBLE) - {_TALL} / 2::DOUBLE, 0)", f"round_even(300::DOUBLE + {_BROAD} / 2::DOUBLE, 0)", f"round_even(floor((800::DOUBLE + a) / 2::DOUBLE) + {_TALL} / 2::DOUBLE, 0)")
add(
    "box_choice",
    stand_ins,
    _box_choice,
    f"""WITH {_STAND_SQL}, s AS (SELECT *, {_shape_sql('p')}, {_shape_sql('c')}, sqrt(power(px + pw / 2 - cx - cw / 2, 2) + power(py + ph / 2 - cy - ch / 2, 2)) / 600::DOUBLE AS apart, {_CUT_SQL} AS common FROM e),
 t AS (SELECT *, {_ok_sql('p')} AS p_ok, {_ok_sql('c')} AS c_ok, greatest(p_area, c_area) / greatest(least(p_area, c_area), 1e-6::DOUBLE) AS ratio, common / (pw * ph + cw * ch - common) AS iou, CASE WHEN c_area < p_area THEN 'component' ELSE 'projection' END AS smaller FROM s)
 SELECT {K}, {', '.join(f'CASE WHEN cx IS NOT NULL THEN {rnd(x, 6)} END AS {n}' for x, n in (('c_area', 'area_ratio'), ('c_width', 'width_ratio')))}, {rnd('c_height', 6)} AS height_ratio, CASE WHEN cx IS NOT NULL THEN {rnd('c_dev', 6)} END AS aspect_deviation, p_ok AS plausible,
 CASE WHEN px IS NULL AND cx IS NULL THEN 'none' WHEN px IS NULL THEN 'component' WHEN cx IS NULL THEN 'projection' WHEN c_ok AND NOT p_ok THEN 'component' WHEN p_ok AND NOT c_ok THEN 'projection' WHEN apart <= 0.16 AND ratio >= 1.45 THEN smaller WHEN iou >= 0.45 AND ratio >= 1.30 THEN smaller
 WHEN p_area > 0.52 AND c_ok THEN 'component' WHEN p_width > 0.78 AND c_ok THEN 'component' WHEN p_height > 0.94 AND c_ok THEN 'component' WHEN p_dev > c_dev + 0.03::DOUBLE AND c_ok THEN 'component' WHEN v > u + 0.18::DOUBLE THEN 'component' ELSE 'projection' END AS chosen,
 CASE WHEN px IS NOT NULL THEN 'projection' WHEN cx IS NOT NULL THEN 'component' ELSE '' END AS seed, coalesce(px + pw, cx + cw) AS seed_x2, CASE WHEN {_FIT} THEN 'estimated_outer_bbox' ELSE 'centered_conservative' END AS fallback,
 {', '.join(f'CASE WHEN {_FIT} THEN {own} ELSE {mid} END AS fallback_{k}' for k, (own, mid) in enumerate(zip(('cx', 'cy', 'cx + cw', 'cy + ch'), _MID, strict=True)))} FROM t""",
)


def _candidate_rules(df: DataFrame) -> DataFrame:
    x1, y1, x2, y2 = F.lit(20.0) + F.col("b"), F.col("cy"), F.lit(20.0) + F.col("b") + F.col("cw"), F.col("cy") + F.col("ch")
    quad, box, u, v = ((x1, y1), (x2 + F.col("a"), y1 + F.col("b")), (x2, y2), (x1 + F.col("c"), y2)), (x1, y1, x2 + F.col("a"), y2), F.col("u"), F.col("v")
    sides, margins = boxes.geometry_sides(quad, F.lit(_W), F.lit(_H)), boxes.outer_margins(quad, box, _box("p"))
    d = df.withColumns(sides | margins)  # what is used several times stands in a column of its own
    own = lambda names: {n: F.col(n) for n in names}
    d = d.withColumns(ratios := boxes.geometry_ratios(own(sides)))
    shares = ((box[2] - box[0]) / _W, (y2 - y1) / _H, 0.5 + 0.5 * u, 0.6 + 0.5 * v, 0.4 + 0.6 * u, 0.4 * v, 0.3 * u)
    d = d.withColumns(flags := boxes.geometry_flags(own(ratios), *shares))
    g = boxes.geometry_rules(quad, F.lit(_W), F.lit(_H), *shares, ratios=own(ratios), flags=own(flags))
    w = boxes.within_outer(quad, box, _box("p"), made=own(margins))
    d = d.select(*KEYS, "u", "v", "px", *(c.alias(n) for n, c in (g | w).items()))
    h = boxes.hard_rules("area_ratio", "v", "u", "u", "v", 0.5 * u, 0.5 * v, "v", 0.4 * v, "geometry_valid", 0.6 * u, 20.0 * v, "touch_count", "is_internal", F.when(F.col("px").isNotNull(), F.col("relative_size")))
    digits = [math.rounded(n, 6).alias(n) for n in ("geometry_penalty", "side_length_consistency_score", "area_plausibility_score", "border_distance", "relative_size", "centre_distance")]
    return d.select(*KEYS, *digits, "geometry_valid", "geometry_reasons", "is_internal", "touches", "touch_count", "rejection_reason", *(c.alias(n) for n, c in h.items()))


def _candidate_sql() -> str:
    soft = {
        "top_bottom_length_mismatch": ("tb > 0.14", "tb > 0.24", 0.18, 0.24), "left_right_length_mismatch": ("lr > 0.16", "lr > 0.26", 0.16, 0.22), "aspect_ratio_off": ("dev > 0.065", "dev > 0.14", 0.18, 0.24),
        "implausible_area": ("pl < 0.40", "pl <= 0.05", 0.15, 0.20), "bbox_too_large": ("greatest(bw, bh) > 0.96 AND share > 0.78", "greatest(bw, bh) > 0.985 AND share > 0.84", 0.16, 0.18),
        "weak_evidence_coverage": ("ev < 0.78", "ev < 0.60", 0.22, 0.26), "oversized_vs_evidence": ("cov < 0.72", "cov < 0.56", 0.12, 0.18), "low_min_side_support": ("ms < 0.16", "ms < 0.10", 0.28, 0.24), "unbalanced_side_support": ("sp > 0.18", "sp > 0.26 AND ms < 0.18", 0.14, 0.18),
    }
    hard = {
        "area_too_small": "share < 0.16", "width_too_small": "v < 0.32", "height_too_small": "u < 0.42", "low_vertical_support": "greatest(u, v) < 0.26", "low_silhouette_support": "v < 0.55", "asymmetric_border_support": "least(u + v, 0.5::DOUBLE * u + 0.5::DOUBLE * v) < 0.40",
        "weak_side_bottleneck": "ms < 0.10", "invalid_geometry": "NOT valid", "strong_trapezoid": "0.6::DOUBLE * u > 0.50", "bad_angles": "20.0::DOUBLE * v > 15.0", "touches_too_many_borders": "tc >= 3", "internal_candidate": "inner_", "too_small_vs_outer_bbox": "px IS NOT NULL AND size2 < 0.35",
    }
    sides = {n: _D.format(*x) for n, x in (("st", ("x1", "y1", "x2 + a", "(y1 + b)")), ("sr", ("(x2 + a)", "(y1 + b)", "x2", "y2")), ("sb", ("x2", "y2", "(x1 + c)", "y2")), ("sl", ("(x1 + c)", "y2", "x1", "y1")))}
    sides["st"] = _D.format("x1", "y1", "(x2 + a)", "(y1 + b)")
    area = "abs(x1 * (y1 + b) - (x2 + a) * y1 + ((x2 + a) * y2 - x2 * (y1 + b)) + (x2 * y2 - (x1 + c) * y2) + ((x1 + c) * y1 - x1 * y2)) / 2"
    valid = " AND ".join(f"NOT ({h})" for _, h, _, _ in soft.values())
    penalty = " + ".join(f"CASE WHEN {s} THEN {a}::DOUBLE ELSE 0 END + CASE WHEN {h} THEN {b}::DOUBLE ELSE 0 END" for s, h, a, b in soft.values())
    m = ["(x1 - px) / norm", "(px + pw - (x2 + a)) / norm", "(y1 - py) / norm", "(py + ph - y2) / norm"]
    return f"""WITH {_STAND_SQL}, q AS (SELECT *, 20 + b AS x1, cy AS y1, 20 + b + cw AS x2, cy + ch AS y2, least(pw, ph) AS norm, 0.4::DOUBLE * v AS ms, 0.3::DOUBLE * u AS sp, 0.4::DOUBLE + 0.6::DOUBLE * u AS cov, least(0.5::DOUBLE + 0.5::DOUBLE * u, 0.6::DOUBLE + 0.5::DOUBLE * v) AS ev FROM e),
 r AS (SELECT *, {', '.join(f'{x} AS {n}' for n, x in sides.items())}, {area} AS area, (x2 + a - x1) / 600::DOUBLE AS bw, (y2 - y1) / 800::DOUBLE AS bh, [{', '.join(m)}] AS m, sqrt(power((x1 + x2 + a + x2 + x1 + c) / 4 - (px + pw / 2), 2) + power((y1 + y1 + b + y2 + y2) / 4 - (py + ph / 2), 2)) / norm AS away FROM q),
 g AS (SELECT *, abs(st - sb) / greatest(st, sb, 1) AS tb, abs(sl - sr) / greatest(sl, sr, 1) AS lr, abs(((st + sb) / 2) / ((sr + sl) / 2) - 0.715::DOUBLE) AS dev, area / 480000::DOUBLE AS share, area / (pw * ph) AS size, len(list_filter(m, lambda x: x <= 0.12)) AS touched, list_sum(list_transform(m, lambda x: greatest(x, 0::DOUBLE))) / 4 AS far FROM r),
 p AS (SELECT *, CASE WHEN share < 0.16 THEN 0 WHEN share < 0.18 THEN 0.35 WHEN share < 0.28 THEN 0.75 WHEN share < 0.58 THEN 1 WHEN share < 0.72 THEN 0.55 WHEN share < 0.84 THEN 0.2 ELSE 0 END::DOUBLE AS pl, px IS NOT NULL AND list_min(m) >= -0.03 AND size < 0.72 AND touched = 0 AND far > 0.10 AND away < 0.28 AS inner_, CASE WHEN px IS NULL THEN 0 ELSE touched END AS tc, CASE WHEN px IS NULL THEN 0 ELSE least(size, 2) END AS size2 FROM g),
 f AS (SELECT *, {valid} AS valid FROM p), w AS (SELECT *, {_listed('[' + ', '.join(f"CASE WHEN {c} THEN '{n}' END" for n, c in hard.items()) + ']')} AS failed FROM f)
 SELECT {K}, {rnd(clamp(penalty), 6)} AS geometry_penalty, {rnd(clamp('0.55::DOUBLE * greatest(0, 1 - tb / 0.24::DOUBLE) + 0.45::DOUBLE * greatest(0, 1 - lr / 0.26::DOUBLE)'), 6)} AS side_length_consistency_score, pl AS area_plausibility_score, CASE WHEN px IS NULL THEN 1 ELSE {rnd('far', 6)} END AS border_distance, {rnd('size2', 6)} AS relative_size, CASE WHEN px IS NOT NULL THEN {rnd('away', 6)} END AS centre_distance,
 valid AS geometry_valid, {_listed('[' + ', '.join(f"CASE WHEN {s} THEN '{n}' END" for n, (s, *_) in soft.items()) + ']')} AS geometry_reasons, inner_ AS is_internal, px IS NOT NULL AND touched > 0 AS touches, CAST(tc AS INT) AS touch_count, CASE WHEN NOT inner_ THEN '' WHEN size < 0.42 THEN 'too_small_inside_outer_bbox' WHEN far > 0.18 THEN 'too_far_from_outer_border' ELSE 'central_internal_shape' END AS rejection_reason, failed = '' AS hard_rules_ok, failed AS hard_fail_reasons FROM w"""


add("candidate_rules", lambda spark, d: stand_ins(compilable(spark), d), _candidate_rules, _candidate_sql())


# -- images and models: no SQL can follow these -----------------------------------------------------------------------------------------
def drawn_images(spark: SparkSession, d: str) -> DataFrame:
    """A drawn card for each region: no photographs are at hand."""
    from collections.abc import Iterator

    import numpy as np
    import pandas as pd

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key in b["r_regionkey"]:
                y, x = np.mgrid[:420, :320]
                a = np.deg2rad(2.0 * key)
                u, v = (x - 160) * np.cos(a) + (y - 210) * np.sin(a), (y - 210) * np.cos(a) - (x - 160) * np.sin(a)
                image = np.full((420, 320, 3), 25 + 5 * key, np.uint8)
                image[(abs(u) <= 107) & (abs(v) <= 150)] = (225, 220, 215)
                image[(abs(u) <= 92) & (abs(v) <= 135)] = (140, 150 + 10 * key, 190)
                rows.append((f"/raw/{'damaged' if key % 2 else 'clean'}/{key}.png", 420, 320, 3, image.tobytes()))
            yield pd.DataFrame(rows, columns=["path", "height", "width", "nChannels", "data"])

    from ..sources.images import with_names

    drawn = table(spark, d, "region").select("r_regionkey").mapInPandas(draw, "path string, height int, width int, nChannels int, data binary")
    return with_names(drawn, "/raw")


@query("image_features")
def image_features(spark, d):
    from ..operators.images import dataset

    return dataset(drawn_images(spark, d)).drop("run_timestamp")


@query("detect_warp")
def detect_warp(spark, d):
    from ..operators.images import measured

    return measured(drawn_images(spark, d)).select("origin", "stage", "detection.*", "postwarp.rectified_aspect_ratio")


@query("train_predict")
def train_predict(spark, d):
    from ..operators import modelling

    rows = split_events(spark, d).join(table(spark, d, "events").select("event_id", "value", "user_id"), "event_id").withColumns({"target_damaged": (F.col("event_type") == "click").cast("int"), "user_id": F.col("user_id").cast("double")})
    model = modelling.pipeline("linear", ["value", "user_id"], maxIter=20).fit(rows.where("split = 'train'"))
    return modelling.predict(model, rows.where("split = 'test'").select("event_id", "value", "user_id", "target_damaged")).select("event_id", "target_damaged", "y_pred", math.rounded("y_prob_damaged", 6).alias("y_prob_damaged"))


@query("batch_inference")
def batch_inference(spark, d):
    """Price of every part: its best catalogue row, a predicted condition and the price for it."""
    score = 1.0 + F.pmod(F.col("query_id"), F.lit(91)) / 10.0
    return candidates(spark, d, "p_retailprice").select("query_id", "id", *(c.alias(n) for n, c in pricing.priced(F.col("p_retailprice"), score).items()))


@query("sequence_similarity")
def sequence_similarity(spark, d):
    return table(spark, d, "part").select("p_partkey", math.rounded(text.sequence_similarity("p_type", "p_name"), 6).alias("similarity"))
