"""Queries of the detector's choice between candidates, over stand-ins: plain arithmetic in place of what a raster shows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import math
from ..operators import detection
from .catalogue import _listed, add, clamp, rnd
from .proxies import table

# -- candidates: a few an order, in an image of 600 x 800; some are the same quad again -------------------------------------------------
_N = "28"
_SHIFT = {"tl_x": "0", "tl_y": "0", "tr_x": "a", "tr_y": "b", "br_x": "b", "br_y": "c", "bl_x": "c", "bl_y": "a"}
_BASE = {
    "g": "CAST(l_linenumber % 3 AS DOUBLE)", "o": "CAST(l_orderkey % 97 AS DOUBLE)", "a": "CAST(l_orderkey % 5 AS DOUBLE)", "b": "CAST(l_orderkey % 7 AS DOUBLE)", "c": "CAST(l_orderkey % 11 AS DOUBLE)",
    "m": "CAST(l_partkey % 31 AS DOUBLE)", "s": "CAST(l_suppkey % 13 AS DOUBLE)", "q": "CAST(l_quantity AS DOUBLE)",
}


def _corner(point: str) -> str:
    """A corner of a quad near a card's shape, moved by the order's key."""
    x = "CAST(70 AS DOUBLE) + g * CAST(6 AS DOUBLE) + o / CAST(4 AS DOUBLE)" + (" + CAST(390 AS DOUBLE)" if point[1] == "r" else "")
    y = "CAST(90 AS DOUBLE) + g * CAST(5 AS DOUBLE) + o / CAST(5 AS DOUBLE)" + (" + CAST(545 AS DOUBLE) - g * CAST(20 AS DOUBLE)" if point[0] == "b" else "")
    return f"{x if point.endswith('x') else y} + CAST({_SHIFT[point]} AS DOUBLE)"


# keys repeat, so candidates are told apart by all that makes them
_ORDER = "((CAST(l_linenumber AS BIGINT) * 1000000 + l_partkey) * 100000 + l_suppkey) * 100 + CAST(l_quantity AS BIGINT)"
_SEED = {"left": 3, "right": 5, "top": 7, "bottom": 11}


def _near(side: str, k: str, mod: str) -> str:
    return f"CAST(1 AS DOUBLE) - CAST({mod.format(f'({k} * {_SEED[side]} + CAST(m AS INT) + CAST(o AS INT))', 29)} AS DOUBLE) / (CAST(35 AS DOUBLE) + s * CAST(9 AS DOUBLE))"


def _deep(side: str, k: str, mod: str) -> str:
    return f"CAST({mod.format(f'({k} + CAST(s AS INT) * {_SEED[side]})', 17)} AS DOUBLE) / CAST(70 AS DOUBLE)"


_SEEN = {"near": _near, "deep": _deep}


def _spread(make, side: str):
    return F.expr(f"transform(sequence(0, {_N} - 1), k -> {make(side, 'k', '{0} % {1}')})")


def _profiles(spark: SparkSession) -> DataFrame:
    """What is seen along the sides depends on m + o and s alone, so each profile is drawn once: 127 x 13 rows."""
    keys = spark.range(127 * 13).select(F.expr("id div 13").cast("double").alias("mo"), (F.col("id") % 13).cast("double").alias("s"))
    drawn = keys.withColumns({"m": F.col("mo"), "o": F.lit(0.0)})
    return drawn.select("mo", "s", *(_spread(make, side).alias(f"drawn_{name}_{side}") for side in detection.SIDES for name, make in _SEEN.items()))


def candidates(spark: SparkSession, d: str, by: str | None = None) -> DataFrame:
    """The ranked candidates; with ``by`` they lie together by that column, dealt out while rows are still a few numbers."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    rows = rows.repartition(by) if by else rows
    rows = rows.select("l_orderkey", F.expr(_ORDER).alias("order"), *(F.expr(e).alias(n) for n, e in _BASE.items())).withColumn("mo", F.col("m") + F.col("o"))
    rows = rows.join(F.broadcast(_profiles(spark)), ["mo", "s"], "left")
    rows = rows.select(
        "l_orderkey", "order", F.lit("stand-in").alias("source"), *(F.expr(_corner(p)).alias(p) for p in detection.POINTS), (F.col("q") / 300.0).alias("edge_share"),
        *(F.coalesce(f"drawn_{name}_{side}", _spread(make, side)).alias(f"{name}_{side}") for side in detection.SIDES for name, make in _SEEN.items()),  # negative keys are drawn here
        F.array(*(F.expr(e) for e in ("CAST(70 AS DOUBLE) + m", "CAST(90 AS DOUBLE) + m", "CAST(470 AS DOUBLE) - s", "CAST(640 AS DOUBLE) - s"))).alias("evidence"),
        F.array(*(F.col("m") * k for k in (5.0, 3.0, 4.0, 2.0, 6.0))).alias("inner"), F.array(*(F.col("s") * k for k in (4.0, 5.0, 3.0, 6.0, 2.0))).alias("outer"), "o",
    )
    expected = F.when(F.col("o") % 4 != 0, F.array(F.lit(60.0), F.lit(80.0), F.lit(480.0) + F.col("o") / 4.0, F.lit(650.0)))
    return detection.ranked(rows, F.lit(600.0), F.lit(800.0), expected)


_SHOWN = ("score", "penalty", "silhouette", "rectangularity", "edges", "colour", "covered", "relative_size", "border_distance", "geometry_penalty")


def _won(df: DataFrame) -> DataFrame:
    w = detection.winners(df, "l_orderkey", "order", keep=("order", *_SHOWN))
    return w.select("l_orderkey", "pool", "competing", F.col("winner.order").alias("best"), *(math.rounded(F.col(f"winner.{n}"), 6).alias(n) for n in _SHOWN))


def _failed(df: DataFrame) -> DataFrame:
    digits = [math.rounded(n, 6).alias(n) for n in ("score", "outerness", "size", "support_spread", "min_support", "trapezoid", "angle_deviation", "parallel_gap")]
    return df.select("l_orderkey", F.col("order").alias("candidate"), *digits, "touch_count", "plausible", "geometry_valid", "geometry_reasons", "hard_fail_reasons")


def _ranked_sql() -> str:
    """Every stage as a common table expression, its terms spelt out."""
    q = [("tl_x", "tl_y"), ("tr_x", "tr_y"), ("br_x", "br_y"), ("bl_x", "bl_y")]
    dist = lambda a, b: f"sqrt(power({b[0]} - {a[0]}, 2) + power({b[1]} - {a[1]}, 2))"
    xs, ys = ", ".join(p[0] for p in q), ", ".join(p[1] for p in q)

    def angle(k: int) -> str:
        at, p, n = q[k], q[k - 1], q[(k + 1) % 4]
        dot = f"(({p[0]} - {at[0]}) * ({n[0]} - {at[0]}) + ({p[1]} - {at[1]}) * ({n[1]} - {at[1]}))"
        return f"abs(degrees(acos({clamp(f'{dot} / ({dist(p, at)} * {dist(n, at)})', -1, 1)})) - 90)"

    def gap(a: tuple, b: tuple) -> str:
        way = lambda x: f"degrees(atan2({x[1][1]} - {x[0][1]}, {x[1][0]} - {x[0][0]}))"
        turned = f"(abs({way(a)} - {way(b)}) % 180)"
        return f"least({turned}, 180 - {turned})"

    def support(side: str) -> str:
        s = f"list_transform(range(0, {_N}), lambda k: {clamp(f'({_near(side, "k", "({0} % {1})")}) * (1 - 0.72::DOUBLE * ({_deep(side, "k", "({0} % {1})")}))')})"
        return f"{s} AS s_{side}"

    def run(side: str) -> str:
        state = f"list_reduce(list_transform(s_{side}, lambda x: {{'now': CASE WHEN x >= 0.45 THEN 1 ELSE 0 END, 'best': CASE WHEN x >= 0.45 THEN 1 ELSE 0 END}}), lambda t, x: {{'now': CASE WHEN x.now > 0 THEN t.now + 1 ELSE 0 END, 'best': greatest(t.best, CASE WHEN x.now > 0 THEN t.now + 1 ELSE 0 END)}})"
        return f"{clamp(f'0.68::DOUBLE * (list_sum(s_{side}) / {_N}) + 0.32::DOUBLE * (({state}).best / {_N}::DOUBLE)')} AS {side}_s"

    turn = [f"(({q[(k + 1) % 4][0]} - {q[k][0]}) * ({q[(k + 2) % 4][1]} - {q[(k + 1) % 4][1]}) - ({q[(k + 1) % 4][1]} - {q[k][1]}) * ({q[(k + 2) % 4][0]} - {q[(k + 1) % 4][0]}))" for k in range(4)]
    shoelace = " + ".join(f"({q[k][0]} * {q[(k + 1) % 4][1]} - {q[(k + 1) % 4][0]} * {q[k][1]})" for k in range(4))
    soft = {
        "top_bottom_length_mismatch": ("wg > 0.14", "wg > 0.24", 0.18, 0.24), "left_right_length_mismatch": ("hg > 0.16", "hg > 0.26", 0.16, 0.22), "aspect_ratio_off": ("dev > 0.065", "dev > 0.14", 0.18, 0.24),
        "implausible_area": ("ap < 0.40", "ap <= 0.05", 0.15, 0.20), "bbox_too_large": ("greatest(bw, bh) > 0.96 AND share > 0.78", "greatest(bw, bh) > 0.985 AND share > 0.84", 0.16, 0.18),
        "weak_evidence_coverage": ("least(ew, eh) < 0.78", "least(ew, eh) < 0.60", 0.22, 0.26), "oversized_vs_evidence": ("covered < 0.72", "covered < 0.56", 0.12, 0.18),
        "low_min_side_support": ("ms < 0.16", "ms < 0.10", 0.28, 0.24), "unbalanced_side_support": ("spread > 0.18", "spread > 0.26 AND ms < 0.18", 0.14, 0.18),
    }
    hard = {
        "area_too_small": "share < 0.16", "width_too_small": "bw < 0.32", "height_too_small": "bh < 0.42", "low_vertical_support": "greatest(left_s, right_s) < 0.26", "low_silhouette_support": "silhouette < 0.55",
        "asymmetric_border_support": "least(left_s + right_s, top_s + bottom_s) < 0.40", "weak_side_bottleneck": "ms < 0.10", "invalid_geometry": "NOT valid", "strong_trapezoid": "trapezoid > 0.50", "bad_angles": "angle_deviation > 15",
        "touches_too_many_borders": "touch_count >= 3", "internal_candidate": "inside", "too_small_vs_outer_bbox": "known AND relative_size < 0.35",
    }
    reasons = lambda found: _listed("[" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in found.items()) + "]")
    m = ["(x1 - 60) / norm", "(480 + o / 4 - x2) / norm", "(y1 - 80) / norm", "(650 - y2) / norm"]
    middle = "sqrt(power((tl_x + tr_x + br_x + bl_x) / 4 - {0}, 2) + power((tl_y + tr_y + br_y + bl_y) / 4 - {1}, 2))"
    terms = " + ".join(
        f"{w}::DOUBLE * {x}"
        for w, x in (
            (0.06, "area_t"), (0.05, "outerness"), (0.08, "aspect_t"), (0.03, "centre_t"), (0.04, "convex"), (0.22, "edges"), (0.18, "rectangularity"), (0.10, "1"), (0.14, "size"), (0.22, "silhouette"),
            (0.04, "colour"), (0.12, "CASE WHEN touches THEN 1 ELSE 0 END"), (0.10, "least(1, relative_size)"),
        )
    )
    return f"""
WITH e AS (SELECT l_orderkey, {_ORDER} AS ord, {', '.join(f'{x} AS {n}' for n, x in _BASE.items())} FROM lineitem),
c AS (SELECT *, {', '.join(f'{_corner(p)} AS {p}' for p in detection.POINTS)}, q / 300 AS edge_share, {', '.join(support(s) for s in detection.SIDES)} FROM e),
f AS (SELECT *, floor(least({xs})) AS x1, floor(least({ys})) AS y1, ceil(greatest({xs})) AS x2, ceil(greatest({ys})) AS y2, abs({shoelace}) / 2 AS surface, (greatest({xs}) - least({xs})) / 600 AS bw, (greatest({ys}) - least({ys})) / 800 AS bh,
 {dist(q[0], q[1])} AS st, {dist(q[1], q[2])} AS sr, {dist(q[2], q[3])} AS sb, {dist(q[3], q[0])} AS sl, ({' + '.join(angle(k) for k in range(4))}) / 4 AS angle_deviation,
 ({gap((q[0], q[1]), (q[3], q[2]))} + {gap((q[0], q[3]), (q[1], q[2]))}) / 2 AS parallel_gap, list_sort([least({xs}) / 600, (600 - greatest({xs})) / 600, least({ys}) / 600, (800 - greatest({ys})) / 600]) AS margins,
 CASE WHEN least({', '.join(turn)}) >= 0 OR greatest({', '.join(turn)}) <= 0 THEN 1 ELSE 0 END AS convex, least(1, edge_share / 0.30::DOUBLE) AS edges, {clamp(f"1 - {middle.format(300, 400)} / 500")} AS centre_t,
 {clamp("0.42::DOUBLE * abs(5 * m - 4 * s) / 255 + 0.28::DOUBLE * sqrt(power(3 * m - 5 * s, 2) + power(4 * m - 3 * s, 2)) / 181 + 0.15::DOUBLE * abs(2 * m - 6 * s) / 255 + 0.15::DOUBLE * abs(6 * m - 2 * s) / 255")} AS colour,
 {', '.join(run(s) for s in detection.SIDES)} FROM c),
g AS (SELECT *, surface / 480000 AS share, abs(st - sb) / greatest(st, sb, 1) AS wg, abs(sl - sr) / greatest(sl, sr, 1) AS hg, ((st + sb) / 2) / ((sr + sl) / 2) AS aspect_ratio, least(left_s, right_s, top_s, bottom_s) AS ms,
 (left_s + right_s + top_s + bottom_s) / 4 AS mean, 0.5::DOUBLE * (left_s + right_s) AS upright, CAST(len(list_filter(margins, lambda x: x <= 0.0035)) AS INT) AS touch_count,
 {clamp("(470 - s - 70 - m) / greatest(x2 - x1, 1)")} AS ew, {clamp("(640 - s - 90 - m) / greatest(y2 - y1, 1)")} AS eh, least(420 + o / 4, 570) AS norm, o % 4 <> 0 AS known FROM f),
h AS (SELECT *, abs(aspect_ratio - 0.715::DOUBLE) AS dev, sqrt((power(left_s - mean, 2) + power(right_s - mean, 2) + power(top_s - mean, 2) + power(bottom_s - mean, 2)) / 4) AS spread, least(1, (0.7::DOUBLE * wg + 0.3::DOUBLE * hg) / 0.35::DOUBLE) AS trapezoid,
 {clamp("(0.40::DOUBLE * left_s + 0.40::DOUBLE * right_s + 0.10::DOUBLE * top_s + 0.10::DOUBLE * bottom_s) * CASE WHEN upright < 0.26 THEN 0.55::DOUBLE ELSE 1 END * CASE WHEN greatest(top_s, bottom_s) < 0.08 AND upright < 0.30 THEN 0.75::DOUBLE ELSE 1 END")} AS silhouette,
 CASE WHEN share < 0.16 THEN 0 WHEN share < 0.20 THEN 0.35 WHEN share < 0.28 THEN 0.65 WHEN share < 0.55 THEN 1 WHEN share < 0.75 THEN 0.55 ELSE 0.10 END::DOUBLE AS area_t,
 CASE WHEN share < 0.16 THEN 0 WHEN share < 0.18 THEN 0.35 WHEN share < 0.28 THEN 0.75 WHEN share < 0.58 THEN 1 WHEN share < 0.72 THEN 0.55 WHEN share < 0.84 THEN 0.2 ELSE 0 END::DOUBLE AS ap,
 CASE WHEN touch_count >= 3 THEN 0 ELSE (0.85::DOUBLE * least(1, share / 0.82::DOUBLE) + 0.15::DOUBLE * least(1, margins[2] / 0.025::DOUBLE)) * CASE touch_count WHEN 2 THEN 0.70::DOUBLE WHEN 1 THEN 0.92::DOUBLE ELSE 1 END END AS outerness,
 {clamp("0.40::DOUBLE * least(1, share / 0.16::DOUBLE) + 0.25::DOUBLE * least(1, bw / 0.32::DOUBLE) + 0.35::DOUBLE * least(1, bh / 0.42::DOUBLE)")} AS size, [{', '.join(m)}] AS ms_outer, {middle.format('(60 + 480 + o / 4) / 2', '(80 + 650) / 2')} / norm AS away,
 surface / ((420 + o / 4) * 570) AS relative, {clamp("0.42::DOUBLE * ew + 0.42::DOUBLE * eh + 0.16::DOUBLE * sqrt(ew * eh)")} AS covered,
 (x2 - x1) * (y2 - y1) / 480000 BETWEEN 0.12 AND 0.82 AND (x2 - x1) / 600 >= 0.38 AND (y2 - y1) / 800 >= 0.50 AND abs((x2 - x1) / (y2 - y1) - 0.715::DOUBLE) <= 0.12 AS plausible FROM g),
i AS (SELECT *, CASE WHEN dev <= 0.03 THEN 1 WHEN dev <= 0.08 THEN 0.75 WHEN dev <= 0.14 THEN 0.45 ELSE 0 END::DOUBLE AS aspect_t, len(list_filter(ms_outer, lambda x: x <= 0.12)) > 0 AND known AS touches, list_sum(list_transform(ms_outer, lambda x: greatest(x, 0))) / 4 AS far,
 {clamp("0.42::DOUBLE * greatest(0, 1 - angle_deviation / 25) + 0.33::DOUBLE * greatest(0, 1 - parallel_gap / 18) + 0.25::DOUBLE * greatest(0, 1 - (wg + hg) / 2 / 0.28::DOUBLE) - 0.18::DOUBLE * trapezoid")} AS rectangularity,
 {' AND '.join(f'NOT ({x})' for _, x, _, _ in soft.values())} AS valid, {clamp(' + '.join(f'CASE WHEN {x} THEN {a}::DOUBLE ELSE 0 END + CASE WHEN {y} THEN {b}::DOUBLE ELSE 0 END' for x, y, a, b in soft.values()))} AS geometry_penalty,
 {reasons({n: x for n, (x, *_) in soft.items()})} AS geometry_reasons FROM h),
j AS (SELECT *, CASE WHEN known THEN far ELSE 1 END AS border_distance, CASE WHEN known THEN least(relative, 2) ELSE 0 END AS relative_size,
 known AND NOT touches AND list_min(ms_outer) >= -0.03 AND relative < 0.72 AND far > 0.10 AND away < 0.28 AS inside FROM i),
k AS (SELECT *, {reasons(hard)} AS hard_fail_reasons, CASE WHEN share > 0.98 THEN 0.05::DOUBLE ELSE 1 END * CASE WHEN trapezoid > 0.55 THEN 0.72::DOUBLE ELSE 1 END * CASE WHEN angle_deviation > 18 THEN 0.85::DOUBLE ELSE 1 END * CASE WHEN size < 0.92 THEN 0.88::DOUBLE ELSE 1 END
 * CASE WHEN top_s < 0.08 AND bottom_s < 0.08 AND greatest(left_s, right_s) < 0.35 THEN 0.78::DOUBLE ELSE 1 END * CASE WHEN geometry_penalty > 0 THEN greatest(0.02::DOUBLE, 1 - geometry_penalty) ELSE 1 END
 * CASE WHEN ms >= 0.16 THEN {clamp("0.78::DOUBLE + 0.22::DOUBLE * least(1, ms / 0.35::DOUBLE)")} ELSE {clamp("ms / 0.16::DOUBLE")} END * CASE WHEN spread > 0.18 THEN 0.88::DOUBLE ELSE 1 END * CASE WHEN covered < 0.72 THEN 0.82::DOUBLE ELSE 1 END
 * CASE WHEN known THEN CASE WHEN touches THEN 1 ELSE 0.70::DOUBLE END * {clamp("1.05::DOUBLE - border_distance", 0.10, 1)} * {clamp("relative_size / 0.82::DOUBLE", 0.12, 1)} ELSE 1 END AS penalty FROM j),
r AS (SELECT *, CASE WHEN hard_fail_reasons = '' THEN {clamp(f"({terms}) * penalty")} ELSE 0 END AS score, [{', '.join(f'floor({p} * 10 + 0.5::DOUBLE)' for p in detection.POINTS)}] AS cell FROM k)"""


_WON_SQL = f"""{_ranked_sql()},
o AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY l_orderkey, cell ORDER BY ord) = 1),
b AS (SELECT * FROM o WHERE plausible AND score > 0 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, ord) = 1),
n AS (SELECT l_orderkey, count(*) AS pool, count(*) FILTER (plausible AND score > 0) AS competing FROM o GROUP BY 1)
SELECT n.l_orderkey, pool, competing, b.ord AS best, {', '.join(f'{rnd("b." + x, 6)} AS {x}' for x in _SHOWN)} FROM n LEFT JOIN b USING (l_orderkey)"""
_FAILED_SQL = f"""{_ranked_sql()}
SELECT l_orderkey, ord AS candidate, {', '.join(f'{rnd(x, 6)} AS {y}' for x, y in (("score", "score"), ("outerness", "outerness"), ("size", "size"), ("spread", "support_spread"), ("ms", "min_support"), ("trapezoid", "trapezoid"), ("angle_deviation", "angle_deviation"), ("parallel_gap", "parallel_gap")))},
 touch_count, plausible, valid AS geometry_valid, geometry_reasons, hard_fail_reasons FROM r"""

add("candidate_winners", lambda spark, d: candidates(spark, d, by="l_orderkey"), _won, _WON_SQL)
add("candidate_terms", candidates, _failed, _FAILED_SQL)


# -- boxes from lines: an embedding four times over as a profile of 256 places ---------------------------------------------------------------
def line_profiles(spark: SparkSession, d: str) -> DataFrame:
    e = F.transform("embedding", lambda x: F.abs(x).cast("double"))
    one = table(spark, d, "embeddings").select("vec_id", F.concat(e, e, e, e).alias("p"))
    across = F.transform("p", lambda x, i: x * (1.0 + i / 1000.0))
    down = F.transform(F.reverse("p"), lambda x, i: x * (1.0 + i / 700.0))
    return one.select("vec_id", across.alias("across"), down.alias("down"), F.lit(256.0).alias("w"), F.lit(256.0).alias("h"))


def _line_boxes(df: DataFrame) -> DataFrame:
    d = df.withColumn("line_box", detection.line_box("across", "down", "w", "h"))
    return d.select("vec_id", math.rounded(F.col("line_box.score"), 6).alias("score"), *(F.col(f"line_box.{n}").cast("int").alias(n) for n in ("x1", "y1", "x2", "y2")))


def _line_sql(most: int = 8, apart: int = 8, n: int = 256) -> str:
    """All pairs of pairs of peaks; the peaks are taken one by one."""
    windows = {"l": ("a", 0.03, 0.48), "r": ("a", 0.52, 0.97), "t": ("d", 0.03, 0.42), "b": ("d", 0.58, 0.97)}
    starts = {k: int(n * lo) for k, (_, lo, _) in windows.items()}
    parts = " UNION ALL ".join(f"SELECT vec_id, '{k}' AS side, {starts[k]} AS start, {p}[{starts[k] + 1}:{int(n * hi)}] AS p, []::INT[] AS f FROM prof" for k, (p, _, hi) in windows.items())
    steps = [f"s0 AS ({parts})"]
    for k in range(most):
        at = "list_position(p, list_max(p))"
        left = f"list_transform(range(1, len(p) + 1), lambda i: CASE WHEN abs(i - {at}) <= {apart} THEN 0::DOUBLE ELSE p[i] END)"
        steps.append(f"s{k + 1} AS (SELECT vec_id, side, start, CASE WHEN list_max(p) > 0 THEN {left} ELSE p END AS p, CASE WHEN list_max(p) > 0 THEN list_append(f, CAST(start + {at} - 1 AS INT)) ELSE f END AS f FROM s{k})")
    side = lambda k: f"SELECT vec_id, unnest(f) AS v, generate_subscripts(f, 1) AS k FROM s{most} WHERE side = '{k}'"
    return f"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(abs(x) AS DOUBLE)) AS e FROM embeddings),
p4 AS (SELECT vec_id, e || e || e || e AS p FROM e),
prof AS (SELECT vec_id, list_transform(range(1, len(p) + 1), lambda i: p[i] * (1 + (i - 1) / 1000::DOUBLE)) AS a, list_transform(range(1, len(p) + 1), lambda i: p[len(p) + 1 - i] * (1 + (i - 1) / 700::DOUBLE)) AS d FROM p4),
{', '.join(steps)},
{', '.join(f"{k} AS ({side(k)})" for k in windows)},
x AS (SELECT l.vec_id, l.v AS x1, r.v AS x2, l.k * 64 + r.k AS kx, a[l.v + 1] + a[r.v] AS line FROM l JOIN r USING (vec_id) JOIN prof USING (vec_id) WHERE (r.v - l.v) / {n}::DOUBLE BETWEEN 0.12 AND 0.75),
y AS (SELECT t.vec_id, t.v AS y1, b.v AS y2, t.k * 64 + b.k AS ky, d[t.v + 1] + d[b.v] AS line FROM t JOIN b USING (vec_id) JOIN prof USING (vec_id) WHERE (b.v - t.v) / {n}::DOUBLE BETWEEN 0.20 AND 0.92),
z AS (SELECT vec_id, x1, x2, y1, y2, kx, ky, greatest(0, 1 - abs((x2 - x1) / (y2 - y1)::DOUBLE - 0.715::DOUBLE) / 0.18::DOUBLE) AS shape, greatest(0, 1 - abs((x2 - x1) * (y2 - y1) / {n * n}::DOUBLE - 0.22::DOUBLE) / 0.20::DOUBLE) AS size,
 1 - sqrt(power((x1 + x2) / 2::DOUBLE - {n / 2}, 2) + power((y1 + y2) / 2::DOUBLE - {n / 2}, 2)) / sqrt(2 * power({n / 2}::DOUBLE, 2)) AS place, {clamp("0.25::DOUBLE * (x.line + y.line)")} AS line FROM x JOIN y USING (vec_id)),
s AS (SELECT *, 0.42::DOUBLE * line + 0.26::DOUBLE * shape + 0.18::DOUBLE * size + 0.14::DOUBLE * place AS score FROM z WHERE shape > 0 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, kx, ky) = 1)
SELECT vec_id, {rnd('score', 6)} AS score, CAST(x1 AS INT) AS x1, CAST(y1 AS INT) AS y1, CAST(x2 AS INT) AS x2, CAST(y2 AS INT) AS y2 FROM prof LEFT JOIN s USING (vec_id)"""


add("line_boxes", line_profiles, _line_boxes, _line_sql())


# -- parts of a card: a grey raster of 48 x 64 for each supplier, drawn by arithmetic ---------------------------------------------------------
_WIDE, _TALL = 48, 64
#: Tasks among which cards are dealt before they are drawn.
CARD_TASKS = 96
_PIXEL = "(70 + (7 * {x} + 11 * {y} + ({x} * {y}) % 13 + 3 * CAST(s_suppkey AS INT)) % 61 + CASE WHEN (5 * {x} + 3 * {y} + CAST(s_suppkey AS INT)) % 37 = 0 THEN 90 ELSE 0 END)"


def drawn_cards(spark: SparkSession, d: str) -> DataFrame:
    pixel = _PIXEL.format(x=f"(i % {_WIDE})", y=f"(i div {_WIDE})")
    data = F.expr(f"unhex(array_join(transform(sequence(0, {_WIDE * _TALL - 1}), i -> lpad(hex({pixel}), 2, '0')), ''))")
    drawn = (F.lit("drawn").alias("path"), F.lit(_TALL).alias("height"), F.lit(_WIDE).alias("width"), F.lit(1).alias("nChannels"), data.alias("data"))
    # a supplier is a few bytes and its raster much work: without this a file of any number of them is one task
    return table(spark, d, "supplier").select("s_suppkey").repartition(CARD_TASKS, "s_suppkey").select("s_suppkey", *drawn)


_METRICS = ("mean_intensity", "std_intensity", "highlight_ratio", "roughness", "anomaly_ratio", "profile_length")


def _parts(df: DataFrame) -> DataFrame:
    from ..operators.images import card_parts

    return card_parts(df, keep=("s_suppkey",)).select("s_suppkey", "family", "part", *(math.rounded(m, 6).alias(m) for m in _METRICS))


def _parts_sql() -> str:
    """Regions with their limits, smoothed pixel by pixel, then counted."""
    regions = {
        ("visual", "whole"): (0, 64, 0, 48), ("edge", "top"): (1, 5, 1, 47), ("edge", "bottom"): (59, 63, 1, 47), ("edge", "left"): (1, 63, 1, 5), ("edge", "right"): (1, 63, 43, 47),
        ("corner", "top_left"): (1, 17, 1, 17), ("corner", "top_right"): (1, 17, 31, 47), ("corner", "bottom_left"): (47, 63, 1, 17), ("corner", "bottom_right"): (47, 63, 31, 47),
    }
    listed = ", ".join(f"('{f}', '{p}', {', '.join(map(str, r))})" for (f, p), r in regions.items())
    side = "exp(-1 / 1.28::DOUBLE)"
    a, b = f"({side} / (1 + 2 * {side}))", f"(1 / (1 + 2 * {side}))"
    column = lambda x: f"({a} * {_PIXEL.format(x=x, y='yu')} + {b} * {_PIXEL.format(x=x, y='y')} + {a} * {_PIXEL.format(x=x, y='yd')})"
    near = lambda part, order: f"coalesce(lag(q) OVER {part}, lead(q) OVER {part}) + coalesce(lead(q) OVER {part}, lag(q) OVER {part})"
    return f"""
WITH reg AS (SELECT * FROM (VALUES {listed}) AS t(family, part, y0, y1, x0, x1)),
px AS (SELECT s_suppkey, family, part, x, y, CASE WHEN x = x0 THEN x + 1 ELSE x - 1 END AS xl, CASE WHEN x = x1 - 1 THEN x - 1 ELSE x + 1 END AS xr, CASE WHEN y = y0 THEN y + 1 ELSE y - 1 END AS yu, CASE WHEN y = y1 - 1 THEN y - 1 ELSE y + 1 END AS yd
 FROM supplier, reg, range({_WIDE}) AS tx(x), range({_TALL}) AS ty(y) WHERE x >= x0 AND x < x1 AND y >= y0 AND y < y1),
sm AS (SELECT s_suppkey, family, part, x, y, CASE WHEN family = 'visual' THEN {_PIXEL.format(x='x', y='y')} ELSE floor({a} * {column('xl')} + {b} * {column('x')} + {a} * {column('xr')} + 0.5::DOUBLE) END::BIGINT AS q FROM px),
bent AS (SELECT *, {near("(PARTITION BY s_suppkey, family, part, y ORDER BY x)", "x")} + {near("(PARTITION BY s_suppkey, family, part, x ORDER BY y)", "y")} - 4 * q AS bend FROM sm),
st AS (SELECT s_suppkey, family, part, count(*) AS n, sum(q) / count(*)::DOUBLE AS mean, sqrt(count(*)::DOUBLE * sum(q * q) - sum(q)::DOUBLE * sum(q)) / count(*)::DOUBLE AS std, sum(bend * bend) / count(*)::DOUBLE - power(sum(bend) / count(*)::DOUBLE, 2) AS bend FROM bent GROUP BY ALL),
hi AS (SELECT s_suppkey, family, part, count(*) FILTER (q > mean + greatest(10, 1.2::DOUBLE * std)) / any_value(n)::DOUBLE AS highlight FROM sm JOIN st USING (s_suppkey, family, part) GROUP BY ALL),
pr AS (SELECT s_suppkey, part, CASE WHEN part IN ('top', 'bottom') THEN x ELSE y END AS pos, avg(q) AS v FROM sm WHERE family = 'edge' GROUP BY ALL),
mv AS (SELECT *, abs(v - sum(v) OVER (PARTITION BY s_suppkey, part ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) / 11::DOUBLE) AS off, v - lag(v) OVER (PARTITION BY s_suppkey, part ORDER BY pos) AS step FROM pr),
sd AS (SELECT s_suppkey, part, stddev_pop(step) AS rough, greatest(6, 1.5::DOUBLE * stddev_pop(off)) AS lim, count(*) AS len FROM mv GROUP BY ALL),
od AS (SELECT s_suppkey, part, count(*) FILTER (off > lim) / any_value(len)::DOUBLE AS odd FROM mv JOIN sd USING (s_suppkey, part) GROUP BY ALL)
SELECT s_suppkey, family, part, {rnd('mean', 6)} AS mean_intensity, {rnd('std', 6)} AS std_intensity, {rnd('highlight', 6)} AS highlight_ratio, {rnd("CASE WHEN family = 'edge' THEN rough ELSE bend END", 6)} AS roughness,
 CASE WHEN family = 'edge' THEN {rnd('odd', 6)} END AS anomaly_ratio, CASE WHEN family = 'edge' THEN len::DOUBLE END AS profile_length
FROM st JOIN hi USING (s_suppkey, family, part) LEFT JOIN sd USING (s_suppkey, part) LEFT JOIN od USING (s_suppkey, part)"""


add("card_parts", drawn_cards, _parts, _parts_sql())
