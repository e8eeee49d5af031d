"""Expressions and operators at their limits, and known values."""

import math as m

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mintlens.config import Thresholds, parse_bool
from mintlens.functions import arrays, math, text
from mintlens.operators import flatten, modelling, pricing, profiling, ranking, rules, scoring


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_known_scores(spark):
    r = one(
        spark,
        edge=scoring.edge(F.lit(82.5), F.lit(0.78)), edge_raw=scoring.edge(F.lit(82.5), F.lit(0.78), None), corner=scoring.corner(F.lit(86.53), F.lit(0.438)),
        **{f"v2_{k}": c for k, c in scoring.condition("v2", [F.lit(8.2), F.lit(7.6), F.lit(8.02)], [F.lit(0.78)]).items()},
        **{f"v3_{k}": c for k, c in scoring.condition("v3", [F.lit(8.2), F.lit(7.6), F.lit(8.0), F.lit(7.69)], [F.lit(0.78), F.lit(0.438)]).items()},
        python=scoring.shown(F.lit(2.675), 2, "python"), floor=scoring.shown(F.lit(0.125), 2),
    )
    assert (r.edge, r.corner, r.v2_condition, r.v3_condition) == (8.02, 7.69, 8.03, 7.96) and r.edge_raw == pytest.approx(8.016625)
    assert (r.v2_weight_preliminary, r.v2_weight_centering, r.v2_weight_edge) == pytest.approx((0.5264, 0.20, 0.2736))
    assert (r.v3_weight_preliminary, r.v3_weight_edge, r.v3_weight_corner) == pytest.approx((0.46256, 0.1824, 0.15504))
    assert (r.python, r.floor) == (2.67, 0.13)


def test_weights_sum_to_one_and_scores_stay_in_range(spark):
    df = spark.range(200).select(*((F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1300)) / 100.0 - 1).alias(f"c{k}") for k in range(8)))
    for version, n in (("v1", 2), ("v2", 3), ("v3", 4), ("v4", 5)):
        c = scoring.condition(version, [F.col(f"c{k}") for k in range(n)], [F.col(f"c{k}") - 4 for k in range(5, 5 + n - 2)])
        got = df.select(c["condition"].alias("s"), sum((w for k, w in c.items() if k != "condition"), F.lit(0.0)).alias("w")).collect()
        assert all(1 <= r.s <= 10 and r.w == pytest.approx(1) for r in got)


def test_published_metrics(spark):
    r = profiling.binary_metrics(spark.createDataFrame([(151, 14, 22, 205)], "tn bigint, fp bigint, fn bigint, tp bigint")).first()
    assert tuple(r) == pytest.approx((0.9081632653, 0.9091176078, 0.9360730594, 0.9030837004, 0.9192825112))
    none = profiling.binary_metrics(spark.createDataFrame([(0, 0, 0, 0)], "tn bigint, fp bigint, fn bigint, tp bigint")).first()
    assert tuple(none) == (0, 0, 0, 0, 0)


def test_clamp_normalise_and_null_policies(spark):
    r = one(spark, a=math.clamp(F.lit(5.0), 0, 10), b=math.clamp(F.lit(15.0), 0, 10), c=math.span(F.lit(50.0), 0, 100), d=math.span(F.lit(150.0), 0, 100), e=math.span(F.lit(1.0), 5, 5), f=math.safe(F.lit(float("nan"))), g=math.safe(F.lit(float("-inf"))), h=math.safe(F.lit(None)), i=math.safe(F.lit("2.5")), j=math.quotient(F.lit(1.0), F.lit(1e-9)), k=math.balance(F.lit(0.0), F.lit(0.0)))
    assert tuple(r) == (5, 10, 0.5, 1, 0, 0, 0, 0, 2.5, 0, 0)


# one row a threshold: just below, on it and just above, with all else fine
FINE = {"used_fallback": False, "best_score": 0.9, "weak": False, "det_conf": 0.9, "coverage": 0.5, "blur": 300.0, "brightness": 150.0, "contrast": 60.0, "edge_conf": 0.9, "corner_conf": 0.9, "postwarp_valid": True, "postwarp_score": 0.9, "retry": False}
CASES = [
    ({}, "valid", ""),
    ({"coverage": 0.1499}, "invalid_capture", "low_coverage"),
    ({"coverage": 0.15}, "valid", ""),
    ({"coverage": 0.20}, "valid", ""),
    ({"coverage": 0.28}, "valid_with_warning", "borderline_low_coverage"),
    ({"coverage": 0.38}, "valid", ""),
    ({"coverage": 0.90}, "valid", ""),
    ({"coverage": 0.99}, "valid_with_warning", "borderline_high_coverage"),
    ({"coverage": 0.991}, "invalid_capture", "excessive_coverage"),
    ({"blur": 69.9}, "invalid_capture", "blurry_image"),
    ({"blur": 70.0}, "valid_with_warning", "moderate_blur"),
    ({"blur": 120.0}, "valid", ""),
    ({"brightness": 74.9}, "invalid_capture", "too_dark"),
    ({"brightness": 75.0}, "valid_with_warning", "suboptimal_dark_brightness"),
    ({"brightness": 210.0}, "valid", ""),
    ({"brightness": 235.0}, "valid_with_warning", "suboptimal_high_brightness"),
    ({"brightness": 235.1}, "invalid_capture", "too_bright"),
    ({"contrast": 19.9}, "invalid_capture", "low_contrast"),
    ({"contrast": 20.0}, "valid_with_warning", "suboptimal_contrast"),
    ({"edge_conf": 0.44}, "invalid_capture", "low_edge_confidence"),
    ({"edge_conf": 0.45}, "valid_with_warning", "moderate_edge_confidence"),
    ({"corner_conf": 0.44}, "invalid_capture", "low_corner_confidence"),
    ({"corner_conf": 0.59}, "valid_with_warning", "moderate_corner_confidence"),
    ({"det_conf": 0.45}, "valid_with_warning", "moderate_detection_confidence"),
    ({"det_conf": 0.40}, "valid", ""),
    ({"weak": True}, "valid_with_warning", "weak_detection"),
    ({"weak": True, "det_conf": 0.40}, "invalid_capture", "weak_detection"),
    ({"used_fallback": True}, "valid_with_warning", "fallback_used"),
    ({"used_fallback": True, "best_score": 0.49}, "invalid_capture", "fallback_detection"),
    ({"postwarp_valid": False, "postwarp_score": 0.44}, "invalid_capture", "invalid_postwarp"),
    ({"postwarp_valid": False, "postwarp_score": 0.45}, "valid_with_warning", "moderate_postwarp_score|weak_postwarp"),
    ({"retry": True}, "valid_with_warning", "weak_postwarp"),
    ({"blur": 10.0, "contrast": 25.0}, "invalid_capture", "blurry_image"),
    (dict.fromkeys(FINE), "invalid_capture", "blurry_image|invalid_postwarp|low_contrast|low_corner_confidence|low_coverage|low_edge_confidence|too_dark"),
]


def test_status_rules_on_both_sides_of_every_limit(spark):
    schema = ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'double'}" for k, v in FINE.items())
    df = spark.createDataFrame([tuple((FINE | c)[k] for k in FINE) for c, *_ in CASES], schema).coalesce(1)
    for (change, status, reasons), r in zip(CASES, rules.with_status(df).collect(), strict=True):
        assert (r.analysis_status, r.invalid_reasons, r.usable_for_condition_model) == (status, reasons, status == "valid"), change


def test_bands(spark):
    r = one(spark, a=rules.score_label(F.lit(9.0)), b=rules.score_label(F.lit(8.99)), c=rules.score_label(F.lit(5.5)), d=rules.score_label(F.lit(None).cast("double")), e=rules.condition_band(F.lit(9.5)), f=rules.condition_band(F.lit(2.9)), g=rules.part_label(F.lit(70.0)), h=rules.damped(F.lit(100.0), F.lit(0.19)), i=rules.context_factor(F.lit(True), F.lit(0.39)))
    assert tuple(r) == ("Excelente", "Muy buena", "Mejorable", "Sin evaluacion", "mint", "damaged", "acceptable", 85, pytest.approx(0.912))


def test_flatten_and_model_inputs(spark):
    df = spark.sql("select 1 as id, named_struct('b', 2.0D, 'c', named_struct('d', true, 'e', array(1))) as a, map('x', 1) as m, binary('z') as z, 5 as a_b")
    flat = flatten.flatten(df)
    assert flat.columns == ["id", "a_b", "a_c_d"] and flat.first().a_b == 5
    r = flatten.model_inputs(spark.sql("select double('nan') as a, true as b, 'x' as c, cast(null as int) as d"), ["a", "b", "c", "d", "e"]).first()
    assert tuple(r) == (0, 1, 0, 0, 0)
    assert flatten.prefixed(spark.sql("select named_struct('blur', 3, 'label', 'x') as visual")).first().asDict() == {"visual_blur": 3.0}
    assert flatten.leading_first(spark.sql("select 1 as zz, 2 as image_id")).columns == ["image_id", "zz"]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(-100, 100), max_size=40))
def test_array_expressions(spark, values):
    df = spark.createDataFrame([(values,)], "a array<double>")
    r = df.select(arrays.mean("a").alias("mean"), arrays.moving_average("a").alias("ma"), arrays.longest_run("a", 0.5).alias("run"), arrays.differences("a").alias("diff"), arrays.argmax("a").alias("top")).first()
    if not values:
        assert r.mean is None and r.ma == [] and r.run == 0 and r.diff == []
        return
    assert r.mean == pytest.approx(sum(values) / len(values), abs=1e-9)
    assert r.ma == pytest.approx([sum(values[max(0, k - 5) : k + 6]) / 11 for k in range(len(values))], abs=1e-9)
    assert r.diff == [b - a for a, b in zip(values, values[1:])] and values[r.top] == max(values)
    best = now = 0
    for v in values:
        now = now + 1 if v > 0.5 else 0
        best = max(best, now)
    assert r.run == best


def test_text(spark):
    names = [("Pikachu", True), ("ab", False), ("HP", False), ("a1234", False), ("Mew 2", True), ("pokémon", False), (None, False)]
    got = spark.createDataFrame([(a,) for a, _ in names], "a string").coalesce(1).select(text.usable_name("a").alias("u")).collect()
    assert [r.u for r in got] == [b for _, b in names]
    r = one(spark, a=text.normal_name(F.lit("  Flabébé-X!! ")), b=text.normal_name(F.lit("Ångström ﬁ"), exact=True), c=text.search_queries(F.lit("charizard vmax gold")), d=text.search_queries(F.lit("mew")), e=text.shared_prefix(F.lit("pika"), F.lit("pikachu")), f=text.joined_reasons(F.lit("b"), F.lit(None), F.lit("a"), F.lit("b")), g=text.clean_scan(F.lit("BASIC Pikachu a 12 HP 60")), h=text.safe_confidence(F.lit("1.7")), i=text.safe_confidence(F.lit("x")), j=text.first_number(F.lit("true"), F.lit("3")))
    assert (r.a, r.b, r.d, r.e, r.f, r.g, r.h, r.i, r.j) == ("flabebe x", "angstrom fi", [], 4, "a|b", "Pikachu", 1.0, None, 3.0)
    assert r.c == ["charizard vmax gold", "charizard", "charizar", "chariza", "chariz", "chari", "charizard vmax"]
    v = one(spark, a=text.field(text.json_object(F.lit('```json\n{"name": "x"} ok')), "$.other", "$.name"), b=text.json_object(F.lit("none")))
    assert v.a == "x" and v.b is None


def test_ranking(spark):
    r = one(spark, a=ranking.candidate_score(F.lit("Mew"), F.lit("Base"), F.lit(""), F.lit("mew"), F.lit("ba"), F.lit("7")), b=ranking.candidate_score(F.lit("Mewtwo"), F.lit(None), F.lit("17"), F.lit("mew"), F.lit(""), F.lit("7")))
    assert (r.a, r.b) == (10 + 3 + 3, 5 + 3)
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 5, "c")], "k int, o int, v string")
    assert sorted((r.k, r.v) for r in ranking.keep_first(df, ["k"], "o").collect()) == [(1, "a"), (2, "c")]
    steps = spark.createDataFrame([(q, n) for q, size in ((0, 6), (1, 5), (2, 3)) for n in range(size)], "q int, n int")
    assert {r.q for r in ranking.stop_early(steps, "q").collect()} == {0, 1}


def test_prices(spark):
    r = one(spark, **pricing.price_base([F.lit(None).cast("double")], [F.lit(2.0)], F.lit(20.0)), **{f"p_{k}": c for k, c in pricing.priced(F.lit(10.0), F.lit(8.5)).items()})
    assert (r.base_price, r.base_currency, r.p_band, r.p_sale_price, r.p_buy_price) == (40.0, "MXN", "near_mint", 9.5, 7.125)


def test_histogram_and_counts(spark):
    df = spark.createDataFrame([(float(k),) for k in range(61)] + [(None,), (float("nan"),)], "x double")
    got = {r.bin: r["count"] for r in profiling.histogram(df, "x").collect()}
    assert sum(got.values()) == 61 and got[29] == 3 and max(got) == 29
    assert {r.bin: r["count"] for r in profiling.histogram(spark.createDataFrame([(2.0,), (2.0,)], "x double"), "x").collect()} == {0: 2}
    assert profiling.histogram(df.limit(0), "x").count() == 0
    words = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "w string")
    assert [tuple(r) for r in profiling.value_counts(words, "w").collect()] == [("b", 2), (None, 1), ("a", 1)]


def test_split_is_stratified(spark):
    df = spark.range(1000).withColumn("y", (F.col("id") % 4 == 0).cast("int"))
    got = profiling.stratified(df, "id", "y").groupBy("y", "split").count().collect()
    assert {(r.y, r.split): r["count"] for r in got} == {(0, "train"): 600, (0, "test"): 150, (1, "train"): 200, (1, "test"): 50}


def test_models(spark, tmp_path):
    df = spark.range(300).select("id", ((F.col("id") * 37) % 100).cast("double").alias("a"), F.when(F.col("id") % 7 != 0, (F.col("id") % 5).cast("double")).alias("b")).withColumn("target_damaged", (F.col("a") > 50).cast("int"))
    small = {"linear": {"maxIter": 20}, "forest": {"numTrees": 5, "maxDepth": 3}, "boosting": {"maxIter": 3, "maxDepth": 2}}
    ranked = modelling.cross_validated(df, "id", ["a", "b"], small, folds=2).collect()
    assert {r.model for r in ranked} == set(small) and all(r.f1 > 0.9 for r in ranked)
    weighted = modelling.balanced(df, "target_damaged")
    model = modelling.pipeline("forest", ["a", "b"], weight="weight", numTrees=5).fit(weighted)
    got = modelling.predict(model, df)
    modelling.save(model, modelling.evaluate(got), ["a", "b"], str(tmp_path / "m"))
    again, names = modelling.load(spark, str(tmp_path / "m"))
    assert names == ["a", "b"] and modelling.predict(again, df).where("y_pred = target_damaged").count() > 290


def test_stream_of_captures(spark, tmp_path):
    from mintlens.plans.proxies import captures
    from mintlens.streaming.captures import status_counts

    rows = captures(spark, "/root/testdata/sf0.001").withColumn("ts", F.timestamp_seconds(F.col("l_orderkey")))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = status_counts(stream).writeStream.format("memory").queryName("status").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("status").agg(F.sum("count")).first()[0] == 6000


def test_settings():
    t = Thresholds.from_env({"MINTLENS_BLUR_LOW": " 80 ", "MINTLENS_FALLBACK_BEST": "7", "MINTLENS_DARK": "x"})
    assert (t.blur_low, t.fallback_best, t.dark) == (80.0, 1.0, 75.0)
    assert parse_bool("Yes", False) and not parse_bool("off", True) and parse_bool("?", True)
    assert m.isclose(Thresholds().weak_confidence, 0.45)


def test_split_takes_large_and_null_keys(spark):
    from mintlens.operators.profiling import stratified

    keys = [5_000_000_000, 2**62, -3, 0, None, None, *range(1, 40)]
    df = spark.createDataFrame([(k, n % 2) for n, k in enumerate(keys)], "k bigint, t int")
    rows = stratified(df, "k", "t").collect()
    assert len(rows) == len(keys) and {r.fold for r in rows} == set(range(5)) and sum(r.split == "train" for r in rows) == int(23 * 0.8) + int(22 * 0.8)


def test_names_strip_the_whole_root(spark):
    from mintlens.sources.images import with_names

    for root, path in (("/data/cards/x/cards", "file:/data/cards/x/cards/Ok/a.b.png"), ("file:///d.(1)/cards/", "file:///d.(1)/cards/Ok/a.b.png"), ("viewfs://store/in/cards", "viewfs://store/in/cards/Ok/a.b.png"), ("cards", "file:/home/cards/Ok/a.b.png")):
        r = with_names(spark.createDataFrame([(path,)], "path string"), root).first()
        assert (r.relative_path, r.label, r.image_filename, r.image_id) == ("Ok/a.b.png", "ok", "a.b.png", "a.b")


def test_counts_as_a_map_keep_nulls(spark):
    from mintlens.operators import profiling

    told = profiling.counts_map(spark.createDataFrame([("a",), (None,), ("a",), ("null",)], "x string"), "x").first()
    assert told.counts == {"a": 2, "null": 1} and told.nulls == 1
    assert tuple(profiling.counts_map(spark.createDataFrame([], "x int"), "x").first()) == ({}, 0)


def test_the_richest_variant_may_be_unfilled(spark):
    from mintlens.operators import ranking

    rows = [({"holo": {"a": None}},), ({"holo": {"a": " "}, "plain": {"a": ""}},), ({"foil": {"a": "1"}},), ({},), (None,)]
    d = spark.createDataFrame(rows, "v map<string,map<string,string>>").select(ranking.richest_variant(F.col("v"), ["plain", "holo"]).alias("n"))
    assert [r.n for r in d.collect()] == ["holo", "holo", None, None, None]


def test_sinks_tell_what_failed(spark, tmp_path):
    from mintlens.sources import sinks
    from mintlens.sources.images import predictions

    d = spark.createDataFrame([(1, 0, 0.25), (0, 1, 0.75)], "y_true int, y_pred int, y_prob_damaged double")
    done = sinks.write(d.withColumn("x", F.array("y_true")), str(tmp_path / "a"), ("csv", "parquet", "json", "xlsx"))
    assert done["csv"].startswith("failed: ") and spark.read.parquet(done["parquet"]).count() == 2 and spark.read.json(done["json"]).count() == 2 and done["xlsx"].startswith("not available")
    done = sinks.write(d, str(tmp_path / "b"), ("csv",))
    assert sorted(map(tuple, predictions(spark, done["csv"]).collect())) == [(0, 1, 0.75), (1, 0, 0.25)]
    assert sinks.write(d, str(tmp_path / "b"), ("csv",))["csv"].startswith("failed: ")  # it is there already


def test_an_amount_meets_the_latest_live_rate(spark):
    from mintlens.streaming import captures

    rates = spark.sql("select * from values ('EUR', 'USD', 1.0D, timestamp '2024-01-01 00:00:00'), ('EUR', 'USD', 2.0D, timestamp '2024-01-01 01:00:00'), ('EUR', 'USD', 3.0D, timestamp '2024-01-01 01:00:00'), ('EUR', 'MXN', 9.0D, timestamp '2024-01-01 00:00:00') t(base, target, rate, fetched_at)")
    amounts = spark.sql("select * from values (1.0D, 'EUR', timestamp '2024-01-01 00:30:00'), (2.0D, 'EUR', timestamp '2024-01-01 01:00:00'), (4.0D, 'EUR', timestamp '2024-01-01 06:30:00'), (8.0D, 'EUR', timestamp '2024-01-01 07:00:00') t(amount, currency, ts)")
    got = sorted((r.amount, r.target, r.value) for r in captures.with_rates(amounts, rates).collect())
    assert got == [(1.0, "MXN", 9.0), (1.0, "USD", 1.0), (2.0, "MXN", 18.0), (2.0, "USD", 6.0), (4.0, "USD", 12.0)]


def test_a_model_that_is_missing_has_a_reason(spark, tmp_path):
    from mintlens.operators import modelling

    rows = spark.createDataFrame([(k, float(k % 10), float(k % 3), int(k % 10 > 4)) for k in range(60)], "id int, a double, b double, target_damaged int")
    path = str(tmp_path / "best")
    gone = modelling.predict_if_available(rows, path).first()
    assert not gone.available and gone.reason and gone.y_pred is None
    table = modelling.train_best(rows, "id", ["a", "b"], {"small": {"kind": "linear", "maxIter": 0}, "linear": {"maxIter": 20}}, path, folds=2)
    assert table.first().model == "linear" and table.count() == 2
    found = modelling.predict_if_available(rows.drop("b"), path)
    assert found.where("available and reason is null").count() == 60 and found.where("y_pred = target_damaged").count() == 60


def test_peaks_and_boxes_at_their_edges(spark):
    from mintlens.functions import arrays
    from mintlens.operators import candidates as c

    d = spark.sql("select * from values (array(0D, 3D, 2D, 3D, -1D)), (array(-1D, 0D)), (cast(array() as array<double>)), (null) t(p)")
    assert [r.k for r in d.select(arrays.peaks("p", 3, 1).alias("k")).collect()] == [[1, 3], [], [], None]
    one = spark.range(1)
    none = (F.lit(None).cast("double"),) * 4
    box = tuple(F.lit(float(x)) for x in (100, 100, 400, 520))
    got = one.select(c.plausible_outer_box(box, F.lit(600.0), F.lit(800.0)), c.chosen_box(none, none, F.lit(600.0), F.lit(800.0), F.lit(0.0), F.lit(0.0)), c.first_box(a=none, b=box)["source"], c.first_box(a=none)["box"], c.fallback_box(F.lit(80.0), F.lit(100.0))["box"]).first()
    assert list(got) == [True, "none", "b", None, [16.0, 16.0, 64.0, 84.0]]


def test_quantiles_of_large_and_odd_groups(spark):
    import numpy as np

    rng = np.random.default_rng(8)
    groups = {"many": rng.normal(0, 1e6, 3000), "ties": np.repeat([1.0, 2.0, 2.5], [400, 500, 100]), "wide": np.exp(rng.uniform(-300, 300, 2000)), "one": np.array([7.0]), None: np.arange(50.0)}
    df = spark.createDataFrame([(k, float(x)) for k, v in groups.items() for x in v] + [("many", None), ("empty", None)], "k string, x double")
    for held in (profiling.HELD, 40):  # the second takes several passes
        for share in (0.0, 0.25, 0.5, 0.9, 1.0):
            got = {r.k: r.quantile for r in profiling.quantiles(df, ["k"], "x", share, held).collect()}
            assert set(got) == set(groups) and all(got[k] == pytest.approx(np.quantile(v, share), rel=1e-12) for k, v in groups.items())
    assert profiling.quantiles(df.where("false"), ["k"], "x", 0.5).count() == 0
    big = spark.range(10_000_000).select(F.lit("g").alias("k"), (F.pmod(F.col("id") * 7919, F.lit(10_000_000)) / 4.0).alias("x"))
    q = profiling.quantiles(big, ["k"], "x", 0.9)
    assert q.first().quantile == pytest.approx(0.9 * 9_999_999 / 4.0, rel=1e-12) and "percentile(" not in q._jdf.queryExecution().optimizedPlan().toString()


def test_median_fill_leaves_a_column_of_nulls(spark):
    df = spark.createDataFrame([(1, None, None), (2, 3.0, None), (3, 5.0, None)], "id int, a double, b double")
    assert sorted(map(tuple, profiling.median_filled(df, ["a", "b"]).collect())) == [(1, 4.0, None), (2, 3.0, None), (3, 5.0, None)]


def test_search_leaves_columns_of_the_catalogue(spark):
    rows = spark.createDataFrame([(1, "Mewtwo", 7, 9, "s"), (2, "Abra", 8, 9, "t")], "id int, name string, low int, query_id int, q_low string")
    asked = spark.createDataFrame([(5, "mew"), (6, "Abra")], "query_id int, q_name string")
    got = {tuple(r) for r in ranking.search(asked, rows).collect()}
    assert got == {(5, 1, "Mewtwo", 7, 9, "s"), (6, 2, "Abra", 8, 9, "t")} and ranking.search(asked, rows).columns[0] == "_query_id"
    assert {tuple(r) for r in ranking.search(asked, rows, exact=True).collect()} == {(6, 2, "Abra", 8, 9, "t")}


def test_metrics_of_all_folds_in_one_aggregate(spark):
    rows = [("a", f, t, t if (f + n) % 4 else 1 - t) for f in range(3) for n in range(12) for t in (0, 1)] + [("b", f, t, 1) for f in range(3) for t in (0, 1, 1)] + [("b", 0, None, 1)]
    folds = profiling.validated(spark.createDataFrame(rows, "model string, fold int, target int, y_pred int"))
    got = {(r.model, r.fold): r for r in folds.collect()}
    assert len(got) == 6 and got["b", 0].recall == 1 and got["b", 0].precision == pytest.approx(2 / 3) and got["b", 0].balanced_accuracy == 0.5 and got["a", 1].accuracy == pytest.approx(0.75)
    assert [(r["rank"], r.model) for r in profiling.ranked_models(folds).orderBy("rank").collect()] == [(1, "b"), (2, "a")]
