"""Work that must not grow faster than the input, or be done over for every use."""

import math

from pyspark.sql import functions as F


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def most_joined(df):
    """Rows that the largest join of ``df`` gave when it ran."""
    df.collect()
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        p = todo.pop()
        kind = lambda: p.getClass().getSimpleName()  # noqa: B023,E731
        if kind() == "AdaptiveSparkPlanExec":
            p = p.executedPlan()
        while kind().endswith("QueryStageExec"):
            p = p.plan()
        if kind().endswith("JoinExec"):
            most = max(most, p.metrics().apply("numOutputRows").value())
        todo += [p.children().apply(k) for k in range(p.children().size())]
    return most


def test_prices_are_parsed_once(spark):
    from mintlens.operators import pricing

    df = spark.createDataFrame([('{"cardmarket": {"normal": {"trend": 1}, "holo": {"trend": 2, "low": 3}}, "tcgplayer": {"marketPrice": "4"}}',)], "p string")
    out = df.select(*(c.alias(m) for m, c in pricing.market_prices(F.col("p")).items()))
    assert plan(out).count("from_json(") <= 4  # a market's block and its variants, for each of two markets
    r = out.first()
    assert r.cardmarket.asDict() == {"currency": "EUR", "trend": 2.0, "avg7": None, "avg30": None, "low": 3.0} and r.tcgplayer.marketPrice == 4.0


def test_deviations_of_a_profile_are_computed_once(spark):
    from mintlens.functions import arrays

    p = [float(k % 7) for k in range(1500)]
    df = spark.createDataFrame([(p,), ([],), (None,)], "p array<double>")
    m = sum(p) / len(p)
    limit = max(0.05, m + 1.2 * math.sqrt(sum((x - m) ** 2 for x in p) / len(p)))
    out = df.select(arrays.share_above("p", arrays.adaptive_limit("p", 0.05, 1.2)).alias("share"), arrays.deviation("p").alias("d"))
    assert plan(df.select(arrays.share_above("p", arrays.adaptive_limit("p", 0.05, 1.2)).alias("x"))).count("aggregate(") <= 3
    rows = out.collect()
    assert rows[0].share == sum(x > limit for x in p) / len(p) and [tuple(r) for r in rows[1:]] == [(None, None)] * 2
    padded = plan(df.select(arrays.residual("p").alias("x")))
    assert padded.count("concat(") <= 1  # the zeros beyond the ends are put there once, not for every element


def test_best_candidate_forms_no_pairs_of_equal_names(spark):
    from mintlens.operators import ranking

    names, sets, numbers = ["mew", "Mewtwo", "mew ex"], ["base", "base 2", None, "jungle"], ["1", "12", "", "7"]
    n = 3000
    rows = spark.range(n).select(
        F.col("id").cast("int").alias("id"), F.get(F.array(*map(F.lit, names)), (F.col("id") % 3).cast("int")).alias("name"),
        F.get(F.array(*map(F.lit, sets)), (F.col("id") % 4).cast("int")).alias("set_name"), F.get(F.array(*map(F.lit, numbers)), (F.col("id") % 5 % 4).cast("int")).alias("number"),
    )
    queries = rows.select(
        F.col("id").alias("query_id"), F.when(F.col("id") % 11 == 0, "two").otherwise(F.concat(F.lit(" "), "name")).alias("q_name"), F.when(F.col("id") % 2 == 0, F.upper("set_name")).otherwise("").alias("q_set"),
        F.when(F.col("id") % 3 == 0, F.get(F.array(F.lit("1"), F.lit("2"), F.lit("127"), F.lit("x")), (F.col("id") % 7 % 4).cast("int"))).alias("q_number"),
    )
    # every pair scored, in plain Spark over one row of each kind
    kinds = rows.groupBy("name", "set_name", "number").agg(F.min("id").alias("id"))
    pairs = queries.crossJoin(kinds).where("contains(lower(name), lower(trim(q_name)))")
    want = pairs.select("query_id", "id", ranking.candidate_score(*(F.col(c) for c in ("name", "set_name", "number", "q_name", "q_set", "q_number"))).alias("score")).groupBy("query_id").agg(F.min(F.struct(-F.col("score"), "id")).alias("b"))
    got = ranking.best_candidate(queries, rows)
    assert {r.query_id: (-r.score, r.id) for r in got.collect()} == {r.query_id: tuple(r.b) for r in want.collect()}
    assert 0 < most_joined(got) <= 2 * n  # all pairs of equal names would be n * n / 3


def test_batch_inference_forms_no_pairs_of_equal_names(spark):
    from mintlens.plans import catalogue

    df = catalogue.QUERIES["batch_inference"](spark, "/root/testdata/sf0.01")
    assert 0 < most_joined(df) <= 2 * 2000  # 64 names, so all pairs would be some 62,500
    assert df.count() == 2000


def test_candidate_winners_shuffle_a_few_numbers_of_a_row(spark):
    import __spark_entry__ as entry

    df = entry.queries()["candidate_winners"](spark, "/root/testdata/sf0.001")
    text = df._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning(") == 1  # both aggregates run where the rows lie
    moved = next(line for line in plan(df).split("RepartitionByExpression")[1].splitlines()[1:] if line.strip())
    assert "near_" not in moved and "drawn_" not in moved and "l_quantity" in moved


def test_cards_are_drawn_and_measured_by_many_tasks(spark):
    from mintlens.plans import detection

    drawn = detection.drawn_cards(spark, "/root/testdata/sf0.1")
    sizes = drawn.select(F.spark_partition_id().alias("k")).groupBy("k").count().collect()
    assert len(sizes) > 48 and max(r["count"] for r in sizes) < 100  # of 1,000 suppliers in one small file


def test_batch_inference_takes_prices_from_the_rows_that_it_found(spark):
    from mintlens.operators import ranking
    from mintlens.plans import catalogue

    df = catalogue.QUERIES["batch_inference"](spark, "/root/testdata/sf0.01")
    assert plan(df).count("Relation [") <= 24  # all ways to score share their joins, and no join of queries with prices by a few ids follows
    rows = spark.createDataFrame([(2, "Mew", "base", "7", 2.5), (1, "mew ex", "base", "", 1.5), (3, "abra", None, None, None)], "id int, name string, set_name string, number string, price double")
    queries = spark.createDataFrame([(1, "mew", "", ""), (2, "ew", "BASE", "17"), (3, "ab", "x", "y"), (4, "w e", None, None), (5, "zz", "base", "7")], "query_id int, q_name string, q_set string, q_number string")
    got = ranking.best_candidate(queries, rows, ["price"]).collect()
    assert sorted(map(tuple, got)) == [(1, 2, "Mew", 10, 2.5), (2, 1, "mew ex", 14, 1.5), (3, 3, "abra", 8, None), (4, 1, "mew ex", 5, 1.5)]


def test_candidate_rules_measure_a_quad_once_in_compiled_code(spark):
    from mintlens.functions import text
    from mintlens.plans import catalogue

    df = catalogue.QUERIES["candidate_rules"](spark, "/root/testdata/sf0.001")
    p = plan(df)
    assert "lambda" not in p and p.count("SQRT(") == 5  # four sides and one distance; 99 when every rule measured its quad again
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000  # larger methods are never compiled
    flags = spark.createDataFrame([(True, True, None), (False, True, True), (None, False, False)], "b boolean, a boolean, c boolean")
    named = {n: F.col(n) for n in ("b", "a", "c")}
    rows = flags.select(text.named_reasons(named).alias("x"), text.joined_reasons(*(F.when(c, n) for n, c in named.items())).alias("y")).collect()
    assert [tuple(r) for r in rows] == [("a|b",) * 2, ("a|c",) * 2, ("",) * 2]
