"""Ranked matching, ordered de-duplication and lookups with defaults."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import edit_similarity, shared_prefix

#: Characters of the runs by which queries find names.
GRAM = 3
#: Columns of the catalogue and those of queries that ask for them.
ASKS = {"name": "q_name", "set_name": "q_set", "number": "q_number"}


def _low(x: Column) -> Column:
    return F.lower(F.trim(F.coalesce(x.cast("string"), F.lit(""))))


def candidate_score(name, set_name, number, query, query_set, query_number) -> Column:
    """10 for the query's name or 5 for one that contains it; 6 or 3 for the set; 6 or 3 for the number, contained either way.

    An empty number is contained in any, so a candidate without one scores 3 where a number is asked for.
    """
    name, set_name, number, query, query_set, query_number = map(_low, (name, set_name, number, query, query_set, query_number))
    by_name = F.when(name == query, 10).when((query != "") & F.contains(name, query), 5).otherwise(0)
    by_set = F.when(query_set == "", 0).when(set_name == query_set, 6).when(F.contains(set_name, query_set), 3).otherwise(0)
    by_number = F.when(query_number == "", 0).when(number == query_number, 6).when(F.contains(number, query_number) | F.contains(query_number, number), 3).otherwise(0)
    return by_name + by_set + by_number


def first_by(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each group under ``order``, as an aggregate that combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    numbered = [o.alias(f"o{k}") for k, o in enumerate(order)]
    best = df.groupBy(*keys).agg(F.min(F.struct(*numbered, F.struct(*rest).alias("row"))).alias("b"))
    return best.select(*keys, *(F.col("b.row")[c].alias(c) for c in rest))


def _ways(names: Sequence[str]) -> Column:
    """A row for each way to look at (name, set, number): ``way`` has bit 1 where the set counts and bit 2 where the number
    does; what doesn't count is empty.
    """
    name, group, number = names
    one = lambda way: F.struct(F.lit(way).alias("way"), F.col(name), (F.col(group) if way & 1 else F.lit("")).alias(group), (F.col(number) if way & 2 else F.lit("")).alias(number))
    return F.inline(F.array(*map(one, range(4))))


def best_candidate(queries: DataFrame, catalogue: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """For each query (query_id, q_name, q_set, q_number) the best catalogue row (id, name, set_name, number) whose name
    contains the query's, with the columns ``keep`` of that row; ties go to the smaller id.

    Equal queries are answered once, and of catalogue rows with equal name, set and number the first stands for all.  The
    best row is the best one that is found by name alone, by name and set, by name and number, or by all three: each way
    forms only pairs that score in all it looks at, and ``candidate_score`` with the rest left out is never too high and
    right in one of them.  Texts meet as in ``containing``.  All four ways share each join.
    """
    q = queries.select("query_id", *(_low(F.col(c)).alias(c) for c in ASKS.values())).where("q_name <> ''")
    row = F.struct("id", F.col("name").alias("shown"), *keep).alias("row")
    held = catalogue.select(row, *(_low(F.col(c)).alias(c) for c in ASKS)).groupBy(*ASKS).agg(F.min("row").alias("row"))
    first = held.select("row", _ways([*ASKS])).groupBy("way", *ASKS).agg(F.min("row").alias("row"))
    told = {c: F.col("way").bitwiseAND(bit) != 0 for c, bit in (("set_name", 1), ("number", 2))}
    asks = ["way", *ASKS.values()]
    all_ways = lambda df: df.select("query_id", _ways([*ASKS.values()])).where((~told["set_name"] | (F.col("q_set") != "")) & (~told["number"] | (F.col("q_number") != "")))

    def meet(c: str, both: bool = False) -> DataFrame:
        a, b, own, turned = F.col(ASKS[c]), _low(F.col(c)), F.lit(False).alias("turned"), F.lit(True).alias("turned")
        texts, names = q.select(own, a.alias("q_low")), catalogue.select(own, b.alias("low"))
        if both:  # the query's text may contain the row's too
            texts, names = texts.unionByName(catalogue.select(turned, b.alias("q_low"))), names.unionByName(q.select(turned, a.alias("low")))
        pick = lambda x, y: F.when(F.col("turned"), F.col(y)).otherwise(F.col(x)) if both else F.col(x)
        return containing(texts, names, ["turned"]).select(pick("q_low", "low").alias(ASKS[c]), pick("low", "q_low").alias(c))

    blank = q.select("q_number").where("q_number <> ''").withColumn("number", F.lit(""))  # contained in any number
    met = {"set_name": meet("set_name"), "number": meet("number", both=True).unionByName(blank).distinct()}
    pairs = all_ways(q).select(*asks).distinct().join(meet("name"), "q_name")
    for c, counts in told.items():  # what doesn't count meets nothing; dealt by its name, as it is one key for all
        dealt = pairs.withColumn("deal", F.when(counts, F.lit(0)).otherwise(F.hash("name")))
        pairs = dealt.join(met[c].withColumn("deal", F.lit(0)), [ASKS[c], "deal"], "left").where(~counts | F.col(c).isNotNull()).withColumn(c, F.coalesce(c, F.lit(""))).drop("deal")
    rows = pairs.join(first, ["way", *ASKS])
    best = rows.groupBy(*asks).agg(F.min(F.struct((-candidate_score(*map(F.col, (*ASKS, *ASKS.values())))).alias("order"), "row")).alias("b"))
    scored = all_ways(q.repartition("query_id")).join(best, asks).select("query_id", F.col("b.row.id").alias("id"), F.col("b.row.shown").alias("name"), (-F.col("b.order")).alias("score"), *(F.col("b.row")[c].alias(c) for c in keep))
    return first_by(scored, ["query_id"], -F.col("score"), F.col("id"))


def containing(queries: DataFrame, catalogue: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(q_low, low) for each distinct query q_low and name low that contains it; a blank query finds nothing.  Only those
    with equal columns ``by`` meet, which go before the texts.

    They meet by an equi-join on the query's rarest run of GRAM characters (all of them, if it is shorter), so a query
    that is part of a word is found and no pair without a common run is formed.
    """
    asked, names = queries.where("q_low <> ''").select(*by, "q_low").distinct(), catalogue.select(*by, "low").distinct()
    runs = lambda x, k: F.when(F.char_length(x) >= k, F.transform(F.sequence(F.lit(1), F.char_length(x) - k + 1), lambda i: F.col(x).substr(i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    held = names.select(*by, "low", F.explode(F.array_distinct(F.concat(*(runs("low", k) for k in range(1, GRAM + 1))))).alias("gram"))
    longest = F.coalesce(*(F.when(F.char_length("q_low") >= k, runs("q_low", k)) for k in range(GRAM, 0, -1)))
    sizes = held.groupBy(*by, "gram").agg(F.count(F.lit(1)).alias("m"))
    rarest = asked.select(*by, "q_low", F.explode(longest).alias("gram")).join(sizes, [*by, "gram"], "left").groupBy(*by, "q_low").agg(F.min_by("gram", F.struct(F.coalesce("m", F.lit(0)), "gram")).alias("gram"))
    return rarest.join(held, [*by, "gram"]).where(F.contains(F.col("low"), F.col("q_low"))).select(*by, "q_low", "low")


def _free(df: DataFrame, name: str) -> str:
    """``name``, with underscores put before it while the frame has such a column."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = "_" + name
    return name


def search(queries: DataFrame, catalogue: DataFrame, exact: bool = False) -> DataFrame:
    """Every catalogue row with each query (query_id, q_name) that its name contains, in either case, or equals if ``exact``.

    Queries are trimmed; blank and null ones find nothing.  Where the catalogue has a column ``query_id`` of its own, the
    query's is named with underscores before it.
    """
    asked, low = _free(catalogue, "query_id"), _free(catalogue, "__low")
    if exact:
        q = queries.select(F.col("query_id").alias(asked), F.trim("q_name").alias("name")).where("name <> ''")
        return q.join(catalogue, "name").select(asked, *catalogue.columns)
    q = queries.select(F.col("query_id").alias(asked), _low(F.col("q_name")).alias("q_low"))
    rows = catalogue.withColumn(low, _low(F.col("name")))
    pairs = containing(q, rows.select(F.col(low).alias("low"))).withColumnRenamed("low", low)
    return q.join(pairs, "q_low").drop("q_low").join(rows, low).select(asked, *catalogue.columns)


def listing(catalogue: DataFrame, *kinds: str) -> DataFrame:
    """kind, value and cards: the distinct values of each of the columns ``kinds`` (sets, series, rarities) in one pass."""
    one = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("value")) for k in kinds)))
    return catalogue.select(one.alias("x")).select("x.*").where("value is not null").groupBy("kind", "value").agg(F.count(F.lit(1)).alias("cards"))


def best_reading(df: DataFrame, by: Sequence[str], text: str = "text", confidence: str = "confidence", order: str = "n") -> DataFrame:
    """For each group the reading of greatest confidence, then share of letters, then fewest digits, then shortest; the first
    by ``order`` of equals.  Blanks don't count as length.
    """
    letters, digits, size = F.regexp_count(text, F.lit(r"\p{L}")), F.regexp_count(text, F.lit(r"\p{Nd}")), F.char_length(F.replace(F.col(text), F.lit(" "), F.lit("")))
    share = letters / F.greatest(size, F.lit(1))
    return first_by(df, list(by), -F.col(confidence), -share, digits, size, F.col(order))


def samples(df: DataFrame, condition: Column, columns: Sequence[str], n: int = 5) -> DataFrame:
    """The first ``n`` rows that meet ``condition``, by the columns shown."""
    return df.where(condition).select(*columns).orderBy(*columns).limit(n)


def fuzzy_rank(df: DataFrame, query: str, candidate: str, order: str, by: Sequence[str], similarity=edit_similarity) -> DataFrame:
    """``df`` with rank among the rows that share ``by``: similarity, common start and closeness in length, then ``order``."""
    gap = -F.abs(F.char_length(query) - F.char_length(candidate))
    w = Window.partitionBy(*by).orderBy(F.desc("similarity"), F.desc("prefix"), F.desc("gap"), order)
    return df.withColumns({"similarity": similarity(query, candidate), "prefix": shared_prefix(query, candidate), "gap": gap}).withColumn("rank", F.row_number().over(w))


def keep_first(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """One row for each key: the first under ``order``."""
    return first_by(df, list(keys), *map(F.col, order))


def union_first(parts: Sequence[DataFrame], key: str, order: str) -> DataFrame:
    """All rows of ``parts`` with equal keys dropped; earlier parts go before later ones, then ``order`` decides."""
    whole = None
    for n, part in enumerate(parts):
        part = part.withColumn("part", F.lit(n))
        whole = part if whole is None else whole.unionByName(part)
    return keep_first(whole, [key], "part", order)


def stop_early(df: DataFrame, order: str, enough: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Rows of the searches (numbered by ``order``) that began before the searches ahead of them had found ``enough``."""
    sizes = df.groupBy(*by, order).agg(F.count(F.lit(1)).alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begun = sizes.withColumn("ahead", ahead).where(F.col("ahead") < enough).select(*by, order)
    return df.join(begun, [*by, order], "left_semi")


def with_default(df: DataFrame, dimension: DataFrame, on: str, column: str, default) -> DataFrame:
    """``df`` with ``column`` of the dimension row of equal key, or ``default``; Catalyst broadcasts a small dimension."""
    return df.join(dimension.select(on, column), on, "left").withColumn(column, F.coalesce(F.col(column), F.lit(default)))


def detailed(df: DataFrame, detail: DataFrame, on: str, columns: Sequence[str]) -> DataFrame:
    """``df`` with the detail row's fields where it has them, else its own."""
    d = detail.select(on, *(F.col(c).alias(f"__d_{c}") for c in columns))
    return df.join(d, on, "left").withColumns({c: F.coalesce(f"__d_{c}", c) for c in columns}).drop(*(f"__d_{c}" for c in columns))


def richest_variant(variants: Column, preferred: Sequence[str]) -> Column:
    """Of a map variant -> (field -> value) the name of the variant with most values; of equals the first preferred one.

    Nulls and empty texts are no values.  A variant without any is still picked where no other is; null if none is there.
    """
    filled = lambda v: F.size(F.filter(F.map_values(v), lambda x: x.isNotNull() & (x.cast("string") != "")))
    zero = F.struct(F.lit(None).cast("string").alias("name"), F.lit(-1).alias("n"))

    def step(s: Column, p: Column) -> Column:
        n = F.when(F.element_at(variants, p).isNotNull(), filled(F.element_at(variants, p))).otherwise(-1)
        return F.when(n > s["n"], F.struct(p.alias("name"), n.alias("n"))).otherwise(s)

    return F.aggregate(F.array(*map(F.lit, preferred)), zero, step, lambda s: s["name"])
