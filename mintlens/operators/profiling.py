"""Profiles of a data set and metrics of a binary classifier, as aggregations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_counts(df: DataFrame, column: str, n: int | None = None) -> DataFrame:
    """Values and how often they occur, the most frequent first, then by value; nulls are a value.  ``n``: the first so many."""
    out = df.groupBy(column).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), F.asc_nulls_first(column))
    return out.limit(n) if n else out


def counts_map(df: DataFrame, column: str) -> DataFrame:
    """The same as one row: counts, a map, for columns of few values, and nulls, how many have none."""
    one = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    entries = F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("value", "n"))))
    return one.agg(F.map_from_entries(entries).alias("counts"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("nulls"))


def percent(condition: Column) -> Column:
    """Share of the rows for which ``condition`` holds, in percent; null counts as not."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0)) * 100.0


def reason_counts(df: DataFrame, column: str = "invalid_reasons", n: int = 15) -> DataFrame:
    """The most frequent of bar-separated reasons."""
    one = df.select(F.explode(F.split(F.coalesce(F.col(column), F.lit("")), r"\|")).alias("reason")).select(F.trim("reason").alias("reason")).where("reason <> ''")
    return value_counts(one, "reason", n)


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """bin (from 0) and count over equal widths between the least and the greatest value, which falls into the last bin.

    Values that are null or no number do not count; equal extremes give one bin.  The extremes are one row.
    """
    x = df.select(F.col(column).try_cast("double").alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    ends = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / float(bins)
    placed = x.join(F.broadcast(ends)).select(F.when(width > 0, F.least(F.floor((F.col("x") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0).cast("bigint").alias("bin"))
    return placed.groupBy("bin").agg(F.count(F.lit(1)).alias("count"))


def confusion(df: DataFrame, truth: str = "y_true", predicted: str = "y_pred") -> DataFrame:
    """One row tn, fp, fn, tp; rows with another label or null count in none."""
    cell = lambda t, p: F.count_if((F.col(truth) == t) & (F.col(predicted) == p))
    return df.agg(cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _f1(p: Column, r: Column) -> Column:
    return F.coalesce(F.try_divide(2.0 * p * r, p + r), F.lit(0.0))


METRICS = ("accuracy", "balanced_accuracy", "precision", "recall", "f1")


def binary_metrics(counts: DataFrame) -> DataFrame:
    """accuracy, balanced_accuracy, precision, recall and f1 from ``confusion``; 0 where a denominator is 0."""
    return counts.select(*(c.alias(n) for n, c in _metrics().items()))


def _metrics() -> dict[str, Column]:
    tn, fp, fn, tp = map(F.col, ("tn", "fp", "fn", "tp"))
    p, r = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return {"accuracy": _ratio(tp + tn, tn + fp + fn + tp), "balanced_accuracy": (r + _ratio(tn, tn + fp)) / 2.0, "precision": p, "recall": r, "f1": _f1(p, r)}


def class_report(counts: DataFrame) -> DataFrame:
    """label, precision, recall, f1 and support of both classes, and their macro and weighted averages."""
    tn, fp, fn, tp = map(F.col, ("tn", "fp", "fn", "tp"))
    one = lambda name, hit, wrong, missed: F.struct(F.lit(name).alias("label"), _ratio(hit, hit + wrong).alias("precision"), _ratio(hit, hit + missed).alias("recall"), _f1(_ratio(hit, hit + wrong), _ratio(hit, hit + missed)).alias("f1"), (hit + missed).alias("support"))
    both = counts.select(one("0", tn, fn, fp).alias("a"), one("1", tp, fp, fn).alias("b"))
    mean = lambda k: (F.col("a")[k] + F.col("b")[k]) / 2.0
    rows = F.col("a.support") + F.col("b.support")
    weighted = lambda k: _ratio(F.col("a")[k] * F.col("a.support") + F.col("b")[k] * F.col("b.support"), rows)
    average = lambda name, f: F.struct(F.lit(name).alias("label"), *(f(k).alias(k) for k in ("precision", "recall", "f1")), rows.alias("support"))
    return both.select(F.inline(F.array(F.col("a"), F.col("b"), average("macro avg", mean), average("weighted avg", weighted))))


def ordered_hash(column: str, seed: int = 42) -> Column:
    """A shuffle that any engine can repeat: multiplication modulo a prime."""
    return F.pmod(F.pmod(F.col(column).cast("bigint"), F.lit(1000003)) * F.lit(2654435761) + F.lit(seed), F.lit(1000003))


def stratified(df: DataFrame, key: str, target: str, share: float = 0.8, folds: int = 5, seed: int = 42) -> DataFrame:
    """``df`` with split ("train" or "test") and fold, exact in proportion within each class.

    A class's rows are numbered within hash buckets first, and each bucket then starts where those before it end, so
    no task sorts a whole class.
    """
    d = df.withColumn("__h", ordered_hash(key, seed)).withColumn("__b", F.floor(F.col("__h") / 4096))
    sizes = d.groupBy(target, "__b").agg(F.count(F.lit(1)).alias("__n"))  # at most 245 buckets a class
    before = Window.partitionBy(target).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col(target).alias("__t"), F.col("__b").alias("__c"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__s"), F.sum("__n").over(Window.partitionBy(target)).alias("__all"))
    joined = d.join(starts, d[target].eqNullSafe(starts["__t"]) & d["__b"].eqNullSafe(starts["__c"]))
    rank = F.col("__s") + F.row_number().over(Window.partitionBy(target, "__b").orderBy("__h", key)) - 1
    out = joined.withColumn("__r", rank)
    return out.select(*df.columns, F.when(F.col("__r") < F.floor(F.col("__all") * share), "train").otherwise("test").alias("split"), (F.col("__r") % folds).cast("bigint").alias("fold"))


def choose_rows(df: DataFrame, target: str, strict: Column, loose: Column, least: int = 20) -> tuple[DataFrame, str]:
    """Rows that meet ``strict`` if both classes have ``least`` of them, else those of ``loose``; one aggregate decides."""
    known = df.where(F.col(target).isin(0, 1))
    n = known.agg(*(F.count_if(c & (F.col(target) == t)) for c in (strict, loose) for t in (0, 1))).first()
    if min(n[0], n[1]) >= least:
        return known.where(strict), "strict"
    if min(n[2], n[3]) > 0:
        return known.where(loose), "loose"
    raise ValueError("neither filter leaves rows of both classes")


#: Distinct values that one group's last step holds, and parts into which a pass divides a group's values.
HELD, PARTS = 1 << 16, 256


def quantiles(df: DataFrame, keys: Sequence[str], column: str, share: float, held: int = HELD) -> DataFrame:
    """``keys`` and ``quantile``: the exact quantile of each group, interpolated between neighbours; nulls don't count.

    No group's values gather in one buffer.  While a group has more than about ``held`` distinct values, a pass finds
    marks that divide them into PARTS (a sketch of bounded size), and the next one keeps what lies between the marks on
    either side of the rank and counts what lies below.  A third pass shrinks 10 billion values to a few thousand; of
    these the distinct ones are counted and walked.  A group without values gives no row; a null key is a group.
    """
    names = [f"__k{n}" for n in range(len(keys))]
    rows = df.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), F.col(column).cast("double").alias("__v")).where("__v is not null")
    rows = rows.select("*", *([F.lit(0).alias("__one")] if not names else []))
    names = names or ["__one"]
    at = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("__n"))
    at = at.select(*names, (F.lit(share) * (F.col("__n") - 1)).alias("__rank"), F.lit(0).cast("bigint").alias("__below"))
    on = reduce(lambda x, y: x & y, (F.col(n).eqNullSafe(F.col(f"{n}_")) for n in names))
    while True:
        marks = rows.groupBy(*names).agg(F.approx_count_distinct("__v").alias("__d"), F.count(F.lit(1)).alias("__m"), F.percentile_approx("__v", [k / PARTS for k in range(PARTS + 1)], 100 * PARTS).alias("__q")).persist()
        if (most := marks.agg(F.max("__d")).first()[0]) is None or most <= held:
            marks.unpersist()
            break
        both = marks.join(at.withColumnsRenamed({n: f"{n}_" for n in names}), on)
        place = lambda rows: (F.col("__rank") - F.col("__below") + rows) / F.col("__m") * PARTS
        # two marks and two rows to spare, as a mark may lie off by less than either
        low, high = F.floor(place(-2)).cast("int") - 2, F.ceil(place(3)).cast("int") + 2
        lo, hi = F.when(low > 0, F.get("__q", low)).otherwise(F.lit(float("-inf"))), F.when(high < PARTS, F.get("__q", high)).otherwise(F.lit(float("inf")))
        bounds = both.select(*(F.col(n).alias(f"{n}_") for n in names), lo.alias("__lo"), hi.alias("__hi"), "__rank", "__below")
        near = rows.join(bounds, on)
        at = near.groupBy(*names).agg(F.first("__rank").alias("__rank"), (F.first("__below") + F.count_if(F.col("__v") < F.col("__lo"))).alias("__below"))
        rows = near.where(F.col("__v").between(F.col("__lo"), F.col("__hi"))).select(*names, "__v")
    counts = rows.groupBy(*names, "__v").agg(F.count(F.lit(1)).alias("c"))
    listed = counts.groupBy(*names).agg(F.sort_array(F.collect_list(F.struct(F.col("__v").alias("v"), "c"))).alias("__l"))  # ``held`` entries, or about so many
    d = listed.join(at.withColumnsRenamed({n: f"{n}_" for n in names}), on)
    first, second = F.floor("__rank") - F.col("__below"), F.ceil("__rank") - F.col("__below")
    zero = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("double").alias("a"), F.lit(None).cast("double").alias("b"))

    def walk(s: Column, x: Column) -> Column:
        seen = s["seen"] + x["c"]
        return F.struct(seen.alias("seen"), F.when(s["a"].isNull() & (seen > first), x["v"]).otherwise(s["a"]).alias("a"), F.when(s["b"].isNull() & (seen > second), x["v"]).otherwise(s["b"]).alias("b"))

    d = d.withColumn("__w", F.aggregate("__l", zero, walk))
    out = F.col("__w.a") + (F.col("__rank") - F.floor("__rank")) * (F.col("__w.b") - F.col("__w.a"))
    return d.select(*(F.col(n).alias(k) for n, k in zip(names, keys, strict=False)), out.alias("quantile"))


def median_filled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls replaced by the column's exact median, as ``quantiles`` finds it; a column of nulls alone stays as it is."""
    medians = reduce(lambda a, b: a.unionByName(b), (quantiles(df, [], c, 0.5).select(F.lit(c).alias("c"), "quantile") for c in columns))
    one = medians.agg(*(F.max(F.when(F.col("c") == c, F.col("quantile"))).alias(f"__m_{c}") for c in columns))
    return df.join(F.broadcast(one)).withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"__m_{c}")) for c in columns}).select(*df.columns)


def validated(predictions: DataFrame, keys: Sequence[str] = ("model", "fold"), target: str = "target", predicted: str = "y_pred") -> DataFrame:
    """``keys`` and the five metrics of each group of stored predictions, from one aggregate; nulls in either class don't count."""
    hit = lambda t, y: F.count_if((F.col(target) == t) & (F.col(predicted) == y))
    counts = predictions.groupBy(*keys).agg(hit(0, 0).alias("tn"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(1, 1).alias("tp"))
    return counts.select(*keys, *(c.alias(n) for n, c in _metrics().items()))


def ranked_models(folds: DataFrame) -> DataFrame:
    """rank, model and the means over its folds of the five metrics of ``validated``: by f1, then recall, balanced accuracy and name.

    There are as many rows as models, so one task orders them.
    """
    means = folds.groupBy("model").agg(*(F.avg(m).alias(m) for m in METRICS))
    order = Window.orderBy(F.desc("f1"), F.desc("recall"), F.desc("balanced_accuracy"), "model")
    return means.select(F.row_number().over(order).alias("rank"), "model", *METRICS)
