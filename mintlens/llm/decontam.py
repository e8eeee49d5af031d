"""Benchmark decontamination by containment search with size-partitioned MinHash (native: DataFrame functions only).

A test item is short and a document may be long, so the Jaccard similarity of the two says nothing, and equal minima
of both would miss long documents.  The search is therefore one-sided: an item's sketch holds its shingles of least
hash, and a document is a candidate if it contains one of them.  Items are partitioned by size: an item of q shingles
keeps q - ceil(threshold q) + 1 minima, so a document that contains enough of the item contains one at least, and a
document probes only the sizes that it can hold.  Candidates are verified by their exact shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, same, small, stored

SHINGLE_WORDS, THRESHOLD = 5, 0.8


def words(text: Column) -> Column:
    """Runs of letters and digits, in lower case; the first or last may be empty where other signs lead or trail."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")


def _bounds(w: Column) -> tuple[Column, Column]:
    """Index of the first word that is not empty, and the number of such words."""
    head = F.when(F.get(w, F.lit(0)) == "", 1).otherwise(0)
    tail = F.when((F.size(w) > 1) & (F.element_at(w, -1) == ""), 1).otherwise(0)
    return head, F.size(w) - head - tail


def _shingles(df: DataFrame, size: int, make) -> Column:
    """An array over the columns w, head, n of ``df``: ``make`` of the positions of each shingle's words."""
    long = F.transform(F.sequence(F.col("head"), F.col("head") + F.col("n") - size), lambda i: make([F.get(F.col("w"), i + k) for k in range(size)]))
    # fewer words than a shingle has: all of them are the one shingle
    few = [F.when(F.col("n") > k, F.get(F.col("w"), F.col("head") + k)) for k in range(size - 1)]
    return F.when(F.col("n") >= size, long).when(F.col("n") > 0, F.array(make(few))).otherwise(F.array().cast(df.sparkSession.range(0).select(F.array(make([F.lit("")] * size))).schema[0].dataType))


def split_words(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with w (words of ``text``), head and n in place of ``text``."""
    d = df.withColumn("w", words(F.col(text))).drop(text)
    head, n = _bounds(F.col("w"))
    return d.withColumn("head", head).withColumn("n", n)


def hashed(df: DataFrame, size: int) -> Column:
    return _shingles(df, size, lambda x: F.xxhash64(*x))


def spelt(df: DataFrame, size: int) -> Column:
    return F.array_distinct(_shingles(df, size, lambda x: F.concat_ws(" ", *x)))


def sketches(items: DataFrame, size: int, threshold: float) -> DataFrame:
    """item, h, need: the minima of every item, and the shingles that a document must have to hold the item.

    Shingles that few items share come first and the hash decides among them, so a passage that all items quote
    does not make every document that quotes it a candidate for all of them.
    """
    d = split_words(items, "text")
    one = d.select("item", F.explode(F.array_distinct(hashed(d, size))).alias("h"))
    spread = one.groupBy("h").agg(F.count(F.lit(1)).alias("items"))
    order = F.sort_array(F.collect_list(F.struct("items", "h")))  # one item's shingles
    kept = one.join(spread, "h").groupBy("item").agg(order.alias("all"))
    need = F.ceil(F.size("all") * F.lit(threshold) - 1e-9).cast("int")
    return kept.select("item", need.alias("need"), F.explode(F.slice("all", F.lit(1), F.size("all") - need + 1)["h"]).alias("h"))


def held(docs: DataFrame, benchmark: DataFrame, size: int = SHINGLE_WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, mark (hash of the text), item_id, n_shared, n_item and containment of every row that holds ``threshold`` of an item's shingles."""
    items = benchmark.select("item_id", F.xxhash64("item_id", "text").alias("item"), "text").dropDuplicates(["item_id", "text"])
    sketch = stored(sketches(items.select("item", "text"), size, threshold))
    d = split_words(docs.select("doc_id", F.xxhash64("text").alias("mark"), "text"))
    seen = d.select("doc_id", "mark", F.greatest(F.col("n") - size + 1, F.least("n", F.lit(1))).alias("held"), F.explode(hashed(d, size)).alias("h"))
    found = stored(seen.join(sketch, (seen["h"] == sketch["h"]) & (seen["held"] >= sketch["need"])).select(F.col("doc_id").alias("id"), F.col("mark").alias("m"), "item").distinct())

    texts = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    pairs = texts.join(found, same(texts, found, {"doc_id": "id", "mark": "m"})).select("doc_id", "mark", "item", "text")
    p = split_words(pairs)
    p = p.select("doc_id", "mark", "item", spelt(p, size).alias("s"))
    i = split_words(items)
    i = i.select("item", "item_id", spelt(i, size).alias("t"))
    both = p.join(i, "item").select("doc_id", "mark", "item_id", F.size(F.array_intersect("s", "t")).cast("bigint").alias("n_shared"), F.size("t").cast("bigint").alias("n_item"))
    return both.where(F.col("n_shared") >= F.ceil(F.col("n_item") * F.lit(threshold) - 1e-9)).withColumn("containment", F.col("n_shared") / F.col("n_item"))


def leaks(docs: DataFrame, benchmark: DataFrame, size: int = SHINGLE_WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, containment, n_shared and n_item for every document that holds ``threshold`` of an item's shingles.

    Shingles are distinct runs of ``size`` words, or all words of a shorter text; texts without words, nulls among
    them, hold nothing and are held by nothing.  Rows that repeat a doc_id or an item_id give one row a pair of ids,
    that of the largest containment (then the larger item).  Null ids are kept as an id.  Empty tables give an empty
    result; other columns are ignored.  The sketches are broadcast only if their table is below Spark's threshold.
    """
    both = held(docs, benchmark, size, threshold)
    best = both.groupBy("doc_id", "item_id").agg(F.max(F.struct("containment", "n_item", "n_shared")).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.containment").alias("containment"), F.col("b.n_shared").alias("n_shared"), F.col("b.n_item").alias("n_item"))


def clean(docs: DataFrame, benchmark: DataFrame, size: int = SHINGLE_WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text holds no item; columns as they were.

    A row goes by its id and its text, so rows that share an id, null among them, are judged each by its own text.
    """
    bad = small(stored(held(docs, benchmark, size, threshold).select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")).distinct()))
    mark = free_name(docs, "mark")
    seen = docs.withColumn(mark, F.xxhash64("text"))
    return seen.join(bad, same(seen, bad, {"doc_id": "__id", mark: "__mark"}), "left_anti").drop(mark)
