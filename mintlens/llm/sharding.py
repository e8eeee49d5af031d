"""Sharding by a hierarchical weighted hash tree (native: DataFrame functions only).

A row descends region, rack and shard.  At each level every child c of weight w draws -ln(u)/w from u = hash(key, c)
and the smallest draw wins, so a child gets rows in proportion to its weight and the draws of its siblings do not
depend on it.  Changing the weight of a subtree therefore moves rows only into or out of that subtree.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Shards that share a region, and racks in a full region.
REGION_SHARDS, REGION_RACKS = 4, 2
#: Shards of the base tree; each shard beyond them opens a region of its own, so that it takes rows only into itself.
BASE_SHARDS = 8
#: Hash buckets that a shard's rows are numbered in; a bucket is the largest unit that one task sorts.
SLOT_BUCKETS = 256

Tree = dict[str, dict[str, dict[int, float]]]


def topology(shards: int, base: int = BASE_SHARDS) -> Tree:
    """region -> rack -> shard -> weight, for shards 0 to ``shards`` - 1, all of weight 1."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    tree: Tree = {}
    per_rack = REGION_SHARDS // REGION_RACKS
    for s in range(shards):
        grown = s >= base
        region = f"grown{s}" if grown else f"region{s // REGION_SHARDS}"
        rack = "rack0" if grown else f"rack{s % REGION_SHARDS // per_rack}"
        tree.setdefault(region, {}).setdefault(rack, {})[s] = 1.0
    return tree


def weight(node) -> float:
    return float(node) if isinstance(node, (int, float)) else sum(weight(x) for x in node.values())


def unit_hash(key: Column, salt: str) -> Column:
    """A double in (0, 1) from 52 bits of md5(salt:key); any engine with md5 gets the same."""
    digits = F.substring(F.md5(F.concat(F.lit(salt + ":"), key).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(2**52))


def pick(key: Column, node, path: str = "") -> Column:
    """The leaf that ``key`` reaches below ``node``: an expression that draws only along its own path."""
    children = {k: v for k, v in node.items() if weight(v) > 0}
    if not children:
        raise ValueError("a subtree without weight")
    found = {k: F.lit(int(k)) if isinstance(v, (int, float)) else pick(key, v, f"{path}/{k}") for k, v in children.items()}
    if len(children) == 1:
        return next(iter(found.values()))
    draws = [F.struct((-F.log(unit_hash(key, f"{path}/{k}")) / F.lit(weight(v))).alias("d"), F.lit(n).alias("n")) for n, (k, v) in enumerate(children.items())]
    best = F.least(*draws)["n"]
    pairs = list(enumerate(found.values()))
    return reduce(lambda rest, x: F.when(best == F.lit(x[0]), x[1]).otherwise(rest), reversed(pairs[:-1]), pairs[-1][1])


def assign(df: DataFrame, key: str, tree: Tree, out: str = "shard") -> DataFrame:
    """``df`` with the shard of each row in ``out`` (replaced if it exists).  A null key counts as the text "null"."""
    return df.withColumn(out, pick(F.coalesce(F.col(key).cast("string"), F.lit("null")), tree))


def shard_documents(docs: DataFrame, shards: int = BASE_SHARDS, buckets: int = SLOT_BUCKETS) -> DataFrame:
    """doc_id, size, text_crc32, law ("key"), shard, slot and grown_shard (with one more shard) of every document.

    The law is ``key``: only doc_id and the number of shards decide, so copies may part.  size is the text's UTF-8
    bytes plus 1 (null: 1); text_crc32 is of those bytes (null: of none, 0).  Null ids count as one key.  Repeated
    rows share a shard and get slots of their own; an empty table gives an empty result; other columns are ignored.

    Slots number a shard's rows without a gap, by (bucket, doc_id, size, crc): each of ``buckets`` hash buckets is
    sorted alone and starts where the counts of those before it end.  Buckets also hash the text's size and
    checksum, so rows that share an id spread.  The texts are read once; only digests are shuffled.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", (F.octet_length(text).cast("bigint") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"), pick(key, topology(shards)).alias("shard"), pick(key, topology(shards + 1)).alias("grown_shard"))
    mark = F.concat_ws(":", key, F.col("size"), F.col("text_crc32"))
    d = cut(d.withColumn("bucket", F.floor(unit_hash(mark, "slot") * F.lit(buckets)).cast("int")))
    counts = d.groupBy("shard", "bucket").count()
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # at most shards x buckets rows, whatever the input
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    order = Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32")
    slot = (F.col("start") + F.row_number().over(order) - 1).cast("bigint")
    return d.join(F.broadcast(starts), ["shard", "bucket"]).select("doc_id", "size", "text_crc32", "law", "shard", slot.alias("slot"), "grown_shard")
