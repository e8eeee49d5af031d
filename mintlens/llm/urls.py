"""URL filters: a trie over reversed host labels and path segments, longest match first."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rules that a trie may hold to be broadcast; more are matched by a join.
TRIE_RULES = 200_000


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str  # allow or block


# The rules of op8.
RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def parts(df: DataFrame, url: str = "url") -> DataFrame:
    """``df`` with host and path: after the first "://" up to "/", "?", "#" or the end, A-Z in lower case; then up to "?" or "#"."""
    rest = F.when(F.locate("://", F.col(url)) > 0, F.expr(f"substring(`{url}`, locate('://', `{url}`) + 3)")).otherwise("")
    at = F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 1), F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 2)
    return df.withColumns({"host": F.coalesce(F.translate(at[0], _UPPER, _UPPER.lower()), F.lit("")), "path": F.coalesce(at[1], F.lit(""))})


def spelling(rule: Rule) -> str:
    return rule.host + rule.path


def trie(rules: Iterable[Rule]) -> dict:
    """Nested dicts: reversed host labels, then under "/" the path's segments; a leaf is (length, verdict, spelling).

    A path's last segment may end within a segment of the url, so it is kept as text to be compared by its start.
    """
    root: dict = {}
    for rule in rules:
        node = root
        for label in reversed(rule.host.split(".")):
            node = node.setdefault(("h", label), {})
        node = node.setdefault("/", {})
        *full, last = rule.path.split("/")
        for segment in full:
            node = node.setdefault(("p", segment), {})
        ends = node.setdefault("ends", {})
        mine = (len(spelling(rule)), rule.verdict == "block", spelling(rule))
        ends[last] = max(ends.get(last, mine), mine)  # of equal rules the block stands
    return root


def longest(root: dict, host: str, path: str) -> tuple[int, bool, str] | None:
    """The longest fitting rule; of equally long ones a block, then the greater spelling."""
    best, node, segments = None, root, path.split("/")
    for label in reversed(host.split(".")):
        if (node := node.get(("h", label))) is None:
            break
        at = node.get("/")
        for segment in segments:
            if at is None:
                break
            for last, leaf in at.get("ends", {}).items() if len(at.get("ends", ())) <= 8 else ((segment[:k], at["ends"].get(segment[:k])) for k in range(len(segment) + 1)):
                if leaf and segment.startswith(last) and (best is None or leaf > best):
                    best = leaf
            at = at.get(("p", segment))
    return best


def judge(df: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """``df`` with host, path, rule (spelt host + path, null where none fits) and verdict (``default`` where none fits).

    A rule fits its host and all subdomains if the url's path starts with the rule's.  The longest in characters wins,
    of equal ones the block, then the greater spelling.  Null urls and urls without "://" have an empty host and path.
    Repeated rows each keep a row; an empty table gives an empty result; columns of these four names are replaced.
    """
    split = parts(df, url)
    if len(rules) > TRIE_RULES:
        return _judge_by_join(split, rules, default)
    root = df.sparkSession.sparkContext.broadcast(trie(rules))

    @F.arrow_udf("struct<rule:string,block:boolean>")
    def match(host: pa.Array, path: pa.Array) -> pa.Array:
        found = [longest(root.value, h, p) for h, p in zip(host.to_pylist(), path.to_pylist(), strict=True)]
        return pa.StructArray.from_arrays([pa.array([f and f[2] for f in found], pa.string()), pa.array([f and f[1] for f in found], pa.bool_())], ["rule", "block"])

    hit = split.withColumn("rule", match("host", "path"))
    verdict = F.when(F.col("rule.block"), "block").when(F.col("rule.rule").isNotNull(), "allow").otherwise(default)
    return hit.withColumn("verdict", verdict).withColumn("rule", F.col("rule.rule"))


def _judge_by_join(split: DataFrame, rules: list[Rule], default: str) -> DataFrame:
    """The same without a broadcast trie: each distinct host meets the rules of its suffixes by an equi-join."""
    spark = split.sparkSession
    r = spark.createDataFrame([(x.host, x.path, len(spelling(x)), x.verdict == "block", spelling(x)) for x in rules], "suffix string, start string, n int, block boolean, spelt string")
    labels = F.split("host", r"\.")
    sites = split.select("host", "path").distinct()
    suffixes = sites.select("host", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))).alias("suffix"))
    best = suffixes.join(r, "suffix").where(F.expr("startswith(path, start)")).groupBy("host", "path").agg(F.max(F.struct("n", "block", "spelt")).alias("b"))
    out = split.drop("rule", "verdict").join(best, ["host", "path"], "left")
    return out.withColumn("rule", F.col("b.spelt")).withColumn("verdict", F.when(F.col("b.block"), "block").when(F.col("b").isNotNull(), "allow").otherwise(default)).select(*[c for c in split.columns if c not in ("rule", "verdict")], "rule", "verdict")


def digest(pages: DataFrame) -> DataFrame:
    return judge(pages.select("page_id", "url"), list(RULES)).select("page_id", "host", "path", "rule", "verdict")
