"""Secret scans over an incremental ledger of blobs.

Every version of a text is addressed by its content (SHA-256).  The ledger holds the pairs (blob, rule version) that
were scanned, with their findings; a run scans only pairs that it lacks and joins findings back to all rows that hold
the blob.  Texts do not travel for that: a row ships its text only if a cheap JVM test says that some rule could match.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, stored



@dataclass(frozen=True)
class RuleSet:
    """Rules in the order in which their kinds are listed: (kind, pattern, group that is measured, least length)."""

    rules: tuple[tuple[str, str, int, int], ...]
    #: Kinds whose letters match in either case, in ASCII only.
    any_case: frozenset[str]
    #: What a text must hold for any rule to match, tested in the JVM: (words of which it holds one when in lower case, pattern).
    triggers: tuple[tuple[tuple[str, ...], str], ...]

    @property
    def version(self) -> str:
        """Changes whenever a rule does, so that the ledger's pairs of former versions don't count."""
        return hashlib.sha256(repr((self.rules, sorted(self.any_case))).encode()).hexdigest()[:16]

    def find(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) of all matches in code points, by start, then kind as listed."""
        found = []
        for n, (kind, pattern, group, least) in enumerate(self.rules):
            for m in re.finditer(pattern, text, re.ASCII | (re.IGNORECASE if kind in self.any_case else 0)):
                if len(m[group]) >= least:
                    found.append((m.start(), n, kind, m.end()))
        return [(kind, start, end) for start, _, kind, end in sorted(found)]

    def could_match(self, text: Column) -> Column:
        """A superset of the rules; plain searches for words go before patterns, which cost more."""
        fired = F.lit(False)
        for words, pattern in self.triggers:
            held = F.lit(not words)
            for w in words:
                held = held | F.contains(F.lower(text), F.lit(w))
            fired = fired | (held & text.rlike(pattern))
        return fired


# The rules that the operator's results are defined by.
BASE = RuleSet(
    (
        ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        ("access", r"AKIA[A-Z0-9]+", 0, 20),
        ("hex", r"[0-9a-f]+", 0, 24),
    ),
    frozenset({"assign"}),
    (
        (("password", "passwd", "secret", "token", "apikey", "api_key"), r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"),
        (("akia",), r"AKIA[A-Z0-9]{16}"),
        ((), r"[0-9a-f]{24}"),
    ),
)
#: Batches of documents that the query takes one after another, each with the ledger that the former left.
INCREMENTS = 2

LEDGER = T.StructType([
    T.StructField("blob", T.StringType()),
    T.StructField("rule_version", T.StringType()),
    T.StructField("findings", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
])


def _scan(rules: RuleSet):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in rules.find(t.as_py() or "")] for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("blob"), b.column("rule_version"), pa.array(found, kind)], LEDGER.names)

    return run


def addressed(versions: DataFrame, path: str = "doc_id", text: str = "text", rules: RuleSet = BASE) -> DataFrame:
    """path, blob (SHA-256 of the text; null counts as empty) and the text itself where a rule could match, else null."""
    content = F.coalesce(F.col(text), F.lit(""))
    return versions.select(F.col(path).alias("path"), F.sha2(content.cast("binary"), 256).alias("blob"), F.when(rules.could_match(content), content).alias("text"))


def scan(rows: DataFrame, ledger: DataFrame | None = None, rules: RuleSet = BASE) -> DataFrame:
    """Ledger rows for the blobs of ``rows`` (of ``addressed``) that ``ledger`` lacks under the version of ``rules``.

    Copies are combined before the shuffle, so a blob that fills a third of the rows is one row for each map task.
    Blobs without a trigger ship no text and enter the ledger with no findings.
    """
    blobs = rows.groupBy("blob").agg(F.max("text").alias("text"))
    if ledger is not None:
        seen = ledger.where(F.col("rule_version") == rules.version).select("blob")
        blobs = blobs.join(seen, "blob", "left_anti")
    return blobs.select("blob", F.lit(rules.version).alias("rule_version"), "text").mapInArrow(_scan(rules), LEDGER)


def scan_history(versions: DataFrame, ledger: DataFrame | None = None, path: str = "doc_id", text: str = "text", rules: RuleSet = BASE) -> tuple[DataFrame, DataFrame]:
    """(path, blob, findings) for every row of ``versions``, and the ledger with what this run adds.

    Null texts count as empty; null paths keep their row; repeated rows each keep a row; an empty table gives an
    empty result; other columns, of whatever name, are ignored.  Findings are never null.
    """
    rows = stored(addressed(versions, path, text, rules))
    fresh = stored(scan(rows, ledger, rules))
    whole = fresh if ledger is None else ledger.select(*LEDGER.names).unionByName(fresh)
    known = whole.where((F.col("rule_version") == rules.version) & (F.size("findings") > 0)).select("blob", "findings")
    none = F.array().cast(LEDGER["findings"].dataType)
    back = rows.select("path", "blob").join(known, "blob", "left").select("path", "blob", F.coalesce("findings", none).alias("findings"))
    return back, whole


def digest(docs: DataFrame, ledger: DataFrame | None = None, increments: int = INCREMENTS, rules: RuleSet = BASE) -> DataFrame:
    """One row a document: the numbers of findings by kind, their spans "kind:start:end", and the spans' SHA-256.

    The documents come in ``increments`` by a hash of their id; each scans only blobs that the ledger of those
    before lacks, so a copy of a text that an earlier increment held is never scanned again.
    """
    batch, parts = F.pmod(F.xxhash64("doc_id"), F.lit(increments)), []
    for k in range(increments):
        back, ledger = scan_history(docs.where(batch == k), ledger, rules=rules)
        parts.append(back)
    spans = F.array_join(F.transform("findings", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return reduce(DataFrame.unionByName, parts).select(F.col("path").alias("doc_id"), *(count(k) for k, *_ in rules.rules), F.sha2(spans.cast("binary"), 256).alias("base_sha256"), spans.alias("spans"))


def masked(text: str, findings, mask: str = "[secret]") -> str:
    """``text`` with each found span, overlaps merged, replaced by ``mask``."""
    out, at = [], 0
    for f in sorted(findings, key=lambda f: (f["start"], f["end"])):
        if f["end"] <= at:
            continue
        if f["start"] >= at:
            out += [text[at : f["start"]], mask]
        at = f["end"]
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, ledger: DataFrame | None = None, rules: RuleSet = BASE) -> DataFrame:
    """``docs`` with every found secret masked and ``n_chars``, if there, brought into line; no row is dropped.

    Only rows that the trigger lets through are joined with the findings of their blob; all others pass as they are.
    """
    fired = rules.could_match(F.coalesce(F.col("text"), F.lit("")))
    hot = docs.where(fired)
    back = stored(scan(addressed(hot, docs.columns[0], rules=rules), ledger, rules))
    known = back if ledger is None else ledger.select(*LEDGER.names).unionByName(back)
    blob, findings = free_name(docs, "blob"), free_name(docs, "findings")
    known = known.where((F.col("rule_version") == rules.version) & (F.size("findings") > 0)).select(F.col("blob").alias(blob), F.col("findings").alias(findings))

    @F.arrow_udf("string")
    def mask(text: pa.Array, findings: pa.Array) -> pa.Array:
        return pa.array([t if f is None or t is None else masked(t, f) for t, f in zip(text.to_pylist(), findings.to_pylist(), strict=True)], pa.string())

    joined = hot.withColumn(blob, F.sha2(F.col("text").cast("binary"), 256)).join(known, blob, "left")
    clean = joined.withColumn("text", F.when(F.col(findings).isNull(), F.col("text")).otherwise(mask("text", findings)))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.col(findings).isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return docs.where(~fired).unionByName(clean.select(*docs.columns))
