"""Fill-in-the-middle transformation by lookaround splitting (native: DataFrame functions only).

A unit grammar is written as the class of signs that end a unit and the class that begins the next one.  It becomes a
regular expression of zero width that matches between two such signs, so ``split`` cuts the text there and loses nothing:
the pieces joined are the text.  Two hashed cuts make prefix, middle and suffix of the pieces.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

SEED, PLAIN_PERCENT, SPM_PERCENT = 42, 50, 80
WHITE = r"\x20\x09-\x0D"


@dataclass(frozen=True)
class Grammar:
    """A unit ends after ``before`` (a class, or a run of signs of fixed length) if ``after`` (a class) follows."""

    before: str
    after: str

    @property
    def boundary(self) -> str:
        return f"(?s)(?<={self.before})(?={self.after})"


#: ``word``: white space with the word after it, or white space at the end.
GRAMMARS = {
    "word": Grammar(f"[^{WHITE}]", f"[{WHITE}]"),
    "character": Grammar(".", "."),
    "line": Grammar(r"\n", "."),
    "paragraph": Grammar(r"\n\n", r"[^\n]"),
    "sentence": Grammar("[.!?]", f"[{WHITE}]"),
}


@dataclass(frozen=True)
class Markers:
    """What stands before prefix, suffix and middle; none may be empty, part of another one, or begin with the end of one."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        every = (self.prefix, self.suffix, self.middle)
        for a in every:
            for b in every:
                if not a or (a is not b and a in b) or any(a.endswith(b[:k]) for k in range(1, len(b) if a == b else len(b) + 1)):
                    raise ValueError(f"markers {a!r} and {b!r} can't be told apart")

    @property
    def any(self) -> str:
        return "|".join("".join(f"\\x{{{ord(c):X}}}" for c in m) for m in (self.prefix, self.suffix, self.middle))


def units(text: Column, grammar: Grammar) -> Column:
    """The units of ``text`` as an array, none for empty text."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, grammar.boundary, -1))


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers below 2**32 from the SHA-256 of seed and id; a null id draws as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]


def transform(
    docs: DataFrame,
    unit: str | Grammar = "word",
    seed: int = SEED,
    plain_percent: int = PLAIN_PERCENT,
    spm_percent: int = SPM_PERCENT,
    markers: Markers = Markers(),
) -> DataFrame:
    """doc_id, text, n (units), form, prefix_chars, middle_chars and output of every row of ``docs``.

    ``form`` is ``plain`` (output is the text) for texts without units, texts that hold a marker, and ``plain_percent``
    of the others; of the rest ``spm_percent`` are ``spm`` (suffix, prefix, middle) and the others ``psm``.  The hash
    of the id decides, so rows that repeat an id are cut alike, and a null id draws as an empty one.  A null text counts
    as empty.  Characters are code points, null for plain rows.  Texts of any length are cut whole; an empty table gives
    an empty result; other columns are ignored.
    """
    grammar = GRAMMARS[unit] if isinstance(unit, str) else unit
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *(h.alias(f"h{k}") for k, h in enumerate(draws(F.col("doc_id"), seed), start=1)))
    d = d.withColumn("u", units(F.col("text"), grammar)).withColumn("n", F.size("u").cast("bigint"))
    held = (F.contains("text", F.lit(m)) for m in (markers.prefix, markers.suffix, markers.middle))
    plain = (F.col("n") == 0) | (F.col("h3") % 100 >= 100 - plain_percent)
    for h in held:
        plain = plain | h
    d = d.withColumn("form", F.when(plain, "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm"))
    a, b = (F.col(h) % (F.col("n") + 1) for h in ("h1", "h2"))
    lo, hi = F.least(a, b).cast("int"), F.greatest(a, b).cast("int")
    cut = lambda start, length: F.array_join(F.slice("u", start, length), "")
    parts = F.when(F.col("form") != "plain", F.struct(cut(F.lit(1), lo).alias("p"), cut(lo + 1, hi - lo).alias("m"), cut(hi + 1, F.col("n").cast("int") - hi).alias("s")))
    d = d.withColumn("c", parts)
    p, m, s = (F.col(f"c.{x}") for x in "pms")
    psm = F.concat(F.lit(markers.prefix), p, F.lit(markers.suffix), s, F.lit(markers.middle), m)
    spm = F.concat(F.lit(markers.suffix), s, F.lit(markers.prefix), p, F.lit(markers.middle), m)
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))
    return d.select("doc_id", "text", "n", "form", F.length(p).cast("bigint").alias("prefix_chars"), F.length(m).cast("bigint").alias("middle_chars"), output.alias("output"))


def restored(df: DataFrame, output: str = "output", form: str = "form", name: str = "restored", markers: Markers = Markers()) -> DataFrame:
    """``df`` with the text that ``output`` was made of, by its form alone; null where output or form is null.

    The new column takes a name with underscores before it where ``df`` has ``name`` already.  A form that isn't known
    gives the output as it is.
    """
    parts = free_name(df, "parts")
    # the first piece is empty, as an output of such a form begins with a marker
    d = df.withColumn(parts, F.when(F.col(form).isin("psm", "spm"), F.split(output, markers.any, -1)))
    piece = lambda k: F.get(parts, F.lit(k))
    text = F.when(F.col(form) == "psm", F.concat(piece(1), piece(3), piece(2))).when(F.col(form) == "spm", F.concat(piece(2), piece(3), piece(1))).when(F.col(form).isNotNull(), F.col(output))
    return d.withColumn(free_name(df, name), text).drop(parts)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the SHA-256 of output and of the text rebuilt from it.

    Nulls, empty and long texts, repeated rows, empty tables and other columns are as in ``transform``.
    """
    d = restored(transform(docs))
    return d.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
