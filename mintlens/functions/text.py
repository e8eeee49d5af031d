"""String and JSON column expressions; pandas functions only for what Spark cannot express exactly."""

from __future__ import annotations

import difflib
import unicodedata
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that name no card.
STOP_NAMES = ("pokemon", "pokémon", "basic", "stage", "fase", "hp", "gx", "ex", "v")
#: Accented letters and their plain ones, for ``plain``.
ACCENTED, PLAIN = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿ", "aaaaaaeeeeiiiiooooouuuuncyy"


def _s(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def plain(x) -> Column:
    """Lower case without the accents of Latin vowels, n, c and y.  ``plain_exact`` covers all of Unicode."""
    return F.translate(F.lower(_s(x)), ACCENTED, PLAIN)


def plain_exact(x) -> Column:
    """Compatibility decomposition without combining marks, in lower case."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).lower())

    return run(x)


def normal_name(x, exact: bool = False) -> Column:
    """Letters a-z, digits and single blanks only."""
    base = plain_exact(_s(x)) if exact else plain(x)
    return F.trim(F.regexp_replace(F.regexp_replace(base, r"[^a-z0-9\s]", " "), r"\s+", " "))


def count_of(x, kind: str) -> Column:
    return F.regexp_count(_s(x), F.lit(kind))


def usable_name(x) -> Column:
    """Three characters and letters at least, not mostly digits, and no stop word."""
    t = F.trim(F.coalesce(_s(x), F.lit("")))
    letters, digits = count_of(t, r"\p{L}"), count_of(t, r"\p{Nd}")
    return (F.char_length(t) >= 3) & (letters >= 3) & (digits <= F.greatest(F.lit(2), letters)) & ~F.lower(t).isin(*STOP_NAMES)


def shared_prefix(a, b) -> Column:
    """Number of leading characters that a and b have in common."""
    a, b = _s(a), _s(b)
    n = F.least(F.char_length(a), F.char_length(b))
    same = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.substring(a, 1, k) == F.substring(b, 1, k))
    return F.when(n < 1, 0).otherwise(F.size(F.filter(same, lambda x: x)))


def edit_similarity(a, b) -> Column:
    """1 - edit distance / longer length: a named alternative to ``sequence_similarity``."""
    a, b = _s(a), _s(b)
    return 1.0 - F.levenshtein(a, b) / F.greatest(F.char_length(a), F.char_length(b), F.lit(1))


def sequence_similarity(a, b) -> Column:
    """Twice the matched characters over all characters, by longest matching blocks; not symmetric."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")

    return run(a, b)


def search_queries(name) -> Column:
    """Ever looser searches for a name: all of it, its first word, that word's starts from 14 down to 5 letters, its
    first two words; four characters at least, each once, in this order."""
    name = _s(name)
    words = F.split(name, " ")
    first, n = words[0], F.char_length(words[0])
    starts = F.when(n >= 5, F.transform(F.sequence(F.least(n, F.lit(14)), F.lit(5), F.lit(-1)), lambda k: F.substring(first, 1, k))).otherwise(F.array().cast("array<string>"))
    two = F.when(F.size(words) >= 2, F.array(F.concat_ws(" ", words[0], words[1]))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.concat(F.array(name, first), starts, two), lambda q: F.char_length(q) >= 4))


def title_case(x) -> Column:
    """The first letter of every run of letters as a capital, the others small: what follows an apostrophe begins a run too."""
    return F.array_join(F.transform(F.regexp_extract_all(_s(x), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0)), F.initcap), "")


def clean_scan(x) -> Column:
    """A name as a text scan reads it: allowed signs only, stage words and one-letter or digit tokens gone, cut at the
    hit points, words capitalised."""
    t = F.trim(F.regexp_replace(F.regexp_replace(_s(x), r"[^\p{L}\p{N}'\-\s]", " "), r"\s+", " "))
    words = F.split(t, " ")
    ends = F.filter(F.transform(words, lambda w, k: F.when(F.lower(w).isin("hp", "ps"), k + 1)), lambda k: k.isNotNull())
    kept = F.when(F.size(ends) > 0, F.slice(words, F.lit(1), F.array_min(ends) - 1)).otherwise(words)
    good = F.filter(kept, lambda w: (F.char_length(w) > 1) & ~w.rlike(r"^\p{N}+$") & ~F.lower(w).isin("basic", "stage", "fase", "etapa", "basico", "básico"))
    return title_case(F.array_join(good, " "))


def token_confidence(tokens) -> Column:
    """Mean confidence of recognised tokens (array of structs text, conf) that are not blank and have one of 0 or more; -1 for none."""
    good = F.filter(_s(tokens), lambda t: (F.trim(t["text"]) != "") & (t["conf"] >= 0))
    total = F.aggregate(good, F.lit(0.0), lambda s, t: s + t["conf"].cast("double"))
    return F.when(F.size(good) > 0, total / F.size(good)).otherwise(-1.0)


def token_text(tokens) -> Column:
    """The tokens' texts, trimmed, those that are not blank, joined by single blanks."""
    return F.array_join(F.filter(F.transform(_s(tokens), lambda t: F.trim(t["text"])), lambda t: t != ""), " ")


def first_usable(*xs) -> Column:
    """The first value that is neither null nor blank."""
    return F.coalesce(*(F.nullif(F.trim(_s(x)), F.lit("")) for x in xs))


def first_number(*xs) -> Column:
    """The first value that reads as a number; booleans do not."""
    return F.coalesce(*(F.when(~F.lower(_s(x).cast("string")).isin("true", "false"), _s(x).cast("string").try_cast("double")) for x in xs))


def joined_reasons(*reasons: Column) -> Column:
    """The reasons that are not null, sorted, each once, joined by a bar."""
    return F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*reasons)))), "|")


def named_reasons(found: Mapping[str, Column]) -> Column:
    """``joined_reasons`` of names and when they hold: sorted beforehand, so nothing is evaluated outside of compiled code."""
    return F.concat_ws("|", *(F.when(found[name], name) for name in sorted(found)))


# -- JSON ------------------------------------------------------------------------------------------------------------------


def json_object(x) -> Column:
    """The text from the first "{" to the last "}" as a variant; null where that is no JSON object."""
    return F.try_parse_json(F.nullif(F.regexp_extract(_s(x), r"(?s)\{.*\}", 0), F.lit("")))


def field(v: Column, *paths: str) -> Column:
    """The first of several spellings of a field that is there, as text."""
    return F.coalesce(*(F.try_variant_get(v, p, "string") for p in paths))


def safe_confidence(x) -> Column:
    """A confidence as a double in 0..1; null where it is missing or no number."""
    c = F.nullif(F.trim(_s(x).cast("string")), F.lit("")).try_cast("double")
    return F.when(c.isNotNull() & ~F.isnan(c), F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)))


def numbers_only(m) -> Column:
    """A map of texts without the entries that are no number, keys in upper case."""
    kept = F.map_filter(_s(m), lambda k, v: v.try_cast("double").isNotNull())
    return F.transform_values(F.transform_keys(kept, lambda k, v: F.upper(k)), lambda k, v: v.try_cast("double"))
