"""Language identification of web pages by Bayesian evidence fusion.

Four kinds of evidence meet in one posterior for each page: the text's character trigrams under models trained from
labelled documents, the language that the markup declares, the suffix of the address, and a prior for the host that
is smoothed towards its domain and that towards all pages.  What declarations, suffixes and hosts are worth is learned
from the text posteriors of all pages by grouped aggregation, without the page's own share.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small, stored

#: Labelled documents a language that the text models are trained on, and trigrams a language that they keep.
TRAIN_DOCS, TRIGRAMS = 2000, 4000
#: Weight of a trigram's log-likelihood (neighbours depend on each other), and the most that all of a page's may add up to.
TEMPER, MOST_TEXT = 0.25, 40.0
#: Pages that a coarser level counts for when it smooths a finer one.
SMOOTH = 8.0

_HIDDEN = re.compile(r"(?i)<(script|style|noscript)\b")
_CLOSING = {name: re.compile(rf"(?i)</{name}\s*>") for name in ("script", "style", "noscript")}
_GAP = re.compile(r"[\W\d_]+")
_LANG = r"(?is)<html\b[^<>]*?\blang\s*=\s*[\"']?([a-z]{2,3})"


def page_text(html: str | None) -> str:
    """The visible text of a page: without scripts, styles, comments and tags, entities resolved.

    What is opened and never closed loses its tag only, as does a comment.  One pass, whatever is left open.
    """
    html, out, at, endless = html or "", [], 0, set()
    while (lt := html.find("<", at)) >= 0:
        out += [html[at:lt], " "]
        end, hidden = None, _HIDDEN.match(html, lt)
        kind = "comment" if html.startswith("<!--", lt) else hidden[1].lower() if hidden else None
        if kind and kind not in endless:
            if kind == "comment":
                found = html.find("-->", lt + 4)
                end = found + 3 if found >= 0 else None
            elif closed := _CLOSING[kind].search(html, hidden.end()):
                end = closed.end()
            if end is None:
                endless.add(kind)
        if end is None:
            gt = html.find(">", lt)
            if gt < 0:
                out[-1], at = html[lt:], len(html)
                break
            end = gt + 1
        at = end
    return entities.unescape("".join([*out, html[at:]]))


def trigrams(text: str) -> Counter:
    """Character trigrams of the lower-cased words, a blank at either side of each."""
    s = f" {_GAP.sub(' ', text.lower()).strip()} "
    return Counter(map("".join, zip(s, s[1:], s[2:], strict=False)))


class TextModel:
    """Smoothed log-probabilities of trigrams by language."""

    def __init__(self, rows: list[tuple[str, str, int]], languages: list[str] | None = None):
        self.languages = sorted({lang for lang, _, _ in rows} if languages is None else set(languages))
        at = {lang: k for k, lang in enumerate(self.languages)}
        grams = sorted({g for _, g, _ in rows})
        counts = np.full((len(grams), len(at)), 0.5)
        place = {g: k for k, g in enumerate(grams)}
        for lang, g, n in rows:
            counts[place[g], at[lang]] += n
        self.place, self.logs = place, np.log(counts / counts.sum(axis=0)) if len(grams) else np.zeros((0, len(at)))

    def log_likelihoods(self, text: str) -> list[float]:
        """Tempered and bounded, the best at 0; all 0 where no trigram is known."""
        found = [(k, n) for g, n in trigrams(text).items() if (k := self.place.get(g)) is not None]
        if not found:
            return [0.0] * len(self.languages)
        k, n = (np.array(x) for x in zip(*found, strict=True))
        total = TEMPER * (self.logs[k] * n[:, None]).sum(axis=0)
        return np.maximum(total - total.max(), -MOST_TEXT).tolist()


def train(docs: DataFrame, lang: str = "lang", text: str = "text") -> TextModel:
    """Text models of all languages, from about TRAIN_DOCS documents of each at most, by the hash of id and text.

    Rows that agree in language, id and text count once, and the share that is taken is of such distinct rows.
    Null languages and texts are left out.  Of each language at most TRIGRAMS trigrams reach the driver, its most frequent.
    """
    d = docs.select(F.col(lang).alias("lang"), F.xxhash64("doc_id", F.col(text)).alias("key"), F.col(text).alias("text")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    share = small(stored(d.select("lang", "key").distinct().groupBy("lang").count()))
    # rows whose hash falls into the share that leaves TRAIN_DOCS of the language, as counted over all documents
    unit = F.col("key").bitwiseAND((1 << 52) - 1) / float(1 << 52)
    chosen = d.join(share, "lang").where(unit * F.col("count") < TRAIN_DOCS).dropDuplicates(["lang", "key"]).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for language, part in b.groupby("lang")["text"]:
                total: Counter = Counter()
                for t in part:
                    total.update(trigrams(t))
                if total:
                    yield pd.DataFrame({"lang": language, "gram": list(total), "n": list(total.values())})

    sums = chosen.mapInPandas(count, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    kept = sums.withColumn("place", place).where(F.col("place") <= TRIGRAMS).select("lang", "gram", "n")
    return TextModel([tuple(r) for r in kept.collect()], [r["lang"] for r in share.select("lang").collect()])


def _log_likelihoods(model: TextModel, source: Column) -> Column:
    @F.arrow_udf("array<double>")
    def run(x: pa.Array) -> pa.Array:
        return pa.array([model.log_likelihoods(page_text(t.as_py())) for t in x], pa.list_(pa.float64()))

    return run(source)


def softmax(logs: list[Column]) -> list[Column]:
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    parts = [F.exp(x - top) for x in logs]
    return [p / sum(parts[1:], parts[0]) for p in parts]


def identify(pages: DataFrame, model: TextModel, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, lang, confidence, text_lang, declared and host of every page.

    Hosts are as they stand between "://" and the next "/", "?" or "#", in lower case and without a port; the domain
    is the last two labels and the suffix the last.  A null url has an empty host; a null page has no text and
    declares nothing, so its host and all pages decide.  Ties go to the first language by name.  Repeated rows each
    keep a row (and count as pages); an empty table, or a model without languages, gives null languages; other
    columns are ignored.
    """
    langs = model.languages
    if not langs:
        return pages.select(key, *(F.lit(None).cast(t).alias(c) for c, t in (("lang", "string"), ("confidence", "double"), ("text_lang", "string"), ("declared", "string"), ("host", "string"))))
    n = range(len(langs))
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"://([^/?#:]*)", 1))
    rows = pages.select(F.col(key), host.alias("host"), F.lower(F.regexp_extract(F.coalesce(F.col(html), F.lit("")), _LANG, 1)).alias("declared"), _log_likelihoods(model, F.col(html)).alias("ll"))
    probable = softmax([F.col("ll")[k] for k in n])
    rows = rows.withColumn("declared", F.when(F.col("declared").isin(langs), F.col("declared")).when(F.col("declared") == "", "").otherwise("other"))
    rows = cut(rows.select("*", *(p.alias(f"p{k}") for k, p in zip(n, probable, strict=True))))

    # sums of posteriors: hosts, then domains, suffixes and all from the hosts'
    labels = F.split("host", r"\.")
    hosts = rows.groupBy("host").agg(*(F.sum(f"p{k}").alias(f"h{k}") for k in n)).withColumn("domain", F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")).withColumn("suffix", F.element_at(labels, -1))
    hosts = cut(hosts)
    total = hosts.agg(*(F.coalesce(F.sum(f"h{k}"), F.lit(0.0)).alias(f"g{k}") for k in n)).first()
    domains = hosts.groupBy("domain").agg(*(F.sum(f"h{k}").alias(f"d{k}") for k in n))
    suffixes = hosts.groupBy("suffix").agg(*(F.sum(f"h{k}").alias(f"s{k}") for k in n))
    hosts = hosts.join(domains, "domain").join(suffixes, "suffix").drop("domain", "suffix")
    said = {r["declared"]: [r[f"c{k}"] for k in n] for r in rows.groupBy("declared").agg(*(F.sum(f"p{k}").alias(f"c{k}") for k in n)).collect()}  # languages + 2 rows at most

    own = [F.col(f"p{k}") for k in n]
    # sums over the same rows in another order may differ in the last digits
    less = lambda prefix: [F.greatest(F.col(f"{prefix}{k}") - own[k], F.lit(0.0)) for k in n]
    smooth = lambda counts, base: [(c + SMOOTH * b) / (sum(counts[1:], counts[0]) + SMOOTH) for c, b in zip(counts, base, strict=True)]
    everywhere = [F.lit(float(total[k])) - own[k] for k in n]
    base = smooth([F.greatest(x, F.lit(0.0)) for x in everywhere], [F.lit(1.0 / len(langs))] * len(langs))
    joined = rows.join(hosts, "host").select(rows["*"], *(x.alias(f"b{k}") for k, x in zip(n, base, strict=True)), *(F.col(f"{c}{k}") for c in "hds" for k in n))
    joined = joined.select("*", *(x.alias(f"e{k}") for k, x in zip(n, smooth(less("d"), [F.col(f"b{k}") for k in n]), strict=True)))
    joined = joined.select("*", *(x.alias(f"q{k}") for k, x in zip(n, smooth(less("h"), [F.col(f"e{k}") for k in n]), strict=True)), *(x.alias(f"t{k}") for k, x in zip(n, smooth(less("s"), [F.col(f"b{k}") for k in n]), strict=True)))

    def declared(k: int) -> Column:
        """log P(declared | language k), over all pages but this one, smoothed by one page a kind; nothing said, no evidence."""
        mass = sum(c[k] for c in said.values())
        value = F.lit(0.0)
        for what, c in said.items():
            if what:
                value = F.when(F.col("declared") == what, F.log((F.greatest(F.lit(float(c[k])) - own[k], F.lit(0.0)) + 1) / (F.greatest(F.lit(float(mass)) - own[k], F.lit(0.0)) + len(said) + 1))).otherwise(value)
        return value

    # the suffix counts as a likelihood: how much more frequent the language is under it than anywhere
    logs = [F.col("ll")[k] + declared(k) + F.log(F.col(f"t{k}") / F.col(f"b{k}")) + F.log(F.col(f"q{k}")) for k in n]
    joined = joined.select(key, "host", "declared", "ll", *(x.alias(f"w{k}") for k, x in zip(n, softmax(logs), strict=True)))

    def first_best(values: list[Column]) -> Column:
        return F.element_at(F.array_sort(F.array(*(F.struct((-v).alias("v"), F.lit(x).alias("x")) for v, x in zip(values, langs, strict=True)))), 1)

    best = first_best([F.col(f"w{k}") for k in n])
    return joined.select(key, best["x"].alias("lang"), (-best["v"]).alias("confidence"), first_best([F.col("ll")[k] for k in n])["x"].alias("text_lang"), F.nullif("declared", F.lit("")).alias("declared"), "host")


