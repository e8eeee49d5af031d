"""Quality classification by a sparse rule ensemble.

Trees of a small forest, fitted on a bounded labelled sample, give rules: the conjunction of conditions on the way to
each node.  A logistic regression with a lasso penalty weighs them and leaves most at zero.  The rest compile into one
Spark column expression over the text's statistics.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name

#: Labelled rows that the classifier is fitted on, at most (those of the least hashes of their id).
SAMPLE_ROWS = 20_000
TREES, DEPTH, LASSO, SEED = 24, 4, 0.0005, 42
#: Scores from which a document counts as good.
THRESHOLD = 0.3

STATISTICS = (
    "log_bytes", "log_words", "bytes_per_word", "upper", "digits", "spaces", "commas_stops", "bangs", "bars", "marks", "other_signs", "high_bytes",
    "distinct_words", "top_word", "repeated_lines", "log_line_words", "short_words", "marked_words", "shouted_words", "distinct_bytes",
)

_CLASS = np.zeros(256, np.int8)
for _n, _bytes in enumerate((range(65, 91), range(48, 58), (32, 9, 10, 11, 12, 13), b".,", b"!", b"|", b"#$%&*", (b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,!|#$%&*"), range(128, 256)), start=1):
    _CLASS[list(_bytes)] = _n


def statistics(text: bytes | None) -> list[float]:
    """The values of STATISTICS for a whole UTF-8 text; shares are of its bytes, words or lines, 0 where there are none."""
    text = text or b""
    n = len(text)
    histogram = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    shares = np.bincount(_CLASS, weights=histogram, minlength=10)[1:] / max(n, 1)
    words, lines = text.split(), [x for x in text.split(b"\n") if x]
    count = Counter(words)
    w, distinct = max(len(words), 1), len(count)
    marked = sum(k for x, k in count.items() if x[-1:] in b"#$%&*!|")
    return [
        math.log1p(n), math.log1p(len(words)), n / w, *shares.tolist(),
        distinct / w, max(count.values(), default=0) / w, 1 - len(set(lines)) / len(lines) if lines else 0.0, math.log1p(len(words) / max(len(lines), 1)),
        sum(k for x, k in count.items() if len(x) < 4) / w, marked / w, sum(k for x, k in count.items() if len(x) > 1 and x.isupper()) / w, np.count_nonzero(histogram) / 256,
    ]


def measured(text: Column | str) -> Column:
    """STATISTICS of a text column as an array of doubles; null counts as empty."""

    @F.arrow_udf("array<double>")
    def run(x: pa.Array) -> pa.Array:
        return pa.array([statistics(t.as_py()) for t in x], pa.list_(pa.float64()))

    return run(F.col(text).cast("binary") if isinstance(text, str) else text.cast("binary"))


#: feature -> (above, at most)
Rule = tuple[tuple[int, float, float], ...]


def tree_rules(node, inside: dict[int, tuple[float, float]] | None = None) -> list[Rule]:
    """The conjunctions on the ways from the root of a fitted tree to each node below it."""
    inside = inside or {}
    found = [tuple((k, *v) for k, v in sorted(inside.items()))] if inside else []
    if node.subtreeDepth() > 0:
        split = node.split()
        k, cutoff = split.featureIndex(), split.threshold()
        low, high = inside.get(k, (-math.inf, math.inf))
        found += tree_rules(node.leftChild(), {**inside, k: (low, min(high, cutoff))})
        found += tree_rules(node.rightChild(), {**inside, k: (max(low, cutoff), high)})
    return found


def holds(rule: Rule, stats: Column) -> Column:
    """Whether the statistics meet every condition of ``rule``, as an expression."""
    cond = None
    for k, above, most in rule:
        for part in ([stats[k] > F.lit(above)] if above > -math.inf else []) + ([stats[k] <= F.lit(most)] if most < math.inf else []):
            cond = part if cond is None else cond & part
    return cond


@dataclass
class RuleModel:
    intercept: float = 0.0
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    def score(self, stats: Column) -> Column:
        """The probability of label 1 as an expression over an array of statistics."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(holds(rule, stats), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """stats and label (double) of at most ``rows`` labelled documents that are not held out, in one partition.

    Of rows that share an id, the one of the least text hash stands for it.  Ids labelled twice take the lower label; null labels, labels other than 0 and 1, and null ids are left out.
    """
    own = labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("label")).where(F.col("label").isin(0, 1) & ~held_out(F.col("id")) & F.col("id").isNotNull())
    own = own.groupBy("id").agg(F.min("label").cast("double").alias("label")).orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(own), F.col("doc_id") == F.col("id"))  # ``rows`` ids at most
    seen = texts.select("id", "label", F.xxhash64("text").alias("mark"), measured("text").alias("stats"))
    one = seen.groupBy("id").agg(F.min(F.struct("mark", "stats", "label")).alias("r")).select(F.col("id").alias("doc_id"), "r.label", "r.stats")
    return one.repartition(1).sortWithinPartitions("doc_id")


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO) -> RuleModel:
    """The rules and their weights.  Without labels of both kinds the model has no rules and the smoothed share of label 1."""
    seen = cut(sample(docs, labels, rows))
    n, good = seen.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if good == 0 or good == n:
        return RuleModel(math.log((good + 1) / (n - good + 1)))
    vectors = seen.withColumn("features", array_to_vector("stats"))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED, labelCol="label", featuresCol="features", minInstancesPerNode=5, featureSubsetStrategy="onethird").fit(vectors)
    rules = list(dict.fromkeys(r for t in forest.trees for r in tree_rules(t._call_java("rootNode"))))
    if not rules:
        return RuleModel(math.log(good / (n - good)))
    facts = seen.select("label", array_to_vector(F.array(*(holds(r, F.col("stats")).cast("double") for r in rules))).alias("features")).persist()
    weights = LogisticRegression(elasticNetParam=1.0, regParam=lasso, maxIter=60, tol=1e-5, labelCol="label", featuresCol="features").fit(facts)
    facts.unpersist()
    return RuleModel(float(weights.intercept), [(r, float(w)) for r, w in zip(rules, weights.coefficients, strict=True) if w])


def scores(docs: DataFrame, model: RuleModel) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``.

    A null text is scored as an empty one.  A null id is not held out.  Repeated rows each keep a row; an empty table
    gives an empty result; other columns are ignored.
    """
    d = docs.select("doc_id", measured("text").alias("stats")).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score(F.col("stats")).alias("score"))
    return d.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def keep_good(docs: DataFrame, model: RuleModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score is ``threshold`` or more; columns as they were."""
    stats = free_name(docs, "stats")
    return docs.withColumn(stats, measured("text")).where(model.score(F.col(stats)) >= threshold).drop(stats)
