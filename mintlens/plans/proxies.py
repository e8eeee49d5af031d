"""Stand-ins: the driver's tables hold no photographs, so plain arithmetic over them exercises the expressions.

The numbers say nothing about cards.  Each stand-in exists as a DataFrame and as SQL for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: column -> expression that Spark and DuckDB both read
CAPTURE = {
    "blur": "CAST((l_partkey % 50) * 8 AS DOUBLE)",
    "brightness": "CAST(60 AS DOUBLE) + l_discount * CAST(1800 AS DOUBLE)",
    "contrast": "CAST(10 AS DOUBLE) + l_tax * CAST(875 AS DOUBLE)",
    "coverage": "floor(l_quantity * CAST(20 AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(1000 AS DOUBLE)",
    "aspect": "CAST(0.6 AS DOUBLE) + CAST(l_suppkey % 25 AS DOUBLE) / CAST(100 AS DOUBLE)",
    "used_fallback": "l_returnflag = 'R'",
    "weak": "l_linestatus = 'O'",
    "best_score": "CAST((l_suppkey % 10) + 1 AS DOUBLE) / CAST(10 AS DOUBLE)",
    "det_conf": "CAST((l_orderkey % 14) + 1 AS DOUBLE) / CAST(14 AS DOUBLE)",
    "edge_conf": "CAST(1 AS DOUBLE) - CAST(l_partkey % 13 AS DOUBLE) / CAST(20 AS DOUBLE)",
    "corner_conf": "CAST(1 AS DOUBLE) - CAST(l_orderkey % 11 AS DOUBLE) / CAST(18 AS DOUBLE)",
    "postwarp_score": "CAST((l_orderkey + l_linenumber) % 20 AS DOUBLE) / CAST(20 AS DOUBLE)",
    "postwarp_valid": "(l_orderkey + l_linenumber) % 20 >= 11",
    "retry": "(l_orderkey + l_linenumber) % 20 < 13",
    "edge_raw": "CAST(l_partkey % 101 AS DOUBLE)",
    "corner_raw": "CAST(l_orderkey % 101 AS DOUBLE)",
    "h_bal": "l_quantity / CAST(50 AS DOUBLE)",
    "v_bal": "CAST(1 AS DOUBLE) - l_tax * CAST(5 AS DOUBLE)",
    "whitening": "l_discount * CAST(100 AS DOUBLE)",
    "surface": "l_quantity / CAST(5 AS DOUBLE)",
    "whitening_conf": "CAST(l_suppkey % 7 AS DOUBLE) / CAST(6 AS DOUBLE)",
    "surface_conf": "CAST(l_partkey % 9 AS DOUBLE) / CAST(8 AS DOUBLE)",
    "edge_ratio": "CAST(l_partkey % 31 AS DOUBLE) / CAST(100 AS DOUBLE)",
    "corner_ratio": "CAST(l_suppkey % 37 AS DOUBLE) / CAST(100 AS DOUBLE)",
    "glare": "CAST(l_partkey % 17 AS DOUBLE) / CAST(400 AS DOUBLE)",
    "texture": "CAST(l_orderkey % 19 AS DOUBLE) / CAST(200 AS DOUBLE)",
    "dark_spots": "CAST(l_suppkey % 23 AS DOUBLE) / CAST(500 AS DOUBLE)",
}
#: A key for results by row; not unique in the data.
KEYS = ("l_orderkey", "l_linenumber", "l_partkey")

LABELLED = {"y_true": "quality", "y_prob": "CAST(n_chars % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE)", "y_pred": "CASE WHEN n_chars % 1000 >= 500 THEN 1 ELSE 0 END"}


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*KEYS, *(F.expr(e).alias(c) for c, e in CAPTURE.items()))


CAPTURES_SQL = f"captures AS (SELECT {', '.join(KEYS)}, {', '.join(f'{e} AS {c}' for c, e in CAPTURE.items())} FROM lineitem)"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return both.select("doc_id", "lang", "source", "toxic", *(F.expr(e).alias(c) for c, e in LABELLED.items()))


LABELLED_SQL = f"labelled AS (SELECT doc_id, lang, source, toxic, {', '.join(f'{e} AS {c}' for c, e in LABELLED.items())} FROM documents JOIN labels USING (doc_id))"


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("p"))


PROFILES_SQL = "profiles AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS p FROM embeddings)"
