"""The ``opN_*`` queries over whole tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, decontam, fim, langid, licences, minhash, oracles, phrases, quality, secrets, sharding, simhash, urls
from .common import read


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.scores(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_sharding": lambda spark, sf_dir: sharding.shard_documents(read(spark, sf_dir, "documents")),
    "op2_secret_scans": lambda spark, sf_dir: secrets.digest(read(spark, sf_dir, "documents")),
    "op3_simhash": lambda spark, sf_dir: simhash.near_duplicates(read(spark, sf_dir, "documents")),
    "op4_licences": lambda spark, sf_dir: licences.digest(read(spark, sf_dir, "documents")),
    "op5_quality": quality_scores,
    "op6_nearest": lambda spark, sf_dir: ann.nearest(read(spark, sf_dir, "embeddings")),
    "op7_decontamination": lambda spark, sf_dir: decontam.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")),
    "op8_url_filters": lambda spark, sf_dir: urls.digest(read(spark, sf_dir, "pages")),
    "op9_languages": lambda spark, sf_dir: langid.identify(read(spark, sf_dir, "pages"), langid.train(read(spark, sf_dir, "documents"))),
    "op10_bpe": lambda spark, sf_dir: bpe.digest(read(spark, sf_dir, "documents"), vocabulary_path()),
    "op11_minhash": lambda spark, sf_dir: minhash.near_duplicates(read(spark, sf_dir, "documents")),
    "op12_phrases": lambda spark, sf_dir: phrases.collocations(read(spark, sf_dir, "documents")),
    "op13_fill_in_middle": lambda spark, sf_dir: fim.digest(read(spark, sf_dir, "documents")),
}

ORACLES: dict[str, str] = {
    "op2_secret_scans": oracles.secrets_sql(),
    "op4_licences": licences.ORACLE_SQL,
    "op6_nearest": oracles.nearest_sql(),
    "op7_decontamination": oracles.decontamination_sql(),
    "op8_url_filters": oracles.urls_sql(),
    "op12_phrases": oracles.phrases_sql(),
    "op13_fill_in_middle": oracles.fim_sql(),
}
