"""Every registered query against its SQL in DuckDB."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from mintlens.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(df):
    cols = sorted(df.columns)
    norm = lambda v: None if pd.isna(v) else int(v) if isinstance(v, float) and v.is_integer() else v
    return sorted(repr(tuple(norm(v) for v in r)) for r in df[cols].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_matches_sql(spark, db, name):
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), db.sql(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


@pytest.mark.parametrize("name", ["detect_warp", "train_predict", "batch_inference", "sequence_similarity"])
def test_queries_without_sql_give_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry_is_the_status_distribution(spark):
    assert {r.analysis_status: r["count"] for r in entry.entry(spark).collect()} == {"invalid_capture": 5145, "valid_with_warning": 777, "valid": 78}


def test_entry_works_without_the_corpus_operators(monkeypatch):
    monkeypatch.setattr(entry, "corpus", None)
    assert set(entry.queries()) == set(catalogue.QUERIES) and set(entry.oracle_sql()) == set(catalogue.ORACLES)


def test_batch_inference_prices_every_part(spark):
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    assert sorted(r.query_id for r in catalogue.QUERIES["batch_inference"](spark, "/root/testdata/sf0.001").collect()) == sorted(r.p_partkey for r in part.collect())


def test_candidates_for_parts_of_words(spark):
    from mintlens.operators import ranking

    names = ["Mewtwo", "mew", "Mr. Mime", "mime jr", "a", "", None, "Äbra x", "charizard ex"]
    rows = spark.createDataFrame([(n, x, "s", "1") for n, x in enumerate(names)], "id int, name string, set_name string, number string")
    asked = ["mewt", "mew", "ime", "R. m", "a", "x", " EX ", "", "none", "äb", None]
    queries = spark.createDataFrame([(n, x, "", "") for n, x in enumerate(asked)], "query_id int, q_name string, q_set string, q_number string")
    want = {}
    for n, q in enumerate((x or "").strip().lower() for x in asked):
        found = [(0 if (x or "").lower() == q else 1, k) for k, x in enumerate(names) if q and q in (x or "").lower()]
        if found:
            want[n] = min(found)[1]
    assert {r.query_id: r.id for r in ranking.best_candidate(queries, rows).collect()} == want
