"""The corpus queries against their SQL in DuckDB, on the tables and on rows at the limits."""

import random

import duckdb
import pandas as pd
import pytest

from mintlens.llm import decontam, oracles, queries, secrets, urls

SF = "/root/testdata/sf0.01"


def rows(df):
    cols = sorted(df.columns)
    plain = lambda v: None if pd.isna(v) else int(v) if isinstance(v, float) and v.is_integer() else v
    return sorted(repr(tuple(plain(v) for v in r)) for r in df[cols].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), db.sql(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) > 0 and rows(got) == rows(want)


def test_odd_secrets_match_sql(spark, tmp_path):
    random.seed(23)
    parts = ["password", "PassWD", "secret", "\u017fecret", "token", "to\u212aen", "apikey", "API_KEY", '"', "'", " ", "=", ":", "abc", "abcdef", "AKIA", "AKIAAKIA", "ABCDEFGHIJ0123456789", "0123456789ab", "é", "\n"]
    texts = [None, "", *("".join(random.choices(parts, k=14)) for _ in range(500))]
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, "token=abcdef"), (1, "token=abcdef")], "doc_id bigint, text string")
    df.write.parquet(str(tmp_path / "d"))
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    want = db.sql(oracles.secrets_sql()).df()
    assert rows(secrets.digest(df).toPandas()) == rows(want) and want["n_assign"].sum() > 50 and want["n_hex"].sum() > 5


def test_odd_urls_and_leaks_match_sql(spark, tmp_path):
    pages = [None, "", "x", "http://com", "http://com/", "https://EXAMPLE.com/en/", "a://b.net/fr/x?y#z", "://net/es/", "http://www.example.com/en", "http://www.example.com/en/"]
    spark.createDataFrame([*enumerate(pages), (None, pages[5]), (3, pages[6])], "page_id bigint, url string").write.parquet(str(tmp_path / "p"))
    docs = [(0, None), (1, ""), (2, "One two, three FOUR five six"), (2, "one two three four five six seven"), (None, "one two three four five"), (4, "short"), (5, "éa ßb " * 40)]
    items = [(0, "one two three four five six"), (1, "Short!"), (2, None), (2, "éa ßb éa ßb éa"), (None, "two three four five six")]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(str(tmp_path / "d"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "b"))
    db = duckdb.connect()
    for name, folder in (("pages", "p"), ("documents", "d"), ("benchmark", "b")):
        db.sql(f"create view {name} as select * from '{tmp_path}/{folder}/*.parquet'")
    frame = {x: spark.read.parquet(str(tmp_path / x)) for x in "pdb"}
    assert rows(urls.digest(frame["p"]).toPandas()) == rows(db.sql(oracles.urls_sql()).df())
    assert rows(decontam.leaks(frame["d"], frame["b"]).toPandas()) == rows(db.sql(oracles.decontamination_sql()).df())
