"""Sentences whose ends are digits or rare blanks, against the queries' SQL."""

from __future__ import annotations

import pytest

import __spark_entry__

DOCS = [
    (1, "Thon said that in the year of 2010\n1 that thon was tion here. That anea was able 21. The idiot erin is 33.1.2.101"),
    (2, " A thon and that idiot in one place.\u3000\n0 that is the second line of thon 0"),
    (3, "That thon is here and it is tion! 1 The rest is thon with that 1"),
]


def rows(spark, tmp_path, name):
    """A query's rows over DOCS, and its SQL's."""
    duckdb = pytest.importorskip("duckdb")
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(DOCS, "doc_id long, text string").write.parquet(path)
    got = __spark_entry__.queries()[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{path}/*.parquet'")
    found = con.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(got.columns)
    return sorted(map(tuple, got.select(*columns).collect())), sorted(found.fetchall())


def test_sentences_keep_digits_at_their_ends(spark, tmp_path):
    got, want = rows(spark, tmp_path, "b13_split_sentences_v1")
    assert got == want


def test_opinion_rows_keep_digits_at_their_ends(spark, tmp_path):
    got, want = rows(spark, tmp_path, "d15_opinion_rows")
    assert got == want and len(got) > 5


def test_opinions_keep_digits_at_their_ends(spark, tmp_path):
    got, want = rows(spark, tmp_path, "d15_opinions")
    assert got == want
    assert any(r[4].endswith("33.1.2.101") for r in got)
