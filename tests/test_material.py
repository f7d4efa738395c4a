"""Material of a document that is cut at the blank line behind a paragraph."""

from __future__ import annotations

import pytest

import __spark_entry__


@pytest.mark.parametrize("size", [2997, 2998, 2999, 3000])
def test_cut_in_the_blank_line(spark, tmp_path, size):
    """No paragraph with the name fits, so the first 3000 characters count, those of a blank line too."""
    duckdb = pytest.importorskip("duckdb")
    path = str(tmp_path / "documents.parquet")
    text = "a" * size + "\n" + "thon " + "b" * 3000 + "\nthe last of the lines"
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(path)
    got = __spark_entry__.queries()["f22_material"](spark, str(tmp_path)).select("doc_id", "h").collect()
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{path}/*.parquet'")
    assert list(map(tuple, got)) == con.execute(__spark_entry__.oracle_sql()["f22_material"]).fetchall()
