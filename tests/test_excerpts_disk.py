"""What excerpts and evidence shuffle: documents once, no words of rows."""

from __future__ import annotations

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from attesta.operators import corpus as C
from attesta.operators import extract as D

TEXT = "The thing that thon said in the first of the lines here is long enough to count as one of its own, as it should be, of course.\nA short line of anea.\nA short line of anea.\nAna Pop ought to be found here, ANEA too, să fie.\n\nănea is Anea here"
VARIANTS = [(1, "thon"), (1, "anea"), (2, "ana pop"), (2, "anea"), (3, "pop ana"), (4, "pop"), (4, "ana"), (5, "-")]


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def shuffled(spark, tmp_path, name):
    spark.createDataFrame([(1, TEXT)], "doc_id long, text string").write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    return re.findall(r"Exchange hashpartitioning\(([^)]*), \d+\), (\w+)", plan(__spark_entry__.queries()[name](spark, str(tmp_path))))


@pytest.mark.parametrize("name", ["a8_report", "d8_mention_excerpts", "d6_evidence", "d7_funding", "d6_evidence_full"])
def test_words_are_not_shuffled(spark, tmp_path, name):
    """Spark doesn't know the size of a table from the driver, so names have to be sent to the rows by hint."""
    told = shuffled(spark, tmp_path, name)
    assert told and not [x for x, _ in told if "_word" in x or re.fullmatch(r"doc_id#\d+L?, _h#\d+L?", x)]
    assert not [x for x, how in told if re.fullmatch(r"doc_id#\d+L?", x) and how != "REPARTITION_BY_COL"]


def test_paragraphs_as_from_blocks(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, None), (3, ""), (4, "ÎN țară se află multe lucruri\nIn tara se afla multe lucruri\nla sfârșit altele, mai multe")], "doc_id long, text string")
    blocks = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    want = D.neighbours(C.paragraphs(blocks, "doc_id"))
    got = C.text_paragraphs(docs, near=True).select(*want.columns)
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() == 5
    assert C.text_paragraphs(docs).columns == ["doc_id", "pos", "text", "norm"]


def test_many_variants_name_the_same_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(1, TEXT)], "doc_id long, text string")
    variants = spark.createDataFrame(VARIANTS, "entity_id long, variant string")
    rows = C.text_paragraphs(docs)
    few = sorted(D.named_rows(rows, variants).collect())
    monkeypatch.setattr(D, "AUTOMATON_BYTES", 0)
    assert sorted(D.named_rows(rows, variants).collect()) == few
    assert sorted({(r.entity_id, r.pos) for r in few}) == [(1, 0), (1, 1), (1, 3), (2, 1), (2, 3), (4, 3)]
