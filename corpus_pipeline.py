"""The corpus pipeline: toxic documents go, one document of each group of near copies stays, contaminated ones go, personal data
is replaced, and what is left is packed.

All stages but the last return the columns of their docs, other columns too, whatever they are called. Texts may be null, empty
or of any length, ids may be null or repeat, and tables may be empty; each stage says what happens then."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attesta.llm import decontaminate, ngram_join, packing, pii, toxicity
from attesta.llm.common import materialise, table


def no_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold. Null and empty texts have the score of a text without features. Each row is
    scored by itself, repeated ones too. Without labels nothing is learnt, and all documents stay."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies; of its repeated rows one. Documents without words (null
    and empty ones, however many) all stay, and so do those of a group in which no row has an id."""
    return ngram_join.keep_one(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated. Null and empty texts have no words and stay; without items all stay. Repeated rows
    are judged one by one."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def no_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates in their texts and n_chars of the new text. Null and empty texts stay as they are;
    repeated rows get the same surrogates."""
    return pii.pseudonymise(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a sequence. A null or empty text is the end token alone; repeated rows are packed each. Only
    doc_id and text are read."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", no_toxic), ("ngram_join", no_near_copies), ("decontamination", no_benchmark), ("pii", no_personal_data), ("packing", packed)]

#: A fitted model, similarity classes and a tokenizer aren't SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
