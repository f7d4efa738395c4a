"""Small dimensions: entities, axes, items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions.text import fold, name_variants, slug

#: Fixed values, in order.
AXES = ["geopolitics", "identity", "economy", "governance", "system", "structure", "energy", "services", "minorities", "labor"]


def load_entities(rows: DataFrame) -> DataFrame:
    """rows (name, alias) with entity_id (folded name, "-" for blanks), short (first word of the alias, else initials) and variants."""
    words = F.split(F.trim("name"), r"\s+")
    initials = F.array_join(F.transform(words, lambda w: F.upper(F.substring(w, 1, 1))), "")
    short = F.coalesce(F.nullif(F.get(F.split(F.coalesce("alias", F.lit("")), r"\s+"), 0), F.lit("")), initials)
    alias = F.when(F.col("alias").isNotNull(), F.array("alias")).otherwise(F.expr("cast(array() as array<string>)"))
    return rows.withColumn("entity_id", slug(F.col("name"))).withColumn("short", short).withColumn("variants", name_variants(F.col("name"), alias))


def variants(entities: DataFrame) -> DataFrame:
    """(entity_id, variant), folded."""
    return entities.select("entity_id", F.explode("variants").alias("v")).select("entity_id", fold(F.col("v")).alias("variant")).distinct()


def axes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, k) for k, a in enumerate(AXES)], "axis_id string, axis_no int")


def load_items(spark: SparkSession, path: str) -> DataFrame:
    """(item_id, axis_id, direction, item_no) from a CSV file with these columns."""
    return spark.read.schema("item_id string, axis_id string, direction int, item_no int").option("header", True).csv(path)


def load_correlations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("ax_i string, ax_j string, r double").option("header", True).csv(path)
