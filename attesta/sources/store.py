"""Keyed store of results: Parquet partitioned by kind and by a bucket of the key; the newest row of a key counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attesta.functions.text import result_key

SCHEMA = "name string, extra string, saved_at timestamp, value string, kind string, bucket int"
#: Buckets of a kind. A key's bucket must not change, so neither may this number in a store that exists.
BUCKETS = 64


def latest(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def _key(name: Column, extra: Column) -> Column:
    return result_key(name, F.coalesce(extra, F.lit("")))


def _bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def write_results(rows: DataFrame, path: str) -> None:
    """Append rows (kind, name, extra, saved_at, value); null values aren't stored. A later row of a key replaces earlier ones on reading."""
    kept = rows.where("value is not null").select("name", "extra", "saved_at", "value", "kind", _bucket(_key(F.col("name"), F.col("extra"))).alias("bucket"))
    _append(kept, path)


def _append(rows: DataFrame, path: str) -> None:
    """A bucket's rows are written together, so an append adds a file to each bucket it touches."""
    rows.repartition("kind", "bucket").write.mode("append").partitionBy("kind", "bucket").parquet(path)


def read_results(spark: SparkSession, path: str, kind: str | None = None, name: str | None = None, extra: str = "") -> DataFrame:
    """The newest row of each kind, name (any case) and extra. With kind, only its folder is listed; with name too, only the key's bucket."""
    rows = spark.read.schema(SCHEMA).parquet(path).withColumn("key", _key(F.col("name"), F.col("extra")))
    if kind is not None:
        rows = rows.where(F.col("kind") == kind)
        if name is not None:
            asked = spark.range(1).select(_key(F.lit(name), F.lit(extra)).alias("k")).select("k", _bucket(F.col("k")).alias("b")).first()
            rows = rows.where((F.col("bucket") == asked.b) & (F.col("key") == asked.k))
    return latest(rows, ["kind", "key"], [F.col("saved_at").desc(), "value"]).drop("bucket")


def compact(spark: SparkSession, path: str) -> int:
    """Rewrite each bucket of several files as one with the newest rows of its keys; returns how many files went.

    The newest rows are appended first, and only when that is committed are the files they came from deleted. A run that stops
    anywhere leaves each row in an old file or a new one, or in both, which reads the same; files that others append meanwhile
    aren't touched. The driver sees names of files alone.
    """
    of: dict[str, list[str]] = {}
    for file in spark.read.schema(SCHEMA).parquet(path).inputFiles():
        of.setdefault(file.rsplit("/", 1)[0], []).append(file)
    old = [f for files in of.values() if len(files) > 1 for f in files]
    if old:
        rows = spark.read.schema(SCHEMA).option("basePath", path).parquet(*old).withColumn("key", _key(F.col("name"), F.col("extra")))
        _append(latest(rows, ["kind", "bucket", "key"], [F.col("saved_at").desc(), "value"]).drop("key"), path)
        delete(spark, old)
    return len(old)


def delete(spark: SparkSession, files: list[str]) -> None:
    for file in files:
        where = spark._jvm.org.apache.hadoop.fs.Path(file)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, False)


def inventory(rows: DataFrame) -> DataFrame:
    return rows.groupBy("kind").agg(F.count("*").alias("n"))


def missing(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """Requests whose key isn't stored yet."""
    return requests.join(stored.select("kind", "key"), ["kind", "key"], "left_anti")
