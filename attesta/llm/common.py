"""Small helpers shared by the corpus operators: shared folders, materialised tables, word splitting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes kept as part of a word by `ascii_words`: digits, letters (lower-cased) and everything outside ASCII.
WORD_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. The cluster names it in spark.checkpoint.dir; where that is unset, a new local one
    if all tasks run on this machine, and else an error, since executors wouldn't see each other's files."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="attesta-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _write(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    # small row groups: a task that writes long arrays holds a group of them in memory
    df.write.option("compression", "zstd").option("parquet.block.size", 32 << 20).parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path), path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage at data that survives the loss of executors. The files go
    when the driver ends, since results are read from them."""
    return _write(df, name)[0]


def _forget(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Rows sent to all executors at most; beyond that a join shuffles.
BROADCAST_ROWS = 250_000


def small(df: DataFrame) -> DataFrame:
    """df, a table, marked for broadcast if it has at most BROADCAST_ROWS rows; its rows must be a few numbers each."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def own_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it until df has no such column."""
    while name.lower() in (c.lower() for c in df.columns):
        name = f"_{name}"
    return name


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(column) -> list[bytes]:
    """An Arrow string column as UTF-8 bytes; null becomes empty."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]


def lean(run):
    """run, a function of Arrow batches, as one that gives back at its end what the worker no longer needs. A Python worker serves
    many tasks, and what a large one held otherwise stays with it while an executor's other workers need room."""

    def then_free(batches):
        import ctypes

        import pyarrow as pa

        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim is not None:
            trim(0)

    return then_free


def ascii_words(text: bytes) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased."""
    return text.translate(WORD_TABLE).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star rounds (Kiveris et al. 2014).

    edges: (a, b) long pairs in any order, self-loops ignored. Returns (node, component): component is the smallest
    node of the component. Nodes without edges don't appear. Each round's table goes to the shared folder, so lineage
    stays short and a lost executor costs one round. A star keeps at most one row for each edge, so no round has more
    rows than there are edges; hubs are aggregated with min() before any row is sent to them. Rounds end when the edges
    are stars: every node is either a centre or has one edge to a centre, which is smaller than it.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e, path = _write(e, "cc")
    for _ in range(max_rounds):
        ends = e.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up")))).alias("p")).select("p.*")
        if ends.groupBy("x").agg(F.sum("up").alias("up"), F.min("up").alias("low")).where("up > 1 or (up = 1 and low = 0)").isEmpty():
            break
        # large star: every larger neighbour of x is linked to the smallest neighbour of x (or x itself)
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: every smaller neighbour of x, and x, are linked to the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e, new = _write(star.union(low.select("u", F.col("m").alias("v"))).distinct(), "cc")
        _forget(e.sparkSession, path)
        path = new
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
