"""Document fingerprints: 64-bit SimHash, and search within a Hamming radius by permuted block tables. Built-in functions only.

Each word's hash votes on 64 bits with the word's weight. Four bits share one long: sixteen sums of 16-bit lanes hold
all votes of a run of words, so one hash aggregate counts them without Python and without 64 columns a word.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.llm.common import materialise, n_partitions, table

#: Words whose votes share lanes, and the largest weight of a word: their product stays under 2**15.
RUN, MOST = 2000, 16
LANES = 0x0001000100010001
#: Hamming radius of searches, and blocks that a fingerprint is cut into for them.
RADIUS, BLOCKS = 3, 6


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, fp): the SimHash of each key's text, for texts with at least one word. keys must tell rows apart.

    Terms are lower-cased words between white space, each occurrence weighs its length, at most MOST. A bit is set where
    more than half of the weight votes for it.
    """
    words = texts.select(*keys, F.posexplode(F.split(F.lower(F.col(text)), r"[ \t-\r]+")).alias("at", "w")).where("w <> ''")
    weight = F.least(F.length("w"), F.lit(MOST)).cast("long")
    hashed = words.select(*keys, F.floor(F.col("at") / RUN).cast("int").alias("run"), F.xxhash64("w").alias("h"), weight.alias("m"))
    lanes = [F.sum(F.shiftrightunsigned("h", j).bitwiseAND(F.lit(LANES)) * F.col("m")).alias(f"v{j}") for j in range(16)]
    runs = hashed.groupBy(*keys, "run").agg(F.sum("m").alias("m"), *lanes)
    votes = [F.sum(F.shiftrightunsigned(f"v{j}", 16 * lane).bitwiseAND(F.lit(0xFFFF))).alias(f"b{j + 16 * lane}") for lane in range(4) for j in range(16)]
    total = runs.groupBy(*keys).agg(F.sum("m").alias("m"), *votes)
    fp = None
    for b in range(64):
        bit = F.when(F.col(f"b{b}") * 2 > F.col("m"), F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))
        fp = bit if fp is None else fp.bitwiseOR(bit)
    return total.select(*keys, fp.alias("fp"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits, 0 to 1."""
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def block_masks(radius: int = RADIUS, blocks: int = BLOCKS) -> list[int]:
    """A mask for each table: fingerprints within the radius agree on all of blocks - radius blocks of at least one table."""
    cuts = [round(64 * k / blocks) for k in range(blocks + 1)]
    part = [((1 << cuts[k + 1]) - 1) & ~((1 << cuts[k]) - 1) for k in range(blocks)]
    masks = [sum(part[k] for k in c) for c in combinations(range(blocks), blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def search(fps: DataFrame, queries: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(query, fp, distance): every distinct fp of fps within the radius of each distinct fp of queries, itself included.

    Both sides are dealt to one table for each choice of blocks and joined on the blocks' bits; a pair counts in the
    first table where it agrees, so it comes once. Nulls find nothing.
    """
    masks = F.array(*map(F.lit, block_masks(radius, blocks)))
    tabled = lambda df, name: df.where(F.col("fp").isNotNull()).select(F.col("fp").alias(name)).distinct().select(name, F.posexplode(masks).alias("t", "mask")).select(name, "t", F.col(name).bitwiseAND(F.col("mask")).alias("key"))
    x = F.col("query").bitwiseXOR(F.col("fp"))
    first = F.array_position(F.transform(masks, lambda m: x.bitwiseAND(m) == 0), True) - 1
    met = tabled(queries, "query").join(tabled(fps, "fp"), ["t", "key"]).where(F.bit_count(x) <= radius)
    return met.where(first == F.col("t")).select("query", "fp", F.bit_count(x).alias("distance"))


def with_next(df: DataFrame, splits: list[int], order: list[str], take: dict[str, str], firsts: list[tuple]) -> DataFrame:
    """df with `_place` in its bucket and columns of the row that follows by `order` (the first's after the last).

    Rows are cut by splits of order[0] into buckets, one window each; the first rows of every bucket also stand, as
    ghosts, at the end of the bucket before it. firsts: (order[0] of a bucket's first row, the bucket before it).
    """
    steps = [1 << k for k in range(max(1, len(splits)).bit_length() - 1, -1, -1)]
    cuts = F.array(*[F.lit(int(s)) for s in splits]) if splits else F.expr("cast(array() as array<bigint>)")
    bucket = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda low, step: F.when(F.get(cuts, low + step - 1) <= F.col(order[0]), low + step).otherwise(low))
    ghosts = df.sparkSession.createDataFrame(firsts, "_first long, _before int")
    spread = df.withColumn("_bucket", bucket).join(F.broadcast(ghosts.groupBy("_first").agg(F.collect_list("_before").alias("_before"))), F.col(order[0]).eqNullSafe(F.col("_first")), "left").drop("_first")
    own = F.array(F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("ghost")))
    also = F.transform(F.coalesce("_before", F.expr("cast(array() as array<int>)")), lambda b: F.struct(b.alias("b"), F.lit(True).alias("ghost")))
    spread = spread.withColumn("_at", F.explode(F.concat(own, also))).withColumn("_ghost", F.col("_at.ghost")).withColumn("_b", F.col("_at.b"))
    window = Window.partitionBy("_b").orderBy("_ghost", *order)
    spread = spread.select("*", F.row_number().over(window).alias("_place"), *[F.lead(column).over(window).alias(name) for name, column in take.items()])
    return spread.where("not _ghost").drop("_before", "_bucket", "_at", "_ghost", "_b")


def cut_points(ids: DataFrame, column: str, buckets: int) -> tuple[list[int], list[tuple]]:
    """(splits, firsts) for with_next: at most `buckets` numbers each, from quantiles of the ids."""
    splits = sorted({int(x) for x in ids.where(F.col(column).isNotNull()).approxQuantile(column, [k / buckets for k in range(1, buckets)], 0.5 / buckets)}) if buckets > 1 else []
    steps = [1 << k for k in range(max(1, len(splits)).bit_length() - 1, -1, -1)]
    cuts = F.array(*map(F.lit, splits)) if splits else F.expr("cast(array() as array<bigint>)")
    bucket = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda low, step: F.when(F.get(cuts, low + step - 1) <= F.col(column), low + step).otherwise(low))
    rows = ids.groupBy(bucket.alias("b")).agg(F.min(column).alias("low"), F.count(F.when(F.col(column).isNull(), 1)).alias("nulls")).orderBy("b").collect()
    low = [None if r["nulls"] else r["low"] for r in rows]
    return splits, [(low[k], rows[k - 1]["b"]) for k in range(len(rows))]


def edited_pairs(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fp, edited_fp, next_fp) for each row of docs (doc_id long, text).

    Null text is empty; an empty text's fingerprint is 0. Rows follow by doc_id (null first), then by a hash of the
    text; repeated rows follow each other. A single row is followed by itself. An empty table gives no rows.
    """
    buckets = buckets or 8 * n_partitions(docs.sparkSession)
    splits, firsts = cut_points(docs.select("doc_id"), "doc_id", buckets)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = with_next(base, splits, ["doc_id", "tie"], {"next_text": "text"}, firsts)
    rows = rows.withColumn("edited", F.concat(F.expr("substring(text, 1, length(text) - int(floor(length(text) / 2)))"), F.expr("substring(next_text, 1, int(floor(length(text) / 2)))")))
    # _place numbers a bucket's rows in their order: with doc_id it tells repeated rows apart, and equal ones may swap
    keys = ["doc_id", "_place"]
    told = rows.select(*keys, F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256")).alias("told")
    both = rows.select(*keys, F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("t")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("t")))).alias("x")).select(*keys, "x.which", F.col("x.t").alias("text"))
    made = fingerprints(both, [*keys, "which"])
    flat = made.groupBy(*keys).agg(F.max(F.when(F.col("which") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("which") == 1, F.col("fp"))).alias("edited_fp")).alias("flat")
    joined = told.join(flat, (F.col("told._place") == F.col("flat._place")) & F.col("told.doc_id").eqNullSafe(F.col("flat.doc_id")), "left")
    joined = joined.select("told.*", F.coalesce("fp", F.lit(0).cast("long")).alias("fp"), F.coalesce("edited_fp", F.lit(0).cast("long")).alias("edited_fp")).withColumnRenamed("_place", "_was")
    return with_next(joined, splits, ["doc_id", "_was"], {"next_fp": "fp"}, firsts).drop("_was", "_place")


def op2_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Of every document; documents whose id is divisible by 20 also tell how many rows lie within RADIUS of theirs."""
    rows = materialise(edited_pairs(table(spark, sf_dir, "documents").select("doc_id", "text")), "simhash")
    found = search(rows.select("fp"), rows.where("doc_id % 20 = 0").select("fp"))
    counts = rows.groupBy("fp").agg(F.count("*").alias("n"))
    within = found.join(counts, "fp").groupBy("query").agg(F.sum("n").alias("n_within"))
    out = rows.join(within, (rows.fp == within["query"]) & (rows.doc_id % 20 == 0), "left")
    hexed = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        hexed("fp").alias("fingerprint"),
        hexed("edited_fp").alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        "n_within",
    )
