"""Running totals and batches over groups of any size: no group goes through one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.sources.scratch import written

#: Rows of a group that one step of a batch search holds.
CHUNK = 4096


def running(rows: DataFrame, by: list[str], order: list, **sums: Column) -> DataFrame:
    """rows with a column for each of sums: its total over the rows of the group so far, this one included, in order.

    A scan in two levels. Rows are dealt by range over (by, order), so a group lies in as many parts as it fills; the parts'
    totals, a row for each part and group, are summed over the parts before; then every part is finished by itself. The dealt rows
    are written once, so that both levels see the same parts: give narrow rows where there are many. Rows that are equal in order
    are taken in any order. Null keys are a group; a null adds nothing. An empty table gives no rows.
    """
    spark = rows.sparkSession
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    added = {f"_add_{k}": F.coalesce(v, F.lit(0)) for k, v in sums.items()}
    dealt = rows.withColumns(added).repartitionByRange(n, *[F.col(c) for c in by], *keys)
    dealt = written(dealt.withColumn("_part", F.spark_partition_id()), "scan").withColumn("_group", F.struct(*by) if by else F.struct(F.lit(0)))
    totals = dealt.groupBy("_group", "_part").agg(*[F.sum(c).alias(c.replace("_add_", "_of_")) for c in added])
    before = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_group", "_part", *[F.coalesce(F.sum(f"_of_{k}").over(before), F.lit(0)).alias(f"_before_{k}") for k in sums])
    here = Window.partitionBy("_group", "_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.join(totals, ["_group", "_part"])
    return out.withColumns({k: F.col(f"_before_{k}") + F.sum(f"_add_{k}").over(here) for k in sums}).select(*rows.columns, *sums)


def numbered(rows: DataFrame, by: list[str], order: list, name: str) -> DataFrame:
    """rows with their place in the group, from 1."""
    return running(rows, by, order, **{name: F.lit(1).cast("long")})


def successors(sizes: np.ndarray, budget: int, most: int) -> np.ndarray:
    """For each row, where the next batch begins if one begins here: by binary search over the prefix sums."""
    total = np.concatenate(([0], np.cumsum(sizes)))
    at = np.arange(len(sizes))
    return np.clip(np.searchsorted(total, total[:-1] + budget, side="right") - 1, at + 1, at + most)


def leave(follow: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the batches from each row on first begin beyond `own`, and how many begin before: by pointer doubling."""
    beyond = np.arange(len(follow) + 1 + int(follow.max(initial=0)))
    jump = beyond.copy()
    jump[:own] = follow[:own]
    count = (beyond < own).astype(np.int64)
    while (jump < own).any():
        count, jump = count + count[jump], jump[jump]
    return jump[: len(follow)], count[: len(follow)]


def starts(follow: np.ndarray, own: int, first: int) -> np.ndarray:
    """Rows before `own` where a batch begins, if one begins at `first`: by pointer doubling."""
    found, jump = np.array([first] if first < own else [], np.int64), np.concatenate((np.minimum(follow[:own], own), [own]))
    while len(found) and jump[found[0]] < own:
        found, jump = np.concatenate((found, (more := jump[found])[more < own])), jump[jump]
    return np.sort(found)


def _lists(column) -> list[np.ndarray]:
    """The lists of an Arrow list column, as arrays."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[a - ends[0] : b - ends[0]] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _entries(chunks: DataFrame, most: int) -> DataFrame:
    """(_group, _chunk, first, before): where the first batch of each chunk begins and how many batches began before it.

    chunks: (_group, _chunk, pass), pass[k] = (k, n): from a batch at row k of this chunk on, n batches begin in it, and the first
    in the next chunk at its row k. Successors of 1, 2, 4, ... chunks are made by joining the table to itself, as often as the
    logarithm of the most chunks of a group.
    """
    top = chunks.agg(F.max("_chunk").alias("n")).first().n or 0
    known = chunks.where("_chunk = 0").select("_group", "_chunk", F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("before"))
    step = 1
    while step <= top:
        near = known.join(chunks, ["_group", "_chunk"]).withColumn("x", F.get("pass", F.col("first").cast("int")))
        near = near.select("_group", (F.col("_chunk") + step).alias("_chunk"), F.col("x.k").alias("first"), (F.col("before") + F.col("x.n")).alias("before"))
        known = written(known.unionByName(near), "entries")
        if 2 * step <= top:
            after = chunks.select("_group", (F.col("_chunk") - step).alias("_chunk"), F.col("pass").alias("then"))
            both = F.transform("pass", lambda x: F.struct(F.get("then", x["k"].cast("int"))["k"].alias("k"), (x["n"] + F.get("then", x["k"].cast("int"))["n"]).alias("n")))
            chunks = written(chunks.join(after, ["_group", "_chunk"]).select("_group", "_chunk", both.alias("pass")), "passes")
        step *= 2
    return known.where(F.col("first").isNotNull())


def batches(rows: DataFrame, by: list[str], order: list, size: Column, budget: int, most: int, chunk: int = CHUNK) -> DataFrame:
    """rows (one of each by and order) with batch_no, from 0: in order, a new batch begins when the next row doesn't fit in size or number.

    Where a batch ends is found from where it begins, so batches are paths over rows. A group is cut into chunks of rows; in each,
    the end of every path is found by pointer doubling over successors, and chunks are joined to chunks the same way, so a
    group is spread over tasks and a task holds a chunk. Null sizes and those under 0 count as 0; a row over the budget is a batch of its own.
    """
    chunk = max(chunk, most)
    placed = written(numbered(rows.withColumn("_size", F.greatest(F.coalesce(size, F.lit(0)).cast("long"), F.lit(0))), by, order, "_place"), "placed")
    place = F.col("_place") - 1
    placed = placed.withColumn("_group", F.struct(*by) if by else F.struct(F.lit(0))).withColumn("_chunk", F.floor(place / chunk)).withColumn("_at", (place % chunk).cast("int"))
    own = F.struct(F.col("_chunk").alias("c"), F.col("_at").alias("at"), F.col("_size").alias("size"))
    # the first rows of a chunk stand behind the chunk before it too, for batches that run on
    behind = F.struct((F.col("_chunk") - 1).alias("c"), (F.col("_at") + chunk).alias("at"), F.col("_size").alias("size"))
    shown = placed.select("_group", F.explode(F.when((F.col("_chunk") > 0) & (F.col("_at") < most - 1), F.array(own, behind)).otherwise(F.array(own))).alias("x"))
    chunks = shown.groupBy("_group", F.col("x.c").alias("_chunk")).agg(F.transform(F.array_sort(F.collect_list(F.struct("x.at", "x.size"))), lambda x: x["size"]).alias("sizes"))
    group = chunks.schema["_group"].dataType.simpleString()

    def passes(parts: Iterator) -> Iterator:
        import pyarrow as pa

        for part in parts:
            made = []
            for sizes in _lists(part.column(2)):
                to, n = leave(successors(sizes, budget, most), min(chunk, len(sizes)))
                made.append([{"k": int(k) - chunk, "n": int(x)} for k, x in zip(to[:most], n[:most], strict=True)])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(made, pa.list_(pa.struct([("k", pa.int64()), ("n", pa.int64())])))], names=["_group", "_chunk", "pass"])

    def marks(parts: Iterator) -> Iterator:
        import pyarrow as pa

        for part in parts:
            made = []
            for sizes, first, before in zip(_lists(part.column(2)), part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True):
                n = min(chunk, len(sizes))
                made.append(before - 1 + np.searchsorted(starts(successors(sizes, budget, most), n, first), np.arange(n), side="right"))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(made, pa.list_(pa.int64()))], names=["_group", "_chunk", "numbers"])

    found = _entries(written(chunks.mapInArrow(passes, f"_group {group}, _chunk long, pass array<struct<k: long, n: long>>"), "passes"), most)
    told = chunks.join(found, ["_group", "_chunk"]).mapInArrow(marks, f"_group {group}, _chunk long, numbers array<bigint>")
    told = told.select("_group", "_chunk", F.posexplode("numbers").alias("_at", "batch_no"))
    return placed.join(told, ["_group", "_chunk", "_at"]).select(*rows.columns, F.col("batch_no").cast("int").alias("batch_no"))
