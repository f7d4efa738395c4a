"""Scans and batches over groups that are cut into parts and chunks, against plain walks."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from attesta.operators import extract as D
from attesta.operators import responses as R
from attesta.operators import scans as S


@pytest.fixture(scope="module")
def rows():
    random.seed(1)
    return [(random.choice([1, 1, 1, 2, None]), k, random.choice([None, 0, 5, 30, 70, 200])) for k in range(600)]


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def test_running_totals_of_a_hot_group_and_null_keys(spark, rows):
    got = S.running(spark.createDataFrame(rows, "g int, k int, size int"), ["g"], ["k"], n=F.lit(1), t=F.col("size")).collect()
    want, so_far = {}, {}
    for g, k, s in in_order(rows):
        n, t = so_far.get(g, (0, 0))
        want[g, k] = so_far[g] = (n + 1, t + (s or 0))
    assert len(got) == len(rows) and {(r.g, r.k): (r.n, r.t) for r in got} == want


def test_a_group_lies_in_several_parts(spark):
    parts = S.running(spark.range(1000).withColumn("g", F.lit(1)), ["g"], [F.col("id").desc()], n=F.lit(1))
    assert {(r.id, r.n) for r in parts.collect()} == {(k, 1000 - k) for k in range(1000)}


def walk(rows, budget, most):
    out, now = {}, {}
    for g, k, s in in_order(rows):
        b, used, n = now.get(g, (0, 0, 0))
        if n and (used + (s or 0) > budget or n >= most):
            b, used, n = b + 1, 0, 0
        now[g], out[g, k] = (b, used + (s or 0), n + 1), b
    return out


@pytest.mark.parametrize(("budget", "most", "chunk"), [(100, 8, 8), (100, 3, 8), (250, 8, 16), (100, 1, 4), (1000, 8, 4096), (10**9, 8, 32)])
def test_batches_of_chunks(spark, rows, budget, most, chunk):
    got = S.batches(spark.createDataFrame(rows, "g int, k int, size int"), ["g"], ["k"], F.col("size"), budget, most, chunk).collect()
    assert len(got) == len(rows) and {(r.g, r.k): r.batch_no for r in got} == walk(rows, budget, most)


def test_ranks_and_lines_of_one_hot_entity(spark):
    rows = spark.range(500).select(F.lit("e").alias("entity_id"), "id", (F.col("id") % 7).alias("x"))
    order = sorted(range(500), key=lambda k: (-(k % 7), k))
    got = {r.id: r["rank"] for r in D.rank_by(rows, F.col("x").desc(), F.col("id")).collect()}
    assert got == {k: n for n, k in enumerate(order, 1)}
    top = {r.id: r["rank"] for r in D.rank_by(rows, F.col("x").desc(), F.col("id"), top=5).collect()}
    assert top == {k: n for n, k in enumerate(order[:5], 1)}
    assert {r.id for r in R.fit_lines(rows, "entity_id", F.col("x"), 100, ["id"]).collect()} == {k for k in range(500) if sum(j % 7 + 1 for j in range(k + 1)) <= 100}


def test_empty(spark):
    none = spark.createDataFrame([], "g long, k long, size long")
    assert S.running(none, ["g"], ["k"], n=F.lit(1)).count() == 0
    assert S.batches(none, ["g"], ["k"], F.col("size"), 10, 8).count() == 0
