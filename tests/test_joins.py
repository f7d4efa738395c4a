"""Joins that avoid hot keys, against comparisons of all pairs."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from attesta.operators import extract as D
from attesta.operators import quiz as G
from attesta.operators import responses as R


def test_promises_meet_later_sentences(spark):
    random.seed(4)
    words = [f"cuvant{chr(97 + k)}{k % 7}x" for k in range(30)]
    stem = [f"stem{chr(97 + k // 5)}{chr(97 + k % 5)}" for k in range(30)]
    text = lambda n, tail: " ".join([*random.choices(stem[:6], k=n // 2), *random.choices(stem, k=n - n // 2)]) + tail
    day = lambda: random.choice([None, *(dt.date(2020, 1, 1) + dt.timedelta(days=k * 45) for k in range(12))])
    promises = [(random.choice("aaab"), k, k % 9, day(), text(random.choice([2, 4, 8]), ".")) for k in range(60)]
    sents = [(random.choice("aaab"), k, k % 11, day(), text(random.choice([2, 4, 8]), random.choice([" done.", " failed.", "."]))) for k in range(120)]
    stems = lambda t: {w[:6] for w in t.replace(".", "").split() if len(w) >= 6} - {"failed"}
    assert words and all(len(x) == 6 for x in stem)
    want = {}
    for e, i, doc, d, t in promises:
        own, n = stems(t), {"kept": 0, "broken": 0}
        for f, _, other, when, u in sents:
            said = "broken" if " failed" in u else "kept" if " done" in u else None
            if said and e == f and doc != other and (d is None or when is None or when >= d) and len(own & stems(u)) >= (3 if len(own) >= 6 else 2):
                n[said] += 1
        want[e, i] = (n["kept"], n["broken"])
    p = spark.createDataFrame(promises, "entity_id string, promise_id int, doc_id int, date date, text string")
    s = spark.createDataFrame(sents, "entity_id string, sent_id int, doc_id int, date date, text string")
    got = D.judge_promises(p, s, kept=r"\bdone\b", broken=r"\bfailed\b").collect()
    assert {(r.entity_id, r.promise_id): (r.n_kept, r.n_broken) for r in got} == want and sum(map(sum, want.values())) > 100
    status = {(True, True): "partial", (True, False): "kept", (False, True): "broken", (False, False): "unverifiable"}
    assert all(r.status == status[r.n_kept > 0, r.n_broken > 0] for r in got)
    pairs = D.shared_stems(*(x.limit(0) for x in (p.select("entity_id", "promise_id", F.lit(1).alias("p_doc"), F.col("date").alias("p_date"), F.lit(2).alias("need"), D.topic_stems(F.col("text")).alias("stems")), s.select("entity_id", "sent_id", F.lit(1).alias("s_doc"), F.col("date").alias("s_date"), F.lit("kept").alias("outcome"), D.topic_stems(F.col("text")).alias("stems")))))
    assert pairs.count() == 0


def test_positions_by_blocks(spark):
    random.seed(5)
    table = lambda ids: [(i, x, random.choice([None, *map(float, range(0, 101, 5))])) for i in ids for x in range(10) if random.random() < 0.6]
    a, b = table(range(40)), table([f"p{k}" for k in range(23)])
    of = lambda rows: {i: {x: v for j, x, v in rows if j == i and v is not None} for i, _, _ in rows}
    want = {}
    for i, own in of(a).items():
        for j, other in of(b).items():
            gaps = [abs(own[x] - other[x]) for x in own.keys() & other.keys()]
            if gaps:
                want[i, j] = (len(gaps), float(int(100 - sum(gaps) / len(gaps) + 0.5)), sum(g >= 30 for g in gaps))
    left, right = spark.createDataFrame(a, "subject_id long, axis_id int, value double"), spark.createDataFrame(b, "subject_id string, axis_id int, value double")
    for block in (5, 50_000):
        got = {(r.a_id, r.b_id): (r.compared, r.match, r.n_major) for r in G.compare_positions(left, right, block=block).collect()}
        assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) <= 1 and got[k][2] == want[k][2] for k in want)
        best = {}
        for i in {i for i, _ in got}:
            order = sorted((-m, j) for (k, j), (n, m, _) in got.items() if k == i and n >= 3)
            best |= {(i, j): r for r, (_, j) in enumerate(order[:4], 1)}
        assert {(r.a_id, r.b_id): r["rank"] for r in G.top_matches(left, right, 4, block=block).collect()} == best
    assert G.compare_positions(left, right.limit(0)).count() == 0 and G.top_matches(left.limit(0), right, 3).count() == 0
    assert "axis_id" not in G.compare_positions(left, right)._jdf.queryExecution().executedPlan().toString().split("hashpartitioning(part")[0]


def test_few_pieces_are_compared_with_a_quote(spark):
    random.seed(6)
    vocabulary = ["".join(random.choices("abcdefghijklmnoprstuvz", k=random.randint(2, 9))) for _ in range(400)]
    sentence = lambda: " ".join(random.choices(vocabulary, k=random.randint(6, 14))).capitalize() + "."
    rows = []
    for k in range(60):
        sents = [sentence() for _ in range(60)]
        spoiled = list(sents[30])
        for at in random.sample(range(len(spoiled)), 4):
            spoiled[at] = "q"
        rows.append((k, "".join(spoiled), " ".join(sents)))
    df = spark.createDataFrame(rows, "k int, quote string, text string")
    from attesta.functions.text import norm_words

    n = df.select(F.sum(F.size(R.candidates(norm_words(F.col("quote")), F.col("text"))))).first()[0]
    assert n <= 0.01 * 60 * 120 * 2
    claims = df.select(F.col("k").alias("finding_id"), F.lit(0).alias("passage_order"), "quote", "text", F.lit(None).cast("string").alias("context"))
    assert R.locate_quotes(claims).count() == 60


def test_values_of_statuses(spark):
    rows = spark.createDataFrame([("kept",), ("partial",), ("broken",), ("unverifiable",), (None,)], "s string")
    assert [r.v for r in rows.select(D.status_value(F.col("s")).alias("v")).collect()] == [1.0, 0.5, 0.0, None, None]
