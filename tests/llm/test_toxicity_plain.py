"""Toxicity against a plain FTRL over plainly made features."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from attesta.llm import toxicity
from tests.llm.plain import lower

MASK = (1 << 64) - 1


def plain_features(text: str | None) -> list[int]:
    """Words, their first 4, 5 and 6 bytes, pairs of neighbours, and pairs with a word between, as numbers of the space."""
    import xxhash

    one, two, skip = map(int, (toxicity.FIRST, toxicity.SECOND, toxicity.SKIP))
    words = [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))]
    h = [xxhash.xxh64_intdigest(w) for w in words]
    found = [x * one for x in h] + [xxhash.xxh64_intdigest(w[:k], seed=k) * one for w in words for k in (4, 5, 6)]
    found += [a * one + b * two for a, b in zip(h, h[1:], strict=False)] + [a * one + b * skip for a, b in zip(h, h[2:], strict=False)]
    return sorted({((x & MASK) ^ ((x & MASK) >> 31)) % toxicity.SPACE for x in found})


def plain_model(rows: list[tuple[str, int]]):
    """weight(feature) after the passes, the bias being feature -1."""
    z, n = {}, {}

    def weight(i: int) -> float:
        l1, own = (0.0 if i == -1 else toxicity.L1), z.get(i, 0.0)
        return 0.0 if abs(own) <= l1 else (math.copysign(l1, own) - own) / ((toxicity.BETA + math.sqrt(n.get(i, 0.0))) / toxicity.ALPHA + toxicity.L2)

    made = [([*plain_features(t), -1], y) for t, y in rows]
    for p in range(toxicity.PASSES):
        for j in np.random.default_rng(p).permutation(len(made)):
            features, y = made[j]
            w = {i: weight(i) for i in features}
            g = 1 / (1 + math.exp(-max(-35, min(35, sum(w.values()))))) - y
            for i in features:
                before = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / toxicity.ALPHA * w[i]
                n[i] = before + g * g
    return weight


@pytest.fixture(scope="module")
def rows():
    random.seed(12)
    mild, rude = [f"word{k}" for k in range(60)], ["fool", "scum", "idiöt"]
    texts = [" ".join(random.choices(mild, k=random.randint(0, 30)) + (random.choices(rude, k=2) if k % 5 == 0 else [])) for k in range(160)]
    return [(k, t, int(k % 5 == 0)) for k, t in enumerate(texts)] + [(500, None, 0), (501, "", 0), (502, "FOOL scum, fool!", None)]


def test_features(rows):
    hashed = toxicity.Hasher()
    for _, t, _ in rows:
        assert hashed((t or "").encode()).tolist() == plain_features(t)


def test_scores_are_those_of_a_plain_fit(spark, rows):
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    order = [r.doc_id for r in docs.join(labels.where("toxic is not null"), "doc_id").where(~toxicity.held_out()).orderBy(F.xxhash64("doc_id")).select("doc_id").collect()]
    of = {k: (t, y) for k, t, y in rows}
    weight = plain_model([of[k] for k in order])
    got = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    for k, t, _ in rows:
        total = sum(map(weight, plain_features(t))) + weight(-1)
        assert got[k] == pytest.approx(1 / (1 + math.exp(-max(-35, min(35, total)))), abs=1e-4)
    assert got[502] > 0.5 > got[501]


def test_a_row_over_the_bound_of_features_leaves_no_model(spark, rows, monkeypatch):
    """Rows are taken while their features fit; a first row over the bound leaves the model empty, and every score next to 0."""
    monkeypatch.setattr(toxicity, "FIT_FEATURES", 3)
    docs = spark.createDataFrame([(4, "one two three four five"), (8, "one")], "doc_id long, text string")
    labels = spark.createDataFrame([(4, 1), (8, 1)], "doc_id long, toxic int")
    used, weights, bias = toxicity.fit(docs, labels)
    assert len(used) == len(weights) == 0 and bias == toxicity.NOTHING
