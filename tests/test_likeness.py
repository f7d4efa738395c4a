"""Likeness against difflib, and in time for long texts."""

from __future__ import annotations

import difflib
import random
import time

from attesta.functions.likeness import ratio
from attesta.operators import responses as R


def changed(rng, letters, n, edits):
    a = [rng.choice(letters) for _ in range(n)]
    b = list(a)
    for _ in range(edits):
        b[rng.randrange(len(b)) : rng.randrange(len(b))] = rng.choice(letters)
    return "".join(a), "".join(b)


def test_ratio_is_difflibs():
    rng = random.Random(4)
    for letters in ("ab", "abc ", "etaoinshrdlu  "):
        for _ in range(400):
            a, b = changed(rng, letters, rng.randint(1, 60), rng.randint(0, 3))
            assert ratio(a, b) == difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()
    assert ratio("", "") == 1.0 and ratio("a", "") == 0.0


def test_long_quotes_are_found_in_time(spark):
    """A sentence of 80 000 characters with a word changed: squares of its length would take minutes."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9)))
    long = " ".join(word() for _ in range(12400))
    other = "It was told in many short words. " * 20
    claims = [(1, 0, "x" + long, f"{other}{long}. {other}", None), (2, 0, "x" + long, other, f"{other}{long}. {other}"), (3, 0, "x" + long, other, None)]
    rows = spark.createDataFrame(claims, "finding_id long, passage_order int, quote string, text string, context string")
    began = time.time()
    got = {r.finding_id: (r.located, r.repaired, r.in_context) for r in R.locate_quotes(rows).collect()}
    assert got == {1: (long + ".", True, False), 2: (long + ".", True, True)}
    assert time.time() - began < 60
