"""Spelling variants, structure of conversations and shards, against plain versions."""

from __future__ import annotations

import itertools
import os
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from attesta.llm import entry, shards, spelling, turns
from tests.llm import plain

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


# ---- spelling
def found_words(df) -> dict:
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_spelling_of_made_up_texts(spark):
    random.seed(1)
    base = ["wandern", "wanderns", "wandorn", "élégante", "Éléganté", "zzzzzzzz", "zzzzzzz", "abcdefgh" * 3000]
    rows = [(k, " ".join(random.choices(base, weights=[60, 9, 2, 30, 3, 40, 5, 0.2], k=12)) + random.choice([" naïve×", " x́", "½"])) for k in range(150)]
    rows += [(None, None), (7, ""), (8, "wandern-WANDERN1wandern"), (8, "wandern-WANDERN1wandern"), (9, "ab cde")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit(1))
    counted = spelling.word_counts(df)
    got = found_words(spelling.variants(spelling.materialise(counted, "v")))
    assert got == plain.spelling(rows)
    assert any(r[0] for r in got.values())


def test_chains_of_forms(spark):
    """Words six letters long whose forms have five times their occurrences, four deep; nodes in pieces of three words."""
    random.seed(2)
    chain = ["aaaaaa", "aaaaab", "aaaabb", "aaabbb"]
    n = {w: 5 * 6**k for k, w in enumerate(chain)} | {"".join(p): 5 for p in itertools.islice(itertools.product("ab", repeat=6), 30, 60)}
    words = spelling.materialise(spark.createDataFrame(list(n.items()), "word string, n long"), "v")
    rows = [(None, w) for w, c in n.items() for _ in range(c)]
    want = plain.spelling([(None, " ".join(w for _, w in rows))])
    if {w: r[2] for w, r in want.items()} == n:  # no run is cut by its CRC
        assert found_words(spelling.variants(words)) == want
    near = {r.word: r.n_near for r in spelling.near_words(words, most=3).collect()}
    apart = lambda a, b: len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1
    assert near == {w: k for w in n if (k := sum(apart(w, v) for v in n))}
    roots = {r.word: r.root for r in spelling.roots(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("x", "e")], "word string, form string")).collect()}
    assert roots == dict.fromkeys("abcdx", "e")


def test_tries_find_all(spark):
    random.seed(3)
    words = list({"".join(random.choices("abcé", k=7)).encode("latin-1") for _ in range(600)})
    trie = spelling.Trie(words)
    pairs = trie.near(words)
    pairs = pairs[spelling.one_apart(spelling.letters([words[a] for a in pairs[:, 0]]), spelling.letters([words[b] for b in pairs[:, 1]]))]
    want = {(a, b) for a, x in enumerate(words) for b, y in enumerate(words) if sum(p != q for p, q in zip(x, y, strict=True)) == 1}
    assert set(map(tuple, pairs.tolist())) == want and not isinstance(trie.root, type(pairs))


@needs_data
def test_op11(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    assert found_words(entry.queries()["op11_spelling"](spark, DATA)) == plain.spelling(rows)


def test_no_words(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(spelling.materialise(spelling.word_counts(none), "v")).count() == 0


# ---- structure of conversations
ROWS = "conv_id long, turn long, role string, text string"


def told(df) -> dict:
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("chunk", [3, 8, 4096])
def test_repairs_in_chunks(spark, chunk):
    random.seed(4)
    text = lambda: random.choice(["a.", "b", "c!", "", None, " ", "d?", "e", "Is it?", "so.\n"])
    rows = [(random.choice([1, 1, 1, 2, None, 5]), random.choice([None, *range(70)]), random.choice(["user", "assistant", "system", "tool", None, "user"]), text()) for _ in range(300)]
    df = spark.createDataFrame(rows, ROWS).withColumn("place", F.lit("clash")).withColumn("fault", F.lit(1))
    own = plain.spoilt(rows)
    assert told(turns.report(turns.damaged(df), chunk)) == {c: plain.repair(x) for c, x in own.items()}


def test_block_tables_agree_with_single_rows():
    t = turns.tables()
    random.seed(5)
    assert len(t.vectors) < 200
    for _ in range(200):
        symbols = random.choices(range(turns.SYMBOLS), k=random.randint(0, 11))
        vector = turns.END
        for s in reversed(symbols):
            vector = turns.before(s, vector)
        behind, cost = turns.pass_over(symbols, t.end)
        assert tuple(x + cost for x in t.vectors[behind[0]]) == vector


@needs_data
def test_op12(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert told(entry.queries()["op12_structure"](spark, DATA)) == plain.repairs(rows)


def test_conversations_of_nothing(spark, tmp_path):
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    spark.createDataFrame([(gone, 0, "user", "a."), (None, None, None, None)], ROWS).write.parquet(f"{tmp_path}/conversations.parquet")
    assert told(turns.op12_structure(spark, str(tmp_path))) == plain.repairs([(gone, 0, "user", "a."), (None, None, None, None)])
    assert turns.report(spark.createDataFrame([], ROWS)).count() == 0


# ---- shards
def check_shards(got: list, rows: list, n: int) -> float:
    """Shares and slots hold; returns how many groups of equal texts lie in more than one shard."""
    counts, slots, groups = Counter(r.shard for r in got), defaultdict(list), defaultdict(set)
    assert len(got) == len(rows) and max(counts.values()) - min(counts[s] for s in range(n)) <= 1
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    text = {i: t or "" for i, t in rows}
    assert Counter((r.size, r.text_crc32) for r in got) == Counter((len(t.encode()) + 1, zlib.crc32(t.encode())) for t in (x or "" for _, x in rows))
    many = {t for t, c in Counter(text.values()).items() if c > 1}
    for r in got:
        groups[text[r.doc_id]].add(r.shard)
    return sum(len(groups[t]) > 1 for t in many)


def test_shards_keep_copies_together(spark):
    random.seed(6)
    rows = [(k, f"pair {k // 2}" if k < 200 else f"ten {k % 10}" if k < 300 else f"é {k}") for k in range(801)]
    docs, links = shards.same_texts(spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(1)).withColumn("shard", F.lit("x")))
    assert check_shards(shards.assign(docs, links, 8).collect(), rows, 8) == 0


def test_a_text_of_a_third_of_all_rows_fills_few_shards(spark):
    rows = [(k, "hot" if k % 3 == 0 else None if k % 50 == 1 else f"t{k // 4}" if k % 5 == 1 else f"u{k}") for k in range(900)]
    docs, links = shards.same_texts(spark.createDataFrame(rows, "doc_id long, text string"))
    got = shards.assign(docs, links, 8).collect()
    assert check_shards(got, rows, 8) <= 3
    hot = Counter(r.shard for r in got if r.doc_id % 3 == 0)
    assert sum(n for _, n in hot.most_common(3)) >= 0.95 * sum(hot.values())


def test_quotas_hold_every_share():
    random.seed(7)
    for _ in range(200):
        n = random.randint(2, 8)
        want = [[0 if i == j else random.randint(0, 50) for j in range(n)] for i in range(n)]
        room = [random.choice([0, 0, 3, 100]) for _ in range(n)]
        may = shards.quotas(want, room)
        assert all(0 <= may[i][j] <= want[i][j] for i in range(n) for j in range(n))
        assert all(sum(row[j] for row in may) <= room[j] + sum(may[j]) for j in range(n))
    assert shards.quotas([[0, 5], [5, 0]], [0, 0]) == [[0, 5], [5, 0]]


def test_shards_of_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    docs, links = shards.same_texts(none)
    assert shards.assign(docs, links, 8).count() == 0
    rows = [(1, "a"), (1, "a"), (None, None), (None, ""), (2, "b" * 200_000)]
    docs, links = shards.same_texts(spark.createDataFrame(rows, "doc_id long, text string"))
    got = shards.assign(docs, links, 8).collect()
    assert len(got) == 5 and max(Counter(r.shard for r in got).values()) == 1


@needs_data
def test_op13(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    got = entry.queries()["op13_sharding"](spark, DATA).collect()
    assert check_shards(got, rows, 8) == 0 and {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
