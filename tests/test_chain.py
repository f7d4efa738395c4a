"""Operators that SQL can't express, against plain walks over the smallest tables."""

from __future__ import annotations

import difflib
import html
import os
import re
import unicodedata
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from attesta.functions import text as X
from attesta.operators import corpus as C
from attesta.operators import extract as D
from attesta.operators import passages as E
from attesta.operators import responses as R
from attesta.plans import registry

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def fold(s):
    return "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn").lower()


def norm_words(s):
    return " ".join(re.findall("[a-z0-9]+", fold(s)))


def sentences(s):
    return [x for x in re.split(r"(?<=[.!?])\s+", s) if x]


def plain_window(text, words, limit):
    sents = sentences(text)
    if not sents:
        return text[:limit]
    first = next((k for k, s in enumerate(sents) if any(re.search(r"(?<!\w)" + w, fold(s)) for w in words)), 0)
    lo = hi = first
    size, moved = len(sents[first]), True
    while moved:
        moved = False
        if hi + 1 < len(sents) and size + 1 + len(sents[hi + 1]) <= limit:
            hi, size, moved = hi + 1, size + 1 + len(sents[hi + 1]), True
        if lo > 0 and size + 1 + len(sents[lo - 1]) <= limit:
            lo, size, moved = lo - 1, size + 1 + len(sents[lo - 1]), True
    joined = " ".join(sents[lo : hi + 1])
    return re.sub(" [^ ]*$", "", joined[:limit]).rstrip(" ") + "…" if len(joined) > limit else joined


@needs_data
def test_sentence_windows_of_all_paragraphs(spark):
    paras = C.text_paragraphs(spark.read.parquet(f"{DATA}/documents.parquet"))
    found = paras.select("text", D.sentence_window(F.col("text"), X.prefix_rx(*registry.WORDS), 120).alias("x")).collect()
    assert len(found) > 100
    for r in found:
        assert r.x == plain_window(r.text, registry.WORDS, 120)


@needs_data
def test_evidence_of_whole_texts(spark):
    """Excerpts of long paragraphs too: each is the plain window, and names its entity."""
    paras = C.text_paragraphs(spark.read.parquet(f"{DATA}/documents.parquet"))
    text = {(r.doc_id, r.pos): r.text for r in paras.collect()}
    found = __spark_entry__.queries()["d6_evidence_full"](spark, DATA).collect()
    long = [r for r in found if len(text[r.doc_id, r.pos]) > 700]
    assert long and all(r.excerpt == plain_window(text[r.doc_id, r.pos], registry.WORDS, 700) for r in long)
    assert all(re.search(rf"(?<!\w){r.entity_id}(?!\w)", fold(r.excerpt)) for r in found)
    assert max(r.rank for r in found) <= 4


@needs_data
def test_article_batches(spark):
    got = defaultdict(dict)
    for r in __spark_entry__.queries()["f14_article_batches"](spark, DATA).collect():
        got[r.entity_id][r.doc_id] = (r.date, r.size, r.batch_no)
    for own in got.values():
        batch, used, n = 0, 0, 0
        for doc in sorted(own, key=lambda i: (-own[i][0].toordinal(), i)):
            size = own[doc][1] + 2
            if n and (used + size > 5000 or n >= E.MAX_PASSAGES):
                batch, used, n = batch + 1, 0, 0
            used, n = used + size, n + 1
            assert own[doc][2] == batch


def test_batches_of_odd_tables(spark):
    none = spark.createDataFrame([], "g long, seq long, size long")
    assert E.pack_batches(none, ["g"], "size", 10).count() == 0
    rows = spark.createDataFrame([(1, 1, 50), (1, 2, None), (1, 3, 50), (2, 1, 1)], "g long, seq long, size long")
    assert sorted((r.g, r.seq, r.batch_no) for r in E.pack_batches(rows, ["g"], "size", 10).collect()) == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 1, 0)]


def plain_context(paras, rx, budget):
    """[(header and paragraphs of each source)] by one walk."""
    saying = re.compile(r"\b(a spus|a declarat|a afirmat|a anun[țt]at|a promis|susține|propune|vrea|consider[ăa])\b", re.I)
    docs = defaultdict(list)
    for p in paras:
        text = p["text"].strip(" ").translate(str.maketrans({c: "'" for c in "„“”«»‘’\""}))
        hits = len(re.findall(rx, text))
        if len(text) > 40 and hits and p["names_entity"]:
            docs[p["doc_id"]].append((3 * min(hits, 3) + 2 + bool(saying.search(text)) + 2 * p["official"], p["pos"], text, p))
    order = sorted(docs, key=lambda i: (-docs[i][0][3]["official"], -sum(x[0] for x in docs[i]), i))
    blocks, used = [], 0
    for n, i in enumerate(order, 1):
        header = f"[S{n}] {docs[i][0][3]['header']}"
        room = min(max(700, budget // len(order)), budget - used) - len(header) - 2
        if room < 200:
            break
        kept, size = [], 0
        for _, pos, text, _ in sorted(docs[i], key=lambda x: (-x[0], x[1])):
            if size + len(text[:600]) + 3 <= room:
                kept.append((pos, text[:600]))
                size += len(text[:600]) + 3
        if kept:
            blocks.append(header + "\n" + "\n".join(f"- {t}" for _, t in sorted(kept)))
            used += len(blocks[-1]) - len("\n") + 2
    return "\n\n".join(blocks)


@needs_data
def test_axis_context(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    about = docs.select((F.col("doc_id") % 3).alias("entity_id"), "doc_id", F.concat_ws(" | ", "lang", "source").alias("header"))
    paras = C.text_paragraphs(docs).join(about, "doc_id").withColumn("official", F.col("doc_id") % 10 == 0).withColumn("names_entity", X.has_word(F.col("norm"), "the", "thon", "de"))
    axes = spark.createDataFrame([("first", "thing|ander"), ("second", "ought|tion"), ("none", "qqqq")], "axis_id string, rx string")
    rows = [r.asDict() for r in paras.collect()]
    for budget in (1500, 6000):
        got = {(r.entity_id, r.axis_id): r.context for r in R.axis_context(paras, axes, budget).collect()}
        for e in range(3):
            for axis, rx in (("first", "thing|ander"), ("second", "ought|tion"), ("none", "qqqq")):
                assert got.get((e, axis), "") == plain_context([r for r in rows if r["entity_id"] == e], rx, budget)


def test_context_says_which_source(spark):
    rows = [(1, "b", 0, "The economy is what he said that it would be, and more", True, True, "b.ro"), (1, "a", 1, "Another economy that „somebody” spoke about for so long", False, False, "a.ro"), (1, "a", 2, "nothing of the word that is looked for, at all, not here", True, True, "a.ro")]
    paras = spark.createDataFrame(rows, "entity_id long, doc_id string, pos int, text string, official boolean, names_entity boolean, header string")
    out = R.axis_context(paras, spark.createDataFrame([("x", "economy")], "axis_id string, rx string"), 2000).collect()
    # a quotation counts where it is told by other marks only, as in the text that is sent
    assert len(out) == 1 and [(x.tag, x.doc_id) for x in out[0].refs] == [("S1", "b")] and out[0].context.startswith("[S1] b.ro\n- The economy")


def plain_locate(quote, texts):
    q = " ".join(quote.split())
    qn = norm_words(q)
    if len(qn) < 15:
        return None
    for k, t in enumerate(texts):
        if t and q in " ".join(t.split()):
            return q, False, k == 1
    for k, t in enumerate(texts):
        if not t:
            continue
        sents = sentences(" ".join(t.split()))
        pieces = [" ".join(sents[i : i + n]) for n in (1, 2) for i in range(len(sents))]
        for p in pieces:
            if qn in norm_words(p):
                return p, True, k == 1
        if qn in norm_words(t):
            return q, True, k == 1
        ratios = [difflib.SequenceMatcher(None, qn, norm_words(p), autojunk=False).ratio() for p in pieces]
        if ratios and max(ratios) >= 0.85:
            return pieces[ratios.index(max(ratios))], True, k == 1
    return None


def test_quotes_are_located_passage_by_passage(spark):
    a, b = "We shall build forty roads in the north. Nobody stops us, not now.", "The budget of the city grew by 12 percent. It was a very good year for all."
    quotes = ["We shall build forty roads in the north.", "we shall BUILD forty roads, in the north", "We shall bild forty roads in the nort", "in the north nobody stops us", "The budget of the city grew by 13 percents", "a very good year", "nothing like this is said anywhere here", "short", "  forty   roads in the north. Nobody stops us", "forty roads in the north nobody stops us not now the budget of the city"]
    passages = [(a, b), (b, None), (None, a), ("Something else. Entirely other words here.", "We shall build fourty roads in the north!"), (a + " " + b, ""), ("", None)]
    rows, want = [], {}
    for i, q in enumerate(quotes):
        for j in range(len(passages)):
            order = passages[j:] + passages[:j]
            rows += [(i * 10 + j, k, q, t, c) for k, (t, c) in enumerate(order[:3])]
            found = next((x for t, c in order[:3] if (x := plain_locate(q, [t, c]))), None)
            if found:
                want[i * 10 + j] = found
    got = R.locate_quotes(spark.createDataFrame(rows, "finding_id long, passage_order int, quote string, text string, context string"))
    assert {r.finding_id: (r.located, r.repaired, r.in_context) for r in got.collect()} == want and len(want) > 20


@needs_data
def test_quotes_of_whole_texts(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").limit(60)
    first = F.get(X.split_sentences(X.squash(F.col("text"))), 0)
    claims = docs.select(F.col("doc_id").alias("finding_id"), F.lit(0).alias("passage_order"), F.when(F.col("doc_id") % 2 == 0, F.regexp_replace(first, "[aeiou]$", "x")).otherwise(F.regexp_replace(first, "^(.)", "x$1")).alias("quote"), "text", F.lit(None).cast("string").alias("context"))
    rows = claims.collect()
    want = {r.finding_id: x for r in rows if (x := plain_locate(r.quote, [r.text, None]))}
    assert {r.finding_id: (r.located, r.repaired, r.in_context) for r in R.locate_quotes(claims).collect()} == want


def test_the_first_six_findings_count(spark):
    one = lambda k, c="misleading": '{"id": "P%d", "category": "%s", "severity": "x", "confidence": "y", "quote": "q%d"}' % (9 - k, c, 9 - k)
    answer = '{"findings": [' + ", ".join([one(0, "made up"), *[one(k) for k in range(1, 8)]]) + "]}"
    rows = spark.createDataFrame([("r", answer), ("cut", answer[:-30]), ("none", ""), ("null", None)], "request_id string, content string")
    got = R.validate_findings(R.parse_findings(rows)).collect()
    assert {(r.request_id, r.id, r.severity, r.confidence) for r in got} == {(q, f"P{9 - k}", "medium", "low") for q in ("r", "cut") for k in range(1, 6)}


def test_summaries_keep_the_first_where_the_second_says_nothing(spark):
    rows = [(1, 1, "Ana are 5 mere", "ana mere"), (1, 2, "FARA_INFORMATII", "ana mere"), (2, 1, "", "x"), (2, 2, "Text", "text"), (3, 1, "ceva", "ceva"), (4, 1, "a 7", "a"), (4, 2, "a", "a"), (5, 1, None, None)]
    got = {r.request_id: (r.summary, r.verified, r.unsupported) for r in R.summary_status(spark.createDataFrame(rows, "request_id long, attempt int, summary string, material string")).collect()}
    assert got[1] == ("Ana are 5 mere", False, ["5"]) and got[2][0] is None and not got[2][1] and got[3] == ("ceva", True, []) and got[4] == ("a", True, []) and got[5][0] is None


def test_budget():
    assert E.batch_budget(7000, 1500, 3400) == 5000 and E.batch_budget(3000, 1500, 340) == int(940 * 2.6) and E.batch_budget(1000, 900, 0) == 1500


def plain_chunks(text, limit):
    text = text.strip(" ")
    if len(text) <= limit:
        return [text]
    done, cur = [], ""
    for s in re.split(r"(?<=[.!?])\s+", text):
        if len(s) > limit:
            cuts = [s[k : k + limit] for k in range(0, len(s), limit)]
            done, cur = [*done, *([cur] if cur else []), *cuts[:-1]], cuts[-1].strip(" ")
        elif not cur or len(cur) + 1 + len(s) <= limit:
            cur = f"{cur} {s}".strip(" ")
        else:
            done, cur = [*done, cur], s
    return [*done, *([cur] if cur else [])]


@needs_data
def test_chunks_of_whole_texts(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for limit in (60, 500):
        for r in docs.select("text", X.split_chunks(F.col("text"), limit).alias("got")).collect():
            assert r.got == (None if r.text is None else plain_chunks(r.text, limit))
    sizes = {(r.doc_id, k): len(p) for r in docs.where("text is not null").collect() for k, p in enumerate(plain_chunks(r.text, 500))}
    assert {(r.doc_id, r.k): r.n for r in __spark_entry__.queries()["b14_split_chunks"](spark, DATA).collect()} == sizes


def plain_blocks(page, hidden, breaks, inside_only):
    """Visible blocks of a page whose tags nest well, by cutting its text."""
    page = re.sub(r"(?s)<!--.*?-->|<!DOCTYPE[^>]*>", "", page)
    for tag in sorted(hidden, key=lambda t: t not in ("script", "style")):
        page = re.sub(rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "" if inside_only else "<hr>", page)
    out, depth = [], 0
    for piece in re.split(rf"(?i)(</?(?:{'|'.join(sorted(breaks, key=len, reverse=True))})\b[^>]*>)", page):
        if piece.startswith("</") and piece[2:-1].strip().lower() in breaks:
            depth = max(0, depth - 1)
        elif piece.startswith("<") and re.match(r"<(\w+)", piece) and re.match(r"<(\w+)", piece)[1].lower() in breaks:
            depth += 1
        elif depth or not inside_only:
            text = " ".join(html.unescape(re.sub(r"<[^>]+>", " ", piece)).split())
            out += [text] if text else []
    return out


@needs_data
@pytest.mark.parametrize("name, hidden, breaks, strict", [("c1_html_blocks", C.HIDDEN, C.BLOCK, False), ("c2_html_blocks_strict", C.STRICT_HIDDEN, C.STRICT, True)])
def test_blocks_of_pages(spark, name, hidden, breaks, strict):
    got = defaultdict(dict)
    rows = __spark_entry__.queries()[name](spark, DATA)
    for r in rows.collect():
        assert strict or r.href is None  # all links stand in hidden tags
        got[r.page_id][r.pos] = r.text
    pages = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    assert len(got) == len(pages) > 10
    for r in pages:
        assert [got[r.page_id][k] for k in sorted(got[r.page_id])] == plain_blocks(r.html, hidden, breaks, strict)


def plain_paragraphs(spark):
    out = defaultdict(list)
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        seen = set()
        for pos, line in enumerate((r.text or "").split("\n")):
            if len(line) >= 20 and fold(line) not in seen:
                seen.add(fold(line))
                out[r.doc_id].append((pos, line))
    return out


def plain_excerpt(own, i, words, limit):
    text = own[i][1]
    if len(text) > limit:
        return plain_window(text, words, limit)
    if len(text) >= 120:
        return text
    lo = hi = i
    size, moved = len(text), True
    while moved and hi - lo < 2:
        moved = False
        if hi + 1 < len(own) and size + 1 + len(own[hi + 1][1]) <= limit:
            hi, size, moved = hi + 1, size + 1 + len(own[hi + 1][1]), True
        if hi - lo < 2 and lo > 0 and size + 1 + len(own[lo - 1][1]) <= limit:
            lo, size, moved = lo - 1, size + 1 + len(own[lo - 1][1]), True
    return " ".join(t for _, t in own[lo : hi + 1])


def plain_fingerprint(s, n):
    return re.sub(r"\W+", " ", fold(s)).strip(" ")[:n]


def starts(norm, word):
    return re.search(r"(?<!\w)" + word, norm) is not None


@needs_data
def test_funding_evidence_of_whole_texts(spark):
    labels = [("first", ["thing"]), ("second", ["ander", "ought"]), ("third", ["erin"])]
    want = set()
    for doc, own in plain_paragraphs(spark).items():
        best = defaultdict(dict)
        for i, (pos, text) in enumerate(own):
            matched = [w for w in registry.WORDS if starts(fold(text), w)]
            told = tuple(label for label, words in labels if any(starts(fold(text), w) for w in words))
            if not matched or (len(matched) < 2 and not told):
                continue
            made = plain_excerpt(own, i, registry.WORDS, 700)
            for name in set(re.findall(r"\w+", fold(made))) & set(registry.NAMES):
                if len(made) >= 100:
                    best[name].setdefault(plain_fingerprint(made, 300), (-len(told), -len(made), pos, matched[0], made, told))
        for name, found in best.items():
            for rank, (_, _, pos, word, made, told) in enumerate(sorted(found.values())[:5], 1):
                want.add((name, doc, pos, word, made, told, rank))
    got = __spark_entry__.queries()["d7_funding"](spark, DATA).collect()
    assert got and {(r.entity_id, r.doc_id, r.pos, r.keyword, r.excerpt, tuple(r.channels), r.rank) for r in got} == want
    assert len(got) == len(want)


@needs_data
def test_mention_excerpts_of_whole_texts(spark):
    want = set()
    for doc, own in plain_paragraphs(spark).items():
        found = defaultdict(dict)
        for i, (pos, text) in enumerate(own):
            made = plain_excerpt(own, i, [], 900)
            for name in set(re.findall(r"\w+", fold(text))) & set(registry.NAMES):
                if len(made) >= 120:
                    found[name].setdefault(plain_fingerprint(made, 250), (pos, made))
        want |= {(name, doc, pos, made, rank) for name, x in found.items() for rank, (pos, made) in enumerate(sorted(x.values())[:4], 1)}
    got = __spark_entry__.queries()["d8_mention_excerpts"](spark, DATA).collect()
    assert got and {(r.entity_id, r.doc_id, r.pos, r.excerpt, r.rank) for r in got} == want
    assert len(got) == len(want)
