"""Operators on small tables with results worked out by hand."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from attesta.functions import text as X
from attesta.functions import urls as U
from attesta.operators import corpus as C
from attesta.operators import extract as D
from attesta.operators import passages as E
from attesta.operators import profile as H
from attesta.operators import quiz as G
from attesta.operators import responses as R


def one(spark, column, *values):
    names = "abcdef"[: len(values)]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "want"), [("Știință Țară", "stiinta tara"), ("É́te", "ete"), ("ß œ", "ß œ"), (None, ""), ("", "")])
def test_fold(spark, text, want):
    assert one(spark, X.fold(F.col("a")), text) == want


def test_words_and_prefixes(spark):
    assert not one(spark, X.has_word(F.col("a"), "dan"), "bogdan vine")
    assert one(spark, X.has_word(F.col("a"), "dan"), "vine dan, azi")
    assert one(spark, X.has_prefix(F.col("a"), "finant"), "finantare")
    assert not one(spark, X.has_prefix(F.col("a"), "voi "), "voiosi")


def test_split_chunks(spark):
    assert one(spark, X.split_chunks(F.col("a"), 10), "Ab cd. Ef gh. " + "x" * 23) == ["Ab cd.", "Ef gh.", "x" * 10, "x" * 10, "xxx"]
    assert one(spark, X.split_chunks(F.col("a"), 13), "Ab cd. Ef gh.") == ["Ab cd. Ef gh."]


def test_urls(spark):
    n = U.normalize_url(F.col("a"))
    assert one(spark, n, "https://x.ro/p?b=&utm_source=f&a=1&fbclid=9#top") == "https://x.ro/p?b=&a=1"
    assert one(spark, n, "ftp://x.ro/p") is None
    official = U.is_official(U.hostname(F.col("a")))
    assert one(spark, official, "https://www.cdep.ro/a") and one(spark, official, "https://a.gov.ro") and not one(spark, official, "https://notgov.ro")


def test_name_variants(spark):
    assert one(spark, X.name_variants(F.col("a")), "Ana Maria Pop") == ["Ana Maria Pop", "Pop Ana Maria", "Ana Pop", "Pop Ana"]
    assert one(spark, X.name_variants(F.col("a")), "Ana") == ["Ana"]


def test_hidden_tags_end_blocks(spark):
    html = "<div>Alpha<nav>menu</nav>Beta<aside>x</aside>Gam<b>ma</b> ray</div><a href=''>none</a><a href='/y'>to <i>it</i></a>"
    blocks = C.html_blocks(spark.createDataFrame([(1, "https://a.ro/", html)], "page_id long, url string, html string"))
    assert [r.text for r in blocks.where("href is null").orderBy("pos").collect()] == ["Alpha", "Beta", "Gam ma ray", "none to it"]
    assert [(r.href, r.text) for r in blocks.where("href is not null").collect()] == [("/y", "to it")]


def test_author_escapes(spark):
    page = lambda name: f'<script>"author": {{"name": "{name}"}}</script>'
    rows = spark.createDataFrame([(1, page(r"Ana \u015etef &amp; co")), (2, page(r"B \ud83d\ude00")), (3, "<p>")], "k long, html string")
    assert [r.a for r in rows.orderBy("k").select(C.page_author(F.col("html")).alias("a")).collect()] == ["Ana Ştef & co", r"B \ud83d\ude00", "Necunoscut"]


def test_html(spark):
    html = "<html><head><title>T &amp; U</title><style>p{}</style></head><body><nav>menu</nav><form>asked here</form><p>One &lt;b&gt;<p>Two <a href='/x'>go</a><script>no()</script></body>"
    pages = spark.createDataFrame([(1, "https://a.ro/d/p", html)], "page_id long, url string, html string")
    blocks = C.html_blocks(pages)
    assert [r.text for r in blocks.where("href is null").orderBy("pos").collect()] == ["asked here", "One <b>", "Two go"]
    assert [r.text for r in C.html_blocks(pages, "strict").where("href is null").orderBy("pos").collect()] == ["One <b>", "Two go"]
    assert C.page_links(blocks, pages).first().href == "https://a.ro/x"
    assert pages.select(C.page_title(F.col("html"))).first()[0] == "T & U"


def test_page_date(spark):
    date = C.page_date(F.col("a"), F.col("b"))
    assert one(spark, date, "<meta name='date' content='2024-05-06T10'>", "u") == dt.date(2024, 5, 6)
    assert one(spark, date, "<meta content='2024-05-07' name='date'>", "u") == dt.date(2024, 5, 7)
    assert one(spark, date, '"datePublished": "2023-02-31"', "http://x/2022/3/4/") == dt.date(2022, 3, 4)
    assert one(spark, date, "none", "http://x/2022/13/4/") is None


def test_mentions_count_words_and_phrases(spark):
    texts = spark.createDataFrame([(1, "ana pop si ana pop, dan"), (2, "bogdan"), (3, None)], "doc_id long, norm string")
    names = spark.createDataFrame([("a", "ana pop"), ("d", "dan")], "entity_id string, variant string")
    assert {(r.entity_id, r.doc_id, r.n) for r in D.mentions(texts, names).collect()} == {("a", 1, 2), ("d", 1, 1)}


def test_excerpts_grow(spark):
    rows = [(1, 0, "p" * 30), (1, 1, "m" * 30), (1, 2, "n" * 30), (1, 3, "o" * 30), (2, 0, "q" * 130), (3, 0, "m" * 50), (3, 1, "z" * 690)]
    paras = spark.createDataFrame(rows, "doc_id long, pos int, text string").withColumn("norm", F.col("text"))
    got = {(r.doc_id, r.pos): r.excerpt for r in D.excerpts(paras, "x").collect()}
    assert got[1, 1] == " ".join(x * 30 for x in "pmn")
    assert got[1, 0] == " ".join(x * 30 for x in "pmn")
    assert got[2, 0] == "q" * 130
    assert got[3, 0] == "m" * 50


def test_sentence_window(spark):
    text = "Aaaa aa. Bbbb bb. Key one. Cccc cc. Dddd dd."
    assert one(spark, D.sentence_window(F.col("a"), "key", 26), text) == "Bbbb bb. Key one. Cccc cc."
    assert one(spark, D.sentence_window(F.col("a"), "zzz", 10), text) == "Aaaa aa."


def test_speeches(spark):
    rows = [(0, "Domnul Ion Popa: " + "a" * 100), (1, "b" * 100), (2, "Ana Radu (PX): scurt"), (3, "c" * 200), (4, "Ion Popa: mic")]
    paras = spark.createDataFrame([(1, *r) for r in rows], "doc_id long, pos int, text string")
    people = spark.createDataFrame([("p", "popa"), ("r", "radu")], "entity_id string, surname string")
    got = {(r.entity_id, r.turn): r.text for r in D.speeches(paras, people).collect()}
    assert got == {("p", 1): "a" * 100 + "\n" + "b" * 100, ("r", 2): "scurt\n" + "c" * 200}


def test_statements(spark):
    long = "cuvinte care se intind destul de mult pentru citat"
    rows = [(1, 0, "Popa vine."), (1, 1, f"El spune „{long}”."), (1, 2, f"Din nou „{long}!” Popa"), (2, 0, f"„{long}”")]
    paras = spark.createDataFrame(rows, "doc_id long, pos int, text string").withColumn("norm", X.fold(F.col("text")))
    names = spark.createDataFrame([("p", "popa")], "entity_id string, variant string")
    got = D.statements(paras, names).collect()
    assert [(r.doc_id, r.pos, r.text, r.same_paragraph) for r in got] == [(1, 1, long, False)]


def test_judge_promises(spark):
    p = spark.createDataFrame([("e", "p1", 1, dt.date(2024, 1, 1), "construim autostrada moldova")], "entity_id string, promise_id string, doc_id long, date date, text string")
    s = spark.createDataFrame(
        [("e", "s1", 2, dt.date(2024, 2, 1), "autostrada moldova finalizat"), ("e", "s2", 3, dt.date(2023, 2, 1), "autostrada moldova nerespectat"), ("e", "s3", 4, None, "autostrada moldova nerespectat"), ("e", "s4", 1, None, "autostrada moldova finalizat")],
        "entity_id string, sent_id string, doc_id long, date date, text string",
    )
    r = D.judge_promises(p, s).first()
    assert (r.n_kept, r.n_broken, r.status) == (1, 1, "partial")


def test_pack_batches(spark):
    rows = spark.createDataFrame([("a", k, n) for k, n in enumerate([5, 5, 5, 20, 1])], "g string, seq long, size long")
    got = [r.batch_no for r in E.pack_batches(rows, ["g"], "size", 10, most=8).orderBy("seq").collect()]
    assert got == [0, 0, 1, 2, 3]
    many = spark.createDataFrame([("a", k, 1) for k in range(9)], "g string, seq long, size long")
    assert [r.batch_no for r in E.pack_batches(many, ["g"], "size", 100, most=8).orderBy("seq").collect()] == [0] * 8 + [1]


def test_candidate_pairs(spark):
    rows = [("e", 1, 1, ["aaaaa", "bbbbb", "ccccc", "ddddd"], ["1"], False), ("e", 2, 2, ["aaaaa", "bbbbb", "ccccc", "eeeee"], ["2"], True), ("e", 3, 1, ["aaaaa", "bbbbb"], [], False), ("e", 4, 1, ["aaaaa", "bbbbb", "ccccc", "ddddd"], [], False)]
    found = spark.createDataFrame(rows, "entity_id string, snippet_id long, doc_id long, stems array<string>, nums array<string>, neg boolean")
    got = {(r.i, r.j): r.score for r in E.candidate_pairs(found).collect()}
    assert got == {(1, 2): 7.0, (2, 4): 5.0}


def test_replan(spark):
    rows = spark.createDataFrame([("q", [1, 2, 3]), ("r", [1]), ("s", [4])], "request_id string, members array<int>")
    got = {r.request_id: r.members for r in E.replan_failed(rows, rows.where("request_id <> 's'")).collect()}
    assert got == {"q.1": [1], "q.2": [2, 3], "r": [1], "s": [4]}


def test_parse_and_validate(spark):
    whole = '<think>x</think>```json\n{"findings": [{"id": "P1", "category": "implausible", "severity": "awful", "confidence": "high", "quote": "q"}]}\n```'
    cut = '{"findings": [{"id": "P2", "category": "misleading", "severity": "low", "quote": "r"}, {"id": "P3", "cat'
    rows = spark.createDataFrame([("a", whole), ("b", cut), ("c", "")], "request_id string, content string")
    got = {(r.request_id, r.id, r.severity, r.confidence) for r in R.validate_findings(R.parse_findings(rows)).collect()}
    assert got == {("a", "P1", "medium", "high"), ("b", "P2", "low", "low")}


def test_locate_quotes(spark):
    text = "First words stand here. The road will be ready in spring, they said. More."
    claims = [(1, "The road will be ready in spring, they said."), (2, "THE ROAD will be ready, in spring they said"), (3, "The road will be ready in sprang they said"), (4, "An invented sentence about nothing"), (5, "short")]
    rows = spark.createDataFrame([(i, 0, q, text, None) for i, q in claims], "finding_id long, passage_order int, quote string, text string, context string")
    got = {r.finding_id: (r.located, r.repaired) for r in R.locate_quotes(rows).collect()}
    line = "The road will be ready in spring, they said."
    assert got == {1: (line, False), 2: (line, True), 3: (line, True)}


def test_credibility(spark):
    f = R.formula(*[F.col(c).cast("int") for c in "abcd"])
    assert [float(one(spark, f, *map(str, v))) for v in ((7, 7, 7, 7), (5, 6, 9, 4), (8, 6, 4, 5))] == [7.0, 6.6, 5.4]
    assert [one(spark, R.clamp_score(F.col("a")), v) for v in ("15", "0", "7.4", None, "x", "2.5")] == [10, 1, 7, None, None, 2]


def test_grounding(spark):
    missing = R.ungrounded(F.col("a"), F.col("b"))
    assert one(spark, missing, "A venit în 1995.", "fără cifre") == ["1995"]
    assert one(spark, missing, "Bugetul de 1.200 milioane lei.", "1200 milioane") == []
    assert one(spark, missing, "- Promisiunea lui despre CNInvest", "nimic") == ["CNInvest"]


def test_axis_validation(spark):
    rows = [("s", "a", 5, "high", [("S1", "Bani pentru  toți"), ("S9", "bani"), ("S1", "inventat")], ["S1"], "aici: bani pentru toți"), ("s", "b", 4, "high", [("S1", "altceva")], ["S1"], "text")]
    df = spark.createDataFrame(rows, "subject_id string, axis_id string, score int, confidence string, evidence array<struct<source: string, quote: string>>, refs array<string>, sent string")
    got = {r.axis_id: (r.score, r.confidence, len(r.evidence), r.dropped_unsupported) for r in R.validate_axis(df).collect()}
    assert got == {"a": (5, "high", 1, False), "b": (None, "low", 0, True)}


def test_scores(spark):
    chunks = spark.createDataFrame([("e", 1.0, 10.0), ("e", 2.0, 10.0), ("e", 5.0, 10.0), ("e", 10.0, 10.0)], "entity_id string, u double, s double")
    promises = spark.createDataFrame([("e", 1.0), ("e", 0.5), ("e", 0.3)], "entity_id string, value double")
    r = G.final_scores(chunks, promises).first()
    assert (round(r.truth_score, 6), r.credibility, r.band) == (0.075, 1, "red")
    assert [one(spark, G.credibility_1_10(F.col("a").cast("double")), v) for v in ("0.66", "1.4", None)] == [7, 10, None]
    big = spark.range(1, 1001).select(F.col("id").cast("double").alias("u"), F.lit(1.0).alias("s"))
    assert big.agg(G.worst_percentile("u", "s")).first()[0] == 150


def test_compare(spark):
    a = spark.createDataFrame([("a", 0, 10.0), ("a", 1, 50.0), ("a", 2, None)], "subject_id string, axis_id int, value double")
    b = spark.createDataFrame([("b", 0, 70.0), ("b", 1, 60.0), ("b", 2, 20.0)], "subject_id string, axis_id int, value double")
    r = G.compare_positions(a, b).first()
    assert (r.compared, r.match, r.n_major) == (2, 65.0, 1)


def test_next_items_alternate(spark):
    order = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "respondent_id long, axis_id string, rank int")
    items = spark.createDataFrame([("x1", "x", 1, 1), ("x2", "x", 1, 2), ("x3", "x", -1, 3), ("y1", "y", -1, 4)], "item_id string, axis_id string, direction int, item_no int")
    asked = spark.createDataFrame([(1, "zz")], "respondent_id long, item_id string")
    assert [r.item_id for r in G.next_items(order, items, asked, 4).orderBy("nth").collect()] == ["x1", "x3", "x2", "y1"]


def test_quality(spark):
    rows = [(1, f"i{k}", 3, False, 2.0) for k in range(6)] + [(2, "i0", 1, False, 9.0), (2, "i1", 1, True, 9.0)]
    got = {r.respondent_id: r.flags for r in G.quality_flags(spark.createDataFrame(rows, "respondent_id long, item_id string, value int, is_dk boolean, seconds double")).collect()}
    assert got == {1: ["flat", "fast"], 2: ["dk"]}


def test_merge_and_plan(spark):
    feeds = spark.createDataFrame([("e", "u", dt.date(2024, 1, 1), 2), ("e", "u", dt.date(2023, 1, 1), 1)], "entity_id string, url string, rss_date date, seq long")
    user = spark.createDataFrame([("e", "u", 1), ("e", "v", 2)], "entity_id string, url string, seq long")
    assert {(r.url, r.rss_date) for r in H.merge_discovered(feeds, user).collect()} == {("u", dt.date(2023, 1, 1)), ("v", None)}


def test_crawl(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    seeds = spark.createDataFrame([("http://a.ro/1",)], "url string")
    links = spark.createDataFrame([("http://a.ro/1", "http://a.ro/2", "profil"), ("http://a.ro/2", "http://a.ro/3", "profil"), ("http://a.ro/1", "http://b.ro/1", "profil"), ("http://a.ro/1", "http://a.ro/x", "altul")], "url string, href string, anchor string")
    pages = spark.createDataFrame([(f"http://a.ro/{k}",) for k in "123x"] + [("http://b.ro/1",)], "url string")
    got = {(r.url, r.round) for r in C.crawl_frontier(seeds, links, pages, pages, ["popa"]).collect()}
    assert got == {("http://a.ro/1", 0), ("http://a.ro/2", 1), ("http://a.ro/3", 2)}
