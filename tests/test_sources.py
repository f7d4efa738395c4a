"""Feeds, bytes of unknown character sets, the store of results and the streaming ingest."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from attesta.sources import pages as P
from attesta.sources import store as S
from attesta.streaming import ingest as I

PAGES = "page_id long, url string, html string, fetched_at timestamp"


def test_read_feed(spark, tmp_path):
    (tmp_path / "feed.xml").write_text(
        "<rss><channel>"
        "<item><link>https://n.org/url?url=https%3A%2F%2Fa.ro%2Fp%3Futm_source%3Dx&amp;ct=1</link><pubDate>Tue, 05 Mar 2024 10:00:00 GMT</pubDate></item>"
        "<item><link>ftp://a.ro/q</link><pubDate>Tue, 05 Mar 2024 10:00:00 GMT</pubDate></item>"
        "<item><link>https://b.ro/q</link><pubDate>yesterday</pubDate></item>"
        "</channel></rss>"
    )
    got = {r.url: r.rss_date for r in P.read_feed(spark, f"{tmp_path}/feed.xml").collect()}
    assert got == {"https://a.ro/p": dt.date(2024, 3, 5), "https://b.ro/q": None}


def test_decode_html(spark):
    rows = [
        (1, bytearray("é ț".encode()), None),
        (2, bytearray("<meta charset=windows-1252>é".encode("cp1252")), None),
        (3, bytearray("é".encode("latin-1")), "iso-8859-1"),
        (4, bytearray(b"a\xff"), "no-such-set"),
        (5, None, "utf-8"),
        (6, bytearray(b""), " "),
    ]
    df = spark.createDataFrame(rows, "page_id long, content binary, charset string")
    got = {r.page_id: r.t for r in df.select("page_id", P.decode_html(F.col("content"), F.col("charset")).alias("t")).collect()}
    assert got == {1: "é ț", 2: "<meta charset=windows-1252>é", 3: "é", 4: "a�", 5: None, 6: ""}


def test_store_keeps_the_newest(spark, tmp_path):
    path = f"{tmp_path}/results"
    make = lambda *rows: spark.createDataFrame([(k, n, e, dt.datetime(2024, 1, d), v) for k, n, e, d, v in rows], "kind string, name string, extra string, saved_at timestamp, value string")
    S.write_results(make(("flags", "Ana Pop", None, 1, "old"), ("axes", "Ana Pop", None, 1, "other"), ("flags", "Dan", None, 1, None)), path)
    S.write_results(make(("flags", "ANA POP", None, 2, "new"), ("flags", "Ana Pop", "deep", 1, "extra")), path)
    stored = S.read_results(spark, path)
    assert sorted(r.value for r in stored.collect()) == ["extra", "new", "other"]
    assert {r.kind: r.n for r in S.inventory(stored).collect()} == {"flags": 2, "axes": 1}
    wanted = stored.select("kind", "key").union(spark.createDataFrame([("flags", "none")], "kind string, key string"))
    assert [r.key for r in S.missing(wanted, stored).collect()] == ["none"]


def test_ingest_reads_new_pages_alone(spark, tmp_path):
    path, seen = f"{tmp_path}/pages", []
    long = "A paragraph that is long enough to stay"
    add = lambda i: spark.createDataFrame([(i, f"https://a.ro/{i}", f"<p>{long} {i}<p>short", dt.datetime(2024, 1, 1))], PAGES).write.mode("append").parquet(path)
    for i in (1, 2):
        add(i)
        I.ingest(I.stream_pages(spark, path, PAGES), lambda df, n: seen.extend(r.text for r in df.collect()), f"{tmp_path}/checkpoint").awaitTermination()
        assert seen == [f"{long} {k}" for k in range(1, i + 1)]


def test_new_pages_come_once(spark, tmp_path):
    path = f"{tmp_path}/pages"
    spark.createDataFrame([(k, f"https://a.ro/{k % 2}", "", dt.datetime(2024, 1, 1, k)) for k in range(4)], PAGES).write.parquet(path)
    fresh = I.new_pages(I.stream_pages(spark, path, PAGES))
    fresh.writeStream.format("memory").queryName("fresh_pages").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.url for r in spark.table("fresh_pages").collect()) == ["https://a.ro/0", "https://a.ro/1"]


def test_a_key_is_read_from_one_bucket_and_compaction_loses_nothing(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/results"
    row = "kind string, name string, extra string, saved_at timestamp, value string"
    for day in (1, 2, 3):
        S.write_results(spark.createDataFrame([("flags", f"Name {k}", None, dt.datetime(2024, 1, day), f"{k}/{day}") for k in range(40) if day < 3 or k % 2], row), path)
    read = lambda: sorted(r.value for r in S.read_results(spark, path).collect())
    want = sorted(f"{k}/{3 if k % 2 else 2}" for k in range(40))
    one = S.read_results(spark, path, "flags", "NAME 7")
    assert [r.value for r in one.collect()] == ["7/3"]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0]
    before = len(spark.read.parquet(path).inputFiles())
    with monkeypatch.context() as m:
        m.setattr(S, "delete", lambda spark, files: (_ for _ in ()).throw(OSError("stopped")))
        try:
            S.compact(spark, path)
        except OSError:
            pass
    assert read() == want and len(spark.read.parquet(path).inputFiles()) > before
    S.write_results(spark.createDataFrame([("flags", "name 0", None, dt.datetime(2024, 1, 9), "0/9")], row), path)
    assert S.compact(spark, path) > 0
    assert read() == sorted([*(w for w in want if w != "0/2"), "0/9"])
    assert S.compact(spark, path) == 0 and len(spark.read.parquet(path).inputFiles()) <= S.BUCKETS
