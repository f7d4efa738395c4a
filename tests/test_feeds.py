"""Feeds that arrive in batches, against all of them at once."""

from __future__ import annotations

import datetime as dt
import random
import time

import pytest

from attesta.operators import profile as H
from attesta.streaming import feeds


@pytest.fixture
def with_state(spark):
    spark.conf.set(*feeds.STORE)
    yield spark
    spark.conf.unset(feeds.STORE[0])


def feed(path, items) -> None:
    path.write_text("<rss><channel>" + "".join(f"<item><link>{u}</link><pubDate>{d:%a, %d %b %Y} 10:00:00 GMT</pubDate></item>" for u, d in items) + "</channel></rss>")


def test_a_restart_neither_repeats_nor_loses_items(spark, tmp_path):
    (tmp_path / "in").mkdir()
    seen, days = [], [dt.date(2024, 3, k) for k in range(1, 8)]
    for k in range(3):
        feed(tmp_path / "in" / f"{k}.xml", [(f"https://a.ro/{k}/{j}", days[j]) for j in range(2 + k)])
        stream = feeds.stream_feed(spark, f"{tmp_path}/in").writeStream.foreachBatch(lambda df, n: seen.extend((r.url, r.rss_date) for r in df.collect()))
        stream.option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        assert sorted(seen) == sorted((f"https://a.ro/{i}/{j}", days[j]) for i in range(k + 1) for j in range(2 + i))


SCHEMA = "entity_id long, url string, rss_date date, seq long"


@pytest.mark.parametrize("cut", [1, 3])
def test_first_dates_are_those_of_the_batch_query(with_state, tmp_path, cut):
    spark, path = with_state, f"{tmp_path}/found"
    random.seed(cut)
    rows = [(random.randrange(3), f"u{random.randrange(9)}", random.choice([None, dt.date(2024, 1, random.randint(1, 28))]), k) for k in range(60)]
    random.shuffle(rows)
    last: dict = {}
    size = len(rows) // cut
    for k in range(cut):
        spark.createDataFrame(rows[k * size : (k + 1) * size], SCHEMA).coalesce(1).write.mode("append").parquet(path)
        out = feeds.first_dates(spark.readStream.schema(SCHEMA).parquet(path))

        def keep(df, n):
            for r in df.collect():
                last[r.entity_id, r.url] = (r.rss_date, r.seq)

        out.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    user = spark.createDataFrame([], "entity_id long, url string, seq long")
    whole = H.merge_discovered(spark.createDataFrame(rows, SCHEMA), user)
    assert last == {(r.entity_id, r.url): (r.rss_date, r.seq) for r in whole.collect()}


def test_a_forgotten_address_comes_again(with_state, tmp_path):
    """A timer clears the state of an address that isn't seen for a moment, so it is new again."""
    spark, path, told = with_state, f"{tmp_path}/found", []
    add = lambda: spark.createDataFrame([(1, "u", None, 5)], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    add()
    out = feeds.first_dates(spark.readStream.schema(SCHEMA).parquet(path), keep_ms=1)
    stream = out.writeStream.outputMode("update").foreachBatch(lambda df, n: told.extend(r.url for r in df.collect()))
    stream = stream.option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(processingTime="200 milliseconds").start()
    try:
        for k in range(60):
            time.sleep(0.5)
            if len(told) == 1 and k % 8 == 7:
                add()
            if len(told) > 1:
                break
    finally:
        stream.stop()
    assert told[:2] == ["u", "u"]
