"""Feeds that arrive bit by bit: items of each new file, and the first date of each address across batches."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from attesta.sources.pages import FEED_ITEM, feed_items

#: The state store that keyed state with timers needs.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stream_feed(spark: SparkSession, path: str) -> DataFrame:
    """(url, rss_date) of the items of feeds that are put into a folder as files, as they come. The query's checkpoint holds which
    files were read, so a restart reads neither a file twice nor passes one by; an item that stands in several files comes
    with each (first_dates keeps one)."""
    return feed_items(spark.readStream.format("xml").option("rowTag", "item").schema(FEED_ITEM).load(path))


class _First(StatefulProcessor):
    """Holds the smallest seq of a key with its date; gives a row whenever that changes."""

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", T.StructType([T.StructField("seq", T.LongType()), T.StructField("rss_date", T.DateType())]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.first.get() if self.first.exists() else None
        best = min(((r.seq, r.rss_date) for r in rows), key=lambda x: x[0])
        if self.keep_ms is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.keep_ms)
        if known is None or best[0] < known[0]:
            self.first.update(best)
            yield Row(entity_id=key[0], url=key[1], rss_date=best[1], seq=best[0])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.first.clear()
        return iter([])

    def close(self) -> None:
        pass


def first_dates(found: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """(entity_id, url, rss_date, seq) of a stream of discovered addresses: a row when an address is new, and again when an earlier
    find of it (a smaller seq) comes later, in update mode. The last row of each address is what merge_discovered gives for all rows
    at once, however they are cut into batches.

    found: (entity_id, url, rss_date, seq). State is a date and a number for each address; with keep_ms, an address that isn't seen
    for so many milliseconds is forgotten by a timer. The session must use STORE.
    """
    kind = found.schema["entity_id"].dataType.simpleString()
    grouped = found.select("entity_id", "url", "rss_date", F.col("seq").cast("long").alias("seq")).groupBy("entity_id", "url")
    return grouped.transformWithState(_First(keep_ms), f"entity_id {kind}, url string, rss_date date, seq long", "Update", "none" if keep_ms is None else "ProcessingTime")
