"""Reading pages, feeds and bytes of unknown character sets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.functions.urls import is_page, normalize_url
from attesta.operators.corpus import keep_first


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages that are HTML and aren't files by their address; one row of each normalised address (the smallest page_id)."""
    pages = spark.read.parquet(path).where(is_page(F.col("url")))
    html = F.contains(F.lower(F.substring("html", 1, 2000)), F.lit("<html"))
    rows = pages.where(html).withColumn("final_url", F.coalesce(normalize_url(F.col("url")), F.col("url")))
    return keep_first(rows, ["final_url"], ["page_id"])


#: What is read of a feed's item.
FEED_ITEM = "link string, pubDate string"


def feed_items(items: DataFrame) -> DataFrame:
    """(url, rss_date) of items (link, pubDate): the address inside a ?url= parameter counts; dates by RFC 2822."""
    inner = F.regexp_extract("link", r"[?&]url=([^&]+)", 1)
    url = normalize_url(F.when(inner != "", F.url_decode(inner)).otherwise(F.col("link")))
    date = F.to_date(F.try_to_timestamp(F.regexp_extract("pubDate", r"(\d{1,2} \w{3} \d{4})", 1), F.lit("d MMM yyyy")))
    return items.select(url.alias("url"), date.alias("rss_date")).where("url is not null")


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """feed_items of a feed's file or folder; what isn't XML gives no rows."""
    return feed_items(spark.read.format("xml").option("rowTag", "item").schema(FEED_ITEM).load(path))


@F.pandas_udf(T.StringType())
def _decode(data: pd.Series, charset: pd.Series) -> pd.Series:
    def one(b, c):
        try:
            return None if b is None else bytes(b).decode(c)
        except (LookupError, UnicodeDecodeError):
            return bytes(b).decode("utf-8", "replace")

    return pd.Series([one(b, c) for b, c in zip(data, charset, strict=True)])


def decode_html(content: Column, header_charset: Column) -> Column:
    """Bytes as text: by the header's character set, else one told in the first 3000 bytes, else UTF-8 with replacement.

    Valid bytes of the usual sets are decoded by Spark; Python sees only the others (null goes there for all that are decoded)."""
    head = F.decode(F.substring(content, 1, 3000), "ISO-8859-1")
    told = F.coalesce(F.nullif(F.upper(F.trim(header_charset)), F.lit("")), F.nullif(F.upper(F.regexp_extract(head, r"(?i)charset=[\"']?([A-Za-z0-9_-]+)", 1)), F.lit("")), F.lit("UTF-8"))
    native = F.when(told.isin("UTF-8", "UTF8"), F.try_validate_utf8(content.cast("string")))
    latin = F.when(told.isin("ISO-8859-1", "LATIN1"), F.decode(content, "ISO-8859-1"))
    plain = F.coalesce(native, latin)
    return F.coalesce(plain, _decode(F.when(plain.isNull(), content), told))
