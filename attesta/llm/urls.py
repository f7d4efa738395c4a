"""URL verdicts: fixed host and path rules, and else association rules mined by FP-growth from labelled URLs.

A URL is a set of tokens (host suffixes and labels, path parts, query keys). FP-growth mines the token combinations of
labelled URLs together with their label, long URLs through conditional bases; rules that tell the label with enough support, confidence and lift are kept, of
those with the same or a weaker say only the shortest. Pages find the rules they satisfy through an inverted index that
holds each rule under its rarest token.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.llm.common import materialise, small, table

#: Least share of labelled URLs that show a combination together with the label, least share of those with the combination
#: that have the label, and how many times the label's share of all URLs that must be.
MIN_SUPPORT, MIN_CONFIDENCE, MIN_LIFT = 0.002, 0.6, 1.5
#: Least number of labelled URLs behind a rule, whatever their share.
MIN_ROWS = 5
#: Items of a basket that goes to FP-growth whole (it has at most 2 ** MAX_ITEMS combinations); longer ones go through conditional bases.
MAX_ITEMS = 10
#: Verdict, host, path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: The label among the items of a basket.
BAD = -1


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule (host and path) that fits, as struct(rule, verdict), else null. A rule's host fits its subdomains."""
    chain = None
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        found = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        chain = F.when(fits, found) if chain is None else chain.when(fits, found)
    return chain


def tokens_of(url: Column) -> Column:
    """Distinct tokens: each label of the host, its registered suffix pairs, parts of the path, keys of the query."""
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    pairs = F.when(F.size(labels) > 1, F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda k: F.concat(F.lit("d:"), F.array_join(F.slice(labels, k, 2), "."))))
    parts = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("p:"), x))
    keys = F.transform(F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#?]+)"), F.lit(1)), lambda x: F.concat(F.lit("q:"), x))
    names = F.transform(F.filter(labels, lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    return F.array_distinct(F.concat(names, F.coalesce(pairs, F.expr("cast(array() as array<string>)")), parts, keys))


def _items(baskets: DataFrame, least: int) -> DataFrame:
    """(token, item, n, bad): the frequent tokens and the item that stands for each: tokens that the very same URLs have
    (a host's label and its pairs, the parts of one path) are one item, the smallest of them. n: URLs with it, bad: bad ones."""
    each = baskets.select(F.xxhash64("row").alias("k"), "bad", F.explode("tokens").alias("token"))
    counted = each.groupBy("token").agg(F.count("*").alias("n"), F.count_if("bad").alias("bad"), F.bit_xor("k").alias("x"), F.bit_xor(F.xxhash64("k")).alias("y"))
    return counted.where(F.col("bad") >= least).withColumn("item", F.min("token").over(Window.partitionBy("n", "x", "y"))).select("token", "item", "n", "bad")


def _fp_growth(bases: DataFrame, least: int, min_confidence: float) -> DataFrame:
    """(items, n, bad): combinations of two items at least, with those of their prefix, that tell the label surely enough.

    Baskets of all bases are mined at once: an item is written behind its base's prefix, so bases share none.
    """
    from pyspark.ml.fpm import FPGrowth

    name = lambda item: F.concat(F.array_join("prefix", "."), F.lit(":"), item.cast("string"))
    labelled = F.when(F.col("bad"), F.concat("items", F.array(F.lit(BAD)))).otherwise(F.col("items"))
    baskets = materialise(bases.select(F.transform(labelled, name).alias("items")), "url-baskets")
    total = baskets.count()
    rules = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / max(1, total)), minConfidence=min_confidence).fit(baskets).associationRules
    rules = rules.where(F.endswith(F.get("consequent", 0), F.lit(f":{BAD}")) & (F.size("antecedent") > 1))
    prefix = F.filter(F.split(F.split(F.get("antecedent", 0), ":")[0], r"\."), lambda x: x != "").cast("array<int>")
    own = F.transform("antecedent", lambda x: F.split(x, ":")[1].cast("int"))
    bad = F.round(F.col("support") * total)
    return rules.select(F.concat(prefix, own).alias("items"), F.round(bad / F.col("confidence")).cast("long").alias("n"), bad.cast("long").alias("bad"))


def combinations(baskets: DataFrame, least: int, min_confidence: float) -> DataFrame:
    """(items, n, bad): all combinations of items that at least `least` bad baskets have and that tell the label surely enough,
    n baskets and bad bad ones having them; perhaps without some that a part of theirs makes needless, being as sure.

    baskets: (items, bad), items being distinct numbers. This is FP-growth's recursion, the bases of one depth at a
    time: the base of a prefix holds, of each basket with the prefix, the items that come before it. A base whose baskets
    have at most MAX_ITEMS items is mined; the items of others are prefixes one longer, each with its base. From a
    base go items that too few bad baskets have, those all its baskets have (the prefix alone is as sure) and those that only bad
    ones have (nothing longer is surer); no others, so nothing is missed, and rounds end when no base is too long.
    """
    bases = baskets.select(F.expr("cast(array() as array<int>)").alias("prefix"), F.lit(-1).cast("long").alias("all"), "bad", F.array_sort("items").alias("items"))
    bases, found = bases.where(F.size("items") > 0).withColumn("basket", F.monotonically_increasing_id()), None
    while True:
        bases = materialise(bases, "url-bases")
        each = bases.select("prefix", "all", "bad", F.explode("items").alias("item"))
        counts = each.groupBy("prefix", "all", "item").agg(F.count("*").alias("n"), F.count_if("bad").alias("n_bad")).where((F.col("n_bad") >= least) & (F.col("n") != F.col("all")))
        counts = materialise(counts, "url-counts")
        told = counts.where(F.col("n_bad") / F.col("n") >= min_confidence).select(F.concat("prefix", F.array("item")).alias("items"), "n", F.col("n_bad").alias("bad"))
        found = told if found is None else found.union(told)
        lasting = counts.where("n > n_bad").select("prefix", "item", "n")
        kept = bases.select("prefix", "basket", "bad", F.explode("items").alias("item")).join(lasting, ["prefix", "item"])
        kept = kept.groupBy("prefix", "basket", "bad").agg(F.array_sort(F.collect_list(F.struct("item", "n"))).alias("own"))
        kept = materialise(kept, "url-kept")
        long = materialise(kept.groupBy("prefix").agg(F.max(F.size("own")).alias("most")).where(F.col("most") > MAX_ITEMS).select("prefix"), "url-long")
        short = kept.join(long, "prefix", "left_anti").select("prefix", "bad", F.transform("own", lambda x: x["item"]).alias("items"))
        if not short.isEmpty():
            found = found.union(_fp_growth(short, least, min_confidence))
        if long.isEmpty():
            return found
        at = kept.join(long, "prefix").select("prefix", "bad", "own", F.posexplode("own").alias("at", "last")).where("at > 0")
        longer = F.concat("prefix", F.array("last.item")).alias("prefix")
        bases = at.select(longer, F.col("last.n").alias("all"), "bad", F.transform(F.slice("own", 1, F.col("at")), lambda x: x["item"]).alias("items"))
        bases = bases.withColumn("basket", F.monotonically_increasing_id())


def mine(labelled: DataFrame, url: str = "url", bad: str = "bad", min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT, min_rows: int = MIN_ROWS) -> DataFrame:
    """(rule_id, antecedent, rarest, confidence, support): token combinations that tell a bad URL. Empty when nothing passes.

    Rows with a null url or label are left out; repeated rows count each. A combination needs min_rows bad URLs and their share
    min_support. Tokens that always stand together are one item; a URL is described by all its items, however many. The
    label is one more item of the basket; of the rules whose consequent is that item those stay that have no shorter
    rule within them as confident. rarest: the antecedent's token that the fewest labelled URLs have.
    """
    rows = labelled.where(F.col(url).isNotNull() & F.col(bad).isNotNull()).select(tokens_of(F.col(url)).alias("tokens"), F.col(bad).alias("bad"))
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "url-tokens")
    total, all_bad = rows.agg(F.count("*"), F.count_if("bad")).first()
    least = max(min_rows, math.ceil(min_support * total))
    items = materialise(_items(rows, least), "url-items")
    # heads are bounded: each has a share min_support of the URLs, which have a bounded number of tokens each; frequent ones have small numbers
    heads = materialise(items.where("token = item").select("item", "n", F.row_number().over(Window.orderBy(F.desc("n"), "item")).alias("number")), "url-heads")
    own = rows.select("row", "bad", F.explode("tokens").alias("item")).join(small(heads.select("item", "number")), "item")
    told = combinations(own.groupBy("row", "bad").agg(F.collect_list("number").alias("items")), least, min_confidence)
    share = F.lit(max(1, all_bad) / max(1, total))
    told = materialise(told.where(F.col("bad") / F.col("n") / share >= min_lift).withColumn("told", F.monotonically_increasing_id()), "url-told")
    named = told.select("told", "n", "bad", F.explode("items").alias("number")).join(small(heads.select("item", "number")), "number")
    found = named.groupBy("told", "n", "bad").agg(F.array_sort(F.collect_list("item")).alias("antecedent"))
    found = found.select("antecedent", (F.col("bad") / F.col("n")).alias("confidence"), (F.col("bad") / total).alias("support"))
    found = materialise(found.withColumn("rule_id", F.xxhash64("antecedent")), "url-rules")
    shorter = found.select(F.col("rule_id").alias("other"), F.col("antecedent").alias("part"), F.col("confidence").alias("says"), F.get("antecedent", 0).alias("token"))
    within = found.withColumn("token", F.explode("antecedent")).join(shorter, "token").where((F.size("part") < F.size("antecedent")) & (F.col("says") >= F.col("confidence")) & (F.size(F.array_except("part", "antecedent")) == 0))
    kept = found.join(within.select("rule_id").distinct(), "rule_id", "left_anti")
    rare = kept.select("rule_id", F.explode("antecedent").alias("item")).join(heads.select("item", "n"), "item").groupBy("rule_id").agg(F.min(F.struct("n", "item")).alias("r"))
    return kept.join(rare.select("rule_id", F.col("r.item").alias("rarest")), "rule_id").select("rule_id", "antecedent", "rarest", "confidence", "support")


def match(pages: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """(url, confidence): for each distinct url with a rule all of whose tokens it has, the best rule's confidence. rules is a table.

    The index holds each rule under its rarest token, so common tokens (a top-level domain) meet only rules of that token alone.
    """
    own = pages.where(F.col(url).isNotNull()).select(F.col(url).alias("url")).distinct().withColumn("tokens", tokens_of(F.col("url")))
    met = own.select("url", "tokens", F.explode("tokens").alias("token")).join(small(rules), F.col("token") == F.col("rarest"))
    return met.where(F.size(F.array_except("antecedent", "tokens")) == 0).groupBy("url").agg(F.max("confidence").alias("confidence"))


def judge(pages: DataFrame, labelled: DataFrame, id_col: str = "page_id", url: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, confidence) for every row of pages, repeated ones included.

    host: behind the first `://`, lower-cased (A-Z); path: what follows up to ? or #; both empty for a null url or one
    without `://`. The longest fixed rule decides; where none fits, a mined rule blocks; else the page is allowed. Without
    labelled rows no rule is mined. Of other columns only the id is kept. An empty table gives no rows.
    """
    rules = materialise(mine(labelled), "url-index")
    found = materialise(match(pages, rules, url), "url-found").withColumnRenamed("url", "_url")
    base = pages.select(F.col(id_col), F.col(url).alias("url")).join(found, F.col("url") == F.col("_url"), "left")
    base = base.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    base = base.withColumn("fixed", rule_of(F.col("host"), F.col("path")))
    mined = F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")
    return base.select(id_col, "host", "path", F.col("fixed.rule").alias("rule"), F.coalesce("fixed.verdict", mined).alias("verdict"), "confidence")


def op8_urls(spark, sf_dir: str) -> DataFrame:
    """Pages labelled through labels.quality of the same number: quality 0 is bad."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    quality = table(spark, sf_dir, "labels").where("quality is not null").groupBy("doc_id").agg((F.min("quality") == 0).alias("bad"))
    return judge(pages, pages.join(quality, pages.page_id == quality.doc_id).select("url", "bad"))
