"""Passages, cues, request batches, snippets and candidate pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions import lexicons as L
from attesta.functions.text import fold, norm_words, plain_quotes, split_chunks, split_sentences
from attesta.operators.corpus import keep_first
from attesta.operators.extract import is_promise
from attesta.operators.scans import batches

#: Kinds with the weight and the name that requests show.
KINDS = [("speech", 3.0, "speech"), ("quote", 2.0, "direct quote"), ("reported", 1.0, "article passage")]
#: Passages and characters of a request; characters of a token; tokens kept free.
MAX_PASSAGES, MAX_CHARS, CHARS_PER_TOKEN, SYSTEM_CHARS_PER_TOKEN, SAFETY_TOKENS, HEADER_TOKENS = 8, 5000, 2.6, 3.4, 300, 160


def latest_news(items: DataFrame, since: str, n_sources: int = 20, per_source: int = 3) -> DataFrame:
    """items (entity_id, doc_id, date, is_speech, seq) of each entity's newest sources, speeches first, at most per_source of each."""
    recent = items.where(F.col("date") >= F.lit(since).cast("date"))
    docs = recent.groupBy("entity_id", "doc_id").agg(F.max("date").alias("_d"))
    docs = docs.withColumn("_r", F.row_number().over(Window.partitionBy("entity_id").orderBy(F.col("_d").desc(), "doc_id"))).where(F.col("_r") <= n_sources).select("entity_id", "doc_id")
    w = Window.partitionBy("entity_id", "doc_id").orderBy(F.col("is_speech").desc(), "seq")
    return recent.join(docs, ["entity_id", "doc_id"], "left_semi").withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= per_source)


def heuristic_cues(text: Column, cues=L.CUES, promise=L.PROMISE) -> Column:
    """Labels of the cue patterns that the folded text matches, in order, and the promise cue."""
    folded = fold(text)
    return F.array_compact(F.array(*[F.when(folded.rlike(rx), F.lit(label)) for label, rx in cues], F.when(is_promise(text, promise), F.lit(L.PROMISE_CUE))))


def passages(speeches: DataFrame, quotes: DataFrame, reported: DataFrame, since: str, chunk: int = 1200, least: int = 40) -> DataFrame:
    """(entity_id, kind, doc_id, seq, text, context, date, source_score, cues, priority): one table of what is to be looked at.

    All three tables: (entity_id, doc_id, seq, text, date, source_score), quotes with context too. Speeches come in pieces,
    quotes with their context if it says more, and reported excerpts; undated, old, short and repeated ones go, and the
    first stays in the order speech, quote, reported.
    """
    cols = ["entity_id", "doc_id", "seq", "text", "context", "date", "source_score", "kind"]
    none = F.lit(None).cast("string")
    pieces = speeches.withColumn("text", F.explode(split_chunks(F.col("text"), chunk))).withColumn("context", none).withColumn("kind", F.lit("speech")).select(cols)
    said = quotes.withColumn("context", F.when(F.length("context") > F.length("text") + 30, F.col("context"))).withColumn("kind", F.lit("quote")).select(cols)
    told = reported_only(reported, quotes).withColumn("context", none).withColumn("kind", F.lit("reported")).select(cols)
    both = pieces.unionByName(said).unionByName(told).where((F.length("text") >= least) & (F.col("date") >= F.lit(since).cast("date")))
    order = F.when(F.col("kind") == "speech", 0).when(F.col("kind") == "quote", 1).otherwise(2)
    keyed = both.withColumn("_k", F.substring(norm_words(F.col("text")), 1, 300)).withColumn("_o", order)
    kept = keep_first(keyed, ["entity_id", "_k"], ["_o", "doc_id", "seq", "text"]).drop("_k", "_o")
    return kept.withColumn("cues", heuristic_cues(F.col("text"))).withColumn("priority", priority(F.col("kind"), F.size("cues"), F.col("source_score")))


def reported_only(reported: DataFrame, quotes: DataFrame, surname: str = "surname") -> DataFrame:
    """Excerpts with the surname and a verb of saying, that hold no quote's context of the same source."""
    base = reported.where(F.contains(fold(F.col("text")), F.col(surname))) if surname in reported.columns else reported
    base = base.where(fold(F.col("text")).rlike(L.ATTRIBUTION)).withColumn("_w", norm_words(F.col("text")))
    ctx = quotes.select(F.col("entity_id").alias("_e"), F.col("doc_id").alias("_d"), norm_words(F.coalesce("context", F.col("text"))).alias("_c"))
    return base.join(ctx, (F.col("entity_id") == F.col("_e")) & (F.col("doc_id") == F.col("_d")) & F.contains(F.col("_w"), F.col("_c")), "left_anti").drop("_w")


def priority(kind: Column, n_cues: Column, score: Column) -> Column:
    """By kind, a little for each cue, and for the source; four decimals, halves up."""
    base = F.when(kind == "speech", 3.0).when(kind == "quote", 2.0).otherwise(1.0)
    return (F.floor((base + F.lit(0.4) * n_cues + score / F.lit(100.0)) * 10000 + 0.5) / 10000).cast("decimal(12,4)")


def render_passage(label: Column, kind: Column, cues: Column, text: Column, context: Column) -> Column:
    """The text block of one passage in a request; quotation marks become apostrophes."""
    name = kind
    for k, _, shown in KINDS:
        name = F.when(kind == k, shown).otherwise(name)
    return F.concat_ws("\n", F.concat(F.lit("["), label, F.lit("] TYPE: "), name), F.when(F.size(cues) > 0, F.concat(F.lit("CUES: "), F.array_join(cues, "; "))), F.concat(F.lit("STATEMENT: "), plain_quotes(text)), F.when(F.length(context) > 0, F.concat(F.lit("SURROUNDING TEXT: "), plain_quotes(context))))


def export_passages(rows: DataFrame) -> DataFrame:
    """(entity_id, kind, text, source) of all passages, those without a finding too. rows: passages with title, domain, date, url."""
    source = F.struct(*[F.col(c) for c in ("doc_id", "title", "domain", "date", "url")])
    return rows.select("entity_id", "kind", F.substring("text", 1, 400).alias("text"), source.alias("source"))


def batch_budget(token_cap: int, answer_tokens: int, system_chars: int) -> int:
    """Characters of passages a request may hold, between 1500 and 5000."""
    free = token_cap - answer_tokens - SAFETY_TOKENS - HEADER_TOKENS - int(system_chars / SYSTEM_CHARS_PER_TOKEN)
    return max(1500, min(MAX_CHARS, int(free * CHARS_PER_TOKEN)))


def pack_batches(rows: DataFrame, by: list[str], size: str, budget: int, most: int = MAX_PASSAGES, order: list | str = "seq") -> DataFrame:
    """rows with batch_no: in order, a new batch begins when the next row doesn't fit in size or number.

    Only the keys and the size take part in the search (scans.batches, which spreads a group over tasks) and are joined back.
    """
    order = [order] if isinstance(order, str) else order
    sizes = rows.select(*by, *order, F.col(size).alias("_own")).dropDuplicates([*by, *order])
    return rows.join(batches(sizes, by, order, F.col("_own"), budget, most).drop("_own"), [*by, *order])


def article_batches(articles: DataFrame, budget: int, most: int = MAX_PASSAGES) -> DataFrame:
    """articles (entity_id, doc_id, date, size) with batch_no: the newest first, undated last; each takes its text and a blank line."""
    ordered = articles.withColumn("_age", -F.coalesce(F.unix_date("date"), F.lit(-(1 << 30)))).withColumn("_size", F.col("size") + 2)
    return pack_batches(ordered, ["entity_id"], "_size", budget, most, ["_age", "doc_id"]).drop("_age", "_size")


def snippets(units: DataFrame, cap: int = 160, n: int = 500) -> DataFrame:
    """(entity_id, snippet_id, doc_id, source_score, text, stems, nums, neg): short statements to compare, at most `cap` of each entity.

    units: (entity_id, doc_id, seq, kind, text, source_score). Quotes count whole, up to 500 characters; of others, sentences
    of 60 to 500, with a verb of saying (reported) or a cue (speech).
    """
    quotes = units.where("kind = 'quote'").withColumn("piece", F.substring("text", 1, n)).withColumn("k", F.lit(0))
    rest = units.where("kind <> 'quote'").select("*", F.posexplode(split_sentences(F.col("text"))).alias("k", "p")).withColumn("piece", F.trim("p")).drop("p")
    rest = rest.where(F.length("piece").between(60, 500))
    rest = rest.where((F.col("kind") != "reported") | fold(F.col("piece")).rlike(L.ATTRIBUTION)).where((F.col("kind") != "speech") | (F.size(heuristic_cues(F.col("piece"))) > 0))
    both = quotes.unionByName(rest).withColumn("_key", norm_words(F.col("piece")))
    kept = keep_first(both, ["entity_id", "_key"], ["doc_id", "seq", "k"]).drop("_key")
    return with_marks(kept.drop("text").withColumnRenamed("piece", "text"), cap)


def with_marks(rows: DataFrame, cap: int = 160, order: tuple = ("doc_id", "seq", "k")) -> DataFrame:
    w = Window.partitionBy("entity_id").orderBy(F.col("source_score").desc(), *order)
    top = rows.withColumn("snippet_id", F.row_number().over(w).cast("long")).where(F.col("snippet_id") <= cap)
    return top.select("entity_id", "snippet_id", "doc_id", "source_score", "text", stems(F.col("text")).alias("stems"), numbers(F.col("text")).alias("nums"), negated(F.col("text")).alias("neg"))


def stems(text: Column) -> Column:
    """Distinct six-letter beginnings of words of at least five letters that aren't stop words."""
    words = F.filter(F.regexp_extract_all(fold(text), F.lit("[a-z]+"), F.lit(0)), lambda w: (F.length(w) >= 5) & ~w.isin(L.STOPWORDS))
    return F.array_sort(F.array_distinct(F.transform(words, lambda w: F.substring(w, 1, 6))))


def numbers(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(L.NUMBER), F.lit(0))))


def negated(text: Column) -> Column:
    return fold(text).rlike(L.NEGATION)


def candidate_pairs(found: DataFrame, top: int = 20, least: int = 3) -> DataFrame:
    """(entity_id, i, j, shared, score, rank): pairs of snippets on one topic that might contradict each other.

    A pair shares at least three stems, and at most four fifths (more is the same text again). Exact prefix filter: stems
    in ascending frequency, a pair must share one of each side's first n - 2; only those meet in the join.
    """
    freq = found.select("entity_id", F.explode("stems").alias("stem")).groupBy("entity_id", "stem").agg(F.count("*").alias("f"))
    ranked = found.select("entity_id", "snippet_id", F.size("stems").alias("n"), F.explode("stems").alias("stem")).join(freq, ["entity_id", "stem"])
    ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy("entity_id", "snippet_id").orderBy("f", "stem"))).where(F.col("r") <= F.col("n") - (least - 1))
    ranked = ranked.select("entity_id", "stem", F.col("snippet_id").alias("i"))
    met = ranked.join(ranked.withColumnRenamed("i", "j"), ["entity_id", "stem"]).where("i < j").select("entity_id", "i", "j").distinct()
    side = lambda x: found.select("entity_id", F.col("snippet_id").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("doc_id", "stems", "nums", "neg")])
    both = met.join(side("i"), ["entity_id", "i"]).join(side("j"), ["entity_id", "j"])
    both = both.withColumn("shared", F.size(F.array_intersect("i_stems", "j_stems"))).where(F.col("shared") >= least)
    both = both.where(F.col("shared") <= F.lit(0.8) * F.size(F.array_union("i_stems", "j_stems")))
    figures = F.when((F.size("i_nums") > 0) & (F.size("j_nums") > 0) & (F.col("i_nums") != F.col("j_nums")), 2.0).otherwise(0.0)
    score = F.col("shared") + figures + F.when(F.col("i_neg") != F.col("j_neg"), 1.5).otherwise(0.0) + F.when(F.col("i_doc_id") != F.col("j_doc_id"), 0.5).otherwise(0.0)
    rank = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.col("score").desc(), F.col("i").desc(), F.col("j").desc()))
    return both.withColumn("score", score).withColumn("rank", rank).where(F.col("rank") <= top).select("entity_id", "i", "j", F.col("shared").cast("long").alias("shared"), "score", F.col("rank").cast("long").alias("rank"))


def order_pair(a_date: Column, b_date: Column) -> Column:
    """True where the sides must be swapped, so that the earlier statement comes first."""
    return F.coalesce(b_date.isNotNull() & (a_date > b_date), F.lit(False))


def replan_failed(requests: DataFrame, failed: DataFrame, depth: int = 3) -> DataFrame:
    """requests (request_id, members) with each failed one of several members as two halves, ".1" and ".2"; the others untouched."""
    n, level = F.size("members"), F.size(F.split("request_id", "\\.")) - 1
    bad = requests.join(failed.select("request_id").distinct(), "request_id", "left_semi").where((n > 1) & (level < depth))
    half = F.floor(n / 2).cast("int")
    halves = bad.select(F.col("*"), F.explode(F.array(F.struct(F.lit(".1").alias("s"), F.slice("members", 1, half).alias("m")), F.struct(F.lit(".2").alias("s"), F.slice("members", half + 1, n).alias("m")))).alias("x"))
    halves = halves.withColumn("request_id", F.concat("request_id", "x.s")).withColumn("members", F.col("x.m")).drop("x")
    return requests.join(bad.select("request_id"), "request_id", "left_anti").unionByName(halves)
