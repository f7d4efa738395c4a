"""Answers of an outside model, read back as tables and held against the source text."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from attesta.functions.likeness import ratio
from attesta.functions.text import cut_words, fold, norm_words, once, plain_quotes, split_sentences, squash
from attesta.operators.corpus import keep_first
from attesta.operators.scans import numbered, running
from attesta.sources.scratch import written

#: Fixed values.
CATEGORIES = ["likely_false", "contradiction", "conspiratorial", "unverifiable", "implausible", "logical_fallacy", "misleading", "other_suspicious"]
LEVELS = ["low", "medium", "high"]
FINDING = "array<struct<id: string, category: string, severity: string, confidence: string, quote: string, problem: string, reasoning: string>>"
MAX_FINDINGS = 6
#: Fixed value: how like a quote must be to what stands in the source.
LIKE = 0.85


def strip_fences(content: Column) -> Column:
    """Without the model's thoughts and code fences."""
    bare = F.regexp_replace(F.coalesce(content, F.lit("")), r"(?s)<think>.*?</think>", "")
    return F.trim(F.regexp_replace(bare, r"(?m)^\s*```(?:json)?\s*$", ""))


@F.pandas_udf(T.StringType())
def _salvage(texts: pd.Series) -> pd.Series:
    """Every complete object of a broken array, as an array."""
    import json

    def objects(text: str | None) -> str | None:
        if text is None:
            return None
        decoder, out, k = json.JSONDecoder(), [], text.find("[") + 1
        while 0 <= (k := text.find("{", k)):
            try:
                found, k = decoder.raw_decode(text, k)
                out.append(found)
            except ValueError:
                k += 1
        return json.dumps(out)

    return texts.map(objects)


def parse_findings(responses: DataFrame) -> DataFrame:
    """(request_id, nth, finding): each object of the answers, in their order; only answers that from_json can't read go through Python."""
    base = responses.select("request_id", strip_fences(F.col("content")).alias("t"))
    inner = F.coalesce(F.get_json_object("t", "$.findings"), F.when(F.startswith("t", F.lit("[")), F.col("t")))
    read = base.withColumn("f", F.from_json(inner, FINDING))
    good = read.where("f is not null").select("request_id", F.posexplode("f").alias("nth", "finding"))
    bad = read.where("f is null and t <> ''").withColumn("f", F.from_json(_salvage("t"), FINDING))
    return good.unionByName(bad.select("request_id", F.posexplode("f").alias("nth", "finding")))


def validate_findings(found: DataFrame, most: int = MAX_FINDINGS) -> DataFrame:
    """The first six of an answer (by nth); unknown categories go, bad severities are medium, bad confidences low."""
    rows = found.select("request_id", "nth", "finding.*") if "finding" in found.columns else found
    rows = rows.where(F.col("nth") < most)
    known = lambda c, other: F.when(F.col(c).isin(LEVELS), F.col(c)).otherwise(F.lit(other))
    return rows.where(F.col("category").isin(CATEGORIES)).withColumn("severity", known("severity", "medium")).withColumn("confidence", known("confidence", "low"))


@F.pandas_udf(T.StructType([T.StructField("quote", T.StringType()), T.StructField("ratio", T.DoubleType())]))
def _likest(quotes: pd.Series, pieces: pd.Series, words: pd.Series) -> pd.DataFrame:
    """Of pieces (and their normalised words), the first that is most like the quote, if it is like enough to count.

    The longest common subsequence, by bit-parallel rows, bounds the likeness; what it leaves is compared in full.
    """
    def places(q: str) -> dict:
        at: dict = {}
        for k, c in enumerate(q):
            at[c] = at.get(c, 0) | 1 << k
        return at

    def common(n: int, at: dict, p: str) -> int:
        row = full = (1 << n) - 1
        for c in p:
            hit = row & at.get(c, 0)
            row = (row + hit | row - hit) & full
        return n - row.bit_count()

    out = []
    for q, texts, norms in zip(quotes, pieces, words, strict=True):
        best, at = (None, 0.0), places(q) if q is not None else {}
        for piece, p in zip(texts if q is not None else (), norms if q is not None else (), strict=True):
            # only what can be more like than the best so far is compared
            told = lambda m: 2.0 * m / (len(q) + len(p)) if q or p else 1.0  # noqa: E731, B023
            can = lambda most: most >= LIKE and most > best[1]  # noqa: E731, B023
            if can(told(min(len(q), len(p)))) and can(told(common(len(q), at, p))) and can(like := ratio(q, p)):
                best = (piece, like)
        out.append(best)
    return pd.DataFrame(out, columns=["quote", "ratio"])


def _grams(words: Column) -> Column:
    """Every three neighbouring characters, repeated ones too."""
    return F.regexp_extract_all(words, F.lit("(?s)(?=(...))"), F.lit(1))


def _pieces(text: Column) -> Column:
    """array<struct<piece, words>>: each sentence with its normalised words, then each with the next one."""
    told = F.transform(F.filter(split_sentences(squash(text)), lambda s: s != ""), lambda s: F.struct(s.alias("piece"), norm_words(s).alias("words")))

    def both(x: Column) -> Column:
        join = lambda a, b, c: F.concat(a[c], F.lit(" "), b[c])
        two = lambda a, b: F.struct(join(a, b, "piece").alias("piece"), F.trim(join(a, b, "words")).alias("words"))
        return F.concat(x, F.transform(x, lambda s, k: F.when(k + 1 < F.size(x), two(s, F.get(x, k + 1))).otherwise(s)))

    return once(told, both)


def candidates(quote: Column, text: Column, least: float = LIKE) -> Column:
    """array<struct<piece, words>>: the pieces of one sentence, then those of two, that can be as like the quote's words as `least`.

    Two texts of n and m characters with k of them in matching blocks have at least 5 k - 2 (n + m) - 2 runs of three in common, and
    a likeness of 2 k / (n + m). What they have in common is at most the different runs that both have, and the repeated ones of
    the side with fewer. So lengths and runs leave out pieces without losing any. quote: normalised words.
    """

    def alike(q: Column, x: Column) -> Column:
        both = F.length(q["words"]) + F.length(x["words"])

        def enough(runs: Column) -> Column:
            few = F.least(q["again"], F.length(x["words"]) - 2 - F.size(runs))
            return F.size(F.array_intersect(q["runs"], runs)) + F.greatest(few, F.lit(0)) >= F.lit(5) * F.ceil(both * (least / 2) - 1e-9) - 2 * both - 2

        return once(F.array_distinct(_grams(x["words"])), enough)

    def sized(q: Column) -> Column:
        n = F.length(q["words"])
        return F.filter(_pieces(text), lambda x: (F.length(x["words"]) > 0) & (2 * F.least(n, F.length(x["words"])) >= (n + F.length(x["words"])) * least))

    def runs(w: Column) -> Column:
        return once(F.array_distinct(_grams(w)), lambda r: F.struct(w.alias("words"), r.alias("runs"), (F.length(w) - 2 - F.size(r)).alias("again")))

    return once(once(quote, runs), lambda q: F.filter(sized(q), lambda x: alike(q, x)))


def locate_quotes(claims: DataFrame, least: float = LIKE) -> DataFrame:
    """claims (finding_id, passage_order, quote, text, context) with where the quote stands: (finding_id, located, repaired, in_context).

    In each passage: as it is in the text, then the context; then of the text, and after it of the context: by normalised words
    in one or two sentences (then the source's wording counts), in the whole, by likeness. The first passage that has it in
    any of these ways counts. Quotes under 15 normalised characters and those found nowhere go. Likeness is Python; only
    passages before the first one that an exact stage settles, or all where none does, can get there, and of them only the
    pieces that lengths and common runs of three characters leave (candidates).
    """
    q, qn = F.col("w.q"), F.col("w.qn")

    def stage(c: str):
        # what a function of elements needs is computed once, and not for each of them
        has = lambda x: F.get(F.filter(x["pieces"], lambda p: F.contains(p["words"], x["qn"])), 0)["piece"]
        found = once(F.struct(qn.alias("qn"), _pieces(F.col(c)).alias("pieces")), has)
        return F.when(F.contains(norm_words(F.col(c)), qn), F.coalesce(found, q))

    as_found = lambda where, repaired, in_context: F.struct(where.alias("located"), F.lit(repaired).alias("repaired"), F.lit(in_context).alias("in_context"))
    exact = F.when(F.contains("text", q), as_found(q, False, False)).when(F.contains("context", q), as_found(q, False, True))
    # by a generator, so that words and squashed texts are made once
    said = F.struct(squash(F.col("quote")).alias("q"), norm_words(F.col("quote")).alias("qn"))
    texts = F.struct(*[F.when(F.col(c).isNotNull(), squash(F.col(c))).alias(c) for c in ("text", "context")])
    rows = claims.select("finding_id", "passage_order", "text", "context", F.explode(F.array(said)).alias("w")).where(F.length(qn) >= 15)
    rows = rows.select("finding_id", "passage_order", "w", F.explode(F.array(texts)).alias("t")).select("finding_id", "passage_order", "w", "t.*").withColumn("x", exact)
    rows = rows.withColumn("y", F.when(F.col("x").isNull(), stage("text"))).withColumn("z", F.when(F.col("x").isNull(), stage("context")))
    settled = F.when(F.coalesce("x.located", "y", "z").isNotNull(), F.col("passage_order"))
    rows = rows.withColumn("sure", F.min(settled).over(Window.partitionBy("finding_id")))
    rows = rows.withColumn("x", F.coalesce("x", F.when(F.col("y").isNotNull(), as_found(F.col("y"), True, False))))
    # a passage whose context has the words may still have a likeness in its text, which comes first
    open_ = F.col("x").isNull() & (F.col("sure").isNull() | (F.col("passage_order") <= F.col("sure")))
    # by a generator, so that candidates are looked for once
    near = F.struct(*[F.when(open_, candidates(qn, F.col(c), least)).alias(c) for c in ("text", "context")])
    rows = rows.select("finding_id", "passage_order", qn.alias("qn"), "x", "z", F.explode(F.array(near)).alias("near"))
    part = lambda c, f: F.transform(F.col(f"near.{c}"), lambda x: x[f])
    some = lambda c: F.size(F.col(f"near.{c}")) > 0
    rows = rows.withColumns({f"{c}_{f}": F.when(some(c), part(c, f)) for c in ("text", "context") for f in ("piece", "words")})
    for c in ("text", "context"):
        rows = rows.withColumn(f"in_{c}", _likest(F.when(F.col(f"{c}_piece").isNotNull(), F.col("qn")), F.col(f"{c}_piece"), F.col(f"{c}_words")))
    by_text = F.when(F.col("in_text.ratio") >= least, as_found(F.col("in_text.quote"), True, False)).when(F.col("z").isNotNull(), as_found(F.col("z"), True, True))
    by_context = F.when(F.col("in_context.ratio") >= least, as_found(F.col("in_context.quote"), True, True))
    rows = rows.withColumn("x", F.coalesce("x", by_text, by_context)).where("x is not null")
    return keep_first(rows.select("finding_id", "passage_order", "x.*"), ["finding_id"], ["passage_order"]).select("finding_id", "located", "repaired", "in_context")


#: Relations of two statements that make a finding, with its severity.
RELATIONS = [("direct_contradiction", "high"), ("reversal", "medium"), ("tension", "low")]
#: What a pair's problem is where the answer doesn't say, and how to check it.
PAIR_PROBLEM = "Statements appear inconsistent."


def pair_findings(verdicts: DataFrame) -> DataFrame:
    """verdicts (a_text, b_text, relation, confidence, key_conflict, explanation, ...) that are findings: category, severity,
    confidence, scope, quote, related_quote, problem and reasoning are added. a is the earlier side (order_pair)."""
    severity = F.lit(None).cast("string")
    for relation, level in RELATIONS:
        severity = F.when(F.col("relation") == relation, level).otherwise(severity)
    rows = verdicts.withColumn("severity", severity).where("severity is not null")
    return rows.withColumns(
        {
            "category": F.lit("contradiction"),
            "confidence": F.when(F.col("confidence").isin(LEVELS), F.col("confidence")).otherwise("low"),
            "scope": F.lit("between_statements"),
            "quote": F.col("a_text"),
            "related_quote": F.col("b_text"),
            "problem": F.coalesce(F.nullif(squash(F.col("key_conflict")), F.lit("")), F.lit(PAIR_PROBLEM)),
            "reasoning": squash(F.col("explanation")),
        }
    ).drop("a_text", "b_text", "key_conflict", "explanation")


#: Names shown for categories and levels.
CATEGORY_LABELS = [
    ("likely_false", "Probabil fals"), ("contradiction", "Contradicție"), ("conspiratorial", "Conspiraționist"),
    ("unverifiable", "Neverificabil"), ("implausible", "Improbabil"), ("logical_fallacy", "Eroare logică"),
    ("misleading", "Înșelător"), ("other_suspicious", "Altfel suspect"),
]
#: Fixed values.
LEVEL_LABELS = [("low", "scăzută"), ("medium", "medie"), ("high", "ridicată")]


def label_findings(found: DataFrame, categories=CATEGORY_LABELS, levels=LEVEL_LABELS) -> DataFrame:
    """found with category_label, severity_label and confidence_label; null where a value has no name."""
    lookup = lambda pairs, c: F.element_at(F.create_map(*[F.lit(x) for p in pairs for x in p]), F.col(c))
    return found.withColumn("category_label", lookup(categories, "category")).withColumn("severity_label", lookup(levels, "severity")).withColumn("confidence_label", lookup(levels, "confidence"))


def level_weight(c: Column) -> Column:
    return F.when(c == "high", 3).when(c == "medium", 2).otherwise(1)


def rank_findings(found: DataFrame, min_confidence: str = "low") -> DataFrame:
    """One row of each finding_id of enough confidence, the gravest first, newer first among equals."""
    kept = keep_first(found, ["finding_id"], ["date", "doc_id"]).where(level_weight(F.col("confidence")) >= level_weight(F.lit(min_confidence)))
    weight = 3 * level_weight(F.col("severity")) + 2 * level_weight(F.col("confidence"))
    w = Window.partitionBy("entity_id").orderBy(F.col("weight").desc(), F.col("date").desc_nulls_last(), "finding_id")
    return kept.withColumn("weight", weight).withColumn("rank", F.row_number().over(w))


def flag_summary(found: DataFrame) -> DataFrame:
    """(entity_id, by_category, by_severity) as maps of counts."""
    one = lambda c: found.groupBy("entity_id", c).agg(F.count("*").alias("n")).groupBy("entity_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "n")))).alias(f"by_{c}"))
    return one("category").join(one("severity"), "entity_id")


def to_score(pole: Column, strength: Column) -> Column:
    """Left clear 1, left slight 2, balanced 3, right slight 4, right clear 5, else null."""
    return F.when((pole == "left") & (strength == "clear"), 1).when(pole == "left", 2).when(pole == "balanced", 3).when((pole == "right") & (strength == "clear"), 5).when(pole == "right", 4)


def validate_axis(answers: DataFrame) -> DataFrame:
    """answers (subject_id, axis_id, score, confidence, evidence, refs, sent): only evidence of a known source whose quote was sent stays; a score without any goes."""
    said = lambda c: F.lower(squash(c))
    kept = F.filter("evidence", lambda e: F.array_contains("refs", e["source"]) & (e["quote"] != "") & F.contains(said(F.col("sent")), said(e["quote"])))
    rows = answers.withColumn("evidence", kept)
    lost = F.col("score").isNotNull() & (F.size("evidence") == 0)
    return rows.withColumn("dropped_unsupported", lost).withColumn("confidence", F.when(lost, "low").otherwise(F.col("confidence"))).withColumn("score", F.when(~lost, F.col("score")))


def salvage_axis(content: Column) -> Column:
    """struct(pole, strength, confidence, evidence) read field by field from a cut answer; null without a pole."""
    field = lambda name: F.nullif(F.regexp_extract(content, rf'"{name}"\s*:\s*"([^"]*)"', 1), F.lit(""))
    objects = F.regexp_extract_all(content, F.lit(r"\{[^{}]*\"quote\"[^{}]*\}"), F.lit(0))
    evidence = F.transform(objects, lambda o: F.struct(F.regexp_extract(o, r'"source"\s*:\s*"([^"]*)"', 1).alias("source"), F.regexp_extract(o, r'"quote"\s*:\s*"([^"]*)"', 1).alias("quote")))
    return F.when(field("pole").isNotNull(), F.struct(field("pole").alias("pole"), field("strength").alias("strength"), field("confidence").alias("confidence"), evidence.alias("evidence")))


def all_axes(subjects: DataFrame, axes: DataFrame, scores: DataFrame) -> DataFrame:
    """A row for each subject and axis; score null where there is none. axes has a fixed ten rows."""
    return subjects.select("subject_id").crossJoin(axes.select("axis_id")).join(scores, ["subject_id", "axis_id"], "left")


def clamp_score(c: Column) -> Column:
    """A number rounded half to even and held between 1 and 10; else null."""
    return F.when(c.try_cast("double").isNotNull(), F.greatest(F.lit(1), F.least(F.lit(10), F.bround(c.try_cast("double"), 0).cast("int"))))


def formula(x: Column, y: Column, z: Column, w: Column) -> Column:
    d = lambda c: c.cast("decimal(12,4)")
    return F.bround(d(x) * F.lit("0.2").cast("decimal(3,1)") + d(y) * F.lit("0.2").cast("decimal(3,1)") + d(z) * F.lit("0.4").cast("decimal(3,1)") + d(w) * F.lit("0.2").cast("decimal(3,1)"), 1).cast("decimal(4,1)")


def article_scores(items: DataFrame, members: DataFrame, history: DataFrame) -> DataFrame:
    """(entity_id, doc_id, x, y, w, z, score): scores of known articles with all parts; the first answer of an article counts."""
    parts = {"x": "feasibility", "y": "precision", "w": "manipulation"}
    rows = items.join(members, ["request_id", "local_id"]).withColumns({k: clamp_score(F.col(v)) for k, v in parts.items()})
    rows = rows.where("x is not null and y is not null and w is not null")
    rows = keep_first(rows, ["entity_id", "doc_id"], ["request_id", "local_id"]).join(history.select("entity_id", F.col("history").alias("z")), "entity_id")
    return rows.select("entity_id", "doc_id", "x", "y", "w", "z", formula(*map(F.col, "xyzw")).alias("score"))


def entity_credibility(scored: DataFrame) -> DataFrame:
    """(entity_id, x, y, z, w, score, n_articles): means over articles, one decimal, and the formula on them."""
    mean = lambda c: F.bround(F.avg(F.col(c).cast("decimal(12,4)")).cast("decimal(12,4)"), 1).alias(c)
    means = scored.groupBy("entity_id").agg(mean("x"), mean("y"), F.max("z").alias("z"), mean("w"), F.count("*").alias("n_articles"))
    return means.withColumn("score", formula(*map(F.col, "xyzw")))


def fit_lines(rows: DataFrame, by: str, length: Column, budget: int, order: list) -> DataFrame:
    """Rows, in order, until their lengths and a line end each exceed the budget for the first time. A group is spread over tasks."""
    return running(rows, [by], order, _sum=length + 1).where(F.col("_sum") <= budget).drop("_sum")


def fit_counts(rows: DataFrame, by: str, length: Column, budget: int, order: list) -> DataFrame:
    """(by, n_kept, n_cut): how many of the rows fit_lines keeps and how many it leaves out."""
    fits = F.col("_sum") <= budget
    return running(rows, [by], order, _sum=length + 1).groupBy(by).agg(F.count_if(fits).alias("n_kept"), F.count_if(~fits).alias("n_cut"))


def top_flags(ranked: DataFrame, most: int = 5) -> DataFrame:
    """(entity_id, top_flags): the first ranked findings as array<struct<rank, category, severity, quote, domain>>. ranked: rank_findings with domain."""
    one = F.struct("rank", "category", "severity", cut_words(F.col("quote"), 160).alias("quote"), "domain")
    return ranked.where(F.col("rank") <= most).groupBy("entity_id").agg(F.array_sort(F.collect_list(one)).alias("top_flags"))


def ungrounded(summary: Column, material: Column) -> Column:
    """Numbers, capitalised words inside sentences and acronyms of a summary that its material lacks; distinct, in order."""
    mat = fold(material)
    digits = F.regexp_replace(mat, r"[.\s]", "")
    text = F.regexp_replace(summary, r"(^|\n)[ \t]*[-•*][ \t]*", "$1. ")
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"\d[\d.,]*\d|\d"), F.lit(0)), lambda n: F.regexp_replace(n, "[.,]+$", ""))
    numbers = F.filter(numbers, lambda n: ~F.contains(mat, n) & ~F.contains(digits, F.regexp_replace(n, r"[.\s]", "")))
    names = F.regexp_extract_all(text, F.lit(r"(?<![.!?]\s)(?<!^)(?U:\b)([A-ZĂÂÎȘȚŞŢ][a-zăâîșțşţ]{3,})"), F.lit(1))
    names = F.filter(names, lambda n: ~F.contains(mat, F.substring(fold(n), 1, 5)))
    short = F.regexp_extract_all(text, F.lit(r"(?U:\b)[A-ZĂÂÎȘȚŞŢ]{2,}[A-Za-zăâîșțşţ]*(?U:\b)"), F.lit(0))
    short = F.filter(short, lambda n: ~F.contains(mat, fold(n)))
    return F.array_distinct(F.concat(numbers, names, short))


NO_INFORMATION = "FARA_INFORMAT"


def summary_status(attempts: DataFrame) -> DataFrame:
    """(request_id, summary, verified, unsupported). attempts: (request_id, attempt from 1 on, summary, material).

    Without a first summary, or where it says that there is no information, there is none. Else the last attempt that says
    something counts; it is verified if all of it is grounded.
    """
    says = (F.trim(F.coalesce("summary", F.lit(""))) != "") & ~F.contains(F.upper(F.coalesce("summary", F.lit(""))), F.lit(NO_INFORMATION))
    marked = attempts.withColumn("_says", says)
    first = keep_first(marked, ["request_id"], ["attempt"]).select("request_id", F.col("_says").alias("_first"))
    last = keep_first(marked.where("_says"), ["request_id"], [F.col("attempt").desc()])
    none = F.expr("cast(array() as array<string>)")
    out = first.join(last.select("request_id", "summary", ungrounded(F.col("summary"), F.col("material")).alias("missing")), "request_id", "left")
    return out.select("request_id", F.when(F.col("_first"), F.col("summary")).alias("summary"), (F.col("_first") & (F.size("missing") == 0)).alias("verified"), F.when(F.col("_first"), F.col("missing")).otherwise(none).alias("unsupported"))


def trim_truncated(content: Column, finish_reason: Column) -> Column:
    """Thoughts gone; of an answer cut by length, the last line goes unless it ends like a sentence. Null where nothing is left."""
    bare = F.trim(F.regexp_replace(content, r"(?s)<think>.*?(</think>|$)", ""))
    lines = F.split(bare, "\n")
    whole = F.element_at(lines, -1).rlike(r'[.!?)"”]\s*$')
    kept = F.when((finish_reason == "length") & ~whole, F.trim(F.array_join(F.slice(lines, 1, F.size(lines) - 1), "\n"))).otherwise(bare)
    return F.nullif(kept, F.lit(""))


#: Verbs of saying in a paragraph; least room for a source; characters of a paragraph.
SAYING = r"(?iU)\b(a spus|a declarat|a afirmat|a anun[țt]at|a promis|susține|propune|vrea|consider[ăa])\b"
SOURCE_ROOM, LEAST_ROOM, PARAGRAPH = 700, 200, 600


def axis_paragraphs(paras: DataFrame, axes: DataFrame) -> DataFrame:
    """paras with axis_id and weight: those over 40 characters with the axis's words that name the entity or quote.

    Weight 3 for each hit (at most 3), 2 for the name, 2 for a quotation, 1 for a verb of saying, 2 for an official source.
    paras: (entity_id, doc_id, pos, text, official, names_entity, ...); axes: (axis_id, rx), a fixed ten.
    """
    rows = paras.withColumn("text", plain_quotes(F.trim("text"))).where(F.length("text") > 40)
    hits = F.regexp_count("text", F.col("rx"))
    rows = rows.crossJoin(axes.select("axis_id", "rx")).withColumn("_hits", hits).where("_hits > 0").where(F.col("names_entity") | F.col("text").rlike('[„"“]'))
    some = lambda c, n: F.when(c, n).otherwise(0)
    weight = 3 * F.least("_hits", F.lit(3)) + some(F.col("names_entity"), 2) + some(F.col("text").rlike('[„"“]'), 2) + some(F.col("text").rlike(SAYING), 1) + some(F.col("official"), 2)
    return rows.withColumn("weight", weight).drop("_hits", "rx")


def _share(n: Column, budget: int) -> Column:
    return F.greatest(F.lit(SOURCE_ROOM), F.floor(F.lit(budget) / n)).cast("int")


def _blocks(rows: DataFrame, budget: int) -> DataFrame:
    """(entity_id, axis_id, place, doc_id, header, body): what is kept of each source; body is empty where nothing is.

    rows: (entity_id, axis_id, place, share, used, doc_id, header, minus, pos, text), a row without text being a source alone. A source's heaviest
    paragraphs that fit its room are kept, in the text's order, and others passed over. Where used is null, each source has its
    share. Else the sources of a group share what is left of the budget behind `used`, in order, and under LEAST_ROOM the rest is left out.
    Rows stream, sorted, through a task that holds one source.
    """
    names = ["entity_id", "axis_id", "place", "doc_id", "header", "body"]
    schema = T.StructType([*(T.StructField(c, rows.schema[c].dataType) for c in names[:-1]), T.StructField("body", T.StringType())])
    types = [to_arrow_type(f.dataType) for f in schema.fields]

    def keep(batches: Iterator) -> Iterator:
        import pyarrow as pa

        group, used, over, source, out = None, None, False, None, []

        def close() -> None:
            nonlocal used, source
            if source is not None:
                body = "\n".join(f"- {t}" for _, t in sorted(source["kept"]))
                out.append((*source["row"], body))
                if used is not None and body:
                    used += len(source["row"][-1]) + len(body) + 2
            source = None

        for batch in batches:
            for entity, axis, place, share, begun, doc, header, pos, text in zip(*(batch.column(k).to_pylist() for k in range(9)), strict=True):
                if group is None or group != (entity, axis):
                    close()
                    group, used, over = (entity, axis), begun, False
                if source is not None and source["row"][2] != place:
                    close()
                if over:
                    continue
                if source is None:
                    room = (share if used is None else min(share, budget - used)) - len(header) - 2
                    if used is not None and room < LEAST_ROOM:
                        over = True
                        continue
                    source = {"row": (entity, axis, place, doc, header), "room": room, "size": 0, "kept": []}
                if text is not None and source["size"] + len(text) + 3 <= source["room"]:
                    source["kept"].append((pos, text))
                    source["size"] += len(text) + 3
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                out = []
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return rows.select("entity_id", "axis_id", "place", "share", "used", "doc_id", "header", "pos", "text").mapInArrow(keep, schema)


def axis_context(paras: DataFrame, axes: DataFrame, budget: int) -> DataFrame:
    """(entity_id, axis_id, context, refs): the text of an axis's request, and which source each tag [S1].. stands for.

    paras: as for axis_paragraphs, with header (what is shown of the source). Sources by official and weight; each has an
    equal share of the budget, 700 characters at least. Its heaviest paragraphs that fit are kept, in the text's order, and
    others passed over; under 200 characters of room the rest of the sources is left out.

    As long as the budget holds a whole share, what a source keeps hangs on itself alone: those are found source by source, and a
    running total tells where they end. Only the sources behind that, with the paragraphs that can still fit, stream through one task.
    """
    rows = axis_paragraphs(paras, axes)
    group = ["entity_id", "axis_id"]
    docs = rows.groupBy(*group, "doc_id").agg(F.sum("weight").alias("_sum"), F.max("official").alias("_official"), F.first("header").alias("_header"))
    docs = numbered(docs, group, [F.col("_official").desc(), F.col("_sum").desc(), F.col("doc_id")], "place")
    docs = docs.join(docs.groupBy(*group).agg(F.count("*").alias("_n")), group)
    docs = docs.select(*group, "doc_id", "place", _share(F.col("_n"), budget).alias("share"), F.concat(F.lit("[S"), F.col("place").cast("string"), F.lit("] "), F.col("_header")).alias("header"))
    told = rows.select(*group, "doc_id", (-F.col("weight")).alias("minus"), "pos", F.substring("text", 1, PARAGRAPH).alias("text")).join(docs, [*group, "doc_id"])
    in_order = lambda df, *by: df.repartition(*by).sortWithinPartitions(*group, "place", "minus", "pos")
    alone = written(_blocks(in_order(told.withColumn("used", F.lit(None).cast("int")), *group, "doc_id"), budget).join(docs.select(*group, "place", "share"), [*group, "place"]), "blocks")
    took = F.when(F.col("body") != "", F.length("header") + F.length("body") + 2).otherwise(0)
    alone = running(alone, group, ["place"], _upto=took).withColumn("_before", F.col("_upto") - took)
    whole = F.lit(budget) - F.col("_before") >= F.col("share")
    closed = F.col("share") - F.length("header") - 2 < LEAST_ROOM
    ends = alone.groupBy(*group).agg(F.min(F.when(~whole, F.col("place"))).alias("_part"), F.min(F.when(whole & closed, F.col("place"))).alias("_shut"), F.min(F.when(~whole, F.col("_before"))).cast("int").alias("_used"))
    alone = alone.join(ends, group)
    settled = alone.where((F.col("_part").isNull() | (F.col("place") < F.col("_part"))) & (F.col("_shut").isNull() | (F.col("place") < F.col("_shut")))).where("body <> ''")
    tail = alone.where((F.col("place") >= F.col("_part")) & (F.col("_shut").isNull() | (F.col("_shut") > F.col("_part")))).select(*group, "place", "doc_id", "share", "header", F.col("_used").alias("used"))
    fits = F.length("text") + 3 <= F.lit(budget) - F.col("used") - F.length("header") - 2
    left = told.select(*group, "place", "minus", "pos", "text").join(tail, [*group, "place"]).where(fits)
    left = left.unionByName(tail.withColumns({"minus": F.lit(None).cast(told.schema["minus"].dataType), "pos": F.lit(None).cast(told.schema["pos"].dataType), "text": F.lit(None).cast("string")}))
    last = _blocks(in_order(left, *group), budget).where("body <> ''")
    both = settled.select(*last.columns).unionByName(last)
    listed = both.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("place", "header", "body", "doc_id"))).alias("x"))
    context = F.array_join(F.transform("x", lambda b: F.concat(b["header"], F.lit("\n"), b["body"])), "\n\n")
    return listed.select(*group, context.alias("context"), F.transform("x", lambda b: F.struct(F.concat(F.lit("S"), b["place"].cast("string")).alias("tag"), b["doc_id"].alias("doc_id"))).alias("refs"))
