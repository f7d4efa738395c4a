"""Profile feeds, roll-ups, search plans, reports and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions.text import cut_words, fold
from attesta.operators.corpus import keep_first
from attesta.operators.extract import analysis_stats
from attesta.operators.passages import replan_failed
from attesta.operators.quiz import leaning, site_position
from attesta.operators.responses import strip_fences
from attesta.operators.scans import running
from attesta.sources.scratch import written


def domain_rollup(sources: DataFrame) -> DataFrame:
    """(domain, n_sources, n_with_statements, official, n_entities). sources: (domain, entity_id, has_statement, official)."""
    return sources.groupBy("domain").agg(F.count("*").alias("n_sources"), F.count_if("has_statement").alias("n_with_statements"), F.max("official").alias("official"), F.countDistinct("entity_id").alias("n_entities"))


def profile_items(sources: DataFrame, statements: DataFrame, speeches: DataFrame) -> DataFrame:
    """(entity_id, doc_id, type, lead, promises, others) of sources with a speech or statement. sources: (entity_id, doc_id, official);
    statements: (entity_id, doc_id, seq, text, is_promise); speeches: (entity_id, doc_id, turn, text)."""
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("seq", "text")))), lambda x: x["text"])
    said = statements.groupBy("entity_id", "doc_id").agg(in_order(F.col("is_promise")).alias("promises"), in_order(~F.col("is_promise")).alias("others"), F.min_by("text", "seq").alias("first"))
    spoke = speeches.groupBy("entity_id", "doc_id").agg(F.min_by("text", "turn").alias("speech"))
    rows = sources.join(said, ["entity_id", "doc_id"], "left").join(spoke, ["entity_id", "doc_id"], "left").where("speech is not null or promises is not null")
    kind = F.when(F.col("speech").isNotNull() | F.col("official"), "discurs").otherwise("articol")
    none = F.expr("cast(array() as array<string>)")
    lead = F.coalesce("speech", "first")
    return rows.select("entity_id", "doc_id", kind.alias("type"), cut_words(lead, 420).alias("lead"), F.coalesce("promises", none).alias("promises"), F.coalesce("others", none).alias("others"))


def press_feed(sources: DataFrame) -> DataFrame:
    """Sources that aren't official and have evidence."""
    return sources.where("not official and n_evidence > 0")


def recent_feed(items: DataFrame, as_of: str, months: int = 12) -> tuple[DataFrame, DataFrame]:
    """(items of the last months with rank, newest first; counts of older and undated ones by entity)."""
    since = F.add_months(F.lit(as_of).cast("date"), -months)
    w = Window.partitionBy("entity_id").orderBy(F.col("date").desc(), "doc_id")
    recent = items.where(F.col("date") >= since).withColumn("rank", F.row_number().over(w))
    counts = items.groupBy("entity_id").agg(F.count_if(F.col("date") < since).alias("n_older"), F.count_if(F.col("date").isNull()).alias("n_undated"))
    return recent, counts


def search_plan(entities: DataFrame, templates: DataFrame, cap: int) -> DataFrame:
    """(entity_id, rank, query): templates filled with names, groups in turn, each query once, at most cap.

    templates: (group_no, rank_in_group, template) with {n}; a fixed small table, so the cross join is linear in entities.
    """
    made = entities.select("entity_id", "name").crossJoin(templates).withColumn("query", F.replace("template", F.lit("{n}"), F.col("name")))
    made = keep_first(made, ["entity_id", "query"], ["rank_in_group", "group_no"])
    return made.withColumn("rank", F.row_number().over(Window.partitionBy("entity_id").orderBy("rank_in_group", "group_no"))).where(F.col("rank") <= cap).select("entity_id", "rank", "query")


def merge_discovered(feeds: DataFrame, user: DataFrame) -> DataFrame:
    """(entity_id, url, rss_date, seq): the first date of each address; the user's come last, undated."""
    both = feeds.select("entity_id", "url", "rss_date", "seq").unionByName(user.select("entity_id", "url", F.lit(None).cast("date").alias("rss_date"), (F.col("seq") + (1 << 40)).alias("seq")))
    return keep_first(both, ["entity_id", "url"], ["seq"])


def opinion_sources(second: DataFrame, main: DataFrame) -> DataFrame:
    return second.join(main.select("entity_id", "url"), ["entity_id", "url"], "left_anti")


def _numbered(rows: DataFrame, most: int, line: Column, name: str) -> DataFrame:
    kept = rows.where(F.col("rank") <= most).groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("x"))
    return kept.select("entity_id", F.array_join(F.transform("x", lambda r: r["line"]), "\n\n").alias(name))


def report(entities: DataFrame, statements: DataFrame, speeches: DataFrame, education: DataFrame, funding: DataFrame, sources: DataFrame) -> DataFrame:
    """(entity_id, report): five numbered sections; a sentence stands where nothing was found. Tables carry `rank` and `text`."""
    cut = F.when(F.length("text") > 2500, F.concat(F.substring("text", 1, 2500), F.lit("…"))).otherwise(F.col("text"))
    numbered = F.concat(F.col("rank").cast("string"), F.lit(". "), cut)
    parts = [("STATEMENTS", statements, 30), ("SPEECHES", speeches, 20), ("EDUCATION", education, 30), ("FUNDING", funding, 40), ("SOURCES", sources, 30)]
    out, sections = entities.select("entity_id", "name"), []
    for k, (title, rows, most) in enumerate(parts, 1):
        out = out.join(_numbered(rows, most, numbered, f"s{k}"), "entity_id", "left")
        sections.append(F.concat(F.lit(f"{k}. {title}\n"), F.coalesce(f"s{k}", F.lit("Not found in the sources that were read."))))
    return out.select("entity_id", F.concat_ws("\n\n", F.concat(F.lit("REPORT: "), F.col("name")), *sections).alias("report"))


def flag_report(found: DataFrame) -> DataFrame:
    """(entity_id, report) of ranked findings, with the other side of pairs."""
    line = F.concat_ws("\n", F.concat(F.col("rank").cast("string"), F.lit(". ["), F.upper("severity"), F.lit("] "), F.col("category")), F.concat(F.lit("“"), F.col("quote"), F.lit("”")), F.when(F.col("related_quote").isNotNull(), F.concat(F.lit("vs. “"), F.col("related_quote"), F.lit("”"))), F.col("problem"), F.concat(F.lit("source: "), F.col("doc_id")))
    return _numbered(found, 1 << 30, line, "report")


def export_profile(scores: DataFrame, quality: DataFrame, responses: DataFrame | None = None, identity: str | None = None, economy: str | None = None) -> DataFrame:
    """(respondent_id, json): axes with two decimals and their positions, leaning, answers, and quality.

    responses: (respondent_id, item_id, value, is_dk), answers as they were given; identity and economy name the axes of the
    leaning. A respondent's axes and answers are a questionnaire's, so lists are short.
    """
    position = F.round(site_position(F.col("score")))
    axis = F.struct("axis_id", "status", F.col("k").alias("items"), F.round(6 - F.col("score"), 2).alias("score"), F.round("margin", 2).alias("margin"), position.alias("position"))
    rows = scores.groupBy("respondent_id").agg(F.array_sort(F.collect_list(axis)).alias("axes")).join(quality, "respondent_id", "left")
    told = ["axes", "flags", "dk_share"]
    if identity is not None:
        sides = scores.withColumn("value", position).select(F.col("respondent_id").alias("subject_id"), F.col("axis_id").cast("string").alias("axis_id"), "value")
        rows = rows.join(leaning(sides, identity, economy).withColumnRenamed("subject_id", "respondent_id"), "respondent_id", "left")
        told.append("leaning")
    if responses is not None:
        given = F.struct("item_id", F.when(F.col("is_dk"), "dk").otherwise(F.col("value").cast("string")).alias("answer"))
        rows = rows.join(responses.groupBy("respondent_id").agg(F.array_sort(F.collect_list(given)).alias("answers")), "respondent_id", "left")
        told.append("answers")
    return rows.select("respondent_id", F.to_json(F.struct(*told)).alias("json"))


def export_analysis(entities: DataFrame, **tables: DataFrame) -> DataFrame:
    """(entity_id, json): one nested object of each entity; lists capped by rank."""
    caps = {"education": 30, "funding": 40, "speeches": 100, "statements": 100}
    out = entities
    for name, rows in tables.items():
        own = F.struct(*[c for c in rows.columns if c != "entity_id"])
        out = out.join(rows.where(F.col("rank") <= caps.get(name, 100)).groupBy("entity_id").agg(F.array_sort(F.collect_list(own)).alias(name)), "entity_id", "left")
    return out.select("entity_id", F.to_json(F.struct("*")).alias("json"))


def pick_sources(sources: DataFrame, statements: DataFrame, as_of: str, most: int = 40) -> DataFrame:
    """Sources with text, not older than the same month a year ago, with a statement or evidence; the newest."""
    since = F.add_months(F.trunc(F.lit(as_of).cast("date"), "month"), -12)
    has = statements.select("entity_id", "doc_id").distinct().withColumn("_s", F.lit(True))
    rows = sources.join(has, ["entity_id", "doc_id"], "left").where((F.length(F.trim("text")) > 0) & (F.col("date") >= since) & (F.col("_s").isNotNull() | (F.size("evidence") > 0)))
    w = Window.partitionBy("entity_id").orderBy(F.col("date").desc(), "doc_id")
    return rows.drop("_s").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def doc_material(paras: DataFrame, surname: Column, cap: int) -> DataFrame:
    """(doc_id, material): the whole text if it is short enough; else paragraphs with the surname, or all where none has it, as
    long as they fit; where not even the first does, the text's first `cap` characters."""
    size = F.length("text") + 2
    told = paras.select("doc_id", "pos", size.cast("long").alias("size"), F.contains("norm", surname).alias("named"))
    facts = told.groupBy("doc_id").agg((F.sum("size") - 2).alias("total"), F.max("named").alias("anyone"))
    whole = F.col("total") <= cap
    told = told.join(facts, "doc_id").withColumn("chosen", whole | ~F.col("anyone") | F.col("named"))
    told = running(told, ["doc_id"], ["pos"], seen=F.col("size"), upto=F.when(F.col("chosen"), F.col("size")))
    told = told.withColumn("fits", F.col("chosen") & (whole | (F.col("upto") <= cap)))
    # without a fitting paragraph, those that the first characters reach, or the blank line before them, are kept for the cut
    told = told.join(told.groupBy("doc_id").agg(F.max("fits").alias("some")), "doc_id").where(F.col("fits") | (~F.col("some") & (F.col("seen") - F.col("size") < cap + 2)))
    rows = paras.select("doc_id", "pos", "text").join(told.select("doc_id", "pos", "some"), ["doc_id", "pos"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n\n")
    return rows.groupBy("doc_id").agg(F.when(F.max("some"), text).otherwise(F.substring(text, 1, cap)).alias("material"))


def evidence_material(rows: DataFrame, cap: int = 9000, most: int = 14) -> DataFrame:
    """(entity_id, material): the first 14 items, each behind a line [S1] with its source, a blank line apart, until one doesn't
    fit. rows: (entity_id, rank, domain, date, title, excerpt)."""
    head = F.concat(F.lit("[S"), F.col("rank").cast("string"), F.lit("] "), F.coalesce("domain", F.lit("")), F.lit(" | "), F.coalesce(F.col("date").cast("string"), F.lit("fără dată")), F.lit(" | "), F.substring(F.coalesce("title", F.lit("")), 1, 100))
    w = Window.partitionBy("entity_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    kept = rows.where(F.col("rank") <= most).withColumn("line", F.concat(head, F.lit("\n"), F.coalesce("excerpt", F.lit(""))))
    kept = kept.withColumn("size", F.sum(F.length("line") + 2).over(w) - 2).where(F.col("size") <= cap)
    return kept.groupBy("entity_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n\n").alias("material"))


def build_requests(batches: DataFrame, task: str, system: str) -> DataFrame:
    """(request_id, task, entity_id, batch_no, system, user, members): one row for each call. batches: (entity_id, batch_no, local_id, ref, body)."""
    item = F.struct("local_id", "ref", "body")
    rows = batches.groupBy("entity_id", "batch_no").agg(F.array_sort(F.collect_list(item)).alias("x"))
    user = F.array_join(F.transform("x", lambda r: r["body"]), "\n\n")
    made = rows.withColumn("user", user).withColumn("system", F.lit(system)).withColumn("task", F.lit(task))
    request = F.substring(F.sha2(F.concat_ws("\n", "task", F.col("entity_id").cast("string"), F.col("batch_no").cast("string"), "user"), 256), 1, 16)
    return made.select(request.alias("request_id"), "task", "entity_id", "batch_no", "system", "user", F.transform("x", lambda r: F.struct(r["local_id"].alias("local_id"), r["ref"].alias("ref"))).alias("members"))


def answer_with(requests: DataFrame, fn) -> DataFrame:
    """(request_id, content, finish_reason): fn(iterator of pandas frames) gives these where a model is at hand."""
    return requests.mapInPandas(fn, "request_id string, content string, finish_reason string")


def usable(content: Column, finish_reason: Column) -> Column:
    """An answer that ends by itself and holds an object or a list."""
    t = strip_fences(content)
    return F.coalesce((finish_reason != "length") & (F.startswith(t, F.lit("[")) | F.try_parse_json(t).isNotNull()), F.lit(False))


def relabelled(members: Column) -> Column:
    """members (local_id, ref, body) numbered anew, P1, P2, ..., also at the heads of their bodies."""
    label = lambda k: F.concat(F.lit("P"), (k + 1).cast("string"))
    return F.transform(members, lambda m, k: F.struct(label(k).alias("local_id"), m["ref"].alias("ref"), F.regexp_replace(m["body"], r"^\[[^\]]*\]", F.concat(F.lit("["), label(k), F.lit("]"))).alias("body")))


def answered(requests: DataFrame, fn, depth: int = 3) -> DataFrame:
    """(request_id, entity_id, members, content, finish_reason): the answers of all requests, unusable ones asked again in halves.

    requests: (request_id, entity_id, system, members of local_id, ref and body). A request of several members whose answer isn't usable is replaced by
    its halves, ".1" and ".2", up to `depth` times; what can't be halved keeps the answer it got (null where fn gave none). Each turn's answers
    are written, so nothing is asked twice, and a turn asks only what failed before; turns end when nothing did.
    """
    todo, out = requests.select("request_id", "entity_id", "system", "members"), None
    for _ in range(depth + 1):
        asked = todo.withColumn("user", F.array_join(F.transform("members", lambda m: m["body"]), "\n\n"))
        now = written(todo.join(answer_with(asked, fn), "request_id", "left"), "answers")
        halve = ~usable(F.col("content"), F.col("finish_reason")) & (F.size("members") > 1) & (F.size(F.split("request_id", "\\.")) - 1 < depth)
        done = now.where(~halve).select("request_id", "entity_id", "members", "content", "finish_reason")
        out = done if out is None else out.unionByName(done)
        again = now.where(halve).select("request_id", "entity_id", "system", "members")
        if again.isEmpty():
            break
        todo = replan_failed(again, again, depth).withColumn("members", relabelled(F.col("members")))
    return out


def history_header(found: DataFrame) -> DataFrame:
    """(entity_id, total, header): how many findings, by category, the most frequent first."""
    counts = found.groupBy("entity_id", "category").agg(F.count("*").alias("n"))
    rows = counts.groupBy("entity_id").agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "category", "n"))).alias("x"))
    return rows.select("entity_id", "total", F.concat(F.lit("FLAGS: "), F.col("total").cast("string"), F.lit("; "), F.array_join(F.transform("x", lambda r: F.concat(r["category"], F.lit(" "), r["n"].cast("string"))), ", ")).alias("header"))


#: Findings that a history request shows at most, characters of a quote and of a problem.
MAX_HISTORY, QUOTE_CHARS, PROBLEM_CHARS = 50, 160, 160


def render_finding(place: Column) -> Column:
    """One line of a finding (category, severity, confidence, date, domain, quote, problem)."""
    shown = F.concat_ws(" | ", F.concat(F.lit("[F"), place.cast("string"), F.lit("] "), F.col("category")), F.concat(F.lit("severity "), F.col("severity")), F.concat(F.lit("confidence "), F.col("confidence")), F.coalesce(F.col("date").cast("string"), F.lit("undated")), F.coalesce("domain", F.lit("")))
    return F.concat(shown, F.lit(" | „"), cut_words(F.col("quote"), QUOTE_CHARS), F.lit("” | "), cut_words(F.col("problem"), PROBLEM_CHARS))


def history_request(ranked: DataFrame, passages: DataFrame, budget: int) -> DataFrame:
    """(entity_id, user, n_shown, n_cut): the text of the request for an entity's history.

    A header with totals and counts by category, and as many of the first 50 ranked findings, a line each, as the budget
    holds. ranked: rank_findings with date, domain and problem; passages: (entity_id, doc_id). Entities without findings say so.
    """
    lines = ranked.where(F.col("rank") <= MAX_HISTORY).withColumn("line", render_finding(F.col("rank")))
    w = Window.partitionBy("entity_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("fits", F.sum(F.length("line") + 1).over(w) <= budget)
    shown = lines.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.when(F.col("fits"), F.struct("rank", "line")))).alias("x"), F.count_if("fits").alias("n_shown"), F.count_if(~F.col("fits")).alias("n_cut"))
    counts = passages.groupBy("entity_id").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))
    rows = counts.join(history_header(ranked), "entity_id", "left").join(shown, "entity_id", "left").na.fill(0, ["n_shown", "n_cut", "total"])
    body = F.when(F.col("n_shown") > 0, F.array_join(F.transform("x", lambda r: r["line"]), "\n")).otherwise("(no findings)")
    head = F.concat(F.lit("PASSAGES: "), F.col("n").cast("string"), F.lit(" of "), F.col("docs").cast("string"), F.lit(" articles\n"), F.coalesce("header", F.lit("FLAGS: 0; none")))
    return rows.select("entity_id", F.concat(head, F.lit("\n\n"), body).alias("user"), "n_shown", "n_cut")


#: Passages and findings of an article that a request shows.
ARTICLE_ITEMS = 3


def group_articles(passages: DataFrame, findings: DataFrame, most: int = ARTICLE_ITEMS) -> DataFrame:
    """(entity_id, doc_id, n_passages, passages, n_findings, findings): sources with either, with their first `most` passages (by
    seq) and findings (by finding_id). passages: (entity_id, doc_id, seq, text); findings: (entity_id, doc_id, finding_id,
    category, severity, confidence, problem). Counts are of all; a request shows no more than the first ones, so lists are short."""

    def first(rows: DataFrame, order: str, value: Column, name: str) -> DataFrame:
        w = Window.partitionBy("entity_id", "doc_id").orderBy(order)
        numbered = rows.withColumn("_r", F.row_number().over(w))
        listed = F.array_sort(F.collect_list(F.when(F.col("_r") <= most, F.struct("_r", value.alias("v")))))
        return numbered.groupBy("entity_id", "doc_id").agg(F.count("*").alias(f"n_{name}"), F.transform(listed, lambda x: x["v"]).alias(name))

    a = first(passages, "seq", F.col("text"), "passages")
    b = first(findings, "finding_id", F.struct("finding_id", "category", "severity", "confidence", "problem"), "findings")
    return a.join(b, ["entity_id", "doc_id"], "full").na.fill(0, ["n_passages", "n_findings"])


def profile_stats(items: DataFrame, press: DataFrame, sources: DataFrame) -> DataFrame:
    """(entity_id, n_sources, n_promises, n_press). items: profile_items; press: press_feed; sources: (entity_id, doc_id)."""
    promises = items.groupBy("entity_id").agg(F.sum(F.size("promises")).cast("long").alias("n_promises"))
    out = sources.groupBy("entity_id").agg(F.count("*").alias("n_sources")).join(promises, "entity_id", "left")
    return out.join(press.groupBy("entity_id").agg(F.count("*").alias("n_press")), "entity_id", "left").na.fill(0)


def entity_rollup(entities: DataFrame, sources: DataFrame, speeches: DataFrame, statements: DataFrame, education: DataFrame, funding: DataFrame) -> DataFrame:
    """(entity_id, n_sources, n_speeches, n_statements, n_education, n_funding) of every entity."""
    return analysis_stats(entities, n_sources=sources, n_speeches=speeches, n_statements=statements, n_education=education, n_funding=funding)


def contains_name(text: Column, name: Column) -> Column:
    return F.contains(fold(text), fold(name))
