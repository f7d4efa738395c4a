"""Queries of the chain from passages to requests, answers, scores, reports and feeds. Each reads whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from attesta.functions import lexicons as L
from attesta.functions import text as X
from attesta.operators import corpus as C
from attesta.operators import extract as D
from attesta.operators import passages as E
from attesta.operators import profile as H
from attesta.operators import quiz as G
from attesta.operators import responses as R
from attesta.plans import registry as Q
from attesta.plans.registry import _t, query
from attesta.sources import dimensions as A
from attesta.sources import pages as P
from attesta.sources import scratch

_NL = "chr(10)"
_SQUASH = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
_DAY = "date '2026-01-01' + cast(doc_id % 400 as int)"


def _day():
    return F.date_add(F.lit("2026-01-01").cast("date"), F.pmod("doc_id", F.lit(400)).cast("int"))


def _docs(spark, d):
    """Documents by source, with a made-up date."""
    return _t(spark, d, "documents").select(F.col("source").alias("entity_id"), "doc_id", "lang", "text", "n_chars", _day().alias("date"))


def _cut(s, n):
    return f"case when length({s}) > {n} then regexp_replace(left({s}, {n}), ' [^ ]*$', '') || '…' else {s} end"


# ---- sources, dimensions, exports
@query("select page_id, md5(html) as h from pages")
def a3_decode_html(spark, d):
    pages = _t(spark, d, "pages").withColumn("bytes", F.encode("html", "UTF-8"))
    return pages.select("page_id", F.md5(P.decode_html(F.col("bytes"), F.lit(None).cast("string"))).alias("h"))


@query(r"""select c_custkey, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '-') as entity_id, case when alias is not null then string_split(alias, ' ')[1] else array_to_string(list_transform(string_split(c_name, ' '), lambda w: upper(w[1])), '') end as short, case when alias is null then 1 else 2 end as n_variants
from (select *, case when c_custkey % 3 = 0 then c_mktsegment || ' ' || c_custkey end as alias from customer)""")
def a6_entities(spark, d):
    rows = _t(spark, d, "customer").select("c_custkey", F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 3 == 0, F.concat_ws(" ", "c_mktsegment", "c_custkey")).alias("alias"))
    return A.load_entities(rows).select("c_custkey", "entity_id", "short", F.size("variants").cast("long").alias("n_variants"))


@query(f"""with r as (select source as entity_id, text, row_number() over (partition by source order by n_chars desc, doc_id) as rank from documents),
b as (select entity_id, string_agg(rank || '. ' || case when length(text) > 2500 then left(text, 2500) || '…' else text end, {_NL} || {_NL} order by rank) as s, string_agg(case when rank <= 20 then rank || '. ' || case when length(text) > 2500 then left(text, 2500) || '…' else text end end, {_NL} || {_NL} order by rank) as t from r where rank <= 30 group by 1)
select entity_id, md5('REPORT: ' || entity_id || {_NL} || {_NL} || '1. STATEMENTS' || {_NL} || s || {_NL} || {_NL} || '2. SPEECHES' || {_NL} || t || {_NL} || {_NL} || '3. EDUCATION' || {_NL} || none || {_NL} || {_NL} || '4. FUNDING' || {_NL} || none || {_NL} || {_NL} || '5. SOURCES' || {_NL} || s) as h from b, (select 'Not found in the sources that were read.' as none)""")
def a8_report_text(spark, d):
    ranked = D.rank_by(_docs(spark, d), F.col("n_chars").desc(), F.col("doc_id"), top=30).select("entity_id", "rank", "text")
    none = ranked.where("false")
    people = ranked.select("entity_id").distinct().withColumn("name", F.col("entity_id"))
    return H.report(people, ranked, ranked, none, none, ranked).select("entity_id", F.md5("report").alias("h"))


#: Findings made from orders.
_FINDINGS = """found as (select cast(o_orderkey as varchar) as finding_id, o_custkey as entity_id, o_orderkey // 2 as doc_id, cast(o_orderdate as date) as date, case o_orderpriority when '1-URGENT' then 'likely_false' when '2-HIGH' then 'misleading' when '3-MEDIUM' then 'implausible' else 'unverifiable' end as category, case o_orderstatus when 'F' then 'high' when 'O' then 'medium' else 'low' end as severity, case o_orderkey % 3 when 0 then 'low' when 1 then 'medium' else 'high' end as confidence, o_orderpriority || ' ' || o_orderkey as quote, 'problem ' || floor(o_totalprice)::bigint as problem, o_orderstatus as domain from orders),
weighed as (select *, 3 * case severity when 'high' then 3 when 'medium' then 2 else 1 end + 2 * case confidence when 'high' then 3 when 'medium' then 2 else 1 end as weight from found),
ranked as (select *, row_number() over (partition by entity_id order by weight desc, date desc, finding_id) as rank from weighed)"""


def _findings(spark, d):
    o = _t(spark, d, "orders")
    category = F.when(F.col("o_orderpriority") == "1-URGENT", "likely_false").when(F.col("o_orderpriority") == "2-HIGH", "misleading").when(F.col("o_orderpriority") == "3-MEDIUM", "implausible").otherwise("unverifiable")
    severity = F.when(F.col("o_orderstatus") == "F", "high").when(F.col("o_orderstatus") == "O", "medium").otherwise("low")
    confidence = F.element_at(F.array(*map(F.lit, R.LEVELS)), (F.pmod("o_orderkey", F.lit(3)) + 1).cast("int"))
    return o.select(
        F.col("o_orderkey").cast("string").alias("finding_id"), F.col("o_custkey").alias("entity_id"), F.floor(F.col("o_orderkey") / 2).cast("long").alias("doc_id"), F.to_date("o_orderdate").alias("date"), category.alias("category"), severity.alias("severity"),
        confidence.alias("confidence"), F.concat_ws(" ", "o_orderpriority", "o_orderkey").alias("quote"), F.concat(F.lit("problem "), F.floor("o_totalprice").cast("long").cast("string")).alias("problem"), F.col("o_orderstatus").alias("domain"),
    )


@query(f"""with {_FINDINGS} select entity_id, md5(string_agg(rank || '. [' || upper(severity) || '] ' || category || {_NL} || '“' || quote || '”' || case when category = 'misleading' then {_NL} || 'vs. “' || problem || '”' else '' end || {_NL} || problem || {_NL} || 'source: ' || doc_id, {_NL} || {_NL} order by rank)) as h from ranked group by 1""")
def a9_flag_report(spark, d):
    ranked = R.rank_findings(_findings(spark, d)).withColumn("related_quote", F.when(F.col("category") == "misleading", F.col("problem")))
    return H.flag_report(ranked).select("entity_id", F.md5("report").alias("h"))


@query("""with r as (select l_suppkey as entity_id, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_extendedprice) as rank, l_orderkey as doc_id from lineitem),
j as (select entity_id, list({'rank': rank, 'doc_id': doc_id} order by rank) filter (rank <= 30) as education, list({'rank': rank, 'doc_id': doc_id} order by rank) filter (rank <= 100) as statements from r group by 1)
select entity_id, md5(cast(to_json({'entity_id': entity_id, 'education': education, 'statements': statements}) as varchar)) as h from j""")
def a11_export_analysis(spark, d):
    lines = _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("entity_id"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    ranked = D.rank_by(lines, F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_extendedprice"), top=100).select("entity_id", F.col("rank").cast("int").alias("rank"), F.col("l_orderkey").alias("doc_id"))
    out = H.export_analysis(ranked.select("entity_id").distinct(), education=ranked, statements=ranked)
    return out.select("entity_id", F.md5("json").alias("h"))


@query(r"""with u as (select url, cast(date '2020-01-01' + cast(page_id % 3000 as int) as date) as day from pages where regexp_matches(url, '^https?://')),
bare as (select regexp_replace(trim(url), '#.*$', '') as bare, day from u),
parts as (select day, regexp_extract(bare, '^([^?]*)', 1) as base, array_to_string(list_filter(string_split(regexp_extract(bare, '^[^?]*\?(.*)$', 1), '&'), lambda p: p <> '' and not regexp_matches(lower(p), '^(utm_[^=]*|fbclid|gclid|mc_[^=]*|ref)(=.*)?$')), '&') as q from bare)
select case when q = '' then base else base || '?' || q end as url, day as rss_date from parts""")
def a2_read_feed(spark, d):
    """The pages' addresses as items of a feed, every second one inside a ?url= parameter."""
    link = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://news.example/url?q=1&url="), F.url_encode("url"), F.lit("&ct=ga"))).otherwise(F.col("url"))
    day = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), F.pmod("page_id", F.lit(3000)).cast("int")), "EEE, dd MMM yyyy")
    items = _t(spark, d, "pages").where(F.col("url").rlike("^https?://")).select(link.alias("link"), F.concat(day, F.lit(" 10:00:00 GMT")).alias("pubDate"))
    path = f"{scratch.shared_dir(spark)}/feed-{uuid.uuid4().hex}"
    items.write.format("xml").option("rootTag", "channel").option("rowTag", "item").save(path)
    scratch.forget_at_exit(spark, path)
    return P.read_feed(spark, path)


@query("select 'p' || p_partkey as item_id, case p_size % 3 when 0 then 'economy' when 1 then 'identity' else 'energy' end as axis_id, cast(case when p_partkey % 2 = 0 then 1 else -1 end as int) as direction, cast(p_partkey as int) as item_no from part")
def a7_items(spark, d):
    """Parts as the items of a questionnaire, through the file that holds them."""
    axis = F.element_at(F.array(*map(F.lit, ("economy", "identity", "energy"))), F.pmod("p_size", F.lit(3)) + 1)
    rows = _t(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("item_id"), axis.alias("axis_id"), F.when(F.col("p_partkey") % 2 == 0, 1).otherwise(-1).alias("direction"), F.col("p_partkey").cast("int").alias("item_no"))
    return A.load_items(spark, _as_csv(spark, rows))


@query("select 'n' || s_suppkey as ax_i, 'n' || (s_suppkey + 1) as ax_j, cast(s_suppkey * 7 % 19 - 9 as double) / 10 as r from supplier")
def a7_correlations(spark, d):
    """Neighbouring suppliers as axes that go together or not, through the file that holds them."""
    n = F.col("s_suppkey")
    rows = _t(spark, d, "supplier").select(F.concat(F.lit("n"), n).alias("ax_i"), F.concat(F.lit("n"), n + 1).alias("ax_j"), ((F.pmod(n * 7, F.lit(19)) - 9).cast("double") / 10).alias("r"))
    return A.load_correlations(spark, _as_csv(spark, rows))


def _as_csv(spark, rows) -> str:
    path = f"{scratch.shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    rows.write.option("header", True).csv(path)
    scratch.forget_at_exit(spark, path)
    return path


@query(f"with {Q._ANSWERS} select respondent_id, axis_id, case when score is null then 'insufficient' else 'ok' end as status, k as items, round(6 - score, 2) as score from scored")
def a10_export_axes(spark, d):
    """What the exported profiles say of axes, read back from them."""
    answers = Q._answers(spark, d)
    out = H.export_profile(G.axis_scores(answers, Q._items(spark)), G.quality_flags(answers))
    axes = F.from_json("json", "axes array<struct<axis_id: long, status: string, items: long, score: double>>")["axes"]
    return out.select("respondent_id", F.explode(axes).alias("x")).select("respondent_id", "x.axis_id", "x.status", "x.items", F.round("x.score", 6).alias("score"))


@query("select o_orderkey, case when o_orderkey % 3 = 0 then '' else strftime(o_orderdate, '%Y-%m-%d') end as own, case when o_orderkey % 3 > 0 then strftime(o_orderdate, '%Y-%m-%d') when o_orderkey % 2 = 0 then '2001-01-01' else '' end as date from orders")
def b18_date_of(spark, d):
    own = F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return _t(spark, d, "orders").select("o_orderkey", own.alias("own"), X.date_of(own, F.when(F.col("o_orderkey") % 2 == 0, "2001-01-01")).alias("date"))


@query("select o_custkey as entity_id, round(avg(case o_orderkey % 4 when 0 then 1.0 when 1 then 0.5 when 2 then 0.0 end), 6) as promise_mean from orders group by 1")
def g18_status_mean(spark, d):
    """Statuses of promises as the values that their mean is of."""
    status = F.element_at(F.array(*map(F.lit, ("kept", "partial", "broken", "unverifiable"))), (F.pmod("o_orderkey", F.lit(4)) + 1).cast("int"))
    rows = _t(spark, d, "orders").select(F.col("o_custkey").alias("entity_id"), D.status_value(status).alias("value"))
    return rows.groupBy("entity_id").agg(F.round(G.promise_average(F.col("value")), 6).alias("promise_mean"))


@query(f"""with t as (select *, sum(case when role = 'user' then 1 else 0 end) over (partition by conv_id order by turn rows unbounded preceding) as n from conversations),
g as (select {Q._ENTITY} as entity_id, conv_id as doc_id, n as turn, string_agg(text, {_NL} order by turn) filter (text <> '') as text from (select conv_id, n, turn, trim(text, ' ') as text from t) group by 1, 2, 3)
select entity_id, doc_id, cast(turn as bigint) as turn, 'Ana ' || upper(entity_id[1]) || entity_id[2:] as speaker, md5(text) as h from g where turn > 0 and length(text) >= 150""")
def d9_speech_turns(spark, d):
    """d9_speeches, of texts without blanks at their ends."""
    turns = _t(spark, d, "conversations").withColumn("text", F.trim("text"))
    return Q.transcripts(spark, turns)


# ---- text
_V1 = Q._V1


@query(f"select doc_id, len(s) as n, md5(array_to_string(s, chr(2))) as h from (select doc_id, {_V1.format('text')} as s from documents)")
def b13_split_sentences_v1(spark, d):
    s = X.split_sentences_v1(F.col("text"))
    return _t(spark, d, "documents").select("doc_id", F.size(s).cast("long").alias("n"), F.md5(F.array_join(s, "\u0002")).alias("h"))


@query(rf"""with l as (select doc_id, list_filter(list_transform(string_split(text, {_NL}), lambda x: trim(regexp_replace(x, '^\s*[-•*]\s*', ''))), lambda x: x <> '') as s from documents)
select doc_id, len(b) as n, md5(array_to_string(b, chr(2))) as h from (select doc_id, case when len(s) = 1 then string_split(regexp_replace(s[1], '([.!?])\s+(\p{{Lu}})', '\1' || chr(1) || '\2', 'g'), chr(1)) else s end as b from l)""")
def b20_bullets(spark, d):
    b = X.bullets(F.col("text"))
    return _t(spark, d, "documents").select("doc_id", F.size(b).cast("long").alias("n"), F.md5(F.array_join(b, "\u0002")).alias("h"))


@query(f"select doc_id, md5(array_to_string({Q._SENT}, chr(2))) as h from documents")
def b12_sentences(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.md5(F.array_join(X.split_sentences(F.col("text")), "\u0002")).alias("h"))


@query(r"""with n as (select doc_id, trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g')) as q, source from documents)
select doc_id, left(sha1(left(q, 200) || source), 10) as finding_id, left(sha1(lower(source) || chr(10) || doc_id), 10) as result_key from n""")
def b11_more_ids(spark, d):
    return _t(spark, d, "documents").select("doc_id", X.finding_id(F.col("text"), F.col("source")).alias("finding_id"), X.result_key(F.col("source"), F.col("doc_id").cast("string")).alias("result_key"))


# ---- links
@query(r"""with a as (select page_id, regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1) as origin, unnest(regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1)) as href, unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) as anchor from pages)
select page_id, origin || replace(href, '&amp;', '&') as href, trim(replace(replace(replace(anchor, '&lt;', '<'), '&gt;', '>'), '&amp;', '&')) as anchor from a where href like '/%' and href not like '//%'""")
def c4_links(spark, d):
    """Links of menus too: their tags are read as plain blocks."""
    pages = _t(spark, d, "pages").withColumn("html", F.regexp_replace("html", r"<(/?)nav\b", "<$1div"))
    return C.page_links(C.html_blocks(pages), pages)


# ---- extraction
@query(f"select doc_id, old as education_only from (select doc_id, n_chars % 3 = 0 as has, year({_DAY}) < 2027 as old from documents) where not old or has")
def d3_age_gate(spark, d):
    docs = _docs(spark, d)
    return D.age_gate(docs.select("doc_id", "date"), 2027, docs.where("n_chars % 3 = 0")).select("doc_id", "education_only")


@query(f"select source as entity_id, doc_id, (doc_id % 7 = 0 or lang = 'en') as primary from documents")
def d19_primary_flag(spark, d):
    docs = _docs(spark, d)
    return D.primary_flag(docs.select("entity_id", "doc_id", (F.col("doc_id") % 7 == 0).alias("official")), docs.where("lang = 'en'")).select("entity_id", "doc_id", "primary")


@query(f"with {Q._PARAS}, {Q._NAMES}, {Q._OPINIONS} select entity_id, doc_id, pos, k, md5(quote) as h, tone from opinions")
def d15_opinion_rows(spark, d):
    return Q.d15_opinions(spark, d).select("entity_id", "doc_id", F.col("pos").cast("long").alias("pos"), F.col("k").cast("long").alias("k"), F.md5("quote").alias("h"), "tone")


@query(f"""with {Q._PARAS}, {Q._NAMES}, {Q._OPINIONS}, t as (select entity_id, doc_id, case when count(case tone when 'positive' then 1 end) > count(case tone when 'negative' then 1 end) then 'positive' when count(case tone when 'positive' then 1 end) < count(case tone when 'negative' then 1 end) then 'negative' else 'mixed' end as tone from opinions group by 1, 2)
select * from t""")
def d16_tones(spark, d):
    return D.article_tone(Q.d15_opinions(spark, d))


_QUOTED = f"""said as (select doc_id, pos, case when regexp_matches(text, '[„“"«”»]') then text else 'Se spune: „' || text || '” azi' end as text from paras),
around as (select *, {Q._TOKENS.format('lower(strip_accents(text))')} as own, lag({Q._TOKENS.format('lower(strip_accents(text))')}) over w as back, lead({Q._TOKENS.format('lower(strip_accents(text))')}) over w as ahead from said window w as (partition by doc_id order by pos)),
quoted as (select entity_id, doc_id, pos, {_SQUASH.format("regexp_extract(text, '^Se spune: „(.*)” azi$', 1, 's')")} as q, list_contains(own, entity_id) as same from around, names where text like 'Se spune: „%' and (list_contains(own, entity_id) or list_contains(back, entity_id) or list_contains(ahead, entity_id)) and length(text) - 16 between 40 and 5000),
keyed as (select *, row_number() over (partition by entity_id, doc_id, {Q._FP.format('q', 400)} order by pos) as rn from quoted where length(q) >= 40)"""


@query(f"with {Q._PARAS}, {Q._NAMES}, {_QUOTED} select entity_id, doc_id, pos, md5(q) as h, same as same_paragraph from keyed where rn = 1")
def d10_quoted_statements(spark, d):
    """Every paragraph without quotation marks stands in some; what others quote is left out."""
    paras = C.text_paragraphs(_t(spark, d, "documents"))
    said = F.when(F.col("text").rlike('[„“"«”»]'), F.col("text")).otherwise(F.concat(F.lit("Se spune: „"), "text", F.lit("” azi")))
    found = D.statements(paras.withColumn("text", said).withColumn("norm", X.fold(F.col("text"))), Q._variants(spark))
    return found.where(F.startswith("context", F.lit("Se spune: „"))).select("entity_id", "doc_id", F.col("pos").cast("long").alias("pos"), F.md5("text").alias("h"), "same_paragraph")


# ---- passages
@query("""with i as (select l_suppkey as entity_id, l_orderkey as doc_id, cast(l_shipdate as date) as date, l_linenumber % 2 = 0 as is_speech, l_linenumber * 10000000 + l_partkey as seq from lineitem where l_shipdate >= date '1996-01-01'),
s as (select entity_id, doc_id, row_number() over (partition by entity_id order by max(date) desc, doc_id) as r from i group by 1, 2),
n as (select i.*, row_number() over (partition by i.entity_id, i.doc_id order by is_speech desc, seq) as nth from i join s using (entity_id, doc_id) where r <= 20)
select entity_id, doc_id, is_speech, seq, nth from n where nth <= 3""")
def e1_latest_news(spark, d):
    lines = _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("entity_id"), F.col("l_orderkey").alias("doc_id"), F.to_date("l_shipdate").alias("date"), (F.col("l_linenumber") % 2 == 0).alias("is_speech"), (F.col("l_linenumber").cast("long") * 10000000 + F.col("l_partkey")).alias("seq"))
    return E.latest_news(lines, "1996-01-01").select("entity_id", "doc_id", "is_speech", "seq", F.col("nth").cast("long").alias("nth"))


_CUE_SQL = "list_filter([" + ", ".join(f"case when regexp_matches({{0}}, '{rx}') then '{label}' end" for label, rx in L.CUES) + r", case when regexp_matches({0}, '(^|[^\p{{L}}\p{{N}}_])(" + "|".join(D.folded(L.PROMISE)) + ")') then '" + L.PROMISE_CUE + "' end], lambda x: x is not null)"
_NORM_WORDS = r"trim(regexp_replace(lower(strip_accents({})), '[^a-z0-9]+', ' ', 'g'))"
#: Speeches and quotations from conversations, reported text from documents.
_PASSAGES = f"""quotes as (select conv_id % 10 as entity_id, conv_id as doc_id, turn as seq, text, case when turn % 3 = 0 then text || ' and this is what stood around it' else text end as ctx, date '2026-01-01' + cast(conv_id % 300 as int) as date from conversations where role = 'assistant'),
told as (select doc_id % 10 as entity_id, doc_id, 0 as seq, 'Thon a declarat: ' || text as text, {_DAY} as date from documents),
both_ as (select entity_id, 0 as o, 'speech' as kind, conv_id as doc_id, seq, text, null as context, date from (select conv_id % 10 as entity_id, conv_id, turn as seq, trim(text) as text, date '2026-01-01' + cast(conv_id % 300 as int) as date from conversations where role = 'user')
union all select entity_id, 1, 'quote', doc_id, seq, text, case when length(ctx) > length(text) + 30 then ctx end, date from quotes
union all select entity_id, 2, 'reported', doc_id, seq, text, null, date from told where not exists (select 1 from quotes q where q.entity_id = told.entity_id and q.doc_id = told.doc_id and contains({_NORM_WORDS.format('told.text')}, {_NORM_WORDS.format('q.ctx')}))),
kept as (select *, row_number() over (partition by entity_id, left({_NORM_WORDS.format('text')}, 300) order by o, doc_id, seq, text) as rn from both_ where length(text) >= 40 and date >= date '2026-02-01'),
passages as (select *, {_CUE_SQL.format('lower(strip_accents(text))')} as cues from kept where rn = 1)"""


def _passages(spark, d):
    turns = _t(spark, d, "conversations").select((F.col("conv_id") % 10).alias("entity_id"), F.col("conv_id").alias("doc_id"), F.col("turn").alias("seq"), "text", "role", F.date_add(F.lit("2026-01-01").cast("date"), F.pmod("conv_id", F.lit(300)).cast("int")).alias("date"), F.lit(10).alias("source_score"))
    around = F.when(F.col("seq") % 3 == 0, F.concat("text", F.lit(" and this is what stood around it"))).otherwise(F.col("text"))
    docs = _t(spark, d, "documents").select((F.col("doc_id") % 10).alias("entity_id"), "doc_id", F.lit(0).cast("long").alias("seq"), F.concat(F.lit("Thon a declarat: "), "text").alias("text"), _day().alias("date"), F.lit(10).alias("source_score"))
    return E.passages(turns.where("role = 'user'"), turns.where("role = 'assistant'").withColumn("context", around), docs, "2026-02-01", chunk=1_000_000)


@query(f"with {_PASSAGES} select entity_id, kind, doc_id, seq, md5(text) as h, md5(context) as c, cues, cast(floor((cast(case kind when 'speech' then 3 when 'quote' then 2 else 1 end as double) + cast(0.4 as double) * len(cues) + cast(0.1 as double)) * 10000 + cast(0.5 as double)) / 10000 as decimal(12,4)) as priority from passages")
def e3_passages(spark, d):
    return _passages(spark, d).select("entity_id", "kind", "doc_id", "seq", F.md5("text").alias("h"), F.md5("context").alias("c"), "cues", "priority")


@query(f"with {_PASSAGES} select doc_id from told where contains(lower(strip_accents(text)), 'thon') and not exists (select 1 from quotes q where q.entity_id = told.entity_id and q.doc_id = told.doc_id and contains({_NORM_WORDS.format('told.text')}, {_NORM_WORDS.format('q.ctx')}))")
def e4_reported(spark, d):
    docs = _t(spark, d, "documents").select((F.col("doc_id") % 10).alias("entity_id"), "doc_id", F.concat(F.lit("Thon a declarat: "), "text").alias("text"), F.lit("thon").alias("surname"))
    turns = _t(spark, d, "conversations").where("role = 'assistant'")
    around = F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit(" and this is what stood around it"))).otherwise(F.col("text"))
    return E.reported_only(docs, turns.select((F.col("conv_id") % 10).alias("entity_id"), F.col("conv_id").alias("doc_id"), "text", around.alias("context"))).select("doc_id")


_PLAIN = """translate({}, '„“”«»‘’"', '''''''''''''''''')"""


@query(f"""with {_PASSAGES} select entity_id, kind, doc_id, seq, md5('[P1] TYPE: ' || case kind when 'quote' then 'direct quote' when 'reported' then 'article passage' else kind end || case when len(cues) > 0 then {_NL} || 'CUES: ' || array_to_string(cues, '; ') else '' end || {_NL} || 'STATEMENT: ' || {_PLAIN.format('text')} || case when context is not null then {_NL} || 'SURROUNDING TEXT: ' || {_PLAIN.format('context')} else '' end) as h from passages""")
def e7_rendered(spark, d):
    return _passages(spark, d).select("entity_id", "kind", "doc_id", "seq", F.md5(E.render_passage(F.lit("P1"), F.col("kind"), F.col("cues"), F.col("text"), F.col("context"))).alias("h"))


_UNITS = rf"""units as (select source as entity_id, doc_id, 0 as seq, doc_id % 7 as source_score, case when doc_id % 3 = 0 then 'quote' when doc_id % 3 = 1 then 'speech' else 'reported' end as kind, case when doc_id % 3 = 2 then 'A declarat: ' || text else text end as text from documents),
pieces as (select *, left(text, 500) as piece, 0 as k from units where kind = 'quote' union all select * from (select *, trim(unnest({Q._SENT})) as piece, generate_subscripts({Q._SENT}, 1) - 1 as k from units where kind <> 'quote') where length(piece) between 60 and 500 and (kind <> 'reported' or regexp_matches(lower(strip_accents(piece)), '{L.ATTRIBUTION}')) and (kind <> 'speech' or len({_CUE_SQL.format('lower(strip_accents(piece))')}) > 0)),
first as (select * from (select *, row_number() over (partition by entity_id, {_NORM_WORDS.format('piece')} order by doc_id, seq, k) as rn from pieces) where rn = 1)
select entity_id, snippet_id, doc_id, md5(piece) as h from (select *, row_number() over (partition by entity_id order by source_score desc, doc_id, seq, k) as snippet_id from first) where snippet_id <= 160"""


@query(f"with {_UNITS}")
def e9_snippet_rows(spark, d):
    docs = _docs(spark, d)
    kind = F.element_at(F.array(F.lit("quote"), F.lit("speech"), F.lit("reported")), (F.pmod("doc_id", F.lit(3)) + 1).cast("int"))
    units = docs.select("entity_id", "doc_id", F.lit(0).alias("seq"), F.pmod("doc_id", F.lit(7)).alias("source_score"), kind.alias("kind"), F.when(F.col("doc_id") % 3 == 2, F.concat(F.lit("A declarat: "), "text")).otherwise(F.col("text")).alias("text"))
    return E.snippets(units).select("entity_id", "snippet_id", "doc_id", F.md5("text").alias("h"))


@query("select l_orderkey, l_linenumber, l_partkey, coalesce(l_shipdate > o_orderdate + interval 30 day, false) as swap from lineitem join orders on l_orderkey = o_orderkey")
def e12_order_pair(spark, d):
    both = _t(spark, d, "lineitem").join(_t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return both.select("l_orderkey", "l_linenumber", "l_partkey", E.order_pair(F.col("l_shipdate"), F.col("o_orderdate") + F.expr("interval 30 days")).alias("swap"))


@query("""with r as (select cast(conv_id as varchar) as request_id, list(turn order by turn) as m, conv_id % 3 = 0 and count(*) > 1 as bad from conversations group by conv_id),
h as (select request_id, m, bad, unnest(case when bad then [1, 2] else [0] end) as s from r)
select case when bad then request_id || '.' || s else request_id end as request_id, case when not bad then m when s = 1 then m[1:len(m) // 2] else m[len(m) // 2 + 1:] end as members from h""")
def e13_replanned(spark, d):
    return Q.e13_replan(spark, d)


@query("select source as entity_id, lang as kind, left(text, 400) as text, doc_id, lang as domain from documents")
def e14_export_passages(spark, d):
    docs = _docs(spark, d).withColumns({"kind": F.col("lang"), "title": F.col("entity_id"), "domain": F.col("lang"), "url": F.lit("")})
    return E.export_passages(docs).select("entity_id", "kind", "text", "source.doc_id", "source.domain")


# ---- answers
_ANSWER = r"""regexp_replace(text, '[\\"\x00-\x1f]', ' ', 'g')"""


@query(f"select cast(doc_id as varchar) as request_id, 'P1' as id, 'implausible' as category, 'medium' as severity, 'high' as confidence, md5({_ANSWER}) as h from documents")
def f1_answers(spark, d):
    return Q.f3_findings(spark, d).select("request_id", "id", "category", "severity", "confidence", F.md5("quote").alias("h"))


@query(r"""select doc_id, 'left' as pole, 'slight' as strength, 'low' as confidence, 1 as n, md5(regexp_replace(text, '[{}"\\]', '', 'g')) as h from documents""")
def f2_salvaged_axis(spark, d):
    clean = F.regexp_replace("text", r'[{}"\\]', "")
    content = F.concat(F.lit('{"pole": "left", "strength": "slight", "confidence": "low", "evidence": [{"source": "S1", "quote": "'), clean, F.lit('"}, {"source": "S2", "quo'))
    rows = _t(spark, d, "documents").select("doc_id", R.salvage_axis(content).alias("x"))
    return rows.select("doc_id", "x.pole", "x.strength", "x.confidence", F.size("x.evidence").alias("n"), F.md5(F.get("x.evidence", 0)["quote"]).alias("h"))


@query("""select o_orderkey, case o_orderkey % 4 when 0 then 'high' when 1 then 'medium' else 'low' end as severity, case when o_orderkey % 5 = 0 then 'high' else 'low' end as confidence, o_orderpriority as quote, o_orderstatus as related_quote, case when o_orderkey % 2 = 0 then 'Statements appear inconsistent.' else 'x y' end as problem from orders where o_orderkey % 4 < 3""")
def f5_pair_findings(spark, d):
    relation = F.element_at(F.array(*map(F.lit, ("direct_contradiction", "reversal", "tension", "unrelated"))), (F.pmod("o_orderkey", F.lit(4)) + 1).cast("int"))
    rows = _t(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("a_text"), F.col("o_orderstatus").alias("b_text"), relation.alias("relation"), F.when(F.col("o_orderkey") % 5 == 0, "high").when(F.col("o_orderkey") % 5 == 1, "sure").alias("confidence"), F.when(F.col("o_orderkey") % 2 == 0, " ").otherwise(" x  y").alias("key_conflict"), F.lit("e").alias("explanation"))
    return R.pair_findings(rows).select("o_orderkey", "severity", "confidence", "quote", "related_quote", "problem")


@query(f"""with {_FINDINGS}, r as (select *, row_number() over (partition by entity_id order by weight desc, date desc, finding_id) as place from weighed where confidence <> 'low') select entity_id, finding_id, weight, place as rank from r""")
def f6_rank_findings(spark, d):
    return R.rank_findings(_findings(spark, d), "medium").select("entity_id", "finding_id", "weight", F.col("rank").cast("long").alias("rank"))


@query(f"""with {_FINDINGS} select finding_id, case category when 'likely_false' then 'Probabil fals' when 'misleading' then 'Înșelător' when 'implausible' then 'Improbabil' else 'Neverificabil' end as category_label, case severity when 'low' then 'scăzută' when 'medium' then 'medie' else 'ridicată' end as severity_label, case confidence when 'low' then 'scăzută' when 'medium' then 'medie' else 'ridicată' end as confidence_label from found""")
def f8_labels(spark, d):
    return R.label_findings(_findings(spark, d)).select("finding_id", "category_label", "severity_label", "confidence_label")


@query("""select l_orderkey, l_linenumber, l_partkey, case l_linenumber % 4 when 0 then case when l_returnflag = 'R' then 1 else 2 end when 1 then case when l_returnflag = 'R' then 5 else 4 end when 2 then 3 end as score from lineitem""")
def f9_to_score(spark, d):
    pole = F.element_at(F.array(*map(F.lit, ("left", "right", "balanced", "none"))), (F.pmod("l_linenumber", F.lit(4)) + 1).cast("int"))
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", R.to_score(pole, F.when(F.col("l_returnflag") == "R", "clear").otherwise("slight")).alias("score"))


@query(r"""with a as (select conv_id as subject_id, turn as axis_id, case when turn % 2 = 0 and trim(regexp_replace(text, '\s+', ' ', 'g')) <> '' then 1 else 0 end as n, case when turn % 5 < 4 then turn % 5 + 1 end as s from conversations)
select subject_id, axis_id, n as n_evidence, case when s is not null and n = 0 then null else s end as score, case when s is not null and n = 0 then 'low' else 'high' end as confidence, s is not null and n = 0 as dropped_unsupported from a""")
def f10_validated(spark, d):
    turns = _t(spark, d, "conversations")
    one = lambda source, quote: F.struct(F.lit(source).alias("source"), quote.alias("quote"))
    evidence = F.array(one("S1", F.regexp_replace("text", " ", "  ")), one("S9", F.col("text")), one("S1", F.lit("this was never sent, of that we are sure")), one("S1", F.lit("")))
    rows = turns.select(F.col("conv_id").alias("subject_id"), F.col("turn").alias("axis_id"), F.when(F.col("turn") % 5 < 4, F.col("turn") % 5 + 1).alias("score"), F.lit("high").alias("confidence"), evidence.alias("evidence"), F.when(F.col("turn") % 2 == 0, F.array(F.lit("S1"))).otherwise(F.array(F.lit("S2"))).alias("refs"), F.col("text").alias("sent"))
    return R.validate_axis(rows).select("subject_id", "axis_id", F.size("evidence").alias("n_evidence"), "score", "confidence", "dropped_unsupported")


@query("select s_suppkey as subject_id, axis_no, case when axis_no = s_suppkey % 10 then s_nationkey % 5 + 1 end as score from supplier, (select unnest(range(10)) as axis_no)")
def f11_all_axes(spark, d):
    axes = A.axes(spark)
    some = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("subject_id"), (F.col("s_suppkey") % 10).alias("axis_no"), (F.col("s_nationkey") % 5 + 1).alias("score")).join(axes, "axis_no").select("subject_id", "axis_id", "score")
    return R.all_axes(_t(spark, d, "supplier").select(F.col("s_suppkey").alias("subject_id")), axes, some).join(axes, "axis_id").select("subject_id", F.col("axis_no").cast("long").alias("axis_no"), "score")


@query(f"""with p as (select l_suppkey as entity_id, l_orderkey as doc_id, l_linenumber * 10000000 + l_partkey as seq from lineitem), f as (select o_custkey % 100 as entity_id, o_orderkey as doc_id, o_orderkey as finding_id from orders),
a as (select entity_id, doc_id, count(*) as n_passages, string_agg('p' || seq, ',' order by seq) filter (r <= 3) as passages from (select *, row_number() over (partition by entity_id, doc_id order by seq) as r from p) group by 1, 2),
b as (select entity_id, doc_id, count(*) as n_findings, string_agg(finding_id::varchar, ',' order by finding_id) as findings from f group by 1, 2)
select entity_id, doc_id, coalesce(n_passages, 0) as n_passages, passages, coalesce(n_findings, 0) as n_findings, findings from a full join b using (entity_id, doc_id)""")
def f12_articles(spark, d):
    seq = F.col("l_linenumber").cast("long") * 10000000 + F.col("l_partkey")
    said = _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("entity_id"), F.col("l_orderkey").alias("doc_id"), seq.alias("seq"), F.concat(F.lit("p"), seq.cast("string")).alias("text"))
    none = F.lit("")
    flags = _t(spark, d, "orders").select((F.col("o_custkey") % 100).alias("entity_id"), F.col("o_orderkey").alias("doc_id"), F.col("o_orderkey").alias("finding_id"), none.alias("category"), none.alias("severity"), none.alias("confidence"), none.alias("problem"))
    out = H.group_articles(said, flags)
    return out.select("entity_id", "doc_id", "n_passages", F.array_join("passages", ",").alias("passages"), "n_findings", F.array_join(F.transform("findings", lambda x: x["finding_id"].cast("string")), ",").alias("findings"))


@query("with s as (select source, sum(n_chars + 1) over (partition by source order by doc_id rows unbounded preceding) as s from documents) select source as entity_id, count(case when s <= 20000 then 1 end) as n_kept, count(case when s > 20000 then 1 end) as n_cut from s group by 1")
def f13_fit_counts(spark, d):
    rows = _t(spark, d, "documents").select(F.col("source").alias("entity_id"), "doc_id", "n_chars")
    return R.fit_counts(rows, "entity_id", F.col("n_chars"), 20000, ["doc_id"])


_WALK = """walk as (select e, p, 0 as b, size as used, 1 as n from placed where p = 1 union all
select r.e, r.p, case when used + size > {budget} or n >= 8 then b + 1 else b end, case when used + size > {budget} or n >= 8 then size else used + size end, case when used + size > {budget} or n >= 8 then 1 else n + 1 end from walk w join placed r on r.e = w.e and r.p = w.p + 1)"""


@query(f"""with recursive placed as (select source as e, doc_id, {_DAY} as date, n_chars, n_chars + 2 as size, row_number() over (partition by source order by {_DAY} desc, doc_id) as p from documents), {_WALK.format(budget=5000)}
select e as entity_id, doc_id, date, n_chars as size, b as batch_no from placed join walk using (e, p)""")
def f14_article_batches(spark, d):
    return E.article_batches(_docs(spark, d).select("entity_id", "doc_id", "date", F.col("n_chars").alias("size")), 5000)


@query(f"""with {_FINDINGS} select entity_id, string_agg(rank || '/' || category || '/' || severity || '/' || quote || '/' || domain, ';' order by rank) as flags from ranked where rank <= 5 group by 1""")
def f17_top_flags(spark, d):
    out = R.top_flags(R.rank_findings(_findings(spark, d)))
    return out.select("entity_id", F.array_join(F.transform("top_flags", lambda x: F.concat_ws("/", x["rank"], x["category"], x["severity"], x["quote"], x["domain"])), ";").alias("flags"))


@query(f"""with {_FINDINGS}, l as (select *, '[F' || rank || '] ' || category || ' | severity ' || severity || ' | confidence ' || confidence || ' | ' || strftime(date, '%Y-%m-%d') || ' | ' || domain || ' | „' || quote || '” | ' || problem as line from ranked where rank <= 50),
s as (select *, sum(length(line) + 1) over (partition by entity_id order by rank rows unbounded preceding) as u from l),
b as (select entity_id, string_agg(line, {_NL} order by rank) filter (u <= 1500) as body, count(case when u <= 1500 then 1 end) as n_shown, count(case when u > 1500 then 1 end) as n_cut from s group by 1),
c as (select entity_id, string_agg(category || ' ' || n, ', ' order by n desc, category) as cats, sum(n) as total from (select entity_id, category, count(*) as n from found group by 1, 2) group by 1),
p as (select o_custkey as entity_id, count(*) as n, count(distinct o_orderkey // 2) as docs from orders group by 1)
select entity_id, md5('PASSAGES: ' || n || ' of ' || docs || ' articles' || {_NL} || 'FLAGS: ' || total::bigint || '; ' || cats || {_NL} || {_NL} || body) as h, n_shown, n_cut from p join b using (entity_id) join c using (entity_id)""")
def f18_history(spark, d):
    found = _findings(spark, d)
    return H.history_request(R.rank_findings(found), found.select("entity_id", "doc_id"), 1500).select("entity_id", F.md5("user").alias("h"), "n_shown", "n_cut")


@query(r"""with a as (select conv_id, turn, text, case when (conv_id + turn) % 7 = 3 then 'Fara_informatii' when (conv_id + turn) % 7 = 4 then '  ' else text end as s from conversations),
m as (select *, trim(s) <> '' and not contains(upper(s), 'FARA_INFORMAT') as says, row_number() over (partition by conv_id order by turn) as rn from a)
select conv_id as request_id, case when f then md5(last) end as h, coalesce(f, false) as verified from (select conv_id, bool_or(says and rn = 1) as f, arg_max(s, turn) filter (says) as last from m group by 1)""")
def f20_summaries(spark, d):
    which = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(7))
    rows = _t(spark, d, "conversations").select(F.col("conv_id").alias("request_id"), (F.col("turn") + 1).alias("attempt"), F.when(which == 3, "Fara_informatii").when(which == 4, "  ").otherwise(F.col("text")).alias("summary"), F.col("text").alias("material"))
    return R.summary_status(rows).select("request_id", F.md5("summary").alias("h"), F.coalesce("verified", F.lit(False)).alias("verified"))


@query(f"""with {Q._PARAS}, t as (select *, contains(norm, 'thon') as named, sum(length(text) + 2) over (partition by doc_id) - 2 as total, bool_or(contains(norm, 'thon')) over (partition by doc_id) as anyone from paras),
c as (select *, total <= 3000 or not anyone or named as chosen from t), u as (select *, sum(case when chosen then length(text) + 2 else 0 end) over (partition by doc_id order by pos rows unbounded preceding) as upto from c),
g as (select *, chosen and (total <= 3000 or upto <= 3000) as fits from u)
select doc_id, md5(coalesce(string_agg(text, {_NL} || {_NL} order by pos) filter (fits), left(string_agg(text, {_NL} || {_NL} order by pos), 3000))) as h from g group by 1""")
def f22_material(spark, d):
    return H.doc_material(C.text_paragraphs(_t(spark, d, "documents")), F.lit("thon"), 3000).select("doc_id", F.md5("material").alias("h"))


@query(f"""with r as (select source as entity_id, row_number() over (partition by source order by doc_id) as rank, '[S' || row_number() over (partition by source order by doc_id) || '] ' || lang || ' | ' || strftime({_DAY}, '%Y-%m-%d') || ' | ' || source || {_NL} || text as line from documents),
s as (select *, sum(length(line) + 2) over (partition by entity_id order by rank rows unbounded preceding) - 2 as u from r where rank <= 14)
select entity_id, md5(string_agg(line, {_NL} || {_NL} order by rank)) as h from s where u <= 9000 group by 1""")
def f23_evidence_material(spark, d):
    rows = D.rank_by(_docs(spark, d), F.col("doc_id"), top=14).select("entity_id", "rank", F.col("lang").alias("domain"), "date", F.col("entity_id").alias("title"), F.col("text").alias("excerpt"))
    return H.evidence_material(rows).select("entity_id", F.md5("material").alias("h"))


@query(f"""select entity_id, doc_id, rank from (select source as entity_id, doc_id, row_number() over (partition by source order by {_DAY} desc, doc_id) as rank from documents where trim(text) <> '' and {_DAY} >= date '2026-03-01' and (doc_id % 2 = 0 or doc_id % 3 = 0)) where rank <= 40""")
def f24_pick_sources(spark, d):
    docs = _docs(spark, d).withColumn("evidence", F.when(F.col("doc_id") % 3 == 0, F.array("lang")).otherwise(F.expr("cast(array() as array<string>)")))
    return H.pick_sources(docs, docs.where("doc_id % 2 = 0"), "2027-03-20").select("entity_id", "doc_id", F.col("rank").cast("long").alias("rank"))


@query(f"""with b as (select conv_id as entity_id, turn // 4 as batch_no, 'P' || (turn % 4 + 1) as local_id, turn as ref, text as body from conversations),
r as (select entity_id, batch_no, string_agg(body, {_NL} || {_NL} order by local_id, ref, body) as u, string_agg(local_id || '=' || ref, ',' order by local_id, ref, body) as members from b group by 1, 2)
select left(sha256('flag' || {_NL} || entity_id || {_NL} || batch_no || {_NL} || u), 16) as request_id, entity_id, batch_no, md5(u) as h, members from r""")
def f25_requests(spark, d):
    rows = _t(spark, d, "conversations").select(F.col("conv_id").alias("entity_id"), F.floor(F.col("turn") / 4).cast("long").alias("batch_no"), F.concat(F.lit("P"), (F.col("turn") % 4 + 1).cast("string")).alias("local_id"), F.col("turn").alias("ref"), F.col("text").alias("body"))
    out = H.build_requests(rows, "flag", "system")
    return out.select("request_id", "entity_id", "batch_no", F.md5("user").alias("h"), F.array_join(F.transform("members", lambda m: F.concat_ws("=", m["local_id"], m["ref"])), ",").alias("members"))


@query(rf"""with b as (select conv_id, turn, trim(text) as t, turn % 2 = 1 as cut from conversations), l as (select *, string_split(t, {_NL}) as s from b)
select conv_id, turn, md5(nullif(case when cut and not regexp_matches(s[-1], '[.!?)"”]\s*$') then trim(array_to_string(s[1:len(s) - 1], {_NL})) else t end, '')) as h from l""")
def f26_trimmed(spark, d):
    content = F.concat(F.lit("<think>a\nb</think>"), "text")
    return _t(spark, d, "conversations").select("conv_id", "turn", F.md5(R.trim_truncated(content, F.when(F.col("turn") % 2 == 1, "length").otherwise("stop"))).alias("h"))


# ---- positions and questionnaire
@query("select p_partkey, cast((p_size % 5) * 25 as double) as position, cast(p_size % 5 + 1 as double) as score, case when (p_size % 5) * 25 < 45 then 'left' when (p_size % 5) * 25 > 55 then 'right' end as pole from part")
def g1_positions(spark, d):
    position = G.score_to_position(F.col("p_size") % 5 + 1)
    return _t(spark, d, "part").select("p_partkey", position.cast("double").alias("position"), G.position_to_score(position).cast("double").alias("score"), G.pole_of(position, F.lit("left"), F.lit("right")).alias("pole"))


@query("select s_suppkey as subject_id, case when s_suppkey % 5 > 0 then round(((100 - s_nationkey * 4) + s_suppkey % 101) / 2.0) end as leaning from supplier")
def g2_leaning(spark, d):
    s = _t(spark, d, "supplier")
    side = lambda axis, value: s.select(F.col("s_suppkey").alias("subject_id"), F.lit(axis).alias("axis_id"), value.cast("double").alias("value"))
    return G.leaning(side("identity", F.col("s_nationkey") * 4).unionByName(side("economy", F.col("s_suppkey") % 101).where("subject_id % 5 > 0")))


@query(f"with {Q._ANSWERS} select respondent_id, axis_id, row_number() over (partition by respondent_id order by case when score is null then 0 else k end, axis_id) as rank from scored")
def g14_focus_order(spark, d):
    scores = G.axis_scores(Q._answers(spark, d), Q._items(spark))
    order = G.focus_order(scores.select("respondent_id", "axis_id", F.col("axis_id").alias("axis_no"), F.lit(1.0).alias("weight"), "margin"))
    return order.select("respondent_id", "axis_id", F.col("rank").cast("long").alias("rank"))


@query(f"""with {Q._ANSWERS}, f as (select respondent_id, axis_id, row_number() over (partition by respondent_id order by case when score is null then 0 else k end, axis_id) as rank from scored),
pool as (select respondent_id, f.axis_id, rank, i as item_id, i % 2 as odd, row_number() over (partition by respondent_id, f.axis_id, i % 2 order by i) as r from f join (select unnest(range(50)) as i) on i // 5 = f.axis_id where not exists (select 1 from answers a where a.respondent_id = f.respondent_id and a.item_id = i))
select respondent_id, item_id, nth from (select *, row_number() over (partition by respondent_id order by rank, 2 * r - case when odd = 0 then 1 else 0 end) as nth from pool where r <= 3) where nth <= 5""")
def g15_next(spark, d):
    return Q.g15_next_items(spark, d).select("respondent_id", "item_id", F.col("nth").cast("long").alias("nth"))


@query("""with w as (select l_suppkey as entity_id, quantile_disc(l_discount / l_quantity, 0.15) as worst, avg(case when l_tax * 100 % 4 = 0 then 1.0 else 0.5 end) as pm from lineitem group by 1), s as (select entity_id, case when entity_id % 3 = 0 then entity_id % 10 / 10.0 else pm * worst end as t from w)
select entity_id, round(t, 6) as truth_score, case when entity_id % 3 > 0 then 'red' when greatest(1, entity_id % 10) >= 7 then 'green' when greatest(1, entity_id % 10) >= 4.5 then 'amber' else 'red' end as band from s""")
def g20_truth_score(spark, d):
    lines = _t(spark, d, "lineitem")
    chunks = lines.select(F.col("l_suppkey").alias("entity_id"), F.col("l_discount").alias("u"), F.col("l_quantity").alias("s"))
    kept = lines.select(F.col("l_suppkey").alias("entity_id"), F.when((F.col("l_tax") * 100) % 4 == 0, 1.0).otherwise(0.5).alias("value"))
    given = lines.where("l_suppkey % 3 = 0").select(F.col("l_suppkey").alias("entity_id"), (F.col("l_suppkey") % 10 / 10.0).cast("double").alias("given")).distinct()
    return G.final_scores(chunks, kept, given).select("entity_id", F.round("truth_score", 6).alias("truth_score"), "band")


# ---- feeds and roll-ups
_ITEMS = f"""said as (select p.doc_id, d.source as entity_id, pos, p.text, pos % 2 = 0 as promise from paras p join documents d using (doc_id)),
grouped as (select entity_id, doc_id, list(text order by pos) filter (promise) as promises, list(text order by pos) filter (not promise) as others, arg_min(text, pos) as first from said group by 1, 2),
items as (select source as entity_id, doc_id, case when doc_id % 5 = 0 or doc_id % 7 = 0 then 'discurs' else 'articol' end as type, {_SQUASH.format("case when doc_id % 5 = 0 then lang else first end")} as lead, coalesce(promises, []) as promises, coalesce(others, []) as others from documents left join grouped using (doc_id) where doc_id % 5 = 0 or first is not null)"""


def _profile_items(spark, d):
    docs = _docs(spark, d)
    paras = C.text_paragraphs(_t(spark, d, "documents")).join(docs.select("entity_id", "doc_id"), "doc_id")
    said = paras.select("entity_id", "doc_id", F.col("pos").alias("seq"), "text", (F.col("pos") % 2 == 0).alias("is_promise"))
    spoke = docs.where("doc_id % 5 = 0").select("entity_id", "doc_id", F.lit(0).alias("turn"), F.col("lang").alias("text"))
    return H.profile_items(docs.select("entity_id", "doc_id", (F.col("doc_id") % 7 == 0).alias("official")), said, spoke)


@query(f"with {Q._PARAS}, {_ITEMS} select entity_id, doc_id, type, md5({_cut('lead', 420)}) as lead, md5(array_to_string(promises, chr(2))) as promises, md5(array_to_string(others, chr(2))) as others from items")
def h1_profile_items(spark, d):
    return _profile_items(spark, d).select("entity_id", "doc_id", "type", F.md5("lead").alias("lead"), F.md5(F.array_join("promises", "\u0002")).alias("promises"), F.md5(F.array_join("others", "\u0002")).alias("others"))


@query("select source as entity_id, doc_id from documents where doc_id % 7 <> 0 and n_chars % 3 > 0")
def h2_press_feed(spark, d):
    return H.press_feed(_docs(spark, d).select("entity_id", "doc_id", (F.col("doc_id") % 7 == 0).alias("official"), (F.col("n_chars") % 3).alias("n_evidence"))).select("entity_id", "doc_id")


@query(f"with {Q._PARAS}, {_ITEMS} select entity_id, n_sources, coalesce(n_promises, 0) as n_promises, coalesce(n_press, 0) as n_press from (select source as entity_id, count(*) as n_sources, count(case when doc_id % 7 <> 0 and n_chars % 3 > 0 then 1 end) as n_press from documents group by 1) left join (select entity_id, cast(sum(len(promises)) as bigint) as n_promises from items group by 1) using (entity_id)")
def h3_profile_stats(spark, d):
    return H.profile_stats(_profile_items(spark, d), h2_press_feed(spark, d), _docs(spark, d))


@query("select source as entity_id, count(*) as n_sources, count(case lang when 'en' then 1 end) as n_speeches, count(case lang when 'de' then 1 end) as n_statements, count(case when n_chars > 1000 then 1 end) as n_education, count(case when doc_id % 3 = 0 then 1 end) as n_funding from documents group by 1")
def h6_entity_rollup(spark, d):
    docs = _docs(spark, d)
    return H.entity_rollup(docs.select("entity_id").distinct(), docs, docs.where("lang = 'en'"), docs.where("lang = 'de'"), docs.where("n_chars > 1000"), docs.where("doc_id % 3 = 0"))
