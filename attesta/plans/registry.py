"""All registered queries and the SQL they are held against. Each query reads whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attesta.functions import text as X
from attesta.functions import urls as U
from attesta.operators import corpus as C
from attesta.operators import extract as D
from attesta.operators import passages as E
from attesta.operators import profile as H
from attesta.operators import quiz as G
from attesta.operators import responses as R
from attesta.sources import pages as P
from attesta.sources import store as S
from attesta.streaming import ingest as I

#: Names that the invented texts hold, and words that stand in for the lexicons.
NAMES = ["thon", "anea", "erin", "eron"]
WORDS = ["thing", "ander", "ought"]
GOOD, BAD = ["tion", "able"], ["idiot", "trash", "scum"]


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _variants(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, n) for n in NAMES], "entity_id string, variant string")


_Q: dict = {}
_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


_WORD = r"(^|[^\p{{L}}\p{{N}}_]){}([^\p{{L}}\p{{N}}_]|$)"
_NORM = "lower(strip_accents(text))"
_SENT = r"string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
_FP = r"left(trim(regexp_replace(lower(strip_accents({})), '[^\p{{L}}\p{{N}}_]+', ' ', 'g')), {})"
_PARAS = f"""raw as (select doc_id, unnest(string_split(text, chr(10))) as text, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents),
paras as (select doc_id, pos, text, norm from (select *, row_number() over (partition by doc_id, norm order by pos) rn from (select doc_id, pos, text, {_NORM} norm from raw where length(text) >= 20)) where rn = 1)"""
_NAMES = "names as (select unnest(['thon', 'anea', 'erin', 'eron']) as entity_id)"
_TOKENS = r"regexp_extract_all({}, '[\p{{L}}\p{{N}}_]+')"


# ---- sources and sinks
@query(r"""select min(page_id) as page_id, final_url from (select page_id, case when q = '' then base else base || '?' || q end as final_url from (
select page_id, html, regexp_extract(bare, '^([^?]*)', 1) as base, array_to_string(list_filter(string_split(regexp_extract(bare, '^[^?]*\?(.*)$', 1), '&'), lambda p: p <> '' and not regexp_matches(lower(p), '^(utm_[^=]*|fbclid|gclid|mc_[^=]*|ref)(=.*)?$')), '&') as q
from (select *, regexp_replace(trim(url), '#.*$', '') as bare from pages)) where contains(lower(left(html, 2000)), '<html')) group by final_url""")
def a1_read_pages(spark, d):
    return P.read_pages(spark, f"{d}/pages.parquet").select("page_id", "final_url")


@query("""select event_type as kind, user_id, event_id, value from (select *, row_number() over (partition by event_type, user_id order by ts desc, event_id desc) rn from events) where rn = 1""")
def a4_latest_results(spark, d):
    rows = _t(spark, d, "events").select(F.col("event_type").alias("kind"), "user_id", "event_id", "value", "ts")
    return S.latest(rows, ["kind", "user_id"], [F.col("ts").desc(), F.col("event_id").desc()]).drop("ts")


@query("select event_type as kind, count(*) as n from events group by event_type")
def a5_inventory(spark, d):
    return S.inventory(_t(spark, d, "events").select(F.col("event_type").alias("kind")))


@query("select date_trunc('hour', ts) as hour, event_type, count(*) as n from events group by 1, 2")
def s1_hourly_counts(spark, d):
    return I.hourly_counts(_t(spark, d, "events")).withColumn("hour", F.col("hour").cast("timestamp_ntz"))


# ---- text and URLs
@query(f"select doc_id, md5({_NORM}) as folded from documents")
def b1_fold(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.md5(X.fold(F.col("text"))).alias("folded"))


@query(r"select doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) as squashed from documents")
def b2_squash(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.md5(X.squash(F.col("text"))).alias("squashed"))


@query(f"select doc_id, regexp_matches({_NORM}, '{_WORD.format('thing')}') as has from documents")
def b3_has_word(spark, d):
    return _t(spark, d, "documents").select("doc_id", X.has_word(X.fold(F.col("text")), "thing").alias("has"))


@query(rf"select doc_id, regexp_matches({_NORM}, '(^|[^\p{{L}}\p{{N}}_])(thing|ander)') as has from documents")
def b4_has_prefix(spark, d):
    return _t(spark, d, "documents").select("doc_id", X.has_prefix(X.fold(F.col("text")), "thing", "ander").alias("has"))


@query(r"""select page_id, case when q = '' then base else base || '?' || q end as url from (
select page_id, regexp_extract(bare, '^([^?]*)', 1) as base, array_to_string(list_filter(string_split(regexp_extract(bare, '^[^?]*\?(.*)$', 1), '&'), lambda p: p <> '' and not regexp_matches(lower(p), '^(utm_[^=]*|fbclid|gclid|mc_[^=]*|ref)(=.*)?$')), '&') as q
from (select page_id, regexp_replace(trim(url), '#.*$', '') as bare from pages))""")
def b5_normalize_url(spark, d):
    return _t(spark, d, "pages").select("page_id", U.normalize_url(F.col("url")).alias("url"))


@query(r"select page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)), '^www\.', '') as host from pages")
def b6_hostname(spark, d):
    return _t(spark, d, "pages").select("page_id", U.hostname(F.col("url")).alias("host"))


@query(r"select page_id, (host = 'example.org' or ends_with(host, '.example.org')) as official from (select page_id, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) as host from pages)")
def b7_is_official(spark, d):
    return _t(spark, d, "pages").select("page_id", U.is_official(U.hostname(F.col("url")), ["example.org"]).alias("official"))


@query(f"select doc_id, {_FP.format('text', 300)} as fp from documents")
def b8_fingerprint(spark, d):
    return _t(spark, d, "documents").select("doc_id", X.fingerprint(F.col("text")).alias("fp"))


@query(f"select doc_id, md5(array_to_string(regexp_extract_all({_NORM}, '[a-z0-9]+'), ' ')) as words from documents")
def b9_norm_words(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.md5(X.norm_words(F.col("text"))).alias("words"))


@query("select c_custkey, regexp_replace(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug from customer")
def b10_slug(spark, d):
    return _t(spark, d, "customer").select("c_custkey", X.slug(F.col("c_name")).alias("slug"))


@query("select page_id, left(sha256(url), 12) as doc_id, left(sha256(url || html), 12) as statement_id from pages")
def b11_ids(spark, d):
    return _t(spark, d, "pages").select("page_id", X.document_id(F.col("url")).alias("doc_id"), X.statement_id(F.col("url"), F.col("html")).alias("statement_id"))


@query(f"select doc_id, len({_SENT}) as n, md5(array_to_string({_SENT}, chr(10))) as all_of_it from documents")
def b12_split_sentences(spark, d):
    s = X.split_sentences(F.col("text"))
    return _t(spark, d, "documents").select("doc_id", F.size(s).cast("long").alias("n"), F.md5(F.array_join(s, "\n")).alias("all_of_it"))


@query()
def b14_split_chunks(spark, d):
    rows = _t(spark, d, "documents").select("doc_id", F.posexplode(X.split_chunks(F.col("text"), 500)).alias("k", "piece"))
    return rows.select("doc_id", "k", F.length("piece").alias("n"))


@query("""select doc_id, md5(translate(text, '„“”«»‘’"', '''''''''''''''''')) as plain from documents""")
def b15_plain_quotes(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.md5(X.plain_quotes(F.col("text"))).alias("plain"))


@query(r"select doc_id, case when length(s) > 80 then regexp_replace(left(s, 80), ' [^ ]*$', '') || '…' else s end as lead from (select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as s from documents)")
def b16_cut_words(spark, d):
    return _t(spark, d, "documents").select("doc_id", X.cut_words(F.col("text"), 80).alias("lead"))


@query("select doc_id, cast(floor(length(text) / 2.6) as bigint) + 1 as tokens, cast(floor(greatest(n_chars, 0) * 2.6) as bigint) as chars from documents")
def b17_tokens(spark, d):
    return _t(spark, d, "documents").select("doc_id", X.est_tokens(F.col("text")).alias("tokens"), X.chars_for_tokens(F.col("n_chars")).alias("chars"))


@query("select o_orderkey, try_cast(left(strftime(o_orderdate, '%Y-%m-%d'), 4) as int) as year from orders")
def b18_year_of(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", X.year_of(F.date_format(F.col("o_orderdate"), "yyyy-MM-dd")).alias("year"))


@query("""select distinct p_partkey, v as variant from (select p_partkey, unnest([array_to_string(w, ' '), case when len(w) > 1 then w[-1] || ' ' || array_to_string(w[1:len(w)-1], ' ') end, case when len(w) > 1 then w[1] || ' ' || w[-1] end, case when len(w) > 1 then w[-1] || ' ' || w[1] end]) as v from (select p_partkey, string_split(trim(p_name), ' ') as w from part)) where v is not null""")
def b19_name_variants(spark, d):
    return _t(spark, d, "part").select("p_partkey", F.explode(X.name_variants(F.col("p_name"))).alias("variant"))


# ---- pages to corpus
@query()
def c1_html_blocks(spark, d):
    return C.html_blocks(_t(spark, d, "pages"))


@query()
def c2_html_blocks_strict(spark, d):
    return C.html_blocks(_t(spark, d, "pages"), "strict").where("href is null").select("page_id", "pos", "text")


@query(f"with {_PARAS} select doc_id, pos, md5(text) as h from paras")
def c3_paragraphs(spark, d):
    return C.text_paragraphs(_t(spark, d, "documents")).select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5("text").alias("h"))


@query(rf"""with found as (select page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) as href, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) as anchor from pages),
bare as (select page_id, anchor, regexp_replace(regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1) || href, '#.*$', '') as bare from found where starts_with(href, '/')),
parts as (select page_id, anchor, regexp_extract(bare, '^([^?]*)', 1) as base, array_to_string(list_filter(string_split(regexp_extract(bare, '^[^?]*\?(.*)$', 1), '&'), lambda p: p <> '' and not regexp_matches(lower(p), '{U.TRACKING}')), '&') as q from bare)
select page_id, case when q = '' then base else base || '?' || q end as href, trim(regexp_replace(anchor, '\s+', ' ', 'g')) as anchor from parts""")
def c4_page_links(spark, d):
    """The pages' links all stand in hidden tags, so those tags are taken as shown ones here."""
    pages = _t(spark, d, "pages").withColumn("html", F.regexp_replace("html", "<(/?)nav>", "<$1div>"))
    return C.page_links(C.html_blocks(pages), pages)


@query(r"""select page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is'), '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) as title from pages""")
def c5_page_title(spark, d):
    return _t(spark, d, "pages").select("page_id", C.page_title(F.col("html")).alias("title"))


#: Pages that tell a date and an author in each place in turn, some of them wrong: made from the page's number, in Spark and in SQL alike.
_TOLD = """select page_id, case when page_id % 6 >= 4 then 'http://h.example/2021/' || cast(1 + page_id % 12 as string) || '/' || cast(1 + page_id % 28 as string) || '/a' else url end as url,
case page_id % 6 when 0 then '<meta property="article:published_time" content="' || day || 'T08:00:00"><meta name="author" content="Ana &amp; Ion ' || cast(page_id as string) || '">'
when 1 then '<meta content="' || day || '" name="pubdate"><meta content="de Maria  Pop, Ziarul" name="author">'
when 2 then '<script>{{"datePublished": "' || day || '", "author": [{{"@type": "Person", "name": "Rad' || chr(92) || 'u0103 Vlad"}}]}}</script>'
when 3 then '<time datetime="' || day || '"><a class="author-link"> Dan Ilie </a>'
when 4 then '<meta name="date" content="2019-13-40"><meta name="author" content="https://x.example/ana">' else '' end || html as html
from (select *, cast(1980 + page_id % 60 as string) || '-0' || cast(1 + page_id % 9 as string) || '-1' || cast(page_id % 10 as string) as day from {pages})"""


def _facts_sql() -> str:
    text = lambda rx: rx.replace("'", "''")
    valid = "case when year(try_cast({0} as date)) between 1990 and 2027 then try_cast({0} as date) end"
    dates = [valid.format(f"regexp_extract(head, '{text(rx)}', 1)") for rx in C.DATE_PLACES]
    part = r"lpad(regexp_extract(url, '/(20\d{{2}}|19\d{{2}})[/\-](\d{{1,2}})[/\-](\d{{1,2}})(?:[/\-]|$)', {}), {}, '0')"
    dates.append(valid.format("(" + " || '-' || ".join(part.format(k, n) for k, n in ((1, 4), (2, 2), (3, 2))) + ")"))
    names = []
    for rx in C.AUTHOR_PLACES:
        name = f"replace(regexp_extract(head, '{text(rx)}', 1), chr(92) || 'u0103', 'ă')"
        for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
            name = f"replace({name}, '{entity}', '{char}')"
        names.append(f"trim(regexp_replace({name}, '\\s+', ' ', 'g'))")
    author = f"list_filter([{', '.join(names)}], lambda c: c <> '' and not regexp_matches(c, '(?i)^https?://') and length(c) <= 120)[1]"
    return rf"""with told as ({_TOLD.format(pages="pages")}), named as (select page_id, coalesce({", ".join(dates)}) as date, coalesce({author}, '{C.UNKNOWN_AUTHOR}') as author from (select page_id, url, left(html, 200000) as head from told)),
short as (select *, trim(regexp_replace(regexp_replace(author, '(?i)^\s*(?:de|by|autor)\s*:?\s+', ''), '\s*[|,;/–—].*$', '')) as s from named)
select page_id, date, author, case when length(s) between 3 and 80 and len(regexp_split_to_array(s, '\s+')) <= 6 and not regexp_matches(s, '(?i)https?:|www\.|@|\b(19|20)\d{{2}}\b') and s <> '{C.UNKNOWN_AUTHOR}' then s end as strict_author from short"""


@query(_facts_sql())
def c6_page_facts(spark, d):
    pages = spark.sql(_TOLD, pages=_t(spark, d, "pages"))
    return pages.select("page_id", C.page_date(F.col("html"), F.col("url")).alias("date"), C.page_author(F.col("html")).alias("author"), C.page_author_v1(F.col("html")).alias("strict_author"))


@query(r"""select page_id, least(100, 20 + case when official then 45 else 0 end + case when regexp_matches(w, 'steno|discurs|declar|interviu|comunicat|conferint|plen|sedint') then 15 else 0 end + case when regexp_matches(w, 'educat|stud|univers|facultat|liceu|finant|buget|fondur|pnrr|grant|investit|biograf') then 8 else 0 end + case when n > 2500 then 5 else 0 end + case when n > 7000 then 5 else 0 end) as score,
case when regexp_matches(w, 'steno|sedint|plen') then 'stenogramă' when regexp_matches(w, 'discurs|alocu|adresare|mesaj') then 'discurs' when regexp_matches(w, 'interviu|invitat|emisiun') then 'interviu' when regexp_matches(w, 'comunicat|press') then 'comunicat' when regexp_matches(w, 'declar|intervent|conferint') then 'declarație' when regexp_matches(w, 'educat|stud|facultat|univers|liceu|scoal|biograf') then 'educație' when regexp_matches(w, 'finant|buget|fondur|pnrr|grant|investit|tax|impozit') then 'finanțare' else 'articol' end as kind
from (select page_id, length(html) as n, false as official, lower(strip_accents(url)) as w from pages)""")
def c9_source_score(spark, d):
    pages = _t(spark, d, "pages")
    none, host = F.lit(None).cast("string"), U.hostname(F.col("url"))
    return pages.select("page_id", C.source_score(none, F.col("url"), host, F.length("html")).alias("score"), C.article_kind(none, F.col("url")).alias("kind"))


@query(f"with {_PARAS} select doc_id, md5(string_agg(text, chr(10) || chr(10) order by pos)) as h, count(*) as n from paras group by doc_id")
def c11_document_text(spark, d):
    paras = C.text_paragraphs(_t(spark, d, "documents"))
    counts = paras.groupBy("doc_id").agg(F.count("*").alias("n"))
    return C.document_text(paras).join(counts, "doc_id").select("doc_id", F.md5("text").alias("h"), "n")


@query(r"""with u as (select url, min(page_id) as page_id from pages group by url), n as (select url, row_number() over (partition by regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)), '^www\.', '') order by page_id) as n from u)
select url, cast(greatest(n - 2, 0) as integer) as round from n where n <= 5""")
def c12_crawl_frontier(spark, d):
    """Links run from page to page of one host in order of their numbers; the two smallest pages of each host are the seeds."""
    from attesta.operators.corpus import keep_first

    pages = _t(spark, d, "pages").select("page_id", "url").withColumn("host", U.hostname(F.col("url")))
    pages = keep_first(pages, ["url"], ["page_id"])
    w = Window.partitionBy("host").orderBy("page_id")
    chain = pages.withColumn("href", F.lead("url").over(w)).withColumn("anchor", F.lit("profil")).where("href is not null").select("url", "href", "anchor")
    seeds = pages.withColumn("n", F.row_number().over(w)).where("n <= 2").select("url")
    return C.crawl_frontier(seeds, chain, pages, pages.select("url"), NAMES, depth=3)


@query(r"""select host as entity_id, url, rank from (select *, row_number() over (partition by host order by pri, page_id, url) as rank from (select page_id, url, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)), '^www\.', '') as host, case when regexp_matches(lower(url), 'steno|discurs|declar|interviu|comunicat|alocu|intervent|sedint|plen|mesaj|conferint|educat|stud|facultat|univers|finant|buget|fondur|pnrr|grant|investit|tax|impozit|biograf|profil') then 1 else 2 end as pri from pages)) where rank <= 3""")
def c13_rank_urls(spark, d):
    rows = _t(spark, d, "pages").select(U.hostname(F.col("url")).alias("entity_id"), "url", F.col("page_id").alias("seq"), F.lit(False).alias("is_user"))
    return C.rank_urls(rows, 3).select("entity_id", "url", F.col("rank").cast("long").alias("rank"))


# ---- extraction
_MENTIONS = f"""mentions as (select entity_id, doc_id, n from (select entity_id, doc_id, len(list_filter({_TOKENS.format(_NORM)}, lambda x: x = entity_id)) as n from documents, names where length(text) >= 300) where n > 0)"""


@query(f"with {_NAMES}, {_MENTIONS} select * from mentions")
def d1_relevant_documents(spark, d):
    return D.relevant_documents(_t(spark, d, "documents"), _variants(spark))


@query(rf"""with {_NAMES}, {_PARAS}, near as (select *, lead(text) over w as n1, lead(text, 2) over w as n2, lag(text) over w as p1, lag(text, 2) over w as p2 from paras window w as (partition by doc_id order by pos)),
hit as (select * from near where regexp_matches(norm, '(^|[^\p{{L}}\p{{N}}_])(thing|ander|ought)')),
a as (select *, case when length(text) >= 120 then text else null end as own, n1 is not null and length(text) + 1 + length(n1) <= 1000000 as up from hit),
b as (select *, case when up then length(text) + 1 + length(n1) else length(text) end as s1 from a),
c as (select *, p1 is not null and s1 + 1 + length(p1) <= 1000000 as down from b),
e as (select *, case when down then s1 + 1 + length(p1) else s1 end as s2 from c),
f as (select *, up and not down and n2 is not null and s2 + 1 + length(n2) <= 1000000 as up2, down and not up and p2 is not null and s2 + 1 + length(p2) <= 1000000 as down2 from e),
x as (select doc_id, pos, coalesce(own, concat_ws(' ', case when down2 then p2 end, case when down then p1 end, text, case when up then n1 end, case when up2 then n2 end)) as excerpt, norm from f),
y as (select entity_id, doc_id, pos, excerpt, {_FP.format('excerpt', 300)} as fp from x, names where length(excerpt) >= 100 and list_contains({_TOKENS.format('lower(strip_accents(excerpt))')}, entity_id)),
z as (select * from (select *, row_number() over (partition by entity_id, doc_id, fp order by pos) as rn from y) where rn = 1)
select entity_id, doc_id, pos, md5(excerpt) as h, rank from (select *, row_number() over (partition by entity_id, doc_id order by length(excerpt) desc, pos) as rank from z) where rank <= 4""")
def d6_evidence(spark, d):
    """With a limit that no paragraph reaches: windows of sentences, which SQL can't express, are d5's and d6_evidence_full's."""
    found = D.evidence(C.text_paragraphs(_t(spark, d, "documents"), near=True), _variants(spark), WORDS, "topic", limit=1_000_000)
    return found.select("entity_id", "doc_id", F.col("pos").cast("long").alias("pos"), F.md5("excerpt").alias("h"), F.col("rank").cast("long").alias("rank"))


@query()
def d5_sentence_window(spark, d):
    paras = C.text_paragraphs(_t(spark, d, "documents"))
    return paras.select("doc_id", "pos", D.sentence_window(F.col("text"), X.prefix_rx(*WORDS), 300).alias("excerpt"))


@query()
def d6_evidence_full(spark, d):
    return D.evidence(C.text_paragraphs(_t(spark, d, "documents"), near=True), _variants(spark), WORDS, "topic")


@query()
def d7_funding(spark, d):
    channels = [("first", ["thing"]), ("second", ["ander", "ought"]), ("third", ["erin"])]
    return D.evidence(C.text_paragraphs(_t(spark, d, "documents"), near=True), _variants(spark), WORDS, "funding", channels, top=5)


@query(rf"""with {_PARAS} select doc_id, pos, list_filter([case when regexp_matches(norm, '(^|[^\p{{L}}\p{{N}}_])thing') then 'first' end, case when regexp_matches(norm, '(^|[^\p{{L}}\p{{N}}_])(ander|ought)') then 'second' end, case when regexp_matches(norm, '(^|[^\p{{L}}\p{{N}}_])erin') then 'third' end], lambda x: x is not null) as channels from paras""")
def d7_channels(spark, d):
    channels = [("first", ["thing"]), ("second", ["ander", "ought"]), ("third", ["erin"])]
    return C.text_paragraphs(_t(spark, d, "documents")).select("doc_id", F.col("pos").cast("long").alias("pos"), D.funding_channels(F.col("norm"), channels).alias("channels"))


@query()
def d8_mention_excerpts(spark, d):
    return D.mention_excerpts(C.text_paragraphs(_t(spark, d, "documents"), near=True), _variants(spark))


@query("""with a as (select *, case when role = lag(role) over (partition by conv_id order by turn) then 0 else 1 end as new from conversations), b as (select *, sum(new) over (partition by conv_id order by turn rows unbounded preceding) as run from a)
select conv_id, cast(run as bigint) as run, min(role) as role, count(*) as n_turns, cast(sum(length(text)) as bigint) as n_chars from b group by conv_id, run""")
def d9_role_turns(spark, d):
    return D.role_turns(_t(spark, d, "conversations"))


_ENTITY = "case conv_id % 4 when 0 then 'thon' when 1 then 'anea' when 2 then 'erin' else 'eron' end"


@query(rf"""with t as (select *, sum(case when role = 'user' then 1 else 0 end) over (partition by conv_id order by turn rows unbounded preceding) as n from conversations),
g as (select {_ENTITY} as entity_id, conv_id as doc_id, n as turn, trim(string_agg(text, chr(10) order by turn) filter (text <> ''), ' ') as text from (select conv_id, n, turn, case when role = 'user' then regexp_replace(text, '^\s+', '') else text end as text from t) group by 1, 2, 3)
select entity_id, doc_id, cast(turn as bigint) as turn, 'Ana ' || upper(entity_id[1]) || entity_id[2:] as speaker, md5(text) as h from g where turn > 0 and length(text) >= 150""")
def d9_speeches(spark, d):
    return transcripts(spark, _t(spark, d, "conversations"))


def transcripts(spark, turns):
    """Speeches of conversations as transcripts: each user's turn names its conversation's entity."""
    turns = turns.withColumn("e", F.element_at(F.array(*map(F.lit, NAMES)), (F.pmod("conv_id", F.lit(4)) + 1).cast("int")))
    head = F.concat(F.lit("Ana "), F.initcap("e"), F.lit(": "))
    paras = turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), F.when(F.col("role") == "user", F.concat(head, "text")).otherwise(F.col("text")).alias("text"))
    return D.speeches(paras, spark.createDataFrame([(n, n) for n in NAMES], "entity_id string, surname string")).select("entity_id", "doc_id", "turn", "speaker", F.md5("text").alias("h"))


@query()
def d10_statements(spark, d):
    return D.statements(C.text_paragraphs(_t(spark, d, "documents")), _variants(spark))


@query(rf"select doc_id, regexp_matches({_NORM}, '(^|[^\p{{L}}\p{{N}}_])(thing|on the)') as promise from documents")
def d11_is_promise(spark, d):
    return _t(spark, d, "documents").select("doc_id", D.is_promise(F.col("text"), ["thing", "on the"]).alias("promise"))


@query(f"""select source as entity_id, doc_id from (select *, row_number() over (partition by source, fp order by doc_id) as rn from (select source, doc_id, {_FP.format('text', 400)} as fp from documents)) where rn = 1 and length(fp) >= 20""")
def d12_dedupe(spark, d):
    rows = _t(spark, d, "documents").select(F.col("source").alias("entity_id"), "doc_id", "text")
    return D.dedupe(rows, "text", ["doc_id"], least=20).select("entity_id", "doc_id")


@query("select source as entity_id, doc_id, row_number() over (partition by source order by n_chars desc, lang, doc_id) as rank from documents")
def d13_rank_outputs(spark, d):
    rows = _t(spark, d, "documents").select(F.col("source").alias("entity_id"), "doc_id", "n_chars", "lang")
    return D.rank_by(rows, F.col("n_chars").desc(), F.col("lang"), F.col("doc_id")).select("entity_id", "doc_id", F.col("rank").cast("long").alias("rank"))


@query(f"with {_NAMES}, {_MENTIONS} select entity_id, coalesce(n_documents, 0) as n_documents, coalesce(n_long, 0) as n_long from names left join (select entity_id, count(*) as n_documents, count(case when n > 2 then 1 end) as n_long from mentions group by entity_id) using (entity_id)")
def d14_analysis_stats(spark, d):
    found = D.relevant_documents(_t(spark, d, "documents"), _variants(spark))
    return D.analysis_stats(_variants(spark), n_documents=found, n_long=found.where("n > 2"))


_V1 = r"""list_filter(list_transform(string_split(regexp_replace({}, '([.!?…])\s+([A-ZĂÂÎȘȚ„"])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) > 25)"""
_OPINIONS = rf"""sents as (select doc_id, pos, unnest({_V1.format('text')}) as quote, generate_subscripts({_V1.format('text')}, 1) - 1 as k from paras),
hits as (select *, len(list_filter({_TOKENS.format('lower(quote)')}, lambda t: regexp_matches(t, '^(tion|able|that)'))) as p, len(list_filter({_TOKENS.format('lower(quote)')}, lambda t: regexp_matches(t, '^(idiot|trash|scum|ther)'))) as m from sents),
named as (select entity_id, doc_id, pos, k, quote, case when p > m then 'positive' when m > p then 'negative' else 'mixed' end as tone, row_number() over (partition by entity_id, doc_id, quote order by pos, k) as rn from hits, names where p + m > 0 and list_contains({_TOKENS.format('lower(strip_accents(quote))')}, entity_id)),
opinions as (select * from (select *, row_number() over (partition by entity_id, doc_id order by pos, k) as r from named where rn = 1) where r <= 8)"""


@query(f"with {_PARAS}, {_NAMES}, {_OPINIONS} select entity_id, doc_id, cast(pos as int) as pos, cast(k as int) as k, quote, tone from opinions")
def d15_opinions(spark, d):
    people = spark.createDataFrame([(n, n) for n in NAMES], "entity_id string, surname string")
    return D.opinions(C.text_paragraphs(_t(spark, d, "documents")), people, r"(?iU)\b(?:tion|able|that)\w*", r"(?iU)\b(?:idiot|trash|scum|ther)\w*")


@query(f"""with {_PARAS}, {_NAMES}, {_OPINIONS}, t as (select entity_id, doc_id, case when count(case tone when 'positive' then 1 end) > count(case tone when 'negative' then 1 end) then 'positive' when count(case tone when 'positive' then 1 end) < count(case tone when 'negative' then 1 end) then 'negative' else 'mixed' end as tone from opinions group by 1, 2)
select entity_id, tone, count(*) as n from t group by 1, 2""")
def d16_article_tone(spark, d):
    return D.article_tone(d15_opinions(spark, d)).groupBy("entity_id", "tone").agg(F.count("*").alias("n"))


@query()
def d17_promises_v1(spark, d):
    return D.promises_v1(C.text_paragraphs(_t(spark, d, "documents")), spark.createDataFrame([(n, n) for n in NAMES], "entity_id string, surname string"))


@query(rf"""with raw as (select source as entity_id, doc_id, unnest({_SENT}) as text, generate_subscripts({_SENT}, 1) - 1 as k from documents),
words as (select *, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-zăâîșțşţ]{{6,}}'), lambda w: not list_contains({D.TOPIC_STOP}, w))) as w from raw),
s as (select entity_id, doc_id, doc_id % 1000 as day, doc_id || ':' || k as sid, text, list_distinct(list_transform(w, lambda x: left(x, 6))) as stems from words),
promises as (select *, case when len(stems) >= 6 then 3 else 2 end as need from s where regexp_matches({_NORM}, '{_WORD.format("thing")}')),
told as (select *, case when regexp_matches(text, '{_WORD.format("worthless")}') then 'broken' when regexp_matches(text, '{_WORD.format("with")}') then 'kept' end as outcome from s),
a as (select entity_id, sid as promise_id, doc_id, day, need, unnest(stems) as stem from promises), b as (select entity_id, sid, doc_id, day, outcome, unnest(stems) as stem from told where outcome is not null),
enough as (select a.entity_id, promise_id, sid, outcome from a join b on a.entity_id = b.entity_id and a.stem = b.stem and a.doc_id <> b.doc_id and b.day >= a.day group by a.entity_id, promise_id, sid, outcome, need having count(*) >= need),
counted as (select entity_id, promise_id, count(*) filter (outcome = 'kept') as n_kept, count(*) filter (outcome = 'broken') as n_broken from enough group by entity_id, promise_id)
select entity_id, promise_id, n_kept, n_broken, case when n_kept > 0 and n_broken > 0 then 'partial' when n_kept > 0 then 'kept' when n_broken > 0 then 'broken' else 'unverifiable' end as status
from (select p.entity_id, p.sid as promise_id, coalesce(n_kept, 0) as n_kept, coalesce(n_broken, 0) as n_broken from promises p left join counted c on p.entity_id = c.entity_id and p.sid = c.promise_id)""")
def d18_judge_promises(spark, d):
    docs = _t(spark, d, "documents").select(F.col("source").alias("entity_id"), "doc_id", "text")
    sents = docs.select("entity_id", "doc_id", F.posexplode(X.split_sentences(F.col("text"))).alias("k", "text"))
    day = F.date_add(F.lit("2026-01-01").cast("date"), F.pmod("doc_id", F.lit(1000)).cast("int"))
    sents = sents.withColumn("date", day).withColumn("sent_id", F.concat_ws(":", "doc_id", "k"))
    promises = sents.where(X.has_word(X.fold(F.col("text")), "thing")).withColumnRenamed("sent_id", "promise_id")
    return D.judge_promises(promises, sents, kept=r"(?U)\bwith\b", broken=r"(?U)\bworthless\b")


# ---- passages and pairs
@query(r"""select doc_id, list_filter([case when regexp_matches(t, '\b(niciodata|intotdeauna|mereu|toti|toate|nimeni|nimic|absolut|complet|total|fara exceptie|oricand|nicio|niciun|zero|100 ?%|100 la suta)\b') then 'absolute language' end, case when regexp_matches(t, '\d') then 'numeric claim' end, case when regexp_matches(t, 'din cauza|din vina|vina (?:este|e) a|datorita faptului') then 'sweeping causal claim' end, case when regexp_matches(t, '\b(?:minte|mint|hoti|hot|tradator|corup|vandut|infractor|trada)\w*') then 'accusation' end], lambda x: x is not null) as cues from (select doc_id, lower(strip_accents(text)) as t from documents)""")
def e2_cues(spark, d):
    return _t(spark, d, "documents").select("doc_id", E.heuristic_cues(F.col("text"), promise=["promisiune nespusa"]).alias("cues"))


@query("""select source as entity_id, doc_id, cast(floor((case doc_id % 3 when 0 then 3.0::double when 1 then 2.0::double else 1.0::double end + 0.4::double * (doc_id % 4) + (n_chars % 101) / 100.0::double) * 10000.0::double + 0.5::double) / 10000.0::double as decimal(12,4)) as priority from documents""")
def e5_priority(spark, d):
    kind = F.element_at(F.array(F.lit("speech"), F.lit("quote"), F.lit("reported")), (F.pmod("doc_id", F.lit(3)) + 1).cast("int"))
    rows = _t(spark, d, "documents")
    return rows.select(F.col("source").alias("entity_id"), "doc_id", E.priority(kind, F.pmod("doc_id", F.lit(4)), F.pmod("n_chars", F.lit(101))).alias("priority"))


@query("""with recursive placed as (select conv_id as e, turn, length(text) as size, row_number() over (partition by conv_id order by turn) as p from conversations),
walk as (select e, p, 0 as b, size as used, 1 as n from placed where p = 1 union all
select r.e, r.p, case when used + size > 2000 or n >= 8 then b + 1 else b end, case when used + size > 2000 or n >= 8 then size else used + size end, case when used + size > 2000 or n >= 8 then 1 else n + 1 end from walk w join placed r on r.e = w.e and r.p = w.p + 1)
select e as conv_id, turn, size, b as batch_no from placed join walk using (e, p)""")
def e6_pack_batches(spark, d):
    rows = _t(spark, d, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("size"))
    return E.pack_batches(rows, ["conv_id"], "size", 2000, order="turn")


def _snippets(spark, d):
    docs = _t(spark, d, "documents")
    sents = docs.select(F.col("source").alias("entity_id"), "doc_id", F.posexplode(X.split_sentences(F.col("text"))).alias("k", "text")).where(F.length("text").between(60, 500))
    return E.with_marks(sents.withColumn("source_score", F.pmod("doc_id", F.lit(7))), 160, ("doc_id", "k"))


_STOP = "['" + "','".join(E.L.STOPWORDS) + "']"
_SNIPPETS = rf"""sents as (select source as entity_id, doc_id, unnest({_SENT}) as text, generate_subscripts({_SENT}, 1) - 1 as k from documents),
snip as (select entity_id, snippet_id, doc_id, text, list_sort(list_distinct(list_transform(list_filter(regexp_extract_all({_NORM}, '[a-z]+'), lambda w: length(w) >= 5 and not list_contains({_STOP}, w)), lambda w: left(w, 6)))) as stems, list_sort(list_distinct(regexp_extract_all(text, '\d+(?:[.,]\d+)?'))) as nums, regexp_matches({_NORM}, '\b(?:nu|nici|niciodata|fara|nicio|niciun|nimeni|nimic)\b') as neg
from (select *, row_number() over (partition by entity_id order by doc_id % 7 desc, doc_id, k) as snippet_id from sents where length(text) between 60 and 500) where snippet_id <= 160)"""


@query(f"with {_SNIPPETS} select entity_id, snippet_id, doc_id, stems, nums, neg from snip")
def e9_snippets(spark, d):
    return _snippets(spark, d).select("entity_id", "snippet_id", "doc_id", "stems", "nums", "neg")


@query(f"""with {_SNIPPETS}, p as (select a.entity_id, a.snippet_id as i, b.snippet_id as j, len(list_intersect(a.stems, b.stems)) as shared, len(list_distinct(list_concat(a.stems, b.stems))) as u, case when len(a.nums) > 0 and len(b.nums) > 0 and a.nums <> b.nums then 2.0 else 0.0 end + case when a.neg <> b.neg then 1.5 else 0.0 end + case when a.doc_id <> b.doc_id then 0.5 else 0.0 end as extra from snip a join snip b on a.entity_id = b.entity_id and a.snippet_id < b.snippet_id)
select entity_id, i, j, shared, score, rank from (select *, row_number() over (partition by entity_id order by score desc, i desc, j desc) as rank from (select entity_id, i, j, shared, cast(shared + extra as double) as score from p where shared >= 3 and shared <= 0.8 * u)) where rank <= 20""")
def e11_candidate_pairs(spark, d):
    return E.candidate_pairs(_snippets(spark, d))


@query("""with r as (select cast(conv_id as varchar) as request_id, list(turn order by turn) as m, conv_id % 3 = 0 and count(*) > 1 as bad from conversations group by conv_id),
h as (select request_id, m, bad, unnest(case when bad then [1, 2] else [0] end) as s from r)
select case when bad then request_id || '.' || s else request_id end as request_id, case when not bad then m when s = 1 then m[1:len(m) // 2] else m[len(m) // 2 + 1:] end as members from h""")
def e13_replan(spark, d):
    rows = _t(spark, d, "conversations").groupBy(F.col("conv_id").cast("string").alias("request_id")).agg(F.array_sort(F.collect_list("turn")).alias("members"))
    return E.replan_failed(rows, rows.where(F.col("request_id").cast("long") % 3 == 0))


# ---- answers
@query("""select source as entity_id, doc_id from (select source, doc_id, sum(n_chars + 1) over (partition by source order by doc_id rows unbounded preceding) as s from documents) where s <= 20000""")
def f13_fit_lines(spark, d):
    rows = _t(spark, d, "documents").select(F.col("source").alias("entity_id"), "doc_id", "n_chars")
    return R.fit_lines(rows, "entity_id", F.col("n_chars"), 20000, ["doc_id"]).select("entity_id", "doc_id")


@query("""select l_orderkey, l_linenumber, cast(greatest(1, least(10, round_even(l_quantity / 4, 0))) as int) as score from lineitem""")
def f15_clamp_score(spark, d):
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", R.clamp_score((F.col("l_quantity") / 4).cast("string")).alias("score"))


@query("""select l_suppkey as entity_id, count(*) as n_articles, max(z) as z from (select *, 4 as z, row_number() over (partition by l_suppkey, l_orderkey order by cast(l_linenumber as varchar)) as rn from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_quantity, l_extendedprice) as one from lineitem) where one = 1) where rn = 1 group by 1""")
def f17_credibility_basis(spark, d):
    return f17_entity_credibility(spark, d).select("entity_id", "n_articles", "z")


def _article_scores(spark, d):
    """Every line of an order is an item of its answer, by its number; a supplier's first line in an order counts."""
    rows = C.keep_first(_t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"])
    text = lambda c: c.cast("string")
    ids = [text(F.col("l_orderkey")).alias("request_id"), text(F.col("l_linenumber")).alias("local_id")]
    items = rows.select(*ids, text(F.pmod("l_quantity", F.lit(10)) + 1).alias("feasibility"), text(F.pmod("l_partkey", F.lit(10)) + 1).alias("precision"), text(F.pmod("l_orderkey", F.lit(10)) + 1).alias("manipulation"))
    members = rows.select(*ids, F.col("l_suppkey").alias("entity_id"), F.col("l_orderkey").alias("doc_id"))
    return R.article_scores(items, members, rows.select(F.col("l_suppkey").alias("entity_id")).distinct().withColumn("history", F.lit(4)))


_SCORES = """lines as (select * from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_quantity, l_extendedprice) as one from lineitem) where one = 1),
scores as (select l_suppkey as entity_id, l_orderkey as doc_id, cast(l_quantity as bigint) % 10 + 1 as x, l_partkey % 10 + 1 as y, l_orderkey % 10 + 1 as w from (select *, row_number() over (partition by l_suppkey, l_orderkey order by cast(l_linenumber as varchar)) as rn from lines) where rn = 1)"""
#: Half to even from ten-thousandths to tenths, and from hundredths to tenths.
_TENTHS = "({0} // 1000 + case when {0} % 1000 > 500 or ({0} % 1000 = 500 and ({0} // 1000) % 2 = 1) then 1 else 0 end)"


@query(f"with {_SCORES} select entity_id, doc_id, x, y, w, (2 * (x + y + w) + 16) / 10.0 as score from scores")
def f16_article_scores(spark, d):
    return _article_scores(spark, d).select("entity_id", "doc_id", "x", "y", "w", "score")


@query(f"""with {_SCORES}, m as (select entity_id, cast(round(sum(x) * 10000.0 / count(*)) as bigint) as mx, cast(round(sum(y) * 10000.0 / count(*)) as bigint) as my, cast(round(sum(w) * 10000.0 / count(*)) as bigint) as mw, count(*) as n_articles from scores group by 1),
t as (select entity_id, {_TENTHS.format('mx')} as x, {_TENTHS.format('my')} as y, {_TENTHS.format('mw')} as w, n_articles from m), v as (select *, 2 * (x + y + w) + 160 as h from t)
select entity_id, x / 10.0 as x, y / 10.0 as y, 4 as z, w / 10.0 as w, (h // 10 + case when h % 10 > 5 or (h % 10 = 5 and (h // 10) % 2 = 1) then 1 else 0 end) / 10.0 as score, n_articles from v""")
def f17_entity_credibility(spark, d):
    return R.entity_credibility(_article_scores(spark, d))


@query(r"""with p as (select d.doc_id, d.text as s, lower(strip_accents(b.text)) as mat from documents d join benchmark b on b.item_id = d.doc_id % (select count(*) from benchmark))
select doc_id, list_distinct(list_filter(list_transform(regexp_extract_all(s, '\d[\d.,]*\d|\d'), lambda n: regexp_replace(n, '[.,]+$', '')), lambda n: not contains(mat, n) and not contains(regexp_replace(mat, '[.\s]', '', 'g'), regexp_replace(n, '[.\s]', '', 'g')))).len() as n from p""")
def f19_numbers(spark, d):
    rows = _grounding(spark, d)
    numbers = F.filter(R.ungrounded(F.col("s"), F.col("mat")), lambda x: x.rlike(r"^\d"))
    return rows.select("doc_id", F.size(numbers).cast("long").alias("n"))


def _grounding(spark, d):
    docs, items = _t(spark, d, "documents"), _t(spark, d, "benchmark").select("item_id", F.col("text").alias("mat"))
    return docs.select("doc_id", F.col("text").alias("s"), F.pmod("doc_id", F.lit(items.count())).alias("item_id")).join(items, "item_id")


@query()
def f19_ungrounded(spark, d):
    return _grounding(spark, d).select("doc_id", R.ungrounded(F.col("s"), F.col("mat")).alias("unsupported"))


@query("""select source as entity_id, kind as category, count(*) as n from (select source, case when doc_id % 3 = 0 then 'implausible' when doc_id % 3 = 1 then 'misleading' else 'contradiction' end as kind from documents) group by 1, 2""")
def f7_flag_counts(spark, d):
    rows = _t(spark, d, "documents").select(F.col("source").alias("entity_id"), F.element_at(F.array(F.lit("implausible"), F.lit("misleading"), F.lit("contradiction")), (F.pmod("doc_id", F.lit(3)) + 1).cast("int")).alias("category"), F.lit("low").alias("severity"))
    return R.flag_summary(rows).select("entity_id", F.explode("by_category").alias("category", "n"))


@query(r"""select cast(doc_id as varchar) as request_id, 'P1' as id, 'implausible' as category, 'medium' as severity, 'high' as confidence, regexp_replace(text, '[\\"\x00-\x1f]', ' ', 'g') as quote from documents""")
def f3_findings(spark, d):
    """Answers that quote whole documents: every fifth is cut, so its complete objects are salvaged."""
    docs = _t(spark, d, "documents")
    quote = F.regexp_replace("text", r'[\\"\x00-\x1f]', " ")
    one = F.concat(F.lit('{"id": "P1", "category": "implausible", "severity": "huge", "confidence": "high", "quote": "'), quote, F.lit('", "problem": "p", "reasoning": "r"}'))
    whole = F.concat(F.lit('{"findings": ['), one, F.lit("]}"))
    cut = F.concat(F.lit('{"findings": ['), one, F.lit(', {"id": "P2", "cat'))
    answers = docs.select(F.col("doc_id").cast("string").alias("request_id"), F.when(F.col("doc_id") % 5 == 0, cut).otherwise(whole).alias("content"))
    return R.validate_findings(R.parse_findings(answers)).select("request_id", "id", "category", "severity", "confidence", "quote")


@query()
def f4_locate_quotes(spark, d):
    """Quotes of the first sentence, as it is, with other punctuation, or with a word changed."""
    docs = _t(spark, d, "documents").withColumn("first", F.get(X.split_sentences(X.squash(F.col("text"))), 0))
    quote = F.when(F.col("doc_id") % 3 == 0, F.col("first")).when(F.col("doc_id") % 3 == 1, F.upper(F.replace("first", F.lit(","), F.lit(";")))).otherwise(F.regexp_replace("first", "^([a-zA-Z])", "x$1"))
    claims = docs.select(F.col("doc_id").alias("finding_id"), F.lit(0).alias("passage_order"), quote.alias("quote"), F.col("text"), F.lit(None).cast("string").alias("context"))
    return R.locate_quotes(claims)


@query()
def f21_axis_context(spark, d):
    """Held against a plain walk in tests."""
    docs = _t(spark, d, "documents").select(F.col("source").alias("entity_id"), "doc_id", F.concat_ws(" | ", "lang", "source").alias("header"))
    paras = C.text_paragraphs(_t(spark, d, "documents")).join(docs, "doc_id").withColumn("official", F.col("doc_id") % 10 == 0).withColumn("names_entity", X.has_word(F.col("norm"), *NAMES))
    axes = spark.createDataFrame([("first", "(?i)thing|ander"), ("second", "(?i)ought|tion")], "axis_id string, rx string")
    return R.axis_context(paras, axes, 6000)


# ---- questionnaire
def _answers(spark, d):
    from attesta.operators.corpus import keep_first

    lines, orders = _t(spark, d, "lineitem"), _t(spark, d, "orders").select("o_orderkey", "o_custkey")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("respondent_id"), F.pmod("l_partkey", F.lit(50)).alias("item_id"), (F.col("l_quantity").cast("int") % 5 + 1).alias("value"), (F.col("l_partkey") % 11 == 0).alias("is_dk"), F.col("l_quantity").alias("seconds"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "seconds", "l_extendedprice"]
    return keep_first(rows, ["respondent_id", "item_id"], order).drop("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


def _items(spark):
    return spark.range(50).select(F.col("id").alias("item_id"), F.floor(F.col("id") / 5).alias("axis_id"), F.when(F.col("id") % 2 == 0, 1).otherwise(-1).alias("direction"), F.col("id").alias("item_no"))


_ANSWERS = """answers as (select * from (select o_custkey as respondent_id, l_partkey % 50 as item_id, cast(l_quantity as int) % 5 + 1 as value, l_partkey % 11 = 0 as is_dk, l_quantity as seconds, row_number() over (partition by o_custkey, l_partkey % 50 order by l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) as rn from lineitem join orders on l_orderkey = o_orderkey) where rn = 1),
axis as (select respondent_id, item_id // 5 as axis_id, count(v) as k, sum(v) as total, count(*) as n from (select *, case when not is_dk then case when item_id % 2 = 0 then value else 6 - value end end as v from answers) group by 1, 2),
scored as (select respondent_id, axis_id, k, case when k >= 2 and k / n >= 0.6 then total / k end as score from axis)"""


@query(f"with {_ANSWERS} select respondent_id, axis_id, k, case when score is null then 'insufficient' else 'ok' end as status, round(score, 6) as score from scored")
def g8_axis_scores(spark, d):
    return G.axis_scores(_answers(spark, d), _items(spark)).select("respondent_id", "axis_id", "k", "status", F.round("score", 6).alias("score"))


@query(f"""with {_ANSWERS}, t as (select *, (score - 3) / (1.15 * sqrt(0.45)) as theta, sqrt(greatest(0, (1 - rel) / rel)) as sem from (select *, least(0.99, k * 0.45 / (1 + (k - 1) * 0.45)) as rel from scored where score is not null)),
u as (select *, abs(theta) / sqrt(2.0) as x, 1 / (1 + 0.3275911 * abs(theta) / sqrt(2.0)) as q from t)
select respondent_id, axis_id, round(sem * 1.15 * sqrt(0.45), 6) as margin, round(100 * 0.5 * (1 + sign(theta) * (1 - ((((1.061405429 * q - 1.453152027) * q + 1.421413741) * q - 0.284496736) * q + 0.254829592) * q * exp(-x * x))), 6) as percentile, case when abs(theta) / greatest(1e-6, sem) < 1 then 'middle' when abs(theta) / greatest(1e-6, sem) < 2 then 'lean' else 'clear' end as clarity from u""")
def g9_percentiles(spark, d):
    rows = G.axis_scores(_answers(spark, d), _items(spark)).where("status = 'ok'")
    return rows.select("respondent_id", "axis_id", F.round("margin", 6).alias("margin"), F.round("percentile", 6).alias("percentile"), "clarity")


@query(f"""with {_ANSWERS}, ok as (select respondent_id, axis_id, score - 3 as t from scored where score is not null), pairs as (select a.respondent_id, case when (case when (a.axis_id + b.axis_id) % 3 = 0 then -0.2 else 0.3 end) * a.t * b.t < 0 then 1.0 else 0.0 end as x from ok a join ok b on a.respondent_id = b.respondent_id and a.axis_id < b.axis_id)
select respondent_id, count(*) as axes_scored, round(coalesce((select avg(x) from pairs p where p.respondent_id = ok.respondent_id), 0), 6) as tension_share from ok group by respondent_id""")
def g11_coherence(spark, d):
    n = spark.range(10)
    corr = n.select(F.col("id").alias("ax_i")).join(n.select(F.col("id").alias("ax_j")), F.col("ax_i") < F.col("ax_j")).withColumn("r", F.when((F.col("ax_i") + F.col("ax_j")) % 3 == 0, -0.2).otherwise(0.3))
    out = G.coherence(G.axis_scores(_answers(spark, d), _items(spark)), corr)
    return out.select("respondent_id", "axes_scored", F.round("tension_share", 6).alias("tension_share"))


@query(f"""with {_ANSWERS}, m as (select respondent_id, max(c) as top from (select respondent_id, value, count(*) as c from answers where not is_dk group by 1, 2) group by 1),
b as (select respondent_id, count(*) as n, count(case when not is_dk then 1 end) as numeric, list_sort(list(seconds))[count(*) // 2 + 1] as med from answers group by 1)
select respondent_id, round(1 - numeric / n, 6) as dk_share, list_filter([case when 1 - numeric / n > 0.25 then 'dk' end, case when numeric >= 6 and top / numeric >= 0.6 then 'flat' end, case when med < 2.5 then 'fast' end], lambda x: x is not null) as flags from b left join m using (respondent_id)""")
def g12_quality_flags(spark, d):
    return G.quality_flags(_answers(spark, d)).select("respondent_id", F.round("dk_share", 6).alias("dk_share"), "flags")


@query(f"""with {_ANSWERS}, f as (select respondent_id, axis_id, row_number() over (partition by respondent_id order by case when score is null then 0 else k end, axis_id) as rank from scored),
pool as (select respondent_id, f.axis_id, rank, i as item_id, i % 2 as odd, row_number() over (partition by respondent_id, f.axis_id, i % 2 order by i) as r from f join (select unnest(range(50)) as i) on i // 5 = f.axis_id where not exists (select 1 from answers a where a.respondent_id = f.respondent_id and a.item_id = i))
select respondent_id, item_id, cast(nth as int) as nth from (select *, row_number() over (partition by respondent_id order by rank, 2 * r - case when odd = 0 then 1 else 0 end) as nth from pool where r <= 3) where nth <= 5""")
def g15_next_items(spark, d):
    answers = _answers(spark, d)
    scores = G.axis_scores(answers, _items(spark))
    order = G.focus_order(scores.select("respondent_id", "axis_id", F.col("axis_id").alias("axis_no"), F.lit(1.0).alias("weight"), "margin"))
    return G.next_items(order, _items(spark), answers, 5)


def _positions(spark, d):
    return G.axis_scores(_answers(spark, d), _items(spark)).where("status = 'ok'").select(F.col("respondent_id").alias("subject_id"), "axis_id", G.site_position(F.col("score")).alias("value"))


_MATCH = f"""with {_ANSWERS}, pos as (select respondent_id as s, axis_id, greatest(0, least(100, ((6 - score) - 1) * 25)) as v from scored where score is not null), cat as (select n_nationkey as e, axis_id, cast((n_nationkey * 7 + axis_id * 11) % 101 as double) as v from nation, (select unnest(range(10)) as axis_id)),
cmp as (select s as a_id, e as b_id, count(*) as compared, cast(round(cast(100 - avg(abs(pos.v - cat.v)) as decimal(12,4))) as double) as match, count(case when abs(pos.v - cat.v) >= 30 then 1 end) as n_major from pos join cat using (axis_id) group by 1, 2)"""


def _catalogue(spark, d):
    subjects = _t(spark, d, "nation").select(F.col("n_nationkey").alias("subject_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))).alias("axis_id"))
    return subjects.withColumn("value", F.pmod(F.col("subject_id") * 7 + F.col("axis_id") * 11, F.lit(101)).cast("double"))


@query(f"{_MATCH} select a_id, b_id, compared, match, n_major from cmp")
def g4_compare(spark, d):
    """Respondents against the nations as a catalogue, whose size doesn't grow."""
    return G.compare_positions(_positions(spark, d), _catalogue(spark, d))


@query(f"{_MATCH} select a_id, b_id, match, rank from (select *, row_number() over (partition by a_id order by match desc, b_id) as rank from cmp where compared >= 3) where rank <= 3")
def g5_rank_matches(spark, d):
    found = G.top_matches(_positions(spark, d), _catalogue(spark, d), 3)
    return found.select("a_id", "b_id", "match", F.col("rank").cast("long").alias("rank"))


@query("""with w as (select l_suppkey as entity_id, quantile_disc(l_discount / l_quantity, 0.15) as worst, avg(case when l_tax * 100 % 4 = 0 then 1.0 else 0.5 end) as pm from lineitem group by 1) select entity_id, round(worst, 9) as worst, round(pm, 6) as promise_mean, cast(greatest(1, least(10, round(cast(pm * worst as decimal(18,9)) * 10))) as int) as credibility from w""")
def g19_final_score(spark, d):
    lines = _t(spark, d, "lineitem")
    chunks = lines.select(F.col("l_suppkey").alias("entity_id"), F.col("l_discount").alias("u"), F.col("l_quantity").alias("s"))
    kept = lines.select(F.col("l_suppkey").alias("entity_id"), F.when((F.col("l_tax") * 100) % 4 == 0, 1.0).otherwise(0.5).alias("value"))
    out = G.final_scores(chunks, kept)
    return out.select("entity_id", F.round("worst", 9).alias("worst"), F.round("promise_mean", 6).alias("promise_mean"), "credibility")


# ---- profiles
@query(r"""select domain, count(*) as n_sources, count(case when s then 1 end) as n_with_statements, bool_or(o) as official, count(distinct e) as n_entities from (select regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)), '^www\.', '') as domain, page_id % 2 = 0 as s, page_id % 5 = 0 as o, page_id % 7 as e from pages) group by domain""")
def h5_domain_rollup(spark, d):
    rows = _t(spark, d, "pages").select(U.hostname(F.col("url")).alias("domain"), (F.col("page_id") % 2 == 0).alias("has_statement"), (F.col("page_id") % 5 == 0).alias("official"), (F.col("page_id") % 7).alias("entity_id"))
    return H.domain_rollup(rows)


@query("""with t as (select * from (values (0, 0, '"{n}" a'), (0, 1, '"{n}" b'), (1, 0, '{n} c'), (1, 1, '"{n}" a'), (2, 0, '{n} d')) as v(group_no, rank_in_group, template)), q as (select c_custkey as entity_id, replace(template, '{n}', c_name) as query, rank_in_group, group_no from customer, t),
u as (select * from (select *, row_number() over (partition by entity_id, query order by rank_in_group, group_no) as rn from q) where rn = 1) select entity_id, rank, query from (select *, row_number() over (partition by entity_id order by rank_in_group, group_no) as rank from u) where rank <= 4""")
def h7_search_plan(spark, d):
    templates = spark.createDataFrame([(0, 0, '"{n}" a'), (0, 1, '"{n}" b'), (1, 0, "{n} c"), (1, 1, '"{n}" a'), (2, 0, "{n} d")], "group_no int, rank_in_group int, template string")
    people = _t(spark, d, "customer").select(F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("name"))
    return H.search_plan(people, templates, 4).select("entity_id", F.col("rank").cast("long").alias("rank"), "query")


@query("""select user_id as entity_id, event_type as url, event_id as seq from (select *, row_number() over (partition by user_id, event_type order by event_id) as rn from events) where rn = 1""")
def h8_merge_discovered(spark, d):
    events = _t(spark, d, "events").select(F.col("user_id").alias("entity_id"), F.col("event_type").alias("url"), F.to_date("ts").alias("rss_date"), F.col("event_id").alias("seq"))
    return H.merge_discovered(events, events.select("entity_id", "url", "seq")).select("entity_id", "url", "seq")


@query("""select distinct user_id as entity_id, event_type as url from events e where event_id % 2 = 1 and not exists (select 1 from events f where f.event_id % 2 = 0 and f.user_id = e.user_id and f.event_type = e.event_type)""")
def h9_opinion_sources(spark, d):
    """Odd events are the second discovery, even ones the main one."""
    events = _t(spark, d, "events").select(F.col("user_id").alias("entity_id"), F.col("event_type").alias("url"), "event_id")
    return H.opinion_sources(events.where("event_id % 2 = 1"), events.where("event_id % 2 = 0")).select("entity_id", "url").distinct()


@query("""select user_id as entity_id, count(case when ts < timestamp '2024-01-15' then 1 end) as n_older, 0 as n_undated from events group by 1""")
def h4_recent_counts(spark, d):
    rows = _t(spark, d, "events").select(F.col("user_id").alias("entity_id"), F.to_date("ts").alias("date"), F.col("event_id").alias("doc_id"))
    return H.recent_feed(rows, "2025-01-15")[1].withColumn("n_undated", F.col("n_undated").cast("int"))


@query()
def a8_report(spark, d):
    """Sections of evidence, funding evidence, mentions and sources of the documents."""
    top = lambda found: D.rank_by(found.drop("rank").withColumnRenamed("excerpt", "text").select("entity_id", "doc_id", "text"), F.length("text").desc(), F.col("doc_id"), F.col("text"), top=40)
    told, funding = top(d6_evidence_full(spark, d)), top(d7_funding(spark, d))
    named = top(d8_mention_excerpts(spark, d))
    sources = D.rank_by(D.relevant_documents(_t(spark, d, "documents"), _variants(spark)).withColumn("text", F.concat(F.lit("document "), F.col("doc_id").cast("string"))), F.col("n").desc(), F.col("doc_id"), top=40)
    people = _variants(spark).withColumnRenamed("variant", "name")
    return H.report(people, told, named, told, funding, sources)


@query()
def a10_export_profile(spark, d):
    answers = _answers(spark, d)
    return H.export_profile(G.axis_scores(answers, _items(spark)), G.quality_flags(answers))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """For each entity, its best evidence excerpts and how many of its documents hold any."""
    found = D.evidence(C.text_paragraphs(_t(spark, d, "documents"), near=True), _variants(spark), WORDS, "topic")
    ranked = D.rank_by(D.dedupe(found, "excerpt", ["doc_id", "pos"]), F.length("excerpt").desc(), F.col("doc_id"), F.col("pos"), top=10)
    counts = found.groupBy("entity_id").agg(F.countDistinct("doc_id").alias("n_documents"))
    return ranked.join(counts, "entity_id").select("entity_id", "rank", "doc_id", "pos", "keyword", "excerpt", "n_documents")


def queries() -> dict:
    from attesta.plans import chain  # noqa: F401  registers its queries

    return dict(_Q)


def oracle_sql() -> dict:
    return {k: _SQL[k] for k in queries() if k in _SQL}
