"""Entity-aware extraction: mentions, evidence, speeches, statements, promises, opinions."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from attesta.functions import lexicons as L
from attesta.functions.text import fingerprint, fold, fold_plain, has_prefix, once, prefix_rx, split_sentences, split_sentences_v1, squash, word_rx
from attesta.operators.corpus import fold_literal, keep_first
from attesta.operators.scans import numbered


def folded(terms: list[str]) -> list[str]:
    import unicodedata

    return ["".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn").lower() for t in terms]


#: Bytes of variants that every task holds as an automaton; more of them are joined by words.
AUTOMATON_BYTES = 64 << 20
#: Signs that are part of words besides letters, marks and digits: joiners.
_JOINERS = "\u200c\u200d"


def _part_of_word(c: str) -> bool:
    import unicodedata

    kind = unicodedata.category(c)
    return kind[0] in "LM" or kind in ("Nd", "Nl", "Pc") or c in _JOINERS


def mentions(texts: DataFrame, variants: DataFrame, by: str = "doc_id") -> DataFrame:
    """(entity_id, by, n): whole-word hits of each entity's variants in folded texts; hits of one variant don't overlap.

    texts: (by, norm), one row of each; variants: (entity_id, variant), folded, a dimension; those without a letter or digit are left out.
    Variants of up to AUTOMATON_BYTES in all go to every task, which finds all of them in one pass over a text (Aho-Corasick),
    so texts aren't shuffled and the time doesn't grow with the variants; more meet texts over words.
    """
    used = variants.select("entity_id", "variant").where(F.col("variant").rlike(r"(?U)\w")).distinct()
    return _mentions_by_automaton(texts, used, by) if _size(used) <= AUTOMATON_BYTES else _mentions_by_words(texts, used, by)


def _mentions_by_automaton(texts: DataFrame, variants: DataFrame, by: str) -> DataFrame:
    told = variants.groupBy("variant").agg(F.array_sort(F.collect_list("entity_id")).alias("own")).collect()
    shared = texts.sparkSession.sparkContext.broadcast([(r.variant, r.own) for r in told])
    entity = to_arrow_type(variants.schema["entity_id"].dataType)
    kinds = {"entity_id": variants.schema["entity_id"].dataType.simpleString(), by: texts.schema[by].dataType.simpleString()}

    def find(parts: Iterator) -> Iterator:
        import pyarrow as pa

        machine, names = _automaton(shared)
        word: dict = {}

        def inside(c: str) -> bool:
            if c not in word:
                word[c] = _part_of_word(c)
            return word[c]

        for part in parts:
            who, at, n, of = [], [], [], part.schema.field(0).type
            for k, text in enumerate(part.column(1).to_pylist()):
                hits, ends = {}, {}
                for end, v in machine.iter(text) if text and names else ():
                    start, end = end - len(names[v][0]) + 1, end + 1
                    if start < ends.get(v, 0) or (start and inside(text[start - 1])) or (end < len(text) and inside(text[end])):
                        continue
                    ends[v] = end
                    hits[v] = hits.get(v, 0) + 1
                total: dict = {}
                for v, m in hits.items():
                    for e in names[v][1]:
                        total[e] = total.get(e, 0) + m
                who.extend(total)
                n.extend(total.values())
                at.extend([k] * len(total))
            yield pa.RecordBatch.from_arrays([pa.array(who, entity), part.column(0).take(pa.array(at, pa.int64())).cast(of), pa.array(n, pa.int64())], names=["entity_id", by, "n"])

    return texts.select(by, "norm").mapInArrow(find, f"entity_id {kinds['entity_id']}, {by} {kinds[by]}, n long")


#: The automaton that a worker holds, and the variants it was built of.
_HELD: dict = {}


def _automaton(shared) -> tuple:
    import ahocorasick

    names = shared.value
    if _HELD.get("of") is not names:
        machine = ahocorasick.Automaton()
        for k, (variant, _) in enumerate(names):
            machine.add_word(variant, k)
        machine.make_automaton()
        _HELD.update(of=names, machine=machine)
    return _HELD["machine"], names


def _mentions_by_words(texts: DataFrame, variants: DataFrame, by: str) -> DataFrame:
    """Texts meet variants over words, so no text is compared with every entity, and only words are shuffled. Phrases are looked for
    in texts that hold their first word."""
    word = F.regexp_extract("variant", r"(?U)\w+", 0)
    wanted = variants.select("entity_id", "variant", word.alias("word"))
    words = texts.select(by, F.explode(F.regexp_extract_all("norm", F.lit(r"(?U)\w+"), F.lit(0))).alias("word"))
    met = words.join(wanted, "word").groupBy("entity_id", "variant", "word", by).agg(F.count("*").alias("n"))
    single = met.where("variant = word").select("entity_id", by, "n")
    phrase = F.regexp_count("norm", F.concat(F.lit(r"(?U)(?<!\w)\Q"), F.col("variant"), F.lit(r"\E(?!\w)"))).cast("long")
    phrases = met.where("variant <> word").drop("n").join(texts.select(by, "norm"), by).select("entity_id", by, phrase.alias("n"))
    return single.unionByName(phrases).where("n > 0").groupBy("entity_id", by).agg(F.sum("n").cast("long").alias("n"))


def _size(variants: DataFrame) -> int:
    """Bytes of variants, about as a task holds them."""
    return variants.agg(F.sum(F.octet_length("variant") + 16).alias("n")).first().n or 0


def named_rows(rows: DataFrame, variants: DataFrame, by: tuple = ("doc_id", "pos")) -> DataFrame:
    """rows with entity_id, once for each variant that a row's norm names; norm goes, all other columns stay.

    rows: (*by, norm, ...), one of each by. Each row's distinct words meet variants, and phrases are looked for in rows that hold their
    first word. Variants of up to AUTOMATON_BYTES in all are sent to every task, so rows stay where they are; with more of them only
    words and `by` are shuffled, and rows are joined to what was found.
    """
    word = F.regexp_extract("variant", r"(?U)\w+", 0)
    used = variants.select("entity_id", "variant").where(F.col("variant").rlike(r"(?U)\w")).distinct()
    wanted = used.withColumn("_word", word)
    kept = [c for c in rows.columns if c not in ("entity_id", "norm")]
    whole = (F.col("variant") == F.col("_word")) | F.rlike("norm", F.concat(F.lit(r"(?U)(?<!\w)\Q"), F.col("variant"), F.lit(r"\E(?!\w)")))
    words = F.explode(F.array_distinct(F.regexp_extract_all("norm", F.lit(r"(?U)\w+"), F.lit(0))))
    if _size(used) <= AUTOMATON_BYTES:
        # told by hint, since Spark doesn't know the size of a table from the driver and would shuffle all words of all rows
        return rows.withColumn("_word", words).join(F.broadcast(wanted), "_word").where(whole).select("entity_id", *kept)
    met = rows.select(*by, words.alias("_word")).join(wanted, "_word")
    return met.join(rows, list(by)).where(whole).select("entity_id", *kept)


def relevant_documents(docs: DataFrame, variants: DataFrame, least: int = 300) -> DataFrame:
    """(entity_id, doc_id, n) of documents of at least 300 characters that name the entity."""
    return mentions(docs.where(F.length("text") >= least).select("doc_id", fold(F.col("text")).alias("norm")), variants)


def sentence_window(text: Column, rx: str, limit: int) -> Column:
    """From the first sentence that matches (folded), the next and the one before in turn while they fit."""

    def window(s: Column) -> Column:
        sents, sizes, first = s["sents"], s["sizes"], s["first"]
        n, size = F.size(sizes), lambda k: F.coalesce(F.get(sizes, k), F.lit(0))
        start = F.struct(first.alias("lo"), first.alias("hi"), size(first).alias("size"))

        def grow(a, _):
            up = (a["hi"] + 1 < n) & (a["size"] + 1 + size(a["hi"] + 1) <= limit)
            hi, with_up = F.when(up, a["hi"] + 1).otherwise(a["hi"]), F.when(up, a["size"] + 1 + size(a["hi"] + 1)).otherwise(a["size"])
            below = size(F.greatest(a["lo"] - 1, F.lit(0)))
            down = (a["lo"] > 0) & (with_up + 1 + below <= limit)
            return F.struct(F.when(down, a["lo"] - 1).otherwise(a["lo"]).alias("lo"), hi.alias("hi"), F.when(down, with_up + 1 + below).otherwise(with_up).alias("size"))

        # each turn adds a sentence or is the last that does, so turns past the limit's characters change nothing
        joined = F.aggregate(F.slice(sizes, 1, limit), start, grow, lambda a: F.array_join(F.slice(sents, a["lo"] + 1, a["hi"] - a["lo"] + 1), " "))
        return F.when(n > 0, joined)

    def cut(joined: Column) -> Column:
        short = F.concat(F.rtrim(F.regexp_replace(F.substring(joined, 1, limit), " [^ ]*$", "")), F.lit("…"))
        return F.when(F.length(joined) > limit, short).otherwise(joined)

    def facts(sents: Column) -> Column:
        at = F.filter(F.transform(sents, lambda s, k: F.when(fold(s).rlike(rx), k)), lambda k: k.isNotNull())
        return F.struct(sents.alias("sents"), F.transform(sents, F.length).alias("sizes"), F.coalesce(F.get(at, 0), F.lit(0)).alias("first"))

    made = once(once(F.filter(split_sentences(text), lambda s: s != ""), facts), window)
    return F.coalesce(once(made, cut), F.substring(text, 1, limit))


#: The texts of the two paragraphs before and after.
BESIDE = ("p2", "p1", "n1", "n2")


def neighbours(paras: DataFrame) -> DataFrame:
    """paras (doc_id, pos, text, ...) with p2, p1, n1 and n2, the texts of the two paragraphs before and after; as they are if they have them."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    near = (F.lag("text", 2).over(w), F.lag("text", 1).over(w), F.lead("text", 1).over(w), F.lead("text", 2).over(w))
    return paras if set(BESIDE) <= set(paras.columns) else paras.withColumns(dict(zip(BESIDE, near, strict=True)))


def excerpts(paras: DataFrame, rx: str, limit: int = 700, keep: Column | None = None) -> DataFrame:
    """paras with excerpt: the paragraph, or its sentences around the match if it is over the limit, or, under 120
    characters, with neighbours (the next first) up to three parts. keep: which paragraphs get one and stay (neighbours need
    not match)."""
    base = neighbours(paras)
    base = base if keep is None else base.where(keep)
    add = lambda size, c: size + 1 + F.length(c)
    own = F.length("text")
    fits = lambda size, c: c.isNotNull() & (add(size, c) <= limit)
    p2, p1, n1, n2 = map(F.col, BESIDE)
    up, s1 = fits(own, n1), F.when(fits(own, n1), add(own, n1)).otherwise(own)
    down, s2 = fits(s1, p1), F.when(fits(s1, p1), add(s1, p1)).otherwise(s1)
    # a second turn happens with under three parts: one neighbour was taken, and then it may go on the same way
    up2, down2 = up & ~down & fits(s2, n2), down & ~up & fits(s2, p2)
    near = F.concat_ws(" ", F.when(down2, p2), F.when(down, p1), F.col("text"), F.when(up, n1), F.when(up2, n2))
    made = F.when(own > limit, sentence_window(F.col("text"), rx, limit)).when(own >= 120, F.col("text")).otherwise(near)
    # by a generator, so that filters on the excerpt don't compute it again
    return base.select("*", F.explode(F.array(made)).alias("excerpt")).drop(*BESIDE)


def funding_channels(norm: Column, channels=L.CHANNELS) -> Column:
    """Labels of channels that the folded text names, in their order."""
    return F.array_compact(F.array(*[F.when(has_prefix(norm, *folded(words)), label) for label, words in channels]))


def evidence(paras: DataFrame, variants: DataFrame, keywords: list[str], category: str, channels=None, top: int = 4, least: int = 100, limit: int = 700) -> DataFrame:
    """(entity_id, doc_id, pos, category, keyword, excerpt, channels): the best excerpts of each document and entity.

    With channels, one keyword alone counts only if the paragraph names a channel. Excerpts must name the entity; repeats
    (by fingerprint) in a document fall to the first; then most channels, then longest.
    """
    words = folded(keywords)
    matched = F.array_compact(F.array(*[F.when(has_prefix(F.col("norm"), w), F.lit(k)) for w, k in zip(words, keywords, strict=True)]))
    hit = excerpts(paras, prefix_rx(*words), limit, keep=has_prefix(F.col("norm"), *words)).where(F.length("excerpt") >= least).withColumn("matched", matched)
    hit = hit.withColumn("channels", funding_channels(F.col("norm"), channels) if channels else F.expr("cast(array() as array<string>)"))
    if channels:
        hit = hit.where((F.size("matched") >= 2) | (F.size("channels") > 0))
    told = hit.select("doc_id", "pos", F.get("matched", 0).alias("keyword"), "channels", "excerpt", fold_plain(F.col("excerpt")).alias("norm"))
    # a row that several variants name is one by its fingerprint
    rows = keep_first(named_rows(told, variants).withColumn("fp", fingerprint(F.col("excerpt"))), ["entity_id", "doc_id", "fp"], ["pos"])
    rank = F.row_number().over(Window.partitionBy("entity_id", "doc_id").orderBy(F.size("channels").desc(), F.length("excerpt").desc(), "pos"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= top).select("entity_id", "doc_id", "pos", F.lit(category).alias("category"), "keyword", "excerpt", "channels", "rank")


def mention_excerpts(paras: DataFrame, variants: DataFrame, top: int = 4, limit: int = 900, least: int = 120, rx: str = "$^") -> DataFrame:
    """(entity_id, doc_id, pos, excerpt): the first excerpts of each document that name the entity."""
    named = named_rows(neighbours(paras).select("doc_id", "pos", "text", "norm", *BESIDE), variants)
    rows = excerpts(named, rx, limit).where(F.length("excerpt") >= least).select("entity_id", "doc_id", "pos", "excerpt")
    # a row that several variants name is one by its fingerprint
    rows = rows.withColumn("fp", fingerprint(F.col("excerpt"), 250))
    rows = keep_first(rows, ["entity_id", "doc_id", "fp"], ["pos"])
    rank = F.row_number().over(Window.partitionBy("entity_id", "doc_id").orderBy("pos"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= top).select("entity_id", "doc_id", "pos", "excerpt", "rank")


def age_gate(docs: DataFrame, cutoff_year: int, with_education: DataFrame) -> DataFrame:
    """docs (doc_id, date) with education_only: old ones stay only with education evidence; undated ones aren't old."""
    old = F.coalesce(F.year("date") < cutoff_year, F.lit(False))
    marked = docs.join(with_education.select("doc_id").distinct().withColumn("_has", F.lit(True)), "doc_id", "left")
    return marked.where(~old | F.col("_has").isNotNull()).withColumn("education_only", old).drop("_has")


def speeches(paras: DataFrame, entities: DataFrame, least: int = 150) -> DataFrame:
    """(entity_id, doc_id, turn, speaker, text): turns of transcripts whose speaker is the entity.

    A paragraph "Name Surname: ..." starts a turn; turns are numbered by a running sum over the document. entities:
    (entity_id, surname), folded.
    """
    name = F.regexp_extract("text", L.SPEAKER, 1)
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    turns = paras.withColumn("speaker", F.when(name != "", name)).withColumn("turn", F.sum(F.when(name != "", 1).otherwise(0)).over(w)).where("turn > 0")
    said = F.when(F.col("speaker").isNotNull(), F.regexp_extract("text", L.SPEAKER, 2)).otherwise(F.col("text"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", said.alias("t"))))
    grouped = turns.groupBy("doc_id", "turn").agg(F.max("speaker").alias("speaker"), F.trim(F.array_join(F.filter(F.transform(ordered, lambda x: x["t"]), lambda t: t != ""), "\n")).alias("text"))
    named = grouped.where(F.length("text") >= least).select("*", F.explode(F.array_distinct(F.regexp_extract_all(fold(F.col("speaker")), F.lit(r"(?U)\w+"), F.lit(0)))).alias("surname"))
    return named.join(entities, "surname").select("entity_id", "doc_id", "turn", "speaker", "text")


def role_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, run, role, n_turns, n_chars): neighbouring turns of one role as one, by a running sum of changes."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    changed = F.when(F.col("role") == F.lag("role").over(w), 0).otherwise(1)
    runs = turns.withColumn("new", changed).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("conv_id", "run").agg(F.min("role").alias("role"), F.count("*").alias("n_turns"), F.sum(F.length("text")).alias("n_chars"))


def statements(paras: DataFrame, variants: DataFrame, least: int = 40) -> DataFrame:
    """(entity_id, doc_id, pos, nth, text, context, same_paragraph): quotations with the entity named in the paragraph or a neighbour."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    near = paras.withColumn("around", F.concat_ws(" ", F.lag("norm").over(w), "norm", F.lead("norm").over(w))).where(F.col("text").rlike(L.QUOTE))
    near = near.withColumn("sid", F.concat_ws(":", "doc_id", "pos"))
    around = mentions(near.select("sid", F.col("around").alias("norm")), variants, "sid").select("entity_id", "sid")
    same = mentions(near.select("sid", "norm"), variants, "sid").select("entity_id", "sid", F.lit(True).alias("same"))
    quoted = near.join(around, "sid").join(same, ["entity_id", "sid"], "left").select("entity_id", "doc_id", "pos", F.col("text").alias("context"), F.coalesce("same", F.lit(False)).alias("same_paragraph"), F.posexplode(F.regexp_extract_all("text", F.lit(L.QUOTE), F.lit(1))).alias("nth", "q"))
    quoted = quoted.withColumn("text", squash(F.col("q"))).where(F.length("text") >= least).withColumn("fp", fingerprint(F.col("text"), 400))
    return keep_first(quoted, ["entity_id", "doc_id", "fp"], ["pos", "nth"]).select("entity_id", "doc_id", "pos", "nth", "text", "context", "same_paragraph")


def is_promise(text: Column, keywords: list[str] = L.PROMISE) -> Column:
    return has_prefix(fold(text), *folded(keywords))


def dedupe(rows: DataFrame, column: str, order: list, least: int = 0, n: int = 400) -> DataFrame:
    """The first row of each entity and fingerprint of `column`; shorter fingerprints than `least` go."""
    keyed = rows.withColumn("_fp", fingerprint(F.col(column), n))
    return keep_first(keyed.where(F.length("_fp") >= least), ["entity_id", "_fp"], order).drop("_fp")


def rank_by(rows: DataFrame, *order: Column, top: int | None = None) -> DataFrame:
    """rows with rank, from 1, in each entity. All ranks come from a scan in two levels, so an entity is spread over tasks; for the
    first `top` rows Spark keeps no more than that many of an entity in each part before it shuffles."""
    if top is None:
        return numbered(rows, ["entity_id"], list(order), "rank")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("entity_id").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def analysis_stats(entities: DataFrame, **tables: DataFrame) -> DataFrame:
    """One row for each entity with the number of its rows in each table."""
    out = entities.select("entity_id")
    for name, rows in tables.items():
        out = out.join(rows.groupBy("entity_id").agg(F.count("*").alias(name)), "entity_id", "left")
    return out.na.fill(0)


def opinions(paras: DataFrame, entities: DataFrame, positive: str = L.POSITIVE, negative: str = L.NEGATIVE, top: int = 8) -> DataFrame:
    """(entity_id, doc_id, pos, k, quote, tone): sentences with the entity and words of judgement. entities: (entity_id, surname)."""
    sents = paras.select("doc_id", "pos", F.posexplode(split_sentences_v1(F.col("text"))).alias("k", "quote"))
    sents = sents.withColumn("p", F.regexp_count("quote", F.lit(positive))).withColumn("m", F.regexp_count("quote", F.lit(negative))).where("p + m > 0")
    sents = sents.withColumn("sid", F.concat_ws(":", "doc_id", "pos", "k"))
    named = mentions(sents.select("sid", fold(F.col("quote")).alias("norm")), entities.select("entity_id", F.col("surname").alias("variant")), "sid")
    tone = F.when(F.col("p") > F.col("m"), "positive").when(F.col("m") > F.col("p"), "negative").otherwise("mixed")
    rows = keep_first(sents.join(named, "sid").withColumn("tone", tone), ["entity_id", "doc_id", "quote"], ["pos", "k"])
    rank = F.row_number().over(Window.partitionBy("entity_id", "doc_id").orderBy("pos", "k"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= top).select("entity_id", "doc_id", "pos", "k", "quote", "tone")


def article_tone(found: DataFrame) -> DataFrame:
    """(entity_id, doc_id, tone) by majority of a document's opinions."""
    p, m = F.count_if(F.col("tone") == "positive"), F.count_if(F.col("tone") == "negative")
    return found.groupBy("entity_id", "doc_id").agg(F.when(p > m, "positive").when(m > p, "negative").otherwise("mixed").alias("tone"))


#: Words that say nothing about a topic.
TOPIC_STOP = (
    "declarat afirmat anunțat anuntat promit promis promisiune ministrul președintele presedintele premierul guvernul domnul doamna aceasta "
    "aceste acesta pentru despre fiecare printre foarte trebuie anului mereu după dupa către catre există exista cadrul vorbit"
).split()


def topic_words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-zăâîșțşţ]{6,}"), F.lit(0)), lambda w: ~w.isin(TOPIC_STOP)))


def promises_v1(paras: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity_id, doc_id, pos, k, quote, context, topic): commitments near the entity's name."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    near = paras.withColumn("around", F.concat_ws(" ", F.lag("norm").over(w), "norm", F.lead("norm").over(w))).withColumn("sid", F.concat_ws(":", "doc_id", "pos"))
    named = mentions(near.select("sid", F.col("around").alias("norm")), entities.select("entity_id", F.col("surname").alias("variant")), "sid")
    rows = near.join(named, "sid").withColumn("s", split_sentences_v1(F.col("text"))).select("entity_id", "doc_id", "pos", "text", "s", F.posexplode("s").alias("k", "quote"))
    rows = rows.where(F.col("quote").rlike(L.STRONG) | (F.col("quote").rlike(L.WEAK) & F.col("text").rlike(L.SPEECH)))
    context = F.array_join(F.slice("s", F.greatest(F.col("k"), F.lit(1)), F.when(F.col("k") > 0, 3).otherwise(2)), " ")
    longest = F.slice(F.array_sort(topic_words(F.col("quote")), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0)), 1, 4)
    return rows.select("entity_id", "doc_id", "pos", "k", "quote", context.alias("context"), F.array_join(longest, ", ").alias("topic"))


def topic_stems(text: Column) -> Column:
    return F.array_distinct(F.transform(topic_words(text), lambda w: F.substring(w, 1, 6)))


#: Days of a bucket of dates, and the bucket of undated rows.
BUCKET_DAYS, UNDATED = 90, -(1 << 40)


def _bucket(date: Column) -> Column:
    return F.coalesce(F.floor(F.unix_date(date) / BUCKET_DAYS), F.lit(UNDATED))


def _rare_first(rows: DataFrame, freq: DataFrame, ids: list[str]) -> DataFrame:
    """rows (entity_id, *ids, stem) as (entity_id, *ids, stems): of the stems that freq has, the rarest first."""
    met = rows.join(freq, ["entity_id", "stem"]).groupBy("entity_id", *ids).agg(F.array_sort(F.collect_list(F.struct("f", "stem"))).alias("x"))
    return met.select("entity_id", *ids, F.transform("x", lambda r: r["stem"]).alias("stems"))


def shared_stems(promises: DataFrame, sentences: DataFrame) -> DataFrame:
    """(entity_id, promise_id, sent_id, outcome): pairs that share enough stems, of other documents and not earlier, each once.

    promises: (entity_id, promise_id, p_doc, p_date, need, stems); sentences: (entity_id, sent_id, s_doc, s_date, outcome, stems).
    A pair with `need` stems in common shares one of each side's first n - need + 1, stems being ordered from rare to frequent,
    so only those are keys and frequent stems seldom are. A bucket of the date is part of the key: a sentence stands in its own
    bucket, a promise in all from its own on, so a stem of a large entity is spread over its time.
    """
    said = sentences.select("entity_id", "sent_id", F.explode("stems").alias("stem"))
    freq = said.groupBy("entity_id", "stem").agg(F.count("*").alias("f"))
    s = _rare_first(said, freq, ["sent_id"]).join(sentences.drop("stems"), ["entity_id", "sent_id"])
    s = s.withColumn("bucket", _bucket(F.col("s_date")))
    p = _rare_first(promises.select("entity_id", "promise_id", F.explode("stems").alias("stem")), freq, ["promise_id"]).join(promises.drop("stems"), ["entity_id", "promise_id"])
    times = s.groupBy("entity_id").agg(F.collect_set("bucket").alias("buckets"))
    from_own = F.filter("buckets", lambda b: F.col("p_date").isNull() | (b == UNDATED) | (b >= _bucket(F.col("p_date"))))
    p = p.join(times, "entity_id").withColumn("bucket", F.explode(from_own)).where(F.size("stems") >= F.col("need"))
    p = p.select("entity_id", "bucket", "promise_id", "p_doc", "p_date", "need", F.col("stems").alias("p_stems"), F.explode(F.slice("stems", 1, F.size("stems") - F.col("need") + 1)).alias("stem"))
    s = s.where(F.size("stems") >= 2).select("entity_id", "bucket", "sent_id", "s_doc", "s_date", "outcome", F.col("stems").alias("s_stems"), F.posexplode(F.slice("stems", 1, F.size("stems") - 1)).alias("at", "stem"))
    met = p.join(s, ["entity_id", "stem", "bucket"]).where((F.col("at") <= F.size("s_stems") - F.col("need")) & (F.col("p_doc") != F.col("s_doc")))
    met = met.where("p_date is null or s_date is null or s_date >= p_date")
    # a pair is told by the first stem that both have
    common = F.array_intersect("p_stems", "s_stems")
    return met.where((F.size(common) >= F.col("need")) & (F.get(common, 0) == F.col("stem"))).select("entity_id", "promise_id", "sent_id", "outcome")


def judge_promises(promises: DataFrame, sentences: DataFrame, kept: str = L.KEPT, broken: str = L.BROKEN) -> DataFrame:
    """(entity_id, promise_id, n_kept, n_broken, status) by sentences of other documents that aren't earlier and share enough stems.

    promises: (entity_id, promise_id, doc_id, date, text); sentences: (entity_id, sent_id, doc_id, date, text); one row of each id.
    Enough is 3 stems, 2 for promises with under 6. Sentences without a word of outcome don't take part.
    """
    p = promises.withColumn("stems", topic_stems(F.col("text"))).withColumn("need", F.when(F.size("stems") >= 6, 3).otherwise(2))
    p = p.select("entity_id", "promise_id", F.col("doc_id").alias("p_doc"), F.col("date").alias("p_date"), "need", "stems")
    outcome = F.when(F.col("text").rlike(broken), "broken").when(F.col("text").rlike(kept), "kept")
    s = sentences.withColumn("outcome", outcome).where("outcome is not null").select("entity_id", "sent_id", F.col("doc_id").alias("s_doc"), F.col("date").alias("s_date"), "outcome", topic_stems(F.col("text")).alias("stems"))
    told = shared_stems(p, s).groupBy("entity_id", "promise_id").agg(F.count_if(F.col("outcome") == "kept").alias("n_kept"), F.count_if(F.col("outcome") == "broken").alias("n_broken"))
    out = promises.select("entity_id", "promise_id").join(told, ["entity_id", "promise_id"], "left").na.fill(0)
    return out.withColumn("status", F.when((F.col("n_kept") > 0) & (F.col("n_broken") > 0), "partial").when(F.col("n_kept") > 0, "kept").when(F.col("n_broken") > 0, "broken").otherwise("unverifiable"))


#: What a promise's status is worth in scores; others are worth nothing.
STATUS_VALUES = [("kept", 1.0), ("partial", 0.5), ("broken", 0.0)]


def status_value(status: Column) -> Column:
    """The value of a promise's status for the mean of promises; null where it can't be told."""
    out = F.lit(None).cast("double")
    for name, value in STATUS_VALUES:
        out = F.when(status == name, value).otherwise(out)
    return out


def primary_flag(sources: DataFrame, found_speeches: DataFrame) -> DataFrame:
    """sources (entity_id, doc_id, official) with primary: official, or with a speech of the entity."""
    has = found_speeches.select("entity_id", "doc_id").distinct().withColumn("_s", F.lit(True))
    return sources.join(has, ["entity_id", "doc_id"], "left").withColumn("primary", F.col("official") | F.coalesce("_s", F.lit(False))).drop("_s")


def surname_rx(term: str) -> str:
    return word_rx(fold_literal(term))
