"""The corpus operators against plain versions, on small tables with nulls, empty and long texts, ties and repeated rows."""

from __future__ import annotations

import hashlib
import random
import unicodedata
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from attesta.llm import chat, decontaminate, ngram_join, packing, pii, repeats, simhash, tokens, toxicity, urls
from attesta.llm.suffix_sort import sorted_suffixes, suffix_array
from tests.llm import plain

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def words(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi pi rho sigma tau".split()) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    base = [words(rng, n) for n in (6, 40, 90, 300, 1500)]
    out = [*base, base[2], base[2].upper()]
    for k in range(40):  # near copies of one text, more or fewer words changed
        w = base[3].split()
        for _ in range(k % 14):
            w[rng.randrange(len(w))] = f"new{rng.randrange(1000)}"
        out.append(" ".join(w))
    out += [base[1] + " " + words(rng, 200), None, "", "  \n", "one two three", "one  TWO three", "x" * 5000, "é" * 900, base[4] + " end"]
    return list(enumerate(out))


def test_ngram_join(spark, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.classes(make(spark, rows)).collect()}
    assert got == plain.jaccard_classes(rows)
    kept = {r.doc_id for r in ngram_join.keep_one(make(spark, rows)).collect()}
    assert kept == {i for i, (_, c) in got.items() if i == c}


def test_one_row_of_each_class_stays(spark):
    text = "one two three four five six"
    rows = [(3, text), (3, text), (3, "other words that stand here alone"), (4, text.upper()), (None, text), (None, "no id but words of its own"), (7, None), (7, None)]
    docs = make(spark, rows).withColumn("_tag", F.lit("clash"))
    got = sorted(((r.doc_id, r.text) for r in ngram_join.keep_one(docs.drop("_tag")).collect()), key=str)
    assert got == sorted([(3, text), (3, rows[2][1]), (None, rows[5][1]), (7, None), (7, None)], key=str)
    found = {(r.doc_id, r.n_shingles): r.component_id for r in ngram_join.classes(docs).collect()}
    assert found == {(3, 2): 3, (4, 2): 3, (None, 2): 3, (None, 3): None, (7, 0): 7}


def test_ngram_join_passes_over_common_keys(spark, rows, monkeypatch):
    monkeypatch.setattr(ngram_join, "COMMON", 3)
    monkeypatch.setattr(ngram_join, "CHUNK", 5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.classes(make(spark, rows)).collect()}
    assert got == plain.jaccard_classes(rows)


def test_empty_tables(spark):
    none = make(spark, [])
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert ngram_join.classes(none).count() == 0
    assert repeats.remove_repeats(none).count() == 0
    assert packing.pack_documents(none).count() == 0
    assert tokens.count_sections(none).count() == 0
    assert simhash.edited_pairs(none).count() == 0
    assert decontaminate.annotate(none, bench).count() == 0
    assert pii.pseudonymise(none, "k").count() == 0
    assert toxicity.score(none, toxicity.train(none, labels)).count() == 0


def test_decontamination(spark, rows):
    rng = random.Random(5)
    items = [(k, words(rng, n)) for k, n in enumerate((13, 20, 5, 1, 40))] + [(9, None), (10, "?!")]
    docs = rows + [(100 + k, f"{words(rng, 30)} {t} {words(rng, 5)}") for k, (_, t) in enumerate(items[:5])] + [(200, items[1][1][:90]), (201, (items[0][1] + " . ") * 3)]
    df = make(spark, docs).withColumn("items", F.lit("clash"))
    found = decontaminate.annotate(df, spark.createDataFrame(items, "item_id long, text string"))
    found = found.select("doc_id", "n_words", "n_hit", F.size("items").alias("n"), F.sha2(F.array_join("items", ","), 256).alias("sha"), decontaminate.contaminated().alias("c"))
    assert {r[0]: tuple(r)[1:] for r in found.collect()} == plain.contamination(docs, items)


def test_decontamination_in_blocks(spark, rows, monkeypatch):
    rng = random.Random(5)
    items = [(k, words(rng, n)) for k, n in enumerate((13, 20, 15))]
    docs = rows[:10] + [(100, " ".join(t for _, t in items))]
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 50)
    found = decontaminate.annotate(make(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    found = found.select("doc_id", "n_words", "n_hit", F.size("items").alias("n"), F.sha2(F.array_join("items", ","), 256).alias("sha"), decontaminate.contaminated().alias("c"))
    assert {r[0]: tuple(r)[1:] for r in found.collect()} == plain.contamination(docs, items)


def test_packing(spark, rows):
    rows = rows + [(500, "<|endoftext|> in a text"), (501, "word " * 6000)]
    want = {i: plain.tokens(t) + [1] for i, t in rows}
    seqs, seen = defaultdict(list), defaultdict(list)
    for r in packing.pack_documents(make(spark, rows)).collect():
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert plain.crc(ids) == r.ids_crc32 and r.doc_tokens == len(want[r.doc_id])
        seqs[r.sequence_id].append((r.offset, r.length))
        seen[r.doc_id] += range(r.start, r.start + r.length)
    assert {i: sorted(x) for i, x in seen.items()} == {i: list(range(len(x))) for i, x in want.items()}
    for own in seqs.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048


def test_room_tree_is_tightest():
    rng = random.Random(1)
    tree, rooms = packing.RoomTree(64), []
    for k in range(500):
        if rng.random() < 0.6:
            rooms.append(rng.randint(1, 63))
            tree.add(rooms[-1], k)
        else:
            n = rng.randint(1, 63)
            got = tree.take(n)
            fit = [r for r in rooms if r >= n]
            assert (got and got[0]) == (min(fit) if fit else None)
            if fit:
                rooms.remove(min(fit))


def test_token_counts(spark):
    text = "Ça va\nbien là\n\nfin"
    rows = [(1, text), (2, None), (3, "")]
    got = defaultdict(list)
    for r in tokens.count_sections(make(spark, rows)).orderBy("doc_id", "section").collect():
        got[r.doc_id].append((r.start_char, r.n_chars, r.n_tokens))
    assert [x[:2] for x in got[1]] == [(0, 6), (6, 8), (14, 1), (15, 3)]
    assert sum(x[2] for x in got[1]) == len(plain.tokens(text))
    assert got[2] == got[3] == [(0, 0, 0)]
    import numpy as np

    ends, sections = np.array([2, 5, 9]), np.array([3, 6, 9])
    assert tokens.attribute(ends, sections, "start")[0].tolist() == [2, 1, 0]
    assert tokens.attribute(ends, sections, "end")[0].tolist() == [1, 1, 1]
    assert tokens.attribute(ends, sections, "most")[0].tolist() == [1, 1, 1]


def test_added_tokens_have_their_ids(spark):
    text = "hi <|endoftext|> there<|endoftext|>"
    assert tokens.ids_of(text.encode()).tolist() == plain.tokens(text) and plain.tokens("<|endoftext|>") == [50256]
    rows = tokens.count_sections(make(spark, [(1, text)])).collect()
    assert [(r.n_chars, r.n_tokens) for r in rows] == [(len(text), len(plain.tokens(text)))]


def test_workers_give_memory_back(spark):
    """A worker that serves a small task after a large one holds little of what the large one held."""
    from attesta.llm.common import lean

    def held(batches):
        import pyarrow as pa

        for batch in batches:
            rest = [bytes(2000) for _ in range(100_000)]
            pinned = rest[::1000]  # what stays lies between what goes
            del rest
            held.pinned = pinned
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["id"])

    def anonymous():
        return next(int(x.split()[1]) for x in open("/proc/self/status") if x.startswith("RssAnon")) / 1024

    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1])], names=["id"])
    before = anonymous()
    assert len(list(lean(held)([batch]))) == 1
    assert anonymous() - before < 60  # of 200 MB


def test_suffix_array():
    rng = random.Random(2)
    for _ in range(500):
        s = [rng.randint(1, rng.choice([1, 2, 4])) for _ in range(rng.randint(1, 50))]
        s = s + s[: rng.randint(0, 10)]
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_suffixes_through_phrases():
    rng = random.Random(4)
    texts = [b"", b"a", b"ab" * 3000, b"\0" * 40, bytes(range(256)) * 3, words(rng, 300).encode()]
    for k in range(120):
        pieces = [b"".join(rng.choice(texts[4:] if k % 2 else [b"x", b"yz", b"\xff\0"])[:90] for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 4))]
        pieces = [*pieces, pieces[0][5:]] if k % 3 else texts[: k % 4 + 1] if k % 9 == 0 else pieces
        lows = [sum(len(x) + 1 for x in pieces[:j]) for j in range(len(pieces))]
        keys = {low + i: ([*(b + len(pieces) for b in x[i:]), j]) for j, (low, x) in enumerate(zip(lows, pieces, strict=True)) for i in range(len(x))} if sum(map(len, pieces)) < 3000 else None
        got = sorted_suffixes(pieces).tolist()
        assert len(got) == sum(map(len, pieces)) and (keys is None or got == sorted(keys, key=keys.get))


def test_long_copies_pass_few_symbols_to_the_grouping(monkeypatch):
    """The interpreted grouping sorts phrases, not bytes; what repeats is found all the same."""
    from attesta.llm import suffix_sort

    rng, seen, grouped = random.Random(6), [], suffix_sort.suffix_array
    monkeypatch.setattr(suffix_sort, "suffix_array", lambda text: seen.append(len(text)) or grouped(text))
    passage = words(rng, 500).encode()
    blocks = [b"one " + passage + b" end", b"another " + passage[:1500] + b"!" + passage[1500:]]
    got = repeats.repeated_starts(blocks, 400)
    every = [b[k : k + 400] for b in blocks for k in range(len(b) - 399)]
    assert [x for own in got for x in own.tolist()] == [every.count(x) > 1 for x in every]
    assert sum(seen) * 8 < sum(map(len, blocks))


def test_repeats(spark, rows):
    docs = [r for r in rows if r[1] is None or len(r[1]) < 4000] + [(900, "ab" * 300), (901, "z" * 399), (902, "z" * 400), (903, "y" * 401)]
    got = repeats.remove_repeats(make(spark, docs)).collect()
    got = {r.doc_id: (r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got}
    assert got == plain.repeats(docs, 400)


def test_repeats_of_a_common_passage_meet_in_bounded_groups(spark, monkeypatch):
    rng = random.Random(8)
    foot = words(rng, 130)
    docs = [(k, f"{words(rng, 30)} {k} {foot[: 700 - 3 * (k % 5)]}{k % 7} {words(rng, 70)}") for k in range(90)]
    docs += [(200, docs[3][1]), (201, foot), (202, None)]
    monkeypatch.setattr(repeats, "GROUP", 5)
    monkeypatch.setattr(repeats, "COMMON", 30)
    sizes, bounded = [], repeats.bounded_groups

    def watched(*given):
        out = bounded(*given)
        sizes.extend(r["count"] for r in out.groupBy("group").count().collect())
        return out

    monkeypatch.setattr(repeats, "bounded_groups", watched)
    got = repeats.remove_repeats(make(spark, docs)).collect()
    got = {r.doc_id: (r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got}
    assert got == plain.repeats(docs, 400)
    assert len(sizes) > 10 and max(sizes) <= 20


def test_fingerprints(spark, rows):
    texts = {i: t or "" for i, t in rows}
    ids = sorted(texts)
    got = {r.doc_id: r for r in simhash.edited_pairs(make(spark, rows), buckets=5).collect()}
    for k, i in enumerate(ids):
        own, other = texts[i], texts[ids[(k + 1) % len(ids)]]
        half = len(own) // 2
        edited = own[: len(own) - half] + other[:half]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].n_chars == len(own)
        assert got[i].next_fp == got[ids[(k + 1) % len(ids)]].fp
    assert got[2].fp == got[5].fp


def test_search_finds_all_within_radius(spark):
    rng = random.Random(4)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    some = [rng.getrandbits(64) for _ in range(30)]
    some += [x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for x in some]
    fps = spark.createDataFrame([(signed(x),) for x in some], "fp long")
    got = {(r.query, r.fp) for r in simhash.search(fps, fps).collect()}
    assert got == {(signed(a), signed(b)) for a in set(some) for b in set(some) if bin(a ^ b).count("1") <= 3}


def test_pii(spark):
    text = "Mail ana.pop@mail.example.com or ana.pop@mail.example.com, +1 (312) 555-0199, 10.20.30.40; card 4532 0151 1283 0366. Mrs Ana Popa, Frau Popa. password=abcd1234ef No. 2.0"
    rows = [(1, text), (2, None), (3, ""), (4, "nothing here 123")]
    got = {r.doc_id: r for r in pii.pseudonymise(make(spark, rows), "k", counts=True).collect()}
    new = got[1].text
    assert got[2].text is None and got[3].text == "" and got[4].text == "nothing here 123"
    for secret in ("ana.pop@mail", "555-0199", "10.20.30.40", "4532 0151", "Popa", "abcd1234ef"):
        assert secret not in new
    mails = [w.strip(",") for w in new.split() if "@" in w]
    assert len(mails) == 2 and mails[0] == mails[1] and mails[0].endswith(".com")
    assert new.endswith("No. 2.0") and "Mrs " in new
    after = new.split("Mrs ")[1].split(",")[0].split()
    assert after[0].endswith("a") and after[1] in new.split("Frau ")[1]
    card = [int(c) for c in new.split("card ")[1][:19] if c.isdigit()]
    assert len(card) == 16 and sum(sum(divmod(d * 2, 10)) if k % 2 == 0 else d for k, d in enumerate(card)) % 10 == 0
    assert (got[1].n_email, got[1].n_phone, got[1].n_ip, got[1].n_card, got[1].n_name, got[1].n_secret) == (2, 1, 1, 1, 2, 1)


def test_surrogates_stay_distinct(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("a"), F.lpad(F.col("id").cast("string"), 4, "0"), F.lit("@x.org 10.1."), (F.col("id") % 200).cast("string"), F.lit(".7")).alias("text"))
    assert pii.collisions(pii.dictionary(df, "k")).isEmpty()
    assert pii.settled(pii.dictionary(df, "k"), "k") is None


def test_written_forms_have_surrogates_of_their_own(spark):
    some = ("00", "0", "01", "1", "07", "7", "255")
    ips = [f"{a}.{b}.{c}.4" for a in some for b in some for c in some]
    names = [f"Mrs {a.upper()}{b}{c}{d}" for a in "bcdfgh" for b in "aeiou" for c in "bcdfghjklmnpqrst" for d in "aeiou"]
    names += [f"Mrs {a.upper()}{b}" for a in "bcdfgh" for b in "aeiou"]
    secrets = [f"token={a}{k:05d}" for a in "afgz" for k in range(300)]
    df = make(spark, list(enumerate([f"at {x} now" for x in (*ips, *names, *secrets)])))
    found = pii.dictionary(df, "k").persist()
    assert {r.kind: r["count"] for r in found.groupBy("kind").count().collect()} == {"ip": len(ips), "name": len(names), "secret": len(secrets)}
    assert pii.collisions(found).isEmpty()
    made = {r.value: r.surrogate for r in found.collect()}
    assert all(made[x].endswith("a") == x.endswith("a") for x in names if len(x) > 6)
    assert all([len(p) > 1 and p[0] == "0" for p in made[x].split(".")] == [len(p) > 1 and p[0] == "0" for p in x.split(".")] for x in ips)
    assert all((made[x][6] in "0123456789abcdef") == (x[6] in "af") for x in secrets)


def test_names_keep_their_coreference(spark):
    text = "Mrs Anna Maria Garcia met Mr Garcia and Dr. Jean-Luc van der Berg. Anna said that Garcia's plan of McGarcia was Berg's; Annab too. Prof O'Neil, o'neil."
    new = pii.pseudonymise(make(spark, [(1, text)]), "k").first().text
    assert not {"Anna", "Maria", "Garcia", "Berg", "Jean", "Neil"} & set(new.replace("'", " ").replace(".", " ").replace("-", " ").split())
    full = new.split("Mrs ")[1].split(" met Mr ")[0].split()
    assert len(full) == 3 and all(w[0].isupper() and w.endswith("a") for w in full)
    assert f"met Mr {full[2]} and" in new and f"{full[0]} said that {full[2]}'s plan of McGarcia" in new and "Annab too" in new
    berg = new.split(" van der ")[1].split(".")[0]
    assert f"was {berg}'s" in new and new.endswith(", o'neil.") and "Dr. " in new


def mod97(iban):
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def test_more_kinds(spark):
    rows = {
        "iban": "DE89 3704 0044 0532 0130 00", "iban_": "GB82WEST12345698765432", "bad": "GB81WEST12345698765432", "ip6": "2001:0db8:85a3:0000:0000:8a2e:0370:7334", "short6": "fe80::1ff:fe23:4567:890a",
        "national": "0171 234 5678", "dotted": "312.555.0199", "date": "on 01-02-2020 12 of", "version": "1.2.3", "code": "std::be", "mark": "a\u0001b x@y.org \u0001", "time": "12:30:45",
    }
    docs = make(spark, list(enumerate(rows.values()))).withColumn("_pieces", F.lit("clash")).withColumn("n_ip6", F.lit("old"))
    done = pii.pseudonymise(docs, "k", counts=True)
    got = {k: r for k, r in zip(rows, sorted(done.collect(), key=lambda r: r.doc_id), strict=True)}
    new = {k: r.text for k, r in got.items()}
    assert all(new[k] == rows[k] for k in ("date", "version", "code", "time"))
    assert all(new[k] != rows[k] and len(new[k]) == len(rows[k]) for k in rows if k not in ("date", "version", "code", "time"))
    assert mod97(new["iban"].replace(" ", "")) == mod97(new["iban_"]) == 1 != mod97(new["bad"]) and [len(x) for x in new["iban"].split(" ")] == [4, 4, 4, 4, 4, 2]
    assert new["national"][0] == "0" and new["mark"].startswith("a\u0001b ") and new["mark"].endswith(".org \u0001")
    assert got["ip6"].n_ip6 == got["short6"].n_ip6 == 1 and got["date"].n_ip6 == 0 and got["date"]["_pieces"] == "clash"
    assert {r.doc_id: r.text for r in pii.pseudonymise(docs, "other").collect()}[0] != new["iban"]


def test_no_name_is_its_own_surrogate(spark):
    names = "Bo Ça Ñuñ Şaş Հայ გი Ðỗ Ștefan Ana Li Al Ed Jo Íó Åse Łuk Žan Ωμ Яна אבי علي राम 王 김 ทอง Ngô".split()
    df = spark.createDataFrame([(n,) for n in names], "n string")
    for key in ("a", "b"):
        for r in df.select("n", pii.name_word(F.col("n"), key).alias("s"), pii.permuted(F.lit("7"), key).alias("d")).collect():
            assert r.n.lower() != r.s.lower() and len(r.n) == len(r.s) and r.d != "7"
            assert [c.isupper() for c in r.n] == [c.isupper() for c in r.s]
            script = lambda x: {unicodedata.name(c).split()[0] for c in x}
            assert script(r.n) == script(r.s)


def test_romanian_titles(spark):
    text = "Domnul Ionescu a venit. doamna Pop si D-l Dan; Ionescu pleaca, doamnei Iacob i-a spus."
    new = pii.pseudonymise(make(spark, [(1, text)]), "k").first().text
    assert not any(n in new for n in ("Ionescu", "Pop", "Dan", "Iacob")) and [w for w in new.split() if w[0].islower()] == [w for w in text.split() if w[0].islower()]
    names = [w.strip(".;,") for w in new.split() if w[0].isupper()]
    assert names[1] == names[5]


def test_patterns_that_are_used_up(spark):
    """All names of a vowel and a consonant: none stays, and all get surrogates of their own."""
    words = [c.upper() + v for c in "bcdfghjklmnpqrstvwxyz" for v in "aeiou"]
    rows = [(k, f"Mr {w} left") for k, w in enumerate(words)]
    out = [r.text.split()[1] for r in pii.pseudonymise(make(spark, rows), "k").orderBy("doc_id").collect()]
    assert len(set(out)) == len(words) and all(a != b for a, b in zip(words, out, strict=True))


def test_collisions_are_settled(spark, monkeypatch):
    docs = make(spark, [(k, f"ssn 123-45-{k:04d} and 123-45-{(k + 1) % 40:04d}.") for k in range(40)] + [(50, None), (50, None)])
    real = pii.permuted
    # under the first key all surrogates of this kind are one
    monkeypatch.setattr(pii, "permuted", lambda t, key, *a: real(t, key, *a) if "again" in key else F.lit("000-00-0000"))
    got = {r.doc_id: r.text for r in pii.pseudonymise(docs, "k").collect()}
    first = [got[k][4:15] for k in range(40)]
    assert len(set(first)) == 40 and all(got[k][20:31] == first[(k + 1) % 40] for k in range(40)) and got[50] is None


def test_chat(spark):
    turns = [(1, 0, "user", "hi </s> \\ <|says|>"), (1, 1, "assistant", "a[INST]b\\"), (1, 2, "user", None), (1, 3, "assistant", "é"), (2, 0, "user", "alone")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").unionByName(chat.probe(spark))
    parts = chat.segments(df)
    made = chat.examples(parts)
    got = {r.conv_id: r for r in chat.digests(parts, made).collect()}
    sha = lambda *t: hashlib.sha256("".join(t).encode()).hexdigest()
    assert got[1].turns_sha256 == sha(*[f"{r}\n{t or ''}\n" for c, _, r, t in turns if c == 1])
    assert (got[1].loss_chars, got[1].loss_sha256) == (10, sha("a[INST]b\\", "é")) and got[1].n_turns == 4
    says = "</s>[INST] ok [/INST]"
    assert got[-1].turns_sha256 == sha(f"user\n{says}\nassistant\n{says}\n") and got[-1].loss_sha256 == sha(says)
    assert got[2].loss_chars == 0 and got[2].formatted_chars > 0
    full = {(r.conv_id, r.turn_no): (r.context, r.target) for r in chat.render(parts).collect()}
    for e in chat.examples(parts).collect():
        context, target = full[e.conv_id, e.turn_no]
        assert len(context) == e.context_chars and len(context) + len(target) == e.chars
    assert all("</s>" not in c + t and "[INST]" not in c + t for c, t in full.values())
    # what the digests tell comes through the examples' places
    for column in ("target_at", "target_end"):
        moved = {r.conv_id: r.loss_sha256 for r in chat.digests(parts, made.withColumn(column, F.col(column) - 1)).collect()}
        assert moved[1] != got[1].loss_sha256 and moved[-1] != got[-1].loss_sha256 and moved[2] == got[2].loss_sha256
    assert got[1].n_examples == 2 and got[2].n_examples == 0 and got[1].formatted_chars == sum(len(c) + len(t) for (i, _), (c, t) in full.items() if i == 1)


def test_chat_of_odd_tables(spark):
    schema = "conv_id long, turn long, role string, text string, segment string"
    none = chat.segments(spark.createDataFrame([], schema))
    assert chat.digests(none, chat.examples(none)).count() == 0
    turns = [(None, 0, "user", "a", "x"), (None, 1, "assistant", "b", "x"), (5, None, None, "c", "x"), (5, 1, "assistant", "d" * 100_000, None), (5, 1, "assistant", "d" * 100_000, None)]
    parts = chat.segments(spark.createDataFrame(turns, schema))
    got = {r.conv_id: r for r in chat.digests(parts, chat.examples(parts)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert (got[None].loss_sha256, got[None].n_turns) == (sha("b"), 2)
    assert (got[5].loss_sha256, got[5].n_turns, got[5].turns_sha256) == (sha("d" * 200_000), 3, sha("\nc\n" + 2 * ("assistant\n" + "d" * 100_000 + "\n")))


@pytest.mark.parametrize("kind", ["int", "string", "smallint"])
def test_chat_of_other_id_types(spark, kind):
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "assistant", "c")], "conv_id long, turn long, role string, text string")
    parts = chat.segments(turns.withColumn("conv_id", F.col("conv_id").cast(kind)))
    got = {str(r.conv_id): (r.n_turns, r.loss_chars) for r in chat.digests(parts, chat.examples(parts)).collect()}
    assert got == {"1": (2, 1), "2": (1, 1)}


def test_urls(spark):
    rows = [(1, "https://A.Example.NET/en/x?q=1"), (2, "https://a.net/x"), (3, "http://example.com/de/1"), (4, "http://x.org/fr/"), (5, "http://x.org/en"), (6, None), (7, "no-scheme.net/"), (8, "http://notexample.com/de/")]
    bad = [("http://spam-farm.org/en/%d" % k, True) for k in range(30)] + [("http://fine%d.org/en/%d" % (k % 5, k), False) for k in range(100)]
    pages = spark.createDataFrame([*rows, (9, "http://spam-farm.org/en/777")], "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, spark.createDataFrame(bad, "url string, bad boolean")).collect()}
    assert got == {
        1: ("a.example.net", "/en/x", "example.net/en/", "allow"), 2: ("a.net", "/x", "net/", "block"), 3: ("example.com", "/de/1", "example.com/de/", "block"),
        4: ("x.org", "/fr/", "org/fr/", "allow"), 5: ("x.org", "/en", None, "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"),
        8: ("notexample.com", "/de/", None, "allow"), 9: ("spam-farm.org", "/en/777", None, "block"),
    }


def plain_rules(labelled, min_rows):
    """Every combination of single tokens of URLs, told bad often enough, that has no shorter part as sure."""
    from itertools import combinations

    def tokens(u):
        host, path = u.split("://", 1)[1].split("/", 1)
        labels = host.split(".")
        return {f"h:{x}" for x in labels} | {"d:" + ".".join(labels[k : k + 2]) for k in range(len(labels) - 1)} | {f"p:{x}" for x in path.split("/") if x}

    rows = [(tokens(u), bad) for u, bad in labelled]
    every = {c for t, bad in rows if bad for n in (1, 2, 3) for c in combinations(sorted(t), n)}
    told = {}
    for c in every:
        own = [bad for t, bad in rows if set(c) <= t]
        if sum(own) >= max(min_rows, 0.002 * len(rows)) and sum(own) / len(own) >= 0.6 and sum(own) / len(own) >= 1.5 * sum(b for _, b in rows) / len(rows):
            told[c] = sum(own) / len(own)
    return lambda u: max((p for c, p in told.items() if set(c) <= tokens(u)), default=None)


def test_url_rules_against_all_combinations(spark):
    rng = random.Random(12)
    some = lambda: f"http://{rng.choice('abc')}.{rng.choice(['com', 'net', 'io'])}/{rng.choice('pqr')}/{rng.choice('xyz')}"
    labelled = [(u, rng.random() < (0.9 if "/p/" in u and "a." in u else 0.7 if ".io" in u else 0.1)) for u in (some() for _ in range(400))]
    sure = plain_rules(labelled, urls.MIN_ROWS)
    pages = sorted({some() for _ in range(200)})
    got = {r.url: round(r.confidence, 9) for r in urls.match(spark.createDataFrame([(u,) for u in pages], "url string"), urls.mine(spark.createDataFrame(labelled, "url string, bad boolean"))).collect()}
    assert got == {u: round(p, 9) for u in pages if (p := sure(u)) is not None} and 0 < len(got) < len(pages)


def test_rules_of_urls_with_many_items_against_all_combinations(spark, monkeypatch):
    """Bases are passed on twice at least; each combination counts in long URLs too."""
    rng = random.Random(31)
    some = lambda n: f"http://{rng.choice('ab')}.io/" + "/".join(rng.sample("pqrstuvw", n))
    labelled = [(u, rng.random() < (0.9 if "p" in u and "q" in u[10:] else 0.8 if "/w" in u and "a." in u else 0.3)) for u in (some(rng.randint(1, 4)) for _ in range(700))]
    pages = sorted({some(rng.randint(1, 5)) for _ in range(300)})
    sure = plain_rules(labelled, 25)
    for most in (2, 3):
        monkeypatch.setattr(urls, "MAX_ITEMS", most)
        rules = urls.mine(spark.createDataFrame(labelled, "url string, bad boolean"), min_rows=25)
        got = {r.url: round(r.confidence, 9) for r in urls.match(spark.createDataFrame([(u,) for u in pages], "url string"), rules).collect()}
        assert got == {u: round(p, 9) for u in pages if (p := sure(u)) is not None} and 0 < len(got) < len(pages)


def test_a_pair_behind_many_more_telling_items(spark):
    """Twelve parts are each more often bad than the two that together always are; long URLs have all of them."""
    rng = random.Random(5)
    decoys = [f"d{k}" for k in range(14)]
    url = lambda *own: "http://x.io/" + "/".join([*rng.sample(decoys, 12), *own])
    rows = [(url("u", "v"), True) for _ in range(12)] + [(url(), True) for _ in range(12)] + [(url(), False) for _ in range(20)]
    rows += [(f"http://x.io/{part}", False) for part in "uv" for _ in range(40)] + [(f"http://x.io/z{k}", False) for k in range(100)]
    rules = {tuple(r.antecedent): (r.confidence, r.support) for r in urls.mine(spark.createDataFrame(rows, "url string, bad boolean")).collect()}
    assert rules[("p:u", "p:v")] == (1.0, 12 / len(rows))
    # every other rule is counted right, too
    for parts, (confidence, _) in rng.sample(sorted(rules.items()), min(50, len(rules))):
        own = [bad for u, bad in rows if all(x[2:] in u.split("/") or x[2:] in u.split("/")[2] for x in parts)]
        assert round(sum(own) / len(own), 9) == round(confidence, 9)


def test_long_urls_give_few_rules(spark):
    long = "http://h.org/" + "/".join(f"part{k}" for k in range(40))
    nested = ["http://n.org/" + "/".join(f"n{j}" for j in range(k)) for k in range(1, 40)]
    rows = [(long, True)] * 30 + [(u, True) for u in nested for _ in range(3)] + [(f"http://good{k}.org/x{k}", False) for k in range(150)] + [(None, True), (long, None)]
    rules = urls.mine(spark.createDataFrame(rows, "url string, bad boolean")).collect()
    assert 0 < len(rules) < 60
    pages = spark.createDataFrame([(1, long), (2, nested[20]), (3, "http://good1.org/x"), (1, long), (4, None)], "page_id long, url string")
    got = sorted((r.page_id, r.verdict) for r in urls.judge(pages.withColumn("verdict", F.lit("clash")), spark.createDataFrame(rows, "url string, bad boolean")).collect())
    assert got == [(1, "block"), (1, "block"), (2, "block"), (3, "allow"), (4, "allow")]
    none = spark.createDataFrame([], "url string, bad boolean")
    assert {r.verdict for r in urls.judge(pages, none).collect()} == {"allow"}
    assert urls.judge(pages.where("false"), none).count() == 0


def test_repeated_ids_do_not_fill_the_fit(spark, monkeypatch):
    docs = make(spark, [(1, "spam spam")] * 500 + [(k, f"fine{k % 3} words here") for k in range(2, 30)] + [(None, "x")])
    marked = spark.createDataFrame([(1, 1, 1), (1, 1, None), *[(k, 1, 0) for k in range(2, 30)], (None, 1, 1)], "doc_id long, quality int, toxic int")
    once = make(spark, [(1, "spam spam")] + [(k, f"fine{k % 3} words here") for k in range(2, 30)])
    model, same = toxicity.fit(docs, marked), toxicity.fit(once, marked)
    assert all((a == b).all() for a, b in zip(model[:2], same[:2], strict=True)) and model[2] == same[2]
    monkeypatch.setattr(toxicity, "FIT_FEATURES", 10)
    assert toxicity.score(docs, toxicity.fit(docs, marked)).count() == docs.count()


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for k in range(600):
        bad = k % 8 == 0
        rows.append((k, words(rng, 60) + (" vileword nasty" + rng.choice("abc") if bad else "")))
        labels.append((k, 1, int(bad)))
    docs, marked = make(spark, [*rows, (900, None)]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    scored = {r.doc_id: (r.s, r.h) for r in toxicity.score(docs, toxicity.train(docs, marked), to="s").withColumn("h", toxicity.held_out()).collect()}
    held = [k for k in range(600) if scored[k][1]]
    assert held and all((scored[k][0] >= 0.3) == (k % 8 == 0) for k in held)
    assert 0 <= scored[900][0] <= 1


def test_pipeline_stages_keep_columns(spark, rows, tmp_path):
    import corpus_pipeline

    make(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "alpha beta")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(0, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= docs.count()
