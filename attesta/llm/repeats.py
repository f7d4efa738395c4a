"""Removal of long strings that repeat anywhere in the corpus, with suffix arrays of bounded groups.

Every window of `length` bytes has a key made from its content (anchors.runs), so equal windows meet under one key
wherever they are. Runs of windows whose whole content occurs again (by two hashes of different make, key and content) are
taken at two of their places, and the bytes from there, with those of the runs that follow in both texts, are sorted
together. Of runs that share a key but not their content, the bytes meet in bounded groups: by key, or where a key has many
contents, by the hashes of their windows. Windows whose hash is alone in the group are left out, and the suffix array of the
rest (suffix_sort, linear grouping over phrases) puts equal windows side by side, where they are compared byte for byte. What is found so
of a content holds at all runs that have it; that these have it is told by the two hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.llm.anchors import Hashes, runs
from attesta.llm.common import materialise, small, table, text_bytes
from attesta.llm.suffix_sort import sorted_suffixes

#: Bytes of a string that may not stand anywhere else.
LENGTH = 400
#: Different contents that are sorted together.
GROUP = 500
#: Windows of a stretch that is sorted with its first copy.
STRETCH = 4096
#: Neighbours of a suffix array whose bytes are compared at once.
COMPARED = 250
#: A content that occurs more often is broadcast to its runs.
COMMON = 10_000


def _numbered(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, rid, text): rid tells different texts of one id apart; equal rows share it, and have equal spans."""
    said = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), said).alias("rid"), said.alias("text"))


def _runs(rows: DataFrame, length: int) -> DataFrame:
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                piece = batch.slice(lo, 500)
                number, key, content, first, last = runs(text_bytes(piece.column(2)), length)
                again = pa.array(number)
                columns = [piece.column(0).take(again), piece.column(1).take(again), *(pa.array(x.astype(np.int64)) for x in (key, content)), *(pa.array(x.astype(np.int32)) for x in (first, last))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "rid", "key", "content", "first", "last"])

    return rows.mapInArrow(run, f"id {kind}, rid long, key long, content long, first int, last int")


def repeated_starts(blocks: list[bytes], length: int) -> list[np.ndarray]:
    """For each block, which windows also stand at another start of any block, by a suffix array of the blocks' bytes."""
    counts = [len(b) - length + 1 for b in blocks]
    starts = [np.zeros(max(0, n), bool) for n in counts]
    data = np.frombuffer(b"".join(blocks), np.uint8)
    begin = np.cumsum([0, *map(len, blocks)])[:-1]
    at = np.concatenate([np.arange(b, b + n) for b, n in zip(begin, counts, strict=True)])
    _, inverse, times = np.unique(Hashes(data).of(at, at + length), return_inverse=True, return_counts=True)
    again = times[inverse] > 1
    if not again.any():
        return starts
    split = np.cumsum([0, *counts])
    parts = []
    for k in range(len(blocks)):
        own = np.flatnonzero(again[split[k] : split[k + 1]])
        if len(own):
            parts.append((k, int(own[0]), int(own[-1])))
    pieces = [blocks[k][low : high + length] for k, low, high in parts]
    sizes = np.array([len(x) + 1 for x in pieces])
    lows = np.cumsum(sizes) - sizes
    part = np.repeat(np.arange(len(parts)), sizes)
    spans = np.array([high - low for _, low, high in parts])
    order = sorted_suffixes(pieces)
    order = order[order - lows[part[order]] <= spans[part[order]]]
    windows = sliding_window_view(np.frombuffer(b"\0".join([*pieces, b""]), np.uint8), length)
    marks = np.zeros(len(part), bool)
    for x in range(0, len(order) - 1, COMPARED):
        one, other = order[x : x + COMPARED + 1][:-1], order[x : x + COMPARED + 1][1:]
        equal = (windows[one] == windows[other]).all(axis=1)
        marks[one[equal]] = marks[other[equal]] = True
    for j, (k, low, high) in enumerate(parts):
        starts[k][low : high + 1] = marks[lows[j] : lows[j] + high - low + 1]
    return starts


def _blocks(spots: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    """spots and block: the bytes from a spot's first window to its last. spots: (id, rid, first, last) and other columns.
    Repeated rows give a block several times."""
    others = [c for c in spots.columns if c not in ("id", "rid")]
    wanted = spots.groupBy("rid", "id").agg(F.collect_list(F.struct(*others)).alias("w"))
    met = rows.alias("t").join(wanted.alias("w"), (F.col("t.rid") == F.col("w.rid")) & F.col("t.id").eqNullSafe(F.col("w.id"))).select("t.id", "t.rid", "t.text", "w.w")

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                piece = batch.slice(lo, 200)
                lasts = [[(x["first"], x["last"]) for x in w] for w in piece.column(3).to_pylist()]
                own = [[t[f : e + length] for f, e in w] for t, w in zip(text_bytes(piece.column(2)), lasts, strict=True)]
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), piece.column(3), pa.array(own, pa.list_(pa.binary()))], names=["id", "rid", "w", "blocks"])

    kinds = {c: met.schema[c].dataType.simpleString() for c in ("id", "w")}
    found = met.mapInArrow(cut, f"id {kinds['id']}, rid long, w {kinds['w']}, blocks array<binary>")
    found = found.select("id", "rid", F.explode(F.arrays_zip("w", "blocks")).alias("x"))
    return found.select("id", "rid", "x.w.*", F.col("x.blocks").alias("block"))


def _windows(blocks: DataFrame, length: int) -> DataFrame:
    """(key, content, hash, at) of every window of the blocks."""

    def explode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                piece = batch.slice(lo, 200)
                own = piece.column(2).to_pylist()
                counts = np.array([len(b) - length + 1 for b in own])
                begin = np.cumsum([0, *map(len, own)])[:-1]
                again = np.repeat(np.arange(len(own)), counts)
                at = np.arange(len(again)) - np.repeat(np.cumsum(counts) - counts, counts)
                start = begin[again] + at
                hashes = Hashes(np.frombuffer(b"".join(own), np.uint8)).of(start, start + length).astype(np.int64)
                number = pa.array(again)
                yield pa.RecordBatch.from_arrays([piece.column(0).take(number), piece.column(1).take(number), pa.array(hashes), pa.array(at.astype(np.int32))], names=["key", "content", "hash", "at"])

    return blocks.select("key", "content", "block").mapInArrow(explode, "key long, content long, hash long, at int")


def bounded_groups(mixed: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    """(group, id, rid, first, alone, block): bytes of runs in groups of about `GROUP` different ones, where every window of a
    run that stands in another run of its key meets an equal one.

    A key with few contents is one group. In others the windows are counted by hash, so that no key is gathered in a task;
    each hash that several contents hold has the least of them as its head. A content goes to its heads with the bytes
    its windows under that head cover, and the heads' followers are dealt in parts, to each of which the head goes too.
    """
    sizes = materialise(mixed.groupBy("key").agg((F.count("*") > GROUP).alias("many")), "sizes")
    blocks = materialise(_blocks(mixed.join(sizes, "key"), rows, length), "blocks")
    few = blocks.where("not many").select(F.col("key").alias("group"), "id", "rid", "first", "alone", "block")
    many = blocks.where("many")
    windows = _windows(many, length)
    heads = materialise(windows.groupBy("key", "hash").agg(F.min("content").alias("head"), F.max("content").alias("other")).where("head <> other").drop("other"), "heads")
    led = materialise(windows.join(heads, ["key", "hash"]).groupBy("key", "content", "head").agg(F.min("at").alias("low"), F.max("at").alias("high")), "led")
    parts = materialise(led.where("content <> head").groupBy("key", "head").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts")), "parts")
    dealt = led.join(parts, ["key", "head"]).withColumn("part", F.explode(F.when(F.col("content") == F.col("head"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod("content", "parts").cast("int")))))
    dealt = dealt.select("key", "content", F.xxhash64("key", "head", "part").alias("group"), "low", "high")
    piece = F.substring("block", F.col("low") + 1, F.col("high") - F.col("low") + length).alias("block")
    return few.union(many.join(dealt, ["key", "content"]).select("group", "id", "rid", (F.col("first") + F.col("low")).alias("first"), "alone", piece))


def _repeats_of(groups: DataFrame, length: int) -> DataFrame:
    """(group, id, rid, start, end): repeated bytes of the blocks marked alone, by the suffix array of each group.

    groups: (group, id, rid, first, alone, block), all of a group in one task, so groups must be bounded.
    """
    kind = groups.schema["id"].dataType.simpleString()

    def find(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def spans(own):
            for (i, rid, group, first, alone, _), marks in zip(own, repeated_starts([x[5] for x in own], length), strict=True):
                if alone and marks.any():
                    edge = np.diff(np.concatenate(([0], marks.astype(np.int8), [0])))
                    for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
                        yield group, i, rid, first + int(s), first + int(e) - 1 + length

        own, group, out, id_type = [], None, [], None
        names = ["id", "rid", "group", "first", "alone", "block"]

        def batch_of(rows_out):
            columns = list(zip(*rows_out, strict=True))
            kinds = (pa.int64(), id_type, pa.int64(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=["group", "id", "rid", "start", "end"])

        for batch in batches:
            id_type = batch.column(batch.schema.get_field_index("id")).type
            for x in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names), strict=True):
                if own and x[2] != group:
                    out += spans(own)
                    own = []
                if not own or x[:5] != own[-1][:5]:  # equal rows give a block several times
                    own.append(x)
                group = x[2]
            if len(out) > 5000:
                yield batch_of(out)
                out = []
        if own:
            out += spans(own)
        if out:
            yield batch_of(out)

    dealt = groups.select("group", "id", "rid", "first", "alone", "block").repartition("group").sortWithinPartitions("group", "id", "rid", "first", "alone")
    return dealt.mapInArrow(find, f"group long, id {kind}, rid long, start int, end int")


def _confirmed(twice: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    """(key, content, low, high): which windows of a content, by their distance from its first, repeat by suffix array.

    twice: (key, content, a, b), a and b the first and last runs with that content, as (rid, first, last, id). Contents
    that follow each other in both texts make one stretch, cut at `STRETCH` windows, so a passage is sorted twice (at a and b)
    however often it stands in the corpus, and its neighbouring windows are sorted together.
    """
    spots = twice.select("key", "content", *(F.col(f"{x}.{c}").alias(f"{x}_{c}") for x in "ab" for c in ("id", "rid", "first", "last")))
    pair = ["a_rid", "b_rid", F.col("b_first") - F.col("a_first")]
    ordered = Window.partitionBy(*pair).orderBy("a_first")
    before = F.lag("a_last").over(ordered)
    new = before.isNull() | (before + 1 != F.col("a_first")) | (F.floor(F.lag("a_first").over(ordered) / STRETCH) != F.floor(F.col("a_first") / STRETCH))
    spots = spots.withColumn("new", new.cast("int")).withColumn("stretch", F.sum("new").over(ordered))
    spots = materialise(spots.withColumn("group", F.xxhash64(*pair, "stretch")).drop("new", "stretch"), "twice")
    ends = spots.groupBy("group", "a_rid", "b_rid").agg(*(F.first(f"{x}_id").alias(f"{x}_id") for x in "ab"), *(f(f"{x}_{c}").alias(f"{x}_{c}") for x in "ab" for c, f in (("first", F.min), ("last", F.max))))
    sides = [F.struct(*(F.col(f"{x}_{c}").alias(c) for c in ("id", "rid", "first", "last")), F.lit(x == "a").alias("alone")) for x in "ab"]
    blocks = _blocks(ends.select("group", F.explode(F.array(*sides)).alias("x")).select("group", "x.*"), rows, length)
    found = _repeats_of(blocks, length).withColumnRenamed("rid", "a_rid").drop("id")
    low, high = F.greatest("start", "a_first"), F.least(F.col("end") - length, F.col("a_last"))
    return spots.join(found, ["group", "a_rid"]).where(low <= high).select("key", "content", (low - F.col("a_first")).alias("low"), (high - F.col("a_first")).alias("high"))


def _contents(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of runs: those whose key occurs again, and (key, content, n, mixed, a, b) of their contents that do or that have others
    under their key; a and b are the first and last of a content's n runs. Counted with partial sums, so a common key isn't
    gathered in a task; the counts are materialised before they are joined, since a common key's rows are dealt to several
    tasks only if no aggregate is in the join's stage."""
    keys = found.groupBy("key").agg(F.count("*").alias("total"), (F.min("content") != F.max("content")).alias("mixed")).where("total > 1")
    found = materialise(found.join(materialise(keys.drop("total"), "keys"), "key"), "runs")
    run = F.struct("rid", "first", "last", "id")
    contents = found.groupBy("key", "content").agg(F.count("*").alias("n"), F.first("mixed").alias("mixed"), F.min(run).alias("a"), F.max(run).alias("b"))
    return found, materialise(contents.where("mixed or n > 1"), "contents")


def _everywhere(found: DataFrame, confirmed: DataFrame, length: int) -> DataFrame:
    """(id, rid, start, end) of what is confirmed of a content, at each run with it. confirmed: (key, content, low, high, n)."""
    common, rest = (confirmed.where(f"n {sign} {COMMON}").drop("n") for sign in (">", "<="))
    common = small(common)  # one in COMMON runs at most, and not above the bound of small()
    names = common.select("key", "content").distinct()
    again = found.join(common, ["key", "content"]).unionByName(found.join(names, ["key", "content"], "left_anti").join(rest, ["key", "content"]))
    return again.select("id", "rid", (F.col("first") + F.col("low")).alias("start"), (F.col("first") + F.col("high") + length).alias("end"))


def repeated_spans(rows: DataFrame, length: int) -> DataFrame:
    """(id, rid, spans): bytes of each text covered by strings of `length` bytes that also start elsewhere. rows: (id, rid, text)."""
    found, contents = _contents(materialise(_runs(rows, length), "found"))
    confirmed = _confirmed(contents.where("n > 1").select("key", "content", "a", "b"), rows, length)
    confirmed = materialise(confirmed.join(contents.select("key", "content", "n"), ["key", "content"]), "confirmed")
    mixed = contents.where("mixed").select("a.id", "a.rid", "key", "content", "a.first", "a.last", (F.col("n") == 1).alias("alone"))
    edges = _repeats_of(bounded_groups(mixed, rows, length), length).select("id", "rid", "start", "end")
    spans = _everywhere(found, confirmed, length).union(edges)
    return spans.groupBy("rid", "id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, n_bytes, spans, kept) for each row: what repeats as array<struct<start, end>> of bytes, and the bytes that stay.

    A byte goes if any string of `length` bytes over it also starts anywhere else in the table, the same text included;
    that is judged on the input. Null texts are empty; texts under `length` bytes keep everything; repeated rows
    count as copies of each other. An empty table gives no rows.
    """
    rows = _numbered(docs, id_col, text)
    spans = materialise(repeated_spans(rows, length), "spans").alias("s")
    kind = rows.schema["id"].dataType.simpleString()
    met = rows.alias("t").join(spans, (F.col("t.rid") == F.col("s.rid")) & F.col("t.id").eqNullSafe(F.col("s.id")), "left").select("t.id", "t.text", "s.spans")

    def apply(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                piece = batch.slice(lo, 500)
                sizes, found, kept = [], [], []
                for t, own in zip(text_bytes(piece.column(1)), piece.column(2).to_pylist(), strict=True):
                    own = merged([(x["start"], x["end"]) for x in own or ()])
                    cuts = [0, *(x for span in own for x in span), len(t)]
                    sizes.append(len(t))
                    found.append([{"start": s, "end": e} for s, e in own])
                    kept.append(b"".join(t[cuts[k] : cuts[k + 1]] for k in range(0, len(cuts), 2)))
                span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(sizes, pa.int64()), pa.array(found, span), pa.array(kept, pa.binary())], names=["id", "n_bytes", "spans", "kept"])

    return met.mapInArrow(apply, f"id {kind}, n_bytes long, spans array<struct<start: int, end: int>>, kept binary").withColumnRenamed("id", id_col)


def op6_repeats(spark, sf_dir: str) -> DataFrame:
    """text is what stays; a cut inside a character leaves replacement characters there, the digest is of the bytes."""
    found = remove_repeats(table(spark, sf_dir, "documents"))
    removed = (F.col("n_bytes") - F.length("kept")).cast("long")
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "spans", F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))
