"""Benchmark decontamination with an FM-index for each shard of documents.

A shard's words are numbered by the benchmark's vocabulary. Only stretches whose neighbouring words also stand side by
side in some benchmark item can hold a window, so only those stretches enter the shard's index (nothing that could match
is left out). The index is the Burrows-Wheeler transform of the stretches behind a wavelet matrix; all windows are
searched backwards at once, occurrences are located through sampled suffix positions, and their spans are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.llm.common import ascii_words, lean, own_name, table, text_bytes

#: Words of a window; an item with fewer words is one window.
WINDOW = 13
#: A document is contaminated if at least one word in this many is hit.
SHARE = 20
#: Suffix positions kept: one in so many.
SAMPLE = 8
#: A shard is indexed once its stretches hold so many words, or its texts so many bytes.
SHARD_WORDS, SHARD_BYTES = 400_000, 24_000_000
#: The benchmark is searched in blocks of at most so many bytes of text, each broadcast by itself.
BLOCK_BYTES = 16_000_000

ADDED = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    ]
)


class WaveletMatrix:
    """rank(c, i): how often symbol c stands among the first i symbols; c and i may be arrays."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.ones, self.zeros = [], []
        level = symbols
        for k in range(self.bits - 1, -1, -1):
            bit = (level >> k) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))))
            self.zeros.append(len(level) - int(self.ones[-1][-1]))
            level = np.concatenate((level[bit == 0], level[bit == 1]))

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        low, high = np.zeros_like(i), i
        for k, ones, zeros in zip(range(self.bits - 1, -1, -1), self.ones, self.zeros, strict=True):
            bit = (c >> k) & 1 == 1
            a, b = ones[low], ones[high]
            low, high = np.where(bit, zeros + a, low - a), np.where(bit, zeros + b, high - b)
        return high - low


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling; the last symbol is the only smallest one."""
    _, rank = np.unique(text, return_inverse=True)
    n, k = len(text), 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - k] = rank[k:] + 1
        order = np.argsort(rank.astype(np.int64) * (n + 1) + second, kind="stable")
        key = (rank.astype(np.int64) * (n + 1) + second)[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
        rank, k = new, 2 * k
        if rank[order[-1]] == n - 1 or k >= n:
            return order


class FMIndex:
    def __init__(self, text: np.ndarray, sigma: int):
        """text: numbers from 1 to sigma - 1."""
        text = np.concatenate((text, [0])).astype(np.int64)
        order = suffix_array(text)
        self.n = len(text)
        self.last = text[order - 1]
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))))
        self.wavelet = WaveletMatrix(self.last, sigma)
        self.sampled = order % SAMPLE == 0
        self.position = np.where(self.sampled, order, -1)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that start with each pattern (rows of equal length), by backward search."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, k]
            low[live] = self.before[c] + self.wavelet.rank(c, low[live])
            high[live] = self.before[c] + self.wavelet.rank(c, high[live])
            live = live[low[live] < high[live]]
            if not len(live):
                break
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, walking back to a sampled one."""
        at, steps = rows.copy(), np.zeros(len(rows), np.int64)
        todo = np.flatnonzero(~self.sampled[at])
        while len(todo):
            c = self.last[at[todo]]
            at[todo] = self.before[c] + self.wavelet.rank(c, at[todo])
            steps[todo] += 1
            todo = todo[~self.sampled[at[todo]]]
        return self.position[at] + steps


class Phrases:
    """The windows of a block of benchmark items, as numbers."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], set[str]] = {}
        pairs = set()
        for item, text in items:
            words = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in ascii_words(text)]
            pairs.update(zip(words, words[1:], strict=False))
            for k in range(max(1, len(words) - window + 1) if words else 0):
                windows.setdefault(tuple(words[k : k + window]), set()).add(item)
        self.sigma = len(self.vocabulary) + 2
        self.pairs = np.unique(np.array([a * self.sigma + b for a, b in pairs], np.int64)) if pairs else np.zeros(0, np.int64)
        self.least = min(map(len, windows), default=0)
        names = sorted({x for s in windows.values() for x in s})
        number = {x: k for k, x in enumerate(names)}
        self.items, self.groups = names, []
        for length in sorted({len(w) for w in windows}):
            own = [w for w in windows if len(w) == length]
            of = [sorted(number[x] for x in windows[w]) for w in own]
            self.groups.append((length, np.array(own, np.int64), np.cumsum([0, *map(len, of)]), np.array([x for o in of for x in o], np.int64)))

    def stretches(self, ids: np.ndarray) -> np.ndarray:
        """True where a word can be part of a window: it stands in a run, of enough words, of pairs that items have."""
        if self.least <= 1:
            return ids > 0
        both = np.flatnonzero((ids[1:] > 0) & (ids[:-1] > 0))
        joined = np.zeros(len(ids) + 1, np.int8)
        if len(both):
            key = ids[both] * self.sigma + ids[both + 1]
            at = np.searchsorted(self.pairs, key)
            at[at == len(self.pairs)] = 0
            joined[both + 1] = self.pairs[at] == key  # the word at both + 1 goes on the run
        edge = np.diff(np.concatenate(([0], joined)))
        start, end = np.flatnonzero(edge == 1) - 1, np.flatnonzero(edge == -1)  # words start .. end - 1
        long = end - start >= self.least
        mark = np.zeros(len(ids) + 1, np.int32)
        np.add.at(mark, start[long], 1)
        np.add.at(mark, end[long], -1)
        return np.cumsum(mark)[:-1] > 0


def hits(phrases: Phrases, shard: list[np.ndarray]) -> list[tuple[int, list[str], list[tuple[int, int]]]]:
    """For each document of a shard (its words' numbers, 0 for words no item has): hit words, items, merged spans."""
    none = [(0, [], []) for _ in shard]
    if not phrases.groups or not shard:
        return none
    sizes = np.array([len(x) + 1 for x in shard])
    ids = np.zeros(int(sizes.sum()), np.int64)  # a 0 ends every document
    begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    for b, x in zip(begin, shard, strict=True):
        ids[b : b + len(x)] = x
    kept = phrases.stretches(ids)
    place = np.flatnonzero(kept)
    if not len(place):
        return none
    # a stretch's words stand together; between stretches stands a number that no window has
    cut = np.flatnonzero(np.diff(place) > 1) + 1
    text = np.insert(ids[place], cut, phrases.sigma - 1)
    where = np.insert(place, cut, -1)
    index = FMIndex(text, phrases.sigma)
    cover, found = np.zeros(len(ids) + 1, np.int32), []
    for length, patterns, offsets, items in phrases.groups:
        low, high = index.search(patterns)
        count = high - low
        own = np.repeat(np.arange(len(patterns)), count)
        rows = np.repeat(low, count) + np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
        if not len(rows):
            continue
        at = where[index.locate(rows)]
        np.add.at(cover, at, 1)
        np.add.at(cover, at + length, -1)
        doc = np.searchsorted(begin, at, side="right") - 1
        pair = np.unique(doc * len(patterns) + own)
        doc, own = pair // len(patterns), pair % len(patterns)
        many = offsets[own + 1] - offsets[own]
        inner = np.repeat(offsets[own], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        found.append(np.repeat(doc, many) * len(phrases.items) + items[inner])
    edge = np.diff(np.concatenate(([0], (np.cumsum(cover) > 0).astype(np.int8))))
    out = none
    if found:
        for x in np.unique(np.concatenate(found)):
            out[x // len(phrases.items)][1].append(phrases.items[x % len(phrases.items)])
        for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
            d = int(np.searchsorted(begin, s, side="right")) - 1
            out[d][2].append((int(s - begin[d]), int(e - begin[d])))
    return [(sum(e - s for s, e in spans), items, spans) for _, items, spans in out]


def _annotator(handle, text: str, names: list[str], schema):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        phrases = handle.value
        get = phrases.vocabulary.get
        waiting, shard, words, size = [], [], 0, 0

        def flush():
            nonlocal waiting, shard, words, size
            result, k = hits(phrases, shard), 0
            for batch in waiting:
                part, own = result[k : k + batch.num_rows], shard[k : k + batch.num_rows]
                k += batch.num_rows
                new = [[len(x) for x in own], [x[0] for x in part], [sorted(x[1]) for x in part], [[{"start": s, "end": e} for s, e in x[2]] for x in part]]
                arrays = [batch.column(n) for n in names] + [pa.array(x, schema.field(len(names) + j).type) for j, x in enumerate(new)]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)
            waiting, shard, words, size = [], [], 0, 0

        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                piece = batch.slice(lo, 500)
                for t in text_bytes(piece.column(text)):
                    own = np.array([get(w, 0) for w in ascii_words(t)], np.int64).astype(np.int32)
                    shard.append(own)
                    words += len(own)
                    size += len(t)
                waiting.append(piece)
                if words >= SHARD_WORDS or size >= SHARD_BYTES:
                    yield from flush()
        if waiting:
            yield from flush()

    return run


def _blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[str, bytes]]]:
    """Items in blocks of bounded size; at least one block."""
    block, size, any_block = [], 0, False
    for row in benchmark.select(F.col(item).cast("string"), F.col(text).cast("binary")).toLocalIterator():
        if row[1] is None or row[0] is None:
            continue
        block.append((row[0], bytes(row[1])))
        size += len(row[1])
        if size >= BLOCK_BYTES:
            yield block
            block, size, any_block = [], 0, True
    if block or not any_block:
        yield block


def annotate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with n_words, n_hit, items (sorted as strings) and spans (of words hit) for each row.

    Null or empty texts have no words; null items or item texts give no windows; an empty benchmark hits nothing.
    Repeated rows are judged one by one. Columns of docs called like an added one are replaced. No shuffle: the
    benchmark goes out in blocks of at most BLOCK_BYTES of text; with several blocks each row passes all of them in turn
    and spans are united row by row.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = docs.drop(*ADDED.names) if set(ADDED.names) & set(docs.columns) else docs
    out = None
    for block in _blocks(benchmark, item, item_text):
        handle = docs.sparkSession.sparkContext.broadcast(Phrases(block, window))
        before = kept if out is None else out.withColumnsRenamed({n: f"_{n}" for n in ADDED.names})
        schema = T.StructType([*before.schema.fields, *ADDED.fields])
        arrow = to_arrow_schema(schema)
        now = before.mapInArrow(lean(_annotator(handle, text, before.columns, arrow)), schema)
        if out is not None:
            now = _unite(now, kept.columns)
        out = now
    return out


def _unite(df: DataFrame, columns: list[str]) -> DataFrame:
    """Items and spans of two blocks as one: spans sorted and merged by a fold."""
    spans = F.aggregate(
        F.array_sort(F.concat("_spans", "spans")),
        F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["start"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end")))),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    df = df.withColumn("spans", spans).withColumn("items", F.array_sort(F.array_union("_items", "items")))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return df.withColumn("n_hit", hit).select(*columns, *ADDED.names)


def contaminated(share: int = SHARE):
    """True where at least one word, and at least one in `share`, is hit."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that aren't contaminated, unchanged; other columns stay, whatever they are called."""
    other = {c: own_name(docs, f"_kept_{c}") for c in docs.columns if c.lower() in ADDED.names}
    found = annotate(docs.withColumnsRenamed(other), benchmark, text).where(~contaminated())
    return found.select(*[F.col(other.get(c, c)).alias(c) for c in docs.columns])


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = annotate(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
        "spans",
    )
