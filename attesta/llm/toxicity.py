"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

The model is fitted on a bounded sample of labelled rows (FIT_ROWS), which is stated here and in the README; scoring
covers every row. L1 leaves few weights, so what is sent to executors is small whatever the corpus is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.llm.common import ascii_words, lean, own_name, table, text_bytes

#: Hash space of features; labelled rows that a fit uses at most; passes over them.
SPACE, FIT_ROWS, PASSES = 1 << 20, 12_000, 4
#: Features that a fit holds in memory at most (four bytes each): whole rows are taken in order until the next one would pass it.
FIT_FEATURES = 64_000_000
ALPHA, BETA, L1, L2 = 0.3, 1.0, 4.0, 0.1
THRESHOLD = 0.3
#: Bias of a model that has seen no row.
NOTHING = -35.0
#: Lengths of stems, in bytes.
STEMS = (4, 5, 6)
#: Feature kinds are told apart by these odd multipliers.
FIRST, SECOND, SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class Hasher:
    """Feature numbers of a text, once each: its words, their stems (first STEMS bytes), pairs of neighbours, and pairs with one word between."""

    def __init__(self, space: int = SPACE, words: int = 300_000):
        self.space, self.known = space, {}
        self.hashes = np.zeros((words, 1 + len(STEMS)), np.uint64)

    def __call__(self, text: bytes) -> np.ndarray:
        import xxhash

        words, known = ascii_words(text), self.known
        fresh = [w for w in set(words) if w not in known]
        if len(known) + len(fresh) > len(self.hashes):
            known.clear()
            fresh = list(set(words))
            if len(fresh) > len(self.hashes):
                self.hashes = np.zeros((2 * len(fresh), 1 + len(STEMS)), np.uint64)
        for w in fresh:
            self.hashes[len(known)] = [xxhash.xxh64_intdigest(w), *(xxhash.xxh64_intdigest(w[:k], seed=k) for k in STEMS)]
            known[w] = len(known)
        h = self.hashes[np.array([known[w] for w in words], np.int64)]
        word = h[:, 0]
        with np.errstate(over="ignore"):
            found = np.concatenate((h.ravel() * FIRST, word[:-1] * FIRST + word[1:] * SECOND, word[:-2] * FIRST + word[2:] * SKIP))
            found ^= found >> np.uint64(31)
        return np.unique((found % np.uint64(self.space)).astype(np.int32))


@dataclass
class Ftrl:
    """Per-coordinate FTRL-proximal (McMahan et al. 2013): z and n for each feature; weights are zero while |z| <= l1."""

    space: int = SPACE
    alpha: float = ALPHA
    beta: float = BETA
    l1: float = L1
    l2: float = L2

    def __post_init__(self):
        self.z, self.n = np.zeros(self.space + 1), np.zeros(self.space + 1)  # the last is the bias, which has no penalty

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == self.space, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, features: np.ndarray, label: int) -> None:
        at = np.append(features, self.space)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g

    def model(self) -> tuple[np.ndarray, np.ndarray, float]:
        at = np.arange(self.space)
        w = self.weights(at)
        used = np.flatnonzero(w)
        return used.astype(np.int32), w[used].astype(np.float32), float(self.weights(np.array([self.space]))[0])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = FIT_ROWS, passes: int = PASSES):
    """(features, weights, bias) learnt from at most `rows` labelled rows, those with the smallest hashes of their ids.

    labels: (id, label); nulls are left out, and an id with several labels counts as 1 if any is 1. The sampled ids
    (bounded by `rows`) are broadcast. Of an id with several rows one is taken, so a repeated id doesn't fill the sample. The
    features meet in one task, which makes the passes; it takes rows in the sample's order as long as they have at most
    FIT_FEATURES features together, so its memory is bounded for texts of any length. Null texts have no features. Without
    labelled rows nothing is learnt: every score is next to 0.
    """
    sample = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label).cast("int").alias("y"))
    sample = sample.orderBy(F.xxhash64(id_col), id_col).limit(rows)
    chosen = docs.select(F.col(id_col), F.col(text).alias("t")).join(F.broadcast(sample), id_col).select(F.xxhash64(id_col).alias("k"), "y", "t")

    def features(batches: Iterator) -> Iterator:
        import pyarrow as pa

        hashed = Hasher()
        for batch in batches:
            found = [hashed(t).tobytes() for t in text_bytes(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["k", "y", "f"])

    def learn(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known, held = [], 0
        for batch in batches:
            for k, y, f in zip(*(batch.column(j).to_pylist() for j in range(3)), strict=True):
                held += len(f) // 4
                if held > FIT_FEATURES:
                    break
                known.append((k, y, f))
        model = Ftrl()
        for p in range(passes):
            for j in np.random.default_rng(p).permutation(len(known)):
                model.learn(np.frombuffer(known[j][2], np.int32), known[j][1])
        used, weights, bias = model.model() if known else (np.zeros(0, np.int32), np.zeros(0, np.float32), NOTHING)
        yield pa.RecordBatch.from_arrays([pa.array([used.tobytes()]), pa.array([weights.tobytes()]), pa.array([bias])], names=["used", "weights", "bias"])

    one = chosen.mapInArrow(lean(features), "k long, y int, f binary").groupBy("k").agg(F.max("y").alias("y"), F.min("f").alias("f"))
    met = one.repartition(1).sortWithinPartitions("k")
    row = met.mapInArrow(lean(learn), "used binary, weights binary, bias double").first()
    if row is None:
        return np.zeros(0, np.int32), np.zeros(0, np.float32), NOTHING
    return np.frombuffer(bytes(row[0]), np.int32), np.frombuffer(bytes(row[1]), np.float32), float(row[2])


def score(docs: DataFrame, model, text: str = "text", to: str = "score") -> DataFrame:
    """docs with a score from 0 to 1 for each row; null and empty texts get the bias alone. A column called `to` is replaced. No shuffle."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = docs.drop(to) if to in docs.columns else docs
    schema = T.StructType([*kept.schema.fields, T.StructField(to, T.DoubleType())])
    names, arrow_names = kept.columns, to_arrow_schema(schema).names
    handle = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        used, weights, bias = handle.value
        dense, hashed = np.zeros(SPACE), Hasher()
        dense[used] = weights
        for batch in batches:
            total = np.array([dense[hashed(t)].sum() for t in text_bytes(batch.column(text))]) + bias
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))], names=arrow_names)

    return kept.mapInArrow(lean(run), schema)


def held_out(id_col: str = "doc_id") -> Column:
    """True for rows that no fit may see."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame):
    return fit(docs, labels.where(~held_out()))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score under the threshold, unchanged; other columns stay, whatever they are called. Null, empty and
    repeated rows are scored like all."""
    to = own_name(docs, "_toxicity")
    return score(docs, train(docs, labels), to=to).where(F.col(to) < threshold).select(*docs.columns)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
