"""Packing of tokenised documents into fixed windows: best-fit decreasing over a segment tree of remaining room."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import lean, materialise, table, text_bytes
from attesta.llm.tokens import ids_of

WINDOW, END_ID = 2048, 1
#: Pieces packed together by one task.
SHARD_PIECES = 20_000


class RoomTree:
    """Segment tree whose leaves are amounts of room left; finds an open window with the least room that is enough."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(self.size)]

    def _change(self, room: int, by: int) -> None:
        k = room + self.size
        while k:
            self.count[k] += by
            k >>= 1

    def add(self, room: int, window: int) -> None:
        self.open[room].append(window)
        self._change(room, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """(room, window) of the tightest open window with room for length, which leaves the tree."""
        k, count = length + self.size, self.count
        while not count[k]:  # up until a right-hand neighbour has windows, then down its left side
            while k & 1:
                k >>= 1
                if k <= 1:
                    return None
            k += 1
        while k < self.size:
            k <<= 1
            if not count[k]:
                k += 1
        room = k - self.size
        window = self.open[room].pop()
        self._change(room, -1)
        return room, window


def best_fit_decreasing(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """(window number, offset in it) of each length; none is over `window`. Equal lengths keep their order."""
    tree, opened = RoomTree(window), 0
    number, offset = [0] * len(lengths), [0] * len(lengths)
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        got = tree.take(lengths[k])
        if got is None:
            got, opened = (window, opened), opened + 1
        number[k], offset[k] = got[1], window - got[0]
        if got[0] > lengths[k]:
            tree.add(got[0] - lengths[k], got[1])
    return number, offset


def pieces(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): every document's ids and end_id, overlong ones cut into full windows and a rest.

    A null or empty text is end_id alone. Repeated rows give pieces of their own. No shuffle.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                piece = batch.slice(lo, 1000)
                rows, repeat = [], []
                for t in text_bytes(piece.column(1)):
                    ids = np.append(ids_of(t, path), np.uint32(end_id)).astype("<u4")
                    own = [(s, min(window, len(ids) - s), zlib.crc32(ids[s : s + window].tobytes()), len(ids)) for s in range(0, len(ids), window)]
                    rows += own
                    repeat.append(len(own))
                again = piece.column(0).take(pa.array(np.repeat(np.arange(piece.num_rows), repeat)))
                yield pa.RecordBatch.from_arrays([again, *(pa.array(list(x), pa.int64()) for x in zip(*rows, strict=True))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text).mapInArrow(lean(run), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def pack(parts: DataFrame, window: int = WINDOW, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """parts with sequence_id and offset. parts is read twice, so give a table.

    Pieces are dealt to shards by a hash of document and start (no key can be hot; repeated rows share a shard), each of
    about shard_pieces, and best-fit decreasing packs each shard by itself. Sequence ids are unique, not dense. An empty
    table gives no rows.
    """
    shards = max(1, -(-parts.count() // shard_pieces))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        number, offset = best_fit_decreasing(pdf["length"].tolist(), window)
        return pdf.assign(sequence_id=(pdf["shard"].to_numpy(np.int64) << 32) + np.array(number, np.int64), offset=np.array(offset, np.int64)).drop(columns="shard")

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema) + ", sequence_id long, offset long"
    dealt = parts.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start"), F.lit(shards)))
    return dealt.repartition(shards, "shard").groupBy("shard").applyInPandas(run, schema)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return pack(materialise(pieces(docs, id_col, text, window), "pieces"), window)


def op5_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
