"""Byte-level BPE over Arrow batches, and token counts by section.

The ids are those of the tokenizer file byte_bpe_50k.json, its added tokens included: where a text holds one's string, that is one
id. They are made from the same vocabulary as ranks, which is several times faster; tests/llm holds both against each other.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from attesta.llm.common import table, text_bytes

RANKS = "byte_bpe_50k.tiktoken"
#: Fixed value: the added token of byte_bpe_50k.json.
ADDED = {"<|endoftext|>": 50256}


@lru_cache(maxsize=2)
def encoder(path: str | None = None):
    """The tokenizer and the byte length of each id. path: a file of ranks; by default the public one."""
    import public_tokenizers as P
    import tiktoken

    with open(path or P.path(RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lengths = np.zeros(max([*ranks.values(), *ADDED.values()]) + 1, np.int64)
    for piece, rank in [*ranks.items(), *((x.encode(), i) for x, i in ADDED.items())]:
        lengths[rank] = len(piece)
    return tiktoken.Encoding("byte_bpe", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens=ADDED), lengths


def ids_of(text: bytes, path: str | None = None) -> np.ndarray:
    return np.array(encoder(path)[0].encode(text.decode("utf-8", "replace"), allowed_special="all"), np.uint32) if text else np.zeros(0, np.uint32)


RULES = ("start", "end", "most")


def attribute(ends: np.ndarray, sections: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens for each section, and how many of them cross a boundary.

    ends: where each token ends, in bytes. sections: where each section ends; the last ends with the text.
    start: a token counts for the section of its first byte; end: of its last byte; most: of most of its bytes,
    the earlier section on a tie.
    """
    starts = np.concatenate(([0], ends[:-1]))
    first, last = np.searchsorted(sections, starts, side="right"), np.searchsorted(sections, ends - 1, side="right")
    if rule == "start":
        own = first
    elif rule == "end":
        own = last
    else:
        own = first.copy()
        for k in np.flatnonzero(last > first):
            cuts = np.concatenate(([starts[k]], sections[first[k] : last[k]], [ends[k]]))
            own[k] = first[k] + int(np.argmax(np.diff(cuts)))
    n = len(sections)
    return np.bincount(own, minlength=n), np.bincount(own[last > first], minlength=n)


def count_sections(docs: DataFrame, id_col: str = "doc_id", text: str = "text", separator: str = "\n", rule: str = "start", path: str | None = None) -> DataFrame:
    """(id, section, start_char, n_chars, n_tokens, n_crossing, doc_tokens): tokens of each section of each text.

    A section ends with its separator, so sections cover the text; the whole text is encoded once and token spans are
    joined to sections by their bytes. A null or empty text has one empty section without tokens. Repeated rows are
    counted one by one. No shuffle.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    mark = separator.encode()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        _, lengths = encoder(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                piece = batch.slice(lo, 500)
                out: list[list] = [[] for _ in range(6)]
                repeat = []
                for t in text_bytes(piece.column(1)):
                    parts = t.split(mark)
                    parts = [p + mark for p in parts[:-1]] + ([parts[-1]] if parts[-1] or len(parts) == 1 else [])
                    ids = ids_of(t, path)
                    tokens, crossing = attribute(np.cumsum(lengths[ids]), np.cumsum([len(p) for p in parts]), rule) if len(ids) else (np.zeros(len(parts), int),) * 2
                    chars = np.array([len(p.decode("utf-8", "replace")) for p in parts])
                    repeat.append(len(parts))
                    for column, new in zip(out, (range(len(parts)), np.cumsum(chars) - chars, chars, tokens, crossing, [len(ids)] * len(parts)), strict=True):
                        column.extend(int(x) for x in new)
                ids_again = piece.column(0).take(pa.array(np.repeat(np.arange(piece.num_rows), repeat)))
                yield pa.RecordBatch.from_arrays([ids_again, *(pa.array(x, pa.int64()) for x in out)], names=["id", *NAMES])

    names = ", ".join(f"{n} long" for n in NAMES)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text).toDF("id", "t").mapInArrow(run, f"id {kind}, {names}").withColumnRenamed("id", id_col)


NAMES = ("section", "start_char", "n_chars", "n_tokens", "n_crossing", "doc_tokens")


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_sections(table(spark, sf_dir, "documents"))
