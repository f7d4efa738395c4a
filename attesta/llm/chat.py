"""Chat formatting: one training example for each assistant turn, with all turns before it as context.

Contexts of one conversation are prefixes of each other, so writing each out makes output grow with the square of the
turns. `segments` writes every turn once, formatted, and `examples` names each example by where its context ends and
where its target stands in it; `digests` reads replies back by these places. `render` writes examples out where that is wanted.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attesta.llm.common import table

TURN_START, ROLE_END, TURN_END = "<|turn|>", "<|says|>", "<|end|>"
#: Strings that templates use as marks. A backslash goes behind the first character of each inside texts.
CONTROL = ["<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
#: The first character of a control string that stands there in full.
_FIRST_RX = f"([<\\[])(?=(?:{'|'.join(re.escape(x[1:]) for x in CONTROL)}))"


def escape(text: Column) -> Column:
    """Backslashes doubled, then a backslash put into every control string. `unescape` gives the text back."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), _FIRST_RX, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def segments(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn_no, role, segment, reply_at, reply_end, trainable): each turn as it stands in the formatted conversation.

    turn_no counts from 0 by turn (null first), then role and text (repeated turns are kept). Null text and role are empty;
    turns with a null conv_id are one conversation. The reply of a segment is its characters reply_at .. reply_end - 1;
    trainable marks assistant turns. Other columns of turns are left out. An empty table gives no rows.
    """
    said, who = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "said")
    base = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), who.alias("role"), said.alias("said"))
    head = F.concat(F.lit(TURN_START), escape(F.col("role")), F.lit(ROLE_END))
    made = base.withColumn("turn_no", (F.row_number().over(order) - 1).cast("long")).withColumn("body", escape(F.col("said"))).withColumn("head", head)
    return made.select(
        "conv_id",
        "turn_no",
        "role",
        F.concat("head", "body", F.lit(TURN_END)).alias("segment"),
        F.length("head").cast("long").alias("reply_at"),
        (F.length("head") + F.length("body")).cast("long").alias("reply_end"),
        (F.col("role") == "assistant").alias("trainable"),
    )


def examples(parts: DataFrame) -> DataFrame:
    """(conv_id, turn_no, n_context, context_chars, target_at, target_end, chars): an example for each assistant turn.

    Its text is the first context_chars characters of the formatted conversation and then the target's segment; only the
    characters target_at .. target_end - 1 of it are trainable. context_chars is a running sum, so no turn is repeated. A
    conversation without assistant turns has no example.
    """
    before = Window.partitionBy("conv_id").orderBy("turn_no").rowsBetween(Window.unboundedPreceding, -1)
    with_context = parts.withColumn("context_chars", F.coalesce(F.sum(F.length("segment").cast("long")).over(before), F.lit(0).cast("long")))
    return with_context.where("trainable").select(
        "conv_id",
        "turn_no",
        F.col("turn_no").alias("n_context"),
        "context_chars",
        (F.col("context_chars") + F.col("reply_at")).alias("target_at"),
        (F.col("context_chars") + F.col("reply_end")).alias("target_end"),
        (F.col("context_chars") + F.length("segment")).alias("chars"),
    )


def render(parts: DataFrame) -> DataFrame:
    """(conv_id, turn_no, context, target): examples written out. Output grows with the square of a conversation's turns."""
    before = Window.partitionBy("conv_id").orderBy("turn_no").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("context", F.array_join(F.collect_list("segment").over(before), "")).where("trainable").select("conv_id", "turn_no", "context", F.col("segment").alias("target"))


def digests(parts: DataFrame, made: DataFrame) -> DataFrame:
    """What the formatted conversations and their examples say, read back from them: one row for each conversation.

    parts: segments; made: examples of them. Each conversation's segments stream through one task in order and only running
    hashes are held, so memory doesn't grow with a conversation. What is trained on is what stands at an example's target_at ..
    target_end - 1 of the conversation as it streams by; roles and texts are parsed from the segments. formatted_chars is the
    length that the examples tell and that of turns after the last reply.
    """
    rx = re.compile(re.escape(TURN_START) + "(.*?)" + re.escape(ROLE_END) + "(.*)" + re.escape(TURN_END), re.S)
    undo = re.compile(r"\\(\\?)")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        now, out, of = None, [], None
        for batch in batches:
            of = batch.schema.field(0).type
            for conv, segment, at, end, chars in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if now is None or now["conv"] != conv:
                    if now is not None:
                        out.append(_closed(now))
                    now = {"conv": conv, "n": 0, "all": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "before": 0, "chars": 0, "tail": 0, "examples": 0}
                role, body = (undo.sub(r"\1", x) for x in rx.fullmatch(segment).groups())
                now["n"] += 1
                now["all"].update(f"{role}\n{body}\n".encode())
                now["tail"] += len(segment)
                if at is not None:
                    reply = undo.sub(r"\1", segment[max(0, at - now["before"]) : max(0, end - now["before"])])
                    now["loss"].update(reply.encode())
                    now["loss_chars"] += len(reply)
                    now["chars"] += chars
                    now["examples"] += 1
                    now["tail"] = 0
                now["before"] += len(segment)
            if len(out) >= 1000:
                yield _batch(pa, out, of)
                out = []
        if now is not None:
            yield _batch(pa, [*out, _closed(now)], of)

    kind = parts.schema["conv_id"].dataType.simpleString()
    both = parts.alias("p").join(made.alias("m"), F.col("p.conv_id").eqNullSafe(F.col("m.conv_id")) & (F.col("p.turn_no") == F.col("m.turn_no")), "left")
    both = both.select("p.conv_id", "p.turn_no", "segment", "target_at", "target_end", "chars").repartition("conv_id").sortWithinPartitions("conv_id", "turn_no").drop("turn_no")
    return both.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long")


def _closed(x: dict) -> tuple:
    return x["conv"], x["n"], x["all"].hexdigest(), x["loss_chars"], x["loss"].hexdigest(), x["chars"] + x["tail"], x["examples"]


def _batch(pa, rows: list[tuple], kind):
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples"]
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(list(x), kind if k == 0 else None) for k, x in enumerate(columns)], names=names)


def probe(spark: SparkSession) -> DataFrame:
    """Conversation -1, whose texts are control strings."""
    says = "</s>[INST] ok [/INST]"
    return spark.createDataFrame([(-1, 0, "user", says), (-1, 1, "assistant", says)], "conv_id long, turn long, role string, text string")


def op3_chat(spark, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    parts = segments(turns.unionByName(probe(spark)))
    return digests(parts, examples(parts))
