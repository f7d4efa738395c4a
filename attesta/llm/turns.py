"""Repair of the structure of conversations: the cheapest edits that make the roles alternate, by block tables.

Roles must read `(s?(ua)+)?` by their initials. The cost of the best edits from a row on, for each of the four states of that pattern,
is a vector, and vectors differ from each other by bounded numbers: less their minimum there are few. So what a block of rows does to
a vector is precomputed for every block of BLOCK symbols and every such vector (the method of the Four Russians), and rows are
passed over a block at a time, from the last one to the first. Edits are then traced from the first row on; a block that is
traced is expanded backward, from the vector behind it, so that ties are broken the same way everywhere.

A conversation is cut into chunks of rows. What a chunk does is a matrix of costs between states; matrices stream through a
task for each conversation, so that rows of a long one are spread over tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import materialise, n_partitions, table
from attesta.operators.scans import numbered

#: States: at the start, behind s, behind u, behind a. The turn that an inserted or changed row becomes, and the state behind it.
STATES = range(4)
TURN, BEHIND = "uuau", [2, 2, 3, 2]
#: Costs of edits. An undeleted truncated row costs as much as an inserted one besides.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: More than any difference of costs: no way.
NEVER = 1_000_000
#: Symbols: 2 * initial (s, u, a, other) + truncated; MUST_GO for blank and repeated rows.
MUST_GO, SYMBOLS, BLOCK = 8, 9, 4
#: Rows of a conversation that one step holds.
CHUNK = 4096
#: White space of texts.
SPACE = " \t\n\x0b\x0c\r"

#: Costs from the end on: nothing where the pattern may end, else insertions.
END = (0, 2 * INSERT, INSERT, 0)


def kept_state(symbol: int, state: int) -> int | None:
    """The state behind a row that is kept, if it may stand there."""
    initial = "sua?"[symbol // 2] if symbol != MUST_GO else "?"
    if initial == "s" and state == 0:
        return 1
    return BEHIND[state] if initial == TURN[state] else None


def choices(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost, state behind) of a row, in the order of edits."""
    out = [("D", DELETE, state)]
    if symbol != MUST_GO:
        more = TRUNCATED if symbol % 2 else 0
        if (kept := kept_state(symbol, state)) is not None:
            out.append(("K", more, kept))
        out.append(("R", REROLE + more, BEHIND[state]))
    return out


def before(symbol: int, vector: tuple) -> tuple:
    """Costs at a row, from those behind it."""
    own = [min(cost + vector[to] for _, cost, to in choices(symbol, q)) for q in STATES]
    for _ in STATES:
        own = [min(own[q], INSERT + own[BEHIND[q]]) for q in STATES]
    return tuple(min(x, NEVER) for x in own)


def normal(vector: tuple) -> tuple[tuple, int]:
    """The vector less its minimum, and that minimum."""
    low = min(vector)
    return tuple(NEVER if x >= NEVER // 2 else x - low for x in vector), low


class Tables:
    """What every symbol and every block of BLOCK symbols does to every normalised vector."""

    def __init__(self):
        unit = [tuple(0 if q == e else NEVER for q in STATES) for e in STATES]
        self.ids, self.vectors, steps = {}, [], []
        self.units, self.end = [self._id(u) for u in unit], self._id(END)
        while len(steps) < len(self.vectors):
            made = [normal(before(s, self.vectors[len(steps)])) for s in range(SYMBOLS)]
            steps.append([(self._id(v), low) for v, low in made])
        one = np.array(steps, np.int64)
        self.one_to, self.one_cost = one[:, :, 0], one[:, :, 1]
        codes = np.arange(SYMBOLS**BLOCK)
        to, cost = np.repeat(np.arange(len(self.vectors))[:, None], len(codes), 1), np.zeros((len(self.vectors), len(codes)), np.int64)
        for k in range(BLOCK):  # the last symbol first
            digit = codes // SYMBOLS**k % SYMBOLS
            cost, to = cost + self.one_cost[to, digit], self.one_to[to, digit]
        self.to, self.cost = to, cost

    def _id(self, vector: tuple) -> int:
        if vector not in self.ids:
            self.ids[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.ids[vector]


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


def blocks_of(symbols: list[int]) -> list[int]:
    """Codes of the whole blocks; the symbols behind them are fewer than BLOCK."""
    whole = len(symbols) // BLOCK * BLOCK
    digits = np.array(symbols[:whole], np.int64).reshape(-1, BLOCK)
    return (digits @ (SYMBOLS ** np.arange(BLOCK - 1, -1, -1))).tolist()


def pass_over(symbols: list[int], vector: int) -> tuple[list[int], int]:
    """The vector behind each block (and behind the rows left over), the first being that before all rows; and the costs added up."""
    t, cost, behind = tables(), 0, [vector]
    for s in reversed(symbols[len(symbols) // BLOCK * BLOCK :]):
        cost, vector = cost + int(t.one_cost[vector, s]), int(t.one_to[vector, s])
    behind.append(vector)
    for code in reversed(blocks_of(symbols)):
        cost, vector = cost + int(t.cost[vector, code]), int(t.to[vector, code])
        behind.append(vector)
    return behind[::-1], cost


def matrix(symbols: list[int]) -> list[int]:
    """Costs from each state before the rows to each state behind them, row by row."""
    made = []
    for unit in tables().units:
        behind, cost = pass_over(symbols, unit)
        made.append([min(NEVER, x + cost) for x in tables().vectors[behind[0]]])
    return [made[e][q] for q in STATES for e in STATES]


@lru_cache(maxsize=200_000)
def expand(symbols: tuple, vector: int, state: int) -> tuple[tuple, int]:
    """The edits of each row of a block and the state behind it: costs are made backward from the vector, edits read forward."""
    costs = [tables().vectors[vector]]
    for s in reversed(symbols):
        costs.append(before(s, costs[-1]))
    costs.reverse()
    edits = []
    for k, s in enumerate(symbols):
        own = ""
        while True:
            ways = [(e, c + costs[k + 1][to], to) for e, c, to in choices(s, state)] + [("I", INSERT + costs[k][BEHIND[state]], BEHIND[state])]
            edit, _, to = min((w for w in ways if w[1] == costs[k][state]), key=lambda w: w[0])
            own += edit + (TURN[state] if edit in "IR" else "")
            state = to
            if edit != "I":
                break
        edits.append(own)
    return tuple(edits), state


def trace(symbols: list[int], vector: int, state: int) -> tuple[list[str], int]:
    """The edits of each row, from the state before them, and the state behind them. An edit is its initial, with the turn that an
    inserted (I) or changed (R) row gets; insertions stand before the edit of the row they precede."""
    behind, _ = pass_over(symbols, vector)
    edits: list[str] = []
    for k in range(0, len(symbols), BLOCK):
        own = symbols[k : k + BLOCK]
        made, state = expand(tuple(own), behind[k // BLOCK + 1] if len(own) == BLOCK else vector, state)
        edits.extend(made)
    return edits, state


def closing(state: int) -> str:
    """Insertions behind the last row."""
    out = ""
    while END[state]:
        out, state = out + "I" + TURN[state], BEHIND[state]
    return out


def damaged(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) with planted faults. By the CRC-32 of `conv_id:turn` modulo 20: 0 drops a row, 1 empties its
    text, 2 removes `.`, `!` and `?` from it, 3 repeats it, 4 makes it the user's. Nulls count as a space; conv_id and turn stay null."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), (F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20).alias("h"))
    rows = rows.where("h <> 0").withColumn("text", F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    rows = rows.withColumn("role", F.when(F.col("h") == 4, "user").otherwise(F.col("role")))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")).drop("_copy")


def faults(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, place, fault, illegal): rows in order of turn (nulls first; then by role and the text's digest), from 1.

    fault is the row's first of blank (nothing but white space), duplicate (role and text stand earlier in the conversation) and
    truncated (its last sign isn't one of `.!?`), or null. illegal: the initials of the row before and this one aren't su, ua or
    au. Null roles and texts are empty. A written table; other columns are left out.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = materialise(numbered(rows.withColumn("digest", F.sha2("text", 256)), ["conv_id"], ["turn", "role", "digest"], "place").withColumn("conv", F.struct("conv_id")), "turns")
    first = rows.groupBy("conv", "role", "digest").agg(F.min("place").alias("place")).select("conv", "place", F.lit(True).alias("first"))
    back = rows.select("conv", (F.col("place") + 1).alias("place"), F.substring("role", 1, 1).alias("back"))
    rows = rows.join(first, ["conv", "place"], "left").join(back, ["conv", "place"], "left")
    bare = F.rtrim("text", F.lit(SPACE))
    fault = F.when(F.ltrim(bare, F.lit(SPACE)) == "", "blank").when(F.col("first").isNull(), "duplicate").when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "truncated")
    legal = F.concat("back", F.substring("role", 1, 1)).isin("su", "ua", "au")
    return materialise(rows.select("conv_id", "conv", "turn", "role", "text", "place", fault.alias("fault"), F.coalesce(~legal, F.lit(False)).alias("illegal")), "faults")


def symbol() -> Column:
    initial = F.substring("role", 1, 1)
    which = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return F.when(F.col("fault").isin("blank", "duplicate"), MUST_GO).otherwise(2 * which + F.coalesce(F.col("fault") == "truncated", F.lit(False)).cast("int"))


def _in_order(df: DataFrame, *order) -> DataFrame:
    """Rows of each conversation in one part, sorted."""
    return df.repartition(n_partitions(df.sparkSession), "conv").sortWithinPartitions("conv", *order)


def edits(rows: DataFrame, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """((conv, place, edit), (conv, cost)): the cheapest edits of each row, of equally cheap ones those that are least in ASCII order.

    rows: faults. Steps: a matrix of each chunk; the vector behind each chunk, from the last to the first; what each chunk does
    from each state; the state before each chunk, from the first to the last. Only matrices and states of chunks, not rows, stream
    through the task of a conversation, and a step over rows holds a chunk.
    """
    no = F.floor((F.col("place") - 1) / chunk)
    chunks = rows.select("conv", no.alias("chunk"), "place", symbol().alias("symbol")).groupBy("conv", "chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "symbol"))), lambda x: x["symbol"]).alias("symbols"))
    chunks = materialise(chunks, "chunks")
    kind = chunks.schema["conv"].dataType.simpleString()

    def matrices(parts: Iterator) -> Iterator:
        import pyarrow as pa

        for part in parts:
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([matrix(x) for x in part.column(2).to_pylist()], pa.list_(pa.int64()))], names=["conv", "chunk", "costs"])

    def behind(parts: Iterator) -> Iterator:
        import pyarrow as pa

        now, costs = None, None
        for part in parts:
            vectors, total = [], []
            for conv, own in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True):
                if now is None or now != conv:
                    now, costs = conv, END
                vectors.append(list(normal(costs)[0]))
                costs = tuple(min(own[4 * q + e] + costs[e] for e in STATES) for q in STATES)
                total.append(costs[0])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(vectors, pa.list_(pa.int64())), pa.array(total, pa.int64())], names=["conv", "chunk", "vector", "cost"])

    def traces(parts: Iterator) -> Iterator:
        import pyarrow as pa

        for part in parts:
            ways, ends = [], []
            for number, symbols, vector in zip(*(part.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                made = [trace(symbols, tables().ids[tuple(vector)], q) for q in (STATES if number else [0])]
                ways.append([e for e, _ in made])
                ends.append([q for _, q in made])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(ends, pa.list_(pa.int64())), pa.array(ways, pa.list_(pa.list_(pa.string())))], names=["conv", "chunk", "ends", "ways"])

    def states(parts: Iterator) -> Iterator:
        import pyarrow as pa

        now, state = None, 0
        for part in parts:
            first, last = [], []
            for conv, own in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True):
                if now is None or now != conv:
                    now, state = conv, 0
                first.append(state)
                state = own[state]
                last.append(closing(state))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(first, pa.int32()), pa.array(last, pa.string())], names=["conv", "chunk", "state", "tail"])

    costs = chunks.mapInArrow(matrices, f"conv {kind}, chunk long, costs array<bigint>")
    vectors = materialise(_in_order(costs, F.col("chunk").desc()).mapInArrow(behind, f"conv {kind}, chunk long, vector array<bigint>, cost long"), "vectors")
    traced = chunks.join(vectors.drop("cost"), ["conv", "chunk"]).mapInArrow(traces, f"conv {kind}, chunk long, ends array<bigint>, ways array<array<string>>")
    traced = materialise(traced, "traced")
    begun = _in_order(traced.select("conv", "chunk", "ends"), "chunk").mapInArrow(states, f"conv {kind}, chunk long, state int, tail string")
    top = chunks.groupBy("conv").agg(F.max("chunk").alias("top"))
    chosen = traced.join(begun, ["conv", "chunk"]).join(top, "conv").withColumn("own", F.get("ways", "state"))
    told = chosen.select("conv", "chunk", "tail", (F.col("chunk") == F.col("top")).alias("ends"), F.size("own").alias("n"), F.posexplode("own").alias("k", "edit"))
    last = F.when(F.col("ends") & (F.col("k") == F.col("n") - 1), F.col("tail")).otherwise("")
    told = told.select("conv", (F.col("chunk") * chunk + F.col("k") + 1).alias("place"), F.concat("edit", last).alias("edit"))
    return told, vectors.where("chunk = 0").select("conv", "cost")


def repaired(rows: DataFrame, told: DataFrame) -> DataFrame:
    """(conv_id, conv, place, nth, role, text, edit): the rows after the edits; edit is K, R or I. Inserted ones have an empty text."""
    each = rows.join(told, ["conv", "place"]).select("conv_id", "conv", "place", "role", "text", F.posexplode(F.regexp_extract_all("edit", F.lit("[DIKR][ua]?"), F.lit(0))).alias("nth", "edit"))
    each = each.where("edit <> 'D'")
    role = F.when(F.endswith("edit", F.lit("u")), "user").when(F.endswith("edit", F.lit("a")), "assistant").otherwise(F.col("role"))
    return each.select("conv_id", "conv", "place", "nth", role.alias("role"), F.when(F.startswith("edit", F.lit("I")), "").otherwise(F.col("text")).alias("text"), F.substring("edit", 1, 1).alias("edit"))


def digests(made: DataFrame) -> DataFrame:
    """(conv, sha): SHA-256 of `role:text` of repaired rows, joined by newlines. A digest is sequential, so a conversation streams
    through one task, a row at a time."""
    kind = made.schema["conv"].dataType.simpleString()

    def run(parts: Iterator) -> Iterator:
        import pyarrow as pa

        of, now, sha = None, None, None
        done: list = []

        def told():
            return pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], of), pa.array([s for _, s in done], pa.string())], names=["conv", "sha"])

        for part in parts:
            of = part.schema.field(0).type
            for conv, role, text in zip(*(part.column(k).to_pylist() for k in (0, 3, 4)), strict=True):
                if now is None or now != conv:
                    if now is not None:
                        done.append((now, sha.hexdigest()))
                    now, sha = conv, hashlib.sha256()
                    sha.update(f"{role}:{text}".encode())
                else:
                    sha.update(f"\n{role}:{text}".encode())
            if len(done) >= 1000:
                yield told()
                done = []
        if now is not None:
            done.append((now, sha.hexdigest()))
            yield told()

    return _in_order(made.select("conv", "place", "nth", "role", "text"), "place", "nth").mapInArrow(run, f"conv {kind}, sha string")


def report(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256): what is wrong with each conversation and what
    its repair costs and does. turns: (conv_id, turn, role, text). An empty table gives no rows; a null conv_id is a conversation."""
    rows = faults(turns)
    told, cost = edits(rows, chunk)
    told = materialise(told, "edits")
    n = lambda name: F.count_if(F.col("fault") == name).alias(name)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long")
    facts = rows.groupBy("conv").agg(gaps.alias("gaps"), n("blank"), n("duplicate"), n("truncated"), F.count_if("illegal").alias("illegal"))
    audit = F.regexp_replace(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "edit"))), lambda x: x["edit"]), ""), "[ua]", "")
    audits = told.groupBy("conv").agg(audit.alias("audit"))
    out = facts.join(cost, "conv").join(audits, "conv").join(digests(repaired(rows, told)), "conv", "left")
    return out.select("conv.conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def op12_structure(spark, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    told = report(damaged(turns)).withColumn("conv", F.struct("conv_id")).drop("conv_id")
    out = turns.select("conv_id").distinct().withColumn("conv", F.struct("conv_id")).join(told, "conv", "left").drop("conv")
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return out.withColumns(zero | {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest()))})
