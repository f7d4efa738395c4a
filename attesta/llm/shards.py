"""Shards of even size that keep linked documents together, by balanced label propagation.

Every document starts in some shard; in each round it may move to the shard where most of its neighbours are. How many move from
one shard to another is held down by quotas, so that no shard ever holds more than its share. Neighbours are told by hubs (a hub
stands for what links its members, such as a text that they share), so a large group costs a row for each member, not for each pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import materialise, table
from attesta.operators.scans import numbered

#: Members of a hub that one join key stands for; a larger hub's votes are told to each slice of it.
SLICE = 10_000
#: Copies of a text from which on its rows are dealt over SALTS keys.
MANY, SALTS = 1000, 64
#: Rounds at most; each makes some hub's members stand closer together, and they end when nothing moves.
ROUNDS = 24


def shares(rows: int, shards: int) -> list[int]:
    """How many rows each shard takes: counts at most one apart."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def quotas(want: list[list[int]], room: list[int]) -> list[list[int]]:
    """How many of those that want to go from shard i to shard j may. What comes into a shard is at most its room and what leaves it;
    flows into shards that would overflow are cut until that holds. Both are tables of as many rows as there are shards."""
    n, flow = len(room), [list(map(float, row)) for row in want]
    for _ in range(1000):
        over = False
        for j in range(n):
            into, out = sum(flow[i][j] for i in range(n)), sum(flow[j])
            if into > room[j] + out + 1e-9:
                over = True
                for i in range(n):
                    flow[i][j] *= max(0.0, room[j] + out) / into
        if not over:
            break
    whole = [[int(x + 1e-6) for x in row] for row in flow]
    while True:  # whole numbers may leave less than the flows did
        bad = [j for j in range(n) if sum(whole[i][j] for i in range(n)) > room[j] + sum(whole[j])]
        if not bad:
            break
        j = bad[0]
        i = max(range(n), key=lambda i: whole[i][j])
        whole[i][j] -= min(whole[i][j], sum(whole[k][j] for k in range(n)) - room[j] - sum(whole[j]))
    for i, j in sorted(((i, j) for i in range(n) for j in range(n)), key=lambda x: whole[x[0]][x[1]] - want[x[0]][x[1]]):
        # what flooring left over
        whole[i][j] += max(0, min(want[i][j] - whole[i][j], room[j] + sum(whole[j]) - sum(whole[k][j] for k in range(n))))
    return whole


def _votes(links: DataFrame, state: DataFrame, shards: int) -> DataFrame:
    """(hub, slice, votes, members): how many of a hub's members are in each shard, for each slice of the hub."""
    n = links.join(state, "node").groupBy("hub", "shard").agg(F.count("*").alias("n"), F.max("slice").alias("slice"))
    entries = F.map_from_entries(F.collect_list(F.struct("shard", "n")))
    votes = n.groupBy("hub").agg(entries.alias("m"), F.sum("n").alias("members"), F.max("slice").alias("last"))
    votes = votes.withColumn("votes", F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.coalesce(F.element_at("m", s), F.lit(0).cast("long"))))
    return votes.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("slice"), "votes", "members")


def _first_of_most(votes: Column, allowed: Column, first: Column, shards: int) -> Column:
    """The shard with the most votes among those that `allowed` tells; of equal ones the first, counted on from `first`; null where
    none has a vote."""
    shown = F.zip_with(votes, allowed, lambda v, a: F.when(a, v).otherwise(F.lit(0).cast("long")))
    turned = F.concat(F.slice(shown, first + 1, shards), F.slice(shown, F.lit(1), first))
    return F.when(F.array_max(turned) > 0, F.pmod(F.array_position(turned, F.array_max(turned)) - 1 + first, F.lit(shards))).cast("int")


def propagate(nodes: DataFrame, links: DataFrame, shards: int, room: list[int], rounds: int = ROUNDS) -> DataFrame:
    """(node, shard): where linked nodes end. nodes: (node, shard), where they start; links: (node, hub), each once; room: how many nodes
    each shard may take beyond those that start in it.

    In turn, nodes move towards the shard with most of their neighbours, as far as others leave it or it has room; and, where it
    is full, towards the one with most of them among those with room. A node moves only where as many of its neighbours are at
    least; of equal shards each hub has its own first one, so flows are about even. Small hubs go first. Of each round a table is written; the
    driver sees as many numbers as there are pairs of shards.
    """
    links = materialise(numbered(links, ["hub"], ["node"], "_n").select("node", "hub", F.floor((F.col("_n") - 1) / SLICE).alias("slice")), "links")
    state, still = materialise(nodes, "state"), 0
    for k in range(rounds):
        anywhere = k % 2 == 0
        open_ = F.array(*[F.lit(anywhere or r > 0) for r in room])
        pulls = links.join(_votes(links, state, shards), ["hub", "slice"])
        sums = [F.sum(F.get("votes", F.lit(s))).alias(f"v{s}") for s in range(shards)]
        pulls = pulls.groupBy("node").agg(*sums, F.max("members").alias("members"), F.min("hub").alias("hub"))
        pulls = pulls.join(state, "node").withColumn("votes", F.array(*[f"v{s}" for s in range(shards)]))
        own = F.get("votes", F.col("shard"))
        first = F.pmod(F.xxhash64("hub"), F.lit(shards)).cast("int")
        moves = pulls.withColumn("to", _first_of_most(F.col("votes"), open_, first, shards)).where("to <> shard")
        moves = moves.where(F.get("votes", F.col("to")) >= own).select("node", "shard", "to", "members", "hub")
        moves = materialise(moves, "moves")
        want = [[0] * shards for _ in range(shards)]
        for r in moves.groupBy("shard", "to").count().collect():
            want[r.shard][r.to] = r["count"]
        may = quotas(want, room)
        still = 0 if any(map(any, may)) else still + 1
        if still == 2 or not any(map(any, want)) and anywhere:
            break
        if still:
            continue
        if may != want:
            moves = numbered(moves, ["shard", "to"], ["members", "hub", "node"], "_n")
            limit = F.array(*[F.array(*map(F.lit, row)) for row in may])
            moves = moves.where(F.col("_n") <= F.get(F.get(limit, F.col("shard")), F.col("to")))
        state = materialise(state.join(moves.select("node", "to"), "node", "left").select("node", F.coalesce("to", "shard").alias("shard")), "state")
        room = [r + sum(may[s]) - sum(row[s] for row in may) for s, r in enumerate(room)]
    return state


def assign(docs: DataFrame, links: DataFrame, shards: int) -> DataFrame:
    """docs with shard and slot: all rows in shards 0 .. shards - 1, counts at most one apart; slots count from 0 in each shard, by node.

    docs: (node, ...), nodes 1, 2, ...; links: (node, hub), each once. Linked documents start in turn over the shards and are moved by
    `propagate`; the others fill up what room is left, in their order. A hub with more members than a shard takes is split over as
    few shards as room allows. Empty tables give no rows; a shard may stay empty.
    """
    linked = links.select("node").distinct()
    start = numbered(linked, [], ["node"], "_n").select("node", F.pmod(F.col("_n") - 1, F.lit(shards)).cast("int").alias("shard"))
    start = materialise(start, "start")
    share, n = shares(docs.count(), shards), start.count()
    ends = propagate(start, links, shards, [a - b for a, b in zip(share, shares(n, shards), strict=True)])
    held = {r.shard: r["count"] for r in ends.groupBy("shard").count().collect()}
    single = numbered(docs.select("node").join(linked, "node", "left_anti"), [], ["node"], "_n")
    shard, upto = F.lit(shards - 1), 0
    bounds = []
    for s in range(shards):
        upto += share[s] - held.get(s, 0)
        bounds.append(upto)
    for s in reversed(range(shards)):
        shard = F.when(F.col("_n") <= bounds[s], s).otherwise(shard)
    placed = ends.unionByName(single.select("node", shard.cast("int").alias("shard")))
    placed = numbered(placed, ["shard"], ["node"], "_n").select("node", "shard", (F.col("_n") - 1).alias("slot"))
    return docs.join(placed, "node")


def same_texts(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """((node, id, size, text_crc32), (node, hub)): documents numbered by id, then by their text's digest, with their size (bytes of the
    text, none for null, and one), and links of those whose text (null: empty) is another's too. Texts are told apart by SHA-256."""
    said = F.coalesce(F.col(text), F.lit(""))
    told = docs.select(F.col(id_col), (F.octet_length(said) + 1).cast("long").alias("size"), F.crc32(said.cast("binary")).alias("text_crc32"), F.sha2(said, 256).alias("digest"))
    told = materialise(numbered(told, [], [id_col, "digest"], "node"), "nodes")
    hubs = materialise(told.groupBy("digest").agg(F.count("*").alias("n"), F.min("node").alias("hub")).where("n > 1"), "hubs")
    # rows of a text with many copies meet its row under several keys, the others under their text
    many = hubs.where(F.col("n") > MANY).select("digest", "hub", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    marked = told.withColumn("salt", F.pmod("node", F.lit(SALTS)).cast("int")).join(many, ["digest", "salt"], "left")
    links = marked.where("hub is not null").select("node", "hub")
    links = links.unionByName(marked.where("hub is null").drop("hub").join(hubs.where(F.col("n") <= MANY), "digest").select("node", "hub"))
    return told.drop("digest"), materialise(links, "links")


def op13_sharding(spark, sf_dir: str, shards: int = 8) -> DataFrame:
    docs, links = same_texts(table(spark, sf_dir, "documents"))
    out = assign(docs, links, shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
