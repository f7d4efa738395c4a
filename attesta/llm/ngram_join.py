"""N-gram Jaccard join over parity sketches.

A document is the set of its five-word shingles, hashed to 64 bits. The sets of one size band are cut by hash into the
same number of blocks, and each block's shingles are XORed into one sketch word. Every shingle that only one of two sets
has changes at most one word, so the number of words that differ is a lower bound of the symmetric difference, which
similarity bounds: sets that are similar enough must agree on one of any d + 1 non-empty words (pigeonhole). Those words are the
join keys. Met pairs must then pass a longer bit sketch (one bit flipped for each shingle), whose Hamming distance
is a lower bound of the symmetric difference too, and last the exact test on the sets.

Equal sets are one node. Within a key only neighbours and the first node are paired at first; nodes that come together
need no further pairs, and the pairs left between components are then tested all, so no link is lost and a group of
many near copies doesn't make pairs with its square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.llm.common import components, lean, materialise, own_name, small, table, text_bytes

#: Words of a shingle; similarity as a whole percentage.
WORDS, PERCENT = 5, 80
#: Blocks of a band, for each shingle of its smallest set.
BLOCK_SHARE = 0.48
#: Rounds that pair neighbours by another order before all pairs left are tested.
ROUNDS = 2
#: A key with more nodes than this is common. Nodes emit SPARE more keys in a hundred than the pigeonhole needs, and
#: common keys are passed over by nodes that keep enough others; nodes that don't are paired within common keys too.
COMMON, SPARE = 24, 25
#: Nodes of a common key that one task compares with as many others.
CHUNK = 4096
#: Keys that a row of a common key carries of those before it: a pair that meets in one of them isn't given again.
BEFORE = 16

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_P = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M[1]
        x = (x ^ (x >> np.uint64(27))) * _M[2]
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's shingles of five words; of all its words, if it has fewer."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, text: bytes) -> np.ndarray:
        import xxhash

        words, known = text.lower().split(), self.known
        if not words:
            return np.zeros(0, np.uint64)
        if len(known) > 500_000:
            known.clear()
        h = np.empty(len(words), np.uint64)
        for k, w in enumerate(words):
            x = known.get(w)
            if x is None:
                x = known[w] = xxhash.xxh64_intdigest(w)
            h[k] = x
        with np.errstate(over="ignore"):
            if len(words) < WORDS:
                total = (h * _P[: len(h)]).sum(dtype=np.uint64) + _P[5] * np.uint64(len(h))
                return mix(np.array([total], np.uint64))
            n = len(h) - WORDS + 1
            total = h[:n] * _P[0]
            for k in range(1, WORDS):
                total += h[k : k + n] * _P[k]
        return np.unique(mix(total))


def band_of(n: int) -> int:
    return n.bit_length() - 1


def most_apart(n: int, largest: int, percent: int = PERCENT) -> int:
    """The largest symmetric difference of a set of n with a similar one of at most `largest`: (1 - t) / (1 + t) of both sizes."""
    m = min(n * 100 // percent, largest)
    return (n + m) * (100 - percent) // (100 + percent)


def bands(n: int, percent: int = PERCENT) -> list[tuple[int, int]]:
    """(band, largest symmetric difference) where a set of n meets similar ones: pairs meet in the larger one's band."""
    home = band_of(n)
    out = [(home, most_apart(n, (2 << home) - 1, percent))]
    if n * 100 >= percent * (2 << home):
        out.append((home + 1, most_apart(n, n * 100 // percent, percent)))
    return out


def block_keys(s: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int, np.ndarray]]:
    """(band, spare, keys): the join keys of a set in each of its bands, and how many it can do without.

    Keys are the set's first non-empty sketch words, d + 1 of them and some more. Two similar sets agree on one of any
    d + 1; if one of the two has at most `spare` keys that are passed over, they agree on another. Where a set has too few
    non-empty words (spare is negative), another such set can be met by its smallest hashes instead, of which two similar
    sets share one; one set with enough words suffices for a pair.
    """
    out = []
    for band, d in bands(len(s), percent):
        if d == 0:
            continue  # only equal sets are that similar, and those are one node
        blocks = int(BLOCK_SHARE * (1 << band)) + 2
        own = ((s >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)  # s is sorted, so blocks are
        start = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        take = d + 3 + d * SPARE // 100
        words = np.bitwise_xor.reduceat(s, start)[:take]
        with np.errstate(over="ignore"):
            keys = mix(words ^ mix(own[start][:take] + np.uint64(band << 32) + np.uint64(1)))
            spare = len(keys) - d - 1
            if spare < 0:
                keys = np.concatenate((keys, mix(mix(s)[np.argsort(mix(s))][: len(s) - -(-percent * len(s) // 100) + 1] + _P[5] * np.uint64(band + 1))))
        out.append((band, spare, keys))
    return out


def bit_sketch(s: np.ndarray, band: int) -> bytes:
    """A parity sketch of 2 << band bits: bit h of the set's sketch tells if an odd number of shingles hash to it."""
    m = max(64, 2 << band)
    odd = np.bincount((mix(s + _P[4]) % np.uint64(m)).astype(np.int64), minlength=m) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _signed(x) -> int:
    return int(np.uint64(x).astype(np.int64))


def _halves(s: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart."""
    with np.errstate(over="ignore"):
        return _signed(mix(s).sum(dtype=np.uint64) + np.uint64(len(s))), _signed(np.bitwise_xor.reduce(mix(s * _M[0]), initial=np.uint64(0)))


def signatures(docs: DataFrame) -> DataFrame:
    """(id, tag, n, h1, h2, home, guest, bands): size, 128 bits, bit sketches and join keys of each row's set.

    docs: (id, text, tag). bands: the keys of each band, with `spare * 64 + band`, which also tells bands of one set apart.
    """
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sets = Shingler()
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                piece = batch.slice(lo, 500)
                facts, spares, keys, per_band, per_row = [], [], [np.zeros(0, np.uint64)], [0], [0]
                for t in text_bytes(piece.column(1)):
                    s = sets(t)
                    own = bands(len(s)) if len(s) else []
                    facts.append((len(s), *_halves(s), bit_sketch(s, own[0][0]) if own else b"", bit_sketch(s, own[1][0]) if len(own) > 1 else b""))
                    for band, spare, found in block_keys(s) if len(s) else ():
                        spares.append(spare * 64 + band)
                        keys.append(found)
                        per_band.append(len(found))
                    per_row.append(len(spares))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(per_band), pa.int32()), pa.array(np.concatenate(keys).astype(np.int64)))
                struct = pa.StructArray.from_arrays([pa.array(spares, pa.int64()), lists], names=["spare", "keys"])
                columns = [pa.array(list(c), k) for c, k in zip(zip(*facts, strict=True), (pa.int64(),) * 3 + (pa.binary(),) * 2, strict=True)]
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(2), *columns, pa.ListArray.from_arrays(pa.array(per_row, pa.int32()), struct)], names=["id", "tag", "n", "h1", "h2", "home", "guest", "bands"])

    return docs.select("id", "text", "tag").mapInArrow(lean(run), f"id {kind}, tag long, n long, h1 long, h2 long, home binary, guest binary, bands array<struct<spare: long, keys: array<long>>>")


def _same(left: str, right: str):
    """The rows of one set: a number of its own is given to each pair of halves, so sets may share one half."""
    return (F.col(f"{left}.h1") == F.col(f"{right}.h1")) & (F.col(f"{left}.h2") == F.col(f"{right}.h2"))


def _sketch_test(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose bit sketches don't show too large a symmetric difference."""
    from_a = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("home").alias("ha"), F.col("guest").alias("ga"))
    from_b = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("home").alias("hb"), F.col("guest").alias("gb"))
    met = pairs.join(from_a, "a").join(from_b, "b").where(100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb"))
    same = F.length("ha") == F.length("hb")
    same_band = F.floor(F.log2("na")) == F.floor(F.log2("nb"))
    left = F.when(same & same_band, F.col("ha")).when(F.col("na") < F.col("nb"), F.col("ga")).otherwise(F.col("ha"))
    right = F.when(same & same_band, F.col("hb")).when(F.col("na") < F.col("nb"), F.col("hb")).otherwise(F.col("gb"))
    most = F.floor((F.col("na") + F.col("nb")) * (100 - PERCENT) / (100 + PERCENT)).cast("long")
    met = met.select("a", "b", most.alias("most"), left.alias("x"), right.alias("y"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            a, b, most, xs, ys = (batch.column(k).to_pylist() for k in range(5))
            near = [len(x) != len(y) or int(np.bitwise_count(np.frombuffer(x, np.uint8) ^ np.frombuffer(y, np.uint8)).sum()) <= m for m, x, y in zip(most, xs, ys, strict=True)]
            keep = pa.array(near, pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()).filter(keep), pa.array(b, pa.int64()).filter(keep)], names=["a", "b"])

    return met.mapInArrow(lean(run), "a long, b long")


def _exact_test(pairs: DataFrame, docs: DataFrame, numbers: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sets are similar enough. pairs is a table; docs: (id, text, tag); numbers: (node, rep, h1, h2)."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = materialise(ends.join(numbers, "node").select("node", "rep", "h1", "h2"), "wanted")

    def shingle(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sets = Shingler()
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                piece = batch.slice(lo, 1000)
                found = [sets(t) for t in text_bytes(piece.column(1))]
                own = pa.array([_halves(s) == h for s, h in zip(found, zip(piece.column(2).to_pylist(), piece.column(3).to_pylist(), strict=True), strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([piece.column(0).filter(own), pa.array([s.tobytes() for s in found], pa.binary()).filter(own)], names=["node", "s"])

    own = docs.join(small(wanted), F.col("id").eqNullSafe(F.col("rep"))).select("node", "text", "h1", "h2").mapInArrow(lean(shingle), "node long, s binary")
    sets = materialise(own.dropDuplicates(["node"]), "sets")
    met = pairs.join(sets.withColumnsRenamed({"node": "a", "s": "sa"}), "a").join(sets.withColumnsRenamed({"node": "b", "s": "sb"}), "b")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            near = []
            for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                near.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            keep = pa.array(near, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return met.select("a", "b", "sa", "sb").mapInArrow(lean(run), "a long, b long")


def _pair(x, y, condition):
    return F.when(condition, F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")))


def _neighbours(met: DataFrame, order, label: str) -> DataFrame:
    """Distinct (a, b) of each key's neighbours in an order, and of its first node, where their labels differ and sizes allow."""
    window = Window.partitionBy("key").orderBy(order, "node")
    back = met.select("key", "node", "n", label, *[F.lag(c).over(window).alias(f"l_{c}") for c in dict.fromkeys(("node", "n", label))], *[F.first(c).over(window).alias(f"f_{c}") for c in dict.fromkeys(("node", "n", label))])
    fits = lambda p: (F.col(f"{p}_{label}") != F.col(label)) & (100 * F.least(F.col(f"{p}_n"), F.col("n")) >= PERCENT * F.greatest(F.col(f"{p}_n"), F.col("n")))
    both = back.select(F.explode(F.array_compact(F.array(*[_pair(F.col(f"{p}_node"), F.col("node"), fits(p)) for p in ("l", "f")]))).alias("p"))
    return both.select("p.a", "p.b").distinct()


def _within_common(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct (a, b) within common keys whose bit sketches are near enough; at least one of the two is bound to common keys.

    rows: (key, node, n, spare, comp, bound). A key's nodes are cut into chunks; each pair of chunks is a group of its own,
    of bounded size, and a task compares its sketches as arrays and gives only the pairs that pass. Near copies share most
    of their keys, so a pair is left to an earlier key where both rows name one that they share.
    """
    by_key = Window.partitionBy("key")
    before = F.collect_list("key").over(Window.partitionBy("node").orderBy("key").rowsBetween(-BEFORE, -1))
    rows = rows.withColumn("before", before)
    chunks = F.ceil(F.count("*").over(by_key) / CHUNK).cast("int")
    sketched = rows.join(nodes.select("node", "home", "guest"), "node").withColumn("c", chunks).withColumn("i", F.pmod(F.xxhash64("node"), F.col("c")).cast("int"))
    sketch = F.when(F.floor(F.log2("n")) == F.pmod("spare", F.lit(64)), F.col("home")).otherwise(F.col("guest"))
    other = F.explode(F.sequence(F.lit(0), F.col("c") - 1))
    dealt = sketched.select("key", "node", "n", "comp", "bound", sketch.alias("s"), "before", "i", other.alias("j")).withColumns({"lo": F.least("i", "j"), "hi": F.greatest("i", "j")})
    dealt = dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").select("key", "lo", "hi", "node", "n", "comp", "bound", "s", "before", "i")

    def compare(own: list[tuple]) -> np.ndarray:
        node, n, comp = (np.array([x[k] for x in own], np.int64) for k in (3, 4, 5))
        bound = np.array([x[6] for x in own])
        bits = np.array([np.frombuffer(x[7], np.uint64) for x in own])
        before, chunk, across = [set(x[8]) for x in own], np.array([x[9] for x in own]), own[0][1] != own[0][2]
        found = [np.zeros((0, 2), np.int64)]
        for k in range(len(own) - 1):
            rest = slice(k + 1, None)
            fits = (comp[rest] != comp[k]) & (100 * np.minimum(n[k], n[rest]) >= PERCENT * np.maximum(n[k], n[rest])) & (bound[rest] | bound[k])
            if across:
                fits &= chunk[rest] != chunk[k]
            at = np.flatnonzero(fits) + k + 1
            if len(at):
                apart = np.bitwise_count(bits[at] ^ bits[k]).sum(axis=1)
                at = at[apart <= (n[k] + n[at]) * (100 - PERCENT) // (100 + PERCENT)]
                at = at[np.array([before[k].isdisjoint(before[j]) for j in at], bool)]
                found.append(np.stack((np.minimum(node[at], node[k]), np.maximum(node[at], node[k])), axis=1))
        return np.concatenate(found)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own, group = [], None
        for batch in batches:
            for x in zip(*(batch.column(k).to_pylist() for k in range(10)), strict=True):
                if x[:3] != group:
                    if len(own) > 1:
                        pairs = compare(own)
                        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])
                    own, group = [], x[:3]
                own.append(x)
        if len(own) > 1:
            pairs = compare(own)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return dealt.mapInArrow(lean(run), "a long, b long").distinct()


def _merged(label: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, comp) after links (a, b) have joined the components that label (node, comp) knows; nodes it doesn't know are their own.

    Only new links between components go through `components`, so a later call works on fewer and fewer edges.
    """
    if label is None:
        return components(links).withColumnRenamed("component", "comp")
    of = lambda x: label.select(F.col("node").alias(x), F.col("comp").alias(f"c{x}"))
    edges = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    moved = materialise(components(edges), "moved")
    old = label.join(moved.select(F.col("node").alias("comp"), F.col("component").alias("to")), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
    return old.union(moved.join(label, "node", "left_anti").select("node", F.col("component").alias("comp")))


def _classes(docs: DataFrame) -> DataFrame:
    """(id, tag, n, component) for each row of docs (id, text, tag)."""
    signed = materialise(signatures(docs), "signatures")
    numbers = signed.where("n > 0").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.first("n").alias("n"))
    numbers = materialise(numbers.withColumn("node", F.monotonically_increasing_id()), "numbers")
    # one row stands for each set, so copies give no keys; repeated rows of its id are taken out below
    chosen = signed.alias("s").join(small(numbers.drop("n")).alias("m"), F.col("s.id").eqNullSafe(F.col("m.rep")) & _same("s", "m")).select("node", "n", "home", "guest", "bands")
    nodes = materialise(chosen.groupBy("node").agg(*(F.first(c).alias(c) for c in ("n", "home", "guest"))), "nodes")
    by_key = Window.partitionBy("key")
    # dealt by key first: taking equal rows out, counting and ordering then need no other shuffle
    keyed = chosen.select("node", "n", F.explode("bands").alias("b")).select(F.explode("b.keys").alias("key"), "node", F.col("n").cast("int").alias("n"), F.col("b.spare").alias("spare"))
    met = keyed.repartition("key").dropDuplicates(["key", "node", "n", "spare"]).withColumn("g", F.count("*").over(by_key))
    met = materialise(met.where("g > 1").withColumn("common", F.col("g") > COMMON).drop("g"), "met")
    bound = met.where("common").groupBy("node", "spare").count().where("count > floor(spare / 64)").select("node").distinct()
    bound = materialise(bound.withColumn("bound", F.lit(True)), "bound")

    tested, label = None, None
    for k in range(ROUNDS + 1):
        if label is None:
            left = met.withColumn("comp", F.col("node"))
        else:  # keys whose nodes are all in one component have nothing left to link
            left = met.join(label, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
            mixed = left.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key")
            left = materialise(left.join(mixed, "key").select("key", "node", "n", "spare", "common", "comp"), "mixed")
        if k < ROUNDS:
            pairs = _neighbours(left, F.xxhash64("node", F.lit(k)), "comp")
        else:
            other = left.select("key", F.col("node").alias("o"), F.col("n").alias("m"), F.col("comp").alias("c"), F.col("common").alias("oc"))
            sizes = 100 * F.least("n", "m") >= PERCENT * F.greatest("n", "m")
            few = left.where("not common").join(other.where("not oc"), "key").where("node < o and comp <> c").where(sizes)
            pairs = few.select(F.col("node").alias("a"), F.col("o").alias("b")).distinct()
            hot = left.where("common").join(bound, "node", "left").withColumn("bound", F.coalesce("bound", F.lit(False)))
            within = _within_common(hot, nodes)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = materialise(pairs, "pairs")
        near = _sketch_test(pairs, nodes)
        if k == ROUNDS:
            near = near.union(within if tested is None else within.join(tested, ["a", "b"], "left_anti")).distinct()
        near = materialise(near, "near")
        if near.isEmpty():
            tested = pairs if tested is None else tested.union(pairs)
            continue
        new = materialise(_exact_test(near, docs, numbers), "links")
        tested = pairs if tested is None else tested.union(pairs)
        label = materialise(_merged(label, new), "label")
    own = numbers.withColumn("comp", F.col("node")) if label is None else numbers.join(label, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    low = own.groupBy("comp").agg(F.min("rep").alias("component"))
    of_set = materialise(own.join(low, "comp").select("h1", "h2", "component"), "sets-of")
    out = signed.alias("s").join(small(of_set).alias("m"), _same("s", "m"), "left")
    return out.select("s.id", "s.tag", "s.n", F.when(F.col("s.n") > 0, F.col("component")).otherwise(F.col("s.id")).alias("component"))


def _tagged(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("tag"))


def classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for each row of docs.

    Rows link when 100 * shared >= 80 * united shingles; component_id is the smallest id that links reach. A null, empty
    or blank text has no shingles and is linked with nothing; of a text with under five words, all its words are one
    shingle. Repeated rows come back as often; rows that share an id but not the text are judged each by its own text. A
    null id is never a class's smallest, unless the class has no other. An empty table gives no rows.
    """
    return _classes(_tagged(docs, id_col, text)).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with only one row of the smallest id of each class, unchanged; rows without shingles, and those whose class has no id, all stay.

    Of repeated rows (id and text) of a smallest id one stays. Other columns stay, whatever they are called.
    """
    found = _classes(_tagged(docs, id_col, text)).where("n > 0 and component is not null")
    key, tag = own_name(docs, "_id"), own_name(docs, "_tag")
    found = materialise(found.select(F.col("id").alias(key), F.col("tag").alias(tag), F.col("id").eqNullSafe(F.col("component")).alias("first")), "found")
    drop = materialise(found.where("not first").select(key, tag).distinct(), "dropped")
    again = materialise(found.where("first").groupBy(key, tag).count().where("count > 1").select(key, tag), "repeated")
    this = lambda: F.col(id_col).eqNullSafe(F.col(key)) & (F.xxhash64(text) == F.col(tag))
    kept = docs.join(small(drop), this(), "left_anti")
    if not again.isEmpty():
        one = docs.join(small(again), this()).dropDuplicates([key, tag])
        kept = kept.join(small(again), this(), "left_anti").select(*docs.columns).unionByName(one.select(*docs.columns))
    return kept.select(*docs.columns)


def op1_ngram_join(spark, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
