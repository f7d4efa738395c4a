"""Spelling variants: words that differ by one letter, by a trie over how often letters of each group occur.

One inserted, deleted or replaced letter changes the counts of letter groups by a surplus of one at most and a deficit of one at
most. A trie holds words by successive group counts; a search goes down it with a budget of one surplus and one deficit, and the
words of the leaves it reaches are compared letter by letter. The trie's upper levels are dealt over tasks by a key that is linear
in the counts, so a word finds the nodes its budget reaches by adding fixed numbers; the levels below stand in the tasks.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import materialise, n_partitions, table, text_bytes

#: Of Latin-1, letters (A-Z lower-cased) stay; all else, and what Latin-1 lacks, is a gap.
LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0xC0 else 0x20 for b in range(256))
#: Distinct words that a task counts before it hands them on.
HELD_WORDS = 200_000
#: Letters from frequent to rare; dealt over the groups in turn, so that groups are about equally frequent.
BY_USE = "etaoinsrhldcumfpgwybvkxjqz"
#: Groups of the levels that are dealt over tasks, and of those in a task.
UPPER_GROUPS, LOWER_GROUPS = 6, 26
#: What a letter of each upper group adds to the key of a node: odd numbers without small relations, so that keys seldom meet by chance.
WEIGHTS = [274177, 67280421310, 2147483647, 99194853094, 31825755127, 7853742119]
#: Words of a node that one task holds at most; of a leaf; queries that go down together.
NODE_WORDS, LEAF_WORDS, TOGETHER = 20_000, 32, 2048


def group_of(code: int, n: int) -> int:
    """The group of a Latin-1 letter among n."""
    letter = chr(code)
    return BY_USE.index(letter) % n if letter in BY_USE else code % n


def word_counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", every: int = 199, least_letters: int = 6, least: int = 5) -> DataFrame:
    """(word, n): words of at least `least_letters` code points with at least `least` occurrences.

    A word is a run of letters with A-Z lower-cased; where the CRC-32 of `<id>:<run>` is divisible by `every`, without the code point
    at CRC modulo length. Null texts have no runs; a null id is empty in the CRC; repeated rows count each. Words are counted in
    each task before they are shuffled.
    """

    def count(parts: Iterator) -> Iterator:
        import pyarrow as pa

        def told(seen: Counter):
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in seen], pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])

        seen: Counter = Counter()
        for part in parts:
            for own, t in zip(part.column(0).to_pylist(), text_bytes(part.column(1)), strict=True):
                start = zlib.crc32(f"{own}:".encode())
                runs = [w for w in t.decode("utf-8", "replace").encode("latin-1", "replace").translate(LETTERS).split() if len(w) >= least_letters]
                seen.update(runs)
                for w in set(runs):
                    h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), start)
                    if h % every == 0:
                        n, k = runs.count(w), h % len(w)
                        seen[w] -= n
                        if len(w) > least_letters:
                            seen[w[:k] + w[k + 1 :]] += n
                if len(seen) >= HELD_WORDS:
                    yield told(seen)
                    seen = Counter()
        yield told(seen)

    found = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text).cast("string")).mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def node_key(word: Column) -> Column:
    """The key of the node that holds a word: a sum over its letters, so one letter more adds its group's weight."""
    alphabet = [chr(c) for c in [*range(0x61, 0x7B), *range(0xC0, 0x100)]]
    key = F.lit(0).cast("long")
    for g, weight in enumerate(WEIGHTS):
        own = "".join(x for x in alphabet if group_of(ord(x), UPPER_GROUPS) == g)
        key = key + (F.length(word) - F.length(F.translate(word, own, ""))).cast("long") * weight
    return key


def routes() -> list[int]:
    """What to add to a word's key to reach each node that can hold a near word: none, a surplus of one, or one of each. Of two
    words near each other one looks for the other: the shorter, or the one whose surplus is in the earlier group."""
    n = range(UPPER_GROUPS)
    return [0, *WEIGHTS, *(WEIGHTS[i] - WEIGHTS[j] for i in n for j in n if i < j)]


_GROUP = np.array([group_of(c, LOWER_GROUPS) for c in range(256)], np.int64)


def counts(words: list[bytes]) -> np.ndarray:
    """How often letters of each lower group occur in each word."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    at = np.repeat(np.arange(len(words)) * LOWER_GROUPS, sizes) + _GROUP[np.frombuffer(b"".join(words), np.uint8)]
    return np.bincount(at, minlength=len(words) * LOWER_GROUPS).reshape(len(words), LOWER_GROUPS).astype(np.int32)


def one_apart(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For each row of two matrices of letters, whether exactly one letter is replaced, or, where `long` is a column wider, inserted."""
    n = short.shape[1]
    if long.shape[1] == n:
        return (short != long).sum(1) == 1
    front, back = np.cumprod(short == long[:, :n], axis=1).sum(1), np.cumprod((short == long[:, 1:])[:, ::-1], axis=1).sum(1)
    return front + back >= n


def letters(words: list[bytes]) -> np.ndarray:
    """Words of one length as a matrix."""
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)


class Trie:
    """Words by successive group counts. Nodes of few words are leaves."""

    def __init__(self, words: list[bytes]):
        self.words = words
        self.vectors = counts(words)
        self.root = self._grow(np.arange(len(words)), 0)

    def _grow(self, own: np.ndarray, level: int):
        if len(own) <= LEAF_WORDS or level == LOWER_GROUPS:
            return own
        values, which = np.unique(self.vectors[own, level], return_inverse=True)
        return [(int(v), self._grow(own[which == k], level + 1)) for k, v in enumerate(values)]

    def near(self, queries: list[bytes]) -> np.ndarray:
        """Rows (query, word): pairs whose counts are within the budget; depth first, with the queries that can still afford a node."""
        asked = counts(queries)
        none = np.zeros(len(queries), np.int8)
        stack, found = [(self.root, 0, np.arange(len(queries)), none, none)], [np.zeros((0, 2), np.int64)]
        while stack:
            node, level, own, surplus, deficit = stack.pop()
            if isinstance(node, np.ndarray):
                apart = self.vectors[node][None, :, level:] - asked[own][:, None, level:]
                up, down = np.maximum(apart, 0).sum(2), -np.minimum(apart, 0).sum(2)
                q, w = np.nonzero((surplus[:, None] + up <= 1) & (deficit[:, None] + down <= 1))
                found.append(np.stack((own[q], node[w]), 1))
                continue
            for value, child in node:
                apart = value - asked[own, level]
                more, less = surplus + np.maximum(apart, 0), deficit - np.minimum(apart, 0)
                if (can := (more <= 1) & (less <= 1)).any():
                    stack.append((child, level + 1, own[can], more[can], less[can]))
        return np.concatenate(found)


class _Node:
    """The words of a node, its queries so far, and what was found for each word."""

    def __init__(self):
        self.words, self.n, self.asked, self.asked_n, self.same = [], [], [], [], []
        self.trie, self.found = None, {}

    def note(self, word: bytes, other: bytes, n: int) -> None:
        many, best = self.found.get(word, (0, None))
        self.found[word] = many + 1, min(best or (-n, other), (-n, other))

    def search(self) -> None:
        """Look for the queries so far. Words of a node are of one length, unless keys met by chance."""
        if self.words and self.asked:
            self.trie = self.trie or Trie(self.words)
            pairs = self.trie.near(self.asked)
            asked, held = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.asked, self.words))
            a, b = asked[pairs[:, 0]], held[pairs[:, 1]]
            for n in set(a.tolist()):
                for more in (0, 1):
                    own = pairs[(a == n) & (b == n + more)]
                    if len(own):
                        own = own[one_apart(letters([self.asked[q] for q in own[:, 0]]), letters([self.words[w] for w in own[:, 1]]))]
                    for q, w in own.tolist():
                        if not self.same[q] or self.asked[q] < self.words[w]:
                            self.note(self.asked[q], self.words[w], self.n[w])
                            self.note(self.words[w], self.asked[q], self.asked_n[q])
        self.asked, self.asked_n, self.same = [], [], []


def _search(parts: Iterator) -> Iterator:
    """Rows (key, piece, asks, same, word, n), sorted, a node's words before its queries: what is near each word in each node."""
    import pyarrow as pa

    def told(done: list):
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w, _ in done], pa.string()), pa.array([x[0] for _, x in done], pa.int64()), pa.array([-x[1][0] for _, x in done], pa.int64()), pa.array([x[1][1].decode("latin-1") for _, x in done], pa.string())], names=["word", "n_near", "best_n", "best"])

    at, node, done = None, _Node(), []
    for part in parts:
        keys, pieces, asks = (part.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        same, words, n = part.column(3).to_pylist(), [w.encode("latin-1") for w in part.column(4).to_pylist()], part.column(5).to_pylist()
        new = np.flatnonzero((np.diff(keys) != 0) | (np.diff(pieces) != 0) | (np.diff(asks) != 0)) + 1
        cuts = sorted({0, part.num_rows, *new.tolist(), *range(0, part.num_rows, TOGETHER)})
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if (here := (keys[lo], pieces[lo])) != at:
                node.search()
                done.extend(node.found.items())
                at, node = here, _Node()
                if len(done) >= 10_000:
                    yield told(done)
                    done = []
            if not asks[lo]:
                node.words.extend(words[lo:hi])
                node.n.extend(n[lo:hi])
            elif node.words:
                node.asked.extend(words[lo:hi])
                node.asked_n.extend(n[lo:hi])
                node.same.extend(same[lo:hi])
                if len(node.asked) >= TOGETHER:
                    node.search()
    node.search()
    yield told([*done, *node.found.items()])


def near_words(words: DataFrame, most: int = NODE_WORDS) -> DataFrame:
    """(word, n_near, best_n, best): for each word that has any, how many words are one letter apart, and the one with the largest n
    (of equal ones the smallest in code-point order).

    words: (word, n), one row of each, of a-z and the code points C0 to FF; a written table. A node of over `most` words is held in pieces, and
    its queries go to all of them, so no task holds more. Pairs aren't written out: a node gives one row for each of its words.
    """
    keyed = words.select(node_key(F.col("word")).alias("key"), "word", "n")
    crowded = keyed.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > most).select("key", F.ceil(F.col("c") / most).cast("int").alias("pieces"))
    held = keyed.join(crowded, "key", "left").select("key", F.coalesce(F.pmod(F.xxhash64("word"), F.col("pieces")), F.lit(0)).cast("int").alias("piece"), F.lit(0).alias("asks"), F.lit(False).alias("same"), "word", "n")
    to = F.explode(F.array(*[F.struct(F.lit(x).cast("long").alias("add"), F.lit(x == 0).alias("same")) for x in routes()]))
    asked = keyed.select("key", "word", "n", to.alias("r")).select((F.col("key") + F.col("r.add")).alias("key"), "r.same", "word", "n")
    asked = asked.join(crowded, "key", "left").select("key", F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1)).alias("piece"), F.lit(1).alias("asks"), "same", "word", "n")
    both = held.unionByName(asked).repartition(n_partitions(words.sparkSession), "key", "piece").sortWithinPartitions("key", "piece", "asks")
    found = both.mapInArrow(_search, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("k"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.k")).alias("best_n"), F.col("b.best").alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root): the last form that a word's forms lead to. links: (word, form), without cycles. By pointer doubling, so rounds
    grow with the logarithm of the longest chain; forms have several times the occurrences of their words, so chains are short."""
    now = materialise(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        after = now.select(F.col("word").alias("root"), F.col("root").alias("then"))
        if now.join(after, "root", "left_semi").isEmpty():
            return now
        now = materialise(now.join(after, "root", "left").select("word", F.coalesce("then", "root").alias("root")), "roots")


def variants(words: DataFrame, times: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n): words with the form they are a variant of: the near word with the largest n, if that is at
    least `times` their own; else null. root: where the forms end; the word itself without a form. An empty table gives no rows."""
    is_form = F.col("best_n") >= times * F.col("n")
    found = words.join(near_words(words), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n"))
    found = materialise(found, "forms")
    ends = roots(found.where("form is not null"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark, sf_dir: str) -> DataFrame:
    return variants(materialise(word_counts(table(spark, sf_dir, "documents")), "vocabulary"))
