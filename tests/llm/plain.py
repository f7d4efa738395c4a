"""Plain versions of the operators' contracts, for tests on small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict


def lower(text: str) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def shingles(text: str | None) -> set:
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def jaccard_classes(rows: list[tuple]) -> dict:
    """{doc_id: (n_shingles, component_id)} by testing all pairs that share a shingle."""
    sets = {i: shingles(t) for i, t in rows}
    boss = {i: i for i in sets}

    def find(i):
        while boss[i] != i:
            i = boss[i]
        return i

    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    shared = Counter((a, b) for own in where.values() for k, a in enumerate(own) for b in own[k + 1 :])
    for (a, b), n in shared.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            boss[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def contamination(docs: list[tuple], items: list[tuple]) -> dict:
    """{doc_id: (n_words, n_hit, n_items, sha, contaminated)}"""
    rx = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for item, text in items:
        words = rx.findall(lower(text or ""))
        for k in range(max(1, len(words) - 12) if words else 0):
            windows[tuple(words[k : k + 13])].add(str(item))
    sizes = {len(w) for w in windows}
    out = {}
    for i, text in docs:
        words, hit, found = rx.findall(lower(text or "")), set(), set()
        for n in sizes:
            for k in range(len(words) - n + 1):
                if own := windows.get(tuple(words[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= own
        out[i] = (len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words))
    return out


def tokens(text: str | None) -> list[int]:
    import public_tokenizers as P
    from tokenizers import Tokenizer

    if not hasattr(tokens, "t"):
        tokens.t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return tokens.t.encode(text or "", add_special_tokens=False).ids


def crc(ids: list[int]) -> int:
    return zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))


def repeats(docs: list[tuple], length: int) -> dict:
    """{doc_id: (n_bytes, n_removed, n_spans, sha of what stays)}"""
    texts = {i: (t or "").encode() for i, t in docs}
    n = Counter(t[k : k + length] for t in texts.values() for k in range(len(t) - length + 1))
    out = {}
    for i, t in texts.items():
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if n[t[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out[i] = (len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def spelling(rows: list[tuple]) -> dict:
    """{word: (form, root, n, n_near, form_n)} by looking at all strings one letter less."""
    n: Counter = Counter()
    for i, text in rows:
        for run in map(lower, re.findall("[A-Za-z\u00C0-\u00FF]+", text or "")):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            k = h % len(run)
            n[run if h % 199 else run[:k] + run[k + 1 :]] += 1
    words = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    shorter, near = defaultdict(set), defaultdict(set)
    for w in words:
        for k in range(len(w)):
            shorter[w[:k] + w[k + 1 :]].add((w, k))
    for x, longer in shorter.items():
        for w, k in longer:
            if x in words:
                near[w].add(x)
                near[x].add(w)
            near[w] |= {v for v, j in longer if j == k and v != w}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda v: (-words[v], v), default=None)
        if best and words[best] >= 5 * words[w]:
            form[w] = best

    def root(w: str) -> str:
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), c, len(near[w]), words[form[w]] if w in form else None) for w, c in words.items()}


SPACE = " \t\n\x0b\x0c\r"


def spoilt(rows: list[tuple]) -> dict:
    """{conv_id: rows (turn, role, text) after the planted faults, in order}"""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        conv_, turn_, role, text = (" " if x is None else x for x in (conv, turn, role, text))
        h = zlib.crc32(f"{conv_}:{turn_}".encode()) % 20
        if h:
            text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
            out[conv] += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return {c: sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest())) for c, x in out.items()}


def repair(rows: list[tuple]) -> tuple:
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, sha) by keeping the best edits for each state, a row at a time."""
    turn, role, then = "uuau", {"u": "user", "a": "assistant"}, [2, 2, 3, 2]
    n = {"blank": 0, "duplicate": 0, "truncated": 0}

    def better(best: dict, state: int, way: tuple) -> None:
        if state not in best or way[:2] < best[state][:2]:
            best[state] = way

    def with_insertions(best: dict) -> dict:
        for _ in range(4):
            for q, (c, a, t) in list(best.items()):
                better(best, then[q], (c + 5, a + "I", (*t, (role[turn[q]], ""))))
        return best

    best, seen = with_insertions({0: (0, "", ())}), set()
    for _, r, x in rows:
        bare = x.strip(SPACE)
        fault = "blank" if not bare else "duplicate" if (r, x) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((r, x))
        if fault:
            n[fault] += 1
        after: dict = {}
        for q, (c, a, t) in best.items():
            better(after, q, (c + 2, a + "D", t))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault else 0
                if r[:1] == "s" and q == 0:
                    better(after, 1, (c + more, a + "K", (*t, (r, x))))
                if r[:1] == turn[q]:
                    better(after, then[q], (c + more, a + "K", (*t, (r, x))))
                better(after, then[q], (c + 1 + more, a + "R", (*t, (role[turn[q]], x))))
        best = with_insertions(after)
    cost, audit, made = min((best[q] for q in (0, 3) if q in best), key=lambda w: w[:2])
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in made).encode()).hexdigest()


def repairs(rows: list[tuple]) -> dict:
    own = spoilt(rows)
    return {c: repair(own.get(c, [])) for c in {r[0] for r in rows}}
