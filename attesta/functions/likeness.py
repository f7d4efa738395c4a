"""How like two texts are, as difflib tells it (SequenceMatcher without junk), in time that hardly grows faster than their lengths."""

from __future__ import annotations


def longest(a: str, alo: int, ahi: int, b: str, blo: int, bhi: int) -> tuple[int, int, int]:
    """(i, j, k): the longest run of k characters that a[alo:ahi] and b[blo:bhi] share, the first in a, then in b: by a suffix automaton."""
    link, size, go, last = [-1], [0], [{}], 0
    for c in b[blo:bhi]:
        new = len(size)
        size.append(size[last] + 1)
        go.append({})
        link.append(0)
        p, last = last, new
        while p >= 0 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p >= 0 and size[p] + 1 == size[q := go[p][c]]:
            link[new] = q
        elif p >= 0:
            twin = len(size)
            size.append(size[p] + 1)
            go.append(dict(go[q]))
            link.append(link[q])
            while p >= 0 and go[p].get(c) == q:
                go[p][c] = twin
                p = link[p]
            link[q] = link[new] = twin
    at, k, most, end = 0, 0, 0, alo
    for i in range(alo, ahi):
        c = a[i]
        while at and c not in go[at]:
            at = link[at]
            k = size[at]
        if c in go[at]:
            at, k = go[at][c], k + 1
        if k > most:
            most, end = k, i + 1
    return end - most, b.find(a[end - most : end], blo, bhi) if most else blo, most


def ratio(a: str, b: str) -> float:
    """2 m / (len(a) + len(b)), m being the characters of the longest run, and of the longest ones before and behind it, and so on."""
    todo, m = [(0, len(a), 0, len(b))], 0
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        if alo < ahi and blo < bhi:
            i, j, k = longest(a, alo, ahi, b, blo, bhi)
            if k:
                m += k
                todo += [(alo, i, blo, j), (i + k, ahi, j + k, bhi)]
    return 2.0 * m / (len(a) + len(b)) if a or b else 1.0
