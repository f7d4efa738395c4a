"""Suffix arrays by grouping: a linear construction without recursion or renaming (after Baier 2016).

First, suffixes are grouped by their Lyndon prefix: groups are taken in descending order, and each member lifts the
nearest smaller-grouped position before it into a new, higher group of its own. Then the groups' order gives the
suffixes' order: from the smallest suffix on, every suffix places those before it whose Lyndon prefix ends at it.

Long texts are sorted so through phrases (prefix-free parsing, Boucher et al. 2019): the grouping orders a text of phrases,
which is many times shorter, and every suffix follows from its first phrase and the place of the rest.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np

#: Bytes that end a phrase, and how many places in a power of two end one.
TRIGGER, APART = 4, 5
#: Phrases of more bytes for each byte of the text aren't written out.
PHRASE_BYTES = 128


def suffix_array(text: list[int]) -> list[int]:
    """Positions of text's suffixes in order. text: numbers from 1 up; a 0 is put behind it and not returned."""
    s = [*text, 0]
    n = len(s)
    size = [0] * (max(s) + 2)
    for c in s:
        size[c + 1] += 1
    begin = list(accumulate(size))
    free = begin[:]
    order, place, group = [0] * n, [0] * n, [0] * n
    members = [0] * n  # of the group that starts there
    for i, c in enumerate(s):
        at = free[c]
        free[c] = at + 1
        order[at], place[i], group[i] = i, at, begin[c]
        members[begin[c]] += 1
    before = [-1] * n

    end = n - 1
    while end > 0:
        start = group[order[end]]
        if start == end:  # one member: the usual case
            i = order[end]
            p = i - 1
            while p >= 0 and group[p] > start:
                p = before[p]
            before[i] = p
            if p >= 0:
                h = group[p]
                m = members[h]
                if m > 1:
                    members[h] = m - 1
                    to = h + m - 1
                    members[to] = 1
                    at = place[p]
                    other = order[to]
                    order[at], place[other] = other, at
                    order[to], place[p], group[p] = p, to, to
        else:
            counts: dict[int, int] = {}
            for i in sorted(order[start : end + 1]):
                p = i - 1
                while p >= 0 and group[p] > start:
                    p = before[p]
                if p >= 0 and group[p] == start:
                    p = before[p]
                before[i] = p
                if p >= 0:
                    counts[p] = counts.get(p, 0) + 1
            by_count: dict[int, list[int]] = {}
            for p, k in counts.items():
                by_count.setdefault(k, []).append(p)
            for k in sorted(by_count, reverse=True):
                lifted: dict[int, list[int]] = {}
                for p in by_count[k]:
                    lifted.setdefault(group[p], []).append(p)
                for h, own in lifted.items():
                    m = members[h]
                    if len(own) == m:
                        continue
                    members[h] = m - len(own)
                    to = h + m
                    for p in own:
                        to -= 1
                        at = place[p]
                        other = order[to]
                        order[at], place[other] = other, at
                        order[to], place[p] = p, to
                    members[to] = len(own)
                    for p in own:
                        group[p] = to
        end = start - 1

    next_free = list(range(n))  # of the group that starts there
    placed = [False] * n
    order[0], placed[n - 1] = n - 1, True
    for k in range(n):
        i = order[k] - 1
        while i >= 0 and not placed[i]:
            h = group[i]
            at = next_free[h]
            next_free[h] = at + 1
            order[at] = i
            placed[i] = True
            i = before[i]
    return order[1:]


def sorted_suffixes(pieces: list[bytes]) -> np.ndarray:
    """Positions of all suffixes of the pieces in order, one place behind each piece being its end. An end is smaller
    than all bytes and a symbol of its own, those of earlier pieces being smaller.

    A phrase goes from any position to the end of the next trigger (TRIGGER bytes chosen by their content) or of the piece.
    No phrase begins with another, so suffixes are ordered by their first phrases and then as the suffixes at the triggers
    that end these; the latter are a text of phrases, sorted by suffix_array.
    """
    raw = b"\0".join([*pieces, b""])
    data, sizes = np.frombuffer(raw, np.uint8), np.array([len(x) for x in pieces])
    ends = np.cumsum(sizes + 1) - 1
    piece = np.repeat(np.arange(len(pieces)), sizes + 1)
    grams = np.zeros(max(0, len(data) - TRIGGER + 1), np.uint32)
    for k in range(TRIGGER):
        grams = grams * np.uint32(0x01000193) ^ data[k : k + len(grams)]
    grams *= np.uint32(0x9E3779B1)
    chosen = np.flatnonzero(grams >> np.uint32(32 - APART) == 0)
    triggers = chosen[chosen + TRIGGER <= ends[piece[chosen]]]
    at = np.delete(np.arange(len(data)), ends)
    following = np.searchsorted(triggers, at, side="right")
    trigger = np.append(triggers, len(data))[following]
    last = trigger > ends[piece[at]]  # no trigger follows in the piece
    stop = np.where(last, ends[piece[at]], trigger + TRIGGER)
    if (stop - at).sum() > PHRASE_BYTES * len(data):
        text = data.astype(np.int64) + len(pieces) + 1
        text[ends] = np.arange(len(pieces)) + 1
        order = np.array(suffix_array(text.tolist()))
        return order[~np.isin(order, ends)]
    phrases = [raw[a:b] for a, b in zip(at.tolist(), stop.tolist(), strict=True)]
    number = {x: k for k, x in enumerate(sorted(set(phrases)))}
    name = np.array([number[x] for x in phrases], np.int64) * (len(pieces) + 1) + np.where(last, piece[at] + 1, 0)
    place = np.zeros(len(triggers) + 1, np.int64)
    if len(triggers):
        _, text = np.unique(name[np.searchsorted(at, triggers)], return_inverse=True)
        place[np.array(suffix_array((text + 1).tolist()))] = np.arange(len(triggers))
    return at[np.lexsort((np.where(last, 0, place[following]), name))]
