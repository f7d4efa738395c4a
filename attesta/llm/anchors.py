"""Content-defined anchors: which grams of a text stand for its windows (winnowing, Schleimer et al. 2003)."""

from __future__ import annotations

import numpy as np

#: Bytes of a gram.
GRAM = 32
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_VALUES = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
#: Texts are taken in stretches of so many window starts.
STRETCH = 1 << 18


def _power(which: str, n: int) -> np.ndarray:
    have = _powers[which]
    if len(have) < n:
        by = np.full(max(n, 2 * len(have)), _BASE if which == "up" else _INVERSE, np.uint64)
        by[0] = 1
        _powers[which] = have = np.multiply.accumulate(by)
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes:
    """Hashes of any substrings of a text, from one pass of sums."""

    def __init__(self, text: np.ndarray):
        with np.errstate(over="ignore"):
            self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_VALUES[text] * _power("up", len(text)), dtype=np.uint64)))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self.sums[end] - self.sums[start]) * _power("down", len(self.sums))[start] + (end - start).astype(np.uint64))


def window_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values in a row, by least values from both ends of blocks of that width."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    padded = padded.reshape(blocks, width)
    front = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], front[width - 1 : n])


def runs(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, key, content, first, last): runs of windows of `length` bytes with one anchor, on one side of it.

    A window's anchor is its gram with the least hash, the last of equal ones, so equal windows have their anchors at
    the same place in them. Windows with the anchor in their first half all hold a stretch behind it, the others one
    before it: the hash of that stretch is the key, and equal windows have equal keys. content: XXH3 of all the run's
    bytes, seeded with the anchor's place in them, so runs count as equal only where two hashes of different make agree (sums
    modulo 2**64 alone are equal for some regular texts); first, last: where the run's first and last windows start.
    """
    from xxhash import xxh3_64_intdigest

    half = (length - GRAM) // 2
    pieces = [(k, low, t[low : low + STRETCH + length - 1]) for k, t in enumerate(texts) for low in range(0, len(t) - length + 1, STRETCH)]
    found, k = [], 0
    while k < len(pieces):
        own, size = [], 0
        while k < len(pieces) and (not own or size + len(pieces[k][2]) <= 2 * STRETCH):
            own.append(pieces[k])
            size += len(pieces[k][2])
            k += 1
        data = np.frombuffer(b"".join(p for _, _, p in own), np.uint8)
        ends = np.cumsum([len(p) for _, _, p in own])
        hashes = Hashes(data)
        at = np.arange(len(data) - GRAM + 1)
        grams = hashes.of(at, at + GRAM)
        low_bits = np.uint64((1 << 20) - 1)
        least = window_least((grams & ~low_bits) | (low_bits - at.astype(np.uint64)), length - GRAM + 1)
        place = (low_bits - (least & low_bits)).astype(np.int64)
        start = np.arange(len(place))
        piece = np.repeat(np.arange(len(own)), np.diff(np.concatenate(([0], ends))))[: len(place)]
        late = place - start > half
        inside = start + length <= ends[piece]
        edge = np.concatenate(([True], (place[1:] != place[:-1]) | (piece[1:] != piece[:-1]) | (late[1:] != late[:-1]) | (inside[1:] != inside[:-1])))
        first = np.flatnonzero(edge)
        last = np.concatenate((first[1:] - 1, [len(place) - 1]))
        keep = inside[first]
        first, last = first[keep], last[keep]
        anchor, side = place[first], late[first]
        key = hashes.of(np.where(side, anchor - half - 1, anchor), np.where(side, anchor + GRAM, anchor + length - half)) ^ side.astype(np.uint64)
        raw, place_in = data.tobytes(), 2 * (anchor - first) + side
        content = np.array([xxh3_64_intdigest(raw[a:b], c) for a, b, c in zip(first.tolist(), (last + length).tolist(), place_in.tolist(), strict=True)], np.uint64)
        begin = np.concatenate(([0], ends[:-1]))[piece[first]]
        number = np.array([n for n, _, _ in own])[piece[first]]
        offset = np.array([low for _, low, _ in own])[piece[first]]
        found.append((number, key, content, first - begin + offset, last - begin + offset))
    if not found:
        return (np.zeros(0, np.int64), *(np.zeros(0, np.uint64),) * 2, *(np.zeros(0, np.int64),) * 2)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))
