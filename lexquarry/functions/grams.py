"""Sparse grams of byte texts, vectorised: windows of 3 to 16 bytes whose two border pairs outweigh every pair between them.

A text lies between two line feeds, so that its ends are grams like any other. Whether a window is a gram depends on its own
bytes alone: a literal's grams are in every text that holds it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from lexquarry.functions.hashing import folded, mix, powers

SHORTEST, LONGEST = 3, 16
SENTINEL = 10
_POWERS = powers(LONGEST)
BLOCK = 1 << 17
BLOCK_BITS, WORD_START, WORD_END, WORD_BOTH, LINE_START, LINE_END = 31, 32, 64, 128, 256, 512
BUCKETS = 5

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_WORD = np.zeros(256, bool)
for _c in b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_":
    _WORD[_c] = True


def windows(stream: np.ndarray, weights: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(length, starts) of all grams of a stream of bytes, in blocks that fit the processor's cache."""
    found: dict[int, list[np.ndarray]] = {n: [] for n in range(SHORTEST, LONGEST + 1)}
    pairs = (stream[:-1].astype(np.uint16) << 8) | stream[1:] if len(stream) > 1 else np.zeros(0, np.uint16)
    for at in range(0, max(len(pairs) - 1, 0), BLOCK):
        w = weights[pairs[at : at + BLOCK + LONGEST - 2]]
        inside = None
        for n in range(SHORTEST, LONGEST + 1):
            last = n - 2  # distance of the border pairs
            size = min(BLOCK, len(w) - last)
            if size <= 0:
                break
            if n == SHORTEST:
                starts = np.arange(size)
            else:
                inside = w[1 : 1 + size].copy() if inside is None else np.maximum(inside[:size], w[last - 1 : last - 1 + size])
                starts = np.flatnonzero(np.minimum(w[:size], w[last : last + size]) > inside)
            if len(starts):
                found[n].append(starts + at)
    return [(n, np.concatenate(s)) for n, s in found.items() if s]


def prefix_hashes(stream: np.ndarray) -> np.ndarray:
    """Sums of bytes times falling powers of the base, from which keys() gets any window's polynomial."""
    down = _up(len(stream) + 1)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(stream.astype(np.uint64) * down[1 : len(stream) + 1], dtype=np.uint64)])


_CACHE: dict[str, np.ndarray] = {}
_INVERSE = pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def _up(n: int) -> np.ndarray:
    """Powers of the base's inverse: byte i of a stream has the factor base**-i."""
    have = _CACHE.get("down")
    if have is None or len(have) < n:
        m = max(n, 1 << 16)
        down = np.full(m, _INVERSE, np.uint64)
        down[0] = 1
        up = powers(m)
        _CACHE["down"], _CACHE["up"] = np.cumprod(down), up
    return _CACHE["down"][:n]


def keys(stream_hash: np.ndarray, starts: np.ndarray, n: int, secret: int) -> np.ndarray:
    """Keys of the windows of n bytes at `starts`: polynomial with leading 1, secret, finalizer."""
    ends = starts + n
    raw = (stream_hash[ends] - stream_hash[starts]) * _CACHE["up"][ends]
    return mix((raw + _POWERS[n]) ^ np.uint64(secret))


@dataclass
class Grams:
    """Grams of a run of texts: row of each, key, and its place in the row's text (clamped to it)."""

    row: np.ndarray
    key: np.ndarray
    start: np.ndarray
    end: np.ndarray
    folded: np.ndarray


NO_GRAMS = Grams(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))


def streamed(content: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts, each between two line feeds, end to end; and where each begins, its first line feed counted in."""
    n = len(offsets) - 1
    begins = offsets[:-1] + 2 * np.arange(n)
    out = np.full(int(offsets[-1] - offsets[0]) + 2 * n, SENTINEL, np.uint8)
    if len(content):
        shift = np.repeat(2 * np.arange(n) + 1, np.diff(offsets))
        out[np.arange(len(content)) + shift] = content
    return out, np.append(begins, len(out))


def extract(content: np.ndarray, offsets: np.ndarray, weights: np.ndarray, secret: int = 0, fold: bool = True) -> Grams:
    """All grams of all texts, those of the folded text that cover an upper-case letter too. Sorted by nothing."""
    stream, begins = streamed(content, offsets)
    parts = []
    row_of = np.repeat(np.arange(len(begins) - 1, dtype=np.int32), np.diff(begins))
    _up(len(stream) + LONGEST + 1)
    for is_folded in (False, True) if fold else (False,):
        s = _LOWER[stream] if is_folded else stream
        if is_folded:
            upper = _UPPER[stream]
            if not upper.any():
                continue
            changed = np.concatenate([[0], np.cumsum(upper)])
        h = prefix_hashes(s)
        for n, starts in windows(s, weights):
            if is_folded:
                starts = starts[changed[starts + n] > changed[starts]]
            row = row_of[starts]
            ok = row_of[starts + n - 1] == row
            starts, row = starts[ok], row[ok]
            if not len(starts):
                continue
            k = keys(h, starts, n, folded(secret) if is_folded else secret)
            at = starts - begins[row] - 1
            size = (begins[1:] - begins[:-1] - 2)[row]
            a, b = np.clip(at, 0, size), np.clip(at + n, 0, size)
            parts.append((row, k, a, b, np.full(len(row), is_folded)))
    if not parts:
        return NO_GRAMS
    row, k, a, b, f = (np.concatenate(x) for x in zip(*parts))
    keep = np.diff(offsets)[row] > 0  # an empty text has no grams
    return Grams(row[keep], k[keep], a[keep], b[keep], f[keep])


def literal_grams(text: bytes, weights: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the grams of a literal, which stands alone."""
    s = np.frombuffer(text, np.uint8)
    return sorted((int(a), int(a) + n) for n, starts in windows(s, weights) for a in starts if a + n <= len(s))


def maximal_grams(text: bytes, weights: np.ndarray) -> list[tuple[int, int]]:
    """The literal's grams that lie in no other of its grams: they imply all the others."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(literal_grams(text, weights), key=lambda g: (g[0], -g[1])):
        if not out or b > out[-1][1]:
            out.append((a, b))
    return out


def minimal_cover(text: bytes, weights: np.ndarray) -> list[tuple[int, int]]:
    """As few of the literal's grams as cover it from end to end: from each place the one that reaches furthest."""
    grams = maximal_grams(text, weights)
    out: list[tuple[int, int]] = []
    reach, i = 0, 0
    while grams and reach < len(text):
        best = None
        while i < len(grams) and grams[i][0] <= max(reach - 1, 0):
            best, i = grams[i], i + 1
        if best is None or best[1] <= reach:
            break
        out.append(best)
        reach = best[1]
    return out


def line_buckets(lines: np.ndarray) -> np.ndarray:
    """One of five bits for each line number."""
    mixed = (lines.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    return (np.uint16(1) << (mixed % np.uint64(BUCKETS)).astype(np.uint16)).astype(np.uint16)


def masks(g: Grams, content: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each gram the bits of the lines that it touches (all of them from five lines' distance on), and whether words and
    lines begin and end at its ends."""
    if not len(g.row):
        return np.zeros(0, np.uint16)
    base = offsets[g.row]
    start, end, stop = base + g.start, base + g.end, offsets[g.row + 1]
    feeds = np.zeros(len(content) + 1, np.int32)  # before each byte
    np.cumsum(content == SENTINEL, out=feeds[1:])
    before = feeds[offsets[:-1]][g.row]  # in the texts before
    last = feeds[np.maximum(end - 1, start)] - before
    first = feeds[start] - before
    bucket = line_buckets(np.arange(int(last.max()) + 1))
    out = bucket[first]
    longer = np.flatnonzero(last > first)
    for step in range(1, BUCKETS):
        longer = longer[first[longer] + step <= last[longer]]
        out[longer] |= bucket[first[longer] + step]
    out[last - first >= BUCKETS] = BLOCK_BITS
    padded = np.append(content, np.zeros(2, np.uint8))
    no_before, no_after = start <= base, end >= stop
    b, a = padded[np.maximum(start - 1, 0)], padded[np.minimum(end, len(content))]
    a2 = padded[np.minimum(end + 1, len(content))]
    word_start, word_end = no_before | ~_WORD[b], no_after | ~_WORD[a]
    line_start = no_before | (b == 10)
    line_end = no_after | (a == 10) | ((a == 13) & ((end + 1 >= stop) | (a2 == 10)))
    out |= np.where(word_start, WORD_START, 0).astype(np.uint16) | np.where(word_end, WORD_END, 0).astype(np.uint16)
    out |= np.where(word_start & word_end, WORD_BOTH, 0).astype(np.uint16)
    out |= np.where(line_start, LINE_START, 0).astype(np.uint16) | np.where(line_end, LINE_END, 0).astype(np.uint16)
    return out


def collapse(g: Grams, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, mask) once for each row and key, masks joined."""
    if not len(g.row):
        return g.row, g.key, mask
    rows = int(g.row.max()) + 1
    order = np.argsort(g.row.astype(np.uint16) if rows <= 1 << 16 else g.row, kind="stable")
    bounds = np.concatenate([[0], np.cumsum(np.bincount(g.row, minlength=rows))])
    key = g.key[order]
    for a, b in zip(bounds, bounds[1:]):  # each row's grams by key
        if b > a:
            inner = np.argsort(key[a:b])
            order[a:b] = order[a:b][inner]
            key[a:b] = key[a:b][inner]
    row, m = g.row[order], mask[order]
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (key[1:] != key[:-1])])
    at = np.flatnonzero(new)
    return row[at], key[at], np.bitwise_or.reduceat(m, at)
