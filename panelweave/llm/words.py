"""Hashes of words and sets of word n-grams, for many texts at once in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

MULT = np.uint64(0x9E3779B97F4A7C15)
CHUNK = 1 << 16  # bytes that are hashed at once; a longer word is hashed whole
_RATIO = 0xD1342543DE82EF95  # odd, so that it has an inverse modulo 2^64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(44).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]


class _Powers:
    """Powers of `ratio` modulo 2^64, as many as were asked for."""

    def __init__(self, ratio: int):
        self.ratio, self.known = np.uint64(ratio), np.ones(1, np.uint64)

    def first(self, n: int) -> np.ndarray:
        if len(self.known) < n:
            x = np.full(max(n, CHUNK + 1), self.ratio)
            x[0] = 1
            self.known = np.cumprod(x)
        return self.known[:n]


_UP, _DOWN = _Powers(_RATIO), _Powers(pow(_RATIO, -1, 1 << 64))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts one after the other, where each begins and the last ends); a null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    return data, at - at[0]


def _chunk(data: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where words begin, their hashes) in bytes that no word crosses the ends of."""
    n = len(data)
    space = _SPACE[data]
    apart = np.ones(n + 1, bool)  # between a byte and the one before
    apart[1:-1] = space[:-1]
    apart[firsts] = True
    starts = np.flatnonzero(~space & apart[:-1])
    apart[1:-1] = space[1:]
    apart[firsts] = True
    ends = np.flatnonzero(~space & apart[1:]) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _UP.first(n), out=total[1:])
    h = (total[ends] - total[starts]) * _DOWN.first(n)[starts]
    h ^= h >> np.uint64(32)
    h *= MULT
    return starts, h ^ (h >> np.uint64(29))


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where words ``[^\\x20\\x09-\\x0D]+`` begin, a 64-bit hash of each, A-Z in lower case), for `text_bytes`.

    The hash is a polynomial in random values of the bytes, modulo 2^64, and mixed.
    """
    starts, hashes, a = [], [], 0
    while a < len(data):
        z, step = min(a + CHUNK, len(data)), CHUNK
        while z < len(data):
            breaks = np.flatnonzero(_SPACE[data[z - step : z]])
            if len(breaks):
                z += int(breaks[-1]) + 1 - step
                break
            step = min(CHUNK, len(data) - z)
            z += step
        s, h = _chunk(data[a:z], at[np.searchsorted(at, a) : np.searchsorted(at, z, "right")] - a)
        starts.append(s + a)
        hashes.append(h)
        a = z
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(hashes)


class _WordHash:
    def __getitem__(self, word: bytes) -> int:
        return int(word_hashes(*text_bytes(pa.array([word])))[1][0])


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of every `n` words that follow each other."""
    m = max(0, len(h) - n + 1)
    out = np.full(m, n, np.uint64)
    for i in range(n):
        out ^= h[i : m + i]
        out *= MULT
        out ^= out >> np.uint64(29)
    return out


def shingles(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the word n-grams of all texts as they follow, their number in each text).

    With fewer than `n` words the whole sequence is one n-gram; with none there is none.
    The word count takes part in the hash of a short sequence, so that it equals no n-gram.
    """
    data, at = text_bytes(column)
    starts, h = word_hashes(data, at)
    first = np.searchsorted(starts, at)
    words, first = np.diff(first), first[:-1]
    count = np.where(words < n, np.minimum(words, 1), words - n + 1)
    stop = np.cumsum(count)
    full = np.where(words < n, 0, count)
    out = np.zeros(int(count.sum()), np.uint64)
    out[np.repeat(words >= n, count)] = grams(h, n)[np.arange(int(full.sum())) + np.repeat(first - np.cumsum(full) + full, full)]
    for k in range(1, n):
        who = np.flatnonzero(words == k)
        if len(who):
            out[stop[who] - 1] = grams(h, k)[first[who]]
    return out, count


def distinct(items: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The items of each set sorted, each once, and the sizes.  Sorts `items` in place."""
    ends = np.cumsum(count)
    for a, z in zip((ends - count).tolist(), ends.tolist(), strict=True):
        items[a:z].sort()
    new = np.ones(len(items), bool)
    new[1:] = items[1:] != items[:-1]
    new[(ends - count)[count > 0]] = True
    upto = np.concatenate([[0], np.cumsum(new)])
    return items[new], np.diff(upto[np.concatenate([[0], ends])])


def set_hashes(items: np.ndarray, size: np.ndarray, salt: np.ndarray | int = 0) -> np.ndarray:
    """A 64-bit hash of each set; of an empty one 0."""
    out, full = np.zeros(len(size), np.uint64), size > 0
    if len(items):
        x = (items + np.uint64(1)) * MULT
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = np.add.reduceat(x ^ (x >> np.uint64(29)), (np.cumsum(size) - size)[full])
        salt = np.broadcast_to(np.asarray(salt, np.uint64), len(size))[full]
        x = (x ^ size[full].astype(np.uint64) ^ salt) * MULT
        out[full] = x ^ (x >> np.uint64(31))
    return out.view(np.int64)


def parity_sketches(items: np.ndarray, size: np.ndarray) -> list[bytes]:
    """`trie_join.parity_sketch` of each set."""
    out: list = [b""] * len(size)
    width = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(1, size))).astype(np.int64))
    of = np.repeat(width, size)
    owner = np.repeat(np.arange(len(size)), size)
    for b in np.unique(width).tolist():
        who = np.flatnonzero(width == b)
        slot = np.zeros(len(width), np.int64)
        slot[who] = np.arange(len(who))
        mine = of == b
        at = slot[owner[mine]] * b + (items[mine] & np.uint64(b - 1)).astype(np.int64)
        raw = np.packbits(np.bincount(at, minlength=len(who) * b).astype(np.uint8) & 1, bitorder="little").tobytes()
        for j, k in enumerate(who.tolist()):
            out[k] = raw[j * b // 8 : (j + 1) * b // 8]
    return out


def binaries(items: np.ndarray, size: np.ndarray) -> pa.Array:
    """Each set as little-endian u64."""
    at = np.concatenate([[0], np.cumsum(size) * 8])
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(at.astype("<i8")), pa.py_buffer(np.ascontiguousarray(items, "<u8"))]).cast(pa.binary())
