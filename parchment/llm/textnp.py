"""Words of many texts at once: numpy over the bytes of an Arrow column, no Python loop per word."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

STEP = 1 << 20  # bytes hashed at a time
_u = np.uint64

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """splitmix64's finaliser: 64 well mixed bits from any 64."""
    with np.errstate(over="ignore"):
        x = np.asarray(x, _u) + _u((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> _u(30))) * _u(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _u(27))) * _u(0x94D049BB133111EB)
        return x ^ (x >> _u(31))


BYTES = mix(np.arange(256), 7) | _u(1)
BASE = 0x5851F42D4C957F2D  # odd, so that it has an inverse modulo 2^64


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i for i < n."""
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.full(n, base, _u)
        p[0] = 1
        with np.errstate(over="ignore"):
            out.append(np.multiply.accumulate(p))
    return out[0], out[1]


#: ASCII white space, control characters and punctuation.
MARKS = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


class Words(NamedTuple):
    doc: np.ndarray  # index of the text
    start: np.ndarray  # byte positions in buf
    end: np.ndarray
    hash: np.ndarray  # 64 bits of the word


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n+1 offsets; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    if offsets is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def blocks(column: pa.Array, limit: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, bytes, offsets) of runs of texts of about limit bytes together, or of a single longer one."""
    buf, offs = buffers(column)
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j, buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def words(buf: np.ndarray, offs: np.ndarray, lower: bool = True, between: np.ndarray = SPACE) -> Words:
    """Runs of bytes other than those between words (ASCII white space); none spans two texts."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(z, z, z, np.zeros(0, _u))
    if lower:
        buf = LOWER[buf]
    gap = between[buf]
    first = np.zeros(n + 1, bool)
    first[offs] = True
    before = np.empty(n + 1, bool)
    before[0], before[1:] = True, gap
    here = np.empty(n + 1, bool)
    here[:n], here[n] = gap, True
    start = np.flatnonzero(~here & (before | first))
    end = np.flatnonzero(~before & (here | first))
    del gap, first, before, here
    h = np.empty(len(start), _u)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(start):
            j = max(i + 1, int(np.searchsorted(end, start[i] + STEP, "right")))
            a, b = int(start[i]), int(end[j - 1])
            up, down = _powers(1 << max(20, int(b - a).bit_length()))
            c = np.zeros(b - a + 1, _u)
            np.cumsum(BYTES[buf[a:b]] * up[: b - a], out=c[1:])
            h[i:j] = (c[end[i:j] - a] - c[start[i:j] - a]) * down[start[i:j] - a]
            i = j
        h = mix(h + (end - start).astype(_u))
    doc = np.searchsorted(offs, start, "right") - 1
    return Words(doc, start, end, h)


def word_hash(word: bytes) -> int:
    """The hash that words() gives to this one word (already lower case)."""
    return int(words(np.frombuffer(word, np.uint8), np.array([0, len(word)]), lower=False).hash[0])


def shingles(w: Words, docs: int, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text, 64-bit hash) of each run of size words; a shorter text with words has one shingle, of all its words."""
    n = len(w.doc)
    if not n:
        return w.doc, w.hash
    per = np.bincount(w.doc, minlength=docs)
    h = np.zeros(n, _u)
    with np.errstate(over="ignore"):
        for k in range(min(size, n)):
            part = np.zeros(n, _u)
            part[: n - k] = w.hash[k:]
            last = np.zeros(n, w.doc.dtype)
            last[: n - k] = w.doc[k:]
            same = np.zeros(n, bool)
            same[: n - k] = last[: n - k] == w.doc[: n - k]
            h = np.where(same, h * _u(BASE) + part, h)
        h = mix(h, 3)
    firsts = np.cumsum(per) - per
    left = np.repeat(firsts + per, per) - np.arange(n)  # words from here to the text's end
    take = (left >= size) | ((np.arange(n) == np.repeat(firsts, per)) & (np.repeat(per, per) < size))
    return w.doc[take], h[take]


#: Classes of bytes in a word's shape: small and other letters, capitals, digits; marks stand for themselves.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[97:123] = SHAPE[128:] = ord("a")
SHAPE[65:91] = ord("A")
SHAPE[48:58] = ord("0")


def shape_hash(buf: np.ndarray, w: Words) -> np.ndarray:
    """A hash of each word's shape: its classes of bytes, runs of one class counting once."""
    if not len(w.doc):
        return w.hash
    kind = SHAPE[buf]
    new = np.ones(len(buf), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[w.start] = True
    inside = np.zeros(len(buf) + 1, np.int8)
    inside[w.start] += 1
    inside[w.end] -= 1
    runs = np.flatnonzero(new & (np.cumsum(inside[:-1], dtype=np.int8) > 0))
    first = np.searchsorted(runs, w.start)
    place = np.minimum(np.arange(len(runs)) - np.repeat(first, np.diff(np.append(first, len(runs)))), 63)
    with np.errstate(over="ignore"):
        return mix(np.add.reduceat(BYTES[kind[runs]] * _powers(64)[0][place], first), 5)


def per_text(doc: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of values by text."""
    return np.bincount(doc, values, n)
