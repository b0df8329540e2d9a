"""Word shingles and min-hashes of many texts at once, as NumPy arrays.

A word is a run of bytes other than blanks and ASCII punctuation, A-Z in lower
case, so that a changed comma or capital changes no word. A text that has nothing
but punctuation has its runs of non-blanks as words. Words are hashed by a
polynomial over their bytes, read from running sums, so that no word becomes an
object of its own. Texts are read in stretches of ``STRETCH`` bytes, cut at
blanks, whatever their length; a run of more than that without a blank is cut
at that length.

A text of fewer words than a shingle has one shingle, all of it; a text without
words, a null one too, has none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

STRETCH = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(31).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_G = np.random.default_rng(77)
_PLACE = _G.integers(1, 1 << 62, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A = _G.integers(1, 1 << 62, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _G.integers(1, 1 << 62, 256, dtype=np.uint64)


def _table(blank: bytes) -> bytes:
    lower = bytearray(range(256))
    lower[65:91] = range(97, 123)
    for c in blank:
        lower[c] = 32
    return bytes(lower)


_PLAIN = _table(bytes(range(9, 14)))
_LETTERS = _table(bytes(c for c in range(128) if not chr(c).isalnum()))


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _INVERSE):
        p = np.full(STRETCH + 1, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(29)
    return h


def _stretches(raw: bytes) -> Iterator[bytes]:
    at = 0
    while len(raw) - at > STRETCH:
        cut = raw.rfind(b" ", at, at + STRETCH)
        cut = at + STRETCH if cut <= at else cut
        yield raw[at:cut]
        at = cut
    yield raw[at:] if at else raw


def _hashed(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, its place) of at most ``STRETCH`` bytes with single-byte blanks 32."""
    flat = np.frombuffer(raw, np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate(([False], flat != 32, [False])).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    up, down = _powers()
    total = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(_BYTE[flat] * up[: len(flat)], out=total[1:])
    return mixed((total[end] - total[start]) * down[start]), start


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one text after another, and how many words each has."""
    count = np.zeros(len(texts), np.int64)
    found: list[np.ndarray] = []
    held: list[bytes] = []
    owner: list[int] = []
    n = 0

    def flush() -> None:
        if held:
            h, start = _hashed(b" ".join(held))
            size = np.array([len(r) + 1 for r in held])
            of = np.searchsorted(np.cumsum(size), start, side="right")
            np.add.at(count, np.array(owner)[of], 1)
            found.append(h)
            held.clear()
            owner.clear()

    for i, t in enumerate(texts):
        raw = t.encode() if t else b""
        if not raw:
            continue
        text = raw.translate(_LETTERS)
        if text.isspace():
            text = raw.translate(_PLAIN)
        for part in _stretches(text):
            if n + len(part) + 1 > STRETCH:
                flush()
                n = 0
            held.append(part)
            owner.append(i)
            n += len(part) + 1
    flush()
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)), count


def shingle_sets(texts: list[str | None], words: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, count, least word): the distinct 32-bit hashes of each text's shingles, sorted in each text, one text after
    another; how many each has; and the least word hash of each (all ones without words)."""
    h, n = word_hashes(texts)
    first = np.cumsum(n) - n
    least = np.full(len(texts), ~np.uint64(0))
    if not len(h):
        return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64), least
    some = np.flatnonzero(n)
    least[some] = np.minimum.reduceat(h, first[some])
    keys = []
    many = np.flatnonzero(n >= words)
    size = n[many] - words + 1
    step = 1 << 22
    for lo in range(0, len(h), step):
        # shingles that start in this stretch of words
        a, z = np.maximum(first[many], lo), np.minimum(first[many] + size, lo + step)
        go = a < z
        if not go.any():
            continue
        k = (z - a)[go]
        at = np.repeat(a[go] - (np.cumsum(k) - k), k) + np.arange(k.sum())
        s = h[at] * _PLACE[0]
        for j in range(1, words):
            s += h[at + j] * _PLACE[j]
        keys.append(np.repeat(many[go].astype(np.uint64) << np.uint64(32), k) | mixed(s) >> np.uint64(32))
    few = np.flatnonzero((n > 0) & (n < words))
    if len(few):
        s = np.zeros(len(few), np.uint64)
        for j in range(words - 1):
            on = n[few] > j
            s[on] += h[first[few[on]] + j] * _PLACE[j]
        keys.append(few.astype(np.uint64) << np.uint64(32) | mixed(s) >> np.uint64(32))
    key = np.concatenate(keys)
    key.sort()
    if len(key) > 1:
        key = key[np.append(True, key[1:] != key[:-1])]
    of = (key >> np.uint64(32)).astype(np.int64)
    return key.astype(np.uint32), np.bincount(of, minlength=len(texts)), least


def min_hashes(values: np.ndarray, count: np.ndarray, ways: int) -> np.ndarray:
    """(texts, ways): the least value of each text's set under as many orders; all ones for empty sets."""
    low = np.full((len(count), ways), ~np.uint64(0))
    some = np.flatnonzero(count)
    if len(some):
        first = (np.cumsum(count) - count)[some]
        v = values.astype(np.uint64)
        x = np.empty_like(v)
        for k in range(ways):
            np.multiply(v, _A[k], out=x)
            x += _B[k]
            low[some, k] = np.minimum.reduceat(x, first)
    return low


def band_keys(low: np.ndarray, rows: int) -> np.ndarray:
    """(texts, bands): a key of each ``rows`` min-hashes next to each other, different for different bands."""
    bands = low.shape[1] // rows
    return (low.reshape(len(low), bands, rows) * _PLACE[:rows]).sum(2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64)


def lists(rows: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as lists."""
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(rows).ravel()))


def parts(values: np.ndarray, count: np.ndarray) -> Iterator[bytes]:
    """The set of each text as bytes, 32 bits a value."""
    raw, end = values.tobytes(), 0
    for n in count.tolist():
        begin, end = end, end + 4 * n
        yield raw[begin:end]


def sliced(texts: list[str | None], chars: int = 500_000) -> Iterator[list[str | None]]:
    """Runs of texts of about ``chars`` characters, each text whole."""
    out, n = [], 0
    for t in texts:
        out.append(t)
        n += len(t or "")
        if n >= chars:
            yield out
            out, n = [], 0
    if out:
        yield out
