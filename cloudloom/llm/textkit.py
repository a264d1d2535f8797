"""Vectorised word and byte hashing for Arrow string batches.

A word is a maximal run of bytes outside ``\\x20`` and ``\\x09-\\x0D``, with A-Z lower-cased.
Hashes are 64-bit polynomial prefix hashes over a fixed random byte table, so every word, shingle
or byte window of a whole batch costs a few array operations and no per-row Python.
Long texts are never cut: a batch is processed in slices of about ``SLICE_BYTES``, and one text
longer than that is a slice of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import wraps

import numpy as np
import pyarrow as pa

SLICE_BYTES = 512 << 10  # a task takes some hundred bytes for each, and keeps power tables of their length
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = np.random.default_rng(20240229).integers(1, 2**63, size=256, dtype=np.int64).astype(U64) | U64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BREAK = _SPACE.copy()
_BREAK[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_tables = np.ones(1, dtype=U64), np.ones(1, dtype=U64)  # of _power_tables


def trimmed(f: Callable) -> Callable:
    """A task's iterator that gives freed memory back at its end: Python workers live on, and idle ones would keep it."""

    @wraps(f)
    def run(*args, **kwargs) -> Iterator:
        yield from f(*args, **kwargs)
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return run


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n, grown by doubling and kept per process; both change together, for threads of the driver."""
    global _tables
    powers, inverse = _tables
    while len(powers) < n:
        m = len(powers)
        step, back = U64(pow(_BASE, m, 1 << 64)), U64(pow(_BASE, -m, 1 << 64))
        with np.errstate(over="ignore"):
            powers = np.concatenate([powers, powers * step])
            inverse = np.concatenate([inverse, inverse * back])
        _tables = powers, inverse
    return powers, inverse


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser; spreads polynomial hashes over all bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
        return h ^ (h >> U64(31))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with H[i] = sum of table[data[j]] * base**j over j < i."""
    powers, _ = _power_tables(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=U64)
    with np.errstate(over="ignore"):
        np.cumsum(_TABLE[data] * powers[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], equal for equal bytes wherever they stand."""
    _, inverse = _power_tables(len(prefix))
    with np.errstate(over="ignore"):
        return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(U64))


@dataclass
class Words:
    """Words of a slice of texts: hash, byte span within the text, and the words of text i at first[i]:first[i+1]."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string array; null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) pieces of at most ``limit`` bytes, or one longer text."""
    if len(texts) == 0:
        return
    data, offsets = text_buffer(texts)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray, loose: bool = False) -> Words:
    """All words of the texts that data and offsets hold; words never cross texts. ``loose``: ASCII punctuation parts words too."""
    n = len(data)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return Words(np.zeros(0, U64), empty, empty, np.zeros(len(offsets), np.int64))
    inside = ~(_BREAK if loose else _SPACE)[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offsets)
    hashes = span_hash(prefix_hash(_LOWER[data]), start, end)
    base = np.repeat(offsets[:-1], np.diff(first))
    return Words(hashes, start - base, end - base, first)


def gram_hash(word: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive word hashes (over text borders too; see ``grams``)."""
    m = max(0, len(word) - n + 1)
    out = np.zeros(m, dtype=U64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * U64(0xD6E8FEB86659FD93) + word[k : k + m]
    return mix(out)


def grams(w: Words, n: int, short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, word position in its text) of all n-grams within texts.

    With ``short`` a text of 1 to n-1 words gives its whole sequence as one gram.
    """
    count = np.diff(w.first)
    hashes = gram_hash(w.hash, n)
    doc = w.doc
    at = np.arange(len(w.hash)) - np.repeat(w.first[:-1], count)
    ok = at[: len(hashes)] + n <= np.repeat(count, count)[: len(hashes)]
    hashes, d, p = hashes[ok], doc[: len(ok)][ok], at[: len(ok)][ok]
    if short:
        few = np.flatnonzero((count > 0) & (count < n))
        if len(few):
            extra = np.array([gram_hash(w.hash[w.first[i] : w.first[i + 1]], int(count[i]))[0] for i in few], dtype=U64)
            hashes, d, p = np.concatenate([hashes, extra]), np.concatenate([d, few]), np.concatenate([p, np.zeros(len(few), np.int64)])
            order = np.argsort(d, kind="stable")
            hashes, d, p = hashes[order], d[order], p[order]
    return hashes, d, p
