"""Vectorised views of Arrow text columns: bytes, words, lines and their hashes.

Everything here works on the UTF-8 bytes of many documents at once. A chunk holds whole
documents only, so results never depend on how rows are batched. Memory follows the chunk:
about ``CHUNK`` bytes of text, or one document if that is longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20

_RANDOM = np.random.default_rng(20240229)
#: Bytes with A-Z as a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: A random 64-bit value for each byte, with A-Z as a-z.
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64)[LOWER]
#: The same with upper and lower case kept apart.
_RAW_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64)
_STEP = np.array([_RANDOM.integers(1, 2**63) | 1 for _ in range(8)], dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
#: Bytes that are white space.
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK + 1)
        _POWERS[:] = []
        for b in (_BASE, _INVERSE):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            _POWERS.append(np.cumprod(p, dtype=np.uint64))
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


class Chunk:
    """Some whole documents: rows ``first`` to ``last`` of the batch, their bytes and offsets."""

    def __init__(self, first: int, last: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.last, self.data, self.offsets = first, last, data, offsets
        self.n = last - first
        self._totals: dict[bool, np.ndarray] = {}

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end bytes of all words, and where each document's words begin (n + 1)."""
        ink = ~SPACE[self.data]
        starts, ends = _runs(ink, self.offsets)
        return starts, ends, np.searchsorted(starts, self.offsets)

    def letters(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Like :meth:`words`, for runs of letters: A-Z, a-z and all characters beyond ASCII."""
        starts, ends = _runs(_LETTER[self.data], self.offsets)
        return starts, ends, np.searchsorted(starts, self.offsets)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end bytes of all lines split at \\n, and where each document's lines begin."""
        breaks = np.flatnonzero(self.data == 10)
        starts = np.sort(np.concatenate([self.offsets[:-1], breaks + 1]), kind="stable")
        ends = np.sort(np.concatenate([self.offsets[1:], breaks]), kind="stable")
        per_doc = 1 + np.diff(np.searchsorted(breaks, self.offsets))
        return starts, ends, np.concatenate([[0], np.cumsum(per_doc)])

    def span_hash(self, starts: np.ndarray, ends: np.ndarray, raw: bool = False) -> np.ndarray:
        """A 64-bit hash of each span's bytes, the same wherever the span stands."""
        power, inverse = _powers(len(self.data) + 1)
        if raw not in self._totals:
            total = np.zeros(len(self.data) + 1, dtype=np.uint64)
            np.cumsum((_RAW_BYTE if raw else _BYTE)[self.data] * power[: len(self.data)], out=total[1:])
            self._totals[raw] = total
        total = self._totals[raw]
        return mix((total[ends] - total[starts]) * inverse[starts])

    def code_points(self) -> np.ndarray:
        """Code points before each byte (one more entry than bytes)."""
        total = np.zeros(len(self.data) + 1, dtype=np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=total[1:])
        return total


def _runs(ink: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``ink`` that do not cross an offset."""
    if not len(ink):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    before = np.empty_like(ink)
    before[0] = False
    before[1:] = ink[:-1]
    before[offsets[:-1][offsets[:-1] < len(ink)]] = False
    after = np.empty_like(ink)
    after[-1] = False
    after[:-1] = ink[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    return np.flatnonzero(ink & ~before), np.flatnonzero(ink & ~after) + 1


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[Chunk]:
    """The documents of an Arrow string column in order; null counts as empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64, count=column.offset + n + 1)[column.offset :]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield Chunk(i, j, whole[offs[i] : offs[j]], (offs[i : j + 1] - offs[i]).astype(np.int64))
        i = j


def shingles(hashes: np.ndarray, begins: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``size``-word windows and where each document's windows begin (n + 1).

    A document with fewer words has its whole sequence as its one window, without words none.
    """
    n_words = np.diff(begins)
    if not len(hashes):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(begins), dtype=np.int64)
    padded = np.concatenate([hashes, np.zeros(size, dtype=np.uint64)])
    at = np.zeros(len(hashes), dtype=np.uint64)
    for k in range(size):
        at += padded[k : k + len(hashes)] * _STEP[k]
    count = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
    for d in np.flatnonzero((n_words > 0) & (n_words < size)):
        own = hashes[begins[d] : begins[d + 1]]
        at[begins[d]] = (own * _STEP[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))
    word_doc_end = np.repeat(begins[:-1] + count, n_words)
    keep = np.arange(len(hashes)) < word_doc_end
    return mix(at[keep]), np.concatenate([[0], np.cumsum(count)]).astype(np.int64)


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... (count[i] numbers) for each i, one after the other."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count, count) + np.repeat(first, count)
