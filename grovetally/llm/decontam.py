"""Benchmark decontamination by q-gram lemma filtering.

A text within k edits of a pattern of m characters shares at least m + 1 - (k + 1) q of its
q-grams, all near one diagonal (place in the document less place in the pattern). Shared
q-grams are counted in diagonal bands of width ``BAND`` that overlap by half, bands that
reach the bound are kept, and banded alignment of the pattern with that region decides.

Texts are compared in lower case (Latin and Cyrillic) and with white space runs as one space. Patterns are the
benchmark items; items longer than ``PIECE`` are cut into pieces that overlap by half, so any part of
one and a half ``PIECE`` is found as well. k is ``EDITS`` of a pattern's characters (bytes of UTF-8).

The index of the benchmark is broadcast in blocks of at most ``BLOCK`` characters: a larger
benchmark takes several passes over the documents, never a larger broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import col, fresh, map_arrow, schema_of, written
from ._text import Chunk, chunks, spread

Q, EDITS, PIECE, BAND, BLOCK = 12, 0.05, 128, 32, 1 << 22
#: Pairs of equal q-grams that are formed at a time.
PAIRS = 1 << 18
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32
_BITS = 22


def fold(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with A-Z and the capitals of Latin-1 and Cyrillic lower-cased, all white space
    as spaces. No character changes its length."""
    out, lead = _FOLD[data], data[:-1]
    tail = out[1:]
    latin = (lead == 0xC3) & (tail >= 0x80) & (tail <= 0x9E) & (tail != 0x97)
    first = (lead == 0xD0) & (tail >= 0x90) & (tail <= 0x9F)
    second = (lead == 0xD0) & (tail >= 0xA0) & (tail <= 0xAF)
    tail[latin | first] += 0x20
    tail[second] -= 0x20
    out[:-1][second] = 0xD1
    return out


def normal(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes with white space runs (not across documents) as one space."""
    if not len(data):
        return data, offsets
    space = _SPACE[data]
    again = np.zeros(len(data), dtype=bool)
    again[1:] = space[1:] & space[:-1]
    again[offsets[:-1][offsets[:-1] < len(data)]] = False
    kept = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(~again, out=kept[1:])
    return fold(data[~again]), kept[offsets]


def normal_text(text: str | None) -> str:
    """One text as it is compared."""
    raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
    return normal(raw, np.array([0, len(raw)]))[0].tobytes().decode()


def grams(data: np.ndarray) -> np.ndarray:
    """A 64-bit number for the Q bytes from each place on."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    data = np.ascontiguousarray(data)
    head = np.ndarray((n,), dtype="<u8", buffer=data, strides=(1,))
    tail = np.ndarray((n,), dtype="<u4", buffer=data, offset=8, strides=(1,))
    return head * np.uint64(0x9E3779B97F4A7C15) + tail.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass
class Index:
    """Patterns and their q-grams: ``gram`` in order, standing at ``place`` of pattern ``owner``."""

    items: np.ndarray
    patterns: list[bytes]
    gram: np.ndarray
    owner: np.ndarray
    place: np.ndarray
    edits: np.ndarray
    bound: np.ndarray
    #: Items shorter than Q bytes by their number of words: the hashes in order and the item of each.
    short: dict[int, tuple[np.ndarray, np.ndarray]]


def _by_words(short: list[tuple[int, bytes]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    if not short:
        return {}
    offs = np.concatenate([[0], np.cumsum([len(p) for _, p in short])])
    whole = Chunk(0, len(short), np.frombuffer(b"".join(p for _, p in short), dtype=np.uint8), offs)
    hashes, items = whole.span_hash(offs[:-1], offs[1:], raw=True), np.array([i for i, _ in short], dtype=np.int64)
    words, out = np.array([p.count(b" ") + 1 for _, p in short]), {}
    for n in np.unique(words).tolist():
        own = np.flatnonzero(words == n)
        own = own[np.argsort(hashes[own], kind="stable")]
        out[n] = hashes[own], items[own]
    return out


def build(rows: list[tuple[int, str]]) -> Index:
    """The index of items (id, text). Items shorter than Q bytes are looked up as runs of whole words,
    items without any character that is not white space are left out."""
    items, patterns, short = [], [], []
    for item, text in rows:
        raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
        p = normal(raw, np.array([0, len(raw)]))[0].tobytes().strip()
        if len(p) < Q:
            if p:
                short.append((item, p))
            continue
        last = max(0, len(p) - PIECE)
        for at in sorted({*range(0, last, PIECE // 2), last}):
            items.append(item)
            patterns.append(p[at : at + PIECE])
    gram, owner, place = [], [], []
    for i, p in enumerate(patterns):
        g = grams(np.frombuffer(p, dtype=np.uint8))
        gram.append(g)
        owner.append(np.full(len(g), i))
        place.append(np.arange(len(g)))
    cat = lambda x, t: np.concatenate([np.zeros(0, t), *x]).astype(t)
    g, o, j = cat(gram, np.uint64), cat(owner, np.int64), cat(place, np.int64)
    order = np.argsort(g, kind="stable")
    m = np.array([len(p) for p in patterns], dtype=np.int64)
    k = np.minimum((EDITS * m).astype(np.int64), (m - Q) // Q)
    return Index(np.array(items, dtype=np.int64), patterns, g[order], o[order], j[order], k, m + 1 - (k + 1) * Q, _by_words(short))


def aligned(pattern: bytes, text: bytes, edits: int) -> bool:
    """Whether some part of ``text`` is within ``edits`` of ``pattern``. One row of the
    alignment table for each character of the pattern, over the band's columns at once."""
    if pattern in text:
        return True
    if not edits or not text:
        return False
    t = np.frombuffer(text, dtype=np.uint8)
    ahead = np.arange(len(t) + 1)
    row = np.zeros(len(t) + 1, dtype=np.int64)
    for c in pattern:
        step = np.empty_like(row)
        step[0] = row[0] + 1
        np.minimum(row[:-1] + (t != c), row[1:] + 1, out=step[1:])
        row = np.minimum.accumulate(step - ahead) + ahead
        if row.min() > edits:
            return False
    return bool(row.min() <= edits)


class Matcher:
    """Finds the items of an index in chunks of documents."""

    def __init__(self, index: Index):
        self.x = index
        self.quick = np.zeros(1 << _BITS, dtype=bool)
        self.quick[self._slot(index.gram)] = True

    @staticmethod
    def _slot(g: np.ndarray) -> np.ndarray:
        return ((g ^ (g >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - _BITS)).astype(np.int64)

    def _bands(self, pos: np.ndarray, doc: np.ndarray, lo: np.ndarray, n: np.ndarray, docs: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Bands, as (pattern * docs + document) * width + number, and the q-grams that each shares. The pairs of equal
        q-grams are formed ``PAIRS`` at a time, so a text of one repeated character takes time, not memory."""
        x, keys, counts = self.x, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        ends = np.cumsum(n)
        i = 0
        while i < len(n):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PAIRS, side="right")))
            at = spread(lo[i:j], n[i:j])
            near, owner = np.repeat(pos[i:j], n[i:j]), np.repeat(doc[i:j], n[i:j])
            base = (x.owner[at] * docs + owner) * width + (near - x.place[at] + PIECE) // (BAND // 2)
            key = np.concatenate([base, base + 1])  # bands overlap by half
            low = int(key.min())
            if int(key.max()) - low < 4 * PAIRS:
                many = np.bincount(key - low)
                some = np.flatnonzero(many)
                keys.append(some + low)
                counts.append(many[some])
            else:
                some, many = np.unique(key, return_counts=True)
                keys.append(some)
                counts.append(many)
            i = j
        if len(keys) <= 2:
            return keys[-1], counts[-1]
        key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        return key, np.bincount(inverse, weights=np.concatenate(counts)).astype(np.int64)

    def _short(self, c: Chunk) -> set[tuple[int, int]]:
        """(document, item) for items shorter than Q bytes, which are found by the hashes of the text's runs of as many words: the
        time does not depend on the number of items."""
        starts, ends, begins = c.words()
        doc = np.repeat(np.arange(c.n), np.diff(begins))
        found = set()
        for n, (hashes, items) in self.x.short.items():
            first = np.arange(max(0, len(starts) - n + 1))
            first = first[(first + n <= begins[doc[first] + 1]) & (ends[first + n - 1] - starts[first] < Q)]
            own = c.span_hash(starts[first], ends[first + n - 1], raw=True)
            lo, hi = np.searchsorted(hashes, own, side="left"), np.searchsorted(hashes, own, side="right")
            some = hi > lo
            hits = np.unique(np.repeat(doc[first[some]], (hi - lo)[some]) * len(items) + spread(lo[some], (hi - lo)[some]))
            found |= set(zip((hits // len(items)).tolist(), items[hits % len(items)].tolist(), strict=True))
        return found

    def find(self, c: Chunk) -> set[tuple[int, int]]:
        """(document, item) of the chunk."""
        x = self.x
        data, offs = normal(c.data, c.offsets)
        found = set()
        if x.short:
            found |= self._short(Chunk(0, c.n, data, offs))
        g = grams(data)
        if not len(g) or not len(x.gram):
            return found
        pos = np.flatnonzero(self.quick[self._slot(g)])
        own = g[pos]
        lo, hi = np.searchsorted(x.gram, own, side="left"), np.searchsorted(x.gram, own, side="right")
        some = hi > lo
        pos, lo, n = pos[some], lo[some], (hi - lo)[some]
        if not len(pos):
            return found
        doc = np.searchsorted(offs, pos, side="right") - 1
        inside = pos + Q <= offs[doc + 1]
        pos, lo, n, doc = pos[inside], lo[inside], n[inside], doc[inside]
        width = len(data) // (BAND // 2) + PIECE + 2
        key, count = self._bands(pos, doc, lo, n, c.n, width)
        pattern = key // width // c.n
        enough = count >= x.bound[pattern]
        for i, p in zip(key[enough].tolist(), pattern[enough].tolist(), strict=True):
            d, k = i // width % c.n, int(x.edits[p])
            if (d, int(x.items[p])) in found:
                continue
            start = (i % width - 1) * (BAND // 2) - PIECE
            region = data[max(offs[d], start - k) : min(offs[d + 1], start + BAND + len(x.patterns[p]) + k)].tobytes()
            if aligned(x.patterns[p], region, k):
                found.add((d, int(x.items[p])))
        return found


def blocks(benchmark: DataFrame, limit: int | None = None) -> Iterator[Index]:
    """Indexes of the benchmark's rows (item_id, text), ``limit`` characters or one row each."""
    limit, rows, size = limit or BLOCK, [], 0
    for r in benchmark.select("item_id", "text").where("text is not null and item_id is not null").toLocalIterator():
        if rows and size + len(r["text"]) > limit:
            yield build(rows)
            rows, size = [], 0
        rows.append((r["item_id"], r["text"]))
        size += len(r["text"])
    yield build(rows)


def matches(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of ``docs`` with items (the ids of the benchmark items found in the
    whole text, in order) and contaminated (whether there are any).

    An item shorter than ``Q`` bytes is found wherever its words stand in a row, so an item "yes" marks every document that holds
    this word: leave such items out of ``benchmark`` if that is not wanted. Item ids are whole numbers.
    Null and empty texts have no items. Null items or item ids are left out, repeated items
    count once. Repeated rows and null ids of documents pass through one by one. With an
    empty benchmark nothing is contaminated. Other columns are not read; where a kept column has
    one of the new names, an underscore is put before the new one. A benchmark of several
    blocks takes as many passes one after another.
    """
    names = fresh(docs.select(*map(col, keep)), "items", "contaminated", "read_text")
    rows = docs.select(F.col("text").alias(names[2]), *map(col, keep), F.lit(None).cast("array<long>").alias(names[0]))
    waiting = None
    for index in blocks(benchmark):
        if waiting is not None:  # written between passes, so that no task holds two blocks
            rows = written(_search(rows, waiting, True), "decontamination")
        waiting = index
    out = _search(rows, waiting, False)
    return out.withColumn(names[1], F.size(names[0]) > 0)


def _search(rows: DataFrame, index: Index, carry: bool) -> DataFrame:
    """One pass: ``rows`` (a text, kept columns, items found before) with the items of one block added; the text
    is carried along for a further pass."""
    sent = rows.sparkSession.sparkContext.broadcast(index)
    names = rows.columns if carry else rows.columns[1:]
    first = 0 if carry else 1

    def run(batches):
        matcher = Matcher(sent.value)
        for b in batches:
            for c in chunks(b.column(0)):
                hits = [set(x or ()) for x in b.column(b.num_columns - 1).slice(c.first, c.n).to_pylist()]
                for d, item in matcher.find(c):
                    hits[d].add(item)
                cols = [b.column(i).slice(c.first, c.n) for i in range(first, b.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([sorted(h) for h in hits], pa.list_(pa.int64()))], names)

    return rows.transform(map_arrow, run, schema_of(rows.schema[first:]))
