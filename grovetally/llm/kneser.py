"""Modified Kneser-Ney scores of every document by counts of all trusted documents, joined by shuffles of shards.

Every place of a document's tokens is a record: the pair of tokens that ends there and the token after it, and
in trusted documents the token before it. Records go to shards by the pair's hash. A shard counts the records
of trusted documents, which gives the triples after each pair and the different tokens before it, and answers every record with
the counts that it needs. A shard's pairs give the counts of their words; these are summed in
shards of words, after each round and then over all, which answer the words of each batch. Last, a batch's tokens meet all answers and its documents are scored.
No task and not the driver holds more than a shard of the counts or a batch of documents.

Trusted documents are scored twice, the second time by a model of the other folds. All that a fold's document asks
for occurs in that fold, so a shard has the counts without the fold as differences for what occurs in it.

Records of a batch send each pair once, and the word before follows from its hash. Answers are small and mostly alike, so they are kept by columns.

Pairs are 64-bit hashes; the tokens before and after a pair are told apart by 32 bits within the pair. To bound the disk that shuffles
take at once, pairs are dealt to ``ROUNDS`` rounds (one if texts are ``FEW``), each of which reads the texts again. Batches must come the same each time; a sum over
each batch's tokens goes with its records, and another sum is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut, map_arrow, shared_path, shuffles_dropped, tidied, written
from ._text import chunks, mix
from .perplexity import _C1, FOLDS, discounts, sequence, signatures

ROUNDS = 7
#: Rounds of the shards of words, and of the input's partitions when documents are scored.
WORD_ROUNDS, LAST_ROUNDS = 2, 4
#: Texts of fewer bytes take one round. Bytes of text for each shard.
FEW, SHARE = 64 << 20, 2 << 20
#: The model of all trusted documents; models 0 to FOLDS - 1 are those without a fold.
ALL = FOLDS
_ROWS = "key long, kind int, at long, blob binary"
_PAIRS, _ANSWERS, _TALLY, _WORD_ANSWERS, _TOKENS = range(5)
#: Counts of words are of kind ``_COUNTS`` and the round of their shard; those who ask for them come after.
_COUNTS, _WORDS = 16, 1 << 16
#: Rows of word counts that a task sums before it passes them on.
_HELD = 1 << 17
#: Bytes of text whose words are found at once, few enough for a core's cache.
_CHUNK = 1 << 18
#: Tokens whose probabilities are computed at once.
_SLICE = 1 << 17


def joint(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Columns of a table of whole numbers from 0 as a byte each: its place among the most frequent columns of small numbers
    (as keys), or 255 for any other, which follow as they are. One byte for a column takes fewer bits than one for each number, as most columns
    are alike. Which are frequent is taken from columns at equal distances; that bears on size only."""
    x = np.ascontiguousarray(x)
    key = np.zeros(x.shape[1], np.uint64)
    for i, row in enumerate(x):
        key |= row.view(np.uint64) << np.uint64(_BITS * i)
    key[x.max(axis=0, initial=0) >= 1 << _BITS] = _OTHER
    some, n = np.unique(key[:: max(1, len(key) >> 12)], return_counts=True)
    some = some[np.argsort(-n, kind="stable")]
    some = some[some != _OTHER][:255]
    slot = lambda k: (k * _C1 >> np.uint64(48)).astype(np.int64)
    of_slot, keys = np.full(1 << 16, 255, np.uint8), np.full(256, _OTHER)
    of_slot[slot(some)[::-1]] = np.arange(len(some), dtype=np.uint8)[::-1]  # of two in one slot, the more frequent one
    keys[: len(some)] = some
    code = of_slot[slot(key)]
    code[keys[code] != key] = 255
    return code, some, x[:, code == 255]


class Columns:
    """The table of :func:`joint`."""

    def __init__(self, code: np.ndarray, keys: np.ndarray, others: np.ndarray):
        self.code, self.others = code, others
        self.frequent = np.zeros((len(others), 256), np.int64)
        for i, row in enumerate(self.frequent):
            row[: len(keys)] = (keys >> np.uint64(_BITS * i) & np.uint64((1 << _BITS) - 1)).astype(np.int64)

    def rows(self, made, kind: type) -> np.ndarray:
        """Columns as rows, after ``made``, which is computed once for all that are alike."""
        out = np.ascontiguousarray(made(self.frequent).T.astype(kind))[self.code]
        out[self.code == 255] = made(self.others).T
        return out


def rising(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that mostly rise, as differences: the lower six bytes of each, which do not compress, and what is above."""
    x = np.diff(x, prepend=np.uint64(0))
    return x.view(np.uint8).reshape(-1, 8)[:, :6], (x >> np.uint64(48)).astype(np.int64)


def risen(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    x = np.zeros((len(low), 8), np.uint8)
    x[:, :6] = low
    return np.cumsum(x.view(np.uint64).ravel() | high.astype(np.uint64) << np.uint64(48), dtype=np.uint64)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes: integers below 255 as one byte each, tables of them by columns (see :func:`joint`). Bytes in
    rows and 32-bit numbers are hashes; they stand behind the others as they are."""
    out, plain = [], []
    for a in arrays:
        if a.ndim == 2 and a.dtype == np.int64:
            code, keys, others = joint(a)
            inner = packed(others.ravel())
            out += [np.array([2, len(code), len(keys)], np.int64).tobytes(), np.array([len(a), len(inner)], np.int64).tobytes(), code.tobytes(), keys.tobytes(), inner]
        elif a.ndim == 2 or a.dtype == np.uint32:
            out.append(np.array([3, len(a), a.shape[1] if a.ndim == 2 else 0], np.int64).tobytes())
            plain.append(a.tobytes())
        else:
            out.append(packed(a))
    raw = b"".join(out)
    small = pa.compress(raw, codec="zstd", asbytes=True)
    return b"".join([len(raw).to_bytes(8, "little"), len(small).to_bytes(8, "little"), small, *plain])


def packed(a: np.ndarray) -> bytes:
    if a.dtype != np.int64:
        return np.array([a.dtype.num + 100, len(a), 0], np.int64).tobytes() + a.tobytes()
    over = a[a >= 255]
    return b"".join([np.array([1, len(a), len(over)], np.int64).tobytes(), np.minimum(a, 255).astype(np.uint8).tobytes(), over.tobytes()])


def unpack(blob: bytes) -> list[np.ndarray | Columns]:
    size, small = int.from_bytes(blob[:8], "little"), int.from_bytes(blob[8:16], "little")
    return unpacked(pa.decompress(blob[16 : 16 + small], size, codec="zstd", asbytes=True), 0, size, blob, 16 + small)


def unpacked(raw: bytes, at: int, size: int, plain: bytes = b"", behind: int = 0) -> list[np.ndarray | Columns]:
    out = []
    while at < size:
        kind, n, over = np.frombuffer(raw, np.int64, 3, at).tolist()
        at += 24
        if kind == 1:
            a = np.frombuffer(raw, np.uint8, n, at).astype(np.int64)
            a[a == 255] = np.frombuffer(raw, np.int64, over, at + n)
            at += n + 8 * over
        elif kind == 2:
            height, inner = np.frombuffer(raw, np.int64, 2, at).tolist()
            code, keys, at = np.frombuffer(raw, np.uint8, n, at + 16), np.frombuffer(raw, np.uint64, over, at + 16 + n), at + 16 + n + 8 * over
            a = Columns(code, keys, unpacked(raw, at, at + inner)[0].reshape(height, -1))
            at += inner
        elif kind == 3:
            a = np.frombuffer(plain, np.uint8, n * over, behind).reshape(n, over) if over else np.frombuffer(plain, np.uint32, n, behind)
            behind += a.nbytes
        else:
            a = np.frombuffer(raw, _DTYPES[kind - 100], n, at)
            at += a.nbytes
        out.append(a)
    return out


#: Bits of a number in the key of a column (of at most 12 numbers), and the key of columns with larger numbers.
_BITS, _OTHER = 5, np.uint64(2**64 - 1)
_DTYPES = {np.dtype(t).num: np.dtype(t) for t in (np.uint8, np.uint16, np.uint32, np.uint64)}


def table(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    key, kind, at, blob = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(kind, pa.int32()), pa.array(at, pa.int64()), pa.array(blob, pa.binary())], ["key", "kind", "at", "blob"])


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, int, bytes]]]]:
    """Rows (kind, at, blob) of each key, of rows that are sorted by key."""
    key, rows = None, []
    for b in batches:
        for k, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if k != key and rows:
                yield key, rows
                rows = []
            key = k
            rows.append(tuple(row))
    if rows:
        yield key, rows


class Tokens:
    """The tokens of some documents: ``seq`` is start, start, words, end of each; ``begins`` are of its words."""

    def __init__(self, seq: np.ndarray, begins: np.ndarray, trusted: np.ndarray):
        self.seq, self.begins, self.trusted = seq, begins, trusted
        n = np.diff(begins)
        starts = begins[:-1] + 3 * np.arange(len(n))
        first = np.zeros(len(seq), bool)
        first[starts] = True
        self.at = np.flatnonzero(~first)  # the second token of each pair
        self.pair = mix(seq[self.at - 1] * _C1 + seq[self.at])
        ends = starts + n + 2 - np.arange(len(n))  # of each document's records
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.pair)])[np.concatenate([[0], ends])]
        self.fold = (mix(np.diff(total)) % np.uint64(FOLDS)).astype(np.int64)  # equal texts are in one
        self.model = np.where(trusted, self.fold, ALL)
        self.of = np.repeat(self.model, n + 2)
        self.sum = int((self.pair * np.arange(1, len(self.pair) + 1, dtype=np.uint64)).sum(dtype=np.uint64))

    @staticmethod
    def read(b: pa.RecordBatch) -> Tokens:
        ws, ns = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for c in chunks(b.column(2), _CHUNK):
            starts, ends, begins = c.words()
            ws.append(c.span_hash(starts, ends))
            ns.append(np.diff(begins))
        w, begins = np.concatenate(ws), np.concatenate([[0], np.cumsum(np.concatenate(ns))]).astype(np.int64)
        return Tokens(sequence(w, begins)[0], begins, b.column(3).is_valid().to_numpy(zero_copy_only=False))

    def turns(self, rounds: int) -> np.ndarray:
        return (self.pair.astype(np.uint16) % np.uint16(rounds)).astype(np.uint8)

    def shards(self, own: np.ndarray, n: int) -> np.ndarray:
        return ((self.pair[own] >> np.uint64(32)) % np.uint64(n)).astype(np.uint32)

    def beside(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens after and before some records' pairs, as 32 bits, 0 where there is none."""
        at, seq = self.at[own], self.seq
        brief = lambda i: np.maximum(mix(seq[i] ^ _C1) >> np.uint64(32), np.uint64(1)).astype(np.uint32)
        is_end, is_second = np.zeros((2, len(seq)), bool)
        starts = self.begins[:-1] + 3 * np.arange(len(self.trusted))
        is_second[starts + 1] = True
        is_end[starts + np.diff(self.begins) + 2] = True
        return np.where(is_end[at], np.uint32(0), brief(np.minimum(at + 1, len(seq) - 1))), np.where(is_second[at], np.uint32(0), brief(at - 2))

    def order(self, turn: int, rounds: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
        """The records of a round by shard, trusted ones last in each, those of a pair beside each other (so that they and
        their answers take few bytes); and their shards."""
        own = np.flatnonzero(self.turns(rounds) == turn)
        shard = self.shards(own, shards)
        low, high = len(own).bit_length(), (2 * shards).bit_length()  # of a record's number and of its part
        if low + high > 64:
            raise ValueError("too many shards or records")
        key = (shard.astype(np.uint64) << np.uint64(1) | (self.of[own] < ALL)) << np.uint64(64 - high)
        key |= self.pair[own] >> np.uint64(high) & ~np.uint64((1 << low) - 1) | np.arange(len(own), dtype=np.uint64)
        order = (np.sort(key) & np.uint64((1 << low) - 1)).astype(np.int64)  # no two keys are equal
        return own[order], shard[order]

    def words(self, shards: int, turn: int = 0, rounds: int = 1, given: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Different words by shard (those of a round's shards), their shards, the models wanted of each as bits, and the
        place of each of their tokens' word. ``given``: all different words in any order, and where each token's is."""
        seq, model = self.seq, np.repeat(self.model, np.diff(self.begins) + 3)
        if rounds > 1:
            here = np.flatnonzero((seq >> np.uint64(40)) % np.uint64(shards) % np.uint64(rounds) == turn)
            seq, model = seq[here], model[here]
        if given:
            rank = np.argsort(given[0])
            back = np.empty(len(rank), np.int64)
            back[rank] = np.arange(len(rank))
            words, own = given[0][rank], back[given[1]]
        else:
            words, own = np.unique(seq, return_inverse=True)
        shard = ((words >> np.uint64(40)) % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        own = place[own]
        bits = np.zeros((len(words), FOLDS), bool)
        bits[own[model < ALL], model[model < ALL]] = True
        return words[order], shard[order], bits, own


def read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, Tokens]]:
    for i, b in enumerate(b for b in batches if b.num_rows):
        yield b.column(4)[0].as_py() << 24 | i, b, Tokens.read(b)


def pair_rows(shards: int, turn: int, rounds: int):
    def run(batches):
        for at, _, t in read_batches(batches):
            order, shard = t.order(turn, rounds, shards)
            good = t.of[order] < ALL
            after, before = t.beside(order)
            pair, fold, w2 = t.pair[order], t.of[order].astype(np.uint8), t.seq[t.at[order]]
            new = np.concatenate([[True], (pair[1:] != pair[:-1]) | (good[1:] != good[:-1]) | (shard[1:] != shard[:-1])])[: len(pair)]
            ends = np.searchsorted(shard, np.arange(shards + 1))
            middle = ends[1:] - np.diff(np.concatenate([[0], np.cumsum(good)])[ends])
            rows = []
            for s in np.flatnonzero(np.diff(ends)).tolist():
                i, j, k = ends[s], middle[s], ends[s + 1]
                one, two = np.flatnonzero(new[i:j]) + i, np.flatnonzero(new[j:k]) + j  # each pair once where its records lie side by side
                blob = pack(np.array([t.sum], np.uint64), *rising(pair[one]), new[i:j].view(np.uint8), after[i:j], *rising(pair[two]), w2[two], new[j:k].view(np.uint8), after[j:k], before[j:k], fold[j:k])
                rows.append((turn * shards + s, _PAIRS, at, blob))
            if rows:
                yield table(rows)

    return run


def brief(x: np.ndarray, back: bool = False) -> np.ndarray:
    """Rows with the totals (row 1) as what they are above 1, 2 and 3 times the kinds (rows 2 to 4): mostly 0."""
    x = x.copy()
    x[1] += (x[2] + 2 * x[3] + 3 * x[4]) * (1 if back else -1)
    return x


def folded(x: np.ndarray) -> np.ndarray:
    """Whole numbers as whole numbers from 0, small ones as small ones."""
    return np.where(x < 0, -2 * x - 1, 2 * x)


def unfolded(x: np.ndarray) -> np.ndarray:
    return np.where(x % 2 == 1, -(x + 1) // 2, x // 2)


def _whole(x: np.ndarray) -> np.ndarray:
    return brief(x, back=True)


def _changes(x: np.ndarray) -> np.ndarray:
    return brief(unfolded(x), back=True)


def tally(old: np.ndarray, new: np.ndarray | None = None, model: np.ndarray | None = None) -> np.ndarray:
    """How many counts are 1, 2, 3 and 4, for all models; or by how much they change in each model."""
    out = np.zeros((FOLDS + 1, 4), np.int64)
    for k in range(1, 5):
        if new is None:
            out[:, k - 1] = int((old == k).sum())
        else:
            out[:FOLDS, k - 1] = np.bincount(model[new == k], minlength=FOLDS) - np.bincount(model[old == k], minlength=FOLDS)
    return out


def _kinds(group: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """How many counts of each group are 1, 2, and more."""
    some = count > 0
    return np.bincount(group[some] * 3 + np.minimum(count[some], 3) - 1, minlength=3 * n).reshape(n, 3)


def first_words(pair: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The first words of pairs, which follow from their hashes and second words: each step of :func:`mix` has an inverse."""
    h = pair ^ pair >> np.uint64(32)
    for _ in range(2):
        h = h * _UNMIX
        h ^= h >> np.uint64(32)
    return (h - second) * _UN_C1


_UNMIX, _UN_C1 = (np.uint64(pow(int(x), -1, 2**64)) for x in (0xD6E8FEB86659FD93, _C1))


class Pairs:
    """The counts of a shard's trusted records, and of each fold's the counts without the fold."""

    def __init__(self, pair: np.ndarray, w2: np.ndarray, run: np.ndarray, after: np.ndarray, before: np.ndarray, fold: np.ndarray):
        """``pair`` and ``w2`` have a row for each run of records of a pair, the others one for each record."""
        sums = lambda at, x, n: np.bincount(at, weights=x, minlength=n).astype(np.int64)
        self.keys, own = np.unique(pair, return_inverse=True)
        self.own = own[run]
        n = len(self.keys)
        self.w2 = np.empty(n, np.uint64)
        self.w2[own] = w2
        self.w1 = first_words(self.keys, self.w2)
        self.in_fold, self.own_fold = np.unique(self.own * 16 + fold, return_inverse=True)
        pair, m = self.in_fold >> 4, len(self.in_fold)

        def types(other):
            """Different (pair, other) with counts; those of each fold with counts; places of the records' ones."""
            has = np.flatnonzero(other)
            code, at, count = np.unique(self.own[has].astype(np.uint64) << np.uint64(32) | other[has], return_inverse=True, return_counts=True)
            each, at_each, inside = np.unique(at * 16 + fold[has], return_inverse=True, return_counts=True)
            kind = each >> 4
            return has, code, (code >> np.uint64(32)).astype(np.int64), at, count, kind, each & 15, at_each, count[kind] - inside

        has, self.types, of, at, self.n, kind, model, at_each, left = types(after)
        self.total, self.kinds = sums(of, self.n, n), _kinds(of, self.n, n)
        place = np.searchsorted(self.in_fold, of[kind] * 16 + model)
        total = self.total[pair] + sums(place, left - self.n[kind], m)
        kinds = self.kinds[pair] + _kinds(place, left, m) - _kinds(place, self.n[kind], m)
        three, three_fold = np.zeros((2, len(run)), np.int64)
        three[has], three_fold[has] = self.n[at], left[at_each]
        self.tally3 = tally(self.n) + tally(self.n[kind], left, model)

        _, _, of, _, _, kind, model, _, left = types(before)
        self.two = np.bincount(of, minlength=n)
        place = np.searchsorted(self.in_fold, of[kind] * 16 + model)
        two = self.two[pair] - np.bincount(place[left == 0], minlength=m)
        self.tally2 = tally(self.two) + tally(self.two[pair], two, self.in_fold & 15)

        o, f = self.own, self.own_fold
        self.answers = np.stack([self.two[o], self.total[o], *self.kinds[o].T, three]), np.stack([two[f], total[f], *kinds[f].T, three_fold])
        # (word, model), then by how much they add to: pairs that end with it, counts of pairs that begin with it, their kinds
        some, less = np.flatnonzero(self.two), np.flatnonzero(two != self.two[pair])
        was, now, rows = self.two[pair[less]], two[less], [np.zeros((len(some), 5), np.int32) for _ in range(2)]
        rows += [np.zeros((len(less), 5), np.int32) for _ in range(2)]  # of a shard, so they are small
        rows[0][:, 0], rows[1][:, 1] = 1, self.two[some]
        rows[1][:, 2:] = _kinds(np.arange(len(some)), self.two[some], len(some))
        rows[2][:, 0], rows[3][:, 1] = -((was > 0) & (now == 0)).astype(np.int64), now - was
        rows[3][:, 2:] = _kinds(np.arange(len(less)), now, len(less)) - _kinds(np.arange(len(less)), was, len(less))
        base, folds = np.full(len(some), ALL, np.uint8), (self.in_fold[less] & 15).astype(np.uint8)
        self.words = summed(np.concatenate([self.w2[some], self.w1[some], self.w2[pair[less]], self.w1[pair[less]]]), np.concatenate([base, base, folds, folds]), np.concatenate(rows))

    def find(self, pair: np.ndarray, run: np.ndarray, after: np.ndarray) -> list[np.ndarray]:
        """The answers to records of other documents; ``pair`` is of runs of them."""
        if not len(self.keys):
            return [np.zeros(len(run), np.int64)] * 6
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        there = self.keys[at] == pair
        out = [np.where(there, x[at], 0)[run] for x in (self.two, self.total, *self.kinds.T)]
        hit = np.flatnonzero(there[run])
        code = at[run[hit]].astype(np.uint64) << np.uint64(32) | after[hit]
        place = np.minimum(np.searchsorted(self.types, code), max(0, len(self.types) - 1))
        col = np.zeros(len(run), np.int64)
        if len(self.types):
            col[hit] = np.where(self.types[place] == code, self.n[place], 0)
        return [*out, col]


def summed(word: np.ndarray, model: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One row for each word and model, sorted by them."""
    if not len(word):
        return word, model, values
    order = np.argsort(word)
    word, model = word[order], model[order].astype(np.int64)
    # the same words stand together; their number and model are a whole number, which sorts faster than two keys
    number = np.cumsum(np.concatenate([[False], word[1:] != word[:-1]]))
    again = np.argsort(number << 4 | model)
    order, word, model = order[again], word[again], model[again]
    first = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (model[1:] != model[:-1])]))
    return word[first], model[first], np.add.reduceat(values[order], first, axis=0)


def counts_packed(word: np.ndarray, model: np.ndarray, values: np.ndarray) -> bytes:
    """Rows as :func:`summed` gives them."""
    first = np.diff(word, prepend=~word[:1]) != 0  # each word once
    return pack(*rising(word[first]), model.astype(np.uint8) | np.where(first, np.uint8(16), np.uint8(0)), folded(brief(values.T.astype(np.int64))))


def counts_summed(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    word, model, values = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros((0, 5), np.int32)]
    for low, high, k, v in map(unpack, blobs):
        word.append(risen(low, high)[np.cumsum(k >> 4, dtype=np.int64) - 1])
        model.append((k & 15).astype(np.int64))
        values.append(v.rows(_changes, np.int32))
    return summed(*map(np.concatenate, (word, model, values)))


def word_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each shard of words: the sums of its counts from the shards of pairs of a round."""
    for shard, rows in grouped(batches):
        yield table([(shard, rows[0][0], 0, counts_packed(*counts_summed([blob for _, _, blob in rows])))])


def pair_counts(shards: int, word_rounds: int):
    def run(batches):
        tallies, held = np.zeros((2, FOLDS + 1, 4), np.int64), []

        def passed():
            nonlocal held
            word, model, values = summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held = []
            shard = ((word >> np.uint64(40)) % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            ends = np.searchsorted(shard[order], np.arange(shards + 1))
            for s in np.flatnonzero(np.diff(ends)).tolist():
                own = order[ends[s] : ends[s + 1]]
                yield (s, _COUNTS + s % word_rounds, 0, counts_packed(word[own], model[own], values[own]))

        for unit, rows in grouped(batches):
            asked = [unpack(blob) for _, _, blob in rows]
            joined = lambda i: np.concatenate([a[i] for a in asked])  # noqa: B023, E731
            hashes = lambda i: np.concatenate([risen(a[i], a[i + 1]) for a in asked])  # noqa: B023, E731
            # each batch begins a run, so runs can be numbered on
            pairs = Pairs(hashes(5), joined(7), np.cumsum(joined(8), dtype=np.int64) - 1, joined(9), joined(10), joined(11).astype(np.int64))
            tallies += np.stack([pairs.tally2, pairs.tally3])
            held.append(pairs.words)
            plain = brief(np.stack(pairs.find(hashes(1), np.cumsum(joined(3), dtype=np.int64) - 1, joined(4))))
            base, other = brief(pairs.answers[0]), brief(pairs.answers[1])
            good, out, i, j = np.concatenate([base, folded(base - other)]), [], 0, 0
            for (_, at, _), a in zip(rows, asked, strict=True):
                out.append((at, _ANSWERS, unit, pack(a[0], plain[:, i : i + len(a[4])], good[:, j : j + len(a[9])])))
                i, j = i + len(a[4]), j + len(a[9])
            yield table(out)
            if sum(len(h[0]) for h in held) > 2 * _HELD:
                held = [summed(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                if len(held[0][0]) > _HELD:
                    yield table([*passed()])
        yield table([*(passed() if held else ()), (-1, _TALLY, 0, tallies.tobytes())])

    return run


def word_rows(shards: int, turn: int, rounds: int):
    def run(batches):
        for at, _, t in read_batches(batches):
            words, shard, bits, _ = t.words(shards, turn, rounds)
            ends = np.searchsorted(shard, np.arange(shards + 1))
            mask = bits @ (1 << np.arange(FOLDS))
            rows = [(s, _WORDS, at, pack(np.array([t.sum], np.uint64), *rising(words[ends[s] : ends[s + 1]]), mask[ends[s] : ends[s + 1]].astype(np.uint16))) for s in np.flatnonzero(np.diff(ends)).tolist()]
            if rows:
                yield table(rows)

    return run


def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of each shard's words; answers to each batch's words: all models' counts, then those of each fold wanted."""
    for shard, rows in grouped(batches):
        word, model, values = counts_summed([blob for kind, _, blob in rows if kind < _WORDS])
        base, less = model == ALL, model < ALL
        keys, counts = word[base], values[base]
        place = np.searchsorted(keys, word[less])
        codes, left = place * 16 + model[less], counts[place] + values[less]
        was, of = counts[place, 0], model[less]
        total = np.zeros((FOLDS + 1, 6), np.int64)
        total[:, :4] = tally(counts[:, 0]) + tally(was, left[:, 0], of)
        total[:, 4], total[:, 5] = (counts[:, 0] > 0).sum(), counts[:, 0].sum()
        total[:FOLDS, 4] += np.bincount(of[left[:, 0] > 0], minlength=FOLDS) - np.bincount(of[was > 0], minlength=FOLDS)
        total[:FOLDS, 5] += np.bincount(of, weights=left[:, 0] - was, minlength=FOLDS).astype(np.int64)
        out = [(-1, _TALLY, 1, total.tobytes())]
        for kind, at, blob in rows:
            if kind == _WORDS:
                sign, low, high, mask = unpack(blob)
                words = risen(low, high)
                found = np.zeros((len(words), 5), np.int64)
                at_word = np.searchsorted(keys, words)
                known = np.flatnonzero(keys[np.minimum(at_word, len(keys) - 1)] == words) if len(keys) else np.zeros(0, np.int64)
                found[known] = counts[at_word[known]]
                i, f = np.nonzero(mask[:, None] >> np.arange(FOLDS, dtype=np.uint16) & 1)
                each = found[i]
                if len(codes):
                    code = at_word[i] * 16 + f
                    spot = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                    hit = codes[spot] == code
                    each[hit] = left[spot[hit]]
                out.append((at, _WORD_ANSWERS, shard, pack(sign, brief(found.T), folded(brief((found[i] - each).T)))))
        yield table(out)


def token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for at, b, t in read_batches(batches):
        words, own, count = np.unique(t.seq, return_inverse=True, return_counts=True)
        order = np.argsort(-count)  # frequent words have small numbers
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        words, own = words[order], place[own].view(np.uint8).reshape(-1, 4).T.ravel()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, b.select([0, 1]).schema) as w:
            w.write_batch(b.select([0, 1]))
        yield table([(at, _TOKENS, 0, pack(words.view(np.uint8).reshape(-1, 8), own, t.begins.astype(np.uint64), t.trusted.astype(np.uint8), np.frombuffer(sink.getvalue(), np.uint8)))])


def _same(sign: np.ndarray, t: Tokens) -> None:
    if int(sign[0]) != t.sum:
        raise RuntimeError("the rows of documents come in other batches when they are read again; write the DataFrame and read it back")


def scores(shards: int, rounds: int, d1: np.ndarray, d2: np.ndarray, d3: np.ndarray, total: np.ndarray, floor: np.ndarray):
    """Documents of each batch from their tokens and all answers; discounts and sums have a row for each model."""

    def log10(doc, n, two, three, words, model) -> np.ndarray:
        """Sums by document of the log10 probabilities of tokens. two: the pair's count; three: total and kinds of the
        context, count of the triple; words: counts of the word and of the one before."""
        (own, before), k = words, model
        a3 = np.where(three[4] > 0, (three[4] - d3[k, np.minimum(three[4], 3)]) / np.maximum(three[0], 1), 0)
        g2 = np.where(three[0] > 0, sum(three[i] * d3[k, i] for i in (1, 2, 3)) / np.maximum(three[0], 1), 1)
        a2 = np.where(two > 0, (two - d2[k, np.minimum(two, 3)]) / np.maximum(before[1], 1), 0)
        g1 = np.where(before[1] > 0, sum(before[i + 1] * d2[k, i] for i in (1, 2, 3)) / np.maximum(before[1], 1), 1)
        a1 = np.where(own[0] > 0, (own[0] - d1[k, np.minimum(own[0], 3)]) / np.maximum(total[k], 1), 0) + floor[k]
        return np.bincount(doc, weights=np.log10(a3 + g2 * (a2 + g1 * a1)), minlength=n)

    def run(batches):
        for _, rows in grouped(batches):
            ((_, _, blob),) = [r for r in rows if r[0] == _TOKENS]
            words, own, begins, trusted, ids = unpack(blob)
            words, own = words.view(np.uint64).ravel(), np.ascontiguousarray(own.reshape(4, -1).T).view(np.uint32).ravel()
            t = Tokens(words[own], begins.astype(np.int64), trusted.astype(bool))
            n, done = len(t.at), 0
            base, other = np.zeros((2, n, 6), np.uint32)
            order = np.concatenate([t.order(turn, rounds, shards)[0] for turn in range(rounds)])
            doc = np.repeat(np.arange(len(t.model)), np.diff(t.begins) + 3)
            for _, _, blob in sorted(r for r in rows if r[0] == _ANSWERS):
                sign, plain, trusted = unpack(blob)
                _same(sign, t)
                here = order[done : done + len(plain.code)]
                base[here] = plain.rows(_whole, np.uint32)
                done += len(plain.code)
                here = order[done : done + len(trusted.code)]
                base[here] = trusted.rows(lambda x: _whole(x[:6]), np.uint32)
                other[here] = trusted.rows(lambda x: _whole(x[:6] - unfolded(x[6:])), np.uint32)
                done += len(trusted.code)
            if done != n:
                raise RuntimeError("answers are missing")
            _, _, bits, own = t.words(shards, given=(words, own))
            found, each, i = [], [], 0
            for _, _, blob in sorted(r for r in rows if r[0] == _WORD_ANSWERS):
                sign, a, b = unpack(blob)
                _same(sign, t)
                found.append(a.rows(_whole, np.int64))
                each.append(found[-1][np.nonzero(bits[i : i + len(a.code)])[0]] - b.rows(_changes, np.int64))
                i += len(a.code)
            found, each = np.concatenate(found), np.concatenate(each)
            spot = np.zeros(bits.shape, np.int64)
            spot[bits] = np.arange(bits.sum())
            # a token at place j of seq has its pair in the record of j and its triple in that of j - 1
            record = np.zeros(len(t.seq), np.int64)
            record[t.at] = np.arange(n)
            second = np.zeros(len(t.seq), bool)
            second[t.begins[:-1] + 3 * np.arange(len(t.model)) + 1] = True
            keep = t.at[~second[t.at]]
            length = np.diff(t.begins)
            logs = np.zeros(len(length))
            for i in range(0, len(keep), _SLICE):
                at = keep[i : i + _SLICE]
                logs += log10(doc[at], len(length), base[record[at], 0], base[record[at - 1], 1:].T, (found[own[at]].T, found[own[at - 1]].T), np.full(len(at), ALL))
            perplexity = 10 ** (-logs / (length + 1))
            unseen = perplexity.copy()
            k = t.model[doc[keep]]
            some = k < ALL
            if some.any():
                keep, k = keep[some], k[some]
                apart = np.zeros(len(length))
                for i in range(0, len(keep), _SLICE):
                    at, which = keep[i : i + _SLICE], k[i : i + _SLICE]
                    apart += log10(doc[at], len(length), other[record[at], 0], other[record[at - 1], 1:].T, (each[spot[own[at], which]].T, each[spot[own[at - 1], which]].T), which)
                mine = t.model < ALL
                unseen[mine] = np.where(total[t.model] > 0, 10 ** (-apart / (length + 1)), np.nan)[mine]
            named = pa.ipc.open_stream(pa.py_buffer(ids.tobytes())).read_next_batch()
            cols = [pa.array(length), pa.array(logs), pa.array(perplexity), pa.array(unseen, mask=np.isnan(unseen))]
            yield pa.RecordBatch.from_arrays([*named.columns, *cols], ["doc_id", "lang", "n_words", "log10_prob", "perplexity", "unseen"])

    return run


def score(docs: DataFrame, good: DataFrame) -> DataFrame:
    """(doc_id, lang, n_words, log10_prob, perplexity, unseen) of every document under a model of all documents with an
    id in ``good``; ``unseen`` is, for those, the perplexity under a model without the documents' fold (null if that has none)."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "lang", "text")
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    rounds, word_rounds, last_rounds = (ROUNDS, WORD_ROUNDS, LAST_ROUNDS) if size >= FEW else (1, 1, 1)
    shards = max(8, size // rounds // SHARE)
    good = cut(good.select(F.col("doc_id").alias("good")))
    read = docs.join(F.broadcast(good), F.col("doc_id") == F.col("good"), "left").select("doc_id", "lang", "text", "good", F.spark_partition_id().alias("part"))

    def by_key(*rows: DataFrame) -> DataFrame:
        return reduce(DataFrame.unionByName, rows).repartition("key").sortWithinPartitions("key", "kind", "at").select("key", "kind", "at", "blob")

    paths = []

    def kept(df: DataFrame, name: str, tidy: bool = True) -> DataFrame:
        """The rows written by kind."""
        paths.append(path := shared_path(spark, name))
        with shuffles_dropped(spark):
            df.write.partitionBy("kind").parquet(path)
        if tidy:
            tidied(spark)
        return spark.read.schema(_ROWS).parquet(path)

    def of_kind(df: DataFrame, kind: int) -> DataFrame:
        return df.where(F.col("kind") == kind)

    def tallies(df: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
        return sum((np.frombuffer(r[0], np.int64).reshape(shape) for r in of_kind(df, _TALLY).select("blob").toLocalIterator()), np.zeros(shape, np.int64))

    union = lambda dfs: reduce(DataFrame.unionByName, dfs)

    def let_go(path: str, turn: int) -> None:
        """Removes counts of words that are summed."""
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/kind={_COUNTS + turn}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    pairs, counted, made = [], [], []
    for turn in range(rounds):
        pairs.append(kept(map_arrow(by_key(map_arrow(read, pair_rows(shards, turn, rounds), _ROWS)), pair_counts(shards, word_rounds), _ROWS), "pairs"))
        # a word is in many shards of pairs; kept until all rounds are done is one row for each word, model and round
        counts = by_key(pairs[-1].where(F.col("kind").between(_COUNTS, _COUNTS + word_rounds - 1)))
        counted.append(kept(map_arrow(counts, word_sums, _ROWS), "counts", tidy=False))
        made.append(paths[-1])
        for i in range(word_rounds):
            let_go(paths[-2], i)
    pairs, counted = union(pairs), union(counted)
    words = []
    for turn in range(word_rounds):
        asked = by_key(of_kind(counted, _COUNTS + turn), map_arrow(read, word_rows(shards, turn, word_rounds), _ROWS))
        words.append(kept(map_arrow(asked, word_counts, _ROWS), "words"))
        for path in made:
            let_go(path, turn)
    words = union(words)
    two, three = tallies(pairs, (2, FOLDS + 1, 4))
    one = tallies(words, (FOLDS + 1, 6))
    d1, d2, d3 = (np.array([discounts(row) for row in x]) for x in (one[:, :4], two, three))
    more = one[:, 4] - one[:, :2].sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        floor = (d1[:, 1] * one[:, 0] + d1[:, 2] * one[:, 1] + d1[:, 3] * more) / one[:, 5] / (one[:, 4] + 1)
    floor = np.where(one[:, 5] > 0, floor, 1.0)
    out = []
    for turn in range(last_rounds):
        answers = [of_kind(x, k).where(F.shiftright("key", 24) % last_rounds == turn) for x, k in ((pairs, _ANSWERS), (words, _WORD_ANSWERS))]
        rows = by_key(*answers, map_arrow(read.where(F.col("part") % last_rounds == turn), token_rows, _ROWS))
        schema = f"doc_id {kind}, lang string, n_words long, log10_prob double, perplexity double, unseen double"
        with shuffles_dropped(spark):
            out.append(written(map_arrow(rows, scores(shards, rounds, d1, d2, d3, one[:, 5], floor), schema), "scores"))
    return union(out)
