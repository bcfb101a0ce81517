"""Language-model scoring: a causal self-attention model in numpy over subword ids.

A text is its words (A-Z lower-cased, one space before each) as subword ids of a public byte-pair
vocabulary, then an end. Every id is a position of the model and every id is predicted: one
attention head looks back over a window of ids, and a softmax factored by frequency gives
the probability of the next one. The most frequent ids have outputs of their own, groups of rarer
ones share an output each and are told apart by a softmax of the group, and the ids of the last
group, which are rarer than ``CUTS[-1]`` others, by their counts. So all ids have probabilities that add up to 1.

Windows overlap: each holds ``CONTEXT`` positions that are only looked at and ``STRIDE`` that are
scored, so each id is scored once, with batched masked attention.

Training takes every id of every training document once. Documents are cut into pieces, and pieces
are dealt by hash to units of about ``UNIT`` ids and to ``ROUNDS`` rounds. In a round each unit takes
its steps, in the order of its pieces' hashes, from the parameters of the round before; the
results are averaged, weighted by steps, in whole numbers, so that the order of sums does not matter.
Units follow from the documents alone: how the input is partitioned changes nothing.

The unigram figures (``base_score``) count all training documents. Frequent words are counted in a table
of at most ``FREQUENT`` rows that every task holds; the other words of each document are joined with the
whole count table by a shuffle. Texts are read twice, for these counts and for the ids, which are written and
then read by training and scoring.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import cut, map_arrow, written
from ._text import LOWER, Chunk, chunks, mix, spread

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
FREQUENT, WIDTH, STRIDE, CONTEXT = 65536, 24, 24, 8
WINDOW = STRIDE + CONTEXT
#: Ranks that end the ids with outputs of their own and each group of rarer ones; ids with rows of their own.
CUTS, ROWS = (64, 128, 256, 512, 1024), 4096
#: Training: rounds, ids in a unit, units that share a task, ids in a piece, windows in a step, step size.
ROUNDS, UNIT, SHARED, PIECE, BATCH, RATE = 8, 1 << 19, 4, STRIDE * 512, 128, 0.02
#: Ids that training sees at least, by going over small tables several times, and the most passes.
LEAST, MOST_PASSES = 1 << 20, 16
#: Fractions of a parameter are summed in steps of 2**-POINT.
POINT = 28
#: Bytes that are encoded in one piece.
ENCODED = 1 << 16
#: The word that ends every text, as a hash.
_END = np.uint64(0x13198A2E03707344)
HELD_OUT, FOLDS = 2, 7


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves remainder 2 modulo 7; a null id is no text."""
    return F.crc32(F.encode(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "utf-8")) % FOLDS == HELD_OUT


class Subwords:
    """The subword ids of texts; ``end`` stands before the first and after the last one."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.code = tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.end = max(ranks.values()) + 1
        self.bytes = np.zeros(self.end + 1, dtype=np.int64)
        self.bytes[list(ranks.values())] = [len(x) for x in ranks]

    def encode(self, text: bytes) -> np.ndarray:
        """Ids of one text. Long ones are cut, before a space where there is one, so that neither a long
        text nor a long word takes more time for its length."""
        ids, at = [], 0
        while at < len(text):
            to = len(text)
            if to - at > ENCODED:
                to = text.rfind(b" ", at + 1, at + ENCODED)
                if to < 0:
                    to = at + ENCODED
                    while text[to] & 0xC0 == 0x80:
                        to -= 1
            ids.append(self.code.encode_to_numpy(text[at:to].decode(), disallowed_special=()).astype(np.int32))
            at = to
        return np.concatenate([np.zeros(0, np.int32), *ids])

    def sequences(self, c: Chunk, starts: np.ndarray, begins: np.ndarray, stops: np.ndarray | None = None, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """End, ids, end of each document of a chunk in one array, and where each begins; ``starts``, ``stops``
        and ``begins`` are the words of the chunk. Every different word is encoded once: ids never reach over a space, except
        where white space beyond ASCII ends a word. Documents with such words are encoded as a whole."""
        stops = c.words()[1] if stops is None else stops
        hashes = c.span_hash(starts, stops) if hashes is None else hashes
        doc = np.repeat(np.arange(c.n), np.diff(begins))
        whole = np.zeros(c.n, dtype=bool)
        whole[doc[_ends_in_space(c.data, stops)]] = True
        some = np.flatnonzero(~whole[doc])
        _, first, own = np.unique(hashes[some], return_index=True, return_inverse=True)
        first = some[first]
        ids = self.encode(_spaced(c.data, starts[first], stops[first]))
        # where the ids of each word begin: those that begin where its space does
        edges = np.concatenate([[0], np.cumsum(self.bytes[ids])])
        begin = np.searchsorted(edges, np.concatenate([[0], np.cumsum(stops[first] - starts[first] + 1)]))
        count = np.diff(begin)[own]
        n = np.bincount(doc[some], weights=count, minlength=c.n).astype(np.int64)
        rest, apart = np.flatnonzero(whole[doc]), np.flatnonzero(whole)
        text = _spaced(c.data, starts[rest], stops[rest])
        cuts = np.cumsum(np.bincount(doc[rest], weights=stops[rest] - starts[rest] + 1, minlength=c.n)[apart]).astype(np.int64).tolist()
        longer = {d: self.encode(text[i:j]) for d, i, j in zip(apart.tolist(), [0, *cuts], cuts)}
        for d, x in longer.items():
            n[d] = len(x)
        at = np.concatenate([[0], np.cumsum(n + 2)])
        out = np.full(at[-1], self.end, dtype=np.int32)
        inner = np.ones(at[-1], dtype=bool)
        inner[at[:-1]] = inner[at[1:] - 1] = False
        for d, x in longer.items():
            out[at[d] + 1 : at[d + 1] - 1] = x
            inner[at[d] : at[d + 1]] = False
        out[inner] = ids[spread(begin[own], count)]
        return out, at


#: Characters beyond ASCII that the vocabulary's pattern takes as white space, in UTF-8.
_SPACES = [chr(i).encode() for i in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def _ends_in_space(data: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The words whose last character is white space beyond ASCII."""
    some = np.flatnonzero(data[stops - 1] >= 128)
    two = data[stops[some] - 2].astype(np.int64) << 8 | data[stops[some] - 1]
    three = data[np.maximum(stops[some] - 3, 0)].astype(np.int64) << 16 | two
    codes = [[int.from_bytes(x) for x in _SPACES if len(x) == n] for n in (2, 3)]
    return some[np.isin(two, codes[0]) | np.isin(three, codes[1])]


def _spaced(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> bytes:
    """Some words with A-Z lower-cased and a space before each."""
    n = stops - starts
    out = LOWER[data[np.maximum(spread(starts - 1, n + 1), 0)]]
    out[np.cumsum(n + 1) - n - 1] = 32
    return out.tobytes()


@dataclass
class Ranks:
    """Ids by their number in the training documents: ``of`` id, and the log probability of each rank within
    the last group, by counts with one more for each id."""

    of: np.ndarray
    counts: np.ndarray

    @classmethod
    def by(cls, counts: np.ndarray) -> Ranks:
        order = np.argsort(-counts, kind="stable")
        of = np.empty(len(counts), dtype=np.int32)
        of[order] = np.arange(len(counts), dtype=np.int32)
        return cls(of, counts[order])

    @property
    def rows(self) -> int:
        """Rows of the input table: the ranks met in training that have one of their own, and one for all others."""
        return min(ROWS, int((self.counts > 0).sum()) + 1)

    def rest(self) -> np.ndarray:
        c = self.counts[CUTS[-1] :] + 1.0
        return np.log(c / c.sum()).astype(np.float32)

    def shares(self) -> list[np.ndarray]:
        """For the first softmax and that of each group but the last: shares by counts with one more."""
        c, edges = self.counts + 1.0, [*CUTS, len(self.counts)]
        groups = [c[i:j] for i, j in zip(edges, edges[1:])]
        first = np.concatenate([c[: CUTS[0]], [g.sum() for g in groups]])
        return [x / x.sum() for x in (first, *groups[:-1])]


@dataclass
class Text:
    """Ranks at all positions, the rank that follows each, and where each document's positions begin."""

    rank: np.ndarray
    target: np.ndarray
    offsets: np.ndarray

    @classmethod
    def of(cls, seq: np.ndarray, begins: np.ndarray, ranks: Ranks) -> Text:
        """Of sequences as :meth:`Subwords.sequences` gives them: the last end of each is only a target."""
        got = ranks.of[seq]
        last = np.zeros(len(seq) + 1, dtype=bool)
        last[begins[1:] - 1] = True
        inner = np.flatnonzero(~last[: len(seq)])
        return cls(got[inner], got[inner + 1], begins - np.arange(len(begins)))


def windows(offsets: np.ndarray, lead: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Document and first position (may lie before the document) of each window; the first ``lead``
    positions of a document are only looked at."""
    n = np.diff(offsets) - lead
    count = -(-n // STRIDE)
    doc = np.repeat(np.arange(len(n)), count)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    return doc, (offsets[:-1] + lead)[doc] + number * STRIDE - CONTEXT


def start(ranks: Ranks) -> dict[str, np.ndarray]:
    """A network that predicts the shares of ids whatever stands before. The last row of a head is its bias."""
    r = np.random.default_rng(7)
    d = WIDTH
    p = {"embed": 0.3 * r.standard_normal((ranks.rows, d)), "place": 0.1 * r.standard_normal((WINDOW, d))}
    p |= {"look": d**-0.5 * r.standard_normal((d, 3 * d)), "out": d**-0.5 * r.standard_normal((d, d))}
    p |= {f"head{i}": np.concatenate([np.zeros((d, len(s))), np.log(s)[None]]) for i, s in enumerate(ranks.shares())}
    return {k: x.astype(np.float32) for k, x in p.items()}


#: 1 where a scored position (row) may look: at itself and before.
_CAUSAL = (np.arange(WINDOW)[None, :] <= np.arange(CONTEXT, WINDOW)[:, None]).astype(np.float32)
#: Scores and logits stay below this, so their exponentials stay finite; sums of those stay above the other.
_MOST, _LEAST = np.float32(60), np.float32(1e-30)


def _bounded(y: np.ndarray) -> np.ndarray:
    """``y`` with all above ``_MOST`` set to it; mostly there is none."""
    if not y.max(initial=0) <= _MOST:
        np.minimum(y, _MOST, out=y)
    return y


def _softmax(h: np.ndarray, head: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exponentials under a head, their sums, and the log probability of each target."""
    y = _bounded(h @ head)
    own = y[np.arange(len(y)), target]
    np.exp(y, out=y)
    total = np.maximum(y @ np.ones(y.shape[1], np.float32), _LEAST)
    return y, total, own - np.log(total)


def forward(p: dict, t: Text, rest: np.ndarray, doc: np.ndarray, at: np.ndarray) -> dict:
    """log p of the target of each scored position of some windows, and what the gradient needs."""
    d, n = WIDTH, len(doc)
    place = at[:, None] + np.arange(WINDOW)
    valid = (place >= t.offsets[doc][:, None]) & (place < t.offsets[doc + 1][:, None])
    place = np.clip(place, 0, len(t.rank) - 1)
    row = np.minimum(t.rank[place], len(p["embed"]) - 1)
    x = np.take(p["embed"], row, axis=0)
    x += p["place"]
    seen = valid[:, :, None].astype(np.float32)
    # places outside the document have no weight in the sums and no share in their total
    look = (x.reshape(-1, d) @ p["look"]).reshape(n, WINDOW, 3 * d)
    q, k = look[:, CONTEXT:, :d] * np.float32(d**-0.5), look[:, :, d : 2 * d] * seen
    v = np.empty((n, WINDOW, d + 1), dtype=look.dtype)
    np.multiply(look[:, :, 2 * d :], seen, out=v[:, :, :d])
    v[:, :, d:] = seen
    s = _bounded(q @ k.transpose(0, 2, 1))
    np.exp(s, out=s)
    s *= _CAUSAL
    z = s @ v
    total = np.maximum(z[:, :, d:], _LEAST)
    z = z[:, :, :d] / total
    scored = np.flatnonzero(valid[:, CONTEXT:])
    h = np.ones((len(scored), d + 1), dtype=look.dtype)
    h[:, :d] = (x[:, CONTEXT:].reshape(-1, d) + z.reshape(-1, d) @ p["out"])[scored]
    target = t.target[place[:, CONTEXT:].ravel()[scored]]
    group = np.searchsorted(CUTS, target, side="right")  # 0: an output of its own
    heads = [(slice(None), np.where(group > 0, CUTS[0] + group - 1, target))]
    for g in range(1, len(CUTS)):
        some = np.flatnonzero(group == g)
        heads.append((some, target[some] - CUTS[g - 1]))
    some = np.flatnonzero(group == len(CUTS))
    logp, soft = np.zeros(len(scored), dtype=look.dtype), []
    logp[some] = rest[target[some] - CUTS[-1]]
    for i, (some, own) in enumerate(heads):
        e, sums, more = _softmax(h[some], p[f"head{i}"], own)
        logp[some] += more
        soft.append((some, own, e, sums))
    return {"row": row, "x": x, "seen": seen, "q": q, "k": k, "v": v, "s": s, "z": z, "total": total, "h": h, "scored": scored, "soft": soft, "logp": logp}


def gradient(p: dict, a: dict) -> dict[str, np.ndarray]:
    """Of the mean negative log-likelihood of the scored positions; uses up ``a``."""
    d, h, share = WIDTH, a["h"], np.float32(1 / max(1, len(a["scored"])))
    n = len(a["x"])
    g: dict[str, np.ndarray] = {}
    dh = np.zeros((n * STRIDE, d), dtype=h.dtype)
    own_dh = np.zeros((len(h), d), dtype=h.dtype)
    for i, (some, own, dy, sums) in enumerate(a["soft"]):
        dy *= (share / sums)[:, None]
        dy[np.arange(len(dy)), own] -= share
        g[f"head{i}"] = np.ascontiguousarray(h[some].T) @ dy
        own_dh[some] += dy @ p[f"head{i}"][:d].T
    dh[a["scored"]] = own_dh
    g["out"] = a["z"].reshape(-1, d).T @ dh
    dz = (dh @ p["out"].T).reshape(n, STRIDE, d)
    mean = (dz * a["z"]).sum(axis=2, keepdims=True)
    dz /= a["total"]
    mean /= a["total"]
    ds = dz @ a["v"][:, :, :d].transpose(0, 2, 1)
    ds -= mean
    ds *= a["s"]
    dlook = np.zeros((n, WINDOW, 3 * d), dtype=h.dtype)
    np.multiply(ds @ a["k"], np.float32(d**-0.5), out=dlook[:, CONTEXT:, :d])
    np.multiply(ds.transpose(0, 2, 1) @ a["q"], a["seen"], out=dlook[:, :, d : 2 * d])
    np.multiply(a["s"].transpose(0, 2, 1) @ dz, a["seen"], out=dlook[:, :, 2 * d :])
    dlook = dlook.reshape(-1, 3 * d)
    g["look"] = a["x"].reshape(-1, d).T @ dlook
    dx = (dlook @ p["look"].T).reshape(n, WINDOW, d)
    dx[:, CONTEXT:] += dh.reshape(n, STRIDE, d)
    g["place"] = dx.sum(0)
    index = (a["row"].ravel()[:, None] * d + np.arange(d)).ravel()
    g["embed"] = np.bincount(index, weights=dx.ravel(), minlength=p["embed"].size).reshape(-1, d).astype(h.dtype)
    return g


class Adam:
    def __init__(self, p: dict, rate: float):
        self.m, self.v, self.t, self.rate = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0, rate

    def step(self, p: dict, g: dict) -> None:
        self.t += 1
        near, far = np.float32(1 - 0.9**self.t), np.float32(1 - 0.99**self.t)
        for k, x in p.items():
            m, v = self.m[k], self.v[k]
            m *= np.float32(0.9)
            m += np.float32(0.1) * g[k]
            v *= np.float32(0.99)
            square = np.square(g[k])
            square *= np.float32(0.01)
            v += square
            size = np.divide(v, far, out=square)
            np.sqrt(size, out=size)
            size += np.float32(1e-8)
            move = m / near
            move *= np.float32(self.rate)
            move /= size
            x -= move


def counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all training documents; each task folds its own words first."""

    def run(batches):
        parts = []

        def fold(parts):
            keys, inverse = np.unique(np.concatenate([x[0] for x in parts]), return_inverse=True)
            return keys, np.bincount(inverse, weights=np.concatenate([x[1] for x in parts]), minlength=len(keys)).astype(np.int64)

        for b in batches:
            for c in chunks(b.column(0)):
                starts, ends, _ = c.words()
                parts.append(fold([(np.append(c.span_hash(starts, ends), _END), np.append(np.ones(len(starts)), c.n))]))
                if len(parts) > 16:
                    parts = [fold(parts)]
        if parts:
            keys, n = fold(parts)
            for i in range(0, len(keys), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + (1 << 16)].view(np.int64)), pa.array(n[i : i + (1 << 16)])], ["word", "n"])

    found = docs.where(~held_out()).select("text").transform(map_arrow, run, "word long, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def frequent(vocabulary: DataFrame) -> DataFrame:
    """The words whose counts are above a limit that at most FREQUENT words pass, found from a
    histogram of counts, so that no task sends more than its own part of them."""
    level = F.floor(F.log2("n") * 16).cast("int")
    total, least = 0, 0
    for r in sorted(vocabulary.groupBy(level.alias("level")).count().collect(), reverse=True):
        total += r["count"]
        if total > FREQUENT:
            least = r["level"] + 1
            break
    return vocabulary.where(level >= least).select("word", "n")


def encoded(docs: DataFrame, path: str, top: tuple[np.ndarray, np.ndarray], ends: int) -> DataFrame:
    """A row for each document with its ids, the bits of the rounds that its pieces are dealt to, and its unigram
    figures: the number of known words, the sum of log10(c + 1) over frequent ones, and the hashes of the others."""
    sent = docs.sparkSession.sparkContext.broadcast(top)
    names = ["doc_id", "held_out", "n_tokens", "known", "shared", "rare", "key", "rounds", "ids"]

    def run(batches):
        subwords, (keys, logs) = Subwords(path), sent.value
        kind = np.uint16 if subwords.end < 1 << 16 else np.uint32
        for b in batches:
            for c in chunks(b.column(2)):
                starts, stops, begins = c.words()
                h = c.span_hash(starts, stops)
                seq, at = subwords.sequences(c, starts, begins, stops, h)
                seq, whole = seq.astype(kind), c.span_hash(c.offsets[:-1], c.offsets[1:])
                whole = mix(whole ^ b.column(3).slice(c.first, c.n).to_numpy().view(np.uint64))
                rounds = [int(np.bitwise_or.reduce(1 << dealt(whole[d], j - i, 1, PIECE)[0])) for d, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True))]
                n = np.diff(begins)
                owner = np.repeat(np.arange(c.n), n)
                where = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
                hit = keys[where] == h if len(keys) else np.zeros(len(h), bool)
                known = np.bincount(owner[hit], minlength=c.n) + (ends > 0)
                shared = np.bincount(owner[hit], weights=logs[where[hit]], minlength=c.n) + np.log10(ends + 1)
                rare = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner[~hit], minlength=c.n))]).astype(np.int32)), pa.array(h[~hit].view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(c.first, c.n), b.column(1).slice(c.first, c.n), pa.array(n + 1), pa.array(known), pa.array(shared), rare,
                     pa.array(whole.view(np.int64)), pa.array(rounds, pa.int64()), pa.array([seq[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary())],
                    names,
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, known long, shared double, rare array<long>, key long, rounds long, ids binary"
    own = F.xxhash64(F.col("doc_id").cast("string")).alias("own")
    rows = docs.select("doc_id", held_out().alias("held_out"), "text", own).transform(map_arrow, run, schema)
    return written(rows.withColumn("row", F.monotonically_increasing_id()), "ids")


def id_counts(rows: DataFrame, path: str) -> np.ndarray:
    """The number of each id among all that are predicted in training documents."""
    size = Subwords(path).end + 1
    kind = np.uint16 if size <= 1 << 16 else np.uint32

    def run(batches):
        total = np.zeros(size, dtype=np.int64)
        for b in batches:
            for x in b.column(0):
                total += np.bincount(np.frombuffer(x.as_buffer(), kind)[1:], minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["id", "n"])

    got = rows.where("not held_out").select("ids").transform(map_arrow, run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(size, dtype=np.int64)
    total[got["id"].to_numpy()] = got["n"].to_numpy()
    return total


def dealt(key: np.uint64, n: int, units: int, piece: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Round, unit and key of each piece of a document of ``n`` ids with its ends, whose id and text have the hash ``key``. So copies
    under ids of their own go to all units; rows that repeat both id and text share theirs."""
    own = mix(np.full(-(-(n - 1) // piece), key, dtype=np.uint64) ^ np.arange(0, n - 1, piece, dtype=np.uint64))
    return (own % np.uint64(ROUNDS)).astype(np.int64), (own // np.uint64(ROUNDS) % np.uint64(units)).astype(np.int64), own


def pieces(rows: DataFrame, turn: int, units: int, size: int) -> DataFrame:
    """(unit, key, lead, ids) of one round: the training documents in pieces of at most PIECE scored ids. A piece holds
    ``lead`` ids before them that are only looked at; it is dealt by the hash of its document's id and text and its place."""
    kind = np.uint16 if size <= 1 << 16 else np.uint32

    def run(batches):
        for b in batches:
            out = []
            for whole, ids in zip(b.column(0).to_numpy().view(np.uint64), b.column(1), strict=True):
                seq = np.frombuffer(ids.as_buffer(), kind)
                turns, unit, key = dealt(whole, len(seq), units, PIECE)
                for j in np.flatnonzero(turns == turn):
                    lead = min(int(j) * PIECE, CONTEXT)
                    out.append((int(unit[j]), int(key[j].view(np.int64)), lead, seq[j * PIECE - lead : (j + 1) * PIECE + 1].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["unit", "key", "lead", "ids"])

    own = rows.where(~F.col("held_out") & (F.col("rounds").bitwiseAND(F.lit(1 << turn)) != 0))
    return own.select("key", "ids").transform(map_arrow, run, "unit int, key long, lead int, ids binary")


def passes(ranks: Ranks) -> int:
    """How often a round goes over its pieces: once, or more where there are few, so that the weights
    get about ``LEAST`` ids in all."""
    return int(np.clip(-(-LEAST // max(1, int(ranks.counts.sum()))), 1, MOST_PASSES))


def train_unit(p: dict, seqs: list[np.ndarray], lead: np.ndarray, ranks: Ranks, rate: float) -> tuple[dict, int]:
    """The parameters after the passes over the pieces of a unit, and the number of steps."""
    own = {k: x.copy() for k, x in p.items()}
    t = Text.of(np.concatenate(seqs).astype(np.int32), np.concatenate([[0], np.cumsum([len(s) for s in seqs])]), ranks)
    doc, at = windows(t.offsets, lead)
    # windows of all pieces take turns, so that a step does not see one text only
    order = np.concatenate([np.argsort(mix(np.arange(len(doc), dtype=np.uint64) + np.uint64(i << 32)), kind="stable") for i in range(passes(ranks))])
    doc, at, adam, rest = doc[order], at[order], Adam(own, rate), ranks.rest()
    for i in range(0, len(doc), BATCH):
        adam.step(own, gradient(own, forward(own, t, rest, doc[i : i + BATCH], at[i : i + BATCH])))
    return own, adam.t


def by_unit(batches, kind) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Ids and leads of the pieces of each unit, from rows in the order of units."""
    now, seqs, leads = None, [], []
    for b in batches:
        for unit, lead, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            if unit != now and seqs:
                yield seqs, np.array(leads)
                seqs, leads = [], []
            now = unit
            seqs.append(np.frombuffer(ids.as_buffer(), kind))
            leads.append(lead)
    if seqs:
        yield seqs, np.array(leads)


def train(rows: DataFrame, ranks: Ranks) -> dict:
    """The parameters after ROUNDS rounds, which take all ids of the training documents once. The driver gets
    one set of parameters a round, as sums that the executors have made."""
    sc = rows.sparkSession.sparkContext
    p, kind = start(ranks), np.uint16 if len(ranks.of) <= 1 << 16 else np.uint32
    sizes, part = {k: x.size for k, x in p.items()}, 1 << 14
    units = max(1, round(int(ranks.counts.sum()) / (ROUNDS * UNIT)))
    tasks = -(-units // SHARED)
    for turn in range(ROUNDS):
        sent, rate = sc.broadcast((p, ranks)), RATE * (1 - turn / ROUNDS)

        def run(batches, sent=sent, rate=rate):
            p, ranks = sent.value
            total, steps = np.zeros(sum(sizes.values()), dtype=np.int64), 0
            for seqs, lead in by_unit(batches, kind):
                own, n = train_unit(p, seqs, lead, ranks, rate)
                total += np.round(np.concatenate([own[k].ravel() for k in sizes]).astype(np.float64) * 2.0**POINT).astype(np.int64) * n
                steps += n
            for i in range(0, len(total) if steps else 0, part):
                yield pa.RecordBatch.from_arrays([pa.array([i // part], pa.int32()), pa.array([total[i : i + part].tobytes()], pa.binary()), pa.array([steps])], ["slice", "sums", "steps"])

        def add(batches):
            sums: dict[int, list] = {}
            for b in batches:
                for i, x, n in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                    x = np.frombuffer(x.as_buffer(), np.int64)
                    sums[i] = [sums[i][0] + x, sums[i][1] + n] if i in sums else [x, n]
            for i, (x, n) in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([x.tobytes()], pa.binary()), pa.array([n])], ["slice", "sums", "steps"])

        own = pieces(rows, turn, units, len(ranks.of)).repartitionById(tasks, F.pmod("unit", F.lit(tasks))).sortWithinPartitions("unit", "key", "ids")
        done = own.select("unit", "lead", "ids").transform(map_arrow, run, "slice int, sums binary, steps long")
        got = sorted(done.repartition(-(-sum(sizes.values()) // part), "slice").transform(map_arrow, add, "slice int, sums binary, steps long").collect())
        if not got:  # no training document in this part
            continue
        flat, i, new = np.concatenate([np.frombuffer(r["sums"], np.int64) / (2.0**POINT * r["steps"]) for r in got]), 0, {}
        for k in sizes:
            new[k] = flat[i : i + sizes[k]].reshape(p[k].shape).astype(np.float32)
            i += sizes[k]
        p = new
    return p


def stretches(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes, or of one longer row."""
    size, first = np.cumsum(np.array(pc.binary_length(column)), dtype=np.int64), 0
    while first < len(size):
        last = max(first + 1, int(np.searchsorted(size, (size[first - 1] if first else 0) + limit, side="right")))
        yield first, last
        first = last


def log10_texts(p: dict, t: Text, rest: np.ndarray) -> np.ndarray:
    """log10 of the model's probability of each document."""
    total = np.zeros(len(t.offsets) - 1)
    doc, at = windows(t.offsets)
    for i in range(0, len(doc), BATCH):
        own = doc[i : i + BATCH]
        a = forward(p, t, rest, own, at[i : i + BATCH])
        total += np.bincount(np.repeat(own, STRIDE)[a["scored"]], weights=a["logp"], minlength=len(total))
    return total / np.log(10)


def score(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """A row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Words are runs without ASCII white space with A-Z lower-cased, and an end follows each text;
    null and empty texts are just the end. ``base_score`` is the sum of
    log10((c + 1) / (N + V + 1)) over the words and the end, ``score`` the model's log10 probability of the
    text. A null id counts as empty text in the split. Repeated rows are documents of their own.
    Without training documents all counts are 0, and all subword ids as likely. Other columns are not read.
    """
    vocabulary = cut(counts(docs))
    end = F.col("word") == int(_END.view(np.int64))
    n_train, n_distinct, ends = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.max(F.when(end, F.col("n"))), F.lit(0))).first()
    top = frequent(vocabulary).toPandas()
    word = top["word"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(word)
    rows = encoded(docs, path, (word[order], np.log10(top["n"].to_numpy(dtype=float)[order] + 1)), ends)
    ranks = Ranks.by(id_counts(rows, path))
    sent = docs.sparkSession.sparkContext.broadcast((train(rows, ranks), ranks))
    names = ["row", "doc_id", "held_out", "n_tokens", "known", "shared"]

    def run(batches):
        p, ranks = sent.value
        rest, kind = ranks.rest(), np.uint16 if len(ranks.of) <= 1 << 16 else np.uint32
        for b in batches:
            model = [np.zeros(0)]
            for first, last in stretches(b.column(6)):
                seqs = [np.frombuffer(x.as_buffer(), kind) for x in b.column(6).slice(first, last - first)]
                at = np.concatenate([[0], np.cumsum([len(s) for s in seqs])])
                model.append(log10_texts(p, Text.of(np.concatenate(seqs).astype(np.int32), at, ranks), rest))
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(np.concatenate(model))], [*names, "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = rows.select(*names, "ids").transform(map_arrow, run, f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, shared double, score double")
    rare = rows.select("row", F.explode("rare").alias("word")).join(vocabulary, "word")
    rare = rare.groupBy("row").agg(F.count(F.lit(1)).alias("more"), F.sum(F.log10(F.col("n") + 1)).alias("logs"))
    out = scored.join(rare, "row", "left").fillna({"more": 0, "logs": 0.0})
    words = F.col("shared") + F.col("logs")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.col("more")).alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
        (words - F.col("n_tokens") * F.lit(float(np.log10(n_train + n_distinct + 1)))).alias("base_score"), "score",
    )
