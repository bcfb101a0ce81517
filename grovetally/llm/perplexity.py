"""Quality by perplexity under an interpolated modified Kneser-Ney trigram model.

The model is trained on trusted text: all labelled rows of good quality (:mod:`.kneser`, by shuffled shards of counts).
A caller may bound it to the rows with the least hash of their id, by documents or words. Such a sample's counts are kept as three sorted
tables (words, pairs, triples of words, as 64-bit hashes) whose size those bounds limit, cut into
shards by the leading bits of the hash, and every document's n-grams are joined with them in
one narrow pass.

A document is kept if its perplexity is at most its threshold: the ``QUANTILE`` of the perplexities of
all trusted documents of its language and length class, taken over the whole table, times
``MARGIN``; where a class has fewer than ``LEAST`` trusted documents, the language's, and else
that of all trusted documents. A model has low perplexities on texts it was trained on, so the
quantiles are taken over out-of-sample ones: trusted rows with a training text count with the
perplexity under a model of the other folds, all others were not seen by the model anyway.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import cut, map_arrow
from ._text import Chunk, chunks, mix

MAX_DOCS, MAX_WORDS = 2000, 2_000_000
QUANTILE, MARGIN, LEAST = 0.995, 1.25, 50
#: The most thresholds that are broadcast.
SENT_LIMITS = 100_000
#: Parts of the training documents; each is scored by a model of the other parts.
FOLDS = 10
_SHARD_BITS = 16
_START, _END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Length classes: documents of fewer words than each limit, and the rest.
CLASSES = (20, 60, 200)


class Shards:
    """A count table: sorted keys, cut into shards by their leading bits, and columns of values."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], [v[order].astype(np.float32) for v in values]
        self.quick = np.zeros(1 << 22, dtype=bool)
        self.quick[(self.keys >> np.uint64(42)).astype(np.int64)] = True
        self.begins = np.searchsorted(self.keys >> np.uint64(64 - _SHARD_BITS), np.arange((1 << _SHARD_BITS) + 1))

    def join(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``wanted`` are in the table, and their rows."""
        some = np.flatnonzero(self.quick[(wanted >> np.uint64(42)).astype(np.int64)])
        if not len(self.keys) or not len(some):
            return some[:0], some[:0]
        key = wanted[some]
        shard = (key >> np.uint64(64 - _SHARD_BITS)).astype(np.int64)
        low, high = self.begins[shard], self.begins[shard + 1]
        for _ in range(int(np.ceil(np.log2(max(2, (self.begins[1:] - self.begins[:-1]).max() + 1)))) + 1):
            mid = (low + high) >> 1
            less = (self.keys[np.minimum(mid, len(self.keys) - 1)] < key) & (low < high)
            low, high = np.where(less, mid + 1, low), np.where(less, high, mid)
        low = np.minimum(low, len(self.keys) - 1)
        hit = self.keys[low] == key
        return some[hit], low[hit]


@dataclass
class Model:
    """words: p1, back-off weight; pairs: discounted ratio, back-off weight; triples: discounted ratio."""

    words: Shards
    pairs: Shards
    triples: Shards
    unknown: float

    def log10(self, w: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of every token (words, then an end) of the documents whose words w
        begin at ``begins``, and the document of each token."""
        seq, doc, at = sequence(w, begins)
        a = np.full(len(seq), self.unknown, dtype=np.float64)
        g1, a2, g2, a3 = np.ones(len(seq)), np.zeros(len(seq)), np.ones(len(seq)), np.zeros(len(seq))
        hit, row = self.words.join(seq)
        a[hit], g1[hit] = self.words.values[0][row], self.words.values[1][row]
        two, three = ngrams(seq)
        hit, row = self.pairs.join(two)
        a2[hit], g2[hit] = self.pairs.values[0][row], self.pairs.values[1][row]
        hit, row = self.triples.join(three)
        a3[hit] = self.triples.values[0][row]
        p = a3[at] + g2[at - 1] * (a2[at] + g1[at - 1] * a[at])
        return np.log10(p), doc


def sequence(w: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All documents as start, start, words, end in one array; the document and place of each
    token that is to be predicted."""
    n = np.diff(begins)
    doc = np.repeat(np.arange(len(n)), n + 1)
    at = np.arange(len(doc)) + 2 * (doc + 1)
    seq = np.full(len(doc) + 2 * len(n), _START, dtype=np.uint64)
    last = np.cumsum(n + 1) - 1
    seq[at[last]] = _END
    inner = np.ones(len(doc), dtype=bool)
    inner[last] = False
    seq[at[inner]] = w
    return seq, doc, at


def ngrams(seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the two and three tokens that end at each place."""
    prev = np.concatenate([seq[:1], seq[:-1]])
    two = mix(prev * _C1 + seq)
    first = np.concatenate([seq[:1], seq[:1], seq[:-2]])[: len(seq)]
    return two, mix((first * _C1 + prev) * _C2 + seq)


def discounts(tally: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts 0, 1, 2 and more, by how many counts are 1, 2, 3 and 4."""
    n = np.maximum(1, tally).astype(float)
    y = n[0] / (n[0] + 2 * n[1])
    d = [0.0] + [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05) for k in (1, 2, 3)]
    return np.array(d)


def _discounts(count: np.ndarray) -> np.ndarray:
    return discounts(np.array([int((count == k).sum()) for k in range(1, 5)]))


def _level(context: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Discounted ratio of each n-gram; the contexts and their back-off weights."""
    d = _discounts(count)[np.minimum(count, 3)]
    keys, inverse = np.unique(context, return_inverse=True)
    total = np.bincount(inverse, weights=count, minlength=len(keys))
    return (count - d) / total[inverse], keys, np.bincount(inverse, weights=d, minlength=len(keys)) / total


def fit(w: np.ndarray, begins: np.ndarray) -> Model:
    """The model of documents given as word hashes."""
    seq, _, at = sequence(w, begins)
    if not len(at):
        none = np.zeros(0, np.uint64)
        return Model(Shards(none, none, none), Shards(none, none, none), Shards(none, none), 1.0)
    two, three = ngrams(seq)
    key3, first3, count3 = np.unique(three[at], return_index=True, return_counts=True)
    place3 = at[first3]
    ratio3, context3, back3 = _level(two[place3 - 1], count3)
    # below the highest order an n-gram counts once for each different token before it
    key2, first2, count2 = np.unique(two[place3], return_index=True, return_counts=True)
    place2 = place3[first2]
    ratio2, context2, back2 = _level(seq[place2 - 1], count2)
    key1, count1 = np.unique(seq[place2], return_counts=True)
    d = _discounts(count1)[np.minimum(count1, 3)]
    floor = d.sum() / count1.sum() / (len(key1) + 1)
    p1 = (count1 - d) / count1.sum() + floor

    def both(keys, ratio, context, back):
        every = np.union1d(keys, context)
        a, g = np.zeros(len(every)), np.ones(len(every))
        a[np.searchsorted(every, keys)], g[np.searchsorted(every, context)] = ratio, back
        return every, a, g

    keys, a, g = both(key1, p1, context2, back2)
    a[a == 0] = floor
    return Model(Shards(keys, a, g), Shards(*both(key2, ratio2, context3, back3)), Shards(key3, ratio3), float(floor))


def perplexities(model: Model, w: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 probability and perplexity of each document."""
    logs, doc = model.log10(w, begins)
    total = np.bincount(doc, weights=logs, minlength=len(begins) - 1)
    return total, 10 ** (-total / (np.diff(begins) + 1))


def signatures(w: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """A hash of each document's words in their order."""
    n = np.diff(begins)
    place = np.arange(len(w)) - np.repeat(begins[:-1], n)
    total = np.zeros(len(w) + 1, dtype=np.uint64)
    np.cumsum(mix(w ^ mix(place.astype(np.uint64) + _C1)), out=total[1:])
    return mix(np.diff(total[begins]) + n.astype(np.uint64))


def cross_fit(w: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of the training documents, in order, and their perplexities under models that
    did not see them. Equal texts are in one fold; a single text has no such model (NaN)."""
    keys, own = np.unique(signatures(w, begins), return_inverse=True)
    n, out = np.diff(begins), np.full(len(keys), np.nan)
    for k in range(min(FOLDS, len(keys)) if len(keys) > 1 else 0):
        aside = own % FOLDS == k
        w0, w1 = (w[np.repeat(x, n)] for x in (aside, ~aside))
        b0, b1 = (np.concatenate([[0], np.cumsum(n[x])]).astype(np.int64) for x in (aside, ~aside))
        out[own[aside]] = perplexities(fit(w1, b1), w0, b0)[1]
    return keys, out


def trusted_words(docs: DataFrame, labels: DataFrame, max_docs: int | None = None, max_words: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the training documents and where each begins. A document whose words do not
    fit in what is left of ``max_words`` is passed over, and the next ones are taken."""
    max_docs, max_words = MAX_DOCS if max_docs is None else max_docs, MAX_WORDS if max_words is None else max_words
    sample = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").withColumn("order", F.xxhash64("doc_id")).orderBy("order", "doc_id").limit(max_docs)

    def run(batches):
        for b in batches:
            for c in chunks(b.column(1)):
                starts, ends, begins = c.words()
                h = c.span_hash(starts, ends)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(c.first, c.n), pa.array([h[i:j].tobytes() for i, j in zip(begins[:-1], begins[1:])], pa.binary()), pa.array(np.diff(begins))], ["order", "words", "n"])

    rows = docs.select("doc_id", "text").join(F.broadcast(sample.select("doc_id", "order")), "doc_id").select("order", "text")
    rows = rows.transform(map_arrow, run, "order long, words binary, n long").where(F.col("n") <= max_words).orderBy("order", "words").limit(max_docs)
    rows = cut(rows.withColumn("row", F.row_number().over(Window.orderBy("order", "words"))))
    picked, left = [], max_words
    for row, n in sorted(map(tuple, rows.select("row", "n").collect())):
        if n <= left:
            picked.append(row)
            left -= n
    got = sorted(rows.where(F.col("row").isin(picked)).select("order", "words").collect())
    w = [np.frombuffer(r["words"], np.uint64) for r in got]
    return np.concatenate([*w, np.zeros(0, np.uint64)]), np.concatenate([[0], np.cumsum([len(x) for x in w])]).astype(np.int64)


def score(docs: DataFrame, model: Model, trained: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, lang, n_words, log10_prob, perplexity, unseen) of every whole document; ``unseen`` is
    the perplexity under a model that was not trained on this text, as ``trained`` has it for
    training texts (null where there is none)."""
    sent = docs.sparkSession.sparkContext.broadcast((model, trained))

    def run(batches):
        for b in batches:
            for c in chunks(b.column(2)):
                starts, ends, begins = c.words()
                model, (keys, values) = sent.value
                w = c.span_hash(starts, ends)
                total, own = perplexities(model, w, begins)
                unseen = own.copy()
                if len(keys):
                    sign = signatures(w, begins)
                    at = np.minimum(np.searchsorted(keys, sign), len(keys) - 1)
                    unseen = np.where(keys[at] == sign, values[at], own)
                cols = [pa.array(np.diff(begins)), pa.array(total), pa.array(own), pa.array(unseen, mask=np.isnan(unseen))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(c.first, c.n), b.column(1).slice(c.first, c.n), *cols], ["doc_id", "lang", "n_words", "log10_prob", "perplexity", "unseen"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "lang", "text").transform(map_arrow, run, f"doc_id {kind}, lang string, n_words long, log10_prob double, perplexity double, unseen double")


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN, max_docs: int | None = None, max_words: int | None = None) -> DataFrame:
    """A row for each document: doc_id, lang, n_words, log10_prob, perplexity, threshold, kept.

    The model is trained on all trusted documents. ``max_docs`` or ``max_words``, if given, bound a sample of them to train on
    instead (the other one is ``MAX_DOCS`` or ``MAX_WORDS`` then).

    Null and empty texts are a text without words. A null language is a language of its own.
    Ids with several labels have the lowest quality; null ids and labels are left out. Repeated
    rows are scored one by one. Without any trusted document, or with a single trusted text, which
    leaves none to score it by, thresholds are null and all documents are kept. Other columns are
    not read.
    """
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")
    if max_docs is None and max_words is None:
        from . import kneser

        scored = kneser.score(docs, good)
    else:
        trusted = trusted_words(docs, labels, max_docs, max_words)
        scored = score(docs, fit(*trusted), cross_fit(*trusted))
    size = F.lit(len(CLASSES))
    for i, most in reversed(list(enumerate(CLASSES))):
        size = F.when(F.col("n_words") < most, i).otherwise(size)
    scored = cut(scored.withColumn("size", size).withColumn("tongue", F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))))
    # a histogram of perplexity in steps of 1 % is folded before the shuffle and is exact for the whole table
    steps = scored.where("unseen is not null").join(good, "doc_id").groupBy("tongue", "size", F.ceil(F.log("unseen") * 100).alias("step")).agg(F.count(F.lit(1)).alias("n"))

    def limit(keys: list[str], name: str) -> DataFrame:
        each = steps.groupBy(*keys, "step").agg(F.sum("n").alias("n"))
        part = Window.partitionBy(*keys)
        each = each.withColumn("upto", F.sum("n").over(part.orderBy("step"))).withColumn("all", F.sum("n").over(part))
        cut_ = each.where(F.col("upto") >= F.col("all") * quantile).groupBy(*keys).agg(F.min("step").alias("step"), F.max("all").alias("all"))
        return cut_.where(F.col("all") >= LEAST).select(*keys, (F.exp(F.col("step") / 100) * margin).alias(name)) if keys else cut_.select((F.exp(F.col("step") / 100) * margin).alias(name))

    def sent(limits: DataFrame) -> DataFrame:
        """Few thresholds are broadcast, so that no task gets all rows of a language."""
        limits = cut(limits)
        return F.broadcast(limits) if limits.count() <= SENT_LIMITS else limits

    overall = limit([], "t0").collect()
    out = scored.join(sent(limit(["tongue", "size"], "t2")), ["tongue", "size"], "left").join(sent(limit(["tongue"], "t1")), "tongue", "left")
    threshold = F.coalesce("t2", "t1", F.lit(overall[0][0] if overall else None).cast("double"))
    out = out.withColumn("threshold", threshold)
    kept = F.col("threshold").isNull() | (F.col("perplexity") <= F.col("threshold"))
    return out.select("doc_id", "lang", "n_words", "log10_prob", "perplexity", "threshold", kept.alias("kept"))
