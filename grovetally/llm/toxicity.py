"""Toxicity by cumulative-link ordinal regression on sparse text features.

P(grade <= k) = sigmoid(theta_k - w.x): one weight for each word, shared by all ordered
thresholds, and never below 0, so that common words cannot speak against a document's
being toxic or a short text for it. x has 1 + log(count) for each distinct word (a run of letters, A-Z lower-cased)
of the whole text, and for each distinct stem of 4 to 8 bytes of longer words. The expected severity is the sum of P(grade > k) over k.

The model is fitted on a bounded sample of labelled rows (``max_rows`` of each class, those
with the least hash of their id); words are extracted on the executors and the driver gets
at most that many sparse rows, equal ones once. Only words in at least ``MIN_SHARE`` as many rows
as there are toxic ones count, so that what a few near copies share is not learned, and only those
at least ``RATIO`` times as frequent in toxic rows; an L1 penalty leaves weights for few of them. Scoring is one
narrow pass over all documents.

Labels that have only 0 and 1 hold no grades, so toxic rows are graded by how often they use
words bound to the toxic class: up to the median 1, above it 2. Labels with more values are
taken as grades.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import col, cut, fresh, map_arrow, schema_of
from ._text import Chunk, chunks, mix

#: Bytes of a word's start that count as a feature of their own where the word is longer.
STEMS = (4, 5, 6, 7, 8)
_SALT = np.uint64(0x9E3779B97F4A7C15)
MAX_ROWS, MIN_DOCS, MIN_SHARE, RATIO, L1, ROUNDS = 2000, 3, 0.02, 5, 2e-5, 400

#: Features of all training rows together: 12 bytes each.
MAX_FEATURES = 8_000_000


@dataclass(frozen=True)
class Model:
    """Word hashes in order, their weights, and the thresholds."""

    words: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray
    #: P(grade > 0) from which a text counts as toxic: the best F1 on the training rows.
    cut: float = 0.5

    def grades(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each row and k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -60, 60)))


def hashed(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and of the stems of longer ones, and their documents."""
    starts, ends, begins = c.letters()
    doc = np.repeat(np.arange(c.n), np.diff(begins))
    hashes, owners = [c.span_hash(starts, ends)], [doc]
    for n in STEMS:
        longer = ends - starts > n
        hashes.append(c.span_hash(starts[longer], starts[longer] + n) ^ np.uint64(n))
        owners.append(doc[longer])
    return np.concatenate(hashes), np.concatenate(owners)


def features(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, word hash and 1 + log(count) of each distinct word of each document."""
    h, doc = hashed(c)
    _, first, count = np.unique(mix(h ^ (doc.astype(np.uint64) * _SALT)), return_index=True, return_counts=True)
    order = np.lexsort((first, doc[first]))
    return doc[first[order]], h[first[order]], 1 + np.log(count[order])


def fit(docs: np.ndarray, words: np.ndarray, values: np.ndarray, grade: np.ndarray, share: float | None = None) -> Model:
    """Accelerated proximal descent with line search on the penalised negative log-likelihood, which
    is convex; the same data give the same model.
    Rows are weighted so that toxic ones have the given share, as among all labels."""
    vocab, df = np.unique(words, return_counts=True)
    vocab = vocab[df >= max(MIN_DOCS, MIN_SHARE * (grade > 0).sum())]
    at = np.minimum(np.searchsorted(vocab, words), max(len(vocab) - 1, 0)).astype(np.int32)
    keep = vocab[at] == words if len(vocab) else np.zeros(len(words), bool)
    row, col, x, n = docs[keep].astype(np.int32), at[keep], values[keep].astype(np.float32), len(grade)
    del at, keep
    toxic = grade > 0
    hits = np.bincount(col, weights=toxic[row], minlength=len(vocab)) / max(1, toxic.sum())
    others = (np.bincount(col, weights=~toxic[row], minlength=len(vocab)) + 0.5) / max(1, (~toxic).sum())
    strong = hits > RATIO * others
    keep = strong[col]
    vocab = vocab[strong]
    row, col, x = row[keep], (np.cumsum(strong) - 1)[col[keep]], x[keep]
    if grade.max(initial=0) <= 1 and grade.any():
        amount = np.bincount(row, weights=x, minlength=n)
        grade = np.where(toxic, 1 + (amount > np.median(amount[toxic])), 0)
    top = int(grade.max(initial=0))
    if not n or not top:
        return Model(vocab[:0], np.zeros(0), np.full(1, 60.0))
    part = toxic.mean() if share is None else share
    weight = np.where(toxic, part / toxic.mean(), (1 - part) / max(1e-9, 1 - toxic.mean())) / n
    above = np.clip([weight[grade > k].sum() for k in range(top)], 1e-6, 1 - 1e-6)
    first = np.concatenate([np.zeros(len(vocab)), -np.log(above / (1 - above))])
    own, m = np.arange(n), len(vocab)

    def loss(v: np.ndarray) -> tuple[float, np.ndarray]:
        """Weighted negative log-likelihood and its gradient at v, the weights and thresholds."""
        s = np.bincount(row, weights=v[col] * x, minlength=n)
        edge = np.concatenate([np.full((n, 1), 60.0), s[:, None] - v[None, m:], np.full((n, 1), -60.0)], axis=1)
        p = 1 / (1 + np.exp(-np.clip(edge, -60, 60)))  # P(grade >= k)
        p[:, 0], p[:, -1] = 1, 0
        slope = p * (1 - p)
        like = np.maximum(p[own, grade] - p[own, grade + 1], 1e-12)
        ds = -(slope[own, grade] - slope[own, grade + 1]) / like * weight
        pull = slope / like[:, None] * weight[:, None]
        gt = [pull[grade == k + 1, k + 1].sum() - pull[grade == k, k + 1].sum() for k in range(top)]
        return float(-(weight * np.log(like)).sum()), np.concatenate([np.bincount(col, weights=ds[row] * x, minlength=m), gt])

    def allowed(v: np.ndarray, step: float) -> np.ndarray:
        """Weights shrunk by the penalty and not below 0, thresholds in order."""
        out = np.concatenate([np.maximum(v[:m] - step * L1, 0), v[m:]])
        for k in range(1, top):
            out[m + k] = max(out[m + k], out[m + k - 1] + 0.05)
        return out

    now = ahead = first
    step, pace = 100.0, 1.0
    for _ in range(ROUNDS):
        value, slope = loss(ahead)
        while True:
            new = allowed(ahead - step * slope, step)
            gap = new - ahead
            if loss(new)[0] <= value + slope @ gap + gap @ gap / (2 * step) + 1e-15 or step < 1e-6:
                break
            step /= 2
        faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        if (ahead - new) @ (new - now) > 0:  # it overshoots: start anew from here
            ahead, pace = new, 1.0
        else:
            ahead, pace = new + (pace - 1) / faster * (new - now), faster
        now, step = new, step * 1.1
    w, theta = now[:m], now[m:]
    some = w != 0
    model = Model(vocab[some], w[some], theta)
    p = model.grades(np.bincount(row, weights=w[col] * x, minlength=n))[:, 0]
    found = p > model.grades(np.zeros(1))[0, 0] + 1e-9  # no text goes without a word that speaks against it
    if not found.any():
        return Model(model.words, model.weights, theta, 1.0)
    p, weight, toxic = p[found], weight[found], toxic[found]
    order = np.argsort(-p, kind="stable")
    right = np.cumsum((weight * toxic)[order])
    f1 = 2 * right / (np.cumsum(weight[order]) + weight[toxic].sum())
    best = int(np.argmax(f1))
    below = p[order[best + 1]] if best + 1 < len(p) else p[order[best]]
    return Model(model.words, model.weights, theta, float((p[order[best]] + below) / 2))


def _useful(rows: DataFrame) -> list[tuple[int, bytes, bytes]]:
    """(grade, words, amounts) of the training rows with the features that :func:`fit` can use, found from counts
    over all of them, so that the driver does not get the others."""
    names, schema = ["grade", "words", "amounts"], "grade int, words binary, amounts binary"

    def tally(batches):
        total, hits = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for b in batches:
            for g, w in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                (hits if g > 0 else total).append(np.frombuffer(w.as_buffer(), np.uint64))
        for flag, parts in ((1, hits), (0, total)):
            words, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n * flag), pa.array(n * (1 - flag))], ["word", "hits", "others"])

    size = {r[0]: r[1] for r in rows.groupBy(F.col("grade") > 0).count().collect()}
    toxic, clean = size.get(True, 0), size.get(False, 0)
    found = rows.transform(map_arrow, tally, "word long, hits long, others long").groupBy("word").agg(F.sum("hits").alias("hits"), F.sum("others").alias("others"))
    found = found.where(F.col("hits") + F.col("others") >= max(MIN_DOCS, MIN_SHARE * toxic))
    found = found.where(F.col("hits") / max(1, toxic) >= (F.col("others") + 0.5) / max(1, clean) * RATIO * (1 - 1e-9)).select("word").toPandas()
    sent = rows.sparkSession.sparkContext.broadcast(np.sort(found["word"].to_numpy().astype(np.int64).view(np.uint64)))

    def narrow(batches):
        for b in batches:
            out = []
            for g, w, v in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                w, v = np.frombuffer(w.as_buffer(), np.uint64), np.frombuffer(v.as_buffer(), np.float32)
                keep = np.isin(w, sent.value)
                out.append((g, w[keep].tobytes(), v[keep].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names) if out else pa.RecordBatch.from_pylist([], pa.schema([("grade", pa.int32()), ("words", pa.binary()), ("amounts", pa.binary())]))

    return sorted((r["grade"], bytes(r["words"]), bytes(r["amounts"])) for r in rows.transform(map_arrow, narrow, schema).collect())


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES) -> Model:
    """The model of ``labels`` (doc_id, toxic) over ``docs``; at most ``max_rows`` labelled rows
    of each class, and those of them (by hash) whose features fit in ``max_features``: a document that does not fit in
    what is left is passed over, not the next ones. Null ids or labels are left out; an id with several labels has the highest."""
    labels = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("grade"))
    count = {r[0]: r[1] for r in labels.groupBy(F.col("grade") > 0).count().collect()}
    share = count.get(True, 0) / max(1, sum(count.values()))
    labels = labels.withColumn("order", F.xxhash64("doc_id"))
    sample = labels.where("grade = 0").orderBy("order", "doc_id").limit(max_rows).unionByName(labels.where("grade > 0").orderBy("order", "doc_id").limit(max_rows))
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("grade", "text")

    def extract(batches):
        for b in batches:
            for c in chunks(b.column(1)):
                doc, h, v = features(c)
                at = np.searchsorted(doc, np.arange(c.n + 1))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(c.first, c.n), pa.array([h[i:j].tobytes() for i, j in zip(at[:-1], at[1:])], pa.binary()), pa.array([v[i:j].astype(np.float32).tobytes() for i, j in zip(at[:-1], at[1:])], pa.binary())],
                    ["grade", "words", "amounts"],
                )

    rows = cut(rows.transform(map_arrow, extract, "grade int, words binary, amounts binary").distinct())
    rows = rows.withColumn("n", (F.octet_length("words") / 8).cast("long")).withColumn("mark", F.sha2(F.concat(F.col("words"), F.col("amounts")), 256))
    picked, left = [], max_features
    for mark, n in sorted(map(tuple, rows.select("mark", "n").distinct().collect())):
        if n <= left:
            picked.append(mark)
            left -= n
    marks = F.broadcast(docs.sparkSession.createDataFrame([(m,) for m in picked], "mark string"))
    rows = cut(rows.join(marks, "mark", "left_semi").select("grade", "words", "amounts"))
    got = _useful(rows)
    n = np.array([len(r[1]) // 8 for r in got], dtype=np.int64)
    grade = np.array([r[0] for r in got], dtype=np.int64)
    words = np.frombuffer(b"".join(r[1] for r in got), np.uint64)
    values = np.frombuffer(b"".join(r[2] for r in got), np.float32)
    del got
    return fit(np.repeat(np.arange(len(n), dtype=np.int32), n), words, values, grade, share)


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), least: float | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` with severity (expected grade), p_toxic (of any grade
    above 0), grade (the most probable) and toxic (p_toxic at least ``least``,
    or else the model's own cut).

    Where a kept column has one of these names, an underscore is put before the new one.
    Null and empty texts get the scores of a text without words. Null ids, repeated rows
    and other columns (whatever their names, read only if kept) pass through one by one.
    """
    names = fresh(docs.select(*map(col, keep)), "severity", "p_toxic", "grade", "toxic")
    least = model.cut if least is None else least
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        quick = np.zeros(1 << 20, dtype=bool)
        quick[(m.words >> np.uint64(44)).astype(np.int64)] = True
        for b in batches:
            for c in chunks(b.column(0)):
                h, owner = hashed(c)
                near = np.flatnonzero(quick[(h >> np.uint64(44)).astype(np.int64)])
                at = np.minimum(np.searchsorted(m.words, h[near]), max(len(m.words) - 1, 0))
                hit = m.words[at] == h[near] if len(m.words) else np.zeros(len(near), bool)
                near, at = near[hit], at[hit]
                doc = owner[near]
                pair, count = np.unique(doc * max(len(m.words), 1) + at, return_counts=True)
                doc, at = pair // max(len(m.words), 1), pair % max(len(m.words), 1)
                s = np.bincount(doc, weights=m.weights[at] * (1 + np.log(count)), minlength=c.n) if len(pair) else np.zeros(c.n)
                over = m.grades(s)
                p = -np.diff(np.concatenate([np.ones((c.n, 1)), over, np.zeros((c.n, 1))], axis=1), axis=1)
                cols = [b.column(i + 1).slice(c.first, c.n) for i in range(len(keep))]
                cols += [pa.array(over.sum(axis=1)), pa.array(over[:, 0]), pa.array(p.argmax(axis=1).astype(np.int32)), pa.array(over[:, 0] >= least)]
                yield pa.RecordBatch.from_arrays(cols, [*keep, *names])

    kinds = ", ".join(f"`{n}` {k}" for n, k in zip(names, ("double", "double", "int", "boolean"), strict=True))
    rows = docs.select(F.col("text").alias(fresh(docs, "read_text")[0]), *map(col, keep))
    return rows.transform(map_arrow, run, schema_of((docs.schema[c] for c in keep), kinds))
