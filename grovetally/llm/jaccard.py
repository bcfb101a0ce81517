"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence.

Two documents link when their sets of word shingles have a Jaccard similarity of at least
``PERCENT`` / 100. The product of the incidence matrix with its transpose holds all overlaps;
bounds that follow from set sizes keep all but a small part of it from being formed:

* Columns (shingles) are put in one global order, rare ones first, by counts in a fixed number
  of hash buckets. Let a be the overlap that a pair of sizes m and n needs. Then the first
  shingle the two share stands among the first m - a + 1 of the one and n - a + 1 of the other,
  so only the prefix block of each row (about a fifth of it) is multiplied at first, and a
  product is kept only if its two places and sizes meet this bound.
* Equal sets are one row of the matrix (a class).
* A column that is common to a large group of near copies would give all pairs of the group.
  Each column is first multiplied with one pivot only, the row in which it stands earliest
  (the row with the fewest edits of its own). Overlaps of these pairs are accumulated over
  their whole rows and give links and components. Then the column's products between
  rows of different components follow, all of them: pairs in one component are linked already,
  so no component is lost, and a group costs little more than its size.

The result is exact up to collisions of hashes: of 64 bits, and of 32 bits within a pair of sets below ``WIDE``. Nothing that
grows with the corpus comes to the driver; hot columns and classes are joined in parts, as many as their rows need, or in joins that
adaptive execution can split.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import col, cut, fresh, map_arrow, schema_of
from ._text import Chunk, chunks, mix, shingles, spread

PERCENT, WORDS = 80, 5
#: Rows of a column, or pairs of a class, that are joined in one place; those of common ones are dealt to more.
SALT_ROWS = 500
#: Sets of at least this size are compared by all 64 bits of their hashes, smaller ones by the upper 32: two sets below it
#: take less than 0.004 shingles for shared that are not.
WIDE = 1 << 12
#: Hash buckets of the column order, and of the filter of the rows whose sets are needed.
_BUCKET_BITS, _FILTER_BITS = 22, 23
_LOW = np.uint64((1 << 30) - 1)


def _windows(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, begins = c.words()
    return shingles(c.span_hash(starts, ends), begins, WORDS)


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - _BUCKET_BITS)).astype(np.int64)


def column_order(docs: DataFrame) -> np.ndarray:
    """The rank of each hash bucket by the number of shingles in it.

    A task sends its counts (up to 255 each) as slices of bytes, which are summed as they
    stream by. The driver gets the 2**22 sums, whatever the size of the corpus.
    """
    size, part = 1 << _BUCKET_BITS, 1 << 16

    def run(batches):
        total = np.zeros(size, dtype=np.int32)
        for b in batches:
            own = [_bucket(_windows(c)[0]) for c in chunks(b.column(0))]
            total += np.bincount(np.concatenate([*own, np.zeros(0, np.int64)]), minlength=size).astype(np.int32)
        small = np.minimum(total, 255).astype(np.uint8)
        some = [i for i in range(size // part) if small[i * part : (i + 1) * part].any()]
        for i in some:
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([small[i * part : (i + 1) * part].tobytes()], pa.binary())], ["slice", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                sums.setdefault(i, np.zeros(part, dtype=np.int64))[:] += np.frombuffer(x.as_buffer(), np.uint8)
        for i, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([x.astype(np.int32).tobytes()], pa.binary())], ["slice", "counts"])

    schema = "slice int, counts binary"
    total = np.zeros(size, dtype=np.int32)
    for r in docs.select("text").transform(map_arrow, run, schema).repartition(size // part, "slice").transform(map_arrow, add, schema).collect():
        total[r["slice"] * part : (r["slice"] + 1) * part] = np.frombuffer(r["counts"], np.int32)
    rank = np.empty(size, dtype=np.int32)
    rank[np.argsort(total, kind="stable")] = np.arange(size, dtype=np.int32)
    return rank


def _sets(c: Chunk, rank: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each document, in column order (or by hash), and where each begins."""
    h, begins = _windows(c)
    doc = np.repeat(np.arange(c.n), np.diff(begins))
    if rank is None:
        order = np.lexsort((h, doc))
    elif c.n > 4096:
        order = np.lexsort((h & _LOW, rank[_bucket(h)], doc))
    else:
        order = np.argsort((doc.astype(np.uint64) << np.uint64(52)) | (rank[_bucket(h)].astype(np.uint64) << np.uint64(30)) | (h & _LOW))
    h, doc = h[order], doc[order]
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[fresh], np.concatenate([[0], np.cumsum(np.bincount(doc[fresh], minlength=c.n))]).astype(np.int64)


def _signature(h: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """A hash of each set, whatever its order."""
    total = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(mix(h ^ np.uint64(0x5851F42D4C957F2D)), out=total[1:])
    return mix(np.diff(total[begins]) + np.diff(begins).astype(np.uint64)).view(np.int64)


def rows_of(docs: DataFrame) -> DataFrame:
    """(doc_id, n, cls) of each row of ``docs``: set size and class (hash of the set)."""

    def run(batches):
        for b in batches:
            for c in chunks(b.column(1)):
                h, begins = _sets(c, None)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(c.first, c.n), pa.array(np.diff(begins)), pa.array(_signature(h, begins))], ["doc_id", "n", "cls"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").transform(map_arrow, run, f"doc_id {kind}, n long, cls long")


class _Filter:
    """A bitmap of fixed size over ids: which documents may stand for one of the classes asked for.

    It lets all of those pass and perhaps others, which a later join or distinct removes.
    """

    def __init__(self, reps: DataFrame):
        word = (F.pmod(F.coalesce("rep", F.lit(0)), F.lit(1 << _FILTER_BITS)) / 64).cast("int").alias("word")
        bit = F.bit_or(F.expr("shiftleft(1L, cast(pmod(coalesce(rep, 0), 64) as int))")).alias("bits")
        got = reps.groupBy(word).agg(bit).toPandas()
        bitmap = np.zeros(1 << (_FILTER_BITS - 6), dtype=np.uint64)
        bitmap[got["word"].to_numpy()] = got["bits"].to_numpy().astype(np.int64).view(np.uint64)
        self.sent = reps.sparkSession.sparkContext.broadcast(bitmap)

    def passing(self, ids: pa.Array) -> pa.Array:
        slot = np.mod(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), 1 << _FILTER_BITS)
        return pa.array(np.flatnonzero((self.sent.value[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1)))


def prefix_cells(docs: DataFrame, rank: np.ndarray, only: _Filter) -> DataFrame:
    """(item, cls, n, place): the cells of the prefix block of the rows that stand for classes."""
    sent = docs.sparkSession.sparkContext.broadcast(rank)

    def run(batches):
        for b in batches:
            for c in chunks(b.column(1).take(only.passing(b.column(0)))):
                h, begins = _sets(c, sent.value)
                n = np.diff(begins)
                size = np.where(n > 0, n - (PERCENT * n + 99) // 100 + 1, 0)
                place = spread(np.zeros(c.n, dtype=np.int64), size)
                cells = [h[place + np.repeat(begins[:-1], size)].view(np.int64), np.repeat(_signature(h, begins), size), np.repeat(n, size).astype(np.int32), place.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cells], ["item", "cls", "n", "place"])

    return docs.select("doc_id", "text").transform(map_arrow, run, "item long, cls long, n int, place int")


def _meets(m: Column, i: Column, n: Column, j: Column) -> Column:
    """Whether rows of sizes m and n that first share a column at places i and j can link."""
    need = F.ceil((m + n) * PERCENT / (100 + PERCENT) - F.lit(1e-9))
    return (i <= m - need) & (j <= n - need) & (F.least(m, n) * 100 >= F.greatest(m, n) * PERCENT)


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _needed(docs: DataFrame, pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(cls, items) for the classes in ``pairs``: their whole sets (see :func:`_packed`).

    Texts are not shuffled: they are read again, and only those that the filter lets pass.
    """
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(classes.select("cls", "rep"), "cls")
    wanted = cut(wanted)
    only = _Filter(wanted)

    def run(batches):
        for b in batches:
            for c in chunks(b.column(1).take(only.passing(b.column(0)))):
                h, begins = _sets(c, None)
                full = np.flatnonzero(np.diff(begins))
                cls = _signature(h, begins)[full]
                yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array([_packed(h[begins[d] : begins[d + 1]]) for d in full], pa.binary())], ["cls", "items"])

    found = docs.select("doc_id", "text").transform(map_arrow, run, "cls long, items binary").join(wanted.select("cls"), "cls", "left_semi")
    return found.dropDuplicates(["cls"])


def _packed(h: np.ndarray) -> bytes:
    """A sorted set of hashes as bytes: whole ones if it has at least ``WIDE``, else their upper halves."""
    return (h if len(h) >= WIDE else (h >> np.uint64(32)).astype(np.uint32)).tobytes()


def _alike(x: memoryview | bytes, y: memoryview | bytes) -> bool:
    """Whether two packed sets link."""
    x, y = (np.frombuffer(s, np.uint64 if memoryview(s).nbytes >= 8 * WIDE else np.uint32) for s in (x, y))
    if x.dtype != y.dtype:
        x, y = (s if s.dtype == np.uint32 else (s >> np.uint64(32)).astype(np.uint32) for s in (x, y))
    shared = len(np.intersect1d(x, y))
    return 100 * shared >= PERCENT * (len(x) + len(y) - shared)


def overlaps(docs: DataFrame, pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The links among ``pairs`` (a, b) of classes, with their overlap accumulated over whole rows."""
    sets = cut(_needed(docs, pairs, classes))
    # a class of many pairs is dealt to as many parts as they need, each with a copy of its set
    parts = _unknown(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SALT_ROWS).cast("int").alias("parts")), "a")
    left = sets.withColumnsRenamed({"cls": "a", "items": "left"}).join(parts, "a").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    dealt = pairs.join(parts, "a").select("a", "b", F.pmod(F.hash("b"), F.col("parts")).alias("part"))
    right = dealt.join(sets.withColumnsRenamed({"cls": "b", "items": "right"}), "b")
    rows = right.join(left, ["a", "part"]).select("a", "b", "left", "right")

    def run(batches):
        for b in batches:
            keep = [_alike(x.as_buffer(), y.as_buffer()) for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep))

    return cut(rows.transform(map_arrow, run, "a long, b long"))


def connected(links: DataFrame) -> DataFrame:
    """(cls, label) of all classes in ``links`` (a, b): the label is the least class reachable.

    Each partition first replaces its links by stars; then labels spread along links
    and along themselves until none changes, so rounds grow with the logarithm of a
    component's width. Rows of a node are folded before the shuffle (min), never gathered.
    """

    def run(batches):
        top: dict[int, int] = {}

        def find(x: int) -> int:
            while (y := top.setdefault(x, x)) != x:
                top[x] = x = top[y] if y in top else y
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = find(a), find(b)
                if a != b:
                    top[max(a, b)] = min(a, b)
        ends = [(x, find(x)) for x in list(top)]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in ends], pa.int64()), pa.array([y for _, y in ends], pa.int64())], ["a", "b"])

    edges = cut(links.transform(map_arrow, run, "a long, b long"))
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        stepped = labels.join(near, "a").select("a", "label", F.least("label", "near").alias("next"))
        over = labels.select(F.col("a").alias("next"), F.col("label").alias("jump"))
        moved = cut(stepped.join(over, "next", "left").select("a", "label", F.coalesce(F.least("next", "jump"), "next").alias("next")))
        labels = moved.select("a", F.col("next").alias("label"))
        if moved.where("next <> label").isEmpty():
            return labels.withColumnRenamed("a", "cls")


def _redealt(sums: DataFrame, key: str = "item") -> DataFrame:
    """Sums by ``key`` with a key that Spark does not know them to be dealt by, so that a join with
    them deals both sides anew and adaptive execution can split a common key's rows."""
    return _unknown(cut(sums), key)


def _unknown(sums: DataFrame, key: str) -> DataFrame:
    return sums.withColumn(key, F.col(key).bitwiseXOR(F.lit(0).cast("long")))


def _cells(docs: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The classes (cls, rep, n) of ``rows``, and the cells (item, cls, n, place) of their prefix blocks in columns that
    several rows share."""
    classes = cut(rows.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n")))
    cells = prefix_cells(docs, column_order(docs), _Filter(classes))
    # a column is of use if it stands early enough in the shorter row of some pair
    early = F.max(F.col("place") <= F.col("n") - F.ceil(F.col("n") * (2 * PERCENT / (100 + PERCENT)) - F.lit(1e-9)))
    common = cells.groupBy("item").agg(F.count(F.lit(1)).alias("of"), early.alias("early")).where("of > 1 and early").select("item")
    # by item and class, so that no later step finds the rows of a common column in one place
    cells = cells.join(common, "item").repartition("item", "cls").distinct()
    return classes, cut(cells.select("item", "cls", F.col("n").cast("long").alias("n"), F.col("place").cast("long").alias("place")))


def _labelled(docs: DataFrame) -> DataFrame:
    """(doc_id, n, cls, label, component) of each row of ``docs``: set size, class, the label of the
    class's component and the component's least doc_id; those but n are null without shingles."""
    rows = cut(rows_of(docs))
    classes, cells = _cells(docs, rows)
    pivots = _redealt(cells.groupBy("item").agg(F.min(F.struct("place", "cls", "n")).alias("p")))
    stars = cells.join(pivots, "item").where(F.col("cls") != F.col("p.cls")).where(_meets(F.col("n"), F.col("place"), F.col("p.n"), F.col("p.place")))
    stars = cut(stars.select(*_ordered("cls", "p.cls")).distinct())
    links = overlaps(docs, stars, classes)
    labels = connected(links)
    marked = cells.join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    mixed = marked.groupBy("item").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min(F.struct("place", "cls", "label")).alias("p"), F.count(F.lit(1)).alias("of")).where("low <> high")
    parts = F.ceil(F.col("of") / SALT_ROWS).cast("int").alias("parts")
    marked = cut(marked.join(_redealt(mixed.select("item", F.col("p.label").alias("main"), parts)), "item"))
    x = marked.where("label <> main").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("x")
    y = marked.withColumn("part", F.pmod(F.hash("cls"), F.col("parts"))).alias("y")
    rest = x.join(y, ["item", "part"]).where("x.label <> y.label").where(_meets(F.col("x.n"), F.col("x.place"), F.col("y.n"), F.col("y.place")))
    rest = cut(rest.select(*_ordered("x.cls", "y.cls")).distinct().join(stars, ["a", "b"], "left_anti"))
    labels = connected(links.unionByName(overlaps(docs, rest, classes)))
    named = labels.join(classes.select("cls", "rep"), "cls")
    least = named.groupBy("label").agg(F.min("rep").alias("component"))
    final = classes.join(named.join(least, "label").select("cls", "label", "component"), "cls", "left")
    final = final.select("cls", F.coalesce("label", "cls").alias("label"), F.coalesce("component", "rep").alias("component"))
    out = rows.select("doc_id", "n", F.when(F.col("n") > 0, F.col("cls")).alias("cls")).join(_redealt(final, "cls"), "cls", "left")
    return out.select("doc_id", "n", "cls", "label", "component")


def groups(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, n_shingles (size of its set) and component_id (the least
    doc_id reachable by links, its own included).

    ``docs`` has an integer doc_id and text; other columns are not read. A-Z are lower-cased and
    words are runs without ASCII white space; a text of fewer than five words is one shingle.
    Null, empty and blank texts have no shingles and link with nothing: their component is
    their own id. Rows of equal texts are one class, so repeated rows get equal results; a null
    id never names a component unless no other id is in it. An empty table gives an empty result.
    """
    own = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return _labelled(docs).select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The whole join: the links (a, b), a < b, between all classes, and the class (doc_id, n, cls) of each row of ``docs``.

    Unlike :func:`groups`, which needs one path between two documents only, this forms every product of the prefix blocks
    that the bounds allow, so a group of g different near copies takes g * g / 2 comparisons; repeated sets take none.
    Rows of equal sets link with each other and share the links of their class. Rows without shingles have the class
    null or one that no link holds. Nulls, repeats and empty tables are as in :func:`groups`.
    """
    rows = cut(rows_of(docs))
    classes, cells = _cells(docs, rows)
    parts = _redealt(cells.groupBy("item").agg(F.ceil(F.count(F.lit(1)) / SALT_ROWS).cast("int").alias("parts")))
    dealt = cells.join(parts, "item")
    x = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("x")
    y = dealt.withColumn("part", F.pmod(F.hash("cls"), F.col("parts"))).alias("y")
    near = x.join(y, ["item", "part"]).where("x.cls < y.cls").where(_meets(F.col("x.n"), F.col("x.place"), F.col("y.n"), F.col("y.place")))
    pairs = cut(near.select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).distinct())
    return overlaps(docs, pairs, classes), rows


def link_counts(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, class_id (the least doc_id among rows of its set) and n_links (other rows that it
    links with, copies included). Rows without shingles have their own id and no links."""
    pairs, rows = links(docs)
    classes = cut(rows.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("of")))
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    far = both.join(_unknown(classes.select(F.col("cls").alias("b"), "of"), "b"), "b").groupBy(F.col("a").alias("cls")).agg(F.sum("of").alias("far"))
    each = classes.join(far, "cls", "left").select("cls", "class_id", (F.col("of") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"))
    out = rows.select("doc_id", "n", F.when(F.col("n") > 0, F.col("cls")).alias("cls")).join(_redealt(each, "cls"), "cls", "left")
    own = F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", own.alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


#: The most classes that are broadcast, to tell which of their rows go.
SENT_CLASSES = 2_000_000


def _with_class(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with the class of each row as a further column, null for rows without shingles."""
    names = [*docs.columns, name]
    text = docs.columns.index("text")

    def run(batches):
        for b in batches:
            for c in chunks(b.column(text)):
                h, begins = _sets(c, None)
                cls = pa.array(_signature(h, begins), mask=np.diff(begins) == 0)
                yield pa.RecordBatch.from_arrays([*(x.slice(c.first, c.n) for x in b.columns), cls], names)

    return docs.transform(map_arrow, run, schema_of(docs.schema, f"`{name}` long"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of linked ones, that with the least (doc_id, class),
    null ids last.

    Rows are told apart by id and class, so a row whose id is null or stands on other rows as well
    stays or goes by its own group. Rows without shingles stay, as they link with nothing.
    Of rows that repeat both id and class the one stays that a hash of the whole row puts first. The classes of the groups are broadcast if
    there are at most ``SENT_CLASSES``, else joined by a shuffle.
    """
    found = cut(_labelled(docs).where("n > 0"))  # cut here, so that the join by class can be split
    found = found.groupBy("label", "cls", "doc_id").agg(F.count(F.lit(1)).alias("of"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "cls", "of")).alias("top")
    tops = _redealt(found.groupBy("label").agg(first, F.sum("of").alias("rows")).where("rows > 1"), "label")
    cls, kept, rows = fresh(docs, "cls", "kept", "rows")
    # of each class in a group: the id that stays and on how many rows, or 0 where all rows go
    stays = F.when(F.col("cls") == F.col("top.cls"), F.col("top.of")).otherwise(0)
    members = found.select("label", "cls").distinct().join(tops, "label")
    members = cut(members.select(F.col("cls").alias(cls), F.col("top.doc_id").alias(kept), stays.alias(rows)))
    out = _with_class(docs, cls).join(F.broadcast(members) if members.count() <= SENT_CLASSES else members, cls, "left")
    out = out.where(F.col(rows).isNull() | ((F.col(rows) > 0) & F.col("doc_id").eqNullSafe(F.col(kept))))
    if not members.where(F.col(rows) > 1).isEmpty():
        several = F.coalesce(F.col(rows) > 1, F.lit(False))
        row = F.struct("*")
        one = out.where(several).select(cls, row.alias("row")).groupBy(cls).agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
        out = out.where(~several).union(one.select("row.*"))
    return out.select(*map(col, docs.columns))
