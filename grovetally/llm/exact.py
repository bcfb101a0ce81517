"""Exact copies by two passes over Bloom filters, in DataFrame operations only.

Texts are equal when they are the same after each run of ASCII white space is replaced by one space;
SHA-256 of that stands for a text.

* First pass: every row sets ``PROBES`` bits in a filter of 64-bit words. A word is kept as the OR of its bits and the
  number of times one was set, folded before the shuffle; where that number is above the number of bits that are
  set, some bit was set twice, and the word is crowded. Only bits travel here, no rows.
* Second pass: the crowded words, a bit each, are the second filter. A row whose words are all crowded may be repeated.
  The others are the only ones of their text for certain: they pass straight through.
* The rows that may be repeated are counted by hash, folded before the shuffle. Groups with a thousandth of all rows or
  more, at most a thousand, are sent to all tasks; only the rows of smaller groups shuffle, so no task holds a hot group.

The second filter takes half a byte a row. It is broadcast in slices of at most ``FILTER_BYTES``, each with the rows
whose hashes fall in it, so that the broadcast stays bounded however many rows there are.
"""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import fresh, written

#: Bits that a row sets in the first filter, and words of the filter for each row.
PROBES, WORDS_A_ROW = 2, 4
#: Words to a block, which is a row of the second filter: so many bits.
BLOCK = 1 << 16
#: Bytes of the second filter that are broadcast at once.
FILTER_BYTES = 32 << 20
#: Groups with this share of all rows or more are broadcast: there are at most so many.
HEAVY = 1000


def digest(text: Column) -> Column:
    """SHA-256 of a text with runs of ASCII white space as one space; null counts as empty."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "), 256))


def _hashed(df: DataFrame, of: str, blocks: int) -> DataFrame:
    """``df`` with the block of a digest and its probes: words of the block, and bits of the words."""
    probes = [F.xxhash64(of, F.lit(i)) for i in range(PROBES)]
    places = F.array(*[F.struct(p.bitwiseAND(BLOCK - 1).alias("word"), F.shiftrightunsigned(p, 16).bitwiseAND(63).cast("int").alias("bit")) for p in probes])
    return df.withColumn("block", F.pmod(F.xxhash64(of), F.lit(blocks))).withColumn("places", places)


def crowded(hashed: DataFrame) -> DataFrame:
    """The second filter, as rows (block, bits): a bit for each word of the block that is crowded."""
    one = lambda bit: F.expr(f"shiftleft(1L, {bit})")
    words = hashed.select("block", F.explode("places").alias("p")).select("block", "p.word", one("p.bit").alias("mask"))
    words = words.groupBy("block", "word").agg(F.bit_or("mask").alias("seen"), F.count("mask").alias("n")).where(F.col("n") > F.bit_count("seen"))
    longs = words.select("block", F.expr("int(word div 64)").alias("slot"), one("int(word % 64)").alias("mask")).groupBy("block", "slot").agg(F.bit_or("mask").alias("mask"))
    found = longs.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("slot", "mask"))).alias("found"))
    return found.select("block", F.transform(F.sequence(F.lit(0), F.lit(BLOCK // 64 - 1)), lambda i: F.coalesce(F.col("found")[i], F.lit(0))).alias("bits"))


def _tested(hashed: DataFrame, filters: DataFrame) -> DataFrame:
    """``hashed`` with ``maybe``: false for rows whose text no other row has."""
    hit = [f"getbit(get(bits, int(places[{i}].word div 64)), int(places[{i}].word % 64)) = 1" for i in range(PROBES)]
    out = hashed.join(F.broadcast(filters), "block", "left")
    return out.withColumn("maybe", F.expr(f"coalesce({' AND '.join(hit)}, false)")).drop("bits", "places")


class _Filters:
    """The second filter of some digests, in slices."""

    def __init__(self, digests: DataFrame, rows: int, filter_bytes: int):
        self.blocks = max(1, ceil(WORDS_A_ROW * rows / BLOCK))
        self.per = max(1, filter_bytes // (BLOCK // 8))
        self.filters = written(crowded(_hashed(digests, "digest", self.blocks)), "repeated")

    def slices(self, rows: DataFrame) -> list[DataFrame]:
        """``rows``, which have a column digest, in slices with ``maybe``."""
        hashed = _hashed(rows, "digest", self.blocks)
        if self.per >= self.blocks:
            return [_tested(hashed, self.filters)]
        lows = range(0, self.blocks, self.per)
        return [_tested(*(x.where(F.col("block").between(low, low + self.per - 1)) for x in (hashed, self.filters))) for low in lows]


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """A row for each row of ``docs``: its id, ``keep_id`` (the least id with an equal text), ``group_size`` (rows with an equal
    text), ``kept`` (true for one row of each group) and ``text_sha256`` (hex, of the text with runs of white space as one space).

    A null text is empty, so it equals an empty one. A null id comes after all others: its group's ``keep_id`` is null only
    where no row has an id. Of rows with equal texts and equal ids one is kept, all have the same ``keep_id``. No row in, no
    row out. Other columns of ``docs`` are not read; if the id's column is named like a column of the result, that gets an
    underscore in front.
    """
    names = fresh(docs.select(F.col(f"`{id_col}`")), "keep_id", "group_size", "kept", "text_sha256")
    quoted = F.col(f"`{id_col}`")
    keyed = docs.select(quoted.alias("id"), F.monotonically_increasing_id().alias("at"), digest(F.col(f"`{text_col}`")).alias("digest"))
    keyed = written(keyed, "digests")
    rows = keyed.count()
    out = []
    for tested in _Filters(keyed.select("digest"), rows, filter_bytes).slices(keyed):
        some = tested.where("maybe").groupBy("digest").agg(F.min(F.struct(F.isnull("id").alias("nul"), "id", "at")).alias("first"), F.count("*").alias("n"))
        some = written(some.where("n > 1"), "groups")
        heavy = some.where(F.col("n") * HEAVY >= rows)
        marked = tested.join(F.broadcast(heavy), "digest", "left")
        out.append(marked.where("NOT maybe OR n IS NOT NULL"))
        light = some.where(F.col("n") * HEAVY < rows)
        out.append(marked.where("maybe AND n IS NULL").drop("first", "n").join(light, "digest", "left").select(*out[-1].columns))
    whole = reduce(DataFrame.union, out)
    alone = F.col("n").isNull()
    return whole.select(
        F.col("id").alias(id_col), F.when(alone, F.col("id")).otherwise(F.col("first.id")).alias(names[0]), F.coalesce("n", F.lit(1)).cast("long").alias(names[1]),
        (alone | (F.col("first.at") == F.col("at"))).alias(names[2]), F.lower(F.hex("digest")).alias(names[3]),
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """``docs`` without copies: of rows with equal texts the one with the least id, null ids last; among equal ids the one that a
    hash of the whole row puts first. Columns stay as they are, whatever their names.

    Rows that are the only ones of their text for certain do not shuffle. The others are folded by text before the
    shuffle, to one row for each text and task.
    """
    rows = docs.select(F.struct("*").alias("row"))
    rows = rows.select("row", digest(F.col("row")[text_col]).alias("digest"))
    out = []
    for tested in _Filters(rows.select("digest"), docs.count(), filter_bytes).slices(rows):
        key = F.col("row")[id_col]
        order = F.struct(F.isnull(key), key, F.xxhash64(F.to_json("row")))
        out.append(tested.where("NOT maybe").select("row.*"))
        out.append(tested.where("maybe").groupBy("digest").agg(F.min_by("row", order).alias("row")).select("row.*"))
    return reduce(DataFrame.union, out)
