"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every copy of a document gets a virtual finish time: the words of its source up to and
including it, in shuffled order, divided by the source's target. All copies are then ordered
by finish time, and the mix is cut where its words reach the budget. As the targets add up
to the budget, the cut falls near time 1 and every source ends within about one document
of its target.

No step gathers a source. Running totals are made in two levels: totals of the
``BUCKETS`` hash buckets of each source, then a window inside one (source, bucket); the
global order is cut in the same way, by totals of time slots and then inside one slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import col, cut, fresh, totals_before, word_count

BUCKETS = 1024
#: Time slots to a unit of virtual time, and their number in all; the last takes all later times.
SLOTS, LAST_SLOT = 4096, 12287
#: Parts of a slot.
PARTS = 4096


def cyclic_weights(weights: tuple[float, ...] = (5.0, 2.0, 1.0)):
    """Weights given to sources in code-point order, null last, repeating."""

    def weigh(rank: Column) -> Column:
        return F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))

    return weigh


def source_targets(totals: DataFrame, weigh, share: float, limit: float) -> DataFrame:
    """Columns weight and target for a table (nul, src, source_size) with a row for each source.

    The budget is ``share`` of all sizes. A source gets its weight's part of it but at most
    ``limit`` times its size; the excess goes to the others by weight, again and again.
    The fixed point is ``least(cap, level * weight)``: with sources ordered by cap / weight,
    the level is the largest one that its own source does not cap.
    Sources may be many: ranks and sums in the order of ratios are running totals over ranges.
    """
    ranked = totals_before(totals, ["nul", "src"], {"rank": F.lit(1)}).withColumn("weight", weigh(F.col("rank"))).drop("rank")
    ranked = ranked.withColumn("cap", F.col("source_size") * float(limit)).withColumn("ratio", F.col("cap") / F.col("weight"))
    size, weights = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    budget = float(size or 0) * float(share)
    ranked = totals_before(ranked, ["ratio", "nul", "src"], {"caps": F.col("cap"), "weights": F.col("weight")})
    level = (F.lit(budget) - F.col("caps")) / (F.lit(float(weights or 0)) - F.col("weights"))
    best = ranked.agg(F.max(F.when(level <= F.col("ratio"), level))).first()[0]
    target = F.least(F.col("cap"), F.lit(float("inf") if best is None else best) * F.col("weight"))
    return ranked.select("nul", "src", "source_size", "weight", target.alias("target"), F.lit(budget).alias("budget"))


def mix(docs: DataFrame, weigh=None, share: float = 1.5, limit: int = 2, seed: int = 17, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The mix of ``docs`` (doc_id, text, source): a row for each document with the columns
    in ``keep`` and ``size`` (words), ``source_size``, ``target`` (its source's words in
    the mix), ``taken`` (size times copies) and ``copies`` (times the mix takes it). Where a kept
    column has one of these names, an underscore is put before the new one.

    ``weigh`` turns a source's rank into its weight; ``share`` sets the budget as a part
    of all words; no document is taken more than ``limit`` times. Put "text" in ``keep`` to
    carry the texts along.

    Null text counts as empty; empty documents have size 0 and are taken 0 times. Null
    source is a source of its own, after all others. Repeated rows are documents of their own.
    Rows that tie in the shuffled order have equal ids and sizes, so which comes first makes
    no difference. An empty table gives an empty result. Other columns are ignored
    whatever their names, unless kept. The shuffle depends on ids and seed only.
    """
    weigh = weigh or cyclic_weights()
    src = docs.select(
        *[col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col("doc_id").alias("id"),
        F.coalesce("source", F.lit("")).alias("src"), F.col("source").isNull().alias("nul"),
        word_count().alias("size"), F.xxhash64(F.lit(seed), "doc_id").alias("key"),
    )
    src = cut(src.withColumn("bucket", F.shiftrightunsigned("key", 54).cast("int")))
    parts = src.groupBy("nul", "src", "bucket").agg(F.sum("size").alias("part"))
    totals = parts.groupBy("nul", "src").agg(F.sum("part").alias("source_size"))
    within = Window.partitionBy("nul", "src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("part").over(within), F.lit(0))).drop("part")
    parts = cut(parts.join(source_targets(totals, weigh, share, limit), ["nul", "src"]))
    local = Window.partitionBy("nul", "src", "bucket").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    timed = src.join(parts, ["nul", "src", "bucket"]).withColumn("upto", F.col("before") + F.sum("size").over(local))
    live = (F.col("size") > 0) & (F.col("target") > 0)
    times = F.when(live, F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda p: (p * F.col("source_size") + F.col("upto")) / F.col("target")))
    timed = cut(timed.select("nul", "src", *[f"k{i}" for i in range(len(keep))], "id", "key", "size", "source_size", "target", "budget", times.alias("times")))
    stop = _stop(timed)
    if stop is None:
        copies = F.coalesce(F.size(F.filter("times", lambda t: F.lit(True))), F.lit(0))
    else:
        at = F.struct(F.lit(stop["time"]).alias("time"), F.lit(stop["key"]).alias("key"), F.lit(stop["id"]).cast(timed.schema["id"].dataType).alias("id"))
        here = lambda t: F.struct(t.alias("time"), F.col("key").alias("key"), F.col("id").alias("id"))
        copies = F.coalesce(F.size(F.filter("times", lambda t: here(t) <= at)), F.lit(0))
    copies = F.when(F.col("times").isNull(), F.lit(0)).otherwise(copies)
    out = timed.withColumn("copies", copies.cast("long")).withColumn("taken", F.col("size") * F.col("copies"))
    made = [F.col("size"), F.col("source_size"), F.col("target").cast("double"), F.col("taken"), F.col("copies")]
    names = fresh(docs.select(*map(col, keep)), "size", "source_size", "target", "taken", "copies")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *[x.alias(n) for x, n in zip(made, names, strict=True)])


def _stop(timed: DataFrame):
    """The last copy (time, key, id) in the order of finish times that the budget still takes;
    None if it takes all. A slot of time is found by the totals of all slots, and a part of that slot in the
    same way, so the copies that are sorted in the end, over ranges of (time, key, id, size), are about one in 2**24 unless
    many end at one time. Few small rows come to the driver, whatever the size of the input."""
    copies = timed.select("id", "key", "size", "budget", F.explode("times").alias("time"))
    # both are whole numbers of the same exact product, as SLOTS and PARTS are powers of two
    copies = copies.withColumn("slot", F.least(F.floor(F.col("time") * SLOTS), F.lit(LAST_SLOT)).cast("int"))
    copies = copies.withColumn("part", F.when(F.col("slot") < LAST_SLOT, F.pmod(F.floor(F.col("time") * SLOTS * PARTS), F.lit(PARTS))).otherwise(0).cast("int"))

    def reached(some: DataFrame, by: str, before: int):
        sums = some.groupBy(by).agg(F.sum("size").alias("words"), F.first("budget").alias("budget"))
        sums = sums.withColumn("upto", F.lit(before) + F.sum("words").over(Window.orderBy(by)))
        return sums.where(F.col("upto") >= F.col("budget")).orderBy(by).select(by, F.col("upto") - F.col("words")).limit(1).collect()

    found = reached(copies, "slot", 0)
    if not found:
        return None
    slot, before = found[0]
    copies = copies.where(F.col("slot") == slot)
    part, before = reached(copies, "part", before)[0]
    # many copies may end at one time, as those of sources with one document do at 1 / limit and at 1
    inside = totals_before(copies.where(F.col("part") == part), ["time", "key", "id", "size"], {"earlier": F.col("size")})
    inside = inside.withColumn("upto", F.lit(before) + F.col("earlier") + F.col("size"))
    taken = inside.where((F.col("upto") - F.col("size") / 2) <= F.col("budget"))
    last = taken.orderBy(F.desc("time"), F.desc("key"), F.desc("id")).select("time", "key", "id").limit(1).collect()
    if last:
        return last[0]
    return {"time": (slot + part / PARTS) / SLOTS, "key": -(2**63), "id": None}
