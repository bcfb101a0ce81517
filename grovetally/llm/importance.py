"""Resampling by importance: documents that resemble a target get a larger chance to be drawn.

Texts become a table of positions: a row for each word, with the words that follow it in its document (``lead`` over
the positions). A row gives one feature for each order: its word, the word with the next one, and so on. Features are hashed to
buckets; the buckets of a position are written once and read twice, to count buckets and to add up gains.

* Texts are dealt by row before they are exploded, so windows and sums by document need no further shuffle; a word's row
  never leaves its task.
* Counts of buckets are folded before the shuffle, so a frequent word is a count. The gains, one row for each bucket, are broadcast.
* Ranks are running totals over ranges of scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import fresh, totals_before, written

#: A word of the features, after A-Z are lower-cased: letters, digits and all that is not ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def positions(docs: DataFrame, id_col: str, text_col: str, orders: int = 3, buckets: int = 10000) -> DataFrame:
    """Rows (at, id, b1, b2, ...): for each word of each row of ``docs``, which ``at`` numbers, the buckets of the runs of 1, 2, ...
    words that begin there, null where the text ends before. A text without words gives one row without buckets."""
    dealt = docs.select(F.monotonically_increasing_id().alias("at"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).repartition("at")
    words = F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))
    table = dealt.select("at", "id", F.posexplode_outer(words).alias("pos", "w1"))
    following = Window.partitionBy("at").orderBy("pos")
    table = table.select("at", "id", "w1", *[F.lead("w1", i).over(following).alias(f"w{i + 1}") for i in range(1, orders)])
    runs = ["w1"]
    for i in range(2, orders + 1):
        runs.append(f"concat({runs[-1]}, ' ', w{i})")
    return table.selectExpr("at", "id", *[f"CAST(crc32({run}) % {buckets} AS INT) AS b{i}" for i, run in enumerate(runs, 1)])


def counts(table: DataFrame, orders: int) -> DataFrame:
    """(bucket, n): how many features of a table of positions fall in each bucket."""
    each = table.select(F.explode(F.array(*[f"b{i}" for i in range(1, orders + 1)])).alias("bucket")).where("bucket IS NOT NULL")
    return each.groupBy("bucket").agg(F.count("*").alias("n"))


def gains(own: DataFrame, target: DataFrame, buckets: int, scale: int = 1000) -> DataFrame:
    """(bucket, gain) for every bucket: ``scale`` times the logarithm of its share in the target by its own, with one added to each count."""
    s, t = (x.agg(F.sum("n")).first()[0] or 0 for x in (own, target))
    every = own.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(own.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    ratio = f"(double(coalesce(t, 0) + 1) * double({s + buckets}L)) / (double(coalesce(s, 0) + 1) * double({t + buckets}L))"
    return both.selectExpr("bucket", f"bigint(floor({scale} * ln({ratio}))) AS gain")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", percent: int = 5,
    min_words: int = 20, orders: int = 3, buckets: int = 10000, seed: int = 42,
) -> DataFrame:
    """A row for each row of ``docs``: its id, ``n_features`` (runs of 1 to ``orders`` words), ``weight`` (sum of the gains of
    their buckets), ``score`` (the weight and Gumbel noise, which ``seed`` and the id decide) and ``rank`` among those drawn, else null.

    Of the documents with ``min_words`` words or more, ``percent`` of a hundred (rounded down) with the largest scores are drawn; ties
    go to the smaller id, null ids come last. The noise makes that a draw without replacement by importance.

    A null text has no words: no features, weight 0, not drawn. A null id has the noise of an empty one. Equal rows have equal
    scores and ranks of their own. Empty ``docs`` give no rows; with an empty target every gain comes from the own counts alone. Other columns are not read. ``docs`` should
    be a table or files, as rows are numbered where they are read. If the id's column is named like one of the result, that gets an
    underscore in front.
    """
    names = fresh(docs.select(F.col(f"`{id_col}`")), "n_features", "weight", "score", "rank")
    table = written(positions(docs, id_col, text_col, orders, buckets), "positions")
    other = target.select(F.lit(0).alias("id"), F.col(f"`{target_text}`").alias("text"))
    own, wanted = (written(counts(t, orders), "counts") for t in (table, positions(other, "id", "text", orders, buckets)))
    gain = written(gains(own, wanted, buckets), "gains")
    columns = [f"b{i}" for i in range(1, orders + 1)]
    for b in columns:
        table = table.join(F.broadcast(gain.select(F.col("bucket").alias(b), F.col("gain").alias(f"g{b}"))), b, "left")
    weight, features = (" + ".join(x.format(b) for b in columns) for x in ("coalesce(g{}, 0L)", "int({} IS NOT NULL)"))
    each = table.groupBy("at", "id").agg(F.expr(f"sum({weight})").alias("weight"), F.expr(f"sum({features})").alias("n_features"), F.count("b1").alias("words"))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = written(each.withColumn("score", F.col("weight") + noise), "scores")
    eligible = scored.where(F.col("words") >= min_words)
    drawn = percent * eligible.count() // 100
    ranked = eligible.select("*", (-F.col("score")).alias("least"), F.isnull("id").alias("nul"))
    ranked = totals_before(ranked, ["least", "nul", "id", "at"], {"before": F.lit(1)})
    ranked = ranked.withColumn("rank", F.when(F.col("before") < drawn, F.col("before") + 1))
    rest = scored.where(F.col("words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    out = [F.col(c).cast("long").alias(n) for c, n in zip(("n_features", "weight", "score", "rank"), names, strict=True)]
    return ranked.select(F.col("id").alias(id_col), *out).union(rest.select(F.col("id").alias(id_col), *out))
