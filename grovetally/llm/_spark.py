"""Spark helpers of this subpackage: lineage cuts and column naming."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word: a maximal run of characters that are no ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only where the session names none and all runs in one process (a local master) is a temporary one
    set: on a cluster, executors could not read it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        sc = spark.sparkContext
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="grovetally-"))
        found = sc._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


#: Paths made under shared folders and not yet removed.
_MADE: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; :func:`clean` removes it."""
    _MADE.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def clean(spark: SparkSession) -> None:
    """Removes what this process has written under the shared folder, once no DataFrame that reads it is needed.

    Checkpoints are Spark's own: it removes them as their DataFrames go if
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    while _MADE:
        path = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: The share of the driver's heap from which :func:`tidied` collects garbage.
FULL = 0.2


def tidied(spark: SparkSession) -> None:
    """Collects the driver's garbage if its heap holds more than ``FULL`` of what it may.

    Plans, tasks and shuffles that are done with leave much of it, the more the more partitions there are. The heap
    would grow to its limit first, and Spark keeps shuffle files and checkpoints until their handles are collected.
    """
    heap = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() - heap.freeMemory() > FULL * heap.maxMemory():
        gc.collect()  # Python's handles of Java objects
        spark.sparkContext._jvm.System.gc()


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it, Spark removes the shuffle files of a write when that ends, not when the driver happens to collect its plan."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder: a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    out = df.checkpoint()
    tidied(df.sparkSession)
    return out


def written(df: DataFrame, name: str) -> DataFrame:
    """Like :func:`cut`, as compressed Parquet, for rows with wide binary columns."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    tidied(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def totals_before(df: DataFrame, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """``df`` with the sums of some columns over all rows that come before in an order of the whole table.

    No task sorts the table: it is cut into ranges of the order, and a range adds to its own running sums the
    totals of those before, of which there are as many as partitions.
    """
    (part, *bases) = fresh(df, "range", *[f"base{i}" for i in range(len(sums))])
    ranged = cut(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy(part).agg(*[F.sum(x).alias(b) for x, b in zip(sums.values(), bases, strict=True)])
    parts = parts.select(part, *[F.coalesce(F.sum(b).over(earlier), F.lit(0)).alias(b) for b in bases])
    own = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(parts), part)
    return out.withColumns({n: F.col(b) + F.coalesce(F.sum(x).over(own), F.lit(0)) for (n, x), b in zip(sums.items(), bases, strict=True)}).drop(part, *bases)


#: Bytes of an Arrow batch: texts may be long, and a batch of many rows is held several times.
BATCH_BYTES = 8 << 20
_ROOT = str(Path(__file__).resolve().parents[2])
_UNITS = {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}


def map_arrow(df: DataFrame, run, schema: str | T.StructType) -> DataFrame:
    """``df.mapInArrow`` in batches of at most ``BATCH_BYTES`` (one row if it is longer).

    The session's own limit is lowered to that if it is higher, and stays so.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(-?\d+)([a-z]?)b?", df.sparkSession.conf.get(key).lower()).groups()
    if not 0 < int(number) * _UNITS[unit or "b"] <= BATCH_BYTES:
        df.sparkSession.conf.set(key, str(BATCH_BYTES))
    own = df.sparkSession.sparkContext.environment
    if _ROOT not in own.get("PYTHONPATH", "").split(os.pathsep):  # for workers that start elsewhere
        own["PYTHONPATH"] = os.pathsep.join(filter(None, [own.get("PYTHONPATH"), _ROOT]))
    plain = [f"column {i}" if "`" in c or "." in c else c for i, c in enumerate(df.columns)]  # Spark looks columns up by name here
    return (df if plain == df.columns else df.toDF(*plain)).mapInArrow(run, schema)


def col(name: str) -> Column:
    """A column by its whole name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def schema_of(fields: Iterable[T.StructField], more: str = "") -> T.StructType:
    """The schema of some fields, whatever their names, and of those that ``more`` spells out; nulls may stand anywhere."""
    return T.StructType([*[T.StructField(f.name, f.dataType) for f in fields], *(T.StructType.fromDDL(more).fields if more else [])])


def word_count(text: str = "text"):
    """Number of words of a text column; null counts as empty."""
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names close to the wanted ones that no column of ``df`` has (Spark ignores case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
