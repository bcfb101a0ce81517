"""Fills a tree from a stream with its state on the executors.

Each row becomes what it adds to the nodes it reaches, and one stateful aggregation by node holds the sums, extremes and moments in
Spark's state store. After each micro-batch the rows of the nodes that it changed go to a folder as Parquet. The latest row of each node is its
state, so the folder is a :class:`~grovetally.plans.tally.Tally` at any time, and no tree is ever on the driver: categories may be
as many as the state store holds.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import shape as H
from ..operators.spec import Spec
from ..plans.lower import measured_by_row, states_by_row
from ..plans.tally import STRUCTURE, Tally, stamped
from ..sources.shared import Folder

#: After so many batches the rows that were replaced since are dropped.
BATCHES = 50
_DONE = "_SUCCESS"


def updates(stream: DataFrame, spec: Spec, nulls: str = "nan") -> DataFrame:
    """A stream of state rows (see :func:`grovetally.plans.lower.states`): in output mode "update" a batch gives the nodes that it changed, in
    "complete" all. Rows hold what a node has got since the stream began."""
    return states_by_row(measured_by_row(stream, spec, nulls))


class Store:
    """The state of a stream's nodes in a folder: ``batch-N`` holds those that batch N changed, ``whole-N`` all up to batch N.

    A folder counts once it is written to its end, so a batch that failed leaves nothing to see. A batch that is delivered again finds its folder, or
    replaces what is unfinished.
    """

    def __init__(self, spark: SparkSession, path: str, structure: dict | None = None):
        self.spark, self.path, self.structure, self.folder = spark, path.rstrip("/"), structure, Folder(spark, path)

    def _finished(self) -> list[tuple[int, str]]:
        """(number, name) of the folders that count, in order: the latest whole one and the batches after it."""
        named = [(int(n.partition("-")[2]), n) for n in self.folder.names() if n.startswith(("batch-", "whole-")) and self.folder.has(f"{n}/{_DONE}")]
        begin = max((i for i, n in named if n.startswith("whole-")), default=-1)
        return sorted((i, n) for i, n in named if (n.startswith("whole-") and i == begin) or (n.startswith("batch-") and i > begin))

    def write(self, changed: DataFrame, number: int) -> None:
        done = self._finished()
        if any(i >= number for i, _ in done):
            return
        rows = stamped(changed.withColumn("batch", F.lit(number).cast("long")), self.structure)
        name = f"batch-{number:012d}"
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}")
        if len(done) >= BATCHES:
            stamped(self._latest(), self.structure).write.mode("overwrite").parquet(f"{self.path}/whole-{number:012d}")
            for old in [n for _, n in done] + [name]:
                self.folder.delete(old)

    def _latest(self) -> DataFrame:
        rows = self.spark.read.parquet(*[f"{self.path}/{n}" for _, n in self._finished()])
        measures = [c for c in rows.columns if c not in ("path", "kind", "keys")]
        return rows.groupBy("path", "kind", "keys").agg(F.max_by(F.struct(*measures), "batch").alias("s")).select("path", "kind", "keys", "s.*")

    def tally(self) -> Tally:
        """What the stream has filled so far."""
        done = self._finished()
        if not done:
            if self.structure is None:
                raise ValueError(f"{self.path} holds no batch yet")
            return Tally.empty(self.spark, self.structure)
        first = self.spark.read.parquet(f"{self.path}/{done[-1][1]}").schema["path"].metadata
        return Tally(self._latest(), json.loads(first[STRUCTURE]))


def fill_store(stream: DataFrame, spec: Spec, path: str, checkpoint: str, nulls: str = "nan", watch: Callable[[Tally], None] | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Starts a query that fills ``spec`` and keeps its state rows at ``path``; ``Store(spark, path).tally()`` reads them, from any session and at any
    time. ``watch`` gets the tally after each batch. Started again with the same checkpoint, path and tree, it goes on where it was; a tree of
    another structure is a :class:`~grovetally.operators.results.MergeError`."""
    store = Store(stream.sparkSession, path, H.shape(spec))
    H.agree(store.tally().structure, store.structure)

    def put(changed: DataFrame, number: int) -> None:
        store.write(changed, number)
        if watch is not None:
            watch(store.tally())

    writer = updates(stream, spec, nulls).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
