"""Fills a tree from a stream: every micro-batch is aggregated by the batch plan, and its result is
added to those before. Addition is associative, so the sum is that of the whole stream.

The running result is durable: each batch writes it, with the batch's number, beside the stream's
checkpoint, and a restart goes on from there.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.results import Result
from ..operators.spec import Spec
from ..plans.assemble import aggregate, build
from ..sources.jsonio import loads, to_string


class Kept:
    """A text by number in a folder of any file system that Spark can write to: the last two stay."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm = spark._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path(folder)
        self.fs = self.path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _file(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.path, name)

    def numbers(self) -> list[int]:
        if not self.fs.exists(self.path):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self.path)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def write(self, number: int, text: str) -> None:
        """The file gets its name when it is whole, so that a crash leaves the one before."""
        part, done = self._file(f"{number}.part"), self._file(f"{number}.json")
        out = self.fs.create(part, True)
        out.write(bytearray(text.encode()))
        out.close()
        self.fs.delete(done, False)
        if not self.fs.rename(part, done):
            raise OSError(f"{done} cannot be written")
        for old in self.numbers()[:-2]:
            self.fs.delete(self._file(f"{old}.json"), False)

    def read(self, number: int) -> str:
        stream = self.fs.open(self._file(f"{number}.json"))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()


class Incremental:
    """The running result of a stream.

    A batch that is delivered again after a failure (same number) replaces its first delivery
    instead of counting twice: the last batch is kept apart until the next one comes. With ``kept``
    the result is written after each batch and read at the start.
    """

    def __init__(self, spec: Spec, nulls: str = "nan", watch: Callable[[Result], None] | None = None, kept: Kept | None = None):
        self.spec, self.nulls, self.watch, self.kept = spec, nulls, watch, kept
        self._before: Result = build(spec, {})
        self._last: Result | None = None
        self._number: int | None = None
        if kept is not None and (numbers := kept.numbers()):
            found = json.loads(kept.read(numbers[-1]))
            self._before, self._last, self._number = loads(found["before"]), loads(found["last"]), numbers[-1]

    @property
    def result(self) -> Result:
        return self._before if self._last is None else self._before + self._last

    def add(self, batch: DataFrame, number: int) -> None:
        own = aggregate(batch, self.spec, self.nulls)
        if self._last is not None and number != self._number:
            self._before = self._before + self._last
        self._last, self._number = own, number
        if self.kept is not None:
            self.kept.write(number, json.dumps({"before": to_string(self._before), "last": to_string(own)}))
        if self.watch is not None:
            self.watch(self.result)


def fill_stream(stream: DataFrame, spec: Spec, checkpoint: str, watch: Callable[[Result], None] | None = None, **options) -> tuple[StreamingQuery, Incremental]:
    """Starts a query that fills ``spec``; the second value holds the running result. Started again with the same
    ``checkpoint`` and tree it goes on with the result of all batches before."""
    kept = Kept(stream.sparkSession, f"{checkpoint.rstrip('/')}/running-result")
    running = Incremental(spec, watch=watch, kept=kept, **options)
    query = stream.writeStream.foreachBatch(running.add).option("checkpointLocation", checkpoint).start()
    return query, running
