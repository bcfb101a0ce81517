"""A log of results as a Spark data source: each write appends one result, of any size, as a whole or not at all.

``spark.dataSource.register(TallyLog)`` makes the format ``tally_log`` known (:func:`log` and :func:`logged` do so themselves):

* A batch read has one partition for each file of the entries asked for (options ``since`` and ``until`` by number; ``entry`` for one, or "last").
* A stream read has the number of an entry as its offset, so that a watcher gets every result once, and goes on after a restart.
* Tasks of a write leave Parquet files with names of their own. The driver commits by writing a manifest, after which the entry is
  there; a write that fails removes its files, and without a manifest none of them is read.

Rows are tidy rows with their entry, its time, and the kind of the node. The folder may be in any store that Arrow's file systems open
(local, HDFS, S3, GCS). One writer at a time may append to a log, as to a file.

This module is sent to the Python workers by value, so nothing of this package needs to be installed there.
"""

from __future__ import annotations

import datetime
import json
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as arrow_fs
from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FORMAT = "tally_log"
#: The rows of a result.
ROWS = "path string, kind string, keys array<string>, entries double, sum double, mean double, variance double, min double, max double"
_ARROW = pa.schema([("path", pa.string()), ("kind", pa.string()), ("keys", pa.list_(pa.string())), *[(c, pa.float64()) for c in ("entries", "sum", "mean", "variance", "min", "max")]])
_MANIFESTS, _FILES = "entries", "rows"
#: Rows of a batch that is read.
_BATCH = 1 << 14


class _Store:
    """The folder of a log."""

    def __init__(self, path: str):
        self.fs, self.root = arrow_fs.FileSystem.from_uri(path)
        self.root = self.root.rstrip("/")

    def at(self, *names: str) -> str:
        return "/".join((self.root, *names))

    def entries(self) -> list[dict]:
        """The manifests in order, from the last that replaced all before."""
        found = self.fs.get_file_info(arrow_fs.FileSelector(self.at(_MANIFESTS), allow_not_found=True))
        out: list[dict] = []
        for info in sorted((f for f in found if f.base_name.endswith(".json")), key=lambda f: f.base_name):
            with self.fs.open_input_stream(info.path) as f:
                entry = json.loads(f.read())
            out = [entry] if entry["replaces"] else [*out, entry]
        return out

    def commit(self, entry: dict) -> None:
        """Writes a manifest under a passing name first: it appears whole."""
        self.fs.create_dir(self.at(_MANIFESTS), recursive=True)
        part = self.at(_MANIFESTS, f"{uuid.uuid4().hex}.part")
        with self.fs.open_output_stream(part) as f:
            f.write(json.dumps(entry).encode())
        self.fs.move(part, self.at(_MANIFESTS, f"{entry['entry']:020d}.json"))

    def remove(self, names: list[str]) -> None:
        for name in names:
            try:
                self.fs.delete_file(self.at(_FILES, name))
            except FileNotFoundError:
                pass


@dataclass
class _File(InputPartition):
    entry: int
    at: str
    name: str

    def __init__(self, entry: int, at: str, name: str):
        super().__init__(None)
        self.entry, self.at, self.name = entry, at, name


def _files(entries: list[dict]) -> list[_File]:
    return [_File(e["entry"], e["at"], name) for e in entries for name in e["files"]]


def _batches(path: str, file: _File) -> Iterator[pa.RecordBatch]:
    store = _Store(path)
    at = datetime.datetime.fromisoformat(file.at)
    with store.fs.open_input_file(store.at(_FILES, file.name)) as f:
        for batch in pq.ParquetFile(f).iter_batches(_BATCH):
            n = batch.num_rows
            own = [pa.array([file.entry] * n, pa.int64()), pa.array([at] * n, pa.timestamp("us", "UTC"))]
            yield pa.RecordBatch.from_arrays([*own, *batch.columns], ["entry", "at", *_ARROW.names])


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.only, self.since, self.until = options.get("entry"), int(options.get("since", -1)), int(options.get("until", sys.maxsize))

    def partitions(self) -> list[InputPartition]:
        entries = _Store(self.path).entries()
        if self.only is not None:
            entries = entries[-1:] if self.only == "last" else [e for e in entries if e["entry"] == int(self.only)]
        # a partition at least, as without any Spark would read once
        return _files([e for e in entries if self.since <= e["entry"] <= self.until]) or [_File(-1, "", "")]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        return _batches(self.path, partition) if partition.name else iter(())


class _StreamReader(DataSourceStreamReader):
    """An offset is the number of the first entry that is not yet read."""

    def __init__(self, options: dict):
        self.path, self.since = options["path"], int(options.get("since", 0))

    def initialOffset(self) -> dict:
        return {"entry": self.since}

    def latestOffset(self) -> dict:
        entries = _Store(self.path).entries()
        return {"entry": max(self.since, entries[-1]["entry"] + 1 if entries else 0)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return _files([e for e in _Store(self.path).entries() if start["entry"] <= e["entry"] < end["entry"]])

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        return _batches(self.path, partition)


@dataclass
class _Written(WriterCommitMessage):
    name: str | None
    rows: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.structure, self.replaces = options["path"], options.get("structure"), overwrite
        self.id = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        store, name, rows = _Store(self.path), f"{self.id}-{uuid.uuid4().hex}.parquet", 0
        store.fs.create_dir(store.at(_FILES), recursive=True)
        writer = None
        try:
            for batch in iterator:
                if writer is None:
                    writer = pq.ParquetWriter(store.at(_FILES, name), _ARROW, filesystem=store.fs)
                writer.write_table(pa.Table.from_batches([batch]).select(_ARROW.names).cast(_ARROW))
                rows += batch.num_rows
        except BaseException:
            if writer is not None:
                writer.close()
                store.remove([name])
            raise
        if writer is None:
            return _Written(None, 0)
        writer.close()
        return _Written(name, rows)

    def commit(self, messages: list[_Written | None]) -> None:
        store = _Store(self.path)
        found = store.entries()
        done = [m for m in messages if m is not None and m.name is not None]
        now = datetime.datetime.now(datetime.timezone.utc).isoformat()
        number = found[-1]["entry"] + 1 if found else 0
        store.commit({"entry": number, "at": now, "files": [m.name for m in done], "rows": sum(m.rows for m in done), "structure": self.structure, "replaces": self.replaces})

    def abort(self, messages: list[_Written | None]) -> None:
        _Store(self.path).remove([m.name for m in messages if m is not None and m.name is not None])


class TallyLog(DataSource):
    """The format ``tally_log``; see the module. Option ``path`` is the folder, as an URI or an absolute path. A write needs rows of ``ROWS``; ``mode("overwrite")``
    makes an entry that replaces all before, which stay readable by none."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return f"entry long, at timestamp, {ROWS}"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)

    def streamReader(self, schema) -> _StreamReader:
        return _StreamReader(self.options)

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options, overwrite)


def manifests(path: str) -> list[dict]:
    """What is known of each entry of a log: number, time, files, rows and structure."""
    return _Store(path).entries()
