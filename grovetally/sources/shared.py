"""Folders that driver and executors share."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names. Without that setting a temporary folder serves on a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(found or 'file://' + tempfile.mkdtemp(prefix='grovetally-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Folder:
    """A folder of any file system that Spark can reach, from the driver."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path.rstrip("/")
        self.fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self) -> list[str]:
        at = self._at("")
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def has(self, name: str) -> bool:
        return self.fs.exists(self._at(name))

    def delete(self, name: str) -> None:
        self.fs.delete(self._at(name), True)

    def write(self, name: str, value) -> None:
        out = self.fs.create(self._at(name), True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()

    def read(self, name: str) -> dict:
        stream = self.fs.open(self._at(name))
        try:
            return json.loads(bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()
