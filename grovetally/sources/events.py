"""Collision events as JSON lines, gzipped or not."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_VECTOR = "px: double, py: double, pz: double, E: double"
_LEPTON = f"array<struct<{_VECTOR}, q: int, iso: double>>"

#: The fields of an event.
EVENT_SCHEMA = (
    f"jets array<struct<{_VECTOR}, btag: double>>, muons {_LEPTON}, electrons {_LEPTON}, photons array<struct<{_VECTOR}, iso: double>>, "
    "MET struct<px: double, py: double>, numPrimaryVertices bigint"
)


def read_events(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Events from any path that Spark can open, one JSON object a line.

    The schema is given, so nothing is read twice; lists that are missing become empty.
    """
    df = spark.read.schema(EVENT_SCHEMA).json(path)
    lists = [f.name for f in df.schema.fields if f.dataType.typeName() == "array"]
    return df.withColumns({c: F.coalesce(c, F.array().cast(df.schema[c].dataType)) for c in lists})
