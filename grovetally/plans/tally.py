"""Filled trees as mergeable rows of a DataFrame: addition, scaling and storage without a tree on the driver.

A :class:`Tally` holds a row of state for each node and its bins. Adding two of them puts their rows together; rows of one node are folded
when they are finished or written, in one ``groupBy`` however many tallies were added, and before the shuffle. So a year of
days is one union and one aggregation, and categories may be too many for any one machine.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import results as R
from ..operators import shape as H
from ..operators.spec import Spec
from ..sources import log_source
from .lower import MEASURES, empty_rows, finished, folded, parts, stacked, states

#: The columns of state rows.
STATE = "path string, kind string, keys array<string>, entries double, sum double, mean double, m2 double, min double, max double"
_COLUMNS = [c.split()[0] for c in STATE.split(", ")]
_LOGGED = [c.split()[0] for c in log_source.ROWS.split(", ")]
#: The key of a structure in the metadata of a column.
STRUCTURE = "structure"


class Tally:
    """The rows of a filled tree and its structure (as :func:`grovetally.operators.shape.shape` gives it).

    ``rows`` may hold several rows for a node, which stand for their sum. Below a Stack they are of its bins or, if ``summed``, of all
    from a threshold up. ``single``: there is one row for each node. ``kept``: rows come from saved tallies, a few for each node; they are brought together by
    node before they are folded, as a table of all nodes that a task reads would grow with the files, and fold little.
    """

    def __init__(self, rows: DataFrame, structure: dict, summed: bool = False, single: bool = False, kept: bool = False):
        self.custom = H.measured(structure)
        self.extra = sorted({c for own in self.custom.values() for c in own.columns().values()})
        self.rows, self.structure, self.summed, self.single, self.kept = rows.select(*_COLUMNS, *self.extra), structure, summed, single, kept

    @property
    def _every(self) -> set[str]:
        return set(MEASURES).union(self.extra)

    def _with(self, rows: DataFrame, single: bool) -> Tally:
        return Tally(rows, self.structure, self.summed, single, self.kept and not single)

    def _folded(self, rows: DataFrame) -> DataFrame:
        return folded(rows.repartition("path", "kind", "keys") if self.kept else rows, self._every)

    def _thresholds(self) -> list[tuple[str, int]]:
        return [] if self.summed else [(path, i) for path, _, _, stacks in H.nodes(self.structure) for i in stacks]

    def _final(self) -> Tally:
        """One row for each node, summed."""
        return Tally(stacked(self.compact().rows, self._every, self._thresholds()), self.structure, True, True)

    def __add__(self, other: Tally) -> Tally:
        """The sum: what both trees were filled with. Trees of other structure or with other names cannot be added (:class:`MergeError`)."""
        if not isinstance(other, Tally):
            return NotImplemented
        H.agree(self.structure, other.structure)
        a, b = (self, other) if self.summed == other.summed or not self._thresholds() + other._thresholds() else (self._final(), other._final())
        return Tally(a.rows.union(b.rows), self.structure, a.summed, kept=a.kept or b.kept)

    def __mul__(self, factor: float) -> Tally:
        """All weights times ``factor``; a factor that is NaN or not above 0 gives :meth:`zero`."""
        if math.isnan(factor) or factor <= 0:
            return self.zero()
        f = F.lit(float(factor))
        return self._with(self.rows.withColumns({c: F.col(c) * f for c in ("entries", "sum", "m2", *[c for c in self.extra if c.startswith("u_sum_")])}), self.single)

    __rmul__ = __mul__

    def zero(self) -> Tally:
        """The tree without data."""
        return Tally.empty(self.rows.sparkSession, self.structure)

    @staticmethod
    def empty(spark: SparkSession, structure: dict) -> Tally:
        more = "".join(f", {c} double" for own in H.measured(structure).values() for c in own.columns().values())
        return Tally(spark.createDataFrame([], STATE + more), structure)

    def compact(self) -> Tally:
        """The same with one row for each node."""
        return self if self.single else self._with(self._folded(parts(self.rows)), True)

    def tidy(self, dense: bool = True) -> DataFrame:
        """Rows as :func:`grovetally.tidy` gives them."""
        rows = parts(self.rows)
        nothing = ["0D AS entries", *[f"double(NULL) AS {c}" for c in rows.columns[4:]]]
        for empty in empty_rows(self.rows.sparkSession, [n[:3] for n in H.nodes(self.structure)], dense, nothing):
            rows = rows.union(empty)
        every = self._every
        return finished(stacked(self._folded(rows), every, self._thresholds()), every, custom=self.custom)

    def result(self) -> R.Result:
        """The tree, on the driver: for results that fit there."""
        from .assemble import assemble

        return assemble(self.tidy(dense=False), H.spec_of(self.structure))

    def save(self, path: str) -> None:
        """Writes the rows, one for each node, as new Parquet files; the structure goes into their schema."""
        self._own().write.mode("errorifexists").parquet(path)

    def _own(self) -> DataFrame:
        """The rows to be written: of bins, which all that is saved has in common."""
        if self.summed and any(stacks for *_, stacks in H.nodes(self.structure)):
            raise ValueError("rows below a Stack are summed from its thresholds up already; save what they were made of, or append to a log")
        return stamped(self.compact().rows, self.structure)

    def append(self, path: str) -> None:
        """Adds to what is saved at ``path``, as further files: they appear as a whole or not at all with a committer that
        does so, and cost no reading of what is there. A tree of other structure is a :class:`MergeError`."""
        try:
            H.agree(load(self.rows.sparkSession, path).structure, self.structure)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        self._own().write.mode("append").parquet(path)

    def log(self, path: str, replace: bool = False) -> None:
        """Appends this result to a log that ``spark.read`` and ``spark.readStream`` read as format ``tally_log``; with ``replace`` it
        becomes the only one. It appears whole, or not at all if the write fails."""
        if self.custom:
            raise TypeError(f"a log has no columns for {', '.join(self.custom)}; save the tally")
        self.rows.sparkSession.dataSource.register(log_source.TallyLog)
        rows = finished(self._final().rows, set(MEASURES), ("kind",)).select(*_LOGGED)
        writer = rows.write.format(log_source.FORMAT).option("path", path).option("structure", H.text(self.structure))
        writer.mode("overwrite" if replace else "append").save()


def stamped(rows: DataFrame, structure: dict) -> DataFrame:
    """``rows`` with the structure in their schema, which Parquet keeps."""
    return rows.withMetadata("path", {STRUCTURE: H.text(structure)})


def load(spark: SparkSession, path: str) -> Tally:
    """What :meth:`Tally.save` and :meth:`Tally.append` have written at ``path``, added up."""
    rows = spark.read.parquet(path)
    known = rows.schema["path"].metadata if "path" in rows.columns else {}
    if STRUCTURE not in known:
        raise ValueError(f"{path} holds no saved tally")
    return Tally(rows, json.loads(known[STRUCTURE]), kept=True)


def logged(spark: SparkSession, path: str, entry: int | str = "last") -> Tally:
    """A result of a log (:meth:`Tally.log`) by its number, or the last one, or the sum of "all"."""
    spark.dataSource.register(log_source.TallyLog)
    known = [e for e in log_source.manifests(path) if entry in ("last", "all", e["entry"])]
    if not known:
        raise ValueError(f"{path} has no entry {entry!r}")
    structure = json.loads(known[-1]["structure"])
    for e in known if entry == "all" else []:
        H.agree(json.loads(e["structure"]), structure)
    reader = spark.read.format(log_source.FORMAT).option("path", path)
    rows = (reader if entry == "all" else reader.option("entry", str(known[-1]["entry"]))).load()
    return from_tidy(rows, structure)


def from_tidy(rows: DataFrame, structure: dict) -> Tally:
    """The tally that tidy rows with a column ``kind`` stand for; a row with no entries stands for none."""
    back = ["CASE kind WHEN 'Average' THEN mean * entries WHEN 'Transformed' THEN entries ELSE sum END AS sum", "CASE WHEN kind = 'Deviate' THEN mean END AS mean", "variance * entries AS m2"]
    ends = [f"nullif({c}, double('NaN')) AS {c}" for c in ("min", "max")]
    return Tally(rows.where("entries > 0 OR kind = 'Transformed'").selectExpr("path", "kind", "keys", "entries", *back, *ends), structure, True)


def tally(df: DataFrame, spec: Spec, nulls: str = "nan") -> Tally:
    """``spec`` filled from ``df``, in the same single pass as :func:`grovetally.tidy`, as rows that can be added to others."""
    return Tally(states(df, spec, nulls), H.shape(spec), single=True)


def merge(tallies: Iterable[Tally]) -> Tally:
    """The sum of some tallies, one at least."""
    return reduce(Tally.__add__, tallies)
