"""Views of results whose bins are rows: histograms, profiles, layers and efficiencies of any number of bins.

Empty bins of a sparse binning are runs: a row says where one begins and ends, so an outlier far away costs a row, not all bins in between. Filled bins
are paired with their neighbours inside ranges of the sorted bins, and over the borders of ranges by a table with a row for each range;
no task sees all bins, however many one binning has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import shape as H
from ..operators.views import ShapeError
from ..sources.shared import shared_path
from .tally import Tally

_VALUES = ("Count", "Sum", "Average", "Deviate")


def _at(structure: dict, path: str) -> dict:
    """The structure of the node at ``path``."""
    d = structure
    for step in filter(None, path.split("/")):
        below = dict(d.get("children", []))
        d = below.get("value" if d["kind"] == "Fraction" and step in ("numerator", "denominator") else step)
        if d is None:
            raise KeyError(f"the tree has nothing at {path!r}")
    return d


def _equal_bins(structure: dict, path: str) -> tuple[str, dict]:
    """Path and structure of the equal bins at ``path``, or of those in a Select there."""
    d = _at(structure, path)
    if d["kind"] == "Select":
        path = f"{path}/data" if path else "data"
        d = _at(structure, path)
    if d["kind"] not in ("Bin", "SparselyBin"):
        raise ShapeError(f"bins of equal width are needed, not {d['kind']}")
    return path, d


def neighbours(rows: DataFrame, group: str, place: str) -> DataFrame:
    """``rows`` with ``before`` and ``after``: the places next to theirs in their group, null at its ends. Groups may be of any size, and places must differ in one."""
    spark, path = rows.sparkSession, shared_path(rows.sparkSession, "ranges")
    rows.repartitionByRange(group, place).withColumn("range", F.spark_partition_id()).write.parquet(path)
    ranged, at, here = spark.read.parquet(path), F.struct(group, place), Window.partitionBy("range").orderBy(group, place)
    # a row for each range
    ends = ranged.groupBy("range").agg(F.min(at).alias("first"), F.max(at).alias("last"))
    over = Window.orderBy("range")
    ends = ends.select("range", F.lag("last").over(over).alias("left"), F.lead("first").over(over).alias("right"))
    out = ranged.select("*", F.lag(at).over(here).alias("lag"), F.lead(at).over(here).alias("lead")).join(F.broadcast(ends), "range")
    same = lambda x: F.when(x[group] == F.col(group), x[place])
    return out.withColumns({"before": same(F.coalesce("lag", "left")), "after": same(F.coalesce("lead", "right"))}).drop("range", "lag", "lead", "left", "right")


def bins(tally: Tally, path: str = "", empty: str = "runs", z: float = 1.0) -> DataFrame:
    """The equal bins at ``path``, which may be inside a Select there: ``above`` (keys of the bins that hold this binning), ``bin`` and
    ``last`` (the same, but for a run of empty bins), ``low``, ``high``, ``center``, ``entries``, ``value`` (count, sum or mean) and ``error`` (``z`` standard errors, null where the bins have none).

    ``empty``: "runs" gives a row for each run of empty bins, "all" one for each empty bin, "none" filled bins only. A Bin is filled from its
    first to its last bin, a SparselyBin from the first to the last that data made. Bins below other bins are the layers of a Stack or
    IrregularlyBin, the rows of a two-dimensional histogram, or a histogram for each category: there, binnings without any data have no rows.
    """
    if empty not in ("runs", "all", "none"):
        raise ValueError('empty must be "runs", "all" or "none"')
    path, d = _equal_bins(tally.structure, path)
    step = "values" if d["kind"] == "Bin" else "bins"
    where, inside = f"{path}/{step}" if path else step, dict(d["children"])[step]["kind"]
    if inside not in _VALUES:
        raise ShapeError(f"the bins must hold {', '.join(_VALUES)}, not {inside}")
    sizes = next(s for p, _, s, _ in H.nodes(tally.structure) if p == where)
    rows = tally.tidy(dense=None not in sizes).where(F.col("path") == where)
    measures = ("entries", "sum", "mean", "variance")
    rows = rows.selectExpr(f"slice(keys, 1, {len(sizes) - 1}) AS above", f"bigint(get(keys, {len(sizes) - 1})) AS bin", *measures).where("bin IS NOT NULL")
    num = d.get("num")
    if None in sizes and empty != "none":
        rows = neighbours(rows.where("entries > 0"), "above", "bin")
        begin, end = ("0L", f"{num - 1}L") if num else ("bin", "bin")
        none = "0D AS entries, 0D AS sum, double('NaN') AS mean, double('NaN') AS variance"
        own = f"struct(bin, bin AS last, {', '.join(measures)})"
        after = f"struct(bin + 1L AS bin, coalesce(after - 1L, {end}) AS last, {none})"
        before = f"struct({begin} AS bin, if(before IS NULL, bin - 1L, {begin} - 1L) AS last, {none})"
        rows = rows.selectExpr("above", f"inline(filter(array({before}, {own}, {after}), r -> r.last >= r.bin))")
    else:
        rows = rows.withColumn("last", F.col("bin"))
        if empty != "all":
            rows = rows.where("entries > 0") if empty == "none" else rows
    if empty == "all":
        rows = rows.selectExpr("above", "explode(sequence(bin, last)) AS bin", *measures).withColumn("last", F.col("bin"))
    edge = (lambda i: f"({d['low']!r}D + {d['high'] - d['low']!r}D * ({i}) / {num}D)") if num else (lambda i: f"({d['origin']!r}D + ({i}) * {d['bin_width']!r}D)")
    low, high = edge("bin"), edge("last + 1L")
    value = {"Count": "entries", "Sum": "sum"}.get(inside, "mean")
    error = {"Count": f"{float(z)!r}D * sqrt(entries)", "Deviate": f"if(entries > 0, {float(z)!r}D * sqrt(variance / entries), double('NaN'))"}.get(inside, "double(NULL)")
    return rows.selectExpr("above", "bin", "last", f"{low} AS low", f"{high} AS high", f"({low} + {high}) / 2 AS center", "entries", f"{value} AS value", f"{error} AS error")


def fractions(tally: Tally, path: str = "", empty: str = "runs", interval: str = "wald", z: float = 1.0) -> DataFrame:
    """The efficiencies of a Fraction of histograms: for each bin of the denominator (see :func:`bins`) ``numerator``, ``denominator``, ``value`` and the bounds ``lower`` and
    ``upper`` of a "wald" or "wilson" interval of ``z`` standard deviations; NaN where the denominator is empty."""
    d = _at(tally.structure, path)
    if d["kind"] != "Fraction":
        raise ShapeError(f"a Fraction is needed, not {d['kind']}")
    if interval not in ("wald", "wilson"):
        raise ValueError('interval must be "wald" or "wilson"')
    below = [f"{path}/{s}" if path else s for s in ("denominator", "numerator")]
    whole, part = bins(tally, below[0], empty), bins(tally, below[1], "none").selectExpr("above", "bin", "entries AS numerator")
    out = whole.join(part, ["above", "bin"], "left").selectExpr("above", "bin", "last", "low", "high", "center", "coalesce(numerator, 0D) AS numerator", "entries AS denominator")
    p, n = "numerator / nullif(denominator, 0D)", "nullif(denominator, 0D)"
    spread = f"greatest({p} * (1D - {p}), 0D)"

    def bound(z: float) -> str:
        if interval == "wald":
            return f"{p} + {z!r}D * sqrt({spread} / {n})"
        return f"({p} + {z * z!r}D / (2D * {n}) + {z!r}D * sqrt({spread} / {n} + {z * z!r}D / (4D * {n} * {n}))) / (1D + {z * z!r}D / {n})"

    ends = {"value": p, "lower": bound(-float(z)), "upper": bound(float(z))}
    return out.selectExpr("*", *[f"coalesce({x}, double('NaN')) AS {c}" for c, x in ends.items()])
