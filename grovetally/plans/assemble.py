"""Rebuilds the tree of a result from its tidy rows."""

from __future__ import annotations

import json
from collections import defaultdict

from pyspark.sql import DataFrame

from ..operators import results as R
from ..operators import spec as S
from .lower import tidy

_NONE = {"entries": 0.0, "sum": 0.0, "mean": float("nan"), "variance": float("nan"), "min": float("nan"), "max": float("nan")}


def aggregate(df: DataFrame, spec: S.Spec, nulls: str = "nan") -> R.Result:
    """Fills a tree from a DataFrame in one pass.

    The result has as many nodes as there are bins; where categories or sparse bins are too
    many for one machine, use ``tidy``, whose rows stay distributed.
    """
    return assemble(tidy(df, spec, nulls, dense=False), spec)


def assemble(rows: DataFrame, spec: S.Spec) -> R.Result:
    """The result whose tidy rows these are."""
    by: dict[str, dict[tuple, dict]] = defaultdict(dict)
    columns = [*_NONE, *(c for c in rows.columns if c == "more")]
    for r in rows.select("path", "keys", *columns).collect():
        by[r["path"]][tuple(r["keys"])] = {k: r[k] for k in columns}
    return build(spec, by)


def build(spec: S.Spec, by: dict) -> R.Result:
    # keys of sparse children by the keys above them
    under: dict[str, dict[tuple, list[str]]] = {}

    def below(path: str, keys: tuple) -> list[str]:
        if path not in under:
            found = defaultdict(list)
            for k in by.get(path, {}):
                found[k[:-1]].append(k[-1])
            under[path] = found
        return under[path].get(keys, [])

    def node(s: S.Spec, path: str, keys: tuple) -> R.Result:
        if hasattr(s, "expand"):
            return node(s.expand(), path, keys)
        row = by.get(path, {}).get(keys) or _NONE
        step = lambda name: f"{path}/{name}" if path else name
        n, name = row["entries"], s.name
        if isinstance(s, S.Count):
            return R.Counted(n)
        if isinstance(s, S.Sum):
            return R.Summed(n, row["sum"], name=name)
        if isinstance(s, S.Average):
            return R.Averaged(n, row["mean"], name=name)
        if isinstance(s, S.Deviate):
            return R.Deviated(n, row["mean"], row["variance"], name=name)
        if isinstance(s, S.Minimize):
            return R.Minimized(n, row["min"], name=name)
        if isinstance(s, S.Maximize):
            return R.Maximized(n, row["max"], name=name)
        if isinstance(s, S.Measured):
            return s.make(n, (row.get("more") or {}) if n else {}, name)
        if isinstance(s, S.Bag):
            p = step("values")
            return R.Bagged(n, {_value(k, s.range): by[p][(*keys, k)]["entries"] for k in below(p, keys)}, s.range, name=name)
        if isinstance(s, S.Bin):
            flows = [node(c, step(f), keys) for f, c in s.children()[1:]]
            return R.Binned(n, s.low, s.high, tuple(node(s.value, step("values"), (*keys, str(i))) for i in range(s.num)), *flows, name=name)
        if isinstance(s, S.SparselyBin):
            p = step("bins")
            bins = {int(k): node(s.value, p, (*keys, k)) for k in sorted(below(p, keys), key=int)}
            return R.SparselyBinned(n, s.bin_width, bins, node(s.nanflow, step("nanflow"), keys), s.origin, zero(s.value), name=name)
        if isinstance(s, S.Categorize):
            p = step("bins")
            return R.Categorized(n, {k: node(s.value, p, (*keys, k)) for k in sorted(below(p, keys))}, zero(s.value), name=name)
        if isinstance(s, (S.CentrallyBin, S.IrregularlyBin)):
            at = s.centers if isinstance(s, S.CentrallyBin) else s.edges
            kind = R.CentrallyBinned if isinstance(s, S.CentrallyBin) else R.Stacked if isinstance(s, S.Stack) else R.IrregularlyBinned
            return kind(n, tuple((x, node(s.value, step("bins"), (*keys, str(i)))) for i, x in enumerate(at)), node(s.nanflow, step("nanflow"), keys), name=name)
        if isinstance(s, S.Select):
            return R.Selected(n, node(s.cut, step("data"), keys), name=name)
        if isinstance(s, S.Fraction):
            return R.Fractioned(n, node(s.value, step("numerator"), keys), node(s.value, step("denominator"), keys), name=name)
        each = [(k, node(c, step(k), keys)) for k, c in s.children()]
        if isinstance(s, S._Labeled):
            return (R.Labeled if isinstance(s, S.Label) else R.UntypedLabeled)(n, dict(each))
        return (R.Indexed if isinstance(s, S.Index) else R.Branched)(n, tuple(c for _, c in each))

    def zero(s: S.Spec) -> R.Result:
        return build(s, {})

    return node(spec, "", ())


def _value(key: str, range: str):
    if range == "S":
        return key
    return float(key) if range == "N" else tuple(float(x) for x in json.loads(key, parse_constant=float))
