"""Lowers an aggregation tree to one DataFrame plan.

Every node asks for sums, extremes or moments of some rows by the bins above it. Bins are
grouping keys, never columns of their own. The requests of a tree are fused:

* A chain is the list of axes (binnings) from the root to a leaf. Requests whose axes begin a
  longer chain are computed with it and rolled up from its small result, so a tree of
  nested binnings takes a single ``groupBy`` whatever flows and totals it holds.
* Guards and weights of selections become conditions inside the aggregates.
* A tree with several chains explodes each row into one record for each chain, so the
  input is read once; all chains then share one ``groupBy``. The records are folded
  before the shuffle, which moves bins, not rows.
* With many chains, what all have in common stands outside the records, and a table of the nodes, in the plan as one constant,
  says which aggregates of a bin go to which node: a bin's work and the plan's size do not grow with the other chains.
* Cumulative containers are aggregated as bins and added up from the last to the first in the small result.
* Bins between many edges are found by a directory of equal slots over the sorted edges and a binary search of the
  edges in one slot, in a few projections: the time for a row hardly depends on the number of edges.
* Weighted variances come from covariances, which Spark sums about running means: with C for
  a covariance over n rows, sum w (x - m)^2 = n (C(w x, x) - m C(w, x)), where m is the weighted mean.
  So one pass suffices, and no more is lost than the rounding of x itself loses.

Expressions are built as SQL text and parsed a few at a time, which keeps planning short.
No Python runs on the executors.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from dataclasses import dataclass, field
from functools import reduce
from itertools import accumulate
from math import floor, inf, isinf, isnan, prod
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.quantity import Quantity
from ..operators import spec as S

UNDER, OVER, NAN = -1, -2, -3
_LOWEST = -(2**63) + 1
#: Up to so many cuts a bin is found by comparing with one after the other.
FEW_CUTS = 32
#: Empty bins that one task makes.
_EMPTY = 1 << 18
#: Up to so many chains, what a bin adds to its nodes is spelled out for each node; beyond, it is looked up in a table of the nodes.
FEW_CHAINS = 8
#: The most bins of a grid that shares a table of empty bins with others.
_SMALL = 1 << 12


@dataclass(frozen=True)
class Axis:
    """A grouping key, as SQL. ``size``: the number of its bins if they are known beforehand."""

    id: str
    slot: str
    key: str = field(compare=False, hash=False)
    size: int | None = None
    cumulative: bool = False


@dataclass(frozen=True, eq=False)
class Request:
    """What the node at ``path`` needs: the rows of ``chain`` that meet ``tests`` and ``guard``,
    by the keys of ``axes``. Guard, weight and value are SQL."""

    path: str
    kind: str
    axes: tuple[Axis, ...]
    chain: tuple[Axis, ...]
    tests: tuple[tuple[Axis, int | None], ...]
    guard: str | None
    weight: str | None
    value: str | None = None
    transform: object = None
    #: Conditions of the selections above, as they stand in the input: no other row counts.
    where: tuple = ()
    #: A container that brings its own parts.
    custom: S.Measured | None = None


@dataclass
class Plan:
    """Requests and the projection of quantities they refer to; ``steps`` are projections that follow, each (name, SQL)."""

    base: list[Column]
    requests: list[Request]
    chains: list[tuple[Axis, ...]]
    steps: list[list[tuple[str, str]]]

    def project(self, df: DataFrame) -> DataFrame:
        """The quantities of ``df``, of the rows that some request counts: where all are below selections, these filter the scan."""
        if all(r.where for r in self.requests):
            ways = {r.guard: r.where for r in self.requests}
            df = df.where(reduce(or_, [reduce(and_, where) for where in ways.values()]))
        out = df.select(*self.base) if self.base else df.selectExpr("0 AS q")
        for step in self.steps:
            out = out.selectExpr("*", *[f"{x} AS {n}" for n, x in step])
        return out


def _number(x: float) -> str:
    """A double as SQL."""
    x = float(x)
    return "double('NaN')" if isnan(x) else f"double('{'-' * (x < 0)}Infinity')" if isinf(x) else f"{x!r}D"


def _string(x: str) -> str:
    """A string as SQL."""
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _selections(n: S.Spec):
    """The quantities that select, in a whole tree."""
    if hasattr(n, "expand"):
        yield from _selections(n.expand())
        return
    if isinstance(n, (S.Select, S.Fraction)):
        yield n.q
    for below in (n.cut,) if isinstance(n, S.Select) else (n.value,) if isinstance(n, S.Fraction) else [c for _, c in n.children()]:
        yield from _selections(below)


class _Lowering:
    def __init__(self, df: DataFrame, nulls: str, spec: S.Spec):
        self.df, self.nulls = df, nulls
        self.base: dict[str, Column] = {}
        self.known: dict = {}
        #: Projections, one after the other, that find a bin, by quantity and cuts.
        self.searches: dict[tuple, list[tuple[str, str]]] = {}
        self.requests: list[Request] = []
        asked = [q for q in _selections(spec) if not self.passes_all(q)]
        types = df.select(*[q.column.alias(f"s{i}") for i, q in enumerate(asked)]).schema if asked else []
        self.types = {id(q): f.dataType for q, f in zip(asked, types, strict=True)}

    @staticmethod
    def passes_all(q: Quantity) -> bool:
        return isinstance(q.expr, (int, float)) and float(q.expr) == 1.0

    def name(self, q: Quantity, how: str) -> str:
        """The base column of a quantity, projected once however often it is used."""
        # an object in the key keeps it alive, so that identities stay apart
        key = (how, q.expr if isinstance(q.expr, (str, float, int)) else id(q.expr))
        if key not in self.known:
            name = f"q{len(self.base)}"
            if how == "number":
                self.base[name] = q.number(self.nulls)
            elif how == "category":
                self.base[name] = q.category()
            elif how == "flag":
                self.base[name] = F.coalesce(q.column, F.lit(False))
            else:
                self.base[name] = q.column.cast("array<double>")
            self.known[key] = (name, q)
        return self.known[key][0]

    def ask(self, node: S.Spec, path: str, kind: str, at: dict, **more) -> None:
        self.requests.append(Request(path, kind, at["axes"], at["chain"], at["tests"], at["guard"], at["weight"], where=at["where"], **more))

    def chosen(self, q: Quantity, at: dict) -> dict:
        """Guard and weight below a selection."""
        if self.passes_all(q):
            return at
        if isinstance(self.types[id(q)], T.BooleanType):
            flag = self.name(q, "flag")
            at = at | {"where": (*at["where"], q.column)}
            return at | {"guard": flag if at["guard"] is None else f"({at['guard']} AND {flag})"}
        w = self.name(q, "number") if at["weight"] is None else f"({at['weight']} * {self.name(q, 'number')})"
        w = f"nanvl({w}, 0D)"
        if at["weight"] is None:  # products may be above 0 where a factor is not
            at = at | {"where": (*at["where"], q.column.cast("double") > 0)}
        passes = f"({w} > 0D)"
        return at | {"weight": w, "guard": passes if at["guard"] is None else f"({at['guard']} AND {passes})"}

    def inside(self, at: dict, axis: Axis, test: int | None, keep: bool) -> dict:
        return at | {"axes": at["axes"] + (axis,) * keep, "chain": at["chain"] + (axis,), "tests": at["tests"] + ((axis, test),)}

    def node(self, n: S.Spec, path: str, at: dict) -> None:
        below = lambda step: f"{path}/{step}" if path else step
        if isinstance(n, S.Count):
            self.ask(n, path, "Count", at, transform=n.transform)
        elif isinstance(n, S._Leaf):
            self.ask(n, path, n.kind, at, value=self.name(n.q, "number"))
        elif isinstance(n, S.Measured):
            self.ask(n, path, n.kind, at, value=self.name(n.q, "number"), custom=n)
        elif isinstance(n, S.Bag):
            self.ask(n, path, "Bag", at)
            how, slot = {"N": ("number", "double"), "S": ("category", "string")}.get(n.range, ("vector", "vector"))
            key = name = self.name(n.q, how)
            if how == "vector":
                size = int(n.range[1:])
                key = f"if(size({name}) = {size}, {name}, raise_error('a vector of {size} numbers is needed'))"
            axis = Axis(f"bag:{n.range}:{name}", slot, key)
            self.ask(n, below("values"), "Item", self.inside(at, axis, None, True))
        elif isinstance(n, S.Categorize):
            self.ask(n, path, n.kind, at)
            name = self.name(n.q, "category")
            self.node(n.value, below("bins"), self.inside(at, Axis(f"category:{name}", "string", name), None, True))
        elif isinstance(n, (S.Bin, S.SparselyBin, S.CentrallyBin, S.IrregularlyBin)):
            self.ask(n, path, n.kind, at)
            axis, flows = self.axis(n)
            for step, child in n.children():
                code = flows.get(step)
                self.node(child, below(step), self.inside(at, axis, code, code is None))
        elif isinstance(n, S.Select):
            self.ask(n, path, n.kind, at)
            self.node(n.cut, below("data"), self.chosen(n.q, at))
        elif isinstance(n, S.Fraction):
            self.ask(n, path, n.kind, at)
            self.node(n.value, below("numerator"), self.chosen(n.q, at))
            self.node(n.value, below("denominator"), at)
        elif isinstance(n, S._Collection):
            self.ask(n, path, n.kind, at)
            for step, child in n.children():
                self.node(child, below(step), at)
        elif hasattr(n, "expand"):
            self.node(n.expand(), path, at)
        else:
            raise TypeError(f"{type(n).__name__} cannot be lowered")

    def axis(self, n: S.Spec) -> tuple[Axis, dict[str, int]]:
        """The key of a binning, and the codes of its flows."""
        q = self.name(n.q, "number")
        key = f"CASE WHEN isnan({q}) THEN {NAN}L"
        if isinstance(n, S.Bin):
            low, high = _number(n.low), _number(n.high)
            place = f"greatest(least(floor(({q} - {low}) * {_number(n.num)} / {_number(n.high - n.low)}), {n.num - 1}L), 0L)"
            key += f" WHEN {q} < {low} THEN {UNDER}L WHEN {q} >= {high} THEN {OVER}L ELSE {place} END"
            return Axis(f"bin:{n.num}:{n.low}:{n.high}:{q}", "long", key, n.num), {"underflow": UNDER, "overflow": OVER, "nanflow": NAN}
        if isinstance(n, S.SparselyBin):
            # any whole number can be a bin, so NaN is the null key
            place = f"greatest(floor(({q} - {_number(n.origin)}) / {_number(n.bin_width)}), {_LOWEST}L)"
            return Axis(f"sparse:{n.bin_width}:{n.origin}:{q}", "long", f"CASE WHEN NOT isnan({q}) THEN {place} END"), {"nanflow": NAN}
        if isinstance(n, S.CentrallyBin):
            # the first midpoint above x is where the largest midpoint so far gets above it, in whatever order the centres are
            cuts = list(accumulate(((a + b) / 2 for a, b in zip(n.centers, n.centers[1:])), max))
            return Axis(f"central:{n.centers}:{q}", "long", f"{key} ELSE {self.rank(q, cuts)} END", len(n.centers)), {"nanflow": NAN}
        key += f" ELSE {self.rank(q, n.edges[1:])} END"
        return Axis(f"{n.kind}:{n.edges}:{q}", "long", key, len(n.edges), isinstance(n, S.Stack)), {"nanflow": NAN}

    def rank(self, q: str, cuts) -> str:
        """SQL for the number of cuts, which do not fall, that are at or below ``q``."""
        if len(cuts) <= FEW_CUTS:
            return "CASE" + "".join(f" WHEN {q} >= {_number(cuts[i - 1])} THEN {i}L" for i in range(len(cuts), 0, -1)) + " ELSE 0L END" if cuts else "0L"
        key = (q, tuple(cuts))
        if key not in self.searches:
            name = f"s{len(self.searches)}"
            finite = [c for c in cuts if not isinf(c)] or [0.0]
            low, slots = finite[0], 2 * len(cuts) if finite[0] < finite[-1] else 1
            scale = slots / (finite[-1] - low) if slots > 1 else 0.0
            slots, scale = (1, 0.0) if isinf(scale) or scale == 0 else (slots, scale)
            place = lambda c: slots - 1 if c == inf else 0 if c == -inf else min(max(floor((c - low) * scale), 0), slots - 1)
            places = [place(c) for c in cuts]
            starts = [bisect_left(places, i) for i in range(slots + 1)]
            at = f"int(greatest(least(floor(({q} - {_number(low)}) * {_number(scale)}), {slots - 1}L), 0L))" if slots > 1 else "0"
            directory, edges = f"CAST(split('{','.join(map(str, starts))}', ',') AS array<int>)", f"CAST(split('{','.join(map(_spelled, cuts))}', ',') AS array<double>)"
            steps = [(f"{name}_at", at), (f"{name}_end", f"get({directory}, {name}_at + 1)"), (f"{name}_0", f"get({directory}, {name}_at)")]
            now = f"{name}_0"
            for i in reversed(range(max(b - a for a, b in zip(starts, starts[1:])).bit_length())):
                steps.append((f"{name}_{len(steps)}", f"if({now} + {1 << i} <= {name}_end AND {q} >= get({edges}, {now} + {(1 << i) - 1}), {now} + {1 << i}, {now})"))
                now = steps[-1][0]
            self.searches[key] = steps
        return f"bigint({self.searches[key][-1][0]})"


def _spelled(x: float) -> str:
    return f"{'-' * (x < 0)}Infinity" if isinf(x) else repr(x)


def lower(df: DataFrame, spec: S.Spec, nulls: str = "nan", paths: list[str] | None = None) -> Plan:
    """The plan of a tree over the columns of ``df``. ``nulls``: "nan" takes a null quantity as
    missing, "zero" as 0. ``paths``: only nodes at or below these."""
    if nulls not in ("nan", "zero"):
        raise ValueError('nulls must be "nan" or "zero"')
    low = _Lowering(df, nulls, spec)
    low.node(spec, "", {"axes": (), "chain": (), "tests": (), "guard": None, "weight": None, "where": ()})
    requests = low.requests
    if paths is not None:
        requests = [r for r in requests if any(r.path == p or r.path.startswith(f"{p}/") or not p for p in paths)]
        if not requests:
            raise KeyError(f"the tree has nothing at {sorted(paths)}")
    every = {r.chain for r in requests}
    longest = [c for c in every if not any(d[: len(c)] == c and len(d) > len(c) for d in every)]
    longest.sort(key=lambda c: [a.id for a in c])
    steps = [[x for steps in low.searches.values() for x in steps[i : i + 1]] for i in range(max(map(len, low.searches.values()), default=0))]
    return Plan([c.alias(n) for n, c in low.base.items()], requests, longest, steps)


def measured_by_row(df: DataFrame, spec: S.Spec, nulls: str = "nan") -> DataFrame:
    """What each row of ``df`` adds to each node it reaches, for one aggregation by node: path, kind, keys, entries, sum, min, max and, of
    a Deviate, wx, w, x. For streams, where only one aggregation can follow; :func:`states` shuffles less and needs fewer rows."""
    plan = lower(df, spec, nulls)
    base = plan.project(df)
    axes = {a: f"a{i}" for i, a in enumerate(dict.fromkeys(a for r in plan.requests for a, _ in r.tests))}
    more = [f"CAST({a.key} AS {_SLOTS[a.slot]}) AS {n}" for a, n in axes.items()]
    changed = [r.transform(F.expr(r.weight or "1D")).cast("double").alias(f"t{i}") for i, r in enumerate(plan.requests) if _kind(r) == "Transformed"]
    base = base.select("*", *map(F.expr, more), *changed)
    each, extra = [], sorted({c for r in plan.requests for c in _own_parts(r)})
    for i, r in enumerate(plan.requests):
        w, x, kind = r.weight or "1D", r.value, _kind(r)
        product = x if r.weight is None else f"{w} * {x}"
        got = {"entries": w, **_own_parts(r), "sum": {"Transformed": f"t{i}", "Sum": product, "Average": product}.get(kind)}
        got |= {c: f"nullif({x}, double('NaN'))" if kind == k else None for c, k in (("min", "Minimize"), ("max", "Maximize"))}
        got |= dict(zip(("wx", "w", "x"), (product, w, x), strict=True)) if kind == "Deviate" else {}
        fields = ", ".join(f"CAST({got.get(c) or 'NULL'} AS double) AS {c}" for c in ("entries", "sum", "min", "max", "wx", "w", "x", *extra))
        keys = f"array({', '.join(_text(axes[a], a.slot) for a in r.axes)})" if r.axes else "CAST(array() AS array<string>)"
        ok = " AND ".join(filter(None, [r.guard, *_tests(r, axes)]))
        row = f"struct({_string(r.path)} AS path, {_string(kind)} AS kind, {keys} AS keys, {fields})"
        each.append(f"CASE WHEN {ok} THEN {row} END" if ok else row)
    return base.selectExpr(f"explode(array({', '.join(each)})) AS r").where("r IS NOT NULL").selectExpr("r.*")


def states_by_row(rows: DataFrame) -> DataFrame:
    """The rows of :func:`measured_by_row` as :func:`states`, by one aggregation."""
    sums = ["sum(entries) AS entries", "sum(sum) AS sum", "min(min) AS min", "max(max) AS max", "sum(wx) AS first", "double(count(wx)) AS rows", "covar_pop(wx, x) AS both", "covar_pop(w, x) AS mixed", "min(x) AS bottom", "max(x) AS top"]
    extra = _extra(rows.columns)
    sums += [f"{_how(c)}({c}) AS {c}" for c in extra]
    rows = rows.groupBy("path", "kind", "keys").agg(*map(F.expr, sums))
    mean = "CASE WHEN top = bottom THEN top ELSE first / nullif(entries, 0D) END AS mean"
    m2 = "CASE WHEN top = bottom THEN 0D ELSE greatest(rows * (both - first / nullif(entries, 0D) * mixed), 0D) END AS m2"
    return rows.selectExpr("path", "kind", "keys", "entries", "sum", mean, m2, "min", "max", *extra)


def _own_parts(r: Request) -> dict[str, str]:
    """What a row adds to the parts of a container of one's own, by column."""
    if r.custom is None:
        return {}
    names = r.custom.columns()
    return {names[part]: x for part, (_, x) in r.custom.parts(r.weight or "1D", r.value).items()}


def _extra(columns) -> list[str]:
    """The columns that hold parts of containers of one's own."""
    return [c for c in sorted(columns) if c.startswith("u_")]


def _how(column: str) -> str:
    return column.split("_")[1]


_SLOTS = {"long": "bigint", "double": "double", "string": "string", "vector": "array<double>"}


class _Group:
    """The aggregates of one chain, each of them asked for once. An input of "cov" is a pair."""

    def __init__(self, number: int, chain: tuple[Axis, ...]):
        self.number, self.chain = number, chain
        self.inputs: dict[str, dict] = {"sum": {}, "min": {}, "max": {}, "var": {}, "cov": {}}
        #: Axes by slot name, as k_long_0.
        self.keys: list[tuple[str, Axis]] = []
        used: dict[str, int] = {}
        for a in chain:
            used[a.slot] = used.get(a.slot, -1) + 1
            self.keys.append((f"k_{a.slot}_{used[a.slot]}", a))

    def slot(self, how: str, x) -> str:
        """The name of an aggregate."""
        return f"{how}_{self.inputs[how].setdefault(x, len(self.inputs[how]))}"


def _when(guard: str | None, x: str) -> str:
    return x if guard is None else f"CASE WHEN {guard} THEN {x} END"


def _measured(df: DataFrame, spec: S.Spec, nulls: str, paths: list[str] | None = None) -> tuple[DataFrame, list[Request], set[str]]:
    """What the rows of ``df`` add to each node, in parts that :func:`folded` adds up; the requests; the measures that these parts have."""
    plan = lower(df, spec, nulls, paths)
    base = plan.project(df)
    groups = [_Group(i, c) for i, c in enumerate(plan.chains)]
    changed = [(i, r) for i, r in enumerate(plan.requests) if r.kind == "Count" and r.transform is not None]
    if changed:
        base = base.select("*", *[r.transform(F.expr(r.weight or "1D")).cast("double").alias(f"t{i}") for i, r in changed])
    wanted = []
    for i, r in enumerate(plan.requests):
        g = next(g for g in groups if g.chain[: len(r.chain)] == r.chain)
        w, x = r.weight or "1D", r.value
        use = {"entries": g.slot("sum", _when(r.guard, w))}
        if r.kind == "Count" and r.transform is not None:
            use["sum"] = g.slot("sum", _when(r.guard, f"t{i}"))
        elif r.kind in ("Sum", "Average"):
            use["sum"] = g.slot("sum", _when(r.guard, x if r.weight is None else f"{w} * {x}"))
        elif r.kind in ("Minimize", "Maximize"):
            how = "min" if r.kind == "Minimize" else "max"
            use[how] = g.slot(how, _when(f"NOT isnan({x})" + (f" AND {r.guard}" if r.guard else ""), x))
        elif r.kind == "Deviate" and r.weight is None:
            use["var"] = g.slot("var", _when(r.guard, x))
        elif r.kind == "Deviate":
            x = _when(r.guard, x)
            use |= {"first": g.slot("sum", _when(r.guard, f"{w} * {r.value}")), "rows": g.slot("sum", _when(r.guard, "1D"))}
            use |= {"both": g.slot("cov", (_when(r.guard, f"{w} * {r.value}"), x)), "mixed": g.slot("cov", (_when(r.guard, w), x))}
        use |= {c: g.slot(_how(c), _when(r.guard, x)) for c, x in _own_parts(r).items()}
        wanted.append((r, g, use))

    small = _grouped(base, groups)
    own = {c for r, _, use in wanted for c in (*_MEASURES.get(_kind(r), ()), *_extra(use))}
    if len(groups) > FEW_CHAINS:
        return _looked_up(small, groups, wanted, own), plan.requests, own
    rows = ", ".join(_contribution(r, g, use, len(groups) > 1, own) for r, g, use in wanted)
    rows = small.selectExpr(f"explode(array({rows})) AS r").selectExpr("r.*").where("entries > 0")
    return rows, plan.requests, own


def _sums(own: set[str], over: str = "") -> tuple[list[str], list[str]]:
    """Aggregates of parts, and what follows from them: entries, and of sum, mean, m2, min and max those in ``own``."""
    named = {"entries": "sum(entries)"} | {c: f"sum({c})" for c in ("sum", "v2") if c in own} | {c: f"{c}({c})" for c in ("min", "max") if c in own}
    named |= {c: f"{_how(c)}({c})" for c in _extra(own)}
    out = ["entries"] + [c for c in ("sum", "min", "max") if c in own] + _extra(own)
    if "vn" in own:
        n, m = "CASE WHEN vn > 0D THEN vn END", "CASE WHEN vn > 0D THEN vm END"
        named |= {"vn": f"sum({n})", "first": f"sum({n} * {m})", "rows": f"count({n})", "both": f"covar_pop({n} * {m}, {m})", "mixed": f"covar_pop({n}, {m})", "top": f"max({m})", "bottom": f"min({m})"}
        gaps = "CASE WHEN top = bottom THEN 0D ELSE greatest(double(rows) * (both - first / vn * mixed), 0D) END"
        out += ["CASE WHEN top = bottom THEN top ELSE first / nullif(vn, 0D) END AS mean", f"v2 + {gaps} AS m2"]
    return [f"{x}{over} AS {c}" for c, x in named.items()], out


def folded(rows: DataFrame, own: set[str]) -> DataFrame:
    """Parts of nodes added up, to a row for each node: path, kind, keys, entries, and of sum, mean, m2, min and max those in ``own``.

    A part has ``vn``, ``vm`` and ``v2`` for weight, mean and sum of squared distances from the mean; parts are merged as weighted rows are."""
    sums, out = _sums(own)
    return rows.groupBy("path", "kind", "keys").agg(*map(F.expr, sums)).selectExpr("path", "kind", "keys", *out)


def parts(rows: DataFrame) -> DataFrame:
    """Rows that :func:`folded` gives, as parts again."""
    have = set(rows.columns)
    moments = ["CASE WHEN kind = 'Deviate' THEN entries END AS vn", "mean AS vm", "m2 AS v2"] if "m2" in have else []
    return rows.selectExpr("path", "kind", "keys", "entries", *[c for c in ("sum", "min", "max") if c in have], *moments, *_extra(have))


def stacked(rows: DataFrame, own: set[str], thresholds: list[tuple[str, int]]) -> DataFrame:
    """Folded rows in which bins of a Stack stand for all from their threshold up; ``thresholds`` are paths, and places in their keys.

    A running sum from the last bin down gives what each filled bin and those after it hold; that is the result of all thresholds
    after the filled bin before. So the work grows with the rows of the result, not with pairs of bins and thresholds.
    """
    group = "PARTITION BY path, kind, others ORDER BY slot DESC"
    sums, out = _sums(own, f" OVER ({group} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
    for place in sorted({i for _, i in thresholds}):
        # all rows take one way, so that the input is read once; a row that is under no threshold here is a group of its own
        here = f"path IN ({', '.join(sorted({_string(p) for p, i in thresholds if i == place}))})"
        others = f"CASE WHEN {here} THEN concat(slice(keys, 1, {place}), slice(keys, {place + 2}, 1000000)) ELSE keys END AS others"
        some = parts(rows).selectExpr("*", f"CASE WHEN {here} THEN bigint(get(keys, {place})) END AS slot", others)
        some = some.selectExpr("path", "kind", "others", "slot", f"lead(slot, 1, -1L) OVER ({group}) AS before", *sums)
        some = some.selectExpr("*", "explode(if(slot IS NULL, array(0L), sequence(before + 1L, slot))) AS i")
        keys = f"if(slot IS NULL, others, concat(slice(others, 1, {place}), array(string(i)), slice(others, {place + 1}, 1000000))) AS keys"
        rows = some.selectExpr("path", "kind", keys, *out)
    return rows


def finished(rows: DataFrame, own: set[str], more: tuple[str, ...] = (), custom: dict[str, S.Measured] | None = None) -> DataFrame:
    """Tidy rows of those that :func:`folded` gives, with further columns of theirs; ``custom``: containers of one's own by kind."""
    nan = "double('NaN')"
    out = {c: "double(NULL)" for c in ("sum", "mean", "variance", "min", "max")}
    entries = "entries"
    if "sum" in own:
        entries = "CASE WHEN kind = 'Transformed' THEN coalesce(sum, 0D) ELSE entries END"
        out["sum"] = "CASE WHEN kind = 'Sum' THEN coalesce(sum, 0D) END"
        out["mean"] = f"CASE WHEN kind = 'Average' THEN coalesce(sum / nullif(entries, 0D), {nan}) END"
    if "vn" in own:
        out["mean"] = f"CASE WHEN kind = 'Deviate' THEN coalesce(mean, {nan}) ELSE {out['mean']} END"
        out["variance"] = f"CASE WHEN kind = 'Deviate' THEN coalesce(m2 / nullif(entries, 0D), {nan}) END"
    for c, kind in (("min", "Minimize"), ("max", "Maximize")):
        if c in own:
            out[c] = f"CASE WHEN kind = '{kind}' THEN coalesce({c}, {nan}) END"
    if custom:
        results = {k: c.finish({**c.columns(), "entries": "entries"}) for k, c in custom.items()}
        maps = {k: ", ".join(f"{_string(n)}, coalesce(CAST({x} AS DOUBLE), {nan})" for n, x in r.items()) for k, r in results.items()}
        out["more"] = "CASE kind " + " ".join(f"WHEN {_string(k)} THEN map({m})" for k, m in maps.items()) + " END"
    return rows.selectExpr(*more, "path", "keys", f"{entries} AS entries", *[f"{x} AS {c}" for c, x in out.items()])


def tidy(df: DataFrame, spec: S.Spec, nulls: str = "nan", dense: bool = True, paths: list[str] | None = None) -> DataFrame:
    """The filled tree as rows (path, keys, entries, sum, mean, variance, min, max).

    ``path`` leads from the root to a node, as "data/values"; ``keys`` are the bins on the way, as
    strings. Columns that a node does not have are null. With ``dense``, bins known beforehand
    are there even if empty, where no sparse binning stands above them. With ``paths`` the nodes at or below these are the only ones that
    are computed, from the columns they need; where all of them are below selections, the input is filtered by these as it is read (so a selection
    must not be random, as it is evaluated again below).
    """
    rows, requests, own = _measured(df, spec, nulls, paths)
    nothing = ["0D AS entries", *[f"double(NULL) AS {c}" for c in sorted(own)]]
    for empty in empty_rows(df.sparkSession, [(r.path, _kind(r), tuple(a.size for a in r.axes)) for r in requests], dense, nothing):
        rows = rows.union(empty)
    thresholds = [(r.path, j) for r in requests for j, a in enumerate(r.axes) if a.cumulative]
    return finished(stacked(folded(rows, own), own, thresholds), own, custom={r.kind: r.custom for r in requests if r.custom is not None})


#: Every measure of a part.
MEASURES = frozenset({"sum", "vn", "vm", "v2", "min", "max"})


def states(df: DataFrame, spec: S.Spec, nulls: str = "nan") -> DataFrame:
    """The filled tree as rows that can be merged: path, kind, keys, entries, sum, mean, m2, min, max, where m2 is the weighted sum of squared
    distances from the mean. There are rows for nodes that something reached; those below a Stack are of its bins, not yet of all from a threshold up. See :class:`~grovetally.plans.tally.Tally`."""
    rows, _, own = _measured(df, spec, nulls)
    rows = folded(rows, own)
    have = set(rows.columns)
    return rows.selectExpr("path", "kind", "keys", "entries", *[c if c in have else f"double(NULL) AS {c}" for c in ("sum", "mean", "m2", "min", "max")], *_extra(have))


#: What a row of a kind adds to besides its entries.
_MEASURES = {
    "Transformed": ("sum",), "Sum": ("sum",), "Average": ("sum",), "Minimize": ("min",), "Maximize": ("max",), "Deviate": ("vn", "vm", "v2"),
}


def _kind(r: Request) -> str:
    return "Transformed" if r.kind == "Count" and r.transform is not None else r.kind


def _grouped(base: DataFrame, groups: list[_Group]) -> DataFrame:
    """One row for each chain and its keys, with all aggregates."""
    names = sorted({(n, a.slot) for g in groups for n, a in g.keys})
    most = {how: max(len(g.inputs[how]) for g in groups) for how in ("sum", "min", "max", "var", "cov")}

    def record(g: _Group) -> list[str]:
        own = dict(g.keys)
        fields = [f"{g.number} AS chain"] + [f"CAST({own[n].key if n in own else 'NULL'} AS {_SLOTS[slot]}) AS {n}" for n, slot in names]
        for how, n in most.items():
            given = list(g.inputs[how])
            for i in range(n):
                pair = (given[i] if how == "cov" else (given[i],)) if i < len(given) else ("NULL",) * (1 + (how == "cov"))
                fields += [f"CAST({x} AS double) AS x_{how}_{i}{'_' * j}" for j, x in enumerate(pair)]
        return fields

    shared = []
    if len(groups) > FEW_CHAINS:
        # a measure that is the same in all chains that have it stands outside the records
        for how in most:
            for i in range(most[how]):
                given = {list(g.inputs[how])[i] for g in groups if i < len(g.inputs[how])}
                if len(given) == 1:
                    x = given.pop()
                    shared += [(f"x_{how}_{i}{'_' * j}", y) for j, y in enumerate(x if how == "cov" else (x,))]
    outside = {n for n, _ in shared}

    def records_of(g: _Group) -> str:
        return f"struct({', '.join(x for x in record(g) if x.rpartition(' ')[2] not in outside)})"

    if len(groups) > 1:
        records = base.selectExpr(*[f"CAST({x} AS double) AS {n}" for n, x in shared], f"explode(array({', '.join(map(records_of, groups))})) AS r").selectExpr(*sorted(outside), "r.*")
    else:
        records = base.selectExpr(*record(groups[0]))
    aggs = ["1 AS one"] if not any(most.values()) else []
    for how, n in most.items():
        for i in range(n):
            x = f"x_{how}_{i}"
            if how == "var":
                aggs += [f"double(count({x})) AS var_{i}_n", f"avg({x}) AS var_{i}_m", f"var_pop({x}) AS var_{i}_v"]
            else:
                aggs.append(f"covar_pop({x}, {x}_) AS cov_{i}" if how == "cov" else f"{how}({x}) AS {how}_{i}")
    keys = (["chain"] if len(groups) > 1 else []) + [n for n, _ in names]
    return (records.groupBy(*keys) if keys else records.groupBy()).agg(*map(F.expr, aggs))


def _looked_up(small: DataFrame, groups: list[_Group], wanted: list[tuple[Request, _Group, dict[str, str]]], own: set[str]) -> DataFrame:
    """What the rows of the small table add to the nodes of their chains, as :func:`_contribution` spells it out, by a table of the nodes of each chain:
    where in the row their keys, conditions and measures stand."""
    slots = sorted({(n, a.slot) for g in groups for n, a in g.keys})
    place = {n: i for i, (n, _) in enumerate(slots)}
    most = {how: max(len(g.inputs[how]) for g in groups) for how in ("sum", "min", "max", "var", "cov")}
    extra = [c for c in sorted(own) if c.startswith("u_")]
    table: list[list[dict]] = [[] for _ in groups]
    for r, g, use in wanted:
        at = {a: place[n] for n, a in g.keys}
        tests = []
        for axis, code in r.tests:  # as in _tests; a bin that is not given is any one of 0 and above
            if axis.id.startswith("sparse:"):
                tests.append({"k": at[axis], "null": code == NAN})
            elif axis.slot == "long":
                tests.append({"k": at[axis], "code": code})
        node = {"path": r.path, "kind": _kind(r), "keys": [at[a] for a in r.axes], "tests": tests}
        table[g.number].append(node | {"x_" + c: int(name.rpartition("_")[2]) for c, name in use.items()})
    uses = ("entries", "sum", "min", "max", "var", "first", "rows", "both", "mixed", *extra)
    kind = f"array<array<struct<path:string,kind:string,keys:array<int>,tests:array<struct<k:int,code:bigint,null:boolean>>,{','.join(f'x_{c}:int' for c in uses)}>>>"
    texts = [_text(n, slot) for n, slot in slots]
    numbers = [n if slot == "long" else "NULL" for n, slot in slots]
    arrays = {"of_text": (texts, "string"), "of_key": (numbers, "bigint")}
    arrays |= {f"of_{how}": ([f"{how}_{i}" for i in range(most[how])], "double") for how in ("sum", "min", "max", "cov")}
    arrays |= {f"of_{c}": ([f"var_{i}_{c[1:]}" for i in range(most["var"])], "double") for c in ("vn", "vm", "vv")}
    rows = small.selectExpr(*[f"CAST(array({', '.join(xs)}) AS array<{t}>) AS {n}" for n, (xs, t) in arrays.items()], f"inline(get(from_json({_string(json.dumps(table))}, '{kind}'), chain))")
    ok = "forall(tests, t -> CASE WHEN t.null IS NOT NULL THEN t.null = (get(of_key, t.k) IS NULL) WHEN t.code IS NULL THEN get(of_key, t.k) >= 0L ELSE get(of_key, t.k) = t.code END)"
    entries, mean = "get(of_sum, x_entries)", "get(of_sum, x_first) / nullif(get(of_sum, x_entries), 0D)"
    rest = f"greatest(get(of_sum, x_rows) * (get(of_cov, x_both) - {mean} * get(of_cov, x_mixed)), 0D)"
    got = {c: f"get(of_{c}, x_{c})" for c in ("sum", "min", "max")} | {c: f"get(of_{_how(c)}, x_{c})" for c in extra}
    got["vn"] = f"CASE WHEN x_var IS NOT NULL THEN get(of_vn, x_var) WHEN x_both IS NOT NULL THEN {entries} END"
    got["vm"] = f"CASE WHEN x_var IS NOT NULL THEN get(of_vm, x_var) WHEN x_both IS NOT NULL THEN {mean} END"
    got["v2"] = f"CASE WHEN x_var IS NOT NULL THEN get(of_vv, x_var) * get(of_vn, x_var) WHEN x_both IS NOT NULL THEN {rest} END"
    rows = rows.where(ok).where(f"{entries} > 0D")
    return rows.selectExpr("path", "kind", "transform(keys, k -> get(of_text, k)) AS keys", f"{entries} AS entries", *[f"{got[c]} AS {c}" for c in sorted(own)])


def _tests(r: Request, column: dict[Axis, str]) -> list[str]:
    """The conditions on bins under which a row counts for a request."""
    ok = []
    for axis, code in r.tests:
        k = column[axis]
        if axis.id.startswith("sparse:"):
            ok.append(f"{k} IS NULL" if code == NAN else f"{k} IS NOT NULL")
        elif axis.slot == "long":
            ok.append(f"{k} = {code}L" if code is not None else f"{k} >= 0L")
    return ok


def _contribution(r: Request, g: _Group, use: dict[str, str], many: bool, own: set[str]) -> str:
    """The result row that a row of the small table adds to, of 0 entries if there is none. Below a threshold it is that of its bin alone."""
    slot = {a: n for n, a in g.keys}
    ok = [f"chain = {g.number}"] * many + _tests(r, slot)
    got = {c: "double(NULL)" for c in own}
    for c in ("sum", "min", "max", *_extra(use)):
        if c in use:
            got[c] = use[c]
    if "var" in use:
        v = use["var"]
        got |= {"vn": f"{v}_n", "vm": f"{v}_m", "v2": f"{v}_v * {v}_n"}
    elif "both" in use:
        n, mean = use["entries"], f"{use['first']} / nullif({use['entries']}, 0D)"
        got |= {"vn": n, "vm": mean, "v2": f"greatest({use['rows']} * ({use['both']} - {mean} * {use['mixed']}), 0D)"}
    entries = f"coalesce({use['entries']}, 0D)"
    entries = f"CASE WHEN {' AND '.join(ok)} THEN {entries} ELSE 0D END" if ok else entries
    keys = f"array({', '.join(_text(slot[a], a.slot) for a in r.axes)})" if r.axes else "CAST(array() AS array<string>)"
    more = "".join(f", {got[c]} AS {c}" for c in sorted(own))
    return f"struct({_string(r.path)} AS path, {_string(_kind(r))} AS kind, {keys} AS keys, {entries} AS entries{more})"


def _text(k: str, slot: str) -> str:
    """A key as text; -0.0 is 0.0, as it is for grouping."""
    return f"to_json(transform({k}, x -> x + 0D))" if slot == "vector" else f"string({k} + 0D)" if slot == "double" else f"string({k})"


def empty_rows(spark: SparkSession, nodes: list[tuple[str, str, tuple]], dense: bool, zero: list[str]):
    """Rows of 0 entries for what is there even without data; ``nodes`` are (path, kind, numbers of bins above). Bins of a large grid are made by several tasks."""
    by: dict[tuple, list[dict]] = {}
    for path, kind, sizes in nodes:
        if not sizes or (dense and None not in sizes):
            by.setdefault(sizes, []).append({"path": path, "kind": kind})
    few = {sizes: paths for sizes, paths in by.items() if len(by) > FEW_CHAINS and prod(sizes) <= _SMALL}
    if few:  # many small grids make one table
        grids = json.dumps([{"sizes": sizes, "below": [prod(sizes[j + 1 :]) for j in range(len(sizes))], "n": prod(sizes), "paths": paths} for sizes, paths in few.items()])
        kind = "array<struct<sizes:array<bigint>,below:array<bigint>,n:bigint,paths:array<struct<path:string,kind:string>>>>"
        rows = spark.range(0, len(few), 1, -(-sum(map(prod, few)) // _EMPTY)).selectExpr(f"get(from_json({_string(grids)}, '{kind}'), int(id)) AS g")
        rows = rows.selectExpr("g", "explode(sequence(0L, g.n - 1L)) AS id").selectExpr("g", "id", "inline(g.paths)")
        yield rows.selectExpr("path", "kind", "transform(g.sizes, (n, j) -> string(id div get(g.below, j) % n)) AS keys", *zero)
    for sizes, paths in by.items():
        if sizes in few:
            continue
        paths = [f"struct({_string(n['path'])}, {_string(n['kind'])})" for n in paths]
        keys = ", ".join(f"string(id div {prod(sizes[j + 1 :])}L % {n}L)" for j, n in enumerate(sizes))
        rows = spark.range(0, prod(sizes), 1, -(-prod(sizes) // _EMPTY)).selectExpr("id", f"inline(array({', '.join(paths)})) AS (path, kind)")
        yield rows.selectExpr("path", "kind", f"CAST(array({keys}) AS array<string>) AS keys", *zero)
