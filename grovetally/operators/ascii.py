"""Results as text for a terminal."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from . import results as R
from .views import FractionedHistogramView, HistogramView, ProfileErrView, ProfileView, wald_interval


def digits(x: float, n: int) -> str:
    """Rounded to n significant digits."""
    if math.isnan(x):
        return "nan"
    if math.isinf(x):
        return "inf" if x > 0 else "-inf"
    return f"{x:.{n}g}"


@dataclass
class _Line:
    label: str
    value: float
    marks: dict[int, str]
    fill: tuple[int, int] | None = None


class _Canvas:
    """Labelled lines over one horizontal axis from ``low`` to ``high``."""

    def __init__(self, low: float, high: float, width: int, labels: list[str], values: list[float]):
        if not low < high:
            low, high = low - 0.5, high + 0.5
        self.low, self.high = low, high
        self.labels = max(len(x) for x in labels)
        self.numbers = max([2, *(len(digits(v, 4)) for v in values)])
        self.width = max(10, width - self.labels - self.numbers - 4)
        self.lines: list[str] = []

    def place(self, x: float) -> int | None:
        """The column of x; None outside of the axis or for NaN."""
        if math.isnan(x):
            return None
        if math.isinf(x):
            return self.width if x > 0 else 0
        i = round(self.width * (x - self.low) / (self.high - self.low))
        return i if 0 <= i <= self.width else None

    def line(self, label: str, value: float, marks: list[tuple[float, str]], bar: float | None = None, between: tuple[float, float] | None = None) -> None:
        cells = [" "] * (self.width + 1)
        zero = self.place(0.0)
        if bar is not None and (end := self.place(bar)) is not None:
            a, b = sorted((zero or 0, end))
            cells[a:b] = "*" * (b - a)
        if between is not None:
            a, b = (min(max(self.place(x) if self.place(x) is not None else (0 if x < self.low else self.width), 0), self.width) for x in between)
            cells[a : b + 1] = "-" * (b + 1 - a)
        if zero is not None:
            cells[zero] = "|"
        for x, c in marks:
            if (i := self.place(x)) is not None:
                cells[i] = c
        self.lines.append(f"{label:<{self.labels}} {digits(value, 4):<{self.numbers}} |{''.join(cells)}|")

    def text(self) -> str:
        pad = " " * (self.labels + self.numbers + 2)
        rule = ["-"] * (self.width + 1)
        if (zero := self.place(0.0)) is not None:
            rule[zero] = "+"
        low, high = f"{self.low:g}", f"{self.high:g}"
        head = f"{pad}{low}{' ' * max(1, self.width + 3 - len(low) - len(high))}{high}"
        edge = f"{pad}+{''.join(rule)}+"
        return "\n".join([head, edge, *self.lines, edge])


def _labels(b: R.Binned) -> list[str]:
    edges = [tuple(digits(x, 3) for x in b.range(i)) for i in b.bins]
    wide = max(len(x) for e in edges for x in e)
    return [f"[{a:>{wide}}, {z:>{wide}})" for a, z in edges]


def _headroom(values: list[float], zero: bool = False) -> tuple[float, float]:
    finite = [v for v in values if math.isfinite(v)] or [0.0]
    low, high = min(finite), max(finite)
    if zero:
        low, high = min(low, 0.0), max(high, 0.0)
    extra = 0.1 * (high - low)
    return (low if zero and low == 0.0 else low - extra), high + extra


def histogram(r: R.Result, width: int = 80) -> str:
    view = HistogramView(r)
    b, values = view.binned, view.numerical_values
    flows = [("underflow", b.underflow.entries), ("overflow", b.overflow.entries), ("nanflow", b.nanflow.entries)]
    labels = _labels(b)
    c = _Canvas(*_headroom(values + [v for _, v in flows], True), width, [*labels, "underflow"], values + [v for _, v in flows])
    c.line(*flows[0], [], bar=flows[0][1])
    for label, v in zip(labels, values, strict=True):
        c.line(label, v, [], bar=v)
    for label, v in flows[1:]:
        c.line(label, v, [], bar=v)
    return c.text()


def profile(r: R.Result, width: int = 80) -> str:
    view = ProfileView(r)
    labels, means = _labels(view.binned), view.mean_values
    c = _Canvas(*_headroom(means), width, labels, means)
    for label, m in zip(labels, means, strict=True):
        c.line(label, m, [(m, "+")])
    return c.text()


def profile_err(r: R.Result, width: int = 80) -> str:
    view = ProfileErrView(r)
    labels, means, errors = _labels(view.binned), view.mean_values, view.error_values
    ends = [(m - e, m + e) for m, e in zip(means, errors, strict=True)]
    c = _Canvas(*_headroom([x for e in ends for x in e] + means), width, labels, means)
    for label, m, (a, z) in zip(labels, means, ends, strict=True):
        if math.isfinite(a) and math.isfinite(z):
            c.line(label, m, [(a, "|"), (z, "|"), (m, "+")], between=(a, z))
        else:
            c.line(label, m, [(m, "+")])
    return c.text()


def efficiency(r: R.Fractioned, width: int = 80, interval: Callable[[float, float, float], float] = wald_interval, z: float = 1.0) -> str:
    view = FractionedHistogramView(r)
    labels, values = _labels(view.denominator), view.numerical_values
    flows = ("underflow", "overflow", "nanflow")
    flow_values = [getattr(view, f"numerical_{f}") for f in flows]
    c = _Canvas(-0.1, 1.1, width, [*labels, "underflow"], values + flow_values)
    rows = list(zip(labels, values, view.confidence_interval_values(interval, z), strict=True))
    extra = [(f, v, view.confidence_interval_flow(f, interval, z)) for f, v in zip(flows, flow_values, strict=True)]
    for label, v, (a, _, b) in [extra[0], *rows, *extra[1:]]:
        if math.isfinite(a) and math.isfinite(b):
            c.line(label, v, [(a, "|"), (b, "|"), (v, "+")], between=(a, b))
        else:
            c.line(label, v, [])
    return c.text()


def collection(r: R.Collection, index_width: int = 40, width: int = 80) -> str:
    """A line for each container of a collection: its path and what it is."""

    def show(path, leaf):
        where, row = [], "("
        for i, step in enumerate(map(repr, path)):
            if len(row) + len(step) + 1 > index_width:
                where.append(row)
                row = "    "
            row += step + (", " if i < len(path) - 1 else "")
        where = "\n".join([*where, row + ")"])
        what, room = f"<{leaf.kind} entries={leaf.entries:g}>", max(4, width - index_width)
        return f"{where} -> {what if len(what) <= room else what[: room - 3] + '...'}"

    return "\n".join(r.walk(show))


def ascii(r: R.Result, width: int = 80) -> str:
    """The text of a result by its shape."""
    if isinstance(r, R.Collection):
        return collection(r, width=width)
    if isinstance(r, R.Fractioned):
        return efficiency(r, width)
    b = HistogramView(r)
    inner = b.result.cut if isinstance(r, R.Selected) else r
    inside = list(inner.values) if isinstance(inner, R.Binned) else list(inner.bins.values()) or [inner.content] if isinstance(inner, R.SparselyBinned) else []
    if inside and all(isinstance(v, R.Deviated) for v in inside):
        return profile_err(r, width)
    if inside and all(isinstance(v, R.Averaged) for v in inside):
        return profile(r, width)
    return histogram(r, width)
