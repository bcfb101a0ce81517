"""Ways to look at results of a known shape: histograms, profiles, efficiencies and so on.

Each view takes the bare binning or one inside a Select, dense or sparse; sparse ones are filled
up from their first to their last bin.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from . import results as R


class ShapeError(TypeError):
    """The result is not of the shape that the view needs."""


def equal_bins(r: R.Result) -> R.Binned:
    """The equal bins of a result, without Select and made dense."""
    if isinstance(r, R.Selected):
        r = r.cut
    if isinstance(r, R.SparselyBinned):
        r = r.dense()
    if not isinstance(r, R.Binned):
        raise ShapeError(f"bins of equal width are needed, not {r.kind}")
    return r


def _holding(r: R.Result, *kinds: type) -> R.Binned:
    b = equal_bins(r)
    if not all(isinstance(v, kinds) for v in b.values):
        raise ShapeError(f"the bins must hold {' or '.join(k.__name__ for k in kinds)}")
    return b


@dataclass(frozen=True)
class _View:
    result: R.Result
    needs = (R.Result,)

    @property
    def binned(self) -> R.Binned:
        return _holding(self.result, *self.needs)

    @property
    def numerical_underflow(self) -> float:
        return self.binned.underflow.entries

    @property
    def numerical_overflow(self) -> float:
        return self.binned.overflow.entries

    @property
    def numerical_nanflow(self) -> float:
        return self.binned.nanflow.entries

    @property
    def edges(self) -> list[float]:
        b = self.binned
        return [b.range(i)[0] for i in b.bins] + [b.high]


class HistogramView(_View):
    needs = (R.Counted,)

    @property
    def numerical_values(self) -> list[float]:
        return [v.entries for v in self.binned.values]

    def confidence_interval_values(self, z: float = 1.0) -> list[float]:
        """z standard deviations of each count."""
        return [z * math.sqrt(v) for v in self.numerical_values]


class ProfileView(_View):
    needs = (R.Averaged, R.Deviated)

    @property
    def mean_values(self) -> list[float]:
        return [v.mean for v in self.binned.values]


class ProfileErrView(ProfileView):
    needs = (R.Deviated,)

    @property
    def variance_values(self) -> list[float]:
        return [v.variance for v in self.binned.values]

    @property
    def error_values(self) -> list[float]:
        """Standard errors of the means."""
        return [math.sqrt(v.variance / v.entries) if v.entries > 0 else math.nan for v in self.binned.values]


class _LayeredView:
    def __init__(self, result: R.IrregularlyBinned):
        if not isinstance(result, R.IrregularlyBinned):
            raise ShapeError(f"layers are needed, not {result.kind}")
        self.result = result
        self.layers = [HistogramView(v) for v in result.values]
        shapes = {(b.low, b.high, b.num) for b in (v.binned for v in self.layers)}
        if len(shapes) > 1:
            raise ShapeError(f"the layers are binned in different ways: {sorted(shapes)}")
        ((self.low, self.high, self.num),) = shapes


class StackedHistogramView(_LayeredView):
    """Layers of a Stack of histograms, which must share their bins."""


class PartitionedHistogramView(_LayeredView):
    """Parts of an IrregularlyBin of histograms, which must share their bins."""


class FractionedHistogramView:
    """A Fraction of histograms: passing over all, bin by bin."""

    def __init__(self, result: R.Fractioned):
        if not isinstance(result, R.Fractioned):
            raise ShapeError(f"a Fraction is needed, not {result.kind}")
        self.result = result
        self.numerator, self.denominator = HistogramView(result.numerator).binned, HistogramView(result.denominator).binned
        n, d = self.numerator, self.denominator
        if not isinstance(result.denominator, R.SparselyBinned) and (n.low, n.high, n.num) != (d.low, d.high, d.num):
            raise ShapeError("numerator and denominator are binned in different ways")

    @staticmethod
    def _ratio(n: float, d: float) -> float:
        return n / d if d else math.nan

    @property
    def _pairs(self):
        return [(n.entries, d.entries) for n, d in zip(self.numerator.values, self.denominator.values, strict=True)]

    @property
    def numerical_values(self) -> list[float]:
        return [self._ratio(n, d) for n, d in self._pairs]

    def _flow(self, name: str) -> tuple[float, float]:
        return getattr(self.numerator, name).entries, getattr(self.denominator, name).entries

    @property
    def numerical_underflow(self) -> float:
        return self._ratio(*self._flow("underflow"))

    @property
    def numerical_overflow(self) -> float:
        return self._ratio(*self._flow("overflow"))

    @property
    def numerical_nanflow(self) -> float:
        return self._ratio(*self._flow("nanflow"))

    def confidence_interval_values(self, interval: Callable[[float, float, float], float], z: float = 1.0) -> list[tuple[float, float, float]]:
        """``interval(n, d, z)`` of each bin at -z, 0 and z."""
        return [tuple(interval(n, d, x) for x in (-z, 0.0, z)) for n, d in self._pairs]

    def confidence_interval_flow(self, flow: str, interval: Callable[[float, float, float], float], z: float = 1.0) -> tuple[float, float, float]:
        n, d = self._flow(flow)
        return tuple(interval(n, d, x) for x in (-z, 0.0, z))


class TwoDimensionalView:
    """Bins of bins of counts."""

    def __init__(self, result: R.Result):
        self.binned = equal_bins(result)
        rows = list(self.binned.values)
        if all(isinstance(v, R.SparselyBinned) for v in rows):
            filled = [v for v in rows if v.bins]
            low = min((v.min_bin for v in filled), default=0)
            high = max((v.max_bin for v in filled), default=-1)
            self._rows = [[v.bins[i].entries if i in v.bins else 0.0 for i in range(low, high + 1)] for v in rows]
            self._inner = [v.dense() for v in rows]
        else:
            self._inner = [_holding(v, R.Counted) for v in rows]
            self._rows = [[c.entries for c in v.values] for v in self._inner]

    @property
    def numerical_values(self) -> list[list[float]]:
        """By the first quantity, then the second."""
        return self._rows

    @property
    def numerical_overflow(self) -> float:
        """All that lies outside in either direction."""
        return self.binned.underflow.entries + self.binned.overflow.entries + sum(v.underflow.entries + v.overflow.entries for v in self._inner)

    @property
    def numerical_nanflow(self) -> float:
        return self.binned.nanflow.entries + sum(v.nanflow.entries for v in self._inner)


def wald_interval(n: float, d: float, z: float) -> float:
    """Normal approximation of a binomial proportion."""
    if not d:
        return math.nan
    p = n / d
    return p + z * math.sqrt(max(p * (1 - p), 0.0) / d)


def wilson_interval(n: float, d: float, z: float) -> float:
    """Wilson's score interval of a binomial proportion; z = 0 gives its centre n / d."""
    if not d:
        return math.nan
    p, zz = n / d, z * z
    return (p + zz / (2 * d) + z * math.sqrt(max(p * (1 - p), 0.0) / d + zz / (4 * d * d))) / (1 + zz / d)


def plot_points(r: R.Result, interval: Callable[[float, float, float], float] | None = None) -> list[dict[str, float]]:
    """What a plotting library needs of a histogram, profile or efficiency: for each bin its edges,
    centre, value and error (None where the shape has none)."""
    if isinstance(r, R.Fractioned):
        view = FractionedHistogramView(r)
        b, values = view.denominator, view.numerical_values
        errors = [None if interval is None else (hi - lo) / 2 for lo, _, hi in view.confidence_interval_values(interval or wald_interval)]
    else:
        b = equal_bins(r)
        if all(isinstance(v, R.Counted) for v in b.values):
            values, errors = [v.entries for v in b.values], [math.sqrt(v.entries) for v in b.values]
        elif all(isinstance(v, R.Deviated) for v in b.values):
            values, errors = [v.mean for v in b.values], ProfileErrView(r).error_values
        else:
            values, errors = ProfileView(r).mean_values, [None] * b.num
    out = []
    for i in b.bins:
        low, high = b.range(i)
        out.append({"low": low, "high": high, "center": (low + high) / 2, "value": values[i], "error": errors[i]})
    return out


def save_html(r: R.Result, path: str, title: str = "", x_label: str = "", y_label: str = "") -> None:
    """A page with a drawing of a histogram, profile or stack, which needs no plotting library."""
    import html
    from pathlib import Path

    layers = [plot_points(v) for v in r.values] if isinstance(r, R.IrregularlyBinned) else [plot_points(r)]
    every = [p for layer in layers for p in layer]
    finite = [p["value"] for p in every if math.isfinite(p["value"])]
    low, high = min([0.0, *finite]), max([0.0, *finite]) or 1.0
    x0, x1 = every[0]["low"], every[-1]["high"]
    px = lambda x: 60 + 560 * (x - x0) / (x1 - x0)
    py = lambda y: 360 - 320 * (y - low) / ((high - low) or 1.0)
    shapes = []
    for k, layer in enumerate(layers):
        hue = 210 + 47 * k
        for p in layer:
            if math.isfinite(p["value"]):
                top, base = sorted((py(p["value"]), py(0.0)))
                shapes.append(f'<rect x="{px(p["low"]):.1f}" y="{top:.1f}" width="{px(p["high"]) - px(p["low"]):.1f}" height="{base - top:.1f}" fill="hsl({hue},60%,60%)"/>')
    axis = f'<path d="M60 40V360H620" fill="none" stroke="black"/><text x="60" y="380">{x0:g}</text><text x="590" y="380">{x1:g}</text><text x="4" y="{py(high):.0f}">{high:g}</text>'
    labels = f'<text x="300" y="396">{html.escape(x_label)}</text><text x="4" y="30">{html.escape(y_label)}</text><text x="300" y="20">{html.escape(title)}</text>'
    Path(path).write_text(f'<!DOCTYPE html><meta charset="utf-8"><title>{html.escape(title)}</title><svg width="640" height="400">{"".join(shapes)}{axis}{labels}</svg>', encoding="utf-8")
