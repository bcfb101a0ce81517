"""Filled trees: immutable, can be added, scaled, compared, walked and written as JSON."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, fields, replace
from typing import ClassVar

NAN = float("nan")


def same(x: float, y: float, rel: float = 0.0, abs_: float = 0.0) -> bool:
    """Equality in which NaN equals NaN and infinities equal those of their sign."""
    if math.isnan(x) or math.isnan(y):
        return math.isnan(x) and math.isnan(y)
    if math.isinf(x) or math.isinf(y):
        return x == y
    return x == y or abs(x - y) <= max(rel * max(abs(x), abs(y)), abs_)


class MergeError(ValueError):
    """Two results differ in structure, so they cannot be added."""


def _agree(what: str, a, b) -> None:
    if a != b and not (isinstance(a, float) and isinstance(b, float) and math.isnan(a) and math.isnan(b)):
        raise MergeError(f"{what} differs: {a!r} and {b!r}")


@dataclass(frozen=True, eq=False)
class Result:
    """A node. ``entries`` is the sum of all weights that reached it."""

    entries: float
    name: str | None = field(default=None, kw_only=True)

    #: Type name in JSON; fields that must agree for a sum; fields that add up.
    kind = ""
    fixed: ClassVar[tuple[str, ...]] = ()

    def __post_init__(self):
        if self.entries < 0:
            raise ValueError("entries cannot be negative")

    # children by step
    def children(self) -> list[tuple[str | int | float, Result]]:
        return []

    def _rebuild(self, change: Callable[[Result], Result], other: Result | None = None) -> dict:
        """New values of the fields that hold children, after ``change`` or added to ``other``'s."""
        return {}

    def _check(self, other: Result) -> None:
        if type(self) is not type(other):
            raise MergeError(f"cannot add {self.kind} and {getattr(other, 'kind', type(other).__name__)}")
        _agree("the name", self.name, other.name)
        for f in self.fixed:
            _agree(f, getattr(self, f), getattr(other, f))

    def _plus(self, other: Result) -> dict:
        return {}

    def _times(self, factor: float) -> dict:
        return {}

    def zero(self) -> Result:
        return replace(self, entries=0.0, **self._nothing(), **self._rebuild(lambda c: c.zero()))

    def _nothing(self) -> dict:
        return {}

    def __add__(self, other: Result) -> Result:
        self._check(other)
        return replace(self, entries=self.entries + other.entries, **self._plus(other), **self._rebuild(None, other))

    def __mul__(self, factor: float) -> Result:
        if math.isnan(factor) or factor <= 0:
            return self.zero()
        return replace(self, entries=self.entries * factor, **self._times(factor), **self._rebuild(lambda c: c * factor))

    __rmul__ = __mul__

    def copy(self) -> Result:
        return self + self.zero()

    def equals(self, other: object, rel: float = 0.0, abs_: float = 0.0) -> bool:
        """Equality within a relative and an absolute tolerance."""
        if type(self) is not type(other) or self.name != other.name:
            return False
        for f in fields(self):
            if f.name == "name":
                continue
            if not _alike(getattr(self, f.name), getattr(other, f.name), rel, abs_):
                return False
        return True

    def __eq__(self, other: object) -> bool:
        return self.equals(other)

    __hash__ = None

    def at(self, *path) -> Result:
        """The node below some steps, as ``at("values", 3)`` or ``at("i1", "data")``."""
        node = self
        for step in path:
            found = dict(node.children())
            if step not in found and isinstance(step, int) and f"i{step}" in found:
                step = f"i{step}"
            if step not in found:
                raise KeyError(f"{node.kind} has nothing at {step!r}")
            node = found[step]
        return node

    def walk(self, f: Callable[[tuple, Result], object]) -> Iterator:
        """``f(path, leaf)`` for each container below the collections at the top."""
        def go(path, node):
            if isinstance(node, Collection):
                for step, c in node.children():
                    yield from go((*path, step), c)
            else:
                yield f(path, node)

        return go((), self)

    def indexes(self) -> list[tuple]:
        """Paths of all containers below the collections at the top."""
        return list(self.walk(lambda path, _: path))


def _alike(a, b, rel, abs_) -> bool:
    if isinstance(a, Result):
        return a.equals(b, rel, abs_)
    if isinstance(a, float):
        return isinstance(b, float) and same(a, b, rel, abs_)
    if isinstance(a, dict):
        return isinstance(b, dict) and _keyed(a).keys() == _keyed(b).keys() and all(_alike(v, _keyed(b)[k], rel, abs_) for k, v in _keyed(a).items())
    if isinstance(a, (list, tuple)):
        return isinstance(b, (list, tuple)) and len(a) == len(b) and all(_alike(x, y, rel, abs_) for x, y in zip(a, b, strict=True))
    return a == b


def _keyed(d: dict) -> dict:
    """With NaN keys that are equal."""
    put = lambda k: "nan" if isinstance(k, float) and math.isnan(k) else tuple(map(put, k)) if isinstance(k, tuple) else k
    return {put(k): v for k, v in d.items()}


@dataclass(frozen=True, eq=False)
class Counted(Result):
    kind = "Count"


@dataclass(frozen=True, eq=False)
class Summed(Result):
    sum: float = 0.0
    kind = "Sum"

    def _plus(self, other):
        return {"sum": self.sum + other.sum}

    def _times(self, factor):
        return {"sum": self.sum * factor}

    def _nothing(self):
        return {"sum": 0.0}


def _mean(na: float, a: float, nb: float, b: float) -> float:
    return b if na == 0 else a if nb == 0 else (na * a + nb * b) / (na + nb)


@dataclass(frozen=True, eq=False)
class Averaged(Result):
    mean: float = NAN
    kind = "Average"

    def _plus(self, other):
        return {"mean": _mean(self.entries, self.mean, other.entries, other.mean)}

    def _nothing(self):
        return {"mean": NAN}


@dataclass(frozen=True, eq=False)
class Deviated(Result):
    mean: float = NAN
    variance: float = NAN
    kind = "Deviate"

    def _plus(self, other):
        na, nb = self.entries, other.entries
        mean = _mean(na, self.mean, nb, other.mean)
        if na == 0 or nb == 0:
            return {"mean": mean, "variance": other.variance if na == 0 else self.variance}
        spread = na * self.variance + nb * other.variance + (other.mean - self.mean) ** 2 * na * nb / (na + nb)
        return {"mean": mean, "variance": spread / (na + nb)}

    def _nothing(self):
        return {"mean": NAN, "variance": NAN}


def _best(choose, a: float, b: float) -> float:
    return b if math.isnan(a) else a if math.isnan(b) else choose(a, b)


@dataclass(frozen=True, eq=False)
class Minimized(Result):
    min: float = NAN
    kind = "Minimize"

    def _plus(self, other):
        return {"min": _best(min, self.min, other.min)}

    def _nothing(self):
        return {"min": NAN}


@dataclass(frozen=True, eq=False)
class Maximized(Result):
    max: float = NAN
    kind = "Maximize"

    def _plus(self, other):
        return {"max": _best(max, self.max, other.max)}

    def _nothing(self):
        return {"max": NAN}


@dataclass(frozen=True, eq=False)
class Bagged(Result):
    values: dict = field(default_factory=dict)
    range: str = "N"
    kind = "Bag"
    fixed = ("range",)

    def _plus(self, other):
        out, names = dict(self.values), {k: j for k, j in zip(_keyed(self.values), self.values, strict=True)}
        for key, (value, w) in zip(_keyed(other.values), other.values.items(), strict=True):
            own = names.get(key, value)
            out[own] = out.get(own, 0.0) + w
        return {"values": out}

    def _times(self, factor):
        return {"values": {k: w * factor for k, w in self.values.items()}}

    def _nothing(self):
        return {"values": {}}


class _Grown(Result):
    """Nodes whose children are in fields: single ones, lists, pairs or dicts."""

    single: tuple[str, ...] = ()
    many: str | None = None

    def children(self):
        out = []
        if self.many:
            x = getattr(self, self.many)
            out += list(x.items()) if isinstance(x, dict) else list(enumerate(x)) if not x or isinstance(x[0], Result) else [(k, v) for k, v in x]
        return out + [(s, getattr(self, s)) for s in self.single]

    def _rebuild(self, change, other=None):
        join = (lambda a, b: a + b) if other is not None else (lambda a, b: change(a))
        out = {s: join(getattr(self, s), getattr(other, s, None)) for s in self.single}
        if self.many:
            a, b = getattr(self, self.many), getattr(other, self.many, None)
            if isinstance(a, dict):
                out[self.many] = {k: join(v, b[k]) if other is None or k in b else v for k, v in a.items()} if other is not None else {k: change(v) for k, v in a.items()}
                if other is not None:
                    out[self.many] |= {k: v for k, v in b.items() if k not in a}
            elif a and not isinstance(a[0], Result):
                if other is not None and (len(a) != len(b) or not all(same(x, y) for (x, _), (y, _) in zip(a, b))):
                    raise MergeError(f"{self.kind}: the keys differ")
                out[self.many] = tuple((k, join(v, b[i][1] if b else None)) for i, (k, v) in enumerate(a))
            else:
                if other is not None and len(a) != len(b):
                    raise MergeError(f"{self.kind}: the sizes differ")
                out[self.many] = tuple(join(v, b[i] if b else None) for i, v in enumerate(a))
        return out


@dataclass(frozen=True, eq=False)
class Binned(_Grown):
    low: float = 0.0
    high: float = 1.0
    values: tuple = ()
    underflow: Result = None
    overflow: Result = None
    nanflow: Result = None
    kind, fixed, many, single = "Bin", ("low", "high"), "values", ("underflow", "overflow", "nanflow")

    @property
    def num(self) -> int:
        return len(self.values)

    def index(self, x: float) -> int:
        """The bin of x, -1 if it is in none."""
        if math.isnan(x) or x < self.low or x >= self.high:
            return -1
        return min(int(math.floor(self.num * (x - self.low) / (self.high - self.low))), self.num - 1)

    def under(self, x: float) -> bool:
        return x < self.low

    def over(self, x: float) -> bool:
        return x >= self.high

    def nan(self, x: float) -> bool:
        return math.isnan(x)

    @property
    def bins(self) -> range:
        return range(self.num)

    def range(self, i: int) -> tuple[float, float]:
        """Edges of bin i."""
        width = self.high - self.low
        return (width * i / self.num + self.low, width * (i + 1) / self.num + self.low)


@dataclass(frozen=True, eq=False)
class SparselyBinned(_Grown):
    bin_width: float = 1.0
    bins: dict = field(default_factory=dict)
    nanflow: Result = None
    origin: float = 0.0
    content: Result = None
    kind, fixed, many, single = "SparselyBin", ("bin_width", "origin"), "bins", ("nanflow",)

    def _nothing(self):
        return {}

    def zero(self):
        return replace(self, entries=0.0, bins={}, nanflow=self.nanflow.zero())

    @property
    def num_filled(self) -> int:
        return len(self.bins)

    @property
    def min_bin(self) -> int | None:
        return min(self.bins) if self.bins else None

    @property
    def max_bin(self) -> int | None:
        return max(self.bins) if self.bins else None

    @property
    def num(self) -> int:
        return 1 + self.max_bin - self.min_bin if self.bins else 0

    @property
    def low(self) -> float:
        return self.min_bin * self.bin_width + self.origin if self.bins else NAN

    @property
    def high(self) -> float:
        return (self.max_bin + 1) * self.bin_width + self.origin if self.bins else NAN

    def range(self, i: int) -> tuple[float, float]:
        return (i * self.bin_width + self.origin, (i + 1) * self.bin_width + self.origin)

    def dense(self) -> Binned:
        """As equal bins from the first to the last one filled; one empty bin if there is none."""
        empty = self.content.zero() if self.content is not None else Counted(0.0)
        first, last = (self.min_bin, self.max_bin) if self.bins else (0, 0)
        values = tuple(self.bins.get(i, empty) for i in range(first, last + 1))
        return Binned(self.entries, self.range(first)[0], self.range(last)[1], values, Counted(0.0), Counted(0.0), self.nanflow, name=self.name)


@dataclass(frozen=True, eq=False)
class CentrallyBinned(_Grown):
    bins: tuple = ()
    nanflow: Result = None
    kind, many, single = "CentrallyBin", "bins", ("nanflow",)

    @property
    def centers(self) -> tuple[float, ...]:
        return tuple(c for c, _ in self.bins)

    def index(self, x: float) -> int:
        c = self.centers
        return next((i for i in range(len(c) - 1) if x < (c[i] + c[i + 1]) / 2), len(c) - 1)

    def center(self, x: float) -> float:
        """The centre nearest to x."""
        return self.centers[self.index(x)]

    def value(self, x: float) -> Result:
        return self.bins[self.index(x)][1]


@dataclass(frozen=True, eq=False)
class IrregularlyBinned(_Grown):
    bins: tuple = ()
    nanflow: Result = None
    kind, many, single = "IrregularlyBin", "bins", ("nanflow",)

    @property
    def edges(self) -> tuple[float, ...]:
        return tuple(e for e, _ in self.bins)

    @property
    def values(self) -> tuple[Result, ...]:
        return tuple(v for _, v in self.bins)


@dataclass(frozen=True, eq=False)
class Stacked(IrregularlyBinned):
    kind = "Stack"

    @staticmethod
    def build(first: Result, *rest: Result) -> Stacked:
        """A stack of results: each layer holds the sum of its own and all later ones."""
        layers, total = [], None
        for r in reversed((first, *rest)):
            total = r if total is None else r + total
            layers.append((NAN, total))
        return Stacked(sum(r.entries for r in (first, *rest)), tuple(reversed(layers)), Counted(0.0))


@dataclass(frozen=True, eq=False)
class Categorized(_Grown):
    bins: dict = field(default_factory=dict)
    content: Result = None
    kind, many = "Categorize", "bins"

    def zero(self):
        return replace(self, entries=0.0, bins={})

    def __getitem__(self, key: str) -> Result:
        return self.bins[key]

    def get(self, key: str, default=None):
        return self.bins.get(key, default)

    def keys(self):
        return self.bins.keys()

    @property
    def size(self) -> int:
        return len(self.bins)


@dataclass(frozen=True, eq=False)
class Fractioned(_Grown):
    numerator: Result = None
    denominator: Result = None
    kind, single = "Fraction", ("numerator", "denominator")

    @property
    def fraction_passing(self) -> float:
        return self.numerator.entries / self.denominator.entries if self.denominator.entries else NAN

    @staticmethod
    def build(numerator: Result, denominator: Result) -> Fractioned:
        """A fraction of two results that could be added."""
        numerator + denominator
        return Fractioned(denominator.entries, numerator, denominator)


@dataclass(frozen=True, eq=False)
class Selected(_Grown):
    cut: Result = None
    kind, single = "Select", ("cut",)

    def children(self):
        return [("data", self.cut)]

    @property
    def fraction_passing(self) -> float:
        return self.cut.entries / self.entries if self.entries else NAN


class Collection(_Grown):
    def __getitem__(self, step):
        return self.at(*step) if isinstance(step, tuple) else self.at(step)

    @property
    def size(self) -> int:
        return len(self.children())


@dataclass(frozen=True, eq=False)
class Labeled(Collection):
    pairs: dict = field(default_factory=dict)
    kind, many = "Label", "pairs"

    def _check(self, other):
        super()._check(other)
        _agree("the set of labels", set(self.pairs), set(other.pairs))

    def get(self, key: str, default=None):
        return self.pairs.get(key, default)

    def keys(self):
        return self.pairs.keys()


@dataclass(frozen=True, eq=False)
class UntypedLabeled(Labeled):
    kind = "UntypedLabel"


@dataclass(frozen=True, eq=False)
class Indexed(Collection):
    values: tuple = ()
    kind, many = "Index", "values"


@dataclass(frozen=True, eq=False)
class Branched(Collection):
    values: tuple = ()
    kind, many = "Branch", "values"

    def children(self):
        return [(f"i{i}", v) for i, v in enumerate(self.values)]

    def __getattr__(self, name):
        if name[:1] == "i" and name[1:].isdigit() and int(name[1:]) < len(self.values):
            return self.values[int(name[1:])]
        raise AttributeError(name)


def zero_of(spec) -> Result:
    """The result of a specification without any data."""
    from ..plans.assemble import build

    return build(spec, {})
