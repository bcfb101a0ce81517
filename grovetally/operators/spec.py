"""What to aggregate: immutable trees of containers.

A specification holds no data. ``grovetally.aggregate(df, spec)`` fills it from a DataFrame in
one pass and returns a result; ``grovetally.tidy(df, spec)`` returns the same as a DataFrame.
Specifications may share parts freely.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column

from ..functions.quantity import Quantity, quantity


class Spec:
    """A node of a tree. ``children`` are (step of the path, child).

    A container of one's own is a subclass with a method ``expand()`` that gives the tree it
    stands for.
    """

    kind = ""
    q: Quantity | None = None

    @property
    def name(self) -> str | None:
        return self.q.name if self.q is not None else None

    def children(self) -> list[tuple[str, Spec]]:
        return []

    def __repr__(self) -> str:
        inside = ", ".join(f"{k}={c!r}" for k, c in self.children())
        return f"{self.kind}({inside})" if inside else self.kind


def _spec(x: Spec) -> Spec:
    if not isinstance(x, Spec):
        raise TypeError(f"an aggregator is needed, not {type(x).__name__}")
    return x


class Count(Spec):
    """Sum of weights; ``transform`` is applied to each weight Column before it is added."""

    kind = "Count"

    def __init__(self, transform: Callable[[Column], Column] | None = None):
        self.transform = transform


class _Leaf(Spec):
    def __init__(self, q):
        self.q = quantity(q)


class Sum(_Leaf):
    """Sum of weight times quantity."""

    kind = "Sum"


class Average(_Leaf):
    """Weighted mean."""

    kind = "Average"


class Deviate(_Leaf):
    """Weighted mean and population variance."""

    kind = "Deviate"


class Minimize(_Leaf):
    """Least value, NaN left out."""

    kind = "Minimize"


class Maximize(_Leaf):
    """Largest value, NaN left out."""

    kind = "Maximize"


class Measured(Spec):
    """A leaf of one's own, which is filled, merged and streamed like the others: a subclass with a ``kind`` (an identifier) and three methods.

    ``parts(w, x)`` gives its state: {name: (function, SQL)}, where the function is "sum", "min" or "max" and the SQL is of a row's weight ``w`` and value ``x``.
    Parts are merged by their functions. ``finish(p)`` gives its results: {name: SQL}, where ``p`` has the SQL of each merged part, and of ``entries``; tidy rows hold
    them in a map ``more``. ``make(entries, more, name)`` gives the node of a tree (``more`` is empty where nothing was filled): a :class:`~grovetally.operators.results.Result` (see
    :func:`grovetally.sources.jsonio.register` for its JSON). The parts must not depend on anything but weight and value.
    """

    kind = ""

    def __init__(self, q):
        self.q = quantity(q)

    def parts(self, w: str, x: str) -> dict[str, tuple[str, str]]:
        raise NotImplementedError

    def finish(self, p: dict[str, str]) -> dict[str, str]:
        raise NotImplementedError

    def make(self, entries: float, more: dict[str, float], name: str | None):
        raise NotImplementedError

    def columns(self) -> dict[str, str]:
        """The column of each part in rows of states; its function stands in the name."""
        return {part: f"u_{how}_{self.kind}_{part}" for part, (how, _) in self.parts("w", "x").items()}


class Bag(Spec):
    """Multiset of values: the sum of weights of each distinct value.

    ``range`` is "N" for numbers, "S" for strings, "N3" for vectors of three numbers.
    """

    kind = "Bag"

    def __init__(self, q, range: str = "N"):
        if range not in ("N", "S") and not (range[:1] == "N" and range[1:].isdigit() and int(range[1:]) >= 1):
            raise ValueError(f"the range of a Bag is N, S or N followed by a size, not {range!r}")
        self.q, self.range = quantity(q), range


class Bin(Spec):
    """``num`` equal bins from ``low`` (in) to ``high`` (out), and what falls below, above and is NaN."""

    kind = "Bin"

    def __init__(self, num: int, low: float, high: float, q, value: Spec | None = None, underflow: Spec | None = None, overflow: Spec | None = None, nanflow: Spec | None = None):
        if num < 1:
            raise ValueError("a Bin needs at least one bin")
        if not low < high:
            raise ValueError(f"low must be less than high, not {low} and {high}")
        self.num, self.low, self.high, self.q = int(num), float(low), float(high), quantity(q)
        self.value, self.underflow, self.overflow, self.nanflow = (_spec(x or Count()) for x in (value, underflow, overflow, nanflow))

    def children(self):
        return [("values", self.value), ("underflow", self.underflow), ("overflow", self.overflow), ("nanflow", self.nanflow)]


class SparselyBin(Spec):
    """Bins of equal width, made where data are."""

    kind = "SparselyBin"

    def __init__(self, bin_width: float, q, value: Spec | None = None, nanflow: Spec | None = None, origin: float = 0.0):
        if not bin_width > 0:
            raise ValueError("the bin width must be above 0")
        self.bin_width, self.q, self.origin = float(bin_width), quantity(q), float(origin)
        self.value, self.nanflow = _spec(value or Count()), _spec(nanflow or Count())

    def children(self):
        return [("bins", self.value), ("nanflow", self.nanflow)]


class CentrallyBin(Spec):
    """Bins by the nearest of some centres, taken in the order given; a tie goes to the later one."""

    kind = "CentrallyBin"

    def __init__(self, centers, q, value: Spec | None = None, nanflow: Spec | None = None):
        self.centers, self.q = tuple(float(c) for c in centers), quantity(q)
        if len(self.centers) < 2:
            raise ValueError("a CentrallyBin needs at least two centres")
        self.value, self.nanflow = _spec(value or Count()), _spec(nanflow or Count())

    def children(self):
        return [("bins", self.value), ("nanflow", self.nanflow)]


class IrregularlyBin(Spec):
    """Bins between edges; the edges are sorted, and a first bin reaches down to -inf."""

    kind = "IrregularlyBin"

    def __init__(self, edges, q, value: Spec | None = None, nanflow: Spec | None = None):
        edges = sorted({float(e) for e in edges} | {float("-inf")})
        if len(edges) < 1:
            raise ValueError("at least one edge is needed")
        self.edges, self.q = tuple(edges), quantity(q)
        self.value, self.nanflow = _spec(value or Count()), _spec(nanflow or Count())

    def children(self):
        return [("bins", self.value), ("nanflow", self.nanflow)]


class Stack(IrregularlyBin):
    """A container for each threshold, filled with all rows that reach it."""

    kind = "Stack"


class Categorize(Spec):
    """A container for each distinct string; null is the category "NaN"."""

    kind = "Categorize"

    def __init__(self, q, value: Spec | None = None):
        self.q, self.value = quantity(q), _spec(value or Count())

    def children(self):
        return [("bins", self.value)]


class Select(Spec):
    """Fills its container with the weight times the quantity, where that is above 0."""

    kind = "Select"

    def __init__(self, q, cut: Spec | None = None):
        self.q, self.cut = quantity(q), _spec(cut or Count())

    def children(self):
        return [("data", self.cut)]


class Fraction(Spec):
    """A container filled with everything, and one filled as by Select."""

    kind = "Fraction"

    def __init__(self, q, value: Spec | None = None):
        self.q, self.value = quantity(q), _spec(value or Count())

    def children(self):
        return [("numerator", self.value), ("denominator", self.value)]


class _Collection(Spec):
    def children(self):
        return list(self.items)


class _Labeled(_Collection):
    def __init__(self, *pairs: tuple[str, Spec], **more: Spec):
        self.items = tuple((str(k), _spec(v)) for k, v in [*pairs, *more.items()])
        if not self.items:
            raise ValueError(f"{self.kind} needs at least one container")
        if len({k for k, _ in self.items}) < len(self.items):
            raise ValueError("labels must differ")


class Label(_Labeled):
    """Containers of one type by label."""

    kind = "Label"

    def __init__(self, *pairs, **more):
        super().__init__(*pairs, **more)
        if len({s.kind for _, s in self.items}) > 1:
            raise TypeError("all containers of a Label must have one type; use UntypedLabel")


class UntypedLabel(_Labeled):
    """Containers of any types by label."""

    kind = "UntypedLabel"


class Index(_Collection):
    """Containers of one type by number."""

    kind = "Index"

    def __init__(self, *values: Spec):
        self.items = tuple((str(i), _spec(v)) for i, v in enumerate(values))
        if not self.items:
            raise ValueError("Index needs at least one container")
        if len({s.kind for _, s in self.items}) > 1:
            raise TypeError("all containers of an Index must have one type; use Branch")


class Branch(_Collection):
    """Containers of any types by number: i0, i1 and so on."""

    kind = "Branch"

    def __init__(self, *values: Spec):
        self.items = tuple((f"i{i}", _spec(v)) for i, v in enumerate(values))
        if not self.items:
            raise ValueError("Branch needs at least one container")


def find(kind: str) -> type[Spec]:
    """The container of a name, among all that are known."""
    todo = [Spec]
    while todo:
        for c in todo.pop().__subclasses__():
            if c.kind == kind:
                return c
            todo.append(c)
    raise KeyError(f"no container is named {kind!r}")


def containers() -> dict[str, str]:
    """Every container by name, with what it does."""
    found, todo = {}, [Spec]
    while todo:
        for c in todo.pop().__subclasses__():
            todo.append(c)
            if c.kind:
                found[c.kind] = (c.__doc__ or "").strip()
    return dict(sorted(found.items()))
