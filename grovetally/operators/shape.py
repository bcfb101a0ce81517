"""The structure of a tree as plain values: what must agree for results to be added, without what fills it."""

from __future__ import annotations

import json

from ..functions.quantity import Quantity
from . import spec as S
from .results import MergeError

#: Parameters of each kind that belong to its structure, in the order its constructor takes them before its quantity.
_FIXED = {"Bin": ("num", "low", "high"), "SparselyBin": ("bin_width",), "CentrallyBin": ("centers",), "IrregularlyBin": ("edges",), "Stack": ("edges",)}

#: Kinds with bins.
BINNED = ("Bin", "SparselyBin", "CentrallyBin", "IrregularlyBin", "Stack", "Categorize")


def _plain(x):
    """A value that JSON can hold; infinities as text."""
    if isinstance(x, tuple):
        return [_plain(v) for v in x]
    return repr(x) if isinstance(x, float) and x in (float("inf"), float("-inf")) else x


def shape(spec: S.Spec) -> dict:
    """The structure of ``spec``: kinds, parameters of binnings, names and children."""
    if hasattr(spec, "expand"):
        return shape(spec.expand())
    out: dict = {"kind": spec.kind}
    if spec.name is not None:
        out["name"] = spec.name
    out |= {f: _plain(getattr(spec, f)) for f in _FIXED.get(spec.kind, ())}
    if isinstance(spec, S.SparselyBin):
        out["origin"] = spec.origin
    if isinstance(spec, S.Bag):
        out["range"] = spec.range
    if isinstance(spec, S.Count) and spec.transform is not None:
        out["transformed"] = True
    if isinstance(spec, S.Measured):
        out["parts"] = spec.columns()
    if isinstance(spec, S.Fraction):
        out["children"] = [["value", shape(spec.value)]]
    elif spec.children():
        out["children"] = [[step, shape(c)] for step, c in spec.children()]
    return out


def spec_of(d: dict) -> S.Spec:
    """A tree of the structure ``d``. Its quantities are 0 with the names they had, so it can rebuild a result but not fill one."""
    kind, q = d["kind"], Quantity(0.0, d.get("name"))
    make, below = S.find(kind), {k: spec_of(c) for k, c in d.get("children", [])}
    fixed = [[float(x) for x in d[f]] if isinstance(d[f], list) else d[f] for f in _FIXED.get(kind, ())]
    if kind == "Count":
        return S.Count((lambda w: w) if d.get("transformed") else None)
    if kind == "Bag":
        return S.Bag(q, d["range"])
    if kind == "Bin":
        return S.Bin(*fixed, q, below["values"], below["underflow"], below["overflow"], below["nanflow"])
    if kind == "SparselyBin":
        return S.SparselyBin(*fixed, q, below["bins"], below["nanflow"], d["origin"])
    if kind in ("CentrallyBin", "IrregularlyBin", "Stack"):
        return make(*fixed, q, below["bins"], below["nanflow"])
    if kind in ("Categorize", "Select", "Fraction"):
        return make(q, next(iter(below.values())))
    if issubclass(make, S._Labeled):
        return make(*below.items())
    return make(*below.values()) if below else make(q)


def measured(d: dict) -> dict[str, S.Measured]:
    """The containers of one's own in a structure, by kind."""
    own = {d["kind"]: S.find(d["kind"])(0.0)} if "parts" in d else {}
    for _, c in d.get("children", []):
        own |= measured(c)
    return own


def text(d: dict) -> str:
    """A structure as text that is equal for equal structures."""
    return json.dumps(d, sort_keys=True)


def agree(a: dict, b: dict, path: str = "") -> None:
    """Raises :class:`MergeError` with the first place where two structures differ."""
    here = f"at {path!r}" if path else "at the top"
    for f in sorted((a.keys() | b.keys()) - {"children"}):
        if a.get(f) != b.get(f):
            raise MergeError(f"{here}, {f} differs: {a.get(f)!r} and {b.get(f)!r}")
    mine, theirs = a.get("children", []), b.get("children", [])
    if [k for k, _ in mine] != [k for k, _ in theirs]:
        raise MergeError(f"{here}, the children differ: {[k for k, _ in mine]} and {[k for k, _ in theirs]}")
    for (step, x), (_, y) in zip(mine, theirs, strict=True):
        agree(x, y, f"{path}/{step}" if path else step)


def nodes(d: dict, path: str = "", sizes: tuple = (), stacks: tuple = ()):
    """(path, kind, numbers of bins above, those of the bins that belong to a Stack) of every node; a number is None where data decide it."""
    yield path, "Transformed" if d.get("transformed") else d["kind"], sizes, stacks
    step = lambda s: f"{path}/{s}" if path else s
    kind = d["kind"]
    if kind == "Bag":
        yield step("values"), "Item", (*sizes, None), stacks
    for s, c in d.get("children", []):
        if kind == "Fraction":
            yield from nodes(c, step("numerator"), sizes, stacks)
            yield from nodes(c, step("denominator"), sizes, stacks)
        elif s in ("values", "bins") and kind in BINNED:
            own = d["num"] if kind == "Bin" else len(d[_FIXED[kind][0]]) if kind in ("CentrallyBin", "IrregularlyBin", "Stack") else None
            yield from nodes(c, step(s), (*sizes, own), (*stacks, len(sizes)) if kind == "Stack" else stacks)
        else:
            yield from nodes(c, step(s), sizes, stacks)
