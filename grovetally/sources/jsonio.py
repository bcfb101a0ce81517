"""The JSON form of results, which other implementations of these aggregators read and write."""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable
from pathlib import Path
from typing import IO

from pyspark.sql import SparkSession

from ..operators import results as R

#: The version written into the header. The keys of objects below are fixed by the format as well.
VERSION = "1.0"


class FormatError(ValueError):
    """The JSON is no result, or of a version that cannot be read."""


def _out(x: float):
    """A number, or "nan", "inf", "-inf"."""
    if math.isnan(x):
        return "nan"
    if math.isinf(x):
        return "inf" if x > 0 else "-inf"
    return int(x) if x == int(x) and abs(x) < 2**53 else x


def _in(x) -> float:
    if isinstance(x, str) and x in ("nan", "inf", "-inf"):
        return float(x)
    if isinstance(x, bool) or not isinstance(x, (int, float)):
        raise FormatError(f"a number is needed, not {x!r}")
    return float(x)


def _type(children: list[R.Result], template: R.Result | None = None) -> str:
    return children[0].kind if children else template.kind if template is not None else "Count"


def _shared(children: list[R.Result], template: R.Result | None = None) -> str | None:
    """The name that all children have, written once beside them."""
    some = children or ([template] if template is not None else [])
    names = {c.name for c in some}
    return names.pop() if len(names) == 1 else None


def _named(d: dict, key: str, name: str | None) -> dict:
    return d | {key: name} if name is not None else d


def _flow(key: str, r: R.Result) -> dict:
    return {f"{key}:type": r.kind, key: fragment(r)}


def fragment(r: R.Result, hide_name: bool = False):
    """The data of a node, without its type."""
    name = None if hide_name else r.name
    if isinstance(r, R.Counted):
        return _out(r.entries)
    d = {"entries": _out(r.entries)}
    if isinstance(r, R.Summed):
        d["sum"] = _out(r.sum)
    elif isinstance(r, R.Averaged):
        d["mean"] = _out(r.mean)
    elif isinstance(r, R.Deviated):
        d |= {"mean": _out(r.mean), "variance": _out(r.variance)}
    elif isinstance(r, R.Minimized):
        d["min"] = _out(r.min)
    elif isinstance(r, R.Maximized):
        d["max"] = _out(r.max)
    elif isinstance(r, R.Bagged):
        order = lambda v: v if isinstance(v, str) else tuple((math.isnan(x), 0 if math.isnan(x) else x) for x in (v if isinstance(v, tuple) else (v,)))
        put = lambda v: v if isinstance(v, str) else [_out(x) for x in v] if isinstance(v, tuple) else _out(v)
        d |= {"values": [{"w": _out(r.values[v]), "v": put(v)} for v in sorted(r.values, key=order)], "range": r.range}
    elif isinstance(r, R.Binned):
        d |= {"low": _out(r.low), "high": _out(r.high), "values:type": _type(list(r.values)), "values": [fragment(v, True) for v in r.values]}
        d |= _flow("underflow", r.underflow) | _flow("overflow", r.overflow) | _flow("nanflow", r.nanflow)
        d = _named(d, "values:name", _shared(list(r.values)))
    elif isinstance(r, R.SparselyBinned):
        own = list(r.bins.values())
        d |= {"binWidth": _out(r.bin_width), "bins:type": _type(own, r.content), "bins": {str(k): fragment(v, True) for k, v in sorted(r.bins.items())}}
        d |= _flow("nanflow", r.nanflow) | {"origin": _out(r.origin)}
        d = _named(d, "bins:name", _shared(own, r.content))
    elif isinstance(r, (R.CentrallyBinned, R.IrregularlyBinned)):
        own, at = [v for _, v in r.bins], "center" if isinstance(r, R.CentrallyBinned) else "atleast"
        d |= {"bins:type": _type(own), "bins": [{at: _out(x), "data": fragment(v, True)} for x, v in r.bins]} | _flow("nanflow", r.nanflow)
        d = _named(d, "bins:name", _shared(own))
    elif isinstance(r, R.Categorized):
        own = list(r.bins.values())
        d |= {"bins:type": _type(own, r.content), "bins": {k: fragment(v, True) for k, v in r.bins.items()}}
        d = _named(d, "bins:name", _shared(own, r.content))
    elif isinstance(r, R.Fractioned):
        d |= {"sub:type": r.numerator.kind, "numerator": fragment(r.numerator, True), "denominator": fragment(r.denominator, True)}
        d = _named(d, "sub:name", _shared([r.numerator, r.denominator]))
    elif isinstance(r, R.Selected):
        d |= {"sub:type": r.cut.kind, "data": fragment(r.cut)}
    elif isinstance(r, R.UntypedLabeled):
        return d | {"data": {k: {"type": v.kind, "data": fragment(v)} for k, v in r.pairs.items()}}
    elif isinstance(r, R.Labeled):
        return d | {"sub:type": _type(list(r.pairs.values())), "data": {k: fragment(v) for k, v in r.pairs.items()}}
    elif isinstance(r, R.Indexed):
        return d | {"sub:type": _type(list(r.values)), "data": [fragment(v) for v in r.values]}
    elif isinstance(r, R.Branched):
        return d | {"data": [{"type": v.kind, "data": fragment(v)} for v in r.values]}
    else:
        kind = next((k for k, (cls, _, _) in _CUSTOM.items() if isinstance(r, cls)), None)
        if kind is None:
            raise TypeError(f"{type(r).__name__} has no JSON form")
        d = _CUSTOM[kind][1](r)
    return _named(d, "name", name)


#: Kinds registered by users: result class, writer of the fragment, reader of the fragment.
_CUSTOM: dict[str, tuple[type, Callable, Callable]] = {}


def register(kind: str, cls: type, write: Callable, read: Callable) -> None:
    """Adds a container type of one's own to the JSON form: ``write(result)`` gives a fragment,
    ``read(fragment, name)`` a result."""
    _CUSTOM[kind] = (cls, write, read)


def registered() -> list[str]:
    return sorted([*_READ, *_CUSTOM])


def to_json(r: R.Result) -> dict:
    return {"version": VERSION, "type": r.kind, "data": fragment(r)}


def to_string(r: R.Result) -> str:
    return json.dumps(to_json(r), allow_nan=False)


def save(r: R.Result, path: str | Path) -> None:
    Path(path).write_text(to_string(r), encoding="utf-8")


def _keys(d, needed: str, optional: str = "") -> dict:
    if not isinstance(d, dict):
        raise FormatError(f"an object is needed, not {type(d).__name__}")
    must, may = set(needed.split()), set(optional.split())
    if not must <= d.keys() <= must | may:
        raise FormatError(f"keys {sorted(d)} do not fit {sorted(must)} and optionally {sorted(may)}")
    return d


def _child(d: dict, key: str) -> R.Result:
    return _node(d[f"{key}:type"], d[key])


def _leaf(cls, *names: str):
    def read(d, name):
        _keys(d, "entries " + " ".join(names), "name")
        return cls(_in(d["entries"]), *[_in(d[n]) for n in names], name=d.get("name", name))

    return read


def _read_bag(d, name):
    _keys(d, "entries values range", "name")
    kind = d["range"]
    value = (lambda v: v) if kind == "S" else _in if kind == "N" else lambda v: tuple(_in(x) for x in v)
    return R.Bagged(_in(d["entries"]), {value(x["v"]): _in(x["w"]) for x in d["values"]}, kind, name=d.get("name", name))


def _read_bin(d, name):
    _keys(d, "low high entries values:type values underflow:type underflow overflow:type overflow nanflow:type nanflow", "name values:name")
    values = tuple(_node(d["values:type"], v, d.get("values:name")) for v in d["values"])
    return R.Binned(_in(d["entries"]), _in(d["low"]), _in(d["high"]), values, _child(d, "underflow"), _child(d, "overflow"), _child(d, "nanflow"), name=d.get("name", name))


def _template(kind: str, name: str | None, bins: list[R.Result]) -> R.Result | None:
    """What a new bin would start as, as far as the JSON tells."""
    if bins:
        return bins[0].zero()
    leaf = {"Count": R.Counted, "Sum": R.Summed, "Average": R.Averaged, "Deviate": R.Deviated, "Minimize": R.Minimized, "Maximize": R.Maximized}.get(kind)
    return None if leaf is None else leaf(0.0) if leaf is R.Counted else leaf(0.0, name=name)


def _read_sparse(d, name):
    _keys(d, "binWidth entries bins:type bins nanflow:type nanflow origin", "name bins:name")
    bins = {int(k): _node(d["bins:type"], v, d.get("bins:name")) for k, v in d["bins"].items()}
    content = _template(d["bins:type"], d.get("bins:name"), list(bins.values()))
    return R.SparselyBinned(_in(d["entries"]), _in(d["binWidth"]), bins, _child(d, "nanflow"), _in(d["origin"]), content, name=d.get("name", name))


def _read_edges(cls, at: str):
    def read(d, name):
        _keys(d, "entries bins:type bins nanflow:type nanflow", "name bins:name")
        bins = tuple((_in(_keys(b, f"{at} data")[at]), _node(d["bins:type"], b["data"], d.get("bins:name"))) for b in d["bins"])
        return cls(_in(d["entries"]), bins, _child(d, "nanflow"), name=d.get("name", name))

    return read


def _read_categories(d, name):
    _keys(d, "entries bins:type bins", "name bins:name")
    bins = {k: _node(d["bins:type"], v, d.get("bins:name")) for k, v in d["bins"].items()}
    return R.Categorized(_in(d["entries"]), bins, _template(d["bins:type"], d.get("bins:name"), list(bins.values())), name=d.get("name", name))


def _read_fraction(d, name):
    _keys(d, "entries sub:type numerator denominator", "name sub:name")
    sub = lambda k: _node(d["sub:type"], d[k], d.get("sub:name"))
    return R.Fractioned(_in(d["entries"]), sub("numerator"), sub("denominator"), name=d.get("name", name))


def _read_select(d, name):
    _keys(d, "entries sub:type data", "name")
    return R.Selected(_in(d["entries"]), _node(d["sub:type"], d["data"]), name=d.get("name", name))


def _read_label(d, name):
    _keys(d, "entries sub:type data")
    return R.Labeled(_in(d["entries"]), {k: _node(d["sub:type"], v) for k, v in d["data"].items()})


def _read_untyped(d, name):
    _keys(d, "entries data")
    return R.UntypedLabeled(_in(d["entries"]), {k: _node(_keys(v, "type data")["type"], v["data"]) for k, v in d["data"].items()})


def _read_index(d, name):
    _keys(d, "entries sub:type data")
    return R.Indexed(_in(d["entries"]), tuple(_node(d["sub:type"], v) for v in d["data"]))


def _read_branch(d, name):
    _keys(d, "entries data")
    return R.Branched(_in(d["entries"]), tuple(_node(_keys(v, "type data")["type"], v["data"]) for v in d["data"]))


_READ: dict[str, Callable] = {
    "Count": lambda d, name: R.Counted(_in(d)), "Sum": _leaf(R.Summed, "sum"), "Average": _leaf(R.Averaged, "mean"), "Deviate": _leaf(R.Deviated, "mean", "variance"),
    "Minimize": _leaf(R.Minimized, "min"), "Maximize": _leaf(R.Maximized, "max"), "Bag": _read_bag, "Bin": _read_bin, "SparselyBin": _read_sparse,
    "CentrallyBin": _read_edges(R.CentrallyBinned, "center"), "IrregularlyBin": _read_edges(R.IrregularlyBinned, "atleast"), "Stack": _read_edges(R.Stacked, "atleast"),
    "Categorize": _read_categories, "Fraction": _read_fraction, "Select": _read_select, "Label": _read_label, "UntypedLabel": _read_untyped, "Index": _read_index,
    "Branch": _read_branch,
}


def _node(kind: str, d, name: str | None = None) -> R.Result:
    if kind in _READ:
        return _READ[kind](d, name)
    if kind in _CUSTOM:
        return _CUSTOM[kind][2](d, name)
    raise FormatError(f"no container type is named {kind!r}")


def from_json(d: dict) -> R.Result:
    _keys(d, "version type data")
    try:
        major = int(str(d["version"]).split(".")[0])
    except ValueError:
        raise FormatError(f"no version: {d['version']!r}") from None
    if major > int(VERSION.split(".")[0]):
        raise FormatError(f"version {d['version']} cannot be read")
    return _node(d["type"], d["data"])


def loads(text: str) -> R.Result:
    return from_json(json.loads(text))


def load(source: str | Path | IO) -> R.Result:
    """From a path or an open file."""
    return loads(source.read() if hasattr(source, "read") else Path(source).read_text(encoding="utf-8"))


class JsonLog:
    """An append-only file with a result a line, for a watcher of a running job."""

    def __init__(self, path: str | Path):
        self.path = Path(path)

    def append(self, r: R.Result) -> None:
        with self.path.open("a", encoding="utf-8") as f:
            f.write(to_string(r) + "\n")

    def results(self) -> list[R.Result]:
        return [loads(x) for x in self.path.read_text(encoding="utf-8").splitlines() if x]


class SharedJsonLog:
    """Like :class:`JsonLog` in a folder of any file system that Spark can write to. Each result is one file of
    its own that appears whole."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, r: R.Result) -> None:
        self.spark.createDataFrame([(time.time_ns(), to_string(r))], "at long, result string").coalesce(1).write.mode("append").json(self.path)

    def results(self) -> list[R.Result]:
        rows = self.spark.read.schema("at long, result string").json(self.path)
        return [loads(x["result"]) for x in rows.orderBy("at").toLocalIterator()]
