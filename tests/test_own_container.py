"""A container that this library does not know: weighted third moments, with a state, results, a node and JSON of its own."""

import math
import sys
from dataclasses import dataclass
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from test_tally import halves, rows  # noqa: F401

from grovetally import Bin, Branch, Categorize, Count, Deviate, Measured, Select, Stack, aggregate, merge, tally, tidy, zero_of
from grovetally.operators import results as R
from grovetally.operators import shape as H
from grovetally.plans.tally import load
from grovetally.sources import loads, to_string
from grovetally.sources.jsonio import register


class Third(Measured):
    """Third central moment and the value farthest up, of what is a number."""

    kind = "Third"

    def parts(self, w, x):
        ok = f"NOT isnan({x})"
        return {"n": ("sum", f"if({ok}, {w}, 0D)"), **{f"s{i}": ("sum", f"if({ok}, {w} * pow({x}, {i}), 0D)") for i in (1, 2, 3)}, "top": ("max", f"if({ok}, {x}, NULL)")}

    def finish(self, p):
        return {k: p[k] for k in ("n", "s1", "s2", "s3", "top")} | {"third": f"try_divide({p['s3']}, {p['n']}) - 3 * try_divide({p['s1']}, {p['n']}) * try_divide({p['s2']}, {p['n']}) + 2 * pow(try_divide({p['s1']}, {p['n']}), 3)"}

    def make(self, entries, more, name):
        return ThirdFilled(entries, *[more.get(k, 0.0) or 0.0 for k in ("n", "s1", "s2", "s3")], more.get("top", math.nan), name=name)


@dataclass(frozen=True, eq=False)
class ThirdFilled(R.Result):
    n: float = 0.0
    s1: float = 0.0
    s2: float = 0.0
    s3: float = 0.0
    top: float = math.nan
    kind = "Third"

    @property
    def third(self):
        return self.s3 / self.n - 3 * self.s1 / self.n * self.s2 / self.n + 2 * (self.s1 / self.n) ** 3 if self.n else math.nan

    def _plus(self, other):
        return {k: getattr(self, k) + getattr(other, k) for k in ("n", "s1", "s2", "s3")} | {"top": max((x for x in (self.top, other.top) if x == x), default=math.nan)}

    def _times(self, factor):
        return {k: getattr(self, k) * factor for k in ("n", "s1", "s2", "s3")}

    def _nothing(self):
        return {"n": 0.0, "s1": 0.0, "s2": 0.0, "s3": 0.0, "top": math.nan}


TREE = Branch(Third("x"), Select("w", Third("y")), Bin(3, -1, 2, "x", Third("y")), Stack([0, 1], "x", Third("y")), Categorize("s", Branch(Deviate("y"), Third("y"))), Count())


def near(a, b):
    return a.equals(b, rel=1e-9, abs_=1e-9)


def plain(values):
    """(sum of weights, third moment, largest) of (weight, value)."""
    values = [(w, x) for w, x in values if x == x and w > 0]
    n = sum(w for w, _ in values)
    if not n:
        return 0.0, math.nan, math.nan
    mean = sum(w * x for w, x in values) / n
    return n, sum(w * (x - mean) ** 3 for w, x in values) / n, max(x for _, x in values)


def test_it_is_filled(rows):  # noqa: F811
    made, r = [tuple(math.nan if x is None and i in (1, 2) else x for i, x in enumerate(row)) for row in rows.collect()], aggregate(rows, TREE)
    check = lambda node, values: (node.n, node.third, node.top) == pytest.approx(plain(values), rel=1e-9, abs=1e-9, nan_ok=True)
    assert check(r.i0, [(1.0, x) for _, x, _, _, _ in made])
    assert check(r.i1.cut, [(w or 0.0, y) for _, _, y, w, _ in made])
    for i in range(3):
        assert check(r.i2.values[i], [(1.0, y) for _, x, y, _, _ in made if -1 + i <= x < i])
    for low, node in r.i3.bins:
        assert check(node, [(1.0, y) for _, x, y, _, _ in made if x >= low])
    for s, node in r.i4.bins.items():
        assert check(node.i1, [(1.0, y) for _, _, y, _, t in made if (t or "NaN") == s])
    row = tidy(rows, TREE).where("path = 'i0'").first()
    assert row["more"]["third"] == pytest.approx(r.i0.third) and row["entries"] == 400
    assert tidy(rows, TREE).where("path = 'i5'").first()["more"] is None


def test_it_is_merged_saved_and_streamed(spark, rows, tmp_path):  # noqa: F811
    from grovetally.streaming import Store, fill_store

    whole = aggregate(rows, TREE)
    parts = [tally(x, TREE) for x in halves(rows)]
    assert near(merge(parts).result(), whole) and near(sum((p.result() for p in parts[1:]), parts[0].result()), whole)
    assert near((2 * parts[0]).result(), parts[0].result() * 2) and (0 * parts[0]).result() == zero_of(TREE) == parts[0].zero().result()
    for p in parts:
        p.append(f"file://{tmp_path}/saved")
    assert near(load(spark, f"file://{tmp_path}/saved").result(), whole)
    rows.write.parquet(f"file://{tmp_path}/files")
    q = fill_store(spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/files"), TREE, f"file://{tmp_path}/store", f"file://{tmp_path}/state")
    q.processAllAvailable()
    q.stop()
    assert near(Store(spark, f"file://{tmp_path}/store").tally().result(), whole)
    assert H.shape(H.spec_of(H.shape(TREE))) == H.shape(TREE)
    with pytest.raises(R.MergeError):
        parts[0] + tally(rows, Branch(Third("x")))
    with pytest.raises(TypeError):
        parts[0].log(f"file://{tmp_path}/log")


def test_its_json(rows):  # noqa: F811
    register("Third", ThirdFilled, lambda r: {"entries": r.entries, "sums": [r.n, r.s1, r.s2, r.s3], "top": "nan" if r.top != r.top else r.top}, lambda d, name: ThirdFilled(d["entries"], *d["sums"], float(d["top"]), name=name))
    r = aggregate(rows, TREE)
    assert near(loads(to_string(r)), r)
