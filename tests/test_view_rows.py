"""Views of rows against views of trees, and requests by path."""

import math
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from test_tally import rows  # noqa: F401

from grovetally import Average, Bin, Categorize, Count, Deviate, Fraction, Histogram, IrregularlyBin, Select, SparselyBin, SparselyHistogram, SparselyProfileErr, Stack, Sum, UntypedLabel, aggregate, tally, tidy
from grovetally.operators import views as V
from grovetally.plans.view_rows import bins, fractions


def near(a, b):
    return a == pytest.approx(b, rel=1e-11, abs=1e-11, nan_ok=True)


@pytest.mark.parametrize("tree", [Bin(7, -2, 2, "x"), Histogram(7, -2, 2, "x", "w"), SparselyHistogram(0.3, "x", origin=0.1), Bin(7, -2, 2, "x", Average("y")), SparselyProfileErr(0.3, "x", "y")], ids=str)
def test_bins_are_those_of_the_plot(rows, tree):  # noqa: F811
    want = [(p["low"], p["high"], p["center"], p["value"], math.nan if p["error"] is None else p["error"]) for p in V.plot_points(aggregate(rows.where("abs(x) < 5"), tree))]
    got = bins(tally(rows.where("abs(x) < 5"), tree), empty="all").orderBy("bin").collect()
    assert len(got) == len(want) and all(near([r["low"], r["high"], r["center"], r["value"], math.nan if r["error"] is None else r["error"]], list(w)) for r, w in zip(got, want))
    runs = bins(tally(rows.where("abs(x) < 5"), tree)).collect()
    assert sum(r["last"] - r["bin"] + 1 for r in runs) == len(want)
    some = bins(tally(rows.where("abs(x) < 5"), tree), empty="none")
    assert some.where("entries = 0").count() == 0 and some.count() == sum(r["entries"] > 0 for r in got)


def test_far_bins_cost_a_row(spark):
    """Runs over the borders of ranges, in groups of many sizes, with bins 10^12 apart."""
    df = spark.range(0, 4000, 1, 8).selectExpr("string(id % 3) AS s", "CASE id WHEN 0 THEN 1e12 WHEN 3 THEN -1e12 WHEN 1 THEN 'NaN' ELSE double(id * id % 9973) END AS x")
    filled: dict = {}
    for i in range(4000):
        x = {0: 10**12, 3: -(10**12), 1: None}.get(i, i * i % 9973)
        if x is not None:
            filled.setdefault(str(i % 3), set()).add(x)
    want = set()
    for s, xs in filled.items():
        order = sorted(xs)
        want |= {(s, x, x) for x in order} | {(s, a + 1, b - 1) for a, b in zip(order, order[1:]) if b > a + 1}
    for parts in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = bins(tally(df, Categorize("s", SparselyBin(1.0, "x"))), "bins").collect()
        assert {(r["above"][0], r["bin"], r["last"]) for r in got} == want and len(got) == len(want)
        assert all((r["entries"] > 0) == (r["bin"] in filled[r["above"][0]]) for r in got)
    # bins of a Bin below categories are filled from first to last
    got = bins(tally(df, Categorize("s", Bin(500, -10, 9990, "x"))), "bins", "all").collect()
    assert sorted((r["above"][0], r["bin"]) for r in got) == sorted((s, i) for s in "012" for i in range(500))


def test_layers_and_two_dimensions(rows):  # noqa: F811
    for tree, view in ((Stack([-1, 0.5], "y", Histogram(5, -2, 2, "x")), V.StackedHistogramView), (IrregularlyBin([-1, 0.5], "y", Histogram(5, -2, 2, "x")), V.PartitionedHistogramView)):
        want = {(i, j): x for i, v in enumerate(view(aggregate(rows, tree)).layers) for j, x in enumerate(v.numerical_values)}
        assert {(int(r["above"][0]), r["bin"]): r["value"] for r in bins(tally(rows, tree), "bins", "all").collect()} == want
    tree = Select("w", Bin(3, -2, 2, "x", Bin(4, -1, 2, "y")))
    want = {(i, j): x for i, row in enumerate(V.TwoDimensionalView(aggregate(rows, tree)).numerical_values) for j, x in enumerate(row)}
    got = {(int(r["above"][0]), r["bin"]): r["value"] for r in bins(tally(rows, tree), "data/values", "all").collect()}
    assert got.keys() == want.keys() and all(near(got[k], want[k]) for k in want)


@pytest.mark.parametrize("tree", [Fraction("y > 0", Histogram(6, -3, 3, "x")), Fraction("w", SparselyBin(0.5, "x"))], ids=str)
@pytest.mark.parametrize("interval", ["wald", "wilson"])
def test_fractions(rows, tree, interval):  # noqa: F811
    rows = rows.where("abs(x) < 4 AND (w IS NULL OR w <= 1)")
    r = aggregate(rows, tree)
    out = fractions(tally(rows, tree), "", "all", interval, 1.5).orderBy("bin").collect()
    f = {"wald": V.wald_interval, "wilson": V.wilson_interval}[interval]
    if isinstance(tree.value, SparselyBin):
        den, num = r.denominator.dense(), r.numerator.bins
        pairs = [(num[i].entries if i in num else 0.0, den.values[i - r.denominator.min_bin].entries) for i in range(r.denominator.min_bin, r.denominator.max_bin + 1)]
    else:
        pairs = [(n.entries, d.entries) for n, d in zip(r.numerator.cut.values, r.denominator.cut.values)]
    assert len(out) == len(pairs)
    for row, (n, d) in zip(out, pairs):
        assert near([row["numerator"], row["denominator"], row["value"], row["lower"], row["upper"]], [n, d, n / d if d else math.nan, f(n, d, -1.5), f(n, d, 1.5)])


def test_other_shapes_are_errors(rows):  # noqa: F811
    t = tally(rows, UntypedLabel(a=Bin(2, 0, 1, "x", Bin(2, 0, 1, "y")), b=Count()))
    for path, error in (("b", V.ShapeError), ("a", V.ShapeError), ("c", KeyError), ("", V.ShapeError)):
        with pytest.raises(error):
            bins(t, path)
    with pytest.raises(V.ShapeError):
        fractions(t, "a")
    with pytest.raises(ValueError):
        bins(t, "a/values", "some")


def test_no_data(rows):  # noqa: F811
    none = rows.limit(0)
    assert bins(tally(none, SparselyBin(1, "x"))).count() == 0
    assert [r["value"] for r in bins(tally(none, Bin(2, 0, 1, "x"))).collect()] == [0.0, 0.0]


# requests by path


TREE = UntypedLabel(
    a=Select("x > 0", Categorize("s", Deviate("y"))), b=Select("w", Select("y", Bin(4, -2, 2, "x"))), c=Fraction("x > 1", Sum("y")), d=Stack([0, 1], "x", Sum("y")), e=Select("k < 3", Count()),
)


@pytest.mark.parametrize("paths", [["a/data"], ["a/data", "e"], ["b/data/data"], ["c/numerator"], ["d/bins", "a"], ["b/data/data/values", "e/data", "c/numerator"], [""], ["a", "b", "c", "d", "e"]], ids="+".join)
@pytest.mark.parametrize("nulls", ["nan", "zero"])
def test_paths_give_the_same_rows(rows, paths, nulls):  # noqa: F811
    table = lambda df: {(r["path"], tuple(r["keys"])): [-7.25 if x is None else x for x in tuple(r)[2:]] for r in df.collect()}
    want = {k: v for k, v in table(tidy(rows, TREE, nulls)).items() if any(k[0] == p or k[0].startswith(p + "/") or not p for p in paths)}
    got = table(tidy(rows, TREE, nulls, paths=paths))
    assert got.keys() == want.keys() and all(near(got[k], want[k]) for k in want)


def test_selections_reach_the_scan(spark, rows, tmp_path):  # noqa: F811
    rows.write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    plan = lambda paths: tidy(df, TREE, paths=paths)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(x,0.0)" in plan(["a/data"]) and "ReadSchema: struct<x:double,y:double,s:string>" in plan(["a/data"])
    assert "GreaterThan(w,0.0)" in plan(["b/data"])
    both = plan(["e/data", "a/data"])
    assert "Or(LessThan(k,3),GreaterThan(x,0.0))" in both or "Or(GreaterThan(x,0.0),LessThan(k,3))" in both
    assert "PushedFilters: []" in plan(["a"])  # the entries of the selection itself are those of all rows
    with pytest.raises(KeyError):
        plan(["z"])
