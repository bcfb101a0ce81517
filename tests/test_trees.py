"""Compiled trees against small goldens and against the row-at-a-time filler."""

import math
import sys

import pytest
from filler import fill, measures
from pyspark.sql import functions as F

from grovetally import (
    Average, Bag, Bin, Branch, Categorize, CentrallyBin, Count, Deviate, Fraction, Histogram, Index, IrregularlyBin, Label, Maximize, Minimize, Select,
    SparselyBin, Stack, Sum, UntypedLabel, aggregate, named, tidy,
)
from grovetally.operators.results import MergeError

#: Inputs whose results are known.
SIMPLE = [3.4, 2.2, -1.8, 0.0, 7.3, -4.7, 1.6, 0.0, -3.0, -1.7]
STRUCT = list(zip(
    [True, False, True, False, False, False, True, True, False, True], range(-2, 8), SIMPLE,
    ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"], strict=True,
))
NAN, INF = math.nan, math.inf
MESSY = [
    (1.0, 0.5, "a", 1.0), (2.5, 1.0, "b", -2.0), (NAN, 2.0, "a", 3.0), (INF, 0.25, None, 0.5), (-INF, 1.0, "c", 1.0), (None, 1.5, "b", 2.0), (-3.5, -1.0, "a", 0.0),
    (7.25, NAN, "d", 1.0), (4.0, 0.0, "a", None), (2.5, 3.0, "b", 1.5), (-0.0, 1.0, "a", 1.0), (0.0, 2.0, "d", -1.0),
]


@pytest.fixture(scope="module")
def simple(spark):
    return spark.createDataFrame([(x,) for x in SIMPLE], "x double").cache()


@pytest.fixture(scope="module")
def struct(spark):
    return spark.createDataFrame(STRUCT, "b boolean, i int, x double, s string").cache()


@pytest.fixture(scope="module")
def messy(spark):
    return spark.createDataFrame(MESSY, "x double, w double, s string, y double").cache()


def counts(values):
    return [v.entries for v in values]


def test_bins(simple, struct):
    r = aggregate(simple, Bin(5, -3, 7, "x"))
    assert counts(r.values) == [3, 2, 2, 1, 0] and (r.underflow.entries, r.overflow.entries, r.nanflow.entries, r.entries) == (1, 1, 0, 10)
    r = aggregate(struct, Select("b", Bin(5, -3, 7, "x")))
    assert counts(r.cut.values) == [2, 1, 1, 1, 0] and r.entries == 10 and r.fraction_passing == 0.5
    r = aggregate(simple, Bin(5, -3, 7, "x", Sum(10), Sum(10), Sum(10), Sum(10)))
    assert [v.sum for v in r.values] == [30, 20, 20, 10, 0] and (r.underflow.sum, r.overflow.sum, r.nanflow.sum) == (10, 10, 0)


def test_other_binnings(simple, struct):
    r = aggregate(simple, SparselyBin(1.0, "x"))
    assert {k: v.entries for k, v in r.bins.items()} == {-5: 1, -3: 1, -2: 2, 0: 2, 1: 1, 2: 1, 3: 1, 7: 1}
    assert (r.num_filled, r.num, r.low, r.high) == (8, 13, -5.0, 8.0)
    r = aggregate(simple, CentrallyBin([-3, -1, 0, 1, 3, 10], "x"))
    assert counts(v for _, v in r.bins) == [2, 2, 2, 1, 2, 1] and r.center(1.5) == 1.0
    r = aggregate(simple, IrregularlyBin([0, 2, 4, 6, 8], "x", Sum("x")))
    assert counts(r.values) == [4, 3, 2, 0, 1, 0] and r.values[0].sum == pytest.approx(-11.2) and r.values[1].sum == pytest.approx(1.6)
    r = aggregate(simple, Stack([0, 2, 4, 6, 8], "x", Sum("x")))
    assert counts(r.values) == [10, 6, 3, 1, 1, 0] and r.values[1].sum == pytest.approx(14.5)
    r = aggregate(struct, Categorize("substring(s, 1, 1)"))
    assert {k: v.entries for k, v in r.bins.items()} == {"n": 1, "e": 1, "t": 3, "s": 2, "f": 2, "o": 1}


def test_fractions_and_weights(simple, struct):
    r = aggregate(simple, Fraction("x > 0", Sum("x")))
    assert r.numerator.sum == pytest.approx(14.5) and r.denominator.sum == pytest.approx(3.3) and r.fraction_passing == 0.4
    r = aggregate(simple, Fraction(F.col("x") > 0, Histogram(5, -3, 7, "x")))
    assert counts(r.numerator.cut.values) == [0, 0, 2, 1, 0] and counts(r.denominator.cut.values) == [3, 2, 2, 1, 0]
    r = aggregate(struct, Select("i", Sum("x")))
    assert r.cut.sum == pytest.approx(sum(i * x for _, i, x, _ in STRUCT if i > 0))


def test_collections(simple):
    one, two, three = Histogram(5, -3, 7, "x"), Histogram(10, 0, 10, "x"), Histogram(5, -3, 7, "2 * x")
    r = aggregate(simple, Label(one=one, two=two, three=three))
    assert [counts(r[k].cut.values) for k in ("one", "two", "three")] == [[3, 2, 2, 1, 0], [2, 1, 1, 1, 0, 0, 0, 1, 0, 0], [0, 2, 0, 2, 1]]
    r = aggregate(simple, Index(one, two, three))
    assert counts(r[1].cut.values) == [2, 1, 1, 1, 0, 0, 0, 1, 0, 0]
    r = aggregate(simple, UntypedLabel(h=one, s=Sum(1), d=Deviate("x + 100")))
    assert r["s"].sum == 10 and r["d"].mean == pytest.approx(100.33) and r["d"].variance == pytest.approx(10.8381)
    r = aggregate(simple, Branch(one, Count(), Deviate("x + 100")))
    assert counts(r.i0.cut.values) == [3, 2, 2, 1, 0] and r.i1.entries == 10 and r.at("i0", "data", 0).entries == 3 and r.at(1).entries == 10
    assert r.indexes() == [("i0",), ("i1",), ("i2",)]
    r = aggregate(simple, Label(*[(n, Histogram(10, -10, 10, "x", sel)) for n, sel in (("a", "x > 0"), ("b", "x > 5"), ("c", "x < 5"))]))
    assert counts(r["a"].cut.values) == [0, 0, 0, 0, 0, 1, 2, 0, 1, 0] and counts(r["c"].cut.values) == [0, 0, 1, 1, 2, 3, 2, 0, 0, 0]


def test_empty(spark):
    none = spark.createDataFrame([], "x double, s string")
    r = aggregate(none, Branch(Average("x"), Deviate("x"), Minimize("x"), Maximize("x"), Sum("x"), Bag("x"), Bin(2, 0, 1, "x"), Categorize("s")))
    assert all(math.isnan(v) for v in (r.i0.mean, r.i1.mean, r.i1.variance, r.i2.min, r.i3.max)) and r.i4.sum == 0 and r.entries == 0
    assert r.i5.values == {} and counts(r.i6.values) == [0, 0] and r.i7.size == 0


LEAVES = [Count(), Sum("y"), Average("y"), Deviate("y"), Minimize("y"), Maximize("y"), Bag("y")]
TREES = [
    *LEAVES,
    *[Bin(4, -4, 8, "x", leaf) for leaf in LEAVES],
    *[Stack([0.0, 2.5, 5.0], "x", leaf) for leaf in LEAVES],
    *[Select("w", leaf) for leaf in LEAVES],
    *[Select("w", Bin(4, -4, 8, "x", leaf, leaf, leaf, leaf)) for leaf in LEAVES],
    *[Fraction("w", Categorize("s", leaf)) for leaf in LEAVES],
    SparselyBin(2.0, "x", SparselyBin(1.0, "y"), Deviate("y")),
    CentrallyBin([-1.0, 3.0, 2.0], "x", Categorize("s", Average("y")), Bag("y")),
    IrregularlyBin([0.0, 3.0], "x", Stack([0.0, 1.0], "y", Deviate("y"))),
    Stack([0.0, 3.0], "x", Stack([0.0, 1.0], "y", Deviate("y"), Sum("w"))),
    Stack([0.0, 3.0], "x", Categorize("s", Bin(3, 0, 3, "y"))),
    Bin(3, -4, 8, "x", Bin(3, -2, 4, "y", Deviate("w")), Categorize("s"), Bag("y"), Stack([0.0], "y")),
    Branch(Select("w", Fraction("y", Bin(3, -4, 8, "x", Average("y")))), Categorize("s", Select("y", Minimize("x"))), SparselyBin(3, "x"), Count(), Bag("x")),
    Select("w", Select("y", Deviate("x"))),
]


def against_rows(messy, tree):
    rows = [dict(zip("xwsy", r, strict=True)) for r in MESSY]
    expected = fill(tree, rows)
    got = {}
    for r in tidy(messy, tree).collect():
        got.setdefault(r["path"], {})[tuple(r["keys"])] = r

    def text(k):
        return "NaN" if k == "nan" else k if isinstance(k, str) else str(k).replace("inf", "Infinity")

    for path, by in expected.items():
        for keys, e in by.items():
            r = got[path].pop(tuple(text(k) for k in keys))
            assert r["entries"] == pytest.approx(e["entries"], rel=1e-12), (path, keys)
            if e["rows"]:
                for name, x in zip(("sum", "mean", "variance", "min", "max"), measures(e["rows"]), strict=True):
                    if r[name] is not None:
                        assert r[name] == pytest.approx(x, rel=1e-9, abs=1e-12, nan_ok=True), (path, keys, name)
    assert all(r["entries"] == 0 for by in got.values() for r in by.values())


@pytest.mark.parametrize("tree", TREES, ids=[f"{i}-{t.kind}" for i, t in enumerate(TREES)])
def test_against_rows(messy, tree):
    against_rows(messy, tree)


@pytest.mark.parametrize("tree", TREES[-8:-1], ids=[t.kind for t in TREES[-8:-1]])
def test_nodes_are_looked_up(messy, tree, monkeypatch):
    monkeypatch.setattr(sys.modules["grovetally.plans.lower"], "FEW_CHAINS", 1)
    against_rows(messy, tree)


def test_wide_tree(messy, spark, tmp_path):
    """All trees at once: many chains of different keys and measures, from one scan and one shuffle of rows."""
    tree = Branch(*TREES, *[Select("w", Bin(2 + i, -4, 8, "x", Deviate("y"))) for i in range(12)], Label(**{"a'b\\": Bin(3, 0, 1, "y"), "c": Bin(5, 0, 1, "y")}))
    against_rows(messy, tree)
    whole = aggregate(messy, tree)
    parts = aggregate(messy.where("y > 0.75"), tree) + aggregate(messy.where("not coalesce(y > 0.75, false)"), tree)
    assert parts.equals(whole, 1e-9, 1e-12)
    spark.range(100).selectExpr("double(id) as x", "id as unused").write.parquet(str(tmp_path / "t"))
    plan = tidy(spark.read.parquet(str(tmp_path / "t")), Branch(*[Bin(5 + i, 0, 100, "x") for i in range(40)]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 2 and "unused" not in plan and "from_json" not in plan
    assert len(tidy(messy.where("false"), tree).where("entries > 0").take(1)) == 0


@pytest.mark.parametrize("tree", TREES, ids=[f"{i}-{t.kind}" for i, t in enumerate(TREES)])
def test_laws(messy, tree):
    from grovetally.sources import loads, to_string

    whole = aggregate(messy, tree)
    left, right = aggregate(messy.where("y > 0.75"), tree), aggregate(messy.where("not coalesce(y > 0.75, false)"), tree)
    assert (left + right).equals(whole, 1e-9, 1e-12) and (right + left).equals(whole, 1e-9, 1e-12)
    assert (whole * 0).equals(whole.zero()) and (whole * 1).equals(whole, 1e-12) and (2 * whole).equals(whole + whole, 1e-9, 1e-12)
    assert (whole + whole.zero()).equals(whole, 1e-12) and (whole * NAN).equals(whole.zero())
    again = loads(to_string(whole))
    assert to_string(again) == to_string(whole) and again.equals(loads(to_string(again)))


def test_merge_needs_one_structure(simple):
    a, b = aggregate(simple, Bin(5, -3, 7, "x")), aggregate(simple, Bin(5, -3, 8, "x"))
    with pytest.raises(MergeError):
        a + b
    with pytest.raises(MergeError):
        aggregate(simple, Sum(named("x", "a"))) + aggregate(simple, Sum(named("x", "b")))
    with pytest.raises(MergeError):
        a + aggregate(simple, Count())


def test_wrong_specs():
    for make in (lambda: Bin(0, 0, 1, "x"), lambda: Bin(2, 1, 1, "x"), lambda: SparselyBin(0, "x"), lambda: CentrallyBin([1], "x"), lambda: Bag("x", "N0"), lambda: Label()):
        with pytest.raises(ValueError):
            make()
    with pytest.raises(TypeError):
        Sum(lambda row: row.x)
    with pytest.raises(TypeError):
        Label(a=Count(), b=Sum("x"))
    with pytest.raises(ValueError):
        named(named("x", "a"), "b")


def test_weighted_variance_does_not_cancel(spark):
    df = spark.range(1000).selectExpr("1e6 + double(id % 10) / 100 as q", "double(1 + id % 7) as w", "id % 3 as g")
    rows = [(r["w"], r["q"], r["g"]) for r in df.collect()]
    r = aggregate(df, Select("w", Categorize("g", Deviate("q"))))
    for k, v in r.cut.bins.items():
        _, mean, variance, _, _ = measures([(w, q) for w, q, g in rows if str(g) == k])
        assert v.variance == pytest.approx(variance, rel=1e-6) and v.mean == pytest.approx(mean, rel=1e-13)


def test_nulls_as_zero(messy):
    assert aggregate(messy, Bin(1, -0.5, 0.5, "x"), nulls="zero").values[0].entries == 3
    assert aggregate(messy, Bin(1, -0.5, 0.5, "x")).nanflow.entries == 2


def test_one_scan_and_one_shuffle_of_rows(spark, tmp_path):
    spark.range(100).selectExpr("id as a", "double(id) as x", "string(id % 3) as s", "id as unused").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = tidy(df, Branch(Bin(5, 0, 100, "x"), Categorize("s", Deviate("x"))))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "unused" not in plan and "Python" not in plan
