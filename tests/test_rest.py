"""Views, text, JSON, sources and streams."""

import gzip
import io
import json
import math

import pytest

from grovetally import (
    Average, Bag, Bin, Branch, Categorize, Count, Deviate, Fraction, Histogram, IrregularlyBin, Label, Minimize, Profile, ProfileErr, SparselyBin, SparselyHistogram,
    SparselyProfile, SparselyProfileErr, Stack, Sum, TwoDimensionallyHistogram, TwoDimensionallySparselyHistogram, aggregate, named,
)
from grovetally.operators import views as V
from grovetally.operators.ascii import ascii
from grovetally.operators.results import Counted, Fractioned, Stacked
from grovetally.sources import JsonLog, load, loads, read_events, save, to_json, to_string
from grovetally.sources.jsonio import FormatError, register, registered


@pytest.fixture(scope="module")
def df(spark):
    return spark.range(100).selectExpr("double(id) as x", "double(id % 10) as y", "id % 2 = 0 as even").cache()


def test_views(df):
    v = V.HistogramView(aggregate(df, Histogram(5, 10, 90, "x")))
    assert v.numerical_values == [16.0] * 5 and (v.numerical_underflow, v.numerical_overflow, v.numerical_nanflow) == (10, 10, 0)
    assert v.confidence_interval_values(2.0) == [8.0] * 5 and v.edges == [10, 26, 42, 58, 74, 90]
    assert V.HistogramView(aggregate(df, SparselyHistogram(50, "x"))).numerical_values == [50, 50]
    assert V.ProfileView(aggregate(df, Profile(2, 0, 100, "x", "x"))).mean_values == [24.5, 74.5]
    assert V.ProfileView(aggregate(df, SparselyProfile(50, "x", "x"))).mean_values == [24.5, 74.5]
    p = V.ProfileErrView(aggregate(df, ProfileErr(2, 0, 100, "x", "x")))
    assert p.variance_values == pytest.approx([208.25, 208.25]) and p.error_values == pytest.approx([math.sqrt(208.25 / 50)] * 2)
    assert V.ProfileErrView(aggregate(df, SparselyProfileErr(50, "x", "x"))).variance_values == pytest.approx([208.25, 208.25])
    f = V.FractionedHistogramView(aggregate(df, Fraction("even", Histogram(4, 0, 80, "x"))))
    assert f.numerical_values == [0.5] * 4 and f.numerical_overflow == 0.5 and math.isnan(f.numerical_nanflow)
    assert f.confidence_interval_values(V.wilson_interval, 1.0)[0][1] == 0.5
    t = V.TwoDimensionalView(aggregate(df, TwoDimensionallyHistogram(2, 0, 80, "x", 3, 0, 6, "y")))
    assert t.numerical_values == [[8.0, 8.0, 8.0]] * 2 and t.numerical_overflow == 20 + 32
    assert V.TwoDimensionalView(aggregate(df, TwoDimensionallySparselyHistogram(50, "x", 5, "y"))).numerical_values == [[25, 25], [25, 25]]
    assert V.TwoDimensionalView(aggregate(df.where("x < 0"), TwoDimensionallySparselyHistogram(50, "x", 5, "y"))).numerical_values == [[]]
    s = V.StackedHistogramView(aggregate(df, Stack([50.0], "x", Histogram(2, 0, 10, "y"))))
    assert (s.low, s.high, s.num, len(s.layers)) == (0, 10, 2, 2)
    assert len(V.PartitionedHistogramView(aggregate(df, IrregularlyBin([50.0], "x", Histogram(2, 0, 10, "y")))).layers) == 2
    with pytest.raises(V.ShapeError):
        V.HistogramView(aggregate(df, Profile(2, 0, 100, "x", "x"))).numerical_values
    a, b = aggregate(df, Histogram(2, 0, 10, "y")), aggregate(df, Histogram(3, 0, 10, "y"))
    with pytest.raises(V.ShapeError):
        V.StackedHistogramView(Stacked(1.0, ((0.0, a), (1.0, b)), Counted(0.0)))


def test_builds(df):
    parts = [aggregate(df.where(c), Histogram(2, 0, 10, "y")) for c in ("x < 30", "x >= 30")]
    s = Stacked.build(*parts)
    assert [v.entries for v in s.values] == [100, 70] and s.entries == 100 and math.isnan(s.edges[0])
    assert Fractioned.build(parts[0], parts[0] + parts[1]).fraction_passing == 0.3
    with pytest.raises(ValueError):
        Fractioned.build(parts[0], Counted(1.0))


def test_text(df, tmp_path):
    drawn = ascii(aggregate(df, Histogram(4, 0, 80, "x")), 60)
    assert drawn.count("\n") == 9 and "underflow" in drawn and all(len(x) <= 62 for x in drawn.split("\n"))
    assert "+" in ascii(aggregate(df, Profile(4, -50, 80, "x", "x - 40"))) and "|" in ascii(aggregate(df, ProfileErr(4, 0, 80, "x", "x")))
    assert "nanflow" in ascii(aggregate(df, Fraction("even", Histogram(4, 0, 80, "x"))))
    assert ascii(aggregate(df, Label(a=Count(), b=Count()))).split("\n")[0].startswith("('a') -> ")
    odd = Counted(math.inf)
    r = aggregate(df, Bin(2, 0, 100, "x"))
    assert "inf" in ascii(type(r)(100.0, 0.0, 100.0, (odd, r.values[1]), r.underflow, r.overflow, r.nanflow))
    points = V.plot_points(aggregate(df, ProfileErr(2, 0, 100, "x", "x")))
    assert points[0]["center"] == 25 and points[0]["value"] == 24.5
    V.save_html(aggregate(df, Stack([50.0], "x", Histogram(2, 0, 10, "y"))), str(tmp_path / "p.html"), "t<")
    assert "t&lt;" in (tmp_path / "p.html").read_text()


def test_json_form(df):
    d = to_json(aggregate(df, Bin(2, 0, 100, named("x", "size"), Sum(named("y", "why")))))
    assert d["version"] == "1.0" and d["type"] == "Bin" and d["data"]["name"] == "size" and d["data"]["values:name"] == "why"
    assert d["data"]["values"][0] == {"entries": 50, "sum": 225} and d["data"]["underflow"] == 0 and d["data"]["nanflow:type"] == "Count"
    assert to_json(aggregate(df, Average("nullif(x, x)")))["data"]["mean"] == "nan"
    assert to_json(aggregate(df, Bag("y")))["data"]["values"][1] == {"w": 10, "v": 1}
    r = aggregate(df, SparselyBin(50, "x", Deviate(named("y", "why"))))
    assert loads(to_string(r)).equals(r, 1e-12) and to_json(r)["data"]["bins"]["1"]["mean"] == 4.5
    r = aggregate(df, Categorize("even", Count()))
    assert to_json(r)["data"]["bins"] == {"false": 50, "true": 50}
    assert to_json(aggregate(df, Branch(Count(), Sum("x"))))["data"]["data"][1]["type"] == "Sum"
    for wrong in ({"version": "2.0", "type": "Count", "data": 1}, {"version": "1.0", "type": "Nothing", "data": 1}, {"version": "1.0", "type": "Sum", "data": {"entries": 1}}, {"version": "1.0", "type": "Count", "data": "x"}, {"type": "Count", "data": 1}):
        with pytest.raises(FormatError):
            loads(json.dumps(wrong))


def test_files(df, tmp_path):
    r = aggregate(df, Histogram(4, 0, 80, "x"))
    save(r, tmp_path / "r.json")
    assert load(tmp_path / "r.json").equals(r) and load(io.StringIO(to_string(r))).equals(r)
    log = JsonLog(tmp_path / "log")
    log.append(r)
    log.append(r + r)
    assert [x.entries for x in log.results()] == [100, 200]


def test_own_container():
    from dataclasses import dataclass

    from grovetally.operators.results import Result

    @dataclass(frozen=True, eq=False)
    class Twice(Result):
        kind = "Twice"

    register("Twice", Twice, lambda r: {"entries": r.entries}, lambda d, name: Twice(d["entries"]))
    assert "Twice" in registered() and len(registered()) >= 20 and loads(to_string(Twice(2.0))).entries == 2.0


def test_own_specification(df):
    from grovetally import Spec, containers

    class Both(Spec):
        """Count and mean."""

        kind = "Both"

        def __init__(self, q):
            self.of = q

        def expand(self):
            return Branch(Count(), Average(self.of))

    r = aggregate(df, Bin(2, 0, 100, "x", Both("y")))
    assert r.values[1].i0.entries == 50 and r.values[1].i1.mean == 4.5
    assert containers()["Both"] == "Count and mean." and len(containers()) >= 20


def test_events(spark, tmp_path):
    from pyspark.sql import functions as F

    from grovetally.functions import eta, lorentz_sum, mass, phi, pt

    line = {"jets": [{"px": 3.0, "py": 4.0, "pz": 0.0, "E": 13.0, "btag": 0.5}], "muons": [], "MET": {"px": 1.0, "py": 1.0}, "numPrimaryVertices": 3}
    with gzip.open(tmp_path / "e.json.gz", "wt") as f:
        f.write(json.dumps(line) + "\n")
    e = read_events(spark, str(tmp_path / "e.json.gz"))
    jet = F.col("jets")[0]
    r = e.select(pt(jet).alias("pt"), mass(jet).alias("m"), eta(jet).alias("eta"), phi(jet).alias("phi"), mass(lorentz_sum(jet, jet)).alias("m2"), F.size("photons").alias("n")).first()
    assert (r["pt"], r["m"], r["eta"], r["m2"], r["n"]) == (5.0, 12.0, 0.0, 24.0, 0) and r["phi"] == pytest.approx(math.atan2(4, 3))
    assert aggregate(e.where(F.size("jets") > 0), Histogram(5, 0, 10, pt(jet))).cut.values[2].entries == 1


def test_stream(spark, df, tmp_path):
    from grovetally.streaming import Incremental, fill_stream

    df.repartition(4).write.parquet(str(tmp_path / "in"))
    tree = Branch(Histogram(4, 0, 80, "x"), Deviate("y"))
    seen = []
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q, running = fill_stream(source, tree, str(tmp_path / "checkpoint"), watch=seen.append)
    q.processAllAvailable()
    q.stop()
    assert len(seen) == 4 and running.result.equals(aggregate(df, tree), 1e-9)
    again = Incremental(tree)
    for number in (0, 1, 1):
        again.add(df, number)
    assert again.result.entries == 200


def test_stream_goes_on_after_a_restart(spark, df, tmp_path):
    from grovetally.streaming import fill_stream

    tree = Branch(Histogram(4, 0, 80, "x"), Deviate("y"), Categorize("string(x % 3)"), Minimize("x"))
    half = [df.where("x < 40"), df.where("not (x < 40) or x is null")]
    for part in half:
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        q, running = fill_stream(source, tree, str(tmp_path / "checkpoint"))
        q.processAllAvailable()
        q.stop()
    assert running.result.equals(aggregate(df, tree), 1e-9)


def test_stacks_from_json_add_up(df):
    from grovetally.operators.results import Stacked
    from grovetally.sources import loads, to_string

    r = aggregate(df, Histogram(4, 0, 80, "x"))
    stack = Stacked.build(r, r)
    total = loads(to_string(stack)) + loads(to_string(stack))
    assert total.entries == 2 * stack.entries and total.equals(stack + stack, 1e-12)


def test_shared_log(spark, df, tmp_path):
    from grovetally.sources import SharedJsonLog

    log, given = SharedJsonLog(spark, str(tmp_path / "log")), [aggregate(df.limit(n), Sum("x")) for n in (3, 5, 9)]
    for r in given:
        log.append(r)
    assert [r.entries for r in log.results()] == [3, 5, 9] and all(a.equals(b) for a, b in zip(log.results(), given, strict=True))


#: The text of a small histogram.
DRAWN = """\
             0                                                                2.2
             ++-----------------------------------------------------------------+
underflow 0  ||                                                                 |
[0, 1)    1  ||*****************************                                    |
[1, 2)    2  ||**********************************************************       |
overflow  0  ||                                                                 |
nanflow   0  ||                                                                 |
             ++-----------------------------------------------------------------+"""


def test_drawn_text_is_known(spark):
    from grovetally.operators.ascii import histogram as draw

    r = aggregate(spark.createDataFrame([(0.5,), (1.5,), (1.0,)], "x double"), Histogram(2, 0, 2, "x"))
    assert [x.rstrip() for x in draw(r).splitlines()] == [x.rstrip() for x in DRAWN.splitlines()]


def test_large_grids_take_no_single_task(spark):
    from grovetally import Bin, tidy

    rows = tidy(spark.range(10).selectExpr("double(id) AS x"), Bin(1500, 0, 10, "x", Bin(1500, 0, 10, "x")))
    assert rows.where("path = 'values/values'").count() == 1500 * 1500


def test_entry_without_llm(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 50
    assert set(e.oracle_sql()) <= set(e.queries())
