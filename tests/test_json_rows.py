"""The JSON of large results, against that of trees and golden text."""

import json
import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from test_tally import LESS, TREE, rows  # noqa: F401

from grovetally import (
    Average, Bag, Bin, Branch, Categorize, CentrallyBin, Count, Deviate, Fraction, Index, IrregularlyBin, Label, Maximize, Minimize, Select, SparselyBin, Stack,
    Sum, UntypedLabel, aggregate, named, tally,
)
from grovetally.operators import shape as H
from grovetally.plans.tally import from_tidy
from grovetally.sources import loads, to_json, to_string
from grovetally.sources.json_rows import decode, encode, read_json, write_json


def document(path):
    return "\n".join(Path(path, f).read_text() for f in sorted(os.listdir(path)) if f.startswith("part-"))


def near(a, b, path=""):
    if isinstance(b, dict):
        assert list(a) == list(b), path
        for k in b:
            near(a[k], b[k], f"{path}/{k}")
    elif isinstance(b, list):
        assert len(a) == len(b), path
        for i, (x, y) in enumerate(zip(a, b)):
            near(x, y, f"{path}/{i}")
    else:
        assert a == (b if isinstance(b, str) else pytest.approx(b, rel=1e-11, abs=1e-11)), path


@pytest.mark.parametrize("tree", [TREE, LESS], ids=["all", "less"])
def test_the_document_is_that_of_the_tree(spark, rows, tmp_path, tree):  # noqa: F811
    t = tally(rows, tree)
    write_json(t, f"file://{tmp_path}/doc")
    text = document(f"{tmp_path}/doc")
    near(json.loads(text), json.loads(json.dumps(to_json(t.result()))))
    assert loads(text).equals(t.result(), rel=1e-11, abs_=1e-11)
    assert read_json(spark, f"file://{tmp_path}/doc").result().equals(t.result(), rel=1e-11, abs_=1e-11)


#: Text for x = 1, 2.5 and s = "a", "b\"": what the format prescribes for each type.
GOLDEN = [
    (Count(), "2"),
    (Sum(named("x", "q")), '{"entries": 2, "sum": 3.5, "name": "q"}'),
    (Average("x"), '{"entries": 2, "mean": 1.75}'),
    (Deviate("x"), '{"entries": 2, "mean": 1.75, "variance": 0.5625}'),
    (Minimize("x"), '{"entries": 2, "min": 1}'),
    (Maximize("x"), '{"entries": 2, "max": 2.5}'),
    (Bag("x"), '{"entries": 2, "values": [{"w": 1, "v": 1}, {"w": 1, "v": 2.5}], "range": "N"}'),
    (Bag("s", "S"), '{"entries": 2, "values": [{"w": 1, "v": "a"}, {"w": 1, "v": "b\\""}], "range": "S"}'),
    (Bag("array(-x, double('Infinity'))", "N2"), '{"entries": 2, "values": [{"w": 1, "v": [-2.5, "inf"]}, {"w": 1, "v": [-1, "inf"]}], "range": "N2"}'),
    (Bin(2, 0, 2, named("x", "q"), Sum(named("x", "in"))), '{"entries": 2, "low": 0, "high": 2, "values:type": "Sum", "values": [{"entries": 0, "sum": 0}, {"entries": 1, "sum": 1}], "underflow:type": "Count", "underflow": 0, "overflow:type": "Count", "overflow": 1, "nanflow:type": "Count", "nanflow": 0, "values:name": "in", "name": "q"}'),
    (SparselyBin(1.5, "x - 3"), '{"entries": 2, "binWidth": 1.5, "bins:type": "Count", "bins": {"-2": 1, "-1": 1}, "nanflow:type": "Count", "nanflow": 0, "origin": 0}'),
    (CentrallyBin([0, 1, 4], "x"), '{"entries": 2, "bins:type": "Count", "bins": [{"center": 0, "data": 0}, {"center": 1, "data": 1}, {"center": 4, "data": 1}], "nanflow:type": "Count", "nanflow": 0}'),
    (IrregularlyBin([2], "x"), '{"entries": 2, "bins:type": "Count", "bins": [{"atleast": "-inf", "data": 1}, {"atleast": 2, "data": 1}], "nanflow:type": "Count", "nanflow": 0}'),
    (Stack([2], "x"), '{"entries": 2, "bins:type": "Count", "bins": [{"atleast": "-inf", "data": 2}, {"atleast": 2, "data": 1}], "nanflow:type": "Count", "nanflow": 0}'),
    (Categorize("s", Bin(1, 0, 2, "x")), '{"entries": 2, "bins:type": "Bin", "bins": {"a": {"entries": 1, "low": 0, "high": 2, "values:type": "Count", "values": [1], "underflow:type": "Count", "underflow": 0, "overflow:type": "Count", "overflow": 0, "nanflow:type": "Count", "nanflow": 0}, "b\\"": {"entries": 1, "low": 0, "high": 2, "values:type": "Count", "values": [0], "underflow:type": "Count", "underflow": 0, "overflow:type": "Count", "overflow": 1, "nanflow:type": "Count", "nanflow": 0}}}'),
    (Fraction("x > 2", Sum(named("x", "q"))), '{"entries": 2, "sub:type": "Sum", "numerator": {"entries": 1, "sum": 2.5}, "denominator": {"entries": 2, "sum": 3.5}, "sub:name": "q"}'),
    (Select(named("x > 2", "cut"), Average("double('Infinity')")), '{"entries": 2, "sub:type": "Average", "data": {"entries": 1, "mean": "inf"}, "name": "cut"}'),
    (Label(a=Count(), b=Count()), '{"entries": 2, "sub:type": "Count", "data": {"a": 2, "b": 2}}'),
    (UntypedLabel(a=Count(), b=Minimize("sqrt(-x)")), '{"entries": 2, "data": {"a": {"type": "Count", "data": 2}, "b": {"type": "Minimize", "data": {"entries": 2, "min": "nan"}}}}'),
    (Index(Count(), Count()), '{"entries": 2, "sub:type": "Count", "data": [2, 2]}'),
    (Branch(Count(), Sum("x")), '{"entries": 2, "data": [{"type": "Count", "data": 2}, {"type": "Sum", "data": {"entries": 2, "sum": 3.5}}]}'),
]


@pytest.fixture(scope="module")
def two(spark):
    return spark.createDataFrame([(1.0, "a"), (2.5, 'b"')], "x double, s string")


@pytest.mark.parametrize("spec, data", GOLDEN, ids=[f"{s.kind}{i}" for i, (s, _) in enumerate(GOLDEN)])
def test_golden_text(spark, two, spec, data):
    want = f'{{"version": "1.0", "type": "{spec.kind}", "data": {data}}}'
    t = tally(two, spec)
    pieces = encode(t).orderBy("place", "numbers").collect()
    assert "".join(r["text"] for r in pieces) == want
    assert json.loads(to_string(aggregate(two, spec))) == json.loads(want)
    docs = spark.createDataFrame([(want, 1), (None, 2)], "doc string, day int")
    rows = decode(docs, t.structure, keep=("day",))
    assert {r["day"] for r in rows.collect()} == {1}
    assert from_tidy(rows, t.structure).result() == loads(want)


def test_documents_of_a_day_each_are_added(spark, rows):  # noqa: F811
    """A table of documents, as a log of other programs holds them, is a table of results."""
    texts = [to_string(aggregate(rows.where(f"k % 2 = {i}"), LESS)) for i in range(2)]
    docs = spark.createDataFrame([(x,) for x in texts], "doc string")
    # the squares of weights are a plain Count in JSON
    structure = H.shape(LESS)
    assert from_tidy(decode(docs, structure), structure).result().equals(aggregate(rows, LESS), rel=1e-11, abs_=1e-11)


def test_other_documents_are_errors(spark):
    docs = lambda x: spark.createDataFrame([(x,)], "doc string")
    with pytest.raises(Exception, match="no Sum"):
        decode(docs('{"version": "1.0", "type": "Count", "data": 3}'), H.shape(Sum("x"))).collect()
    with pytest.raises(Exception, match="no number at 'data'"):
        decode(docs('{"version": "1.0", "type": "Select", "data": {"entries": 3, "sub:type": "Sum", "data": {"entries": 3}}}'), H.shape(Select("x", Sum("x")))).collect()
    with pytest.raises(Exception, match="MALFORMED|malformed|JSON"):
        decode(docs("{"), H.shape(Count())).collect()


def test_many_categories(spark, tmp_path):
    """More bins than a task writes at once; commas stand between them all, whatever range a bin falls in."""
    df = spark.range(0, 100000, 1, 8).selectExpr("concat('key ', id % 50000, if(id % 1000 = 0, '\"\\\\', '')) AS s")
    write_json(tally(df, Categorize("s", Categorize("substr(s, 1, 5)"))), f"file://{tmp_path}/doc")
    got = json.loads(document(f"{tmp_path}/doc"))["data"]
    assert got["entries"] == 100000 and len(got["bins"]) == 50000
    assert read_json(spark, f"file://{tmp_path}/doc").rows.where("path = 'bins/bins'").selectExpr("count(*)", "sum(entries)").first()[:] == (50000, 100000.0)


#: Bins that data decide and bins that are there anyway, above and below each other, beside leaves of the same form.
NESTED = UntypedLabel(
    cats=Categorize("s", Bin(3, -1, 1, "x", Categorize("s", Branch(Count(), Sum("y"))))), bins=Bin(2, -1, 1, "x", SparselyBin(1.0, "y", CentrallyBin([0, 1], "x", Bag("s", "S")))),
    items=Categorize("s", Bag("array(double(k), 1D)", "N2")), again=Categorize("s", Count()), last=Bag("x"),
)


def test_documents_are_read_by_line(spark, rows, tmp_path, monkeypatch):  # noqa: F811
    """No task gets a document, or more of it than a file; what was open before a file is known in it."""
    from grovetally.sources import json_rows

    def refused(*args):
        raise AssertionError("the whole document")

    monkeypatch.setattr(json_rows, "_LINES", 7)
    odd = "concat(s, if(k = 1, '\": {\"entries\": 5, \\\\ : 7\u2028', if(k = 2, '\\n\": 12', '')))"
    rows = rows.withColumn("s", F.expr(odd))
    for i, tree in enumerate((NESTED, Count(), Bin(2, -1, 1, named("x", "q"), Deviate("y")), Categorize("s", Minimize("sqrt(-x)")))):
        t, path = tally(rows, tree), f"{tmp_path}/doc{i}"
        write_json(t, f"file://{path}")
        near(json.loads(document(path)), json.loads(json.dumps(to_json(t.result()))))
        with monkeypatch.context() as m:
            m.setattr(json_rows, "decode", refused)
            assert read_json(spark, f"file://{path}").result().equals(t.result(), rel=1e-11, abs_=1e-11)
    assert len([f for f in os.listdir(f"{tmp_path}/doc0") if f.startswith("part-")]) > 50
    # another structure, and one that is not indented, are read whole
    with pytest.raises(Exception, match="no Sum"):
        read_json(spark, f"file://{tmp_path}/doc1", H.shape(Sum("x"))).rows.collect()
    os.remove(f"{tmp_path}/doc0/_lines.json")
    assert read_json(spark, f"file://{tmp_path}/doc0").result().equals(tally(rows, NESTED).result(), rel=1e-11, abs_=1e-11)
