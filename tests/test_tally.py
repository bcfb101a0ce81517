"""Mergeable rows, logs of results, streams with state on the executors, and searches of many edges."""

import bisect
import math
import os
import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from filler import fill

from grovetally import (
    Average, Bag, Bin, Branch, Categorize, CentrallyBin, Count, Deviate, Fraction, Index, IrregularlyBin, Label, Maximize, Minimize, Select, SparselyBin, Stack,
    Sum, UntypedLabel, aggregate, merge, named, tally, tidy, zero_of,
)
from grovetally.operators import shape as H
from grovetally.operators.results import MergeError
from grovetally.plans.tally import from_tidy, load, logged
from grovetally.sources import TallyLog

#: Every container, with weights, names, flows and cumulative bins over each other.
TREE = UntypedLabel(
    count=Count(), squares=Select("w", Count(lambda w: w * w)), sum=Sum(named("x", "the x")), average=Select("w", Average("x")), deviate=Deviate("x"), weighted=Select("w", Deviate("x")),
    least=Minimize("x"), most=Maximize("x"), bag=Bag("x"), letters=Bag("s", "S"), pairs=Bag("array(double(k), 1D)", "N2"),
    bins=Bin(4, -2, 2, "x", Deviate("y"), Sum("y"), Average("y"), Count()), sparse=SparselyBin(0.5, "x", Minimize("y"), origin=0.1), near=CentrallyBin([-1, 2, 0.5, 3], "x", Maximize("y")),
    edges=IrregularlyBin([-1, 0, 1.5], "x", Bag("s", "S")), stack=Stack([-1, 0, 1.5], "x", Stack([0, 1], "y", Deviate("x"))), cats=Categorize("s", Stack([0, 1], "y", Categorize("k"))),
    part=Fraction("x > 0", Stack([0.0], "y")), several=Label(a=Sum("x"), b=Sum("y")), index=Index(Count(), Count()), branch=Branch(Count(), Sum("y")),
)


#: Fewer chains, for tests of how results are kept.
LESS = UntypedLabel(cats=Categorize("s", Deviate(named("x", "the x"))), stack=Stack([-1, 0, 1.5], "x", Stack([0, 1], "y", Deviate("x"))), bins=Bin(4, -2, 2, "x", Select("w", Count(lambda w: w * w))))


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(3)
    odd = [float("nan"), None, 0.0, -0.0, 1.5, -1.0, 2.0]
    made = [(i, r.choice(odd) if r.random() < 0.2 else r.gauss(0, 1), r.gauss(0.3, 1), r.choice([None, 0.0, -1.0, 0.5, 2.0, 3.0]), r.choice(["a", "b", "ü", None])) for i in range(400)]
    return spark.createDataFrame(made, "k long, x double, y double, w double, s string").withColumn("k", F.expr("k % 7")).cache()


def halves(rows, n=3):
    return [rows.where(f"pmod(xxhash64(*), {n}) = {i}") for i in range(n)]


def test_the_sum_of_parts_is_the_whole(rows):
    assert merge([tally(x, TREE) for x in halves(rows)]).result().equals(aggregate(rows, TREE), rel=1e-11, abs_=1e-11)


def test_rows_obey_the_laws_of_trees(rows):
    t, tree = tally(rows, LESS), aggregate(rows, LESS)
    assert (t * 0).result() == zero_of(LESS) and (t * float("nan")).result() == zero_of(LESS) and t.zero().result() == zero_of(LESS)
    assert (2.5 * t).result().equals(tree * 2.5, rel=1e-11, abs_=1e-11) and (t + t).result().equals((t * 2).result(), rel=1e-11, abs_=1e-11)
    assert (t + t.zero()).result().equals(tree, rel=1e-11, abs_=1e-11)
    parts = [tally(x, LESS) for x in halves(rows)]
    for got in (parts[2] + parts[0] + parts[1], (parts[0] + parts[1]).compact() + parts[2]):
        assert got.result().equals(tree, rel=1e-11, abs_=1e-11)
    assert sum((p.result() for p in parts[1:]), parts[0].result()).equals(tree, rel=1e-11, abs_=1e-11)


def test_tidy_rows_of_a_tally_are_those_of_the_tree(rows):
    table = lambda df: {(r["path"], tuple(r["keys"])): [-7.25 if r[c] is None else r[c] for c in ("entries", "sum", "mean", "variance", "min", "max")] for r in df.collect()}
    for dense in (True, False):
        got, want = table(tally(rows, TREE).tidy(dense)), table(tidy(rows, TREE, dense=dense))
        assert got.keys() == want.keys()
        for k, values in want.items():
            assert got[k] == pytest.approx(values, rel=1e-11, abs=1e-11, nan_ok=True), k


def test_no_rows(spark, rows):
    none = tally(rows.limit(0), LESS)
    assert none.rows.count() == 0 and none.result() == zero_of(LESS)
    assert (none + tally(rows, LESS)).result().equals(aggregate(rows, LESS), rel=1e-12)


def test_structures():
    d = H.shape(TREE)
    again = H.spec_of(d)
    assert H.shape(again) == d and zero_of(again) == zero_of(TREE)
    H.agree(d, H.shape(again))


@pytest.mark.parametrize("other, said", [
    (Select("y", Bin(4, 0, 2, "x")), "at 'data', high differs"), (Select("y", Bin(4, 0, 1, named("x", "n"))), "at 'data', name differs"), (Select("y", Bin(4, 0, 1, "x", Sum("x"))), "at 'data/values', kind differs"), (Branch(Count()), "at the top, kind differs"),
])
def test_structures_that_differ_cannot_be_added(rows, other, said):
    with pytest.raises(MergeError, match=said):
        tally(rows, Select("x", Bin(4, 0, 1, "x"))) + tally(rows, other)


def test_saved_tallies_fold_by_node(spark, rows, tmp_path):
    """No task holds a table of all nodes in the files that it reads, and what is filled is not folded again to be saved."""
    path = f"file://{tmp_path}/saved"
    parts = [tally(x, LESS) for x in halves(rows)]
    assert parts[0].compact() is parts[0] and (2 * parts[0]).single and not (parts[0] + parts[1]).single
    for p in parts:
        p.append(path)
    for t in (load(spark, path), 2 * load(spark, path)):
        plan = t.compact().rows._jdf.queryExecution().executedPlan().toString()
        assert "Aggregate" in plan and "Exchange hashpartitioning(path" in plan
        assert "Aggregate" not in plan[plan.rindex("Exchange hashpartitioning") :]
        assert t.compact().compact().single
    assert (load(spark, path) + parts[0]).result().equals(merge([*parts, parts[0]]).result(), rel=1e-11, abs_=1e-11)


def test_saved_rows(spark, rows, tmp_path):
    path = f"file://{tmp_path}/saved"
    parts = [tally(x, LESS) for x in halves(rows)]
    parts[0].save(path)
    for p in parts[1:]:
        p.append(path)
    assert load(spark, path).result().equals(aggregate(rows, LESS), rel=1e-11, abs_=1e-11)
    with pytest.raises(MergeError):
        tally(rows, Count()).append(path)
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        parts[0].save(path)
    rows.write.parquet(f"{path}-other")
    with pytest.raises(ValueError, match="no saved tally"):
        load(spark, f"{path}-other")
    # what is appended first makes the folder
    parts[0].append(f"{path}-new")
    assert load(spark, f"{path}-new").result().equals(parts[0].result(), rel=1e-12)


def test_adding_shuffles_nothing_before_the_end(rows):
    plan = merge([tally(x, Categorize("s", Deviate("x"))) for x in halves(rows, 4)]).rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Union") == 1 and plan.count("Aggregate") == 8  # two for each part, none above the union


# logs


def test_log(spark, rows, tmp_path):
    path = f"file://{tmp_path}/log"
    parts = [tally(x, LESS) for x in halves(rows)]
    for p in parts:
        p.log(path)
    whole = aggregate(rows, LESS)
    assert logged(spark, path, "all").result().equals(whole, rel=1e-11, abs_=1e-11)
    assert logged(spark, path, 1).result().equals(parts[1].result(), rel=1e-11, abs_=1e-11)
    assert (logged(spark, path, 0) + parts[1] + parts[2]).result().equals(whole, rel=1e-11, abs_=1e-11)
    table = spark.read.format("tally_log").load(path)
    assert sorted(r[0] for r in table.select("entry").distinct().collect()) == [0, 1, 2]
    assert table.rdd.getNumPartitions() == len(os.listdir(f"{tmp_path}/log/rows"))
    since = spark.read.format("tally_log").option("since", 1).option("until", 1).load(path)
    assert [r[0] for r in since.select("entry").distinct().collect()] == [1]
    with pytest.raises(ValueError, match="no entry"):
        logged(spark, path, 7)
    tally(rows, Count()).log(path)
    with pytest.raises(MergeError):
        logged(spark, path, "all")
    with pytest.raises(ValueError, match="summed"):
        logged(spark, path, 0).save(f"{path}-tally")
    parts[0].log(path, replace=True)
    assert [r[0] for r in spark.read.format("tally_log").load(path).select("entry").distinct().collect()] == [4]


def test_tidy_rows_give_the_tally_back(rows):
    t = tally(rows, TREE)
    kinds = t.rows.select("path", "kind").distinct()
    assert from_tidy(t.tidy(dense=False).join(kinds, "path"), t.structure).result().equals(t.result(), rel=1e-11, abs_=1e-11)


def test_a_failed_write_leaves_nothing_to_see(spark, rows, tmp_path):
    path = f"file://{tmp_path}/log"
    tally(rows, Categorize("s")).log(path)
    columns = [f"double(NULL) AS {c}" for c in ("sum", "mean", "variance", "min", "max")]
    bad = spark.range(0, 1000, 1, 4).selectExpr("'a' AS path", "'Count' AS kind", "array(string(id)) AS keys", "IF(id = 999, raise_error('lost'), 1D) AS entries", *columns)
    with pytest.raises(Exception, match="lost"):
        bad.write.format("tally_log").option("path", path).mode("append").save()
    assert os.listdir(f"{tmp_path}/log/entries") == [f"{0:020d}.json"]
    assert logged(spark, path, "all").result() == aggregate(rows, Categorize("s"))


def test_an_empty_log_and_an_empty_result(spark, rows, tmp_path):
    spark.dataSource.register(TallyLog)
    assert spark.read.format("tally_log").load(f"file://{tmp_path}/none").count() == 0
    tally(rows.limit(0), Count()).log(f"file://{tmp_path}/none")
    assert logged(spark, f"file://{tmp_path}/none").result() == zero_of(Count())


def test_a_watcher_sees_each_result_once(spark, rows, tmp_path):
    spark.dataSource.register(TallyLog)
    path, seen = f"file://{tmp_path}/log", []

    def watch():
        stream = spark.readStream.format("tally_log").load(path).where("path = ''")
        q = stream.writeStream.foreachBatch(lambda b, n: seen.extend((r["entry"], r["entries"]) for r in b.collect())).option("checkpointLocation", f"{path}-watch").trigger(availableNow=True).start()
        q.awaitTermination()

    for i in range(3):
        tally(rows.limit(10 * (i + 1)), Count()).log(path)
        watch()
    watch()
    assert seen == [(0, 10.0), (1, 20.0), (2, 30.0)]


# streams


def test_stream_state(spark, rows, tmp_path, monkeypatch):
    from grovetally.streaming import Store, fill_store, stateful

    monkeypatch.setattr(stateful, "BATCHES", 2)
    files, store, checkpoint = f"file://{tmp_path}/files", f"file://{tmp_path}/store", f"file://{tmp_path}/state"
    names, watched = [], []
    for part in halves(rows, 4):  # started again with new files each time
        part.coalesce(1).write.mode("append").parquet(files)
        q = fill_store(spark.readStream.schema(rows.schema).parquet(files), LESS, store, checkpoint, watch=watched.append)
        q.processAllAvailable()
        assert "StateStoreSave" in q._jsq.explainInternal(False)
        q.stop()
        names.append(sorted(n[:5] for n in os.listdir(f"{tmp_path}/store")))
    assert names == [["batch"], ["batch", "batch"], ["whole"], ["batch", "whole"]] and len(watched) == 4
    got, whole = Store(spark, store).tally(), aggregate(rows, LESS)
    assert got.result().equals(whole, rel=1e-11, abs_=1e-11)
    # a batch that comes again changes nothing
    Store(spark, store, H.shape(LESS)).write(got.rows.withColumn("entries", F.lit(1e9)), 3)
    assert Store(spark, store).tally().result().equals(whole, rel=1e-11, abs_=1e-11)
    # one that failed in the middle is replaced
    os.remove(f"{tmp_path}/store/batch-000000000003/_SUCCESS")
    assert not Store(spark, store).tally().result().equals(whole, rel=1e-3)
    Store(spark, store, H.shape(LESS)).write(got.rows, 3)
    assert Store(spark, store).tally().result().equals(whole, rel=1e-11, abs_=1e-11)
    with pytest.raises(MergeError):
        fill_store(spark.readStream.schema(rows.schema).parquet(files), Count(), store, checkpoint)
    with pytest.raises(ValueError, match="no batch"):
        Store(spark, f"{store}-none").tally()


def test_stream_updates_in_complete_mode(spark, rows, tmp_path):
    from grovetally.plans import Tally
    from grovetally.streaming import updates

    files = f"file://{tmp_path}/files"
    rows.write.parquet(files)
    q = updates(spark.readStream.schema(rows.schema).parquet(files), TREE).writeStream.format("memory").queryName("complete_states").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert Tally(spark.table("complete_states"), H.shape(TREE)).result().equals(aggregate(rows, TREE), rel=1e-11, abs_=1e-11)


# searches


def cuts_of(kind, r):
    if kind == "even":
        return [0.1 * i for i in range(300)]
    if kind == "wide":
        return [2.0**i for i in range(-100, 100)]
    if kind == "equal":
        return [1.0] * 50 + [2.0] * 50
    if kind == "one":
        return [1.5] * 40
    if kind == "tiny":
        return [1.0 + i * 5e-324 for i in range(40)] + [i * 5e-324 for i in range(40)]
    return [r.gauss(0, 1) for _ in range(500)] + [float("inf"), float("-inf"), 0.0, -0.0]


@pytest.mark.parametrize("kind", ["even", "wide", "equal", "one", "tiny", "random"])
def test_search_finds_every_bin(spark, kind):
    r = random.Random(kind)
    cuts = cuts_of(kind, r)
    asked = cuts + [math.nextafter(c, s * math.inf) for c in cuts[:100] for s in (1, -1)] + [r.uniform(-5, 40) for _ in range(200)] + [math.inf, -math.inf, math.nan, 1e308, -1e308]
    df = spark.createDataFrame([(float(x),) for x in asked], "x double")
    edges = sorted(set(cuts) | {-math.inf})
    want: dict = {}
    for x in asked:
        if x == x:
            i = bisect.bisect_right(edges, x) - 1
            want[(str(i),)] = want.get((str(i),), 0) + 1
    got = {tuple(r["keys"]): r["entries"] for r in tidy(df, IrregularlyBin(cuts, "x"), dense=False).where("path = 'bins' AND entries > 0").collect()}
    assert got == want
    assert tidy(df, IrregularlyBin(cuts, "x")).where("path = 'nanflow'").first()["entries"] == 1


def test_search_takes_centers_in_their_order(spark):
    r = random.Random(5)
    centers = [r.gauss(0, 3) for _ in range(200)]
    made = [{"x": r.gauss(0, 4)} for _ in range(1000)] + [{"x": (a + b) / 2} for a, b in zip(centers, centers[1:])]
    spec = CentrallyBin(centers, "x")
    want = {tuple(map(str, k)): v["entries"] for k, v in fill(spec, made)["bins"].items()}
    df = spark.createDataFrame([(m["x"],) for m in made], "x double")
    assert {tuple(r["keys"]): r["entries"] for r in tidy(df, spec, dense=False).where("path = 'bins'").collect()} == want


def test_search_takes_few_steps(spark):
    from grovetally.plans import lower

    df = spark.range(1).selectExpr("double(id) AS x")
    assert len(lower(df, IrregularlyBin(range(4000), "x")).steps) <= 6
    assert len(lower(df, IrregularlyBin([2.0**i for i in range(-900, 900)], "x")).steps) <= 15
    assert lower(df, IrregularlyBin(range(20), "x")).steps == []


def test_stack_grows_with_its_result(spark):
    """No step makes a row for each pair of a bin and a threshold."""
    df = spark.range(3000).selectExpr("double(id % 997) AS x", "string(id % 5) AS s")
    spec = Stack(range(2000), "x", Categorize("s", Deviate("x")))
    got = tidy(df, spec, dense=False).where("path = 'bins/bins'").collect()
    want: dict = {}
    for i in range(3000):
        for t in range(-1, i % 997 + 1):
            want.setdefault((t, i % 5), []).append(i % 997)
    assert len(got) == len(want)
    for r in got:
        values = want[int(r["keys"][0]) - 1, int(r["keys"][1])]
        mean = sum(values) / len(values)
        assert r["entries"] == len(values) and r["mean"] == pytest.approx(mean) and r["variance"] == pytest.approx(sum((v - mean) ** 2 for v in values) / len(values), abs=1e-6)


# Python functions


def test_functions_of_columns(rows):
    import numpy as np

    def side(x, s):
        return None if s is None else f"{s}{'+' if x is not None and x > 0 else '-'}"

    got = aggregate(rows, Branch(Categorize(side, Sum(lambda y: y * 2)), Select(lambda k: k > 3, Count()), Sum(named(lambda y, k: y if k else None, "some"))))
    made = rows.collect()
    want: dict = {}
    for r in made:
        want.setdefault("NaN" if r["s"] is None else f"{r['s']}{'+' if r['x'] is not None and r['x'] > 0 else '-'}", []).append(2 * r["y"])
    assert {k: (v.entries, pytest.approx(v.sum)) for k, v in got.i0.bins.items()} == {k: (len(v), sum(v)) for k, v in want.items()}
    assert got.i1.cut.entries == sum(r["k"] > 3 for r in made) and math.isnan(got.i2.sum) and got.i2.name == "some"
    for wrong in (lambda: 1.0, lambda *columns: 1.0, lambda row: row.x):
        with pytest.raises(TypeError):
            Sum(wrong)
    assert np.isclose(aggregate(rows, Sum(lambda y: y), "zero").sum, sum(r["y"] for r in made))
