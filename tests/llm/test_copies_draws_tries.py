"""Exact copies, importance resampling and the prefix trie against brute force."""

import random
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute
from test_ops import AWKWARD, DOCS, SMALL

IDS = [r for r in AWKWARD if r[0] not in (10, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(AWKWARD, DOCS).cache()


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns or df.columns).collect()), key=str)


# op11

OUT = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def test_copies_on_tables(spark, small):
    from grovetally.llm import exact

    given = [(r["doc_id"], r["text"]) for r in small.collect()]
    assert rows(exact.groups(small), *OUT) == sorted(brute.exact(given), key=str)
    assert sorted(r["doc_id"] for r in exact.one_of_each(small).collect()) == sorted(r[0] for r in brute.exact(given) if r[3])


def test_copies_of_awkward_rows(spark, docs):
    from grovetally.llm import exact

    want = {(i, k, n, s) for i, k, n, _, s in brute.exact([(r[0], r[1]) for r in AWKWARD])}
    got = exact.groups(docs).collect()
    assert {(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got} == want and len(got) == len(AWKWARD)
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len({r["text_sha256"] for r in got})
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    one = rows(exact.one_of_each(docs), "doc_id")
    assert one == sorted(((r["doc_id"],) for r in got if r["kept"]), key=str)


def test_copies_without_ids_and_with_clashing_names(spark, docs):
    from grovetally.llm import exact

    odd = docs.withColumns({n: F.lit("x") for n in ("digest", "block", "places", "bits", "maybe", "n", "first", "row", "id", "at", "a.b", "kept")}).withColumn("s", F.expr("named_struct('content-type', 1)"))
    assert rows(exact.groups(odd)) == rows(exact.groups(docs))
    assert rows(exact.one_of_each(odd), "doc_id") == rows(exact.one_of_each(docs), "doc_id") and exact.one_of_each(odd).columns == odd.columns
    bare = spark.createDataFrame([(None, "a"), (None, "a "), (None, "a\t"), (None, "b")], "doc_id long, text string")
    assert Counter((r["keep_id"], r["group_size"], r["kept"]) for r in exact.groups(bare).collect()) == {(None, 1, True): 2, (None, 2, True): 1, (None, 2, False): 1}
    named = docs.select(F.col("doc_id").alias("kept"), F.concat(F.lit("k"), "doc_id").alias("key.id"), "text")
    assert exact.groups(named, id_col="kept").columns == ["kept", "keep_id", "group_size", "_kept", "text_sha256"]
    assert {r["keep_id"] for r in exact.groups(named, id_col="key.id").collect()} >= {"k1", "k7"}
    none = spark.createDataFrame([], DOCS)
    assert exact.groups(none).count() == 0 and exact.one_of_each(none).count() == 0


def test_copies_in_slices_of_the_filter(spark):
    """Rows beyond what one filter holds, a hot group, and groups on both sides of the share that is broadcast."""
    from grovetally.llm import exact

    texts = spark.range(0, 60000, 1, 8).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN concat('g ', id % 5000) ELSE concat('t ', id) END AS text")
    given = [(r["doc_id"], r["text"]) for r in texts.collect()]
    got = rows(exact.groups(texts, filter_bytes=8192), *OUT)
    assert got == sorted(brute.exact(given), key=str)
    assert exact.one_of_each(texts, filter_bytes=8192).count() == sum(r[3] for r in got)


def test_filters_let_few_single_rows_through(spark):
    from grovetally.llm import exact

    n = 100000
    keyed = spark.range(n).select(exact.digest(F.expr("string(if(id < 10000, id % 2000, id))")).alias("digest"), "id")
    (tested,) = exact._Filters(keyed.select("digest"), n, exact.FILTER_BYTES).slices(keyed)
    maybe = tested.where("maybe").select("id").toPandas()["id"]
    assert (maybe < 10000).sum() == 10000  # all that are repeated
    assert (maybe >= 10000).sum() < 0.02 * n


def test_single_rows_do_not_shuffle(spark, small):
    """The plan has one shuffle of rows: that of the rows which may be repeated, folded before it. No Python runs."""
    from grovetally.llm import exact

    plan = exact.one_of_each(small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapInArrow" not in plan and plan.count("Exchange hashpartitioning") == 1 and plan.count("BroadcastExchange") == 2


# op12


def test_resampling_on_tables(spark, small):
    from grovetally.llm import importance

    target = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    want = brute.resample([(r["doc_id"], r["text"]) for r in small.collect()], [r["text"] for r in target.collect()])
    got = {r["doc_id"]: tuple(r)[1:] for r in importance.resample(small, target).collect()}
    assert got == want and sum(v[3] is not None for v in got.values()) > 1


def test_resampling_of_awkward_rows(spark, docs):
    from grovetally.llm import importance

    given = spark.createDataFrame(IDS, DOCS)
    target = spark.createDataFrame([("alpha1 beta2 gamma",), (None,), ("",)], "text string")
    want = brute.resample([(r[0], r[1]) for r in IDS], ["alpha1 beta2 gamma"], percent=50)
    odd = given.withColumns({n: F.lit("x") for n in ("pos", "w1", "at", "b1", "bucket", "gain", "words", "a.b", "id", "rank", "least")})
    got = importance.resample(odd, target, percent=50)
    assert {r["doc_id"]: tuple(r)[1:] for r in got.collect()} == want and got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    # repeated rows and null ids have rows and ranks of their own
    twice = docs.union(docs)
    ranked = importance.resample(twice, target, percent=100).collect()
    assert len(ranked) == 2 * len(AWKWARD) and sorted(r["rank"] for r in ranked if r["rank"]) == list(range(1, 1 + sum(r["rank"] is not None for r in ranked)))
    scores = [r["score"] for r in sorted((r for r in ranked if r["rank"]), key=lambda r: r["rank"])]
    assert scores == sorted(scores, reverse=True)
    none = spark.createDataFrame([], DOCS)
    assert importance.resample(none, target).count() == 0
    assert all(r["n_features"] >= 0 for r in importance.resample(docs, none).collect())
    named = docs.select(F.col("doc_id").alias("score"), "text")
    assert importance.resample(named, target, id_col="score").columns == ["score", "n_features", "weight", "_score", "rank"]


def test_resampling_prefers_what_resembles_the_target(spark):
    from grovetally.llm import importance

    r = random.Random(8)
    like, other = ["sun moon star sky night".split(), "tax fee cost bill rate".split()]
    text = lambda words: " ".join(r.choice(words) for _ in range(60))
    docs = spark.createDataFrame([(i, text(like if i % 4 == 0 else other)) for i in range(400)], "doc_id long, text string")
    target = spark.createDataFrame([(text(like),) for _ in range(20)], "text string")
    drawn = importance.resample(docs, target, percent=20).where("rank IS NOT NULL").collect()
    assert len(drawn) == 80 and all(x["doc_id"] % 4 == 0 for x in drawn)


# op13


def nodes(df):
    return sorted(tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


TURNS = "conv_id long, turn long, role string, text string"


def talks(seed, n, fan=2):
    r = random.Random(seed)
    return [(c * 7 % n, t, r.choice("ua"), f"{r.randrange(fan)}é" * r.randrange(3)) for c in range(n) for t in range(r.randrange(9))]


@pytest.mark.parametrize("most", [1, 3, 10, 1 << 20])
def test_trie_in_shards(spark, most):
    """Whatever a shard holds, the nodes are the same: beginnings that all shards share, and a conversation that fills many."""
    from grovetally.llm import trie

    made = talks(1, 120) + [(1000 + i, t, "u", "same") for i in range(40) for t in range(3)]
    plain = {}
    for c, t, role, text in sorted(made):
        plain.setdefault(c, []).append((role, text))
    turns = spark.createDataFrame(made, TURNS)
    assert nodes(trie.prefixes(trie.labelled(turns), most)) == brute.trie(plain)


def test_trie_query_on_awkward_rows(spark, tmp_path):
    from grovetally.llm import queries

    made = talks(2, 60, 1) + [(0, None, None, None), (0, None, "u", ""), (0, 5, "u", "tie"), (0, 5, "u", "tie"), (0, 5, "a", "tie"), (None, 1, "u", "x"), (-7, 0, "u", "below"), (-5, 0, "u", "base"), (9**15, 1, "u", "far" * 9000), (77, 0, "u", "only"), (75, 1, "a", "b")]
    spark.createDataFrame(made, TURNS).withColumn("path", F.lit(1)).withColumn("a.b", F.lit(1)).write.parquet(f"{tmp_path}/conversations.parquet")
    assert nodes(queries.op13_trie(spark, str(tmp_path))) == brute.trie(brute.rebuilt(made))


def test_trie_query_on_tables(spark):
    from grovetally.llm import queries

    made = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert nodes(queries.op13_trie(spark, SMALL)) == brute.trie(brute.rebuilt(made))


def test_trie_of_nothing(spark):
    from grovetally.llm import queries, trie

    assert nodes(trie.prefixes(trie.labelled(spark.createDataFrame([], TURNS)))) == []
    assert nodes(trie.prefixes(queries.rebuilt(spark.createDataFrame([(1, 0, "u", "x")], TURNS)))) == brute.trie({1: brute.rebuilt([(1, 0, "u", "x")])[1]})


def test_level_order_bits():
    """The tree 0 -> 1, 2; 1 -> 3; 2 -> 4, 5."""
    from grovetally.llm.trie import Louds

    t = Louds(np.array([2, 1, 2, 0, 0, 0]))
    assert "".join(map(str, t.bits)) == "10" + "110" + "10" + "110" + "0" + "0" + "0"
    assert t.parents().tolist() == [-1, 0, 0, 1, 2, 2] and t.degrees().tolist() == [2, 1, 2, 0, 0, 0]


# columns that are only passed through, in every operator that passes them


def test_odd_columns_pass_through(spark, docs, tmp_path):
    """Names with dots, backticks and spaces, fields with hyphens, maps of structs."""
    import corpus_pipeline
    from grovetally.llm import decontam, jaccard, mixing, pii, toxicity

    odd = {"a.b": F.lit(1), "c`d": F.lit("x"), "e f": F.expr("named_struct('content-type', 'x', 'g.h', array(1))"), "text.x": F.expr("map('k.l', named_struct('m-n', 2D))")}
    table = docs.withColumns(odd)
    labels = spark.createDataFrame([(7, 1), (11, 0), (12, 0)], "doc_id long, toxic int")
    items = spark.createDataFrame([(1, "nothing like this stands in any of them")], "item_id long, text string")
    keep = tuple(table.columns)
    model = toxicity.train(table, labels)
    sides = lambda df: sorted(map(str, df.select(*[f"`{c.replace('`', '``')}`" for c in keep]).collect()))
    want = sides(table)
    assert sides(toxicity.score(table, model, keep)) == want and sides(decontam.matches(table, items, keep)) == want and sides(mixing.mix(table, keep=keep)) == want
    assert pii.redact(table).columns == list(keep) and jaccard.one_of_each(table).columns == list(keep)
    assert jaccard.one_of_each(table).count() == jaccard.one_of_each(docs).count()
    table.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, got, str(tmp_path))
        assert got.columns == list(keep)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_which_of_rows_with_one_id_and_class_stays_is_settled(spark):
    """Texts of one set of shingles under one id: the same one stays however the rows are dealt."""
    from grovetally.llm import jaccard

    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text + " " * i, i) for i in range(30)] + [(2, text, 99)]
    stays = set()
    for parts in (1, 3, 7):
        got = jaccard.one_of_each(spark.createDataFrame(rows[parts:] + rows[:parts], "doc_id long, text string, n long").repartition(parts)).collect()
        assert len(got) == 1
        stays.add(got[0]["n"])
    assert len(stays) == 1 and stays != {99}
