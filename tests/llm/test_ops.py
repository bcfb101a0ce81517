"""Every operator and the pipeline against brute force, on awkward rows and on the smallest tables."""

import math
import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


LONG = prose(1, 30000)
BASE = prose(2, 120)
EDITED = " ".join(["changed" if i == 60 else w for i, w in enumerate(BASE.split())])
FAR = " ".join(["changed" if i % 12 == 0 else w for i, w in enumerate(BASE.split())])
AWKWARD = [
    (1, None, "en", "a", None), (2, "", None, None, 0), (3, "  \n\t ", "en", "a", 5), (4, "one", "en", "b", 3), (5, "One", "en", "b", 3), (6, LONG, "en", "a", len(LONG)),
    (7, BASE, "en", "a", 1), (8, BASE.upper(), "en", None, 1), (9, EDITED, "de", "b", 1), (10, FAR, "de", "b", 1), (10, FAR, "de", "b", 1), (None, BASE, "en", "c", 1),
    (11, "a b c d", "en", "c", 1), (12, "a b c d e", "en", "c", 1), (13, "write to x.y@mail.example.com or +1 (555) 010-2233, ip 10.0.0.1 and 300.1.1.1, card 4111 1111 1111 1111", "en", "c", 1),
    (14, "é ü  ß 日本語 \U0001f600 mail ö@ü.de a@b.c_d@e.fg", "en", "\U0001f600", 1), (15, "x\ny\nx\n\nx z\n" * 3, "en", "c", 1), (16, "1.2.3.4.5.6.7.8 4111111111111112 +49 30 1234567 " + "9" * 3000, "en", "c", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(AWKWARD, DOCS).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def clash(docs):
    """Extra columns with names that operators use inside."""
    names = ["size", "cls", "label", "kept", "items", "n", "row", "word", "pii", "target", "contaminated", "toxic", "severity", "key", "id", "rare"]
    names += ["read_text", "found_items", "taken", "copies", "source_size", "bucket", "layout", "turns", "formatted", "held_out", "ids", "score", "payload", "grade", "rows", "pii_text", "digest", "perplexity"]
    return docs.withColumns({n: F.lit("x") for n in names})


def rows(df):
    return [tuple(r) for r in df.collect()]


# op1


@pytest.mark.parametrize("which", ["docs", "small", "clash"])
def test_mix(which, request):
    from grovetally.llm.mixing import mix

    df = request.getfixturevalue(which)
    given = [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]
    expected = brute.mix_targets(given)
    got = mix(df, keep=("doc_id", "source")).collect()
    assert sorted((str(i), len(brute.words(t))) for i, t, _ in given) == sorted((str(r["doc_id"]), r["size"]) for r in got)
    took, most = {}, {}
    for r in got:
        size, target = expected[r["source"]]
        assert r["source_size"] == size and r["target"] == pytest.approx(target, rel=1e-9) and 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["size"] * r["copies"]
        took[r["source"]] = took.get(r["source"], 0) + r["taken"]
        most[r["source"]] = max(most.get(r["source"], 0), r["size"])
    largest = max(most.values())
    for s, (_, target) in expected.items():
        assert abs(took[s] - target) <= most[s] + largest * 0.5 + 1
    assert sorted(map(tuple, got), key=str) == sorted(rows(mix(df, keep=("doc_id", "source"))), key=str)


@pytest.mark.parametrize("which", ["docs", "small"])
def test_mix_is_a_fair_queue(which, request):
    """Which copies the mix takes, against one queue over all copies."""
    from grovetally.llm.mixing import mix

    df = request.getfixturevalue(which)
    given = [(r["key"], r["doc_id"], len(brute.words(r["text"])), r["source"]) for r in df.select("doc_id", "text", "source", F.xxhash64(F.lit(17), "doc_id").alias("key")).collect()]
    expected = brute.fair_queue(given, brute.mix_targets([(r["doc_id"], r["text"], r["source"]) for r in df.collect()]))
    got = sorted(((str(r["doc_id"]), r["size"], r["copies"]) for r in mix(df).collect()))
    assert got == expected


def test_mix_keeps_columns_whatever_their_names(clash):
    from grovetally.llm.mixing import mix

    got = mix(clash, keep=("doc_id", "size", "taken", "copies", "target"))
    assert got.columns == ["doc_id", "size", "taken", "copies", "target", "_size", "source_size", "_target", "_taken", "_copies"]
    assert got.count() == len(AWKWARD) and {r["size"] for r in got.collect()} == {"x"}
    from grovetally.llm import queries

    assert queries.op1_mix(clash.sparkSession, SMALL).columns[:5] == ["doc_id", "size", "source_size", "target", "taken"]


def test_mix_of_sources_with_one_document(spark):
    """Their copies all end at one of two times; the cut among them is made over ranges and in the order of the keys."""
    from grovetally.llm.mixing import mix

    given = [(i, "a b c", f"s{i:05d}") for i in range(4000)] + [(4000 + i, "a " * 50, "big") for i in range(40)]
    rows = mix(spark.createDataFrame(given, "doc_id long, text string, source string"), weigh=lambda rank: F.lit(1.0), share=1.2).collect()
    total, budget = sum(r["taken"] for r in rows), 1.2 * sum(r["size"] for r in rows)
    assert abs(total - budget) <= 50 and {r["copies"] for r in rows} <= {0, 1, 2} and len(rows) == len(given)
    again = mix(spark.createDataFrame(given[::-1], "doc_id long, text string, source string").repartition(7), weigh=lambda rank: F.lit(1.0), share=1.2).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_mix_targets(spark):
    from grovetally.llm.mixing import cyclic_weights, source_targets

    for seed in range(20):
        r = random.Random(seed)
        sizes = {f"s{i:02}": r.choice([0, 1, 5, 100, 1000, 100000]) for i in range(r.randrange(1, 9))}
        expected = brute.mix_targets([(0, "w " * 0, s) for s in sizes] and [(0, "w " * n, s) for s, n in sizes.items() if n < 2000])
        t = spark.createDataFrame([(False, s, n) for s, n in sizes.items() if n < 2000], "nul boolean, src string, source_size long")
        got = {x["src"]: x["target"] for x in source_targets(t, cyclic_weights(), 1.5, 2).collect()}
        assert got == pytest.approx({s: v for s, (_, v) in expected.items()})


def test_mix_targets_of_many_sources(spark):
    """Several ranges of sources, with sizes and ratios that tie."""
    from grovetally.llm.mixing import cyclic_weights, source_targets

    r = random.Random(2)
    sizes = {f"host{i}": r.choice([0, 1, 5, 5, 90, 1000, r.randrange(5000)]) for i in range(500)} | {None: 77}
    totals = spark.createDataFrame([(s is None, s or "", n) for s, n in sizes.items()], "nul boolean, src string, source_size long").repartition(7)
    expected = brute.mix_targets([(0, "w " * n, s) for s, n in sizes.items()])
    got = {None if x["nul"] else x["src"]: (x["source_size"], x["target"]) for x in source_targets(totals, cyclic_weights(), 1.5, 2).collect()}
    assert got.keys() == expected.keys()
    for s in expected:
        assert got[s] == pytest.approx(expected[s], rel=1e-9)


def test_mix_of_nothing(none):
    from grovetally.llm.mixing import mix

    assert mix(none).count() == 0


# op2


@pytest.mark.parametrize("which", ["docs", "small", "clash"])
def test_jaccard(which, request):
    from grovetally.llm.jaccard import groups

    df = request.getfixturevalue(which)
    given = [(r["doc_id"], r["text"]) for r in df.collect()]
    expected = brute.jaccard_components([(i, t) for i, t in given if i is not None])
    got = groups(df).collect()
    assert len(got) == len(given)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == expected[r["doc_id"]]
        else:
            assert r["component_id"] == 7


def test_jaccard_groups(spark):
    """A large group of near copies, of which some link only through others, and common passages."""
    from grovetally.llm.jaccard import groups, one_of_each

    r, given = random.Random(5), []
    base, passage = prose(6, 150).split(), prose(7, 60).split()
    for i in range(300):
        text = list(base)
        for _ in range(r.randrange(0, 7)):
            text[r.randrange(len(text))] = f"edit{r.randrange(10**6)}"
        given.append((i * 3, " ".join(text)))
    for i in range(200):
        own = prose(1000 + i, r.randrange(5, 60)).split()
        given.append((i * 3 + 1, " ".join(own + passage)))
    given += [(10000 + i, " ".join(passage)) for i in range(50)]
    df = spark.createDataFrame(given, "doc_id long, text string").repartition(7)
    expected = brute.jaccard_components(given)
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in groups(df).collect()} == expected
    assert {x["doc_id"] for x in one_of_each(df).collect()} == {c for _, c in expected.values()}


@pytest.mark.parametrize("which", ["docs", "none", "clash"])
def test_jaccard_links(which, request):
    from grovetally.llm.jaccard import link_counts

    df = request.getfixturevalue(which)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    expected = brute.jaccard_links([(r["doc_id"], r["text"]) for r in df.collect()])
    assert sorted(rows(link_counts(df)), key=key) == sorted(expected, key=key)


def test_jaccard_links_within_a_group(spark, monkeypatch):
    """Every link of a group of different near copies, with common columns and classes dealt to several parts."""
    from grovetally.llm import jaccard

    r, given, base = random.Random(8), [], prose(6, 150).split()
    for i in range(90):
        text = list(base)
        for _ in range(r.randrange(0, 5)):
            text[r.randrange(len(text))] = f"edit{r.randrange(10**6)}"
        given.append((i, " ".join(text)))
    given += [(200 + i, given[i % 3][1]) for i in range(9)]
    monkeypatch.setattr(jaccard, "SALT_ROWS", 10)
    got = rows(jaccard.link_counts(spark.createDataFrame(given, "doc_id long, text string").repartition(5)))
    assert sorted(got) == sorted(brute.jaccard_links(given))
    pairs, members = jaccard.links(spark.createDataFrame(given, "doc_id long, text string"))
    assert pairs.where("a >= b").isEmpty() and pairs.distinct().count() == pairs.count() and members.count() == len(given)


def test_jaccard_overlap_of_large_sets_is_exact():
    """A million shingles: whole hashes, so a pair just below the threshold is none and one at it links."""
    import numpy as np

    from grovetally.llm.jaccard import WIDE, _alike, _packed

    pool = np.unique(np.random.default_rng(3).integers(0, 1 << 63, 1_200_000, dtype=np.uint64))
    for n in (9, WIDE // 10 * 9, 900_000):
        n = n // 9 * 9
        shared, x, y = pool[: n // 9 * 8], pool[n // 9 * 8 : n], pool[n : n + n // 9]
        left = _packed(np.sort(np.concatenate([shared, x])))
        assert _alike(left, _packed(np.sort(np.concatenate([shared, y]))))
        assert not _alike(left, _packed(np.sort(np.concatenate([shared[1:], y, pool[n + n // 9 : n + n // 9 + 1]]))))
    edge = pool[:WIDE]  # one set is packed in whole, the other in halves
    assert _alike(_packed(edge), _packed(edge[:-1])) and not _alike(_packed(edge), _packed(pool[WIDE : 2 * WIDE - 1]))


def test_one_of_each_decides_by_row(spark):
    """Null and reused ids: each row stays or goes by its own group."""
    from grovetally.llm.jaccard import one_of_each

    edit = lambda text, i: " ".join("changed" if k == i else w for k, w in enumerate(text.split()))
    other, third, clean, own = prose(41, 120), prose(42, 120), prose(43, 120), prose(44, 120)
    given = [
        (1, BASE), (None, EDITED), (None, clean), (2, own), (2, edit(BASE, 90)), (None, other), (None, edit(other, 60)), (None, other),
        (5, third), (5, edit(third, 30)), (5, third.upper()), (6, third), (None, None), (None, ""), (7, prose(45, 120)),
    ]
    got = [(r["doc_id"], r["text"]) for r in one_of_each(spark.createDataFrame(given, "doc_id long, text string").repartition(3)).collect()]
    assert sorted((i is None, i or 0) for i, _ in got) == sorted((i is None, i or 0) for i in [1, None, 2, None, 5, None, None, 7])
    assert (1, BASE) in got and (None, clean) in got and (2, own) in got and (None, None) in got and (None, "") in got
    assert len([t for i, t in got if i is None and t and t != clean]) == 1


def test_jaccard_of_nothing(none):
    from grovetally.llm.jaccard import groups, one_of_each

    assert groups(none).count() == 0 and one_of_each(none).count() == 0


def test_components(spark):
    from grovetally.llm.jaccard import connected

    chain = [(i, i + 1) for i in range(1, 60)] + [(100, 200), (200, 300), (150, 300), (7, 40)]
    got = {r["cls"]: r["label"] for r in connected(spark.createDataFrame(chain, "a long, b long").repartition(9)).collect()}
    assert all(got[i] == 1 for i in range(1, 61)) and all(got[i] == 100 for i in (100, 150, 200, 300))


# op3


def test_chat(spark):
    from grovetally.llm import chat, queries

    expected = {}
    given = spark.read.parquet(f"{SMALL}/conversations.parquet")
    for r in given.orderBy("conv_id", "turn").collect():
        expected.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    said = "\\### Assistant: </turn> ok"
    expected[-7] = [("user", said), ("assistant", said)]
    got = {r["conv_id"]: tuple(r)[1:5] for r in queries.op3_chat(spark, SMALL).collect()}
    assert got == {k: brute.chat(v) for k, v in expected.items()}
    odd = ["", None, "\\", "<", "\\l", "\\\\l", "<|end|>", "<|turn|>a<|text|>b<|end|>", "\\<\\", "a\nb", "\U0001f600<"]
    table = spark.createDataFrame([(1, None, "user", "late")] + [(1, i, r, t) for i, t in enumerate(odd) for r in ("assistant", None)] + [(None, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    done = chat.format_chats(chat.gathered(table)).select("conv_id", "turns", chat.read_back(F.col("formatted")).alias("back"))
    for r in done.collect():
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(t["role"], t["text"]) for t in r["back"]]
    turns = {r["conv_id"]: r["turns"] for r in done.collect()}
    assert [t["text"] for t in turns[1] if t["role"] == "assistant"] == [t or "" for t in odd] and turns[1][-1]["text"] == "late"
    assert chat.format_chats(chat.gathered(table.where("false"))).count() == 0


def test_chat_layouts(spark):
    from grovetally.llm.chat import MAPPINGS, canonical_turns

    given = [
        '{"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": null}]}', '{"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]}',
        '{"instruction": "i", "input": null, "output": "o"}', '{"instruction": "i", "output": "o"}', '{"prompt": "p", "completion": "c"}', '{"system": "s", "prompt": "p", "response": "r"}',
        '{"question": "q", "answer": 5}', '{"other": 1}', "no json", None, '{"turns": []}', '{"answer": "a", "question": "q"}',
    ]
    got = [(r["layout"], r["turns"] and [tuple(t) for t in r["turns"]]) for r in canonical_turns(spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, record string")).orderBy("i").collect()]
    assert got[0] == ("messages", [("system", "s"), ("user", "")]) and got[1] == ("conversations", [("user", "h"), ("assistant", "g")])
    assert got[2] == ("instruction", [("user", "i"), ("assistant", "o")]) and got[3][0] == "instruction_plain" and got[4] == ("prompt", [("user", "p"), ("assistant", "c")])
    assert got[5] == ("prompt_response", [("system", "s"), ("user", "p"), ("assistant", "r")]) and got[6] == ("question", [("user", "q"), ("assistant", "5")]) and got[11][0] == "question"
    assert got[7] == got[8] == got[9] == (None, None) and len({m.name for m in MAPPINGS}) == len(MAPPINGS)


def test_chat_of_conversations_in_many_layouts(spark):
    """Whatever layout a conversation is dealt to, its turns come back; every layout that can hold some is met."""
    from grovetally.llm import chat

    kinds = [["user", "assistant"], ["user", "user", "assistant"], ["system", "user", "assistant"], ["human", "gpt"], [None, "assistant"], ["user"]]
    given = [(i, t, role, None if (i + t) % 7 == 0 else f"<{i}\\{t}>") for i in range(240) for t, role in enumerate(kinds[i % len(kinds)])] + [(None, 0, "user", "x"), (None, 1, "assistant", "y")]
    table = spark.createDataFrame(given, "conv_id long, turn long, role string, text string")
    done = chat.format_chats(chat.gathered(table, chat.MAPPINGS)).select("conv_id", "layout", chat.read_back(F.col("formatted")).alias("back")).collect()
    expected = {}
    for i, _, role, text in given:
        expected.setdefault(i, []).append((role or "", text or ""))
    assert {r["conv_id"]: [(t["role"], t["text"]) for t in r["back"]] for r in done} == expected and len(done) == len(expected)
    assert {r["layout"] for r in done} == {m.name for m in chat.MAPPINGS}
    assert {r["layout"] for r in done if r["conv_id"] is not None and r["conv_id"] % 6 == 3} == {"messages", "turns"}
    plain = chat.gathered(table, tuple(m for m in chat.MAPPINGS if m.name == "question"))
    assert {r["conv_id"] for r in plain.where("record is not null").collect()} == {i for i in expected if [r for r, _ in expected[i]] == ["user", "assistant"]}
    assert chat.gathered(table.where("false"), chat.MAPPINGS).count() == 0


def test_chat_records_with_further_fields(spark):
    """A mapping needs its own paths only; nothing is lost for a field too many, and no element loses its text."""
    from grovetally.llm.chat import format_chats, read_back

    given = [
        '{"id": 7, "prompt": "p", "completion": "c"}', '{"messages": [{"role": "user", "content": "x", "name": "n"}, {"role": "assistant", "content": "y"}, {"role": "tool"}, 5, null], "meta": {"a": [1]}}', '{"messages": []}',
        '{"prompt": "p", "response": "r"}', '{"instruction": "i", "input": "j", "output": "o", "prompt": "q", "id": null}', '{"messages": "x"}', '{"messages": [1]}', '{"prompt": null, "completion": null}', '{"answer": {"a": 1}, "question": ["x"]}',
    ]
    table = spark.createDataFrame([(i, x, "mine", "own", "kept", "v") for i, x in enumerate(given)], "i int, record string, layout string, turns string, formatted string, variant_of_record string")
    done = format_chats(table)
    assert done.columns == [*table.columns, "_turns", "_layout", "_formatted"]
    got = [(r["_layout"], r["_turns"] and [tuple(t) for t in r["_turns"]], r["layout"], r["variant_of_record"]) for r in done.orderBy("i").collect()]
    assert got[0][:2] == ("prompt", [("user", "p"), ("assistant", "c")]) and got[2][:2] == ("messages", []) and got[3][0] == "prompt_plain" and got[4][0] == "instruction"
    assert got[1][:2] == ("messages", [("user", "x"), ("assistant", "y"), ("tool", ""), ("", ""), ("", "")])
    assert got[5][0] is got[6][0] is None and got[7][:2] == ("prompt", []) and got[8][:2] == ("question", [("user", '["x"]'), ("assistant", '{"a":1}')])
    assert all(g[2:] == ("mine", "v") for g in got)
    back = done.where("_turns is not null").select("_turns", read_back(F.col("_formatted")).alias("back")).collect()
    assert all([tuple(t) for t in r["_turns"]] == [(t["role"], t["text"]) for t in r["back"]] for r in back)
    assert format_chats(table.where("false")).count() == 0 and format_chats(table.unionAll(table)).count() == 2 * len(given)


# op4


def test_lm(spark, small, docs, none):
    from grovetally.llm import lm

    given = [(r["doc_id"], r["text"]) for r in small.collect()]
    expected = brute.unigram(given)
    got = lm.score(small).collect()
    for r in got:
        e = expected[r["doc_id"]]
        assert tuple(r)[1:5] == e[:4] and r["base_score"] == pytest.approx(e[4], rel=1e-9)
    assert len(got) == len(given)
    # on texts held out, the network gains on what it starts as, the shares of ids
    import numpy as np

    subwords, seq, at = _encoded([t or "" for i, t in given if not expected[i][0]])
    ranks = lm.Ranks.by(np.bincount(seq, minlength=subwords.end + 1) - np.bincount([subwords.end], minlength=subwords.end + 1) * (len(at) - 1))
    kept = [i for i, _ in given if expected[i][0]]
    _, seq, at = _encoded([t or "" for i, t in given if expected[i][0]])
    first = dict(zip(kept, lm.log10_texts(lm.start(ranks), lm.Text.of(seq, at, ranks), ranks.rest()), strict=True))
    gain = {r["doc_id"]: r["score"] - first[r["doc_id"]] for r in got if r["held_out"]}
    assert sum(gain.values()) > 0.1 * -sum(first.values()) and sum(x > 0 for x in gain.values()) > 0.8 * len(gain)
    odd = lm.score(docs).collect()
    assert len(odd) == len(AWKWARD) and all(r["n_tokens"] == len(brute.words(t)) + 1 for r in odd for i, t, *_ in AWKWARD if i == r["doc_id"] and i is not None)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in odd)
    assert lm.score(none).count() == 0


def test_lm_beats_counts_of_words(spark):
    """With ten thousand documents to learn from, held-out texts are likelier than under the word counts."""
    from grovetally.llm import lm

    got = lm.score(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).where("held_out").selectExpr("sum(score)", "sum(base_score)").first()
    assert got[0] > 0.97 * got[1]


def test_lm_does_not_depend_on_partitions(spark, small):
    """Units of training follow from the documents alone, also where there are several units."""
    from grovetally.llm import lm

    few = spark.createDataFrame(small.orderBy("doc_id").limit(60).collect(), small.schema)
    got = []
    for n in (1, 6, 24):
        was, lm.UNIT = lm.UNIT, 2000
        try:
            got.append({r["doc_id"]: r["score"] for r in lm.score(few.repartition(n, "text")).collect()})
        finally:
            lm.UNIT = was
    assert got[0] == pytest.approx(got[1], rel=1e-6) and got[0] == pytest.approx(got[2], rel=1e-6)


def _encoded(texts):
    import pyarrow as pa

    from grovetally.llm import lm
    from grovetally.llm._text import chunks

    subwords = lm.Subwords(lm.VOCABULARY)
    (c,) = chunks(pa.array(texts))
    starts, ends, begins = c.words()
    return subwords, *subwords.sequences(c, starts, begins)


def _network(ranks, seed=1):
    import numpy as np

    from grovetally.llm import lm

    r, p = np.random.default_rng(seed), lm.start(ranks)
    return {k: (x + 0.3 * r.standard_normal(x.shape)).astype(np.float32) if k.startswith("head") else x for k, x in p.items()}


def test_lm_ids_are_those_of_the_text():
    from grovetally.llm import lm

    texts = ["", " \n", "One  TWO\tthree", "é ü  ß 日本語 \U0001f600 \u00a0 x", prose(3, 400), "a" * 200000, "é" * 100000, "-" * 1000000]
    for t in texts:
        subwords, seq, (i, j) = _encoded([t])
        assert seq[i] == seq[j - 1] == subwords.end
        normal = "".join(" " + w for w in brute.words(t.translate(brute.LOWER)))
        assert subwords.code.decode(seq[i + 1 : j - 1].tolist()) == normal
        if len(normal) < lm.ENCODED:
            assert seq[i + 1 : j - 1].tolist() == subwords.code.encode_ordinary(normal)


def test_lm_encodes_each_word_once(monkeypatch):
    """The ids of every text are those of the whole text, though a word that occurs often is encoded once; words that
    end in white space beyond ASCII, where ids may reach over a space, leave their documents as they are."""
    import pyarrow as pa

    from grovetally.llm import lm
    from grovetally.llm._text import chunks

    given = []
    subwords = lm.Subwords(lm.VOCABULARY)
    plain = subwords.encode
    monkeypatch.setattr(subwords, "encode", lambda text: given.append(text) or plain(text))
    odd = ["x\u00a0 \u00a0y \u3000 z\u2003", "it's  \u0085 's", "\u200b a\u200b b", "\u3000"]
    texts = [prose(3, 400), "", *odd, " ".join(["One two's 33 --"] * 500), prose(3, 400), *odd]
    (c,) = chunks(pa.array(texts))
    starts, _, begins = c.words()
    seq, at = subwords.sequences(c, starts, begins)
    normal = ["".join(" " + w for w in brute.words(t.translate(brute.LOWER))) for t in texts]
    for t, i, j in zip(normal, at[:-1], at[1:], strict=True):
        assert seq[i] == seq[j - 1] == subwords.end and seq[i + 1 : j - 1].tolist() == subwords.code.encode_ordinary(t)
    once = {w for t in (texts[0], texts[6], odd[2]) for w in brute.words(t.translate(brute.LOWER))}
    assert sum(map(len, given)) <= sum(len(w.encode()) + 1 for w in once) + 2 * sum(len(t.encode()) for t in normal[2:6])


def test_lm_pieces_hold_every_id_of_training_once(spark, monkeypatch):
    """Whatever the piece's length, each id of a training document is scored once, in one of the rounds."""
    from collections import Counter

    import numpy as np

    from grovetally.llm import lm

    monkeypatch.setattr(lm, "PIECE", 48)
    given = [(i, prose(i, 5 + 40 * i)) for i in range(12)] + [(3, None), (4, "")]
    import zlib

    kept = [t or "" for i, t in given if zlib.crc32(str(i).encode()) % 7 != 2]
    _, seq, at = _encoded(kept)
    expected = Counter(int(x) for i, j in zip(at[:-1], at[1:], strict=True) for x in seq[i + 1 : j])
    got = Counter()
    rows = lm.encoded(spark.createDataFrame(given, "doc_id long, text string"), lm.VOCABULARY, (np.zeros(0, np.uint64), np.zeros(0)), 0)
    for turn in range(lm.ROUNDS):
        own = lm.pieces(rows, turn, 3, 50257).collect()
        assert own and all(0 <= r["unit"] < 3 for r in own)
        for r in own:
            got.update(np.frombuffer(r["ids"], np.uint16)[r["lead"] + 1 :].tolist())
    assert got == expected
    ids = lm.id_counts(rows, lm.VOCABULARY)
    assert {i: int(n) for i, n in enumerate(ids) if n} == expected


def test_lm_copies_go_to_all_units(spark):
    """A text that stands under many ids is not one unit's work."""
    from collections import Counter

    import numpy as np

    from grovetally.llm import lm

    df = spark.range(3000).selectExpr("id AS doc_id", "'the same few words in every row' AS text")
    rows = lm.encoded(df, lm.VOCABULARY, (np.zeros(0, np.uint64), np.zeros(0)), 0)
    units = Counter(r["unit"] for turn in range(lm.ROUNDS) for r in lm.pieces(rows, turn, 10, 50257).select("unit").collect())
    assert len(units) == 10 and max(units.values()) < 1.5 * sum(units.values()) / 10


def test_lm_scores_each_id_once_by_plain_attention():
    """Overlapping windows against attention over one position at a time; probabilities add up to 1."""
    import numpy as np

    from grovetally.llm import lm

    texts = ["", "one", prose(3, 9), prose(4, 120)]
    subwords, seq, at = _encoded(texts)
    ranks = lm.Ranks.by(np.bincount(seq, minlength=subwords.end + 1))
    p, rest = _network(ranks), ranks.rest()
    got = lm.log10_texts(p, lm.Text.of(seq, at, ranks), rest)

    def softmax(y):
        e = np.exp(y - y.max())
        return e / e.sum()

    def plain(ids, at_place):
        """Probabilities of all ranks after position ``at_place``."""
        first = at_place // lm.STRIDE * lm.STRIDE - lm.CONTEXT  # of the window that scores it
        look = range(max(0, first), at_place + 1)
        x = np.array([p["embed"][min(ids[j], len(p["embed"]) - 1)] + p["place"][j - first] for j in look], dtype=float)
        query, key, value = np.split(p["look"], 3, axis=1)
        s = softmax(x @ key @ (query.T @ x[-1]) / lm.WIDTH**0.5)
        h = x[-1] + (s @ (x @ value)) @ p["out"]
        heads = [softmax(h @ p[f"head{i}"][:-1] + p[f"head{i}"][-1]) for i in range(len(lm.CUTS))] + [np.exp(rest)]
        n = lm.CUTS[0]
        return np.concatenate([heads[0][:n]] + [heads[0][n + i] * t for i, t in enumerate(heads[1:])])

    for d, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True)):
        ids, total = ranks.of[seq[i:j]], 0.0
        for k in range(len(ids) - 1):
            q = plain(ids, k)
            assert len(q) == len(ranks.of) and q.sum() == pytest.approx(1, abs=1e-5)
            total += math.log10(q[ids[k + 1]])
        assert got[d] == pytest.approx(total, rel=1e-5)


def test_lm_gradient():
    import numpy as np

    from grovetally.llm import lm

    subwords, seq, at = _encoded([prose(5, 40), prose(6, 7), "é 日本語 \U0001f600"])
    ranks = lm.Ranks.by(np.bincount(seq[:60], minlength=subwords.end + 1))
    t, rest = lm.Text.of(seq, at, ranks), ranks.rest()
    doc, place = lm.windows(t.offsets)
    p = {k: v.astype(np.float64) for k, v in _network(ranks).items()}

    def loss(q):
        return -lm.forward(q, t, rest, doc, place)["logp"].mean()

    r, g = np.random.default_rng(2), lm.gradient(p, lm.forward(p, t, rest, doc, place))
    assert set(g) == set(p)
    for k in p:
        direction = r.standard_normal(p[k].shape)
        up, down = (loss(p | {k: p[k] + e * direction}) for e in (1e-4, -1e-4))
        assert (up - down) / 2e-4 == pytest.approx(float((g[k] * direction).sum()), rel=2e-3, abs=1e-5), k


# op5


def test_perplexity_model_is_a_distribution():
    import numpy as np

    from grovetally.llm.perplexity import fit

    r = np.random.default_rng(0)
    words = r.integers(1, 30, 2000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    begins = np.arange(0, 2001, 20)
    m = fit(words, begins)
    vocab = np.unique(words)
    for history in ([], [vocab[0]], [vocab[3], vocab[5]], [np.uint64(12345), vocab[1]], [np.uint64(99)]):
        total = 0.0
        for w in [*vocab, np.uint64(77)]:
            seq = np.array([*history, w], dtype=np.uint64)
            logs, _ = m.log10(seq, np.array([0, len(seq)]))
            total += 10 ** logs[len(history)]
        seq = np.array(history, dtype=np.uint64)
        total += 10 ** m.log10(seq, np.array([0, len(seq)]))[0][-1]
        assert total == pytest.approx(1.0, abs=1e-3)


def test_perplexity_by_plain_counts():
    """Interpolated modified Kneser-Ney with dictionaries."""
    import numpy as np

    from grovetally.llm import perplexity

    r = random.Random(8)
    vocab = list(range(2, 30))
    texts = [[r.choice(vocab[: r.choice([4, 28])]) for _ in range(r.randrange(0, 40))] for _ in range(60)]
    arrays = lambda ts: (np.array([w for t in ts for w in t], np.uint64), np.concatenate([[0], np.cumsum([len(t) for t in ts])]).astype(np.int64))
    model = perplexity.fit(*arrays(texts))
    plain = brute.KneserNey(texts)
    new = [[r.choice([*vocab, 99]) for _ in range(r.randrange(0, 30))] for _ in range(40)]
    for given in (texts, new):
        logs, _ = perplexity.perplexities(model, *arrays(given))
        assert logs == pytest.approx([plain.log10(t) for t in given], rel=1e-5)


def test_quality(spark, small, docs, none):
    from grovetally.llm.perplexity import classify

    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    got = classify(small, labels).join(labels, "doc_id")
    kept = {r["quality"]: r["share"] for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert kept[1] > 0.95 and kept[0] < 0.6
    odd = classify(docs, labels.unionByName(spark.createDataFrame([(None, 1, 0), (7, 1, 0), (7, 0, 1)], labels.schema)))
    assert odd.count() == len(AWKWARD) and odd.where("perplexity is null or isnan(perplexity)").count() == 0
    assert classify(docs, labels.where("false")).where("kept").count() == len(AWKWARD)
    assert classify(none, labels).count() == 0


def test_quality_sample_passes_over_long_documents(spark, monkeypatch):
    """A document beyond the limit of words does not end the sample, wherever it comes by hash."""
    import numpy as np

    from grovetally.llm import perplexity

    monkeypatch.setattr(perplexity, "MAX_WORDS", 100)
    ids = [r["id"] for r in spark.range(20).orderBy(F.xxhash64("id")).collect()]
    size = {i: 20 for i in ids} | {ids[0]: 300, ids[3]: 90}
    df = spark.createDataFrame([(i, prose(i, n)) for i, n in size.items()], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in ids], "doc_id long, quality int")
    assert np.diff(perplexity.trusted_words(df, labels)[1]).tolist() == [20] * 5


@pytest.mark.parametrize("few", [0, 1 << 30])
def test_quality_counts_every_trusted_document(spark, monkeypatch, few):
    """Scores are those of a plain model of all trusted documents, and of all of the other folds, in one round or several."""
    import pyarrow as pa

    from grovetally.llm import kneser, perplexity

    monkeypatch.setattr(perplexity, "MAX_DOCS", 5)
    for name, value in {"FEW": few, "ROUNDS": 2, "WORD_ROUNDS": 2, "LAST_ROUNDS": 2}.items():
        monkeypatch.setattr(kneser, name, value)
    r = random.Random(4)
    given = [(i, " ".join(r.choice(WORDS[: r.choice([3, 24])]) for _ in range(r.randrange(0, 40)))) for i in range(120)]
    given += [(120, None), (121, ""), (122, given[0][1]), (3, given[3][1].upper()), (None, given[5][1]), (200, "only here"), (201, "alpha " * 400)]
    labels = spark.createDataFrame([(i, 1) for i in range(125) if i % 3 != 1] + [(3, 1), (6, 0), (None, 1)], "doc_id long, quality int")
    good = {i for i in range(125) if i % 3 != 1} - {6}
    df = spark.createDataFrame([(i, t, "en") for i, t in given], "doc_id long, text string, lang string").repartition(3)
    words = lambda t: (t or "").lower().split()
    fold = lambda t: kneser.Tokens.read(pa.record_batch([pa.array([1]), pa.array(["en"]), pa.array([t], pa.string()), pa.array([1])], list("abcd"))).fold[0]
    trusted = [(fold(t), words(t)) for i, t in given if i in good]
    whole = brute.KneserNey([w for _, w in trusted])
    apart = {k: brute.KneserNey([w for f, w in trusted if f != k]) for k, _ in trusted}
    want = sorted((i or -1, len(words(t)), whole.log10(words(t)), (apart[fold(t)] if i in good else whole).log10(words(t))) for i, t in given)
    got = kneser.score(df, labels.groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1 and doc_id is not null")).collect()
    got = sorted((r["doc_id"] or -1, r["n_words"], r["log10_prob"], -math.log10(r["unseen"]) * (r["n_words"] + 1)) for r in got)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    for k in (2, 3):
        assert [x[k] for x in got] == pytest.approx([x[k] for x in want], rel=1e-9)
    kept = perplexity.classify(df, labels).collect()
    assert sorted(r["log10_prob"] for r in kept) == pytest.approx(sorted(x[2] for x in want), rel=1e-9)


def test_quality_records_of_a_pair_stand_together():
    """In each shard, those of trusted documents apart; and a round's words are those of its shards, in the same order."""
    import numpy as np
    import pyarrow as pa

    from grovetally.llm import kneser

    r = random.Random(8)
    texts = [" ".join(r.choice(WORDS[:6]) for _ in range(r.randrange(0, 60))) for _ in range(200)]
    t = kneser.Tokens.read(pa.record_batch([pa.array(range(200)), pa.array(["en"] * 200), pa.array(texts), pa.array([i if i % 3 else None for i in range(200)])], list("abcd")))
    seen = []
    for turn in range(2):
        order, shard = t.order(turn, 2, 5)
        seen += order.tolist()
        part = shard.astype(np.int64) * 2 + (t.of[order] < kneser.ALL)
        assert (np.diff(part) >= 0).all() and (shard == t.shards(order, 5)).all() and (t.turns(2)[order] == turn).all()
        runs = list(zip(part.tolist(), t.pair[order].tolist()))
        assert 1 + sum(x != y for x, y in zip(runs, runs[1:])) == len(set(runs)) < len(runs)
    assert sorted(seen) == list(range(len(t.pair)))
    words, shard, bits, _ = t.words(7)
    for turn in range(3):
        here = shard % 3 == turn
        got = t.words(7, turn, 3)
        assert all((x == y[here]).all() and len(x) for x, y in zip(got[:3], (words, shard, bits)))


def test_quality_tables_are_coded_by_columns():
    """A table whose columns are mostly alike takes less than a byte a column; all numbers come back; and words come back from pairs."""
    import numpy as np

    from grovetally.llm import kneser
    from grovetally.llm._text import mix

    r = np.random.default_rng(4)
    kinds = r.integers(0, 5, (12, 60))
    table = kinds[:, np.minimum(r.geometric(0.3, 20_000), 60) - 1]
    table[:, ::500] = r.integers(0, 1 << 40, (12, 40))
    for x in (table, table[:6], table[:, :1], table[:, :0], r.integers(0, 1 << 50, (5, 30))):
        (got,) = kneser.unpack(kneser.pack(x))
        assert (got.rows(lambda t: t, np.int64) == x.T).all()
    assert len(kneser.pack(table)) < 12_500  # one code for each number took 55,000 at least
    h = np.sort(r.integers(0, 2**64, 5000, dtype=np.uint64))
    for x in (h, h[:1], h[:0], h[::-1].copy()):
        assert (kneser.risen(*kneser.unpack(kneser.pack(*kneser.rising(x)))) == x).all()
    first, second = h, h[::-1]
    assert (kneser.first_words(mix(first * kneser._C1 + second), second) == first).all()


def test_quality_counts_of_words_are_summed_by_round():
    """While pairs are counted, each shard of words keeps one row for a round, however many shards of pairs have the word."""
    from collections import Counter

    import numpy as np

    from grovetally.llm import kneser

    r, want, rows = np.random.default_rng(5), Counter(), []
    for i in range(60):
        word, model, values = r.integers(0, 20, 50).astype(np.uint64) << np.uint64(59), r.integers(0, 11, 50).astype(np.uint8), r.integers(-3, 400, (50, 5))
        for w, m, v in zip(word.tolist(), model.tolist(), values):
            want[w, m] += v
        rows.append((i // 20, 16, 0, kneser.counts_packed(*kneser.summed(word, model, values))))
    got = [x for b in kneser.word_sums(iter([kneser.table(rows[:25]), kneser.table(rows[25:])])) for x in zip(*(c.to_pylist() for c in b.columns))]
    assert [x[:3] for x in got] == [(0, 16, 0), (1, 16, 0), (2, 16, 0)]
    word, model, values = kneser.counts_summed([x[3] for x in got])
    assert {(w, m): v.tolist() for w, m, v in zip(word.tolist(), model.tolist(), values)} == {k: v.tolist() for k, v in want.items()}


def test_quality_leaves_no_shuffle_files(spark, monkeypatch):
    """Those of a round go when it is written, whether or not the driver collects its garbage."""
    import time

    from grovetally.llm import kneser

    for name, value in {"FEW": 0, "ROUNDS": 2, "WORD_ROUNDS": 2, "LAST_ROUNDS": 2}.items():
        monkeypatch.setattr(kneser, name, value)
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    left, docs = [], spark.createDataFrame([(i, prose(i, 30), "en") for i in range(40)], "doc_id long, text string, lang string")

    def shuffles():
        found = blocks.getAllBlocks()
        return {n.split("_")[1] for n in (found.apply(i).name() for i in range(found.size())) if n.startswith("shuffle_")}

    def after_write(_):
        time.sleep(0.7)  # the files go in the background
        left.append(shuffles() - before)

    monkeypatch.setattr(kneser, "tidied", after_write, raising=False)
    good = docs.where("doc_id % 2 = 0").select("doc_id")
    before = shuffles()
    assert kneser.score(docs, good).count() == 40
    assert len(left) == 4 and len(set.union(*left)) <= 1  # the sum of sizes is no write


def test_quality_keeps_clean_text_it_has_not_seen(spark):
    """Trusted rows are few enough to be trained on, all of them; others are of the same kind."""
    from grovetally.llm.perplexity import classify

    given = [(i, prose(5000 + i, 100), "en") for i in range(240)]
    df = spark.createDataFrame(given, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(120)], "doc_id long, quality int")
    kept = {r["doc_id"] for r in classify(df, labels).where("kept").collect()}
    assert len(kept & set(range(120, 240))) >= 114 and kept >= set(range(120))
    one = classify(df, labels.where("doc_id = 0"))
    assert one.where("kept and threshold is null").count() == len(given)


# op6


@pytest.mark.parametrize("which", ["docs", "small"])
def test_pii(which, request):
    from grovetally.llm.pii import KINDS, find_pii, joined

    df = request.getfixturevalue(which)
    base = [k.name for k in KINDS if k.base]
    got = find_pii(df).select("doc_id", "text", joined(F.filter("pii", lambda s: s["kind"].isin(*base))).alias("spans")).collect()
    assert len(got) == df.count()
    for r in got:
        assert r["spans"] == brute.pii(r["text"])[1]


def test_pii_patterns(spark):
    """Random strings of the characters that the patterns are about."""
    from grovetally.llm.pii import KINDS, find_pii, joined

    r = random.Random(3)
    texts = ["".join(r.choice("0123456789.. -+()@ab_%xé\n" if i % 2 else "0123.-@a ") for _ in range(r.randrange(1, 60))) for i in range(3000)]
    texts += ["4111 1111 1111 1111", "4111-1111-1111-1112", "+1-555-010-2233x", "a@b.c.d@e.f", "0001.002.3.0255 256.1.1.1", "1.1.1.1.1.1.1.1.1"]
    base = [k.name for k in KINDS if k.base]
    got = find_pii(spark.createDataFrame([(t,) for t in texts], "text string")).select("text", joined(F.filter("pii", lambda s: s["kind"].isin(*base))).alias("spans")).collect()
    assert [r["spans"] for r in got] == [brute.pii(r["text"])[1] for r in got]


def test_pii_extras_and_redaction(spark, none):
    from grovetally.llm.pii import find_pii, redact

    texts = [
        "my bank account is DE89 3704 0044 0532 0130 00 ok", "DE89 3704 0044 0532 0130 01", "ssn 123-45-6789", "part 123-45-6789", None, "", "a@b.cd, +49 30 1234567 and 10.0.0.1", "mail me: 1@2.3.4.5.6",
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "i int, text string, pii_text string")
    found = [[s["kind"] for s in r["pii"]] for r in find_pii(df).orderBy("i").collect()]
    assert found[0] == ["iban"] and found[1] == [] and found[2] == ["national"] and found[3] == [] and found[4] == found[5] == []
    clean = [r["text"] for r in redact(df).orderBy("i").collect()]
    assert clean[0] == "my bank account is <IBAN> ok" and clean[4] is None and clean[5] == "" and clean[6] == "<EMAIL>, <PHONE> and <IP>" and "@" not in clean[7]
    assert redact(df).columns == df.columns and redact(none).count() == 0 and redact(redact(df)).select("text").collect() == redact(df).select("text").collect()


def test_pii_redacts_any_overlap(spark):
    """Stretches of overlapping spans against a plain pass over them, with texts longer than a block."""
    from grovetally.llm.pii import find_pii, redact

    r = random.Random(4)
    parts = ["a.b@1.2.3.4", "+49 30 1234567", "4111 1111 1111 1111", "10.0.0.1", "é", "ssn 123-45-6789", "x@y.zz", "+1.2.3.4.5.6.7.8.9", "日本 \U0001f600 ", "w" * 900, " "]
    given = [("".join(r.choice(parts) + r.choice(["", " ", "\n"]) for _ in range(r.choice([0, 1, 5, 40, 300])))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(given)), "i int, text string")
    spans = {x["i"]: x["pii"] for x in find_pii(df).collect()}
    clean = {x["i"]: x["text"] for x in redact(df).collect()}
    for i, text in enumerate(given):
        out, at = [], 0
        for s in sorted(spans[i], key=lambda s: (s["start"], -s["end"], s["kind"])):
            if s["start"] >= at:
                out.append(text[at : s["start"]] + f"<{s['kind'].upper()}>")
            at = max(at, s["end"])
        assert clean[i] == "".join(out) + text[at:]


def test_pii_of_many_spans_takes_time_by_their_number(spark):
    import time

    from grovetally.llm.pii import redact

    took = {}
    for n in (500, 5000, 90000):  # the last text has 2 MB; the first call warms up
        df = spark.createDataFrame([(" ".join(f"é a{i}@mail.example.com" for i in range(n)),)], "text string")
        began = time.perf_counter()
        assert redact(df).first()["text"] == " ".join(["é <EMAIL>"] * n)
        took[n] = time.perf_counter() - began
    assert took[90000] < 60


# op7


def test_toxicity(spark, docs, none, clash):
    from grovetally.llm.toxicity import score, train

    r, given, labels = random.Random(1), [], []
    for i in range(600):
        text = prose(i, r.randrange(5, 60)).split()
        bad = i % 5 == 0
        for _ in range(r.randrange(1, 6) * bad):
            text.insert(r.randrange(len(text)), r.choice(["vile", "Rotten", "FILTH!"]))
        given.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    df, lab = spark.createDataFrame(given, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    model = train(df.where("doc_id < 400"), lab)
    got = score(df.where("doc_id >= 400"), model).collect()
    assert all(x["toxic"] == (x["doc_id"] % 5 == 0) for x in got)
    assert [tuple(x) for x in got] == [tuple(x) for x in score(df.where("doc_id >= 400"), train(df.where("doc_id < 400").repartition(5), lab)).collect()]
    grades = {x["doc_id"]: x["severity"] for x in score(spark.createDataFrame([(1, "x"), (2, "x vile"), (3, "vile vile rotten filth vile")], "doc_id long, text string"), model).collect()}
    assert grades[1] < grades[2] < grades[3]
    assert score(docs, model).where("toxic").count() == 0 and score(docs, model).count() == len(AWKWARD) and score(none, model).count() == 0
    assert score(docs, train(docs, lab.where("false"))).where("toxic").count() == 0
    kept = score(clash, model, tuple(clash.columns))
    assert "_toxic" in kept.columns and len(set(kept.columns)) == len(kept.columns) and kept.count() == len(AWKWARD)


def test_toxicity_fit_is_the_best_there_is():
    """The penalised likelihood, written out row by row, is no better anywhere near the fit."""
    import numpy as np

    from grovetally.llm import toxicity

    r = np.random.default_rng(3)
    docs, words, values, grade = [], [], [], []
    for i in range(300):
        level = int(r.integers(0, 3)) if i % 3 == 0 else 0
        own = [*r.integers(0, 12, 6), *(100 + r.integers(0, 3, level * 2))]
        for w in sorted(set(own)):
            docs.append(i), words.append(w), values.append(1 + math.log(own.count(w)))
        grade.append(level)
    grade = np.array(grade)
    model = toxicity.fit(np.array(docs), np.array(words, np.uint64), np.array(values, np.float32), grade)
    assert set(model.words.tolist()) <= {100, 101, 102} and len(model.thresholds) == 2

    def loss(weights, theta):
        total = 0.0
        for i, g in enumerate(grade):
            x = sum(weights.get(w, 0.0) * v for d, w, v in zip(docs, words, values, strict=True) if d == i)
            over = [1.0, *(1 / (1 + math.exp(t - x)) for t in theta), 0.0]
            total -= math.log(max(over[g] - over[g + 1], 1e-12))
        return total / len(grade) + toxicity.L1 * sum(weights.values())

    weights, theta = dict(zip(model.words.tolist(), model.weights, strict=True)), list(model.thresholds)
    best = loss(weights, theta)
    for w in weights:
        assert loss(weights | {w: weights[w] + 0.05}, theta) > best - 1e-7 and loss(weights | {w: max(0.0, weights[w] - 0.05)}, theta) > best - 1e-7
    for k in (0, 1):
        for step in (-0.05, 0.05):
            assert loss(weights, [t + step * (j == k) for j, t in enumerate(theta)]) > best - 1e-7


def test_toxicity_sample_is_bounded_by_features(spark):
    from grovetally.llm import toxicity

    given = [(i, "vile " + prose(i, 20) if i % 2 else prose(i, 20)) for i in range(60)] + [(60, "vile " + " ".join(f"w{i}" for i in range(20000)))]
    df, labels = spark.createDataFrame(given, "doc_id long, text string"), spark.createDataFrame([(i, i % 2 if i < 60 else 1) for i in range(61)], "doc_id long, toxic int")
    model = toxicity.train(df, labels, max_features=15000)
    got = {r["doc_id"]: r["toxic"] for r in toxicity.score(df, model).collect()}
    assert all(got[i] == (i % 2 == 1) for i in range(60))


# op8


def test_rules_know_where_sentences_end(spark):
    """By whole code points: a letter whose last byte is that of a stop is none."""
    from grovetally.llm.rules import apply_rules

    line = {i: t for i, t in enumerate(["он сегодня утром пришел", "мы сидели дома", "jeg så en bæ", "这 是 一 行 文字。", "وصل اليوم؟", "он пришел.", "он пришел…", "«он пришел»", "नमस्ते दुनिया।", "x 𝒳"])}
    df = spark.createDataFrame([(i, "\n".join([t] * 3)) for i, t in line.items()], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in apply_rules(df, with_text=True).collect()}
    assert [bool(got[i]) for i in sorted(line)] == [False, False, False, True, True, True, True, True, True, False]


@pytest.mark.parametrize("which", ["docs", "small"])
def test_rules(which, request):
    from grovetally.llm.rules import apply_rules

    df = request.getfixturevalue(which)
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    got = apply_rules(df).collect()
    assert len(got) == df.count()
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute.rules(texts[r["doc_id"]])
        assert not (r["kept"] and r["base_failed"])


def test_rules_lines(spark, none):
    from grovetally.llm.rules import apply_rules

    good = "\n".join(prose(i, 12).capitalize() + "." for i in range(6))
    texts = [good, good + "\nLicensed under the MIT License.", "home | about | news | terms | log in | sign up\n" * 5, good + "\nhome | about | news |", "READ THIS NOW OR LOSE ALL OF YOUR MONEY TODAY!\n" + good]
    got = apply_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), with_text=True).orderBy("doc_id").collect()
    assert [r["kept"] for r in got] == [True, True, False, True, True] and all(r["text"] == good for i, r in enumerate(got) if i != 2)
    assert apply_rules(none, with_text=True).count() == 0


def test_rules_of_ids_named_like_results(spark):
    from grovetally.llm.rules import apply_rules

    for name in ("n_words", "text", "a.b", "read_text"):
        table = spark.createDataFrame([("x", "one two"), (None, None), ("x", "one two")], "id string, words string").withColumnRenamed("id", name)
        got = apply_rules(table, name, "words", with_text=True)
        assert got.columns[0] == name and len({c.lower() for c in got.columns}) == len(got.columns) == 10
        assert sorted((str(r[0]), r[1]) for r in got.collect()) == [("None", 0), ("x", 2), ("x", 2)]


# op9


def test_warc(spark):
    import hashlib

    from grovetally.llm.warc import archive_pages

    big, other = "é" * 700, "x" * 1000
    given = [(1, "http://a.com/1", big), (2, "http://b.com/", big), (3, "http://a.com/1", other), (4, None, None), (5, "http://a.com/\r\nX: y%0A", "small"), (6, "http://a.com/", "small"),
             (7, "http://www.A.com:80/?b=2&a=1", big), (7, "http://www.A.com:80/?b=2&a=1", big), (None, "no url", big), (8, "", "x" * 999), (9, "", "x" * 999), (10, "http://[bad", other)]
    pages = spark.createDataFrame(given, "page_id long, url string, html string").withColumns({"path": F.lit(1), "digest": F.lit(2)}).repartition(4)
    got = archive_pages(pages).collect()
    assert len(got) == len(given)
    for r in got:
        html = next(h or "" for i, _, h in given if i == r["page_id"]).encode()
        assert r["payload_bytes"] == len(html) and r["payload_digest"] == hashlib.sha1(html).hexdigest()
        top = {big: 7, other: 10}.get(html.decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if top is None or r["page_id"] == top else ("revisit", top))
        assert r["url"] == next(u or "" for i, u, _ in given if i == r["page_id"])
    keys = [(r["url_key"].encode(), r["captured"]) for r in got]
    assert keys == sorted(keys) and "com,a)/?a=1&b=2" in {r["url_key"] for r in got}
    assert archive_pages(pages.where("false")).count() == 0


def test_warc_in_several_ranges(spark, monkeypatch):
    """Ranges far smaller than the table, several archives, and one payload on most pages by way of both joins."""
    from grovetally.llm import warc

    given = [(i, f"http://h{i % 7}.org/p{i % 50}", "same " * 300 if i % 3 else f"own {i} " * 200) for i in range(2000)]
    df = spark.createDataFrame(given, "page_id long, url string, html string").repartition(4)
    monkeypatch.setattr(warc, "RANGE", 150)
    whole = []
    for most in (500_000, 0):
        monkeypatch.setattr(warc, "SENT_PAYLOADS", most)
        got = warc.archive_pages(df, archive_bytes=20000)
        assert got.rdd.getNumPartitions() == 14
        whole.append([tuple(r) for r in got.select("url_key", "captured", "page_id", "record_type", "refers_to").collect()])
    assert whole[0] == whole[1] and whole[0] == sorted(whole[0], key=lambda r: (r[0].encode(), r[1], r[2])) and len(whole[0]) == 2000
    assert {(r[3], r[4]) for r in whole[0] if r[2] % 3 and r[2] != 1999} == {("revisit", 1999)} and all(r[3] == "response" for r in whole[0] if r[2] % 3 == 0 or r[2] == 1999)


def test_loser_tree():
    from grovetally.llm.warc import _place, merge

    r = random.Random(4)
    for k in [0, 1, 2, 3, 5, 8, 13]:
        runs = [sorted(((f"p{i}", j, r.choice("abcd"), str(r.randrange(5)), "u", r.choice([None, 1, 2, 3]), 0, "", "response", None) for j in range(r.randrange(0, 30))), key=_place) for i in range(k)]
        assert list(merge(runs)) == sorted((x for run in runs for x in run), key=_place)


# op10


def test_decontamination(spark, docs, none, clash, monkeypatch):
    from grovetally.llm import decontam

    items = [(0, prose(50, 30)), (1, prose(51, 12)), (2, "Ünlü Éa " + prose(52, 20)), (3, "tiny"), (4, None), (5, ""), (6, prose(53, 200)), (6, prose(53, 200)), (None, prose(54, 20))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    typo = list(items[0][1])
    for at in (20, 60, 100, 140):
        typo[at] = "#"
    far = "".join(c if i % 9 else "#" for i, c in enumerate(items[0][1]))
    given = [
        (0, prose(60, 40)), (1, prose(61, 500) + " " + items[0][1] + " " + prose(62, 100)), (2, items[0][1].upper().replace(" ", " \n\t")), (3, "".join(typo)), (4, far), (5, items[1][1][: len(items[1][1]) // 2]),
        (6, "x " + items[2][1].upper() + " y"), (7, "a tiny word"), (8, "atiny word"), (9, prose(63, 30) + " " + " ".join(items[6][1].split()[60:140])), (10, items[1][1] + " " + items[0][1]), (11, None), (12, ""), (11, items[1][1]),
    ]
    df = spark.createDataFrame(given, "doc_id long, text string")
    got = [(r["doc_id"], r["items"]) for r in decontam.matches(df, bench).collect()]
    expected = [[], [0], [0], [0], [], [], [2], [3], [], [6], [0, 1], [], [], [1]]
    assert [x for _, x in got] == expected
    assert decontam.matches(docs, bench).where("contaminated").count() == 0 and decontam.matches(none, bench).count() == 0
    assert decontam.matches(df, bench.where("false")).where("contaminated").count() == 0
    assert "_items" in decontam.matches(clash, bench, tuple(clash.columns)).columns
    assert len(list(decontam.blocks(bench, 200))) > 3
    monkeypatch.setattr(decontam, "BLOCK", 200)  # several passes
    assert sorted((r["doc_id"], r["items"]) for r in decontam.matches(df, bench).collect()) == sorted(got)


def test_decontamination_finds_parts_of_items(spark):
    """Any part of one and a half pieces is found wherever it stands, also in items of moderate length."""
    from grovetally.llm import decontam

    long = decontam.PIECE * 3 // 2
    item = prose(71, 40)[:long + 60]
    parts = [item[a : a + long].strip() for a in range(0, 61, 7)]
    given = [(i, f"{prose(72 + i, 80)} {p} {prose(99 + i, 30)}") for i, p in enumerate(parts)] + [(100, prose(73, 300)), (101, item[: decontam.PIECE // 2])]
    found = decontam.matches(spark.createDataFrame(given, "doc_id long, text string"), spark.createDataFrame([(5, item)], "item_id long, text string"))
    got = {r["doc_id"]: r["items"] for r in found.collect()}
    assert all(got[i] == [5] for i in range(len(parts)) if len(parts[i]) >= long - 2) and got[100] == [] and got[101] == []


def test_decontamination_of_many_short_items(spark):
    """Short items are runs of whole words; 20,000 of them take no search of the text each."""
    import time

    from grovetally.llm import decontam

    r = random.Random(9)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 4))) for _ in range(60)] + ["Жи", "x-y", "😀"]
    items = [(i, " ".join(r.choice(words) for _ in range(1 + i % 3))) for i in range(600)] + [(700, "a"), (701, "a"), (702, " a  b "), (703, "b\na")]
    items = [(i, t) for i, t in items if len(t.encode()) < decontam.Q]
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(0, 40))) for _ in range(80)] + [None, "", "a", "ab", "b", "a b", "A\n\nB"]
    got = decontam.matches(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    plain = {i: f" {decontam.normal_text(t).strip()} " for i, t in items}
    for row in got.collect():
        text = f" {decontam.normal_text(texts[row['doc_id']]).strip()} "
        assert row["items"] == sorted({i for i, p in plain.items() if p in text})
    many = decontam.Matcher(decontam.build([(i, f"w{i}") for i in range(20000)]))
    chunk = next(decontam.chunks(decontam.pa.array([" ".join(f"w{r.randrange(40000)}" for _ in range(100000))])))
    began = time.perf_counter()
    assert 15000 < len(many.find(chunk)) <= 20000 and time.perf_counter() - began < 5


def test_decontamination_on_tables(spark, small):
    from grovetally.llm import decontam

    bench = [(r["item_id"], decontam.normal_text(r["text"]).strip()) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    texts = {r["doc_id"]: decontam.normal_text(r["text"]) for r in small.collect()}
    got = {r["doc_id"]: set(r["items"]) for r in decontam.matches(small, spark.read.parquet(f"{SMALL}/benchmark.parquet")).collect()}
    for i, t in texts.items():
        assert {b for b, p in bench if p in t} <= got[i]


def test_decontamination_against_all_alignments(spark, small):
    """Every document against every item by whole edit-distance tables: no match is missed, none is made up."""
    from grovetally.llm import decontam

    r = random.Random(6)
    items = [(x["item_id"], x["text"]) for x in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()][:12]
    texts = [(x["doc_id"], x["text"]) for x in small.orderBy("doc_id").limit(40).collect()]
    for i, (_, t) in enumerate(items):  # items with some edits inside other text
        chars = list(t)
        for _ in range(i):
            chars[r.randrange(len(chars))] = r.choice("abc ")
        texts.append((1000 + i, f"Before it. {''.join(chars)} and after"))
    got = {x["doc_id"]: x["items"] for x in decontam.matches(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    found = 0
    for d, t in texts:
        text = decontam.normal_text(t).encode()
        for i, item in items:
            p = decontam.normal_text(item).encode().strip()
            last = max(0, len(p) - decontam.PIECE)
            parts = [p[a : a + decontam.PIECE] for a in sorted({*range(0, last, decontam.PIECE // 2), last})]
            hit = any(brute.best_edits(x, text) <= min(int(decontam.EDITS * len(x)), (len(x) - decontam.Q) // decontam.Q) for x in parts)
            found += hit
            assert (i in got[d]) == hit, (d, i)
    assert found >= 6


def test_decontamination_of_one_repeated_character():
    """Memory does not grow with the pairs of equal q-grams."""
    import resource

    import pyarrow as pa

    from grovetally.llm import decontam
    from grovetally.llm._text import chunks

    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    matcher = decontam.Matcher(decontam.build([(1, "-" * 200), (2, "=" * 150 + "tail of an item")]))
    (c,) = chunks(pa.array(["-" * 1000000 + "x" + "=" * 100]))
    assert matcher.find(c) == {(0, 1)}
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 700_000


def test_alignment():
    from grovetally.llm.decontam import aligned

    def distance(p, t):
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p):
            new = [i + 1]
            for j, d in enumerate(t):
                new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
            row = new
        return min(row)

    r = random.Random(8)
    for _ in range(300):
        p, t = ("".join(r.choice("ab") for _ in range(r.randrange(1, 12))) for _ in range(2))
        d = distance(p, t)
        for k in range(0, 6):
            assert aligned(p.encode(), t.encode(), k) == (d <= k), (p, t, k)


# the pipeline


def test_pipeline(spark, small, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "jaccard", "decontaminate", "pii", "mix"] and corpus_pipeline.ORACLE_SQL is None
    labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    bench = [r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    docs = small
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = {r["doc_id"]: r for r in docs.collect()}
        if i < 4:
            assert docs.columns == small.columns
        if name == "toxicity":
            clean = [i for i, (_, t) in labels.items() if not t]
            assert sum(i in after for i in clean) >= 0.97 * len(clean)
        elif name == "jaccard":
            assert set(after) == {c if n else i for i, (n, c) in brute.jaccard_components(before).items()}
        elif name == "decontaminate":
            assert {i for i, t in before if any(b in t for b in bench)} == {i for i, _ in before} - set(after)
        elif name == "pii":
            assert all(not brute.pii(r["text"])[1] or "<" in r["text"] for r in after.values()) and all(r["n_chars"] == len(r["text"]) for r in after.values())
            assert all(after[i]["text"] == t for i, t in before if not brute.pii(t)[1] and "<" not in after[i]["text"])
        else:
            assert set(after) == {i for i, _ in before}
    assert sorted(map(tuple, corpus_pipeline.run(spark, SMALL).collect())) == sorted(map(tuple, docs.collect()))


def test_pipeline_on_awkward_rows(spark, docs, none, tmp_path):
    import corpus_pipeline

    for given in (docs.withColumns({"toxic": F.lit(1), "items": F.lit("x"), "gone": F.lit(0)}), none):
        df = given
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{len(given.columns)}-{name}")
            stage(spark, df, SMALL).write.parquet(path)
            df = spark.read.parquet(path)
            if i < 4:
                assert df.columns == given.columns
        assert (df.count() > 0) == (given is not none)


def test_garbage_of_the_driver_goes_when_rows_are_kept(spark, monkeypatch):
    from grovetally.llm import _spark

    def collected(share, keep):
        monkeypatch.setattr(_spark, "FULL", share, raising=False)
        old = [b for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in b.getName() or "MarkSweep" in b.getName()]
        before = sum(b.getCollectionCount() for b in old)
        assert keep(spark.range(3)).count() == 3
        return sum(b.getCollectionCount() for b in old) > before

    for keep in (_spark.cut, lambda df: _spark.written(df, "kept")):
        assert collected(0.0, keep) and not collected(1.0, keep)


def test_every_query_is_registered():
    import re

    from grovetally.llm.queries import QUERIES, SQL

    exact = {"mix_targets", "jaccard_links", "pii_counts", "rules_base"}  # what SQL can express of op1, op6 and op8, and the links of op2
    assert exact <= set(SQL) and sorted(int(re.match(r"op(\d+)_", n)[1]) for n in set(QUERIES) - exact) == list(range(1, 14)) and set(SQL) <= set(QUERIES)
