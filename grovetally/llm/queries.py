"""The queries of this subpackage and their SQL, as ``__spark_entry__`` registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, exact, importance, jaccard, lm, mixing, perplexity, pii, rules, toxicity, trie, warc
from ._spark import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.groups(table(spark, sf_dir, "documents"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    done = chat.format_chats(chat.gathered(rows.unionByName(extra), chat.MAPPINGS))
    back = done.select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("turns"))
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    back = back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), loss.alias("loss"), "formatted")
    return back.select(
        "conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = {k.name for k in pii.KINDS if k.base}
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k) for k in ("email", "ip", "card", "phone")],
        F.sha2(pii.joined(F.filter("pii", lambda s: s["kind"].isin(*base))), 256).alias("base_sha256"), pii.joined(F.col("pii")).alias("spans"),
    )


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.apply_rules(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.groups(table(spark, sf_dir, "documents"))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """Conversations that begin with turns of another one: c with the first h of c - c % 5, h being crc32(c) % 9; see op13's contract.

    A conversation gives at most its first eight turns to at most nine others, so no key is hot."""
    own = written(trie.labelled(turns), "labelled")
    family = F.col("conv_id") - F.col("conv_id") % 5
    heads = own.where(F.col("conv_id") % 5 == 0).select(F.col("conv_id").alias("family"), F.slice("turns", 1, 8).alias("head"))
    both = own.withColumn("family", family).join(heads, "family", "left")
    h = (F.crc32(F.col("conv_id").cast("string")) % 9).cast("int")
    head = F.coalesce(F.slice("head", F.lit(1), h), F.slice("turns", 1, 0))
    return both.select("conv_id", F.concat(head, F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefixes(rebuilt(table(spark, sf_dir, "conversations")))


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sizes and targets of op1, which SQL can express."""
    return op1_mix(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"))


def jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole join of op2: class and number of links of each document."""
    return jaccard.link_counts(table(spark, sf_dir, "documents"))


def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of op6 for the base kinds, which SQL can express."""
    return op6_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def rules_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base figures of op8, which SQL can express."""
    return op8_rules(spark, sf_dir).drop("kept")


QUERIES = {f.__name__: f for f in (op1_mix, op2_jaccard, op3_chat, op4_lm, op5_quality, op6_pii, op7_toxicity, op8_rules, op9_warc, op10_decontaminate, op11_exact, op12_resample, op13_trie, mix_targets, jaccard_links, pii_counts, rules_base)}

_LENGTH = "length({x}) + length({x}) - length(replace(replace({x}, chr(92), ''), '<', ''))"

#: CRC-32 in SQL of a text whose bytes are x in hex, given a list t of 256 numbers.
_TABLE = "SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t"
_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(x) // 2 + 1), lambda i: ('0x' || substr(x, 2 * i - 1, 2))::BIGINT)),
lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"""


def _runs(table: str, key: str) -> str:
    words = f"SELECT {key} AS k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {table}"
    return " UNION ALL ".join(f"SELECT k, unnest(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) AS f FROM ({words}) WHERE len(w) >= {n}" for n in (1, 2, 3))


#: DuckDB SQL for the rows of a query, where SQL can express them.
SQL: dict[str, str] = {
    "op2_jaccard": r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s), u AS (SELECT doc_id, unnest(s) AS s FROM s),
e AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM u a JOIN u b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT e.a, e.b FROM e JOIN n x ON x.doc_id = e.a JOIN n y ON y.doc_id = e.b WHERE 100 * e.c >= 80 * (x.n + y.n - e.c)),
g AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, g.b FROM r JOIN g ON r.b = g.a)
SELECT n.doc_id, any_value(n.n) AS n_shingles, min(r.b) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY n.doc_id""",
    "op3_chat": f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -7, t, r, chr(92) || '### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
g AS (SELECT conv_id, count(*)::BIGINT AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole,
coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
sum({len(chat.TURN + chat.TEXT + chat.END)} + {_LENGTH.format(x='role')} + {_LENGTH.format(x='text')})::BIGINT AS formatted_chars FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g""",
    "op9_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS n, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to FROM p""",
    "op11_exact": r"""WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t)::BIGINT AS group_size, doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM d""",
    "op12_resample": f"""WITH c AS ({_TABLE}), x AS ({_runs('documents', 'doc_id')}), y AS ({_runs('benchmark', 'item_id')}),
z AS MATERIALIZED (SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM x UNION SELECT f FROM y)), b AS MATERIALIZED (SELECT f, ({_CRC} % 10000)::INT AS b FROM z, c),
s AS (SELECT b, count(*) AS s FROM x JOIN b USING (f) GROUP BY b), t AS (SELECT b, count(*) AS t FROM y JOIN b USING (f) GROUP BY b),
g AS (SELECT r.range::INT AS b, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE) / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain
FROM range(10000) r LEFT JOIN s ON s.b = r.range LEFT JOIN t ON t.b = r.range),
w AS (SELECT k, count(*) AS n, sum(gain) AS weight, count(*) FILTER (strpos(f, ' ') = 0) AS words FROM x JOIN b USING (f) JOIN g USING (b) GROUP BY k),
d AS (SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, coalesce(words, 0) AS words, coalesce(weight, 0)::BIGINT
+ floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM documents LEFT JOIN w ON k = doc_id),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM d WHERE words >= 20)
SELECT d.doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT 5 * count(*) // 100 FROM r) THEN rank END::BIGINT AS rank FROM d LEFT JOIN r USING (doc_id)""",
    "op13_trie": f"""WITH p AS ({_TABLE}), l AS (SELECT conv_id AS c, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS label, strlen(coalesce(text, '')) AS size FROM conversations WHERE conv_id IS NOT NULL),
i AS (SELECT c, label, size, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, label) AS i FROM l), h AS (SELECT c, {_CRC} % 9 AS h FROM (SELECT DISTINCT c, hex(encode(c::VARCHAR)) AS x FROM l), p),
u AS (SELECT h.c, 0 AS part, i, label, size FROM h JOIN i ON i.c = h.c - h.c % 5 AND i <= h UNION ALL SELECT h.c, 1, i, label, size FROM h JOIN i ON i.c = h.c AND i > h),
o AS (SELECT c, size, row_number() OVER w AS d, sha256(string_agg(label, '') OVER w) AS k FROM u WINDOW w AS (PARTITION BY c ORDER BY part, i ROWS UNBOUNDED PRECEDING)),
v AS (SELECT c, 0 AS size, 0 AS d, '' AS k FROM h UNION ALL SELECT c, size, d, k FROM o), m AS (SELECT c, max(d) AS last FROM v GROUP BY c),
a AS (SELECT c, d, k, size, lag(k) OVER (PARTITION BY c ORDER BY d) AS up, d = last AS ends FROM v JOIN m USING (c)),
n AS (SELECT k, d, min(c) AS conv_id, count(*)::BIGINT AS n_convs, any_value(size) AS size, any_value(up) AS up, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends FROM a GROUP BY k, d),
q AS (SELECT up, count(*)::BIGINT AS n FROM n WHERE up IS NOT NULL GROUP BY up), e AS (SELECT n.*, coalesce(q.n, 0)::BIGINT AS n_children FROM n LEFT JOIN q ON q.up = n.k),
s AS (SELECT a.k, a.d, count(*) FILTER (e.n_children = 0)::BIGINT AS n_leaves, sum((e.n_convs - 1) * e.size)::BIGINT AS saved FROM a JOIN e ON e.conv_id = a.c AND e.d >= a.d GROUP BY a.k, a.d)
SELECT e.conv_id, e.d::BIGINT AS depth, f.conv_id AS parent_conv_id, e.n_convs, e.n_children, s.n_leaves, s.saved AS saved_tokens, e.ends AS ends_sha256 FROM e JOIN s USING (k, d) LEFT JOIN n f ON f.k = e.up AND f.d = e.d - 1""",
    "mix_targets": r"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM d GROUP BY source),
c AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / w AS ratio, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM s),
l AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
t AS (SELECT source, source_size, least(cap, coalesce(max(level) FILTER (level <= ratio) OVER (), 'Infinity'::DOUBLE) * w) AS target FROM l)
SELECT doc_id, size, source_size, round(target, 6) AS target FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source""",
    "jaccard_links": r"""WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
k AS (SELECT doc_id, len(s) AS n, CASE WHEN len(s) > 0 THEN min(doc_id) OVER (PARTITION BY list_sort(s)) ELSE doc_id END AS class_id FROM s), u AS (SELECT doc_id, unnest(s) AS s FROM s),
e AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM u a JOIN u b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT e.a, count(*)::BIGINT AS n FROM e JOIN k x ON x.doc_id = e.a JOIN k y ON y.doc_id = e.b WHERE 100 * e.c >= 80 * (x.n + y.n - e.c) GROUP BY e.a)
SELECT k.doc_id, k.class_id, coalesce(l.n, 0)::BIGINT AS n_links FROM k LEFT JOIN l ON l.a = k.doc_id""",
    "pii_counts": r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS email, regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS ip,
regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+') AS card, regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]') AS phone FROM d),
n AS (SELECT *, list_filter(list_transform(card, lambda x: reverse(regexp_replace(x, '[^0-9]', '', 'g'))), lambda x: length(x) BETWEEN 13 AND 19) AS digits FROM m)
SELECT doc_id, len(email)::BIGINT AS n_email,
len(list_filter(ip, lambda x: len(list_filter(string_split(x, '.'), lambda p: length(ltrim(p, '0')) > 3 OR (length(ltrim(p, '0')) = 3 AND ltrim(p, '0') > '255'))) = 0))::BIGINT AS n_ip,
len(list_filter(digits, lambda x: list_sum(list_transform(range(1, length(x) + 1), lambda i: (substr(x, i, 1)::INT * (2 - i % 2)) // 10 + (substr(x, i, 1)::INT * (2 - i % 2)) % 10)) % 10 = 0))::BIGINT AS n_card,
len(list_filter(phone, lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 9 AND 15))::BIGINT AS n_phone FROM n""",
    "rules_base": r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
x AS (SELECT r, unnest(list_transform(range(1, len(w) - 3), lambda i: {'i': i, 'g': array_to_string(w[i:i + 4], ' ')})) AS s FROM d WHERE len(w) >= 5),
y AS (SELECT r, s.i AS i, count(*) OVER (PARTITION BY r, s.g) AS c FROM x), z AS (SELECT r, count(DISTINCT p)::BIGINT AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM y WHERE c > 1) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda v: length(v))), 0)::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
(len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(z.n, 0) AS n_repeat_words, len(w) < 10 OR 100 * coalesce(z.n, 0) > 20 * len(w) AS base_failed FROM d LEFT JOIN z USING (r)""",
}
