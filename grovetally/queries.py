"""A query for each operator over the driver's tables, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    Average, Bag, Bin, Branch, Categorize, CentrallyBin, Count, Deviate, Fraction, Histogram, Index, IrregularlyBin, Label, Maximize, Minimize, Profile,
    ProfileErr, Select, SparselyBin, SparselyHistogram, SparselyProfile, SparselyProfileErr, Stack, Sum, TwoDimensionallyHistogram,
    TwoDimensionallySparselyHistogram, UntypedLabel, aggregate, tidy,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Decimals to which means, variances and sums are compared.
DIGITS = {"sum": 2, "mean": 6, "variance": 4, "min": 6, "max": 6, "entries": 6}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shown(rows: DataFrame, path: str, cols: str, keys: str = "") -> DataFrame:
    """The tidy rows of a path: ``keys`` are "name type" of the bins, ``cols`` the measures."""
    out: list[Column] = []
    for i, k in enumerate(filter(None, keys.split(", "))):
        name, kind = k.split(" ")
        out.append(F.col("keys")[i].cast(kind).alias(name))
    out += [F.round(c, DIGITS[c]).alias(c) for c in cols.split(", ")]
    return rows.where(F.col("path") == path).select(*out)


def lineitem(spark, d):
    return read(spark, d, "lineitem")


def bin_sql(q: str, num: int, low: float, high: float) -> str:
    return f"CASE WHEN isnan({q}) THEN -3 WHEN {q} < {low} THEN -1 WHEN {q} >= {high} THEN -2 ELSE least(floor(({q} - {low}) * {num} / ({high} - {low})), {num - 1}) END::BIGINT"


def dense_sql(num: int, inner: str, cols: str) -> str:
    """All bins left-joined with an aggregate ``inner`` that has a column bin."""
    return f"SELECT r.range::BIGINT AS bin, {cols} FROM range({num}) r LEFT JOIN ({inner}) a ON a.bin = r.range"


# leaves ------------------------------------------------------------------------------------

_LEAVES = {
    "sum": (Sum, "entries, sum", "{n} AS entries, round(sum({w} * {q}), 2) AS sum"),
    "average": (Average, "entries, mean", "{n} AS entries, round(sum({w} * {q}) / sum({w}), 6) AS mean"),
    "deviate": (Deviate, "entries, mean, variance", "{n} AS entries, round(any_value(m), 6) AS mean, round(sum({w} * ({q} - m) * ({q} - m)) / sum({w}), 4) AS variance"),
    "minimize": (Minimize, "entries, min", "{n} AS entries, round(min({q}), 6) AS min"),
    "maximize": (Maximize, "entries, max", "{n} AS entries, round(max({q}), 6) AS max"),
}


def _leaf(kind: str, how: str) -> None:
    make, cols, sql = _LEAVES[kind]
    q = "l_discount" if kind == "deviate" else "l_extendedprice"
    cut = {"": None, "weighted": "l_quantity", "filtered": "l_returnflag = 'R'"}[how]
    w = "l_quantity" if how == "weighted" else "1.0::DOUBLE"

    def run(spark, d):
        leaf = make(q)
        rows = tidy(lineitem(spark, d), leaf if cut is None else Select(cut, leaf))
        return shown(rows, "" if cut is None else "data", cols)

    where = f" WHERE {cut}" if how == "filtered" else ""
    source = f"(SELECT *, (SELECT sum({w} * {q}) / sum({w}) FROM lineitem{where}) AS m FROM lineitem{where})" if kind == "deviate" else f"lineitem{where}"
    name = f"{kind}_{how}" if how else kind
    run.__name__ = name
    query(f"SELECT {sql.format(n=f'sum({w})::DOUBLE', w=w, q=q)} FROM {source}")(run)


for _kind in _LEAVES:
    for _how in ("", "weighted", "filtered"):
        _leaf(_kind, _how)


@query("SELECT count(*)::DOUBLE AS entries FROM lineitem")
def count(spark, d):
    return shown(tidy(lineitem(spark, d), Count()), "", "entries")


@query("SELECT round(sum(l_discount), 6) AS entries FROM lineitem WHERE l_discount > 0")
def count_weighted(spark, d):
    return shown(tidy(lineitem(spark, d), Select("l_discount", Count())), "data", "entries")


@query("SELECT sum(l_quantity * l_quantity)::DOUBLE AS entries FROM lineitem")
def count_transform(spark, d):
    return shown(tidy(lineitem(spark, d), Select("l_quantity", Count(lambda w: w * w))), "data", "entries")


@query("SELECT l_quantity::DOUBLE AS value, count(*)::DOUBLE AS entries FROM lineitem GROUP BY 1")
def bag_number(spark, d):
    return shown(tidy(lineitem(spark, d), Bag("l_quantity")), "values", "entries", "value double")


@query("SELECT l_returnflag AS value, count(*)::DOUBLE AS entries FROM lineitem GROUP BY 1")
def bag_string(spark, d):
    return shown(tidy(lineitem(spark, d), Bag("l_returnflag", "S")), "values", "entries", "value string")


@query("SELECT l_linenumber::DOUBLE AS x, l_quantity::DOUBLE AS y, count(*)::DOUBLE AS entries FROM lineitem GROUP BY 1, 2")
def bag_vector(spark, d):
    rows = tidy(lineitem(spark, d), Bag("array(double(l_linenumber), l_quantity)", "N2")).where("path = 'values'")
    v = F.from_json(F.col("keys")[0], "array<double>")
    return rows.select(v[0].alias("x"), v[1].alias("y"), "entries")


@query("SELECT embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, count(*)::DOUBLE AS entries FROM embeddings GROUP BY 1, 2")
def embeddings_bag(spark, d):
    rows = tidy(read(spark, d, "embeddings"), Bag("slice(embedding, 1, 2)", "N2")).where("path = 'values'")
    v = F.from_json(F.col("keys")[0], "array<double>")
    return rows.select(v[0].alias("x"), v[1].alias("y"), "entries")


# equal bins ---------------------------------------------------------------------------------

_PRICE = (50, 10000.0, 90000.0)
_PRICE_SQL = f"SELECT *, {bin_sql('l_extendedprice', *_PRICE)} AS bin FROM lineitem"


def _price(value=None, **flows):
    return Bin(*_PRICE, "l_extendedprice", value, **flows)


@query(dense_sql(50, f"SELECT bin, count(*)::DOUBLE AS n FROM ({_PRICE_SQL}) GROUP BY bin", "coalesce(n, 0.0)::DOUBLE AS entries"))
def bin_count(spark, d):
    return shown(tidy(lineitem(spark, d), _price()), "values", "entries", "bin bigint")


@query(f"""SELECT p.path, coalesce(n, 0.0)::DOUBLE AS entries FROM (VALUES ('', 0), ('underflow', -1), ('overflow', -2), ('nanflow', -3)) p(path, code)
LEFT JOIN (SELECT bin, count(*)::DOUBLE AS n FROM ({_PRICE_SQL}) GROUP BY bin HAVING bin < 0 UNION ALL SELECT 0, count(*)::DOUBLE FROM lineitem) a ON a.bin = p.code""")
def bin_flows(spark, d):
    return tidy(lineitem(spark, d), _price()).where("path <> 'values'").select("path", "entries")


@query(dense_sql(50, f"SELECT bin, count(*)::DOUBLE AS n, sum(l_tax) AS s FROM ({_PRICE_SQL}) GROUP BY bin", "coalesce(n, 0.0)::DOUBLE AS entries, round(coalesce(s, 0.0), 2) AS sum"))
def bin_sum(spark, d):
    return shown(tidy(lineitem(spark, d), _price(Sum("l_tax"))), "values", "entries, sum", "bin bigint")


@query(dense_sql(50, f"SELECT bin, count(*)::DOUBLE AS n, avg(l_quantity) AS m FROM ({_PRICE_SQL}) GROUP BY bin", "coalesce(n, 0.0)::DOUBLE AS entries, coalesce(round(m, 6), 'NaN'::DOUBLE) AS mean"))
def bin_average(spark, d):
    return shown(tidy(lineitem(spark, d), _price(Average("l_quantity"))), "values", "entries, mean", "bin bigint")


_DEVIATE_COLS = "coalesce(n, 0.0)::DOUBLE AS entries, coalesce(round(m, 6), 'NaN'::DOUBLE) AS mean, coalesce(round(v, 4), 'NaN'::DOUBLE) AS variance"


@query(dense_sql(50, f"SELECT bin, count(*)::DOUBLE AS n, avg(l_quantity) AS m, var_pop(l_quantity) AS v FROM ({_PRICE_SQL}) GROUP BY bin", _DEVIATE_COLS))
def bin_deviate(spark, d):
    return shown(tidy(lineitem(spark, d), _price(Deviate("l_quantity"))), "values", "entries, mean, variance", "bin bigint")


@query(dense_sql(50, f"""SELECT a.bin, sum(l_quantity)::DOUBLE AS n, any_value(m) AS m, sum(l_quantity * (l_discount - m) * (l_discount - m)) / sum(l_quantity) AS v
FROM ({_PRICE_SQL}) a JOIN (SELECT bin, sum(l_quantity * l_discount) / sum(l_quantity) AS m FROM ({_PRICE_SQL}) GROUP BY bin) b ON a.bin = b.bin GROUP BY a.bin""", _DEVIATE_COLS))
def bin_deviate_weighted(spark, d):
    return shown(tidy(lineitem(spark, d), Select("l_quantity", _price(Deviate("l_discount")))), "data/values", "entries, mean, variance", "bin bigint")


@query(f"""SELECT r.range::BIGINT AS bin, p.path, round(CASE p.path WHEN 'i0/values' THEN lo ELSE hi END, 6) AS value FROM range(50) r
CROSS JOIN (VALUES ('i0/values'), ('i1/values')) p(path) LEFT JOIN (SELECT bin, min(l_quantity) AS lo, max(l_quantity) AS hi FROM ({_PRICE_SQL}) GROUP BY bin) a ON a.bin = r.range""")
def bin_minmax(spark, d):
    rows = tidy(lineitem(spark, d), Branch(_price(Minimize("l_quantity")), _price(Maximize("l_quantity")))).where("path in ('i0/values', 'i1/values')")
    return rows.select(F.col("keys")[0].cast("bigint").alias("bin"), "path", F.round(F.coalesce("min", "max"), 6).alias("value"))


@query(f"""SELECT x.range::BIGINT AS x, y.range::BIGINT AS y, coalesce(n, 0.0)::DOUBLE AS entries FROM range(20) x CROSS JOIN range(11) y LEFT JOIN
(SELECT {bin_sql('l_extendedprice', 20, 0.0, 80000.0)} AS bx, {bin_sql('l_discount', 11, 0.0, 0.11)} AS b, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2) a ON a.bx = x.range AND a.b = y.range""")
def bin_bin_2d(spark, d):
    return shown(tidy(lineitem(spark, d), Bin(20, 0, 80000, "l_extendedprice", Bin(11, 0, 0.11, "l_discount"))), "values/values", "entries", "x bigint, y bigint")


@query(f"""SELECT 'underflow' AS path, count(*)::DOUBLE AS entries, round(sum(l_tax), 2) AS sum, NULL::DOUBLE AS mean FROM ({_PRICE_SQL}) WHERE bin = -1
UNION ALL SELECT 'overflow', count(*)::DOUBLE, NULL, round(avg(l_quantity), 6) FROM ({_PRICE_SQL}) WHERE bin = -2
UNION ALL SELECT 'nanflow', count(*)::DOUBLE, NULL, NULL FROM ({_PRICE_SQL}) WHERE bin = -3""")
def bin_custom_flows(spark, d):
    rows = tidy(lineitem(spark, d), _price(underflow=Sum("l_tax"), overflow=Average("l_quantity"))).where("path in ('underflow', 'overflow', 'nanflow')")
    return rows.select("path", "entries", F.round("sum", 2).alias("sum"), F.round("mean", 6).alias("mean"))


_HOLES = "case when l_linenumber = 7 then 'NaN'::double when l_linenumber = 6 then 'Infinity'::double when l_linenumber = 5 then '-Infinity'::double else l_quantity end"


@query(f"""SELECT p.path, p.bin::BIGINT AS bin, coalesce(n, 0.0)::DOUBLE AS entries FROM
(SELECT 'values' AS path, range AS bin FROM range(10) UNION ALL VALUES ('underflow', -1), ('overflow', -2), ('nanflow', -3)) p(path, bin)
LEFT JOIN (SELECT {bin_sql('q', 10, 5.0, 45.0)} AS bin, count(*)::DOUBLE AS n FROM (SELECT {_HOLES} AS q FROM lineitem) GROUP BY 1) a ON a.bin = p.bin""")
def bin_nan(spark, d):
    rows = tidy(lineitem(spark, d), Bin(10, 5, 45, _HOLES)).where("path <> ''")
    code = F.when(F.col("path") == "underflow", -1).when(F.col("path") == "overflow", -2).when(F.col("path") == "nanflow", -3).otherwise(F.try_element_at("keys", F.lit(1)).cast("bigint"))
    return rows.select("path", code.cast("bigint").alias("bin"), "entries")


# other binnings -----------------------------------------------------------------------------


@query("SELECT floor((l_extendedprice - 0.0) / 1000.0)::BIGINT AS bin, count(*)::DOUBLE AS entries FROM lineitem GROUP BY 1")
def sparse_count(spark, d):
    return shown(tidy(lineitem(spark, d), SparselyBin(1000, "l_extendedprice")), "bins", "entries", "bin bigint")


@query("SELECT floor((l_quantity - 2.5) / 7.0)::BIGINT AS bin, count(*)::DOUBLE AS entries, round(sum(l_extendedprice), 2) AS sum FROM lineitem GROUP BY 1")
def sparse_origin(spark, d):
    return shown(tidy(lineitem(spark, d), SparselyBin(7, "l_quantity", Sum("l_extendedprice"), origin=2.5)), "bins", "entries, sum", "bin bigint")


@query("SELECT floor((c_acctbal - 0.0) / 250.0)::BIGINT AS bin, count(*)::DOUBLE AS entries FROM customer GROUP BY 1")
def sparse_negative(spark, d):
    return shown(tidy(read(spark, d, "customer"), SparselyBin(250, "c_acctbal")), "bins", "entries", "bin bigint")


@query("SELECT floor((l_extendedprice - 0.0) / 5000.0)::BIGINT AS x, floor((l_quantity - 0.0) / 5.0)::BIGINT AS y, count(*)::DOUBLE AS entries FROM lineitem GROUP BY 1, 2")
def sparse_2d(spark, d):
    return shown(tidy(lineitem(spark, d), SparselyBin(5000, "l_extendedprice", SparselyBin(5, "l_quantity"))), "bins/bins", "entries", "x bigint, y bigint")


@query("SELECT floor((n_chars - 0.0) / 500.0)::BIGINT AS bin, count(*)::DOUBLE AS entries FROM documents GROUP BY 1")
def doc_len_sparse(spark, d):
    return shown(tidy(read(spark, d, "documents"), SparselyBin(500, "n_chars")), "bins", "entries", "bin bigint")


@query("SELECT floor(epoch(ts) / 3600.0)::BIGINT AS bin, count(*)::DOUBLE AS entries, round(sum(value), 2) AS sum FROM events GROUP BY 1")
def events_hourly(spark, d):
    seconds = F.col("ts").cast("timestamp").cast("double")
    return shown(tidy(read(spark, d, "events"), SparselyBin(3600, seconds, Sum("value"))), "bins", "entries, sum", "bin bigint")


_CENTERS = (2.0, 5.0, 11.0, 25.0, 40.0)
_CENTRAL_SQL = "CASE WHEN l_quantity < 3.5 THEN 0 WHEN l_quantity < 8.0 THEN 1 WHEN l_quantity < 18.0 THEN 2 WHEN l_quantity < 32.5 THEN 3 ELSE 4 END"


@query(dense_sql(5, f"SELECT {_CENTRAL_SQL} AS bin, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1", "coalesce(n, 0.0)::DOUBLE AS entries"))
def central_count(spark, d):
    return shown(tidy(lineitem(spark, d), CentrallyBin(_CENTERS, "l_quantity")), "bins", "entries", "bin bigint")


@query(dense_sql(5, f"SELECT {_CENTRAL_SQL} AS bin, count(*)::DOUBLE AS n, avg(l_extendedprice) AS m FROM lineitem GROUP BY 1", "coalesce(n, 0.0)::DOUBLE AS entries, round(m, 6) AS mean"))
def central_average(spark, d):
    return shown(tidy(lineitem(spark, d), CentrallyBin(_CENTERS, "l_quantity", Average("l_extendedprice"))), "bins", "entries, mean", "bin bigint")


_EDGES = (5000.0, 20000.0, 45000.0, 80000.0, 200000.0)
_EDGE_SQL = "CASE WHEN l_extendedprice >= 200000 THEN 5 WHEN l_extendedprice >= 80000 THEN 4 WHEN l_extendedprice >= 45000 THEN 3 WHEN l_extendedprice >= 20000 THEN 2 WHEN l_extendedprice >= 5000 THEN 1 ELSE 0 END"


@query(dense_sql(6, f"SELECT {_EDGE_SQL} AS bin, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1", "coalesce(n, 0.0)::DOUBLE AS entries"))
def irregular_count(spark, d):
    return shown(tidy(lineitem(spark, d), IrregularlyBin(_EDGES, "l_extendedprice")), "bins", "entries", "bin bigint")


@query(dense_sql(6, f"SELECT {_EDGE_SQL} AS bin, count(*)::DOUBLE AS n, sum(l_quantity) AS s FROM lineitem GROUP BY 1", "coalesce(n, 0.0)::DOUBLE AS entries, round(coalesce(s, 0.0), 2) AS sum"))
def irregular_sum(spark, d):
    return shown(tidy(lineitem(spark, d), IrregularlyBin(_EDGES, "l_extendedprice", Sum("l_quantity"))), "bins", "entries, sum", "bin bigint")


@query("SELECT event_type AS category, count(*)::DOUBLE AS entries FROM events GROUP BY 1")
def categorize_count(spark, d):
    return shown(tidy(read(spark, d, "events"), Categorize("event_type")), "bins", "entries", "category string")


@query("SELECT o_orderpriority AS category, count(*)::DOUBLE AS entries, round(avg(o_totalprice / 1000), 6) AS mean, round(var_pop(o_totalprice / 1000), 4) AS variance FROM orders GROUP BY 1")
def categorize_deviate(spark, d):
    return shown(tidy(read(spark, d, "orders"), Categorize("o_orderpriority", Deviate("o_totalprice / 1000"))), "bins", "entries, mean, variance", "category string")


@query(f"SELECT event_type AS category, {bin_sql('value', 10, 0.0, 400.0)} AS bin, count(*)::DOUBLE AS entries FROM events GROUP BY 1, 2 HAVING bin >= 0")
def categorize_bin(spark, d):
    return shown(tidy(read(spark, d, "events"), Categorize("event_type", Bin(10, 0, 400, "value"))), "bins/values", "entries", "category string, bin bigint")


@query("SELECT coalesce(nullif(event_type, 'view'), 'NaN') AS category, count(*)::DOUBLE AS entries FROM events GROUP BY 1")
def categorize_null(spark, d):
    return shown(tidy(read(spark, d, "events"), Categorize("nullif(event_type, 'view')")), "bins", "entries", "category string")


# selections ---------------------------------------------------------------------------------


@query("SELECT count(*) FILTER (l_discount > 0.05)::DOUBLE AS numerator, count(*)::DOUBLE AS denominator FROM lineitem")
def fraction_count(spark, d):
    rows = tidy(lineitem(spark, d), Fraction("l_discount > 0.05"))
    pick = lambda p: F.max(F.when(F.col("path") == p, F.col("entries"))).alias(p)
    return rows.agg(pick("numerator"), pick("denominator"))


@query(f"""SELECT p.path, r.range::BIGINT AS bin, coalesce(CASE p.path WHEN 'numerator/values' THEN a.num ELSE a.den END, 0.0)::DOUBLE AS entries FROM range(50) r CROSS JOIN (VALUES ('numerator/values'), ('denominator/values')) p(path)
LEFT JOIN (SELECT bin, count(*)::DOUBLE AS den, count(*) FILTER (l_returnflag = 'R')::DOUBLE AS num FROM ({_PRICE_SQL}) GROUP BY bin) a ON a.bin = r.range""")
def fraction_bin(spark, d):
    rows = tidy(lineitem(spark, d), Fraction("l_returnflag = 'R'", _price())).where("path like '%/values'")
    return rows.select("path", F.col("keys")[0].cast("bigint").alias("bin"), "entries")


@query("""SELECT 'numerator/bins' AS path, floor(l_quantity / 5.0)::BIGINT AS bin, round(sum(l_discount), 6) AS entries FROM lineitem WHERE l_discount > 0 AND l_quantity < 20 GROUP BY 2
UNION ALL SELECT 'denominator/bins', floor(l_quantity / 5.0)::BIGINT, count(*)::DOUBLE FROM lineitem GROUP BY 2""")
def fraction_weighted(spark, d):
    w = "case when l_quantity < 20 then l_discount else 0 end"
    rows = tidy(lineitem(spark, d), Fraction(w, SparselyBin(5, "l_quantity"))).where("path like '%/bins'")
    return rows.select("path", F.col("keys")[0].cast("bigint").alias("bin"), F.round("entries", 6).alias("entries"))


_STACK = (10.0, 20.0, 30.0, 40.0)
_STACK_ROWS = "(VALUES (0, '-Infinity'::DOUBLE), (1, 10.0), (2, 20.0), (3, 30.0), (4, 40.0)) t(bin, edge)"


@query(f"SELECT t.bin::BIGINT AS bin, count(l_quantity)::DOUBLE AS entries FROM {_STACK_ROWS} LEFT JOIN lineitem ON l_quantity >= t.edge GROUP BY 1")
def stack_count(spark, d):
    return shown(tidy(lineitem(spark, d), Stack(_STACK, "l_quantity")), "bins", "entries", "bin bigint")


@query(f"SELECT t.bin::BIGINT AS bin, count(l_quantity)::DOUBLE AS entries, round(sum(l_extendedprice), 2) AS sum FROM {_STACK_ROWS} LEFT JOIN lineitem ON l_quantity >= t.edge GROUP BY 1")
def stack_sum(spark, d):
    return shown(tidy(lineitem(spark, d), Stack(_STACK, "l_quantity", Sum("l_extendedprice"))), "bins", "entries, sum", "bin bigint")


@query(f"SELECT t.bin::BIGINT AS bin, count(l_quantity)::DOUBLE AS entries, round(avg(l_extendedprice), 6) AS mean FROM {_STACK_ROWS} LEFT JOIN lineitem ON l_quantity >= t.edge GROUP BY 1")
def stack_average(spark, d):
    return shown(tidy(lineitem(spark, d), Stack(_STACK, "l_quantity", Average("l_extendedprice"))), "bins", "entries, mean", "bin bigint")


@query(f"SELECT t.bin::BIGINT AS bin, count(l_quantity)::DOUBLE AS entries, round(avg(l_extendedprice / 1000), 6) AS mean, round(var_pop(l_extendedprice / 1000), 4) AS variance FROM {_STACK_ROWS} LEFT JOIN lineitem ON l_quantity >= t.edge GROUP BY 1")
def stack_deviate(spark, d):
    return shown(tidy(lineitem(spark, d), Stack(_STACK, "l_quantity", Deviate("l_extendedprice / 1000"))), "bins", "entries, mean, variance", "bin bigint")


@query(f"""SELECT b.bin::BIGINT AS bin, r.range::BIGINT AS value, coalesce(n, 0.0)::DOUBLE AS entries FROM {_STACK_ROWS.replace('t(bin, edge)', 'b(bin, edge)')} CROSS JOIN range(50) r LEFT JOIN
(SELECT t.bin AS s, a.bin AS v, count(*)::DOUBLE AS n FROM {_STACK_ROWS} JOIN ({_PRICE_SQL}) a ON l_quantity >= t.edge GROUP BY 1, 2) c ON c.s = b.bin AND c.v = r.range""")
def stack_bin(spark, d):
    return shown(tidy(lineitem(spark, d), Stack(_STACK, "l_quantity", _price())), "bins/values", "entries", "bin bigint, value bigint")


@query("""SELECT 0::BIGINT AS layer, count(*)::DOUBLE AS entries FROM lineitem UNION ALL SELECT 1, count(*)::DOUBLE FROM lineitem WHERE l_returnflag IN ('N', 'R')
UNION ALL SELECT 2, count(*)::DOUBLE FROM lineitem WHERE l_returnflag = 'R'""")
def stack_build(spark, d):
    from .operators.results import Stacked

    r = aggregate(lineitem(spark, d), Label(*[(f, Select(f"l_returnflag = '{f}'", Count())) for f in "ANR"]))
    stack = Stacked.build(*[r[f].cut for f in "ANR"])
    return spark.createDataFrame([(i, v.entries) for i, (_, v) in enumerate(stack.bins)], "layer bigint, entries double")


@query("SELECT count(*)::DOUBLE AS entries, round(sum(l_extendedprice), 2) AS sum FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_quantity < 25")
def select_bool(spark, d):
    return shown(tidy(lineitem(spark, d), Select("l_shipdate >= timestamp_ntz'1995-01-01' and l_quantity < 25", Sum("l_extendedprice")), paths=["data"]), "data", "entries, sum")


@query("SELECT round(sum(l_tax), 6) AS entries, round(sum(l_tax * l_extendedprice), 2) AS sum FROM lineitem WHERE l_tax > 0")
def select_weight(spark, d):
    return shown(tidy(lineitem(spark, d), Select("l_tax", Sum("l_extendedprice"))), "data", "entries, sum")


@query("SELECT '' AS path, count(*)::DOUBLE AS entries FROM customer UNION ALL SELECT 'data', round(sum(c_acctbal), 6) FROM customer WHERE c_acctbal > 0")
def select_negative_weight(spark, d):
    return tidy(read(spark, d, "customer"), Select("c_acctbal", Count())).select("path", F.round("entries", 6).alias("entries"))


@query("""SELECT '' AS path, count(*)::DOUBLE AS entries FROM lineitem UNION ALL SELECT 'data', count(*)::DOUBLE FROM lineitem WHERE l_returnflag = 'R'
UNION ALL SELECT 'data/data', round(sum(l_discount), 6) FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0""")
def select_nested(spark, d):
    return tidy(lineitem(spark, d), Select("l_returnflag = 'R'", Select("l_discount", Count()))).select("path", F.round("entries", 6).alias("entries"))


# collections --------------------------------------------------------------------------------


@query("""SELECT 'low/data' AS path, count(*)::DOUBLE AS entries FROM lineitem WHERE l_quantity < 10
UNION ALL SELECT 'high/data', count(*)::DOUBLE FROM lineitem WHERE l_quantity >= 40 UNION ALL SELECT p, count(*)::DOUBLE FROM lineitem, (VALUES (''), ('low'), ('high')) v(p) GROUP BY p""")
def label(spark, d):
    return tidy(lineitem(spark, d), Label(low=Select("l_quantity < 10"), high=Select("l_quantity >= 40"))).select("path", "entries")


@query("""SELECT 'n' AS path, count(*)::DOUBLE AS entries, NULL::DOUBLE AS sum, NULL::DOUBLE AS mean FROM lineitem UNION ALL SELECT 's', count(*)::DOUBLE, round(sum(l_tax), 2), NULL FROM lineitem
UNION ALL SELECT 'a', count(*)::DOUBLE, NULL, round(avg(l_discount), 6) FROM lineitem""")
def untyped_label(spark, d):
    rows = tidy(lineitem(spark, d), UntypedLabel(n=Count(), s=Sum("l_tax"), a=Average("l_discount"))).where("path <> ''")
    return rows.select("path", "entries", F.round("sum", 2).alias("sum"), F.round("mean", 6).alias("mean"))


@query("SELECT '0' AS path, round(sum(l_tax), 2) AS sum FROM lineitem UNION ALL SELECT '1', round(sum(l_discount), 2) FROM lineitem UNION ALL SELECT '2', round(sum(l_quantity), 2) FROM lineitem")
def index(spark, d):
    return tidy(lineitem(spark, d), Index(Sum("l_tax"), Sum("l_discount"), Sum("l_quantity"))).where("path <> ''").select("path", F.round("sum", 2).alias("sum"))


@query(f"""SELECT 'i0/values' AS path, r.range::VARCHAR AS key, coalesce(n, 0.0)::DOUBLE AS entries, NULL::DOUBLE AS sum FROM range(50) r LEFT JOIN (SELECT bin, count(*)::DOUBLE AS n FROM ({_PRICE_SQL}) GROUP BY bin) a ON a.bin = r.range
UNION ALL SELECT 'i1/bins', l_returnflag, count(*)::DOUBLE, round(sum(l_extendedprice), 2) FROM lineitem GROUP BY 2
UNION ALL SELECT 'i2/bins', floor(l_quantity / 10.0)::BIGINT::VARCHAR, count(*)::DOUBLE, NULL FROM lineitem GROUP BY 2""")
def branch(spark, d):
    rows = tidy(lineitem(spark, d), Branch(_price(), Categorize("l_returnflag", Sum("l_extendedprice")), SparselyBin(10, "l_quantity"))).where("path in ('i0/values', 'i1/bins', 'i2/bins')")
    return rows.select("path", F.col("keys")[0].alias("key"), "entries", F.round("sum", 2).alias("sum"))


@query("""SELECT 'a/0/data' AS path, count(*)::DOUBLE AS entries FROM lineitem WHERE l_tax > 0.04 UNION ALL SELECT 'a/1/data', count(*)::DOUBLE FROM lineitem WHERE l_tax > 0.06
UNION ALL SELECT 'b/0/data', count(*)::DOUBLE FROM lineitem WHERE l_discount > 0.04""")
def nested_collections(spark, d):
    tree = Label(a=Index(Select("l_tax > 0.04"), Select("l_tax > 0.06")), b=Index(Select("l_discount > 0.04")))
    return tidy(lineitem(spark, d), tree).where("path like '%/data'").select("path", "entries")


# compositions -------------------------------------------------------------------------------


@query(dense_sql(50, f"SELECT bin, count(*)::DOUBLE AS n FROM ({_PRICE_SQL} WHERE l_returnflag = 'A') GROUP BY bin", "coalesce(n, 0.0)::DOUBLE AS entries"))
def histogram(spark, d):
    return shown(tidy(lineitem(spark, d), Histogram(*_PRICE, "l_extendedprice", "l_returnflag = 'A'")), "data/values", "entries", "bin bigint")


@query("SELECT floor((l_extendedprice - 0.0) / 2500.0)::BIGINT AS bin, count(*)::DOUBLE AS entries FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1")
def sparsely_histogram(spark, d):
    return shown(tidy(lineitem(spark, d), SparselyHistogram(2500, "l_extendedprice", "l_returnflag = 'A'")), "data/bins", "entries", "bin bigint")


@query(dense_sql(50, f"SELECT bin, count(*)::DOUBLE AS n, avg(l_quantity) AS m FROM ({_PRICE_SQL} WHERE l_discount > 0.05) GROUP BY bin", "coalesce(n, 0.0)::DOUBLE AS entries, coalesce(round(m, 6), 'NaN'::DOUBLE) AS mean"))
def profile(spark, d):
    return shown(tidy(lineitem(spark, d), Profile(*_PRICE, "l_extendedprice", "l_quantity", "l_discount > 0.05")), "data/values", "entries, mean", "bin bigint")


@query("SELECT floor((l_extendedprice - 0.0) / 2500.0)::BIGINT AS bin, count(*)::DOUBLE AS entries, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY 1")
def sparsely_profile(spark, d):
    return shown(tidy(lineitem(spark, d), SparselyProfile(2500, "l_extendedprice", "l_quantity")), "data/bins", "entries, mean", "bin bigint")


@query(dense_sql(50, f"SELECT bin, count(*)::DOUBLE AS n, avg(l_quantity) AS m, var_pop(l_quantity) AS v FROM ({_PRICE_SQL} WHERE l_discount > 0.05) GROUP BY bin", _DEVIATE_COLS))
def profile_err(spark, d):
    return shown(tidy(lineitem(spark, d), ProfileErr(*_PRICE, "l_extendedprice", "l_quantity", "l_discount > 0.05")), "data/values", "entries, mean, variance", "bin bigint")


@query("SELECT floor((l_extendedprice - 0.0) / 2500.0)::BIGINT AS bin, count(*)::DOUBLE AS entries, round(avg(l_quantity), 6) AS mean, round(var_pop(l_quantity), 4) AS variance FROM lineitem GROUP BY 1")
def sparsely_profile_err(spark, d):
    return shown(tidy(lineitem(spark, d), SparselyProfileErr(2500, "l_extendedprice", "l_quantity")), "data/bins", "entries, mean, variance", "bin bigint")


@query(f"""SELECT x.range::BIGINT AS x, y.range::BIGINT AS y, coalesce(n, 0.0)::DOUBLE AS entries FROM range(20) x CROSS JOIN range(10) y LEFT JOIN
(SELECT {bin_sql('l_extendedprice', 20, 0.0, 80000.0)} AS bx, {bin_sql('l_quantity', 10, 0.0, 45.0)} AS b, count(*)::DOUBLE AS n FROM lineitem WHERE l_tax < 0.05 GROUP BY 1, 2) a ON a.bx = x.range AND a.b = y.range""")
def hist2d(spark, d):
    return shown(tidy(lineitem(spark, d), TwoDimensionallyHistogram(20, 0, 80000, "l_extendedprice", 10, 0, 45, "l_quantity", "l_tax < 0.05")), "data/values/values", "entries", "x bigint, y bigint")


@query("SELECT floor((l_extendedprice - 0.0) / 10000.0)::BIGINT AS x, floor((l_quantity - 0.0) / 10.0)::BIGINT AS y, count(*)::DOUBLE AS entries FROM lineitem GROUP BY 1, 2")
def sparse_hist2d(spark, d):
    return shown(tidy(lineitem(spark, d), TwoDimensionallySparselyHistogram(10000, "l_extendedprice", 10, "l_quantity")), "data/bins/bins", "entries", "x bigint, y bigint")


# algebra ------------------------------------------------------------------------------------


def _tree():
    return Branch(_price(), Average("l_quantity"), Maximize("l_tax"))


def _flat(spark, r):
    rows = [("bin", i, v.entries) for i, v in enumerate(r.i0.values)] + [("mean", 0, r.i1.mean), ("entries", 0, r.i1.entries), ("max", 0, r.i2.max)]
    return spark.createDataFrame(rows, "what string, bin bigint, value double").withColumn("value", F.round("value", 6))


def _flat_sql(f: str) -> str:
    return f"""SELECT 'bin' AS what, r.range::BIGINT AS bin, round(coalesce(n, 0.0) * {f}, 6)::DOUBLE AS value FROM range(50) r LEFT JOIN (SELECT bin, count(*)::DOUBLE AS n FROM ({_PRICE_SQL}) GROUP BY bin) a ON a.bin = r.range
UNION ALL SELECT 'mean', 0, round(avg(l_quantity), 6) FROM lineitem UNION ALL SELECT 'entries', 0, count(*) * {f}::DOUBLE FROM lineitem UNION ALL SELECT 'max', 0, max(l_tax) FROM lineitem"""


@query(_flat_sql("1.0"))
def merge_two_halves(spark, d):
    df = lineitem(spark, d)
    return _flat(spark, aggregate(df.where("l_orderkey % 2 = 0"), _tree()) + aggregate(df.where("l_orderkey % 2 = 1"), _tree()))


@query(_flat_sql("0.5"))
def scale(spark, d):
    return _flat(spark, aggregate(lineitem(spark, d), _tree()) * 0.5)


@query("SELECT 'bin' AS what, range::BIGINT AS bin, 0.0::DOUBLE AS value FROM range(50) UNION ALL VALUES ('mean', 0, 'NaN'::DOUBLE), ('entries', 0, 0.0), ('max', 0, 'NaN'::DOUBLE)")
def zero(spark, d):
    return _flat(spark, aggregate(lineitem(spark, d), _tree()).zero())


# views, JSON, text, streams -----------------------------------------------------------------


@query(f"""SELECT r.range::BIGINT AS bin, coalesce(n, 0.0)::DOUBLE AS value, round(2 * sqrt(coalesce(n, 0.0)), 6) AS error FROM range(50) r
LEFT JOIN (SELECT bin, count(*)::DOUBLE AS n FROM ({_PRICE_SQL}) GROUP BY bin) a ON a.bin = r.range""")
def view_hist_ci(spark, d):
    from .operators.views import HistogramView

    v = HistogramView(aggregate(lineitem(spark, d), Histogram(*_PRICE, "l_extendedprice")))
    rows = [(i, n, e) for i, (n, e) in enumerate(zip(v.numerical_values, v.confidence_interval_values(2.0), strict=True))]
    return spark.createDataFrame(rows, "bin bigint, value double, error double").withColumn("error", F.round("error", 6))


@query(f"""SELECT r.range::BIGINT AS bin, coalesce(round(num / den, 6), 'NaN'::DOUBLE) AS value FROM range(50) r
LEFT JOIN (SELECT bin, count(*)::DOUBLE AS den, count(*) FILTER (l_returnflag = 'R')::DOUBLE AS num FROM ({_PRICE_SQL}) GROUP BY bin) a ON a.bin = r.range""")
def view_fraction_ratio(spark, d):
    from .operators.views import FractionedHistogramView

    v = FractionedHistogramView(aggregate(lineitem(spark, d), Fraction("l_returnflag = 'R'", Histogram(*_PRICE, "l_extendedprice"))))
    return spark.createDataFrame(list(enumerate(v.numerical_values)), "bin bigint, value double").withColumn("value", F.round("value", 6))


@query("""SELECT count(*) FILTER (l_extendedprice < 10000 OR l_extendedprice >= 90000 OR l_quantity < 5 OR l_quantity >= 45)::DOUBLE AS overflow, 0.0::DOUBLE AS nanflow FROM lineitem""")
def view_2d_overflow(spark, d):
    from .operators.views import TwoDimensionalView

    v = TwoDimensionalView(aggregate(lineitem(spark, d), TwoDimensionallyHistogram(20, 10000, 90000, "l_extendedprice", 10, 5, 45, "l_quantity")))
    return spark.createDataFrame([(v.numerical_overflow, v.numerical_nanflow)], "overflow double, nanflow double")


@query("SELECT 10000.0::DOUBLE AS low, 90000.0::DOUBLE AS high, 50::BIGINT AS num, 5::BIGINT AS layers")
def view_stack_compat(spark, d):
    from .operators.views import StackedHistogramView

    v = StackedHistogramView(aggregate(lineitem(spark, d), Stack(_STACK, "l_quantity", Histogram(*_PRICE, "l_extendedprice"))))
    return spark.createDataFrame([(v.low, v.high, v.num, len(v.layers))], "low double, high double, num bigint, layers bigint")


@query(dense_sql(50, f"SELECT bin, avg(l_quantity) AS m, count(*) AS n, var_pop(l_quantity) AS v FROM ({_PRICE_SQL}) GROUP BY bin",
"coalesce(round(m, 6), 'NaN'::DOUBLE) AS mean, coalesce(round(v, 4), 'NaN'::DOUBLE) AS variance, coalesce(round(sqrt(v / n), 6), 'NaN'::DOUBLE) AS error"))
def view_profile_err(spark, d):
    from .operators.views import ProfileErrView

    v = ProfileErrView(aggregate(lineitem(spark, d), ProfileErr(*_PRICE, "l_extendedprice", "l_quantity")))
    rows = list(zip(range(50), v.mean_values, v.variance_values, v.error_values, strict=True))
    return spark.createDataFrame(rows, "bin bigint, mean double, variance double, error double").select("bin", F.round("mean", 6).alias("mean"), F.round("variance", 4).alias("variance"), F.round("error", 6).alias("error"))


@query(dense_sql(50, f"SELECT bin, avg(l_quantity) AS m FROM ({_PRICE_SQL}) GROUP BY bin", "coalesce(round(m, 6), 'NaN'::DOUBLE) AS mean"))
def view_profile(spark, d):
    from .operators.views import ProfileView

    v = ProfileView(aggregate(lineitem(spark, d), Profile(*_PRICE, "l_extendedprice", "l_quantity")))
    return spark.createDataFrame(list(enumerate(v.mean_values)), "bin bigint, mean double").withColumn("mean", F.round("mean", 6))


_LAYERS = """SELECT layer::BIGINT AS layer, r.range::BIGINT AS bin, coalesce(n, 0.0)::DOUBLE AS value FROM range(50) r CROSS JOIN (VALUES (0, -1e300), (1, 10.0), (2, 20.0), (3, 40.0)) e(layer, edge)
LEFT JOIN (SELECT bin, layer AS l, count(*)::DOUBLE AS n FROM ({inner}) JOIN (VALUES (0, -1e300, 10.0), (1, 10.0, 20.0), (2, 20.0, 40.0), (3, 40.0, 1e300)) g(layer, low, high) ON l_quantity >= low AND {upper} GROUP BY 1, 2) a
ON a.bin = r.range AND a.l = e.layer"""


def _layers(spark, view):
    return spark.createDataFrame([(i, j, x) for i, v in enumerate(view.layers) for j, x in enumerate(v.numerical_values)], "layer bigint, bin bigint, value double")


@query(_LAYERS.format(inner=_PRICE_SQL, upper="true"))
def view_stack_layers(spark, d):
    from .operators.views import StackedHistogramView

    return _layers(spark, StackedHistogramView(aggregate(lineitem(spark, d), Stack([10, 20, 40], "l_quantity", Histogram(*_PRICE, "l_extendedprice")))))


@query(_LAYERS.format(inner=_PRICE_SQL, upper="l_quantity < high"))
def view_partitioned(spark, d):
    from .operators.views import PartitionedHistogramView

    return _layers(spark, PartitionedHistogramView(aggregate(lineitem(spark, d), IrregularlyBin([10, 20, 40], "l_quantity", Histogram(*_PRICE, "l_extendedprice")))))


@query(f"""SELECT r.range::BIGINT AS bin, coalesce(round(p - 2 * sqrt(p * (1 - p) / den), 6), 'NaN'::DOUBLE) AS wald_low, coalesce(round(p + 2 * sqrt(p * (1 - p) / den), 6), 'NaN'::DOUBLE) AS wald_high,
coalesce(round((p + 2 / den - 2 * sqrt(p * (1 - p) / den + 1 / (den * den))) / (1 + 4 / den), 6), 'NaN'::DOUBLE) AS wilson_low,
coalesce(round((p + 2 / den + 2 * sqrt(p * (1 - p) / den + 1 / (den * den))) / (1 + 4 / den), 6), 'NaN'::DOUBLE) AS wilson_high
FROM range(50) r LEFT JOIN (SELECT bin, count(*)::DOUBLE AS den, count(*) FILTER (l_returnflag = 'R') / count(*)::DOUBLE AS p FROM ({_PRICE_SQL}) GROUP BY bin) a ON a.bin = r.range""")
def view_fraction_intervals(spark, d):
    from .operators.views import FractionedHistogramView, wald_interval, wilson_interval

    v = FractionedHistogramView(aggregate(lineitem(spark, d), Fraction("l_returnflag = 'R'", Histogram(*_PRICE, "l_extendedprice"))))
    both = zip(v.confidence_interval_values(wald_interval, 2.0), v.confidence_interval_values(wilson_interval, 2.0), strict=True)
    names = ["wald_low", "wald_high", "wilson_low", "wilson_high"]
    rows = [(i, a[0], a[2], b[0], b[2]) for i, (a, b) in enumerate(both)]
    return spark.createDataFrame(rows, "bin bigint, " + ", ".join(f"{n} double" for n in names)).select("bin", *[F.round(n, 6).alias(n) for n in names])


@query(f"""SELECT x.range::BIGINT AS x, y.range::BIGINT AS y, coalesce(n, 0.0)::DOUBLE AS value FROM range(20) x CROSS JOIN range(10) y LEFT JOIN
(SELECT {bin_sql('l_extendedprice', 20, 10000.0, 90000.0)} AS bx, {bin_sql('l_quantity', 10, 5.0, 45.0)} AS b, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2) a ON a.bx = x.range AND a.b = y.range""")
def view_2d_values(spark, d):
    from .operators.views import TwoDimensionalView

    v = TwoDimensionalView(aggregate(lineitem(spark, d), TwoDimensionallyHistogram(20, 10000, 90000, "l_extendedprice", 10, 5, 45, "l_quantity")))
    return spark.createDataFrame([(i, j, n) for i, row in enumerate(v.numerical_values) for j, n in enumerate(row)], "x bigint, y bigint, value double")


@query(f"""SELECT r.range::BIGINT AS bin, r.range * 2500.0::DOUBLE AS low, (r.range + 1) * 2500.0::DOUBLE AS high, (r.range + 0.5) * 2500.0::DOUBLE AS center, coalesce(n, 0.0)::DOUBLE AS value, round(sqrt(coalesce(n, 0.0)), 6) AS error FROM range(40) r
LEFT JOIN (SELECT {bin_sql('l_extendedprice', 40, 0.0, 100000.0)} AS bin, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1) a ON a.bin = r.range""")
def view_plot_points(spark, d):
    from .operators.views import plot_points

    points = plot_points(aggregate(lineitem(spark, d), Histogram(40, 0, 100000, "l_extendedprice")))
    rows = [(i, *(p[c] for c in ("low", "high", "center", "value", "error"))) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "bin bigint, low double, high double, center double, value double, error double").withColumn("error", F.round("error", 6))


@query("""SELECT count(*)::DOUBLE AS entries, round(sum(l_tax) FILTER (l_returnflag = 'R'), 2) AS numerator, round(sum(l_tax), 2) AS denominator, round(count(*) FILTER (l_returnflag = 'R') / count(*)::DOUBLE, 6) AS passing FROM lineitem""")
def fraction_build(spark, d):
    from .operators.results import Fractioned

    df = lineitem(spark, d)
    r = Fractioned.build(aggregate(df.where("l_returnflag = 'R'"), Sum("l_tax")), aggregate(df, Sum("l_tax")))
    return spark.createDataFrame([(r.entries, round(r.numerator.sum, 2), round(r.denominator.sum, 2), round(r.fraction_passing, 6))], "entries double, numerator double, denominator double, passing double")


@query("""SELECT 'a/0' AS path, round(sum(l_tax), 2) AS sum FROM lineitem UNION ALL SELECT 'a/1', round(sum(l_discount), 2) FROM lineitem UNION ALL SELECT 'b/i0', count(*)::DOUBLE FROM lineitem UNION ALL SELECT 'b/i1', round(sum(l_quantity), 2) FROM lineitem""")
def multi_index(spark, d):
    """Every leaf of nested collections by its index, and the leaf that the index leads to."""
    r = aggregate(lineitem(spark, d), UntypedLabel(a=Index(Sum("l_tax"), Sum("l_discount")), b=Branch(Count(), Sum("l_quantity"))))
    rows = list(r.walk(lambda path, leaf: ("/".join(map(str, path)), round(getattr(r.at(*path), "sum", leaf.entries), 2))))
    return spark.createDataFrame(rows, "path string, sum double")


@query("SELECT 'price' AS name, 'Bin' AS kind, 50::BIGINT AS bins, count(*)::DOUBLE AS entries FROM lineitem UNION ALL SELECT 'taxes', 'Sum', NULL, count(*)::DOUBLE FROM lineitem")
def named_quantities(spark, d):
    """Names go from the tree to the result and through its JSON."""
    from . import named
    from .sources import loads, to_string

    r = loads(to_string(aggregate(lineitem(spark, d), Branch(Bin(*_PRICE, named("l_extendedprice", "price")), Sum(named("l_tax", "taxes"))))))
    return spark.createDataFrame([(x.name, x.kind, getattr(x, "num", None), x.entries) for x in r.values], "name string, kind string, bins bigint, entries double")


@query("""WITH c AS (SELECT count(*) AS n, count(*) FILTER (l_extendedprice < 25000) AS a, count(*) FILTER (l_extendedprice >= 25000 AND l_extendedprice < 50000) AS b,
count(*) FILTER (l_extendedprice >= 50000 AND l_extendedprice < 75000) AS c, count(*) FILTER (l_extendedprice >= 75000 AND l_extendedprice < 100000) AS d, count(*) FILTER (l_extendedprice >= 100000) AS o FROM lineitem)
SELECT '{"version": "1.0", "type": "Bin", "data": {"entries": ' || n || ', "low": 0, "high": 100000, "values:type": "Count", "values": [' || a || ', ' || b || ', ' || c || ', ' || d || '], "underflow:type": "Count", "underflow": 0, "overflow:type": "Count", "overflow": ' || o || ', "nanflow:type": "Count", "nanflow": 0, "name": "price"}}' AS json FROM c""")
def json_bin(spark, d):
    """The whole JSON of a histogram, as text."""
    from . import named
    from .sources import to_string

    return spark.createDataFrame([(to_string(aggregate(lineitem(spark, d), Bin(4, 0, 100000, named("l_extendedprice", "price")))),)], "json string")


@query("""WITH k AS (SELECT l_returnflag AS f, count(*) AS n, count(*) FILTER (l_linestatus = 'F') AS m FROM lineitem GROUP BY 1)
SELECT '{"version": "1.0", "type": "Categorize", "data": {"entries": ' || sum(n) || ', "bins:type": "Fraction", "bins": {' || string_agg('"' || f || '": {"entries": ' || n || ', "sub:type": "Count", "numerator": ' || m || ', "denominator": ' || n || '}', ', ' ORDER BY f) || '}}}' AS json FROM k""")
def json_categorize(spark, d):
    """The whole JSON of fractions by category, as text."""
    from .sources import to_string

    return spark.createDataFrame([(to_string(aggregate(lineitem(spark, d), Categorize("l_returnflag", Fraction("l_linestatus = 'F'", Count())))),)], "json string")


@query("SELECT count(*)::DOUBLE AS entries, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum FROM lineitem")
def python_quantity(spark, d):
    """A Python function of two columns as the quantity, over Arrow batches."""
    from . import vectorized

    rows = tidy(lineitem(spark, d), Sum(vectorized(lambda price, off: price * (1 - off), "l_extendedprice", "l_discount")))
    return rows.select("entries", F.round("sum", 2).alias("sum"))


@query()
def json_roundtrip(spark, d):
    """The tree of several queries as JSON, read and written again."""
    from .sources import loads, to_string

    tree = UntypedLabel(h=Histogram(*_PRICE, "l_extendedprice"), c=Categorize("l_returnflag", Deviate("l_quantity")), s=Stack(_STACK, "l_quantity", Bag("l_tax")))
    text = to_string(aggregate(lineitem(spark, d), tree))
    again = to_string(loads(text))
    return spark.createDataFrame([(again, again == text)], "json string, same boolean")


@query()
def ascii_hist(spark, d):
    from .operators.ascii import histogram as draw

    return spark.createDataFrame([(draw(aggregate(lineitem(spark, d), Histogram(20, 0, 100000, "l_extendedprice"))),)], "text string")


@query()
def ascii_profile(spark, d):
    from .operators.ascii import profile_err as draw

    return spark.createDataFrame([(draw(aggregate(lineitem(spark, d), ProfileErr(20, 0, 100000, "l_extendedprice", "l_quantity"))),)], "text string")


def _stream(spark, d, tree, starts: int = 1):
    """The result of a stream over the table's files that is started, stopped and started again."""
    import tempfile
    import uuid

    from .streaming import fill_stream

    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    checkpoint = f"{shared or 'file://' + tempfile.mkdtemp(prefix='grovetally-')}/stream-{uuid.uuid4().hex}"
    for _ in range(starts):
        source = spark.readStream.schema(lineitem(spark, d).schema).parquet(f"{d}/lineitem.parquet*")
        q, running = fill_stream(source, tree, checkpoint)
        q.processAllAvailable()
        q.stop()
    return running.result


@query(dense_sql(50, f"SELECT bin, count(*)::DOUBLE AS n FROM ({_PRICE_SQL}) GROUP BY bin", "coalesce(n, 0.0)::DOUBLE AS entries"))
def stream_histogram(spark, d):
    """The histogram of a stream of files, added up batch by batch."""
    return spark.createDataFrame([(i, v.entries) for i, v in enumerate(_stream(spark, d, _price()).values)], "bin bigint, entries double")


@query("SELECT l_returnflag AS flag, count(*)::DOUBLE AS entries, round(avg(l_quantity), 6) AS mean, round(var_pop(l_quantity), 4) AS variance FROM lineitem GROUP BY 1")
def stream_restart(spark, d):
    """A stream that was stopped goes on with the result it had."""
    r = _stream(spark, d, Categorize("l_returnflag", Deviate("l_quantity")), starts=2)
    rows = [(k, v.entries, round(v.mean, 6), round(v.variance, 4)) for k, v in r.bins.items()]
    return spark.createDataFrame(rows, "flag string, entries double, mean double, variance double")


# distributed results ---------------------------------------------------------------------------

_GOODS = UntypedLabel(stack=Stack([10, 20, 40], "l_quantity", Deviate("l_extendedprice")), orders=Categorize("l_orderkey", Deviate("l_extendedprice")))
_GOODS_SQL = """SELECT 'stack/bins' AS path, i::VARCHAR AS key, count(*)::DOUBLE AS entries, round(avg(l_extendedprice), 6) AS mean, round(var_pop(l_extendedprice) / 1e6, 4) AS variance
FROM lineitem JOIN (VALUES (0, '-Infinity'::DOUBLE), (1, 10), (2, 20), (3, 40)) t(i, low) ON l_quantity >= low GROUP BY i
UNION ALL SELECT 'orders/bins', l_orderkey::VARCHAR, count(*)::DOUBLE, round(avg(l_extendedprice), 6), round(var_pop(l_extendedprice) / 1e6, 4) FROM lineitem GROUP BY l_orderkey"""


def _goods(rows: DataFrame) -> DataFrame:
    """Means and variances (in millions) below the two binnings of ``_GOODS``."""
    rows = rows.where("path IN ('stack/bins', 'orders/bins')")
    return rows.select("path", F.get("keys", F.lit(0)).alias("key"), "entries", F.round("mean", 6).alias("mean"), F.round(F.col("variance") / 1e6, 4).alias("variance"))


@query(_GOODS_SQL)
def tally_merge(spark, d):
    """Eight parts of the table are filled apart and saved as days would be, read again and added."""
    from .plans import tally
    from .plans.tally import load
    from .sources.shared import shared_path

    path = shared_path(spark, "tally")
    for i in range(8):
        tally(lineitem(spark, d).where(f"pmod(l_suppkey, 8) = {i}"), _GOODS).append(path)
    return _goods(load(spark, path).tidy())


@query("""SELECT 'a' AS path, round(2 * sum(l_tax) FILTER (l_returnflag = 'A') + sum(l_tax) FILTER (l_returnflag = 'R'), 2) AS sum, 2.0::DOUBLE * count(*) FILTER (l_returnflag = 'A') + count(*) FILTER (l_returnflag = 'R') AS entries FROM lineitem
UNION ALL SELECT 'b', NULL, 2.0::DOUBLE * count(*) FILTER (l_returnflag = 'A' AND l_quantity < 10) + count(*) FILTER (l_returnflag = 'R' AND l_quantity < 10) FROM lineitem""")
def tally_algebra(spark, d):
    """2 * a + b + 0 * c over rows, whatever the size of the trees."""
    from .plans import tally

    tree = UntypedLabel(a=Sum("l_tax"), b=Select("l_quantity < 10", Count()))
    a, b, c = (tally(lineitem(spark, d).where(f"l_returnflag = '{flag}'"), tree) for flag in "ARN")
    rows = (2 * a + b + 0 * c).tidy().where("path IN ('a', 'b/data')")
    return rows.select(F.substring("path", 1, 1).alias("path"), F.round("sum", 2).alias("sum"), "entries")


_MANY_CENTERS = tuple(20.0 * i + i % 7 for i in range(4000))


@query("""WITH c AS (SELECT range AS i, 20.0::DOUBLE * range + range % 7 AS c FROM range(4000)), m AS (SELECT i, (lag(c) OVER (ORDER BY i) + c) / 2 AS low FROM c),
s AS (SELECT i, coalesce(low, '-Infinity'::DOUBLE) AS low FROM m) SELECT s.i::BIGINT AS bin, count(*)::DOUBLE AS entries, round(avg(l_quantity), 6) AS mean FROM lineitem l ASOF JOIN s ON l.l_extendedprice >= s.low GROUP BY s.i""")
def centrally_bin_4000(spark, d):
    """Nearest of 4,000 centres."""
    rows = tidy(lineitem(spark, d), CentrallyBin(_MANY_CENTERS, "l_extendedprice", Average("l_quantity")), dense=False)
    return shown(rows, "bins", "entries, mean", "bin bigint")


@query("""WITH e AS (SELECT range AS i, power(1.003, range) * 900 AS low FROM range(1600)), s AS (SELECT i + 1 AS i, low FROM e UNION ALL SELECT 0, '-Infinity'::DOUBLE)
SELECT s.i::BIGINT AS bin, count(*)::DOUBLE AS entries FROM lineitem l ASOF JOIN s ON l.l_extendedprice >= s.low GROUP BY s.i""")
def irregularly_bin_1600(spark, d):
    """Bins between 1,600 edges that stand ever wider apart."""
    return shown(tidy(lineitem(spark, d), IrregularlyBin([1.003**i * 900 for i in range(1600)], "l_extendedprice"), dense=False), "bins", "entries", "bin bigint")


@query(f"""WITH f AS (SELECT least(greatest(floor(l_extendedprice / 100), -1), 999)::BIGINT + 1 AS slot, {bin_sql('l_quantity', 50, 0.5, 50.5)} AS bin, count(*) AS n, sum(l_tax) AS tax FROM lineitem GROUP BY 1, 2),
g AS (SELECT s.range AS slot, b.range AS bin FROM range(1001) s CROSS JOIN range(50) b),
r AS (SELECT g.slot, g.bin, sum(coalesce(n, 0)) OVER w AS n, sum(coalesce(tax, 0)) OVER w AS tax FROM g LEFT JOIN f USING (slot, bin) WINDOW w AS (PARTITION BY g.bin ORDER BY g.slot DESC ROWS UNBOUNDED PRECEDING))
SELECT slot::BIGINT AS threshold, bin::BIGINT AS bin, n::DOUBLE AS entries, round(tax, 2) AS sum FROM r WHERE n > 0""")
def stack_bin_1000(spark, d):
    """1,000 thresholds over 50 bins."""
    rows = tidy(lineitem(spark, d), Stack([100.0 * i for i in range(1000)], "l_extendedprice", Bin(50, 0.5, 50.5, "l_quantity", Sum("l_tax"))), dense=False)
    return shown(rows, "bins/values", "entries, sum", "threshold bigint, bin bigint")


_LOGGED_SQL = """SELECT e::BIGINT AS entry, path, key, entries, mean FROM (SELECT (l_suppkey % 3)::BIGINT AS e, 'bins' AS path, l_shipdate::DATE::VARCHAR AS key, count(*)::DOUBLE AS entries, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY ALL
UNION ALL SELECT (l_suppkey % 3)::BIGINT, '', NULL, count(*)::DOUBLE, NULL FROM lineitem GROUP BY ALL)"""


def _logged(spark, d) -> str:
    """A log of three results."""
    from .plans import tally
    from .sources.shared import shared_path

    path = shared_path(spark, "log")
    for i in range(3):
        tally(lineitem(spark, d).where(f"l_suppkey % 3 = {i}"), Categorize("date(l_shipdate)", Average("l_quantity"))).log(path)
    return path


def _of_log(rows: DataFrame) -> DataFrame:
    return rows.select("entry", "path", F.get("keys", F.lit(0)).alias("key"), "entries", F.round("mean", 6).alias("mean"))


@query(_LOGGED_SQL)
def log_source(spark, d):
    """Three results appended to a log and read as a data source."""
    return _of_log(spark.read.format("tally_log").load(_logged(spark, d)))


@query(_LOGGED_SQL)
def log_source_stream(spark, d):
    """The same log read as a stream, by a watcher that writes what it sees."""
    from .sources.shared import shared_path

    seen, checkpoint = shared_path(spark, "seen"), shared_path(spark, "watcher")
    rows = spark.readStream.format("tally_log").load(_logged(spark, d))
    q = rows.writeStream.format("parquet").option("path", seen).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return _of_log(spark.read.parquet(seen))


@query(_GOODS_SQL)
def stream_state(spark, d):
    """A stream with its state on the executors, stopped and started again with new files in between."""
    from .sources.shared import shared_path
    from .streaming import Store, fill_store

    files, store, checkpoint = (shared_path(spark, n) for n in ("files", "store", "state"))
    rows = lineitem(spark, d)
    for i in range(2):
        rows.where(f"l_suppkey % 2 = {i}").write.mode("append").parquet(files)
        q = fill_store(spark.readStream.schema(rows.schema).parquet(files), _GOODS, store, checkpoint)
        q.processAllAvailable()
        q.stop()
    return _goods(Store(spark, store).tally().tidy())


@query("""SELECT l_orderkey::VARCHAR AS key, count(*)::DOUBLE AS entries, round(avg(l_extendedprice), 6) AS mean, round(max(l_tax), 2) AS top FROM lineitem GROUP BY l_orderkey""")
def json_large(spark, d):
    """The JSON of a result with a category for each order, written and read again without a tree on the driver."""
    from .plans import tally
    from .sources.json_rows import read_json, write_json
    from .sources.shared import shared_path

    path = shared_path(spark, "json")
    write_json(tally(lineitem(spark, d), Categorize("l_orderkey", Branch(Average("l_extendedprice"), Maximize("l_tax")))), path)
    rows = read_json(spark, path).tidy().where("path IN ('bins/i0', 'bins/i1')").groupBy(F.get("keys", F.lit(0)).alias("key"))
    return rows.agg(F.max(F.expr("if(path = 'bins/i0', entries, NULL)")).alias("entries"), F.round(F.max("mean"), 6).alias("mean"), F.round(F.max("max"), 2).alias("top"))


@query("""SELECT '{"version": "1.0", "type": "Stack", "data": {"entries": ' || count(*) || ', "bins:type": "Bag", "bins": [' || (SELECT string_agg('{"atleast": ' || low || ', "data": {"entries": ' || n || ', "values": [' || v || '], "range": "N"}}', ', ' ORDER BY i) FROM
(SELECT i, low, sum(n) AS n, string_agg('{"w": ' || n || ', "v": ' || l_linenumber || '}', ', ' ORDER BY l_linenumber) AS v FROM (SELECT i, low, l_linenumber, count(*) AS n FROM lineitem JOIN (VALUES (0, '"-inf"', -1), (1, '10', 10), (2, '40', 40)) t(i, low, x) ON l_quantity >= x GROUP BY ALL) GROUP BY i, low)) || '], "nanflow:type": "Count", "nanflow": 0}}' AS json FROM lineitem""")
def json_stack(spark, d):
    """The whole JSON of a Stack of Bags, as text, put together from pieces."""
    from .plans import tally
    from .sources.json_rows import encode

    pieces = encode(tally(lineitem(spark, d), Stack([10, 40], "l_quantity", Bag("l_linenumber"))))
    whole = F.sort_array(F.collect_list(F.struct("place", "numbers", "text")))
    return pieces.agg(F.array_join(F.transform(whole, lambda p: p["text"]), "").alias("json"))


_FAR = "CASE WHEN l_orderkey = 1 AND l_linenumber = 1 THEN 1e12D WHEN l_orderkey = 1 THEN -3e11D ELSE l_extendedprice / 10 END"


@query("""WITH f AS (SELECT l_linenumber::VARCHAR AS above, floor(CASE WHEN l_orderkey = 1 AND l_linenumber = 1 THEN 1e12 WHEN l_orderkey = 1 THEN -3e11 ELSE l_extendedprice / 10 END)::BIGINT AS bin, count(*)::DOUBLE AS value FROM lineitem GROUP BY 1, 2),
n AS (SELECT *, lead(bin) OVER (PARTITION BY above ORDER BY bin) AS after FROM f)
SELECT above, bin, bin AS last, bin::DOUBLE AS low, bin + 1.0::DOUBLE AS high, value FROM n UNION ALL SELECT above, bin + 1, after - 1, bin + 1.0::DOUBLE, after::DOUBLE, 0.0::DOUBLE FROM n WHERE after > bin + 1""")
def view_runs(spark, d):
    """Sparse histograms for each line number, with outliers: empty bins are runs."""
    from .plans import tally
    from .plans.view_rows import bins

    rows = bins(tally(lineitem(spark, d), Categorize("l_linenumber", SparselyBin(1.0, _FAR))), "bins")
    return rows.select(F.get("above", F.lit(0)).alias("above"), "bin", "last", "low", "high", "value")


@query(_LAYERS.format(inner=_PRICE_SQL, upper="true"))
def view_rows_layers(spark, d):
    """The layers of a Stack of histograms, as rows."""
    from .plans import tally
    from .plans.view_rows import bins

    rows = bins(tally(lineitem(spark, d), Stack([10, 20, 40], "l_quantity", Histogram(*_PRICE, "l_extendedprice"))), "bins", "all")
    return rows.select(F.get("above", F.lit(0)).cast("bigint").alias("layer"), "bin", "value")


@query(SQL["view_fraction_intervals"])
def view_rows_fractions(spark, d):
    """Efficiencies and their intervals, as rows."""
    from .plans import tally
    from .plans.view_rows import fractions

    t = tally(lineitem(spark, d), Fraction("l_returnflag = 'R'", Histogram(*_PRICE, "l_extendedprice")))
    wald, wilson = (fractions(t, interval=i, z=2.0).select("bin", F.round("lower", 6).alias(f"{i}_low"), F.round("upper", 6).alias(f"{i}_high")) for i in ("wald", "wilson"))
    return wald.join(wilson, "bin")


@query(SQL["view_profile_err"])
def view_rows_profile(spark, d):
    """A profile and its errors, as rows; variances from the errors."""
    from .plans import tally
    from .plans.view_rows import bins

    rows = bins(tally(lineitem(spark, d), ProfileErr(*_PRICE, "l_extendedprice", "l_quantity")), empty="all")
    return rows.select("bin", F.round("value", 6).alias("mean"), F.round(F.coalesce(F.col("error") * F.col("error") * F.col("entries"), F.lit(float("nan"))), 4).alias("variance"), F.round("error", 6).alias("error"))


@query("""SELECT CASE WHEN l_quantity < 10 THEN 'few' WHEN l_discount > 0.05 THEN 'cheap' ELSE 'plain' END AS kind, count(*)::DOUBLE AS entries, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum FROM lineitem GROUP BY 1""")
def python_functions(spark, d):
    """Python functions of single values as a category and as a quantity; their parameters are columns."""

    def kind(l_quantity, l_discount):
        if l_quantity < 10:
            return "few"
        return "cheap" if l_discount > 0.05 else "plain"

    return shown(tidy(lineitem(spark, d), Categorize(kind, Sum(lambda l_extendedprice, l_discount: l_extendedprice * (1 - l_discount)))), "bins", "entries, sum", "kind string")


@query(f"""SELECT 'mean' AS name, NULL AS bin, round(avg(l_extendedprice * (1 - l_discount)), 6) AS value FROM lineitem UNION ALL SELECT 'bins', {bin_sql('l_extendedprice * (1 - l_discount)', 20, 0.0, 100000.0)}, count(*)::DOUBLE FROM lineitem
WHERE l_extendedprice * (1 - l_discount) < 100000 GROUP BY 2""")
def shared_quantity(spark, d):
    """One quantity in two containers is one column of the plan, computed once a row."""
    price = "l_extendedprice * (1 - l_discount)"
    rows = tidy(lineitem(spark, d), UntypedLabel(mean=Average(price), bins=Bin(20, 0, 100000, price)), dense=False)
    means = rows.where("path = 'mean'").selectExpr("'mean' AS name", "CAST(NULL AS bigint) AS bin", "round(mean, 6) AS value")
    return means.union(rows.where("path = 'bins/values' AND entries > 0").selectExpr("'bins' AS name", "bigint(get(keys, 0)) AS bin", "entries AS value"))


_TYPES = UntypedLabel(
    count=Count(), sum=Sum("l_linenumber"), average=Average(2), deviate=Deviate(3), least=Minimize("l_linenumber"), most=Maximize("l_linenumber"), bag=Bag("l_returnflag", "S"),
    sparse=SparselyBin(2, "l_linenumber"), near=CentrallyBin([1, 4, 7], "l_linenumber"), edges=IrregularlyBin([2, 5], "l_linenumber"), cut=Select("l_returnflag = 'R'", Count()),
    label=Label(a=Count(), b=Count()), index=Index(Count(), Count()), branch=Branch(Count(), Sum("l_linenumber")),
)
_NAN = '"nanflow:type": "Count", "nanflow": 0'
_TYPES_SQL = f"""WITH c AS (SELECT count(*) AS n, sum(l_linenumber)::BIGINT AS s, min(l_linenumber) AS lo, max(l_linenumber) AS hi, count(*) FILTER (l_returnflag = 'R') AS r,
count(*) FILTER (l_linenumber < 2.5) AS c0, count(*) FILTER (l_linenumber >= 2.5 AND l_linenumber < 5.5) AS c1, count(*) FILTER (l_linenumber >= 5.5) AS c2,
count(*) FILTER (l_linenumber < 2) AS e0, count(*) FILTER (l_linenumber >= 2 AND l_linenumber < 5) AS e1, count(*) FILTER (l_linenumber >= 5) AS e2 FROM lineitem),
b AS (SELECT string_agg('{{"w": ' || n || ', "v": "' || f || '"}}', ', ' ORDER BY f) AS b FROM (SELECT l_returnflag AS f, count(*) AS n FROM lineitem GROUP BY 1)),
p AS (SELECT string_agg('"' || k || '": ' || n, ', ' ORDER BY k) AS p FROM (SELECT l_linenumber // 2 AS k, count(*) AS n FROM lineitem GROUP BY 1))
SELECT '{{"version": "1.0", "type": "UntypedLabel", "data": {{"entries": ' || n || ', "data": {{"count": {{"type": "Count", "data": ' || n || '}}, "sum": {{"type": "Sum", "data": {{"entries": ' || n || ', "sum": ' || s || '}}}}, '
|| '"average": {{"type": "Average", "data": {{"entries": ' || n || ', "mean": 2}}}}, "deviate": {{"type": "Deviate", "data": {{"entries": ' || n || ', "mean": 3, "variance": 0}}}}, '
|| '"least": {{"type": "Minimize", "data": {{"entries": ' || n || ', "min": ' || lo || '}}}}, "most": {{"type": "Maximize", "data": {{"entries": ' || n || ', "max": ' || hi || '}}}}, '
|| '"bag": {{"type": "Bag", "data": {{"entries": ' || n || ', "values": [' || b || '], "range": "S"}}}}, "sparse": {{"type": "SparselyBin", "data": {{"entries": ' || n || ', "binWidth": 2, "bins:type": "Count", "bins": {{' || p || '}}, {_NAN}, "origin": 0}}}}, '
|| '"near": {{"type": "CentrallyBin", "data": {{"entries": ' || n || ', "bins:type": "Count", "bins": [{{"center": 1, "data": ' || c0 || '}}, {{"center": 4, "data": ' || c1 || '}}, {{"center": 7, "data": ' || c2 || '}}], {_NAN}}}}}, '
|| '"edges": {{"type": "IrregularlyBin", "data": {{"entries": ' || n || ', "bins:type": "Count", "bins": [{{"atleast": "-inf", "data": ' || e0 || '}}, {{"atleast": 2, "data": ' || e1 || '}}, {{"atleast": 5, "data": ' || e2 || '}}], {_NAN}}}}}, '
|| '"cut": {{"type": "Select", "data": {{"entries": ' || n || ', "sub:type": "Count", "data": ' || r || '}}}}, "label": {{"type": "Label", "data": {{"entries": ' || n || ', "sub:type": "Count", "data": {{"a": ' || n || ', "b": ' || n || '}}}}}}, '
|| '"index": {{"type": "Index", "data": {{"entries": ' || n || ', "sub:type": "Count", "data": [' || n || ', ' || n || ']}}}}, '
|| '"branch": {{"type": "Branch", "data": {{"entries": ' || n || ', "data": [{{"type": "Count", "data": ' || n || '}}, {{"type": "Sum", "data": {{"entries": ' || n || ', "sum": ' || s || '}}}}]}}}}}}}}}}' AS json FROM c, b, p"""


@query(_TYPES_SQL)
def json_types(spark, d):
    """The whole JSON of a tree with the types that json_bin, json_categorize and json_stack leave out, as text."""
    from .plans import tally
    from .sources.json_rows import encode

    pieces = encode(tally(lineitem(spark, d), _TYPES))
    whole = F.sort_array(F.collect_list(F.struct("place", "numbers", "text")))
    return pieces.agg(F.array_join(F.transform(whole, lambda p: p["text"]), "").alias("json"))


_WIDE = 24


@query(f"""SELECT 'i' || n || '/values' AS path, floor(l_extendedprice * (10 + n) / 110000)::BIGINT AS bin, count(*)::DOUBLE AS entries, round(avg(l_quantity), 6) AS mean
FROM lineitem CROSS JOIN generate_series(0, {_WIDE - 1}) g(n) GROUP BY 1, 2""")
def wide_branch(spark, d):
    """Histograms of one quantity by 24 bin widths, each with means of another, in one pass over the table."""
    rows = tidy(lineitem(spark, d), Branch(*[Bin(10 + i, 0, 110000, "l_extendedprice", Average("l_quantity")) for i in range(_WIDE)]), dense=False)
    return rows.where("path LIKE '%/values' AND entries > 0").selectExpr("path", "bigint(get(keys, 0)) AS bin", "entries", "round(mean, 6) AS mean")


@query(f"""WITH m AS (SELECT l_orderkey, l_quantity AS px, l_linenumber::DOUBLE AS py, l_discount AS pz, l_extendedprice / 100.0 AS e,
row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_linenumber, l_discount, l_extendedprice, l_tax) AS k FROM lineitem),
t AS (SELECT a.px + b.px AS px, a.py + b.py AS py, a.pz + b.pz AS pz, a.e + b.e AS e FROM m a JOIN m b ON a.l_orderkey = b.l_orderkey AND a.k = 1 AND b.k = 2),
s AS (SELECT sqrt(px * px + py * py) AS pt, e * e - px * px - py * py - pz * pz AS s FROM t)
SELECT bin, count(*)::DOUBLE AS entries, round(avg(pt), 6) AS mean FROM (SELECT pt, {bin_sql("m", 50, 0.0, 2500.0)} AS bin FROM (SELECT pt, CASE WHEN s >= 0 THEN sqrt(s) ELSE 'NaN'::DOUBLE END AS m FROM s))
GROUP BY bin HAVING bin >= 0""")
def events_from_json(spark, d):
    """Orders as events with their lines as muons, written as gzipped JSON lines and read back: the masses of pairs, with mean momenta across."""
    from .functions.vectors import lorentz_sum, mass, pt
    from .sources.events import read_events
    from .sources.shared import shared_path

    path = shared_path(spark, "collisions")
    line = "named_struct('px', l_quantity, 'py', double(l_linenumber), 'pz', l_discount, 'E', l_extendedprice / 100D, 'q', l_linenumber, 'iso', l_tax)"
    orders = lineitem(spark, d).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.expr(line))).alias("muons"))
    orders.select("muons", F.size("muons").alias("numPrimaryVertices")).write.option("compression", "gzip").json(path)
    events = read_events(spark, path)
    both = lorentz_sum(F.get("muons", F.lit(0)), F.get("muons", F.lit(1)))
    rows = tidy(events, Select(F.size("muons") >= 2, Bin(50, 0, 2500, mass(both), Average(pt(both)))), dense=False)
    return shown(rows.where("entries > 0"), "data/values", "entries, mean", "bin bigint")
