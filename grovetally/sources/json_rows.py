"""The JSON form of results that no machine has to hold: written and read on the executors.

Writing: each node of the result is a few pieces of text with a place in the document. Pieces are sorted by place over ranges and written a line each; the
files, in the order of their names, are one JSON document, as :func:`grovetally.sources.to_string` gives it but for white space and the
spelling of numbers. No step gathers the children of a node.

A line is indented by the number of its piece, in blanks (0) and tabs (1), which JSON does not mind.

Reading: what :func:`write_json` has written is read by lines, in ranges of any size. The indent says which node a line is of, the bins around it are the last ones
that began before it, and a table with a row for each file says which had begun before the file. Other documents are VARIANTs, and each path
of the tree is a walk through them that explodes bins as it meets them, to tidy rows (:func:`decode`); such a document must fit in one value (128 MiB).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import shape as H
from ..plans.tally import Tally, from_tidy
from .jsonio import VERSION, _out
from .shared import Folder, shared_path

_MEASURES = {"Sum": ("sum",), "Average": ("mean",), "Deviate": ("mean", "variance"), "Minimize": ("min",), "Maximize": ("max",)}
_EDGE = {"CentrallyBin": "center", "IrregularlyBin": "atleast", "Stack": "atleast"}
#: The kind of a Bag's values, which are nodes of their own here.
_ITEM = {"kind": "Item"}
#: Lines of a file, and what says that they are indented.
_LINES, _INDENTED = 1_000_000, "_lines.json"


def _text(x) -> str:
    return json.dumps(x)


def _number(x: float) -> str:
    return _text(_out(float(x)))


@dataclass
class _Node:
    """How a node is written. In ``place`` and ``pieces``, what begins with # is filled in for each row."""

    path: str
    kind: str
    place: list[str]
    pieces: list[list[str]]
    edges: list[float]
    #: The node below the nearest bins that data decide (or the root) that this one hangs from, and the numbers of bins between.
    anchor: str
    sizes: tuple[int, ...]
    #: Bins that data decide begin with this node.
    sparse: bool
    #: The number of keys that its rows have.
    depth: int


def _pieces(d: dict, hide: bool) -> tuple[list[list[str]], list[tuple[str, dict, bool]]]:
    """The text of a node around its children, and these: (step, structure, whether their name is left out). The keys are fixed by the format."""
    kind, below = d["kind"], dict(d.get("children", []))
    name = [f', "name": {_text(d["name"])}'] if "name" in d and not hide else []
    named = lambda key, c: [f', "{key}": {_text(c["name"])}'] if "name" in c else []
    begin = ['{"entries": ', "#entries"]
    if "parts" in d:
        raise TypeError(f"{kind} has no JSON form that rows can be written in")
    if kind in ("Count", "Item"):
        return [["#entries" if kind == "Count" else "#item"]], []
    if kind in _MEASURES:
        return [[*begin, *[x for m in _MEASURES[kind] for x in (f', "{m}": ', f"#{m}")], *name, "}"]], []
    if kind == "Bag":
        return [[*begin, ', "values": ['], [f'], "range": {_text(d["range"])}', *name, "}"]], [("values", _ITEM, True)]
    flow = lambda step: f', "{step}:type": {_text(below[step]["kind"])}, "{step}": '
    if kind == "Bin":
        steps = ("underflow", "overflow", "nanflow")
        first = [*begin, f', "low": {_number(d["low"])}, "high": {_number(d["high"])}, "values:type": {_text(below["values"]["kind"])}, "values": [']
        middle = [[("]" if i == 0 else "") + flow(s)] for i, s in enumerate(steps)]
        return [first, *middle, [*named("values:name", below["values"]), *name, "}"]], [("values", below["values"], True), *[(s, below[s], False) for s in steps]]
    if kind in ("SparselyBin", "Categorize", *_EDGE):
        opening, closing = ("[", "]") if kind in _EDGE else ("{", "}")
        width = f', "binWidth": {_number(d["bin_width"])}' if kind == "SparselyBin" else ""
        first = [*begin, f'{width}, "bins:type": {_text(below["bins"]["kind"])}, "bins": {opening}']
        origin = [f', "origin": {_number(d["origin"])}'] if kind == "SparselyBin" else []
        last = [*origin, *named("bins:name", below["bins"]), *name, "}"]
        if kind == "Categorize":
            return [first, [closing, *last]], [("bins", below["bins"], True)]
        return [first, [closing + flow("nanflow")], last], [("bins", below["bins"], True), ("nanflow", below["nanflow"], False)]
    if kind == "Fraction":
        c = below["value"]
        return [[*begin, f', "sub:type": {_text(c["kind"])}, "numerator": '], [', "denominator": '], [*named("sub:name", c), *name, "}"]], [("numerator", c, True), ("denominator", c, True)]
    if kind == "Select":
        return [[*begin, f', "sub:type": {_text(below["data"]["kind"])}, "data": '], [*name, "}"]], [("data", below["data"], False)]
    # collections
    each, out, before = list(below.items()), [], ""
    typed, labels = kind in ("Label", "Index"), kind in ("Label", "UntypedLabel")
    for i, (step, c) in enumerate(each):
        label = f"{_text(step)}: " if labels else ""
        text = before + (", " if i else "") + label + ("" if typed else f'{{"type": {_text(c["kind"])}, "data": ')
        out.append([text] if i else [*begin, f', "sub:type": {_text(c["kind"])}' if typed else "", f', "data": {"{" if labels else "["}', text])
        before = "" if typed else "}"
    return [*out, [f'{before}{"}" if labels else "]"}}}']], [(step, c, False) for step, c in each]


def _nodes(d: dict) -> Iterator[_Node]:
    def walk(d: dict, path: str, hide: bool, place: list[str], keys: int, anchor: str, sizes: tuple, before: list[str], after: list[str], edges: list[float], sparse: bool) -> Iterator[_Node]:
        pieces, below = _pieces(d, hide)
        pieces = [*pieces]
        pieces[0], pieces[-1] = [*before, *pieces[0]], [*(pieces[-1] if len(pieces) > 1 else [*before, *pieces[-1]]), *after]
        yield _Node(path, "Transformed" if d.get("transformed") else d["kind"], place, pieces, edges, anchor, sizes, sparse, keys)
        kind = d["kind"]
        for i, (step, c, hidden) in enumerate(below):
            down, here = f"{path}/{step}" if path else step, [*place, f"{2 * i + 1:06d}"]
            if not (i == 0 and step in ("values", "bins") and kind in (*H.BINNED, "Bag")):
                yield from walk(c, down, hidden, here, keys, anchor, sizes, [], [], [], False)
            elif kind == "Bin":
                yield from walk(c, down, hidden, [*here, f"#d{keys}"], keys + 1, anchor, (*sizes, d["num"]), ["#comma"], [], [], False)
            elif kind in _EDGE:
                at = [float(x) for x in d["centers" if kind == "CentrallyBin" else "edges"]]
                yield from walk(c, down, hidden, [*here, f"#d{keys}"], keys + 1, anchor, (*sizes, len(at)), ["#comma", f'{{"{_EDGE[kind]}": ', "#edge", ', "data": '], ["}"], at, False)
            elif kind == "Bag":
                own = {"S": [f"#s{keys}"]}.get(d["range"], [])
                value = "#" + {"S": "string", "N": "double"}.get(d["range"], "vector")
                yield _Node(down, "Item", [*here, *own], [["#comma", '{"w": ', "#entries", ', "v": ', value, "}"]], [], down, (), True, keys + 1)
            else:
                order = f"#{'i' if kind == 'SparselyBin' else 's'}{keys}"
                yield from walk(c, down, hidden, [*here, order], keys + 1, down, (), ["#comma", "#key", ": "], [], [], True)

    yield from walk(d, "", False, [], 0, "", (), [f'{{"version": {_text(VERSION)}, "type": {_text(d["kind"])}, "data": '], ["}"], [], False)


def _indents(nodes: list[_Node]) -> dict[tuple[str, int], str]:
    """What the lines of a piece begin with, by the path of its node and its number there."""
    return {k: f"{i:b}".translate({48: " ", 49: "\t"}) for i, k in enumerate((n.path, j) for n in nodes for j in range(len(n.pieces)))}


def _spelled(x: str) -> str:
    """SQL for a number as JSON."""
    whole = f"{x} = floor({x}) AND abs({x}) < 9007199254740992D"
    return f"CASE WHEN isnan({x}) THEN '\"nan\"' WHEN {x} = double('Infinity') THEN '\"inf\"' WHEN {x} = -double('Infinity') THEN '\"-inf\"' WHEN {whole} THEN string(bigint({x})) ELSE string({x}) END"


def _quoted(x: str) -> str:
    """SQL for a string as JSON."""
    return f"regexp_replace(to_json(array({x})), '^.|.$', '')"


def encode(tally: Tally, kept: str | None = None) -> DataFrame:
    """The JSON document of a result as rows (place, numbers, text, indent): sorted by the first two, the texts are the document.

    The tidy rows are written once, at ``kept`` or in the shared folder, as several steps read them."""
    spark, nodes = tally.rows.sparkSession, list(_nodes(tally.structure))
    kept = kept or shared_path(spark, "tidy")
    tally.tidy(dense=False).write.parquet(kept)
    rows = spark.read.parquet(kept)
    # every node that the document has: below each of the bins that data made, all those that are there without data
    whole = []
    for anchor in dict.fromkeys(n.anchor for n in nodes):
        made = rows.where(F.col("path") == anchor).select("keys") if anchor else spark.range(1).selectExpr("CAST(array() AS array<string>) AS keys")
        for sizes in dict.fromkeys(n.sizes for n in nodes if n.anchor == anchor):
            paths = F.array(*[F.lit(n.path) for n in nodes if n.anchor == anchor and n.sizes == sizes])
            numbers = [f"string(i div {prod(sizes[j + 1 :])}L % {n}L)" for j, n in enumerate(sizes)]
            each = made.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(prod(sizes) - 1).cast("long")))) if sizes else made
            each = each.selectExpr(f"concat(keys, array({', '.join(numbers)})) AS keys") if sizes else each
            whole.append(each.select("keys", F.explode(paths).alias("path")))
    whole = reduce(DataFrame.union, whole)
    # which bins are the first of those that data made
    sparse = [n.path for n in nodes if n.sparse]
    if sparse:
        some = rows.where(F.col("path").isin(sparse)).selectExpr("path", "slice(keys, 1, size(keys) - 1) AS above", "get(keys, size(keys) - 1) AS key", "keys")
        orders = {n.path: ("i" if n.place[-1].startswith("#i") else "s" if n.place[-1].startswith("#s") else "n" if n.pieces[0][4] == "#double" else "v") for n in nodes if n.sparse}
        order = F.create_map(*[F.lit(x) for item in orders.items() for x in item])[F.col("path")]
        some = some.withColumn("how", order)
        at = F.struct(F.expr("if(how = 'i', decimal(key), NULL)"), F.expr("if(how = 'n', double(key), NULL)"), F.expr("if(how = 'v', from_json(key, 'array<double>'), NULL)"), "key")
        first = some.groupBy("path", "above").agg(F.min_by("keys", at).alias("keys")).select("path", "keys", F.lit(True).alias("first"))
        whole = whole.join(first, ["path", "keys"], "left")
    else:
        whole = whole.withColumn("first", F.lit(False))
    indents = _indents(nodes)
    forms = [(n.path, [(f"{2 * i:06d}", p, indents[n.path, i]) for i, p in enumerate(n.pieces)], n.place, n.edges, n.sparse) for n in nodes]
    forms = spark.createDataFrame(forms, "path string, pieces array<struct<number: string, parts: array<string>, indent: string>>, place array<string>, edges array<double>, sparse boolean")
    # as many forms as the tree has nodes, whatever the bins
    out = whole.join(rows, ["path", "keys"], "left").join(F.broadcast(forms), "path").withColumn("last", F.expr("get(keys, size(keys) - 1)"))
    zero = {"entries": "0D", "sum": "0D"} | {m: "double('NaN')" for m in ("mean", "variance", "min", "max")}
    out = out.withColumns({m: F.expr(f"coalesce({m}, {z})") for m, z in zero.items()})
    vector = "from_json(last, 'array<double>')"
    fill = {f"#{m}": _spelled(m) for m in zero} | {
        "#comma": "if(coalesce(first, false) OR NOT sparse AND last = '0', '', ', ')", "#key": _quoted("last"), "#string": _quoted("last"), "#double": _spelled("double(last)"),
        "#edge": _spelled("get(edges, int(last))"), "#vector": f"concat('[', array_join(transform({vector}, x -> {_spelled('x')}), ', '), ']')",
    }
    text = "CASE p " + " ".join(f"WHEN '{k}' THEN {x}" for k, x in fill.items()) + " ELSE p END"
    key = "get(keys, int(substr(p, 3)))"
    order = f"CASE substr(p, 1, 2) WHEN '#d' THEN lpad({key}, 12, '0') WHEN '#i' THEN lpad(string(decimal({key}) + 9223372036854775808), 20, '0') WHEN '#s' THEN {key} ELSE p END"
    out = out.selectExpr("*", f"transform(place, p -> {order}) AS own", "explode(pieces) AS piece")
    numbers = f"CASE WHEN array_contains(piece.parts, '#double') THEN array(double(last)) WHEN array_contains(piece.parts, '#vector') THEN {vector} ELSE CAST(array() AS array<double>) END"
    place = "if(array_contains(piece.parts, '#double') OR array_contains(piece.parts, '#vector'), own, concat(own, array(piece.number)))"
    return out.selectExpr(f"{place} AS place", f"{numbers} AS numbers", f"array_join(transform(piece.parts, p -> {text}), '') AS text", "piece.indent")


def write_json(tally: Tally, path: str) -> None:
    """Writes a result as one JSON document over text files, and its structure beside them, in a new folder."""
    spark = tally.rows.sparkSession
    kept = shared_path(spark, "tidy")
    sorted_ = encode(tally, kept).repartitionByRange("place", "numbers").sortWithinPartitions("place", "numbers")
    sorted_.select(F.concat("indent", "text").alias("text")).write.option("maxRecordsPerFile", _LINES).text(path)
    Folder(spark, kept).delete("")
    Folder(spark, path).write("_structure.json", tally.structure)
    Folder(spark, path).write(_INDENTED, {"lines": _LINES})


def read_json(spark: SparkSession, path: str, structure: dict | None = None) -> Tally:
    """The result whose document :func:`write_json` has written; the structure is that beside it if none is given."""
    folder = Folder(spark, path)
    own = folder.read("_structure.json") if structure is None or folder.has(_INDENTED) else structure
    structure = own if structure is None else structure
    if folder.has(_INDENTED) and _nameless(own) == _nameless(structure):
        return from_tidy(_by_line(spark, path, structure), structure)
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    whole = lines.groupBy("file", "start").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]), "\n").alias("text"))
    doc = whole.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("file", "start", "text"))), lambda x: x["text"]), "\n").alias("doc"))
    return from_tidy(decode(doc, structure), structure)


def _nameless(d: dict) -> dict:
    """A structure without the names of quantities."""
    return {k: [[s, _nameless(c)] for s, c in x] if k == "children" else x for k, x in d.items() if k != "name"}


def _by_line(spark: SparkSession, path: str, structure: dict) -> DataFrame:
    """Tidy rows (and ``kind``) of a document whose lines are indented by the numbers of their pieces."""
    nodes = list(_nodes(structure))
    indents = _indents(nodes)
    how = {n.path: (n.pieces[0][4] if n.kind == "Item" else "#key" if n.sparse else "#number") if n.pieces[0][0] == "#comma" else None for n in nodes}
    table = [(indents[n.path, j], j == 0, n.path, n.kind, n.depth, how[n.path], n.sizes[-1] if n.sizes else None) for n in nodes for j in range(len(n.pieces))]
    table = spark.createDataFrame(table, "indent string, first boolean, path string, kind string, depth int, how string, size long")
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    lines = lines.withColumn("indent", F.regexp_extract("value", "^[ \t]*", 0)).join(F.broadcast(table), "indent", "left")
    lines = lines.where(F.coalesce("first", F.raise_error(F.lit("a line of the document is of no node")).cast("boolean")))
    # the numbers of a line, and its own bin
    number = r'"(?:nan|inf|-inf)"|[-+0-9.eE]+'
    many = rf'\{{"entries": ({number})(?:, "(?:sum|mean|min|max)": ({number}))?(?:, "variance": ({number}))?'
    item, kind = F.parse_json(F.when(F.col("kind") == "Item", F.regexp_extract("value", r'(?s)\{"w": .*', 0))), F.col("kind")
    one = F.regexp_extract("value", rf"({number})\}}*\z", 1)
    wrong = lambda: F.raise_error(F.concat(F.lit("the document has no number at '"), "path", F.lit("'"))).cast("double")
    real = lambda x: F.coalesce(F.btrim(x, F.lit('"')).try_cast("double"), wrong())
    group = lambda i: real(F.regexp_extract("value", many, i))
    text = lambda key: F.variant_get(item, f"$.{key}", "string")
    entries = F.when(kind.isin("Count", "Transformed"), real(one)).when(kind == "Item", real(text("w"))).otherwise(group(1))
    measures = {"entries": entries, **{m: F.when(kind.isin(*[k for k, ms in _MEASURES.items() if m in ms]), group(3 if m == "variance" else 2)) for m in ("sum", "mean", "variance", "min", "max")}}
    name = F.variant_get(F.parse_json(F.regexp_extract("value", rf'(?s)^[ \t]*(?:, )?(".*"): (?:\{{"entries": |(?:{number})\z)', 1)), "$", "string")
    vector = F.to_json(F.transform(F.variant_get(item, "$.v", "array<string>"), lambda x: x.cast("double")))
    key = F.when(F.col("how") == "#key", name).when(F.col("how") == "#string", text("v")).when(F.col("how") == "#double", text("v").cast("double").cast("string")).when(F.col("how") == "#vector", vector)
    top = F.when((F.col("path") == "") & ~F.contains("value", F.lit(f'"type": {_text(structure["kind"])}, "data": ')), F.raise_error(F.lit(f"the document is no {structure['kind']}")).cast("string")).otherwise(kind)
    rows = lines.select("file", "start", "at", "indent", "path", top.alias("kind"), "depth", "how", "size", key.alias("key"), *[x.alias(m) for m, x in measures.items()])
    within, over, part = Window.partitionBy("file", "start").orderBy("at"), Window.orderBy("file", "start"), ["file", "start"]
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    if "#number" in how.values():
        # a dense binning has all its bins, so the number of a bin follows from how many of its kind came before
        met = rows.where("how = '#number'").groupBy(*part, "indent").count()
        met = met.select(*part, "indent", F.coalesce(F.sum("count").over(before(Window.partitionBy("indent").orderBy(*part))), F.lit(0)).alias("met"))
        here = F.row_number().over(Window.partitionBy(*part, "indent").orderBy("at"))
        rows = rows.withColumn("here", here).join(F.broadcast(met), [*part, "indent"], "left")
        rows = rows.withColumn("key", F.when(F.col("how") == "#number", ((F.col("met") + F.col("here") - 1) % F.col("size")).cast("string")).otherwise(F.col("key")))
    deepest = max(n.depth for n in nodes)
    last: list[Column] = []
    if deepest:
        # the document goes through bins one after another, so the last bin of a depth that began is the one around what is deeper
        own = lambda x, i: F.when(F.col("how").isNotNull() & (F.col("depth") == i + 1), F.col(x))
        begun = rows.groupBy(*part).agg(*[F.max_by(own("key", i), own("at", i)).alias(f"b{i}") for i in range(deepest)])
        begun = begun.select(*part, *[F.last(f"b{i}", True).over(before(over)).alias(f"b{i}") for i in range(deepest)])
        rows = rows.select("*", *[F.last(own("key", i), True).over(within.rowsBetween(Window.unboundedPreceding, 0)).alias(f"k{i}") for i in range(deepest)]).join(F.broadcast(begun), part, "left")
        last = [F.coalesce(f"k{i}", f"b{i}") for i in range(deepest)]
    return rows.select("path", "kind", F.slice(F.array(*last).cast("array<string>"), F.lit(1), F.col("depth")).alias("keys"), *measures)


def decode(docs: DataFrame, structure: dict, doc_col: str = "doc", keep: tuple[str, ...] = ()) -> DataFrame:
    """Tidy rows (and ``kind``) of the JSON documents in a column, which all have one structure; columns in ``keep`` go with them.

    A document that lacks a part of the structure, or has another type at its top, is an error; null documents give no rows. Names are not compared.
    """
    top = docs.where(F.col(doc_col).isNotNull()).select(*keep, F.parse_json(doc_col).alias("v"))
    kind = f"variant_get(v, '$.type', 'string') = '{structure['kind']}'"
    top = top.selectExpr(*keep, f"if({kind}, variant_get(v, '$.data', 'variant'), CAST(raise_error('the document is no {structure['kind']}') AS VARIANT)) AS v", "CAST(array() AS array<string>) AS keys")
    number = lambda x, path: f"coalesce(CAST(CAST({x} AS STRING) AS DOUBLE), CAST(raise_error({_sql('the document has no number at ' + repr(path))}) AS DOUBLE))"
    field = lambda name: f"variant_get(v, '$.{name}', 'variant')"
    out: list[DataFrame] = []

    def rows(df: DataFrame, d: dict, path: str, **measures: str) -> None:
        kind = "Transformed" if d.get("transformed") else d["kind"]
        own = [f"{measures.get(m, 'double(NULL)')} AS {m}" for m in ("entries", "sum", "mean", "variance", "min", "max")]
        out.append(df.selectExpr(*keep, f"{_sql(path)} AS path", f"'{kind}' AS kind", "keys", *own))

    def down(df: DataFrame, value: str, keys: str = "keys") -> DataFrame:
        return df.selectExpr(*keep, f"{value} AS v", f"{keys} AS keys")

    def walk(df: DataFrame, d: dict, path: str) -> None:
        kind, below = d["kind"], dict(d.get("children", []))
        step = lambda s: f"{path}/{s}" if path else s
        if kind == "Count":
            rows(df, d, path, entries=number("v", path))
            return
        rows(df, d, path, entries=number(field("entries"), path), **{m: number(field(m), path) for m in _MEASURES.get(kind, ())})
        if kind == "Bag":
            each = df.selectExpr(*keep, "keys", f"explode(CAST({field('values')} AS ARRAY<VARIANT>)) AS v")
            value = {"S": "variant_get(v, '$.v', 'string')", "N": "string(double(variant_get(v, '$.v', 'string')))"}.get(d["range"], "to_json(transform(CAST(variant_get(v, '$.v', 'variant') AS ARRAY<STRING>), x -> double(x)))")
            rows(down(each, "v", f"concat(keys, array({value}))"), _ITEM, step("values"), entries=number("variant_get(v, '$.w', 'variant')", step("values")))
        elif kind in H.BINNED:
            name = "values" if kind == "Bin" else "bins"
            cast = "MAP<STRING, VARIANT>" if kind in ("SparselyBin", "Categorize") else "ARRAY<VARIANT>"
            each = df.selectExpr(*keep, "keys", f"{'explode' if cast.startswith('MAP') else 'posexplode'}(CAST({field(name)} AS {cast})) AS (k, v)")
            walk(down(each, "variant_get(v, '$.data', 'variant')" if kind in _EDGE else "v", "concat(keys, array(string(k)))"), below[name], step(name))
            for s in below:
                if s != name:
                    walk(down(df, field(s)), below[s], step(s))
        elif kind == "Fraction":
            for s in ("numerator", "denominator"):
                walk(down(df, field(s)), below["value"], step(s))
        elif kind == "Select":
            walk(down(df, field("data")), below["data"], step("data"))
        else:
            labels = kind in ("Label", "UntypedLabel")
            for i, (s, c) in enumerate(below.items()):
                value = f"try_element_at(CAST({field('data')} AS MAP<STRING, VARIANT>), {_sql(s)})" if labels else f"get(CAST({field('data')} AS ARRAY<VARIANT>), {i})"
                walk(down(df, value if kind in ("Label", "Index") else f"variant_get({value}, '$.data', 'variant')"), c, step(s))

    walk(top, structure, "")
    return reduce(DataFrame.union, out)


def _sql(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
