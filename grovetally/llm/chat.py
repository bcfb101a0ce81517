"""Chat formatting in DataFrame operations only.

Records of any layout become canonical turns through schema fingerprinting: the nested field
paths of a record that some mapping knows are hashed, and the hash selects a declarative mapping. Fields that no
mapping knows do not matter. The turns are then
written with a template that marks turns and escapes control strings inside texts, and can
be read back from the formatted string alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import fresh

TURNS = "array<struct<role:string,text:string>>"

#: The marks of the template. Escaped texts hold no "<", so no mark can be met
#: inside one.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Roles whose texts are under the loss mask.
LEARNED = ("assistant",)


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns: ``parts`` are (role, path of a text), or ``each`` is
    (path of an array, its role field, its text field) with ``roles`` as names of roles."""

    name: str
    parts: tuple[tuple[str, str], ...] = ()
    each: tuple[str, str, str] | None = None
    roles: tuple[tuple[str, str], ...] = ()

    @property
    def paths(self) -> tuple[str, ...]:
        """The nested field paths that make up this layout."""
        if self.each:
            path, role, text = self.each
            return (f"{path}[*]", f"{path}[*].{role}", f"{path}[*].{text}")
        return tuple(path for _, path in self.parts)


#: Layouts. Of those that fit a record the one with the most paths counts, then the first.
MAPPINGS = (
    Mapping("messages", each=("$.messages", "role", "content")),
    Mapping("turns", each=("$.turns", "role", "text")),
    Mapping("conversations", each=("$.conversations", "from", "value"), roles=(("human", "user"), ("gpt", "assistant"))),
    Mapping("instruction", parts=(("user", "$.instruction"), ("user", "$.input"), ("assistant", "$.output"))),
    Mapping("instruction_plain", parts=(("user", "$.instruction"), ("assistant", "$.output"))),
    Mapping("prompt", parts=(("user", "$.prompt"), ("assistant", "$.completion"))),
    Mapping("prompt_response", parts=(("system", "$.system"), ("user", "$.prompt"), ("assistant", "$.response"))),
    Mapping("prompt_plain", parts=(("user", "$.prompt"), ("assistant", "$.response"))),
    Mapping("question", parts=(("user", "$.question"), ("assistant", "$.answer"))),
)


def _has(record: Column, path: str) -> Column:
    """Whether a variant has a nested field path. [*] stands for an array and .field after it for a field of its
    elements; an array without elements has all fields, as none of its elements lacks one."""
    array, _, field = path.partition("[*]")
    if array == path:  # anything but an object or array can be a text
        return F.try_variant_get(record, path, "string").isNotNull() | F.coalesce(F.is_variant_null(F.try_variant_get(record, path, "variant")), F.lit(False))
    rows = F.try_variant_get(record, array, "array<variant>")
    if not field:
        return rows.isNotNull()
    got = lambda x: F.try_variant_get(x, "$" + field, "variant").isNotNull()
    return F.coalesce((F.size(rows) == 0) | F.exists(rows, got), F.lit(False))


def fingerprint(record: Column, paths: tuple[str, ...]) -> Column:
    """A 64-bit hash of those of some nested field paths that a variant has."""
    had = F.transform(F.filter(F.array(*[F.struct(F.lit(p).alias("path"), _has(record, p).alias("has")) for p in paths]), lambda x: x["has"]), lambda x: x["path"])
    return F.xxhash64(F.array_join(had, "\n"))


def _own(paths: tuple[str, ...]) -> Column:
    """The fingerprint of a record that has all of some paths."""
    return F.xxhash64(F.lit("\n".join(paths)))


def _turns(record: Column, m: Mapping) -> Column:
    if m.each:
        path, role, text = m.each
        rows = F.try_variant_get(record, path, "array<variant>")
        get = lambda x, field: F.try_variant_get(x, "$." + field, "string")

        def name(r: Column) -> Column:
            out = r
            for was, now in m.roles:
                out = F.when(r == was, now).otherwise(out)
            return F.coalesce(out, F.lit(""))

        return F.transform(rows, lambda x: F.struct(name(get(x, role)).alias("role"), F.coalesce(get(x, text), F.lit("")).alias("text")))
    parts = [F.struct(F.lit(role).alias("role"), F.try_variant_get(record, path, "string").alias("text")) for role, path in m.parts]
    return F.filter(F.array(*parts), lambda x: x["text"].isNotNull())


def canonical_turns(records: DataFrame, record_col: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """``records`` with turns: array<struct<role, text>>, and layout: the mapping's name. Where a column has one of
    these names, an underscore is put before the new one.

    ``record_col`` is a variant or a string of JSON. A mapping fits a record that has all paths of the
    mapping, whatever else it has; an array without elements fits and gives no turns. A record that no mapping fits, that is null or is
    no JSON, has null turns and a null layout. Roles and texts that are null, missing or no text in a list of messages become
    empty; a null part of a prompt layout is left out. Repeated rows are formatted one by one; an empty table stays empty.
    """
    kind = records.schema[record_col].dataType.typeName()
    v = F.col(record_col) if kind == "variant" else F.try_parse_json(F.col(record_col))
    turns_col, layout_col, variant, number = fresh(records, "turns", "layout", "variant_of_record", "number_of_mapping")
    df = records.withColumn(variant, v)
    order = sorted(range(len(mappings)), key=lambda i: (-len(mappings[i].paths), i))
    chosen = F.coalesce(*[F.when(fingerprint(F.col(variant), mappings[i].paths) == _own(mappings[i].paths), i) for i in order])
    df = df.withColumn(number, F.when(F.col(variant).isNotNull(), chosen))
    turns, layout = F.lit(None).cast(TURNS), F.lit(None).cast("string")
    for i, m in enumerate(mappings):
        turns = F.when(F.col(number) == i, _turns(F.col(variant), m)).otherwise(turns)
        layout = F.when(F.col(number) == i, F.lit(m.name)).otherwise(layout)
    return df.withColumns({turns_col: turns, layout_col: layout}).drop(variant, number)


def _says(turns: Column, m: Mapping) -> Column:
    """Whether a layout can hold some turns so that they are read back as they are."""
    if m.each:
        return ~F.exists(turns, lambda t: t["role"].isin(*[was for was, _ in m.roles])) if m.roles else F.lit(True)
    return F.transform(turns, lambda t: t["role"]) == F.array(*[F.lit(role) for role, _ in m.parts])


def _record(turns: Column, m: Mapping) -> Column:
    """The variant that holds some turns in a layout, whose fields stand at the top of a record."""
    field = lambda path: path.removeprefix("$.")
    if not m.each:
        return F.to_variant_object(F.struct(*[F.get(turns, F.lit(i))["text"].alias(field(path)) for i, (_, path) in enumerate(m.parts)]))
    path, role, text = m.each

    def name(r: Column) -> Column:
        out = r
        for was, now in m.roles:
            out = F.when(r == now, was).otherwise(out)
        return out

    return F.to_variant_object(F.struct(F.transform(turns, lambda t: F.struct(name(t["role"]).alias(role), t["text"].alias(text))).alias(field(path))))


def gathered(rows: DataFrame, layouts: tuple[Mapping, ...] = MAPPINGS[1:2]) -> DataFrame:
    """A record for each conv_id of (conv_id, turn, role, text), {"turns": [{role, text}]} unless ``layouts`` says otherwise.

    Turns go by number, null last; rows that tie go by role and text, so repeated rows give
    repeated turns. Null roles and texts become empty, null ids form one conversation. A
    conversation is one training example, so its rows are brought together.

    With several ``layouts``, as a table put together from several sources has them, the hash of a conversation's id selects one of those that can hold
    its roles; a conversation that none can hold has a null record.
    """
    rows = rows.select(
        "conv_id", F.struct(F.col("turn").isNull().alias("late"), F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("row")
    )
    turns = F.transform(F.array_sort(F.collect_list("row")), lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text")))
    whole, t = rows.groupBy("conv_id").agg(turns.alias("turns")), F.col("turns")
    able = F.filter(F.array(*[F.when(_says(t, m), i) for i, m in enumerate(layouts)]), lambda i: i.isNotNull())
    whole = whole.withColumn("able", able).withColumn("layout", F.get("able", F.pmod(F.xxhash64("conv_id"), F.greatest(F.size("able"), F.lit(1))).cast("int")))
    record = F.lit(None).cast("variant")
    for i, m in enumerate(layouts):
        record = F.when(F.col("layout") == i, _record(t, m)).otherwise(record)
    return whole.select("conv_id", record.alias("record"))


def escape(x: Column) -> Column:
    """Backslash becomes two, "<" becomes backslash and l."""
    return F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l"))


def unescape(x: Column) -> Column:
    """The inverse of :func:`escape`. Runs of backslashes are pairs from their start on."""
    return F.array_join(F.transform(F.split(x, r"\\\\"), lambda p: F.replace(p, F.lit("\\l"), F.lit("<"))), "\\")


def formatted(turns: Column) -> Column:
    """The training string of array<struct<role, text>>."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT), escape(t["text"]), F.lit(END))), "")


def read_back(x: Column, learned: tuple[str, ...] = LEARNED) -> Column:
    """array<struct<role, text, loss>> from a formatted string; loss: under the loss mask."""
    pieces = F.split(x, r"<\|end\|>", -1)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(p: Column) -> Column:
        parts = F.split(F.substring(p, len(TURN) + 1, 2**31 - 1), r"<\|text\|>", -1)
        role = unescape(parts[0])
        return F.struct(role.alias("role"), unescape(parts[1]).alias("text"), role.isin(*learned).alias("loss"))

    return F.transform(pieces, turn)


def format_chats(records: DataFrame, record_col: str = "record", **options) -> DataFrame:
    """``records`` with turns, layout and formatted as further columns; null where no mapping fits. Names, nulls,
    repeated rows and empty tables are as in :func:`canonical_turns`."""
    (turns,) = fresh(records, "turns")
    df = canonical_turns(records, record_col, **options)
    return df.withColumn(fresh(records, "formatted")[0], formatted(F.col(turns)))
