"""Personal data in texts, in DataFrame operations only.

Regular expressions propose spans, checksum validators (Luhn, mod 97) and range checks
confirm them, and words near a span adjust its score. A span is kept if its kind is one of
the base kinds and its validator agrees, or if its score reaches the threshold.

The patterns are written so that the regular-expression engine never goes back over a run
of characters: a match may start only where such a run starts (or where the last match
ended), and inner repetitions are possessive. Both leave the matches as they are and
keep the time linear in the text, for texts of any length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import fresh

#: The kinds, in the order of the output.
EMAIL = r"(?=[A-Za-z0-9._%+-])(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?=[0-9])(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?=[0-9])(?:(?<![0-9])|\G)[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
NATIONAL = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    """Whether the digits of ``x`` pass the Luhn check."""
    d = F.reverse(digits(x))

    def add(total: Column, i: Column) -> Column:
        v = d.substr(i, F.lit(1)).cast("int") * F.when(F.pmod(i, F.lit(2)) == 0, 2).otherwise(1)
        return total + F.when(v > 9, v - 9).otherwise(v)

    return F.pmod(F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add), F.lit(10)) == 0


def mod97(x: Column) -> Column:
    """Whether ``x`` is an account number whose ISO 7064 remainder is 1."""
    s = F.replace(x, F.lit(" "), F.lit(""))
    s = F.concat(F.substring(s, 5, 40), F.substring(s, 1, 4))

    def add(rest: Column, i: Column) -> Column:
        v = _value(s.substr(i, F.lit(1)))
        return F.pmod(rest * F.when(v > 9, 100).otherwise(10) + v, F.lit(97))

    return F.aggregate(F.sequence(F.lit(1), F.length(s)), F.lit(0), add) == 1


def _value(c: Column) -> Column:
    """0 to 9 for digits, 10 to 35 for A to Z."""
    code = F.ascii(c)
    return F.when(code >= 65, code - 55).otherwise(code - 48)


def between(x: Column, low: int, high: int) -> Column:
    n = F.length(digits(x))
    return (n >= low) & (n <= high)


@dataclass(frozen=True)
class Kind:
    """A kind of personal data: what proposes it, what must hold, and what speaks for it."""

    name: str
    pattern: str
    trigger: str
    check: object
    score: float
    context: str
    base: bool = True


KINDS = (
    Kind("email", EMAIL, "@", lambda x: F.lit(True), 0.8, "mail|contact|write|kontakt|correo"),
    Kind("ip", IP, ".", lambda x: x.rlike(OCTETS), 0.6, "ip|address|host|server|adresse"),
    Kind("card", CARD, "", lambda x: F.when(between(x, 13, 19), luhn(x)).otherwise(False), 0.8, "card|visa|credit|karte|carte|tarjeta"),
    Kind("phone", PHONE, "+", lambda x: between(x, 9, 15), 0.6, "call|phone|tel|fax|mobile|telefon"),
    Kind("iban", IBAN, "", mod97, 0.7, "iban|account|bank|konto|compte|cuenta", base=False),
    Kind("national", NATIONAL, "-", lambda x: ~x.rlike("^(?:000|666|9)|-00-|-0000$"), 0.3, "ssn|social security|tax id|taxpayer", base=False),
)
BONUS, NEAR, THRESHOLD = 0.3, 40, 0.6


#: Elements that are added up one after another; running totals are made of such blocks, so that time grows with
#: the number of spans, not with its square.
_BLOCK = 64
#: Code points of the blocks a text is cut into, to reach any place of it without reading all before it.
_REACH = 1024


def let(x: Column, use) -> Column:
    """``use(x)`` with x computed once."""
    return F.transform(F.array(x), use)[0]


def running(values: Column, add, levels: int = 3) -> Column:
    """add(... add(v1, v2) ..., vi) for each i of an array of ints."""
    def plain(part: Column) -> Column:
        step = lambda acc, v: F.concat(acc, F.array(F.when(F.size(acc) > 0, add(F.element_at(acc, -1), v)).otherwise(v)))
        return F.aggregate(part, F.array().cast("array<int>"), step)

    if levels == 1:
        return plain(values)

    def deep(v: Column) -> Column:
        count = F.ceil(F.size(v) / _BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), count - 1), lambda b: plain(F.slice(v, b * _BLOCK + 1, F.lit(_BLOCK))))

        def joined_(parts: Column) -> Column:
            ends = running(F.transform(parts, lambda p: F.element_at(p, -1)), add, levels - 1)
            return let(ends, lambda e: F.flatten(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.transform(p, lambda x: add(F.get(e, i - 1), x))))))

        return let(blocks, joined_)

    return F.when(F.size(values) > 0, let(values, deep)).otherwise(F.array().cast("array<int>"))


def reach(text: Column) -> Column:
    """The text as blocks of _REACH code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_REACH}}}"), F.lit(0))


def _near(blocks: Column, start: Column, n: Column) -> Column:
    """At most _REACH code points from a place on."""
    at = F.floor(start / _REACH).cast("int")
    two = F.concat(F.coalesce(F.get(blocks, at), F.lit("")), F.coalesce(F.get(blocks, at + 1), F.lit("")))
    return two.substr(start - at * _REACH + 1, n)


def _stretch(blocks: Column, start: Column, end: Column) -> Column:
    """The pieces of text between two places."""
    a, b = F.floor(start / _REACH).cast("int"), F.floor(end / _REACH).cast("int")
    head = lambda i, k, n: F.coalesce(F.get(blocks, i), F.lit("")).substr(k, n)
    across = F.concat(F.array(head(a, start - a * _REACH + 1, F.lit(_REACH))), F.slice(blocks, a + 2, F.greatest(b - a - 1, F.lit(0))), F.array(head(b, F.lit(1), end - b * _REACH)))
    return F.when(a == b, F.array(head(a, start - a * _REACH + 1, end - start))).otherwise(across)


def _spans(text: Column, kind: Kind) -> Column:
    """The matches of one kind and the lengths of the texts between them, in code points."""
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    gaps = F.transform(F.split(text, kind.pattern, -1), lambda x: F.length(x))
    return F.struct(found.alias("found"), gaps.alias("gaps"))


def _placed(blocks: Column, raw: Column, kind: Kind, rank: int, threshold: float) -> Column:
    """array<struct<rank, start, end, kind, score>> of one kind; code points, end exclusive.

    The texts between matches and the matches alternate, so their lengths add up to the places.
    """

    def scored(s: Column) -> Column:
        before = F.greatest(s["start"] - NEAR, F.lit(0))
        near = F.concat(_near(blocks, before, s["start"] - before), F.lit(" "), _near(blocks, s["end"], F.lit(NEAR)))
        score = F.lit(kind.score) + F.when(F.lower(near).rlike(rf"(?:^|[^a-z])(?:{kind.context})"), BONUS).otherwise(0.0)
        return F.struct(F.lit(rank).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), F.lit(kind.name).alias("kind"), F.round(score, 3).alias("score"))

    def ended(r: Column) -> Column:
        ends = running(F.zip_with(F.slice(r["gaps"], F.lit(1), F.size(r["found"])), r["found"], lambda g, x: g + F.length(x)), lambda a, b: a + b)
        placed = F.zip_with(r["found"], ends, lambda x, e: F.struct(x.alias("match"), (e - F.length(x)).alias("start"), e.alias("end")))
        return F.transform(F.filter(placed, lambda s: kind.check(s["match"])), scored)

    placed = let(raw, ended)
    return placed if kind.base else F.filter(placed, lambda s: s["score"] >= threshold)


_FOUND = "array<struct<rank:int,start:int,end:int,kind:string,score:double>>"


def find_pii(docs: DataFrame, text_col: str = "text", kinds: tuple[Kind, ...] = KINDS, threshold: float = THRESHOLD, out: str = "pii") -> DataFrame:
    """``docs`` with a column ``out``: array<struct<rank, start, end, kind, score>>, by rank of
    the kind, then start.

    Null and empty texts have an empty array. Matches of one kind never overlap; those of
    different kinds may. Repeated rows each get their own array; other columns pass through
    unchanged, and a column named as ``out`` is replaced. An empty table stays empty. Time grows with the text and
    with the number of matches.
    """
    names = fresh(docs, "pii_text", *[f"pii_raw{i}" for i in range(len(kinds))])
    t = F.col(names[0])
    digit = t.rlike("[0-9]")
    df = docs.withColumn(names[0], F.coalesce(F.col(text_col), F.lit("")))
    df = df.withColumns({n: F.when((t.contains(k.trigger) if k.trigger else F.lit(True)) & (F.lit(True) if k.name == "email" else digit), _spans(t, k)) for n, k in zip(names[1:], kinds, strict=True)})
    empty = F.array().cast(_FOUND)
    some = {n: F.size(F.col(n)["found"]) > 0 for n in names[1:]}

    def each(blocks: Column) -> Column:
        return F.concat(*[F.when(some[n], _placed(blocks, F.col(n), k, i, threshold)).otherwise(empty) for i, (n, k) in enumerate(zip(names[1:], kinds, strict=True))])

    any_ = F.coalesce(*[F.when(x, True) for x in some.values()], F.lit(False))
    return df.withColumn(out, F.when(any_, let(reach(t), each)).otherwise(empty)).drop(*names)


def joined(spans: Column) -> Column:
    """kind:start:end of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with every span in ``text_col`` replaced by its kind in angle brackets, as <EMAIL>.

    Of overlapping spans the one that starts first (then the longest) names the whole stretch
    they cover. Texts without spans, null ones included, stay as they are.
    """
    (name,) = fresh(docs, "pii_spans")
    df = find_pii(docs, text_col, out=name, **options)
    t = F.col(text_col)
    order = F.array_sort(F.transform(F.col(name), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))

    def clean(spans: Column) -> Column:
        # how far the spans up to each one reach: the first one beyond that begins a new stretch
        return let(running(F.transform(spans, lambda s: -s["back"]), F.greatest), lambda upto: let(_begins(spans, upto), lambda begins: let(reach(t), lambda blocks: _rebuilt(spans, upto, begins, blocks))))

    return df.withColumn(text_col, F.when(F.size(name) > 0, let(order, clean)).otherwise(t)).drop(name)


def _begins(spans: Column, upto: Column) -> Column:
    """The numbers of the spans that begin a stretch."""
    return F.filter(F.sequence(F.lit(0), F.size(spans) - 1), lambda i: (i == 0) | (F.get(spans, i)["start"] >= F.get(upto, i - 1)))


def _rebuilt(spans: Column, upto: Column, begins: Column, blocks: Column) -> Column:
    """The text between stretches, and the kind that names each."""

    def piece(i: Column, k: Column) -> Column:
        span, last = F.get(spans, i), F.when(i == 0, 0).otherwise(F.get(upto, F.greatest(i - 1, F.lit(0))))
        return F.concat(_stretch(blocks, last, span["start"]), F.array(F.concat(F.lit("<"), F.upper(span["kind"]), F.lit(">"))))

    end = F.element_at(upto, -1)
    rest = F.concat(F.array(_near(blocks, end, F.lit(_REACH) - end + F.floor(end / _REACH).cast("int") * _REACH)), F.slice(blocks, F.floor(end / _REACH).cast("int") + 2, F.size(blocks)))
    return F.array_join(F.concat(F.flatten(F.transform(begins, piece)), rest), "")
