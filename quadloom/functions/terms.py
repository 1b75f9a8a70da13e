"""Values of query variables and RDF terms as columns.

A term is one string: ``<iri>``, ``_:label``, ``"text"``, ``"text"@tag`` or
``"text"^^<datatype>``; the text stands as it is, the last quotation mark ends
it.  Equal terms are equal strings, so joins and DISTINCT work on plain
strings.  NULL is unbound or an error.

A ``Val`` is a column with what is known about it beforehand.  Columns that
come from typed tables stay typed (``int``, ``dec``, ``dbl``, ``bool``, ``str``,
``ts``, ``date``, ``iri``, and ``ref``: the key of a row whose IRI is built from
it) until something needs the term, so filters reach the Parquet scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadloom import vocab as v

DECIMAL = "decimal(38,10)"


def null(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


@dataclass(frozen=True)
class Val:
    """A column, its kind, and for ``ref`` the IRI prefix that the key follows."""

    kind: str
    col: Column
    prefix: str = ""

    def term(self) -> Column:
        c = self.col
        match self.kind:
            case "term":
                return c
            case "iri":
                return F.concat(F.lit("<"), c, F.lit(">"))
            case "ref":
                return F.concat(F.lit("<" + self.prefix), c.cast("string"), F.lit(">"))
            case "str":
                return F.concat(F.lit('"'), c, F.lit('"'))
            case "bool":
                return typed(c.cast("string"), v.XSD_BOOLEAN)
            case "int":
                return typed(c.cast("string"), v.XSD_INTEGER)
            case "dec":
                return typed(decimal_text(c), v.XSD_DECIMAL)
            case "dbl":
                return typed(double_text(c), v.XSD_DOUBLE)
            case "ts":
                return typed(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"), v.XSD_DATETIME)
            case "date":
                return typed(c.cast("string"), v.XSD_DATE)
        raise ValueError(self.kind)

    def plain(self) -> Column:
        """The value as users of a table expect it: numbers as numbers, IRIs and texts as strings."""
        if self.kind == "ref":
            return F.concat(F.lit(self.prefix), self.col.cast("string"))
        if self.kind == "term":
            return F.when(is_iri(self.col), F.substring(self.col, F.lit(2), F.char_length(self.col) - 2)).when(is_literal(self.col), lex(self.col)).otherwise(self.col)
        return self.col


def typed(text: Column, datatype: str) -> Column:
    return F.concat(F.lit('"'), text, F.lit(f'"^^<{datatype}>'))


def decimal_text(c: Column) -> Column:
    text = c.cast("string")
    text = F.when(text.contains("."), F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")).otherwise(text)
    return F.when(text.contains(".") | text.isNull(), text).otherwise(F.concat(text, F.lit(".0")))


def double_text(c: Column) -> Column:
    return F.when(F.isnan(c), "NaN").when(c == float("inf"), "INF").when(c == float("-inf"), "-INF").otherwise(c.cast("string"))


def is_iri(t: Column) -> Column:
    return t.startswith("<")


def is_blank(t: Column) -> Column:
    return t.startswith("_:")


def is_literal(t: Column) -> Column:
    return t.startswith('"')


def lex(t: Column) -> Column:
    """The text of a literal; NULL for others."""
    return F.when(is_literal(t), F.regexp_extract(t, r'(?s)^"(.*)"', 1))


def lang(t: Column) -> Column:
    return F.when(is_literal(t), F.regexp_extract(t, r'"@([A-Za-z0-9-]+)$', 1))


def explicit_type(t: Column) -> Column:
    """The datatype that is written out, '' if there is none."""
    return F.regexp_extract(t, r'"\^\^<([^>]*)>$', 1)


def datatype(t: Column) -> Column:
    own = explicit_type(t)
    return F.when(is_literal(t), F.when(own != "", own).when(F.regexp_extract(t, r'"@([A-Za-z0-9-]+)$', 1) != "", v.LANG_STRING).otherwise(v.XSD_STRING))


def rank(t: Column) -> Column:
    """0 integer, 1 decimal, 2 float, 3 double; NULL for what is no number."""
    d = explicit_type(t)
    return F.when(d.isin(*v.INTEGERS), 0).when(d == v.XSD_DECIMAL, 1).when(d == v.XSD_FLOAT, 2).when(d == v.XSD_DOUBLE, 3)


_EXACT = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$"


def try_cast(c: Column, kind: str) -> Column:
    return c.try_cast(kind)


def exact(text: Column) -> Column:
    return F.when(text.rlike(_EXACT), try_cast(text, DECIMAL))


def approximate(text: Column) -> Column:
    return F.when(text == "INF", float("inf")).when(text == "-INF", float("-inf")).when(text.rlike(r"^([+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|NaN)$"), try_cast(text, "double"))


@dataclass(frozen=True)
class Num:
    """A number: rank 0..3 as an int if it is known beforehand, its exact and its floating value."""

    rank: int | Column
    dec: Column
    dbl: Column

    def value(self) -> Val:
        """As narrow a value as the rank allows."""
        if isinstance(self.rank, int) and self.rank == 0:
            return Val("int", try_cast(self.dec, "bigint"))
        if isinstance(self.rank, int) and self.rank == 1:
            return Val("dec", self.dec)
        if isinstance(self.rank, int):
            return Val("dbl", self.dbl)
        whole = try_cast(self.dec, "decimal(38,0)").cast("string")
        return Val(
            "term",
            F.when(self.rank == 0, typed(whole, v.XSD_INTEGER)).when(self.rank == 1, typed(decimal_text(self.dec), v.XSD_DECIMAL)).when(self.rank == 2, typed(double_text(self.dbl), v.XSD_FLOAT)).when(self.rank == 3, typed(double_text(self.dbl), v.XSD_DOUBLE)),
        )


def number(x: Val) -> Num:
    match x.kind:
        case "int":
            return Num(0, x.col.cast(DECIMAL), x.col.cast("double"))
        case "dec":
            return Num(1, try_cast(x.col, DECIMAL), x.col.cast("double"))
        case "dbl":
            return Num(3, try_cast(x.col, DECIMAL), x.col.cast("double"))
        case "term":
            r, text = rank(x.col), lex(x.col)
            return Num(r, F.when(r <= 1, exact(text)), F.when(r.isNotNull(), approximate(text)))
        case _:
            return Num(0, null(DECIMAL), null("double"))


def text_of(x: Val) -> Column:
    """What STR gives: the text of a literal, the IRI, NULL for blank nodes."""
    match x.kind:
        case "term":
            return F.when(is_iri(x.col), F.substring(x.col, F.lit(2), F.char_length(x.col) - 2)).otherwise(lex(x.col))
        case "iri" | "str":
            return x.col
        case "ref":
            return x.plain()
        case _:
            return lex(x.term())


def instant(x: Val) -> Column:
    """The timestamp of a dateTime or date; NULL for others."""
    match x.kind:
        case "ts":
            return x.col.cast("timestamp")
        case "date":
            return x.col.cast("timestamp")
        case "term":
            return F.when(explicit_type(x.col).isin(v.XSD_DATETIME, v.XSD_DATE), F.try_to_timestamp(lex(x.col)))
    return null("timestamp")


def truth(x: Val) -> Column:
    """The effective boolean value; NULL is an error."""
    match x.kind:
        case "bool":
            return x.col
        case "int" | "dec":
            return x.col != 0
        case "dbl":
            return (x.col != 0) & ~F.isnan(x.col)
        case "str":
            return x.col != ""
        case "iri" | "ref" | "ts" | "date":
            return null("boolean")
    t, text = x.col, lex(x.col)
    d, r = explicit_type(t), rank(t)
    value = approximate(text)
    return (
        F.when(d == v.XSD_BOOLEAN, text.isin("true", "1"))
        .when(r.isNotNull(), F.coalesce((value != 0) & ~F.isnan(value), F.lit(False)))
        .when(is_literal(t) & ((d == "") | (d == v.XSD_STRING)), text != "")
    )


def order_keys(x: Val) -> list[Column]:
    """Sort keys of the total order: unbound, blank nodes, IRIs, literals; numbers by value, then the rest by text."""
    if x.kind in ("int", "dec", "dbl", "str", "bool", "ts", "date"):
        return [x.col]
    if x.kind == "iri":
        return [x.col]
    if x.kind == "ref":
        return [x.plain()]
    t = x.col
    kind = F.when(t.isNull(), 0).when(is_blank(t), 1).when(is_iri(t), 2).when(rank(t).isNotNull(), 3).when(explicit_type(t).isin(v.XSD_DATETIME, v.XSD_DATE), 4).otherwise(5)
    return [kind, F.when(rank(t).isNotNull(), approximate(lex(t))), instant(x), F.coalesce(text_of(x), t), t]


def same_kind(a: Val, b: Val) -> bool:
    return a.kind == b.kind and a.prefix == b.prefix and a.kind != "dbl"
