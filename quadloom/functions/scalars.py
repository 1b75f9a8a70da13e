"""SPARQL operators and functions as column expressions; NULL stands for unbound and for errors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadloom import vocab as v
from quadloom.functions import terms as t
from quadloom.functions.terms import Num, Val

_NUMERIC = ("int", "dec", "dbl")


def const(term: str) -> Val:
    """A constant as a value of the narrowest kind."""
    if term.startswith("<"):
        return Val("iri", F.lit(term[1:-1]))
    if term.startswith("_:"):
        return Val("term", F.lit(term))
    text, _, suffix = term[1:].rpartition('"')
    if not suffix:
        return Val("str", F.lit(text))
    try:
        if suffix == f"^^<{v.XSD_INTEGER}>" and str(int(text)) == text and abs(int(text)) < 1 << 63:
            return Val("int", F.lit(int(text)).cast("bigint"))
        if suffix == f"^^<{v.XSD_BOOLEAN}>" and text in ("true", "false"):
            return Val("bool", F.lit(text == "true"))
    except ValueError:
        pass
    return Val("term", F.lit(term))


def string_parts(x: Val) -> tuple[Column, Column]:
    """The text and the suffix ('' or @tag) of a string literal; NULL for others."""
    if x.kind == "str":
        return x.col, F.lit("")
    if x.kind == "term":
        d = t.explicit_type(x.col)
        ok = t.is_literal(x.col) & ((d == "") | (d == v.XSD_STRING))
        tag = t.lang(x.col)
        return F.when(ok, t.lex(x.col)), F.when(ok, F.when(tag == "", "").otherwise(F.concat(F.lit("@"), tag)))
    return t.null(), t.null()


def with_suffix(text: Column, suffix: Column, plain: bool) -> Val:
    return Val("str", text) if plain else Val("term", F.concat(F.lit('"'), text, F.lit('"'), suffix))


def compatible(a: Val, b: Val) -> Column:
    """The second string argument is plain or has the first one's tag."""
    if a.kind == b.kind == "str":
        return F.lit(True)
    _, x = string_parts(a)
    _, y = string_parts(b)
    return (y == "") | (x == y)


# --- comparison ---------------------------------------------------------------


def _compare_numbers(a: Val, b: Val, op: Callable[[Column, Column], Column]) -> Column:
    x, y = t.number(a), t.number(b)
    exact = op(x.dec, y.dec)
    loose = op(x.dbl, y.dbl) & ~F.isnan(x.dbl) & ~F.isnan(y.dbl)
    if isinstance(x.rank, int) and isinstance(y.rank, int):
        if a.kind == b.kind == "int":
            return op(a.col, b.col)
        return exact if max(x.rank, y.rank) <= 1 else loose
    both = (F.lit(x.rank) if isinstance(x.rank, int) else x.rank).isNotNull() & (F.lit(y.rank) if isinstance(y.rank, int) else y.rank).isNotNull()
    narrow = F.greatest(F.lit(x.rank) if isinstance(x.rank, int) else x.rank, F.lit(y.rank) if isinstance(y.rank, int) else y.rank) <= 1
    return F.when(both, F.when(narrow, exact).otherwise(loose))


def equal(a: Val, b: Val) -> Column:
    if a.kind in _NUMERIC and b.kind in _NUMERIC:
        return _compare_numbers(a, b, lambda x, y: x == y)
    if a.kind == b.kind and a.kind in ("str", "bool", "ts", "date", "iri"):
        return a.col == b.col
    if a.kind == b.kind == "ref":
        return a.col == b.col if a.prefix == b.prefix else F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(False))
    if {a.kind, b.kind} == {"ref", "iri"}:
        return a.plain() == b.plain()
    x, y = a.term(), b.term()
    numbers = t.number(a), t.number(b)
    both_numbers = (F.lit(0) if isinstance(numbers[0].rank, int) else numbers[0].rank).isNotNull() & (F.lit(0) if isinstance(numbers[1].rank, int) else numbers[1].rank).isNotNull()
    if not (a.kind in (*_NUMERIC, "term") and b.kind in (*_NUMERIC, "term")):
        both_numbers = F.lit(False)
    times = t.instant(a), t.instant(b)
    tx, ty = t.truth(a), t.truth(b)
    dx, dy = t.datatype(x), t.datatype(y)
    known = [v.XSD_STRING, v.LANG_STRING, v.XSD_BOOLEAN]
    return (
        F.when(both_numbers, _compare_numbers(a, b, lambda p, q: p == q))
        .when((dx == v.XSD_BOOLEAN) & (dy == v.XSD_BOOLEAN), tx == ty)
        .when(times[0].isNotNull() & times[1].isNotNull(), times[0] == times[1])
        .when(x == y, F.lit(True))
        .when(t.is_literal(x) & t.is_literal(y) & ~(dx.isin(*known) & dy.isin(*known)) & (dx == dy), t.null("boolean"))
        .when(x.isNotNull() & y.isNotNull(), F.lit(False))
    )


def less(a: Val, b: Val, op: Callable[[Column, Column], Column]) -> Column:
    if a.kind in _NUMERIC and b.kind in _NUMERIC:
        return _compare_numbers(a, b, op)
    if a.kind == b.kind and a.kind in ("str", "bool", "ts", "date"):
        return op(a.col, b.col)
    if "iri" in (a.kind, b.kind) or "ref" in (a.kind, b.kind):
        return t.null("boolean")
    x, y = t.number(a), t.number(b)
    (p, ps), (q, qs) = string_parts(a), string_parts(b)
    bx, by = t.truth(a), t.truth(b)
    boolean = (t.datatype(a.term()) == v.XSD_BOOLEAN) & (t.datatype(b.term()) == v.XSD_BOOLEAN)
    out = F.when(p.isNotNull() & q.isNotNull() & (ps == "") & (qs == ""), op(p, q)).when(boolean, op(bx, by))
    times = t.instant(a), t.instant(b)
    out = out.when(times[0].isNotNull() & times[1].isNotNull(), op(times[0], times[1]))
    if a.kind in (*_NUMERIC, "term") and b.kind in (*_NUMERIC, "term"):
        numbers = _compare_numbers(a, b, op)
        rank = lambda n: F.lit(n.rank) if isinstance(n.rank, int) else n.rank
        return F.when(rank(x).isNotNull() & rank(y).isNotNull(), numbers).otherwise(out)
    return out


# --- arithmetic ---------------------------------------------------------------


def arithmetic(name: str, a: Val, b: Val) -> Val:
    x, y = t.number(a), t.number(b)
    f = {"+": "try_add", "-": "try_subtract", "*": "try_multiply", "/": "try_divide"}[name]
    if name != "/" and a.kind == b.kind == "int":
        return Val("int", F.call_function(f, a.col, b.col))
    least = 1 if name == "/" else 0
    if isinstance(x.rank, int) and isinstance(y.rank, int):
        rank: int | Column = max(x.rank, y.rank, least)
    else:
        lift = lambda r: F.lit(r) if isinstance(r, int) else r
        rank = F.when(lift(x.rank).isNotNull() & lift(y.rank).isNotNull(), F.greatest(lift(x.rank), lift(y.rank), F.lit(least)))
    narrow = "decimal(28,10)"
    dec = t.try_cast(F.call_function(f, t.try_cast(x.dec, narrow), t.try_cast(y.dec, narrow)), t.DECIMAL)
    dbl = F.call_function({"+": "try_add", "-": "try_subtract", "*": "try_multiply", "/": "try_divide"}[name], x.dbl, y.dbl)
    if name == "/":
        dbl = F.when(y.dbl != 0, dbl).when(F.isnan(x.dbl) | (x.dbl == 0), float("nan")).when(x.dbl > 0, float("inf")).when(x.dbl < 0, float("-inf"))
    return Num(rank, dec, dbl).value()


def map_number(x: Val, dec: Callable[[Column], Column], dbl: Callable[[Column], Column]) -> Val:
    n = t.number(x)
    return Num(n.rank, t.try_cast(dec(n.dec), t.DECIMAL), dbl(n.dbl)).value()


# --- casts --------------------------------------------------------------------


def cast_to(iri: str, x: Val) -> Val:
    text = t.text_of(x)
    n = t.number(x)
    if iri == v.XSD_STRING:
        return Val("str", F.when(~t.is_blank(x.term()), text))
    if iri == v.XSD_BOOLEAN:
        if x.kind == "bool":
            return x
        known = (F.lit(n.rank) if isinstance(n.rank, int) and x.kind in _NUMERIC else n.rank if not isinstance(n.rank, int) else t.null("int")).isNotNull()
        return Val("bool", F.when(known, F.coalesce((n.dbl != 0) & ~F.isnan(n.dbl), F.lit(False))).when(text.isin("true", "1"), True).when(text.isin("false", "0"), False))
    if iri in (v.XSD_INTEGER, v.XSD + "int", v.XSD + "long"):
        if x.kind == "int":
            return x
        whole = F.when(text.rlike(r"^[+-]?[0-9]+$"), t.try_cast(text, "bigint"))
        truncated = t.try_cast(F.when(n.dbl >= 0, F.floor(n.dbl)).otherwise(F.ceil(n.dbl)), "bigint")
        as_bool = t.truth(x) if x.kind in ("bool", "term") else t.null("boolean")
        return Val("int", F.coalesce(whole, F.when(~F.isnan(n.dbl), truncated), F.when(t.datatype(x.term()) == v.XSD_BOOLEAN, as_bool.cast("bigint"))))
    if iri == v.XSD_DECIMAL:
        as_bool = t.truth(x) if x.kind in ("bool", "term") else t.null("boolean")
        return Val("dec", F.coalesce(t.exact(text), F.when(~F.isnan(n.dbl), t.try_cast(n.dbl, t.DECIMAL)), F.when(t.datatype(x.term()) == v.XSD_BOOLEAN, as_bool.cast("int").cast(t.DECIMAL))))
    if iri in (v.XSD_DOUBLE, v.XSD_FLOAT):
        as_bool = t.truth(x) if x.kind in ("bool", "term") else t.null("boolean")
        value = F.coalesce(t.approximate(text), F.when(t.datatype(x.term()) == v.XSD_BOOLEAN, as_bool.cast("int").cast("double")))
        return Val("dbl", value) if iri == v.XSD_DOUBLE else Val("term", t.typed(t.double_text(value.cast("float").cast("double")), iri))
    if iri == v.XSD_DATETIME:
        own = text if x.kind != "date" else F.concat(x.col.cast("string"), F.lit("T00:00:00"))
        return Val("term", F.when(F.try_to_timestamp(own).isNotNull() & own.rlike(r"^-?\d{4,}-\d\d-\d\dT"), t.typed(own, iri)))
    if iri == v.XSD_DATE:
        day = F.substring(text, 1, 10)
        return Val("term", F.when(t.try_cast(day, "date").isNotNull() & text.rlike(r"^\d{4}-\d\d-\d\d"), t.typed(day, iri)))
    raise ValueError(f"unknown function <{iri}>")


CASTS = (v.XSD_STRING, v.XSD_BOOLEAN, v.XSD_INTEGER, v.XSD + "int", v.XSD + "long", v.XSD_DECIMAL, v.XSD_DOUBLE, v.XSD_FLOAT, v.XSD_DATETIME, v.XSD_DATE)

# --- functions ----------------------------------------------------------------


def merge(values: list[Val]) -> tuple[str, list[Column], str]:
    """Values as columns of one kind: their own if all share it, else terms."""
    first = values[0]
    if all(x.kind == first.kind and x.prefix == first.prefix for x in values):
        return first.kind, [x.col for x in values], first.prefix
    return "term", [x.term() for x in values], ""


def _both(f: Callable[[Column, Column], Column]):
    def run(a: Val, b: Val) -> Val:
        (x, _), (y, _) = string_parts(a), string_parts(b)
        return Val("bool", F.when(compatible(a, b), f(x, y)))

    return run


def _map_text(f: Callable[..., Column]):
    def run(a: Val, *rest: Val) -> Val:
        x, s = string_parts(a)
        return with_suffix(f(x, *rest), s, a.kind == "str")

    return run


def _integer(x: Val) -> Column:
    return x.col if x.kind == "int" else t.try_cast(t.number(x).dec, "bigint")


def _substr(x: Column, start: Val, length: Val | None = None) -> Column:
    a = _integer(start)
    b = F.char_length(x) + 1 if length is None else a + _integer(length)
    lo = F.greatest(a, F.lit(1))
    return F.substring(x, lo.cast("int"), F.greatest(b - lo, F.lit(0)).cast("int"))


def _flags(pattern: Column, flags: Val | None) -> Column:
    if flags is None:
        return pattern
    f, _ = string_parts(flags)
    literal = F.concat(F.lit("\\Q"), pattern, F.lit("\\E"))
    inline = F.regexp_replace(f, "[^ismx]", "")
    body = F.when(f.contains("q"), literal).otherwise(pattern)
    return F.when(inline == "", body).otherwise(F.concat(F.lit("(?"), inline, F.lit(")"), body))


def _regex(a: Val, p: Val, flags: Val | None = None) -> Val:
    (x, _), (y, _) = string_parts(a), string_parts(p)
    return Val("bool", F.rlike(x, _flags(y, flags)))


def _replace(a: Val, p: Val, r: Val, flags: Val | None = None) -> Val:
    (x, s), (y, _), (z, _) = string_parts(a), string_parts(p), string_parts(r)
    full = _flags(y, flags)
    return with_suffix(F.when(~F.rlike(F.lit(""), full), F.regexp_replace(x, full, z)), s, a.kind == "str")


def _before(a: Val, b: Val, after: bool) -> Val:
    (x, s), (y, _) = string_parts(a), string_parts(b)
    at = F.call_function("locate", y, x)
    part = F.substring(x, at + F.char_length(y), F.char_length(x)) if after else F.substring(x, F.lit(1), at - 1)
    text = F.when(compatible(a, b), F.when(at > 0, part).otherwise(F.when(x.isNotNull() & y.isNotNull(), "")))
    return with_suffix(text, F.when(at > 0, s).otherwise(""), a.kind == "str")


def _concat(*values: Val) -> Val:
    if not values:
        return Val("str", F.lit(""))
    parts = [string_parts(x) for x in values]
    text = F.concat(*(p for p, _ in parts))
    if all(x.kind == "str" for x in values):
        return Val("str", text)
    same = F.lit(True)
    for _, s in parts[1:]:
        same = same & (s == parts[0][1])
    return with_suffix(text, F.when(same, parts[0][1]).otherwise(""), False)


def _encode(a: Val) -> Val:
    x, _ = string_parts(a)
    safe = F.url_encode(x)
    for old, new in (("+", "%20"), ("%7E", "~"), ("*", "%2A")):
        safe = F.replace(safe, F.lit(old), F.lit(new))
    return Val("str", safe)


def _lang_matches(a: Val, b: Val) -> Val:
    (x, _), (y, _) = string_parts(a), string_parts(b)
    low, want = F.lower(x), F.lower(y)
    return Val("bool", F.when(want == "*", low != "").otherwise((low == want) | F.startswith(low, F.concat(want, F.lit("-")))))


def _hash(bits: int | str):
    def run(a: Val) -> Val:
        x, _ = string_parts(a)
        return Val("str", F.md5(x) if bits == "md5" else F.sha1(x) if bits == "sha1" else F.sha2(x, bits))

    return run


def _stamp(x: Val) -> Column:
    """The written form of a dateTime or date; parts are read from it, so its own time zone counts."""
    if x.kind in ("ts", "date"):
        return t.lex(x.term())
    return F.when(t.explicit_type(x.term()).isin(v.XSD_DATETIME, v.XSD_DATE), t.lex(x.term()))


def _part(pattern: str, kind: str = "int"):
    def run(x: Val) -> Val:
        text = F.regexp_extract(_stamp(x), pattern, 1)
        return Val(kind, t.try_cast(F.when(text != "", text), "bigint" if kind == "int" else t.DECIMAL))

    return run


_ZONE = r"^-?\d{4,}-\d\d-\d\d(?:T[\d:.]+)?(Z|[+-]\d\d:\d\d)?$"


def _tz(x: Val) -> Val:
    return Val("str", F.regexp_extract(_stamp(x), _ZONE, 1))


def _timezone(x: Val) -> Val:
    z = F.regexp_extract(_stamp(x), _ZONE, 1)
    hours, minutes = F.substring(z, 2, 2).try_cast("int"), F.substring(z, 5, 2).try_cast("int")
    text = F.concat(
        F.when(z.startswith("-") & ((hours > 0) | (minutes > 0)), "-").otherwise(""),
        F.lit("PT"),
        F.when(hours > 0, F.concat(hours.cast("string"), F.lit("H"))).otherwise(""),
        F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("M"))).otherwise(F.when(hours > 0, "").otherwise("0S")),
    )
    return Val("term", F.when(z == "Z", t.typed(F.lit("PT0S"), v.XSD_DURATION)).when(z != "", t.typed(text, v.XSD_DURATION)))


def _datatype(x: Val) -> Val:
    known = {"int": v.XSD_INTEGER, "dec": v.XSD_DECIMAL, "dbl": v.XSD_DOUBLE, "bool": v.XSD_BOOLEAN, "str": v.XSD_STRING, "ts": v.XSD_DATETIME, "date": v.XSD_DATE}
    if x.kind in known:
        return Val("iri", F.when(x.col.isNotNull(), known[x.kind]))
    return Val("iri", t.datatype(x.term()) if x.kind == "term" else t.null())


def _is(test: Callable[[Column], Column], *kinds: str):
    def run(x: Val) -> Val:
        return Val("bool", test(x.col) if x.kind == "term" else F.when(x.col.isNotNull(), x.kind in kinds))

    return run


def _is_numeric(x: Val) -> Val:
    if x.kind != "term":
        return Val("bool", F.when(x.col.isNotNull(), x.kind in _NUMERIC))
    return Val("bool", F.when(x.col.isNotNull(), t.rank(x.col).isNotNull() & F.coalesce(t.approximate(t.lex(x.col)).isNotNull(), F.lit(False))))


def _strdt(a: Val, b: Val) -> Val:
    x, s = string_parts(a)
    return Val("term", F.when(s == "", F.concat(F.lit('"'), x, F.lit('"^^'), F.when(t.is_iri(b.term()), b.term()))))


def _strlang(a: Val, b: Val) -> Val:
    (x, s), (y, _) = string_parts(a), string_parts(b)
    return Val("term", F.when((s == "") & (y != ""), F.concat(F.lit('"'), x, F.lit('"@'), F.lower(y))))


def _iri(x: Val, base: str = "") -> Val:
    if x.kind in ("iri", "ref"):
        return Val("iri", x.plain())
    text = F.when(t.is_iri(x.term()), t.text_of(x)).otherwise(string_parts(x)[0])
    if base:
        text = F.when(text.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), text).otherwise(F.concat(F.lit(base.rsplit("/", 1)[0] + "/"), text))
    return Val("iri", text)


FUNCTIONS: dict[str, Callable[..., Val]] = {
    "STR": lambda x: Val("str", t.text_of(x)),
    "LANG": lambda x: Val("str", t.lang(x.term())),
    "LANGMATCHES": _lang_matches,
    "DATATYPE": _datatype,
    "ABS": lambda x: map_number(x, F.abs, F.abs),
    "CEIL": lambda x: map_number(x, F.ceil, lambda d: F.ceil(d).cast("double")),
    "FLOOR": lambda x: map_number(x, F.floor, lambda d: F.floor(d).cast("double")),
    "ROUND": lambda x: map_number(x, lambda d: F.floor(d + F.lit("0.5").cast("decimal(2,1)")), lambda d: F.floor(d + 0.5).cast("double")),
    "NEG": lambda x: arithmetic("-", Val("int", F.lit(0).cast("bigint")), x),
    "POS": lambda x: arithmetic("+", Val("int", F.lit(0).cast("bigint")), x),
    "CONCAT": _concat,
    "STRLEN": lambda x: Val("int", F.char_length(string_parts(x)[0]).cast("bigint")),
    "UCASE": _map_text(F.upper),
    "LCASE": _map_text(F.lower),
    "SUBSTR": _map_text(_substr),
    "ENCODE_FOR_URI": _encode,
    "CONTAINS": _both(F.contains),
    "STRSTARTS": _both(F.startswith),
    "STRENDS": _both(F.endswith),
    "STRBEFORE": lambda x, y: _before(x, y, False),
    "STRAFTER": lambda x, y: _before(x, y, True),
    "YEAR": _part(r"^(-?\d{4,})-"),
    "MONTH": _part(r"^-?\d{4,}-(\d\d)"),
    "DAY": _part(r"^-?\d{4,}-\d\d-(\d\d)"),
    "HOURS": _part(r"T(\d\d):"),
    "MINUTES": _part(r"T\d\d:(\d\d)"),
    "SECONDS": _part(r"T\d\d:\d\d:(\d\d(?:\.\d+)?)", "dec"),
    "TZ": _tz,
    "TIMEZONE": _timezone,
    "MD5": _hash("md5"),
    "SHA1": _hash("sha1"),
    "SHA256": _hash(256),
    "SHA384": _hash(384),
    "SHA512": _hash(512),
    "STRDT": _strdt,
    "STRLANG": _strlang,
    "ISIRI": _is(t.is_iri, "iri", "ref"),
    "ISURI": _is(t.is_iri, "iri", "ref"),
    "ISBLANK": _is(t.is_blank),
    "ISLITERAL": _is(t.is_literal, "int", "dec", "dbl", "bool", "str", "ts", "date"),
    "ISNUMERIC": _is_numeric,
    "SAMETERM": lambda x, y: Val("bool", x.term() == y.term()),
    "REGEX": _regex,
    "REPLACE": _replace,
    "RAND": lambda: Val("dbl", F.rand()),
    "UUID": lambda: Val("iri", F.concat(F.lit("urn:uuid:"), F.uuid())),
    "STRUUID": lambda: Val("str", F.uuid()),
    "=": lambda x, y: Val("bool", equal(x, y)),
    "!=": lambda x, y: Val("bool", ~equal(x, y)),
    "<": lambda x, y: Val("bool", less(x, y, lambda p, q: p < q)),
    ">": lambda x, y: Val("bool", less(x, y, lambda p, q: p > q)),
    "<=": lambda x, y: Val("bool", less(x, y, lambda p, q: p <= q)),
    ">=": lambda x, y: Val("bool", less(x, y, lambda p, q: p >= q)),
    "+": lambda x, y: arithmetic("+", x, y),
    "-": lambda x, y: arithmetic("-", x, y),
    "*": lambda x, y: arithmetic("*", x, y),
    "/": lambda x, y: arithmetic("/", x, y),
    "!": lambda x: Val("bool", ~t.truth(x)),
    "&&": lambda x, y: Val("bool", t.truth(x) & t.truth(y)),
    "||": lambda x, y: Val("bool", t.truth(x) | t.truth(y)),
}

#: Functions that users add: IRI -> (Val, ...) -> Val.
CUSTOM: dict[str, Callable[..., Val]] = {}


def register(iri: str, function: Callable[..., Val]) -> None:
    """Make ``<iri>(...)`` callable in queries; the function builds a column, so it runs inside the plan."""
    CUSTOM[iri] = function
