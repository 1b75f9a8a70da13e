"""Solutions as a DataFrame: one column for each variable, with what is known of it."""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.functions import terms as t
from quadloom.functions.terms import Val

_counter = itertools.count()


def fresh(name: str = "c") -> str:
    return f"_{re.sub(r'[^A-Za-z0-9]', '_', name)}_{next(_counter)}"


@dataclass(frozen=True)
class Info:
    """Where a variable is, its kind, and whether it may be unbound."""

    column: str
    kind: str
    prefix: str = ""
    maybe: bool = False


@dataclass(frozen=True)
class Rel:
    df: DataFrame
    vars: dict[str, Info] = field(default_factory=dict)

    def val(self, name: str) -> Val:
        i = self.vars[name]
        return Val(i.kind, F.col(i.column), i.prefix)

    def with_val(self, name: str, value: Val, maybe: bool = True) -> Rel:
        column = fresh(name)
        return Rel(self.df.withColumn(column, value.col), self.vars | {name: Info(column, value.kind, value.prefix, maybe)})

    def keep(self, names) -> Rel:
        own = {n: self.vars[n] for n in names if n in self.vars}
        return Rel(self.df.select(*dict.fromkeys(i.column for i in own.values())), own)

    def renamed(self) -> Rel:
        """The same solutions under new column names, so that a relation can meet itself."""
        names = {i.column: fresh(n) for n, i in self.vars.items()}
        return Rel(self.df.select(*(F.col(a).alias(b) for a, b in names.items())), {n: replace(i, column=names[i.column]) for n, i in self.vars.items()})

    def as_terms(self, names) -> Rel:
        out = {n: Info(fresh(n), "term", "", self.vars[n].maybe) for n in names}
        return Rel(self.df.select("*", *(self.val(n).term().alias(i.column) for n, i in out.items())), self.vars | out)


def align(a: Rel, b: Rel, names) -> tuple[Rel, Rel]:
    """Both relations with the named variables in kinds whose columns can be compared directly."""
    odd = [n for n in names if not t.same_kind(a.val(n), b.val(n))]
    iris = [n for n in odd if {a.vars[n].kind, b.vars[n].kind} <= {"iri", "ref"}]
    for n in iris:
        a = a.with_val(n, Val("iri", a.val(n).plain()), a.vars[n].maybe)
        b = b.with_val(n, Val("iri", b.val(n).plain()), b.vars[n].maybe)
    rest = [n for n in odd if n not in iris]
    return a.as_terms(rest), b.as_terms(rest)


def meets(a: Rel, b: Rel, names) -> Column | None:
    """The solutions agree: equal where both are bound."""
    out = None
    for n in names:
        x, y = F.col(a.vars[n].column), F.col(b.vars[n].column)
        one = x == y
        if a.vars[n].maybe:
            one = one | x.isNull()
        if b.vars[n].maybe:
            one = one | y.isNull()
        out = one if out is None else out & one
    return out


#: Shared variables that may be unbound, up to which both sides are split by what is bound, so that every join has equal keys.
SPLIT = 2


def split(rel: Rel, names: list[str]) -> list[tuple[set[str], DataFrame]]:
    """The relation in parts by which of the named variables are bound: (unbound ones, rows)."""
    parts = [(set(), rel.df)]
    for n in names:
        if rel.vars[n].maybe:
            c = F.col(rel.vars[n].column)
            parts = [(free | extra, df.where(c.isNull() if extra else c.isNotNull())) for free, df in parts for extra in (set(), {n})]
    return parts


def matched(left: DataFrame, right: DataFrame, on: Column | None, how: str) -> DataFrame:
    if on is None:
        return left.crossJoin(right) if how == "inner" else left.join(right, F.lit(True), how)
    return left.join(right, on, how)


def parted(a: Rel, b: Rel, shared: list[str], loose: list[str], how: str, extra: Column | None = None, real: list[str] | None = None) -> DataFrame:
    """The join as a union over what is bound on either side.

    ``inner`` and ``left`` give the columns of both, ``left_semi`` and ``left_anti`` those of a.
    real: variables of which one at least must be bound on both sides, for MINUS.
    """
    rights = split(b, loose)
    pieces: list[DataFrame] = []
    for free, rows in split(a, loose):
        tests = []
        for other, found in rights:
            keys = [n for n in shared if n not in free | other]
            if real is not None and not set(keys) & set(real):
                continue
            on = extra
            for n in keys:
                one = F.col(a.vars[n].column) == F.col(b.vars[n].column)
                on = one if on is None else on & one
            tests.append((found, on))
        if how in ("inner", "left"):
            pieces += [matched(rows, found, on, "inner").select(*a.df.columns, *b.df.columns) for found, on in tests]
        rest = rows
        for found, on in tests:
            if how == "left_semi":
                pieces.append(matched(rest, found, on, "left_semi"))
            if how != "inner":
                rest = matched(rest, found, on, "left_anti")
        if how == "left_anti":
            pieces.append(rest)
        if how == "left":
            pieces.append(rest.select(*a.df.columns, *(F.lit(None).cast(f.dataType).alias(f.name) for f in b.df.schema)))
    out = pieces[0]
    for x in pieces[1:]:
        out = out.union(x)
    return out


def _loose(a: Rel, b: Rel, shared) -> list[str]:
    return [n for n in shared if a.vars[n].maybe or b.vars[n].maybe]


def join(a: Rel, b: Rel, how: str = "inner", condition=None) -> Rel:
    """Natural join on shared variables; ``condition``: a function of the joined relation to a Boolean column."""
    shared = [n for n in a.vars if n in b.vars]
    a, b = align(a, b.renamed(), shared)
    on = meets(a, b, shared)
    out = dict(a.vars)
    merged: list[tuple[str, Info, Column]] = []
    for n, i in b.vars.items():
        if n not in a.vars:
            out[n] = replace(i, maybe=i.maybe or how == "left")
        elif a.vars[n].maybe:
            info = Info(fresh(n), i.kind, i.prefix, i.maybe or how == "left")
            merged.append((n, info, F.coalesce(F.col(a.vars[n].column), F.col(i.column))))
    if condition is not None:
        whole = {**b.vars, **a.vars}
        extra = condition(Rel(a.df, whole))
        on = extra if on is None else on & extra
    loose = _loose(a, b, shared)
    df = parted(a, b, shared, loose, how, extra if condition is not None else None) if 0 < len(loose) <= SPLIT else matched(a.df, b.df, on, how)
    if merged:
        df = df.select("*", *(c.alias(i.column) for _, i, c in merged))
        out |= {n: i for n, i, _ in merged}
    return Rel(df.select(*dict.fromkeys(i.column for i in out.values())), out)


def union(a: Rel, b: Rel) -> Rel:
    shared = [n for n in a.vars if n in b.vars]
    a, b = align(a, b, shared)
    out, left, right = {}, [], []
    for n in dict.fromkeys([*a.vars, *b.vars]):
        i = a.vars.get(n) or b.vars[n]
        column = fresh(n)
        here, there = a.vars.get(n), b.vars.get(n)
        out[n] = Info(column, i.kind, i.prefix, not (here and there) or here.maybe or there.maybe)
        other = F.lit(None)
        left.append((F.col(here.column) if here else other.cast(b.df.schema[i.column].dataType)).alias(column))
        right.append((F.col(there.column) if there else other.cast(a.df.schema[i.column].dataType)).alias(column))
    if not out:
        return Rel(a.df.select(F.lit(1).alias("_u")).union(b.df.select(F.lit(1).alias("_u"))), {})
    return Rel(a.df.select(*left).union(b.df.select(*right)), out)


def semi(a: Rel, b: Rel, how: str, condition=None) -> Rel:
    """Solutions of a that meet (left_semi) or do not meet (left_anti) one of b."""
    shared = [n for n in a.vars if n in b.vars]
    a, c = align(a, b.renamed(), shared)
    on = meets(a, c, shared)
    if condition is not None:
        extra = condition(Rel(a.df, {**c.vars, **a.vars}))
        on = extra if on is None else on & extra
    loose = _loose(a, c, shared)
    if 0 < len(loose) <= SPLIT:
        return Rel(parted(a, c, shared, loose, how, extra if condition is not None else None), a.vars)
    return Rel(matched(a.df, c.df, on, how), a.vars)


def minus(a: Rel, b: Rel) -> Rel:
    """Solutions of a without those that meet one of b in a variable that both bind; names with a dot are no variables of the query."""
    shared = [n for n in a.vars if n in b.vars]
    real = [n for n in shared if not n.startswith(".")]
    if not real:
        return a
    a, c = align(a, b.renamed(), shared)
    loose = _loose(a, c, shared)
    if 0 < len(loose) <= SPLIT:
        return Rel(parted(a, c, shared, loose, "left_anti", real=real), a.vars)
    on = meets(a, c, shared)
    if all(a.vars[n].maybe or c.vars[n].maybe for n in real):
        both = F.lit(False)
        for n in real:
            both = both | (F.col(a.vars[n].column).isNotNull() & F.col(c.vars[n].column).isNotNull())
        on = on & both
    return Rel(a.df.join(c.df, on, "left_anti"), a.vars)
