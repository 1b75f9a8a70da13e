"""SPARQL aggregates: an error in a group makes SUM, AVG and the order of MIN and MAX unbound, COUNT counts what is bound."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadloom.functions import terms as t
from quadloom.functions.terms import Val


def aggregate(name: str, x: Val | None, distinct: bool, separator: str, row: list[Column]) -> Val:
    """One aggregate as a value over a group; ``row``: all columns, for COUNT(DISTINCT *)."""
    if name == "COUNT":
        if x is None:
            return Val("int", F.count_distinct(F.struct(*row)) if distinct and row else F.count(F.lit(1)))
        return Val("int", F.count_distinct(x.col) if distinct else F.count(x.col))
    if name == "SAMPLE":
        return Val(x.kind, F.min(x.col), x.prefix)
    if name in ("MIN", "MAX"):
        if x.kind != "term":
            return Val(x.kind, (F.min if name == "MIN" else F.max)(x.col), x.prefix)
        keys = F.struct(*(k.alias(f"k{i}") for i, k in enumerate(t.order_keys(x))))
        bound = F.when(x.col.isNotNull(), keys)
        return Val("term", (F.min_by if name == "MIN" else F.max_by)(x.col, bound))
    if name == "GROUP_CONCAT":
        text = t.text_of(x) if x.kind != "str" else x.col
        collected = F.sort_array(F.collect_set(text) if distinct else F.collect_list(text))
        return Val("str", F.array_join(collected, separator))
    if x.kind == "int":
        total = (F.sum_distinct if distinct else F.sum)(x.col)
        if name == "SUM":
            return Val("int", F.coalesce(total, F.lit(0).cast("bigint")))
        n = F.count_distinct(x.col) if distinct else F.count(x.col)
        return Val("dec", F.coalesce(t.try_cast(F.try_divide(total.cast("decimal(28,10)"), n.cast("decimal(20,0)")), t.DECIMAL), F.lit(0).cast(t.DECIMAL)))
    n = t.number(x)
    ok = n.dbl.isNotNull() if x.kind != "term" else (n.rank.isNotNull() & (n.dec.isNotNull() | (n.rank > 1)))
    bad = F.count_if(x.col.isNotNull() & ~F.coalesce(ok, F.lit(False))) > 0
    fold = F.sum_distinct if distinct else F.sum
    count = F.count_distinct(x.col) if distinct else F.count(x.col)
    exact = t.try_cast(F.coalesce(fold(t.try_cast(n.dec, "decimal(28,10)")), F.lit(0)), t.DECIMAL)
    loose = F.coalesce(fold(n.dbl), F.lit(0.0))
    if name == "AVG":
        exact = F.coalesce(t.try_cast(F.try_divide(t.try_cast(exact, "decimal(28,10)"), count.cast("decimal(20,0)")), t.DECIMAL), F.lit(0).cast(t.DECIMAL))
        loose = F.coalesce(F.try_divide(loose, count.cast("double")), F.lit(0.0))
    if x.kind == "dec":
        return Val("dec", exact)
    if x.kind == "dbl":
        return Val("dbl", loose)
    rank = F.greatest(F.coalesce(F.max(n.rank), F.lit(0)), F.lit(1 if name == "AVG" else 0))
    rank = F.when(count == 0, 0).otherwise(rank)
    value = t.Num(rank, exact, loose).value()
    return Val("term", F.when(~bad, value.col))


