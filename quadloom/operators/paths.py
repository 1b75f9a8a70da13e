"""Property paths as relations of two columns (s, o) of terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.operators.closure import reachable, transitive_closure
from quadloom.plans import algebra as a
from quadloom.plans.relation import Info, Rel, fresh
from quadloom.sources.dataset import Dataset, Scope


def pairs(dataset: Dataset, path, scope: Scope) -> DataFrame:
    """(s, o) of a path, a row for each way, except for the repeating forms, which are sets."""
    match path:
        case a.Link(iri):
            rel = dataset.basic((a.Triple(a.Var("s"), a.Const(f"<{iri}>"), a.Var("o")),), scope)
            return rel.df.select(rel.val("s").term().alias("s"), rel.val("o").term().alias("o"))
        case a.Inverse(inner):
            return pairs(dataset, inner, scope).select(F.col("o").alias("s"), F.col("s").alias("o"))
        case a.Seq(left, right):
            first = pairs(dataset, left, scope).select("s", F.col("o").alias("m"))
            return first.join(pairs(dataset, right, scope).select(F.col("s").alias("m"), "o"), "m").select("s", "o")
        case a.Alt(left, right):
            return pairs(dataset, left, scope).union(pairs(dataset, right, scope))
        case a.Negated(forward, backward):
            triples = dataset.active(scope)
            out = None
            if forward or not backward:
                out = triples.where(~F.col("p").isin([f"<{x}>" for x in forward])).select("s", "o")
            if backward:
                back = triples.where(~F.col("p").isin([f"<{x}>" for x in backward])).select(F.col("o").alias("s"), F.col("s").alias("o"))
                out = back if out is None else out.union(back)
            return out
        case a.Repeat(inner, least, many):
            steps = pairs(dataset, inner, scope)
            steps = transitive_closure(steps) if many else steps.distinct()
            return steps.union(nodes(dataset, scope)).distinct() if least == 0 else steps
    raise ValueError(path)


def nodes(dataset: Dataset, scope: Scope) -> DataFrame:
    """(n, n) for every subject and object of the active graph."""
    triples = dataset.active(scope)
    own = triples.select(F.col("s").alias("s")).union(triples.select("o")).distinct()
    return own.select("s", F.col("s").alias("o"))


def match_path(dataset: Dataset, pattern: a.PathPattern, scope: Scope) -> Rel:
    """A path pattern as a relation; from a constant end only what it reaches is computed."""
    s, path, o = pattern.s, pattern.path, pattern.o
    if isinstance(path, a.Repeat) and path.many and (isinstance(s, a.Const) or isinstance(o, a.Const)):
        forward = isinstance(s, a.Const)
        start = s if forward else o
        steps = pairs(dataset, path.path if forward else a.Inverse(path.path), scope)
        seed = dataset.spark.createDataFrame([(start.term,)], "n string")
        first = steps.join(seed.withColumnRenamed("n", "s"), "s").select(F.col("o").alias("n"))
        found = reachable(steps, seed if path.least == 0 else first)
        df = found.select(F.lit(start.term).alias("s"), F.col("n").alias("o"))
        df = df if forward else df.select(F.col("o").alias("s"), F.col("s").alias("o"))
    elif isinstance(path, a.Repeat) and path.least == 0 and (isinstance(s, a.Const) or isinstance(o, a.Const)):
        here = {x.term for x in (s, o) if isinstance(x, a.Const)}
        zero = dataset.spark.createDataFrame([(x, x) for x in here], "s string, o string")
        df = pairs(dataset, path.path, scope).distinct().union(zero).distinct()
    else:
        df = pairs(dataset, path, scope)
    for column, node in (("s", s), ("o", o)):
        if isinstance(node, a.Const):
            df = df.where(F.col(column) == node.term)
    if isinstance(s, a.Var) and isinstance(o, a.Var) and s.name == o.name:
        df = df.where("s = o")
    out = {}
    picked = []
    for column, node in (("s", s), ("o", o)):
        if isinstance(node, a.Var) and node.name not in out:
            out[node.name] = Info(fresh(node.name), "term")
            picked.append(F.col(column).alias(out[node.name].column))
    return Rel(df.select(*picked) if picked else df.select(F.lit(1).alias("_u")), out)
