"""Datasets that patterns are matched against: quads, or tables with a mapping to triples."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom import vocab as v
from quadloom.functions import scalars
from quadloom.functions.terms import Val
from quadloom.plans import algebra as a
from quadloom.plans import relation as r
from quadloom.plans.relation import Info, Rel


@dataclass(frozen=True)
class Scope:
    """The active graph: '' is the default graph, a term a named one, a Var ranges over the named ones."""

    graph: object = ""
    from_graphs: tuple[str, ...] = ()
    from_named: tuple[str, ...] = ()


QUADS = "s string, p string, o string, g string"


class Dataset:
    """Quads (s, p, o, g) as terms, g '' for the default graph, and the registry of named graphs (g)."""

    spark: SparkSession

    def quads(self) -> DataFrame:
        raise NotImplementedError

    def graphs(self) -> DataFrame:
        return self.quads().select("g").where("g <> ''").distinct()

    def active(self, scope: Scope) -> DataFrame:
        """The triples of the active graph; with a g column where a variable ranges over graphs."""
        q = self.quads()
        if isinstance(scope.graph, a.Var):
            q = q.where(F.col("g") != "")
            return q.where(F.col("g").isin([f"<{x}>" for x in scope.from_named])) if scope.from_graphs or scope.from_named else q
        if scope.graph != "":
            listed = not (scope.from_graphs or scope.from_named) or scope.graph[1:-1] in scope.from_named
            return q.where(F.col("g") == scope.graph).select("s", "p", "o") if listed else q.limit(0).select("s", "p", "o")
        if scope.from_graphs or scope.from_named:
            return q.where(F.col("g").isin([f"<{x}>" for x in scope.from_graphs])).select("s", "p", "o").distinct()
        return q.where(F.col("g") == "").select("s", "p", "o")

    def match(self, pattern: a.Triple, scope: Scope) -> Rel:
        """One triple pattern over the active graph's terms."""
        df = self.active(scope)
        out: dict[str, Info] = {}
        picked: list[Column] = []
        columns = [("s", pattern.s), ("p", pattern.p), ("o", pattern.o)]
        if isinstance(scope.graph, a.Var):
            columns.append(("g", scope.graph))
        seen: dict[str, str] = {}
        for c, node in columns:
            if isinstance(node, a.Const):
                df = df.where(F.col(c) == node.term)
            elif node.name in seen:
                df = df.where(F.col(c) == F.col(seen[node.name]))
            else:
                seen[node.name] = c
                out[node.name] = Info(r.fresh(node.name), "term")
                picked.append(F.col(c).alias(out[node.name].column))
        return Rel(df.select(*picked) if picked else df.select(F.lit(1).alias("_u")), out)

    def basic(self, triples: tuple[a.Triple, ...], scope: Scope) -> Rel:
        """All patterns joined: the most selective first, then always one that shares a variable if there is one."""
        return chain([(t_, lambda t_=t_: self.match(t_, scope)) for t_ in triples], cost)


def cost(pattern: a.Triple, bound: set[str]) -> int:
    free = lambda n: isinstance(n, a.Var) and n.name not in bound
    kind = 2 * free(pattern.s) + 2 * free(pattern.o) + 4 * free(pattern.p)
    common = isinstance(pattern.p, a.Const) and pattern.p.term == f"<{v.TYPE}>" and free(pattern.o)
    return kind + common


def names_of(pattern: a.Triple) -> set[str]:
    return {x.name for x in (pattern.s, pattern.p, pattern.o) if isinstance(x, a.Var)}


def chain(parts: list, price) -> Rel:
    left, bound, out = list(parts), set(), None
    while left:
        linked = [x for x in left if names_of(x[0]) & bound] if bound else left
        best = min(linked or left, key=lambda x: price(x[0], bound))
        left.remove(best)
        rel = best[1]()
        out = rel if out is None else r.join(out, rel)
        bound |= names_of(best[0])
    return out


class QuadDataset(Dataset):
    """Quads and named graphs as DataFrames."""

    def __init__(self, quads: DataFrame, graphs: DataFrame | None = None) -> None:
        self.spark = quads.sparkSession
        self._quads = quads.select("s", "p", "o", "g")
        self._graphs = graphs

    def quads(self) -> DataFrame:
        return self._quads

    def graphs(self) -> DataFrame:
        own = super().graphs()
        return own if self._graphs is None else own.union(self._graphs.select("g")).distinct()


@dataclass
class Table:
    """How a table's rows are triples: the subject is prefix + key; columns are predicates."""

    df: DataFrame
    prefix: str
    key: Column
    type: str
    columns: dict[str, tuple[str, str, str]] = field(default_factory=dict)  # predicate IRI -> (column, kind, prefix for ref)

    def value(self, predicate: str) -> Val:
        column, kind, prefix = self.columns[predicate]
        return Val(kind, F.col(column), prefix)


_KINDS = {"tinyint": "int", "smallint": "int", "int": "int", "bigint": "int", "double": "dbl", "float": "dbl", "string": "str", "boolean": "bool", "timestamp": "ts", "timestamp_ntz": "ts", "date": "date"}


def table(df: DataFrame, base: str, name: str, key: str | Column | None, links: dict[str, str] | None = None, skip: tuple[str, ...] = ()) -> Table:
    """The usual mapping: one predicate for each column, links (column -> table) as IRIs, the whole row's hash where there is no key."""
    links = links or {}
    columns = {}
    for column, kind in df.dtypes:
        if column in skip:
            continue
        if column in links:
            columns[f"{base}{column}"] = (column, "ref", f"{base}{links[column]}/")
        elif kind in _KINDS or kind.startswith("decimal"):
            columns[f"{base}{column}"] = (column, _KINDS.get(kind, "dec"), "")
    whole = [F.col(c) for c in sorted(df.columns)]
    return Table(df, f"{base}{name}/", F.col(key) if isinstance(key, str) else F.xxhash64(*whole) if key is None else key, f"{base}{name.capitalize()}", columns)


class MappedDataset(Dataset):
    """Tables seen as triples.

    Patterns that share a subject and have known predicates become one scan of
    the table (no self-joins), with typed columns, so that projections and
    filters reach Parquet.  Patterns with a variable predicate read the triples
    of all tables.
    """

    def __init__(self, tables: list[Table]) -> None:
        self.tables = tables
        self.spark = tables[0].df.sparkSession

    def quads(self) -> DataFrame:
        out = None
        for tb in self.tables:
            s = Val("ref", F.col("_key"), tb.prefix).term()
            rows = [F.struct(F.lit(f"<{v.TYPE}>").alias("p"), F.lit(f"<{tb.type}>").alias("o"))]
            rows += [F.struct(F.lit(f"<{p}>").alias("p"), tb.value(p).term().alias("o")) for p in tb.columns]
            one = tb.df.withColumn("_key", tb.key).select(s.alias("s"), F.explode(F.array(*rows)).alias("x")).select("s", "x.p", "x.o", F.lit("").alias("g")).where("s is not null and o is not null")
            out = one if out is None else out.union(one)
        return out

    def graphs(self) -> DataFrame:
        return self.spark.createDataFrame([], "g string")

    def basic(self, triples: tuple[a.Triple, ...], scope: Scope) -> Rel:
        if scope.graph != "" or scope.from_graphs or scope.from_named:
            return super().basic(triples, scope)
        stars: dict[object, list[a.Triple]] = {}
        loose: list[a.Triple] = []
        for p in triples:
            (stars.setdefault(p.s, []) if isinstance(p.p, a.Const) else loose).append(p)
        parts = []
        for s, some in stars.items():
            names = set().union(*(names_of(x) for x in some))
            parts.append((_Group(names, sum(isinstance(x.o, a.Const) for x in some)), lambda s=s, some=some: self.star(s, some)))
        parts += [(_Group(names_of(p), -3), lambda p=p: self.match(p, scope)) for p in loose]
        return _chain_groups(parts)

    def star(self, subject: a.Node, triples: list[a.Triple]) -> Rel:
        out = None
        for tb in self.tables:
            if all(p.p.term == f"<{v.TYPE}>" or p.p.term[1:-1] in tb.columns for p in triples):
                one = self.star_on(tb, subject, triples)
                if one is not None:
                    out = one if out is None else r.union(out, one)
        if out is None:
            names = dict.fromkeys(n for p in [a.Triple(subject, subject, subject), *triples] for n in sorted(names_of(p)))
            cols = {n: Info(r.fresh(n), "term") for n in names}
            return Rel(self.spark.createDataFrame([], ", ".join(f"{i.column} string" for i in cols.values()) or "_u int"), cols)
        return out

    def star_on(self, tb: Table, subject: a.Node, triples: list[a.Triple]) -> Rel | None:
        df, out, picked = tb.df, {}, []
        key = Val("ref", tb.key, tb.prefix)

        def bind(name: str, value: Val) -> None:
            nonlocal df
            if name in out:
                i, known = out[name]
                df = df.where(scalars.equal(known, value) if known.kind in ("iri", "ref") else known.term() == value.term())
            else:
                out[name] = (Info(r.fresh(name), value.kind, value.prefix), value)

        if isinstance(subject, a.Const):
            own = subject.term[1:-1]
            if not own.startswith(tb.prefix):
                return None
            df = df.where(tb.key.cast("string") == own[len(tb.prefix) :])
        else:
            bind(subject.name, key)
        for p in triples:
            if p.p.term == f"<{v.TYPE}>":
                if isinstance(p.o, a.Const):
                    if p.o.term != f"<{tb.type}>":
                        return None
                else:
                    bind(p.o.name, Val("iri", F.lit(tb.type)))
                continue
            value = tb.value(p.p.term[1:-1])
            df = df.where(value.col.isNotNull())
            if isinstance(p.o, a.Const):
                df = df.where(_is_constant(value, p.o.term))
            else:
                bind(p.o.name, value)
        picked = [value.col.alias(i.column) for i, value in out.values()]
        return Rel(df.select(*picked) if picked else df.select(F.lit(1).alias("_u")), {n: i for n, (i, _) in out.items()})


def _is_constant(value: Val, term: str) -> Column:
    """The column is the term; a comparison that Parquet can use where there is one."""
    if value.kind == "ref":
        own = term[1:-1]
        if not term.startswith("<") or not own.startswith(value.prefix):
            return F.lit(False)
        rest = own[len(value.prefix) :]
        return value.col == int(rest) if rest.lstrip("-").isdigit() else value.col.cast("string") == rest
    c = scalars.const(term)
    if c.kind == value.kind and c.kind in ("str", "int", "bool"):
        return value.col == c.col
    return value.term() == term


@dataclass(frozen=True)
class _Group:
    names: frozenset | set
    constants: int


def _chain_groups(parts: list) -> Rel:
    left, bound, out = list(parts), set(), None
    while left:
        linked = [x for x in left if x[0].names & bound] if bound else left
        best = max(linked or left, key=lambda x: (x[0].constants, -len(x[0].names)))
        left.remove(best)
        rel = best[1]()
        out = rel if out is None else r.join(out, rel)
        bound |= set(best[0].names)
    return out


__all__ = ["Dataset", "MappedDataset", "QuadDataset", "Scope", "Table", "table"]
