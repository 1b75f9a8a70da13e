"""Updates as functions from one state of a dataset to the next; a state is never changed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.plans import algebra as a
from quadloom.plans.compiler import Compiler
from quadloom.plans.parser import parse_update
from quadloom.sources import rdf
from quadloom.sources.dataset import QuadDataset, Scope

KEYS = ["s", "p", "o", "g"]


class GraphError(ValueError):
    """A graph operation that the registry does not allow."""


@dataclass(frozen=True)
class State:
    """All quads, and the named graphs, which may be empty."""

    quads: DataFrame
    graphs: DataFrame

    @classmethod
    def empty(cls, spark) -> State:
        return cls(spark.createDataFrame([], rdf.QUADS), spark.createDataFrame([], "g string"))

    def dataset(self) -> QuadDataset:
        return QuadDataset(self.quads, self.graphs)

    def has_graph(self, g: str) -> bool:
        return not self.graphs.where(F.col("g") == g).isEmpty()

    def inserted(self, rows: DataFrame) -> State:
        quads = self.quads.select(*KEYS).union(rows.select(*KEYS)).distinct()
        graphs = self.graphs.union(rows.select("g").where("g <> ''")).distinct()
        return State(quads, graphs)

    def deleted(self, rows: DataFrame) -> State:
        return State(self.quads.join(rows.select(*KEYS).distinct(), KEYS, "left_anti").select(*KEYS), self.graphs)

    def cleared(self, g: str, drop: bool = False) -> State:
        return State(self.quads.where(F.col("g") != g), self.graphs.where(F.col("g") != g) if drop else self.graphs)

    def replaced(self, g: str, triples: DataFrame) -> State:
        out = self.cleared(g).inserted(triples.withColumn("g", F.lit(g)))
        return out if g == "" else State(out.quads, out.graphs.union(out.graphs.sparkSession.createDataFrame([(g,)], "g string")).distinct())

    def registered(self, g: str) -> State:
        return State(self.quads, self.graphs.union(self.graphs.sparkSession.createDataFrame([(g,)], "g string")).distinct())


def _data(state: State, quads: a.Quads) -> DataFrame:
    rows = [(t.s.term, t.p.term, t.o.term, g) for g, triples in quads.parts for t in triples]
    return state.quads.sparkSession.createDataFrame(rows, rdf.QUADS)


def apply_one(state: State, op, base: str = "") -> State:
    match op:
        case a.InsertData(quads):
            return state.inserted(_data(state, quads))
        case a.DeleteData(quads):
            return state.deleted(_data(state, quads))
        case a.Modify():
            return _modify(state, op, base)
        case a.Manage(kind, target, silent):
            return _manage(state, kind, target, silent)
        case a.Transfer(kind, source, target, silent):
            return _transfer(state, kind, source, target, silent)
        case a.Load(source, target, silent):
            if source.startswith(("http:", "https:", "ftp:")):
                if silent:
                    return state
                raise ValueError(f"LOAD of {source}: only files can be read")
            rows = rdf.read(state.quads.sparkSession, source, graph=target[1:-1])
            return state.inserted(rows)
    raise ValueError(op)


def _modify(state: State, op: a.Modify, base: str) -> State:
    """Both templates see the solutions over the old state; deletions come first."""
    dataset = state.dataset()
    scope = Scope(op.with_graph or "") if not (op.using or op.using_named) else Scope("", tuple(op.using), tuple(op.using_named))
    compiler = Compiler(dataset, base)
    rel = compiler.pattern(op.pattern, scope)

    def parts(quads: a.Quads | None) -> list:
        return [(op.with_graph or "" if g == "" else g, triples) for g, triples in quads.parts] if quads else []

    if op.delete is not None and op.insert is not None:
        from quadloom.session import written

        rel = type(rel)(written(rel.df, "solutions"), rel.vars)
    out = state
    if op.delete is not None:
        cut = []
        for g, triples in parts(op.delete):
            # in DELETE WHERE a blank node is a variable of the pattern
            name = lambda x: a.Var(".b." + x.term[2:]) if isinstance(x, a.Const) and x.term.startswith("_:") else x
            cut.append((g, [a.Triple(name(t.s), name(t.p), name(t.o)) for t in triples]))
        out = out.deleted(compiler.instantiate(rel, cut))
    if op.insert is not None:
        out = out.inserted(compiler.instantiate(rel, parts(op.insert)))
    return out


def _manage(state: State, kind: str, target: str, silent: bool) -> State:
    if kind == "CREATE":
        if state.has_graph(target):
            if silent:
                return state
            raise GraphError(f"{target} exists")
        return state.registered(target)
    drop = kind == "DROP"
    if target == "DEFAULT":
        return state.cleared("")
    none = state.graphs.limit(0)
    if target == "NAMED":
        return State(state.quads.where("g = ''"), none if drop else state.graphs)
    if target == "ALL":
        return State(state.quads.limit(0), none if drop else state.graphs)
    if not state.has_graph(target):
        if silent:
            return state
        raise GraphError(f"{target} does not exist")
    return state.cleared(target, drop)


def _transfer(state: State, kind: str, source: str, target: str, silent: bool) -> State:
    if source and not state.has_graph(source):
        if silent:
            return state
        raise GraphError(f"{source} does not exist")
    if source == target:
        return state
    rows = state.quads.where(F.col("g") == source).select("s", "p", "o")
    out = state.inserted(rows.withColumn("g", F.lit(target))) if kind == "ADD" else state.replaced(target, rows)
    if target:
        out = out.registered(target)
    return out.cleared(source, drop=bool(source)) if kind == "MOVE" else out


def apply(state: State, text: str, base: str = "") -> State:
    """All operations of an update, one after another; a syntax error comes before any of them runs."""
    for op in parse_update(text, base):
        state = apply_one(state, op, base)
    return state
