"""Algebra to DataFrames: Catalyst sees plain equi-joins, filters and aggregates."""

from __future__ import annotations

import datetime
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadloom import vocab as v
from quadloom.functions import scalars
from quadloom.functions import terms as t
from quadloom.functions.aggregates import aggregate
from quadloom.functions.terms import Val
from quadloom.operators.paths import match_path
from quadloom.plans import algebra as a
from quadloom.plans import relation as r
from quadloom.plans.parser import UnsupportedError, parse_query
from quadloom.plans.relation import Info, Rel
from quadloom.session import written
from quadloom.sources.dataset import Dataset, QuadDataset, Scope

#: Graphs whose plans are put together at once where a pattern has to be matched graph by graph.
GRAPHS_AT_ONCE = 50


class Compiler:
    def __init__(self, dataset: Dataset, base: str = "") -> None:
        self.dataset = dataset
        self.spark = dataset.spark
        self.base = base
        self.now = datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ")

    # -- patterns --------------------------------------------------------------
    def unit(self) -> Rel:
        return Rel(self.spark.range(1).select(F.lit(1).alias("_u")), {})

    def pattern(self, node, scope: Scope) -> Rel:
        match node:
            case a.Unit():
                return self.named(scope) if isinstance(scope.graph, a.Var) else self.unit()
            case a.Bgp(triples):
                return self.dataset.basic(triples, scope)
            case a.PathPattern():
                return self.path_in_graphs(node, scope) if isinstance(scope.graph, a.Var) else match_path(self.dataset, node, scope)
            case a.Join(left, right):
                return r.join(self.pattern(left, scope), self.pattern(right, scope))
            case a.LeftJoin(left, right, condition):
                x, y = self.pattern(left, scope), self.pattern(right, scope)
                test = None if condition is None else lambda rel: F.coalesce(t.truth(self.expr(condition, rel, scope)[0]), F.lit(False))
                return r.join(x, y, "left", test)
            case a.Union(left, right):
                return r.union(self.pattern(left, scope), self.pattern(right, scope))
            case a.Minus(left, right):
                return r.minus(self.pattern(left, scope), self.pattern(right, scope))
            case a.Filter(condition, inner):
                return self.filter(self.pattern(inner, scope), condition, scope)
            case a.Graph(name, inner):
                graph = name.term if isinstance(name, a.Const) else name
                if isinstance(name, a.Var) and isinstance(inner, a.Unit):
                    df = self.dataset.graphs()
                    column = r.fresh(name.name)
                    return Rel(df.select(F.col("g").alias(column)), {name.name: Info(column, "term")})
                if isinstance(name, a.Var) and not isinstance(inner, a.Bgp):
                    return self.in_graphs(inner, replace(scope, graph=name)) if carries_graph(inner) else self.each_graph(inner, replace(scope, graph=name))
                return self.pattern(inner, replace(scope, graph=graph))
            case a.Extend(inner, name, expression):
                value, rel = self.expr(expression, self.pattern(inner, scope), scope)
                return rel.with_val(name, value)
            case a.Values(names, rows):
                own = self.values(names, rows)
                return r.join(own, self.named(scope)) if isinstance(scope.graph, a.Var) else own
            case a.Query():
                return self.select(node, scope)
        raise ValueError(node)

    def named(self, scope: Scope) -> Rel:
        """The named graphs that the variable of the scope ranges over."""
        df, column = self.dataset.graphs(), r.fresh("graph")
        if scope.from_graphs or scope.from_named:
            df = df.where(F.col("g").isin([f"<{x}>" for x in scope.from_named]))
        return Rel(df.select(F.col("g").alias(column)), {scope.graph.name: Info(column, "term")})

    def in_graphs(self, node, scope: Scope) -> Rel:
        """A pattern in every named graph at once: the graph is a variable of its own in each part, by which parts are joined."""
        name, hidden = scope.graph.name, "." + r.fresh("graph")
        rel = self.pattern(node, replace(scope, graph=a.Var(hidden)))
        graph = rel.val(hidden)
        if name in rel.vars:  # the pattern itself speaks of the graph's name
            own = rel.val(name)
            rel = Rel(rel.df.where(own.term().isNull() | (own.term() == graph.term())), rel.vars)
        return Rel(rel.df, {n: i for n, i in rel.vars.items() if n not in (name, hidden)}).with_val(name, graph, False)

    def path_in_graphs(self, node: a.PathPattern, scope: Scope) -> Rel:
        """A path in every named graph at once: each node is named with its graph, so ways stay in one."""
        mark = lambda c: F.concat("g", F.lit("\n"), c).alias(c)
        inside = QuadDataset(self.dataset.active(scope).select(mark("s"), "p", mark("o"), F.lit("").alias("g")))
        rel = match_path(inside, a.PathPattern(a.Var("s"), node.path, a.Var("o")), Scope())
        ends = rel.df.select(*(rel.val(c).term().alias(c) for c in "so")).withColumn("g", F.substring_index("s", "\n", 1))
        df = ends.select("g", *(F.expr(f"substring({c}, length(g) + 2)").alias(c) for c in "so"))
        out: dict[str, Info] = {}
        picked: list[Column] = []
        for c, end in (("s", node.s), ("o", node.o), ("g", scope.graph)):
            if isinstance(end, a.Const):
                df = df.where(F.col(c) == end.term)
            elif end.name in out:
                df = df.where(F.col(c) == F.col("s"))
            else:
                out[end.name] = Info(r.fresh(end.name), "term")
                picked.append(F.col(c).alias(out[end.name].column))
        return Rel(df.select(*picked), out)

    def each_graph(self, node, scope: Scope) -> Rel:
        """A pattern that has to be matched graph by graph, such as one with a LIMIT inside; beyond ``GRAPHS_AT_ONCE`` in parts that are written."""
        name = scope.graph
        graphs = [row["g"] for row in self.named(scope).df.toDF("g").distinct().toLocalIterator()]
        out, part = None, None
        for k, g in enumerate(graphs):
            inner = replace(scope, graph=g, from_named=(*scope.from_named,))
            one = self.pattern(node, inner)
            if name.name in one.vars:
                own = one.val(name.name).term()
                one = Rel(one.df.where(own.isNull() | (own == g)), {n: i for n, i in one.vars.items() if n != name.name})
            one = one.with_val(name.name, Val("term", F.lit(g)), False)
            part = one if part is None else r.union(part, one)
            if k + 1 == len(graphs) or (k + 1) % GRAPHS_AT_ONCE == 0:
                if len(graphs) > GRAPHS_AT_ONCE:
                    part = Rel(written(part.keep(part.vars).df, "graphs"), part.vars)
                out, part = part if out is None else r.union(out, part), None
        if out is None:
            names = {**a.variables(node), name.name: None}
            cols = {n: Info(r.fresh(n), "term") for n in names}
            out = Rel(self.spark.createDataFrame([], ", ".join(f"{i.column} string" for i in cols.values())), cols)
        return out

    def values(self, names: tuple[str, ...], rows: tuple) -> Rel:
        columns = {n: r.fresh(n) for n in names}
        maybe = {n: any(row[k] is None for row in rows) for k, n in enumerate(names)}
        whole = {n: rows and all(row[k] is not None and scalars.const(row[k]).kind == "int" for row in rows) for k, n in enumerate(names)}
        native = lambda n, x: int(x[1:].rpartition('"')[0]) if whole[n] else x
        schema = ", ".join(f"{c} {'bigint' if whole[n] else 'string'}" for n, c in columns.items())
        df = self.spark.createDataFrame([tuple(native(n, x) for n, x in zip(names, row)) for row in rows], schema)
        return Rel(df, {n: Info(c, "int" if whole[n] else "term", "", maybe[n]) for n, c in columns.items()})

    def filter(self, rel: Rel, condition, scope: Scope) -> Rel:
        if isinstance(condition, a.Call) and condition.name == "&&":
            return self.filter(self.filter(rel, condition.args[0], scope), condition.args[1], scope)
        if isinstance(condition, a.Call) and condition.name == "!" and isinstance(condition.args[0], a.Exists):
            inner = condition.args[0]
            condition = a.Exists(inner.pattern, not inner.negated)
        if isinstance(condition, a.Exists):
            return self.exists(rel, condition, scope)
        value, rel = self.expr(condition, rel, scope)
        return Rel(rel.df.where(t.truth(value)), rel.vars)

    def exists(self, rel: Rel, node: a.Exists, scope: Scope) -> Rel:
        inner, test = node.pattern, None
        if isinstance(inner, a.Filter) and expression_variables(inner.condition) - set(a.variables(inner.pattern)):
            condition, inner = inner.condition, inner.pattern  # it speaks of the outer solution
            test = lambda both: F.coalesce(t.truth(self.expr(condition, both, scope)[0]), F.lit(False))
        found = self.pattern(inner, scope)
        if test is None:
            found = found.keep([n for n in found.vars if n in rel.vars]) if any(n in rel.vars for n in found.vars) else found
        return r.semi(rel, found, "left_anti" if node.negated else "left_semi", test)

    # -- expressions -------------------------------------------------------------
    def expr(self, node, rel: Rel, scope: Scope) -> tuple[Val, Rel]:
        """The value of an expression, and the relation, which may have got a column for an EXISTS."""
        match node:
            case a.Var(name):
                return (rel.val(name) if name in rel.vars else Val("term", t.null())), rel
            case a.Const(term):
                return scalars.const(term), rel
            case a.Exists(pattern, negated):
                found = self.pattern(pattern, scope)
                shared = [n for n in found.vars if n in rel.vars]
                found = found.keep(shared) if shared else found
                flag = r.fresh("exists")
                found = Rel(found.df.distinct().withColumn(flag, F.lit(True)) if shared else found.df.limit(1).select(F.lit(True).alias(flag)), {**found.vars, "." + flag: Info(flag, "bool")} if shared else {"." + flag: Info(flag, "bool")})
                row = r.fresh("row")
                numbered = Rel(rel.df.withColumn(row, F.monotonically_increasing_id()), {**rel.vars, "." + row: Info(row, "int")})
                joined = r.join(numbered, found, "left")
                hit = joined.vars["." + flag].column
                if any(rel.vars[n].maybe for n in shared):
                    joined = Rel(joined.df.dropDuplicates([row]), joined.vars)
                value = F.col(hit).isNotNull()
                kept = {n: joined.vars[n] for n in rel.vars}
                return Val("bool", ~value if negated else value), Rel(joined.df, kept)
            case a.Aggregate():
                raise UnsupportedError("an aggregate outside of a grouped query")
            case a.Call(name, args):
                return self.call(name, args, rel, scope)
        raise ValueError(node)

    def call(self, name: str, args: tuple, rel: Rel, scope: Scope) -> tuple[Val, Rel]:
        if name == "BOUND":
            value, rel = self.expr(args[0], rel, scope)
            return Val("bool", value.col.isNotNull()), rel
        values: list[Val] = []
        for x in args:
            value, rel = self.expr(x, rel, scope)
            values.append(value)
        if name == "IF":
            kind, (x, y), prefix = scalars.merge(values[1:])
            test = t.truth(values[0])
            return Val(kind, F.when(test, x).when(~test, y), prefix), rel
        if name == "COALESCE":
            kind, columns, prefix = scalars.merge(values)
            return Val(kind, F.coalesce(*columns), prefix), rel
        if name in ("IN", "NOT IN"):
            out = F.lit(False)
            for x in values[1:]:
                out = out | scalars.equal(values[0], x)
            return Val("bool", ~out if name == "NOT IN" else out), rel
        if name in ("IRI", "URI"):
            return scalars._iri(values[0], self.base), rel
        if name == "NOW":
            return Val("term", F.lit(f'"{self.now}"^^<{v.XSD_DATETIME}>')), rel
        if name == "BNODE":
            row = F.monotonically_increasing_id().cast("string")
            label = F.concat(F.lit("s"), row, F.lit("x"), F.md5(scalars.string_parts(values[0])[0])) if values else F.concat(F.lit("u"), F.replace(F.uuid(), F.lit("-"), F.lit("")))
            return Val("term", F.concat(F.lit("_:"), label)), rel
        if name in scalars.CASTS:
            return scalars.cast_to(name, values[0]), rel
        if name in scalars.CUSTOM:
            return scalars.CUSTOM[name](*values), rel
        if name in scalars.FUNCTIONS:
            try:
                return scalars.FUNCTIONS[name](*values), rel
            except TypeError as x:
                raise ValueError(f"{name}: {x}") from x
        raise UnsupportedError(f"unknown function <{name}>")

    # -- queries -----------------------------------------------------------------
    def grouped(self, q: a.Query, rel: Rel, scope: Scope) -> Rel:
        """GROUP BY, aggregates and HAVING; expressions over aggregates are computed after the grouping."""
        keys: list[tuple[str, Val]] = []
        for k, (name, expression) in enumerate(q.group or ()):
            value, rel = self.expr(expression, rel, scope)
            keys.append((name or f".key{k}", value))
        found: dict[a.Aggregate, str] = {}

        def collect(node) -> None:
            if isinstance(node, a.Aggregate):
                found.setdefault(node, f".agg{len(found)}")
            elif isinstance(node, a.Call):
                for x in node.args:
                    collect(x)

        targets = [e for _, e in q.projection or () if e is not None] + list(q.having) + [o.expr for o in q.order]
        for e in targets:
            collect(e)
        out: dict[str, Info] = {}
        key_columns = []
        for name, value in keys:
            out[name] = Info(r.fresh(name), value.kind, value.prefix, True)
            key_columns.append(value.col.alias(out[name].column))
        aggregates = []
        row = [F.col(i.column) for n, i in rel.vars.items() if not n.startswith(".")]
        for node, name in found.items():
            value = None
            if node.arg is not None:
                value, rel = self.expr(node.arg, rel, scope)
            done = aggregate(node.name, value, node.distinct, node.separator, row)
            out[name] = Info(r.fresh(name), done.kind, done.prefix, True)
            aggregates.append(done.col.alias(out[name].column))
        if aggregates:
            df = rel.df.groupBy(*key_columns).agg(*aggregates) if key_columns else rel.df.agg(*aggregates)
        else:
            df = rel.df.select(*key_columns).distinct()
        for e in targets:
            for n in expression_variables(e, aggregates=False):
                if n not in out and n in rel.vars:
                    raise UnsupportedError(f"?{n} is neither grouped nor aggregated")
        done_rel = Rel(df, out)
        swap = lambda node: a.Var(found[node]) if isinstance(node, a.Aggregate) else a.Call(node.name, tuple(swap(x) for x in node.args)) if isinstance(node, a.Call) else node
        q.projection = [(n, swap(e) if e is not None else None) for n, e in q.projection or ()]
        q.order = [a.OrderKey(swap(o.expr), o.descending) for o in q.order]
        for h in q.having:
            done_rel = self.filter(done_rel, swap(h), scope)
        return done_rel

    def select(self, q: a.Query, scope: Scope) -> Rel:
        """The solutions of a SELECT, in order if it has one."""
        q = replace(q, projection=None if q.projection is None else list(q.projection), order=list(q.order))
        if q.from_graphs or q.from_named:
            scope = Scope("", tuple(q.from_graphs), tuple(q.from_named))
        rel = self.pattern(q.pattern, scope)
        if q.group is not None or q.having or any(has_aggregate(e) for _, e in q.projection or ()) or any(has_aggregate(o.expr) for o in q.order):
            rel = self.grouped(q, rel, scope)
        names = [n for n in rel.vars if not n.startswith(".")] if q.projection is None else [n for n, _ in q.projection]
        for n, expression in q.projection or ():
            if expression is not None:
                value, rel = self.expr(expression, rel, scope)
                rel = rel.with_val(n, value)
            elif n not in rel.vars:
                rel = rel.with_val(n, Val("term", t.null()))
        if q.distinct and any(expression_variables(o.expr) - set(names) for o in q.order):
            rel = self.first_of_each(q, rel, names, scope)
        else:
            if q.distinct:
                rel = rel.keep(names)
                rel = Rel(rel.df.distinct(), rel.vars)
            if q.order:
                keys: list[Column] = []
                for o in q.order:
                    value, rel = self.expr(o.expr, rel, scope)
                    keys += [_directed(k, o.descending) for k in t.order_keys(value)]
                rel = Rel(rel.df.orderBy(*keys), rel.vars)
        out = rel.keep(names)
        df = out.df
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        return Rel(df, out.vars)

    def first_of_each(self, q: a.Query, rel: Rel, names: list[str], scope: Scope) -> Rel:
        """DISTINCT solutions in an order by variables that they leave out: each stands where its first one would."""
        keys: list[tuple[Column, bool]] = []
        for o in q.order:
            value, rel = self.expr(o.expr, rel, scope)
            keys += [(k, o.descending) for k in t.order_keys(value)]
        own = rel.keep(names)
        columns = own.df.columns
        named = [r.fresh("key") for _ in keys]
        df = rel.df.select(*columns, *(k.alias(n) for (k, _), n in zip(keys, named)))
        if len({down for _, down in keys}) == 1:  # one direction: a struct's least or greatest is the first, and partial sums do
            first = (F.max if keys[0][1] else F.min)(F.struct(*named))
            df = df.groupBy(*columns).agg(first.alias("_first")).select(*columns, *(F.col("_first")[n].alias(n) for n in named))
        else:
            place = F.row_number().over(Window.partitionBy(*columns).orderBy(*(_directed(F.col(n), down) for n, (_, down) in zip(named, keys))))
            df = df.withColumn("_place", place).where("_place = 1").drop("_place")
        return Rel(df.orderBy(*(_directed(F.col(n), down) for n, (_, down) in zip(named, keys))), own.vars)

    def construct(self, q: a.Query, scope: Scope) -> DataFrame:
        """The set of triples (s, p, o) that the template makes of the solutions."""
        inner = replace(q, form="SELECT", projection=None, template=[])
        rel = self.select(inner, scope)
        return self.instantiate(rel, [("", q.template)]).select("s", "p", "o").distinct()

    def instantiate(self, rel: Rel, parts: list) -> DataFrame:
        """(s, p, o, g) rows of templates: ill-formed and unbound ones dropped, blank nodes fresh for each solution."""
        row = r.fresh("row")
        df = rel.df.withColumn(row, F.monotonically_increasing_id()) if any(isinstance(x, a.Const) and x.term.startswith("_:") for _, triples in parts for tr in triples for x in (tr.s, tr.p, tr.o)) else rel.df

        def column(node) -> Column:
            if isinstance(node, a.Const):
                return F.concat(F.lit(node.term + "x"), F.col(row).cast("string")) if node.term.startswith("_:") else F.lit(node.term)
            return rel.val(node.name).term() if node.name in rel.vars else t.null()

        rows = []
        for graph, triples in parts:
            g = F.lit(graph) if isinstance(graph, str) else column(graph)
            rows += [F.struct(column(x.s).alias("s"), column(x.p).alias("p"), column(x.o).alias("o"), g.alias("g")) for x in triples]
        if not rows:
            return self.spark.createDataFrame([], "s string, p string, o string, g string")
        made = df.select(F.explode(F.array(*rows)).alias("x")).select("x.*")
        good = (t.is_iri(F.col("s")) | t.is_blank(F.col("s"))) & t.is_iri(F.col("p")) & F.col("o").isNotNull() & ((F.col("g") == "") | t.is_iri(F.col("g")))
        return made.where(good)

    def describe(self, q: a.Query, scope: Scope) -> DataFrame:
        """Triples whose subject is a described resource, and those of blank nodes that they lead to."""
        rel = self.select(replace(q, form="SELECT", projection=None, template=[]), scope)
        seeds = None
        for x in q.describe:
            one = self.spark.createDataFrame([(x.term,)], "s string") if isinstance(x, a.Const) else rel.df.select(rel.val(x.name).term().alias("s")).where("s is not null") if x.name in rel.vars else None
            if one is not None:
                seeds = one if seeds is None else seeds.union(one)
        triples = self.dataset.active(scope)
        if seeds is None:
            return triples.limit(0)
        found = triples.join(seeds.distinct(), "s").select("s", "p", "o")
        from quadloom.operators.closure import reachable

        blanks = triples.where(t.is_blank(F.col("o"))).select("s", "o")
        starts = found.where(t.is_blank(F.col("o"))).select(F.col("o").alias("n"))
        more = reachable(blanks.where(t.is_blank(F.col("s"))), starts)
        return found.union(triples.join(more.select(F.col("n").alias("s")), "s").select("s", "p", "o")).distinct()


def _directed(key: Column, descending: bool) -> Column:
    return key.desc_nulls_last() if descending else key.asc_nulls_first()


def carries_graph(node) -> bool:
    """Whether a pattern inside GRAPH with a variable can be matched in all graphs at once: no sub-SELECT, no other GRAPH, no constant that is its own way of no steps."""
    match node:
        case a.Query() | a.Graph():
            return False
        case a.PathPattern(s, path, o):
            return not (isinstance(path, a.Repeat) and path.least == 0 and (isinstance(s, a.Const) or isinstance(o, a.Const)))
        case a.Join(x, y) | a.Union(x, y) | a.Minus(x, y):
            return carries_graph(x) and carries_graph(y)
        case a.LeftJoin(x, y, condition):
            return carries_graph(x) and carries_graph(y) and carries_graph(condition)
        case a.Filter(condition, inner):
            return carries_graph(condition) and carries_graph(inner)
        case a.Extend(inner, _, expression):
            return carries_graph(inner) and carries_graph(expression)
        case a.Exists(inner, _):
            return carries_graph(inner)
        case a.Call(_, args):
            return all(carries_graph(x) for x in args)
    return True


def has_aggregate(node) -> bool:
    return isinstance(node, a.Aggregate) or isinstance(node, a.Call) and any(has_aggregate(x) for x in node.args)


def expression_variables(node, aggregates: bool = True) -> set[str]:
    match node:
        case a.Var(name):
            return {name}
        case a.Call(_, args):
            return set().union(*(expression_variables(x, aggregates) for x in args)) if args else set()
        case a.Aggregate(_, arg):
            return expression_variables(arg) if aggregates and arg is not None else set()
    return set()


class Engine:
    """Queries over a dataset."""

    def __init__(self, dataset: Dataset, base: str = "") -> None:
        self.dataset, self.base = dataset, base

    def _parsed(self, text: str, *forms: str) -> tuple[Compiler, a.Query, Scope]:
        if not text.strip():
            raise ValueError("an empty query")
        q = parse_query(text, self.base)
        if q.form not in forms:
            raise ValueError(f"a {q.form} query; expected {' or '.join(forms)}")
        return Compiler(self.dataset, self.base), q, Scope("", tuple(q.from_graphs), tuple(q.from_named))

    def select(self, text: str, native: bool = False) -> DataFrame:
        """Solutions, one column for each variable: terms, or with ``native`` plain numbers, texts and IRIs."""
        compiler, q, scope = self._parsed(text, "SELECT")
        rel = compiler.select(q, scope)
        return rel.df.select(*((rel.val(n).plain() if native else rel.val(n).term()).alias(n) for n in rel.vars))

    def ask(self, text: str) -> bool:
        compiler, q, scope = self._parsed(text, "ASK")
        return not compiler.pattern(q.pattern, scope).df.isEmpty()

    def construct(self, text: str) -> DataFrame:
        compiler, q, scope = self._parsed(text, "CONSTRUCT", "DESCRIBE")
        return compiler.construct(q, scope) if q.form == "CONSTRUCT" else compiler.describe(q, scope)

    def query(self, text: str):
        """A bool, solutions or triples, as the query's form asks."""
        form = parse_query(text, self.base).form if text.strip() else "SELECT"
        return self.ask(text) if form == "ASK" else self.select(text) if form == "SELECT" else self.construct(text)
