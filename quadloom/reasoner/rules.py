"""Bounded RDFS and OWL rules as fixpoints over DataFrames.

Triples are (s, p, o) IRIs.  Schema axioms are few beside assertions as a rule:
up to ``FEW`` of them, and closures of up to ``FEW_PAIRS`` pairs, are worked
out on the driver and sent to the tasks; more stay tables, which DataFrame loops
close and read lists from.  Both ways give the same rows.  Assertions never
leave the cluster.  Every round of a fixpoint joins what the last one added and
appends what is new to a table in the shared folder.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom import vocab as v
from quadloom.functions import terms as t
from quadloom.operators.closure import components, paths, transitive_closure
from quadloom.reasoner.policy import Policy
from quadloom.session import Growing, free, unique, written

#: Axioms that are worked on on the driver, pairs of a closure there, and rows of a relation that joins may send to all tasks.
FEW, FEW_PAIRS = 2_000, 10_000
#: Lines of a schema's diagnostics for people; their number is stated where there are more.
LINES = 1_000
TRIPLE = "s string, p string, o string"

#: Predicates whose triples are axioms or equality, not property assertions.
AXIOMS = (
    v.TYPE, v.SUB_CLASS, v.SUB_PROPERTY, v.DOMAIN, v.RANGE, v.CHAIN, v.MEMBERS, v.DISTINCT_MEMBERS, v.FIRST, v.REST,
    v.SAME_AS, v.DIFFERENT_FROM, v.DISJOINT_WITH, v.PROPERTY_DISJOINT, v.INVERSE_OF, v.EQUIVALENT_CLASS, v.EQUIVALENT_PROPERTY,
)
CHARACTERISTICS = (v.FUNCTIONAL, v.INVERSE_FUNCTIONAL, v.TRANSITIVE, v.SYMMETRIC, v.ASYMMETRIC, v.REFLEXIVE, v.IRREFLEXIVE)
GROUPS = (v.ALL_DIFFERENT, v.ALL_DISJOINT_CLASSES, v.ALL_DISJOINT_PROPERTIES)


# --- snapshot -------------------------------------------------------------------


@dataclass(frozen=True)
class Snapshot:
    """What the reasoner sees of a dataset: IRI triples of all graphs, and counts of what it does not see."""

    triples: DataFrame  # (s, p, o), one row for each quad
    coverage: dict[str, int]
    key: tuple

    @classmethod
    def of(cls, quads: DataFrame) -> Snapshot:
        s, o = F.col("s"), F.col("o")
        kind = F.when(t.is_blank(s), 1).when(t.is_iri(o), 0).when(t.is_blank(o), 2).otherwise(3)
        row = quads.select("s", "p", "o", "g", kind.alias("kind")).agg(
            F.count_if(F.col("kind") == 0).alias("supported"),
            F.count_if(F.col("kind") > 0).alias("unsupported"),
            F.count_if(F.col("kind") == 1).alias("bnode_subjects"),
            F.count_if(F.col("kind") == 2).alias("bnode_objects"),
            F.count_if(F.col("kind") == 3).alias("literal_objects"),
            F.count_if(F.col("g") != "").alias("flattened_named_graph_quads"),
            F.bit_xor(F.when(F.col("kind") == 0, F.xxhash64("s", "p", "o"))).alias("x"),
            F.sum(F.when(F.col("kind") == 0, F.xxhash64("o", "p", "s") % 1000000007)).alias("y"),
        )
        values = row.first().asDict()
        key = (values.pop("x"), values.pop("y"), values["supported"], values["unsupported"])
        bare = lambda c: F.substring(c, F.lit(2), F.char_length(F.col(c)) - 2).alias(c)
        triples = quads.where(t.is_iri(s) & t.is_iri(o)).select(bare("s"), bare("p"), bare("o"))
        return cls(triples, values, key)

    @classmethod
    def of_triples(cls, triples: DataFrame) -> Snapshot:
        """From bare IRIs."""
        return cls.of(triples.select(*(F.concat(F.lit("<"), F.col(c), F.lit(">")).alias(c) for c in "spo"), F.lit("").alias("g")))


# --- schema ---------------------------------------------------------------------


def closed(edges: set[tuple[str, str]], most: int | None = None) -> set[tuple[str, str]] | None:
    """Transitive closure on the driver; None if it has over ``most`` pairs."""
    out: dict[str, set[str]] = defaultdict(set)
    for a, b in edges:
        out[a].add(b)
    found: set[tuple[str, str]] = set()
    for start in list(out):
        seen: set[str] = set()
        stack = list(out[start])
        while stack:
            x = stack.pop()
            if x not in seen:
                seen.add(x)
                stack += out.get(x, ())
        found |= {(start, x) for x in seen}
        if most is not None and len(found) > most:
            return None
    return found


class Relation:
    """Rows of axioms: a set on the driver, or a table if there are many."""

    def __init__(self, spark, columns: str, rows: set[tuple] | None = None, table: DataFrame | None = None) -> None:
        self.spark, self.columns, self.rows, self.table = spark, columns.split(), rows, table

    @cached_property
    def empty(self) -> bool:
        return not self.rows if self.table is None else self.table.isEmpty()

    def __bool__(self) -> bool:
        return not self.empty

    @property
    def few(self) -> bool:
        return self.table is None and len(self.rows) <= FEW_PAIRS

    def frame(self, columns: str = "") -> DataFrame:
        """The rows as a table, under other names if some are given; a small one may be sent to all tasks."""
        names = columns.split() or self.columns
        if self.table is not None:
            return self.table.select(*(F.col(c).alias(n) for c, n in zip(self.columns, names)))
        df = self.spark.createDataFrame(sorted(self.rows), ", ".join(f"{n} {'int' if c == 'k' else 'string'}" for c, n in zip(self.columns, names)))
        return F.broadcast(df) if self.few else df

    def values(self, column: str) -> DataFrame:
        """(v): the distinct values of a column."""
        return self.frame().select(F.col(column).alias("v")).distinct()

    def limits(self, df: DataFrame, column: str, *own: str) -> DataFrame:
        """The rows of ``df`` whose column has a value of the relation's columns ``own``."""
        wanted = None
        for c in own:
            wanted = self.values(c) if wanted is None else wanted.union(self.values(c))
        return df.join(F.broadcast(wanted.distinct()) if self.few else wanted.distinct(), df[column] == F.col("v"), "left_semi")

    def union(self, other: Relation) -> Relation:
        if self.table is None and other.table is None:
            return Relation(self.spark, " ".join(self.columns), self.rows | other.rows)
        return Relation(self.spark, " ".join(self.columns), table=self.frame().union(other.frame()).distinct())

    def both_ways(self) -> Relation:
        if self.table is None:
            return Relation(self.spark, " ".join(self.columns), self.rows | {(y, x) for x, y in self.rows})
        return Relation(self.spark, " ".join(self.columns), table=self.table.union(self.table.select(*self.columns[::-1])).distinct())

    def closure(self) -> Relation:
        """Pairs that a path of one or more of these joins."""
        rows = closed(self.rows, FEW_PAIRS) if self.table is None else None
        if rows is not None:
            return Relation(self.spark, " ".join(self.columns), rows)
        a, b = self.columns
        return Relation(self.spark, " ".join(self.columns), table=transitive_closure(self.frame(), a, b).select(F.col("s").alias(a), F.col("o").alias(b)))

    def count(self) -> int:
        return len(self.rows) if self.table is None else self.table.count()

    def nodes(self) -> int:
        """Distinct values in any column."""
        if self.table is None:
            return len({x for row in self.rows for x in row})
        return self.table.select(F.explode(F.array(*self.columns)).alias("v")).distinct().count()


#: Why a list cannot be read.
NO_VALUE, TWO_VALUES, RING = "a node lacks its {}", "a node has several values of its {}", "it runs into itself"


def read_list(cells: dict[str, tuple[set[str], set[str]]], head: str) -> tuple[list[str], str | None]:
    """The members of an RDF list, and what is wrong with it; cells: node -> (values of first, values of rest)."""
    order: dict[str, str] = {}
    node = head
    while node != v.NIL or not order:
        if node in order:
            return list(order.values()), RING
        ends = cells.get(node, (set(), set()))
        for values, name in zip(ends, ("first", "rest")):
            if len(values) != 1:
                return list(order.values()), (TWO_VALUES if values else NO_VALUE).format(name)
        (order[node],), (node,) = ends
    return list(order.values()), None


def read_lists(firsts: DataFrame, rests: DataFrame, heads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((head, k, member) of well-formed lists, (head, reason) of the others), for any number of lists of any length.

    firsts, rests: (n, x); heads: (head).  Links are doubled until the longest
    list has ended, so a list of n members takes the logarithm of n rounds.
    """
    name = lambda n, word: F.when(n == 0, F.lit(NO_VALUE.format(word))).when(n > 1, F.lit(TWO_VALUES.format(word)))
    own = firsts.groupBy("n").agg(F.min("x").alias("first"), F.count_distinct("x").alias("f")).join(rests.groupBy("n").agg(F.min("x").alias("rest"), F.count_distinct("x").alias("r")), "n", "full")
    cells = written(own.select("n", "first", "rest", F.coalesce(name(F.coalesce("f", F.lit(0)), "first"), name(F.coalesce("r", F.lit(0)), "rest")).alias("bad")), "cells")
    good = cells.where("bad is null")
    links = written(good.select("n", F.col("rest").alias("to")), "links")
    size = links.count()
    reached = written(heads.select("head").distinct().select("head", F.lit(0).cast("long").alias("k"), F.col("head").alias("n")), "members")
    step = 1
    while step <= size and not links.isEmpty():
        ahead = reached.join(links, "n").where(F.col("to") != v.NIL).select("head", (F.col("k") + step).alias("k"), F.col("to").alias("n"))
        last, reached = reached, written(reached.union(ahead), "members")
        free(last)
        old, links = links, written(links.select("n", F.col("to").alias("m")).join(links.select(F.col("n").alias("m"), "to"), "m").select("n", "to"), "links")
        free(old)
        step *= 2
    told = reached.join(cells, "n", "left").select("head", "k", "n", "first", F.when(F.col("rest").isNull() & F.col("bad").isNull(), NO_VALUE.format("first")).otherwise(F.col("bad")).alias("bad"))
    # a list with more places than nodes runs into itself
    kinds = told.groupBy("head").agg(F.min(F.when(F.col("bad").isNotNull(), F.struct("k", "bad")))["bad"].alias("bad"), F.count(F.lit(1)).alias("places"), F.count_distinct("n").alias("nodes"))
    reasons = written(kinds.select("head", F.coalesce("bad", F.when(F.col("places") > F.col("nodes"), F.lit(RING))).alias("reason")), "reasons")
    fine = reasons.where("reason is null").select("head")
    return told.join(fine, "head", "left_semi").select("head", "k", F.col("first").alias("member")), reasons.where("reason is not null")


def unread(name: str, subject: str, reason: str) -> str:
    return f"{name} of <{subject}> is left out: its list cannot be read, {reason}"


def wrong_length(name: str, subject: str, n: int, wanted: str) -> str:
    return f"{name} of <{subject}> is left out: it has {n} members where {wanted} can be used"


_GROUPS = ((v.ALL_DIFFERENT, "owl:AllDifferent", (v.DISTINCT_MEMBERS, v.MEMBERS)), (v.ALL_DISJOINT_CLASSES, "owl:AllDisjointClasses", (v.MEMBERS,)), (v.ALL_DISJOINT_PROPERTIES, "owl:AllDisjointProperties", (v.MEMBERS,)))


@dataclass
class Schema:
    """The axioms; groups are (g, k, m): a group's name and its members by place, never the pairs of them."""

    sub_class: Relation
    sub_property: Relation
    asserted_sub_class: Relation
    asserted_sub_property: Relation
    domain: Relation
    range: Relation
    inverse: Relation
    disjoint: Relation
    property_disjoint: Relation
    chains: Relation  # (q, p1, p2)
    different_groups: Relation
    class_groups: Relation
    property_groups: Relation
    marks: dict[str, Relation]  # characteristic -> (p)
    key: object
    diagnostics: list[str] = field(default_factory=list)

    @cached_property
    def class_closure(self) -> Relation:
        return self.sub_class.closure()

    @cached_property
    def property_closure(self) -> Relation:
        return self.sub_property.closure()

    @classmethod
    def of(cls, triples: DataFrame, policy: Policy) -> Schema:
        wanted = [p for p in AXIOMS if p not in (v.TYPE, v.SAME_AS, v.DIFFERENT_FROM)]
        p, o = F.col("p"), F.col("o")
        axioms = triples.where(p.isin(wanted) | ((p == v.TYPE) & o.isin(list(CHARACTERISTICS + GROUPS)))).select("s", "p", "o").distinct()
        rows = [tuple(r) for r in axioms.limit(FEW + 1).collect()]
        return cls._on_driver(triples.sparkSession, rows) if len(rows) <= FEW else cls._in_tables(written(axioms, "axioms"))

    @classmethod
    def _made(cls, pairs, marks: dict[str, Relation], **rest) -> Schema:
        """pairs: predicate -> Relation (a, b)."""
        return cls(
            sub_class=pairs(v.SUB_CLASS).union(pairs(v.EQUIVALENT_CLASS).both_ways()),
            sub_property=pairs(v.SUB_PROPERTY).union(pairs(v.EQUIVALENT_PROPERTY).both_ways()),
            asserted_sub_class=pairs(v.SUB_CLASS),
            asserted_sub_property=pairs(v.SUB_PROPERTY),
            domain=pairs(v.DOMAIN),
            range=pairs(v.RANGE),
            inverse=pairs(v.INVERSE_OF).both_ways(),
            disjoint=pairs(v.DISJOINT_WITH).both_ways(),
            property_disjoint=pairs(v.PROPERTY_DISJOINT).both_ways(),
            marks=marks,
            **rest,
        )

    @classmethod
    def _on_driver(cls, spark, rows: list[tuple[str, str, str]]) -> Schema:
        by: dict[str, set[tuple[str, str]]] = defaultdict(set)
        for s, p, o in rows:
            by[p].add((s, o))
        cells: dict[str, tuple[set[str], set[str]]] = defaultdict(lambda: (set(), set()))
        for place, p in enumerate((v.FIRST, v.REST)):
            for s, o in by[p]:
                cells[s][place].add(o)
        said: set[str] = set()
        chains: set[tuple[str, str, str]] = set()
        for s, head in by[v.CHAIN]:
            members, reason = read_list(cells, head)
            if reason:
                said.add(unread("owl:propertyChainAxiom", s, reason))
            elif len(members) != 2:
                said.add(wrong_length("owl:propertyChainAxiom", s, len(members), "two"))
            else:
                chains.add((s, *members))
        groups = []
        for kind, name, predicates in _GROUPS:
            found: set[tuple[str, int, str]] = set()
            named = {s for s, o in by[v.TYPE] if o == kind}
            for s, head in {x for p in predicates for x in by[p] if x[0] in named}:
                members, reason = read_list(cells, head)
                if reason:
                    said.add(unread(name, s, reason))
                elif len(members) < 2:
                    said.add(wrong_length(name, s, len(members), "two or more"))
                else:
                    found |= {(f"{s} {head}", k, m) for k, m in enumerate(members)}
            groups.append(Relation(spark, "g k m", found))
        marks = {c: Relation(spark, "p", {(s,) for s, o in by[v.TYPE] if o == c}) for c in CHARACTERISTICS}
        return cls._made(lambda p: Relation(spark, "a b", by[p]), marks, chains=Relation(spark, "q p1 p2", chains), different_groups=groups[0], class_groups=groups[1], property_groups=groups[2], key=frozenset(rows), diagnostics=sorted(said))

    @classmethod
    def _in_tables(cls, axioms: DataFrame) -> Schema:
        spark = axioms.sparkSession
        of = lambda *ps: axioms.where(F.col("p").isin(list(ps)))
        typed = lambda kind: axioms.where((F.col("p") == v.TYPE) & (F.col("o") == kind)).select("s")
        uses = of(v.CHAIN).select("s", F.col("o").alias("head"), F.lit("owl:propertyChainAxiom").alias("name"))
        for kind, name, predicates in _GROUPS:
            uses = uses.union(of(*predicates).join(typed(kind), "s", "left_semi").select("s", F.col("o").alias("head"), F.lit(name).alias("name")))
        uses = written(uses.distinct(), "lists")
        cell = lambda p: of(p).select(F.col("s").alias("n"), F.col("o").alias("x"))
        members, broken = read_lists(cell(v.FIRST), cell(v.REST), uses.select("head"))
        members = written(members, "list-members")
        sizes = uses.join(members.groupBy("head").agg(F.count(F.lit(1)).alias("size")), "head")
        short = sizes.where("size < 2 or name = 'owl:propertyChainAxiom' and size <> 2")
        # one line for each malformed axiom; the schema's diagnostics are text for people, of whom the first lines are enough
        said = [unread(r["name"], r["s"], r["reason"]) for r in uses.join(broken, "head").orderBy("name", "s").limit(LINES).collect()]
        said += [wrong_length(r["name"], r["s"], r["size"], "two" if r["name"].endswith("Axiom") else "two or more") for r in short.orderBy("name", "s").limit(LINES).collect()]
        n_bad = uses.join(broken, "head").count() + short.count()
        if n_bad > len(said):
            said.append(f"{n_bad - len(said)} more axioms with lists are left out")
        fit = sizes.where("size >= 2")
        two = fit.where("name = 'owl:propertyChainAxiom' and size = 2").select("s", "head")
        at = lambda k, n: members.where(F.col("k") == k).select("head", F.col("member").alias(n))
        chains = two.join(at(0, "p1"), "head").join(at(1, "p2"), "head").select(F.col("s").alias("q"), "p1", "p2").distinct()
        groups = [Relation(spark, "g k m", table=written(fit.where(F.col("name") == name).join(members, "head").select(F.concat_ws(" ", "s", "head").alias("g"), F.col("k").cast("int").alias("k"), F.col("member").alias("m")), "groups")) for _, name, _ in _GROUPS]
        marks = {c: Relation(spark, "p", table=typed(c).select(F.col("s").alias("p"))) for c in CHARACTERISTICS}
        key = tuple(axioms.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("s", "p", "o")), F.sum(F.xxhash64("o", "p", "s") % 1000000007)).first())
        pairs = lambda p: Relation(spark, "a b", table=of(p).select(F.col("s").alias("a"), F.col("o").alias("b")))
        return cls._made(pairs, marks, chains=Relation(spark, "q p1 p2", table=written(chains, "chains")), different_groups=groups[0], class_groups=groups[1], property_groups=groups[2], key=key, diagnostics=sorted(said))


def derived_axioms(schema: Schema, policy: Policy, spark) -> DataFrame:
    """(s, p, o): the closure of the two hierarchies without what is asserted."""
    out = spark.createDataFrame([], TRIPLE)
    for on, name, asserted, p in (
        (policy.rdfs_subclass_closure, "class_closure", schema.asserted_sub_class, v.SUB_CLASS),
        (policy.rdfs_subproperty_closure, "property_closure", schema.asserted_sub_property, v.SUB_PROPERTY),
    ):
        if on and (pairs := getattr(schema, name)):
            fresh = pairs.frame("s o").join(asserted.frame("s o"), ["s", "o"], "left_anti")
            out = out.union((fresh.where("s <> o") if policy.drop_reflexive else fresh).select("s", F.lit(p).alias("p"), "o"))
    return out


# --- assertions -------------------------------------------------------------------


def property_assertions(triples: DataFrame) -> DataFrame:
    """Assertions, a row for each quad."""
    return triples.where(~F.col("p").isin(list(AXIOMS)))


def type_assertions(triples: DataFrame) -> DataFrame:
    return triples.where((F.col("p") == v.TYPE) & ~F.col("o").isin(list(CHARACTERISTICS))).select("s", F.col("o").alias("c"))


def canonical(df: DataFrame, clusters: DataFrame | None, *columns: str) -> DataFrame:
    """The columns with each member of an equality cluster replaced by the cluster's least member."""
    if clusters is None:
        return df
    for c in columns:
        own = clusters.select(F.col("member").alias("_m"), F.col("canonical").alias("_c"))
        df = df.join(own, df[c] == F.col("_m"), "left").withColumn(c, F.coalesce("_c", c)).drop("_m", "_c")
    return df


def expanded(df: DataFrame, clusters: DataFrame | None, *columns: str) -> DataFrame:
    """The columns with each least member replaced by every member."""
    if clusters is None:
        return df
    for c in columns:
        own = clusters.select(F.col("member").alias("_m"), F.col("canonical").alias("_c"))
        df = df.join(own, df[c] == F.col("_c"), "left").withColumn(c, F.coalesce("_m", c)).drop("_m", "_c")
    return df


def close_assertions(assertions: DataFrame, schema: Schema, policy: Policy, observed: DataFrame | None = None, whole: bool = False) -> DataFrame:
    """(s, p, o): assertions closed under hierarchy, inverses, symmetry, transitivity, binary chains and reflexivity.

    whole: they are a table of ``written`` with each row once, which is not copied.
    """
    facts = assertions.select("s", "p", "o")
    if policy.reflexive and schema.marks[v.REFLEXIVE] and observed is not None:
        # each resource under each reflexive property is what the rule derives
        whole, facts = False, facts.union(observed.select("n").distinct().crossJoin(schema.marks[v.REFLEXIVE].frame("q")).select(F.col("n").alias("s"), F.col("q").alias("p"), F.col("n").alias("o")))
    rules, paired = [], None
    if policy.rdfs_subproperty_closure and schema.property_closure:
        up = schema.property_closure.frame("p q")
        rules.append(lambda new, old: new.join(up, "p").select("s", F.col("q").alias("p"), "o"))
    if policy.owl_property_assertion_closure and schema.inverse:
        turned = schema.inverse.frame("p q")
        rules.append(lambda new, old: new.join(turned, "p").select(F.col("o").alias("s"), F.col("q").alias("p"), F.col("s").alias("o")))
    if policy.owl_property_assertion_closure and schema.marks[v.SYMMETRIC]:
        rules.append(lambda new, old: schema.marks[v.SYMMETRIC].limits(new, "p", "p").select(F.col("o").alias("s"), "p", F.col("s").alias("o")))
    if policy.owl_property_assertion_closure and schema.marks[v.TRANSITIVE]:

        def transitive(new: DataFrame, old: DataFrame) -> DataFrame:
            left, right = (schema.marks[v.TRANSITIVE].limits(x, "p", "p") for x in (new, old))
            ahead = left.select("s", "p", F.col("o").alias("m")).join(right.select(F.col("s").alias("m"), "p", "o"), ["m", "p"]).select("s", "p", "o")
            behind = right.select("s", "p", F.col("o").alias("m")).join(left.select(F.col("s").alias("m"), "p", "o"), ["m", "p"]).select("s", "p", "o")
            return ahead.union(behind)

        paired = transitive
    if policy.chains and schema.chains:
        plan = schema.chains.frame()

        def chain(new: DataFrame, old: DataFrame) -> DataFrame:
            out = None
            for a, b in ((new, old), (old, new)):
                first = a.join(plan, a["p"] == F.col("p1")).select("s", "q", "p2", F.col("o").alias("m"))
                one = first.join(b.select(F.col("s").alias("m"), F.col("p").alias("p2"), "o"), ["m", "p2"]).select("s", F.col("q").alias("p"), "o")
                out = one if out is None else out.union(one)
            return out

        rules.append(chain)
    known = Growing(assertions.sparkSession, "facts", facts if whole else None)
    fresh = facts if whole else known.add(unique(facts))

    def grown(fresh: DataFrame) -> DataFrame:
        made = None
        for rule in rules:
            one = rule(fresh, known.all)
            made = one if made is None else made.union(one)
        return known.add(made.distinct().join(known.all, ["s", "p", "o"], "left_anti"))

    if paired is not None:
        # paths at once when the other rules have ended; after that, pair by pair for what these rules make of the paths
        while rules and not fresh.isEmpty():
            fresh = grown(fresh)
        edges = schema.marks[v.TRANSITIVE].limits(known.all, "p", "p").where("s is not null and o is not null")
        fresh = known.take(paths(written(edges, "edges"), "p"))
        if fresh is None or not rules:
            return known.all
        fresh = grown(fresh)
        rules.append(paired)
    while rules and not fresh.isEmpty():
        fresh = grown(fresh)
    return known.all


def implied_equalities(facts: DataFrame, schema: Schema) -> DataFrame:
    """(a, b): least object of a functional property's subject with each other one, and the same for inverse functional ones."""
    out = facts.sparkSession.createDataFrame([], "a string, b string")
    for mark, key, value in ((v.FUNCTIONAL, "s", "o"), (v.INVERSE_FUNCTIONAL, "o", "s")):
        if schema.marks[mark]:
            own = schema.marks[mark].limits(facts, "p", "p").select("p", key, value).distinct()
            least = own.groupBy("p", key).agg(F.min(value).alias("a"))
            out = out.union(own.join(least, ["p", key]).where(F.col(value) != F.col("a")).select("a", F.col(value).alias("b")))
    return out.distinct()


@dataclass(frozen=True)
class Identity:
    clusters: DataFrame | None  # (member, canonical), of members of clusters only
    facts: DataFrame  # closed assertions on canonical resources, each row once
    inferred: DataFrame  # (a, b) equality links that are not asserted


def identity(triples: DataFrame, schema: Schema, policy: Policy, observed: DataFrame) -> Identity:
    """Equality and property closure, alternating until no new equality appears."""
    spark = triples.sparkSession
    assertions = written(unique(property_assertions(triples).select("s", "p", "o")), "assertions")
    none = spark.createDataFrame([], "a string, b string")
    if not policy.owl_equality_reasoning:
        return Identity(None, close_assertions(assertions, schema, policy, observed, whole=True), none)
    pairs = written(triples.where(F.col("p") == v.SAME_AS).select(F.col("s").alias("a"), F.col("o").alias("b")).distinct(), "same")
    asserted = pairs
    implied = none
    entails = bool(schema.marks[v.FUNCTIONAL] or schema.marks[v.INVERSE_FUNCTIONAL])
    clusters = None
    while True:
        if not pairs.isEmpty():
            clusters = written(components(pairs), "clusters")
        own = canonical(assertions, clusters, "s", "o")
        seen = canonical(observed, clusters, "n")
        facts = close_assertions(own, schema, policy, seen, whole=clusters is None)
        if not entails:
            break
        fresh = written(implied_equalities(facts, schema), "implied")
        if fresh.isEmpty():
            break
        implied = implied.union(fresh).distinct()
        pairs = written(pairs.union(fresh).distinct(), "same")
    if clusters is None:
        return Identity(None, facts, none)
    # links from the least member of a cluster to the others, unless asserted either way
    touched = implied
    if entails:
        linked = clusters.where("member <> canonical").select(F.col("canonical").alias("a"), F.col("member").alias("b"))
        hit = canonical(touched.select(F.col("a").alias("n")), clusters, "n").distinct()
        linked = linked.join(hit.select(F.col("n").alias("a")), "a", "left_semi")
    else:
        linked = none
    both = asserted.union(asserted.select("b", "a")).distinct()
    return Identity(clusters, facts, linked.join(both, ["a", "b"], "left_anti"))


# --- types ------------------------------------------------------------------------


def effective_types(triples: DataFrame, found: Identity, schema: Schema, policy: Policy) -> DataFrame:
    """(i, c, rank, origin, direct): every type of every instance with its most direct origin.

    Ranks: asserted 0, by domain 10, by range 20, through an equal resource one
    more than its own, through a subclass ten more; ties go to the lesser text.
    """
    rows = type_assertions(triples).distinct().select(F.col("s").alias("i"), "c", F.lit(0).alias("rank"), F.lit("asserted").alias("origin"))
    if policy.rdfs_domain_range_typing:
        facts = expanded(found.facts, found.clusters, "s", "o") if found.clusters is not None else found.facts
        for pairs, side, rank, word in ((schema.domain, "s", 10, "domain"), (schema.range, "o", 20, "range")):
            if pairs:
                rule = pairs.frame("p c")
                rows = rows.union(facts.join(rule, "p").select(F.col(side).alias("i"), "c", F.lit(rank).alias("rank"), F.concat(F.lit(f"{word}-derived via "), F.col("p")).alias("origin")))
    best = lambda df: df.groupBy("i", "c").agg(F.min(F.struct("rank", "origin")).alias("x")).select("i", "c", "x.rank", "x.origin")
    rows = best(rows)
    if found.clusters is not None:
        # one row for a cluster and class, so a large cluster makes no pairs
        own = rows.join(found.clusters, rows["i"] == F.col("member")).groupBy("canonical", "c").agg(F.min(F.struct("rank", "i", "origin")).alias("x"))
        shared = own.join(found.clusters, "canonical").select(F.col("member").alias("i"), "c", (F.col("x.rank") + 1).alias("rank"), F.concat(F.lit("equality-derived via "), F.col("x.i"), F.lit(" ("), F.col("x.origin"), F.lit(")")).alias("origin"))
        rows = best(rows.union(shared))
    if policy.rdfs_type_propagation and schema.class_closure:
        up = schema.class_closure.frame("c d")
        higher = rows.join(up, "c").select("i", F.col("d").alias("c"), (F.col("rank") + 10).alias("rank"), F.concat(F.lit("subclass-derived from "), F.col("c"), F.lit(" ("), F.col("origin"), F.lit(")")).alias("origin"))
        rows = best(rows.union(higher))
    return rows


def observed_resources(triples: DataFrame) -> DataFrame:
    """(n): resources of assertions, and instances of types."""
    own = property_assertions(triples)
    return own.select(F.col("s").alias("n")).union(own.select("o")).union(type_assertions(triples).select("s")).distinct()


def unsupported(triples: DataFrame) -> DataFrame:
    """(message) for each axiom of a construct that the rules do not interpret."""
    name = F.substring_index("p", "#", -1)
    kind = F.lower(name)
    what = (
        F.when(name.isin("onProperty", "hasValue"), F.concat(F.lit("a restriction by owl:"), name))
        .when(kind.contains("qualifiedcardinality"), F.lit("a qualified cardinality"))
        .when(kind.contains("cardinality"), F.lit("a cardinality"))
        .otherwise(F.concat(F.lit("owl:"), name))
    )
    return triples.where(F.col("p").isin(list(v.UNSUPPORTED))).distinct().select(F.format_string("no rule reads %s: <%s> <%s> <%s>", what, "s", "p", "o").alias("message"))
