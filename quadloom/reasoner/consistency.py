"""Consistency detectors: each gives violations with a focus and two conflicting terms, as rows of one shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom import vocab as v
from quadloom.reasoner.rules import Identity, Relation, Schema, canonical, expanded
from quadloom.session import tasks_for

VIOLATION = "ordinal int, constraint string, focus string, left string, right string, left_origin string, right_origin string, left_rank int, right_rank int"


def _rows(df: DataFrame, ordinal: int, constraint: str, **columns) -> DataFrame:
    out = {"focus": None, "left": None, "right": None, "left_origin": None, "right_origin": None, "left_rank": None, "right_rank": None} | columns
    kinds = {"left_rank": "int", "right_rank": "int"}
    as_col = lambda n, c: (F.lit(None) if c is None else F.col(c) if isinstance(c, str) else c).cast(kinds.get(n, "string")).alias(n)
    return df.select(F.lit(ordinal).alias("ordinal"), F.lit(constraint).alias("constraint"), *(as_col(n, c) for n, c in out.items()))


def nothing(types: DataFrame, schema: Schema) -> DataFrame:
    """Instances of owl:Nothing or of a class below it; the supporting class is the most direct one."""
    below = schema.class_closure.frame("c d").where(F.col("d") == v.NOTHING).select("c")
    unsatisfiable = below.union(below.sparkSession.createDataFrame([(v.NOTHING,)], "c string")).distinct()
    hit = types.join(F.broadcast(unsatisfiable) if schema.class_closure.few else unsatisfiable, "c", "left_semi")
    support = hit.where(F.col("c") != v.NOTHING).groupBy("i").agg(F.min(F.struct("rank", "c", "origin")).alias("x"))
    own = hit.where(F.col("c") == v.NOTHING).select("i", F.col("rank").alias("nr"), F.col("origin").alias("no"))
    both = hit.select("i").distinct().join(support, "i", "left").join(own, "i", "left")
    return _rows(both, 1, "owl:Nothing", focus="i", left=F.coalesce("x.c", F.lit(v.NOTHING)), right=F.lit(v.NOTHING), left_origin=F.coalesce("x.origin", "no"), right_origin="no", left_rank=F.coalesce("x.rank", "nr"), right_rank="nr")


def _conflicts(rows: DataFrame, on: list[str], term: str, pairs: Relation, groups: Relation) -> DataFrame | None:
    """(on, x, y): rows that are equal in ``on`` whose terms x <= y are a pair, or two places of one group.

    Members of a group meet where an instance has them; the pairs of a group are never listed.
    """
    out = None
    if pairs:
        rule = pairs.frame("x y").where("x <= y")
        left = rows.join(rule, rows[term] == F.col("x")).select(*on, "x", "y")
        out = left.join(rows.select(*on, F.col(term).alias("y")), [*on, "y"]).select(*on, "x", "y")
    if groups:
        placed = rows.join(groups.frame("g k m"), rows[term] == F.col("m")).select(*on, "g", "k", F.col("m").alias("m"))
        if (n := tasks_for(rows)) > 2:
            placed = placed.repartition(n, *on, "g").hint("merge")  # both sides of the join read this one shuffle, in small tasks
        other = placed.select(*on, "g", F.col("k").alias("l"), F.col("m").alias("n"))
        met = placed.join(other, [*on, "g"]).where("k < l").select(*on, F.least("m", "n").alias("x"), F.greatest("m", "n").alias("y"))
        out = met if out is None else out.union(met)
    return None if out is None else out.distinct()


def disjoint(types: DataFrame, schema: Schema) -> DataFrame:
    """Instances with two types that are disjoint; each unordered pair of classes once for an instance."""
    met = _conflicts(types.select("i", "c"), ["i"], "c", schema.disjoint, schema.class_groups)
    if met is None:
        return types.sparkSession.createDataFrame([], VIOLATION)
    left = types.select("i", F.col("c").alias("x"), F.col("origin").alias("lo"), F.col("rank").alias("lr"))
    right = types.select("i", F.col("c").alias("y"), F.col("origin").alias("ro"), F.col("rank").alias("rr"))
    return _rows(met.join(left, ["i", "x"]).join(right, ["i", "y"]), 2, "owl:disjointWith", focus="i", left="x", right="y", left_origin="lo", right_origin="ro", left_rank="lr", right_rank="rr")


def different(triples: DataFrame, found: Identity, schema: Schema) -> DataFrame:
    """Resources declared different, by an axiom or as members of a group, that are equal."""
    said = triples.where(F.col("p") == v.DIFFERENT_FROM).select("s", "o").distinct()
    both = canonical(said.select("s", "o", F.col("s").alias("a"), F.col("o").alias("b")), found.clusters, "a", "b").where("a = b").select("s", "o", "a")
    if schema.different_groups:
        members = canonical(schema.different_groups.frame("g k m").select("g", "k", "m", F.col("m").alias("a")), found.clusters, "a")
        other = members.select("g", "a", F.col("k").alias("l"), F.col("m").alias("o"))
        both = both.union(members.join(other, ["g", "a"]).where("k < l").select(F.col("m").alias("s"), "o", "a")).distinct()
    return _rows(both, 3, "owl:differentFrom", focus="s", left="s", right="o", left_origin=F.lit(SAID_DIFFERENT), right_origin=F.concat(F.lit("member of the cluster of "), F.col("a")))


def _constrained(found: Identity, properties: Relation, *columns: str) -> DataFrame:
    """Closed assertions of the constrained properties only, on all members of clusters."""
    limited = properties.limits(found.facts, "p", *columns)
    return limited if found.clusters is None else expanded(limited, found.clusters, "s", "o").distinct()


def _statement(s: str, p: str, o: str):
    return F.format_string("holds: <%s> <%s> <%s>", s, p, o)


def irreflexive(found: Identity, schema: Schema) -> DataFrame:
    hit = _constrained(found, schema.marks[v.IRREFLEXIVE], "p").where("s = o")
    return _rows(hit, 4, "owl:IrreflexiveProperty", focus="s", left="p", right="s", left_origin=F.lit(DECLARED), right_origin=_statement("s", "p", "o"))


def asymmetric(found: Identity, schema: Schema) -> DataFrame:
    """Pairs in both directions; a resource with itself does not count."""
    facts = _constrained(found, schema.marks[v.ASYMMETRIC], "p")
    back = facts.select(F.col("o").alias("s"), "p", F.col("s").alias("o"))
    hit = facts.where("s < o").join(back, ["s", "p", "o"])
    return _rows(hit, 5, "owl:AsymmetricProperty", focus="s", left="p", right="o", left_origin=_statement("s", "p", "o"), right_origin=_statement("o", "p", "s"))


def property_disjoint(found: Identity, schema: Schema) -> DataFrame:
    """One pair of resources under two disjoint properties; a property disjoint with itself conflicts with each assertion."""
    facts = None
    for properties, columns in ((schema.property_disjoint, ("a", "b")), (schema.property_groups, ("m",))):
        if properties:
            own = _constrained(found, properties, *columns)
            facts = own if facts is None else facts.union(own).distinct()
    met = None if facts is None else _conflicts(facts, ["s", "o"], "p", schema.property_disjoint, schema.property_groups)
    if met is None:
        return found.facts.sparkSession.createDataFrame([], VIOLATION)
    return _rows(met, 6, "owl:propertyDisjointWith", focus="s", left="x", right="y", left_origin=_statement("s", "x", "o"), right_origin=_statement("s", "y", "o"))


def violations(triples: DataFrame, types: DataFrame, found: Identity, schema: Schema) -> DataFrame:
    """All violations; the first by ordinal, focus, left and right is the primary one."""
    parts = [nothing(types, schema), disjoint(types, schema), different(triples, found, schema), irreflexive(found, schema), asymmetric(found, schema), property_disjoint(found, schema)]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


#: Where a contribution to a conflict comes from.
DECLARED, SAID_DIFFERENT, SAID_DISJOINT, HOLDS, CLUSTER = "declared of the property", "said by an owl:differentFrom axiom or group", "said by a disjointness axiom or group", "a statement that holds", "the closure of equality"


def explanation(row: dict) -> dict:
    """Summary, blame and evidence of one violation."""
    kind, focus, left, right, lo, ro = (row[k] for k in ("constraint", "focus", "left", "right", "left_origin", "right_origin"))
    said = lambda s, p, o: f"<{s}> <{p}> <{o}>"
    # per constraint: summary, (heuristic, principal, its origin, context, its origin), evidence as (role, s, p, o, origin)
    match kind:
        case "owl:Nothing":
            summary = f"{focus} is of type {left} ({lo})" + (", which can have no instance" if left == v.NOTHING else f", and {left} can have no instance")
            blame = ("prefer-more-direct-effective-type-origin", left, lo, v.NOTHING, ro or lo)
            evidence = [("conflicting-type", focus, v.TYPE, c, origin) for c, origin in dict([(left, lo), (v.NOTHING, ro or lo)][: 1 if left == v.NOTHING else 2]).items()]
        case "owl:disjointWith":
            summary = f"{focus} is of the types {left} ({lo}) and {right} ({ro}), which exclude each other"
            (_, *first), (_, *second) = sorted([(row["left_rank"], left, lo), (row["right_rank"], right, ro)])
            blame = ("prefer-more-direct-effective-type-origin", *first, *second)
            evidence = [("constraint-axiom", left, v.DISJOINT_WITH, right, SAID_DISJOINT), *(("conflicting-type", focus, v.TYPE, c, origin) for c, origin in ((left, lo), (right, ro)))]
        case "owl:differentFrom":
            summary = f"{left} and {right} are said to differ, yet they are equal"
            blame = ("prefer-direct-different-from-axiom", said(left, v.DIFFERENT_FROM, right), lo, said(left, v.SAME_AS, right), CLUSTER)
            evidence = [("constraint-axiom", left, v.DIFFERENT_FROM, right, lo), ("conflicting-equality", left, v.SAME_AS, right, CLUSTER)]
        case "owl:IrreflexiveProperty":
            summary = f"{focus} stands to itself in {left}, which is irreflexive"
            blame = ("prefer-direct-self-loop-assertion", said(focus, left, focus), HOLDS, left, DECLARED)
            evidence = [("constraint-declaration", left, v.TYPE, v.IRREFLEXIVE, DECLARED), ("conflicting-assertion", focus, left, focus, HOLDS)]
        case "owl:AsymmetricProperty":
            summary = f"{focus} and {right} stand to each other in {left} both ways, which is asymmetric"
            blame = ("pairwise-asymmetry-assertion-collision", said(focus, left, right), HOLDS, said(right, left, focus), HOLDS)
            evidence = [("constraint-declaration", left, v.TYPE, v.ASYMMETRIC, DECLARED), ("conflicting-assertion", focus, left, right, HOLDS), ("conflicting-assertion", right, left, focus, HOLDS)]
        case _:
            target = lo.rsplit(" <", 1)[1][:-1]
            summary = f"{focus} stands to {target} in both {left} and {right}, which exclude each other"
            blame = ("pairwise-property-disjointness-assertion-collision", said(focus, left, target), HOLDS, said(focus, right, target), HOLDS)
            evidence = [("constraint-axiom", left, v.PROPERTY_DISJOINT, right, SAID_DISJOINT), *(("conflicting-assertion", focus, p, target, HOLDS) for p in (left, right))]
    return {
        "summary": f"inconsistent: {summary}",
        "violated_constraint": kind,
        "focus_resource": focus,
        "primary_conflicting_term": left,
        "secondary_conflicting_term": right,
        "blame": dict(zip(("heuristic", "principal_contributor", "principal_origin", "contextual_contributor", "contextual_origin"), blame)),
        "evidence": [dict(zip(("role", "subject", "predicate", "object", "origin"), e)) for e in evidence],
    }


#: Scores of an inserted triple against a rejection (fixed values).
EVIDENCE_SCORES = {"conflicting-assertion": 300, "conflicting-type": 300, "constraint-axiom": 220, "constraint-declaration": 200}
OTHER_EVIDENCE = 150
MOST_CANDIDATES = 5


def attribution(reject: dict, inserted: DataFrame) -> DataFrame:
    """(s, p, o, score): the inserted triples that most likely caused a rejection, five at most."""
    score = F.lit(0)
    s, p, o = F.col("s"), F.col("p"), F.col("o")
    for e in reject["evidence"]:
        hit = (s == e["subject"]) & (p == e["predicate"]) & (o == e["object"])
        score = score + F.when(hit, EVIDENCE_SCORES.get(e["role"], OTHER_EVIDENCE)).otherwise(0)
    blame = reject["blame"]
    for test, points in (
        (s == reject["focus_resource"], 100),
        (o == reject["focus_resource"], 90),
        ((p == v.TYPE) & (o == reject["primary_conflicting_term"]), 80),
        ((p == v.TYPE) & (o == reject["secondary_conflicting_term"]), 70),
        (o == blame["principal_contributor"], 60),
        (o == blame["contextual_contributor"], 50),
    ):
        score = score + F.when(test, points).otherwise(0)
    return inserted.select("s", "p", "o", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "s", "p", "o").limit(MOST_CANDIDATES)
