"""Rules and detectors, each on a few triples."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quadloom import queries, session
from quadloom import vocab as v
from quadloom.operators.closure import components, reachable, transitive_closure
from quadloom.reasoner import consistency, rules
from quadloom.reasoner.policy import PRESETS, Policy, capabilities
from quadloom.reasoner.rules import Snapshot
from quadloom.reasoner.service import Reasoner, infer

T = v.TYPE


@pytest.fixture(params=["driver", "tables"])
def size(request, monkeypatch):
    """With axioms on the driver, and with tables of them."""
    if request.param == "tables":
        monkeypatch.setattr(rules, "FEW", -1)


def run(spark, triples, policy=Policy()):
    return infer(Snapshot.of_triples(spark.createDataFrame([tuple(f"e:{x}" if ":" not in x else x for x in t) for t in triples], "s string, p string, o string")), policy)


def derived(found):
    return {tuple(x.removeprefix("e:") for x in r) for r in found.derived.collect()}


def test_subclasses_and_types(spark):
    found = run(spark, [("Child", v.SUB_CLASS, "Parent"), ("Parent", v.SUB_CLASS, "Anc"), ("al", T, "Child")])
    assert derived(found) == {("Child", v.SUB_CLASS, "Anc"), ("al", T, "Parent"), ("al", T, "Anc")}
    assert found.consistency_violations == 0 and found.primary_reject is None
    s = found.stats
    assert (s["supported_asserted_triples"], s["subclass_edge_count"], s["type_assertion_count"], s["taxonomy_node_count"]) == (3, 2, 1, 3)


def test_property_rules(spark, size):
    found = run(
        spark,
        [
            ("friend", v.SUB_PROPERTY, "knows"), ("friend", T, v.SYMMETRIC), ("likes", v.DOMAIN, "Person"), ("likes", v.RANGE, "Doc"), ("part", T, v.TRANSITIVE), ("owns", v.INVERSE_OF, "ownedBy"),
            ("a", "friend", "b"), ("a", "likes", "d"), ("x", "part", "y"), ("y", "part", "z"), ("a", "owns", "d"),
            ("uncle", v.CHAIN, "l1"), ("l1", v.FIRST, "parent"), ("l1", v.REST, "l2"), ("l2", v.FIRST, "brother"), ("l2", v.REST, v.NIL), ("a", "parent", "p"), ("p", "brother", "u"),
        ],
    )
    expected = {("b", "friend", "a"), ("a", "knows", "b"), ("b", "knows", "a"), ("a", T, "Person"), ("d", T, "Doc"), ("x", "part", "z"), ("d", "ownedBy", "a"), ("a", "uncle", "u")}
    assert derived(found) == expected


def test_reflexive_and_gates(spark):
    triples = [("near", T, v.REFLEXIVE), ("a", "knows", "b")]
    assert {("a", "near", "a"), ("b", "near", "b")} <= derived(run(spark, triples))
    assert derived(run(spark, triples, PRESETS["rdfs-core"])) == set()


def test_equality(spark):
    found = run(spark, [("al", v.SAME_AS, "alicia"), ("alicia", T, "Person"), ("al", "knows", "bob")])
    assert {("al", T, "Person"), ("alicia", "knows", "bob")} <= derived(found) and found.stats["equality_cluster_count"] == 1
    found = run(spark, [("p", T, v.FUNCTIONAL), ("al", "p", "one"), ("al", "p", "two"), ("q", T, v.INVERSE_FUNCTIONAL), ("m", "q", "id"), ("n", "q", "id"), ("n", T, "C")])
    assert {("one", v.SAME_AS, "two"), ("m", v.SAME_AS, "n"), ("m", T, "C")} <= derived(found) and found.consistency_violations == 0
    assert found.stats["inferred_equality_link_count"] == 2


@pytest.mark.parametrize(
    "triples,constraint,focus",
    [
        ([("Bad", v.SUB_CLASS, v.NOTHING), ("x", T, "Bad")], "owl:Nothing", "e:x"),
        ([("A", v.DISJOINT_WITH, "B"), ("C", v.SUB_CLASS, "A"), ("x", T, "C"), ("x", T, "B")], "owl:disjointWith", "e:x"),
        ([("x", v.SAME_AS, "y"), ("x", v.DIFFERENT_FROM, "y")], "owl:differentFrom", "e:x"),
        ([("p", T, v.IRREFLEXIVE), ("x", "p", "x")], "owl:IrreflexiveProperty", "e:x"),
        ([("p", T, v.ASYMMETRIC), ("x", "p", "y"), ("y", "p", "x")], "owl:AsymmetricProperty", "e:x"),
        ([("p", v.PROPERTY_DISJOINT, "q"), ("x", "p", "y"), ("x", "q", "y")], "owl:propertyDisjointWith", "e:x"),
    ],
    ids=["nothing", "disjoint", "different", "irreflexive", "asymmetric", "property-disjoint"],
)
def test_detectors(spark, triples, constraint, focus):
    found = run(spark, triples)
    assert found.consistency_violations == 1
    reject = found.primary_reject
    assert reject["violated_constraint"] == constraint and reject["focus_resource"] == focus and reject["evidence"]
    assert run(spark, triples[:-1]).consistency_violations == 0


def test_groups_lists_and_diagnostics(spark, size):
    found = run(
        spark,
        [
            ("g", T, v.ALL_DISJOINT_CLASSES), ("g", v.MEMBERS, "l1"), ("l1", v.FIRST, "A"), ("l1", v.REST, "l2"), ("l2", v.FIRST, "B"), ("l2", v.REST, v.NIL), ("x", T, "A"), ("x", T, "B"),
            ("h", T, v.ALL_DIFFERENT), ("h", v.DISTINCT_MEMBERS, "m1"), ("m1", v.FIRST, "x"), ("m1", v.REST, "m1"),
            ("c", v.CHAIN, "k1"), ("k1", v.FIRST, "p"), ("k1", v.REST, v.NIL), ("R", v.OWL + "unionOf", "l1"),
        ],
    )
    assert found.primary_reject["violated_constraint"] == "owl:disjointWith"
    said = "\n".join(found.diagnostics)
    assert "owl:AllDifferent of <e:h> is left out" in said and rules.RING in said and "it has 1 members where two" in said and "no rule reads owl:unionOf" in said


def test_lists_of_any_kind(spark):
    """Lists as the driver reads them and as tables do: well-formed, empty, broken, branching, ringed, shared tails."""
    rnd = random.Random(3)
    firsts, rests, heads = set(), set(), ["nowhere", v.NIL]
    for k in range(40):
        n = rnd.choice([1, 2, 3, 7, 8, 9, 31])
        cells = [f"c{k}/{i}" for i in range(n)]
        heads.append(cells[0])
        for i, c in enumerate(cells):
            firsts.add((c, f"m{rnd.randrange(5)}"))
            rests.add((c, cells[i + 1] if i + 1 < n else rnd.choice([v.NIL, v.NIL, v.NIL, "c0/0", cells[n // 2], "lost"])))
        if k % 7 == 3:
            firsts.add((cells[-1], "another"))
        if k % 9 == 4:
            rests.add((cells[n // 3], "c1/0"))
        if k % 11 == 5:
            firsts -= {x for x in firsts if x[0] == cells[n // 2]}
    both = {}
    for place, some in enumerate((firsts, rests)):
        for n, x in some:
            both.setdefault(n, (set(), set()))[place].add(x)
    expected = {h: rules.read_list(both, h) for h in heads}
    assert len({r for _, r in expected.values()}) >= 5
    frame = lambda rows: spark.createDataFrame(sorted(rows), "n string, x string")
    members, broken = rules.read_lists(frame(firsts), frame(rests), spark.createDataFrame([(h,) for h in heads], "head string"))
    assert {r["head"]: r["reason"] for r in broken.collect()} == {h: reason for h, (_, reason) in expected.items() if reason}
    found = {}
    for r in members.orderBy("head", "k").collect():
        found.setdefault(r["head"], []).append(r["member"])
    assert found == {h: m for h, (m, reason) in expected.items() if not reason}


def test_many_axioms(spark):
    """Over 100,000 axioms: a class for each number under the one of half of it, one of them disjoint with another."""
    n = 110_000
    axioms = spark.range(1, n).select(F.concat(F.lit("C"), F.col("id")).alias("s"), F.lit(v.SUB_CLASS).alias("p"), F.concat(F.lit("C"), F.floor(F.col("id") / 2)).alias("o"))
    facts = spark.createDataFrame([("x", T, f"C{n - 1}"), ("C2", v.DISJOINT_WITH, "C3"), ("y", T, "C4"), ("y", T, "C6")], rules.TRIPLE)
    triples = axioms.union(facts)
    schema = rules.Schema.of(triples, Policy())
    assert not schema.sub_class.few and schema.sub_class.count() == n - 1
    found = rules.identity(triples, schema, Policy(), rules.observed_resources(triples))
    types = rules.effective_types(triples, found, schema, Policy())
    up, k = {"C0"}, n - 1
    while k:
        up.add(f"C{k}")
        k //= 2
    assert {r["c"] for r in types.where("i = 'x'").collect()} == up
    assert [(r["focus"], r["left"], r["right"]) for r in consistency.disjoint(types, schema).collect()] == [("y", "C2", "C3")]
    assert rules.derived_axioms(schema, Policy(), spark).count() == sum(max(0, k.bit_length() - 1) for k in range(1, n))


def test_snapshot_coverage(spark):
    rows = [("<e:a>", "<e:p>", "<e:b>", ""), ("<e:a>", "<e:p>", '"x"', ""), ("_:n", "<e:p>", '"x"', ""), ("<e:a>", "<e:p>", "_:n", "<e:g>")]
    c = Snapshot.of(spark.createDataFrame(rows, "s string, p string, o string, g string")).coverage
    assert c == {"supported": 1, "unsupported": 3, "bnode_subjects": 1, "bnode_objects": 1, "literal_objects": 1, "flattened_named_graph_quads": 1}


def test_service(spark):
    snapshot = Snapshot.of_triples(spark.createDataFrame([("e:C", v.SUB_CLASS, "e:D"), ("e:x", T, "e:C")], rules.TRIPLE))
    assert Reasoner().run(snapshot).status == Reasoner("owl-dl-target").run(snapshot).status == "skipped"
    r = Reasoner("rules-mvp")
    first, second = r.run(snapshot), r.run(snapshot)
    assert first.status == "completed" and not first.cache["execution_cache_hit"] and second.cache["execution_cache_hit"]
    assert Policy().preset == "bounded-owl" and len(capabilities("rules-mvp", Policy())) == 8
    with pytest.raises(ValueError):
        Reasoner("other")


def test_fixpoints_against_plain_python(spark):
    rnd = random.Random(1)
    for n, m in ((6, 9), (25, 30)):
        edges = {(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)}
        expected = {(int(a), int(b)) for a, b in rules.closed({(str(a), str(b)) for a, b in edges})}
        df = spark.createDataFrame(sorted(edges), "s int, o int")
        assert {tuple(r) for r in transitive_closure(df).collect()} == expected
        seeds = spark.createDataFrame([(0,)], "n int")
        assert {r.n for r in reachable(df, seeds).collect()} == {0} | {b for a, b in expected if a == 0}
        parent = list(range(n))
        for _ in range(n):
            for a, b in edges:
                parent[a] = parent[b] = min(parent[a], parent[b])
        touched = {x for a, b in edges if a != b for x in (a, b)}
        assert {r.member: r.canonical for r in components(df, "s", "o").collect()} == {x: parent[x] for x in touched}


def shuffled(spark):
    """Bytes of shuffles that the session has written so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    time.sleep(0.3)  # figures of executors are published every 0.1 s, with the next task
    spark.range(4).rdd.count()
    sc.listenerBus().waitUntilEmpty(30_000)
    executors = sc.statusStore().executorList(True)
    return sum(executors.apply(k).totalShuffleWrite() for k in range(executors.size()))


def test_transitive_pairs_travel_few_times(spark):
    """In a tree each pair is made once, so what is shuffled stays a few times the pairs."""
    n = 20_000
    tree = spark.range(1, n).select(F.concat(F.lit("c/"), F.col("id")).alias("s"), F.lit("under").alias("p"), F.concat(F.lit("c/"), F.floor(F.col("id") / 2)).alias("o"))
    triples = tree.union(spark.createDataFrame([("under", T, v.TRANSITIVE)], rules.TRIPLE))
    schema = rules.Schema.of(triples, Policy())
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables that are too large to be sent to all tasks
    before = shuffled(spark)
    facts = rules.close_assertions(rules.property_assertions(triples), schema, Policy())
    moved = shuffled(spark) - before
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert facts.distinct().count() == facts.count() == sum(k.bit_length() for k in range(1, n))
    start = shuffled(spark)
    facts.repartition(4).write.format("noop").mode("overwrite").save()
    assert moved < 4.5 * (shuffled(spark) - start)


def test_transitive_with_other_rules(spark):
    """Paths beside rules that feed them and rules that they feed, against a plain fixpoint."""
    rnd = random.Random(5)
    axioms = [("up", T, v.TRANSITIVE), ("near", T, v.TRANSITIVE), ("near", T, v.SYMMETRIC), ("step", v.SUB_PROPERTY, "up"), ("down", v.INVERSE_OF, "up"), ("up", v.CHAIN, "l1"), ("l1", v.FIRST, "up"), ("l1", v.REST, "l2"), ("l2", v.FIRST, "jump"), ("l2", v.REST, v.NIL)]
    facts = {(f"n{rnd.randrange(14)}", rnd.choice(["step", "step", "up", "down", "near", "jump"]), f"n{rnd.randrange(14)}") for _ in range(16)}
    expected, last = set(facts), None
    while expected != last:
        last = set(expected)
        for s, p, o in last:
            expected |= {(s, "up", o)} if p == "step" else {(o, {"up": "down", "down": "up"}[p], s)} if p in ("up", "down") else {(o, p, s)} if p == "near" else set()
            expected |= {(s, p, y) for x, q, y in last if x == o and (p == q and p in ("up", "near") or (p, q) == ("up", "jump"))}
    triples = spark.createDataFrame(sorted(facts) + axioms, rules.TRIPLE)
    closed = rules.close_assertions(rules.property_assertions(triples).distinct(), rules.Schema.of(triples, Policy()), Policy())
    assert sorted(tuple(r) for r in closed.collect()) == sorted(expected)


def test_large_facts_are_dealt_to_small_tasks(spark, sf, monkeypatch):
    """The tasks that make facts different and that find conflicts of groups grow in number with the input, not in size."""
    few = {tuple(r) for r in queries.QUERIES["owl_all_disjoint_properties"](spark, sf).collect()}
    monkeypatch.setattr(session, "TASK_BYTES", 2_000)
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    facts = queries.bare(li, queries.res("part", "l_partkey"), "flag", queries.res("supplier", "l_suppkey"))
    n = session.tasks_for(facts)
    _, _, found, _ = queries.closed(facts, [])
    assert n > 20 and len(found.facts.inputFiles()) >= n / 2
    assert {tuple(r) for r in queries.QUERIES["owl_all_disjoint_properties"](spark, sf).collect()} == few and few
