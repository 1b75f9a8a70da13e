"""Readers, writers, the store and its gate."""

import json

import pytest

from quadloom.plans.parser import SparqlSyntaxError
from quadloom.reasoner.service import Reasoner
from quadloom.sinks import results
from quadloom.sources import rdf
from quadloom.store import state as st
from quadloom.store.gate import Gate, ReasonerReject
from quadloom.store.store import ConflictError, QuadStore
from quadloom import vocab as v

XML = f"""<?xml version="1.0"?><rdf:RDF xmlns:rdf="{v.RDF}" xmlns:q="e:" xml:base="http://b/">
<q:T rdf:about="x" q:a="1"><q:l xml:lang="EN">hi</q:l><q:r rdf:resource="#f"/><q:n rdf:datatype="{v.XSD}int">5</q:n>
<q:c rdf:parseType="Collection"><rdf:Description rdf:about="e:m"/></q:c><q:k rdf:parseType="Resource"><q:z>9</q:z></q:k></q:T></rdf:RDF>"""


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_readers(spark, tmp_path):
    got = rdf.parse_turtle('@base <http://b/> . @prefix p: <e:> . <x> p:a "l\\n\\u00e9"@EN, """m"q""", true, -1.5, 2e3 ; a p:T . # c\n[] p:b _:n , () .', scope="s")
    assert ("<http://b/x>", "<e:a>", '"l\né"@en') in got and ("<http://b/x>", "<e:a>", '"m"q"') in got and ("_:sa1", "<e:b>", f"<{v.NIL}>") in got and len(got) == 8
    xml = rdf.parse_rdfxml(XML, scope="s")
    assert ("<http://b/x>", f"<{v.TYPE}>", "<e:T>") in xml and ("<http://b/x>", "<e:r>", "<http://b/#f>") in xml and ("<http://b/x>", "<e:l>", '"hi"@en') in xml and len(xml) == 10
    with pytest.raises(rdf.RdfSyntaxError):
        rdf.parse_turtle("<a:b> <c:d> .")
    with pytest.raises(ValueError):
        rdf.format_of("x.json")
    (tmp_path / "a.nq").write_text('<a:s> <a:p> "x\\ty\\"z"^^<http://www.w3.org/2001/XMLSchema#string> <a:g> .\n# no\n\n_:b <a:p> "v"@EN . # yes\n')
    quads = rdf.read(spark, str(tmp_path / "a.nq")).collect()
    assert {(r.p, r.o, r.g) for r in quads} == {("<a:p>", '"x\ty"z"', "<a:g>"), ("<a:p>", '"v"@en', "")}
    (tmp_path / "t.ttl").write_text("<s> <a:p> 1 .")
    assert rdf.read(spark, str(tmp_path / "t.ttl"), graph="e:g").first().g == "<e:g>"
    with pytest.raises(rdf.RdfSyntaxError, match="not a statement"):
        rdf.parse_payload(spark, "<a:b> <c:d> .", "ntriples")
    assert rdf.parse_payload(spark, '<a:b> <c:d> "x\u2028\x85y" .\r\n', "ntriples").first().o == '"x\u2028\x85y"'


def test_writers(spark):
    triples = spark.createDataFrame([("<e:s>", "<e:p>", '"a\n"q"@en'), ("<e:s>", f"<{v.TYPE}>", "<e:T>"), ("_:b", "<e:p>", f'"1"^^<{v.XSD_INTEGER}>')], "s string, p string, o string")
    text = "".join(results.graph(triples))
    assert '<e:s> <e:p> "a\\n\\"q"@en .' in text
    again = rdf.parse_payload(spark, text, "ntriples", scope="")
    assert rows(again.select("s", "p", "o")) == rows(triples)
    turtle = "".join(results.graph(triples, "turtle"))
    assert sorted(t[1:] for t in rdf.parse_turtle(turtle, scope="")) == sorted(t[1:] for t in rows(triples))
    xml = "".join(results.graph(triples, "rdfxml"))
    assert len(rdf.parse_rdfxml(xml)) == 3
    solutions = spark.createDataFrame([("<e:a>", '"x,y"'), (None, '"z"@en')], "a string, b string").coalesce(1)
    parsed = json.loads("".join(results.solutions(solutions, "json")))
    assert parsed["results"]["bindings"][0] == {"a": {"type": "uri", "value": "e:a"}, "b": {"type": "literal", "value": "x,y"}}
    assert "".join(results.solutions(solutions, "csv")) == 'a,b\r\ne:a,"x,y"\r\n,z\r\n'
    assert "".join(results.solutions(solutions, "tsv")) == '?a\t?b\n<e:a>\t"x,y"\n\t"z"@en\n'
    assert "<uri>e:a</uri>" in "".join(results.solutions(solutions, "xml"))
    assert json.loads(results.boolean(True))["boolean"] is True and results.boolean(False, "csv") == "false"
    assert results.negotiate("application/sparql-results+json, text/csv") == "csv" and results.negotiate(None, True) == "ntriples"


def test_store(spark, tmp_path):
    store = QuadStore(spark, str(tmp_path / "s"))
    assert store.revision == 0 and store.stats()["is_empty"]
    assert store.update("INSERT DATA { <e:a> <e:p> <e:b> }") == 1
    with pytest.raises(SparqlSyntaxError):
        store.update("INSERT DATA { <e:a> }")
    assert store.revision == 1
    report = store.write_graph("<e:x> <e:p> 1 .", "turtle", "e:g")
    assert report.created and report.revision == 2 and not store.write_graph("<e:y> <e:p> 2 .", "turtle", "e:g", replace=False).created
    assert store.read_graph("e:g").count() == 2 and store.stats()["named_graph_count"] == 1
    assert store.engine(1).select("SELECT * { ?s ?p ?o }").count() == 1
    with pytest.raises(ValueError):
        store.delete_graph("no iri")
    with store.writer(), pytest.raises(ConflictError):
        store.update("CLEAR ALL")
    backup = store.export(str(tmp_path / "b"))
    store.delete_graph("e:g")
    assert store.stats()["quad_count"] == 1 and store.read_graph("e:none").count() == 0
    with pytest.raises(ValueError):
        store.restore(str(tmp_path / "b"), "0")
    assert store.restore(str(tmp_path / "b"), backup["sha256"])["quad_count"] == 3 and "quadloom_quads 3" in store.metrics()


def test_writers_that_die_and_writers_that_meet(spark, tmp_path):
    store = QuadStore(spark, str(tmp_path / "s"))
    with pytest.raises(ZeroDivisionError), store.writer(lease=-1.0):
        store.files.write("LOCK", json.dumps({"owner": "dead", "until": 0}))  # it never lets go
        1 / 0
    assert store.update("INSERT DATA { <e:a> <e:p> 1 }") == 1

    def meanwhile(x):
        other = QuadStore(spark, str(tmp_path / "s"))
        other._publish(other.state().inserted(spark.createDataFrame([("<e:o>", "<e:p>", "<e:q>", "")], rdf.QUADS)), other.revision + 1)
        return x.cleared("")

    with pytest.raises(ConflictError):
        store.mutate(meanwhile)
    assert store.revision == 2 and store.stats()["quad_count"] == 2
    store.files.write("HEAD", json.dumps({"revision": 1}))  # as if the last writer had died before it
    assert store.revision == 2 and store.update("CLEAR ALL") == 3


def test_inferred_engine(spark, tmp_path):
    store = QuadStore(spark, str(tmp_path / "s"))
    store.update(f"INSERT DATA {{ <e:x> a <e:A> . <e:A> <{v.SUB_CLASS}> <e:B> }}")
    ask = "ASK { <e:x> a <e:B> }"
    assert not store.engine().ask(ask) and store.inferred_engine(Reasoner("rules-mvp")).ask(ask) and not store.inferred_engine(Reasoner()).ask(ask)
    assert store.stats()["quad_count"] == 2


def test_gate(spark, tmp_path):
    store, gate = QuadStore(spark, str(tmp_path / "s")), Gate(Reasoner("rules-mvp"))
    store.update("PREFIX o: <%s> PREFIX : <e:> INSERT DATA { :A o:disjointWith :B . :x a :A }" % v.OWL, gate)
    with pytest.raises(ReasonerReject) as x:
        store.update("INSERT DATA { <e:x> a <e:B> . <e:q> <e:p> <e:r> }", gate)
    assert store.revision == 1 and store.stats()["quad_count"] == 2
    best = x.value.candidates[0]
    assert (best["s"], best["o"], best["score"]) == ("e:x", "e:B", 300 + 100 + 70 + 50)
    assert gate.last.report.status == "rejected"


def test_graph_updates(spark):
    empty = st.State.empty(spark)
    full = st.apply(empty, "CREATE GRAPH <e:e> ; INSERT DATA { GRAPH <e:g> { <e:a> <e:p> 1 } <e:a> <e:p> 2 }")
    assert rows(full.graphs) == [("<e:e>",), ("<e:g>",)]
    cleared = st.apply(full, "CLEAR GRAPH <e:g>")
    assert rows(cleared.graphs) == [("<e:e>",), ("<e:g>",)] and cleared.quads.count() == 1
    assert rows(st.apply(full, "DROP NAMED").graphs) == []
    with pytest.raises(st.GraphError):
        st.apply(full, "DROP GRAPH <e:no>")
    assert st.apply(full, "DROP SILENT GRAPH <e:no>").quads.count() == 2
    with pytest.raises(st.GraphError):
        st.apply(full, "CREATE GRAPH <e:g>")
    moved = st.apply(full, "WITH <e:g> DELETE { ?s ?p ?o } INSERT { ?s <e:q> ?o } WHERE { ?s ?p ?o }")
    assert ("<e:a>", "<e:q>", f'"1"^^<{v.XSD_INTEGER}>', "<e:g>") in rows(moved.quads) and moved.quads.count() == 2
    used = st.apply(full, "INSERT { <e:n> <e:v> ?o } USING <e:g> WHERE { ?s ?p ?o }")
    assert used.quads.where("s = '<e:n>'").count() == 1
