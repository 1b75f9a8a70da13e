"""The protocol endpoint, and the tools that compare and measure."""

import json
import time

import pytest

from quadloom import harness as h
from quadloom.reasoner.service import Reasoner
from quadloom.service.endpoint import Endpoint, graph_target
from quadloom.service.rules import Access, Config, Limits, Problem, Rates
from quadloom.sources import rdf
from quadloom.store.store import QuadStore

TURTLE = {"Content-Type": "text/turtle"}


def test_endpoint(spark, tmp_path):
    service = Endpoint(QuadStore(spark, str(tmp_path / "s")), Reasoner("rules-mvp"))
    go = service.handle
    assert go("GET", "/healthz").status == 200 and go("GET", "/nowhere").status == 404
    assert go("PUT", "/dataset/data", "graph=http%3A%2F%2Fe%2Fg", TURTLE, b"<a:b> <c:d> 1 .").status == 201
    assert go("PUT", "/dataset/data", "graph=http%3A%2F%2Fe%2Fg", TURTLE, b"<a:b> <c:d> 2 .").status == 200
    assert go("POST", "/dataset/data", "default", TURTLE | {"Content-Location": "http://b/"}, b"<x> a <Y> .").status == 204
    read = go("GET", "/dataset/data", "", {"Accept": "application/n-triples"})
    assert "<http://b/x>" in read.text() and go("HEAD", "/dataset/data").text() == ""
    assert go("POST", "/dataset/data", "", {"Content-Type": "text/csv"}, b"a").status == 400
    bindings = go("GET", "/dataset/query", "query=SELECT%20%3Fs%20%7B%20%3Fs%20%3Fp%20%3Fo%20%7D").text()
    assert h.canonical_bindings(bindings) == {"s=uri|||http://b/x"}
    assert go("POST", "/dataset/query", "", {"Accept": "text/csv"}, b"ASK { ?s ?p ?o }").text() == "true"
    for bad in (b"SELECT WHERE {", b" "):
        answer = go("POST", "/dataset/query", "", {}, bad)
        assert (answer.status, answer.media) == (400, "application/problem+json")
    assert go("POST", "/dataset/update", "", {"Content-Type": "application/json"}, b"CLEAR ALL").status == 400
    owl = "PREFIX o: <http://www.w3.org/2002/07/owl#> INSERT DATA { <e:A> o:disjointWith <e:B> . <e:x> a <e:A> }"
    assert go("POST", "/dataset/update", "", {}, owl.encode()).status == 204
    refused = go("POST", "/dataset/tell", "", TURTLE, b"<e:x> a <e:B> .")
    document = json.loads(refused.text())
    assert refused.status == 400 and document["type"].endswith("reasoner-reject") and document["reasoner_reject"]["likely_triggers"][0]["o"] == "e:B"
    seen = json.loads(go("GET", "/ops/api/diagnostics/reasoning").text())
    assert seen["last_run"]["status"] == "rejected" and len(seen["last_run"]["stats"]) == 18 and len(seen["last_run"]["cache"]) == 10
    assert "quadloom_reasoner_schema_cache_misses_total" in go("GET", "/metrics").text()
    assert json.loads(go("GET", "/dataset/info").text())["revision"] == service.store.revision
    assert len(rdf.parse_turtle(go("GET", "/dataset/service-description").text(), "http://s/")) >= 14
    assert go("POST", "/dataset/tell", "", {"Content-Type": "application/n-triples"}, b"<a:b> <c:d> .").status == 400
    backup = go("GET", "/ops/api/admin/dataset/backup")
    text = backup.text().encode()
    assert go("DELETE", "/dataset/data", "graph=http%3A%2F%2Fe%2Fg").status == 204 and service.store.stats()["named_graph_count"] == 0
    sent = {"Content-Type": "application/n-quads", "X-Backup-Sha256": backup.headers["x-backup-sha256"]}
    assert go("POST", "/ops/api/admin/dataset/restore", "", sent, text + b"\n").status == 400
    assert json.loads(go("POST", "/ops/api/admin/dataset/restore", "", sent, text).text())["quad_count"] == int(backup.headers["x-backup-quad-count"])
    assert service.store.stats()["named_graph_count"] == 1
    assert go("DELETE", "/dataset/data", "graph=http%3A%2F%2Fe%2Fg").status == 204 and go("DELETE", "/dataset/data", "graph=x").status == 400


def test_rules(spark, tmp_path):
    store = QuadStore(spark, str(tmp_path / "s"))
    closed = Endpoint(store, config=Config(posture="read-only-demo"))
    assert closed.handle("POST", "/dataset/update", "", {}, b"CLEAR ALL").status == 404
    with pytest.raises(ValueError):
        Endpoint(store, config=Config(posture="internal-authenticated"))
    guarded = Endpoint(store, config=Config(access=Access(("r",), ("a",)), limits=Limits(query=40, read=3)))
    ask = lambda token, method="POST", path="/dataset/query", body=b"ASK {}": guarded.handle(method, path, "", {"Authorization": token} if token else {}, body).status
    assert [ask(None), ask("Bearer no"), ask("Bearer r"), ask("Bearer r", path="/dataset/update", body=b"CLEAR ALL")] == [401, 401, 200, 403]
    assert ask("Bearer a", body=h.padded("query", 41).encode()) == 413 and ask("Bearer a") == 200 and ask("Bearer a") == 429
    now = [0.0]
    rates = Rates(Limits(write=1), lambda: now[0])
    rates.count("write")
    with pytest.raises(Problem):
        rates.count("write")
    now[0] = 60.0
    rates.count("write")
    assert graph_target("") == graph_target("default") == "" and graph_target("graph=e%3Ag") == "e:g"
    for bad in ("graph=a:b&graph=c:d", "default&graph=a:b", "graph="):
        with pytest.raises(Problem):
            graph_target(bad)


def test_timeouts(spark, tmp_path):
    store = QuadStore(spark, str(tmp_path / "s"))
    hasty = Endpoint(store, config=Config(limits=Limits(read_seconds=0.001, write_seconds=0.001)))
    assert hasty.handle("POST", "/dataset/query", "", {}, b"ASK { ?s ?p ?o }").status == 408
    assert hasty.handle("POST", "/dataset/update", "", {}, b"INSERT DATA { <e:a> <e:p> 1 }").status == 408
    time.sleep(8)
    assert store.revision == 0 and store.stats()["is_empty"]
    patient = Endpoint(store, config=Config(limits=Limits(read_seconds=300, write_seconds=300)))
    assert patient.handle("POST", "/dataset/update", "", {}, b"INSERT DATA { <e:a> <e:p> 1 }").status == 204
    assert patient.handle("POST", "/dataset/query", "", {"Accept": "text/csv"}, b"ASK { ?s ?p ?o }").text() == "true"


def test_harness(spark):
    ring = lambda names: [(names[k], "<e:p>", names[(k + 1) % len(names)]) for k in range(len(names))]
    a, b = ring(["_:a", "_:b", "_:c", "_:d"]), ring(["_:x", "_:q", "_:m", "_:n"])
    assert h.canonical_graph(a) == h.canonical_graph(b) and h.canonical_graph(a) != h.canonical_graph(ring(["_:a", "_:b"]) + ring(["_:c", "_:d"]))
    assert h.canonical_graph([("_:a", "<e:p>", '"1"')]) != h.canonical_graph([("_:a", "<e:p>", '"2"')])
    left, right = (spark.createDataFrame([(x,) for x in xs], "k string") for xs in (["a", "a", None], ["a", None, "b"]))
    found = h.compare_frames(left, right)
    assert (found.matched, found.left_only, found.right_only) == (False, [("a",)], [("b",)]) and h.compare_frames(left, left).matched
    assert h.compare_frames(left.limit(0), right.limit(0)).matched
    assert h.compare_sets({"a"}, {"a", "b"}).right_only == ["b"]
    assert h.percentile([1, 2, 3, 4], 50) == 2 and h.percentile([1, 2, 3, 4], 99) == 3 and h.percentile([], 50) == 0
    ran = h.measured(lambda: None, 3, 2)
    assert (ran["samples"], ran["failure"]) == (6, 0) and h.measured(lambda: 1 / 0, 2)["failure"] == 2
    assert json.loads(h.report({"x": found, "y": ran}))["x"]["matched"] is False
    assert len(h.padded("turtle", 100)) == 100 and rdf.parse_turtle(h.padded("turtle", 100)) and h.media_kind("text/turtle; x", b"a") == "rdf"
    with pytest.raises(ValueError):
        h.canonical_bindings("{}")
