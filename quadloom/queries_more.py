"""More queries over the test tables: readers, writers, the store, the reasoner's service, the protocol and the harness."""

from __future__ import annotations

import json
import uuid
import xml.etree.ElementTree as ET
from dataclasses import fields, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom import harness, session
from quadloom import vocab as v
from quadloom.plans.compiler import Engine
from quadloom.plans.parser import parse_query, parse_update
from quadloom.queries import _N, _NAME, _NATIONS, _X, BASE, PREFIX, bare, closed, dataset, documents_by_language, frame, in_store, iri, nations, query, sparql, stored, update
from quadloom.reasoner import consistency
from quadloom.reasoner.policy import PRESETS, Policy, capabilities
from quadloom.reasoner.rules import Snapshot
from quadloom.reasoner.service import Reasoner, infer
from quadloom.service.endpoint import Endpoint, graph_target
from quadloom.service.rules import Access, Config, Limits, Problem
from quadloom.sinks import results
from quadloom.sources import rdf
from quadloom.sources.dataset import QuadDataset
from quadloom.store import state as st
from quadloom.store.gate import Gate, ReasonerReject
from quadloom.store.state import GraphError
from quadloom.store.store import ConflictError, QuadStore


def own_path(spark, name: str) -> str:
    path = f"{session.shared_folder(spark)}/quadloom-{name.replace('.', f'-{uuid.uuid4().hex}.')}"
    session.delete_at_end(spark, path)
    return path


def values(*rows: tuple) -> str:
    """Rows as a VALUES list of SQL."""
    cell = lambda x: "null" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)


def outcome(run, *errors: type[Exception]) -> str:
    """What a call does: 'ok', or the name of the error."""
    try:
        run()
        return "ok"
    except errors as x:
        return type(x).__name__


# --- expressions and forms ----------------------------------------------------------

sparql(
    "sparql_fn_logic",
    'SELECT ?p (!(?s > 10) AS ?no) (IF(?s - 1, "some", "none") AS ?ebv) (IF(STRAFTER(?b, "1"), "t", "f") AS ?text) (?s NOT IN (1, 2, 3) AS ?out) (?s + 5 AS ?plus) (?s * 3 AS ?times) (+?s AS ?pos) WHERE { ?p ex:p_size ?s ; ex:p_brand ?b }',
    f"select {iri('p_partkey', 'part')} as p, not p_size > 10 as no, case when p_size <> 1 then 'some' else 'none' end as ebv, case when contains(p_brand, '1') and instr(p_brand, '1') < length(p_brand) then 't' else 'f' end as text, p_size not in (1, 2, 3) as out, p_size + 5 as plus, p_size * 3 as times, p_size as pos from part",
    "part",
)
sparql(
    "sparql_fn_casts",
    'SELECT ?p (xsd:double(xsd:decimal(?s) / 2) AS ?half) (YEAR(?t) AS ?y) (?t < "2000-01-01T00:00:00Z"^^xsd:dateTime AS ?old) (STR(TIMEZONE(?t)) AS ?zone) (xsd:date(?day) = ?day AS ?same) (STR(xsd:date(CONCAT(STR(1980 + ?s), "-02-03"))) AS ?d) (xsd:double(xsd:float(?s)) AS ?f) (BOUND(?bad) AS ?b) WHERE { ?p ex:p_size ?s BIND(xsd:dateTime(CONCAT(STR(1980 + ?s), "-02-03T04:05:06Z")) AS ?t) BIND(xsd:date("2001-02-03") AS ?day) BIND(xsd:dateTime("no date") AS ?bad) }',
    f"select {iri('p_partkey', 'part')} as p, p_size / 2 as half, 1980 + p_size as y, 1980 + p_size < 2000 as old, 'PT0S' as zone, true as same, (1980 + p_size) || '-02-03' as d, cast(p_size as double) as f, false as b from part",
    "part",
)
_SHA384 = "cb00753f45a35e8bb5a03d699ac65007272c32ab0eded1631a8b605a43ff5bed8086072ba1e7cc2358baeca134c825a7"
_SHA512 = "ddaf35a193617abacc417349ae20413112e6fa4e89a97ea20a9eeee64b55d39a2192992a274fc1a836ba3c23a3feebbd454d4423643ce80e2a9ac94fa54ca49f"
sparql(
    "sparql_fn_long_hashes",
    f'SELECT ?n (SHA384("abc") = "{_SHA384}" AS ?a) (SHA512("abc") = "{_SHA512}" AS ?b) (STRLEN(SHA384(?n)) AS ?c) (STRLEN(SHA512(?n)) AS ?d) (SHA384(?n) != SHA384(CONCAT(?n, "x")) AS ?e) WHERE {{ ?x ex:n_name ?n }}',
    "select n_name as n, true as a, true as b, 96 as c, 128 as d, true as e from nation",
    "nation",
)
sparql(
    "sparql_fn_fresh",
    'SELECT (COUNT(*) AS ?n) (COUNT(DISTINCT ?u) AS ?uuids) (COUNT(DISTINCT ?s) AS ?texts) (COUNT(DISTINCT ?b) AS ?blanks) (SUM(?ok) AS ?good) (COUNT(DISTINCT ?now) AS ?nows) WHERE { ?x ex:s_name ?name BIND(UUID() AS ?u) BIND(STRUUID() AS ?s) BIND(BNODE() AS ?b) BIND(RAND() AS ?r) BIND(NOW() AS ?now) BIND(IF(ISBLANK(?b) && REGEX(STR(?u), "^urn:uuid:[0-9a-f]{8}-") && STRLEN(?s) = 36 && ?r >= 0 && ?r < 1 && YEAR(?now) > 2000, 1, 0) AS ?ok) }',
    "select count(*) as n, count(*) as uuids, count(*) as texts, count(*) as blanks, cast(count(*) as bigint) as good, 1 as nows from supplier",
    "supplier",
)
sparql(
    "sparql_agg_distinct",
    "SELECT ?b (SAMPLE(?s) AS ?any) (SUM(DISTINCT ?s) AS ?total) (xsd:double(AVG(DISTINCT ?s)) AS ?mean) WHERE { ?p ex:p_brand ?b ; ex:p_size ?s } GROUP BY ?b",
    "select p_brand as b, min(p_size) as any, cast(sum(distinct p_size) as bigint) as total, round(avg(distinct p_size), 10) as mean from part group by 1",
    "part",
)
sparql("sparql_blank_nodes", "SELECT ?n ?r WHERE { [] ex:n_name ?n ; ex:n_regionkey _:r . _:r ex:r_name ?r }", "select n_name as n, r_name as r from nation join region on n_regionkey = r_regionkey", "nation", "region")
sparql("sparql_distinct_order_other", "SELECT DISTINCT ?s WHERE { ?c ex:c_mktsegment ?s ; ex:c_acctbal ?b } ORDER BY DESC(?b) LIMIT 3", "select c_mktsegment as s from customer group by 1 order by max(c_acctbal) desc limit 3", "customer")
sparql("sparql_optional_joined", "SELECT ?d ?q ?k WHERE { ?d ex:lang ?l OPTIONAL { ?d ex:quality ?q } { SELECT ?q (COUNT(*) AS ?k) WHERE { ?x ex:quality ?q } GROUP BY ?q } }", f"with k as (select quality as q, count(*) as k from labels group by 1) select {iri('doc_id', 'documents')} as d, k.q as q, k from documents left join labels using (doc_id) join k on quality is null or quality = k.q", "documents", "labels")
sparql("sparql_minus_unbound", "SELECT ?d ?q WHERE { ?d ex:lang ?l OPTIONAL { ?d ex:quality ?q } MINUS { ?x ex:toxic ?q } }", f"select {iri('doc_id', 'documents')} as d, quality as q from documents left join labels using (doc_id) where quality is null or quality not in (select toxic from labels where toxic is not null)", "documents", "labels")


@query("select '<http://ex.org/nation/' || n_nationkey || '>' as s, '<http://ex.org/label>' as p, '\"' || n_name || '\"' as o from nation order by n_name limit 7")
def sparql_construct_limit(spark, sf_dir):
    return Engine(dataset(spark, sf_dir, "nation")).construct(PREFIX + "CONSTRUCT { ?n ex:label ?l } WHERE { ?n ex:n_name ?l } ORDER BY ?l LIMIT 7")


@query(f"select {iri('n_nationkey', 'nation')} as x, n_name as a, r_name as b from nation join region on n_regionkey = r_regionkey")
def sparql_collections(spark, sf_dir):
    """Each nation's name and region as an RDF list of two, found by a collection in the pattern."""
    df = frame(spark, sf_dir, "nation").join(frame(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    key = F.col("n_nationkey").cast("string")
    node = lambda k: F.concat(F.lit(f"_:l{k}x"), key)
    text = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    triple = lambda s, p, o: F.struct(s.alias("s"), F.lit(f"<{p}>").alias("p"), o.alias("o"), F.lit("").alias("g"))
    rows = F.array(triple(F.concat(F.lit(f"<{BASE}nation/"), key, F.lit(">")), BASE + "pair", node(1)), triple(node(1), v.FIRST, text("n_name")), triple(node(1), v.REST, node(2)), triple(node(2), v.FIRST, text("r_name")), triple(node(2), v.REST, F.lit(f"<{v.NIL}>")))
    return Engine(QuadDataset(df.select(F.explode(rows).alias("x")).select("x.*"))).select(PREFIX + "SELECT ?x ?a ?b { ?x ex:pair (?a ?b) }", native=True)


@query("select '<http://ex.org/lang/' || lang || '>' as g, count(*) as n, min(n_chars) as least from (select distinct doc_id, n_chars, lang from documents where lang is not null) group by lang")
def sparql_graph_group(spark, sf_dir):
    """A variable over graphs round a pattern that is no plain triples: an OPTIONAL and a path in each graph."""
    text = PREFIX + "SELECT ?g (COUNT(?d) AS ?n) (MIN(?c) AS ?least) { GRAPH ?g { ?d ex:n_chars ?c OPTIONAL { ?d ex:none ?x } FILTER NOT EXISTS { ?d ex:none/ex:none ?y } } } GROUP BY ?g"
    found = Engine(documents_by_language(spark, sf_dir).dataset()).select(text)
    return found.select("g", F.regexp_extract("n", r"\d+", 0).cast("long").alias("n"), F.regexp_extract("least", r"\d+", 0).cast("long").alias("least"))


_REFUSED = [("SELECT WHERE { ?s ?p ?o }", "SparqlSyntaxError"), ("SELECT ?s { ?s ?p }", "SparqlSyntaxError"), ("ASK { ?s ?p ?o", "SparqlSyntaxError"), ("SELECT ?s { ?s x:p ?o }", "SparqlSyntaxError"), ("SELECT ?s ?s { ?s ?p ?o }", "SparqlSyntaxError"), ("SELECT * { SERVICE <e:s> { ?s ?p ?o } }", "UnsupportedError"), ("SELECT ?s { ?s a ?c }", "ok")]


@query(f"select * from (values {values(*_REFUSED)}) t(query, said)")
def sparql_refused(spark, sf_dir):
    return spark.createDataFrame([(q, outcome(lambda q=q: parse_query(q), ValueError)) for q, _ in _REFUSED], "query string, said string")


# --- updates ------------------------------------------------------------------------

update("update_graph_data", 'INSERT DATA { GRAPH ex:g { ex:x ex:p "1" . ex:y ex:p "2" } } ; DELETE DATA { GRAPH ex:g { ex:y ex:p "2" } }', f"{_NATIONS} union all select {_X}, '<{BASE}g>' as g")
update("update_with", 'COPY DEFAULT TO ex:g ; WITH ex:g DELETE { ?n ex:name ?l } INSERT { ?n ex:label ?l } WHERE { ?n ex:name ?l }', f"{_NATIONS} union all select {_N}, '<{BASE}label>', {_NAME}, '<{BASE}g>' from nation")
update("update_using", 'COPY DEFAULT TO ex:g ; CLEAR DEFAULT ; INSERT { ?n ex:label ?l } USING ex:g WHERE { ?n ex:name ?l }', f"select {_N} as s, '<{BASE}label>' as p, {_NAME} as o, '' as g from nation union all select {_N}, '<{BASE}name>', {_NAME}, '<{BASE}g>' from nation")

_ALL_GRAPHS = "COPY DEFAULT TO ex:g ; COPY DEFAULT TO ex:h ; CREATE GRAPH ex:e ; "
_MANAGED = {"CREATE GRAPH ex:f": "dghef", "DROP GRAPH ex:g": "dhe", "CLEAR GRAPH ex:g": "dhe+g", "CLEAR DEFAULT": "ghe", "CLEAR NAMED": "de+g+h", "CLEAR ALL": "e+g+h", "DROP DEFAULT": "ghe", "DROP NAMED": "d", "DROP ALL": "", "DROP SILENT GRAPH ex:no": "dghe"}


def _managed_rows() -> list[tuple[str, str, int]]:
    """(operation, graph, how many copies of the nations it has): d is the default graph, e and f are empty, + marks graphs that stay without quads."""
    out = []
    for op, left in _MANAGED.items():
        cleared = {left[k + 1] for k, c in enumerate(left) if c == "+"}
        out += [(op, "" if g == "d" else f"<{BASE}{g}>", int(g in "dgh" and g not in cleared)) for g in left.replace("+", "")]
    return out


@query(f"select op, g, copies * (select count(*) from nation) as n from (values {values(*_managed_rows())}) t(op, g, copies)")
def update_graph_management(spark, sf_dir):
    """What each operation leaves of the default graph, two copies of it and an empty graph."""
    full = st.apply(nations(spark, sf_dir), PREFIX + _ALL_GRAPHS.rstrip("; "))
    out = None
    for op in _MANAGED:
        after = st.apply(full, PREFIX + op)
        sizes = after.graphs.select("g").withColumn("n", F.lit(0)).union(after.quads.groupBy("g").agg(F.count(F.lit(1)).alias("n"))).groupBy("g").agg(F.max("n").alias("n"))
        one = sizes.select(F.lit(op).alias("op"), "g", F.col("n").cast("long").alias("n"))
        out = one if out is None else out.union(one)
    return out


_GRAPH_ERRORS = [("DROP GRAPH ex:no", "GraphError"), ("CLEAR GRAPH ex:no", "GraphError"), ("CREATE GRAPH ex:g", "GraphError"), ("CREATE SILENT GRAPH ex:g", "ok"), ("COPY ex:no TO ex:g", "GraphError"), ("MOVE SILENT ex:no TO ex:g", "ok"), ("LOAD <http://e.org/x.ttl>", "ValueError"), ("LOAD SILENT <http://e.org/x.ttl>", "ok")]


@query(f"select * from (values {values(*_GRAPH_ERRORS)}) t(op, said)")
def update_graph_errors(spark, sf_dir):
    full = st.apply(nations(spark, sf_dir), PREFIX + "COPY DEFAULT TO ex:g")
    return spark.createDataFrame([(op, outcome(lambda op=op: st.apply(full, PREFIX + op), GraphError, ValueError)) for op, _ in _GRAPH_ERRORS], "op string, said string")


@query(f"{_NATIONS} union all select {_N}, '<{BASE}name>', {_NAME}, '<{BASE}loaded>' from nation")
def update_load(spark, sf_dir):
    """N-Triples files, written by tasks, loaded into a graph."""
    state = nations(spark, sf_dir)
    path = own_path(spark, "load.nt")
    results.write_statements(state.quads.select("s", "p", "o"), path)
    return st.apply(state, f"LOAD <{path}> INTO GRAPH <{BASE}loaded>").quads.select("s", "p", "o", "g")


# --- readers and writers --------------------------------------------------------------

_TRIPLES = f"select {_N} as s, '<{BASE}name>' as p, {_NAME} as o from nation union all select {_N}, '<{v.TYPE}>', '<{BASE}Nation>' from nation"


def typed_nations(spark, sf_dir) -> DataFrame:
    own = nations(spark, sf_dir).quads.select("s", "p", "o")
    return own.union(own.select("s", F.lit(f"<{v.TYPE}>"), F.lit(f"<{BASE}Nation>")))


def through_file(spark, sf_dir, kind: str, ending: str) -> DataFrame:
    """The nations written in a format, read again from the file; the ending names the format."""
    path = own_path(spark, f"nations.{ending}")
    text = "".join(results.graph(typed_nations(spark, sf_dir), kind))
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    return rdf.read(spark, path).select("s", "p", "o")


@query(_TRIPLES)
def file_turtle(spark, sf_dir):
    return through_file(spark, sf_dir, "turtle", "ttl")


@query(_TRIPLES)
def file_rdfxml(spark, sf_dir):
    return through_file(spark, sf_dir, "rdfxml", "rdf")


@query(_TRIPLES)
def file_ntriples(spark, sf_dir):
    path = own_path(spark, "nations.nt")
    results.write_statements(typed_nations(spark, sf_dir), path)
    return rdf.read(spark, path).select("s", "p", "o")


@query(f"select '<http://b.org/d/n' || n_nationkey || '>' as s, '<http://b.org/p>' as p, '<http://b.org/d/sub/x#r' || n_regionkey || '>' as o from nation")
def base_iri(spark, sf_dir):
    """Relative IRIs of a Turtle payload against a base and a directive."""
    rows = frame(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").collect()
    text = "".join(f"@base <http://b.org/d/> . <n{k}> </p> <sub/x#r{r}> .\n" for k, r in rows)
    return rdf.parse_payload(spark, text, "turtle", "http://other.org/").select("s", "p", "o")


_ENDINGS = [("a.ttl", "turtle"), ("a.nt", "ntriples"), ("a.nq", "nquads"), ("a.rdf", "rdfxml"), ("a.json", "ValueError"), ("a", "ValueError")]


@query(f"select * from (values {values(*_ENDINGS)}) t(file, format)")
def format_from_extension(spark, sf_dir):
    def told(name: str) -> str:
        try:
            return rdf.format_of(name)
        except ValueError:
            return "ValueError"

    return spark.createDataFrame([(n, told(n)) for n, _ in _ENDINGS], "file string, format string")


@query("select 2 * count(*) as quads, 1 as revision, 'ValueError' as without from nation")
def ontology_preload(spark, sf_dir):
    """A new store begins with the first of its files that exists; without any it is an error."""
    path = own_path(spark, "ontology.nt")
    results.write_statements(typed_nations(spark, sf_dir), path)
    x = QuadStore(spark, own_path(spark, "preloaded.store"), preload=[path + ".missing.ttl", path]).stats()
    without = outcome(lambda: QuadStore(spark, own_path(spark, "none.store"), preload=[path + ".missing.ttl"]), ValueError)
    return spark.createDataFrame([(x["quad_count"], x["revision"], without)], "quads long, revision long, without string")


def solved(spark, sf_dir) -> DataFrame:
    return Engine(dataset(spark, sf_dir, "nation")).select(PREFIX + 'SELECT ?n ?l ?k ?none { ?n ex:n_name ?l ; ex:n_nationkey ?k OPTIONAL { ?n ex:nothing ?none } }')


_KEY = "cast(n_nationkey as varchar)"


@query(f"select 'n,l,k,none' as line union all select {iri('n_nationkey', 'nation')} || ',' || n_name || ',' || {_KEY} || ',' from nation")
def results_csv(spark, sf_dir):
    text = "".join(results.solutions(solved(spark, sf_dir), "csv"))
    return spark.createDataFrame([(x,) for x in text.split("\r\n")[:-1]], "line string")


@query(f"select '?n|?l|?k|?none' as line union all select '<' || {iri('n_nationkey', 'nation')} || '>|\"' || n_name || '\"|\"' || {_KEY} || '\"^^<{v.XSD_INTEGER}>|' from nation")
def results_tsv(spark, sf_dir):
    text = "".join(results.solutions(solved(spark, sf_dir), "tsv"))
    return spark.createDataFrame([(x.replace("\t", "|"),) for x in text.split("\n")[:-1]], "line string")


_BOUND = f"select {iri('n_nationkey', 'nation')} as n, 'uri' as kind, n_name as l, {_KEY} as k, '{v.XSD_INTEGER}' as datatype, 3 as bound from nation"


@query(_BOUND)
def results_json(spark, sf_dir):
    rows = json.loads("".join(results.solutions(solved(spark, sf_dir), "json")))["results"]["bindings"]
    return spark.createDataFrame([(b["n"]["value"], b["n"]["type"], b["l"]["value"], b["k"]["value"], b["k"]["datatype"], len(b)) for b in rows], "n string, kind string, l string, k string, datatype string, bound int")


@query(_BOUND)
def results_xml(spark, sf_dir):
    root = ET.fromstring("".join(results.solutions(solved(spark, sf_dir), "xml")))
    ns = "{http://www.w3.org/2005/sparql-results#}"
    rows = []
    for r in root.iter(f"{ns}result"):
        b = {x.get("name"): x[0] for x in r}
        rows.append((b["n"].text, b["n"].tag.removeprefix(ns), b["l"].text, b["k"].text, b["k"].get("datatype"), len(b)))
    return spark.createDataFrame(rows, "n string, kind string, l string, k string, datatype string, bound int")


@query("select kind, 'true' as yes, 'false' as no from (values ('json'), ('xml'), ('csv'), ('tsv')) t(kind)")
def results_boolean(spark, sf_dir):
    e = Engine(dataset(spark, sf_dir, "nation"))
    told = {True: e.ask(PREFIX + "ASK { ?n ex:n_name ?l }"), False: e.ask(PREFIX + "ASK { ?n ex:none ?l }")}

    def word(kind: str, value: bool) -> str:
        text = results.boolean(value, kind)
        return str(json.loads(text)["boolean"]).lower() if kind == "json" else ET.fromstring(text)[1].text if kind == "xml" else text

    return spark.createDataFrame([(k, word(k, told[True]), word(k, told[False])) for k in ("json", "xml", "csv", "tsv")], "kind string, yes string, no string")


# --- the store ------------------------------------------------------------------------

in_store("store_syntax_error", lambda x: outcome(lambda: x.update("DELETE WHERE { ?s ?p ?o } ; INSERT DATA { broken"), ValueError), _NATIONS)


@query("select * from (values ('put', true, 2), ('put', false, 3), ('post', true, 4), ('post', false, 5), ('default', false, 6)) t(op, created, revision)")
def graph_created_flag(spark, sf_dir):
    store = stored(nations(spark, sf_dir))
    text = f"<{BASE}x> <{BASE}p> 1 ."
    calls = [("put", BASE + "g", True), ("put", BASE + "g", True), ("post", BASE + "h", False), ("post", BASE + "h", False), ("default", "", True)]
    made = [(op, store.write_graph(text, "turtle", g, replace=whole)) for op, g, whole in calls]
    return spark.createDataFrame([(op, r.created, r.revision) for op, r in made], "op string, created boolean, revision long")


@query("select * from (select 'quadloom_quads' as name, count(*) as n from nation union all values ('quadloom_revision', 1), ('quadloom_named_graphs', 0), ('quadloom_ready', 1), ('quadloom_reasoner_execution_cache_entries', 0))")
def metrics_text(spark, sf_dir):
    lines = [x.rsplit(" ", 1) for x in stored(nations(spark, sf_dir)).metrics(Reasoner("rules-mvp")).splitlines() if not x.startswith("#")]
    wanted = ("quadloom_quads", "quadloom_revision", "quadloom_named_graphs", "quadloom_ready", "quadloom_reasoner_execution_cache_entries")
    return spark.createDataFrame([(n, int(x)) for n, x in lines if n in wanted], "name string, n long")


_EARLY = f"PREFIX owl: <{v.OWL}> INSERT DATA {{ ex:Early owl:disjointWith ex:Late }} ; INSERT {{ ?n a ex:Early }} WHERE {{ ?n ex:name ?l }}"


@query("select 'accepted' as step, 2 as revision, 2 * count(*) + 1 as quads, 'ok' as said, cast(null as varchar) as focus from nation union all select 'rejected', 2, 2 * count(*) + 1, 'ReasonerReject', 'http://ex.org/nation/3' from nation union all select 'after', 3, 2 * count(*) + 2, 'ok', null from nation")
def gate_decisions(spark, sf_dir):
    """A consistent update is published; one that makes a nation both early and late leaves no trace; the next one is published."""
    store, gate = stored(nations(spark, sf_dir)), Gate(Reasoner("rules-mvp"))
    rows = []
    for step, text in (("accepted", _EARLY), ("rejected", f"INSERT DATA {{ <{BASE}nation/3> a ex:Late . ex:q ex:p ex:r }}"), ("after", "INSERT DATA { ex:q a ex:Late }")):
        said = outcome(lambda text=text: store.update(PREFIX + text, gate), ReasonerReject)
        x = store.stats()
        rows.append((step, x["revision"], x["quad_count"], said, gate.last.report.inference.primary_reject["focus_resource"] if said != "ok" else None))
    return spark.createDataFrame(rows, "step string, revision long, quads long, said string, focus string")


@query("select * from (select 'inserted' as what, count(*) + 1 as n from nation union all values ('removed', 0), ('derived', 0), ('status completed', 1))")
def gate_last_run(spark, sf_dir):
    """The delta and the report that a gate keeps of its last run: a preview of the next state, judged before it is published."""
    store, gate = stored(nations(spark, sf_dir)), Gate(Reasoner("rules-mvp"))
    store.update(PREFIX + _EARLY, gate)
    last = gate.last
    return spark.createDataFrame([("inserted", last.inserted.count()), ("removed", last.removed.count()), ("derived", last.report.inference.inferred_triples), (f"status {last.report.status}", 1)], "what string, n long")


@query("select * from (values ('while another writes', 'ConflictError', 1), ('afterwards', 'ok', 2)) t(step, said, revision)")
def single_writer(spark, sf_dir):
    store = stored(nations(spark, sf_dir))
    rows = []
    with store.writer():
        rows.append(("while another writes", outcome(lambda: store.update("CLEAR ALL"), ConflictError), store.revision))
    rows.append(("afterwards", outcome(lambda: store.update("CLEAR ALL"), ConflictError), store.revision))
    return spark.createDataFrame(rows, "step string, said string, revision long")


_COMMANDS = {
    "update": lambda x: x.update(f"INSERT DATA {{ <{BASE}a> <{BASE}p> 1 }}"),
    "tell": lambda x: x.tell(f"<{BASE}b> <{BASE}p> 1 .", "turtle"),
    "put": lambda x: x.write_graph(f"<{BASE}c> <{BASE}p> 1 .", "turtle", BASE + "g"),
    "post": lambda x: x.write_graph(f"<{BASE}d> <{BASE}p> 1 .", "turtle", BASE + "g", replace=False),
    "delete": lambda x: x.delete_graph(BASE + "g"),
}


@query("select command, revision, added + (select count(*) from nation) as quads from (values ('update', 2, 1), ('tell', 3, 2), ('put', 4, 3), ('post', 5, 4), ('delete', 6, 2)) t(command, revision, added)")
def mutation_revisions(spark, sf_dir):
    """Every kind of mutation makes one revision."""
    store = stored(nations(spark, sf_dir))
    rows = []
    for name, run in _COMMANDS.items():
        run(store)
        rows.append((name, store.revision, store.stats()["quad_count"]))
    return spark.createDataFrame(rows, "command string, revision long, quads long")


# --- reasoning ------------------------------------------------------------------------


@query("select min(s_suppkey) over (partition by s_nationkey) as x, s_suppkey as y, 'Vendor' as c, case when s_suppkey = x then 0 else 1 end as rank, case when s_suppkey = x then 'asserted' else 'equality-derived via ' || 'supplier/' || lpad(cast(x as varchar), 9, '0') || ' (asserted)' end as origin from supplier union all select min(s_suppkey) over (partition by s_nationkey) as x, s_suppkey, 'Agent', case when s_suppkey = x then 10 else 11 end, 'subclass-derived from Vendor (' || case when s_suppkey = x then 'asserted' else 'equality-derived via ' || 'supplier/' || lpad(cast(x as varchar), 9, '0') || ' (asserted)' end || ')' from supplier")
def types_through_equality(spark, sf_dir):
    """The first supplier of a nation is a vendor and the same as its others; ranks and origins of all types."""
    own = frame(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    own = own.join(own.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("x")), "s_nationkey")
    name = lambda c: F.concat(F.lit("supplier/"), F.lpad(F.col(c).cast("string"), 9, "0"))
    facts = bare(own.where("s_suppkey <> x"), name("x"), v.SAME_AS, name("s_suppkey")).union(bare(own.where("s_suppkey = x"), name("x"), v.TYPE, F.lit("Vendor")))
    types = closed(facts, [("Vendor", v.SUB_CLASS, "Agent")])[1]
    found = types.withColumn("y", F.substring("i", 10, 9).cast("long"))
    return found.join(own.select(F.col("s_suppkey").alias("y"), "x"), "y").select("x", "y", "c", "rank", "origin")


_FACTS = "(select count(*) from nation)"
_STATS = [
    ("supported_asserted_triples", f"2 * {_FACTS} + 5"), ("unsupported_asserted_triples", _FACTS), ("unsupported_blank_node_subjects", "0"), ("unsupported_blank_node_objects", "0"), ("unsupported_literal_objects", _FACTS),
    ("flattened_named_graph_quads", "0"), ("interned_terms", f"{_FACTS} + (select count(distinct n_regionkey) from nation) + 11"), ("subclass_edge_count", "2"), ("subproperty_edge_count", "1"), ("type_assertion_count", _FACTS),
    ("property_assertion_count", _FACTS), ("equality_assertion_count", "0"), ("equality_cluster_count", "0"), ("inferred_equality_link_count", "0"), ("domain_assertion_count", "1"), ("range_assertion_count", "1"), ("taxonomy_node_count", "3"), ("property_taxonomy_node_count", "2"),
]


def nation_quads(spark, sf_dir) -> DataFrame:
    """Nations with names, types and regions, and a small schema over them."""
    df = frame(spark, sf_dir, "nation")
    named = lambda kind, key: F.concat(F.lit(f"<{BASE}{kind}/"), F.col(key).cast("string"), F.lit(">"))
    row = lambda p, o: df.select(named("nation", "n_nationkey").alias("s"), F.lit(f"<{p}>").alias("p"), o.alias("o"), F.lit("").alias("g"))
    schema = [("Nation", v.SUB_CLASS, "Place"), ("Place", v.SUB_CLASS, "Thing"), ("in", v.SUB_PROPERTY, "within"), ("in", v.DOMAIN, "Nation"), ("in", v.RANGE, "Region")]
    axioms = spark.createDataFrame([(f"<{BASE}{s}>", f"<{p}>", f"<{BASE}{o}>", "") for s, p, o in schema], rdf.QUADS)
    return row(BASE + "in", named("region", "n_regionkey")).union(row(v.TYPE, F.lit(f"<{BASE}Nation>"))).union(row(BASE + "name", F.concat(F.lit('"'), "n_name", F.lit('"')))).union(axioms)


@query("select * from (" + " union all ".join(f"select '{n}' as name, {x} as n" for n, x in _STATS) + ")")
def run_statistics(spark, sf_dir):
    found = infer(Snapshot.of(nation_quads(spark, sf_dir)))
    return spark.createDataFrame(list(found.stats.items()), "name string, n long")


@query("select 'first' as run, 'completed' as status, false as execution_hit, false as schema_hit, 3 * count(*) + count(distinct n_regionkey) + 1 as derived from nation union all select 'same rows in another order', 'completed', true, false, 3 * count(*) + count(distinct n_regionkey) + 1 from nation union all select 'one row more', 'completed', false, true, 3 * count(*) + count(distinct n_regionkey) + 1 + 2 from nation")
def run_caches(spark, sf_dir):
    """Runs are remembered by content, schemas by their axioms."""
    quads, r = nation_quads(spark, sf_dir), Reasoner("rules-mvp")
    more = quads.union(spark.createDataFrame([(f"<{BASE}nation/x>", f"<{v.TYPE}>", f"<{BASE}Nation>", "")], rdf.QUADS))
    rows = []
    for name, some in (("first", quads), ("same rows in another order", quads.orderBy(F.desc("o"))), ("one row more", more)):
        report = r.run(Snapshot.of(some))
        hit = report.cache["execution_cache_hit"]
        rows.append((name, report.status, hit, report.cache["schema_cache_hit"], report.inference.inferred_triples))
    return spark.createDataFrame(rows, "run string, status string, execution_hit boolean, schema_hit boolean, derived long")


_FLAGS = [f.name for f in fields(Policy) if f.type == "bool" or f.type is bool]


@query("select mode, status, preset, derived from (select 'disabled' as mode, 'skipped' as status, 'bounded-owl' as preset, 0 as derived union all values ('owl-dl-target', 'skipped', 'bounded-owl', 0) union all select 'rules-mvp', 'completed', 'bounded-owl', 3 * count(*) + count(distinct n_regionkey) + 1 from nation union all select 'rules-mvp', 'completed', 'rdfs-core', 3 * count(*) + count(distinct n_regionkey) + 1 from nation union all select 'rules-mvp', 'completed', 'custom', count(*) + 1 from nation)")
def reasoner_modes(spark, sf_dir):
    """Modes and presets, and what stages that are switched off leave out."""
    snapshot = Snapshot.of(nation_quads(spark, sf_dir))
    rows = []
    for mode, policy in (("disabled", Policy()), ("owl-dl-target", Policy()), ("rules-mvp", Policy()), ("rules-mvp", PRESETS["rdfs-core"]), ("rules-mvp", replace(Policy(), rdfs_type_propagation=False))):
        report = Reasoner(mode, policy).run(snapshot)
        rows.append((mode, report.status, policy.preset, report.inference.inferred_triples if report.inference else 0))
    return spark.createDataFrame(rows, "mode string, status string, preset string, derived long")


_CAPABLE = [("rules-mvp", f, "stable" if f.startswith("rdfs") else "experimental", True) for f in ("rdfs_subclass_closure", "rdfs_subproperty_closure", "rdfs_type_propagation", "rdfs_domain_range_typing", "owl_property_assertion_closure", "owl_equality_reasoning", "owl_property_chain_axioms", "owl_consistency_check")]
_CAPABLE += [("owl-dl-target", f, "target", False) for f in ("owl_class_satisfiability", "owl_consistency_check", "incremental_refresh", "explanation_trace")]


@query(f"select * from (values {values(*_CAPABLE)}) t(mode, feature, maturity, enabled)")
def reasoner_capabilities(spark, sf_dir):
    return spark.createDataFrame([(m, c["feature"], c["maturity"], c["enabled"]) for m in ("disabled", "rules-mvp", "owl-dl-target") for c in capabilities(m, Policy())], "mode string, feature string, maturity string, enabled boolean")


@query(f"select * from (values {values(*[('rdfs-core', f, f.startswith('rdfs') or f.startswith('diagnose') or f == 'drop_reflexive') for f in _FLAGS], *[('bounded-owl', f, True) for f in _FLAGS])}) t(preset, flag, value) union all select 'keys differ', 'all', true")
def reasoner_presets(spark, sf_dir):
    rows = [(name, f, getattr(p, f)) for name, p in PRESETS.items() for f in _FLAGS]
    keys = {replace(Policy(), **{f: False}).key for f in _FLAGS} | {Policy().key}
    return spark.createDataFrame([*rows, ("keys differ", "all", len(keys) == len(_FLAGS) + 1)], "preset string, flag string, value boolean")


@query("select 'literal objects' as what, count(*) as n from nation union all select 'unread axioms', 1 union all select 'lists left out', 2 union all select 'named graphs', 0")
def reasoner_diagnostics(spark, sf_dir):
    """What a run says that it did not see, and of groups and chains whose lists it cannot use."""
    more = [("c", v.CHAIN, "k1"), ("k1", v.FIRST, "p"), ("k1", v.REST, v.NIL), ("g", v.TYPE, v.ALL_DIFFERENT), ("g", v.DISTINCT_MEMBERS, "m1"), ("m1", v.FIRST, "x"), ("m1", v.REST, "m1"), ("C", v.OWL + "unionOf", "k1")]
    name = lambda x: f"<{x}>" if ":" in x else f"<{BASE}{x}>"
    quads = nation_quads(spark, sf_dir).union(spark.createDataFrame([(*map(name, t), "") for t in more], rdf.QUADS))
    said = infer(Snapshot.of(quads)).diagnostics
    count = lambda text: sum(int(x.split(" ")[0]) for x in said if text in x)
    rows = [("literal objects", count("have a literal as object")), ("unread axioms", sum("no rule reads" in x for x in said)), ("lists left out", sum("is left out" in x for x in said)), ("named graphs", count("quads of named graphs"))]
    return spark.createDataFrame(rows, "what string, n long")


@query("select 'nation/' || n_nationkey as focus, c, o from nation, (values ('owl:disjointWith', 2), ('owl:IrreflexiveProperty', 4), ('owl:AsymmetricProperty', 5), ('owl:propertyDisjointWith', 6)) t(c, o) where c <> 'owl:AsymmetricProperty' or n_nationkey < (select max(n_nationkey) from nation) union all select 'first', 'owl:disjointWith', 2")
def consistency_order(spark, sf_dir):
    """Violations by several detectors; the primary one is by the first of them."""
    n = frame(spark, sf_dir, "nation")
    key = lambda x: F.concat(F.lit("nation/"), x.cast("string"))
    me, last = key(F.col("n_nationkey")), F.lit("nation/~last")
    chosen = n.where(F.col("n_nationkey") < n.agg(F.max("n_nationkey")).first()[0])
    facts = bare(n, me, v.TYPE, F.lit("A")).union(bare(n, me, v.TYPE, F.lit("B"))).union(bare(n, me, "self", me)).union(bare(n, me, "p", F.lit("o"))).union(bare(n, me, "q", F.lit("o"))).union(bare(chosen, me, "r", last)).union(bare(chosen, last, "r", me))
    triples, types, found, schema = closed(facts, [("A", v.DISJOINT_WITH, "B"), ("self", v.TYPE, v.IRREFLEXIVE), ("p", v.PROPERTY_DISJOINT, "q"), ("r", v.TYPE, v.ASYMMETRIC)])
    bad = consistency.violations(triples, types, found, schema)
    first = bad.orderBy("ordinal", "focus", "left", "right").limit(1).select(F.lit("first").alias("focus"), F.col("constraint").alias("c"), F.col("ordinal").alias("o"))
    return bad.select("focus", F.col("constraint").alias("c"), F.col("ordinal").alias("o")).union(first)


# --- the protocol ------------------------------------------------------------------------

_TTL = {"Content-Type": "text/turtle"}
_G = "graph=http%3A%2F%2Fe%2Fg"
_REQUESTS = [
    ("GET", "/healthz", "", {}, b"", 200, "application/json"),
    ("GET", "/nowhere", "", {}, b"", 404, "application/problem+json"),
    ("PUT", "/dataset/data", _G, _TTL, b"<a:b> <c:d> 1 .", 201, ""),
    ("PUT", "/dataset/data", _G, _TTL, b"<a:b> <c:d> 2 .", 200, ""),
    ("POST", "/dataset/data", "default", _TTL, b"<a:x> a <a:Y> .", 204, ""),
    ("POST", "/dataset/data", "", {"Content-Type": "text/csv"}, b"a", 400, "application/problem+json"),
    ("GET", "/dataset/data", _G, {"Accept": "text/turtle"}, b"", 200, "text/turtle"),
    ("HEAD", "/dataset/data", _G, {"Accept": "application/rdf+xml"}, b"", 200, "application/rdf+xml"),
    ("GET", "/dataset/query", "query=ASK%20%7B%20%3Fs%20%3Fp%20%3Fo%20%7D", {"Accept": "text/csv"}, b"", 200, "text/csv"),
    ("POST", "/dataset/query", "", {"Content-Type": "application/x-www-form-urlencoded"}, b"query=ASK%20%7B%7D", 200, "application/sparql-results+json"),
    ("POST", "/dataset/query", "", {"Accept": "application/sparql-results+xml"}, b"SELECT ?s { ?s ?p ?o }", 200, "application/sparql-results+xml"),
    ("POST", "/dataset/query", "", {"Accept": "text/turtle"}, b"DESCRIBE <a:x>", 200, "text/turtle"),
    ("POST", "/dataset/query", "", {}, b"SELECT {", 400, "application/problem+json"),
    ("POST", "/dataset/query", "", {}, b" ", 400, "application/problem+json"),
    ("POST", "/dataset/update", "", {"Content-Type": "application/sparql-update"}, b"INSERT DATA { <a:b> <c:d> <e:f> }", 204, ""),
    ("POST", "/dataset/update", "", {"Content-Type": "application/json"}, b"CLEAR ALL", 400, "application/problem+json"),
    ("POST", "/dataset/update", "", {}, b"DROP GRAPH <e:none>", 400, "application/problem+json"),
    ("POST", "/dataset/tell", "", _TTL, b"<a:q> a <a:Y> .", 204, ""),
    ("GET", "/dataset/info", "", {}, b"", 200, "application/json"),
    ("GET", "/dataset/service-description", "", {}, b"", 200, "text/turtle"),
    ("GET", "/metrics", "", {}, b"", 200, "text/plain; version=0.0.4; charset=utf-8"),
    ("GET", "/ops/api/diagnostics/reasoning", "", {}, b"", 200, "application/json"),
    ("DELETE", "/dataset/data", _G, {}, b"", 204, ""),
    ("DELETE", "/dataset/data", "graph=x", {}, b"", 400, "application/problem+json"),
]


@query(f"select * from (values {values(*[(k, m, p, s, t) for k, (m, p, _, _, _, s, t) in enumerate(_REQUESTS)])}) t(n, method, path, status, media)")
def protocol_requests(spark, sf_dir):
    """Requests one after another to a store of the nations: status and media type."""
    service = Endpoint(stored(nations(spark, sf_dir)), Reasoner("rules-mvp"))
    rows = []
    for k, (method, path, text, headers, body, _, _) in enumerate(_REQUESTS):
        answer = service.handle(method, path, text, headers, body)
        answer.text()
        rows.append((k, method, path, answer.status, answer.media))
    return spark.createDataFrame(rows, "n int, method string, path string, status int, media string")


@query("select n_name as name from nation")
def protocol_query(spark, sf_dir):
    """Solutions of a query, as they leave the endpoint."""
    service = Endpoint(stored(nations(spark, sf_dir)))
    text = service.handle("POST", "/dataset/query", "", {"Accept": "application/json"}, f"SELECT ?l {{ ?n <{BASE}name> ?l }}".encode()).text()
    return spark.createDataFrame([(b["l"]["value"],) for b in json.loads(text)["results"]["bindings"]], "name string")


@query("select * from (select 'type' as field, '/problems/reasoner-reject' as value union all values ('title', 'Reasoner Reject'), ('status', '400'), ('constraint', 'owl:disjointWith'), ('trigger', 'http://ex.org/Late'), ('revision', '2'), ('last_run', 'rejected'))")
def protocol_reject(spark, sf_dir):
    """A rejection as a problem document, and in the diagnostics."""
    service = Endpoint(stored(nations(spark, sf_dir)), Reasoner("rules-mvp"))
    service.handle("POST", "/dataset/update", "", {}, (PREFIX + _EARLY).encode())
    x = json.loads(service.handle("POST", "/dataset/tell", "", _TTL, f"<{BASE}nation/3> a <{BASE}Late> .".encode()).text())
    seen = json.loads(service.handle("GET", "/ops/api/diagnostics/reasoning").text())
    reject = x["reasoner_reject"]
    rows = [("type", x["type"]), ("title", x["title"]), ("status", str(x["status"])), ("constraint", reject["violated_constraint"]), ("trigger", reject["likely_triggers"][0]["o"]), ("revision", str(seen["revision"])), ("last_run", seen["last_run"]["status"])]
    return spark.createDataFrame(rows, "field string, value string")


_POLICIES = [("no token", 401), ("unknown token", 401), ("read token reads", 200), ("read token writes", 403), ("long query", 413), ("admin token writes", 204), ("over the rate", 429), ("read-only posture writes", 404), ("posture without access", 0), ("late query", 408)]


@query(f"select * from (values {values(*_POLICIES)}) t(request, status)")
def protocol_policies(spark, sf_dir):
    """Tokens, limits, rates, timeouts and postures."""
    store = stored(nations(spark, sf_dir))
    guarded = Endpoint(store, config=Config(access=Access(("r",), ("a",)), limits=Limits(query=60, read=2)))
    ask = lambda e, token, path="/dataset/query", body=b"ASK {}": e.handle("POST", path, "", {"Authorization": token} if token else {}, body).status
    refused = outcome(lambda: Endpoint(store, config=Config(posture="internal-authenticated")), ValueError)
    hasty = Endpoint(store, config=Config(limits=Limits(read_seconds=0.001)))
    rows = [
        ("no token", ask(guarded, None)),
        ("unknown token", ask(guarded, "Bearer no")),
        ("read token reads", ask(guarded, "Bearer r")),
        ("read token writes", ask(guarded, "Bearer r", "/dataset/update", b"CLEAR ALL")),
        ("long query", ask(guarded, "Bearer a", body=harness.padded("query", 61).encode())),
        ("admin token writes", ask(guarded, "Bearer a", "/dataset/update", b"INSERT DATA {}")),
        ("over the rate", ask(guarded, "Bearer r")),
        ("read-only posture writes", ask(Endpoint(store, config=Config(posture="read-only-demo")), None, "/dataset/update", b"CLEAR ALL")),
        ("posture without access", 0 if refused == "ValueError" else 1),
        ("late query", ask(hasty, None, body=b"ASK { ?s ?p ?o }")),
    ]
    return spark.createDataFrame(rows, "request string, status int")


_TARGETS = [("", ""), ("default", ""), ("graph=e%3Ag", "e:g"), ("graph=a:b&graph=c:d", "Problem"), ("default&graph=a:b", "Problem"), ("graph=", "Problem")]


@query(f"select * from (values {values(*_TARGETS)}) t(query, target)")
def protocol_graph_target(spark, sf_dir):
    def told(text: str) -> str:
        try:
            return graph_target(text)
        except Problem:
            return "Problem"

    return spark.createDataFrame([(q, told(q)) for q, _ in _TARGETS], "query string, target string")


# --- the harness --------------------------------------------------------------------------


@query("select count(*) as triples, true as renamed_equal, false as changed_equal from nation")
def harness_graphs(spark, sf_dir):
    """A ring of blank nodes, one for each nation, is the same graph under other names and another one with one name less."""
    names = [r[0] for r in frame(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_name").collect()]
    ring = lambda tag, some: [(f"_:{tag}{k}", f"<e:{some[k]}>", f"_:{tag}{(k + 1) % len(some)}") for k in range(len(some))]
    a, b, c = harness.canonical_graph(ring("a", names)), harness.canonical_graph(ring("z", names)[::-1]), harness.canonical_graph(ring("a", names[1:]))
    return spark.createDataFrame([(len(a), a == b, a == c)], "triples long, renamed_equal boolean, changed_equal boolean")


@query(f"select 'k=literal|{v.XSD_INTEGER}||' || n_nationkey || '|l=literal|||' || n_name || '|n=uri|||{BASE}nation/' || n_nationkey as row from nation")
def harness_bindings(spark, sf_dir):
    return spark.createDataFrame([(x,) for x in harness.canonical_bindings("".join(results.solutions(solved(spark, sf_dir), "json")))], "row string")


@query("select false as matched, (select count(*) from customer) as left_count, (select count(*) from customer where c_custkey <> 3) as right_count, (select c_name from customer where c_custkey = 3) as left_only")
def harness_difference(spark, sf_dir):
    c = frame(spark, sf_dir, "customer").select("c_custkey", "c_name")
    x = harness.compare_frames(c, c.where("c_custkey <> 3"))
    assert harness.compare_frames(c, c).matched
    return spark.createDataFrame([(x.matched, x.left_count, x.right_count, x.left_only[0][1])], "matched boolean, left_count long, right_count long, left_only string")


@query("with x as (select p_size as v, row_number() over (order by p_size) - 1 as k, count(*) over () as n from part) select p, max(v) filter (where k = (n - 1) * p // 100) as value from x, (values (50), (95), (99)) t(p) group by p")
def harness_percentiles(spark, sf_dir):
    ordered = [r[0] for r in frame(spark, sf_dir, "part").select("p_size").orderBy("p_size").collect()]
    return spark.createDataFrame([(p, harness.percentile(ordered, p)) for p in (50, 95, 99)], "p int, value long")


@query("select * from (values ('query', 300, 'ok'), ('update', 300, 'ok'), ('turtle', 300, 'ok'), ('report', 2, 'ok'), ('rdf', 1, 'ok'), ('empty', 0, 'ok')) t(kind, size, said)")
def harness_payloads(spark, sf_dir):
    """Padded texts that parse, a report of two cases, kinds of bodies."""
    parse = {"query": parse_query, "update": parse_update, "turtle": rdf.parse_turtle}
    rows = [(k, len(text := harness.padded(k, 300)), outcome(lambda k=k, text=text: parse[k](text), ValueError)) for k in parse]
    ran = harness.measured(lambda: None, 3, 2)
    rows.append(("report", len(json.loads(harness.report({"runs": ran, "sets": harness.compare_sets({"a"}, {"a", "b"})}))), "ok" if (ran["samples"], ran["failure"]) == (6, 0) else "wrong"))
    rows += [("rdf", int(harness.media_kind("text/turtle; x", b"a") == "rdf"), "ok"), ("empty", int(harness.media_kind("text/turtle", b"") != "empty"), "ok")]
    return spark.createDataFrame(rows, "kind string, size int, said string")
