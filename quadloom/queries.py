"""Queries over the test tables, seen as triples through the usual mapping, and DuckDB SQL with the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadloom import session
from quadloom import vocab as v
from quadloom.operators.closure import components
from quadloom.plans.compiler import Engine
from quadloom.reasoner import consistency, rules
from quadloom.reasoner.policy import Policy
from quadloom.reasoner.rules import Schema, Snapshot
from quadloom.reasoner.service import Reasoner
from quadloom.sinks import results
from quadloom.sources.dataset import MappedDataset, table
from quadloom.store import state as st
from quadloom.store.gate import Gate, delta
from quadloom.store.state import State
from quadloom.store.store import QuadStore

BASE = "http://ex.org/"
PREFIX = f"PREFIX ex: <{BASE}> PREFIX xsd: <{v.XSD}> PREFIX rdf: <{v.RDF}> "
#: table -> (key column, {column: table that it links to}); no key: the whole row's hash.
TABLES = {
    "region": ("r_regionkey", {}),
    "nation": ("n_nationkey", {"n_regionkey": "region"}),
    "customer": ("c_custkey", {"c_nationkey": "nation"}),
    "supplier": ("s_suppkey", {"s_nationkey": "nation"}),
    "part": ("p_partkey", {}),
    "orders": ("o_orderkey", {"o_custkey": "customer"}),
    "lineitem": (None, {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}),
    "events": ("event_id", {"user_id": "user"}),
    "documents": ("doc_id", {}),
    "labels": ("doc_id", {}),
}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def dataset(spark: SparkSession, sf_dir: str, *names: str) -> MappedDataset:
    tables = []
    for name in names or TABLES:
        key, links = TABLES[name]
        df = frame(spark, sf_dir, name)
        if name == "customer":
            df = df.withColumn("c_parent", F.when(F.col("c_custkey") > 0, F.floor(F.col("c_custkey") / 2)))
            links = links | {"c_parent": "customer"}
        tables.append(table(df, BASE, "documents" if name == "labels" else name, key, links, skip=("doc_id",) if name == "labels" else ()))
    return MappedDataset(tables)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def sparql(name: str, text: str, sql: str, *tables: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: Engine(dataset(spark, sf_dir, *tables)).select(PREFIX + text, native=True)
    ORACLE_SQL[name] = sql


def iri(column: str, name: str) -> str:
    return f"'{BASE}{name}/' || {column}"


# --- algebra ------------------------------------------------------------------

sparql(
    "sparql_class_counts",
    "SELECT ?class (COUNT(?i) AS ?n) WHERE { ?i a ?class } GROUP BY ?class ORDER BY DESC(?n) ?class LIMIT 10",
    " union all ".join(f"select '{BASE}{t.capitalize()}' as class, count(*) as n from {t}" for t in TABLES if t not in ("documents", "labels")) + f" union all select '{BASE}Documents', (select count(*) from documents) + (select count(*) from labels)",
)
sparql(
    "sparql_bgp_join",
    "SELECT ?order ?customer ?nation ?region WHERE { ?order ex:o_custkey ?c . ?c ex:c_name ?customer ; ex:c_nationkey ?n . ?n ex:n_name ?nation ; ex:n_regionkey ?r . ?r ex:r_name ?region }",
    f"select {iri('o_orderkey', 'orders')} as order, c_name as customer, n_name as nation, r_name as region from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey",
    "orders", "customer", "nation", "region",
)
sparql(
    "sparql_star",
    "SELECT ?flag (COUNT(*) AS ?n) (SUM(?q) AS ?quantity) WHERE { ?l ex:l_quantity ?q ; ex:l_extendedprice ?p ; ex:l_returnflag ?flag . FILTER(?p > 20000) } GROUP BY ?flag",
    "select l_returnflag as flag, count(*) as n, sum(l_quantity) as quantity from lineitem where l_extendedprice > 20000 group by 1",
    "lineitem",
)
sparql("sparql_filter_compare", "SELECT ?p ?size WHERE { ?p ex:p_size ?size . FILTER(?size >= 10 && ?size < 20 || ?size = 45) }", f"select {iri('p_partkey', 'part')} as p, p_size as size from part where p_size >= 10 and p_size < 20 or p_size = 45", "part")
sparql("sparql_filter_regex", 'SELECT ?name WHERE { ?c ex:c_name ?name . FILTER(REGEX(?name, "1[05]$") || REGEX(?name, "CUSTOMER.*7", "i")) }', "select c_name as name from customer where regexp_matches(c_name, '1[05]$') or regexp_matches(c_name, '(?i)CUSTOMER.*7')", "customer")
sparql("sparql_filter_in", 'SELECT ?c WHERE { ?c ex:c_mktsegment ?s . FILTER(?s IN ("BUILDING", "MACHINERY")) }', f"select {iri('c_custkey', 'customer')} as c from customer where c_mktsegment in ('BUILDING', 'MACHINERY')", "customer")
sparql("sparql_optional", "SELECT ?d ?q WHERE { ?d ex:lang ?l OPTIONAL { ?d ex:quality ?q } }", f"select {iri('doc_id', 'documents')} as d, quality as q from documents left join labels using (doc_id)", "documents", "labels")
sparql("sparql_optional_filter", "SELECT ?d ?q WHERE { ?d ex:n_chars ?n OPTIONAL { ?d ex:quality ?q FILTER(?n > 2000) } }", f"select {iri('d.doc_id', 'documents')} as d, quality as q from documents d left join labels l on d.doc_id = l.doc_id and n_chars > 2000", "documents", "labels")
sparql("sparql_union", "SELECT ?x ?name WHERE { { ?x ex:c_name ?name } UNION { ?x ex:s_name ?name } }", f"select {iri('c_custkey', 'customer')} as x, c_name as name from customer union all select {iri('s_suppkey', 'supplier')}, s_name from supplier", "customer", "supplier")
sparql("sparql_minus", "SELECT ?d WHERE { ?d ex:lang ?l MINUS { ?d ex:quality ?q } }", f"select {iri('doc_id', 'documents')} as d from documents where doc_id not in (select doc_id from labels)", "documents", "labels")
sparql("sparql_exists", "SELECT ?c WHERE { ?c ex:c_name ?n FILTER EXISTS { ?o ex:o_custkey ?c ; ex:o_totalprice ?t . FILTER(?t > 400000) } }", f"select {iri('c_custkey', 'customer')} as c from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 400000)", "customer", "orders")
sparql("sparql_not_exists", "SELECT ?c WHERE { ?c ex:c_name ?n FILTER NOT EXISTS { ?o ex:o_custkey ?c } }", f"select {iri('c_custkey', 'customer')} as c from customer where not exists (select 1 from orders where o_custkey = c_custkey)", "customer", "orders")
sparql("sparql_exists_expression", "SELECT ?c ?has WHERE { ?c ex:c_acctbal ?b BIND((EXISTS { ?o ex:o_custkey ?c } || ?b < 0) AS ?has) }", f"select {iri('c_custkey', 'customer')} as c, (c_custkey in (select o_custkey from orders) or c_acctbal < 0) as has from customer", "customer", "orders")
sparql("sparql_values", 'SELECT ?n ?k WHERE { VALUES (?name ?k) { ("ASIA" 1) ("EUROPE" 2) (UNDEF 3) } ?r ex:r_name ?name . ?x ex:n_regionkey ?r ; ex:n_name ?n }', "select n_name as n, k from nation join region on n_regionkey = r_regionkey join (values ('ASIA', 1), ('EUROPE', 2), (null, 3)) t(a, k) on a is null or a = r_name", "nation", "region")
sparql("sparql_bind", "SELECT ?p ?double ?kind WHERE { ?p ex:p_size ?s BIND(?s * 2 + 1 AS ?double) BIND(IF(?s > 25, \"large\", \"small\") AS ?kind) }", f"select {iri('p_partkey', 'part')} as p, p_size * 2 + 1 as double, case when p_size > 25 then 'large' else 'small' end as kind from part", "part")
sparql("sparql_subselect", "SELECT ?c ?n WHERE { ?c ex:c_mktsegment \"BUILDING\" { SELECT ?c (COUNT(*) AS ?n) WHERE { ?o ex:o_custkey ?c } GROUP BY ?c } }", f"select {iri('c_custkey', 'customer')} as c, count(*) as n from customer join orders on c_custkey = o_custkey where c_mktsegment = 'BUILDING' group by c_custkey", "customer", "orders")
sparql("sparql_distinct", "SELECT DISTINCT ?s ?n WHERE { ?c ex:c_mktsegment ?s ; ex:c_nationkey ?n }", f"select distinct c_mktsegment as s, {iri('c_nationkey', 'nation')} as n from customer", "customer")
sparql("sparql_order_limit_offset", "SELECT ?o ?t WHERE { ?x ex:o_totalprice ?t BIND(STR(?x) AS ?o) } ORDER BY DESC(?t) ?o LIMIT 20 OFFSET 5", f"select {iri('o_orderkey', 'orders')} as o, o_totalprice as t from orders order by 2 desc, 1 limit 20 offset 5", "orders")

# --- aggregates -----------------------------------------------------------------

sparql("sparql_agg_count", "SELECT ?s (COUNT(*) AS ?n) (COUNT(?b) AS ?m) (COUNT(DISTINCT ?k) AS ?d) WHERE { ?c ex:c_mktsegment ?s ; ex:c_nationkey ?k ; ex:c_acctbal ?b } GROUP BY ?s", "select c_mktsegment as s, count(*) as n, count(c_acctbal) as m, count(distinct c_nationkey) as d from customer group by 1", "customer")
sparql("sparql_agg_sum_avg", "SELECT ?b (SUM(?s) AS ?total) (xsd:double(AVG(?s)) AS ?mean) WHERE { ?p ex:p_brand ?b ; ex:p_size ?s } GROUP BY ?b", "select p_brand as b, cast(sum(p_size) as bigint) as total, round(avg(p_size), 10) as mean from part group by 1", "part")
sparql("sparql_agg_min_max", "SELECT ?b (MIN(?s) AS ?low) (MAX(?s) AS ?high) (MIN(?n) AS ?first) WHERE { ?p ex:p_brand ?b ; ex:p_size ?s ; ex:p_name ?n } GROUP BY ?b", "select p_brand as b, min(p_size) as low, max(p_size) as high, min(p_name) as first from part group by 1", "part")
sparql("sparql_agg_group_concat", 'SELECT ?r (GROUP_CONCAT(?n; SEPARATOR="|") AS ?names) WHERE { ?x ex:n_regionkey ?r ; ex:n_name ?n } GROUP BY ?r', f"select {iri('n_regionkey', 'region')} as r, string_agg(n_name, '|' order by n_name) as names from nation group by n_regionkey", "nation")
sparql("sparql_agg_having", "SELECT ?c (COUNT(?o) AS ?n) WHERE { ?o ex:o_custkey ?c } GROUP BY ?c HAVING(COUNT(?o) > 12)", f"select {iri('o_custkey', 'customer')} as c, count(*) as n from orders group by o_custkey having count(*) > 12", "orders")
sparql("sparql_agg_empty", 'SELECT (COUNT(*) AS ?n) (SUM(?s) AS ?t) WHERE { ?p ex:p_size ?s FILTER(?s < 0) }', "select 0 as n, 0 as t", "part")
sparql("sparql_agg_expression_key", "SELECT ?k (COUNT(*) AS ?n) WHERE { ?p ex:p_size ?s } GROUP BY (FLOOR(?s / 10) AS ?k)", "select cast(floor(p_size / 10) as decimal(38,10)) as k, count(*) as n from part group by 1", "part")

# --- functions --------------------------------------------------------------------

sparql(
    "sparql_fn_string",
    'SELECT ?n (STRLEN(?n) AS ?len) (UCASE(?n) AS ?up) (LCASE(?n) AS ?low) (SUBSTR(?n, 2, 3) AS ?sub) (STRBEFORE(?n, "N") AS ?bef) (STRAFTER(?n, "N") AS ?aft) (CONTAINS(?n, "AN") AS ?has) (STRSTARTS(?n, "A") AS ?st) (STRENDS(?n, "A") AS ?en) (CONCAT(?n, "-", ?n) AS ?cat) (REPLACE(?n, "[AEIOU]", "_") AS ?rep) (ENCODE_FOR_URI(CONCAT(?n, " ~*/")) AS ?enc) WHERE { ?x ex:n_name ?n }',
    "select n_name as n, length(n_name) as len, upper(n_name) as up, lower(n_name) as low, substr(n_name, 2, 3) as sub, case when contains(n_name, 'N') then substr(n_name, 1, instr(n_name, 'N') - 1) else '' end as bef, case when contains(n_name, 'N') then substr(n_name, instr(n_name, 'N') + 1) else '' end as aft, contains(n_name, 'AN') as has, starts_with(n_name, 'A') as st, ends_with(n_name, 'A') as en, n_name || '-' || n_name as cat, regexp_replace(n_name, '[AEIOU]', '_', 'g') as rep, replace(n_name, ' ', '%20') || '%20~%2A%2F' as enc from nation",
    "nation",
)
sparql(
    "sparql_fn_numeric",
    "SELECT ?s (ABS(0 - ?s) AS ?a) (xsd:integer(CEIL(?s / 4)) AS ?c) (xsd:integer(FLOOR(?s / 4)) AS ?f) (xsd:integer(ROUND(?s / 4)) AS ?r) (xsd:double(?s / 4) AS ?d) (xsd:string(?s) AS ?t) (?s - 3 AS ?m) (-?s AS ?neg) (xsd:boolean(?s - 1) AS ?b) WHERE { ?p ex:p_size ?s }",
    "select p_size as s, p_size as a, cast(ceil(p_size / 4) as bigint) as c, cast(floor(p_size / 4) as bigint) as f, cast(floor(p_size / 4 + 0.5) as bigint) as r, p_size / 4 as d, cast(p_size as varchar) as t, p_size - 3 as m, -p_size as neg, p_size <> 1 as b from part",
    "part",
)
sparql("sparql_fn_datetime", "SELECT ?e (YEAR(?t) AS ?y) (MONTH(?t) AS ?m) (DAY(?t) AS ?d) (HOURS(?t) AS ?h) (MINUTES(?t) AS ?i) (xsd:double(SECONDS(?t)) AS ?s) (TZ(?t) AS ?z) WHERE { ?e ex:ts ?t }", f"select {iri('event_id', 'events')} as e, year(ts) as y, month(ts) as m, day(ts) as d, hour(ts) as h, minute(ts) as i, millisecond(ts) / 1000 as s, 'Z' as z from events", "events")
sparql("sparql_fn_hash", "SELECT ?n (MD5(?n) AS ?a) (SHA1(?n) AS ?b) (SHA256(?n) AS ?c) WHERE { ?x ex:n_name ?n }", "select n_name as n, md5(n_name) as a, sha1(n_name) as b, sha256(n_name) as c from nation", "nation")
sparql("sparql_fn_cond", 'SELECT ?d (COALESCE(?q, -1) AS ?c) (BOUND(?q) AS ?b) (IF(?q = 1, "good", "bad") AS ?i) WHERE { ?d ex:lang ?l OPTIONAL { ?d ex:quality ?q } }', f"select {iri('doc_id', 'documents')} as d, coalesce(quality, -1) as c, quality is not null as b, case when quality = 1 then 'good' when quality is not null then 'bad' end as i from documents left join labels using (doc_id)", "documents", "labels")
sparql(
    "sparql_fn_term",
    'SELECT ?x (STR(?x) AS ?s) (ISIRI(?x) AS ?i) (ISLITERAL(?n) AS ?l) (ISNUMERIC(?n) AS ?num) (DATATYPE(?n) AS ?dt) (LANG(STRLANG(?n, "EN")) AS ?lg) (DATATYPE(STRDT("1", xsd:byte)) AS ?dd) (LANGMATCHES("en-gb", "EN") AS ?lm) (SAMETERM(?x, ?x) AS ?same) (STR(IRI(CONCAT("http://z/", ?n))) AS ?made) WHERE { ?x ex:r_name ?n }',
    f"select {iri('r_regionkey', 'region')} as x, {iri('r_regionkey', 'region')} as s, true as i, true as l, false as num, '{v.XSD_STRING}' as dt, 'en' as lg, '{v.XSD}byte' as dd, true as lm, true as same, 'http://z/' || r_name as made from region",
    "region",
)

# --- paths ------------------------------------------------------------------------

_TREE = "with recursive tc(s, o) as (select c_custkey, c_custkey // 2 from customer where c_custkey > 0 union select tc.s, tc.o // 2 from tc where tc.o > 0)"
sparql("sparql_path_seq", "SELECT ?c ?name WHERE { ?c ex:c_nationkey/ex:n_regionkey/ex:r_name ?name }", f"select {iri('c_custkey', 'customer')} as c, r_name as name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey", "customer", "nation", "region")
sparql("sparql_path_alt", "SELECT ?x ?n WHERE { ?x ex:c_nationkey|ex:s_nationkey ?n }", f"select {iri('c_custkey', 'customer')} as x, {iri('c_nationkey', 'nation')} as n from customer union all select {iri('s_suppkey', 'supplier')}, {iri('s_nationkey', 'nation')} from supplier", "customer", "supplier")
sparql("sparql_path_inverse", "SELECT ?r ?n WHERE { ?r ^ex:n_regionkey/ex:n_name ?n }", f"select {iri('n_regionkey', 'region')} as r, n_name as n from nation", "nation", "region")
sparql("sparql_path_plus", "SELECT ?a ?b WHERE { ?a ex:c_parent+ ?b }", f"{_TREE} select {iri('s', 'customer')} as a, {iri('o', 'customer')} as b from tc", "customer")
sparql("sparql_path_star_from", f"SELECT ?b WHERE {{ <{BASE}customer/77> ex:c_parent* ?b }}", f"{_TREE} select {iri('o', 'customer')} as b from tc where s = 77 union select '{BASE}customer/77'", "customer")
sparql("sparql_path_star", "SELECT ?a ?b WHERE { ?a ex:c_nationkey ?n . ?a ex:c_parent* ?b }", f"{_TREE} select {iri('s', 'customer')} as a, {iri('o', 'customer')} as b from tc union select {iri('c_custkey', 'customer')}, {iri('c_custkey', 'customer')} from customer", "customer")
sparql("sparql_path_optional", "SELECT ?a ?b WHERE { ?a ex:c_nationkey ?n . ?a ex:c_parent? ?b }", f"select {iri('c_custkey', 'customer')} as a, {iri('c_custkey', 'customer')} as b from customer union select {iri('c_custkey', 'customer')}, {iri('c_custkey // 2', 'customer')} from customer where c_custkey > 0", "customer")
sparql("sparql_path_negated", "SELECT ?x ?y WHERE { ?x !(rdf:type|ex:n_nationkey|ex:n_name|ex:n_comment|^ex:n_regionkey) ?y FILTER(ISIRI(?x) && ISIRI(?y)) }", "select x, y from (" + f"select {iri('n_nationkey', 'nation')} as x, {iri('n_regionkey', 'region')} as y from nation" + f" union all select '{BASE}Nation', {iri('n_nationkey', 'nation')} from nation)", "nation")


# --- forms and graphs -----------------------------------------------------------------


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


@query("select true as yes, false as no")
def sparql_ask(spark, sf_dir):
    e = Engine(dataset(spark, sf_dir, "nation", "region"))
    yes = e.ask(PREFIX + 'ASK { ?n ex:n_regionkey/ex:r_name "ASIA" }')
    no = e.ask(PREFIX + 'ASK { ?n ex:n_name "ATLANTIS" }')
    return spark.createDataFrame([(yes, no)], "yes boolean, no boolean")


@query(f"select '<' || {iri('n_regionkey', 'region')} || '>' as s, '<{BASE}has>' as p, '<' || {iri('n_nationkey', 'nation')} || '>' as o from nation union select '<' || {iri('n_nationkey', 'nation')} || '>', '<{BASE}label>', '\"' || n_name || '\"' from nation")
def sparql_construct(spark, sf_dir):
    return Engine(dataset(spark, sf_dir, "nation")).construct(PREFIX + "CONSTRUCT { ?r ex:has ?n . ?n ex:label ?l . ?l ex:bad ?n } WHERE { ?n ex:n_regionkey ?r ; ex:n_name ?l }")


@query(f"select '<{BASE}region/1>' as s, '<{BASE}r_name>' as p, '\"' || r_name || '\"' as o from region where r_regionkey = 1 union all select '<{BASE}region/1>', '<{BASE}r_regionkey>', '\"1\"^^<{v.XSD_INTEGER}>' union all select '<{BASE}region/1>', '<{v.TYPE}>', '<{BASE}Region>'")
def sparql_describe(spark, sf_dir):
    return Engine(dataset(spark, sf_dir, "region")).construct(f"DESCRIBE <{BASE}region/1>").where(~F.col("p").contains("comment"))


def documents_by_language(spark, sf_dir) -> State:
    """Each document's size in the graph of its language."""
    docs = frame(spark, sf_dir, "documents")
    quads = docs.select(
        F.concat(F.lit(f"<{BASE}documents/"), F.col("doc_id").cast("string"), F.lit(">")).alias("s"),
        F.lit(f"<{BASE}n_chars>").alias("p"),
        F.concat(F.lit('"'), F.col("n_chars").cast("string"), F.lit(f'"^^<{v.XSD_INTEGER}>')).alias("o"),
        F.concat(F.lit(f"<{BASE}lang/"), "lang", F.lit(">")).alias("g"),
    )
    return State(quads, quads.select("g").distinct())


@query(f"select '{BASE}lang/' || lang as g, count(*) as n, sum(n_chars)::bigint as chars from documents where lang in ('en', 'fr') group by lang")
def sparql_graph_named(spark, sf_dir):
    text = f"SELECT ?g (COUNT(*) AS ?n) (SUM(?c) AS ?chars) WHERE {{ GRAPH ?g {{ ?d <{BASE}n_chars> ?c }} FILTER(?g IN (<{BASE}lang/en>, <{BASE}lang/fr>)) }} GROUP BY ?g"
    return Engine(documents_by_language(spark, sf_dir).dataset()).select(text, native=True).select("g", "n", F.col("chars").cast("bigint").alias("chars"))


@query("select count(*) as n from (select distinct doc_id, n_chars from documents where lang in ('en', 'de'))")
def sparql_from(spark, sf_dir):
    text = f"SELECT (COUNT(*) AS ?n) FROM <{BASE}lang/en> FROM <{BASE}lang/de> WHERE {{ ?d ?p ?c }}"
    return Engine(documents_by_language(spark, sf_dir).dataset()).select(text, native=True)


# --- updates --------------------------------------------------------------------------

_N, _NAME = f"'<{BASE}nation/' || n_nationkey || '>'", f"'\"' || n_name || '\"'"
_NATIONS = f"select {_N} as s, '<{BASE}name>' as p, {_NAME} as o, '' as g from nation"


def nations(spark, sf_dir) -> State:
    """The nations' names, in the default graph."""
    df = frame(spark, sf_dir, "nation")
    quads = df.select(F.concat(F.lit(f"<{BASE}nation/"), F.col("n_nationkey").cast("string"), F.lit(">")).alias("s"), F.lit(f"<{BASE}name>").alias("p"), F.concat(F.lit('"'), "n_name", F.lit('"')).alias("o"), F.lit("").alias("g"))
    return State(quads, spark.createDataFrame([], "g string"))


def update(name: str, text: str, sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: st.apply(nations(spark, sf_dir), PREFIX + text).quads.select("s", "p", "o", "g")
    ORACLE_SQL[name] = sql


_X = f"'<{BASE}x>' as s, '<{BASE}p>' as p, '\"1\"' as o"
update("update_insert_data", 'INSERT DATA { ex:x ex:p "1" . GRAPH ex:g { ex:x ex:p "1" } }', f"{_NATIONS} union all select {_X}, '' as g union all select {_X}, '<{BASE}g>'")
update("update_delete_data", f'INSERT DATA {{ ex:x ex:p "1" }} ; DELETE DATA {{ ex:x ex:p "1" . ex:x ex:p "2" }}', _NATIONS)
update("update_delete_insert_where", 'DELETE { ?n ex:name ?l } INSERT { ?n ex:label ?u } WHERE { ?n ex:name ?l FILTER(STRSTARTS(?l, "A")) BIND(LCASE(?l) AS ?u) }', f"select {_N} as s, case when n_name like 'A%' then '<{BASE}label>' else '<{BASE}name>' end as p, case when n_name like 'A%' then lower({_NAME}) else {_NAME} end as o, '' as g from nation")
update("update_delete_where", f'DELETE WHERE {{ <{BASE}nation/3> ex:name ?l }}', f"{_NATIONS} where n_nationkey <> 3")
update("update_copy", "COPY DEFAULT TO ex:g ; CLEAR DEFAULT", f"select {_N} as s, '<{BASE}name>' as p, {_NAME} as o, '<{BASE}g>' as g from nation")
update("update_move", "MOVE DEFAULT TO ex:g ; MOVE ex:g TO ex:h", f"select {_N} as s, '<{BASE}name>' as p, {_NAME} as o, '<{BASE}h>' as g from nation")
update("update_add", 'INSERT DATA { GRAPH ex:g { ex:x ex:p "1" } } ; ADD DEFAULT TO ex:g', f"{_NATIONS} union all select {_N}, '<{BASE}name>', {_NAME}, '<{BASE}g>' from nation union all select {_X}, '<{BASE}g>'")
update("update_clear", "COPY DEFAULT TO ex:g ; COPY DEFAULT TO ex:h ; CLEAR GRAPH ex:g ; DROP GRAPH ex:h", _NATIONS)


# --- the store ------------------------------------------------------------------------


def stored(state: State) -> QuadStore:
    """A store of its own in the shared folder, with the state as revision 1; it goes when the session ends."""
    spark = state.quads.sparkSession
    path = f"{session.shared_folder(spark)}/quadloom-store-{uuid.uuid4().hex}"
    session.delete_at_end(spark, path)
    store = QuadStore(spark, path)
    store.mutate(lambda x: x.inserted(state.quads))
    return store


def in_store(name: str, change: Callable[[QuadStore], object], sql: str) -> None:
    """The quads of a store of nations after a change."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        store = stored(nations(spark, sf_dir))
        change(store)
        return store.state().quads.select("s", "p", "o", "g")

    QUERIES[name] = run
    ORACLE_SQL[name] = sql


def _copied(store: QuadStore) -> QuadStore:
    store.update(f"COPY DEFAULT TO <{BASE}g>")
    return store


def _restored(store: QuadStore) -> None:
    path = f"{store.path}-backup"
    session.delete_at_end(store.spark, path)
    told = store.export(path)
    store.update("CLEAR ALL")
    store.restore(path, told["sha256"])


_STATEMENT = f'<{BASE}x> <{BASE}p> "1" .'
_IN_G = f"select {_N} as s, '<{BASE}name>' as p, {_NAME} as o, '<{BASE}g>' as g from nation"
in_store("graph_put", lambda x: _copied(x).write_graph(_STATEMENT, "ntriples"), f"{_IN_G} union all select {_X}, '' as g")
in_store("graph_post", lambda x: _copied(x).write_graph(_STATEMENT, "turtle", BASE + "g", replace=False), f"{_NATIONS} union all {_IN_G} union all select {_X}, '<{BASE}g>' as g")
in_store("graph_delete", lambda x: _copied(x).delete_graph(), _IN_G)
in_store("tell", lambda x: x.tell(_STATEMENT, "turtle", gate=Gate(Reasoner("rules-mvp"))), f"{_NATIONS} union all select {_X}, '' as g")
in_store("backup_restore", _restored, _NATIONS)


@query(f"select {iri('n_nationkey', 'nation')} as n, 'region/' || n_regionkey as r from nation")
def inferred_read_model(spark, sf_dir):
    """What is asserted and what follows from it, in one dataset."""
    df = frame(spark, sf_dir, "nation")
    named = lambda kind, key: F.concat(F.lit(f"<{BASE}{kind}/"), F.col(key).cast("string"), F.lit(">"))
    quads = df.select(named("nation", "n_nationkey").alias("s"), F.lit(f"<{BASE}in>").alias("p"), named("region", "n_regionkey").alias("o"), F.lit("").alias("g"))
    store = stored(State(quads, spark.createDataFrame([], "g string")))
    store.update(f"INSERT DATA {{ <{BASE}in> <{v.SUB_PROPERTY}> <{BASE}within> . <{BASE}holds> <{v.INVERSE_OF}> <{BASE}within> }}")
    found = store.inferred_engine(Reasoner("rules-mvp")).select(PREFIX + "SELECT ?n ?r { ?n ex:within ?r . ?r ex:holds ?n }", native=True)
    return found.select("n", F.substring(F.col("r"), len(BASE) + 1, 100).alias("r"))


@query(f"select distinct '<{BASE}lang/' || lang || '>' as g from documents where lang is not null")
def named_graphs(spark, sf_dir):
    return documents_by_language(spark, sf_dir).graphs.where("g is not null").select("g")


@query("select count(*) as quads, count(distinct lang) as graphs, count(*) = 0 as empty, 1 as revision from (select distinct doc_id, n_chars, lang from documents)")
def dataset_stats(spark, sf_dir):
    x = stored(documents_by_language(spark, sf_dir)).stats()
    return spark.createDataFrame([(x["quad_count"], x["named_graph_count"], x["is_empty"], x["revision"])], "quads long, graphs long, empty boolean, revision long")


@query("select 'inserted' as side, count(*) as n from nation where n_name like 'A%' union all select 'removed', 0")
def snapshot_delta(spark, sf_dir):
    before = nations(spark, sf_dir)
    after = st.apply(before, PREFIX + 'INSERT { ?n a ex:Early } WHERE { ?n ex:name ?l FILTER(STRSTARTS(?l, "A")) } ; DELETE DATA { ex:x ex:y ex:z }')
    new, gone = delta(Snapshot.of(before.quads).triples, Snapshot.of(after.quads).triples)
    return new.agg(F.count(F.lit(1)).alias("n")).select(F.lit("inserted").alias("side"), "n").union(gone.agg(F.count(F.lit(1)).alias("n")).select(F.lit("removed"), "n"))


@query("select count(*) * 2 as supported, count(*) * 2 as literal_objects, 0 as bnode_subjects, 0 as bnode_objects, 0 as flattened_named_graph_quads from supplier")
def snapshot_coverage(spark, sf_dir):
    quads = dataset(spark, sf_dir, "supplier").quads().where(~F.col("p").rlike("s_(address|phone|acctbal|comment)>"))
    c = Snapshot.of(quads).coverage
    return spark.createDataFrame([(c["supported"], c["literal_objects"], c["bnode_subjects"], c["bnode_objects"], c["flattened_named_graph_quads"])], "supported long, literal_objects long, bnode_subjects long, bnode_objects long, flattened_named_graph_quads long")


# --- reasoning ----------------------------------------------------------------------


def bare(df: DataFrame, s, p: str, o) -> DataFrame:
    return df.select(s.alias("s"), F.lit(p).alias("p"), o.alias("o"))


def res(name: str, column: str):
    return F.concat(F.lit(f"{name}/"), F.col(column).cast("string"))


def closed(facts: DataFrame, axioms: list[tuple[str, str, str]], policy: Policy = Policy()) -> tuple[DataFrame, DataFrame, rules.Identity, Schema]:
    """(triples, types, identity, schema) of facts under axioms; a triple may be there twice, which all that reads them allows for."""
    spark = facts.sparkSession
    triples = facts.union(spark.createDataFrame(axioms, rules.TRIPLE))
    schema = Schema.of(triples, policy)
    found = rules.identity(triples, schema, policy, rules.observed_resources(triples))
    return triples, rules.effective_types(triples, found, schema, policy), found, schema


def derived(facts: DataFrame, axioms: list, predicate: str) -> DataFrame:
    _, _, found, _ = closed(facts, axioms)
    out = rules.expanded(found.facts, found.clusters, "s", "o").where(F.col("p") == predicate).select("s", "o").distinct()
    return out.join(facts.where(F.col("p") == predicate).select("s", "o").distinct(), ["s", "o"], "left_anti")


_HIERARCHY = "select 'nation/' || n_nationkey as s, 'region/' || n_regionkey as o from nation union all select 'region/' || r_regionkey, 'Place' from region union all select distinct p_brand, p_type from part union all select distinct p_type, 'Part' from part"


def hierarchy(spark, sf_dir, predicate: str) -> DataFrame:
    """Nations in regions, regions and types in one top, brands in types, as axioms of a hierarchy."""
    n, r, p = (frame(spark, sf_dir, x) for x in ("nation", "region", "part"))
    edges = n.select(res("nation", "n_nationkey").alias("s"), res("region", "n_regionkey").alias("o")).union(r.select(res("region", "r_regionkey"), F.lit("Place"))).union(p.select("p_brand", "p_type").distinct()).union(p.select("p_type", F.lit("Part")).distinct())
    return edges.select("s", F.lit(predicate).alias("p"), "o")


def derived_hierarchy(spark, sf_dir, predicate: str) -> DataFrame:
    return rules.derived_axioms(Schema.of(hierarchy(spark, sf_dir, predicate), Policy()), Policy(), spark).select("s", "o")


_CLOSURE = f"with recursive e(s, o) as ({_HIERARCHY}), cl(s, o) as (select s, o from e union select cl.s, e.o from cl join e on cl.o = e.s) select * from cl except select * from e"


@query(_CLOSURE)
def rdfs_subclass_closure(spark, sf_dir):
    return derived_hierarchy(spark, sf_dir, v.SUB_CLASS)


@query(_CLOSURE)
def rdfs_subproperty_closure(spark, sf_dir):
    return derived_hierarchy(spark, sf_dir, v.SUB_PROPERTY)


def order_facts(spark, sf_dir) -> DataFrame:
    o = frame(spark, sf_dir, "orders")
    c = frame(spark, sf_dir, "customer")
    return bare(o, res("order", "o_orderkey"), "placedBy", res("customer", "o_custkey")).union(bare(c, res("customer", "c_custkey"), "livesIn", res("nation", "c_nationkey")))


@query("select 'order/' || o_orderkey as s, p, 'customer/' || o_custkey as o from orders, (values ('relatedTo'), ('linkedTo')) t(p)")
def rdfs_property_propagation(spark, sf_dir):
    _, _, found, _ = closed(order_facts(spark, sf_dir), [("placedBy", v.SUB_PROPERTY, "relatedTo"), ("relatedTo", v.SUB_PROPERTY, "linkedTo")])
    return found.facts.where(F.col("p").isin("relatedTo", "linkedTo")).select("s", "p", "o")


@query("select distinct i, c from (select 'order/' || o_orderkey as i, unnest(['Order', 'Thing']) as c from orders union all select 'customer/' || o_custkey, unnest(['Customer', 'Agent', 'Thing']) from orders)")
def rdfs_type_propagation(spark, sf_dir):
    facts = order_facts(spark, sf_dir).where("p = 'placedBy'")
    axioms = [("placedBy", v.DOMAIN, "Order"), ("placedBy", v.RANGE, "Customer"), ("Customer", v.SUB_CLASS, "Agent"), ("Agent", v.SUB_CLASS, "Thing"), ("Order", v.SUB_CLASS, "Thing")]
    return closed(facts, axioms)[1].select("i", "c")


@query("select distinct i, c, rank, origin from (select 'order/' || o_orderkey as i, 'Order' as c, 10 as rank, 'domain-derived via placedBy' as origin from orders union all select 'customer/' || o_custkey, 'Customer', 20, 'range-derived via placedBy' from orders)")
def rdfs_domain_range(spark, sf_dir):
    facts = order_facts(spark, sf_dir).where("p = 'placedBy'")
    return closed(facts, [("placedBy", v.DOMAIN, "Order"), ("placedBy", v.RANGE, "Customer")])[1].select("i", "c", "rank", "origin")


@query("select 'customer/' || o_custkey as s, 'order/' || o_orderkey as o from orders")
def owl_inverse(spark, sf_dir):
    return derived(order_facts(spark, sf_dir), [("placed", v.INVERSE_OF, "placedBy")], "placed")


@query("select 'supplier/' || min(s_suppkey) over (partition by s_nationkey) as s, 'supplier/' || s_suppkey as o from supplier qualify s <> o")
def owl_symmetric(spark, sf_dir):
    """Each supplier is near the first one of its nation, so that one is near each of them."""
    own = frame(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    pairs = own.join(own.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("k")), "s_nationkey").where("s_suppkey <> k")
    return derived(bare(pairs, res("supplier", "s_suppkey"), "near", res("supplier", "k")), [("near", v.TYPE, v.SYMMETRIC)], "near")


@query(f"{_TREE} select 'customer/' || s as s, 'customer/' || o as o from tc where o <> s // 2")
def owl_transitive(spark, sf_dir):
    c = frame(spark, sf_dir, "customer").where("c_custkey > 0").withColumn("parent", F.floor(F.col("c_custkey") / 2))
    return derived(bare(c, res("customer", "c_custkey"), "under", res("customer", "parent")), [("under", v.TYPE, v.TRANSITIVE)], "under")


@query("select distinct n as s, n as o from (select 'order/' || o_orderkey as n from orders union all select 'customer/' || o_custkey from orders)")
def owl_reflexive(spark, sf_dir):
    facts = order_facts(spark, sf_dir).where("p = 'placedBy'")
    return derived(facts, [("knows", v.TYPE, v.REFLEXIVE)], "knows")


@query("select 'order/' || o_orderkey as s, 'nation/' || c_nationkey as o from orders join customer on o_custkey = c_custkey")
def owl_chain(spark, sf_dir):
    axioms = [("shippedTo", v.CHAIN, "l1"), ("l1", v.FIRST, "placedBy"), ("l1", v.REST, "l2"), ("l2", v.FIRST, "livesIn"), ("l2", v.REST, v.NIL)]
    return derived(order_facts(spark, sf_dir), axioms, "shippedTo")


@query("select 'customer/' || c_custkey as i, unnest(['Customer', 'Client']) as c from customer")
def owl_equivalent_class(spark, sf_dir):
    c = frame(spark, sf_dir, "customer")
    return closed(bare(c, res("customer", "c_custkey"), v.TYPE, F.lit("Customer")), [("Customer", v.EQUIVALENT_CLASS, "Client")])[1].select("i", "c")


@query("select 'order/' || o_orderkey as s, 'customer/' || o_custkey as o from orders")
def owl_equivalent_property(spark, sf_dir):
    return derived(order_facts(spark, sf_dir), [("orderedBy", v.EQUIVALENT_PROPERTY, "placedBy")], "orderedBy")


_CLUSTERS = "with recursive e(x, y) as (select a.doc_id, b.doc_id from documents a join documents b on {on}), r(x, y) as (select x, y from e union select r.x, e.y from r join e on r.y = e.x)"


@query(_CLUSTERS.format(on="a.text = b.text or a.n_chars = b.n_chars") + " select x as member, min(y) as canonical from r group by x having count(*) > 1")
def owl_sameas_clusters(spark, sf_dir):
    d = frame(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    edges = None
    for key in (F.xxhash64("text"), F.col("n_chars")):
        own = d.select("doc_id", key.alias("k"))
        one = own.join(own.groupBy("k").agg(F.min("doc_id").alias("m")), "k").select(F.col("doc_id").alias("a"), F.col("m").alias("b"))
        edges = one if edges is None else edges.union(one)
    return components(edges)


@query("select 'customer/' || min(c_custkey) over (partition by c_nationkey) as a, 'customer/' || c_custkey as b from customer qualify a <> b")
def owl_inverse_functional_sameas(spark, sf_dir):
    c = frame(spark, sf_dir, "customer")
    number = lambda k: F.concat(F.lit("customer/"), F.lpad(F.col(k).cast("string"), 9, "0"))
    facts = bare(c, number("c_custkey"), "nation", res("nation", "c_nationkey"))
    schema = Schema.of(facts.sparkSession.createDataFrame([("nation", v.TYPE, v.INVERSE_FUNCTIONAL)], rules.TRIPLE), Policy())
    out = rules.implied_equalities(facts, schema)
    plain = lambda k: F.concat(F.lit("customer/"), F.regexp_replace(F.split(k, "/")[1], "^0+(?=.)", ""))
    return out.select(plain("a").alias("a"), plain("b").alias("b"))


@query("select 'customer/' || min(c_custkey) over (partition by c_nationkey) as a, 'customer/' || c_custkey as b from customer qualify a <> b")
def owl_functional_sameas(spark, sf_dir):
    """A nation houses one customer, it is said: so all customers of a nation are the same."""
    c = frame(spark, sf_dir, "customer")
    number = F.concat(F.lit("customer/"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"))
    schema = Schema.of(spark.createDataFrame([("houses", v.TYPE, v.FUNCTIONAL)], rules.TRIPLE), Policy())
    out = rules.implied_equalities(bare(c, res("nation", "c_nationkey"), "houses", number), schema)
    plain = lambda k: F.concat(F.lit("customer/"), F.regexp_replace(F.split(k, "/")[1], "^0+(?=.)", "")).alias(k)
    return out.select(plain("a"), plain("b"))


@query(_CLUSTERS.format(on="a.text = b.text or a.n_chars = b.n_chars") + " select x as member, min(y) as canonical from r group by x having count(*) > 1")
def owl_identity_fixpoint(spark, sf_dir):
    """Text and size are both inverse functional: equality by one makes equality by the other, until nothing is new."""
    d = frame(spark, sf_dir, "documents")
    number = F.concat(F.lit("d/"), F.lpad(F.col("doc_id").cast("string"), 12, "0"))
    facts = bare(d, number, "hasText", F.concat(F.lit("t/"), F.md5("text"))).union(bare(d, number, "hasSize", F.concat(F.lit("n/"), F.col("n_chars").cast("string"))))
    _, _, found, _ = closed(facts, [("hasText", v.TYPE, v.INVERSE_FUNCTIONAL), ("hasSize", v.TYPE, v.INVERSE_FUNCTIONAL)])
    plain = lambda k: F.substring(k, 3, 12).cast("long").alias(k)
    return found.clusters.select(plain("member"), plain("canonical"))


@query("select 'nation/' || a.n_nationkey as l, 'nation/' || b.n_nationkey as r from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey")
def owl_all_different(spark, sf_dir):
    """All nations are different, a list says; those of a region are said to be the same, so they conflict, pair by pair."""
    n = frame(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    same = n.join(n.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("m")), "n_regionkey").where("n_nationkey <> m")
    cell = lambda k: F.concat(F.lit("cell/"), k.cast("string"))
    place = n.select("n_nationkey", F.row_number().over(Window.orderBy("n_nationkey")).alias("k"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))
    axioms = bare(place, cell(F.col("k")), v.FIRST, res("nation", "n_nationkey")).union(bare(place, cell(F.col("k")), v.REST, F.when(F.col("k") == F.col("n"), v.NIL).otherwise(cell(F.col("k") + 1))))
    facts = bare(same, res("nation", "n_nationkey"), v.SAME_AS, res("nation", "m")).union(axioms)
    triples, _, found, schema = closed(facts, [("group", v.TYPE, v.ALL_DIFFERENT), ("group", v.DISTINCT_MEMBERS, "cell/1")])
    return consistency.different(triples, found, schema).select(F.col("left").alias("l"), F.col("right").alias("r"))


def line_types(spark, sf_dir) -> DataFrame:
    li = frame(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag").distinct()
    return li.select(F.concat_ws("/", F.lit("ps"), "l_partkey", "l_suppkey").alias("s"), F.lit(v.TYPE).alias("p"), F.concat(F.lit("Flag"), "l_returnflag").alias("o"))


@query("with f as (select distinct l_partkey p, l_suppkey s, l_returnflag r from lineitem) select 'ps/' || a.p || '/' || a.s as focus, 'Flag' || a.r as l, 'Flag' || b.r as r from f a join f b on a.p = b.p and a.s = b.s and a.r < b.r")
def consistency_disjoint(spark, sf_dir):
    axioms = [("FlagA", v.DISJOINT_WITH, "FlagN"), ("FlagN", v.DISJOINT_WITH, "FlagR"), ("FlagR", v.DISJOINT_WITH, "FlagA")]
    _, types, _, schema = closed(line_types(spark, sf_dir), axioms)
    return consistency.disjoint(types, schema).select("focus", F.col("left").alias("l"), F.col("right").alias("r"))


def listed(kind: str, members: list[str]) -> list[tuple[str, str, str]]:
    """Axioms of a group with a list of members."""
    axioms = [("group", v.TYPE, kind), ("group", v.MEMBERS, "l0")]
    for k, m in enumerate(members):
        axioms += [(f"l{k}", v.FIRST, m), (f"l{k}", v.REST, f"l{k + 1}" if k + 1 < len(members) else v.NIL)]
    return axioms


@query("with f as (select distinct l_partkey p, l_suppkey s, l_returnflag r from lineitem) select 'ps/' || a.p || '/' || a.s as focus, 'Flag' || a.r as l, 'Flag' || b.r as r from f a join f b on a.p = b.p and a.s = b.s and a.r < b.r")
def owl_all_disjoint_classes(spark, sf_dir):
    _, types, _, schema = closed(line_types(spark, sf_dir), listed(v.ALL_DISJOINT_CLASSES, ["FlagR", "FlagA", "FlagN"]))
    return consistency.disjoint(types, schema).select("focus", F.col("left").alias("l"), F.col("right").alias("r"))


@query("with f as (select distinct l_partkey p, l_suppkey s, l_returnflag r from lineitem) select 'part/' || a.p as focus, 'flag' || a.r as l, 'flag' || b.r as r, a.s as supplier from f a join f b on a.p = b.p and a.s = b.s and a.r < b.r")
def owl_all_disjoint_properties(spark, sf_dir):
    li = frame(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag")
    facts = li.select(res("part", "l_partkey").alias("s"), F.concat(F.lit("flag"), "l_returnflag").alias("p"), res("supplier", "l_suppkey").alias("o"))
    _, _, found, schema = closed(facts, listed(v.ALL_DISJOINT_PROPERTIES, ["flagN", "flagR", "flagA"]))
    return consistency.property_disjoint(found, schema).select("focus", F.col("left").alias("l"), F.col("right").alias("r"), F.regexp_extract("left_origin", r"supplier/(\d+)", 1).cast("bigint").alias("supplier"))


@query("select distinct 'ps/' || l_partkey || '/' || l_suppkey as focus, 'FlagR' as support from lineitem where l_returnflag = 'R'")
def consistency_nothing(spark, sf_dir):
    _, types, _, schema = closed(line_types(spark, sf_dir), [("FlagR", v.SUB_CLASS, v.NOTHING)])
    return consistency.nothing(types, schema).select("focus", F.col("left").alias("support"))


def tree(spark, sf_dir) -> DataFrame:
    c = frame(spark, sf_dir, "customer").withColumn("parent", F.floor(F.col("c_custkey") / 2))
    return bare(c, res("customer", "c_custkey"), "under", res("customer", "parent"))


@query("select 'customer/0' as focus")
def consistency_irreflexive(spark, sf_dir):
    _, _, found, schema = closed(tree(spark, sf_dir), [("under", v.TYPE, v.IRREFLEXIVE)])
    return consistency.irreflexive(found, schema).select("focus")


@query("with e as (select distinct l_suppkey s, l_partkey % 100 o from lineitem) select 'n/' || a.s as focus, 'n/' || a.o as other from e a join e b on a.s = b.o and a.o = b.s where 'n/' || a.s < 'n/' || a.o")
def consistency_asymmetric(spark, sf_dir):
    li = frame(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_partkey") % 100).alias("o")).distinct()
    _, _, found, schema = closed(bare(li, res("n", "l_suppkey"), "beats", res("n", "o")), [("beats", v.TYPE, v.ASYMMETRIC)])
    return consistency.asymmetric(found, schema).select("focus", F.col("right").alias("other"))


@query("select distinct 'part/' || l_partkey as focus, a.l_suppkey as supplier from (select distinct l_partkey, l_suppkey from lineitem where l_returnflag = 'A') a join (select distinct l_partkey, l_suppkey from lineitem where l_returnflag = 'R') b using (l_partkey, l_suppkey)")
def consistency_property_disjoint(spark, sf_dir):
    li = frame(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag")
    facts = li.select(res("part", "l_partkey").alias("s"), F.concat(F.lit("flag"), "l_returnflag").alias("p"), res("supplier", "l_suppkey").alias("o"))
    _, _, found, schema = closed(facts, [("flagA", v.PROPERTY_DISJOINT, "flagR")])
    return consistency.property_disjoint(found, schema).select("focus", F.regexp_extract("left_origin", r"supplier/(\d+)", 1).cast("bigint").alias("supplier"))


@query("with m as (select doc_id, text, min(doc_id) over (partition by lang, n_chars) as k from documents) select 'd/' || m.doc_id as l, 'd/' || m.k as r from m join documents d on d.doc_id = m.k where m.doc_id <> m.k and m.text = d.text")
def consistency_different_from(spark, sf_dir):
    """Documents of one text are the same; each is said to differ from the first of its language and size."""
    d = frame(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", F.md5("text").alias("k"))
    same = d.join(d.groupBy("k").agg(F.min("doc_id").alias("m")), "k").where("doc_id <> m")
    first = d.select("doc_id", F.min("doc_id").over(Window.partitionBy("lang", "n_chars")).alias("m")).where("doc_id <> m")
    facts = bare(same, res("d", "doc_id"), v.SAME_AS, res("d", "m")).union(bare(first, res("d", "doc_id"), v.DIFFERENT_FROM, res("d", "m")))
    triples, _, found, schema = closed(facts, [])
    return consistency.different(triples, found, schema).select(F.col("left").alias("l"), F.col("right").alias("r"))


@query(
    "with f as (select distinct 'ps/' || l_partkey || '/' || l_suppkey as s, 'Flag' || l_returnflag as o from lineitem), "
    "focus as (select min(a.s) as x from f a join f b on a.s = b.s and a.o = 'FlagA' and b.o = 'FlagR') "
    f"select s, '{v.TYPE}' as p, o, case when s = x then 100 else 0 end + case when s = x and o in ('FlagA', 'FlagR') then 300 else 0 end + case o when 'FlagA' then 80 + 60 when 'FlagR' then 70 + 50 else 0 end as score "
    "from f, focus where s = x or o in ('FlagA', 'FlagR') order by score desc, s, o limit 5"
)
def reject_attribution(spark, sf_dir):
    inserted = line_types(spark, sf_dir)
    triples, types, found, schema = closed(inserted, [("FlagA", v.DISJOINT_WITH, "FlagR")])
    first = consistency.disjoint(types, schema).orderBy("focus", "left", "right").first().asDict()
    return consistency.attribution(consistency.explanation(first), inserted)


@query("select 'Flag' || f as c, 'no rule reads owl:' || k as said from (select distinct l_returnflag f from lineitem) , (values ('unionOf'), ('complementOf')) t(k)")
def diagnostics_unsupported(spark, sf_dir):
    flags = line_types(spark, sf_dir).select("o").distinct()
    made = flags.select(F.col("o").alias("s"), F.explode(F.array(F.lit(v.OWL + "unionOf"), F.lit(v.OWL + "complementOf"))).alias("p"), F.lit("list").alias("o"))
    out = rules.unsupported(made.select("s", "p", "o"))
    return out.select(F.regexp_extract("message", r"<([^>]*)>", 1).alias("c"), F.split("message", ": ")[0].alias("said"))


@query("select '<http://ex.org/region/' || r_regionkey || '> <http://ex.org/r_name> \"' || r_name || '\" .' as value from region")
def write_ntriples(spark, sf_dir):
    return results.statement_lines(dataset(spark, sf_dir, "region").quads().where(F.col("p") == f"<{BASE}r_name>").select("s", "p", "o"))

