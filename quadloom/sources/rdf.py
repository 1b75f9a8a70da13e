"""RDF readers: N-Triples and N-Quads line by line inside the plan, Turtle and RDF/XML file by file.

Blank nodes get a label prefix for each load, so two loads never share one.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom import vocab as v
from quadloom.plans import algebra as a
from quadloom.plans.parser import Parser, SparqlSyntaxError, literal, unescape
from quadloom.session import ship

#: Extension -> format (fixed values).
FORMATS = {"ttl": "turtle", "nt": "ntriples", "rdf": "rdfxml", "xml": "rdfxml", "nq": "nquads"}
MEDIA_TYPES = {"text/turtle": "turtle", "application/x-turtle": "turtle", "application/n-triples": "ntriples", "application/rdf+xml": "rdfxml", "application/n-quads": "nquads"}
QUADS = "s string, p string, o string, g string"


class RdfSyntaxError(ValueError):
    """A payload that is not in the format it is said to be in."""


def format_of(path: str) -> str:
    """The format that a file's extension names; without a known one a configuration error."""
    ending = path.rsplit(".", 1)[-1].lower() if "." in os.path.basename(path) else ""
    if ending not in FORMATS:
        raise ValueError(f"{path}: no RDF format for the extension {ending!r}")
    return FORMATS[ending]


_IRI = r"<[^<>\"{}|^`\\\x00-\x20]*(?:\\u[0-9A-Fa-f]{4}[^<>\"{}|^`\\\x00-\x20]*)*>"
_BLANK = r"_:[\w](?:[\w.-]*[\w-])?"
_LITERAL = r"\"(?:[^\"\\\n\r]|\\.)*\"(?:@[A-Za-z]+(?:-[A-Za-z0-9]+)*|\^\^" + _IRI + ")?"
LINE = rf"^\s*({_IRI}|{_BLANK})\s*({_IRI})\s*({_IRI}|{_BLANK}|{_LITERAL})\s*({_IRI}|{_BLANK})?\s*\.\s*(?:#.*)?$"


def _unescaped(term: Column) -> Column:
    """Written escapes as the characters themselves; only terms with a backslash pay for it."""

    @F.pandas_udf("string")
    def slow(x: pd.Series) -> pd.Series:
        return x.map(lambda s: s if s is None else unescape(s), na_action="ignore")

    return F.when(term.contains("\\"), slow(term)).otherwise(term)


def _normal(term: Column, scope: str) -> Column:
    """Labels scoped, xsd:string left out, tags in lower case."""
    tag = F.regexp_extract(term, r'"(@[A-Za-z0-9-]+)$', 1)
    plain = F.when(term.endswith(f'"^^<{v.XSD_STRING}>'), F.substring(term, F.lit(1), F.char_length(term) - len(f"^^<{v.XSD_STRING}>")))
    tagged = F.when(term.startswith('"') & (tag != ""), F.concat(F.substring(term, F.lit(1), F.char_length(term) - F.char_length(tag)), F.lower(tag)))
    blank = F.when(term.startswith("_:"), F.concat(F.lit(f"_:{scope}"), F.substring(term, F.lit(3), F.char_length(term))))
    return F.coalesce(blank, plain, tagged, term)


def parse_lines(lines: DataFrame, quads: bool = True, scope: str | None = None, strict: bool = True) -> DataFrame:
    """(s, p, o, g) of N-Triples or N-Quads lines in column ``value``; a bad line is an error when it is read, or left out."""
    ship(lines.sparkSession)
    scope = uuid.uuid4().hex[:8] if scope is None else scope
    text = F.col("value")
    real = lines.where(text.rlike(r"^\s*[^\s#]"))
    parts = [F.regexp_extract(text, LINE, k) for k in (1, 2, 3, 4)]
    bad = parts[0] == "" if quads else (parts[0] == "") | (parts[3] != "")
    made = real.select(*(F.when(bad, F.raise_error(F.concat(F.lit("not a statement: "), F.substring(text, 1, 80)))).otherwise(x).alias(c) for x, c in zip(parts, "spog"))) if strict else real.where(~bad).select(*(x.alias(c) for x, c in zip(parts, "spog")))
    return made.select(*(_normal(_unescaped(F.col(c)), scope).alias(c) for c in "spog"))


class TurtleParser(Parser):
    """Turtle with the tokens of SPARQL: directives, statements, the same nodes and abbreviations."""

    def __init__(self, text: str, base: str, scope: str) -> None:
        text = re.sub(r"@(prefix|base)\b", lambda m: m[1].upper() + " ", text) if re.search(r"@(prefix|base)\b", text) else text
        super().__init__(text, base)
        self.ground, self.scope = True, scope

    def blank(self, label: str | None) -> a.Node:
        if label is None:
            self.fresh += 1
            label = f"a{self.fresh}"
        else:
            label = f"n{label}"
        return a.Const(f"_:{self.scope}{label}")

    def triples(self) -> Iterator[tuple[str, str, str]]:
        while self.kind != "end":
            if self.peek("PREFIX", "BASE"):
                self.prologue_one()
                continue
            out: list = []
            bracket = self.peek("[", "(")
            s = self.node(out)
            if not (bracket and out and self.peek(".")):
                self.properties(s, out)
            self.need(".")
            for t in out:
                if not t.p.term.startswith("<") or t.s.term.startswith('"'):
                    raise SparqlSyntaxError("a literal where a resource is needed")
                yield t.s.term, t.p.term, t.o.term

    def prologue_one(self) -> None:
        word = self.need("PREFIX", "BASE").upper()
        if word == "BASE":
            self.base = urljoin(self.base, unescape(self.pop("iri")[1:-1]))
        else:
            prefix = self.pop("pname")
            raw = unescape(self.pop("iri")[1:-1])
            self.prefixes[prefix[:-1]] = urljoin(self.base, raw) if self.base else raw
        self.take(".")


def parse_turtle(text: str, base: str = "", scope: str | None = None) -> list[tuple[str, str, str]]:
    try:
        return list(TurtleParser(text, base, uuid.uuid4().hex[:8] if scope is None else scope).triples())
    except SparqlSyntaxError as x:
        raise RdfSyntaxError(str(x)) from x


_XML = "{http://www.w3.org/XML/1998/namespace}"


def parse_rdfxml(text: str, base: str = "", scope: str | None = None) -> list[tuple[str, str, str]]:
    """RDF/XML: typed nodes, property attributes, parse types Resource, Collection and Literal, language and base."""
    scope = uuid.uuid4().hex[:8] if scope is None else scope
    try:
        root = ET.fromstring(text)
    except ET.ParseError as x:
        raise RdfSyntaxError(str(x)) from x
    out: list[tuple[str, str, str]] = []
    count = iter(range(1 << 60))
    rdf = "{" + v.RDF + "}"

    def fresh() -> str:
        return f"_:{scope}x{next(count)}"

    def name(tag: str) -> str:
        if not tag.startswith("{"):
            raise RdfSyntaxError(f"{tag} has no namespace")
        return tag[1:].replace("}", "", 1)

    def resolve(ref: str, at: str) -> str:
        return urljoin(at, ref) if at else ref

    def subject(e: ET.Element, at: str) -> str:
        if (x := e.get(rdf + "about")) is not None:
            return f"<{resolve(x, at)}>"
        if (x := e.get(rdf + "ID")) is not None:
            return f"<{resolve('#' + x, at)}>"
        if (x := e.get(rdf + "nodeID")) is not None:
            return f"_:{scope}n{x}"
        return fresh()

    def attributes(e: ET.Element, s: str, lang: str | None, at: str) -> None:
        for k, x in e.attrib.items():
            if k == rdf + "type":
                out.append((s, f"<{v.TYPE}>", f"<{resolve(x, at)}>"))
            elif k.startswith("{") and not k.startswith((rdf, _XML)):
                out.append((s, f"<{name(k)}>", literal(x, lang)))

    def node(e: ET.Element, lang: str | None, at: str) -> str:
        lang, at = e.get(_XML + "lang", lang), e.get(_XML + "base", at)
        s = subject(e, at)
        if e.tag != rdf + "Description":
            out.append((s, f"<{v.TYPE}>", f"<{name(e.tag)}>"))
        attributes(e, s, lang, at)
        number = 0
        for child in e:
            tag = child.tag
            if tag == rdf + "li":
                number += 1
                tag = f"{rdf}_{number}"
            prop(child, f"<{name(tag)}>", s, lang, at)
        return s

    def prop(e: ET.Element, p: str, s: str, lang: str | None, at: str) -> None:
        lang, at = e.get(_XML + "lang", lang) or None, e.get(_XML + "base", at)
        kind = e.get(rdf + "parseType")
        if (x := e.get(rdf + "resource")) is not None:
            o = f"<{resolve(x, at)}>"
            attributes(e, o, lang, at)
        elif (x := e.get(rdf + "nodeID")) is not None:
            o = f"_:{scope}n{x}"
        elif kind == "Resource":
            o = fresh()
            for child in e:
                prop(child, f"<{name(child.tag)}>", o, lang, at)
        elif kind == "Collection":
            o = f"<{v.NIL}>"
            for item in reversed([node(child, lang, at) for child in e]):
                cell = fresh()
                out.extend([(cell, f"<{v.FIRST}>", item), (cell, f"<{v.REST}>", o)])
                o = cell
        elif kind == "Literal":
            o = literal((e.text or "") + "".join(ET.tostring(c, encoding="unicode") for c in e), None, v.RDF + "XMLLiteral")
        elif len(e):
            o = node(e[0], lang, at)
        elif any(k.startswith("{") and not k.startswith((rdf, _XML)) for k in e.attrib):
            o = fresh()
            attributes(e, o, lang, at)
        else:
            d = e.get(rdf + "datatype")
            o = literal(e.text or "", None if d else lang, d)
        out.append((s, p, o))

    for e in root if root.tag == rdf + "RDF" else [root]:
        node(e, root.get(_XML + "lang"), root.get(_XML + "base", base))
    return out


def parse_payload(spark: SparkSession, payload: str, kind: str, base: str = "", scope: str | None = None) -> DataFrame:
    """(s, p, o, g) of one payload in memory."""
    if base and not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", base):
        raise ValueError(f"{base} is no absolute base IRI")
    scope = uuid.uuid4().hex[:8] if scope is None else scope
    if kind in ("ntriples", "nquads"):
        # other separators than these are ordinary characters of literals
        lines = spark.createDataFrame([(x,) for x in re.split(r"\r\n|\n|\r", payload)], "value string")
        try:
            rows = [tuple(r) for r in parse_lines(lines, kind == "nquads", scope).collect()]
        except PySparkException as x:
            found = re.search(r"not a statement: .*", str(x))
            if found:
                raise RdfSyntaxError(found[0]) from None
            raise
    else:
        rows = [(*t, "") for t in (parse_turtle if kind == "turtle" else parse_rdfxml)(payload, base, scope)]
    return spark.createDataFrame(rows, QUADS)




def read(spark: SparkSession, path: str, kind: str | None = None, graph: str | None = None, base: str | None = None) -> DataFrame:
    """(s, p, o, g) of files; ``graph``: all go to that graph, whatever the payload says."""
    ship(spark)
    kind = kind or format_of(path)
    scope = uuid.uuid4().hex[:8]
    if kind in ("ntriples", "nquads"):
        out = parse_lines(spark.read.text(path), kind == "nquads", scope)
    else:
        files = spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("file"))

        def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for text, file in zip(batch["value"], batch["file"]):
                    own = scope + hashlib.md5(file.encode()).hexdigest()[:16]  # the same when a task runs again
                    rows = (parse_turtle if kind == "turtle" else parse_rdfxml)(text, file if base is None else base, own)
                    yield pd.DataFrame([(*r, "") for r in rows], columns=list("spog"))

        out = files.mapInPandas(parse, QUADS)
    return out if graph is None else out.withColumn("g", F.lit(f"<{graph}>" if graph else ""))
