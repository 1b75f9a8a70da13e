"""Writers: solutions and Booleans as JSON, XML, CSV and TSV; graphs as N-Triples, Turtle and RDF/XML."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom import vocab as v

SOLUTION_TYPES = {"xml": "application/sparql-results+xml", "csv": "text/csv", "tsv": "text/tab-separated-values", "json": "application/sparql-results+json"}
GRAPH_TYPES = {"rdfxml": "application/rdf+xml", "turtle": "text/turtle", "ntriples": "application/n-triples"}


def negotiate(accept: str | None, graph: bool = False) -> str:
    """The format for an Accept header: fixed order of preference, weights do not count."""
    types = GRAPH_TYPES if graph else SOLUTION_TYPES
    for kind, media in types.items():
        if accept and media in accept:
            return kind
    return "ntriples" if graph else "json"


def parts(term: str) -> dict[str, str]:
    """A term as the JSON results format describes it."""
    if term.startswith("<"):
        return {"type": "uri", "value": term[1:-1]}
    if term.startswith("_:"):
        return {"type": "bnode", "value": term[2:]}
    text, _, suffix = term[1:].rpartition('"')
    out = {"type": "literal", "value": text}
    if suffix.startswith("@"):
        out["xml:lang"] = suffix[1:]
    elif suffix:
        out["datatype"] = suffix[3:-1]
    return out


_QUOTED = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def written(term: str) -> str:
    """A term as N-Triples writes it."""
    if not term.startswith('"'):
        return term
    text, _, suffix = term[1:].rpartition('"')
    return '"' + re.sub(r'[\\"\n\r\t]', lambda m: _QUOTED[m[0]], text) + '"' + suffix


def written_column(term: Column) -> Column:
    """The same inside a plan."""
    suffix = F.regexp_extract(term, r'"(@[A-Za-z0-9-]+|\^\^<[^>]*>)?$', 1)
    text = F.regexp_extract(term, r'(?s)^"(.*)"', 1)
    for old, new in _QUOTED.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return F.when(term.startswith('"'), F.concat(F.lit('"'), text, F.lit('"'), suffix)).otherwise(term)


def solutions(df: DataFrame, kind: str = "json") -> Iterator[str]:
    """The text of a result in pieces; rows come partition by partition, never all at once."""
    names = df.columns
    rows = df.toLocalIterator()
    match kind:
        case "json":
            yield json.dumps({"head": {"vars": names}})[:-1] + ', "results": {"bindings": ['
            for k, row in enumerate(rows):
                yield (", " if k else "") + json.dumps({n: parts(x) for n, x in zip(names, row) if x is not None}, ensure_ascii=False)
            yield "]}}"
        case "xml":
            yield '<?xml version="1.0"?>\n<sparql xmlns="http://www.w3.org/2005/sparql-results#"><head>' + "".join(f"<variable name={quoteattr(n)}/>" for n in names) + "</head><results>"
            for row in rows:
                yield "<result>" + "".join(f"<binding name={quoteattr(n)}>{_xml_term(x)}</binding>" for n, x in zip(names, row) if x is not None) + "</result>"
            yield "</results></sparql>"
        case "csv":
            yield ",".join(names) + "\r\n"
            for row in rows:
                yield ",".join("" if x is None else _csv(x) for x in row) + "\r\n"
        case "tsv":
            yield "\t".join("?" + n for n in names) + "\n"
            for row in rows:
                yield "\t".join("" if x is None else written(x) for x in row) + "\n"
        case _:
            raise ValueError(kind)


def _csv(term: str) -> str:
    p = parts(term)
    text = "_:" + p["value"] if p["type"] == "bnode" else p["value"]
    return '"' + text.replace('"', '""') + '"' if re.search(r'[",\r\n]', text) else text


def _xml_term(term: str) -> str:
    p = parts(term)
    if p["type"] != "literal":
        return f"<{p['type']}>{escape(p['value'])}</{p['type']}>"
    extra = f" xml:lang={quoteattr(p['xml:lang'])}" if "xml:lang" in p else f" datatype={quoteattr(p['datatype'])}" if "datatype" in p else ""
    return f"<literal{extra}>{escape(p['value'])}</literal>"


def boolean(value: bool, kind: str = "json") -> str:
    word = "true" if value else "false"
    return {
        "json": json.dumps({"head": {}, "boolean": value}),
        "xml": f'<?xml version="1.0"?>\n<sparql xmlns="http://www.w3.org/2005/sparql-results#"><head></head><boolean>{word}</boolean></sparql>',
        "csv": word,
        "tsv": word,
    }[kind]


def statement_lines(triples: DataFrame) -> DataFrame:
    """(value): one N-Triples or, with a g column, N-Quads line for each row."""
    columns = [written_column(F.col(c)) for c in "spo"]
    if "g" in triples.columns:
        columns.append(F.when(F.col("g") != "", F.col("g")))
    return triples.select(F.concat(F.concat_ws(" ", *columns), F.lit(" .")).alias("value"))


def write_statements(triples: DataFrame, path: str) -> None:
    """N-Triples or N-Quads files, written by all tasks."""
    statement_lines(triples).write.text(path)


def graph(triples: DataFrame, kind: str = "ntriples") -> Iterator[str]:
    """The text of a graph in pieces, sorted by subject for Turtle and RDF/XML."""
    if kind == "ntriples":
        for row in statement_lines(triples.select("s", "p", "o")).toLocalIterator():
            yield row["value"] + "\n"
        return
    rows = triples.select("s", "p", "o").distinct().orderBy("s", "p", "o").toLocalIterator()
    if kind == "turtle":
        last = None
        for s, p, o in rows:
            pred = "a" if p == f"<{v.TYPE}>" else p
            yield f" ;\n    {pred} {written(o)}" if s == last else (" .\n" if last is not None else "") + f"{s} {pred} {written(o)}"
            last = s
        yield " .\n" if last is not None else ""
    elif kind == "rdfxml":
        yield f'<?xml version="1.0" encoding="UTF-8"?>\n<rdf:RDF xmlns:rdf="{v.RDF}">\n'
        for s, p, o in rows:
            m = re.match(r"^(.*[^\w.-]|)([A-Za-z_][\w.-]*)$", p[1:-1])
            if not m:
                raise ValueError(f"{p} cannot be an XML name")
            about = f"rdf:about={quoteattr(s[1:-1])}" if s.startswith("<") else f"rdf:nodeID={quoteattr(s[2:])}"
            x = parts(o)
            tag = f"<q:{m[2]} xmlns:q={quoteattr(m[1])}"
            if x["type"] == "uri":
                body = f"{tag} rdf:resource={quoteattr(x['value'])}/>"
            elif x["type"] == "bnode":
                body = f"{tag} rdf:nodeID={quoteattr(x['value'])}/>"
            else:
                extra = f" xml:lang={quoteattr(x['xml:lang'])}" if "xml:lang" in x else f" rdf:datatype={quoteattr(x['datatype'])}" if "datatype" in x else ""
                body = f"{tag}{extra}>{escape(x['value'])}</q:{m[2]}>"
            yield f"  <rdf:Description {about}>{body}</rdf:Description>\n"
        yield "</rdf:RDF>\n"
    else:
        raise ValueError(kind)
