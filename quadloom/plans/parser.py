"""SPARQL 1.1 Query and Update: text to algebra, by recursive descent."""

from __future__ import annotations

import re
from urllib.parse import urljoin

from quadloom import vocab as v
from quadloom.plans import algebra as a


class SparqlSyntaxError(ValueError):
    """The text is no SPARQL 1.1 query or update."""


class UnsupportedError(ValueError):
    """Valid SPARQL that this engine does not offer."""


_TOKEN = re.compile(
    r"""
    (?P<ws>(?:\s|\#[^\n\r]*)+)
  | (?P<iri><[^<>"{}|^`\\\x00-\x20]*>)
  | (?P<string>\"\"\"(?:(?:\"|\"\")?(?:[^"\\]|\\.))*\"\"\"|'''(?:(?:'|'')?(?:[^'\\]|\\.))*'''|"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
  | (?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
  | (?P<var>[?$]\w+)
  | (?P<bnode>_:\w(?:[\w.-]*[\w-])?)
  | (?P<num>(?:\d+\.\d*|\.\d+|\d+)[eE][+-]?\d+|\d*\.\d+|\d+)
  | (?P<pname>(?:[^\W\d_](?:[\w.-]*[\w-])?)?:(?:(?:[\w:]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])(?:(?:[\w.:-]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])*(?:[\w:-]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%]))?)?)
  | (?P<word>[A-Za-z_]\w*)
  | (?P<op>\^\^|&&|\|\||!=|<=|>=|[{}()\[\].,;=<>!+\-*/|^?])
    """,
    re.X | re.S,
)

_ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def unescape(body: str) -> str:
    def one(m: re.Match) -> str:
        x = m[1]
        if x[0] in "uU":
            return chr(int(x[1:], 16))
        if x not in _ESCAPES:
            raise SparqlSyntaxError(f"unknown escape \\{x}")
        return _ESCAPES[x]

    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", one, body, flags=re.S)


def literal(text: str, lang: str | None = None, datatype: str | None = None) -> str:
    """A literal term: xsd:string is the plain form, tags are lower-cased."""
    if lang:
        return f'"{text}"@{lang.lower()}'
    if datatype and datatype != v.XSD_STRING:
        return f'"{text}"^^<{datatype}>'
    return f'"{text}"'


AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX", "SAMPLE", "GROUP_CONCAT"}
FUNCTIONS = set(
    "STR LANG LANGMATCHES DATATYPE BOUND IRI URI BNODE RAND ABS CEIL FLOOR ROUND CONCAT STRLEN UCASE LCASE ENCODE_FOR_URI CONTAINS STRSTARTS STRENDS "
    "STRBEFORE STRAFTER YEAR MONTH DAY HOURS MINUTES SECONDS TIMEZONE TZ NOW UUID STRUUID MD5 SHA1 SHA256 SHA384 SHA512 COALESCE IF STRLANG STRDT "
    "SAMETERM ISIRI ISURI ISBLANK ISLITERAL ISNUMERIC REGEX SUBSTR REPLACE".split()
)


class Parser:
    def __init__(self, text: str, base: str = "") -> None:
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise SparqlSyntaxError(f"unexpected character {text[at]!r} at {at}")
            if m.lastgroup != "ws":
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.tokens.append(("end", ""))
        self.at = 0
        self.base = base
        self.prefixes: dict[str, str] = {}
        self.fresh = 0
        self.labels: dict[str, str] = {}
        self.ground = False  # bnodes stand for themselves (templates, data)

    # -- tokens --------------------------------------------------------------
    @property
    def kind(self) -> str:
        return self.tokens[self.at][0]

    @property
    def text(self) -> str:
        return self.tokens[self.at][1]

    def peek(self, *words: str) -> bool:
        return self.text.upper() in words and self.kind in ("word", "op")

    def take(self, *words: str) -> bool:
        if self.peek(*words):
            self.at += 1
            return True
        return False

    def need(self, *words: str) -> str:
        found = self.text
        if not self.take(*words):
            raise SparqlSyntaxError(f"expected {' or '.join(words)}, found {found or 'the end'}")
        return found

    def pop(self, kind: str) -> str:
        if self.kind != kind:
            raise SparqlSyntaxError(f"expected {kind}, found {self.text or 'the end'}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def new_var(self) -> a.Var:
        self.fresh += 1
        return a.Var(f".{self.fresh}")

    # -- terms ---------------------------------------------------------------
    def iri(self) -> str:
        if self.kind == "iri":
            raw = unescape(self.pop("iri")[1:-1])
            return urljoin(self.base, raw) if self.base and not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", raw) else raw
        prefix, _, local = self.pop("pname").partition(":")
        if prefix not in self.prefixes:
            raise SparqlSyntaxError(f"unknown prefix {prefix}:")
        return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)

    def at_iri(self) -> bool:
        return self.kind in ("iri", "pname")

    def string(self) -> str:
        raw = self.pop("string")
        return unescape(raw[3:-3] if raw[:3] in ('"""', "'''") else raw[1:-1])

    def literal(self) -> str:
        if self.kind == "string":
            text = self.string()
            if self.kind == "lang":
                return literal(text, lang=self.pop("lang")[1:])
            if self.take("^^"):
                return literal(text, datatype=self.iri())
            return literal(text)
        sign = self.need("+", "-") if self.peek("+", "-") else ""
        if self.kind == "num":
            return self.number(sign)
        if self.peek("TRUE", "FALSE"):
            self.at += 1
            return literal(self.tokens[self.at - 1][1].lower(), datatype=v.XSD_BOOLEAN)
        raise SparqlSyntaxError(f"expected a literal, found {self.text}")

    def number(self, sign: str = "") -> str:
        n = self.pop("num")
        kind = v.XSD_DOUBLE if re.search("[eE]", n) else v.XSD_DECIMAL if "." in n else v.XSD_INTEGER
        return literal(sign.replace("+", "") + n, datatype=kind)

    def node(self, triples: list) -> a.Node:
        """A variable or term; collections and bracketed blank nodes add their triples."""
        if self.kind == "var":
            return a.Var(self.pop("var")[1:])
        if self.at_iri():
            return a.Const(f"<{self.iri()}>")
        if self.kind == "bnode":
            return self.blank(self.pop("bnode")[2:])
        if self.take("["):
            own = self.blank(None)
            if not self.take("]"):
                self.properties(own, triples)
                self.need("]")
            return own
        if self.take("("):
            items = []
            while not self.take(")"):
                items.append(self.node(triples))
            head: a.Node = a.Const(f"<{v.NIL}>")
            for item in reversed(items):
                cell = self.blank(None)
                triples += [a.Triple(cell, a.Const(f"<{v.FIRST}>"), item), a.Triple(cell, a.Const(f"<{v.REST}>"), head)]
                head = cell
            return head
        return a.Const(self.literal())

    def blank(self, label: str | None) -> a.Node:
        if label is None:
            self.fresh += 1
            label = f"q{self.fresh}"
            return a.Const(f"_:{label}") if self.ground else a.Var(f".{label}")
        return a.Const(f"_:{label}") if self.ground else a.Var(f".b.{label}")

    # -- triples -------------------------------------------------------------
    def verb(self):
        if self.kind == "word" and self.text == "a":
            self.at += 1
            return a.Const(f"<{v.TYPE}>")
        if self.kind == "var":
            return a.Var(self.pop("var")[1:])
        if self.ground:
            return a.Const(f"<{self.iri()}>")
        path = self.path()
        return a.Const(f"<{path.iri}>") if isinstance(path, a.Link) else path

    def path(self):
        out = self.path_sequence()
        while self.take("|"):
            out = a.Alt(out, self.path_sequence())
        return out

    def path_sequence(self):
        out = self.path_step()
        while self.take("/"):
            out = a.Seq(out, self.path_step())
        return out

    def path_step(self):
        if self.take("^"):
            return a.Inverse(self.path_repeat())
        return self.path_repeat()

    def path_repeat(self):
        out = self.path_primary()
        if self.take("?"):
            return a.Repeat(out, 0, False)
        if self.take("*"):
            return a.Repeat(out, 0, True)
        if self.take("+"):
            return a.Repeat(out, 1, True)
        return out

    def path_primary(self):
        if self.kind == "word" and self.text == "a":
            self.at += 1
            return a.Link(v.TYPE)
        if self.take("!"):
            forward, backward = [], []

            def one() -> None:
                back = self.take("^")
                if self.kind == "word" and self.text == "a":
                    self.at += 1
                    iri = v.TYPE
                else:
                    iri = self.iri()
                (backward if back else forward).append(iri)

            if self.take("("):
                if not self.take(")"):
                    one()
                    while self.take("|"):
                        one()
                    self.need(")")
            else:
                one()
            return a.Negated(tuple(forward), tuple(backward))
        if self.take("("):
            out = self.path()
            self.need(")")
            return out
        return a.Link(self.iri())

    def properties(self, subject: a.Node, triples: list) -> None:
        while True:
            verb = self.verb()
            while True:
                o = self.node(triples)
                triples.append(a.Triple(subject, verb, o) if isinstance(verb, (a.Var, a.Const)) else a.PathPattern(subject, verb, o))
                if not self.take(","):
                    break
            if not self.take(";"):
                return
            while self.take(";"):
                pass
            if not (self.kind in ("var", "iri", "pname") or self.peek("A", "^", "!", "(")):
                return

    def triples_block(self, stop: tuple[str, ...] = ("}",)) -> list:
        triples: list = []
        while not self.peek(*stop) and self.kind != "end":
            if self.peek("FILTER", "OPTIONAL", "UNION", "MINUS", "GRAPH", "SERVICE", "BIND", "VALUES", "{"):
                break
            bracket = self.peek("[", "(")
            before = len(triples)
            s = self.node(triples)
            if not (bracket and len(triples) > before and self.peek(".", "}")):
                self.properties(s, triples)
            if not self.take("."):
                break
        return triples

    # -- patterns ------------------------------------------------------------
    def group(self):
        self.need("{")
        if self.peek("SELECT"):
            out = self.select()
            self.need("}")
            return out
        out, filters = a.Unit(), []

        def join(x, y):
            return y if isinstance(x, a.Unit) else a.Join(x, y)

        while not self.take("}"):
            if self.take("FILTER"):
                filters.append(self.constraint())
            elif self.take("OPTIONAL"):
                right = self.group()
                out = a.LeftJoin(out, right.pattern, right.condition) if isinstance(right, a.Filter) else a.LeftJoin(out, right)
            elif self.take("MINUS"):
                out = a.Minus(out, self.group())
            elif self.take("GRAPH"):
                name = a.Var(self.pop("var")[1:]) if self.kind == "var" else a.Const(f"<{self.iri()}>")
                out = join(out, a.Graph(name, self.group()))
            elif self.peek("SERVICE"):
                raise UnsupportedError("federated queries (SERVICE) are not offered")
            elif self.take("BIND"):
                self.need("(")
                expr = self.expression()
                self.need("AS")
                name = self.pop("var")[1:]
                self.need(")")
                if name in a.variables(out):
                    raise SparqlSyntaxError(f"?{name} is already in use")
                out = a.Extend(out, name, expr)
            elif self.take("VALUES"):
                out = join(out, self.values())
            elif self.peek("{"):
                part = self.group()
                while self.take("UNION"):
                    part = a.Union(part, self.group())
                out = join(out, part)
            elif self.take("."):
                continue
            else:
                block = self.triples_block()
                if not block:
                    raise SparqlSyntaxError(f"unexpected {self.text or 'end'}")
                plain = tuple(t for t in block if isinstance(t, a.Triple))
                if plain:
                    out = join(out, a.Bgp(plain))
                for t in block:
                    if isinstance(t, a.PathPattern):
                        out = join(out, t)
        if filters:
            condition = filters[0]
            for f in filters[1:]:
                condition = a.Call("&&", (condition, f))
            out = a.Filter(condition, out)
        return out

    def values(self) -> a.Values:
        if self.kind == "var":
            names = [self.pop("var")[1:]]
            single = True
        else:
            self.need("(")
            names, single = [], False
            while not self.take(")"):
                names.append(self.pop("var")[1:])
        self.need("{")
        rows = []

        def item() -> str | None:
            if self.take("UNDEF"):
                return None
            return f"<{self.iri()}>" if self.at_iri() else self.literal()

        while not self.take("}"):
            if single:
                rows.append((item(),))
            else:
                self.need("(")
                row = []
                while not self.take(")"):
                    row.append(item())
                if len(row) != len(names):
                    raise SparqlSyntaxError("VALUES row of another length")
                rows.append(tuple(row))
        return a.Values(tuple(names), tuple(rows))

    # -- expressions ---------------------------------------------------------
    def constraint(self):
        if self.peek("("):
            self.need("(")
            out = self.expression()
            self.need(")")
            return out
        return self.primary()

    def expression(self):
        out = self.and_expression()
        while self.take("||"):
            out = a.Call("||", (out, self.and_expression()))
        return out

    def and_expression(self):
        out = self.relation()
        while self.take("&&"):
            out = a.Call("&&", (out, self.relation()))
        return out

    def relation(self):
        out = self.sum()
        if self.peek("=", "!=", "<", ">", "<=", ">="):
            return a.Call(self.need("=", "!=", "<", ">", "<=", ">="), (out, self.sum()))
        if self.peek("IN", "NOT"):
            name = "NOT IN" if self.take("NOT") else "IN"
            self.need("IN")
            return a.Call(name, (out, *self.arguments()))
        return out

    def sum(self):
        out = self.product()
        while self.peek("+", "-"):
            out = a.Call(self.need("+", "-"), (out, self.product()))
        return out

    def product(self):
        out = self.unary()
        while self.peek("*", "/"):
            out = a.Call(self.need("*", "/"), (out, self.unary()))
        return out

    def unary(self):
        if self.take("!"):
            return a.Call("!", (self.unary(),))
        if self.take("-"):
            return a.Const(self.number("-")) if self.kind == "num" else a.Call("NEG", (self.unary(),))
        if self.take("+"):
            return a.Call("POS", (self.unary(),))
        return self.primary()

    def arguments(self) -> tuple:
        self.need("(")
        out = []
        if not self.take(")"):
            out.append(self.expression())
            while self.take(","):
                out.append(self.expression())
            self.need(")")
        return tuple(out)

    def primary(self):
        if self.take("("):
            out = self.expression()
            self.need(")")
            return out
        if self.kind == "var":
            return a.Var(self.pop("var")[1:])
        if self.kind == "word":
            word = self.text.upper()
            if word in ("EXISTS", "NOT"):
                self.at += 1
                if word == "NOT":
                    self.need("EXISTS")
                return a.Exists(self.group(), word == "NOT")
            if word in AGGREGATES:
                self.at += 1
                return self.aggregate(word)
            if word in FUNCTIONS:
                self.at += 1
                return a.Call(word, self.arguments())
            if word in ("TRUE", "FALSE"):
                return a.Const(self.literal())
            raise SparqlSyntaxError(f"unknown function {self.text}")
        if self.at_iri():
            iri = self.iri()
            return a.Call(iri, self.arguments()) if self.peek("(") else a.Const(f"<{iri}>")
        return a.Const(self.literal())

    def aggregate(self, name: str) -> a.Aggregate:
        self.need("(")
        distinct = self.take("DISTINCT")
        if name == "COUNT" and self.take("*"):
            self.need(")")
            return a.Aggregate(name, None, distinct)
        arg = self.expression()
        separator = " "
        if name == "GROUP_CONCAT" and self.take(";"):
            self.need("SEPARATOR")
            self.need("=")
            separator = self.string()
        self.need(")")
        return a.Aggregate(name, arg, distinct, separator)

    # -- queries -------------------------------------------------------------
    def prologue(self) -> None:
        while True:
            if self.take("BASE"):
                self.base = urljoin(self.base, unescape(self.pop("iri")[1:-1]))
            elif self.take("PREFIX"):
                prefix = self.pop("pname")
                if not prefix.endswith(":"):
                    raise SparqlSyntaxError(f"bad prefix {prefix}")
                raw = unescape(self.pop("iri")[1:-1])
                self.prefixes[prefix[:-1]] = urljoin(self.base, raw) if self.base else raw
            else:
                return

    def dataset(self, q: a.Query) -> None:
        while self.take("FROM"):
            (q.from_named if self.take("NAMED") else q.from_graphs).append(self.iri())

    def where(self):
        self.take("WHERE")
        return self.group()

    def modifiers(self, q: a.Query) -> a.Query:
        if self.take("GROUP"):
            self.need("BY")
            q.group = []
            while True:
                if self.kind == "var":
                    name = self.pop("var")[1:]
                    q.group.append((name, a.Var(name)))
                elif self.peek("("):
                    self.need("(")
                    expr = self.expression()
                    name = self.pop("var")[1:] if self.take("AS") else None
                    self.need(")")
                    q.group.append((name, expr))
                elif self.at_iri() or self.kind == "word" and self.text.upper() in FUNCTIONS:
                    q.group.append((None, self.primary()))
                else:
                    break
            if not q.group:
                raise SparqlSyntaxError("GROUP BY without a key")
        if self.take("HAVING"):
            q.having.append(self.constraint())
            while self.peek("(") or self.kind == "word" and self.text.upper() in FUNCTIONS | AGGREGATES:
                q.having.append(self.constraint())
        if self.take("ORDER"):
            self.need("BY")
            while True:
                if self.peek("ASC", "DESC"):
                    down = self.need("ASC", "DESC").upper() == "DESC"
                    self.need("(")
                    q.order.append(a.OrderKey(self.expression(), down))
                    self.need(")")
                elif self.kind == "var":
                    q.order.append(a.OrderKey(a.Var(self.pop("var")[1:])))
                elif self.peek("(") or self.kind == "word" and self.text.upper() in FUNCTIONS | AGGREGATES:
                    q.order.append(a.OrderKey(self.constraint()))
                else:
                    break
            if not q.order:
                raise SparqlSyntaxError("ORDER BY without a key")
        while self.peek("LIMIT", "OFFSET"):
            word = self.need("LIMIT", "OFFSET").upper()
            n = self.pop("num")
            if not n.isdigit():
                raise SparqlSyntaxError(f"{word} needs an integer")
            if word == "LIMIT":
                q.limit = int(n)
            else:
                q.offset = int(n)
        if self.take("VALUES"):
            q.pattern = a.Join(q.pattern, self.values())
        return q

    def select(self) -> a.Query:
        self.need("SELECT")
        q = a.Query("SELECT", None)
        q.distinct, q.reduced = self.take("DISTINCT"), self.take("REDUCED")
        if not self.take("*"):
            q.projection = []
            while True:
                if self.kind == "var":
                    q.projection.append((self.pop("var")[1:], None))
                elif self.take("("):
                    expr = self.expression()
                    self.need("AS")
                    q.projection.append((self.pop("var")[1:], expr))
                    self.need(")")
                else:
                    break
            if not q.projection:
                raise SparqlSyntaxError("SELECT without variables")
        self.dataset(q)
        q.pattern = self.where()
        self.modifiers(q)
        names = [n for n, _ in q.projection or ()]
        if len(set(names)) < len(names):
            raise SparqlSyntaxError("a variable is selected twice")
        return q

    def query(self) -> a.Query:
        self.prologue()
        if self.peek("SELECT"):
            q = self.select()
        elif self.take("ASK"):
            q = a.Query("ASK", None)
            self.dataset(q)
            q.pattern = self.where()
            self.modifiers(q)
        elif self.take("CONSTRUCT"):
            q = a.Query("CONSTRUCT", None)
            if self.peek("{"):
                q.template = self.template()
                self.dataset(q)
                q.pattern = self.where()
            else:
                self.dataset(q)
                self.take("WHERE")
                mark = self.at
                q.template = self.template()
                self.at = mark
                q.pattern = self.group()
            self.modifiers(q)
        elif self.take("DESCRIBE"):
            q = a.Query("DESCRIBE", a.Unit())
            if not self.take("*"):
                while self.kind in ("var", "iri", "pname"):
                    q.describe.append(a.Var(self.pop("var")[1:]) if self.kind == "var" else a.Const(f"<{self.iri()}>"))
                if not q.describe:
                    raise SparqlSyntaxError("DESCRIBE without a resource")
            self.dataset(q)
            if self.peek("WHERE", "{"):
                q.pattern = self.where()
            if not q.describe:
                q.describe = [a.Var(n) for n in a.variables(q.pattern)]
            self.modifiers(q)
        else:
            raise SparqlSyntaxError(f"expected a query, found {self.text or 'the end'}")
        if self.kind != "end":
            raise SparqlSyntaxError(f"unexpected {self.text} after the query")
        return q

    def template(self) -> list[a.Triple]:
        self.need("{")
        self.ground = True
        try:
            triples = self.triples_block()
        finally:
            self.ground = False
        self.need("}")
        return triples

    # -- updates -------------------------------------------------------------
    def quads(self, data: bool) -> a.Quads:
        self.need("{")
        parts: list = []
        self.ground = True
        try:
            while not self.take("}"):
                if self.take("GRAPH"):
                    name = a.Var(self.pop("var")[1:]) if self.kind == "var" and not data else f"<{self.iri()}>"
                    self.need("{")
                    parts.append((name, self.triples_block()))
                    self.need("}")
                    self.take(".")
                else:
                    block = self.triples_block(("}", "GRAPH"))
                    if not block and not self.take("."):
                        raise SparqlSyntaxError(f"unexpected {self.text or 'end'}")
                    parts.append(("", block))
        finally:
            self.ground = False
        if data:
            for _, triples in parts:
                if any(isinstance(x, a.Var) for t in triples for x in (t.s, t.p, t.o)):
                    raise SparqlSyntaxError("variables in data")
        return a.Quads(parts)

    def graph_or_default(self) -> str:
        if self.take("DEFAULT"):
            return ""
        self.take("GRAPH")
        return f"<{self.iri()}>"

    def pattern_of(self, quads: a.Quads):
        out = a.Unit()
        for name, triples in quads.parts:
            blanks = lambda x: a.Var(".b." + x.term[2:]) if isinstance(x, a.Const) and x.term.startswith("_:") else x
            part = a.Bgp(tuple(a.Triple(blanks(t.s), blanks(t.p), blanks(t.o)) for t in triples))
            part = part if name == "" else a.Graph(name if isinstance(name, a.Var) else a.Const(name), part)
            out = part if isinstance(out, a.Unit) else a.Join(out, part)
        return out

    def one_update(self):
        if self.take("LOAD"):
            silent = self.take("SILENT")
            source = self.iri()
            target = ""
            if self.take("INTO"):
                self.need("GRAPH")
                target = f"<{self.iri()}>"
            return a.Load(source, target, silent)
        if self.peek("CLEAR", "DROP", "CREATE"):
            kind = self.need("CLEAR", "DROP", "CREATE").upper()
            silent = self.take("SILENT")
            if kind != "CREATE" and self.peek("DEFAULT", "NAMED", "ALL"):
                return a.Manage(kind, self.need("DEFAULT", "NAMED", "ALL").upper(), silent)
            self.need("GRAPH")
            return a.Manage(kind, f"<{self.iri()}>", silent)
        if self.peek("COPY", "MOVE", "ADD"):
            kind = self.need("COPY", "MOVE", "ADD").upper()
            silent = self.take("SILENT")
            source = self.graph_or_default()
            self.need("TO")
            return a.Transfer(kind, source, self.graph_or_default(), silent)
        with_graph = f"<{self.iri()}>" if self.take("WITH") else None
        delete = insert = None
        if self.take("DELETE"):
            if with_graph is None and self.take("DATA"):
                return a.DeleteData(self.quads(True))
            if self.take("WHERE"):
                delete = self.quads(False)
                return a.Modify(delete, None, self.pattern_of(delete), with_graph)
            delete = self.quads(False)
        if self.take("INSERT"):
            if delete is None and with_graph is None and self.take("DATA"):
                return a.InsertData(self.quads(True))
            insert = self.quads(False)
        if delete is None and insert is None:
            raise SparqlSyntaxError(f"expected an update, found {self.text or 'the end'}")
        out = a.Modify(delete, insert, None, with_graph)
        while self.take("USING"):
            (out.using_named if self.take("NAMED") else out.using).append(self.iri())
        self.need("WHERE")
        out.pattern = self.group()
        return out

    def update(self) -> list:
        out = []
        while True:
            self.prologue()
            if self.kind == "end" and out:
                break
            out.append(self.one_update())
            if not self.take(";"):
                break
        if self.kind != "end":
            raise SparqlSyntaxError(f"unexpected {self.text} after the update")
        return out


def parse_query(text: str, base: str = "") -> a.Query:
    return Parser(text, base).query()


def parse_update(text: str, base: str = "") -> list:
    """The operations of an update; none of them runs unless all parse."""
    return Parser(text, base).update()
