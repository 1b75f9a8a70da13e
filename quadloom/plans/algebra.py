"""The query algebra: plain data that the parser makes and the compiler reads."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Const:
    """A term in its string form (see functions.terms)."""

    term: str


Node = Var | Const


@dataclass(frozen=True)
class Triple:
    s: Node
    p: Node
    o: Node


# property paths
@dataclass(frozen=True)
class Link:
    iri: str


@dataclass(frozen=True)
class Inverse:
    path: object


@dataclass(frozen=True)
class Seq:
    left: object
    right: object


@dataclass(frozen=True)
class Alt:
    left: object
    right: object


@dataclass(frozen=True)
class Repeat:
    """least 0 or 1 steps; many: any number of them."""

    path: object
    least: int
    many: bool


@dataclass(frozen=True)
class Negated:
    forward: tuple[str, ...]
    backward: tuple[str, ...]


@dataclass(frozen=True)
class PathPattern:
    s: Node
    path: object
    o: Node


# patterns
@dataclass(frozen=True)
class Bgp:
    triples: tuple[Triple, ...]


@dataclass(frozen=True)
class Unit:
    """One solution without variables."""


@dataclass(frozen=True)
class Join:
    left: object
    right: object


@dataclass(frozen=True)
class LeftJoin:
    left: object
    right: object
    condition: object = None


@dataclass(frozen=True)
class Union:
    left: object
    right: object


@dataclass(frozen=True)
class Minus:
    left: object
    right: object


@dataclass(frozen=True)
class Filter:
    condition: object
    pattern: object


@dataclass(frozen=True)
class Graph:
    name: Node
    pattern: object


@dataclass(frozen=True)
class Extend:
    pattern: object
    name: str
    expr: object


@dataclass(frozen=True)
class Values:
    names: tuple[str, ...]
    rows: tuple[tuple[str | None, ...], ...]


# expressions
@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Exists:
    pattern: object
    negated: bool


@dataclass(frozen=True)
class Aggregate:
    name: str
    arg: object  # None for COUNT(*)
    distinct: bool = False
    separator: str = " "


@dataclass(frozen=True)
class OrderKey:
    expr: object
    descending: bool = False


@dataclass
class Query:
    form: str  # SELECT, ASK, CONSTRUCT, DESCRIBE
    pattern: object
    projection: list[tuple[str, object]] | None = None  # name, expression or None; None: all
    distinct: bool = False
    reduced: bool = False
    group: list[tuple[str | None, object]] | None = None
    having: list = field(default_factory=list)
    order: list[OrderKey] = field(default_factory=list)
    offset: int = 0
    limit: int | None = None
    template: list[Triple] = field(default_factory=list)
    describe: list = field(default_factory=list)
    from_graphs: list[str] = field(default_factory=list)
    from_named: list[str] = field(default_factory=list)


# updates
@dataclass
class Quads:
    """Triples by graph: '' is the default graph, a Var is bound by the solutions."""

    parts: list[tuple[object, list[Triple]]]


@dataclass
class InsertData:
    quads: Quads


@dataclass
class DeleteData:
    quads: Quads


@dataclass
class Modify:
    delete: Quads | None
    insert: Quads | None
    pattern: object
    with_graph: str | None = None
    using: list[str] = field(default_factory=list)
    using_named: list[str] = field(default_factory=list)


@dataclass
class Manage:
    """CLEAR, DROP or CREATE of a graph IRI, DEFAULT, NAMED or ALL."""

    kind: str
    target: str
    silent: bool = False


@dataclass
class Transfer:
    """COPY, MOVE or ADD; '' is the default graph."""

    kind: str
    source: str
    target: str
    silent: bool = False


@dataclass
class Load:
    source: str
    target: str = ""
    silent: bool = False


def variables(node, found: dict[str, None] | None = None) -> dict[str, None]:
    """In-scope variables of a pattern, in order of appearance."""
    found = {} if found is None else found
    add = lambda x: found.setdefault(x.name) if isinstance(x, Var) else None
    match node:
        case Bgp(triples):
            for t in triples:
                add(t.s), add(t.p), add(t.o)
        case PathPattern(s, _, o):
            add(s), add(o)
        case Join(a, b) | Union(a, b):
            variables(a, found), variables(b, found)
        case LeftJoin(a, b, _):
            variables(a, found), variables(b, found)
        case Minus(a, _):
            variables(a, found)
        case Filter(_, p):
            variables(p, found)
        case Graph(name, p):
            add(name)
            variables(p, found)
        case Extend(p, name, _):
            variables(p, found)
            found.setdefault(name)
        case Values(names, _):
            for n in names:
                found.setdefault(n)
        case Query():
            for n in (variables(node.pattern) if node.projection is None else [n for n, _ in node.projection]):
                found.setdefault(n)
    return found
