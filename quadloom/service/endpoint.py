"""The protocol of a dataset without a network: requests in, answers out.

A web server of any kind can sit before ``Endpoint.handle``.  Bodies are
iterators, so a large result leaves the cluster partition by partition.
"""

from __future__ import annotations

import hashlib
import json
import threading
import time
import uuid
from collections.abc import Iterator, Mapping
from dataclasses import asdict, dataclass, field
from urllib.parse import parse_qsl

from pyspark import InheritableThread

from quadloom import session
from quadloom.plans.parser import SparqlSyntaxError, parse_query, parse_update
from quadloom.reasoner.policy import PRESETS, capabilities
from quadloom.reasoner.service import Reasoner
from quadloom.service.rules import Config, Problem, Rates
from quadloom.sinks import results
from quadloom.sources.rdf import RdfSyntaxError
from quadloom.store.gate import Gate, ReasonerReject
from quadloom.store.state import GraphError
from quadloom.store.store import CANCELLED, CancelledError, ConflictError, QuadStore

FORM = "application/x-www-form-urlencoded"
PAYLOADS = {"application/n-triples": "ntriples", "application/rdf+xml": "rdfxml", "text/turtle": "turtle", "application/x-turtle": "turtle"}
NAMESPACE = "urn:quadloom:service#"


@dataclass
class Answer:
    status: int
    media: str = ""
    body: Iterator[str] = field(default_factory=lambda: iter(()))
    headers: dict[str, str] = field(default_factory=dict)

    def text(self) -> str:
        return "".join(self.body)


def media_of(content_type: str | None) -> str:
    return (content_type or "").split(";")[0].strip().lower()


def graph_target(query_string: str) -> str:
    """The graph that ``graph=IRI`` names; '' for the default graph, also with ``default`` or nothing."""
    fields = parse_qsl(query_string, keep_blank_values=True)
    named = [value for key, value in fields if key == "graph"]
    if len(named) > 1:
        raise Problem(400, "more than one graph is named")
    if named and any(key == "default" for key, _ in fields):
        raise Problem(400, "either the default graph or a named one")
    if named and not named[0].strip():
        raise Problem(400, "the graph's name is empty")
    return named[0] if named else ""


class Endpoint:
    """A store, its reasoner and the rules under which both can be reached."""

    def __init__(self, store: QuadStore, reasoner: Reasoner | None = None, config: Config = Config()) -> None:
        self.store, self.reasoner, self.config = store, reasoner or Reasoner(), config
        config.validate(self.reasoner.mode)
        self.gate, self.rates = Gate(self.reasoner), Rates(config.limits)
        self.last_reject: Problem | None = None
        self.last_revision = 0
        self.routes = {
            ("GET", "/healthz"): ("", self._health),
            ("GET", "/readyz"): ("", self._health),
            ("GET", "/version"): ("", self._version),
            ("GET", "/metrics"): ("admin", self._metrics),
            ("GET", "/dataset/info"): ("read", self._info),
            ("GET", "/dataset/service-description"): ("read", self._description),
            ("GET", "/dataset/query"): ("read", self._query),
            ("POST", "/dataset/query"): ("read", self._query),
            ("POST", "/dataset/update"): ("write", self._update),
            ("POST", "/dataset/tell"): ("write", self._tell),
            ("GET", "/dataset/data"): ("read", self._read),
            ("HEAD", "/dataset/data"): ("read", self._head),
            ("PUT", "/dataset/data"): ("write", self._put),
            ("POST", "/dataset/data"): ("write", self._post),
            ("DELETE", "/dataset/data"): ("write", self._delete),
            ("GET", "/ops/api/diagnostics/reasoning"): ("admin", self._diagnostics),
            ("GET", "/ops/api/admin/dataset/backup"): ("admin", self._backup),
            ("POST", "/ops/api/admin/dataset/restore"): ("admin", self._restore),
        }

    def handle(self, method: str, path: str, query: str = "", headers: Mapping[str, str] | None = None, body: bytes = b"") -> Answer:
        """The answer to one request; refusals are problem documents, or plain text for syntax errors if configured."""
        own = {k.lower(): x for k, x in (headers or {}).items()}
        try:
            if (method, path) not in self.routes:
                raise Problem(404, f"nothing answers {method} {path}")
            kind, answer = self.routes[method, path]
            if (kind == "write" or path.startswith("/ops/api/admin/")) and not self.config.writes:
                raise Problem(404, f"{self.config.posture} does not write")
            if kind:
                self.config.access.check(kind, own.get("authorization"))
                self.rates.count(kind)
            seconds = getattr(self.config.limits, f"{kind}_seconds") if kind else 0
            return self._in_time(lambda: answer(query, own, body), seconds) if seconds else answer(query, own, body)
        except Problem as x:
            return Answer(x.status, "text/plain", iter([x.detail])) if x.plain else Answer(x.status, "application/problem+json", iter([x.document()]))

    def _in_time(self, run, seconds: float) -> Answer:
        """The answer, or a refusal once its time is over: its Spark jobs are cancelled then, and a mutation is not published.

        A body that is still being read when the time is over ends with the refusal as an error.
        """
        context, group, late = self.store.spark.sparkContext, f"quadloom-{uuid.uuid4().hex}", threading.Event()
        out: dict[str, object] = {}
        ends = time.monotonic() + seconds
        refusal = Problem(408, f"not done in {seconds:g} seconds")

        def work() -> None:
            token = CANCELLED.set(late.is_set)
            context.setJobGroup(group, "a request", interruptOnCancel=True)
            try:
                out["answer"] = run()
            except BaseException as x:  # noqa: BLE001 - it is raised where the answer is awaited
                out["error"] = x
            finally:
                CANCELLED.reset(token)

        worker = InheritableThread(target=work, daemon=True, session=self.store.spark)
        worker.start()
        worker.join(seconds)
        if worker.is_alive():
            late.set()
            context.cancelJobGroup(group)
            raise refusal
        if "error" in out:
            raise out["error"]
        answer = out["answer"]

        def pieces(body: Iterator[str]) -> Iterator[str]:
            for piece in body:
                if time.monotonic() > ends:
                    raise refusal
                yield piece

        return Answer(answer.status, answer.media, pieces(answer.body), answer.headers)

    # -- small answers ---------------------------------------------------------------
    @staticmethod
    def _json(value: object) -> Answer:
        return Answer(200, "application/json", iter([json.dumps(value, default=str)]))

    def _health(self, query, headers, body) -> Answer:
        return self._json({"status": "ok"})

    def _version(self, query, headers, body) -> Answer:
        return self._json({"name": "quadloom", "spark": self.store.spark.version})

    def _info(self, query, headers, body) -> Answer:
        return self._json(self.store.stats() | {"posture": self.config.posture, "reasoning_mode": self.reasoner.mode, "reasoning_preset": self.reasoner.policy.preset, "read_model": "asserted-only"})

    def _metrics(self, query, headers, body) -> Answer:
        if not self.config.show_metrics:
            raise Problem(404, "metrics are not shown")
        return Answer(200, "text/plain; version=0.0.4; charset=utf-8", iter([self.store.metrics(self.reasoner)]))

    def _description(self, query, headers, body) -> Answer:
        """The service in Turtle."""
        on = lambda x: '"true"' if x else '"false"'
        writes = self.config.writes
        facts = [
            ("a", "sd:Service"),
            ("sd:endpoint", "</dataset/query>"),
            ("sd:supportedLanguage", "sd:SPARQL11Query" + (" , sd:SPARQL11Update" if writes else "")),
            ("sd:resultFormat", " , ".join(f"format:SPARQL_Results_{x}" for x in ("JSON", "XML", "CSV", "TSV"))),
            ("q:graphStoreEndpoint", "</dataset/data>"),
            *([("q:updateEndpoint", "</dataset/update>"), ("q:tellEndpoint", "</dataset/tell>")] if writes else []),
            *([("q:metricsEndpoint", "</metrics>")] if self.config.show_metrics else []),
            ("q:reasoningMode", f'"{self.reasoner.mode}"'),
            ("q:reasoningPreset", f'"{self.reasoner.policy.preset}"'),
            ("q:readModel", '"asserted-only"'),
            ("q:writesEnabled", on(writes)),
            ("q:federationEnabled", on(False)),
        ]
        head = f"@prefix sd: <http://www.w3.org/ns/sparql-service-description#> .\n@prefix format: <http://www.w3.org/ns/formats/> .\n@prefix q: <{NAMESPACE}> .\n\n"
        return Answer(200, "text/turtle", iter([head + "[] " + " ;\n   ".join(f"{p} {o}" for p, o in facts) + " .\n"]))

    # -- queries -----------------------------------------------------------------------
    @staticmethod
    def _decoded(body: bytes) -> str:
        try:
            return body.decode()
        except UnicodeDecodeError as x:
            raise Problem(400, f"the body is not UTF-8: {x}") from None

    def _field(self, text: str, name: str) -> str:
        found = [value for key, value in parse_qsl(text, keep_blank_values=True) if key == name]
        if len(found) != 1:
            raise Problem(400, f"one field {name} is needed")
        return found[0]

    def _syntax(self, x: Exception) -> Problem:
        return Problem(400, str(x), plain=self.config.plain_syntax_errors)

    def _query(self, query, headers, body) -> Answer:
        if body:
            text = self._decoded(body)
            text = self._field(text, "query") if media_of(headers.get("content-type")) == FORM else text
        else:
            text = self._field(query, "query")
        self.config.limits.fits("query", len(text.encode()))
        if not text.strip():
            raise Problem(400, "the query is empty")
        try:
            form = parse_query(text).form
            engine, accept = self.store.engine(), headers.get("accept")
            if form in ("SELECT", "ASK"):
                kind = results.negotiate(accept)
                pieces = iter([results.boolean(engine.ask(text), kind)]) if form == "ASK" else results.solutions(engine.select(text), kind)
                return Answer(200, results.SOLUTION_TYPES[kind], pieces)
            kind = results.negotiate(accept, True)
            return Answer(200, results.GRAPH_TYPES[kind], results.graph(engine.construct(text), kind))
        except (SparqlSyntaxError, ValueError) as x:
            raise self._syntax(x) from None

    # -- mutations ---------------------------------------------------------------------
    def _mutation(self, run):
        """What ``run`` gives, with refusals of the store and the reasoner as problems."""
        try:
            out = run()
        except ReasonerReject as x:
            self.last_reject = Problem(400, str(x), "reasoner-reject", reasoner_reject=x.report.inference.primary_reject | {"likely_triggers": x.candidates})
            raise self.last_reject from None
        except ConflictError as x:
            raise Problem(503, str(x)) from None
        except CancelledError:
            raise Problem(408, "the mutation was cancelled") from None
        except SparqlSyntaxError as x:
            raise self._syntax(x) from None
        except (RdfSyntaxError, GraphError, ValueError) as x:
            raise Problem(400, str(x)) from None
        self.last_revision = self.store.revision
        return out

    def _update(self, query, headers, body) -> Answer:
        media = media_of(headers.get("content-type"))
        if media not in ("", FORM, "application/sparql-update", "text/plain"):
            raise Problem(400, f"{media} is no media type of updates")
        text = self._decoded(body)
        text = self._field(text, "update") if media == FORM else text
        self.config.limits.fits("update", len(text.encode()))
        if not text.strip():
            raise Problem(400, "the update is empty")
        self._mutation(lambda: (parse_update(text), self.store.update(text, self.gate)))
        return Answer(204)

    def _payload(self, headers, body: bytes) -> tuple[str, str, str]:
        media = media_of(headers.get("content-type"))
        if media not in PAYLOADS:
            raise Problem(400, f"{media or 'no type'} is no media type of graphs")
        self.config.limits.fits("rdf", len(body))
        return self._decoded(body), PAYLOADS[media], headers.get("content-location", "").strip()

    def _tell(self, query, headers, body) -> Answer:
        payload, kind, base = self._payload(headers, body)
        graph = graph_target(query)
        self._mutation(lambda: self.store.tell(payload, kind, graph, base, self.gate))
        return Answer(204)

    def _write(self, query, headers, body, replace: bool) -> Answer:
        graph = graph_target(query)
        payload, kind, base = self._payload(headers, body)
        report = self._mutation(lambda: self.store.write_graph(payload, kind, graph, replace, base, self.gate))
        return Answer(204 if not graph else 201 if report.created else 200)

    def _put(self, query, headers, body) -> Answer:
        return self._write(query, headers, body, True)

    def _post(self, query, headers, body) -> Answer:
        return self._write(query, headers, body, False)

    def _delete(self, query, headers, body) -> Answer:
        graph = graph_target(query)
        self._mutation(lambda: self.store.delete_graph(graph, self.gate))
        return Answer(204)

    def _read(self, query, headers, body) -> Answer:
        kind = results.negotiate(headers.get("accept"), True)
        graph = graph_target(query)
        try:
            triples = self.store.read_graph(graph)
        except ValueError as x:
            raise Problem(400, str(x)) from None
        return Answer(200, results.GRAPH_TYPES[kind], results.graph(triples, kind))

    def _head(self, query, headers, body) -> Answer:
        return Answer(200, self._read(query, headers, body).media)

    def _backup(self, query, headers, body) -> Answer:
        """All quads as sorted N-Quads, their checksum, number and revision in headers."""
        path = f"{session.shared_folder(self.store.spark)}/quadloom-backup-{uuid.uuid4().hex}"
        session.delete_at_end(self.store.spark, path)
        told = self.store.export(path)
        # the checksum of the text itself, which passes here anyway
        digest = hashlib.sha256()
        for r in self.store.spark.read.text(path).orderBy("value").toLocalIterator():
            digest.update(r["value"].encode() + b"\n")
        told["sha256"] = digest.hexdigest()
        lines = self.store.spark.read.text(path).orderBy("value").toLocalIterator()
        return Answer(200, "application/n-quads", (r["value"] + "\n" for r in lines), {f"x-backup-{k.replace('_', '-')}": str(x) for k, x in told.items()})

    def _restore(self, query, headers, body) -> Answer:
        """Replace everything by an N-Quads body; with ``x-backup-sha256`` only if that is its checksum."""
        if media_of(headers.get("content-type")) != "application/n-quads":
            raise Problem(400, "a backup is application/n-quads")
        wanted = headers.get("x-backup-sha256")
        if wanted and hashlib.sha256(body).hexdigest() != wanted:
            raise Problem(400, "the backup does not have the given checksum")
        payload = self._decoded(body)
        return self._json(self._mutation(lambda: self.store.restore_payload(payload, self.gate)))

    # -- reasoning ---------------------------------------------------------------------
    def _diagnostics(self, query, headers, body) -> Answer:
        """Mode, policy, capabilities, and what the last run found."""
        if not self.config.show_diagnostics:
            raise Problem(404, "diagnostics are not shown")
        last = self.gate.last
        run = None
        if last is not None:
            found = last.report.inference
            run = {"revision": self.last_revision, "status": last.report.status, "notes": last.report.notes, "cache": last.report.cache, "derived_sample": last.sample, "likely_triggers": last.attribution}
            if found is not None:
                run |= {"inferred_triples": found.inferred_triples, "consistency_violations": found.consistency_violations, "stats": found.stats, "diagnostics": found.diagnostics, "primary_reject": found.primary_reject}
        return self._json(
            {
                "revision": self.store.revision,
                "mode": self.reasoner.mode,
                "read_model": "asserted-only",
                "capabilities": capabilities(self.reasoner.mode, self.reasoner.policy),
                "policy": asdict(self.reasoner.policy) | {"preset": self.reasoner.policy.preset, "presets": [*PRESETS, "custom"]},
                "last_run": run,
                "last_reject": self.last_reject.detail if self.last_reject else None,
            }
        )
