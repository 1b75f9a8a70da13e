"""A quad store: immutable Parquet revisions, each published by one file that only one writer can make.

The file ``commit-<n>`` says where the data of revision n is; renaming it into
place fails if it is there, so of two writers that begin at one revision the
second gets a conflict and leaves nothing behind.  ``HEAD`` only saves looking
for the last of these files.  The lock keeps writers from working for nothing;
it is a lease, which a writer that died does not hold for ever.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom import session
from quadloom.plans.compiler import Engine
from quadloom.reasoner.rules import Snapshot
from quadloom.sinks import results
from quadloom.sources import rdf
from quadloom.store import state as s
from quadloom.store.state import State


class ConflictError(RuntimeError):
    """Another writer holds the store."""


class CancelledError(RuntimeError):
    """The mutation was cancelled before it was published."""


#: Whether the work of this thread has been cancelled; nothing of it is published then.
CANCELLED: ContextVar[Callable[[], bool]] = ContextVar("CANCELLED", default=lambda: False)
#: Seconds for which a writer's lock holds.
LEASE = 3600.0


@dataclass(frozen=True)
class WriteReport:
    target: str
    modified: bool
    created: bool
    revision: int


class _Files:
    """The few file operations a store needs, through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm = spark.sparkContext._jvm
        self.root = root.rstrip("/")
        self.fs = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def read(self, name: str) -> str | None:
        if not self.fs.exists(self.path(name)):
            return None
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str, replace: bool = True) -> bool:
        """Whole or not at all: a new file takes the old one's place, or with ``replace`` off only a free place."""
        from pyspark import SparkContext

        temporary = f".{name}-{uuid.uuid4().hex}"
        stream = self.fs.create(self.path(temporary), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        options = self.jvm.org.apache.hadoop.fs.Options.Rename
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path("").toUri(), self.fs.getConf())
        flags = SparkContext._gateway.new_array(options, 1)
        flags[0] = options.OVERWRITE if replace else options.NONE
        try:
            context.rename(self.path(temporary), self.path(name), flags)
        except Py4JJavaError:
            self.drop(temporary)
            if replace or not self.fs.exists(self.path(name)):
                raise
            return False
        return True

    def drop(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def lines_digest(lines: DataFrame) -> tuple[str, int]:
    """A checksum of the bag of lines ``value``, and their number; where a line stands does not count, so tasks sum their own.

    Each line's SHA-256 is eight 32-bit numbers; the digest is the SHA-256 of their sums and the number of lines.
    """
    parts = [F.conv(F.substring(F.sha2("value", 256), 8 * k + 1, 8), 16, 10).cast("decimal(38,0)") for k in range(8)]
    sums = lines.agg(F.count(F.lit(1)), *(F.coalesce(F.sum(x), F.lit(0)) for x in parts)).first()
    return hashlib.sha256(",".join(map(str, map(int, sums))).encode()).hexdigest(), sums[0]


class QuadStore:
    """Revisions of a dataset under ``path``; every successful mutation makes the next one.

    Initially the revision is 0, or 1 if ``preload`` names a file that exists.
    """

    def __init__(self, spark: SparkSession, path: str, preload: list[str] | None = None) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.files = _Files(spark, self.path)
        if self.files.read("HEAD") is None:
            state, revision = State.empty(spark), 0
            for candidate in preload or ():
                file = self.files.jvm.org.apache.hadoop.fs.Path(candidate)
                if file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(file):
                    state, revision = state.inserted(rdf.read(spark, candidate, graph="")), 1
                    break
            else:
                if preload:
                    raise ValueError(f"none of {preload} exists")
            self._publish(state, revision)

    # -- state -----------------------------------------------------------------
    @property
    def revision(self) -> int:
        n = json.loads(self.files.read("HEAD"))["revision"]
        while self.files.read(f"commit-{n + 1}") is not None:  # its writer did not get to HEAD
            n += 1
        return n

    def state(self, revision: int | None = None) -> State:
        n = self.revision if revision is None else revision
        at = f"{self.path}/{json.loads(self.files.read(f'commit-{n}'))['data']}"
        return State(self.spark.read.schema(rdf.QUADS).parquet(f"{at}/quads"), self.spark.read.schema("g string").parquet(f"{at}/graphs"))

    def engine(self, revision: int | None = None) -> Engine:
        return Engine(self.state(revision).dataset())

    def inferred_engine(self, reasoner) -> Engine:
        """Queries over what is asserted and what the reasoner derives from it; derived triples are in the default graph and are not stored."""
        state = self.state()
        report = reasoner.run(Snapshot.of(state.quads))
        if report.inference is None:
            return Engine(state.dataset())
        named = [F.concat(F.lit("<"), F.col(c), F.lit(">")).alias(c) for c in "spo"]
        return Engine(State(state.quads.select(*s.KEYS).union(report.inference.derived.select(*named, F.lit("").alias("g"))), state.graphs).dataset())

    def _publish(self, state: State, revision: int) -> State:
        data = f"rev={revision}-{uuid.uuid4().hex[:12]}"
        at = f"{self.path}/{data}"
        state.quads.select(*s.KEYS).distinct().sortWithinPartitions("p", "g", "s").write.parquet(f"{at}/quads")
        state.graphs.select("g").union(state.quads.select("g").where("g <> ''")).distinct().coalesce(1).write.parquet(f"{at}/graphs")
        if CANCELLED.get()():
            self.files.drop(data)
            raise CancelledError
        if not self.files.write(f"commit-{revision}", json.dumps({"data": data}), replace=False):
            self.files.drop(data)
            raise ConflictError(f"{self.path}: revision {revision} was published by another writer")
        self.files.write("HEAD", json.dumps({"revision": revision}))
        return self.state(revision)

    @contextlib.contextmanager
    def writer(self, lease: float = LEASE) -> Iterator[None]:
        mine = json.dumps({"owner": uuid.uuid4().hex, "until": time.time() + lease})
        if not self.files.write("LOCK", mine, replace=False):
            held = json.loads(self.files.read("LOCK") or '{"until": 0}')
            if held["until"] > time.time():
                raise ConflictError(f"{self.path} has a writer")
            self.files.write("LOCK", mine)
        try:
            yield
        finally:
            if self.files.read("LOCK") == mine:
                self.files.drop("LOCK")

    def mutate(self, change: Callable[[State], State], gate: Callable[[State, State], object] | None = None, cancelled: Callable[[], bool] = lambda: False) -> int:
        """The change of the newest state becomes the next revision if ``gate(before, after)`` does not object."""
        with self.writer():
            start = self.revision
            before = self.state(start)
            after = change(before)
            if gate is not None:
                # what is judged is what is published
                after = State(session.written(after.quads.select(*s.KEYS).distinct(), "candidate"), session.written(after.graphs.distinct(), "graphs"))
                gate(before, after)
            if cancelled():
                raise CancelledError
            self._publish(after, start + 1)
            return start + 1

    # -- mutations ---------------------------------------------------------------
    def update(self, text: str, gate=None, base: str = "") -> int:
        from quadloom.plans.parser import parse_update

        parse_update(text, base)
        return self.mutate(lambda x: s.apply(x, text, base), gate)

    def tell(self, payload: str, kind: str, graph: str = "", base: str = "", gate=None) -> int:
        rows = rdf.parse_payload(self.spark, payload, kind, base)
        g = f"<{graph}>" if graph else ""
        return self.mutate(lambda x: x.inserted(rows.withColumn("g", F.lit(g))), gate)

    def write_graph(self, payload: str, kind: str, graph: str = "", replace: bool = True, base: str = "", gate=None) -> WriteReport:
        """Replace (PUT) or extend (POST) a graph; graph names in the payload do not count."""
        g = self._target(graph)
        rows = rdf.parse_payload(self.spark, payload, kind, base).select("s", "p", "o")
        created = bool(g) and not self.state().has_graph(g)

        def change(x: State) -> State:
            out = x.replaced(g, rows) if replace else x.inserted(rows.withColumn("g", F.lit(g)))
            return out.registered(g) if g else out

        return WriteReport(graph, True, created, self.mutate(change, gate))

    def delete_graph(self, graph: str = "", gate=None) -> WriteReport:
        """Clear the default graph, or remove a named one; a missing one is no error."""
        g = self._target(graph)
        return WriteReport(graph, True, False, self.mutate(lambda x: x.cleared(g, drop=bool(g)), gate))

    def read_graph(self, graph: str = "") -> DataFrame:
        g = self._target(graph)
        return self.state().quads.where(F.col("g") == g).select("s", "p", "o")

    @staticmethod
    def _target(graph: str) -> str:
        import re

        if graph and (":" not in graph or re.search(r'[<>"{}|^`\\\x00-\x20]', graph)):
            raise ValueError(f"{graph!r} is no graph IRI")
        return f"<{graph}>" if graph else ""

    # -- statistics, backup --------------------------------------------------------
    def stats(self) -> dict[str, object]:
        x = self.state()
        n = x.quads.count()
        return {"quad_count": n, "named_graph_count": x.graphs.count(), "is_empty": n == 0, "revision": self.revision}

    def metrics(self, reasoner=None) -> str:
        """The statistics, and those of a reasoner's caches, in Prometheus' text format."""
        x = self.stats()
        rows = [("ready", "gauge", "", 1), ("revision", "gauge", "", x["revision"]), ("quads", "gauge", "", x["quad_count"]), ("named_graphs", "gauge", "", x["named_graph_count"]), ("store_info", "gauge", '{mode="parquet",durability="durable"}', 1)]
        if reasoner is not None:
            rows.append(("reasoner_info", "gauge", f'{{mode="{reasoner.mode}",preset="{reasoner.policy.preset}"}}', 1))
            for name, cache in (("execution", reasoner.executions), ("schema", reasoner.schemas)):
                rows += [(f"reasoner_{name}_cache_entries", "gauge", "", len(cache.entries)), (f"reasoner_{name}_cache_hits_total", "counter", "", cache.hits), (f"reasoner_{name}_cache_misses_total", "counter", "", cache.misses)]
        return "".join(f"# TYPE quadloom_{name} {kind}\nquadloom_{name}{labels} {n}\n" for name, kind, labels, n in rows)

    def export(self, path: str) -> dict[str, object]:
        """All quads as sorted N-Quads files with a checksum of their lines; empty named graphs are not in this format."""
        revision = self.revision
        results.statement_lines(self.state(revision).quads).orderBy("value").write.text(path)
        digest, n = lines_digest(self.spark.read.text(path))
        return {"sha256": digest, "quad_count": n, "revision": revision}

    def restore(self, path: str, sha256: str | None = None, gate=None) -> dict[str, object]:
        """Replace everything by a backup, which is parsed as a whole before anything changes."""
        lines = self.spark.read.text(path)
        if sha256 is not None and lines_digest(lines)[0] != sha256:
            raise ValueError("the backup does not have the given checksum")
        return self._restored(rdf.parse_lines(lines, True, scope=""), gate)

    def restore_payload(self, payload: str, gate=None) -> dict[str, object]:
        """The same from N-Quads in memory."""
        return self._restored(rdf.parse_payload(self.spark, payload, "nquads", scope=""), gate)

    def _restored(self, rows: DataFrame, gate) -> dict[str, object]:
        rows = session.written(rows, "restore")
        had = not self.state().quads.isEmpty()
        revision = self.mutate(lambda x: State.empty(self.spark).inserted(rows), gate)
        return {"replaced_existing": had, "quad_count": rows.distinct().count(), "revision": revision}
