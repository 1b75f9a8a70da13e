"""Statements that arrive as a stream, told to a store batch by batch through its gate."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quadloom.session import written
from quadloom.sources import rdf
from quadloom.store.store import QuadStore


def tell_stream(lines: DataFrame, store: QuadStore, checkpoint: str, gate=None, **trigger):
    """Start a query that adds the N-Quads in column ``value`` to the store; a batch that the gate rejects ends it.

    Adding is idempotent, so a batch that runs again after a failure changes
    nothing.  Blank nodes are scoped by batch.
    """

    def add(batch: DataFrame, number: int) -> None:
        rows = written(rdf.parse_lines(batch, True, scope=f"t{number}x"), "tell")
        store.mutate(lambda state: state.inserted(rows), gate)

    return lines.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
