"""The gate before a revision is published: preview, reasoning, attribution, acceptance or rejection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from quadloom.reasoner import consistency
from quadloom.reasoner.rules import Snapshot
from quadloom.reasoner.service import Reasoner, Report
from quadloom.store.state import State


class ReasonerReject(ValueError):
    """The candidate state is inconsistent."""

    def __init__(self, report: Report, candidates: list[dict]) -> None:
        super().__init__(report.inference.primary_reject["summary"])
        self.report, self.candidates = report, candidates


def delta(before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(inserted, removed) triples that the reasoner sees."""
    keys = ["s", "p", "o"]
    a, b = before.select(*keys).distinct(), after.select(*keys).distinct()
    return b.join(a, keys, "left_anti"), a.join(b, keys, "left_anti")


@dataclass
class LastRun:
    report: Report
    inserted: DataFrame
    removed: DataFrame
    sample: list[tuple]
    attribution: list[dict]


class Gate:
    """Call with the states before and after; raises ``ReasonerReject``, keeps the last run either way."""

    def __init__(self, reasoner: Reasoner) -> None:
        self.reasoner = reasoner
        self.last: LastRun | None = None

    def __call__(self, before: State, after: State) -> Report:
        old, new = Snapshot.of(before.quads), Snapshot.of(after.quads)
        report = self.reasoner.run(new)
        inserted, removed = delta(old.triples, new.triples)
        found: list[dict] = []
        if report.status == "rejected":
            found = [r.asDict() for r in consistency.attribution(report.inference.primary_reject, inserted).collect()]
        sample = [tuple(r) for r in report.inference.derived.orderBy("s", "p", "o").limit(5).collect()] if report.inference else []
        self.last = LastRun(report, inserted, removed, sample, found)
        if report.status == "rejected":
            raise ReasonerReject(report, found)
        return report
