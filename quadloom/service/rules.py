"""What a service allows: limits, rates, postures, access; and how it says no."""

from __future__ import annotations

import hmac
import json
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from http import HTTPStatus

#: Slugs of problem documents by status (fixed values).
SLUGS = {400: "bad-request", 401: "unauthorized", 403: "forbidden", 404: "not-found", 408: "timeout", 413: "payload-too-large", 429: "too-many-requests", 500: "internal-error", 503: "service-unavailable"}
POSTURES = ("open-workbench", "read-only-demo", "internal-authenticated", "replacement-grade")


class Problem(Exception):
    """A refusal with its status; ``extra`` goes into the document."""

    def __init__(self, status: int, detail: str, slug: str | None = None, plain: bool = False, **extra) -> None:
        super().__init__(detail)
        self.status, self.detail, self.slug, self.plain, self.extra = status, detail, slug or SLUGS[status], plain, extra

    def document(self) -> str:
        """The problem as RFC 9457 has it."""
        title = "Reasoner Reject" if self.slug == "reasoner-reject" else HTTPStatus(self.status).phrase
        return json.dumps({"type": f"/problems/{self.slug}", "title": title, "status": self.status, "detail": self.detail, **self.extra}, default=str)


@dataclass(frozen=True)
class Limits:
    """Bytes of requests (fixed values); for each kind of action requests in a window, and seconds for one; 0 is no limit."""

    query: int = 1 << 20
    update: int = 1 << 20
    rdf: int = 10 << 20
    window_seconds: float = 60.0
    read: int = 0
    write: int = 0
    admin: int = 0
    read_seconds: float = 0.0
    write_seconds: float = 0.0
    admin_seconds: float = 0.0

    def fits(self, what: str, size: int) -> None:
        most = getattr(self, what)
        if size > most:
            raise Problem(413, f"the {what} has {size} bytes, {most} are allowed")


class Rates:
    """Counts requests in windows of fixed length."""

    def __init__(self, limits: Limits, clock: Callable[[], float] = time.monotonic) -> None:
        self.limits, self.clock = limits, clock
        self.lock = threading.Lock()
        self.windows: dict[str, tuple[float, int]] = {}

    def count(self, kind: str) -> None:
        most = getattr(self.limits, kind)
        if not most:
            return
        with self.lock:
            now = self.clock()
            began, n = self.windows.get(kind, (now, 0))
            if now - began >= self.limits.window_seconds:
                began, n = now, 0
            if n >= most:
                raise Problem(429, f"over {most} {kind} requests in {self.limits.window_seconds:g} seconds")
            self.windows[kind] = (began, n + 1)


@dataclass(frozen=True)
class Access:
    """Bearer tokens for reading and for everything; without any, all is open."""

    read_tokens: tuple[str, ...] = ()
    admin_tokens: tuple[str, ...] = ()

    @property
    def open(self) -> bool:
        return not (self.read_tokens or self.admin_tokens)

    def check(self, kind: str, authorization: str | None) -> None:
        if self.open:
            return
        scheme, _, token = (authorization or "").partition(" ")
        if scheme.lower() != "bearer" or not token:
            raise Problem(401, "a bearer token is needed")
        known = lambda tokens: any([hmac.compare_digest(t.encode(), token.strip().encode()) for t in tokens])
        if known(self.admin_tokens):
            return
        if not known(self.read_tokens):
            raise Problem(401, "the bearer token is not known")
        if kind != "read":
            raise Problem(403, "the bearer token may only read")


@dataclass(frozen=True)
class Config:
    posture: str = POSTURES[0]
    limits: Limits = field(default_factory=Limits)
    access: Access = field(default_factory=Access)
    show_metrics: bool = True
    show_diagnostics: bool = True
    plain_syntax_errors: bool = False

    def __post_init__(self) -> None:
        if self.posture not in POSTURES:
            raise ValueError(f"unknown posture {self.posture}")

    @property
    def writes(self) -> bool:
        return self.posture != "read-only-demo"

    def validate(self, reasoning_mode: str) -> None:
        """Whether the settings fit the posture; a store here is always durable."""
        if self.posture in POSTURES[2:] and self.access.open:
            raise ValueError(f"{self.posture} needs access control")
        if self.posture == "replacement-grade" and reasoning_mode == "owl-dl-target":
            raise ValueError("replacement-grade cannot use owl-dl-target, which does nothing yet")
        if self.posture == "replacement-grade" and self.plain_syntax_errors:
            raise ValueError("replacement-grade needs problem documents for syntax errors")
