"""Vectorised primitives over the UTF-8 buffers of Arrow string columns.

A chunk is a run of rows whose texts lie in one ``uint8`` buffer; ``offsets``
(length rows + 1) says where each text begins.  Nothing here loops over bytes
or words in Python, and a chunk is kept small enough that the 8-byte-per-byte
work arrays stay within a few megabytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer single text makes a chunk of its own.
CHUNK_BYTES = 1 << 19

U64 = np.uint64
_MASK = (1 << 64) - 1
#: Multiplier of the polynomial hash (odd, 3 modulo 8) and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C13
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int) -> "_PowerTable":
    return _PowerTable(base)


class _PowerTable:
    """base**0, base**1, ... modulo 2**64, extended on demand."""

    def __init__(self, base: int) -> None:
        self._base = base
        self._table = np.ones(1, dtype=U64)

    def upto(self, n: int) -> np.ndarray:
        while len(self._table) < n:
            step = U64(pow(self._base, len(self._table), 1 << 64))
            self._table = np.concatenate([self._table, self._table * step])
        return self._table


_POW = _powers(_BASE)
_INV = _powers(_INVERSE)
#: One random 64-bit value for each byte.
_BYTE = np.random.default_rng(20240117).integers(0, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string column; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, raw, data = column.buffers()
    n = len(column)
    if raw is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(raw, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    body = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return body, offsets - offsets[0]


def cut(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, at least a row each."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(n, max(to, at + 1))
        yield at, to
        at = to


def chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, buffer, offsets) pieces of a record batch."""
    body, offsets = text_buffer(batch.column(batch.schema.get_field_index(text)))
    for a, b in cut(offsets, limit):
        yield batch.slice(a, b - a), body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial hash, one longer than the buffer."""
    sums = np.empty(len(buf) + 1, dtype=U64)
    sums[0] = 0
    np.cumsum(_BYTE[buf] * _POW.upto(len(buf))[: len(buf)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; equal spans have equal hashes wherever they lie."""
    return mix64((sums[ends] - sums[starts]) * _INV.upto(len(sums))[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def spans_of(flag: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True, cut at the bounds of texts."""
    n = len(flag)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    begin = flag.copy()
    begin[1:] &= ~flag[:-1] | edge[1:n]
    end = flag.copy()
    end[:-1] &= ~flag[1:] | edge[1:n]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def space_words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+``: starts, ends, and for each text the range of its words."""
    starts, ends = spans_of(~_SPACE[buf], offsets)
    return starts, ends, np.searchsorted(starts, offsets)


def fold(parts: list[np.ndarray]) -> np.ndarray:
    """One hash of several hashes, in order."""
    out = np.full(len(parts[0]), 0x243F6A8885A308D3, dtype=U64)
    for p in parts:
        out = mix64(out * U64(0x9E3779B97F4A7C15) + p)
    return out


# --- XXH64 -----------------------------------------------------------------

#: Fixed values of XXH64.
_P1, _P2, _P3, _P4, _P5 = (U64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U64(r)) | (x >> U64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * _P2, 31) * _P1


def xxh64_spans(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of many spans of one buffer, span by span in lock step."""
    n = len(starts)
    padded = np.concatenate([np.ascontiguousarray(buf), np.zeros(8, np.uint8)])
    view8 = np.ndarray(len(buf) + 1, "<u8", padded.data, 0, (1,))
    view4 = np.ndarray(len(buf) + 1, "<u4", padded.data, 0, (1,))
    at, left, s = starts.astype(np.int64), lengths.astype(np.int64), U64(seed)
    with np.errstate(over="ignore"):
        h = np.full(n, s + _P5, dtype=U64)
        big = np.flatnonzero(left >= 32)
        if len(big):
            p, rest = at[big], left[big].copy()
            acc = [np.full(len(big), x, dtype=U64) for x in (s + _P1 + _P2, s + _P2, s, s - _P1)]
            live = np.arange(len(big))
            while len(live):
                q = p[live]
                for k in range(4):
                    acc[k][live] = _round(acc[k][live], view8[q + 8 * k])
                p[live] += 32
                rest[live] -= 32
                live = live[rest[live] >= 32]
            out = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
            for k in range(4):
                out = (out ^ _round(np.zeros(len(big), U64), acc[k])) * _P1 + _P4
            h[big] = out
            at, left = at.copy(), left.copy()
            at[big], left[big] = p, rest
        h = h + lengths.astype(U64)
        for _ in range(3):
            live = np.flatnonzero(left >= 8)
            if not len(live):
                break
            if len(live) == n:
                h = _rotl(h ^ _round(np.zeros(1, U64), view8[at]), 27) * _P1 + _P4
                at, left = at + 8, left - 8
            else:
                q = at[live]
                h[live] = _rotl(h[live] ^ _round(np.zeros(1, U64), view8[q]), 27) * _P1 + _P4
                if at is starts:
                    at, left = at.copy(), left.copy()
                at[live] += 8
                left[live] -= 8
        live = np.flatnonzero(left >= 4)
        if len(live):
            q = at[live]
            h[live] = _rotl(h[live] ^ (view4[q].astype(U64) * _P1), 23) * _P2 + _P3
            at, left = at.copy(), left.copy()
            at[live] += 4
            left[live] -= 4
        for _ in range(3):
            live = np.flatnonzero(left >= 1)
            if not len(live):
                break
            q = at[live]
            h[live] = _rotl(h[live] ^ (padded[q].astype(U64) * _P5), 11) * _P1
            at[live] += 1
            left[live] -= 1
        h ^= h >> U64(33)
        h = h * _P2
        h ^= h >> U64(29)
        h = h * _P3
        h ^= h >> U64(32)
    return h


_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def majority(hashes: np.ndarray, group_offsets: np.ndarray) -> np.ndarray:
    """For each group of consecutive hashes, the bits set in over half of them."""
    groups = len(group_offsets) - 1
    sizes = np.diff(group_offsets)
    owner = np.repeat(np.arange(groups, dtype=np.int64), sizes)
    out = np.zeros(groups, dtype=U64)
    weights = U64(1) << np.arange(8, dtype=U64)
    for k in range(8):
        byte = ((hashes >> U64(8 * k)) & U64(0xFF)).astype(np.int64)
        for a in range(0, groups, 512):
            b = min(groups, a + 512)
            lo, hi = group_offsets[a], group_offsets[b]
            counts = np.bincount((owner[lo:hi] - a) * 256 + byte[lo:hi], minlength=(b - a) * 256).reshape(b - a, 256) @ _BITS
            bits = counts * 2 > sizes[a:b, None]
            out[a:b] |= (bits * weights).sum(axis=1, dtype=U64) << U64(8 * k)
    return out
