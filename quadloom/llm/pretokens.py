"""Vectorised pre-tokenisation: the patterns of two public BPE vocabularies over code points.

``spans_gpt`` follows ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``;
``spans_words`` follows ``'s|'t|'re|'ve|'m|'ll|'d|\\p{L}+|\\p{N}|[^\\s\\p{L}\\p{N}]+``, white space dropped.
Both work on all texts of a chunk at once: class changes of neighbouring code
points are the borders, and the few exceptions (a space joins what follows it,
the last of several white spaces stands alone, contractions end early) are
corrections at the places where they occur.
"""

from __future__ import annotations

import functools

import numpy as np

from quadloom.llm import bytesvec as bv

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3


@functools.lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point, as the tokenizers library's own patterns see it."""
    from tokenizers import Regex, normalizers

    table = np.zeros(0x110000, dtype=np.uint8)
    points = np.array([*range(1, 0xD800), *range(0xE000, 0x110000)], dtype=np.uint32)
    everything = points.tobytes().decode("utf-32-le")
    for pattern, kind, mark in ((r"\p{L}", LETTER, "\0"), (r"\p{N}", NUMBER, "\0"), (r"\s", SPACE, "\0")):
        marked = normalizers.Replace(Regex(pattern), mark).normalize_str(everything)
        table[points[np.frombuffer(marked.encode("utf-32-le"), np.uint32) == 0]] = kind
    return table


def code_points(buf: np.ndarray, offsets: np.ndarray) -> tuple[str, np.ndarray, np.ndarray]:
    """The chunk as one string, its code points, and where each text begins among them."""
    text = buf.tobytes().decode("utf-8", "replace")
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(points) == len(buf):
        return text, points, offsets
    heads = np.zeros(len(buf) + 1, dtype=np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=heads[1:])
    return text, points, heads[offsets]


def _contractions(points: np.ndarray, kind: np.ndarray, starts: np.ndarray, edge: np.ndarray, spaced: bool) -> None:
    """Correct ``starts`` at contractions: apostrophes that begin a piece, and one of s t m d re ve ll after them."""
    n = len(points)
    at = np.flatnonzero((points == 0x27) & starts[:n])
    at = at[at + 1 < n]
    at = at[~edge[at + 1]]
    if not len(at):
        return
    one = points[at + 1]
    single = np.isin(one, [ord(c) for c in "stmd"])
    inside = (at + 2 < n) & ~edge[np.minimum(at + 2, n)]
    two = points[np.minimum(at + 2, n - 1)]
    double = inside & ((one == ord("r")) & (two == ord("e")) | (one == ord("v")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
    for found, width in ((at[single], 2), (at[double], 3)):
        starts[found + 1] = False
        starts[found + width] = True


def _edges(n: int, offsets: np.ndarray) -> np.ndarray:
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    edge[n] = True
    return edge


def spans_gpt(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all pieces; they cover every code point."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = classes()[points]
    edge = _edges(n, offsets)
    starts = edge.copy()
    starts[1:n] |= kind[1:] != kind[:-1]
    blank = kind == SPACE
    # the last of several white spaces before something else begins a piece
    starts[1 : n - 1] |= blank[1:-1] & blank[:-2] & ~blank[2:] & ~edge[1 : n - 1] & ~edge[2:n]
    # a space (U+0020) joins what follows
    join = (points[:-1] == 0x20) & ~blank[1:] & ~edge[1:n]
    starts[1:n] &= ~join
    _contractions(points, kind, starts, edge, True)
    starts |= edge
    where = np.flatnonzero(starts)
    return where[:-1], where[1:]


def spans_words(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all pieces, white space left out."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = classes()[points]
    edge = _edges(n, offsets)
    starts = edge.copy()
    starts[1:n] |= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
    _contractions(points, kind, starts, edge, False)
    starts |= edge
    where = np.flatnonzero(starts)
    a, b = where[:-1], where[1:]
    full = kind[a] != SPACE
    return a[full], b[full]


_POINT_SALT = np.uint64(0x632BE59BD9B4E019)


def span_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the code points of each span."""
    value = (points.astype(np.uint64) + np.uint64(1)) * _POINT_SALT
    value ^= value >> np.uint64(29)
    value *= bv._POW.upto(len(points))[: len(points)]
    sums = np.empty(len(points) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(value, out=sums[1:])
    return bv.span_hash(sums, starts, ends)


class PieceTable:
    """What has been worked out for distinct pieces, looked up by hash; emptied when it holds ``most`` pieces."""

    def __init__(self, most: int) -> None:
        self._most = most
        self._known: dict = {}

    def lookup(self, hashes: np.ndarray, text: str, starts: np.ndarray, ends: np.ndarray, work) -> tuple[list, np.ndarray]:
        """The values of the distinct spans, and for each span its place among them; ``work(pieces)`` gets the pieces that are new, each once."""
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self._known) > self._most:
            self._known.clear()
        known = self._known
        each = distinct.tolist()
        fresh = [k for k, h in enumerate(each) if h not in known]
        if fresh:
            at = first[fresh]
            pieces = [text[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())]
            known.update(zip([each[k] for k in fresh], work(pieces)))
        return [known[h] for h in each], inverse


class IdTable:
    """The token ids of distinct pieces, found by hash in arrays (open addressing, at most half full); emptied when it holds over ``most`` pieces."""

    def __init__(self, most: int) -> None:
        self._most = most
        self._clear()

    def _clear(self) -> None:
        self._known = self._end = 0
        self._slots(1 << 16)
        #: the ids of all pieces after one another
        self.ids = np.zeros(1 << 18, dtype="<u2")

    def _slots(self, n: int) -> None:
        self._hash, self._begin, self._size = np.zeros(n, np.uint64), np.zeros(n, np.int64), np.zeros(n, np.int64)

    def _home(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes & np.uint64(len(self._hash) - 1)).astype(np.int64)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hash; a slot of size 0 if it is not there."""
        slot, last = self._home(hashes), len(self._hash) - 1
        rest = np.flatnonzero(self._hash[slot] != hashes)
        while len(rest):
            rest = rest[self._size[slot[rest]] > 0]
            slot[rest] = slot[rest] + 1 & last
            rest = rest[self._hash[slot[rest]] != hashes[rest]]
        return slot

    def _insert(self, hashes: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
        """Distinct hashes that are not there yet."""
        slot, last = self._home(hashes), len(self._hash) - 1
        live = np.arange(len(hashes))
        while len(live):
            free = live[self._size[slot[live]] == 0]
            self._hash[slot[free]] = hashes[free]
            # of several for one slot the last has it
            won = free[self._hash[slot[free]] == hashes[free]]
            self._begin[slot[won]], self._size[slot[won]] = begin[won], size[won]
            live = np.setdiff1d(live, won, assume_unique=True)
            slot[live] = slot[live] + 1 & last

    def _learn(self, hashes: np.ndarray, made: list[bytes]) -> None:
        size = np.fromiter(map(len, made), np.int64, len(made)) // 2
        stop = self._end + np.cumsum(size)
        end = int(stop[-1])
        if end > len(self.ids):
            self.ids = np.concatenate([self.ids[: self._end], np.zeros(2 * end - self._end, "<u2")])
        self.ids[self._end : end] = np.frombuffer(b"".join(made), "<u2")
        self._end, self._known = end, self._known + len(made)
        if 2 * self._known > len(self._hash):
            full = np.flatnonzero(self._size)
            old = self._hash[full], self._begin[full], self._size[full]
            self._slots(1 << (4 * self._known - 1).bit_length())
            self._insert(*old)
        self._insert(hashes, stop - size, size)

    def lookup(self, hashes: np.ndarray, text: str, starts: np.ndarray, ends: np.ndarray, work) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``ids`` each span's ids begin, and how many they are; ``work(pieces)`` gives the ids of new pieces, each once, as bytes."""
        if self._known > self._most:
            self._clear()
        slot = self._find(hashes)
        new = np.flatnonzero(self._size[slot] == 0)
        if len(new):
            fresh, first = np.unique(hashes[new], return_index=True)
            at = new[first]
            self._learn(fresh, work([text[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())]))
            slot = self._find(hashes)
        return self._begin[slot], self._size[slot]
