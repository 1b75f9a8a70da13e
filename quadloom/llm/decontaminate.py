"""Benchmark decontamination: SimHash windows, a multi-index over Hamming blocks, exact verification.

Words are runs of ASCII letters and digits and of any non-ASCII characters,
in lower case.  A benchmark item of n words is compared with windows of n words
of each document.  Window and item have a 64-bit SimHash of their five-word
shingles; the fingerprint is cut into ``BLOCKS`` blocks, and as two
fingerprints within ``RADIUS`` bits differ in at most RADIUS // BLOCKS bits in
one block, looking up all variants of each block at that distance misses no
fingerprint within the radius.  Candidates are verified by the exact
similarity of their weighted shingles (sum of least counts over sum of
greatest counts), ``SIMILARITY`` = 0.8 or more.

The similarity of a window and an item is at most the share of the item's
length that the window has in shingles known of items of that length.  Windows
for which that is under 0.8 are left out by counting, so a shingle that many
items share makes no window by itself; only the others are fingerprinted.  At similarity 0.8 two
fingerprints differ in about 10 of 64 bits (standard deviation 3); the radius
of 20 leaves a miss about one chance in two thousand for a passage that is
exactly at the threshold and has one window only.

Items of under five words have one shingle, all their words; items without
words match nothing; a text shorter than an item is one window.  Null texts
are empty.  Repeated rows give repeated results, a repeated item counts once.  The
items are sent to every task, in blocks of about ``MOST_ITEMS`` items and
``MOST_BYTES`` of text: a larger benchmark takes a pass over the documents for
each block.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.llm import bytesvec as bv
from quadloom.llm.common import batch, pick, small_batches

SHINGLE, SIMILARITY = 5, 0.8
RADIUS, BLOCKS = 20, 5
MOST_ITEMS, MOST_BYTES = 50_000, 16 << 20

_WORD = np.zeros(256, dtype=bool)
_WORD[0x80:] = True
_WORD[[*b"abcdefghijklmnopqrstuvwxyz0123456789"]] = True


def word_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of lower-cased texts, and for each text the range of its words."""
    starts, ends = bv.spans_of(_WORD[buf], offsets)
    return bv.span_hash(bv.prefix_sums(buf), starts, ends), np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """The hash of the ``width`` words from each word on (texts are not told apart here)."""
    n = max(0, len(words) - width + 1)
    return bv.fold([words[k : k + n] for k in range(width)]) if n else np.zeros(0, np.uint64)


def _block_bounds() -> list[tuple[int, int]]:
    cuts = [round(64 * k / BLOCKS) for k in range(BLOCKS + 1)]
    return [(a, b - a) for a, b in itertools.pairwise(cuts)]


class Index:
    """The items of one block of the benchmark, of one shingle width."""

    def __init__(self, items: list[tuple[int, np.ndarray]], width: int) -> None:
        self.width = width
        self.ids = [i for i, _ in items]
        self.shingles = [shingle_hashes(w, width) for _, w in items]
        self.sizes = np.array([len(s) for s in self.shingles], dtype=np.int64)
        self.weights = [Counter(s.tolist()) for s in self.shingles]
        every = np.concatenate(self.shingles)
        owner = np.repeat(np.arange(len(items)), self.sizes)
        order = np.lexsort((owner, every))
        self.known = every[order]
        # the distinct lengths of the items that have a shingle, side by side
        sizes = self.sizes[owner[order]]
        order = np.lexsort((sizes, self.known))
        keep = np.ones(len(order), dtype=bool)
        keep[1:] = (np.diff(self.known[order]) != 0) | (np.diff(sizes[order]) != 0)
        self.pair_shingles, self.pair_sizes = self.known[order][keep], sizes[order][keep]
        self.filter = np.zeros(1 << 18, dtype=bool)
        self.filter[(self.known >> np.uint64(46)).astype(np.int64)] = True
        bounds = np.zeros(len(items) + 1, dtype=np.int64)
        np.cumsum(self.sizes, out=bounds[1:])
        self.prints = bv.majority(every, bounds)
        self.blocks = []
        near = RADIUS // BLOCKS
        for at, bits in _block_bounds():
            key = (self.prints >> np.uint64(at) & np.uint64((1 << bits) - 1)).astype(np.int64)
            order = np.argsort(key, kind="stable")
            first = np.searchsorted(key[order], np.arange((1 << bits) + 1))
            flips = np.array([sum(1 << i for i in c) for k in range(near + 1) for c in itertools.combinations(range(bits), k)], dtype=np.int64)
            self.blocks.append((at, bits, order, first, flips))

    def hits(self, shingles: np.ndarray) -> np.ndarray:
        """Places of shingles that some item has."""
        at = np.flatnonzero(self.filter[(shingles >> np.uint64(46)).astype(np.int64)])
        spot = np.searchsorted(self.known, shingles[at])
        return at[self.known[np.minimum(spot, len(self.known) - 1)] == shingles[at]]

    def by_size(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which, size): every distinct length of the items that have each of these shingles."""
        first, last = (np.searchsorted(self.pair_shingles, shingles, side) for side in ("left", "right"))
        count = last - first
        which = np.repeat(np.arange(len(shingles)), count)
        return which, self.pair_sizes[np.repeat(first - np.cumsum(count) + count, count) + np.arange(len(which))]

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (print, item) pairs within the radius."""
        pairs = []
        for at, bits, order, first, flips in self.blocks:
            key = (prints >> np.uint64(at) & np.uint64((1 << bits) - 1)).astype(np.int64)
            reach = key[:, None] ^ flips
            count = first[reach + 1] - first[reach]
            row, col = np.nonzero(count)
            each = count[row, col]
            begin = np.repeat(first[reach[row, col]], each)
            step = np.arange(len(begin)) - np.repeat(np.cumsum(each) - each, each)
            item = order[begin + step]
            which = np.repeat(row, each)
            close = np.bitwise_count(prints[which] ^ self.prints[item]) <= RADIUS
            pairs.append(which[close] * len(self.ids) + item[close])
        pairs = np.unique(np.concatenate(pairs))
        return pairs // len(self.ids), pairs % len(self.ids)


def windows(index: Index, shingles: np.ndarray, ranges: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(text, item, first shingle, similarity in millionths) of every verified window of a chunk; ranges: each text's shingles."""
    hits = index.hits(shingles)
    text = np.searchsorted(ranges[:, 0], hits, "right") - 1
    inside = hits < ranges[text, 1] if len(hits) else np.zeros(0, bool)
    hits, text = hits[inside], text[inside]
    which, size = index.by_size(shingles[hits])
    order = np.lexsort((hits[which], size, text[which]))
    which, size = which[order], size[order]
    heads = np.flatnonzero(np.concatenate([[True], (np.diff(text[which]) != 0) | (np.diff(size) != 0)])) if len(which) else np.zeros(0, np.int64)
    wanted = []
    for a, z in zip(heads, np.append(heads[1:], len(which))):
        t, long = int(text[which[a]]), int(size[a])
        lo, hi = ranges[t].tolist()
        last = max(lo, hi - long)
        places = hits[which[a:z]]
        # how many of the places each window has
        count = np.zeros(last - lo + 2, dtype=np.int64)
        np.add.at(count, np.clip(places - long + 1, lo, last) - lo, 1)
        np.subtract.at(count, np.minimum(places, last) - lo + 1, 1)
        wanted += [(t, long, lo + k) for k in np.flatnonzero(np.cumsum(count[:-1]) >= SIMILARITY * long).tolist()]
    found = []
    for at in range(0, len(wanted), 2048):
        some = wanted[at : at + 2048]
        a = np.array([w[2] for w in some])
        b = np.minimum(a + np.array([w[1] for w in some]), ranges[[w[0] for w in some], 1])
        bounds = np.zeros(len(some) + 1, dtype=np.int64)
        np.cumsum(b - a, out=bounds[1:])
        every = shingles[np.repeat(a - bounds[:-1], b - a) + np.arange(bounds[-1])]
        which, item = index.near(bv.majority(every, bounds))
        for w, i in zip(which.tolist(), item.tolist()):
            if index.sizes[i] != some[w][1]:
                continue
            own = Counter(shingles[a[w] : b[w]].tolist())
            common = sum((own & index.weights[i]).values())
            whole = sum((own | index.weights[i]).values())
            if common >= SIMILARITY * whole:
                found.append((some[w][0], i, int(a[w]), common * 1_000_000 // whole))
    return found


def build(items: list[tuple[int, str]]) -> list[Index]:
    column = pc.utf8_lower(pa.array([t or "" for _, t in items], pa.large_string()))
    words, first = word_hashes(*bv.text_buffer(column))
    by_width: dict[int, list] = {}
    for (item_id, _), a, b in zip(items, first[:-1], first[1:]):
        if b > a:
            by_width.setdefault(min(SHINGLE, int(b - a)), []).append((item_id, words[a:b]))
    return [Index(some, width) for width, some in by_width.items()]


def chunk_matches(indexes: list[Index], buf: np.ndarray, offsets: np.ndarray) -> dict[tuple[int, int], list[int]]:
    """For each (text, item id) of a lower-cased chunk that match: greatest similarity in millionths, windows, first and last word."""
    words, first = word_hashes(buf, offsets)
    best: dict[tuple[int, int], list[int]] = {}
    for index in indexes:
        shingles = shingle_hashes(words, index.width)
        ranges = np.stack([first[:-1], np.maximum(first[:-1], first[1:] - index.width + 1)], axis=1)
        for t, i, a, score in windows(index, shingles, ranges):
            a -= int(first[t])
            z = min(a + int(index.sizes[i]) + index.width - 1, int(first[t + 1] - first[t]))
            own = best.setdefault((t, index.ids[i]), [0, 0, a, z])
            own[:] = [max(own[0], score), own[1] + 1, min(own[2], a), max(own[3], z)]
    return best


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, most_items: int) -> Iterator[list[Index]]:
    """Indexes of at most about ``most_items`` items and ``MOST_BYTES`` of text each."""
    items = pick(benchmark, item_id=item_col, text=text_col).distinct()
    n, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(-(-n // most_items), -(-size // MOST_BYTES))
    for part in range(parts):
        block = items if parts == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        yield build([(r["item_id"], r["text"]) for r in block.collect()])


def _lower(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column) if not pa.types.is_null(column.type) else column


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", most_items: int = MOST_ITEMS) -> DataFrame:
    """One row for each text and item that match: doc_id, item_id, similarity, n_windows, first_word, last_word (of all matching windows)."""
    small_batches(docs.sparkSession)
    out = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("n_windows", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64())])
    schema = "doc_id long, item_id long, similarity double, n_windows long, first_word long, last_word long"
    texts = pick(docs, doc_id=id_col, text=text_col)
    result = None
    for indexes in item_blocks(benchmark, item_col, item_text_col, most_items):

        def run(batches: Iterator[pa.RecordBatch], indexes=indexes) -> Iterator[pa.RecordBatch]:
            for b in batches:
                lower = pa.RecordBatch.from_arrays([b.column(0), _lower(b.column(1))], names=["doc_id", "text"])
                for rows, buf, offsets in bv.chunks(lower, "text"):
                    best = chunk_matches(indexes, buf, offsets)
                    if best:
                        ids = rows.column(0).to_pylist()
                        yield batch(out, [ids[t] for t, _ in best], [i for _, i in best], [v[0] / 1e6 for v in best.values()], *zip(*(v[1:] for v in best.values())))

        found = texts.mapInArrow(run, schema)
        result = found if result is None else result.unionByName(found)
    return result if result is not None else texts.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", most_items: int = MOST_ITEMS) -> DataFrame:
    """The rows of ``docs`` whose text contains no benchmark item, all columns as they are; nothing is shuffled."""
    small_batches(docs.sparkSession)
    position = docs.columns.index(text_col)
    for indexes in item_blocks(benchmark, item_col, item_text_col, most_items):

        def run(batches: Iterator[pa.RecordBatch], indexes=indexes) -> Iterator[pa.RecordBatch]:
            for b in batches:
                lower = pa.RecordBatch.from_arrays([_lower(b.column(position)), pa.array(np.arange(b.num_rows))], names=["text", "row"])
                good = np.ones(b.num_rows, dtype=bool)
                for rows, buf, offsets in bv.chunks(lower, "text"):
                    base = rows.column(1)[0].as_py()
                    good[[base + t for t, _ in chunk_matches(indexes, buf, offsets)]] = False
                yield b.filter(pa.array(good))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
