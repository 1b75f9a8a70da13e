"""Exact removal of repeated 400-byte strings with a run-length index.

1.  *Routing.*  Each window of ``LENGTH`` = 400 bytes is owned by its anchor,
    the leftmost least-hashed ``GRAM``-byte string in it.  Equal windows have
    equal anchors at equal offsets, so only windows of one anchor hash can be
    equal, and every window has one owner.  The windows of an anchor's place
    form its context (at most ``2 * LENGTH - GRAM`` bytes), named by a 128-bit
    BLAKE2b digest of its bytes.  Anchors whose one context occurs once have no
    repeated window.
2.  *Run-length index.*  Equal contexts are one run: a context that occurs
    twice is covered whole, and goes on once with its number of copies.  The
    different contexts of an anchor that has several go to blocks that hold
    whole anchors.  A block's Burrows-Wheeler transform is kept as runs with
    the suffix positions at run heads and run ends.  Only there are common
    prefixes measured; between them the matching statistics are streamed
    through the text, each one less than the one before.  Positions with a
    statistic of 400 or more start a repeated window.  The suffix order from
    which a piece's runs are cut is built in full, so a task's memory follows
    the piece: about ``BLOCK`` bytes, or one anchor with ``MOST`` contexts.
3.  *Hot anchors.*  The contexts of an anchor with more than ``MOST`` of them
    are routed again, by anchors of a longer string (half way to ``LENGTH``
    each time), which tell apart what the shorter one did not.  An anchor of
    ``LENGTH`` bytes is a window itself and has one context, so this ends; the
    result does not depend on ``MOST``.

Texts are UTF-8 bytes; null texts are empty; texts under 400 bytes lose
nothing; matches never cross documents; repeated rows (null ids included) are
repeated documents, so all of a repeated long text goes.  Every row of the
input has a row in the result.  Ids are integers that fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.llm import bytesvec as bv
from quadloom.llm.common import batch, null_safe_id, pick, small_batches, written

LENGTH = 400
GRAM = 152
#: Different contexts of one anchor in one piece of the index; an anchor with more is routed again by longer strings.
MOST = 1000
#: Bytes of contexts in one piece of the index, and in one group of pieces, which goes to one task.
BLOCK, GROUP = 1 << 17, 2 << 20
_ANCHOR_CHUNK = 1 << 17


def anchors_of(buf: np.ndarray, offsets: np.ndarray, width: int = GRAM) -> tuple[np.ndarray, ...] | None:
    """For each anchor place of a chunk: text, first window, windows, anchor hash, and the two halves of its context's digest."""
    n, m, starts, span = len(buf), len(buf) - width + 1, len(buf) - LENGTH + 1, LENGTH - width + 1
    lengths = np.diff(offsets)
    if starts <= 0 or not (lengths >= LENGTH).any():
        return None
    sums = bv.prefix_sums(buf)
    gram = sums[width:] - sums[:m]
    gram *= bv._INV.upto(n + 1)[:m]
    rows = -(-m // span)
    key = np.full(rows * span, bv.U64(bv._MASK))
    np.multiply(gram, bv.U64(0xD6E8FEB86659FD93), out=key[:m])
    key[:m] &= bv.U64(0xFFFFFFFF00000000)
    key[:m] |= np.arange(m, dtype=np.uint64)
    key = key.reshape(rows, span)
    ahead = np.minimum.accumulate(key, axis=1).ravel()
    behind = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:starts], ahead[span - 1 : span - 1 + starts])
    # windows must end in the text in which they start
    valid = np.zeros(n + 1, dtype=np.int32)
    fits = lengths >= LENGTH
    valid[offsets[:-1][fits]] += 1
    valid[offsets[1:][fits] - LENGTH + 1] -= 1
    valid = np.cumsum(valid[:starts]).astype(bool)
    first = np.empty(starts, dtype=bool)
    first[0] = True
    np.not_equal(least[1:], least[:-1], out=first[1:])
    first[1:] |= ~valid[:-1]
    first[offsets[:-1][offsets[:-1] < starts]] = True
    first &= valid
    last = np.empty(starts, dtype=bool)
    last[-1] = True
    last[:-1] = first[1:] | ~valid[1:]
    last &= valid
    lo, hi = np.flatnonzero(first), np.flatnonzero(last)
    at = (least[lo] & bv.U64(0xFFFFFFFF)).astype(np.int64)
    text = np.searchsorted(offsets, lo, "right") - 1
    raw = memoryview(np.ascontiguousarray(buf))
    digests = b"".join([hashlib.blake2b(raw[a:z], digest_size=16).digest() for a, z in zip(lo.tolist(), (hi + LENGTH).tolist())])
    context = np.frombuffer(digests, np.int64).reshape(-1, 2)
    return text, lo - offsets[text], hi - lo + 1, bv.mix64(gram[at]), context[:, 0], context[:, 1]


_ANCHORS = "id long, th long, lo long, n int, h long, c long, d long"


def _anchor_rows(width: int):
    out = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("lo", pa.int64()), ("n", pa.int32()), ("h", pa.int64()), ("c", pa.int64()), ("d", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, buf, offsets in bv.chunks(b, "text", _ANCHOR_CHUNK):
                found = anchors_of(buf, offsets, width)
                if found is not None:
                    text, lo, n, h, c, d = found
                    ids, hashes = (rows.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                    yield batch(out, ids[text], hashes[text], lo, n.astype(np.int32), h.view(np.int64), c, d)

    return run


def suffix_array(text: np.ndarray, end: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first ``depth`` bytes; a suffix ends at ``end`` of its position, before which no byte is 0.

    Ranks of ``known`` bytes become ranks of two or three times as many.  A
    sort key holds its position in the low bits, so plain sorts do; they are
    several times faster than sorts of positions.
    """
    n = len(text)
    bits = max(n, 1).bit_length()
    low = np.uint64((1 << bits) - 1)
    here = np.arange(n, dtype=np.int64)
    place = here.astype(np.uint64)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    known = min(8, (64 - bits) // 8)
    key = np.ndarray(n, ">u8", padded.data, 0, (1,)).astype(np.uint64)
    left = np.minimum(end - here, known).astype(np.uint64)
    key &= np.where(left > 0, ~np.uint64(0) << ((np.uint64(8) - left) * np.uint64(8) & np.uint64(63)), np.uint64(0))
    key >>= np.uint64(64 - 8 * known)
    shift = np.uint64(bits)
    parts = 2 if bits * 4 <= 64 else 1
    if bits * 3 > 64:
        raise ValueError("a block of the index is limited to 2 MB")
    rank = np.empty(n + 1, dtype=np.uint64)
    while True:
        ordered = np.sort(key << shift | place)
        order = (ordered & low).astype(np.int64)
        ordered >>= shift
        fresh = np.empty(n, dtype=bool)
        fresh[:1] = True
        np.not_equal(ordered[1:], ordered[:-1], out=fresh[1:])
        ranks = np.cumsum(fresh)
        if known >= depth or not n or ranks[-1] == n:
            return order
        rank[order] = ranks
        rank[n] = 0
        key = rank[:n].copy()
        for k in range(1, parts + 1):
            to = here + k * known
            key <<= shift
            key |= rank[np.where(to < end, to, n)]
        known *= parts + 1


def common_prefix(view: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Bytes that the texts from a and from b have in common, ``most`` at most; view: 8 bytes from each position."""
    out = np.zeros(len(a), dtype=np.int64)
    live = np.flatnonzero(most > 0)
    while len(live):
        x = view[a[live] + out[live]] ^ view[b[live] + out[live]]
        whole = x == 0
        low = x & (~x + np.uint64(1))
        out[live] += np.where(whole, 8, np.bitwise_count(low - np.uint64(1)).astype(np.int64) // 8)
        live = live[whole & (out[live] < most[live])]
    return np.minimum(out, most)


def matching_statistics(contexts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each position of the joined contexts, the longest string from it that also starts elsewhere (in any of them); and the bounds of the contexts."""
    bounds = np.zeros(len(contexts) + 1, dtype=np.int64)
    np.cumsum([len(x) for x in contexts], out=bounds[1:])
    text = np.frombuffer(b"".join(contexts), np.uint8).copy()
    text[text == 0] = 0xC0  # not in any UTF-8 text; 0 is kept for ends
    n = len(text)
    if n < 2:
        return np.zeros(n, np.int64), bounds
    end = np.repeat(bounds[1:], np.diff(bounds))
    order = suffix_array(text, end, max(len(x) for x in contexts))
    before = text[order - 1].astype(np.int16)
    heads = bounds[:-1][np.diff(bounds) > 0]
    starts_context = np.zeros(n, dtype=bool)
    starts_context[heads] = True
    cut = np.empty(n + 1, dtype=bool)  # run i begins where the transform changes
    cut[0] = cut[n] = True
    cut[1:n] = (before[1:] != before[:-1]) | starts_context[order[1:]] | starts_context[order[:-1]]
    view = np.ndarray(n, "<u8", (padded := np.concatenate([text, np.zeros(8, np.uint8)])).data, 0, (1,))
    left = end - np.arange(n)
    run_heads, run_ends = np.flatnonzero(cut[:-1]), np.flatnonzero(cut[1:])
    here = np.arange(n)
    best = np.zeros(n, dtype=np.int64)
    for samples, step in ((run_heads, -1), (run_ends, 1)):
        at = order[samples]
        neighbour = samples + step
        inside = (neighbour >= 0) & (neighbour < n)
        other = order[np.where(inside, neighbour, samples)]
        length = common_prefix(view, at, other, np.where(inside, np.minimum(left[at], left[other]), 0))
        sampled = np.zeros(n, dtype=np.int64)
        sampled[at] = length + at + 1  # length + position falls only at samples
        known = np.zeros(n, dtype=bool)
        known[at] = True
        source = np.maximum.accumulate(np.where(known, here, 0))
        best = np.maximum(best, sampled[source] - 1 - here)
    return best, bounds


def _index_blocks(t: pa.Table) -> pa.Table:
    """Contexts of whole anchors in; (c, d, from, to) out: bytes of the context that repeated windows cover."""
    t = t.sort_by("h")
    h, c, d = (t.column(k).to_numpy() for k in ("h", "c", "d"))
    body = t.column("body").to_pylist()
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = np.cumsum([len(x) for x in body])
    groups = np.append(np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])), len(h)) if len(h) else np.zeros(1, np.int64)
    at = 0
    while at < len(groups) - 1:
        to = at + 1
        base = size[groups[at]] - len(body[groups[at]])
        while to < len(groups) - 1 and size[groups[to + 1] - 1] - base <= BLOCK:
            to += 1
        a, b = int(groups[at]), int(groups[to])
        at = to
        stats, bounds = matching_statistics(body[a:b])
        flag = stats >= LENGTH
        lo, hi = bv.spans_of(flag, bounds[:-1])
        which = np.searchsorted(bounds, lo, "right") - 1
        found.append((which + a, lo - bounds[which], hi - 1 + LENGTH - bounds[which]))
    which, lo, hi = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found) if found else ((), (), ())))
    which = which.astype(np.int64)
    return pa.table({"c": pa.array(c[which], pa.int64()), "d": pa.array(d[which], pa.int64()), "a": pa.array(lo, pa.int32()), "b": pa.array(hi, pa.int32())})


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, th, text, places: h, c, d, lo, n) in; the bytes of each context out, once for neighbouring rows that are equal."""
    out = pa.schema([("h", pa.int64()), ("c", pa.int64()), ("d", pa.int64()), ("body", pa.binary())])
    last = None
    for b in batches:
        for rows, buf, offsets in bv.chunks(b, "text"):
            raw = buf.tobytes()
            for *key, base, places in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), offsets[:-1].tolist(), rows.column(3).to_pylist()):
                if key != last:
                    yield batch(out, *zip(*[(p["h"], p["c"], p["d"], raw[base + p["lo"] : base + p["lo"] + p["n"] - 1 + LENGTH]) for p in places]))
                last = key


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])
    for b in batches:
        for rows, buf, offsets in bv.chunks(b, "text"):
            raw = buf.tobytes()
            result = []
            for doc_id, spans, a, z in zip(rows.column("doc_id").to_pylist(), rows.column("spans").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                kept, at, removed, runs = [], 0, 0, 0
                for lo, hi in sorted((s["a"], s["b"]) for s in spans or ()):
                    if lo > at or not runs:
                        runs += 1
                        kept.append(raw[a + at : a + lo])
                        removed += hi - lo
                        at = hi
                    elif hi > at:
                        removed += hi - at
                        at = hi
                kept.append(raw[a + at : z])
                body = b"".join(kept)
                result.append((doc_id, z - a, removed, runs, hashlib.sha256(body).hexdigest(), body))
            yield batch(out, *zip(*result))


def covered(texts: DataFrame, width: int = GRAM, most: int | None = None) -> DataFrame:
    """(id, th, a, b): bytes that repeated windows cover, overlaps and repeats included.

    texts: (id, th, text) of at least ``LENGTH`` bytes; equal ids and hashes mean equal texts.
    """
    most = MOST if most is None else most
    rows = written(texts.mapInArrow(_anchor_rows(width), _ANCHORS), "anchors")
    groups = rows.groupBy("h").agg(F.count(F.lit(1)).alias("total"), *(f(k).alias(f"{k}{i}") for k in "cd" for i, f in enumerate((F.min, F.max)))).where("total > 1")
    # a table of its own, so that the join has an exchange on both sides and the rows of a hot anchor can be split
    groups = written(groups.selectExpr("h", "c0 = c1 and d0 = d1 as uniform"), "groups")
    mine = written(rows.join(groups, "h"), "repeated")
    mixed = mine.where(~F.col("uniform"))
    # a digest names a context's bytes, and so its anchor
    contexts = written(mixed.groupBy("h", "c", "d").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("id", "th", "lo", "n")).alias("at")), "contexts")
    hot = written(contexts.groupBy("h").agg(F.count(F.lit(1)).alias("different")).where(F.col("different") > most).select("h"), "hot")
    total = contexts.agg(F.coalesce(F.sum(F.col("at.n") + F.lit(LENGTH)), F.lit(0))).first()[0]
    wanted = contexts.groupBy(F.col("at.id").alias("id"), F.col("at.th").alias("th")).agg(F.collect_list(F.struct("h", "c", "d", F.col("at.lo").alias("lo"), F.col("at.n").alias("n"))).alias("places"))
    # rows that repeat an id and its text give a context several times; copies are dropped in each task before they are shuffled
    cut = texts.join(wanted, ["id", "th"]).select("id", "th", "text", "places").mapInArrow(_cut_out, "h long, c long, d long, body binary")
    bodies = written(cut.dropDuplicates(["h", "c", "d"]), "bodies")
    few = bodies
    whole = contexts.where("copies > 1").select("c", "d", F.lit(0).alias("a"), (F.col("at.n") + (LENGTH - 1)).alias("b"))
    inside = whole
    if not hot.isEmpty():
        few = bodies.join(hot, "h", "left_anti")
        again = bodies.join(hot, "h", "left_semi").select(F.col("c").alias("id"), F.col("d").alias("th"), F.col("body").alias("text"))
        deeper = covered(again, width + -(-(LENGTH - width) // 2), most)
        inside = inside.unionByName(deeper.select(F.col("id").alias("c"), F.col("th").alias("d"), F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b")))
    dealt = few.withColumn("block", F.pmod(F.xxhash64("h"), F.lit(max(1, int(total) // GROUP)))).select("block", "h", "c", "d", "body")
    inside = inside.unionByName(dealt.groupBy("block").applyInArrow(_index_blocks, "c long, d long, a int, b int"))
    spans = mine.where("uniform").select("id", "th", F.col("lo").alias("a"), (F.col("lo") + F.col("n") + (LENGTH - 1)).alias("b"))
    return spans.unionByName(mixed.join(inside, ["c", "d"]).select("id", "th", (F.col("lo") + F.col("a")).alias("a"), (F.col("lo") + F.col("b")).alias("b")))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(the documents keyed by id and text hash; spans a..b (bytes) of them that repeated windows cover, overlaps and repeats included)."""
    small_batches(docs.sparkSession)
    keyed = pick(docs, doc_id=id_col, text=text_col).withColumns({"id": null_safe_id("doc_id"), "th": F.xxhash64("text")})
    return keyed, covered(keyed.where(F.octet_length("text") >= LENGTH).select("id", "th", "text"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept, the remaining bytes."""
    keyed, spans = repeated_spans(docs, id_col, text_col)
    lists = spans.groupBy("id", "th").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    return keyed.join(lists, ["id", "th"], "left").select("doc_id", "text", "spans").mapInArrow(_kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
