"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints of word shingles (XXH64, seed 42) link at ``RADIUS`` = 3 or fewer
differing bits.  Two fingerprints at distance d meet at a point at most
ceil(d / 2) from one and floor(d / 2) from the other, so every distinct
fingerprint emits the variants of itself within half the radius, the variants
are shuffled, and fingerprints that meet are linked.  Three facts keep the
balls small without losing a link:

* at distance 3 one fingerprint has an even and one an odd number of set bits.
  Only the even one needs to flip two bits, the odd one flips one;
* of the three bits in which they differ, two lie in the same 32-bit half, so
  only pairs within a half are flipped (992 of 2,016);
* at distance 2 both flip one bit, at distance 1 the odd one reaches the even.

A meeting of variants with flips i and j, one of them under two, is at most 3
bits wide, so in a group of equal variants a star around one member with at
most one flip has all its links: no pairs of the group are listed.

Null texts are empty; texts without words have fingerprint zero and link like
any other; repeated rows give repeated results; null ids never name a component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.llm import bytesvec as bv
from quadloom.llm import urls
from quadloom.llm.common import batch, hex_of, pick, small_batches, written

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Bytes of variants that one bucket, and so one task, should hold.
BUCKET_BYTES = 6 << 20
#: Fingerprints whose variants a task should emit, and the tasks for that at most.
EMIT_ROWS, MOST_TASKS = 1 << 14, 100_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def shingle_hashes(buf: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all shingles of a chunk, and for each text the range of its own."""
    starts, ends, first = bv.space_words(buf, offsets)
    n = len(offsets) - 1
    lengths = ends - starts
    # all words after one another, a space after each
    begin = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(lengths + 1, out=begin[1:])
    joined = np.full(int(begin[-1]), 0x20, dtype=np.uint8)
    source = np.flatnonzero(~bv._SPACE[buf])
    place = np.arange(len(source), dtype=np.int64) + np.repeat(np.arange(len(starts), dtype=np.int64), lengths)
    joined[place] = _LOWER[buf[source]]
    counts = np.diff(first)
    shingles = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    bounds = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(shingles, out=bounds[1:])
    owner = np.repeat(np.arange(n), shingles)
    head = first[owner] + np.arange(len(owner)) - bounds[owner]
    last = np.minimum(head + width, first[owner + 1])
    return bv.xxh64_spans(joined, begin[head], begin[last] - 1 - begin[head], SEED), bounds


def fingerprints_of(buf: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each text of a chunk."""
    return bv.majority(*shingle_hashes(buf, offsets, width))


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a long."""
    small_batches(docs.sparkSession)
    out = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, buf, offsets in bv.chunks(b, "text"):
                yield batch(out, rows.column(0).cast(pa.int64()), fingerprints_of(buf, offsets, width).view(np.int64))

    return pick(docs, doc_id=id_col, text=text_col).mapInArrow(run, "doc_id long, fp long")


def _masks() -> tuple[np.ndarray, int, int]:
    """Flips: none, one bit, then pairs of bits in the same half."""
    one = [1 << i for i in range(64)]
    two = [1 << i | 1 << j for h in (0, 32) for i in range(h, h + 32) for j in range(i + 1, h + 32)]
    return np.array([0, *one, *two], dtype=np.uint64), 65, 1 + 64 + len(two)


MASKS, ONE_END, TWO_END = _masks()


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def variants(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All variants of the fingerprints, and which flip made each."""
    odd = (_popcount(fps) & 1).astype(bool)
    codes_even = np.arange(TWO_END, dtype=np.uint16)
    codes_odd = np.arange(1, ONE_END, dtype=np.uint16)
    even, odds = fps[~odd], fps[odd]
    v = np.concatenate([(even[:, None] ^ MASKS[codes_even]).ravel(), (odds[:, None] ^ MASKS[codes_odd]).ravel()])
    c = np.concatenate([np.tile(codes_even, len(even)), np.tile(codes_odd, len(odds))])
    return v, c


def _emit(buckets: int):
    out = pa.schema([("bucket", pa.int32()), ("variants", pa.binary()), ("codes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fps), 2048):
                v, c = variants(fps[at : at + 2048])
                home = ((bv.mix64(v) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.uint16 if buckets <= 1 << 16 else np.int32)
                order = np.argsort(home, kind="stable")
                v, c, home = v[order], c[order], home[order]
                cuts = np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1]])) if len(home) else np.zeros(0, np.int64)
                ends = np.append(cuts[1:], len(home))
                yield batch(out, home[cuts].astype(np.int32), [v[i:j].tobytes() for i, j in zip(cuts, ends)], [c[i:j].tobytes() for i, j in zip(cuts, ends)])

    return run


def meetings(v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) between fingerprints whose variants meet: stars around a member with at most one flip."""
    order = np.argsort(v)
    v, c = v[order], c[order]
    same = v[1:] == v[:-1]
    keep = np.zeros(len(v), dtype=bool)
    keep[1:] |= same
    keep[:-1] |= same
    v, c = v[keep], c[keep]
    far = c >= ONE_END
    src = v ^ MASKS[c]
    order = np.lexsort((src, far, v))
    v, far, src = v[order], far[order], src[order]
    if not len(v):
        return src, src
    head = np.concatenate([[True], v[1:] != v[:-1]])
    at = np.maximum.accumulate(np.where(head, np.arange(len(v)), 0))
    hub = src[at]
    good = ~far[at] & (hub != src) & (_popcount(hub ^ src) <= RADIUS)
    a, b = hub[good], src[good]
    return np.minimum(a, b), np.maximum(a, b)


def links(nodes: DataFrame, n_nodes: int) -> DataFrame:
    """(a, b) links that connect exactly the fingerprints that chains of distances <= 3 connect; nodes: distinct ``fp``."""
    spark = nodes.sparkSession
    buckets = max(1, min(1 << 30, -(-n_nodes * (ONE_END + TWO_END) // 2 * 10 // BUCKET_BYTES)))
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def meet(t: pa.Table) -> pa.Table:
        v, c = (np.frombuffer(b"".join(t.column(k).to_pylist()), kind) for k, kind in (("variants", np.uint64), ("codes", np.uint16)))
        a, b = meetings(v, c)
        return pa.table([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=out)

    small_batches(spark)
    # a fingerprint becomes some 560 variants: tasks are dealt by what they will write, not by what they read
    dealt = nodes.select("fp").repartition(max(1, min(MOST_TASKS, n_nodes // EMIT_ROWS)))
    emitted = dealt.mapInArrow(_emit(buckets), "bucket int, variants binary, codes binary")
    return emitted.groupBy("bucket").applyInArrow(meet, "a long, b long").distinct()


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of one partition, batch by batch, as (node, least node that it reaches within the batch)."""
    out = pa.schema([("node", pa.int64()), ("root", pa.int64())])
    for b in batches:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while parent.setdefault(root, root) != root:
                root = parent[root]
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        nodes = list(parent)
        yield batch(out, nodes, [find(x) for x in nodes])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge: root is the least node that it reaches.

    Alternating large-star and small-star rounds (each a few equi-joins and
    grouped minima, hot hubs pre-aggregated before the shuffle) after a
    contraction within batches; every round is written to the shared folder.
    """
    edges = written(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").mapInArrow(_stars, "node long, root long").where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")).distinct(), "edges")

    def stamp(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v") % 1000003)).first())

    last = stamp(edges)
    while last[0]:
        # large star: each node's larger neighbours join its least neighbour
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: its smaller neighbours and itself join the least of them; u > v in all rows here
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        edges = written(small, "edges")
        now = stamp(edges)
        if now == last:
            break
        last = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable)."""
    rows = written(with_fingerprints(docs, id_col, text_col, width), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    found = components(links(nodes, nodes.count()))
    return grouped(rows, nodes, found).select("doc_id", hex_of("fp").alias("fingerprint"), "component_id")


def grouped(rows: DataFrame, nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for each of ``rows``; nodes: (fp, least), found: (node, root) of ``components``."""
    roots = nodes.join(found, nodes.fp == found.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # only the fingerprints that have links need the least id of a component
    linked = found.select("node", "root").union(found.select(F.col("root").alias("node"), "root").distinct())
    named = linked.join(nodes, linked.node == nodes.fp).groupBy("root").agg(F.min("least").alias("component"))
    ids = roots.join(named, "root", "left").select("fp", F.coalesce("component", "least").alias("component_id"))
    return rows.join(ids, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id names their component: one document of each group.

    Rows without an id stay: nothing names them.  Of rows that repeat an id one stays.
    """
    return heads_of(docs, near_duplicates(docs, id_col, text_col), id_col)


def heads_of(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id names their component in ``groups`` (doc_id, component_id), and those without an id.

    Most ids stay, so a Bloom filter holds the others and those that repeat: a row that it stops stays where it is,
    and only rows that it lets through are joined.  It has at most 6 MB; past its size it lets more rows through.
    """
    named = groups.where("doc_id is not null").groupBy("doc_id")
    ids = written(named.agg(F.max(F.expr("doc_id = component_id")).alias("head"), F.count(F.lit(1)).alias("n")), "ids")
    unsure = ids.where("not head or n > 1").select(F.col("doc_id").alias("k"))
    level = urls.filter_of(unsure, min(unsure.count(), urls.FILTER_KEYS), 0, urls.BITS_PER_KEY)

    @F.arrow_udf("boolean")
    def through(key: pa.Array) -> pa.Array:
        return pa.array(urls.accepts(level, key.to_numpy(zero_copy_only=False).view(np.uint64), 0))

    own = docs[id_col]
    passes = through(F.coalesce(own.cast("long"), F.lit(0).cast("long")))
    heads = ids.where("head").select(F.col("doc_id").alias("_head"), F.col("n").alias("_n"))
    found = docs.where(own.isNotNull() & passes).join(heads, own == heads["_head"])
    columns = [docs[c] for c in docs.columns]
    single = found.where(heads["_n"] == 1).select(columns)
    repeated = found.where(heads["_n"] > 1).select(columns).dropDuplicates([id_col])
    return docs.where(own.isNull() | ~passes).unionByName(single).unionByName(repeated)
