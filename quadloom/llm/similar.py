"""Near-duplicates by similarity: SimHash balls and MinHash bands find candidates, exact similarity of shingle sets decides.

Two texts are near-duplicates if their sets of five-word shingles have a
similarity (common over all) of ``SIMILARITY`` = 0.8 or more; chains of such
pairs make a group.  Words and shingle hashes are those of ``simhash``.

Texts with equal sets are one node.  Its fingerprint is the SimHash of its set,
and fingerprints at 3 or fewer differing bits are found by the balls of
``simhash``; the least node of a fingerprint stands for it there and is a
candidate for its other nodes.  At similarity 0.8 fingerprints differ in about
10 bits, so balls alone would miss most pairs.  Therefore a node also has
``BANDS`` keys, each of ``ROWS`` minima; two nodes of similarity s meet in a
band with probability s**ROWS, so a pair that is just at 0.8 is missed about
three times in a million.  Candidates of both kinds pass the same exact check.

Members of a bucket (the nodes with one key) are first compared with its least
member.  Buckets whose members are then not all in one component are cut into
blocks of about ``BLOCK`` members; each pair of blocks goes to a task, which
compares all its pairs that are not connected yet and returns only links that
connect.  So no pair that meets is left out, and a large group lists no pairs.

Null texts are empty; texts without words are one group; repeated rows
give repeated results; null ids never name a component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.llm import bytesvec as bv
from quadloom.llm import urls
from quadloom.llm.common import batch, null_safe_id, pick, small_batches, written
from quadloom.llm.simhash import components, grouped, heads_of, links, shingle_hashes

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 4
#: Members of a block of a bucket that is compared pair by pair.
BLOCK = 256

_RANDOM = np.random.default_rng(20240117)
_XOR = _RANDOM.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_ODD = _RANDOM.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text of a chunk in order, and for each text the range of its own."""
    hashes, bounds = shingle_hashes(buf, offsets, width)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    keep = np.ones(len(hashes), dtype=bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[keep], owner[keep]
    return hashes, np.searchsorted(owner, np.arange(len(offsets)))


def nodes_of(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each set."""
    sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(bv.mix64(hashes), out=sums[1:])
    return bv.mix64(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(np.uint64))


def keys_of(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts that have shingles, and a row of ``BANDS`` keys for each of them."""
    filled = np.flatnonzero(np.diff(bounds))
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    least = [np.minimum.reduceat((short ^ x) * a, bounds[filled]).astype(np.uint64) if len(filled) else np.zeros(0, np.uint64) for x, a in zip(_XOR, _ODD)]
    keys = [bv.fold([*least[ROWS * k : ROWS * (k + 1)], np.full(len(filled), k, np.uint64)]) for k in range(BANDS)]
    return filled, np.stack(keys, axis=1).view(np.int64)


def with_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, fp, n, print, keys): fp names the text's set of n shingles, print is its SimHash."""
    small_batches(docs.sparkSession)
    out = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("n", pa.int64()), ("print", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, buf, offsets in bv.chunks(b, "text"):
                hashes, bounds = shingle_sets(buf, offsets)
                filled, keys = keys_of(hashes, bounds)
                counts = np.zeros(len(offsets), dtype=np.int32)
                counts[filled + 1] = BANDS
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(counts, dtype=np.int32)), pa.array(keys.ravel()))
                yield batch(out, rows.column(0).cast(pa.int64()), nodes_of(hashes, bounds).view(np.int64), np.diff(bounds), bv.majority(hashes, bounds).view(np.int64), lists)

    return pick(docs, doc_id=id_col, text=text_col).mapInArrow(run, "doc_id long, fp long, n long, print long, keys array<long>")


def met_in_balls(nodes: DataFrame) -> DataFrame:
    """(a, b), a < b: candidates whose fingerprints are equal or meet in balls; nodes: (fp, n, print)."""
    filled = nodes.where("n > 0").select("fp", "print")
    prints = written(filled.groupBy("print").agg(F.min("fp").alias("node")), "prints")
    own, other = (prints.toDF(x, f"node_{x}") for x in "ab")
    between = links(prints.select(F.col("print").alias("fp")), prints.count()).join(own, "a").join(other, "b").select("node_a", "node_b")
    within = filled.join(prints, "print").where("fp <> node").select("node", "fp")
    return between.union(within).select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))


def _with_nodes(docs: DataFrame, id_col: str, text_col: str, wanted: urls.Level) -> DataFrame:
    """(node, text) of the rows whose node and id the Bloom filter ``wanted`` lets through, in a chunk each node once."""
    small_batches(docs.sparkSession)
    out = pa.schema([("node", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, buf, offsets in bv.chunks(b, "text"):
                nodes = nodes_of(*shingle_sets(buf, offsets)).view(np.int64)
                ids = rows.column(0).to_numpy(zero_copy_only=False)
                through = np.flatnonzero(urls.accepts(wanted, (nodes ^ ids).view(np.uint64), 0))
                through = through[np.unique(nodes[through], return_index=True)[1]]
                yield batch(out, nodes[through], rows.column(1).take(pa.array(through)).cast(pa.string()))

    rows = pick(docs, doc_id=id_col, text=text_col).select(null_safe_id("doc_id").alias("id"), "text")
    return rows.mapInArrow(run, "node long, text string")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, n, text) as (node, n, shingles): the set's hashes in order."""
    out = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("shingles", pa.binary())])
    for b in batches:
        for rows, buf, offsets in bv.chunks(b, "text"):
            hashes, bounds = shingle_sets(buf, offsets)
            yield batch(out, rows.column(0), rows.column(1), [hashes[i:j].tobytes() for i, j in zip(bounds[:-1], bounds[1:])])


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, shingles of a, shingles of b) the (a, b) that are near-duplicates."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for rows in batches:
        good = np.zeros(rows.num_rows, dtype=bool)
        for k, (x, y) in enumerate(zip(rows.column(2), rows.column(3))):
            x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
            common = len(np.intersect1d(x, y, assume_unique=True))
            good[k] = common >= SIMILARITY * (len(x) + len(y) - common)
        yield batch(out, rows.column(0).filter(pa.array(good)), rows.column(1).filter(pa.array(good)))


def connecting(root: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Near-duplicate pairs that connect members of a block; root: the component of each so far."""
    root = root.copy()
    size = np.array([len(s) for s in sets])
    first = np.cumsum(size) - size
    every, place = np.unique(np.concatenate(sets), return_inverse=True)
    found = []
    for k in range(len(sets)):
        if (root == root[k]).all():
            break
        own = np.zeros(len(every), dtype=np.int64)
        own[place[first[k] : first[k] + size[k]]] = 1
        common = np.add.reduceat(own[place], first)
        for j in np.flatnonzero((common >= SIMILARITY * (size + size[k] - common)) & (root != root[k])).tolist():
            if root[j] != root[k]:
                found.append((k, j))
                root[root == root[j]] = root[k]
    return found


def _compared(t: pa.Table) -> pa.Table:
    node = t.column("node").to_numpy()
    links = connecting(t.column("node_root").to_numpy(), [np.frombuffer(s.as_buffer(), np.uint64) for s in t.column("shingles")])
    return pa.table({"a": pa.array([node[k] for k, _ in links], pa.int64()), "b": pa.array([node[j] for _, j in links], pa.int64())})


def found_in(members: DataFrame, sets: DataFrame, block: int = BLOCK, met: DataFrame | None = None) -> DataFrame:
    """(node, root) for every node that has links; members: (key, node) of buckets with more than one node, sets: (node, n, shingles), met: more candidates (a, b), a < b."""
    small_batches(members.sparkSession)
    hubs = members.groupBy("key").agg(F.min("node").alias("hub"))
    stars = members.join(hubs, "key").where("node <> hub")
    pairs = stars.select(F.col("hub").alias("a"), F.col("node").alias("b"))
    pairs = (pairs if met is None else pairs.union(met)).distinct()
    own, other = (sets.toDF(x, f"n_{x}", f"shingles_{x}") for x in "ab")
    both = pairs.join(own, "a").join(other, "b").where(f"least(n_a, n_b) >= {SIMILARITY} * greatest(n_a, n_b)")
    near = written(both.select("a", "b", "shingles_a", "shingles_b").mapInArrow(_similar, "a long, b long"), "links")
    roots = components(near)
    # a hub has been compared with all members of its bucket
    rest = stars.select("key", "node").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("node_root"))
    parts = rest.groupBy("key").agg(F.min("node_root").alias("lo"), F.max("node_root").alias("hi"), F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts")).where("lo < hi").select("key", "parts")
    placed = written(rest.join(parts, "key").withColumn("part", F.expr("cast(pmod(xxhash64(node), parts) as int)")), "placed")
    if placed.isEmpty():
        return roots
    dealt = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("key", "node", "node_root", F.least("part", "with").alias("x"), F.greatest("part", "with").alias("y"))
    more = dealt.join(sets.select("node", "shingles"), "node").groupBy("key", "x", "y").applyInArrow(_compared, "a long, b long").distinct()
    return components(near.union(more))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row for each row of ``docs``: doc_id, component_id (least doc_id reachable)."""
    rows = written(with_keys(docs, id_col, text_col), "keys")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("print").alias("print"), F.first("keys").alias("keys")), "nodes")
    met = written(met_in_balls(nodes), "met")
    every = nodes.select(F.explode("keys").alias("key"), F.col("fp").alias("node"))
    shared = every.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    members = written(every.join(shared, "key"), "members")
    partners = members.select(F.col("node").alias("fp")).union(met.select("a")).union(met.select("b")).distinct()
    wanted = nodes.join(partners, "fp").select(F.col("fp").alias("node"), "n", null_safe_id("least").alias("id"))
    wanted = written(wanted, "wanted")
    # a filter of at most 6 MB, so that of each text with a partner one row travels; past its size it lets more rows through
    keys = wanted.select(F.expr("node ^ id").alias("k"))
    through = urls.filter_of(keys, min(keys.count(), urls.FILTER_KEYS), 0, urls.BITS_PER_KEY)
    # tasks leave out repeated nodes before the shuffle, which serves the join too
    found = _with_nodes(docs, id_col, text_col, through).dropDuplicates(["node"])
    texts = found.join(wanted.select("node", "n"), "node").select("node", "n", "text")
    sets = written(texts.mapInArrow(_sets, "node long, n long, shingles binary"), "sets")
    return grouped(rows.select("doc_id", "fp"), nodes.select("fp", "least"), found_in(members, sets, block, met)).select("doc_id", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id names their component: one document of each group.

    Rows without an id stay: nothing names them.  Of rows that repeat an id one stays.
    """
    return heads_of(docs, near_duplicates(docs, id_col, text_col), id_col)
