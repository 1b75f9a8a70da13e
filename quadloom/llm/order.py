"""Training order on disk: a keyed permutation gives every sequence its global slot.

Texts become token ids (a byte-level BPE vocabulary, 16-bit ids) and are cut
into sequences of ``LENGTH`` ids, the last one of a text filled up with the
padding id.  The n sequences get dense numbers; a keyed Feistel network over
the least even number of bits that holds n, walked along its cycle until it
lands under n, permutes them.  The slot decides everything else: shard
``slot // SHARD``, record ``slot % SHARD``, byte ``record * stride``.  So a
reader can begin or resume at any slot with one seek, and the order for a new
epoch needs a new key only.

A record is 16 bytes of header (doc_id, sequence number in its text, ids used;
little-endian) and the ids.  Shards are binary files of records, each closed by
one byte, ``\\n``: Spark's text writer puts it there, and commits files so that a
lost executor leaves no half of one.  The stride counts it.  Texts without tokens (null, empty) make no
sequence; null ids are written as the least long; repeated rows are sequences of their own.  Special strings
inside texts are text like any other.  Ids of documents are integers that fit a long; a vocabulary with ids
over 65,535 is refused, since a record has 16 bits for each.

Sequences are numbered by the task that reads them and their place in it, for which the number in each task
is counted first.  Both passes must see the same rows in the same order: the documents are written to the
shared folder first, unless the caller says that they are ``stable`` (read from files that do not change).  A
task whose second pass finds another number than its first fails.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.llm import bytesvec as bv
from quadloom.llm import pretokens
from quadloom.llm.common import batch, pick, small_batches, written
from quadloom.llm.counts import ByteVocabulary

LENGTH = 512
SHARD = 8192
HEADER = 16
ROUNDS = 6
#: Partitions of the shuffle at most; with more shards each partition has a run of whole ones, sorted by spilling.
MOST_PARTITIONS = 20_000
#: Records that are made at once.
BATCH = 4096
_NULL_ID = -(1 << 63)


def stride(length: int = LENGTH) -> int:
    """Bytes from one record of a shard to the next."""
    return HEADER + 2 * length + 1


def round_keys(key: str) -> np.ndarray:
    raw = b"".join(hashlib.sha256(f"{key}/{r}".encode()).digest()[:8] for r in range(ROUNDS))
    return np.frombuffer(raw, "<u8")


def permuted(index: np.ndarray, n: int, key: str) -> np.ndarray:
    """The slots of ``index`` (any of 0 .. n - 1): a bijection of that range, another for each key."""
    half = max(1, -(-max(n - 1, 1).bit_length() // 2))
    low, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = round_keys(key)
    out = index.astype(np.uint64)
    live = np.arange(len(out))
    while len(live):
        left, right = out[live] >> shift, out[live] & low
        for k in keys:
            left, right = right, left ^ (bv.mix64(right * np.uint64(0x9E3779B97F4A7C15) + k) >> np.uint64(20) & low)
        out[live] = left << shift | right
        live = live[out[live] >= n]
    return out.astype(np.int64)


def chunk_ids(vocabulary: ByteVocabulary, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each piece of a chunk where its ids begin in ``vocabulary.short``, and the number of ids before it; for each text the number of ids."""
    text, points, bounds = pretokens.code_points(buf, offsets)
    starts, ends = pretokens.spans_gpt(points, bounds)
    begin, size = vocabulary.short.lookup(pretokens.span_hashes(points, starts, ends), text, starts, ends, vocabulary.short_pieces)
    before = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(size, out=before[1:])
    return begin, before, np.diff(before[np.searchsorted(starts, bounds)])


def chunk_sequences(vocabulary: ByteVocabulary, doc_ids: pa.Array, buf: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, pa.Array]]:
    """(doc_id, part, n_tokens, record) of the sequences of a chunk, ``BATCH`` at a time."""
    begin, before, tokens = chunk_ids(vocabulary, buf, offsets)
    ids = vocabulary.short.ids[np.repeat(begin - before[:-1], np.diff(before)) + np.arange(before[-1])]
    each = -(-tokens // length)
    owner = np.repeat(np.arange(len(tokens)), each)
    part = np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)
    used = np.minimum(length, tokens[owner] - part * length)
    first = np.cumsum(used) - used
    named = pc.fill_null(doc_ids, _NULL_ID).to_numpy(zero_copy_only=False)
    for at in range(0, len(owner), BATCH):
        some = slice(at, at + BATCH)
        n = len(owner[some])
        records = np.zeros((n, HEADER // 2 + length), dtype="<u2")
        head = np.stack([named[owner[some]], part[some] | used[some] << 32], axis=1).astype("<i8")
        records[:, : HEADER // 2] = head.view("<u2")
        records[:, HEADER // 2 :][np.arange(length) < used[some, None]] = ids[first[at] : first[at] + used[some].sum()]
        ends = pa.array(np.arange(n + 1, dtype=np.int32) * np.int32(records.itemsize * records.shape[1]))
        yield doc_ids.take(pa.array(owner[some])), part[some].astype(np.int32), used[some].astype(np.int32), pa.Array.from_buffers(pa.binary(), n, [None, ends.buffers()[1], pa.py_buffer(records)])


def counted(texts: DataFrame, vocabulary_path: str, length: int) -> DataFrame:
    """(src, n): the number of sequences that each task makes of its rows (doc_id, text)."""
    out = pa.schema([("src", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = ByteVocabulary.load(vocabulary_path)
        n = 0
        for b in batches:
            for _, buf, offsets in bv.chunks(b, "text"):
                n += int((-(-chunk_ids(vocabulary, buf, offsets)[2] // length)).sum())
        yield batch(out, [TaskContext.get().partitionId()], [n])

    return texts.mapInArrow(run, "src int, n long")


def training_order(docs: DataFrame, vocabulary_path: str, key: str, length: int = LENGTH, shard: int = SHARD, id_col: str = "doc_id", text_col: str = "text", most_partitions: int = MOST_PARTITIONS, stable: bool = False) -> DataFrame:
    """One row for each sequence: slot, shard, byte_offset, doc_id, part, n_tokens, record; a partition is a shard, or a run of shards if there are over ``most_partitions``, in slot order."""
    small_batches(docs.sparkSession)
    texts = pick(docs, doc_id=id_col, text=text_col)
    texts = texts if stable else written(texts, "texts")
    # one row for each task that reads the input, not for each sequence
    sizes = {r["src"]: r["n"] for r in counted(texts, vocabulary_path, length).collect()}
    number = np.zeros(max(sizes, default=0) + 1, dtype=np.int64)
    for src, size in sizes.items():
        number[src] = size
    base = np.cumsum(number) - number
    n = int(number.sum())
    out = pa.schema([("slot", pa.int64()), ("doc_id", pa.int64()), ("part", pa.int32()), ("n_tokens", pa.int32()), ("record", pa.binary())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = ByteVocabulary.load(vocabulary_path)
        src, pos = TaskContext.get().partitionId(), 0
        most = int(number[src]) if src < len(number) else 0
        for b in batches:
            for rows, buf, offsets in bv.chunks(b, "text"):
                for made in chunk_sequences(vocabulary, rows.column(0).cast(pa.int64()), buf, offsets, length):
                    n_made = len(made[0])
                    if pos + n_made <= most:
                        yield batch(out, permuted(base[src] + np.arange(pos, pos + n_made), n, key), *made)
                    pos += n_made
        if pos != most:
            raise RuntimeError(f"the input changed between its two passes: {pos} sequences, {most} before; write it to a table first")

    placed = texts.mapInArrow(place, "slot long, doc_id long, part int, n_tokens int, record binary")
    shards = max(1, -(-n // shard))
    run = -(-shards // most_partitions)
    rows = placed.withColumn("shard", F.floor(F.col("slot") / shard).cast("int"))
    ordered = rows.repartitionById(-(-shards // run), F.floor(F.col("shard") / run).cast("int")).sortWithinPartitions("shard", "slot")
    return ordered.select("slot", "shard", (F.col("slot") % shard * stride(length)).alias("byte_offset"), "doc_id", "part", "n_tokens", "record")


def write_shards(ordered: DataFrame, path: str) -> None:
    """Shards as binary files ``path/shard=<n>/part-*``, one each: nothing but records of one stride, in slot order."""
    ordered.select("shard", F.col("record").cast("string").alias("value")).write.partitionBy("shard").option("lineSep", "\n").option("compression", "none").text(path)


def _opened(length: int, shard: int):
    """Shard files (shard, content) as rows of ``training_order``, some records at a time."""
    out = pa.schema([("slot", pa.int64()), ("doc_id", pa.int64()), ("part", pa.int32()), ("n_tokens", pa.int32()), ("record", pa.binary())])
    size = stride(length) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, content in zip(b.column(0).to_pylist(), b.column(1)):
                whole = np.frombuffer(content.as_buffer(), np.uint8).reshape(-1, size + 1)
                for at in range(0, len(whole), 1024):
                    some = np.ascontiguousarray(whole[at : at + 1024, :size])
                    head = np.ascontiguousarray(some[:, :HEADER]).view("<i8")
                    ends = pa.array(np.arange(len(some) + 1, dtype=np.int32) * np.int32(size))
                    record = pa.Array.from_buffers(pa.binary(), len(some), [None, ends.buffers()[1], pa.py_buffer(some)])
                    doc_id = pa.array(head[:, 0], mask=head[:, 0] == _NULL_ID)
                    yield batch(out, number * shard + np.arange(at, at + len(some)), doc_id, (head[:, 1] & 0xFFFFFFFF).astype(np.int32), (head[:, 1] >> 32).astype(np.int32), record)

    return run


def read_back(spark: SparkSession, path: str, length: int = LENGTH, shard: int = SHARD, slot: int = 0) -> DataFrame:
    """The rows of ``training_order`` from ``slot`` on, as the shards say them, in no order between shards; earlier shards are not opened."""
    small_batches(spark)
    files = spark.read.format("binaryFile").load(path)
    schema = "slot long, doc_id long, part int, n_tokens int, record binary"
    if "shard" not in files.columns:  # no text had a token
        rows = spark.createDataFrame([], schema)
    else:
        rows = files.where(F.col("shard") >= slot // shard).select("shard", "content").mapInArrow(_opened(length, shard), schema).where(F.col("slot") >= slot)
    return rows.select("slot", F.floor(F.col("slot") / shard).cast("int").alias("shard"), (F.col("slot") % shard * stride(length)).alias("byte_offset"), "doc_id", "part", "n_tokens", "record")


def read_from(spark: SparkSession, path: str, slot: int, length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """(slot, record) from ``slot`` on, in order."""
    return read_back(spark, path, length, shard, slot).select("slot", "record").orderBy("slot")


def ids_of(record: bytes) -> np.ndarray:
    """The ids of a record, padding left out."""
    used = int(np.frombuffer(record[8:16], "<i8")[0]) >> 32
    return np.frombuffer(record[HEADER : HEADER + 2 * used], "<u2")
