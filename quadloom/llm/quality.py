"""Quality rules: fixed rules, and a calibrated logistic regression over hashed n-grams.

Features are hashed: words and word pairs, and character trigrams (bytes), each
counted relative to their number in the text.  The regression is trained on
labelled rows, at most ``TRAIN_ROWS`` of each label (those whose id hashes
least) whose whole texts have ``TRAIN_BYTES`` in all, on the driver; a held-out
quarter calibrates its probabilities by Platt's method.  Texts are scored in Arrow batches by table look-ups; a text is
kept if the fixed rules pass it and its probability of good quality is at least
``THRESHOLD``.

Words are ``[^\\x20\\x09-\\x0D]+``.  Null texts have no words, so the rules fail them;
repeated rows give repeated results; without labelled rows of both kinds the
model passes everything.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.llm import bytesvec as bv
from quadloom.llm.common import batch, pick, small_batches, sparse, whole_texts

WINDOW, MIN_WORDS, MAX_REPEATED = 5, 10, 20
SYMBOLS = b"#*$%&|<>"
TRAIN_ROWS = 1500
THRESHOLD = 0.5
BITS = 15
#: Bytes of all training texts together; a row whose text would pass the bound is not in the sample.
TRAIN_BYTES = 64 << 20

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[*SYMBOLS]] = True


def _inside(grams: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Only the n-grams of ``width`` that end in the text where they begin, and each text's range of them."""
    counts = np.maximum(0, np.diff(bounds) - width + 1)
    ranges = np.zeros(len(bounds), dtype=np.int64)
    np.cumsum(counts, out=ranges[1:])
    return grams[np.repeat(bounds[:-1] - ranges[:-1], counts) + np.arange(ranges[-1])], ranges


def features(buf: np.ndarray, offsets: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], tuple]:
    """For each kind of n-gram the hashed features and each text's range of them; and words with their hashes."""
    starts, ends, first = bv.space_words(buf, offsets)
    hashes = bv.span_hash(bv.prefix_sums(buf), starts, ends) if len(buf) else np.zeros(0, np.uint64)
    shift = np.uint64(64 - BITS)
    kinds = [((hashes >> shift).astype(np.int32), first)]
    pairs = bv.mix64(hashes[:-1] * np.uint64(3) + hashes[1:]) >> shift if len(hashes) > 1 else np.zeros(0, np.uint64)
    kinds.append(_inside(pairs.astype(np.int32) + (1 << BITS), first, 2))
    raw = buf.astype(np.uint32)
    grams = (raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]) if len(raw) > 2 else np.zeros(0, np.uint32)
    grams = (grams * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)).astype(np.int32) + (2 << BITS)
    kinds.append(_inside(grams, offsets, 3))
    return kinds, (starts, ends, first, hashes)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def probabilities(self, kinds: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The calibrated probability of good quality of each text."""
        score = np.full(len(kinds[0][1]) - 1, self.bias)
        for feature, ranges in kinds:
            owner = np.repeat(np.arange(len(score)), np.diff(ranges))  # summed text by text, so neighbours do not change rounding either
            score += np.bincount(owner, self.weights[feature], len(score)) / np.maximum(1, np.diff(ranges))
        return 1 / (1 + np.exp(-np.clip(self.slope * score + self.shift, -500, 500)))


def _matrix(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of all training texts."""
    rows, columns, values = [], [], []
    for k, text in enumerate(texts):
        buf = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        for feature, ranges in features(buf, np.array([0, len(buf)]))[0]:
            n = ranges[1] - ranges[0]
            each, count = np.unique(feature[: n], return_counts=True)
            rows.append(np.full(len(each), k))
            columns.append(each)
            values.append(count / max(1, n))
    return np.concatenate(rows), np.concatenate(columns), np.concatenate(values)


def fit(texts: list[str], labels: list[int], epochs: int = 60) -> Model:
    """Logistic regression by Adagrad with balanced classes on three quarters of the rows; Platt's calibration on the others."""
    y = np.array(labels, dtype=float)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(3 << BITS, np.float32), 0.0, 0.0, 20.0)
    row, column, value = _matrix(texts)
    held = np.arange(len(y)) % 4 == 3
    train = ~held if len(set(y[held])) == 2 and len(set(y[~held])) == 2 else np.ones(len(y), bool)
    held = held if train.sum() < len(y) else train
    balance = np.where(y == 1, 0.5 / max(1, (y[train] == 1).sum()), 0.5 / max(1, (y[train] == 0).sum())) * train
    w, b = np.zeros(3 << BITS), 0.0
    scale = np.full(3 << BITS, 1e-12)
    scale_b = 1e-12
    for _ in range(epochs):
        score = np.bincount(row, value * w[column], len(y)) + b
        error = (1 / (1 + np.exp(-np.clip(score, -500, 500))) - y) * balance
        gradient = np.bincount(column, value * error[row], 3 << BITS) + 1e-7 * w
        scale += gradient**2
        w -= 2.0 * gradient / np.sqrt(scale) * (np.abs(gradient) > 0)
        scale_b += error.sum() ** 2
        b -= 0.1 * error.sum() / np.sqrt(scale_b)
    score = np.bincount(row, value * w[column], len(y)) + b
    s, t = score[held], y[held]
    spread = max(1e-9, float(np.std(s)))
    slope, shift = 1.0 / spread, 0.0
    target = np.where(t == 1, ((t == 1).sum() + 1) / ((t == 1).sum() + 2), 1 / ((t == 0).sum() + 2))
    for _ in range(60):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(slope * s + shift, -500, 500)))
        g = np.array([((p - target) * s).sum(), (p - target).sum()])
        r = p * (1 - p)
        hessian = np.array([[(r * s * s).sum(), (r * s).sum()], [(r * s).sum(), r.sum()]]) + 1e-6 * np.eye(2) * len(s)
        step = np.linalg.solve(hessian, g)
        slope, shift = slope - step[0], shift - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return Model(w.astype(np.float32), float(b), float(slope), float(shift))


def model_from(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> Model:
    """Fit on at most ``most`` labelled documents of each label, those whose id hashes least, with at most ``most_bytes`` of text.

    A label given twice counts as the greater one, and of the texts of a repeated id the least is used.
    """
    chosen = None
    marks = pick(labels, id=id_col, y=label_col).where("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    sizes = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    for y in (0, 1):
        own = sparse(marks.where(F.col("y") == y), F.col("id"), most, sizes.get(y, 0))
        some = own.withColumn("k", F.xxhash64("id", F.lit("sample"))).orderBy("k", "id").limit(most)
        chosen = some if chosen is None else chosen.union(some)
    picked = {r["id"]: r["y"] for r in chosen.collect()}
    if not picked:
        return fit([], [])
    # the bounded sample of ids (at most 2 x most) goes to the scan, so the documents are not shuffled
    # as an Arrow table: a list would start Python workers of its own beside those of the operators, which stay
    sample = docs.sparkSession.createDataFrame(pa.table({"id": pa.array(list(picked), pa.int64())}))
    texts = pick(docs, id=id_col, text=text_col).join(F.broadcast(sample), "id", "left_semi")
    texts = texts.groupBy("id").agg(F.min("text").alias("text")).withColumn("k", F.xxhash64("id", F.lit("order")))
    rows = whole_texts(texts, most_bytes)
    return fit([t for _, t in rows], [picked[i] for i, _ in rows])


def rule_counts(buf: np.ndarray, offsets: np.ndarray, words: tuple) -> tuple[np.ndarray, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    starts, ends, first, hashes = words
    n = len(offsets) - 1
    heads = np.zeros(len(buf) + 1, dtype=np.int64)
    np.cumsum(((buf & 0xC0) != 0x80) & ~bv._SPACE[buf], out=heads[1:])
    symbols = np.zeros(len(buf) + 1, dtype=np.int64)
    np.cumsum(_SYMBOL[buf], out=symbols[1:])
    n_words = np.diff(first)

    # lines: cut at \n and at the bounds of texts
    line_starts, line_ends = bv.spans_of(buf != 0x0A, offsets)
    owner = np.searchsorted(offsets, line_starts, "right") - 1
    filled = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends, owner = line_starts[filled], line_ends[filled], owner[filled]
    key = bv.mix64((bv.span_hash(bv.prefix_sums(buf), line_starts, line_ends) if len(buf) else np.zeros(0, np.uint64)) + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    distinct_lines = np.unique(key, return_index=True)[1]
    dup_lines = np.bincount(owner, minlength=n) - np.bincount(owner[distinct_lines], minlength=n)

    # windows of words that occur twice in their text
    repeated = np.zeros(n, dtype=np.int64)
    count = len(hashes) - WINDOW + 1
    if count > 0:
        text = np.repeat(np.arange(n), n_words)
        whole = np.flatnonzero(text[:count] == text[WINDOW - 1 :])
        window = bv.fold([hashes[k : k + count] for k in range(WINDOW)])[whole]
        window = bv.mix64(window + text[whole].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        ordered = np.sort(window)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if len(twice):
            spot = np.minimum(np.searchsorted(twice, window), len(twice) - 1)
            at = whole[twice[spot] == window]
            covered = np.zeros(len(hashes) + 1, dtype=np.int64)
            np.add.at(covered, at, 1)
            np.add.at(covered, at + WINDOW, -1)
            repeated = np.bincount(text[np.cumsum(covered[:-1]) > 0], minlength=n)
    return n_words, heads[offsets[1:]] - heads[offsets[:-1]], symbols[offsets[1:]] - symbols[offsets[:-1]], dup_lines, repeated


def _failed(n_words: np.ndarray, repeated: np.ndarray) -> np.ndarray:
    return (n_words < MIN_WORDS) | (100 * repeated > MAX_REPEATED * n_words)


def judged(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of ``docs``: doc_id, the five counts, base_failed, probability, kept."""
    small_batches(docs.sparkSession)
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    out = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in counts), ("base_failed", pa.bool_()), ("probability", pa.float64()), ("kept", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, buf, offsets in bv.chunks(b, "text"):
                kinds, words = features(buf, offsets)
                found = rule_counts(buf, offsets, words)
                failed = _failed(found[0], found[4])
                probability = model.probabilities(kinds)
                yield batch(out, rows.column(0).cast(pa.int64()), *found, failed, probability, ~failed & (probability >= threshold))

    columns = ", ".join(f"{c} long" for c in counts)
    return pick(docs, doc_id=id_col, text=text_col).mapInArrow(run, f"doc_id long, {columns}, base_failed boolean, probability double, kept boolean")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the rules and the model keep, all columns as they are."""
    small_batches(docs.sparkSession)
    position = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = list(b.schema.names)
            inner = b.rename_columns([f"c{k}" if k != position else "text" for k in range(len(names))])
            for rows, buf, offsets in bv.chunks(inner, "text"):
                kinds, words = features(buf, offsets)
                found = rule_counts(buf, offsets, words)
                good = ~_failed(found[0], found[4]) & (model.probabilities(kinds) >= threshold)
                yield rows.filter(pa.array(good)).rename_columns(names)

    return docs.mapInArrow(run, docs.schema)
