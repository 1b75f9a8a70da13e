"""BPE encoding and decoding by forced boundaries, for a vocabulary with word ends.

Two neighbouring bytes that stand side by side in no token can never be merged,
nor can anything across them, so a cut there is certain.  Every text is cut at
all such pairs (and where the vocabulary's pattern separates words); each
distinct fragment is encoded once on its own, by merges in rank order, and the
results are concatenated.  Only a fragment at the end of a word gets the
word-end mark.

The normaliser is NFC, white space to one space, lower case letter by letter.
Texts with special strings go piece by piece between them.  Null texts are
empty: no ids, an empty decoded text.  Repeated rows give repeated results.

``encode`` remembers the ids of fragments in arrays, some 30 bytes for each,
since a worker outlives its task and keeps what it knows; decimal ids and
tokens as bytes are made only where digests need them.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quadloom.llm import bytesvec as bv
from quadloom.llm import pretokens
from quadloom.llm.common import batch, pick, small_batches
from quadloom.llm.counts import byte_letters

#: Distinct fragments that one Python worker remembers.
FRAGMENTS = 250_000
_WORD_END = np.uint64(0xA24BAED4963EE407)


def normalised(text: str) -> str:
    """NFC, then lower case letter by letter (a final sigma is no exception); white space only separates, so it stays as it is."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


class KnownIds:
    """The ids of distinct fragments: hashes in order, the row of each, and for each row the range of its ids."""

    def __init__(self) -> None:
        self.hashes, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.bounds, self.ids = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def rows_of(self, hashes: np.ndarray) -> np.ndarray:
        """The row of each hash, -1 for one that is not known."""
        if not len(self.hashes):
            return np.full(len(hashes), -1, dtype=np.int64)
        spot = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[spot] == hashes, self.rows[spot], -1).astype(np.int64)

    def add(self, hashes: np.ndarray, ids: list[list[int]]) -> np.ndarray:
        """Rows for hashes in order, none of them known."""
        rows = np.arange(len(self.rows), len(self.rows) + len(hashes))
        at = np.searchsorted(self.hashes, hashes)
        self.hashes, self.rows = np.insert(self.hashes, at, hashes), np.insert(self.rows, at, rows)
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum([len(x) for x in ids], dtype=np.int64)])
        self.ids = np.concatenate([self.ids, np.array([i for x in ids for i in x], dtype=np.int32)])
        return rows


class WordVocabulary:
    """A BPE vocabulary whose tokens at word ends carry a mark."""

    _loaded: dict[str, "WordVocabulary"] = {}

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or spec["post_processor"] or spec["decoder"]:
            raise ValueError(f"{path}: a BPE vocabulary with word ends and neither post-processor nor decoder is needed")
        self.end = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        #: key of a pair of ids -> place in the list of merges, and the id that each merge makes
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for m in model["merges"]:
            left, right = m if isinstance(m, list) else m.split(" ", 1)
            self.ranks.setdefault(self.ids[left] << 32 | self.ids[right], len(self.made))
            self.made.append(self.ids[left + right])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.letters = byte_letters()
        plain = {letter: b for b, letter in self.letters.items()}
        #: pairs[a, b]: some token has byte b right after byte a
        self.pairs = np.zeros((256, 256), dtype=bool)
        for token in self.ids:
            if token not in self.special:
                body = [plain[c] for c in token.removesuffix(self.end)]
                for a, b in zip(body, body[1:]):
                    self.pairs[a, b] = True
        missing = [c for c in self.letters.values() if c not in self.ids or c + self.end not in self.ids]
        if missing:
            raise ValueError(f"{path}: no token for the single bytes {missing[:5]}")
        self.inner = [self.ids[self.letters[b]] for b in range(256)]
        self.final = [self.ids[self.letters[b] + self.end] for b in range(256)]
        self.known = KnownIds()
        # what digests know of distinct fragments: row by hash, and by row the number of ids, decimal ids, decoded tokens
        self.rows: dict[int, int] = {}
        self.counts: list[int] = []
        self.decimals: list[bytes] = []
        self.decoded: list[bytes] = []

    @cached_property
    def tokens(self) -> dict[int, str]:
        return {i: t for t, i in self.ids.items()}

    @cached_property
    def decimal(self) -> dict[int, bytes]:
        return {i: str(i).encode() for i in self.tokens}

    @cached_property
    def raw(self) -> dict[int, bytes]:
        return {i: t.encode() for i, t in self.tokens.items()}

    @classmethod
    def load(cls, path: str) -> "WordVocabulary":
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def merge(self, symbols: list[int]) -> list[int]:
        """Merge the pair of least rank, leftmost first, until none is left."""
        get, made, none = self.ranks.get, self.made, len(self.made)
        pairs = [get(a << 32 | b, none) for a, b in zip(symbols, symbols[1:])]
        while pairs:
            best = min(pairs)
            if best == none:
                break
            at = pairs.index(best)
            new = symbols[at] = made[best]
            del symbols[at + 1], pairs[at]
            if at:
                pairs[at - 1] = get(symbols[at - 1] << 32 | new, none)
            if at < len(pairs):
                pairs[at] = get(new << 32 | symbols[at + 1], none)
        return symbols

    def encode_fragment(self, body: bytes, last: bool) -> list[int]:
        symbols = [self.inner[b] for b in body]
        if last:
            symbols[-1] = self.final[body[-1]]
        return self.merge(symbols) if len(symbols) <= 200 else self.merge_long(symbols)

    def merge_long(self, symbols: list[int]) -> list[int]:
        """The same merges for long fragments: a heap of pairs over a linked list."""
        get, n = self.ranks.get, len(symbols)
        after, before, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
        heap = [(r, k) for k in range(n - 1) if (r := get(symbols[k] << 32 | symbols[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, k = heapq.heappop(heap)
            j = after[k] if alive[k] else -1
            if j < 0 or get(symbols[k] << 32 | symbols[j]) != r:
                continue
            symbols[k], alive[j] = self.made[r], False
            after[k] = after[j]
            if after[j] >= 0:
                before[after[j]] = k
            for x in (before[k], k):
                y = after[x] if x >= 0 else -1
                if y >= 0 and (r := get(symbols[x] << 32 | symbols[y])) is not None:
                    heapq.heappush(heap, (r, x))
        return [s for s, ok in zip(symbols, alive) if ok]

    def decode(self, ids: list[int]) -> str:
        """As the library decodes without a decoder: the tokens, a space between any two."""
        special = {i: t for t, i in self.special.items()}
        return " ".join(special.get(i) or self.tokens[i] for i in ids)


def fragments(vocabulary: WordVocabulary, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and word-end flags of the fragments of normalised texts, in bytes."""
    _, points, bounds = pretokens.code_points(buf, offsets)
    a, b = pretokens.spans_words(points, bounds)
    if len(points) != len(buf):
        heads = np.append(np.flatnonzero((buf & 0xC0) != 0x80), len(buf))
        a, b = heads[a], heads[b]
    n = len(buf)
    inside = np.zeros(n + 1, dtype=np.int8)
    inside[a] += 1
    inside[b] -= 1
    inside = np.cumsum(inside[:n]).astype(bool)
    cut = np.zeros(n + 1, dtype=bool)
    cut[1:n] = ~vocabulary.pairs[buf[:-1], buf[1:]]
    cut[a] = True
    starts = np.flatnonzero(cut[:n] & inside)
    stop = np.zeros(n + 1, dtype=bool)
    stop[b] = True
    ends = np.append(starts[1:], n)
    word = np.searchsorted(a, starts, "right") - 1
    limit = b[word] if len(b) else ends
    ends = np.minimum(ends, limit)
    return starts, ends, ends == limit


def _hashed(vocabulary: WordVocabulary, texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes and offsets of texts, and of their fragments starts, ends, word-end flags and hashes."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    offsets = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum([len(r) for r in raw], out=offsets[1:])
    body = b"".join(raw)
    buf = np.frombuffer(body, np.uint8)
    starts, ends, last = fragments(vocabulary, buf, offsets)
    hashes = bv.span_hash(bv.prefix_sums(buf), starts, ends) if len(starts) else np.zeros(0, np.uint64)
    return body, offsets, starts, ends, last, np.where(last, hashes ^ _WORD_END, hashes)


def chunk_ids(vocabulary: WordVocabulary, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of normalised texts without special strings, one text after another, and for each the range of its own."""
    body, offsets, starts, ends, last, hashes = _hashed(vocabulary, texts)
    distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    if len(vocabulary.known.hashes) > FRAGMENTS:
        vocabulary.known = KnownIds()
    known = vocabulary.known
    found = known.rows_of(distinct)
    new = np.flatnonzero(found < 0)
    if len(new):
        found[new] = known.add(distinct[new], [vocabulary.encode_fragment(body[starts[i] : ends[i]], bool(last[i])) for i in first[new].tolist()])
    rows = found[inverse]
    counts = known.bounds[rows + 1] - known.bounds[rows]
    sums = np.zeros(len(rows) + 1, dtype=np.int64)
    np.cumsum(counts, out=sums[1:])
    ids = known.ids[np.repeat(known.bounds[rows] - sums[:-1], counts) + np.arange(sums[-1])]
    return ids, sums[np.searchsorted(starts, offsets)]


def chunk_encode(vocabulary: WordVocabulary, texts: list[str]) -> Iterator[tuple[int, bytes, bytes]]:
    """(number of ids, decimal ids joined by spaces, decoded UTF-8) of each normalised text without special strings."""
    body, offsets, starts, ends, last, hashes = _hashed(vocabulary, texts)
    distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    v = vocabulary
    if len(v.rows) > FRAGMENTS:
        for known in (v.rows, v.counts, v.decimals, v.decoded):
            known.clear()
    found = np.empty(len(distinct), dtype=np.int64)
    for k, h in enumerate(distinct.tolist()):
        row = v.rows.get(h)
        if row is None:
            i = first[k]
            ids = v.encode_fragment(body[starts[i] : ends[i]], bool(last[i]))
            row = v.rows[h] = len(v.counts)
            v.counts.append(len(ids))
            v.decimals.append(b" ".join([v.decimal[x] for x in ids]))
            v.decoded.append(b" ".join([v.raw[x] for x in ids]))
        found[k] = row
    sums = np.zeros(len(starts) + 1, dtype=np.int64)
    if len(starts):
        np.cumsum(np.array([v.counts[r] for r in found.tolist()], dtype=np.int64)[inverse], out=sums[1:])
    rows = found[inverse].tolist()
    at = np.searchsorted(starts, offsets).tolist()
    decimal, decoded = v.decimals.__getitem__, v.decoded.__getitem__
    for a, b in zip(at[:-1], at[1:]):
        own = rows[a:b]
        yield int(sums[b] - sums[a]), b" ".join(map(decimal, own)), b" ".join(map(decoded, own))


def _pieces(vocabulary: WordVocabulary, texts: list[str]) -> tuple[list[str], list[list[int]]]:
    """The normalised pieces between special strings, and for each text its pieces by number, the id of a special string between any two."""
    pattern = re.compile("|".join(map(re.escape, sorted(vocabulary.special, key=len, reverse=True)))) if vocabulary.special else None
    pieces: list[str] = []
    layout: list[list[int]] = []
    for text in texts:
        own: list[int] = []
        at = 0
        if pattern is not None and any(s in text for s in vocabulary.special):
            for m in pattern.finditer(text):
                own += [len(pieces), vocabulary.special[m[0]]]
                pieces.append(normalised(text[at : m.start()]))
                at = m.end()
        own.append(len(pieces))
        pieces.append(normalised(text[at:]))
        layout.append(own)
    return pieces, layout


def text_ids(vocabulary: WordVocabulary, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """As ``chunk_ids`` for any texts: special strings stand for themselves, and what lies between them is normalised and encoded."""
    pieces, layout = _pieces(vocabulary, texts)
    ids, bounds = chunk_ids(vocabulary, pieces)
    if len(pieces) == len(texts):
        return ids, bounds
    parts = [[ids[bounds[x] : bounds[x + 1]] if k % 2 == 0 else np.array([x], dtype=np.int32) for k, x in enumerate(own)] for own in layout]
    sums = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([sum(map(len, own)) for own in parts], out=sums[1:])
    return np.concatenate([x for own in parts for x in own]), sums


def encode_texts(vocabulary: WordVocabulary, texts: list[str]) -> Iterator[tuple[int, bytes, bytes]]:
    """As ``chunk_encode`` for any texts: special strings stand for themselves, and what lies between them is normalised and encoded."""
    pieces, layout = _pieces(vocabulary, texts)
    done = list(chunk_encode(vocabulary, pieces))
    special = {i: t.encode() for t, i in vocabulary.special.items()}
    for own in layout:
        if len(own) == 1:
            yield done[own[0]]
            continue
        parts = [done[x] if k % 2 == 0 else (1, str(x).encode(), special[x]) for k, x in enumerate(own)]
        parts = [p for p in parts if p[0]]
        yield sum(p[0] for p in parts), b" ".join(p[1] for p in parts), b" ".join(p[2] for p in parts)


def _texts(rows: pa.RecordBatch) -> list[str]:
    return [t or "" for t in rows.column(rows.schema.get_field_index("text")).to_pylist()]


def encoded_digests(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    small_batches(docs.sparkSession)
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = WordVocabulary.load(vocabulary_path)
        for b in batches:
            for rows, _, _ in bv.chunks(b, "text"):
                done = [(n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()) for n, ids, decoded in encode_texts(vocabulary, _texts(rows))]
                yield batch(out, rows.column(0).cast(pa.int64()), *zip(*done))

    return pick(docs, doc_id=id_col, text=text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_tokens and ids (array<int>)."""
    small_batches(docs.sparkSession)
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = WordVocabulary.load(vocabulary_path)
        for b in batches:
            for rows, _, _ in bv.chunks(b, "text"):
                ids, bounds = text_ids(vocabulary, _texts(rows))
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
                yield batch(out, rows.column(0).cast(pa.int64()), np.diff(bounds), lists)

    return pick(docs, doc_id=id_col, text=text_col).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>")


def decode(encoded: DataFrame, vocabulary_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text: the tokens of ``ids`` joined as the library joins them; null ids are none."""
    small_batches(encoded.sparkSession)
    out = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = WordVocabulary.load(vocabulary_path)
        for b in batches:
            yield batch(out, b.column(0).cast(pa.int64()), [vocabulary.decode(x or []) for x in b.column(1).to_pylist()])

    return pick(encoded, doc_id=id_col, ids=ids_col).mapInArrow(run, "doc_id long, text string")
