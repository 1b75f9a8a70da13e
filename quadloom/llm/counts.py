"""Token counts without token ids.

The pieces (pre-tokens) of the texts are found by a vectorised splitter.  In
each chunk the distinct pieces are counted once: a piece that is new to the
task goes through the vocabulary's merges, and its number of tokens is joined
to the frequencies per document by position, a local hash join on the piece.
A shuffle join on pieces would move several times the input; the table of
distinct pieces in a task has a fixed bound instead and starts anew beyond it.

A text that contains one of the vocabulary's special strings is counted by the
library itself, since special strings are cut out before pieces are found.
Null texts are empty and have no tokens; repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quadloom.llm import bytesvec as bv
from quadloom.llm import pretokens
from quadloom.llm.common import batch, pick, small_batches

#: Distinct pieces that one Python worker remembers.
PIECES = 1_000_000
LIMIT = 1024
#: Stands between pieces that are encoded together; a non-character.
BREAK = "\U0010ffff"


class ByteVocabulary:
    """A byte-level BPE vocabulary in the tokenizers library's JSON format."""

    _loaded: dict[str, "ByteVocabulary"] = {}

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        shape = spec["pre_tokenizer"], spec["normalizer"], spec["model"]["type"]
        if shape[0] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} or shape[1] or shape[2] != "BPE":
            raise ValueError(f"{path}: a byte-level BPE vocabulary without normaliser is needed")
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.special = [t["content"] for t in spec["added_tokens"]]
        letters = byte_letters()
        plain = {letter: b for b, letter in letters.items()}
        vocabulary = spec["model"]["vocab"]
        specials = set(self.special)
        self.largest = max(vocabulary.values(), default=0)
        ranks = {bytes(plain[c] for c in token): i for token, i in vocabulary.items() if token not in specials}
        # the merges' order is the order of ids here; the core below needs that
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in spec["model"]["merges"]]
        ids = [vocabulary[m] for m in merged]
        self.core = tiktoken.Encoding("pieces", pat_str=f"[^{BREAK}]+|{BREAK}", mergeable_ranks=ranks, special_tokens={})._core_bpe if ids == sorted(ids) else None
        self.mark = None if self.core is None else self.core.encode_ordinary(BREAK)
        self.table = pretokens.PieceTable(PIECES)
        self.short = pretokens.IdTable(PIECES)

    @classmethod
    def load(cls, path: str) -> "ByteVocabulary":
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces after one another, and where each piece's ids begin and end."""
        if self.core is None or any(BREAK in p for p in pieces):
            lists = [e.ids for e in self.library.encode_batch(pieces, add_special_tokens=False)]
            bounds = np.zeros(len(lists) + 1, dtype=np.int64)
            np.cumsum([len(x) for x in lists], out=bounds[1:])
            return np.array([i for x in lists for i in x], dtype=np.uint32), np.stack([bounds[:-1], bounds[1:]])
        flat = np.frombuffer(self.core.encode_to_tiktoken_buffer(BREAK.join(pieces) + BREAK, set()), np.uint32)
        mark, n = self.mark, len(self.mark)
        hit = np.ones(len(flat) - n + 1, dtype=bool)
        for k, x in enumerate(mark):
            hit &= flat[k : k + len(hit)] == x
        stops = np.flatnonzero(hit)
        return flat, np.stack([np.concatenate([[0], stops[:-1] + n]), stops])

    def count_pieces(self, pieces: list[str]) -> list[int]:
        _, (a, b) = self.encode_pieces(pieces)
        return (b - a).tolist()

    def short_pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece as little-endian 16-bit integers; the vocabulary must fit them."""
        if self.largest >= 1 << 16:
            raise ValueError(f"ids up to {self.largest} do not fit 16 bits")
        flat, (a, b) = self.encode_pieces(pieces)
        raw = flat.astype("<u2").tobytes()
        return [raw[2 * x : 2 * y] for x, y in zip(a.tolist(), b.tolist())]


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes for themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {**{b: chr(b) for b in shown}, **{b: chr(0x100 + k) for k, b in enumerate(hidden)}}


def chunk_counts(vocabulary: ByteVocabulary, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The number of tokens of each text of a chunk."""
    text, points, bounds = pretokens.code_points(buf, offsets)
    starts, ends = pretokens.spans_gpt(points, bounds)
    values, which = vocabulary.table.lookup(pretokens.span_hashes(points, starts, ends), text, starts, ends, vocabulary.count_pieces)
    sums = np.zeros(len(starts) + 1, dtype=np.int64)
    if len(starts):
        np.cumsum(np.array(values, dtype=np.int64)[which], out=sums[1:])
    at = np.searchsorted(starts, bounds)
    counts = sums[at[1:]] - sums[at[:-1]]
    for special in vocabulary.special:
        if special in text:
            for k in range(len(counts)):
                own = text[bounds[k] : bounds[k + 1]]
                if special in own:
                    counts[k] = len(vocabulary.library.encode(own, add_special_tokens=False).ids)
    return counts


def token_counts(docs: DataFrame, vocabulary_path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens)."""
    small_batches(docs.sparkSession)
    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = ByteVocabulary.load(vocabulary_path)
        for b in batches:
            for rows, buf, offsets in bv.chunks(b, "text"):
                n = chunk_counts(vocabulary, buf, offsets)
                yield batch(out, rows.column(0).cast(pa.int64()), np.diff(offsets), n, n > limit)

    return pick(docs, doc_id=id_col, text=text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
