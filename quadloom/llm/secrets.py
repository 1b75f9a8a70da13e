"""Secret scans: fixed rules, and Markov models of random strings and ordinary identifiers.

Three rules find labelled assignments, access keys and long hexadecimal runs.
Beside them, two first-order Markov models over characters score every other
run of 20 or more key characters: one model of random strings, one of ordinary
words and identifiers.  A run whose log-likelihood ratio is over ``LLR`` in all
and over ``PER_CHARACTER`` for a character is reported as ``markov``.

Both are trained from labelled samples.  Some are labelled by how they were
made: keys drawn from the alphabets of key generators, and identifiers joined
from a list of words.  The others come from all documents and are labelled by
the rules: key characters of the secrets that they find (``RUN`` or more) are
random, runs without digits outside of every match are ordinary.  Each task
counts pairs of characters in a table of fixed size, and the tables are summed,
so what is learnt grows with the corpus and what travels does not.

Positions are code points, ends exclusive.  Null texts are empty; texts
without a secret have no spans; repeated rows give repeated results; a corpus
without any text leaves the models to the made samples.  Ids are integers that
fit a long.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.llm import bytesvec as bv
from quadloom.llm.common import batch, pick, small_batches

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "markov")
#: Least characters of a run that the models judge, and the thresholds of the ratio (natural logarithms).
RUN, LLR, PER_CHARACTER = 20, 14.0, 0.6
#: Weights of the corpus's samples in the models of random and of ordinary strings; the made samples have the rest.
RANDOM_SHARE, ORDINARY_SHARE = 0.2, 0.5
KEYWORDS = (b"pass", b"secret", b"token", b"api")

_KEY = np.zeros(256, dtype=bool)
_KEY[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"]] = True
_DIGIT = np.zeros(256, dtype=np.int32)
_DIGIT[[*b"0123456789+"]] = 1
_HEX = np.zeros(256, dtype=bool)
_HEX[[*b"0123456789abcdef"]] = True
_RUN_PATTERN = re.compile(rf"[A-Za-z0-9+/_-]{{{RUN},}}")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the three rules: leftmost matches of each, without those that are too short."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def tallied(samples: list[str]) -> np.ndarray:
    """How often each pair of bytes occurs: row 256 is the first byte, row a column b is b after a."""
    counts = np.zeros((257, 256), dtype=np.int64)
    for x in samples:
        raw = np.frombuffer(x.encode(), np.uint8)
        if len(raw):
            counts[256, raw[0]] += 1
            np.add.at(counts, (raw[:-1], raw[1:]), 1)
    return counts


def likelihoods(counts: np.ndarray) -> np.ndarray:
    """Smoothed probabilities of the next byte, row by row."""
    counts = counts + 0.02
    backoff = counts.sum(axis=0, keepdims=True)
    counts += 2 * backoff / backoff.sum()
    return counts / counts.sum(axis=1, keepdims=True)


def train(random_made: np.ndarray, ordinary_made: np.ndarray, random_found: np.ndarray | None = None, ordinary_found: np.ndarray | None = None) -> np.ndarray:
    """Log-likelihood ratios from tallies: of samples made with their label, and of those found in the corpus (any number, none too)."""

    def mixed(made: np.ndarray, found: np.ndarray | None, share: float) -> np.ndarray:
        share = share if found is not None and found.any() else 0.0
        return (1 - share) * likelihoods(made) + (share * likelihoods(found) if share else 0.0)

    return np.log(mixed(random_made, random_found, RANDOM_SHARE)) - np.log(mixed(ordinary_made, ordinary_found, ORDINARY_SHARE))


def random_strings(n: int = 3000, seed: int = 11) -> list[str]:
    """Labelled positives: keys drawn from the alphabets that key generators use."""
    rng = np.random.default_rng(seed)
    digits, lower = "0123456789", "abcdefghijklmnopqrstuvwxyz"
    alphabets = [digits + lower + lower.upper(), digits + lower + lower.upper() + "+/", digits + lower + lower.upper() + "-_", digits + lower.upper(), digits + lower, digits + "abcdef"]
    return ["".join(rng.choice(list(alphabets[k % len(alphabets)]), rng.integers(20, 48))) for k in range(n)]


#: Words of ordinary identifiers, from which labelled negatives are made.
IDENTIFIER_WORDS = (
    "account action address after align allow array base before begin block body buffer button cache call change char check child class clean client close code "
    "column command config content count create current data date default delete depth device digest display document domain download element empty enable end "
    "entry error event exception export field file filter first flag folder format from function get group handle header height identifier image import index "
    "init input insert instance item join key language last layout length level library limit line link list load local lock logger main manager map match message "
    "method mode model module name network next node normal number object offset open option order ordinary output package page parent parse password path pattern "
    "point position prefix process project property protocol query queue random range read record reference register remove render request reset response result "
    "return root row sample schema scope search section select server service session set size sort source src start state status store stream string style system "
    "table target task template test text thread time title token type update upload url user util value vector version view visible weight width window word worker write"
).split()


def ordinary_strings(words: list[str] = IDENTIFIER_WORDS, n: int = 6000, seed: int = 12) -> list[str]:
    """Labelled negatives: the words themselves, and identifiers and paths joined from them."""
    rng = np.random.default_rng(seed)
    out = list(words)
    for k in range(n):
        some = [words[i] for i in rng.integers(0, len(words), rng.integers(2, 6))]
        joint = ("_", "-", "/", "")[k % 4]
        some = [w.capitalize() for w in some] if joint == "" else some
        out.append(joint.join(some) + (str(rng.integers(0, 2100)) if k % 5 == 0 else ""))
    return out


def tally_ordinary(counts: np.ndarray, buf: np.ndarray, offsets: np.ndarray) -> None:
    """Add the runs of key characters without digits."""
    starts, ends = bv.spans_of(_KEY[buf], offsets)
    digits = np.concatenate([[0], np.cumsum(_DIGIT[buf])])
    plain = digits[ends] == digits[starts]
    starts, ends = starts[plain], ends[plain]
    counts[256] += np.bincount(buf[starts], minlength=256)
    edge = np.zeros(len(buf) + 1, dtype=np.int8)
    edge[starts] += 1
    edge[ends - 1] -= 1  # pairs begin at every byte of a run but its last
    first = np.flatnonzero(np.cumsum(edge[:-1]))
    counts[:256] += np.bincount(buf[first].astype(np.int64) << 8 | buf[first + 1], minlength=1 << 16).reshape(256, 256)


def corpus_tallies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Tallies of random and of ordinary samples in all documents, as the rules label them."""
    small_batches(docs.sparkSession)
    out = pa.schema([("label", pa.int32()), ("cell", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 257, 256), dtype=np.int64)
        for b in batches:
            for rows, buf, offsets in bv.chunks(b, "text"):
                flags = suspects(buf, offsets)
                outside, values = [], []
                for k in np.flatnonzero(flags).tolist():
                    text = buf[offsets[k] : offsets[k + 1]].tobytes().decode()
                    at = 0
                    for a, z, _ in base_spans(text):
                        outside.append(text[at : max(at, a)])
                        values += _RUN_PATTERN.findall(text[max(at, a) : z])
                        at = max(at, z)
                    outside.append(text[at:])
                counts[0] += tallied(values)
                whole = buf
                if outside:  # blanks take the place of these texts, which are counted without their secrets
                    whole = np.where(np.repeat(flags, np.diff(offsets)), np.uint8(0x20), buf)
                    rest = np.frombuffer(" ".join(outside).encode(), np.uint8)
                    tally_ordinary(counts[1], rest, np.array([0, len(rest)]))
                tally_ordinary(counts[1], whole, offsets)
        for label, own in enumerate(counts.reshape(2, -1)):
            cells = np.flatnonzero(own)
            yield batch(out, np.full(len(cells), label, np.int32), cells.astype(np.int32), own[cells])

    summed = np.zeros((2, 257 * 256), dtype=np.int64)
    # at most one row for each cell of the two tables
    for r in pick(docs, id=id_col, text=text_col).select("text").mapInArrow(run, "label int, cell int, n long").groupBy("label", "cell").agg(F.sum("n").alias("n")).collect():
        summed[r["label"], r["cell"]] = r["n"]
    return summed[0].reshape(257, 256), summed[1].reshape(257, 256)


def model_from(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Train on the made samples and on all documents."""
    return train(tallied(random_strings()), tallied(ordinary_strings()), *corpus_tallies(docs, id_col, text_col))


def markov_spans(text: str, model: np.ndarray, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Runs that the models call random; of a run that spans of the rules (``taken``, by start) overlap, each piece of ``RUN`` or more characters beside them."""
    found = []
    begins = [y for y, _, _ in taken]
    reach = [0, *itertools.accumulate((z for _, z, _ in taken), max)]  # the furthest end of the first spans
    for m in _RUN_PATTERN.finditer(text):
        at, end = m.span()
        first, last = bisect.bisect_right(begins, at), bisect.bisect_left(begins, end)
        at = max(at, reach[first])
        for k in range(first, last + 1):
            a, b = at, min(end, begins[k]) if k < last else end
            at = max(at, reach[k + 1]) if k < last else end
            if b - a < RUN:
                continue
            raw = np.frombuffer(text[a:b].encode(), np.uint8)
            score = model[256, raw[0]] + model[raw[:-1], raw[1:]].sum()
            if score > LLR and score > PER_CHARACTER * len(raw):
                found.append((a, b, "markov"))
    return found


def _long_run(flag: np.ndarray, offsets: np.ndarray, least: int) -> np.ndarray:
    """Texts that have a run of ``least`` flagged bytes."""
    starts, ends = bv.spans_of(flag, offsets)
    hit = np.searchsorted(offsets, starts[ends - starts >= least], "right") - 1
    out = np.zeros(len(offsets) - 1, dtype=bool)
    out[hit] = True
    return out


def suspects(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts in which any rule or model could find something; a cheap test that never misses one."""
    flag = _long_run(_KEY[buf], offsets, RUN) | _long_run(_HEX[buf], offsets, 24)
    raw = buf.tobytes().lower()
    for word in (*KEYWORDS, b"akia"):
        at = raw.find(word)
        while at >= 0:
            k = int(np.searchsorted(offsets, at, "right")) - 1
            flag[k] = True
            at = raw.find(word, int(offsets[k + 1]))
    return flag


def scan(rows: pa.RecordBatch, buf: np.ndarray, offsets: np.ndarray, model: np.ndarray) -> list[tuple[str, list[tuple[int, int, str]], list[tuple[int, int, str]]]]:
    """(text, base spans, all spans) of each text of a chunk; the text of unsuspicious ones is left out."""
    flags = suspects(buf, offsets).tolist()
    column = rows.column(rows.schema.get_field_index("text"))
    result = []
    for k, flag in enumerate(flags):
        if not flag:
            result.append((None, [], []))
            continue
        text = column[k].as_py() or ""
        base = base_spans(text)
        more = markov_spans(text, model, base)
        result.append((text, base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2]), s[1])) if more else base))
    return result


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def secret_spans(docs: DataFrame, model: np.ndarray | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans (kind:start:end, comma-joined)."""
    small_batches(docs.sparkSession)
    model = model_from(docs, id_col, text_col) if model is None else model
    out = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, buf, offsets in bv.chunks(b, "text"):
                done = []
                for _, base, spans in scan(rows, buf, offsets, model):
                    kinds = [k for _, _, k in spans]
                    done.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans)))
                yield batch(out, rows.column(0).cast(pa.int64()), *zip(*done))

    return pick(docs, doc_id=id_col, text=text_col).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string")


def redact(text: str, spans: list[tuple[int, int, str]], mark: str = "[secret]") -> str:
    """The text with each secret (overlapping spans as one) replaced by ``mark``."""
    parts, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            parts += [text[at:a], mark]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def without_secrets(docs: DataFrame, model: np.ndarray | None = None, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with secrets replaced in the texts, the same rows and columns; ``count_col`` (if there) counts the new text's characters."""
    small_batches(docs.sparkSession)
    model = model_from(docs, id_col, text_col) if model is None else model
    schema = docs.schema
    position = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = list(b.schema.names)
            inner = b.rename_columns([f"c{k}" if k != position else "text" for k in range(len(names))])
            for rows, buf, offsets in bv.chunks(inner, "text"):
                done = scan(rows, buf, offsets, model)
                if not any(spans for _, _, spans in done):
                    yield rows.rename_columns(names)
                    continue
                old = rows.column(position).to_pylist()
                new = [redact(text, spans) if spans else before for before, (text, _, spans) in zip(old, done)]
                columns = list(rows.columns)
                columns[position] = pa.array(new, type=columns[position].type)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    changed = docs.mapInArrow(run, schema)
    if count_col in docs.columns:
        changed = changed.withColumn(count_col, F.when(F.col(text_col).isNull(), F.col(count_col)).otherwise(F.char_length(text_col)).cast(schema[count_col].dataType))
    return changed.select(docs.columns)
