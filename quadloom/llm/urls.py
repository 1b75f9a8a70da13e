"""URL filters: host and path rules, and a cascade of Bloom filters for listed hosts.

Rules are (host, path, verdict); a rule fits its host and all subdomains when
the URL's path starts with the rule's path, and the longest rule wins.

Listed hosts and addresses (host and path) are matched by a cascade: level 0 is
a Bloom filter of the listed keys that the corpus has; level 1 holds the other
keys of the corpus that level 0 lets through, level 2 the listed keys that
level 1 lets through, and so on until a level lets nothing wrong through.  A
key of the corpus is listed if the first level that refuses it is odd, or the
last level that accepts it is even.  As the levels are built from all keys of
the corpus, the answer is exact for each of them and no join with the list is
needed.

The keys of a page are its host, the host's parent domains and its address, so
listing a domain lists its subdomains.  Level 0 is made tighter the fewer of
the corpus's keys are listed, so a cascade has about 30 bits and a few more for
each doubling of that ratio for a listed key, whatever the corpus's size.  One
that would be over ``MOST_BYTES`` is cut by key into parts of at most about
that size; each part is built, sent to the tasks and looked up in a pass of its
own, so neither the driver nor a task ever holds more than one.

Null URLs and URLs without ``://`` have empty host and path and are allowed;
repeated rows give repeated results; null and empty entries of the list count
for nothing.  Ids of pages are integers that fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.llm import bytesvec as bv
from quadloom.llm.common import batch, pick, small_batches, written

#: The rules of the production query: (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Domains that the production query lists: names of advertisers and spammers under each of the corpus's domains.
LISTED_NAMES, LISTED_UNDER = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"), ("example.com", "example.net", "example.org")
#: A page with fewer paragraphs is thin; the production query lists the addresses of thin pages.
PARAGRAPHS = 2
#: Bits and hashes for a key of the levels after the first.
BITS_PER_KEY, HASHES = 12, 5
#: Keys for which a filter that spares a join rows has room.
FILTER_KEYS = 4_000_000
#: Bytes of a part of the cascade, about.
MOST_BYTES = 64 << 20


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (host and path together; then the longer host), and its verdict; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for own, start, says in sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[0]))):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        name = F.when(fits, F.lit(own + start)).otherwise(name)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def domains(host: Column) -> Column:
    """The host and its parent domains, as an array."""
    parts = F.split(host, r"\.")
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), ".")))


def address(host: Column, path: Column) -> Column:
    return F.when((host != "") & (path != ""), F.concat(host, path))


def keys_of(host: Column, path: Column) -> Column:
    """The 64-bit keys of a page: its host, the parent domains, its address."""
    names = F.concat(domains(host), F.array_compact(F.array(address(host, path))))
    return F.transform(names, lambda x: F.xxhash64(x))


def production_list(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(entry): the listed domains, and the addresses of all thin pages, which stand for a list that a user brings and that grows with the corpus."""
    html = F.col(f"`{html_col}`")
    url = F.col(f"`{url_col}`")
    thin = pages.where(F.char_length(html) - F.char_length(F.replace(html, F.lit("<p>"), F.lit(""))) < 3 * PARAGRAPHS)
    names = F.explode(F.array(*(F.lit(f"{n}.{u}") for n in LISTED_NAMES for u in LISTED_UNDER)))
    return pages.sparkSession.range(1).select(names.alias("entry")).unionByName(thin.select(address(host_of(url), path_of(url)).alias("entry")).where("entry is not null").distinct())


@dataclass(frozen=True)
class Level:
    table: np.ndarray  # bits
    hashes: int


@dataclass(frozen=True)
class Cascade:
    """The levels, level 0 first, of the keys of one part."""

    levels: tuple[Level, ...]

    @property
    def n_bytes(self) -> int:
        return sum(x.table.nbytes for x in self.levels)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """Exact for all keys of the corpus from which the cascade was built."""
        depth = np.zeros(len(keys), dtype=np.int64)
        live = np.arange(len(keys))
        for number, level in enumerate(self.levels):
            live = live[accepts(level, keys[live], number)]
            depth[live] += 1
        return depth % 2 == 1


def places(keys: np.ndarray, size: int, number: int, hashes: int = HASHES) -> np.ndarray:
    """The bits of each key in a table of ``size`` bits; each level hashes anew."""
    a = bv.mix64(keys + np.uint64(0x9E3779B97F4A7C15 * (number + 1) & (1 << 64) - 1))
    b = bv.mix64(a) | np.uint64(1)
    return (a[:, None] + b[:, None] * np.arange(hashes, dtype=np.uint64)) % np.uint64(size)


def accepts(level: Level, keys: np.ndarray, number: int) -> np.ndarray:
    at = places(keys, len(level.table) * 8, number, level.hashes)
    return (level.table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).all(axis=1)


def _table_bytes(n: int, bits: float = BITS_PER_KEY) -> int:
    return max(8, -(-int(n * bits) // 8))


def first_bits(listed: int, others: int) -> float:
    """Bits for a key of level 0: no more of the other keys pass it than are listed, about."""
    return max(BITS_PER_KEY, 1.44 * np.log2(max(1.0, others / max(1, listed))))


def filter_of(keys: DataFrame, n: int, number: int, bits: float) -> Level:
    """The Bloom filter of the keys ``k``: each task sets bits of its own table, and equal words of tables are joined by bitwise or."""
    size = _table_bytes(n, bits)
    hashes = HASHES if bits == BITS_PER_KEY else max(HASHES, round(0.69 * bits))
    piece = 4096
    out = pa.schema([("word", pa.int64()), ("bits", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(-(-size // 8) * 8, dtype=np.uint8)
        for b in batches:
            at = places(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), size * 8, number, hashes).ravel()
            np.bitwise_or.at(own, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        words = own.view(np.int64)
        set_words = np.flatnonzero(words)
        for lo in range(0, len(set_words), piece):
            some = set_words[lo : lo + piece]
            yield batch(out, some, words[some])

    table = np.zeros(-(-size // 8) * 8, dtype=np.uint8)
    words = table.view(np.int64)
    # one job, and two columns of the table's set words
    found = keys.select("k").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return Level(table[:size], hashes)


def _passing(keys: DataFrame, level: Level, number: int) -> DataFrame:
    out = pa.schema([("k", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.column(0).to_numpy(zero_copy_only=False)
            yield batch(out, k[accepts(level, k.view(np.uint64), number)])

    return keys.select("k").mapInArrow(run, "k long")


def part_of(k: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(k, F.lit("part")), F.lit(parts))


def cascades(universe: DataFrame, listed: DataFrame, most_bytes: int = MOST_BYTES) -> Iterator[tuple[int, int, Cascade]]:
    """(part, parts, cascade of that part) over the 64-bit keys ``k`` of the corpus, one after another.

    Keys are hashes of domains and addresses; two with equal hashes would be one key.
    """
    universe = written(universe.select("k").distinct(), "keys")
    inside = written(universe.join(listed.select("k").distinct(), "k", "left_semi"), "listed")
    outside = written(universe.join(inside, "k", "left_anti"), "others")
    n, others = inside.count(), outside.count()
    bits = first_bits(n, others)
    parts = max(1, -(-_table_bytes(n, bits + BITS_PER_KEY + 1) // most_bytes))
    for part in range(parts):
        this, other = (x if parts == 1 else x.where(part_of(F.col("k"), parts) == part) for x in (inside, outside))
        levels: list[Level] = []
        while size := this.count():
            level = filter_of(this, size, len(levels), BITS_PER_KEY if levels else bits)
            wrong = written(_passing(other, level, len(levels)), "level")
            levels.append(level)
            this, other = wrong, this
        yield part, parts, Cascade(tuple(levels))


def _looked_up(keyed: DataFrame, cascade: Cascade, part: int, parts: int) -> DataFrame:
    """``keyed`` with ``listed`` set where a key of this part is listed; the keys of other parts are left alone."""
    own = keyed.withColumn("mine", F.col("keys") if parts == 1 else F.filter("keys", lambda k: part_of(k, parts) == part))
    names = ["page_id", "host", "path", "keys", "listed", "mine"]
    out = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("keys", pa.list_(pa.int64())), ("listed", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(5)
            flat = keys.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            bounds = np.append(0, np.cumsum(keys.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
            hit = np.append(0, np.cumsum(cascade.contains(flat)))
            found = hit[bounds[1:]] > hit[bounds[:-1]]
            yield batch(out, *(b.column(k).cast(out.field(k).type) for k in range(4)), found | b.column(4).to_numpy(zero_copy_only=False))

    return own.select(names).mapInArrow(run, "page_id long, host string, path string, keys array<long>, listed boolean")


def judged(pages: DataFrame, listed: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", entry_col: str = "entry", most_bytes: int = MOST_BYTES) -> DataFrame:
    """One row for each row of ``pages``: page_id, host, path, rule, verdict, listed; ``listed``: a column of domains and of addresses (host/path)."""
    spark = pages.sparkSession
    small_batches(spark)
    url = pick(pages, page_id=id_col, url=url_col)
    parsed = url.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    universe = parsed.select("host", "path").distinct().select(F.explode(keys_of(F.col("host"), F.col("path"))).alias("k"))
    lower = F.translate(F.regexp_extract("entry", "^[^/]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    wanted = pick(listed, entry=entry_col).where("entry is not null and entry <> ''").select(F.xxhash64(F.concat(lower, F.regexp_extract("entry", "(?s)/.*", 0))).alias("k"))
    flagged = parsed.select("page_id", "host", "path", keys_of(F.col("host"), F.col("path")).alias("keys"), F.lit(False).alias("listed"))
    for part, parts, cascade in cascades(universe, wanted, most_bytes):
        flagged = _looked_up(flagged, cascade, part, parts)
        if parts > 1:  # one part in a task at a time
            flagged = written(flagged, "looked-up")
    name, says = rule_of(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(says, F.when(F.col("listed"), "block").otherwise("allow"))
    return flagged.select("page_id", "host", "path", name.alias("rule"), verdict.alias("verdict"), "listed")
