"""Fixpoints over edge tables: transitive closure, reachability, connected components.

All are driver loops over DataFrames; every round is written to the shared
folder, so plans stay short and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.session import Growing, free, tasks_for, written


def transitive_closure(edges: DataFrame, s: str = "s", o: str = "o") -> DataFrame:
    """(s, o) for every path of one or more edges."""
    edges = edges.select(F.col(s).alias("s"), F.col(o).alias("o")).where("s is not null and o is not null").distinct()
    return paths(written(edges, "edges")).all


def paths(edges: DataFrame, *by: str) -> Growing:
    """``edges`` (s, o, by) and what paths of them join, in as many rounds as the logarithm of the longest shortest path.

    edges: a table of ``written``, each row once, no nulls; the edges of a path are equal in ``by``.
    Before round k the table has the ends of all walks of under 2**k edges.  The
    round makes walks of exactly 2**k edges from those of half the length, joins
    them with the table, and adds what is new; in a tree each pair is made once.
    When there are no such walks, or a round adds nothing, every walk has a shorter one with its ends.
    """
    known = Growing(edges.sparkSession, "closure", edges)
    names = ["s", *by, "o"]
    walks = edges.select(*names)
    while True:
        half = walks
        walks = written(_walk(half, half, by).distinct(), "walks")
        if known.parts:
            free(half)
        # walks of twice the length, alone and before each pair of the table
        if walks.isEmpty() or known.add(walks.union(_walk(walks, known.all, by)).distinct().join(known.all, names, "left_anti")).isEmpty():
            free(walks)
            return known


def _walk(first: DataFrame, then: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Pairs of ``first`` followed by pairs of ``then``; large tables are joined in small tasks, so that few rows meet in one."""
    a, b = first.select("s", *by, F.col("o").alias("m")), then.select(F.col("s").alias("m"), *by, "o")
    n = tasks_for(first, then)
    if n > 2:
        a, b = (x.repartition(n, "m", *by) for x in (a.hint("merge"), b))
    return a.join(b, ["m", *by]).select("s", *by, "o")


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(n) of ``seeds`` (n) and all that edges (s, o) reach from them; each round joins only what is new."""
    edges = written(edges.select("s", "o").distinct(), "edges")
    found = Growing(edges.sparkSession, "reach")
    fresh = found.add(seeds.select("n").distinct())
    while not fresh.isEmpty():
        step = edges.join(fresh.select(F.col("n").alias("s")), "s").select(F.col("o").alias("n")).distinct()
        fresh = found.add(step.join(found.all, "n", "left_anti"))
    return found.all


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(member, canonical): the least member that each node of an edge reaches, by alternating large and small stars."""
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    pairs = written(pairs, "stars")

    def stamp(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    last = stamp(pairs)
    while last[0]:
        both = pairs.union(pairs.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).distinct()
        pairs = written(small, "stars")
        now = stamp(pairs)
        if now == last:
            break
        last = now
    roots = pairs.select("v").distinct().select(F.col("v").alias("member"), F.col("v").alias("canonical"))
    return pairs.select(F.col("u").alias("member"), F.col("v").alias("canonical")).union(roots)
