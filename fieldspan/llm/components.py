"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, stage

SALTS = 32


def _mark(edges: DataFrame) -> tuple:
    """Tells whether two edge tables hold the same edges."""
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(h), F.bit_xor(F.xxhash64("b", "a"))).first())


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """edges: whole-number columns a and b, in any order, repeated or not. Gives node and root (the
    least node of its component) for every node that an edge joins to another.

    A large star ties a node's larger neighbours to its least neighbour, a small star its smaller
    ones. Edges never grow in number; a round is written before the next reads it, and the edges
    are at rest once every node hangs on its root: after a number of rounds in the logarithm of
    the longest path. Rows never come to the driver, only a count and a checksum of each round."""
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = stage(now, "edges")
    mark = _mark(now)
    for _ in range(rounds):
        # A root that many nodes hang on is many edges' lower end: it is dealt over SALTS tasks.
        lower = now.groupBy("a").agg(F.min("b").alias("m"))
        lower = lower.select(F.col("a").alias("n"), "m", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")).hint("merge")
        dealt = now.withColumn("at", F.pmod(F.xxhash64("a"), F.lit(SALTS)))
        large = dealt.join(lower, (F.col("b") == F.col("n")) & (F.col("at") == F.col("salt")), "left").select("a", F.coalesce("m", "b").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        before, now = now, stage(joined.filter("a <> b").distinct(), "edges")
        drop(before)
        last, mark = mark, _mark(now)
        if mark == last:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    raise RuntimeError(f"components are not at rest after {rounds} rounds")
