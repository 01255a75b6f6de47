"""Samples by rank: stratified, systematic, every k-th."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def evenly(df: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """k rows of each key at places floor(i * n / k) of the order; all of them where there are k or fewer."""
    w = Window.partitionBy(*keys)
    ranked = df.withColumns({"__r": F.row_number().over(w.orderBy(*order)) - 1, "__n": F.count(F.lit(1)).over(w)})
    # Row r is picked if some i has floor(i * n / k) = r: the least i with i * n >= r * k gives it.
    i = F.ceil(F.col("__r") * k / F.col("__n"))
    hit = (F.col("__n") <= k) | ((i < k) & (F.floor(i * F.col("__n") / k) == F.col("__r")))
    return ranked.filter(hit).drop("__r", "__n")


def every_kth(df: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """Every n-th row, n being max(1, rows // k), and of those the first k."""
    w = Window.partitionBy(*keys)
    ranked = df.withColumns({"__r": F.row_number().over(w.orderBy(*order)) - 1, "__n": F.count(F.lit(1)).over(w)})
    step = F.greatest(F.lit(1), F.floor(F.col("__n") / k))
    return ranked.filter((F.col("__r") % step == 0) & (F.col("__r") / step < k)).drop("__r", "__n")


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def shuffled(df: DataFrame, seed: int, *ids: str) -> DataFrame:
    """Rows in a pseudorandom order that depends on the seed and the ids alone."""
    return df.orderBy(F.xxhash64(F.lit(seed), *ids), *ids)


def sample_times(start: Column, end: Column, n: int) -> Column:
    """n evenly spaced times from start to end."""
    if n == 1:
        return F.array(start)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: start + (end - start) * i / (n - 1))
