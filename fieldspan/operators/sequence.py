"""Ordered-sequence operators: islands, runs, fills, resampling. keys always partition the order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ordered(keys: list[str], *order: str | Column):
    return Window.partitionBy(*keys).orderBy(*order)


def islands(df: DataFrame, keys: list[str], pos: str, max_gap: int = 0) -> DataFrame:
    """Segments of the positions in df: keys, start, end (exclusive), n. A gap of max_gap positions or
    less between two of them is bridged; gaps before the first and after the last are not filled."""
    w = ordered(keys, pos)
    new = F.when(F.col(pos) - F.lag(pos).over(w) - 1 <= max_gap, 0).otherwise(1)
    marked = df.select(*keys, F.col(pos).alias("__p"), new.alias("__new"))
    marked = marked.withColumn("__island", F.sum("__new").over(Window.partitionBy(*keys).orderBy("__p")))
    return marked.groupBy(*keys, "__island").agg(F.min("__p").alias("start"), (F.max("__p") + 1).alias("end"), F.count(F.lit(1)).alias("n")).drop("__island")


def sustained(segments: DataFrame, strict: DataFrame, keys: list[str], pos: str, least: int, width: int = 512) -> DataFrame:
    """The segments that hold so many consecutive positions of strict. Segments and runs are dealt over bins of
    a width; as neither overlap among themselves, there are no more pairs than segments, runs and bins."""
    bins = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.col(e) - 1) / width)))
    runs = islands(strict, keys, pos).filter(F.col("n") >= least).select(*keys, F.col("start").alias("__s"), F.col("end").alias("__e")).withColumn("__bin", bins("__s", "__e"))
    within = F.least("__e", "end") - F.greatest("__s", "start") >= least
    return segments.withColumn("__bin", bins("start", "end")).join(runs, [*keys, "__bin"]).filter(within).select(*segments.columns).distinct()


def runs(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Run-length encoding: keys, value, first and last of order, n, run (number)."""
    w = ordered(keys, order)
    change = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & F.lag(F.lit(1)).over(w).isNotNull(), 0).otherwise(1)
    numbered = df.withColumn("__c", change).withColumn("run", F.sum("__c").over(w))
    return numbered.groupBy(*keys, "run", value).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n"))


def low_stretches(df: DataFrame, keys: list[str], order: str, low: Column) -> DataFrame:
    """Stretches of consecutive rows (not consecutive numbers) where low holds: keys, first, last, n."""
    w = ordered(keys, order)
    flagged = df.select(*keys, order, low.alias("__low"))
    return runs(flagged, keys, order, "__low").filter("__low").select(*keys, "first", "last", "n")


def next_known(value: Column, keys: list[str], *order: str) -> Column:
    """The value itself, else the next known one, else the last known one, else 0."""
    # The next known value is the last one of the order turned round: a running frame, where one that
    # reaches to the end would be gone through anew for every row.
    so_far = lambda w: F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return F.coalesce(so_far(ordered(keys, *[F.desc(o) for o in order])), so_far(ordered(keys, *order)), F.lit(0.0))


def carried(value: Column, keys: list[str], *order: str) -> Column:
    """The last known value up to here."""
    return F.last(value, ignorenulls=True).over(ordered(keys, *order).rowsBetween(Window.unboundedPreceding, 0))


def sibling_gaps(df: DataFrame, keys: list[str], start: str, end: str, near: float, ties: Sequence[str] = ()) -> DataFrame:
    """df with gap_before, gap_after to the siblings in keys, and near (either below the limit).
    ties: columns that order siblings of the same start and end."""
    w = ordered(keys, start, end, *ties)
    before, after = F.col(start) - F.lag(end).over(w), F.lead(start).over(w) - F.col(end)
    out = df.withColumns({"gap_before": before, "gap_after": after})
    return out.withColumn("near", F.coalesce(F.col("gap_before") < near, F.lit(False)) | F.coalesce(F.col("gap_after") < near, F.lit(False)))


def resample_nearest(samples: DataFrame, keys: list[str], t: str, value: str, step: int) -> DataFrame:
    """A grid of step from 0 to the largest t in each key, with the value of the nearest sample (of
    two as near, the later; of samples at the same t, the largest value). Each sample covers the grid
    points up to the middle to its neighbours: no sample is compared with any but those."""
    w = ordered(keys, t)
    own = samples.groupBy(*keys, t).agg(F.max(value).alias(value))
    own = own.withColumns({"__prev": F.lag(t).over(w), "__next": F.lead(t).over(w)})
    # A point at the middle goes to the later sample.
    low = F.when(F.col("__prev").isNull(), 0).otherwise(F.ceil((F.col("__prev") + F.col(t)) / (2 * step)))
    high = F.when(F.col("__next").isNull(), F.floor(F.col(t) / step)).otherwise(F.ceil((F.col(t) + F.col("__next")) / (2 * step)) - 1)
    grid = own.withColumns({"__low": low.cast("long"), "__high": high.cast("long")}).filter("__low <= __high")
    return grid.select(*keys, F.explode(F.sequence("__low", "__high")).alias("__point"), value).select(*keys, (F.col("__point") * step).alias(t), value)


def grid_gaps(grid: DataFrame, keys: list[str], pos: str, on: str) -> DataFrame:
    """keys, max_gap (longest run of positions where on is false between two where it is true),
    open_gap (the run at the end), n_on."""
    seen = runs(grid, keys, pos, on)
    w = Window.partitionBy(*keys)
    marked = seen.withColumns({"__last": F.max("run").over(w), "__first": F.min("run").over(w)})
    inner = ~F.col(on) & (F.col("run") > F.col("__first")) & (F.col("run") < F.col("__last"))
    tail = ~F.col(on) & (F.col("run") == F.col("__last"))
    return marked.groupBy(*keys).agg(
        F.coalesce(F.max(F.when(inner, F.col("n"))), F.lit(0)).alias("max_gap"), F.coalesce(F.max(F.when(tail, F.col("n"))), F.lit(0)).alias("open_gap"), F.coalesce(F.sum(F.when(F.col(on), F.col("n"))), F.lit(0)).alias("n_on")
    )


def latest(df: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(o).desc() if isinstance(o, str) else o.desc() for o in order])
    return df.withColumn("__rank", F.row_number().over(w)).filter("__rank = 1").drop("__rank")
