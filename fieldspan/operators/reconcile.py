"""Which team defends: readings, alternation over quarters, agreement of cameras."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def reading(scores: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """keys, score_a, score_b, dominant (a where they are equal), gap: sums of scores by team."""
    s = lambda t: F.coalesce(F.sum(F.when(F.col("team") == t, F.col("score"))), F.lit(0))
    got = scores.groupBy(*keys).agg(s(a).alias("score_a"), s(b).alias("score_b"))
    return got.withColumns({"dominant": F.when(F.col("score_b") > F.col("score_a"), b).otherwise(a), "gap": F.abs(F.col("score_a") - F.col("score_b"))})


def alternate(readings: DataFrame, game: list[str], a: str, b: str, first: str, second: str) -> DataFrame:
    """game, quarter, camera, team. readings: game, camera, quarter, dominant (or null), gap.

    The first and third, and the second and fourth quarter have one team each: that of the reading with
    the largest gap (of those as large, the earliest); quarters beyond the fourth are left out. Where both cameras then name the same team, the one with the larger
    gap in that quarter keeps it (first, where equal) and the other gets the other team."""
    parity = Window.partitionBy(*game, "camera", F.col("quarter") % 2)
    best = F.max_by("dominant", F.when(F.col("dominant").isNotNull(), F.struct("gap", (-F.col("quarter")).alias("q")))).over(parity)
    each = readings.filter(F.col("quarter").between(1, 4)).withColumn("team", best)
    pick = lambda cam, c: F.max(F.when(F.col("camera") == cam, F.col(c)))
    gap = lambda cam: F.coalesce(F.max(F.when((F.col("camera") == cam) & F.col("dominant").isNotNull(), F.col("gap"))), F.lit(0))
    both = each.groupBy(*game, "quarter").agg(pick(first, "team").alias("t1"), pick(second, "team").alias("t2"), gap(first).alias("g1"), gap(second).alias("g2"))
    other = lambda t: F.when(F.col(t) == a, b).otherwise(a)
    clash = F.coalesce(F.col("t1") == F.col("t2"), F.lit(False))
    one = F.when(clash & (F.col("g1") < F.col("g2")), other("t2")).otherwise(F.col("t1"))
    two = F.when(clash & (F.col("g1") >= F.col("g2")), other("t1")).otherwise(F.col("t2"))
    cams = F.array(F.struct(F.lit(first).alias("camera"), one.alias("team")), F.struct(F.lit(second).alias("camera"), two.alias("team")))
    return both.select(*game, "quarter", F.inline(cams))


def attack_camera(defends: DataFrame, teams: DataFrame, keys: list[str]) -> DataFrame:
    """teams with camera: the first camera whose defending team is known and another one."""
    d = defends.filter("def_team is not null")
    met = teams.join(d, keys).filter(F.col("def_team") != F.col("team"))
    return met.groupBy(*teams.columns).agg(F.min_by("camera", "camera_ix").alias("camera"))
