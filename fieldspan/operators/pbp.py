"""Play-by-play logs: lines to events, markers and possessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import clock
from . import intervals, sequence

# The log's line and event patterns.
LINE = r"^(\d{2}:\d{2}|--)\s+(\S+)\s*(.*)$"
GAIN = r"^(?:Draw control|Ground ball pickup) by\s+(\S+)"
CLEAR = r"^Clear attempt by\s+(\S+)"
GOAL = r"^GOAL by\s+(\S+)"
CARD = r"^(Green|Yellow|Red) card"
END = "End-of-period"


def parse(lines: DataFrame, keys: list[str], seq: str = "seq", line: str = "line", period_sec: float = 900.0) -> DataFrame:
    """keys, quarter, seq, time_str, team, desc, elapsed_sec from raw lines in order.

    A period ends after its marker; what follows the last one is one more period. Untimed events
    take the next known time of their period, else the last, else 0."""
    hit = F.trim(line)
    part = [F.regexp_extract(hit, LINE, k) for k in (1, 2, 3)]
    got = lines.filter(hit.rlike(LINE)).select(*keys, F.col(seq).alias("seq"), part[0].alias("time_str"), part[1].alias("team"), part[2].alias("desc"))
    end = (F.col("team") == "0") & F.col("desc").contains(END)
    w = Window.partitionBy(*keys).orderBy("seq")
    got = got.withColumn("__end", end.cast("int")).withColumn("quarter", F.sum("__end").over(w) - F.col("__end") + 1)
    got = got.filter(F.col("team") != "0").drop("__end")
    timed = F.when(F.col("time_str") != "--", clock.elapsed(F.col("time_str"), period_sec))
    got = got.withColumn("__t", timed)
    return got.withColumn("elapsed_sec", sequence.next_known(F.col("__t"), [*keys, "quarter"], "seq")).select(*keys, "quarter", "seq", "time_str", "team", "desc", "elapsed_sec")


def stoppage(desc: Column) -> Column:
    """timeout, free_position, card or null."""
    return F.when(desc.startswith("Timeout by"), "timeout").when(desc.startswith("Free position attempt for"), "free_position").when(desc.rlike(CARD), "card")


def stoppages(events: DataFrame, keys: list[str]) -> DataFrame:
    return events.withColumn("type", stoppage(F.col("desc"))).filter("type is not null").select(*keys, "quarter", "elapsed_sec", "type")


def goals(events: DataFrame, keys: list[str]) -> DataFrame:
    team = F.regexp_extract("desc", GOAL, 1)
    return events.filter(team != "").select(*keys, "quarter", "elapsed_sec", team.alias("team"))


def possessions(events: DataFrame, keys: list[str], period_sec: float = 900.0) -> DataFrame:
    """keys, quarter, team, start_sec, end_sec, duration_sec, end_reason.

    Gains and clears both claim the ball for a team. The holder after a row is the last claim's
    team, or no one once that team has scored since; possessions run between changes of holder."""
    name = lambda p: F.nullif(F.regexp_extract("desc", p, 1), F.lit(""))
    claims = events.select(*keys, "quarter", "seq", "elapsed_sec", F.coalesce(name(GAIN), name(CLEAR)).alias("claim"), name(GOAL).alias("goal"))
    return held_intervals(claims, [*keys, "quarter"], "seq", "elapsed_sec", period_sec)


def held_intervals(events: DataFrame, keys: list[str], seq: str, t: str, end_t: float) -> DataFrame:
    """The state machine behind possessions(), over rows with claim (team or null) and goal (team or null)."""
    w = Window.partitionBy(*keys).orderBy(seq)
    e = events.withColumns({"lc": F.last("claim", ignorenulls=True).over(w), "g": F.count("claim").over(w)})
    own = Window.partitionBy(*keys, "g").orderBy(seq)
    scored = F.coalesce((F.col("goal") == F.col("lc")).cast("int"), F.lit(0))
    e = e.withColumn("closed", F.max(scored).over(own))
    e = e.withColumn("cur", F.when(F.col("closed") == 0, F.col("lc")))
    e = e.withColumn("before", F.lag("cur").over(w)).filter(~F.col("cur").eqNullSafe(F.col("before")))
    e = e.withColumns({"end_sec": F.coalesce(F.lead(t).over(w), F.lit(float(end_t))), "next_goal": F.lead((F.col("goal").isNotNull() & F.col("cur").isNull()).cast("int")).over(w)})
    why = F.when(F.col("next_goal") == 1, "goal").when(F.col("next_goal") == 0, "turnover").otherwise("period_end")
    got = e.filter(F.col("cur").isNotNull() & (F.col("end_sec") > F.col(t)))
    return got.select(*keys, F.col("cur").alias("team"), F.round(t, 1).alias("start_sec"), F.round("end_sec", 1).alias("end_sec"), F.round(F.col("end_sec") - F.col(t), 1).alias("duration_sec"), why.alias("end_reason"))


def totals(rows: DataFrame) -> DataFrame:
    """team, n, total_sec, avg_sec."""
    return rows.groupBy("team").agg(F.count(F.lit(1)).alias("n"), F.sum("duration_sec").alias("total_sec"), F.avg("duration_sec").alias("avg_sec"))


def audit_lines(lines: DataFrame, spans: DataFrame, keys: list[str], tolerance: float = 20.0) -> DataFrame:
    """Lines whose remaining time lies within a span's, to within the tolerance.

    lines: keys, seq, remaining; spans: keys, span_id, remaining_start (the larger), remaining_end."""
    wide = spans.withColumns({"__low": F.col("remaining_end") - tolerance, "__high": F.col("remaining_start") + tolerance})
    return intervals.dealt_join(lines, wide, keys, "remaining", "__low", "__high", 60).drop("__low", "__high")


def blocks(lines: DataFrame, keys: list[str], seq: str = "seq", line: str = "line") -> DataFrame:
    """lines with block, from 1: a line that holds the end marker, in any case, ends its block."""
    end = F.lower(line).contains(END.lower()).cast("int")
    w = Window.partitionBy(*keys).orderBy(seq)
    return lines.withColumn("__end", end).withColumn("block", F.sum("__end").over(w) - F.col("__end") + 1).drop("__end")


def goal_consistency(spans: DataFrame, marks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_possession_goals, n_goal_lines, consistent."""
    both = spans.filter("end_reason = 'goal'").select(*keys, F.lit(1).alias("p"), F.lit(0).alias("m")).unionByName(marks.select(*keys, F.lit(0).alias("p"), F.lit(1).alias("m")))
    got = both.groupBy(*keys).agg(F.sum("p").alias("n_possession_goals"), F.sum("m").alias("n_goal_lines"))
    return got.withColumn("consistent", F.col("n_possession_goals") == F.col("n_goal_lines"))
