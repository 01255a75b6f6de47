"""Report: possessions joined to their results, formations and cuts, and the tables made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import workbook
from . import sequence

UNTAGGED = "Untagged"


def combined(rows: DataFrame, results: DataFrame, formations: DataFrame, cuts: DataFrame, keys: list[str], order: str) -> DataFrame:
    """rows with result (untagged where there is none), formation and cuts; of entries for the same key the last counts."""
    last = lambda df, *cols: sequence.latest(df, keys, order).select(*keys, *cols)
    out = rows.join(last(results, "result"), keys, "left").join(last(formations, "formation"), keys, "left").join(last(cuts, "cuts_in", "cuts_out"), keys, "left")
    return out.withColumns({"result": F.coalesce("result", F.lit(UNTAGGED)), "cuts_in": F.coalesce("cuts_in", F.lit(0)), "cuts_out": F.coalesce("cuts_out", F.lit(0))})


def chosen(rows: DataFrame, team: str | None = None, max_duration: float | None = None) -> DataFrame:
    """Possessions of a team, and no longer than so many seconds, where these are given."""
    if team is not None:
        rows = rows.filter(F.col("team") == team)
    if max_duration is not None:
        rows = rows.filter(F.col("end_sec") - F.col("start_sec") <= max_duration)
    return rows


def averages(rows: DataFrame) -> DataFrame:
    """team, n, total_sec, avg_sec, goals (results that tell of a goal), total_cuts, avg_cuts."""
    cuts = F.col("cuts_in") + F.col("cuts_out")
    return rows.groupBy("team").agg(
        F.count(F.lit(1)).alias("n"), F.sum("duration_sec").alias("total_sec"), F.avg("duration_sec").alias("avg_sec"), F.count_if(F.lower("result").contains("goal")).alias("goals"), F.sum(cuts).alias("total_cuts"), F.avg(cuts).alias("avg_cuts")
    )


def results(rows: DataFrame) -> DataFrame:
    """team, result, n, share of the team's tagged rows."""
    got = rows.filter(F.col("result") != UNTAGGED).groupBy("team", "result").agg(F.count(F.lit(1)).alias("n"))
    return got.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("team")))


def quarters(rows: DataFrame) -> DataFrame:
    return rows.groupBy("team", "quarter").agg(F.count(F.lit(1)).alias("n"), F.sum("duration_sec").alias("total_sec"), F.avg("duration_sec").alias("avg_sec"))


def cuts_summary(rows: DataFrame) -> DataFrame:
    """team, quarter (null: the whole game), n, cuts_in, cuts_out."""
    sets = rows.groupingSets([["team"], ["team", "quarter"]], "team", "quarter")
    return sets.agg(F.count(F.lit(1)).alias("n"), F.sum("cuts_in").alias("cuts_in"), F.sum("cuts_out").alias("cuts_out"))


def formations_by_result(rows: DataFrame) -> DataFrame:
    """team, result, formation, n, share within the result; rows without a result or a formation are left out."""
    got = rows.filter((F.col("result") != UNTAGGED) & F.col("formation").isNotNull()).groupBy("team", "result", "formation").agg(F.count(F.lit(1)).alias("n"))
    return got.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("team", "result")))


def cuts_by_result(rows: DataFrame) -> DataFrame:
    """team, result, n and averages; rows without a result are left out."""
    return rows.filter(F.col("result") != UNTAGGED).groupBy("team", "result").agg(
        F.count(F.lit(1)).alias("n"), F.avg("cuts_in").alias("avg_in"), F.avg("cuts_out").alias("avg_out"), F.avg(F.col("cuts_in") + F.col("cuts_out")).alias("avg_total"), F.avg("duration_sec").alias("avg_sec")
    )


# The headings of the sheets.
LOG = {
    "quarter": "Quarter", "team": "Team", "camera": "Camera", "start_sec": "Start (s)", "end_sec": "End (s)", "duration_sec": "Duration (s)", "result": "Result", "man_situation": "Man Situation",
    "notes": "Notes", "formation": "Offense Formation", "def_formation": "Defense Formation", "cuts_in": "Cuts In", "cuts_out": "Cuts Out",
}
SHEETS = ("Game Averages", "Quarter Breakdown", "Cuts Summary", "Formations by Result", "Cuts by Result", "Possession Log")


def sheets(rows: DataFrame) -> dict[str, DataFrame]:
    """The tables of the report by name, with the headings, the order of columns and rows and the one
    decimal that they are read with. Result Breakdown belongs to Game Averages."""
    one = lambda c, name: F.round(c, 1).alias(name)
    percent = lambda name: one(F.col("share") * 100, name)
    team, n = F.col("team").alias("Team"), F.col("n")
    total = (F.col("cuts_in") + F.col("cuts_out")).alias("Total Cuts")
    return {
        "Game Averages": averages(rows).orderBy("team").select(
            team, n.alias("Total Possessions"), F.col("goals").alias("Total Goals"), one("total_sec", "Total Possession Time (s)"), one("avg_sec", "Avg Possession Length (s)"), F.col("total_cuts").alias("Total Cuts (In + Out)"), one("avg_cuts", "Avg Cuts per Possession")
        ),
        "Result Breakdown": results(rows).orderBy("team", F.desc("n"), "result").select(team, F.col("result").alias("Result Breakdown"), n.alias("Count"), percent("%")),
        "Quarter Breakdown": quarters(rows).orderBy("team", "quarter").select(team, F.col("quarter").alias("Quarter"), n.alias("# Possessions"), one("total_sec", "Total Duration (s)"), one("avg_sec", "Avg Duration (s)")),
        "Cuts Summary": cuts_summary(rows).orderBy("team", F.asc_nulls_first("quarter")).select(
            team, F.col("quarter").alias("Quarter"), F.col("cuts_in").alias("Cuts In"), F.col("cuts_out").alias("Cuts Out"), total, F.when(F.col("quarter").isNull(), F.round((F.col("cuts_in") + F.col("cuts_out")) / n, 1)).alias("Avg Cuts per Possession")
        ),
        "Formations by Result": formations_by_result(rows).orderBy("team", "result", F.desc("n"), "formation").select(team, F.col("result").alias("Result"), F.col("formation").alias("Offense Formation (Behind Net, Net-to-8, Perimeter)"), n.alias("Count"), percent("% within Result")),
        "Cuts by Result": cuts_by_result(rows).orderBy("team", F.desc("n"), "result").select(team, F.col("result").alias("Result"), n.alias("# Possessions"), one("avg_in", "Avg Cuts In"), one("avg_out", "Avg Cuts Out"), one("avg_total", "Avg Total Cuts"), one("avg_sec", "Avg Duration (s)")),
        "Possession Log": rows.orderBy("team", "quarter", *[c for c in ("start_sec",) if c in rows.columns]).select(*[F.col(c).alias(name) for c, name in LOG.items() if c in rows.columns]),
    }


def write_sheets(rows: DataFrame, path: str) -> list[str]:
    """Write each sheet as a folder of CSV with a header under path; returns the paths of SHEETS."""
    for name, table in sheets(rows).items():
        table.write.mode("overwrite").option("header", True).csv(f"{path}/{name.lower().replace(' ', '_')}")
    return [f"{path}/{name.lower().replace(' ', '_')}" for name in SHEETS]


def write_workbook(rows: DataFrame, path: str) -> None:
    """Write the sheets as one workbook; Result Breakdown stands below Game Averages."""
    made = sheets(rows)
    below = {"Game Averages": ["Result Breakdown"]}
    workbook.write({name: [made[x] for x in (name, *below.get(name, []))] for name in SHEETS}, path, label="Team")
