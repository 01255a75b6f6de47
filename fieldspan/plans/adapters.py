"""Inputs of the operators made from the driver's tables, with whole-number arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spatial import Calibration, zone
from ..params import Params

CAL = Calibration(1000.0, 600.0, 200.0, ((900.0, 1000.0), (1100.0, 1000.0), (800.0, 700.0), (1200.0, 700.0)), 2000, 1200)
#: Thresholds that suit these data.
P = Params(strict_off=4, strict_def=4, strict_deep=3, loose_off=4, loose_def=4, grace_buckets=1, sustained_buckets=3, stride=15, max_interp_gap=150, roster_floor=3, min_zone_run=2, huddle_ratio=20.0, quiet_samples=2)
QUARTER = 180
SIX_HOURS = 21600


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tracks(spark: SparkSession, sf_dir: str, with_key: bool = False) -> DataFrame:
    """A tracking table out of events: 14 events a frame, errors being missed detections."""
    e = read(spark, sf_dir, "events").filter("event_type <> 'error'")
    e = e.select(F.expr("event_id div 14").alias("k"), (F.col("event_id") % 14).cast("int").alias("slot"), F.floor("value").alias("v"))
    team = F.when(F.col("slot") < 7, "A").when(F.col("slot") < 13, "B").otherwise("Goalie")
    e = e.select(
        F.lit("g").alias("game"), F.lit("c").alias("camera"), (1 + F.expr(f"k div {QUARTER}")).alias("quarter"), (F.col("k") % QUARTER).alias("bucket"), (F.col("k") * 15).alias("frame"),
        F.col("slot").alias("det_ix"), F.col("slot").alias("track_id"), team.alias("team"),
        ((140 * F.col("slot") + 5 * F.col("k")) % 2000).alias("cx"), ((150 * F.col("slot") + 11 * F.col("k") + F.col("v") % 20) % 1200).alias("cy"),
    )
    e = e.withColumns({"l": F.col("cx") - 20, "r": F.col("cx") + 20, "t": F.col("cy") - 40, "b": F.col("cy") + 40})
    return e.withColumn("zone", zone(F.col("cx"), F.col("cy"), CAL, with_key))


def spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """game, camera, quarter, bucket of every frame, with detections or without."""
    k = read(spark, sf_dir, "events").select(F.expr("event_id div 14").alias("k")).distinct()
    return k.select(F.lit("g").alias("game"), F.lit("c").alias("camera"), (1 + F.expr(f"k div {QUARTER}")).alias("quarter"), (F.col("k") % QUARTER).alias("bucket"))


def quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """game, camera, camera_ix, quarter, first_frame, last_frame of the quarters that frames lie in."""
    q = spine(spark, sf_dir).select("game", "camera", "quarter").distinct()
    first = (F.col("quarter") - 1) * (QUARTER * 15)
    return q.select("game", "camera", F.lit(0).alias("camera_ix"), "quarter", first.alias("first_frame"), (first + QUARTER * 15 - 1).alias("last_frame"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """game, camera, frame of every frame, with detections or without."""
    k = read(spark, sf_dir, "events").select((F.expr("event_id div 14") * 15).alias("frame")).distinct()
    return k.select(F.lit("g").alias("game"), F.lit("c").alias("camera"), "frame")


def seen_by_two(df: DataFrame) -> DataFrame:
    """Tracks as two cameras see them: even slots on c0, odd ones on c1."""
    return df.withColumn("camera", F.concat(F.lit("c"), F.col("track_id") % 2))


def for_two(df: DataFrame) -> DataFrame:
    """Frames or quarters of one camera as those of both."""
    out = df.drop("camera", "camera_ix").withColumn("camera_ix", F.explode(F.array(F.lit(0), F.lit(1))))
    return out.withColumn("camera", F.concat(F.lit("c"), "camera_ix"))


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with t, whole seconds since 1970 (the time zone of the session being UTC)."""
    e = read(spark, sf_dir, "events")
    return e.withColumn("t", F.expr("unix_micros(cast(ts AS timestamp)) div 1000000"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Play-by-play lines out of conversations: conv_id, seq, line."""
    c = read(spark, sf_dir, "conversations")
    at = F.format_string("%02d:%02d", (F.lit(14) - F.col("turn")).cast("int"), (F.col("conv_id") * 7 % 60).cast("int"))
    line = (
        F.when(F.col("role") == "system", "00:00 0 End-of-period")
        .when(F.col("role") == "user", F.concat(at, F.lit(" A "), F.when(F.col("turn") % 4 == 2, "Clear attempt by A good").otherwise("Draw control by A P1")))
        .when(F.col("turn") == 3, F.concat(at, F.lit(" B GOAL by B P3")))
        .when(F.col("turn") == 5, F.concat(at, F.lit(" B Timeout by B")))
        .otherwise("-- B Ground ball pickup by B P2")
    )
    return c.select("conv_id", F.col("turn").alias("seq"), line.alias("line"))


# SQL of the same inputs.
TRK_SQL = """
e AS (SELECT event_id // 14 AS k, event_id % 14 AS slot, CAST(floor(value) AS BIGINT) % 20 AS v FROM events WHERE event_type <> 'error'),
x AS (SELECT 1 + k // 180 AS quarter, k % 180 AS bucket, k * 15 AS frame, slot AS track_id, CASE WHEN slot < 7 THEN 'A' WHEN slot < 13 THEN 'B' ELSE 'Goalie' END AS team,
        (140 * slot + 5 * k) % 2000 AS cx, (150 * slot + 11 * k + v) % 1200 AS cy FROM e),
trk AS (SELECT *, CASE WHEN cy > 1000 THEN 'Behind Net' WHEN cy >= 600 THEN 'Net-to-8' WHEN cy >= 200 THEN 'Perimeter' ELSE 'Beyond 30' END AS zone FROM x)"""
SPINE_SQL = "spine AS (SELECT DISTINCT 1 + (event_id // 14) // 180 AS quarter, (event_id // 14) % 180 AS bucket FROM events)"
TIMED_SQL = "timed AS (SELECT *, epoch_us(ts) // 1000000 AS t FROM events)"
LINES_SQL = """
lines AS (SELECT conv_id, turn AS seq, CASE WHEN role = 'system' THEN '00:00 0 End-of-period'
    WHEN role = 'user' THEN printf('%02d:%02d', 14 - turn, conv_id * 7 % 60) || ' A ' || CASE WHEN turn % 4 = 2 THEN 'Clear attempt by A good' ELSE 'Draw control by A P1' END
    WHEN turn = 3 THEN printf('%02d:%02d', 14 - turn, conv_id * 7 % 60) || ' B GOAL by B P3'
    WHEN turn = 5 THEN printf('%02d:%02d', 14 - turn, conv_id * 7 % 60) || ' B Timeout by B'
    ELSE '-- B Ground ball pickup by B P2' END AS line FROM conversations)"""


def islands_sql(source: str, keys: str, pos: str, gap: int) -> str:
    return (
        f"(SELECT {keys}, min({pos}) AS s, max({pos}) + 1 AS e, count(*) AS n FROM (SELECT *, sum(nw) OVER (PARTITION BY {keys} ORDER BY {pos}) AS isl FROM "
        f"(SELECT *, CASE WHEN {pos} - lag({pos}) OVER (PARTITION BY {keys} ORDER BY {pos}) - 1 <= {gap} THEN 0 ELSE 1 END AS nw FROM {source})) GROUP BY {keys}, isl)"
    )
