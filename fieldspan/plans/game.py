"""The chain for one game's folder, from detections to the report, as steps of plans.pipeline."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clock, spatial
from ..operators import align, diagnostics, formations, pbp, possessions, reconcile, report, sequence, tracking
from ..params import DEFAULTS, GOALIE, Params
from ..sources import frames, tables
from . import analysis, pipeline
from .pipeline import Step

GAME_COLUMNS = ["game", "camera", "frame", "det_ix", "l", "t", "r", "b", "cx", "cy", "team", "zone", "track_id", "interpolated"]


def calibrations(spark: SparkSession, folder: str, cameras: list[str]) -> dict[str, spatial.Calibration]:
    """Each camera's calibration out of its own file: one small row a camera."""
    out = {}
    for c in cameras:
        row = tables.read_rows(spark, f"{folder}/{c}.calibration.json", tables.CALIBRATION).first()
        out[c] = spatial.Calibration.from_points(row["points"], row["frame_width"], row["frame_height"])
    return out


def steps(spark: SparkSession, folder: str, game: str, p: Params = DEFAULTS) -> list[Step]:
    """The steps over folder: game_config.json, and for each camera its .detections.json, .calibration.json
    and goalie_team_....json (readings of who defends), the log and, if there is one,
    possession_results.json. On the driver are the configuration and a calibration for each camera."""
    config = tables.read_config(spark, f"{folder}/game_config.json")
    names = config.select("team_a", "team_b", "team_aliases", "playbyplay_txt", "fps", "period_length_sec", F.expr("transform(cameras, c -> c.label)").alias("cameras")).first()
    a, b, cameras = names["team_a"], names["team_b"], names["cameras"]
    aliases = names["team_aliases"] or {}
    # Seconds and frames are turned into each other as the game has them. What is given in frames (the
    # stride, the gaps of tracks) stays in frames.
    p = replace(p, fps=float(names["fps"]), period_sec=float(names["period_length_sec"]))
    cal = calibrations(spark, folder, cameras)
    quarters = tables.quarters(config).withColumn("game", F.lit(game))
    lines = spark.createDataFrame([(game, c, x.yard8_y, x.yard30_y, x.frame_height) for c, x in cal.items()], "game string, camera string, yard8_y double, yard30_y double, frame_height int")
    named = lambda df: df.withColumn("team", clock.normalised(F.col("team"), aliases))
    by_camera = lambda df, f: _union([f(df.filter(F.col("camera") == c), cal[c]) for c in cameras])

    def read(_spark, _inputs) -> DataFrame:
        got = tables.read_frames(spark, f"{folder}/*.detections.json")
        return got.withColumnRenamed("label", "camera").withColumn("game", F.lit(game)).select(*GAME_COLUMNS)

    def tracked(_spark, t) -> DataFrame:
        dets = tables.detections(t["frames"]).drop("track_id")
        return by_camera(dets, lambda df, c: tracking.track(df, ["game", "camera"], [a, b, GOALIE], float(c.frame_width), p)).select(*GAME_COLUMNS)

    def filled(_spark, t) -> DataFrame:
        return t["tracked"].unionByName(tracking.interpolate(t["tracked"], ["game", "camera"], p), allowMissingColumns=True)

    def zoned(_spark, t) -> DataFrame:
        # Formations and cuts look at the point itself; what the files call a zone serves the signal.
        return by_camera(t["filled"], lambda df, c: df.withColumn("zone", spatial.zone(F.col("cx"), F.col("cy"), c)))

    def defenders(_spark, _inputs) -> DataFrame:
        got = tables.read_quarter_map(spark, f"{folder}/goalie_team_*.json", "struct<dominant:string,gap:double>")
        got = got.select(F.lit(game).alias("game"), F.regexp_replace("label", "^goalie_team_", "").alias("camera"), "quarter", "value.dominant", "value.gap")
        return reconcile.alternate(got, ["game"], a, b, *cameras[:2]).withColumnRenamed("team", "def_team")

    def events(_spark, _inputs) -> DataFrame:
        return pbp.parse(tables.read_lines(spark, f"{folder}/{names['playbyplay_txt']}").withColumn("game", F.lit(game)), ["game"], period_sec=p.period_sec)

    def official(_spark, t) -> DataFrame:
        got = align.align_frames(t["filled"], _spine(t["frames"]), quarters, pbp.possessions(t["events"], ["game"], p.period_sec), pbp.stoppages(t["events"], ["game"]), pbp.goals(t["events"], ["game"]), p)
        return named(got).withColumn("seq", F.struct("quarter", "start_sec", "end_sec", "team"))

    def detected(_spark, t) -> DataFrame:
        return analysis.with_records(analysis.detect_frames(t["filled"], quarters, t["defenders"], lines, (a, b), p), t["official"], p)

    def final(_spark, t) -> DataFrame:
        results = tables.read_rows(spark, f"{folder}/possession_results.json", tables.RESULT, optional=True)
        tags = sequence.latest(results, ["possession_id"], "tagged_at").select("possession_id", "corrected_end_sec", "result", "man_situation", "notes")
        rows = t["detected"].withColumn("possession_id", clock.interval_id(F.col("quarter"), F.col("team"), F.col("start_sec"), F.col("end_sec")))
        got = possessions.apply_corrections(rows, tags, "possession_id").join(tags.drop("corrected_end_sec"), "possession_id", "left")
        return got.withColumns({"duration_sec": F.round(F.col("end_sec") - F.col("start_sec"), 1), "other": clock.other_team(F.col("team"), a, b)})

    def shapes(_spark, t) -> DataFrame:
        return formations.of_possessions(t["zoned"], _spine(t["frames"]), t["final"], quarters, p)

    def cuts(_spark, t) -> DataFrame:
        return formations.cuts_of_possessions(t["zoned"], t["final"], quarters, p)

    def rows(_spark, t) -> DataFrame:
        text = lambda c: F.when(F.col(c).isNotNull(), F.format_string("(%d, %d, %d)", f"{c}.bn", f"{c}.n8", f"{c}.pm"))
        got = t["final"].join(t["formations"].drop("n_frames"), formations.ID, "left").join(t["cuts"], formations.ID, "left")
        return got.withColumns({"result": F.coalesce("result", F.lit(report.UNTAGGED)), "formation": text("off_formation"), "def_formation": text("def_formation"), "cuts_in": F.coalesce("n_cuts_in", F.lit(0)), "cuts_out": F.coalesce("n_cuts_out", F.lit(0))})

    def against_log(look) -> Callable:
        return lambda _spark, t: look(t["official"], t["final"], t["filled"], quarters, t["defenders"], (a, b), p)

    def fragments(_spark, t) -> DataFrame:
        own = t["final"].select("game", "quarter", "team", "camera", "start_sec", "end_sec", "duration_sec")
        return sequence.sibling_gaps(own, ["game", "quarter", "team"], "start_sec", "end_sec", p.sibling_gap_sec, ["camera"])

    given = (p, a, b, cameras, aliases, game)
    configured = [f"{folder}/game_config.json", f"{folder}/*.calibration.json"]
    made: list[tuple[str, Callable, list[str], list[str]]] = [
        ("frames", read, [], [f"{folder}/*.detections.json"]),
        ("tracked", tracked, ["frames"], configured),
        ("filled", filled, ["tracked"], []),
        ("zoned", zoned, ["filled"], configured),
        ("defenders", defenders, [], [f"{folder}/goalie_team_*.json"]),
        ("events", events, [], [f"{folder}/{names['playbyplay_txt']}"]),
        ("official", official, ["filled", "frames", "events"], configured),
        ("detected", detected, ["filled", "defenders", "official"], configured),
        ("final", final, ["detected"], [f"{folder}/possession_results.json"]),
        ("formations", shapes, ["zoned", "frames", "final"], configured),
        ("cuts", cuts, ["zoned", "final"], configured),
        ("report", rows, ["final", "formations", "cuts"], []),
        ("unmatched", against_log(diagnostics.unmatched_peaks), ["official", "final", "filled", "defenders"], configured),
        ("missing_signal", against_log(diagnostics.missing_signal), ["official", "final", "filled", "defenders"], configured),
        ("fragments", fragments, ["final"], []),
    ]
    # Files, tags that change by hand among them, and parameters are part of a step's fingerprint.
    return [Step(name, make, inputs, reads=reads, params=given) for name, make, inputs, reads in made]


def _spine(frames: DataFrame) -> DataFrame:
    return frames.select("game", "camera", "frame").distinct()


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def run(spark: SparkSession, folder: str, game: str, out: str, p: Params = DEFAULTS, force: bool = False) -> dict[str, str]:
    """Run the chain into out, a folder of Parquet tables. out/sheets has the sheets as CSV, out/game_report.xlsx the
    workbook, where Python can write to out's file system, out/checks how detected and recorded possessions agree, and
    out/unmatched, out/missing_signal and out/fragments what cameras show where they don't."""
    told = pipeline.run(spark, steps(spark, folder, game, p), out, force)
    rows = spark.read.parquet(f"{out}/report")
    report.write_sheets(rows, f"{out}/sheets")
    if "://" not in out or out.split("://")[0] in frames.OPENED:
        report.write_workbook(rows, f"{out}/game_report.xlsx")
    official = spark.read.parquet(f"{out}/official")
    for name, table in analysis.checks(spark.read.parquet(f"{out}/final"), official, p).items():
        table.write.mode("overwrite").parquet(f"{out}/checks/{name}")
    return told
