"""Diagnostics on a time grid: probes of exact frames, peaks, cameras side by side, best clips."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clock
from ..params import ALL_ZONES, DEEP_ZONES, DEFAULTS, DIAGNOSTIC_ZONES, GOALIE, NEAR_NET_ZONES, PLAY_ZONES, Params
from . import intervals, reconcile
from .possessions import KEYS, QUARTER_BIN


def probe(spans: DataFrame, tracks: DataFrame, keys: list[str], step: int) -> DataFrame:
    """keys, span_id, at and the zone counts of the frame that stands exactly there; none where there is none."""
    grid = spans.withColumn("at", F.explode(F.sequence("first_frame", "last_frame", F.lit(step)))).select(*keys, "span_id", "at")
    name = lambda z: "n_" + z.lower().replace(" ", "_").replace("-", "_")
    counts = tracks.groupBy(*keys, F.col("frame").alias("at")).agg(*[F.count_if(F.col("zone") == z).alias(name(z)) for z in ALL_ZONES], F.count(F.lit(1)).alias("n_total"))
    return grid.join(counts, [*keys, "at"], "left").fillna(0)


def peaks(spans: DataFrame, tracks: DataFrame, keys: list[str], off: str, deff: str, width: int, zones: tuple[str, ...]) -> DataFrame:
    """keys, span_id, peak_off, peak_def: the largest counts of a frame within the span."""
    seen = tracks.filter(F.col("zone").isin(*zones)).groupBy(*keys, "frame").agg(F.count_if(F.col("team") == off).alias("off"), F.count_if(F.col("team").isin(deff, GOALIE)).alias("def"))
    met = intervals.binned_join(seen, spans, keys, "frame", "first_frame", "last_frame", width)
    got = met.groupBy(*keys, "span_id").agg(F.max("off").alias("peak_off"), F.max("def").alias("peak_def"))
    return spans.select(*keys, "span_id").join(got, [*keys, "span_id"], "left").fillna(0, ["peak_off", "peak_def"])


def _by_side(tracks: DataFrame, zones: tuple[str, ...], deep: tuple[str, ...], teams: tuple[str, str]) -> DataFrame:
    """game, camera, frame and how many of each team, of goalies, and of each team deep stand in zones."""
    a, b = teams
    n = lambda name, team, *also: F.count_if((F.col("team") == team) & (F.col("zone").isin(*also) if also else F.lit(True))).alias(name)
    return tracks.filter(F.col("zone").isin(*zones)).groupBy("game", "camera", "frame").agg(n("n_a", a), n("n_b", b), n("n_goalie", GOALIE), n("deep_a", a, *deep), n("deep_b", b, *deep))


def unmatched_peaks(official: DataFrame, found: DataFrame, tracks: DataFrame, quarters: DataFrame, defends: DataFrame, teams: tuple[str, str], p: Params = DEFAULTS) -> DataFrame:
    """game, quarter, team, start_sec, end_sec, camera, peak_off, peak_def, peak_deep: records without a
    common stretch with any detected interval of their team, and the largest counts in the frames
    around them on the camera that shows the team's attack. A record whose camera isn't known is left out;
    equal records count once. quarters and defends (def_team) have KEYS; quarters also camera_ix."""
    row = ["game", "quarter", "team", "start_sec", "end_sec"]
    own = official.filter(F.col("team").isin(*teams)).select(*row).distinct()
    lone = intervals.matched(own, found, ["game", "quarter", "team"], strict=True, how="left_anti")
    sides = defends.join(quarters.select(*KEYS, "camera_ix"), KEYS).select(*KEYS, "camera_ix", "def_team")
    seen = reconcile.attack_camera(sides, lone, ["game", "quarter"]).join(quarters.select(*KEYS, "first_frame", "last_frame"), KEYS)
    low = clock.to_frame(F.greatest(F.col("start_sec") - p.unmatched_pad_sec, F.lit(0.0)), F.col("first_frame"), p.fps)
    high = F.least(clock.to_frame(F.col("end_sec") + p.unmatched_pad_sec, F.col("first_frame"), p.fps), F.col("last_frame"))
    spans = seen.select(*row, "camera", low.alias("low"), high.alias("high")).filter("low <= high")
    met = intervals.binned_join(_by_side(tracks, DIAGNOSTIC_ZONES, NEAR_NET_ZONES, teams), spans, ["game", "camera"], "frame", "low", "high", QUARTER_BIN)
    mine = lambda x, y: F.when(F.col("team") == teams[0], F.col(x)).otherwise(F.col(y))
    peaked = met.groupBy(*row, "camera").agg(F.max(mine("n_a", "n_b")).alias("peak_off"), F.max(mine("n_b", "n_a") + F.col("n_goalie")).alias("peak_def"), F.max(mine("deep_a", "deep_b")).alias("peak_deep"))
    return seen.select(*row, "camera").join(peaked, [*row, "camera"], "left").fillna(0, ["peak_off", "peak_def", "peak_deep"])


def peaks_by_team(unmatched: DataFrame) -> DataFrame:
    """game, team, n_unmatched and the means of the peaks out of unmatched_peaks()."""
    return unmatched.groupBy("game", "team").agg(F.count(F.lit(1)).alias("n_unmatched"), F.avg("peak_off").alias("avg_peak_off"), F.avg("peak_def").alias("avg_peak_def"))


def missing_signal(official: DataFrame, found: DataFrame, tracks: DataFrame, quarters: DataFrame, defends: DataFrame, teams: tuple[str, str], p: Params = DEFAULTS) -> DataFrame:
    """game, quarter, team, start_sec, end_sec, camera, assigned, at, within, n_own, n_other, n_goalie,
    n_deep: records with no detected interval of their team near them, probed at every step around them on
    every camera that has the quarter. A probe looks at the very frame; assigned: the camera shows the
    team's attack; within: inside the record; n_deep: of the own team."""
    row = ["game", "quarter", "team", "start_sec", "end_sec"]
    own = official.filter(F.col("team").isin(*teams)).select(*row).distinct()
    lone = intervals.matched(own, found, ["game", "quarter", "team"], p.probe_within_sec, how="left_anti")
    sides = defends.join(quarters.select(*KEYS, "camera_ix"), KEYS).select(*KEYS, "camera_ix", "def_team")
    attack = reconcile.attack_camera(sides, lone, ["game", "quarter"]).withColumnRenamed("camera", "shown")
    steps = F.floor((F.col("end_sec") - F.col("start_sec") + 2 * p.probe_pad_sec) / p.probe_step_sec)
    at = F.col("start_sec") - p.probe_pad_sec + F.col("k") * p.probe_step_sec
    grid = lone.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), steps))).withColumn("at", at).drop("k")
    grid = grid.join(attack, row, "left").join(quarters.select(*KEYS, "first_frame"), ["game", "quarter"])
    grid = grid.withColumn("frame", clock.to_frame(F.col("at"), F.col("first_frame"), p.fps))
    met = grid.join(_by_side(tracks, PLAY_ZONES, DEEP_ZONES, teams), ["game", "camera", "frame"], "left").fillna(0, ["n_a", "n_b", "n_goalie", "deep_a", "deep_b"])
    mine = lambda x, y: F.when(F.col("team") == teams[0], F.col(x)).otherwise(F.col(y))
    return met.select(
        *row, "camera", F.col("camera").eqNullSafe(F.col("shown")).alias("assigned"), "at", F.col("at").between(F.col("start_sec"), F.col("end_sec")).alias("within"),
        mine("n_a", "n_b").alias("n_own"), mine("n_b", "n_a").alias("n_other"), "n_goalie", mine("deep_a", "deep_b").alias("n_deep"),
    )


def side_by_side(counts: DataFrame, keys: list[str], at: str, value: str, cameras: list[str]) -> DataFrame:
    """keys, at and a column for each camera, 0 where it has nothing."""
    return counts.groupBy(*keys, at).pivot("camera", cameras).agg(F.sum(value)).fillna(0, cameras)


def clip_quality(spans: DataFrame) -> DataFrame:
    """spans with quality: the smaller share of qualifying frames of the two sides."""
    return spans.withColumn("quality", F.least(F.col("off_qualifying"), F.col("def_qualifying")) / F.col("n_frames"))


def with_last_seen(frames: DataFrame, values: DataFrame, keys: list[str], frame: str, value: str) -> DataFrame:
    """Every frame with the value of the last frame that has one."""
    from . import sequence

    met = frames.join(values, [*keys, frame], "left")
    return met.withColumn(value, sequence.carried(F.col(value), keys, frame))


def camera_of(files: DataFrame, cameras: DataFrame, name: str = "name") -> DataFrame:
    """files with the camera (label) whose label or video they name; null where there is none."""
    names = cameras.select("label", F.explode(F.array_distinct(F.array("label", "video"))).alias("__name"))
    met = files.join(names, files[name] == F.col("__name"), "left")
    return met.groupBy(*files.columns).agg(F.min("label").alias("label"))


def first_untagged(rows: DataFrame, tags: DataFrame, key: str, order: str) -> DataFrame:
    """The place in the order of the first row without a tag: where tagging goes on."""
    return rows.join(tags.select(key), key, "left_anti").agg(F.min(order).alias("resume_at"))
