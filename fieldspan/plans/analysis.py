"""The whole of possession detection: signal, segments, split, reasons, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import spatial
from ..operators import intervals, possessions
from ..operators.possessions import KEYS
from ..params import DEFAULTS, Params
from ..sources.tables import staged


def detect_all(tracks: DataFrame, spine: DataFrame, defends: DataFrame, cal: spatial.Calibration, teams: tuple[str, str], p: Params = DEFAULTS, duration: DataFrame | None = None) -> DataFrame:
    """KEYS, team, other, start_sec, end_sec of both teams. defends: KEYS, def_team; a camera and quarter
    whose defender isn't known has no signal. One pass over tracks serves both teams: who attacks is
    a column. What is partitioned by KEYS stays so up to the segments.

    duration: KEYS, duration, from the quarters' frames; without it a quarter lasts as long as its
    buckets, which is up to one bucket too much. Numbers of cal may be columns of tracks."""
    a, b = teams
    off = F.when(F.col("def_team") == a, b).otherwise(a)
    sides = defends.filter("def_team is not null").select(*KEYS, "def_team", off.alias("off_team"))
    met = tracks.join(sides, KEYS)
    own = met.filter(~spatial.beyond_cutoff(F.col("cy"), F.col("zone"), cal, p.perimeter_share))
    o, d = F.col("off_team"), F.col("def_team")
    credit = possessions.offscreen_credit(met, o, d, cal.frame_height, p)
    signal = possessions.bucket_signal(own, spine.join(sides.select(*KEYS), KEYS), o, d, credit, possessions.huddles(own, o, p))
    if duration is None:
        duration = spine.groupBy(*KEYS).agg((F.count(F.lit(1)) * p.bucket_sec).alias("duration"))
    got = possessions.detect(signal, "", p, duration).drop("team")
    return got.join(sides, KEYS).select(*KEYS, F.col("off_team").alias("team"), F.col("def_team").alias("other"), "start_sec", "end_sec")


def detect_frames(tracks: DataFrame, quarters: DataFrame, defends: DataFrame, lines: DataFrame, teams: tuple[str, str], p: Params = DEFAULTS) -> DataFrame:
    """detect_all() over frames as files have them. tracks: game, camera, frame and the detection's
    fields; quarters: KEYS, first_frame, last_frame; lines: game, camera, yard8_y, yard30_y,
    frame_height (each camera's own)."""
    cal = spatial.Calibration(None, F.col("yard8_y"), F.col("yard30_y"), (), None, F.col("frame_height"))
    seen = possessions.in_buckets(tracks, quarters, p).join(lines.select("game", "camera", "yard8_y", "yard30_y", "frame_height"), ["game", "camera"])
    return detect_all(seen, possessions.bucket_spine(quarters, p), defends, cal, teams, p, possessions.durations(quarters, p))


def with_records(found: DataFrame, official: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """found split where records of the other team lie within long blocks, with the reason of the
    nearest record and the camera of the block. official: game, quarter, seq, team, start_sec,
    end_sec, end_reason. Blocks of a camera can overlap, as their ends are padded: a record that two of
    them hold is one possession."""
    keys = ["game", "quarter"]
    pieces = intervals.split_blocks(staged(found), official, [*keys], p.long_block_sec, p.split_buffer_sec, ["camera"]).distinct()
    out = intervals.nearest_reason(pieces, official, [*keys, "team"])
    long = F.col("end_sec") - F.col("start_sec")
    return out.withColumns({"duration_sec": F.round(long, 1), "long": long > p.long_block_sec, "end_reason": F.coalesce("end_reason", F.lit("unknown"))})


def checks(final: DataFrame, official: DataFrame, p: Params = DEFAULTS) -> dict[str, DataFrame]:
    """Counts by team with their difference, and how many records have a detected interval near them."""
    return {"counts": possessions.count_deltas(final, official), "matched": possessions.match_check(official, final, ["game", "quarter", "team"], p.match_window_sec)}
