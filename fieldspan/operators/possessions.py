"""Possession detection: bucket signal, hysteresis, segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import spatial
from ..params import BEHIND_NET, DEEP_ZONES, DEFAULTS, GOALIE, PLAY_ZONES, Params
from . import intervals, sequence

KEYS = ["game", "camera", "quarter"]
#: Frames of a bin in which frames and quarters meet.
QUARTER_BIN = 3000
Team = str | Column  # a name, or a column that has it for each row


def in_buckets(frames: DataFrame, quarters: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """frames (game, camera, frame, ...) with quarter and bucket, the number of bucket_sec steps since the
    quarter began. quarters: KEYS, first_frame, last_frame; a frame in two of them counts in both. Frames and
    quarters meet over bins, so that a camera's many quarters make no pairs with all of its frames."""
    own = quarters.select(*KEYS, F.col("first_frame").alias("__first"), F.col("last_frame").alias("__last"))
    met = intervals.binned_join(frames, own, ["game", "camera"], "frame", "__first", "__last", QUARTER_BIN)
    return met.withColumn("bucket", F.floor((F.col("frame") - F.col("__first")) / p.fps / p.bucket_sec)).drop("__first", "__last")


def durations(quarters: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """KEYS, duration: seconds from a quarter's first to its last frame."""
    return quarters.select(*KEYS, ((F.col("last_frame") - F.col("first_frame")) / p.fps).alias("duration"))


def bucket_spine(quarters: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """KEYS, bucket: every bucket that begins within a quarter, with frames or without."""
    last = F.floor(F.col("duration") / p.bucket_sec)
    return durations(quarters, p).select(*KEYS, F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("bucket"))


def _is(team: Team) -> Column:
    return F.col("team") == team


def frame_counts(tracks: DataFrame, off: Team, deff: Team) -> DataFrame:
    """KEYS, frame, bucket, off, def (the goalie counts), deep: counts in the zones of play."""
    zone = F.col("zone")
    play = zone.isin(*PLAY_ZONES)
    return tracks.groupBy(*KEYS, "frame", "bucket").agg(
        F.count_if(play & _is(off)).alias("off"), F.count_if(play & (_is(deff) | _is(GOALIE))).alias("def"), F.count_if(zone.isin(*DEEP_ZONES) & _is(off)).alias("deep")
    )


def huddles(tracks: DataFrame, off: Team, p: Params = DEFAULTS) -> DataFrame:
    """KEYS, frame, bucket, huddled: whether the offence stands close together."""
    own = tracks.filter(_is(off) & F.col("zone").isin(*PLAY_ZONES))
    got = own.groupBy(*KEYS, "frame", "bucket").agg(F.sort_array(F.collect_list(F.struct("det_ix", F.col("cx").cast("double").alias("x"), F.col("cy").cast("double").alias("y"), (F.col("r") - F.col("l")).cast("double").alias("w")))).alias("d"))
    return got.select(*KEYS, "frame", "bucket", spatial.huddled(F.col("d"), F.col("d.w"), p.huddle_players, p.huddle_ratio).alias("huddled"))


def offscreen_credit(tracks: DataFrame, off: Team, deff: Team, frame_height: float | Column, p: Params = DEFAULTS) -> DataFrame:
    """KEYS, bucket, off, def, deep: what players credit who leave at the bottom edge behind the net and
    come back in time. Every bucket from the last to the next detection counts."""
    w = Window.partitionBy(*KEYS, "track_id").orderBy("frame")
    seen = tracks.filter(F.col("track_id").isNotNull() & (_is(off) | _is(deff)))
    seen = seen.withColumns({"next_frame": F.lead("frame").over(w), "next_bucket": F.lead("bucket").over(w), "n": F.row_number().over(w)})
    gap = F.col("next_frame") - F.col("frame")
    left = (F.col("zone") == BEHIND_NET) & (F.col("cy") >= p.credit_edge_share * frame_height)
    held = seen.filter((gap > 1) & (F.col("n") >= p.credit_min_detections) & left & (gap / p.fps <= p.credit_max_sec))
    each = held.withColumn("bucket", F.explode(F.sequence("bucket", "next_bucket")))
    return each.groupBy(*KEYS, "bucket").agg(F.count_if(_is(off)).alias("off"), F.count_if(_is(deff)).alias("def"), F.count_if(_is(off)).alias("deep"))


def bucket_signal(tracks: DataFrame, spine: DataFrame, off: Team, deff: Team, credit: DataFrame | None = None, huddle: DataFrame | None = None) -> DataFrame:
    """KEYS, bucket, off, def, deep, huddled for every bucket of the spine: the largest counts of its
    frames, plus credit; a bucket without frames is 0 and false."""
    names = ("off", "def", "deep")
    none, no = {c: F.lit(0).cast("long") for c in names}, F.lit(False)

    def part(df: DataFrame, seen: dict, more: dict, close: Column) -> DataFrame:
        return df.select(*KEYS, "bucket", *[seen[c].alias(c) for c in names], *[more[c].alias(f"__{c}") for c in names], close.alias("huddled"))

    # Counts, credit and huddles in one table: one aggregate and one join with the spine.
    own = {c: F.col(c) for c in names}
    rows = part(frame_counts(tracks, off, deff), own, none, no)
    if credit is not None:
        rows = rows.unionByName(part(credit, none, own, no))
    if huddle is not None:
        rows = rows.unionByName(part(huddle, none, none, F.col("huddled")))
    got = rows.groupBy(*KEYS, "bucket").agg(*[(F.max(c) + F.sum(f"__{c}")).alias(c) for c in names], F.bool_or("huddled").alias("huddled"))
    out = spine.join(got, [*KEYS, "bucket"], "left")
    return out.select(*KEYS, "bucket", *[F.coalesce(c, F.lit(0)).alias(c) for c in names], F.coalesce("huddled", no).alias("huddled"))


def detect(signal: DataFrame, team: str, p: Params = DEFAULTS, duration: DataFrame | None = None) -> DataFrame:
    """KEYS, team, start_sec, end_sec: loose stretches bridged over short gaps, kept if they hold a
    sustained strict run; the end is padded, up to the quarter's end where duration gives it."""
    strict = (F.col("off") >= p.strict_off) & (F.col("def") >= p.strict_def) & (F.col("deep") >= p.strict_deep)
    loose = (F.col("off") >= p.loose_off) & (F.col("def") >= p.loose_def) & ~F.col("huddled")
    segments = sequence.islands(signal.filter(loose), KEYS, "bucket", p.grace_buckets)
    kept = sequence.sustained(segments, signal.filter(strict), KEYS, "bucket", p.sustained_buckets)
    end = F.col("end") * p.bucket_sec + p.end_pad_sec
    if duration is not None:
        kept, end = kept.join(duration, KEYS), F.least(end, F.col("duration"))
    return kept.select(*KEYS, F.lit(team).alias("team"), F.round(F.col("start") * p.bucket_sec, 1).alias("start_sec"), F.round(end, 1).alias("end_sec"))


def match_check(official: DataFrame, detected: DataFrame, keys: list[str], within: float) -> DataFrame:
    """team, n_official, n_matched: official intervals that a detected one overlaps to within so much."""
    hit = intervals.matched(official, detected, keys, within).withColumn("__hit", F.lit(1)).select("seq", "__hit")
    return official.join(hit, "seq", "left").groupBy("team").agg(F.count(F.lit(1)).alias("n_official"), F.coalesce(F.sum("__hit"), F.lit(0)).alias("n_matched"))


def count_deltas(detected: DataFrame, official: DataFrame) -> DataFrame:
    """team, n_detected, n_official, delta; teams of either side."""
    both = detected.select("team", F.lit(1).alias("d"), F.lit(0).alias("o")).unionByName(official.select("team", F.lit(0).alias("d"), F.lit(1).alias("o")))
    return both.groupBy("team").agg(F.sum("d").alias("n_detected"), F.sum("o").alias("n_official")).withColumn("delta", F.col("n_detected") - F.col("n_official"))


def apply_corrections(rows: DataFrame, tags: DataFrame, key: str) -> DataFrame:
    """rows with end_sec replaced where a tag gives a later time than the start; corrected tells."""
    fix = tags.select(key, F.col("corrected_end_sec").alias("__end"))
    good = F.col("__end").isNotNull() & (F.col("__end") > F.col("start_sec"))
    met = rows.join(fix, key, "left").withColumn("corrected", F.coalesce(good, F.lit(False)))
    return met.withColumn("end_sec", F.when(F.col("corrected"), F.col("__end")).otherwise(F.col("end_sec"))).drop("__end")
