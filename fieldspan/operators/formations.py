"""Formations (zone histograms per frame) and cuts (zone changes per track), as such and per possession."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import clock
from ..params import BEHIND_NET, CUT_ZONES, DEFAULTS, FORMATION_ZONES, GOALIE, NET_TO_8, PERIMETER, Params
from . import intervals, sequence

#: What tells possessions apart, and the columns that go with it.
ID = ["game", "camera", "quarter", "team", "other", "start_sec", "end_sec"]
BIN_FRAMES = 900


def frame_formations(tracks: DataFrame, keys: list[str], floor: int = DEFAULTS.roster_floor) -> DataFrame:
    """keys, frame, formation (counts behind the net, near it, on the perimeter) of frames with floor players or more."""
    n = lambda z: F.count_if(F.col("zone") == z)
    got = tracks.groupBy(*keys, "frame").agg(n(BEHIND_NET).alias("bn"), n(NET_TO_8).alias("n8"), n(PERIMETER).alias("pm"))
    return got.filter(F.col("bn") + F.col("n8") + F.col("pm") >= floor).select(*keys, "frame", F.struct("bn", "n8", "pm").alias("formation"))


def histogram(frames: DataFrame, keys: list[str]) -> DataFrame:
    """keys, formation, cnt, first_frame."""
    return frames.groupBy(*keys, "formation").agg(F.count(F.lit(1)).alias("cnt"), F.min("frame").alias("first_frame"))


def dominant(hist: DataFrame, keys: list[str]) -> DataFrame:
    """keys, formation, cnt: the most frequent, of those as frequent the first seen; and the whole
    histogram as a map with text keys."""
    best = F.max_by(F.struct("formation", "cnt"), F.struct(F.col("cnt"), -F.col("first_frame"))).alias("best")
    text = F.format_string("(%d, %d, %d)", "formation.bn", "formation.n8", "formation.pm")
    got = hist.groupBy(*keys).agg(best, F.map_from_entries(F.sort_array(F.collect_list(F.struct(text.alias("k"), F.col("cnt").alias("v"))))).alias("distribution"), F.sum("cnt").alias("n_qualifying"))
    return got.select(*keys, F.col("best.formation").alias("formation"), F.col("best.cnt").alias("cnt"), "n_qualifying", "distribution")


def top(hist: DataFrame, keys: list[str], k: int = 3) -> DataFrame:
    """keys, rank, formation, cnt, total."""
    w = Window.partitionBy(*keys)
    ranked = hist.withColumns({"rank": F.row_number().over(w.orderBy(F.desc("cnt"), "first_frame")), "total": F.sum("cnt").over(w)})
    return ranked.filter(F.col("rank") <= k).select(*keys, "rank", "formation", "cnt", "total")


def frequency(best: DataFrame, team: str = "team") -> DataFrame:
    """team, formation, n, total: how often a formation is the dominant one."""
    got = best.groupBy(team, "formation").agg(F.count(F.lit(1)).alias("n"))
    return got.withColumn("total", F.sum("n").over(Window.partitionBy(team)))


def cut_events(tracks: DataFrame, keys: list[str], least: int = DEFAULTS.min_zone_run) -> DataFrame:
    """keys, frame, direction: changes between the perimeter and the zone near the net, between runs
    of so many samples or more; shorter runs are left out before neighbours are compared, and samples
    in other zones before runs are made."""
    runs = sequence.runs(tracks.filter(F.col("zone").isin(*CUT_ZONES)), keys, "frame", "zone").filter(F.col("n") >= least)
    before = F.lag("zone").over(Window.partitionBy(*keys).orderBy("first"))
    way = F.when((before == PERIMETER) & (F.col("zone") == NET_TO_8), "in").when((before == NET_TO_8) & (F.col("zone") == PERIMETER), "out")
    return runs.withColumn("direction", way).filter("direction is not null").select(*keys, F.col("first").alias("frame"), "direction")


def cut_counts(cuts: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """keys of spans, n_cuts_in, n_cuts_out, suspect_zero_cuts."""
    got = cuts.groupBy(*keys).agg(F.count_if(F.col("direction") == "in").alias("n_cuts_in"), F.count_if(F.col("direction") == "out").alias("n_cuts_out"))
    out = spans.select(*keys).distinct().join(got, keys, "left").fillna(0, ["n_cuts_in", "n_cuts_out"])
    return out.withColumn("suspect_zero_cuts", F.col("n_cuts_in") + F.col("n_cuts_out") == 0)


# --- per possession ---------------------------------------------------------------------------
def within(rows: DataFrame, spans: DataFrame, quarters: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """rows (game, camera, frame, ...) that lie in the frames of a possession, with ID; their own team
    is called player. spans: ID; quarters: game, camera, quarter, first_frame."""
    s = spans.select(*ID).join(quarters.select("game", "camera", "quarter", "first_frame"), ["game", "camera", "quarter"])
    s = s.withColumns({"__low": clock.to_frame(F.col("start_sec"), F.col("first_frame"), p.fps), "__high": clock.to_frame(F.col("end_sec"), F.col("first_frame"), p.fps)})
    own = rows.drop("quarter", "bucket").withColumnRenamed("team", "player")
    return intervals.binned_join(own, s, ["game", "camera"], "frame", "__low", "__high", BIN_FRAMES).drop("__low", "__high", "first_frame")


def of_possessions(tracks: DataFrame, frames: DataFrame, spans: DataFrame, quarters: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """ID, n_frames, and of each side (off: the holder; def: the other team and goalies) formation,
    distribution and n_qualifying (null, null and 0 without a frame that counts).

    A frame counts for a side that has roster_floor players or more in the zones of formations; rows
    that were filled in don't count. frames: game, camera, frame of all frames, with detections or not."""
    seen = tracks.filter(~F.coalesce("interpolated", F.lit(False)) & F.col("zone").isin(*FORMATION_ZONES)).select("game", "camera", "frame", "team", "zone")
    met = within(seen, spans, quarters, p)
    side = F.when(F.col("player") == F.col("team"), "off").when(F.col("player").isin(F.col("other"), F.lit(GOALIE)), "def")
    keys = [*ID, "side"]
    best = dominant(histogram(frame_formations(met.withColumn("side", side).filter("side is not null"), keys, p.roster_floor), keys), keys)
    of = lambda s, c: F.first(F.when(F.col("side") == s, F.col(c)), ignorenulls=True).alias(f"{s}_{c}")
    both = best.groupBy(*ID).agg(*[of(s, c) for s in ("off", "def") for c in ("formation", "distribution", "n_qualifying")])
    n = within(frames.select("game", "camera", "frame"), spans, quarters, p).groupBy(*ID).agg(F.count(F.lit(1)).alias("n_frames"))
    out = spans.select(*ID).join(n, ID, "left").join(both, ID, "left")
    return out.fillna(0, ["n_frames", "off_n_qualifying", "def_n_qualifying"])


def frequency_by_side(per: DataFrame) -> DataFrame:
    """side, team, formation, n, total: how often a team's formation is dominant, attacking and defending."""
    each = per.select(F.explode(F.array(F.struct(F.lit("off").alias("side"), F.col("team").alias("team"), F.col("off_formation").alias("formation")), F.struct(F.lit("def").alias("side"), F.col("other").alias("team"), F.col("def_formation").alias("formation")))).alias("x"))
    got = each.select("x.*").filter("formation is not null").groupBy("side", "team", "formation").agg(F.count(F.lit(1)).alias("n"))
    return got.withColumn("total", F.sum("n").over(Window.partitionBy("side", "team")))


def cuts_of_possessions(tracks: DataFrame, spans: DataFrame, quarters: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """ID, n_cuts_in, n_cuts_out, n_tracks (of the holder's players), cuts (frame, direction, track_id, in
    order), suspect_zero_cuts. Rows that were filled in count."""
    seen = tracks.filter(F.col("track_id").isNotNull() & F.col("zone").isin(*CUT_ZONES)).select("game", "camera", "frame", "team", "zone", "track_id")
    met = within(seen, spans, quarters, p).filter(F.col("player") == F.col("team"))
    per_track = met.groupBy(*ID, "track_id").agg(F.lit(1).alias("one")).groupBy(*ID).agg(F.count(F.lit(1)).alias("n_tracks"))
    way = lambda d: F.count_if(F.col("direction") == d).alias(f"n_cuts_{d}")
    cuts = cut_events(met, [*ID, "track_id"], p.min_zone_run).groupBy(*ID).agg(way("in"), way("out"), F.sort_array(F.collect_list(F.struct("frame", "direction", "track_id"))).alias("cuts"))
    out = spans.select(*ID).join(per_track, ID, "left").join(cuts, ID, "left").fillna(0, ["n_tracks", "n_cuts_in", "n_cuts_out"])
    empty = F.array().cast(cuts.schema["cuts"].dataType)
    return out.withColumns({"cuts": F.coalesce("cuts", empty), "suspect_zero_cuts": F.col("n_cuts_in") + F.col("n_cuts_out") == 0})


def cuts_by_team(per: DataFrame) -> DataFrame:
    """team, cuts_in, cuts_out, possessions_with_cuts, n_possessions."""
    return per.groupBy("team").agg(F.sum("n_cuts_in").alias("cuts_in"), F.sum("n_cuts_out").alias("cuts_out"), F.count_if(~F.col("suspect_zero_cuts")).alias("possessions_with_cuts"), F.count(F.lit(1)).alias("n_possessions"))
