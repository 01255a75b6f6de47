"""Clock alignment: windows, markers matched to windows, anchors, piecewise-linear time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spatial
from ..params import DEFAULTS, GOALIE, NEAR_NET_ZONES, Params
from . import intervals, sequence
from .possessions import QUARTER_BIN


def near_net(tracks: DataFrame, frames: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """game, camera, frame, near, huddled for every row of frames: how many players are near the net, and
    whether those of them that are no goalies stand close together; 0 and false without detections."""
    keys = ["game", "camera", "frame"]
    player = F.struct("det_ix", F.col("cx").cast("double").alias("x"), F.col("cy").cast("double").alias("y"), (F.col("r") - F.col("l")).cast("double").alias("w"))
    seen = tracks.filter(F.col("zone").isin(*NEAR_NET_ZONES))
    got = seen.groupBy(*keys).agg(F.count(F.lit(1)).alias("near"), F.sort_array(F.collect_list(F.when(~F.col("team").eqNullSafe(F.lit(GOALIE)), player))).alias("d"))
    got = got.select(*keys, "near", spatial.huddled(F.col("d"), F.col("d.w"), p.huddle_players, p.huddle_ratio).alias("huddled"))
    out = frames.select(*keys).join(got, keys, "left")
    return out.select(*keys, F.coalesce("near", F.lit(0)).alias("near"), F.coalesce("huddled", F.lit(False)).alias("huddled"))


def timeline(signals: DataFrame, quarters: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """game, quarter, bucket, near, huddled out of near_net(): each camera's nearest frame at every bucket,
    the cameras combined. quarters: game, camera, quarter, first_frame, last_frame; of quarters that
    hold a frame the first counts. A bucket is a whole number of frames."""
    step = int(p.fps * p.bucket_sec)
    own = quarters.select("game", "camera", "quarter", "first_frame", "last_frame")
    met = intervals.binned_join(signals, own, ["game", "camera"], "frame", "first_frame", "last_frame", QUARTER_BIN)
    first = met.groupBy("game", "camera", "frame").agg(F.min(F.struct("quarter", "first_frame")).alias("q"), F.first(F.struct("near", "huddled")).alias("v"))
    first = first.select("game", "camera", "q.quarter", (F.col("frame") - F.col("q.first_frame")).alias("t"), "v")
    grid = sequence.resample_nearest(first, ["game", "camera", "quarter"], "t", "v", step)
    return combine_cameras(grid.select("game", "quarter", F.expr(f"t div {step}").alias("bucket"), "v.near", "v.huddled"), ["game", "quarter"], "bucket")


def combine_cameras(counts: DataFrame, keys: list[str], t: str) -> DataFrame:
    """keys, t, near, huddled: the larger count and either flag of the cameras; a missing one is 0, false."""
    return counts.groupBy(*keys, t).agg(F.max("near").alias("near"), F.bool_or("huddled").alias("huddled"))


def windows(samples: DataFrame, keys: list[str], t: str, p: Params = DEFAULTS, step: float = 1) -> DataFrame:
    """keys, kind (quiet, huddle), start_sec, end_sec: runs of few players near the net, or of huddles.
    samples stand at t = 0, step, 2 step ...; a run ends where the sample after its last one begins."""

    def kind(name, flag, least):
        found = sequence.low_stretches(samples, keys, t, flag).filter(F.col("n") >= least)
        return found.select(*keys, F.lit(name).alias("kind"), F.col("first").alias("start_sec"), (F.col("last") + step).alias("end_sec"))

    return kind("quiet", F.col("near") <= p.quiet_count, p.quiet_samples).unionByName(kind("huddle", F.col("huddled"), p.huddle_samples))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _greedy(marks: Column, left: Column, radius: float) -> Column:
    """Array of structs at, to. marks: structs t, guess, in the order in which they choose; left: structs seq, mid.
    A marker takes the nearest window that is left (of those as near, the first) if it is near enough."""

    def choose(state: Column, m: Column) -> Column:
        nearest = F.array_min(F.transform(state["left"], lambda w, i: F.struct(F.abs(w["mid"] - m["guess"]).alias("far"), i.alias("i"))))

        def take(n: Column) -> Column:
            rest = F.filter(state["left"], lambda _, i: i != n["i"])
            made = F.struct(m["t"].alias("at"), F.get(state["left"], n["i"])["mid"].alias("to"))
            return F.when(n["far"] < radius, F.struct(rest.alias("left"), F.array_append(state["out"], made).alias("out"))).otherwise(state)

        return _let(nearest, take)

    none = F.array().cast("array<struct<at:double,to:double>>")
    return F.aggregate(marks, F.struct(left.alias("left"), none.alias("out")), choose, lambda state: state["out"])


def match_markers(markers: DataFrame, spans: DataFrame, keys: list[str], duration: str = "duration", p: Params = DEFAULTS) -> DataFrame:
    """keys, at (marker time), to (middle of its window). markers: keys, elapsed_sec, delay, duration.

    One-to-one and in order of time: a row for each of keys (a quarter) holds its markers and windows, and a fold
    over the markers takes windows away. A marker without a time or a guess and a window without a middle match nothing."""
    t, length, delay = (F.col(c).cast("double") for c in ("elapsed_sec", duration, "delay"))
    guess = (t + delay) / p.period_sec * length
    mid = ((F.col("start_sec") + F.col("end_sec")) / 2).cast("double")
    mark, window = "struct<t:double,guess:double>", "struct<seq:double,mid:double>"
    m = markers.select(*keys, F.struct(t.alias("t"), guess.alias("guess")).alias("mark"), F.lit(None).cast(window).alias("window")).filter("mark.guess IS NOT NULL")
    s = spans.select(*keys, F.lit(None).cast(mark).alias("mark"), F.struct(F.col("start_sec").cast("double").alias("seq"), mid.alias("mid")).alias("window")).filter("window.mid IS NOT NULL")
    both = m.unionByName(s).groupBy(*keys).agg(F.sort_array(F.collect_list("mark")).alias("marks"), F.sort_array(F.collect_list("window")).alias("windows"))
    return both.select(*keys, F.inline(_greedy(F.col("marks"), F.col("windows"), p.anchor_radius_sec)))


def _bends(a: Column, b: Column, c: Column, scale: Column, ratio: float) -> Column:
    """Whether the slopes before and after b, the anchor between a and c, are both off by more than ratio."""
    off = lambda s: (s > scale * ratio) | (s < scale / ratio)
    ahead = lambda u, v: (v["to"] - u["to"]) / F.nullif(v["at"] - u["at"], F.lit(0.0))
    return F.coalesce(off(ahead(a, b)) & off(ahead(b, c)), F.lit(False))


def _straightened(points: Column, scale: Column, ratio: float) -> Column:
    """points without inner ones that bend both their segments, the first of these always taken out first.

    Points are laid on a pile. A new one may make those below it bend, from the top down: taking one out changes
    nothing but the triples around it, and those below were right."""

    def lay(pile: Column, q: Column) -> Column:
        top = lambda kept, k: F.get(kept, F.size(kept) - k)
        cut = lambda kept: F.when((F.size(kept) > 1) & _bends(top(kept, 2), top(kept, 1), q, scale, ratio), F.slice(kept, 1, F.size(kept) - 1)).otherwise(kept)
        return F.array_append(F.aggregate(pile, pile, lambda kept, _: cut(kept)), q)

    return F.aggregate(points, F.array().cast("array<struct<at:double,to:double>>"), lay)


def filter_anchors(anchors: DataFrame, keys: list[str], duration: str = "duration", p: Params = DEFAULTS) -> DataFrame:
    """Anchors without those that bend both their segments. anchors: keys, at, to, duration. Equal ones count once,
    those without a time or a value not at all; a quarter's are one row."""
    point = F.struct(F.col("at").cast("double").alias("at"), F.col("to").cast("double").alias("to"))
    known = anchors.filter("at IS NOT NULL AND `to` IS NOT NULL")
    rows = known.groupBy(*keys).agg(F.sort_array(F.collect_set(point)).alias("points"), F.min(F.col(duration).cast("double")).alias("length"))
    return rows.select(*keys, F.inline(_straightened(F.col("points"), F.col("length") / p.period_sec, p.bad_anchor_ratio)))


def align(official: DataFrame, markers: DataFrame, spans: DataFrame, quarters: DataFrame, keys: list[str], p: Params = DEFAULTS) -> DataFrame:
    """official with start_sec and end_sec in video time. markers: keys, kind, elapsed_sec (quiet:
    stoppages, huddle: goals); spans: windows(); quarters: keys, duration. Rows of a quarter that
    isn't there are left out."""
    delay = F.when(F.col("kind") == "huddle", p.goal_delay_sec).otherwise(0.0)
    m = markers.join(quarters, keys).withColumn("delay", delay)
    found = match_markers(m, spans.join(quarters.select(*keys), keys), [*keys, "kind"], p=p).select(*keys, "at", "to")
    ends = quarters.select(*keys, F.explode(F.array(F.struct(F.lit(0.0).alias("at"), F.lit(0.0).alias("to")), F.struct(F.lit(p.period_sec).alias("at"), F.col("duration").cast("double").alias("to")))).alias("e")).select(*keys, "e.at", "e.to")
    anchors = filter_anchors(found.unionByName(ends).distinct().join(quarters, keys), keys, p=p)
    out = intervals.piecewise(official, anchors, keys, "start_sec", "__s")
    out = intervals.piecewise(out, anchors, keys, "end_sec", "__e")
    s, e = F.round("__s", 1), F.round("__e", 1)
    return out.withColumns({"start_sec": s, "end_sec": e, "duration_sec": F.round(F.col("__e") - F.col("__s"), 1)}).drop("__s", "__e")


def align_frames(tracks: DataFrame, frames: DataFrame, quarters: DataFrame, official: DataFrame, stoppages: DataFrame, goals: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """official (game, quarter, start_sec, end_sec, ...) in video time, from tracks alone: windows out of
    both cameras' frames, stoppages matched to quiet and goals to huddled ones. The first camera's
    quarters (camera_ix 0) say how long a quarter is and which there are."""
    keys = ["game", "quarter"]
    spans = windows(timeline(near_net(tracks, frames, p), quarters, p), keys, "bucket", p)
    spans = spans.withColumns({c: F.col(c) * p.bucket_sec for c in ("start_sec", "end_sec")})
    kind = lambda df, k: df.select(*keys, F.lit(k).alias("kind"), "elapsed_sec")
    marks = kind(stoppages, "quiet").unionByName(kind(goals, "huddle"))
    length = quarters.filter("camera_ix = 0").select(*keys, ((F.col("last_frame") - F.col("first_frame")) / p.fps).alias("duration"))
    return align(official, marks, spans, length, keys, p)
