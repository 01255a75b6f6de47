"""Tracking over frames, and gap interpolation."""

from __future__ import annotations

import json
import math
import sys
from collections.abc import Iterable

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..params import DEFAULTS, Params
from ..sources.tables import staged

for _name in (__name__, Params.__module__):  # executors need no copy of the package
    cloudpickle.register_pickle_by_value(sys.modules[_name])

#: Frames that a task tracks at a time, and frames before them from which it guesses the tracks it starts with.
CHUNK, WARM_UP = 3000, 270
#: A track: number, team, x, y, frame it was last seen at.
Track = list


class Follower:
    """Follows the detections of the trackable teams from frame to frame.

    A detection and a track of its team may be joined if they are within reach, which grows with the
    frames since the track was seen. The closest pair is joined first, each to one; ties go to the earlier
    detection, then to the older track. A detection that is left begins a track."""

    def __init__(self, teams: Iterable[str], frame_width: float, p: Params) -> None:
        scale = frame_width / p.track_full_width
        self.teams, self.max_gap = frozenset(teams), p.track_max_gap
        self.per_frame, self.base, self.cap = p.track_px_per_frame, p.track_base_px, p.track_cap_px
        self.scale = scale

    def alive(self, tracks: list[Track], frame: int) -> list[Track]:
        return [t for t in tracks if frame - t[4] <= self.max_gap]

    def step(self, tracks: list[Track], n: int, frame: int, seen: list[tuple]) -> tuple[list[Track], int, list[int | None]]:
        """Tracks and their number after a frame, and the track of each of seen (team, x, y)."""
        tracks = self.alive(tracks, frame)
        of_team: dict[str, list] = {}
        for t in tracks:
            reach = min((self.per_frame * (frame - t[4]) + self.base) * self.scale, self.cap * self.scale)
            of_team.setdefault(t[1], []).append((t, reach))
        pairs = [(far, i, t[0]) for i, (team, x, y) in enumerate(seen) if team in self.teams for t, reach in of_team.get(team, ()) if (far := math.hypot(x - t[2], y - t[3])) <= reach]
        of_seen: dict[int, int] = {}
        joined: set[int] = set()
        for _, i, k in sorted(pairs):
            if i not in of_seen and k not in joined:
                of_seen[i] = k
                joined.add(k)
        ids: list[int | None] = []
        now = []
        for i, (team, x, y) in enumerate(seen):
            if team not in self.teams:
                ids.append(None)
                continue
            k = of_seen.get(i)
            if k is None:
                n += 1
                k = n
            ids.append(k)
            now.append([k, team, x, y, frame])
        return sorted([t for t in tracks if t[0] not in joined] + now), n, ids

    def frames(self, pdf: pd.DataFrame, tracks: list[Track], n: int) -> tuple[list[Track], int, list]:
        """As step(), over the frames of pdf, which is in order."""
        ids: list = []
        frame, team, cx, cy = (pdf[c].tolist() for c in ("frame", "team", "cx", "cy"))
        i = 0
        while i < len(frame):
            j = i
            while j < len(frame) and frame[j] == frame[i]:
                j += 1
            tracks, n, got = self.step(tracks, n, int(frame[i]), list(zip(team[i:j], cx[i:j], cy[i:j], strict=True)))
            ids += got
            i = j
        return tracks, n, ids


def in_order(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.sort_values(["frame", "det_ix"], kind="stable").reset_index(drop=True)


def _told(tracks: list[Track]) -> str:
    """What tracks are, apart from their numbers: what follows depends on these and their order alone."""
    return json.dumps([t[1:] for t in tracks])


STATE = "entry string, exit string, exit_ids array<bigint>, n_entry bigint, n_new bigint"


def track(dets: DataFrame, keys: list[str], trackable: list[str], frame_width: float = DEFAULTS.track_full_width, p: Params = DEFAULTS, chunk: int = CHUNK, warm_up: int = WARM_UP) -> DataFrame:
    """dets (keys, frame, det_ix, team, cx, cy, ...) with track_id, numbered from 1 in each of keys; null
    for teams that aren't tracked.

    Greedy matching depends on all that went before, and yet chunks of frames are tracked side by side: each
    guesses the tracks it starts with from the frames just before it. A chunk is right, but for the numbers of
    its tracks, if it started with just the tracks that the one before ended with. Those that didn't are tracked
    again from there, until all agree: each round settles one chunk more at least, and most are right at once, as
    tracks end after some frames without a detection. Numbers are then put together by sums and
    by following tracks back over borders. Jobs run at once; on the driver is a count for each round."""
    if not p.track_max_gap < chunk or not 0 <= warm_up <= chunk:
        raise ValueError("a chunk must be longer than a track's largest gap and than the warm-up")
    names, held = dets.columns, Follower(trackable, frame_width, p)
    at = [*keys, "_chunk"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dets.schema)
    schema = f"{fields}, _chunk bigint, _local bigint, {STATE}"
    state_columns = [c.split(" ")[0] for c in STATE.split(", ")]

    def made(pdf: pd.DataFrame, tracks: list[Track], number: int) -> pd.DataFrame:
        """pdf's rows with numbers of their own, and a row that tells how the chunk began and ended."""
        tracks = [[k + 1, *t[1:]] for k, t in enumerate(tracks)]
        after, n, ids = held.frames(pdf, tracks, len(tracks))
        after = held.alive(after, (number + 1) * chunk)
        out = pdf.assign(_chunk=number, _local=pd.array(ids, dtype="Int64"), **{c: None for c in state_columns})
        last = {"_chunk": number, "entry": _told(tracks), "exit": _told(after), "exit_ids": [t[0] for t in after], "n_entry": len(tracks), "n_new": n - len(tracks)}
        told = pd.DataFrame({c: pd.Series([last.get(c, None if c not in keys else pdf[c].iloc[0])], dtype=object) for c in out.columns})
        return pd.concat([out.astype(object), told], ignore_index=True)

    def guess(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        number = int(key[-1])
        pdf = in_order(pdf).drop(columns="_chunk")
        before = pdf["frame"] < number * chunk
        own = pdf[~before].reset_index(drop=True)
        if own.empty:
            return pd.DataFrame(columns=[*own.columns, "_chunk", "_local", *state_columns])
        return made(own, held.alive(held.frames(pdf[before], [], 0)[0], number * chunk), number)

    def again(key: tuple, pdf: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        tracks = [[0, *t] for t in json.loads(told["entry"].iloc[0])]
        return made(in_order(pdf).drop(columns="_chunk"), tracks, int(key[-1]))

    own = dets.withColumn("_chunk", F.floor(F.col("frame") / chunk))
    twice = F.when(F.pmod("frame", F.lit(chunk)) >= chunk - warm_up, F.array(F.col("_chunk"), F.col("_chunk") + 1)).otherwise(F.array("_chunk"))
    tables = [staged(own.withColumn("_chunk", F.explode(twice)).groupBy(*at).applyInPandas(guess, schema))]
    told = lambda df, k: df.filter("entry is not null").select(*at, *state_columns, F.lit(k).alias("_round"))
    states = staged(told(tables[0], 0))
    w = Window.partitionBy(*keys).orderBy("_chunk")
    last = lambda c: F.when(F.lag("_chunk").over(w) == F.col("_chunk") - 1, F.lag(c).over(w))
    while True:
        bad = states.withColumn("_true", F.coalesce(last("exit"), F.lit("[]"))).filter("_true <> entry").select(*at, F.col("_true").alias("entry"))
        bad = staged(bad)
        if not bad.count():
            break
        tables.append(staged(own.join(bad.select(*at), at, "left_semi").groupBy(*at).cogroup(bad.groupBy(*at)).applyInPandas(again, schema)))
        states = staged(states.join(bad.select(*at), at, "left_anti").unionByName(told(tables[-1], len(tables) - 1)))
    numbered = _numbers(states, keys, last, w)
    rows = None
    for k, t in enumerate(tables):
        t = t.filter("entry is null").select(*names, "_chunk", "_local", F.lit(k).alias("_round"))
        rows = t if rows is None else rows.unionByName(t)
    track_id = F.when(F.col("_local") <= F.col("n_entry"), F.get("_entry_ids", (F.col("_local") - 1).cast("int"))).otherwise(F.col("_local") - F.col("n_entry") + F.col("_base"))
    return rows.join(numbered, [*at, "_round"]).select(*names, track_id.alias("track_id"))


def _numbers(states: DataFrame, keys: list[str], last, w) -> DataFrame:
    """states with _base (tracks begun in earlier chunks) and _entry_ids (final numbers of the tracks it starts with)."""
    at = [*keys, "_chunk"]
    based = states.withColumn("_base", F.coalesce(F.sum("n_new").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    begun = based.select(*at, "n_entry", "_base")
    # Where each track that a chunk starts with was one chunk ago; then twice as far back in each round.
    link = states.withColumn("_ids", last("exit_ids")).select(*at, F.posexplode("_ids").alias("_pos", "_from"))
    link = link.withColumns({"_at": F.col("_chunk") - 1, "_pos": F.col("_pos") + 1})
    enters = begun.select(*keys, F.col("_chunk").alias("_at"), F.col("n_entry").alias("_n"))
    link = staged(link.join(enters, [*keys, "_at"]).withColumn("_open", F.col("_from") <= F.col("_n")).select(*at, "_pos", "_at", "_from", "_open"))
    while link.filter("_open").count():
        further = link.select(*keys, F.col("_chunk").alias("_at"), F.col("_pos").cast("bigint").alias("_from"), F.col("_at").alias("_at2"), F.col("_from").alias("_from2"), F.col("_open").alias("_open2"))
        on = link.join(further, [*keys, "_at", "_from"], "left")
        moved = lambda c: F.when(F.col("_open"), F.col(f"{c}2")).otherwise(F.col(c)).alias(c)
        link = staged(on.select(*at, "_pos", moved("_at"), moved("_from"), moved("_open")))
    origin = begun.select(*keys, F.col("_chunk").alias("_at"), F.col("n_entry").alias("_n"), "_base")
    final = link.join(origin, [*keys, "_at"]).select(*at, "_pos", (F.col("_from") - F.col("_n") + F.col("_base")).alias("_id"))
    ids = final.groupBy(*at).agg(F.sort_array(F.collect_list(F.struct("_pos", "_id"))).alias("_x")).select(*at, F.expr("transform(_x, x -> x._id)").alias("_entry_ids"))
    return based.join(ids, at, "left").select(*at, "_round", "n_entry", "_base", "_entry_ids")


def summary(tracks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, team, n_tracks, avg_detections, max_detections, n_fragments (two detections or fewer)."""
    per = tracks.filter("track_id is not null").groupBy(*keys, "team", "track_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(*keys, "team").agg(F.count(F.lit(1)).alias("n_tracks"), F.avg("n").alias("avg_detections"), F.max("n").alias("max_detections"), F.count_if(F.col("n") <= 2).alias("n_fragments"))


def gaps(tracks: DataFrame, keys: list[str], p: Params = DEFAULTS) -> DataFrame:
    """Each detection with the next of its track, the gap, and what is to be done: fill, long, far, none."""
    w = Window.partitionBy(*keys, "track_id").orderBy("frame")
    nxt = {f"next_{c}": F.lead(c).over(w) for c in ("frame", "cx", "cy", "l", "t", "r", "b", "zone")}
    g = tracks.filter("track_id is not null").withColumns(nxt).filter("next_frame is not null")
    width = ((F.col("r") - F.col("l")) + (F.col("next_r") - F.col("next_l"))) / 2.0
    far = F.hypot(F.col("next_cx") - F.col("cx"), F.col("next_cy") - F.col("cy"))
    gap = F.col("next_frame") - F.col("frame")
    what = F.when(gap <= p.stride, "none").when(gap > p.max_interp_gap, "long").when((width > 0) & (far > p.max_interp_widths * width), "far").otherwise("fill")
    return g.withColumns({"gap": gap, "action": what})


def interpolate(tracks: DataFrame, keys: list[str], p: Params = DEFAULTS) -> DataFrame:
    """The rows that fill gaps: keys, track_id, team, frame, cx, cy, l, t, r, b, zone, interpolated."""
    g = gaps(tracks, keys, p).filter("action = 'fill'")
    g = g.withColumn("__at", F.explode(F.sequence(F.col("frame") + p.stride, F.col("next_frame") - 1, F.lit(p.stride))))
    share = (F.col("__at") - F.col("frame")) / F.col("gap")
    line = lambda c: F.rint(F.col(c) + (F.col(f"next_{c}") - F.col(c)) * F.col("__share")).cast("int").alias(c)
    g = g.withColumn("__share", share)
    zone = F.when(F.col("__share") < 0.5, F.col("zone")).otherwise(F.col("next_zone"))
    return g.select(*keys, "track_id", "team", F.col("__at").alias("frame"), *[line(c) for c in ("cx", "cy", "l", "t", "r", "b")], zone.alias("zone"), F.lit(True).alias("interpolated"))
