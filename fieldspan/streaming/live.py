"""Streaming variants: bucket counts, grace sessions, a tracker and possessions with state and timers, and sinks that
write each batch once."""

from __future__ import annotations

import json
import math
import sys

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators import tracking
from ..params import DEFAULTS, Params

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package


def bucket_counts(events: DataFrame, ts: str = "ts", key: str = "event_type", width: str = "500 milliseconds", late: str = "10 seconds") -> DataFrame:
    """start, key, n: tumbling buckets; rows later than the watermark are left out."""
    got = events.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count(F.lit(1)).alias("n"))
    return got.select(F.col("window.start").alias("start"), key, "n")


def grace_sessions(events: DataFrame, ts: str = "ts", key: str = "user_id", gap: str = "9500 milliseconds", late: str = "1 minute") -> DataFrame:
    """key, start, end, n: sessions that go on over gaps up to and including this one."""
    got = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count(F.lit(1)).alias("n"))
    return got.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def write_batches(stream: DataFrame, path: str, checkpoint: str):
    """Start a query that writes each batch under its own number: one written again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _pack(pdf: pd.DataFrame) -> bytes:
    """Rows as an Arrow stream, for a state."""
    table = pa.Table.from_pandas(pdf, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpack(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_all().to_pandas()


def _millis(ts: pd.Series) -> pd.Series:
    return ts.astype("datetime64[ns]").astype("int64") // 1_000_000


def track_stream(dets: DataFrame, keys: list[str], trackable: list[str], ts: str = "ts", late: str = "10 seconds", frame_width: float = DEFAULTS.track_full_width, p: Params = DEFAULTS) -> DataFrame:
    """dets (keys, frame, det_ix, team, cx, cy, ts, ...) with track_id, as operators.tracking.track gives it, in whatever
    order frames arrive. ts: a frame's time, the same for all of its rows and rising with frame.

    A frame waits in the state until the watermark has passed its time: no row of it or of an earlier one
    can come after that, as later ones are left out. Then frames are followed in order. The
    state of one of keys is its waiting frames, which the watermark bounds, its live tracks, and how many
    tracks it has had. A timer goes off when the next waiting frame is due, so frames come out though their camera
    has fallen silent, and when all tracks have ended, which leaves the number alone."""
    held = tracking.Follower(trackable, frame_width, p)
    span = int(1000 * (p.track_max_gap + 1) / p.fps)

    def run(key, batches, state):
        data, told, n, last = state.get if state.exists else (None, "[]", 0, 0)
        parts = [_unpack(data)] if data else []
        tracks, now = json.loads(told), state.getCurrentWatermarkMs()
        if not state.hasTimedOut:
            parts += list(batches)
        pdf = pd.concat(parts, ignore_index=True) if parts else None
        if pdf is not None and len(pdf):
            at = _millis(pdf[ts])
            due, pdf = tracking.in_order(pdf[at <= now]), pdf[at > now]
            if len(due):
                tracks, n, ids = held.frames(due, tracks, n)
                last = int(_millis(due[ts]).max())
                yield due.assign(track_id=pd.array(ids, dtype="Int64"))
        waiting = pdf is not None and len(pdf) > 0
        if tracks and not waiting and now > last + span:
            tracks = []
        state.update((_pack(pdf) if waiting else None, json.dumps(tracks), n, last))
        if waiting:
            state.setTimeoutTimestamp(max(int(_millis(pdf[ts]).min()), now + 1))
        elif tracks:
            state.setTimeoutTimestamp(max(last + span, now) + 1)

    return dets.withWatermark(ts, late).groupBy(*keys).applyInPandasWithState(run, f"{_schema(dets)}, track_id bigint", "held binary, tracks string, n bigint, last bigint", "append", GroupStateTimeout.EventTimeTimeout)


class Hysteresis:
    """Possessions out of buckets in order, as operators.possessions.detect() finds them, with a state that
    doesn't grow: the open stretch of loose buckets (its first and last one, the longest strict run in
    it, and the longest one that reaches past its last loose bucket), and the strict run that goes on."""

    def __init__(self, p: Params) -> None:
        self.p = p

    def levels(self, off: int, deff: int, deep: int, huddled: bool) -> tuple[bool, bool]:
        p = self.p
        return off >= p.loose_off and deff >= p.loose_def and not huddled, off >= p.strict_off and deff >= p.strict_def and deep >= p.strict_deep

    def closed(self, open_: dict, before: int) -> bool:
        """Whether the stretch has ended if no bucket below this one is to come and this one is the next."""
        return bool(open_.get("first") is not None and before - open_["last"] - 1 > self.p.grace_buckets)

    def take(self, open_: dict) -> tuple[int, int] | None:
        """End the stretch: its first bucket and the one after its last, if a strict run in it is long enough."""
        first, last, best = (open_.pop(k) for k in ("first", "last", "best"))
        open_.pop("beyond")
        return (first, last + 1) if best >= self.p.sustained_buckets else None

    def step(self, open_: dict, bucket: int, loose: bool, strict: bool) -> tuple[int, int] | None:
        found = None
        if loose and self.closed(open_, bucket):
            found = self.take(open_)
        if loose and open_.get("first") is None:
            open_ |= {"first": bucket, "best": 0, "beyond": 0}
        if strict:
            if open_.get("strict_last") != bucket - 1:
                open_["strict_first"] = bucket
            open_["strict_last"] = bucket
            if open_.get("first") is not None:
                open_["beyond"] = max(open_["beyond"], bucket - max(open_["strict_first"], open_["first"]) + 1)
        if loose:
            open_ |= {"last": bucket, "best": max(open_["best"], open_["beyond"])}
        return found


def _possession(key: tuple, span: tuple[int, int], duration: float | None, p: Params) -> tuple:
    end = span[1] * p.bucket_sec + p.end_pad_sec
    return (*key, round(span[0] * p.bucket_sec, 1), round(end if duration is None else min(end, duration), 1))


def possessions_stream(counts: DataFrame, keys: list[str], ts: str = "ts", late: str = "10 seconds", p: Params = DEFAULTS) -> DataFrame:
    """keys, start_sec, end_sec of possessions, each as soon as the watermark says that it is over.

    counts: a row for each frame: keys, t (seconds since the quarter began), off, def, deep, huddled (null: no), ts, and
    if need be duration (of the quarter; ends are cut there). Frames may come in any order within the
    watermark. A bucket's counts are its frames' largest, kept until the watermark has passed the bucket;
    then buckets go through Hysteresis in order. A stretch comes out once no bucket that could carry it on can come any more,
    by a timer if need be. With neither waiting buckets nor an open stretch the state goes."""
    machine, step = Hysteresis(p), round(1000 * p.bucket_sec)
    with_end = "duration" in counts.columns

    def run(key, batches, state):
        got = json.loads(state.get[0]) if state.exists else {"wait": {}, "open": {}, "began": None, "duration": None}
        wait, open_, now = got["wait"], got["open"], state.getCurrentWatermarkMs()
        if not state.hasTimedOut:
            for pdf in batches:
                if len(pdf):
                    began = (_millis(pdf[ts]) - (1000 * pdf["t"]).round().astype("int64")).min()
                    got["began"] = int(began if got["began"] is None else min(got["began"], began))
                    if with_end:
                        got["duration"] = float(pdf["duration"].iloc[0])
                    pdf = pdf.assign(b=(pdf["t"] / p.bucket_sec).apply(math.floor), huddled=pdf["huddled"].fillna(False).astype(bool))
                    for b, *new in pdf.groupby("b")[["off", "def", "deep", "huddled"]].max().itertuples(name=None):
                        old = wait.get(str(b), [0, 0, 0, False])
                        wait[str(b)] = [max(x, type(x)(y)) for x, y in zip(old, new, strict=True)]
        found = []
        if got["began"] is not None:
            over = (now - got["began"]) // step  # buckets below this one are complete
            for b in sorted(int(x) for x in wait if int(x) < over):
                found.append(machine.step(open_, b, *machine.levels(*wait.pop(str(b)))))
            nearest = min(map(int, wait), default=over)
            if machine.closed(open_, min(nearest, over)):
                found.append(machine.take(open_))
        found = [_possession(key, x, got["duration"], p) for x in found if x]
        if found:
            yield pd.DataFrame(found, columns=[*keys, "start_sec", "end_sec"])
        due = [int(min(map(int, wait))) + 1] if wait else []
        if open_.get("first") is not None:
            due.append(open_["last"] + p.grace_buckets + 2)
        if due:
            state.update((json.dumps(got),))
            state.setTimeoutTimestamp(max(got["began"] + min(due) * step, now + 1))
        elif state.exists:
            state.remove()

    kinds = {f.name: f.dataType.simpleString() for f in counts.schema}
    out = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", start_sec double, end_sec double"
    return counts.withWatermark(ts, late).groupBy(*keys).applyInPandasWithState(run, out, "told string", "append", GroupStateTimeout.EventTimeTimeout)


def possessions_of(signal: DataFrame, keys: list[str], p: Params = DEFAULTS) -> DataFrame:
    """possessions_stream() over buckets that are all there: keys, bucket, off, def, deep, huddled, and if need be duration."""
    machine = Hysteresis(p)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, open_, found = pdf.sort_values("bucket"), {}, []
        duration = float(pdf["duration"].iloc[0]) if "duration" in pdf else None
        for b, *levels in pdf[["bucket", "off", "def", "deep", "huddled"]].itertuples(index=False, name=None):
            found.append(machine.step(open_, int(b), *machine.levels(*levels)))
        if open_.get("first") is not None:
            found.append(machine.take(open_))
        return pd.DataFrame([_possession(key, x, duration, p) for x in found if x], columns=[*keys, "start_sec", "end_sec"])

    kinds = {f.name: f.dataType.simpleString() for f in signal.schema}
    out = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", start_sec double, end_sec double"
    return signal.groupBy(*keys).applyInPandas(run, out)
