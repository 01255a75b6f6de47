"""Queries over the driver's tables, one for each operator, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import clock, spatial
from ..operators import align, colours, diagnostics, formations, intervals, pbp, possessions, reconcile, report, sampling, sequence, tracking
from ..params import PERIMETER
from ..sources import tables
from ..streaming import live
from . import adapters as A
from . import analysis
from .adapters import CAL, LINES_SQL, SIX_HOURS, SPINE_SQL, TIMED_SQL, TRK_SQL, P, islands_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
K = ["quarter"]


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


# --- possessions over the bucket signal -------------------------------------------------------
COUNTS_SQL = f"""{TRK_SQL},
f AS (SELECT quarter, bucket, count(*) FILTER (zone <> 'Beyond 30' AND team = 'A') AS off, count(*) FILTER (zone <> 'Beyond 30' AND team <> 'A') AS def,
        count(*) FILTER (zone IN ('Behind Net', 'Net-to-8') AND team = 'A') AS deep FROM trk GROUP BY 1, 2)"""
DETECT_SQL = f"""{COUNTS_SQL},
loose AS (SELECT * FROM f WHERE off >= 4 AND def >= 4),
strict AS (SELECT * FROM loose WHERE deep >= 3),
seg AS {islands_sql('loose', 'quarter', 'bucket', 1)},
run AS {islands_sql('strict', 'quarter', 'bucket', 0)},
det AS (SELECT DISTINCT seg.quarter, 'A' AS team, seg.s * 0.5::DOUBLE AS start_sec, seg.e * 0.5::DOUBLE + 4 AS end_sec
        FROM seg JOIN run ON seg.quarter = run.quarter AND least(seg.e, run.e) - greatest(seg.s, run.s) >= 3)"""


def signal(spark: SparkSession, d: str) -> DataFrame:
    return possessions.bucket_signal(A.tracks(spark, d), A.spine(spark, d), "A", "B")


def detected(spark: SparkSession, d: str) -> DataFrame:
    return possessions.detect(signal(spark, d), "A", P)


@query(f"WITH {DETECT_SQL} SELECT * FROM det")
def possessions_detected(spark, d):
    return detected(spark, d).select("quarter", "team", "start_sec", "end_sec")


@query(f"WITH {COUNTS_SQL}, {SPINE_SQL} SELECT quarter, bucket, coalesce(off, 0) AS n_off, coalesce(def, 0) AS n_def, coalesce(deep, 0) AS n_deep FROM spine LEFT JOIN f USING (quarter, bucket)")
def bucket_spine_counts(spark, d):
    return signal(spark, d).select("quarter", "bucket", *[F.col(c).alias(f"n_{c}") for c in ("off", "def", "deep")])


@query(f"WITH {DETECT_SQL} SELECT quarter, count(*) AS n, sum(end_sec - start_sec) AS total_sec, count(*) FILTER (end_sec - start_sec > 6) AS n_flagged FROM det GROUP BY 1")
def long_possessions_flagged(spark, d):
    long = F.col("end_sec") - F.col("start_sec")
    return detected(spark, d).groupBy("quarter").agg(F.count(F.lit(1)).alias("n"), F.sum(long).alias("total_sec"), F.count_if(long > 6).alias("n_flagged"))


@query(f"WITH {DETECT_SQL} SELECT * FROM det WHERE team = 'A' AND end_sec - start_sec <= 8")
def possessions_chosen(spark, d):
    return report.chosen(detected(spark, d), "A", 8.0).select("quarter", "team", "start_sec", "end_sec")


@query("WITH k AS (SELECT DISTINCT event_id // 14 AS k FROM events), q AS (SELECT DISTINCT 1 + k // 180 AS quarter FROM k), s AS (SELECT quarter, unnest(range(180)) AS bucket FROM q), n AS (SELECT 1 + k // 180 AS quarter, k % 180 AS bucket, count(*) AS n FROM k GROUP BY 1, 2) SELECT quarter, bucket, coalesce(n, 0) AS n_frames FROM s LEFT JOIN n USING (quarter, bucket)")
def frame_buckets(spark, d):
    q = A.quarters(spark, d)
    n = possessions.in_buckets(A.frames(spark, d), q, P).groupBy("quarter", "bucket").agg(F.count(F.lit(1)).alias("n_frames"))
    return possessions.bucket_spine(q, P).select("quarter", "bucket").join(n, ["quarter", "bucket"], "left").fillna(0, ["n_frames"])


@query(
    f"""WITH {TRK_SQL}, g AS (SELECT *, lead(frame) OVER w AS nf, lead(bucket) OVER w AS nb, row_number() OVER w AS n FROM trk WHERE team IN ('A', 'B') WINDOW w AS (PARTITION BY quarter, track_id ORDER BY frame)),
h AS (SELECT quarter, team, unnest(range(bucket, nb + 1)) AS bucket FROM g WHERE nf - frame > 1 AND n >= 5 AND zone = 'Behind Net' AND cy >= 0.95 * 1200 AND (nf - frame) / 30.0 <= 8)
SELECT quarter, bucket, count(*) FILTER (team = 'A') AS n_off, count(*) FILTER (team = 'B') AS n_def, count(*) FILTER (team = 'A') AS n_deep FROM h GROUP BY 1, 2"""
)
def offscreen_credit(spark, d):
    got = possessions.offscreen_credit(A.tracks(spark, d), "A", "B", 1200.0, P)
    return got.select("quarter", "bucket", *[F.col(c).alias(f"n_{c}") for c in ("off", "def", "deep")])


@query(
    f"""WITH {TRK_SQL}, o AS (SELECT * FROM trk WHERE team = 'A' AND zone <> 'Beyond 30'), n AS (SELECT quarter, frame, count(*) AS n FROM o GROUP BY 1, 2),
p AS (SELECT a.quarter, a.frame, sum(sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy))) / count(*) AS m FROM o a JOIN o b ON a.quarter = b.quarter AND a.frame = b.frame AND a.track_id < b.track_id GROUP BY 1, 2)
SELECT quarter, frame, n >= 4 AND coalesce(m / 40 < 20, false) AS huddled FROM n LEFT JOIN p USING (quarter, frame)"""
)
def huddle_frames(spark, d):
    return possessions.huddles(A.tracks(spark, d), "A", P).select("quarter", "frame", "huddled")


# --- zones ------------------------------------------------------------------------------------
@query(f"WITH {TRK_SQL} SELECT quarter, zone, count(*) AS n FROM trk GROUP BY 1, 2")
def zone_histogram(spark, d):
    return A.tracks(spark, d).groupBy("quarter", "zone").agg(F.count(F.lit(1)).alias("n"))


def _polygon_sql() -> str:
    on, cross = [], []
    for ax, ay, bx, by in spatial.edges(spatial.key_polygon(CAL)):
        turn = f"(({bx!r}::DOUBLE - {ax!r}::DOUBLE) * (cy - {ay!r}::DOUBLE) - ({by!r}::DOUBLE - {ay!r}::DOUBLE) * (cx - {ax!r}::DOUBLE))"
        on.append(f"({turn} = 0 AND cx BETWEEN {min(ax, bx)!r} AND {max(ax, bx)!r} AND cy BETWEEN {min(ay, by)!r} AND {max(ay, by)!r})")
        if ay != by:
            cross.append(f"(CASE WHEN cy >= {min(ay, by)!r}::DOUBLE AND cy < {max(ay, by)!r}::DOUBLE AND {turn} {'>' if by > ay else '<'} 0 THEN 1 ELSE 0 END)")
    return f"(({' OR '.join(on)}) OR ({' + '.join(cross)}) % 2 = 1)"


@query(f"WITH {TRK_SQL} SELECT quarter, CASE WHEN cy > 1000 THEN 'Behind Net' WHEN {_polygon_sql()} THEN 'Key' ELSE zone END AS zone, count(*) AS n FROM trk GROUP BY 1, 2")
def zone_key_polygon(spark, d):
    return A.tracks(spark, d, with_key=True).groupBy("quarter", "zone").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {TRK_SQL} SELECT quarter, frame, count(*) FILTER (zone = 'Behind Net') AS behind, count(*) FILTER (zone = 'Net-to-8') AS near, count(*) FILTER (zone = 'Perimeter') AS perimeter, count(*) FILTER (zone = 'Beyond 30') AS beyond, count(*) AS total FROM trk WHERE frame % 60 = 0 GROUP BY 1, 2")
def zone_pivot(spark, d):
    t = A.tracks(spark, d).filter("frame % 60 = 0")
    got = t.groupBy("quarter", "frame").pivot("zone", ["Behind Net", "Net-to-8", "Perimeter", "Beyond 30"]).agg(F.count(F.lit(1))).fillna(0)
    got = got.toDF("quarter", "frame", "behind", "near", "perimeter", "beyond")
    return got.withColumn("total", F.col("behind") + F.col("near") + F.col("perimeter") + F.col("beyond"))


@query(f"WITH {TRK_SQL} SELECT quarter, count(*) AS n_kept, count(*) FILTER (zone = 'Perimeter') AS n_perimeter FROM trk WHERE NOT (zone = 'Perimeter' AND cy < 600 - 0.7 * 400) GROUP BY 1")
def perimeter_cutoff(spark, d):
    t = A.tracks(spark, d)
    kept = t.filter(~spatial.beyond_cutoff(F.col("cy"), F.col("zone"), CAL))
    return kept.groupBy("quarter").agg(F.count(F.lit(1)).alias("n_kept"), F.count_if(F.col("zone") == PERIMETER).alias("n_perimeter"))


# --- formations and cuts ----------------------------------------------------------------------
FORM_SQL = f"""{TRK_SQL},
ff AS (SELECT quarter, team, bucket // 30 AS chunk, frame, count(*) FILTER (zone = 'Behind Net') AS bn, count(*) FILTER (zone = 'Net-to-8') AS n8, count(*) FILTER (zone = 'Perimeter') AS pm FROM trk WHERE team <> 'Goalie' GROUP BY 1, 2, 3, 4),
hist AS (SELECT quarter, team, chunk, bn, n8, pm, count(*) AS cnt, min(frame) AS ff FROM ff WHERE bn + n8 + pm >= 3 GROUP BY 1, 2, 3, 4, 5, 6),
rk AS (SELECT *, row_number() OVER (PARTITION BY quarter, team, chunk ORDER BY cnt DESC, ff) AS rank, sum(cnt) OVER (PARTITION BY quarter, team, chunk)::BIGINT AS total FROM hist)"""
FK = ["quarter", "team", "chunk"]


def form_hist(spark: SparkSession, d: str) -> DataFrame:
    t = A.tracks(spark, d).filter("team <> 'Goalie'").withColumn("chunk", F.expr("bucket div 30"))
    return formations.histogram(formations.frame_formations(t, FK, P.roster_floor), FK)


@query(f"WITH {FORM_SQL} SELECT quarter, team, chunk, bn, n8, pm, cnt, total AS n_qualifying FROM rk WHERE rank = 1")
def formation_mode(spark, d):
    return formations.dominant(form_hist(spark, d), FK).select(*FK, "formation.*", "cnt", "n_qualifying")


@query(f"WITH {FORM_SQL} SELECT quarter, team, chunk, rank, bn, n8, pm, cnt, total FROM rk WHERE rank <= 3")
def formation_top3(spark, d):
    return longs(formations.top(form_hist(spark, d), FK).select(*FK, "rank", "formation.*", "cnt", "total"), "rank")


@query(f"WITH {FORM_SQL} SELECT team, bn, n8, pm, count(*) AS n, sum(count(*)) OVER (PARTITION BY team)::BIGINT AS total FROM rk WHERE rank = 1 GROUP BY 1, 2, 3, 4")
def formation_frequency(spark, d):
    return formations.frequency(formations.dominant(form_hist(spark, d), FK)).select("team", "formation.*", "n", "total")


CUTS_SQL = f"""{TRK_SQL},
c1 AS (SELECT *, CASE WHEN zone = lag(zone) OVER w THEN 0 ELSE 1 END AS ch FROM trk WHERE zone IN ('Net-to-8', 'Perimeter') WINDOW w AS (PARTITION BY quarter, track_id ORDER BY frame)),
c2 AS (SELECT *, sum(ch) OVER (PARTITION BY quarter, track_id ORDER BY frame) AS run FROM c1),
c3 AS (SELECT quarter, track_id, run, zone, min(frame) AS first, count(*) AS n FROM c2 GROUP BY 1, 2, 3, 4),
c4 AS (SELECT *, lag(zone) OVER (PARTITION BY quarter, track_id ORDER BY first) AS pz FROM c3 WHERE n >= 2),
cut AS (SELECT quarter, track_id, first AS frame, CASE WHEN pz = 'Perimeter' AND zone = 'Net-to-8' THEN 'in' WHEN pz = 'Net-to-8' AND zone = 'Perimeter' THEN 'out' END AS direction FROM c4)"""


def cuts(spark: SparkSession, d: str) -> DataFrame:
    return formations.cut_events(A.tracks(spark, d), ["quarter", "track_id"], P.min_zone_run)


@query(f"WITH {CUTS_SQL} SELECT quarter, track_id::INT AS track_id, frame, direction FROM cut WHERE direction IS NOT NULL")
def cut_events(spark, d):
    return cuts(spark, d)


@query(f"WITH {CUTS_SQL}, q AS (SELECT DISTINCT quarter FROM trk) SELECT q.quarter, count(*) FILTER (direction = 'in') AS n_cuts_in, count(*) FILTER (direction = 'out') AS n_cuts_out, count(direction) = 0 AS suspect_zero_cuts FROM q LEFT JOIN cut USING (quarter) GROUP BY 1")
def cuts_in_out(spark, d):
    return formations.cut_counts(cuts(spark, d), A.tracks(spark, d), K)


# --- tracks -----------------------------------------------------------------------------------
GAP_SQL = f"""{TRK_SQL},
g AS (SELECT *, lead(frame) OVER w AS nf, lead(cx) OVER w AS ncx, lead(cy) OVER w AS ncy, lead(zone) OVER w AS nz FROM trk WINDOW w AS (PARTITION BY quarter, track_id ORDER BY frame)),
act AS (SELECT *, nf - frame AS gap, CASE WHEN nf - frame <= 15 THEN 'none' WHEN nf - frame > 150 THEN 'long' WHEN sqrt((ncx - cx) * (ncx - cx) + (ncy - cy) * (ncy - cy)) > 320 THEN 'far' ELSE 'fill' END AS action FROM g WHERE nf IS NOT NULL)"""


@query(
    f"""WITH {GAP_SQL}, p AS (SELECT *, unnest(range(frame + 15, nf, 15)) AS fr FROM act WHERE action = 'fill'), s AS (SELECT *, (fr - frame) / (nf - frame)::DOUBLE AS sh FROM p)
SELECT quarter, track_id::INT AS track_id, team, fr AS frame, round_even(cx + (ncx - cx) * sh, 0)::INT AS cx, round_even(cy + (ncy - cy) * sh, 0)::INT AS cy, CASE WHEN sh < 0.5 THEN zone ELSE nz END AS zone FROM s"""
)
def gap_interpolation(spark, d):
    return tracking.interpolate(A.tracks(spark, d), K, P).select("quarter", "track_id", "team", "frame", "cx", "cy", "zone")


@query(f"WITH {GAP_SQL} SELECT quarter, action, count(*) AS n FROM act GROUP BY 1, 2")
def gap_actions(spark, d):
    return tracking.gaps(A.tracks(spark, d), K, P).groupBy("quarter", "action").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {TRK_SQL}, n AS (SELECT quarter, team, track_id, count(*) AS n FROM trk GROUP BY 1, 2, 3) SELECT quarter, team, count(*) AS n_tracks, avg(n) AS avg_detections, max(n) AS max_detections, count(*) FILTER (n <= 2) AS n_fragments FROM n GROUP BY 1, 2")
def track_summary(spark, d):
    return tracking.summary(A.tracks(spark, d), K)


#: One step of the recursion for each frame: pairs within reach, the closest first, folded into those that are joined.
TRACKER_SQL = f"""WITH RECURSIVE {TRK_SQL},
fr AS (SELECT quarter, frame, row_number() OVER (PARTITION BY quarter ORDER BY frame) AS i, list({{'r': r, 'ix': ix, 'team': team, 'x': cx, 'y': cy}} ORDER BY r) AS dets
  FROM (SELECT quarter, frame, track_id AS ix, team, cx, cy, row_number() OVER (PARTITION BY quarter, frame ORDER BY track_id) AS r FROM trk) GROUP BY quarter, frame),
walk(quarter, i, n, live, ids) AS (
  SELECT DISTINCT quarter, 0::BIGINT, 0::BIGINT, []::STRUCT(id BIGINT, team VARCHAR, x BIGINT, y BIGINT, seen BIGINT)[], []::BIGINT[] FROM fr
  UNION ALL
  SELECT quarter, i, n + len(list_filter(ids, lambda k: k > n)), list_concat(list_filter(kept, lambda t: NOT list_contains(ids, t.id)), list_transform(dets, lambda d: {{'id': ids[d.r], 'team': d.team, 'x': d.x, 'y': d.y, 'seen': frame}})), ids
  FROM (SELECT *, list_transform(dets, lambda d: coalesce(picked.k[list_position(picked.r, d.r)], n + len(list_filter(dets, lambda o: o.r <= d.r AND NOT list_contains(picked.r, o.r))))) AS ids
    FROM (SELECT *, coalesce(list_reduce(list_transform(pairs, lambda q: {{'r': [q.r], 'k': [q.k]}}), lambda a, b: CASE WHEN list_contains(a.r, b.r[1]) OR list_contains(a.k, b.k[1]) THEN a ELSE {{'r': list_concat(a.r, b.r), 'k': list_concat(a.k, b.k)}} END), {{'r': []::BIGINT[], 'k': []::BIGINT[]}}) AS picked
      FROM (SELECT *, CASE WHEN len(within) = 0 THEN NULL ELSE list_sort(within) END AS pairs
        FROM (SELECT *, flatten(list_transform(dets, lambda d: list_transform(list_filter(kept, lambda t: t.team = d.team AND sqrt((d.x - t.x) * (d.x - t.x) + (d.y - t.y) * (d.y - t.y)) <= least((12.0 * (frame - t.seen) + 40.0) * (2000.0 / 3840.0), 500.0 * (2000.0 / 3840.0))),
            lambda t: {{'far': sqrt((d.x - t.x) * (d.x - t.x) + (d.y - t.y) * (d.y - t.y)), 'r': d.r, 'k': t.id}}))) AS within
          FROM (SELECT w.quarter, fr.i, w.n, fr.frame, fr.dets, list_filter(w.live, lambda t: fr.frame - t.seen <= 90) AS kept FROM walk w JOIN fr ON fr.quarter = w.quarter AND fr.i = w.i + 1))))))
SELECT quarter, frame, unnest(list_transform(dets, lambda d: d.ix)) AS det_ix, unnest(list_transform(dets, lambda d: d.team)) AS team, unnest(list_transform(dets, lambda d: d.x)) AS cx, unnest(list_transform(dets, lambda d: d.y)) AS cy, unnest(ids) AS track_id
FROM walk JOIN fr USING (quarter, i)"""


@query(TRACKER_SQL)
def tracker_assign(spark, d):
    dets = A.tracks(spark, d).drop("track_id").select("quarter", "frame", "det_ix", "team", "cx", "cy")
    return tracking.track(dets, K, ["A", "B", "Goalie"], 2000.0, P)


# --- runs and windows -------------------------------------------------------------------------
@query(
    f"""WITH {TRK_SQL}, n AS (SELECT quarter, frame, count(*) AS n FROM trk GROUP BY 1, 2), a AS (SELECT *, n <= 10 AS low, CASE WHEN (n <= 10) = lag(n <= 10) OVER (PARTITION BY quarter ORDER BY frame) THEN 0 ELSE 1 END AS ch FROM n),
b AS (SELECT *, sum(ch) OVER (PARTITION BY quarter ORDER BY frame) AS run FROM a)
SELECT quarter, min(frame) AS first, max(frame) AS last, count(*) AS n FROM b WHERE low GROUP BY quarter, run HAVING (max(frame) - min(frame)) / 30.0 >= 0.5"""
)
def low_count_stretches(spark, d):
    n = A.tracks(spark, d).groupBy("quarter", "frame").agg(F.count(F.lit(1)).alias("n"))
    return sequence.low_stretches(n, K, "frame", F.col("n") <= 10).filter((F.col("last") - F.col("first")) / 30.0 >= 0.5)


@query(
    f"""WITH {COUNTS_SQL}, {SPINE_SQL}, n AS (SELECT quarter, bucket, coalesce(deep, 0) AS near FROM spine LEFT JOIN f USING (quarter, bucket)),
a AS (SELECT *, CASE WHEN (near <= 1) = lag(near <= 1) OVER (PARTITION BY quarter ORDER BY bucket) THEN 0 ELSE 1 END AS ch FROM n), b AS (SELECT *, sum(ch) OVER (PARTITION BY quarter ORDER BY bucket) AS run FROM a)
SELECT quarter, 'quiet' AS kind, min(bucket) AS start_sec, max(bucket) + 1 AS end_sec FROM b WHERE near <= 1 GROUP BY quarter, run HAVING count(*) >= 2"""
)
def quiet_windows(spark, d):
    s = signal(spark, d).select("quarter", "bucket", F.col("deep").alias("near"), "huddled")
    return align.windows(align.combine_cameras(s, K, "bucket"), K, "bucket", P)


SESSION_SQL = f"{TIMED_SQL}, h AS (SELECT DISTINCT user_id, t // {SIX_HOURS} AS h, event_type FROM timed)"


def sessions_sql(name: str, types: str, gap: int) -> str:
    return f"{name}_h AS (SELECT DISTINCT user_id, h FROM h WHERE event_type IN ({types})), {name} AS (SELECT user_id, s * {SIX_HOURS} AS start_sec, e * {SIX_HOURS} AS end_sec FROM {islands_sql(name + '_h', 'user_id', 'h', gap)})"


def sessions(spark: SparkSession, d: str, types: list[str], gap: int) -> DataFrame:
    """Stretches of six-hour buckets of a user's events, bridged over so many empty ones."""
    h = A.timed(spark, d).filter(F.col("event_type").isin(types)).select("user_id", F.expr(f"t div {SIX_HOURS}").alias("h")).distinct()
    got = sequence.islands(h, ["user_id"], "h", gap)
    return got.select("user_id", (F.col("start") * SIX_HOURS).alias("start_sec"), (F.col("end") * SIX_HOURS).alias("end_sec"))


VIEWS, CLICKS = sessions_sql("v", "'view'", 1), sessions_sql("c", "'click'", 1)


@query(f"WITH {SESSION_SQL}, {VIEWS} SELECT * FROM v")
def session_grace_merge(spark, d):
    return sessions(spark, d, ["view"], 1)


@query(
    f"""WITH {SESSION_SQL}, a AS (SELECT DISTINCT user_id, h FROM h), b AS (SELECT DISTINCT user_id, h FROM h WHERE event_type <> 'error'), seg AS {islands_sql('a', 'user_id', 'h', 1)}, run AS {islands_sql('b', 'user_id', 'h', 0)}
SELECT DISTINCT seg.user_id, seg.s AS first_bucket, seg.e AS end_bucket FROM seg JOIN run ON seg.user_id = run.user_id AND least(seg.e, run.e) - greatest(seg.s, run.s) >= 2"""
)
def sustained_sessions(spark, d):
    h = A.timed(spark, d).select("user_id", F.expr(f"t div {SIX_HOURS}").alias("h"), "event_type")
    seg = sequence.islands(h.select("user_id", "h").distinct(), ["user_id"], "h", 1)
    got = sequence.sustained(seg, h.filter("event_type <> 'error'").select("user_id", "h").distinct(), ["user_id"], "h", 2)
    return got.select("user_id", F.col("start").alias("first_bucket"), F.col("end").alias("end_bucket"))


@query("SELECT o_custkey, o_orderkey, s - lag(e) OVER w AS gap_before, lead(s) OVER w - e AS gap_after, coalesce(s - lag(e) OVER w < 15, false) OR coalesce(lead(s) OVER w - e < 15, false) AS near FROM (SELECT o_custkey, o_orderkey, o_orderkey % 1000 AS s, o_orderkey % 1000 + 10 AS e FROM orders) WINDOW w AS (PARTITION BY o_custkey ORDER BY s, e, o_orderkey)")
def sibling_gaps(spark, d):
    o = A.read(spark, d, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 1000).alias("s"), (F.col("o_orderkey") % 1000 + 10).alias("e"))
    return sequence.sibling_gaps(o, ["o_custkey"], "s", "e", P.sibling_gap_sec, ["o_orderkey"]).drop("s", "e")


@query("SELECT event_id, user_id, coalesce(CASE WHEN event_id % 3 <> 0 THEN value END, first(CASE WHEN event_id % 3 <> 0 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), last(CASE WHEN event_id % 3 <> 0 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS filled FROM events")
def next_known_fill(spark, d):
    v = F.when(F.col("event_id") % 3 != 0, F.col("value"))
    return A.read(spark, d, "events").select("event_id", "user_id", v.alias("v")).withColumn("filled", sequence.next_known(F.col("v"), ["user_id"], "event_id")).drop("v")


@query("SELECT event_id, user_id, last(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS last_purchase FROM events")
def asof_carry_forward(spark, d):
    v = F.when(F.col("event_type") == "purchase", F.col("value"))
    return A.read(spark, d, "events").select("event_id", "user_id", v.alias("v")).withColumn("last_purchase", sequence.carried(F.col("v"), ["user_id"], "event_id")).drop("v")


@query(
    f"""WITH {TIMED_SQL}, s AS (SELECT user_id % 5 AS g, t // 3600 - 473352 AS t, count(*) AS v FROM timed GROUP BY 1, 2), m AS (SELECT g, max(t) AS m FROM s GROUP BY 1), grid AS (SELECT g, unnest(range(0, m // 5 + 1)) * 5 AS t FROM m)
SELECT g, grid.t AS t, arg_min(s.v, abs(s.t - grid.t) * 100000 - s.t) AS v FROM grid JOIN s USING (g) GROUP BY 1, 2"""
)
def nearest_resample(spark, d):
    s = A.timed(spark, d).select((F.col("user_id") % 5).alias("g"), (F.expr("t div 3600") - 473352).alias("t")).groupBy("g", "t").agg(F.count(F.lit(1)).alias("v"))
    return sequence.resample_nearest(s, ["g"], "t", "v", 5)


@query(
    f"""WITH {SESSION_SQL}, r AS (SELECT user_id, min(h) AS a, max(h) AS b FROM h GROUP BY 1), g AS (SELECT user_id, unnest(range(a, b + 5)) AS h FROM r), o AS (SELECT DISTINCT user_id, h, true AS o FROM h), f AS (SELECT user_id, h, coalesce(o, false) AS o FROM g LEFT JOIN o USING (user_id, h)),
l AS (SELECT user_id, h - lag(h) OVER (PARTITION BY user_id ORDER BY h) - 1 AS gap FROM f WHERE o), t AS (SELECT user_id, max(h) FILTER (o) AS lo, max(h) AS hi, count(*) FILTER (o) AS n FROM f GROUP BY 1)
SELECT t.user_id, coalesce(max(gap), 0)::BIGINT AS max_gap, any_value(hi - lo)::BIGINT AS open_gap, any_value(n)::BIGINT AS n_on FROM t JOIN l USING (user_id) GROUP BY 1"""
)
def grid_gap_tracker(spark, d):
    h = A.timed(spark, d).select("user_id", F.expr(f"t div {SIX_HOURS}").alias("h")).distinct()
    grid = h.groupBy("user_id").agg(F.min("h").alias("a"), F.max("h").alias("b")).select("user_id", F.explode(F.sequence(F.col("a"), F.col("b") + 4)).alias("h"))
    grid = grid.join(h.withColumn("seen", F.lit(True)), ["user_id", "h"], "left").withColumn("seen", F.coalesce("seen", F.lit(False)))
    return longs(sequence.grid_gaps(grid, ["user_id"], "h", "seen"), "max_gap", "open_gap", "n_on")


# --- intervals --------------------------------------------------------------------------------
BOTH = f"{SESSION_SQL}, {VIEWS}, {CLICKS}"
OVER = "v.user_id = c.user_id AND v.start_sec <= c.end_sec AND c.start_sec <= v.end_sec"


@query(f"WITH {BOTH} SELECT * FROM v WHERE EXISTS (SELECT 1 FROM c WHERE {OVER})")
def interval_semi_match(spark, d):
    return intervals.matched(sessions(spark, d, ["view"], 1), sessions(spark, d, ["click"], 1), ["user_id"])


@query(f"WITH {BOTH} SELECT * FROM v WHERE NOT EXISTS (SELECT 1 FROM c WHERE {OVER})")
def interval_anti_unmatched(spark, d):
    return intervals.matched(sessions(spark, d, ["view"], 1), sessions(spark, d, ["click"], 1), ["user_id"], how="left_anti")


@query(f"WITH {BOTH} SELECT * FROM v WHERE NOT EXISTS (SELECT 1 FROM c WHERE v.user_id = c.user_id AND least(v.end_sec, c.end_sec) - greatest(v.start_sec, c.start_sec) > 0)")
def interval_anti_strict(spark, d):
    return intervals.matched(sessions(spark, d, ["view"], 1), sessions(spark, d, ["click"], 1), ["user_id"], strict=True, how="left_anti")


@query(f"WITH {BOTH} SELECT 'disappeared' AS change, * FROM v WHERE NOT EXISTS (SELECT 1 FROM c WHERE {OVER}) UNION ALL SELECT 'appeared' AS change, * FROM c WHERE NOT EXISTS (SELECT 1 FROM v WHERE {OVER})")
def snapshot_diff(spark, d):
    return intervals.snapshot_diff(sessions(spark, d, ["view"], 1), sessions(spark, d, ["click"], 1), ["user_id"])


@query(f"WITH {SESSION_SQL}, {VIEWS}, {sessions_sql('w', chr(39) + 'view' + chr(39), 6)} SELECT w.user_id, w.start_sec, w.end_sec, count(*) AS n_old, min(v.start_sec) AS first_old FROM w JOIN v ON v.user_id = w.user_id AND v.start_sec <= w.end_sec AND w.start_sec <= v.end_sec GROUP BY 1, 2, 3 HAVING count(*) >= 2")
def interval_merges(spark, d):
    got = intervals.merges(sessions(spark, d, ["view"], 1), sessions(spark, d, ["view"], 6), ["user_id"], 86400.0)
    return got.withColumn("first_old", F.get("old_starts", F.lit(0))).drop("old_starts")


@query(
    f"""WITH {SESSION_SQL}, {sessions_sql('b', chr(39) + 'click' + chr(39), 3)}, {sessions_sql('x', chr(39) + 'view' + chr(39), 0)},
m AS (SELECT b.user_id, b.start_sec AS bs, b.end_sec AS be, greatest(x.start_sec, b.start_sec) AS s, least(x.end_sec, b.end_sec) AS e FROM b JOIN x ON b.user_id = x.user_id AND b.end_sec - b.start_sec > 86400 AND x.start_sec >= b.start_sec - 3600 AND x.end_sec <= b.end_sec + 3600),
p AS (SELECT *, coalesce(lag(e) OVER w, bs) AS cur, lead(s) OVER w AS nx FROM m WHERE e > s WINDOW w AS (PARTITION BY user_id, bs, be ORDER BY s, e))
SELECT user_id, 'A' AS team, cur AS start_sec, s AS end_sec, 'video_detected' AS boundary_source FROM p WHERE s > cur
UNION ALL SELECT user_id, 'B', s, e, 'official_split_within_long_video_block' FROM p
UNION ALL SELECT user_id, 'A', e, be, 'video_detected' FROM p WHERE nx IS NULL AND be > e
UNION ALL SELECT user_id, 'A', start_sec, end_sec, 'video_detected' FROM b WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.user_id = b.user_id AND p.bs = b.start_sec AND p.be = b.end_sec)"""
)
def block_split(spark, d):
    blocks = sessions(spark, d, ["click"], 3).withColumns({"team": F.lit("A"), "other": F.lit("B")})
    hidden = sessions(spark, d, ["view"], 0).withColumn("team", F.lit("B"))
    return intervals.split_blocks(blocks, hidden, ["user_id"], 86400, 3600)


@query(f"WITH {BOTH}, o AS (SELECT *, row_number() OVER (ORDER BY user_id, start_sec) AS seq, CASE WHEN start_sec // {SIX_HOURS} % 2 = 0 THEN 'goal' ELSE 'turnover' END AS end_reason FROM c) SELECT v.user_id, v.start_sec, v.end_sec, arg_min(o.end_reason, abs(v.end_sec - o.end_sec) * 1000000 + o.seq) AS end_reason FROM v LEFT JOIN o USING (user_id) GROUP BY 1, 2, 3")
def nearest_end_reason(spark, d):
    o = sessions(spark, d, ["click"], 1).withColumn("seq", F.row_number().over(Window.partitionBy("user_id").orderBy("start_sec")))
    o = o.withColumn("end_reason", F.when(F.expr(f"start_sec div {SIX_HOURS} % 2 = 0"), "goal").otherwise("turnover"))
    return intervals.nearest_reason(sessions(spark, d, ["view"], 1), o, ["user_id"])


@query(f"WITH {BOTH}, o AS (SELECT *, 'T' || user_id % 3 AS team FROM v) SELECT team, count(*) AS n_official, count(*) FILTER (EXISTS (SELECT 1 FROM c WHERE c.user_id = o.user_id AND o.start_sec <= c.end_sec + 3600 AND c.start_sec <= o.end_sec + 3600)) AS n_matched FROM o GROUP BY 1")
def match_check(spark, d):
    team = F.concat(F.lit("T"), (F.col("user_id") % 3).cast("string"))
    o = sessions(spark, d, ["view"], 1).withColumns({"team": team, "seq": F.struct("user_id", "start_sec")})
    return longs(possessions.match_check(o, sessions(spark, d, ["click"], 1), ["user_id"], 3600), "n_matched")


@query(f"WITH {BOTH}, u AS (SELECT 'T' || user_id % 3 AS team, 1 AS v, 0 AS c FROM v UNION ALL SELECT 'T' || user_id % 3, 0, 1 FROM c) SELECT team, sum(v)::BIGINT AS n_detected, sum(c)::BIGINT AS n_official, (sum(v) - sum(c))::BIGINT AS delta FROM u GROUP BY 1")
def count_deltas(spark, d):
    team = F.concat(F.lit("T"), (F.col("user_id") % 3).cast("string"))
    return possessions.count_deltas(sessions(spark, d, ["view"], 1).withColumn("team", team), sessions(spark, d, ["click"], 1).withColumn("team", team))


@query(f"WITH {TIMED_SQL}, a AS (SELECT event_id, user_id, t FROM timed WHERE event_type = 'click'), b AS (SELECT event_id AS near_id, user_id, t AS pt FROM timed WHERE event_type = 'purchase') SELECT event_id, a.user_id, t, arg_min(pt, abs(t - pt) * 10000000000 + pt) AS nearest, arg_min(near_id, abs(t - pt) * 10000000000 + pt) AS near_id, min(abs(t - pt)) AS distance FROM a LEFT JOIN b ON a.user_id = b.user_id AND abs(t - pt) < 86400 GROUP BY 1, 2, 3")
def nearest_event(spark, d):
    e = A.timed(spark, d)
    a = e.filter("event_type = 'click'").select("event_id", "user_id", "t")
    b = e.filter("event_type = 'purchase'").select("user_id", F.col("t").alias("p"), F.col("event_id").alias("near_id"))
    return intervals.nearest_within(a, b, ["user_id"], "t", "p", "near_id", 86400)


RANKED = f"{BOTH}, rv AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start_sec, end_sec) AS rank FROM v), rc AS (SELECT user_id, start_sec AS aligned_start, end_sec AS aligned_end, row_number() OVER (PARTITION BY user_id ORDER BY start_sec, end_sec) AS rank FROM c), rr AS (SELECT * FROM rv JOIN rc USING (user_id, rank))"


def ranked(spark: SparkSession, d: str) -> DataFrame:
    return longs(intervals.by_rank(sessions(spark, d, ["view"], 1), sessions(spark, d, ["click"], 1), ["user_id"]), "rank")


@query(f"WITH {RANKED} SELECT *, (aligned_end - aligned_start) / greatest(end_sec - start_sec, 0.1::DOUBLE) AS ratio, (aligned_end - aligned_start) / greatest(end_sec - start_sec, 0.1::DOUBLE) > 1.5 AS flagged FROM rr")
def stretch_ratio(spark, d):
    return intervals.stretch(ranked(spark, d))


@query(f"WITH {RANKED}, p AS (SELECT user_id, rank, start_sec - lag(start_sec) OVER w AS raw_gap, aligned_start - lag(aligned_start) OVER w AS aligned_gap FROM rr WINDOW w AS (PARTITION BY user_id ORDER BY start_sec, rank)) SELECT *, aligned_gap / raw_gap AS pace, aligned_gap / raw_gap > 2 OR aligned_gap / raw_gap < 0.5 AS flagged FROM p WHERE raw_gap > 0")
def local_pace(spark, d):
    return intervals.local_pace(ranked(spark, d), ["user_id"]).select("user_id", "rank", "raw_gap", "aligned_gap", "pace", "flagged")


@query(f"WITH {RANKED}, nv AS (SELECT user_id, count(*) AS n FROM v GROUP BY 1), nc AS (SELECT user_id, count(*) AS n FROM c GROUP BY 1) SELECT rr.*, (aligned_end - aligned_start) / greatest(end_sec - start_sec, 0.1::DOUBLE) AS ratio, (aligned_end - aligned_start) / greatest(end_sec - start_sec, 0.1::DOUBLE) > 2.5 OR aligned_end - aligned_start > 200000 AS flagged FROM rr JOIN nv USING (user_id) JOIN nc USING (user_id) WHERE nv.n = nc.n")
def stretch_guarded(spark, d):
    pairs = longs(intervals.by_position(sessions(spark, d, ["view"], 1), sessions(spark, d, ["click"], 1), ["user_id"]), "rank")
    return intervals.stretch(pairs, 2.5, 200000)


@query(f"WITH {BOTH}, nv AS (SELECT user_id, count(*) AS n FROM v GROUP BY 1), nc AS (SELECT user_id, count(*) AS n FROM c GROUP BY 1) SELECT user_id, nv.n AS n_raw, coalesce(nc.n, 0) AS n_aligned FROM nv LEFT JOIN nc USING (user_id) WHERE nv.n <> coalesce(nc.n, 0)")
def count_mismatches(spark, d):
    return intervals.count_mismatches(sessions(spark, d, ["view"], 1), sessions(spark, d, ["click"], 1), ["user_id"])


@query(
    """WITH t AS (SELECT o_orderkey, o_custkey % 20 AS g, (o_orderkey % 1000)::DOUBLE AS t FROM orders), s AS (SELECT 1 AS i, g, 0.0 AS t0, 0.0 AS v0, 100.0 + g AS t1, 500.0 AS v1 FROM range(20) r(g) UNION ALL SELECT 2, g, 100.0 + g, 500.0, 450.0, 600.0 + g FROM range(20) r(g) UNION ALL SELECT 3, g, 450.0, 600.0 + g, 900.0, 1000.0 FROM range(20) r(g)),
h AS (SELECT o_orderkey, g, t, arg_min(v0::DOUBLE + (t - t0::DOUBLE) / (t1::DOUBLE - t0::DOUBLE) * (v1::DOUBLE - v0::DOUBLE), i) AS v FROM t JOIN s USING (g) WHERE t BETWEEN t0 AND t1 GROUP BY 1, 2, 3)
SELECT t.o_orderkey, t.g, t.t, coalesce(v, CASE WHEN t.t < 0 THEN 0 ELSE 1000 END)::DOUBLE AS video FROM t LEFT JOIN h USING (o_orderkey)"""
)
def piecewise_align(spark, d):
    t = A.read(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 20).alias("g"), (F.col("o_orderkey") % 1000).cast("double").alias("t"))
    g = F.col("id").cast("double")
    point = lambda a, b: F.struct(a.cast("double").alias("at"), b.cast("double").alias("to"))
    anchors = spark.range(20).select(F.col("id").alias("g"), F.inline(F.array(point(F.lit(0), F.lit(0)), point(g + 100, F.lit(500)), point(F.lit(450), g + 600), point(F.lit(900), F.lit(1000)))))
    return intervals.piecewise(t, anchors, ["g"], "t", "video")


# --- logs -------------------------------------------------------------------------------------
EVENTS_SQL = rf"""{LINES_SQL},
l AS (SELECT conv_id, seq, regexp_extract(line, '^(\d{{2}}:\d{{2}}|--)\s+(\S+)\s*(.*)$', 1) AS time_str, regexp_extract(line, '^(\d{{2}}:\d{{2}}|--)\s+(\S+)\s*(.*)$', 2) AS team, regexp_extract(line, '^(\d{{2}}:\d{{2}}|--)\s+(\S+)\s*(.*)$', 3) AS "desc" FROM lines),
q AS (SELECT *, (1 + coalesce(sum(CASE WHEN team = '0' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS quarter FROM l),
y AS (SELECT *, CASE WHEN time_str <> '--' THEN 900 - (substr(time_str, 1, 2)::DOUBLE * 60 + substr(time_str, 4, 2)::DOUBLE) END AS t0 FROM q WHERE team <> '0'),
ev AS (SELECT conv_id, quarter, seq, time_str, team, "desc", coalesce(first(t0 IGNORE NULLS) OVER (PARTITION BY conv_id, quarter ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), last(t0 IGNORE NULLS) OVER (PARTITION BY conv_id, quarter ORDER BY seq), 0) AS elapsed_sec FROM y)"""


def log_events(spark: SparkSession, d: str) -> DataFrame:
    return pbp.parse(A.log_lines(spark, d), ["conv_id"])


@query(f"WITH {EVENTS_SQL} SELECT * FROM ev")
def log_line_parse(spark, d):
    return log_events(spark, d)


@query(f"""WITH {EVENTS_SQL} SELECT conv_id, quarter, elapsed_sec, 'timeout' AS type FROM ev WHERE "desc" LIKE 'Timeout by%'""")
def stoppage_classify(spark, d):
    return pbp.stoppages(log_events(spark, d), ["conv_id"])


@query(rf"""WITH {EVENTS_SQL} SELECT conv_id, quarter, elapsed_sec, regexp_extract("desc", '^GOAL by\s+(\S+)', 1) AS team FROM ev WHERE "desc" LIKE 'GOAL by%'""")
def goal_markers(spark, d):
    return pbp.goals(log_events(spark, d), ["conv_id"])


def held_sql(source: str, keys: str, seq: str, t: str, end: str) -> str:
    """CTEs h1 .. h4 and held: the state machine over claim and goal."""
    return f"""
h1 AS (SELECT *, last(claim IGNORE NULLS) OVER w AS lc, count(claim) OVER w AS g FROM {source} WINDOW w AS (PARTITION BY {keys} ORDER BY {seq})),
h2 AS (SELECT *, max(CASE WHEN goal = lc THEN 1 ELSE 0 END) OVER (PARTITION BY {keys}, g ORDER BY {seq}) AS closed FROM h1),
h3 AS (SELECT *, CASE WHEN closed = 0 THEN lc END AS cur FROM h2),
h4 AS (SELECT *, lag(cur) OVER (PARTITION BY {keys} ORDER BY {seq}) AS before FROM h3),
h5 AS (SELECT *, coalesce(lead({t}) OVER w, {end}) AS e, lead(cur IS NULL) OVER w AS ng FROM h4 WHERE cur IS DISTINCT FROM before WINDOW w AS (PARTITION BY {keys} ORDER BY {seq})),
held AS (SELECT {keys}, cur AS team, {t}::DOUBLE AS start_sec, e::DOUBLE AS end_sec, (e - {t})::DOUBLE AS duration_sec, CASE WHEN ng THEN 'goal' WHEN NOT ng THEN 'turnover' ELSE 'period_end' END AS end_reason FROM h5 WHERE cur IS NOT NULL AND e > {t})"""


LOG_HELD = EVENTS_SQL + r""",
cl AS (SELECT conv_id, quarter, seq, elapsed_sec, nullif(coalesce(nullif(regexp_extract("desc", '^(?:Draw control|Ground ball pickup) by\s+(\S+)', 1), ''), regexp_extract("desc", '^Clear attempt by\s+(\S+)', 1)), '') AS claim, nullif(regexp_extract("desc", '^GOAL by\s+(\S+)', 1), '') AS goal FROM ev),""" + held_sql("cl", "conv_id, quarter", "seq", "elapsed_sec", "900")


@query(f"WITH {LOG_HELD} SELECT * FROM held")
def pbp_possessions(spark, d):
    return pbp.possessions(log_events(spark, d), ["conv_id"])


@query(f"WITH {LOG_HELD} SELECT team, count(*) AS n, sum(duration_sec) AS total_sec, avg(duration_sec) AS avg_sec FROM held GROUP BY 1")
def official_totals(spark, d):
    return pbp.totals(pbp.possessions(log_events(spark, d), ["conv_id"]))


@query(f"WITH {TIMED_SQL}, cl AS (SELECT user_id, event_id, t, CASE event_type WHEN 'click' THEN 'A' WHEN 'view' THEN 'B' END AS claim, CASE WHEN event_type = 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'B' END END AS goal FROM timed), {held_sql('cl', 'user_id', 'event_id', 't', '1706745600')} SELECT * FROM held")
def claim_state_machine(spark, d):
    claim = F.when(F.col("event_type") == "click", "A").when(F.col("event_type") == "view", "B")
    goal = F.when(F.col("event_type") == "purchase", F.when(F.col("event_id") % 2 == 0, "A").otherwise("B"))
    e = A.timed(spark, d).select("user_id", "event_id", "t", claim.alias("claim"), goal.alias("goal"))
    got = pbp.held_intervals(e, ["user_id"], "event_id", "t", 1706745600)
    return got.withColumns({c: F.col(c).cast("double") for c in ("start_sec", "end_sec", "duration_sec")})


@query("""WITH s AS (SELECT DISTINCT conv_id % 10 AS g, conv_id AS span_id, (conv_id * 37 % 800)::DOUBLE AS lo FROM conversations), l AS (SELECT conv_id % 10 AS g, conv_id * 100 + turn AS seq, (conv_id * 53 % 900 + turn)::DOUBLE AS remaining FROM conversations) SELECT g, span_id, seq, remaining FROM s JOIN l USING (g) WHERE remaining BETWEEN lo - 20 AND lo + 30 + 20""")
def log_clock_audit(spark, d):
    c = A.read(spark, d, "conversations")
    low = (F.col("conv_id") * 37 % 800).cast("double")
    spans = c.select((F.col("conv_id") % 10).alias("g"), F.col("conv_id").alias("span_id"), low.alias("remaining_end"), (low + 30).alias("remaining_start")).distinct()
    lines = c.select((F.col("conv_id") % 10).alias("g"), (F.col("conv_id") * 100 + F.col("turn")).alias("seq"), (F.col("conv_id") * 53 % 900 + F.col("turn")).cast("double").alias("remaining"))
    return pbp.audit_lines(lines, spans, ["g"]).select("g", "span_id", "seq", "remaining")


@query("SELECT event_id, printf('%02d:%02d:%02d', event_id // 30 // 3600, event_id // 30 % 3600 // 60, event_id // 30 % 60) AS frame_clock, 'Q' || (event_id % 4 + 1) || '_' || event_type || '_' || ((event_id % 100) / 2.0)::DOUBLE || '_' || ((event_id % 100) / 2.0 + 10)::DOUBLE AS possession_id FROM events")
def clock_and_ids(spark, d):
    e = A.read(spark, d, "events")
    s = (F.col("event_id") % 100) / 2.0
    return e.select("event_id", clock.frame_clock(F.col("event_id")).alias("frame_clock"), clock.interval_id(F.col("event_id") % 4 + 1, F.col("event_type"), s, s + 10).alias("possession_id"))


# --- report -----------------------------------------------------------------------------------
REPORT_SQL = """
rw AS (SELECT o_orderkey AS start_sec, o_orderstatus AS team, year(o_orderdate)::INT AS quarter, (o_custkey % 100)::DOUBLE AS duration_sec FROM orders),
lt AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS k FROM lineitem),
cb AS (SELECT rw.*, coalesce(CASE l_returnflag WHEN 'R' THEN 'Goal scored' WHEN 'A' THEN 'Turnover' END, 'Untagged') AS result, CASE WHEN l_orderkey IS NOT NULL AND l_linenumber > 1 THEN '(' || l_linenumber % 3 || ', ' || l_suppkey % 2 || ', 4)' END AS formation,
  coalesce(l_linenumber % 4, 0)::BIGINT AS cuts_in, coalesce(l_suppkey % 3, 0)::BIGINT AS cuts_out FROM rw LEFT JOIN (SELECT * FROM lt WHERE k = 1) l ON l.l_orderkey = rw.start_sec)"""


def report_rows(spark: SparkSession, d: str) -> DataFrame:
    o = A.read(spark, d, "orders").select(F.col("o_orderkey").alias("start_sec"), F.col("o_orderstatus").alias("team"), F.year("o_orderdate").alias("quarter"), (F.col("o_custkey") % 100).cast("double").alias("duration_sec"))
    n = F.col("l_linenumber")
    line = A.read(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("start_sec"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("o"), F.when(F.col("l_returnflag") == "R", "Goal scored").when(F.col("l_returnflag") == "A", "Turnover").alias("result"),
        F.when(n > 1, F.format_string("(%d, %d, 4)", n % 3, F.col("l_suppkey") % 2)).alias("formation"), (n % 4).cast("long").alias("cuts_in"), (F.col("l_suppkey") % 3).alias("cuts_out"),
    )
    return report.combined(o, line, line, line, ["start_sec"], "o")


@query(f"WITH {REPORT_SQL} SELECT * FROM cb")
def report_combined(spark, d):
    return report_rows(spark, d)


@query(f"WITH {REPORT_SQL} SELECT team, count(*) AS n, sum(duration_sec) AS total_sec, avg(duration_sec) AS avg_sec, count(*) FILTER (lower(result) LIKE '%goal%') AS goals, sum(cuts_in + cuts_out)::BIGINT AS total_cuts, avg(cuts_in + cuts_out) AS avg_cuts FROM cb GROUP BY 1")
def game_averages(spark, d):
    return report.averages(report_rows(spark, d))


@query(f"WITH {REPORT_SQL} SELECT team, result, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY team) AS share FROM cb WHERE result <> 'Untagged' GROUP BY 1, 2")
def result_breakdown(spark, d):
    return report.results(report_rows(spark, d))


@query(f"WITH {REPORT_SQL} SELECT team, quarter, count(*) AS n, sum(duration_sec) AS total_sec, avg(duration_sec) AS avg_sec FROM cb GROUP BY 1, 2")
def quarter_breakdown(spark, d):
    return report.quarters(report_rows(spark, d))


@query(f"WITH {REPORT_SQL} SELECT team, quarter, count(*) AS n, sum(cuts_in)::BIGINT AS cuts_in, sum(cuts_out)::BIGINT AS cuts_out FROM cb GROUP BY GROUPING SETS ((team), (team, quarter))")
def cuts_summary(spark, d):
    return report.cuts_summary(report_rows(spark, d))


@query(f"WITH {REPORT_SQL} SELECT team, result, formation, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY team, result) AS share FROM cb WHERE result <> 'Untagged' AND formation IS NOT NULL GROUP BY 1, 2, 3")
def formations_by_result(spark, d):
    return report.formations_by_result(report_rows(spark, d))


@query(f"WITH {REPORT_SQL} SELECT team, result, count(*) AS n, avg(cuts_in) AS avg_in, avg(cuts_out) AS avg_out, avg(cuts_in + cuts_out) AS avg_total, avg(duration_sec) AS avg_sec FROM cb WHERE result <> 'Untagged' GROUP BY 1, 2")
def cuts_by_result(spark, d):
    return report.cuts_by_result(report_rows(spark, d))


LATEST_SQL = "lt AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber >= 3 THEN l_quantity + 20 END AS fix FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS k FROM lineitem) WHERE k = 1)"


def tags(spark: SparkSession, d: str) -> DataFrame:
    line = A.read(spark, d, "lineitem")
    last = sequence.latest(line, ["l_orderkey"], "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return last.select(F.col("l_orderkey"), "l_linenumber", F.when(F.col("l_linenumber") >= 3, F.col("l_quantity") + 20).alias("fix"))


@query(f"WITH {LATEST_SQL} SELECT * FROM lt")
def latest_tag(spark, d):
    return tags(spark, d)


@query(f"WITH {LATEST_SQL} SELECT o_orderkey AS id, (o_custkey % 50)::DOUBLE AS start_sec, CASE WHEN fix > o_custkey % 50 THEN fix ELSE (o_custkey % 50 + 30)::DOUBLE END AS end_sec, coalesce(fix > o_custkey % 50, false) AS corrected FROM orders LEFT JOIN lt ON l_orderkey = o_orderkey")
def corrections_applied(spark, d):
    s = (F.col("o_custkey") % 50).cast("double")
    rows = A.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), s.alias("start_sec"), (s + 30).alias("end_sec"))
    return possessions.apply_corrections(rows, tags(spark, d).select(F.col("l_orderkey").alias("id"), F.col("fix").alias("corrected_end_sec")), "id").select("id", "start_sec", "end_sec", "corrected")


# --- samples, readings, colours, grids --------------------------------------------------------
RANK_SQL = "r AS (SELECT o_orderkey, year(o_orderdate)::INT AS y, row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_totalprice, o_orderkey) - 1 AS r, count(*) OVER (PARTITION BY year(o_orderdate)) AS n FROM orders)"


def ranked_orders(spark: SparkSession, d: str) -> DataFrame:
    return A.read(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"), "o_totalprice")


@query(f"WITH {RANK_SQL} SELECT o_orderkey, y FROM r WHERE n <= 5 OR r IN (0, n // 5, 2 * n // 5, 3 * n // 5, 4 * n // 5)")
def stratified_sample(spark, d):
    return sampling.evenly(ranked_orders(spark, d), ["y"], ["o_totalprice", "o_orderkey"], 5).drop("o_totalprice")


@query(f"WITH {RANK_SQL} SELECT o_orderkey, y FROM r WHERE r % greatest(1, n // 12) = 0 AND r // greatest(1, n // 12) < 12")
def every_kth_sample(spark, d):
    return sampling.every_kth(ranked_orders(spark, d), ["y"], ["o_totalprice", "o_orderkey"], 12).drop("o_totalprice")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS k FROM orders) WHERE k = 1")
def first_of_group(spark, d):
    return sampling.first_of(A.read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_custkey"], ["o_totalprice", "o_orderkey"])


SCORE_SQL = """
sc AS (SELECT user_id, CASE WHEN event_id % 2 = 0 THEN 'c1' ELSE 'c2' END AS camera, 1 + (event_id // 2) % 4 AS quarter, CASE WHEN event_type IN ('click', 'view') THEN 'A' ELSE 'B' END AS team, floor(value)::BIGINT AS score FROM events),
rd AS (SELECT user_id, camera, quarter, coalesce(sum(score) FILTER (team = 'A'), 0)::BIGINT AS score_a, coalesce(sum(score) FILTER (team = 'B'), 0)::BIGINT AS score_b FROM sc GROUP BY 1, 2, 3),
rg AS (SELECT *, CASE WHEN score_b > score_a THEN 'B' ELSE 'A' END AS dominant, abs(score_a - score_b) AS gap FROM rd)"""


def readings(spark: SparkSession, d: str) -> DataFrame:
    cam, q = F.when(F.col("event_id") % 2 == 0, "c1").otherwise("c2"), 1 + F.expr("event_id div 2") % 4
    team = F.when(F.col("event_type").isin("click", "view"), "A").otherwise("B")
    s = A.read(spark, d, "events").select("user_id", cam.alias("camera"), q.alias("quarter"), team.alias("team"), F.floor("value").alias("score"))
    return reconcile.reading(s, ["user_id", "camera", "quarter"], "A", "B")


@query(f"WITH {SCORE_SQL} SELECT * FROM rg")
def team_reading(spark, d):
    return readings(spark, d)


@query(
    f"""WITH {SCORE_SQL}, u AS (SELECT DISTINCT user_id FROM events), gr AS (SELECT user_id, camera, quarter FROM u, (VALUES ('c1'), ('c2')) c(camera), (VALUES (1), (2), (3), (4)) q(quarter)),
al AS (SELECT gr.*, dominant, gap FROM gr LEFT JOIN rg USING (user_id, camera, quarter)),
b AS (SELECT *, first_value(dominant) OVER (PARTITION BY user_id, camera, quarter % 2 ORDER BY dominant IS NULL, gap DESC, quarter) AS team FROM al),
m AS (SELECT user_id, quarter, max(team) FILTER (camera = 'c1') AS t1, max(team) FILTER (camera = 'c2') AS t2, coalesce(max(gap) FILTER (camera = 'c1'), 0) AS g1, coalesce(max(gap) FILTER (camera = 'c2'), 0) AS g2 FROM b GROUP BY 1, 2)
SELECT user_id, quarter::BIGINT AS quarter, 'c1' AS camera, CASE WHEN t1 = t2 AND g1 < g2 THEN CASE t2 WHEN 'A' THEN 'B' ELSE 'A' END ELSE t1 END AS team FROM m
UNION ALL SELECT user_id, quarter::BIGINT, 'c2', CASE WHEN t1 = t2 AND g1 >= g2 THEN CASE t1 WHEN 'A' THEN 'B' ELSE 'A' END ELSE t2 END FROM m"""
)
def alternation_reconcile(spark, d):
    users = A.read(spark, d, "events").select("user_id").distinct()
    grid = users.withColumn("camera", F.explode(F.array(F.lit("c1"), F.lit("c2")))).withColumn("quarter", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(4).cast("long"))))
    full = grid.join(readings(spark, d), ["user_id", "camera", "quarter"], "left")
    return reconcile.alternate(full, ["user_id"], "A", "B", "c1", "c2")


@query(
    """WITH p AS (SELECT l_returnflag AS team, (l_linenumber * 20 + l_suppkey % 10)::DOUBLE AS h, (l_partkey % 256)::DOUBLE AS s, (l_orderkey % 256)::DOUBLE AS v FROM lineitem), m AS (SELECT team, count(*) AS n, avg(h) AS hm, stddev_pop(h) AS hd, avg(s) AS sm, stddev_pop(s) AS sd, avg(v) AS vm, stddev_pop(v) AS vd FROM p GROUP BY 1)
SELECT team, n, greatest(round_even(hm - greatest(3 * hd, 8), 0), 0)::INT AS h_low, least(round_even(hm + greatest(3 * hd, 8), 0), 180)::INT AS h_high, greatest(round_even(sm - greatest(3 * sd, 35), 0), 0)::INT AS s_low, least(round_even(sm + greatest(3 * sd, 35), 0), 255)::INT AS s_high, greatest(round_even(vm - greatest(3 * vd, 35), 0), 0)::INT AS v_low, least(round_even(vm + greatest(3 * vd, 35), 0), 255)::INT AS v_high FROM m"""
)
def hsv_range_stats(spark, d):
    p = A.read(spark, d, "lineitem").select(F.col("l_returnflag").alias("team"), (F.col("l_linenumber") * 20 + F.col("l_suppkey") % 10).cast("double").alias("h"), (F.col("l_partkey") % 256).cast("double").alias("s"), (F.col("l_orderkey") % 256).cast("double").alias("v"))
    return colours.ranges(p, ["team"])


@query(f"WITH {TRK_SQL}, s AS (SELECT quarter, bucket // 60 AS span_id, min(frame) AS a, max(frame) AS b FROM trk GROUP BY 1, 2), g AS (SELECT quarter, span_id, unnest(range(a, b + 1, 50)) AS fr FROM s), c AS (SELECT quarter, frame AS fr, count(*) AS n, count(*) FILTER (zone = 'Perimeter') AS p FROM trk GROUP BY 1, 2) SELECT quarter, span_id, fr AS probe, coalesce(p, 0) AS n_perimeter, coalesce(n, 0) AS n_total FROM g LEFT JOIN c USING (quarter, fr)")
def full_zone_grid(spark, d):
    t = A.tracks(spark, d)
    spans = t.groupBy("quarter", F.expr("bucket div 60").alias("span_id")).agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"))
    return diagnostics.probe(spans, t, K, 50).select("quarter", "span_id", F.col("at").alias("probe"), "n_perimeter", "n_total")


@query(f"WITH {TRK_SQL}, s AS (SELECT quarter, bucket // 60 AS span_id, min(frame) AS a, max(frame) AS b FROM trk GROUP BY 1, 2), c AS (SELECT quarter, frame, count(*) FILTER (team = 'A') AS off, count(*) FILTER (team <> 'A') AS def FROM trk WHERE zone IN ('Behind Net', 'Perimeter') GROUP BY 1, 2) SELECT s.quarter, span_id, coalesce(max(off), 0) AS peak_off, coalesce(max(def), 0) AS peak_def FROM s LEFT JOIN c ON s.quarter = c.quarter AND frame BETWEEN a AND b GROUP BY 1, 2")
def peak_signal(spark, d):
    t = A.tracks(spark, d)
    spans = t.groupBy("quarter", F.expr("bucket div 60").alias("span_id")).agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"))
    return diagnostics.peaks(spans, t, K, "A", "B", 900, ("Behind Net", "Key", "Perimeter"))


@query(f"WITH {TRK_SQL} SELECT quarter, bucket, count(*) FILTER (track_id % 2 = 0) AS c0, count(*) FILTER (track_id % 2 = 1) AS c1 FROM trk GROUP BY 1, 2")
def two_camera_grid(spark, d):
    t = A.tracks(spark, d).drop("camera").withColumn("camera", F.concat(F.lit("c"), F.col("track_id") % 2)).groupBy("quarter", "bucket", "camera").agg(F.count(F.lit(1)).alias("n"))
    return diagnostics.side_by_side(t, K, "bucket", "n", ["c0", "c1"])


@query(f"WITH {TRK_SQL}, c AS (SELECT quarter, bucket // 30 AS span_id, count(*) FILTER (team = 'A') AS o, count(*) FILTER (team = 'B') AS f, count(*) AS n FROM trk GROUP BY 1, 2) SELECT quarter, arg_min(span_id, least(o / n, f / n) * -1000000 + span_id / 1000000) AS best_span FROM c GROUP BY 1")
def best_clip(spark, d):
    t = A.tracks(spark, d).groupBy("quarter", F.expr("bucket div 30").alias("span_id")).agg(F.count_if(F.col("team") == "A").alias("off_qualifying"), F.count_if(F.col("team") == "B").alias("def_qualifying"), F.count(F.lit(1)).alias("n_frames"))
    return diagnostics.clip_quality(t).groupBy("quarter").agg(F.min_by("span_id", F.struct(-F.col("quality"), F.col("span_id"))).alias("best_span"))


@query("SELECT p_partkey, printf('%d %.6f %.6f %.6f %.6f', p_size % 3, (p_partkey % 400 + p_partkey % 400 + 50) / 2.0 / 512, (p_size + p_size + 30) / 2.0 / 256, 50 / 512.0, 30 / 256.0) AS line FROM part")
def yolo_labels(spark, d):
    p = A.read(spark, d, "part").select("p_partkey", (F.col("p_size") % 3).alias("cls"), (F.col("p_partkey") % 400).alias("l"), (F.col("p_partkey") % 400 + 50).alias("r"), F.col("p_size").alias("t"), (F.col("p_size") + 30).alias("b"), F.lit(512).alias("w"), F.lit(256).alias("h"))
    return colours.yolo_labels(p, "w", "h").select("p_partkey", "line")


# --- alignment from tracks -----------------------------------------------------------------------
#: Clocks of 90 seconds, as long as a quarter of these data; two players make a huddle.
AP = replace(P, period_sec=90.0, anchor_radius_sec=9.0, huddle_players=2, huddle_ratio=25.0, huddle_samples=1, bad_anchor_ratio=1.2)

TIMELINE_SQL = f"""{TRK_SQL}, {SPINE_SQL},
nn AS (SELECT quarter, bucket, track_id % 2 AS cam, count(*) AS near, count(*) FILTER (team <> 'Goalie') AS n FROM trk WHERE zone = 'Behind Net' GROUP BY 1, 2, 3),
np AS (SELECT * FROM trk WHERE zone = 'Behind Net' AND team <> 'Goalie'),
pw AS (SELECT a.quarter, a.bucket, a.track_id % 2 AS cam, sum(sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy))) / count(*) AS m FROM np a JOIN np b ON a.quarter = b.quarter AND a.bucket = b.bucket AND a.track_id % 2 = b.track_id % 2 AND a.track_id < b.track_id GROUP BY 1, 2, 3),
tl AS (SELECT quarter, bucket, coalesce(max(near), 0) AS near, coalesce(bool_or(n >= 2 AND m / 40 < 25), false) AS huddled FROM spine LEFT JOIN nn USING (quarter, bucket) LEFT JOIN pw USING (quarter, bucket, cam) GROUP BY 1, 2),
qt AS (SELECT quarter, bucket FROM tl WHERE near <= 1), ht AS (SELECT quarter, bucket FROM tl WHERE huddled),
win AS (SELECT quarter, 'quiet' AS kind, s * 0.5::DOUBLE AS start_sec, e * 0.5::DOUBLE AS end_sec FROM {islands_sql('qt', 'quarter', 'bucket', 0)} WHERE n >= 2
  UNION ALL SELECT quarter, 'huddle', s * 0.5::DOUBLE, e * 0.5::DOUBLE FROM {islands_sql('ht', 'quarter', 'bucket', 0)})"""
ANCHOR_SQL = f"""{TIMELINE_SQL},
du AS (SELECT DISTINCT quarter, 2699 / 30.0::DOUBLE AS dur FROM spine),
mk AS (SELECT quarter, kind, t, dur, (t + CASE kind WHEN 'huddle' THEN 2.5::DOUBLE ELSE 0 END) / 90.0::DOUBLE * dur AS guess, row_number() OVER (PARTITION BY quarter, kind ORDER BY t) AS k
  FROM (SELECT quarter, 'quiet' AS kind, bucket * 0.5::DOUBLE AS t FROM spine WHERE bucket % 17 = 0 UNION ALL SELECT quarter, 'huddle', bucket * 0.5::DOUBLE FROM spine WHERE bucket % 23 = 5) JOIN du USING (quarter)),
wn AS (SELECT quarter, kind, (start_sec + end_sec) / 2 AS mid, row_number() OVER (PARTITION BY quarter, kind ORDER BY start_sec) AS i FROM win),
cd AS (SELECT quarter, kind, k, t, coalesce(list(i ORDER BY abs(mid - guess), i) FILTER (abs(mid - guess) < 9), []) AS c FROM mk LEFT JOIN wn USING (quarter, kind) GROUP BY 1, 2, 3, 4),
g AS (SELECT DISTINCT quarter, kind, 0::BIGINT AS k, 0::DOUBLE AS t, []::BIGINT[] AS used, NULL::BIGINT AS hit FROM mk
  UNION ALL SELECT quarter, kind, k, t, CASE WHEN hit IS NULL THEN used ELSE list_append(used, hit) END, hit FROM (SELECT cd.quarter, cd.kind, cd.k, cd.t, g.used, list_filter(cd.c, lambda x: NOT list_contains(g.used, x))[1] AS hit FROM g JOIN cd ON cd.quarter = g.quarter AND cd.kind = g.kind AND cd.k = g.k + 1)),
mt AS (SELECT g.quarter, g.kind, g.t AS "at", wn.mid AS "to" FROM g JOIN wn ON wn.quarter = g.quarter AND wn.kind = g.kind AND wn.i = g.hit),
an AS (SELECT quarter, "at", "to" FROM mt UNION SELECT quarter, 0, 0 FROM du UNION SELECT quarter, 90, dur FROM du),
ap AS (SELECT quarter, list(struct_pack(a := "at", v := "to") ORDER BY "at", "to") AS p, dur / 90 AS sc FROM an JOIN du USING (quarter) GROUP BY quarter, dur),
fl AS (SELECT quarter, 0 AS step, p, sc FROM ap
  UNION ALL SELECT quarter, step + 1, p[:i - 1] || p[i + 1:], sc FROM (SELECT *, list_filter(range(2, len(p)), lambda i: p[i].a > p[i - 1].a AND p[i + 1].a > p[i].a
    AND ((p[i].v - p[i - 1].v) / (p[i].a - p[i - 1].a) > sc * 1.2 OR (p[i].v - p[i - 1].v) / (p[i].a - p[i - 1].a) < sc / 1.2)
    AND ((p[i + 1].v - p[i].v) / (p[i + 1].a - p[i].a) > sc * 1.2 OR (p[i + 1].v - p[i].v) / (p[i + 1].a - p[i].a) < sc / 1.2))[1] AS i FROM fl) WHERE i IS NOT NULL),
kp AS (SELECT quarter, unnest(arg_max(p, step)) AS x FROM fl GROUP BY 1),
fa AS (SELECT quarter, x.a AS "at", x.v AS "to" FROM kp)"""


def two_cameras(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return A.seen_by_two(A.tracks(spark, d)), A.for_two(A.frames(spark, d)), A.for_two(A.quarters(spark, d))


def marks(spark: SparkSession, d: str, every: int, at: int) -> DataFrame:
    """Markers of a log: one in so many buckets."""
    return A.spine(spark, d).filter(F.col("bucket") % every == at).select("game", "quarter", (F.col("bucket") * 0.5).alias("elapsed_sec"))


def matched_markers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t, f, q = two_cameras(spark, d)
    spans = align.windows(align.timeline(align.near_net(t, f, AP), q, AP), K, "bucket", AP).withColumns({c: F.col(c) * 0.5 for c in ("start_sec", "end_sec")})
    kind = lambda df, k, delay: df.select("quarter", F.lit(k).alias("kind"), "elapsed_sec", F.lit(delay).alias("delay"))
    length = q.filter("camera_ix = 0").select("quarter", ((F.col("last_frame") - F.col("first_frame")) / 30.0).alias("duration"))
    m = kind(marks(spark, d, 17, 0), "quiet", 0.0).unionByName(kind(marks(spark, d, 23, 5), "huddle", AP.goal_delay_sec))
    return align.match_markers(m.join(length, K), spans, [*K, "kind"], p=AP), length


@query(f"WITH {TIMELINE_SQL} SELECT * FROM tl")
def near_net_timeline(spark, d):
    t, f, q = two_cameras(spark, d)
    return align.timeline(align.near_net(t, f, AP), q, AP).select("quarter", "bucket", "near", "huddled")


@query(f"WITH {TIMELINE_SQL} SELECT * FROM win")
def alignment_windows(spark, d):
    t, f, q = two_cameras(spark, d)
    got = align.windows(align.timeline(align.near_net(t, f, AP), q, AP), K, "bucket", AP)
    return got.withColumns({c: F.col(c) * 0.5 for c in ("start_sec", "end_sec")})


@query(f"WITH RECURSIVE {ANCHOR_SQL} SELECT * FROM mt")
def greedy_marker_match(spark, d):
    return matched_markers(spark, d)[0]


@query(f"WITH RECURSIVE {ANCHOR_SQL} SELECT * FROM fa")
def anchor_filter(spark, d):
    found, length = matched_markers(spark, d)
    ends = length.select("quarter", F.inline(F.array(F.struct(F.lit(0.0).alias("at"), F.lit(0.0).alias("to")), F.struct(F.lit(90.0).alias("at"), F.col("duration").alias("to")))))
    return align.filter_anchors(found.select("quarter", "at", "to").unionByName(ends).join(length, K), K, p=AP)


ALIGN_SQL = """
of AS (SELECT quarter, bucket, bucket * 0.5::DOUBLE AS s, bucket * 0.5::DOUBLE + 3 AS e FROM spine WHERE bucket % 40 = 7),
lk AS (SELECT quarter, p, len(p) AS n FROM (SELECT quarter, arg_max(p, step) AS p FROM fl GROUP BY 1)),
pt AS (SELECT quarter, bucket, w, t, p, n, list_filter(range(1, n), lambda i: t BETWEEN p[i].a AND p[i + 1].a)[1] AS i FROM (SELECT quarter, bucket, 's' AS w, s AS t FROM of UNION ALL SELECT quarter, bucket, 'e', e FROM of) JOIN lk USING (quarter)),
vt AS (SELECT quarter, bucket, w, CASE WHEN i IS NULL THEN CASE WHEN t < p[1].a THEN p[1].v ELSE p[n].v END WHEN p[i + 1].a = p[i].a THEN p[i].v ELSE p[i].v + (t - p[i].a) / (p[i + 1].a - p[i].a) * (p[i + 1].v - p[i].v) END AS v FROM pt)"""


@query(f"WITH RECURSIVE {ANCHOR_SQL}, {ALIGN_SQL} SELECT quarter, bucket, round(s.v, 1) AS start_sec, round(e.v, 1) AS end_sec, round(e.v - s.v, 1) AS duration_sec FROM (SELECT * FROM vt WHERE w = 's') s JOIN (SELECT * FROM vt WHERE w = 'e') e USING (quarter, bucket)")
def clock_alignment(spark, d):
    t, f, q = two_cameras(spark, d)
    official = records(spark, d).select("game", "quarter", "seq.bucket", "start_sec", "end_sec")
    return align.align_frames(t, f, q, official, marks(spark, d, 17, 0), marks(spark, d, 23, 5), AP).select("quarter", "bucket", "start_sec", "end_sec", "duration_sec")


# --- lookups, samples and streams ---------------------------------------------------------------
@query("SELECT l_returnflag, CASE l_returnflag WHEN 'R' THEN 'Red' WHEN 'A' THEN 'Amber' ELSE l_returnflag END AS team, CASE WHEN l_returnflag = 'R' THEN 'A' ELSE 'R' END AS other, count(*) AS n FROM lineitem GROUP BY 1, 2, 3")
def alias_normalised(spark, d):
    f = F.col("l_returnflag")
    return A.read(spark, d, "lineitem").groupBy("l_returnflag", clock.normalised(f, {"R": "Red", "A": "Amber"}).alias("team"), clock.other_team(f, "R", "A").alias("other")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {TRK_SQL} SELECT label, frame, quarter, (frame - (quarter - 1) * 2700) / 30.0::DOUBLE AS elapsed FROM (SELECT DISTINCT 'c' AS label, frame, 1 + frame // 2700 AS quarter FROM trk)")
def frame_quarter_lookup(spark, d):
    t = A.tracks(spark, d)
    first = (F.col("quarter") - 1) * 2700
    spans = t.select("camera", "quarter", first.alias("first_frame"), (first + 2699).alias("last_frame")).distinct()
    return tables.frame_quarter(t.select(F.col("camera").alias("label"), "frame").distinct(), spans, width=2700)


@query(f"WITH {TRK_SQL}, s AS (SELECT DISTINCT quarter, bucket // 40 AS span_id, (quarter - 1) * 2700 + bucket // 40 * 600 + 100 AS a, (quarter - 1) * 2700 + bucket // 40 * 600 + 400 AS b FROM trk) SELECT s.quarter, span_id, count(*) AS n, min(frame) AS lo, max(frame) AS hi FROM trk JOIN s ON trk.quarter = s.quarter AND frame BETWEEN a AND b GROUP BY 1, 2")
def frames_in_spans(spark, d):
    t = A.tracks(spark, d)
    part = F.expr("bucket div 40")
    first = (F.col("quarter") - 1) * 2700 + part * 600
    spans = t.select("quarter", part.alias("span_id"), (first + 100).alias("first_frame"), (first + 400).alias("last_frame")).distinct()
    met = intervals.binned_join(t.select("quarter", "frame"), spans, K, "frame", "first_frame", "last_frame", 300)
    return met.groupBy("quarter", "span_id").agg(F.count(F.lit(1)).alias("n"), F.min("frame").alias("lo"), F.max("frame").alias("hi"))


@query(f"WITH {SCORE_SQL}, t AS (SELECT DISTINCT user_id, quarter, team FROM sc) SELECT t.user_id, t.quarter, t.team, min(camera) AS camera FROM t JOIN rg ON t.user_id = rg.user_id AND t.quarter = rg.quarter AND rg.dominant <> t.team GROUP BY 1, 2, 3")
def attack_camera(spark, d):
    r = readings(spark, d)
    teams = r.select("user_id", "quarter", F.explode(F.array(F.when(F.col("score_a") >= 0, "A"), F.lit("B"))).alias("team")).distinct()
    score = A.read(spark, d, "events").select("user_id", (1 + F.expr("event_id div 2") % 4).alias("quarter"), F.when(F.col("event_type").isin("click", "view"), "A").otherwise("B").alias("team")).distinct()
    defends = r.select("user_id", "quarter", "camera", F.col("dominant").alias("def_team"), F.when(F.col("camera") == "c1", 0).otherwise(1).alias("camera_ix"))
    return reconcile.attack_camera(defends, teams.join(score, teams.columns, "left_semi"), ["user_id", "quarter"])


@query(f"WITH {LOG_HELD}, b AS (SELECT conv_id, 1 AS p, 0 AS m FROM held WHERE end_reason = 'goal' UNION ALL SELECT conv_id, 0, 1 FROM ev WHERE \"desc\" LIKE 'GOAL by%') SELECT conv_id, sum(p)::BIGINT AS n_possession_goals, sum(m)::BIGINT AS n_goal_lines, sum(p) = sum(m) AS consistent FROM b GROUP BY 1")
def goal_consistency(spark, d):
    ev = log_events(spark, d)
    return pbp.goal_consistency(pbp.possessions(ev, ["conv_id"]), pbp.goals(ev, ["conv_id"]), ["conv_id"])


@query(f"WITH {LINES_SQL} SELECT conv_id, seq, line, (1 + coalesce(sum(CASE WHEN lower(line) LIKE '%end-of-period%' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS block FROM lines")
def period_blocks(spark, d):
    return pbp.blocks(A.log_lines(spark, d), ["conv_id"])


@query("SELECT n_name AS name, r_name AS label FROM nation LEFT JOIN region ON n_name = r_name OR n_name = 'NATION_' || r_regionkey")
def camera_lookup(spark, d):
    cams = A.read(spark, d, "region").select(F.col("r_name").alias("label"), F.concat(F.lit("NATION_"), F.col("r_regionkey")).alias("video"))
    return diagnostics.camera_of(A.read(spark, d, "nation").select(F.col("n_name").alias("name")), cams)


@query("SELECT l_returnflag AS team, median(l_linenumber * 1.0::DOUBLE) AS h, median((l_partkey % 256)::DOUBLE) AS s, median((l_orderkey % 256)::DOUBLE) AS v, count(*) AS n_clicks FROM lineitem GROUP BY 1")
def click_medians(spark, d):
    p = A.read(spark, d, "lineitem").select(F.col("l_returnflag").alias("team"), (F.col("l_linenumber") * 1.0).cast("double").alias("h"), (F.col("l_partkey") % 256).cast("double").alias("s"), (F.col("l_orderkey") % 256).cast("double").alias("v"))
    return colours.click_medians(p, ["team"]).join(p.groupBy("team").agg(F.count(F.lit(1)).alias("n_clicks")), "team")


@query(f"WITH {BOTH}, i AS (SELECT unnest(range(5)) AS i) SELECT user_id, start_sec, start_sec + (end_sec - start_sec) * i / 4.0::DOUBLE AS at_sec FROM v, i")
def sample_times(spark, d):
    s = sessions(spark, d, ["view"], 1)
    return s.select("user_id", "start_sec", F.explode(sampling.sample_times(F.col("start_sec"), F.col("end_sec"), 5)).alias("at_sec"))


@query(f"WITH {TRK_SQL}, c AS (SELECT quarter, bucket, track_id % 2 AS cam, count(*) FILTER (zone = 'Behind Net') AS near FROM trk GROUP BY 1, 2, 3) SELECT quarter, bucket, max(near) AS near, bool_or(near >= 2) AS huddled FROM c GROUP BY 1, 2")
def cameras_combined(spark, d):
    t = A.tracks(spark, d).groupBy("quarter", "bucket", (F.col("track_id") % 2).alias("cam")).agg(F.count_if(F.col("zone") == "Behind Net").alias("near"))
    return align.combine_cameras(t.withColumn("huddled", F.col("near") >= 2), K, "bucket")


@query("SELECT min(o_orderkey) AS resume_at FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def resume_index(spark, d):
    return diagnostics.first_untagged(A.read(spark, d, "orders").select("o_orderkey"), A.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "o_orderkey")


@query("SELECT event_type, epoch_us(ts) // 3600000000 * 3600 AS start_sec, count(*) AS n FROM events GROUP BY 1, 2")
def stream_bucket_counts(spark, d):
    e = A.read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    got = live.bucket_counts(e, width="1 hour")
    return got.select("event_type", F.unix_seconds("start").alias("start_sec"), "n")


@query(
    """WITH g AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w <= 21600000000 THEN 0 ELSE 1 END AS nw FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY t) AS k FROM g) SELECT user_id, min(t) AS start_us, max(t) + 21600000000 AS end_us, count(*) AS n FROM s GROUP BY user_id, k"""
)
def stream_grace_sessions(spark, d):
    e = A.read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    got = live.grace_sessions(e, gap="6 hours")
    return got.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query(f"WITH {DETECT_SQL} SELECT * EXCLUDE (team) FROM det")
def stream_possessions(spark, d):
    return live.possessions_of(signal(spark, d), possessions.KEYS, P).select("quarter", "start_sec", "end_sec")


@query(
    "SELECT l_orderkey, l_linenumber, printf('%.1f', l_extendedprice / 8)::DOUBLE AS tenths, printf('%.2f', l_extendedprice * l_discount)::DOUBLE AS hundredths, printf('%.1f', CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END * (l_quantity + 0.25 * (l_orderkey % 4)))::DOUBLE AS ties FROM lineitem"
)
def exact_rounding(spark, d):
    price, off = F.col("l_extendedprice").cast("double"), F.col("l_discount").cast("double")
    tie = F.when(F.col("l_linenumber") % 2 == 0, -1).otherwise(1) * (F.col("l_quantity").cast("double") + 0.25 * (F.col("l_orderkey") % 4))
    return A.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", clock.rounded(price / 8).alias("tenths"), clock.rounded(price * off, 2).alias("hundredths"), clock.rounded(tie).alias("ties"))


# --- the whole --------------------------------------------------------------------------------
def records(spark: SparkSession, d: str) -> DataFrame:
    """Invented records of both teams: a short one in every 40 buckets of the spine."""
    s = A.spine(spark, d).filter("bucket % 40 = 7")
    team = F.when((F.col("bucket") + F.col("quarter")) % 3 == 0, "A").otherwise("B")
    return s.select("game", "quarter", F.struct("quarter", "bucket").alias("seq"), team.alias("team"), (F.col("bucket") * 0.5).alias("start_sec"), (F.col("bucket") * 0.5 + 3).alias("end_sec"), F.when(F.col("bucket") % 80 == 7, "goal").otherwise("turnover").alias("end_reason"))


# Records of a log, intervals found a second after some of them, and who defends on which of two cameras.
LOOK_SQL = f"""{TRK_SQL}, {SPINE_SQL}, of AS (SELECT quarter, CASE WHEN (bucket + quarter) % 3 = 0 THEN 'A' ELSE 'B' END AS team, bucket * 0.5::DOUBLE AS s, bucket * 0.5::DOUBLE + 3 AS e FROM spine WHERE bucket % 40 = 7),
fd AS (SELECT quarter, team, s + 1 AS s, e + 1 AS e FROM of WHERE (s * 2)::BIGINT % 60 = 7),
cm AS (SELECT *, CASE WHEN (quarter % 2 = 0) = (team = 'B') THEN 0 ELSE 1 END AS ix, (quarter - 1) * 2700 AS f0, quarter * 2700 - 1 AS f1 FROM of)"""


def looked_at(spark: SparkSession, d: str) -> tuple:
    t, _, q = two_cameras(spark, d)
    official = records(spark, d)
    found = official.filter("seq.bucket % 60 = 7").withColumns({c: F.col(c) + 1 for c in ("start_sec", "end_sec")})
    defends = q.select("game", "camera", "quarter", F.when((F.col("quarter") + F.col("camera_ix")) % 2 == 0, "A").otherwise("B").alias("def_team"))
    p = replace(P, unmatched_pad_sec=4.0, probe_within_sec=1.0, probe_step_sec=0.5, probe_pad_sec=2.0)
    return official, found, t, q, defends, ("A", "B"), p


@query(
    f"WITH {LOOK_SQL}, c AS (SELECT track_id % 2 AS ix, frame, count(*) FILTER (team = 'A') AS a, count(*) FILTER (team = 'B') AS b, count(*) FILTER (team = 'Goalie') AS g, "
    "count(*) FILTER (team = 'A' AND zone = 'Behind Net') AS da, count(*) FILTER (team = 'B' AND zone = 'Behind Net') AS db FROM trk WHERE zone IN ('Behind Net', 'Perimeter') GROUP BY 1, 2), "
    "un AS (SELECT * FROM cm WHERE NOT EXISTS (SELECT 1 FROM fd WHERE fd.quarter = cm.quarter AND fd.team = cm.team AND least(fd.e, cm.e) - greatest(fd.s, cm.s) > 0)) "
    "SELECT quarter, team, s AS start_sec, e AS end_sec, 'c' || un.ix AS camera, coalesce(max(CASE WHEN team = 'A' THEN a ELSE b END), 0) AS peak_off, coalesce(max(CASE WHEN team = 'A' THEN b ELSE a END + g), 0) AS peak_def, "
    "coalesce(max(CASE WHEN team = 'A' THEN da ELSE db END), 0) AS peak_deep FROM un LEFT JOIN c ON c.ix = un.ix AND frame BETWEEN f0 + trunc(greatest(s - 4, 0) * 30) AND least(f0 + trunc((e + 4) * 30), f1) GROUP BY 1, 2, 3, 4, 5"
)
def unmatched_peaks(spark, d):
    return diagnostics.unmatched_peaks(*looked_at(spark, d)).drop("game")


@query(
    f"WITH {LOOK_SQL}, c AS (SELECT track_id % 2 AS ix, frame, count(*) FILTER (team = 'A') AS a, count(*) FILTER (team = 'B') AS b, count(*) FILTER (team = 'Goalie') AS g, "
    "count(*) FILTER (team = 'A' AND zone <> 'Perimeter') AS da, count(*) FILTER (team = 'B' AND zone <> 'Perimeter') AS db FROM trk WHERE zone <> 'Beyond 30' GROUP BY 1, 2), "
    "mi AS (SELECT *, s - 2 + k * 0.5::DOUBLE AS t FROM cm, range(0, 15) r(k) WHERE NOT EXISTS (SELECT 1 FROM fd WHERE fd.quarter = cm.quarter AND fd.team = cm.team AND fd.s <= cm.e + 1 AND cm.s <= fd.e + 1)) "
    "SELECT quarter, team, s AS start_sec, e AS end_sec, 'c' || y.ix AS camera, y.ix = mi.ix AS assigned, t AS \"at\", t BETWEEN s AND e AS within, coalesce(CASE WHEN team = 'A' THEN a ELSE b END, 0) AS n_own, "
    "coalesce(CASE WHEN team = 'A' THEN b ELSE a END, 0) AS n_other, coalesce(g, 0) AS n_goalie, coalesce(CASE WHEN team = 'A' THEN da ELSE db END, 0) AS n_deep FROM mi CROSS JOIN (VALUES (0), (1)) y(ix) LEFT JOIN c ON c.ix = y.ix AND frame = f0 + trunc(t * 30)"
)
def missing_signal(spark, d):
    return diagnostics.missing_signal(*looked_at(spark, d)).drop("game")


def whole(spark: SparkSession, d: str) -> DataFrame:
    p = replace(P, long_block_sec=8.0, split_buffer_sec=2.0)
    spine = A.spine(spark, d)
    defends = spine.select("game", "camera", "quarter", F.when(F.col("quarter") % 2 == 0, "A").otherwise("B").alias("def_team")).distinct()
    lines = spark.range(1).select(F.lit("g").alias("game"), F.lit("c").alias("camera"), F.lit(CAL.yard8_y).alias("yard8_y"), F.lit(CAL.yard30_y).alias("yard30_y"), F.lit(CAL.frame_height).alias("frame_height"))
    found = analysis.detect_frames(A.tracks(spark, d).drop("quarter", "bucket"), A.quarters(spark, d), defends, lines, ("A", "B"), p)
    return analysis.with_records(found, records(spark, d), p)


WHOLE_SQL = f"""{TRK_SQL}, {SPINE_SQL},
sd AS (SELECT *, CASE WHEN quarter % 2 = 0 THEN 'A' ELSE 'B' END AS d, CASE WHEN quarter % 2 = 0 THEN 'B' ELSE 'A' END AS o FROM trk),
nr AS (SELECT * FROM sd WHERE NOT (zone = 'Perimeter' AND cy < 600 - 0.7 * 400)),
f AS (SELECT quarter, bucket, count(*) FILTER (zone <> 'Beyond 30' AND team = o) AS off, count(*) FILTER (zone <> 'Beyond 30' AND team IN (d, 'Goalie')) AS def, count(*) FILTER (zone IN ('Behind Net', 'Net-to-8') AND team = o) AS deep FROM nr GROUP BY 1, 2),
g AS (SELECT *, lead(frame) OVER w AS nf, lead(bucket) OVER w AS nb, row_number() OVER w AS n FROM sd WHERE team IN (o, d) WINDOW w AS (PARTITION BY quarter, track_id ORDER BY frame)),
cr AS (SELECT quarter, bucket, count(*) FILTER (team = o) AS coff, count(*) FILTER (team = d) AS cdef FROM (SELECT quarter, team, o, d, unnest(range(bucket, nb + 1)) AS bucket FROM g WHERE nf - frame > 1 AND n >= 5 AND zone = 'Behind Net' AND cy >= 0.95 * 1200 AND (nf - frame) / 30.0 <= 8) GROUP BY 1, 2),
op AS (SELECT * FROM nr WHERE team = o AND zone <> 'Beyond 30'), on_ AS (SELECT quarter, bucket, count(*) AS n FROM op GROUP BY 1, 2),
pr AS (SELECT a.quarter, a.bucket, sum(sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy))) / count(*) AS m FROM op a JOIN op b ON a.quarter = b.quarter AND a.bucket = b.bucket AND a.track_id < b.track_id GROUP BY 1, 2),
sg AS (SELECT quarter, bucket, coalesce(off, 0) + coalesce(coff, 0) AS off, coalesce(def, 0) + coalesce(cdef, 0) AS def, coalesce(deep, 0) + coalesce(coff, 0) AS deep, coalesce(n >= 4 AND m / 40 < 20, false) AS hd
        FROM spine LEFT JOIN f USING (quarter, bucket) LEFT JOIN cr USING (quarter, bucket) LEFT JOIN on_ USING (quarter, bucket) LEFT JOIN pr USING (quarter, bucket)),
loose AS (SELECT * FROM sg WHERE off >= 4 AND def >= 4 AND NOT hd), strict AS (SELECT * FROM sg WHERE off >= 4 AND def >= 4 AND deep >= 3),
seg AS {islands_sql('loose', 'quarter', 'bucket', 1)}, run AS {islands_sql('strict', 'quarter', 'bucket', 0)}, du AS (SELECT DISTINCT quarter, 2699 / 30.0::DOUBLE AS dur FROM spine),
b AS (SELECT DISTINCT seg.quarter, CASE WHEN seg.quarter % 2 = 0 THEN 'B' ELSE 'A' END AS team, CASE WHEN seg.quarter % 2 = 0 THEN 'A' ELSE 'B' END AS other, seg.s * 0.5::DOUBLE AS bs, round(least(seg.e * 0.5::DOUBLE + 4, dur), 1) AS be
      FROM seg JOIN run ON seg.quarter = run.quarter AND least(seg.e, run.e) - greatest(seg.s, run.s) >= 3 JOIN du ON du.quarter = seg.quarter),
rc AS (SELECT quarter, bucket, CASE WHEN (bucket + quarter) % 3 = 0 THEN 'A' ELSE 'B' END AS team, bucket * 0.5::DOUBLE AS s, bucket * 0.5::DOUBLE + 3 AS e, CASE WHEN bucket % 80 = 7 THEN 'goal' ELSE 'turnover' END AS why FROM spine WHERE bucket % 40 = 7),
m AS (SELECT b.*, greatest(s, bs) AS s, least(e, be) AS e FROM b JOIN rc ON b.quarter = rc.quarter AND b.other = rc.team AND be - bs > 8 AND s >= bs - 2 AND e <= be + 2),
p AS (SELECT *, coalesce(lag(e) OVER w, bs) AS cur, lead(s) OVER w AS nx FROM m WHERE e > s WINDOW w AS (PARTITION BY quarter, bs, be ORDER BY s, e)),
pc AS (SELECT quarter, team, cur AS start_sec, s AS end_sec, 'video_detected' AS boundary_source FROM p WHERE s > cur
  UNION ALL SELECT quarter, other, s, e, 'official_split_within_long_video_block' FROM p
  UNION ALL SELECT quarter, team, e, be, 'video_detected' FROM p WHERE nx IS NULL AND be > e
  UNION ALL SELECT quarter, team, bs, be, 'video_detected' FROM b WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.quarter = b.quarter AND p.bs = b.bs AND p.be = b.be)),
wh AS (SELECT pc.quarter, pc.team, start_sec, end_sec, end_sec - start_sec AS duration_sec, boundary_source, coalesce(arg_min(why, abs(end_sec - e) * 1000000 + bucket), 'unknown') AS end_reason, end_sec - start_sec > 8 AS long
       FROM pc LEFT JOIN rc ON pc.quarter = rc.quarter AND pc.team = rc.team GROUP BY ALL)"""


@query(f"WITH {WHOLE_SQL} SELECT * FROM wh")
def possessions_whole(spark, d):
    return whole(spark, d).select("quarter", "team", "start_sec", "end_sec", "duration_sec", "boundary_source", "end_reason", "long")


@query(f"WITH {WHOLE_SQL} SELECT team, count(*) AS n_official, count(*) FILTER (EXISTS (SELECT 1 FROM wh WHERE wh.quarter = rc.quarter AND wh.team = rc.team AND s <= end_sec + 15 AND start_sec <= e + 15)) AS n_matched FROM rc GROUP BY 1")
def possessions_checked(spark, d):
    return longs(analysis.checks(whole(spark, d), records(spark, d), replace(P, match_window_sec=15.0))["matched"], "n_matched")


SPANS_SQL = f"""{WHOLE_SQL},
sp AS (SELECT quarter, team, CASE team WHEN 'A' THEN 'B' ELSE 'A' END AS other, start_sec, end_sec, (quarter - 1) * 2700 + trunc(start_sec * 30)::BIGINT AS lo, (quarter - 1) * 2700 + trunc(end_sec * 30)::BIGINT AS hi FROM wh)"""
SHAPES_SQL = f"""{SPANS_SQL},
pf AS (SELECT sp.quarter, sp.team, start_sec, end_sec, frame, CASE WHEN trk.team = sp.team THEN 'off' ELSE 'def' END AS side, count(*) FILTER (zone = 'Behind Net') AS bn, count(*) FILTER (zone = 'Net-to-8') AS n8, count(*) FILTER (zone = 'Perimeter') AS pm
        FROM sp JOIN trk ON frame BETWEEN lo AND hi WHERE zone <> 'Beyond 30' GROUP BY 1, 2, 3, 4, 5, 6),
ph AS (SELECT quarter, team, start_sec, end_sec, side, bn, n8, pm, printf('(%d, %d, %d)', bn, n8, pm) AS k, count(*) AS cnt, min(frame) AS ff FROM pf WHERE bn + n8 + pm >= 3 GROUP BY 1, 2, 3, 4, 5, 6, 7, 8),
pb AS (SELECT quarter, team, start_sec, end_sec, side, arg_min(k, -cnt * 100000000 + ff) AS formation, sum(cnt)::BIGINT AS n, '{{' || string_agg('"' || k || '":' || cnt, ',' ORDER BY k) || '}}' AS dist FROM ph GROUP BY 1, 2, 3, 4, 5),
fn AS (SELECT sp.quarter, sp.team, start_sec, end_sec, count(*) AS n_frames FROM sp JOIN (SELECT DISTINCT event_id // 14 * 15 AS frame FROM events) f ON frame BETWEEN lo AND hi GROUP BY 1, 2, 3, 4),
sh AS (SELECT sp.quarter, sp.team, sp.other, sp.start_sec, sp.end_sec, coalesce(n_frames, 0) AS n_frames, o.formation AS off_formation, o.dist AS off_distribution, coalesce(o.n, 0) AS off_n, f.formation AS def_formation, f.dist AS def_distribution, coalesce(f.n, 0) AS def_n
        FROM sp LEFT JOIN fn USING (quarter, team, start_sec, end_sec) LEFT JOIN (SELECT * FROM pb WHERE side = 'off') o USING (quarter, team, start_sec, end_sec) LEFT JOIN (SELECT * FROM pb WHERE side = 'def') f USING (quarter, team, start_sec, end_sec))"""
TEAM_CUTS_SQL = f"""{SPANS_SQL},
gp AS (SELECT *, lead(frame) OVER w AS nf, lead(cx) OVER w AS ncx, lead(cy) OVER w AS ncy, lead(zone) OVER w AS nz FROM trk WINDOW w AS (PARTITION BY quarter, track_id ORDER BY frame)),
gf AS (SELECT *, unnest(range(frame + 15, nf, 15)) AS fr FROM gp WHERE nf - frame BETWEEN 16 AND 150 AND sqrt((ncx - cx) * (ncx - cx) + (ncy - cy) * (ncy - cy)) <= 320),
al AS (SELECT track_id, team, frame, zone FROM trk UNION ALL SELECT track_id, team, fr, CASE WHEN (fr - frame) / (nf - frame)::DOUBLE < 0.5 THEN zone ELSE nz END FROM gf),
cw AS (SELECT sp.quarter, sp.team, start_sec, end_sec, track_id, frame, zone FROM sp JOIN al ON al.team = sp.team AND frame BETWEEN lo AND hi WHERE zone IN ('Net-to-8', 'Perimeter')),
w1 AS (SELECT *, CASE WHEN zone = lag(zone) OVER w THEN 0 ELSE 1 END AS ch FROM cw WINDOW w AS (PARTITION BY quarter, team, start_sec, end_sec, track_id ORDER BY frame)),
w2 AS (SELECT *, sum(ch) OVER (PARTITION BY quarter, team, start_sec, end_sec, track_id ORDER BY frame) AS run FROM w1),
w3 AS (SELECT quarter, team, start_sec, end_sec, track_id, run, zone, min(frame) AS first, count(*) AS n FROM w2 GROUP BY 1, 2, 3, 4, 5, 6, 7),
w4 AS (SELECT *, lag(zone) OVER (PARTITION BY quarter, team, start_sec, end_sec, track_id ORDER BY first) AS pz FROM w3 WHERE n >= 2),
w5 AS (SELECT quarter, team, start_sec, end_sec, count(*) FILTER (zone = 'Net-to-8') AS n_in, count(*) FILTER (zone = 'Perimeter') AS n_out, string_agg(first || CASE zone WHEN 'Net-to-8' THEN 'in' ELSE 'out' END || track_id, ',' ORDER BY first, CASE zone WHEN 'Net-to-8' THEN 0 ELSE 1 END, track_id) AS cuts FROM w4 WHERE pz <> zone GROUP BY 1, 2, 3, 4),
nt AS (SELECT quarter, team, start_sec, end_sec, count(DISTINCT track_id) AS n FROM cw GROUP BY 1, 2, 3, 4),
pc_ AS (SELECT quarter, team, start_sec, end_sec, coalesce(n_in, 0) AS n_cuts_in, coalesce(n_out, 0) AS n_cuts_out, coalesce(n, 0) AS n_tracks, coalesce(cuts, '') AS cuts, coalesce(n_in + n_out, 0) = 0 AS suspect_zero_cuts FROM sp LEFT JOIN w5 USING (quarter, team, start_sec, end_sec) LEFT JOIN nt USING (quarter, team, start_sec, end_sec))"""


def spans(spark: SparkSession, d: str) -> DataFrame:
    """The possessions of possessions_whole, written: what is made of them reads them several times."""
    return tables.staged(whole(spark, d).withColumn("other", clock.other_team(F.col("team"), "A", "B")).select(*formations.ID))


def filled(spark: SparkSession, d: str) -> DataFrame:
    """Tracks with their gaps filled; not from or to a detection whose place isn't known."""
    t = A.tracks(spark, d)
    made = tracking.interpolate(t, ["game", "camera", "quarter"], P).dropna(subset=["cx", "cy"])
    return t.withColumn("interpolated", F.lit(False)).unionByName(made, allowMissingColumns=True)


def shapes(spark: SparkSession, d: str) -> DataFrame:
    return formations.of_possessions(filled(spark, d), A.frames(spark, d), spans(spark, d), A.quarters(spark, d), P)


@query(f"WITH {SHAPES_SQL} SELECT * FROM sh")
def formations_by_possession(spark, d):
    text = lambda s: F.when(F.col(f"{s}_formation").isNotNull(), F.format_string("(%d, %d, %d)", f"{s}_formation.bn", f"{s}_formation.n8", f"{s}_formation.pm")).alias(f"{s}_formation")
    side = lambda s: [text(s), F.to_json(f"{s}_distribution").alias(f"{s}_distribution"), F.col(f"{s}_n_qualifying").alias(f"{s}_n")]
    return shapes(spark, d).select("quarter", "team", "other", "start_sec", "end_sec", "n_frames", *side("off"), *side("def"))


@query(f"WITH {SHAPES_SQL}, u AS (SELECT 'off' AS side, team, off_formation AS formation FROM sh UNION ALL SELECT 'def', other, def_formation FROM sh) SELECT side, team, formation, count(*) AS n, sum(count(*)) OVER (PARTITION BY side, team)::BIGINT AS total FROM u WHERE formation IS NOT NULL GROUP BY 1, 2, 3")
def formations_by_side(spark, d):
    got = formations.frequency_by_side(shapes(spark, d))
    return got.withColumn("formation", F.format_string("(%d, %d, %d)", "formation.bn", "formation.n8", "formation.pm"))


def team_cuts(spark: SparkSession, d: str) -> DataFrame:
    return formations.cuts_of_possessions(filled(spark, d), spans(spark, d), A.quarters(spark, d), P)


@query(f"WITH {TEAM_CUTS_SQL} SELECT * FROM pc_")
def cuts_by_possession(spark, d):
    text = F.array_join(F.transform("cuts", lambda c: F.concat(c["frame"], c["direction"], c["track_id"])), ",")
    return team_cuts(spark, d).select("quarter", "team", "start_sec", "end_sec", "n_cuts_in", "n_cuts_out", "n_tracks", text.alias("cuts"), "suspect_zero_cuts")


@query(f"WITH {TEAM_CUTS_SQL} SELECT team, sum(n_cuts_in)::BIGINT AS cuts_in, sum(n_cuts_out)::BIGINT AS cuts_out, count(*) FILTER (NOT suspect_zero_cuts) AS possessions_with_cuts, count(*) AS n_possessions FROM pc_ GROUP BY 1")
def cuts_by_team(spark, d):
    return formations.cuts_by_team(team_cuts(spark, d))


def entry(spark: SparkSession) -> DataFrame:
    return possessions_detected(spark, "/root/testdata/sf0.001")
