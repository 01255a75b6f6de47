"""Hand-computed cases, and plain sequential versions on random input."""

import math
import random

import pytest
from pyspark.sql import functions as F

from fieldspan.functions import clock, spatial
from fieldspan.operators import align, formations, intervals, pbp, reconcile, sampling, sequence, tracking
from fieldspan.params import Params
from fieldspan.sources import tables


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


LOG = ["15:00 0", "14:30 A Draw control by A P1", "-- A Shot by A P1", "13:30 A GOAL by A P1", "-- B Draw control by B P2", "12:00 B Turnover by B P2", "11:00 A Clear attempt by A good", "11:00 A Timeout by A", "00:00 0 End-of-period"]


def test_log(spark):
    lines = spark.createDataFrame([("g", i, x) for i, x in enumerate(LOG)], "game string, seq int, line string")
    ev = pbp.parse(lines, ["game"])
    assert rows(pbp.possessions(ev, ["game"]), "quarter", "team", "start_sec", "end_sec", "end_reason") == [(1, "A", 30.0, 90.0, "goal"), (1, "A", 240.0, 900.0, "period_end"), (1, "B", 180.0, 240.0, "turnover")]
    assert rows(pbp.stoppages(ev, ["game"]), "quarter", "elapsed_sec", "type") == [(1, 240.0, "timeout")]
    assert rows(pbp.goals(ev, ["game"]), "quarter", "elapsed_sec", "team") == [(1, 90.0, "A")]
    assert rows(ev.filter("time_str = '--'"), "seq", "elapsed_sec") == [(2, 90.0), (4, 180.0)]


def walk(events, end):
    out, team, start = [], None, None
    for t, claim, goal in events:
        if goal and goal == team:
            if t > start:
                out.append((team, start, t, "goal"))
            team = None
        elif claim and claim != team:
            if team and t > start:
                out.append((team, start, t, "turnover"))
            team, start = claim, t
    if team and end > start:
        out.append((team, start, end, "period_end"))
    return out


def test_state_machine_against_a_walk(spark):
    rng, data, want = random.Random(3), [], []
    for k in range(150):
        t, ev = 0, []
        for i in range(rng.randrange(1, 14)):
            t += rng.randrange(0, 4)
            what = rng.random()
            claim, goal = (rng.choice("AB"), None) if what < 0.5 else (None, rng.choice("AB")) if what < 0.75 else (None, None)
            ev.append((float(t), claim, goal))
            data.append((k, i, float(t), claim, goal))
        want += [(k, *x) for x in walk(ev, 60.0)]
    df = spark.createDataFrame(data, "k int, i int, t double, claim string, goal string")
    assert rows(pbp.held_intervals(df, ["k"], "i", "t", 60.0), "k", "team", "start_sec", "end_sec", "end_reason") == sorted(want)


def test_grace_and_gate(spark):
    loose = [*range(10), *range(28, 36), *range(55, 61)]
    strict = [*range(2, 8), *range(55, 60)]
    frame = lambda xs: spark.createDataFrame([("q", x) for x in xs], "q string, b int")
    seg = sequence.islands(frame(loose), ["q"], "b", 18)
    assert rows(seg, "start", "end") == [(0, 36), (55, 61)]
    assert rows(sequence.sustained(seg, frame(strict), ["q"], "b", 6), "start", "end") == [(0, 36)]


def test_interpolation(spark):
    def fill(next_frame, cx):
        data = [("q", 1, 0, "A", 0, 100, 0, 90, -10, 110, 10, "X"), ("q", 1, 1, "A", next_frame, cx, 0, cx - 10, -10, cx + 10, 10, "Y")]
        df = spark.createDataFrame(data, "q string, track_id int, det_ix int, team string, frame int, cx int, cy int, l int, t int, r int, b int, zone string")
        return rows(tracking.interpolate(df, ["q"]), "frame", "cx", "zone")

    assert fill(12, 112) == [(3, 103, "X"), (6, 106, "Y"), (9, 109, "Y")]
    assert fill(3, 110) == [] and len(fill(30, 110)) == 9 and fill(31, 110) == []
    assert len(fill(12, 260)) == 3 and fill(12, 261) == []


def test_cuts(spark):
    z = {"P": "Perimeter", "N": "Net-to-8"}
    df = spark.createDataFrame([(1, 3 * i, z[c]) for i, c in enumerate("PPPNNPPPNNN")], "track_id int, frame int, zone string")
    assert rows(formations.cut_events(df, ["track_id"], 3), "frame", "direction") == [(24, "in")]


def test_anchors(spark):
    def run(points, t):
        a = spark.createDataFrame([("q", float(x), float(y), 1000.0) for x, y in points], "q string, at double, to double, duration double")
        kept = align.filter_anchors(a, ["q"])
        return intervals.piecewise(spark.createDataFrame([("q", float(x)) for x in t], "q string, t double"), kept, ["q"], "t", "v")

    assert rows(run([(0, 0), (100, 500), (900, 1000)], [450]), "v") == [(500.0,)]
    assert rows(run([(0, 0), (450, 600), (900, 1000)], [225, 675, 1200, -5]), "v") == [(0.0,), (300.0,), (800.0,), (1000.0,)]


def test_markers_take_windows_once(spark):
    m = spark.createDataFrame([("q", 100.0, 0.0, 900.0), ("q", 110.0, 0.0, 900.0), ("q", 500.0, 0.0, 900.0)], "q string, elapsed_sec double, delay double, duration double")
    w = spark.createDataFrame([("q", 100.0, 104.0), ("q", 130.0, 134.0)], "q string, start_sec double, end_sec double")
    assert rows(align.match_markers(m, w, ["q"]), "at", "to") == [(100.0, 102.0), (110.0, 132.0)]


def greedy(marks, windows, radius=90.0):
    left, out = sorted(windows), []
    for t, guess in sorted(marks):
        near = sorted((abs((a + b) / 2 - guess), i) for i, (a, b) in enumerate(left))
        if near and near[0][0] < radius:
            a, b = left.pop(near[0][1])
            out.append((t, (a + b) / 2))
    return out


def unbent(points, scale, ratio=1.6):
    """The first inner point whose slopes are both off goes, again and again."""
    points = sorted(set(points))
    off = lambda p, q: q[0] > p[0] and not scale / ratio <= (q[1] - p[1]) / (q[0] - p[0]) <= scale * ratio
    while bad := [i for i in range(1, len(points) - 1) if off(points[i - 1], points[i]) and off(points[i], points[i + 1])]:
        del points[bad[0]]
    return points


def test_markers_and_anchors_as_in_plain_loops(spark):
    """Many groups at once, with ties, repeated rows, groups with one side only, and nulls that match nothing."""
    rng = random.Random(7)
    marks = {g: [(float(rng.randrange(0, 900, 30)), 0.0) for _ in range(g % 9)] for g in range(40)}
    windows = {g: [(float(a), float(a + rng.choice([4, 4, 20]))) for a in (rng.randrange(0, 900, 10) for _ in range(g % 7))] for g in range(40)}
    m = spark.createDataFrame([(g, t, d, 900.0) for g, x in marks.items() for t, d in x] + [(3, None, 0.0, 900.0), (4, 10.0, 0.0, None)], "g int, elapsed_sec double, delay double, duration double")
    w = spark.createDataFrame([(g, a, b) for g, x in windows.items() for a, b in x] + [(5, None, 10.0)], "g int, start_sec double, end_sec double")
    want = sorted((g, at, to) for g in marks for at, to in greedy([(t, t) for t, _ in marks[g]], windows[g]))
    assert rows(align.match_markers(m, w, ["g"]), "g", "at", "to") == want and len(want) > 40

    # Enough wild points that taking one out makes the ones before it bend.
    points = {g: [(float(rng.randrange(0, 900, 20)), float(rng.randrange(0, 900, 20))) for _ in range(g)] for g in range(40)}
    a = spark.createDataFrame([(g, x, y, 900.0) for g, v in points.items() for x, y in v] + [(2, None, 1.0, 900.0), (2, 1.0, None, 900.0)], "g int, at double, to double, duration double")
    want = sorted((g, x, y) for g, v in points.items() for x, y in unbent(v, 1.0))
    assert rows(align.filter_anchors(a, ["g"]), "g", "at", "to") == want and len(want) < 600 < 780 == sum(map(len, points.values()))
    for made in (align.match_markers(m, w, ["g"]), align.filter_anchors(a, ["g"])):
        assert "Python" not in made._jdf.queryExecution().executedPlan().toString()
        assert made.limit(0).count() == 0
    assert align.match_markers(m.limit(0), w.limit(0), ["g"]).count() == align.filter_anchors(a.limit(0), ["g"]).count() == 0


def test_reconcile(spark):
    read = {"cam1": [("A", 0.2), ("A", 0.5), ("B", 0.9), (None, None)], "cam2": [("B", 0.5), ("B", 0.3), ("A", 0.1), ("B", 0.2)]}
    data = [("g", c, q + 1, t, gap) for c, x in read.items() for q, (t, gap) in enumerate(x)]
    df = spark.createDataFrame(data, "game string, camera string, quarter int, dominant string, gap double")
    got = rows(reconcile.alternate(df, ["game"], "A", "B", "cam1", "cam2"), "camera", "quarter", "team")
    assert "".join(t for _, _, t in got) == "AABA" + "BBAB"


def test_split(spark):
    def run(end):
        b = spark.createDataFrame([("q", "A", "B", 0.0, end)], "q string, team string, other string, start_sec double, end_sec double")
        h = spark.createDataFrame([("q", "B", 50.0, 70.0), ("q", "B", 190.0, 230.0)], "q string, team string, start_sec double, end_sec double")
        return rows(intervals.split_blocks(b, h, ["q"], 150.0, 45.0), "start_sec", "end_sec", "team")

    assert run(200.0) == [(0.0, 50.0, "A"), (50.0, 70.0, "B"), (70.0, 190.0, "A"), (190.0, 200.0, "B")]
    assert run(150.0) == [(0.0, 150.0, "A")]


def test_tracker_reach_and_retirement(spark):
    def ids(second_frame, cx):
        df = spark.createDataFrame([("q", 0, 0, "A", 0, 0), ("q", second_frame, 0, "A", cx, 0), ("q", second_frame, 1, "Unknown", 5, 5)], "q string, frame int, det_ix int, team string, cx int, cy int")
        got = {(r.frame, r.det_ix): r.track_id for r in tracking.track(df, ["q"], ["A", "Goalie"]).collect()}
        assert got[second_frame, 1] is None
        return got[0, 0], got[second_frame, 0]

    assert ids(3, 76) == (1, 1) and ids(3, 77) == (1, 2) and ids(90, 500) == (1, 1) and ids(93, 0) == (1, 2)


def plain_tracks(dets, p=Params()):
    live, out, n = {}, {}, 0
    frames = {}
    for d in dets:
        frames.setdefault(d[0], []).append(d)
    for f, now in sorted(frames.items()):
        live = {k: v for k, v in live.items() if f - v[3] <= p.track_max_gap}
        pairs = sorted((math.hypot(d[3] - x, d[4] - y), i, k) for i, d in enumerate(now) for k, (team, x, y, seen) in live.items() if team == d[2] and math.hypot(d[3] - x, d[4] - y) <= min(12 * (f - seen) + 40, 500))
        took, used = {}, set()
        for _, i, k in pairs:
            if i not in took and k not in used:
                took[i] = k
                used.add(k)
        for i, d in enumerate(now):
            if i not in took:
                n += 1
                took[i] = n
            live[took[i]] = (d[2], d[3], d[4], f)
            out[f, d[1]] = took[i]
    return out


@pytest.mark.parametrize("cut", [{}, {"chunk": 91, "warm_up": 0}, {"chunk": 120, "warm_up": 40}, {"chunk": 300, "warm_up": 270}])
def test_tracker_in_chunks_is_the_whole(spark, cut):
    rng = random.Random(5)
    data, want = [], {}
    for k in range(12):
        f, dets = 0, []
        for _ in range(30):
            f += rng.choice([3, 3, 3, 60, 95])
            dets += [(f, i, rng.choice("AB"), rng.randrange(700), rng.randrange(700)) for i in range(rng.randrange(4))]
        data += [(k, *d) for d in dets]
        want |= {(k, *key): v for key, v in plain_tracks(dets).items()}
    df = spark.createDataFrame(data, "k int, frame int, det_ix int, team string, cx int, cy int")
    got = {(r.k, r.frame, r.det_ix): r.track_id for r in tracking.track(df, ["k"], ["A", "B"], **cut).collect()}
    assert got == want


def test_tracker_over_one_long_stretch(spark):
    """A hundred thousand frames without a pause, in 34 chunks: players move, cross, are missed now and then, and leave for a while."""
    rng = random.Random(6)
    at = [(t, rng.uniform(0, 3800), rng.uniform(0, 2100)) for t in "AAAAABBBBB"]
    dets = []
    for f in range(0, 100_000, 3):
        at = [(t, min(3800, max(0, x + rng.gauss(0, 9))), min(2100, max(0, y + rng.gauss(0, 9)))) for t, x, y in at]
        dets += [(f, i, t, int(x), int(y)) for i, (t, x, y) in enumerate(at) if rng.random() > 0.08 and ((f // 900 + i) % 7 or f % 900 > 120)]
    want = plain_tracks(dets)
    df = spark.createDataFrame([("k", *d) for d in dets], "k string, frame int, det_ix int, team string, cx int, cy int").repartition(8)
    got = tracking.track(df, ["k"], ["A", "B"]).collect()
    assert {(r.frame, r.det_ix): r.track_id for r in got} == want and max(want.values()) > 10


def test_tracker_on_nothing(spark):
    df = spark.createDataFrame([], "k string, frame int, det_ix int, team string, cx int, cy int")
    assert tracking.track(df, ["k"], ["A"]).count() == 0
    df = spark.createDataFrame([("k", 5, 0, "Unknown", 1, 1), ("k", 3005, 0, None, 1, 1)], df.schema)
    assert [r.track_id for r in tracking.track(df, ["k"], ["A"]).collect()] == [None, None]


def test_zones(spark):
    cal = spatial.Calibration(1000.0, 600.0, 200.0, ((900.0, 1000.0), (1100.0, 1000.0), (800.0, 700.0), (1200.0, 700.0)))
    points = {(1000, 1001): "Behind Net", (1000, 800): "Key", (1000, 650): "Key", (1000, 630): "Net-to-8", (600, 800): "Net-to-8", (1000, 599): "Perimeter", (1000, 199): "Beyond 30"}
    df = spark.createDataFrame(list(points), "x int, y int")
    got = df.withColumn("z", spatial.zone(F.col("x"), F.col("y"), cal)).collect()
    assert {(r.x, r.y): r.z for r in got} == points


def test_snapshot_diff(spark):
    make = lambda xs: spark.createDataFrame([("q", float(a), float(b)) for a, b in xs], "q string, start_sec double, end_sec double")
    old, new = make([(0, 10), (12, 20), (50, 60)]), make([(0, 20), (80, 90)])
    assert rows(intervals.snapshot_diff(old, new, ["q"]), "change", "start_sec") == [("appeared", 80.0), ("disappeared", 50.0)]
    assert rows(intervals.merges(old, new, ["q"]), "start_sec", "n_old") == [(0.0, 2)]
    assert intervals.matched(make([(0, 10)]), make([(10, 12)]), ["q"]).count() == 1
    assert intervals.matched(make([(0, 10)]), make([(10, 12)]), ["q"], strict=True).count() == 0


def test_samples_against_indexes(spark):
    for n in (1, 4, 5, 6, 13, 50):
        df = spark.createDataFrame([("s", i) for i in range(n)], "s string, i int")
        assert [r[0] for r in rows(sampling.evenly(df, ["s"], ["i"], 5), "i")] == (list(range(n)) if n <= 5 else [i * n // 5 for i in range(5)])
        assert [r[0] for r in rows(sampling.every_kth(df, ["s"], ["i"], 3), "i")] == list(range(n))[:: max(1, n // 3)][:3]


def test_resample_against_nearest(spark):
    rng = random.Random(8)
    data, want = [], []
    for k in range(20):
        ts = sorted(rng.sample(range(60), rng.randrange(1, 12)))
        data += [(k, t, t * 10) for t in ts]
        want += [(k, g, min(ts, key=lambda t: (abs(t - g), -t)) * 10) for g in range(0, ts[-1] + 1, 3)]
    df = spark.createDataFrame(data, "k int, t int, v int")
    assert rows(sequence.resample_nearest(df, ["k"], "t", "v", 3), "k", "t", "v") == sorted(want)


def test_clock(spark):
    df = spark.createDataFrame([("14:30", 4.1)], "c string, s double")
    r = df.select(clock.elapsed(F.col("c")), clock.to_frame(F.col("s"), F.lit(0)), clock.frame_clock(F.lit(110000)), clock.remaining_clock(F.lit(60.25)), clock.seconds_or_clock(F.lit("x")), clock.seconds_or_clock(F.lit("2:05"))).first()
    assert tuple(r) == (30.0, 122, "01:01:06", "13:59.75", None, 125.0)


def test_files(spark, tmp_path):
    (tmp_path / "cam1.tracks.json").write_text('{"0": [{"l": 1, "t": 2, "r": 3, "b": 4, "cx": 2, "cy": 3, "team": "A", "zone": "Key", "track_id": 7}], "3": [], "6": [{"l": 1, "t": 2, "r": 3, "b": 4, "cx": 2, "cy": 3, "team": "Unknown", "zone": "Key", "track_id": null, "interpolated": true}]}')
    frames = tables.read_frames(spark, str(tmp_path / "*.json"))
    assert rows(frames, "label", "frame", "track_id", "interpolated") == [("cam1", 0, 7, False), ("cam1", 3, None, False), ("cam1", 6, None, True)]
    assert rows(tables.spine(frames), "frame") == [(0,), (3,), (6,)] and tables.detections(frames).count() == 2
    out = tmp_path / "again"
    tables.frames_json(frames).select("value").coalesce(1).write.text(str(out))
    assert '"3":[]' in "".join(p.read_text() for p in out.glob("part-*"))
    assert tables.read_rows(spark, str(tmp_path / "none.json"), tables.RESULT, optional=True).count() == 0
    store = spark.createDataFrame([("a", "1", "x"), ("b", "2", "y")], "id string, tagged_at string, v string")
    new = spark.createDataFrame([("a", "3", "z"), ("c", "1", "w")], "id string, tagged_at string, v string")
    assert rows(tables.upsert(store, new, "id", "tagged_at"), "id", "v") == [("a", "z"), ("b", "y"), ("c", "w")]


def test_config(spark, tmp_path):
    (tmp_path / "c.json").write_text(tables.scaffold_config("A", "B", ["c1", "c2"]).replace("[\n            0,\n            0\n          ]", "[0, 90]"))
    q = tables.quarters(tables.read_config(spark, str(tmp_path / "c.json")))
    assert q.count() == 8 and q.filter("camera = 'c2' and quarter = 4").count() == 1


def test_whole_detection_is_that_of_both_sides(spark, data):
    from fieldspan.operators import possessions
    from fieldspan.plans import adapters, analysis

    p = Params(strict_off=2, strict_def=2, strict_deep=1, loose_off=2, loose_def=2, grace_buckets=2, sustained_buckets=2, huddle_ratio=5.0)
    t, spine = adapters.tracks(spark, data), adapters.spine(spark, data)
    defends = spine.select("game", "camera", "quarter").distinct().withColumn("def_team", F.when(F.col("quarter") % 2 == 0, "A").otherwise("B"))
    got = rows(analysis.detect_all(t, spine, defends, adapters.CAL, ("A", "B"), p), "quarter", "team", "start_sec", "end_sec")
    want = []
    duration = spine.groupBy("game", "camera", "quarter").agg((F.count(F.lit(1)) * 0.5).alias("duration"))
    for odd, off, deff in ((1, "A", "B"), (0, "B", "A")):
        own = t.filter(F.col("quarter") % 2 == odd)
        near = own.filter(~spatial.beyond_cutoff(F.col("cy"), F.col("zone"), adapters.CAL))
        credit = possessions.offscreen_credit(own, off, deff, float(adapters.CAL.frame_height), p)
        s = possessions.bucket_signal(near, spine.filter(F.col("quarter") % 2 == odd), off, deff, credit, possessions.huddles(near, off, p))
        want += rows(possessions.detect(s, off, p, duration), "quarter", "team", "start_sec", "end_sec")
    assert got == sorted(want) and got


def test_more_files(spark, tmp_path):
    (tmp_path / "goalie_team_cam1.json").write_text('{"1": {"A": 0.4, "B": 0.1}, "2": null}')
    q = tables.read_quarter_map(spark, str(tmp_path / "goalie_team_cam1.json"), "map<string,double>")
    assert rows(q.select("label", "quarter", F.col("value")["A"].alias("a")), "label", "quarter", "a") == [("goalie_team_cam1", 1, 0.4), ("goalie_team_cam1", 2, None)]
    (tmp_path / "log.txt").write_text("15:00 0\r\n\n14:30 A x")
    assert rows(tables.read_lines(spark, str(tmp_path / "log.txt")), "label", "seq", "line") == [("log.txt", 0, "15:00 0"), ("log.txt", 1, ""), ("log.txt", 2, "14:30 A x")]
    t = spark.createDataFrame([("c", 3, 0, "A"), ("c", 0, 0, "B")], "label string, frame int, det_ix int, team string")
    tables.write_tracks(t, str(tmp_path / "tracks"))
    assert rows(spark.read.parquet(str(tmp_path / "tracks")), "label", "frame", "team") == [("c", 0, "B"), ("c", 3, "A")]
    assert tables.staged(t).count() == 2


def test_calibration_from_points():
    p = [[900, 1000], [1100, 1002], [800, 700], [1200, 700], [0, 600], [9, 610], [0, 200], [9, 200]]
    c = spatial.Calibration.from_points(p, 2000, 1200)
    assert (c.goal_y, c.yard8_y, c.yard30_y, c.key[2], c.frame_height) == (1001, 605, 200, (800.0, 700.0), 1200)
    top = min(y for _, y in spatial.key_polygon(spatial.Calibration(1000.0, 600.0, 200.0, ((900.0, 1000.0), (1100.0, 1000.0), (800.0, 700.0), (1200.0, 700.0)))))
    assert abs(top - 640) < 1e-6


def test_sheets_and_small_ones(spark, tmp_path):
    from fieldspan.operators import diagnostics, report

    r = spark.createDataFrame([("A", 1, 10.0, "Goal scored", "(1, 2, 4)", 1, 0), ("A", 2, 20.0, "Untagged", None, 0, 0), ("B", 1, 5.0, "Turnover", "(1, 2, 4)", 2, 1)], "team string, quarter int, duration_sec double, result string, formation string, cuts_in int, cuts_out int")
    paths = report.write_sheets(r, str(tmp_path))
    assert len(paths) == 6 and spark.read.option("header", True).csv(paths[0]).count() == 2
    assert rows(report.cuts_summary(r).filter("quarter is null"), "team", "n", "cuts_in") == [("A", 2, 1), ("B", 1, 2)]
    assert rows(report.formations_by_result(r), "team", "n") == [("A", 1), ("B", 1)]
    d = spark.range(50)
    one, two = ([r.id for r in sampling.shuffled(d, s, "id").collect()] for s in (1, 2))
    assert sorted(one) == sorted(two) == list(range(50)) and one != two and one == [r.id for r in sampling.shuffled(d.repartition(3), 1, "id").collect()]
    f = spark.createDataFrame([("c", i) for i in range(4)], "k string, f int")
    v = spark.createDataFrame([("c", 1, "x"), ("c", 3, "y")], "k string, f int, v string")
    assert rows(diagnostics.with_last_seen(f, v, ["k"], "f", "v").filter("f > 0"), "f", "v") == [(1, "x"), (2, "x"), (3, "y")]


def test_rounding_is_that_of_the_exact_value(spark):
    """A million doubles: ties, neighbours of ties, small and large ones, with both signs."""
    import numpy as np
    import pandas as pd

    rng = np.random.Generator(np.random.PCG64(1))
    ties = (rng.integers(-(10**7), 10**7, 250_000) + 0.5) / 10
    x = np.concatenate([ties, np.nextafter(ties, np.inf), rng.integers(-(10**6), 10**6, 200_000) / 8, rng.normal(0, 1, 100_000) * 10.0 ** rng.integers(-6, 14, 100_000), rng.integers(-(10**5), 10**5, 190_000) / 1000, [0.25, 0.35, 2.675, 2.5, 1e300, -1e300, 4503599627370495.5, 0.0, 5e-324]])
    df = spark.createDataFrame(pd.DataFrame({"i": np.arange(len(x)), "x": x}))
    got = df.select("i", *[clock.rounded(F.col("x"), n).alias(f"r{n}") for n in (0, 1, 2)]).toPandas().sort_values("i")
    for n in (0, 1, 2):
        assert (got[f"r{n}"].to_numpy() == np.array([round(v, n) for v in x.tolist()])).all()
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,)], "x double").select(clock.rounded(F.col("x")).alias("r")).collect()
    assert math.isnan(odd[0].r) and odd[1].r == math.inf and odd[2].r is None
