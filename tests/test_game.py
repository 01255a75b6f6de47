"""One game's folder, from detections to sheets; and the operators that the chain rests on against plain versions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from fieldspan.functions import spatial
from fieldspan.operators import align, diagnostics, formations, intervals, possessions, reconcile, sequence
from fieldspan.params import Params
from fieldspan.plans import analysis, game
from fieldspan.sources import tables


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


POINTS = [[900, 1000], [1100, 1000], [800, 700], [1200, 700], [0, 600], [2000, 600], [0, 200], [2000, 200]]
P = Params(stride=3)


def detection(team, cx, cy, zone):
    return {"l": cx - 20, "r": cx + 20, "t": cy - 40, "b": cy + 40, "cx": cx, "cy": cy, "team": team, "zone": zone}


def folder(tmp_path, fps=30, period=900):
    """Two cameras and a quarter of 60 s. On c1 team A attacks from second 10 to second 40: three on the
    perimeter (two from second 24 on, as one cuts in), four near the net, the goalie behind it."""
    files = {}
    for camera in ("c1", "c2"):
        frames = {}
        k30 = fps // 30
        for f in range(0, 1801, 3):  # in thirtieths of a second
            play = camera == "c1" and 300 <= f <= 1200
            y = lambda near: (near if play else 100)
            zone = lambda name: name if play else "Beyond 30"
            dets = []
            for k in range(7):
                inside = k < 4 or (k == 4 and f >= 720)
                dets.append(detection("A", 150 + 250 * k, y(620 if inside else 550), zone("Net-to-8" if inside else "Perimeter")))
            dets += [detection("B", 200 + 280 * k, y(620), zone("Net-to-8")) for k in range(6)]
            dets.append(detection("Goalie", 1000, y(1050), zone("Behind Net")))
            frames[k30 * f] = dets[1:] if f % 60 == 30 else dets  # once in two seconds a player is missed
        frames[k30 * 1797] = []
        files[f"{camera}.detections.json"] = json.dumps(frames)
        files[f"{camera}.calibration.json"] = json.dumps({"points": POINTS, "point_names": [], "video_path": "", "frame_width": 3840, "frame_height": 1200, "calibration_frame": 0, "timestamp": ""})
    files["goalie_team_c1.json"] = json.dumps({"1": {"dominant": "B", "gap": 0.4}})
    files["goalie_team_c2.json"] = json.dumps({"1": {"dominant": "A", "gap": 0.3}})
    cameras = [{"label": c, "video": f"{c}.mp4", "quarter_frames": {"1": [0, 60 * fps]}} for c in ("c1", "c2")]
    files["game_config.json"] = json.dumps({"team_a": "A", "team_b": "B", "team_aliases": {"AA": "A"}, "playbyplay_txt": "log.txt", "period_length_sec": period, "fps": float(fps), "cameras": cameras})
    clock = lambda second: "%02d:%02d" % divmod(period - period * second // 60, 60)
    files["log.txt"] = f"{clock(10)} AA Draw control by AA P1\n{clock(40)} AA GOAL by AA P1\n{clock(44)} B Draw control by B P2\n00:00 0 End-of-period\n"
    for name, text in files.items():
        (tmp_path / name).write_text(text)


def test_chain(spark, tmp_path):
    (tmp_path / "in").mkdir()
    folder(tmp_path / "in")
    told = game.run(spark, str(tmp_path / "in"), "g", str(tmp_path / "out"), P)
    assert set(told.values()) == {"ran"}
    table = lambda name: spark.read.parquet(str(tmp_path / "out" / name))
    assert rows(table("defenders"), "camera", "quarter", "def_team") == [("c1", 1, "B"), ("c2", 1, "A")]
    filled = table("filled")
    # The player who is missed 30 times on each camera, and all 14 of each in the frame without anyone.
    assert filled.filter("interpolated").count() == 60 + 28
    # 150 and 600 of 900 s on the game's clock are 10 and 40 of the quarter's 60 s.
    assert rows(table("official"), "team", "start_sec", "end_sec", "end_reason") == [("A", 10.0, 40.0, "goal"), ("B", 44.0, 60.0, "period_end")]
    final = rows(table("final"), "camera", "team", "start_sec", "end_sec", "duration_sec", "end_reason", "boundary_source")
    assert final == [("c1", "A", 10.0, 44.5, 34.5, "goal", "video_detected")]
    shape = table("formations").first()
    assert (shape.n_frames, tuple(shape.off_formation), tuple(shape.def_formation)) == (346, (0, 5, 2), (1, 6, 0))
    seen = [f for f in range(300, 1201, 3) if f % 60 != 30]
    assert shape.off_distribution == {"(0, 4, 3)": sum(f < 720 for f in seen), "(0, 5, 2)": sum(f >= 720 for f in seen)} and shape.off_n_qualifying == len(seen)
    assert shape.def_n_qualifying == 301
    cut = table("cuts").first()
    assert (cut.n_cuts_in, cut.n_cuts_out, cut.suspect_zero_cuts) == (1, 0, False) and cut.cuts[0].frame == 720
    assert rows(formations.cuts_by_team(table("cuts")), "team", "cuts_in", "cuts_out", "possessions_with_cuts", "n_possessions") == [("A", 1, 0, 1, 1)]
    assert rows(formations.frequency_by_side(table("formations")), "side", "team", "n") == [("def", "B", 1), ("off", "A", 1)]
    log = spark.read.option("header", True).csv(str(tmp_path / "out" / "sheets" / "possession_log")).first().asDict()
    assert log == {"Quarter": "1", "Team": "A", "Camera": "c1", "Start (s)": "10.0", "End (s)": "44.5", "Duration (s)": "34.5", "Result": "Untagged", "Man Situation": None, "Notes": None, "Offense Formation": "(0, 5, 2)", "Defense Formation": "(1, 6, 0)", "Cuts In": "1", "Cuts Out": "0"}

    # A tag corrects the end; what follows is made anew, what comes before is kept.
    (tmp_path / "in" / "possession_results.json").write_text(json.dumps([{"possession_id": "Q1_A_10.0_44.5", "quarter": 1, "team": "A", "start_sec": 10.0, "corrected_end_sec": 40.0, "result": "Goal", "tagged_at": "1"}]))
    told = game.run(spark, str(tmp_path / "in"), "g", str(tmp_path / "out"), P)
    assert told["detected"] == told["tracked"] == "kept" and told["final"] == told["report"] == "ran"
    row = table("report").first()
    assert (row.end_sec, row.duration_sec, row.result, row.cuts_in) == (40.0, 30.0, "Goal", 1) and table("formations").first().n_frames == 301
    sheet = spark.read.option("header", True).csv(str(tmp_path / "out" / "sheets" / "formations_by_result")).first()
    assert tuple(sheet) == ("A", "Goal", "(0, 5, 2)", "1", "100.0")
    assert (tmp_path / "out" / "game_report.xlsx").exists()
    assert rows(spark.read.parquet(str(tmp_path / "out" / "checks" / "matched")), "team", "n_official", "n_matched") == [("A", 1, 1), ("B", 1, 0)]

    # B's record has no interval, and c2, where B attacks, shows nobody in play. Probed every five seconds from 34 s on, c1
    # has all until second 40.
    assert rows(table("unmatched"), "team", "start_sec", "end_sec", "camera", "peak_off", "peak_def", "peak_deep") == [("B", 44.0, 60.0, "c2", 0, 0, 0)]
    assert rows(diagnostics.peaks_by_team(table("unmatched")), "team", "n_unmatched", "avg_peak_off", "avg_peak_def") == [("B", 1, 0.0, 0.0)]
    probes = rows(table("missing_signal"), "camera", "assigned", "at", "within", "n_own", "n_other", "n_goalie", "n_deep")
    assert probes == [(c, c == "c2", 34.0 + 5 * k, 44 <= 34 + 5 * k <= 60, *((6, 7, 1, 6) if c == "c1" and k < 2 else (0, 0, 0, 0))) for c in ("c1", "c2") for k in range(8)]
    assert rows(table("fragments"), "team", "gap_before", "gap_after", "near") == [("A", None, None, False)]

    # With nothing changed all is kept; a step whose table is gone is made again, and what hangs on it; another log
    # remakes what hangs on the log.
    assert set(game.run(spark, str(tmp_path / "in"), "g", str(tmp_path / "out"), P).values()) == {"kept"}
    (tmp_path / "in" / "log.txt").write_text((tmp_path / "in" / "log.txt").read_text() + "\n")
    told = game.run(spark, str(tmp_path / "in"), "g", str(tmp_path / "out"), P)
    assert {k for k, v in told.items() if v == "kept"} == {"frames", "tracked", "filled", "zoned", "defenders"}


def test_chain_at_another_frame_rate(spark, tmp_path):
    """The same minute at 60 frames a second, and periods of 720 s: both come from the configuration."""
    (tmp_path / "in").mkdir()
    folder(tmp_path / "in", fps=60, period=720)
    game.run(spark, str(tmp_path / "in"), "g", str(tmp_path / "out"), Params(stride=6, max_interp_gap=60))
    table = lambda name: spark.read.parquet(str(tmp_path / "out" / name))
    assert rows(table("official"), "team", "start_sec", "end_sec", "end_reason") == [("A", 10.0, 40.0, "goal"), ("B", 44.0, 60.0, "period_end")]
    assert rows(table("final"), "camera", "team", "start_sec", "end_sec", "end_reason") == [("c1", "A", 10.0, 44.5, "goal")]
    assert table("formations").first().n_frames == 346 and table("cuts").first().cuts[0].frame == 1440


def test_quarter_ends_with_its_last_frame(spark):
    """Play in all of 900 s (1,801 buckets, the last one of a single frame) ends at 900, not at 900.5."""
    q = spark.createDataFrame([("g", "c", 1, 100, 27100)], "game string, camera string, quarter int, first_frame int, last_frame int")
    spine = possessions.bucket_spine(q)
    assert spine.count() == 1801 and spine.agg(F.max("bucket")).first()[0] == 1800
    signal = spine.filter("bucket >= 1750").withColumns({"off": F.lit(7), "def": F.lit(7), "deep": F.lit(4), "huddled": F.lit(False)})
    assert rows(possessions.detect(signal, "A", duration=possessions.durations(q)), "start_sec", "end_sec") == [(875.0, 900.0)]
    f = spark.createDataFrame([("g", "c", x) for x in (99, 100, 114, 115, 27100, 27101)], "game string, camera string, frame int")
    assert rows(possessions.in_buckets(f, q), "frame", "bucket") == [(100, 0), (114, 0), (115, 1), (27100, 1800)]


def intervals_of(spark, xs):
    return spark.createDataFrame([(k % 3, float(a), float(b), i) for i, (k, a, b) in enumerate(xs)], "k int, start_sec double, end_sec double, i int")


@pytest.mark.parametrize("seed", [1, 2])
def test_interval_joins_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    make = lambda n: [(rng.randrange(9), s, s + rng.randrange(6)) for s in (rng.randrange(60) for _ in range(n))]
    a, b = make(60), make(40)
    da, db = intervals_of(spark, a), intervals_of(spark, b)
    for within in (0, 2):
        hit = {i for i, (k, s, e) in enumerate(a) if any(k % 3 == m % 3 and e >= u - within and v >= s - within for m, u, v in b)}
        assert {r.i for r in intervals.matched(da, db, ["k"], within).collect()} == hit
        assert sorted(r.i for r in intervals.matched(da, db, ["k"], within, how="left_anti").collect()) == sorted(set(range(60)) - hit)
    hit = {i for i, (k, s, e) in enumerate(a) if any(k % 3 == m % 3 and min(e, v) - max(s, u) > 0 for m, u, v in b)}
    assert {r.i for r in intervals.matched(da, db, ["k"], strict=True).collect()} == hit
    pairs = sorted((i, float(u), float(v)) for i, (k, s, e) in enumerate(a) for m, u, v in b if k % 3 == m % 3 and e >= u and v >= s)
    for width in (1.0, 7.0, 1000.0):
        assert rows(intervals.overlaps(da, db, ["k"], width), "i", "other_start", "other_end") == sorted(pairs, key=str)
    official = db.withColumns({"seq": F.col("i"), "end_reason": F.concat(F.lit("r"), "i")})
    near = [(i, min(((abs(e - v), j) for j, (m, _, v) in enumerate(b) if m % 3 == k % 3), default=(0, None))[1]) for i, (k, s, e) in enumerate(a)]
    assert rows(intervals.nearest_reason(da, official, ["k"]), "i", "end_reason") == sorted(((i, None if j is None else f"r{j}") for i, j in near), key=str)


def test_interval_joins_with_nulls(spark):
    a = spark.createDataFrame([(None, 0.0, 1.0, 0), (1, None, 1.0, 1), (1, 0.0, 1.0, 2), (1, 0.0, 1.0, 2)], "k int, start_sec double, end_sec double, i int")
    b = spark.createDataFrame([(None, 0.0, 1.0), (1, None, 1.0), (1, 1.0, 2.0)], "k int, start_sec double, end_sec double")
    assert rows(intervals.matched(a, b, ["k"]), "i") == [(2,), (2,)] and rows(intervals.matched(a, b, ["k"], how="left_anti"), "i") == [(0,), (1,)]
    assert intervals.matched(a, b.limit(0), ["k"]).count() == 0 and intervals.matched(a, b.limit(0), ["k"], how="left_anti").count() == 4
    named = b.withColumns({"seq": F.lit(1), "end_reason": F.lit("x")})
    assert rows(intervals.nearest_reason(a, named, ["k"]), "i", "end_reason") == [(0, None), (1, "x"), (2, "x"), (2, "x")]


def test_pairs_by_position(spark):
    make = lambda xs: spark.createDataFrame([(q, float(s), float(e)) for q, s, e in xs], "q int, start_sec double, end_sec double")
    raw, aligned = make([(1, 0, 10), (1, 20, 30), (2, 0, 10), (3, 5, 6)]), make([(1, 0, 20), (2, 0, 250), (4, 1, 2)])
    assert rows(intervals.by_rank(raw, aligned, ["q"]), "q", "rank") == [(1, 1), (2, 1)]
    pairs = intervals.by_position(raw, aligned, ["q"])
    assert rows(intervals.stretch(pairs, 30.0, 200.0), "q", "ratio", "flagged") == [(2, 25.0, True)] and rows(intervals.stretch(pairs, 30.0), "flagged") == [(False,)]
    assert rows(intervals.count_mismatches(raw, aligned, ["q"]), "q", "n_raw", "n_aligned") == [(1, 2, 1), (3, 1, 0)]


def test_split_keeps_the_camera(spark):
    found = spark.createDataFrame([("g", "c2", 1, "A", "B", 0.0, 200.0), ("g", "c1", 1, "A", "B", 300.0, 310.0)], "game string, camera string, quarter int, team string, other string, start_sec double, end_sec double")
    official = spark.createDataFrame([("g", 1, 1, "B", 50.0, 70.0, "goal"), ("g", 1, 2, "A", 70.0, 199.0, "turnover")], "game string, quarter int, seq int, team string, start_sec double, end_sec double, end_reason string")
    got = rows(analysis.with_records(found, official), "camera", "team", "start_sec", "end_sec", "end_reason", "long")
    assert got == [("c1", "A", 300.0, 310.0, "turnover", False), ("c2", "A", 0.0, 50.0, "turnover", False), ("c2", "A", 70.0, 200.0, "turnover", False), ("c2", "B", 50.0, 70.0, "goal", False)]


def test_cuts_look_over_other_zones(spark):
    z = {"P": "Perimeter", "N": "Net-to-8", "B": "Behind Net"}
    df = spark.createDataFrame([(1, 3 * i, z[c]) for i, c in enumerate("PPPBBBNNNBBBBPPBP")], "track_id int, frame int, zone string")
    assert rows(formations.cut_events(df, ["track_id"], 3), "frame", "direction") == [(18, "in"), (39, "out")]


def test_windows_and_timeline(spark):
    """Two cameras out of step; one huddle, seen by the second only; the end of a window is where the next sample begins."""
    q = spark.createDataFrame([("g", c, 1, k, 300) for k, c in enumerate(("c0", "c1"))], "game string, camera string, quarter int, first_frame int, last_frame int").withColumn("camera_ix", F.col("first_frame"))
    frames = spark.createDataFrame([("g", c, 0 if c == "c0" else 1) for c in ("c0", "c1")], "game string, camera string, at int").select("game", "camera", F.explode(F.sequence("at", F.lit(300), F.lit(3))).alias("frame"))
    near = frames.filter("frame < 150").withColumn("det_ix", F.explode(F.sequence(F.lit(0), F.lit(3))))
    close = (F.col("camera") == "c1") & F.col("frame").between(60, 120)
    tracks = near.withColumns({"cx": F.col("det_ix") * F.when(close, 30).otherwise(400), "cy": F.lit(1100), "team": F.lit("A"), "zone": F.lit("Behind Net")})
    tracks = tracks.withColumns({"l": F.col("cx") - 20, "r": F.col("cx") + 20})
    got = align.timeline(align.near_net(tracks, frames), q)
    seen = rows(got.filter("bucket < 20"), "bucket", "near", "huddled")
    assert [(b, n) for b, n, _ in sorted(seen)] == [(b, 4 if 15 * b < 150 else 0) for b in range(20)]
    assert [b for b, _, h in sorted(seen) if h] == [4, 5, 6, 7]
    w = rows(align.windows(got, ["game", "quarter"], "bucket"), "kind", "start_sec", "end_sec")
    assert w[0] == ("huddle", 4, 8) and w[1][:2] == ("quiet", 10)


def test_small_ones(spark, tmp_path):
    s = spark.createDataFrame([("k", 0, 1), ("k", 0, 5), ("k", 0, 3), ("k", 7, 2)], "k string, t int, v int")
    assert rows(sequence.resample_nearest(s, ["k"], "t", "v", 5), "t", "v") == [(0, 5), (5, 2)]
    r = spark.createDataFrame([("g", c, q, t, 0.5) for c, q, t in (("a", 1, "A"), ("b", 1, "B"), ("a", 3, "A"), ("b", 3, "B"), ("a", 5, "B"), ("b", 5, "A"))], "game string, camera string, quarter int, dominant string, gap double")
    assert rows(reconcile.alternate(r, ["game"], "A", "B", "a", "b"), "quarter", "camera", "team") == [(1, "a", "A"), (1, "b", "B"), (3, "a", "A"), (3, "b", "B")]
    v = spark.createDataFrame([("k", 1, None), ("k", 2, 2.0), ("k", 3, None), ("k", 4, 4.0), ("k", 5, None), ("m", 1, None)], "k string, i int, v double")
    assert rows(v.select("k", "i", sequence.next_known(F.col("v"), ["k"], "i").alias("f")), "k", "i", "f") == [("k", 1, 2.0), ("k", 2, 2.0), ("k", 3, 4.0), ("k", 4, 4.0), ("k", 5, 4.0), ("m", 1, 0.0)]
    (tmp_path / "cam1.detections.json").write_text('{"0": [{"l": 1, "t": 2, "r": 3, "b": 4, "cx": 2, "cy": 3, "team": "A", "zone": "Key", "track_id": 7}], "3": [], "6": [{"l": 1, "t": 2, "r": 3, "b": 4, "cx": 2, "cy": 3, "team": "B", "zone": "Key"}]}')
    one = tables.read_frames(spark, str(tmp_path / "cam1.detections.json"))
    tables.write_frame_lines(one, str(tmp_path / "lines"))
    text = "\n".join(p.read_text().strip() for p in sorted((tmp_path / "lines" / "label=cam1").glob("part-*")))
    (tmp_path / "cam1.detections.jsonl").write_text(text)
    assert rows(tables.read_frame_lines(spark, str(tmp_path / "cam1.detections.jsonl")), *one.columns) == rows(one, *one.columns) and one.count() == 3


def test_polygon_box_changes_nothing(spark):
    cal = spatial.Calibration(1000.0, 600.0, 200.0, ((900.0, 1000.0), (1100.0, 1000.0), (800.0, 700.0), (1200.0, 700.0)))
    polygon = spatial.key_polygon(cal)

    def plain(x, y):
        odd = False
        for (ax, ay), (bx, by) in zip(polygon, [*polygon[1:], polygon[0]], strict=True):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                odd = not odd
        return odd

    points = [(x + 0.3, y + 0.4) for x in range(750, 1260, 17) for y in range(600, 1020, 13)]
    df = spark.createDataFrame(points, "x double, y double")
    got = {(r.x, r.y): r.z for r in df.withColumn("z", spatial.inside(F.col("x"), F.col("y"), polygon)).collect()}
    assert got == {p: plain(*p) for p in points}
