"""The splittable source of frame files: ranges of any size give what the whole file gives."""

import io
import json
import random

import pytest

from fieldspan.sources import frames, tables


def detection(rng):
    return {"l": rng.randrange(9), "t": 2, "r": 3, "b": 4, "cx": rng.randrange(999), "cy": 3, "team": rng.choice(["A", 'B"]', "Ü [x]", '\\"12\\": ['[1:], None]), "zone": "Key", "hsv": [1, 2, [3]], "track_id": rng.choice([None, 7])}


def texts(seed):
    rng = random.Random(seed)
    made = {str(3 * f): [detection(rng) for _ in range(rng.randrange(5))] for f in range(150)}
    return [json.dumps(made, **kw) for kw in ({}, {"indent": 1}, {"separators": (",", ":")}, {"ensure_ascii": False})]


@pytest.mark.parametrize("block", [1, 7, 300, 1 << 20])
def test_ranges_share_out_the_frames(block):
    for text in [*texts(1), "{}", "", '{"0": []}', ' {"0" : [ ] ,\n "-3":[{"cx": 1}]}']:
        data = text.encode()
        want = [(int(k), v) for k, v in json.loads(text or "{}").items()]
        for size in (1, 50, 997, 1 << 20) if len(data) < 1000 else (997, 5000, 1 << 20):
            got = []
            for start in range(0, len(data), size):
                for frame, held, where in frames.frame_texts(io.BytesIO(data), start, min(len(data), start + size), block):
                    got.append((frame, json.JSONDecoder().raw_decode(frames._list_text(held, where))[0]))
            assert got == want


def test_source_gives_what_whole_files_give(spark, tmp_path):
    for k, text in enumerate(texts(2)):
        (tmp_path / f"cam{k}.detections.json").write_text(text)
    (tmp_path / "none.tracks.json").write_text("{}")
    key = lambda df: sorted(map(str, map(tuple, df.collect())))
    want = key(tables.whole_frames(spark, str(tmp_path / "*.json")))
    for size in (4000, 1 << 25):
        got = frames.read_frames(spark, str(tmp_path / "*.json"), size)
        assert key(got) == want and got.rdd.getNumPartitions() == (5 if size > 4000 else sum(-(-p.stat().st_size // 4000) for p in tmp_path.iterdir()))
    assert key(tables.read_frames(spark, str(tmp_path / "*.json"))) == want
    some = frames.read_frames(spark, str(tmp_path / "*.json"), 4000).filter("frame >= 300 and frame < 330 and team = 'A'")
    assert "frame" in some._jdf.queryExecution().toString() and key(some) == key(tables.whole_frames(spark, str(tmp_path / "*.json")).filter("frame >= 300 and frame < 330 and team = 'A'"))
    reader = frames.FrameReader([], 1)
    kept = list(reader.pushFilters([frames.GreaterThanOrEqual(("frame",), 9), frames.EqualTo(("team",), "A"), frames.In(("frame",), (9, 12))]))
    assert [f.attribute for f in kept] == [("team",)] and [f for f in range(20) if reader.wanted(f)] == [9, 12]


def test_a_large_file_is_dealt_out(spark, tmp_path):
    """30 MB in 30 ranges: no task reads more than its own and no row is above a frame."""
    rng = random.Random(3)
    with open(tmp_path / "cam.detections.json", "w") as f:
        f.write("{")
        for k in range(20_000):
            f.write(("" if k == 0 else ", ") + f'"{3 * k}": ' + json.dumps([{"l": 1, "t": 2, "r": 3, "b": 4, "cx": rng.randrange(3000), "cy": k, "team": "A", "zone": "Perimeter", "frame_note": "x" * 20} for _ in range(12)]))
        f.write("}")
    df = frames.read_frames(spark, str(tmp_path / "cam.detections.json"), 1 << 20)
    size = (tmp_path / "cam.detections.json").stat().st_size
    assert df.rdd.getNumPartitions() == -(-size // (1 << 20)) > 25
    assert tuple(df.selectExpr("count(*)", "count(distinct frame)", "sum(cy)", "max(det_ix)").first()) == (240_000, 20_000, 12 * sum(range(20_000)), 11)
