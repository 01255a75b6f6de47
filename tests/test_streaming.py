"""Streams give what batches give; a chain of steps keeps what it has."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldspan.plans.pipeline import Step, run
from fieldspan.streaming import live


def test_sessions_and_buckets(spark, tmp_path):
    rows = [(1, f"2024-01-01 00:00:{s:04.1f}", "a") for s in (0, 5, 14.5, 30)] + [(2, "2024-01-01 00:00:01.0", "a")]
    df = spark.createDataFrame(rows, "user_id int, ts string, event_type string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = live.grace_sessions(stream).writeStream.format("memory").queryName("sessions").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    batch = live.grace_sessions(df).collect()
    assert sorted(r.n for r in batch) == [1, 1, 3]
    # Rows of 00:00:30 and a watermark a minute before it: no session is closed yet.
    assert spark.table("sessions").count() == 0
    counts = live.bucket_counts(df).collect()
    assert sum(r.n for r in counts) == 5 and len(counts) == 5
    live.write_batches(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_closed_sessions_are_those_of_the_batch(spark, tmp_path):
    """A later event moves the watermark on: every session before it comes out, as the batch has it, once."""
    kind = "user_id int, ts string, event_type string"
    make = lambda rows: spark.createDataFrame(rows, kind).withColumn("ts", F.col("ts").cast("timestamp"))
    first = make([(1, f"2024-01-01 00:00:{s:04.1f}", "a") for s in (0, 5, 14.5, 30)] + [(2, "2024-01-01 00:00:01.0", "a")])
    first.coalesce(1).write.parquet(str(tmp_path / "in"))
    for minute in (20, 40):
        make([(3, f"2024-01-01 00:{minute}:00.0", "a")]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = live.grace_sessions(stream).writeStream.format("memory").queryName("closed").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    key = lambda r: (r.user_id, str(r.start), str(r.end), r.n)
    want = sorted(map(key, live.grace_sessions(first).collect()))
    assert sorted(key(r) for r in spark.table("closed").collect() if r.user_id != 3) == want and len(want) == 3
    q = live.bucket_counts(stream).writeStream.format("memory").queryName("closed_buckets").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sum(r.n for r in spark.table("closed_buckets").collect()) >= 5


def in_batches(spark, df, order, n, path):
    """A stream that delivers the rows of df in n batches, in the order of a column."""
    dealt = df.withColumn("k", F.ntile(n).over(Window.orderBy(order))).drop(order)
    schema = df.drop(order).schema
    for k in range(n):
        dealt.filter(F.col("k") == k + 1).drop("k").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def run_all(stream, name, spark):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    told = q.lastProgress
    q.stop()
    return spark.table(name).collect(), told


def test_tracker_waits_for_late_frames(spark, tmp_path):
    """Frames up to 4 s out of order give what the batch gives, those behind the watermark are left out, and
    once a camera is silent its state holds a number alone."""
    import random

    from fieldspan.operators import tracking

    rng = random.Random(4)
    rows = [(c, f * 3, i, rng.choice(["A", "B", "Unknown"]), rng.randrange(400), rng.randrange(400)) for c in "xy" for f in range(200) for i in range(rng.randrange(4))]
    df = spark.createDataFrame(rows, "camera string, frame int, det_ix int, team string, cx int, cy int")
    df = df.withColumn("ts", F.timestamp_seconds(F.lit(10**6) + F.col("frame") / 30.0))
    want = {(r.camera, r.frame, r.det_ix): r.track_id for r in tracking.track(df, ["camera"], ["A", "B"]).collect()}
    # The order of arrival: up to 120 frames late; then the clock of another camera moves on, twice; then a row of long ago.
    late = df.withColumn("o", F.col("frame") + F.pmod(F.xxhash64("frame"), F.lit(120)))
    ends = spark.createDataFrame([("z", 10**6, 0, "A", 1, 1, 10**7), ("z", 2 * 10**6, 0, "A", 1, 1, 2 * 10**7), ("x", 1, 9, "A", 1, 1, 3 * 10**7), ("z", 3 * 10**6, 0, "A", 1, 1, 3 * 10**7)], "camera string, frame int, det_ix int, team string, cx int, cy int, o long")
    ends = ends.withColumn("ts", F.timestamp_seconds(F.lit(10**6) + F.col("frame") / 30.0)).select(late.columns)
    late.write.parquet(str(tmp_path / "rows"))
    stream = in_batches(spark, spark.read.parquet(str(tmp_path / "rows")), "o", 8, str(tmp_path / "in"))
    for k in (0, 1, 2):
        ends.filter(F.col("o") == (k + 1) * 10**7).drop("o").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got, told = run_all(live.track_stream(stream, ["camera"], ["A", "B"], late="5 seconds"), "tracked", spark)
    assert {(r.camera, r.frame, r.det_ix): r.track_id for r in got if r.camera != "z"} == want and len(got) == len(want) + 2
    assert [r.track_id for r in sorted(got, key=lambda r: r.frame) if r.camera == "z"] == [1, 2]


def signals(seed, n=400):
    import random

    rng = random.Random(seed)
    rows, level = [], 3
    for k in ("g1", "g2"):
        for b in range(n):
            level = max(0, min(8, level + rng.choice([-1, 0, 0, 1]))) if rng.random() < 0.9 else rng.randrange(9)
            if rng.random() < 0.95:
                rows.append((k, "c", 1, b, level, max(0, min(8, level + rng.choice([-1, 0, 1]))), rng.randrange(level + 1), rng.random() < 0.05))
    return rows


SIGNAL = "game string, camera string, quarter int, bucket bigint, off bigint, def bigint, deep bigint, huddled boolean"


def test_hysteresis_is_the_batch(spark):
    from fieldspan.operators import possessions
    from fieldspan.params import Params

    for seed in range(6):
        p = Params(strict_off=4 + seed % 2, strict_def=4, strict_deep=2, loose_off=3, loose_def=3, grace_buckets=seed, sustained_buckets=2 + seed % 3)
        df = spark.createDataFrame(signals(seed), SIGNAL)
        q = df.select(*possessions.KEYS).distinct().withColumn("duration", F.lit(199.3))
        want = sorted(map(tuple, possessions.detect(df, "A", p, q).drop("team").collect()))
        assert sorted(map(tuple, live.possessions_of(df.join(q, possessions.KEYS), possessions.KEYS, p).collect())) == want and len(want) > 3


def test_possessions_come_out_of_the_stream(spark, tmp_path):
    from fieldspan.operators import possessions
    from fieldspan.params import Params

    p = Params(strict_off=4, strict_def=4, strict_deep=2, loose_off=3, loose_def=3, grace_buckets=3, sustained_buckets=3)
    df = spark.createDataFrame(signals(7), SIGNAL)
    want = sorted(map(tuple, possessions.detect(df, "A", p).drop("team").collect()))
    # Three frames a bucket, the largest counts in one of them; frames are up to 6 s out of order; a bucket-old row that is too late.
    frames = df.withColumn("j", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    top = F.pmod(F.xxhash64("bucket"), F.lit(3)) == F.col("j")
    frames = frames.select("game", "camera", "quarter", (F.col("bucket") * 0.5 + F.col("j") * 0.15).alias("t"), *[F.when(top, F.col(c)).otherwise(F.col(c) - F.least(F.col(c), F.lit(2))).alias(c) for c in ("off", "def", "deep")], (F.col("huddled") & top).alias("huddled"))
    frames = frames.withColumn("ts", F.timestamp_millis((F.lit(10**12) + F.round(F.col("t") * 1000)).cast("long")))
    frames = frames.withColumn("o", F.col("t") + F.pmod(F.xxhash64("t", "game"), F.lit(6)))
    frames.write.parquet(str(tmp_path / "rows"))
    stream = in_batches(spark, spark.read.parquet(str(tmp_path / "rows")), "o", 9, str(tmp_path / "in"))
    for k in (1, 2):
        end = frames.limit(1).withColumns({"game": F.lit("z"), "off": F.lit(0).cast("bigint"), "ts": F.timestamp_seconds(F.lit(10**9 + k * 10**5))}).drop("o")
        late = frames.filter("off >= 3").limit(5).drop("o")
        (end.unionByName(late) if k == 2 else end).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got, told = run_all(live.possessions_stream(stream, possessions.KEYS, late="8 seconds", p=p), "possessions", spark)
    assert sorted(map(tuple, got)) == want and len(want) > 3
    assert told["stateOperators"][0]["numRowsTotal"] <= 1


def test_steps_are_kept(spark, tmp_path):
    steps = [Step("a", lambda s, _: s.range(5)), Step("b", lambda s, i: i["a"].filter("id > 2"), ["a"]), Step("c", lambda s, i: i["b"], ["b"], always=True)]
    assert run(spark, steps, str(tmp_path)) == {"a": "ran", "b": "ran", "c": "ran"}
    assert run(spark, steps, str(tmp_path)) == {"a": "kept", "b": "kept", "c": "ran"}
    assert spark.read.parquet(str(tmp_path / "c")).count() == 2
    # A step that is made again makes those again that hang on it, and so do other parameters or files.
    (tmp_path / "a" / "_SUCCESS").unlink()
    assert run(spark, steps, str(tmp_path)) == {"a": "ran", "b": "ran", "c": "ran"}
    steps[1].params = 3
    assert run(spark, steps, str(tmp_path)) == {"a": "kept", "b": "ran", "c": "ran"}
    (tmp_path / "x.txt").write_text("1")
    steps[0].reads = [str(tmp_path / "*.txt")]
    assert run(spark, steps, str(tmp_path)) == {"a": "ran", "b": "ran", "c": "ran"}
    assert run(spark, steps, str(tmp_path)) == {"a": "kept", "b": "kept", "c": "ran"}
