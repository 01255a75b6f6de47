"""Readers and writers: detection and track files, configuration, logs, results."""

from __future__ import annotations

import atexit
import contextlib
import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import intervals
from . import frames as frame_files

DETECTION = "l int, t int, r int, b int, cx int, cy int, team string, zone string, track_id int, interpolated boolean"
POSSESSION = "quarter int, team string, camera string, start_sec double, end_sec double, duration_sec double, end_reason string, boundary_source string"
RESULT = "possession_id string, quarter int, team string, camera string, start_sec double, end_sec double, corrected_end_sec double, result string, man_situation string, notes string, tagged_at string"
STOPPAGE, GOAL = "quarter int, elapsed_sec double, type string", "quarter int, elapsed_sec double, team string"
CONFIG = (
    "team_a string, team_b string, team_aliases map<string,string>, playbyplay_txt string, period_length_sec double, fps double, trusted_camera string, "
    "cameras array<struct<label:string,video:string,quarter_frames:map<string,array<int>>,team_colors:map<string,array<array<int>>>>>"
)
CALIBRATION = "points array<array<double>>, point_names array<string>, video_path string, frame_width int, frame_height int, calibration_frame int, timestamp string"


def label(path: Column) -> Column:
    """Name of a file without its folders, its type and .tracks or .detections."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.(?:tracks|detections))?\.json$", 1)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """label, frame, det_ix and the detection's fields; a frame without detections is one row of nulls.

    A file is one object, frame number to list of detections. Its byte ranges are read side by side; where only
    Spark's readers reach the files, each is parsed as a map and exploded."""
    split = frame_files.read_frames(spark, path)
    return whole_frames(spark, path) if split is None else split


def whole_frames(spark: SparkSession, path: str) -> DataFrame:
    """read_frames() with a file as one row."""
    kind = DETECTION.replace(" ", ":").replace(",:", ",")
    raw = spark.read.text(path, wholetext=True).select(label(F.col("_metadata.file_path")).alias("label"), F.from_json("value", f"map<string,array<struct<{kind}>>>").alias("m"))
    each = raw.select("label", F.explode("m").alias("frame", "d")).select("label", F.col("frame").cast("int").alias("frame"), F.posexplode_outer("d").alias("det_ix", "d"))
    return each.select("label", "frame", "det_ix", "d.*").withColumn("interpolated", F.coalesce("interpolated", F.lit(False)))


def read_frame_lines(spark: SparkSession, path: str) -> DataFrame:
    """As read_frames(), from files with a line for each frame: {"frame": 3, "detections": [...]}. Unlike
    files of one object these are split over tasks, and no row is larger than a frame."""
    kind = DETECTION.replace(" ", ":").replace(",:", ",")
    raw = spark.read.schema(f"frame int, detections array<struct<{kind}>>").json(path)
    each = raw.select(F.regexp_extract("_metadata.file_path", r"([^/]+?)(?:\.(?:tracks|detections))?\.jsonl$", 1).alias("label"), "frame", F.posexplode_outer("detections").alias("det_ix", "d"))
    return each.select("label", "frame", "det_ix", "d.*").withColumn("interpolated", F.coalesce("interpolated", F.lit(False)))


def write_frame_lines(frames: DataFrame, path: str) -> None:
    """Files of read_frame_lines() under path/label=.../, frames in order."""
    fields = [c for c in frames.columns if c not in ("label", "frame", "det_ix")]
    per = frames.groupBy("label", "frame").agg(F.sort_array(F.collect_list(F.when(F.col("det_ix").isNotNull(), F.struct("det_ix", *fields)))).alias("d"))
    rows = per.select("label", "frame", F.transform("d", lambda x: F.struct(*[x[c].alias(c) for c in fields])).alias("detections"))
    rows.repartitionByRange("label", "frame").sortWithinPartitions("label", "frame").write.partitionBy("label").json(path)


def detections(frames: DataFrame) -> DataFrame:
    return frames.filter("det_ix is not null")


def spine(frames: DataFrame) -> DataFrame:
    """Every frame, with detections or without."""
    return frames.select("label", "frame").distinct()


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_rows(spark: SparkSession, path: str, ddl: str, optional: bool = False) -> DataFrame:
    """A JSON array of rows; with optional, a file that isn't there is an empty table."""
    if optional and not exists(spark, path):
        return spark.createDataFrame([], ddl)
    return spark.read.schema(ddl).json(path, multiLine=True)


def read_config(spark: SparkSession, path: str) -> DataFrame:
    out = spark.read.schema(CONFIG).json(path, multiLine=True)
    return out.fillna({"fps": 30.0, "period_length_sec": 900.0})


def quarters(config: DataFrame) -> DataFrame:
    """camera, camera_ix, quarter, first_frame, last_frame."""
    cams = config.select(F.posexplode("cameras").alias("camera_ix", "c"))
    each = cams.select("camera_ix", F.col("c.label").alias("camera"), F.explode("c.quarter_frames").alias("q", "f"))
    return each.select("camera", "camera_ix", F.col("q").cast("int").alias("quarter"), F.get("f", F.lit(0)).alias("first_frame"), F.get("f", F.lit(1)).alias("last_frame"))


def frame_quarter(frames: DataFrame, spans: DataFrame, camera: str = "label", fps: float = 30.0, width: int | None = None) -> DataFrame:
    """frames with quarter and elapsed: of quarters that hold the frame, the first. With a width, frames
    and spans meet over bins of so many frames: for cameras with many quarters."""
    own = spans.select(F.col("camera").alias(camera), "quarter", "first_frame", "last_frame")
    if width:
        met = intervals.binned_join(frames, own, [camera], "frame", "first_frame", "last_frame", width)
    else:
        met = frames.join(own, camera).filter(F.col("frame").between(F.col("first_frame"), F.col("last_frame")))
    best = met.groupBy(*frames.columns).agg(F.min(F.struct("quarter", "first_frame")).alias("q"))
    return best.select(*frames.columns, "q.quarter", ((F.col("frame") - F.col("q.first_frame")) / fps).alias("elapsed"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """label, seq, line of text files, in order."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_path", r"([^/]+)$", 1).alias("label"), "value")
    return raw.select("label", F.posexplode(F.split("value", r"\r?\n")).alias("seq", "line"))


def read_quarter_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """label, quarter and the value of an object that maps quarters to values (null allowed)."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_path", r"([^/]+)\.json$", 1).alias("label"), F.from_json("value", f"map<string,{value}>").alias("m"))
    return raw.select("label", F.explode("m").alias("quarter", "value")).withColumn("quarter", F.col("quarter").cast("int"))


def write_tracks(tracks: DataFrame, path: str) -> None:
    """Parquet by label, frames in order within files; a new path, never the one that is read."""
    tracks.repartition("label").sortWithinPartitions("label", "frame", "det_ix").write.partitionBy("label").parquet(path)


def frames_json(tracks: DataFrame) -> DataFrame:
    """label, value: the object of read_frames() as text."""
    fields = [c for c in tracks.columns if c not in ("label", "frame", "det_ix")]
    per = tracks.groupBy("label", "frame").agg(F.sort_array(F.collect_list(F.when(F.col("det_ix").isNotNull(), F.struct("det_ix", *fields)))).alias("d"))
    plain = F.transform("d", lambda x: F.struct(*[x[c].alias(c) for c in fields]))
    return per.groupBy("label").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("frame").alias("k"), plain.alias("v")))))).alias("value"))


def upsert(store: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Of entries with the same key the last tagged one; of those as late, the new one."""
    both = store.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    best = both.groupBy(key).agg(F.max_by(F.struct(*store.columns), F.struct(order, "__new")).alias("v"))
    return best.select(*[F.col(f"v.{c}").alias(c) for c in store.columns])


def scaffold_config(team_a: str, team_b: str, cameras: list[str]) -> str:
    """A configuration to fill in, as JSON text."""
    return json.dumps({"team_a": team_a, "team_b": team_b, "team_aliases": {}, "period_length_sec": 900, "fps": 30.0, "cameras": [{"label": c, "video": f"{c}.mp4", "quarter_frames": {str(q): [0, 0] for q in range(1, 5)}} for c in cameras]}, indent=2)


def staged(df: DataFrame) -> DataFrame:
    """df, written as Parquet and read again: what is used several times is made once, and what is
    written outlives executors. The folder is the one that all machines share, spark.checkpoint.dir.
    Where the session names none, it is a temporary one on a single machine, and an error on a cluster."""
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = f"file://{tempfile.gettempdir()}"
    path = f"{shared.rstrip('/')}/fieldspan-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
