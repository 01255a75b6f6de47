"""A splittable source for files of one JSON object, frame number to list of detections.

A file is dealt out by byte ranges. A task looks for the first frame key (digits in quotes, a colon, a
bracket) in its range, parses the lists of the frames whose keys lie in it, one after the other, and goes on
past its end only to finish the last one: no task holds more than a block of the file and one frame. Filters on
frame are applied before a list is parsed.

That asks for one thing of the files: fields of a detection aren't named by digits and lists at once.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

BLOCK = 4 << 20
RANGE = 32 << 20
ROWS = 5000
FRAME_KEY = re.compile(rb'(?<!\\)"(-?\d+)"\s*:\s*\[')
#: Bytes that a key may take up: one that a block ends in is found again with the next.
KEY_BYTES = 256
INTS = ("l", "t", "r", "b", "cx", "cy")
SCHEMA = "label string, frame int, det_ix int, l int, t int, r int, b int, cx int, cy int, team string, zone string, track_id int, interpolated boolean"
ARROW = pa.schema(
    [("label", pa.string()), ("frame", pa.int32()), ("det_ix", pa.int32()), *((c, pa.int32()) for c in INTS), ("team", pa.string()), ("zone", pa.string()), ("track_id", pa.int32()), ("interpolated", pa.bool_())]
)
#: File systems that a Python worker opens by itself.
OPENED = ("file", "hdfs", "s3", "gs")


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int) -> None:
        self.path, self.start, self.end = path, start, end


def frame_texts(file, start: int, end: int, block: int = BLOCK) -> Iterator[tuple[int, bytes, int]]:
    """Frame number, a buffer, and where in it the frame's list begins, for the frames whose keys begin in
    [start, end) of a file."""
    file.seek(start)
    held, at = b"", start  # what was read and not yet handed on, and where it begins
    key = None
    while True:
        more = file.read(block)
        held += more
        here = 0
        while True:
            found = FRAME_KEY.search(held, key.end() if key else here)
            # A key at the very end may go on in the next block.
            if found is None or more and found.end() > len(held) - 1:
                break
            if key:
                yield int(key[1]), held, key.end() - 1
            key = None
            if at + found.start() >= end:
                return
            key, here = found, found.start()
        if not more:
            if key:
                yield int(key[1]), held, key.end() - 1
            return
        keep = key.start() if key else max(0, len(held) - KEY_BYTES)
        if not key and at + keep >= end:
            return
        held, at = held[keep:], at + keep
        key = FRAME_KEY.match(held) if key else None


def _whole(x) -> int | None:
    return int(x) if isinstance(x, (int, float)) and not isinstance(x, bool) and x == int(x) else None


def _text(x) -> str | None:
    return x if x is None or isinstance(x, str) else json.dumps(x)


def label_of(path: str) -> str:
    """A file's name without its folders, its type and .tracks or .detections."""
    name = path.rsplit("/", 1)[-1]
    return re.sub(r"(\.(tracks|detections))?\.json$", "", name)


def open_file(path: str):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


class FrameReader(DataSourceReader):
    def __init__(self, files: list[tuple[str, int]], size: int) -> None:
        self.files, self.size, self.bounds = files, size, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        kinds = {EqualTo: "==", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", In: "in"}
        for f in filters:
            if type(f) in kinds and f.attribute == ("frame",) and f.value is not None:
                self.bounds.append((kinds[type(f)], f.value))
            else:
                yield f

    def wanted(self, frame: int) -> bool:
        tests = {"==": lambda v: frame == v, ">": lambda v: frame > v, ">=": lambda v: frame >= v, "<": lambda v: frame < v, "<=": lambda v: frame <= v, "in": lambda v: frame in v}
        return all(tests[op](v) for op, v in self.bounds)

    def partitions(self) -> list[InputPartition]:
        return [Range(path, s, min(s + self.size, length)) for path, length in self.files for s in range(0, length, self.size)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        label, decode = label_of(partition.path), json.JSONDecoder().raw_decode
        rows: list[tuple] = []
        with open_file(partition.path) as file:
            for frame, held, where in frame_texts(file, partition.start, partition.end):
                if not self.wanted(frame):
                    continue
                detections = decode(_list_text(held, where))[0]
                if not detections:
                    rows.append((label, frame, None, *[None] * 9, False))
                for k, d in enumerate(detections):
                    d = d if isinstance(d, dict) else {}
                    rows.append((label, frame, k, *(_whole(d.get(c)) for c in INTS), _text(d.get("team")), _text(d.get("zone")), _whole(d.get("track_id")), d.get("interpolated") is True))
                if len(rows) >= ROWS:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)


def _list_text(held: bytes, where: int) -> str:
    """The text from a list's bracket up to the next frame's key, or to the end."""
    following = FRAME_KEY.search(held, where)
    return held[where : following.start() if following else len(held)].decode()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


class FrameSource(DataSource):
    """Option files: a JSON list of paths and lengths; option range: bytes for each task."""

    @classmethod
    def name(cls) -> str:
        return "frame_objects"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FrameReader:
        return FrameReader([tuple(x) for x in json.loads(self.options["files"])], int(self.options.get("range", RANGE)))


def files_of(spark: SparkSession, path: str, times: bool = False) -> list[tuple]:
    """Full paths and lengths (and times, in milliseconds) of the files that a path or pattern names, as Spark's
    file systems list them."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return [(f.getPath().toUri().toString(), f.getLen(), *([f.getModificationTime()] if times else [])) for f in (found or []) if f.isFile()]


def read_frames(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame | None:
    """label, frame, det_ix and the detection's fields; a frame without detections is one row of nulls. None
    where the files lie in a store that Python workers don't open."""
    files = files_of(spark, path)
    if any(f.split(":", 1)[0] not in OPENED for f, _ in files):
        return None
    spark.dataSource.register(FrameSource)
    files = [(f.replace("file:/", "file:///", 1) if re.match(r"file:/[^/]", f) else f, n) for f, n in files]
    if spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") != "true":
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("frame_objects").options(files=json.dumps(files), range=str(range_bytes)).load()
