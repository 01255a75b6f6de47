"""Runs a chain of named steps; a step whose table is complete, and made of what is there now, is not run again."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..sources.frames import files_of
from ..sources.tables import exists


@dataclass
class Step:
    """name; make(spark, inputs by name) -> table; inputs; always: run even if its table is there; reads: paths or
    patterns of the files that make reads; params: whatever else its result hangs on."""

    name: str
    make: Callable[[SparkSession, dict[str, DataFrame]], DataFrame]
    inputs: list[str] = field(default_factory=list)
    always: bool = False
    reads: list[str] = field(default_factory=list)
    params: object = None


def fingerprint(spark: SparkSession, step: Step, upstream: dict[str, str]) -> str:
    """What a step's table is made of: its files (names, lengths, times), its parameters, and its inputs' fingerprints."""
    files = sorted(f for path in step.reads for f in files_of(spark, path, times=True))
    told = json.dumps([step.name, repr(step.params), files, [upstream[k] for k in step.inputs]])
    return hashlib.sha256(told.encode()).hexdigest()


def run(spark: SparkSession, steps: list[Step], folder: str, force: bool = False) -> dict[str, str]:
    """name -> "ran" or "kept". Tables are written as Parquet under folder; the mark of success that
    Spark writes last tells a complete one. A step is run again if its fingerprint isn't the one that was kept with its
    table, or if an input of it ran just now. The first step that fails ends the chain."""
    done: dict[str, DataFrame] = {}
    told, prints = {}, {}
    for s in steps:
        path = f"{folder}/{s.name}"
        prints[s.name] = fingerprint(spark, s, prints)
        known = spark.read.schema("fingerprint string").json(f"{path}.fingerprint").first() if exists(spark, f"{path}.fingerprint") else None
        same = known is not None and known["fingerprint"] == prints[s.name]
        if force or s.always or not same or not exists(spark, f"{path}/_SUCCESS") or any(told[k] == "ran" for k in s.inputs):
            s.make(spark, {k: done[k] for k in s.inputs}).write.mode("overwrite").parquet(path)
            told[s.name] = "ran"
            if not exists(spark, f"{path}/_SUCCESS"):
                raise RuntimeError(f"step {s.name} left no complete table")
            spark.createDataFrame([(prints[s.name],)], "fingerprint string").coalesce(1).write.mode("overwrite").json(f"{path}.fingerprint")
        else:
            told[s.name] = "kept"
        done[s.name] = spark.read.parquet(path)
    return told
