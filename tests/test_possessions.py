"""Possessions of blocks that overlap, and what is made of them, against their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from fieldspan.plans.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def overlapping(spark, tmp_path_factory):
    """Events of one quarter in which two long blocks of a camera hold the same record."""
    d = tmp_path_factory.mktemp("overlapping")
    k = F.col("event_id")
    e = spark.range(246 * 180 * 14, 247 * 180 * 14).toDF("event_id")
    e.select("event_id", F.when(k * 7919 % 10007 % 5 == 0, "error").otherwise("view").alias("event_type"), (k * 31 % 97).cast("double").alias("value")).write.parquet(f"{d}/events.parquet")
    return str(d)


@pytest.mark.parametrize("name", ["possessions_whole", "formations_by_possession", "formations_by_side", "cuts_by_possession", "cuts_by_team"])
def test_a_record_in_two_blocks_is_one_possession(spark, overlapping, name):
    con = duckdb.connect()
    con.sql(f"create view events as select * from read_parquet('{overlapping}/events.parquet/*.parquet')")
    df = QUERIES[name](spark, overlapping)
    cols = sorted(df.columns)
    want = con.sql(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({SQL[name]})").fetchall()
    assert sorted(map(str, map(tuple, df.select(*cols).collect()))) == sorted(map(str, want))


def same_as_sql(spark, d, name):
    con = duckdb.connect()
    con.sql(f"create view events as select * from read_parquet('{d}/events.parquet/*.parquet')")
    df = QUERIES[name](spark, d)
    cols = sorted(df.columns)
    want = con.sql(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({SQL[name]})").fetchall()
    assert sorted(map(str, map(tuple, df.select(*cols).collect()))) == sorted(map(str, want))


@pytest.fixture(scope="module")
def placeless(spark, tmp_path_factory):
    """Events of two quarters, a fifth of them without a value: detections whose place isn't known."""
    d = tmp_path_factory.mktemp("placeless")
    k = F.col("event_id")
    e = spark.range(4 * 180 * 14, 6 * 180 * 14).toDF("event_id")
    e.select("event_id", F.when(k * 7919 % 10007 % 5 == 0, "error").otherwise("view").alias("event_type"), F.when(k * 31 % 101 % 5 != 0, (k * 31 % 97).cast("double")).alias("value")).write.parquet(f"{d}/events.parquet")
    return str(d)


@pytest.mark.parametrize("name", ["cuts_by_possession", "cuts_by_team"])
def test_no_gap_is_filled_from_or_to_an_unknown_place(spark, placeless, name):
    same_as_sql(spark, placeless, name)
