"""Joins of points with spans that overlap among themselves."""

from pyspark.sql import functions as F

from fieldspan.operators import intervals, pbp


def test_tiles_lose_and_double_no_pair(spark):
    points = [(k % 3, i, float(i * 7 % 40)) for k in range(3) for i in range(60)] + [(0, -1, None), (None, -2, 5.0), (7, -3, 5.0), (0, 3, 21.0)]
    spans = [(k, j, float(j * 5 % 30), float(j * 5 % 30 + j % 13)) for k in range(3) for j in range(50)] + [(0, -1, None, 9.0), (8, -2, 0.0, 9.0), (None, -3, 0.0, 9.0)]
    p, s = spark.createDataFrame(points, "k int, i int, at double"), spark.createDataFrame(spans, "k int, j int, lo double, hi double")
    want = sorted((k, i, at, j, lo, hi) for k, i, at in points for q, j, lo, hi in spans if k is not None and k == q and at is not None and lo is not None and lo <= at <= hi)
    for side in (1, 4, 1000):
        got = intervals.dealt_join(p, s, ["k"], "at", "lo", "hi", 6, side)
        assert got.columns == intervals.binned_join(p, s, ["k"], "at", "lo", "hi", 6).columns
        assert sorted(map(tuple, got.select("k", "i", "at", "j", "lo", "hi").collect())) == want
    assert intervals.dealt_join(p.limit(0), s, ["k"], "at", "lo", "hi", 6).count() == 0


def test_audit_deals_the_pairs_of_one_bin(spark):
    n = 3000
    lines = spark.range(0, n, 1, 1).select(F.lit(1).alias("g"), F.col("id").alias("seq"), F.lit(30.0).alias("remaining"))
    spans = spark.range(n).select(F.lit(1).alias("g"), F.col("id").alias("span_id"), F.lit(35.0).alias("remaining_start"), F.lit(25.0).alias("remaining_end"))
    per_task = [r[1] for r in pbp.audit_lines(lines, spans, ["g"]).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(per_task) == n * n and max(per_task) < 0.6 * n * n
