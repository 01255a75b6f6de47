"""The queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, fim, licence, linededup, mixing, neardup, pii, quality, sharding, tokenalign, tokencount, warc
from .common import new_path


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    done = sharding.reshard(docs, sharding.hashed(F.col("source")))
    path = new_path(spark, "shards")
    sharding.rewrite(done, path, every=True)  # the old layout is a rule: there are no files to keep
    done = spark.read.schema(done.schema).parquet(path)
    return done.select("doc_id", "size", F.crc32("text").alias("text_crc32"), "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard", "moved")


def op2_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence.report(_read(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write(_read(spark, sf_dir, "pages"), new_path(spark, "warc"))
    return warc.report(warc.read(archives))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(_read(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count(_read(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.Join(_read(spark, sf_dir, "documents")).report()


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(_read(spark, sf_dir, "documents"), find=linededup.find_whole)


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_read(spark, sf_dir, "documents"))


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_read(spark, sf_dir, "documents"))


def op11_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.report(_read(spark, sf_dir, "embeddings"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.report(_read(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenalign.report(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_reshard": op1_reshard,
        "op2_licence_scan": op2_licence_scan,
        "op3_decontaminate": op3_decontaminate,
        "op4_warc": op4_warc,
        "op5_quality": op5_quality,
        "op6_token_counts": op6_token_counts,
        "op7_jaccard_join": op7_jaccard_join,
        "op8_line_dedup": op8_line_dedup,
        "op9_personal_data": op9_personal_data,
        "op10_mix": op10_mix,
        "op11_nearest": op11_nearest,
        "op12_fill_in_middle": op12_fill_in_middle,
        "op13_token_alignment": op13_token_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_decontaminate": decontaminate.oracle(),
        "op4_warc": warc.oracle(),
        "op5_quality": quality.oracle(),
        "op12_fill_in_middle": fim.oracle(),
    }
