"""The corpus pipeline: quality rules, near duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a table; it is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspan.llm import decontaminate, mixing, neardup, quality, sharding
from fieldspan.llm.common import stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; the others stay as they are.

    A null or empty text has no words and is rejected; rows are judged one by one, so repeated ones stay or go
    together; texts are counted whole; an empty table stays empty; columns of any name come back."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that copies and links join, the document with the least id stays; a null id comes last.

    Texts without words (null ones too) are one group; rows alike in id and text are copies, of which one stays;
    of equal ids the text with the least hash stays; an empty table stays empty; columns of any name come back."""
    return neardup.Join(docs).keep_one()


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go, wherever in the text it is.

    A null or empty text has no words and stays; rows alike stay or go together; with an empty benchmark all stay;
    an empty table stays empty; columns of any name come back."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and with as many of their words, as the target weights ask for.

    A text without words is taken zero times; a null source is a source of its own, ordered last; repeated rows are
    documents of their own; an empty table stays empty; columns of any name come back, the text cut where a
    part of it is taken."""
    return mixing.mix_documents(docs)


def reshard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their new shard and slot: size, law, old_shard, shard, slot and moved are added, and take
    the place of columns of those names.

    A null text has a size of 16; a null source is hashed like any other; rows alike are placed one by one; an empty
    table stays empty."""
    return sharding.reshard(docs, sharding.hashed(F.col("source")))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mix_sources),
    ("sharding", reshard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage(docs, "pipeline")
    return docs


#: The join by MinHash and the mix by pseudorandom draws have no SQL; tests hold run() against
#: a plain version.
ORACLE_SQL = None
