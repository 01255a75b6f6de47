"""Operator 10: mix sources to target weights.

Each source's documents are laid end to end and packed into blocks of a fixed number of words.
Multinomial counts say how many slots of each output shard a source fills; the slots of a
source, numbered through all shards, pass over its blocks in a pseudorandom order (another
permutation for each pass); blocks and slots meet by block index.

DataFrame operations only. What the driver holds: one row for each source with its count in each
output shard; more than MAX_SOURCES sources raise an error.

Defined cases: a null text has no words; a null source is a source of its own, ordered last; a
document without words is taken zero times; repeated rows count as documents of their own;
an empty table gives an empty result. Extra columns of the input are not read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import let, small_table, stage, word_count, words

WEIGHTS = (5, 2, 1)
CAP = 3
BLOCK_WORDS = 64
N_SHARDS = 64
N_BUCKETS = 1024
CHUNK = 4096
SEED = 20240229
MAX_SOURCES = 10_000


def targets(sizes: list[int], weights: list[float], cap: float = CAP) -> list[float]:
    """Share sum(sizes) by weight. A share above cap * size stops there and its excess goes to
    the others by weight, until no share is above."""
    out, left, active = [0.0] * len(sizes), float(sum(sizes)), list(range(len(sizes)))
    while active:
        total = sum(weights[i] for i in active)
        over = [i for i in active if left * weights[i] / total > cap * sizes[i]]
        if not over:
            for i in active:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(cap * sizes[i])
        left -= sum(out[i] for i in over)
        stopped = set(over)
        active = [i for i in active if i not in stopped]
    return out


def shard_counts(slots: list[int], n_shards: int, seed: int) -> np.ndarray:
    """counts[shard, source]: multinomial draws, shard after shard, then evened so that each
    source has just the slots given. A draw that a source has too many of is handed, in the
    same shard, to one that has too few: shard lengths stay as they were."""
    total = sum(slots)
    if not total:
        return np.zeros((n_shards, len(slots)), dtype=np.int64)
    rng = np.random.Generator(np.random.PCG64(seed))
    length = [total // n_shards + (k < total % n_shards) for k in range(n_shards)]
    p = np.array(slots, dtype=float) / total
    counts = np.array([rng.multinomial(n, p) for n in length], dtype=np.int64)
    over = counts.sum(axis=0) - np.array(slots)
    for k in rng.permutation(n_shards).tolist() * 2:
        give, take = np.minimum(counts[k], np.maximum(over, 0)), np.maximum(-over, 0)
        n = min(give.sum(), take.sum())
        # The first ones in order give and take until n are handed over.
        change = sum(sign * np.clip(n - (x.cumsum() - x), 0, x) for sign, x in ((1, take), (-1, give)))
        counts[k] += change
        over += change
    return counts


def permuted(index: Column, size: Column, bits: Column, key: Column) -> Column:
    """A pseudorandom permutation of 0 .. size - 1, another for each key; bits: the least number
    with 2 ** bits >= size, 40 at most.

    Odd multiplication, addition and shifted exclusive-or are one-to-one on numbers of so many
    bits; 2 ** bits is under twice the size, and numbers that fall outside go round again until
    they fall inside. Each round more is needed with a chance under 1/2: what 96 rounds would
    leave outside has a chance of less than 2 ** -90."""
    top = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
    half = F.greatest(F.lit(1), F.floor(bits / 2).cast("int"))

    def step(x: Column) -> Column:
        for n in (1, 2, 3):
            odd = F.xxhash64(key, F.lit(2 * n)).bitwiseAND(F.lit(0x3FFFFE)) + 1
            add = F.xxhash64(key, F.lit(2 * n + 1)).bitwiseAND(F.lit(0x3FFFFFFF))
            x = (x * odd + add).bitwiseAND(top)
            x = x.bitwiseXOR(F.call_function("shiftrightunsigned", x, half))
        return x

    again = lambda y: F.aggregate(F.sequence(F.lit(1), F.lit(96)), y, lambda x, _: F.when(x < size, x).otherwise(step(x)))
    return let(step(index.cast("long")), lambda y: F.when(y < size, y).otherwise(again(y)))


def add_key(df: DataFrame, id_col: str, text_col: str, source_col: str, extra: list[str] = ()) -> DataFrame:
    """A written table: a row key, id, source, size in words, text hash; extra columns as they are."""
    own = df.select(
        F.monotonically_increasing_id().alias("__uid"),
        F.col(id_col).alias("__id"),
        F.col(source_col).alias("__source"),
        word_count(F.col(text_col)).alias("__size"),
        F.xxhash64(F.col(text_col)).alias("__hash"),
        *extra,
    )
    return stage(own, "mix-rows")


class Mix:
    """The plan of one mix over rows of add_key()."""

    def __init__(self, rows: DataFrame, *, weights=WEIGHTS, cap: int = CAP, block_words: int = BLOCK_WORDS, n_shards: int = N_SHARDS, n_buckets: int = N_BUCKETS, seed: int = SEED):
        spark, self.block_words = rows.sparkSession, block_words
        found = rows.groupBy("__source").agg(F.sum("__size").alias("n")).limit(MAX_SOURCES + 1).collect()  # one row a source
        if len(found) > MAX_SOURCES:
            raise ValueError(f"there are more than {MAX_SOURCES} sources")
        found.sort(key=lambda r: (r[0] is None, r[0] or ""))
        size = [r["n"] for r in found]
        target = targets(size, [weights[i % len(weights)] for i in range(len(size))], cap)
        blocks = [-(-n // block_words) for n in size]
        # A block holds size / blocks words on average, and the target is met in words.
        slots = [min(cap * b, round(t * b / n)) if n else 0 for t, b, n in zip(target, blocks, size, strict=True)]
        counts = shard_counts(slots, n_shards, seed)
        first = np.cumsum(counts, axis=0) - counts
        rows_of = [{"src": i, "name": r[0], "known": r[0] is not None, "source_size": n, "target": t} for i, (r, n, t) in enumerate(zip(found, size, target, strict=True))]
        self.sources = small_table(spark, rows_of, "src int, name string, known boolean, source_size bigint, target double")
        per = [{"src": i, "nb": blocks[i], "bits": (blocks[i] - 1).bit_length(), "of": [{"shard": k, "first": int(first[k, i]), "n": int(counts[k, i])} for k in range(n_shards) if counts[k, i]]} for i in range(len(size))]
        spans = small_table(spark, per, "src int, nb bigint, bits int, of array<struct<shard:int,first:bigint,n:bigint>>")
        self.spans = spans.select("src", "nb", "bits", F.inline("of"))
        self.seed, self.n_buckets, self.spark = seed, n_buckets, spark
        named = rows.join(self.sources, F.col("__source").eqNullSafe(F.col("name")), "inner")
        self.rows = named.withColumn("bucket", F.pmod(F.xxhash64("__id", "__hash"), F.lit(n_buckets)).cast("int"))

    def placed(self) -> DataFrame:
        """Each row with the number of its first word within its source.

        Two levels of prefix sums: rows within a bucket of a source, then buckets, so that a
        source with a large part of all rows is dealt over as many tasks as there are buckets."""
        inner = Window.partitionBy("src", "bucket").orderBy("__id", "__hash", "__uid").rowsBetween(Window.unboundedPreceding, -1)
        outer = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        sums = self.rows.groupBy("src", "bucket").agg(F.sum("__size").alias("sum"))
        base = sums.select("src", "bucket", F.coalesce(F.sum("sum").over(outer), F.lit(0)).alias("base"))
        at = F.coalesce(F.sum("__size").over(inner), F.lit(0))
        return self.rows.withColumn("at", at).join(base, ["src", "bucket"]).withColumn("at", F.col("at") + F.col("base")).drop("base", "bucket")

    def pieces(self) -> DataFrame:
        """Each row cut at block borders: block, from (word within the document), length."""
        n, size = F.lit(self.block_words), F.col("__size")
        # A row without words has no blocks; it goes to block -1, which no slot has.
        first, last = F.when(size > 0, F.floor(F.col("at") / n)).otherwise(-1), F.when(size > 0, F.floor((F.col("at") + size - 1) / n)).otherwise(-1)
        cut = self.placed().withColumn("block", F.explode(F.sequence(first, last)))
        low = F.greatest(F.col("at"), F.col("block") * n)
        high = F.least(F.col("at") + size, (F.col("block") + 1) * n)
        return cut.withColumn("from", low - F.col("at")).withColumn("length", F.when(size > 0, high - low).otherwise(0))

    def slots(self) -> DataFrame:
        """The mix itself: shard, slot number within its source, pass, source, block."""
        chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK)))
        # A stated number: left to itself, Spark would gather these few rows into one task.
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        some = self.spans.withColumn("chunk", chunk).repartition(parts, "src", "shard", "chunk")
        own = F.explode(F.sequence(F.col("chunk") * CHUNK, F.least(F.col("n"), (F.col("chunk") + 1) * CHUNK) - 1))
        every = some.withColumn("q", own).withColumn("q", F.col("q") + F.col("first"))
        every = every.withColumn("pass", F.floor(F.col("q") / F.col("nb")).cast("int"))
        key = F.xxhash64(F.lit(self.seed), F.col("src"), F.col("pass"))
        block = permuted(F.col("q") % F.col("nb"), F.col("nb"), F.col("bits"), key)
        return every.select("shard", "src", "q", "pass", block.alias("block"))

    def taken(self) -> DataFrame:
        """One row for each input row: __uid, __id, __size, source_size, target, taken."""
        # Spark takes a table that grows out of a few rows for small: the join is told to shuffle.
        uses = self.slots().groupBy("src", "block").agg(F.count(F.lit(1)).alias("uses")).hint("merge")
        met = self.pieces().join(uses, ["src", "block"], "left")
        got = F.sum(F.col("length") * F.coalesce(F.col("uses"), F.lit(0)))
        return met.groupBy("__uid", "__id", "__size", "source_size", "target").agg(got.cast("long").alias("taken"))

    def passes(self) -> DataFrame:
        """One row for each input row and pass that takes words of it: __uid, __size, pass, parts."""
        met = self.pieces().join(self.slots().hint("merge"), ["src", "block"])
        return met.groupBy("__uid", "__size", "pass").agg(F.sort_array(F.collect_list(F.struct("from", "length"))).alias("parts"))


def mix_report(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """For each row: id, size, source_size, target, taken (words that the mix takes, with repeats)."""
    plan = Mix(add_key(df, id_col, text_col, source_col), **options)
    return plan.taken().select(F.col("__id").alias(id_col), F.col("__size").alias("size"), "source_size", "target", "taken")


def pick(text: Column, parts: Column) -> Column:
    """What a text has between the first and last word of each part, white space included. Parts
    (from, length; sorted) that follow on each other go on as the text does; others begin a line."""
    gaps = F.split(text, r"[^\x20\x09-\x0D]+", -1)  # what stands before each word, and after the last

    def taken(w: Column, g: Column) -> Column:
        def one(p: Column, i: Column) -> Column:
            at, n, last = p["from"].cast("int"), p["length"].cast("int"), F.get(parts, i - 1)
            lead = F.when(i == 0, "").when(last["from"] + last["length"] == p["from"], F.get(g, at)).otherwise("\n")
            rest = F.zip_with(F.slice(g, at + 2, n - 1), F.slice(w, at + 2, n - 1), lambda x, y: F.concat(x, y))
            return F.concat(lead, F.get(w, at), F.array_join(rest, ""))

        return F.array_join(F.transform(parts, one), "")

    # let: as columns of their own the arrays would be made again for each part.
    return let(words(text), lambda w: let(gaps, lambda g: taken(w, g)))


def mix_documents(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed corpus in the columns of df: one row for each document and pass with the words
    of the blocks that this pass takes. Where it takes the whole document the text is as it was;
    of others it is what pick() gives. n_chars, if there is such a column, follows."""
    copy = {c: f"__in_{i}" for i, c in enumerate(df.columns)}
    rows = add_key(df, id_col, text_col, source_col, [F.col(c).alias(x) for c, x in copy.items()])
    text = F.col(copy[text_col])
    done = Mix(rows.select("__uid", "__id", "__source", "__size", "__hash"), **options).passes()
    both = rows.drop("__size").join(done, "__uid")
    whole = F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["length"]) == F.col("__size")
    both = both.withColumn(copy[text_col], F.when(whole, text).otherwise(pick(text, F.col("parts"))))
    if "n_chars" in copy:
        kind = df.schema["n_chars"].dataType
        both = both.withColumn(copy["n_chars"], F.when(whole, F.col(copy["n_chars"])).otherwise(F.length(text).cast(kind)))
    return both.select(*[F.col(x).alias(c) for c, x in copy.items()])
