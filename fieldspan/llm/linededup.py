"""Operator 8: line dedup by pairwise alignment.

Documents (ordered by id) that overlap are found through shared hashes and aligned by patience diff
over the hashes of all their lines; aligned blocks of MIN_BLOCK_WORDS words or more are deleted from
the later one. There are two ways to find them.

find_whole(), which the query takes, hashes runs: from each line on, and up to each line, the shortest
stretch of lines that has MIN_BLOCK_WORDS words, so that every block that could be deleted has one
and a run of so many words is rare as single lines needn't be. A document first meets the first
holder of each of its runs, then, for runs that still have a line left, the next holders: it ends up
as if aligned with every earlier document. A frequent run whose lines are gone makes no pairs: of n
documents with it, n - 1 are paired with the first. A run that no alignment takes away (it stands
twice on both sides, say) is looked for in its earlier holders: in all of them up to TIED, and beyond in those
with which the document shares its first line, its last one, or a line that each has once, as without such a
tie a patience diff aligns nothing.

find(), the default of report() and dedup(), takes lines of ANCHOR_WORDS words or more and their first
holders only: one pass, but blocks that only a later holder has stay.

Lines are compared without white space at their ends. Line hashes and pairs are shuffled; texts
only once, to meet the numbers of their deleted lines.

Defined cases: a null text stays null, with no lines; rows alike in id and text are one document
and come out alike; null ids come last in the order; equal ids are ordered by the hash of the
text; an empty table gives an empty result; other columns stay as they are in dedup() and are not
read by report().
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WS, WS_CHARS, apart, drop, ship, stage

ship(__name__)

ANCHOR_WORDS = 8
MIN_BLOCK_WORDS = 8


def longest_rising(values: list[int]) -> list[int]:
    """Places of a longest rising subsequence: piles as in the card game."""
    tops, at, before = [], [], []
    for k, v in enumerate(values):
        p = bisect_left(tops, v)
        before.append(at[p - 1] if p else -1)
        if p == len(tops):
            tops.append(v)
            at.append(k)
        else:
            tops[p], at[p] = v, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def align(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Patience diff: pairs of places of equal lines, rising in both.

    Equal lines at both ends are matched; between them, lines that each side has once are matched
    along their longest rising sequence, and what lies between those is aligned likewise."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, k, j, m = todo.pop()
        while i < k and j < m and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < k and j < m and a[k - 1] == b[m - 1]:
            k, m = k - 1, m - 1
            out.append((k, m))
        if i == k or j == m:
            continue
        times, others = Counter(a[i:k]), Counter(b[j:m])
        place = {b[y]: y for y in range(j, m) if others[b[y]] == 1}
        once = [(x, place[a[x]]) for x in range(i, k) if times[a[x]] == 1 and a[x] in place]
        found = [once[p] for p in longest_rising([y for _, y in once])]
        if not found:
            continue
        out += found
        last = (i - 1, j - 1)
        for x, y in [*found, (k, m)]:
            todo.append((last[0] + 1, x, last[1] + 1, y))
            last = (x, y)
    return sorted(out)


def deleted(first: list[int], later: list[int], words: list[int], least: int = MIN_BLOCK_WORDS) -> list[int]:
    """Places of the later document's lines that lie in aligned blocks of so many words."""
    out, block, last = [], [], None
    for x, y in [*align(first, later), (-9, -9)]:
        if last != (x - 1, y - 1):
            if sum(words[p] for p in block) >= least:
                out += block
            block = []
        block.append(y)
        last = (x, y)
    return out


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            first, later, words = (part.column(k).to_pylist() for k in (2, 3, 4))
            lines = [deleted(x, y, w) for x, y, w in zip(first, later, words, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lines, pa.list_(pa.int32()))], names=["id", "th", "lines"])


def _lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, th (hash of the text), h and w: hash and words of each line; texts that are null have no row."""
    text = F.col(text_col)
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(WS_CHARS)))
    count = lambda x: F.when(x == "", 0).otherwise(F.size(F.split(x, WS + "+")))
    docs = df.filter(text.isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), lines.alias("l"))
    return docs.select("id", "th", F.transform("l", lambda x: F.xxhash64(x)).alias("h"), F.transform("l", count).alias("w"))


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", anchor_words: int = ANCHOR_WORDS) -> DataFrame:
    """id, th (hash of the text), lines: places, from 0, of the lines to delete; only where there are any."""
    kind = df.schema[id_col].dataType.simpleString()
    docs = stage(_lines(df, id_col, text_col), "lines")
    key = F.struct(F.col("id").isNull().alias("x"), F.col("id").alias("id"), F.col("th").alias("th"))
    anchors = docs.select(key.alias("key"), F.explode(F.array_distinct(F.filter("h", lambda h, i: F.get("w", i) >= anchor_words))).alias("h"))
    first = anchors.groupBy("h").agg(F.min("key").alias("first"), F.max("key").alias("last")).filter("first <> last").select(F.bitwise_not("h").alias("nh"), "first")
    # Joined by another key than it was grouped by, so that both sides are shuffled for the join
    # alone and a frequent line's rows can be split over tasks.
    pairs = anchors.withColumn("nh", F.bitwise_not("h")).join(first, "nh").filter("key <> first").select("key", "first").distinct()
    own = docs.groupBy("id", "th").agg(F.first("h").alias("h"), F.first("w").alias("w"))
    later, earlier = own.select(key.alias("key"), "h", "w"), own.select(key.alias("first"), F.col("h").alias("fh"))
    both = pairs.join(later, "key").join(earlier, "first").select("key.id", "key.th", "fh", "h", "w")
    found = both.mapInArrow(_aligned, f"id {kind}, th bigint, lines array<int>").filter(F.size("lines") > 0)
    return found.groupBy("id", "th").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("lines")))).alias("lines"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, th, h, w, lines (those deleted), ks (hashes to look at; none: all) -> id, th, k: hashes of the
    document's runs of lines that have a line left.

    A run is the shortest one from a line on, or up to a line, that has MIN_BLOCK_WORDS words: each
    line of a block of so many words lies in a run that is within the block."""
    base = 0x9E3779B97F4A7C15
    back = np.uint64(pow(base, -1, 1 << 64))
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            h, w, gone, ks = (part.column(k) for k in (2, 3, 4, 5))
            sizes = h.value_lengths().to_numpy()
            ends = np.cumsum(sizes)
            starts, doc, n = ends - sizes, np.repeat(np.arange(len(sizes)), sizes), int(sizes.sum())
            if not n:
                continue
            words = np.concatenate([[0], np.cumsum(w.flatten().to_numpy(), dtype=np.int64)])
            left = np.ones(n, dtype=np.int64)
            left[np.repeat(starts, gone.value_lengths().to_numpy()) + gone.flatten().to_numpy()] = 0
            left = np.concatenate([[0], np.cumsum(left)])
            power = np.cumprod(np.full(n, base, dtype=np.uint64))
            sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(h.flatten().to_numpy().view(np.uint64) * power)])
            inverse = np.cumprod(np.full(n, back, dtype=np.uint64))
            at = np.arange(n)
            first = np.concatenate([at, np.searchsorted(words, words[1:] - MIN_BLOCK_WORDS, "right") - 1])
            end = np.concatenate([np.searchsorted(words, words[:-1] + MIN_BLOCK_WORDS, "left"), at + 1])
            doc = np.concatenate([doc, doc])
            good = (end <= ends[doc]) & (first >= starts[doc])
            first, end, doc = first[good], end[good], doc[good]
            good = left[end] > left[first]
            first, end, doc = first[good], end[good], doc[good]
            k = (sums[end] - sums[first]) * inverse[first]
            order = np.lexsort((k, doc))
            k, doc = k[order], doc[order]
            new = np.ones(len(k), dtype=bool)
            new[1:] = (k[1:] != k[:-1]) | (doc[1:] != doc[:-1])
            asked = ks.value_lengths().to_numpy()
            if asked.sum():
                mix = lambda a, b: a + b.astype(np.uint64) * np.uint64(base)
                new &= np.isin(mix(k, doc), mix(ks.flatten().to_numpy().view(np.uint64), np.repeat(np.arange(len(sizes)), asked)))
            doc = pa.array(doc[new])
            yield pa.RecordBatch.from_arrays([part.column(0).take(doc), part.column(1).take(doc), pa.array(k[new].view(np.int64))], names=["id", "th", "k"])


#: A round looks at so many times the holders of the round before.
WIDER = 4
#: Runs of more holders than this are looked for in those alone that a document has a tie with.
TIED = 16


def _ties(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, th, h -> id, th, t: hashes of what a patience diff can start from: a document's first line, its
    last one, and each line that it has once."""
    base = np.uint64(0x9E3779B97F4A7C15)
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            for k in range(part.num_rows):
                h = part.column(2)[k].values.to_numpy().view(np.uint64)
                if not len(h):
                    continue
                value, times = np.unique(h, return_counts=True)
                t = np.concatenate([value[times == 1] * base, h[:1] * base + np.uint64(1), h[-1:] * base + np.uint64(2)]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.repeat(part.column(0)[k], len(t)), pa.repeat(part.column(1)[k], len(t)), pa.array(t)], names=["id", "th", "t"])


def find_whole(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As find(), but with the lines of every aligned block that a document has with any earlier one.

    Documents meet over the hashes of their runs (see _runs), so that each block of
    MIN_BLOCK_WORDS words brings its documents together. The first round aligns with the first
    holder of each run. Runs that still have a line left are then taken to their next holders, 1, 4,
    16 ... of them in a round, until no run is left or has another earlier holder: a document
    meets all earlier ones that could still delete a line of it, and lines that are gone make no
    pairs. Of documents with the same lines the first stands for all; the others go as a whole."""
    kind = df.schema[id_col].dataType.simpleString()
    key = F.struct(F.col("id").isNull().alias("x"), F.col("id").alias("id"), F.col("th").alias("th"))
    docs = stage(_lines(df, id_col, text_col).withColumn("c", F.xxhash64("h")), "lines")
    # A document's lines are fixed by their hashes, and so are the words of each.
    every = stage(docs.groupBy("c").agg(F.min(key).alias("key"), F.first("h").alias("h"), F.first("w").alias("w")), "each")
    whole = docs.select(key.alias("key"), F.bitwise_not("c").alias("nc"), F.size("h").alias("n"), F.aggregate("w", F.lit(0), lambda a, x: a + x).alias("words"))
    copies = whole.filter(F.col("words") >= MIN_BLOCK_WORDS).join(every.select(F.bitwise_not("c").alias("nc"), F.col("key").alias("own")), "nc").filter("key <> own")
    copies = copies.select("key", F.sequence(F.lit(0), F.col("n") - 1).alias("lines")).dropDuplicates(["key"])
    every = every.select("key", "h", "w")
    none = F.array()

    def runs_of(rows: DataFrame) -> DataFrame:
        got = rows.select("key.id", "key.th", "h", "w", F.coalesce("lines", none.cast("array<int>")).alias("lines"), "ks").mapInArrow(_runs, f"id {kind}, th bigint, k bigint")
        return got.select(key.alias("key"), "k")

    def aligned(pairs: DataFrame) -> DataFrame:
        both = pairs.join(every, "key").join(every.select(F.col("key").alias("first"), F.col("h").alias("fh")), "first").select("key.id", "key.th", "fh", "h", "w")
        found = both.mapInArrow(_aligned, f"id {kind}, th bigint, lines array<int>").filter(F.size("lines") > 0)
        return found.select(key.alias("key"), "lines")

    def merged(found: DataFrame) -> DataFrame:
        return found.groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("lines")))).alias("lines"))

    runs = stage(runs_of(every.select("*", none.cast("array<int>").alias("lines"), none.cast("array<bigint>").alias("ks"))), "runs")
    held = runs.groupBy("k").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.bitwise_not("k").alias("nk"), "first", "n")
    # Joined by another key than it was grouped by, so that both sides are shuffled for the join
    # alone and a frequent run's rows can be split over tasks.
    met = stage(runs.withColumn("nk", F.bitwise_not("k")).join(held, "nk").filter("key <> first").select("key", "k", "first", "n"), "met")
    tried = stage(met.select("key", "first").distinct(), "pairs")
    seen = [tried]
    gone = stage(merged(aligned(tried)), "gone")

    def left_of(rows: DataFrame) -> DataFrame:
        ks = rows.groupBy("key").agg(F.collect_list("k").alias("ks"))
        return runs_of(ks.join(every, "key").join(gone, "key", "left"))

    left = stage(left_of(met.filter("n > 2")), "left")
    if not left.isEmpty():
        # Holders after the first, numbered; those of runs that nobody looks for are left out. Runs of many holders
        # are looked for tie by tie: two documents that have neither their first nor their last line in common,
        # nor a line that each has once, have no aligned lines at all, however often both have the run.
        asked = left.select("k").distinct()
        later = met.filter("n > 2").join(asked, "k", "left_semi").select("key", "k", "n")
        many = later.filter(F.col("n") > TIED)
        tied = many.select("key").distinct().join(every, "key").select("key.id", "key.th", "h").mapInArrow(_ties, f"id {kind}, th bigint, t bigint").select(key.alias("key"), "t")
        grouped = later.filter(F.col("n") <= TIED).select("key", "k", F.lit(0).cast("bigint").alias("t")).unionByName(many.join(tied, "key").select("key", "k", "t"))
        rank = F.row_number().over(Window.partitionBy("k", "t").orderBy("key"))
        holders = stage(grouped.select("key", "k", "t", rank.alias("r")), "holders")
        left = stage(left.join(holders, ["key", "k"]).filter("r > 1"), "left")
        low, high = 1, 1
        while not left.filter(F.col("r") > low).isEmpty():
            partners = holders.filter(F.col("r").between(low, high)).select("k", "t", F.col("key").alias("first"), F.col("r").alias("fr"))
            pairs = left.join(partners, ["k", "t"]).filter("fr < r").select("key", "first").distinct().join(tried, ["key", "first"], "left_anti")
            pairs = stage(pairs, "pairs")
            seen.append(pairs)
            tried = tried.unionByName(pairs)
            before, gone = gone, stage(merged(gone.unionByName(aligned(pairs))), "gone")
            drop(before)
            low, high = high + 1, high + WIDER * (high - low + 1)
            still = left.filter(F.col("r") > low)
            before, left = left, stage(left_of(still.select("key", "k").distinct()).join(still, ["key", "k"]), "left")
            drop(before)
        seen.append(holders)
    for table in (*seen, runs, met, left):
        drop(table)
    found = gone.join(copies.select("key"), "key", "left_anti").unionByName(copies)
    return found.select("key.id", "key.th", "lines")


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", find=find) -> DataFrame:
    """df with the deleted lines gone from its texts, and n_lines, n_deleted, deleted (places).
    find: find_whole for all blocks, find for those with first holders."""
    own = ["n_lines", "n_deleted", "deleted"]
    rows, names, _ = apart(df)
    ident, text = names[id_col], names[text_col]
    found = find(rows, ident, text).select(F.col("id").alias("__id"), F.col("th").alias("__th"), F.col("lines").alias("__lines"))
    keyed = rows.withColumn("__own", F.xxhash64(text))
    met = keyed.join(found, F.col(ident).eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__th")), "left")
    lines = F.split(F.col(text), "\n", -1)
    rest = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("__lines", i)), "\n")
    left = F.when(F.col("__lines").isNull(), F.col(text)).otherwise(rest)
    return met.select(
        *[(left if c == text_col else F.col(names[c])).alias(c) for c in df.columns if c not in own],
        F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).alias("n_lines"),
        F.when(F.col("__lines").isNull(), 0).otherwise(F.size("__lines")).alias("n_deleted"),
        F.coalesce("__lines", F.array().cast("array<int>")).alias("deleted"),
    )


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", find=find) -> DataFrame:
    """A row for each document: id, n_lines, n_deleted, text (what is left)."""
    got = dedup(df.select(id_col, text_col), id_col, text_col, find)
    return got.select(id_col, F.col("n_lines").cast("long").alias("n_lines"), F.col("n_deleted").cast("long").alias("n_deleted"), text_col)
