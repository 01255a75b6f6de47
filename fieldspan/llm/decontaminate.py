"""Operator 3: benchmark decontamination by winnowing.

Texts are hashed by K-word grams. Of each window of W grams the least hash is kept, in documents
and in benchmark items alike, so that any span of K + W - 1 words that both have shares a
fingerprint. Fingerprints are joined; each hit is extended word by word to both sides, by as
much as a window can reach, and counts if the equal words make up a window. As words are
compared, not hashes, and each shared window has a fingerprint, the hits are exact.

Items shorter than a window are one window of their own; their longest word is the fingerprint.

DataFrame operations only. Fingerprints of the benchmark are broadcast if it has at most
BROADCAST_WORDS words (counted first), and joined by a shuffle beyond: of documents' fingerprints
alone, without words, which only those take along that the benchmark has as well. Items that are
shorter than a window are counted apart: any word of a document may be their fingerprint, and while
they are few only the others' fingerprints, a fraction of the words, are shuffled.

Defined cases: a null text has no words; an item without words has no window; a null item_id
marks words but is not listed; documents alike in id and text are repeated in the result as
often as in the input; an empty benchmark leaves every document clean; other columns are not
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import apart, let

WINDOW = 10
K = 5
W = WINDOW - K + 1
BROADCAST_WORDS = 1_000_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    other = text.rlike(r"[\p{Lu}\p{Lt}\p{Nl}\p{So}&&[^A-Z]]")
    return F.when(other, F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))


def item_words(text: Column) -> Column:
    """Runs of digits, letters and characters beyond ASCII, in ASCII lower case."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def with_fingerprints(df: DataFrame, words: str) -> DataFrame:
    """df with __grams (hashes by place) and __kept (places of fingerprints)."""
    n = F.size(words)
    empty = F.array().cast("array<bigint>")
    gram = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(K)])
    df = df.withColumn("__grams", F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - K), gram)).otherwise(empty))
    m = F.size("__grams")
    least = lambda i: F.least(*[F.get("__grams", i + k) for k in range(W)])
    df = df.withColumn("__least", F.when(m >= W, F.transform(F.sequence(F.lit(0), m - W), least)).otherwise(empty))
    # A gram is kept if it is the least of some window that it lies in: no window's least is above it.
    kept = lambda i: F.get("__grams", i) == F.greatest(*[F.get("__least", i - k) for k in range(W)])
    places = F.when(m >= W, F.filter(F.sequence(F.lit(0), m - 1), kept)).otherwise(F.array().cast("array<int>"))
    return df.withColumn("__kept", places).drop("__least")


def _short(word: Column) -> Column:
    return F.xxhash64(word, F.lit("short item"))


def benchmark_index(benchmark: DataFrame, item_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """A row for each fingerprint of the benchmark: hash, ids of the items (those alike in words
    are one), near (words about it), at (its place in near), whole (words of a short item, or 0)."""
    items = benchmark.select(F.col(item_id).cast("string").alias("id"), item_words(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    items = items.groupBy("w").agg(F.collect_set("id").alias("ids"))
    long = with_fingerprints(items.filter(F.size("w") >= WINDOW), "w").withColumn("p", F.explode_outer("__kept"))
    low = F.greatest(F.col("p") - (W - 1), F.lit(0))
    long = long.select(F.get("__grams", F.col("p")).alias("hash"), "ids", F.slice("w", low + 1, F.lit(K + 2 * W - 2)).alias("near"), (F.col("p") - low).alias("at"), F.lit(0).alias("whole"))
    length = F.transform("w", lambda x: F.length(x))
    short = items.filter(F.size("w") < WINDOW).withColumn("at", F.array_position(length, F.array_max(length)).cast("int") - 1)
    short = short.select(_short(F.get("w", F.col("at"))).alias("hash"), "ids", F.col("w").alias("near"), "at", F.size("w").alias("whole"))
    # What items share word for word (a preamble of thousands of them, say) is one row with all of their ids.
    every = long.unionByName(short).groupBy("hash", "near", "at", "whole").agg(F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids"))
    return every.select("hash", "ids", "near", "at", "whole")


def find(documents: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each distinct (id, text): id_col, __hash (of the text), n_words, copies (rows
    alike), spans (start and end of the merged runs of hit words), items (ids as strings)."""
    tall = benchmark.select(F.size(item_words(F.col(item_text))).alias("n"))
    of = tall.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("words"), F.coalesce(F.sum(F.when(F.col("n") < WINDOW, F.col("n"))), F.lit(0)).alias("short")).first()
    index = benchmark_index(benchmark, item_id, item_text)

    texts = documents.select(F.col(id_col).alias("__id"), F.xxhash64(F.col(text_col)).alias("__hash"), item_words(F.col(text_col)).alias("__w"))
    docs = with_fingerprints(texts, "__w")
    # explode_outer, as the filter that Spark infers from explode would repeat the expressions above
    # for every place. Places of fingerprints; -1 stands for the document itself, -2 and below for single words.
    long = F.concat(F.array(F.lit(-1)), F.col("__kept"))
    single = F.when(F.size("__w") > 0, F.sequence(F.lit(-2), -1 - F.size("__w"), F.lit(-1))).otherwise(F.array().cast("array<int>"))

    def with_keys(places: Column) -> DataFrame:
        """A row for each of these places: __x, its fingerprint __key, and __p, the place in the text."""
        rows = docs.withColumn("__n", F.size("__w")).withColumn("__places", places).select("__id", "__hash", "__w", "__grams", "__n", F.explode_outer("__places").alias("__x"))
        word = -2 - F.col("__x")
        key = F.when(F.col("__x") <= -2, _short(F.get("__w", word))).otherwise(F.get("__grams", F.col("__x")))
        place = F.when(F.col("__x") <= -2, word).otherwise(F.col("__x"))
        return rows.withColumn("__key", key).withColumn("__p", place).drop("__grams")

    def at_hand(places: Column, index: DataFrame) -> DataFrame:
        """Places of documents with the fingerprints they meet, by broadcast; __w: all words, __at: the
        place in them."""
        rows = with_keys(places).withColumn("__at", F.col("__p"))
        # -1 has no key; it passes the outer join unmatched.
        return rows.join(F.broadcast(index), F.col("__key") == F.col("hash"), "left").filter((F.col("__x") == -1) | F.col("hash").isNotNull())

    def shuffled(places: Column, index: DataFrame) -> DataFrame:
        """As at_hand(), by a shuffle of fingerprints without words; those that are in the index then
        take the words about them along (__w, with __at the place in these)."""
        # Joined by another key than it was grouped by, so that a frequent fingerprint's rows can be split over tasks.
        known = index.select("hash").distinct().select(F.bitwise_not("hash").alias("__known"))
        slim = with_keys(places).select("__id", "__hash", "__x", "__p", "__key")
        slim = slim.join(known, F.bitwise_not("__key") == F.col("__known"), "left_semi")
        per = slim.groupBy("__id", "__hash").agg(F.collect_set(F.struct("__x", "__p", "__key")).alias("__hits")).withColumnsRenamed({"__id": "__own", "__hash": "__own_hash"})
        own = texts.join(per, F.col("__id").eqNullSafe(F.col("__own")) & F.col("__hash").eqNullSafe(F.col("__own_hash")))
        rows = own.select("__id", "__hash", "__w", F.size("__w").alias("__n"), F.explode_outer("__hits").alias("__hit")).select("__id", "__hash", "__n", "__w", "__hit.*")
        low = F.greatest(F.col("__p") - WINDOW, F.lit(0))
        rows = rows.withColumns({"__w": F.slice("__w", low + 1, F.lit(3 * WINDOW)), "__at": F.col("__p") - low})
        return rows.join(index, F.col("__key") == F.col("hash"))

    if of["words"] <= BROADCAST_WORDS:
        met = at_hand(F.concat(long, single) if of["short"] else long, index)
    else:
        # Each document's own row needs no join.
        met = texts.select("__id", "__hash", F.size("__w").alias("__n"), F.lit(-1).alias("__x"))
        met = met.unionByName(shuffled(F.col("__kept"), index.filter("whole = 0")), allowMissingColumns=True)
        if of["short"]:
            way = at_hand if of["short"] <= BROADCAST_WORDS else shuffled
            met = met.unionByName(way(single, index.filter("whole > 0")), allowMissingColumns=True)
    text, p = F.col("__w"), F.col("__at")

    same = lambda d: F.coalesce(F.get(text, p + d) == F.get("near", F.col("at") + d), F.lit(False))
    reach = W - 1
    left, right = F.lit(reach), F.lit(reach)
    for d in range(reach, 0, -1):
        left = F.when(~same(-d), d - 1).otherwise(left)
        right = F.when(~same(K - 1 + d), d - 1).otherwise(right)
    core = same(0)
    for d in range(1, K):
        core = core & same(d)
    first = p - F.col("at")
    whole = (F.col("whole") > 0) & (first >= 0) & (F.slice(text, F.greatest(first, F.lit(0)) + 1, F.greatest(F.col("whole"), F.lit(0))) == F.col("near"))
    start = F.when(F.col("whole") > 0, F.col("__p") - F.col("at")).otherwise(F.col("__p") - left)
    end = F.when(F.col("whole") > 0, start + F.col("whole")).otherwise(F.col("__p") + K + right)
    hit = F.col("hash").isNotNull() & F.when(F.col("whole") > 0, whole).otherwise(core & (left + K + right >= WINDOW))
    met = met.select("__id", "__hash", "__n", (F.col("__x") == -1).alias("self"), F.when(hit, F.struct(start.alias("start"), end.alias("end"))).alias("span"), F.when(hit, F.col("ids")).alias("ids"))
    per = met.filter(F.col("self") | F.col("span").isNotNull()).groupBy("__id", "__hash", "__n").agg(
        F.sum(F.col("self").cast("int")).alias("copies"), F.sort_array(F.collect_set("span")).alias("found"), F.collect_set("ids").alias("of")
    )
    return per.select(
        F.col("__id").alias(id_col),
        "__hash",
        F.col("__n").cast("long").alias("n_words"),
        "copies",
        let(F.col("found"), _merged).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten("of"))).alias("items"),
    )


def _merged(spans: Column) -> Column:
    """Sorted spans with those that overlap or touch made one."""
    kind = "array<struct<start:int,end:int>>"

    def add(out: Column, s: Column) -> Column:
        last = F.get(out, F.size(out) - 1)
        grown = F.concat(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(out) > 0) & (last["end"] >= s["start"]), grown).otherwise(F.concat(out, F.array(s)))

    return F.aggregate(spans, F.array().cast(kind), add)


def report(documents: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """A row for each document: id, n_words, n_hit, n_items, items_sha256, contaminated."""
    ident = names.get("id_col", "doc_id")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    got = find(documents, benchmark, **names).withColumn("n_hit", n_hit)
    got = got.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies").cast("long"))))
    return got.select(
        ident,
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """The documents without a hit, in their columns."""
    rows, own, back = apart(documents)
    ident, text = own[names.get("id_col", "doc_id")], own[names.get("text_col", "text")]
    found = find(rows, benchmark, **(names | {"id_col": ident, "text_col": text}))
    bad = found.filter(F.size("spans") > 0).select(F.col(ident).alias("__bad"), F.col("__hash").alias("__bad_hash"))
    keyed = rows.withColumn("__key_hash", F.xxhash64(F.col(text)))
    return keyed.join(bad, F.col(ident).eqNullSafe(F.col("__bad")) & (F.col("__key_hash") == F.col("__bad_hash")), "left_anti").select(*back)


def oracle() -> str:
    """report() in DuckDB SQL."""
    w = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {w} AS ws FROM documents),
b AS (SELECT item_id, {w} AS ws FROM benchmark),
bu AS (SELECT row_number() OVER () AS bid, item_id, ws FROM b WHERE len(ws) > 0),
bx AS (SELECT bid, item_id, least(len(ws), {WINDOW}) AS n, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM bu),
bw AS (SELECT DISTINCT item_id, n, array_to_string(l, ' ') AS s
       FROM (SELECT item_id, n, list(x) OVER (PARTITION BY bid ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS l FROM bx) WHERE len(l) >= n),
ns AS (SELECT DISTINCT n FROM bw),
du AS (SELECT rid, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM d),
dl AS (SELECT rid, i, list(x) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS l FROM du),
dw AS (SELECT rid, i, n, array_to_string(list_slice(l, 1, n), ' ') AS s FROM dl, ns WHERE len(l) >= n),
h AS (SELECT rid, i, n, item_id FROM dw JOIN bw USING (n, s)),
c AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT rid, i, n FROM h)) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT rid, item_id::VARCHAR AS x FROM h) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN t USING (rid)"""
