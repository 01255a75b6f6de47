"""Operator 5: quality rules.

A table of thresholds is compiled into one projection of counts over each text: no user
function, no shuffle. Ratios are compared as products of whole numbers.

Defined cases: a null or empty text has no words and fails; the counts cover the whole text,
however long; repeated rows get the same verdict; an empty table gives an empty result; extra
columns stay as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, apart, let, words

#: Frequent words of the four languages (fixed values).
STOP_WORDS = (
    "a al als and are as at auf aus avec be but by con con da dans das de del dem den der des die du ein eine el elle en er es est et "
    "for from für he il im in is ist it la las le les lo los mais mit nicht no not of on or ou par para pas por pour que qui se si "
    "sich sind son su sur that the they this to un una und une von was with y you zu"
).split()


@dataclass(frozen=True)
class Rule:
    """Reject where low * (count of) > share * 100 fails: percent_low <= 100 * count / per <= percent_high."""

    name: str
    count: str
    per: str
    percent_low: int | None = None
    percent_high: int | None = None


#: The threshold table. Counts: see COUNTS; a percentage of 100 means one for each.
RULES = (
    Rule("mean word length", "word_chars", "n_words", 200, 1200),
    Rule("symbols to words", "n_symbols", "n_words", None, 25),
    Rule("exclamation marks to words", "n_bangs", "n_words", None, 50),
    Rule("stop words", "n_stop_words", "n_words", 1, None),
    Rule("repeated lines", "n_dup_lines", "n_lines", None, 50),
)
MIN_WORDS = 50
REPEAT_PERCENT = 50
WINDOW = 3


def with_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with the counts as columns prefixed by two underscores, which df's own names must not be."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    first = df.withColumns({"__words": words(text), "__lines": lines})
    n = F.size("__words")
    every = sorted({x for w in STOP_WORDS for x in (w, w.capitalize(), w.upper())})
    grams = F.when(
        n >= WINDOW,
        F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get("__words", i + k) for k in range(WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>"))
    second = first.withColumn("__grams", grams)
    out = {
        "__n_words": n,
        "__word_chars": F.length(F.regexp_replace(text, WS + "+", "")),
        "__n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")),
        "__n_bangs": F.length(F.regexp_replace(text, r"[^!]+", "")),
        "__n_lines": F.size("__lines"),
        "__n_dup_lines": F.size("__lines") - F.size(F.array_distinct("__lines")),
        "__n_stop_words": F.size(F.filter("__words", lambda w: w.isin(every))),
        "__n_repeat_words": F.when(F.size(F.array_distinct("__grams")) == F.size("__grams"), 0).otherwise(_covered("__grams")),
    }
    # The counts come out of a generator: a filter on a projected column would be pushed below the
    # projection and count everything again for each mention.
    counts = F.struct(*[v.cast("long").alias(k) for k, v in out.items()])
    held = second.select(*df.columns, F.explode_outer(F.array(counts)).alias("__counts"))
    return held.select(*df.columns, "__counts.*")


def _covered(grams: str) -> Column:
    """Words that lie in windows found twice or more: sort windows with their places, keep those
    equal to a neighbour, and add up how far each reaches beyond the one before."""
    placed = F.array_sort(F.transform(F.col(grams), lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        near = lambda x, k: F.coalesce(F.get(s, k)["g"] == x["g"], F.lit(False))
        return F.array_sort(F.transform(F.filter(s, lambda x, k: near(x, k - 1) | near(x, k + 1)), lambda x: x["i"]))

    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    total = lambda at: F.aggregate(
        at, start, lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"]
    )
    return let(placed, lambda s: let(repeated(s), total))


def passes(rules: tuple[Rule, ...] = RULES) -> Column:
    """The compiled table: true where every rule holds."""
    out = F.lit(True)
    for r in rules:
        count, per = F.col(f"__{r.count}") * 100, F.col(f"__{r.per}")
        if r.percent_low is not None:
            out = out & (count >= per * r.percent_low)
        if r.percent_high is not None:
            out = out & (count <= per * r.percent_high)
    return out


def base_failed() -> Column:
    return (F.col("__n_words") < MIN_WORDS) | (F.col("__n_repeat_words") * 100 > F.col("__n_words") * REPEAT_PERCENT)


def judge(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """df with the counts, __base_failed and __kept."""
    return with_counts(df, text_col).withColumn("__base_failed", base_failed()).withColumn("__kept", ~base_failed() & passes(rules))


def keep_good(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of df that pass, in its columns."""
    rows, names, back = apart(df)
    return judge(rows, names[text_col]).filter("__kept").select(*back)


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    more = ["base_failed", "kept", "n_lines", "n_bangs", "n_stop_words"]
    got = judge(df.select(F.col(id_col), F.col(text_col)), text_col)
    return got.select(F.col(id_col), *[F.col(f"__{c}").alias(c) for c in names + more])


def oracle() -> str:
    """The same report in DuckDB SQL."""
    stop = ", ".join("'" + x + "'" for x in sorted({x for w in STOP_WORDS for x in (w, w.capitalize(), w.upper())}))
    rules = " AND ".join(
        f"{r.count} * 100 {op} {r.per} * {v}" for r in RULES for op, v in ((">=", r.percent_low), ("<=", r.percent_high)) if v is not None
    )
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
u AS (SELECT rid, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT rid, i, x, lead(x, 1) OVER p AS y, lead(x, 2) OVER p AS z FROM u WINDOW p AS (PARTITION BY rid ORDER BY i)),
c AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, x, y, z) AS n FROM g WHERE z IS NOT NULL),
r AS (SELECT rid, count(DISTINCT i + k) AS n FROM c, (VALUES (0), (1), (2)) AS v(k) WHERE n > 1 GROUP BY rid),
m AS (SELECT w.rid, doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
        len(ls)::BIGINT AS n_lines, length(regexp_replace(t, '[^!]', '', 'g'))::BIGINT AS n_bangs,
        len(list_filter(ws, lambda x: x IN ({stop})))::BIGINT AS n_stop_words
      FROM w LEFT JOIN r USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_bangs, n_stop_words,
  n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {REPEAT_PERCENT} AS base_failed,
  NOT (n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {REPEAT_PERCENT}) AND {rules} AS kept
FROM m"""
