"""Interval operators. Every join has equal keys; ranges are running windows or bins, never all pairs of a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows on each side of a tile of dealt_join(), tiles to a task, and the most tasks that it asks for; beyond those, a task has
#: more tiles, one after another.
TILE, TASK_TILES, MOST_TASKS = 1024, 4, 10_000


def closed_overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column, within: float = 0) -> Column:
    """Overlap, touching included, of intervals that lie within so much of each other."""
    return (a_start <= b_end + within) & (b_start <= a_end + within)


def matched(a: DataFrame, b: DataFrame, keys: list[str], within: float = 0, strict: bool = False, how: str = "left_semi") -> DataFrame:
    """Rows of a that some row of b with the same keys overlaps (left_semi), or none (left_anti).

    Touching counts, and so does lying within so much of each other; with strict, only a common stretch
    does. Of the rows of b that begin by the end of a row of a, the one that ends last decides. So one
    sort of both sides does, and no pairs are made."""
    low, high = F.col("start_sec").cast("double"), F.col("end_sec").cast("double")
    row = F.struct(*a.columns)
    kind = a.select(row.alias("r")).schema["r"].dataType
    # On equal places, b comes first where touching counts and last where it doesn't.
    own = a.select(*keys, row.alias("__row"), (high + within).alias("__at"), F.lit(0 if strict else 1).alias("__turn"), F.lit(None).cast("double").alias("__end"))
    real = b.dropna(subset=[*keys, "start_sec", "end_sec"])
    if strict:
        real = real.filter("end_sec > start_sec")
    others = real.select(*keys, F.lit(None).cast(kind).alias("__row"), low.alias("__at"), F.lit(1 if strict else 0).alias("__turn"), high.alias("__end"))
    so_far = Window.partitionBy(*keys).orderBy("__at", "__turn").rowsBetween(Window.unboundedPreceding, 0)
    both = own.unionByName(others).withColumn("__last", F.max("__end").over(so_far)).filter("__row is not null")
    start, end = F.col("__row.start_sec").cast("double"), F.col("__row.end_sec").cast("double")
    hit = F.coalesce((F.col("__last") > start) & (end > start) if strict else F.col("__last") >= start - within, F.lit(False))
    return both.filter(hit if how == "left_semi" else ~hit).select("__row.*")


def binned_join(points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str, width: float) -> DataFrame:
    """Points within spans (both ends included): spans are dealt over bins of a width, bins are joined
    by equality. A long span meets its own points only, and a bin no more than its own."""
    held = spans.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    own = points.withColumn("__bin", F.floor(F.col(at) / width))
    return own.join(held, [*keys, "__bin"]).filter(F.col(at).between(F.col(start), F.col(end))).drop("__bin")


def dealt_join(points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str, width: float, side: int = TILE) -> DataFrame:
    """binned_join() where the spans of a key overlap, so that pairs grow with the square of the input.

    A bin of more than side points or spans is cut into tiles of about side by side rows, by a hash of the row
    (exactly equal rows stay together): points are repeated for each part of its spans, spans for each part of
    its points, and every pair meets in one tile. There are as many tasks as pairs ask for; they are counted
    beforehand, as the bytes that go in don't tell."""
    held = spans.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    own = points.withColumn("__bin", F.floor(F.col(at) / width))
    cell = [*keys, "__bin"]
    both = own.select(*cell, F.lit(1).alias("p"), F.lit(0).alias("s")).unionByName(held.select(*cell, F.lit(0).alias("p"), F.lit(1).alias("s")))
    cells = both.groupBy(*cell).agg(F.sum("p").alias("__p"), F.sum("s").alias("__s"))
    work = cells.agg(F.sum(F.col("__p").cast("double") * F.col("__s") + F.col("__p") + F.col("__s"))).first()[0] or 0
    tasks = int(min(work // (TASK_TILES * side * side) + 1, MOST_TASKS))
    parts = lambda n: F.greatest(F.ceil(F.col(n) / side), F.lit(1)).alias(f"{n}_parts")
    large = F.broadcast(cells.filter((F.col("__p") > 0) & (F.col("__s") > 0) & (F.greatest("__p", "__s") > side)).select(*cell, parts("__p"), parts("__s")))

    def dealt(df: DataFrame, mine: str, other: str) -> DataFrame:
        n = lambda c: F.coalesce(f"{c}_parts", F.lit(1).cast("long"))
        row = F.xxhash64(*[c for c, kind in df.dtypes if "map<" not in kind])
        out = df.join(large, cell, "left").withColumns({f"{mine}_part": F.pmod(row, n(mine)), f"{other}_part": F.explode(F.sequence(F.lit(0).cast("long"), n(other) - 1))})
        return out.drop("__p_parts", "__s_parts").repartition(tasks, *tile)

    tile = [*cell, "__p_part", "__s_part"]
    met = dealt(own, "__p", "__s").join(dealt(held, "__s", "__p"), tile)
    return met.filter(F.col(at).between(F.col(start), F.col(end))).drop("__bin", "__p_part", "__s_part")


def overlaps(a: DataFrame, b: DataFrame, keys: list[str], width: float) -> DataFrame:
    """a with other_start, other_end of each row of b that overlaps it, touching included.

    Both are dealt over bins of a width; a pair counts in the first bin that both lie in."""
    bins = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor(F.col(e) / width)))
    own = a.withColumn("__bin", bins("start_sec", "end_sec"))
    other = b.select(*keys, F.col("start_sec").alias("other_start"), F.col("end_sec").alias("other_end")).withColumn("__bin", bins("other_start", "other_end"))
    met = own.join(other, [*keys, "__bin"])
    once = F.floor(F.greatest("start_sec", "other_start") / width) == F.col("__bin")
    return met.filter(closed_overlap(F.col("start_sec"), F.col("end_sec"), F.col("other_start"), F.col("other_end")) & once).drop("__bin")


def nearest_within(targets: DataFrame, points: DataFrame, keys: list[str], target: str, at: str, value: str, limit: int) -> DataFrame:
    """Each target with the nearest point less than limit away (the first of those as near), or null."""
    near = points.select(*keys, F.col(at).alias("__at"), F.col(value).alias("__value"), F.explode(F.array(*[F.floor(F.col(at) / limit) + d for d in (-1, 0, 1)])).alias("__bin"))
    own = targets.withColumn("__bin", F.floor(F.col(target) / limit))
    met = own.join(near, [*keys, "__bin"], "left")
    far = F.abs(F.col(target) - F.col("__at"))
    best = F.min(F.when(far < limit, F.struct(far.alias("far"), F.col("__at").alias("at"), F.col("__value").alias("value")))).alias("__best")
    return met.groupBy(*targets.columns).agg(best).select(*targets.columns, F.col("__best.at").alias("nearest"), F.col("__best.value").alias(value), F.col("__best.far").alias("distance"))


def nearest_reason(detected: DataFrame, official: DataFrame, keys: list[str]) -> DataFrame:
    """detected with the end_reason of the official row of the same keys that ends nearest (first of
    those as near, by seq); null where there is none.

    In the order of their ends, that is the official row before or the one after."""
    row = F.struct(*[c for c in detected.columns if c != "end_reason"])
    ends = official.dropna(subset=[*keys, "end_sec"]).groupBy(*keys, F.col("end_sec").alias("__at")).agg(F.min(F.struct("seq", "end_reason")).alias("__hit"))
    none = lambda df, c: F.lit(None).cast(df.select(F.expr(c) if isinstance(c, str) else c).schema[0].dataType)
    own = detected.select(*keys, F.col("end_sec").alias("__at"), none(ends, "__hit").alias("__hit"), row.alias("__row"))
    both = own.unionByName(ends.select(*keys, "__at", "__hit", none(detected, row).alias("__row")))
    point = F.when(F.col("__hit").isNotNull(), F.struct("__at", "__hit"))
    w = Window.partitionBy(*keys)
    so_far = lambda order: F.last(point, ignorenulls=True).over(w.orderBy(order, F.col("__row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0))
    met = both.withColumns({"__before": so_far(F.asc("__at")), "__after": so_far(F.desc("__at"))}).filter("__row is not null")
    far = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col("__at") - F.col(f"{c}.__at")).alias("far"), F.col(f"{c}.__hit.seq").alias("seq"), F.col(f"{c}.__hit.end_reason").alias("why")))
    return met.withColumn("__best", F.least(far("__before"), far("__after"))).select("__row.*", F.col("__best.why").alias("end_reason"))


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """change (disappeared, appeared), keys, start_sec, end_sec."""
    gone = matched(old, new, keys, how="left_anti").select(F.lit("disappeared").alias("change"), *keys, "start_sec", "end_sec")
    came = matched(new, old, keys, how="left_anti").select(F.lit("appeared").alias("change"), *keys, "start_sec", "end_sec")
    return gone.unionByName(came)


def merges(old: DataFrame, new: DataFrame, keys: list[str], width: float = 600.0) -> DataFrame:
    """New intervals that two old ones or more overlap: keys, start_sec, end_sec, n_old, old_starts."""
    met = overlaps(new.select(*keys, "start_sec", "end_sec"), old, keys, width)
    got = met.groupBy(*keys, "start_sec", "end_sec").agg(F.count(F.lit(1)).alias("n_old"), F.array_sort(F.collect_list("other_start")).alias("old_starts"))
    return got.filter("n_old >= 2")


def split_blocks(blocks: DataFrame, hidden: DataFrame, keys: list[str], long_sec: float, buffer_sec: float, carry: Sequence[str] = (), width: float = 600.0) -> DataFrame:
    """Cut long blocks where windows of the other team lie within them.

    blocks: keys, carry, team, other, start_sec, end_sec; hidden: keys, team, start_sec, end_sec. A block
    above long_sec that holds windows of its other team (to within buffer_sec) becomes its own
    remainders and those windows, cut to the block; every other block stays. Pieces have the columns
    of carry (a camera) from their block. Blocks and windows meet over bins of a width."""
    b = blocks.withColumn("__long", F.col("end_sec") - F.col("start_sec") > long_sec)
    h = hidden.select(*keys, F.col("team").alias("other"), F.col("start_sec").alias("__hs"), F.col("end_sec").alias("__he"))
    low, high = F.col("start_sec") - buffer_sec, F.col("end_sec") + buffer_sec
    spans = b.filter("__long").withColumns({"__low": low, "__high": high})
    met = binned_join(h, spans, [*keys, "other"], "__hs", "__low", "__high", width).filter("__he <= __high").drop("__low", "__high")
    met = met.withColumns({"__s": F.greatest("__hs", "start_sec"), "__e": F.least("__he", "end_sec")})
    kept = [*keys, *carry]
    own = [*kept, "team", "other", "start_sec", "end_sec"]
    found = met.select(*own).distinct()
    met = met.filter("__e > __s")
    w = Window.partitionBy(*own).orderBy("__s", "__e")
    met = met.withColumns({"__cursor": F.coalesce(F.lag("__e").over(w), F.col("start_sec")), "__next": F.lead("__s").over(w)})
    keep, cut = F.lit("video_detected"), F.lit("official_split_within_long_video_block")
    piece = lambda df, team, s, e, source: df.select(*kept, team.alias("team"), s.alias("start_sec"), e.alias("end_sec"), source.alias("boundary_source"))
    before = piece(met.filter("__s > __cursor"), F.col("team"), F.col("__cursor"), F.col("__s"), keep)
    theirs = piece(met, F.col("other"), F.col("__s"), F.col("__e"), cut)
    after = piece(met.filter("__next is null and end_sec > __e"), F.col("team"), F.col("__e"), F.col("end_sec"), keep)
    # Blocks whose windows are all empty once cut stay whole as a remainder of their own.
    bare = found.join(met.select(*own).distinct(), own, "left_anti")
    whole = piece(bare, F.col("team"), F.col("start_sec"), F.col("end_sec"), keep)
    rest = piece(b.join(found, own, "left_anti"), F.col("team"), F.col("start_sec"), F.col("end_sec"), keep)
    return before.unionByName(theirs).unionByName(after).unionByName(whole).unionByName(rest)


def _numbered(raw: DataFrame, aligned: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    w = Window.partitionBy(*keys)
    rank, n = F.row_number().over(w.orderBy("start_sec", "end_sec")).alias("rank"), F.count(F.lit(1)).over(w).alias("__n")
    return raw.select(*keys, "start_sec", "end_sec", rank, n), aligned.select(*keys, F.col("start_sec").alias("aligned_start"), F.col("end_sec").alias("aligned_end"), rank, n)


def by_rank(raw: DataFrame, aligned: DataFrame, keys: list[str]) -> DataFrame:
    """The n-th raw with the n-th aligned interval of the same keys; those left over are skipped."""
    r, a = _numbered(raw, aligned, keys)
    return r.drop("__n").join(a.drop("__n"), [*keys, "rank"])


def by_position(raw: DataFrame, aligned: DataFrame, keys: list[str]) -> DataFrame:
    """As by_rank(), but only for keys of which both sides have as many; count_mismatches() has the others."""
    r, a = _numbered(raw, aligned, keys)
    return r.join(a, [*keys, "rank", "__n"]).drop("__n")


def count_mismatches(raw: DataFrame, aligned: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_raw, n_aligned of the keys of raw whose numbers of intervals differ."""
    both = raw.select(*keys, F.lit(1).alias("r"), F.lit(0).alias("a")).unionByName(aligned.select(*keys, F.lit(0).alias("r"), F.lit(1).alias("a")))
    got = both.groupBy(*keys).agg(F.sum("r").alias("n_raw"), F.sum("a").alias("n_aligned"))
    return got.filter("n_raw > 0 and n_raw <> n_aligned")


def stretch(pairs: DataFrame, limit: float = 1.5, longest: float | None = None) -> DataFrame:
    """pairs with ratio (aligned over raw length, raw being 0.1 at least) and flagged: above the limit, or,
    where longest is given, aligned to more than that."""
    long = F.col("aligned_end") - F.col("aligned_start")
    out = pairs.withColumn("ratio", long / F.greatest(F.col("end_sec") - F.col("start_sec"), F.lit(0.1)))
    return out.withColumn("flagged", (F.col("ratio") > limit) | (long > longest if longest is not None else F.lit(False)))


def local_pace(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Between consecutive intervals: aligned gap over raw gap, flagged above 2 or below a half; pairs
    without a raw gap are left out."""
    w = Window.partitionBy(*keys).orderBy("start_sec", "rank")
    raw, own = F.col("start_sec") - F.lag("start_sec").over(w), F.col("aligned_start") - F.lag("aligned_start").over(w)
    got = pairs.withColumns({"raw_gap": raw, "aligned_gap": own}).filter("raw_gap > 0")
    pace = F.col("aligned_gap") / F.col("raw_gap")
    return got.withColumn("pace", pace).withColumn("flagged", (F.col("pace") > 2.0) | (F.col("pace") < 0.5))


def piecewise(times: DataFrame, anchors: DataFrame, keys: list[str], t: str, out: str) -> DataFrame:
    """times with t mapped through the anchors (keys, at, to): linear between two, constant outside;
    where segments meet the earlier one counts.

    Anchors of a key become one sorted array: the lookup is a projection behind an equal join."""
    lines = anchors.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("at", "to"))).alias("__anchors"))
    met = times.join(lines, keys)
    n, x = F.size("__anchors"), F.col(t)
    first, last = F.element_at("__anchors", 1), F.element_at("__anchors", -1)
    segments = F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda i: F.struct(F.get("__anchors", i).alias("a"), F.get("__anchors", i + 1).alias("b")))
    hit = F.get(F.filter(segments, lambda s: s["b"].isNotNull() & x.between(s["a"]["at"], s["b"]["at"])), F.lit(0))
    met = met.withColumn("__hit", hit)
    a, b = F.col("__hit.a"), F.col("__hit.b")
    line = F.when(b["at"] == a["at"], a["to"]).otherwise(a["to"] + (x - a["at"]) / (b["at"] - a["at"]) * (b["to"] - a["to"]))
    value = F.when(F.col("__hit").isNotNull(), line).when(x < first["at"], first["to"]).otherwise(last["to"])
    return met.withColumn(out, value).drop("__anchors", "__hit")
