"""Operator 1: reshard by minimum-cost flow.

Rows lie in old shards. Each old shard is cut into blocks by a hash of the row; from the blocks'
sizes and the new shards' capacities a minimum-cost flow says how many bytes go from which old
to which new shard so that the fewest bytes move, whole blocks are dealt out to meet it, and the
files of the shards that change are written anew. Shard i keeps its place for old and new alike.

Law "bytes": all new shards have nearly the same size. A row above 1 / LARGE of a shard's mean
size is placed by itself (there are fewer than LARGE * n_new of them, whatever the input).

What the driver holds: one row for each block (n_old * BLOCKS at most) and each large row.

Defined cases: a null text counts as no bytes; rows alike in id and text are rows of their own;
an empty table gives an empty result; columns of the input stay as they are, but for those named
as a column that is added, which give way to it.
"""

from __future__ import annotations

import heapq
import uuid
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small_table

ROW_BYTES = 16
N_OLD, N_NEW = 32, 40
BLOCKS = 1024
LARGE = 64


def row_size(text: Column) -> Column:
    """UTF-8 bytes of the text and 16 for the row."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")


def cheapest_flow(excess: list[int], arcs: list[tuple[int, int, float]]) -> dict[tuple[int, int], int]:
    """Amounts (u, v) on arcs (u, v, cost), cost >= 0, that bring what each node has in excess (above 0)
    to nodes that have room (below 0) at the least total cost; there must be room for all of it.

    Primal-dual: a search from all nodes with excess gives the cost of the cheapest way to room, and
    every way of that cost is filled before the next search. So there is about one search for each
    different cost of a way, however many nodes there are."""
    left, most = list(excess), sum(e for e in excess if e > 0)
    out: list[list[int]] = [[] for _ in left]
    to, price, room = [], [], []
    for u, v, c in arcs:  # arc k is edge 2 k, and edge 2 k + 1 the way back
        for x, y, k, r in ((u, v, c, most), (v, u, -c, 0)):
            out[x].append(len(to))
            to.append(y)
            price.append(k)
            room.append(r)
    pot = [0.0] * len(left)

    def way(v: int) -> list[int] | None:
        """Edges without reduced cost from v to room, by depth first search."""
        path: list[int] = []
        seen[v] = True
        while left[v] >= 0:
            while tried[v] < len(out[v]):
                e = out[v][tried[v]]
                if room[e] and not seen[to[e]] and abs(price[e] + pot[v] - pot[to[e]]) < 1e-9:
                    break
                tried[v] += 1
            if tried[v] < len(out[v]):
                path.append(e)
                v = to[e]
                seen[v] = True
            elif path:
                v = to[path.pop() ^ 1]
                tried[v] += 1
            else:
                return None
        for e in path:
            seen[to[e]] = seen[to[e ^ 1]] = False
        return path

    while any(e > 0 for e in left):
        far = [0.0 if e > 0 else float("inf") for e in left]
        heap = [(0.0, v) for v, e in enumerate(left) if e > 0]
        while heap:
            d, v = heapq.heappop(heap)
            if d > far[v]:
                continue
            for e in out[v]:
                if room[e]:
                    u, there = to[e], d + max(0.0, price[e] + pot[v] - pot[to[e]])
                    if there < far[u]:
                        far[u] = there
                        heapq.heappush(heap, (there, u))
        nearest = min((far[v] for v, e in enumerate(left) if e < 0), default=float("inf"))
        if nearest == float("inf"):
            raise ValueError("there is no room for all of it")
        pot = [p + min(d, nearest) for p, d in zip(pot, far, strict=True)]
        tried, seen = [0] * len(left), [False] * len(left)
        for s in [v for v, e in enumerate(left) if e > 0]:
            while left[s] > 0 and (path := way(s)):
                end = to[path[-1]]
                n = min(left[s], -left[end], *(room[e] for e in path))
                for e in path:
                    room[e] -= n
                    room[e ^ 1] += n
                left[s] -= n
                left[end] += n
    return {(u, v): room[2 * k + 1] for k, (u, v, _) in enumerate(arcs) if room[2 * k + 1]}


def min_cost_flow(supply: list[int], demand: list[int], cost) -> dict[tuple[int, int], int]:
    """Amounts (i, j) that bring every supply to the demands at the least total cost.

    sum(supply) <= sum(demand); cost(i, j) >= 0."""
    n = len(supply)
    flow = cheapest_flow([*supply, *(-d for d in demand)], [(i, n + j, cost(i, j)) for i in range(n) for j in range(len(demand))])
    return {(i, j - n): v for (i, j), v in flow.items()}


def transfers(olds: list[int], supply: list[int], demand: list[int]) -> dict[tuple[int, int], int]:
    """min_cost_flow() where bytes that stay cost nothing and those that move cost 1 each: (old, new) -> bytes.

    As all moves cost alike they run through one node between, so that there are as many arcs as
    shards and not as pairs of them. What goes in there and what comes out are matched in order;
    none of it comes back to where it was, as staying would have cost less."""
    n, m = len(olds), len(demand)
    between = n + m
    arcs = [(i, n + old, 0.0) for i, old in enumerate(olds) if 0 <= old < m]
    arcs += [(i, between, 1.0) for i in range(n)] + [(between, n + j, 0.0) for j in range(m)]
    flow = cheapest_flow([*supply, *(-d for d in demand), 0], arcs)
    out = {(olds[u], v - n): x for (u, v), x in flow.items() if between not in (u, v)}
    to = iter(sorted((v - n, x) for (u, v), x in flow.items() if u == between))
    j, room = None, 0
    for u, x in sorted((u, x) for (u, v), x in flow.items() if v == between):
        while x:
            if not room:
                j, room = next(to)
            part = min(x, room)
            out[olds[u], j] = part
            x, room = x - part, room - part
    return out


def levelled(loads: list[int], amount: int) -> list[int]:
    """How much of amount each of these shards takes so that all end as level as can be."""
    order = sorted(loads)
    level, total = 0, 0
    for k, x in enumerate(order):
        total += x
        level = -(-(amount + total) // (k + 1))
        if k + 1 == len(order) or level <= order[k + 1]:
            break
    room = [max(0, level - x) for x in loads]
    spare = sum(room) - amount
    for j in range(len(room)):
        cut = min(spare, room[j], 1) if room[j] else 0
        room[j] -= cut
        spare -= cut
    return room


def plan_bytes(blocks: list[tuple[int, int, int, int]], large: list[tuple[int, int, int]], n_new: int) -> dict[tuple[int, int], list[dict]]:
    """blocks: (old, block, bytes, rows) without the large rows; large: (old, block, size), those of
    a block in the order of its rows. Gives for each block its pieces: from this row on
    (numbered from 1, large rows first), shard and slot."""
    total = sum(b[2] for b in blocks) + sum(x[2] for x in large)
    mean = total / n_new
    load, count = [0] * n_new, [0] * n_new
    big: dict[int, int] = {}
    heap = [(0, j) for j in range(n_new)]
    for k in sorted(range(len(large)), key=lambda k: -large[k][2]):
        old, _, size = large[k]
        j = old
        if old >= n_new or load[old] + size > mean:
            while heap[0][0] != load[heap[0][1]]:  # this one has grown meanwhile
                heapq.heapreplace(heap, (load[heap[0][1]], heap[0][1]))
            j = heap[0][1]
        load[j] += size
        big[k] = j
    olds = sorted({b[0] for b in blocks})
    place = {o: i for i, o in enumerate(olds)}
    supply = [0] * len(olds)
    for b in blocks:
        supply[place[b[0]]] += b[2]
    flow = transfers(olds, supply, levelled(load, sum(supply)))
    pieces: dict[tuple[int, int], list[dict]] = defaultdict(list)
    for k, (old, block, _) in enumerate(large):
        own = pieces[old, block]
        own.append({"from": len(own) + 1, "shard": big[k], "slot": count[big[k]]})
        count[big[k]] += 1
    want: dict[int, list[list[int]]] = defaultdict(list)
    for (old, j), n in sorted(flow.items()):
        want[old].append([j, n])
    for old in want:
        want[old].sort(key=lambda x: (x[0] != old, x[0]))
    for old, block, size, n in sorted(blocks):
        own = pieces[old, block]
        at, todo = len(own) + 1, want[old]
        while n:
            # A block goes to the shard where its middle falls; one that is large against a
            # shard (rows alike fall into one block) is cut by rows.
            while len(todo) > 1 and todo[0][1] <= min(size / 2, mean / (2 * LARGE)):
                todo[1][1] += todo[0][1]
                todo.pop(0)
            j, room = todo[0]
            k = n
            if len(todo) > 1 and size > room + mean / (2 * LARGE):
                k = min(n, max(1, round(n * room / size)))
            part = size * k // n
            own.append({"from": at, "shard": j, "slot": count[j]})
            count[j] += k
            todo[0][1] -= part
            at, n, size = at + k, n - k, size - part
    return pieces


def reshard(df: DataFrame, old: Column, *, id_col: str = "doc_id", text_col: str = "text", n_new: int = N_NEW, n_blocks: int = BLOCKS) -> DataFrame:
    """df with size, law ("bytes"), old_shard, shard, slot (gapless from 0 in each shard), moved."""
    spark: SparkSession = df.sparkSession
    own = ["size", "law", "old_shard", "shard", "slot", "moved"]
    # The old layout is an expression over df's own names; everything after works under others.
    names = {c: f"__input_{k}" for k, c in enumerate(df.columns)}
    back = [F.col(names[c]).alias(c) for c in df.columns if c not in own]
    text, ident = F.col(text_col), F.col(id_col)
    block = F.pmod(F.xxhash64(ident, text), F.lit(n_blocks)).cast("int")
    at = df.select(*[F.col(c).alias(n) for c, n in names.items()], row_size(text).alias("size"), old.cast("int").alias("old_shard"), block.alias("__block"), F.xxhash64(text).alias("__hash"), ident.alias("__id"))
    sums = at.groupBy("old_shard", "__block").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.max("size").alias("most")).collect()
    least = sum(r["bytes"] for r in sums) // (n_new * LARGE)
    first = [F.desc("size"), F.asc("__id"), F.asc("__hash")]
    large: list[tuple[int, int, int]] = []
    if any(r["most"] > least for r in sums):
        found = at.filter(F.col("size") > least).select("old_shard", "__block", "size").collect()
        large = sorted(((r[0], r[1], r[2]) for r in found), key=lambda x: (x[0], x[1], -x[2]))
    less: dict[tuple[int, int], list[int]] = defaultdict(lambda: [0, 0])
    for o, b, size in large:
        less[o, b][0] += size
        less[o, b][1] += 1
    rest = [(r["old_shard"], r["__block"], r["bytes"] - less[r["old_shard"], r["__block"]][0], r["n"] - less[r["old_shard"], r["__block"]][1]) for r in sums]
    pieces = plan_bytes(rest, large, n_new)
    table = small_table(spark, [{"old_shard": o, "__block": b, "__pieces": p} for (o, b), p in pieces.items()], "old_shard int, __block int, __pieces array<struct<from:bigint,shard:int,slot:bigint>>")
    # Large rows come first in their block, in the order in which the driver has them.
    rank = F.row_number().over(Window.partitionBy("old_shard", "__block").orderBy(F.when(F.col("size") > least, 0).otherwise(1), F.when(F.col("size") > least, -F.col("size")).otherwise(0), *first[1:]))
    # At most n_old * n_blocks rows: a size that the parameters bound.
    met = at.withColumn("__rank", rank).join(F.broadcast(table), ["old_shard", "__block"])
    met = met.withColumn("__piece", F.element_at(F.filter("__pieces", lambda p: p["from"] <= F.col("__rank")), -1))
    return met.select(
        *back,
        "size",
        F.lit("bytes").alias("law"),
        "old_shard",
        F.col("__piece.shard").alias("shard"),
        (F.col("__piece.slot") + F.col("__rank") - F.col("__piece.from")).alias("slot"),
        (F.col("__piece.shard") != F.col("old_shard")).alias("moved"),
    )


def rewrite(resharded: DataFrame, path: str, every: bool = False) -> list[int]:
    """Write the shards that rows have left or joined, as path/shard=N/; returns their numbers.

    Shards whose rows stay the same keep the files that they have there; every=True is for a path
    without any, and writes those too. Changed shards are written to a folder of their own under
    path and swapped in once all are there, so that resharded may read from path; a shard without
    rows left is gone afterwards. A journal tells what is being swapped: recover(), read() and the next rewrite()
    finish what was broken off. old_shard and moved in a shard's files are those of its last
    rewrite."""
    spark = resharded.sparkSession
    moved = resharded.filter("moved")
    changed = moved.select(F.explode(F.array("shard", "old_shard")).alias("s")).distinct()
    known = sorted(r["s"] for r in changed.collect())  # a row for each shard
    path = path.rstrip("/")
    made = f"{path}/_made-{uuid.uuid4().hex}"
    recover(spark, path)
    (resharded if every else resharded.filter(F.col("shard").isin(known))).write.partitionBy("shard").parquet(f"{made}/new")
    fs, at = _files(spark, path)
    fs.mkdirs(at(f"{made}/old"))
    fresh = {x.getPath().getName() for x in fs.listStatus(at(f"{made}/new")) if x.isDirectory()}
    # From the moment that the journal has its name, the new shards are the layout: what follows only moves folders.
    spark.createDataFrame([(made, sorted(fresh | {f"shard={s}" for s in known}))], "made string, shards array<string>").coalesce(1).write.json(f"{made}/journal")
    _rename(fs, at, f"{made}/journal", f"{path}/{JOURNAL}")
    recover(spark, path)
    return known


#: The folder, among the shards, that says which of them are being swapped, and from where.
JOURNAL = "_journal"


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark._jsc.hadoopConfiguration()), at


def _rename(fs, at, a: str, b: str) -> None:
    if not fs.rename(at(a), at(b)):
        raise OSError(f"{a} can't be renamed to {b}")


def recover(spark: SparkSession, path: str) -> bool:
    """Finish a rewrite that was broken off; tells whether there was one. A layout has one writer at a time.

    A shard's new folder is moved in once its old one has moved out, so whatever was done before is seen from what
    is where, and doing this again, or breaking off here too, does no harm. A rewrite that hadn't come as far as its
    journal has changed nothing, and its folder goes."""
    path = path.rstrip("/")
    fs, at = _files(spark, path)
    there = lambda p: fs.exists(at(p))
    if not there(path):
        return False
    told = spark.read.schema("made string, shards array<string>").json(f"{path}/{JOURNAL}").first() if there(f"{path}/{JOURNAL}") else None
    if told:
        made = told["made"]
        for name in told["shards"]:
            new, old, own = f"{made}/new/{name}", f"{made}/old/{name}", f"{path}/{name}"
            fresh = there(new)
            if there(own) and not there(old) and (fresh or not there(f"{made}/done/{name}")):
                _rename(fs, at, own, old)
            if fresh:
                fs.mkdirs(at(f"{made}/done/{name}"))  # a shard without an old folder looks the same before and after
                _rename(fs, at, new, own)
        fs.delete(at(f"{path}/{JOURNAL}"), True)
    for x in fs.listStatus(at(path)):
        if x.getPath().getName().startswith("_made-"):
            fs.delete(x.getPath(), True)
    return told is not None


def read(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """The layout, after a rewrite that was broken off, if any, is finished."""
    recover(spark, path)
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def hashed(col: Column, n: int = N_OLD) -> Column:
    """The old layout of the queries: sources hashed over n shards."""
    return F.pmod(F.xxhash64(col), F.lit(n)).cast("int")
