"""Operator 11: approximate nearest neighbours by learned partitions.

A bounded sample of the vectors gives a graph of nearest neighbours by inner product. The graph is cut
into parts of equal size by bisection (the order of its slowest eigenvector, then swaps that leave fewer
edges cut), and a small classifier (one hidden layer) learns which parts hold a vector's neighbours.
Every vector of the table is filed under its most probable part; a query goes to its most probable parts,
whose vectors are ranked by the exact inner product.

How many parts a query goes to is measured: for CALIBRATION vectors the true neighbours in the whole table are
found, and the number is the least that holds TARGET of them. A query also goes on to further
parts until those it has been to hold as many rows as it asks for.

Equal vectors are searched once: a vector stands for its rows with the k + 1 least ids, as more can't
be among a query's k nearest. Parts meet queries in tiles of TILE vectors and QUERY_TILE queries, so that
neither a part that holds a third of all vectors nor one that every query goes to makes a large task.

On the driver: the sample (SAMPLE vectors at most), the calibration vectors, the model, and a row for each part (MAX_PARTS
at most). All are bounded, whatever the table. Beyond MAX_PARTS times PART_ROWS rows parts grow with the table.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do
those whose length isn't the table's most frequent one (of equally frequent ones, the larger); rows alike in id and vector count once; rows with
a null id are no queries and come last among ties; with fewer rows than asked for, all are returned; an
empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ship, stage

ship(__name__)

K = 20
SAMPLE = 8192
PART_ROWS = 1024
MAX_PARTS = 256
GRAPH = 16
HIDDEN = 128
CALIBRATION = 256
TARGET = 0.95
TILE, QUERY_TILE = 4096, 1024
SEED = 11


# --- fitting on the sample ---------------------------------------------------------------------
def neighbours(x: np.ndarray, k: int, block: int = 1024) -> np.ndarray:
    """For each row the k others of largest inner product."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), dtype=np.int64)
    for i in range(0, len(x), block):
        s = x[i : i + block] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        out[i : i + block] = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else 0
    return out


def _halves(x: np.ndarray, u: np.ndarray, v: np.ndarray, n_left: int, steps: int = 40, rounds: int = 12) -> np.ndarray:
    """True for the n_left rows of x that are cut off; u, v: edges, both ways."""
    n = len(x)
    degree = np.maximum(np.bincount(u, minlength=n), 1)
    c = x - x.mean(axis=0)
    f = c @ np.linalg.svd(c[: min(n, 2048)], full_matrices=False)[2][0]
    for _ in range(steps):  # a lazy walk leaves the slowest eigenvector
        f = (f + np.bincount(u, f[v], n) / degree) / 2
        f -= (f * degree).sum() / degree.sum()
        f /= max(np.linalg.norm(f), 1e-30)
    left = np.zeros(n, dtype=bool)
    left[np.argsort(f, kind="stable")[:n_left]] = True
    best, cut = left.copy(), (left[u] != left[v]).sum()
    for _ in range(rounds):
        other = np.bincount(u, left[u] != left[v], n)
        gain = 2 * other - np.bincount(u, minlength=n)
        a, b = (side[np.argsort(-gain[side], kind="stable")] for side in (np.flatnonzero(left), np.flatnonzero(~left)))
        m = min(len(a), len(b))
        n_swap = int((gain[a[:m]] + gain[b[:m]] > 0).sum() + 1) // 2
        if not n_swap:
            break
        left[a[:n_swap]], left[b[:n_swap]] = False, True
        now = (left[u] != left[v]).sum()
        if now >= cut:
            break
        best, cut = left.copy(), now
    return best


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int) -> np.ndarray:
    """The part of each row: sizes differ by rounding alone, few edges of the neighbour graph are cut."""
    label = np.zeros(len(x), dtype=np.int64)
    u = np.concatenate([np.repeat(np.arange(len(x)), near.shape[1]), near.ravel()])
    v = np.concatenate([near.ravel(), np.repeat(np.arange(len(x)), near.shape[1])])
    todo = [(np.arange(len(x)), u, v, 0, parts)]
    while todo:
        rows, u, v, first, n = todo.pop()
        if n == 1:
            label[rows] = first
            continue
        left = _halves(x[rows], u, v, len(rows) * (n // 2) // n)
        place = np.empty(len(rows), dtype=np.int64)
        for side, begin, many in ((left, first, n // 2), (~left, first + n // 2, n - n // 2)):
            inside = side[u] & side[v]
            place[side] = np.arange(side.sum())
            todo.append((rows[side], place[u[inside]], place[v[inside]], begin, many))
    return label


def train(x: np.ndarray, wanted: np.ndarray, epochs: int = 30, rate: float = 3e-3, decay: float = 1e-3) -> list[np.ndarray]:
    """Weights of a classifier with one hidden layer, fitted to the shares of parts in `wanted` by Adam."""
    rng = np.random.Generator(np.random.PCG64(SEED))
    d, parts = x.shape[1], wanted.shape[1]
    w = [rng.normal(0, (2 / d) ** 0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, (1 / HIDDEN) ** 0.5, (HIDDEN, parts)), np.zeros(parts)]
    m, s, t, batch = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0, 256
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), batch):
            rows = order[i : i + batch]
            h = np.maximum(x[rows] @ w[0] + w[1], 0)
            z = h @ w[2] + w[3]
            z -= z.max(axis=1, keepdims=True)
            e = np.exp(z)
            dz = (e / e.sum(axis=1, keepdims=True) - wanted[rows]) / len(rows)
            dh = dz @ w[2].T * (h > 0)
            grads = [x[rows].T @ dh, dh.sum(axis=0), h.T @ dz, dz.sum(axis=0)]
            t += 1
            now = rate * (1 - epoch / epochs)
            for k, g in enumerate(grads):
                m[k] += 0.1 * (g - m[k])
                s[k] += 0.001 * (g * g - s[k])
                step = m[k] / (1 - 0.9**t) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
                w[k] -= now * (step + (decay * w[k] if k in (0, 2) else 0))
    return w


def fit(x: np.ndarray, parts: int) -> dict:
    """The model for a sample: mean and scale of its vectors, weights of the classifier."""
    scale = float(np.sqrt((x * x).sum(axis=1).mean() / x.shape[1])) or 1.0
    if parts <= 1 or len(x) < 2 * parts:
        return {"scale": scale, "weights": None, "parts": 1}
    near = neighbours(x, GRAPH)
    label = balanced_parts(x, near, parts)
    wanted = np.zeros((len(x), parts))
    wanted[np.arange(len(x)), label] += 1
    for k in range(near.shape[1]):
        np.add.at(wanted, (np.arange(len(x)), label[near[:, k]]), 1)
    return {"scale": scale, "weights": train(x / scale, wanted / wanted.sum(axis=1, keepdims=True)), "parts": parts}


def scores(model: dict, x: np.ndarray) -> np.ndarray:
    """A score of each part for each row: larger is more probable."""
    if model["weights"] is None:
        return np.zeros((len(x), 1))
    w = model["weights"]
    return np.maximum(x / model["scale"] @ w[0] + w[1], 0) @ w[2] + w[3]


# --- the table ---------------------------------------------------------------------------------
def _matrix(column: pa.Array, dtype: str) -> np.ndarray:
    """Rows of a column of vectors' bytes, in double precision."""
    joined = b"".join(x.as_py() for x in column)
    return np.frombuffer(joined, dtype=dtype).reshape(len(column), -1).astype(float)


def _parser(dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, values, sizes = [], [], []
            for key, x in zip(batch.column(0), batch.column(1), strict=True):
                if not x.is_valid or not len(x.values) or x.values.null_count:
                    continue
                v = x.values.to_numpy(zero_copy_only=False).astype(dtype) + 0.0  # one kind of zero
                if np.isfinite(v).all() and v.any():
                    ids.append(key.as_py())
                    values.append(v.astype(dtype).tobytes())
                    sizes.append(len(v))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(values, pa.binary()), pa.array(sizes, pa.int32())], names=["id", "v", "size"])

    return run


def parsed(df: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, str]:
    """id and v (bytes) of the vectors that take part, without repeated rows; the components' type."""
    element = df.schema[vec_col].dataType.elementType.simpleString()
    dtype = "<f4" if element == "float" else "<f8"
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>" if dtype == "<f4" else "array<double>").alias("x"))
    rows = rows.mapInArrow(_parser(dtype), "id bigint, v binary, size int")
    top = rows.groupBy("size").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    if top is None:
        return rows.select("id", "v"), dtype
    return rows.filter(F.col("size") == top["size"]).select("id", "v").distinct(), dtype


def _filer(model, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                part = scores(model.value, _matrix(batch.column("v"), dtype)).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part, pa.int32())], names=[*batch.schema.names, "part"])

    return run


def _router(model, dtype: str, probes: int, rows_of: np.ndarray, least: int):
    """Each query's most probable parts: `probes`, and more until they hold `least` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            order = np.argsort(-scores(model.value, _matrix(batch.column("v"), dtype)), axis=1, kind="stable")
            enough = (np.cumsum(rows_of[order], axis=1) < least).sum(axis=1) + 1
            parts = [o[: max(probes, int(n))].tolist() for o, n in zip(order, enough, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts, pa.list_(pa.int32()))], names=[*batch.schema.names, "parts"])

    return run


def _top(q: np.ndarray, c: np.ndarray, ids: np.ndarray, none: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query row, candidate row and score of each query's k nearest candidates, ties to the smaller id.

    A fast product tells which candidates can be among them, all that are within its rounding error of the
    k-th; their scores are summed anew in one fixed order, so that equal vectors score alike."""
    k = min(k, len(c))
    s = q @ c.T
    slack = 4e-16 * c.shape[1] * np.linalg.norm(q, axis=1) * np.linalg.norm(c, axis=1).max()
    may = s >= (np.partition(s, len(c) - k, axis=1)[:, len(c) - k] - 2 * slack)[:, None]
    ends = np.cumsum(may.sum(axis=1))
    found, start = [], 0
    while start < len(q):  # rows whose candidates fill a block; with many ties a row is a block
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + 100_000, side="right")))
        rows, cols = np.nonzero(may[start:stop])
        rows += start
        exact = (q[rows] * c[cols]).sum(axis=1) + 0.0
        order = np.lexsort((ids[cols], none[cols], -exact, rows))
        rows, cols, exact = rows[order], cols[order], exact[order]
        first = np.searchsorted(rows, rows)
        keep = np.arange(len(rows)) - first < k
        found.append((rows[keep], cols[keep], exact[keep]))
        start = stop
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


NEAR = pa.struct([("neg", pa.float64()), ("none", pa.bool_()), ("id", pa.int64()), ("same", pa.bool_())])


def _searcher(k: int, dtype: str):
    kind = pa.schema([("qno", pa.int64()), ("near", pa.list_(NEAR))])

    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        candidates, queries = candidates.combine_chunks(), queries.combine_chunks()
        if not candidates.num_rows or not queries.num_rows:
            return kind.empty_table()
        vectors = candidates.column("v").combine_chunks() if isinstance(candidates.column("v"), pa.ChunkedArray) else candidates.column("v")
        c, q = (_matrix(t.column("v"), dtype) for t in (candidates, queries))
        raw = candidates.column("id").to_pandas()
        none = raw.isna().to_numpy()
        ids = raw.fillna(0).astype("int64").to_numpy() if none.any() else candidates.column("id").to_numpy()
        rows, cols, exact = _top(q, c, ids, none, k)
        same = np.fromiter((vectors[int(j)].as_py() == queries.column("v")[int(i)].as_py() if abs(exact[n] - own) <= 1e-9 * abs(own) else False for n, (i, j, own) in enumerate(zip(rows, cols, (q * q).sum(axis=1)[rows], strict=True))), bool, len(rows))
        near = pa.StructArray.from_arrays([pa.array(-exact), pa.array(none[cols]), pa.array(ids[cols], mask=none[cols]), pa.array(same)], fields=list(NEAR))
        offsets = np.searchsorted(rows, np.arange(len(q) + 1))
        return pa.table([queries.column("qno"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), near)], schema=kind)

    return run


def _nearest_parts(queries: np.ndarray, k: int, dtype: str):
    """For calibration: the k best candidates of a task for each query with their parts, but equal vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, part = np.full((len(queries), k), -np.inf), np.full((len(queries), k), -1)
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                some = batch.slice(start, 4096)
                c = _matrix(some.column("v"), dtype)
                s = queries @ c.T
                s[np.abs(s - (queries * queries).sum(axis=1)[:, None]) < 1e-9 * np.abs(s)] = -np.inf  # itself, and its copies
                s, p = np.concatenate([best, s], axis=1), np.concatenate([part, np.broadcast_to(some.column("part").to_numpy(), s.shape)], axis=1)
                top = np.argpartition(-s, k - 1, axis=1)[:, :k]
                best, part = np.take_along_axis(s, top, axis=1), np.take_along_axis(p, top, axis=1)
        row = np.repeat(np.arange(len(queries)), k)
        there = part.ravel() >= 0
        yield pa.RecordBatch.from_arrays([pa.array(row[there], pa.int32()), pa.array(best.ravel()[there]), pa.array(part.ravel()[there], pa.int32())], names=["c", "score", "part"])

    return run


def calibrated(filed: DataFrame, queries: np.ndarray, model: dict, dtype: str, k: int = K, target: float = TARGET) -> tuple[int, float]:
    """How many parts hold `target` of the true neighbours of these vectors in the whole table, and which
    share that is. The driver gets k rows for each vector."""
    found = filed.select("v", "part").mapInArrow(_nearest_parts(queries, k, dtype), "c int, score double, part int")
    rank = F.row_number().over(Window.partitionBy("c").orderBy(F.desc("score")))
    rows = found.withColumn("at", rank).filter(F.col("at") <= k).select("c", "part").collect()
    order = np.argsort(-scores(model, queries), axis=1, kind="stable")
    place = np.argsort(order, axis=1)
    at = np.bincount([place[r["c"], r["part"]] for r in rows], minlength=model["parts"])
    held = np.cumsum(at) / max(1, at.sum())
    probes = int((held < target).sum()) + 1
    return min(probes, model["parts"]), float(held[min(probes, model["parts"]) - 1])


def search(df: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, parts: int | None = None, probes: int | None = None, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id (of id_col's name), score: for each row for whose id is_query (a function of a column)
    holds, the k nearest other rows. parts and probes: as many parts, and as many of them to look into,
    in place of those that follow from the table's size and the calibration."""
    spark = df.sparkSession
    rows, dtype = parsed(df, id_col, vec_col)
    rows = stage(rows, "vectors")
    # More than k + 1 copies of a vector can't be among a query's k nearest, itself left out.
    copy = F.row_number().over(Window.partitionBy("v").orderBy(F.asc_nulls_last("id")))
    kept = stage(rows.withColumn("copy", copy).filter(F.col("copy") <= k + 1), "kept")
    first = kept.filter("copy = 1")
    n = kept.count()
    parts = max(1, min(MAX_PARTS, n // PART_ROWS)) if parts is None else parts
    sample = [np.frombuffer(r["v"], dtype=dtype).astype(float) for r in first.select("v").orderBy(F.xxhash64("v"), "v").limit(SAMPLE + CALIBRATION).collect()]
    held_out = np.array(sample[-CALIBRATION:]) if len(sample) >= 4 * CALIBRATION else np.array(sample)
    learnt = np.array(sample[:-CALIBRATION]) if len(sample) >= 4 * CALIBRATION else np.array(sample)
    if not sample:
        return spark.createDataFrame([], f"query_id bigint, rank int, {id_col} bigint, score double")
    model = fit(learnt, parts)
    told = spark.sparkContext.broadcast(model)
    filed = stage(kept.select("id", "v").mapInArrow(_filer(told, dtype), "id bigint, v binary, part int"), "filed")
    if probes is None:
        probes = calibrated(filed, held_out, model, dtype, k, target)[0] if model["parts"] > 1 else 1
    asked = rows.filter(is_query(F.col("id")))
    count = {r["part"]: r["n"] for r in filed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows_of = np.array([count.get(p, 0) for p in range(model["parts"])])
    routed = asked.select("v").distinct().withColumn("qno", F.monotonically_increasing_id())
    routed = stage(routed.mapInArrow(_router(told, dtype, probes, rows_of, k + 1), "v binary, qno bigint, parts array<int>"), "routed")
    met = {r["part"]: r["n"] for r in routed.select(F.explode("parts").alias("part")).groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    tiles = [(p, -(-count[p] // TILE), -(-met[p] // QUERY_TILE)) for p in sorted(count) if p in met]
    tiles = F.broadcast(spark.createDataFrame(tiles, "part int, n_tiles int, n_query_tiles int"))
    dealt = lambda n: F.pmod(F.xxhash64("v"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cell = ["part", "tile", "query_tile"]
    candidates = filed.join(tiles, "part").select("part", dealt("n_tiles").alias("tile"), each("n_query_tiles").alias("query_tile"), "id", "v")
    queries = routed.select("qno", "v", F.explode("parts").alias("part")).join(tiles, "part").select("part", each("n_tiles").alias("tile"), dealt("n_query_tiles").alias("query_tile"), "qno", "v")
    near = candidates.groupBy(*cell).cogroup(queries.groupBy(*cell)).applyInArrow(_searcher(k + 1, dtype), "qno bigint, near array<struct<neg:double,none:boolean,id:bigint,same:boolean>>")
    best = near.groupBy("qno").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near"))
    found = routed.select("qno", "v").join(best, "qno").select("v", "near")
    out = asked.select("v", F.col("id").alias("query_id")).join(found, "v")
    # Of equal vectors only the least ids are at hand, which need not hold the query's own.
    others = F.slice(F.filter("near", lambda x: ~(x["same"] & x["id"].eqNullSafe(F.col("query_id")))), 1, k)
    out = out.select("query_id", F.posexplode(others).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias(id_col), (-F.col("x.neg")).alias("score"))


def report(df: DataFrame) -> DataFrame:
    """The nearest rows of every row whose id 20 divides."""
    return search(df, lambda c: F.pmod(c, F.lit(20)) == 0)
