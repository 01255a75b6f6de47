"""Operator 7: N-gram Jaccard join by a MinHash LSH forest with exact verification.

Each text is the set of its runs of SHINGLE words (lower case letters and digits; a text of fewer
words is one run). Texts with equal sets are one class. A forest of TREES prefix tries over sorted
labels holds DEPTH levels for each class. All tries are climbed together, from the leaves: first
meet the classes below a common node at DEPTH. The links found say, by their similarities, how many
links such prefixes miss, and to which length prefixes must be shortened so that the share found
reaches the target; there the branches of the nodes meet, and the links found by then are asked
again, until the share is reached, and not beyond the depth at which a pair just at the threshold
would reach it. A pair meets once, in the round in which its longest common prefix is reached, and
is verified there on the whole sets.

A node's classes are cut into tiles of TILE x TILE classes at most (fewer if sets are large). Labels
come to a tile first; sets follow only for classes that have a pair to verify there. Only counts
and a spanning star come out of it, so that the pairs of a large group are neither emitted nor
gathered in one place.

Defined cases: a null text is a class of its own row's id; texts without words are copies if
they are equal, and have no links; rows alike in id and text are copies; null ids come last where
the least id names a class; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import apart, arrow_batches, drop, ship, stage
from .components import components

ship(__name__)

SHINGLE = 5
THRESHOLD = (4, 5)
TREES, DEPTH, LEVEL_BITS = 24, 8, 8
TARGET_RECALL = 0.9999
#: Classes, and bytes of their sets, on a side of a tile.
TILE, TILE_BYTES = 1024, 16 << 20
#: Bands of similarity, from the threshold to 1, in which links are counted.
BANDS = 40
WORD_CACHE = 400_000

_WORD = re.compile(r"[^\W_]+")
_M64 = (1 << 64) - 1


def prefix_depth(threshold: float, target: float, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix at which a pair at the threshold meets with the target probability."""
    for r in range(depth, 0, -1):
        if 1 - (1 - threshold**r) ** trees >= target:
            return r
    return 1


def estimated_recall(bands: list[int], depth: int, threshold: float, trees: int = TREES, at: int | None = None) -> float:
    """The share of all links that prefixes of this depth find, from those that they found: a link of
    similarity s is found with the chance p(s), so that each one found stands for 1 / p(s). A band's
    similarity is its lower end. Without links nothing can be told: 0. at: the share that prefixes
    of that depth would find instead."""
    seen = lambda s, r: 1 - (1 - s**r) ** trees
    every = [(n / seen(s, depth), s) for n, s in ((n, threshold + (1 - threshold) * k / BANDS) for k, n in enumerate(bands))]
    total = sum(n for n, _ in every)
    return sum(n * seen(s, at or depth) for n, s in every) / total if total else 0.0


def _prefix(label: str, depth: int) -> Column:
    return F.shiftrightunsigned(label, LEVEL_BITS * (DEPTH - depth))


def _odd_and_add(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(7))
    return rng.integers(0, _M64, n, dtype=np.uint64, endpoint=True) | np.uint64(1), rng.integers(0, _M64, n, dtype=np.uint64, endpoint=True)


def shingles(text: str, cache: dict) -> np.ndarray:
    """The sorted distinct hashes (64 bits) of the text's runs of words."""
    found = _WORD.findall(text.lower())
    if not found:
        return np.empty(0, dtype=np.uint64)
    try:
        ids = [cache[w] for w in found]
    except KeyError:
        if len(cache) > WORD_CACHE:
            cache.clear()
        for w in found:
            if w not in cache:
                cache[w] = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
        ids = [cache[w] for w in found]
    a = np.array(ids, dtype=np.uint64)
    n = len(a) - SHINGLE + 1
    if n < 1:
        a = np.concatenate([a, np.zeros(SHINGLE - len(a), dtype=np.uint64)])
        n = 1
    h = np.zeros(n, dtype=np.uint64)
    for k in range(SHINGLE):
        h = (h ^ a[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return np.unique(h)


def labels(s: np.ndarray, odd: np.ndarray, add: np.ndarray) -> np.ndarray:
    """One label for each tree: DEPTH MinHashes of LEVEL_BITS bits, the first one on top."""
    least = np.full(len(odd), _M64, dtype=np.uint64)
    for at in range(0, len(s), 1024):
        h = odd[:, None] * s[None, at : at + 1024]
        h += add[:, None]
        np.minimum(least, h.min(axis=1), out=least)
    least ^= least >> np.uint64(32)
    least ^= least >> np.uint64(16)
    part = (least & np.uint64((1 << LEVEL_BITS) - 1)).reshape(TREES, DEPTH)
    out = np.zeros(TREES, dtype=np.uint64)
    for k in range(DEPTH):
        out = (out << np.uint64(LEVEL_BITS)) | part[:, k]
    return out.view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    odd, add = _odd_and_add(TREES * DEPTH)
    cache: dict = {}
    for batch in batches:
        for start in range(0, batch.num_rows, 1024):
            part = batch.slice(start, 1024)
            ids, texts = part.column(0), part.column(2)
            digests, sizes, marks = [], [], []
            for i in range(part.num_rows):
                text = texts[i].as_py()
                s = shingles(text, cache) if text is not None else np.empty(0, dtype=np.uint64)
                if len(s):
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    marks.append(labels(s, odd, add))
                else:
                    own = b"text" + text.encode("utf-8", "surrogatepass") if text is not None else f"none{ids[i].as_py()}".encode()
                    digests.append(hashlib.blake2b(own, digest_size=16, key=b"no words").digest())
                    marks.append(np.empty(0, dtype=np.int64))
                sizes.append(len(s))
            two = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
            ends = np.cumsum([0] + [len(m) for m in marks]).astype(np.int32)
            flat = np.concatenate(marks) if marks else np.empty(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [ids, part.column(1), pa.array(two[:, 0]), pa.array(two[:, 1]), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                names=["id", "th", "d1", "d2", "n", "labels"],
            )


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache: dict = {}
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            sets = [shingles(x.as_py(), cache).tobytes() for x in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["c", "s"])


class _Side:
    """Classes of one side of a tile, from rows c, copies, labels and set (or its size alone)."""

    def __init__(self, rows: list):
        self.c = np.array([r[0] for r in rows], dtype=np.int64)
        self.copies = np.array([r[1] for r in rows], dtype=np.int64)
        self.labels = np.array([r[2] for r in rows], dtype=np.int64).view(np.uint64)
        self.sets = [np.frombuffer(r[3], dtype=np.uint64) for r in rows if not isinstance(r[3], int)]
        self.n = np.array([r[3] if isinstance(r[3], int) else len(r[3]) // 8 for r in rows], dtype=np.int64)


def shared_counts(a: _Side, b: _Side, wanted: np.ndarray) -> np.ndarray:
    """How many shingles the wanted pairs share, exactly; by the cheaper of two ways."""
    out = np.zeros(wanted.shape, dtype=np.int64)
    i, j = np.nonzero(wanted)
    if not len(i):
        return out
    every = np.concatenate(a.sets + (b.sets if b is not a else []))
    by_pair = float(np.minimum(a.n[i], b.n[j]).sum()) * 6e-8 + len(i) * 8e-6
    product = len(a.n) * len(b.n) * len(every) / 2e10 + len(every) * 2e-7
    if by_pair <= product:
        for x, y in zip(i, j, strict=True):
            s, t = (a.sets[x], b.sets[y]) if a.n[x] <= b.n[y] else (b.sets[y], a.sets[x])
            at = np.searchsorted(t, s)
            at[at == len(t)] = 0
            out[x, y] = np.count_nonzero(t[at] == s)
        return out
    values, place, times = np.unique(every, return_inverse=True, return_counts=True)
    row_a = np.repeat(np.arange(len(a.n)), a.n)
    column_a = place[: len(row_a)]
    row_b, column_b = (row_a, column_a) if b is a else (np.repeat(np.arange(len(b.n)), b.n), place[len(row_a) :])
    # Only shingles that two sets have matter; they are numbered anew and taken in blocks.
    number = np.cumsum(times > 1) - 1
    keep_a, keep_b = times[column_a] > 1, times[column_b] > 1
    row_a, column_a, row_b, column_b = row_a[keep_a], number[column_a[keep_a]], row_b[keep_b], number[column_b[keep_b]]
    total = np.zeros(wanted.shape, dtype=np.float64)
    for low in range(0, int((times > 1).sum()), 8192):
        x = np.zeros((len(a.n), 8192), dtype=np.float32)
        own = (column_a >= low) & (column_a < low + 8192)
        x[row_a[own], column_a[own] - low] = 1
        if b is a:
            y = x
        else:
            y = np.zeros((len(b.n), 8192), dtype=np.float32)
            own = (column_b >= low) & (column_b < low + 8192)
            y[row_b[own], column_b[own] - low] = 1
        total += x @ y.T
    out[wanted] = np.rint(total[wanted]).astype(np.int64)
    return out


def pairs_that_meet(a: _Side, b: _Side, tree: int, depth: int, num: int, den: int, done: int | None = None) -> np.ndarray:
    """The pairs of a tile of a node of this tree whose longest prefix in any tree has this depth or
    more, but less than done (the depth of the round before; one more, if not given), and that have
    this depth in no tree before: each pair is met once. Pairs whose sizes rule the threshold out are
    left aside."""
    done = done or depth + 1
    small, large = np.minimum(a.n[:, None], b.n[None, :]), np.maximum(a.n[:, None], b.n[None, :])
    fits = small * den >= large * num
    if a is b:
        fits = np.triu(fits, 1)
    i, j = np.nonzero(fits)
    for t in range(TREES):
        levels = depth if t < tree else done
        if levels <= DEPTH and len(i):
            ok = (a.labels[i, t] ^ b.labels[j, t]) >> np.uint64(LEVEL_BITS * (DEPTH - levels)) != 0
            i, j = i[ok], j[ok]
    out = np.zeros(fits.shape, dtype=bool)
    out[i, j] = True
    return out


def _sides(key: tuple, rows: list) -> tuple[_Side, _Side] | None:
    """The two sides of a tile; a tile on the diagonal has one."""
    seen, sides = set(), ([], [])
    for own, *row in rows:
        if row[0] not in seen:
            seen.add(row[0])
            sides[0 if own == key[2] else 1].append(row)
    if not sides[0] or key[2] != key[3] and not sides[1]:
        return None
    a = _Side(sides[0])
    return a, a if key[2] == key[3] else _Side(sides[1])


def _met(key: tuple, rows: list, depth: int, done: int, num: int, den: int) -> list[tuple]:
    """The classes of a tile, by labels alone, that meet another one there: key, own, c."""
    sides = _sides(key, rows)
    if not sides:
        return []
    a, b = sides
    wanted = pairs_that_meet(a, b, key[0], depth, num, den, done)
    out = {(key[2], c) for c in a.c[wanted.any(axis=1)].tolist()} | {(key[3], c) for c in b.c[wanted.any(axis=0)].tolist()}
    return [(*key, own, c) for own, c in sorted(out)]


def _tile(key: tuple, rows: list, depth: int, done: int, num: int, den: int) -> list[tuple]:
    """Rows c, links, link_docs, root of the classes that have links within the tile; with them,
    how many links lie in each band of similarity: rows with c = -1 - band."""
    sides = _sides(key, rows)
    if not sides:
        return []
    a, b = sides
    wanted = pairs_that_meet(a, b, key[0], depth, num, den, done)
    both = shared_counts(a, b, wanted)
    either = a.n[:, None] + b.n[None, :] - both
    linked = wanted & (both * den >= num * either)
    x, y = np.nonzero(linked)
    if not len(x):
        return []
    stats: dict[int, list[int]] = {}
    up: dict[int, int] = {}

    def root(v: int) -> int:
        while up[v] != v:
            up[v] = up[up[v]]
            v = up[v]
        return v

    for side, n, docs in ((a, linked.sum(axis=1), linked @ b.copies), (b, linked.sum(axis=0), a.copies @ linked)):
        for k in np.flatnonzero(n):
            s = stats.setdefault(int(side.c[k]), [0, 0])
            s[0] += int(n[k])
            s[1] += int(docs[k])
            up.setdefault(int(side.c[k]), int(side.c[k]))
    for u, v in zip(a.c[x].tolist(), b.c[y].tolist(), strict=True):
        u, v = root(u), root(v)
        if u != v:
            up[max(u, v)] = min(u, v)
    least = num / den
    band = np.minimum((both[x, y] / either[x, y] - least) / (1 - least) * BANDS, BANDS - 1).astype(int)
    bands = np.bincount(band, minlength=BANDS).tolist()
    return [(c, n, docs, root(c)) for c, (n, docs) in stats.items()] + [(-1 - k, n, 0, None) for k, n in enumerate(bands) if n]


MET = ("tree", "prefix", "i", "j", "own", "c")
LINKS = ("c", "links", "link_docs", "root")


def _by_tile(work, names: tuple, *how: int):
    """work over the rows of each tile; rows come sorted by tile."""

    def flush(out: list) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=list(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], []
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True))
            own, c, copies, n = (batch.column(k).to_pylist() for k in (4, 5, 6, 7))
            flat = batch.column(8).flatten().to_numpy()
            sets = batch.column(9) if batch.num_columns > 9 else None
            for i, at in enumerate(keys):
                if at != key:
                    if rows:
                        out += work(key, rows, *how)
                    key, rows = at, []
                    if len(out) > 5000:
                        yield flush(out)
                        out = []
                rows.append((own[i], c[i], copies[i], flat[i * TREES : (i + 1) * TREES].copy(), sets[i].as_buffer().to_pybytes() if sets else n[i]))
        if rows:
            out += work(key, rows, *how)
        yield flush(out)

    return run


def _least_first(ident: str, th: str) -> Column:
    return F.struct(F.col(ident).isNull().alias("x"), F.col(ident).alias("id"), F.col(th).alias("th"))


class Join:
    """The join over one table: sketch (a row for each document) and classes (a row for each class:
    c, d1, d2, rep, copies, links, link_docs, root_rep); depth is the length down to which prefixes
    were shortened, and recall what the links that were found say of those that weren't."""

    def __init__(self, df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: tuple[int, int] = THRESHOLD, target_recall: float = TARGET_RECALL, tile: int = TILE, tile_bytes: int = TILE_BYTES):
        num, den = threshold
        spark = df.sparkSession
        kind = df.schema[id_col].dataType.simpleString()
        docs = df.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
        with arrow_batches(spark):
            self.sketch = stage(docs.mapInArrow(_sketch, f"id {kind}, th bigint, d1 bigint, d2 bigint, n int, labels array<bigint>"), "sketch")
        of = self.sketch.groupBy("d1", "d2").agg(F.min(_least_first("id", "th")).alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("labels").alias("labels"))
        classes = stage(of.withColumn("c", F.monotonically_increasing_id()), "classes")

        # No prefix gets shorter than floor: classes that are alone there in every tree meet no one.
        # explode makes no rows of empty label lists: texts without words have no links.
        floor = prefix_depth(num / den, target_recall)
        trees = classes.select("c", "n", F.posexplode("labels").alias("tree", "label")).withColumn("prefix", _prefix("label", floor))
        shared = trees.groupBy("tree", "prefix").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
        # Joined by another key than it was grouped by, so that a hot node's rows can be split over tasks.
        shared = shared.select("tree", F.bitwise_not("prefix").alias("np"))
        members = stage(trees.withColumn("np", F.bitwise_not("prefix")).join(shared, ["tree", "np"], "left_semi").select("c", "n", "tree", "label"), "members")

        cand = members.select("c").distinct().join(classes.select("c", "rep"), "c").select("c", F.col("rep.id").alias("rid"), F.col("rep.th").alias("rth"))
        texts = docs.join(cand, docs["id"].eqNullSafe(cand["rid"]) & (docs["th"] == cand["rth"])).select("c", "text")
        with arrow_batches(spark):
            sets = texts.mapInArrow(_shingle_rows, "c bigint, s binary").groupBy("c").agg(F.first("s").alias("s"))
            full = stage(sets.join(classes.select("c", "copies", "n", "labels"), "c"), "sets")

        self.recall, bands, parts = 0.0, [0] * BANDS, []
        depth, done = DEPTH, DEPTH + 1
        while True:
            found = self._round(members, full, depth, done, num, den, tile, tile_bytes)
            for r in found.filter("c < 0").groupBy("c").agg(F.sum("links").alias("n")).collect():  # BANDS rows at most
                bands[-1 - r["c"]] += r["n"]
            parts.append(found.filter("c >= 0"))
            self.depth, self.recall = depth, estimated_recall(bands, depth, num / den)
            if self.recall >= target_recall or depth == floor:
                break
            enough = lambda r: estimated_recall(bands, self.depth, num / den, at=r) >= target_recall
            done, depth = depth, next(r for r in range(depth - 1, floor - 1, -1) if r == floor or enough(r))
        found = parts[0]
        for one in parts[1:]:
            found = found.unionByName(one)
        drop(members)
        drop(full)

        root = components(found.select(F.col("c").alias("a"), F.col("root").alias("b")))
        per = found.groupBy("c").agg(F.sum("links").alias("links"), F.sum("link_docs").alias("link_docs"))
        named = per.join(root, per["c"] == root["node"], "left").select("c", "links", "link_docs", F.coalesce("root", "c").alias("root"))
        reps = named.join(classes.select("c", "rep"), "c")
        least = reps.groupBy("root").agg(F.min("rep").alias("root_rep"))
        linked = reps.join(least, "root").select("c", "links", "link_docs", "root_rep")
        self.classes = classes.drop("labels", "n").join(linked, "c", "left").withColumn("root_rep", F.coalesce("root_rep", "rep")).fillna(0, ["links", "link_docs"])
        self.docs, self.df, self.names = docs, df, (id_col, text_col)

    @staticmethod
    def _round(members: DataFrame, full: DataFrame, depth: int, done: int, num: int, den: int, tile: int, tile_bytes: int) -> DataFrame:
        """The links of all pairs that meet at this depth, but not at that of the round before (done)."""
        spark = members.sparkSession
        rows = members.withColumn("prefix", _prefix("label", depth))
        child = _prefix("label", done) if done <= DEPTH else F.col("c")
        node = rows.groupBy("tree", "prefix").agg(
            F.count(F.lit(1)).alias("m"), F.sum("n").alias("size"), F.min(child).alias("low"), F.max(child).alias("high"), F.bit_xor(F.xxhash64("c")).alias("x"), F.bit_xor(F.xxhash64("c", F.lit(1))).alias("y")
        )
        # Nodes with one branch have no pair that parts here. Those that hold the same classes in
        # several trees count in the first.
        node = node.filter("low <> high").groupBy("m", "x", "y", "size").agg(F.min(F.struct("tree", "prefix")).alias("t"))
        node = node.select("t.tree", "t.prefix", F.ceil(F.greatest(F.col("m") / tile, F.col("size") * 8 / tile_bytes)).alias("parts"))
        met = rows.select("c", "tree", "prefix").join(node, ["tree", "prefix"])
        dealt = met.withColumn("own", F.pmod(F.xxhash64("c", F.lit(2)), F.col("parts"))).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        dealt = dealt.withColumn("i", F.least("own", "k")).withColumn("j", F.greatest("own", "k"))
        key = ["tree", "prefix", "i", "j"]
        kinds = lambda names: ", ".join(f"{c} bigint" for c in names)

        def tiles(rows: DataFrame, *more: str) -> DataFrame:
            return rows.join(full, "c").select(*key, "own", "c", "copies", "n", "labels", *more).repartition(*key).sortWithinPartitions(*key)

        with arrow_batches(spark):
            # Labels alone tell which classes of a tile have a pair to look at; only their sets travel.
            wanted = stage(tiles(dealt).mapInArrow(_by_tile(_met, MET, depth, done, num, den), kinds(MET)), "met")
            found = stage(tiles(wanted, "s").mapInArrow(_by_tile(_tile, LINKS, depth, done, num, den), kinds(LINKS)), "links")
        drop(wanted)
        return found

    def report(self) -> DataFrame:
        """A row for each document: id; class_id, the least id of those that links or copies join it
        to; copy_of, the least id with the same set; n_copies, documents with the same set (itself
        among them); n_links, other sets that are similar; n_link_docs, documents that have them."""
        per = self.classes.select("d1", "d2", F.col("root_rep.id").alias("class_id"), F.col("rep.id").alias("copy_of"), F.col("copies").alias("n_copies"), F.col("links").alias("n_links"), F.col("link_docs").alias("n_link_docs"))
        out = self.sketch.select(F.col("id").alias(self.names[0]), "d1", "d2").join(per, ["d1", "d2"])
        return out.drop("d1", "d2")

    def keep_one(self) -> DataFrame:
        """The rows of the table without those that a row before them, by least id, stands for."""
        rep = self.classes.select("root_rep").distinct().select(F.col("root_rep.id").alias("__rid"), F.col("root_rep.th").alias("__rth"))
        rows, names, back = apart(self.df)
        ident, text = (names[c] for c in self.names)
        keyed = rows.withColumn("__th", F.xxhash64(text))
        kept = keyed.join(rep, F.col(ident).eqNullSafe(F.col("__rid")) & (F.col("__th") == F.col("__rth")), "left_semi")
        # Rows alike in id and text: one stays.
        own = Window.partitionBy(ident, "__th").orderBy(F.xxhash64(*rows.columns))
        return kept.withColumn("__row", F.row_number().over(own)).filter("__row = 1").select(*back)
