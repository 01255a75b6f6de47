"""Operator 13: cross-tokenizer alignment with segments encoded once.

A text, with a space before it, is cut before white space wherever neither vocabulary can merge across:
no piece of either holds a character that isn't white space followed by that white space, and the
first tokenizer's pre-tokens never reach over such a place. Segments are encoded and aligned
apart from each other, so a distinct one is encoded once, however often the corpus has it:

1. segments are counted: in each task, then by a shuffle;
2. each distinct segment is encoded by both tokenizers and aligned by byte offsets;
3. counts of linked id pairs are sums over distinct segments, weighed with their counts;
4. alignments go back to the texts and are composed in order. The most frequent segments are broadcast
   (at most `hot` of them, of at most SHORT characters); all others are joined by segment, and
   meet the texts that hold them in one shuffle by row.

As the most frequent segments don't take part in the join, no key of it holds more than a share of one
over `hot` of all short segments. Long segments may be frequent: Spark's join may split them.

Pair counts are broadcast up to MAX_PAIRS pairs, which are counted first; beyond, links are joined
with them by a shuffle. Both ways give the same rows.

Defined cases: texts that are null or empty, or that the second tokenizer doesn't give back byte by byte,
have no tokens: zeros, and '' for the groups; they count for nothing. Rows are looked at one by one, and repeated
ones count as often as they are there; an empty table gives an empty result; other columns are not
read, whatever their names. The table is read three times and must not change in between.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import filterfalse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, ship, shuffles_dropped, stage

ship(__name__)

TOKENIZER_A = "/opt/tokenizers/byte_bpe_50k.json"
TOKENIZER_B = "/opt/tokenizers/piece_bpe_32k.model"
HOT = 225_000
SHORT = 64
MAX_PAIRS = 1 << 18
#: Distinct segments that a task counts before it hands its counts on.
HELD = 250_000
SLICE = 4 << 20
#: White space of any of the libraries, as a class of a pattern.
ANY_SPACE = r"\s᠎"
#: One that Python doesn't split at.
SPECIAL_SPACE = "\u180e"
SPACE_MARK = "▁"
FIELDS = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint"


class Pair:
    """Both tokenizers, what their tokens spell, and where texts may be cut."""

    def __init__(self, a_file: bytes, b_file: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        told = json.loads(a_file)
        pre = told.get("pre_tokenizer") or {}
        if told.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space"):
            raise ValueError("the first tokenizer must be byte-level, without a normalizer or a prefix")
        self.a = Tokenizer.from_str(a_file.decode())
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=b_file)
        self.as_is = normalizer_of(b_file) == (b"", 1, 0, 1)
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves
        rest = [b for b in range(256) if b not in set(plain)]
        to_byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
        special = {t["id"] for t in told.get("added_tokens", [])}
        vocabulary = {i: bytes(map(to_byte.__getitem__, t)) for t, i in told["model"]["vocab"].items() if i not in special}
        self.a_bytes = [vocabulary.get(i, b"") for i in range(1 + max(vocabulary))]
        if {b for b in self.a_bytes if len(b) == 1} != {bytes([b]) for b in range(256)}:
            raise ValueError("the first tokenizer doesn't spell every byte")
        ids = range(self.b.get_piece_size())
        pieces = ["" if self.b.is_control(i) or self.b.is_unknown(i) else self.b.id_to_piece(i) for i in ids]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in zip(ids, pieces, strict=True)]
        words = [p for i, p in zip(ids, pieces, strict=True) if not self.b.is_byte(i)]
        self.space = self.b.piece_to_id(SPACE_MARK)
        self.a_size, self.b_size = [list(map(len, x)) for x in (self.a_bytes, self.b_bytes)]
        self.cuts = self._cuts(words, pre) if words.count(SPACE_MARK) else ""
        here = re.escape(self.cuts)
        self.odd = re.compile(rf"([{ANY_SPACE}]{{2,}}[^{ANY_SPACE}]*|(?![{here}])[{ANY_SPACE}][^{ANY_SPACE}]*)") if self.cuts else None

    def _cuts(self, words: list[str], pre: dict) -> str:
        """White space before which a text may be cut: none without a space, as both begin with one."""
        if not pre.get("use_regex", True):
            return ""
        safe = ""
        for c in " \n":
            b = c.replace(" ", SPACE_MARK)
            # A segment that begins with another sign than a space is encoded after a space of its own, which must stay alone.
            across = rf"[^{ANY_SPACE}{SPACE_MARK}]{b}" if c == " " else rf"[^{ANY_SPACE}]{b}"
            bytes_across = rb"[^\x00-\x20\x80-\xff]" + c.encode()
            if not any(re.search(across, w) for w in words) and not any(re.search(bytes_across, x) for x in self.a_bytes):
                safe += c
        return safe if safe.startswith(" ") else ""

    def whole(self, text: str) -> bool:
        """Whether B gives back the text: it spells what its normalizer leaves."""
        if self.as_is:
            return SPACE_MARK not in text
        return self.b.normalize(text).replace(SPACE_MARK, " ") == " " + text

    def segments(self, text: str) -> list[str]:
        """Keys of the segments of space and text, in order. The space that a segment begins with is left
        out of its key unless more white space follows; keys that begin with white space have it all."""
        if not self.cuts:
            return [_key(" " + text)]
        lines = "\n" in self.cuts
        words = text.split()
        if SPECIAL_SPACE not in text and " ".join(words) == (text.replace("\n", " ") if lines else text):
            # One space or line break between any two words, and none at the ends: by far most texts.
            return text.replace("\n", " \n").split(" ") if "\n" in text else words
        keys: list[str] = []
        for k, part in enumerate(self.odd.split(" " + text)):
            if k % 2:
                if part[0] in self.cuts:
                    keys.append(_key(part))
                else:
                    keys[-1] += part
            elif part:
                keys += (part.replace("\n", " \n") if lines else part)[1:].split(" ")
        return keys

    def encoded(self, keys: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both tokenizers for segments."""
        full = [k if k[:1].isspace() else " " + k for k in keys]
        a = [e.ids for e in self.a.encode_batch_fast(full, add_special_tokens=False)]
        b = self.b.encode([x[1:] if x[0] == " " else x for x in full], num_threads=1)
        for k, x in enumerate(full):
            if x == " ":
                b[k] = [self.space]
            elif x[0] != " ":
                if b[k][0] != self.space:
                    raise ValueError("the space before a segment doesn't stay alone")
                del b[k][0]
        return a, b


def _key(segment: str) -> str:
    return segment[1:] if segment[0] == " " and not segment[1:2].isspace() else segment


def aligned(a: list[int], b: list[int], a_size: list[int], b_size: list[int]) -> tuple[str, int, list[int]]:
    """Groups as text, their number, and links (a times 2 ** 32 plus b) of two encodings of the same bytes."""
    links, groups = [], []
    i = j = 0
    own_a, own_b = [a[0]], [b[0]]
    ahead = a_size[a[0]] - b_size[b[0]]  # how much further A's token ends than B's
    while True:
        links.append(a[i] << 32 | b[j])
        if ahead > 0:
            j += 1
            own_b.append(b[j])
            ahead -= b_size[b[j]]
        elif ahead < 0:
            i += 1
            own_a.append(a[i])
            ahead += a_size[a[i]]
        else:
            groups.append(f"{own_a[0]}|{own_b[0]}" if len(own_a) == len(own_b) == 1 else f"{','.join(map(str, own_a))}|{','.join(map(str, own_b))}")
            i += 1
            j += 1
            if i == len(a) or j == len(b):
                return ";".join(groups), len(groups), links
            own_a, own_b = [a[i]], [b[j]]
            ahead = a_size[a[i]] - b_size[b[j]]


def normalizer_of(model: bytes) -> tuple[bytes, int, int, int]:
    """A model file's normalizer: its character map (empty: texts stay as they are), and whether it puts a space
    before a text, takes out extra white space, and marks spaces. The file is a protocol buffer: the
    normalizer is field 3, and these are its fields 2 to 5."""

    def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
        i = 0

        def number() -> int:
            nonlocal i
            n = shift = 0
            while True:
                b = data[i]
                i += 1
                n |= (b & 127) << shift
                shift += 7
                if b < 128:
                    return n

        while i < len(data):
            tag = number()
            kind = tag & 7
            if kind == 0:
                yield tag >> 3, number()
            else:
                size = number() if kind == 2 else {1: 8, 5: 4}[kind]
                yield tag >> 3, data[i : i + size]
                i += size

    own = dict(fields(dict(fields(model)).get(3, b"")))
    return own.get(2, b""), own.get(3, 1), own.get(4, 1), own.get(5, 1)


_loaded: dict[bytes, Pair] = {}


def _pair(files: tuple[bytes, bytes]) -> Pair:
    """The tokenizers of this process."""
    key = hashlib.sha256(files[0] + files[1]).digest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Pair(*files)
    return _loaded[key]


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, int, str]]:
    for batch in batches:
        for k, x in enumerate(batch.column(column)):
            yield batch, k, x.as_py()


def _counter(files):
    kind = pa.schema([("seg", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, counts = _pair(files.value), Counter()
        for _, _, text in _texts(batches, 0):
            if text and pair.whole(text):
                counts.update(pair.segments(text))
                if len(counts) > HELD:
                    yield from _parts(counts.items(), kind)
                    counts = Counter()
        yield from _parts(counts.items(), kind)

    return run


def _parts(rows, kind: pa.Schema, most: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Batches of rows, each of some MB at most: the first column of a row may be long."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[0])
        if len(held) >= most or size >= SLICE:
            yield _table(held, kind)
            held, size = [], 0
    if held:
        yield _table(held, kind)


def _aligner(files):
    kind = pa.schema([("seg", pa.string()), ("n", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups", pa.string()), ("links", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(files.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                segs, ns = part.column(0).to_pylist(), part.column(1).to_pylist()
                rows = []
                for seg, n, a, b in zip(segs, ns, *pair.encoded(segs), strict=True):
                    groups, n_groups, links = aligned(a, b, pair.a_size, pair.b_size)
                    rows.append((seg, n, len(a), len(b), n_groups, groups, links))
                yield from _parts(rows, kind)

    return run


def _scorer(pairs):
    """n_best and count_sum of segments from the broadcast pair counts."""
    kind = pa.schema([("seg", pa.string()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pairs.value
        for batch in batches:
            rows = []
            for seg, n_a, n_b, n_groups, groups, links in zip(*(batch.column(c).to_pylist() for c in ("seg", "n_a", "n_b", "n_groups", "groups", "links")), strict=True):
                found = [known[x] for x in links]
                rows.append((seg, n_a, n_b, n_groups, len(links), sum(x[1] for x in found), sum(x[0] for x in found), groups))
            yield from _parts(rows, kind)

    return run


#: Sums of a text are made of all its segments' numbers at once: each has so many bits of one whole number.
BITS = 64


def packed(numbers: Iterable[int]) -> int:
    out = 0
    for k, n in enumerate(numbers):
        out |= n << (BITS * k)
    return out


def unpacked(n: int, many: int) -> list[int]:
    return [n >> (BITS * k) & ((1 << BITS) - 1) for k in range(many)]


def _rare(files, hot):
    """Which segments that aren't broadcast a row's text has."""
    kind = pa.schema([("seg", pa.string()), ("row_key", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, known = _pair(files.value), hot.value[0]

        def rows() -> Iterator[tuple[str, int]]:
            for batch, k, text in _texts(batches, 1):
                if text and pair.whole(text):
                    key = batch.column(0)[k].as_py()
                    for seg in set(filterfalse(known.__contains__, pair.segments(text))):
                        yield seg, key

        yield from _parts(rows(), kind)

    return run


def _composer(files, hot, id_kind: pa.DataType):
    """Rows of a key in order: alignments of rare segments, then texts."""
    kind = pa.schema([("id", id_kind), *((c.split(" ")[0], pa.int64()) for c in FIELDS.split(", ")), ("groups", pa.string())])
    many = len(kind) - 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, (numbers, groups) = _pair(files.value), hot.value
        own: list[str] = []

        def forget() -> None:
            for seg in own:
                del numbers[seg], groups[seg]
            own.clear()

        try:
            yield from composed(batches, pair, numbers, groups, own, forget)
        finally:  # the broadcast tables stay as they came
            forget()

    def composed(batches, pair: Pair, numbers: dict, groups: dict, own: list[str], forget) -> Iterator[pa.RecordBatch]:
        own_key, rows, size = None, [], 0
        for batch in batches:
            ids, texts, is_text = batch.column("id"), batch.column("text"), batch.column("side").to_pylist()
            for k, key in enumerate(batch.column("row_key").to_pylist()):
                if key != own_key:  # what the last key's texts had besides goes again
                    forget()
                    own_key = key
                text = texts[k].as_py()
                if not is_text[k]:
                    told, group, seg = text.split("\t", 2)
                    if seg not in numbers:
                        own.append(seg)
                        numbers[seg], groups[seg] = packed(map(int, told.split(","))), group
                elif text and pair.whole(text):
                    segs = pair.segments(text)
                    rows.append((ids[k].as_py(), *unpacked(sum(map(numbers.__getitem__, segs)), many), ";".join(map(groups.__getitem__, segs))))
                    size += len(text) * 3
                else:
                    rows.append((ids[k].as_py(), *[0] * many, ""))
                if size >= SLICE or len(rows) >= 2000:
                    yield _table(rows, kind)
                    rows, size = [], 0
        if rows:
            yield _table(rows, kind)

    return run


def _load(spark: SparkSession, a: str, b: str):
    """The tokenizers' files, read by the driver; their size doesn't depend on the corpus."""
    with open(a, "rb") as f, open(b, "rb") as g:
        return spark.sparkContext.broadcast((f.read(), g.read()))


def segment_table(df: DataFrame, text_col: str = "text", a: str = TOKENIZER_A, b: str = TOKENIZER_B) -> DataFrame:
    """A row for each distinct segment: seg (its key), n (how often the corpus has it), n_a, n_b, n_groups, groups
    (`a1,a2|b1;a3|b2,b3`), links (a * 2 ** 32 + b, each as often as it is there)."""
    files = _load(df.sparkSession, a, b)
    parts = df.select(F.col(text_col).alias("text")).mapInArrow(_counter(files), "seg string, n bigint")
    counts = parts.groupBy("seg").agg(F.sum("n").alias("n"))
    return counts.mapInArrow(_aligner(files), "seg string, n bigint, n_a bigint, n_b bigint, n_groups bigint, groups string, links array<bigint>")


def pair_counts(segments: DataFrame) -> DataFrame:
    """pair, count, best (1 if no other pair of the B id has a higher one) over a segment table."""
    per = segments.select("n", F.explode("links").alias("pair")).groupBy("pair").agg(F.sum("n").alias("count"))
    per = per.withColumn("b_id", F.col("pair").bitwiseAND((1 << 32) - 1))
    top = per.groupBy("b_id").agg(F.max("count").alias("most"))
    return per.join(top, "b_id").select("pair", "count", (F.col("count") == F.col("most")).cast("long").alias("best"))


def _hot_from(segments: DataFrame, hot: int) -> tuple[int, int]:
    """The least count from which at most `hot` short segments have at least that; how many segments there are
    besides those. On the driver: a row for each different count, the `hot` highest at most."""
    short = F.length("seg") <= SHORT
    n_all = segments.count()
    least, n = 1 << 62, 0
    for r in segments.filter(short).groupBy("n").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("n")).limit(max(1, hot)).collect():
        if n + r["rows"] > hot:
            break
        least, n = r["n"], n + r["rows"]
    return least, n_all - n


def align(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", a: str = TOKENIZER_A, b: str = TOKENIZER_B, hot: int = HOT, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """A row for each row: id, n_a, n_b, n_groups, n_links, n_best (links whose count is their B id's highest), count_sum
    (counts of the links' pairs), groups. a and b: paths that the driver can read."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = df.sparkSession
    files = _load(spark, a, b)
    with shuffles_dropped(spark):
        segments = stage(segment_table(df, text_col, a, b), "segments")
        pairs = stage(pair_counts(segments), "pairs")
    columns = ["seg", *(c.split(" ")[0] for c in FIELDS.split(", ")), "groups"]
    few = pairs.count() <= max_pairs
    if few:
        known = spark.sparkContext.broadcast({r["pair"]: (r["count"], r["best"]) for r in pairs.collect()})
        scored = lambda x: x.mapInArrow(_scorer(known), f"seg string, {FIELDS}, groups string")
    else:

        def scored(x: DataFrame) -> DataFrame:
            met = x.select("seg", F.explode("links").alias("pair")).join(pairs.hint("merge"), "pair")
            sums = met.groupBy("seg").agg(F.sum("best").alias("n_best"), F.sum("count").alias("count_sum"))
            return x.join(sums, "seg").withColumn("n_links", F.size("links").cast("long")).select(*columns)

    kind = df.schema[id_col].dataType
    least, n_rare = _hot_from(segments, hot)
    is_hot = (F.col("n") >= least) & (F.length("seg") <= SHORT)
    frequent = scored(segments.filter(is_hot)).select(*columns).toArrow()
    values = zip(*(frequent.column(c).to_pylist() for c in columns[1:-1]), strict=True)
    segs = frequent.column("seg").to_pylist()
    known_segs = spark.sparkContext.broadcast((dict(zip(segs, map(packed, values), strict=True)), dict(zip(segs, frequent.column("groups").to_pylist(), strict=True))))
    # Rows with the same key have each other's segments at hand too, which does no harm: a key of four bytes will do.
    key = F.when(F.length(text_col) > 0, F.hash(id_col, text_col)).otherwise(F.hash(F.monotonically_increasing_id()))
    rows = df.select(key.alias("row_key"), F.lit(True).alias("side"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if n_rare:
        wanted = df.select(F.hash(id_col, text_col).alias("row_key"), F.col(text_col).alias("text")).mapInArrow(_rare(files, known_segs), "seg string, row_key int")
        told = F.concat_ws("\t", F.concat_ws(",", *columns[1:-1]), "groups", "seg")
        rare = scored(segments.filter(~is_hot)).select("seg", told.alias("told"))
        back = wanted.join(rare.hint("merge"), "seg").select("row_key", F.lit(False).alias("side"), F.lit(None).cast(kind).alias("id"), F.col("told").alias("text"))
        rows = rows.unionByName(back).repartition("row_key").sortWithinPartitions("row_key", "side")
    out = rows.mapInArrow(_composer(files, known_segs, to_arrow_type(kind)), f"id {kind.simpleString()}, {FIELDS}, groups string")
    if few:
        drop(pairs)
    return out.withColumnRenamed("id", id_col)


def report(df: DataFrame) -> DataFrame:
    """align() with the groups' digest in their place."""
    got = align(df)
    return got.select(*got.columns[:-1], F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256"))
