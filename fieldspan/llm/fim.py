"""Operator 12: fill-in-middle transformation by bit-parallel big integers.

A text's UTF-8 bytes are translated into one binary digit each and read as one whole number: bit i
tells whether byte i belongs to a class. Shifts and boolean operations turn class masks into the
mask of places where a unit (a code point, a word, a line) starts; bit_count says how many units
there are; the places of the two units at which the text is cut are selected by rank, halving
the mask again and again. Nothing looks at single characters.

A text is cut into prefix, middle and suffix and put together again as

    psm   <P>prefix<S>suffix<M>middle
    spm   <S>suffix<P>prefix<M>middle
    plain the text as it is

Cuts and form depend on the seed and the id alone, so that a rerun, in any order, agrees.

Defined cases: a null text is empty; empty texts, and texts that hold a marker, stay plain; a null id
is hashed as no digits; rows are looked at one by one, so repeated ones give repeated results; an empty
table gives an empty result; other columns are not read, whatever their names. Texts are worked on whole:
memory is a small multiple of the longest text in each worker.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship

ship(__name__)

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED = 1
#: In a hundred: texts that are transformed, and transformed ones with the suffix first.
TRANSFORMED, SUFFIX_FIRST = 90, 20
SLICE = 4 << 20


def _table(inside) -> bytes:
    return bytes(ord("1") if inside(b) else ord("0") for b in range(256))


LEAD = _table(lambda b: not 0x80 <= b < 0xC0)
NOT_SPACE = _table(lambda b: b not in b" \t\n\v\f\r")
NEW_LINE = _table(lambda b: b == 0x0A)


def class_mask(data: bytes, table: bytes) -> int:
    """Bit i: whether byte i is in the table's class."""
    return int(data.translate(table)[::-1], 2) if data else 0


def starts(data: bytes, unit: str = "chars") -> int:
    """Bit i: whether a unit starts at byte i."""
    if unit == "chars":
        return class_mask(data, LEAD)
    if unit == "words":
        inside = class_mask(data, NOT_SPACE)
        return inside & ~(inside << 1)
    if unit == "lines":
        return (class_mask(data, NEW_LINE) << 1 | 1) & ((1 << len(data)) - 1)
    raise ValueError(f"no unit {unit}")


def select(mask: int, width: int, ranks: list[int]) -> list[int]:
    """Places of the set bits of these ranks (from 0, rising), among the lowest width bits."""
    if not ranks:
        return []
    if width <= 32:
        out, gone = [], 0
        for r in ranks:
            while gone < r:
                mask &= mask - 1
                gone += 1
            out.append((mask & -mask).bit_length() - 1)
        return out
    half = width >> 1
    low = mask & ((1 << half) - 1)
    n = low.bit_count()
    left = [r for r in ranks if r < n]
    right = [r - n for r in ranks[len(left) :]]
    return select(low, half, left) + [half + x for x in select(mask >> half, width - half, right)]


def cut(data: bytes, first: int, second: int, unit: str = "chars", mask: int | None = None) -> tuple[bytes, bytes, bytes]:
    """Prefix of `first` units, middle up to `second` units, suffix; first <= second."""
    mask = starts(data, unit) if mask is None else mask
    n, size = mask.bit_count(), len(data)
    ranks = sorted({k for k in (first, second) if k < n})
    at = dict(zip(ranks, select(mask, size, ranks), strict=True))
    # Where a text begins with what belongs to no unit, that goes with the prefix's first unit.
    a, b = (0 if k == 0 else at.get(k, size) for k in (first, second))
    return data[:a], data[a:b], data[b:]


def draws(key: str, seed: int = SEED) -> list[int]:
    """Four pseudorandom numbers below 2 ** 32 for a row."""
    h = hashlib.sha256(f"{seed}:{key}".encode()).digest()
    return [int.from_bytes(h[4 * k : 4 * k + 4], "big") for k in range(4)]


def transformed(data: bytes, key: str, seed: int = SEED, unit: str = "chars") -> tuple[int, str, int | None, int | None, bytes]:
    """Number of units, form, units of prefix and middle, output."""
    mask = starts(data, unit)
    n = mask.bit_count()
    h1, h2, h3, h4 = draws(key, seed)
    if not data or h3 % 100 >= TRANSFORMED or any(m in data for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, data
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = cut(data, a, b, unit, mask)
    if h4 % 100 < SUFFIX_FIRST:
        return n, "spm", a, b - a, SUFFIX + s + PREFIX + p + MIDDLE + m
    return n, "psm", a, b - a, PREFIX + p + SUFFIX + s + MIDDLE + m


def _runner(seed: int, unit: str, kind: pa.DataType):
    names = ["id", "n", "form", "prefix_units", "middle_units", "output"]
    kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        cols = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for key, text in zip(batch.column(0), texts, strict=True):
                key, data = key.as_py(), text.as_py() or b""
                rows.append((key, *transformed(data, "" if key is None else str(key), seed, unit)))
                size += len(data)
                if size >= SLICE:
                    yield made(rows)
                    rows, size = [], 0
        if rows:
            yield made(rows)

    return run


def transform(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, unit: str = "chars") -> DataFrame:
    """A row for each row: id, n (units of the text), form, prefix_units and middle_units (null if
    plain), output (the text to train on). unit: chars, words or lines."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = df.schema[id_col].dataType
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {kind.simpleString()}, n bigint, form string, prefix_units bigint, middle_units bigint, output string"
    return rows.mapInArrow(_runner(seed, unit, to_arrow_type(kind)), schema).withColumnRenamed("id", id_col)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from: the parts lie between markers that no part holds."""
    p, s, m = (x.decode() for x in (PREFIX, SUFFIX, MIDDLE))
    first = lambda mark: F.substring_index(output, mark, 1)
    bare = lambda x: F.substr(x, F.lit(4))
    middle = F.substring_index(output, m, -1)
    psm = F.concat(bare(first(s)), middle, F.substring_index(first(m), s, -1))
    spm = F.concat(F.substring_index(first(m), p, -1), middle, bare(first(p)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def report(df: DataFrame) -> DataFrame:
    """The transformation of every row, with digests of the output and of the text that is rebuilt from it."""
    got = transform(df)
    return got.select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def oracle() -> str:
    return f"""
with t as (select doc_id, coalesce(text, '') as x, sha256('{SEED}:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
u as (select doc_id, x, length(x)::bigint as n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from t),
v as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
  case when x = '' or contains(x, '<P>') or contains(x, '<S>') or contains(x, '<M>') or h3 % 100 >= {TRANSFORMED} then 'plain' when h4 % 100 < {SUFFIX_FIRST} then 'spm' else 'psm' end as form from u),
w as (select *, substring(x, 1, a) as p, substring(x, a + 1, b - a) as m, substring(x, b + 1) as s from v)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
  sha256(case form when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m when 'spm' then '<S>' || s || '<P>' || p || '<M>' || m else x end) as output_sha256, sha256(x) as restored_sha256 from w"""
