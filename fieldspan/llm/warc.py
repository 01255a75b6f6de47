"""Operator 4: WARC archives and their chunked record table.

write() puts rows into gzip-compressed WARC files, a member for each record; of records with
equal payloads the one with the smallest id is a response and the others revisit it. read()
streams archives back as rows (record, chunk number): a chunk holds CHUNK bytes of the payload
at most and the SHA-1 of all up to its end, so that neither side holds a whole record besides
the row that Spark hands over.

Archives go to the folder that all machines share, under a name of their task's own, and take
their final name when complete; a task that runs again writes the same records under that name.

Defined cases: a null payload is empty; a null id is no one's reference: of equal payloads the
smallest id that is not null is the response, rows that share it all are, and if every id is
null all are; an empty table gives no archive and no rows; an archive that ends within a
record raises an error.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import ship

ship(__name__)

CHUNK = 256 * 1024
ARCHIVE_BYTES = 64 * 1024 * 1024
MIN_REVISIT_BYTES = 0
READ_BYTES = 64 * 1024
BATCH_BYTES = 4 * 1024 * 1024

_RECORDS = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space for URLs

WRITTEN = "archive string, n_records bigint, n_bytes bigint"
CHUNKS = (
    "record_id string, page_id bigint, record_type string, refers_to bigint, chunk_no int, data binary, "
    "bytes_so_far bigint, digest_so_far string, is_last boolean, payload_bytes bigint, payload_digest string"
)


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def record_name(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(_RECORDS, f'page/{page_id}')}>"


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def _head(row: dict, date: str) -> tuple[bytes, bytes]:
    """The WARC header and the HTTP header of a record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['bytes']}\r\n\r\n".encode()
    revisit = row["refers_to"] is not None
    own = row["page_id"] if row["page_id"] is not None else uuid.uuid4()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_name(own)}",
        f"WARC-Date: {date}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{base32(row['sha1'])}",
        f"X-Payload-Length: {row['bytes']}",
        f"Content-Length: {len(http) + (0 if revisit else row['bytes'])}",
    ]
    if row["url"]:
        lines.append("WARC-Target-URI: " + "".join(ch for ch in row["url"] if ch not in "\r\n"))
    if row["page_id"] is not None:
        lines.append(f"X-Page-ID: {row['page_id']}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_name(row['refers_to'])}", f"X-Refers-To-Page: {row['refers_to']}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode(), http


def _writer(folder: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _fs(folder)
        fs.create_dir(base, recursive=True)
        task = TaskContext.get()
        part, attempt, number = task.partitionId(), task.taskAttemptId(), 0
        out, n, size = None, 0, 0

        def done():
            final = f"{base}/part-{part:05d}-{number:04d}.warc.gz"
            out.close()
            if fs.type_name != "local" and fs.get_file_info(final).type.name != "NotFound":
                fs.delete_file(final)
            fs.move(temp, final)
            name = folder.rstrip("/") + final[len(base.rstrip("/")) :]
            return pa.RecordBatch.from_pydict({"archive": [name], "n_records": [n], "n_bytes": [size]}, schema=pa.schema([("archive", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())]))

        for batch in batches:
            names = [c for c in batch.schema.names if c != "payload"]
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in names}
                if out is None:
                    temp = f"{base}/.part-{part:05d}-{number:04d}-{attempt}"
                    out, n, size = fs.open_output_stream(temp, compression=None), 0, 0
                head, http = _head(row, date)
                press = zlib.compressobj(1, zlib.DEFLATED, 31)
                pieces = [press.compress(head + http)]
                if row["refers_to"] is None:
                    view = memoryview(batch.column("payload")[i].as_buffer())
                    for at in range(0, len(view), CHUNK):
                        pieces.append(press.compress(view[at : at + CHUNK]))
                        if sum(map(len, pieces)) > CHUNK:
                            size += sum(out.write(x) or len(x) for x in pieces)
                            pieces = []
                pieces += [press.compress(b"\r\n\r\n"), press.flush()]
                joined = b"".join(pieces)
                out.write(joined)
                size += len(joined)
                n += 1
                if size >= ARCHIVE_BYTES:
                    yield done()
                    out, number = None, number + 1
        if out is not None:
            yield done()

    return run


def write(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = MIN_REVISIT_BYTES, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """A lazy table of the archives written: archive (path), n_records, n_bytes. Ids are whole numbers."""
    if not isinstance(pages.schema[id_col].dataType, IntegralType):
        raise ValueError(f"{id_col} must be of a whole-number type")
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.octet_length(payload).cast("long").alias("bytes"), F.sha1(payload).alias("sha1"))
    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), F.octet_length(payload).cast("long").alias("bytes"), F.sha1(payload).alias("sha1"))
    first = slim.filter(F.col("bytes") >= min_revisit_bytes).groupBy("sha1", "bytes").agg(F.min("page_id").alias("first"))
    # Joined by another key than it was grouped by: both sides are shuffled for the join alone, and
    # the rows of a payload that many pages have can be split over tasks.
    first = first.select(F.reverse("sha1").alias("key"), F.col("bytes").alias("size"), "first")
    on = (F.col("key") == F.reverse("sha1")) & (F.col("size") == F.col("bytes"))
    refers = F.when(F.col("page_id").eqNullSafe(F.col("first")), None).otherwise(F.col("first"))
    met = rows.join(first, on, "left").select("page_id", "url", "payload", "bytes", "sha1", refers.alias("refers_to"))
    return met.mapInArrow(_writer(folder, date), WRITTEN)


def _members(fs, path: str) -> Iterator[bytes]:
    """The archive's bytes, decompressed piece by piece."""
    with fs.open_input_stream(path, compression=None) as f:
        inflate, rest = zlib.decompressobj(31), b""
        while True:
            if not rest:
                rest = f.read(READ_BYTES)
                if not rest:
                    break
            out = inflate.decompress(rest, READ_BYTES * 4)
            rest = inflate.unconsumed_tail
            if inflate.eof:
                rest, inflate = inflate.unused_data, zlib.decompressobj(31)
            if out:
                yield out
        if inflate.flush():
            raise ValueError(f"{path} ends within a record")


class _Bytes:
    """Takes lines, heads and lengths from a stream of pieces."""

    def __init__(self, pieces: Iterator[bytes], name: str):
        self.pieces, self.buffer, self.name = pieces, bytearray(), name

    def more(self) -> bool:
        for x in self.pieces:
            self.buffer += x
            return True
        return False

    def head(self) -> bytes | None:
        """Up to an empty line; None at the end."""
        while (at := self.buffer.find(b"\r\n\r\n")) < 0:
            if not self.more():
                if self.buffer:
                    raise ValueError(f"{self.name} ends within a header")
                return None
        out = bytes(self.buffer[:at])
        del self.buffer[: at + 4]
        return out

    def take(self, n: int) -> bytes:
        """Up to n bytes, one at least."""
        while len(self.buffer) < n and self.more():
            pass
        if not self.buffer:
            raise ValueError(f"{self.name} ends within a record")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out


def records(path: str, chunk: int = CHUNK) -> Iterator[dict]:
    """The rows of one archive's chunked record table."""
    fs, local = _fs(path)
    source = _Bytes(_members(fs, local), path)
    whole = lambda h, k: int(h[k]) if k in h else None
    while (head := source.head()) is not None:
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"{path}: a record begins with {lines[0][:40]!r}")
        h = dict(x.split(": ", 1) for x in lines[1:])
        http = source.head()
        left = int(h["Content-Length"]) - len(http) - 4
        base = {"record_id": h["WARC-Record-ID"], "page_id": whole(h, "X-Page-ID"), "record_type": h["WARC-Type"], "refers_to": whole(h, "X-Refers-To-Page"), "payload_bytes": int(h["X-Payload-Length"]), "payload_digest": h["WARC-Payload-Digest"].removeprefix("sha1:")}
        sha, number, so_far = hashlib.sha1(), 0, 0
        while True:
            data = source.take(min(chunk, left)) if left else b""
            sha.update(data)
            left -= len(data)
            so_far += len(data)
            digest = base64.b32encode(sha.digest()).decode()
            if not left and base["record_type"] == "response" and digest != base["payload_digest"]:
                raise ValueError(f"{path}: payload of {base['record_id']} is not what its digest says")
            yield base | {"chunk_no": number, "data": data, "bytes_so_far": so_far, "digest_so_far": digest, "is_last": not left}
            number += 1
            if not left:
                break
        if source.take(4) != b"\r\n\r\n":
            raise ValueError(f"{path}: a record doesn't end where its length says")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("chunk_no", pa.int32()), ("data", pa.binary()), ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string()), ("is_last", pa.bool_()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])
    for batch in batches:
        for path in batch.column("archive").to_pylist():
            rows, size = [], 0
            for row in records(path):
                rows.append(row)
                size += len(row["data"]) + 500
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)


def read(archives: DataFrame) -> DataFrame:
    """The chunked record table of the archives whose paths are in column archive."""
    n = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return archives.select("archive").repartition(n, "archive").mapInArrow(_reader, CHUNKS)


def report(chunks: DataFrame) -> DataFrame:
    """A row for each record, from its last chunk: size and digest of the full payload."""
    response = F.col("record_type") == "response"
    return chunks.filter("is_last").select(
        "page_id",
        F.when(response, F.col("bytes_so_far")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(response, F.col("digest_so_far")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


def oracle() -> str:
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    letters = " || ".join(f"substr('{alphabet}', ((('0x' || substr(h, {5 * j + 1}, 5))::INT >> {s}) & 31) + 1, 1)" for j in range(8) for s in (15, 10, 5, 0))
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
h AS (SELECT page_id, octet_length(encode(t))::BIGINT AS payload_bytes, sha1(t) AS h FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h, payload_bytes) AS first FROM h)
SELECT page_id, payload_bytes, {letters} AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to
FROM f"""
