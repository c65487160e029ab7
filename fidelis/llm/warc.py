"""WARC archives: a writer with revisit records and a sequential, verifying reader.

Every record is one gzip member.  The reader decompresses incrementally, member by member,
cuts records by ``Content-Length`` and checks the block and payload digests; a truncated or
changed archive raises instead of losing records.  Archives and the table that lists them lie
in the shared folder, so any executor can read what another wrote; a file's name holds the
task attempt and the list names only files of attempts that succeeded.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fidelis.session import checkpoint_dir

VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
ARCHIVE_BYTES = 64 << 20
CHUNK = 256 << 10


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


# ------------------------------------------------------------------ records

@dataclass(frozen=True)
class Record:
    headers: dict[str, str]  # names in lower case
    block: bytes
    offset: int  # of its gzip member in the archive

    @property
    def payload(self) -> bytes:
        """The block of an http record after its http headers, else the block."""
        if self.headers.get("content-type", "").startswith("application/http"):
            return self.block.partition(b"\r\n\r\n")[2]
        return self.block

    def http(self, name: str) -> str | None:
        head = self.block.partition(b"\r\n\r\n")[0].decode("latin-1")
        return next((v.strip() for k, _, v in (x.partition(":") for x in head.split("\r\n")[1:]) if k.strip().lower() == name), None)


def record_bytes(kind: str, record_id: str, url: str, payload: bytes, refers_to: str | None, date: str = DATE) -> bytes:
    """One record as a gzip member; a revisit carries the http headers and digests only."""
    url = re.sub(r"[\r\n]+", " ", url)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date), ("WARC-Target-URI", url),
            ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
            ("WARC-Block-Digest", "sha1:" + digest32(block)), ("WARC-Payload-Digest", "sha1:" + digest32(payload))]
    if refers_to is not None:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{refers_to}>")]
    raw = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def read_records(stream, name: str = "archive") -> Iterator[Record]:
    """Records of one archive in order, holding one record at a time.

    Raises ValueError on a truncated member, a wrong version line, a length that does not fit
    or a digest that does not match.
    """
    data, offset = b"", 0
    while True:
        data = data or stream.read(CHUNK)
        if not data:
            return
        z, parts, used = zlib.decompressobj(31), [], 0
        while not z.eof:
            if not data:
                raise ValueError(f"{name}: truncated gzip member at {offset}")
            try:
                parts.append(z.decompress(data))
            except zlib.error as e:
                raise ValueError(f"{name}: damaged gzip member at {offset}: {e}") from e
            used += len(data) - len(z.unused_data)
            data = z.unused_data if z.eof else stream.read(CHUNK)
        yield _parse(b"".join(parts), name, offset)
        offset += used
        if not data:
            data = stream.read(CHUNK)


def _parse(raw: bytes, name: str, offset: int) -> Record:
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not mark or not lines[0].startswith("WARC/"):
        raise ValueError(f"{name}: no WARC record at {offset}")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(headers.get("content-length", "-1"))
    if n < 0 or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"{name}: Content-Length {n} does not fit the record at {offset}")
    r = Record(headers, rest[:n], offset)
    if headers.get("warc-block-digest", want := "sha1:" + digest32(r.block)) != want:
        raise ValueError(f"{name}: block digest differs at {offset}")
    if headers.get("warc-type") != "revisit" and headers.get("warc-payload-digest", want := "sha1:" + digest32(r.payload)) != want:
        raise ValueError(f"{name}: payload digest differs at {offset}")
    return r


# ------------------------------------------------------------------ Spark

def write_archives(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write every row as a record; return the table of archives (path, records, bytes).

    Of rows with equal payloads the smallest id is the response (rows that repeat that id and
    payload too), the others are revisits of it.  A null html is an empty payload, a null url
    an empty one; a null id is written as ``null`` and is never the response of other rows
    unless all ids of the payload are null.  Only (id, digest) pairs are grouped; each html is
    shuffled once, by its id.
    """
    p = pages.select(F.col(id_col).cast("bigint").alias("__id"), F.coalesce(F.col(url_col), F.lit("")).alias("__url"),
                     F.coalesce(F.col(html_col), F.lit("")).alias("__html")).withColumn("__digest", F.sha1(F.col("__html").cast("binary")))
    narrow = p.select("__id", "__digest")
    first = narrow.groupBy("__digest").agg(F.min("__id").alias("__first"), F.max("__id").alias("__last"), F.count(F.lit(1)).alias("__n"), F.count("__id").alias("__ids"))
    first = first.where("__first < __last or (__ids > 0 and __ids < __n)").select("__digest", "__first")
    # rows that revisit another; distinct, so that repeated rows do not multiply below
    revisit = narrow.join(first, "__digest").where("__id is null or __id > __first").distinct()
    joined = p.join(revisit.withColumnRenamed("__id", "__rid").withColumnRenamed("__digest", "__rd"),
                    F.col("__id").eqNullSafe(F.col("__rid")) & (F.col("__digest") == F.col("__rd")), "left")

    def write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        stem, n = f"{task.partitionId():06d}-{task.taskAttemptId()}", 0
        out, path, rows, size = None, "", 0, 0
        where, base = _filesystem(folder)
        for b in it:
            for i, url, html, ref in zip(*[c.to_pylist() for c in b.columns]):
                if out is None:
                    path, rows, size, n = f"part-{stem}-{n:04d}.warc.gz", 0, 0, n + 1
                    out = where.open_output_stream(f"{base}/{path}", compression=None)
                kind = "response" if ref is None else "revisit"
                member = record_bytes(kind, f"urn:page:{'null' if i is None else i}", url, html.encode(), None if ref is None else f"urn:page:{ref}")
                out.write(member)
                rows, size = rows + 1, size + len(member)
                if size >= archive_bytes:
                    out.close()
                    out = None
                    yield _row(path, rows, size)
        if out is not None:
            out.close()
            yield _row(path, rows, size)

    def _row(path, rows, size):
        return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{path}"]), pa.array([rows], pa.int64()), pa.array([size], pa.int64())], names=["path", "records", "bytes"])

    where, base = _filesystem(folder)
    where.create_dir(base, recursive=True)
    spark = pages.sparkSession
    listing = f"{folder}-list"
    joined.select("__id", "__url", "__html", "__first").mapInArrow(write, "path string, records bigint, bytes bigint").write.parquet(listing)
    return spark.read.parquet(listing)


def read_archives(archives: DataFrame, *, path_col: str = "path") -> DataFrame:
    """One row per record of the listed archives, each archive read front to back by one task."""
    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for path in b.column(0).to_pylist():
                where, inner = _filesystem(path)
                rows = []
                with where.open_input_stream(inner, compression=None) as stream:
                    for r in read_records(stream, path):
                        rows.append(_fields(r))
                        if len(rows) >= 2000:
                            yield _records(rows)
                            rows = []
                yield _records(rows)

    parts = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return archives.select(path_col).repartition(parts, path_col).mapInArrow(read, "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def _number(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def _fields(r: Record) -> tuple:
    revisit = r.headers["warc-type"] == "revisit"
    size = int(r.http("content-length")) if revisit else len(r.payload)
    return (_number(r.headers["warc-record-id"]), r.headers.get("warc-target-uri"), size, r.headers["warc-payload-digest"].removeprefix("sha1:"),
            r.headers["warc-type"], _number(r.headers.get("warc-refers-to")))


def _records(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * 6
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)],
                                      names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def archive_folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
