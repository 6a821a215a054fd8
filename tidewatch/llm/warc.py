"""WARC archives as a chunked record table.

Payloads are streamed as rows (record id, chunk number, bytes) from the source on: Spark cuts a payload into chunks of fixed
size, a task writes chunk after chunk and builds the record's digest up on the way. Reading gives such rows again, each with
the length so far, the last one with the digest. Neither writing nor reading ever holds a whole record or archive in Python.
Archives are WARC/1.1 files of one gzip member per record, so that any reader can start at a record; responses hold an HTTP
header before the payload, as readers of http records expect it, and digests are of the payload alone.

Equal payloads of at least ``revisit_bytes`` are stored once: the row with the largest id is the response, the others
become revisit records that name it. Smaller payloads are all responses. Which payloads are equal is decided on digests
made in Spark; the digest that a task builds up has to be the same one.

Null and empty payloads are records of length zero. A row without id gets a record too, but is never a revisit nor named
by one. Rows that repeat an id and payload are all responses if the id is the largest, and revisits of it otherwise. An
empty table writes no file. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm._common import fresh_path, materialise, slices

REVISIT_BYTES = 1000
CHUNK_BYTES = 1 << 20
#: Duplicated payloads (some 100 bytes each) that are broadcast at most; more are joined by digest.
BROADCAST_COPIES = 200_000
#: A fixed namespace, so that a record written again by another executor has the same id.
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

CHUNKS = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("chunk", T.LongType()),
        T.StructField("page_id", T.LongType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("data", T.BinaryType()),
        T.StructField("bytes_so_far", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("declared_digest", T.StringType()),
        T.StructField("declared_bytes", T.LongType()),
    ]
)


def decide(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", revisit_bytes: int = REVISIT_BYTES, url_col: str = "url") -> DataFrame:
    """(id, url, payload, digest, record_type, refers_to). Payloads stay where they are: only digests and ids of large ones
    are shuffled."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = rows.filter((F.octet_length("payload") >= revisit_bytes) & F.col("id").isNotNull())
    copies = large.groupBy("digest").agg(F.max("id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    copies = materialise(copies, "payload-copies")
    few = copies.limit(BROADCAST_COPIES + 1).count() <= BROADCAST_COPIES
    rows = rows.join(F.broadcast(copies) if few else copies, "digest", "left")
    again = F.coalesce(F.col("first") > F.col("id"), F.lit(False))
    return rows.select("id", "url", "payload", "digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"))


def _record_id(page_id: int | None, url: str | None, digest: str) -> str:
    """Of a row with id, by id and digest, so that a revisit can name its response."""
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{url if page_id is None else page_id} {digest}')}>"


def _uri(url: str | None) -> str:
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "")


def _http_head(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def _head(page_id: int | None, url: str | None, digest: str, kind: str, refers_to: int | None, size: int, date: str) -> bytes:
    """The header block and, of a response, the HTTP header; what they say of the payload is of the full one, for revisits too."""
    http = _http_head(size)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {_record_id(page_id, url, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_uri(url)}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {size}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + (size if kind == 'response' else 0)}",
    ]
    if kind == "revisit":
        lines[5:5] = [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to, None, digest)}", f"X-Refers-To-Page-Id: {refers_to}",
        ]
    return ("\r\n".join(lines) + "\r\n\r\n").encode("utf-8") + http


class _Archive:
    """A file of one gzip member per record, written chunk by chunk under a passing name."""

    def __init__(self, fs: pafs.FileSystem, name: str, level: int):
        self.fs, self.name, self.level, self.records, self.at = fs, name, level, 0, 0
        self.out = fs.open_output_stream(f"{name}.part", compression=None)

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, head: bytes, digest: str) -> None:
        self.zipped, self.declared, self.sha1 = zlib.compressobj(self.level, zlib.DEFLATED, 31), digest, hashlib.sha1()
        self._write(self.zipped.compress(head))

    def add(self, chunk: memoryview) -> None:
        self.sha1.update(chunk)
        self._write(self.zipped.compress(chunk))

    def end(self, whole: bool) -> None:
        if whole and self.sha1.hexdigest() != self.declared:
            raise ValueError(f"the digest built up over a record's chunks isn't that of its payload, {self.declared}")
        self._write(self.zipped.compress(b"\r\n\r\n") + self.zipped.flush())
        self.records += 1

    def close(self) -> None:
        self.out.close()
        self.fs.move(f"{self.name}.part", self.name)


def _chunk_rows(decided: DataFrame) -> DataFrame:
    """A row for each chunk of a response, and one without bytes for a revisit; a record's rows stand together, in order."""
    size = F.octet_length("payload").cast("long")
    last = F.when(F.col("record_type") == "response", F.greatest(F.ceil(size / CHUNK_BYTES) - 1, F.lit(0))).otherwise(0).cast("int")
    rows = decided.select("id", "url", "digest", "record_type", "refers_to", size.alias("size"), last.alias("last"), "payload", F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
    data = F.when(F.col("record_type") == "response", F.substring("payload", F.col("chunk") * CHUNK_BYTES + 1, F.lit(CHUNK_BYTES))).otherwise(F.lit(b""))
    return rows.select("id", "url", "digest", "record_type", "refers_to", "size", "last", "chunk", data.alias("data"))


def write(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_bytes: int = REVISIT_BYTES, date: str = "2024-01-01T00:00:00Z", level: int = 1
) -> DataFrame:
    """Writes an archive per task into a folder that all executors reach, and returns the table of archives (path, records,
    bytes). A task writes under a name of its own and renames at its end, so a lost or repeated task leaves no half file in
    the table; names of attempts that Spark didn't count are never listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        archive = None
        for batch in slices(batches):
            columns, chunks = [batch.column(i).to_pylist() for i in range(8)], batch.column(8)
            for i, (page_id, url, digest, kind, refers_to, size, last, number) in enumerate(zip(*columns)):
                archive = archive or _Archive(fs, f"{base}/{uuid.uuid4().hex}.warc.gz", level)
                if not number:
                    archive.begin(_head(page_id, url, digest, kind, refers_to, size, date), digest)
                archive.add(memoryview(chunks[i].as_buffer()))
                if number == last:
                    archive.end(kind == "response")
        if archive:
            archive.close()
            yield pa.RecordBatch.from_arrays([pa.array([archive.name]), pa.array([archive.records]), pa.array([archive.at])], ["path", "records", "bytes"])

    rows = _chunk_rows(decide(pages, id_col, payload_col, revisit_bytes, url_col))
    return materialise(rows.mapInArrow(run, "path string, records long, bytes long"), "warc-files")


class _Inflated:
    """Reads a file of gzip members as one stream, in bounded pieces."""

    def __init__(self, raw):
        self.raw, self.z, self.held, self.left = raw, zlib.decompressobj(31), b"", b""

    def fill(self) -> bool:
        while True:
            data = self.left or self.raw.read(CHUNK_BYTES)
            if not data:
                return False
            if self.z.eof:
                self.z = zlib.decompressobj(31)
            out = self.z.decompress(data, CHUNK_BYTES)
            self.left = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            if out:
                self.held += out
                return True

    def upto(self, mark: bytes) -> bytes | None:
        while (at := self.held.find(mark)) < 0:
            if not self.fill():
                return None
        out, self.held = self.held[:at], self.held[at + len(mark) :]
        return out

    def some(self, most: int) -> bytes:
        if not self.held and not self.fill():
            raise EOFError("the archive ends inside a record")
        out, self.held = self.held[:most], self.held[most:]
        return out


def read_records(raw: io.RawIOBase, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple]:
    """Rows of CHUNKS from one archive; a record has one row at least."""
    source = _Inflated(raw)
    while (head := source.upto(b"\r\n\r\n")) is not None:
        own = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode("utf-8").strip().split("\r\n")[1:])
        left, digest, size, number = int(own["Content-Length"]), hashlib.sha1(), 0, 0
        page_id, refers = own["X-Page-Id"], own.get("X-Refers-To-Page-Id")
        declared = base64.b32decode(own["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        if own.get("Content-Type", "").startswith("application/http"):
            if (http := source.upto(b"\r\n\r\n")) is None:
                raise EOFError("the archive ends inside a record")
            left -= len(http) + 4
        fixed = (int(page_id) if page_id else None, own["WARC-Type"], int(refers) if refers else None)
        while True:
            pieces, got = [], 0
            while got < min(left, chunk_bytes):
                piece = source.some(min(left, chunk_bytes) - got)
                pieces.append(piece)
                got += len(piece)
                digest.update(piece)
            left, size = left - got, size + got
            yield own["WARC-Record-ID"], number, *fixed, b"".join(pieces), size, None if left else digest.hexdigest(), declared, int(own["X-Payload-Length"])
            number += 1
            if not left:
                break
        if source.upto(b"\r\n\r\n") != b"":
            raise ValueError("a record doesn't end where it says")


def read(spark: SparkSession, files: DataFrame, folder: str) -> DataFrame:
    """The chunk table of the archives in files (column path); each task streams its own archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, size = [], 0
                with fs.open_input_stream(path, compression=None) as raw:
                    for row in read_records(raw):
                        rows.append(row)
                        size += len(row[5])
                        if size >= 4 * CHUNK_BYTES or len(rows) >= 2000:
                            yield _batch(rows)
                            rows, size = [], 0
                if rows:
                    yield _batch(rows)

    n = max(1, files.count())
    return files.select("path").repartition(n, "path").mapInArrow(run, CHUNKS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], CHUNKS.fieldNames())


def record_table(chunks: DataFrame) -> DataFrame:
    """One row for each record from its last chunk, where length and digest are complete; payloads aren't gathered. Of a
    revisit, length and digest are those that its header declares for the full payload. A response whose digest isn't the
    declared one is an error."""
    last = chunks.filter(F.col("payload_digest").isNotNull())
    is_response = F.col("record_type") == "response"
    sound = F.when(~is_response | (F.col("payload_digest") == F.col("declared_digest")), F.col("declared_digest"))
    digest = F.coalesce(sound, F.raise_error(F.concat(F.lit("payload digest differs in "), F.col("record_id"))))
    return last.select(
        "record_id", "page_id", F.when(is_response, F.col("bytes_so_far")).otherwise(F.col("declared_bytes")).alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to"
    )


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes archives of all pages into a fresh folder and reads them back."""
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")
    return record_table(read(spark, write(pages, folder), folder))
