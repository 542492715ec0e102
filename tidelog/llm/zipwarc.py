"""WARC records in ZIP archives, read by range.

An archive is a ZIP file with two stored members: ``archive/data.warc.gz``, a
gzip member for each record, and ``indexes/index.cdxj``, a line for each record
with its offset and length in the first.  A reader takes the end of the file,
the ZIP64 records where there are any, and the central directory; that gives the
place of both members.  Records are then read by range; nothing is extracted.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import join_side, pages, scratch_path, small_batches, stored

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
LEAST_REVISIT = 100
#: An archive is closed after so many bytes of records; a range read takes so many at most (or one record).
ARCHIVE_BYTES = 128 << 20
RANGE_BYTES, RANGE_RECORDS = 4 << 20, 500
DATE = "2024-01-01T00:00:00Z"

MANIFEST = "archive string, records long, bytes long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


#: Schemes of Hadoop's connectors for stores that the file system library knows by another name.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "wasb": "abfs", "wasbs": "abfs", "viewfs": "hdfs"}


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI and the path there; an error that names the scheme if there is none."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    scheme, rest = uri.split("://", 1)
    try:
        return pafs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}")
    except (pa.ArrowInvalid, OSError) as e:
        raise ValueError(f"archives can't be written to {scheme}:// from Python workers; name another shared folder") from e


def page_uri(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def page_of(uri: str) -> int | None:
    number = uri.removeprefix("<urn:x-page:").removesuffix(">")
    return int(number) if number else None


def header_value(text: str) -> str:
    """A value that can't end its header line; undone by the reader."""
    return text.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    """A WARC record; a revisit has the HTTP header alone, with the full payload's length."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {page_uri(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {header_value(url)}")
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {page_uri(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The columns of RECORDS from a record; a response's digest is made from its payload and held against its header."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    refers = fields.get("WARC-Refers-To")
    if refers is None and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't fit its digest")
    url = fields.get("WARC-Target-URI")
    return {
        "page_id": page_of(fields["WARC-Record-ID"]),
        "url": None if url is None else url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": None if refers is None else page_of(refers),
    }


class ArchiveWriter:
    """One archive under a temporary name, moved to its own when it is whole."""

    def __init__(self, store: pafs.FileSystem, path: str):
        self.store, self.path, self.part = store, path, f"{path}.part"
        self.raw = store.open_output_stream(self.part)
        self.zip = zipfile.ZipFile(self.raw, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.lines: list[str] = []
        self.at = 0

    def add(self, page_id: int | None, raw: bytes) -> None:
        packer = zlib.compressobj(4, zlib.DEFLATED, 31)
        packed = packer.compress(raw) + packer.flush()
        self.data.write(packed)
        self.lines.append(f"{page_uri(page_id)} 20240101000000 {json.dumps({'offset': self.at, 'length': len(packed)})}\n")
        self.at += len(packed)

    def close(self) -> tuple[str, int, int]:
        self.data.close()
        with self.zip.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as index:
            index.write("".join(self.lines).encode())
        self.zip.close()
        self.raw.close()
        self.store.move(self.part, self.path)
        return self.path, len(self.lines), self.at


def directory(f: pa.NativeFile, size: int) -> dict[str, tuple[int, int]]:
    """name -> (where its bytes begin, how many) of the stored members of a ZIP file."""

    def at(offset: int, n: int) -> bytes:
        f.seek(offset)
        return f.read(n)

    tail = at(max(0, size - 65_557), min(size, 65_557))  # the end record and the longest comment
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    n, length, start = struct.unpack_from("<10xHII", tail, end)
    locator = end - 20
    if locator >= 0 and tail[locator : locator + 4] == b"PK\x06\x07":
        (end64,) = struct.unpack_from("<8xQ", tail, locator)
        n, length, start = struct.unpack("<32xQQQ", at(end64, 56))
    listing, out, p = at(start, length), {}, 0
    for _ in range(n):
        if listing[p : p + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, packed, plain, n_name, n_extra, n_comment, where = struct.unpack_from("<10xH8xIIHHH8xI", listing, p)
        name = listing[p + 46 : p + 46 + n_name].decode("utf-8")
        extra = listing[p + 46 + n_name : p + 46 + n_name + n_extra]
        while len(extra) >= 4:  # the ZIP64 field has those of the sizes and the place that don't fit
            kind, span = struct.unpack_from("<HH", extra)
            if kind == 1:
                wide = iter(struct.unpack_from(f"<{span // 8}Q", extra, 4))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                where = next(wide) if where == 0xFFFFFFFF else where
            extra = extra[4 + span :]
        if method == 0:
            n_name2, n_extra2 = struct.unpack("<26xHH", at(where, 30))
            out[name] = (where + 30 + n_name2 + n_extra2, packed)
        p += 46 + n_name + n_extra + n_comment
    return out


def ranges(uri: str, archive: str) -> Iterator[tuple[str, int, list[int]]]:
    """(archive, first byte, record lengths) of neighbouring records, from the index of an archive."""
    store, _ = filesystem(uri)
    with store.open_input_file(archive) as f:
        members = directory(f, f.size())
        base, _ = members[DATA]
        at, n = members[INDEX]
        f.seek(at)
        lines = f.read(n).decode().splitlines()
    first, lengths = base, []
    for line in lines:
        entry = json.loads(line.split(" ", 2)[2])
        if lengths and (entry["offset"] + base != first + sum(lengths) or len(lengths) >= RANGE_RECORDS or sum(lengths) + entry["length"] > RANGE_BYTES):
            yield archive, first, lengths
            lengths = []
        if not lengths:
            first = base + entry["offset"]
        lengths.append(entry["length"])
    if lengths:
        yield archive, first, lengths


def with_revisits(table: DataFrame) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, refers_to of every page; html is empty for revisits.

    Of pages with equal payloads of at least 100 bytes those with the smallest
    page_id are responses (all of them, if it is repeated) and the others revisit
    it; a page without an id revisits one that has one.
    """
    html = F.coalesce("html", F.lit("")).cast("binary")
    size, digest = F.octet_length(html).cast("long").alias("payload_bytes"), F.sha2(html, 256).alias("payload_digest")
    long = table.select("page_id", size, digest).filter(F.col("payload_bytes") >= LEAST_REVISIT)
    first = long.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first is not null").drop("n")
    every = table.select("page_id", "url", html.alias("html"), size, digest)
    # digests that come once aren't in the side, whose rows are one for each digest; what repeats may be one error page on many hosts
    joined = join_side(every, stored(first, "warc-first"), ["payload_digest"], F.lit(72), "left")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") > F.col("first")), F.col("first"))
    joined = joined.withColumn("refers_to", refers)
    return joined.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("html")).otherwise(F.lit("").cast("binary")).alias("html"), "payload_bytes", "payload_digest", "refers_to")


def write(table: DataFrame, uri: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record for each page into archives below uri; returns their manifest.

    Each attempt of a task writes archives of its own, and the manifest names
    those of the attempts that counted, so what a lost or doubled attempt left
    is never read.  Memory holds a batch of pages and one archive's index.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = filesystem(uri)
        store.create_dir(folder, recursive=True)
        task, own, made = TaskContext.get(), None, []
        for b in batches:
            for r in b.to_pylist():
                if own is None:
                    own = ArchiveWriter(store, f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(made):04d}.wacz")
                own.add(r["page_id"], record(r["page_id"], r["url"], r["html"], r["payload_bytes"], r["payload_digest"], r["refers_to"]))
                if own.at >= archive_bytes:
                    made.append(own.close())
                    own = None
        if own is not None:
            made.append(own.close())
        yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["archive", "records", "bytes"])

    small_batches(table.sparkSession)
    return stored(with_revisits(table).mapInArrow(run, MANIFEST), "warc-manifest")


def read(manifest: DataFrame, uri: str) -> DataFrame:
    """The records of the archives of a manifest: every range is read by its own row, over all tasks."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive in b.column(0).to_pylist():
                found = list(ranges(uri, archive))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[k] for x in found], t) for k, t in enumerate((pa.string(), pa.int64(), pa.list_(pa.int64())))], ["archive", "first", "lengths"]
                )

    names = [c.split()[0] for c in RECORDS.split(", ")]
    schema = pa.schema([(n, pa.string() if n in ("url", "payload_digest", "record_type") else pa.int64()) for n in names])

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = filesystem(uri)
        for b in batches:
            for r in b.to_pylist():
                with store.open_input_file(r["archive"]) as f:
                    f.seek(r["first"])
                    raw = f.read(sum(r["lengths"]))
                rows, p = [], 0
                for n in r["lengths"]:
                    rows.append(parse(zlib.decompress(raw[p : p + n], 31)))
                    p += n
                yield pa.RecordBatch.from_pylist(rows, schema)

    small_batches(manifest.sparkSession)
    listed = manifest.select("archive").repartition("archive").mapInArrow(places, "archive string, first long, lengths array<long>")
    return listed.repartition("archive", "first").mapInArrow(load, RECORDS)


def op9_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page into ZIP-packed archives and read them back.

    A null html is an empty payload; repeated rows are written as often; an
    empty table gives no rows.  Columns besides page_id, url and html aren't read.
    """
    uri = scratch_path(spark, "warc")
    manifest = write(pages(spark, sf_dir).select("page_id", "url", "html"), uri)
    return read(manifest, uri).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: DuckDB SQL for the same rows.
ORACLE_SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p
), r AS (
  SELECT *, CASE WHEN payload_bytes >= 100 AND (page_id > first OR page_id IS NULL) THEN first END AS refers_to FROM f
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM r
"""
