"""WARC archives: writing captures, reading records, and assembling each capture's transaction."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import in_batches, materialise, shared_path, small

#: Payloads of at least this many bytes are stored once; later ones refer to it.
REVISIT_BYTES = 1000
#: An archive is closed once it holds this many compressed bytes.
ARCHIVE_BYTES = 64 << 20
_DATE = "2024-01-01T00:00:00Z"
_CRLF = b"\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = "path string, records long, bytes long"
_RECORD = (
    "record_id string, type string, concurrent_to string, refers_to string, target_uri string, date string, content_type string,"
    " declared_sha1 string, http_start string, http_length long, payload binary, payload_bytes long, payload_sha1 string, fields map<string,string>"
)


def record_id(kind: str, page: int | None, place: str = "") -> str:
    """A stable urn:uuid for the record of a kind of a page (and of a place, where the id is null or not unique)."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}/{page}/{place}')}>"


def base32_digest(sha1_hex: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def hex_digest(declared: str | None) -> str | None:
    """Lower-case hex of a ``sha1:`` header, which archives write in base32 or hex."""
    name, _, value = (declared or "").partition(":")
    if name.lower() != "sha1":
        return None
    return base64.b32decode(value.upper()).hex() if len(value) == 32 else value.lower()


def encode_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC/1.1 record as its own gzip member. Line ends in a header value become spaces."""
    lines = [b"WARC/1.1", *(f"{k}: {' '.join(v.split())}".encode() for k, v in headers), b"Content-Length: %d" % len(block)]
    return gzip.compress(_CRLF.join(lines) + _CRLF * 2 + block + _CRLF * 2, 3, mtime=0)


def capture_records(page: int | None, place: str, url: str | None, payload: bytes, revisit_of: int | None, sha1_hex: str) -> list[bytes]:
    """The request, the response or revisit, and the metadata record of one capture; the first and last are concurrent to the second."""
    url = " ".join((url or "urn:none").split())
    main = record_id("capture", page, place)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    common = [("WARC-Target-URI", url), ("WARC-Date", _DATE)]
    kept = [("WARC-Record-ID", main), *common, ("WARC-Payload-Digest", base32_digest(sha1_hex)), ("Content-Type", "application/http; msgtype=response")]
    if revisit_of is None:
        second = encode_record([("WARC-Type", "response"), *kept], head + payload)
    else:
        second = encode_record([("WARC-Type", "revisit"), *kept, ("WARC-Refers-To", record_id("capture", revisit_of)), ("WARC-Profile", _PROFILE)], head)
    ask = f"GET {url} HTTP/1.1\r\n\r\n".encode()
    first = encode_record([("WARC-Type", "request"), ("WARC-Record-ID", record_id("request", page, place)), *common, ("WARC-Concurrent-To", main), ("Content-Type", "application/http; msgtype=request")], ask)
    note = "".join(f"{k}: {v}\r\n" for k, v in (("page_id", page), ("refers_to_page", revisit_of)) if v is not None).encode()
    third = encode_record([("WARC-Type", "metadata"), ("WARC-Record-ID", record_id("metadata", page, place)), *common, ("WARC-Concurrent-To", main), ("Content-Type", "application/warc-fields")], note)
    return [first, second, third]


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, by pyarrow; Hadoop's names for S3 are taken as that."""
    for name in ("s3a://", "s3n://"):
        path = "s3://" + path.removeprefix(name) if path.startswith(name) else path
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def payload_keys(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(sha1, bytes, keep): each payload of at least ``REVISIT_BYTES`` that occurs more than once, with its largest id."""
    data = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    each = pages.select(F.col(id_col).cast("long").alias("page_id"), F.sha1(data).alias("sha1"), F.length(data).alias("bytes")).filter(F.col("bytes") >= REVISIT_BYTES)
    return each.groupBy("sha1", "bytes").agg(F.max("page_id").alias("keep"), F.count("*").alias("n")).filter("n > 1 AND keep IS NOT NULL").drop("n")


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write every page's capture to gzipped WARC files below ``folder`` (shared, any file system pyarrow opens) and return
    the manifest (path, records, bytes).

    Of equal payloads of at least ``REVISIT_BYTES`` the capture with the largest id holds the payload. A file is written
    under a name of its task attempt and counts only through its manifest row, so a lost or repeated attempt leaves no
    record twice. Payloads stay in their partition unless the list of repeated ones is too large to broadcast.
    """
    data = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), data.alias("payload")).withColumn("sha1", F.sha1("payload"))
    repeated = materialise(payload_keys(pages, id_col, html_col), "payloads").select(F.col("sha1").alias("_sha1"), F.col("bytes").alias("_bytes"), "keep")
    ids = pages.groupBy(F.col(id_col).cast("long").alias("_page")).count().filter("count > 1 AND _page IS NOT NULL")
    twice = materialise(ids.select("_page", F.lit(True).alias("twice")), "twice")
    joined = slim.join(small(repeated), (F.col("sha1") == F.col("_sha1")) & (F.length("payload") == F.col("_bytes")), "left").join(small(twice), F.col("page_id") == F.col("_page"), "left")
    joined = joined.select("page_id", "url", "payload", "sha1", "keep", F.col("twice").isNull().alias("single"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        stem = f"{context.partitionId():05d}-{context.taskAttemptId()}" if context else uuid.uuid4().hex
        fs, base = _filesystem(folder)
        fs.create_dir(base, recursive=True)
        out, name, size, number, rows, place = None, "", 0, 0, 0, 0
        done: list[tuple[str, int, int]] = []
        for batch in batches:
            for k in range(batch.num_rows):
                if out is None:
                    name, size, rows = f"part-{stem}-{number:04d}.warc.gz", 0, 0
                    out, number = fs.open_output_stream(f"{base}/{name}", compression=None), number + 1
                page, url, payload, sha1, keep, single = (batch.column(c)[k].as_py() for c in range(6))
                of = keep if keep is not None and keep != page else None
                for record in capture_records(page, "" if single and page is not None else f"{stem}/{place}", url, payload, of, sha1):
                    out.write(record)
                    size, rows = size + len(record), rows + 1
                place += 1
                if size >= ARCHIVE_BYTES:
                    out.close()
                    done.append((f"{folder}/{name}", rows, size))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", rows, size))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), *(pa.array([d[c] for d in done], pa.int64()) for c in (1, 2))], names=["path", "records", "bytes"])

    return materialise(in_batches(joined, run, _MANIFEST), "manifest")


def _members(stream: pa.NativeFile, step: int = 1 << 20) -> Iterator[bytes]:
    """The decompressed content of a gzip file, in bounded parts; a plain file as it is."""
    first = stream.read(step)
    if first[:2] != b"\x1f\x8b":
        while first:
            yield first
            first = stream.read(step)
        return
    inflate, data = zlib.decompressobj(31), first
    while data:
        yield inflate.decompress(data, step)
        data = inflate.unconsumed_tail or inflate.unused_data
        if inflate.eof:
            inflate = zlib.decompressobj(31)
        elif not data:  # the inner buffer may still hold output of input that is used up
            while part := inflate.decompress(b"", step):
                yield part
        if not data:
            data = stream.read(step)


class _Reader(io.RawIOBase):
    def __init__(self, parts: Iterator[bytes]) -> None:
        self.parts, self.rest = parts, memoryview(b"")

    def readable(self) -> bool:
        return True

    def readinto(self, buffer: memoryview) -> int:
        while not self.rest:
            part = next(self.parts, None)
            if part is None:
                return 0
            self.rest = memoryview(part)
        n = min(len(buffer), len(self.rest))
        buffer[:n] = self.rest[:n]
        self.rest = self.rest[n:]
        return n


def parse_records(source: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record. An incomplete last record ends the file; it comes out with what
    there is of its block and the type ``truncated``."""
    while line := source.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := source.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers.get("content-length", 0))
        block = source.read(size)
        yield headers | {"warc-type": "truncated"} if len(block) < size else headers, block


def _row(headers: dict[str, str], block: bytes) -> dict:
    kind, content = headers.get("warc-type"), headers.get("content-type", "")
    row = {"record_id": headers.get("warc-record-id"), "type": kind, "concurrent_to": headers.get("warc-concurrent-to"), "refers_to": headers.get("warc-refers-to"), "target_uri": headers.get("warc-target-uri")}
    row |= {"date": headers.get("warc-date"), "content_type": content or None, "declared_sha1": hex_digest(headers.get("warc-payload-digest")), "http_start": None, "http_length": None, "fields": []}
    payload = block
    if content.startswith("application/http"):
        head, _, payload = block.partition(_CRLF * 2)
        start, *lines = head.decode("utf-8", "replace").split("\r\n")
        http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        row |= {"http_start": start, "http_length": int(http["content-length"]) if http.get("content-length", "").isdigit() else None}
    elif content.startswith("application/warc-fields"):
        row["fields"] = list({k.strip(): v.strip() for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n") if x.strip())}.items())
    return row | {"payload": payload, "payload_bytes": len(payload), "payload_sha1": hashlib.sha1(payload).hexdigest()}


_ARROW = pa.schema(
    [(n, pa.string()) for n in ("record_id", "type", "concurrent_to", "refers_to", "target_uri", "date", "content_type", "declared_sha1", "http_start")]
    + [("http_length", pa.int64()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_sha1", pa.string()), ("fields", pa.map_(pa.string(), pa.string()))]
)


def read_archives(manifest: DataFrame, with_payload: bool = True, rows_at_once: int = 256) -> DataFrame:
    """One row per record of the files named in column ``path``, streamed record by record (plain or gzipped); the incomplete last
    record of a cut file has the type ``truncated`` and belongs to no capture.

    Without payloads that column is null (sizes and digests are still those of the bytes read).
    """
    files = max(1, manifest.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = _filesystem(path)
                with fs.open_input_stream(at, compression=None) as stream:
                    rows, held = [], 0
                    for headers, block in parse_records(io.BufferedReader(_Reader(_members(stream)), 1 << 20)):
                        row = _row(headers, block)
                        rows.append(row if with_payload else row | {"payload": None})
                        held += len(block)
                        if len(rows) >= rows_at_once or held > 32 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    dealt = manifest.select("path").repartition(min(files, 10_000)) if files > 1 else manifest.select("path")
    return in_batches(dealt, run, _RECORD)


def assemble_transactions(records: DataFrame) -> DataFrame:
    """One nested row per capture: record_id, request, response, metadata (structs; null where there is none).

    A capture is a response, revisit or resource record; a request or metadata record belongs to it if it is concurrent
    to it, or it to the request. Where several claim one capture the one with the smallest id is taken; those that claim
    none are left out. Two equi-joins on record ids, which are unique: no hot key, and columns that a caller does not use
    (the payload) are not shuffled.
    """
    held = [f.name for f in records.schema if f.name not in ("record_id", "type")]
    main = records.filter(F.col("type").isin("response", "revisit", "resource"))
    back = main.filter("concurrent_to IS NOT NULL").select(F.col("concurrent_to").alias("other"), F.col("record_id").alias("claimed"))

    def side(kind: str) -> DataFrame:
        rows = records.filter(F.col("type") == kind)
        direct = rows.filter("concurrent_to IS NOT NULL").select(F.col("concurrent_to").alias("key"), F.struct("record_id", *held).alias(kind))
        named = rows.join(back, F.col("record_id") == F.col("other")).select(F.col("claimed").alias("key"), F.struct("record_id", *held).alias(kind))
        one = direct.unionByName(named).withColumn("_id", F.col(f"{kind}.record_id"))
        return one.groupBy("key").agg(F.min("_id").alias("_least")).withColumnRenamed("key", "_key").join(one, (F.col("_key") == F.col("key")) & (F.col("_least") == F.col("_id"))).dropDuplicates(["key"]).select(F.col("key").alias(f"_{kind}"), kind)

    out = main.select("record_id", F.struct("type", *held).alias("response"))
    for kind in ("request", "metadata"):
        out = out.join(side(kind), F.col("record_id") == F.col(f"_{kind}"), "left").drop(f"_{kind}")
    return out.select("record_id", "request", "response", "metadata")


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", folder: str | None = None) -> DataFrame:
    """Write every page's transaction to archives, read them back, and return the assembled captures (``record_id, request,
    response, metadata``) without payloads.

    Null html is an empty payload, a null url ``urn:none``. Of rows that repeat one id with an equal payload of at least
    ``REVISIT_BYTES`` all are responses if the id is the largest of that payload; null ids never hold a payload for others.
    An empty table writes no archive and gives an empty result. Other columns are ignored.
    """
    manifest = write_archives(pages, folder or shared_path(pages.sparkSession, "warc"), id_col, url_col, html_col)
    records = materialise(read_archives(manifest, with_payload=False), "records")
    written, read = manifest.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0], records.filter("type <> 'truncated'").count()
    if written != read:
        raise RuntimeError(f"{written} records were written, {read} read back")
    return assemble_transactions(records)


def capture_digests(captures: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of assembled captures: a response's size and digest
    are those of the bytes read back, a revisit's those its headers declare for the full payload."""
    full = F.col("response.type") != "revisit"
    number = lambda k: F.element_at("metadata.fields", k).cast("long")
    return captures.select(
        number("page_id").alias("page_id"),
        F.when(full, F.col("response.payload_bytes")).otherwise(F.col("response.http_length")).alias("payload_bytes"),
        F.when(full, F.col("response.payload_sha1")).otherwise(F.col("response.declared_sha1")).alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.when(~full, number("refers_to_page")).alias("refers_to"),
    )
