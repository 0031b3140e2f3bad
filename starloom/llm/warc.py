"""WARC archives: a writer of one gzip member a record, and a splittable reader.

Tasks of the reader get byte ranges. A task looks for the gzip magic from its
range's start, takes a candidate for a record only if it inflates to a whole
WARC header, and then owns every record that starts inside its range, the last
of them read to its end. Files are reached through Arrow's file systems, so any
store with a URI serves.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm.common import Workspace, small

#: Bytes of a reader's range and of a read, and ranges of a task at most.
SPLIT, CHUNK, RANGES = 8 << 20, 1 << 18, 64
#: Payloads from this size on are written once.
REVISIT_BYTES = 1000
MAGIC = b"\x1f\x8b\x08"
#: Bytes inflated at a time: what lies behind a member's end is handed back, and so copied.
PIECE = 1 << 14
#: Names that Spark has for stores which Arrow knows by another.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}
FIRST = (b"WARC/1.0\r\n", b"WARC/1.1\r\n")
DATE = "2000-01-01T00:00:00Z"


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    scheme, mark, rest = uri.partition("://")
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}") if mark else (fs.LocalFileSystem(), uri)


def _uuid(*parts: object) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(repr(parts).encode(), usedforsecurity=False).digest())}>"


def _line(value: str) -> str:
    return "".join(c if " " <= c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, salt: str = "") -> bytes:
    """One record, compressed as a member of its own."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_uuid(page_id, digest, salt) if revisit else _uuid(page_id, digest)}", f"WARC-Date: {DATE}"]
    head += [f"WARC-Target-URI: {_line(url) if url else f'urn:page:{page_id}'}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_uuid(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    if page_id is not None:
        head.append(f"X-Page: {page_id}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + packer.flush()


def write(pages: DataFrame, directory: str, ws: Workspace, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = REVISIT_BYTES) -> DataFrame:
    """Writes an archive a task and returns (path, bytes, records) of those that count, written.

    Of equal payloads of at least ``least`` bytes the row with the greatest id is
    the response and the others revisit it; rows that repeat id and payload are
    responses all. Null payloads are empty; a null id is less than any other.
    A task that is run again writes another file; only the files in the returned
    table belong to the result. No rows: no records.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    own = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    groups = own.filter(F.octet_length("payload") >= least).groupBy("digest").agg(F.count("*").alias("m"), F.max("id").alias("last")).filter("m > 1").select("digest", "last", F.lit(True).alias("many"))
    groups = small(ws.save(groups, "groups"))
    placed = own.join(groups, "digest", "left").select("id", "url", "payload", "digest", "last", (F.coalesce("many", F.lit(False)) & ~F.col("id").eqNullSafe(F.col("last"))).alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{directory}/{uuid.uuid4().hex}.warc.gz"
        system, path = _place(name)
        records = size = 0
        out = None
        for batch in batches:
            for i in range(batch.num_rows):
                page, url, body, digest, last, revisit = (column[i].as_py() for column in batch.columns)
                if out is None:
                    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    out = system.open_output_stream(path, compression=None)
                member = record(page, url, body, digest, last, revisit, f"{name}-{records}")
                out.write(member)
                records, size = records + 1, size + len(member)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [name], "bytes": pa.array([size], pa.int64()), "records": pa.array([records], pa.int64())})

    return ws.save(placed.mapInArrow(run, "path string, bytes bigint, records bigint"), "archives")


class _Window:
    """Sequential reading of a file from some place on, a chunk at a time; ``at`` is where ``held[begin:]`` starts."""

    def __init__(self, file: pa.NativeFile, at: int, size: int):
        self.file, self.size = file, size
        self.seek(at)

    def seek(self, at: int) -> None:
        self.at, self.begin, self.held = at, 0, b""
        self.file.seek(at)

    def more(self) -> bool:
        got = self.file.read(CHUNK) if self.at + len(self.held) - self.begin < self.size else b""
        if got:
            self.held, self.begin = self.held[self.begin :] + got, 0
        return bool(got)

    def skip(self, n: int) -> None:
        self.begin, self.at = self.begin + n, self.at + n

    def left(self) -> int:
        return len(self.held) - self.begin


class _Payload:
    """Digest and size of a record's payload: what follows the HTTP head, or the whole block of another type."""

    def __init__(self, fields: dict[str, str]):
        self.left = int(fields["content-length"])
        self.http = b"" if fields.get("content-type", "").lower().startswith("application/http") else None
        self.body, self.headed = self.http is None, bytearray()
        self.sha, self.size = hashlib.sha1(usedforsecurity=False), 0

    def take(self, data: bytes) -> None:
        data = data[: self.left]
        self.left -= len(data)
        if not self.body:
            start = max(0, len(self.headed) - 3)
            self.headed += data
            end = self.headed.find(b"\r\n\r\n", start)
            if end < 0:
                return
            self.http, data, self.body = bytes(self.headed[: end + 4]), bytes(self.headed[end + 4 :]), True
            self.headed = bytearray()
        self.sha.update(data)
        self.size += len(data)


def _member(window: _Window) -> tuple[dict[str, str], _Payload] | None:
    """Inflates the member at the window's start and goes behind it; None, and no step, if it is no record.

    What does not begin with a WARC line is given up at once; a header that
    does is read to its end, however long. An HTTP head is held in memory, a
    payload is not.
    """
    begin, unpack, head, fields, payload, seen = window.at, zlib.decompressobj(31), bytearray(), None, None, 0
    while not unpack.eof:
        if not window.left() and not window.more():
            window.seek(begin)
            return None
        piece = memoryview(window.held)[window.begin : window.begin + PIECE]
        try:
            data = unpack.decompress(piece)
        except zlib.error:
            window.seek(begin)
            return None
        window.skip(len(piece) - len(unpack.unused_data))
        if fields is not None:
            payload.take(data)
            continue
        head += data
        if not any(x.startswith(head[: len(x)]) for x in FIRST):
            window.seek(begin)
            return None
        end = head.find(b"\r\n\r\n", max(0, seen - 3))
        seen = len(head)
        if end >= 0:
            lines = head[:end].decode("utf-8", "replace").split("\r\n")[1:]
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            if not fields.get("content-length", "").isdigit() or "warc-type" not in fields:
                window.seek(begin)
                return None
            payload = _Payload(fields)
            payload.take(bytes(head[end + 4 :]))
    if fields is None or payload.left:
        window.seek(begin)
        return None
    return fields, payload


def scan(uri: str, start: int, end: int, size: int) -> Iterator[tuple]:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url) of the captures that start in [start, end).

    Captures are responses, revisits and resources; other records, as foreign
    archives hold them, are passed over.
    """
    system, path = _place(uri)
    with system.open_input_file(path) as file:
        window = _Window(file, start, size)
        while window.at < end:
            found = window.held.find(MAGIC, window.begin)
            if found < 0:
                window.skip(max(0, window.left() - 2))
                if not window.more():
                    return
                continue
            window.skip(found - window.begin)
            if window.at >= end:
                return
            got = _member(window)
            if got is None:
                window.skip(1)
                continue
            fields, payload = got
            kind = fields["warc-type"]
            if kind not in ("response", "revisit", "resource"):
                continue
            n, digest = payload.size, payload.sha.hexdigest()
            if kind == "revisit":
                lengths = [x.split(b":", 1)[1].strip() for x in (payload.http or b"").split(b"\r\n") if x.lower().startswith(b"content-length:")]
                n = int(lengths[0]) if lengths else 0
                algorithm, _, value = fields.get("warc-payload-digest", "").partition(":")
                digest = base64.b32decode(value).hex() if algorithm == "sha1" and len(value) == 32 else value.lower()
            page, other = fields.get("x-page"), fields.get("x-refers-to-page")
            yield int(page) if page else None, n, digest, kind, int(other) if other and other != "None" else None, fields.get("warc-target-uri")


def read(spark: SparkSession, archives: DataFrame, split: int = SPLIT) -> DataFrame:
    """The captures of ``archives(path, bytes)``, whatever the ranges; no archives: no rows.

    A task gets up to ``RANGES`` ranges, fewer where that would leave cores idle.
    """
    ranges = archives.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split).cast("bigint"))).alias("start"))
    n = ranges.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

        for batch in batches:
            for place in batch.to_pylist():
                rows = []
                for row in scan(place["path"], place["start"], place["start"] + split, place["bytes"]):
                    rows.append(row)
                    if len(rows) == 2000:
                        yield batch_of(rows)
                        rows = []
                if rows:
                    yield batch_of(rows)

    tasks = min(n, max(-(-n // RANGES), 4 * spark.sparkContext.defaultParallelism))
    return ranges.repartition(max(1, tasks)).mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string")


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes ``pages(page_id, url, html)`` as archives in the shared folder and reads them back."""
    ws = Workspace(pages.sparkSession, "warc")
    return read(pages.sparkSession, write(pages, ws.path("files"), ws))
