"""WARC archives: a writer with revisit records and a splittable reader.

Writing: every page becomes one gzip member. The smallest id of each payload (equal by
SHA-1 and length) is a ``response``; the others are ``revisit`` records that name it and
carry the HTTP headers only. Each task writes one archive to a folder all executors
share, under a name of its own attempt that is final only when the task's row of the
manifest is; archives of lost attempts are never read.

Reading: archives are cut into byte ranges that tasks take independently. A task looks
for gzip magic in its range, accepts a candidate only if it inflates to a whole member
with a right checksum that begins with a WARC version line and is followed by another
member or the end of the file, and owns the records that start inside its range; it
reads past the range's end only to finish the last of them. Any archive written so,
one member a record, can be read, whoever wrote it.

Edge cases: a null payload is empty; a null id or url is kept as null, and a page without an
id is always a response and none that others refer to; repeated rows are records like any others,
told apart by id and payload: of equal payloads all rows with the smallest id are responses, and
rows of one id with other payloads have nothing to do with them; an empty table gives no archives
and no records; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionlake.llm.shared import Stage, only

SPLIT_BYTES = 8 << 20
MAGIC = b"\x1f\x8b\x08"
READ_BYTES = 1 << 20
#: What the inflater is fed at once.
FEED_BYTES = 1 << 15
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, file string, offset long, header string"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def urn(page: int | None) -> str:
    return f"<urn:x-page:{'null' if page is None else page}>"


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record, not yet compressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {urn(page)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        *([f"WARC-Target-URI: {''.join(c if c > ' ' else '%%%02X' % ord(c) for c in url)}"] if url is not None else []),
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        *([f"WARC-Refers-To: {urn(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if refers_to is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    return gz.compress(data) + gz.flush()


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        name = f"{root}/{uuid.uuid4().hex}.warc.gz"
        out, size, n = None, 0, 0
        for batch in batches:
            for page, url, text, refers in zip(*(batch.column(c).to_pylist() for c in ("id", "url", "text", "refers_to")), strict=True):
                out = out or files.open_output_stream(name, compression=None)
                data = member(record(page, url, (text or "").encode(), refers))
                out.write(data)
                size += len(data)
                n += 1
        if out:
            out.close()
            uri = folder.rstrip("/") + "/" + name.rsplit("/", 1)[1]
            yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([size]), pa.array([n])], ["file", "bytes", "records"])

    return run


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write ``pages`` under ``folder``, a URI all executors share; returns the written manifest: file, bytes, records."""
    stage = Stage(pages.sparkSession, "warc")
    source = only(pages, id_col, url_col, payload_col).toDF("id", "url", "text").withColumn("id", F.col("id").cast("long"))
    payload = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    source = source.withColumns({"digest": F.sha1(payload), "n": F.octet_length(payload)})
    described = stage.keep(source.select("id", "digest", "n"), "digests")
    firsts = described.filter((F.col("n") >= least_bytes) & F.col("id").isNotNull()).groupBy("digest", "n").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    revisits = described.join(firsts, ["digest", "n"]).filter(F.col("id") != F.col("first")).select("id", "digest", "n", F.col("first").alias("refers_to")).distinct()
    rows = source.join(revisits, ["id", "digest", "n"], "left").select("id", "url", "text", "refers_to")
    manifest = stage.keep(rows.mapInArrow(_write(folder), "file string, bytes long, records long"), "manifest")
    stage.drop("digests")
    return manifest


class Window:
    """A file read forward in blocks, with the bytes from ``at`` on at hand; what is used up goes once a block is."""

    def __init__(self, file: pa.NativeFile, at: int):
        self.file, self.at, self.held = file, at, bytearray()

    def more(self) -> bool:
        got = self.file.read_at(READ_BYTES, self.at + len(self.held))
        self.held += got
        return bool(got)

    def drop(self, n: int) -> None:
        del self.held[:n]
        self.at += n


def inflate(window: Window, skip: int) -> tuple[bytes, int] | None:
    """The member at ``skip`` and its compressed length, or None if no WARC record is there."""
    gz, out, fed, start = zlib.decompressobj(31), io.BytesIO(), skip, b""
    try:
        while not gz.eof:
            if fed >= len(window.held) and not window.more():
                return None
            piece = bytes(window.held[fed : fed + FEED_BYTES])
            got = gz.decompress(piece)
            fed += len(piece)
            out.write(got)
            if len(start) < 5:
                start += got[: 5 - len(start)]
                if not b"WARC/".startswith(start):
                    return None
    except zlib.error:
        return None
    if len(start) < 5:
        return None
    used = fed - len(gz.unused_data) - skip
    while len(window.held) < skip + used + 3 and window.more():
        pass
    after = window.held[skip + used : skip + used + 3]
    return (out.getvalue(), used) if after in (b"", MAGIC) else None


def parse(data: bytes) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields.get("content-length", 0))]
    http, _, payload = block.partition(b"\r\n\r\n") if fields.get("content-type", "").startswith("application/http") else (b"", b"", block)
    inner = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])}

    def page(value: str | None) -> int | None:
        digits = (value or "").removeprefix("<urn:x-page:").removesuffix(">")
        return int(digits) if digits.lstrip("-").isdigit() else None

    kind = fields.get("warc-type")
    return {
        "page_id": page(fields.get("warc-record-id")),
        "url": fields.get("warc-target-uri"),
        "record_type": kind,
        "refers_to": page(fields.get("warc-refers-to")),
        "payload_bytes": int(inner["content-length"]) if kind == "revisit" and "content-length" in inner else len(payload),
        "payload_digest": fields["warc-payload-digest"].removeprefix("sha1:") if kind == "revisit" and "warc-payload-digest" in fields else digest_of(payload),
        "payload": None if kind == "revisit" else payload,
        "header": head.decode("utf-8", "replace"),
    }


def records_in(file: pa.NativeFile, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of every record that starts in [start, end)."""
    window, seen = Window(file, start), 0
    while True:
        skip = window.held.find(MAGIC, seen)
        while skip < 0:
            window.drop(max(0, len(window.held) - len(MAGIC) + 1))
            seen = 0
            if window.at >= end or not window.more():
                return
            skip = window.held.find(MAGIC)
        if window.at + skip >= end:
            return
        found = inflate(window, skip)
        seen = skip + 1
        if found is not None:
            yield window.at + skip, found[0]
            seen = skip + found[1]
        if seen >= READ_BYTES:
            window.drop(seen)
            seen = 0


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = pa.schema(
        [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64())]
        + [("payload_digest", pa.string()), ("payload", pa.binary()), ("file", pa.string()), ("offset", pa.int64()), ("header", pa.string())]
    )
    for batch in batches:
        for uri, start, end in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "end")), strict=True):
            files, path = fs.FileSystem.from_uri(uri)
            rows, held = [], 0
            with files.open_input_file(path) as file:
                for offset, data in records_in(file, start, end):
                    rows.append(parse(data) | {"file": uri, "offset": offset})
                    held += len(data)
                    if held >= 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, types)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, types)


def read_archives(manifest: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Every record of the archives in ``manifest`` (file, bytes): see RECORD for the columns."""
    spark: SparkSession = manifest.sparkSession
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long")))
    ranges = manifest.filter("bytes > 0").select("file", "bytes", starts.alias("start"))
    ranges = ranges.select("file", "start", F.least(F.col("start") + split_bytes, F.col("bytes")).alias("end"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return ranges.repartition(n, F.xxhash64("file", "start")).mapInArrow(_read, RECORD)
