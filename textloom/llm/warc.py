"""WARC archives: a writer of gzip members, one for each record, and a splittable reader.

Writing: pages with equal payloads are found by digest and grouped with partial aggregation; the one
with the largest page_id is written as a response, the others as revisits that refer to it. Each task
writes one archive under a name of its own partition: to a temporary name first, then renamed, so a
task that runs again replaces its file and a lost one leaves nothing under the final name.

Reading: archives are cut into byte ranges of RANGE_MB. A task scans its range for the gzip magic and
validates a candidate by decoding its header: the member must inflate to a WARC version line. It owns the
records that start in its range and reads past the end to finish the last one; each member is inflated
once, and the next one must begin where it ends. Where it doesn't, or a member is cut off or fails its
checksum, that place comes back as a row of type "damaged" and the scan goes on for the next magic, so
damage costs the records that it touches and no others. Memory is a range and one record.

A gzip member may also be stored inside a payload. Deflate stores at most STORED bytes in a block, with 5
bytes before each, so members that follow each other for longer are no stored ones. A task whose range
begins within a member follows its first candidate for so long; if the chain breaks before that, it reads
on from further back to see where records really begin.

Defined results: null html is an empty payload, and empty payloads are equal to each other; a null
page_id is written without a number, comes back null, and is never referred to if another page has the
payload; repeated rows of a page are a record each; very long payloads are single records; an empty
table makes no archive and reads back as no rows; columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import as_bytes, materialize, shared_dir

RANGE_MB = 16.0
ARCHIVE_MB = 64.0
LEVEL = 6
STORED = (1 << 16) - 1
LEAST_REVISIT = 0
BROADCAST_ROWS = 200_000
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
DATE = "2000-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _files(path: str):
    """A file system and a path in it, for a local path or any uri that pyarrow can open."""
    from pyarrow import fs

    u = urlsplit(path)
    if u.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(u.path) if u.scheme else path
    return fs.FileSystem.from_uri(path)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record, not compressed. A revisit has the digest and length of the payload but not
    the payload itself."""
    kind = "response" if refers_to is None else "revisit"
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body += payload if refers_to is None else b""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    if url is not None:
        head.insert(3, "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def member(raw: bytes, level: int = LEVEL) -> bytes:
    """A gzip member with no time or name, so that equal records have equal bytes."""
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


def parse(raw: bytes) -> dict:
    """Fields of a record, by their names in small letters, with its payload (empty for a revisit)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = fields.get("content-length", "")
    body = rest[: int(size)] if size.isdigit() else rest.removesuffix(b"\r\n\r\n")
    # an HTTP head stands before the payload of responses only
    http = body.startswith(b"HTTP/") and fields.get("warc-type") in ("response", "revisit")
    return fields | {"payload": body.partition(b"\r\n\r\n")[2] if http else body}


def _write(out: str, level: int, archive_mb: float):
    def written(batches):
        from pyspark import TaskContext

        files, root = _files(out)
        ctx = TaskContext.get()
        done, sink, rows, size = [], None, 0, 0

        def close():
            sink.close()
            files.move(f"{name}.{ctx.taskAttemptId()}", name)
            done.append((out.rstrip("/") + "/" + os.path.basename(name), size, rows))

        for b in batches:
            for page, url, html, to in zip(b.column("page_id").to_pylist(), b.column("url").to_pylist(), as_bytes(b.column("html")), b.column("refers_to").to_pylist()):
                if sink is None:
                    files.create_dir(root, recursive=True)
                    name, rows, size = f"{root}/part-{ctx.partitionId():06d}-{len(done):04d}.warc.gz", 0, 0
                    sink = files.open_output_stream(f"{name}.{ctx.taskAttemptId()}", compression=None)
                data = member(record(page, url, html, to), level)
                sink.write(data)
                rows, size = rows + 1, size + len(data)
                if size >= archive_mb * 1e6:
                    close()
                    sink = None
        if sink is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "bytes", "records"])

    return written


def write_archives(pages: DataFrame, out: str, level: int = LEVEL, least: int = LEAST_REVISIT, archive_mb: float = ARCHIVE_MB) -> DataFrame:
    """Write a record for each page under out, in archives of about archive_mb; returns path, bytes and records of each archive, as a
    table that is already made."""
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).alias("html"))
    # a payload's digest, in the JVM: two rows are equal if 160 bits and the length are
    key = base.withColumn("digest", F.sha1(F.encode("html", "UTF-8"))).withColumn("bytes", F.octet_length("html"))
    groups = key.where(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1 AND response IS NOT NULL")
    groups = materialize(groups.select("digest", "bytes", "response"), "payloads")
    if groups.count() <= BROADCAST_ROWS:
        groups = F.broadcast(groups)
    to = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("response")), F.col("response"))
    told = key.join(groups, ["digest", "bytes"], "left").select("page_id", "url", "html", to.alias("refers_to"))
    return materialize(told.mapInArrow(_write(out, level, archive_mb), "path string, bytes long, records long"), "archives")


class _Source:
    """Bytes of a file by position; keeps one window of it."""

    def __init__(self, path: str, window: int = 1 << 20):
        files, name = _files(path)
        self.f, self.window = files.open_input_file(name), window
        self.size = self.f.size()
        self.at, self.data = 0, b""

    def get(self, at: int, n: int) -> bytes:
        if at < self.at or at + n > self.at + len(self.data):
            self.f.seek(at)
            self.at, self.data = at, self.f.read(max(n, self.window))
        return self.data[at - self.at : at - self.at + n]


def _inflate(source: _Source, at: int) -> tuple[bytes, int] | None:
    """The record in the member that starts at a position, and where the member ends; None if there is
    none, if it is cut off, or if it fails its checksum. A member that is no record fails at once."""
    if source.get(at, 3) != MAGIC:
        return None
    d, out, pos = zlib.decompressobj(31), [], at
    try:
        while not d.eof:
            data = source.get(pos, 1 << 16)
            if not data:
                return None
            out.append(d.decompress(data))
            pos += len(data)
            if len(out) == 1 and not out[0].startswith(VERSION[: len(out[0])]):
                return None
    except zlib.error:
        return None
    raw = b"".join(out)
    return (raw, pos - len(d.unused_data)) if raw.startswith(VERSION) else None


def _is_record(source: _Source, at: int) -> bool:
    """Whether a member with a WARC version line starts at a position, whatever comes after the line."""
    if source.get(at, 3) != MAGIC:
        return False
    try:
        return zlib.decompressobj(31).decompress(source.get(at, 1 << 12), 64).startswith(VERSION)
    except zlib.error:
        return False


def _candidate(source: _Source, at: int, end: int) -> int | None:
    """The first position in [at, end) where a record seems to start, by its decoded header."""
    while at < end:
        data = source.get(at, min(1 << 20, end - at + 2))  # a magic may end after the range
        hit = data.find(MAGIC)
        if hit >= 0 and at + hit < end:
            at += hit
            if _is_record(source, at):
                return at
            at += 1
        elif at + len(data) >= min(end + 2, source.size):
            return None
        else:
            at += max(1, len(data) - 2)
    return None


def _first(source: _Source, start: int, end: int) -> int | None:
    """Where the first record of a range starts that is not stored inside another one."""
    at = _candidate(source, start, end)
    if at is None or start == 0:
        return at
    pos = at
    while (got := _inflate(source, pos)) is not None:
        pos = got[1]
        if pos - at > STORED or pos >= source.size:  # a stored member has the end of its record after it
            return at
    # a chain so short may be stored in a record that starts before the range: come from further back
    back = max(end - start, STORED)
    while True:
        pos, linked = _candidate(source, max(0, start - back), start), False
        while pos is not None and pos < at:
            got = _inflate(source, pos)
            pos, linked = (got[1], True) if got else (_candidate(source, pos + 1, at), False)
        if pos is not None and linked:
            return pos if pos < end and _is_record(source, pos) else _candidate(source, pos, end)
        if start - back <= 0:
            return at
        back *= 4


def range_records(path: str, start: int, end: int):
    """Fields of the records that start in [start, end) of an archive, in order, with their positions;
    None for the fields where something is damaged."""
    source = _Source(path)
    end = min(end, source.size)
    at = _first(source, start, end)
    if start == 0 and at != 0 and source.size:
        yield 0, None
    while at is not None and at < end:
        got = _inflate(source, at)
        if got is not None:
            yield at, parse(got[0])
            at = got[1]
            if at >= source.size or _is_record(source, at):
                continue
        if at < source.size:
            yield at, None  # owned by the range in which the last good record starts, wherever it ends
        at = _candidate(source, at + 1, end)


RECORD = "path string, position long, record_id string, url string, record_type string, payload_digest string, payload_length long, refers_to string, payload binary, payload_sha1 string"
_TYPES = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string())


def _read(batches):
    for b in batches:
        for path, start, end in zip(*(b.column(c).to_pylist() for c in ("path", "start", "end"))):
            rows, size = [], 0
            for at, f in range_records(path, start, end):
                if f is None:
                    rows.append((path, at, None, None, "damaged", *(None,) * 5))
                    continue
                length = f.get("x-payload-length", "")
                rows.append((path, at, f.get("warc-record-id"), f.get("warc-target-uri"), f.get("warc-type"), f.get("warc-payload-digest"), int(length) if length.isdigit() else None, f.get("warc-refers-to"), f["payload"], digest(f["payload"])))
                size += len(f["payload"])
                if size > 8 << 20:
                    yield _batch(rows)
                    rows, size = [], 0
            yield _batch(rows)


def _batch(rows):
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES)], [f.split()[0] for f in RECORD.split(", ")])


def read_archives(archives: DataFrame, range_mb: float = RANGE_MB) -> DataFrame:
    """Records of archives (path, bytes): a row each, with its payload and that payload's own digest; see
    RECORD. A place where an archive is damaged is a row of record_type "damaged" with path and position."""
    step = int(range_mb * 1e6)
    ranges = archives.where("bytes > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(step).cast("long"))).alias("start"))
    ranges = ranges.select("path", "start", (F.col("start") + step).alias("end"))
    n = max(1, min(20_000, ranges.count()))
    return ranges.repartition(n, "path", "start").mapInArrow(_read, RECORD)


def checked(records: DataFrame) -> DataFrame:
    """The same records; the query fails at a damaged place, and at a response whose payload has not the length or the SHA-1 that
    its header says, where payload_digest is read. (A revisit has no payload to check.)"""
    damaged = (F.col("record_type") == "damaged") | (F.col("record_type") == "response") & (F.octet_length("payload").cast("long") != F.col("payload_length")) | (F.col("record_type") == "response") & F.col("payload_digest").startswith("sha1:") & (F.col("payload_digest") != F.concat(F.lit("sha1:"), "payload_sha1"))
    error = F.raise_error(F.concat_ws(" ", F.lit("damaged payload:"), "path", F.col("position").cast("string"), "record_id"))
    return records.withColumn("payload_digest", F.when(damaged, error.cast("string")).otherwise(F.col("payload_digest")))


def round_trip(pages: DataFrame, out: str | None = None) -> DataFrame:
    """Write pages to archives and read them back: page_id, payload_bytes, payload_digest, record_type,
    refers_to, url; length and digest are checked against the payload where the record has it (checked)."""
    spark: SparkSession = pages.sparkSession
    out = out or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    got = checked(read_archives(write_archives(pages, out)))
    number = lambda c: F.expr(f"try_cast(nullif(regexp_extract({c}, '<urn:page:(-?[0-9]*)>', 1), '') AS BIGINT)")
    whole = F.col("record_type") == "response"
    return got.select(number("record_id").alias("page_id"), F.when(whole, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"), F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"), "url")
