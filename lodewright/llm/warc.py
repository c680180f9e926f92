"""WARC archives: a writer with payload deduplication and a salvage reader.

Every record is a gzip member of its own, so damage to one record leaves the
others readable. The reader checks each record (member checksum, version line,
lengths, payload digest); after a failed check it searches for the next place
at which a valid record starts, goes on from there, and logs the bytes in
between as a quarantined gap. Members of several records are read alike: what
could be inflated is searched for version lines, so that one bad record, or a
cut, costs no others.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import new_path, table

#: Date of all records, so that a rerun writes equal bytes.
DATE = "2024-01-01T00:00:00Z"
#: A file ends with the record that takes it to so many bytes.
FILE_BYTES = 64 << 20
#: Bytes of junk before a record in a drill.
JUNK = 37
#: Bytes given to a decompressor at once.
CHUNK = 1 << 16
#: Pages of a batch out of the writer.
BATCH = 256

GZIP = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {}\r\n\r\n"


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def _header(value: str) -> str:
    """A header value without line ends and other control characters."""
    return re.sub(r"[\x00-\x1f\x7f]", " ", value)


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A plain WARC record; a revisit (``refers_to`` given) has no payload."""
    revisit = refers_to is not None
    block = HTTP.format(len(payload)).encode() + (b"" if revisit else payload)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {_header(url)}"] if url is not None else []),
        f"WARC-Payload-Digest: sha1:{digest}",
        *(["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"] if revisit else []),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    """A gzip member that ends in a zero byte.

    The last byte of a member is the top byte of the size, zero below 16 MB; a
    larger one is followed by an empty member, which is legal and ends in zeros.
    """
    def zipped(raw: bytes) -> bytes:
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        return z.compress(raw) + z.flush()

    out = zipped(record)
    return out if out[-1] == 0 else out + zipped(b"")


class Broken(ValueError):
    """A check failed at this place."""


def parse_record(raw: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record that starts at ``at``; raises Broken."""
    if not VERSION.match(raw, at):
        raise Broken("no version line")
    stop = raw.find(b"\r\n\r\n", at)
    if stop < 0:
        raise Broken("header without end")
    headers = {}
    for line in raw[at:stop].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Broken("header line without colon")
        headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = headers.get("content-length", "")
    if not length.isdecimal():
        raise Broken("no content length")
    end = stop + 4 + int(length)
    if raw[end : end + 4] != b"\r\n\r\n":
        raise Broken("block doesn't end where its length says")
    block = raw[stop + 4 : end]
    if headers.get("warc-type") == "response":
        said = headers.get("warc-payload-digest", "")
        body = block[block.find(b"\r\n\r\n") + 4 :]
        if said.startswith("sha1:") and said[5:] != base32(hashlib.sha1(body).digest()):
            raise Broken("payload digest differs")
    return headers, block, end + 4


def _inflate(raw: bytes, at: int) -> tuple[bytes, int, str | None]:
    """Content and end of the gzip member at ``at``, and what is wrong with it:
    then the content is what came before the fault."""
    z, parts, view, p = zlib.decompressobj(31), [], memoryview(raw), at
    try:
        while not z.eof:
            if p >= len(raw):
                return b"".join(parts), len(raw), "member is cut off"
            parts.append(z.decompress(view[p : p + CHUNK]))
            p += CHUNK
    except zlib.error as e:
        # the piece with the fault again, in small steps: all that precedes it counts
        z, parts, p = zlib.decompressobj(31), [], at
        try:
            while p < len(raw):
                parts.append(z.decompress(view[p : p + 64]))
                p += 64
        except zlib.error:
            pass
        return b"".join(parts), p, f"member: {e}"
    return b"".join(parts), min(p, len(raw)) - len(z.unused_data), None


def _starts_well(raw: bytes, at: int) -> bool:
    """Whether a member at ``at`` is empty or its content starts with a version line; inflates a few bytes only."""
    z = zlib.decompressobj(31)
    try:
        head = z.decompress(memoryview(raw)[at : at + CHUNK], 10)
    except zlib.error:
        return False
    return bool(VERSION.match(head)) if head else z.eof


Found = tuple[str, int, int, object]


def _inside(content: bytes, at: int, length: int, fault: str | None = None) -> list[Found]:
    """Records and gaps of a member's content; they bear the member's place and fault."""
    out: list[Found] = []
    p = 0
    while p < len(content):
        try:
            headers, block, end = parse_record(content, p)
            out.append(("record", at, length, (headers, block, fault)))
            p = end
        except Broken as e:
            hit = VERSION.search(content, p + 1)
            stop = hit.start() if hit else len(content)
            out.append(("gap", at, length, f"bytes {p} to {stop} of the content: {e}"))
            p = stop
    return out


def _unit(raw: bytes, at: int) -> tuple[list[Found], int]:
    """What is at ``at``, and where to go on: a member with its records, or a
    plain record. Raises Broken if no record can be had from it."""
    if not raw.startswith(GZIP, at):
        headers, block, end = parse_record(raw, at)
        return [("record", at, end - at, (headers, block, None))], end
    content, end, fault = _inflate(raw, at)
    found = _inside(content, at, end - at, fault)
    if not any(f[0] == "record" for f in found) and (content or fault):
        raise Broken(fault or found[0][3])
    if not fault:
        return found, end
    # a damaged member ends where the next valid start is
    stop = _next_start(raw, at + 1)
    return [f for f in found if f[0] == "record"] + [("gap", at, stop - at, fault)], stop


def _next_start(raw: bytes, at: int) -> int:
    """The next place from ``at`` on at which a record can be had; the end if there is none."""
    while hit := START.search(raw, at):
        at = hit.start()
        try:
            if raw.startswith(GZIP, at):
                if _starts_well(raw, at):
                    content, _, fault = _inflate(raw, at)
                    if not fault and not content or any(f[0] == "record" for f in _inside(content, at, 0)):
                        return at
            else:
                parse_record(raw, at)
                return at
        except Broken:
            pass
        at += 1
    return len(raw)


def salvage(raw: bytes) -> Iterator[Found]:
    """('record', offset, length, (headers, block, fault)) for each valid record,
    and ('gap', offset, length, reason) for each stretch of bytes that is none.

    ``fault`` tells what is wrong with the member of a record whose own checks
    hold; as the member's checksum doesn't, nothing vouches for its headers.

    Records of one member bear its offset and length; a gap inside a member
    that is sound as such says so. Empty members and zero or line-end padding
    between records are no gaps.
    """
    at = 0
    while at < len(raw):
        try:
            found, at = _unit(raw, at)
            yield from found
            continue
        except Broken as e:
            reason = str(e)
        pad = at
        while pad < len(raw) and raw[pad] in b"\0\r\n":
            pad += 1
        if pad > at and (pad == len(raw) or START.match(raw, pad)):
            at = pad
            continue
        start, at = at, _next_start(raw, at + 1)
        yield "gap", start, at - start, reason


def write_archives(pages: DataFrame, path: str, ident: str = "page_id", url: str = "url", html: str = "html", file_bytes: int = FILE_BYTES, junk_every: int = 0) -> None:
    """One record per row under ``path``: of equal payloads the row with the
    smallest id is the response, the others are revisits of it.

    A null payload is empty. Null ids come last; where all ids of a payload
    are null, or rows repeat with the smallest id, each such row is a response.
    An empty table writes no records. A task starts a new file when one has
    ``file_bytes``. With ``junk_every`` the first ``JUNK`` bytes of the member
    of each id divisible by it are written once more before it, as a drill for
    the reader.

    Members pass through Spark's text writer, which puts bytes out as they are.
    """
    payload = F.coalesce(F.col(f"`{html}`"), F.lit(""))
    rows = pages.select(F.col(f"`{ident}`").cast("long").alias("page_id"), F.col(f"`{url}`").alias("url"), payload.alias("html"), F.sha1(payload.cast("binary")).alias("sha1"))
    first = rows.groupBy("sha1").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    told = rows.join(first, "sha1", "left")
    refers = F.when(F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        volume, size = 0, 0
        for b in batches:
            for k in range(0, len(b), BATCH):
                part = b.slice(k, BATCH)
                ids, urls, sha1, refer = (part.column(i).to_pylist() for i in (0, 1, 3, 4))
                bodies = part.column(2).cast(pa.binary()).to_pylist()
                made, at = [], []
                for i, u, x, s, r in zip(ids, urls, bodies, sha1, refer, strict=True):
                    m = member(make_record(i, u, x, base32(bytes.fromhex(s)), r))
                    made.append((m[:JUNK] if junk_every and i is not None and i % junk_every == 0 else b"") + m[:-1])
                    at.append(volume)
                    size += len(made[-1])
                    if size >= file_bytes:
                        volume, size = volume + 1, 0
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()), pa.array(at, pa.int32())], ["record", "volume"])

    members = told.select("page_id", "url", "html", "sha1", refers.alias("refers_to")).mapInArrow(encode, "record binary, volume int")
    # the text writer puts the zero byte that ends each member after it
    members.select(F.col("record").cast("string").alias("value"), "volume").write.partitionBy("volume").option("lineSep", "\0").text(path)


READ = "kind string, file string, offset long, length long, reason string, page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, gap_before long, payload binary"


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """``READ``: a row of kind ``record`` per valid record, and a row of kind
    ``gap`` per quarantined stretch of bytes. Length and digest of a revisit's
    payload are those that it states; ``gap_before`` are the quarantined bytes
    right before a record. Without files there are no rows.
    """

    kinds = to_arrow_schema(StructType.fromDDL(READ))

    def number(urn: str | None) -> int | None:
        m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
        return int(m[1]) if m else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, kinds.field(i).type) for i, c in enumerate(zip(*out, strict=True))], kinds.names)
            out.clear()
            return batch

        for b in batches:
            for i in range(len(b)):
                file, raw = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                gap = 0
                for kind, at, n, what in salvage(raw):
                    if kind == "gap":
                        out.append((kind, file, at, n, what, *[None] * 8))
                        gap = n
                    else:
                        headers, block, fault = what
                        head = block.find(b"\r\n\r\n") + 4
                        body, revisit = block[head:], headers.get("warc-type") == "revisit"
                        size = re.search(rb"(?i)content-length: *(\d+)", block[:head])
                        digest = headers.get("warc-payload-digest", "").removeprefix("sha1:") if revisit else base32(hashlib.sha1(body).digest())
                        out.append((kind, file, at, n, fault, number(headers.get("warc-record-id")), headers.get("warc-target-uri"), headers.get("warc-type"), number(headers.get("warc-refers-to")), digest, int(size[1]) if revisit and size else len(body), gap, body if with_payload else None))
                        gap = 0
                    if len(out) >= 2000:
                        yield flush()
        if out:
            yield flush()

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(read, READ)


def op2_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``pages`` written to archives, with junk before each sixteenth, and
    read back through the salvage reader, which passes the junk over."""
    path = new_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path, junk_every=16)
    return read_archives(spark, path).filter("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "gap_before")


OP2_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, payload_bytes, min(page_id) OVER (PARTITION BY h) AS first_id,
        concat(to_base(('0x' || h[1:10])::BIGINT, 32, 8), to_base(('0x' || h[11:20])::BIGINT, 32, 8),
               to_base(('0x' || h[21:30])::BIGINT, 32, 8), to_base(('0x' || h[31:40])::BIGINT, 32, 8)) AS b FROM p)
SELECT page_id, payload_bytes, translate(b, '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to,
       CASE WHEN page_id % 16 = 0 THEN 37 ELSE 0 END::BIGINT AS gap_before
FROM d
"""
