"""TIFF columns: walk image directories, decode strips and tiles, one row per page.

Compressions: none, LZW, deflate (both codes) and PackBits; predictors: none and
horizontal differencing; 8 and 16 bit samples, interleaved or alone; either byte
order; strips or tiles. The encoder writes what the decoder reads.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

# Fixed values of the TIFF 6.0 format: tags, compression codes, bytes of a field type.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS = 273, 277, 278, 279
PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 317, 322, 323, 324, 325
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
LZW_CLEAR, LZW_END = 256, 257

#: Width of a stored payload: a row is 64 bytes.
ROW = 64
#: Rows of a page, of a strip and of a tile of the stored form.
PAGE_ROWS, STRIP_ROWS, TILE_ROWS = 1024, 128, 64
#: Documents of a batch between the steps.
BATCH = 256


def packbits_decode(raw: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(raw):
        n = raw[i]
        if n < 128:
            out += raw[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += raw[i + 1 : i + 2] * (257 - n)
            i += 2 if n > 128 else 1
    return bytes(out)


def packbits_encode(raw: bytes) -> bytes:
    """Runs of three bytes or more as such; what lies between them as it is."""
    data = np.frombuffer(raw, np.uint8)
    edges = np.concatenate(([0], np.flatnonzero(data[1:] != data[:-1]) + 1, [len(data)])) if len(data) else np.zeros(1, np.int64)
    sizes = np.diff(edges)
    out, at = bytearray(), 0

    def plain(stop: int) -> None:
        for k in range(at, stop, 128):
            part = raw[k : min(k + 128, stop)]
            out.append(len(part) - 1)
            out.extend(part)

    for k in np.flatnonzero(sizes >= 3):
        start, n = int(edges[k]), int(sizes[k])
        plain(start)
        at = start + n
        while n > 0:
            run = min(n, 128)
            out += bytes((257 - run, raw[start])) if run > 1 else bytes((0, raw[start]))
            n -= run
    plain(len(raw))
    return bytes(out)


def lzw_decode(raw: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bit first; the width grows one code early."""
    out, words, width = bytearray(), [], 9
    held = bits = 0
    last = b""
    for byte in raw:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & ((1 << width) - 1)
        if code == LZW_END:
            break
        if code == LZW_CLEAR:
            words, width, last = [], 9, b""
            continue
        if code < 256:
            word = bytes((code,))
        elif code - 258 < len(words):
            word = words[code - 258]
        elif code - 258 == len(words) and last:
            word = last + last[:1]
        else:
            raise ValueError("LZW code out of range")
        if last:
            words.append(last + word[:1])
        out += word
        last = word
        count = 258 + len(words)
        width = 12 if count >= 2047 else 11 if count >= 1023 else 10 if count >= 511 else 9
    return bytes(out)


def lzw_encode(raw: bytes) -> bytes:
    out = bytearray()
    held = bits = 0

    def emit(code: int, width: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    codes: dict[bytes, int] = {}
    emit(LZW_CLEAR, 9)
    width, word = 9, b""
    for i in range(len(raw)):
        longer = word + raw[i : i + 1]
        if len(longer) == 1 or longer in codes:
            word = longer
            continue
        emit(codes[word] if len(word) > 1 else word[0], width)
        codes[longer] = 258 + len(codes)
        count = 258 + len(codes)
        width = 12 if count >= 2048 else 11 if count >= 1024 else 10 if count >= 512 else 9
        if count >= 4094:
            emit(LZW_CLEAR, width)
            codes, width = {}, 9
        word = raw[i : i + 1]
    if word:
        emit(codes[word] if len(word) > 1 else word[0], width)
        # the decoder adds a word for the last code too, and may widen
        count = 258 + len(codes) + 1
        width = 12 if count >= 2048 else 11 if count >= 1024 else 10 if count >= 512 else 9
    emit(LZW_END, width)
    if bits:
        emit(0, 8 - bits)
    return bytes(out)


DECODERS = {NONE: bytes, LZW: lzw_decode, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress, PACKBITS: packbits_decode}
ENCODERS = {NONE: bytes, LZW: lzw_encode, DEFLATE: zlib.compress, PACKBITS: packbits_encode}


@dataclass
class Page:
    page: int
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    tiled: bool
    data: bytes


def _fields(raw: bytes, at: int, order: str) -> tuple[dict[int, tuple], int]:
    """Values by tag of the directory at ``at``, and the offset of the next."""
    (n,) = struct.unpack_from(order + "H", raw, at)
    found = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", raw, at + 2 + 12 * k)
        size = TYPE_BYTES.get(kind, 1) * count
        where = at + 10 + 12 * k
        if size > 4:
            (where,) = struct.unpack_from(order + "I", raw, where)
        if kind in (1, 3, 4):
            found[tag] = struct.unpack_from(f"{order}{count}{'BBHI'[kind - 1]}", raw, where)
    return found, struct.unpack_from(order + "I", raw, at + 2 + 12 * n)[0]


def read_pages(raw: bytes) -> Iterator[Page]:
    """All pages; raises ValueError (or struct.error, zlib.error) where the file is broken."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(raw[:2]))
    if not order or struct.unpack_from(order + "H", raw, 2)[0] != 42:
        raise ValueError("no TIFF header")
    (at,) = struct.unpack_from(order + "I", raw, 4)
    seen: set[int] = set()
    while at:
        if at in seen:
            raise ValueError("directories form a loop")
        seen.add(at)
        tags, following = _fields(raw, at, order)

        def one(tag: int, default: int | None = None, tags: dict = tags) -> int:
            if tag not in tags and default is None:
                raise ValueError(f"tag {tag} is missing")
            return tags.get(tag, (default,))[0]

        width, height, samples, bits = one(WIDTH), one(LENGTH), one(SAMPLES, 1), one(BITS, 1)
        code, predictor, tiled = one(COMPRESSION, NONE), one(PREDICTOR, 1), TILE_OFFSETS in tags
        if code not in DECODERS or predictor not in (1, 2) or bits not in (8, 16):
            raise ValueError(f"compression {code}, predictor {predictor}, {bits} bits")
        kind = np.dtype(np.uint8 if bits == 8 else order + "u2")
        image = np.zeros((height, width * samples), kind)
        cell_w, cell_h = (one(TILE_WIDTH), one(TILE_LENGTH)) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
        across = -(-width // cell_w)
        cells = zip(tags[TILE_OFFSETS if tiled else STRIP_OFFSETS], tags[TILE_COUNTS if tiled else STRIP_COUNTS], strict=True)
        for k, (start, count) in enumerate(cells):
            top, left = k // across * cell_h, k % across * cell_w
            rows = cell_h if tiled else min(cell_h, height - top)
            part = DECODERS[code](bytes(raw[start : start + count]))
            block = np.frombuffer(part, kind, rows * cell_w * samples).reshape(rows, cell_w, samples)
            if predictor == 2:
                block = np.cumsum(block, axis=1, dtype=np.uint8 if bits == 8 else np.uint16).astype(kind)
            h, w = min(rows, height - top), min(cell_w, width - left)
            image[top : top + h, left * samples : (left + w) * samples] = block[:h, :w].reshape(h, -1)
        yield Page(len(seen) - 1, width, height, samples, bits, code, predictor, tiled, image.tobytes())
        at = following


def write_tiff(images: list[np.ndarray], compression: int | list[int] = DEFLATE, predictor: int = 2, tiled: list[bool] | None = None, order: str = "<") -> bytes:
    """A TIFF of 8-bit single-sample images, each (rows, columns); a list has a compression for each."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for k, image in enumerate(images):
        height, width = image.shape
        tile = bool(tiled and tiled[k])
        code = compression if isinstance(compression, int) else compression[k]
        step_h, step_w = (TILE_ROWS, -(-width // 16) * 16) if tile else (STRIP_ROWS, width)
        offsets, counts = [], []
        for top in range(0, height, step_h):
            block = image[top : top + step_h]
            if tile:
                block = np.pad(block, ((0, step_h - len(block)), (0, step_w - width)))
            if predictor == 2:
                block = np.diff(block, axis=1, prepend=np.zeros((len(block), 1), np.uint8))
            part = ENCODERS[code](block.astype(np.uint8).tobytes())
            offsets.append(len(out))
            counts.append(len(part))
            out += part + b"\0" * (len(part) % 2)
        entries = [(WIDTH, 4, [width]), (LENGTH, 4, [height]), (BITS, 3, [8]), (COMPRESSION, 3, [code]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [1]), (PREDICTOR, 3, [predictor])]
        entries += [(TILE_WIDTH, 4, [step_w]), (TILE_LENGTH, 4, [step_h]), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, counts)] if tile else [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [step_h]), (STRIP_COUNTS, 4, counts)]
        body = bytearray(struct.pack(order + "H", len(entries)))
        far = bytearray()
        at = len(out)
        beyond = at + 2 + 12 * len(entries) + 4
        for tag, kind, values in sorted(entries):
            packed = struct.pack(f"{order}{len(values)}{'H' if kind == 3 else 'I'}", *values)
            body += struct.pack(order + "HHI", tag, kind, len(values))
            if len(packed) <= 4:
                body += packed.ljust(4, b"\0")
            else:
                body += struct.pack(order + "I", beyond + len(far))
                far += packed
        out[link : link + 4] = struct.pack(order + "I", at)
        link = at + len(body)
        out += body + b"\0\0\0\0" + far
    return bytes(out)


#: Compressions of the stored pages, taken in turn from one that the payload's checksum picks.
CODES = (DEFLATE, LZW, PACKBITS)


def store_payload(payload: bytes) -> bytes:
    """A payload (a multiple of 64 bytes) as a TIFF: 64 columns, pages of 1024
    rows, strips on even pages and tiles on odd ones, ``CODES`` in turn, so that
    all of the decoder is used; equal payloads give equal files."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    images = [rows[k : k + PAGE_ROWS] for k in range(0, len(rows), PAGE_ROWS)]
    first = zlib.crc32(payload)
    return write_tiff(images, [CODES[(first + k) % len(CODES)] for k in range(len(images))], 2, [k % 2 == 1 for k in range(len(images))])


def encode_texts(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text as a TIFF; a null text is empty, and
    every payload has at least one row of zeros. Null ids and repeated rows give
    a row each; an empty table gives none; other columns, whatever their names,
    are not read."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, len(b), BATCH):
                part = b.slice(k, BATCH)
                raw = [t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()]
                media = [store_payload(t.ljust(max(1, -(-len(t) // ROW)) * ROW, b"\0")) for t in raw]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in raw], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(f"`{ident}`").cast("long"), F.col(f"`{text}`")).mapInArrow(encode, "doc_id long, n_bytes long, media binary")


PAGE_FIELDS = "page int, width long, height long, samples int, bits int, compression int, predictor int, tiled boolean, data binary, error string"


def decode_pages(files: DataFrame, media: str = "media") -> DataFrame:
    """One row per page: the columns of ``files`` but ``media``, then
    ``PAGE_FIELDS``. Pages of a file follow each other in its partition. A
    broken or null file gives its whole pages and a row with ``error`` and a
    null page. Of columns named alike the new one wins.
    """
    new = T.StructType.fromDDL(PAGE_FIELDS)
    names = [c for c in files.columns if c != media and c.lower() not in new.names]
    schema = T.StructType([files.schema[c] for c in names] + new.fields)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(new)
        for b in batches:
            for k in range(0, len(b), BATCH):
                part = b.slice(k, BATCH)
                rows, source = [], []
                for i, raw in enumerate(part.column(len(names)).to_pylist()):
                    try:
                        for p in read_pages(raw or b""):
                            source.append(i)
                            rows.append((p.page, p.width, p.height, p.samples, p.bits, p.compression, p.predictor, p.tiled, p.data, None))
                    except (ValueError, KeyError, struct.error, zlib.error) as e:
                        source.append(i)
                        rows.append((None,) * 9 + (str(e)[:200] or type(e).__name__,))
                columns = list(zip(*rows, strict=True)) or [[]] * len(new)
                kept = [part.column(j).take(pa.array(source, pa.int64())) for j in range(len(names))]
                yield pa.RecordBatch.from_arrays(kept + [pa.array(c, kinds.field(j).type) for j, c in enumerate(columns)], schema.names)

    return files.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{media}`")).mapInArrow(decode, schema)


def _features(pages: int, payload: bytes) -> str:
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256).tolist()
    n = len(payload)
    mean = sum(i * c for i, c in enumerate(counts)) / n
    entropy = -math.fsum(c / n * math.log2(c / n) for c in counts if c)
    return f"pages={pages};rows={n // ROW};mean={mean:.4f};entropy={entropy:.4f};zeros={counts[0]};levels={sum(c > 0 for c in counts)}"


def payload_features(pages: DataFrame) -> DataFrame:
    """Puts the pages of each file together again and describes the payload.

    Pages of a file follow each other in its partition, as ``decode_pages``
    leaves them; page 0 starts the next file, so null and repeated ids stay
    apart. A broken file is an error. An empty table gives no rows."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        done: list[tuple] = []
        head: tuple | None = None
        parts: list[bytes] = []

        def close() -> None:
            if head is not None:
                payload = b"".join(parts)
                doc, n, media_bytes, media_sha = head
                done.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]), media_bytes, media_sha, _features(len(parts), payload)))

        def flush() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)
            done.clear()
            return batch

        for b in batches:
            for *new, page, data, error in zip(*[b.column(k).to_pylist() for k in range(7)], strict=True):
                if error:
                    raise ValueError(f"stored file of document {new[0]}: {error}")
                if page == 0:
                    close()
                    head, parts = tuple(new), []
                parts.append(data)
                if len(done) >= 1000:
                    yield flush()
        close()
        if done:
            yield flush()

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return pages.select("doc_id", "n_bytes", "media_bytes", "media_sha256", "page", "data", "error").mapInArrow(describe, schema)


def op6_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``, each text stored as a TIFF and read back page by page."""
    files = encode_texts(table(spark, sf_dir, "documents"))
    files = files.withColumn("media_bytes", F.octet_length("media").cast("long")).withColumn("media_sha256", F.sha2("media", 256))
    return payload_features(decode_pages(files))
