"""TIFF columns: files of many pages in a binary column, one row per page.

The reader walks the chain of image directories in either byte order, decodes PackBits, LZW or deflate strips and
tiles, undoes the horizontal predictor and gives each page's samples. The writer makes such files from pixel arrays,
so that media can be stored losslessly: see payload_documents, which keeps any bytes as 8-bit grey pages.

Each file is decoded in the task that holds its row; a page never needs another row, and nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import common

# Fixed values of the TIFF 6.0 specification.
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, STRIP_ROWS, STRIP_COUNTS, PLANAR, PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325
TYPE_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
CLEAR, END, FIRST = 256, 257, 258


def unpack_packbits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
                i += 1
            i += 1
    return bytes(out)


def pack_packbits(data: bytes) -> bytes:
    """Runs of three or more equal bytes as runs, what is between them as literals of up to 128."""
    out = bytearray()
    a = np.frombuffer(data, np.uint8)
    edges = np.flatnonzero(np.diff(a)) + 1
    starts = np.concatenate([[0], edges]) if len(a) else np.zeros(0, int)
    lengths = np.diff(np.append(starts, len(a)))
    long = lengths >= 3
    at = 0

    def literal(end: int) -> None:
        for i in range(at, end, 128):
            part = data[i : min(i + 128, end)]
            out.append(len(part) - 1)
            out.extend(part)

    for start, n in zip(starts[long].tolist(), lengths[long].tolist(), strict=True):
        literal(start)
        at = start + n
        while n:
            run = min(n, 128)
            out += bytes((257 - run if run > 1 else 0, data[start]))
            n -= run
    literal(len(data))
    return bytes(out)


#: The first bit and the width of the n-th code behind a clear code: from 9 to 12 bits, widening one code early.
_WIDTHS = np.array([9 + sum(FIRST + n >= 1 << w for w in (9, 10, 11)) for n in range(1 << 13)])
_BEGINS = np.concatenate([[0], np.cumsum(_WIDTHS)])
_SINGLE = [bytes((i,)) for i in range(256)] + [b"", b""]


def _codes(data: np.ndarray, begin: int, end: int) -> np.ndarray:
    """The codes from bit `begin` on, behind a clear code, up to the next clear or end code (with it) or bit `end`."""
    n = int(np.searchsorted(_BEGINS, end - begin, "right")) - 1
    at, width = begin + _BEGINS[:n], _WIDTHS[:n]
    byte = at >> 3
    three = data[byte] << 16 | data[byte + 1] << 8 | data[byte + 2]
    codes = three >> (24 - (at & 7) - width) & ((1 << width) - 1)
    stop = np.flatnonzero((codes == CLEAR) | (codes == END))
    return codes[: stop[0] + 1] if len(stop) else codes


def unpack_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, the high bit first, that widen one code early. Codes are cut out a table's length at once."""
    wide = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64)
    out: list[bytes] = []
    at, end = 0, 8 * len(data)
    while True:
        found = _codes(wide, at, end)
        if not len(found):
            break
        at += int(_BEGINS[len(found)])
        codes = found.tolist()
        last_code = codes.pop() if codes[-1] in (CLEAR, END) else None
        if codes:
            table = _SINGLE.copy()
            last = table[codes[0]]
            out.append(last)
            size = FIRST
            for code in codes[1:]:
                if code < size:
                    word = table[code]
                    table.append(last + word[:1])
                elif code == size:
                    word = last + last[:1]
                    table.append(word)
                else:
                    raise ValueError(f"LZW code {code} before its time")
                size += 1
                out.append(word)
                last = word
        if last_code != CLEAR:
            break
    return b"".join(out)


def pack_lzw(data: bytes) -> bytes:
    """Strings are known by their code and the next byte; a full table is cleared. Codes become bits all at once."""
    codes, table, new, word = [CLEAR], {}, FIRST, -1
    for byte in data:
        if word < 0:
            word = byte
            continue
        longer = word << 8 | byte
        known = table.get(longer)
        if known is not None:
            word = known
            continue
        codes.append(word)
        table[longer] = new
        new += 1
        if new >= 4094:
            codes.append(CLEAR)
            table, new = {}, FIRST
        word = byte
    if word >= 0:
        codes.append(word)
    codes.append(END)
    all_ = np.array(codes)
    clear = np.maximum.accumulate(np.where(all_ == CLEAR, np.arange(len(all_)), -1))
    width = _WIDTHS[np.arange(len(all_)) - 1 - np.concatenate([[-1], clear[:-1]])]
    place = np.arange(12)
    bits = all_[:, None] >> np.maximum(width[:, None] - 1 - place, 0) & 1
    return np.packbits(bits[place < width[:, None]].astype(np.uint8)).tobytes()


def pack(data: bytes, compression: int) -> bytes:
    return data if compression == NONE else pack_packbits(data) if compression == PACKBITS else pack_lzw(data) if compression == LZW else zlib.compress(data, 6)


def unpack(data: bytes, compression: int) -> bytes:
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(data)
    if compression == LZW:
        return unpack_lzw(data)
    if compression == PACKBITS:
        return unpack_packbits(data)
    if compression == NONE:
        return data
    raise ValueError(f"compression {compression} is not supported")


@dataclass
class Page:
    number: int
    samples: np.ndarray  # rows, columns, samples a pixel
    compression: int
    predictor: int
    tiled: bool


def _values(data: bytes, order: str, kind: int, count: int, at: int) -> list[int]:
    size = TYPE_SIZES.get(kind, 0) * count
    if size > 4:
        at = struct.unpack_from(order + "I", data, at)[0]
    letter = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}.get(kind)
    return list(struct.unpack_from(f"{order}{count}{letter}", data, at)) if letter else []


def read_pages(data: bytes) -> Iterator[Page]:
    """The pages of a TIFF file; samples of 8 or 16 bits, chunky or planar. Damaged files raise ValueError."""
    try:
        order = {b"II": "<", b"MM": ">"}[bytes(data[:2])]
        magic, at = struct.unpack_from(order + "HI", data, 2)
        if magic != 42:
            raise ValueError("not a TIFF file")
        seen: set[int] = set()
        while at:
            if at in seen:
                raise ValueError("directories form a circle")
            seen.add(at)
            (n,) = struct.unpack_from(order + "H", data, at)
            tags = {}
            for i in range(n):
                tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
                tags[tag] = _values(data, order, kind, count, at + 10 + 12 * i)
            yield _page(len(seen) - 1, data, order, tags)
            (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
    except (KeyError, IndexError, struct.error, zlib.error) as e:
        raise ValueError(f"damaged TIFF file: {e!r}") from e


def _page(number: int, data: bytes, order: str, tags: dict[int, list[int]]) -> Page:
    first = lambda tag, default: (tags.get(tag) or [default])[0]
    columns, rows, deep = tags[WIDTH][0], tags[LENGTH][0], first(SAMPLES, 1)
    bits, compression, predictor = set(tags.get(BITS) or [1]), first(COMPRESSION, NONE), first(PREDICTOR, 1)
    if bits not in ({8}, {16}) or predictor not in (1, 2):
        raise ValueError(f"samples of {bits} bits with predictor {predictor} are not supported")
    kind = np.dtype(np.uint8) if bits == {8} else np.dtype(order + "u2")
    tiled = TILE_OFFSETS in tags
    wide, high = (tags[TILE_WIDTH][0], tags[TILE_LENGTH][0]) if tiled else (columns, min(rows, first(STRIP_ROWS, rows)))
    offsets, counts = (tags[TILE_OFFSETS], tags[TILE_COUNTS]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_COUNTS])
    planes = deep if first(PLANAR, 1) == 2 else 1
    each = deep // planes
    across, down = -(-columns // wide), -(-rows // high)
    out = np.empty((rows, columns, deep), kind.newbyteorder("="))
    if len(offsets) != across * down * planes:
        raise ValueError("wrong number of strips or tiles")
    for k, (at, size) in enumerate(zip(offsets, counts, strict=True)):
        plane, cell = divmod(k, across * down)
        y, x = cell // across * high, cell % across * wide
        tall = high if tiled else min(high, rows - y)
        block = np.frombuffer(unpack(data[at : at + size], compression), kind, tall * wide * each).reshape(tall, wide, each).astype(out.dtype)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=out.dtype)
        h, w = min(tall, rows - y), min(wide, columns - x)
        out[y : y + h, x : x + w, plane * each : (plane + 1) * each] = block[:h, :w]
    return Page(number, out, compression, predictor, tiled)


def write_pages(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, strip_rows: int = 64, tile: int | tuple[int, int] = 0) -> bytes:
    """A little-endian file of 8-bit pages (rows, columns), in strips of strip_rows, or in tiles of `tile` (side, or width and height: multiples of 16)."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for page in pages:
        rows, columns = page.shape
        wide, high = (columns, strip_rows) if not tile else (tile, tile) if isinstance(tile, int) else tile
        offsets, counts = [], []
        for y in range(0, rows, high):
            for x in range(0, columns, wide):
                block = page[y : y + high, x : x + wide]
                if tile:
                    block = np.pad(block, ((0, high - block.shape[0]), (0, wide - block.shape[1])))
                if predictor == 2:
                    block = np.diff(block, axis=1, prepend=block.dtype.type(0))
                part = pack(np.ascontiguousarray(block).tobytes(), compression)
                offsets.append(len(out))
                counts.append(len(part))
                out += part
        out += b"\0" * (len(out) % 2)
        where, n = len(out), len(offsets)
        out += struct.pack(f"<{n}I{n}I", *offsets, *counts)
        place = lambda i: where + 4 * n * i if n > 1 else (offsets, counts)[i][0]
        tags = [(WIDTH, 4, 1, columns), (LENGTH, 4, 1, rows), (BITS, 3, 1, 8), (COMPRESSION, 3, 1, compression), (PHOTOMETRIC, 3, 1, 1), (SAMPLES, 3, 1, 1), (PREDICTOR, 3, 1, predictor)]
        tags += [(TILE_WIDTH, 4, 1, wide), (TILE_LENGTH, 4, 1, high), (TILE_OFFSETS, 4, n, place(0)), (TILE_COUNTS, 4, n, place(1))] if tile else [(STRIP_OFFSETS, 4, n, place(0)), (STRIP_ROWS, 4, 1, high), (STRIP_COUNTS, 4, n, place(1))]
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in sorted(tags)) + b"\0\0\0\0"
        link = len(out) - 4
    return bytes(out)


def page_rows(files: DataFrame, media: str = "media") -> DataFrame:
    """The rows of files, once for each page of the binary column `media`, with page, page_rows, page_columns,
    page_samples (a pixel), compression, predictor, tiled, pixels (binary, native byte order), error instead of it.

    A null or empty file has no page. A damaged one has a row with `error` and no page, behind those of its pages that
    can be read. A file's rows follow each other, in the order of its pages. Other columns stay; a column with one of
    these names raises.
    """
    added = "page int, page_rows int, page_columns int, page_samples int, compression int, predictor int, tiled boolean, pixels binary, error string"
    names = [x.split()[0] for x in added.split(", ")]
    if clash := set(names) & set(files.columns):
        raise ValueError(f"files have columns {sorted(clash)} already")

    @F.udf(f"array<struct<{added.replace(' ', ':').replace(',:', ',')}>>", useArrow=True)
    def decoded(data: bytes | None) -> list:
        rows: list[tuple] = []
        try:
            for p in read_pages(data) if data else ():
                rows.append((p.number, *p.samples.shape, p.compression, p.predictor, p.tiled, p.samples.tobytes(), None))
        except ValueError as e:
            rows.append((*(None,) * 8, str(e)))
        return rows

    kept = [c for c in files.columns if c != media]
    return files.select(*kept, F.explode(decoded(media)).alias("__page")).select(*kept, "__page.*")


UNIT, COLUMNS, PAGE_ROWS = 576, 576, 64


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Bytes of a text (null: none), and these with 255 behind them up to a positive multiple of UNIT."""
    data = (text or "").encode()
    return len(data), data + b"\xff" * (max(1, -(-len(data) // UNIT)) * UNIT - len(data))


def stored_form(payload: bytes) -> bytes:
    """The payload as grey pages of 576 columns and up to 64 rows.

    The codec (LZW, PackBits or deflate), the predictor, and strips or tiles are drawn by the payload's CRC: texts of
    any length are in any form, and equal payloads are equal files.
    """
    a = np.frombuffer(payload, np.uint8).reshape(-1, COLUMNS)
    drawn = zlib.crc32(payload)
    codec, drawn = (LZW, PACKBITS, DEFLATE)[drawn % 3], drawn // 3
    return write_pages([a[y : y + PAGE_ROWS] for y in range(0, len(a), PAGE_ROWS)], codec, 1 + drawn % 2, 16, (192, 16) if drawn // 2 % 2 else 0)


def payload_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media of every row of docs: its text as TIFF pages (see payload_of, stored_form)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in common.sliced(frames, 200):
            found = [payload_of(x) for x in frame.text]
            yield pd.DataFrame({"doc_id": frame.doc_id.astype("Int64"), "n_bytes": [n for n, _ in found], "media": [stored_form(p) for _, p in found]})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of stored media.

    Files become rows of pages (page_rows); a fold over these, which follow each other in their task, gives a row for
    each file. feature: pages, mean sample and entropy in bits a sample, of all pages' samples. A file that can't be
    read whole has none of what is from its pages, and the error as its feature; a null or empty one has no row.
    """
    columns = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        row, sha, counts, tail, pages, error = None, hashlib.sha256(), np.zeros(256, np.int64), b"", 0, None

        def done() -> tuple:
            head, last = (row.doc_id, row.n_bytes), (row.media_bytes, row.media_sha256)
            if error is not None:
                return *head, None, None, None, *last, error
            n = int(counts.sum())
            share = counts[counts > 0] / n
            feature = f"pages={pages};mean={counts @ np.arange(256) / n:.4f};entropy={-(share * np.log2(share)).sum() + 0.0:.4f}"
            return *head, n, sha.hexdigest(), zlib.crc32(tail), *last, feature

        def table(out: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(out, columns=columns).astype({c: "Int64" for c in ("doc_id", "payload_bytes", "tail_crc32")})

        for frame in frames:
            out = []
            for page in frame.itertuples(index=False):
                if row is None or page.uid != row.uid:
                    if row is not None:
                        out.append(done())
                    row, sha, counts, tail, pages, error = page, hashlib.sha256(), np.zeros(256, np.int64), b"", 0, None
                if page.error is not None:
                    error = page.error
                    continue
                sha.update(page.pixels)
                counts += np.bincount(np.frombuffer(page.pixels, np.uint8), minlength=256)
                tail, pages = (tail + page.pixels)[-32:], pages + 1
            yield table(out)
        if row is not None:
            yield table([done()])

    files = media.select("doc_id", "n_bytes", "media", F.monotonically_increasing_id().alias("uid"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"))
    pages = page_rows(files).select("uid", "doc_id", "n_bytes", "media_bytes", "media_sha256", "pixels", "error")
    return pages.mapInPandas(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def payload_documents(docs: DataFrame) -> DataFrame:
    """media_features of every row of docs, from the stored files read again.

    Repeated rows, nulls and empty texts are rows like others; an empty table gives an empty one.
    """
    return media_features(common.stored(payload_media(docs), "tiff"))


def op5_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """payload_documents of all documents."""
    return payload_documents(common.documents(spark, sf_dir))
