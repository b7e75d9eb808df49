"""TIFF pages (operator 1): write samples as TIFF, and turn TIFF bytes into one row per page.

The reader walks the chain of image directories (classic and 64-bit files, both
byte orders), decodes uncompressed, PackBits, LZW and deflate strips and tiles,
and undoes the horizontal and floating-point predictors.

Defined cases: a null cell gives one row with ``error`` "null"; bytes that are
no TIFF, or break off, give the pages read so far and then one row with
``error``; no input makes a task fail, as sizes of odd field types and any other failure
of decoding are error rows too.  A text or page may be as long as a cell of a table can
hold.  Repeated rows give repeated pages, an empty table gives an empty one; columns kept
may have any names (new ones are underscored until they clash with none).
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import bounded_batches, free_name, slices

# Field types (struct code, bytes) and tag numbers of TIFF 6.0 and of its 64-bit form.
FIELD_TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, FILL_ORDER = 256, 257, 258, 259, 262, 266
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, SAMPLE_FORMAT = 322, 323, 324, 325, 339
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
NAMES = {NONE: "none", LZW: "lzw", DEFLATE: "deflate", OLD_DEFLATE: "deflate", PACKBITS: "packbits"}
CLEAR, END, FIRST_FREE, LAST_ENTRY = 256, 257, 258, 4094

#: Tags whose values are whole numbers from 0, whatever type a file gives them.
_COUNTS = {WIDTH, HEIGHT, BITS, COMPRESSION, FILL_ORDER, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES}
#: What a cell of a table can hold.
CELL_BYTES = (1 << 31) - 1

#: Bits of the j-th code after a clear code, and where it starts.
_LZW_BITS = np.array([9] * 254 + [10] * 512 + [11] * 1024 + [12] * 2049, dtype=np.int64)
_LZW_AT = np.concatenate([[0], np.cumsum(_LZW_BITS)[:-1]])
_SINGLES = [bytes([i]) for i in range(256)] + [b"", b""]
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
_RUN = re.compile(rb"(.)\1{2,127}", re.DOTALL)

#: Codings that stored payloads go through in turn: compression, tiled, predictor.
CODINGS = ((DEFLATE, False, 1), (LZW, False, 1), (PACKBITS, False, 1), (DEFLATE, True, 2), (LZW, True, 2), (PACKBITS, True, 1))


class TiffError(ValueError):
    """The bytes can't be read as the TIFF they claim to be."""


# -- codecs -----------------------------------------------------------------


def packbits_encode(data: bytes) -> bytes:
    out, at = bytearray(), 0

    def literal(end: int) -> None:
        for a in range(at, end, 128):
            piece = data[a : min(a + 128, end)]
            out.append(len(piece) - 1)
            out.extend(piece)

    for run in _RUN.finditer(data):
        literal(run.start())
        out.extend((257 - (run.end() - run.start()), data[run.start()]))
        at = run.end()
    literal(len(data))
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, at, end = bytearray(), 0, len(data)
    while at < end and len(out) < size:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    """Codes of the variable-width dictionary coder, most significant bit first."""
    segments, codes, table, free = [], [], {}, FIRST_FREE
    it = iter(data)
    held = next(it, None)
    for byte in it:
        key = held << 8 | byte
        longer = table.get(key)
        if longer is not None:
            held = longer
            continue
        codes.append(held)
        table[key] = free
        held = byte
        if free == LAST_ENTRY:
            codes.append(CLEAR)
            segments.append(codes)
            codes, table, free = [], {}, FIRST_FREE
        else:
            free += 1
    if held is not None:
        codes.append(held)
    codes.append(END)
    segments.append(codes)
    every = np.concatenate([[CLEAR], *segments]).astype(">u2")
    widths = np.concatenate([[9], *(_LZW_BITS[: len(s)] for s in segments)])
    bits = np.unpackbits(every.view(np.uint8)).reshape(-1, 16)
    return np.packbits(bits[np.arange(16) >= 16 - widths[:, None]]).tobytes()


def lzw_decode(data: bytes, size: int) -> bytes:
    raw = np.frombuffer(data + b"\0\0\0\0", dtype=np.uint8).astype(np.int64)
    total, at, out, got = 8 * len(data), 0, [], 0
    while got < size and at + 9 <= total:
        n = min(len(_LZW_AT), (total - at) // 9 + 1)
        where, wide = at + _LZW_AT[:n], _LZW_BITS[:n]
        inside = where + wide <= total
        where, wide = where[inside], wide[inside]
        byte = where >> 3
        window = raw[byte] << 24 | raw[byte + 1] << 16 | raw[byte + 2] << 8 | raw[byte + 3]
        codes = window >> (32 - (where & 7) - wide) & ((1 << wide) - 1)
        stop = np.flatnonzero((codes == CLEAR) | (codes == END))
        upto = int(stop[0]) if len(stop) else len(codes)
        if upto:
            table, rest = _SINGLES.copy(), codes[:upto].tolist()
            if rest[0] > 255:
                raise TiffError("an LZW segment starts with an unknown code")
            before = table[rest[0]]
            out.append(before)
            got += len(before)
            for code in rest[1:]:
                if code < len(table):
                    entry = table[code]
                elif code == len(table):
                    entry = before + before[:1]
                else:
                    raise TiffError("an LZW code lies beyond the table")
                out.append(entry)
                got += len(entry)
                table.append(before + entry[:1])
                before = entry
        if not len(stop) or codes[upto] == END:
            break
        at = int(where[upto] + wide[upto])
    return b"".join(out)


def _expand(kind: int, data: bytes, size: int) -> bytes:
    if kind == NONE:
        return data
    if kind == PACKBITS:
        return packbits_decode(data, size)
    if kind == LZW:
        return lzw_decode(data, size)
    if kind in (DEFLATE, OLD_DEFLATE):
        try:
            return zlib.decompressobj().decompress(data, size)
        except zlib.error as e:
            raise TiffError(f"deflate: {e}") from None
    raise TiffError(f"compression {kind} isn't supported")


def _shrink(kind: int, data: bytes) -> bytes:
    return {NONE: bytes, PACKBITS: packbits_encode, LZW: lzw_encode, DEFLATE: zlib.compress}[kind](data)


# -- writer -----------------------------------------------------------------


def write_tiff(pages, rows_per_strip: int = 128, tile: int = 64) -> bytes:
    """A little-endian file of 8-bit grey pages: (rows x columns array, compression, tiled, predictor) each."""
    out = bytearray(struct.pack("<2sHI", b"II", 42, 0))
    link = 4
    for samples, kind, tiled, predictor in pages:
        high, wide = samples.shape
        if tiled:
            padded = np.zeros((-(-high // tile) * tile, -(-wide // tile) * tile), dtype=np.uint8)
            padded[:high, :wide] = samples
            parts = [padded[y : y + tile, x : x + tile] for y in range(0, padded.shape[0], tile) for x in range(0, padded.shape[1], tile)]
        else:
            parts = [samples[y : y + rows_per_strip] for y in range(0, high, rows_per_strip)]
        offsets, lengths = [], []
        for part in parts:
            if predictor == 2:
                part = np.diff(part, axis=1, prepend=np.uint8(0))
            data = _shrink(kind, part.tobytes())
            offsets.append(len(out))
            lengths.append(len(data))
            out += data + b"\0" * (len(data) & 1)
        fields = {WIDTH: (4, [wide]), HEIGHT: (4, [high]), BITS: (3, [8]), COMPRESSION: (3, [kind]), PHOTOMETRIC: (3, [1]), SAMPLES: (3, [1]), PLANAR: (3, [1]), PREDICTOR: (3, [predictor])}
        if tiled:
            fields |= {TILE_WIDTH: (4, [tile]), TILE_HEIGHT: (4, [tile]), TILE_OFFSETS: (4, offsets), TILE_BYTES: (4, lengths)}
        else:
            fields |= {ROWS_PER_STRIP: (4, [rows_per_strip]), STRIP_OFFSETS: (4, offsets), STRIP_BYTES: (4, lengths)}
        entries = b""
        for tag, (kind_of, values) in sorted(fields.items()):
            data = struct.pack(f"<{len(values)}{FIELD_TYPES[kind_of]}", *values)
            if len(data) > 4:
                data, at = struct.pack("<I", len(out)), data
                out += at
            entries += struct.pack("<HHI", tag, kind_of, len(values)) + data.ljust(4, b"\0")
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def payload_tiff(payload: bytes, width: int = 64) -> bytes:
    """A one-page file that holds ``payload`` (a positive multiple of ``width`` bytes) as samples.

    The coding follows from the payload alone, so equal payloads give equal files.
    """
    samples = np.frombuffer(payload, dtype=np.uint8).reshape(-1, width)
    return write_tiff([(samples, *CODINGS[zlib.crc32(payload) % len(CODINGS)])])


# -- reader -----------------------------------------------------------------


@dataclass
class Page:
    width: int
    height: int
    bits: int
    samples: int
    compression: str
    predictor: int
    layout: str
    pixels: bytes = field(repr=False)


def _directories(data: bytes) -> Iterator[tuple[str, dict]]:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order:
        raise TiffError("no TIFF signature")
    try:
        (magic,) = struct.unpack_from(order + "H", data, 2)
        if magic == 42:
            count_at, entry, offset, first = "H", "HHI4s", "I", 4
        elif magic == 43:
            count_at, entry, offset, first = "Q", "HHQ8s", "Q", 8
        else:
            raise TiffError(f"version {magic}")
        size, inline = struct.calcsize("=" + entry), struct.calcsize("=" + offset)
        (at,), seen = struct.unpack_from(order + offset, data, first), set()
        while at:
            if at in seen:
                raise TiffError("the directories form a loop")
            seen.add(at)
            (n,) = struct.unpack_from(order + count_at, data, at)
            at += struct.calcsize("=" + count_at)
            tags = {}
            if n * size > len(data):
                raise TiffError("a directory is longer than the file")
            for i in range(n):
                tag, kind, count, raw = struct.unpack_from(order + entry, data, at + i * size)
                code = FIELD_TYPES.get(kind)
                if code is None:
                    continue
                if (length := count * struct.calcsize("=" + code)) > inline:
                    (where,) = struct.unpack(order + offset, raw)
                    raw = data[where : where + length]
                if len(raw) < length:
                    raise TiffError(f"the values of tag {tag} lie beyond the file")
                tags[tag] = struct.unpack(f"{order}{count}{code}", raw[:length])
            yield order, tags
            (at,) = struct.unpack_from(order + offset, data, at + n * size)
    except struct.error as e:
        raise TiffError(f"the file breaks off: {e}") from None


def _undo(data: bytes, predictor: int, rows: int, columns: int, samples: int, bits: int, order: str) -> np.ndarray:
    """Decoded rows as bytes, little-endian where a sample has more than one."""
    row_bytes = (columns * samples * bits + 7) // 8
    grid = np.frombuffer(data, dtype=np.uint8, count=rows * row_bytes).reshape(rows, row_bytes)
    if predictor == 3:
        if bits not in (16, 32, 64):
            raise TiffError("the floating-point predictor needs 16, 32 or 64 bits")
        summed = np.cumsum(grid.reshape(rows, -1, samples), axis=1, dtype=np.uint8).reshape(rows, bits // 8, -1)
        return np.ascontiguousarray(summed[:, ::-1].transpose(0, 2, 1)).reshape(rows, row_bytes)
    if bits > 8:
        grid = np.ascontiguousarray(grid).view(f"{order}u{bits // 8}").astype(f"<u{bits // 8}")
    if predictor == 2:
        if bits < 8:
            raise TiffError("the horizontal predictor needs whole bytes")
        grid = np.cumsum(grid.reshape(rows, columns, samples), axis=1, dtype=grid.dtype).reshape(rows, -1)
    elif predictor != 1:
        raise TiffError(f"predictor {predictor}")
    return np.ascontiguousarray(grid).view(np.uint8).reshape(rows, row_bytes)


def _page(data: bytes, order: str, tags: dict, most: int) -> Page:
    for tag in _COUNTS & tags.keys():
        if not all(isinstance(v, int) and v >= 0 for v in tags[tag]):
            raise TiffError(f"tag {tag} doesn't hold whole numbers from 0")
    one = lambda tag, default=None: tags[tag][0] if tags.get(tag) else default
    wide, high, kind = one(WIDTH), one(HEIGHT), one(COMPRESSION, NONE)
    if not wide or not high:
        raise TiffError("a page without width or height")
    depths = set(tags.get(BITS, (1,)))
    bits, samples, predictor, planar = depths.pop(), one(SAMPLES, 1), one(PREDICTOR, 1), one(PLANAR, 1)
    if depths or bits not in (1, 2, 4, 8, 16, 32, 64) or not samples:
        raise TiffError("samples of mixed or unknown depth")
    if max(wide, high, samples) > 0x7FFFFFFF:
        raise TiffError("more than 2147483647 columns, rows or samples")
    if wide * high * samples * bits > 8 * most:
        raise TiffError(f"the page would take more than {most} bytes")
    if planar == 2 and bits < 8:
        raise TiffError("separate planes of less than a byte")
    per = samples if planar == 1 else 1
    planes = samples // per
    tiled = TILE_OFFSETS in tags
    part_w, part_h = (one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0)) if tiled else (wide, min(one(ROWS_PER_STRIP, high) or high, high))
    if not part_w or not part_h or part_w * part_h * per * bits > 8 * most:
        raise TiffError("tiles or strips of no or too large a size")
    offsets = tags.get(TILE_OFFSETS if tiled else STRIP_OFFSETS, ())
    lengths = tags.get(TILE_BYTES if tiled else STRIP_BYTES, ())
    across, down = -(-wide // part_w), -(-high // part_h)
    if len(offsets) < across * down * planes or len(lengths) < len(offsets):
        raise TiffError("strips or tiles are missing")
    row_bytes, part_bytes = (wide * per * bits + 7) // 8, (part_w * per * bits + 7) // 8
    if tiled and part_w * per * bits % 8:
        raise TiffError("a tile's row isn't a whole number of bytes")
    out = np.zeros((planes, high, max(row_bytes, across * part_bytes)), dtype=np.uint8)
    for i in range(across * down * planes):
        plane, y, x = i // (across * down), i // across % down, i % across
        rows = part_h if tiled else min(part_h, high - y * part_h)
        raw = data[offsets[i] : offsets[i] + lengths[i]]
        if one(FILL_ORDER, 1) == 2:
            raw = raw.translate(_REVERSED)
        plain = _expand(kind, raw, rows * part_bytes)
        if len(plain) < rows * part_bytes:
            raise TiffError("a strip or tile is too short")
        grid = _undo(plain, predictor, rows, part_w, per, bits, order)
        shown = min(rows, high - y * part_h)
        out[plane, y * part_h : y * part_h + shown, x * part_bytes : (x + 1) * part_bytes] = grid[:shown]
    out = out[:, :, :row_bytes]
    if planes > 1:
        out = out.reshape(planes, high, wide, bits // 8).transpose(1, 2, 0, 3)
    return Page(wide, high, bits, samples, NAMES.get(kind, str(kind)), predictor, "tiles" if tiled else "strips", np.ascontiguousarray(out).tobytes())


def read_pages(data: bytes, most: int = CELL_BYTES) -> Iterator[Page]:
    """The pages in file order; raises :class:`TiffError` where the file can't be read on, whatever is wrong with it."""
    directories = _directories(data)
    while True:
        try:
            order, tags = next(directories)
            page = _page(data, order, tags, most)
        except StopIteration:
            return
        except TiffError:
            raise
        except (MemoryError, ValueError, TypeError, IndexError, KeyError, OverflowError, ArithmeticError, struct.error, zlib.error) as e:
            raise TiffError(f"unreadable: {type(e).__name__}") from e
        yield page


def feature(pixels: bytes) -> str:
    """Mean, deviation and a 64-bit average hash of the sample bytes."""
    raw = np.frombuffer(pixels, dtype=np.uint8)
    counts, values = np.bincount(raw, minlength=256), np.arange(256)
    mean = float(counts @ values) / len(raw)
    spread = (float(counts @ values**2) / len(raw) - mean * mean) ** 0.5 if len(raw) else 0.0
    edges = np.linspace(0, len(raw), 65).astype(np.int64)
    level = np.diff(np.concatenate([[0], np.cumsum(raw, dtype=np.int64)])[edges]) / np.maximum(np.diff(edges), 1)
    return f"mean={mean:.4f};std={abs(spread):.4f};ahash={np.packbits(level > mean).tobytes().hex()}"


# -- operators --------------------------------------------------------------


def store_texts(df: DataFrame, text: str = "text", keep: tuple = (), width: int = 64) -> DataFrame:
    """Each text (null: empty) as a one-page TIFF: ``keep`` columns, ``n_bytes`` (unpadded) and ``media``."""
    size, media = free_name(keep, "n_bytes"), free_name(keep, "media")
    inner = free_name(keep, "stored_text")
    bounded_batches(df.sparkSession)
    source = df.select(*keep, F.col(text).cast("string").alias(inner))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField(size, T.LongType()), T.StructField(media, T.BinaryType())])

    def run(batches):
        for batch in slices(batches):
            plain = [(x or "").encode() for x in batch.column(batch.num_columns - 1).to_pylist()]
            files = [payload_tiff(x + b"\0" * (-len(x) % width if x else width), width) for x in plain]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(map(len, plain), pa.int64()), pa.array(files, pa.binary())], names=schema.names)

    return source.mapInArrow(run, schema)


PAGE_FIELDS = (("page", "int"), ("width", "int"), ("height", "int"), ("bits", "int"), ("samples", "int"), ("compression", "string"), ("predictor", "int"), ("layout", "string"), ("pixels", "binary"), ("feature", "string"), ("error", "string"))


def tiff_pages(df: DataFrame, media: str = "media", keep: tuple = (), most: int = CELL_BYTES) -> DataFrame:
    """One row per page of each file: the ``keep`` columns and those of PAGE_FIELDS (page counts from 0).

    ``most`` bounds the bytes of a decoded page; a larger one is an error row.  The default is
    what a cell of a table can hold, so no page that could be a row is refused.
    """
    names = [free_name(keep, n) for n, _ in PAGE_FIELDS]
    inner = free_name(keep, "tiff_bytes")
    bounded_batches(df.sparkSession)
    source = df.select(*keep, F.col(media).alias(inner))
    schema = T.StructType([*source.schema.fields[:-1], *T._parse_datatype_string(", ".join(f"`{n}` {kind}" for n, (_, kind) in zip(names, PAGE_FIELDS, strict=True))).fields])
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.binary(), pa.string(), pa.string()]

    def run(batches):
        for batch in slices(batches):
            took, rows = [], []
            for i, cell in enumerate(batch.column(batch.num_columns - 1)):
                n, data = 0, cell.as_py()
                try:
                    if data is None:
                        raise TiffError("null")
                    for p in read_pages(data, most):
                        rows.append((n, p.width, p.height, p.bits, p.samples, p.compression, p.predictor, p.layout, p.pixels, feature(p.pixels), None))
                        took.append(i)
                        n += 1
                except TiffError as e:
                    rows.append((n, *[None] * 9, str(e)))
                    took.append(i)
            at = pa.array(took, pa.int64())
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns[:-1]), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=schema.names)

    return source.mapInArrow(run, schema)
