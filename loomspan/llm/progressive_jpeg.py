"""Media columns: progressive JPEG images, decoded to full-resolution RGB tensors.

Decoding runs the scans one after another into coefficient arrays: spectral bands and successive-approximation bits add up
there; then all blocks are transformed back together in numpy, chroma is upsampled, and the tensor is stored as height,
width and RGB bytes (store_tensors; media_round_trip digests tensors and keeps the media alone). All arithmetic after the entropy decoder is on integers (held exactly in doubles for the matrix
product), so equal media give equal tensors on any machine. Scans whose code words all have one width, and refinement
scans made of end-of-band runs, are read column-wise; any other scan by a symbol loop.

Payloads: any bytes can be stored without loss in the format's own unit, the quantised coefficient, by encode_payload. A byte
b is the coefficient b if b >= 128, else b - 255: those are just the values of magnitude category 8, so no coefficient is
zero. The image is 4:2:0 with two spectral bands at one bit less than full precision and refinement scans for the last bit.
The payload's length is in an application segment; blocks beyond it hold spaces.

Defined cases: null and empty texts are 192 spaces; media that can't be decoded give status "error: ..." and nulls; a null
medium gives status "null"; other columns don't matter; empty tables give no row.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, scratch, ship, sliced

#: Payloads are filled up with spaces to a multiple of this: a block in each of three components.
UNIT = 192
TAG = b"LOOMSPAN\0"
_END_OF_SCAN = re.compile(rb"\xff[\x01-\xcf\xd8-\xff]")
#: Bits of the integer basis functions.
SCALE = 20


def _zigzag() -> np.ndarray:
    """Natural index (8 * row + column) of each coefficient in zigzag order."""
    return np.array([r * 8 + c for r, c in sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))])


ZIGZAG = _zigzag()


def _basis() -> np.ndarray:
    """Row: a coefficient in zigzag order; column: the pixel's part of its inverse transform, in units of 2**-SCALE."""
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    one = np.where(k == 0, np.sqrt(0.5), 1.0) * np.cos((2 * x + 1) * k * np.pi / 16) / 2
    return np.rint(np.einsum("ur,vc->uvrc", one, one).reshape(64, 64)[ZIGZAG] * (1 << SCALE))


BASIS = _basis()


@dataclass
class Component:
    ident: int
    h: int
    v: int
    quant: int
    wide: int = 0  # blocks that its own scans have
    high: int = 0
    stride: int = 0  # blocks with those that fill up the last units
    rows: int = 0
    coefs: np.ndarray = field(default_factory=lambda: np.zeros((0, 64), np.int32))


@dataclass
class Image:
    width: int = 0
    height: int = 0
    components: list[Component] = field(default_factory=list)
    quants: dict[int, np.ndarray] = field(default_factory=dict)
    payload_bytes: int | None = None
    scans: int = 0


@dataclass
class Table:
    """A Huffman table. uniform: bits of code and extra bits together, if that is the same for all symbols."""

    symbols: list[tuple[int, int, int]]  # length, code, symbol

    def __post_init__(self) -> None:
        self.find = {(n, c): s for n, c, s in self.symbols}
        widths = {n + (s & 15) for n, _, s in self.symbols}
        self.uniform = widths.pop() if len(widths) == 1 else None


def read_table(counts: bytes, symbols: bytes) -> Table:
    out, code, k = [], 0, 0
    for n, count in enumerate(counts, 1):
        for _ in range(count):
            out.append((n, code, symbols[k]))
            code, k = code + 1, k + 1
        code <<= 1
    return Table(out)


class Bits:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, n: int) -> int:
        if not n:
            return 0
        a, z = self.at >> 3, (self.at + n + 7) >> 3
        got = int.from_bytes(self.data[a:z].ljust(z - a, b"\xff"), "big")
        self.at += n
        return got >> (z * 8 - self.at) & (1 << n) - 1

    def symbol(self, table: Table) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.take(1)
            if (n, code) in table.find:
                return table.find[n, code]
        raise ValueError("no such Huffman code")

    def many(self, n: int) -> np.ndarray:
        """The next n bits as an array."""
        a, z = self.at >> 3, (self.at + n + 7) >> 3
        if z > len(self.data):
            raise ValueError("the scan ends early")
        bits = np.unpackbits(np.frombuffer(self.data, np.uint8, z - a, a))[self.at - a * 8 :][:n]
        self.at += n
        return bits


def _signed(bits: np.ndarray | int, size: np.ndarray | int):  # noqa: ANN202
    return np.where(bits < (1 << size >> 1), bits - (1 << size) + 1, bits)


def _order(image: Image, chosen: list[Component]) -> list[np.ndarray]:
    """For each component of a scan, its blocks in the scan's order (with several, the units' order, a row a unit)."""
    if len(chosen) == 1:
        c = chosen[0]
        return [(np.arange(c.high)[:, None] * c.stride + np.arange(c.wide)).ravel()]
    out = []
    for c in chosen:
        grid = np.arange(c.rows * c.stride).reshape(c.rows // c.v, c.v, c.stride // c.h, c.h)
        out.append(grid.transpose(0, 2, 1, 3).reshape(-1, c.h * c.v))
    return out


def _dc_first(parts: list[Bits], chosen: list[Component], orders: list[np.ndarray], tables: list[Table], low: int, every: int) -> None:
    per = [o.shape[1] if o.ndim == 2 else 1 for o in orders]
    units = len(orders[0])
    if len(parts) == 1 and len({t.uniform for t in tables}) == 1 and tables[0].uniform and all(t.symbols == tables[0].symbols for t in tables):
        width, table = tables[0].uniform, tables[0]
        rows = parts[0].many(units * sum(per) * width).reshape(-1, width)
        words = (rows.astype(np.int64) << np.arange(width - 1, -1, -1)).sum(axis=1)
        firsts = np.array(sorted((code << (width - n), s) for n, code, s in table.symbols))
        size = firsts[np.searchsorted(firsts[:, 0], words, side="right") - 1, 1]
        diffs = _signed(words & (1 << size) - 1, size).reshape(units, sum(per))
        at = 0
        for c, o, n in zip(chosen, orders, per, strict=True):
            c.coefs[o.ravel(), 0] = np.cumsum(diffs[:, at : at + n].ravel()) << low
            at += n
        return
    for k, bits in enumerate(parts):
        last = [0] * len(chosen)
        for u in range(k * every, min(units, (k + 1) * every)):
            for i, (c, o, t) in enumerate(zip(chosen, orders, tables, strict=True)):
                for b in np.atleast_1d(o[u]):
                    s = bits.symbol(t)
                    last[i] += int(_signed(bits.take(s), s))
                    c.coefs[b, 0] = last[i] << low


def _dc_refine(parts: list[Bits], chosen: list[Component], orders: list[np.ndarray], low: int, every: int) -> None:
    per = [o.shape[1] if o.ndim == 2 else 1 for o in orders]
    units = len(orders[0])
    got = np.concatenate([p.many((min(units, (k + 1) * every) - k * every) * sum(per)) for k, p in enumerate(parts)]).reshape(units, sum(per)).astype(np.int32)
    at = 0
    for c, o, n in zip(chosen, orders, per, strict=True):
        c.coefs[o.ravel(), 0] |= got[:, at : at + n].ravel() << low
        at += n


def _ac_first(parts: list[Bits], c: Component, order: np.ndarray, table: Table, band: tuple[int, int], low: int, every: int) -> None:
    lo, hi = band
    if len(parts) == 1 and len(table.symbols) == 1 and 0 < table.symbols[0][2] < 16:
        n, _, size = table.symbols[0]
        width = n + size
        if width == 8:
            words = np.frombuffer(parts[0].data, np.uint8, len(order) * (hi - lo + 1)).astype(np.int32)
        else:
            words = (parts[0].many(len(order) * (hi - lo + 1) * width).reshape(-1, width).astype(np.int32) << np.arange(width - 1, -1, -1)).sum(axis=1)
        c.coefs[order, lo : hi + 1] = (_signed(words & (1 << size) - 1, size) << low).reshape(len(order), -1)
        return
    for k, bits in enumerate(parts):
        run = 0
        for b in order[k * every : (k + 1) * every]:
            if run:
                run -= 1
                continue
            i = lo
            while i <= hi:
                s = bits.symbol(table)
                r, s = s >> 4, s & 15
                if not s and r < 15:
                    run = (1 << r) + bits.take(r) - 1
                    break
                i += r
                if s:
                    if i > hi:
                        raise ValueError("a run passes the band's end")
                    c.coefs[b, i] = int(_signed(bits.take(s), s)) << low
                i += 1


def _ac_refine(parts: list[Bits], c: Component, order: np.ndarray, table: Table, band: tuple[int, int], low: int, every: int) -> None:
    lo, hi = band
    bit = 1 << low
    for k, bits in enumerate(parts):
        blocks, at = order[k * every : (k + 1) * every], 0
        while at < len(blocks):
            row, i, run = c.coefs[blocks[at]], lo, 0
            while i <= hi:
                s = bits.symbol(table)
                r, s = s >> 4, s & 15
                if not s and r < 15:
                    run = (1 << r) + bits.take(r)
                    break
                new = (bit if bits.take(1) else -bit) if s else 0
                while i <= hi:
                    if row[i]:
                        if bits.take(1) and not abs(int(row[i])) & bit:
                            row[i] += bit if row[i] > 0 else -bit
                    elif r:
                        r -= 1
                    else:
                        break
                    i += 1
                if new and i <= hi:
                    row[i] = new
                i += 1
            if not run:
                c.coefs[blocks[at]] = row
                at += 1
                continue
            # an end-of-band run: one correction bit for each coefficient that isn't zero, in order
            some = blocks[at : at + run]
            if i > lo:
                old = np.flatnonzero(row[i : hi + 1]) + i
                got = bits.many(len(old)).astype(np.int32)
                row[old] += np.sign(row[old]) * (got * bit) * (np.abs(row[old]) & bit == 0)
                c.coefs[blocks[at]] = row
                some = some[1:]
            part = c.coefs[some, lo : hi + 1]
            old = part != 0
            got = np.zeros(part.shape, np.int32)
            got[old] = bits.many(int(old.sum()))
            c.coefs[some, lo : hi + 1] = part + np.sign(part) * (got * bit) * (np.abs(part) & bit == 0)
            at += run


def read_coefficients(data: bytes) -> Image:
    """All scans of a progressive JPEG accumulated into the coefficient arrays of its components (zigzag order)."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    image, tables, at, every, progressive = Image(), {}, 2, 0, False
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError(f"no marker at {at}")
        mark = data[at + 1]
        if mark == 0xFF:
            at += 1
            continue
        if mark == 0xD9:
            break
        size = struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if mark == 0xEF and body.startswith(TAG):
            image.payload_bytes = struct.unpack_from(">Q", body, len(TAG))[0]
        elif mark == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                image.quants[body[k] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, k + 1).astype(np.int64)
                k += 1 + 64 * (1 + wide)
        elif mark == 0xC4:
            k = 0
            while k < len(body):
                n = sum(body[k + 1 : k + 17])
                tables[body[k]] = read_table(body[k + 1 : k + 17], body[k + 17 : k + 17 + n])
                k += 17 + n
        elif mark == 0xDD:
            every = struct.unpack(">H", body)[0]
        elif mark == 0xC2:
            progressive = True
            precision, image.height, image.width, n = struct.unpack_from(">BHHB", body)
            if precision != 8 or not image.height or not image.width or n not in (1, 3):
                raise ValueError("only 8-bit grey or three-component images")
            image.components = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            if n == 1:
                image.components[0].h = image.components[0].v = 1
            hmax, vmax = max(c.h for c in image.components), max(c.v for c in image.components)
            for c in image.components:
                c.wide, c.high = -(-image.width * c.h // (hmax * 8)), -(-image.height * c.v // (vmax * 8))
                c.stride, c.rows = -(-image.width // (hmax * 8)) * c.h, -(-image.height // (vmax * 8)) * c.v
                c.coefs = np.zeros((c.stride * c.rows, 64), np.int32)
        elif 0xC0 <= mark <= 0xCF and mark not in (0xC8, 0xCC):
            raise ValueError(f"not a progressive Huffman image (marker {mark:02x})")
        elif mark == 0xDA:
            if not progressive:
                raise ValueError("a scan before the frame")
            n = body[0]
            named = {c.ident: c for c in image.components}
            chosen = [named[body[1 + 2 * i]] for i in range(n)]
            lo, hi, high, low = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
            found = _END_OF_SCAN.search(data, at)
            stop = found.start() if found else len(data)
            pieces = re.split(rb"\xff[\xd0-\xd7]", data[at:stop]) if every else [data[at:stop]]
            parts = [Bits(p.replace(b"\xff\x00", b"\xff")) for p in pieces]
            at = stop
            image.scans += 1
            orders = _order(image, chosen)
            step = every or len(orders[0])
            if lo == 0 and not high:
                _dc_first(parts, chosen, orders, [tables[body[2 + 2 * i] >> 4] for i in range(n)], low, step)
            elif lo == 0:
                _dc_refine(parts, chosen, orders, low, step)
            else:
                (_ac_refine if high else _ac_first)(parts, chosen[0], orders[0], tables[0x10 | body[2] & 15], (lo, hi), low, step)
    if not image.components:
        raise ValueError("no frame")
    return image


def to_rgb(image: Image) -> np.ndarray:
    """The full-resolution tensor (height, width, 3), 8 bits; chroma is upsampled by repeating samples."""
    hmax, vmax = max(c.h for c in image.components), max(c.v for c in image.components)
    planes = []
    for c in image.components:
        scaled = c.coefs * image.quants[c.quant]
        pixels = np.empty((len(scaled), 64), np.int32)
        for i in range(0, len(scaled), 1 << 15):
            part = np.floor((scaled[i : i + (1 << 15)].astype(np.float64) @ BASIS) * 0.5**SCALE + 0.5)
            pixels[i : i + (1 << 15)] = np.clip(part + 128, 0, 255)
        plane = pixels.reshape(c.rows, c.stride, 8, 8).transpose(0, 2, 1, 3).reshape(c.rows * 8, c.stride * 8)
        if c.v < vmax:
            plane = plane.repeat(vmax // c.v, axis=0)
        if c.h < hmax:
            plane = plane.repeat(hmax // c.h, axis=1)
        planes.append(plane[: image.height, : image.width])
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, axis=2).astype(np.uint8)
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    half, out = 1 << 15, np.empty((image.height, image.width, 3), np.uint8)  # JFIF's factors in units of 2**-16
    out[:, :, 0] = np.clip(y + ((91881 * cr + half) >> 16), 0, 255)
    out[:, :, 1] = np.clip(y + ((-22554 * cb - 46802 * cr + half) >> 16), 0, 255)
    out[:, :, 2] = np.clip(y + ((116130 * cb + half) >> 16), 0, 255)
    return out


def _segment(mark: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body


def _huffman(kind: int, by_length: dict[int, list[int]]) -> bytes:
    return _segment(0xC4, bytes([kind]) + bytes(len(by_length.get(n, ())) for n in range(1, 17)) + bytes(s for n in range(1, 17) for s in by_length.get(n, ())))


def _scan(idents: list[int], tables: int, lo: int, hi: int, high: int, low: int, data: bytes) -> bytes:
    return _segment(0xDA, bytes([len(idents), *(x for i in idents for x in (i, tables)), lo, hi, high << 4 | low])) + data.replace(b"\xff", b"\xff\x00")


def _packed(bits: np.ndarray) -> bytes:
    pad = -len(bits) % 8
    return np.packbits(np.concatenate([bits, np.ones(pad, np.uint8)]) if pad else bits).tobytes()


#: Bits of a DC word: the code of size s has DC_WIDTH - s bits, so code and extra bits together always have as many.
DC_WIDTH = 10
DC_TABLE = {DC_WIDTH - s: [s] for s in range(9)}
#: One symbol (no run, size 7) with the code 0: a word is a byte.
AC_TABLE = {1: [0x07]}
#: End-of-band runs of 1 to 32767 blocks, four bits each.
RUN_TABLE = {4: [r << 4 for r in range(15)]}
_DC_CODES = {s: c for _, c, s in read_table(bytes(len(DC_TABLE.get(n, ())) for n in range(1, 17)), bytes(s for n in range(1, 17) for s in DC_TABLE.get(n, ()))).symbols}
_DC_HEAD = np.array([_DC_CODES[s] << s for s in range(9)])
_TABLES = _segment(0xDB, b"\0" + bytes([1] * 64)) + _huffman(0x00, DC_TABLE) + _huffman(0x10, AC_TABLE) + _huffman(0x11, RUN_TABLE)


def encode_payload(payload: bytes) -> bytes:
    """A progressive 4:2:0 JPEG whose coefficients are the payload's bytes."""
    units = max(1, -(-len(payload) // 384))
    wide = int(np.ceil(np.sqrt(units)))
    high = -(-units // wide)
    if max(wide, high) * 16 > 65535:
        raise ValueError("the payload is larger than an image can be")
    blocks = np.frombuffer(payload.ljust(wide * high * 384, b" "), np.uint8).reshape(-1, 64)
    n = wide * high
    split = [blocks[: 4 * n], blocks[4 * n : 5 * n], blocks[5 * n :]]
    frame = struct.pack(">BHHB", 8, high * 16, wide * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    out = [b"\xff\xd8", _segment(0xEF, TAG + struct.pack(">Q", len(payload))), _segment(0xC2, frame), _TABLES]

    dc = [b[:, 0].astype(np.int64) for b in split]
    dc = [np.where(x < 128, x - 255, x) for x in dc]
    dc[0] = dc[0].reshape(high, 2, wide, 2).transpose(0, 2, 1, 3).ravel()
    diffs = np.column_stack([np.diff(x >> 1, prepend=0).reshape(n, -1) for x in dc]).ravel()
    size = np.frexp(np.abs(diffs))[1]
    words = _DC_HEAD[size] | np.where(diffs < 0, diffs + (1 << size) - 1, diffs)
    out.append(_scan([1, 2, 3], 0x00, 0, 0, 0, 1, _packed((words[:, None] >> np.arange(DC_WIDTH - 1, -1, -1) & 1).astype(np.uint8).ravel())))
    for lo, hi in ((1, 5), (6, 63)):
        for ident, b in enumerate(split, 1):
            out.append(_scan([ident], 0x00, lo, hi, 0, 1, (b[:, lo : hi + 1] >> 1).tobytes()))
    out.append(_scan([1, 2, 3], 0x00, 0, 0, 1, 0, _packed(np.column_stack([(x & 1).reshape(n, -1) for x in dc]).astype(np.uint8).ravel())))
    for ident, b in enumerate(split, 1):
        last = ((b[:, 1:] ^ (b[:, 1:] < 128)) & 1).astype(np.uint8)  # of the magnitude, which is 255 - b below 128
        bits = []
        for i in range(0, len(b), 32767):
            part = last[i : i + 32767]
            r = len(part).bit_length() - 1
            head = r << r | len(part) - (1 << r)  # the code of symbol r is r
            bits += [np.array([head >> k & 1 for k in range(3 + r, -1, -1)], np.uint8), part.ravel()]
        out.append(_scan([ident], 0x01, 1, 63, 1, 0, _packed(np.concatenate(bits))))
    out.append(b"\xff\xd9")
    return b"".join(out)


def payload_of(image: Image) -> bytes:
    if image.payload_bytes is None:
        raise ValueError("the image has no payload")
    c = np.concatenate([x.coefs for x in image.components])
    return np.where(c < 0, c + 255, c).astype(np.uint8).tobytes()[: image.payload_bytes]


def store_texts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The table doc_id, n_bytes, media, written and read back: each text filled up with spaces, as a progressive JPEG."""
    spark = docs.sparkSession
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text", 4 << 20):
            texts = byte_texts(b.column(1))
            media = [encode_payload(t.ljust(max(1, -(-len(t) // UNIT)) * UNIT)) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    path = path or scratch(spark, "media")
    schema = "doc_id long, n_bytes long, media binary"
    docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def decode_media(df: DataFrame, column: str = "media", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns keep, then status, height, width, channels, tensor (RGB bytes by row) for each medium."""
    ship(df.sparkSession)
    chosen = df.select(*keep, F.col(column).alias("__media"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "__media", 2 << 20):
            rows = []
            for m in b.column(len(keep)).to_pylist():
                try:
                    t = to_rgb(read_coefficients(m)) if m is not None else None
                    rows.append(("ok", *t.shape, t.tobytes()) if t is not None else ("null", None, None, None, None))
                except (ValueError, KeyError, IndexError, struct.error) as e:
                    rows.append((f"error: {e}", None, None, None, None))
            columns = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), *columns], [*keep, "status", "height", "width", "channels", "tensor"])

    from pyspark.sql.types import StructType

    schema = StructType([*(df.schema[k] for k in keep), *StructType.fromDDL("status string, height int, width int, channels int, tensor binary").fields])
    return chosen.mapInArrow(run, schema)


def store_tensors(df: DataFrame, column: str = "media", keep: tuple[str, ...] = (), path: str | None = None) -> DataFrame:
    """The table of decode_media's rows, written and read back: full-resolution RGB tensors, six bytes for four samples of 4:2:0."""
    tensors = decode_media(df, column, keep)
    path = path or scratch(df.sparkSession, "tensors")
    tensors.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(tensors.schema).parquet(path)


def features(stored: DataFrame) -> DataFrame:
    """Per stored text: what its payload and its image are, from the stored bytes."""
    ship(stored.sparkSession)
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "media", 4 << 20):
            rows = []
            for m in b.column(2).to_pylist():
                image = read_coefficients(m)
                payload, rgb = payload_of(image), to_rgb(image)
                means = ",".join(f"{x:.4f}" for x in (rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64) / (rgb.shape[0] * rgb.shape[1])).tolist())
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(m), hashlib.sha256(m).hexdigest(), f"{rgb.shape[0]}x{rgb.shape[1]}x3 {means} {zlib.crc32(rgb):08x}"))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True))], names)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_round_trip(docs: DataFrame) -> DataFrame:
    return features(store_texts(docs))
