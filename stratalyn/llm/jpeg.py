"""Progressive JPEG media columns: lossless payloads in coefficients, and a decoder to RGB tensors.

Reading accumulates every scan (spectral selection and successive approximation, DC and AC, first and refining) into
coefficient arrays, inverse-transforms them in numpy, upsamples chroma and gives a full-resolution RGB tensor.

Writing stores a payload of bytes, a multiple of 64, as the quantised coefficients of a colour image with half-size
chroma: byte b becomes coefficient 256 + b, block after block, first luma, then both chroma planes. Because every
coefficient has nine significant bits, the AC scans have a fixed bit layout, which the reader notices from the Huffman
table (one code only) or the run of block ends, and unpacks with numpy. DC scans and any other AC scan are read code by
code.

The inverse transform uses integers held in doubles, so results do not depend on batch or library.

Defined results: null and empty texts give 64 zero bytes; equal texts give equal media; a broken file raises in
``read`` and becomes a null tensor with an error text in ``decode``; repeated rows get equal results; an empty table
gives an empty table. Rows stream through mapInArrow one document at a time.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StringType, StructField, StructType

MCU_BLOCKS = 6  # four luma blocks, one of each chroma
MAX_MCUS = 4095  # in a row or column: 65,535 pixels at most


def _zigzag() -> np.ndarray:
    cells = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))
    return np.array([y * 8 + x for y, x in cells])


ZIGZAG = _zigzag()
_c = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for u in range(8)] for x in range(8)])
#: Inverse transform of a block in zigzag order, as integers: 64 coefficients to 64 samples, scaled by 2**15.
INVERSE = np.rint(np.kron(_c, _c)[:, ZIGZAG] * (1 << 15)).T.copy()


@dataclass
class Component:
    ident: int
    h: int
    v: int
    table: int
    blocks_y: int = 0  # with padding to whole MCUs
    blocks_x: int = 0
    own_y: int = 0  # without
    own_x: int = 0
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    single: np.ndarray | None = None  # block numbers in the order of scans of this component alone
    mixed: np.ndarray | None = None  # and of interleaved scans, a row for each MCU


@dataclass
class Image:
    width: int
    height: int
    components: list[Component]
    tables: dict[int, np.ndarray]
    comment: bytes = b""


# ---- writing ------------------------------------------------------------------------------------------------------


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, ident: int, symbols: list[int]) -> bytes:
    """A Huffman table in which all codes have one length and none is all ones."""
    bits = len(symbols).bit_length()
    counts = [0] * 16
    counts[bits - 1] = len(symbols)
    return _segment(0xC4, bytes([kind << 4 | ident, *counts, *symbols]))


def _pack(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Bits of each value, most significant first, one after another."""
    which = np.repeat(np.arange(len(values)), lengths)
    place = np.arange(len(which)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return ((values[which] >> (lengths[which] - 1 - place)) & 1).astype(np.uint8)


def _entropy(bits: np.ndarray) -> bytes:
    """Whole bytes, the last one filled with ones, a zero after each 0xFF."""
    if pad := -len(bits) % 8:
        bits = np.concatenate((bits, np.ones(pad, np.uint8)))
    return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")


def _scan(components: list[int], tables: int, first: int, last: int, high: int, low: int) -> bytes:
    return _segment(0xDA, bytes([len(components), *(x for c in components for x in (c, tables)), first, last, high << 4 | low]))


def store(payload: bytes) -> bytes:
    """A progressive JPEG that holds ``payload`` (a positive multiple of 64 bytes) in its coefficients."""
    blocks = len(payload) // 64
    mcus = -(-blocks // MCU_BLOCKS)
    down = -(-mcus // MAX_MCUS)
    across = -(-mcus // down)
    n = across * down
    v = np.full((MCU_BLOCKS * n, 64), 256, np.int16)
    v[:blocks] += np.frombuffer(payload, np.uint8).reshape(-1, 64)
    planes = [v[: 4 * n], v[4 * n : 5 * n], v[5 * n :]]
    # MCU order of blocks, for the scans that interleave the components
    luma = np.arange(4 * n).reshape(down, 2, across, 2).transpose(0, 2, 1, 3).reshape(n, 4)
    order = np.concatenate((luma, np.arange(n)[:, None] + 4 * n, np.arange(n)[:, None] + 5 * n), axis=1).ravel()
    out = [b"\xff\xd8", _segment(0xFE, f"payload={len(payload)}".encode()), _segment(0xDB, b"\0" + b"\1" * 64)]
    out.append(_segment(0xC2, struct.pack(">BHHB", 8, 16 * down, 16 * across, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    # DC, all but the last bit: differences along each component
    dc = [p[:, 0].astype(np.int32) for p in planes]
    half = np.empty(MCU_BLOCKS * n, np.int32)
    for c, seq in enumerate((luma.ravel(), np.arange(n), np.arange(n))):
        x = dc[c][seq] >> 1
        half[seq + (0, 4 * n, 5 * n)[c]] = np.diff(x, prepend=0)
    d = half[order]
    size = np.where(d == 0, 0, np.floor(np.log2(np.maximum(np.abs(d), 1))).astype(np.int32) + 1)
    out += [_table(0, 0, list(range(12))), _scan([1, 2, 3], 0, 0, 0, 0, 1)]
    out.append(_entropy(_pack(size << size | np.where(d < 0, d + (1 << size) - 1, d), size + 4)))
    # AC, all but the last bit: the one-bit code of (run 0, size 8), then eight bits
    out.append(_table(1, 0, [0x08]))
    for c, p in enumerate(planes):
        for first, last in ((1, 5), (6, 63)) if c == 0 else ((1, 63),):
            bits = np.zeros((len(p), last + 1 - first, 9), np.uint8)
            bits[:, :, 1:] = np.unpackbits((p[:, first : last + 1] >> 1).astype(np.uint8)[:, :, None], axis=2)
            out += [_scan([c + 1], 0, first, last, 0, 1), _entropy(bits.ravel())]
    # the last bit: runs of blocks without new coefficients, a correction bit for each known one
    out.append(_table(1, 0, [r << 4 for r in range(15)]))
    for c, p in enumerate(planes):
        out.append(_scan([c + 1], 0, 1, 63, 1, 0))
        bits = []
        for at in range(0, len(p), 32767):
            part = p[at : at + 32767, 1:]
            r = len(part).bit_length() - 1
            bits += [_pack(np.array([r << r | len(part) - (1 << r)]), np.array([4 + r])), (part & 1).astype(np.uint8).ravel()]
        out.append(_entropy(np.concatenate(bits)))
    out += [_scan([1, 2, 3], 0, 0, 0, 1, 0), _entropy((np.concatenate(dc)[order] & 1).astype(np.uint8)), b"\xff\xd9"]
    return b"".join(out)


# ---- reading ------------------------------------------------------------------------------------------------------


class _Codes:
    """A Huffman table: look-up by the next 16 bits."""

    def __init__(self, counts: tuple[int, ...], symbols: bytes):
        self.symbols, self.length, self.symbol = symbols, np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        code, k = 0, 0
        for bits, n in enumerate(counts, 1):
            for s in symbols[k : k + n]:
                at = slice(code << (16 - bits), (code + 1) << (16 - bits))
                self.length[at], self.symbol[at] = bits, s
                code += 1
            k += n
            code <<= 1
        self.only = (counts.index(1) + 1, symbols[0]) if sum(counts) == 1 else None


_codes = lru_cache(maxsize=64)(_Codes)


class _Bits:
    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8))
        self.at = self.asked = 0
        self._windows: np.ndarray | None = None

    def windows(self) -> np.ndarray:
        """The 16 bits that start at each place (ones past the end)."""
        if self._windows is None:
            b = np.concatenate((self.bits, np.ones(24, np.uint8)))
            w = np.zeros(len(b) - 15, np.uint32)
            for i in range(16):
                w = (w << np.uint32(1)) | b[i : len(b) - 15 + i]
            self._windows = w
        return self._windows

    def take(self, n: int) -> int:
        x = 0
        for b in self.bits[self.at : self.at + n].tolist():
            x = x << 1 | b
        self.at += n
        return x

    def many(self, n: int) -> np.ndarray:
        got = self.bits[self.at : self.at + n]
        if len(got) < n:
            raise ValueError("a scan ends early")
        self.at += n
        return got

    def code(self, codes: _Codes) -> int:
        self.asked += 1
        if self.asked < 8:  # a scan of few codes needs no table of windows
            got = self.bits[self.at : self.at + 16]
            w = int(np.packbits(np.concatenate((got, np.ones(16 - len(got), np.uint8)))).view(">u2")[0])
        else:
            w = int(self.windows()[min(self.at, len(self.windows()) - 1)])
        if not codes.length[w] or self.at >= len(self.bits):
            raise ValueError("no such code")
        self.at += int(codes.length[w])
        return int(codes.symbol[w])


def _signed(x, size):
    return np.where(x < (1 << np.maximum(size - 1, 0)), x - (1 << size) + 1, x) * (size > 0)


def _dc_first(bits: _Bits, parts: list[tuple[Component, np.ndarray, _Codes]], low: int) -> None:
    """The length of a code and its bits is looked up at every place at once; a walk along the lengths finds the codes."""
    w = bits.windows()
    tables: dict[int, tuple] = {}
    for _, _, codes in parts:
        if id(codes) not in tables:
            length, size = codes.length[w], codes.symbol[w]
            tables[id(codes)] = (np.where(length > 0, length + size, len(w)).tolist(), length, size)
    walk = [tables[id(codes)][0] for _, order, codes in parts for _ in range(order.shape[1])]
    places, p, end = [], bits.at, len(bits.bits)
    for _ in range(len(parts[0][1])):
        for steps in walk:
            if p >= end:
                raise ValueError("a scan ends early")
            places.append(p)
            p += steps[p]
    bits.at = p
    at = np.array(places, np.int64).reshape(len(parts[0][1]), len(walk))
    col = 0
    for comp, order, codes in parts:
        own = at[:, col : col + order.shape[1]].ravel()
        col += order.shape[1]
        _, length, size = tables[id(codes)]
        n = size[own]
        raw = w[np.minimum(own + length[own], len(w) - 1)].astype(np.int64) >> (16 - n)
        comp.coefficients[order.ravel(), 0] = np.cumsum(_signed(raw, n)) << low


def _ac_first(bits: _Bits, comp: Component, order: np.ndarray, codes: _Codes, first: int, last: int, low: int) -> None:
    band = last - first + 1
    if codes.only and codes.only[1] >> 4 == 0 and (size := codes.only[1] & 15):  # a fixed layout
        stride = codes.only[0] + size
        got = bits.many(len(order) * band * stride).reshape(-1, stride)
        if size == 8:
            x = np.packbits(got[:, codes.only[0] :], axis=1)[:, 0].astype(np.int32)
        else:
            x = got[:, codes.only[0] :].astype(np.int32) @ (1 << np.arange(size - 1, -1, -1))
        x[x >> (size - 1) == 0] -= (1 << size) - 1
        comp.coefficients[order, first : last + 1] = (x << low).reshape(-1, band)
        return
    run = 0
    for block in order.tolist():
        if run:
            run -= 1
            continue
        k = first
        while k <= last:
            s = bits.code(codes)
            r, size = s >> 4, s & 15
            if size:
                k += r
                x = bits.take(size)
                comp.coefficients[block, k] = (x if x >> (size - 1) else x - (1 << size) + 1) << low
                k += 1
            elif r == 15:
                k += 16
            else:
                run = (1 << r) + (bits.take(r) if r else 0) - 1
                break


def _ac_refine(bits: _Bits, comp: Component, order: np.ndarray, codes: _Codes, first: int, last: int, low: int) -> None:
    one, c, i = 1 << low, comp.coefficients, 0

    def correct(block: int, a: int, b: int) -> None:
        part = c[block, a:b]
        known = np.flatnonzero(part)
        if len(known):
            part[known] += np.sign(part[known]) * bits.many(len(known)).astype(np.int32) * one

    while i < len(order):
        block, k, run = int(order[i]), first, 0
        while k <= last:
            s = bits.code(codes)
            r, size = s >> 4, s & 15
            if not size and r < 15:
                run = (1 << r) + (bits.take(r) if r else 0)
                break
            new = (one if bits.take(1) else -one) if size else 0
            start = k
            while k <= last:  # past known coefficients and r zeros
                if not c[block, k]:
                    if not r:
                        break
                    r -= 1
                k += 1
            correct(block, start, min(k, last + 1))
            if new and k <= last:
                c[block, k] = new
            k += 1
        if not run:
            i += 1
            continue
        if k > first:
            correct(block, k, last + 1)
        rest = order[i + (k > first) : i + run]
        if len(rest):  # all blocks of the run at once
            part = c[rest, first : last + 1]
            known = part != 0
            if known.all():
                part += np.sign(part) * (bits.many(part.size).astype(np.int32) << low).reshape(part.shape)
            else:
                part[known] += np.sign(part[known]) * (bits.many(int(known.sum())).astype(np.int32) << low)
            c[rest, first : last + 1] = part
        i += run


def read(data: bytes) -> Image:
    """Accumulate all scans of a progressive JPEG."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, image, codes, quant, comment, restart = 2, None, {}, {}, b"", 0
    while at < len(data):
        if data[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker = data[at + 1]
        if marker == 0xD9:
            break
        size = struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 128 if wide else 64
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int32)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                counts = list(body[1:17])
                codes[body[0]] = _codes(tuple(counts), bytes(body[17 : 17 + sum(counts)]))
                body = body[17 + sum(counts) :]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xFE:
            comment = body
        elif marker == 0xC2:
            _, height, width, n = struct.unpack_from(">BHHB", body)
            parts = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            h, v = max(c.h for c in parts), max(c.v for c in parts)
            mx, my = -(-width // (8 * h)), -(-height // (8 * v))
            for c in parts:
                c.blocks_x, c.blocks_y = mx * c.h, my * c.v
                c.own_x, c.own_y = -(-(-(-width * c.h // h)) // 8), -(-(-(-height * c.v // v)) // 8)
                c.coefficients = np.zeros((c.blocks_x * c.blocks_y, 64), np.int32)
                grid = np.arange(c.blocks_x * c.blocks_y).reshape(c.blocks_y, c.blocks_x)
                c.single = grid[: c.own_y, : c.own_x].reshape(-1, 1)
                c.mixed = grid.reshape(my, c.v, mx, c.h).transpose(0, 2, 1, 3).reshape(-1, c.v * c.h)
            image = Image(width, height, parts, quant)
        elif marker in (0xC0, 0xC1, 0xC3) or 0xC5 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("not a progressive JPEG")
        elif marker == 0xDA:
            if image is None:
                raise ValueError("a scan comes before the frame")
            end = at
            while not (data[end : end + 1] == b"\xff" and end + 1 < len(data) and data[end + 1] != 0 and not 0xD0 <= data[end + 1] <= 0xD7):
                end = data.find(b"\xff", end + 1)
                if end < 0:
                    end = len(data)
                    break
            _one_scan(image, body, data[at:end], codes, restart)
            at = end
    if image is None:
        raise ValueError("no frame")
    image.comment = comment
    return image


def _one_scan(image: Image, body: bytes, data: bytes, codes: dict[int, _Codes], restart: int) -> None:
    n = body[0]
    chosen = [(next(c for c in image.components if c.ident == body[1 + 2 * i]), body[2 + 2 * i]) for i in range(n)]
    first, last, high, low = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
    orders = [c.single if n == 1 else c.mixed for c, _ in chosen]
    total = len(orders[0])
    step = restart or total
    pieces = [data]
    if restart:
        pieces, at = [], 0
        for i in range(len(data) - 1):
            if data[i] == 0xFF and 0xD0 <= data[i + 1] <= 0xD7:
                pieces.append(data[at:i])
                at = i + 2
        pieces.append(data[at:])
    for piece, begin in zip(pieces, range(0, total, step)):
        bits, parts = _Bits(piece), [(c, o[begin : begin + step], codes.get(t >> 4)) for (c, t), o in zip(chosen, orders)]
        if first == 0:
            if high == 0:
                _dc_first(bits, parts, low)
            else:
                wide = sum(o.shape[1] for _, o, _ in parts)
                got, col = (bits.many(len(parts[0][1]) * wide).astype(np.int32) << low).reshape(-1, wide), 0
                for c, o, _ in parts:
                    c.coefficients[o.ravel(), 0] |= got[:, col : col + o.shape[1]].ravel()
                    col += o.shape[1]
        else:
            c, t = chosen[0]
            table = codes[0x10 | t & 15]
            (_ac_refine if high else _ac_first)(bits, c, parts[0][1].ravel(), table, first, last, low)


def payload_of(image: Image) -> bytes:
    """The bytes that ``store`` put into the coefficients."""
    size = int(image.comment.removeprefix(b"payload="))
    return (np.concatenate([c.coefficients for c in image.components]) - 256).astype(np.uint8).tobytes()[:size]


def tensor(image: Image) -> np.ndarray:
    """Height x width x 3 bytes: inverse transform, chroma repeated to full size, YCbCr to RGB in integers."""
    h, v = max(c.h for c in image.components), max(c.v for c in image.components)
    planes = []
    for c in image.components:
        samples = np.empty((len(c.coefficients), 64), np.int32)
        for at in range(0, len(samples), 1 << 14):
            x = (c.coefficients[at : at + (1 << 14)] * image.tables[c.table]).astype(np.float64) @ INVERSE
            samples[at : at + (1 << 14)] = np.floor(x / (1 << 15) + 0.5)
        plane = np.clip(samples + 128, 0, 255).astype(np.int32).reshape(c.blocks_y, c.blocks_x, 8, 8).transpose(0, 2, 1, 3).reshape(c.blocks_y * 8, c.blocks_x * 8)
        if (h // c.h, v // c.v) != (1, 1):
            plane = plane.repeat(v // c.v, axis=0).repeat(h // c.h, axis=1)
        planes.append(plane[: image.height, : image.width])
    if len(planes) == 1:
        return np.stack(planes * 3, axis=-1).astype(np.uint8)
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    rgb = (y + ((91881 * cr + 32768) >> 16), y - ((22554 * cb + 46802 * cr + 32768) >> 16), y + ((116130 * cb + 32768) >> 16))
    return np.stack([np.clip(x, 0, 255).astype(np.uint8) for x in rgb], axis=-1)


def features(rgb: np.ndarray) -> str:
    """Size, then sum and sum of squares of each channel: exact integers."""
    flat = rgb.reshape(-1, 3)
    sums, squares = np.zeros(3, np.int64), np.zeros(3, np.int64)
    for at in range(0, len(flat), 1 << 18):
        part = flat[at : at + (1 << 18)].T.astype(np.int32)
        sums += part.sum(axis=1, dtype=np.int64)
        squares += (part * part).sum(axis=1, dtype=np.int64)
    return f"{rgb.shape[1]}x{rgb.shape[0]};" + ";".join(f"{a}:{b}" for a, b in zip(sums.tolist(), squares.tolist()))


def decode(media: DataFrame, column: str = "content") -> DataFrame:
    """``media`` with height, width, ``rgb`` (the tensor's bytes) and ``error`` (null if the file was read).

    Columns that already have these names are replaced.
    """
    media = media.drop("height", "width", "rgb", "error")
    packed = media.select(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in media.columns]).alias("row"), F.col(column).alias("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a row at a time: a tensor can be large
                h, w, rgb, error, raw = None, None, None, None, batch.column(1)[i]
                try:
                    t = tensor(read(raw.as_py() or b""))
                    h, w, rgb = t.shape[0], t.shape[1], t.tobytes()
                except (ValueError, IndexError, KeyError, StopIteration, struct.error) as e:
                    error = f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([h], pa.int32()), pa.array([w], pa.int32()), pa.array([rgb], pa.binary()), pa.array([error], pa.string())], ["row", "height", "width", "rgb", "error"])

    schema = StructType([StructField("row", packed.schema["row"].dataType), StructField("height", IntegerType()), StructField("width", IntegerType()), StructField("rgb", BinaryType()), StructField("error", StringType())])
    return packed.mapInArrow(run, schema).select("row.*", "height", "width", "rgb", "error")


def digest(docs: DataFrame) -> DataFrame:
    """The columns of op2: store each text, read the stored bytes back, digest what was read."""

    def one(raw: bytes) -> tuple:
        media = store(raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64)))
        image = read(media)
        back = payload_of(image)
        return len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), features(tensor(image))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(zip(*(one(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in batch.column(1)))) or [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
