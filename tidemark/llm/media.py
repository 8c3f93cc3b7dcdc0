"""Media columns: payloads in progressive JPEG, decoded to coefficients, payload and full-resolution RGB.

Storing: byte b becomes the quantised AC coefficient of size 128 + b mod 128, negative from 128 on (the format's unit), 63 to a block,
with luma at full and chroma at half resolution (4:2:0) and quantisation by one, so that nothing is lost. Scans: DC; luma AC in two
spectral bands and chroma AC in one, all without their last bit (successive approximation); then a refinement of each component's AC.
The Huffman table of each scan has the one symbol that the scan needs, so every code takes one bit and scans are packed as arrays.

Reading: all segments are parsed; each scan adds its part to the coefficient arrays. A scan whose table has a single symbol of fixed
width is read with numpy; any other goes through the bit reader with its full rules (bands, end-of-band runs, zero runs, refinement).
Coefficients are dequantised, inverse-transformed in numpy, chroma is doubled, and colours become 8-bit RGB, height x width x 3.

The tensors are columns of the result, which is their stored form; features come from the same arrays in the same pass. JPEGs go from task to task in a table.

Payload: the UTF-8 bytes of a text and blanks up to a positive multiple of 192. Null text: empty, so 192 blanks. Equal texts give equal
values; repeated rows are stored each; an empty table gives an empty result. Other columns are left out but for `keep`.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import sliced

UNIT = 192
PAD = b" "
PER_BLOCK = 63
TENSOR_BYTES = 16_000_000  # tensors that a task holds before it hands them on
BANDS = {0: ((1, 5), (6, 63)), 1: ((1, 63),), 2: ((1, 63),)}


def _zigzag() -> np.ndarray:
    """Place in the block (row * 8 + column) of each coefficient in scan order: diagonals, every other one upwards."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([r * 8 + c for r, c in cells])


ZIGZAG = _zigzag()
COSINES = np.array([[math.sqrt((1 if u == 0 else 2) / 8) * math.cos((2 * x + 1) * u * math.pi / 16) for x in range(8)] for u in range(8)], np.float32)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


def _scan(components: list[int], table: bytes, band: tuple[int, int], high: int, low: int, data: bytes) -> bytes:
    """A scan with its table of one symbol (code 0): class 0 for DC, 1 for AC."""
    huffman = bytes([0 if band[0] == 0 else 16, 1, *[0] * 15]) + table
    head = bytes([len(components), *[x for c in components for x in (c + 1, 0)], *band, high << 4 | low])
    return _segment(0xC4, huffman) + _segment(0xDA, head) + data.replace(b"\xff", b"\xff\x00")


def _packed(bits: int) -> bytes:
    """So many zero bits, filled up with ones."""
    whole, rest = divmod(bits, 8)
    return bytes(whole) + (bytes([255 >> rest]) if rest else b"")


def encode_payload(payload: bytes) -> bytes:
    """The payload as a progressive JPEG."""
    mcus = max(1, -(-len(payload) // (6 * PER_BLOCK)))
    wide = math.isqrt(mcus - 1) + 1
    high = -(-mcus // wide)
    count = wide * high
    values = np.zeros(count * 6 * PER_BLOCK, np.uint8)
    values[: len(payload)] = np.frombuffer(payload, np.uint8)
    blocks = values.reshape(-1, PER_BLOCK)
    parts = {0: blocks[: 4 * count], 1: blocks[4 * count : 5 * count], 2: blocks[5 * count :]}
    out = [b"\xff\xd8", _segment(0xFE, struct.pack(">Q", len(payload))), _segment(0xDB, bytes([0, *[1] * 64]))]
    out.append(_segment(0xC2, struct.pack(">BHHB", 8, high * 16, wide * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    out.append(_scan([0, 1, 2], b"\x00", (0, 0), 0, 0, _packed(6 * count)))
    for c, part in parts.items():
        size = (part & 127) >> 1 | 64  # all bits of the coefficient's size but the last
        code = np.where(part > 127, ~size & 127, size).astype(np.uint8)
        for lo, hi in BANDS[c]:
            out.append(_scan([c], b"\x07", (lo, hi), 0, 1, np.ascontiguousarray(code[:, lo - 1 : hi]).tobytes()))
    for c, part in parts.items():
        bits = np.zeros((len(part), 64), np.uint8)  # one bit ends the band's new coefficients, the rest refines the old ones
        bits[:, 1:] = part & 1
        out.append(_scan([c], b"\x00", (1, 63), 1, 0, np.packbits(bits, axis=1).tobytes()))
    return b"".join([*out, b"\xff\xd9"])


class Bits:
    """Bits of an entropy-coded segment without stuffing; ones past its end."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> int:
        value = 0
        for _ in range(n):
            byte = self.data[self.at >> 3] if self.at >> 3 < len(self.data) else 255
            value = value << 1 | byte >> (7 - (self.at & 7)) & 1
            self.at += 1
        return value

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            if (length, code) in codes:
                return codes[length, code]
        raise ValueError("no such Huffman code")

    def signed(self, size: int) -> int:
        value = self.take(size)
        return value if not size or value >> (size - 1) else value - (1 << size) + 1


def huffman_codes(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    """(length, code) -> symbol."""
    codes, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            codes[length, code] = symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return codes


@dataclass
class Component:
    across: int
    down: int
    table: int
    wide: int = 0  # blocks, with those that fill up the last units
    high: int = 0
    own_wide: int = 0  # blocks that the picture itself needs
    own_high: int = 0
    blocks: np.ndarray = field(default_factory=lambda: np.zeros(0))


@dataclass
class Picture:
    width: int
    height: int
    components: dict[int, Component]
    quantisers: dict[int, np.ndarray]
    comment: bytes


def _ac_band(bits: Bits, codes: dict, blocks: np.ndarray, rows: list[int], lo: int, hi: int, high: int, low: int) -> None:
    """A spectral band by the bit reader: its first pass, or its refinement."""
    run, one = 0, 1 << low
    for row in rows:
        block, k = blocks[row], lo
        while k <= hi and not run:
            value = bits.symbol(codes)
            zeros, size = value >> 4, value & 15
            if not size and zeros < 15:
                run = (1 << zeros) + bits.take(zeros)
                break
            if not high:
                k += zeros
                if size:
                    block[k] = bits.signed(size) << low if size else 0
                k += 1
                continue
            new = (one if bits.take(1) else -one) if size else 0
            while k <= hi:
                if block[k]:
                    if bits.take(1) and not abs(int(block[k])) & one:
                        block[k] += one if block[k] > 0 else -one
                elif zeros:
                    zeros -= 1
                else:
                    block[k] = new
                    k += 1
                    break
                k += 1
        if run:
            if high:
                for i in range(k, hi + 1):
                    if block[i] and bits.take(1) and not abs(int(block[i])) & one:
                        block[i] += one if block[i] > 0 else -one
            run -= 1


def _ac_arrays(data: bytes, symbol: int, blocks: np.ndarray, rows: list[int], lo: int, hi: int, high: int, low: int) -> bool:
    """The same with numpy, if the scan's one symbol has fixed width here; False if not."""
    n, width = len(rows), hi - lo + 1
    if not high and symbol == 7:  # no zeros, seven bits: a byte for each coefficient
        raw = np.frombuffer(data, np.uint8, n * width).reshape(n, width).astype(np.int16)
        blocks[rows, lo : hi + 1] = np.where(raw & 64, raw, raw - 127) << low
        return True
    if high and symbol == 0 and width == 63 and blocks[rows, lo : hi + 1].all():  # one bit for the end, one for each coefficient
        bits = np.unpackbits(np.frombuffer(data, np.uint8, n * 8).reshape(n, 8), axis=1)[:, 1:].astype(np.int16)
        old = blocks[rows, lo : hi + 1]
        blocks[rows, lo : hi + 1] = old + np.where(old > 0, bits, -bits) * (1 << low)
        return True
    return False


def read_coefficients(media: bytes, arrays: bool = True) -> Picture:
    """All scans of a progressive JPEG, accumulated into one array of coefficients (zigzag order) for each component."""
    at, tables, quantisers, comment, restart = 2, {}, {}, b"", 0
    picture = None
    while True:
        marker = media[at + 1]
        if marker == 0xD9:
            return picture
        (size,) = struct.unpack_from(">H", media, at + 2)
        body, at = media[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xFE:
            comment = body
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quantisers[body[0] & 15] = np.frombuffer(body, ">u2" if wide else ">u1", 64, 1).astype(np.float32)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = huffman_codes(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            (restart,) = struct.unpack(">H", body)
            if restart:
                raise ValueError("restart intervals are not read")
        elif marker == 0xC2:
            _, height, width, n = struct.unpack_from(">BHHB", body)
            parts = {body[6 + 3 * i]: Component(body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)}
            most_across, most_down = max(c.across for c in parts.values()), max(c.down for c in parts.values())
            units_wide, units_high = -(-width // (8 * most_across)), -(-height // (8 * most_down))
            for c in parts.values():
                c.wide, c.high = units_wide * c.across, units_high * c.down
                c.own_wide, c.own_high = -(-width * c.across // (8 * most_across)), -(-height * c.down // (8 * most_down))
                c.blocks = np.zeros((c.wide * c.high, 64), np.int16)
            picture = Picture(width, height, parts, quantisers, comment)
        elif marker == 0xDA:
            n, end = body[0], at
            while media[end : end + 1] != b"\xff" or media[end + 1] == 0:
                end = media.find(b"\xff", end + (media[end : end + 1] == b"\xff"))
            data, at = media[at:end].replace(b"\xff\x00", b"\xff"), end
            lo, hi, high, low = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
            chosen = [(picture.components[body[1 + 2 * i]], body[2 + 2 * i]) for i in range(n)]
            if lo == 0:
                _dc_scan(data, chosen, tables, high, low, arrays)
                continue
            part, table = chosen[0][0], tables[16 | chosen[0][1] & 15]
            rows = [r * part.wide + c for r in range(part.own_high) for c in range(part.own_wide)] if part.own_wide < part.wide else range(part.own_high * part.wide)
            rows = slice(0, len(rows)) if isinstance(rows, range) and arrays else list(rows)
            count = rows.stop if isinstance(rows, slice) else len(rows)
            if not (arrays and isinstance(rows, slice) and list(table) == [(1, 0)] and _ac_arrays(data, table[1, 0], part.blocks[:count], range(count), lo, hi, high, low)):
                _ac_band(Bits(data), table, part.blocks, list(range(count)) if isinstance(rows, slice) else rows, lo, hi, high, low)
        elif not (0xE0 <= marker <= 0xEF):
            raise ValueError(f"a segment that isn't progressive JPEG: {marker:x}")


def _dc_scan(data: bytes, chosen: list[tuple[Component, int]], tables: dict, high: int, low: int, arrays: bool) -> None:
    if arrays and not high and all(list(tables[t >> 4].items()) == [((1, 0), 0)] for _, t in chosen):
        return  # only differences of zero
    bits = Bits(data)
    last = [0] * len(chosen)
    alone = len(chosen) == 1
    first = chosen[0][0]
    units = [(r, c) for r in range(first.own_high if alone else first.high // first.down) for c in range(first.own_wide if alone else first.wide // first.across)]
    for r, c in units:
        for i, (part, table) in enumerate(chosen):
            cells = [(r, c)] if alone else [(r * part.down + y, c * part.across + x) for y in range(part.down) for x in range(part.across)]
            for y, x in cells:
                block = part.blocks[y * part.wide + x]
                if high:
                    block[0] |= bits.take(1) << low
                else:
                    last[i] += bits.signed(bits.symbol(tables[table >> 4]))
                    block[0] = last[i] << low


def read_payload(picture: Picture) -> bytes:
    """The payload that `encode_payload` stored."""
    values = np.concatenate([picture.components[c + 1].blocks[:, 1:].ravel() for c in range(3)])
    (length,) = struct.unpack(">Q", picture.comment)
    values = values[:length]
    return ((np.abs(values) & 127) | ((values < 0) << 7)).astype(np.uint8).tobytes()


def read_rgb(picture: Picture) -> np.ndarray:
    """Height x width x 3 of 8 bits; components of lower resolution are repeated up to the full one."""
    across, down = max(c.across for c in picture.components.values()), max(c.down for c in picture.components.values())
    planes = []
    for part in picture.components.values():
        scaled = np.zeros(part.blocks.shape, np.float32)
        scaled[:, ZIGZAG] = part.blocks * picture.quantisers[part.table]
        rows = scaled.reshape(-1, 8) @ COSINES
        samples = rows.reshape(-1, 8, 8).transpose(0, 2, 1).reshape(-1, 8) @ COSINES
        plane = samples.reshape(part.high, part.wide, 8, 8).transpose(0, 3, 1, 2).reshape(part.high * 8, part.wide * 8)
        plane = plane.repeat(down // part.down, 0).repeat(across // part.across, 1) if (down, across) != (part.down, part.across) else plane
        planes.append(plane[: picture.height, : picture.width])
    if len(planes) == 1:
        planes = [planes[0], np.zeros_like(planes[0]), np.zeros_like(planes[0])]
    y, cb, cr = planes
    y = y + np.float32(128)
    rgb = np.stack([y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb], axis=-1)
    return np.clip(np.rint(rgb), 0, 255).astype(np.uint8)


def text_payload(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data + PAD * (max(1, -(-len(data) // UNIT)) * UNIT - len(data))


def _schema(kept: DataFrame, n: int) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:n])


def store_media(documents: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns of keep, n_bytes and media (a progressive JPEG of the text)."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, len(keep)):
            sizes, media = [], []
            for value in batch.column(len(keep)):
                size, payload = text_payload(value.as_py())
                sizes.append(size)
                media.append(encode_payload(payload))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], [*keep, "n_bytes", "media"])

    kept = documents.select(*[f"`{c}`" for c in keep], text)
    return kept.mapInArrow(store, f"{_schema(kept, len(keep))}, n_bytes long, media binary")


def _feature(rgb: np.ndarray) -> str:
    sums = rgb.reshape(-1, 3).sum(0, dtype=np.int64)
    squares = np.einsum("ij,ij->j", *[rgb.reshape(-1, 3).astype(np.float64)] * 2)
    n = rgb.size // 3
    means = [s / n for s in sums.tolist()]
    spread = [math.sqrt(max(0.0, q / n - m * m)) for q, m in zip(squares.tolist(), means)]
    return f"{rgb.shape[0]}x{rgb.shape[1]}:" + ",".join(f"{m:.3f}/{d:.3f}" for m, d in zip(means, spread)) + f":{zlib.crc32(rgb):08x}"


def described(tensors: DataFrame) -> DataFrame:
    """The table without height, width and rgb, its feature made anew from them."""
    names = [c for c in tensors.columns if c not in ("height", "width", "rgb", "feature")]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes = zip(batch.column("rgb"), batch.column("height").to_pylist(), batch.column("width").to_pylist())
            found = [_feature(np.frombuffer(rgb.as_buffer(), np.uint8).reshape(height, width, 3)) for rgb, height, width in shapes]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(found, pa.string())], [*names, "feature"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tensors.schema.fields if f.name in names)
    return tensors.mapInArrow(describe, f"{schema}, feature string")


def read_media(stored: DataFrame, keep: tuple[str, ...] = ("doc_id", "n_bytes"), tensors: bool = True) -> DataFrame:
    """The columns of keep, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature and, if asked for, height, width and rgb (the tensor's bytes).

    feature: height x width, mean and deviation of each colour, CRC-32 of the tensor.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in types]
            lo, held = 0, 0
            for at, value in enumerate(batch.column(len(keep))):
                media = value.as_py()
                picture = read_coefficients(media)
                payload, rgb = read_payload(picture), read_rgb(picture)
                feature = _feature(rgb)
                row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature, *((*rgb.shape[:2], rgb.tobytes()) if tensors else ()))
                for column, x in zip(columns, row):
                    column.append(x)
                held += rgb.size * tensors
                if held >= TENSOR_BYTES or at == batch.num_rows - 1:  # a batch may hold more tensors than a task
                    yield pa.RecordBatch.from_arrays([*[c.slice(lo, at + 1 - lo) for c in batch.columns[: len(keep)]], *[pa.array(c, t) for c, t in zip(columns, types)]], [*keep, *names])
                    columns, lo, held = [[] for _ in types], at + 1, 0

    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"] + ["height", "width", "rgb"] * tensors
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.int32(), pa.int32(), pa.binary()] * tensors
    kept = stored.select(*[f"`{c}`" for c in keep], "media")
    schema = f"{_schema(kept, len(keep))}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return kept.mapInArrow(read, schema + ", height int, width int, rgb binary" * tensors)
