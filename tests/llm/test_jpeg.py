"""The progressive reader on pictures of an encoder of its own, written bit by bit: long Huffman codes, runs of empty blocks, two refinements, chroma at half resolution, units beyond the picture's edge."""

import math
import struct

import numpy as np
import pytest

from tidemark.llm import media

WIDTH, HEIGHT = 40, 24  # 3 x 2 units of 16 x 16; luma has blocks that fill up the last unit
SYMBOLS = [0x00, 0xF0, 0x01, 0x11, *[s for s in range(256) if s not in (0x00, 0xF0, 0x01, 0x11) and (s & 15) <= 10]]
LENGTHS = {3: 1, 5: 3, 9: 40, 12: 100, 16: len(SYMBOLS) - 144}


def segment(marker, body):
    return bytes([255, marker]) + struct.pack(">H", len(body) + 2) + body


def code_table():
    codes, code, at = {}, 0, 0
    for length in range(1, 17):
        for _ in range(LENGTHS.get(length, 0)):
            codes[SYMBOLS[at]] = format(code, f"0{length}b")
            code, at = code + 1, at + 1
        code *= 2
    return codes


CODES = code_table()
TABLE = bytes(LENGTHS.get(n, 0) for n in range(1, 17)) + bytes(SYMBOLS)


def number(value):
    """A value's size and its bits, as the format writes them."""
    size = abs(value).bit_length()
    return size, format(value if value > 0 else value + (1 << size) - 1, f"0{size}b") if size else ""


def entropy(bits):
    bits += "1" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")


def dc_scan(planes, high, low):
    bits, last = "", [0, 0, 0]
    for uy in range(2):
        for ux in range(3):
            for c, (plane, step) in enumerate(zip(planes, (2, 1, 1))):
                for y in range(step):
                    for x in range(step):
                        value = int(plane[uy * step + y, ux * step + x, 0])
                        if high:
                            bits += str(value >> low & 1)
                        else:
                            size, extra = number((value >> low) - last[c])
                            bits, last[c] = bits + CODES[size] + extra, value >> low
    return entropy(bits)


def first_pass(blocks, lo, hi, low):
    bits, run = "", 0

    def ended():
        nonlocal run
        n = run.bit_length() - 1
        out = CODES[n << 4] + (format(run - (1 << n), f"0{n}b") if n else "") if run else ""
        run = 0
        return out

    for block in blocks:
        zeros = 0
        for value in block[lo : hi + 1]:
            value = int(math.copysign(abs(int(value)) >> low, value))
            if not value:
                zeros += 1
                continue
            bits += ended()
            while zeros > 15:
                bits, zeros = bits + CODES[0xF0], zeros - 16
            size, extra = number(value)
            bits, zeros = bits + CODES[zeros << 4 | size] + extra, 0
        run += zeros > 0
    return entropy(bits + ended())


def refinement(blocks, lo, hi, low):
    bits = ""
    for block in blocks:
        sizes = [abs(int(v)) >> low for v in block[: hi + 1]]
        new = max((k for k in range(lo, hi + 1) if sizes[k] == 1), default=0)
        zeros, waiting = 0, ""
        for k in range(lo, hi + 1):
            if not sizes[k]:
                zeros += 1
                continue
            while zeros > 15 and k <= new:
                bits, waiting, zeros = bits + CODES[0xF0] + waiting, "", zeros - 16
            if sizes[k] > 1:
                waiting += str(sizes[k] & 1)
                continue
            bits += CODES[zeros << 4 | 1] + ("1" if block[k] > 0 else "0") + waiting
            zeros, waiting = 0, ""
        if zeros or waiting:
            bits += CODES[0] + waiting
    return entropy(bits)


def scan(components, band, high, low, data):
    return segment(0xDA, bytes([len(components), *[x for c in components for x in (c + 1, 0)], *band, high << 4 | low])) + data


def encoded(planes, quantiser):
    out = [b"\xff\xd8", segment(0xE0, b"JFIF\0"), segment(0xDB, bytes([0, *quantiser])), segment(0xC4, b"\x00" + TABLE + b"\x10" + TABLE)]
    out.append(segment(0xC2, struct.pack(">BHHB", 8, HEIGHT, WIDTH, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    own = [planes[0][:3, :5].reshape(-1, 64), planes[1].reshape(-1, 64), planes[2].reshape(-1, 64)]
    out.append(scan([0, 1, 2], (0, 0), 0, 1, dc_scan(planes, 0, 1)))
    for c, bands in ((2, [(1, 63)]), (0, [(1, 5), (6, 63)]), (1, [(1, 63)])):
        for band in bands:
            out.append(scan([c], band, 0, 2, first_pass(own[c], *band, 2)))
    for high in (2, 1):
        for c in range(3):
            out.append(scan([c], (1, 63), high, high - 1, refinement(own[c], 1, 63, high - 1)))
    out.append(scan([0, 1, 2], (0, 0), 1, 0, dc_scan(planes, 1, 0)))
    return b"".join([*out, b"\xff\xd9"])


def drawn(seed, share):
    draw = np.random.default_rng(seed)
    planes = []
    for high, wide in ((4, 6), (2, 3), (2, 3)):
        blocks = np.where(draw.random((high, wide, 64)) < share, draw.integers(-60, 61, (high, wide, 64)), 0)
        blocks[..., 0] = draw.integers(-200, 200, (high, wide))
        blocks[draw.random((high, wide)) < 0.3, 1:] = 0  # empty blocks, for runs
        planes.append(blocks)
    planes[0][3:, :, 1:] = planes[0][:, 5:, 1:] = 0  # beyond the picture there are no AC coefficients
    return planes


@pytest.mark.parametrize("arrays", [True, False])
@pytest.mark.parametrize(("seed", "share"), [(1, 0.05), (2, 0.3), (3, 0.95), (4, 0.0)])
def test_independent_pictures(seed, share, arrays):
    planes, quantiser = drawn(seed, share), [3, *[1 + i % 4 for i in range(63)]]
    picture = media.read_coefficients(encoded(planes, quantiser), arrays=arrays)
    for c, plane in enumerate(planes):
        assert (picture.components[c + 1].blocks.reshape(plane.shape) == plane).all()
    rgb = media.read_rgb(picture)
    assert rgb.shape == (HEIGHT, WIDTH, 3)
    samples = []
    for plane, times in zip(planes, (1, 2, 2)):  # the transform by its definition
        flat = np.zeros(plane.shape)
        for i, (place, q) in enumerate(zip(media.ZIGZAG, quantiser)):
            flat[..., place] = plane[..., i] * q
        basis = np.array([[(math.sqrt(0.125) if u == 0 else 0.5) * math.cos((2 * x + 1) * u * math.pi / 16) for x in range(8)] for u in range(8)])
        pixels = np.einsum("abuv,uy,vx->aybx", flat.reshape(*plane.shape[:2], 8, 8), basis, basis).reshape(plane.shape[0] * 8, plane.shape[1] * 8)
        samples.append(pixels.repeat(times, 0).repeat(times, 1)[:HEIGHT, :WIDTH])
    y, cb, cr = samples[0] + 128, samples[1], samples[2]
    want = np.clip(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2), 0, 255)
    assert np.abs(rgb.astype(float) - want).max() <= 1.0
