"""Baseline files made bit by bit here: AC coefficients, several components, subsampling, restarts, wide quantisers."""

import random
import struct

import numpy as np
import pytest

from pagegrain.llm import jpeg_media

DC_SYMBOLS = list(range(12))  # codes of four bits
AC_SYMBOLS = [0x00, 0xF0, 0x01, 0x02, 0x05, 0x11, 0x13, 0x21, 0x37, 0x61, 0xA2]  # codes of five bits


def segment(kind, body):
    return bytes((0xFF, kind)) + struct.pack(">H", len(body) + 2) + body


def huffman(number, symbols, bits):
    return segment(0xC4, bytes((number,)) + bytes(len(symbols) if n == bits else 0 for n in range(1, 17)) + bytes(symbols))


def amount(value):
    """(size, bits) of a coefficient."""
    size = abs(value).bit_length()
    return size, format(value if value >= 0 else value + (1 << size) - 1, f"0{size}b") if size else ""


def make(rng, width, height, sampling, step=16, interval=0, wide=False):
    """A file, and the DC values of its first component's blocks as they lie on the page."""
    tall, broad = max(v for _, v in sampling), max(h for h, _ in sampling)
    if len(sampling) == 1:
        sampling, tall, broad = [(1, 1)], 1, 1
    down, across = -(-height // (8 * tall)), -(-width // (8 * broad))
    h, v = sampling[0]
    values = np.zeros((down * v, across * h), int)
    scan, bits, before, restarts = b"", "", [0] * len(sampling), 0

    def flush(bits):
        bits += "1" * (-len(bits) % 8)
        return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")

    for unit in range(down * across):
        if interval and unit and unit % interval == 0:
            scan += flush(bits) + bytes((0xFF, 0xD0 + restarts % 8))
            bits, before, restarts = "", [0] * len(sampling), restarts + 1
        for c, (ch, cv) in enumerate(sampling):
            for k in range(ch * cv):
                value = rng.randrange(-60, 60)
                if c == 0:
                    values[unit // across * v + k // h, unit % across * h + k % h] = value
                size, extra = amount(value - before[c])
                before[c] = value
                bits += format(DC_SYMBOLS.index(size), "04b") + extra
                place = 0
                while place < 63:
                    code = rng.choice(AC_SYMBOLS)
                    if place + (code >> 4) + 1 > 63:
                        code = 0
                    bits += format(AC_SYMBOLS.index(code), "05b") + "".join(rng.choice("01") for _ in range(code & 15))
                    if not code:
                        break
                    place += (code >> 4) + 1
    scan += flush(bits)
    quantiser = bytes((16,)) + struct.pack(">64H", *[step] * 64) if wide else bytes((0,)) + bytes([step] * 64)
    n = len(sampling)
    frame = struct.pack(">BHHB", 8, height, width, n) + b"".join(bytes((c + 1, a << 4 | b, 0)) for c, (a, b) in enumerate(sampling))
    head = segment(0xE0, b"JFIF\0") + segment(0xDB, quantiser) + segment(0xC0, frame) + huffman(0, DC_SYMBOLS, 4) + huffman(16, AC_SYMBOLS, 5)
    head += segment(0xDD, struct.pack(">H", interval)) if interval else b""
    head += segment(0xDA, bytes((n,)) + b"".join(bytes((c + 1, 0)) for c in range(n)) + bytes((0, 63, 0)))
    pixels = np.clip(np.floor(values * step / 8 + 128.5), 0, 255).astype(np.uint8)
    return b"\xff\xd8" + head + scan + b"\xff\xd9", pixels[: -(-height // 8), : -(-width // 8)]


@pytest.mark.parametrize("sampling", [[(1, 1)], [(1, 1)] * 3, [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)], [(1, 2), (1, 1)]])
def test_thumbnails_of_any_baseline_file(sampling):
    rng = random.Random(str(sampling))
    made = [
        make(rng, *size, sampling, step, interval, wide)
        for size, step, interval, wide in (((40, 24), 16, 0, False), ((33, 17), 3, 2, False), ((8, 8), 16, 0, True), ((100, 50), 300, 5, True), ((40, 24), 16, 0, False))
    ]
    for (_, want), frames in zip(made, jpeg_media.thumbnails([file for file, _ in made])):
        ((width, height, thumb),) = frames
        assert thumb.tolist() == want.tolist() and (-(-height // 8), -(-width // 8)) == want.shape


def test_features_of_a_column(spark):
    rng = random.Random(1)
    file, thumb = make(rng, 64, 64, [(2, 2), (1, 1), (1, 1)])
    rows = [(1, file), (2, file[:-9]), (3, file.replace(b"\xff\xc0", b"\xff\xc2", 1)), (4, None), (5, b"")]
    told = {r.id: r for r in jpeg_media.media_features(spark.createDataFrame(rows, "id long, media binary")).collect()}
    assert (told[1].width, told[1].height, told[1].feature) == (64, 64, "64x64:" + jpeg_media.thumbnail_hash(thumb))
    assert told[3].error == "not baseline" and all(told[i].error and told[i].feature is None for i in (2, 4, 5))
