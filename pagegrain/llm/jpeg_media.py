"""Baseline JPEG in numpy: DC-only luminance thumbnails of any baseline file, and lossless payloads.

A payload byte is stored as one flat 8 x 8 block, so the thumbnail made of DC
values (an eighth of the width and height) gives the payload back exactly.
Scans are decoded in step over all restart intervals of a batch.
"""

from __future__ import annotations

import struct
import zlib
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._text import id_text, slices

#: Payload bytes in a row of blocks; one restart interval.
WIDTH = 64
#: Rows of blocks in a frame: JPEG heights go to 65535.
ROWS = 8191
# The luminance DC code lengths and symbols that the standard suggests (table K.3).
DC_COUNTS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
DC_SYMBOLS = tuple(range(12))
#: The stored form has no AC values: its AC table knows the end of a block alone.
AC_COUNTS, AC_SYMBOLS = (1, *[0] * 15), (0,)
#: Quantiser of DC values: 8 makes the stored value the sample less 128.
DC_STEP = 8


def code_table(counts, symbols) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Canonical codes: code and length by symbol, and for each 16 bits that follow, length << 8 | symbol (0: none)."""
    codes, lengths = np.zeros(256, np.int64), np.zeros(256, np.int64)
    peek = np.zeros(1 << 16, np.int32)
    code = at = 0
    for length, count in enumerate(counts, 1):
        for symbol in symbols[at : at + count]:
            codes[symbol], lengths[symbol] = code, length
            peek[code << 16 - length : code + 1 << 16 - length] = length << 8 | symbol
            code += 1
        at += count
        code <<= 1
    return codes, lengths, peek


_size = np.array([int(i).bit_length() for i in range(256)], np.int64)
_dc = code_table(DC_COUNTS, DC_SYMBOLS)


def _segment(kind: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, kind, len(body) + 2) + body


_HEAD = b"\xff\xd8" + _segment(0xDB, bytes([0, DC_STEP] + [1] * 63))
_TABLES = (
    _segment(0xC4, bytes([0x00, *DC_COUNTS, *DC_SYMBOLS]))
    + _segment(0xC4, bytes([0x10, *AC_COUNTS, *AC_SYMBOLS]))
    + _segment(0xDD, struct.pack(">H", WIDTH))
    + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
)


def _scans(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stuffed entropy-coded bytes of each row of WIDTH samples, concatenated, and their offsets."""
    value = samples.reshape(-1, WIDTH).astype(np.int64) - 128
    diff = np.diff(value, axis=1, prepend=0)
    size = _size[np.abs(diff)]
    bits = np.where(diff < 0, diff + (1 << size) - 1, diff)
    code = _dc[0][size] << size + 1 | bits << 1  # the end-of-block code is one 0 bit
    length = _dc[1][size] + size + 1
    ends = np.cumsum(length, axis=1)
    row_bytes = (ends[:, -1] + 7) >> 3
    starts = np.concatenate([[0], np.cumsum(row_bytes)])
    place = (starts[:-1, None] * 8 + ends - length).ravel()
    word = code.ravel() << 24 - (place & 7) - length.ravel()
    total = int(starts[-1])
    out = np.zeros(total + 3)
    for k in range(3):
        out += np.bincount((place >> 3) + k, word >> 16 - 8 * k & 255, total + 3)
    raw = out[:total].astype(np.uint8)
    raw[starts[1:] - 1] |= ((1 << row_bytes * 8 - ends[:, -1]) - 1).astype(np.uint8)
    full = raw == 255
    shift = np.concatenate([[0], np.cumsum(full)])
    stuffed = np.zeros(total + int(shift[-1]), np.uint8)
    stuffed[np.arange(total) + shift[:-1]] = raw
    return stuffed, starts + shift[starts]


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """Each payload (a positive multiple of WIDTH bytes) as one or more JPEG frames, one after the other."""
    stuffed, offsets = _scans(np.frombuffer(b"".join(payloads), np.uint8))
    raw, out, row = stuffed.tobytes(), [], 0
    for payload in payloads:
        rows, frames = len(payload) // WIDTH, []
        for first in range(0, rows, ROWS):
            n = min(ROWS, rows - first)
            frame = [_HEAD, _segment(0xC0, struct.pack(">BHHB3B", 8, n * 8, WIDTH * 8, 1, 1, 0x11, 0)), _TABLES]
            bounds = offsets[row + first : row + first + n + 1].tolist()
            for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
                if i:
                    frame.append(bytes((0xFF, 0xD0 + (i - 1 & 7))))
                frame.append(raw[a:b])
            frame.append(b"\xff\xd9")
            frames.append(b"".join(frame))
        row += rows
        out.append(b"".join(frames))
    return out


class Frame:
    """Headers of one baseline frame, and where its scan lies."""

    def __init__(self):
        self.width = self.height = self.interval = 0
        self.components: list[tuple[int, int, int, int]] = []
        self.quant: dict[int, int] = {}
        self.tables: dict[int, bytes] = {}
        self.scan: list[tuple[int, int, int]] = []
        self.start = self.stop = 0


def parse(data: bytes) -> list[Frame]:
    """Frames of a file by its markers; raises ValueError where it is not baseline JPEG."""
    frames, at = [], 0
    while at < len(data):
        if data[at : at + 2] != b"\xff\xd8":
            raise ValueError("no start of image")
        frame, at = Frame(), at + 2
        while True:
            if data[at : at + 1] != b"\xff" or at + 4 > len(data):
                raise ValueError("no marker where one must be")
            kind = data[at + 1]
            if kind == 0xFF:
                at += 1
                continue
            (n,) = struct.unpack_from(">H", data, at + 2)
            body = data[at + 4 : at + 2 + n]
            at += 2 + n
            if kind == 0xDB:
                i = 0
                while i < len(body):
                    wide = body[i] >> 4
                    frame.quant[body[i] & 15] = struct.unpack_from(">H", body, i + 1)[0] if wide else body[i + 1]
                    i += 129 if wide else 65
            elif kind == 0xC4:
                i = 0
                while i < len(body):
                    m = sum(body[i + 1 : i + 17])
                    frame.tables[body[i]] = body[i + 1 : i + 17 + m]
                    i += 17 + m
            elif kind in (0xC0, 0xC1):
                depth, frame.height, frame.width, m = struct.unpack_from(">BHHB", body)
                if depth != 8:
                    raise ValueError("not 8 bits a sample")
                frame.components = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(m)]
            elif 0xC2 <= kind <= 0xCF and kind not in (0xC8, 0xCC):
                raise ValueError("not baseline")
            elif kind == 0xDD:
                (frame.interval,) = struct.unpack(">H", body)
            elif kind == 0xDA:
                frame.scan = [(body[1 + 2 * k], body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])]
                break
        frame.start, end = at, at
        while True:
            end = data.find(b"\xff", end)
            if end < 0 or end + 1 >= len(data):
                raise ValueError("no end of image")
            following = data[end + 1]
            if following == 0xD9:
                break
            if following and not 0xD0 <= following <= 0xD7:
                raise ValueError("more than one scan")
            end += 2
        frame.stop, at = end, end + 2
        frames.append(frame)
    return frames


def _intervals(scan: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scan bytes without stuffing and restart markers, and the start of each interval in them."""
    after = np.concatenate([scan[1:], [0]])
    mark = (scan == 255) & (after >= 0xD0) & (after <= 0xD7)
    stuffing = np.concatenate([[False], (scan == 255)[:-1]]) & (scan == 0)
    drop = mark | stuffing
    drop[1:] |= mark[:-1]
    kept = np.cumsum(~drop)
    return scan[~drop], np.concatenate([[0], kept[np.flatnonzero(mark)]])


def decode_dc(items: list[tuple[Frame, np.ndarray]]) -> list[np.ndarray]:
    """DC-only luminance thumbnails (uint8, one pixel a block) of frames whose tables are the same."""
    head = items[0][0]
    dc = {t: code_table(x[:16], x[16:])[2] for t, x in head.tables.items() if t < 16}
    ac = {t & 15: code_table(x[:16], x[16:])[2] for t, x in head.tables.items() if t >= 16}
    sampling = {c: (h, v) for c, h, v, _ in head.components}
    plan = []  # blocks of one unit: (component, table, table)
    for c, d, a in head.scan:
        h, v = sampling[c] if len(head.components) > 1 else (1, 1)
        plan += [(c, dc[d], ac[a])] * (h * v)
    luma = head.components[0][0]
    parts, starts, units, shapes, total = [], [], [], [], 0
    for frame, scan in items:
        raw, begin = _intervals(scan)
        h, v = (sampling[luma] if len(head.components) > 1 else (1, 1))
        tall = max(x[1] for x in sampling.values()) if len(head.components) > 1 else 1
        wide = max(x[0] for x in sampling.values()) if len(head.components) > 1 else 1
        across, down = -(-frame.width // (8 * wide)), -(-frame.height // (8 * tall))
        n, step = across * down, frame.interval or across * down
        counts = np.minimum(step, n - np.arange(0, n, step))
        if len(counts) != len(begin):
            raise ValueError("restart intervals are missing")
        parts.append(raw)
        starts.append(begin + total)
        units.append(counts)
        shapes.append((down, across, v, h))
        total += len(raw)
    data = np.concatenate([*parts, np.zeros(8, np.uint8)]).astype(np.uint64)
    window = data[:-4] << np.uint64(32)
    for k, shift in enumerate((24, 16, 8, 0), 1):
        window |= data[k : len(data) - 4 + k] << np.uint64(shift)
    position = np.concatenate(starts) * 8
    counts = np.concatenate(units)
    most = int(counts.max())
    luma_blocks = sum(c == luma for c, _, _ in plan)
    out = np.zeros((len(counts), most, luma_blocks), np.int32)
    previous = {c: np.zeros(len(counts), np.int64) for c, _, _ in plan}

    def peek(at: np.ndarray, bits: int) -> np.ndarray:
        """The next ``bits`` (32 at most) bits at bit places."""
        byte = np.minimum(at >> 3, len(window) - 1)
        return (window[byte] >> (40 - bits - (at & 7)).astype(np.uint64)).astype(np.int64) & (1 << bits) - 1

    live = np.arange(len(counts))
    for unit in range(most):
        if unit:
            live = live[counts[live] > unit] if counts.min() < most else live
        k = 0
        for c, dc_peek, ac_peek in plan:
            at = position[live]
            bits = peek(at, 32)
            found = dc_peek[bits >> 16]
            length, size = found >> 8, (found & 255).astype(np.int64)
            if not length.all():
                raise ValueError("no such DC code")
            extra = bits >> 32 - length - size & (1 << size) - 1
            diff = np.where(extra < (1 << size) >> 1, extra - (1 << size) + 1, extra)
            value = previous[c][live] + diff
            previous[c][live] = value
            if c == luma:
                out[live, unit, k] = value
                k += 1
            at = at + length + size
            coefficient, busy = np.zeros(len(live), np.int64), np.arange(len(live))
            while True:
                found = ac_peek[peek(at[busy], 16)]
                length, symbol = found >> 8, found & 255
                if not length.all():
                    raise ValueError("no such AC code")
                at[busy] += length + (symbol & 15)
                going = (symbol & 15 > 0) | (symbol == 0xF0)
                busy = busy[going]
                if not len(busy):
                    break
                coefficient[busy] += (symbol[going] >> 4) + 1
                busy = busy[coefficient[busy] < 63]
                if not len(busy):
                    break
            position[live] = at
    step = head.quant[head.components[0][3]]
    pixels = np.clip(np.floor(out * step / 8 + 128.5), 0, 255).astype(np.uint8)
    result, row = [], 0
    for (down, across, v, h), counts_here in zip(shapes, units):
        flat = pixels[row : row + len(counts_here)].reshape(-1, luma_blocks)
        if counts_here[-1] < most or len(set(counts_here.tolist())) > 1:
            flat = np.concatenate([pixels[row + i, :n] for i, n in enumerate(counts_here.tolist())])
        row += len(counts_here)
        result.append(flat.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h))
    return result


def thumbnails(files: list[bytes]) -> list[list[tuple[int, int, np.ndarray]]]:
    """(width, height, thumbnail) of every frame of every file; frames with equal tables are decoded together."""
    parsed = [parse(f) for f in files]
    groups: dict[tuple, list[tuple[int, int]]] = {}
    for i, frames in enumerate(parsed):
        for k, f in enumerate(frames):
            key = (*sorted(f.tables.items()), *f.components, *f.scan, *sorted(f.quant.items()))
            groups.setdefault(key, []).append((i, k))
    out: list[list] = [[None] * len(frames) for frames in parsed]
    for where in groups.values():
        items = []
        for i, k in where:
            f = parsed[i][k]
            items.append((f, np.frombuffer(files[i], np.uint8, f.stop - f.start, f.start)))
        for (i, k), thumb in zip(where, decode_dc(items)):
            f = parsed[i][k]
            used = thumb[: -(-f.height // 8), : -(-f.width // 8)]
            out[i][k] = (f.width, f.height, used)
    return out


def thumbnail_hash(thumb: np.ndarray) -> str:
    """64 bits, hexadecimal: which cells of an 8 x 8 grid of means exceed the grid's mean."""
    rows, cols = thumb.shape
    down = thumb.sum(1, dtype=np.int64) if cols < 8 else None
    grid = np.empty((8, 8))
    ys = [(rows * i // 8, max(rows * (i + 1) // 8, rows * i // 8 + 1)) for i in range(8)]
    if down is None and cols % 8 == 0:
        bands = thumb.reshape(rows, 8, cols // 8).mean(2)
        sums = np.concatenate([np.zeros((1, 8)), np.cumsum(bands, axis=0)])
        for i, (a, b) in enumerate(ys):
            grid[i] = (sums[b] - sums[a]) / (b - a)
    else:
        xs = [(cols * i // 8, max(cols * (i + 1) // 8, cols * i // 8 + 1)) for i in range(8)]
        for i, (a, b) in enumerate(ys):
            for j, (c, d) in enumerate(xs):
                grid[i, j] = thumb[a:b, c:d].mean()
    grid = np.round(grid, 6)
    return np.packbits(grid > grid.mean()).tobytes().hex()


def media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each text: doc_id, n_bytes and media, a JPEG file that holds the text losslessly.

    The payload is the text's UTF-8 with zero bytes up to a positive multiple
    of 64.  Null text is empty; ids may be null or repeat; an empty table gives
    no rows; other columns are ignored.
    """

    def run(batches):
        for batch in slices(batches, limit=1 << 20):
            raws = [t.encode() for t in batch.column(1).to_pylist()]
            files = encode_payloads([r + bytes(-len(r) % WIDTH or (0 if r else WIDTH)) for r in raws])
            cols = [batch.column(0), pa.array(list(map(len, raws)), pa.int64()), pa.array(files, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "media"])

    return id_text(df, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def media_payloads(stored: DataFrame) -> DataFrame:
    """What the stored files of ``media`` hold: doc_id, n_bytes, width, height, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature (size and thumbnail hash).  All but doc_id and n_bytes is read from the file."""
    schema = (
        "doc_id long, n_bytes long, width int, height int, payload_bytes long, payload_sha256 string, "
        "tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for batch in slices(batches, "media", limit=1 << 20):
            files, rows = batch.column(2).to_pylist(), []
            for file, frames in zip(files, thumbnails(files)):
                thumb = frames[0][2] if len(frames) == 1 else np.concatenate([f[2] for f in frames])
                back = thumb.tobytes()
                width, height = frames[0][0], sum(f[1] for f in frames)
                rows.append(
                    (width, height, len(back), sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(file),
                     sha256(file).hexdigest(), f"{width}x{height}:{thumbnail_hash(thumb)}")
                )
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            cols = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], names=names)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def media_features(df: DataFrame, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """id, width, height, feature and error of any baseline JPEG column; errors are rows, not failures."""

    def run(batches):
        for batch in slices(batches, "media"):
            rows = []
            for key, file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    frames = thumbnails([file or b""])[0]
                    if not frames:
                        raise ValueError("no image")
                    width, height, thumb = frames[0]
                    rows.append((key, width, height, f"{width}x{height}:{thumbnail_hash(thumb)}", None))
                except (ValueError, KeyError, IndexError, struct.error) as error:
                    rows.append((key, None, None, None, str(error) or type(error).__name__))
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            names = ["id", "width", "height", "feature", "error"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    rows = df.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS id", f"coalesce(`{media_col}`, X'') AS media")
    return rows.mapInArrow(run, "id long, width int, height int, feature string, error string")
