"""Pixels of PNG and BMP images from their bytes, for images that are a column of a table."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
#: First column and row, and steps, of the passes of an interlaced image.
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Kind and content of a PNG's chunks, up to its end."""
    at = 8
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if len(body) < size or data[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + body)):
            raise ValueError("a damaged chunk")
        yield kind, body
        if kind == b"IEND":
            return
        at += 12 + size
    raise ValueError("no end")


def unfiltered(data: np.ndarray, height: int, width: int, step: int) -> np.ndarray:
    """Bytes of (height, width), each row with its filter before it; step: bytes of a pixel."""
    rows, before = np.empty((height, width), np.uint8), np.zeros(width, np.uint8)
    for y, row in enumerate(data.reshape(height, width + 1)):
        kind, own = row[0], row[1:].copy()
        if kind == 1:
            for c in range(step):
                own[c::step] = np.add.accumulate(own[c::step], dtype=np.uint8)
        elif kind == 2:
            own += before
        elif kind in (3, 4):
            got, up = own.tolist(), before.tolist()
            for x in range(width):
                left, above, corner = (got[x - step], up[x], up[x - step]) if x >= step else (0, up[x], 0)
                if kind == 3:
                    add = (left + above) // 2
                else:  # whichever of the three is nearest to left + above - corner, in this order
                    near = left + above - corner
                    add = min((abs(near - v), k, v) for k, v in enumerate((left, above, corner)))[2]
                got[x] = (got[x] + add) & 255
            own = np.array(got, np.uint8)
        elif kind:
            raise ValueError(f"no filter {kind}")
        rows[y] = before = own
    return rows


def samples(rows: np.ndarray, width: int, channels: int, depth: int) -> np.ndarray:
    """(height, width, channels) as bytes; of 16 bits the upper ones, smaller ones as they are."""
    if depth == 16:
        return rows[:, ::2].reshape(len(rows), width, channels)
    if depth == 8:
        return rows.reshape(len(rows), width, channels)
    bits = np.unpackbits(rows, axis=1)[:, : width * depth].reshape(len(rows), width, depth)
    return (bits @ (1 << np.arange(depth)[::-1]).astype(np.uint8))[..., None]


def png(data: bytes) -> tuple[int, int, np.ndarray]:
    parts: dict[bytes, list[bytes]] = {}
    for kind, body in chunks(data):
        parts.setdefault(kind, []).append(body)
    width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", parts[b"IHDR"][0])
    if colour not in CHANNELS or depth not in DEPTHS[colour] or not width or not height or interlaced > 1:
        raise ValueError("no such kind of PNG")
    channels = CHANNELS[colour]
    line = lambda w: -(-w * channels * depth // 8)
    areas = [(x, y, dx, dy, -(-(width - x) // dx), -(-(height - y) // dy)) for x, y, dx, dy in (PASSES if interlaced else ((0, 0, 1, 1),))]
    areas = [a for a in areas if a[4] > 0 and a[5] > 0]
    size = sum(h * (line(w) + 1) for *_, w, h in areas)
    flat = np.frombuffer(zlib.decompressobj().decompress(b"".join(parts.get(b"IDAT", [])), size), np.uint8)  # not more than the header says
    if len(flat) < size:
        raise ValueError("too few pixels")
    out, at = np.empty((height, width, channels), np.uint8), 0
    for x, y, dx, dy, w, h in areas:
        n = h * (line(w) + 1)
        out[y::dy, x::dx] = samples(unfiltered(flat[at : at + n], h, line(w), max(1, channels * depth // 8)), w, channels, depth)
        at += n
    if colour == 3:
        palette = np.frombuffer(parts[b"PLTE"][0], np.uint8).reshape(-1, 3)
        if out.max() >= len(palette):
            raise ValueError("a colour out of the palette")
        return width, height, palette[out[..., 0]]
    if channels < 3:
        grey = out[..., :1] if depth >= 8 else (out[..., :1] * (255 // ((1 << depth) - 1))).astype(np.uint8)
        return width, height, np.repeat(grey, 3, axis=2)
    return width, height, out[..., :3]


def bmp(data: bytes) -> tuple[int, int, np.ndarray]:
    start, header, width, height, _, depth, packed = struct.unpack("<IIiiHHI", data[10:34])
    if header < 40 or width <= 0 or not height or (packed, depth) not in ((0, 8), (0, 24), (0, 32)):
        raise ValueError("no such kind of BMP")
    line, step = -(-width * depth // 32) * 4, depth // 8
    flat = np.frombuffer(data, np.uint8, abs(height) * line, start)  # too few bytes are an error
    rows = flat.reshape(abs(height), line)[:, : width * step].reshape(abs(height), width, step)[:: -1 if height > 0 else 1]
    if depth == 8:
        used = struct.unpack("<I", data[46:50])[0] or 256
        palette = np.frombuffer(data, np.uint8, used * 4, 14 + header).reshape(-1, 4)
        rows = palette[rows[..., 0]]
    return width, abs(height), rows[..., 2::-1]


def pixels(data: bytes) -> tuple[int, int, np.ndarray]:
    """Width, height and (height, width, 3) red, green and blue."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return png(data)
    if data[:2] == b"BM":
        return bmp(data)
    raise ValueError("neither PNG nor BMP")


def decoded_bytes(rows: DataFrame, column: str = "bytes") -> DataFrame:
    """Adds width, height, rgb (row by row) and error to rows with images as bytes.

    What can't be decoded has an error and no pixels, and null has neither; a caller keeps the
    two apart by ``error is null``. Images are decoded one at a time, in the task of their row."""

    def run(batches):
        for b in batches:
            made = []
            for data in b.column(column).to_pylist():
                try:
                    made.append((None, None, None, None) if data is None else (lambda w, h, x: (w, h, np.ascontiguousarray(x).tobytes(), None))(*pixels(data)))
                except (ValueError, KeyError, IndexError, struct.error, zlib.error, MemoryError) as e:
                    made.append((None, None, None, f"{type(e).__name__}: {e}"))
            for name, kind, values in zip(("width", "height", "rgb", "error"), (pa.int32(), pa.int32(), pa.binary(), pa.string()), zip(*made, strict=True) if made else ((),) * 4, strict=True):
                b = b.append_column(name, pa.array(values, kind))
            yield b

    old = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return rows.mapInArrow(run, f"{old}, width int, height int, rgb binary, error string")


def image_column(rows: DataFrame, column: str = "image") -> DataFrame:
    """``decoded_bytes`` of a struct column of bytes and path; rows of paths only stay as they are, for ``images.decoded_images``."""
    return decoded_bytes(rows.withColumn("__bytes", F.col(column)["bytes"]), "__bytes").drop("__bytes")
