"""Images from bytes: what an encoder of our own writes, and what the JVM reads of the same files."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.sources import images, pixels


def packed(rows, depth):
    """(height, width * channels) values as lines of bytes."""
    if depth == 16:
        return rows.astype(">u2").view(np.uint8).reshape(len(rows), -1)
    if depth == 8:
        return rows.astype(np.uint8)
    bits = (rows[..., None] >> np.arange(depth)[::-1]) & 1
    return np.packbits(bits.reshape(len(rows), -1).astype(np.uint8), axis=1)


def filtered(lines, step, kinds):
    out, before = b"", np.zeros(lines.shape[1], int)
    for y, line in enumerate(lines.astype(int)):
        left, corner = (np.concatenate([np.zeros(step, int), a])[: len(a)] for a in (line, before))
        kind = kinds[y % len(kinds)]
        if kind == 4:
            near = left + before - corner
            far = [abs(near - v) for v in (left, before, corner)]
            guess = np.where((far[0] <= far[1]) & (far[0] <= far[2]), left, np.where(far[1] <= far[2], before, corner))
        else:
            guess = (0, left, before, (left + before) // 2)[kind]
        out += bytes([kind]) + ((line - guess) % 256).astype(np.uint8).tobytes()
        before = line
    return out


def encoded(values, depth, colour, palette=None, interlaced=False, kinds=(0, 1, 2, 3, 4)):
    height, width, channels = values.shape
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    step = max(1, channels * depth // 8)
    body = b""
    for x, y, dx, dy in pixels.PASSES if interlaced else ((0, 0, 1, 1),):
        own = values[y::dy, x::dx]
        if own.size:
            body += filtered(packed(own.reshape(len(own), -1), depth), step, kinds)
    parts = [chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, int(interlaced)))]
    if palette is not None:
        parts.append(chunk(b"PLTE", palette.astype(np.uint8).tobytes()))
    squeezed = zlib.compress(body)
    parts += [chunk(b"IDAT", squeezed[: len(squeezed) // 2]), chunk(b"IDAT", squeezed[len(squeezed) // 2 :]), chunk(b"IEND", b"")]
    return b"\x89PNG\r\n\x1a\n" + b"".join(parts)


def bitmap(rgb, depth, down=False):
    height, width, _ = rgb.shape
    line = -(-width * depth // 32) * 4
    table, body = b"", b""
    rows = rgb if down else rgb[::-1]
    if depth == 8:
        colours, index = np.unique(rows.reshape(-1, 3), axis=0, return_inverse=True)
        table = b"".join(bytes([*c[::-1], 0]) for c in colours.tolist())
        raw = [index.reshape(height, width)[y].astype(np.uint8).tobytes() for y in range(height)]
    else:
        raw = [np.concatenate([r[:, ::-1], np.full((width, depth // 8 - 3), 7, np.uint8)], axis=1).tobytes() for r in rows]
    body = b"".join(r.ljust(line, b"\0") for r in raw)
    header = struct.pack("<IiiHHIIiiII", 40, width, -height if down else height, 1, depth, 0, len(body), 0, 0, len(table) // 4, 0)
    return b"BM" + struct.pack("<IHHI", 54 + len(table) + len(body), 0, 0, 54 + len(table)) + header + table + body


@pytest.mark.parametrize("interlaced", [False, True])
@pytest.mark.parametrize("colour,depth", [(c, d) for c, ds in pixels.DEPTHS.items() for d in ds])
def test_png(colour, depth, interlaced):
    rnd = np.random.default_rng(colour * 16 + depth)
    for height, width in ((1, 1), (5, 3), (13, 17)):
        values = rnd.integers(0, 1 << depth, (height, width, pixels.CHANNELS[colour]))
        palette = rnd.integers(0, 256, (1 << depth, 3)) if colour == 3 else None
        w, h, got = pixels.pixels(encoded(values, depth, colour, palette, interlaced))
        small = values >> 8 if depth == 16 else values
        grey = np.repeat(small[..., :1] * (255 // ((1 << depth) - 1) if depth < 8 else 1), 3, axis=2)
        want = palette[values[..., 0]] if colour == 3 else grey if colour in (0, 4) else small[..., :3]
        assert (w, h) == (width, height) and (got == want).all()


def test_bytes_and_files_agree(spark, tmp_path):
    rnd = np.random.default_rng(3)
    rgb = rnd.integers(0, 256, (9, 7, 3)).astype(np.uint8)
    palette = rnd.integers(0, 256, (16, 3))
    own = {
        "rgb.png": encoded(rgb, 8, 2), "interlaced.png": encoded(rgb, 8, 2, interlaced=True), "grey.png": encoded(rgb[..., :1], 8, 0), "bits.png": encoded(rgb[..., :1] & 1, 1, 0), "palette.png": encoded(rgb[..., :1] & 15, 4, 3, palette),
        "alpha.png": encoded(np.concatenate([rgb, np.full((9, 7, 1), 255)], axis=2), 8, 6), "a.bmp": bitmap(rgb, 24), "down.bmp": bitmap(rgb, 24, True), "table.bmp": bitmap(rgb, 8),
    }
    for name, data in own.items():
        (tmp_path / name).write_bytes(data)
    bad = {"cut": own["rgb.png"][:60], "flip": own["rgb.png"][:50] + b"?" + own["rgb.png"][51:], "jpeg": b"\xff\xd8\xff", "empty": b"", "short.bmp": own["a.bmp"][:80], "huge": encoded(rgb[:1, :1], 8, 2)[:16] + struct.pack(">II", 1, 10**6), "none": None}
    rows = spark.createDataFrame([(k, v, 5) for k, v in (own | bad).items()], "name string, bytes binary, width_of long").repartition(3)
    got = {r["name"]: r for r in pixels.decoded_bytes(rows).collect()}
    files = {r["path"].rsplit("/", 1)[-1]: (r["width"], r["height"], bytes(r["rgb"])) for r in images.decoded_images(spark, str(tmp_path)).collect()}
    assert set(files) == set(own) and {k: (got[k]["width"], got[k]["height"], bytes(got[k]["rgb"])) for k in own} == files
    assert all(got[k]["rgb"] is None and (got[k]["error"] is None) == (k == "none") for k in bad) and got["jpeg"]["width_of"] == 5
    assert bytes(got["rgb.png"]["rgb"]) == rgb.tobytes() and pixels.decoded_bytes(rows.limit(0)).count() == 0
    wide = np.concatenate([rgb, np.full((9, 7, 1), 9)], axis=2)
    assert (pixels.pixels(bitmap(rgb, 32))[2] == rgb).all() and (pixels.pixels(encoded(wide, 8, 6))[2] == rgb).all()
    structs = rows.select("name", F.struct("bytes", F.lit("p").alias("path")).alias("image"))
    assert pixels.image_column(structs).where("error is null and rgb is not null").count() == len(own)
