"""Text members of ZIP archives of any size, in the file system of their path.

The driver reads the archives' tables of contents only. The bytes themselves come from
Spark's text source, as lines of raw bytes by ranges of the file, which are put together to
pieces; counts of the ranges before say where in the file a piece lies. Pieces are dealt to
the members that they belong to, and each member is unpacked as a stream, in one task and
constant memory, so neither an archive nor a member has to fit anywhere."""

from __future__ import annotations

import codecs
import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.sources.whole_files import Files

PIECE, LINES = 1 << 18, 10_000
TAIL = 22 + 65_535  # the end record and the longest comment
NEWLINE = re.compile(r"\r\n|\n|\r")


def read_at(files: Files, path: str, start: int, size: int) -> bytes:
    source = files.fs.open(files.at(path))
    try:
        source.seek(start)
        return bytes(files.jvm.org.apache.commons.io.IOUtils.toByteArray(source, size))
    finally:
        source.close()


def contents(files: Files, path: str, length: int) -> list[tuple[str, int, int, int, int, int]]:
    """(member, first byte of its header, end of what belongs to it, packed size, method, CRC) of an archive, from its table of contents."""
    start = max(0, length - TAIL - 20)
    tail = read_at(files, path, start, length - start)
    end = tail.rfind(b"PK\5\6")
    if end < 0:
        raise ValueError(f"{path} is no ZIP archive")
    size, at = struct.unpack("<II", tail[end + 12 : end + 20])
    if end >= 20 and tail[end - 20 : end - 16] == b"PK\6\7":  # sizes of 64 bits
        record = read_at(files, path, struct.unpack("<Q", tail[end - 12 : end - 4])[0], 56)
        size, at = struct.unpack("<QQ", record[40:56])
    table, k, out = read_at(files, path, at, size), 0, []
    while table[k : k + 4] == b"PK\1\2":
        flags, method = struct.unpack("<HH", table[k + 8 : k + 12])
        crc, packed, plain, name, extra, comment = struct.unpack("<IIIHHH", table[k + 16 : k + 34])
        header = struct.unpack("<I", table[k + 42 : k + 46])[0]
        label = table[k + 46 : k + 46 + name].decode("utf-8" if flags & 0x800 else "cp437")
        more = table[k + 46 + name : k + 46 + name + extra]
        while len(more) >= 4:
            kind, n = struct.unpack("<HH", more[:4])
            if kind == 1:  # what did not fit in 32 bits, in this order
                wide = iter(struct.unpack(f"<{n // 8}Q", more[4 : 4 + n // 8 * 8]))
                plain, packed, header = (next(wide) if x == 0xFFFFFFFF else x for x in (plain, packed, header))
            more = more[4 + n :]
        if flags & 1 or method not in (0, 8):
            raise ValueError(f"{path}: {label} is encrypted or packed in another way than by deflation")
        out.append((label, header, packed, method, crc))
        k += 46 + name + extra + comment
    starts = sorted(x[1] for x in out) + [at]
    following = dict(zip(starts, starts[1:], strict=False))
    return [(label, header, following[header], packed, method, crc) for label, header, packed, method, crc in out]


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of a range, in order, put together: (path, start, at, bytes), at counted from the range's first byte."""
    key, at, held, size = None, 0, [], 0

    def piece() -> pa.RecordBatch:
        return pa.record_batch([pa.array([key[0]]), pa.array([key[1]]), pa.array([at]), pa.array([b"".join(held)], pa.binary())], ["path", "start", "at", "bytes"])

    for b in batches:
        for path, start, line in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            if key != (path, start) or size >= PIECE:
                if held:
                    yield piece()
                at = at + size if key == (path, start) else 0
                key, held, size = (path, start), [], 0
            held += [line, b"\n"]
            size += len(line) + 1
    if held:
        yield piece()


class Member:
    """A member being unpacked: bytes in, lines out."""

    def __init__(self, name: str, packed: int, method: int, crc: int):
        self.name, self.left, self.want, self.crc = name, packed, crc, 0
        self.head, self.body = b"", False
        self.unpack = zlib.decompressobj(-15) if method == 8 else None
        self.decode, self.text, self.count = codecs.getincrementaldecoder("utf-8-sig")(), "", 0

    def lines(self, data: bytes) -> Iterator[tuple[int, str]]:
        if not self.body:
            self.head += data
            if len(self.head) < 30:
                return
            name, extra = struct.unpack("<HH", self.head[26:30])
            if len(self.head) < 30 + name + extra:
                return
            self.body, data = True, self.head[30 + name + extra :]
        data = data[: self.left]
        self.left -= len(data)
        while data:
            plain = self.unpack.decompress(data, PIECE) if self.unpack else data
            data = self.unpack.unconsumed_tail if self.unpack else b""
            yield from self.told(plain, False)
        if self.left == 0:
            yield from self.told(self.unpack.flush() if self.unpack else b"", True)
            self.left = -1
            if self.crc != self.want:
                raise ValueError(f"{self.name} is damaged")

    def told(self, plain: bytes, last: bool) -> Iterator[tuple[int, str]]:
        self.crc = zlib.crc32(plain, self.crc)
        self.text += self.decode.decode(plain, last)
        held = "" if last or not self.text.endswith("\r") else "\r"  # a line feed may follow
        parts = NEWLINE.split(self.text[: len(self.text) - len(held)])
        self.text = parts.pop() + held
        for line in parts + ([self.text] if last and self.text else []):
            self.count += 1
            if line.strip():
                yield self.count, line


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of members from their pieces, in order: (archive, member, line_no, line)."""
    key, member, out = None, None, []

    def rows() -> pa.RecordBatch:
        return pa.record_batch([pa.array([x[i] for x in out]) for i in range(4)], ["archive", "member", "line_no", "line"])

    def ended() -> None:
        if member is not None and member.left >= 0:
            raise ValueError(f"{member.name} is cut off")

    for b in batches:
        names = ("path", "member", "header", "end", "packed", "method", "crc", "offset", "bytes")
        for path, name, header, end, packed, method, crc, offset, data in zip(*(b.column(k).to_pylist() for k in names), strict=True):
            if key != (path, name, header):
                ended()
                key, member = (path, name, header), Member(name, packed, method, crc)
            if member.left < 0:
                continue
            for n, line in member.lines(data[max(0, header - offset) : end - offset]):
                out.append((path, name, n, line))
                if len(out) == LINES:
                    yield rows()
                    out = []
    ended()
    if out:
        yield rows()


def zipped_lines(spark: SparkSession, path: str, suffix: str = ".jsonl", exclude: str = "comparison/") -> DataFrame:
    """(archive, member, line_no, line) of the text members of ZIP archives; blank lines are left out, but counted."""
    found = spark.read.format("binaryFile").load(path).select("path", "length").collect()  # names, not contents
    wanted = [(r["path"], *x) for r in sorted(found) for x in contents(Files(spark, r["path"]), r["path"], r["length"]) if x[0].endswith(suffix) and not x[0].startswith(exclude)]
    members = spark.createDataFrame(wanted, "path string, member string, header long, end long, packed long, method int, crc long")
    if not wanted:
        return spark.createDataFrame([], "archive string, member string, line_no long, line string")
    lines = spark.read.option("lineSep", "\n").text(sorted({r[0] for r in wanted}))
    raw = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value"))
    cut = raw.mapInArrow(pieces, "path string, start long, at long, bytes binary")
    sizes = raw.groupBy("path", "start").agg(F.sum(F.octet_length("value") + 1).alias("n"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    begun = sizes.select("path", "start", F.coalesce(before, F.lit(0)).alias("before"))  # a row for each range
    placed = cut.join(begun, ["path", "start"]).select("path", (F.col("before") + F.col("at")).alias("offset"), "bytes")
    plain = lambda c: F.regexp_replace(c, "^([a-z]+):/+", "$1:/")
    members = members.withColumn("__at", plain(F.col("path")))
    own = placed.withColumn("__at", plain(F.col("path"))).drop("path").join(members, "__at").where("offset < end and offset + octet_length(bytes) > header")
    dealt = own.repartition("path", "member", "header").sortWithinPartitions("path", "member", "header", "offset")
    return dealt.select("path", "member", "header", "end", "packed", "method", "crc", "offset", "bytes").mapInArrow(unpacked, "archive string, member string, line_no long, line string")
