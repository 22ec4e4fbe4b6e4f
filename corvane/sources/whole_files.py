"""One file from many tasks: tasks write parts, and the driver copies them as streams, in constant memory.

The file is put in place by a rename when it is whole, in the file system of its path. The
order of the rows is that of the DataFrame's partitions."""

from __future__ import annotations

import csv
import io
import os
import uuid
import zipfile
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Files:
    """The file system of a path, by the JVM."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark._jvm
        self.fs = self.at(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.at(path))

    def delete(self, path: str) -> None:
        self.fs.delete(self.at(path), True)

    def parts(self, path: str) -> list[tuple[str, int]]:
        """(path, bytes) of the files that hold rows, in order."""
        found = [(s.getPath().toString(), s.getLen()) for s in self.fs.listStatus(self.at(path))]
        return sorted((p, n) for p, n in found if n and p.rsplit("/", 1)[-1].startswith("part-"))

    def copy(self, path: str, out, n: int) -> None:
        """The first n bytes of a file."""
        source = self.fs.open(self.at(path))
        self.jvm.org.apache.commons.io.IOUtils.copyLarge(source, out, 0, n)
        source.close()

    @contextmanager
    def whole(self, path: str):
        """A stream to a file that takes its place when the block ends well."""
        part = f"{path}.{uuid.uuid4().hex}.part"
        out = self.fs.create(self.at(part), True)
        try:
            yield out
            out.close()
        except BaseException:
            out.close()
            self.delete(part)
            raise
        if self.exists(path):
            self.delete(path)
        if not self.fs.rename(self.at(part), self.at(path)):
            raise OSError(f"{path} could not be put in place")


def join_parts(spark: SparkSession, path: str, write: Callable[[str], None], head: bytes, tail: bytes, between: bytes, empty: bytes, mode: str) -> None:
    """What ``write`` makes below a folder, as one file: head, the parts without the last row's ``between``, tail; or ``empty``."""
    files, folder = Files(spark, path), f"{path}.{uuid.uuid4().hex}.parts"
    if mode == "errorifexists" and files.exists(path):
        raise FileExistsError(path)
    try:
        write(folder)
        parts = files.parts(folder)
        with files.whole(path) as out:
            out.write(bytearray(head if parts else empty))
            for i, (part, size) in enumerate(parts):
                files.copy(part, out, size - (len(between) if i == len(parts) - 1 else 0))
            out.write(bytearray(tail if parts else b""))
    finally:
        files.delete(folder)


def write_json_array(df: DataFrame, path: str, mode: str = "overwrite", pretty: bool = False) -> None:
    """A JSON array of the rows, one on a line, or indented; null fields are null."""
    told = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false", "pretty": str(pretty).lower()})
    body = F.concat(F.lit("  "), F.replace(told, F.lit("\n"), F.lit("\n  "))) if pretty else told
    rows = df.select(body.alias("value"))
    join_parts(df.sparkSession, path, lambda to: rows.write.option("lineSep", ",\n").text(to), b"[\n", b"\n]\n", b",\n", b"[]\n", mode)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A CSV file with a line of names; no rows make an empty file. Null is empty, quotes are doubled."""
    names = io.StringIO()
    csv.writer(names, lineterminator="\n").writerow(df.columns)
    made = lambda to: df.write.option("header", False).option("escape", '"').option("emptyValue", "").csv(to)
    join_parts(df.sparkSession, path, made, names.getvalue().encode(), b"", b"", b"", mode)


def write_package(path: str, members: dict[str, str], note: str = "", spark: SparkSession | None = None) -> None:
    """A ZIP archive of files under member names, with a note on how to make them again, put in place when it is whole.

    Members are streamed. With a session, the archive goes to the file system of its path, and
    members may be in any, by their scheme; without one, all are files of the driver."""
    if spark is None:
        with zipfile.ZipFile(f"{path}.part", "w", zipfile.ZIP_DEFLATED) as z:
            for name in sorted(members):
                z.write(members[name], name)
            if note:
                z.writestr("REPRODUCE.md", note)
        os.replace(f"{path}.part", path)
        return
    files, jvm = Files(spark, path), spark._jvm
    with files.whole(path) as out:
        z = jvm.java.util.zip.ZipOutputStream(out)
        for name in sorted(members):
            z.putNextEntry(jvm.java.util.zip.ZipEntry(name))
            source = members[name] if "://" in members[name] else f"file://{os.path.abspath(members[name])}"
            own = Files(spark, source)
            own.copy(source, z, own.fs.getFileStatus(own.at(source)).getLen())
            z.closeEntry()
        if note:
            z.putNextEntry(jvm.java.util.zip.ZipEntry("REPRODUCE.md"))
            z.write(bytearray(note.encode()))
            z.closeEntry()
        z.finish()
