"""Members of archives, by pieces and as streams."""

import io
import random
import zipfile

import pytest

from corvane.sources import archives, readers, whole_files


def want_of(path, suffix=".jsonl", exclude="comparison/"):
    out = set()
    with zipfile.ZipFile(path) as z:
        for name in (n for n in z.namelist() if n.endswith(suffix) and not n.startswith(exclude)):
            text = io.TextIOWrapper(io.BytesIO(z.read(name)), "utf-8-sig")
            out |= {(path.name, name, i, x.rstrip("\r\n")) for i, x in enumerate(text, 1) if x.strip()}
    return out


def told(df):
    return [(r["archive"].rsplit("/", 1)[-1], r["member"], r["line_no"], r["line"]) for r in df.collect()]


@pytest.mark.parametrize("piece,range_bytes", [(1 << 18, "128m"), (50, "3000")])
def test_members_by_pieces(spark, tmp_path, monkeypatch, piece, range_bytes):
    monkeypatch.setattr(archives, "PIECE", piece)
    monkeypatch.setattr(archives, "LINES", 7)
    spark.conf.set("spark.sql.files.maxPartitionBytes", range_bytes)
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    rnd = random.Random(1)
    line = lambda: "".join(rnd.choice("abcäß  \t{}\"") for _ in range(rnd.randrange(40)))
    try:
        for k in range(3):
            with zipfile.ZipFile(tmp_path / f"{k}.zip", "w") as z:
                for i in range(6):
                    lines = [line() for _ in range(rnd.choice([0, 1, 300]))]
                    text = rnd.choice(["\n", "\r\n", "\r"]).join(lines) + rnd.choice(["", "\n"])
                    z.writestr(f"m{k}/{'ü' * i}{i}.jsonl", ("﻿" if i == 2 else "") + text, rnd.choice([zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED]))
                z.writestr("comparison/x.jsonl", "no")
                z.writestr("other.txt", "no")
                with z.open("wide.jsonl", "w", force_zip64=True) as f:
                    f.write(b"one\n\ntwo")
                z.comment = b"PK" * k
        df = archives.zipped_lines(spark, str(tmp_path))
        got = told(df)
        want = set().union(*(want_of(tmp_path / f"{k}.zip") for k in range(3)))
        assert len(got) == len(want) and set(got) == want and ("1.zip", "wide.jsonl", 3, "two") in want
        assert told(readers.open_source(spark, "zip", str(tmp_path / "1.zip"), suffix=".txt")) == [("1.zip", "other.txt", 1, "no")]
        assert archives.zipped_lines(spark, str(tmp_path), suffix=".none").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_damaged_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("a.jsonl", "some text of a member\n" * 9)
    data = bytearray((tmp_path / "a.zip").read_bytes())
    data[60] ^= 1
    (tmp_path / "b.zip").write_bytes(data)
    (tmp_path / "c.zip").write_bytes(b"no archive")
    with pytest.raises(Exception, match="damaged"):
        archives.zipped_lines(spark, str(tmp_path / "b.zip")).collect()
    with pytest.raises(ValueError, match="no ZIP"):
        archives.zipped_lines(spark, str(tmp_path / "c.zip"))


def test_what_is_packed_is_read(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text("".join(f"line {i}\n" for i in range(3000)))
    whole_files.write_package(str(tmp_path / "p.zip"), {"a/x.jsonl": str(tmp_path / "x.jsonl")}, "", spark)
    got = told(archives.zipped_lines(spark, str(tmp_path / "p.zip")))
    assert got == [("p.zip", "a/x.jsonl", i + 1, f"line {i}") for i in range(3000)]
