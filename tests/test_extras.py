"""Ablation modes, images, settings and streams."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from corvane.operators import ablation as A
from corvane.operators import retrieval as R
from corvane.sources import config, images
from corvane.streaming import appends


@pytest.fixture(scope="module")
def index(spark):
    corpus = spark.createDataFrame([(0, "red fox  jumps"), (1, "blue whale"), (2, "red whale sings"), (3, None)], "row_id long, report string")
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.6, 0.8])], "row_id long, vec array<double>")
    return A.Index(corpus, text_vectors=vectors, image_vectors=vectors)


def test_modes(spark, index):
    asked = spark.createDataFrame([(7, "whale sings", [1.0, 0.0], [0.0, 1.0]), (8, "", None, None)], "query_id long, text string, text_vec array<double>, image_vec array<double>")
    assert A.retrieve("no_retrieval", asked, index, 2) is None
    rows = lambda df: [(r["query_id"], r["row_id"]) for r in df.orderBy("query_id", "rank").collect()]
    assert rows(A.retrieve("sparse_bm25", asked, index, 1)) == [(7, 2)]
    assert rows(A.retrieve("dense_visual", asked, index, 2)) == [(7, 1), (7, 2)]
    with pytest.raises(ValueError, match="hybrid"):
        A.retrieve("other", asked, index, 2)
    with pytest.raises(ValueError, match="image vectors"):
        A.retrieve("dense_visual", asked, A.Index(index.corpus), 2)
    text, bm25, seen = R.dense_topk(index.text_vectors, asked.where("query_id = 7").select("query_id", F.col("text_vec").alias("vec")), 2), R.bm25_topk(index.corpus, asked, 2), R.dense_topk(index.image_vectors, asked.where("query_id = 7").select("query_id", F.col("image_vec").alias("vec")), 2)
    want = R.fuse([(text, 0.7), (bm25, 0.7), (seen, 0.3)], 2)
    assert A.retrieve("hybrid", asked, index, 2, pool=2, visual=0.3).collect() == want.collect()
    swap = A.Steps(rerank=lambda df: df.withColumn("rank", 3 - F.col("rank")), weights=lambda w: {"visual": 0.0, "text": 1.0})
    assert len(rows(A.retrieve("hybrid", asked, index, 1, pool=2, steps=swap))) == 1
    got = {r["query_id"]: r["context"] for r in A.contexts(asked, A.retrieve("sparse_bm25", asked, index, 1), index, "H", "F", 100).collect()}
    assert got == {7: "H\n[1] (text) red whale sings\nF", 8: ""}
    done = A.compare(["no_retrieval", "sparse_bm25"], lambda mode, rows: rows.select("query_id", "context"), asked, index, 1, "H", "F", 100)
    assert {r["context"] for r in done["no_retrieval"].collect()} == {""} and done["sparse_bm25"].count() == 2
    parts = spark.createDataFrame([(1, 1, "b"), (1, 0, "a"), (2, 0, "c")], "query_id long, part int, text string")
    assert {tuple(r) for r in A.joined_parts(parts).collect()} == {(1, "a b"), (2, "c")}


def png(pixels: bytes, width: int, height: int) -> bytes:
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    lines = b"".join(b"\0" + pixels[i * width * 3 : (i + 1) * width * 3] for i in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def test_images(spark, tmp_path):
    pixels = bytes(range(18))
    (tmp_path / "a.png").write_bytes(png(pixels, 3, 2))
    (tmp_path / "b.jpg").write_bytes(b"no image")
    (tmp_path / "c.txt").write_text("no image either")
    row = images.decoded_images(spark, str(tmp_path)).collect()
    assert [(r["width"], r["height"], bytes(r["rgb"])) for r in row] == [(3, 2, pixels)]
    assert [r["path"].rsplit("/", 1)[-1] for r in images.listed_images(spark, str(tmp_path)).collect()] == ["a.png", "b.jpg"]
    assert [r["path"].rsplit("/", 1)[-1] for r in images.unreadable_images(spark, str(tmp_path)).collect()] == ["b.jpg"]


def test_settings(tmp_path):
    path = tmp_path / "s.yaml"
    path.write_text("corpus:\n  name: x\n  max_pairs: 5\neval:\n")
    got = config.load_settings(str(path), {**config.SYNTHETIC, "corpus.max_pairs": None, "eval.num_samples": 3})
    assert got == {"corpus": {"name": "synthetic", "source": "synthetic", "max_pairs": 5}, "eval": {"num_samples": 3}}
    assert config.setting(got, "corpus.max_pairs") == 5 and config.setting(got, "model.checkpoint", "none") == "none"
    path.write_text("")
    assert config.load_settings(str(path)) == {}


def test_streams(spark, tmp_path):
    logs, out = tmp_path / "logs", str(tmp_path / "out")
    logs.mkdir()
    line = "Step {0}/100 | Loss: {1} | LR: 1e-4 | Samples/s: 26.0\n"
    (logs / "a.txt").write_text("noise\n" + line.format(10, 2.5) + line.format(10, 2.5))
    run = lambda check: appends.append_stream(appends.log_stream(spark, str(logs)), "step", out, str(tmp_path / check)).awaitTermination(60)
    steps = lambda: sorted(r["step"] for r in spark.read.json(out).collect())
    assert run("one") and steps() == [10]
    (logs / "b.txt").write_text(line.format(20, 1.5) + line.format(10, 9.0))
    assert run("one") and steps() == [10, 20]
    assert run("two") and steps() == [10, 20]  # all files again: nothing new
