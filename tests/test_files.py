"""Lines with their numbers, one file from many tasks, labels, loaders and model inputs."""

import csv
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from corvane.operators import mining as M
from corvane.operators import models as X
from corvane.operators import reports as P
from corvane.sources import readers, sinks, whole_files

SCHEMA = "id long, v string"


@pytest.fixture
def ranges(spark):
    """Files are read in ranges of a few bytes."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def lines_of(n, start=0):
    return ["" if i % 7 == 3 else json.dumps({"id": start + i, "v": "x" * (i % 40)}) for i in range(n)]


def test_line_numbers(spark, tmp_path, ranges):
    own = {"a.jsonl": ["﻿" + lines_of(1)[0], *lines_of(200)[1:]], "b.jsonl": lines_of(90, 1000), "c.jsonl": [""], "d.jsonl": []}
    for name, lines in own.items():
        (tmp_path / name).write_text("\n".join(lines) + ("\n" if lines else ""), encoding="utf-8")
    df = readers.numbered_lines(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() > 3
    got = {(r["path"].rsplit("/", 1)[-1], r["line_no"]): r["line"] for r in df.collect()}
    assert got == {(name, i): line.removeprefix("﻿") for name, lines in own.items() for i, line in enumerate(lines, 1)}
    strict = readers.json_lines(spark, str(tmp_path), SCHEMA)
    assert sorted(r["id"] for r in strict.collect()) == sorted(json.loads(x)["id"] for lines in own.values() for x in got_lines(lines))


def got_lines(lines):
    return [x.removeprefix("﻿") for x in lines if x.strip("﻿")]


@pytest.mark.parametrize("bad", ['{"id": 1', "[1]", "5", '{"id": "x"}'])
def test_bad_lines_are_named(spark, tmp_path, ranges, bad):
    lines = lines_of(150)
    lines[120] = bad
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    for use in (lambda df: df.collect(), lambda df: df.count(), lambda df: df.select("v").collect()):
        with pytest.raises(Exception, match=r"a\.jsonl:121: bad JSON"):
            use(readers.json_lines(spark, str(tmp_path), SCHEMA))
    assert readers.json_lines(spark, str(tmp_path), SCHEMA, limit=50).count() == 50
    assert readers.json_lines(spark, str(tmp_path), SCHEMA, strict=False, limit=500).count() == sum(bool(x) for x in lines) - 1


def test_capped_reads_open_few_files(spark, tmp_path):
    for i in range(9):
        (tmp_path / f"{i}.jsonl").write_text("\n".join(lines_of(10, 10 * i) if i < 4 else ["not json"]))
    got = readers.json_lines(spark, str(tmp_path), SCHEMA, limit=12)
    assert [r["id"] for r in got.collect()] == [i for i in range(20) if i % 10 != 3][:12]
    assert len(readers.first_files(spark, str(tmp_path), 12)) == 3 and readers.json_lines(spark, str(tmp_path), SCHEMA, limit=0).count() == 0


def test_one_file_from_many_tasks(spark, tmp_path):
    rows = [(i, None if i % 5 == 0 else f'say "{i}",\n| ü', [i, i + 1]) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, v string, xs array<long>").repartitionByRange(6, "id").sortWithinPartitions("id")
    want = [{"id": i, "v": v, "xs": xs} for i, v, xs in rows]
    for pretty in (False, True):
        sinks.write_json_array(df, str(tmp_path / "a.json"), pretty=pretty)
        assert json.loads((tmp_path / "a.json").read_text(encoding="utf-8")) == want
    sinks.write_csv(df.select("id", F.col("v").alias("a,b")), str(tmp_path / "a.csv"))
    with open(tmp_path / "a.csv", encoding="utf-8", newline="") as f:
        assert list(csv.reader(f)) == [["id", "a,b"], *[[str(i), v or ""] for i, v, _ in rows]]
    with pytest.raises(FileExistsError):
        sinks.write_csv(df.select("id"), str(tmp_path / "a.csv"))
    sinks.write_csv(df.select("id").limit(0), str(tmp_path / "a.csv"), "overwrite")
    sinks.write_document(df.limit(0), str(tmp_path / "b.json"))
    assert (tmp_path / "a.csv").read_text() == "" and json.loads((tmp_path / "b.json").read_text()) == []
    with pytest.raises(Exception, match="no good"):
        sinks.write_json_array(df.select(F.raise_error(F.lit("no good")).alias("x")), str(tmp_path / "b.json"))
    assert json.loads((tmp_path / "b.json").read_text()) == [] and sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["a.csv", "a.json", "b.json"]


def test_streamed_archives(spark, tmp_path):
    (tmp_path / "x").write_bytes(bytes(range(256)) * 20_000)
    for name, session in (("p.zip", None), ("q.zip", spark)):
        whole_files.write_package(str(tmp_path / name), {"m/x": str(tmp_path / "x"), "a/y": str(tmp_path / "x")}, "how", session)
        with zipfile.ZipFile(tmp_path / name) as z:
            assert z.namelist() == ["a/y", "m/x", "REPRODUCE.md"] and z.testzip() is None
            assert z.read("m/x") == (tmp_path / "x").read_bytes() and z.read("REPRODUCE.md") == b"how"
    with pytest.raises(Exception, match="nothing"):
        whole_files.write_package(str(tmp_path / "q.zip"), {"z": str(tmp_path / "nothing")}, "", spark)
    assert zipfile.ZipFile(tmp_path / "q.zip").testzip() is None


@pytest.mark.parametrize("path,label", [
    ("eval_runs/full_heldout/my_model.per_sample.jsonl", "my_model"), ("comparison/x.json", "x"), ("metrics_full_heldout_epoch3.json", "epoch3"), ("predictions_full_heldout.jsonl", "artifact"),
    ("run7/x.jsonl", "run7"), ("base/comparison/x.json", "base"), ("", "artifact"), ("a\\comparison\\metrics_full_heldout-b.json", "b"),
])
def test_labels(path, label):
    assert readers.label_of(path, known=("base",)) == label
    assert readers.label_of(path, embedded="e", known=("base",)) == "e" and readers.label_of(path, "f", "e") == "f"


def test_entailment_labels_and_long_pairs(spark):
    rows = spark.createDataFrame([("a b c d e f", "x y", "p")], "answer string, prediction string, prompt string")
    told = lambda *names: X.nli(rows, lambda: lambda p, h: [[{"label": n, "score": 0.1 * (i + 3)} for i, n in enumerate(names)]] * len(p)).first()["nli"]
    assert told("ENTAIL", "LABEL_CONTRADICT", "neutral") == pytest.approx(-0.1) and told("is_entailment") == pytest.approx(0.3) and told("other") == 0.0

    class Words:
        encode, decode = staticmethod(str.split), staticmethod(" ".join)

    seen = X.nli(rows, lambda: lambda p, h: [[len(p[0].split()) / 10, len(h[0].split())]] * len(p), tokenizer=lambda: Words, max_tokens=5).first()["nli"]
    assert seen == pytest.approx(0.3 - 2)
    for n in range(7):
        for m in range(7):
            for most in range(14):
                a, b = list(range(n)), list(range(m))
                while len(a) + len(b) > most:
                    (a if len(a) > len(b) else b).pop()
                assert X.pair_cut(list(range(n)), list(range(m)), most) == (a, b)


def test_loaders(spark):
    readers.register_source("mine", lambda spark, n: spark.range(n).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("pair_id"), F.lit("r").alias("report"), (-F.col("id")).alias("position")))
    got = readers.load_corpus(spark, "mine", 4).orderBy("row_id").collect()
    assert [(r["row_id"], r["pair_id"], r["image_path"], r["meta"]) for r in got] == [(i, f"p{3 - i}", None, {}) for i in range(4)]
    assert readers.load_corpus(spark, "synthetic", 5).columns == ["row_id", "pair_id", "image_path", "report", "meta"]
    with pytest.raises(ValueError, match="already"):
        readers.register_source("mine", None)
    with pytest.raises(ValueError, match="gives no"):
        readers.load_corpus(spark, "restricted")


def test_mined_report(spark):
    kind = "unique_key string, image string, record_type string, prompt string, answer string, prediction string, token_f1 double, rougeL double, unsupported_specific_count int, has_specificity_hallucination boolean"
    make = lambda f1, said: spark.createDataFrame([("k1", "im", "qa", "q|\nq", "g", said, f1, 0.5, 1, True), ("k2", "im", "qa", "q2", "g", said, 0.0, 0.5, 1, True)], kind)
    page = P.mined_report({"improvements": M.improvements(make(0.75, "yes"), make(0.25, "no"), 5), "none": M.improvements(make(0.1, "x"), make(0.1, "x"), 5)}, {"a": "new", "b": "old"})
    assert "| k1 | 0.5000 | im | qa | q\\| q | g | yes | 0.7500 | 1 | no | 0.2500 | 1 |" in page and "## none\n\n_No rows._" in page and "k2" not in page
    with pytest.raises(ValueError, match="write_csv"):
        sinks.markdown_table(spark.range(12), most=10)
