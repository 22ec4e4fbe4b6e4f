import math
import os
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import datasets as D
from corvane.operators import evaluation as E
from corvane.operators import mining as M
from corvane.operators import models as X
from corvane.operators import retrieval as R
from corvane.plans import catalog
from corvane.sources import readers, sinks

DATA = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 8)
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    df = catalog.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    want = con.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in want.fetchall()), key=repr)


def test_normalizers_and_match(spark):
    n = lambda s: one(spark, T.normalize_words(F.lit(s)))
    assert (n("x_y!"), one(spark, T.normalize_unicode(F.lit("x_y!"))), n("The cat, a dog")) == ("xy", "x_y", "cat dog")
    em = lambda p, g: one(spark, T.exact_match(F.lit(p), F.lit(g)))
    assert em("", "") and not em("x", "") and em("There is cardiomegaly here", "cardiomegaly") and not em("heart", "art")
    assert one(spark, T.answer_type(F.lit("Yes."), False)) == "open"
    assert one(spark, T.answer_type(F.lit("Yes."), True)) == "closed"


def test_token_f1_and_rouge(spark):
    f1 = lambda p, g: one(spark, T.token_f1(F.lit(p), F.lit(g)))
    assert f1("", "") == 1.0 and f1("x", "") == 0.0 and f1("b b c", "b b b") == pytest.approx(2 / 3)
    assert one(spark, E.rouge_l(F.lit("the cat sat on the mat"), F.lit("the cat lay on a mat"))) == pytest.approx(4 / 6)
    assert E.lcs_length(list("abcbdab"), list("bdcaba")) == 4


def test_specifics(spark):
    got = one(spark, T.specifics(F.lit("NGC 1234 and Messier 42, 12.5 light years off, z = 0.5, seen by Hubble in 1999")))
    assert {"ngc1234", "m42", "12.5 light years", "z = 0.5", "hubble", "1999"} <= set(got)
    assert one(spark, T.unsupported(F.lit("NGC 1 and M 31"), F.lit("m31"))) == ["ngc1"]


def test_small_functions(spark):
    assert one(spark, T.safe_name(F.lit("__a b/c.."), "x")) == "a_b_c"
    assert one(spark, T.shorten(F.lit("a  b\nc" * 20), 10)) == "a b ca..."
    assert [one(spark, T.as_number(F.lit(v))) for v in ("true", "2.5", "x")] == [1.0, 2.5, None]
    assert one(spark, T.first_filled(F.lit(" "), F.lit("b"))) == "b"
    assert one(spark, T.first_present(F.lit(""), F.lit("b"))) == ""
    assert one(spark, T.decoded_answer(F.lit("q<|im_start|>assistant\n hi <|im_end|>x"))) == "hi"
    assert one(spark, T.record_type("a", F.lit(None), F.lit("x"), F.lit("Describe this image."))) == "caption"
    assert one(spark, T.record_type("b", F.lit(None), F.lit("x"), F.lit("Describe this image."))) == "qa"
    assert one(spark, T.record_type("d", F.lit("caption"), F.lit("1_qa0"), F.lit(None))) == "qa"
    reasons = T.joined_reasons([("a", F.lit(True)), ("b", F.lit(False)), ("c", F.lit(True))], "none")
    assert one(spark, reasons) == "a;c"


def test_qa_flatten_and_conversations(spark):
    roles = "user user assistant assistant user assistant".split()
    rows = [(1, i, r, f"t{i}") for i, r in enumerate(roles)] + [(2, 0, "user", "q"), (2, 1, "assistant", " "), (2, 2, "assistant", "a")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["qa_id"], r["question"], r["answer"]) for r in D.question_answers(turns).collect()}
    assert got == {("1_qa0", "t1", "t2"), ("1_qa1", "t4", "t5"), ("2_qa0", "q", "a")}
    c = D.conversations(turns).where("conv_id = 1").select(D.with_image_token(F.col("conversations")).alias("c")).first()["c"]
    assert c[0]["value"] == "<image>\nt0" and c[1]["value"] == "t1"


def test_context_budget(spark):
    rows = spark.createDataFrame([(1, i, "x" * 10) for i in range(1, 5)], "query_id long, rank int, entry string")
    assert R.pack_context(rows, "h" * 5, "f", 30).first()["context"] == "\n".join(["hhhhh", "x" * 10, "x" * 10, "xx", "f"])


def test_bm25_zero_scores_and_fusion(spark):
    docs = spark.createDataFrame([(0, "b"), (1, "a a"), (2, "c"), (3, None)], "row_id long, report string")
    top = R.bm25_topk(docs, spark.createDataFrame([(7, "a a"), (8, "")], "query_id long, text string"), 3)
    assert [(r["rank"], r["row_id"]) for r in top.orderBy("rank").collect()] == [(1, 1), (2, 0), (3, 2)]
    a = spark.createDataFrame([(1, 5, 1), (1, 6, 2)], "query_id long, row_id long, rank int")
    b = spark.createDataFrame([(1, 6, 1), (1, 5, 2)], "query_id long, row_id long, rank int")
    assert [r["row_id"] for r in R.fuse([(a, 1), (b, 1)], 5).orderBy("rank").collect()] == [5, 6]


def test_keys_summaries_and_splits(spark):
    rows = spark.createDataFrame([(["k"], i) for i in range(3)], "row_key array<string>, pos long")
    assert [r["unique_key"] for r in E.occurrence_keys(rows).orderBy("pos").collect()] == [["k"], ["k", "dup", "2"], ["k", "dup", "3"]]
    none = spark.createDataFrame([(True, "open")], "em boolean, answer_type string")
    assert E.em_summary(none).first()["em_closed"] == 0.0
    groups = spark.range(400).select("id", (F.col("id") % 40).alias("g"))
    split = D.group_split(groups, "g", 0.3)
    assert split.groupBy("g").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    assert D.exact_sample(groups, "id", 17).count() == 17 and D.exact_sample(groups, "id", 0).count() == 400


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.json").write_text('﻿[{"id": "1", "image": "i", "conversations": [{"from": "human", "value": "q"}]}]', encoding="utf-8")
    assert readers.json_records(spark, str(tmp_path / "a.json")).first()["conversations"][0]["value"] == "q"
    (tmp_path / "b.jsonl").write_text('{"id": "1", "response": "r"}\n\n{bad\n')
    assert readers.json_lines(spark, str(tmp_path / "b.jsonl"), strict=False).count() == 1
    with pytest.raises(Exception):  # noqa: B017
        readers.json_lines(spark, str(tmp_path / "b.jsonl")).collect()
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("m/x.jsonl", '{"id": 1}\n\n{"id": 2}\n')
        z.writestr("comparison/y.jsonl", "{}\n")
    assert [(r["member"], r["line_no"]) for r in readers.zipped_lines(spark, str(tmp_path / "c.zip")).collect()] == [("m/x.jsonl", 1), ("m/x.jsonl", 3)]
    (tmp_path / "log.txt").write_text("noise\nStep 10/100 | Loss: 2.5 | LR: 1e-4 | Samples/s: 26.0\nStep 20/100 | Loss: 1.5 | LR: 1e-4 | Samples/s: 24.0\n")
    s = E.curve_summary(readers.training_log(spark, str(tmp_path / "log.txt"))).first()
    assert (s["first_loss"], s["last_loss"], s["min_step"], s["mean_samples_per_sec"]) == (2.5, 1.5, 20, 25.0)
    done = spark.createDataFrame([("1",)], "id string")
    sinks.append_new(spark.createDataFrame([("1", None), ("2", "x")], "id string, v string"), done, "id", str(tmp_path / "out"))
    assert [r["id"] for r in spark.read.json(str(tmp_path / "out")).collect()] == ["2"]
    assert sinks.markdown_table(spark.createDataFrame([(None, 1.5)], "a string, b double")).splitlines()[-1] == "| - | 1.5000 |"
    with pytest.raises(ValueError, match="synthetic"):
        readers.open_source(spark, "nothing")
    closed = readers.open_source(spark, "restricted")
    with pytest.raises(Exception, match="credentials"):
        closed.collect()
    assert readers.open_source(spark, "synthetic", 9).count() == 9


def test_bootstrap_in_blocks(spark):
    rows = [(["id", str(i)], "qa", "rougeL", float(i % 7)) for i in range(400)]
    base = spark.createDataFrame(rows, "unique_key array<string>, record_type string, metric string, value double")
    pairs = E.paired(base, base.withColumn("value", F.col("value") * 1.5))
    one_, many = ({r["split"]: r for r in E.bootstrap_ci(pairs, 2000, blocks=b).collect()} for b in (100_000, 150))
    diffs = [0.5 * (i % 7) for i in range(400)]
    mean = sum(diffs) / 400
    half = 1.96 * (sum((d - mean) ** 2 for d in diffs) / 400) ** 0.5 / 20
    for got in (one_["overall"], many["overall"], many["qa"]):
        assert (got["n"], got["ci_excludes_zero"]) == (400, True) and got["diff"] == pytest.approx(mean)
        assert got["ci_low"] == pytest.approx(mean - half, abs=half / 4) and got["ci_high"] == pytest.approx(mean + half, abs=half / 4)
    assert many == {r["split"]: r for r in E.bootstrap_ci(pairs.repartition(7), 2000, blocks=150).collect()}
    assert E.bootstrap_ci(pairs.limit(0), 10).count() == 0


def test_miners_on_missing_values(spark):
    kind = "unique_key string, token_f1 double, rougeL double, sbert double, contradiction double, unsupported_specific_count int, has_specificity_hallucination boolean, pred_specifics array<string>, answer_specifics array<string>"
    a = spark.createDataFrame([("x", 0.9, None, None, None, None, None, ["m31"], ["m31"]), ("y", 0.1, None, None, None, 2, True, None, None)], kind)
    b = spark.createDataFrame([("x", 0.5, None, None, None, None, None, [], ["m31"]), ("y", 0.5, None, None, None, 0, False, None, None), ("z", 1.0, None, None, None, 9, True, [], [])], kind)
    keys = lambda df: [(r["unique_key"], round(r["mine_score"], 6)) for r in df.collect()]
    assert keys(M.improvements(a, b, 5)) == [("x", 0.4)]
    assert keys(M.better_supported(a, b, 5)) == [("x", 0.9)]
    assert keys(M.safer_baselines(a, b, 5)) == [("y", 2.0)]
    assert keys(M.baseline_failures(a, b, 5)) == [("x", 0.4)]
    assert [r["mine_score"] for r in M.hallucinations(a.withColumn("pos", F.lit(1)), 5).collect()] == [2.1]


def test_model_seams(spark):
    rows = spark.createDataFrame([(1, 1, "a", "b b"), (1, 2, "a", "c"), (1, 3, "a", "d d d")], "query_id long, rank int, text string, report string")
    top = X.rerank(rows, lambda: lambda q, p: [float(len(x)) for x in p], 2)
    assert [(r["rank"], r["report"]) for r in top.orderBy("rank").collect()] == [(1, "d d d"), (2, "b b")]
    vec = X.embed(rows, lambda: lambda t: [[3.0, 4.0]] * len(t), "text").first()["vec"]
    assert vec == pytest.approx([0.6, 0.8])
    told = spark.createDataFrame([("q", "", "a"), ("q", "x", "a")], "prompt string, prediction string, answer string")
    scored = X.nli(told, lambda: lambda p, h: [[0.2, 0.7]] * len(p))
    assert sorted(round(r["nli"], 6) for r in scored.collect()) == [-1.0, -0.5]
    assert X.nli_summary(scored).first()["contradiction_rate"] == 1.0
    assert X.nli_summary(scored.limit(0)).first()["nli_consistency"] == 0.0
    made = X.generate(told.withColumn("prompt", F.col("prediction")), lambda: lambda p: 1 / len(p))
    assert sorted((r["response"] or "", r["error"] or "") for r in made.collect()) == [("", "ZeroDivisionError: division by zero"), ("1.0", "")]


def test_reports_and_packages(spark, tmp_path):
    report = sinks.markdown_report("R", [("A", "text"), ("B", spark.createDataFrame([], "a int"))])
    assert report == "# R\n\n## A\n\ntext\n\n## B\n\n_No rows._\n"
    (tmp_path / "x").write_text("1")
    sinks.write_package(str(tmp_path / "p.zip"), {"m/x.json": str(tmp_path / "x")}, "how")
    sinks.write_package(str(tmp_path / "q.zip"), {"m/x.json": str(tmp_path / "x")}, "how", spark)
    assert zipfile.ZipFile(tmp_path / "q.zip").namelist() == ["m/x.json", "REPRODUCE.md"]
    with zipfile.ZipFile(tmp_path / "p.zip") as z:
        assert z.namelist() == ["m/x.json", "REPRODUCE.md"] and z.read("REPRODUCE.md") == b"how"
