"""Records, labels, metrics, stored indexes and early persistence."""

import dataclasses
import json
import math
import random
import warnings
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import ablation as A
from corvane.operators import datasets as D
from corvane.operators import evaluation as E
from corvane.operators import mining as M
from corvane.operators import models as X
from corvane.operators import records as C
from corvane.operators import reports as P
from corvane.operators import retrieval as R
from corvane.sources import readers, sinks

TURNS = "array<struct<`from`: string, value: string>>"


def test_metric_values(spark):
    kind = "k int, prediction string, answer string, sbert_cos double, sbert double, nli double, contradiction double, has_specificity_hallucination boolean, unsupported_specific_count int, pred_specifics array<string>"
    rows = spark.createDataFrame([(1, "The x_y", "x_y.", 0.0, 0.4, -0.1, None, True, 3, ["m31"]), (2, " ", "z", 0.0, None, None, None, None, None, []), (3, None, None, 0.7, 0.0, 0.2, 1.0, False, 0, None), (4, "a", "a", None, 0.0, 0.0, None, None, None, None)], kind)
    got = {(r["k"], r["metric"]): (r["value"], r["direction"]) for r in C.metric_values(rows, ["k"]).collect()}
    assert len(got) == 4 * len(C.METRICS)
    want = {
        (1, "em_all"): 1.0, (1, "sbert"): 0.4, (1, "contradiction"): 1.0, (1, "specificity_halluc"): 1.0, (1, "unsupported_specifics"): 3.0, (1, "records_with_pred_specifics"): 1.0, (1, "rougeL"): None,
        (2, "em_all"): 0.0, (2, "sbert"): None, (2, "contradiction"): None, (2, "records_with_pred_specifics"): 0.0, (3, "em_all"): 1.0, (3, "sbert"): 0.7, (3, "contradiction"): 1.0, (4, "sbert"): 0.0, (4, "contradiction"): 0.0,
    }
    assert {k: got[k][0] for k in want} == want
    assert {m: d for (_, m), (_, d) in got.items()} == {m: "higher" if m in C.HIGHER else "lower" if m in C.LOWER else "unknown" for m in C.METRICS}
    other = C.metric_values(rows.withColumn("has_specificity_hallucination", F.lit(False)), ["k"])
    sides = [df.withColumn("record_type", F.lit("qa")) for df in (C.metric_values(rows, ["k"]), other)]
    d = {(r["split"], r["metric"]): r for r in E.paired_delta(E.paired(*sides, key="k")).collect()}
    assert d["overall", "specificity_halluc"]["direction"] == "lower" and d["overall", "specificity_halluc"]["favors_target"]
    ci = {(r["split"], r["metric"]): r for r in E.bootstrap_ci(E.paired(*sides, key="k"), 50).collect()}
    assert ci["qa", "specificity_halluc"]["favors_target"] and {"baseline_mean", "target_mean", "ci_low"} <= set(ci["qa", "specificity_halluc"].asDict())


def test_rows_that_count(spark):
    turn = lambda who, text: {"from": who, "value": text}
    rows = [(1, "a", " im ", [turn("human", "<image> q"), turn("gpt", " a "), turn("human", "q2"), turn("gpt", "b")]), (2, "b_qa", "im", [turn("human", "q")]), (3, None, " ", [turn("human", "q"), turn("gpt", "a")]), (4, None, "im", [turn("gpt", "a"), turn("human", "q"), turn("gpt", " ")]), (5, "c_QA1", "im", [turn("human", "q"), turn("gpt", "a")]), (6, None, "im", None)]
    records = spark.createDataFrame(rows, f"position int, id string, image string, conversations {TURNS}")
    assert [tuple(r) for r in C.single_turns(records).orderBy("index").collect()] == [(1, "a", "im", "caption", "q2", "b"), (5, "c_QA1", "im", "qa", "q", "a")]
    assert [tuple(r) for r in C.reference_rows(records).orderBy("answer", "id").collect()] == [("a", "im", "q", "a", "caption"), ("c_QA1", "im", "q", "a", "qa"), (None, "im", "a", "q", "caption")]
    texts = [(1, json.dumps([turn(" human ", "q"), turn("", "x"), turn("gpt", "")])), (2, json.dumps([turn("human", "see <image>"), turn("gpt", "a")])), (3, "[]"), (4, None), (5, "no json")]
    docs = spark.createDataFrame(texts, "k int, c string")
    good, bad = C.quarantined(docs, "c", as_json=True)
    assert {r["k"]: [tuple(x) for x in r["c"]] for r in good.collect()} == {1: [("human", "<image>\nq")], 2: [("human", "see <image>"), ("gpt", "a")]}
    assert {r["k"] for r in bad.collect()} == {3, 4, 5}
    with pytest.raises(Exception, match="no valid conversation"):
        docs.where("k = 3").select(C.plain_conversations(F.col("c"), as_json=True)).collect()


def test_source_order(spark):
    rnd = random.Random(1)
    rows = [(rnd.randrange(50), f"r{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "pos int, r string").repartition(5)
    got = sorted((r["index"], r["pos"]) for r in C.numbered(df, "pos", start=1, parts=8).collect())
    assert [k for k, _ in got] == list(range(1, 301)) and [p for _, p in got] == sorted(p for p, _ in rows)
    assert C.numbered(df.limit(0), "pos").count() == 0 and C.first_rows(df, "pos", None).count() == 300 and C.first_rows(df, "pos", -1).count() == 0
    many = spark.createDataFrame([(3, ["c", "d"]), (1, ["a"]), (2, None)], "pos int, report array<string>")
    assert [tuple(r) for r in C.capped_pairs(many, "pos", "x", "report", 2).orderBy("row_id").collect()] == [(0, "x_0", "a"), (1, "x_1", "")]
    with pytest.raises(KeyError, match="text"):
        C.capped_pairs(many, "pos", "x", "text")
    assert [r["id"] for r in D.exact_sample(spark.range(100), "id", 9).collect()] == sorted(r["id"] for r in D.exact_sample(spark.range(100), "id", 9).collect())


def test_labels(spark):
    df = spark.range(1)
    assert list(C.by_label([("a", df), ("b", df)])) == ["a", "b"]
    with pytest.raises(ValueError, match="'a'"):
        C.by_label([("a", df), ("b", df), ("a", df)])
    assert [C.parse_spec(s) for s in ("x=p/q.jsonl", "p/q=1.jsonl", "p.jsonl")] == [("x", "p/q.jsonl"), ("p/q", "1.jsonl"), (None, "p.jsonl")]
    assert C.parse_comparisons(["a:b", "c,d"], [], []) == [("a", "b"), ("c", "d")] and C.parse_comparisons(None, ["a", "b"], [("a", "b"), ("a", "c")]) == [("a", "b")]
    with pytest.raises(ValueError, match="TARGET:BASELINE"):
        C.parse_comparisons(["a"], [], [])
    assert readers.label_of("m.per_sample.jsonl") == "m" and readers.label_of("run7/x.jsonl") == "run7"
    ids = lambda *xs: spark.createDataFrame([(x,) for x in xs], "k int")
    assert {r["k"] for r in C.common_keys({"a": ids(1, 2, 2), "b": ids(2, 3), "c": ids(2, 1)}, "k").collect()} == {2}


def test_reports(spark):
    rows = spark.createDataFrame([(1, "i", "qa", "im", "generation_error", "a|b"), (2, "j", "qa", None, "missing_prediction", None)], "`index` int, id string, record_type string, image string, reason string, error string")
    page = P.skip_report("m", 5, 3, E.reason_counts(rows), rows)
    assert "2 of 5 rows have no score." in page and "| generation_error | 1 |" in page and "a\\|b" in page
    sheet = spark.createDataFrame([("judge_0001", "a"), ("judge_0001", "b")], "sample_id string, model_label string")
    told = P.rubric(sheet, {"x": "y"})
    assert "1 records, each answered by 2 systems: a, b." in told and "| x | y |" in told and "None." in P.rubric(sheet, {})


def test_stored_index(spark, tmp_path):
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(30)]
    corpus = spark.createDataFrame([(i, " ".join(rnd.choices(words, k=rnd.randrange(1, 20)))) for i in range(60)] + [(60, None), (61, "")], "row_id long, report string")
    asked = spark.createDataFrame([(i, " ".join(rnd.choices([*words, "none"], k=4))) for i in range(9)], "query_id long, text string")
    vectors = spark.createDataFrame([(0, [1.0, 2.0])], "row_id long, vec array<double>")
    sinks.write_index(corpus, vectors, str(tmp_path), visual=vectors.select("row_id", F.array(F.lit(3.0)).alias("vec")))
    index = readers.bm25_index(spark, str(tmp_path))
    rows = lambda df: sorted((r["query_id"], r["rank"], r["row_id"], round(r["score"], 9)) for r in df.collect())
    want = rows(R.bm25_topk(corpus, asked, 5))
    assert rows(R.bm25_topk(corpus, asked, 5, index)) == want and len(want) == 45
    assert readers.vectors(spark, str(tmp_path), "visual").first()["vec"] == [3.0] and readers.pair_store(spark, str(tmp_path)).count() == 62
    one = asked.where("query_id = 1")
    assert rows(A.retrieve("sparse_bm25", one, A.Index(corpus, terms=index), 5)) == [r for r in want if r[0] == 1]
    with pytest.raises(ValueError, match="empty"):
        sinks.write_index(corpus.limit(0), None, str(tmp_path / "x"))


def test_negative_idf(spark):
    """All terms in nearly all documents: matches score below zero, and ids without a match go first."""
    rows = [(i, "a b") for i in range(40)] + [(i, "c d") for i in range(40, 43)]
    corpus = spark.createDataFrame(rows, "row_id long, report string")
    counts, n = Counter(w for _, t in rows for w in set(t.split())), len(rows)
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in counts.items()}
    some = {"b": raw["b"], "a": raw["a"]}
    assert sum(some.values()) < 0
    top = R.bm25_topk(corpus, spark.createDataFrame([(1, "a")], "query_id long, text string"), 3)
    negative = dataclasses.replace(R.corpus_index(corpus), mean_idf=-1.0)
    top = R.bm25_topk(corpus, spark.createDataFrame([(1, "a")], "query_id long, text string"), 3, negative)
    assert [(r["row_id"], r["score"]) for r in top.orderBy("rank").collect()] == [(40, 0.0), (41, 0.0), (42, 0.0)]


def test_early_persistence(spark, tmp_path):
    base = spark.createDataFrame([(1, 2.0)], "k int, v double")
    with warnings.catch_warnings(record=True):
        warnings.simplefilter("always")
        failed = sinks.write_early(base, str(tmp_path / "m"), "k", {"nli": lambda df: df.select("k", F.raise_error(F.lit("no model")).alias("nli")), "sbert": lambda df: df.select("k", (F.col("v") * 2).alias("sbert"))})
    assert list(failed) == ["nli"]
    assert spark.read.parquet(str(tmp_path / "m/base")).count() == 1 and spark.read.parquet(str(tmp_path / "m/sbert")).first()["sbert"] == 4.0
    sinks.write_document(base, str(tmp_path / "d.json"))
    sinks.write_document(base, str(tmp_path / "d.json"))
    assert json.loads((tmp_path / "d.json").read_text()) == [{"k": 1, "v": 2.0}]
    with pytest.raises(ValueError, match="exclude"):
        sinks.append_new(base, base, "k", str(tmp_path / "o"), overwrite=True)


def test_strict_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "response": "r"}\n\n{"id": "2"}\n')
    (tmp_path / "b.jsonl").write_text('{"id": "1"}\n{bad one\n')
    assert readers.json_lines(spark, str(tmp_path / "a.jsonl")).count() == 2
    for f in (lambda df: df.collect(), lambda df: df.count()):
        with pytest.raises(Exception, match=r"b\.jsonl.*bad one"):
            f(readers.json_lines(spark, str(tmp_path / "b.jsonl")))


def test_overlap_is_a_multiset(spark):
    rnd = random.Random(3)
    rows = [([rnd.choice("abcd") for _ in range(rnd.randrange(12))], [rnd.choice("abce") for _ in range(rnd.randrange(12))]) for _ in range(60)] + [([], []), (["", "a"], ["", ""])]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>").select("a", "b", T.overlap(F.col("a"), F.col("b")).alias("n"))
    assert all(r["n"] == sum((Counter(r["a"]) & Counter(r["b"])).values()) for r in df.collect())
    long = spark.createDataFrame([("w " * 20_000 + "x", "w " * 15_000 + "y")], "p string, g string")
    assert long.select(T.token_f1(F.col("p"), F.col("g")).alias("f")).first()["f"] == pytest.approx(2 * 15_000 / 35_002)


def test_miners_on_scored_rows(spark):
    rows = [(f"q{i}", f"NGC {i} seen by Hubble in 1999", f"the galaxy NGC {i} as Hubble saw it in 1999") for i in range(6)]
    base = spark.createDataFrame(rows, "unique_key string, prediction string, answer string")
    worse = base.withColumn("prediction", F.lit("a star called M 31 with z = 0.5"))
    a, b = (E.scored(df).withColumn("sbert", F.lit(None).cast("double")).withColumn("contradiction", F.lit(None).cast("double")) for df in (base, worse))
    for miner in (M.improvements, M.better_supported, M.baseline_failures):
        assert miner(a, b, 10).count() == 6
    assert M.safer_baselines(b, a, 10).count() == 6 and M.safer_baselines(a, b, 10).count() == 0
    assert M.hallucinations(b.withColumn("pos", F.monotonically_increasing_id()), 3).count() == 3
    four = a.select(F.col("rougeL") * 10_000 - F.round(F.col("rougeL") * 10_000)).first()[0]
    assert abs(four) < 1e-6 and tuple(E.scored_counts(base.withColumn("answer", F.when(F.col("unique_key") > "q3", F.col("answer")))).first()) == (6, 2, 4)


def test_places_for_models(spark):
    rows = spark.createDataFrame([("q", "pp", "aa")], "prompt string, prediction string, answer string")
    named = X.nli(rows, lambda: lambda p, h: [{"CONTRADICTION": 0.1 * len(p[0]), "Entailment": 0.5, "neutral": 0.3}] * len(p), max_chars=1).first()
    assert named["nli"] == pytest.approx(0.4) and set(named.asDict()) == {"prompt", "prediction", "answer", "nli"}
    images = spark.createDataFrame([(1, b"xx")], "k int, rgb binary")
    assert X.embed_images(images, lambda: lambda pics: [[[3.0, 0.0], [3.0, 8.0]]] * len(pics)).first()["vec"] == pytest.approx([0.6, 0.8])
    assert spark.range(1).select(R.mean_pooled(F.array().cast("array<array<double>>")).alias("v")).first()["v"] is None


def test_a_mode_of_the_callers_own(spark):
    index = A.Index(spark.createDataFrame([(0, "x")], "row_id long, report string"))
    asked = spark.createDataFrame([(7, "q")], "query_id long, text string")
    A.register("first_row", lambda questions, index, k: questions.select("query_id", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("row_id"), F.lit(1.0).alias("score")))
    try:
        assert A.retrieve("first_row", asked, index, 1).first()["row_id"] == 0
        with pytest.raises(ValueError, match="already"):
            A.register("first_row", None)
    finally:
        del A.RETRIEVERS["first_row"]


def test_images_beside_masks(spark):
    rows = spark.createDataFrame([(1, [5, 9, 6], [-100, 9, 6], [1, 1, 1]), (2, [5, 6], [5, 6], [1, 1])], "k int, ids array<bigint>, labels array<bigint>, attention_mask array<bigint>")
    got = {r["k"]: (r["ids"], r["labels"], r["attention_mask"]) for r in D.expanded_images(rows, 9, 3).collect()}
    assert got == {1: ([5, 9, 9, 9, 6], [-100, -100, -100, -100, 6], [1] * 5), 2: ([5, 6], [5, 6], [1, 1])}


def test_benchmarks(spark, tmp_path):
    spark.range(6).select(F.col("id").alias("vec_id"), (F.col("id") % 10).cast("int").alias("label")).write.parquet(str(tmp_path / "e"))
    got = readers.open_benchmark(spark, "class_questions", str(tmp_path / "e"), num_samples=3, position="vec_id").orderBy("position").collect()
    assert [(r["position"], r["answer"]) for r in got] == [(0, "Disturbed Galaxies"), (1, "yes"), (2, "Round Smooth Galaxies")]
    with pytest.raises(ValueError, match="class_questions"):
        readers.open_benchmark(spark, "other")
    with pytest.raises(ValueError, match="already"):
        readers.register_benchmark("class_questions", readers.class_questions)
