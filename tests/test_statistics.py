"""Exact samples by thresholds, keys by digests, counter-based draws, specifics in one pass, and question parts."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import ablation as A
from corvane.operators import datasets as D
from corvane.operators import evaluation as E


def hashed(i):
    return hashlib.md5(f"42:{i}".encode()).hexdigest()


def plan_of(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("few,digits", [(10_000, 3), (4, 1), (0, 2)])
def test_exact_samples(spark, monkeypatch, few, digits):
    monkeypatch.setattr(D, "FEW", few)
    monkeypatch.setattr(D, "DIGITS", digits)
    ids = [*range(400), *[7] * 30, None]
    rows = [(i, "ab"[i % 3 > 0] if i is not None else "a", k) for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "id long, s string, k int").repartition(5)
    order = sorted((i for i in ids if i is not None), key=lambda i: (hashed(i), i))
    for n in (1, 17, 250, 430, 999):
        got = [r["id"] for r in D.exact_sample(df, "id", n).collect()]
        assert got == sorted(order[:n])
    for n, first in ((60, "a"), (300, "a"), (999, "b"), (1, "a")):
        have = {s: sum(r[0] is not None and r[1] == s for r in rows) for s in "ab"}
        have["a"] += 1  # the row without an id counts for the quota, but is not drawn
        other = {"a": "b", "b": "a"}[first]
        quota = min(have[other], n - min(have[first], n // 2))
        want = Counter()
        for s, m in ((first, min(have[first], n - quota)), (other, quota)):
            want += Counter(sorted((i for i, t, _ in rows if i is not None and t == s), key=lambda i: (hashed(i), i))[:m])
        assert Counter(r["id"] for r in D.stratified_sample(df, "id", "s", first, n).collect()) == want
    assert "Window" not in plan_of(D.stratified_sample(df, "id", "s", "a", 60))
    assert D.stratified_sample(df.limit(0), "id", "s", "a", 5).count() == 0


@pytest.mark.parametrize("ranges", [64, 2, 1])
def test_hot_keys_are_numbered_by_ranges(spark, ranges):
    rnd = random.Random(ranges)
    rows = [(i, rnd.choice([["hot"], ["hot"], ["a", "b"], ["ab"], ["a", None], ["-"], [], None])) for i in rnd.sample(range(-500, 5000), 600)]
    got = E.occurrence_keys(spark.createDataFrame(rows, "pos long, row_key array<string>").repartition(4), ranges=ranges).collect()
    count, want = defaultdict(int), {}
    for i, k in sorted(rows, key=lambda r: r[0]):
        count[str(k)] += 1
        want[i] = (count[str(k)], k if count[str(k)] == 1 or k is None else [*k, "dup", str(count[str(k)])])
    assert {r["pos"]: (r["nth"], r["unique_key"]) for r in got} == want


def test_pairs_meet_by_digest(spark):
    rows = [(k, "qa", "rougeL", float(i)) for i, k in enumerate((["a", "b"], ["ab"], ["1:a"], ["a", None], [None, "a"], ["", "x"], ["x", ""], ["x" * 5000]))]
    one = spark.createDataFrame(rows, "unique_key array<string>, record_type string, metric string, value double")
    got = E.paired(one, one.withColumn("value", F.col("value") * 10))
    assert sorted((r["baseline"], r["target"]) for r in got.collect()) == [(float(i), 10.0 * i) for i in range(8)]
    assert sorted(map(str, (r["unique_key"] for r in got.collect()))) == sorted(str(k) for k, *_ in rows)
    below = E.paired_delta(got)._jdf.queryExecution().executedPlan().toString().split("Join", 1)[1]
    scans = [x for x in below.splitlines() if "Exchange hashpartitioning" in x]
    assert scans and all("unique_key" not in x for x in scans)


def test_draws_are_poisson_and_independent(spark):
    rows = spark.range(300).select(F.col("id").alias("block")).crossJoin(spark.range(400).select(F.col("id").alias("resample")))
    got = E.with_draws(rows, 42).toPandas()
    w = got.pivot(index="block", columns="resample", values="w").to_numpy().astype(float)
    assert w.mean() == pytest.approx(1, abs=0.02) and w.var() == pytest.approx(1, abs=0.04)
    assert [float((w == n).mean()) for n in range(4)] == pytest.approx([0.3679, 0.3679, 0.1839, 0.0613], abs=0.01)
    for x in (w, w.T):
        z = np.corrcoef(x)[~np.eye(len(x), dtype=bool)]
        assert abs(z.mean()) < 0.01 and np.abs(z).max() < 0.4 and z.std() == pytest.approx(1 / x.shape[1] ** 0.5, rel=0.1)
    other = E.with_draws(rows, 43).toPandas()["w"].to_numpy()
    assert abs(np.corrcoef(got["w"].to_numpy(), other)[0, 1]) < 0.02


def test_intervals_cover(spark):
    """Of intervals of samples whose mean is known, about as many hold it as they should."""
    rnd, rows = np.random.default_rng(1), []
    for s in range(60):
        rows += [([str(s), str(i)], f"m{s}", float(x)) for i, x in enumerate(rnd.exponential(1.0, 250))]
    base = spark.createDataFrame(rows, "unique_key array<string>, metric string, value double").withColumn("record_type", F.lit("qa"))
    got = E.bootstrap_ci(E.paired(base.withColumn("value", F.lit(0.0)), base), 1000).where("split = 'overall'").collect()
    assert len(got) == 60 and 0.85 <= sum(r["ci_low"] <= 1.0 <= r["ci_high"] for r in got) / 60 <= 1.0
    width = np.mean([r["ci_high"] - r["ci_low"] for r in got])
    assert width == pytest.approx(2 * 1.96 / 250**0.5, rel=0.12)


def python_specifics(text):
    flags = lambda p: re.compile(p, re.ASCII)
    found = [m.group(0) for p in T.CATALOG_PATTERNS for m in flags(p).finditer(text.upper())]
    found += [m.group(0) for p in (T.MEASUREMENT_PATTERN, T.REDSHIFT_PATTERN, T.YEAR_PATTERN) for m in flags(p).finditer(text)]
    found += [n for n in T.INSTRUMENTS if flags(rf"\b{re.escape(n)}\b").search(text.lower())]
    return sorted({re.sub(T.SPECIFIC_PREFIX, r"\1", re.sub(r"\s+", " ", re.sub(r"\bmessier\s+", "m", x.strip().lower()))) for x in found})


def test_specifics_of_each_pattern_by_itself(spark):
    rnd = random.Random(4)
    bits = ["NGC", "ngc 12", "M", "m31", "Messier", "42", "1999", "2MASS", "GAIA", "SDSS NGC", "J12.3+4", "z =", "z~0.5", "0.5", "12", "kpc", "million", "light years", "light-years", "Hubble", "hst", "very large array", "very large telescope", "vla", "IC-", "SH2-", "SH", "5A", "wise", "wisea x", "pan-starrs", "panstarrs", "sloan digital sky survey", "12 kpc", "1610", "3.5 au", ",", "-", "k", "mag", "IC 7 kpc", "alma", "almanac", "x1999", "99 degrees"]
    texts = [rnd.choice([" ", "  ", "", " "]).join(rnd.choices(bits, k=rnd.randrange(1, 9))) for _ in range(1500)] + ["", "no digit, but GAIA MISSION and SDSS"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.specifics(F.col("t")).alias("s")).collect()
    assert {r["i"]: r["s"] for r in got} == {i: python_specifics(t) for i, t in enumerate(texts)}


def test_specifics_are_found_once_for_a_row(spark):
    rows = spark.createDataFrame([("NGC 1 in 1999", "M 31 in 1999"), ("", "x"), ("q", None)], "prediction string, answer string")
    got = E.scored(rows)
    assert [(r["pred_specifics"], r["answer_specifics"], r["unsupported_specifics"], r["unsupported_specific_count"], r["has_specificity_hallucination"]) for r in got.collect()] == [(["1999", "ngc1"], ["1999", "m31"], ["ngc1"], 1, True)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("light[-") == 2


def test_question_parts(spark):
    questions = spark.createDataFrame([(1, "What is it? A ring, or a disk.", "x"), (2, "", "x"), (3, None, "x"), (4, " , one", "x")], "query_id long, text string, part string")
    got = [(r["query_id"], r["part"], r["text"]) for r in A.decomposed(questions).orderBy("query_id", "part").collect()]
    assert got == [(1, 0, "What is it"), (1, 1, " A ring"), (1, 2, " or a disk"), (4, 0, " one")]

    @F.udtf(returnType="part int, text string", useArrow=False)
    class Words:
        def eval(self, text: str):
            yield from enumerate((text or "").split())

    assert A.decomposed(questions, Words).where("query_id = 1").count() == 8
    corpus = spark.createDataFrame([(0, "ring galaxy"), (1, "disk galaxy"), (2, "ring ring disk"), (3, "none")], "row_id long, report string")
    top = A.retrieve_parts(questions.where("query_id = 1"), A.Index(corpus), 2)
    assert {r["row_id"] for r in top.collect()} <= {0, 1, 2} and top.count() == 2


def test_judged_samples_are_in_all_systems(spark):
    make = lambda ids: spark.createDataFrame([(i, f"p{i}") for i in ids], "k long, prediction string")
    systems = {"a": make([1, 2, 3, 4]), "b": make([2, 3, 4, 5]), "c": make([4, 2, 9])}
    samples = spark.createDataFrame([(i,) for i in range(1, 6)], "k long")
    got = E.judge_sheet(samples, systems, "k", F.col("k")).collect()
    assert {(r["k"], r["sample_id"], r["model_label"]) for r in got} == {(k, s, m) for k, s in ((2, "judge_0001"), (4, "judge_0002")) for m in "abc"}
    assert {r["k"] for r in E.in_all(samples, systems, "k").collect()} == {2, 4}
