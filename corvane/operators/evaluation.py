"""Scoring of predictions, aggregation by split, paired comparison and audits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from corvane.functions import text as T
from corvane.operators.records import common_keys, metric_direction


def lcs_length(a: list[str], b: list[str]) -> int:
    """Longest common subsequence, by bit-parallel rows: one big integer for each word of b."""
    where: dict[str, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | (1 << i)
    rows = 0
    for w in b:
        x = rows | where.get(w, 0)
        rows = x & ~(x - ((rows << 1) | 1))
    return rows.bit_count()


@F.pandas_udf(DoubleType())
def rouge_l(prediction: pd.Series, gold: pd.Series) -> pd.Series:
    """ROUGE-L F1 on lower-cased words; 0 if either side is empty."""
    out = []
    for p, g in zip(prediction.fillna(""), gold.fillna(""), strict=True):
        a, b = p.lower().split(), g.lower().split()
        n = lcs_length(a, b) if a and b else 0
        out.append(2 * n / (len(a) + len(b)) if n else 0.0)
    return pd.Series(out, dtype=float)


def scored(rows: DataFrame) -> DataFrame:
    """Adds token_f1, rougeL (both to four places), em, answer_type and the specifics columns to rows
    (prediction, answer, ...); rows without either side are left out."""
    both = (F.coalesce("prediction", F.lit("")) != "") & (F.coalesce("answer", F.lit("")) != "")
    p, a = F.col("prediction"), F.col("answer")

    def compared(x: Column) -> Column:
        extra = F.array_sort(F.array_except(x["p"], x["a"]))
        return F.struct(x["p"].alias("pred_specifics"), x["a"].alias("answer_specifics"), extra.alias("unsupported_specifics"))

    # Each text's specifics are computed once for each row, however often they are used.
    told = F.transform(F.array(F.struct(T.specifics(p).alias("p"), T.specifics(a).alias("a"))), compared)
    new = [F.round(T.token_f1(p, a), 4).alias("token_f1"), F.round(rouge_l(p, a), 4).alias("rougeL"), T.exact_match(p, a).alias("em"), T.answer_type(a, True).alias("answer_type")]
    return rows.where(both).select("*", *new, F.inline(told)).select("*", F.size("unsupported_specifics").alias("unsupported_specific_count"), (F.size("unsupported_specifics") > 0).alias("has_specificity_hallucination"))


def scored_counts(rows: DataFrame) -> DataFrame:
    """(num_rows, num_scored, num_skipped): rows with both sides, and the others."""
    both = (F.coalesce("prediction", F.lit("")) != "") & (F.coalesce("answer", F.lit("")) != "")
    return rows.agg(F.count(F.lit(1)).alias("num_rows"), F.count_if(both).alias("num_scored"), F.count_if(~both).alias("num_skipped"))


def basic_summary(rows: DataFrame, split: str = "record_type") -> DataFrame:
    """The means of scored rows to four places, overall and by split: lexical, exact match, specificity, and
    the cosine where there is one (overall of its own values, by split of values to four places)."""
    four = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 4)
    closed, open_ = F.col("answer_type") == "closed", F.col("answer_type") == "open"
    cosine = F.col("sbert_cos") if "sbert_cos" in rows.columns else F.lit(None).cast("double")
    named = rows.withColumn("__cos", cosine.cast("double")).withColumn("__split", F.col(split))
    got = named.groupingSets([[], ["__split"]], "__split").agg(
        F.grouping("__split").alias("whole"), F.count(F.lit(1)).alias("n"),
        four(F.avg(F.round("rougeL", 4))).alias("rougeL_f1"), four(F.avg(F.round("token_f1", 4))).alias("token_f1"),
        F.round(share(F.col("em")), 4).alias("em_all"), F.round(share(F.col("em"), closed), 4).alias("em_closed"), F.round(share(F.col("em"), open_), 4).alias("em_open"),
        F.round(share(F.col("has_specificity_hallucination")), 4).alias("specificity_hallucination_rate"), four(F.avg("unsupported_specific_count")).alias("unsupported_specifics_per_record"),
        F.count_if(F.size("pred_specifics") > 0).alias("records_with_pred_specifics"), F.avg("__cos").alias("cos"), F.avg(F.round("__cos", 4)).alias("cos4"),
    )
    label = F.when(F.col("whole") == 1, "overall").otherwise(F.col("__split"))
    semantic = F.round(F.when(F.col("whole") == 1, F.col("cos")).otherwise(F.col("cos4")), 4).alias("sbert_cosine")
    return got.where("whole = 1 or __split in ('caption', 'qa')").select(label.alias("split"), *[c for c in got.columns if c not in ("whole", "cos", "cos4", "__split")], semantic)


def share(condition: Column, among: Column | None = None) -> Column:
    """Mean of a condition; 0 for no rows."""
    value = F.when(among, condition.cast("double")) if among is not None else condition.cast("double")
    return F.coalesce(F.avg(value), F.lit(0.0))


def em_summary(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    closed, open_ = F.col("answer_type") == "closed", F.col("answer_type") == "open"
    return rows.groupBy(*by).agg(
        share(F.col("em")).alias("em_all"), share(F.col("em"), closed).alias("em_closed"), share(F.col("em"), open_).alias("em_open"),
        F.count(F.lit(1)).alias("n"), F.count_if(closed).alias("n_closed"), F.count_if(open_).alias("n_open"),
    )


def split_summary(rows: DataFrame, metrics: dict[str, Column], split: str = "record_type") -> DataFrame:
    """Means overall and for each split that occurs, in one pass by grouping sets."""
    named = rows.select(F.col(split).alias("split"), *[c.cast("double").alias(k) for k, c in metrics.items()])
    means = [F.avg(k).alias(k) for k in metrics]
    got = named.groupingSets([[], ["split"]], "split").agg(F.grouping("split").alias("whole"), F.count(F.lit(1)).alias("n"), *means)
    label = F.when(F.col("whole") == 1, "overall").otherwise(F.col("split"))
    return got.where("whole = 1 or split in ('caption', 'qa')").select(label.alias("split"), "n", *metrics)


def key_digest(key: Column) -> Column:
    """128 bits of a key of texts, each with its length before it, so that no two keys of different texts are written alike; null for null."""
    part = lambda x: F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-"))
    return F.unhex(F.md5(F.array_join(F.transform(key, part), "")))


def occurrence_keys(rows: DataFrame, key: str = "row_key", position: str = "pos", ranges: int = 64) -> DataFrame:
    """The n-th row of a key gets ("dup", n) behind it, from the second on; nth counts in the order of a numeric position.

    Rows are numbered by two levels: within a key's rows of one range of positions, behind its
    rows in the ranges before. So the rows of a hot key are dealt over ``ranges`` tasks, and
    keys are shuffled as digests; their texts stay with their rows. A null key is one key.
    Rows of one position are numbered in any order."""
    at = F.col(position).cast("double")
    cuts = rows.agg(F.percentile_approx(at, [i / ranges for i in range(1, ranges)]).alias("c")).first()["c"] or []
    where = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c < at)) if cuts else F.lit(0)
    placed = rows.withColumn("__key", key_digest(F.col(key))).withColumn("__range", F.coalesce(where, F.lit(-1)))
    sizes = placed.groupBy("__key", "__range").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("__key").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range
    more = sizes.withColumn("__before", F.coalesce(before, F.lit(0))).where("__before > 0").select(F.col("__key").alias("__k"), F.col("__range").alias("__r"), "__before")
    within = F.row_number().over(Window.partitionBy("__key", "__range").orderBy(position))
    own = placed.withColumn("__within", within)
    joined = own.join(more, F.col("__key").eqNullSafe(F.col("__k")) & (F.col("__range") == F.col("__r")), "left")
    numbered = joined.withColumn("nth", (F.col("__within") + F.coalesce("__before", F.lit(0))).cast("int")).drop("__key", "__range", "__within", "__k", "__r", "__before")
    return numbered.withColumn("unique_key", F.when(F.col("nth") == 1, F.col(key)).otherwise(F.concat(F.col(key), F.array(F.lit("dup"), F.col("nth").cast("string")))))


def paired(a: DataFrame, b: DataFrame, key: str = "unique_key") -> DataFrame:
    """Inner join of two systems' long metric rows (key, record_type, metric, value), by the keys' digests; where nothing asks for the keys, only digests are shuffled."""
    join_key = key_digest(F.col(key)) if dict(a.dtypes)[key].startswith("array") else F.unhex(F.md5(F.col(key).cast("string")))
    left = a.where("value is not null").select(join_key.alias("key_digest"), key, "metric", F.col("record_type").alias("type_a"), F.col("value").alias("baseline"))
    right = b.where("value is not null").select(join_key.alias("key_digest"), "metric", F.col("record_type").alias("type_b"), F.col("value").alias("target"))
    return left.join(right, ["key_digest", "metric"])


def by_split(pairs: DataFrame) -> DataFrame:
    """Each pair counts overall, and in a split if both sides are of it."""
    both = F.when(F.col("type_a") == F.col("type_b"), F.array(F.lit("overall"), F.col("type_a"))).otherwise(F.array(F.lit("overall")))
    return pairs.withColumn("split", F.explode(both))


def paired_delta(pairs: DataFrame) -> DataFrame:
    direction = metric_direction(F.col("metric"))
    got = by_split(pairs).groupBy("split", "metric").agg(F.count(F.lit(1)).alias("n"), F.avg("baseline").alias("baseline_mean"), F.avg("target").alias("target_mean"), F.avg(F.col("target") - F.col("baseline")).alias("diff"))
    better = F.when(direction == "higher", F.col("diff") > 0).when(direction == "lower", F.col("diff") < 0)
    return got.select("*", direction.alias("direction"), F.coalesce(better, F.lit(False)).alias("favors_target"))


#: P(X <= n) of X Poisson with mean 1, for n = 0, 1, ..., 7; what is above is 8.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253)


#: Factors of the draws, one for each round of mixing.
FACTORS = (48_271, 1_583_458_089, 784_588_716)
PRIME = 2**31 - 1


def with_draws(rows: DataFrame, seed: int) -> DataFrame:
    """Adds w to rows (block, resample): how often the resample takes the block, Poisson with mean 1.

    A draw is a counter's value, in integers that any engine can repeat: block and resample are
    mixed by multiplications modulo the prime 2 ** 31 - 1, with shifts between them."""
    made = rows.withColumn("__m", (F.col("block") * 1_103_515_245 + F.col("resample") * 1_664_525 + F.lit(seed * 69_069 + 12_345).cast("long")) % PRIME)
    for factor in FACTORS:
        made = made.withColumn("__m", F.col("__m").bitwiseXOR(F.shiftright("__m", 15)) % PRIME * factor % PRIME)
    out = F.lit(8)
    for n, p in reversed(list(enumerate(POISSON))):
        out = F.when(F.col("__m") < int(p * PRIME), n).otherwise(out)
    return made.withColumn("w", out).drop("__m")


def bootstrap_ci(pairs: DataFrame, resamples: int = 10_000, level: float = 0.95, seed: int = 42, blocks: int = 500) -> DataFrame:
    """Percentile intervals of the mean difference by paired resampling, in blocks of rows.

    Rows are dealt to ``blocks`` blocks by the digest of their key, whatever the size of a
    group (split and metric), and summed there, before any shuffle. A resample takes each block
    a Poisson number of times and is the mean of what it took; with few rows nearly every row
    is a block of its own, with many the variance of the blocks' sums stands for that of the
    rows. Draws are hashes of block and resample: no generator, no state, the same on any
    number of tasks. A task holds some resamples of a group, and the groups' sums are at most
    ``blocks`` rows each."""
    rows = by_split(pairs).select("split", "metric", F.pmod(F.conv(F.hex(F.substring("key_digest", 1, 4)), 16, 10).cast("long"), F.lit(blocks)).alias("block"), (F.col("target") - F.col("baseline")).alias("diff"))
    sums = rows.groupBy("split", "metric", "block").agg(F.count(F.lit(1)).alias("n"), F.sum("diff").alias("total"))
    each = sums.repartition("split", "metric", "block").withColumn("resample", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(resamples - 1).cast("long"))))
    taken = with_draws(each, seed).where("w > 0")
    means = taken.groupBy("split", "metric", "resample").agg((F.sum(F.col("w") * F.col("total")) / F.sum(F.col("w") * F.col("n"))).alias("mean"))
    ends = [F.percentile("mean", F.lit(x)).alias(name) for x, name in (((1 - level) / 2, "ci_low"), ((1 + level) / 2, "ci_high"))]
    found = means.groupBy("split", "metric").agg(*ends)
    out = paired_delta(pairs).join(F.broadcast(found), ["split", "metric"])  # a row for each split and metric
    return out.withColumn("ci_excludes_zero", (F.col("ci_low") > 0) | (F.col("ci_high") < 0))


def skipped(predictions: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Predictions whose key was never scored, with the reasons."""
    filled = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    rows = predictions.join(done.select(key).distinct(), key, "left_anti")
    reasons = [("generation_error", filled(F.col("error"))), ("missing_prediction", ~filled(F.col("prediction"))), ("missing_reference", ~filled(F.col("answer")))]
    return rows.withColumn("reason", T.joined_reasons(reasons, "not_in_scored_per_sample"))


def reason_counts(rows: DataFrame) -> DataFrame:
    """How often each reason occurs; most frequent first, then by name."""
    one = rows.select(F.explode(F.split("reason", ";")).alias("reason"))
    return one.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason")


def mode_comparison(modes: dict[str, DataFrame]) -> DataFrame:
    """One row for each mode: exact-match shares of its rows (em, answer_type), and nli means where they are there."""
    out = None
    for mode, rows in modes.items():
        kept = rows.select("em", "answer_type", (F.col("nli") if "nli" in rows.columns else F.lit(None)).cast("double").alias("nli"), F.lit(mode).alias("mode"))
        out = kept if out is None else out.unionByName(kept)
    contradicts = F.avg((F.col("nli") < 0).cast("double")).alias("contradiction_rate")
    more = out.groupBy("mode").agg(F.avg("nli").alias("nli_consistency"), contradicts)
    return em_summary(out, ["mode"]).join(F.broadcast(more), "mode")


def in_all(samples: DataFrame, systems: dict[str, DataFrame], key: str) -> DataFrame:
    """The samples that every system has; to be taken before a quota is drawn from them."""
    return samples.join(common_keys(systems, key), key, "left_semi")


def judge_sheet(samples: DataFrame, systems: dict[str, DataFrame], key: str, order: Column) -> DataFrame:
    """A row for each system and each sample that all have, with numbered samples and systems, ready for a judge's marks."""
    samples = in_all(samples, systems, key)
    number = F.row_number().over(Window.orderBy(order, key))  # a sample: as many rows as a judge reads
    named = samples.withColumn("sample_id", F.format_string("judge_%04d", number))
    out = None
    for i, (label, rows) in enumerate(sorted(systems.items()), 1):
        own = named.join(rows.select(key, "prediction"), key).select("*", F.lit(f"model_{i}").alias("model_slot"), F.lit(label).alias("model_label"))
        out = own if out is None else out.unionByName(own)
    return out


def reference_cascade(rows: DataFrame, references: DataFrame) -> DataFrame:
    """References for rows (image, prompt): by image and prompt, else the image's caption if the
    prompt asks for one, else the image's only record. Of equal keys the last reference wins."""
    ref = references.withColumn("key", T.prompt_key(F.col("prompt")))
    last = F.max_by("answer", "pos").alias
    exact = ref.groupBy("image", "key").agg(last("exact"))
    caption = ref.where(F.col("record_type") == "caption").groupBy("image").agg(last("caption"))
    only = ref.groupBy("image").agg(F.count(F.lit(1)).alias("n"), last("only")).where("n = 1").drop("n")
    asks = T.prompt_key(F.col("prompt")).isin(*T.CAPTION_PROMPTS)
    joined = rows.withColumn("key", T.prompt_key(F.col("prompt"))).join(exact, ["image", "key"], "left").join(caption, "image", "left").join(only, "image", "left")
    return joined.withColumn("reference", F.coalesce("exact", F.when(asks, F.col("caption")), "only")).drop("key", "exact", "caption", "only")


def mine(pairs: DataFrame, where: Column, score: Column, n: int, tie: str) -> DataFrame:
    return pairs.where(where).withColumn("mine_score", score).orderBy(F.desc(F.round("mine_score", 9)), tie).limit(n)


def curve_summary(log: DataFrame) -> DataFrame:
    """First, last and least loss with its step, and the mean throughput of a training log."""
    return log.agg(F.min_by("loss", "step").alias("first_loss"), F.max_by("loss", "step").alias("last_loss"), F.min("loss").alias("min_loss"), F.min(F.struct("loss", "step"))["step"].alias("min_step"), F.avg("samples_per_sec").alias("mean_samples_per_sec"))


def weighted_loss(rows: DataFrame, by: list[str]) -> DataFrame:
    """Token-weighted mean loss; NaN where there are no tokens."""
    ok = rows.where("tokens > 0 or tokens = 0")
    return ok.groupBy(*by).agg(F.coalesce(F.try_divide(F.sum(F.col("loss") * F.col("tokens")), F.sum("tokens").cast("double")), F.lit(float("nan"))).alias("mean_loss"), F.sum("tokens").alias("tokens"))
