"""Examples worth a look, from two systems' scored rows: five filters, each with its own score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("token_f1", "rougeL", "sbert", "contradiction", "unsupported_specific_count")


def value(side: str, metric: str) -> Column:
    """A side's metric; what was not measured is 0."""
    return F.coalesce(F.col(f"{side}.{metric}").cast("double"), F.lit(0.0))


def gain(metric: str) -> Column:
    return value("a", metric) - value("b", metric)


def flagged(side: str) -> Column:
    return F.coalesce(F.col(f"{side}.has_specificity_hallucination").cast("double"), F.lit(0.0))


def supported_count(side: str) -> Column:
    """How many of the predicted specifics the answer has too."""
    both = F.array_intersect(F.col(f"{side}.pred_specifics"), F.col(f"{side}.answer_specifics"))
    return F.when(both.isNull(), 0).otherwise(F.size(both)).cast("double")


def beside(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of both systems under one key, as structs a and b."""
    pack = lambda df, name: df.select(key, F.struct(*[c for c in df.columns if c != key]).alias(name))
    return pack(a, "a").join(pack(b, "b"), key)


def best(rows: DataFrame, keep: Column, score: Column, n: int, tie: str) -> DataFrame:
    return rows.where(keep).withColumn("mine_score", score).orderBy(F.desc(F.round("mine_score", 9)), tie).limit(n)


def improvements(a: DataFrame, b: DataFrame, n: int, key: str = "unique_key") -> DataFrame:
    """Where a has more overlap than b, or drops a hallucination."""
    dropped, fewer = flagged("b") - flagged("a"), -gain("unsupported_specific_count")
    keep = (gain("token_f1") > 0) | (gain("rougeL") > 0) | (dropped > 0)
    return best(beside(a, b, key), keep, gain("token_f1") + gain("rougeL") + 0.25 * dropped + 0.05 * fewer, n, key)


def better_supported(a: DataFrame, b: DataFrame, n: int, key: str = "unique_key") -> DataFrame:
    """Where the answer has specifics and a meets more of them than b, or has more overlap."""
    more = supported_count("a") - supported_count("b")
    keep = (F.coalesce(F.size("a.answer_specifics"), F.lit(0)) > 0) & ((more > 0) | (gain("token_f1") > 0))
    return best(beside(a, b, key), keep, gain("token_f1") + 0.5 * more, n, key)


def safer_baselines(a: DataFrame, b: DataFrame, n: int, key: str = "unique_key") -> DataFrame:
    """Where a states more without support than b, or contradicts the answer and b does not."""
    keep = (gain("unsupported_specific_count") > 0) | (gain("contradiction") > 0)
    return best(beside(a, b, key), keep, gain("unsupported_specific_count") + gain("contradiction"), n, key)


def hallucinations(a: DataFrame, n: int, position: str = "pos") -> DataFrame:
    """Rows of one system with unsupported specifics; ties keep the order of the input."""
    rows = a.select(position, F.struct("*").alias("a"))
    return best(rows, flagged("a") > 0, value("a", "unsupported_specific_count") + value("a", "token_f1"), n, position)


def baseline_failures(a: DataFrame, b: DataFrame, n: int, key: str = "unique_key") -> DataFrame:
    """Where b falls behind a in overlap and similarity, or states much without support."""
    score = gain("token_f1") + gain("sbert") + 0.1 * value("b", "unsupported_specific_count")
    return best(beside(a, b, key), score > 0, score, n, key)
