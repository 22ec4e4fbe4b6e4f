"""The same questions under several retrieval modes, with places for a caller's own steps."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.retrieval import Index as Terms
from corvane.operators.retrieval import RRF, attach, bm25_topk, dense_topk, fuse, pack_context, ranked

MODES = ("no_retrieval", "dense_visual", "sparse_bm25", "hybrid")


class Retriever(Protocol):
    """A caller's own way to retrieve: (query_id, rank, row_id, score) of the k best."""

    def __call__(self, questions: DataFrame, index: Index, k: int) -> DataFrame: ...


RETRIEVERS: dict[str, Retriever] = {}


def register(mode: str, retriever: Retriever) -> None:
    """A further mode for ``retrieve`` and ``compare``."""
    if mode in MODES or mode in RETRIEVERS:
        raise ValueError(f"there is a mode {mode!r} already")
    RETRIEVERS[mode] = retriever


def unchanged(rows: DataFrame) -> DataFrame:
    return rows


def fixed_weights(visual: float) -> dict[str, float]:
    return {"visual": visual, "text": 1 - visual}


@dataclass(frozen=True)
class Steps:
    """What a caller may replace: questions before retrieval, entries before packing, the weights of fusion, and the order of what was fused."""

    questions: Callable[[DataFrame], DataFrame] = unchanged
    entries: Callable[[DataFrame], DataFrame] = unchanged
    weights: Callable[[float], dict[str, float]] = fixed_weights
    rerank: Callable[[DataFrame], DataFrame] = unchanged


@dataclass(frozen=True)
class Index:
    """corpus (row_id, report[, modality]); vectors (row_id, vec) of its texts and of its images, and stored BM25 tables, where there are any."""

    corpus: DataFrame
    text_vectors: DataFrame | None = field(default=None)
    image_vectors: DataFrame | None = field(default=None)
    terms: Terms | None = field(default=None)


@F.udtf(returnType="part int, text string", useArrow=False)
class Clauses:
    """The parts of a question between marks that end a sentence or a clause, in order; blank ones don't count."""

    def eval(self, text: str):
        yield from enumerate(x for x in re.split(r"[.!?,;]+", text or "") if x.strip(" \t\r\n"))


def decomposed(questions: DataFrame, parts: type = Clauses) -> DataFrame:
    """(query_id, part, text) of questions (query_id, text), by a table function of the text: ``Clauses`` or a caller's own."""
    return questions.select("query_id", "text").lateralJoin(parts(F.col("text").outer()).alias("p")).select("query_id", F.col("p.part").alias("part"), F.col("p.text").alias("text"))


def retrieve_parts(questions: DataFrame, index: Index, k: int, pool: int = 20, parts: type = Clauses) -> DataFrame:
    """(query_id, rank, row_id, score): each part retrieves by BM25, and a question's lists are fused, equal scores by row_id."""
    asked = decomposed(questions, parts).withColumn("of", F.struct("query_id", "part"))
    top = bm25_topk(index.corpus, asked.select(F.col("of").alias("query_id"), "text"), pool, index.terms)
    fused = top.groupBy(F.col("query_id.query_id").alias("query_id"), "row_id").agg(F.sum(1 / (RRF + F.col("rank"))).alias("score"))
    return ranked(fused, k)


def joined_parts(parts: DataFrame) -> DataFrame:
    """One question (query_id, text) from its parts (query_id, part, text), in order, with a space between."""
    ordered = F.array_sort(F.collect_list(F.struct("part", "text")))
    return parts.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias("text"))


def dense(vectors: DataFrame | None, questions: DataFrame, column: str, k: int) -> DataFrame | None:
    """Top-k by the questions' vectors in ``column``; questions without one get nothing."""
    if vectors is None or column not in questions.columns:
        return None
    return dense_topk(vectors, questions.where(F.col(column).isNotNull()).select("query_id", F.col(column).alias("vec")), k)


def retrieve(mode: str, questions: DataFrame, index: Index, k: int, pool: int = 20, visual: float = 0.5, steps: Steps | None = None) -> DataFrame | None:
    """(query_id, rank, row_id, score) for questions (query_id, text[, text_vec, image_vec]); None for the mode without retrieval.

    Hybrid fuses text vectors, BM25 and image vectors, in that order for ties."""
    if mode not in MODES and mode not in RETRIEVERS:
        raise ValueError(f"unknown mode {mode!r}; there are {', '.join([*MODES, *RETRIEVERS])}")
    if mode == "no_retrieval":
        return None
    steps = steps or Steps()
    asked = steps.questions(questions)
    if mode in RETRIEVERS:
        return RETRIEVERS[mode](asked, index, k)
    if mode == "sparse_bm25":
        return bm25_topk(index.corpus, asked, k, index.terms)
    seen = dense(index.image_vectors, asked, "image_vec", k if mode == "dense_visual" else pool)
    if mode == "dense_visual":
        if seen is None:
            raise ValueError("dense_visual needs image vectors of the index and of the questions")
        return seen
    weight = steps.weights(visual)
    lists = [(dense(index.text_vectors, asked, "text_vec", pool), weight["text"]), (bm25_topk(index.corpus, asked, pool, index.terms), weight["text"]), (seen, weight["visual"])]
    return steps.rerank(fuse([(df, w) for df, w in lists if df is not None], pool)).where(F.col("rank") <= k)


def contexts(questions: DataFrame, top: DataFrame | None, index: Index, header: str, footer: str, budget: int, steps: Steps | None = None) -> DataFrame:
    """(query_id, n_kept, context) of every question; empty where nothing was retrieved."""
    asked = questions.select("query_id").distinct()
    if top is None:
        return asked.select("query_id", F.lit(0).cast("long").alias("n_kept"), F.lit("").alias("context"))
    modality = F.coalesce(F.col("modality"), F.lit("text")) if "modality" in index.corpus.columns else F.lit("text")
    flat = F.trim(F.regexp_replace("report", r"(?U)\s+", " "))
    entry = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] ("), modality, F.lit(") "), flat)
    entries = attach(top, index.corpus).select("query_id", "rank", entry.alias("entry"))
    packed = pack_context((steps or Steps()).entries(entries), header, footer, budget)
    return asked.join(packed, "query_id", "left").select("query_id", F.coalesce("n_kept", F.lit(0)).cast("long").alias("n_kept"), F.coalesce("context", F.lit("")).alias("context"))


def compare(modes: list[str], answer: Callable[[str, DataFrame], DataFrame], questions: DataFrame, index: Index, k: int, header: str, footer: str, budget: int, **options) -> dict[str, DataFrame]:
    """mode -> answer(mode, questions with their contexts), for ``evaluation.mode_comparison``."""
    out = {}
    for mode in modes:
        top = retrieve(mode, questions, index, k, **options)
        out[mode] = answer(mode, questions.join(contexts(questions, top, index, header, footer, budget, options.get("steps")), "query_id"))
    return out
