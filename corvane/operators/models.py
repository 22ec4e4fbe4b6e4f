"""Places for models: a callable over lists, loaded once in each task, applied to batches of rows.

``load`` is called in the worker and returns the model as a function of lists; it has to
be picklable. Nothing here needs a particular model or library."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BATCH = 256


def by_batch(rows: DataFrame, load: Callable[[], Callable], inputs: list[str], output: str, kind: str) -> DataFrame:
    """Adds ``output``, the model's value for each row's inputs."""

    def run(batches):
        model = load()
        for pdf in batches:
            got = []
            for at in range(0, len(pdf), BATCH):
                got += list(model(*[pdf[c].iloc[at : at + BATCH].tolist() for c in inputs]))
            yield pdf.assign(**{output: pd.Series(got, index=pdf.index, dtype=object)})

    return rows.mapInPandas(run, ", ".join([*[f"`{c}` {t}" for c, t in rows.dtypes], f"`{output}` {kind}"]))


def embed(rows: DataFrame, load: Callable[[], Callable], text: str, output: str = "vec") -> DataFrame:
    """Unit vectors of texts; a zero vector stays zero."""
    from corvane.operators.retrieval import unit

    return by_batch(rows, load, [text], output, "array<double>").withColumn(output, unit(F.col(output)))


def embed_images(rows: DataFrame, load: Callable[[], Callable], image: str = "rgb", output: str = "vec") -> DataFrame:
    """Unit vectors of images: the mean of the vectors that the model gives for an image's patches."""
    from corvane.operators.retrieval import mean_pooled, unit

    made = by_batch(rows, load, [image], "__patches", "array<array<double>>")
    return made.withColumn(output, unit(mean_pooled(F.col("__patches")))).drop("__patches")


def pair_cut(a: list, b: list, most: int) -> tuple[list, list]:
    """Both without what is over ``most`` together: the longer one is cut first, of equals the second."""
    over = max(0, len(a) + len(b) - most)
    longer, shorter = max(len(a), len(b)), min(len(a), len(b))
    first = min(over, longer - shorter)
    rest = over - first
    cut_a, cut_b = (first, 0) if len(a) > len(b) else (0, first)
    return a[: max(0, len(a) - cut_a - rest // 2)], b[: max(0, len(b) - cut_b - (rest + 1) // 2)]


def nli(rows: DataFrame, load: Callable[[], Callable], premise: str = "answer", hypothesis: str = "prediction", labels: tuple[str, str] = ("entail", "contradict"), max_chars: int | None = None, tokenizer: Callable[[], Callable] | None = None, max_tokens: int = 512) -> DataFrame:
    """Adds nli: P(entailment) - P(contradiction); -1 for an empty prediction.

    The model gives a pair of these, a dict by label, or a list of dicts with label and score;
    a label counts if it holds the given text, in any letter case, and what is missing is 0.
    A model has a longest input: texts over ``max_chars`` are cut, and pairs over
    ``max_tokens`` of a ``tokenizer``, which is loaded in the task and has encode and decode."""

    def named():
        model, words = load(), tokenizer() if tokenizer else None

        def pair(p):
            if isinstance(p, list) and p and isinstance(p[0], dict):
                p = {x["label"]: x["score"] for x in p}
            if isinstance(p, dict):
                return [next((float(v) for k, v in p.items() if label in k.lower()), 0.0) for label in labels]
            return list(p)

        def fitted(a, b):
            x, y = words.encode(a or ""), words.encode(b or "")
            u, v = pair_cut(x, y, max_tokens)
            return (a if len(u) == len(x) else words.decode(u)), (b if len(v) == len(y) else words.decode(v))

        def run(premises, hypotheses):
            if words is not None:
                premises, hypotheses = map(list, zip(*map(fitted, premises, hypotheses), strict=True))
            return [pair(p) for p in model(premises, hypotheses)]

        return run

    cut = lambda c: F.left(F.coalesce(c, F.lit("")), F.lit(max_chars)) if max_chars else F.col(c)
    given = rows.withColumn("__premise", cut(premise)).withColumn("__hypothesis", cut(hypothesis))
    scored = by_batch(given, named, ["__premise", "__hypothesis"], "__p", "array<double>")
    empty = F.trim(F.coalesce(F.col(hypothesis), F.lit(""))) == ""
    return scored.withColumn("nli", F.when(empty, -1.0).otherwise(F.col("__p")[0] - F.col("__p")[1])).drop("__p", "__premise", "__hypothesis")


def nli_summary(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """Mean consistency, and the share of rows that contradict, to four places; 0 for no rows."""
    four = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 4)
    return rows.groupBy(*by).agg(four("nli").alias("nli_consistency"), four((F.col("nli") < 0).cast("double")).alias("contradiction_rate"))


def rerank(candidates: DataFrame, load: Callable[[], Callable], k: int, query: str = "text", passage: str = "report") -> DataFrame:
    """The k best candidates (query_id, rank, ...) of each query by the model; ties keep the former order."""
    scored = by_batch(candidates, load, [query, passage], "model_score", "double")
    order = Window.partitionBy("query_id").orderBy(F.desc("model_score"), "rank")
    return scored.withColumn("new_rank", F.row_number().over(order)).where(F.col("new_rank") <= k).withColumn("rank", F.col("new_rank")).drop("new_rank")


def generate(rows: DataFrame, load: Callable[[], Callable], prompt: str = "prompt") -> DataFrame:
    """Adds response and error: a row on which the model fails keeps its error and has no response."""

    def guarded():
        model = load()

        def run(prompts):
            out = []
            for p in prompts:
                try:
                    out.append({"response": str(model(p)), "error": None})
                except Exception as e:  # the row's error is its result
                    out.append({"response": None, "error": f"{type(e).__name__}: {e}"})
            return out

        return run

    made = by_batch(rows, guarded, [prompt], "__made", "struct<response: string, error: string>")
    return made.select("*", "__made.response", "__made.error").drop("__made")


def cosine(a: Column, b: Column) -> Column:
    from corvane.operators.retrieval import inner_product, unit

    return inner_product(unit(a), unit(b))
