"""Language identification by multilingual mixture inference (operator 6).

Each language has a distribution over character trigrams (lower-cased; runs of anything
but letters become one space), hashed into ``BUCKETS`` and smoothed. A document's
trigrams are taken as drawn from a mixture of languages; expectation-maximisation
estimates the proportions. The set of languages is the one with the highest likelihood
less a penalty for each language, along the order of the fitted proportions.

The models are fitted on about ``sample_per_language`` labelled documents for each
language (all, where there are fewer), chosen by a hash of the id: what the classifier
learns from is bounded, what it labels is every row, from its whole text.

Scale: two passes over the table, no shuffle but of the trigram counts, which are summed
in each task first: at most languages x BUCKETS rows. The models are broadcast; their
size does not depend on the corpus. Over ``max_languages`` labels are an error: a column of
that many is no language, and the models would not fit.

Text that is null or has no letter gives ``und`` with score 0, as does everything where
nothing was learned. Rows without an id teach nothing, and are labelled only where columns are
kept that tell them apart; repeated rows are labelled each. Languages of equal shares are tied:
the one whose name is smaller goes first. Very long texts are read in pieces, as a whole. An
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import batch

BUCKETS = 1 << 16
SMOOTHING = 0.5
EM_STEPS = 15
#: A further language has to gain this much log-likelihood for each trigram, and twice the logarithm of their number.
GAIN_PER_TRIGRAM = 0.02
PIECE = 1 << 18


def letter_table() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(1 << 16)])


def trigrams(text: str, letters: np.ndarray) -> np.ndarray:
    """Hashed trigrams of a text; none if it has no letter. Long texts go piece by piece."""
    out = []
    for at in range(0, len(text), PIECE):
        codes = np.frombuffer(text[at : at + PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        alpha = letters[np.minimum(codes, 0xFFFF)]
        for i in np.flatnonzero(codes > 0xFFFF):
            alpha[i] = chr(codes[i]).isalpha()
        if not alpha.any():
            continue
        codes = np.concatenate(([32], np.where(alpha, codes, 32), [32])).astype(np.uint64)
        codes = codes[(codes != 32) | np.append(True, codes[:-1] != 32)]
        key = (codes[:-2] << np.uint64(42)) ^ (codes[1:-1] << np.uint64(21)) ^ codes[2:]
        out.append((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def fit_mixture(p: np.ndarray, weight: np.ndarray | None, share: np.ndarray, steps: int = EM_STEPS) -> tuple[np.ndarray, float]:
    """EM for mixture proportions of trigram probabilities p (trigrams x languages): (shares, log-likelihood)."""
    n = len(p) if weight is None else weight.sum()
    for _ in range(steps):
        q = p @ share
        r = (1 / q if weight is None else weight / q) @ p
        new = share * r / n
        if np.abs(new - share).max() < 1e-4:
            share = new
            break
        share = new
    share = share / share.sum()
    logs = np.log(p @ share)
    return share, float(logs.sum() if weight is None else logs @ weight)


def infer(h: np.ndarray, models: np.ndarray) -> tuple[np.ndarray, float]:
    """Shares of the selected languages (0 for the others), and what they sum to in the unrestricted mixture."""
    weight = None
    if len(h) > 20_000:
        counts = np.bincount(h.astype(np.int64), minlength=len(models))
        h = np.flatnonzero(counts)
        weight = counts[h].astype(np.float64)
    p = models[h]
    n, languages = (len(h) if weight is None else weight.sum()), models.shape[1]
    share, full = fit_mixture(p, weight, np.full(languages, 1 / languages))
    order = np.argsort(-share, kind="stable")
    price = 2 * np.log(n + 1) + GAIN_PER_TRIGRAM * n
    best, kept = -np.inf, share
    for size in range(1, languages + 1):
        if full - price * (size - 1) <= best:  # no set of this size or over can be better
            break
        own = order[:size]
        if size == 1:
            logs = np.log(p[:, own[0]])
            got, value = np.ones(1), float(logs.sum() if weight is None else logs @ weight)
        else:
            got, value = fit_mixture(p[:, own], weight, np.full(size, 1 / size))
        if value - price * (size - 1) > best:
            best, kept = value - price * (size - 1), np.zeros(languages)
            kept[own] = got
    # The score is the share in the unrestricted mixture, so that a poor fit shows.
    fit = min(1.0, float(share[kept > 0].sum()))
    return np.where(kept > 0, share, 0) if (kept > 0).sum() == 1 else kept, fit


def learn(labelled: DataFrame, sample_per_language: int, max_languages: int) -> tuple[list[str], np.ndarray]:
    """Languages and their trigram probabilities, BUCKETS x languages."""
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(max_languages + 1).collect()}
    if len(counts) > max_languages:
        raise ValueError(f"over {max_languages} languages: set max_languages, or merge labels")
    languages = sorted(counts)
    if not languages:
        return [], np.empty((BUCKETS, 0))
    spread = 1 << 20
    limit = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(spread, int(spread * sample_per_language / counts[k]) + 1)))])
    sample = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(spread)) < limit[F.col("lang")])
    number = {k: i for i, k in enumerate(languages)}

    def run(batches):
        letters, sums = letter_table(), np.zeros((len(number), BUCKETS), np.int64)
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                sums[number[lang]] += np.bincount(trigrams(text.as_py(), letters).astype(np.int64), minlength=BUCKETS)
        at = np.nonzero(sums)
        yield batch(lang=at[0].astype(np.int32), bucket=at[1].astype(np.int32), n=sums[at])

    got = sample.select("lang", "text").mapInArrow(run, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    table = np.full((BUCKETS, len(languages)), SMOOTHING)
    table[got["bucket"], got["lang"]] += got["n"]
    return languages, table / table.sum(0)


def inferred(docs: DataFrame, keep: list[str], training: Column | str, sample_per_language: int, id_col: str, text_col: str, lang_col: str, max_languages: int) -> DataFrame:
    """(_0, _1, ... of the columns in keep, lang_pred, score, languages, fit) of every row."""
    spark = docs.sparkSession
    training = F.expr(training) if isinstance(training, str) else training
    labelled = docs.where(F.col(id_col).isNotNull() & training & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    labelled = labelled.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    languages, models = learn(labelled, sample_per_language, max_languages)
    held = spark.sparkContext.broadcast(models.astype(np.float32) if len(languages) > 16 else models)
    rows = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(keep)], F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kept = [(f"_{i}", t) for i, t in enumerate(dict(docs.dtypes)[c] for c in keep)]
    schema = ", ".join(f"{c} {t}" for c, t in [*kept, ("lang_pred", "string"), ("score", "double"), ("languages", "array<struct<lang: string, share: double>>"), ("fit", "double")])
    mixed = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def run(batches):
        letters, models = letter_table(), held.value
        for b in batches:
            pred, score, sets, fits = [], [], [], []
            for text in b.column("text"):
                h = trigrams(text.as_py(), letters) if languages else ()
                if len(h):
                    share, fit = infer(h, models)
                    best = int(share.argmax())
                    pred.append(languages[best])
                    score.append(min(1.0, float(share[best])))
                    sets.append([{"lang": languages[i], "share": float(share[i])} for i in np.flatnonzero(share)])
                    fits.append(fit)
                else:
                    pred.append("und")
                    score.append(0.0)
                    sets.append([])
                    fits.append(0.0)
            yield batch(**{c: b.column(c) for c, _ in kept}, lang_pred=pa.array(pred, pa.string()), score=pa.array(score, pa.float64()), languages=pa.array(sets, mixed), fit=pa.array(fits, pa.float64()))

    return rows.mapInArrow(run, schema)


def identify(docs: DataFrame, training: Column | str = "true", sample_per_language: int = 2000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_languages: int = 1000) -> DataFrame:
    """(doc_id, lang_pred, score, languages, fit) of each row with an id; learns from rows where ``training`` holds."""
    out = inferred(docs.where(F.col(id_col).isNotNull()), [id_col], training, sample_per_language, id_col, text_col, lang_col, max_languages)
    return out.select(F.col("_0").cast("long").alias("doc_id"), "lang_pred", "score", "languages", "fit")


def explained(docs: DataFrame, least_fit: float = 0.5, training: Column | str = "true", sample_per_language: int = 2000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_languages: int = 1000) -> DataFrame:
    """The rows, with all their columns, whose text has letters and is for ``least_fit`` or more in the languages selected for it."""
    out = inferred(docs, docs.columns, training, sample_per_language, id_col, text_col, lang_col, max_languages)
    out = out.where((F.col("lang_pred") != "und") & (F.col("fit") >= least_fit))
    return out.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)])
