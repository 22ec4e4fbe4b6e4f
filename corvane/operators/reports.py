"""Pages for people: rows without a score, marks for judges, and mined examples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.sources.sinks import markdown_report


def skip_report(label: str, predictions: int, scored: int, reasons: DataFrame, preview: DataFrame, rows: int = 50) -> str:
    """How many rows of a system have no score, why, and the first of them."""
    text = f"{predictions - scored} of {predictions} rows have no score."
    why = reasons.orderBy(F.desc("n"), "reason").select("reason", F.col("n").alias("rows"))
    few = preview.select("index", "id", "record_type", "image", "reason", F.coalesce("error", F.lit("")).alias("error")).limit(rows)
    return markdown_report(f"{label}: what was not scored", [("Count", text), ("Why", why), (f"First {rows}", few)])


def rubric(sheet: DataFrame, fields: dict[str, str]) -> str:
    """What judges of a sheet should know: how many records, of which systems, and what each mark means."""
    n = sheet.agg(F.count_distinct("sample_id").alias("n"), F.array_sort(F.collect_set("model_label")).alias("labels")).first()
    marks = sheet.sparkSession.createDataFrame(list(fields.items()), "mark string, meaning string") if fields else "None."
    return markdown_report("Marks for this sheet", [("Sheet", f"{n['n']} records, each answered by {len(n['labels'])} systems: {', '.join(n['labels'])}."), ("Marks", marks)])


def mined_report(found: dict[str, DataFrame], names: dict[str, str], key: str = "unique_key") -> str:
    """A section for each miner, with a table of its examples, best first: what was asked and expected, the score, and what each system said.

    ``found`` has the miners' rows (key, mine_score, and a struct of scored fields for each system); ``names`` has the
    systems' labels by struct. A miner returns a stated number of rows, which bounds the page."""
    sections: list[tuple[str, DataFrame | str]] = []
    for miner, rows in found.items():
        sides = [s for s in names if s in rows.columns]
        first = sides[0] if sides else None
        have = set(rows.schema[first].dataType.names) if first else set()
        asked = [F.col(f"{first}.{c}").alias(c) for c in ("image", "record_type", "prompt", "answer") if c in have]
        said = [c for s in sides for c in (F.col(f"{s}.prediction").alias(names[s]), F.round(F.col(f"{s}.token_f1"), 4).alias(f"{names[s]}: token F1"), F.col(f"{s}.unsupported_specific_count").alias(f"{names[s]}: unsupported"))]
        key_ = F.col(key).cast("string").alias("key")
        sections.append((miner, rows.orderBy(F.desc(F.round("mine_score", 9)), key).select(key_, F.col("mine_score").cast("double").alias("score"), *asked, *said)))
    return markdown_report("Examples worth a look", sections)
