"""Writers: JSON, JSON lines, CSV, Markdown, index tables and resumable appends."""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators import retrieval as R
from corvane.sources.whole_files import write_csv, write_json_array, write_package

__all__ = ["append_new", "markdown_report", "markdown_table", "write_bucketed", "write_csv", "write_document", "write_early", "write_index", "write_json_array", "write_json_lines", "write_package", "write_rows_index"]


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def append_new(df: DataFrame, done: DataFrame | None, key: str, path: str, resume: bool = True, overwrite: bool = False) -> None:
    """Append rows whose key is not written yet; rows with an error count as written. To overwrite and to resume exclude each other."""
    if overwrite and resume and done is not None:
        raise ValueError("overwrite and resume exclude each other")
    if overwrite:
        write_json_lines(df, path, "overwrite")
        return
    rows = df if done is None else df.join(done.select(key).distinct(), key, "left_anti")
    write_json_lines(rows, path, "append")


def write_bucketed(df: DataFrame, path: str, by: list[str], buckets: int, mode: str = "errorifexists", dealt: bool = False) -> None:
    """A table in files of one bucket each, sorted by its keys; ``readers.bucketed`` reads it as such. ``dealt``: the rows are in these buckets already."""
    name = f"corvane_{uuid.uuid4().hex}"
    rows = df if dealt else df.repartition(buckets, *by)
    rows.write.mode(mode).bucketBy(buckets, *by).sortBy(*by).option("path", path).saveAsTable(name)
    df.sparkSession.sql(f"DROP TABLE {name}")  # the files stay


def write_index(corpus: DataFrame, vectors: DataFrame | None, index_dir: str, mode: str = "errorifexists", visual: DataFrame | None = None, buckets: int | None = None) -> None:
    """Pairs, BM25 tables, and text and visual vectors.

    Postings and document counts are bucketed by term, pairs and lengths by row_id, so that
    joins with them shuffle the other side only. The numbers are written last: an index
    without them is not whole."""
    if corpus.isEmpty():
        raise ValueError("the corpus is empty")
    spark = corpus.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = lambda name: f"{index_dir}/{name}"
    read = lambda name: spark.read.parquet(place(name))
    write_bucketed(corpus, place("pairs"), ["row_id"], buckets, mode)
    write_bucketed(R.lengths(read("pairs")), place("lengths"), ["row_id"], buckets, mode)
    size = read("lengths").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("terms")).first()
    shards, mean = -(-size["n"] // R.SHARD_ROWS), size["terms"] / size["n"] or 1.0
    write_bucketed(R.blocks(read("pairs"), mean, shards, buckets), place("postings"), ["term", "shard"], buckets, mode, dealt=True)
    write_bucketed(read("postings").groupBy("term").agg(F.sum(F.size("rows")).alias("df")), place("counts"), ["term"], buckets, mode)
    for name, table in (("vectors", vectors), ("visual", visual)):
        if table is not None:
            table.write.mode(mode).parquet(place(name))
    kept = R.numbers(read("lengths"), read("counts"))
    spark.createDataFrame([(*kept, shards, buckets)], "documents long, terms long, mean_idf double, shards int, buckets int").write.mode(mode).parquet(place("numbers"))


def write_rows_index(corpus: DataFrame, index_dir: str, mode: str = "errorifexists") -> None:
    """An index for many questions at once: counted rows, document counts and the numbers. Nothing but counts is shuffled."""
    if corpus.isEmpty():
        raise ValueError("the corpus is empty")
    spark = corpus.sparkSession
    read = lambda name: spark.read.parquet(f"{index_dir}/{name}")
    R.counted(corpus).write.mode(mode).parquet(f"{index_dir}/rows")
    R.row_counts(read("rows")).write.mode(mode).parquet(f"{index_dir}/counts")
    kept = R.numbers(read("rows"), read("counts"))
    spark.createDataFrame([kept], "documents long, terms long, mean_idf double").write.mode(mode).parquet(f"{index_dir}/numbers")


def markdown_table(df: DataFrame, most: int = 10_000) -> str:
    """A small result as a table: null is a dash, doubles have four places. More than ``most`` rows are an error: no page holds them."""
    text = lambda c, t: F.format_string("%.4f", F.col(f"`{c}`")) if t == "double" else F.col(f"`{c}`").cast("string")
    flat = lambda x: F.replace(F.regexp_replace(x, r"\s*\n\s*", " "), F.lit("|"), F.lit("\\|"))
    rows = df.select(*[F.coalesce(flat(text(c, t)), F.lit("-")).alias(c) for c, t in df.dtypes]).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows are no page: write them with write_csv")
    if not rows:
        return "_No rows._"
    line = lambda xs: f"| {' | '.join(xs)} |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *[line(list(r)) for r in rows]])


def write_document(df: DataFrame, path: str) -> None:
    """Rows as one indented JSON file, whatever their number."""
    write_json_array(df, path, pretty=True)


def write_early(base: DataFrame, path: str, key: str, optional: dict[str, Callable[[DataFrame], DataFrame]]) -> dict[str, str]:
    """The base rows first, then each optional table of (key, values) beside them; one that fails is left out.

    Returns what failed, and why; the base rows and the other tables stay."""
    base.write.mode("overwrite").parquet(f"{path}/base")
    rows, failed = base.sparkSession.read.parquet(f"{path}/base"), {}
    for name, make in optional.items():
        try:
            make(rows).write.mode("overwrite").parquet(f"{path}/{name}")
        except Exception as e:  # any failure of an optional metric is a warning
            failed[name] = str(e).splitlines()[0] if str(e) else type(e).__name__
            warnings.warn(f"{name} failed and is left out: {failed[name]}", stacklevel=2)
    return failed


def markdown_report(title: str, sections: list[tuple[str, DataFrame | str]]) -> str:
    """A page of headings, each with a text or a small result's table."""
    parts = [f"# {title}"]
    for heading, body in sections:
        parts += [f"## {heading}", body if isinstance(body, str) else markdown_table(body)]
    return "\n\n".join(parts) + "\n"
