"""Line deduplication by a suffix array over line ids (operator 3), in DataFrame operations only.

A document is its sequence of lines that are not blank. Lines that occur once get no id:
no repeated run can hold them. The others get ids in the order of their digests, and
prefix doubling ranks the suffixes that start at them by their first 2, 4, ... lines:
a rank at depth h and the rank h lines on make the rank at depth 2h. Suffixes with equal
ranks at a depth form an interval of the suffix array whose longest common prefix is at
least that; the others leave, and doubling goes on until none is tied. In each interval
the first suffix, by (doc_id, line), stays; the lines that the others share with it are a
later copy of a run. A suffix counts with the deepest interval in which it is a later
copy. A run whose length is not a power of two is covered by two that are, from its start
and to its end, so the overlapping ones join into the maximal runs of later copies; these
go. A run has ``min_lines`` lines or more, or is a line of ``long_line`` characters or more.

Scale: lines travel as 16-byte digests. Ids and ranks are dealt by range over distinct
keys, counted before the shuffle; a line that makes up a third of the corpus is one key,
and its occurrences are dealt over several tasks. There are as many rounds as the longest
repeated run's length has binary digits, over ever fewer suffixes.

Null text stays null and has no lines; blank lines stay; a document may lose all lines
and becomes empty. Rows without an id are returned unchanged. Rows that repeat an id with
the same text are one document: they are no copies of each other; with different texts
they are documents of their own. Other columns stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, dealt_join, parts, variant

FILLED = "filter(split({0}, '\\n', -1), x -> trim(both ' \\t\\r' from x) <> '')"


PLACE = ["doc_id", "variant", "pos"]


def dealt_ranks(keys: DataFrame, columns: list[str], scratch: Scratch, name: str) -> tuple[DataFrame, int]:
    """Number distinct keys from 0 in their order, without one task seeing them all; and how many rows (n) they have."""
    ranged = scratch.keep(keys.repartitionByRange(parts(keys.sparkSession), *columns).withColumn("part", F.spark_partition_id()), name)
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("n")).collect()  # a row for each partition
    before, total = [], 0
    for r in sorted(sizes):
        before += [F.lit(r["part"]), F.lit(total)]
        total += r["keys"]
    local = F.row_number().over(Window.partitionBy("part").orderBy(*columns)) - 1
    first = F.create_map(*before)[F.col("part")] if before else F.lit(0)
    return ranged.withColumn("rank", (first + local).cast("long")).drop("part"), sum(r["n"] for r in sizes)


def line_rows(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", "variant", F.posexplode(F.expr(FILLED.format("text"))).alias("pos", "line"))
    return rows.select(*PLACE, F.unhex(F.md5("line")).alias("line_key"), F.length("line").alias("chars"))


def later_runs(docs: DataFrame, min_lines: int, long_line: int, scratch: Scratch) -> DataFrame:
    """(doc_id, variant, pos, depth): of each suffix, the most lines, by doubling, for which it is a later copy."""
    lines = scratch.keep(line_rows(docs), "lines")
    counted = [F.count(F.lit(1)).alias("n"), F.min(F.struct(*PLACE)).alias("first")]
    ids, tied = dealt_ranks(lines.groupBy("line_key").agg(*counted).where("n > 1"), ["line_key"], scratch, "ids")
    now = scratch.keep(dealt_join(lines, ids, ["line_key"], "n", ["doc_id", "pos"], tied).select(*PLACE, "rank", "first", "chars").dropDuplicates(PLACE), "depth1")
    scratch.drop("lines", "ids")
    later, depth = F.struct(*PLACE) > F.col("first"), 1
    out = now.where(later if min_lines == 1 else later & (F.col("chars") >= long_line)).select(*PLACE, F.lit(1).alias("depth"))
    while tied:
        step = min(depth, min_lines - depth) if depth < min_lines else depth
        ahead = now.select("doc_id", "variant", (F.col("pos") - step).alias("pos"), F.col("rank").alias("rank2"))
        pairs = scratch.keep(now.select(*PLACE, F.col("rank").alias("rank1")).join(ahead.hint("merge"), PLACE), f"pairs{depth}")
        ranks, tied = dealt_ranks(pairs.groupBy("rank1", "rank2").agg(*counted).where("n > 1"), ["rank1", "rank2"], scratch, f"ranks{depth}")
        if not tied:
            break
        depth += step
        now = scratch.keep(dealt_join(pairs, ranks, ["rank1", "rank2"], "n", ["doc_id", "pos"], tied).select(*PLACE, "rank", "first"), f"depth{depth}")
        if depth >= min_lines:
            out = out.unionByName(now.where(later).select(*PLACE, F.lit(depth).alias("depth")))
        scratch.drop(f"pairs{depth - step}", f"ranks{depth - step}")
    return out.groupBy(*PLACE).agg(F.max("depth").alias("depth"))


def line_runs(docs: DataFrame, min_lines: int = 2, long_line: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, variant, lo, hi): the maximal runs of later copies, in numbers of lines that are not blank, without overlaps."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), variant(F.col(text_col)).alias("variant"), F.col(text_col).alias("text"))
    scratch = Scratch(docs.sparkSession, "lines")
    found = later_runs(own.where("doc_id is not null and text is not null"), min_lines, long_line, scratch)
    order = Window.partitionBy("doc_id", "variant").orderBy("pos")
    reach = F.max(F.col("pos") + F.col("depth")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(reach > F.col("pos"), 0).otherwise(1)
    run = found.withColumn("begins", begins).withColumn("run", F.sum("begins").over(order))
    runs = run.groupBy("doc_id", "variant", "run").agg(F.min("pos").alias("lo"), F.max(F.col("pos") + F.col("depth")).alias("hi"))
    return scratch.keep(runs.drop("run"), "runs")


def bound(value: Column, use) -> Column:
    """use(value), with the value computed once for each row however often it is used."""
    return F.transform(F.array(value), use)[0]


def kept_text(text: Column, gone: Column) -> Column:
    """The text without the lines numbered in gone (null: none)."""

    def cut(every: Column) -> Column:
        all_ = F.sequence(F.lit(0), F.size(every) - 1)
        filled = F.filter(all_, lambda i: F.trim(every[i], F.lit(" \t\r")) != "")
        kept = bound(filled, lambda at: F.array_except(all_, F.transform(gone, lambda k: at[k])))
        return F.array_join(F.transform(kept, lambda i: every[i]), "\n")

    return F.when(gone.isNull(), text).otherwise(bound(F.split(text, "\n", -1), cut))


def line_dedup(docs: DataFrame, min_lines: int = 2, long_line: int = 200, id_col: str = "doc_id", text_col: str = "text", counts: tuple[str, str] | None = None) -> DataFrame:
    """All rows and columns, the text without later copies of runs; counts names two more: lines not blank, and lines removed."""
    if min_lines < 1:
        raise ValueError("min_lines must be 1 or more")
    runs = line_runs(docs, min_lines, long_line, id_col, text_col)
    spans = F.flatten(F.transform(F.collect_list(F.struct("lo", "hi")), lambda r: F.sequence(r["lo"], r["hi"] - 1)))
    gone = runs.groupBy(F.col("doc_id").alias("__gone_id"), F.col("variant").alias("__gone_variant")).agg(spans.alias("__gone")).hint("merge")
    same = (docs[id_col].cast("long") == F.col("__gone_id")) & (variant(docs[text_col]) == F.col("__gone_variant"))
    joined = docs.join(gone, same, "left")
    text = F.col(text_col)
    out = [kept_text(text, F.col("__gone")).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    if counts:
        out += [F.coalesce(F.size(F.expr(FILLED.format(f"`{text_col}`"))), F.lit(0)).alias(counts[0]), F.coalesce(F.size("__gone"), F.lit(0)).alias(counts[1])]
    return joined.select(*out)
