"""Helpers that the corpus operators share."""

from __future__ import annotations

import atexit
import contextlib
import gc
import uuid
from collections.abc import Iterator

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOT_KEYS = 65_536
HOT_ROWS = 20_000
_live: list[Scratch] = []


class Scratch:
    """Intermediate tables in the folder that the cluster shares.

    The folder is the session's ``spark.checkpoint.dir``; where that is unset (tests,
    a single machine) the SQL warehouse is used. A table written here cuts the lineage:
    the loss of an executor costs the tasks of the present stage only.

    A returned DataFrame may read the last of these tables, so they stay until their owner
    is done: the end of an ``owned()`` block, a call of ``release()``, or the program's end.
    """

    def __init__(self, spark: SparkSession, name: str):
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
        self.spark, self.root = spark, f"{root.rstrip('/')}/corvane/{name}-{uuid.uuid4().hex}"
        _live.append(self)

    def keep(self, df: DataFrame, name: str, row_group: int = 128 << 20) -> DataFrame:
        """Write ``df`` and return the written table; a task holds ``row_group`` bytes of it."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("parquet.block.size", row_group).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that later steps do not read, and let go of finished shuffles."""
        for name in names:
            self._delete(f"{self.root}/{name}")
        self.spark.range(1).count()  # the session holds the plan that ran last, and with it its shuffles
        gc.collect()
        self.spark._jvm.System.gc()

    def release(self) -> None:
        """Delete all tables."""
        if self in _live:
            _live.remove(self)
        self._delete(self.root)

    def _delete(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def owned() -> Iterator[None]:
    """Tables that operators write inside are deleted when the block ends; write what it returns before."""
    before = list(_live)
    try:
        yield
    finally:
        for scratch in [s for s in _live if s not in before]:
            scratch.release()


@atexit.register
def _release_all() -> None:
    for scratch in list(_live):
        with contextlib.suppress(Py4JError, OSError, AttributeError, TypeError):
            scratch.release()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) only, under fixed names: null text is empty, rows without an id take no part."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("doc_id is not null")


def variant(text: Column) -> Column:
    """Tells texts under one id apart: rows with the same id and variant have the same text."""
    return F.hash(F.coalesce(text, F.lit("")))


def parts(spark: SparkSession, at_least: int = 1) -> int:
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def dealt_join(rows: DataFrame, keys: DataFrame, on: list[str], count: str, spread: list[str], total: int | None = None) -> DataFrame:
    """Inner join of rows with keys, a written table of one row for each key and how many rows have it.

    A key of over ``limit`` rows is dealt by ``spread`` over several tasks, each with a copy of the
    key's row. At most HOT_KEYS keys can have so many rows; only these are broadcast."""
    total = keys.agg(F.sum(count)).first()[0] or 0 if total is None else total
    limit = max(HOT_ROWS, -(-total // HOT_KEYS))
    shares = F.ceil(F.col(count) / limit).cast("int")
    hot = keys.where(F.col(count) > limit).select(*on, shares.alias("__shares"))
    dealt = rows.join(F.broadcast(hot), on, "left").withColumn("__share", F.coalesce(F.pmod(F.hash(*spread), F.col("__shares")), F.lit(0))).drop("__shares")
    copies = keys.withColumn("__share", F.explode(F.sequence(F.lit(0), F.greatest(shares, F.lit(1)) - 1)))
    return dealt.join(copies.hint("merge"), [*on, "__share"]).drop("__share")


def word_count(text: Column) -> Column:
    """How many runs of bytes other than space and \\t to \\r; null has none. No array of words is built."""
    spaced = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.when(spaced == "", F.lit(0)).otherwise(F.octet_length(spaced) - F.octet_length(F.replace(spaced, F.lit(" "), F.lit(""))) + 1).cast("long")
