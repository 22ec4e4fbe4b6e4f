"""Logs and resumable appends as streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvane.sources.readers import log_rows
from corvane.sources.whole_files import Files


def log_stream(spark: SparkSession, path: str) -> DataFrame:
    """Rows of trainers' logs as they come in below a folder; other lines are dropped."""
    return log_rows(spark.readStream.text(path))


def digest(key: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))))


class Ledger:
    """Which batches of a run are written, and the digests of all keys that are.

    16 bytes for each key, in Parquet, are all that is kept; the stream has no state of its own.
    A batch is written in four steps: its rows to a hidden folder beside the output, from
    there into place under names of the run and the batch, its keys to the ledger, and the mark
    that it is done. A batch that is run again after a failure first takes back what it had
    put in place, so rows are neither lost nor doubled wherever it had stopped."""

    def __init__(self, spark: SparkSession, key: str, path: str, checkpoint: str):
        self.spark, self.key, self.path, self.root = spark, key, path, f"{checkpoint}/ledger"
        self.here, self.there = Files(spark, self.root), Files(spark, path)
        self.run = self.run_name()
        if not self.here.exists(f"{self.root}/keys/former/_SUCCESS"):
            self.former().write.mode("overwrite").parquet(f"{self.root}/keys/former")

    def run_name(self) -> str:
        """A name that no other run into the same output has; it stays with the checkpoint."""
        if not self.here.exists(f"{self.root}/run"):
            self.here.fs.mkdirs(self.here.at(f"{self.root}/run/{uuid.uuid4().hex}"))
        return self.here.fs.listStatus(self.here.at(f"{self.root}/run"))[0].getPath().getName()

    def former(self) -> DataFrame:
        """The keys of what was in the output before this run."""
        if not self.there.exists(self.path):
            return self.spark.createDataFrame([], "digest binary")
        return self.spark.read.schema(f"`{self.key}` string").json(self.path).select(digest(self.key).alias("digest")).distinct()

    def known(self) -> DataFrame:
        return self.spark.read.schema("digest binary").option("recursiveFileLookup", True).parquet(f"{self.root}/keys")

    def in_place(self, batch: int) -> list[str]:
        """A batch's files in the output."""
        if not self.there.exists(self.path):
            return []
        return [s.getPath().toString() for s in self.there.fs.listStatus(self.there.at(self.path)) if s.getPath().getName().startswith(f"{self.run}-{batch}-")]

    def write(self, rows: DataFrame, batch: int) -> None:
        done, keys, hidden = f"{self.root}/done/{batch}", f"{self.root}/keys/{batch}", f"{self.path}/_{self.run}-{batch}"
        if self.here.exists(done):
            return
        for left in self.in_place(batch):
            self.there.delete(left)
        self.here.delete(keys)
        fresh = rows.withColumn("__digest", digest(self.key)).dropDuplicates(["__digest"])
        old = self.known().join(fresh.select(F.col("__digest").alias("digest")), "digest", "left_semi")  # of the keys, only those that the batch has
        fresh = fresh.join(old.select(F.col("digest").alias("__digest")), "__digest", "left_anti")
        fresh.write.mode("overwrite").parquet(f"{hidden}/rows")  # both the output and the keys are of these rows
        fresh = self.spark.read.schema(fresh.schema).parquet(f"{hidden}/rows")
        fresh.drop("__digest").write.mode("overwrite").option("ignoreNullFields", False).json(f"{hidden}/json")
        for part, _ in self.there.parts(f"{hidden}/json"):
            self.there.fs.rename(self.there.at(part), self.there.at(f"{self.path}/{self.run}-{batch}-{part.rsplit('/', 1)[-1]}"))
        fresh.select(F.col("__digest").alias("digest")).write.mode("overwrite").parquet(keys)
        self.here.fs.mkdirs(self.here.at(done))
        self.there.delete(hidden)


def append_stream(rows: DataFrame, key: str, path: str, checkpoint: str) -> StreamingQuery:
    """Append, as JSON lines, each key's first row only, over all runs; takes what is there and stops.

    Keys are those of all runs into the output up to this run's first start, and of the run
    itself (``Ledger``). Of rows of one key in a batch, any one is taken."""
    ledger = Ledger(rows.sparkSession, key, path, checkpoint)
    return rows.writeStream.foreachBatch(ledger.write).option("checkpointLocation", f"{checkpoint}/state").trigger(availableNow=True).start()
