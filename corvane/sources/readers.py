"""Readers of corpora, records and logs, and a registry of sources by name."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.text import first_filled, first_present
from corvane.operators.datasets import template_questions
from corvane.operators.records import first_rows, numbered
from corvane.operators.retrieval import Index
from corvane.operators.retrieval import rows_index as build_rows_index
from corvane.sources.archives import zipped_lines

# Names of fields and folders, log format, the classes with their descriptions, and FINDINGS.
PREDICTION_KEYS = ("prediction", "response", "output", "generated_text")
ANSWER_KEYS = ("answer", "reference", "gold", "ground_truth")
SHARED_FOLDERS = ("comparison", "full_heldout", "eval_runs")
KIND_PARTS = (".per_sample", "metrics_full_heldout", "predictions_full_heldout")
LOG_LINE = r"Step\s+(\d+)\s*/\s*(\d+)\s*\|\s*Loss:\s*([0-9.]+)\s*\|\s*LR:\s*([0-9.eE+\-]+)\s*\|\s*Samples/s:\s*([0-9.]+)"
CLASSES = (
    ("Disturbed Galaxies", "An irregular galaxy with a distorted, asymmetric shape, often from gravitational interaction."),
    ("Merging Galaxies", "Two or more galaxies colliding and merging, showing tidal tails and overlapping structure."),
    ("Round Smooth Galaxies", "A smooth elliptical galaxy with a round, featureless light profile and no spiral arms."),
    ("In-between Round Smooth Galaxies", "A smooth elliptical galaxy of intermediate, slightly flattened roundness."),
    ("Cigar Shaped Smooth Galaxies", "A smooth elliptical galaxy with an elongated, cigar-like elliptical shape."),
    ("Barred Spiral Galaxies", "A spiral galaxy with a central bar-shaped structure of stars from which spiral arms extend."),
    ("Unbarred Tight Spiral Galaxies", "A spiral galaxy without a central bar, with tightly wound spiral arms."),
    ("Unbarred Loose Spiral Galaxies", "A spiral galaxy without a central bar, with loosely wound, open spiral arms."),
    ("Edge-on Galaxies without Bulge", "A disk galaxy seen edge-on as a thin line of light, lacking a prominent central bulge."),
    ("Edge-on Galaxies with Bulge", "A disk galaxy seen edge-on with a prominent bright central bulge."),
)
#: The classes, one galaxy each, in the same order.
SINGULAR = (
    "a disturbed galaxy",
    "a pair of merging galaxies",
    "a round, smooth elliptical galaxy",
    "an in-between round smooth galaxy",
    "a cigar-shaped smooth galaxy",
    "a barred spiral galaxy",
    "an unbarred tight spiral galaxy",
    "an unbarred loose spiral galaxy",
    "an edge-on galaxy without a bulge",
    "an edge-on galaxy with a bulge",
)
FINDINGS = (
    "Findings: bilateral lower-lobe airspace opacities consistent with pneumonia.",
    "Findings: cardiomegaly with an enlarged cardiac silhouette; lungs are clear.",
    "Findings: no acute cardiopulmonary abnormality; normal chest radiograph.",
    "Findings: small right-sided pleural effusion with blunting of the costophrenic angle.",
    "Findings: hyperinflated lungs with flattened diaphragms suggesting emphysema.",
    "Findings: left upper-lobe consolidation; no pneumothorax identified.",
    "Findings: interstitial edema with vascular congestion and Kerley B lines.",
    "Findings: right perihilar mass-like opacity; further evaluation recommended.",
)
TURNS = "array<struct<`from`: string, value: string>>"
RECORD = f"id string, image string, conversations {TURNS}"
PREDICTION = "`index` long, id string, image string, record_type string, task_type string, type string, prompt string, question string, prediction string, response string, output string, generated_text string, answer string, reference string, gold string, ground_truth string, error string, label string"


def json_records(spark: SparkSession, path: str, schema: str = RECORD) -> DataFrame:
    """A JSON array of records; a byte-order mark is tolerated."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, line_no, line) of text files, blank lines counted; large files are read in ranges of bytes by several tasks.

    Lines are counted by range first; sums of these counts say at which line of its file a range
    begins. Within a range, rows come in the order of the file, which the row's number in its
    task keeps."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), "value")
    ranges = raw.groupBy("path", "start").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    begun = ranges.select("path", "start", (F.col("first") - F.coalesce(before, F.lit(0)) - 1).alias("less"))  # a row for each range
    line = F.when(F.col("line_no") == 1, F.regexp_replace("value", "^\\uFEFF", "")).otherwise(F.col("value"))
    return raw.join(begun, ["path", "start"]).select("path", (F.col("at") - F.col("less")).alias("line_no"), "value").select("path", "line_no", line.alias("line"))


def first_files(spark: SparkSession, path: str | list[str], lines: int) -> list[str]:
    """The first files, by path, that together have so many lines that are not blank; later files are not opened."""
    names, used, have = sorted(spark.read.text(path).inputFiles()), 0, 0
    while have < lines and used < len(names):
        more = names[used : 2 * used + 1]
        have += spark.read.text(more).where(F.trim("value") != "").limit(lines - have).count()
        used += len(more)
    return names[:used]


def json_lines(spark: SparkSession, path: str | list[str], schema: str = PREDICTION, strict: bool = True, limit: int | None = None) -> DataFrame:
    """JSON lines; blank lines are skipped. A bad line is dropped; if strict, it fails the query, which names it as path:line.

    With a limit, the first rows by path and line, from as few files as hold them."""
    if limit is not None:
        path = first_files(spark, path, limit)
        if limit <= 0 or not path:
            return spark.createDataFrame([], schema)
    if not strict and limit is None:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    lines = numbered_lines(spark, path).where(F.trim("line", F.lit(" \t\r")) != "")
    if strict and limit is not None:  # a line behind the last wanted one may be bad
        lines = lines.orderBy("path", "line_no").limit(limit)
    parsed = F.from_json("line", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    read = lines.withColumn("row", parsed).withColumn("bad", F.col("row._bad").isNotNull() | ~F.ltrim("line").startswith("{"))
    if strict:
        told = F.raise_error(F.concat("path", F.lit(":"), F.col("line_no").cast("string"), F.lit(": bad JSON: "), F.left("line", F.lit(200))))
        read = read.where(F.when(F.col("bad"), told.cast("boolean")).otherwise(F.lit(True)))
    else:
        read = read.where(~F.col("bad"))
    if not strict and limit is not None:
        read = read.orderBy("path", "line_no").limit(limit)
    return read.select("row.*").drop("_bad")


def with_aliases(rows: DataFrame, blank_counts: bool = False) -> DataFrame:
    """prediction, answer, prompt and record_type from whichever field holds them."""
    pick = first_present if blank_counts else first_filled
    have = lambda names: pick(*[F.col(c) for c in names if c in rows.columns])
    named = {"prediction": PREDICTION_KEYS, "answer": ANSWER_KEYS, "prompt": ("prompt", "question"), "record_type": ("record_type", "task_type", "type")}
    keep = [c for c in rows.columns if c not in {x for v in named.values() for x in v}]
    return rows.select(*keep, *[have(v).alias(k) for k, v in named.items()])


def files_by_suffix(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """(path, length) of all files below a folder, in order; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(path)
    return found.select("path", "length").orderBy("path")


def training_log(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a trainer's log; other lines are dropped."""
    return log_rows(spark.read.text(path))


def log_rows(lines: DataFrame) -> DataFrame:
    lines = lines.where(F.col("value").rlike(LOG_LINE))
    part = lambda i, kind: F.regexp_extract("value", LOG_LINE, i).cast(kind)
    return lines.select(part(1, "int").alias("step"), part(2, "int").alias("total_steps"), part(3, "double").alias("loss"), part(4, "double").alias("lr"), part(5, "double").alias("samples_per_sec"))


def checkpoint_losses(spark: SparkSession, path: str) -> DataFrame:
    """(step, loss) of checkpoint folders' meta files; bad files are skipped."""
    return spark.read.schema("step long, loss double").option("multiLine", True).option("mode", "DROPMALFORMED").json(f"{path}/checkpoint-*/meta.json").where("step is not null").orderBy("step")


def metric_summary(spark: SparkSession, path: str) -> DataFrame:
    """One row of a nested summary file, old and new field places alike."""
    raw = spark.read.text(path, wholetext=True)
    pick = lambda *paths: F.coalesce(*[F.get_json_object("value", p) for p in paths])
    return raw.select(
        pick("$.label").alias("label"), pick("$.num_scored", "$.overall.n").cast("long").alias("n"),
        *[pick(f"$.overall.{g}.{m}", f"$.{g}.{m}", f"$.{m}").cast("double").alias(m) for g, m in (("lexical", "rougeL_f1"), ("lexical", "token_f1"), ("exact_match", "em_all"), ("nli", "nli_consistency"), ("semantic", "sbert_cosine"))],
    )


def pair_store(spark: SparkSession, index_dir: str) -> DataFrame:
    """The index's pair table."""
    try:
        return spark.read.parquet(f"{index_dir}/pairs")
    except Exception as e:
        raise FileNotFoundError(f"no pair store in {index_dir}: build the index first") from e


def bucketed(spark: SparkSession, path: str, by: list[str], buckets: int) -> DataFrame:
    """Files of ``sinks.write_bucketed`` as the bucketed table that they are, so that joins by its keys don't shuffle it."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    name, keys = f"corvane_{hashlib.md5(f'{path} {buckets} {columns}'.encode()).hexdigest()}", ", ".join(f"`{k}`" for k in by)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {buckets} BUCKETS LOCATION '{path}'")
    spark.catalog.refreshTable(name)
    return spark.table(name)


def bm25_index(spark: SparkSession, index_dir: str) -> Index:
    """The stored BM25 tables."""
    kept = spark.read.parquet(f"{index_dir}/numbers").first()
    part = lambda name, *by: bucketed(spark, f"{index_dir}/{name}", list(by), kept["buckets"])
    return Index(part("postings", "term", "shard"), part("counts", "term"), part("lengths", "row_id"), kept["documents"], kept["terms"], kept["mean_idf"], kept["shards"])


def rows_index(spark: SparkSession, index_dir: str) -> Index:
    """The tables of ``sinks.write_rows_index``."""
    part = lambda name: spark.read.parquet(f"{index_dir}/{name}")
    kept = part("numbers").first()
    return build_rows_index(part("rows"), part("counts"), kept["documents"], kept["terms"], kept["mean_idf"])


def vectors(spark: SparkSession, index_dir: str, kind: str = "vectors") -> DataFrame:
    """The stored text vectors, or the visual ones."""
    return spark.read.parquet(f"{index_dir}/{kind}")


def synthetic_corpus(spark: SparkSession, n: int = 10) -> DataFrame:
    report = F.element_at(F.array(*[F.lit(x) for x in FINDINGS]), (F.col("id") % len(FINDINGS) + 1).cast("int"))
    return spark.range(n).select(F.col("id").alias("row_id"), F.concat(F.lit("synthetic_"), F.col("id").cast("string")).alias("pair_id"), report.alias("report"))


def with_class_reports(rows: DataFrame, label: str) -> DataFrame:
    """A descriptive text from a class number, by a broadcast ten-row dimension."""
    spark = rows.sparkSession
    dim = spark.createDataFrame([(i, f"Morphology: {n}. {d}") for i, (n, d) in enumerate(CLASSES)], f"{label} int, report string")
    return rows.join(F.broadcast(dim), label, "left")


def class_corpus(rows: DataFrame, position: str, label: str, split: str) -> DataFrame:
    """(row_id, pair_id, report) of labelled images: numbered in source order, the text from the class."""
    own = with_class_reports(numbered(rows, position, "row_id"), label)
    return own.select("row_id", F.concat(F.lit(f"galaxy_{split}_"), F.col("row_id").cast("string")).alias("pair_id"), "report")


def restricted(spark: SparkSession, **options) -> DataFrame:
    """A place for a source that needs its owner's credentials: it can be opened, and fails when it is read."""
    return spark.range(1).select(F.raise_error(F.lit("this source needs credentials of its owner")).cast("string").alias("report"))


class Loader(Protocol):
    """A caller's own corpus: a DataFrame of at least ``pair_id`` and ``report``; image_path and meta are added where they are missing."""

    def __call__(self, spark: SparkSession, *args, **options) -> DataFrame: ...


SOURCES: dict[str, Callable[..., DataFrame]] = {"synthetic": synthetic_corpus, "json": json_records, "jsonl": json_lines, "lines": numbered_lines, "zip": zipped_lines, "log": training_log, "pairs": pair_store, "restricted": restricted}


def register_source(name: str, load: Loader) -> None:
    """A further source for ``open_source`` and ``load_corpus``."""
    if name in SOURCES:
        raise ValueError(f"there is a source {name!r} already")
    SOURCES[name] = load


def open_source(spark: SparkSession, name: str, *args, **options) -> DataFrame:
    if name not in SOURCES:
        raise ValueError(f"unknown source {name!r}; there are {', '.join(sorted(SOURCES))}")
    return SOURCES[name](spark, *args, **options)


def load_corpus(spark: SparkSession, name: str, *args, **options) -> DataFrame:
    """(row_id, pair_id, image_path, report, meta) of a source, as ``sinks.write_index`` takes it; pair ids are unique; row_id is the source's, or follows its position or else a hash."""
    rows = open_source(spark, name, *args, **options)
    if lacking := {"pair_id", "report"} - set(rows.columns):
        raise ValueError(f"source {name!r} gives no {', '.join(sorted(lacking))}")
    if "row_id" not in rows.columns:
        order = F.col("position") if "position" in rows.columns else F.xxhash64("pair_id")
        rows = rows.join(numbered(rows.select("pair_id", order.alias("__order")), "__order", "row_id").drop("__order"), "pair_id")
    place = F.col("image_path") if "image_path" in rows.columns else F.lit(None).cast("string")
    meta = F.col("meta") if "meta" in rows.columns else F.create_map().cast("map<string,string>")
    return rows.select("row_id", "pair_id", place.alias("image_path"), "report", meta.alias("meta"))


BENCHMARKS: dict[str, Callable[..., DataFrame]] = {}


def register_benchmark(name: str, load: Callable[..., DataFrame]) -> None:
    """A set of questions under a name: load(spark, ...) gives (position, question, answer, answer_type)."""
    if name in BENCHMARKS:
        raise ValueError(f"there is a benchmark {name!r} already")
    BENCHMARKS[name] = load


def open_benchmark(spark: SparkSession, name: str, *args, num_samples: int | None = None, **options) -> DataFrame:
    """A benchmark's questions, the first ``num_samples`` in source order."""
    if name not in BENCHMARKS:
        raise ValueError(f"unknown benchmark {name!r}; there are {', '.join(sorted(BENCHMARKS))}")
    return first_rows(BENCHMARKS[name](spark, *args, **options), "position", num_samples)


def class_questions(spark: SparkSession, path: str, position: str = "position", label: str = "label") -> DataFrame:
    """Questions on labelled images, by templates."""
    rows = spark.read.parquet(path).select(F.col(position).alias("position"), F.col(label).alias("label"))
    return template_questions(rows, "position", "label", tuple(n for n, _ in CLASSES)).drop("label")


register_benchmark("class_questions", class_questions)


def label_of(path: str, forced: str | None = None, embedded: str | None = None, known: tuple[str, ...] = ()) -> str:
    """A result's label: as forced, as embedded, a known label in the path, the folder (unless it is one of all results), or the file's stem without what says its kind."""
    parts = [p for p in path.replace("\\", "/").split("/") if p]
    if label := forced or embedded or next((p for p in reversed(parts) if p in known), None):
        return label
    if len(parts) > 1 and parts[-2] not in SHARED_FOLDERS:
        return parts[-2]
    stem = parts[-1].rsplit(".", 1)[0] if parts else ""
    for kind in KIND_PARTS:
        stem = stem.replace(kind, "")
    return stem.strip("_-.") or "artifact"
