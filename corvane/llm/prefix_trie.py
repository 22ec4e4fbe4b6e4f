"""A trie of conversations by chained prefix digests (operator 13).

The digest of a prefix is SHA-256 of the digest of the prefix before it and of its last
turn, so equal (depth, digest) means equal turns from the first on. Every prefix of every
conversation is a row; grouped by (depth, digest) these are the nodes, with their members
counted and the smallest member. The nodes of one smallest member are the end of its path,
as all deeper nodes of the path have it as a member too: a run, from the node where the
conversation leaves those of smaller ones (the head) down to its last. Subtree sums add, for
each node, what is below it in its own run, by a running sum, and the sums of all runs
that hang off below: the sums of a run are exploded to all ancestors of its head. That is
the same as exploding every node to all ancestors, but for the rows: a conversation of n
turns makes at most n of them and not n * n / 2, however often it is repeated.

Scale: texts are hashed and counted where they are read; digests and numbers are shuffled.
Counts and sums are combined before each shuffle, so a prefix that a third of all
conversations share is a row for each task. Where heads look up the node that they hang
off, hot nodes are dealt (``common.dealt_join``). Within a conversation turns are chained
one by one, in a stream of constant memory; so is the list of ids that end at a node, which
is put together by ranges of ids first. SHA-256 leaves no other way; a task may so get all
turns of one conversation, and all ids that end at one node, but no text.

Turns are ordered by number, null first, and by digest where numbers are equal; null role or
text is empty. Rows without a conversation id take no part. Rows that repeat a turn are
turns of their own. Conversations without a turn left are members of the root, which has no
text. Other columns are ignored. No conversations, no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, dealt_join, parts, word_count

ROOT = hashlib.sha256(b"").digest()
NONE = hashlib.sha256(b"").hexdigest()
PIECE = 1 << 16


def numbered_turns(rows: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv_id, at, own, words): each turn's place, from 0, its digest and its words."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    own = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    short = rows.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), own.alias("own"), word_count(text).alias("words")).where("conv_id is not null")
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "own")) - 1
    return short.withColumn("at", at).drop("turn")


def rebuilt(turns: DataFrame, base: Column, head: Column, heads: int) -> DataFrame:
    """(conv_id, part, at, own, words): for each conversation a row of part -1, then the first ``head`` turns of its base (fewer than ``heads``), then its own after as many."""
    every = turns.where("at = 0").select("conv_id")
    none = [F.lit(-1).alias("part"), F.lit(0).alias("at"), F.lit(b"").alias("own"), F.lit(0).cast("long").alias("words")]
    wanted = every.select("conv_id", base.alias("base"), head.alias("head")).where("head > 0")
    first = turns.where(F.col("at") < heads - 1).join(wanted.select("base", "head", F.col("conv_id").alias("into")), F.col("conv_id") == F.col("base")).where("at < head")
    rest = turns.where(F.col("at") >= head).select("conv_id", F.lit(1).alias("part"), "at", "own", "words")
    return every.select("conv_id", *none).unionByName(first.select(F.col("into").alias("conv_id"), F.lit(0).alias("part"), "at", "own", "words")).unionByName(rest)


def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The prefixes of sorted conversations; whether a prefix is the whole is known when the next row is."""
    conv, depth, digest, words = None, 0, ROOT, 0
    for b in batches:
        out = []
        for c, part, own, n in zip(*(b.column(k).to_pylist() for k in ("conv_id", "part", "own", "words")), strict=True):
            if conv is not None:
                out.append((conv, depth, digest, words, c != conv))
            conv, depth, digest, words = (c, 0, ROOT, 0) if part < 0 else (c, depth + 1, hashlib.sha256(digest + own).digest(), n)
        if out:
            yield prefix_rows(out)
    if conv is not None:
        yield prefix_rows([(conv, depth, digest, words, True)])


def prefix_rows(rows: list[tuple]) -> pa.RecordBatch:
    c, d, h, n, last = zip(*rows, strict=True)
    return pa.record_batch([pa.array(c, pa.int64()), pa.array(d, pa.int32()), pa.array(h, pa.binary()), pa.array(n, pa.int64()), pa.array(last, pa.bool_())], ["conv_id", "depth", "digest", "words", "last"])


def id_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids sorted by (digest, id), as pieces of text of one digest each; from is the first id of a piece."""
    key, first, text, size = None, 0, [], 0

    def piece() -> pa.RecordBatch:
        return pa.record_batch([pa.array([key], pa.binary()), pa.array([first], pa.int64()), pa.array([",".join(text)])], ["digest", "from", "ids"])

    for b in batches:
        for h, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if text and (h != key or size > PIECE):
                yield piece()
                text, size = [], 0
            if not text:
                key, first = h, c
            text.append(str(c))
            size += len(text[-1]) + 1
    if text:
        yield piece()


def list_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of all pieces of each key, sorted by (key, from)."""
    key, sha = None, None

    def row() -> tuple[bytes, str]:
        return key, sha.hexdigest()

    for b in batches:
        out = []
        for h, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if h != key:
                if sha is not None:
                    out.append(row())
                key, sha = h, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ids.encode())
        if out:
            yield pa.record_batch([pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out])], ["digest", "ends_sha256"])
    if sha is not None:
        yield pa.record_batch([pa.array([key], pa.binary()), pa.array([sha.hexdigest()])], ["digest", "ends_sha256"])


def end_digests(prefixes: DataFrame) -> DataFrame:
    """(digest, ends_sha256) of the nodes at which conversations end; their ids in order, joined by commas."""
    n = parts(prefixes.sparkSession)
    ends = prefixes.where("last").select("digest", "conv_id").repartitionByRange(n, "digest", "conv_id").sortWithinPartitions("digest", "conv_id")
    pieces = ends.mapInArrow(id_lists, "digest binary, `from` long, ids string")
    return pieces.repartition(n, "digest").sortWithinPartitions("digest", "from").select("digest", "ids").mapInArrow(list_digests, "digest binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, every: int = 20, heads: int = 4, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node.

    Conversations are rebuilt first: c takes the first h turns of c - c % every in place of its
    own, h = crc32 of its decimal id % ``heads``; ``heads=1`` leaves them as they are."""
    spark = conversations.sparkSession
    scratch, node = Scratch(spark, "trie"), ["depth", "digest"]
    turns = scratch.keep(numbered_turns(conversations, id_col, turn_col, role_col, text_col), "turns")
    conv = F.col("conv_id")
    whole = rebuilt(turns, conv - conv % every, (F.crc32(conv.cast("string")) % heads).cast("int"), heads)
    in_order = whole.repartition(parts(spark), "conv_id").sortWithinPartitions("conv_id", "part", "at").select("conv_id", "part", "own", "words")
    prefixes = scratch.keep(in_order.mapInArrow(chained, "conv_id long, depth int, digest binary, words long, last boolean"), "prefixes")
    scratch.drop("turns")
    nodes = prefixes.groupBy(*node).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"))
    nodes = scratch.keep(nodes, "nodes")

    # Where runs hang off, and what is above their heads.
    tops = nodes.groupBy("conv_id").agg(F.min("depth").alias("top"))
    above = scratch.keep(prefixes.select("conv_id", *node).join(tops, "conv_id").where("depth < top"), "above")
    joined = above.where("depth = top - 1").groupBy(*node).agg(F.count(F.lit(1)).alias("joined"))

    # Sums within runs, from the last node up.
    up = Window.partitionBy("conv_id").orderBy(F.desc("depth"))
    so_far = up.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = nodes.join(joined, node, "left").withColumn("joined", F.coalesce("joined", F.lit(0)))
    own = own.select(
        "conv_id", *node, "n_convs", "joined", F.sum((F.col("n_convs") - 1) * F.col("words")).over(so_far).alias("saved"), (F.first("joined").over(so_far) == 0).cast("long").alias("leaf"),
        (F.row_number().over(up) > 1).cast("long").alias("inner"), F.lead("depth").over(up).isNull().alias("is_top"),
    )
    own = scratch.keep(own, "own")

    # The sums of each run go to all ancestors of its head; the head finds the node that it hangs off.
    runs = own.where("is_top").select("conv_id", "saved", "leaf")
    below = above.join(runs, "conv_id").groupBy(*node).agg(F.sum("saved").alias("saved_below"), F.sum("leaf").alias("leaves_below"))
    keys = own.where("joined > 0").select(*node, "joined", F.col("conv_id").alias("parent"))
    parents = dealt_join(above.where("depth = top - 1").select("conv_id", *node), keys, node, "joined", ["conv_id"]).select("conv_id", "parent", F.lit(True).alias("is_top"))

    out = own.join(below, node, "left").join(end_digests(prefixes), "digest", "left").join(parents, ["conv_id", "is_top"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), F.when(F.col("is_top"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs",
        (F.col("joined") + F.col("inner")).alias("n_children"), (F.col("leaf") + zero("leaves_below")).alias("n_leaves"), (F.col("saved") + zero("saved_below")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NONE)).alias("ends_sha256"),
    )
