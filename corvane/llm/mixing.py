"""Mixing sources to target weights by pivotal dependent rounding (operator 12).

Sources, in the order of their code points and null last, weigh 5, 2, 1, 5, 2, ... and share
all words by weight. A source's target stops at ``most`` times its size; the excess is
reshared among the others until no target is above. So each document of a source is wanted
``target / source_size`` times: the whole part is taken as copies, the fraction is a
probability of one more copy.

Fractions are settled in pairs. Of two documents of one source, words of the one's expected
taking move to the other, to either side with the chances that keep both expectations, until
one of them is taken or left for certain; the other one goes on to the next pair. The words
that the pair takes in all are the same before and after, so a source's taking stays at its
target. Documents of a group are paired from the longest to the shortest, which leaves a
short one over; groups of about ``fan_in`` documents leave one each, these are grouped
again, and so on up a tree until one document of each source is left. It has no partner
and rounds to the nearer side: a source misses its target by at most half of its words.

Scale: texts are read once, for their sizes; only ids and numbers are shuffled. Rows that
agree in id, source and size are one row with a count. Groups are dealt by hash, about
``fan_in`` rows of one source each, so a hot source is as many groups as it needs, and each
level of the tree has ``fan_in`` times fewer rows. Choices are hashes of the rows, so
reruns agree, whatever tasks are lost. Targets are found by rounds over the table of
sources, which may be large; only sums of it reach the driver. Functions of Spark only.

Null or empty texts have size 0 and are taken 0 times; so are the texts of a source without
words. Rows without an id are mixed like others; equal rows share their copies as evenly as
these go. Other columns are ignored, whatever their names. No rows, no result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, dealt_join, parts, word_count

# The weights in turn, and how many times its size a source gives at most.
WEIGHTS, MOST = (5, 2, 1), 3


def in_order(sources: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds nth, from 0, in the order of (no_source, source): ranges are numbered by themselves, behind the rows before them."""
    ranged = sources.repartitionByRange(parts(scratch.spark), "no_source", "source").withColumn("range", F.spark_partition_id())
    ranged = scratch.keep(ranged, "ranged")
    sizes = {r["range"]: r["n"] for r in ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each range
    before, total = [], 0
    for k in sorted(sizes):
        before += [F.lit(k), F.lit(total)]
        total += sizes[k]
    within = F.row_number().over(Window.partitionBy("range").orderBy("no_source", "source")) - 1
    first = F.create_map(*before)[F.col("range")] if before else F.lit(0)
    return ranged.withColumn("nth", (first + within).cast("long")).drop("range")


def with_targets(sources: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """Adds target to sources (source_size, nth): shares by weight, none above ``most`` times its size."""
    sources = sources.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int")).cast("long"))
    r = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("words"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight")).first()
    total, left, weight, full, cap = r["words"], r["words"], r["weight"], -1, most * F.col("source_size")
    while True:  # every round reshares what the sources that are full leave to the others
        share = F.lit(float(left)) * F.col("weight") / float(weight or 1)
        above = share > cap
        r = sources.agg(F.count_if(above).alias("full"), F.coalesce(F.sum(F.when(above, cap)), F.lit(0)).alias("given"), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)).alias("weight")).first()
        if r["full"] <= full:
            break
        left, weight, full = total - r["given"], r["weight"], r["full"]
    return sources.withColumn("target", F.least(share, cap.cast("double"))).drop("weight")


def paired(held: Column, x: Column) -> Column:
    """One pair: words move between the document that is held and the next until one of the two is settled."""
    a, m, b, q = held["size"].cast("double"), held["mass"], x["size"].cast("double"), x["mass"]
    up, down = F.least(a - m, q), F.least(m, b - q)
    rises = x["chance"] * (up + down) < down
    # held: the settled one is the one held; taken: whether it is taken; mass: what the other then expects.
    fate = lambda held, taken, mass: F.struct(F.lit(held).alias("held"), F.lit(taken).alias("taken"), mass.alias("mass"))
    rising = F.when(a - m <= q, fate(True, True, q - (a - m))).otherwise(fate(False, False, m + q))
    falling = F.when(m <= b - q, fate(True, False, q + m)).otherwise(fate(False, True, m - (b - q)))
    return F.when(rises, rising).otherwise(falling)


ROW = ("size", "doc_id", "n", "whole")


def settled_groups(rows: DataFrame, level: int, seed: int, fan_in: int) -> DataFrame:
    """(nth, source_size, target, groups, held, done): each group's documents settled but for one."""
    key = [F.col("doc_id"), F.col("size")]
    chance = F.shiftrightunsigned(F.xxhash64(F.lit(f"chance {seed} {level}"), *key), 11) / float(2**53)
    dealt = rows.withColumn("chance", chance).withColumn("group", F.pmod(F.xxhash64(F.lit(f"group {seed} {level}"), *key), F.col("groups")))
    members = F.sort_array(F.collect_list(F.struct(*ROW, "mass", "chance")), asc=False)
    groups = dealt.groupBy("nth", "group").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.first("groups").alias("groups"), members.alias("members"))
    one = F.struct(*[F.col("members")[0][c].alias(c) for c in (*ROW, "mass")])
    empty = F.array().cast("array<struct<size:bigint,doc_id:bigint,n:bigint,whole:bigint,taken:boolean>>")

    def merge(s: Column, x: Column) -> Column:
        fate = F.array(paired(s["held"], x))  # bound once, as the only value of an array
        next_ = F.transform(fate, lambda f: F.struct(
            F.struct(*[F.when(f["held"], x[c]).otherwise(s["held"][c]).alias(c) for c in ROW], f["mass"].alias("mass")).alias("held"),
            F.concat(s["done"], F.array(F.struct(*[F.when(f["held"], s["held"][c]).otherwise(x[c]).alias(c) for c in ROW], f["taken"].alias("taken")))).alias("done"),
        ))
        return next_[0]

    made = F.aggregate(F.slice("members", F.lit(2), F.size("members")), F.struct(one.alias("held"), empty.alias("done")), merge)
    out = groups.select("nth", "source_size", "target", F.ceil(F.col("groups") / fan_in).cast("long").alias("groups"), made.alias("made"))
    return out.select("nth", "source_size", "target", "groups", "made.held", "made.done")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 42, fan_in: int = 128, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) of each document; taken is its size times its copies."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).isNull().alias("no_source"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), word_count(F.col(text_col)).alias("size"))
    items = scratch.keep(sized.groupBy("doc_id", "no_source", "source", "size").agg(F.count(F.lit(1)).alias("n")), "items")
    sources = items.groupBy("no_source", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count(F.lit(1)).alias("rows"))
    sources = scratch.keep(with_targets(in_order(sources, scratch), weights, most), "sources")
    told = dealt_join(items, sources, ["no_source", "source"], "rows", ["doc_id", "size"])
    wanted = F.when(F.col("source_size") > 0, F.col("n") * F.col("target") / F.col("source_size")).otherwise(0.0)
    told = told.withColumn("wanted", wanted).withColumn("whole", F.floor("wanted").cast("long")).withColumn("mass", (F.col("wanted") - F.col("whole")) * F.col("size"))
    told = scratch.keep(told.select("nth", "source_size", "target", F.ceil(F.col("rows") / fan_in).cast("long").alias("groups"), *ROW, "mass"), "told")
    fraction = F.col("mass") > 0
    done = told.where(~fraction).select("source_size", "target", *ROW, F.lit(False).alias("taken"))
    rows, level = told.where(fraction), 0
    most_groups = rows.agg(F.max("groups").alias("n")).first()["n"]
    while most_groups is not None:
        made = scratch.keep(settled_groups(rows, level, seed, fan_in), f"level{level}")
        done = done.unionByName(made.select("source_size", "target", F.explode("done").alias("x")).select("source_size", "target", "x.*"))
        rows, level = made.select("nth", "source_size", "target", "groups", "held.*"), level + 1
        most_groups = -(-most_groups // fan_in) if most_groups > 1 else None
    if level:
        done = done.unionByName(rows.select("source_size", "target", *ROW, (2 * F.col("mass") >= F.col("size")).alias("taken")))
    scratch.drop("items", "ranged", "sources")
    copies = F.col("whole") + F.col("taken").cast("long")
    each = done.withColumn("all", copies).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n"))))
    copies = F.floor(F.col("all") / F.col("n")) + (F.col("i") <= F.col("all") % F.col("n")).cast("long")
    return each.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))
