"""Conversations, sampling, splits and padded batches for building data sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import IMAGE_TOKEN, choose

# Prompts for descriptions, classes and captions.
DESCRIBE = ("Describe this galaxy.", "Provide a short description of the galaxy in this image.", "What does this astronomical image show?", "Describe the morphology of the galaxy in the image.")
CLASSIFY = ("What type of galaxy is shown in this image?", "Classify the morphology of this galaxy.", "Which galaxy morphology class does this image belong to?")
CAPTION = ("Describe this astronomical image.", "What does this image show?", "Provide a detailed description of this image.", "Explain what is depicted in this astronomical image.")


def human_or_gpt(role: Column) -> Column:
    """Every role that is not the human's is the model's."""
    return F.when(role.isin("human", "user"), "human").otherwise("gpt")


def question_answers(turns: DataFrame) -> DataFrame:
    """(conv_id, qa_id, turn, question, answer) from turns (conv_id, turn, role, text).

    A model turn with text answers the human turn right before it, blank model turns aside;
    a later human turn replaces an earlier one. System turns are left out."""
    own = turns.where(F.col("role") != "system").withColumn("role", human_or_gpt(F.col("role")))
    own = own.where((F.col("role") == "human") | (F.trim(F.coalesce("text", F.lit(""))) != ""))
    order = Window.partitionBy("conv_id").orderBy("turn")
    paired = own.withColumn("before", F.lag("role").over(order)).withColumn("question", F.lag("text").over(order))
    paired = paired.where("role = 'gpt' and before = 'human'").withColumn("n", F.row_number().over(order) - 1)
    return paired.select("conv_id", F.concat(F.col("conv_id").cast("string"), F.lit("_qa"), F.col("n").cast("string")).alias("qa_id"), "turn", "question", F.col("text").alias("answer"))


def conversations(turns: DataFrame) -> DataFrame:
    """One row for each conversation: array of (from, value) in turn order."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", human_or_gpt(F.col("role")).alias("from"), F.col("text").alias("value"))))
    return turns.groupBy("conv_id").agg(F.transform(ordered, lambda x: F.struct(x["from"].alias("from"), x["value"].alias("value"))).alias("conversations"))


def from_lists(conversation: Column) -> Column:
    """Turns from a struct of two lists."""
    zipped = F.arrays_zip(conversation["from"].alias("from"), conversation["value"].alias("value"))
    return F.transform(zipped, lambda x: F.struct(human_or_gpt(x["from"]).alias("from"), x["value"].alias("value")))


def with_image_token(turns: Column) -> Column:
    """The image token goes before the first turn, unless some turn has it."""
    has = F.exists(turns, lambda x: F.contains(x["value"], F.lit(IMAGE_TOKEN)))
    put = F.transform(turns, lambda x, i: F.struct(x["from"].alias("from"), F.when(i == 0, F.concat(F.lit(f"{IMAGE_TOKEN}\n"), x["value"])).otherwise(x["value"]).alias("value")))
    return F.when(has, turns).otherwise(put)


def last_turn(turns: Column, role: str) -> Column:
    return F.try_element_at(F.filter(turns, lambda x: x["from"] == role), F.lit(-1))["value"]


def bucket(id_: Column, seed: int) -> Column:
    """A hash of id and seed in [0, 1), the same in any engine with md5."""
    head = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), id_.cast("string"))), 1, 8)
    return F.conv(head, 16, 10).cast("double") / float(1 << 32)


def draw(id_: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), id_.cast("string")))


def group_split(rows: DataFrame, group: str, fraction: float, seed: int = 42) -> DataFrame:
    """All rows of a group on one side: test for about this fraction of groups, else train."""
    return rows.withColumn("split", F.when(bucket(F.col(group), seed) < fraction, "test").otherwise("train"))


FEW, DIGITS = 10_000, 3


def smallest(rows: DataFrame, draws: Column, wanted: dict[str, int], stratum: Column | None = None, tie: str | None = None) -> DataFrame:
    """Of each stratum, the ``wanted`` rows of smallest draws (hexadecimal texts), ties by ``tie``.

    A threshold is found first: rows are counted by the next DIGITS digits of their draws, the
    digits that hold the last wanted row are kept, and rows that begin with these are counted
    by the digits after, until about FEW are left. Rows below the threshold are taken as they
    are, without a sort or a shuffle; only those at it are sorted. The driver sees counts, 16 **
    DIGITS for each stratum at most."""
    rows = rows.withColumn("__draw", draws).withColumn("__of", stratum if stratum is not None else F.lit(""))
    at = {s: ("", n, None) for s, n in wanted.items() if n > 0}  # digits of the threshold, rows wanted at it, how many there are
    within = lambda s, prefix: (F.col("__of") == s) & F.col("__draw").startswith(prefix)
    open_ = dict(at)
    while open_:
        length = len(next(iter(open_.values()))[0])
        some = rows.where(reduce(lambda a, b: a | b, [within(s, x[0]) for s, x in open_.items()]))
        counts: dict[str, list[tuple[str, int]]] = {}
        for r in some.groupBy("__of", F.substring("__draw", length + 1, DIGITS).alias("d")).agg(F.count(F.lit(1)).alias("n")).collect():
            counts.setdefault(r["__of"], []).append((r["d"], r["n"]))
        for s, (prefix, n, _) in list(open_.items()):
            for d, m in sorted(counts.get(s, [])):
                if m >= n:
                    at[s] = open_[s] = (prefix + d, n, m)
                    break
                n -= m
            else:  # no more rows than wanted
                at[s] = (prefix + "g", 0, 0)
            if at[s][2] <= FEW or not d:
                del open_[s]
    if not at:
        return rows.limit(0).drop("__draw", "__of")
    taken = rows.where(reduce(lambda a, b: a | b, [(F.col("__of") == s) & (F.col("__draw") < prefix) for s, (prefix, _, _) in at.items()]))
    for s, (prefix, n, _) in at.items():
        if n:
            taken = taken.unionByName(rows.where(within(s, prefix)).orderBy("__draw", *([tie] if tie else [])).limit(n))
    return taken.drop("__draw", "__of")


def exact_sample(rows: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows, by hash, in the order of their ids; all, where n is not positive."""
    return rows if n <= 0 else smallest(rows, draw(F.col(id_col), seed), {"": n}, tie=id_col).orderBy(id_col)


def stratified_sample(rows: DataFrame, id_col: str, stratum: str, first: str, n: int, seed: int = 42) -> DataFrame:
    """Half of n from the stratum ``first``, the rest from the others; what one side lacks the other gives."""
    side = F.when(F.col(stratum) == first, "a").when(F.col(stratum) != first, "b")
    have = {r["s"]: r["n"] for r in rows.groupBy(side.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()}
    b = min(have.get("b", 0), n - min(have.get("a", 0), n // 2))
    return smallest(rows, draw(F.col(id_col), seed), {"a": min(have.get("a", 0), n - b), "b": b}, side, id_col)


def masked_labels(ids: Column, prompt_len: Column, max_length: int) -> Column:
    return F.slice(F.transform(ids, lambda x, i: F.when(i < prompt_len, F.lit(-100).cast("bigint")).otherwise(x)), 1, max_length)


def padded_batches(rows: DataFrame, batch: str, max_length: int, pad: int = 0) -> DataFrame:
    """input_ids, labels and attention_mask of one length in each batch."""
    longest = F.least(F.max(F.size("ids")).over(Window.partitionBy(batch)), F.lit(max_length))
    out = rows.withColumn("width", longest)
    fill = lambda c, v: F.concat(F.slice(c, F.lit(1), F.col("width")), F.array_repeat(F.lit(v).cast("bigint"), F.greatest(F.col("width") - F.size(c), F.lit(0))))
    ones = F.transform(F.col("ids"), lambda x: F.lit(1).cast("bigint"))
    return out.select("*", fill(F.col("ids"), pad).alias("input_ids"), fill(F.col("labels"), -100).alias("padded_labels"), fill(ones, 0).alias("attention_mask"))


def image_positions(ids: Column, token: int, positions: int = 256) -> Column:
    """The first image token becomes this many positions."""
    return widened(ids, ids, token, positions, F.lit(token).cast("bigint"))


def widened(values: Column, ids: Column, token: int, positions: int, fill: Column) -> Column:
    """Values beside ids, with ``positions`` fills at the first image token's place."""
    at = F.array_position(ids, F.lit(token).cast("bigint")).cast("int")
    wide = F.concat(F.slice(values, F.lit(1), at - 1), F.array_repeat(fill, positions), F.slice(values, at + 1, F.size(values)))
    return F.when(at > 0, wide).otherwise(values)


def expanded_images(rows: DataFrame, token: int, positions: int = 256) -> DataFrame:
    """ids, labels and attention_mask with the image's positions; these are attended to and have no label."""
    big = lambda x: F.lit(x).cast("bigint")
    wide = lambda c, fill: widened(F.col(c), F.col("ids"), token, positions, big(fill)).alias(c)
    rest = [c for c in rows.columns if c not in ("ids", "labels", "attention_mask")]
    return rows.select(*rest, wide("ids", token), wide("labels", -100), wide("attention_mask", 1))


def template_questions(rows: DataFrame, position: str, label: str, names: tuple[str, ...]) -> DataFrame:
    """Adds question, answer and answer_type: even rows ask for the class, odd ones for yes and no by turns (the wrong class is five on)."""
    i, name = F.col(position), lambda k: F.element_at(F.array(*[F.lit(x) for x in names]), (F.pmod(k, F.lit(len(names))) + 1).cast("int"))
    true, wrong = name(F.col(label)), name(F.col(label) + 5)
    even, yes = F.pmod(i, F.lit(2)) == 0, F.pmod(F.floor(i / 2), F.lit(2)) == 0
    ask = lambda n: F.concat(F.lit("Is this galaxy best classified as "), F.lower(n), F.lit("?"))
    question = F.when(even, "What is the morphological classification of this galaxy?").when(yes, ask(true)).otherwise(ask(wrong))
    return rows.select("*", question.alias("question"), F.when(even, true).when(yes, "yes").otherwise("no").alias("answer"), F.when(even, "open").otherwise("closed").alias("answer_type"))


def one_of(options: tuple[str, ...], id_: Column, seed: int) -> Column:
    """One of the options, by a hash of id and seed."""
    return choose(F.floor(bucket(id_, seed) * len(options)).cast("int"), list(options))


def turns_of(question: Column, answer: Column) -> Column:
    """A question on an image, and its answer, as turns."""
    asked = F.struct(F.lit("human").alias("from"), F.concat(F.lit(f"{IMAGE_TOKEN}\n"), question).alias("value"))
    return F.array(asked, F.struct(F.lit("gpt").alias("from"), answer.alias("value")))


def class_conversations(rows: DataFrame, id_col: str, label: str, singular: tuple[str, ...], descriptions: tuple[str, ...], seed: int = 42) -> DataFrame:
    """Adds conversations: half ask for a description, half for the class; which, and in what words, goes by hashes of the id."""
    id_, of = F.col(id_col), lambda values: F.element_at(F.array(*[F.lit(x) for x in values]), F.col(label) + 1)
    describe = bucket(id_, seed) < 0.5
    question = F.when(describe, one_of(DESCRIBE, id_, seed + 1)).otherwise(one_of(CLASSIFY, id_, seed + 1))
    answer = F.when(describe, of(descriptions)).otherwise(F.concat(F.lit("This image shows "), of(singular), F.lit(". "), of(descriptions)))
    return rows.select("*", turns_of(question, answer).alias("conversations"))


def caption_conversations(rows: DataFrame, id_col: str, caption: str, seed: int = 42) -> DataFrame:
    """Rows with a caption that is not blank, and their conversations: a prompt by a hash of the id, and the caption."""
    own = rows.where(F.trim(F.coalesce(caption, F.lit(""))) != "")
    return own.select("*", turns_of(one_of(CAPTION, F.col(id_col), seed), F.trim(caption)).alias("conversations"))
