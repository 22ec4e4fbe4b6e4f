"""Scalar text functions as Column expressions: normalisers, matching, tokens, specifics."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What results depend on.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ARTICLES = ("a", "an", "the")
IMAGE_TOKEN = "<image>"
CAPTION_PROMPTS = ("describe this astronomical image", "describe this image", "caption this image")
INSTRUMENTS = (
    "alma",
    "atacama large millimeter/submillimeter array",
    "chandra",
    "gaia",
    "hubble",
    "hst",
    "herschel",
    "james webb",
    "jwst",
    "keck",
    "pan-starrs",
    "panstarrs",
    "sdss",
    "sloan digital sky survey",
    "spitzer",
    "subaru",
    "vla",
    "very large array",
    "vlt",
    "very large telescope",
    "wise",
    "xmm-newton",
)
CATALOG_PATTERNS = (
    r"\b(?:NGC|IC|UGC|PGC|ESO|ARP|ABELL|ACO|SH2|SH|BARNARD)\s*[-]?\s*\d+[A-Z]?\b",
    r"\bM\s*\d{1,3}[A-Z]?\b",
    r"\bMESSIER\s+\d{1,3}[A-Z]?\b",
    r"\b(?:2MASS|WISEA|SDSS|GAIA)\s+[A-Z0-9.+-]+\b",
)
MEASUREMENT_PATTERN = (
    r"(?i)\b\d+(?:\.\d+)?\s*(?:thousand|million|billion)?\s*"
    r"(?:light[-\s]?years?|ly|parsecs?|pc|kpc|mpc|gpc|au|astronomical units?|arcseconds?|arcminutes?|degrees?|kelvin|k|solar masses|magnitude|mag)\b"
)
REDSHIFT_PATTERN = r"(?i)\bz\s*[=~]\s*\d+(?:\.\d+)?\b"
YEAR_PATTERN = r"\b(?:1[6-9]\d{2}|20\d{2})\b"
SPECIFIC_PREFIX = r"\b(ngc|ic|ugc|pgc|eso|arp|abell|aco|sh2|sh|barnard|m)\s*-?\s*"


def normalize_words(text: Column) -> Column:
    """Lower case, ASCII punctuation out, articles out, single spaces."""
    bare = F.translate(F.trim(F.lower(text)), PUNCTUATION, "")
    return F.array_join(F.filter(F.split(bare, r"(?U)\s+"), lambda w: (w != "") & ~w.isin(*ARTICLES)), " ")


def normalize_unicode(text: Column) -> Column:
    """Lower case, everything but word characters and white space out, articles out; keeps underscores."""
    bare = F.regexp_replace(F.lower(text), r"(?U)[^\w\s]", "")
    return F.array_join(F.filter(F.split(bare, r"(?U)\s+"), lambda w: (w != "") & ~w.isin(*ARTICLES)), " ")


def exact_match(prediction: Column, gold: Column, normalize=normalize_words) -> Column:
    """Equal, or the gold's words stand together in the prediction; an empty gold only matches an empty prediction."""
    p, g = normalize(prediction), normalize(gold)
    return F.when(g == "", p == "").otherwise((p == g) | F.contains(F.concat(F.lit(" "), p, F.lit(" ")), F.concat(F.lit(" "), g, F.lit(" "))))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def words_of(normalized: Column) -> Column:
    return F.filter(F.split(normalized, " "), lambda w: w != "")


def overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays: both sorted into one, and each word's run counted once."""
    tagged = lambda xs, left: F.transform(xs, lambda x: F.struct(x.alias("w"), F.lit(left).alias("left")))
    every = F.sort_array(F.concat(tagged(a, 1), tagged(b, 0)))
    start = F.struct(F.lit("").alias("w"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("n"))

    def step(s: Column, x: Column) -> Column:
        same, left = s["w"] == x["w"], x["left"]
        count = lambda k, one: F.when(same, s[k]).otherwise(0) + one
        done = s["n"] + F.when(same, 0).otherwise(F.least(s["a"], s["b"]))
        return F.struct(x["w"].alias("w"), count("a", left).alias("a"), count("b", 1 - left).alias("b"), done.alias("n"))

    return F.aggregate(every, start, step, lambda s: s["n"] + F.least(s["a"], s["b"]))


def token_f1(prediction: Column, gold: Column) -> Column:
    def score(x: Column) -> Column:
        p, g = x["p"], x["g"]
        same = overlap(p, g).cast("double")
        return F.when((F.size(p) == 0) | (F.size(g) == 0), (F.size(p) == F.size(g)).cast("double")).otherwise(2 * same / (F.size(p) + F.size(g)))

    # The words are computed once for each row, however often they are used.
    words = F.struct(words_of(normalize_words(prediction)).alias("p"), words_of(normalize_words(gold)).alias("g"))
    return F.transform(F.array(words), score)[0]


def answer_type(answer: Column, normalized: bool) -> Column:
    """closed for yes or no, else open; by the trimmed text, or by its normal form."""
    text = normalize_words(answer) if normalized else F.lower(F.trim(answer))
    return F.when(text.isin("yes", "no"), "closed").otherwise("open")


def clean_prompt(prompt: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(prompt, F.lit(IMAGE_TOKEN), F.lit(" ")), r"(?U)\s+", " "))


def prompt_key(prompt: Column) -> Column:
    return normalize_words(clean_prompt(prompt))


def record_type(variant: str, explicit: Column, id_: Column, prompt: Column) -> Column:
    """caption or qa. Variants: (a) field with caption first, then id, caption prompts, prompt;
    (b) the same without caption prompts; (c) field with qa first, then id; (d) id only."""
    kind, id_ = F.lower(F.coalesce(explicit, F.lit(""))), F.lower(F.coalesce(id_, F.lit("")))
    qa_id = F.contains(id_, F.lit("_qa"))
    if variant == "d":
        return F.when(qa_id, "qa").otherwise("caption")
    if variant == "c":
        return F.when(F.contains(kind, F.lit("qa")), "qa").when(F.contains(kind, F.lit("caption")), "caption").when(qa_id, "qa").otherwise("caption")
    out = F.when(F.contains(kind, F.lit("caption")), "caption").when(F.contains(kind, F.lit("qa")), "qa").when(qa_id | F.endswith(id_, F.lit("qa")), "qa")
    if variant == "a":
        out = out.when(prompt_key(prompt).isin(*CAPTION_PROMPTS), "caption")
    return out.when(clean_prompt(F.coalesce(prompt, F.lit(""))) != "", "qa").otherwise("caption")


def normalize_specific(value: Column) -> Column:
    """Lower case, messier as m, single spaces, catalogue name and number joined."""
    out = F.regexp_replace(F.trim(F.lower(value)), r"\bmessier\s+", "m")
    return F.regexp_replace(F.regexp_replace(out, r"\s+", " "), SPECIFIC_PREFIX, "$1")


#: Catalogue numbers that never overlap, as one alternation: a name, then digits at once or behind white space and a hyphen.
NUMBERED = "|".join(CATALOG_PATTERNS[:3])
#: All instruments as one alternation; none begins where another ends. The class of first letters saves most tries.
NAMED = rf"\b(?=[{''.join(sorted({n[0] for n in INSTRUMENTS}))}])(?:{'|'.join(re.escape(n) for n in INSTRUMENTS)})\b"


def specifics(text: Column) -> Column:
    """Sorted distinct catalogue numbers, measurements, redshifts, years and instruments in a text.

    A text is put in upper and lower case once, and read by six patterns at most; all but
    those of names need a digit, and are tried only where there is one."""
    every = lambda where, pattern: F.regexp_extract_all(where, F.lit(pattern), F.lit(0))
    none = F.array().cast("array<string>")

    def found(x: Column) -> Column:
        numbers = F.concat(every(x["upper"], NUMBERED), *[every(x["text"], p) for p in (MEASUREMENT_PATTERN, REDSHIFT_PATTERN, YEAR_PATTERN)])
        # Marks like superscripts are digits to neither the patterns nor this test.
        return F.concat(F.when(x["text"].rlike("[0-9]"), numbers).otherwise(none), every(x["upper"], CATALOG_PATTERNS[3]), F.array_distinct(every(x["lower"], NAMED)))

    text = F.coalesce(text, F.lit(""))
    cases = F.array(F.struct(text.alias("text"), F.upper(text).alias("upper"), F.lower(text).alias("lower")))
    return F.array_sort(F.array_distinct(F.transform(F.transform(cases, found)[0], normalize_specific)))


def unsupported(prediction: Column, answer: Column) -> Column:
    return F.array_sort(F.array_except(specifics(prediction), specifics(answer)))


def supported(prediction: Column, answer: Column) -> Column:
    return F.array_sort(F.array_intersect(specifics(prediction), specifics(answer)))


def shorten(text: Column, limit: int) -> Column:
    """White space collapsed; longer texts cut to limit - 3 and closed by dots."""
    flat = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(F.left(flat, F.lit(limit - 3))), F.lit("...")))


def safe_name(name: Column, fallback: str) -> Column:
    cleaned = F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_")
    return F.coalesce(F.nullif(F.trim(cleaned, F.lit("._")), F.lit("")), F.lit(fallback))


def first_present(*columns: Column) -> Column:
    """The first that is not null (it may be empty)."""
    return F.coalesce(*columns)


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor blank."""
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in columns])


def as_number(value: Column) -> Column:
    """A double; true and false are 1 and 0; null where the text is no number."""
    text = F.lower(F.trim(value.cast("string")))
    return F.when(text == "true", 1.0).when(text == "false", 0.0).otherwise(text.try_cast("double"))


def choose(index: Column, options: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in options]), (F.pmod(index, F.lit(len(options))) + 1).cast("int"))


def chat_prompt(context: Column, question: Column, system: str = "You are a helpful assistant.") -> Column:
    """System, user with the image token first, and an open assistant turn."""
    body = F.concat(F.lit(f"{IMAGE_TOKEN}\n"), F.when(context != "", F.concat(context, F.lit("\n\n"))).otherwise(""), question)
    return F.concat(F.lit(f"<|im_start|>system\n{system}<|im_end|>\n<|im_start|>user\n"), body, F.lit("<|im_end|>\n<|im_start|>assistant\n"))


def decoded_answer(text: Column, marker: str = "<|im_start|>assistant\n", end: str = "<|im_end|>") -> Column:
    return F.trim(F.substring_index(F.substring_index(text, marker, -1), end, 1))


def joined_reasons(reasons: list[tuple[str, Column]], default: str) -> Column:
    """All labels that hold, joined by semicolons."""
    return F.coalesce(F.nullif(F.concat_ws(";", *[F.when(c, label) for label, c in reasons]), F.lit("")), F.lit(default))


def row_key(image: Column, kind: Column, prompt: Column, answer: Column, id_: Column, index: Column, whole: Column) -> Column:
    """Array key: by content where image and prompt are there, else by id, by index, or by the whole row."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    content = F.array(F.lit("content"), text(image), text(kind), prompt_key(text(prompt)), normalize_words(text(answer)))
    return (
        F.when((text(image) != "") & (clean_prompt(text(prompt)) != ""), content)
        .when(text(id_) != "", F.array(F.lit("id"), text(id_)))
        .when(index.isNotNull(), F.array(F.lit("index"), text(index)))
        .otherwise(F.array(F.lit("row"), whole))
    )


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def warm_up_cosine(step: Column, warm_up: int, total: int, peak: float, least: float = 0.1) -> Column:
    """Learning rate: linear warm-up, then a half cosine down to peak x least."""
    done = (step - warm_up) / max(1, total - warm_up)
    cosine = 0.5 * (1 + F.cos(F.lit(3.141592653589793) * F.least(done, F.lit(1.0))))
    return peak * F.when(step < warm_up, step / max(1, warm_up)).otherwise(F.greatest(F.lit(least), cosine))
