"""Line-first quality rules, DataFrame operations only.

Every line is judged by itself: punctuation (a line of mostly symbols, or of words with the same symbols stuck to each),
navigation (a line of items with separators between them) and boilerplate (licence, cookie and menu phrases).
Failing lines go; a document that loses too much of its words with them is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, WORD

#: Phrases that mark a line as boilerplate, whole words, letters A to Z in either case.
BOILERPLATE = ("all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "accept cookies", "licensed under", "powered by")
#: A part of each phrase whose absence from a text rules the phrase out.
TRIGGERS = ("rights reserved", "terms of", "privacy", "cookie", "licensed", "powered")
#: A line fails on punctuation if more than this share of its words hold a symbol or end in two exclamation marks.
MAX_ODD_WORDS = 0.3
#: A line fails as navigation if it has at least this many separators a word.
NAV_SHARE = 0.34
#: A document is rejected if failing lines hold more than this share of its words.
MAX_LOST = 0.5
MIN_WORDS = 10
#: Words of a window whose repetition counts.
SPAN = 5


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def phrases() -> str:
    """The phrases as one pattern, which any engine reads alike."""
    return "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in x) for x in BOILERPLATE)


def has_phrase(text: Column) -> Column:
    return text.rlike(r"(?<![^\x20\x09-\x0D])(?:" + phrases() + r")(?![^\x20\x09-\x0D.,;:!?)])")


def line_fails(line: Column) -> Column:
    """The rule that a line fails: 'punctuation', 'navigation', 'boilerplate', or null. Lines without words pass."""
    words = _count(line, WORD)
    odd = _count(line, r"[#*$%&<>]|!!")
    bars = _count(line, r"[|»›•]| > ")
    return (
        F.when(words == 0, None)
        .when(odd > MAX_ODD_WORDS * words, F.lit("punctuation"))
        .when(bars >= NAV_SHARE * words, F.lit("navigation"))
        .when(has_phrase(line), F.lit("boilerplate"))
    )


def may_fail(text: Column) -> Column:
    """False only if no line of the text can fail: it spares line_fails on most texts and changes no result.

    A phrase holds its trigger, and lower() makes A to Z small wherever they stand.
    """
    low = F.lower(text)
    found = text.rlike("[#*$%&<>|»›•]|!!")
    for trigger in TRIGGERS:
        found = found | low.contains(trigger)
    return found


def with_windows(df: DataFrame) -> DataFrame:
    """Adds grams, a 64-bit hash of every window of SPAN words: of words, then of two, four and five neighbours."""
    pair = lambda a, b, k: F.zip_with(a, F.slice(b, k + 1, F.size("words")), lambda x, y: F.xxhash64(x, y))
    one = df.withColumn("h1", F.transform("words", lambda x: F.xxhash64(x)))
    two = one.withColumn("h2", pair("h1", "h1", 1))
    four = two.withColumn("h4", pair("h2", "h2", 2))
    return four.withColumn("grams", F.slice(pair("h4", "h1", 4), 1, F.greatest(F.size("words") - (SPAN - 1), F.lit(0)))).drop("h1", "h2", "h4")


def covered_words(grams: Column) -> Column:
    """Words inside windows that occur twice or more, in n log n: sorted windows equal to a neighbour are repeated,
    and the words they cover are the gaps between repeated starts, SPAN at most."""
    let = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)  # noqa: E731  each is evaluated once
    at = lambda s, i: F.get(s, i)["g"]

    def starts(s: Column) -> Column:
        same = F.transform(s, lambda x, i: F.when((at(s, i - 1) == x["g"]) | (at(s, i + 1) == x["g"]), x["i"]))
        return F.sort_array(F.array_compact(same))

    def total(p: Column) -> Column:
        gaps = F.transform(p, lambda x, i: F.least(F.lit(SPAN), F.coalesce(F.get(p, i + 1) - x, F.lit(SPAN))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    placed = F.arrays_zip(grams.alias("g"), F.sequence(F.lit(1), F.size(grams)).alias("i"))
    return let(F.sort_array(placed.cast("array<struct<g:bigint,i:int>>")), lambda s: let(starts(s), total))


def rules(docs: DataFrame) -> DataFrame:
    """(doc_id, counts, base_failed, n_failed_lines, n_lost_words, kept, cleaned) for every row of docs(doc_id, text).

    A null text has no words and fails; so does an empty one. cleaned is the text without failing lines. Repeated rows
    stay; extra columns are ignored; no rows in, no rows out.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select("doc_id", text.alias("text")).select(
        "doc_id", "text", F.array_remove(F.split("text", BLANK), "").alias("words"), F.split("text", "\n").alias("lines")
    )
    cut = with_windows(split).withColumn("full", F.filter("lines", lambda x: x.rlike(WORD)))
    judged = F.transform("lines", lambda x: F.struct(x.alias("line"), line_fails(x).alias("rule"), _count(x, WORD).alias("n")))
    counted = cut.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.when(F.col("text").rlike("[#*$%&|<>]"), _count(F.col("text"), "[#*$%&|<>]")).otherwise(0).cast("long").alias("n_symbols"),
        (F.size("full") - F.size(F.array_distinct("full"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("grams")) == F.size("grams"), F.lit(0)).otherwise(covered_words(F.col("grams"))).cast("long").alias("n_repeat_words"),
        "text",
        F.when(may_fail(F.col("text")), judged).alias("judged"),
    )
    lost = F.filter("judged", lambda x: x["rule"].isNotNull())
    kept_lines = F.transform(F.filter("judged", lambda x: x["rule"].isNull()), lambda x: x["line"])
    out = counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
        F.coalesce(F.size(lost), F.lit(0)).cast("long").alias("n_failed_lines"),
        F.coalesce(F.aggregate(lost, F.lit(0).cast("long"), lambda a, x: a + x["n"]), F.lit(0)).alias("n_lost_words"),
        F.coalesce(F.array_join(kept_lines, "\n"), "text").alias("cleaned"),
    )
    kept = ~F.col("base_failed") & (F.col("n_lost_words") <= MAX_LOST * F.col("n_words"))
    return out.select(*out.columns[:-1], kept.alias("kept"), "cleaned")
