"""Mixing sources to target weights by hash-threshold histograms, DataFrame operations only.

Each source's target is a number of words. Whole copies of a source come first; what is left of the target is met by the
documents whose hash lies under a threshold. The threshold comes from histograms: words are summed by source and hash
bucket, the bucket in which the running sum passes the budget is found, and only that bucket is cut finer, twice. So no
documents are sorted, thresholds of smaller budgets are nested in those of larger ones, and a rerun takes the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hinted, n_words, stash

#: Each histogram cuts a bucket into 2**BITS; LEVELS of them make 2**36 buckets of a source.
BITS = 12
LEVELS = 3
WEIGHTS = (1, 2, 3)
CAP = 3


def hash_of(doc_id: Column, seed: str = "mix") -> Column:
    """36 bits of MD5, which any engine has; a null doc_id hashes as the empty text."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, BITS * LEVELS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size) -> also target: shares by weight of all words, none above cap times its source.

    Sources by code point, null last, weigh `weights`, repeating. Filling in order of cap over weight ends where
    resharing the excess again and again would: the sources up to a prefix of that order stand at their caps.
    One row a source: the windows here run over the list of sources, never over documents.
    """
    listed = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    weighed = listed.withColumn("w", pick.cast("long")).withColumn("most", F.col("source_size") * cap)
    by_room = Window.orderBy(F.col("most") / F.col("w"), "place")
    before, every = by_room.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    filled = weighed.select(
        "source", "source_size", "w", "most",
        (F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0))).alias("left"),
        (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0))).alias("w_left"),
        F.row_number().over(by_room).alias("turn"),
    ).withColumn("share", F.col("w") * F.col("left") / F.col("w_left"))
    first = F.first(F.when(F.col("share") <= F.col("most"), F.struct("left", "w_left", "turn")), ignorenulls=True).over(Window.orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    at = filled.withColumn("level", first)
    return at.select("source", "source_size", F.when(F.col("turn") >= F.col("level.turn"), F.col("w") * F.col("level.left") / F.col("level.w_left")).otherwise(F.col("most")).cast("double").alias("target"))


def thresholds(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, size, h) and (source, budget) -> (source, below): documents with h < below make up the budget.

    A bucket of the last histogram is taken if that comes nearer to the budget than leaving it.
    """
    state = plan.select("source", F.lit(0).cast("long").alias("prefix"), F.col("budget").alias("room"))
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        here = rows.withColumn("bucket", F.shiftright("h", shift))
        s = state.select(F.col("source").alias("s"), "prefix", "room")
        inside = here.join(s, here.source.eqNullSafe(s.s)).where(F.shiftright("bucket", BITS) == F.col("prefix"))
        sums = inside.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
        run = Window.partitionBy("source").orderBy("bucket")
        upto = sums.withColumn("upto", F.sum("words").over(run)).select(F.col("source").alias("t"), "bucket", "words", "upto")
        joined = s.join(upto, s.s.eqNullSafe(upto.t), "left")
        hit = F.when((F.col("upto") > F.col("room")), F.struct("bucket", "words", (F.col("upto") - F.col("words")).alias("before")))
        state = stash(joined.groupBy(F.col("s").alias("source")).agg(F.min(hit).alias("hit"), F.first("prefix").alias("was"), F.first("room").alias("room")).select(
            "source",
            F.coalesce(F.col("hit.bucket"), F.shiftleft(F.col("was") + 1, BITS)).alias("prefix"),
            F.when(F.col("hit").isNull(), F.lit(0.0)).otherwise(F.col("room") - F.col("hit.before")).alias("room"),
            F.coalesce(F.col("hit.words"), F.lit(0)).alias("words"),
        ))
    return state.select("source", (F.col("prefix") + F.when((F.col("words") > 0) & (F.col("words") - F.col("room") < F.col("room")), 1).otherwise(0)).alias("below"))


def plan(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """rows(source, size, h) -> (s, source_size, target, whole, budget, below), one row a source s: whole copies that all its
    documents go in, and the hash under which a document goes once more."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    aims = targets(sizes, weights, cap)
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(cap))).otherwise(0).cast("long")
    aims = stash(aims.withColumn("whole", whole).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")))
    cut = thresholds(rows, aims).withColumnRenamed("source", "c")
    return aims.join(cut, aims.source.eqNullSafe(cut.c)).drop("c").withColumnRenamed("source", "s")


def copies_of(h: Column, cap: int = CAP) -> Column:
    """How often a document goes, by its hash and its source's row of plan()."""
    return F.col("whole") + ((h < F.col("below")) & (F.col("whole") < cap)).cast("long")


def measured(docs: DataFrame, seed: str = "mix") -> DataFrame:
    return stash(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), hash_of(F.col("doc_id"), seed).alias("h")))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = "mix") -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) for every row of docs(doc_id, text, source).

    copies: how often the mix takes the document, at most cap; taken = copies * size. Null texts have size 0. Rows with
    one doc_id share its hash and go together. A null source is a source, the last. No rows in, no rows out.
    """
    rows = measured(docs, seed)
    per_source = plan(rows, weights, cap)
    copies = copies_of(F.col("h"), cap)
    return rows.join(per_source, rows.source.eqNullSafe(per_source.s)).select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def take_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = "mix") -> DataFrame:
    """docs as the mix takes them: each row as many times as its copies, columns unchanged.

    A row's copies follow from its own doc_id and its source's row of the plan, which is broadcast if sources are few; so no
    text is shuffled.
    """
    own = "mix" + "_" * max(map(len, docs.columns))  # no column of docs has a name so long
    per_source = hinted(stash(plan(measured(docs, seed), weights, cap).select(F.struct("s", "whole", "below").alias(own))))
    p = F.col(own)
    copies = p["whole"] + ((hash_of(docs.doc_id, seed) < p["below"]) & (p["whole"] < cap)).cast("long")
    joined = docs.join(per_source, docs.source.eqNullSafe(p["s"])).where(copies > 0)
    return joined.withColumn(own, F.explode(F.sequence(F.lit(1).cast("long"), copies))).select(*[docs[c] for c in docs.columns])
