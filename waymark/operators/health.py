"""Whether records still point at something: liveness, partial rot, breadth, evidence, review dates, spelling of authors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.records import anchors as anchors_of
from .matching import FIRING, firing, path_pairs, path_values, pattern_pairs, symbol_pairs
from .tables import placed


def anchor_liveness(anchors: DataFrame, files: DataFrame, own_file: bool = True) -> DataFrame:
    """Path and pattern anchors with live: a path anchor covers a tracked path, a pattern hits a path or a content.

    With own_file a pattern's hits in its record's own file do not count. files(path, content), content null if not loaded.
    """
    kinds = anchors.where(F.col("kind").isin("path", "pattern"))
    # What an anchor hits depends on its value; of a value's hits two paths say whether one is not the record's own file.
    different = kinds.select("kind", "value").distinct()
    slim = files.select("path")
    hits = [pattern_pairs(different, side, text).select("kind", "value", "path") for text, side in (("path", slim), ("content", files.where("content <> ''")))]
    found = hits[0].union(hits[1]).groupBy("kind", "value").agg(F.count("*").alias("_n"), F.min("path").alias("_first"), F.max("path").alias("_last"))
    other = (F.col("_first") != F.col("source")) | (F.col("_last") != F.col("source")) if own_file else F.col("_n") > 0
    covered = path_values(different, slim).withColumn("_covers", F.lit(True))
    judged = kinds.join(found, ["kind", "value"], "left").join(covered, ["kind", "value"], "left")
    return judged.select(*anchors.columns, F.coalesce("_covers", other, F.lit(False)).alias("live"))


def record_liveness(anchors: DataFrame, files: DataFrame, own_file: bool = True) -> DataFrame:
    """(id, source, status, all_dead, n_live, n_dead, dead_paths, dead_patterns) of every record.

    A command anchor holds a record alive; a record without path and pattern anchors, as one with symbols only, is dead.
    """
    records = anchors.groupBy("id", "source", "status").agg(F.max((F.col("kind") == "command").cast("int")).alias("command"))
    judged = anchor_liveness(anchors, files, own_file)
    dead = lambda kind: F.sort_array(F.collect_set(F.when(~F.col("live") & (F.col("kind") == kind), F.col("value"))))
    counts = judged.groupBy("id", "source", "status").agg(
        F.count_if("live").alias("n_live"), F.count_if(~F.col("live")).alias("n_dead"), dead("path").alias("dead_paths"), dead("pattern").alias("dead_patterns")
    )
    none = F.array().cast("array<string>")
    return records.join(counts, ["id", "source", "status"], "left").select(
        "id", "source", "status",
        ((F.col("command") == 0) & (F.coalesce("n_live", F.lit(0)) == 0)).alias("all_dead"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_dead", F.lit(0)).alias("n_dead"),
        F.coalesce("dead_paths", none).alias("dead_paths"), F.coalesce("dead_patterns", none).alias("dead_patterns"),
    )


def orphans(anchors: DataFrame, files: DataFrame) -> DataFrame:
    return record_liveness(firing(anchors), files).where("all_dead")


def partial_rot(anchors: DataFrame, files: DataFrame) -> DataFrame:
    return record_liveness(firing(anchors), files).where("not all_dead and n_live > 0 and n_dead > 0")


def revived(anchors: DataFrame, files: DataFrame) -> DataFrame:
    """Orphaned records whose anchors live again; own files count here."""
    return record_liveness(anchors.where("status = 'orphaned'"), files, own_file=False).where("not all_dead")


def born_orphans(promoted: DataFrame, files: DataFrame) -> DataFrame:
    """(id, source) of records, fresh from promotion, whose anchors all resolve to nothing: to be told, not refused."""
    return record_liveness(anchors_of(promoted), files).where("all_dead").select("id", "source")


def overbroad(anchors: DataFrame, files: DataFrame, share: float = 0.25, least: int = 20) -> DataFrame:
    """Firing path anchors that cover at least `share` of the tracked files, where there are at least `least` files."""
    covered = path_pairs(firing(anchors), files.select("path")).groupBy("id", "value").agg(F.count("*").alias("covered"))
    total = files.agg(F.count("*").alias("n_files"))
    return covered.crossJoin(F.broadcast(total)).where((F.col("n_files") >= least) & (F.col("covered") / F.col("n_files") >= share)).withColumn("share", F.col("covered") / F.col("n_files"))


def review_due(records: DataFrame, today: str) -> DataFrame:
    """Firing records whose review date, as text, is before today."""
    return records.where(F.col("status").isin(*FIRING) & (F.col("review_after") != "") & (F.col("review_after") < today))


def status_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("status").agg(F.count("*").alias("n"))


def unreachable_evidence(evidence: DataFrame, reachable: DataFrame, existing: DataFrame) -> DataFrame:
    """evidence(id, sha) that no commit of reachable(sha) has: off-history if existing(sha) has it, else missing.

    shas may be shortened to seven digits or more; sides are joined by their first seven and then compared whole.
    """
    named = evidence.where(F.col("sha").rlike("^[0-9a-f]{7,40}$")).select("id", "sha", F.substring("sha", 1, 7).alias("head")).distinct()

    def known(commits: DataFrame) -> DataFrame:
        full = commits.select(F.col("sha").alias("full"), F.substring("sha", 1, 7).alias("head"))
        return named.join(full, "head").where(F.startswith("full", "sha")).select("id", "sha").distinct()

    lost = named.select("id", "sha").join(known(reachable), ["id", "sha"], "left_anti")
    there = known(existing).withColumn("there", F.lit(True))
    return lost.join(there, ["id", "sha"], "left").select("id", "sha", F.when(F.col("there"), "off-history").otherwise("missing").alias("reason"))


def author_drift(authors: DataFrame) -> DataFrame:
    """authors(author) whose spellings differ in case only: (folded, spellings)."""
    return authors.groupBy(F.lower("author").alias("folded")).agg(F.sort_array(F.collect_set("author")).alias("spellings")).where(F.size("spellings") > 1)


def lost_symbols(anchors: DataFrame, symbols: DataFrame) -> DataFrame:
    """Firing symbol anchors that mean no definition of symbols(path, name)."""
    asked = firing(anchors).where("kind = 'symbol'")
    return asked.join(symbol_pairs(asked.select("kind", "value").distinct(), symbols.select("path", "name")).select("value").distinct(), "value", "left_anti")


def brief(records: DataFrame, budget: int) -> DataFrame:
    """Records in order of severity, confidence and id, each with taken: whether its entry fits what is left.

    An entry that does not fit is passed over and later ones are still tried, so this is a fold in order, not a running
    sum. Of one length n at most budget / n entries fit, and they are the first of that length: only those are folded,
    whose number depends on the budget alone. An entry that is null is not taken.
    """
    order = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "high", 1).when(F.col("severity") == "low", 3).otherwise(2)
    rows = records.select(order.alias("o"), (-F.col("confidence")).alias("c"), F.coalesce("id", F.lit(0)).cast("long").alias("id"), (F.length("entry") + 1).alias("n"))
    at = placed(rows, "o", "c", "id", "n")
    nth = F.row_number().over(Window.partitionBy("n").orderBy("pos"))
    may = at.where(F.col("n") <= budget).withColumn("nth", nth).where((F.col("nth") <= budget) & (F.col("nth") * F.col("n") <= budget))
    start = F.struct(F.lit(budget).cast("long").alias("left"), F.array().cast("array<bigint>").alias("out"))
    fits = lambda a, r: r["n"] <= a["left"]
    fold = F.aggregate(
        F.sort_array(F.collect_list(F.struct("pos", "n"))), start,
        lambda a, r: F.struct((a["left"] - F.when(fits(a, r), r["n"]).otherwise(0)).cast("long").alias("left"), F.when(fits(a, r), F.concat(a["out"], F.array(r["pos"]))).otherwise(a["out"]).alias("out")),
    )
    taken = may.agg(fold.alias("f")).select(F.explode("f.out").alias("pos"), F.lit(True).alias("taken"))
    return at.join(F.broadcast(taken), "pos", "left").select((F.col("pos") - 1).cast("int").alias("pos"), "id", F.coalesce("taken", F.lit(False)).alias("taken"))


def unique_best(scored: DataFrame) -> DataFrame:
    """scored(item, candidate, ratio) -> (item, outcome): survived with one best candidate, ambiguous with more."""
    w = Window.partitionBy("item").orderBy(F.col("ratio").desc())
    return scored.withColumn("r", F.rank().over(w)).where("r = 1").groupBy("item").agg(F.when(F.count("*") == 1, "survived").otherwise("ambiguous").alias("outcome"))
