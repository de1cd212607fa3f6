"""Candidates from history: reverts, deleted components, oscillating values, marked comments; their rank and precision."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import MARKED_COMMENT, REVERT_SUBJECT, VENDORED, candidate_id, candidate_score, has_segment, strip
from .tables import kept, placed

#: Names of lock files, whose comments are not mined, and the order of sections.
LOCKFILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "Cargo.lock", "go.sum", "uv.lock", "Gemfile.lock", "composer.lock", "Pipfile.lock")
SECTIONS = ("revert", "deleted_component", "flapping", "comment")


def _either(pattern: str, extra: str | None) -> str:
    return f"{pattern}|{extra}" if extra else pattern


def reverts(commits: DataFrame, extra: str | None = None) -> DataFrame:
    """commits(seq, sha, date, subject) that speak of going back, or match extra; the sha is cut to eight digits."""
    return commits.where(F.col("subject").rlike(f"(?iu){_either(REVERT_SUBJECT, extra)}")).select(F.lit("revert").alias("section"), F.substring("sha", 1, 8).alias("commit"), "date", "subject", "seq")


def deleted_components(deletions: DataFrame, live: DataFrame) -> DataFrame:
    """deletions(seq, sha, date, subject, path), the smallest seq newest, and live(path).

    A component is the first two segments of a path; those that still hold a file are left out.
    """
    component = lambda p: F.array_join(F.slice(F.split(p, "/"), 1, 2), "/")
    gone = deletions.where(F.col("path").contains("/")).withColumn("component", component(F.col("path")))
    newest = F.min_by(F.struct("date", "sha", "subject"), "seq")
    died = gone.groupBy("component").agg(newest.alias("last"), F.count("*").alias("files_deleted"), F.min("seq").alias("seq"))
    there = live.select(component(F.col("path")).alias("component")).distinct()
    return died.join(there, "component", "left_anti").select(F.lit("deleted_component").alias("section"), "component", F.col("last.date").alias("died"), F.col("last.sha").alias("death_commit"), F.col("last.subject").alias("death_subject"), "files_deleted", "seq")


def oscillations(history: DataFrame, keys: list[str], order: list[str], width: int = 4096) -> DataFrame:
    """history(keys, order, value) -> keys, oscillation_count, first: how often a value goes and comes back.

    A cycle is A, B, A; it uses up its first two places, and the next may begin at its last. In a run of consecutive
    places where cycles could begin, every other one counts, so a run of n counts half of n, rounded up. first is the
    values and order of the first cycle.

    All rows are put in one order by ranges and cut into slices of `width`, at least two, each with the two rows after it, so
    a key of any length is many tasks. Runs inside a slice are counted there; of those that touch an edge, two a slice at
    most, what goes on in the next slice is put together first.
    """
    rows = placed(history.select(F.struct(*keys).alias("_key"), *order, "value"), "_key", *order).withColumn("_slice", F.floor((F.col("pos") - 1) / width))
    after = rows.where((F.col("pos") - 1) % width < 2).withColumn("_slice", F.col("_slice") - 1)
    inside = Window.partitionBy("_slice").orderBy("pos")
    lead = lambda c, i: F.when(F.lead("_key", i).over(inside).eqNullSafe(F.col("_key")), F.lead(c, i).over(inside))
    seen = rows.withColumn("_own", F.lit(True)).union(after.withColumn("_own", F.lit(False))).withColumn("_b", lead("value", 1)).withColumn("_c", lead("value", 2))
    begins = seen.where(F.col("_own") & (F.col("value") == F.col("_c")) & (F.col("value") != F.col("_b")))
    by = Window.partitionBy("_slice").orderBy("pos")
    runs = begins.withColumn("_run", F.col("pos") - F.row_number().over(by))
    found = F.min_by(F.struct("value", F.col("_b").alias("back"), *order), "pos").alias("first")
    pieces = kept(runs.groupBy("_key", "_slice", "_run").agg(F.count("*").alias("n"), F.min("pos").alias("at"), F.max("pos").alias("end"), found))
    low, high = F.col("_slice") * width + 1, (F.col("_slice") + 1) * width
    edge = (F.col("at") == low) | (F.col("end") == high)
    order_of = Window.partitionBy("_key").orderBy("at")
    goes_on = F.lag("end").over(order_of) == F.col("at") - 1
    linked = pieces.where(edge).withColumn("_new", F.when(goes_on, 0).otherwise(1)).withColumn("_chain", F.sum("_new").over(order_of))
    whole = linked.groupBy("_key", "_chain").agg(F.sum("n").alias("n"), F.min_by("first", "at").alias("first"), F.min("at").alias("at"))
    every = pieces.where(~edge).select("_key", "n", "first", "at").union(whole.select("_key", "n", "first", "at"))
    return every.groupBy("_key").agg(F.sum(F.ceil(F.col("n") / 2)).cast("long").alias("oscillation_count"), F.min_by("first", "at").alias("first")).select("_key.*", "oscillation_count", "first")


def flapping(history: DataFrame) -> DataFrame:
    """history(file, key, value, seq, sha) of added lines in time order -> candidates with their first cycle."""
    found = oscillations(history, ["file", "key"], ["seq"])
    return found.select(F.lit("flapping").alias("section"), "file", "key", F.concat_ws(" -> ", "first.value", "first.back", "first.value").alias("sequence"), "oscillation_count", F.col("first.seq").alias("seq"))


def comments(files: DataFrame, extra: str | None = None) -> DataFrame:
    """Lines of files(path, content) with a marker, or that match extra, as path:line and 120 characters of the stripped text."""
    marked = _either(MARKED_COMMENT, extra)
    lines = files.where(F.col("content").rlike(marked)).select("path", F.posexplode(F.split("content", "\n")).alias("n", "line"))
    return lines.where(F.col("line").rlike(marked)).select(F.lit("comment").alias("section"), F.concat_ws(":", "path", (F.col("n") + 1).cast("string")).alias("location"), F.substring(strip(F.col("line")), 1, 120).alias("text"), "path", (F.col("n") + 1).cast("long").alias("seq"))


def harvest(parts: list[DataFrame], now_months: int) -> DataFrame:
    """One ranked table of the sections: what lies in record folders, vendored code or lock files left out, then id,
    score and pos. Equal scores keep the order of sections, then of seq, then of id."""
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part, allowMissingColumns=True)
    for column, kind in (("subject", "string"), ("date", "string"), ("commit", "string"), ("component", "string"), ("died", "string"), ("death_commit", "string"), ("death_subject", "string"), ("sequence", "string"), ("files_deleted", "long"), ("file", "string"), ("key", "string"), ("oscillation_count", "long"), ("location", "string"), ("text", "string")):
        if column not in every.columns:
            every = every.withColumn(column, F.lit(None).cast(kind))
    path = F.coalesce(F.element_at(F.split("location", ":"), 1), "file", "component", F.lit(""))
    lock = (F.col("section") == "comment") & F.element_at(F.split(path, "/"), -1).isin(*LOCKFILES)
    mined = every.where(~(has_segment(path, (".scars", *VENDORED)) | lock))
    scored = mined.withColumn("id", candidate_id()).withColumn("score", candidate_score(now_months))
    place = F.array_position(F.array(*[F.lit(s) for s in SECTIONS]), F.col("section"))
    return scored.withColumn("_section", place)


def top(harvested: DataFrame, k: int) -> DataFrame:
    """The k best candidates, with pos. Sorting for a limit keeps k rows of each task."""
    order = [F.col("score").desc(), "_section", "seq", "id"]
    return harvested.orderBy(*order).limit(k).withColumn("pos", F.row_number().over(Window.orderBy(*order))).drop("_section")


def precision(ranked: DataFrame, labels: DataFrame, at: list[int]) -> DataFrame:
    """ranked(pos, id) and labels(id, keep) -> (n, labeled_in_top, precision, base_rate, lift) for each n of at.

    Unlabelled candidates count nowhere; without labelled ones precision is nothing. n is capped at the number of
    candidates, repeated ones are given once. Positions come in; the answer is one pass of conditional sums.
    """
    hit = ranked.join(labels.select("id", "keep"), "id", "left")
    total = F.max("pos")
    sums = [F.struct(F.least(F.lit(n), total).alias("n"), F.count_if((F.col("pos") <= n) & F.col("keep").isNotNull()).alias("labeled"), F.count_if((F.col("pos") <= n) & F.col("keep")).alias("kept")) for n in at if n > 0]
    row = hit.agg(F.array(*sums).alias("at"), F.count_if(F.col("keep").isNotNull()).alias("all"), F.count_if("keep").alias("good"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    each = row.select(F.explode(F.array_distinct("at")).alias("x"), share(F.col("good"), F.col("all")).alias("base_rate"))
    return each.select(F.col("x.n").cast("long").alias("n"), F.col("x.labeled").alias("labeled_in_top"), share(F.col("x.kept"), F.col("x.labeled")).alias("precision"), "base_rate").withColumn("lift", F.col("precision") - F.col("base_rate"))


def anchor_paths(ranked: DataFrame, changes: DataFrame, tracked: DataFrame, most: int = 3) -> DataFrame:
    """(id, path): tracked paths to anchor a candidate at: its own, or the first `most` that a revert's commit touched."""
    own = ranked.where("section <> 'revert'").select("id", F.coalesce(F.element_at(F.split("location", ":"), 1), "file", "component").alias("path"))
    touched = ranked.where("section = 'revert'").select("id", "commit").join(changes.select(F.substring("sha", 1, 8).alias("commit"), "path").distinct(), "commit")
    alive = touched.join(tracked.select("path"), "path", "left_semi")
    first = alive.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("path"))).where(F.col("r") <= most)
    return own.join(tracked.select("path"), "path", "left_semi").select("id", "path").union(first.select("id", "path"))


def label_requests(requests: DataFrame, harvested: DataFrame, date: str) -> DataFrame:
    """requests(id, label, note) -> (id, label, note, date, refused): refused says why a label is not to be recorded, and is
    null where it is: the label is keep or discard, and the id one of harvested(id)."""
    there = harvested.select("id", F.lit(True).alias("_there")).distinct()
    why = F.when(~F.coalesce(F.col("label").isin("keep", "discard"), F.lit(False)), "invalid label").when(F.col("_there").isNull(), "no such candidate")
    return requests.join(there, "id", "left").select("id", "label", "note", F.lit(date).alias("date"), why.alias("refused"))
