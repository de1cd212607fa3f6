"""From dead or drifting anchors to findings in one plan: the history that is looked up, and the text that says so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import jaccard, signature_lines, tier
from ..sources.logs import definitions
from .ancestry import at, first_evidence
from .matching import BROADCAST_MOST, firing
from .reanchor import killing_commit, pickaxe, symbol_candidates, symbol_moves, symbol_path, symbol_prints
from .tables import kept

#: Longest part of a line that history is searched for.
ASKED = 200


def two_digits(ratio: Column) -> Column:
    return F.format_number(ratio, 2)


def shared_lines(dead: DataFrame, sets: DataFrame, keys: list[str], low: float) -> DataFrame:
    """dead(id, keys, lines) and sets(keys, path, lines) -> (id, path, ratio): share of the dead lines, at least `low`; lines
    as numbers.

    Files with equal lines under equal keys are compared once. A line is a key together with keys.
    """
    of = F.sha1(F.array_join(F.array_sort("lines").cast("array<string>"), "\n").cast("binary"))
    named = kept(sets.where(F.size("lines") > 0).withColumn("_set", of))
    each = named.groupBy(*keys, "_set").agg(F.first("lines").alias("lines")).select(*keys, "_set", F.explode("lines").alias("line"))
    left = dead.where(F.size("lines") > 0).select("id", *keys, F.size("lines").alias("_n"), F.explode("lines").alias("line"))
    ratio = left.join(each, [*keys, "line"]).groupBy("id", *keys, "_set").agg((F.count("*") / F.first("_n")).alias("ratio")).where(F.col("ratio") >= low)
    return ratio.join(named.select(*keys, "_set", "path"), [*keys, "_set"]).select("id", "path", "ratio")


def _changed(patches: DataFrame) -> DataFrame:
    """(sha, file, lines, line) of patches(sha, file, text): 64-bit hashes of the different lines that count, and the begin of
    the longest. Lines are gathered as numbers, not as text."""
    each = patches.select("sha", "file", F.explode(signature_lines(F.col("text"))).alias("x"))
    cut = each.select("sha", "file", F.xxhash64("x").alias("h"), F.struct(F.length("x").alias("n"), F.substring("x", 1, ASKED).alias("x")).alias("long"))
    return cut.groupBy("sha", "file").agg(F.collect_set("h").alias("lines"), F.max("long").alias("_long")).select("sha", "file", "lines", F.col("_long.x").alias("line"))


def _only(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """rows whose wanted(keys) are there if these are few, else all: the join that follows drops the others."""
    keys = wanted.distinct()
    return rows.join(F.broadcast(keys), wanted.columns, "left_semi") if keys.limit(BROADCAST_MOST + 1).count() <= BROADCAST_MOST else rows


def trace_paths(dead: DataFrame, deletions: DataFrame, patches: DataFrame, files: DataFrame, low: float = 0.2, most: int = 20) -> DataFrame:
    """dead(id, path) -> (id, dead, proposed, ratio, tier, evidence): where the content of deleted files may have gone.

    deletions(seq, sha, path) and patches(seq, sha, file, sign, text), the smallest seq newest; files(path, content) are those
    tracked now. First the newest commit that deleted a path is asked: the lines it removed there, stripped, of at least
    ten characters, against the lines it added to each tracked file. Only paths for which that finds nothing go on: the
    longest of their lines is searched for in the `most` newest commits that change how often it occurs, and the files it
    was added to count by what they hold today. A path that was never deleted, or without such lines, has no row. Shares of
    lines are counted by 64-bit hashes, so texts are read where they lie and not dealt out.
    """
    asked = dead.select("id", "path").distinct()
    killer = killing_commit(deletions, asked.select("path").distinct())
    killed = kept(asked.join(killer, "path").select("id", "path", "sha"))
    removed = _changed(_only(patches.where("sign = '-'"), killed.select(F.col("path").alias("file"), "sha")))
    lost = kept(killed.join(removed.withColumnRenamed("file", "path"), ["sha", "path"]).select("id", "path", "sha", "lines", "line"))
    tracked = files.select("path").distinct()
    added = _changed(_only(patches.where("sign = '+'"), lost.select("sha"))).join(lost.select("sha").distinct(), "sha").select("sha", F.col("file").alias("path"), "lines")
    near = kept(shared_lines(lost.select("id", "sha", "lines"), added.join(tracked, "path", "left_semi"), ["sha"], low).join(lost.select("id", F.col("path").alias("dead"), "sha"), "id").where("path <> dead"))
    rest = kept(lost.join(near.select("id").distinct(), "id", "left_anti"))
    found = pickaxe(patches, rest.select("id", "line"), tracked, most)
    pairs = kept(found.join(rest.select("id", F.col("path").alias("dead"), "sha", "lines"), "id").where("file <> dead"))
    now = F.transform(signature_lines(F.col("content")), lambda x: F.xxhash64(x))
    today = _only(files.withColumnRenamed("path", "file"), pairs.select("file")).select("file", now.alias("now"))
    share = F.size(F.array_intersect("lines", "now")) / F.size("lines")
    far = pairs.join(today, "file").select("id", "dead", F.col("file").alias("path"), "sha", share.alias("ratio")).where(F.col("ratio") >= low)
    said = lambda before, after: F.concat(F.lit(before), F.substring("sha", 1, 7), F.lit(after), two_digits(F.col("ratio")))
    row = lambda rows, evidence: rows.select("id", "dead", F.col("path").alias("proposed"), "ratio", tier(F.col("ratio")).alias("tier"), evidence.alias("evidence"))
    return row(near, said("killing-commit ", ": overlap ")).union(row(far, said("pickaxe ", ": distinctive-line match, overlap ")))


def _prints(asked: DataFrame, sources: DataFrame) -> DataFrame:
    """asked(id, value, path, key) -> (id, value, path, shingles): the definition that each symbol anchor means in the source of
    its key, if it means one there; sources(key, path, content)."""
    name = F.when(F.col("value").contains("::"), F.expr("substring(value, locate('::', value) + 2)")).otherwise(F.col("value"))
    at_key = lambda key, path: F.concat_ws(":", key, path)  # noqa: E731  the path last, as its ending says the language
    found = definitions(sources.select(at_key(F.col("key"), F.col("path")).alias("path"), "content"))
    wanted = asked.select(F.struct("id", "value", "path").alias("id"), F.lit("symbol").alias("kind"), name.alias("value"), at_key(F.col("key"), F.col("path")).alias("path"))
    return symbol_prints(wanted, found).select("id.id", "id.value", "id.path", "shingles")


def _before(asked: DataFrame, placed: DataFrame, versions: DataFrame, contents: DataFrame) -> DataFrame:
    """asked(id, value, path, repo, sha) -> (id, value, path, sha, shingles): what each symbol was at its commit."""
    blobs = kept(asked.hint("merge").join(at(placed, versions, asked.select("repo", "sha", "path")), ["repo", "sha", "path"]).where("blob is not null"))
    sources = blobs.select(F.col("blob").alias("key"), "path").distinct().join(contents.select(F.col("blob").alias("key"), "content"), "key")
    return _prints(blobs.select("id", "value", "path", F.col("blob").alias("key")), sources).join(blobs.select("id", "value", "path", "sha"), ["id", "value", "path"])


def drift(anchors: DataFrame, states: DataFrame, placed: DataFrame, versions: DataFrame, contents: DataFrame, files: DataFrame) -> DataFrame:
    """(id, symbol, sha, similarity) of firing symbol anchors that changed since their record's first reachable evidence.

    anchors(id, kind, value, status); states as ancestry.evidence_states() gives them, placed as lines(), versions and
    contents(blob, content) as at() takes them; files(path, content) are those of today. An anchor's file is the tracked
    one that it names, or the only tracked one among its record's paths. Left out is what cannot be compared: records
    without reachable evidence, files that were not there, names that mean no definition, or several, then or now.
    """
    live = firing(anchors)
    symbols, paths = live.where("kind = 'symbol'").select("id", "value"), live.where("kind = 'path'").select("id", "value")
    there = kept(symbol_path(symbols, paths, files.select("path")).where("path is not null").distinct())
    then = _before(there.join(first_evidence(states), "id"), placed, versions, contents)
    today = files.join(there.select("path").distinct(), "path").select(F.lit("").alias("key"), "path", "content")
    now = _prints(there.withColumn("key", F.lit("")), today).withColumnRenamed("shingles", "now")
    return then.join(now, ["id", "value", "path"]).select("id", F.col("value").alias("symbol"), "sha", jaccard(F.col("shingles"), F.col("now")).alias("similarity")).where("similarity < 1")


def trace_symbols(anchors: DataFrame, states: DataFrame, placed: DataFrame, versions: DataFrame, contents: DataFrame, files: DataFrame, most: int = 50) -> DataFrame:
    """(id, dead, proposed, ratio, tier, evidence): where definitions may be now that firing symbol anchors no longer find.

    An anchor is dead if it has no tracked file (as in drift()) or means nothing there. What it was comes from the file it
    names, or its record's only path, at the record's first reachable evidence. Definitions of the first `most` of its old
    file, its folder and its kind of file are compared with that by their shingles; the anchor's first name again adds 0.05.
    """
    live = firing(anchors)
    symbols, paths = live.where("kind = 'symbol'").select("id", "value").distinct(), live.where("kind = 'path'").select("id", "value").distinct()
    tracked = files.select("path").distinct()
    located = kept(symbol_path(symbols, paths, tracked))
    known = located.where("path is not null")
    sources = files.join(known.select("path").distinct(), "path")
    defined = definitions(sources.select("path", "content")).select("path", "name").distinct()
    held = known.join(defined, "path").select("id", "value", _means(F.col("value"), F.col("name")).alias("_means")).where("_means").select("id", "value").distinct()
    sole = paths.groupBy("id").agg(F.min("value").alias("_sole"), F.count("*").alias("_n"))
    old = F.when(F.col("value").contains("::"), F.substring_index("value", "::", 1)).when(F.col("_n") == 1, F.col("_sole"))
    dead = located.select("id", "value").join(held, ["id", "value"], "left_anti").join(sole, "id", "left").select("id", "value", old.alias("path")).where("path is not null and path <> ''")
    was = kept(_before(dead.join(first_evidence(states), "id"), placed, versions, contents).withColumn("_id", F.struct("id", "value")))
    candidates = kept(symbol_candidates(was.select(F.col("_id").alias("id"), "path"), tracked, most))
    now = definitions(files.join(candidates.select("path").distinct(), "path").select("path", "content"))
    name = F.when(F.col("value").contains("::"), F.expr("substring(value, locate('::', value) + 2)")).otherwise(F.col("value"))
    moved = symbol_moves(was.select(F.col("_id").alias("id"), name.alias("name"), "shingles"), now, candidates).withColumnRenamed("id", "_id")
    said = F.concat(F.lit("symbol fingerprint at "), F.substring("sha", 1, 7), F.lit(": jaccard "), two_digits(F.col("similarity")), F.when(F.col("named"), " (+name match)").otherwise(""))
    return moved.join(was.select("_id", "sha"), "_id").select("_id.id", F.col("_id.value").alias("dead"), F.concat_ws("::", "path", F.substring_index("name", ".", -1)).alias("proposed"), "ratio", "tier", said.alias("evidence"))


def _means(value: Column, name: Column) -> Column:
    """Whether a symbol anchor, less its file, may mean a definition's dotted name."""
    bare = F.when(value.contains("::"), F.regexp_extract(value, "::(.*)$", 1)).otherwise(value)
    parts = F.transform(F.split(bare, r"\."), lambda p: F.concat(F.lit(r"\Q"), p, F.lit(r"\E")))
    return F.rlike(name, F.concat(F.lit(r"^(?:.*\.)?"), F.array_join(parts, r"\.(?:.*\.)?"), F.lit("$")))
