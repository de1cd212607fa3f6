"""Text sources that are not tables: JSON lines, unified diffs, transcripts, source files and their definitions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.tables import last_before, newest_of, running_count
from . import indented, scripts

#: Largest file whose content is loaded.
MAX_FILE = 1 << 20


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of a tree; content is null for files over MAX_FILE and those that are no UTF-8."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    text = F.when((F.col("length") <= MAX_FILE) & F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    return raw.select("path", text.alias("content"))


def tracked_files(spark: SparkSession, path: str, tracked: DataFrame) -> DataFrame:
    """files() of tracked(path), paths below the folder `path`: a row for each, content null also for those that are not there.
    What is in the folder but not tracked has no row."""
    there = files(spark, path).select(F.substring_index("path", path.rstrip("/") + "/", -1).alias("path"), "content")
    return tracked.select("path").distinct().join(there, "path", "left")


def payloads(lines: DataFrame) -> DataFrame:
    """lines(ord, value) of requests as JSON -> (ord, session, folder, path, command, content).

    path is the file or notebook that an edit names, content all that the edit brings, its parts' texts too. What is no
    object, or has another type than it should, counts as not given; a line without path and command has no row.
    """
    v = lines.select("ord", F.try_parse_json("value").alias("v"), "value").where(F.col("v").isNotNull() & F.schema_of_variant("v").startswith("OBJECT"))
    of = lambda name: F.try_variant_get("v", f"$.{name}", "string")
    told = lambda name: F.when(of(f"tool_input.{name}") != "", of(f"tool_input.{name}"))
    parts = F.from_json(F.get_json_object("value", "$.tool_input.edits"), "array<string>")
    brought = F.concat_ws(" ", told("content"), told("new_string"), told("new_source"), F.transform(parts, lambda e: F.get_json_object(e, "$.new_string")))
    each = v.select("ord", of("session_id").alias("session"), of("cwd").alias("folder"), F.coalesce(told("file_path"), told("notebook_path")).alias("path"), told("command").alias("command"), brought.alias("content"))
    return each.where("path is not null or command is not null")


def json_objects(lines: DataFrame) -> DataFrame:
    """lines(line_no, value) -> (line_no, v) as VARIANT; blank, malformed and non-object lines are passed over."""
    parsed = lines.select("line_no", F.try_parse_json("value").alias("v"))
    return parsed.where(F.col("v").isNotNull() & F.schema_of_variant("v").startswith("OBJECT"))


def firings(lines: DataFrame) -> DataFrame:
    """Firing-log lines -> (ts, repo, target, record_id, violated), an id a row; elements that are no integers are skipped."""
    objects = json_objects(lines)
    spark = lines.sparkSession
    part = "SELECT line_no, try_variant_get(v, '$.ts', 'string') AS ts, coalesce(try_variant_get(v, '$.repo', 'string'), '(unknown)') AS repo, try_variant_get(v, '$.target', 'string') AS target, try_cast(e.value AS bigint) AS record_id, {violated} AS violated FROM {df}, LATERAL variant_explode(try_variant_get(v, '$.{field}', 'variant')) e WHERE schema_of_variant(e.value) IN ('BIGINT', 'BOOLEAN')"
    both = [spark.sql(part.replace("{violated}", violated).replace("{field}", field), df=objects) for field, violated in (("scar_ids", "false"), ("violation_ids", "true"))]
    return both[0].union(both[1])


def transcript_blocks(lines: DataFrame, last: int = 4000) -> DataFrame:
    """Transcript lines(session, line_no, value) -> blocks(session, role, kind, text, file, is_error), of each session's
    last `last` lines. A message whose content is text is one text block."""
    tail = newest_of(lines, ["session"], "line_no", last)
    v = tail.select("session", "line_no", F.try_parse_json("value").alias("v")).where("v is not null")
    role = F.try_variant_get("v", "$.type", "string")
    content = F.try_variant_get("v", "$.message.content", "variant")
    flat = v.select("session", role.alias("role"), content.alias("c")).where("c is not null")
    texts = flat.where(F.schema_of_variant("c") == "STRING").select("session", "role", F.lit("text").alias("kind"), F.col("c").cast("string").alias("text"), F.lit(None).cast("string").alias("file"), F.lit(False).alias("is_error"))
    query = "SELECT session, role, try_variant_get(e.value, '$.type', 'string') AS kind, try_variant_get(e.value, '$.text', 'string') AS text, CASE WHEN try_variant_get(e.value, '$.name', 'string') IN ('Edit', 'Write', 'MultiEdit') THEN try_variant_get(e.value, '$.input.file_path', 'string') END AS file, coalesce(try_variant_get(e.value, '$.is_error', 'boolean'), false) AS is_error FROM {df}, LATERAL variant_explode(c) e WHERE schema_of_variant(c) LIKE 'ARRAY%' AND schema_of_variant(e.value) LIKE 'OBJECT%'"
    return texts.union(lines.sparkSession.sql(query, df=flat))


def diff_targets(diffs: DataFrame) -> DataFrame:
    """diffs(diff_id, text) of unified diffs -> (diff_id, ord, path, content): the added lines of each file, in order.

    Deleted files are dropped; a file without added lines has empty content.
    """
    lines = diffs.select("diff_id", F.posexplode(F.split("text", "\r\n|\n")).alias("n", "line"))
    w = Window.partitionBy("diff_id").orderBy("n")
    heads = lines.withColumn("head", F.when(F.startswith("line", F.lit("+++ ")), F.col("n"))).withColumn("ord", F.last("head", ignorenulls=True).over(w))
    name = F.trim(F.substring("line", 5, 1 << 30))
    added = F.when(F.col("head").isNull() & F.startswith("line", F.lit("+")), F.struct("n", F.expr("substring(line, 2)").alias("text")))
    files = heads.where("ord is not null").groupBy("diff_id", "ord").agg(F.max(F.when(F.col("head").isNotNull(), F.when(name.startswith("b/"), F.substring(name, 3, 1 << 30)).otherwise(name))).alias("path"), F.sort_array(F.collect_list(added)).alias("added"))
    return files.where("path <> '/dev/null' and path <> ''").select("diff_id", "ord", "path", F.array_join(F.transform("added", lambda x: x["text"]), "\n").alias("content"))


def definitions(sources: DataFrame) -> DataFrame:
    """Python, JavaScript and TypeScript sources(path, content) -> (path, name, first, last, shingles): every definition with
    its dotted name, lines, and the distinct triples of what it consists of, names and literals with their text.

    An error in a Python file costs no definition; one that holds it is described by its tokens."""
    schema = "path string, name string, first int, last int, shingles array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                of = indented if path.endswith(".py") else scripts
                try:
                    rows += [(path, *d) for d in of.definitions(content or "")]
                except (ValueError, RecursionError):
                    continue
            columns = list(zip(*rows)) or [[], [], [], [], []]
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["path", "name", "first", "last", "shingles"])

    return sources.where(F.col("path").rlike(r"\.(?:py|tsx?|jsx?)$")).select("path", "content").mapInArrow(run, schema)


def git_log(lines: DataFrame) -> DataFrame:
    """lines(repo, n, line) of `git log --format=%x02%H%x01%ad%x01%s` with any of --name-only, --name-status or -p
    -> (repo, n, seq, sha, date, subject, rest): every other line with the commit it belongs to, seq 0 the first printed.

    Commits without other lines have one row with rest null; lines before the first commit have none. A log is read in
    ranges of its numbers n, and each range goes on with the commit that was open before it.
    """
    parts = F.split(F.expr("substring(line, 2)"), "\x01", 3)
    heads = running_count(lines.where(F.startswith("line", F.lit("\x02"))).select("repo", "n", parts.alias("at")), ["repo"], "n", "seq")
    open_ = heads.select("repo", "n", F.struct("seq", "at").alias("open"))
    rest = lines.where((F.col("line") != "") & ~F.startswith("line", F.lit("\x02"))).select("repo", "n", F.col("line").alias("rest"))
    placed = last_before(rest, open_, ["repo"], "n", "open").where("open is not null")
    each = placed.unionByName(open_.withColumn("rest", F.lit(None).cast("string")))
    return each.select("repo", "n", "open.seq", F.col("open.at")[0].alias("sha"), F.col("open.at")[1].alias("date"), F.col("open.at")[2].alias("subject"), "rest")


def git_commits(log: DataFrame) -> DataFrame:
    return log.select("repo", "seq", "sha", "date", "subject").distinct()


def git_deletions(log: DataFrame) -> DataFrame:
    """Deleted paths of a log made with --diff-filter=D --name-only."""
    return log.where("rest is not null").select("repo", "seq", "sha", "date", "subject", F.col("rest").alias("path"))


def git_renames(log: DataFrame) -> DataFrame:
    """(repo, old, new, seq) of a log made with -M --diff-filter=R --name-status."""
    parts = F.split("rest", "\t")
    return log.where(F.col("rest").rlike("^R\\d*\t")).select("repo", parts[1].alias("old"), parts[2].alias("new"), "seq")


def git_patch_lines(log: DataFrame) -> DataFrame:
    """(repo, seq, sha, date, n, file, sign, text): changed lines of a log made with -p. The file is that of the last header
    before a line, looked up as commits are in git_log()."""
    changed = log.where(F.col("rest").rlike("^[+-]") & ~F.col("rest").rlike("^(\\+\\+\\+|---) "))
    files = log.where(F.startswith("rest", F.lit("+++ "))).select("repo", "n", F.regexp_replace(F.expr("substring(rest, 5)"), "^b/", "").alias("file"))
    placed = last_before(changed, files, ["repo"], "n", "file").where("file is not null")
    return placed.select("repo", "seq", "sha", "date", "n", "file", F.substring("rest", 1, 1).alias("sign"), F.expr("substring(rest, 2)").alias("text"))


def tracked_values(patches: DataFrame, keys: tuple[str, ...] = ("image", "replicas", "tag", "version", "cpu", "memory")) -> DataFrame:
    """Added lines `key: value` of the tracked keys: (repo, file, key, value, seq, sha)."""
    pattern = rf"^\s*({'|'.join(keys)}):\s*(.+)$"
    added = patches.where((F.col("sign") == "+") & F.col("text").rlike(pattern))
    return added.select("repo", "file", F.regexp_extract("text", pattern, 1).alias("key"), F.trim(F.regexp_extract("text", pattern, 2)).alias("value"), F.col("n").alias("seq"), "sha")


def reset_hits(reflog: DataFrame, since: str) -> DataFrame:
    """Reflog lines(ts, line) of resets at or after `since`."""
    return reflog.where((F.col("ts") >= since) & F.col("line").rlike("reset: moving to")).select("ts", F.regexp_extract("line", "reset: moving to (\\S+)", 1).alias("to"))
