"""Record files: text with a head of fields -> one row a file, and back; and the lint rules over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import empty_udf, prone_udf, valid_udf
from ..operators.tables import kept, placed, running_count

#: The domains of type, severity and status, evidence kinds, and unsupported anchors.
TYPES = ("deadend", "fence", "landmine")
SEVERITIES = ("low", "medium", "high", "critical")
STATUSES = ("active", "challenged", "archived", "orphaned", "candidate")
EVIDENCE = "commit|pr|issue|incident|note|url"
UNSUPPORTED = ("touch", "breaks")
HEAD = r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n?(.*)\z"


def read(spark: SparkSession, path: str) -> DataFrame:
    """(source, text) of the record files of a folder: markdown, without read-me files, templates and _ names."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.md").select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("source"), F.col("value").alias("text"))
    return files.where(~F.lower("source").isin("readme.md", "template.md") & ~F.col("source").startswith("_"))


def _field(name: str, comments: bool = True) -> Column:
    value = F.regexp_extract("head", rf"(?m)^\s*{name}:\s*(.+?)\s*$", 1)
    if comments:
        value = F.when(value.rlike("[\"']"), value).otherwise(F.regexp_replace(value, r"\s+#.*$", ""))
    return F.when(value != "", F.regexp_replace(value, r"^[\"']|[\"']$", "")) if comments else F.when(value != "", value)


def _anchors(kind: str, quotes: str, comments: bool) -> Column:
    found = F.regexp_extract_all("head", F.lit(rf"(?m)^\s*-\s*{kind}:\s*(.+?)\s*$"), 1)
    if comments:
        found = F.transform(found, lambda v: F.when(v.rlike("[\"']"), v).otherwise(F.regexp_replace(v, r"\s+#.*$", "")))
    return F.transform(found, lambda v: F.regexp_replace(v, f"^[{quotes}]+|[{quotes}]+$", ""))


def _evidence(line: Column) -> Column:
    """`kind: value` of an evidence line, without a comment behind the value and quotes around it."""
    part = lambda i: F.regexp_extract(line, r"^\s*-\s*(\w+):\s*(.+?)\s*$", i)
    bare = F.when(part(2).rlike("[\"']"), part(2)).otherwise(F.regexp_replace(part(2), r"\s+#.*$", ""))
    return F.concat(part(1), F.lit(": "), F.regexp_replace(bare, r"^[\"']+|[\"']+$", ""))


def parse(texts: DataFrame) -> DataFrame:
    """texts(source, text) -> the record columns, and broken: whether there is no head, in which case all else is null.

    Of a field the first line counts, at any indentation. Malformed confidence is 0.5, a malformed id null.
    """
    split = texts.withColumn("broken", ~F.col("text").rlike(HEAD)).withColumn("head", F.when(~F.col("broken"), F.regexp_extract("text", HEAD, 1)))
    evidence = F.transform(F.regexp_extract_all("head", F.lit(rf"(?m)^\s*-\s*(?:{EVIDENCE}):\s*.+?\s*$"), 0), _evidence)
    authors = F.filter(F.transform(F.split(F.regexp_replace(F.coalesce(_field("authors"), F.lit("")), r"[\[\]]", ""), ","), lambda a: F.regexp_replace(F.trim(a), "^[\"']|[\"']$", "")), lambda a: a != "")
    confidence = _field("confidence")
    out = split.select(
        "source", "broken", "text",
        _field("id").try_cast("long").alias("id"),
        F.coalesce(_field("type"), F.lit("deadend")).alias("type"), F.coalesce(_field("title", comments=False), F.lit("")).alias("title"),
        F.coalesce(_field("severity"), F.lit("medium")).alias("severity"), F.coalesce(_field("status"), F.lit("active")).alias("status"),
        F.coalesce(confidence.try_cast("double"), F.lit(0.5)).alias("confidence"), F.coalesce(_field("created"), F.lit("")).alias("created"),
        F.when(F.col("head").isNotNull(), authors).alias("authors"),
        _anchors("path", "\"'", True).alias("path_anchors"), _anchors("pattern", "\"", False).alias("pattern_anchors"),
        _anchors("symbol", "\"'", True).alias("symbol_anchors"), _anchors("command", "\"'", False).alias("command_anchors"),
        evidence.alias("evidence"),
        F.coalesce(_field("condition"), F.lit("")).alias("expires_condition"), F.coalesce(_field("review_after"), F.lit("")).alias("review_after"),
        F.coalesce(F.regexp_replace(F.regexp_extract("head", r"(?m)^\s*violation:\s*(.+?)\s*$", 1), "^\"+|\"+$", ""), F.lit("")).alias("violation"),
        F.trim(F.regexp_replace(F.regexp_extract("text", HEAD, 2), r"^\s+|\s+$", "")).alias("body"),
        "head",
    )
    keep = ("source", "broken", "text", "head")
    return out.select(*[F.col(c) if c in keep else F.when(~F.col("broken"), F.col(c)).alias(c) for c in out.columns])


def to_text(records: DataFrame) -> DataFrame:
    """records with text: the canonical form of its fields, which parse() reads back."""
    listed = lambda column, kind: F.transform(column, lambda v: F.concat(F.lit(f"  - {kind}: "), v))
    quoted = lambda column, kind: F.transform(column, lambda v: F.concat(F.lit(f"  - {kind}: \""), v, F.lit('"')))
    line = lambda name, value: F.when(value.isNotNull() & (value.cast("string") != ""), F.concat(F.lit(f"{name}: "), value.cast("string")))
    anchors = F.concat(listed("path_anchors", "path"), quoted("pattern_anchors", "pattern"), listed("symbol_anchors", "symbol"), quoted("command_anchors", "command"))
    head = F.concat(
        F.array_compact(F.array(line("id", F.col("id")), line("type", F.col("type")), line("title", F.col("title")), line("severity", F.col("severity")), line("confidence", F.col("confidence")), line("created", F.col("created")), line("authors", F.concat(F.lit("["), F.array_join("authors", ", "), F.lit("]"))))),
        F.when(F.size(anchors) > 0, F.concat(F.array(F.lit("anchors:")), anchors)).otherwise(F.array().cast("array<string>")),
        F.when(F.size("evidence") > 0, F.concat(F.array(F.lit("evidence:")), F.transform("evidence", lambda v: F.concat(F.lit("  - "), v)))).otherwise(F.array().cast("array<string>")),
        F.array_compact(F.array(line("condition", F.col("expires_condition")), line("review_after", F.col("review_after")), F.when(F.col("violation") != "", F.concat(F.lit('violation: "'), F.col("violation"), F.lit('"'))), line("status", F.col("status")))),
    )
    return records.withColumn("text", F.concat(F.lit("---\n"), F.array_join(head, "\n"), F.lit("\n---\n\n"), F.col("body"), F.lit("\n")))


def anchors(records: DataFrame) -> DataFrame:
    """One row an anchor: id, source, kind, value, anchor_ord, severity, confidence, status."""

    def of(kind: str) -> Column:
        return F.transform(f"{kind}_anchors", lambda v, i: F.struct(F.lit(kind).alias("kind"), v.alias("value"), i.alias("anchor_ord")))

    parts = F.flatten(F.array(*[of(kind) for kind in ("path", "pattern", "symbol", "command")]))
    return records.where(~F.col("broken")).select("id", "source", "severity", "confidence", "status", F.explode(parts).alias("a")).select("id", "source", "a.kind", "a.value", "a.anchor_ord", "severity", "confidence", "status")


def lint(parsed: DataFrame, today: str, symbols: bool = True) -> DataFrame:
    """(source, level, message) findings of every file; a file without head has that finding alone."""
    some = lambda column: F.size(column) > 0
    rule = lambda when, level, message: F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(level).alias("level"), F.lit(message).alias("message")))
    url = F.exists("evidence", lambda e: e.startswith("url: ") & ~e.rlike("^url: https?://"))
    folded = F.transform("authors", lambda a: F.lower(a))
    rules = [
        rule(~F.col("type").isin(*TYPES), "error", "unknown type"),
        rule(F.col("title") == "", "error", "missing title"),
        rule(F.col("title").rlike(r"https?://|[*_`\[\]]"), "warning", "markdown or URL in title"),
        rule(~F.col("severity").isin(*SEVERITIES), "error", "invalid severity"),
        rule(~F.col("status").isin(*STATUSES), "error", "invalid status"),
        rule(~(some("path_anchors") | some("pattern_anchors") | some("symbol_anchors") | some("command_anchors")), "error", "no anchors"),
        rule(F.col("head").rlike(rf"(?m)^\s*-\s*(?:{'|'.join(UNSUPPORTED)}):"), "warning", "unsupported anchors"),
        rule(some("symbol_anchors") & F.lit(not symbols), "warning", "symbol anchors without parser"),
        rule(F.size(F.array_distinct(folded)) < F.size(F.array_distinct("authors")), "warning", "author spelled in different case"),
        rule(~some("evidence"), "warning", "no evidence"),
        rule(url, "warning", "bad url evidence"),
        rule(F.col("status").isin("active", "challenged") & (F.col("review_after") != "") & (F.col("review_after") < today), "warning", "review_after is past"),
        rule(F.col("body") == "", "warning", "empty body"),
    ]
    whole = parsed.where(~F.col("broken"))
    plain = whole.select("source", F.explode(F.array_compact(F.array(*rules))).alias("f")).select("source", "f.*")
    broken = parsed.where("broken").select("source", F.lit("error").alias("level"), F.lit("missing frontmatter").alias("message"))
    kind_of = lambda kind: F.transform(f"{kind}_anchors", lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("rx")))
    listed = F.concat(kind_of("pattern"), kind_of("command"), F.when(F.col("violation") != "", F.array(F.struct(F.lit("violation").alias("kind"), F.col("violation").alias("rx")))).otherwise(F.array().cast("array<struct<kind:string,rx:string>>")))
    rx = whole.select("source", F.explode(listed).alias("p")).select("source", "p.*").distinct()
    judged = rx.select("source", "kind", valid_udf("rx").alias("ok"), prone_udf("rx").alias("prone"), empty_udf("rx").alias("empty"))
    message = F.when(~F.col("ok"), F.concat("kind", F.lit(" is no valid pattern"))).when((F.col("kind") == "command") & F.col("empty"), F.lit("command matches the empty text")).when(F.col("prone"), F.concat("kind", F.lit(" may backtrack without end")))
    bad = judged.select("source", F.lit("error").alias("level"), message.alias("message")).where("message is not null")
    return plain.union(broken).union(bad)


def free_names(drafts: DataFrame, taken: DataFrame) -> DataFrame:
    """drafts(ord, stem, ...) with name: the stem, or the stem and the least number from 2 on that taken(name) and earlier drafts
    leave free.

    The bare name of every stem is its first draft's, so no other stem's numbers reach it. A draft's place among those of
    its stem gives its number: the place-th of those that are free.
    """
    placed_ = running_count(drafts, ["stem"], "ord", "_place")
    used = taken.select("name").union(drafts.select(F.col("stem").alias("name"))).distinct()
    numbered = used.select(F.regexp_replace("name", r"-\d+$", "").alias("stem"), F.regexp_extract("name", r"-(\d+)$", 1).try_cast("long").alias("k")).where("k >= 2")
    bare = taken.select(F.col("name").alias("stem"), F.lit(1).cast("long").alias("k")).distinct()
    gone = numbered.union(bare).join(drafts.select("stem").distinct(), "stem", "left_semi").groupBy("stem").agg(F.sort_array(F.collect_set("k")).alias("_gone"))
    number = F.aggregate(F.coalesce("_gone", F.array().cast("array<bigint>")), F.col("_place") + 1, lambda x, t: F.when(t <= x, x + 1).otherwise(x))
    named = placed_.join(gone, "stem", "left").withColumn("_number", number)
    return named.select(*drafts.columns, F.when(F.col("_number") == 1, F.col("stem")).otherwise(F.concat_ws("-", "stem", F.col("_number").cast("string"))).alias("name"))


def transition(records: DataFrame, ident: int, status: str, reason: str, date: str) -> DataFrame:
    """The records with one at a new status and a note of the reason. Raises if the id is unknown or has the status."""
    mine = records.where((F.col("id") == ident) & ~F.col("broken")).select("status").limit(1).collect()
    if not mine or mine[0]["status"] == status:
        raise ValueError(f"record {ident} is unknown" if not mine else f"record {ident} is {status} already")
    hit = F.col("id").eqNullSafe(ident)
    note = F.lit(f"note: {date} {status}: {reason}")
    return records.withColumn("evidence", F.when(hit, F.array_append("evidence", note)).otherwise(F.col("evidence"))).withColumn("status", F.when(hit, F.lit(status)).otherwise(F.col("status")))


def promote(candidates: DataFrame, records: DataFrame, reviewer: str, today: str) -> DataFrame:
    """Candidates without lint errors, active, numbered on from the greatest id, with the reviewer among the authors."""
    same = records is candidates
    candidates = kept(candidates)  # each rule of lint() reads them again
    records = candidates if same else records
    bad = lint(candidates, today).where("level = 'error'").select("source").distinct()
    top = records.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    known = F.exists("authors", lambda a: F.lower(a) == reviewer.lower())
    good = placed(candidates.join(bad, "source", "left_anti"), "source").crossJoin(F.broadcast(top))
    numbered = good.withColumn("id", F.col("top") + F.col("pos")).drop("top", "pos")
    return numbered.withColumn("status", F.lit("active")).withColumn("authors", F.when(known, F.col("authors")).otherwise(F.array_append("authors", F.lit(reviewer))))
