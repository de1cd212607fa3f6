"""Column functions over records, paths, candidates and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of a text that one pattern may scan.
MAX_SCAN = 65_536
#: Weights of severities; an unknown one weighs as medium.
SEVERITY_WEIGHT = {"low": 1, "medium": 2, "high": 3, "critical": 4}
#: Languages of reverts in commit subjects, in assistants' and in users' messages, and marked comments.
REVERT_SUBJECT = r"revert|rollback|roll back|downgrade|back to|undo|set back|retire|disable again"
REVERT_SPEECH = r"revert(ing|ed)?\b|roll(ing|ed)? back|undo(ing)? (the|that|my)|abandon(ing|ed)? (the|this|that|this approach)|scrap(ping)? (the|this|that)|back to the (original|previous)"
USER_NEGATION = r"didn'?t work|doesn'?t work|still (broken|failing|not working)|that broke|go back|revert|undo that|no funciona|sigue (roto|fallando)|volv[ée] al?"
MARKED_COMMENT = r"DO NOT|DON'T|do not (remove|change|touch)|HACK|XXX|load.?bearing|intentional|must (stay|remain)|workaround"
HIGH_COMMENT = r"DO NOT|DON'T|do not (remove|change|touch)|load.?bearing|must (stay|remain)"
PR_REF = r"#\d+"
VENDORED = ("node_modules", "vendor", ".tessl", ".kiro")


def path_covers(anchor: Column, path: Column) -> Column:
    """A raw prefix without trailing slashes: src1 covers src12/x, and / covers everything."""
    return F.startswith(path, F.rtrim(anchor, F.lit("/")))


def pattern_hits(pattern: Column, text: Column, flags: str = "(?iu)") -> Column:
    """A search that ignores case in the first MAX_SCAN characters. Patterns must be Java's: see patterns.java()."""
    return F.rlike(F.substring(text, 1, MAX_SCAN), F.concat(F.lit(flags), pattern))


def severity_weight(severity: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SEVERITY_WEIGHT.items() for x in kv]), severity), F.lit(2))


def rank(strength: Column, severity: Column, confidence: Column) -> Column:
    return strength * severity_weight(severity).cast("double") * confidence


def rule_line(body: Column, most: int = 140) -> Column:
    """The first sentence of a body with blanks collapsed, at most `most` characters."""
    text = F.trim(F.regexp_replace(body, r"\s+", " "))
    at = F.instr(text, ". ")
    return F.substring(F.when(at > 0, F.substring(text, F.lit(1), at)).otherwise(text), 1, most)


def label_line(kind: Column, status: Column, ident: Column, severity: Column, confidence: Column, title: Column) -> Column:
    label = F.when(status == "challenged", F.concat(F.lit("challenged "), kind)).otherwise(kind)
    return F.format_string("[%s #%s | severity: %s | confidence: %s] %s", label, ident.cast("string"), severity, confidence.cast("string"), title)


def recency(date: Column, now_months: int, most: float = 1.0) -> Column:
    """most up to twelve months of age, nothing from sixty, a line between; nothing for what is no year-month."""
    year, month = F.regexp_extract(date, r"^\s*(-?\d+)\s*-", 1), F.regexp_extract(date, r"^[^-]+-\s*(\d+)\s*(?:-|$)", 1)
    age = now_months - (year.try_cast("int") * 12 + month.try_cast("int"))
    return F.when(age.isNull(), 0.0).when(age <= 12, most).when(age >= 60, 0.0).otherwise(most * (60 - age) / (60 - 12))


def candidate_score(now_months: int) -> Column:
    """The score of a mined candidate, from the columns that its section fills; unknown sections score nothing."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return (
        F.when(F.col("section") == "revert", 3.0 + F.when(text("subject").rlike(PR_REF), 1.5).otherwise(0.0) + recency(text("date"), now_months))
        .when(F.col("section") == "deleted_component", 2.5 + F.when(F.coalesce(F.col("files_deleted"), F.lit(0)) > 3, 1.0).otherwise(0.0) + recency(text("died"), now_months))
        .when(F.col("section") == "flapping", 2.0 + 0.5 * (F.coalesce(F.col("oscillation_count"), F.lit(1)) - 1))
        .when(F.col("section") == "comment", 1.0 + F.when(text("text").rlike(f"(?iu){HIGH_COMMENT}"), 1.5).otherwise(0.0))
        .otherwise(0.0)
        .cast("double")
    )


def candidate_id() -> Column:
    """Ten hex digits that stay the same while a candidate's identifying fields do."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    key = (
        F.when(F.col("section") == "revert", F.concat(F.lit("revert:"), text("commit")))
        .when(F.col("section") == "deleted_component", F.concat(F.lit("deleted_component:"), text("component")))
        .when(F.col("section") == "flapping", F.concat(F.lit("flapping:"), text("file"), F.lit(":"), text("key")))
        .otherwise(F.concat(F.lit("comment:"), text("location"), F.lit(":"), F.substring(text("text"), 1, 40)))
    )
    return F.substring(F.sha1(key.cast("binary")), 1, 10)


def slug(text: Column, most: int = 60) -> Column:
    """Lower case with dashes, cut at a dash before `most` characters where there is one."""
    whole = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    head = F.substring(whole, 1, most)
    short = F.regexp_replace(head, "-[^-]*$", "")
    return F.when(F.length(whole) <= most, whole).otherwise(F.regexp_replace(short, "-+$", ""))


def short_slug(text: Column, empty: str, most: int = 60) -> Column:
    """Lower case with dashes, cut at `most` characters wherever that is; `empty` for what has no letter or digit."""
    whole = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(whole == "", F.lit(empty)).otherwise(F.substring(whole, 1, most))


def strip(text: Column) -> Column:
    """text without blanks of any kind at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def telling_line(lines: Column, most: int = 200) -> Column:
    """Of an array of lines the longest, the greatest of several, cut at `most` characters; null of none."""
    best = F.array_max(F.transform(lines, lambda x: F.struct(F.length(x).alias("n"), x.alias("line"))))
    return F.substring(best["line"], 1, most)


def is_concrete(anchor: Column) -> Column:
    return ~anchor.endswith("/") & ~anchor.rlike(r"[*?\[]")


def has_segment(path: Column, names: tuple[str, ...]) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(x) for x in names]))


def edit_text(content: str = "content", new_string: str = "new_string", new_source: str = "new_source", edits: str = "edits") -> Column:
    """The text that an edit request brings: its fields, then those of its parts, joined by blanks."""
    return F.concat_ws(" ", content, new_string, new_source, F.transform(edits, lambda e: e["new_string"]))


def fire_key(trajectory: Column, record: Column, target: Column) -> Column:
    return F.concat_ws("|", F.coalesce(trajectory, F.lit("unknown")), record, target)


def overlap(dead: Column, other: Column) -> Column:
    """Share of the dead lines that the other set holds; nothing if there are none."""
    n = F.size(F.array_distinct(dead))
    return F.when(n > 0, F.size(F.array_intersect(dead, other)) / n).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all; two empty sets are equal."""
    whole = F.size(F.array_union(a, b))
    return F.when(whole > 0, F.size(F.array_intersect(a, b)) / whole).otherwise(1.0)


def tier(ratio: Column, high: float = 0.6, low: float = 0.2) -> Column:
    return F.when(ratio >= high, "high").when(ratio >= low, "low")


def signature_lines(text: Column, least: int = 10) -> Column:
    """Distinct trimmed lines of at least `least` characters."""
    lines = F.transform(F.split(text, "\r\n|\r|\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.array_distinct(F.filter(lines, lambda x: F.length(x) >= least))


def shingles(tokens: Column, n: int = 3) -> Column:
    """Distinct n-grams joined by bars; of fewer tokens the distinct tokens."""
    size = F.size(tokens)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(size - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, n), "|"))
    return F.array_distinct(F.when(size < n, tokens).otherwise(grams))


def sanitize(text: Column) -> Column:
    """Mined text on one line, without what would break a record's head: quotes, bars of comments, fences."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[\"'`]", ""), r"(?m)^\s*(#+|//+|/?\*+)\s*", ""), r"\s+", " "))


def draft_title(section: Column) -> Column:
    """The title of a record drafted from a mined candidate."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return (
        F.when(section == "revert", sanitize(text("subject")))
        .when(section == "deleted_component", F.concat(F.lit("removed component "), text("component")))
        .when(section == "flapping", F.concat(F.lit("oscillating "), text("key"), F.lit(" in "), text("file")))
        .otherwise(sanitize(text("text")))
    )


def draft_evidence(section: Column) -> Column:
    """The evidence of a record drafted from a mined candidate."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return (
        F.when(section == "revert", F.concat(F.lit("commit: "), text("commit")))
        .when(section == "deleted_component", F.concat(F.lit("commit: "), text("death_commit")))
        .when(section == "flapping", F.concat(F.lit("note: harvest flapping signal "), text("sequence"), F.lit(" in "), text("file")))
        .otherwise(F.concat(F.lit("note: harvest comment signal at "), text("location")))
    )


def harvest_line(section: Column) -> Column:
    """A mined candidate on one line: its id and score, then what its section has to say."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    said = (
        F.when(section == "revert", F.format_string("`%s` %s — %s", text("commit"), text("date"), text("subject")))
        .when(section == "deleted_component", F.format_string("**%s** died %s (`%s` %s)", text("component"), text("died"), text("death_commit"), text("death_subject")))
        .when(section == "flapping", F.format_string("`%s` **%s**: %s", text("file"), text("key"), text("sequence")))
        .otherwise(F.format_string("`%s` — %s", text("location"), text("text")))
    )
    return F.concat(F.format_string("- [%s score %.1f] ", F.col("id"), F.col("score")), said)


def dead_summary(dead_paths: Column, dead_patterns: Column, renamed: Column | None = None) -> Column:
    """Dead anchors in words; renamed is a map from a dead path to where it went."""
    named = (lambda p: F.coalesce(F.concat(F.lit("renamed: "), p, F.lit(" -> "), F.element_at(renamed, p)), p)) if renamed is not None else (lambda p: p)
    paths = F.when(F.size(dead_paths) > 0, F.concat(F.lit("paths: "), F.array_join(F.transform(dead_paths, named), ", ")))
    patterns = F.when(F.size(dead_patterns) > 0, F.concat(F.lit("patterns: "), F.array_join(F.transform(dead_patterns, lambda p: F.concat(F.lit("/"), p, F.lit("/"))), ", ")))
    return F.concat_ws("; ", paths, patterns)


def _migration(dead_patterns: Column) -> Column:
    hint = " — hint: a pattern that guards against reintroduction (healthy when absent) belongs in violation:, not anchors"
    return F.when(F.size(dead_patterns) > 0, hint).otherwise("")


def orphan_reason(dead_paths: Column, dead_patterns: Column, nothing: str, renamed: Column | None = None) -> Column:
    """Why a record points at nothing; `nothing` is said of one without anchors."""
    none = (F.size(dead_paths) == 0) & (F.size(dead_patterns) == 0)
    return F.when(none, nothing).otherwise(F.concat(F.lit("all anchors dead ("), dead_summary(dead_paths, dead_patterns, renamed), F.lit(")"), _migration(dead_patterns)))


def rot_reason(dead_paths: Column, dead_patterns: Column, renamed: Column | None = None) -> Column:
    return F.concat(F.lit("partial rot — dead anchor(s) ("), dead_summary(dead_paths, dead_patterns, renamed), F.lit(")"), _migration(dead_patterns))


def drift_reason(symbol: Column, similarity: Column, sha: Column) -> Column:
    return F.format_string("%s ~%s%% similar since %s", symbol, F.bround(similarity * 100).cast("int").cast("string"), F.substring(sha, 1, 7))


def full_block(label: Column, body: Column, most: int = 700) -> Column:
    """What is shown of a record in full: its label and the beginning of its body."""
    return F.concat(label, F.lit("\n"), F.substring(body, 1, most))


def short_block(label: Column, reason: Column) -> Column:
    """What is shown of a record that was shown in full lately."""
    return F.concat(label, F.lit(" - "), reason)
