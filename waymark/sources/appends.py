"""What is appended to logs of JSON lines: showings, violations, drafts and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def showing_lines(shown: DataFrame, runtime: str) -> DataFrame:
    """shown(ts, repo, target, id, pos, full) -> one JSON line for every ts, repo and target: the ids in order of pos, and
    those of them that one line stood for."""
    ids = lambda rows: F.transform(rows, lambda x: x["id"])
    each = shown.groupBy("ts", "repo", "target").agg(F.sort_array(F.collect_list(F.struct("pos", "id", "full"))).alias("s"))
    return each.select(_line(ts="ts", repo="repo", target="target", scar_ids=ids(F.col("s")), count=F.size("s"), demoted_ids=ids(F.filter("s", lambda x: ~x["full"])), runtime=F.lit(runtime)))


def violation_lines(violated: DataFrame, runtime: str) -> DataFrame:
    """violated(ts, repo, target, id) -> one JSON line for every ts, repo and target."""
    each = violated.groupBy("ts", "repo", "target").agg(F.sort_array(F.collect_list("id")).alias("s"))
    return each.select(_line(ts="ts", repo="repo", target="target", violation_ids=F.col("s"), count=F.size("s"), runtime=F.lit(runtime)))


def label_lines(labels: DataFrame) -> DataFrame:
    """Labels that mining.label_requests did not refuse, as JSON lines."""
    return labels.where("refused is null").select(_line(id="id", label="label", note=F.coalesce("note", F.lit("")), date="date"))


def draft_lines(drafts: DataFrame) -> DataFrame:
    """Every row of drafts as a JSON line of its columns."""
    return drafts.select(_line(**{c: c for c in drafts.columns}))


def _line(**values: Column | str) -> Column:
    return F.to_json(F.struct(*[(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in values.items()]), {"ignoreNullFields": "false"}).alias("value")


def append(lines: DataFrame, folder: str) -> None:
    """Appends lines(value) to a folder of text files, which the readers of JSON lines take as one log."""
    lines.write.mode("append").text(folder)
