"""What happened: firing statistics, cooldown and once-only logic over logs, churn, signals of abandoned work."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import REVERT_SPEECH, USER_NEGATION

COOLDOWN = 4 * 3600
THROTTLE = 3600
BLOCK_TTL = 24 * 3600


def fire_stats(fires: DataFrame, keys: list[str]) -> DataFrame:
    """fires(keys, record_id, violated, ts) -> fired, violations, last_fired of each record."""
    return fires.groupBy(*keys).agg(F.count_if(~F.col("violated")).alias("fired"), F.count_if("violated").alias("violations"), F.max("ts").alias("last_fired"))


def never_fired(records: DataFrame, fires: DataFrame) -> DataFrame:
    return records.select("id").distinct().join(fires.where("not violated").select(F.col("record_id").alias("id")).distinct(), "id", "left_anti")


def advisories(stats: DataFrame, least: int = 20, share: float = 0.5) -> DataFrame:
    """Records that make up more than `share` of more than `least` firings."""
    whole = stats.crossJoin(F.broadcast(stats.agg(F.sum("fired").alias("total"))))
    return whole.where((F.col("total") > least) & (F.col("fired") / F.col("total") > share)).withColumn("share", F.col("fired") / F.col("total"))


def compliance(fires: DataFrame, armed: DataFrame) -> DataFrame:
    """Violations over firings of each record since it was armed: armed(record_id, armed_at)."""
    live = fires.join(armed, "record_id").where("ts >= armed_at")
    return live.groupBy("record_id").agg(F.count_if("violated").alias("violations"), F.count_if(~F.col("violated")).alias("fired"))


def _fold(events: DataFrame, keys: list[str], order: list[str], seconds: int, again: bool) -> DataFrame:
    """Marks the events that stand: the first of a key, then each that comes `seconds` after the last that stood.

    What an event does depends on the last event that stood, not on the last event, so this is a fold in order. Only the
    first event of a second can stand, so the fold passes over a key's different seconds, which Spark sorts and hands on
    batch by batch: a task remembers one time, never a key's events. Of events alike in keys, order and time one stands;
    without a time none does. again: an event exactly `seconds` later still waits.
    """
    firsts = events.where("t is not null").groupBy(*keys, "t").agg(F.min(F.struct(*order)).alias("_first"))

    def stand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, None
        for b in batches:
            hits = []
            for i, (t, *name) in enumerate(zip(b.column("t").to_pylist(), *(b.column(k).to_pylist() for k in keys))):
                if name != key:
                    key, last = name, None
                if last is None or t - last > seconds or (t - last == seconds and not again):
                    last = t
                    hits.append(i)
            yield b.take(pa.array(hits, pa.int64()))

    standing = firsts.repartition(*keys).sortWithinPartitions(*keys, "t").mapInArrow(stand, firsts.schema)
    marks = standing.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("t").alias("_t"), *[F.col(f"_first.{c}").alias(f"_first_{c}") for c in order], F.lit(True).alias("_stands"))
    pairs = [(k, f"_{k}") for k in keys] + [("t", "_t")] + [(c, f"_first_{c}") for c in order]
    same = reduce(Column.__and__, [F.col(a).eqNullSafe(F.col(b)) for a, b in pairs])
    different = events.groupBy(*keys, "t", *order).agg(F.count("*").alias("_n"))
    each = different.join(marks, same, "left").withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), "_n")))
    return each.select(*keys, *order, (F.coalesce("_stands", F.lit(False)) & (F.col("_i") == 1)).alias("stands"))


def cooldown(events: DataFrame, keys: list[str], order: list[str], seconds: int = COOLDOWN) -> DataFrame:
    """events(keys, order, t seconds) with stands: shown in full, because no full showing lies within `seconds` before."""
    return _fold(events, keys, order, seconds, again=True)


def block_once(events: DataFrame, keys: list[str], order: list[str], seconds: int = BLOCK_TTL) -> DataFrame:
    """events with stands: blocked, as the first of its key or the first after the last block ran out."""
    return _fold(events, keys, order, seconds, again=False)


def throttle(events: DataFrame, keys: list[str], order: list[str], seconds: int = THROTTLE) -> DataFrame:
    """events with stands: a check that runs, as none ran in the `seconds` before; at exactly that age it runs again."""
    return _fold(events, keys, order, seconds, again=False)


def remembered(fired: DataFrame, now: float, seconds: float = BLOCK_TTL, most: int = 1000) -> DataFrame:
    """fired(key, t) -> the last t of each key that has not run out, of the `most` newest keys: what stays remembered."""
    alive = fired.groupBy("key").agg(F.max("t").alias("t")).where(F.col("t") >= now - seconds)
    return alive.orderBy(F.col("t").desc(), "key").limit(most)


def churn(changes: DataFrame, last: int = 10, least: int = 4) -> DataFrame:
    """changes(seq, path), the smallest seq newest: paths in at least `least` of the `last` newest commits."""
    newest = changes.select("seq").distinct().orderBy("seq").limit(last)
    return changes.join(F.broadcast(newest), "seq").groupBy("path").agg(F.count_distinct("seq").alias("commits")).where(F.col("commits") >= least)


def transcript_signals(blocks: DataFrame, key: str = "session", extra: str | None = None) -> DataFrame:
    """blocks(key, role, kind, text, file, is_error) -> counts of a session, and triggered.

    Only an assistant's words of going back trigger. extra is one more pattern that counts as such words.
    """
    speech = f"(?iuU){REVERT_SPEECH}" + (f"|{extra}" if extra else "")
    text = (F.col("kind") == "text") & F.col("text").isNotNull()
    reverts = text & (F.col("role") == "assistant") & F.col("text").rlike(speech)
    negations = text & (F.col("role") == "user") & F.col("text").rlike(f"(?iu){USER_NEGATION}")
    per_file = blocks.where((F.col("kind") == "tool_use") & (F.col("file") != "")).groupBy(key, "file").count().groupBy(key).agg(F.max("count").alias("max_edits_one_file"))
    counts = blocks.groupBy(key).agg(F.count_if(reverts).alias("revert_language"), F.count_if(negations).alias("user_corrections"), F.count_if((F.col("kind") == "tool_result") & F.col("is_error")).alias("tool_errors"))
    return counts.join(per_file, key, "left").fillna(0, ["max_edits_one_file"]).withColumn("triggered", F.col("revert_language") >= 1)


def newest(lines: DataFrame, n: int) -> DataFrame:
    """The n newest of lines(line_no, ...): what truncating a log keeps."""
    return lines.orderBy(F.col("line_no").desc()).limit(n)


def last_labels(labels: DataFrame) -> DataFrame:
    """labels(id, label, line_no): the last line of each id wins; other labels than keep and discard are passed over."""
    return labels.where(F.col("label").isin("keep", "discard")).groupBy("id").agg(F.max_by("label", "line_no").alias("label"))


def draft_window(last_check: float | None, now: float, most: float = 24 * 3600) -> float:
    """Where the window of a draft check begins: at the last check, but at most `most` seconds back."""
    return max(last_check or 0.0, now - most)


def stale(markers: DataFrame, now: float, days: float = 7) -> DataFrame:
    """markers(name, mtime seconds) older than `days`, the limit itself excluded."""
    return markers.where(F.col("mtime") < now - days * 86_400)


def ages(candidates: DataFrame, now: float) -> DataFrame:
    """candidates(name, mtime) with their age in days, oldest first."""
    return candidates.select("name", F.round((now - F.col("mtime")) / 86_400, 1).alias("days")).orderBy(F.col("days").desc(), "name")


def histogram(values: DataFrame, bins: int = 10) -> DataFrame:
    """values(value) between 0 and 1 in equal bins, the last closed: (bin, n)."""
    return values.groupBy(F.least(F.floor(F.col("value") * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def survival(outcomes: DataFrame) -> DataFrame:
    """outcomes(outcome) -> survived, failed and the share of survivors among both."""
    survived, failed = F.count_if(F.col("outcome") == "survived"), F.count_if(F.col("outcome") == "failed")
    return outcomes.agg(survived.alias("survived"), failed.alias("failed"), F.when(survived + failed > 0, survived / (survived + failed)).alias("share"))


def spread(values: DataFrame) -> DataFrame:
    """values(value) -> n, median, least and most."""
    v = F.col("value")
    return values.agg(F.count(v).alias("n"), F.median(v).alias("median"), F.min(v).alias("least"), F.max(v).alias("most"))
