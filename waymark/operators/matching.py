"""Records against files: which apply, how strongly, and the best of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..functions.patterns import folded, fragments, java, java_udf
from ..functions.text import MAX_SCAN, fire_key, full_block, label_line, pattern_hits, rank, short_block

FIRING = ("active", "challenged")
#: Strength of each signal.
STRENGTH = {"path": 2.0, "symbol": 2.25, "path_pattern": 1.5, "content_pattern": 2.5, "command": 2.5}
ACT_PROOF = ("content_pattern", "symbol", "command")
#: Different patterns that one pass over the texts has as literals, which Java compiles once, and passes of them at most; more
#: go by their fragments, so many at a time.
LITERALS, PASSES = 64, 1
PATTERNS_MOST = 100_000
#: Rows of a broadcast side at most.
BROADCAST_MOST = 10_000


def firing(anchors: DataFrame) -> DataFrame:
    return anchors.where(F.col("status").isin(*FIRING))


def hinted(small: DataFrame, most: int = BROADCAST_MOST) -> DataFrame:
    """small with a broadcast hint if it has at most `most` rows."""
    return F.broadcast(small) if small.limit(most + 1).count() <= most else small


def path_pairs(anchors: DataFrame, targets: DataFrame, path: str = "path") -> DataFrame:
    """anchors(value, ...) of kind path joined to the targets they cover, as a hash join.

    A raw prefix of length L covers a path if the path's first L characters equal it; so every path is looked up once
    for each different length among the anchors, of which there are at most as many as characters in a path.
    """
    prefixes = anchors.where("kind = 'path'").withColumn("prefix", F.rtrim("value", F.lit("/")))
    lengths = prefixes.agg(F.collect_set(F.length("prefix")).alias("lengths"))
    heads = targets.crossJoin(F.broadcast(lengths)).withColumn("_n", F.explode("lengths")).where(F.length(path) >= F.col("_n")).withColumn("prefix", F.expr(f"substring({path}, 1, _n)"))
    return prefixes.join(heads, "prefix").drop("prefix", "lengths", "_n")


def path_values(anchors: DataFrame, targets: DataFrame, path: str = "path") -> DataFrame:
    """(kind, value), distinct, of the path anchors that cover any target: path_pairs() without a row for each pair."""
    prefixes = anchors.where("kind = 'path'").select("kind", "value").distinct().withColumn("prefix", F.rtrim("value", F.lit("/")))
    lengths = prefixes.agg(F.collect_set(F.length("prefix")).alias("lengths"))
    heads = targets.select(path).crossJoin(F.broadcast(lengths)).withColumn("_n", F.explode("lengths")).where(F.length(path) >= F.col("_n"))
    return prefixes.join(heads.select(F.expr(f"substring({path}, 1, _n)").alias("prefix")).distinct(), "prefix", "left_semi").drop("prefix")


def pattern_pairs(anchors: DataFrame, targets: DataFrame, text: str, kind: str = "pattern") -> DataFrame:
    """Usable patterns of a kind joined to the targets whose text they hit."""
    return rows_hit(anchors.where(F.col("kind") == kind), targets, text)


def rows_hit(patterns: DataFrame, targets: DataFrame, text: str, flags: str = "(?iu)", value: str = "value") -> DataFrame:
    """patterns(value, ...) joined to the targets whose text they hit; those without a Java counterpart hit nothing.

    Up to LITERALS * PASSES different patterns go into the plan as literals, which Java compiles once. More are looked for
    all at once: one automaton of their literal fragments reads each text, and only patterns of which a text holds a
    fragment are tried on it. Those without a fragment are literals again. The driver gets PATTERNS_MOST different ones at
    a time; a table with more is as many passes.
    """
    different = patterns.select(F.col(value).alias("_value")).where("_value is not null").distinct()
    few = [r["_value"] for r in different.limit(PATTERNS_MOST + 1).collect()]
    if len(few) <= PATTERNS_MOST:
        return _hit_by(few, patterns, targets, text, flags, value)
    parts = -(-different.count() // PATTERNS_MOST) + 1  # one more, as hashing does not part evenly
    of = F.pmod(F.xxhash64("_value"), F.lit(parts))
    return reduce(DataFrame.union, [_hit_by([r["_value"] for r in different.where(of == i).collect()], patterns, targets, text, flags, value) for i in range(parts)])


def _hit_by(values: list[str], patterns: DataFrame, targets: DataFrame, text: str, flags: str, value: str) -> DataFrame:
    known = sorted((v, rx) for v in values if (rx := java(v)) is not None)
    named = targets.sparkSession.createDataFrame([(v, rx, i) for i, (v, rx) in enumerate(known)], "_value string, _rx string, _hit int")
    mine = patterns.join(F.broadcast(named), F.col(value) == F.col("_value")).drop("_value")
    whole, parts = list(enumerate(rx for _, rx in known)), []
    if len(known) > LITERALS * PASSES:
        held = [(f, i) for i, (v, _) in enumerate(known) for f in fragments(v)]
        found = {i for _, i in held}
        whole = [(i, rx) for i, rx in whole if i not in found]
        tried = _holding(targets, text, held).withColumn("_hit", F.explode("_hits")).drop("_hits").join(F.broadcast(named.select("_hit", "_rx")), "_hit")
        parts.append(tried.where(pattern_hits(F.col("_rx"), F.col(text), flags)).select(*targets.columns, "_hit"))
    for at in range(0, max(len(whole), not parts), LITERALS):
        hits = F.array_compact(F.array(*[F.when(pattern_hits(F.lit(rx), F.col(text), flags), F.lit(i)) for i, rx in whole[at : at + LITERALS]]).cast("array<int>"))
        parts.append(targets.withColumn("_hit", F.explode(hits)))
    return reduce(DataFrame.union, parts).join(mine, "_hit").drop("_hit", "_rx")


def _holding(targets: DataFrame, text: str, held: list[tuple[str, int]]) -> DataFrame:
    """targets with _hits: the numbers of held(fragment, number) of which the text's first MAX_SCAN characters hold a fragment."""
    return holding(targets, text, held, lambda t: folded(t[:MAX_SCAN]))


def holding(targets: DataFrame, text: str, held: list[tuple[str, int]], read: Callable[[str], str] = str) -> DataFrame:
    """targets with _hits: the numbers of held(fragment, number), fragments not empty, that read(text) holds, in one pass."""
    sent = targets.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[str, list[int]] = {}
        for fragment, i in sent.value:
            by.setdefault(fragment, []).append(i)
        automaton = ahocorasick.Automaton()
        for fragment, numbers in by.items():
            automaton.add_word(fragment, numbers)
        automaton.make_automaton()
        for b in batches:
            hits = [sorted({i for _, numbers in automaton.iter(read(t)) for i in numbers}) if t and by else [] for t in b.column(text).to_pylist()]
            yield b.append_column("_hits", pa.array(hits, pa.list_(pa.int32())))

    return targets.mapInArrow(run, StructType([*targets.schema.fields, StructField("_hits", ArrayType(IntegerType()))]))


def symbol_pairs(anchors: DataFrame, symbols: DataFrame) -> DataFrame:
    """anchors(value, ...) of kind symbol joined to the symbols(path, name, ...) that they may mean.

    `a.b` is any b at any depth inside any a; `path::` before it holds it to one file. Last parts of the names are the key
    of a hash join; what it brings together is verified.
    """
    last = lambda c: F.substring_index(c, ".", -1)
    here = F.contains("value", F.lit("::"))
    file = F.when(here, F.substring_index("value", "::", 1)).otherwise("")
    asked = anchors.where("kind = 'symbol'").withColumn("_file", file).withColumn("_name", F.when(here, F.expr("substring(value, locate('::', value) + 2)")).otherwise(F.col("value")))
    parts = F.transform(F.split("_name", r"\."), lambda p: F.concat(F.lit(r"\Q"), p, F.lit(r"\E")))
    inside = F.rlike("name", F.concat(F.lit(r"^(?:.*\.)?"), F.array_join(parts, r"\.(?:.*\.)?"), F.lit("$")))
    joined = asked.withColumn("_last", last("_name")).join(symbols.withColumn("_last", last("name")), "_last")
    return joined.where(F.col("_file").isin("") | (F.col("_file") == F.col("path"))).where(inside).drop("_last", "_file", "_name")


def signal_rows(anchors: DataFrame, targets: DataFrame, content: bool = True, symbols: DataFrame | None = None) -> DataFrame:
    """(id, source, severity, confidence, ord, path, name, strength, at): every hit of a firing anchor on a target, without any
    grouping, so targets(ord, path, content) may be a stream."""
    live = firing(anchors)
    record = ["id", "source", "severity", "confidence"]
    named = lambda df, name, at: df.select(*record, "ord", "path", F.lit(name).alias("name"), F.lit(STRENGTH[name]).alias("strength"), at.alias("at"))
    slim = targets.select("ord", "path")
    found = named(path_pairs(live, slim), "path", F.lit(0)).union(named(pattern_pairs(live, slim, "path"), "path_pattern", 2 * F.col("anchor_ord") + 2))
    if content:
        found = found.union(named(pattern_pairs(live, targets.where("content <> ''"), "content"), "content_pattern", 2 * F.col("anchor_ord") + 3))
    if symbols is not None:
        hits = symbol_pairs(live, symbols.select("path", "name").distinct()).join(slim, "path")
        found = found.union(named(hits, "symbol", F.lit(1)))
    return found


def signals(anchors: DataFrame, targets: DataFrame, content: bool = True, symbols: DataFrame | None = None) -> DataFrame:
    """(id, source, severity, confidence, ord, path, strength, matched_by) of firing anchors and targets(ord, path, content).

    strength is the greatest of the signals, matched_by their names in the order of the record's anchors. symbols(path,
    name) adds symbol signals; of several symbols that an anchor may mean, any will do.
    """
    record = ["id", "source", "severity", "confidence"]
    one = signal_rows(anchors, targets, content, symbols).groupBy(*record, "ord", "path", "name").agg(F.max("strength").alias("strength"), F.min("at").alias("at"))
    return one.groupBy(*record, "ord", "path").agg(
        F.max("strength").alias("strength"), F.transform(F.sort_array(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]).alias("matched_by")
    )


def ranked(found: DataFrame) -> DataFrame:
    act = F.arrays_overlap("matched_by", F.array(*[F.lit(x) for x in ACT_PROOF]))
    return found.withColumn("rank", rank(F.col("strength"), F.col("severity"), F.col("confidence"))).withColumn("act_proof", act)


def top_of_target(found: DataFrame, k: int) -> DataFrame:
    """The k best of every target: act-proof ones first, then by rank, ties by source."""
    w = Window.partitionBy("ord", "path").orderBy(F.col("act_proof").desc(), F.col("rank").desc(), "source")
    return found.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k)


def merge_best(tops: DataFrame, k: int) -> DataFrame:
    """The best k records over all targets, from each target's own top.

    A record counts with its highest rank, the first target's among equals; equals between records keep the order in
    which they first appear. What a target's top left out stays out.
    """
    key = F.coalesce(F.col("id").cast("string"), F.col("source"))
    placed = tops.withColumn("_key", key).withColumn("_at", F.struct("ord", "pos"))
    best = placed.groupBy("_key").agg(
        F.max_by(F.struct("id", "source", "path", "strength", "matched_by", "rank", "act_proof"), F.struct(F.col("rank"), -F.col("ord"), -F.col("pos"))).alias("b"), F.min("_at").alias("first")
    )
    order = [F.col("act_proof").desc(), F.col("rank").desc(), F.col("first.ord"), F.col("first.pos")]
    return best.select("b.*", "first").orderBy(*order).limit(k).withColumn("pos", F.row_number().over(Window.orderBy(*order))).drop("first")


def for_commands(anchors: DataFrame, commands: DataFrame, k: int = 3) -> DataFrame:
    """commands(ord, command) with the k best records whose command patterns hit them."""
    hits = pattern_pairs(firing(anchors), commands, "command", "command").select("id", "source", "severity", "confidence", "ord", "command").distinct()
    scored = hits.withColumn("rank", rank(F.lit(STRENGTH["command"]), F.col("severity"), F.col("confidence")))
    w = Window.partitionBy("ord").orderBy(F.col("rank").desc(), "source")
    return scored.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k)


def violations(anchors: DataFrame, rules: DataFrame, targets: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """(id, source, path, excerpt): rules(id, violation) that hit the content of a target near their record.

    Near means a signal without content; a record's own file never violates it. The excerpt is the line in which the
    first hit starts, at most 120 characters.
    """
    near = signals(anchors, targets, content=False, symbols=symbols).where("source <> path").select("id", "source", "ord", "path")
    armed = rules.withColumn("_rx", java_udf("violation")).where("_rx is not null").select("id", "_rx")
    text = F.substring("content", 1, 65_536)
    hit = near.join(armed, "id").join(targets.select("ord", "path", "content"), ["ord", "path"]).where(pattern_hits(F.col("_rx"), F.col("content")))
    found = F.regexp_instr(text, F.concat(F.lit("(?iu)"), F.col("_rx")))
    before = F.substring_index(F.substring(text, F.lit(1), found - 1), "\n", -1)
    after = F.substring_index(F.expr("substring(substring(content, 1, 65536), _at)"), "\n", 1)
    return hit.withColumn("_at", found).select("id", "source", "path", F.substring(F.concat(before, after), 1, 120).alias("excerpt"))


def covering(anchors: DataFrame, paths: DataFrame) -> DataFrame:
    """Records of any status whose path anchors cover a path or lie under it: paths(path) x id, distinct."""
    path = anchors.where("kind = 'path'").withColumn("bare", F.rtrim("value", F.lit("/")))
    down = path_pairs(path, paths).select("path", "id")
    # The other direction: the path is a prefix of the anchor. Anchors are few; their prefixes are looked up.
    heads = path.select("id", F.explode(F.transform(F.sequence(F.lit(0), F.length("bare")), lambda n: F.substring(F.col("bare"), F.lit(1), n))).alias("path"))
    return down.union(paths.join(heads, "path").select("path", "id")).distinct()


def brief_filter(anchors: DataFrame, paths: DataFrame) -> DataFrame:
    """Ids of firing records for a brief about paths(path): those with a path anchor that covers a path or lies under it,
    with a pattern that hits a path, or with a command anchor; all if a path is empty or a dot."""
    live = firing(anchors)
    whole = paths.where(F.rtrim("path", F.lit("/")).isin("", ".")).limit(1)
    near = path_pairs(live, paths).select("id").union(pattern_pairs(live, paths, "path").select("id")).union(live.where("kind = 'command'").select("id"))
    under = paths.select(F.concat(F.rtrim("path", F.lit("/")), F.lit("/")).alias("folder"))
    bare = live.where("kind = 'path'")
    heads = bare.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("value"), F.lit(1))), lambda n: F.substring(F.col("value"), F.lit(1), n))).alias("folder"))
    below = heads.join(under, "folder").select("id")
    every = bare.crossJoin(F.broadcast(whole.select(F.lit(1).alias("one")))).select("id")
    return near.union(below).union(every).distinct()


def drafts(ranked: DataFrame, live: DataFrame, n: int, taken: DataFrame) -> DataFrame:
    """The first n candidates of ranked(pos, id, title) that live(id) anchors somewhere, with fresh: whether their name is
    not in taken(name) yet. A name that is taken uses up its place all the same."""
    if not 1 <= n <= 20:
        raise ValueError("n must be between 1 and 20")
    alive = ranked.join(live.select("id").distinct(), "id", "left_semi").orderBy("pos").limit(n)
    used = taken.select("name", F.lit(True).alias("_used"))
    return alive.join(used, alive.id == used.name, "left").select(*ranked.columns, F.col("_used").isNull().alias("fresh"))


def shown(found: DataFrame, recent: DataFrame) -> DataFrame:
    """found(ord, path, id, act_proof, ...) with full: whether a record is shown with its body.

    Without proof in the edit itself, or if recent(path, id) has it shown in full lately, one line stands for it; reason says
    which of the two.
    """
    lately = recent.select("path", "id", F.lit(True).alias("_lately")).distinct()
    joined = found.join(lately, ["path", "id"], "left")
    reason = F.when(~F.col("act_proof"), "path-only match").when(F.col("_lately"), "shown in full lately")
    return joined.withColumn("reason", reason).withColumn("full", reason.isNull()).drop("_lately")


def contexts(shown: DataFrame, records: DataFrame, broken: DataFrame) -> DataFrame:
    """shown(ord, path, id, pos, full, reason) with records(id, type, status, severity, confidence, title, body) and
    broken(source) -> (ord, path, context): one text for each target, records in full first, then those that one line
    stands for and why, then which record files cannot be read."""
    label = label_line(F.col("type"), F.col("status"), F.col("id"), F.col("severity"), F.col("confidence"), F.col("title"))
    block = F.when(F.col("full"), full_block(label, F.col("body"))).otherwise(short_block(label, F.col("reason")))
    each = shown.join(records, "id").select("ord", "path", F.struct(~F.col("full"), "pos", block.alias("block")).alias("b"))
    told = each.groupBy("ord", "path").agg(F.sort_array(F.collect_list("b")).alias("b"))
    lost = broken.agg(F.count("*").alias("_lost"), F.array_join(F.sort_array(F.collect_set("source")), ", ").alias("_names"))
    head = F.format_string("%d record(s) apply to what is about to change. Honor these unless the user says otherwise.", F.size("b"))
    notice = F.when(F.col("_lost") > 0, F.format_string("%d record file(s) cannot be read and never apply: %s", F.col("_lost"), F.col("_names")))
    return told.crossJoin(F.broadcast(lost)).select("ord", "path", F.concat_ws("\n\n", head, F.array_join(F.transform("b", lambda x: x["block"]), "\n\n"), notice).alias("context"))


def respond(found: DataFrame, fired: DataFrame, trajectory: str = "trajectory") -> DataFrame:
    """found(trajectory, path, id, act_proof, ...) with key and block: a record blocks an action once, if the edit itself proves
    it and fired(key) has no earlier block of that record on that target in that trajectory; otherwise it is only shown."""
    keyed = found.withColumn("key", fire_key(F.col(trajectory), F.col("id").cast("string"), F.col("path")))
    before = fired.select("key", F.lit(True).alias("_before")).distinct()
    return keyed.join(before, "key", "left").withColumn("block", F.col("act_proof") & F.col("_before").isNull()).drop("_before")
