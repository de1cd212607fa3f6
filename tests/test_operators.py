"""The library's own operators on small inputs with known answers."""

import json
import random

import pytest
from pyspark.sql import functions as F

from waymark.functions import patterns
from waymark.functions import text as X
from waymark.operators import activity, health, matching, mining, reanchor, tables
from waymark.plans import adapters as A
from waymark.sources import logs, records

ANCHOR = "id long, source string, kind string, value string, anchor_ord int, severity string, confidence double, status string"


def anchor(i, kind, value, severity="medium", confidence=0.5, status="active", at=0):
    return (i, f"records/{i}.md", kind, value, at, severity, confidence, status)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def files(spark, *rows):
    return frame(spark, [(i, p, c) for i, (p, c) in enumerate(rows)], "ord long, path string, content string")


def test_prefixes_are_raw(spark):
    a = frame(spark, [anchor(1, "path", "src1"), anchor(2, "path", "src1/"), anchor(3, "path", "/"), anchor(4, "path", "other")], ANCHOR)
    f = files(spark, ("src1/a", ""), ("src12/b", ""), ("x", ""))
    got = {(r.id, r.path) for r in matching.path_pairs(a, f).collect()}
    assert got == {(i, p) for i in (1, 2) for p in ("src1/a", "src12/b")} | {(3, p) for p in ("src1/a", "src12/b", "x")}


def test_content_outranks_path_and_survives_the_cut(spark):
    loud = [anchor(i, "path", "payments/", "critical", 1.0) for i in (1, 2, 3, 4)]
    quiet = [anchor(5, "path", "payments/", "low", 0.3), anchor(5, "pattern", "forbidden_widget", "low", 0.3, at=1)]
    f = files(spark, ("payments/x.py", "use FORBIDDEN_WIDGET now"))
    top = matching.top_of_target(matching.ranked(matching.signals(frame(spark, loud + quiet, ANCHOR), f)), 3).orderBy("pos").collect()
    assert [r.id for r in top] == [5, 1, 2] and top[0].matched_by == ["path", "content_pattern"] and top[0].rank == pytest.approx(2.5 * 0.3)


def test_scan_cap_and_bad_patterns(spark):
    a = frame(spark, [anchor(1, "pattern", "needle"), anchor(2, "pattern", "(unclosed")], ANCHOR)
    f = files(spark, ("a", "x" * 65_536 + "needle"), ("b", "needle" + "x" * 70_000))
    assert {(r.id, r.path) for r in matching.signals(a, f).collect()} == {(1, "b")}


def test_merge_takes_the_best_target_and_first_appearance(spark):
    a = frame(spark, [anchor(1, "path", "a"), anchor(2, "path", "b"), anchor(3, "pattern", "hot", "high")], ANCHOR)
    f = files(spark, ("a/1", ""), ("b/1", ""), ("a/2", "hot"))
    merged = matching.merge_best(matching.top_of_target(matching.ranked(matching.signals(a, f)), 3), 3).orderBy("pos").collect()
    assert [(r.id, r.path) for r in merged] == [(3, "a/2"), (1, "a/1"), (2, "b/1")]


def test_commands_with_look_ahead(spark):
    a = frame(spark, [anchor(1, "command", "uv sync(?!.* --all-extras)")], ANCHOR)
    c = frame(spark, [(1, "uv sync"), (2, "uv sync --all-extras")], "ord long, command string")
    assert [r.ord for r in matching.for_commands(a, c).collect()] == [1]


def test_violations_skip_their_own_file(spark):
    a = frame(spark, [anchor(1, "path", "payments/"), anchor(1, "path", "records/", at=1)], ANCHOR)
    rules = frame(spark, [(1, r"sleep\((?:[0-6])\)")], "id long, violation string")
    f = files(spark, ("payments/x.py", "import time\n  time.sleep(3)\nend"), ("records/1.md", "sleep(3)"), ("other.py", "sleep(3)"))
    assert [(r.path, r.excerpt) for r in matching.violations(a, rules, f).collect()] == [("payments/x.py", "  time.sleep(3)")]


def test_symbols_join_by_name(spark):
    code = "class Foo:\n    def bar(self):\n        return 1\n"
    d = logs.definitions(frame(spark, [("a.py", code), ("bad.py", "def (")], "path string, content string"))
    assert {r.name for r in d.collect()} == {"Foo", "Foo.bar"}
    a = frame(spark, [anchor(1, "symbol", "Foo.bar"), anchor(2, "symbol", "gone")], ANCHOR)
    got = matching.signals(a, files(spark, ("a.py", code)), symbols=d.select("path", "name")).collect()
    assert [(r.id, r.strength, r.matched_by) for r in got] == [(1, 2.25, ["symbol"])]
    assert [r.value for r in health.lost_symbols(a, d).collect()] == ["gone"]


def test_liveness(spark):
    rows = [anchor(1, "path", "gone/"), anchor(2, "pattern", "only_here"), anchor(3, "path", "gone/"), anchor(3, "path", "src/", at=1), anchor(4, "command", "rm"), anchor(5, "symbol", "Foo"), anchor(6, "path", "gone/", status="archived"), anchor(7, "pattern", "bad(", at=0)]
    a = frame(spark, rows, ANCHOR)
    f = files(spark, ("src/a", "text"), ("records/2.md", "only_here"), ("big", None))
    assert {r.id for r in health.orphans(a, f).collect()} == {1, 2, 5, 7}
    rot = health.partial_rot(a, f).collect()
    assert [(r.id, r.dead_paths) for r in rot] == [(3, ["gone/"])]
    back = frame(spark, [anchor(2, "pattern", "only_here", status="orphaned")], ANCHOR)
    assert health.revived(back, f).count() == 1


def test_overbroad_needs_enough_files(spark):
    a = frame(spark, [anchor(1, "path", "apps/")], ANCHOR)
    many = files(spark, *[(f"apps/{i}", "") for i in range(15)], *[(f"tools/{i}", "") for i in range(5)])
    assert [(r.covered, r.share) for r in health.overbroad(a, many).collect()] == [(15, 0.75)]
    assert health.overbroad(a, many.where("ord < 15")).count() == 0


@pytest.mark.parametrize("values, n", [("ABA", 1), ("ABABA", 2), ("ABABABA", 3), ("ABC", 0), ("AAA", 0), ("ABAB", 1), ("ABACA", 2)])
def test_oscillations(spark, values, n):
    h = frame(spark, [("f", "k", v, i, f"c{i}") for i, v in enumerate(values)], "file string, key string, value string, seq long, sha string")
    got = mining.flapping(h).collect()
    assert (got[0].oscillation_count if got else 0) == n
    if n:
        assert got[0].sequence == "A -> B -> A"


def test_scores(spark):
    schema = "section string, subject string, date string, died string, files_deleted long, oscillation_count long, text string"
    rows = [
        ("revert", "Revert #12", "2025-06-01", None, None, None, None, 5.5), ("revert", "Revert", "2025-06-01", None, None, None, None, 4.0),
        ("deleted_component", None, None, "2025-06-01", 4, None, None, 4.5), ("deleted_component", None, None, "2025-06-01", 3, None, None, 3.5),
        ("revert", "x", "1999-01", None, None, None, None, 3.0), ("revert", "x", "junk", None, None, None, None, 3.0),
        ("flapping", None, None, None, None, 2, None, 2.5), ("comment", None, None, None, None, None, "do not touch", 2.5), ("comment", None, None, None, None, None, "HACK", 1.0), ("odd", None, None, None, None, None, None, 0.0),
    ]
    got = frame(spark, [r[:-1] for r in rows], schema).select(X.candidate_score(24310)).collect()
    assert [r[0] for r in got] == [r[-1] for r in rows]


def test_precision(spark):
    ranked = frame(spark, [(i + 1, c) for i, c in enumerate("ABCDE")], "pos long, id string")
    labels = frame(spark, [("A", True), ("B", False), ("D", True)], "id string, keep boolean")
    got = {r.n: (r.precision, r.labeled_in_top) for r in mining.precision(ranked, labels, [1, 3, 5, 20]).collect()}
    assert got == {1: (1.0, 1), 3: (0.5, 2), 5: (pytest.approx(2 / 3), 3)}
    assert mining.precision(ranked, labels.limit(0), [3]).first().precision == 0.0


def test_deleted_components(spark):
    gone = frame(spark, [(1, "s1", "2024-02-01", "kill", "apps/short/a"), (2, "s2", "2024-01-01", "old", "apps/short/b"), (3, "s3", "2024-01-01", "x", "apps/live/c"), (4, "s4", "2024-01-01", "x", "top")], "seq long, sha string, date string, subject string, path string")
    got = mining.deleted_components(gone, frame(spark, [("apps/live/d",)], "path string")).collect()
    assert [(r.component, r.died, r.death_commit, r.files_deleted) for r in got] == [("apps/short", "2024-02-01", "s1", 2)]


def test_renames(spark):
    edges = [("a", "b"), ("b", "c"), ("x", "y"), ("x", "z"), ("p", "x"), ("l", "m"), ("m", "l"), ("d", "e"), ("d", "e"), ("g", "gone")]
    starts = [(s,) for s in ("a", "x", "p", "l", "d", "g", "nohop")]
    got = {r.path: r.terminal for r in reanchor.rename_terminal(frame(spark, edges, "old string, new string"), frame(spark, starts, "path string"), frame(spark, [("c",), ("y",), ("l",), ("e",), ("nohop",)], "path string")).collect()}
    assert got == {"a": "c", "x": None, "p": None, "l": None, "d": "e", "g": None, "nohop": None}


def test_renames_along_a_long_chain(spark):
    n = 3000
    edges = [(f"f{i}", f"f{i + 1}") for i in range(n)] + [("q0", "q1"), ("q1", "q2"), ("q2", "q0"), ("into", "q0"), (None, "x"), ("y", None)]
    starts = [("f0",), ("f1",), (f"f{n - 1}",), (f"f{n}",), ("q1",), ("into",), (None,)]
    got = {r.path: r.terminal for r in reanchor.rename_terminal(frame(spark, edges, "old string, new string"), frame(spark, starts, "path string"), frame(spark, [(f"f{n}",), ("q0",)], "path string")).collect()}
    assert got == {"f0": f"f{n}", "f1": f"f{n}", f"f{n - 1}": f"f{n}", f"f{n}": None, "q1": None, "into": None, None: None}


def test_positions_over_the_whole_table(spark):
    values = [(i, i * 7919 % 501) for i in range(2000)] + [(None, 3), (5000, None)]
    got = tables.placed(frame(spark, values, "id long, v long").repartition(7), F.col("v").desc(), "id").orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(1, 2003))
    assert [(r.id, r.v) for r in got] == sorted(values, key=lambda r: (r[1] is None, -(r[1] or 0), r[0] is not None, r[0] or 0))
    assert tables.placed(frame(spark, [], "id long, v long"), "v").count() == 0


def test_overlap_and_eligibility(spark):
    lines = "\n".join(f"a line of code {i}" for i in range(10))
    dead = frame(spark, [(1, lines)], "id long, text string")
    others = frame(spark, [("same", lines), ("copy", lines), ("part", "\n".join(lines.split("\n")[:3])), ("none", "short")], "path string, text string")
    got = {(r.path, r.ratio, r.tier) for r in reanchor.line_overlap(dead, others).collect()}
    assert got == {("same", 1.0, "high"), ("copy", 1.0, "high"), ("part", 0.3, "low")}
    p = frame(spark, [(1, "d", "x", "high"), (2, "d", "x", "low"), (3, "d", "x", "high"), (3, "d", "y", "high")], "id long, dead string, proposed string, tier string")
    assert {r.id: (r.outcome, r.proposed) for r in reanchor.eligible(p).collect()} == {1: ("applied", "x"), 2: ("low confidence", None), 3: ("ambiguous", None)}


def test_rewrite_changes_values_only(spark):
    text = "---\nanchors:\n  - path: \"a/b\"  # why\n  - pattern: a/b\n---\na/b\n"
    got = reanchor.rewrite_anchors(frame(spark, [("s", text)], "source string, text string"), frame(spark, [("s", "a/b", "c/d")], "source string, old string, new string")).first().text
    assert got == text.replace('"a/b"', '"c/d"')


def test_jaccard_and_shingles(spark):
    row = frame(spark, [(["a", "b", "c", "d"], ["a", "b"])], "t array<string>, u array<string>").select(X.shingles(F.col("t")).alias("x"), X.shingles(F.col("u")).alias("y"), X.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("j")).first()
    assert row.x == ["a|b|c", "b|c|d"] and row.y == ["a", "b"] and row.j == 1.0


def test_cooldown_counts_from_the_last_full_showing(spark):
    e = frame(spark, [("k", i, t) for i, t in enumerate((0, 10_000, 14_400, 14_401, 20_000))], "k string, ord long, t long")
    got = {r.ord: r.stands for r in activity.cooldown(e, ["k"], ["ord"]).collect()}
    assert got == {0: True, 1: False, 2: False, 3: True, 4: False}
    once = {r.ord: r.stands for r in activity.block_once(e, ["k"], ["ord"], 14_400).collect()}
    assert once == {0: True, 1: False, 2: True, 3: False, 4: False}


@pytest.mark.parametrize("call, seconds, again", [(activity.cooldown, 50, True), (activity.block_once, 50, False)])
def test_fold_against_a_plain_loop(spark, call, seconds, again):
    r = random.Random(seconds)
    rows = [(r.choice(("a", "b", None)), i, r.choice((None, r.randint(0, 600), r.randint(0, 12) * 50)), "x") for i in range(700)]
    want = {}
    last = {}
    for k, i, t, _ in sorted(rows, key=lambda x: (x[2] or 0, x[1])):
        gap = None if t is None or k not in last else t - last[k]
        want[i] = t is not None and (k not in last or gap > seconds or (gap == seconds and not again))
        if want[i]:
            last[k] = t
    got = call(frame(spark, rows, "k string, ord long, t long, other string").repartition(5), ["k"], ["ord"], seconds)
    assert got.columns == ["k", "ord", "stands"] and {x.ord: x.stands for x in got.collect()} == want


def test_liveness_asks_each_value_once(spark):
    a = frame(spark, [anchor(i, "path", "src/") for i in range(300)] + [anchor(i, "pattern", "fence[s]") for i in range(300)] + [anchor(300, "pattern", "records/300")], ANCHOR)
    f = files(spark, *[(f"src/{i}", "two fences") for i in range(300)], ("records/300.md", ""))
    live = health.anchor_liveness(a, f)
    assert {(r.id, r.kind) for r in live.where("not live").collect()} == {(300, "pattern")} and live.count() == 601
    values = matching.path_values(a, f.select("path"))
    assert [tuple(r) for r in values.collect()] == [("path", "src/")]


def test_fold_marks_one_of_equal_events(spark):
    rows = [("k", 1, 0), ("k", 1, 0), ("k", 1, 50), ("k", 2, 100), ("k", 2, 100)]
    got = activity.block_once(frame(spark, rows, "k string, ord long, t long"), ["k"], ["ord"], 100).collect()
    assert sorted((r.ord, r.stands) for r in got) == [(1, False), (1, False), (1, True), (2, False), (2, True)]


def test_seconds_of_events_are_the_nearest(spark, tmp_path):
    times = ["2024-01-01 00:00:00.4", "2024-01-01 00:00:00.5", "2024-01-01 00:00:01.5", "2024-01-01 00:00:01.7"]
    e = frame(spark, [(i, 1, "view", '{"k": 1}', t) for i, t in enumerate(times)], "event_id long, user_id long, event_type string, props string, at string")
    e.withColumn("ts", F.expr("cast(at as timestamp)")).drop("at").write.parquet(f"{tmp_path}/events.parquet")
    rows = A.fires(spark, str(tmp_path)).withColumn("base", F.expr("unix_timestamp(timestamp'2024-01-01 00:00:00')")).collect()
    assert sorted((r.event_id, r.t - r.base) for r in rows) == [(0, 0), (1, 0), (2, 2), (3, 2)]


def test_stream_keeps_state_between_batches(spark, tmp_path):
    from waymark import streaming

    e = frame(spark, [("k", i, t) for i, t in enumerate((0, 10_000, 14_400, 14_401, 20_000, 40_000))], "k string, ord long, t long")
    for n in range(2):
        e.where(F.col("ord") % 6 >= 3 if n else F.col("ord") < 3).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, ord long, t long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streaming.cooldown(stream, ["k"]).writeStream.format("memory").queryName("cool").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.ord: r.stands for r in spark.table("cool").collect()}
    want = {r.ord: r.stands for r in activity.cooldown(e, ["k"], ["ord"]).collect()}
    assert len(q.recentProgress) >= 2 and got == want


def test_firing_log(spark):
    lines = ['{"ts":"t1","repo":"r","scar_ids":[1]}', '{"ts":"t2","repo":"r","scar_ids":[1,2,"x",2.5,true]}', "", "null", "[]", "7", "{bad", '{"ts":"t3","violation_ids":"no"}', '{"ts":"t3","violation_ids":[2]}']
    f = logs.firings(frame(spark, list(enumerate(lines)), "line_no long, value string"))
    got = {(r.repo, r.record_id): (r.fired, r.violations, r.last_fired) for r in activity.fire_stats(f, ["repo", "record_id"]).collect()}
    assert got[("r", 2)] == (1, 0, "t2") and got[("(unknown)", 2)] == (0, 1, "t3") and got[("r", 1)][0] >= 2


def test_transcripts(spark):
    say = lambda role, content: json.dumps({"type": role, "message": {"content": content}})
    lines = [("s", 0, say("assistant", "I will revert this")), ("s", 1, say("user", "that broke")), ("s", 2, say("assistant", [{"type": "tool_use", "name": "Edit", "input": {"file_path": "a"}}, {"type": "tool_use", "name": "Edit", "input": {"file_path": "a"}}, 7])), ("s", 3, say("user", [{"type": "tool_result", "is_error": True}])), ("t", 0, say("user", "revert")), ("t", 1, "junk")]
    blocks = logs.transcript_blocks(frame(spark, lines, "session string, line_no long, value string"))
    got = {r.session: (r.revert_language, r.user_corrections, r.tool_errors, r.max_edits_one_file, r.triggered) for r in activity.transcript_signals(blocks).collect()}
    assert got == {"s": (1, 1, 1, 2, True), "t": (0, 1, 0, 0, False)}


def test_diffs(spark):
    diff = "--- a/x\n+++ b/x\n@@ -1 +1 @@\n-old\n+new\n+more\n--- a/y\n+++ /dev/null\n-gone\n+++ b/z\n context"
    got = logs.diff_targets(frame(spark, [(1, diff)], "diff_id long, text string")).orderBy("ord").collect()
    assert [(r.path, r.content) for r in got] == [("x", "new\nmore"), ("z", "")]


def test_evidence(spark):
    e = frame(spark, [(1, "aaa1111"), (2, "bbb2222"), (3, "ccc3333"), (4, "not-a-sha")], "id long, sha string")
    full = lambda *x: frame(spark, [(s + "0" * 33,) for s in x], "sha string")
    got = {r.id: r.reason for r in health.unreachable_evidence(e, full("aaa1111"), full("aaa1111", "bbb2222")).collect()}
    assert got == {2: "off-history", 3: "missing"}


def test_churn(spark):
    changes = [(i, "hot") for i in (0, 3, 6, 9)] + [(i, f"c{i}") for i in range(12)] + [(i, "warm") for i in (0, 3, 6, 11)]
    assert [r.path for r in activity.churn(frame(spark, changes, "seq long, path string")).collect()] == ["hot"]


PRONE = ["((a+))+$", "(x(y+)z)*", "(?:(a*))+", "(a|a)*$", "(x|xy)*$", "(?:foo|foobar)+", "(a+)+$", "([a-z]+)*"]
SAFE = [r"redis\.get\(", "TODO|FIXME", "(abc)+", "(a|b)*", "[+*]+", r"\(a\+\)\+", "uv sync(?!.* --all-extras)", r"except \((KeyError|TypeError)[^)]*\)"]


def test_backtracking_patterns():
    assert all(patterns.prone(p) for p in PRONE) and not any(patterns.prone(p) for p in SAFE)
    assert patterns.valid("a(?!b)") and not patterns.valid("a(") and patterns.matches_empty("x*")


RECORD = '---\nid: 1\ntype: fence\ntitle: Sleep is 7s # kept\nseverity: critical  # now\nconfidence: 0.9\ncreated: 2026-06-09\nauthors: [mara, "Lee"]\nanchors:\n  - path: pay ments/\n  - pattern: "sleep\\( #"\n  - command: \'rm x\'\nevidence:\n  - commit: aaa1111\n  - url: https://x\nexpires:\n  condition: gone\n  review_after: 2026-01-01\nviolation: "a # b"\nstatus: active\n---\n\nDo not.\n'


def test_records_round_trip(spark):
    texts = frame(spark, [("a.md", RECORD), ("b.md", "no head"), ("c.md", RECORD.replace("\n", "\r\n")), ("d.md", "---\nid: x\nconfidence: much\n---\n")], "source string, text string")
    rows = {r.source: r for r in records.parse(texts).collect()}
    a = rows["a.md"]
    assert (a.id, a.type, a.title, a.severity, a.confidence, a.authors) == (1, "fence", "Sleep is 7s # kept", "critical", 0.9, ["mara", "Lee"])
    assert (a.path_anchors, a.pattern_anchors, a.command_anchors, a.evidence) == (["pay ments/"], ["sleep\\( #"], ["rm x"], ["commit: aaa1111", "url: https://x"])
    assert (a.review_after, a.violation, a.body) == ("2026-01-01", "a # b", "Do not.")
    assert rows["b.md"].broken and rows["b.md"].id is None and rows["c.md"].title == "Sleep is 7s # kept"
    assert (rows["d.md"].id, rows["d.md"].confidence, rows["d.md"].type, rows["d.md"].severity, rows["d.md"].status) == (None, 0.5, "deadend", "medium", "active")
    first = records.parse(texts.where("source = 'a.md'"))
    again = records.parse(records.to_text(first).select("source", "text"))
    drop = ("text", "head")
    assert first.drop(*drop).collect() == again.drop(*drop).collect()


def test_lint_transition_promote(spark):
    texts = frame(spark, [("a.md", RECORD), ("b.md", "no head"), ("c.md", '---\nid: 5\ntype: odd\ntitle: t\nanchors:\n  - pattern: "(a+)+$"\n  - command: \'x*\'\n---\n')], "source string, text string")
    parsed = records.parse(texts)
    found = {(r.source, r.level, r.message) for r in records.lint(parsed, "2026-06-01").collect()}
    assert ("b.md", "error", "missing frontmatter") in found and ("a.md", "warning", "review_after is past") in found
    assert {m for s, _, m in found if s == "c.md"} == {"unknown type", "no evidence", "empty body", "pattern may backtrack without end", "command matches the empty text"}
    moved = records.transition(parsed, 1, "archived", "done", "2026-02-02").where("source = 'a.md'").first()
    assert moved.status == "archived" and moved.evidence[-1] == "note: 2026-02-02 archived: done"
    with pytest.raises(ValueError):
        records.transition(parsed, 1, "active", "x", "y")
    new = records.promote(parsed, parsed, "LEE", "2026-06-01").collect()
    assert [(r.source, r.id, r.authors) for r in new] == [("a.md", 6, ["mara", "Lee"])]


def test_brief_is_first_fit(spark):
    rows = [(1, "high", 0.5, "x" * 10), (2, "high", 0.9, "x" * 100), (3, "low", 0.9, "x" * 5)]
    got = health.brief(frame(spark, rows, "id long, severity string, confidence double, entry string"), 20).orderBy("pos").collect()
    assert [(r.id, r.taken) for r in got] == [(2, False), (1, True), (3, True)]


def test_brief_against_a_plain_loop(spark):
    r = random.Random(8)
    rows = [(i, r.choice(("critical", "high", "low", "odd")), r.randint(0, 9) / 10, "x" * r.choice((3, 3, 7, 40, r.randint(0, 300)))) for i in range(400)] + [(900, "high", 0.5, None)]
    rank = {"critical": 0, "high": 1, "low": 3}
    left, want = 500, []
    for i, _, _, entry in sorted(rows, key=lambda x: (rank.get(x[1], 2), -x[2], x[0])):
        taken = entry is not None and len(entry) + 1 <= left
        left -= len(entry) + 1 if taken else 0
        want.append((i, taken))
    got = health.brief(frame(spark, rows, "id long, severity string, confidence double, entry string"), 500).orderBy("pos").collect()
    assert [(x.id, x.taken) for x in got] == want and [x.pos for x in got] == list(range(401))


def test_text_functions(spark):
    row = spark.range(1).select(X.rule_line(F.lit("Do  not.\n Ever. x")).alias("rule"), X.slug(F.lit("Hello, World!")).alias("slug"), X.fire_key(F.lit(None).cast("string"), F.lit("1"), F.lit("t")).alias("key"), X.is_concrete(F.lit("a/*")).alias("glob")).first()
    assert row.asDict() == {"rule": "Do not.", "slug": "hello-world", "key": "unknown|1|t", "glob": False}
    assert spark.range(1).select(X.tier(F.lit(0.6)), X.tier(F.lit(0.2)), X.tier(F.lit(0.1))).first()[:] == ("high", "low", None)


def test_file_source(spark, tmp_path):
    (tmp_path / "a.txt").write_text("text")
    (tmp_path / "b.bin").write_bytes(b"\xff\xfe")
    got = {r.path.rsplit("/", 1)[1]: r.content for r in logs.files(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "text", "b.bin": None}
    (tmp_path / "r").mkdir()
    for n in ("README.md", "_x.md", "one.md"):
        (tmp_path / "r" / n).write_text(RECORD)
    assert [r.source for r in records.read(spark, str(tmp_path / "r")).collect()] == ["one.md"]
