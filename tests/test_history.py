"""History in, candidates and moves out."""

import pytest

from waymark.operators import activity, mining, reanchor
from waymark.sources import logs


def log(spark, text):
    return logs.git_log(spark.createDataFrame([("r", i, x) for i, x in enumerate(text.split("\n"))], "repo string, n long, line string"))


def test_commits_deletions_renames(spark):
    text = "\x02aaa\x012024-02-01\x01Remove it\n\napps/x/a\napps/x/b\n\x02bbb\x012024-01-01\x01Start\x01odd"
    parsed = log(spark, text)
    assert {(r.seq, r.sha, r.subject) for r in logs.git_commits(parsed).collect()} == {(0, "aaa", "Remove it"), (1, "bbb", "Start\x01odd")}
    assert {(r.sha, r.path) for r in logs.git_deletions(parsed).collect()} == {("aaa", "apps/x/a"), ("aaa", "apps/x/b")}
    renamed = logs.git_renames(log(spark, "\x02a\x01d\x01s\nR100\told\tnew")).collect()
    assert [(r.old, r.new) for r in renamed] == [("old", "new")]


def test_flapping_from_patches(spark):
    text = "".join(f"\x02c{i}\x012024-01-0{i + 1}\x01s\ndiff --git a/v b/v\n--- a/v\n+++ b/v\n-  replicas: 9\n+  replicas: {v}\n+other: {v}\n" for i, v in enumerate((1, 3, 1)))
    patches = logs.git_patch_lines(log(spark, text))
    assert patches.count() == 9
    got = mining.flapping(logs.tracked_values(patches)).collect()
    assert [(r.file, r.key, r.sequence, r.oscillation_count) for r in got] == [("v", "replicas", "1 -> 3 -> 1", 1)]


def test_pickaxe_and_killer(spark):
    patches = spark.createDataFrame([(0, "s0", "new", "+", "the long line"), (0, "s0", "old", "-", "the long line"), (1, "s1", "gone", "+", "the long line"), (2, "s2", "same", "+", "the long line"), (2, "s2", "same", "-", "the long line")], "seq long, sha string, file string, sign string, text string")
    lines = spark.createDataFrame([(1, "long line")], "id long, line string")
    tracked = spark.createDataFrame([("new",), ("same",)], "path string")
    assert [r.file for r in reanchor.pickaxe(patches, lines, tracked).collect()] == ["new"]
    deletions = spark.createDataFrame([(3, "x", "p"), (1, "y", "p")], "seq long, sha string, path string")
    assert reanchor.killing_commit(deletions, spark.createDataFrame([("p",)], "path string")).first().sha == "y"


def test_symbols_move_and_drift(spark):
    old = "def alpha(x):\n    y = x + 1\n    return [z for z in range(y)]\n"
    new = "def other():\n    pass\n\ndef alpha(x):\n    y = x + 1\n    return [z for z in range(y)]\n"
    src = lambda *x: spark.createDataFrame(list(x), "path string, content string")
    was, now = logs.definitions(src(("a/m.py", old))), logs.definitions(src(("a/n.py", new), ("b/k.py", "x = 1")))
    lost = was.selectExpr("1L as id", "name", "shingles")
    tracked = src(("a/n.py", ""), ("b/k.py", ""), ("a/x.txt", "")).select("path")
    cand = reanchor.symbol_candidates(spark.createDataFrame([(1, "a/m.py")], "id long, path string"), tracked)
    assert [(r.path, r.pos) for r in cand.orderBy("pos").collect()] == [("a/n.py", 1), ("b/k.py", 2)]
    best = reanchor.symbol_moves(lost, now, cand).orderBy("ratio", ascending=False).first()
    assert (best.path, best.name, best.ratio, best.tier) == ("a/n.py", "alpha", 1.0, "high")
    assert reanchor.symbol_drift(lost, now).count() == 0
    changed = logs.definitions(src(("a/n.py", "def alpha():\n    pass\n")))
    assert reanchor.symbol_drift(lost, changed).first().similarity < 1


def test_upkeep(spark):
    m = spark.createDataFrame([("old", 0.0), ("edge", 86_400.0), ("new", 90_000.0)], "name string, mtime double")
    assert [r.name for r in activity.stale(m, 8 * 86_400.0).collect()] == ["old"]
    assert activity.ages(m, 8 * 86_400.0).first()[:] == ("old", 8.0)
    v = spark.createDataFrame([(0.0,), (0.95,), (1.0,)], "value double")
    assert {(r.bin, r.n) for r in activity.histogram(v).collect()} == {(0, 1), (9, 2)}
    o = spark.createDataFrame([("survived",), ("survived",), ("failed",), ("other",)], "outcome string")
    assert activity.survival(o).first().share == pytest.approx(2 / 3)
    assert activity.draft_window(None, 100_000.0) == 13_600.0 and activity.draft_window(99_000.0, 100_000.0) == 99_000.0


def test_anchor_paths(spark):
    ranked = spark.createDataFrame([("i", "revert", "abcdefgh", None, None, None), ("j", "comment", None, "a:3", None, None), ("k", "comment", None, "gone:1", None, None)], "id string, section string, commit string, location string, file string, component string")
    changes = spark.createDataFrame([("abcdefgh12", p) for p in "edcba"], "sha string, path string")
    tracked = spark.createDataFrame([(p,) for p in "abcd"], "path string")
    got = {(r.id, r.path) for r in mining.anchor_paths(ranked, changes, tracked).collect()}
    assert got == {("i", "a"), ("i", "b"), ("i", "c"), ("j", "a")}


ANCHOR = "id long, source string, kind string, value string, anchor_ord int, severity string, confidence double, status string"


def test_brief_filter_and_drafts(spark):
    from waymark.operators import matching

    row = lambda i, kind, value: (i, f"r{i}", kind, value, 0, "low", 0.5, "active")
    a = spark.createDataFrame([row(1, "path", "src/a"), row(2, "path", "lib/"), row(3, "pattern", "src"), row(4, "command", "x"), row(5, "path", "src/a/b/c")], ANCHOR)
    of = lambda *p: {r.id for r in matching.brief_filter(a, spark.createDataFrame([(x,) for x in p], "path string")).collect()}
    assert of("src/a/b") == {1, 3, 4, 5} and of(".") == {1, 2, 4, 5} and of("other") == {4}
    ranked = spark.createDataFrame([(1, "a", "t"), (2, "b", "t"), (3, "c", "t"), (4, "d", "t")], "pos long, id string, title string")
    got = matching.drafts(ranked, spark.createDataFrame([("b",), ("c",), ("d",)], "id string"), 2, spark.createDataFrame([("b",)], "name string"))
    assert {(r.id, r.fresh) for r in got.collect()} == {("b", False), ("c", True)}
    with pytest.raises(ValueError):
        matching.drafts(ranked, ranked, 21, ranked)


def test_edits_as_a_stream(spark, tmp_path):
    from waymark import streaming

    a = spark.createDataFrame([(1, "r1", "path", "src/", 0, "high", 0.5, "active")], ANCHOR)
    spark.createDataFrame([(1, "src/x", "text"), (2, "lib/y", "text")], "ord long, path string, content string").write.parquet(str(tmp_path / "in"))
    edits = spark.readStream.schema("ord long, path string, content string").parquet(str(tmp_path / "in"))
    streaming.on_edits(edits, a, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert [(r.id, r.ord, r.rank) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, 1, 3.0)]


def test_draft_texts(spark):
    from pyspark.sql import functions as F

    from waymark.functions import text as X

    rows = spark.createDataFrame([("revert", 'Revert "x"', None, None, None, None), ("comment", None, None, None, None, "# DO NOT  `touch`")], "section string, subject string, component string, key string, file string, text string")
    assert [r[0] for r in rows.select(X.draft_title(F.col("section"))).collect()] == ["Revert x", "DO NOT touch"]
    one = spark.range(1).select(X.full_block(F.lit("l"), F.lit("b" * 900)).alias("f"), X.short_block(F.lit("l"), F.lit("why")).alias("s")).first()
    assert len(one.f) == 702 and one.s == "l - why"
