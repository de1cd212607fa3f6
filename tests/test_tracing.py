"""Dead paths, dead symbols and drift, from history to finding."""

import pytest

from waymark.operators import ancestry, tracing

PATCH = "seq long, sha string, file string, sign string, text string"
BODY = ["first line of the module", "  second line, indented", "short", "a third and by far the longest line of the module"]


def patch(seq, sha, file, sign, lines):
    return [(seq, sha, file, sign, x) for x in lines]


def paths(spark, dead, deletions, patches, files):
    got = tracing.trace_paths(
        spark.createDataFrame(dead, "id long, path string"), spark.createDataFrame(deletions, "seq long, sha string, path string"),
        spark.createDataFrame(patches, PATCH), spark.createDataFrame(files, "path string, content string"),
    )
    return sorted((r.id, r.proposed, round(r.ratio, 4), r.tier, r.evidence) for r in got.collect())


def test_the_killing_commit_is_asked_before_the_pickaxe(spark):
    deletions = [(5, "kill0000000", "old/a"), (9, "earlier0000", "old/a"), (5, "kill0000000", "old/b"), (6, "other000000", "old/c"), (7, "kill7000000", "old/d")]
    patches = (
        patch(5, "kill0000000", "old/a", "-", BODY) + patch(5, "kill0000000", "new/a", "+", BODY) + patch(5, "kill0000000", "new/copy", "+", BODY) + patch(5, "kill0000000", "untracked", "+", BODY)
        + patch(9, "earlier0000", "old/a", "-", ["what it was in another life"]) + patch(9, "earlier0000", "new/b", "+", ["what it was in another life"])
        + patch(5, "kill0000000", "old/b", "-", ["only this line is in b, and long", "and one that went elsewhere", "third of those lines", "fourth of those lines", "fifth of those lines"])
        + patch(6, "other000000", "old/c", "-", ["tiny", "x = 1"]) + patch(7, "kill7000000", "old/d", "-", ["nothing like this is anywhere else"])
        + patch(1, "later000000", "late/b", "+", ["only this line is in b, and long", "unrelated"]) + patch(2, "later200000", "late/gone", "+", ["only this line is in b, and long"])
    )
    files = [("new/a", ""), ("new/copy", ""), ("new/b", ""), ("late/b", "only this line is in b, and long\n  and one that went elsewhere\nmore"), ("late/same", "only this line is in b, and long")]
    dead = [(1, "old/a"), (2, "old/b"), (3, "old/c"), (4, "old/d"), (5, "never/deleted")]
    assert paths(spark, dead, deletions, patches, files) == [
        (1, "new/a", 1.0, "high", "killing-commit kill000: overlap 1.00"),
        (1, "new/copy", 1.0, "high", "killing-commit kill000: overlap 1.00"),
        (2, "late/b", 0.4, "low", "pickaxe kill000: distinctive-line match, overlap 0.40"),
    ]


def test_nothing_is_proposed_from_empty_history(spark):
    assert paths(spark, [(1, "a")], [], [], []) == []


def history(spark, first, second, moved=None):
    """Two commits: one with m.py as it was, one with it as it is; the record's evidence is the first, shortened."""
    parents = spark.createDataFrame([("r", "aaaaaaa1", 0, None), ("r", "bbbbbbb2", 0, "aaaaaaa1"), ("r", "ccccccc3", 0, None)], "repo string, sha string, nth int, parent string")
    heads = spark.createDataFrame([("r", "bbbbbbb2")], "repo string, sha string")
    versions = spark.createDataFrame([("r", "aaaaaaa1", "pkg/m.py", "old"), ("r", "bbbbbbb2", "pkg/m.py", "new"), ("r", "ccccccc3", "pkg/m.py", "side")], "repo string, sha string, path string, blob string")
    contents = spark.createDataFrame([("old", first), ("new", second), ("side", "def other():\n    pass\n")], "blob string, content string")
    files = spark.createDataFrame([("pkg/m.py", second), *([("lib/n.py", moved)] if moved else [])], "path string, content string")
    evidence = spark.createDataFrame([(1, 0, "r", "ccccccc"), (1, 1, "r", "aaaaaaa"), (1, 2, "r", "bbbbbbb2")], "id long, n int, repo string, sha string")
    states = ancestry.evidence_states(evidence, ancestry.reachable(parents, heads))
    return states, ancestry.lines(parents), versions, contents, files


def anchors(spark, symbol, status="active"):
    return spark.createDataFrame([(1, "path", "pkg/m.py", status), (1, "symbol", symbol, status)], "id long, kind string, value string, status string")


KEEP = "class Box:\n    def put(self, x):\n        y = x + 1\n        return [y for _ in range(x)]\n"


@pytest.mark.parametrize("symbol", ["put", "Box.put", "pkg/m.py::put", "pkg/m.py::Box.put"])
def test_drift_since_the_first_reachable_evidence(spark, symbol):
    changed = history(spark, KEEP, KEEP.replace("x + 1", "compute(other(x))"))
    got = tracing.drift(anchors(spark, symbol), *changed).collect()
    assert [(r.id, r.symbol, r.sha) for r in got] == [(1, symbol, "aaaaaaa1")] and 0 <= got[0].similarity < 1


@pytest.mark.parametrize("second", [KEEP, KEEP.replace("        y =", "        # said\n\n        y ="), KEEP + "def put():\n    pass\n", "def gone():\n    pass\n"])
def test_no_drift_of_comments_of_ambiguous_and_of_lost_names(spark, second):
    assert tracing.drift(anchors(spark, "put"), *history(spark, KEEP, second)).collect() == []


def test_no_drift_of_records_that_do_not_fire(spark):
    changed = history(spark, KEEP, KEEP.replace("x + 1", "compute(other(x))"))
    assert tracing.drift(anchors(spark, "put", "archived"), *changed).collect() == []


FUNCTION = "def before(items):\n    total = 0\n    for i in items:\n        if i > 3:\n            total += i\n    return total\n"


def test_a_symbol_renamed_in_its_file(spark):
    got = tracing.trace_symbols(anchors(spark, "before"), *history(spark, FUNCTION, FUNCTION.replace("before", "after"))).collect()
    assert [(r.id, r.dead, r.proposed, r.tier) for r in got] == [(1, "before", "pkg/m.py::after", "high")]
    assert got[0].evidence.startswith("symbol fingerprint at aaaaaaa: jaccard 0.") and got[0].ratio >= 0.7


def test_a_symbol_moved_to_another_file_keeps_its_name(spark):
    got = tracing.trace_symbols(anchors(spark, "before"), *history(spark, FUNCTION, "def unlike():\n    pass\n", FUNCTION)).collect()
    assert [(r.proposed, r.ratio, r.tier, r.evidence) for r in got] == [("lib/n.py::before", 1.0, "high", "symbol fingerprint at aaaaaaa: jaccard 1.00 (+name match)")]


def test_a_symbol_that_is_gone_or_still_there_has_no_proposal(spark):
    assert tracing.trace_symbols(anchors(spark, "before"), *history(spark, FUNCTION, "def unlike():\n    pass\n")).collect() == []
    assert tracing.trace_symbols(anchors(spark, "before"), *history(spark, FUNCTION, FUNCTION)).collect() == []
