"""Streams give the same rows however their events fall into batches."""

import itertools

import pytest

from waymark import streaming

ANCHOR = "id long, source string, kind string, value string, anchor_ord int, severity string, confidence double, status string"
EDITS = "ord long, path string, content string, trajectory string, t long"
H = 3600


def run(spark, folder, schema, batches, start):
    """What `start` logs of the batches, one file and so one batch each."""
    source, sink, checkpoint = (str(folder / x) for x in ("in", "out", "cp"))
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        assert start(stream, sink, checkpoint).awaitTermination(120)
    return spark.read.parquet(sink).collect()


def splits(rows):
    n = len(rows)
    return [[rows], [rows[:1], rows[1:]], [rows[: n // 2], rows[n // 2 :]]]


def anchors(spark):
    rows = [(1, "r1", "path", "src/", 0, "high", 0.5, "active"), (2, "r2", "pattern", "secret", 0, "high", 0.5, "active"), (3, "r3", "command", "^rm ", 0, "low", 0.5, "active"), (4, "r4", "command", "-r", 0, "high", 0.5, "active"), (5, "r5", "pattern", "[.]py$", 0, "low", 0.9, "active")]
    return spark.createDataFrame(rows, ANCHOR)


def edits():
    times = [0, 60, 4 * H, 4 * H + 1, 6 * H, 8 * H + 1, 8 * H + 2, 20 * H]
    return [(i, f"src/{'x' if i % 3 else 'y'}.py", "a secret" if i % 4 != 3 else "plain", "T" if i % 2 else "U", t) for i, t in enumerate(times)]


def fold(rows, seconds=4 * H):
    """Record 2 is shown in full on a path more than `seconds` after it last was."""
    last, out = {}, {}
    for ord_, path, content, _, t in rows:
        if "secret" in content:
            out[ord_] = path not in last or t - last[path] > seconds
            if out[ord_]:
                last[path] = t
    return out


@pytest.mark.parametrize("split", range(3))
def test_showings(spark, tmp_path, split):
    a, rows = anchors(spark), edits()
    got = run(spark, tmp_path, EDITS, splits(rows)[split], lambda s, out, cp: streaming.on_edits(s, a, out, cp))
    assert {r.ord: r.full for r in got if r.id == 2} == fold(rows)
    assert {r.reason for r in got if r.id in (1, 5)} == {"path-only match"}
    assert {(r.ord, r.id): (r.pos, r.matched_by) for r in got if r.ord == 0} == {(0, 2): (1, ["content_pattern"]), (0, 1): (2, ["path"]), (0, 5): (3, ["path_pattern"])}


@pytest.mark.parametrize("split", range(3))
def test_commands(spark, tmp_path, split):
    rows = [(i, c, t) for i, (c, t) in enumerate((("rm -r x", 0), ("ls", 1), ("rm -r x", 4 * H), ("rm y", 4 * H), ("rm -r x", 4 * H + 1), ("rm -r x", 8 * H)))]
    a = anchors(spark)
    got = run(spark, tmp_path, "ord long, command string, t long", splits(rows)[split], lambda s, out, cp: streaming.on_commands(s, a, out, cp))
    assert {(r.ord, r.id): (r.pos, r.full) for r in got} == {(0, 4): (1, True), (0, 3): (2, True), (2, 4): (1, False), (2, 3): (2, False), (3, 3): (1, True), (4, 4): (1, True), (4, 3): (2, True), (5, 4): (1, False), (5, 3): (2, False)}


@pytest.mark.parametrize("split", range(3))
def test_blocks_once_until_it_runs_out(spark, tmp_path, split):
    rows = [(i, "src/x.py", "secret", who, t) for i, (who, t) in enumerate((("T", 0), ("T", 5), ("U", 6), ("T", 24 * H), ("T", 24 * H + 1), ("T", 24 * H + 2)))]
    a = anchors(spark)
    got = run(spark, tmp_path, EDITS, splits(rows)[split], lambda s, out, cp: streaming.block_actions(s, a, out, cp))
    assert {r.ord: r.block for r in got if r.id == 2} == {0: True, 1: False, 2: True, 3: False, 4: True, 5: False}
    assert not any(r.block for r in got if r.id != 2)


@pytest.mark.parametrize("split", range(3))
def test_only_the_newest_blocks_are_remembered(spark, tmp_path, split):
    paths = ["a", "b", "c", "a", "c", "b"]
    rows = [(i, p, "secret", "T", i) for i, p in enumerate(paths)]
    a = anchors(spark)
    got = run(spark, tmp_path, EDITS, splits(rows)[split], lambda s, out, cp: streaming.block_actions(s, a, out, cp, most=2))
    held, want = {}, {}
    for i, p in enumerate(paths):
        want[i] = p not in held
        if want[i]:
            held = dict(sorted({**held, p: i}.items(), key=lambda x: -x[1])[:2])
    assert {r.ord: r.block for r in got} == want and list(want.values()) == [True, True, True, True, False, True]


def test_edits_without_a_time_are_always_full(spark, tmp_path):
    rows = [(i, "lib/z", "secret") for i in range(3)]
    a = anchors(spark)
    got = run(spark, tmp_path, "ord long, path string, content string", [rows], lambda s, out, cp: streaming.on_edits(s, a, out, cp))
    assert sorted((r.ord, r.full) for r in got) == list(zip(range(3), itertools.repeat(True)))


@pytest.mark.parametrize("order", [(0, 1, 2, 3, 4, 5, 6, 7), (3, 1, 0, 2, 5, 4, 7, 6), (7, 6, 5, 4, 3, 2, 1, 0)])
@pytest.mark.parametrize("size", [3])
def test_showings_of_edits_in_any_order(spark, tmp_path, order, size):
    a, rows = anchors(spark), edits()
    mixed = [rows[i] for i in order]
    last = [(99, "end", "", "T", 200 * H)]  # carries the watermark past all others
    batches = [mixed[i : i + size] for i in range(0, len(mixed), size)] + [last, [(100, "end", "", "T", 201 * H)]]
    got = run(spark, tmp_path, EDITS, batches, lambda s, out, cp: streaming.on_edits(s, a, out, cp, wait="30 hours"))
    assert {r.ord: r.full for r in got if r.id == 2} == fold(rows) and len(got) == len({(r.ord, r.id) for r in got})
    assert {(r.ord, r.id): (r.pos, r.matched_by) for r in got if r.ord == 0} == {(0, 2): (1, ["content_pattern"]), (0, 1): (2, ["path"]), (0, 5): (3, ["path_pattern"])}
