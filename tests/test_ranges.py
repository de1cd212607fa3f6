"""Logs and histories cut into ranges, against reading them from the start."""

import random

import pytest

from waymark.operators import mining
from waymark.operators.tables import newest_of, running_count
from waymark.sources import logs


def plain(history):
    """Cycles of a list of values, taken from the front."""
    count, first, i = 0, None, 0
    while i + 2 < len(history):
        if history[i] == history[i + 2] != history[i + 1]:
            count, first = count + 1, first if first is not None else i
            i += 2
        else:
            i += 1
    return count, first


@pytest.mark.parametrize("width", [2, 3, 7, 4096])
def test_oscillations_of_any_slices_equal_a_walk(spark, width):
    r = random.Random(width)
    files = {f"f{k}": [r.choice("ab" if k % 2 else "abc") for _ in range(r.randrange(0, 40))] for k in range(12)}
    files["flip"] = list("ab" * 30)
    rows = [(f, i, v) for f, values in files.items() for i, v in enumerate(values)]
    r.shuffle(rows)
    got = mining.oscillations(spark.createDataFrame(rows, "file string, at long, value string").repartition(5), ["file"], ["at"], width).collect()
    want = {f: plain(values) for f, values in files.items()}
    assert {x.file: (x.oscillation_count, x.first.at) for x in got} == {f: w for f, w in want.items() if w[0]}


def test_counts_and_newest_rows_of_a_hot_key(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(0, 900, 3)] + [("cold", 7)], "k string, n long")
    got = {(x.k, x.n): x.c for x in running_count(rows, ["k"], "n", "c", 10).collect()}
    assert got == {("hot", 3 * i): i for i in range(300)} | {("cold", 7): 0}
    assert sorted(x.n for x in newest_of(rows, ["k"], "n", 5, 4).collect()) == [7, 885, 888, 891, 894, 897]


def test_a_log_of_many_ranges(spark):
    r, lines, want = random.Random(3), ["before any commit"], []
    patched = []
    for c in range(60):
        lines.append(f"\x02sha{c}\x012024-01-01\x01Subject {c}")
        want.append((c, f"sha{c}", None))
        for f in range(r.choice([0, 0, 1, 2, 40])):
            lines += [f"--- a/f{f}", f"+++ b/f{f}"]
            for k in range(r.choice([0, 3, 300])):
                lines.append(f"{'+-'[k % 2]}line {k}")
                patched.append((c, f"f{f}", "+-"[k % 2], f"line {k}"))
    rows = spark.createDataFrame([("r", i, x) for i, x in enumerate(lines)], "repo string, n long, line string").repartition(7)
    log = logs.git_log(rows)
    assert sorted((x.seq, x.sha) for x in logs.git_commits(log).collect()) == [(c, s) for c, s, _ in want]
    assert log.where("rest = 'before any commit'").count() == 0
    assert sorted((x.seq, x.file, x.sign, x.text) for x in logs.git_patch_lines(log).collect()) == sorted(patched)
