"""Commit graphs against walks over them."""

import random

import pytest

from waymark.operators import ancestry, tables
from waymark.operators.tables import last_before

PARENTS = "repo string, sha string, nth int, parent string"


def graph(seed, n):
    """Commits of two repositories with branches, merges, several roots and a parent that is not there."""
    r, rows = random.Random(seed), []
    for repo in "ab":
        for i in range(n):
            if i < 1 or r.random() < 0.04:
                rows.append((repo, f"{repo}{i:06x}0", 0, None if i != n // 2 else "gone"))
                continue
            first = i - 1 if r.random() < 0.7 else r.randrange(i)
            more = [r.randrange(i) for _ in range(r.choice([0, 0, 0, 1, 2]))]
            rows += [(repo, f"{repo}{i:06x}0", k, f"{repo}{p:06x}0") for k, p in enumerate([first, *more])]
    return rows


def walked(rows, heads):
    up = {}
    for repo, sha, _, parent in rows:
        up.setdefault((repo, sha), []).append((repo, parent))
    seen, todo = set(), [h for h in heads if h in up]
    while todo:
        at = todo.pop()
        if at not in seen:
            seen.add(at)
            todo += [p for p in up[at] if p in up]
    return seen, up


@pytest.mark.parametrize("seed", range(3))
def test_reachable_equals_a_walk(spark, seed):
    rows = graph(seed, 120)
    heads = [("a", f"a{119 - 7 * seed:06x}0"), ("a", f"a{40:06x}0"), ("b", f"b{60 + seed:06x}0"), ("b", "unknown")]
    want, commits = walked(rows, heads)
    got = ancestry.reachable(spark.createDataFrame(rows, PARENTS), spark.createDataFrame(heads, "repo string, sha string")).collect()
    assert len(got) == len(commits) and {(r.repo, r.sha) for r in got if r.reachable} == want


def test_a_long_main_history_is_one_line(spark):
    rows = [("a", f"m{i:05d}", 0, f"m{i - 1:05d}" if i else None) for i in range(300)] + [("a", f"z{i:05d}", 0, f"m{i:05d}") for i in range(0, 300, 3)]
    placed = ancestry.lines(spark.createDataFrame(rows, PARENTS)).collect()
    main = [r for r in placed if r.line == "m00000"]
    assert len(main) >= 300 and sorted(r.pos for r in main) == list(range(len(main)))
    assert {(r.on_line, r.on_pos) for r in placed if r.sha == "z00030"} == {("m00000", 30)}


def test_shallow_repositories_say_nothing(spark):
    rows = spark.createDataFrame(graph(1, 12), PARENTS)
    heads = spark.createDataFrame([("a", "a00000b0"), ("b", "b00000b0")], "repo string, sha string")
    cut = spark.createDataFrame([("b",)], "repo string")
    found = ancestry.reachable(rows, heads, cut)
    assert {r.repo for r in found.collect() if r.reachable is None} == {"b"}
    evidence = spark.createDataFrame([(1, 0, "b", "b00000b0"), (2, 0, "a", "a00000b0"), (2, 1, "a", "fffffff"), (3, 0, "a", "not a sha")], "id long, n int, repo string, sha string")
    states = {(r.id, r.n): r.state for r in ancestry.evidence_states(evidence, found, cut).collect()}
    assert states == {(1, 0): "unknown", (2, 0): "reachable", (2, 1): "missing"}


def test_short_names_and_first_evidence(spark):
    commits = spark.createDataFrame([("a", "abcdef0123", True), ("a", "abcdef0456", False), ("a", "1234567aa", True)], "repo string, sha string, reachable boolean")
    rows = [(1, 0, "a", "abcdef0"), (1, 1, "a", "abcdef04"), (1, 2, "a", "1234567"), (1, 3, "a", "abcdef01"), (2, 0, "a", "abcdef045")]
    states = ancestry.evidence_states(spark.createDataFrame(rows, "id long, n int, repo string, sha string"), commits)
    assert {(r.id, r.n): r.state for r in states.collect()} == {(1, 0): "missing", (1, 1): "off-history", (1, 2): "reachable", (1, 3): "reachable", (2, 0): "off-history"}
    assert [tuple(r) for r in ancestry.first_evidence(states).collect()] == [(1, "a", "1234567aa")]


@pytest.mark.parametrize("seed", range(3))
def test_content_at_a_commit_follows_first_parents(spark, seed):
    rows = graph(seed + 10, 80)
    r = random.Random(seed)
    shas = sorted({(repo, sha) for repo, sha, _, _ in rows})
    versions = [(repo, sha, f"p{k}", r.choice([None, f"blob{r.randrange(99)}"])) for repo, sha in shas for k in range(3) if r.random() < 0.15]
    asked = [(repo, sha, f"p{k}") for repo, sha in shas for k in range(4)]
    first = {(repo, sha): parent for repo, sha, nth, parent in rows if nth == 0}
    changed = {(repo, sha, path): blob for repo, sha, path, blob in versions}

    def walk(repo, sha, path):
        while (repo, sha) in first:
            if (repo, sha, path) in changed:
                return changed[repo, sha, path]
            sha = first[repo, sha]
        return None

    parents = spark.createDataFrame(rows, PARENTS)
    got = ancestry.at(ancestry.lines(parents), spark.createDataFrame(versions, "repo string, sha string, path string, blob string"), spark.createDataFrame(asked, "repo string, sha string, path string"))
    assert {(x.repo, x.sha, x.path): x.blob for x in got.collect()} == {a: walk(*a) for a in asked}


@pytest.mark.parametrize("width", [1, 5, 1000])
def test_last_before_equals_a_search(spark, width):
    r = random.Random(width)
    facts = [("k" if r.random() < 0.8 else "j", i, f"v{i}") for i in r.sample(range(200), 60)]
    asked = [(k, i, f"x{n}") for n, (k, i) in enumerate((r.choice("kji"), r.randrange(-3, 210)) for _ in range(150))]
    got = last_before(spark.createDataFrame(asked, "k string, at long, x string"), spark.createDataFrame(facts, "k string, at long, v string"), ["k"], "at", "v", width)
    want = {(k, i, x): max(((a, v) for f, a, v in facts if f == k and a <= i), default=(0, None))[1] for k, i, x in asked}
    assert {(q.k, q.at, q.x): q.v for q in got.collect()} == want


def test_size_estimates_do_not_grow_with_rounds(spark):
    rows = [("a", f"m{i:03d}", 0, f"m{i - 1:03d}" if i else None) for i in range(40)]
    placed = ancestry.lines(spark.createDataFrame(rows, PARENTS))
    assert int(str(placed._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 1 << 20


def test_nothing_of_empty_tables(spark):
    none = spark.createDataFrame([], PARENTS)
    placed = ancestry.lines(none)
    assert placed.count() == 0 and ancestry.reachable(none, none.select("repo", "sha")).count() == 0
    assert ancestry.at(placed, spark.createDataFrame([], "repo string, sha string, path string, blob string"), spark.createDataFrame([("a", "b", "c")], "repo string, sha string, path string")).first().blob is None


def test_rows_that_take_little_parquet_are_not_broadcast(spark):
    """A million rows of a few values are some kilobytes, which Spark would send through the driver."""
    many = tables.kept(spark.range(1_000_000).selectExpr("id", "id % 3 as kind"))
    held = spark.range(2_000_000).withColumnRenamed("id", "kind").join(many, "kind")
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    alike = tables.kept(spark.range(1).selectExpr("explode(sequence(0, 30000)) as id", "1 as kind").select("kind"))
    assert "Broadcast" not in spark.range(9_000_000).selectExpr("cast(id as int) as kind").join(alike, "kind")._jdf.queryExecution().executedPlan().toString()
    few = tables.kept(spark.range(10))
    assert "BroadcastHashJoin" in spark.range(2_000_000).join(few, "id")._jdf.queryExecution().executedPlan().toString()


def test_evidence_of_a_small_table_is_not_broadcast(spark, tmp_path):
    spark.range(1000).write.parquet(str(tmp_path / "few"))
    rows = spark.read.parquet(str(tmp_path / "few")).selectExpr("id", "explode(sequence(0, 999)) as n", "'a' as repo", "substring(md5(cast(id * 1000 + n as string)), 1, 9) as sha")
    commits = spark.range(1000).selectExpr("'a' as repo", "md5(cast(id as string)) as sha", "true as reachable")
    plan = ancestry.evidence_states(rows, commits)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2
