"""Commit graphs: lines of first parents, what heads reach, what a file was at a commit, and records' evidence in it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import kept, last_before


def _tree(parents: DataFrame) -> DataFrame:
    """(id, repo, sha, up, merged): every commit of parents(repo, sha, nth, parent) with a number, that of its first parent, null
    if the table has no commit of that name, and the names of its other parents.

    What follows goes by numbers: a row of a join is a few longs, not names.
    """
    named = F.sort_array(F.collect_list(F.when(F.col("parent").isNotNull(), F.struct("nth", "parent"))))
    own = parents.groupBy("repo", "sha").agg(F.transform(named, lambda p: p["parent"]).alias("_all"))
    first = F.get("_all", 0)
    own = kept(own.select(F.monotonically_increasing_id().alias("id"), "repo", "sha", first.alias("_parent"), F.when(F.size("_all") > 1, F.array_except("_all", F.array(first))).alias("merged")))
    there = own.select("repo", F.col("sha").alias("_parent"), F.col("id").alias("up"))
    return kept(own.join(there, ["repo", "_parent"], "left").select("id", "repo", "sha", "up", "merged"))


def _ranked(nodes: DataFrame) -> DataFrame:
    """nodes(id, on, step) -> (id, line, pos): where each comes to by going on from node to node, and the steps to there; on is null
    where a line begins. Pointers are doubled: n nodes in a row take log n joins."""
    start = F.col("on").isNull()
    walk = kept(nodes.select("id", F.coalesce("on", "id").alias("line"), F.when(start, 0).otherwise(F.col("step")).cast("long").alias("pos"), start.alias("done")))
    while not walk.where("not done").isEmpty():
        there = walk.select(F.col("id").alias("line"), F.col("line").alias("_line"), F.col("pos").alias("_pos"), F.col("done").alias("_done"))
        on = walk.where("not done").join(there, "line").select("id", F.col("_line").alias("line"), (F.col("pos") + F.col("_pos")).alias("pos"), F.col("_done").alias("done"))
        walk = kept(walk.where("done").union(on), walk)
    return walk.select("id", "line", "pos")


def _heights(tree: DataFrame) -> DataFrame:
    """tree(id, at, far, tall), tall the length of a node and far that of its parent `at`, with tall the greatest length of a way
    from its node on. Each round looks twice as far."""
    now = kept(tree.select("id", "at", "far", "tall"))
    while not now.where("at is not null").isEmpty():
        gain = now.where("at is not null").groupBy(F.col("at").alias("id")).agg(F.max(F.col("tall") + F.col("far")).alias("gain"))
        onward = now.select(F.col("id").alias("at"), F.col("at").alias("next"), F.col("far").alias("more"))
        taller = now.join(gain, "id", "left").withColumn("tall", F.greatest("tall", F.coalesce("gain", "tall"))).drop("gain")
        now = kept(taller.join(onward, "at", "left").select("id", F.col("next").alias("at"), (F.col("far") + F.col("more")).alias("far"), "tall"), now)
    return now.select("id", "tall")


def numbered_lines(parents: DataFrame) -> DataFrame:
    """lines() with numbers for names of lines, on_line and on_pos at the begin of each line only, and merged, the names of a commit's
    other parents than the first.

    Commits that are their parent's only child are put in a row first; only where history forks are these rows weighed
    against each other, so without forks there is nothing to weigh.
    """
    tree = _tree(parents)
    children = tree.where("up is not null").groupBy("up").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    only = children.where("n = 1").select("id", F.col("up").alias("on"))
    rows = _ranked(tree.select("id").join(only, "id", "left").withColumn("step", F.lit(1)))
    if not children.where("n > 1").isEmpty():
        sizes = kept(rows.groupBy("line").agg(F.count("*").alias("size")))
        # A row hangs on the last commit of another one, as its parent has other children.
        hang = tree.where("up is not null").select("id", "up").join(rows.where("pos = 0").select("id"), "id").join(rows.select(F.col("id").alias("up"), F.col("line").alias("at")), "up")
        hung = hang.select(F.col("id").alias("line"), "at").join(sizes.select(F.col("line").alias("at"), F.col("size").alias("far")), "at")
        segments = kept(sizes.join(hung, "line", "left").select(F.col("line").alias("id"), "at", "far", F.col("size").alias("tall")))
        tall = segments.select("id", "at", "far").join(_heights(segments), "id")
        chosen = tall.where("at is not null").groupBy(F.col("at").alias("on")).agg(F.max_by("id", F.struct("tall", "id")).alias("id"), F.first("far").alias("step"))
        joined = _ranked(segments.select("id").join(chosen, "id", "left"))
        whole = joined.select(F.col("id").alias("line"), F.col("line").alias("_line"), F.col("pos").alias("_base"))
        rows = kept(rows.join(whole, "line").select("id", F.col("_line").alias("line"), (F.col("pos") + F.col("_base")).alias("pos")))
    begins = tree.where("up is not null").select("id", "up").join(rows.where("pos = 0").select("id"), "id")
    at = begins.join(rows.select(F.col("id").alias("up"), F.col("line").alias("on_line"), F.col("pos").alias("on_pos")), "up").drop("up")
    return kept(tree.drop("up").join(rows, "id").join(at, "id", "left").select("repo", "sha", "line", "pos", "on_line", "on_pos", "merged"))


def lines(parents: DataFrame) -> DataFrame:
    """parents(repo, sha, nth, parent), a row for each parent and one with parent null for a commit without any
    -> (repo, sha, line, pos, on_line, on_pos, merged): every commit's line, its number on it from 0, and where the line begins;
    lines have the name of their first commit.

    A line goes from a commit to that child, among those whose first parent it is, above which history is longest; the
    others begin lines, which begin at on_line, on_pos (null at a root). So the main history is one line however many
    branches leave it. Heights and numbers are found by doubling: n commits in a row take log n joins.
    """
    found = numbered_lines(parents)
    begins = found.where("pos = 0").select("line", F.col("sha").alias("_name"), "on_line", "on_pos")
    on = begins.select(F.col("line").alias("on_line"), F.col("_name").alias("_on"))
    named = begins.join(on, "on_line", "left").select("line", "_name", F.col("_on").alias("on_line"), "on_pos")
    return kept(found.drop("on_line", "on_pos").join(named, "line").select("repo", "sha", F.col("_name").alias("line"), "pos", "on_line", "on_pos", "merged"))


def reached(placed: DataFrame, heads: DataFrame) -> DataFrame:
    """(repo, line, upto): the highest number on each line that heads(repo, sha) reach; all below it on the line are reached.
    placed as lines() or numbered_lines() give it.

    The frontier is lines, not commits: a round follows the parents that lie on other lines, from the numbers that came
    new, and as many rounds are needed as a path changes lines, not as it has commits.
    """
    at = placed.select("repo", "sha", "line", "pos")
    low = at.select("repo", F.col("sha").alias("parent"), F.col("line").alias("to_line"), F.col("pos").alias("to_pos"))
    merges = placed.where("merged is not null").select("repo", "line", "pos", F.explode("merged").alias("parent")).join(low, ["repo", "parent"])
    begins = placed.where("pos = 0 and on_line is not null").select("repo", "line", "pos", F.col("on_line").alias("to_line"), F.col("on_pos").alias("to_pos"))
    cross = kept(merges.where("line <> to_line").select(*begins.columns).union(begins))
    none = F.lit(-1).cast("long")
    state = kept(heads.select("repo", "sha").distinct().join(at, ["repo", "sha"]).groupBy("repo", "line").agg(F.max("pos").alias("upto")).withColumn("below", none))
    while not (fresh := state.where("upto > below")).isEmpty():
        came = cross.join(fresh, ["repo", "line"]).where("pos > below and pos <= upto").select("repo", F.col("to_line").alias("line"), F.col("to_pos").alias("upto"), none.alias("below"))
        both = came.union(state.select("repo", "line", "upto", F.col("upto").alias("below")))
        state = kept(both.groupBy("repo", "line").agg(F.max("upto").alias("upto"), F.max("below").alias("below")), state)
    return state.select("repo", "line", "upto")


def reachable(parents: DataFrame, heads: DataFrame, shallow: DataFrame | None = None, placed: DataFrame | None = None) -> DataFrame:
    """(repo, sha, reachable) of every commit: whether it is one of heads(repo, sha) or an ancestor of one; null in the
    repositories of shallow(repo), whose history is cut off, so that nothing can be said."""
    placed = numbered_lines(parents) if placed is None else placed
    upto = reached(placed, heads)
    found = placed.join(upto, ["repo", "line"], "left").withColumn("reachable", F.coalesce(F.col("pos") <= F.col("upto"), F.lit(False)))
    if shallow is not None:
        cut = shallow.select("repo", F.lit(True).alias("_cut")).distinct()
        found = found.join(cut, "repo", "left").withColumn("reachable", F.when(F.col("_cut").isNull(), F.col("reachable")))
    return found.select("repo", "sha", "reachable")


def evidence_states(evidence: DataFrame, commits: DataFrame, shallow: DataFrame | None = None) -> DataFrame:
    """evidence(id, n, repo, sha) against reachable()'s commits(repo, sha, reachable) -> (id, n, repo, sha, full, state).

    sha may be shortened to seven digits or more; full is the one commit it names. state is reachable, off-history, missing
    (no commit, or several, of that name) or, in a shallow(repo), unknown. What is no commit's name is left out.

    Evidence may be many rows of few in a table, which Spark's estimate does not know; so it is joined by sorting.
    """
    named = evidence.where(F.col("sha").rlike("^[0-9a-f]{7,40}$")).select("id", "n", "repo", "sha", F.substring("sha", 1, 7).alias("_head"))
    asked = named.select("repo", "sha", "_head").distinct()
    full = commits.select("repo", F.col("sha").alias("full"), "reachable", F.substring("sha", 1, 7).alias("_head"))
    one = asked.hint("merge").join(full, ["repo", "_head"]).where(F.startswith("full", "sha")).groupBy("repo", "sha").agg(F.min("full").alias("full"), F.first("reachable").alias("reachable"), F.count("*").alias("_n")).where("_n = 1").drop("_n")
    cut = (shallow if shallow is not None else commits.select("repo").limit(0)).select("repo", F.lit(True).alias("_cut")).distinct()
    state = F.when(F.col("_cut"), "unknown").when(F.col("reachable"), "reachable").when(F.col("full").isNotNull(), "off-history").otherwise("missing")
    return named.drop("_head").join(one.hint("merge"), ["repo", "sha"], "left").join(cut, "repo", "left").select("id", "n", "repo", "sha", "full", state.alias("state"))


def first_evidence(states: DataFrame) -> DataFrame:
    """(id, repo, sha): the first reachable commit among each record's evidence, in the order n."""
    return states.where("state = 'reachable'").groupBy("id").agg(F.min_by(F.struct("repo", "full"), "n").alias("b")).select("id", "b.repo", F.col("b.full").alias("sha"))


def at(placed: DataFrame, versions: DataFrame, asked: DataFrame) -> DataFrame:
    """asked(repo, sha, path) -> (repo, sha, path, blob): what each file was at each commit, null if it was not there.

    versions(repo, sha, path, blob) says what a commit made of a path against its first parent, null where it removed it.
    Files are looked up by as-of joins along lines(), so in the order of commits, whatever their dates: the last version
    at or before the commit on its line; what has none there goes on from where the line begins, until no line is left.
    """
    at = placed.select("repo", "sha", "line", "pos")
    known = kept(versions.join(at, ["repo", "sha"]).select("repo", "line", "path", "pos", F.struct("blob").alias("v")))
    begins = placed.where("pos = 0").select("repo", "line", "on_line", "on_pos")
    open_ = kept(asked.select("repo", "sha", "path").distinct().join(at, ["repo", "sha"], "left"))
    parts = []
    while not open_.where("line is not null").isEmpty():
        looked = kept(last_before(open_.where("line is not null"), known, ["repo", "line", "path"], "pos", "v"))
        parts += [open_.where("line is null"), looked.where("v is not null").select("repo", "sha", "path", "v.blob")]
        onward = looked.where("v is null").select("repo", "sha", "path", "line").join(begins, ["repo", "line"])
        open_ = kept(onward.select("repo", "sha", "path", F.col("on_line").alias("line"), F.col("on_pos").alias("pos")))
    blob = F.lit(None).cast(versions.schema["blob"].dataType).alias("blob")
    return reduce(DataFrame.union, [p if "blob" in p.columns else p.select("repo", "sha", "path", blob) for p in [*parts, open_]])
