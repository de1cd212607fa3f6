"""Registered queries over stores of record files that Spark writes from the tables, and over logs, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import activity, health, matching, mining, reanchor
from ..sources import appends, logs, records
from . import adapters as A
from .catalog import TODAY, doc, joined, query, record_texts

#: What is wrong with every 22nd record file: the finding, and the line that makes it, in place of the sound one.
SOUND = {"type": "fence", "title": "Sound", "severity": "low", "confidence": "0.5", "authors": "[ann]", "anchors": "  - path: src/", "evidence": "  - pr: 1", "status": "active", "review_after": "2030-01-01", "violation": "", "body": "Because."}
FAULTS = [
    ("error", "missing frontmatter", {}),
    ("error", "unknown type", {"type": "odd"}), ("error", "missing title", {"title": ""}), ("warning", "markdown or URL in title", {"title": "see https://x.y"}),
    ("error", "invalid severity", {"severity": "huge"}), ("error", "invalid status", {"status": "asleep"}), ("error", "no anchors", {"anchors": ""}),
    ("warning", "unsupported anchors", {"anchors": "  - path: src/\n  - touch: x"}), ("warning", "symbol anchors without parser", {"anchors": "  - symbol: Foo.bar"}),
    ("warning", "author spelled in different case", {"authors": "[ann, Ann]"}), ("warning", "no evidence", {"evidence": ""}), ("warning", "bad url evidence", {"evidence": "  - url: ftp://x"}),
    ("warning", "review_after is past", {"review_after": "2020-01-01"}), ("warning", "empty body", {"body": ""}),
    ("error", "pattern is no valid pattern", {"anchors": '  - pattern: "("'}), ("error", "pattern may backtrack without end", {"anchors": '  - pattern: "(a+)+$"'}),
    ("error", "command is no valid pattern", {"anchors": '  - command: "("'}), ("error", "command may backtrack without end", {"anchors": '  - command: "x(a+)+$"'}), ("error", "command matches the empty text", {"anchors": '  - command: "x*"'}),
    ("error", "violation is no valid pattern", {"violation": "("}), ("error", "violation may backtrack without end", {"violation": "(b+)+$"}),
]


def file_text(fault: dict[str, str] | None) -> str:
    f = SOUND | (fault or {})
    lines = [f"{k}: {f[k]}" for k in ("type", "title", "severity", "confidence", "authors", "status", "review_after") if f[k]] + ([f'violation: "{f["violation"]}"'] if f["violation"] else [])
    return "\n".join(["---", *lines, "anchors:", f["anchors"], "evidence:", f["evidence"], "---", "", f["body"], ""])


def store(spark, sf_dir) -> DataFrame:
    """A record file for every document, each 22nd with the same fault, one of 22 without."""
    texts = F.array(*[F.lit("no head" if not fault else file_text(fault)) for _, _, fault in FAULTS], F.lit(file_text(None)))
    named = F.concat(F.lit("---\nid: "), F.col("doc_id").cast("string"), F.lit("\n"))
    text = F.get(texts, (F.col("doc_id") % (len(FAULTS) + 1)).cast("int"))
    with_id = F.when(F.startswith("_text", F.lit("---")), F.concat(named, F.expr("substring(_text, 5)"))).otherwise(F.col("_text"))
    return doc(spark, sf_dir).withColumn("_text", text).select(joined("'r", "doc_id", "'.md").alias("source"), with_id.alias("text"))


FAULT_ROWS = A.values([(i, level, message) for i, (level, message, _) in enumerate(FAULTS)])


@query(f"select 'r' || doc_id || '.md' as source, level, message from documents join ({FAULT_ROWS}) v(k, level, message) on doc_id % {len(FAULTS) + 1} = k")
def lint_kinds(spark, sf_dir):
    """Every kind of finding, one in each file that has one."""
    return records.lint(records.parse(store(spark, sf_dir)), TODAY, symbols=False)


KIND = f"doc_id % {len(FAULTS) + 1}"
NUMBER = {message: i for i, (_, message, _) in enumerate(FAULTS)}
ERRORS = ", ".join(str(i) for i, (level, _, _) in enumerate(FAULTS) if level == "error")


@query(f"select doc_id as id, '2020-01-01' as review_after from documents where {KIND} = {NUMBER['review_after is past']}")
def review_due(spark, sf_dir):
    return health.review_due(records.parse(store(spark, sf_dir)).where("not broken"), TODAY).select("id", "review_after")


@query(f"select case {KIND} when {NUMBER['invalid status']} then 'asleep' else 'active' end as status, count(*) as n from documents where {KIND} <> 0 group by 1")
def status_counts(spark, sf_dir):
    return health.status_counts(records.parse(store(spark, sf_dir)).where("not broken"))


@query(f"""with g as (select doc_id, 'r' || doc_id || '.md' as source from documents where {KIND} not in ({ERRORS})), m as (select max(doc_id) as top from documents where {KIND} <> 0)
select source, top + row_number() over (order by source) as id, 'active' as status, case {KIND} when {NUMBER['author spelled in different case']} then 'ann,Ann' else 'ann' end || ',lee' as authors from g, m""")
def promoted(spark, sf_dir):
    """Candidates without errors, numbered on from the greatest id, the reviewer among their authors."""
    files = records.parse(store(spark, sf_dir))
    return records.promote(files, files, "lee", TODAY).select("source", "id", "status", F.array_join("authors", ",").alias("authors"))


@query(f"""with g as (select doc_id, 'r' || doc_id || '.md' as source from documents where {KIND} not in ({ERRORS})), m as (select max(doc_id) as top from documents where {KIND} <> 0),
n as (select doc_id, source, top + row_number() over (order by source) as id from g, m)
select id, source from n where {KIND} in ({NUMBER['symbol anchors without parser']}) or not exists (select 1 from documents d where d.source like 'src%')""")
def promotion_advice(spark, sf_dir):
    """Records that point at nothing when they are promoted: here those with a symbol anchor only."""
    files = records.parse(store(spark, sf_dir))
    return health.born_orphans(records.promote(files, files, "lee", TODAY), A.files(spark, sf_dir))


@query(f"select doc_id as id, case when doc_id = (select min(doc_id) from documents where {KIND} = {len(FAULTS)}) then 'archived' when {KIND} = {NUMBER['invalid status']} then 'asleep' else 'active' end as status, case when doc_id = (select min(doc_id) from documents where {KIND} = {len(FAULTS)}) then 'note: {TODAY} archived: gone' when {KIND} = {NUMBER['no evidence']} then '' when {KIND} = {NUMBER['bad url evidence']} then 'url: ftp://x' else 'pr: 1' end as last from documents where {KIND} <> 0")
def transitioned(spark, sf_dir):
    """One record archived with a note, the others as they were."""
    files = records.parse(store(spark, sf_dir)).where("not broken")
    first = files.where((F.col("id") % (len(FAULTS) + 1)) == len(FAULTS)).agg(F.min("id")).first()[0]
    return records.transition(files, first, "archived", "gone", TODAY).select("id", "status", F.coalesce(F.try_element_at("evidence", F.lit(-1)), F.lit("")).alias("last"))


@query("""select 'r' || doc_id || '.md' as source, doc_id as id, 'Doc #' || doc_id as title, (['low', 'medium', 'high', 'critical'])[doc_id % 4 + 1] as severity, 'a' || doc_id || '[.]' as pattern, case when doc_id % 3 = 0 then '' else 'commit: abc' || doc_id end as evidence, 'Body ' || doc_id || '.' as body from documents where doc_id % 13 <> 0""")
def written_and_read(spark, sf_dir):
    """Records in their canonical form, read once more."""
    once = records.parse(record_texts(spark, sf_dir)).where("not broken")
    r = records.parse(records.to_text(once).select("source", "text"))
    return r.select("source", "id", "title", "severity", F.get("pattern_anchors", 0).alias("pattern"), F.array_join("evidence", ",").alias("evidence"), "body")


@query("""with d as (select doc_id as ord, 'draft-' || (doc_id % 40) as stem from documents), t as (select distinct 'draft-' || (doc_id % 40) || '-' || (2 + doc_id % 3) as name from documents where doc_id % 7 = 0 union select 'draft-' || (doc_id % 40) from documents where doc_id % 11 = 0),
r as (select *, row_number() over (partition by stem order by ord) as place from d),
n as (select stem, k, case when k = 1 then stem else stem || '-' || k end as name from (select distinct stem from d), range(1, 1000) g(k)),
f as (select n.stem, n.name, row_number() over (partition by n.stem order by k) as place from n where n.name not in (select name from t) and (k = 1 or n.name not in (select stem from d)))
select r.ord, f.name from r join f using (stem, place)""")
def draft_names(spark, sf_dir):
    d, i = doc(spark, sf_dir), F.col("doc_id")
    stem = lambda: joined("'draft-", (i % 40).cast("string"))
    taken = d.where(i % 7 == 0).select(F.concat(stem(), F.lit("-"), (2 + i % 3).cast("string")).alias("name")).union(d.where(i % 11 == 0).select(stem()))
    return records.free_names(d.select(i.alias("ord"), stem().alias("stem")), taken).select("ord", "name")


@query("select event_id as name from events where epoch(date_trunc('second', ts)) < (select max(epoch(date_trunc('second', ts))) from events) - 10 * 86400")
def stale_markers(spark, sf_dir):
    e = A.table(spark, sf_dir, "events").select(F.col("event_id").alias("name"), F.unix_timestamp("ts").cast("double").alias("mtime"))
    return activity.stale(e, e.agg(F.max("mtime")).first()[0], 10).select("name")


@query("select least(floor(l_discount * 100)::int, 9) as bin, count(*) as n from (select l_discount * 10 / 10 as l_discount from lineitem) group by 1")
def value_histogram(spark, sf_dir):
    """Discounts, which go to a tenth, in ten bins."""
    return activity.histogram(A.table(spark, sf_dir, "lineitem").select((F.floor(F.col("l_discount") * 100) / 10).alias("value")))


@query("with r as (select l_orderkey, count(*) as n from (select l_orderkey, rank() over (partition by l_orderkey order by l_quantity desc) as r from lineitem) where r = 1 group by l_orderkey) select count(*) filter (n = 1) as survived, count(*) filter (n > 1) as failed, count(*) filter (n = 1) / count(*)::double as share from r")
def survival_share(spark, sf_dir):
    best = health.unique_best(A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_partkey").alias("candidate"), F.col("l_quantity").alias("ratio")))
    return activity.survival(best.select(F.when(F.col("outcome") == "ambiguous", "failed").otherwise(F.col("outcome")).alias("outcome")))


@query("select strftime(ts, '%Y-%m-%dT%H:%M:%S') as ts, 'c' || event_id as to from events where event_id % 5 = 0 and strftime(ts, '%Y-%m-%dT%H:%M:%S') >= '2024-01-10T00:00:00'")
def reset_log(spark, sf_dir):
    e, i = A.table(spark, sf_dir, "events"), F.col("event_id")
    line = F.when(i % 5 == 0, joined("'reset: moving to c", "event_id", "' again")).otherwise(joined("'commit: c", "event_id"))
    return logs.reset_hits(e.select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), line.alias("line")), "2024-01-10T00:00:00")


@query("with d as (select 'old/' || (doc_id % 50) as path, doc_id as seq, sha1(doc_id::varchar) as sha from documents where doc_id % 3 = 0) select path, arg_min(sha, seq) as sha from d where path in (select distinct 'old/' || (doc_id % 25) from documents) group by path")
def killing_commits(spark, sf_dir):
    d, i = doc(spark, sf_dir), F.col("doc_id")
    name = lambda n: joined("'old/", (i % n).cast("string"))
    deleted = d.where(i % 3 == 0).select(i.alias("seq"), F.sha1(i.cast("string").cast("binary")).alias("sha"), name(50).alias("path"))
    return reanchor.killing_commit(deleted, d.select(name(25).alias("path")).distinct())


@query("select source as repo, doc_id as seq, sha1(doc_id::varchar) as sha, 'gone/' || doc_id || '/' || unnest(range(doc_id % 3)) as path from documents")
def deletion_log(spark, sf_dir):
    """Deleted paths from a log's text, the commits of each repository in order."""
    i = F.col("doc_id")
    head = F.concat(F.lit("\x02"), F.sha1(i.cast("string").cast("binary")), F.lit("\x012020-01-02\x01Subject"))
    paths = F.slice(F.array(*[joined("'gone/", "doc_id", f"'/{k}") for k in range(2)]), F.lit(1), (i % 3).cast("int"))
    lines = doc(spark, sf_dir).select(F.col("source").alias("repo"), "doc_id", F.posexplode(F.concat(F.array(head, F.lit("")), paths)).alias("p", "line")).select("repo", (i * 10 + F.col("p")).alias("n"), "line")
    found = logs.git_deletions(logs.git_log(lines))
    order = doc(spark, sf_dir).select(F.sha1(i.cast("string").cast("binary")).alias("sha"), i.alias("doc"))
    return found.join(order, "sha").select("repo", F.col("doc").alias("seq"), "sha", "path")


@query("select doc_id as ord, source || '/a.py' as path, case when doc_id % 4 = 3 then '' when doc_id % 4 = 2 then 'one ' || doc_id else text end as content from documents where doc_id % 4 <> 1")
def edit_payloads(spark, sf_dir):
    d, i = doc(spark, sf_dir), F.col("doc_id")
    path = joined("source", "'/a.py")
    plain = F.to_json(F.struct(F.struct(path.alias("file_path"), F.col("text").alias("new_string")).alias("tool_input")))
    parts = F.to_json(F.struct(F.struct(path.alias("notebook_path"), F.array(F.struct(F.lit("one").alias("new_string")), F.struct(i.cast("string").alias("new_string"))).alias("edits")).alias("tool_input")))
    bare = F.to_json(F.struct(F.struct(path.alias("file_path"), F.lit(5).alias("edits")).alias("tool_input")))
    value = F.when(i % 4 == 0, plain).when(i % 4 == 2, parts).when(i % 4 == 3, bare).otherwise("{no json")
    return logs.payloads(d.select(i.alias("ord"), value.alias("value"))).select("ord", "path", "content")


@query("select distinct id, path from (select doc_id as id, 'd/' || (doc_id % 100) || '.txt' as path from documents where doc_id % 2 = 1 and doc_id % 100 < 60 union all select doc_id, 'd/' || k || '.txt' from documents, range(0, 3) r(k) where doc_id % 2 = 0)")
def draft_anchors(spark, sf_dir):
    """Paths to anchor candidates at: a comment's own if it is tracked, a revert's first three that are."""
    d, i = doc(spark, sf_dir), F.col("doc_id")
    name = lambda n: joined("'d/", n.cast("string"), "'.txt")
    revert = i % 2 == 0
    null = F.lit(None).cast("string")
    ranked = d.select(i.alias("id"), F.when(revert, "revert").otherwise("comment").alias("section"), F.when(revert, F.substring(F.md5(i.cast("string").cast("binary")), 1, 8)).alias("commit"), F.when(~revert, F.concat(name(i % 100), F.lit(":7"))).alias("location"), null.alias("file"), null.alias("component"))
    changes = d.where(revert).select(F.md5(i.cast("string").cast("binary")).alias("sha"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k")).select("sha", name(F.col("k")).alias("path"))
    tracked = spark.range(60).select(name(F.col("id")).alias("path"))
    return mining.anchor_paths(ranked, changes, tracked)


FIRST = "select doc_id as id, 'alpha' || doc_id as name, source || '/' || lang || '/' || doc_id || '.py' as path from documents"


@query(f"with f as ({FIRST}) select id, path from f where id % 3 <> 2")
def symbol_match(spark, sf_dir):
    """Symbol anchors against the definitions of every file: a bare name, one held to its file, one held to another."""
    d, i = doc(spark, sf_dir), F.col("doc_id")
    path = joined("source", "'/", "lang", "'/", "doc_id", "'.py")
    name = joined("'alpha", "doc_id")
    value = F.when(i % 3 == 0, name).when(i % 3 == 1, F.concat(path, F.lit("::"), name)).otherwise(F.concat(F.lit("other.py::"), name))
    anchors = d.select(i.alias("id"), joined("'r", "doc_id", "'.md").alias("source"), F.lit("symbol").alias("kind"), value.alias("value"), F.lit(0).alias("anchor_ord"), F.lit("low").alias("severity"), F.lit(0.5).alias("confidence"), F.lit("active").alias("status"))
    code = d.select(path.alias("path"), F.concat(F.lit("def "), name, F.lit("(x):\n    return x\n")).alias("content"))
    found = matching.signals(anchors, d.select(i.alias("ord"), path.alias("path"), F.lit("").alias("content")), symbols=logs.definitions(code))
    return found.select("id", "path")


@query("select doc_id as id from documents where doc_id % 3 = 2")
def lost_symbols(spark, sf_dir):
    """Symbol anchors that mean no definition of any file."""
    d, i = doc(spark, sf_dir), F.col("doc_id")
    name = joined("'alpha", "doc_id")
    anchors = d.select(i.alias("id"), F.lit("symbol").alias("kind"), name.alias("value"), F.lit("active").alias("status"))
    code = d.where(i % 3 != 2).select(joined("'p", "doc_id", "'.py").alias("path"), F.concat(F.lit("def "), name, F.lit("(x):\n    return x\n")).alias("content"))
    return health.lost_symbols(anchors, logs.definitions(code)).select("id")


BRIEF = [(1, "path", "src1/en", 0, "low", 0.5, "active"), (2, "path", "src1", 0, "low", 0.5, "active"), (3, "path", "src2/", 0, "low", 0.5, "active"), (4, "pattern", "[0-9]7[.]txt$", 0, "low", 0.5, "active"), (5, "command", "make", 0, "low", 0.5, "active"), (6, "path", "src1/en", 0, "low", 0.5, "archived"), (7, "pattern", "zzzqqq", 0, "low", 0.5, "active")]


@query(f"with f as (select source || '/' || lang || '/' || doc_id || '.txt' as path from documents where source = 'src1'), a as (select * from ({A.values(BRIEF)}) v(id, kind, value, anchor_ord, severity, confidence, status) where status = 'active') select distinct id from a where kind = 'command' or (kind = 'path' and exists (select 1 from f where starts_with(path, rtrim(value, '/')) or starts_with(value, path || '/'))) or (kind = 'pattern' and exists (select 1 from f where regexp_matches(path, value)))")
def brief_records(spark, sf_dir):
    """Which records belong in a brief about the files of one source."""
    return matching.brief_filter(spark.createDataFrame(BRIEF, A.ANCHOR_SCHEMA), A.files(spark, sf_dir).where(F.startswith("path", F.lit("src1/"))).select("path"))


@query("select doc_id as id, '[fence #' || doc_id || ' | severity: low | confidence: 0.5] Doc ' || doc_id as label, trim(regexp_replace(case when strpos(w, '. ') > 0 then w[1:strpos(w, '. ')] else w end, '^$', '')[1:140]) as rule from (select doc_id, trim(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g')) as w from documents)")
def label_and_rule(spark, sf_dir):
    """A record's label, and its body's first sentence."""
    d = doc(spark, sf_dir)
    label = X.label_line(F.lit("fence"), F.lit("active"), F.col("doc_id"), F.lit("low"), F.lit(0.5), joined("'Doc ", "doc_id"))
    return d.select(F.col("doc_id").alias("id"), label.alias("label"), F.trim(X.rule_line(F.col("text"))).alias("rule"))


@query("""select user_id::varchar as repo, count(*) as showings, sum(n)::bigint as ids from (select user_id, date_trunc('minute', ts) as t, count(*) as n from events group by all) group by user_id""")
def showing_log(spark, sf_dir):
    """Showings as lines of a log: one for every minute and repository."""
    e = A.table(spark, sf_dir, "events")
    w = F.row_number().over(Window.partitionBy("user_id", F.date_trunc("minute", "ts")).orderBy("event_id"))
    shown = e.select(F.date_trunc("minute", "ts").cast("string").alias("ts"), F.col("user_id").cast("string").alias("repo"), F.lit("t").alias("target"), F.col("event_id").alias("id"), w.alias("pos"), F.lit(True).alias("full"))
    lines = appends.showing_lines(shown, "x").select(F.from_json("value", "ts string, repo string, scar_ids array<long>, count int").alias("v"))
    return lines.select("v.repo", "v.count").groupBy("repo").agg(F.count("*").alias("showings"), F.sum("count").alias("ids"))


@query("""select 'f' || doc_id || case when doc_id % 3 = 2 then '.js' else '.py' end as path, unnest(['F' || doc_id, 'F' || doc_id || '.bar', 'baz']) as name, unnest(case doc_id % 3 when 2 then [1, 2, 4] else [1, 2, 5] end) as first from documents""")
def definitions_in_broken_files(spark, sf_dir):
    """Python, every other file with an error in its last definition, and JavaScript."""
    i = F.col("doc_id")
    sound = joined("'class F", "doc_id", "':\n    def bar(self):\n        return ", "doc_id", "'\n\ndef baz(x):\n    return [y for y in x]\n")
    broken = joined("'class F", "doc_id", "':\n    def bar(self):\n        return ", "doc_id", "'\n\ndef baz(x):\n    return (y = = x\n")
    script = joined("'class F", "doc_id", "' {\n  bar() { return ", "doc_id", "' }\n}\nfunction baz(x) { return x }\n")
    path = joined("'f", "doc_id", F.when(i % 3 == 2, ".js").otherwise(".py"))
    return logs.definitions(doc(spark, sf_dir).select(path.alias("path"), F.when(i % 3 == 0, sound).when(i % 3 == 1, broken).otherwise(script).alias("content"))).select("path", "name", "first")
