"""Registered queries over commit graphs and patches that Spark makes of the tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import ancestry, tracing
from . import adapters as A
from .catalog import LINES, doc, joined, query

#: Orders as commits: the first parent is the customer's order before, the second, of every third, one of fifty shares of the customers;
#: repositories are priorities.
GRAPH = """o as (select o_orderpriority as repo, o_orderkey as k, md5(o_orderkey::varchar) as sha, lag(o_orderkey) over (partition by o_orderpriority, o_custkey order by o_orderkey) as one, lag(o_orderkey) over (partition by o_orderpriority, o_custkey % 50 order by o_orderkey) as two from orders),
first as (select repo, k, sha, md5(one::varchar) as parent from o),
e as (select repo, sha, parent from first where parent is not null union all select repo, sha, md5(two::varchar) from o where two is not null and k % 3 = 0 and one is not null),
heads as (select repo, sha from o where k % 41 = 0)"""
REACHED = GRAPH + """,
r as (select repo, sha from heads union select r.repo, e.parent from r join e on e.repo = r.repo and e.sha = r.sha),
m as (select o.repo, o.sha, case when o.repo = '5-LOW' then null else r.sha is not null end as reachable from o left join r using (repo, sha))"""


def sha(c: Column) -> Column:
    return F.md5(c.cast("string").cast("binary"))


def commit_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(parents, heads, shallow) of orders as commits."""
    o = A.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("repo"), F.col("o_orderkey").alias("k"), "o_custkey", (F.col("o_custkey") % 50).alias("fifty"))
    before = lambda by: F.lag("k").over(Window.partitionBy("repo", by).orderBy("k"))
    o = o.withColumn("one", before("o_custkey")).withColumn("two", before("fifty"))
    first = o.select("repo", sha(F.col("k")).alias("sha"), F.lit(0).alias("nth"), sha(F.col("one")).alias("parent"))
    second = o.where("two is not null and one is not null and k % 3 = 0").select("repo", sha(F.col("k")).alias("sha"), F.lit(1).alias("nth"), sha(F.col("two")).alias("parent"))
    shallow = spark.createDataFrame([("5-LOW",)], "repo string")
    return first.union(second), o.where("k % 41 = 0").select("repo", sha(F.col("k")).alias("sha")), shallow


@query(f"with recursive {REACHED} select * from m")
def reachable_commits(spark, sf_dir):
    return ancestry.reachable(*commit_graph(spark, sf_dir))


PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
EVIDENCE = "v as (select c_custkey as id, n, p.repo, substr(md5((c_custkey * 8 + n)::varchar), 1, 7 + c_custkey % 9) as sha from customer, (values (0), (1), (2)) x(n), (select distinct o_orderpriority as repo from orders) p)"
STATES = f"""with recursive {REACHED}, {EVIDENCE},
j as (select v.id, v.n, v.repo, v.sha, min(m.sha) as found, count(m.sha) as names, bool_or(m.reachable) as ok from v left join m on m.repo = v.repo and substr(m.sha, 1, 7) = substr(v.sha, 1, 7) and starts_with(m.sha, v.sha) group by all),
s as (select id, n, repo, sha, case when repo = '5-LOW' then 'unknown' when names = 1 and ok then 'reachable' when names = 1 then 'off-history' else 'missing' end as state, case when names = 1 then found end as full from j)"""


def customer_evidence(spark, sf_dir):
    c = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("n"))
    c = c.withColumn("repo", F.explode(F.array(*[F.lit(x) for x in PRIORITIES])))
    return c.select("id", "n", "repo", F.substring(sha(F.col("id") * 8 + F.col("n")), F.lit(1), (F.col("id") % 9 + 7).cast("int")).alias("sha"))


def customer_states(spark, sf_dir):
    parents, heads, shallow = commit_graph(spark, sf_dir)
    return ancestry.evidence_states(customer_evidence(spark, sf_dir), ancestry.reachable(parents, heads, shallow), shallow)


@query(f"{STATES} select id, n, repo, sha, state from s")
def evidence_states(spark, sf_dir):
    return customer_states(spark, sf_dir).select("id", "n", "repo", "sha", "state")


@query(f"""{STATES} select id, arg_min(repo, p) as repo, arg_min(f, p) as sha from (select id, repo, "full" as f, n as p from s where state = 'reachable') group by id""")
def first_evidence(spark, sf_dir):
    return ancestry.first_evidence(customer_states(spark, sf_dir))


@query(f"""with recursive {GRAPH}, v as (select repo, sha, case when k % 5 <> 0 then md5('b' || k) end as blob from o where k % 4 = 0 and k // 4 % 2 = 0),
w as (select repo, sha as asked, sha as here from o where k % 7 = 0 union all select w.repo, w.asked, f.parent from w join first f on f.repo = w.repo and f.sha = w.here where f.parent is not null and not exists (select 1 from v where v.repo = w.repo and v.sha = w.here)),
x as (select w.repo, w.asked, v.blob from w join v on v.repo = w.repo and v.sha = w.here)
select o.repo, o.sha, 'p0' as path, x.blob from o left join x on x.repo = o.repo and x.asked = o.sha where o.k % 7 = 0""")
def content_at_commit(spark, sf_dir):
    parents, _, _ = commit_graph(spark, sf_dir)
    o = A.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("repo"), F.col("o_orderkey").alias("k"))
    blob = F.when(F.col("k") % 5 != 0, F.md5(joined("'b", "k").cast("binary")))
    versions = o.where("k % 4 = 0").select("repo", sha(F.col("k")).alias("sha"), joined("'p", (F.floor(F.col("k") / 4) % 2).cast("string")).alias("path"), blob.alias("blob"))
    asked = o.where("k % 7 = 0").select("repo", sha(F.col("k")).alias("sha"), F.lit("p0").alias("path"))
    return ancestry.at(ancestry.numbered_lines(parents), versions, asked)


@query(f"""with d as (select doc_id, {LINES} as lines, sha1(doc_id::varchar) as sha from documents),
p as (select 2 * doc_id + 1 as seq, 'old/' || doc_id as file, -1 as sign, unnest(string_split(text, chr(10))) as line from documents
      union all select 2 * doc_id + 1, 'moved/' || doc_id, 1, unnest(string_split(text, chr(10))) from documents where doc_id % 3 = 0
      union all select 2 * doc_id, 'late/' || doc_id, 1, unnest(string_split(text, chr(10))) from documents where doc_id % 3 = 1),
near as (select doc_id as id, 'old/' || doc_id as dead, 'moved/' || doc_id as proposed, 1.0::double as ratio, 'killing-commit ' || sha[1:7] || ': overlap ' as said from d where doc_id % 3 = 0 and len(lines) > 0),
rest as (select doc_id as id, sha, lines, list_max(list_transform(lines, lambda x: struct_pack(n := length(x), x := x))).x[1:200] as line from d where doc_id % 3 <> 0 and len(lines) > 0),
asked as (select distinct line from rest),
c as (select a.line, seq, file, sum(sign) as net from asked a join p on contains(p.line, a.line) group by a.line, seq, file having sum(sign) <> 0),
q as (select line, seq, row_number() over (partition by line order by seq) as r from (select distinct line, seq from c) qualify r <= 20),
t as (select distinct c.line, c.file from c join q using (line, seq) where net > 0),
far as (select rest.id, 'old/' || rest.id as dead, t.file as proposed, len(list_intersect(rest.lines, f.lines)) / len(rest.lines)::double as ratio, 'pickaxe ' || rest.sha[1:7] || ': distinctive-line match, overlap ' as said
        from rest join t using (line) join d f on f.doc_id = string_split(t.file, '/')[2]::bigint)
select id, dead, proposed, ratio, case when ratio >= 0.6 then 'high' else 'low' end as tier, said || format('{{:.2f}}', ratio) as evidence from (select * from near union all select * from far) where ratio >= 0.2""")
def path_traces(spark, sf_dir):
    """Every document deleted: a third is moved by the same commit, a third turns up in a later one, a third is gone."""
    d, i = doc(spark, sf_dir), F.col("doc_id")
    seq, name = 2 * i + 1, F.sha1(i.cast("string").cast("binary"))
    deletions = d.select(seq.alias("seq"), name.alias("sha"), joined("'old/", "doc_id").alias("path"))
    part = lambda rows, at, by, folder, sign: rows.select(at.alias("seq"), by.alias("sha"), joined(folder, "doc_id").alias("file"), F.lit(sign).alias("sign"), F.explode(F.split("text", "\n")).alias("text"))
    moved, late = d.where(i % 3 == 0), d.where(i % 3 == 1)
    patches = part(d, seq, name, "'old/", "-").union(part(moved, seq, name, "'moved/", "+")).union(part(late, 2 * i, F.sha1(joined("'late", "doc_id").cast("binary")), "'late/", "+"))
    files = moved.select(joined("'moved/", "doc_id").alias("path"), F.col("text").alias("content")).union(late.select(joined("'late/", "doc_id").alias("path"), F.col("text").alias("content")))
    return tracing.trace_paths(d.select(i.alias("id"), joined("'old/", "doc_id").alias("path")), deletions, patches, files)


def code_history(spark, sf_dir, later: Column):
    """Every document as a commit of its source that adds a Python file; the next commit makes `later` of its class."""
    d = doc(spark, sf_dir)
    w = Window.partitionBy("source").orderBy("doc_id")
    d = d.select("doc_id", "source", F.lag("doc_id").over(w).alias("back"), F.lead("doc_id").over(w).alias("next"))
    name = lambda c: F.sha1(F.col(c).cast("string").cast("binary"))
    first = joined("'class F", "doc_id", "':\n    def bar(self, x", "doc_id", "'):\n        y", "doc_id", "' = x", "doc_id", "' + ", "doc_id", "'\n        return y", "doc_id", "'\n")
    d = d.withColumn("path", joined("'f", "doc_id", "'.py")).withColumn("first", first).withColumn("later", F.when(F.col("next").isNotNull(), later).otherwise(first))
    parents = d.select(F.col("source").alias("repo"), name("doc_id").alias("sha"), F.lit(0).alias("nth"), name("back").alias("parent"))
    heads = d.where("next is null").select(F.col("source").alias("repo"), name("doc_id").alias("sha"))
    blob = lambda text: F.sha1(F.col(text).cast("binary"))
    versions = d.select(F.col("source").alias("repo"), name("doc_id").alias("sha"), "path", blob("first").alias("blob")).union(d.where("next is not null").select("source", name("next"), "path", blob("later")))
    contents = d.select(blob("first").alias("blob"), F.col("first").alias("content")).union(d.select(blob("later"), "later")).distinct()
    evidence = d.select(F.col("doc_id").alias("id"), F.lit(0).alias("n"), F.col("source").alias("repo"), F.lit("0123456789").alias("sha")).union(d.select("doc_id", F.lit(1), "source", F.substring(name("doc_id"), 1, 12)))
    anchors = d.select(F.col("doc_id").alias("id"), F.lit("path").alias("kind"), F.col("path").alias("value"), F.lit("active").alias("status")).union(d.select("doc_id", F.lit("symbol"), joined("'F", "doc_id", "'.bar"), F.lit("active")))
    placed = ancestry.numbered_lines(parents)
    states = ancestry.evidence_states(evidence, ancestry.reachable(parents, heads, placed=placed))
    return anchors, states, placed, versions, contents, d.select("path", F.col("later").alias("content"))


NEXT = "n as (select doc_id, lead(doc_id) over (partition by source order by doc_id) as next from documents)"


@query(f"with {NEXT} select doc_id as id, 'F' || doc_id || '.bar' as symbol, sha1(doc_id::varchar) as sha from n where next is not null and doc_id % 2 = 0")
def symbol_drift(spark, sf_dir):
    longer = F.concat("first", F.lit("        pass\n"))
    return tracing.drift(*code_history(spark, sf_dir, F.when(F.col("doc_id") % 2 == 0, longer).otherwise(F.concat(F.lit("# said\n"), "first")))).select("id", "symbol", "sha")


@query(f"with {NEXT} select doc_id as id, 'F' || doc_id || '.bar' as dead, 'f' || doc_id || '.py::' || unnest(['baz', 'F' || doc_id]) as proposed, 'high' as tier from n where next is not null and doc_id % 4 = 1")
def symbol_traces(spark, sf_dir):
    """Of every fourth file the method gets another name; the class around it is much alike as well."""
    found = tracing.trace_symbols(*code_history(spark, sf_dir, F.when(F.col("doc_id") % 4 == 1, F.replace("first", F.lit("def bar("), F.lit("def baz("))).otherwise(F.col("first"))))
    return found.where("tier = 'high'").select("id", "dead", "proposed", "tier")
