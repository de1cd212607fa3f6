"""Registered queries over the adapters, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import activity, health, matching, mining, reanchor, similarity
from ..operators.tables import placed
from ..sources import logs, records
from . import adapters as A

NOW_MONTHS = 2001 * 12 + 8
TODAY = "2026-06-15"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

FILES = "f as (select doc_id as ord, source || '/' || lang || '/' || doc_id || '.txt' as path, text as content from documents)"
RECORDS = f"a as (select *, 'records/' || lpad(cast(id as varchar), 4, '0') || '.md' as source from ({A.values(A.ANCHORS)}) v(id, kind, value, anchor_ord, severity, confidence, status)), live as (select * from a where status in ('active', 'challenged'))"
WEIGHT = "(case severity when 'low' then 1 when 'medium' then 2 when 'high' then 3 when 'critical' then 4 else 2 end)"
HIT = "regexp_matches(substr({t}, 1, 65536), {p}, 'i')"


def signal_sql(content: bool) -> str:
    parts = [
        "select id, source, severity, confidence, ord, path, cast(2.0 as double) as strength, 'path' as name, 0 as place from live join f on starts_with(path, rtrim(value, '/')) where kind = 'path'",
        f"select id, source, severity, confidence, ord, path, cast(1.5 as double), 'path_pattern', 2 * anchor_ord + 2 from live join f on {HIT.format(t='path', p='value')} where kind = 'pattern'",
    ]
    if content:
        parts.append(f"select id, source, severity, confidence, ord, path, cast(2.5 as double), 'content_pattern', 2 * anchor_ord + 3 from live join f on content <> '' and {HIT.format(t='content', p='value')} where kind = 'pattern'")
    return f"""s1 as (select id, source, severity, confidence, ord, path, name, max(strength) as strength, min(place) as place from ({' union all '.join(parts)}) group by all),
s as (select id, source, severity, confidence, ord, path, max(strength) as strength, string_agg(name, ',' order by place) as matched_by from s1 group by id, source, severity, confidence, ord, path)"""


def query(sql: str = "") -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


TOPS = f"""with {FILES}, {RECORDS}, {signal_sql(True)},
r as (select *, strength * cast({WEIGHT} as double) * confidence as rank, contains(matched_by, 'content_pattern') as act_proof from s),
t as (select *, row_number() over (partition by ord, path order by act_proof desc, rank desc, source) as pos from r qualify pos <= {{k}})"""


def tops(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return matching.top_of_target(matching.ranked(matching.signals(A.anchors(spark), A.files(spark, sf_dir))), k)


@query(TOPS.replace("{k}", "3") + " select id, path, strength, matched_by, rank, pos from t")
def anchor_topk(spark, sf_dir):
    return tops(spark, sf_dir, 3).select("id", "path", "strength", F.array_join("matched_by", ",").alias("matched_by"), "rank", "pos")


@query(TOPS.replace("{k}", "3") + """, b as (select id, max(rank) as rank, max(strength) as strength, bool_or(act_proof) as any_act, min(struct_pack(ord := ord, pos := pos)) as first from t group by id),
w as (select t.id, t.path, t.rank, t.act_proof, b.first from t join b on t.id = b.id and t.rank = b.rank qualify row_number() over (partition by t.id order by t.ord, t.pos) = 1)
select id, path, rank, row_number() over (order by act_proof desc, rank desc, first.ord, first.pos) as pos from w qualify pos <= 5""")
def anchor_merge(spark, sf_dir):
    return matching.merge_best(tops(spark, sf_dir, 3), 5).select("id", "path", "rank", "pos")


@query(f"""with {RECORDS}, c as (select conv_id, turn, text from conversations),
h as (select distinct id, source, severity, confidence, conv_id, turn, text from live join c on {HIT.format(t='text', p='value')} where kind = 'command')
select id, conv_id, turn, cast(2.5 as double) * cast({WEIGHT} as double) * confidence as rank, row_number() over (partition by conv_id, turn order by cast(2.5 as double) * cast({WEIGHT} as double) * confidence desc, source) as pos from h qualify pos <= 3""")
def command_match(spark, sf_dir):
    c = A.table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("ord"), F.col("text").alias("command"))
    return matching.for_commands(A.anchors(spark), c).select("id", "ord.conv_id", "ord.turn", "rank", "pos")


@query(f"""with {FILES}, {RECORDS}, {signal_sql(False)}, v as (select * from ({A.values(A.RULES)}) v(id, violation)),
h as (select s.id, s.path, f.content, lower(f.content) as low, v.violation from s join v using (id) join f on f.ord = s.ord and f.path = s.path where s.source <> s.path and {HIT.format(t='f.content', p='v.violation')}),
p as (select *, strpos(substr(low, 1, 65536), regexp_extract(substr(low, 1, 65536), violation)) as place from h)
select id, path, substr(list_extract(string_split(substr(content, 1, place - 1), chr(10)), -1) || list_extract(string_split(substr(substr(content, 1, 65536), place), chr(10)), 1), 1, 120) as excerpt from p""")
def violations(spark, sf_dir):
    rules = spark.createDataFrame(A.RULES, "id long, violation string")
    return matching.violations(A.anchors(spark), rules, A.files(spark, sf_dir)).select("id", "path", "excerpt")


URL = "regexp_replace(url, '^[a-z]+://', '')"
WHY = [(1, "path", "tionsh.example", 0, "low", 0.5, "archived"), (2, "path", "m.theror.example.net/es/29287/", 0, "low", 0.5, "active"), (3, "path", "tionsh.example.net/en/1", 0, "low", 0.5, "active")]


@query(f"""with p as (select distinct {URL} as path from pages union select 'm.theror.example.net'), a as (select * from ({A.values(WHY)}) v(id, kind, value, anchor_ord, severity, confidence, status))
select distinct path, id from p join a on starts_with(path, rtrim(value, '/')) or starts_with(rtrim(value, '/'), path)""")
def why_path(spark, sf_dir):
    pages = A.table(spark, sf_dir, "pages").select(F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    paths = pages.union(spark.createDataFrame([("m.theror.example.net",)], "path string")).distinct()
    return matching.covering(spark.createDataFrame(WHY, A.ANCHOR_SCHEMA), paths)


def live_sql(scope: str, own: str) -> str:
    return f"""with {FILES}, {RECORDS}, scope as (select * from a where {scope}),
hit as (select distinct id, kind, value from scope join f on (kind = 'path' and starts_with(path, rtrim(value, '/'))) or (kind = 'pattern' {own} and ({HIT.format(t='path', p='value')} or (content <> '' and {HIT.format(t='content', p='value')})))),
j as (select scope.*, hit.id is not null as live from scope left join hit on scope.id = hit.id and scope.kind = hit.kind and scope.value = hit.value where scope.kind in ('path', 'pattern')),
g as (select id, count(*) filter (live) as n_live, count(*) filter (not live) as n_dead, string_agg(value, ',' order by value) filter (not live and kind = 'path') as dead_paths, string_agg(value, ',' order by value) filter (not live and kind = 'pattern') as dead_patterns from j group by id),
r as (select o.id, not o.command and coalesce(n_live, 0) = 0 as all_dead, coalesce(n_live, 0) as n_live, coalesce(n_dead, 0) as n_dead, coalesce(dead_paths, '') as dead_paths, coalesce(dead_patterns, '') as dead_patterns from (select id, bool_or(kind = 'command') as command from scope group by id) o left join g using (id))"""


FIRING_SQL = "status in ('active', 'challenged')"


def shown(df: DataFrame) -> DataFrame:
    return df.select("id", "n_live", "n_dead", F.array_join("dead_paths", ",").alias("dead_paths"), F.array_join("dead_patterns", ",").alias("dead_patterns"))


COLUMNS = "select id, n_live, n_dead, dead_paths, dead_patterns from r where "


@query(live_sql(FIRING_SQL, "and path <> source") + COLUMNS + "all_dead")
def orphans(spark, sf_dir):
    return shown(health.orphans(A.anchors(spark), A.files(spark, sf_dir)))


@query(live_sql(FIRING_SQL, "and path <> source") + COLUMNS + "not all_dead and n_live > 0 and n_dead > 0")
def partial_rot(spark, sf_dir):
    return shown(health.partial_rot(A.anchors(spark), A.files(spark, sf_dir)))


@query(live_sql("status = 'orphaned'", "") + COLUMNS + "not all_dead")
def reverse_hint(spark, sf_dir):
    return shown(health.revived(A.anchors(spark), A.files(spark, sf_dir)))


@query(f"with {FILES}, {RECORDS}, n as (select count(*) as n_files from f) select id, value, count(*) as covered, n_files, count(*) / cast(n_files as double) as share from live join f on starts_with(path, rtrim(value, '/')), n where kind = 'path' group by id, value, n_files having n_files >= 20 and count(*) / cast(n_files as double) >= 0.25")
def overbroad(spark, sf_dir):
    return health.overbroad(A.anchors(spark), A.files(spark, sf_dir)).select("id", "value", "covered", "n_files", "share")


FIRES = "e as (select event_id, user_id as repo, json_extract_string(props, '$.k') as target, event_type as record_id, event_type = 'error' as violated, ts, epoch(ts)::bigint as t from events)"
STATS = "count(*) filter (not violated) as fired, count(*) filter (violated) as violations, max(ts) as last_fired"


@query(f"with {FIRES} select record_id, {STATS} from e group by record_id")
def fire_stats(spark, sf_dir):
    return activity.fire_stats(A.fires(spark, sf_dir), ["record_id"])


@query(f"with {FIRES} select repo, record_id, {STATS} from e group by repo, record_id")
def fire_stats_by_repo(spark, sf_dir):
    return activity.fire_stats(A.fires(spark, sf_dir), ["repo", "record_id"])


@query(f"with {FIRES} select distinct event_type as id from (select event_type from events union all select 'nothing') x where event_type not in (select record_id from e where not violated)")
def never_fired(spark, sf_dir):
    ids = A.table(spark, sf_dir, "events").select(F.col("event_type").alias("id")).union(spark.createDataFrame([("nothing",)], "id string"))
    return activity.never_fired(ids, A.fires(spark, sf_dir))


@query(f"with {FIRES}, g as (select repo, record_id, {STATS} from e group by repo, record_id), w as (select record_id, sum(fired) as fired from g group by record_id), t as (select *, sum(fired) over () as total from w) select record_id, cast(fired as bigint) as fired, fired / cast(total as double) as share from t where total > 20 and fired / cast(total as double) > 0.2")
def advisory_share(spark, sf_dir):
    return activity.advisories(activity.fire_stats(A.fires(spark, sf_dir), ["record_id"]), share=0.2).select("record_id", "fired", "share")


@query(f"with {FIRES} select record_id, count(*) filter (violated) as violations, count(*) filter (not violated) as fired from e join (select 'click' as record_id, timestamp '1990-01-01' as armed_at union all select 'error', timestamp '2024-01-15') a using (record_id) where ts >= armed_at group by record_id")
def compliance(spark, sf_dir):
    armed = spark.sql("select 'click' as record_id, timestamp '1990-01-01' as armed_at union all select 'error', timestamp '2024-01-15'")
    return activity.compliance(A.fires(spark, sf_dir), armed)


FOLD = """with recursive {fires}, n as (select repo, target, event_id, t, row_number() over (partition by repo, target order by t, event_id) as i from e),
r as (select repo, target, event_id, t, i, t as last, true as stands from n where i = 1
 union all select n.repo, n.target, n.event_id, n.t, n.i, case when n.t - r.last {op} then n.t else r.last end, n.t - r.last {op} from r join n on n.repo = r.repo and n.target = r.target and n.i = r.i + 1)
select repo, target, event_id, stands from r"""


@query(FOLD.replace("{fires}", FIRES).replace("{op}", "> 14400"))
def cooldown_full(spark, sf_dir):
    return activity.cooldown(A.fires(spark, sf_dir), ["repo", "target"], ["event_id"])


@query(FOLD.replace("{fires}", FIRES).replace("{op}", ">= 86400"))
def block_once(spark, sf_dir):
    return activity.block_once(A.fires(spark, sf_dir), ["repo", "target"], ["event_id"])


@query("with c as (select -(event_id // 20) as seq, user_id as path from events), l as (select distinct seq from c order by seq limit 10) select path, count(distinct seq) as commits from c join l using (seq) group by path having count(distinct seq) >= 2")
def churn(spark, sf_dir):
    c = A.table(spark, sf_dir, "events").select((-F.floor(F.col("event_id") / 20)).alias("seq"), F.col("user_id").alias("path"))
    return activity.churn(c, least=2)


EXTRA = "the [a-z]*ing"


@query(f"select conv_id as session, count(*) filter (role = 'assistant' and regexp_matches(text, '{X.REVERT_SPEECH}|{EXTRA}', 'i')) as revert_language, count(*) filter (role = 'user' and regexp_matches(text, '{X.USER_NEGATION.replace(chr(39), chr(39) * 2)}', 'i')) as user_corrections, count(*) filter (role = 'assistant' and regexp_matches(text, '{X.REVERT_SPEECH}|{EXTRA}', 'i')) >= 1 as triggered from conversations group by conv_id")
def transcript_signals(spark, sf_dir):
    c = A.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), "role", F.lit("text").alias("kind"), "text", F.lit(None).cast("string").alias("file"), F.lit(False).alias("is_error"))
    return activity.transcript_signals(c, extra=EXTRA).select("session", "revert_language", "user_corrections", "triggered")


#: What invented prose has in place of the words that miners look for.
SUBJECT_EXTRA, COMMENT_EXTRA = "ention of|tion the", "Licensed under|[a-z]+ed the [a-z]+ing"
SUBJECT_SQL = f"{X.REVERT_SUBJECT}|{SUBJECT_EXTRA}"
COMMENT_SQL = f"{X.MARKED_COMMENT}|{COMMENT_EXTRA}".replace(chr(39), chr(39) * 2)
COMMITS = "c as (select doc_id as seq, md5(cast(doc_id as varchar)) as sha, strftime(date '1996-01-01' + cast(doc_id % 3000 as integer), '%Y-%m-%d') as date, string_split(text, chr(10))[1] as subject, text from documents)"


@query(f"with {COMMITS} select substr(sha, 1, 8) as commit, date, subject from c where regexp_matches(subject, '{SUBJECT_SQL}', 'i')")
def revert_hits(spark, sf_dir):
    return mining.reverts(A.commits(spark, sf_dir), SUBJECT_EXTRA).select("commit", "date", "subject")


@query(f"with {FILES}, l as (select path, unnest(string_split(content, chr(10))) as line, generate_subscripts(string_split(content, chr(10)), 1) as n from f) select path || ':' || n as location, substr(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), 1, 120) as text from l where regexp_matches(line, '{COMMENT_SQL}')")
def comment_hits(spark, sf_dir):
    return mining.comments(A.files(spark, sf_dir), COMMENT_EXTRA).select("location", "text")


@query("with p as (select page_id as seq, regexp_replace(url, '^[a-z]+://', '') as path from pages), g as (select seq, path, array_to_string(string_split(path, '/')[1:2], '/') as component from p where contains(path, '/') and seq % 2 = 0), v as (select distinct array_to_string(string_split(path, '/')[1:2], '/') as component from p where seq % 2 = 1) select component, count(*) as files_deleted, '2000-01-' || lpad(cast(min(seq) % 28 + 1 as varchar), 2, '0') as died from g where component not in (select component from v) group by component")
def deleted_components(spark, sf_dir):
    p = A.table(spark, sf_dir, "pages").select(F.col("page_id").alias("seq"), F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    gone = p.where("seq % 2 = 0").select("seq", F.col("seq").cast("string").alias("sha"), F.concat(F.lit("2000-01-"), F.lpad((F.col("seq") % 28 + 1).cast("string"), 2, "0")).alias("date"), F.lit("").alias("subject"), "path")
    return mining.deleted_components(gone, p.where("seq % 2 = 1").select("path")).select("component", "files_deleted", "died")


OSC = """with h as (select l_partkey as file, l_returnflag as value, row_number() over w as n, lead(l_returnflag, 1) over w as b, lead(l_returnflag, 2) over w as c from lineitem window w as (partition by l_partkey order by l_shipdate, l_orderkey, l_linenumber)),
g as (select *, n - row_number() over (partition by file order by n) as run from h where value = c and value <> b),
u as (select file, run, (count(*) + 1) // 2 as cycles, arg_min(value || ' -> ' || b || ' -> ' || value, n) as first, min(n) as place from g group by file, run)
select file, cast(sum(cycles) as bigint) as oscillation_count{more} from u group by file"""


@query(OSC.replace("{more}", ""))
def oscillation(spark, sf_dir):
    return mining.oscillations(A.history(spark, sf_dir), ["file"], ["l_shipdate", "l_orderkey", "l_linenumber"]).select("file", "oscillation_count")


@query(OSC.replace("{more}", ", arg_min(first, place) as sequence"))
def flapping_first_cycle(spark, sf_dir):
    h = mining.oscillations(A.history(spark, sf_dir), ["file"], ["l_shipdate", "l_orderkey", "l_linenumber"])
    return h.select("file", "oscillation_count", F.concat_ws(" -> ", "first.value", "first.back", "first.value").alias("sequence"))


MONTHS = "({now} - (cast(substr(d, 1, 4) as integer) * 12 + cast(substr(d, 6, 2) as integer)))"
RECENT = f"(case when {MONTHS} <= 12 then cast(1 as double) when {MONTHS} >= 60 then cast(0 as double) else cast(60 - {MONTHS} as double) / 48 end)".replace("{now}", str(NOW_MONTHS))


@query(f"select o_orderkey, {RECENT} as bonus from (select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as d from orders)")
def recency(spark, sf_dir):
    return A.table(spark, sf_dir, "orders").select("o_orderkey", X.recency(F.date_format("o_orderdate", "yyyy-MM-dd"), NOW_MONTHS).alias("bonus"))


HARVEST = f"""with {COMMITS}, {FILES},
v as (select 'revert' as section, 1 as part, seq, substr(sha, 1, 8) as commit, date as d, subject, null as location, null as text from c where regexp_matches(subject, '{SUBJECT_SQL}', 'i')),
l as (select ord, path, unnest(string_split(content, chr(10))) as line, generate_subscripts(string_split(content, chr(10)), 1) as n from f),
m as (select 'comment' as section, 4 as part, n as seq, null as commit, null as d, null as subject, path || ':' || n as location, trim(line, ' ') as text from l where regexp_matches(line, '{COMMENT_SQL}')),
z as (select *, substr(sha1(case section when 'revert' then 'revert:' || commit else 'comment:' || location || ':' || substr(text, 1, 40) end), 1, 10) as id,
 case section when 'revert' then cast(3 as double) + (case when regexp_matches(subject, '#[0-9]+') then cast(1.5 as double) else cast(0 as double) end) + {RECENT} else cast(1 as double) + (case when regexp_matches(text, '{X.HIGH_COMMENT.replace(chr(39), chr(39) * 2)}', 'i') then cast(1.5 as double) else cast(0 as double) end) end as score from (select * from v union all select * from m)),
h as (select *, row_number() over (order by score desc, part, seq, id) as pos from z)"""


def harvested(spark, sf_dir):
    return mining.harvest([mining.reverts(A.commits(spark, sf_dir), SUBJECT_EXTRA), mining.comments(A.files(spark, sf_dir), COMMENT_EXTRA)], NOW_MONTHS)


@query(HARVEST + " select id, section, score from z")
def candidate_score(spark, sf_dir):
    return harvested(spark, sf_dir).select("id", "section", "score")


@query(HARVEST + " select id, section, score, pos from h where pos <= 20")
def harvest_topk(spark, sf_dir):
    return mining.top(harvested(spark, sf_dir), 20).select("id", "section", "score", "pos")


@query("""with r as (select cast(doc_id as varchar) as id, row_number() over (order by n_chars desc, doc_id) as pos from documents), t as (select count(*) as total from r), n as (select distinct least(n, total) as n from (values (5), (10), (20), (100), (1000000)) v(n), t),
j as (select r.pos, l.quality = 1 as keep from r left join labels l on r.id = cast(l.doc_id as varchar)), b as (select count(*) filter (keep) / cast(count(keep) as double) as base_rate from j)
select n, count(keep) as labeled_in_top, coalesce(count(*) filter (keep) / nullif(cast(count(keep) as double), 0), 0) as precision, base_rate, coalesce(count(*) filter (keep) / nullif(cast(count(keep) as double), 0), 0) - base_rate as lift from n join j on pos <= n, b group by n, base_rate""")
def precision_at_n(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents")
    longer = placed(d.select(F.col("doc_id").cast("string").alias("id"), "n_chars", "doc_id"), F.col("n_chars").desc(), "doc_id").select("id", "pos")
    labels = A.table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id"), (F.col("quality") == 1).alias("keep"))
    return mining.precision(longer, labels, [5, 10, 20, 100, 1_000_000])


LINES = "list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: length(x) >= 10))"


@query(f"""with d as (select item_id as id, {LINES} as lines from benchmark), o as (select doc_id as path, {LINES} as lines from documents), x as (select id, len(lines) as n, unnest(lines) as line from d), y as (select path, unnest(lines) as line from o)
select id, path, count(*) / cast(n as double) as ratio, case when count(*) / cast(n as double) >= 0.6 then 'high' else 'low' end as tier from x join y using (line) group by id, path, n having count(*) / cast(n as double) >= 0.2""")
def benchmark_overlap(spark, sf_dir):
    dead = A.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    return reanchor.line_overlap(dead, A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text"))


CLASSED = f"o as (select doc_id, {LINES} as lines from documents), c as (select min(doc_id) as rep, first(lines) as lines, count(*) as members, list(doc_id) as ids from o where len(lines) > 0 group by list_sort(lines))"


@query(f"""with {CLASSED}, x as (select rep as id, len(lines) as n, unnest(lines) as line from c), y as (select rep as path, unnest(lines) as line from c)
select id, path, count(*) / cast(n as double) as ratio, case when count(*) / cast(n as double) >= 0.6 then 'high' else 'low' end as tier from x join y using (line) group by id, path, n having count(*) / cast(n as double) >= 0.2""")
def overlap_tier(spark, sf_dir):
    """Every document against every other, between the representatives of equal line sets."""
    d = A.table(spark, sf_dir, "documents")
    pairs, _, _ = reanchor.overlap_classes(d.select(F.col("doc_id").alias("id"), "text"), d.select(F.col("doc_id").alias("path"), "text"))
    return pairs.select(F.col("left").alias("id"), F.col("right").alias("path"), "ratio", "tier")


@query(f"with {CLASSED} select unnest(ids) as doc_id, rep as class, members from c")
def line_classes(spark, sf_dir):
    """Who belongs to which representative of overlap_tier, and how many do."""
    d = A.table(spark, sf_dir, "documents").select("doc_id", X.signature_lines(F.col("text")).alias("lines"))
    _, members = similarity.classes(d, "doc_id", "lines")
    sizes = members.groupBy("set").agg(F.count("*").alias("members"))
    return members.join(sizes, "set").select("doc_id", F.col("set").alias("class"), "members")


WORDS = "list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: x <> '')"


@query(f"""with w as (select item_id as id, {WORDS} as w from benchmark), g as (select id, list_distinct(case when len(w) < 3 then w else list_transform(range(1, len(w) - 1), lambda i: w[i] || '|' || w[i + 1] || '|' || w[i + 2]) end) as s from w), e as (select id, len(s) as n, unnest(s) as s from g)
select a.id as a, b.id as b, count(*) / cast(a.n + b.n - count(*) as double) as similarity from e a join e b on a.s = b.s and a.id < b.id group by a.id, b.id, a.n, b.n having count(*) / cast(a.n + b.n - count(*) as double) >= 0.01""")
def shingle_jaccard(spark, sf_dir):
    b = A.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), X.shingles(F.array_remove(F.split(F.lower("text"), "[^a-z]+"), "")).alias("shingles"))
    return reanchor.shingle_similarity(b, 0.01)


CHAIN = "r as (select old, new from (select doc_id as old, lead(doc_id) over (partition by text order by doc_id) as new from documents) where new is not null)"


@query(f"""with recursive {CHAIN}, w as (select old as path, old as here, 0 as hops from r union all select w.path, r.new, w.hops + 1 from w join r on r.old = w.here)
select path, arg_max(here, hops) as terminal from w group by path""")
def rename_terminal(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents")
    at = placed(d.select(F.sha2("text", 256).alias("of"), F.col("doc_id").alias("old")), "of", "old")
    after = at.select((F.col("pos") - 1).alias("pos"), F.col("of").alias("then"), F.col("old").alias("new"))
    edges = at.join(after, "pos").where("of <=> then").select("old", "new")
    return reanchor.rename_terminal(edges, edges.select(F.col("old").alias("path")), d.select(F.col("doc_id").alias("path")))


@query(SQL["benchmark_overlap"].join(["select id, case when count(*) > 1 then 'ambiguous' when min(tier) <> 'high' then 'low confidence' else 'applied' end as outcome, case when count(*) = 1 and min(tier) = 'high' then min(path) end as proposed from (", ") group by id"]))
def reanchor_eligible(spark, sf_dir):
    found = benchmark_overlap(spark, sf_dir)
    return reanchor.eligible(found.select("id", F.lit("").alias("dead"), F.col("path").alias("proposed"), "tier")).select("id", "outcome", "proposed")


@query("select l_orderkey as item, case when count(*) = 1 then 'survived' else 'ambiguous' end as outcome from (select l_orderkey, l_quantity, rank() over (partition by l_orderkey order by l_quantity desc) as r from lineitem) where r = 1 group by l_orderkey")
def unique_best(spark, sf_dir):
    return health.unique_best(A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_partkey").alias("candidate"), F.col("l_quantity").alias("ratio")))


@query("select lower(n) as folded, array_to_string(list_sort(list(distinct n)), ',') as spellings from (select c_mktsegment as n from customer union all select lower(c_mktsegment) from customer where c_custkey % 3 = 0) group by lower(n) having count(distinct n) > 1")
def author_drift(spark, sf_dir):
    c = A.table(spark, sf_dir, "customer")
    n = c.select(F.col("c_mktsegment").alias("author")).union(c.where("c_custkey % 3 = 0").select(F.lower("c_mktsegment")))
    return health.author_drift(n).select("folded", F.array_join("spellings", ",").alias("spellings"))


@query("""with recursive e as (select p_partkey as id, length(p_name) + 1 as n, case p_size % 4 when 0 then 0 when 1 then 1 when 2 then 2 else 3 end as o, -(p_retailprice / 10000) as c from part),
s as (select *, row_number() over (order by o, c, id) as pos from e),
f as (select pos, id, n <= 2000 as taken, cast(2000 - case when n <= 2000 then n else 0 end as bigint) as room from s where pos = 1 union all select s.pos, s.id, s.n <= f.room, f.room - case when s.n <= f.room then s.n else 0 end from f join s on s.pos = f.pos + 1)
select cast(pos - 1 as integer) as pos, id, taken from f""")
def brief_budget(spark, sf_dir):
    severity = F.element_at(F.array(F.lit("critical"), F.lit("high"), F.lit("medium"), F.lit("low")), (F.col("p_size") % 4 + 1).cast("int"))
    p = A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), severity.alias("severity"), (F.col("p_retailprice") / 10000).alias("confidence"), F.col("p_name").alias("entry"))
    return health.brief(p, 2000)


@query("with e as (select distinct o_custkey as id, substr(md5(cast(o_orderkey as varchar)), 1, 8) as sha from orders), r as (select md5(cast(l_orderkey as varchar)) as sha from lineitem where l_quantity > 30), x as (select md5(cast(l_orderkey as varchar)) as sha from lineitem where l_quantity > 20) select id, sha, case when sha in (select substr(sha, 1, 8) from x) then 'off-history' else 'missing' end as reason from e where sha not in (select substr(sha, 1, 8) from r)")
def unreachable_evidence(spark, sf_dir):
    sha = lambda c: F.md5(F.col(c).cast("string").cast("binary"))
    li = A.table(spark, sf_dir, "lineitem")
    e = A.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.substring(sha("o_orderkey"), 1, 8).alias("sha"))
    seen = lambda q: li.where(F.col("l_quantity") > q).select(sha("l_orderkey").alias("sha")).distinct()
    return health.unreachable_evidence(e, seen(30), seen(20))


@query("select doc_id as id, case quality when 1 then 'keep' else 'discard' end as label from labels")
def last_labels(spark, sf_dir):
    rows = A.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "keep").otherwise("discard").alias("label"), F.col("doc_id").alias("line_no"))
    old = rows.select("id", F.lit("keep").alias("label"), (F.col("line_no") - 1_000_000).alias("line_no"))
    return activity.last_labels(rows.union(old))


@query("select event_id as line_no, event_type from events order by event_id desc limit 200")
def newest_lines(spark, sf_dir):
    return activity.newest(A.table(spark, sf_dir, "events").select(F.col("event_id").alias("line_no"), "event_type"), 200)


def doc(spark, sf_dir):
    return A.table(spark, sf_dir, "documents")


def joined(*parts: Column | str) -> Column:
    """Columns, names of columns, and texts that a ' marks, after one another; numbers as texts."""
    return F.concat(*[F.lit(x[1:]) if isinstance(x, str) and x.startswith("'") else F.col(x).cast("string") if isinstance(x, str) else x for x in parts])


def record_texts(spark, sf_dir):
    """A record file for every document, with comments, quotes, odd values and defects at set places."""
    i = F.col("doc_id")
    pick = lambda when, one, other: F.when(when, F.lit(one)).otherwise(F.lit(other))
    severity = F.element_at(F.array(*[F.lit(x) for x in ("low", "medium", "high", "critical")]), (i % 4 + 1).cast("int"))
    evidence = F.when(i % 3 == 0, "").otherwise(joined("'evidence:\n  - commit: ", F.when(i % 2 == 0, joined("'\"abc", "doc_id", "'\"")).otherwise(joined("'abc", "doc_id", "' # why")), "'\n"))
    text = joined(
        "'---\nid: ", "doc_id", "'\ntype: ", pick(i % 7 == 0, "odd", "fence"), "'\ntitle: Doc #", "doc_id", "'\nseverity: ", severity, "' # of four\nconfidence: ", pick(i % 5 == 0, "much", "0.25"),
        "'\nauthors: [mara, Lee]\nanchors:\n  - path: ", "source", "'/", "lang", "'/ # here\n  - pattern: \"a", "doc_id", "'[.]\"\n", evidence, "'status: ", pick(i % 11 == 0, "archived", "active"), "'\n---\n\nBody ", "doc_id", "'.\n",
    )
    return doc(spark, sf_dir).select(joined("'r", "doc_id", "'.md").alias("source"), F.when(i % 13 == 0, joined("'no head ", "doc_id")).otherwise(text).alias("text"))


@query("""select 'r' || doc_id || '.md' as source, doc_id as id, case when doc_id % 7 = 0 then 'odd' else 'fence' end as type, 'Doc #' || doc_id as title,
(['low', 'medium', 'high', 'critical'])[doc_id % 4 + 1] as severity, cast(case when doc_id % 5 = 0 then 0.5 else 0.25 end as double) as confidence, source || '/' || lang || '/' as path,
'a' || doc_id || '[.]' as pattern, case when doc_id % 3 = 0 then '' else 'commit: abc' || doc_id end as evidence, case when doc_id % 11 = 0 then 'archived' else 'active' end as status, 'Body ' || doc_id || '.' as body
from documents where doc_id % 13 <> 0""")
def parsed_records(spark, sf_dir):
    r = records.parse(record_texts(spark, sf_dir)).where("not broken")
    return r.select("source", "id", "type", "title", "severity", "confidence", F.get("path_anchors", 0).alias("path"), F.get("pattern_anchors", 0).alias("pattern"), F.array_join("evidence", ",").alias("evidence"), "status", "body")


@query("""select level, message, count(*) as n from (
select 'error' as level, 'missing frontmatter' as message from documents where doc_id % 13 = 0
union all select 'error', 'unknown type' from documents where doc_id % 13 <> 0 and doc_id % 7 = 0
union all select 'warning', 'no evidence' from documents where doc_id % 13 <> 0 and doc_id % 3 = 0) group by all""")
def lint_findings(spark, sf_dir):
    return records.lint(records.parse(record_texts(spark, sf_dir)), TODAY).groupBy("level", "message").agg(F.count("*").alias("n"))


@query("select 'r' || doc_id || '.md' as source, case when doc_id % 13 = 0 then '' when lang = 'en' then source || '/english/' else source || '/' || lang || '/' end as path from documents")
def rewritten_anchors(spark, sf_dir):
    changes = doc(spark, sf_dir).where("lang = 'en'").select(joined("'r", "doc_id", "'.md").alias("source"), joined("source", "'/en/").alias("old"), joined("source", "'/english/").alias("new"))
    texts = reanchor.rewrite_anchors(record_texts(spark, sf_dir), changes)
    return texts.select("source", F.regexp_extract("text", r"- path: (\S+) # here", 1).alias("path"))


@query("select 'f' || doc_id || '.py' as path, unnest(['F' || doc_id, 'F' || doc_id || '.bar', 'baz']) as name, unnest([1, 2, 5]) as first from documents where doc_id % 2 = 0")
def symbol_defs(spark, sf_dir):
    code = joined("'class F", "doc_id", "':\n    def bar(self):\n        return 1\n\ndef baz(x):\n    return [y for y in x]\n")
    sources = doc(spark, sf_dir).select(joined("'f", "doc_id", F.when(F.col("doc_id") % 2 == 0, ".py").otherwise(".txt")).alias("path"), code.alias("content"))
    return logs.definitions(sources).select("path", "name", "first")


@query("select doc_id as diff_id, 1 as ord, source || '/x.txt' as path, replace(text, chr(13) || chr(10), chr(10)) as content from documents")
def diff_targets(spark, sf_dir):
    d = doc(spark, sf_dir).select(F.col("doc_id").alias("diff_id"), F.concat(F.lit("--- a/x\n+++ b/"), "source", F.lit("/x.txt\n"), F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("+"), x)), "\n"), F.lit("\n+++ /dev/null\n-gone")).alias("text"))
    return logs.diff_targets(d)


@query("""select repo, rec as id, count(*) as fired, count(*) filter (where violated) as violated, max(ts) as last from (
select cast(user_id as varchar) as repo, event_id % 5 as rec, false as violated, strftime(ts, '%Y-%m-%dT%H:%M:%S') as ts from events where event_id % 10 <> 3
union all select cast(user_id as varchar), event_id % 7, true, strftime(ts, '%Y-%m-%dT%H:%M:%S') from events where event_id % 4 = 0 and event_id % 10 <> 3) group by all""")
def firing_log(spark, sf_dir):
    """The log written as JSON lines and read again; every tenth line is broken."""
    e = A.table(spark, sf_dir, "events").withColumn("at", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    line = F.to_json(F.struct(F.col("at").alias("ts"), F.col("user_id").cast("string").alias("repo"), F.col("props").alias("target"), F.array(F.col("event_id") % 5).alias("scar_ids"), F.when(F.col("event_id") % 4 == 0, F.array(F.col("event_id") % 7)).alias("violation_ids")))
    lines = e.select(F.col("event_id").alias("line_no"), F.when(F.col("event_id") % 10 == 3, F.lit("{broken")).otherwise(line).alias("value"))
    return logs.firings(lines).groupBy("repo", F.col("record_id").alias("id")).agg(F.count("*").alias("fired"), F.count_if("violated").alias("violated"), F.max("ts").alias("last"))


@query("""select cast(conv_id as varchar) as session, case when role = 'user' then 'user' else 'assistant' end as role, count(*) as blocks, cast(sum(length(text)) as bigint) as chars from conversations group by all""")
def transcript_lines(spark, sf_dir):
    """Turns as transcript lines, a text or a list of one block, and read again."""
    c = A.table(spark, sf_dir, "conversations")
    role = F.when(F.col("role") == "user", "user").otherwise("assistant")
    one = F.to_json(F.struct(role.alias("type"), F.struct(F.col("text").alias("content")).alias("message")))
    listed = F.to_json(F.struct(role.alias("type"), F.struct(F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))).alias("content")).alias("message")))
    lines = c.select(F.col("conv_id").cast("string").alias("session"), F.col("turn").alias("line_no"), F.when(F.col("turn") % 2 == 0, one).otherwise(listed).alias("value"))
    return logs.transcript_blocks(lines).groupBy("session", "role").agg(F.count("*").alias("blocks"), F.sum(F.length("text")).alias("chars"))


def git_lines(spark, sf_dir):
    """A log for every source: a commit for each document, with a rename and a changed line."""
    i = doc(spark, sf_dir)
    head = joined("'\x02", F.sha1(F.col("doc_id").cast("string").cast("binary")), "'\x01", "'2020-01-02\x01Subject ", "doc_id")
    rest = F.when(F.col("doc_id") % 2 == 0, F.array(joined("'R100\told/", "doc_id", "'\tnew/", "doc_id"))).otherwise(F.array(joined("'+++ b/src/", "doc_id", "'.yaml"), joined("'+replicas: ", (F.col("doc_id") % 9).cast("string"))))
    return i.select(F.col("source").alias("repo"), "doc_id", F.posexplode(F.concat(F.array(head), F.array(F.lit("")), rest)).alias("p", "line")).select("repo", (F.col("doc_id") * 10 + F.col("p")).alias("n"), "line")


@query("select source as repo, 'old/' || doc_id as old, 'new/' || doc_id as new, sha1(cast(doc_id as varchar)) as sha, row_number() over (partition by source order by doc_id) - 1 as seq from documents qualify doc_id % 2 = 0")
def git_rename_log(spark, sf_dir):
    log = logs.git_log(git_lines(spark, sf_dir))
    return logs.git_renames(log).join(logs.git_commits(log).select("repo", "seq", "sha"), ["repo", "seq"]).select("repo", "old", "new", "sha", "seq")


@query("select source as repo, 'src/' || doc_id || '.yaml' as file, 'replicas' as key, cast(doc_id % 9 as varchar) as value, sha1(cast(doc_id as varchar)) as sha from documents where doc_id % 2 = 1")
def tracked_value_log(spark, sf_dir):
    return logs.tracked_values(logs.git_patch_lines(logs.git_log(git_lines(spark, sf_dir)))).select("repo", "file", "key", "value", "sha")


@query(FOLD.replace("{fires}", FIRES).replace("{op}", ">= 3600"))
def throttled(spark, sf_dir):
    return activity.throttle(A.fires(spark, sf_dir), ["repo", "target"], ["event_id"])


@query("select user_id || '|' || event_type as key, max(epoch(date_trunc('second', ts))::bigint) as t from events group by all having max(epoch(date_trunc('second', ts))::bigint) >= (select max(epoch(date_trunc('second', ts))::bigint) from events) - 864000 order by t desc, key limit 1000")
def remembered_keys(spark, sf_dir):
    e = A.table(spark, sf_dir, "events").select(F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("key"), F.unix_timestamp("ts").alias("t"))
    return activity.remembered(e, e.agg(F.max("t")).first()[0], 864_000)


@query("select doc_id, (list_max(list_transform(string_split(text, chr(10)), lambda x: struct_pack(n := length(x), line := x)))).line[1:200] as line from documents")
def telling_lines(spark, sf_dir):
    return doc(spark, sf_dir).select("doc_id", X.telling_line(F.split("text", "\n")).alias("line"))


DEAD = [(1, "licensed under"), (2, "zzzqqq"), (3, "(a+)+$"), (4, "^The [a-z]+"), (5, "[[]x")]


@query(f"""with q as (select * from ({A.values(DEAD)}) v(id, value)), l as (select doc_id, unnest(string_split(text, chr(10))) as line from documents),
m as (select q.id, min(l.doc_id) as seq from q join l on q.id <> 3 and regexp_matches(l.line, q.value) group by q.id)
select cast(q.id as bigint) as id, q.value, case when q.id = 3 then 'skipped — pathological pattern (ReDoS risk)' when m.seq is null then 'no prior match found' else 'last matched at ' || md5(cast(m.seq as varchar))[1:7] end as diagnostic from q left join m on m.id = q.id""")
def pattern_diagnostics(spark, sf_dir):
    lines = doc(spark, sf_dir).select(F.col("doc_id").alias("seq"), F.md5(F.col("doc_id").cast("string").cast("binary")).alias("sha"), F.explode(F.split("text", "\n")).alias("text"))
    return reanchor.pattern_diagnostic(spark.createDataFrame(DEAD, "id long, value string"), lines)


@query(f"""with {FILES}, s as (select doc_id as id, case when doc_id % 3 = 0 then 'Foo' when doc_id % 3 = 1 then source || '/' || lang || '/' || doc_id || '.txt::Foo' else 'gone::Foo' end as value, source || '/' || lang || '/' || doc_id || '.txt' as own from documents)
select id, value, case when id % 3 = 2 then null else own end as path from s""")
def symbol_paths(spark, sf_dir):
    f = A.files(spark, sf_dir)
    third = F.col("ord") % 3
    value = F.when(third == 0, "Foo").when(third == 1, joined("path", "'::Foo")).otherwise("gone::Foo")
    symbols = f.select(F.col("ord").alias("id"), value.alias("value"))
    return reanchor.symbol_path(symbols, f.select(F.col("ord").alias("id"), F.col("path").alias("value")), f.select("path"))


@query("""with r as (select doc_id as id, case quality when 1 then 'keep' when 0 then 'discard' end as label from labels)
select id, label, case when label is null then 'invalid label' when id % 2 = 1 then 'no such candidate' end as refused from r""")
def label_requests(spark, sf_dir):
    asked = A.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "keep").when(F.col("quality") == 0, "discard").alias("label"), F.lit("").alias("note"))
    return mining.label_requests(asked, doc(spark, sf_dir).where("doc_id % 2 = 0").select(F.col("doc_id").alias("id")), TODAY).select("id", "label", "refused")


@query("select count(*) as n, median(l_discount) as median, min(l_discount) as least, max(l_discount) as most from lineitem")
def value_spread(spark, sf_dir):
    return activity.spread(A.table(spark, sf_dir, "lineitem").select(F.col("l_discount").alias("value")))


def dead_anchors(spark, sf_dir):
    found = health.orphans(A.anchors(spark), A.files(spark, sf_dir))
    return found.select("id", X.orphan_reason(F.col("dead_paths"), F.col("dead_patterns"), "no anchors").alias("reason"))


HINT = " — hint: a pattern that guards against reintroduction (healthy when absent) belongs in violation:, not anchors"


@query("select * from (values (cast(7 as bigint), 'all anchors dead (paths: gone/; patterns: /zzzqqq/)" + HINT + "'), (8, 'all anchors dead (patterns: /qqqzzz/)" + HINT + "'), (11, 'no anchors')) v(id, reason)")
def orphan_reasons(spark, sf_dir):
    return dead_anchors(spark, sf_dir)


@query(f"with {FILES}, l as (select path, unnest(string_split(content, chr(10))) as line, generate_subscripts(string_split(content, chr(10)), 1) as n from f), c as (select path || ':' || n as location, substr(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), 1, 120) as text from l where regexp_matches(line, '{COMMENT_SQL}')) select location, '- [' || substr(sha1('comment:' || location || ':' || substr(text, 1, 40)), 1, 10) || ' score 1.0] `' || location || '` — ' || text as line from c")
def harvest_lines(spark, sf_dir):
    found = mining.harvest([mining.comments(A.files(spark, sf_dir), COMMENT_EXTRA)], NOW_MONTHS)
    return found.withColumn("score", F.lit(1.0)).select("location", X.harvest_line(F.col("section")).alias("line"))


@query("select o_orderkey as id, rtrim(left(regexp_replace(lower(o_orderpriority || ' of ' || o_orderkey), '[^a-z0-9]+', '-', 'g'), 12), '') as slug from orders")
def short_slugs(spark, sf_dir):
    return A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), X.short_slug(joined("o_orderpriority", "' of ", "o_orderkey"), "none", 12).alias("slug"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
