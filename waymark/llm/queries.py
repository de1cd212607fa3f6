"""The queries that apply each operator of this subpackage to its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import media, merkle, mixing, packing, periodic, pieces, quality_model, quality_rules, secrets, simhash, suffixes, toxicity, warc
from .common import table

NFKC = "nmt_nfkc"

Query = Callable[[SparkSession, str], DataFrame]


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve(warc.captures(table(spark, sf_dir, "pages")))
    page = lambda c: F.substring(c, 2, 19).cast("long")  # noqa: E731
    return found.select(
        page("record_id").alias("page_id"), "outcome", page("refers_to").alias("refers_to"), F.col("headers")["date"].alias("date"), F.col("headers")["content-length"].alias("content_length"), F.col("headers")["etag"].alias("etag")
    )


OP4_SQL = r"""
with u as (
  select page_id, md5(coalesce(html, '')) as tag, cast(coalesce(strlen(html), 0) as varchar) as size,
         regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?@]*@)?', '') as bare
  from pages),
v as (
  select page_id, tag, size,
         regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^(www|m)\.', ''), ':(80|443)$', '') as host,
         regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') as path,
         array_to_string(list_filter(string_split(regexp_extract(bare, '[?](.*)$', 1), '&'),
                                     lambda x: not regexp_matches(x, '^(utm_[a-z]+|gclid|fbclid|ref)=')), '&') as query
  from u),
k as (select page_id, tag, size, page_id * 1800 as ts, case when page_id % 7 = 3 then page_id * 1800 - 900 else page_id * 1800 + 900 + 1800 * ((page_id * 7919) % 997) end as t, host || path || case when query <> '' then '?' || query else '' end as key from v),
j as (select b.page_id, b.t, b.tag as new_tag, a.page_id as hit, a.tag as old_tag, a.size from k b asof left join k a on a.key = b.key and a.ts < b.t),
o as (select *, case when hit is null then 'missing' when page_id % 11 = 5 then 'unvalidated' when new_tag <> old_tag then 'mismatch' else 'resolved' end as outcome from j)
select page_id, outcome,
       case when outcome = 'resolved' then hit end as refers_to,
       case when outcome = 'resolved' then cast(t as varchar) end as date,
       case when outcome = 'resolved' then size end as content_length,
       case when outcome = 'resolved' then 'W/' || new_tag end as etag
from o
"""


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP5_SQL = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
         cast('0x' || substr(md5('mix:' || coalesce(cast(doc_id as varchar), '')), 1, 9) as bigint) as h
  from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
p as (select *, (row_number() over (order by source asc nulls last) - 1) % 3 + 1 as w, row_number() over (order by source asc nulls last) as place, source_size * 3 as most from s),
q as (select *, row_number() over (order by most / cast(w as double), place) as turn from p),
r as (select *, cast(sum(source_size) over () - coalesce(sum(most) over (order by turn rows between unbounded preceding and 1 preceding), 0) as double) as room,
             cast(sum(w) over () - coalesce(sum(w) over (order by turn rows between unbounded preceding and 1 preceding), 0) as double) as room_w from q),
f as (select room, room_w, turn from r where w * room / room_w <= most order by turn limit 1),
t as (select r.source, r.source_size, case when r.turn >= f.turn then r.w * f.room / f.room_w else cast(r.most as double) end as target from r, f),
k as (select *, case when source_size > 0 then least(cast(floor(target / source_size) as bigint), 3) else 0 end as whole from t),
b as (select *, target - whole * source_size as budget from k),
e as (select source, h, sum(size) as size from d group by source, h),
u as (select source, h, size, sum(size) over (partition by source order by h) as upto from e),
g as (select b.source, min(struct_pack(h := u.h, size := u.size, before := u.upto - u.size)) as hit
      from b join u on b.source is not distinct from u.source where u.upto > b.budget group by b.source),
c as (select b.source, b.whole, b.source_size, b.target,
             case when g.hit is null then 68719476736 else g.hit.h + case when g.hit.size - (b.budget - g.hit.before) < b.budget - g.hit.before then 1 else 0 end end as below
      from b left join g on b.source is not distinct from g.source)
select d.doc_id, cast(d.size as bigint) as size, c.source_size, c.target, cast(d.size * (c.whole + case when d.h < c.below and c.whole < 3 then 1 else 0 end) as bigint) as taken
from d join c on d.source is not distinct from c.source
"""


OP9_SQL = r"""
with d as (select doc_id, coalesce(text, '') as text from documents),
l as (select doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words, string_split(text, chr(10)) as lines from d),
g as (select *, case when len(words) >= 5 then list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) else [] end as grams from l),
x as (select doc_id, unnest(grams) as gram, generate_subscripts(grams, 1) as at_word from g),
y as (select doc_id, at_word from (select *, count(*) over (partition by doc_id, gram) as n from x) where n > 1),
z as (select doc_id, sum(least(5, coalesce(after - at_word, 5))) as n from (select *, lead(at_word) over (partition by doc_id order by at_word) as after from y) group by doc_id),
i as (select doc_id, unnest(lines) as line from g),
m as (select doc_id, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as n, len(regexp_extract_all(line, '[#*$%&<>]|!!')) as odd, len(regexp_extract_all(line, '[|»›•]| > ')) as bars,
             regexp_matches(line, '(^|[\x20\x09-\x0D])({PHRASES})($|[\x20\x09-\x0D.,;:!?)])') as phrase from i),
v as (select doc_id, count(*) as n_failed_lines, sum(n) as n_lost_words from m where n > 0 and (odd > 0.3 * n or bars >= 0.34 * n or phrase) group by doc_id),
w as (select g.doc_id, cast(len(words) as bigint) as n_words, cast(length(array_to_string(words, '')) as bigint) as word_chars, cast(len(regexp_extract_all(text, '[#*$%&|<>]')) as bigint) as n_symbols,
             cast(len(list_filter(lines, lambda q: regexp_matches(q, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(lines, lambda q: regexp_matches(q, '[^\x20\x09-\x0D]')))) as bigint) as n_dup_lines,
             cast(coalesce(z.n, 0) as bigint) as n_repeat_words, cast(coalesce(v.n_failed_lines, 0) as bigint) as n_failed_lines, cast(coalesce(v.n_lost_words, 0) as bigint) as n_lost_words
      from g left join z using (doc_id) left join v using (doc_id))
select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed, not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and n_lost_words <= 0.5 * n_words as kept from w
"""


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup(table(spark, sf_dir, "documents")).drop("kept")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.rules(table(spark, sf_dir, "documents")).drop("cleaned")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(table(spark, sf_dir, "documents"))


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def pieces_nfkc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10_pieces behind the library's NFKC map: every text normalised by longest prefixes before it is encoded."""
    import public_tokenizers

    return pieces.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), normaliser=NFKC)


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.planted(table(spark, sf_dir, "documents")))


#: crc32 of the UTF-8 bytes of decimal digits, by its table of 256 values, which is built in the statement.
CRC = "crc as (select list(list_reduce([i::ubigint] || [0::ubigint, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c % 2 = 1 then xor(c // 2, 3988292384::ubigint) else c // 2 end) order by i) as t from range(256) r(i))"
CRC_OF = "xor(list_reduce([4294967295::ubigint] || list_transform(string_split({x}, ''), lambda a: ascii(a)::ubigint), lambda c, b: xor(c // 256, t[xor(c % 256, b)::bigint + 1])), 4294967295::ubigint)::bigint"

OP11_SQL = rf"""
with {CRC},
d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^ 	-]+') as w, {CRC_OF.format(x="doc_id::varchar")} as h from documents, crc),
e as (select doc_id, w, len(w) as n, h % 10 = 0 and len(w) > 0 as changed, case when len(w) > 0 then (h // 10) % len(w) end as a, (h // 10) % 8 + 3 as parts from d),
f as (select doc_id, n, case when changed then list_transform(range(0, n), lambda i: case when i < a then w[i + 1] else w[a + (i - a) % (1 + (n - a) // parts) + 1] end) else w end as w from e),
x as (select doc_id, n, unnest(w) as word, generate_subscripts(w, 1) - 1 as i from f),
m as (select a.doc_id, a.i, b.i - a.i as q from x a join x b on a.doc_id = b.doc_id and a.word = b.word and b.i > a.i and 2 * (b.i - a.i) <= a.n),
l as (select doc_id, q from m group by doc_id, q having count(*) >= greatest(12 - q, q)),
s as (select doc_id, q, i, i - row_number() over (partition by doc_id, q order by i) as island from m semi join l using (doc_id, q)),
r as (select doc_id, min(i) as start, count(*) + q as length, q as period from s group by doc_id, q, island having count(*) >= greatest(12 - q, q)),
u as (select doc_id, start, length, min(period) as period from r group by doc_id, start, length),
g as (select doc_id, count(*) as n_runs, min(struct_pack(back := -length, start := start, period := period)) as best,
             string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as lines from u group by doc_id),
k as (select distinct u.doc_id, i from u, lateral (select unnest(range(u.start + u.period, u.start + u.length)) as i)),
c as (select doc_id, string_agg(word, ' ' order by i) as text from x anti join k using (doc_id, i) group by doc_id)
select f.doc_id, coalesce(n_runs, 0) as n_runs, best.start::bigint as start, (-best.back)::bigint as length, best.period::bigint as period,
       (-1000 * best.back // best.period)::bigint as exponent_milli, sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(c.text, '')) as collapsed_sha256
from f left join g using (doc_id) left join c using (doc_id)
"""


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digests(table(spark, sf_dir, "documents"))


def merkle_field(c: str) -> str:
    return f"coalesce(strlen({c}::varchar) || ':' || {c}, '-')"


MERKLE_HEAD = " || ".join(merkle_field(c) for c in ("doc_id", "source", "lang", "n_chars"))
#: Nodes of tree 0 are those of each source, of tree 1 the sources' roots; a level holds as many sixteenths as are left.
OP12_SQL = rf"""
with recursive {CRC},
d as (select *, coalesce('s' || source, '') as key, case when {CRC_OF.format(x="doc_id::varchar")} % 5 = 0 then translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else text end as changed from documents, crc),
l as (select doc_id, key, sha256({MERKLE_HEAD} || {merkle_field("text")}) as leaf, sha256({MERKLE_HEAD} || {merkle_field("changed")}) as now from d),
p as (select *, row_number() over (partition by key order by doc_id, leaf) - 1 as pos, count(*) over (partition by key) as n from l),
t as (select key, 0 as level, pos, n, leaf as h from p
      union all select key, level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(h, '' order by pos)) from t where n > 1 group by key, level, pos // 16, n),
b as (select key, h as subroot, row_number() over (order by key) - 1 as place, count(*) over () as trees from t where n = 1),
v as (select 0 as level, place as pos, trees as n, subroot as h from b
      union all select level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(h, '' order by pos)) from v where n > 1 group by level, pos // 16, n),
o as (select h as root from v where n = 1),
y as (select p.pos as leaf_pos, p.key, t.level, t.pos, t.h, t.pos = p.pos // (16 ** t.level)::bigint as own from p join t on t.key = p.key and t.n > 1 and t.pos // 16 = p.pos // (16 ** (t.level + 1))::bigint
      union all select p.pos, p.key, 100 + v.level, v.pos, v.h, v.pos = b.place // (16 ** v.level)::bigint from p join b using (key) join v on v.n > 1 and v.pos // 16 = b.place // (16 ** (v.level + 1))::bigint),
q as (select key, leaf_pos, sha256(coalesce(string_agg(h, '' order by level, pos) filter (not own), '')) as proof_sha256 from y group by all),
z as (select *, dense_rank() over (partition by key, leaf_pos order by level) as step from y),
f as (select key, pos as leaf_pos, 0::bigint as step, now as h from p
      union all select f.key, f.leaf_pos, f.step + 1, sha256(string_agg(case when z.own then f.h else z.h end, '' order by z.pos)) from f join z on z.key = f.key and z.leaf_pos = f.leaf_pos and z.step = f.step + 1 group by f.key, f.leaf_pos, f.step),
e as (select key, leaf_pos, arg_max(h, step) as folded_root from f group by all)
select p.doc_id, p.leaf, b.subroot, o.root, coalesce(q.proof_sha256, sha256('')) as proof_sha256, e.folded_root, e.folded_root = o.root as verified
from p join b using (key) join o on true join e on e.key = p.key and e.leaf_pos = p.pos left join q on q.key = p.key and q.leaf_pos = p.pos
"""


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def queries() -> dict[str, Query]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_secrets": op2_secrets,
        "op3_simhash": op3_simhash,
        "op4_warc": op4_warc,
        "op5_mixing": op5_mixing,
        "op6_quality": op6_quality,
        "op7_suffixes": op7_suffixes,
        "op8_media": op8_media,
        "op9_quality_rules": op9_quality_rules,
        "op10_pieces": op10_pieces,
        "op11_periodic": op11_periodic,
        "op12_merkle": op12_merkle,
        "op13_packing": op13_packing,
        "pieces_nfkc": pieces_nfkc,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_warc": OP4_SQL, "op5_mixing": OP5_SQL, "op9_quality_rules": OP9_SQL.replace("{PHRASES}", quality_rules.phrases()), "op11_periodic": OP11_SQL, "op12_merkle": OP12_SQL}
