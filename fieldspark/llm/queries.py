"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.llm import bpe, centroids, conversations, exact_dedup, language_id, line_dedup, near_dedup, packing, pii, quality_knn, quality_rules, sharding, toxicity
from fieldspark.llm._spark import documents


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(documents(spark, sf_dir)).drop("rejected_by")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(documents(spark, sf_dir))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's text without duplicate lines."""
    return line_dedup.without_duplicate_lines(documents(spark, sf_dir)).select("doc_id", "text", "n_chars")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir), k=4, percent=80)


def op9_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_knn.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(documents(spark, sf_dir))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))[0]


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


QUERIES = {
    f.__name__: f
    for f in (op1_quality_rules, op2_pii, op3_language_id, op4_byte_bpe, op5_exact_dedup, op6_line_dedup, op7_best_fit_packing, op8_near_dedup, op9_quality_knn, op10_sharding, op11_toxicity, op12_centroid_clustering, op13_conversation_repair)
}

_WS = r"[\x20\x09-\x0D]"
_WORDS = rf"list_filter(string_split_regex(coalesce(text, ''), '{_WS}+'), lambda x: x <> '')"

#: Nearest centroid of table {0}, by all distances.
_ASSIGN = """select r, arg_min(c, (d, c)) as c, min(d) as d from (
  select r, c, list_sum(list_transform(list_zip(kept.v, z.v), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::bigint as d from kept cross join {0} z) group by r"""


def _round(i: int) -> str:
    """SQL of centroids i + 1 from i."""
    return f"""a{i} as materialized ({_ASSIGN.format(f"c{i}")}),
means as materialized (select c, list(m order by p) as v from (select c, p, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) as m
  from (select c, unnest(v) as x, unnest(range(64)) as p from a{i} join kept using (r)) group by c, p) group by c),
c{i + 1} as materialized (select c{i}.c, coalesce(means.v, c{i}.v) as v from c{i} left join means using (c)),
""".replace("means", f"m{i}")


ORACLE_SQL = {
    "op1_quality_rules": rf"""
with w as (select row_number() over () as r, doc_id, coalesce(text, '') as t, {_WORDS} as w from documents),
lines as (select r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from w),
windows as (select r, i, array_to_string(w[i : i + 4], ' ') as g from (select r, w, unnest(range(1, len(w) - 3)) as i from w where len(w) > 5)),
twice as (select r, i, lead(i) over (partition by r order by i) as n from (select *, count(*) over (partition by r, g) as c from windows) where c > 1),
covered as (select r, sum(least(5, coalesce(n - i, 5))) as n_repeat_words from twice group by r),
f as (select w.doc_id, t, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols, len(l)::bigint as n_lines,
    (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words
  from w join lines using (r) left join covered using (r)),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from f)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or n_symbols * 20 > word_chars or n_dup_lines * 2 > n_lines or word_chars < n_words * 2 or word_chars > n_words * 20
    or length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) * 2 > length(regexp_replace(t, '[^\p{{L}}]+', '', 'g'))
    or length(regexp_replace(t, '[^\p{{L}}]+', '', 'g')) * 2 < word_chars
    or length(regexp_replace(t, '[^!]+', '', 'g')) * 5 > n_words) as kept
from b""",
    "op5_exact_dedup": rf"""
with t as (select doc_id, coalesce(text, '') as t, regexp_replace(coalesce(text, ''), '{_WS}+', '', 'g') as s from documents),
g as (select s, count(*) as group_size, min({{'p': -length(t), 'z': doc_id is null, 'd': doc_id}}) as f from t group by s)
select doc_id, f.d as keep_id, group_size, doc_id is not distinct from f.d and length(t) = -f.p as kept, sha256(s) as text_sha256 from t join g using (s)""",
    "op12_centroid_clustering": f"""
with recursive kept as materialized (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = 64),
c0 as materialized (select (row_number() over (order by sha256('3:' || vec_id), v) - 1)::int as c, v from kept order by sha256('3:' || vec_id), v limit 8),
{"".join(_round(i) for i in range(10))}
final as materialized ({_ASSIGN.format("c10")}),
sums as (select c, sum(d) as s from final group by c),
digests as (select c, sha256(array_to_string(v, ',')) as h from c10)
select vec_id, c as cluster, d as distance, s::bigint as cluster_inertia, (select sum(s) from sums)::bigint as inertia, h as centroid_sha256
from final join kept using (r) join sums using (c) join digests using (c)""",
    "op13_conversation_repair": rf"""
with recursive tab as (select list(x order by i) as t from (select i, list_reduce([i] || range(8), lambda c, s: if(c & 1 = 1, xor(c >> 1, 3988292384), c >> 1)) as x from range(256) as r(i))),
src as materialized (select row_number() over () as r, conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
  coalesce(conv_id::text, ' ') || ':' || coalesce(turn::text, ' ') as name from conversations),
hit as (select src.*, xor(list_reduce([4294967295] || list_transform(string_split(name, ''), lambda x: ascii(x)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 as f from src, tab),
dam as materialized (select conv_id, turn, if(f = 4, 'user', role) as role, case f when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from hit, range(2) as n(k) where f <> 0 and (k = 0 or f = 3)),
o as materialized (select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text)) as i, left(role, 1) as ini from dam),
nth as (select *, row_number() over (partition by conv_id, role, text order by i) as nth from o),
flt as materialized (select *, case when not regexp_matches(text, '[^ 	-
]') then 'b' when nth > 1 then 'd' when not regexp_matches(text, '[.!?][ 	-
]*\z') then 't' else '' end as fault,
  lag(ini) over (partition by conv_id order by i) as was from nth),
facts as materialized (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) filter (fault = 'b') as blank, count(*) filter (fault = 'd') as duplicate,
  count(*) filter (fault = 't') as truncated, count(*) filter (i > 1 and was || ini not in ('su', 'ua', 'au')) as illegal, count(*) as n from flt group by conv_id),
ins as (from (values (0,0,0), (0,2,1), (0,3,2), (1,1,0), (1,2,1), (1,3,2), (2,2,0), (2,3,1), (3,3,0), (3,2,1)) as x(p, q, j)),
arc as (from (values (0,'s',1), (0,'u',2), (1,'u',2), (3,'u',2), (2,'a',3)) as x(p, ch, q)),
way as materialized (
  select conv_id, i, p, p as q, 3 as cost, 'D' as e from flt, range(4) as s(p)
  union all select conv_id, i, p, q, (fault = 't')::int, 'K' from flt join arc on ini = ch where fault not in ('b', 'd')
  union all select conv_id, i, p, q, 2 + (fault = 't')::int, 'R' from flt, arc where ch <> 's' and fault not in ('b', 'd')),
step as materialized (select conv_id, i, a.p as p, b.q as q, min({{'c': cost + 2 * (a.j + b.j), 'a': repeat('I', a.j) || e || repeat('I', b.j)}}) as m
  from way join ins a on a.q = way.p join ins b on b.p = way.q group by all),
run as (
  select conv_id, i, q, m from step where i = 1 and p = 0
  union all
  select x.conv_id, x.i + 1, s.q, min({{'c': x.m.c + s.m.c, 'a': x.m.a || s.m.a}}) from run x join step s on s.conv_id is not distinct from x.conv_id and s.i = x.i + 1 and s.p = x.q group by x.conv_id, x.i, s.q),
best as materialized (select facts.conv_id, min(m) as m from facts join run on run.conv_id is not distinct from facts.conv_id and i = n where q in (0, 3) group by all),
ch as (select conv_id, p, substr(m.a, p, 1) as e, count(*) filter (substr(m.a, p, 1) <> 'I') over (partition by conv_id order by p) as i from (select *, unnest(range(1, length(m.a) + 1)) as p from best)),
kept as (select ch.*, role, text, ini, row_number() over (partition by ch.conv_id order by p) as z from ch left join flt on e <> 'I' and flt.conv_id is not distinct from ch.conv_id and flt.i = ch.i where e <> 'D'),
heads as (select *, coalesce(max((e = 'K' and ini = 's')::int) over (partition by conv_id), 0) as s from kept),
lines as (select conv_id, string_agg(case when e = 'K' then role when (z - s) % 2 = 1 then 'user' else 'assistant' end || ':' || if(e = 'I', '', text), chr(10) order by p) as b from heads group by conv_id)
select c.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  coalesce(m.c, 0)::bigint as cost, coalesce(m.a, '') as audit, sha256(coalesce(b, '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join facts on facts.conv_id is not distinct from c.conv_id left join best on best.conv_id is not distinct from c.conv_id left join lines on lines.conv_id is not distinct from c.conv_id""",
}
