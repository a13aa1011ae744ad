"""The registered queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat_format, embed_dedup, exact_dedup, lang_id, ngram_join, packing, pii, quality, runs, source_divergence, suffix_dedup, toxicity
from .common import held_out, training_half


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _scored(found: DataFrame, most: float, *more: str) -> DataFrame:
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= most).cast("int").alias("predicted"), *more)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return _scored(quality.score(docs, quality.learn(docs, _table(spark, sf_dir, "labels"))), 0.5)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return _scored(toxicity.score(docs, toxicity.learn(docs, _table(spark, sf_dir, "labels"))), 0.7, "spans")


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_dedup(_table(spark, sf_dir, "embeddings"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = lang_id.learn(docs.where(training_half()))
    found = lang_id.predict(docs.select("doc_id", "text"), model)
    return found.select("row.doc_id", held_out("row.doc_id").alias("held_out"), "lang_pred", "score")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_chat_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = chat_format.neighbour_pairs(_table(spark, sf_dir, "conversations"))
    spans = lambda name: F.array_join(F.transform(name, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",").alias(name)
    return chat_format.preferences(pairs).select("pair_id", "n_common", "prompt", "chosen", "rejected", spans("chosen_mask"), spans("rejected_mask"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(_table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.divergence(_table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(_table(spark, sf_dir, "documents"))


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality, op2_embedding_near_dedup, op3_language_id, op4_byte_bpe, op5_chat_preferences, op6_suffix_array_dedup, op7_toxicity, op8_best_fit_packing, op9_exact_dedup, op10_ngram_join, op11_source_divergence, op12_periodic_runs, op13_pii)
}

_TURN = "'<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10)"

ORACLES: dict[str, str] = {
    "op12_periodic_runs": r"""
with o as (
  select row_number() over () as r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
    xor(4294967295, list_reduce(flatten(list_transform(string_split(coalesce(cast(doc_id as varchar), ''), ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1])),
      lambda c, x: case when x >= 0 then xor(c, cast(x as bigint)) else xor(c >> 1, 3988292384 * (c & 1)) end, cast(4294967295 as bigint))) as h
  from documents
), a as (
  select *, len(w) as n, h // 10 as g, case when h % 10 = 0 and len(w) > 0 then (h // 10) % len(w) end as a from o
), b as (
  select *, 1 + (n - a) // (3 + g % 8) as p from a
), d as (
  select r, doc_id, n, case when a is null then w else list_transform(range(n), lambda i: w[1 + case when i < a then i else a + (i - a) % p end]) end as w from b
), x as (
  select r, unnest(w) as word, generate_subscripts(w, 1) - 1 as i from d
), e as (
  select x.r, y.i - x.i as q, x.i as i from x join x y on x.r = y.r and x.word = y.word and x.i < y.i
), f as (
  select r, q, i, i - row_number() over (partition by r, q order by i) as k from e
), s as (
  select r, min(i) as start, count(*) + q as length, q as period from f group by r, q, k having count(*) >= greatest(q, 12 - q)
), t as (
  select r, start, length, min(period) as period from s group by r, start, length
), u as (
  select r, count(*) as n_runs, arg_max({'start': start, 'length': length, 'period': period}, [length, -start, -period]) as top,
    string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as listed
  from t group by r
), z as (
  select distinct r, unnest(range(start + period, start + length)) as i from t
), k as (
  select x.r, string_agg(x.word, ' ' order by x.i) as kept from x anti join z on z.r = x.r and z.i = x.i group by x.r
)
select d.doc_id, coalesce(u.n_runs, 0) as n_runs, u.top.start as start, u.top.length as length, u.top.period as period,
  1000 * u.top.length // u.top.period as exponent_milli, sha256(coalesce(u.listed, '')) as runs_sha256, sha256(coalesce(k.kept, '')) as collapsed_sha256
from d left join u on u.r = d.r left join k on k.r = d.r
""",
    "op11_source_divergence": r"""
with d as (
  select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as body
  from documents
), t as (
  select r, lang, source, unnest(regexp_extract_all(body, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d
), k as (
  select lang, term from t group by lang, term having count(distinct r) >= 10
), g as (
  select distinct lang, source from d
), c as (
  select lang, source, term, count(*) as n from t group by lang, source, term
), x as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n
  from g join k on g.lang = k.lang left join c on c.lang = g.lang and c.source = g.source and c.term = k.term
), y as (
  select lang, source, term, n, sum(n) over (partition by lang, source) as total, count(*) over (partition by lang, source) as v,
    sum(n) over (partition by lang, term) as lang_n, sum(n) over (partition by lang) as lang_total
  from x
), s as (
  select lang, source, term, n, cast(1 + cast(1000000000 as hugeint) * (n + 2) // (total + 2 * v) as bigint) as p,
    cast(1 + cast(1000000000 as hugeint) * (lang_n + 2) // (lang_total + 2 * v) as bigint) as q
  from y
), f as (
  select a.lang, a.source, b.source as item, cast(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as bigint) as value
  from s a join s b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3
), pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(f.value, 0) as value
  from g a join g b on a.lang = b.lang and a.source <> b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source
), terms as (
  select lang, source, 'term' as part, term as item, (p - q) * (p - q) // (p + q) as value from s where n > 0 and p > q
)
select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) as rank from (select * from pairs union all select * from terms)
qualify part = 'pair' or row_number() over (partition by lang, source, part order by value desc, item) <= 10
""",
    "op2_embedding_near_dedup": """
with recursive x as (
  select vec_id, label, list_transform(embedding, lambda v: cast(v as double)) as v from embeddings
), v as (
  select vec_id, label, v, sqrt(list_dot_product(v, v)) as norm from x
  where label is not null and v is not null and len(v) > 0 and len(list_filter(v, lambda c: c is null or not isfinite(c))) = 0
), e as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and len(a.v) = len(b.v) and a.vec_id <> b.vec_id
  where a.norm > 0 and b.norm > 0 and list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.98
), r(id, root) as (
  select vec_id, vec_id from embeddings
  union
  select e.b, r.root from r join e on e.a = r.id
), c as (
  select id, min(root) as root from r group by id
)
select x.vec_id, (select count(*) from e where e.a = x.vec_id) as n_links, c.root as component_id, c.root = x.vec_id as kept
from x join c on c.id = x.vec_id
""",
    "op5_chat_preferences": f"""
with t as (
  select conv_id // 2 as pair_id, conv_id % 2 as odd, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn, coalesce(role, ''), coalesce(text, '')) as k
  from conversations where conv_id is not null
), p as (
  select distinct pair_id from t
), j as (
  select coalesce(a.pair_id, b.pair_id) as pair_id, coalesce(a.k, b.k) as k,
    coalesce(a.role = b.role and a.text = b.text, false) as same
  from (select * from t where odd = 0) a full join (select * from t where odd = 1) b on a.pair_id = b.pair_id and a.k = b.k
), n as (
  select pair_id, coalesce(min(case when not same then k end) - 1, max(k)) as n_common from j group by pair_id
), u as (
  select t.*, n_common, t.k <= n_common as shared, {_TURN} as body,
    sum(case when t.k > n_common then length({_TURN}) else 0 end) over (partition by t.pair_id, odd order by t.k) as upto
  from t join n on t.pair_id = n.pair_id
), v as (
  select *, upto - length('<|im_end|>' || chr(10)) as e, upto - length('<|im_end|>' || chr(10)) - length(text) as s from u
)
select p.pair_id, cast(max(n_common) as integer) as n_common,
  coalesce(string_agg(body, '' order by k) filter (where odd = 0 and shared), '') as prompt,
  coalesce(string_agg(body, '' order by k) filter (where odd = 0 and not shared), '') as chosen,
  coalesce(string_agg(body, '' order by k) filter (where odd = 1 and not shared), '') as rejected,
  coalesce(string_agg(cast(s as varchar) || '-' || cast(e as varchar), ',' order by k) filter (where odd = 0 and not shared and role = 'assistant'), '') as chosen_mask,
  coalesce(string_agg(cast(s as varchar) || '-' || cast(e as varchar), ',' order by k) filter (where odd = 1 and not shared and role = 'assistant'), '') as rejected_mask
from p join v on v.pair_id = p.pair_id group by p.pair_id
""",
    "op10_ngram_join": r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words
  from documents
), s as (
  select doc_id, list_distinct(case when len(words) = 0 then [] when len(words) < 4 then [array_to_string(words, ' ')]
    else list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) end) as items
  from w
), n as (
  select doc_id, len(items) as n_shingles from s
), u as (
  select doc_id, unnest(list_transform(items, lambda x: hash(x))) as item from s
), f as (
  select item from u group by item having count(*) > 1
), v as (
  select u.* from u semi join f on u.item = f.item
), c as (
  select a.doc_id as a, b.doc_id as b, count(*) as common from v a join v b on a.item = b.item and a.doc_id <> b.doc_id group by 1, 2
), e as (
  select c.a, c.b from c join n x on x.doc_id = c.a join n y on y.doc_id = c.b
  where 100 * common >= 85 * (x.n_shingles + y.n_shingles - common)
), r(id, root) as (
  select doc_id, doc_id from documents
  union
  select e.b, r.root from r join e on e.a = r.id
)
select n.doc_id, n.n_shingles, min(r.root) as component_id from n join r on r.id = n.doc_id group by 1, 2
""",
    "op9_exact_dedup": r"""
with n as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as body from documents
), r as (
  select *, min(doc_id) over (partition by body) as keep_id, count(*) over (partition by body) as group_size,
    row_number() over (partition by body order by doc_id) as k
  from n
)
select doc_id, keep_id, group_size, k = 1 as kept, sha256(body) as text_sha256 from r
""",
}
