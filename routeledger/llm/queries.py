"""Registered queries of the corpus operators, over the whole tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (bottomk, digest_index, langid, license_scan, maxscore, packing, pii, positional_index, quality, secret_scan,
               shallot, token_store, whitening)
from .common import ship_package, table, work_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, sf_dir)
    QUERIES[fn.__name__] = run
    return fn


@register
def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "token-store")
    token_store.write_store(table(spark, sf_dir, "documents"), path)
    return token_store.read_store(spark, path, ids=False)


@register
def op3_digest_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_index.exact_duplicates(table(spark, sf_dir, "documents"))


SQL["op3_digest_dedup"] = r"""
with n as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents),
     g as (select text_sha256, min(doc_id) as keep_id, count(*) as group_size from n group by text_sha256)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from n join g using (text_sha256)
"""


@register
def op4_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@register
def op5_positional_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positional_index.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


SQL["op5_positional_decontamination"] = r"""
with words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as ws from documents),
items as (
  select cast(item_id as varchar) as item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as ws from benchmark),
wins as (
  select distinct item, least(13, len(ws)) as size, array_to_string(list_slice(ws, k, k + least(13, len(ws)) - 1), ' ') as win
  from (select item, ws, unnest(generate_series(1, len(ws) - least(13, len(ws)) + 1)) as k from items where len(ws) > 0)),
sizes as (select distinct size from wins),
places as (
  select doc_id, size, k, array_to_string(list_slice(ws, k, k + size - 1), ' ') as win
  from (select doc_id, ws, size, unnest(generate_series(1, len(ws) - size + 1)) as k from words, sizes where len(ws) >= size)),
found as (select p.doc_id, p.size, p.k, w.item from places p join wins w on p.win = w.win and p.size = w.size),
hit as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(generate_series(k, k + size - 1)) as j from found) group by doc_id),
named as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as names from (select distinct doc_id, item from found) group by doc_id)
select doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
from words left join hit using (doc_id) left join named using (doc_id)
"""


@register
def op6_bottomk_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bottomk.near_duplicates(table(spark, sf_dir, "documents"))


SQL["op6_bottomk_near_dedup"] = r"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda w: w <> '') as ws from documents),
sets as (
  select distinct doc_id, md5(array_to_string(list_slice(ws, k, k + 4), ' ')) as g
  from (select doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, least(len(ws), 1)))) as k from words)),
sizes as (select doc_id, count(*) as n from sets group by doc_id),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as c from sets a join sets b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
ways as (select a, b from links union all select b, a from links),
reach as (select doc_id, doc_id as root from documents union select ways.b, reach.root from reach join ways on ways.a = reach.doc_id),
named as (select doc_id, min(root) as component_id from reach group by doc_id)
select d.doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, component_id, d.doc_id = component_id as kept
from documents d join named using (doc_id) left join sizes using (doc_id)
"""


@register
def op7_neighbour_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


@register
def op8_marginal_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


@register
def op9_dice_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licenses(table(spark, sf_dir, "documents"))


SQL["op9_dice_licenses"] = license_scan.oracle_sql()


@register
def op10_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


@register
def op2_layered_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(table(spark, sf_dir, "documents"))


@register
def op11_lanczos_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


@register
def op12_shallot_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shallot.clusters(table(spark, sf_dir, "embeddings")).drop("second_cluster")


def _clusters_sql(k: int = shallot.CENTROIDS, rounds: int = shallot.ROUNDS) -> str:
    nearest = lambda c: f"""  -- nearest centroid, ties to the smaller number
a{c} as (select r, arg_min(c, (dist, c)) as c, min(dist) as dist from (
  select v.r, m.c, sum((v.x - m.x) * (v.x - m.x)) as dist from v join m{c} m on v.d = m.d group by v.r, m.c) group by r),
"""
    moved = lambda c: f"""
m{c + 1} as (select m.c, m.d, coalesce(n.x, m.x) as x from m{c} m left join (
  select a.c, v.d, cast((sum(v.x) - ((sum(v.x) % count(*)) + count(*)) % count(*)) // count(*) as bigint) as x
  from a{c} a join v on v.r = a.r group by a.c, v.d) n on n.c = m.c and n.d = m.d),
"""
    return f"""
with kept as (
  select row_number() over () as r, vec_id, embedding as e from embeddings
  where len(embedding) = {shallot.SIZE} and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
v as (select r, vec_id, d, cast(floor({shallot.SCALE} * cast(e[d] as double)) as bigint) as x from (select r, vec_id, e, unnest(generate_series(1, {shallot.SIZE})) as d from kept)),
seeds as (select r, row_number() over (order by sha256('2:' || cast(vec_id as varchar)), r) - 1 as c from kept),
m0 as (select c, d, x from seeds join v using (r) where c < {k}),
""" + "".join(nearest(c) + moved(c) for c in range(rounds)) + nearest(rounds) + f"""
named as (select c, sha256(string_agg(cast(x as varchar), ',' order by d)) as centroid_sha256 from m{rounds} group by c),
spread as (select c, sum(dist) as s from a{rounds} group by c)
select k.vec_id, cast(a.c as integer) as cluster, cast(a.dist as bigint) as distance, cast(s.s as bigint) as cluster_inertia,
       cast((select sum(dist) from a{rounds}) as bigint) as inertia, n.centroid_sha256
from kept k join a{rounds} a using (r) join spread s on s.c = a.c join named n on n.c = a.c
"""


SQL["op12_shallot_clusters"] = _clusters_sql()


@register
def op13_maxscore_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.top_k(table(spark, sf_dir, "embeddings"))


SQL["op13_maxscore_top_k"] = f"""
with kept as (
  select row_number() over () as r, vec_id, embedding as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
v as (select r, vec_id, d, cast(floor({maxscore.SCALE} * cast(e[d] as double)) as bigint) as x from (select r, vec_id, e, unnest(generate_series(1, len(e))) as d from kept)),
scored as (
  select q.r, o.r as other, q.vec_id as query_id, o.vec_id, sum(q.x * o.x) as score
  from v q join v o on q.d = o.d and q.r <> o.r where q.vec_id % {maxscore.EVERY} = 0 group by q.r, o.r, q.vec_id, o.vec_id),
ranked as (select *, row_number() over (partition by r order by score desc, vec_id nulls last) as rank from scored)
select query_id, cast(rank as integer) as rank, vec_id, cast(score as bigint) as score from ranked where rank <= {maxscore.TOP}
"""
