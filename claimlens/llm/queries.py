"""The queries of this subpackage's operators, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.llm import bpe_codec
from claimlens.llm.chat_windows import chat_windows, read_back
from claimlens.llm.decontaminate import benchmark_hits
from claimlens.llm.embedding_neardup import embedding_neardup
from claimlens.llm.hard_negatives import hard_negatives
from claimlens.llm.html_lines import html_lines
from claimlens.llm.mix_sources import mix_sources
from claimlens.llm.ngram_join import ngram_join
from claimlens.llm.pii_bootstrap import pii_spans
from claimlens.llm.quality_classifier import quality_classifier
from claimlens.llm.token_alignment import align_tokens
from claimlens.llm.token_histogram import token_histogram
from claimlens.llm.url_filter import rule_table, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(_table(spark, sf_dir, "documents"))


def op2_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_spans(_table(spark, sf_dir, "documents")).drop("items")


def op3_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_neardup(_table(spark, sf_dir, "embeddings"))


def op4_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(chat_windows(turns.unionByName(own)))


def op5_html_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_lines(_table(spark, sf_dir, "pages"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_histogram(_table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(_table(spark, sf_dir, "pages"), rule_table(spark))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = F.when(F.expr("vec_id % 7 = 0"), (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(_table(spark, sf_dir, "embeddings").withColumn("label", labelled))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = align_tokens(_table(spark, sf_dir, "documents"))
    return aligned.withColumn("groups_sha256", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))).drop("groups")


def op13_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe_codec.encode_and_decode(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {f.__name__: f for f in (op1_ngram_join, op2_pii_bootstrap, op3_embedding_neardup, op4_chat_windows, op5_html_lines, op6_decontaminate, op7_token_histogram, op8_quality_classifier, op9_url_filter, op10_mix_sources, op11_hard_negatives, op12_token_alignment, op13_bpe_codec)}

_OP1 = """
with recursive words as (
  select doc_id, list_filter(string_split_regex(lower(text), '[\\s\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+'), lambda x: x <> '') as w from documents),
grams as (
  select doc_id, unnest(list_distinct(case when len(w) = 0 then ['']
    else [array_to_string(w[i : i + 4], ' ') for i in range(1, greatest(len(w) - 4, 1) + 1)] end)) as g from words),
sizes as (select doc_id, count(*) as n from grams group by 1),
pairs as (
  select a.doc_id as x, b.doc_id as y, count(*) as c
  from grams a join grams b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
links as (
  select x, y from pairs join sizes s on x = s.doc_id join sizes t on y = t.doc_id
  where 5 * c >= 4 * (s.n + t.n - c)),
edges as (select x, y from links union all select y, x from links),
reach(x, y) as (select doc_id, doc_id from documents union select r.x, b.y from reach r join edges b on r.y = b.x),
classes as (select x as doc_id, min(y) as class_id from reach group by 1),
degree as (select x as doc_id, count(*) as n_links from edges group by 1)
select doc_id, class_id, coalesce(n_links, 0) as n_links, doc_id = class_id as kept
from classes left join degree using (doc_id)
"""

_OP3 = """
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings),
u as (
  select vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as n from v
  where label is not null and e is not null and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0),
links as (
  select a.vec_id as x, b.vec_id as y from u a join u b on a.label = b.label and len(a.e) = len(b.e) and a.vec_id < b.vec_id
  where a.n > 0 and b.n > 0 and list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98),
edges as (select x, y from links union all select y, x from links),
reach(x, y) as (select vec_id, vec_id from embeddings union select r.x, b.y from reach r join edges b on r.y = b.x),
classes as (select x as vec_id, min(y) as component_id from reach group by 1),
degree as (select x as vec_id, count(*) as n_links from edges group by 1)
select vec_id, coalesce(n_links, 0) as n_links, component_id, vec_id = component_id as kept
from classes left join degree using (vec_id)
"""

_OP9 = r"""
with p as (
  select page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path
  from pages),
rules(verdict, h, p) as (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
best as (
  select host, path, arg_max(h || p, length(h || p)) as rule, arg_max(verdict, length(h || p)) as verdict
  from (select distinct host, path from p) q join rules r on (host = h or ends_with(host, '.' || h)) and starts_with(path, r.p)
  group by 1, 2)
select page_id, p.host, p.path, rule, coalesce(verdict, 'allow') as verdict
from p left join best on p.host = best.host and p.path = best.path
"""

_OP4 = r"""
with own as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
marks as (
  select *, length(replace(replace(replace(replace(role, '\', '\b'), '<', '\l'), '>', '\g'), chr(10), '\n'))
    + length(replace(replace(replace(text, '\', '\b'), '<', '\l'), '>', '\g')) + 6 as chars from own),
turns as (
  select *, ceil(chars / 4)::bigint as tokens, row_number() over w as pos, sum(ceil(chars / 4)::bigint) over w as fin,
    first_value(case when lower(role) = 'system' then chars end) over w as sys_chars
  from marks window w as (partition by conv_id order by turn nulls first, role, text rows unbounded preceding)),
cells as (
  select *, fin - tokens as start, greatest(1, 1024 - 192 - coalesce(ceil(sys_chars / 4), 0))::bigint as room from turns),
placed as (
  select *, start // room as cell, min(start) over (partition by conv_id, start // room) as first_start,
    lag(chars, 1) over w as chars1, lag(tokens, 1) over w as tokens1, lag(chars, 2) over w as chars2, lag(tokens, 2) over w as tokens2
  from cells window w as (partition by conv_id order by pos)),
parts as (
  select *, fin > (cell + 1) * room and fin - first_start > room and start > first_start as alone from placed),
wins as (
  select conv_id, cell, alone, min(pos) as first_pos, sum(tokens) as tokens, sum(chars) as chars, max(sys_chars) as sys_chars,
    first(chars1 order by pos) as chars1, first(tokens1 order by pos) as tokens1, first(chars2 order by pos) as chars2, first(tokens2 order by pos) as tokens2
  from parts group by all),
room_left as (
  select *, sys_chars is not null and first_pos > 1 as has_system,
    least(192, 1024 - tokens - case when sys_chars is not null and first_pos > 1 then ceil(sys_chars / 4) else 0 end) as room_left from wins),
nearest as (
  select *, chars1 is not null and not (has_system and first_pos = 2) and tokens1 <= room_left as fits1 from room_left),
both_fit as (
  select *, fits1 and chars2 is not null and not (has_system and first_pos = 3) and tokens1 + tokens2 <= room_left as fits2 from nearest),
lengths as (
  select conv_id, sum(chars + case when has_system then sys_chars else 0 end + case when fits1 then chars1 else 0 end + case when fits2 then chars2 else 0 end)::bigint as formatted_chars
  from both_fit group by 1),
whole as (
  select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by pos)) as turns_sha256,
    coalesce(string_agg(case when lower(role) = 'assistant' then text end, '' order by pos), '') as loss from turns group by 1)
select w.conv_id, n_turns, turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256, formatted_chars
from whole w join lengths l on w.conv_id is not distinct from l.conv_id
"""

_OP10 = r"""
with sized as (
  select doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))::bigint as size,
    md5('17:' || coalesce(doc_id::varchar, '')) as h from documents),
sources as (
  select source, sum(size)::double as n, [5.0, 2.0, 1.0][1 + (row_number() over (order by source nulls last) - 1) % 3]::double as w from sized group by 1),
levels as (
  select *, coalesce(sum(3.0::double * n) over (o rows between unbounded preceding and 1 preceding), 0.0) as capped,
    sum(w) over (o rows between current row and unbounded following) as open_weight
  from sources window o as (order by 3.0::double * n / w, source nulls last)),
level as (
  select arg_min(open_weight, 3.0::double * n / w) filter (3.0::double * n / w >= ((select sum(n) from sources) - capped) / open_weight) as weight,
    arg_min((select sum(n) from sources) - capped, 3.0::double * n / w) filter (3.0::double * n / w >= ((select sum(n) from sources) - capped) / open_weight) as left_over
  from levels),
targets as (
  select source, n::bigint as source_size, n, case when weight is null or 3.0::double * n <= w * (left_over / weight) then 3.0::double * n else w * (left_over / weight) end as target
  from sources, level),
placed as (
  select doc_id, size, source_size, target, target / n as rate, n,
    sum(size) over (partition by s.source order by h, doc_id, size rows unbounded preceding) - size + size / 2 as middle
  from sized s join targets t on s.source is not distinct from t.source)
select doc_id, size, source_size, target, copies * size as taken, copies from (
  select *, (case when n > 0 then floor(rate) + case when rate > floor(rate) and middle <= (rate - floor(rate)) * n then 1 else 0 end else 0 end)::bigint as copies from placed)
"""
_OP11 = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as e
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, list_dot_product(a.e, b.e)::bigint as score
  from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where a.vec_id % 100 = 0),
positives as (
  select anchor_id, id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select p.anchor_id, positive_id, (row_number() over w)::int as rank, id as negative_id, positive_score, score as negative_score
from positives p join scored s on p.anchor_id = s.anchor_id and not same
  and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
window w as (partition by p.anchor_id, positive_id order by score desc, id)
qualify row_number() over w <= 10
"""
ORACLE: dict[str, str] = {"op1_ngram_join": _OP1, "op3_embedding_neardup": _OP3, "op4_chat_windows": _OP4, "op9_url_filter": _OP9, "op10_mix_sources": _OP10, "op11_hard_negatives": _OP11}
