"""Claims and references derived from the driver's tables, in Spark and in the same SQL.

The tables hold no quotes, so quotes are cut out of the documents: as they are, in capitals,
with other punctuation, with editorial brackets, with an ellipsis, or scrambled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.functions import text

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SCRAMBLE = ("etaoinsr", "rsniotae")
MISSING = 1_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    kind = F.when(F.col("doc_id") % 3 == 0, "abstract_only").when(F.col("doc_id") % 3 == 1, "full_text_xml").otherwise("summary")
    return d.select(F.concat(F.lit("DOC:"), F.col("doc_id").cast("string")).alias("reference_id"), F.substring_index("text", "\n", 1).alias("title"), F.when(F.col("doc_id") % 11 != 5, F.col("text")).alias("content"), kind.alias("content_type"))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    i, t = F.col("doc_id"), F.col("text")
    s = i.cast("string")
    slice_ = F.substr(t, (1 + (i * 37) % F.greatest(F.length(t) - 120, F.lit(1))).cast("int"), F.lit(120))
    start = F.substring(t, 1, 120)
    quote = (
        F.when(i % 6 == 0, slice_)
        .when(i % 6 == 1, F.translate(slice_, LOWER, UPPER))
        .when(i % 6 == 2, F.replace(slice_, F.lit(" "), F.lit(" -- ")))
        .when(i % 6 == 3, F.replace(start, F.lit(" "), F.lit(" [sic] ")))
        .when(i % 6 == 4, F.concat(F.substring(t, 1, 60), F.lit(" ... "), F.substring(t, 200, 60)))
        .otherwise(F.translate(start, *SCRAMBLE))
    )
    rid = (
        F.when(i % 7 == 1, F.concat(F.lit("doc "), s))
        .when(i % 7 == 2, F.concat(F.lit("doc:"), s))
        .when(i % 7 == 3, F.concat(F.lit("SRA:"), s))
        .when(i % 7 == 4, F.concat(F.lit("DOC:"), (i + MISSING).cast("string")))
        .when(i % 7 == 5, F.concat(F.lit(" DOC: "), s))
        .otherwise(F.concat(F.lit("DOC:"), s))
    )
    title = F.substring_index("text", "\n", 1)
    expected = F.when(i % 4 == 1, title).when(i % 4 == 2, F.concat(title, F.lit(" x"))).when(i % 4 == 3, "")
    return d.select(i.alias("claim_id"), quote.alias("supporting_text"), rid.alias("reference_id"), expected.alias("expected_title"), F.concat(F.lit("docs["), s, F.lit("]")).alias("path"))


REFERENCES_SQL = """refs as (
  select 'DOC:' || doc_id as reference_id, split_part(text, chr(10), 1) as title, case when doc_id % 11 <> 5 then text end as content,
    case doc_id % 3 when 0 then 'abstract_only' when 1 then 'full_text_xml' else 'summary' end as content_type
  from documents)"""
CLAIMS_SQL = f"""cut as (
  select *, substr(text, 1 + (doc_id * 37) % greatest(length(text) - 120, 1), 120) as slice, substr(text, 1, 120) as start, split_part(text, chr(10), 1) as title from documents),
claims as (
  select doc_id as claim_id,
    case doc_id % 6 when 0 then slice when 1 then translate(slice, '{LOWER}', '{UPPER}') when 2 then replace(slice, ' ', ' -- ')
      when 3 then replace(start, ' ', ' [sic] ') when 4 then substr(text, 1, 60) || ' ... ' || substr(text, 200, 60)
      else translate(start, '{SCRAMBLE[0]}', '{SCRAMBLE[1]}') end as supporting_text,
    case doc_id % 7 when 1 then 'doc ' || doc_id when 2 then 'doc:' || doc_id when 3 then 'SRA:' || doc_id
      when 4 then 'DOC:' || (doc_id + {MISSING}) when 5 then ' DOC: ' || doc_id else 'DOC:' || doc_id end as reference_id,
    case doc_id % 4 when 1 then title when 2 then title || ' x' when 3 then '' end as expected_title,
    'docs[' || doc_id || ']' as path
  from cut)"""


def sql_greek(x: str) -> str:
    for upper, lower in zip(text.GREEK_UPPER, text.GREEK_FOLDED, strict=True):
        x = f"replace({x}, '{upper}', '{lower}')"
    for letter, name in zip(text.GREEK_FOLDED, text.GREEK_NAMES, strict=False):
        x = f"replace({x}, '{letter}', '{name}')"
    return x


def sql_norm(x: str) -> str:
    """normalize_text() but for Greek, which the tables don't hold."""
    return rf"trim(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"


def sql_flat(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def sql_parts(x: str) -> str:
    pieces = rf"regexp_extract_all({x}, '(\[[^\n]*?\]|[^\[]+|\[)', 1)"
    kept = f"array_to_string(list_transform({pieces}, lambda b: case when starts_with(b, '[') and ends_with(b, ']') and length(b) > 1 then ' ' else b end), '')"
    return rf"list_filter(list_transform(string_split_regex({kept}, '\.{{2,}}'), lambda p: {sql_flat('p')}), lambda p: p <> '')"


def sql_sentences(x: str) -> str:
    return rf"list_filter(list_transform(string_split_regex(regexp_replace({x}, '\s+', ' ', 'g'), '[.!?] '), lambda s: trim(s)), lambda s: length(s) >= 20)"


def sql_words(x: str) -> str:
    stop = ", ".join(f"'{w}'" for w in text.STOPWORDS)
    tokens = rf"regexp_extract_all(lower({sql_flat(x)}), '[\p{{L}}\p{{N}}_]+')"
    return f"list_distinct(list_filter({tokens}, lambda w: regexp_full_match(w, '[a-z0-9]+') and length(w) > 2 and not list_contains([{stop}], w)))"


def sql_prefix(x: str) -> str:
    return rf"case when regexp_matches(trim({x}), '^https?://') then 'url' when regexp_matches(trim({x}), '^[A-Za-z_]+[:\s]+.+$') then upper(regexp_extract(trim({x}), '^([A-Za-z_]+)[:\s]+(.+)$', 1)) when regexp_matches(trim({x}), '^[0-9]+$') then 'PMID' else 'UNKNOWN' end"


def sql_identifier(x: str) -> str:
    return rf"case when regexp_matches(trim({x}), '^https?://') then trim({x}) when regexp_matches(trim({x}), '^[A-Za-z_]+[:\s]+.+$') then trim(regexp_extract(trim({x}), '^([A-Za-z_]+)[:\s]+(.+)$', 2)) else trim({x}) end"


def sql_fuzzy(threshold: float) -> str:
    """CTEs that search the closest sentence for the rows of `asked` (claim_id, query, content):
    `closest` (claim_id, query, found, score, best_match). They need WITH RECURSIVE.

    `combed` compares the shorter string of each pair with all parts of the longer one: x and y
    are their characters, x in reverse; h and v the strands that cross their rows and columns.
    A step crosses an antidiagonal: strands turn where characters are equal or the one from the
    left is later. `own` then is where a part must begin to lose a column."""
    return f"""flat as (
  select *, lower({sql_flat("query")}) as q_norm, {sql_words("query")} as q_words, lower({sql_flat("content")}) as t_norm from asked),
judged as (
  select *, case when contains(t_norm, q_norm) then 'exact' when len(string_split(q_norm, ' ')) < 5 then 'none' else 'search' end as state from flat),
sentences as (
  select claim_id, q_norm, q_words, unnest({sql_sentences("content")}) as sentence, unnest(range(len({sql_sentences("content")}))) as pos from judged where state = 'search'),
overlapping as (
  select *, lower({sql_flat("sentence")}) as s_norm, 100.0::double * len(list_intersect(q_words, {sql_words("sentence")})) / len(q_words) as overlap from sentences where len(q_words) > 0),
met as (select *, row_number() over () as pair from overlapping where overlap > 0),
pairs as (
  select pair, case when length(q_norm) <= length(s_norm) then q_norm else s_norm end as a, case when length(q_norm) <= length(s_norm) then s_norm else q_norm end as b
  from met where not contains(s_norm, q_norm) and not contains(q_norm, s_norm)
  union all select pair, s_norm, q_norm from met where length(q_norm) = length(s_norm) and q_norm <> s_norm),
spelled as (
  select pair, length(a) as n, length(b) as m, list_reverse(list_transform(string_split(a, ''), lambda c: ord(c))) as x, list_transform(string_split(b, ''), lambda c: ord(c)) as y from pairs),
combed as (
  select pair, n, m, x, y, 0 as d, list_transform(range(n), lambda k: k::int) as h, list_transform(range(m), lambda k: (n + k)::int) as v from spelled
  union all
  select pair, n, m, x, y, d + 1,
    h[1 : n - 1 - d + f] || list_transform(z, lambda t: case when t[1] = t[2] or t[3] > t[4] then t[4] else t[3] end) || h[n - d + l :],
    v[1 : f] || list_transform(z, lambda t: case when t[1] = t[2] or t[3] > t[4] then t[3] else t[4] end) || v[l + 1 :]
  from (
    select *, list_zip(x[n - d + f : n - 1 - d + l], y[f + 1 : l], h[n - d + f : n - 1 - d + l], v[f + 1 : l]) as z
    from (select *, greatest(0, d - n + 1) as f, least(m, d + 1) as l from combed where d < n + m - 1))),
lost as (select pair, n, m, list_transform(v, lambda q: q - n) as own from combed where d = n + m - 1),
shares as (
  select pair, greatest(
    list_max(list_transform(range(m - n + 1), lambda i: (n - len(list_filter(own[i + 1 : i + n], lambda q: q >= i)))::double / n)),
    coalesce(list_max(list_transform(range(1, n), lambda w: (2 * (w - len(list_filter(own[1 : w], lambda q: q >= 0))))::double / (n + w))), 0),
    coalesce(list_max(list_transform(range(1, n), lambda w: (2 * (w - len(list_filter(own, lambda q: q >= m - w))))::double / (n + w))), 0)) as share from lost),
ratios as (select pair, 100.0::double * max(share) as ratio from shares group by 1),
scored as (select met.*, coalesce(ratio, 100.0::double) as ratio, case when overlap >= 50 then coalesce(ratio, 100.0::double) else coalesce(ratio, 100.0::double) * overlap / 50.0::double end as effective from met left join ratios using (pair)),
bests as (
  select claim_id, arg_min(struct_pack(ratio := ratio, sentence := sentence), pos) filter (where ratio >= 95 and overlap >= 50) as first,
    first(struct_pack(effective := effective, overlap := overlap, sentence := sentence) order by effective desc, pos) as top
  from scored where effective > 0 group by 1),
closest as (
  select claim_id, query, state = 'exact' or first is not null or coalesce(top.effective >= {threshold} and top.overlap >= 50, false) as found,
    case when state = 'exact' then 100.0::double when first is not null then first.ratio else coalesce(top.effective, 0.0::double) end as score,
    case when state = 'exact' then query when first is not null then first.sentence else top.sentence end as best_match
  from judged left join bests using (claim_id))"""
