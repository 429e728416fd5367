"""Queries over files that are written and read back, over reports, levels and suggestions."""

from __future__ import annotations

import uuid
from pathlib import Path
from urllib.parse import unquote, urlparse

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.functions import text
from claimlens.operators import extract, fulltext, report
from claimlens.operators.validate import suggested_fix
from claimlens.plans import derived as d
from claimlens.plans.stage import shared_dir
from claimlens.sources import cache, custom, payloads, store

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    """Register a query under its function's name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return put


@query("""
with d as (select *, doc_id % 6 as k, '  DOC:' || doc_id || case when doc_id % 2 = 0 then ' at docs[' || doc_id || ']' else '' end || ':' as head from documents),
acts as (
  select doc_id, case k when 1 then 1 when 5 then 1 when 2 then 2 when 3 then 3 else 4 end as part, case k when 3 then 1 else 0 end as ord,
    case when k = 3 then [head, '    Similarity: ' || doc_id % 50 || '%', '    Snippet: ''' || substr(text, 1, 60) || '...''']
      when k in (1, 5) then [head, '    done', '    ''' || substr(text, 1, 50) || '...'' → ''' || substr(replace(text, 'e', 'E'), 1, 50) || '...''']
      when k = 2 then [head, '    done', '    Suggestion: ''' || substr(replace(text, 'e', 'E'), 1, 80) || '...'''] else [head, '    done'] end as lines
  from d where k > 0),
sizes as (select part, count(*) as size from acts group by 1),
lists as (
  select part, 1 as place, doc_id as claim_id, ord, lines from acts
  union all select part, 0, null, 0, [['HIGH CONFIDENCE FIXES (auto-applicable):', 'SUGGESTED FIXES (review recommended):', 'RECOMMENDED REMOVALS (low confidence):', 'UNVERIFIABLE (no abstract available):'][part]] from sizes
  union all select part, 2, null, 0, [''] from sizes
  union all select 0, 0, null, 0, [repeat('=', 60), 'Repair Report', repeat('=', 60), '']
  union all select 9, 0, null, 0, [repeat('-', 60), 'Summary:', '  Total items: ' || count(*), '  Already valid: ' || count_if(k = 0), '  Auto-fixes: ' || count_if(k in (1, 5)), '  Suggestions: ' || count_if(k = 2), '  Removals: ' || count_if(k = 3), '  Unverifiable: ' || count_if(k = 4)] from d)
select part::int as part, place::int as place, claim_id, ord::int as ord, (unnest(range(len(lines))))::int as n, unnest(lines) as line from lists
""")
def repair_report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report over a repair of each document, as a table of lines."""
    i, t = F.col("doc_id"), F.col("text")
    k, null, s = i % 6, F.lit(None).cast("string"), F.col("doc_id").cast("string")

    def action(kind, repaired, confidence, score, fix):
        return F.struct(F.lit(kind).alias("action_type"), t.alias("original_text"), repaired.alias("repaired_text"), F.lit(confidence).alias("confidence"), score.alias("similarity_score"), F.lit("done").alias("description"), null.alias("reference_id"), F.lit(fix).alias("can_auto_fix"))

    up, low = F.replace(t, F.lit("e"), F.lit("E")), (i % 50).cast("double") / 100
    removal = F.array(action("FUZZY_CORRECTION", up, "LOW", low, False), action("REMOVAL", null, "VERY_LOW", low, False))
    actions = (
        F.when(k == 1, F.array(action("CHARACTER_NORMALIZATION", up, "HIGH", F.lit(1.0), True)))
        .when(k == 5, F.array(action("FUZZY_CORRECTION", up, "HIGH", F.lit(0.96), True)))
        .when(k == 2, F.array(action("ELLIPSIS_INSERTION", up, "MEDIUM", F.lit(0.85), False)))
        .when(k == 3, removal)
        .when(k == 4, F.array(action("UNVERIFIABLE", null, "VERY_LOW", F.lit(0.0), False)))
        .otherwise(F.slice(removal, 1, 0))
    )
    results = d.table(spark, sf_dir, "documents").select(i.alias("claim_id"), F.concat(F.lit("DOC:"), s).alias("reference_id"), (k == 0).alias("was_valid"), k.isin(1, 2, 5).alias("is_repaired"), actions.alias("actions"), F.when(i % 2 == 0, F.concat(F.lit("docs["), s, F.lit("]"))).alias("path"))
    return report.report_lines(results, verbose=True)


@query(r"""
with f as (select lang, string_split_regex(string_agg(text, chr(10) order by doc_id), '\r\n|\r|\n') as lines from documents group by 1)
select lang, unnest(range(1, len(lines) + 1)) as line_number, md5(unnest(lines)) as line_md5 from f
""")
def text_file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, written as a text for each language, in files of ranges of documents, and
    read back by line."""
    folder = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    name = F.coalesce(F.concat(F.lit("x"), F.hex("lang")), F.lit("none"))  # any language as a folder's name
    docs = d.table(spark, sf_dir, "documents").where("text is not null").select(name.alias("lang"), "doc_id", F.col("text").alias("value"))
    order = "lang", F.asc_nulls_last("doc_id")
    docs.repartitionByRange(*order).sortWithinPartitions(*order).select("lang", "value").write.partitionBy("lang").text(folder)
    lines = extract.text_lines(spark, folder, F.regexp_extract("file", "lang=([^/]*)/", 1))
    lang = F.when(F.col("file") != "none", F.unhex(F.substr("file", F.lit(2))).cast("string"))
    return lines.select(lang.alias("lang"), "line_number", F.md5("line").alias("line_md5"))


@query("""
select doc_id || '.yaml' as file, '[' || k || '].evidence[' || j || ']' as path, case when j = 0 then text else 'q' end as supporting_text,
  'DOC:' || doc_id || '/' || k as reference_id, case when k = 1 then 'T' end as expected_title
from documents, range(2) a(k), range(2) b(j)
""")
def yaml_evidence_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as quotes in YAML files of two instances, walked by names."""
    s, quoted = F.col("doc_id").cast("string"), F.to_json(F.struct("text"))
    quoted = F.substr(quoted, F.lit(9), F.length(quoted) - 9)  # a JSON string is a YAML string

    def instance(k):
        rid = F.concat(F.lit("'DOC:"), s, F.lit(f"/{k}'"))
        title = ", title: T" if k else ""
        return F.concat(F.lit("- evidence:\n  - supporting_text: "), quoted, F.lit("\n    reference: {id: "), rid, F.lit(title + "}\n  - {snippet: q, reference_id: "), rid, F.lit(title + "}\n"))

    files = d.table(spark, sf_dir, "documents").select(F.concat(s, F.lit(".yaml")).alias("file"), F.concat(instance(0), instance(1)).alias("value"))
    return extract.nested_claims(files)


@query("""
select 'SUP:' || s_suppkey as reference_id, s_name as title, case when s_suppkey % 3 = 0 then [s_address] else [s_name, s_phone] end as authors,
  case when s_suppkey % 2 = 0 then s_comment else 'Legacy ' || s_comment end as content, case when s_suppkey % 2 = 0 then 'summary' else 'abstract_only' end as content_type,
  case when s_suppkey % 4 = 0 then 'f' || s_suppkey || '.csv' end as file, case when s_suppkey % 4 = 0 then s_suppkey end as size_bytes
from (select s_suppkey, s_name, 'N' || s_nationkey as s_address, 'K' || s_suppkey as s_phone, 'of nation ' || s_nationkey || ', named "' || s_name || '": 5 \\ 6' as s_comment from supplier)
""")
def cache_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reference for each supplier in a folder of cache files: new ones with supplementary
    files and single authors as scalars, legacy ones, and for some both, of which the new counts."""
    folder = f"{shared_dir(spark)}/cache-{uuid.uuid4().hex}"
    s = d.table(spark, sf_dir, "supplier")
    key, nation, name = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string"), F.col("s_name")
    place, phone = F.concat(F.lit("N"), nation), F.concat(F.lit("K"), key)
    comment = F.concat(F.lit("of nation "), nation, F.lit(', named "'), name, F.lit('": 5 \\ 6'))
    one = F.col("s_suppkey") % 3 == 0
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    authors = F.when(one, F.concat(F.lit("authors: "), quoted(place))).otherwise(F.concat(F.lit("authors:\n- "), quoted(name), F.lit("\n- "), quoted(phone)))
    extra = F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit("\nsupplementary_files:\n- filename: f"), key, F.lit(".csv\n  size_bytes: "), key)).otherwise("")
    md = F.concat(F.lit("---\nreference_id: SUP:"), key, F.lit("\ntitle: "), quoted(name), F.lit("\n"), authors, F.lit("\ncontent_type: summary"), extra, F.lit("\n---\n# "), name, F.lit("\n\n## Content\n\n"), comment, F.lit("\n"))
    listed = F.when(one, place).otherwise(F.concat(name, F.lit(", "), phone))
    txt = F.concat(F.lit("ID: SUP:"), key, F.lit("\nTitle: "), name, F.lit("\nAuthors: "), listed, F.lit("\nContentType: abstract_only\n\nLegacy "), comment, F.lit("\n"))
    even = F.col("s_suppkey") % 2 == 0
    both = s.select(F.concat(F.lit("SUP_"), key, F.lit(".md")).alias("file"), md.alias("value"), even.alias("kept")).unionByName(s.select(F.concat(F.lit("SUP_"), key, F.lit(".txt")).alias("file"), txt.alias("value"), (~even | (F.col("s_suppkey") % 8 == 0)).alias("kept")))
    files = both.where("kept").select("file", "value")
    cache.write_folder(files, folder)
    r = cache.read_cache(spark, folder)
    first = F.get("supplementary_files", F.lit(0))
    return r.select("reference_id", "title", "authors", "content", "content_type", first["filename"].alias("file"), first["size_bytes"].cast("long").alias("size_bytes"))


@query("select event_id, case when event_id % 6 < 2 then 'WARN' when event_id % 6 = 2 then 'INFO' else 'ERROR' end as severity from events")
def severity_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 6
    said = F.when(k == 0, "warning").when(k == 1, "WARN").when(k == 2, "Info").when(k == 3, "ERROR").when(k == 4, F.col("event_type"))
    return d.table(spark, sf_dir, "events").select("event_id", text.severity(said).alias("severity"))


@query("""
with s as (select *, (doc_id % 101)::double as score, case when doc_id % 3 = 0 then replace(text, 'e', 'E') when doc_id % 3 = 1 then text || '!' end as best from documents)
select doc_id, md5(case when best is null or score <= 70 then null when score > 90 and lower(text) = lower(best) then 'Capitalization differs - try: "' || best || '"'
  when score > 90 then 'Very close match (' || (doc_id % 101) || '%) - try: "' || best || '"' else 'Partial match found (' || (doc_id % 101) || '%): "' || best || '"' end) as fix_md5 from s
""")
def suggested_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, t = F.col("doc_id"), F.col("text")
    best = F.when(i % 3 == 0, F.replace(t, F.lit("e"), F.lit("E"))).when(i % 3 == 1, F.concat(t, F.lit("!")))
    return d.table(spark, sf_dir, "documents").select("doc_id", F.md5(suggested_fix(t, best, (i % 101).cast("double"))).alias("fix_md5"))


def _written(spark: SparkSession, files: dict[str, str]) -> str:
    """A new folder in the shared one with these configuration files; its path."""
    folder = Path(unquote(urlparse(shared_dir(spark)).path), f"config-{uuid.uuid4().hex}")
    folder.mkdir(parents=True)
    for name, value in files.items():
        (folder / name).write_text(value, encoding="utf-8")
    return str(folder)


@query("""
with s as (select n_nationkey as k, case when n_nationkey % 5 = 0 then 'v' when n_nationkey % 2 = 0 then 'u' else 't' end as field from nation)
select 'N' || k || ':' || doc_id as reference_id, field || doc_id as title, md5(text) as content_md5, case when k % 5 > 0 and k % 2 = 0 then 'abstract_only' else 'summary' end as content_type
from documents join s on doc_id % 27 = k
""")
def configured_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source for each nation, declared in files of a folder: of those of one prefix the later
    file counts, and the main configuration before all; payloads of no source give no record."""
    nations = sorted(r[0] for r in d.table(spark, sf_dir, "nation").select("n_nationkey").collect())  # configuration, which is the driver's
    plain = {f"N{n}": {"fields": {"title": "$.t", "content": "$.x"}} for n in nations}
    later = [{"prefix": f"N{n}", "fields": {"title": "$.u", "content": "$.x"}, "content_type": "abstract_only"} for n in nations if n % 2 == 0]
    folder = _written(spark, {"b.yaml": yaml.safe_dump(later), "a.yml": yaml.safe_dump({"sources": plain}), "no.txt": "sources: {N1: {fields: {title: $.no}}}"})
    main = {"sources": {f"N{n}": {"fields": {"title": "$.v", "content": "$.x"}} for n in nations if n % 5 == 0}}
    sources = custom.load_custom_sources([folder], main)
    i, s = F.col("doc_id"), F.col("doc_id").cast("string")
    prefix = F.concat(F.lit("N"), (i % 27).cast("string"))
    body = F.to_json(F.struct(*[F.concat(F.lit(c), s).alias(c) for c in "tuv"], F.col("text").alias("x")))
    landed = d.table(spark, sf_dir, "documents").select(F.concat(prefix, F.lit(":"), s).alias("reference_id"), prefix.alias("source"), body.alias("body"))
    return payloads.parse_json_api(landed, sources).select("reference_id", "title", F.md5("content").alias("content_md5"), "content_type")


@query("""
select 'D:' || doc_id as reference_id, provider, case provider when 'one' then 'https://new/10.1/' || doc_id else 'https://two/' || doc_id || '/x' end as url
from documents, (values ('one'), ('two')) p(provider) where provider = 'one' or doc_id % 4 > 0
""")
def configured_providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to ask of providers declared in files: the later file's of one name, and none that
    lacks a template or a field."""
    first = {"providers": {"one": {"url_template": "https://old/{doi}", "text_field": "$.t"}, "two": {"url_template": "https://two/{pmid}/x", "location_field": "$.l"}, "none": {"url_template": "https://none/{doi}"}}}
    second = {"providers": {"one": {"url_template": "https://new/{doi}", "location_field": "$.l"}}}
    folder = _written(spark, {"first.yaml": yaml.safe_dump(first), "second.yaml": yaml.safe_dump(second)})
    providers = custom.load_providers([f"{folder}/first.yaml", f"{folder}/second.yaml"])
    i, s = F.col("doc_id"), F.col("doc_id").cast("string")
    who = d.table(spark, sf_dir, "documents").select(F.concat(F.lit("D:"), s).alias("reference_id"), F.concat(F.lit("10.1/"), s).alias("doi"), F.when(i % 4 > 0, s).alias("pmid"), F.lit(None).cast("string").alias("pmcid"))
    return fulltext.declared_requests(who, providers)


@query("""
select 'DOC:' || doc_id as reference_id, md5(case when doc_id % 10 = 0 then text || ' newer' when doc_id % 10 = 1 then 'added ' || doc_id else text end) as content_md5 from documents
""")
def store_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store in buckets of nine tenths of the documents, and an update of two tenths, of which
    some come twice: the later version counts."""
    i, s = F.col("doc_id"), F.col("doc_id").cast("string")
    docs = d.table(spark, sf_dir, "documents").select(i, F.concat(F.lit("DOC:"), s).alias("reference_id"), F.col("text").alias("content"), F.lit(0).alias("version"))
    path = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    store.write_store(docs.where("doc_id % 10 <> 1").drop("doc_id"), path, 16)
    newer = docs.where("doc_id % 10 = 0").select("reference_id", F.concat("content", F.lit(" newer")).alias("content"), F.lit(2).alias("version"))
    added = docs.where("doc_id % 10 = 1").select("reference_id", F.concat(F.lit("added "), s).alias("content"), F.lit(1).alias("version"))
    between = newer.withColumns({"content": F.lit("zzz"), "version": F.lit(1)})
    store.update_store(spark, path, newer.unionByName(added).unionByName(between), 16, "version")
    return store.read_store(spark, path).select("reference_id", F.md5("content").alias("content_md5"))
