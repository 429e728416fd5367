"""One query per operator over the driver's tables, whole, and its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.functions import fields, ids, jsonpath, text
from claimlens.operators import extract, fulltext, report
from claimlens.operators.containment import passage_containment as containment
from claimlens.operators.fuzzy_search import fuzzy_search
from claimlens.operators.repair import repair
from claimlens.operators.repair import ellipsis_insertion as insertion
from claimlens.operators.validate import failures, validate
from claimlens.operators.validate import validate_title as titles
from claimlens.plans import derived as d
from claimlens.plans.config import ValidationConfig
from claimlens.plans.lifecycle import unresolved
from claimlens.sources.formats import html_text_col
from claimlens.sources.formats import html_title as title_of

SKIPPING = ValidationConfig(skip_prefixes=("SRA",), unknown_prefix_severity="WARN")
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


# Scalar functions


_GREEK = "concat(text, ' α-catenin ΔNp63 ς-Factor ½ x_y')"


@query(f"select doc_id, {d.sql_norm(d.sql_greek(_GREEK))} as norm from documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = d.table(spark, sf_dir, "documents")
    return t.select("doc_id", text.normalize_text(F.concat("text", F.lit(" α-catenin ΔNp63 ς-Factor ½ x_y"))).alias("norm"))


@query(f"with {d.CLAIMS_SQL} select claim_id, array_to_string({d.sql_parts('supporting_text')}, '|') as parts, len({d.sql_parts('supporting_text')}) as n from claims")
def split_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = d.claims(spark, sf_dir).select("claim_id", text.split_query(F.col("supporting_text")).alias("p"))
    return p.select("claim_id", F.array_join("p", "|").alias("parts"), F.size("p").alias("n"))


@query(f"select doc_id, len({d.sql_sentences('text')}) as n, array_to_string({d.sql_sentences('text')}, '|') as sentences from documents")
def split_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = d.table(spark, sf_dir, "documents").select("doc_id", text.split_sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").alias("n"), F.array_join("s", "|").alias("sentences"))


@query(
    f"""with {d.REFERENCES_SQL}, {d.CLAIMS_SQL},
w as (select claim_id, {d.sql_words("supporting_text")} as q, {d.sql_words("content")} as t
  from claims join refs on 'DOC:' || claim_id = refs.reference_id where content is not null)
select claim_id, len(q) as n_query, len(t) as n_target, case when len(q) = 0 then 0.0::double else 100.0::double * len(list_intersect(q, t)) / len(q) end as overlap from w"""
)
def word_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = d.references(spark, sf_dir).where("content is not null").select(F.substring("reference_id", 5, 20).cast("long").alias("claim_id"), text.significant_words(F.col("content")).alias("t"))
    q = d.claims(spark, sf_dir).select("claim_id", text.significant_words(F.col("supporting_text")).alias("q"))
    return q.join(r, "claim_id").select("claim_id", F.size("q").alias("n_query"), F.size("t").alias("n_target"), text.overlap_of_words(F.col("q"), F.col("t")).alias("overlap"))


@query("select doc_id, replace(replace(replace(replace(replace(replace(text || ' +/- 5 +-1 H2O2 CO2 N2', '+/-', '±'), '+-', '±'), 'CO2', 'CO₂'), 'H2O', 'H₂O'), 'O2', 'O₂'), 'N2', 'N₂') as mapped from documents")
def character_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = d.table(spark, sf_dir, "documents")
    return t.select("doc_id", text.character_mapping(F.concat("text", F.lit(" +/- 5 +-1 H2O2 CO2 N2"))).alias("mapped"))


@query("select case when doc_id % 101 >= 95 then 'HIGH' when doc_id % 101 >= 80 then 'MEDIUM' when doc_id % 101 >= 50 then 'LOW' else 'VERY_LOW' end as confidence, count(*) as n from documents group by 1")
def confidence_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = d.table(spark, sf_dir, "documents")
    return t.groupBy(text.confidence((F.col("doc_id") % 101) / 100).alias("confidence")).agg(F.count("*").alias("n"))


@query(r"select doc_id, list_filter(list_transform(string_split_regex(text, '[.!?]\s+'), lambda p: trim(p)), lambda p: p <> '') as f from documents".replace("select doc_id, list", "select doc_id, array_to_string(list").replace(" as f from", ", '|') as fragments from"))
def split_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = d.table(spark, sf_dir, "documents")
    return t.select("doc_id", F.array_join(text.split_fragments(F.col("text")), "|").alias("fragments"))


# Identifiers


@query(
    f"""with {d.CLAIMS_SQL}, p as (select claim_id, {d.sql_prefix("reference_id")} as prefix, {d.sql_identifier("reference_id")} as identifier,
  case when contains(reference_id, ':') then upper(split_part(reference_id, ':', 1)) else '' end as skip_prefix from claims)
select claim_id, prefix, identifier, case when prefix = 'UNKNOWN' then identifier else prefix || ':' || identifier end as normal, skip_prefix from p"""
)
def parse_reference_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = d.claims(spark, sf_dir).select("claim_id", ids.parse_reference_id(F.col("reference_id")).alias("p"), ids.normalize_reference_id(F.col("reference_id")).alias("normal"), ids.skip_prefix(F.col("reference_id")).alias("skip_prefix"))
    return c.select("claim_id", "p.prefix", "p.identifier", "normal", "skip_prefix")


@query(f"with {d.CLAIMS_SQL} select claim_id, translate(reference_id, ':/?=', '____') || '.md' as file from claims")
def cache_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.claims(spark, sf_dir).select("claim_id", ids.cache_name(F.col("reference_id")).alias("file"))


_ROUTED = "case doc_id % 10 when 0 then doc_id::varchar when 1 then 'pmid ' || doc_id when 2 then 'DOI:10.1/' || doc_id when 3 then 'PPR' || doc_id when 4 then 'https://x.org/' || doc_id when 5 then 'GSE' || doc_id when 6 then 'PRJNA' || doc_id when 7 then 'SAMN' || doc_id when 8 then 'NCT' || lpad(doc_id::varchar, 8, '0') else 'odd-' || doc_id end"


@query(f"select doc_id, {_ROUTED} as reference_id, case doc_id % 10 when 0 then 'PMID' when 1 then 'PMID' when 2 then 'DOI' when 3 then 'PPR' when 4 then 'url' when 5 then 'GEO' when 6 then 'BIOPROJECT' when 7 then 'BIOSAMPLE' when 8 then 'clinicaltrials' end as source from documents")
def route_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, s = F.col("doc_id") % 10, F.col("doc_id").cast("string")
    forms = [s, F.concat(F.lit("pmid "), s), F.concat(F.lit("DOI:10.1/"), s), F.concat(F.lit("PPR"), s), F.concat(F.lit("https://x.org/"), s), F.concat(F.lit("GSE"), s), F.concat(F.lit("PRJNA"), s), F.concat(F.lit("SAMN"), s), F.concat(F.lit("NCT"), F.lpad(s, 8, "0"))]
    rid = F.concat(F.lit("odd-"), s)
    for k, form in enumerate(forms):
        rid = F.when(i == k, form).otherwise(rid)
    t = d.table(spark, sf_dir, "documents").select("doc_id", rid.alias("reference_id"))
    return t.select("doc_id", "reference_id", ids.source_of(F.col("reference_id")).alias("source"))


# Validation


def _validation_sql(unknown: str, skip: str | None) -> str:
    skipped = f"upper(split_part(c.reference_id, ':', 1)) = '{skip}' and contains(c.reference_id, ':')" if skip else "false"
    return f"""{d.REFERENCES_SQL}, {d.CLAIMS_SQL},
norms as (select reference_id as ref_key, title as ref_title, content_type, coalesce(content, '') <> '' as has_content, {d.sql_norm("coalesce(content, '')")} as content_norm, {d.sql_norm("title")} as title_norm from refs),
k as (select c.*, {skipped} as skipped, {d.sql_prefix("c.reference_id")} || ':' || {d.sql_identifier("c.reference_id")} as ref_key, {d.sql_parts("supporting_text")} as parts from claims c),
j as (select k.*, n.ref_title, n.content_type, n.has_content, n.title_norm, n.ref_key is not null as known,
    list_filter(parts, lambda p: not contains(n.content_norm, {d.sql_norm("p")})) as missing
  from k left join norms n on k.ref_key = n.ref_key and not skipped),
v as (select *, not skipped and known and has_content as compared, not skipped and known and has_content and len(parts) > 0 and len(missing) = 0 as found,
    not (coalesce(expected_title, '') <> '' and coalesce(ref_title, '') <> '') or {d.sql_norm("expected_title")} = title_norm as title_ok from j),
results as (select claim_id, skipped or (found and title_ok) as is_valid, reference_id, supporting_text,
    case when skipped or (found and title_ok) then 'INFO' when not known and not skipped then '{unknown}' else 'ERROR' end as severity,
    case when skipped then 'Skipping validation for reference with prefix ''' || upper(split_part(reference_id, ':', 1)) || ''': ' || reference_id
      when not known then 'Could not fetch reference: ' || reference_id
      when not has_content then 'No content available for reference: ' || reference_id
      when not title_ok or not found then
        case when not title_ok then 'Title mismatch: expected ''' || expected_title || ''' but got ''' || ref_title || ''''
          when len(parts) = 0 then 'Query is empty after removing brackets and splitting' else 'Text part not found as substring: ''' || missing[1] || '''' end
        || case when not found and content_type = 'abstract_only' then ' (note: only abstract available for ' || reference_id || ', full text may contain this excerpt)' else '' end
      else 'Supporting text validated successfully in ' || reference_id || case when coalesce(expected_title, '') <> '' then ', title validated' else '' end end as message,
    case when compared then found end as found, case when found then array_to_string(parts, ' ... ') end as matched_text, path from v)"""


_VALIDATED = f"with {_validation_sql('ERROR', None)} select * from results"
_SKIPPED = f"with {_validation_sql('WARN', 'SRA')}"


def _flat(results: DataFrame) -> DataFrame:
    return results.select("claim_id", "is_valid", "reference_id", "supporting_text", "severity", "message", "match.found", "match.matched_text", "path")


@query(_VALIDATED)
def validate_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(validate(d.claims(spark, sf_dir), d.references(spark, sf_dir), suggest=False))


@query(f"{_VALIDATED} union all select * from results where claim_id % 5 = 0")
def repeated_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims whose id and all else repeat, with suggestions: a result for each row, no more."""
    c = d.claims(spark, sf_dir)
    return _flat(validate(c.unionByName(c.where("claim_id % 5 = 0")), d.references(spark, sf_dir)))


@query(
    f"""with {_validation_sql("ERROR", None)}, one(ref) as (select 'DOC:' || min(doc_id) from documents where doc_id % 11 <> 5),
t as (select content_norm from norms, one where ref_key = ref),
parted as (select claim_id, list_transform(parts, lambda p: {d.sql_norm("p")}) as parts from k)
select claim_id, len(parts) > 0 and len(list_filter(parts, lambda p: not contains(content_norm, p))) = 0 as is_valid from parted, t"""
)
def quotes_of_one_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All quotes held against one document: their parts are searched in one pass over its text."""
    one = d.table(spark, sf_dir, "documents").where("doc_id % 11 <> 5").agg(F.min("doc_id")).first()[0]
    c = d.claims(spark, sf_dir).withColumns({"reference_id": F.lit(f"DOC:{one}"), "expected_title": F.lit(None).cast("string")})
    return validate(c, d.references(spark, sf_dir), suggest=False, many=16).select("claim_id", "is_valid")


@query(f"{_SKIPPED} select claim_id, is_valid, severity, message from results")
def skip_and_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate(d.claims(spark, sf_dir), d.references(spark, sf_dir), SKIPPING, suggest=False).select("claim_id", "is_valid", "severity", "message")


@query(
    f"""with {d.REFERENCES_SQL}, {d.CLAIMS_SQL}, j as (select c.*, r.title, r.reference_id is not null as known, {d.sql_norm("expected_title")} = {d.sql_norm("r.title")} as equal
  from claims c left join refs r on {d.sql_prefix("c.reference_id")} || ':' || {d.sql_identifier("c.reference_id")} = r.reference_id where expected_title <> '')
select claim_id, reference_id, path, known and title <> '' and equal as is_valid, case when known and title <> '' and equal then 'INFO' else 'ERROR' end as severity,
  case when not known then 'Could not fetch reference: ' || reference_id when title = '' then 'Reference ' || reference_id || ' has no title to validate against'
    when equal then 'Title validated successfully for ' || reference_id
    else 'Title mismatch for ' || reference_id || ': expected ''' || expected_title || ''' but got ''' || title || '''' end as message from j"""
)
def validate_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titles(d.claims(spark, sf_dir).where("expected_title <> ''"), d.references(spark, sf_dir))


@query(f"{_SKIPPED} select count(*) as total_validations, count(*) filter (where is_valid) as valid_count, count(*) filter (where not is_valid) as invalid_count, count(*) filter (where severity = 'ERROR') as error_count, count(*) filter (where severity = 'WARN') as warning_count, count_if(severity = 'ERROR') = 0 as is_valid from results")
def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.validation_report(validate(d.claims(spark, sf_dir), d.references(spark, sf_dir), SKIPPING, suggest=False))


@query(f"{_SKIPPED} select 'reference_validation' as type, severity, message, supporting_text as instance, reference_id as instantiates, path from results where not is_valid")
def finding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return failures(validate(d.claims(spark, sf_dir), d.references(spark, sf_dir), SKIPPING, suggest=False))


@query(f"{_SKIPPED} select lang as file, count(*) filter (where not is_valid) as results from results join documents on doc_id = claim_id group by 1")
def files_with_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = validate(d.claims(spark, sf_dir), d.references(spark, sf_dir), SKIPPING, suggest=False)
    files = d.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("claim_id"), F.col("lang").alias("file"))
    return report.files_report(results.where("not is_valid").join(files, "claim_id"), files)


@query(
    f"""with {d.REFERENCES_SQL}, {d.CLAIMS_SQL}, n as (select distinct {d.sql_prefix("reference_id")} || ':' || {d.sql_identifier("reference_id")} as reference_id from claims where not (contains(reference_id, ':') and upper(split_part(reference_id, ':', 1)) = 'SRA'))
select n.reference_id, null::varchar as source from n anti join refs using (reference_id)"""
)
def fetch_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unresolved(d.claims(spark, sf_dir), d.references(spark, sf_dir), SKIPPING)


@query(f"select item_id as quote_id, doc_id from benchmark b join documents d on contains({d.sql_norm('d.text')}, {d.sql_norm('b.text')})")
def passage_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotes = d.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), "text")
    return containment(quotes, d.table(spark, sf_dir, "documents"))


# Search and repair


@query(
    f"""with recursive {d.REFERENCES_SQL}, {d.CLAIMS_SQL},
asked as (select claim_id, supporting_text as query, content from claims join refs on 'DOC:' || claim_id = refs.reference_id where content is not null),
{d.sql_fuzzy(70.0)} select claim_id, query, found, score, best_match from closest"""
)
def fuzzy_best_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = d.claims(spark, sf_dir).select("claim_id", F.col("supporting_text").alias("query"), F.concat(F.lit("DOC:"), F.col("claim_id").cast("string")).alias("ref_key"))
    contents = d.references(spark, sf_dir).where("content is not null").select(F.col("reference_id").alias("ref_key"), "content")
    return fuzzy_search(q, contents, threshold=70.0)


@query(
    f"""with recursive {_validation_sql("WARN", "SRA")},
asked as (select claim_id, supporting_text as query, content from v join refs r on v.ref_key = r.reference_id where compared and not v.found and len(parts) > 0),
{d.sql_fuzzy(70.0)}
select s.claim_id, s.is_valid, s.severity, s.message, case when s.found then 1.0::double when not s.found then coalesce(score, 0.0::double) / 100 end as similarity_score, best_match,
  case when best_match is not null and score > 70 then case when score > 90 and lower(query) = lower(best_match) then 'Capitalization differs - try: "' || best_match || '"'
    when score > 90 then 'Very close match (' || round_even(score, 0)::int || '%) - try: "' || best_match || '"' else 'Partial match found (' || round_even(score, 0)::int || '%): "' || best_match || '"' end end as suggested_fix
from results s left join closest c using (claim_id)"""
)
def validate_with_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate(d.claims(spark, sf_dir), d.references(spark, sf_dir), SKIPPING).select("claim_id", "is_valid", "severity", "message", "match.similarity_score", "match.suggested_fix", "match.best_match")


@query()
def repair_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(d.claims(spark, sf_dir), d.references(spark, sf_dir), validation=SKIPPING)


_FRAGMENTS = r"list_filter(list_transform(string_split_regex(query, '[.!?]\s+'), lambda p: trim(p)), lambda p: p <> '')"
_DECIDED = f"""with recursive {_validation_sql("WARN", "SRA")},
checked as (select v.*, content, skipped or (v.found and title_ok) as was_valid from v left join refs r on v.ref_key = r.reference_id and not skipped),
failed as (select claim_id, supporting_text as query, content, {d.sql_norm("content")} as whole, lower({d.sql_flat("content")}) as t from checked where not was_valid),
cut_up as (
  select *, {_FRAGMENTS} as fr from failed where content is not null and not contains(query, '...') and not contains(t, lower({d.sql_flat("query")}))),
fragments as (select claim_id, content, t, len(fr) as n, unnest(fr) as fragment, unnest(range(len(fr))) as ord from cut_up where len(fr) >= 2),
stood as (select *, instr(t, lower({d.sql_flat("fragment")})) as pos, length({d.sql_flat("fragment")}) as long from fragments),
asked as (
  select 'whole' || claim_id as claim_id, query, content from failed where content is not null
  union all select claim_id || '/' || ord, fragment, content from stood where pos = 0),
{d.sql_fuzzy(90.0)},
placed as (
  select s.claim_id, ord, fragment, n, case when c.found then instr(t, lower({d.sql_flat("best_match")})) else pos end as pos, case when c.found then length({d.sql_flat("best_match")}) else long end as long
  from stood s left join closest c on c.claim_id = s.claim_id || '/' || ord),
gaps as (select *, pos - lag(pos + long) over (partition by claim_id order by pos, ord) as gap from placed where pos > 0),
joined as (select claim_id, string_agg(fragment, ' ... ' order by pos, ord) as spaced from gaps group by 1 having count(*) = max(n) and max(gap) > 50),
inserted as (select claim_id, spaced from joined join failed using (claim_id) where len(list_filter({d.sql_parts("spaced")}, lambda p: not contains(whole, {d.sql_norm("p")}))) = 0),
known as (
  select f.claim_id, content is null as lost, spaced, coalesce(score, 0.0::double) as score, best_match, round_even(score, 0)::int || '%)' as percent
  from failed f left join inserted using (claim_id) left join closest c on c.claim_id = 'whole' || f.claim_id),
levels as (
  select *, case when score / 100 >= 0.95 then 'HIGH' when score / 100 >= 0.8 then 'MEDIUM' when score / 100 >= 0.5 then 'LOW' else 'VERY_LOW' end as level,
    best_match is null or score / 100 < 0.5 as removed from known),
decided as (
  select claim_id,
    case when lost then 'UNVERIFIABLE VERY_LOW' when spaced is not null then 'ELLIPSIS_INSERTION MEDIUM' when level in ('HIGH', 'MEDIUM') and best_match is not null then 'FUZZY_CORRECTION ' || level
      else concat_ws(', ', case when best_match is not null then 'FUZZY_CORRECTION ' || level end, case when removed then 'REMOVAL VERY_LOW' end) end as actions,
    case when lost then null when spaced is not null then spaced when level in ('HIGH', 'MEDIUM') then best_match end as repaired_text,
    not lost and (spaced is not null or (best_match is not null and level = 'HIGH')) as is_repaired,
    case when lost then 'Reference content not available - cannot verify' when spaced is not null then 'Fixed via ellipsis insertion'
      when level in ('HIGH', 'MEDIUM') and best_match is not null then 'Suggested fix via fuzzy matching (' || percent when removed then 'Flagged for removal - text not found in reference' else 'Could not find a suitable repair' end as message,
    case when lost or spaced is not null or best_match is null then null when score >= 95 then 'Very close match (' || percent when score >= 80 then 'Close match (' || percent else 'Partial match (' || percent end as closeness
  from levels)
select c.claim_id, was_valid, coalesce(is_repaired, false) as is_repaired, repaired_text, coalesce(actions, '') as actions, coalesce(message, 'Already valid') as message, closeness from checked c left join decided using (claim_id)"""


@query(_DECIDED)
def repair_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repair of each claim: its actions by type and confidence, in order, and how close the closest sentence is."""
    r = repair(d.claims(spark, sf_dir), d.references(spark, sf_dir), validation=SKIPPING)
    said = F.array_join(F.transform("actions", lambda a: F.concat(a["action_type"], F.lit(" "), a["confidence"])), ", ")
    close = F.get(F.filter("actions", lambda a: a["action_type"] == "FUZZY_CORRECTION"), 0)["description"]
    return r.select("claim_id", "was_valid", "is_repaired", "repaired_text", said.alias("actions"), "message", close.alias("closeness"))


_PAIRED = f"select doc_id, text, {d.sql_sentences('text')} as s from documents"


@query(
    rf"""with s as ({_PAIRED}), q as (select doc_id as claim_id, s[1] || '. ' || s[5] as query, lower({d.sql_flat("text")}) as t from s where len(s) >= 5),
f as (select *, list_filter(list_transform(string_split_regex(query, '[.!?]\s+'), lambda p: trim(p)), lambda p: p <> '') as fr from q where not contains(query, '...') and not contains(t, lower({d.sql_flat("query")}))),
p as (select claim_id, t, len(fr) as n, unnest(fr) as fragment, unnest(range(len(fr))) as ord from f where len(fr) >= 2),
g as (select *, instr(t, lower({d.sql_flat("fragment")})) as pos, length({d.sql_flat("fragment")}) as len from p),
w as (select *, pos - lag(pos + len) over (partition by claim_id order by pos, ord) as gap from g where pos > 0)
select claim_id, string_agg(fragment, ' ... ' order by pos, ord) as repaired_text from w group by claim_id having count(*) = max(n) and max(gap) > 50"""
)
def ellipsis_insertion(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = d.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("claim_id"), F.col("doc_id").cast("string").alias("ref_key"), "text", text.split_sentences(F.col("text")).alias("s")).where(F.size("s") >= 5)
    queries = s.select("claim_id", F.concat(F.get("s", F.lit(0)), F.lit(". "), F.get("s", F.lit(4))).alias("query"), "ref_key")
    return insertion(queries, s.select("ref_key", F.col("text").alias("content")), fuzzy=False)


# Extraction


_LINES = """lines as (select doc_id, doc_id || ' ex:supporting_text="' || translate(text, '"[]' || chr(10), '') || '[DOC:' || doc_id || ']" ex:supporting_text="two[X:' || doc_id || ']"  ' as line from documents)"""


@query(
    rf"""with {_LINES}, m as (select doc_id, line, unnest(regexp_extract_all(line, 'ex:supporting_text="([^"]*)\[(\S+:\S+)\]"', 1)) as supporting_text, unnest(regexp_extract_all(line, 'ex:supporting_text="([^"]*)\[(\S+:\S+)\]"', 2)) as reference_id from lines)
select doc_id::varchar as file, doc_id as line_number, supporting_text, reference_id, rtrim(line) as original_line from m"""
)
def regex_claim_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("doc_id").cast("string")
    line = F.concat(s, F.lit(' ex:supporting_text="'), F.translate("text", '"[]\n', ""), F.lit("[DOC:"), s, F.lit(']" ex:supporting_text="two[X:'), s, F.lit(']"  '))
    return extract.claims_from_lines(d.table(spark, sf_dir, "documents").select(s.alias("file"), F.col("doc_id").alias("line_number"), line.alias("line")))


@query(
    """with t as (select conv_id, text, row_number() over (partition by conv_id order by turn) - 1 as k from conversations)
select conv_id::varchar as file, 'evidence[' || k || ']' as path, text as supporting_text, 'CONV:' || conv_id as reference_id, 'title ' || conv_id as expected_title from t where text <> ''"""
)
def nested_evidence_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = d.table(spark, sf_dir, "conversations").withColumn("s", F.col("conv_id").cast("string"))
    ref = F.struct(F.concat(F.lit("CONV:"), F.col("s")).alias("id"), F.concat(F.lit("title "), F.col("s")).alias("title"))
    items = F.transform(F.sort_array(F.collect_list(F.struct("turn", F.col("text").alias("supporting_text"), ref.alias("reference")))), lambda x: x.dropFields("turn"))
    files = c.groupBy("s").agg(items.alias("evidence")).select(F.concat("s", F.lit(".json")).alias("file"), F.to_json(F.struct("evidence")).alias("value"))
    return extract.nested_claims(files).withColumn("file", F.replace("file", F.lit(".json"), F.lit("")))


@query("with t as (select conv_id, text, row_number() over (partition by conv_id order by turn) - 1 as k from conversations) select conv_id::varchar as file, 'evidence[' || k || ']' as path, text as supporting_text, 'CONV:' || conv_id as reference_id from t where text <> ''")
def evidence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = d.table(spark, sf_dir, "conversations").withColumn("file", F.col("conv_id").cast("string"))
    item = F.struct("turn", F.col("text").alias("supporting_text"), F.concat(F.lit("CONV:"), F.col("file")).alias("reference_id"))
    return extract.evidence_rows(c.groupBy("file").agg(F.sort_array(F.collect_list(item)).alias("evidence")), "evidence")


_SLOTS = (
    ("c", "quote", 1, ("ex:excerpt",), None), ("c", "supporting_text", 0, (), None), ("c", "cited", 2, (), "dcterms:references"), ("c", "liked", 3, (), "ex:user_preference"), ("c", "seen", 4, (), "ex:hasReference"),
    ("d", "title", 0, (), None), ("d", "name", 1, (), "dcterms:title"), ("d", "exact", 2, ("oa:exact",), "dcterms:title"), ("d", "reference_id", 3, (), None), ("d", "reference", 4, ("ex:reference_excerpt",), None),
    ("e", "supporting_text", 0, (), "dcterms:title"), ("e", "reference_id", 1, ("oa:exact",), None), ("e", "reference", 2, (), None),
)


@query(
    """with t(kind, role, names) as (values ('c', 'excerpt', 'quote,supporting_text'), ('c', 'reference', 'cited,seen'), ('d', 'title', 'name,exact,title'), ('d', 'excerpt', 'exact,reference'), ('d', 'reference', 'reference,reference_id'), ('e', 'excerpt', 'reference_id,supporting_text'), ('e', 'title', 'supporting_text'), ('e', 'reference', 'reference,reference_id'))
select kind || doc_id as class, role, names from documents join t on kind = ['c', 'd', 'e'][doc_id % 3 + 1]"""
)
def field_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A class for each document. Roles are independent of each other; fallback names follow in their own order."""
    kinds = {k: F.array(*[F.struct(F.lit(n).alias("name"), F.lit(o).alias("ord"), F.array(*[F.lit(i) for i in im]).cast("array<string>").alias("implements"), F.lit(u).cast("string").alias("slot_uri")) for c, n, o, im, u in _SLOTS if c == k]) for k in "cde"}
    k = F.col("doc_id") % 3
    kind = F.when(k == 0, "c").when(k == 1, "d").otherwise("e")
    held = F.when(k == 0, kinds["c"]).when(k == 1, kinds["d"]).otherwise(kinds["e"])
    slots = d.table(spark, sf_dir, "documents").select(F.concat(kind, F.col("doc_id").cast("string")).alias("class"), F.inline(held))
    return fields.class_slots(slots).select("class", "role", F.array_join("names", ",").alias("names"))


_EVIDENCE = {"Talk": {"ranges": {"turns": "Turn"}}, "Turn": {"roles": {"excerpt": ["quote"], "reference": ["cited", "reference"], "title": ["title"]}}}


@query(
    """with t as (select *, row_number() over (partition by conv_id order by turn) - 1 as k from conversations),
u as (select *, conv_id || '/' || k as own, 'turns[' || k || '].' as place from t)
select conv_id::varchar as file, place || case when k % 3 = 2 then 'title' else 'quote' end as path, case when k % 3 < 2 then text end as supporting_text,
  case when k % 2 = 0 then 'R:' else 'C:' end || own as reference_id, case when k % 3 = 0 then case when k % 2 = 0 then 'of ' || own end else 'T ' || own end as expected_title, case when k % 3 = 2 then 'title' else 'excerpt' end as kind
from u where k % 3 = 2 or text <> ''"""
)
def typed_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as instances of a class, by schema: with a quote and a reference's own title, with a
    title slot beside them, and with a title alone."""
    c = d.table(spark, sf_dir, "conversations").withColumn("s", F.col("conv_id").cast("string"))
    turns = F.sort_array(F.collect_list(F.struct("turn", "text")))

    def instance(x, k):
        own = F.concat(F.col("s"), F.lit("/"), k.cast("string"))
        ref = F.struct(F.concat(F.lit("R:"), own).alias("id"), F.concat(F.lit("of "), own).alias("title"))
        return F.struct(F.when(k % 3 < 2, x["text"]).alias("quote"), F.when(k % 3 > 0, F.concat(F.lit("T "), own)).alias("title"), F.when(k % 2 == 1, F.concat(F.lit("C:"), own)).alias("cited"), ref.alias("reference"), F.lit("no").alias("other"))

    files = c.groupBy("s").agg(turns.alias("t")).select(F.concat("s", F.lit(".json")).alias("file"), F.to_json(F.struct(F.transform("t", instance).alias("turns"))).alias("value"))
    return extract.nested_claims(files, "Talk", _EVIDENCE).withColumn("file", F.replace("file", F.lit(".json"), F.lit("")))


# Sources and documents


@query(r"select page_id, coalesce(nullif(trim(regexp_extract(html, '(?i)<title[^>]*>([^<]+)</title>', 1)), ''), url) as title from pages")
def html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.table(spark, sf_dir, "pages").select("page_id", title_of(F.col("html"), F.col("url")).alias("title"))


@query()
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.table(spark, sf_dir, "pages").select("page_id", html_text_col(F.col("html")).alias("text"))


@query("select event_id, json_extract_string(props, '$.k') as k, json_extract_string(props, '$.k') as deep, case when json_extract_string(props, '$.k') is not null then '### key' || chr(10) || chr(10) || json_extract_string(props, '$.k') else '' end as block from events")
def jsonpath_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = jsonpath.extra_fields(F.col("props"), {"key": "$.k", "none": "$.x"})
    return d.table(spark, sf_dir, "events").select("event_id", jsonpath.first_match(F.col("props"), "$.k").alias("k"), jsonpath.first_match(F.col("props"), "$..k").alias("deep"), jsonpath.extra_content(extra).alias("block"))


_CANDIDATES = """c as (select 'DOC:' || doc_id as reference_id, p.provider, p.rank, text || repeat(' more text', ((doc_id * p.rank * 7) % 120)::int) as t, (doc_id + p.rank) % 9 = 0 as error
  from documents, (values ('pmc', 1), ('epmc_preprint', 2), ('unpaywall', 3), ('openalex', 4)) p(provider, rank)),
u as (select *, not error and length(trim(t)) >= 500 and (provider <> 'pmc' or length(t) > 1000) as usable from c)"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each provider offers the whole text and an ending of its own; PMC, errors aside, nothing
    up to its own floor."""
    ranks = F.posexplode(F.array(*[F.lit(p) for p in fulltext.PROVIDERS])).alias("r", "provider")
    c = d.table(spark, sf_dir, "documents").select("doc_id", "text", ranks).withColumn("rank", F.col("r") + 1)
    offered = F.concat("text", F.repeat(F.lit(" more text"), (F.col("doc_id") * F.col("rank") * 7 % 120).cast("int")))
    null = F.lit(None).cast("string")
    c = c.select(F.concat(F.lit("DOC:"), F.col("doc_id").cast("string")).alias("reference_id"), "provider", offered.alias("text"), F.concat(F.lit("u"), F.col("rank").cast("string")).alias("url"), F.lit("xml").alias("format"), null.alias("license"), null.alias("oa_status"), ((F.col("doc_id") + F.col("rank")) % 9 == 0).alias("error"))
    return c.where(F.col("error") | (F.col("provider") != "pmc") | (F.length("text") > fulltext.MIN_PMC_TEXT))


@query(f"with {_CANDIDATES}, f as (select *, row_number() over (partition by reference_id order by rank) as n from u where usable) select reference_id, f.provider, length(f.t) as chars, n.usable, n.failed from (select reference_id, count(*) filter (where usable) as usable, bool_or(error) as failed from u group by 1) n left join (select * from f where n = 1) f using (reference_id)")
def fulltext_first_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fulltext.first_usable(_candidates(spark, sf_dir)).select("reference_id", "best.provider", F.length("best.text").alias("chars"), "usable", "failed")


@query(
    f"""with {_CANDIDATES}, f as (select reference_id, min_by(provider, rank) filter (usable) as provider, min_by(t, rank) filter (usable) as t, bool_or(error) as failed from u group by 1),
r as (select 'DOC:' || doc_id as reference_id, doc_id % 3 = 0 as wanted, text as content from documents)
select reference_id, case when wanted and provider is not null then 'full_text_xml' when wanted then 'abstract_only' else 'full_text_html' end as content_type, case when wanted then provider end as full_text_provider,
  wanted and (provider is not null or not failed) as full_text_attempted, md5(case when wanted and provider is not null then concat_ws(chr(10) || chr(10), nullif(trim(content), ''), trim(t)) else content end) as content_md5 from r join f using (reference_id)"""
)
def fulltext_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, null = F.col("doc_id"), F.lit(None).cast("string")
    refs = d.table(spark, sf_dir, "documents").select(F.concat(F.lit("DOC:"), i.cast("string")).alias("reference_id"), F.col("text").alias("content"), F.when(i % 3 == 0, "abstract_only").otherwise("full_text_html").alias("content_type"), null.alias("full_text_provider"), null.alias("full_text_url"), null.alias("oa_status"), null.alias("license"), F.lit(False).alias("full_text_attempted"))
    return fulltext.enrich(refs, _candidates(spark, sf_dir)).select("reference_id", "content_type", "full_text_provider", "full_text_attempted", F.md5("content").alias("content_md5"))


@query("select lang as content_type, count(*) as n from documents where doc_id % 3 = 0 and doc_id % 4 <> 0 group by 1")
def retry_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    refs = d.table(spark, sf_dir, "documents").select("lang", F.when(i % 3 == 0, "summary").otherwise("full_text_pdf").alias("content_type"), F.when(i % 4 == 0, True).when(i % 4 == 1, False).alias("full_text_attempted"))
    return fulltext.full_text_worklist(refs).groupBy(F.col("lang").alias("content_type")).agg(F.count("*").alias("n"))
