"""Queries over sources, providers, caches and repairs, with their SQL.

The tables hold no answers of services, so answers are built from the documents, as JSON, XML
or bytes, and the parsers have to give the documents' values back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.functions import fields, ids
from claimlens.operators import fulltext, report
from claimlens.operators.repair import repair
from claimlens.plans import derived as d
from claimlens.plans import lifecycle
from claimlens.plans.config import RepairConfig, ValidationConfig
from claimlens.sources import cache, formats, payloads

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    """Register a query under its function's name, with its SQL."""

    def put(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return put




def _id() -> Column:
    return F.col("doc_id")


def _s() -> Column:
    return F.col("doc_id").cast("string")


def _title() -> Column:
    return F.substring_index("text", "\n", 1)


_SQL_TITLE = "nullif(trim(split_part(text, chr(10), 1)), '')"
#: What without_markup() leaves of a text without tags or entities.
_SQL_FLAT = d.sql_flat("text")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.table(spark, sf_dir, "documents")


def _prefixed(prefix: str) -> Column:
    return F.concat(F.lit(prefix), _s())


def _payload(df: DataFrame, source: str, body: Column, prefix: str) -> DataFrame:
    return df.select(_prefixed(prefix).alias("reference_id"), F.lit(source).alias("source"), body.alias("body"))


def _named(**columns: Column) -> Column:
    return F.struct(*[c.alias(k) for k, c in columns.items()])


def _parsed(refs: DataFrame, *more: Column) -> DataFrame:
    return refs.select("reference_id", "title", F.array_join("authors", "|").alias("authors"), "journal", "year", "doi", F.md5("content").alias("content_md5"), "content_type", *more)


# Bibliographic services


def _crossref(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = F.array(_named(given=F.concat(F.lit("G"), (_id() % 3).cast("string")), family=F.concat(F.lit("F"), (_id() % 5).cast("string"))), _named(given=F.lit(None).cast("string"), family=F.col("lang")))
    date = _named(**{"date-parts": F.array(F.array((F.lit(2000) + _id() % 20).cast("int"), F.lit(2)))})
    dates = {name: F.when(_id() % 3 == k, date) for k, name in enumerate(("published-print", "created", "issued"))}
    kind = F.when(_id() % 4 == 0, "posted-content").when(_id() % 4 < 3, "journal-article")
    message = _named(title=F.array(_title()), author=people, **{"container-title": F.array(F.col("source"))}, **dates, DOI=_prefixed("10.1/"), type=kind, subtype=F.when(_id() % 4 == 1, "preprint"), subject=F.array("lang", F.lit(" "), F.col("source")), abstract=F.concat(F.lit("<jats:p>"), F.col("text"), F.lit("</jats:p>")))
    return _payload(_docs(spark, sf_dir), "crossref", F.to_json(F.struct(message.alias("message"))), "DOI:10.1/")


@query(
    f"""select 'DOI:10.1/' || doc_id as reference_id, {_SQL_TITLE} as title, 'G' || (doc_id % 3) || ' F' || (doc_id % 5) || '|' || lang as authors, source as journal, (2000 + doc_id % 20)::varchar as year, '10.1/' || doc_id as doi,
  md5({_SQL_FLAT}) as content_md5, 'abstract_only' as content_type, lang || '|' || source as keywords, case when doc_id % 4 < 2 then true when doc_id % 4 = 2 then false end as is_preprint, case when doc_id % 4 < 2 then 'preprint' end as peer_review_status from documents"""
)
def crossref_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(payloads.parse_crossref(_crossref(spark, sf_dir)), F.array_join("keywords", "|").alias("keywords"), F.col("is_preprint"), F.col("peer_review_status"))


def _datacite(spark: SparkSession, sf_dir: str) -> DataFrame:
    described = F.array(_named(description=F.lit("other"), descriptionType=F.lit("Methods")), _named(description=F.col("text"), descriptionType=F.lit("Abstract")))
    a = _named(titles=F.array(_named(title=_title())), creators=F.array(_named(name=F.col("source"), givenName=F.lit("x"), familyName=F.lit("y")), _named(name=F.lit(None).cast("string"), givenName=F.lit("Ada"), familyName=F.col("lang"))), publisher=F.lit("Depot"), publicationYear=(F.lit(1990) + _id() % 30).cast("int"), doi=_prefixed("10.5281/zenodo."), descriptions=described, subjects=F.array(_named(subject=F.col("lang")), _named(subject=F.lit(" "))))
    return _payload(_docs(spark, sf_dir), "datacite", F.to_json(_named(data=_named(attributes=a))), "DOI:10.1/")


@query(
    f"""select 'DOI:10.1/' || doc_id as reference_id, {_SQL_TITLE} as title, case when doc_id % 2 = 0 then 'G' || (doc_id % 3) || ' F' || (doc_id % 5) || '|' || lang else source || '|Ada ' || lang end as authors, case when doc_id % 2 = 0 then source else 'Depot' end as journal,
  (case when doc_id % 2 = 0 then 2000 + doc_id % 20 else 1990 + doc_id % 30 end)::varchar as year, case when doc_id % 2 = 0 then '10.1/' else '10.5281/zenodo.' end || doc_id as doi, md5({_SQL_FLAT}) as content_md5, 'abstract_only' as content_type from documents"""
)
def doi_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DataCite answers where Crossref has none."""
    both = _crossref(spark, sf_dir).where(F.substring("reference_id", 10, 20).cast("long") % 2 == 0).unionByName(_datacite(spark, sf_dir))
    return _parsed(payloads.parse_doi(both))


@query(
    f"""select 'PPR:' || doc_id as reference_id, {_SQL_TITLE} as title, 'Ada B|' || lang as authors, case when doc_id % 2 = 0 then 'Server' else source end as journal, '2021' as year, '10.2/' || doc_id as doi, md5({_SQL_FLAT}) as content_md5, 'abstract_only' as content_type, true as is_preprint
from documents where doc_id % 3 <> 2"""
)
def preprint_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda source, title: _named(source=F.lit(source), title=title, authorString=F.concat(F.lit("Ada B, "), F.col("lang"), F.lit(".")), abstractText=F.concat(F.lit("<h4>"), F.col("text"), F.lit("</h4>")), doi=_prefixed("10.2/"), pubYear=F.lit("2021"), bookOrReportDetails=F.when(_id() % 2 == 0, _named(publisher=F.lit("Server"))), journalTitle=F.col("source"))
    results = F.when(_id() % 3 == 2, F.array(one("MED", F.lit("no")))).otherwise(F.array(one("MED", F.lit("no")), one("PPR", _title()), one("PPR", F.lit("later"))))
    return _parsed(payloads.parse_ppr(_payload(_docs(spark, sf_dir), "PPR", F.to_json(_named(resultList=_named(result=results))), "PPR:")), F.col("is_preprint"))


@query(
    """with s as (select *, ['GEO', 'BIOPROJECT', 'BIOSAMPLE'][1 + doc_id % 3] as kind from documents)
select kind || ':' || doc_id as reference_id, case when doc_id % 2 = 0 then 'T' || doc_id else lang end as title, case kind when 'GEO' then lang || '; ' || source when 'BIOPROJECT' then lang else lang end as content, 'summary' as content_type, kind as source from s"""
)
def entrez_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys in any case, blank ones passed over, lists joined."""
    name = F.when(_id() % 2 == 0, F.concat(F.lit("T"), _s())).otherwise(" ")
    kinds = {
        "GEO": _named(TITLE=name, Description=F.col("lang"), summary=F.array("lang", "source")),
        "BIOPROJECT": _named(project_title=name, Project_Name=F.col("lang"), PROJECT_DESCRIPTION=F.col("lang")),
        "BIOSAMPLE": _named(Title=name, Description=F.col("lang")),
    }
    docs, rows = _docs(spark, sf_dir), None
    for k, (kind, body) in enumerate(kinds.items()):
        part = _payload(docs.where(_id() % 3 == k), kind, F.to_json(body), f"{kind}:")
        rows = part if rows is None else rows.unionByName(part)
    return payloads.parse_summary(rows).select("reference_id", "title", "content", "content_type", F.col("metadata")["source"].alias("source"))


@query("select 'GSE' || doc_id as accession, (doc_id + 200)::varchar as uid from documents where doc_id % 2 = 0")
def accession_uids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.when(_id() % 2 == 0, F.array((_id() + 200).cast("string"), F.lit("9"))).otherwise(F.array().cast("array<string>"))
    return payloads.accession_uids(_payload(_docs(spark, sf_dir), "GEO", F.to_json(_named(esearchresult=_named(idlist=found))), "GSE"))


@query(
    """select 'clinicaltrials:NCT' || doc_id as reference_id, case when doc_id % 2 = 0 then 'Official ' || lang else 'Brief ' || lang end as title, md5(case when doc_id % 3 = 0 then 'details' else nullif(trim(text), '') end) as content_md5, 'summary' as content_type, 'DONE' as status, case when doc_id % 5 > 0 then source end as sponsor from documents"""
)
def trial_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    modules = _named(
        identificationModule=_named(officialTitle=F.when(_id() % 2 == 0, F.concat(F.lit("Official "), F.col("lang"))), briefTitle=F.concat(F.lit("Brief "), F.col("lang"))),
        descriptionModule=_named(briefSummary=F.when(_id() % 3 == 0, " ").otherwise(F.col("text")), detailedDescription=F.lit("details")),
        statusModule=_named(overallStatus=F.lit("DONE")),
        sponsorCollaboratorsModule=_named(leadSponsor=F.when(_id() % 5 > 0, _named(name=F.col("source")))),
    )
    rows = payloads.parse_trials(_payload(_docs(spark, sf_dir), "clinicaltrials", F.to_json(_named(protocolSection=modules)), "clinicaltrials:NCT"))
    return rows.select("reference_id", "title", F.md5("content").alias("content_md5"), "content_type", F.col("metadata")["status"].alias("status"), F.col("metadata")["sponsor"].alias("sponsor"))


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


_STRIPPED = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"


@query(
    f"""select 'PMID:' || doc_id as reference_id, 'On E. coli in ' || lang as title, case when doc_id % 2 = 0 then 'Ada|Bo BB|Group ' || source else 'Ada|Bo BB' end as authors, source as journal, case when doc_id % 3 = 0 then '1998' else '2003' end as year, '10.3/' || doc_id as doi,
  md5('AIM: We use E. coli here.' || chr(10) || chr(10) || {_STRIPPED}) as content_md5, 'abstract_only' as content_type, 'Humans/a, b|Mice' as keywords, 'Review' as publication_types from documents"""
)
def pubmed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markup within texts, authors without initials, groups, sections with and without labels."""
    people = F.concat(F.lit("<Author><LastName>Ada</LastName></Author><Author><LastName>Bo</LastName><Initials>BB</Initials></Author>"), F.when(_id() % 2 == 0, F.concat(F.lit("<Author><CollectiveName>Group "), F.col("source"), F.lit("</CollectiveName></Author>"))).otherwise(""))
    date = F.when(_id() % 3 == 0, "<MedlineDate>1998 Dec-1999 Jan</MedlineDate>").otherwise("<Year>2003</Year>")
    xml = F.concat(
        F.lit("<PubmedArticle><MedlineCitation><Article><ArticleTitle>On <i>E. coli</i> in "), F.col("lang"), F.lit("</ArticleTitle><Journal><Title>"), F.col("source"), F.lit("</Title><JournalIssue><PubDate>"), date,
        F.lit("</PubDate></JournalIssue></Journal><Abstract><AbstractText Label='AIM'>We use <i>E. coli</i> here.</AbstractText><AbstractText> </AbstractText><AbstractText>"), _escaped(F.col("text")), F.lit("</AbstractText></Abstract><AuthorList>"), people,
        F.lit("</AuthorList><PublicationTypeList><PublicationType>Review</PublicationType></PublicationTypeList></Article><MeshHeadingList><MeshHeading><DescriptorName>Humans</DescriptorName><QualifierName>a</QualifierName><QualifierName>b</QualifierName></MeshHeading>"),
        F.lit("<MeshHeading><DescriptorName>Mice</DescriptorName></MeshHeading></MeshHeadingList></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType='pubmed'>1</ArticleId><ArticleId IdType='doi'>10.3/"), _s(), F.lit("</ArticleId></ArticleIdList></PubmedData></PubmedArticle>"),
    )
    return _parsed(payloads.parse_pubmed(_payload(_docs(spark, sf_dir), "PMID", xml, "PMID:")), F.array_join("keywords", "|").alias("keywords"), F.array_join("publication_types", "|").alias("publication_types"))


@query("select 'DOI:' || doc_id as reference_id, doc_id % 3 as files, case when doc_id % 3 > 0 then 'a' || doc_id || '.csv' end as filename, case when doc_id % 3 > 0 then doc_id * 10 end as size_bytes, case when doc_id % 3 > 0 then 'http://z/' || doc_id end as download_url, doc_id::varchar as record from documents")
def repository_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a repository's record; those without a name don't count."""
    file = _named(key=F.concat(F.lit("a"), _s(), F.lit(".csv")), size=_id() * 10, checksum=F.lit("md5:1"), links=_named(self=_prefixed("http://z/")))
    odd = _named(key=F.lit(None).cast("string"), size=F.lit(1).cast("long"), checksum=F.lit("x"), links=_named(self=F.lit("y")))
    files = F.concat(F.array(odd), F.array_repeat(file, (_id() % 3).cast("int")))
    found = payloads.repository_files(_payload(_docs(spark, sf_dir), "zenodo", F.to_json(_named(files=files)), "DOI:"))
    first = F.get("supplementary_files", F.lit(0))
    record = payloads.zenodo_record(F.concat(F.lit("10.5281/Zenodo."), F.substring("reference_id", 5, 20)))
    return found.select("reference_id", F.coalesce(F.size(F.when(F.col("supplementary_files").isNotNull(), F.col("supplementary_files"))), F.lit(0)).cast("long").alias("files"), first["filename"].alias("filename"), first["size_bytes"].alias("size_bytes"), first["download_url"].alias("download_url"), record.alias("record"))


# Declared sources and further fields


_DECLARED = {"my": {"fields": {"title": "$.t", "content": "$.x.c", "doi": "$.ids[0].doi"}, "extra_fields": {"more": "$.x.l", "none": "$.y"}}}


@query(
    f"""select 'my:' || doc_id as reference_id, {_SQL_TITLE} as title, '10.4/' || doc_id as doi, md5(case when doc_id % 2 = 0 then nullif(trim(text), '') || chr(10) || chr(10) else '' end || '### more' || chr(10) || chr(10) || lang || ' ' || source) as content_md5, 'summary' as content_type, lang || ' ' || source as more from documents"""
)
def declared_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source declared by JSON paths of several keys, with extra fields as headed blocks."""
    body = _named(t=_title(), x=_named(c=F.when(_id() % 2 == 0, F.col("text")), l=F.array("lang", F.lit(" "), "source")), ids=F.array(_named(doi=_prefixed("10.4/"))))
    rows = payloads.parse_json_api(_payload(_docs(spark, sf_dir), "my", F.to_json(body), "my:"), _DECLARED)
    return rows.select("reference_id", F.nullif(F.trim("title"), F.lit("")).alias("title"), "doi", F.md5("content").alias("content_md5"), "content_type", F.col("metadata")["more"].alias("more"))


@query(
    """select 'clinicaltrials:' || doc_id as reference_id, case when doc_id % 2 = 0 then 'S' else '' end || chr(10) || chr(10) || '### A' || chr(10) || chr(10) || lang || case when doc_id % 3 = 0 then chr(10) || chr(10) || '### B' || chr(10) || chr(10) || source else '' end as content,
  case when doc_id % 3 = 0 then 'A,B' else 'A' end as captured, 'summary' as content_type from documents"""
)
def extra_field_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extra fields of several sources follow a reference's content, in their order."""
    docs = _docs(spark, sf_dir)
    trial = _named(protocolSection=_named(descriptionModule=_named(briefSummary=F.when(_id() % 2 == 0, "S"), x=F.lit(1))), a=F.col("lang"))
    rows = _payload(docs, "ct", F.to_json(trial), "clinicaltrials:")
    more = _payload(docs.where(_id() % 3 == 0), "other", F.to_json(_named(b=F.array("source"))), "clinicaltrials:")
    refs = payloads.with_extra_fields(payloads.parse_trials(rows), rows.unionByName(more), {"ct": {"A": "$.a"}, "other": {"B": "$.b"}})
    return refs.select("reference_id", "content", F.col("metadata")["extra_fields_captured"].alias("captured"), "content_type")


@query(
    f"""select case doc_id % 2 when 0 then 'DOI:10.1/' || doc_id else 'my:' || doc_id end as reference_id, {_SQL_TITLE} as title, case doc_id % 2 when 0 then '10.1/' else '10.4/' end || doc_id as doi from documents"""
)
def parse_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of registered and declared sources through one call."""
    docs = _docs(spark, sf_dir).where(_id() % 2 == 1)
    body = _named(t=_title(), x=_named(c=F.col("text")), ids=F.array(_named(doi=_prefixed("10.4/"))))
    both = _crossref(spark, sf_dir).where(F.substring("reference_id", 10, 20).cast("long") % 2 == 0).unionByName(_payload(docs, "my", F.to_json(body), "my:"))
    return payloads.parse(both, _DECLARED).select("reference_id", F.nullif(F.trim("title"), F.lit("")).alias("title"), "doi")


# Files and pages


@query(
    r"""with p as (select page_id, url, case when page_id % 3 = 2 then chr(65533) || html else html end as content from pages)
select 'url:' || url as reference_id, page_id, coalesce(nullif(trim(regexp_extract(content, '(?i)<title[^>]*>([^<]+)</title>', 1)), ''), url) as title, md5(content) as content_md5, 'url' as content_type from p"""
)
def url_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages in declared charsets, and ones that aren't what they say."""
    k = F.col("page_id") % 3
    content = F.when(k == 0, F.encode("html", "UTF-16BE")).when(k == 1, F.encode("html", "UTF-8")).otherwise(F.concat(F.unhex(F.lit("FF")), F.encode("html", "UTF-8")))
    declared = F.when(k == 0, 'text/html; charset="utf-16be"').when(k == 1, "text/html; charset=unheard-of").otherwise("text/html")
    pages = d.table(spark, sf_dir, "pages").select(F.concat(F.col("url"), F.lit("\u0001"), F.col("page_id").cast("string")).alias("url"), content.alias("content"), declared.alias("content_type"))
    own = F.substring_index(F.col("reference_id"), "\u0001", 1)
    rows = payloads.from_urls(pages)
    return rows.select(own.alias("reference_id"), F.substring_index("reference_id", "\u0001", -1).cast("long").alias("page_id"), F.substring_index("title", "\u0001", 1).alias("title"), F.md5("content").alias("content_md5"), "content_type")


@query(r"select 'file:/data/' || doc_id || '.md' as reference_id, case when doc_id % 2 = 0 then 'Heading ' || lang else doc_id || '.md' end as title, md5(case when doc_id % 2 = 0 then text || chr(10) || '# Heading ' || lang || chr(10) || 'x' else text end) as content_md5, 'local_file' as content_type from documents")
def file_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(_id() % 2 == 0, F.concat("text", F.lit("\n# Heading "), "lang", F.lit("\nx"))).otherwise(F.col("text"))
    files = _docs(spark, sf_dir).select(F.concat(F.lit("file:///data/"), _s(), F.lit(".md")).alias("file"), value.alias("value"))
    return payloads.from_files(files).select("reference_id", "title", F.md5("content").alias("content_md5"), "content_type")


@query("select doc_id, case doc_id % 7 when 0 then 'pdf' when 1 then 'html' when 2 then 'xml' when 3 then 'pdf' when 4 then 'xml' when 5 then 'html' else 'hint' end as format from documents")
def resolved_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the first bytes, else the declared type, else the URL, else the hint."""
    k, text = _id() % 7, F.encode("text", "UTF-8")
    head = F.when(k == 0, "%PDF-1.4 ").when(k == 1, " <!DOCTYPE html> ").when(k == 2, "<?xml version='1.0'?>").otherwise(": ")
    kind = F.when(k == 3, "Application/PDF; q=1").when(k < 3, "text/plain")
    url = F.when(k == 4, "http://a/b.NXML?x=.pdf").when(k == 5, "http://a/b.htm#c").when(k == 6, "http://a/b")
    docs = _docs(spark, sf_dir).select("doc_id", F.concat(F.encode(head, "UTF-8"), text).alias("c"), kind.alias("t"), url.alias("u"))
    return docs.select("doc_id", formats.resolve_format(F.col("c"), F.col("t"), F.col("u"), F.lit("hint")).alias("format"))


# Full-text providers


@query(
    """with p as (select doc_id, unnest(['unpaywall', 'openalex', 'epmc_preprint']) as provider from documents),
c as (select *, case provider when 'unpaywall' then case doc_id % 4 when 0 then 'http://u/' || doc_id || '.pdf' when 1 then 'http://u/' || doc_id end
    when 'openalex' then case doc_id % 4 when 0 then 'http://o/' || doc_id when 1 then 'http://oa/' || doc_id || '.pdf' end
    else case doc_id % 4 when 0 then 'http://e/' || doc_id || '?fileName=x.pdf' when 1 then 'http://e/fulltextRepo?' || doc_id end end as url from p)
select 'DOI:' || doc_id as reference_id, provider, url, case when provider = 'epmc_preprint' or doc_id % 4 = 0 then 'pdf' else 'html' end as format, 'cc-by' as license, case provider when 'unpaywall' then 'gold' when 'openalex' then 'hybrid' else 'green' end as oa_status, case provider when 'epmc_preprint' then 'preprint' else 'v1' end as version from c where url is not null"""
)
def provider_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open or not, PDF or page, preprint or not, preprint records among others, PDFs among other links."""
    k, null = _id() % 4, F.lit(None).cast("string")
    pdf = lambda field, url, page: _named(**{field: F.when(k == 0, url).otherwise(null)}, url=page, license=F.lit("cc-by"), version=F.lit("v1"))
    unpaywall = _named(is_oa=k < 2, best_oa_location=pdf("url_for_pdf", F.concat(F.lit("http://u/"), _s(), F.lit(".pdf")), _prefixed("http://u/")), oa_status=F.lit("gold"))
    openalex = _named(open_access=_named(is_oa=k < 2, oa_url=F.concat(F.lit("http://oa/"), _s(), F.lit(".pdf")), oa_status=F.lit("hybrid")), best_oa_location=pdf("pdf_url", _prefixed("http://o/"), F.lit("x")))
    link = lambda style, url: _named(documentStyle=F.lit(style), url=url)
    links = F.when(k == 0, F.array(link("html", F.lit("http://e/page")), link("pdf", F.concat(F.lit("http://e/"), _s(), F.lit("?fileName=x.pdf"))))).when(k == 2, F.array(link("html", F.lit("http://e/page")))).otherwise(F.array(link("doi", F.concat(F.lit("http://e/fulltextRepo?"), _s()))))
    record = lambda source: _named(source=F.lit(source), license=F.lit("cc-by"), fullTextUrlList=_named(fullTextUrl=links))
    epmc = _named(resultList=_named(result=F.array(record("MED"), record("PPR"))))
    docs = _docs(spark, sf_dir)
    rows = None
    for provider, body in (("unpaywall", unpaywall), ("openalex", openalex), ("epmc_preprint", epmc)):
        part = docs.select(_prefixed("DOI:").alias("reference_id"), F.lit(provider).alias("provider"), F.to_json(body).alias("body"), F.when(k == 3, False).when(k == 0, True).alias("is_preprint"))
        rows = part if rows is None else rows.unionByName(part)
    return fulltext.provider_candidates(rows).select("reference_id", "provider", "url", "format", "license", "oa_status", "version")


_API = {"depot": {"url_template": "https://d/{doi}?p={pmid}", "text_field": "$.text", "location_field": "$.links[0].url"}, "store": {"url_template": "https://s/{pmcid}", "location_field": "$.links[0].url", "format_hint": "pdf"}}


@query("select 'DOI:' || doc_id as reference_id, provider, url from (select doc_id, 'depot' as provider, case when doc_id % 2 = 0 then 'https://d/10.1/' || doc_id || '?p=' || doc_id end as url from documents union all select doc_id, 'store', case when doc_id % 3 > 0 then 'https://s/PMC' || doc_id end from documents) where url is not null")
def declared_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared providers are asked only where all their placeholders have values."""
    who = _docs(spark, sf_dir).select(_prefixed("DOI:").alias("reference_id"), _prefixed("10.1/").alias("doi"), F.when(_id() % 2 == 0, _s()).otherwise("").alias("pmid"), F.when(_id() % 3 > 0, _prefixed("PMC")).alias("pmcid"))
    return fulltext.declared_requests(who, _API)


@query(
    """select 'DOI:' || doc_id as reference_id, provider, md5(case when provider = 'depot' and doc_id % 2 = 0 then text end) as text_md5, case when provider = 'store' or doc_id % 2 = 1 then 'http://l/' || doc_id end as url, case when provider = 'store' then 'pdf' when doc_id % 2 = 0 then 'text' end as format
from documents, (values ('depot'), ('store')) p(provider) where doc_id % 5 > 0 or provider = 'depot' and doc_id % 2 = 0"""
)
def declared_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text where an answer has it, else the location, else nothing."""
    body = F.to_json(_named(text=F.when(_id() % 2 == 0, F.col("text")).otherwise(""), links=F.when(_id() % 5 > 0, F.array(_named(url=_prefixed("http://l/")))).otherwise(F.array().cast("array<struct<url:string>>"))))
    rows = _docs(spark, sf_dir).select(_prefixed("DOI:").alias("reference_id"), body.alias("body")).withColumn("provider", F.explode(F.array(F.lit("depot"), F.lit("store"))))
    return fulltext.declared_candidates(rows, _API).select("reference_id", "provider", F.md5("text").alias("text_md5"), "url", "format")


@query(
    f"""with t as (select doc_id, {_SQL_FLAT} as x, 'page text ' || repeat('z', 1000) as h from documents)
select 'PMC:' || doc_id as reference_id, case when length(x) > 1000 then 'xml' else 'html' end as format, md5(case when length(x) > 1000 then x else h end) as text_md5, 'green' as oa_status from t where length(x) > 1000 or doc_id % 2 = 0"""
)
def pmc_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article XML if it is long enough, else the page's body if that is."""
    docs = _docs(spark, sf_dir)
    xml = docs.select(_prefixed("PMC:").alias("reference_id"), F.lit("xml").alias("kind"), F.concat(F.lit("<article><front><p>no</p></front><body><sec><p>"), _escaped(F.col("text")), F.lit("</p></sec></body></article>")).alias("body"))
    page = F.when(_id() % 2 == 0, F.concat(F.lit("<div class='top'><p>no</p></div><div class='x article-body'><div><p>page text "), F.repeat(F.lit("z"), 1000), F.lit("</p></div></div><p>no</p>"))).otherwise("<div class='tsec'><p>short</p></div>")
    html = docs.select(_prefixed("PMC:").alias("reference_id"), F.lit("html").alias("kind"), page.alias("body"))
    return fulltext.pmc_candidates(xml.unionByName(html)).select("reference_id", "format", F.md5("text").alias("text_md5"), "oa_status")


@query("select 'PMID:' || doc_id as reference_id, case when doc_id % 3 = 0 then 'PMC' || doc_id else (doc_id + 7)::varchar end as pmcid from documents where doc_id % 3 < 2")
def pmc_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    who = docs.select(_prefixed("PMID:").alias("reference_id"), _s().alias("pmid"), F.when(_id() % 3 == 0, _prefixed("PMC")).otherwise("").alias("pmcid"))
    links = F.when(_id() % 3 == 1, F.array((_id() + 7).cast("string"))).otherwise(F.array().cast("array<string>"))
    answers = docs.select(_s().alias("pmid"), F.to_json(_named(linksets=F.array(_named(linksetdbs=F.array(_named(links=links)))))).alias("body"))
    return fulltext.pmc_ids(who, answers)


@query(
    r"""with d as (select *, trim(regexp_replace(text, '\s+', ' ', 'g')) as flat, doc_id % 5 < 2 and strlen(case when doc_id % 5 = 0 then replace(replace(text, '&', '&amp;'), '<', '&lt;') || repeat('x', 39) else text end) > 3000 as large from documents)
select 'U' || doc_id as reference_id, case when doc_id % 5 = 0 and not large then md5('caf' || chr(233) || ' ' || flat) when doc_id % 5 = 1 and not large then md5(text) end as text_md5,
  case when doc_id % 5 = 0 then 'html' when doc_id % 5 = 1 then 'txt' end as format, doc_id % 5 = 4 as error from d"""
)
def acquired_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed files of whole documents by their format and charset. Too large a file and another
    answer than 200 are no errors, a file that never landed is one."""
    k, null = _id() % 5, F.lit(None).cast("string")
    docs = _docs(spark, sf_dir)
    cands = docs.select(_prefixed("U").alias("reference_id"), F.lit("unpaywall").alias("provider"), null.alias("text"), _prefixed("http://f/").alias("url"), F.when(k == 1, "txt").alias("format"), null.alias("license"), null.alias("oa_status"), F.lit(False).alias("error"))
    page = F.encode(F.concat(F.lit("<html><body><p>café "), _escaped(F.col("text")), F.lit("</p></body></html>")), "UTF-8")
    content = F.when(k == 0, page).otherwise(F.encode("text", "UTF-8"))
    files = docs.where(k != 4).select(_prefixed("http://f/").alias("url"), content.alias("content"), F.when(k == 0, "text/html; charset=UTF-8").alias("content_type"), F.when(k == 2, 404).otherwise(200).alias("status"))
    got = fulltext.acquire(cands, files, max_bytes=3000)
    return got.select("reference_id", F.md5("text").alias("text_md5"), "format", "error")


# Identifiers and schema


@query(
    """select doc_id, case doc_id % 4 when 0 then 'PMID:' || doc_id when 1 then 'GEO:GSE' || doc_id when 2 then 'file:a/' || doc_id else 'DOI:10.1/' || doc_id end as normal, case doc_id % 4 when 3 then '10.1/' || doc_id when 1 then 'x' end as doi, case when doc_id % 4 = 0 then doc_id::varchar end as pmid,
  case when doc_id % 4 = 3 then 'PPR' || doc_id end as pprid, doc_id % 4 = 0 as is_preprint from documents"""
)
def reference_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefixes by an alias map, in any case, and the identifiers of a reference."""
    k = _id() % 4
    rid = F.when(k == 0, F.concat(F.lit("PubMed: "), _s())).when(k == 1, F.concat(F.lit("ncbigeo:GSE"), _s())).when(k == 2, F.concat(F.lit("FILE:a/"), _s())).otherwise(F.concat(F.lit("doi:10.1/"), _s()))
    docs = _docs(spark, sf_dir).select("doc_id", ids.normalize_reference_id(rid, {"pubmed": "pmid", "NCBIGEO": "GEO"}).alias("normal"))
    who = ids.build_identifiers(F.col("normal"), F.when(k == 1, "x"), k == 0)
    preprint = ids.build_identifiers(F.concat(F.lit("PPR:"), F.when(_id() % 8 == 3, "ppr").otherwise(""), _s()))
    return docs.select("doc_id", "normal", who["doi"].alias("doi"), who["pmid"].alias("pmid"), F.when(k == 3, preprint["pprid"]).alias("pprid"), who["is_preprint"].alias("is_preprint"))


@query(
    """select doc_id, case doc_id % 3 when 0 then 'http://purl.org/dc/terms/' || source when 1 then 'zz:' || source else source end as uri, case doc_id % 4 when 0 then 'has|reference' when 1 then 'has|referenced' when 2 then 'my|references|2' else 'preference' end as tokens, doc_id % 4 in (0, 2) as is_reference from documents"""
)
def curies(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = F.create_map(*[F.lit(x) for kv in fields.PREFIXES.items() for x in kv])
    uri = F.concat(F.when(_id() % 3 == 0, "dcterms:").when(_id() % 3 == 1, "zz:").otherwise(""), F.col("source"))
    name = F.when(_id() % 4 == 0, "hasReference").when(_id() % 4 == 1, "hasReferenced").when(_id() % 4 == 2, "my_References-2").otherwise("preference")
    return _docs(spark, sf_dir).select("doc_id", fields.expand_curie(uri, table).alias("uri"), F.array_join(fields.uri_tokens(name), "|").alias("tokens"), fields.is_reference_uri(name).alias("is_reference"))


# Cached references


def _cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = {
        "title": F.nullif(F.trim(_title()), F.lit("")), "content": F.col("text"), "content_type": F.lit("abstract_only"), "authors": F.when(_id() % 3 > 0, F.array(F.concat(F.lit("A: "), "lang"), F.col("source"))),
        "journal": F.concat(F.lit('J "'), "source", F.lit('" & # x')), "year": F.lit("2001"), "doi": _prefixed("10.1/"), "keywords": F.when(_id() % 2 == 0, F.array(F.lit("no"), F.lit("1e3"))),
        "is_preprint": F.when(_id() % 4 == 0, True).when(_id() % 4 == 1, False), "full_text_attempted": _id() % 5 == 0, "metadata": F.create_map(F.lit("k"), F.col("lang")), "license": F.when(_id() % 2 == 1, "cc: by"),
    }
    columns = []
    for name, kind in (c.strip().split(" ", 1) for c in cache.REFERENCE.split(", ")):
        columns.append((_prefixed("DOC:") if name == "reference_id" else given.get(name, F.lit(None))).cast(kind).alias(name))
    return _docs(spark, sf_dir).select(*columns)


@query(
    rf"""select 'DOC:' || doc_id as reference_id, 'DOC_' || doc_id || '.md' as file, {_SQL_TITLE} as title, md5(regexp_replace(regexp_replace(text, '^\n+', ''), '\s+$', '')) as content_md5, case when doc_id % 3 > 0 then 'A: ' || lang || '|' || source end as authors, 'J "' || source || '" & # x' as journal, '2001' as year, '10.1/' || doc_id as doi,
  case when doc_id % 2 = 0 then 'no|1e3' end as keywords, case doc_id % 4 when 0 then true when 1 then false end as is_preprint, doc_id % 5 = 0 as full_text_attempted, lang as k, case when doc_id % 2 = 1 then 'cc: by' end as license from documents"""
)
def cache_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References written as Markdown with front matter and read again."""
    made = cache.to_markdown(_cached(spark, sf_dir))
    read = cache.parse_references(made.select("value"))
    return read.select("reference_id", ids.cache_name(F.col("reference_id")).alias("file"), "title", F.md5("content").alias("content_md5"), F.array_join("authors", "|").alias("authors"), "journal", "year", "doi", F.array_join("keywords", "|").alias("keywords"), "is_preprint", "full_text_attempted", F.col("metadata")["k"].alias("k"), "license")


@query(
    r"""select 'DOC:' || doc_id as reference_id, source as title, md5(regexp_replace(text, '^\s+|\s+$', '', 'g')) as content_md5, lang || '|x' as authors, 'J' as journal, 'summary' as content_type from documents"""
)
def legacy_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older form: header lines, a blank one, the content."""
    value = F.concat(F.lit("ID: DOC:"), _s(), F.lit("\nTitle: "), F.col("source"), F.lit("\nAuthors: "), F.col("lang"), F.lit(", x\nJournal: J\nContentType: summary\n\n"), F.col("text"))
    read = cache.parse_references(_docs(spark, sf_dir).select(value.alias("value")))
    return read.select("reference_id", "title", F.md5("content").alias("content_md5"), F.array_join("authors", "|").alias("authors"), "journal", "content_type")


@query("select 'DOC:' || doc_id as reference_id, case when doc_id % 3 = 0 then 'new' else 'abstract_only' end as content_type from documents")
def cache_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _cached(spark, sf_dir)
    new = store.where(F.substring("reference_id", 5, 20).cast("long") % 3 == 0).withColumn("content_type", F.lit("new"))
    return cache.upsert(store, new).select("reference_id", "content_type")


@query("select 'DOC:' || doc_id as reference_id, md5(coalesce(nullif(trim(split_part(text, chr(10), 1)), '') || chr(10), '') || case when doc_id % 3 > 0 then 'A: ' || lang || ', ' || source || chr(10) else '' end || 'J \"' || source || '\" & # x 2001' || chr(10) || chr(10) || text) as shown_md5 from documents where doc_id in (0, 1, 2, 3)")
def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cache.lookup(_cached(spark, sf_dir), [f"DOC:{k}" for k in range(4)], "text")
    return found.select("reference_id", F.md5("value").alias("shown_md5"))


# Repairs


_FAR = "'First marker sentence number ' || doc_id || ' here'", "'Second marker sentence number ' || doc_id || ' there'"
_REPAIRS = f"""f as (select *, length({_SQL_FLAT}) > 60 as far, {_FAR[0]} as one, {_FAR[1]} as two from documents),
c as (select *, case when doc_id % 7 = 6 then 'skipped' when doc_id % 5 = 0 then 'valid' when doc_id % 5 = 1 then 'characters' when doc_id % 5 = 2 then 'unverifiable' when doc_id % 5 = 3 and far then 'ellipsis' else 'removal' end as step from f)"""


def _markers() -> tuple[Column, ...]:
    return tuple(F.concat(F.lit(f"{a} marker sentence number "), _s(), F.lit(f" {b}")) for a, b in (("First", "here"), ("Second", "there")))


def _repairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Claims that each step of the cascade but the closest sentence decides, and their references."""
    from claimlens.functions.text import collapse

    docs, (one, two), k = _docs(spark, sf_dir), _markers(), _id() % 5
    far = F.length(collapse(F.col("text"))) > 60
    refs = docs.select(_prefixed("DOC:").alias("reference_id"), F.lit("t").alias("title"), F.concat(one, F.lit(". "), F.col("text"), F.lit(" . "), two, F.lit(". CO₂ levels ± 5 were seen.")).alias("content"), F.lit("abstract_only").alias("content_type"))
    quote = F.when(k == 0, two).when(k == 1, "CO2 levels +/- 5 were seen").when((k == 3) & far, F.concat(one, F.lit(". "), two)).otherwise("qzxv wvkq zzyx kkjq vvxz qqkz")
    rid = F.when(_id() % 7 == 6, _prefixed("SRA:")).when(k == 2, F.concat(F.lit("DOC:"), (_id() + d.MISSING).cast("string"))).otherwise(_prefixed("DOC:"))
    return docs.select(_id().alias("claim_id"), quote.alias("supporting_text"), rid.alias("reference_id"), F.lit(None).cast("string").alias("expected_title"), F.concat(F.lit("evidence["), _s(), F.lit("]")).alias("path")), refs


_SKIPPING = ValidationConfig(skip_prefixes=("SRA",), unknown_prefix_severity="WARN")


@query(
    f"""with {_REPAIRS}
select doc_id as claim_id, step in ('skipped', 'valid') as was_valid, step in ('characters', 'ellipsis') as is_repaired, case step when 'characters' then 'CO₂ levels ± 5 were seen' when 'ellipsis' then one || ' ... ' || two end as repaired_text,
  case step when 'characters' then 'Fixed via character normalization' when 'ellipsis' then 'Fixed via ellipsis insertion' when 'unverifiable' then 'Reference content not available - cannot verify' when 'removal' then 'Flagged for removal - text not found in reference' else 'Already valid' end as message,
  case step when 'characters' then 'CHARACTER_NORMALIZATION:HIGH:true' when 'ellipsis' then 'ELLIPSIS_INSERTION:MEDIUM:false' when 'unverifiable' then 'UNVERIFIABLE:VERY_LOW:false' when 'removal' then 'REMOVAL:VERY_LOW:false' else '' end as actions from c"""
)
def repair_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole cascade, on claims that no similar sentence can decide."""
    claims, refs = _repairs(spark, sf_dir)
    shown = F.array_join(F.transform("actions", lambda a: F.concat_ws(":", a["action_type"], a["confidence"], a["can_auto_fix"].cast("string"))), "|")
    return repair(claims, refs, validation=_SKIPPING).select("claim_id", "was_valid", "is_repaired", "repaired_text", "message", shown.alias("actions"))


@query(
    f"""with {_REPAIRS}
select doc_id as claim_id, case when doc_id % 5 = 0 and step <> 'skipped' then 'Skipped - reference DOC:' || doc_id || ' is in skip list' else 'other' end as message, case when step = 'removal' and doc_id = 4 then 0 when step in ('skipped', 'valid') then 0 else 1 end as actions from c where doc_id < 30"""
)
def repair_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References that are skipped, and ones that are trusted in spite of low similarity."""
    claims, refs = _repairs(spark, sf_dir)
    config = RepairConfig(skip_references=tuple(f"DOC:{k}" for k in range(0, 30, 5)), trusted_low_similarity=("DOC:4",))
    made = repair(claims.where("claim_id < 30"), refs, config, _SKIPPING)
    return made.select("claim_id", F.when(F.col("message").startswith("Skipped"), F.col("message")).otherwise("other").alias("message"), F.size("actions").alias("actions"))


@query(
    f"""with {_REPAIRS}
select count(*) as total_items, count(*) filter (where step in ('skipped', 'valid')) as already_valid_count, count(*) filter (where step in ('characters', 'ellipsis')) as repaired_count, count(*) filter (where step = 'characters') as auto_fixed_count,
  count(*) filter (where step = 'ellipsis') as suggested_count, count(*) filter (where step = 'removal') as removal_count, count(*) filter (where step = 'unverifiable') as unverifiable_count from c"""
)
def repair_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.repair_report(repair(*_repairs(spark, sf_dir), validation=_SKIPPING))


@query(
    f"""with {_REPAIRS}
select case step when 'characters' then 'fixes' when 'ellipsis' then 'suggestions' when 'removal' then 'removals' else 'unverifiable' end as section, doc_id as claim_id, case when step = 'unverifiable' then 'DOC:' || (doc_id + {d.MISSING}) else 'DOC:' || doc_id end as reference_id, 'evidence[' || doc_id || ']' as path
from c where step not in ('skipped', 'valid')"""
)
def repair_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.repair_sections(repair(*_repairs(spark, sf_dir), validation=_SKIPPING)).select("section", "claim_id", "reference_id", "path")


@query(f"with {_REPAIRS} select 'f' || doc_id || '.json' as file, 1::bigint as applied, 'CO₂ levels ± 5 were seen' as supporting_text, 'DOC:' || doc_id as reference from c where step = 'characters'")
def applied_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Automatic fixes written into the data files that the claims come from."""
    claims, refs = _repairs(spark, sf_dir)
    name = F.concat(F.lit("f"), F.col("claim_id").cast("string"), F.lit(".json"))
    placed = claims.withColumn("file", name).withColumn("path", F.lit("evidence[0]"))
    files = placed.select("file", F.to_json(_named(evidence=F.array(_named(supporting_text=F.col("supporting_text"), reference=F.col("reference_id"))))).alias("value"))
    fixes = lifecycle.automatic_fixes(repair(placed.drop("file"), refs, validation=_SKIPPING), placed)
    at = lambda slot: F.get_json_object("value", f"$.evidence[0].{slot}")
    return lifecycle.apply_repairs(files, fixes).select("file", "applied", at("supporting_text").alias("supporting_text"), at("reference").alias("reference"))
