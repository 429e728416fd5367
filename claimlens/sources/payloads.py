"""Landed answers of bibliographic services, parsed into reference records.

payloads: reference_id, source, body (JSON or XML text), as some crawler has stored them.
JSON is read with JVM expressions; only repeated structures go through from_json.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.functions import jsonpath
from claimlens.sources.cache import REFERENCE

_PERSON = "array<struct<given:string,family:string,name:string,givenName:string,familyName:string>>"


def _get(path: str, column: str = "body") -> Column:
    return F.get_json_object(column, path)


def _some(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def _strings(path: str) -> Column:
    """A JSON list of strings without blanks; null if nothing is left."""
    kept = F.filter(F.from_json(_get(path), "array<string>"), lambda x: F.trim(x) != "")
    return F.when(F.size(kept) > 0, kept)


def without_markup(text: Column) -> Column:
    bare = F.regexp_replace(text, "<[^>]+>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(char))
    return _some(F.regexp_replace(bare, r"\s+", " "))


def _record(df: DataFrame, **columns: Column) -> DataFrame:
    """REFERENCE rows with the given columns, null elsewhere."""
    out = []
    for name, kind in (c.strip().split(" ", 1) for c in REFERENCE.split(", ")):
        value = columns.get(name)
        out.append((F.col("reference_id") if name == "reference_id" else value if value is not None else F.lit(False if name == "full_text_attempted" else None)).cast(kind).alias(name))
    return df.select(*out)


def _content_type(content: Column, kind: str) -> Column:
    return F.when(content.isNotNull(), kind).otherwise("unavailable")


def crossref_year() -> Column:
    return F.coalesce(*[_get(f"$.message.{k}.date-parts[0][0]") for k in ("published-print", "published-online", "created", "issued")])


def crossref_preprint() -> Column:
    """True, false, or null where no type is given."""
    kind, sub = F.lower(_get("$.message.type")), F.lower(_get("$.message.subtype"))
    return F.when((kind == "posted-content") | (sub == "preprint"), True).when(kind.isNotNull(), False)


def names(path: str, *, name_first: bool = False) -> Column:
    """`given family`, or whichever exists; a whole name first if asked."""
    people = F.from_json(_get(path), _PERSON)

    def one(p: Column) -> Column:
        both = _some(F.concat_ws(" ", F.coalesce(p["given"], p["givenName"]), F.coalesce(p["family"], p["familyName"])))
        return F.coalesce(p["name"], both) if name_first else F.coalesce(both, p["name"])

    found = F.filter(F.transform(people, one), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found)


def parse_crossref(payloads: DataFrame) -> DataFrame:
    abstract = without_markup(_get("$.message.abstract"))
    return _record(
        payloads.where(_get("$.message").isNotNull()),
        title=_some(_get("$.message.title[0]")),
        authors=names("$.message.author"),
        journal=_some(_get("$.message.container-title[0]")),
        year=crossref_year(),
        doi=_get("$.message.DOI"),
        keywords=_strings("$.message.subject"),
        content=abstract,
        content_type=_content_type(abstract, "abstract_only"),
        is_preprint=crossref_preprint(),
        peer_review_status=F.when(crossref_preprint(), "preprint"),
    )


def parse_datacite(payloads: DataFrame) -> DataFrame:
    a = "$.data.attributes"
    described = F.from_json(_get(f"{a}.descriptions"), "array<struct<description:string,descriptionType:string>>")
    abstract = without_markup(F.get(F.filter(described, lambda d: d["descriptionType"] == "Abstract"), 0)["description"])
    subjects = F.filter(F.transform(F.from_json(_get(f"{a}.subjects"), "array<struct<subject:string>>"), lambda s: s["subject"]), lambda s: F.trim(s) != "")
    return _record(
        payloads.where(_get(a).isNotNull()),
        title=_some(_get(f"{a}.titles[0].title")),
        authors=names(f"{a}.creators", name_first=True),
        journal=_some(_get(f"{a}.publisher")),
        year=_get(f"{a}.publicationYear"),
        doi=_get(f"{a}.doi"),
        keywords=F.when(F.size(subjects) > 0, subjects),
        content=abstract,
        content_type=_content_type(abstract, "abstract_only"),
    )


def parse_doi(payloads: DataFrame) -> DataFrame:
    """Crossref's answer where there is one, else DataCite's, by one aggregation per id."""
    both = parse_crossref(payloads.where("source = 'crossref'")).withColumn("_rank", F.lit(0)).unionByName(parse_datacite(payloads.where("source = 'datacite'")).withColumn("_rank", F.lit(1)))
    return _first_by(both, "_rank")


def _first_by(df: DataFrame, rank: str) -> DataFrame:
    columns = [c for c in df.columns if c not in (rank, "reference_id")]
    # Maps can't be compared, but min_by only compares the rank.
    best = df.groupBy("reference_id").agg(F.min_by(F.struct(*columns), rank).alias("r"))
    return best.select("reference_id", "r.*")


def repository_files(payloads: DataFrame) -> DataFrame:
    """(reference_id, supplementary_files) of Zenodo records; entries without a name are dropped."""
    files = F.from_json(_get("$.files"), "array<struct<key:string,size:bigint,checksum:string,links:struct<self:string>>>")
    kept = F.filter(files, lambda f: F.coalesce(f["key"], F.lit("")) != "")
    shaped = F.transform(kept, lambda f: F.struct(f["key"].alias("filename"), f["links"]["self"].alias("download_url"), F.lit(None).cast("string").alias("content_type"), f["size"].alias("size_bytes"), f["checksum"].alias("checksum"), F.lit(None).cast("string").alias("description"), F.lit(None).cast("string").alias("local_path")))
    return payloads.where("source = 'zenodo'").select("reference_id", F.when(F.size(shaped) > 0, shaped).alias("supplementary_files"))


def zenodo_record(doi: Column) -> Column:
    """Record number of a Zenodo DOI, else null."""
    return F.when(F.lower(doi).startswith("10.5281/zenodo."), F.substring(doi, 16, 64))


def parse_ppr(payloads: DataFrame) -> DataFrame:
    """The first preprint among the results."""
    result = "struct<source:string,title:string,authorString:string,abstractText:string,doi:string,pubYear:string,bookOrReportDetails:struct<publisher:string>,journalTitle:string>"
    found = F.filter(F.from_json(_get("$.resultList.result"), f"array<{result}>"), lambda r: r["source"] == "PPR")
    df = payloads.withColumn("p", F.get(found, 0)).where("p is not null")
    authors = F.filter(F.transform(F.split("p.authorString", ","), lambda x: F.regexp_replace(F.trim(x), r"\.+$", "")), lambda x: x != "")
    abstract = without_markup(F.col("p.abstractText"))
    return _record(df, title=_some(F.col("p.title")), authors=F.when(F.size(authors) > 0, authors), journal=F.coalesce("p.bookOrReportDetails.publisher", "p.journalTitle"), year=F.col("p.pubYear"), doi=F.col("p.doi"), content=abstract, content_type=_content_type(abstract, "abstract_only"), is_preprint=F.lit(True), peer_review_status=F.lit("preprint"))


def ppr_id(identifier: Column) -> Column:
    bare = F.upper(F.trim(identifier))
    return F.when(bare.startswith("PPR"), bare).otherwise(F.concat(F.lit("PPR"), bare))


#: Fields of summaries, the first that isn't blank counts (fixed values).
SUMMARY_FIELDS = {
    "GEO": (("title", "description", "summary"), ("summary", "description", "title")),
    "BIOPROJECT": (("Project_Title", "Project_Name", "title"), ("Project_Description", "Description", "title")),
    "BIOSAMPLE": (("Title", "title", "Description"), ("Description", "Title", "title")),
}


def parse_summary(payloads: DataFrame, fields: Mapping[str, tuple[Sequence[str], Sequence[str]]] = SUMMARY_FIELDS) -> DataFrame:
    """Entrez summaries by source; keys are matched without case, lists joined by `; `."""
    flat = F.map_from_entries(F.transform(F.map_entries(F.from_json("body", "map<string,string>")), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))
    df = payloads.where(F.col("source").isin(*fields)).withColumn("m", flat)

    def text(value: Column) -> Column:
        return _some(F.when(value.startswith("["), F.array_join(F.from_json(value, "array<string>"), "; ")).otherwise(value))

    def pick(which: int) -> Column:
        branches = [(F.col("source") == s, F.coalesce(*[text(F.element_at("m", k.lower())) for k in names_[which]])) for s, names_ in fields.items()]
        return reduce(lambda acc, b: F.when(b[0], b[1]) if acc is None else acc.when(b[0], b[1]), branches, None)

    content = pick(1)
    return _record(df, title=pick(0), content=content, content_type=_content_type(content, "summary"), metadata=F.create_map(F.lit("source"), F.col("source")))


def accession_uids(payloads: DataFrame) -> DataFrame:
    """(accession, uid) from landed search answers, to join summaries by uid."""
    return payloads.select(F.col("reference_id").alias("accession"), _get("$.esearchresult.idlist[0]").alias("uid")).where("uid is not null")


def parse_trials(payloads: DataFrame) -> DataFrame:
    p = "$.protocolSection"
    content = F.coalesce(_some(_get(f"{p}.descriptionModule.briefSummary")), _some(_get(f"{p}.descriptionModule.detailedDescription")))
    meta = F.map_filter(F.create_map(F.lit("status"), _get(f"{p}.statusModule.overallStatus"), F.lit("sponsor"), _get(f"{p}.sponsorCollaboratorsModule.leadSponsor.name")), lambda k, v: v.isNotNull())
    return _record(payloads.where(_get(p).isNotNull()), title=F.coalesce(_some(_get(f"{p}.identificationModule.officialTitle")), _some(_get(f"{p}.identificationModule.briefTitle"))), content=content, content_type=_content_type(content, "summary"), metadata=meta)


_ARTICLE = "title string, authors array<string>, journal string, year string, doi string, keywords array<string>, publication_types array<string>, content string"


def pubmed_record(xml: str | None) -> dict | None:
    """The fields of one PubMed article, element by element: text within further markup counts."""
    try:
        root = ElementTree.fromstring(xml or "")
    except ElementTree.ParseError:
        return None
    text = lambda e: "".join(e.itertext()).strip() if e is not None else ""
    article = root.find(".//MedlineCitation/Article")
    if article is None:
        return None
    sections = [(e.get("Label"), text(e)) for e in article.findall("./Abstract/AbstractText")]
    people = [" ".join(filter(None, (text(p.find("LastName")), text(p.find("Initials"))))) or text(p.find("CollectiveName")) for p in article.findall("./AuthorList/Author")]
    heads = [(text(h.find("DescriptorName")), [text(q) for q in h.findall("QualifierName")]) for h in root.findall(".//MeshHeadingList/MeshHeading")]
    date = article.find("./Journal/JournalIssue/PubDate")
    year = date is not None and (text(date.find("Year")) or text(date.find("MedlineDate"))[:4])
    return {
        "title": text(article.find("ArticleTitle")) or None,
        "authors": [p for p in people if p] or None,
        "journal": text(article.find("./Journal/Title")) or None,
        "year": year or None,
        "doi": text(root.find(".//ArticleIdList/ArticleId[@IdType='doi']")) or None,
        "keywords": [f"{d}/{', '.join(q)}" if q else d for d, q in heads if d] or None,
        "publication_types": [t for e in article.findall("./PublicationTypeList/PublicationType") if (t := text(e))] or None,
        "content": "\n\n".join(f"{label}: {t}" if label else t for label, t in sections if t) or None,
    }


def parse_pubmed(payloads: DataFrame) -> DataFrame:
    """PubMed article XML: sections `Label: text` by blank lines, MeSH as descriptor and
    qualifiers. Payloads that hold no article have null fields."""

    def over(bodies: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([pubmed_record(b) or {} for b in bodies], columns=[c.split()[0] for c in _ARTICLE.split(", ")], dtype=object)

    df = payloads.withColumn("a", F.pandas_udf(over, _ARTICLE)("body"))
    fields = {name: F.col(f"a.{name}") for name in (c.split()[0] for c in _ARTICLE.split(", "))}
    return _record(df, **fields, content_type=_content_type(F.col("a.content"), "abstract_only"))


def parse_json_api(payloads: DataFrame, sources: Mapping[str, Mapping]) -> DataFrame:
    """Payloads of config-declared sources: `fields` maps record columns to JSON paths, and
    `extra_fields` names further ones, whose text follows the content in headed blocks. Sources
    that are declared alike are parsed together, in one pass over the payloads."""
    alike: dict[str, list[str]] = {}
    for prefix, conf in sources.items():
        alike.setdefault(json.dumps([conf["fields"], conf.get("extra_fields"), conf.get("content_type")]), []).append(prefix)
    out = None
    for prefixes in alike.values():
        conf = sources[prefixes[0]]
        fields = {k: jsonpath.first_match(F.col("body"), p) for k, p in conf["fields"].items() if k in ("title", "content", "journal", "year", "doi")}
        extra = jsonpath.extra_fields(F.col("body"), conf.get("extra_fields", {})) if conf.get("extra_fields") else None
        content = _some(fields.pop("content", F.lit(None).cast("string")))
        if extra is not None:
            content = _some(F.concat_ws("\n\n", content, _some(jsonpath.extra_content(extra))))
        part = _record(payloads.where(F.col("source").isin(*prefixes)), **fields, content=content, content_type=_content_type(content, conf.get("content_type", "summary")), metadata=extra)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else _record(payloads.limit(0))


def with_extra_fields(refs: DataFrame, payloads: DataFrame, fields: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """refs whose source has extra fields configured (source to name to JSON path): their
    text follows the content in headed blocks, and metadata says which were found. A reference
    with payloads of several such sources gets them in the order of `fields`, in one join."""
    if not fields:
        return refs
    parts = [payloads.where(F.col("source") == source).select("reference_id", F.lit(k).alias("k"), jsonpath.extra_fields(F.col("body"), paths).alias("extra")).where(F.size("extra") > 0) for k, (source, paths) in enumerate(fields.items())]
    found = reduce(lambda a, b: a.unionByName(b), parts).select(F.col("reference_id").alias("_rid"), F.struct("k", jsonpath.extra_content(F.col("extra")).alias("block"), F.map_keys("extra").alias("names")).alias("x"))
    extra = found.groupBy("_rid").agg(F.sort_array(F.collect_list("x")).alias("_x"))
    j = refs.join(extra, F.col("reference_id") == F.col("_rid"), "left")
    met = F.col("_rid").isNotNull()
    content = F.when(met, F.concat(F.coalesce("content", F.lit("")), F.lit("\n\n"), F.array_join(F.transform("_x", lambda x: x["block"]), "\n\n"))).otherwise(F.col("content"))
    seen = F.create_map(F.lit("extra_fields_captured"), F.array_join(F.flatten(F.transform("_x", lambda x: x["names"])), ","))
    meta = F.when(met, F.map_concat(F.coalesce("metadata", F.create_map().cast("map<string,string>")), seen)).otherwise(F.col("metadata"))
    kind = F.when(met & (F.col("content_type") == "unavailable"), "summary").otherwise(F.col("content_type"))
    return j.select(*[{"content": content, "metadata": meta, "content_type": kind}.get(c, F.col(c)).alias(c) for c in refs.columns])


def from_files(files: DataFrame) -> DataFrame:
    """Local text files (file: path, value: text) as references file:<path>; the title is the
    first heading, else the file's name."""
    heading = _some(F.regexp_extract("value", r"(?m)^#\s+(.+)$", 1))
    path = F.regexp_replace("file", "^file:/*", "/")
    df = files.withColumn("reference_id", F.concat(F.lit("file:"), path))
    return _record(df, title=F.coalesce(heading, F.substring_index(path, "/", -1)), content=F.col("value"), content_type=F.lit("local_file"))


def from_urls(pages: DataFrame) -> DataFrame:
    """Landed pages (url, content: binary, content_type) as references url:<url>; HTML stays as
    it is, decoded by the declared charset, else as UTF-8; what can't be read is replaced."""
    from claimlens.sources.formats import extracted_text, html_title, resolve_format

    kind = resolve_format(F.col("content"), F.col("content_type"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    text = extracted_text(F.col("content"), F.when(kind == "pdf", "pdf").otherwise("text"), F.col("content_type"))
    df = pages.withColumn("value", text).withColumn("reference_id", F.concat(F.lit("url:"), F.col("url")))
    return _record(df, title=html_title(F.col("value"), F.col("url")), content=F.col("value"), content_type=F.lit("url"))


#: Parsers by source; register() adds others. Each takes payloads and returns REFERENCE rows.
PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "PMID": parse_pubmed,
    "crossref": parse_crossref,
    "datacite": parse_datacite,
    "PPR": parse_ppr,
    "GEO": parse_summary,
    "BIOPROJECT": parse_summary,
    "BIOSAMPLE": parse_summary,
    "clinicaltrials": parse_trials,
}


def register(source: str, parser: Callable[[DataFrame], DataFrame]) -> None:
    PARSERS[source] = parser


def parse(payloads: DataFrame, sources: Mapping[str, Mapping] | None = None, extra: Mapping[str, Mapping[str, str]] | None = None) -> DataFrame:
    """References from payloads of all registered sources, of config-declared ones, and with
    extra fields; of several answers for an id the first source's counts, in that order."""
    order = [*PARSERS, *(sources or {})]
    rank = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("source"))
    parts = [parser(payloads.where(F.col("source") == s)).withColumn("_rank", F.lit(k)) for k, (s, parser) in enumerate(PARSERS.items())]
    if sources:
        ranks = payloads.select(F.col("reference_id"), rank.alias("_rank")).where(F.col("_rank") > len(PARSERS)).distinct()
        parts.append(parse_json_api(payloads, sources).join(ranks, "reference_id"))
    refs = _first_by(reduce(lambda a, b: a.unionByName(b), parts), "_rank")
    return with_extra_fields(refs, payloads, extra) if extra else refs
