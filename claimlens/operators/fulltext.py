"""The full-text chain as relational steps over landed candidates.

candidates: reference_id, provider, text, url, format, license, oa_status, error (boolean)
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.functions import jsonpath, text

#: Content types that leave room for a full text (fixed values).
LACKING = ("abstract_only", "unavailable", "summary", "no_pmc", "pmc_restricted")
PROVIDERS = ("pmc", "epmc_preprint", "unpaywall", "openalex")
MIN_TEXT = 500
#: What PMC's own answers must exceed, untrimmed, to be offered at all.
MIN_PMC_TEXT = 1000


def needs_full_text() -> Column:
    return F.col("content_type").isin(*LACKING)


def full_text_worklist(refs: DataFrame) -> DataFrame:
    """References that still lack full text and whose chain hasn't been through without an error."""
    return refs.where(needs_full_text() & ~F.coalesce(F.col("full_text_attempted"), F.lit(False)))


def first_usable(candidates: DataFrame, providers: Sequence[str] = PROVIDERS) -> DataFrame:
    """Per reference_id: the candidate of the first provider in order whose stripped text is
    long enough, and whether any failed. One aggregation with partial sums, no sort."""
    rank = F.array_position(F.array(*[F.lit(p) for p in providers]), F.col("provider"))
    usable = ~F.coalesce(F.col("error"), F.lit(False)) & (F.length(text.strip(F.col("text"))) >= MIN_TEXT)
    c = candidates.withColumn("rank", rank).where("rank > 0")
    return c.groupBy("reference_id").agg(
        F.min_by(F.struct("provider", "text", "url", "format", "license", "oa_status"), F.when(usable, F.col("rank"))).alias("best"),
        F.count_if(usable).alias("usable"),
        F.coalesce(F.bool_or("error"), F.lit(False)).alias("failed"),
    )


def enrich(refs: DataFrame, candidates: DataFrame, providers: Sequence[str] = PROVIDERS) -> DataFrame:
    """refs with full text where a candidate offers it: content becomes abstract, blank line,
    text; content_type full_text_<format>. full_text_attempted is set on success, and where
    all were tried without an error; after an error a reference stays on the worklist."""
    best = first_usable(candidates, providers)
    wanted = needs_full_text() & ~F.coalesce(F.col("full_text_attempted"), F.lit(False))
    j = refs.withColumn("_wanted", F.coalesce(wanted, F.lit(False))).join(best.withColumnRenamed("reference_id", "_rid"), F.col("reference_id") == F.col("_rid"), "left")
    got = F.col("_wanted") & (F.coalesce(F.col("usable"), F.lit(0)) > 0)
    content = F.concat_ws("\n\n", F.nullif(F.trim(F.col("content")), F.lit("")), F.trim(F.col("best.text")))
    kind = F.when(F.col("best.format").isin("pdf", "html", "xml"), F.concat(F.lit("full_text_"), F.col("best.format"))).otherwise("full_text")
    new = {
        "content": F.when(got, content).otherwise(F.col("content")),
        "content_type": F.when(got, kind).otherwise(F.col("content_type")),
        "full_text_provider": F.when(got, F.col("best.provider")).otherwise(F.col("full_text_provider")),
        "full_text_url": F.when(got, F.col("best.url")).otherwise(F.col("full_text_url")),
        "oa_status": F.when(got, F.coalesce("best.oa_status", "oa_status")).otherwise(F.col("oa_status")),
        "license": F.when(got, F.coalesce("best.license", "license")).otherwise(F.col("license")),
        "full_text_attempted": F.coalesce(F.col("full_text_attempted"), F.lit(False)) | got | (F.col("_wanted") & ~F.coalesce(F.col("failed"), F.lit(False))),
    }
    return j.select(*[new.get(c, F.col(c)).alias(c) for c in refs.columns])


_EPMC = "array<struct<source:string,license:string,fullTextUrlList:struct<fullTextUrl:array<struct<url:string,documentStyle:string>>>>>"


def provider_candidates(payloads: DataFrame) -> DataFrame:
    """candidates from landed provider answers (reference_id, provider, body: JSON, and perhaps
    is_preprint), for providers that name a location: its URL, terms and version; the text comes
    with acquisition. Europe PMC's is the PDF of the first preprint found, and isn't asked for
    references known not to be preprints."""
    j = lambda p: F.nullif(F.get_json_object("body", p), F.lit(""))
    by = lambda name: F.col("provider") == name
    preprint = F.coalesce(F.col("is_preprint"), F.lit(True)) if "is_preprint" in payloads.columns else F.lit(True)
    result = F.get(F.filter(F.from_json(F.get_json_object("body", "$.resultList.result"), _EPMC), lambda r: r["source"] == "PPR"), 0)
    pdfs = F.filter(result["fullTextUrlList"]["fullTextUrl"], lambda u: (u["url"] != "") & ((u["documentStyle"] == "pdf") | F.contains(u["url"], F.lit("fulltextRepo"))))
    best = lambda field: j(f"$.best_oa_location.{field}")
    url = (
        F.when(by("unpaywall"), F.when(F.coalesce(j("$.is_oa"), F.lit("true")) == "true", F.coalesce(best("url_for_pdf"), best("url"))))
        .when(by("openalex"), F.when(j("$.open_access.is_oa") == "true", F.coalesce(best("pdf_url"), j("$.open_access.oa_url"))))
        .when(by("epmc_preprint"), F.when(preprint, F.get(pdfs, 0)["url"]))
    )
    path = F.lower(F.col("url"))
    by_suffix = F.when(path.rlike(r"\.pdf($|\?)"), "pdf").when(path.rlike(r"\.xml($|\?)"), "xml").otherwise("html")
    hint = F.when(by("epmc_preprint"), "pdf").when(by("openalex"), F.when(best("pdf_url").isNotNull(), "pdf").otherwise("html")).when(best("url_for_pdf").isNotNull(), "pdf").otherwise(by_suffix)
    license_ = F.when(by("epmc_preprint"), result["license"]).otherwise(best("license"))
    status = F.when(by("epmc_preprint"), "green").when(by("openalex"), j("$.open_access.oa_status")).otherwise(j("$.oa_status"))
    version = F.when(by("epmc_preprint"), "preprint").otherwise(best("version"))
    found = payloads.withColumn("url", url).where("url is not null")
    return found.select("reference_id", "provider", F.lit(None).cast("string").alias("text"), "url", hint.alias("format"), license_.alias("license"), status.alias("oa_status"), F.lit(False).alias("error"), version.alias("version"))


def pmc_ids(identifiers: DataFrame, links: DataFrame) -> DataFrame:
    """(reference_id, pmcid) for identifiers (reference_id, pmid, pmcid): their own PMC id, else
    the first that a landed link answer (pmid, body: JSON) names; references without one are left out."""
    linked = links.select("pmid", F.get_json_object("body", "$.linksets[0].linksetdbs[0].links[0]").alias("_linked"))
    j = identifiers.join(linked, "pmid", "left")
    return j.select("reference_id", F.coalesce(F.nullif("pmcid", F.lit("")), "_linked").alias("pmcid")).where("pmcid is not null")


def pmc_candidates(payloads: DataFrame) -> DataFrame:
    """candidates from landed PMC answers (reference_id, kind: xml or html, body): the article
    XML's text if it has more than 1000 characters, else that of the HTML page if it has."""
    from claimlens.sources.formats import pmc_html_text, text_col, xml_text

    texts = payloads.where("kind = 'xml'").withColumn("text", text_col(F.col("body"), xml_text)).unionByName(payloads.where("kind = 'html'").withColumn("text", text_col(F.col("body"), pmc_html_text)))
    best = texts.where(F.length("text") > MIN_PMC_TEXT).groupBy("reference_id").agg(F.max_by(F.struct("kind", "text"), "kind").alias("b"))
    null = F.lit(None).cast("string")
    return best.select("reference_id", F.lit("pmc").alias("provider"), "b.text", null.alias("url"), F.col("b.kind").alias("format"), null.alias("license"), F.lit("green").alias("oa_status"), F.lit(False).alias("error"))


def declared_requests(identifiers: DataFrame, providers: Mapping[str, Mapping]) -> DataFrame:
    """(reference_id, provider, url): what to ask of declared providers for identifiers
    (reference_id, doi, pmid, pmcid). A URL whose template names an identifier that is missing isn't asked."""
    urls = []
    for name, conf in providers.items():
        parts = re.split(r"\{(doi|pmid|pmcid)\}", conf["url_template"])
        pieces = [F.nullif(F.col(p), F.lit("")) if k % 2 else F.lit(p) for k, p in enumerate(parts)]
        urls.append(F.struct(F.lit(name).alias("provider"), F.concat(*pieces).alias("url")))
    return identifiers.select("reference_id", F.explode(F.array(*urls)).alias("u")).select("reference_id", "u.*").where("url is not null")


def declared_candidates(payloads: DataFrame, providers: Mapping[str, Mapping]) -> DataFrame:
    """candidates from landed answers (reference_id, provider, body: JSON) of declared
    providers: the text at text_field, else the URL at location_field."""
    null = F.lit(None).cast("string")
    some = lambda c: F.nullif(c, F.lit(""))
    out = None
    for name, conf in providers.items():
        at = lambda field: some(jsonpath.first_match(F.col("body"), conf[field])) if conf.get(field) else null  # noqa: B023, E731
        hint = F.lit(conf.get("format_hint")).cast("string")
        part = payloads.where(F.col("provider") == name).select("reference_id", "provider", at("text_field").alias("text"), at("location_field").alias("url"))
        part = part.where("text is not null or url is not null")
        given = F.col("text").isNotNull()
        part = part.select("reference_id", "provider", "text", F.when(~given, F.col("url")).alias("url"), F.when(given, F.coalesce(hint, F.lit("text"))).otherwise(hint).alias("format"), null.alias("license"), null.alias("oa_status"), F.lit(False).alias("error"))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else payloads.limit(0).select("reference_id", "provider", *[null.alias(c) for c in ("text", "url", "format", "license", "oa_status")], F.lit(False).alias("error"))


def acquire(candidates: DataFrame, files: DataFrame, max_bytes: int = 50 * 1024 * 1024) -> DataFrame:
    """candidates with the text of landed files (url, content: binary, content_type, and
    perhaps status: the answer's code, or null).

    An error, to be tried again, is a URL of which nothing has landed, bytes of a known format
    that can't be read, or a candidate that was one and still has no text. Definitive, and no error, are answers other than 200, files over
    max_bytes, unknown formats and candidates without a URL: they just have no text."""
    from claimlens.sources.formats import extracted_text, resolve_format

    status = F.col("status") if "status" in files.columns else F.lit(None).cast("int")
    usable = (F.coalesce(status, F.lit(200)) == 200) & (F.length("content") <= max_bytes)
    held = files.select(F.col("url").alias("_url"), F.when(usable, F.col("content")).alias("_bytes"), F.col("content_type").alias("_type"), F.lit(True).alias("_landed"))
    j = candidates.join(held, F.col("url") == F.col("_url"), "left")
    kind = resolve_format(F.col("_bytes"), F.col("_type"), F.col("url"), F.col("format"))
    out = j.withColumn("_kind", kind).withColumn("_text", F.when(F.col("text").isNotNull(), F.col("text")).when(F.col("_kind").isNotNull(), extracted_text(F.col("_bytes"), F.col("_kind"), F.col("_type"))))
    missed = F.col("url").isNotNull() & F.col("_landed").isNull()
    unread = F.col("_bytes").isNotNull() & F.coalesce(F.col("_kind").isin("pdf", "html", "xml", "text"), F.lit(False)) & F.col("_text").isNull()
    error = F.col("_text").isNull() & (F.coalesce(F.col("error"), F.lit(False)) | missed | unread)
    return out.select("reference_id", "provider", F.col("_text").alias("text"), "url", F.col("_kind").alias("format"), "license", "oa_status", error.alias("error"))
