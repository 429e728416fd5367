"""Reference identifiers: parsing, normal form, routing to sources, cache paths."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_ID = r"^([A-Za-z_]+)[:\s]+(.+)$"
#: Prefixes whose normal form is lower case.
LOWER = ("FILE", "URL")


def _prefix(raw: Column, prefix_map: Mapping[str, str]) -> Column:
    up = F.upper(raw)
    for alias, to in prefix_map.items():
        up = F.when(F.upper(raw) == alias.upper(), F.lit(to.upper())).otherwise(up)
    return F.when(up.isin(*LOWER), F.lower(up)).otherwise(up)


def parse_reference_id(reference_id: Column, prefix_map: Mapping[str, str] | None = None) -> Column:
    """struct(prefix, identifier): a bare URL is url, bare digits are PMID, the rest without a prefix is UNKNOWN."""
    raw = F.trim(reference_id)
    prefix, rest = F.regexp_extract(raw, _ID, 1), F.trim(F.regexp_extract(raw, _ID, 2))
    return (
        F.when(raw.rlike(r"^https?://"), F.struct(F.lit("url").alias("prefix"), raw.alias("identifier")))
        .when(raw.rlike(_ID), F.struct(_prefix(prefix, prefix_map or {}).alias("prefix"), rest.alias("identifier")))
        .when(raw.rlike(r"^[0-9]+$"), F.struct(F.lit("PMID").alias("prefix"), raw.alias("identifier")))
        .otherwise(F.struct(F.lit("UNKNOWN").alias("prefix"), raw.alias("identifier")))
    )


def normalize_reference_id(reference_id: Column, prefix_map: Mapping[str, str] | None = None) -> Column:
    p = parse_reference_id(reference_id, prefix_map)
    return F.when(p["prefix"] == "UNKNOWN", p["identifier"]).otherwise(F.concat(p["prefix"], F.lit(":"), p["identifier"]))


def skip_prefix(reference_id: Column) -> Column:
    """The prefix that the skip list is asked for: of the id as given; empty without a colon."""
    return F.when(F.contains(reference_id, F.lit(":")), F.upper(F.split_part(reference_id, F.lit(":"), F.lit(1)))).otherwise("")


def is_skipped(reference_id: Column, skip_prefixes: Sequence[str]) -> Column:
    prefix = skip_prefix(reference_id)
    return (prefix != "") & prefix.isin(*[p.upper() for p in skip_prefixes]) if skip_prefixes else F.lit(False)


def cache_name(reference_id: Column, suffix: str = ".md") -> Column:
    return F.concat(F.translate(reference_id, ":/?=", "____"), F.lit(suffix))


#: Sources in the order in which they are asked, with what they take.
SOURCES: tuple[tuple[str, str], ...] = (
    ("PMID", r"(?i)^(pmid[:\s].*|[0-9]+)$"),
    ("DOI", r"(?i)^doi[:\s]"),
    ("PPR", r"(?i)^ppr[:\s]?"),
    ("file", r"(?i)^file[:\s]"),
    ("url", r"(?i)^(url[:\s]|https?://)"),
    ("GEO", r"(?i)^(geo[:\s]|(GSE|GDS)[0-9]+$)"),
    ("BIOPROJECT", r"(?i)^(bioproject[:\s]|PRJ[A-Z]{2}[0-9]+$)"),
    ("BIOSAMPLE", r"(?i)^(biosample[:\s]|SAM[A-Z]+[0-9]+$)"),
    ("clinicaltrials", r"(?i)^(clinicaltrials[:\s]|NCT[0-9]{8}$)"),
)


def source_of(reference_id: Column, custom: Sequence[tuple[str, Sequence[str]]] = ()) -> Column:
    """Name of the first source that takes the id; custom (prefix, id patterns) come last; null without one."""
    raw, found = F.trim(reference_id), None
    rules = [*SOURCES, *((p, "|".join([rf"(?i)^{p}[:\s]", *(f"(?:{x})" for x in patterns)])) for p, patterns in custom)]
    for name, pattern in rules:
        hit = raw.rlike(pattern)
        found = F.when(hit, name) if found is None else found.when(hit, name)
    return found.otherwise(F.lit(None).cast("string"))


def build_identifiers(reference_id: Column, doi: Column | None = None, is_preprint: Column | None = None) -> Column:
    """struct(doi, pmid, pmcid, url, pprid, is_preprint) for the full-text chain."""
    p = parse_reference_id(reference_id)
    slot = lambda name: F.when(p["prefix"] == name, p["identifier"])
    pprid = F.when(p["prefix"] == "PPR", F.concat(F.lit("PPR"), F.regexp_replace(p["identifier"], "(?i)^PPR", "")))
    return F.struct(
        F.coalesce(slot("DOI"), doi if doi is not None else F.lit(None).cast("string")).alias("doi"),
        slot("PMID").alias("pmid"),
        F.coalesce(slot("PMC"), slot("PMCID")).alias("pmcid"),
        slot("url").alias("url"),
        pprid.alias("pprid"),
        (is_preprint if is_preprint is not None else F.lit(None).cast("boolean")).alias("is_preprint"),
    )
