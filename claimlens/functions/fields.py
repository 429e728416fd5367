"""Roles of schema slots, from their URIs and names."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What URIs of each role contain, and slot names without a URI that have it.
EXCERPT_PATTERNS = ("oa:exact", "oa#exact", "excerpt", "supporting_text")
REFERENCE_PATTERNS = ("dcterms:references", "dc/terms/references", "dcterms:source", "dc/terms/source", "authoritative_reference")
REFERENCE_TOKENS = ("reference", "references")
TITLE_PATTERNS = ("dcterms:title", "dc/terms/title")
PREFIXES = {"oa": "http://www.w3.org/ns/oa#", "dcterms": "http://purl.org/dc/terms/"}
FALLBACK_NAMES = {"excerpt": ("supporting_text",), "reference": ("reference", "reference_id"), "title": ("title",)}


def uri_tokens(uri: Column) -> Column:
    """Lower-case parts of a URI, split at camel case and at other than letters and digits."""
    spaced = F.regexp_replace(uri, "(?<=[a-z0-9])(?=[A-Z])", " ")
    return F.filter(F.split(F.lower(spaced), "[^a-z0-9]+"), lambda t: t != "")


def _contains_any(uri: Column, patterns: Sequence[str]) -> Column:
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.contains(F.lower(uri), F.lit(p.lower()))
    return F.coalesce(hit, F.lit(False))


def is_excerpt_uri(uri: Column) -> Column:
    return _contains_any(uri, EXCERPT_PATTERNS)


def is_reference_uri(uri: Column) -> Column:
    tokens = F.array(*[F.lit(t) for t in REFERENCE_TOKENS])
    return _contains_any(uri, REFERENCE_PATTERNS) | F.coalesce(F.arrays_overlap(uri_tokens(uri), tokens), F.lit(False))


def is_title_uri(uri: Column) -> Column:
    return F.coalesce(F.lower(uri) == "title", F.lit(False)) | _contains_any(uri, TITLE_PATTERNS)


def expand_curie(uri: Column, prefixes: Column) -> Column:
    """prefix:name by a map of prefixes; other values as they are."""
    base = F.element_at(prefixes, F.substring_index(uri, ":", 1))
    known = F.contains(uri, F.lit(":")) & base.isNotNull()
    return F.when(known, F.concat(base, F.substring(uri, F.instr(uri, F.lit(":")) + 1, F.length(uri)))).otherwise(uri)


def _as_is_or_expanded(test: Callable[[Column], Column], table: Column) -> Callable[[Column], Column]:
    return lambda uri: test(uri) | test(expand_curie(uri, table))


def slot_roles(implements: Column, slot_uri: Column, name: Column, prefixes: Mapping[str, str] | None = None) -> Column:
    """Array of (role, fallback) that a slot has: excerpt, reference and title are independent
    of each other, each by any URI that the slot implements or its own URI, as they are and
    expanded (fallback null), else by its name (fallback: its place among the names)."""
    table = F.create_map(*[F.lit(x) for kv in (prefixes or PREFIXES).items() for x in kv])
    uris = F.concat(F.coalesce(implements, F.array().cast("array<string>")), F.array_compact(F.array(slot_uri)))
    roles = []
    for kind, test in (("excerpt", is_excerpt_uri), ("reference", is_reference_uri), ("title", is_title_uri)):
        by_uri = F.exists(uris, _as_is_or_expanded(test, table))
        place = F.nullif(F.array_position(F.array(*[F.lit(n) for n in FALLBACK_NAMES[kind]]), name), F.lit(0))
        one = lambda fallback, kind=kind: F.struct(F.lit(kind).alias("role"), fallback.cast("int").alias("fallback"))
        roles.append(F.when(by_uri, one(F.lit(None))).when(place.isNotNull(), one(place)))
    return F.array_compact(F.array(*roles))


def class_slots(slots: DataFrame, prefixes: Mapping[str, str] | None = None) -> DataFrame:
    """(class, role, names) for slots (class, name, ord, implements, slot_uri): slots of a
    role by URI come first, in schema order, fallback names after them, in their own. A slot
    of several roles is in the list of each."""
    s = slots.withColumn("r", F.explode(slot_roles(F.col("implements"), F.col("slot_uri"), F.col("name"), prefixes)))
    late = F.coalesce("r.fallback", F.lit(0))
    return s.groupBy("class", "r.role").agg(F.transform(F.sort_array(F.collect_list(F.struct(late.alias("late"), "ord", "name"))), lambda x: x["name"]).alias("names"))
