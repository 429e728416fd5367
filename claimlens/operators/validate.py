"""Strict validation of quotes and titles against reference documents.

claims: claim_id, supporting_text, reference_id, expected_title, path
references: reference_id, title, content, content_type (one row per normal id)

Documents that claims name are normalised once each, before the join; the verdict is a
predicate over the joined row, so nothing leaves the JVM. Documents that more than MANY claims
name aren't joined to each of them: the parts of their quotes are searched together. Only
failures go on to the fuzzy search. Claims are rows: where a claim_id repeats, so do its results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.functions import ids, text
from claimlens.operators.fuzzy_search import fuzzy_search
from claimlens.operators.quote_parts import held_parts
from claimlens.plans.config import ValidationConfig
from claimlens.plans.stage import staged

MATCH = "struct<found:boolean,similarity_score:double,matched_text:string,match_location:string,error_message:string,suggested_fix:string,best_match:string>"

#: Claims of a document from which on their quotes are searched together.
MANY = 256


def keyed_references(refs: DataFrame, config: ValidationConfig) -> DataFrame:
    """References by normal id, with their normalised text."""
    return refs.select(
        ids.normalize_reference_id(F.col("reference_id"), config.reference_prefix_map).alias("ref_key"),
        F.col("title").alias("ref_title"),
        "content_type",
        (F.coalesce(F.length("content"), F.lit(0)) > 0).alias("has_content"),
        F.coalesce(text.normalize_text(F.col("content")), F.lit("")).alias("content_norm"),
        F.coalesce(text.normalize_text(F.col("title")), F.lit("")).alias("title_norm"),
        F.lit(True).alias("known"),
    )


def _asked_references(refs: DataFrame, keyed: DataFrame, config: ValidationConfig) -> DataFrame:
    """The references that claims name, normalised only after the others are gone (a stream
    can name any)."""
    if keyed.isStreaming:
        return keyed_references(refs, config)
    key = ids.normalize_reference_id(F.col("reference_id"), config.reference_prefix_map)
    asked = keyed.where(~F.col("skipped")).select(F.col("ref_key").alias("_asked")).distinct()
    return keyed_references(refs.join(asked, key == F.col("_asked"), "left_semi"), config)


def _keyed_claims(claims: DataFrame, config: ValidationConfig) -> DataFrame:
    skipped = ids.is_skipped(F.col("reference_id"), config.skip_prefixes)
    # Skipped claims meet nothing; a key of their own keeps them from piling up under null.
    own = F.concat(F.lit("\u0000"), F.xxhash64("claim_id").cast("string"))
    key = ids.normalize_reference_id(F.col("reference_id"), config.reference_prefix_map)
    return claims.withColumn("skipped", skipped).withColumn("ref_key", F.when(skipped, own).otherwise(F.coalesce(key, own)))


def _slim(refs: DataFrame) -> DataFrame:
    return refs.select("ref_key", "ref_title", "title_norm", "content_type", "has_content", "known")


def _with_missing(claims: DataFrame, refs: DataFrame, many: int) -> DataFrame:
    """Keyed claims with what is known of their document, and `missing`: the first part of the
    quote that it doesn't contain."""
    lacks = text.first_missing(F.col("content_norm"), F.col("parts"))
    joined = lambda c, r: c.join(r, "ref_key", "left").withColumn("missing", lacks).drop("content_norm")
    if claims.isStreaming:
        return joined(claims, refs)
    often = staged(claims.where(~F.col("skipped")).groupBy("ref_key").agg(F.count("*").alias("n")).where(F.col("n") > many).select("ref_key"))
    if often.isEmpty():
        return joined(claims, refs)
    few = claims.join(often, "ref_key", "left_anti")
    crowd = staged(claims.join(often, "ref_key", "left_semi").withColumn("_row", F.monotonically_increasing_id()))
    parts = crowd.select("_row", "ref_key", F.posexplode("parts").alias("pos", "said")).withColumn("part", text.normalize_text(F.col("said")))
    own = staged(refs.join(often, "ref_key", "left_semi"))
    held = held_parts(parts.select("ref_key", "part"), own.select("ref_key", F.col("content_norm").alias("text")))
    lost = parts.join(held, ["ref_key", "part"], "left_anti").groupBy("_row").agg(F.min_by("said", "pos").alias("missing"))
    crowd = crowd.join(_slim(own), "ref_key", "left").join(lost, "_row", "left").drop("_row")
    return joined(few, refs).unionByName(crowd)


def _quoted(before: str, value: Column, after: str = "") -> Column:
    return F.concat(F.lit(before), F.coalesce(value, F.lit("None")), F.lit(after))


def validate(claims: DataFrame, refs: DataFrame, config: ValidationConfig | None = None, suggest: bool = True, many: int = MANY) -> DataFrame:
    """One row per claim: claim_id, is_valid, reference_id, supporting_text, severity,
    message, match (struct, null where no text was compared), path.

    A quote is valid if all its parts occur in the normalised content, in any order. With
    `suggest`, failures get the closest sentence; that never makes a claim valid."""
    config = config or ValidationConfig()
    c = _keyed_claims(claims, config).withColumn("parts", text.split_query(F.col("supporting_text"), config.literal_bracket_patterns))
    j = _with_missing(c, _asked_references(refs, c, config), many)
    rid = F.col("reference_id")
    compared = F.col("known") & F.col("has_content")
    found = (F.size("parts") > 0) & F.col("missing").isNull()
    wanted = F.coalesce(F.col("expected_title") != "", F.lit(False))
    title_ok = ~(wanted & (F.coalesce(F.col("ref_title"), F.lit("")) != "")) | (text.normalize_text(F.col("expected_title")) == F.col("title_norm"))
    error = F.when(F.size("parts") == 0, "Query is empty after removing brackets and splitting").otherwise(
        _quoted("Text part not found as substring: '", F.col("missing"), "'")
    )
    j = j.withColumn("compared", ~F.col("skipped") & F.coalesce(compared, F.lit(False))).withColumn("found", F.col("compared") & F.coalesce(found, F.lit(False)))
    j = j.withColumn("title_ok", F.coalesce(title_ok, F.lit(True))).withColumn("error", F.when(F.col("compared") & ~F.col("found"), error))
    valid = F.col("skipped") | (F.col("found") & F.col("title_ok"))
    note = F.when(~F.col("found") & (F.col("content_type") == "abstract_only"), _quoted(" (note: only abstract available for ", rid, ", full text may contain this excerpt)")).otherwise("")
    mismatch = F.concat(_quoted("Title mismatch: expected '", F.col("expected_title"), "'"), _quoted(" but got '", F.col("ref_title"), "'"))
    message = (
        F.when(F.col("skipped"), F.concat(_quoted("Skipping validation for reference with prefix '", ids.skip_prefix(rid), "': "), rid))
        .when(F.col("known").isNull(), _quoted("Could not fetch reference: ", rid))
        .when(~F.col("has_content"), _quoted("No content available for reference: ", rid))
        .when(~F.col("title_ok"), F.concat(mismatch, note))
        .when(~F.col("found"), F.concat("error", note))
        .otherwise(F.concat(_quoted("Supporting text validated successfully in ", rid), F.when(wanted, ", title validated").otherwise("")))
    )
    level = F.when(valid, "INFO").when(F.col("known").isNull() & ~F.col("skipped"), config.unknown_prefix_severity).otherwise("ERROR")
    j = j.select("claim_id", valid.alias("is_valid"), "reference_id", "supporting_text", level.alias("severity"), message.alias("message"), "compared", "found", F.when(F.col("found"), F.array_join("parts", " ... ")).alias("matched_text"), "error", "path", "ref_key")
    none = F.lit(None).cast("string")
    if suggest:
        j = staged(j.withColumn("_row", F.monotonically_increasing_id()))
        failed = j.where(F.col("compared") & ~F.col("found") & F.col("error").startswith("Text part")).select("_row", F.col("supporting_text").alias("query"), "ref_key")
        contents = refs.select(ids.normalize_reference_id(F.col("reference_id"), config.reference_prefix_map).alias("ref_key"), "content")
        contents = staged(contents.join(failed.select("ref_key").distinct(), "ref_key", "left_semi"))
        best = fuzzy_search(failed, contents, threshold=config.suggest_threshold, key="_row").select("_row", "score", F.col("best_match").alias("closest"), suggested_fix(F.col("query"), F.col("best_match"), F.col("score")).alias("fix"))
        j = j.join(best, "_row", "left")
    else:
        j = j.withColumns({"score": F.lit(0.0), "closest": none, "fix": none})
    match = F.struct(
        "found",
        F.when(F.col("found"), 1.0).otherwise(F.coalesce(F.col("score"), F.lit(0.0)) / 100).alias("similarity_score"),
        "matched_text",
        none.alias("match_location"),
        F.col("error").alias("error_message"),
        F.col("fix").alias("suggested_fix"),
        F.col("closest").alias("best_match"),
    )
    return j.select("claim_id", "is_valid", "reference_id", "supporting_text", "severity", "message", F.when(F.col("compared"), match).alias("match"), "path")


def suggested_fix(query: Column, best: Column, score: Column) -> Column:
    """What to try instead of a failed quote, by how close the closest sentence is."""
    percent = F.concat(F.lit("("), F.bround(score, 0).cast("int").cast("string"), F.lit("%)"))
    ending = _quoted('"', best, '"')
    return F.when(
        best.isNotNull() & (score > 70),
        F.when((score > 90) & (F.lower(query) == F.lower(best)), F.concat(F.lit("Capitalization differs - try: "), ending))
        .when(score > 90, F.concat(F.lit("Very close match "), percent, F.lit(" - try: "), ending))
        .otherwise(F.concat(F.lit("Partial match found "), percent, F.lit(": "), ending)),
    )


def validate_title(claims: DataFrame, refs: DataFrame, config: ValidationConfig | None = None) -> DataFrame:
    """One row per claim with its expected_title held against the reference's: equal after
    normalisation, not contained. claim_id, is_valid, reference_id, severity, message, path."""
    config = config or ValidationConfig()
    c = _keyed_claims(claims, config)
    slim = _asked_references(refs.withColumn("content", F.lit(None).cast("string")), c, config).select("ref_key", "ref_title", "title_norm", "known")
    j = c.join(slim, "ref_key", "left")
    rid = F.col("reference_id")
    equal = text.normalize_text(F.col("expected_title")) == F.col("title_norm")
    untitled = F.coalesce(F.col("ref_title"), F.lit("")) == ""
    message = (
        F.when(F.col("skipped"), F.concat(_quoted("Skipping title validation for reference with prefix '", ids.skip_prefix(rid), "': "), rid))
        .when(F.col("known").isNull(), _quoted("Could not fetch reference: ", rid))
        .when(untitled, _quoted("Reference ", rid, " has no title to validate against"))
        .when(equal, _quoted("Title validated successfully for ", rid))
        .otherwise(F.concat(_quoted("Title mismatch for ", rid, ": "), _quoted("expected '", F.col("expected_title"), "'"), _quoted(" but got '", F.col("ref_title"), "'")))
    )
    valid = F.col("skipped") | F.coalesce(F.col("known") & ~untitled & equal, F.lit(False))
    level = F.when(valid, "INFO").when(F.col("known").isNull(), config.unknown_prefix_severity).otherwise("ERROR")
    return j.select("claim_id", valid.alias("is_valid"), "reference_id", level.alias("severity"), message.alias("message"), "path")


def validate_typed(claims: DataFrame, refs: DataFrame, config: ValidationConfig | None = None, suggest: bool = True) -> DataFrame:
    """validate() for claims of a quote and validate_title() for claims of a title alone (`kind`
    is 'title'), in one result with that column. A null kind is a quote."""
    title = F.coalesce(F.col("kind") == "title", F.lit(False))
    quotes = validate(claims.where(~title), refs, config, suggest).withColumn("kind", F.lit("excerpt"))
    none = {"supporting_text": F.lit(None).cast("string"), "match": F.lit(None).cast(MATCH), "kind": F.lit("title")}
    return quotes.unionByName(validate_title(claims.where(title), refs, config).withColumns(none).select(quotes.columns))


def failures(results: DataFrame, instance: Column | None = None) -> DataFrame:
    """Failed results as findings: type, severity, message, instance, instantiates, path."""
    found = results.where(~F.col("is_valid"))
    return found.select(F.lit("reference_validation").alias("type"), F.col("severity"), "message", (instance if instance is not None else F.col("supporting_text")).alias("instance"), F.col("reference_id").alias("instantiates"), "path")
