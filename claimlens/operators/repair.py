"""Repairs of failed quotes: an ordered cascade in which each step sees only what is left.

Missing reference, character normalisation, ellipsis insertion, closest sentence, removal.
The exact legs are Column expressions; only what survives them reaches the fuzzy search.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimlens.functions import ids, text
from claimlens.functions.fuzzy import token_sort_ratio_col
from claimlens.operators.fuzzy_search import fuzzy_search
from claimlens.operators.validate import validate
from claimlens.plans.config import RepairConfig, ValidationConfig
from claimlens.plans.stage import staged

ACTION = "struct<action_type:string,original_text:string,repaired_text:string,confidence:string,similarity_score:double,description:string,reference_id:string,can_auto_fix:boolean>"
#: Characters between two fragments up to which they count as contiguous.
GAP = 50
FRAGMENT_THRESHOLD = 90.0
ELLIPSIS_SCORE = 0.85


def _action(kind: str, repaired: Column, confidence: Column, score: Column, description: Column, with_id: bool = True) -> Column:
    rid = F.col("reference_id") if with_id else F.lit(None).cast("string")
    fix = text.can_auto_fix(F.lit(kind), confidence, repaired)
    return F.struct(
        F.lit(kind).alias("action_type"),
        F.col("query").alias("original_text"),
        repaired.cast("string").alias("repaired_text"),
        confidence.alias("confidence"),
        score.cast("double").alias("similarity_score"),
        description.alias("description"),
        rid.alias("reference_id"),
        fix.alias("can_auto_fix"),
    ).cast(ACTION)


def ellipsis_insertion(queries: DataFrame, contents: DataFrame, key: str = "claim_id", fuzzy: bool = True) -> DataFrame:
    """(key, repaired_text) for queries (key, query, ref_key) whose sentences all occur in the
    content, but apart: the sentences in the content's order, joined by ellipses.

    A sentence that doesn't occur as it stands may stand for one that matches by 90 (with
    `fuzzy`). Queries that have an ellipsis, occur as they are, are of one sentence, or lie
    within 50 characters from one to the next, have no row."""
    flat = contents.select("ref_key", text.normalize_whitespace(F.col("content")).alias("t_norm"))
    q = queries.where(~F.contains("query", F.lit("..."))).select(key, "query", "ref_key", text.split_fragments(F.col("query")).alias("fragments")).where(F.size("fragments") >= 2)
    q = q.join(flat, "ref_key").where(~F.contains("t_norm", text.normalize_whitespace(F.col("query"))))
    # Each fragment is looked for beside the text; the text itself isn't repeated for them.
    at = F.transform("fragments", lambda f: F.struct(f.alias("fragment"), F.position(text.normalize_whitespace(f), F.col("t_norm")).alias("pos"), F.length(text.normalize_whitespace(f)).alias("long")))
    parts = q.select(key, "ref_key", F.size("fragments").alias("n"), at.alias("f")).select(key, "ref_key", "n", F.posexplode("f").alias("ord", "f"))
    placed = parts.select(key, "ref_key", "ord", "f.fragment", "n", "f.pos", "f.long")
    if fuzzy:
        placed = staged(placed)
        lost = placed.where("pos = 0").select(F.struct(key, "ord").alias("part"), F.col("fragment").alias("query"), "ref_key")
        met = fuzzy_search(lost, contents, FRAGMENT_THRESHOLD, key="part").where("found").select(F.col(f"part.{key}").alias(key), F.col("part.ord").alias("ord"), text.normalize_whitespace(F.col("best_match")).alias("m_norm"))
        stand_in = placed.where("pos = 0").select(key, "ord", "ref_key").join(met, [key, "ord"]).join(flat, "ref_key").select(key, "ord", F.position("m_norm", "t_norm").alias("m_pos"), F.length("m_norm").alias("m_long"))
        placed = placed.join(stand_in, [key, "ord"], "left").withColumn("long", F.coalesce("m_long", "long")).withColumn("pos", F.coalesce("m_pos", "pos"))
    placed = placed.select(key, "ord", "fragment", "n", "pos", "long").where("pos > 0")
    order = Window.partitionBy(key).orderBy("pos", "ord")
    gaps = placed.withColumn("gap", F.col("pos") - F.lag(F.col("pos") + F.col("long")).over(order))
    whole = gaps.groupBy(key).agg(F.max("n").alias("n"), F.count("*").alias("met"), F.max("gap").alias("gap"), F.sort_array(F.collect_list(F.struct("pos", "ord", "fragment"))).alias("all"))
    return whole.where((F.col("met") == F.col("n")) & (F.col("gap") > GAP)).select(key, F.array_join(F.transform("all", lambda x: x["fragment"]), " ... ").alias("repaired_text"))


def attempt_repair(queries: DataFrame, contents: DataFrame, config: RepairConfig | None = None, literal_brackets: tuple[str, ...] = ()) -> DataFrame:
    """One row per failed quote of (claim_id, query, reference_id, ref_key), claim_ids being
    unique: claim_id, is_repaired, repaired_text, actions, message. contents: ref_key, content (null: unverifiable)."""
    config = config or RepairConfig()
    contents = contents.select("ref_key", "content")
    known = contents.where("content is not null").select("ref_key", text.normalize_text(F.col("content")).alias("content_norm"))
    j = queries.select("claim_id", "query", "reference_id", "ref_key").join(known, "ref_key", "left")
    mapped = text.character_mapping(F.col("query"), config.character_mappings)
    held = F.coalesce(F.col("content_norm"), F.lit(""))
    by_characters = F.col("content_norm").isNotNull() & (mapped != F.col("query")) & F.contains(held, text.normalize_text(mapped))
    j = staged(j.withColumn("mapped", mapped).withColumn("step", F.when(F.col("content_norm").isNull(), "unverifiable").when(by_characters, "characters").otherwise("search")))
    rest = j.where("step = 'search'").select("claim_id", "query", "reference_id", "ref_key", "content_norm")
    insert = ellipsis_insertion(rest, contents.where("content is not null"))
    insert = rest.join(insert, "claim_id").where(text.contains_all(F.col("content_norm"), text.split_query(F.col("repaired_text"), literal_brackets))).select("claim_id", F.col("repaired_text").alias("spaced"))
    rest = staged(rest.drop("content_norm").join(insert, "claim_id", "left"))
    fuzzy = fuzzy_search(rest.where("spaced is null"), contents.where("content is not null"), threshold=50.0).select("claim_id", "score", "best_match")
    rest = rest.join(fuzzy, "claim_id", "left")

    null = F.lit(None).cast("string")
    done = lambda repaired, ok, actions, message: F.struct(ok.alias("is_repaired"), repaired.cast("string").alias("repaired_text"), actions.alias("actions"), message.alias("message"))
    unverifiable = j.where("step = 'unverifiable'").select("claim_id", done(null, F.lit(False), F.array(_action("UNVERIFIABLE", null, F.lit("VERY_LOW"), F.lit(0.0), F.lit("No content available for reference"))), F.lit("Reference content not available - cannot verify")).alias("r"))
    alike = token_sort_ratio_col(text.normalize_whitespace(F.col("mapped")), text.normalize_whitespace(F.col("query"))) / 100
    characters = j.where("step = 'characters'").withColumn("alike", alike)
    characters = characters.select("claim_id", done(F.col("mapped"), F.lit(True), F.array(_action("CHARACTER_NORMALIZATION", F.col("mapped"), F.lit("HIGH"), F.col("alike"), F.lit("Character normalization fix"))), F.lit("Fixed via character normalization")).alias("r"))

    score = F.coalesce(F.col("score"), F.lit(0.0)) / 100
    percent = F.concat(F.bround(F.col("score"), 0).cast("int").cast("string"), F.lit("%)"))
    level = text.confidence(score)
    close = F.concat(F.when(F.col("score") >= 95, "Very close match (").when(F.col("score") >= 80, "Close match (").otherwise("Partial match ("), percent)
    fuzzy_action = _action("FUZZY_CORRECTION", F.col("best_match"), level, score, close, with_id=False)
    met = F.col("best_match").isNotNull()
    removal = _action("REMOVAL", null, F.lit("VERY_LOW"), score, F.lit("Text not found in reference - likely fabricated"))
    removed = ~met | (score < config.removal_threshold)
    actions = F.array_compact(F.array(F.when(met, fuzzy_action), F.when(removed, removal)))
    spaced = F.col("spaced").isNotNull()
    ellipsis = _action("ELLIPSIS_INSERTION", F.col("spaced"), F.lit("MEDIUM"), F.lit(ELLIPSIS_SCORE), F.lit("Inserted ellipsis between non-contiguous parts"))
    accepted = met & level.isin("HIGH", "MEDIUM")
    rest = rest.select(
        "claim_id",
        F.when(spaced, done(F.col("spaced"), F.lit(True), F.array(ellipsis), F.lit("Fixed via ellipsis insertion")))
        .when(accepted, done(F.col("best_match"), level == "HIGH", F.array(fuzzy_action), F.concat(F.lit("Suggested fix via fuzzy matching ("), percent)))
        .when(removed, done(null, F.lit(False), actions, F.lit("Flagged for removal - text not found in reference")))
        .otherwise(done(null, F.lit(False), actions, F.lit("Could not find a suitable repair")))
        .alias("r"),
    )
    return unverifiable.unionByName(characters).unionByName(rest).select("claim_id", "r.*")


def repair(claims: DataFrame, refs: DataFrame, config: RepairConfig | None = None, validation: ValidationConfig | None = None) -> DataFrame:
    """One row per claim: claim_id, reference_id, original_text, was_valid, is_repaired,
    repaired_text, actions, message, path. Valid and skipped claims have no actions. Claims are
    rows: where a claim_id repeats, so do its results."""
    config, validation = config or RepairConfig(), validation or ValidationConfig()
    rid = F.col("reference_id")
    listed = rid.isin(*config.skip_references) if config.skip_references else F.lit(False)
    checked = validate(claims, refs, validation, suggest=False).select("claim_id", "is_valid", "reference_id", "supporting_text", "path").withColumn("listed", F.coalesce(listed, F.lit(False)))
    checked = staged(checked.withColumn("_row", F.monotonically_increasing_id()))
    key = ids.normalize_reference_id(rid, validation.reference_prefix_map)
    failed = checked.where("not is_valid and not listed").select(F.col("_row").alias("claim_id"), F.col("supporting_text").alias("query"), "reference_id", F.coalesce(key, F.lit("")).alias("ref_key"))
    # What failures name is far less than the store, and is read several times.
    contents = staged(refs.select(key.alias("ref_key"), "content").join(failed.select("ref_key").distinct(), "ref_key", "left_semi"))
    tried = attempt_repair(failed, contents, config, validation.literal_bracket_patterns)
    j = checked.join(tried.withColumnRenamed("claim_id", "_row"), "_row", "left")
    message = F.when(F.col("listed"), F.concat(F.lit("Skipped - reference "), rid, F.lit(" is in skip list"))).when(F.col("is_valid"), "Already valid").otherwise(F.col("message"))
    actions = F.coalesce("actions", F.array().cast(f"array<{ACTION}>"))
    if config.trusted_low_similarity:
        actions = F.when(rid.isin(*config.trusted_low_similarity), F.filter(actions, lambda a: a["action_type"] != "REMOVAL")).otherwise(actions)
    return j.select("claim_id", "reference_id", F.col("supporting_text").alias("original_text"), (F.col("is_valid") & ~F.col("listed")).alias("was_valid"), F.coalesce("is_repaired", F.lit(False)).alias("is_repaired"), "repaired_text", actions.alias("actions"), message.alias("message"), "path")
