"""Counts over validation and repair results, and their text form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F


def _validation_counts() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("total_validations"),
        F.count_if("is_valid").alias("valid_count"),
        F.count_if(~F.col("is_valid")).alias("invalid_count"),
        F.count_if(F.col("severity") == "ERROR").alias("error_count"),
        F.count_if(F.col("severity") == "WARN").alias("warning_count"),
        (F.count_if(F.col("severity") == "ERROR") == 0).alias("is_valid"),
    ]


def validation_report(results: DataFrame) -> DataFrame:
    """One row of counts; is_valid if there is no error (warnings pass)."""
    return results.agg(*_validation_counts())


def with_validation_report(results: DataFrame) -> tuple[DataFrame, Observation]:
    """The results, and their report, which is filled in while they are written or collected:
    `.get` then has it as a dictionary. No further pass over the claims is made for it."""
    observation = Observation("validation_report")
    return results.observe(observation, *_validation_counts()), observation


def files_report(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Per file, how many findings it has; files without any count 0."""
    return files.select("file").distinct().join(findings.groupBy("file").agg(F.count("*").alias("results")), "file", "left").fillna(0, ["results"])


def _repair_counts() -> list[Column]:
    has = lambda cond: F.exists("actions", cond)
    return [
        F.count(F.lit(1)).alias("total_items"),
        F.count_if("was_valid").alias("already_valid_count"),
        F.count_if("is_repaired").alias("repaired_count"),
        F.count_if(F.col("is_repaired") & has(lambda a: a["can_auto_fix"])).alias("auto_fixed_count"),
        F.count_if(~F.col("was_valid") & has(lambda a: a["confidence"] == "MEDIUM")).alias("suggested_count"),
        F.count_if(has(lambda a: a["action_type"] == "REMOVAL")).alias("removal_count"),
        F.count_if(has(lambda a: a["action_type"] == "UNVERIFIABLE")).alias("unverifiable_count"),
    ]


def repair_report(results: DataFrame) -> DataFrame:
    """One row of counts over repair results."""
    return results.agg(*_repair_counts())


def with_repair_report(results: DataFrame) -> tuple[DataFrame, Observation]:
    """As with_validation_report(), for repair results."""
    observation = Observation("repair_report")
    return results.observe(observation, *_repair_counts()), observation


def repair_sections(results: DataFrame) -> DataFrame:
    """One row per action with the report section it belongs to: fixes, suggestions,
    removals or unverifiable; other actions belong to none."""
    a = results.where(~F.col("was_valid")).select("claim_id", "reference_id", "path", F.posexplode("actions").alias("ord", "a"))
    section = F.when(F.col("a.can_auto_fix"), "fixes").when(F.col("a.action_type") == "REMOVAL", "removals").when(F.col("a.action_type") == "UNVERIFIABLE", "unverifiable").when(F.col("a.confidence") == "MEDIUM", "suggestions")
    return a.withColumn("section", section).where("section is not null").select("section", "claim_id", "reference_id", "path", "ord", F.col("a").dropFields("reference_id").alias("a")).select("section", "claim_id", "reference_id", "path", "ord", "a.*")


_TITLES = (
    ("fixes", "HIGH CONFIDENCE FIXES (auto-applicable):"),
    ("suggestions", "SUGGESTED FIXES (review recommended):"),
    ("removals", "RECOMMENDED REMOVALS (low confidence):"),
    ("unverifiable", "UNVERIFIABLE (no abstract available):"),
)


_COUNTS = (("Total items", "total_items"), ("Already valid", "already_valid_count"), ("Auto-fixes", "auto_fixed_count"), ("Suggestions", "suggested_count"), ("Removals", "removal_count"), ("Unverifiable", "unverifiable_count"))


def _lines_of_actions(sections: DataFrame, verbose: bool) -> DataFrame:
    """Each action as an array of report lines."""
    cut = lambda c, n: F.concat(F.substring(F.col(c), 1, n), F.lit("..."))
    name = F.col("section")
    head = F.concat(F.lit("  "), F.coalesce("reference_id", F.lit("None")), F.when(F.coalesce("path", F.lit("")) != "", F.concat(F.lit(" at "), "path")).otherwise(""), F.lit(":"))
    percent = F.concat(F.lit("    Similarity: "), F.bround(F.col("similarity_score") * 100, 0).cast("int").cast("string"), F.lit("%"))
    snippet = F.concat(F.lit("    Snippet: '"), cut("original_text", 60), F.lit("'"))
    change = F.concat(F.lit("    '"), cut("original_text", 50), F.lit("' → '"), F.coalesce(cut("repaired_text", 50), F.lit("N/A...")), F.lit("'"))
    suggestion = F.concat(F.lit("    Suggestion: '"), cut("repaired_text", 80), F.lit("'"))
    more = F.when(name == "fixes", change).when((name == "suggestions") & F.lit(verbose) & (F.col("repaired_text") != ""), suggestion)
    other = F.array_compact(F.array(head, F.concat(F.lit("    "), F.col("description")), more))
    return sections.select("section", "claim_id", "ord", F.when(name == "removals", F.array(head, percent, snippet)).otherwise(other).alias("lines"))


def report_lines(results: DataFrame, lines_per_section: int | None = None, verbose: bool = False) -> DataFrame:
    """The report as a table of its lines, in order: (part, place, claim_id, ord, n, line), sorted
    by these. All actions by claim, or the first lines_per_section of each section and how many
    more there are. Nothing is gathered; the sort is a range partitioning."""
    sections = repair_sections(results)
    part = F.array_position(F.array(*[F.lit(n) for n, _ in _TITLES]), F.col("section")).cast("int")
    actions = _lines_of_actions(sections, verbose).withColumn("part", part)
    sizes = actions.groupBy("part").agg(F.count("*").alias("size"))
    if lines_per_section is not None:
        order = Window.partitionBy("part").orderBy("claim_id", "ord")
        actions = actions.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= lines_per_section)
    null = F.lit(None).cast("long")
    titles = F.element_at(F.array(*[F.lit(t) for _, t in _TITLES]), F.col("part"))
    body = actions.select("part", F.lit(1).alias("place"), F.col("claim_id").cast("long").alias("claim_id"), "ord", F.posexplode("lines").alias("n", "line"))
    fixed = lambda df, place, lines: df.select("part", F.lit(place).alias("place"), null.alias("claim_id"), F.lit(0).alias("ord"), F.posexplode(lines).alias("n", "line"))
    limit = F.lit(lines_per_section if lines_per_section is not None else 2**31 - 1)
    ends = F.array_compact(F.array(F.when(F.col("size") > limit, F.concat(F.lit("  ... and "), (F.col("size") - limit).cast("string"), F.lit(" more"))), F.lit("")))
    summary = F.array(F.lit("-" * 60), F.lit("Summary:"), *[F.concat(F.lit(f"  {label}: "), F.col(c).cast("string")) for label, c in _COUNTS])
    head = F.array(*[F.lit(x) for x in ("=" * 60, "Repair Report", "=" * 60, "")])
    totals = repair_report(results)
    every = [body, fixed(sizes, 0, F.array(titles)), fixed(sizes, 2, ends), fixed(totals.withColumn("part", F.lit(0)), 0, head), fixed(totals.withColumn("part", F.lit(9)), 0, summary)]
    return reduce(DataFrame.unionByName, every).orderBy("part", "place", "claim_id", "ord", "n")


def format_report(results: DataFrame, lines_per_section: int | None = None, verbose: bool = False) -> str:
    """The lines of report_lines() as one text, for a terminal: ask for few lines per section, or
    read the table's lines, where there may be many."""
    return "\n".join(r["line"] for r in report_lines(results, lines_per_section, verbose).toLocalIterator())
