"""End-to-end plans: read claims and references, decide, report, write back."""

from __future__ import annotations

import json
import shutil
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.functions import ids
from claimlens.operators import extract
from claimlens.operators.repair import repair
from claimlens.operators.report import files_report, repair_report, validation_report
from claimlens.operators.validate import failures, validate, validate_typed
from claimlens.plans.config import RepairConfig, ValidationConfig
from claimlens.plans.stage import staged


def with_ids(claims: DataFrame) -> DataFrame:
    """Claims with a claim_id from what they are, so that a retried task gives the same one.
    Where a file says the same twice in one place, two claims share an id."""
    return claims.select("*", F.xxhash64(*[F.col(c) for c in ("file", "path", "supporting_text", "reference_id", "expected_title")]).alias("claim_id"))


def _files_of(claims: DataFrame) -> DataFrame:
    """(claim_id, file), each claim_id once: it tells the file."""
    return claims.select("claim_id", "file").dropDuplicates(["claim_id"])


def claims_of(spark: SparkSession, path: str, target_class: str | None = None, schema: Mapping | None = None) -> DataFrame:
    """Claims of nested YAML or JSON files, one row each; null paths mark unreadable files."""
    documents = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return with_ids(extract.nested_claims(documents, target_class, schema))


def validate_data(spark: SparkSession, path: str, refs: DataFrame, config: ValidationConfig | None = None, target_class: str | None = None, schema: Mapping | None = None) -> dict[str, DataFrame]:
    """results, findings (failures only), files (findings per file) and report of data files.
    By schema, instances that have a title and a reference but no quote have their title validated."""
    claims = claims_of(spark, path, target_class, schema)
    readable = claims.where("path is not null")
    results = validate_typed(readable, refs, config) if target_class else validate(readable, refs, config)
    results = staged(results)  # four tables are made of them
    found = failures(results)
    per_file = files_report(results.where("not is_valid").join(_files_of(readable), "claim_id"), claims)
    return {"results": results, "findings": found, "files": per_file, "report": validation_report(results), "unreadable": claims.where("path is null").select("file")}


def validate_text_file(spark: SparkSession, path: str, refs: DataFrame, config: ValidationConfig | None = None) -> DataFrame:
    """Results for the claims that annotated text lines hold."""
    lines = extract.claims_from_lines(extract.text_lines(spark, path), config)
    claims = lines.select(F.xxhash64("file", "line_number", "supporting_text", "reference_id").alias("claim_id"), "supporting_text", "reference_id", F.lit(None).cast("string").alias("expected_title"), F.concat_ws(":", "file", "line_number").alias("path"))
    return validate(claims, refs, config)


def unresolved(claims: DataFrame, refs: DataFrame, config: ValidationConfig | None = None) -> DataFrame:
    """The fetch worklist: normal ids that claims name and the store lacks, with their source, each once."""
    config = config or ValidationConfig()
    key = ids.normalize_reference_id(F.col("reference_id"), config.reference_prefix_map)
    wanted = claims.where(~ids.is_skipped(F.col("reference_id"), config.skip_prefixes)).select(key.alias("reference_id")).where("reference_id <> ''").distinct()
    known = refs.select(key.alias("reference_id"))
    return wanted.join(known, "reference_id", "left_anti").withColumn("source", ids.source_of(F.col("reference_id")))


def _set(node, path: str, value: str) -> bool:
    """Replace the quote of the mapping at a path, or the string there; '' is the root."""
    keys: list = []
    for part in filter(None, path.split(".")):
        name, *indices = part.split("[")
        keys += [name] if name else []
        keys += [int(i.rstrip("]")) for i in indices]
    try:
        for k in keys[:-1]:
            node = node[k]
        last = node[keys[-1]] if keys else node
        if isinstance(last, str):
            node[keys[-1]] = value
            return True
        slot = next((s for s in ("supporting_text", "snippet") if last.get(s)), None)
    except (KeyError, IndexError, TypeError, AttributeError):
        return False
    if slot:
        last[slot] = value
    return slot is not None


def apply_repairs(documents: DataFrame, fixes: DataFrame) -> DataFrame:
    """(file, value, applied): documents (file, value: YAML or JSON text) with the fixes
    (file, path, repaired_text) of each written into its tree. Fixes meet in one row per file."""
    import pandas as pd

    per_file = fixes.groupBy("file").agg(F.to_json(F.collect_list(F.struct("path", "repaired_text"))).alias("fixes"))
    j = documents.join(per_file, "file").select("file", "value", "fixes")

    def run(batches):
        import yaml

        for batch in batches:
            rows = []
            for file, value, found in zip(batch["file"], batch["value"], batch["fixes"], strict=True):
                is_json = file.endswith(".json")
                tree = json.loads(value) if is_json else yaml.safe_load(value)
                done = sum(_set(tree, f["path"], f["repaired_text"]) for f in json.loads(found))
                text = json.dumps(tree, indent=2, ensure_ascii=False) if is_json else yaml.safe_dump(tree, allow_unicode=True, sort_keys=False)
                rows.append((file, text, done))
            yield pd.DataFrame(rows, columns=["file", "value", "applied"])

    return j.mapInPandas(run, "file string, value string, applied long")


def automatic_fixes(results: DataFrame, claims: DataFrame, threshold: float | None = None) -> DataFrame:
    """(file, path, repaired_text) of repaired claims whose action may be applied unseen;
    with a threshold, of at least that score."""
    good = lambda a: a["can_auto_fix"] & (a["similarity_score"] >= threshold if threshold is not None else F.lit(True))
    fixed = results.where(F.col("is_repaired") & F.exists("actions", good)).select("claim_id", "repaired_text")
    return fixed.dropDuplicates(["claim_id"]).join(claims.select("claim_id", "file", "path").dropDuplicates(["claim_id"]), "claim_id").select("file", "path", "repaired_text")


def repair_data(spark: SparkSession, path: str, refs: DataFrame, config: RepairConfig | None = None, validation: ValidationConfig | None = None) -> dict[str, DataFrame]:
    """results, report and changed documents of data files; writes nothing."""
    config = config or RepairConfig()
    claims = claims_of(spark, path).where("path is not null")
    results = repair(claims, refs, config, validation)
    documents = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return {"results": results, "report": repair_report(results), "changed": apply_repairs(documents, automatic_fixes(results, claims))}


def write_back(changed: DataFrame, backup: bool = True) -> int:
    """Write changed documents over their files, keeping .bak copies; number of files. Tasks
    write, to files that all executors share; one that runs again finds its work done."""

    def run(batches):
        for batch in batches:
            for file, value in zip(batch["file"], batch["value"], strict=True):
                target = Path(file.removeprefix("file:").replace("//", "/", 1))
                if target.read_text(encoding="utf-8") != value:
                    if backup:
                        shutil.copyfile(target, f"{target}.bak")
                    part = target.with_name(f"{target.name}.part")
                    part.write_text(value, encoding="utf-8")
                    part.replace(target)
            yield batch[["file"]]

    return changed.select("file", "value").mapInPandas(run, "file string").count()
