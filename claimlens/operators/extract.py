"""Claims out of text and nested data."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimlens.operators.json_walk import json_claims, parsed_json
from claimlens.plans.config import ValidationConfig
from claimlens.plans.stage import staged

CLAIMS = "file string, path string, supporting_text string, reference_id string, expected_title string"


def claims_from_lines(lines: DataFrame, config: ValidationConfig | None = None) -> DataFrame:
    """(file, line_number, supporting_text, reference_id, original_line) for every match of
    the configured expression in lines (file, line_number, line)."""
    config = config or ValidationConfig()
    pattern = F.lit(config.supporting_text_regex)
    both = F.arrays_zip(
        F.regexp_extract_all("line", pattern, F.lit(config.text_group)).alias("supporting_text"),
        F.regexp_extract_all("line", pattern, F.lit(config.ref_group)).alias("reference_id"),
    )
    found = lines.where(F.col("line").rlike(config.supporting_text_regex)).select("file", "line_number", F.explode(both).alias("m"), F.regexp_replace("line", r"\s+$", "").alias("original_line"))
    return found.select("file", "line_number", F.col("m")["supporting_text"].alias("supporting_text"), F.col("m")["reference_id"].alias("reference_id"), "original_line")


def text_lines(spark: SparkSession, path: str, text: Column | None = None) -> DataFrame:
    """(file, line_number from 1, line) of text files. Files of any size are read in splits, line
    by line; the counts of the splits before a line's own make its number.

    With `text`, an expression over `file`, files of one value are the parts of one text: its
    lines are numbered through them in the order of their names, and `file` is that value."""
    at = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    lines = staged(at)  # the same ids for the counts and for the lines
    splits = lines.groupBy("file", "split").agg(F.min("id").alias("first"), F.count("*").alias("n")).withColumn("text", F.col("file") if text is None else text)
    before = F.sum("n").over(Window.partitionBy("text").orderBy("file", "split").rowsBetween(Window.unboundedPreceding, -1))
    splits = staged(splits.select("file", "split", "text", (F.coalesce(before, F.lit(0)) - F.col("first") + 1).alias("shift")))  # few rows: broadcast by their size
    return lines.join(splits, ["file", "split"]).select(F.col("text").alias("file"), (F.col("id") + F.col("shift")).alias("line_number"), "line")


def _first(node: Mapping, *names: str):
    return next((node[n] for n in names if node.get(n)), None)


def _reference_id(value) -> str | None:
    if isinstance(value, dict):
        value = _first(value, "id", "reference_id")
    return value if isinstance(value, str) and value else None


def _title(value) -> str | None:
    return _first(value, "title", "reference_title") if isinstance(value, dict) else None


def _join(path: str, key: str) -> str:
    return f"{path}.{key}" if path else key


def walk_names(node, path: str = "") -> Iterator[tuple[str, str, str, str | None]]:
    """(path, text, reference id, title) of each mapping that has a quote and a reference by
    name, evidence lists before the other keys."""
    if isinstance(node, dict):
        text, ref = _first(node, "supporting_text", "snippet"), _first(node, "reference", "reference_id")
        if isinstance(text, str) and (rid := _reference_id(ref)):
            yield path, text, rid, _title(ref) or _title(node)
        keys = sorted(node, key=lambda k: k not in ("evidence", "has_evidence"))
        for key in keys:
            if isinstance(node[key], (dict, list)):
                yield from walk_names(node[key], _join(path, str(key)))
    elif isinstance(node, list):
        for k, child in enumerate(node):
            yield from walk_names(child, f"{path}[{k}]")


def _slot_values(node: Mapping, slots: Sequence[str]) -> Iterator[tuple[str, object]]:
    """The named slots that have something, in order; of lists, their items."""
    for slot in slots:
        for value in node[slot] if isinstance(node.get(slot), list) else [node.get(slot)]:
            if value:
                yield slot, value


def walk_schema(node, class_name: str, schema: Mapping, path: str = "") -> Iterator[tuple[str, str | None, str, str | None, str]]:
    """(path, text, reference id, title, kind) by schema: classes have `roles` (role to slot
    names) and `ranges` (slot to class); other keys aren't entered.

    Each quote of an instance is a claim, with the first reference that names an id; its title
    is that of the first title slot with one, else the reference's own. An instance without
    quotes whose first reference names an id claims that title alone (kind 'title')."""
    here = schema.get(class_name)
    if isinstance(node, list):
        for k, child in enumerate(node):
            yield from walk_schema(child, class_name, schema, f"{path}[{k}]")
        return
    if here is None or not isinstance(node, dict):
        return
    roles = here.get("roles", {})
    refs = [r for _, r in _slot_values(node, roles.get("reference", ()))]
    ref = next((r for r in refs if _reference_id(r)), None)
    titled = next(((slot, t) for slot, t in _slot_values(node, roles.get("title", ())) if isinstance(t, str)), None)
    quotes = [(slot, text) for slot, text in _slot_values(node, roles.get("excerpt", ())) if isinstance(text, str)]
    if ref is not None and quotes:
        for slot, text in quotes:
            yield _join(path, slot), text, _reference_id(ref), titled[1] if titled else _title(ref), "excerpt"
    elif titled and refs and _reference_id(refs[0]):
        yield _join(path, titled[0]), None, _reference_id(refs[0]), titled[1], "title"
    for slot, target in here.get("ranges", {}).items():
        if isinstance(node.get(slot), (dict, list)):
            yield from walk_schema(node[slot], target, schema, _join(path, slot))


def load_instances(text: str, file: str) -> list | None:
    """Instances of a YAML or JSON document: a list is many, a mapping one, else None."""
    import yaml

    try:
        data = json.loads(text) if file.endswith(".json") else yaml.safe_load(text)
    except (ValueError, yaml.YAMLError):
        return None
    return data if isinstance(data, list) else [data] if isinstance(data, dict) else None


def nested_claims(documents: DataFrame, target_class: str | None = None, schema: Mapping | None = None) -> DataFrame:
    """Claims of documents (file, value: YAML or JSON text); see CLAIMS. By schema if a target
    class is given, and then with their `kind` (excerpt or title), else by names. An unreadable
    document has one row with a null path."""
    made: DataFrame | None = None
    if target_class is None:
        # JSON is walked in the JVM; what its parser doesn't take, and YAML, in Python.
        parsed = staged(parsed_json(documents.where(F.col("file").endswith(".json"))))
        made = json_claims(parsed.where("node is not null"))
        documents = documents.where(~F.col("file").endswith(".json")).select("file", "value").unionByName(parsed.where("node is null").select("file", "value"))
        if documents.isEmpty():
            return made
    schema_of_rows = CLAIMS + (", kind string" if target_class else "")
    names = [c.split()[0] for c in schema_of_rows.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file, value in zip(batch["file"], batch["value"], strict=True):
                data = load_instances(value or "", file)
                if data is None:
                    rows.append((file, *[None] * (len(names) - 1)))
                    continue
                many = len(data) > 1
                for k, instance in enumerate(data):
                    start = f"[{k}]" if many else ""
                    found = walk_schema(instance, target_class, schema or {}, start) if target_class else walk_names(instance, start)
                    rows += [(file, *claim) for claim in found]
            yield pd.DataFrame(rows, columns=names, dtype=object)

    walked = documents.select("file", "value").mapInPandas(run, schema_of_rows)
    return walked if made is None else made.unionByName(walked)


def evidence_rows(df: DataFrame, items: str) -> DataFrame:
    """The same for a fixed layout, without Python: df's column `items` is an array of
    structs (supporting_text, reference_id); rows with both become claims, with their path."""
    out = df.select("file", F.posexplode_outer(items).alias("pos", "e"))
    path = F.concat(F.lit(f"{items}["), F.col("pos").cast("string"), F.lit("]"))
    return out.where("e.supporting_text <> '' and e.reference_id <> ''").select("file", path.alias("path"), "e.supporting_text", "e.reference_id")
