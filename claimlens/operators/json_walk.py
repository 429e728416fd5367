"""Claims out of nested JSON, without Python: one level of all documents at a time.

A document is parsed once into a variant. Each level of its tree is a table of nodes, whose
claims are column expressions and whose children are the next level, until none has any: trees
may be of any depth, and a level of all documents is one job, however many they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.plans.stage import staged

#: Values that count as none (fixed values of JSON).
_NONE = ("null", "false", "0", "0.0", "-0", '""', "[]", "{}")


def _slot(node: Column, name: str) -> Column:
    """The JSON text of a value of an object; null if it is missing or counts as none."""
    text = F.to_json(F.try_variant_get(node, f"$.{name}", "variant"))
    return F.when(~text.isin(*_NONE), text)


def _first(node: Column, *names: str) -> Column:
    return F.coalesce(*[_slot(node, n) for n in names])


def _string(text: Column) -> Column:
    """The string that JSON text stands for; null if that is of another kind."""
    return F.when(text.startswith('"'), F.try_parse_json(text).cast("string"))


def _of_object(text: Column, *names: str) -> Column:
    return F.when(text.startswith("{"), _first(F.try_parse_json(text), *names))


def _nested(nodes: DataFrame) -> DataFrame:
    """The nodes that are objects or arrays, which alone have children."""
    return nodes.where(F.schema_of_variant("node").rlike("^(OBJECT|ARRAY)<"))


def _children(nodes: DataFrame) -> DataFrame:
    made = nodes.lateralJoin(nodes.sparkSession.tvf.variant_explode(F.col("node").outer()))
    key = F.when(F.col("path") == "", F.col("key")).otherwise(F.concat("path", F.lit("."), "key"))
    path = F.when(F.col("key").isNull(), F.concat("path", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(key)
    return _nested(made.select("file", path.alias("path"), F.col("value").alias("node")))


def _claims(nodes: DataFrame) -> DataFrame:
    """A claim for each object that has a quote and a reference by name."""
    node = F.col("node")
    j = nodes.select("file", "path", node, _first(node, "supporting_text", "snippet").alias("quote"), _first(node, "reference", "reference_id").alias("ref"))
    ref = F.coalesce(_string(F.col("ref")), _string(_of_object(F.col("ref"), "id", "reference_id")))
    title = F.coalesce(_of_object(F.col("ref"), "title", "reference_title"), _first(node, "title", "reference_title"))
    found = j.select("file", "path", _string(F.col("quote")).alias("supporting_text"), ref.alias("reference_id"), _string(title).alias("expected_title"))
    return found.where("supporting_text is not null and reference_id is not null")


def parsed_json(documents: DataFrame) -> DataFrame:
    """(file, value, node): documents (file, value) with their tree, null where the JVM's parser
    doesn't take the text, which is stricter than others (no repeated keys, no NaN)."""
    return documents.select("file", "value", F.try_parse_json("value").alias("node"))


def json_claims(parsed: DataFrame) -> DataFrame:
    """Claims (file, path, supporting_text, reference_id, expected_title) of trees (file, node).

    An object with a quote (supporting_text, else snippet) and a reference (reference, else
    reference_id: a string, or an object with an id) is a claim; the title is the reference's,
    else its own. Elements of a document that is an array of several have their place in the
    path. A document that is neither object nor array has one row with a null path."""
    kind = F.schema_of_variant("node")
    null = [F.lit(None).cast("string").alias(c) for c in ("path", "supporting_text", "reference_id", "expected_title")]
    other = parsed.where(~kind.rlike("^(OBJECT|ARRAY)<")).select("file", *null)
    roots = _nested(parsed.select("file", F.lit("").alias("path"), "node"))
    several = F.to_json(F.try_variant_get("node", "$[1]", "variant")).isNotNull()
    lists = roots.where(kind.startswith("ARRAY")).withColumn("several", several)
    items = lists.lateralJoin(lists.sparkSession.tvf.variant_explode(F.col("node").outer()))
    items = _nested(items.select("file", F.when(F.col("several"), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise("").alias("path"), F.col("value").alias("node")))
    level = staged(roots.where(kind.startswith("OBJECT")).unionByName(items))
    levels = [level]
    while not (level := staged(_children(level))).isEmpty():
        levels.append(level)
    return reduce(DataFrame.unionByName, map(_claims, levels)).unionByName(other)
