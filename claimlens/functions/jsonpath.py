"""JSON paths over string columns: the first match, as text."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_STEP = re.compile(r"""\.\.(?P<deep>[\w-]+|\*)|\.(?P<name>[\w-]+|\*)|\[(?P<index>-?\d+|\*)\]|\[(?P<q>['"])(?P<key>.*?)(?P=q)\]""")


def parse_path(path: str) -> list[tuple[str, str]] | None:
    """Steps of a path as (kind, value); None if it isn't one."""
    rest, steps = path.strip(), []
    if rest.startswith("$"):
        rest = rest[1:]
    elif rest and rest[0] not in ".[":
        rest = "." + rest
    at = 0
    while at < len(rest):
        m = _STEP.match(rest, at)
        if not m:
            return None
        kind = next(k for k in ("deep", "name", "index", "key") if m[k] is not None)
        steps.append((kind, m[kind]))
        at = m.end()
    return steps


def _walk(value, steps):
    if not steps:
        yield value
        return
    (kind, name), rest = steps[0], steps[1:]
    if kind == "deep":
        if isinstance(value, dict) and (name in value or name == "*"):
            for v in value.values() if name == "*" else [value[name]]:
                yield from _walk(v, rest)
        for v in value.values() if isinstance(value, dict) else value if isinstance(value, list) else ():
            yield from _walk(v, steps)
    elif kind == "index" and isinstance(value, list):
        chosen = value if name == "*" else value[int(name) :][:1] if int(name) >= 0 else value[int(name) : (int(name) + 1) or None]
        for v in chosen:
            yield from _walk(v, rest)
    elif kind in ("name", "key") and isinstance(value, dict):
        if name == "*" and kind == "name":
            for v in value.values():
                yield from _walk(v, rest)
        elif name in value:
            yield from _walk(value[name], rest)


def _text(value) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def first_match(document: Column, path: str) -> Column:
    """The first match of a path in JSON text; null without one, or for an invalid path.

    Plain paths run as get_json_object(); ones with wildcards or descendants, whose first
    match that function doesn't give, run in an Arrow UDF. Numbers, booleans, objects and
    lists come as JSON text."""
    steps = parse_path(path)
    if steps is None:
        return F.lit(None).cast("string")
    if all(k in ("name", "key", "index") and v != "*" and not v.startswith("-") and "'" not in v for k, v in steps):
        plain = "$" + "".join(f"[{v}]" if k == "index" else f"['{v}']" for k, v in steps)
        return F.get_json_object(document, plain)

    def over(values: pd.Series) -> pd.Series:
        def one(v):
            try:
                return _text(next(_walk(json.loads(v), steps), None)) if v else None
            except ValueError:
                return None

        return values.map(one)

    return F.pandas_udf(over, "string")(document)


def extract_fields(document: Column, paths: Mapping[str, str]) -> Column:
    """A struct with the first match of each named path."""
    return F.struct(*[first_match(document, p).alias(k) for k, p in paths.items()])


def joined_value(value: Column) -> Column:
    """Text of a field: a JSON list's entries joined by a space, blank as null."""
    entries = F.from_json(value, "array<string>")
    text = F.when(value.startswith("["), F.array_join(F.filter(entries, lambda x: F.trim(x) != ""), " ")).otherwise(value)
    return F.nullif(F.trim(text), F.lit(""))


def extra_fields(document: Column, paths: Mapping[str, str]) -> Column:
    """map of name to text for the fields that have any."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), joined_value(first_match(document, p)).alias("value")) for k, p in paths.items()])
    return F.map_from_entries(F.filter(pairs, lambda e: e["value"].isNotNull()))


def extra_content(fields: Column) -> Column:
    """Extra fields as headed blocks."""
    return F.array_join(F.transform(F.map_entries(fields), lambda e: F.concat(F.lit("### "), e["key"], F.lit("\n\n"), e["value"])), "\n\n")
