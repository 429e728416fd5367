"""Schemas of nested data in YAML: classes with their imports, parents and mixins resolved.

Schemas are configuration: they are read on the driver, and what comes of them is a small
table of slots, whose roles are told by the same expressions as anyone's.
"""

from __future__ import annotations

from collections.abc import Mapping
from pathlib import Path

import yaml
from pyspark.sql import SparkSession

from claimlens.functions.fields import PREFIXES, class_slots

SLOTS = "class string, name string, ord int, implements array<string>, slot_uri string, range string"


def load_schema(path: str | Path, seen: set[Path] | None = None) -> dict:
    """classes, slots and prefixes of a schema file and of the files that it imports by relative
    name; what a file says itself counts before its imports, and of these the earlier."""
    path, seen = Path(path).resolve(), set() if seen is None else seen
    seen.add(path)
    own = yaml.safe_load(path.read_text(encoding="utf-8")) or {}
    found = {part: dict(own.get(part) or {}) for part in ("classes", "slots", "prefixes")}
    for name in own.get("imports") or []:
        target = (path.parent / f"{name}.yaml").resolve()
        if target not in seen and target.exists():
            for part, values in load_schema(target, seen).items():
                found[part] = values | found[part]
    return found


def _lineage(schema: Mapping, name: str, seen: tuple[str, ...] = ()) -> list[str]:
    """The class, its mixins and its parent, and theirs, nearest first, each once."""
    if name in seen or name not in schema["classes"]:
        return []
    conf = schema["classes"][name] or {}
    line = [name]
    for other in [*(conf.get("mixins") or []), conf.get("is_a")]:
        line += [c for c in _lineage(schema, other, (*seen, name)) if c not in line] if other else []
    return line


def slots_of(schema: Mapping, name: str) -> dict[str, dict]:
    """Slots of a class by name, in order: its own first, then those it inherits. What a class
    nearer to it says of a slot, as an attribute or by its usage, counts before what is said
    farther away, and all of it before the slot's own definition."""
    found: dict[str, dict] = {}
    for c in _lineage(schema, name):
        conf = schema["classes"][c] or {}
        attributes = conf.get("attributes") or {}
        for slot in [*(conf.get("slots") or []), *attributes]:
            found.setdefault(slot, {})
        for said in (attributes, conf.get("slot_usage") or {}):
            for slot, values in said.items():
                if slot in found:
                    found[slot] = (values or {}) | found[slot]
        # Usage of slots that classes farther away bring in.
        for slot, values in (conf.get("slot_usage") or {}).items():
            if slot not in found:
                found[slot] = dict(values or {}) | {"_used": True}
    brought = {s for c in _lineage(schema, name) for s in [*((schema["classes"][c] or {}).get("slots") or []), *((schema["classes"][c] or {}).get("attributes") or {})]}
    return {slot: (schema["slots"].get(slot) or {}) | {k: v for k, v in values.items() if k != "_used"} for slot, values in found.items() if slot in brought}


def resolved(spark: SparkSession, path: str | Path) -> dict[str, dict]:
    """Classes as nested_claims() takes them: `roles` (role to slot names) and `ranges` (slot to
    class), of a schema file with all it imports and inherits."""
    schema = load_schema(path)
    rows, out = [], {name: {"roles": {}, "ranges": {}} for name in schema["classes"]}
    for name in schema["classes"]:
        for k, (slot, conf) in enumerate(slots_of(schema, name).items()):
            implements = conf.get("implements") or []
            rows.append((name, slot, k, [implements] if isinstance(implements, str) else list(implements), conf.get("slot_uri"), conf.get("range")))
            if conf.get("range") in schema["classes"]:
                out[name]["ranges"][slot] = conf["range"]
    prefixes = {k: v if isinstance(v, str) else (v or {}).get("prefix_reference", "") for k, v in schema["prefixes"].items()}
    if rows:
        for r in class_slots(spark.createDataFrame(rows, SLOTS), PREFIXES | prefixes).collect():
            out[r["class"]]["roles"][r["role"]] = list(r["names"])
    return out


def root_class(path: str | Path) -> str | None:
    """The class that the schema marks as tree_root, if it is the only one."""
    roots = [name for name, conf in load_schema(path)["classes"].items() if (conf or {}).get("tree_root")]
    return roots[0] if len(roots) == 1 else None
