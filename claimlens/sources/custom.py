"""Sources and providers declared in YAML: read on the driver, where configuration lives."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping, Sequence
from pathlib import Path

import yaml


def _declared(path: Path) -> list[dict]:
    data = yaml.safe_load(path.read_text()) or {}
    rows = data.get("sources", data) if isinstance(data, dict) else data
    if isinstance(rows, dict):
        rows = [{"prefix": k, **v} for k, v in rows.items() if isinstance(v, dict)]
    return [r for r in rows if isinstance(r, dict)]


def load_custom_sources(paths: Sequence[str | Path], main: Mapping | None = None) -> dict[str, dict]:
    """Sources by prefix, from files (a folder's .yaml and .yml in order) and the main
    configuration's `sources`. Of one prefix the later wins; without `fields` it is dropped."""
    rows: list[dict] = []
    for p in map(Path, paths):
        for f in sorted([*p.glob("*.yaml"), *p.glob("*.yml")]) if p.is_dir() else [p]:
            rows += _declared(f)
    for prefix, conf in ((main or {}).get("sources") or {}).items():
        rows.append({"prefix": prefix, **conf})
    return {str(r["prefix"]): r for r in rows if r.get("prefix") and r.get("fields")}


def load_providers(paths: Sequence[str | Path]) -> dict[str, dict]:
    """Full-text providers by name; the later wins. Each needs a url template and a text or location field."""
    found: dict[str, dict] = {}
    for p in paths:
        data = yaml.safe_load(Path(p).read_text()) or {}
        for name, conf in (data.get("providers") or {}).items():
            if conf.get("url_template") and (conf.get("text_field") or conf.get("location_field")):
                found[name] = {"name": name, **conf}
    return found


def fill_template(template: str, values: Mapping[str, str | None]) -> str | None:
    """The URL, or None if a placeholder has no value."""
    needed = re.findall(r"\{(\w+)\}", template)
    return None if any(not values.get(n) for n in needed) else re.sub(r"\{(\w+)\}", lambda m: str(values[m[1]]), template)


def fill_headers(headers: Mapping[str, str]) -> dict[str, str]:
    """${NAME} from the environment; unset ones are empty."""
    return {k: re.sub(r"\$\{(\w+)\}", lambda m: os.environ.get(m[1], ""), str(v)) for k, v in headers.items()}
