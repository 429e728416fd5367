"""Settings of validation and repair, with bounds checked and files read on the driver."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any

import yaml

from claimlens.functions.text import CHARACTER_MAPPINGS


@dataclass(frozen=True)
class ValidationConfig:
    skip_prefixes: tuple[str, ...] = ()
    unknown_prefix_severity: str = "ERROR"
    literal_bracket_patterns: tuple[str, ...] = ()
    reference_prefix_map: Mapping[str, str] = field(default_factory=dict)
    source_extra_fields: Mapping[str, Mapping[str, str]] = field(default_factory=dict)
    supporting_text_regex: str = r'ex:supporting_text="([^"]*)\[(\S+:\S+)\]"'
    text_group: int = 1
    ref_group: int = 2
    fetch_full_text: bool = True
    full_text_providers: tuple[str, ...] = ("pmc", "epmc_preprint", "unpaywall", "openalex")
    max_supplementary_file_size: int = 50 * 1024 * 1024
    suggest_threshold: float = 70.0

    def __post_init__(self):
        if self.unknown_prefix_severity not in ("ERROR", "WARN", "INFO"):
            raise ValueError(f"unknown_prefix_severity: {self.unknown_prefix_severity}")


@dataclass(frozen=True)
class RepairConfig:
    auto_fix_threshold: float = 0.95
    suggest_threshold: float = 0.80
    removal_threshold: float = 0.50
    dry_run: bool = True
    create_backup: bool = True
    character_mappings: Mapping[str, str] = field(default_factory=lambda: dict(CHARACTER_MAPPINGS))
    skip_references: tuple[str, ...] = ()
    trusted_low_similarity: tuple[str, ...] = ()

    def __post_init__(self):
        for name in ("auto_fix_threshold", "suggest_threshold", "removal_threshold"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must be from 0 to 1")


def _build(kind: type, values: Mapping[str, Any]) -> Any:
    known = {f.name for f in fields(kind)}
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items() if k in known})


def load_config(path: str | None = None, directory: str = ".") -> tuple[ValidationConfig, RepairConfig]:
    """From the file given, else .claimlens.yaml or .yml in the directory, else defaults.

    Validation settings are under `validation`, `reference_validation` or at the top; repair
    settings under `repair` or at the top."""
    found = Path(path) if path else next((p for n in ("yaml", "yml") if (p := Path(directory, f".claimlens.{n}")).exists()), None)
    data = (yaml.safe_load(found.read_text()) or {}) if found else {}
    section = lambda *names: next((data[n] for n in names if isinstance(data.get(n), dict)), data)
    return _build(ValidationConfig, section("validation", "reference_validation")), _build(RepairConfig, section("repair"))
