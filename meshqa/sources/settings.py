"""Settings of a study as one value: rules, limits and cell size, from a JSON file (or a YAML one where a YAML reader is
installed); tables kept to the columns that matter; where a study's tables lie."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Settings:
    """Lengths are in metres, angles in degrees. Rules are those of functions.predicates."""

    cell: float = 300.0
    overshoot: float = 3.0
    undershoot: float = 3.0
    gap: float = 10.0
    piece: float = 10.0
    buffer: float = 15.0
    hausdorff: float = 17.0
    angle: float = 30.0
    infrastructure: dict[str, str] = field(default_factory=dict)
    geometries: dict[str, list[str]] = field(default_factory=dict)
    protection: dict[str, list[str]] = field(default_factory=dict)
    attributes: dict[str, dict[str, list[str]]] = field(default_factory=dict)
    incompatible: list[list[str]] = field(default_factory=list)
    keep: list[str] = field(default_factory=list)

    @classmethod
    def of(cls, values: dict) -> Settings:
        if unknown := sorted(set(values) - {f.name for f in fields(cls)}):
            raise ValueError(f"no such settings: {unknown}")
        return cls(**values)


def load(path: str) -> Settings:
    with open(path, encoding="utf-8") as f:
        if path.endswith((".yml", ".yaml")):
            try:
                import yaml
            except ModuleNotFoundError as e:
                raise ValueError("reading YAML takes the yaml package; JSON takes none") from e
            return Settings.of(yaml.safe_load(f) or {})
        return Settings.of(json.load(f))


def whitelisted(df: DataFrame, keep: Iterable[str], always: Iterable[str] = ()) -> DataFrame:
    """The columns to keep that are there, after those kept always."""
    names = [*always, *[c for c in keep if c not in always]]
    return df.select(*[c for c in names if c in df.columns])


def place(root: str, source: str, area: str, kind: str) -> str:
    """Where a study's tables (kind raw or processed) or results (maps, plots, data) lie."""
    return f"{root}/{'data' if kind in ('raw', 'processed') else 'results'}/{source.upper()}/{area}/{kind}"
