"""Settings with an overlay for each environment.

A settings file is JSON or TOML. Keys under ``environments.<name>`` replace the top-level ones
with the same path; an unknown environment leaves them as they are.
"""

from __future__ import annotations

import json
import tomllib
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any


@dataclass(frozen=True)
class SparkSettings:
    master: str = "local[*]"
    warehouse: str = "spark-warehouse"
    extensions: str = ""
    catalog: str = ""


@dataclass(frozen=True)
class DataSettings:
    source: str = "data/pdfs"
    downloads: str = "data/downloads"
    store: str = "data/rag"
    snapshots: str = "data/snapshots"


@dataclass(frozen=True)
class EmbeddingSettings:
    model: str = "mxbai-embed-large"
    version: str = "1.0"
    batch: int = 2
    host: str = "localhost"
    port: int = 11434
    timeout: float = 120.0

    @property
    def url(self) -> str:
        return self.host if "://" in self.host else f"http://{self.host}:{self.port}"


@dataclass(frozen=True)
class Settings:
    name: str = "cairn"
    spark: SparkSettings = field(default_factory=SparkSettings)
    data: DataSettings = field(default_factory=DataSettings)
    embedding: EmbeddingSettings = field(default_factory=EmbeddingSettings)


def _merge(base: dict[str, Any], over: dict[str, Any]) -> dict[str, Any]:
    out = dict(base)
    for k, v in over.items():
        out[k] = _merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load(source: str | Path | dict | None = None, env: str | None = None) -> Settings:
    """Settings of a file or dict; what it doesn't name keeps its default, unknown keys raise."""
    raw: dict[str, Any] = {}
    if isinstance(source, dict):
        raw = source
    elif source is not None:
        text = Path(source).read_text()
        raw = tomllib.loads(text) if str(source).endswith(".toml") else json.loads(text)
    environments = raw.get("environments", {})
    flat = _merge({k: v for k, v in raw.items() if k != "environments"}, environments.get(env, {}) if env else {})
    return Settings(flat.get("name", "cairn"), SparkSettings(**flat.get("spark", {})), DataSettings(**flat.get("data", {})), EmbeddingSettings(**flat.get("embedding", {})))
