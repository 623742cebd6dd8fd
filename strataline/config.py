"""Settings of the engine: defaults, overlays from files and from the environment."""

from __future__ import annotations

import dataclasses
import json
import os
from dataclasses import dataclass, field
from typing import Any

PREFIX = "STRATALINE_"


@dataclass
class Chunking:
    max_chars: int = 1800
    overlap_chars: int = 200
    min_chars: int = 200
    by_sections: bool = True


@dataclass
class Retrieval:
    top_k: int = 8
    candidate_k: int = 40
    fusion: str = "rrf"
    rrf_k: int = 60
    dense_weight: float = 0.5
    bm25_weight: float = 0.5
    rerank: bool = False


@dataclass
class Generation:
    min_evidence_score: float = 0.05
    min_citations: int = 1
    abstain_below_confidence: float = 0.15
    max_context_chunks: int = 6
    quote_chars: int = 240


@dataclass
class Verification:
    enabled: bool = True
    groundedness_floor: float = 0.6
    repair: bool = True
    abstain_on_contradiction: bool = True


@dataclass
class Embedding:
    backend: str = "hashing"
    dim: int = 256


@dataclass
class Audit:
    path: str = ""


@dataclass
class Config:
    chunking: Chunking = field(default_factory=Chunking)
    retrieval: Retrieval = field(default_factory=Retrieval)
    generation: Generation = field(default_factory=Generation)
    verification: Verification = field(default_factory=Verification)
    embedding: Embedding = field(default_factory=Embedding)
    audit: Audit = field(default_factory=Audit)


def coerced(value: str) -> Any:
    """true and false, whole numbers and decimals from text; anything else stays text."""
    low = value.strip().lower()
    if low in ("true", "false"):
        return low == "true"
    for kind in (int, float):
        try:
            return kind(value)
        except ValueError:
            pass
    return value


def overlaid(config: Config, values: dict[str, Any]) -> Config:
    """config with the values of a nested dict; unknown sections and keys are errors."""
    out = dataclasses.replace(config)
    for section, entries in values.items():
        if not hasattr(out, section):
            raise ValueError(f"unknown section {section!r}")
        setattr(out, section, dataclasses.replace(getattr(out, section), **entries))
    return out


def _read(path: str) -> dict[str, Any]:
    """The nested dict of a JSON file, or of a YAML file where PyYAML is installed; an empty file has none."""
    with open(path) as f:
        if not path.endswith((".yaml", ".yml")):
            return json.load(f)
        try:
            import yaml
        except ImportError as e:
            raise ValueError("YAML settings need PyYAML; use JSON") from e
        return yaml.safe_load(f) or {}


def load(path: str | None = None, env: dict[str, str] | None = None) -> Config:
    """Defaults, then a JSON or YAML file, then variables such as STRATALINE_RETRIEVAL__TOP_K."""
    config = Config()
    if path:
        config = overlaid(config, _read(path))
    for name, value in (os.environ if env is None else env).items():
        if name.startswith(PREFIX) and "__" in name:
            section, key = name[len(PREFIX) :].lower().split("__", 1)
            config = overlaid(config, {section: {key: coerced(value)}})
    return config
