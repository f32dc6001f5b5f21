"""Knobs of the engine. The clock, encoders and sources are arguments of the operators, not settings."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Config:
    """Defaults of retrieval, chunking, graphs and dependency scans; times in milliseconds."""

    max_tokens: int = 512
    overlap_tokens: int = 64
    page_tokens: int = 8000
    rrf_k: int = 60
    window: int = 50
    default_k: int = 8
    max_k: int = 32
    fan_out: int = 16
    neighbour_limit: int = 16
    max_neighbours: int = 64
    dimension: int = 384
    index_ttl_ms: int = 24 * 3600 * 1000
    page_ttl_ms: int = 24 * 3600 * 1000
    bom_depth: int = 5
    scan_depth: int = 8
    upward_levels: int = 32
    workspace_cap: int = 256
    watch_cap: int = 512
    metric_samples: int = 1000
    build_window: int = 10
    default_build_ms: float = 8000.0
    include_dev: bool = False
    include_optional: bool = True
    split_query: bool = False

    @classmethod
    def from_env(cls, prefix: str = "QUARRYLIGHT_") -> Config:
        """Settings from the environment; values that do not parse leave the default."""
        found = {}
        for f in fields(cls):
            raw = os.environ.get(prefix + f.name.upper())
            if raw is None:
                continue
            if isinstance(f.default, bool):
                if raw.strip().lower() in ("1", "true", "yes", "on", "0", "false", "no", "off"):
                    found[f.name] = raw.strip().lower() in ("1", "true", "yes", "on")
                continue
            try:
                found[f.name] = type(f.default)(raw)
            except ValueError:
                continue
        return cls(**found)


DEFAULT = Config()
