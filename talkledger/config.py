"""Configuration: one nested mapping from JSON (or YAML where a parser is installed)."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from .operators.scoring import Settings

DEFAULTS: dict[str, Any] = {"inference": {"threshold": 0.5, "low": 0.3, "high": 0.7, "top_k": 5, "chunk_words": 20, "overlap": 15, "speakers": ["Agent"], "exclude": ["1", "13", "14"]}}


def deep_merge(base: dict, over: dict) -> dict:
    """base with over's values; mappings are merged, everything else is replaced. Neither is changed."""
    return {k: deep_merge(base[k], over[k]) if isinstance(base.get(k), dict) and isinstance(over.get(k), dict) else over.get(k, base.get(k)) for k in [*base, *[k for k in over if k not in base]]}


def dotted(config: dict, path: str, default: Any = None) -> Any:  # noqa: ANN401
    for part in path.split("."):
        if not isinstance(config, dict) or part not in config:
            return default
        config = config[part]
    return config


def load(path: str | None = None) -> dict:
    if path is None:
        return DEFAULTS
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        import yaml

        found = yaml.safe_load(text)
    else:
        found = json.loads(text)
    if not isinstance(found, dict):
        raise ValueError(f"{path}: not a mapping")
    return deep_merge(DEFAULTS, found)


def settings(config: dict) -> Settings:
    names = Settings.__dataclass_fields__
    return Settings(**{k: v for k, v in config.get("inference", {}).items() if k in names})
