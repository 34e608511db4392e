"""Catalogues and metric configurations from YAML or JSON text: variables, relative paths, named parts, deep merge."""

from __future__ import annotations

import json
import re
from pathlib import Path
from typing import Any


def parse(text: str) -> Any:
    """YAML if the library is there, else JSON."""
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    return yaml.safe_load(text)


def merge(a: Any, b: Any) -> Any:
    """b over a; mappings are merged key by key, anything else is replaced."""
    if isinstance(a, dict) and isinstance(b, dict):
        return {k: merge(a[k], b[k]) if k in a and k in b else b.get(k, a.get(k)) for k in {**a, **b}}
    return b


def interpolate(value: Any, variables: dict[str, str]) -> Any:
    """`$name` and `${name}` replaced everywhere; an unknown name is an error."""
    if isinstance(value, dict):
        return {k: interpolate(v, variables) for k, v in value.items()}
    if isinstance(value, list):
        return [interpolate(v, variables) for v in value]
    if isinstance(value, str):
        return re.sub(r"\$(?:\{(\w+)\}|(\w+))", lambda m: str(variables[m[1] or m[2]]), value)
    return value


def resolve_paths(value: Any, base: Path, keys: tuple[str, ...] = ("path", "file", "dir")) -> Any:
    """Relative paths under keys that end in path, file or dir made absolute from `base`."""
    if isinstance(value, dict):
        return {k: str((base / v).resolve()) if isinstance(v, str) and k.endswith(keys) and "://" not in v else resolve_paths(v, base, keys) for k, v in value.items()}
    return [resolve_paths(v, base, keys) for v in value] if isinstance(value, list) else value


def metric_configs(text: str, base: str = ".", variables: dict[str, str] | None = None) -> dict[str, dict]:
    """name -> configuration: `defaults` under every metric, `vars` for interpolation, given variables last."""
    raw = parse(text) or {}
    names = merge(raw.get("vars", {}), variables or {})
    defaults = raw.get("defaults", {})
    return {n: resolve_paths(interpolate(merge(defaults, c or {}), names), Path(base)) for n, c in raw.get("metrics", {}).items()}


def template(metrics: dict[str, list]) -> dict[str, Any]:
    """An empty configuration for metrics with lists of Parameter."""
    return {"vars": {}, "defaults": {}, "metrics": {n: {p.name: p.default for p in ps} for n, ps in metrics.items()}}


def catalogue(text: str) -> dict[str, dict[str, Any]]:
    """Pipeline name -> {description, config, tasks}; a pipeline without tasks is an error."""
    out = {}
    for name, c in (parse(text) or {}).items():
        if not c or not c.get("tasks"):
            raise ValueError(f"{name} has no tasks")
        out[name] = {"description": c.get("description", ""), "config": c.get("config", {}), "tasks": list(c["tasks"])}
    return out
