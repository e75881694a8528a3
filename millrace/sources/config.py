"""Configuration: YAML files, deep merge, overrides; adapters by dotted path."""

from __future__ import annotations

import hashlib
import importlib
import json
from collections.abc import Callable, Mapping
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession


def load_yaml(path: str) -> dict[str, Any]:
    try:
        import yaml
    except ImportError as missing:
        raise RuntimeError("reading YAML needs PyYAML; JSON configurations need nothing") from missing
    with open(path) as f:
        return yaml.safe_load(f) or {}


def load(path: str) -> dict[str, Any]:
    if path.endswith(".json"):
        with open(path) as f:
            return json.load(f)
    return load_yaml(path)


def deep_merge(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    """Mappings are merged at every depth, anything else is replaced."""
    out = dict(base)
    for k, v in over.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def with_overrides(config: Mapping[str, Any], overrides: Mapping[str, Any]) -> dict[str, Any]:
    """Dotted keys set nested values: {"retrieval.top_k": 5}."""
    out: dict[str, Any] = dict(config)
    for dotted, value in overrides.items():
        nested: Any = value
        for key in reversed(dotted.split(".")):
            nested = {key: nested}
        out = deep_merge(out, nested)
    return out


def config_hash(config: Mapping[str, Any]) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:12]


class Adapter(Protocol):
    """What a dataset brings: rows, documents and evaluation queries as DataFrames."""

    source_name: str
    version: str

    def read_rows(self, spark: SparkSession, split: str) -> DataFrame: ...

    def to_documents(self, rows: DataFrame, split: str) -> DataFrame: ...

    def evaluation_queries(self, rows: DataFrame) -> DataFrame: ...


_SHORTCUTS: dict[str, Callable[..., Any]] = {}


def register_adapter(name: str, make: Callable[..., Any]) -> None:
    _SHORTCUTS[name] = make


def load_adapter(name: str, **options: Any) -> Any:
    """An adapter by registered name or dotted path ``package.module.Class``."""
    if name in _SHORTCUTS:
        return _SHORTCUTS[name](**options)
    module, _, cls = name.rpartition(".")
    if not module:
        raise ValueError(f"unknown adapter {name}; registered: {sorted(_SHORTCUTS)}")
    return getattr(importlib.import_module(module), cls)(**options)
