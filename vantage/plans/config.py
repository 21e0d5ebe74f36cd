"""Configurations as nested dictionaries and as (path, value) tables: defaults, overrides, differences, methods."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


def load(text: str | None, defaults: dict) -> tuple[dict, list[str]]:
    """(configuration, paths that got their default). JSON text; None or empty gives the defaults."""
    data = json.loads(text) if text else {}
    filled: list[str] = []
    return apply_defaults(defaults, data, filled), filled


def apply_defaults(defaults: dict, data: dict, filled: list[str], at: str = "") -> dict:
    """data with absent fields from defaults; present fields stay, even null ones."""
    out = dict(data)
    for k, v in defaults.items():
        path = f"{at}.{k}" if at else k
        if k not in out:
            out[k] = v
            filled.append(path)
        elif isinstance(v, dict) and isinstance(out[k], dict):
            out[k] = apply_defaults(v, out[k], filled, path)
    return out


def override(saved: dict, overrides: dict) -> dict:
    """saved with the overrides that are not None."""
    return saved | {k: v for k, v in overrides.items() if v is not None}


def flatten(data, at: str = "") -> list[tuple[str, str]]:
    """(path, JSON value) of the leaves."""
    if isinstance(data, dict) and data:
        return [x for k, v in sorted(data.items()) for x in flatten(v, f"{at}.{k}" if at else k)]
    return [(at, json.dumps(data, sort_keys=True))]


def table(spark: SparkSession, data: dict) -> DataFrame:
    return spark.createDataFrame(flatten(data), "path string, value string")


def get_path(data: dict, path: str, default=None):
    for k in path.split("."):
        if not isinstance(data, dict) or k not in data:
            return default
        data = data[k]
    return data


def set_path(data: dict, path: str, value) -> dict:
    head, _, rest = path.partition(".")
    return data | {head: set_path(data.get(head) or {}, rest, value) if rest else value}


def working_dir(path: str, saved: str, candidates: list[str]) -> str | None:
    """The candidate that shares the longest suffix of folders with saved; None if none shares any, or saved is absolute."""
    if saved.startswith("/"):
        return None
    want = saved.strip("/").split("/")

    def shared(c: str) -> int:
        own = c.strip("/").split("/")
        n = 0
        while n < min(len(own), len(want)) and own[-1 - n] == want[-1 - n]:
            n += 1
        return n

    best = max(candidates, key=shared, default=None)
    return best if best is not None and shared(best) else None


def run_name(now, taken: set[str]) -> str:
    """Name of a run's folder by its time; _2, _3, ... where it is taken."""
    base = now.strftime("%Y-%m-%d_%H%M%S")
    n = 1
    while (name := base if n == 1 else f"{base}_{n}") in taken:
        n += 1
    return name


def extract_nested(data: dict, path: str) -> dict:
    """outer key -> the value at path of its nested map; keys without one are left out."""
    missing = object()
    found = {k: get_path(v, path, missing) for k, v in data.items()}
    return {k: v for k, v in found.items() if v is not missing}


class Methods:
    """Registry of components by slot; a method is a dotted string with one component a slot."""

    def __init__(self, slots: tuple[str, ...]):
        self.slots, self.parts = slots, {s: {} for s in slots}

    def add(self, slot: str, name: str, config: dict) -> None:
        self.parts[slot][name] = config

    def parse(self, method: str) -> dict:
        names = method.split(".")
        if len(names) != len(self.slots):
            raise ValueError(f"expected {len(self.slots)} parts: {method}")
        if bad := [f"{s}={n}" for s, n in zip(self.slots, names, strict=True) if n not in self.parts[s]]:
            raise ValueError(f"unknown components: {bad}")
        return {s: self.parts[s][n] for s, n in zip(self.slots, names, strict=True)}


def first_of_type(configs: list[dict], kind: str) -> dict | None:
    return next((c for c in configs if c.get("type") == kind), None)
