"""All registered queries with their oracles."""

from __future__ import annotations

import importlib

MODULES = ("fleet_models", "stations", "analytics", "quality", "corridors", "energy", "feeds", "streams", "basics")


def registries():
    return [importlib.import_module(f"strom.registry.{name}").REG for name in MODULES]


def all_queries() -> dict:
    return {name: build for reg in registries() for name, build in reg.queries.items()}


def all_oracles() -> dict[str, str]:
    return {name: sql for reg in registries() for name, sql in reg.oracles.items()}
