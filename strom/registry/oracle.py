"""Assembles DuckDB oracle queries from named relations."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strom.session import release
from strom.sources import driver
from strom.sources.driver import Tables

RELATIONS: dict[str, str] = driver.duck_ctes()


def relation(name: str, sql: str) -> str:
    """Name an oracle relation other oracles may build on."""
    RELATIONS[name] = sql
    return name


def _closure(text: str) -> list[str]:
    wanted: list[str] = []

    def visit(body: str, seen: tuple[str, ...]) -> None:
        for name in driver.references(body, RELATIONS):
            if name in wanted or name in seen:
                continue
            visit(RELATIONS[name], (*seen, name))
            wanted.append(name)

    visit(text, ())
    return wanted


def oracle(body: str) -> str:
    """Complete query: every named relation the body uses, then the body itself."""
    body = body.strip()
    own = set(re.findall(r"(?:with|,)\s+([a-z_0-9]+)\s+as\s+(?:materialized\s+)?\(", body))
    names = [name for name in _closure(body) if name not in own]
    head = ",\n".join(f"{name} as ({RELATIONS[name]})" for name in names)
    if not head:
        return body
    if body.lower().startswith("with "):
        return f"with {head},\n{body[5:]}"
    return f"with {head}\n{body}"


class Registry:
    """Queries by name, each with an optional oracle."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, build: Callable[[Tables], DataFrame], sql: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            release()
            return build(Tables(spark, folder))

        self.queries[name] = run
        if sql is not None:
            self.oracles[name] = oracle(sql)
