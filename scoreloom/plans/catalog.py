"""Registry of the queries: a Spark plan plus, where SQL can say it, the same query as SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from scoreloom.plans.bind import Tables, oracle_text


@dataclass(frozen=True)
class Entry:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(name: str, sql: str | None = None):
    """Register ``build(tables) -> DataFrame``; ``sql`` may use ``@view`` names of the bindings."""

    def register(build):
        if name in ENTRIES:
            raise ValueError(f"query {name} registered twice")
        ENTRIES[name] = Entry(name, build, None if sql is None else oracle_text(sql))
        return build

    return register


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bound(entry: Entry):
        return lambda spark, sf_dir: entry.build(Tables(spark, sf_dir))

    return {name: bound(entry) for name, entry in ENTRIES.items()}


def oracles() -> dict[str, str]:
    return {name: entry.sql for name, entry in ENTRIES.items() if entry.sql is not None}
