"""Registered queries: a name, the inventory rows it covers, a callable and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
COVERS: dict[str, tuple[str, ...]] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Registers f(views) -> DataFrame, where views has the canonical tables of one data folder."""

    def add(f):
        from segspark.sources.views import PRELUDE, Views

        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        COVERS[name] = tuple(covers.split())
        if sql is not None:
            ORACLE_SQL[name] = PRELUDE + sql
        return f

    return add


#: Inventory rows that are functions or services, not queries over tables.
LIBRARY: dict[str, tuple[str, ...]] = {
    "sources.config": ("SRC-01",),
    "sources.audio": ("SRC-26",),
    "sources.formats.snapshot, restored": ("JFA-02",),
    "service.Recogniser": ("ONL-08", "ONL-10"),
    "service.Server": ("ONL-11", "ONL-12", "ONL-13", "ONL-14", "ONL-15"),
}
