"""All queries by name: how to compute each, its columns, and its SQL check (if SQL can)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from barloom.plans.present import present, present_sql
from barloom.plans.staging import ship_package


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    columns: str
    sql: str | None = None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return present(self.run(spark, sf_dir), self.columns)

    @property
    def oracle(self) -> str | None:
        return present_sql(self.sql, self.columns) if self.sql else None


CATALOG: dict[str, Query] = {}


def query(name: str, columns: str, sql: str | None = None):
    """Register a function ``(spark, sf_dir) -> DataFrame`` under ``name``."""

    def register(run):
        CATALOG[name] = Query(run, columns, sql)
        return run

    return register


def load() -> dict[str, Query]:
    """The full catalog."""
    from barloom.queries import bars, models, ordered, statistics, tables  # noqa: F401

    return CATALOG
