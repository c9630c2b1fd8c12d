"""How plans register queries: a Spark callable each, and the SQL that states the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Run
    sql: str | None = None


class Registry(dict[str, Query]):
    def add(self, name: str, sql: str | None = None) -> Callable[[Run], Run]:
        def register(run: Run) -> Run:
            if name in self:
                raise ValueError(f"query {name} exists")
            self[name] = Query(run, sql)
            return run

        return register
