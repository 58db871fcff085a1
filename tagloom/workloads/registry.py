"""Named queries over the given tables, each with the SQL it has to agree with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tagloom.fixtures import Inputs, duck_sql
from tagloom.session import compile_methods


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Inputs], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        compile_methods(spark)
        return self.build(Inputs(spark, sf_dir))

    def oracle(self) -> str | None:
        return None if self.sql is None else duck_sql(self.sql)


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[Inputs], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, build, sql)
        return build

    return register
