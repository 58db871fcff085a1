"""Small fixed tables as local relations, so the planner knows how small they are."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession


def _literal(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(value)


def literal_rows(spark: SparkSession, columns: Sequence[str], rows: Iterable[Sequence]) -> DataFrame:
    listed = ", ".join("(" + ", ".join(map(_literal, row)) + ")" for row in rows)
    return spark.sql(f"select * from values {listed} as t({', '.join(columns)})")
