"""JSON columns of uploads and probes as typed columns."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.functions.common import ColumnOrName, col
from tagloom.schema import PROBE_JSON, TASK_METADATA_JSON


def _parsed(body: ColumnOrName, schema: T.StructType):
    """Struct of the body plus ``_corrupt``: the text of a body that is not valid."""
    with_corrupt = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType(), True)])
    return F.from_json(
        col(body), with_corrupt, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    )


def parse_task_metadata(df: DataFrame, json_col: str) -> DataFrame:
    """Replace the JSON column by typed ones with defaults; a bad body gives ``error``."""
    m = F.col("_m")
    text = lambda name: F.coalesce(m[name], F.lit("")).alias(name)
    no_tags = F.create_map().cast("map<string,array<string>>")
    bad = m["_corrupt"].isNotNull() | F.col(json_col).isNull()
    return df.withColumn("_m", _parsed(json_col, TASK_METADATA_JSON)).select(
        *[c for c in df.columns if c != json_col],
        text("title"), text("description"), text("origin_name"), text("origin_id"),
        F.coalesce(m["tags"], no_tags).alias("tags"),
        F.coalesce(m["rewrite"], F.lit(False)).alias("rewrite"),
        F.when(bad, "Invalid JSON in metadata field").alias("error"),
    )


def _pruned(schema: T.StructType, names: Collection[str]) -> T.StructType:
    """The fields whose dotted path, or one above it, is named; arrays of structs count as their structs."""

    def kept(struct: T.StructType, path: str) -> T.StructType:
        fields = []
        for f in struct.fields:
            at, array = f"{path}{f.name}", isinstance(f.dataType, T.ArrayType)
            inner = f.dataType.elementType if array else f.dataType
            if at not in names and isinstance(inner, T.StructType):
                inner = kept(inner, f"{at}.")
                if inner.fields:
                    fields.append(T.StructField(f.name, T.ArrayType(inner) if array else inner, f.nullable))
            elif at in names:
                fields.append(f)
        return T.StructType(fields)

    return kept(schema, "")


def parse_probe(df: DataFrame, json_col: str, fields: Collection[str] | None = None) -> DataFrame:
    """Add ``probe`` (format, streams) and ``error`` for a probe that is not valid JSON.

    Where only some of its fields are read, ``fields`` names them (``format.duration``): the parser
    passes over the others without making values of them, and does not say whether they suit their types.
    """
    schema = PROBE_JSON if fields is None else _pruned(PROBE_JSON, fields)
    parsed = df.withColumn("probe", _parsed(json_col, schema))
    corrupt = F.col("probe._corrupt").isNotNull() | F.col(json_col).isNull()
    return parsed.select(
        *[c for c in df.columns if c != json_col],
        F.struct("probe.format", "probe.streams").alias("probe"),
        F.when(corrupt, "Invalid probe JSON").alias("error"),
    )


def probe_streams(probes: DataFrame) -> DataFrame:
    """One row per stream of parsed probes, with the container's duration and bit rate."""
    return probes.select(
        "file_id", F.col("probe.format.duration").try_cast("double").alias("file_duration"),
        F.col("probe.format.bit_rate").try_cast("long").alias("bit_rate"), F.explode("probe.streams").alias("s"),
    ).select("file_id", "file_duration", "bit_rate", "s.*")
