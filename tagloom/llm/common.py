"""What the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.session import settle_table  # noqa: F401

# Words are what stands between these characters, in every operator: bytes.split() cuts at the same six.
SPACE = r"[\x20\x09-\x0D]"


def texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Only (doc_id long, text string); a null text is empty. Other columns cannot clash."""
    return docs.select(
        docs[doc_id].cast("long").alias("doc_id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text")
    )


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def map_columns(
    df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], schema: str, rows: int = 512,
    arrow: bool = False,
) -> DataFrame:
    """Apply a Python function to slices of columns.

    ``make()`` is called once per task and gives the function, so that it can hold a bounded cache.
    Slices of ``rows`` rows keep the Python objects of one step few, whatever Spark's batch size is.
    With ``arrow`` the function is given slices as they are, as record batches.
    """
    names = df.sparkSession.createDataFrame([], schema).schema.fieldNames()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                out = apply(part if arrow else part.to_pydict())
                if out and len(out[names[0]]):
                    yield pa.RecordBatch.from_arrays([as_arrow(out[n]) for n in names], names)

    return df.mapInArrow(task, schema)


def as_arrow(values) -> pa.Array:
    return values if isinstance(values, pa.Array) else pa.array(values)


def joined(spans: Column, kinds: list[str]) -> Column:
    """"kind:start:end" of the spans in order of start, then kind as listed, comma-joined."""
    rank = F.create_map(*[x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(i))])
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], rank[s["kind"]].alias("rank"), s["end"], s["kind"])))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
