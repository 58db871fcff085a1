"""Reading, writing and backfilling the catalog tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions import hashing, names
from tagloom.schema import CATALOG


def load_catalog(spark: SparkSession, path: str, tables: Iterable[str] = CATALOG) -> dict[str, DataFrame]:
    """Typed scans of the catalog tables under ``path``, one folder per table."""
    return {name: spark.read.schema(CATALOG[name]).parquet(f"{path}/{name}") for name in tables}


def load_catalog_jdbc(
    spark: SparkSession, options: dict[str, str], key_ranges: dict[str, tuple[str, int, int]], partitions: int
) -> dict[str, DataFrame]:
    """Scans of a live database, each read in ``partitions`` ranges of its key.

    ``key_ranges``: table -> (key column, lowest, highest).
    """
    reader = lambda name, key, low, high: (
        spark.read.format("jdbc").options(**options).option("dbtable", name)
        .option("partitionColumn", key).option("lowerBound", low).option("upperBound", high)
        .option("numPartitions", partitions).load()
    )
    return {name: reader(name, *bounds) for name, bounds in key_ranges.items()}


def write_catalog(
    df: DataFrame, path: str, partition_by: str | None = None, mode: str = "append", rows_per_file: int = 0
) -> None:
    """Write rows as Parquet, by day of a timestamp column where one is named."""
    rows = df if partition_by is None else df.withColumn("day", F.to_date(partition_by))
    writer = rows.write.mode(mode)
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    if partition_by is not None:
        writer = writer.partitionBy("day")
    writer.parquet(path)


def write_bucketed(df: DataFrame, name: str, path: str, by: str = "content_id", buckets: int = 64) -> None:
    """Write rows as table ``name`` in ``buckets`` files by a hash of a column, each sorted by it.

    Tables written alike are joined and grouped by that column as they lie, without an exchange. A
    task writes one bucket whole, so there are as many files as buckets.
    """
    (
        df.repartition(buckets, by).write.mode("overwrite").format("parquet").bucketBy(buckets, by).sortBy(by)
        .option("path", path).saveAsTable(name)
    )


def backfill_derived(
    content: DataFrame, image_hash: DataFrame, representation: DataFrame, checksums: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Fill slugs, hash prefixes and, given (filepath, checksum), missing rendition checksums."""
    slug = F.coalesce(F.nullif("slug", F.lit("")), names.content_slug("addition_date", "source_hash"))
    keys = ("l_hash", "a_hash", "b_hash")
    result = {
        "content": content.withColumn("slug", slug),
        "image_hash": image_hash.withColumns(
            {"search_similar": hashing.search_similar(*keys), "far_similarity": hashing.far_similarity(*keys)}
        ),
        "representation": representation,
    }
    if checksums is not None:
        found = checksums.select("filepath", F.col("checksum").alias("_c"))
        result["representation"] = (
            representation.join(found, "filepath", "left").withColumn("hash", F.coalesce("hash", "_c"))
            .select(*representation.columns)
        )
    return result
