"""Processing, storage and queue reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom import rules
from tagloom.functions import text
from tagloom.functions.common import lookup
from tagloom.plans.literals import literal_rows


def _totals() -> list:
    return [
        F.count(F.lit(1)).alias("count"), F.sum("source_file_size").alias("source"),
        F.sum("result_file_size").alias("result"),
    ]


def processing_by_mime(results: DataFrame) -> DataFrame:
    """Per (media type, file type): counts, average and saved sizes, ratio, growth."""
    stats = results.groupBy("media_type", "mime_type").agg(*_totals())
    ratio = text.percent_of("result", "source")
    mean = lambda c: text.format_size(F.col(c).cast("double") / F.col("count"))
    return stats.select(
        F.coalesce("mime_type", F.lit("Unknown")).alias("mime"), F.col("media_type").alias("type"), "count",
        mean("source").alias("avg_source"), mean("result").alias("avg_result"),
        text.saved_size(F.col("source") - F.col("result")).alias("total_saved"),
        F.concat(text.one_place(ratio), F.lit("%")).alias("ratio"), (ratio > 100).alias("is_growth"),
    ).orderBy("type", "mime")


def _shown(stats: DataFrame, *lead) -> DataFrame:
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    rows = stats.select(*lead, zero("count").alias("count"), zero("source").alias("source"), zero("result").alias("result"))
    mean = lambda c: text.format_size(
        F.coalesce(F.rint(F.try_divide(F.col(c).cast("double"), F.col("count"))), F.lit(0.0)).cast("long")
    )
    return rows.select(
        *lead, text.format_size("source").alias("source"), text.format_size("result").alias("result"), "count",
        F.bround(text.percent_of("result", "source"), 1).alias("ratio"), mean("source").alias("avg_source"),
        mean("result").alias("avg_result"), text.saved_size(F.col("source") - F.col("result")).alias("total_saved"),
    )


def processing_by_type(results: DataFrame) -> DataFrame:
    """Per media type, with zero rows for types nothing was processed of."""
    kinds = literal_rows(results.sparkSession, ["media_type"], [(m,) for m in rules.MEDIA_TYPES])
    stats = results.groupBy("media_type").agg(*_totals())
    return _shown(kinds.join(stats, "media_type", "left"), "media_type")


def processing_overall(results: DataFrame) -> DataFrame:
    """One row of totals over all results."""
    return _shown(results.agg(*_totals()))


def processing_rollup(results: DataFrame) -> DataFrame:
    """The three reports as one pass: totals per (type, mime), per type, and overall."""
    rolled = results.withColumn("mime_type", F.coalesce("mime_type", F.lit("Unknown"))).rollup(
        "media_type", "mime_type"
    ).agg(*_totals(), F.grouping_id().cast("int").alias("depth"))
    return rolled.select("media_type", "mime_type", "depth", "count", "source", "result")


def result_change(results: DataFrame) -> DataFrame:
    """Per result: percent, direction, signed difference and the band it is shown in."""
    ratio = F.try_divide(
        F.col("result_file_size").cast("double"), F.col("source_file_size").cast("double")
    ) * 100
    known = F.coalesce("source_file_size", F.lit(0)) != 0
    diff = F.col("result_file_size") - F.col("source_file_size")
    return results.withColumn("_ratio", ratio).select(
        "task_id", "source_file_size", "result_file_size",
        F.when(known, F.concat(text.one_place(F.col("_ratio")), F.lit("%"))).otherwise("-").alias("percent"),
        F.when(~known, "-").when(diff > 0, "Increased").when(diff < 0, "Reduced").otherwise("No change").alias("direction"),
        F.when(known, text.signed_size(diff)).alias("difference"),
        F.when(~known, "none").when(F.col("_ratio") > 105, "growth").when(F.col("_ratio") >= 95, "neutral")
        .otherwise("saving").alias("band"),
    )


def orphan_files(listing: DataFrame, referenced: DataFrame, by_name: bool = False) -> DataFrame:
    """Listed paths no catalog row refers to; queue files are compared by name alone."""
    key = (lambda c: F.regexp_extract(c, r"([^/]+)$", 1)) if by_name else (lambda c: F.col(c))
    known = referenced.select(key("filepath").alias("_key")).filter(F.col("_key").isNotNull())
    return listing.withColumn("_key", key("filepath")).join(known, "_key", "left_anti").drop("_key")


def task_status_counts(tasks: DataFrame) -> DataFrame:
    counts = tasks.groupBy("status").agg(F.count(F.lit(1)).alias("tasks"))
    return counts.select("status", lookup(F.col("status"), rules.STATUS_LABELS).alias("label"), "tasks")


def result_list(
    results: DataFrame, tasks: DataFrame, media_type: str | None = None, status: int | None = None
) -> DataFrame:
    """Results filtered by the media type and status of their task."""
    wanted = tasks
    if media_type is not None:
        wanted = wanted.filter(F.col("media_type") == media_type)
    if status is not None:
        wanted = wanted.filter(F.col("status") == status)
    return results.join(wanted.select("task_id"), "task_id", "left_semi")
