"""Merging items into one another across the catalog tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.session import settle


def resolve_merge_chains(pairs: DataFrame) -> DataFrame:
    """(source_id, target_id, status): where each source ends up when targets merge on.

    Pointers are doubled each round, so a chain of n steps takes about log2(n) rounds.
    Rows caught in a cycle, or leading into one, are reported as ``cycle``. Of several
    targets for a source the lowest is taken; merging an item into itself is dropped.
    """
    once = pairs.filter(F.col("source_id") != F.col("target_id")).groupBy("source_id").agg(
        F.min("target_id").alias("target_id")
    )
    current = settle(once)
    before = -1
    while True:
        onward = current.select(F.col("source_id").alias("target_id"), F.col("target_id").alias("_next"))
        moved = settle(
            current.join(onward, "target_id", "left").select("source_id", "target_id", "_next")
        )
        open_rows = moved.filter(F.col("_next").isNotNull()).count()
        if open_rows == 0 or open_rows == before:
            status = F.when(F.col("_next").isNull(), "ok").otherwise("cycle")
            return moved.select("source_id", "target_id", status.alias("status"))
        before = open_rows
        current = moved.select("source_id", F.coalesce("_next", "target_id").alias("target_id"))


def _mapping(pairs: DataFrame) -> DataFrame:
    return pairs.filter(F.col("status") == "ok").select(
        F.col("source_id").alias("_source"), F.col("target_id").alias("_target")
    )


def _split(df: DataFrame, mapping: DataFrame, column: str = "content_id") -> tuple[DataFrame, DataFrame]:
    """Rows of items that stay, and rows of sources with ``column`` set to the target."""
    joined = df.join(mapping, df[column] == mapping["_source"], "left")
    stay = joined.filter(F.col("_source").isNull()).select(*df.columns)
    moved = joined.filter(F.col("_source").isNotNull()).withColumn(column, F.col("_target")).select(*df.columns)
    return stay, moved


def _repoint(df: DataFrame, mapping: DataFrame, column: str = "content_id") -> DataFrame:
    joined = df.join(mapping, df[column] == mapping["_source"], "left")
    return joined.withColumn(column, F.coalesce("_target", column)).select(*df.columns)


def merge_tags(content_tag: DataFrame, pairs: DataFrame) -> DataFrame:
    return _repoint(content_tag.select("content_id", "tag_id"), _mapping(pairs)).distinct()


def merge_origins(origin: DataFrame, pairs: DataFrame) -> DataFrame:
    """Origins move as alternates, unless the target has the same (name, origin_id)."""
    own, moved = _split(origin.select("content_id", "name", "origin_id", "alternate"), _mapping(pairs))
    keys = ["content_id", "name", "origin_id"]
    added = moved.select(*keys).distinct().join(own.select(*keys), keys, "left_anti")
    return own.unionByName(added.withColumn("alternate", F.lit(True)))


def merge_redirects(redirect: DataFrame, content: DataFrame, pairs: DataFrame) -> DataFrame:
    """Redirects follow to the target, and the source's own slug and hash become one."""
    mapping = _mapping(pairs)
    gone = content.join(mapping, content["content_id"] == mapping["_source"]).select(
        F.col("slug").alias("old_slug"), F.col("_target").alias("new_content_id"),
        F.col("addition_date").alias("created_at"), "source_hash",
    )
    kept = redirect.select("old_slug", "new_content_id", "created_at", "source_hash")
    return _repoint(kept, mapping, "new_content_id").unionByName(gone)


def merge_albums(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """Slots move unless the target is in the album already; of several, the lowest moves."""
    own, moved = _split(items.select("album_id", "content_id", "ord"), _mapping(pairs))
    keys = ["album_id", "content_id"]
    first = moved.groupBy(*keys).agg(F.min("ord").alias("ord"))
    return own.unionByName(first.join(own.select(*keys), keys, "left_anti"))


def merge_collections(items: DataFrame, pairs: DataFrame) -> DataFrame:
    return _repoint(items.select("collection_id", "content_id"), _mapping(pairs)).distinct()


def drop_sources(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows whose item has not been merged away."""
    gone = _mapping(pairs).select(F.col("_source").alias("content_id"))
    return df.join(gone, "content_id", "left_anti").select(*df.columns)


def merge_task_results(results: DataFrame, pairs: DataFrame) -> DataFrame:
    mapping = _mapping(pairs)
    joined = results.join(mapping, results["content_id"] == mapping["_source"], "left")
    return joined.withColumn(
        "content_id", F.when(F.col("_source").isNull(), F.col("content_id"))
    ).select(*results.columns)


def merge_content(pairs: DataFrame, catalog: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """New versions of the catalog tables after merging (source_id, target_id) pairs.

    Tables that are not given are left out of the result. The resolved mapping is
    worked out once and shared by all of them.
    """
    resolved = settle(resolve_merge_chains(pairs))
    mapping = _mapping(resolved)
    steps = {
        "content_tag": lambda t: merge_tags(t, resolved),
        "content_origin": lambda t: merge_origins(t, resolved),
        "content_redirect": lambda t: merge_redirects(t, catalog["content"], resolved),
        "attachment": lambda t: _repoint(t, mapping),
        "collection_item": lambda t: merge_collections(t, resolved),
        "album_order": lambda t: merge_albums(t, resolved),
        "content": lambda t: drop_sources(t, resolved),
        "representation": lambda t: drop_sources(t, resolved),
        "image_hash": lambda t: drop_sources(t, resolved),
        "task_result": lambda t: merge_task_results(t, resolved),
    }
    return {name: step(catalog[name]) for name, step in steps.items() if name in catalog}
