"""Groups of alike images, their review, and decisions on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.functions import hashing
from tagloom.operators.representations import best_raster

_HASHES = ("l_hash", "a_hash", "b_hash")


def _keyed(image_hash: DataFrame, precision: str) -> tuple[DataFrame, list[str]]:
    """Rows with the columns that make up a group at this precision."""
    if precision == "exact":
        return image_hash, list(_HASHES)
    key = {"medium": hashing.search_similar, "low": hashing.far_similarity}[precision]
    return image_hash.withColumn("group_key", key(*_HASHES)), ["group_key"]


def duplicate_groups(image_hash: DataFrame, precision: str = "exact") -> DataFrame:
    """One row per group of two or more with a member still to be reviewed.

    (key_hex, items, alternates, first_id, and the three hashes of exact groups).
    Members are not collected: ``duplicate_members`` lists them as rows.
    """
    rows, keys = _keyed(image_hash, precision)
    groups = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("items"), F.sum(F.col("alternate_version").cast("long")).alias("alternates"),
        F.min("imagehash_id").alias("first_id"),
    ).filter((F.col("items") > 1) & (F.col("alternates") < F.col("items")))
    if precision == "exact":
        shown = hashing.search_similar(*_HASHES)
        return groups.select(hashing.hex_text(shown).alias("key_hex"), *keys, "items", "alternates", "first_id")
    return groups.select(hashing.hex_text("group_key").alias("key_hex"), *keys, "items", "alternates", "first_id")


def duplicate_members(image_hash: DataFrame, precision: str = "exact") -> DataFrame:
    """(key_hex, first_id, items, imagehash_id, content_id, aspect_ratio, alternate_version)."""
    rows, keys = _keyed(image_hash, precision)
    groups = duplicate_groups(image_hash, precision).select(*keys, "key_hex", "items", "first_id")
    return rows.join(groups, keys).select(
        "key_hex", "first_id", "items", "imagehash_id", "content_id", "aspect_ratio", "alternate_version"
    )


def review_pairs(members: DataFrame) -> DataFrame:
    """(key_hex, first_hash, second_hash): every other member of a group against its first.

    The list grows with the members, not with their square; pairs of two later members
    are given to ``compare_pairs`` as the reviewer asks for them.
    """
    return members.filter(F.col("imagehash_id") != F.col("first_id")).select(
        "key_hex", F.col("first_id").alias("first_hash"), F.col("imagehash_id").alias("second_hash")
    )


def compare_pairs(
    pairs: DataFrame, image_hash: DataFrame, representation: DataFrame, origin: DataFrame
) -> DataFrame:
    """Facts a reviewer decides on for each given pair (first_hash, second_hash).

    same_size of the best raster images, same_origin (a common site), both_alternate;
    a member without a raster image is an error.
    """
    sites = origin.groupBy("content_id").agg(F.collect_set("name").alias("sites"))
    facts = (
        image_hash.select("imagehash_id", "content_id", "alternate_version")
        .join(best_raster(representation).withColumnRenamed("filepath", "raster"), "content_id", "left")
        .join(sites, "content_id", "left")
    )

    def side(name: str) -> DataFrame:
        return facts.select(
            F.col("imagehash_id").alias(f"{name}_hash"),
            F.struct("content_id", "raster", "width", "height", "sites", "alternate_version").alias(name),
        )

    joined = pairs.join(side("first"), "first_hash").join(side("second"), "second_hash")
    missing = F.col("first.raster").isNull() | F.col("second.raster").isNull()
    same_size = (F.col("first.width") == F.col("second.width")) & (F.col("first.height") == F.col("second.height"))
    shared = F.coalesce(F.arrays_overlap("first.sites", "second.sites"), F.lit(False))
    return joined.select(
        *pairs.columns, F.col("first.content_id").alias("first_content"),
        F.col("second.content_id").alias("second_content"),
        F.when(~missing, same_size).alias("same_size"), shared.alias("same_origin"),
        (F.col("first.alternate_version") & F.col("second.alternate_version")).alias("both_alternate"),
        F.when(missing, "no raster image").alias("error"),
    )


def mark_alternates(image_hash: DataFrame, marks: DataFrame) -> DataFrame:
    """Set or clear the alternate flag; the last mark (imagehash_id, decided_at, alternate) wins."""
    last = marks.groupBy("imagehash_id").agg(
        F.max_by("alternate", F.struct("decided_at", "alternate")).alias("_mark")
    )
    return image_hash.join(last, "imagehash_id", "left").withColumn(
        "alternate_version", F.coalesce("_mark", "alternate_version")
    ).drop("_mark")


def hash_list(
    image_hash: DataFrame, content: DataFrame, alternate: bool | None = None, text: str | None = None
) -> DataFrame:
    """Hashes in hex, filtered by alternate flag and by text in the item's title or slug."""
    rows = image_hash if alternate is None else image_hash.filter(F.col("alternate_version") == alternate)
    rows = rows.join(content.select("content_id", "title", "slug"), "content_id")
    if text:
        needle = F.lower(F.lit(text))
        rows = rows.filter(F.lower("title").contains(needle) | F.lower("slug").contains(needle))
    return rows.select(
        "imagehash_id", "content_id", "aspect_ratio", *[hashing.hex_text(h).alias(h) for h in _HASHES],
        "alternate_version",
    )
