"""Choosing, describing and planning stored renditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom import rules
from tagloom.functions import names, sizes
from tagloom.functions.common import lookup, python_quote
from tagloom.functions.levels import image_level
from tagloom.plans.positions import first_by

MEDIA_URL = "/media/"


def images(representation: DataFrame) -> DataFrame:
    return representation.filter(F.col("repr_type") == rules.IMAGE)


def pick_representation(requests: DataFrame, representation: DataFrame) -> DataFrame:
    """Best rendition per request (content, content_type, level cap, target size).

    ``requests`` has a unique ``request_id``. An image with a target takes the
    narrowest rendition reaching it on either side, else the widest; other kinds take
    the highest level. ``status``: found, missing, or error for a one-sided target.
    """
    kind = lookup(F.col("content_type"), rules.REPR_KIND_OF_CONTENT)
    one_sided = F.col("target_width").isNull() != F.col("target_height").isNull()
    asked = requests.withColumns({"_kind": kind, "_bad": one_sided & (kind == rules.IMAGE)})
    r = representation.select(
        "content_id", F.col("repr_type").alias("_kind"), "compatibility_level", "width", "height", "filepath"
    )
    fit = asked.filter(~F.col("_bad")).join(r, ["content_id", "_kind"]).filter(
        F.col("compatibility_level") <= F.col("clevel")
    )
    is_image = F.col("_kind") == rules.IMAGE
    reaches = is_image & F.coalesce(
        (F.col("width") >= F.col("target_width")) | (F.col("height") >= F.col("target_height")), F.lit(False)
    )
    # Ranks as numbers, smallest first: reaching the target, then size, then level.
    order = [
        F.when(reaches, 0).otherwise(1),
        F.when(reaches, F.col("width")).when(is_image, -F.col("width")).otherwise(0),
        F.when(reaches, 0).otherwise(-F.col("compatibility_level")),
        F.col("filepath"),
    ]
    best = fit.groupBy("request_id").agg(
        first_by(order, "filepath", "width", "height", "compatibility_level").alias("_p")
    )
    status = F.when(F.col("_bad"), "error").when(F.col("_p").isNull(), "missing").otherwise("found")
    return asked.join(best, "request_id", "left").select(
        *requests.columns, status.alias("status"), F.col("_p.filepath").alias("filepath"),
        F.col("_p.width").alias("width"), F.col("_p.height").alias("height"),
        F.col("_p.compatibility_level").alias("compatibility_level"),
    )


def _reaches(target_width: int, target_height: int) -> Column:
    return (F.col("width") >= target_width) | (F.col("height") >= target_height)


def _entry(target_width: int, target_height: int, media_url: str, places: int | None) -> tuple[Column, Column]:
    """Address and printed pixel ratio of an image."""
    ratio = sizes.size_relation("width", "height", target_width, target_height)
    shown = ratio.cast("string") if places is None else F.format_string(f"%.{places}f", ratio)
    return F.concat(F.lit(media_url), python_quote("filepath")), shown


def srcset_entries(
    representation: DataFrame, target_width: int, target_height: int,
    media_url: str = MEDIA_URL, places: int | None = None,
) -> DataFrame:
    """One row per image that reaches the target: its address, width and pixel ratio."""
    url, shown = _entry(target_width, target_height, media_url, places)
    ratio = sizes.size_relation("width", "height", target_width, target_height)
    return (
        images(representation).filter(_reaches(target_width, target_height))
        .select("content_id", "width", "filepath", ratio.alias("ratio"), url.alias("url"), shown.alias("ratio_text"))
    )


def image_base(representation: DataFrame, target_width: int, target_height: int) -> DataFrame:
    """(content_id, srcset_n, base_src) of every item with an image.

    ``srcset_n`` counts the rows that ``srcset_entries`` has for the item. ``base_src`` is the
    narrowest image reaching the target, else the one with the largest area. Both are plain
    aggregates, so an item with any number of images is combined on the map side.
    """
    return images(representation).groupBy("content_id").agg(*base_columns(target_width, target_height))


def base_columns(target_width: int, target_height: int) -> list[Column]:
    """Aggregates ``srcset_n`` and ``base_src`` of the images among an item's renditions."""
    is_image = F.col("repr_type") == rules.IMAGE
    reaches = _reaches(target_width, target_height)
    area = F.col("width").cast("long") * F.col("height").cast("long")
    order = [
        F.when(reaches, 0).otherwise(1), F.when(~reaches, -area), F.col("width"), F.col("filepath"),
    ]
    key = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    # Rows without a key are passed over.
    return [
        F.count(F.when(is_image & reaches, 1)).alias("srcset_n"),
        F.min_by("filepath", F.when(is_image, key)).alias("base_src"),
    ]


def srcset_text(target_width: int, target_height: int, media_url: str = MEDIA_URL, places: int | None = None) -> Column:
    """Aggregate: what ``srcset_entries`` has for an item as one text, narrowest first; '' where it has nothing."""
    url, ratio = _entry(target_width, target_height, media_url, places)
    text = F.concat(url, F.lit(" "), ratio, F.lit("x"))
    reaches = (F.col("repr_type") == rules.IMAGE) & _reaches(target_width, target_height)
    entry = F.when(reaches, F.struct("width", "filepath", text.alias("text")))
    return F.array_join(F.sort_array(F.collect_list(entry))["text"], ", ")


def preview_pick(representation: DataFrame, limit: int) -> DataFrame:
    """Widest image with both sides within ``limit``, per item."""
    small = images(representation).filter((F.col("width") <= limit) & (F.col("height") <= limit))
    order = F.struct(-F.col("width"), F.col("filepath"))
    return small.groupBy("content_id").agg(F.min_by("filepath", order).alias("preview"))


def best_raster(representation: DataFrame) -> DataFrame:
    """Widest image that is not a drawing, per item."""
    raster = images(representation).filter(F.col("format") != "svg")
    best = raster.groupBy("content_id").agg(
        first_by([-F.col("width"), F.col("filepath")], "filepath", "width", "height").alias("b")
    )
    return best.select("content_id", "b.filepath", "b.width", "b.height")


def tagger_input(representation: DataFrame) -> DataFrame:
    """Widest image at level 1, per item: what a tagging service is given."""
    level_one = images(representation).filter(F.col("compatibility_level") == 1)
    order = F.struct(-F.col("width"), F.col("filepath"))
    return level_one.groupBy("content_id").agg(F.min_by("filepath", order).alias("filepath"))


def main_origins(origin: DataFrame, any_kind: bool = False) -> DataFrame:
    """First origin with an id per item; main ones only unless ``any_kind``."""
    named = origin.filter(F.col("origin_id") != "")
    if not any_kind:
        named = named.filter(~F.col("alternate"))
    first = named.groupBy("content_id").agg(
        first_by([F.col("name"), F.col("origin_id")], "name", "origin_id").alias("o")
    )
    return first.select("content_id", F.col("o.name").alias("site"), F.col("o.origin_id").alias("site_id"))


# Style name -> Column over (content columns, suffix, main_*, any_*, seed); callers may add styles.
NAME_STYLES = {
    "content_slug": lambda seed: names.content_slug_name("slug", "suffix"),
    "title_slug": lambda seed: names.title_slug_name(
        "content_id", "title", "main_site", "main_id", "suffix"
    ),
    "origin_id": lambda seed: names.origin_id_name("content_id", "any_id", "suffix"),
    "random_string": lambda seed: F.concat(
        names.scattered_name(F.concat_ws("|", F.lit(seed), "filepath"), names.LETTERS_AND_DIGITS), "suffix"
    ),
    "random_digits": lambda seed: F.concat(
        names.scattered_name(F.concat_ws("|", F.lit(seed), "filepath"), names.DIGITS), "suffix"
    ),
}


def download_names(
    content: DataFrame, origin: DataFrame, representation: DataFrame, style: str, seed: str = "0"
) -> DataFrame:
    """(content_id, filepath, file_name): what a rendition is called when downloaded."""
    main = main_origins(origin).withColumnsRenamed({"site": "main_site", "site_id": "main_id"})
    any_kind = main_origins(origin, True).withColumnsRenamed({"site": "any_site", "site_id": "any_id"})
    rows = representation.select(
        "content_id", "filepath", F.concat(F.lit("."), "format").alias("suffix")
    ).join(content.select("content_id", "slug", "title"), "content_id")
    if style == "title_slug":
        rows = rows.join(main, "content_id", "left")
    elif style == "origin_id":
        rows = rows.join(any_kind, "content_id", "left")
    return rows.select("content_id", "filepath", NAME_STYLES[style](seed).alias("file_name"))


def storage_paths(
    content: DataFrame, origin: DataFrame, representation: DataFrame, date: Column
) -> DataFrame:
    """(content_id, filepath, stored_path): where renditions of an item are kept."""
    first = origin.groupBy("content_id").agg(
        first_by([F.col("name"), F.col("origin_id")], "name", "origin_id").alias("o")
    )
    rows = representation.join(content.select("content_id", "source_hash"), "content_id").join(
        first, "content_id", "left"
    )
    path = names.storage_path(
        "content_id", "source_hash", "o.name", "o.origin_id", date, "compatibility_level",
        "width", "height", F.concat(F.lit("."), "format"),
    )
    return rows.select("content_id", "filepath", path.alias("stored_path"))


# Longest side of a rung -> (format, quality, effort). Callers may add rungs.
LADDER = dict(rules.LADDER)


def _rung(size: int, fmt: Column, width: Column, height: Column) -> Column:
    """What one ladder rung does to an image: shrink it, keep it, or nothing (null)."""
    side = F.greatest(width, height)
    smaller = [s for s in LADDER if s < size]
    larger = side > size
    similar = ~larger & (side > max(smaller)) if smaller else ~larger
    out_format, quality, effort = LADDER[size]
    keeps_source = similar & (
        (fmt == "JPEG") | ((fmt == "WEBP") & ~F.coalesce(F.col("is_lossless"), F.lit(False)))
    )
    # The shrunk image touches the rung with its longer side.
    scale = F.when(larger, F.lit(float(size)) / side).otherwise(1.0)
    made = lambda d: F.greatest(F.floor(d * scale + 0.5), F.lit(1)).cast("int")
    rung_format = F.when(keeps_source, fmt).otherwise(out_format)
    struct = F.struct(
        F.lit(size).alias("rung"),
        F.when(larger, "LARGER").otherwise("SIMILAR").alias("fit"),
        rung_format.alias("out_format"),
        F.when(~keeps_source, F.lit(quality)).alias("quality"),
        F.when(~keeps_source, F.lit(effort).cast("int")).alias("effort"),
        made(width).alias("out_width"), made(height).alias("out_height"),
        keeps_source.alias("keeps_source"),
    )
    wanted = larger | similar
    if size > rules.SVG_TOP_RUNG:
        wanted = wanted & (fmt != "SVG")
    return F.when(wanted, struct)


def image_ladder(files: DataFrame) -> DataFrame:
    """Rows (file_id, rung, ...) of the sizes an image is stored in.

    ``files``: file_id, width, height, format, is_lossless (WEBP). Rungs grow until
    one holds the whole image; a drawing keeps its original besides its rungs.
    """
    fmt, width, height = F.col("format"), F.col("width"), F.col("height")
    original = F.struct(
        F.lit(None).cast("int").alias("rung"), F.lit("ORIGINAL").alias("fit"), fmt.alias("out_format"),
        F.lit(None).cast("int").alias("quality"), F.lit(None).cast("int").alias("effort"),
        width.alias("out_width"), height.alias("out_height"), F.lit(True).alias("keeps_source"),
    )
    rungs = [_rung(size, fmt, width, height) for size in LADDER]
    rungs.append(F.when(fmt == "SVG", original))
    rows = files.select("file_id", F.explode(F.array_compact(F.array(*rungs))).alias("r")).select(
        "file_id", "r.*"
    )
    level = F.when(F.col("rung").isNull(), rules.IMAGE_FORMAT_FLOOR["SVG"]).otherwise(
        image_level("out_width", "out_height", "out_format")
    )
    return rows.withColumn("level", level.cast("int"))


def validate_representations(representation: DataFrame) -> DataFrame:
    """Violations (problem, filepath, n): sizes, levels, repeated paths."""
    sized = F.col("repr_type") >= rules.IMAGE
    checks = F.array_compact(
        F.array(
            F.when(sized & (F.coalesce("width", F.lit(0)) <= 0), "width"),
            F.when(sized & (F.coalesce("height", F.lit(0)) <= 0), "height"),
            F.when(~F.col("compatibility_level").isin(*rules.LEVEL_LABELS), "level"),
        )
    )
    rowwise = representation.select("filepath", F.explode(checks).alias("problem")).withColumn(
        "n", F.lit(1).cast("long")
    )
    repeated = (
        representation.groupBy("filepath").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        .withColumn("problem", F.lit("path"))
    )
    return rowwise.unionByName(repeated).select("problem", "filepath", "n")


def level_coverage(representation: DataFrame) -> DataFrame:
    """Renditions and items per level with its label; level 0 is not offered to viewers."""
    # Items are counted from distinct pairs, so a hot level is not held in one set.
    pairs = representation.groupBy("compatibility_level", "content_id").agg(F.count(F.lit(1)).alias("n"))
    counts = pairs.groupBy("compatibility_level").agg(
        F.sum("n").alias("renditions"), F.count(F.lit(1)).alias("items")
    )
    level = F.col("compatibility_level")
    return counts.select(
        level.alias("level"), lookup(level, rules.LEVEL_LABELS).alias("label"), "renditions", "items",
        (level > 0).alias("offered"), (level == rules.DEFAULT_LEVEL).alias("is_default"),
    )
