"""Compatibility levels of images."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagloom import rules
from tagloom.functions.common import ColumnOrName, col, first_match, lookup


def size_level(width: ColumnOrName, height: ColumnOrName) -> Column:
    side = F.greatest(col(width), col(height))
    steps = [(side <= limit, F.lit(level)) for level, limit in rules.IMAGE_SIDE_LIMITS]
    return first_match(steps, F.lit(len(rules.IMAGE_SIDE_LIMITS)))


def image_level(width: ColumnOrName, height: ColumnOrName, file_format: ColumnOrName) -> Column:
    """Level by size, at least the floor of the format; AVIF counts one size level higher."""
    file_format = col(file_format)
    floor = lookup(file_format, rules.IMAGE_FORMAT_FLOOR, 0)
    extra = F.when(file_format == "AVIF", 1).otherwise(0)
    return F.greatest(size_level(width, height) + extra, floor).cast("int")


def media_format_of_mime(mime: ColumnOrName) -> Column:
    return lookup(col(mime), rules.FORMAT_BY_MIME)


def media_format_of_suffix(suffix: ColumnOrName) -> Column:
    return lookup(col(suffix), rules.FORMAT_BY_SUFFIX)
