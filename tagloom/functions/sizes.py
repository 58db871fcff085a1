"""Rounding and size arithmetic on image and frame dimensions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagloom.functions.common import ColumnOrName, col


def _number(x: ColumnOrName | int | float) -> Column:
    return F.lit(x) if isinstance(x, (int, float)) else col(x)


def bit_round(value: ColumnOrName | int | float, precision: int = 0) -> Column:
    """Nearest multiple of 2**-precision, ties to even."""
    scale = 2.0**precision
    return F.rint(_number(value).cast("double") * scale) / scale


def _whole(value: Column, precision: int) -> Column:
    return bit_round(value, precision).cast("int")


def _oriented(landscape: Column, long_side: Column, short_side: Column) -> Column:
    return F.struct(
        F.when(landscape, long_side).otherwise(short_side).alias("w"),
        F.when(landscape, short_side).otherwise(long_side).alias("h"),
    )


def _sides(width: Column, height: Column) -> tuple[Column, Column, Column]:
    return height <= width, F.greatest(width, height), F.least(width, height)


def scale_to_fill(width, height, min_size, precision: int = -1) -> Column:
    """Shrink until the short side equals ``min_size``; smaller frames are only rounded."""
    width, height, limit = _number(width), _number(height), _number(min_size)
    landscape, long_side, short_side = _sides(width, height)
    coefficient = short_side / limit
    keeps = short_side <= limit
    return _oriented(
        landscape,
        F.when(keeps, _whole(long_side, precision)).otherwise(
            _whole(long_side / coefficient, precision)
        ),
        F.when(keeps, _whole(short_side, precision)).otherwise(limit),
    )


def scale_fit_in(width, height, max_size, precision: int = -1) -> Column:
    """Shrink until the long side equals ``max_size``; smaller frames are only rounded."""
    width, height, limit = _number(width), _number(height), _number(max_size)
    landscape, long_side, short_side = _sides(width, height)
    coefficient = long_side / limit
    keeps = long_side <= limit
    return _oriented(
        landscape,
        F.when(keeps, _whole(long_side, precision)).otherwise(limit),
        F.when(keeps, _whole(short_side, precision)).otherwise(
            _whole(short_side / coefficient, precision)
        ),
    )


def scale_down(width, height, min_size, max_size, precision: int = -1) -> Column:
    """Struct (w, h): fill the short side if the long side then fits, else fit the long side."""
    filled = scale_to_fill(width, height, min_size, precision)
    fitted = scale_fit_in(width, height, max_size, precision)
    landscape = _number(height) <= _number(width)
    long_side = F.when(landscape, filled.w).otherwise(filled.h)
    short_side = F.when(landscape, filled.h).otherwise(filled.w)
    fits = (long_side <= _number(max_size)) & (short_side <= _number(min_size))
    return F.when(fits, filled).otherwise(fitted)


def fit_in_rect(width, height, rect_width, rect_height, precision: int = 0) -> Column:
    """Struct (scale, w, h); the scale follows the longer side of the source only."""
    width, height = _number(width), _number(height)
    rect_width, rect_height = _number(rect_width), _number(rect_height)
    larger = (width > rect_width) | (height > rect_height)
    scale = (
        F.when(larger & (width / height > 1), width / rect_width)
        .when(larger, height / rect_height)
        .otherwise(F.lit(1.0))
    )
    return F.struct(
        scale.alias("scale"),
        _whole(width / scale, precision).alias("w"),
        _whole(height / scale, precision).alias("h"),
    )


def size_relation(width, height, target_width, target_height) -> Column:
    """How many times the image covers the target, by the side that covers it more."""
    w, h = _number(width).cast("long"), _number(height).cast("long")
    tw, th = _number(target_width).cast("long"), _number(target_height).cast("long")
    return F.when(w * th >= tw * h, w / tw).otherwise(h / th)


def tile_exponent(width: ColumnOrName) -> Column:
    """log2 of the tile columns an encoder may use: tiles at least 256 wide, at most 64."""
    tiles = F.floor(_number(width) / 256)
    exponent = sum((tiles >= (1 << n)).cast("int") for n in range(1, 7))
    return exponent.cast("int")
