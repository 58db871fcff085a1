"""Perceptual signatures of images and per-pixel comparison."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions import hashing
from tagloom.functions.common import ColumnOrName, col
from tagloom.functions.sizes import bit_round

# Value range of a pixel by stored type (fixed values).
PIXEL_RANGE = {"uint8": 255.0, "uint16": 65535.0, "float32": 1.0, "float64": 1.0}

# sRGB to CIE XYZ (D65) and the D65 white point (fixed values, IEC 61966-2-1 / CIE 15).
_TO_XYZ = (
    (0.4124564, 0.3575761, 0.1804375),
    (0.2126729, 0.7151522, 0.0721750),
    (0.0193339, 0.1191920, 0.9503041),
)
_WHITE = (0.95047, 1.0, 1.08883)


def zigzag_order(side: int) -> list[int]:
    """Row-major indexes of a square in diagonal order, the first step going right."""
    cells = [(row, column) for row in range(side) for column in range(side)]
    along = lambda cell: cell[1] if sum(cell) % 2 == 0 else cell[0]
    return [r * side + c for r, c in sorted(cells, key=lambda cell: (sum(cell), along(cell)))]


def zigzag(values: ColumnOrName, side: int) -> Column:
    order = F.array(*[F.lit(k) for k in zigzag_order(side)])
    return F.transform(order, lambda k: F.get(col(values), k))


def _linear(channel: Column) -> Column:
    c = channel / 255.0
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def _lab(pixel: Column) -> tuple[Column, Column, Column]:
    rgb = [_linear(pixel[name]) for name in ("r", "g", "b")]
    fs = []
    for row, white in zip(_TO_XYZ, _WHITE):
        t = (rgb[0] * row[0] + rgb[1] * row[1] + rgb[2] * row[2]) / white
        fs.append(F.when(t > 216 / 24389, F.cbrt(t)).otherwise((t * (24389 / 27) + 16.0) / 116.0))
    x, y, z = fs
    return y * 116.0 - 16.0, (x - y) * 500.0, (y - z) * 200.0


def lab_bands(pixels: DataFrame) -> DataFrame:
    """(image_id, l_band, a_band, b_band) as 8-bit values from sRGB arrays r, g, b."""
    zipped = F.arrays_zip("r", "g", "b")
    band = lambda pick: F.transform(zipped, lambda p: pick(_lab(p)).cast("int"))
    return pixels.select(
        "image_id",
        band(lambda lab: lab[0] / 100.0 * 255.0).alias("l_band"),
        band(lambda lab: lab[1] + 128.0).alias("a_band"),
        band(lambda lab: lab[2] + 128.0).alias("b_band"),
    )


def _hash_batch(bands: pd.Series, keep: int) -> list[bytes | None]:
    """Hashes of square bands: sign of each low frequency against their median."""
    result: list[bytes | None] = [None] * len(bands)
    order = zigzag_order(keep)
    sides = bands.map(lambda b: 0 if b is None else math.isqrt(len(b)) if math.isqrt(len(b)) ** 2 == len(b) else 0)
    for side, positions in sides.groupby(sides).groups.items():
        if side < keep:
            continue
        rows = np.asarray(positions)
        cube = np.stack([np.asarray(bands.iloc[p], dtype="float64") for p in rows]).reshape(-1, side, side)
        steps = np.arange(side)
        basis = np.cos(np.pi * np.outer(steps[:keep], 2 * steps + 1) / (2 * side))
        low = (basis @ cube @ basis.T).reshape(len(rows), keep * keep)
        bits = low > np.median(low, axis=1, keepdims=True)
        packed = np.packbits(bits[:, order], axis=1)
        usable = np.isfinite(low).all(axis=1)
        for p, line, good in zip(rows, packed, usable):
            result[p] = line.tobytes() if good else None
    return result


def visual_signature(bands: DataFrame, l_side: int = 16, ab_side: int = 8) -> DataFrame:
    """(imagehash_id, l_hash, a_hash, b_hash, search_similar, far_similarity, error).

    ``bands``: imagehash_id and square row-major arrays l_band, a_band, b_band. The
    transform is a matrix product over a whole Arrow batch; rows never meet, so the
    work spreads like the input does.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.reset_index(drop=True)
            yield pd.DataFrame(
                {
                    "imagehash_id": batch["imagehash_id"],
                    "l_hash": _hash_batch(batch["l_band"], l_side),
                    "a_hash": _hash_batch(batch["a_band"], ab_side),
                    "b_hash": _hash_batch(batch["b_band"], ab_side),
                }
            )

    hashed = bands.select("imagehash_id", "l_band", "a_band", "b_band").mapInPandas(
        run, "imagehash_id long, l_hash binary, a_hash binary, b_hash binary"
    )
    empty = F.col("l_hash").isNull() | F.col("a_hash").isNull() | F.col("b_hash").isNull()
    keys = ("l_hash", "a_hash", "b_hash")
    return hashed.select(
        "imagehash_id", *keys,
        F.when(~empty, hashing.search_similar(*keys)).alias("search_similar"),
        F.when(~empty, hashing.far_similarity(*keys)).alias("far_similarity"),
        F.when(empty, "empty hash").alias("error"),
    )


def signature_aspect(width: ColumnOrName, height: ColumnOrName) -> Column:
    """Aspect ratio as stored with a signature: to 1/256."""
    return bit_round(col(width) / col(height), 8)


def image_error(pairs: DataFrame) -> DataFrame:
    """(pair_id, rmse, psnr, error) of two pixel arrays (first, second) with their types.

    Equal images have an infinite psnr; unlike types or lengths are an error.
    """
    same_type = F.col("first_type") == F.col("second_type")
    same_size = F.size("first") == F.size("second")
    ranges = F.create_map(*[F.lit(x) for pair in PIXEL_RANGE.items() for x in pair])
    squares = F.zip_with("first", "second", lambda a, b: (a - b) * (a - b))
    total = F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)
    error = F.when(~same_type, "types differ").when(~same_size, "sizes differ")
    rows = pairs.select(
        "pair_id", error.alias("error"), F.try_element_at(ranges, F.col("first_type")).alias("_range"),
        F.when(error.isNull(), F.try_divide(total, F.size("first"))).alias("_mse"),
    )
    psnr = F.when(F.col("_mse") == 0, F.lit(float("inf"))).otherwise(
        F.log10(F.col("_range") * F.col("_range") / F.nullif(F.col("_mse"), F.lit(0.0))) * 10
    )
    return rows.select(
        "pair_id", F.sqrt("_mse").alias("rmse"), F.when(F.col("_mse").isNotNull(), psnr).alias("psnr"), "error"
    )


def _with_alpha(pixels: Column, channels: Column, wanted: Column) -> Column:
    """Row-major pixels; an image without alpha gets an opaque one where the other has it."""
    size = F.size(pixels)
    chunks = F.transform(
        F.sequence(F.lit(0), (size / channels).cast("int") - 1),
        lambda n: F.slice(pixels, n * channels + 1, channels),
    )
    opaque = F.flatten(F.transform(chunks, lambda p: F.concat(p, F.array(F.lit(255.0)))))
    return F.when(channels < wanted, opaque).otherwise(pixels)


def diff_heatmap(pairs: DataFrame) -> DataFrame:
    """(pair_id, heatmap, clipped, error): summed channel differences per pixel.

    ``pairs``: pair_id, first, second (row-major pixels with interleaved channels),
    width, height, channels of each. Sizes have to match.
    """
    fits = (F.col("first_width") == F.col("second_width")) & (F.col("first_height") == F.col("second_height"))
    depth = F.greatest("first_channels", "second_channels")
    a = _with_alpha(F.col("first"), F.col("first_channels"), depth)
    b = _with_alpha(F.col("second"), F.col("second_channels"), depth)
    rows = pairs.select(
        "pair_id", fits.alias("_fits"), depth.alias("_depth"),
        F.when(fits, F.zip_with(a, b, lambda x, y: F.abs(x - y))).alias("_diff"),
    )
    cells = F.transform(
        F.sequence(F.lit(0), (F.size("_diff") / F.col("_depth")).cast("int") - 1),
        lambda n: F.aggregate(
            F.slice("_diff", n * F.col("_depth") + 1, F.col("_depth")), F.lit(0.0), lambda s, x: s + x,
            lambda s: s.cast("int"),
        ),
    )
    rows = rows.select("pair_id", F.when(F.col("_fits"), cells).alias("heatmap"), "_fits")
    return rows.select(
        "pair_id", "heatmap", F.transform("heatmap", lambda x: F.least(x, F.lit(255))).alias("clipped"),
        F.when(~F.col("_fits"), "different sizes").alias("error"),
    )
