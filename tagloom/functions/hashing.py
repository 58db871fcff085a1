"""File identity and image signature keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagloom.functions.common import ColumnOrName, col


def source_hash(content: ColumnOrName) -> Column:
    """SHA-256 of the bytes: the identity of a file."""
    return F.unhex(F.sha2(col(content), 256))


def checksum(content: ColumnOrName) -> Column:
    """64-bit checksum of a rendition, signed. XXH64, so not comparable with XXH3 values."""
    return F.xxhash64(col(content))


def hex_text(value: ColumnOrName) -> Column:
    return F.lower(F.hex(col(value)))


def _lead(l_hash, a_hash, b_hash, n_l: int, n_ab: int) -> Column:
    return F.concat(
        F.substring(col(l_hash), 1, n_l), F.substring(col(a_hash), 1, n_ab),
        F.substring(col(b_hash), 1, n_ab),
    )


def search_similar(l_hash: ColumnOrName, a_hash: ColumnOrName, b_hash: ColumnOrName) -> Column:
    return _lead(l_hash, a_hash, b_hash, 4, 2)


def far_similarity(l_hash: ColumnOrName, a_hash: ColumnOrName, b_hash: ColumnOrName) -> Column:
    return _lead(l_hash, a_hash, b_hash, 2, 1)


def luma(red: ColumnOrName, green: ColumnOrName, blue: ColumnOrName) -> Column:
    return col(red) * 0.2126 + col(green) * 0.7152 + col(blue) * 0.0722
