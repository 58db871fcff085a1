"""Media files on shared storage: listing, type detection, digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom import rules
from tagloom.functions.common import ColumnOrName, col, first_match

HEADER_BYTES = 2048
BLOCK_BYTES = 64 * 1024

# Leading bytes of each type, as hex from the start of the file (fixed values, public formats).
_PNG, _JPEG, _GIF, _EBML = "89504E470D0A1A0A", "FFD8", "47494638", "1A45DFA3"
_RIFF, _WEBP = "52494646", "57454250"
_MP4_BRANDS = ("isom", "iso2", "iso4", "iso5", "iso6", "mp41", "mp42", "avc1", "dash", "M4V ", "MSNV")


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, modified) of all files below ``root``; no file is opened."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def _open(path: str):
    """A byte stream of a file on any storage Arrow can reach, local paths included."""
    from pyarrow import fs

    filesystem, inner = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return filesystem.open_input_stream(inner)


def file_headers(files: DataFrame) -> DataFrame:
    """Add ``header``: the first bytes of each file. The rest of a file is not read."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            headers = []
            for path in batch["path"]:
                with _open(path) as stream:
                    headers.append(stream.read(HEADER_BYTES))
            yield batch.assign(header=headers)

    spread = files.select("path", "size", "modified").repartition("path")
    return spread.mapInPandas(run, "path string, size long, modified timestamp, header binary")


def detect_mime(header: ColumnOrName) -> Column:
    """Type of a file from its leading bytes, null for an unknown one."""
    header = col(header)
    start = lambda n: F.hex(F.substring(header, 1, n))
    brand = F.substring(header, 9, 4).cast("string")
    boxed = F.substring(header, 5, 4).cast("string") == "ftyp"
    text = header.cast("string")
    return first_match(
        [
            (start(8) == _PNG, F.lit("image/png")),
            (start(2) == _JPEG, F.lit("image/jpeg")),
            (start(4) == _GIF, F.lit("image/gif")),
            ((start(4) == _RIFF) & (F.hex(F.substring(header, 9, 4)) == _WEBP), F.lit("image/webp")),
            (boxed & brand.isin("avif", "avis"), F.lit("image/avif")),
            (boxed & (brand == "qt  "), F.lit("video/quicktime")),
            (boxed & brand.isin(*_MP4_BRANDS), F.lit("video/mp4")),
            ((start(4) == _EBML) & F.contains(text, F.lit("webm")), F.lit("video/webm")),
            (start(4) == _EBML, F.lit("video/x-matroska")),
            (text.rlike(r"<svg[^>]*>"), F.lit("image/svg+xml")),
        ]
    )


def scan_files(spark: SparkSession, root: str, claimed: DataFrame | None = None) -> DataFrame:
    """(path, size, modified, mime_type, media_type, error) of all files below ``root``.

    ``claimed`` (path, mime_type) are types told at upload: a file that looks like
    QuickTime but was sent as MP4 is taken as MP4.
    """
    rows = file_headers(list_files(spark, root)).withColumn("mime_type", detect_mime("header")).drop("header")
    if claimed is not None:
        told = claimed.select("path", F.col("mime_type").alias("_told"))
        as_mp4 = (F.col("mime_type") == "video/quicktime") & (F.col("_told") == "video/mp4")
        rows = rows.join(told, "path", "left").withColumn(
            "mime_type", F.when(as_mp4, "video/mp4").otherwise(F.col("mime_type"))
        ).drop("_told")
    kind = F.split_part("mime_type", F.lit("/"), F.lit(1))
    return rows.select(
        "*", F.when(kind.isin(*rules.MEDIA_TYPES), kind).alias("media_type"),
        F.when(F.col("mime_type").isNull(), "undetected content type").alias("error"),
    )


def hash_files(files: DataFrame) -> DataFrame:
    """(path, source_hash): SHA-256 of each file, read in blocks so size does not matter."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            digests = []
            for path in batch["path"]:
                digest = hashlib.sha256()
                with _open(path) as stream:
                    while block := stream.read(BLOCK_BYTES):
                        digest.update(block)
                digests.append(digest.digest())
            yield pd.DataFrame({"path": batch["path"], "source_hash": digests})

    return files.select("path").repartition("path").mapInPandas(run, "path string, source_hash binary")
