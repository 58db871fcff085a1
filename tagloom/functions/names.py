"""File names and storage paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagloom import rules
from tagloom.functions.common import ColumnOrName, col, lookup, python_quote
from tagloom.functions.origins import file_safe_id, site_prefix

DIGITS = "0123456789"
LETTERS_AND_DIGITS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" + DIGITS


def path_stem(name: ColumnOrName) -> Column:
    """Last path element without its last suffix."""
    base = F.regexp_extract(col(name), r"([^/]+)/*$", 1)
    cut = F.regexp_extract(base, r"(?s)^(.+)\.[^.]+$", 1)
    return F.when(cut == "", base).otherwise(cut)


def scattered_name(seed: ColumnOrName, alphabet: str, length: int = 16) -> Column:
    """A random-looking name that the same seed always gets, so reruns agree."""
    digest = F.sha2(col(seed).cast("string"), 256)
    letter = lambda i: F.substring(
        F.lit(alphabet),
        (F.conv(F.substring(digest, i * 2 + 1, F.lit(2)), 16, 10).cast("int") % len(alphabet)) + 1,
        F.lit(1),
    )
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(length - 1)), letter), "")


def clean_title(title: ColumnOrName) -> Column:
    """Title without slashes and without known file suffixes at its end."""
    title = col(title)
    start = F.when(F.coalesce(title, F.lit("")) == "", "Untitled").otherwise(F.translate(title, "/", "_"))
    suffixes = F.array(*[F.lit(s) for s in rules.FORMAT_BY_SUFFIX])
    return F.aggregate(
        suffixes,
        start,
        lambda text, s: F.when(
            F.endswith(text, s), F.left(text, F.length(text) - F.length(s))
        ).otherwise(text),
    )


def content_slug_name(slug: ColumnOrName, suffix: ColumnOrName) -> Column:
    return F.concat(col(slug), col(suffix))


def title_slug_name(content_id, title, site, origin_id, suffix) -> Column:
    """``site``/``origin_id`` are those of the main origin, null where there is none."""
    lead = F.when(
        col(origin_id).isNotNull(), F.concat(site_prefix(site), col(origin_id))
    ).otherwise(F.concat(F.lit(rules.ITEM_STEM), col(content_id).cast("string")))
    return python_quote(F.concat(lead, F.lit(" "), clean_title(title), col(suffix)))


def origin_id_name(content_id, origin_id, suffix) -> Column:
    stem = F.coalesce(
        col(origin_id), F.concat(F.lit(rules.ITEM_STEM), col(content_id).cast("string"))
    )
    return F.concat(stem, col(suffix))


def storage_path(
    content_id, source_hash, site, origin_id, date, level, width, height, suffix
) -> Column:
    """``Y/m/d/item hash origin_level_size.suffix`` of a stored rendition."""
    digest = F.left(F.translate(F.base64(col(source_hash)), "+/", "-_"), F.lit(12))
    known = site_prefix(site).isNotNull() & (F.coalesce(col(origin_id), F.lit("")) != "")
    origin = F.when(known, F.concat(F.lit(" "), site_prefix(site), file_safe_id(origin_id))).otherwise("")
    has_size = (F.coalesce(col(width), F.lit(0)) != 0) & (F.coalesce(col(height), F.lit(0)) != 0)
    size = F.when(
        has_size, F.concat(F.lit("_"), col(width).cast("string"), F.lit("x"), col(height).cast("string"))
    ).otherwise("")
    return F.concat(
        F.date_format(col(date), "yyyy/MM/dd"),
        F.lit(f"/{rules.ITEM_STEM}"), col(content_id).cast("string"), F.lit(" "), digest, origin,
        F.lit("_cl"), col(level).cast("string"), size, col(suffix),
    )


def normalise_filename(name, mime, seed, directory: str = "queue") -> Column:
    """Queue file name: the stem cut to fit the path limit, with the suffix of the type.

    Null for a type without a suffix; a file without a name gets one from ``seed``.
    """
    suffix = lookup(col(mime), rules.SUFFIX_BY_MIME)
    room = (
        F.lit(rules.FILE_NAME_LIMIT - (len(directory) + 1) - rules.FILE_NAME_RESERVE)
        - F.length(suffix)
    )
    given = F.left(path_stem(name), room)
    named = F.coalesce(col(name), F.lit("")) != ""
    return F.concat(
        F.when(named, given).otherwise(scattered_name(seed, LETTERS_AND_DIGITS)), suffix
    )


def content_slug(date: ColumnOrName, source_hash: ColumnOrName) -> Column:
    return F.concat(
        F.date_format(col(date), "yyyy-MM-dd"), F.lit("-"), F.lower(F.hex(col(source_hash)))
    )
