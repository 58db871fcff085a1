"""Tag name normalisation and alias generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagloom import rules
from tagloom.functions.common import ColumnOrName, col

# Characters a name is stripped of at both ends (fixed values: Unicode white space).
_SPACE_CODES = (
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0, 0x1680,
    *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
WHITE_SPACE = "".join(map(chr, _SPACE_CODES))


def prepare_tag_name(name: ColumnOrName) -> Column:
    return F.btrim(F.translate(F.lower(col(name)), "_", " "), F.lit(WHITE_SPACE))


def is_prefixed(category: ColumnOrName) -> Column:
    return col(category).isin(*rules.PREFIXED_CATEGORIES)


def generate_aliases(title: ColumnOrName, category: ColumnOrName) -> Column:
    """Array of one or two aliases: the spoken form, then the typed form if it differs."""
    title, category = col(title), col(category)
    typed = F.translate(title, " ", "_")
    spoken_prefix = F.when(is_prefixed(category), F.concat(category, F.lit(": "))).otherwise("")
    typed_prefix = F.when(
        is_prefixed(category), F.concat(F.translate(category, "-", "_"), F.lit(":"))
    ).otherwise("")
    return F.array_distinct(
        F.array(F.concat(spoken_prefix, title), F.concat(typed_prefix, typed))
    )
