"""Numbers and dates as the reports print them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagloom.functions.common import ColumnOrName, col


def two_places(value: Column) -> Column:
    # Ties round to even before printing; the formatter alone would round them up.
    return F.format_string("%.2f", F.bround(value.cast("double"), 2))


def one_place(value: Column) -> Column:
    return F.format_string("%.1f", F.bround(value.cast("double"), 1))


def format_size(size: ColumnOrName) -> Column:
    size = col(size)
    chain = None
    for unit, power in (("GiB", 30), ("MiB", 20), ("KiB", 10)):
        shown = F.concat(two_places(size / F.lit(float(1 << power))), F.lit(f" {unit}"))
        condition = size >= F.lit(1 << power)
        chain = F.when(condition, shown) if chain is None else chain.when(condition, shown)
    return chain.otherwise(F.concat(size.cast("string"), F.lit(" bytes")))


def signed_size(difference: ColumnOrName) -> Column:
    """Size of a change: the amount formatted as a size, behind its sign."""
    difference = col(difference)
    sign = F.when(difference > 0, "+").when(difference < 0, "-").otherwise("")
    return F.concat(sign, format_size(F.abs(difference)))


def saved_size(saved: ColumnOrName) -> Column:
    """Saved bytes; a loss, or nothing saved, is shown behind a minus sign."""
    saved = col(saved)
    text = format_size(F.abs(saved))
    return F.when(saved > 0, text).otherwise(F.concat(F.lit("-"), text))


def percent_of(part: ColumnOrName, whole: ColumnOrName) -> Column:
    """100 * part / whole; 0 where there is no whole."""
    whole = col(whole).cast("double")
    ratio = F.try_divide(col(part).cast("double"), whole) * 100
    return F.when(F.coalesce(whole, F.lit(0.0)) == 0, 0.0).otherwise(ratio)
