"""Small Column helpers shared by the function modules."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lookup(key: Column, table: Mapping, default=None) -> Column:
    """Value of ``key`` in a small fixed table; ``default`` where it is not listed."""
    if not table:
        return F.lit(default)
    entries = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    found = F.try_element_at(entries, key)
    return found if default is None else F.coalesce(found, F.lit(default))


def any_true(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def first_match(rules: list[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    chain = None
    for condition, value in rules:
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    return chain if otherwise is None else chain.otherwise(otherwise)


def python_quote(c: ColumnOrName) -> Column:
    """Percent-encoding that leaves letters, digits and ``_.-~/`` alone."""
    encoded = F.url_encode(col(c))
    for got, want in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        encoded = F.replace(encoded, F.lit(got), F.lit(want))
    return encoded


def at_least(text: Column, width: int) -> Column:
    """Left-pad with zeros without ever cutting."""
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)
