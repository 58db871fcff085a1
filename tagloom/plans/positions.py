"""Numbering and top-k that do not put one group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.session import settle

_ROW_BITS = 33  # monotonically_increasing_id keeps the row within the partition in the low 33 bits


def number_rows(
    df: DataFrame,
    name: str,
    order: Sequence[Column | str],
    by: Sequence[str] = (),
) -> DataFrame:
    """Add ``name`` = 1, 2, 3... in ``order``, within ``by`` or over all rows.

    Rows are range-partitioned on (by, order), so a group that holds most of the
    table is spread over many partitions like any other rows; ``order`` has to end
    in something unique. The sorted rows are settled once (range bounds come from
    sampling, so they must not be drawn twice), then a partition's first position
    is the count of all rows in the partitions before it.
    """
    keys = [F.col(c) for c in by] + [F.col(o) if isinstance(o, str) else o for o in order]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = settle(
        ranged.select("*", F.monotonically_increasing_id().alias("_at"))
    )
    row = F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    part = F.shiftright("_at", _ROW_BITS)
    placed = placed.select(
        *df.columns, part.alias("_part"), (row + 1).alias("_row")
    )
    # One row per partition of the exchange, so this window and broadcast stay tiny.
    sizes = placed.groupBy("_part").agg(F.max("_row").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    numbered = placed.join(F.broadcast(starts), "_part").withColumn(
        name, F.col("_start") + F.col("_row")
    )
    if by:
        first = numbered.groupBy(*by).agg(F.min(name).alias("_first"))
        numbered = numbered.join(first, list(by)).withColumn(
            name, F.col(name) - F.col("_first") + 1
        )
    return numbered.select(*df.columns, name)


def first_k(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, name: str = "_rank"
) -> DataFrame:
    """The first ``k`` rows of each group; ``name`` keeps their rank.

    ``row_number() <= k`` is planned with a group limit before the shuffle, so each
    map task sends at most ``k`` rows of a group, however large the group is.
    """
    window = Window.partitionBy(*by).orderBy(*order)
    ranked = df.withColumn(name, F.row_number().over(window))
    return ranked.filter(F.col(name) <= k)


def first_by(order: Sequence[Column], *values: str, last: bool = False) -> Column:
    """Struct of ``values`` of the first row in ``order``; merges on the map side."""
    picked = F.struct(*[F.col(v) for v in values])
    key = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    return F.max_by(picked, key) if last else F.min_by(picked, key)
