"""Joins in which a few keys may hold most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.session import settle_table

BROADCAST_ROWS = 200_000  # of the small side, counted before it is broadcast
SHARE = 1000  # a key with more than a SHARE-th of the rows is split
TRACKED = 16 * SHARE  # keys the sketch counts; no key above the share escapes it
SALTS = 64


def frequent_keys(rows: DataFrame, key: Column) -> list[int]:
    """Hashes of the keys that hold more than a SHARE-th of ``rows``: fewer than 2 * SHARE of them.

    A sketch of bounded size counts them in one pass, merged on the map side.
    """
    sketch = rows.select(F.xxhash64(key).alias("k")).agg(
        F.expr(f"approx_top_k(k, {2 * SHARE}, {TRACKED})").alias("top"), F.count(F.lit(1)).alias("n")
    )
    found = sketch.select(F.explode("top").alias("t"), "n").filter(F.col("t.count") * SHARE > F.col("n"))
    return sorted(r[0] for r in found.select("t.item").collect())


def split_join(
    rows: DataFrame, small: DataFrame, on: str, spread: Sequence[str], how: str = "inner", most: int = BROADCAST_ROWS,
    write: bool = True,
) -> DataFrame:
    """Join ``rows`` with ``small`` on a column, whatever share of ``rows`` a key has.

    A ``small`` of at most ``most`` rows is broadcast, so nothing is shuffled. Otherwise ``rows`` are
    written once (unless not ``write``), as they are read for the count of their keys and for the join. Rows of frequent keys
    meet a broadcast of what ``small`` has of these keys, so only the others are shuffled. If that is more
    than ``most`` rows as well, the rows of frequent keys are dealt out over SALTS by a hash of their
    ``spread`` columns (which tell rows of a key apart, so a task that is run again deals them alike), and
    the rows of ``small`` with such a key are sent to each of these; all other keys are joined as they
    are. ``how``: inner, left or left_semi.
    """
    if how not in ("inner", "left", "left_semi"):
        raise ValueError("how is 'inner', 'left' or 'left_semi'")
    if small.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(small), on, how)
    if write:
        rows = settle_table(rows, "rows")
    hot = frequent_keys(rows, F.col(on))
    if not hot:
        return rows.join(small, on, how)
    is_hot = F.xxhash64(F.col(on)).isin(hot)
    few = small.filter(is_hot)
    if few.limit(most + 1).count() <= most:
        rest = rows.filter(~is_hot).join(small.filter(~is_hot), on, how)
        return rows.filter(is_hot).join(F.broadcast(few), on, how).unionByName(rest)
    salted = rows.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(*spread), F.lit(SALTS))).otherwise(0).cast("int"))
    every = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    copies = small.withColumn("_salt", F.explode(every))
    return salted.join(copies, [on, "_salt"], how).drop("_salt")
