"""Sharding: groups of documents in order, cut into shards whose largest is as small as can be."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import settle_table, texts
from tagloom.plans.positions import number_rows

KNOWN = 20_000  # ends of groups the driver asks for at a time


class Ends:
    """What the driver knows of the sorted ends (running sizes) of all groups, and asks for more of.

    Between two neighbours in ``ends`` there may be ends it does not know, unless the gap is in ``whole``.
    """

    def __init__(self, total: int):
        self.ends, self.whole = [0, total], set()

    def reach(self, target: int) -> tuple[int, int]:
        """The last end up to ``target`` lies between these two; they are equal where it is known."""
        i = bisect_right(self.ends, target) - 1
        low = self.ends[i]
        if i + 1 == len(self.ends) or low == target or low in self.whole:
            return low, low
        return low, min(target, self.ends[i + 1] - 1)

    def cuts(self, capacity: int, shards: int, high: bool) -> list[int]:
        """Greedy cuts with this capacity, by the lower or upper bound of each reach; as many as there are shards."""
        at, out = 0, []
        for _ in range(shards):
            at = self.reach(at + capacity)[high]
            out.append(at)
        return out


def smallest(feasible, low: int, high: int) -> int:
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if feasible(middle) else (middle + 1, high)
    return low


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The smallest capacity for which ``shards`` runs of consecutive groups suffice, and the runs' ends.

    ``groups`` has a row per group with ``size`` and ``end``, the running size with this group. A
    capacity is feasible if filling each shard as far as groups go needs no more than ``shards``;
    the smallest is found by halving. The driver looks at ends of groups on a grid of at most about
    KNOWN cells and asks again, on a finer grid, only where a cut may fall, until every cut is an
    end it knows; so it holds few ends at any number of groups.
    """
    top = groups.agg(F.max("end").alias("total"), F.max("size").alias("largest")).first()
    total, known = top["total"] or 0, Ends(top["total"] or 0)
    if not total:
        return 0, []
    while True:
        least = max(top["largest"], -(-total // shards))
        # With unknown ends taken for none, a feasible capacity is so in truth; taken for anywhere, an infeasible one.
        sure = smallest(lambda c: known.cuts(c, shards, False)[-1] >= total, least, total)
        hoped = smallest(lambda c: known.cuts(c, shards, True)[-1] >= total, least, total)
        spans = []
        for low, high in zip(known.cuts(hoped, shards, False), known.cuts(sure, shards, True)):
            i, j = bisect_right(known.ends, low) - 1, bisect_right(known.ends, high)
            open_ = [(a, b) for a, b in zip(known.ends[i:j], known.ends[i + 1 : j + 1]) if a not in known.whole]
            if open_:  # one stretch for each cut
                spans.append((open_[0][0], open_[-1][1]))
        spans = sorted(set(spans))
        if not spans or sure == hoped and all(known.reach(a + sure)[0] == known.reach(a + sure)[1] for a in [0, *known.cuts(sure, shards, False)]):
            return sure, [c for c in dict.fromkeys(known.cuts(sure, shards, False))]
        runs = []  # stretches that meet as one
        for a, b in spans:
            if runs and runs[-1][1] >= a:
                runs[-1][1] = max(runs[-1][1], b)
            else:
                runs.append([a, b])
        step = max(1, sum(b - a for a, b in runs) // KNOWN)
        inside = F.lit(False)
        for a, b in runs:
            inside = inside | ((F.col("end") > a) & (F.col("end") <= b))
        cell = F.floor((F.col("end") - 1) / step).cast("long")
        found = groups.filter(inside).groupBy(cell.alias("cell")).agg(
            F.max("end").alias("end"), F.max(F.struct("end", "size"))["size"].alias("size"), F.count("*").alias("n")
        ).collect()
        for r in found:
            if r["n"] == 1:  # nothing else ends in this cell: the gap before this end begins where the group does
                known.whole.add(r["end"] - r["size"])
        known.ends = sorted({*known.ends, *(r["end"] for r in found), *(r["end"] - r["size"] for r in found)})
        known.whole.update(r["end"] - r["size"] for r in found)


def shard(docs: DataFrame, shards: int = 40, overhead: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): equal texts stay together, shards are near equal in bytes.

    A size is the UTF-8 bytes of the text and ``overhead``. Groups of equal texts stand in the order
    of their smallest doc_id; :func:`minimax_cuts` cuts them so that the largest shard is as small as
    consecutive whole groups allow. A group larger than a fair share is a shard of its own, and the
    others share the rest. Slots count from 0 in a shard by doc_id. Null texts are a group of their
    own, of no bytes; null ids come first; repeated rows are placed one by one; other columns are
    ignored; an empty table gives no row.
    """
    text = F.col("text")
    rows = settle_table(
        docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).select(
            "doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            F.coalesce(F.unhex(F.sha2(text, 256)), F.unhex(F.lit(""))).alias("key"),
        ),
        "sized",
    )
    groups = rows.groupBy("key").agg(F.min("doc_id").alias("first"), F.sum("size").alias("size"))
    ended = settle_table(running(groups, "size", [F.asc_nulls_first("first"), F.col("key")]), "groups")
    _, cuts = minimax_cuts(ended, shards)
    number = sum((F.when(F.col("end") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    placed = settle_table(rows.join(ended.select("key", number.cast("int").alias("shard")), "key"), "placed")
    slots = number_rows(placed, "slot", [F.asc_nulls_first("doc_id"), F.col("key")], by=["shard"])
    return slots.select("doc_id", "size", "text_crc32", "shard", (F.col("slot") - 1).cast("long").alias("slot"))


def running(df: DataFrame, size: str, order: list[Column]) -> DataFrame:
    """``df`` and ``end``, the running sum of ``size`` in ``order``.

    Rows are dealt by ranges and sorted there; each partition's sum (a row per partition) gives the
    next ones their start, and only running sums within a partition are left to a window.
    """
    from pyspark.sql import Window

    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = settle_table(ranged.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_row")), "ranged")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = kept.groupBy("_part").agg(F.sum(size).alias("_sum")).select(
        "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start")
    )
    inside = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return kept.join(F.broadcast(starts), "_part").select(
        *df.columns, (F.col("_start") + F.sum(size).over(inside)).cast("long").alias("end")
    )
