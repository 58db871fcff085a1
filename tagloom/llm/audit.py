"""How five quality filters act on each other: what each removes in all 120 orders they can be applied in."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.common import map_columns

FILTERS = "ABCDE"
ORDERS = ["".join(order) for order in permutations(FILTERS)]
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
SHAPE = (len(ORDERS), len(FILTERS), len(COUNTS))
FIELD = np.dtype("<u8")  # a field of a packed integer; no table has 2^63 rows, so none carries into the next
PACKED_BYTES = int(np.prod(SHAPE)) * FIELD.itemsize
PARTS_HELD = 512  # sums a task holds before it sends them
SALTS = 1024  # groups that a part's sums meet in before they become one
GOOD, TOXIC = 32, 64  # flags beside the bits of the filters

_SYMBOL = re.compile(r"[#$%&*|]")
_CAPITALS = bytes(range(65, 91))


def fails(text: str) -> int:
    """Bits of the filters A to D that a text fails; E needs the other documents."""
    raw = text.encode()
    words = raw.split()
    a = len(words) < 100
    b = 100 * len(set(words)) < 80 * len(words)
    c = 100 * (len(raw) - len(raw.translate(None, _CAPITALS))) > 10 * len(text)
    return a | b << 1 | c << 2 | (_SYMBOL.search(text) is not None) << 3


def packed(mask: int) -> int:
    """All step outcomes of one document with this mask, as the fields of one integer."""
    out = np.zeros(SHAPE, FIELD)
    for i, order in enumerate(ORDERS):
        gone = False
        for step, name in enumerate(order):
            bit = 1 << FILTERS.index(name)
            failed = bool(mask & bit)
            removed = failed and not gone
            gone = gone or failed
            lost = (removed and bool(mask & GOOD), removed and bool(mask & TOXIC))
            out[i, step] = (not gone, removed, failed and not removed, mask & 31 == bit, *lost)
    return int.from_bytes(out.tobytes(), "little")


def unpacked(total: int) -> np.ndarray:
    """The fields of a sum of packed integers: order, step, count."""
    return np.frombuffer(total.to_bytes(PACKED_BYTES, "little"), FIELD).reshape(SHAPE).astype(np.int64)


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n): how many documents; a row per text, part and labels and less where copies are.

    Copies of a text differ in E alone, so they are counted, not listed: first by document, then by
    text, both combined before they are shuffled. Then the first document of a text passes E, with
    all rows that have its id, and its other documents fail.
    """
    slim = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"),
        F.coalesce(docs["lang"].cast("string"), F.lit("")).alias("part"),
    )
    judged = map_columns(
        slim,
        lambda: lambda r: {
            "doc_id": pa.array(r["doc_id"], pa.int64()), "part": pa.array(r["part"], pa.string()),
            "mask": pa.array(map(fails, r["text"]), pa.int32()),
            "digest": pa.array([hashlib.sha256(t.encode()).digest() for t in r["text"]], pa.binary()),
        },
        "doc_id long, part string, mask int, digest binary",
    )
    flag = lambda name, bit: F.when(F.max(labels[name]) == 1, bit).otherwise(0)
    flags = labels.groupBy(labels["doc_id"].cast("long").alias("doc_id")).agg(
        (flag("quality", GOOD) + flag("toxic", TOXIC)).alias("flags")
    )
    joined = judged.join(flags, "doc_id", "left").withColumn("mask", F.col("mask") + F.coalesce("flags", F.lit(0)))
    by_id = joined.groupBy("digest", "part", "mask", "doc_id").agg(F.count("*").alias("n"))
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    alone = F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0))
    by_text = by_id.groupBy("digest", "part", "mask").agg(F.sum("n").alias("n"), first.alias("first"), alone.alias("alone"))
    # What is left of a text is a row per part and labels, however many copies it has.
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))
    here = F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    passes = F.col("alone") + here
    ends = F.array(
        F.struct(F.col("mask").alias("mask"), passes.alias("n")),
        F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - passes).alias("n")),
    )
    return by_text.withColumn("least", least).select("part", F.explode(ends).alias("e")).select("part", "e.mask", "e.n").filter("n > 0")


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of the packed integers of each part in a task."""
    known, held, salt = {}, {}, TaskContext.get().partitionId() % SALTS

    def send() -> pa.RecordBatch:
        raw = [x.to_bytes(PACKED_BYTES, "little") for x in held.values()]
        return pa.RecordBatch.from_pydict({
            "part": pa.array(held, pa.string()), "salt": pa.array([salt] * len(raw), pa.int32()), "packed": pa.array(raw, pa.binary())
        })

    for batch in batches:
        count = Counter()
        for part, mask, n in zip(*(c.to_pylist() for c in batch.columns)):
            count[part, mask] += n
        for (part, mask), n in count.items():
            if mask not in known:
                known[mask] = packed(mask)
            held[part] = held.get(part, 0) + n * known[mask]
            if len(held) >= PARTS_HELD:
                yield send()
                held.clear()
    if held:
        yield send()


def _total(table: pa.Table) -> int:
    return sum(int.from_bytes(x.as_py(), "little") for x in table.column("packed"))


def _merged(table: pa.Table) -> pa.Table:
    return pa.table({"part": table.column("part").slice(0, 1), "packed": pa.array([_total(table).to_bytes(PACKED_BYTES, "little")], pa.binary())})


def _report(table: pa.Table) -> pa.Table:
    counts = unpacked(_total(table))
    names = [f for order in ORDERS for f in order]
    removed = counts[..., COUNTS.index("removed")].ravel()
    shapley = Counter()
    for name, n in zip(names, removed.tolist()):
        shapley[name] += n
    rows = len(names)
    columns = {
        "part": pa.array(table.column("part")[:1].to_pylist() * rows, pa.string()),
        "filter_order": pa.array([order for order in ORDERS for _ in order], pa.string()),
        "step": pa.array([1, 2, 3, 4, 5] * len(ORDERS), pa.int32()),
    }
    columns |= {c: pa.array(counts[..., i].ravel()) for i, c in enumerate(COUNTS)}
    return pa.table(columns | {"shapley": pa.array([shapley[name] for name in names], pa.int64())})


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per part, order of the filters and step: part, filter_order, step and the counts.

    ``docs`` has doc_id, text and lang (the part), ``labels`` has doc_id, quality and toxic. A
    document's mask says which filters it fails; every mask is one wide integer, whose 64-bit fields
    hold what happens to such a document at each of the 600 steps. A part's counts are the sum of its
    documents' integers: tasks add up theirs, then groups of tasks, then the part. ``shapley`` is what
    a step's filter removes, over all orders.

    A null text is empty, a null lang is the part "". A null doc_id is smaller than none and larger than
    none: such a row passes E, whatever its text, and has no labels. Rows with one id and text are as many
    documents, and none of them fails E for another. Of several label rows of an id, one that says 1
    decides; null labels say nothing. An empty table gives no rows. Other columns are ignored.
    """
    sent = masks(docs, labels).select("part", F.col("mask").cast("int"), F.col("n").cast("long")).mapInArrow(
        _sums, "part string, salt int, packed binary"
    )
    met = sent.groupBy("part", "salt").applyInArrow(_merged, "part string, packed binary")
    counts = ", ".join(f"{c} long" for c in (*COUNTS, "shapley"))
    return met.groupBy("part").applyInArrow(_report, f"part string, filter_order string, step int, {counts}")


SQL = r"""
with judged as (
    select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words
    from documents
), flags as (
    select doc_id, coalesce(max(quality) = 1, false) as good, coalesce(max(toxic) = 1, false) as toxic from labels group by doc_id
), failed as (
    select j.part, coalesce(f.good, false) as good, coalesce(f.toxic, false) as toxic,
        len(words) < 100 as a,
        100 * len(list_distinct(words)) < 80 * len(words) as b,
        100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) as c,
        regexp_matches(t, '[#$%&*|]') as d,
        coalesce(j.doc_id > min(j.doc_id) over (partition by t), false) as e
    from judged j left join flags f on j.doc_id = f.doc_id
), counted as (
    select part, good, toxic, map {'A': a, 'B': b, 'C': c, 'D': d, 'E': e} as fails,
        a::int + b::int + c::int + d::int + e::int as n_fails, count(*) as n
    from failed group by all
), letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
orders as (
    select p.x || q.x || r.x || s.x || t.x as filter_order from letters p, letters q, letters r, letters s, letters t
    where len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5
), steps as (select filter_order, step from orders, (select unnest([1, 2, 3, 4, 5]) as step)),
outcomes as (
    select part, filter_order, step, filter_order[step] as f, n, good, toxic, n_fails,
        fails[filter_order[step]] as failing,
        list_bool_or([fails[filter_order[i]] for i in range(1, step)]) as gone
    from counted, steps
), summed as (
    select part, filter_order, step::int as step, any_value(f) as f,
        sum(case when not failing and not coalesce(gone, false) then n else 0 end)::bigint as kept,
        sum(case when failing and not coalesce(gone, false) then n else 0 end)::bigint as removed,
        sum(case when failing and gone then n else 0 end)::bigint as redundant,
        sum(case when failing and n_fails = 1 then n else 0 end)::bigint as unique_fails,
        sum(case when failing and not coalesce(gone, false) and good then n else 0 end)::bigint as good_lost,
        sum(case when failing and not coalesce(gone, false) and toxic then n else 0 end)::bigint as toxic_lost
    from outcomes group by part, filter_order, step
)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    (sum(removed) over (partition by part, f))::bigint as shapley
from summed
"""
