"""Near duplicates by SimHash: every pair of fingerprints that differ in three bits or fewer, found in the middle."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.blocks import ascending, planes, unascending, unplanes
from tagloom.llm.common import map_columns, settle_table, texts
from tagloom.llm.components import components

BITS, WORDS, SEED = 64, 3, 42
RADIUS = 3
CHUNK = 1 << 16  # shingles whose bits are counted at a time
PRINTS = 1 << 12  # fingerprints whose variants are dealt out at a time
SHARD = 1 << 20  # variants of a group
TASK = 1 << 13  # fingerprints of a task
HEAVY = 1000  # a fingerprint with more than this part of all documents is joined by broadcast


def fingerprint(text: str) -> int:
    """A bit is 1 if more than half of the text's shingles have it in their XXH64; a shingle counts each time."""
    words = text.encode().lower().split()  # of bytes: A-Z and the six spaces, nothing else
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: max(1, len(words) - WORDS + 1)].tolist()
    ends = ends[min(WORDS, len(words)) - 1 :].tolist()
    digest, ones = xxhash.xxh64_digest, np.zeros(BITS, np.int64)
    for at in range(0, len(starts), CHUNK):
        raw = b"".join([digest(line[a:b], SEED) for a, b in zip(starts[at : at + CHUNK], ends[at : at + CHUNK])])
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, BITS // 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint): the 64 bits as a long."""
    return map_columns(
        texts(docs, doc_id, text),
        lambda: lambda r: {
            "doc_id": pa.array(r["doc_id"], pa.int64()),
            "fingerprint": pa.array(np.array([fingerprint(t) for t in r["text"]], np.uint64).view(np.int64)),
        },
        "doc_id long, fingerprint long", rows=64,
    )


def _flips(places) -> list[int]:
    return [sum(1 << p for p in at) for at in places]


_HALVES = (range(BITS // 2), range(BITS // 2, BITS))
#: What fingerprints flip: none, one bit, or two bits of the same half of the word.
FLIPS = np.array([0, *_flips((i,) for i in range(BITS)), *_flips(p for h in _HALVES for p in combinations(h, 2))], np.uint64)
NEAR = 1 + BITS  # so many of them flip one bit at most
_SPREAD = 0x9E3779B97F4A7C15  # odd, so variants are spread over shards without two becoming one
_GATHER = pow(_SPREAD, -1, 1 << BITS)


def variants(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(variants, flips): the points around fingerprints at which others can meet them, and the number of the flip each is.

    Two points at most three bits apart have a point between them that is one bit from one and at most
    two from the other. Of such a pair at an odd distance just one has an even number of ones. So even
    fingerprints flip one bit, and odd ones flip none, one or two:

    - three apart: the even one flips one of the three bits, the odd one the other two. It is free
      which, so the odd one needs only pairs of bits of the same half; of three bits, two always are.
    - two apart: both flip one of the two bits.
    - one apart: the even one flips it, the odd one none.
    """
    odd = np.bitwise_count(prints) % 2 == 1
    one = np.arange(1, NEAR)
    out = [(prints[~odd, None] ^ FLIPS[one]).ravel(), (prints[odd, None] ^ FLIPS).ravel()]
    flips = [np.tile(one, int((~odd).sum())), np.tile(np.arange(len(FLIPS)), int(odd.sum()))]
    return np.concatenate(out), np.concatenate(flips).astype(np.uint16)


def _sent(shard_bits: int):
    """A task that deals the variants of its fingerprints out to 2 ^ shard_bits ranges of spread variants."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("fingerprint").to_numpy().view(np.uint64)
            for at in range(0, len(own), PRINTS):
                points, flips = variants(own[at : at + PRINTS])
                points *= np.uint64(_SPREAD)
                order = np.argsort(points)
                points, flips = points[order], flips[order]
                shard = points >> np.uint64(BITS - shard_bits) if shard_bits else np.zeros(len(points), np.uint64)
                cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
                parts = list(zip(cuts, cuts[1:]))
                yield pa.RecordBatch.from_pydict({
                    "shard": pa.array([int(shard[a]) for a, _ in parts], pa.int64()),
                    "points": pa.array([ascending(points[a:b]) for a, b in parts], pa.binary()),
                    "flips": pa.array([planes(flips[a:b]) for a, b in parts], pa.binary()),
                })

    return task


def _met(table: pa.Table) -> pa.Table:
    """The links of a range of variants.

    Fingerprints with the same variant are within one or two bits of it. The smallest of those within
    one, if there is any, is within three of all others, and any two that had to meet here have one of
    them within one: links to that one fingerprint join them all. So a variant with n fingerprints
    makes n - 1 links, each verified by its differing bits.
    """
    points = np.concatenate([unascending(x.as_py(), np.uint64) for x in table.column("points")])
    flips = np.concatenate([unplanes(x.as_py(), np.uint16) for x in table.column("flips")])
    order = np.argsort(points)
    points, flips = points[order], flips[order]
    same = points[1:] == points[:-1]
    several = np.append(same, False) | np.append(False, same)
    points, flips = points[several], flips[several]
    prints, far = (points * np.uint64(_GATHER)) ^ FLIPS[flips], flips >= NEAR
    order = np.lexsort((prints, far, points))
    points, prints, far = points[order], prints[order], far[order]
    new = np.ones(len(points), bool)
    new[1:] = points[1:] != points[:-1]
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    u, v = prints, prints[first]
    found = ~far[first] & (u != v) & (np.bitwise_count(u ^ v) <= RADIUS)
    pairs = np.unique(np.stack([u[found], v[found]], 1), axis=0).view(np.int64)
    return pa.table({"u": pa.array(pairs[:, 0]), "v": pa.array(pairs[:, 1])})


def links(prints: DataFrame, n: int) -> DataFrame:
    """(u, v): pairs of the ``n`` ``prints`` (distinct longs, column fingerprint) at most three bits apart.

    They connect what all such pairs connect. Variants meet by ranges, in as many groups as keep each
    at some SHARD variants; no fingerprint or variant is frequent, so the groups are even.
    """
    shard_bits = max(0, ((n + 1) * (len(FLIPS) + BITS) // 2 // SHARD).bit_length())
    # A fingerprint is a few bytes and makes hundreds of variants: as many tasks as these need, not those.
    dealt = prints.repartition(max(1, -(-n // TASK)))
    sent = dealt.mapInArrow(_sent(shard_bits), "shard long, points binary, flips binary")
    met = sent.groupBy("shard").applyInArrow(_met, "u long, v long")
    return met.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _named(rows: DataFrame, classes: DataFrame, columns: list[Column | str]) -> DataFrame:
    """``rows`` joined with the class of their fingerprint.

    Fingerprints with more than a HEAVY-th of all rows, of which there are fewer than HEAVY, are
    joined by broadcast, so the rows of none of them meet in one task.
    """
    total = classes.agg(F.sum("n").alias("total"))
    ranked = classes.crossJoin(F.broadcast(total)).withColumn("heavy", F.col("n") * HEAVY > F.col("total"))
    heavy = F.broadcast(ranked.filter("heavy").select("fingerprint", "component_id"))
    light = ranked.filter("not heavy").select("fingerprint", "component_id")
    kept = heavy.select("fingerprint")
    return rows.join(heavy, "fingerprint").select(*columns).unionByName(
        rows.join(F.broadcast(kept), "fingerprint", "left_anti").join(light, "fingerprint").select(*columns)
    )


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint long, component_id): a row per row of ``docs``.

    Documents whose fingerprints differ in at most three of the 64 bits are linked; ``component_id`` is
    the smallest id reachable. Copies have one fingerprint and are compared once.

    A null text is an empty one; texts without words have the fingerprint 0 and are linked like any
    other. A null id stays null and is never the smallest; where a component has no other, its
    component_id is null. Rows with one id are told apart by their texts. An empty table gives no
    rows; other columns are ignored.
    """
    rows = settle_table(fingerprints(docs, doc_id, text), "fingerprints")
    classes = settle_table(rows.groupBy("fingerprint").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")), "classes")
    reached = components(links(classes.select("fingerprint"), classes.count()))
    rooted = settle_table(
        classes.join(reached.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
        .withColumn("root", F.coalesce("component", "fingerprint")), "rooted",
    )
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root")
    return _named(rows, named.select("fingerprint", "n", "component_id"), ["doc_id", "fingerprint", "component_id"])
