"""Documents whose sets of word n-grams are alike, linked by exact Jaccard similarity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.blocks import (
    FAR_FIRST, Sketch, Words, blocks_of, by_row, estimated_words, from_blob, repeated_counters, repeated_elsewhere,
    sketches, unique_keys, with_answers,
)
from tagloom.llm.common import settle_table
from tagloom.llm.components import components
from tagloom.plans.positions import number_rows

TILE = 1024  # sets of one size band in a tile


def _prefix(own: np.ndarray, shared: np.ndarray, percent: int) -> np.ndarray:
    """The shared n-grams among the first of a set, where those of one set only come first, then by hash.

    Two sets of this similarity have one of their first n - ceil(n * percent / 100) + 1 in common,
    in any order that all sets follow; what only one set has cannot be that one.
    """
    n = len(own)
    length = n - -(-n * percent // 100) + 1
    return own[shared][: max(0, length - int((~shared).sum()))]


def _sets(rows: DataFrame, doc_id: str, text: str, n: int, percent: int, sketch: Sketch) -> DataFrame:
    """(doc_id, size, key, grams, prefix): grams and prefix only where another set can be alike, and once per block."""

    def work(r: dict) -> pa.RecordBatch:
        table = from_blob(r["payload"])
        words = Words(table.column(text), n, lower=True, short=True)
        ids = [FAR_FIRST if x is None else x for x in table.column(doc_id).to_pylist()]
        elsewhere = repeated_elsewhere(words, r["told0"], sketch)
        # Distinct n-grams of each document, by hash.
        k1 = words.keys[0]
        ends = np.cumsum(np.bincount(words.doc, minlength=len(ids)))
        order = np.concatenate([a + np.argsort(k1[a:b]) for a, b in zip([0, *ends], ends)]) if len(ids) else ends
        doc, gram = words.doc[order], k1[order]
        new = np.ones(len(order), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1])
        doc, gram, elsewhere = doc[new], gram[new], elsewhere[order][new]
        sizes = np.bincount(doc, minlength=len(ids))
        ends = np.cumsum(sizes)
        keys = [xxhash.xxh3_128_digest(gram[e - s : e].tobytes()) for e, s in zip(ends, sizes)]
        # An n-gram counts here once for each different set that has it.
        first, fresh = {}, np.zeros(len(ids), bool)
        for i, key in enumerate(keys):
            fresh[i] = sizes[i] > 0 and first.setdefault(key, i) == i
        own = np.flatnonzero(fresh[doc])
        sorted_, group = unique_keys(gram[own], gram[own])
        several = np.zeros(len(gram), bool)
        several[own[sorted_]] = np.bincount(group)[group] > 1 if len(group) else False
        shared = elsewhere | several
        grams, prefixes = [None] * len(ids), [None] * len(ids)
        for i in np.flatnonzero(fresh):
            s = slice(ends[i] - sizes[i], ends[i])
            # A set that shares n - u n-grams at most is alike to none if that is too little.
            if 100 * int(shared[s].sum()) >= percent * int(sizes[i]):
                grams[i] = gram[s].tobytes()
                prefixes[i] = _prefix(gram[s], shared[s], percent).view(np.int64)
        return pa.RecordBatch.from_pydict({
            "doc_id": pa.array(ids, pa.int64()), "size": pa.array(sizes, pa.int64()), "key": pa.array(keys, pa.binary()),
            "grams": pa.array(grams, pa.binary()), "prefix": pa.array(prefixes, pa.list_(pa.int64())),
        })

    return rows.mapInArrow(by_row(work), "doc_id long, size long, key binary, grams binary, prefix array<long>")


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A bitmap for each set, one bit per hashed n-gram, of a width that leaves most bits of a set alone."""
    bits = 1 << int(np.clip(np.ceil(np.log2(16 * max(map(len, sets)))), 10, 14))
    out = np.zeros((len(sets), bits // 64), np.uint64)
    for i, s in enumerate(sets):
        h = (s >> np.uint64(7)) & np.uint64(bits - 1)
        np.bitwise_or.at(out[i], (h >> np.uint64(6)).astype(np.int64), np.uint64(1) << (h & np.uint64(63)))
    return out


def tile_links(ids: list[int], sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between sets of ``left`` and ``right`` (both of a tile's two blocks, or the same block twice).

    Bit counts bound an overlap from above: a bit that only one of two bitmaps has is an n-gram that
    only one of the sets has. Pairs within the bound are intersected exactly, unless they are
    connected already: the links that come back connect what all links would.
    """
    size = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(size, kind="stable")
    signature, rank = _signatures(sets), np.empty(len(sets), np.int64)
    rank[order] = np.arange(len(sets))
    root, found = np.arange(len(sets)), []
    for x in order:
        # Of sets no smaller than this one, those within the size band.
        band = order[rank[x] + 1 : np.searchsorted(size[order], 100 * size[x] // percent, "right")]
        band = band[(left[x] & right[band]) | (right[x] & left[band])]
        band = band[root[band] != root[x]]
        if not len(band):
            continue
        only_x = np.bitwise_count(signature[x] & ~signature[band]).sum(1).astype(np.int64)
        only_y = np.bitwise_count(signature[band] & ~signature[x]).sum(1).astype(np.int64)
        bound = np.minimum(size[x] - only_x, size[band] - only_y)
        both = size[x] + size[band]
        band = band[(100 + percent) * bound >= percent * both]
        while len(band):
            y, band = band[0], band[1:]
            overlap = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if (100 + percent) * overlap >= percent * int(size[x] + size[y]):
                found.append((ids[x], ids[y]))
                root[root == root[y]] = root[x]
                band = band[root[band] != root[x]]
    return found


def _tiles(classes: DataFrame, percent: int) -> DataFrame:
    """(u, v): links between classes, found tile by tile.

    Classes that share a prefix n-gram, directly or over others, are a family; alike sets are in one.
    A family is sorted by size and cut into bands of TILE sets; each pair of bands whose sizes can be
    alike is a tile. So a family of any size is worked on by many tasks, and each set is sent to the
    tiles of its band.
    """
    held = classes.select("cls", F.explode("prefix").alias("gram"))
    least = held.groupBy("gram").agg(F.min("cls").alias("lead"), F.max("cls").alias("last")).filter("lead <> last")
    star = held.join(least, "gram").filter("cls <> lead").select(F.col("cls").alias("u"), F.col("lead").alias("v"))
    family = components(star)
    sized = classes.select("cls", "size").join(family.withColumnRenamed("node", "cls"), "cls")
    banded = number_rows(sized, "at", ["size", "cls"], by=["component"]).withColumn("band", F.floor((F.col("at") - 1) / TILE))
    banded = settle_table(banded.select("cls", "component", "size", "band"), "banded")
    bands = banded.groupBy("component", "band").agg(F.min("size").alias("low"), F.max("size").alias("high"))
    other = bands.select("component", F.col("band").alias("band2"), F.col("low").alias("low2"))
    pairs = bands.join(other, "component").filter((F.col("band2") >= F.col("band")) & (100 * F.col("high") >= percent * F.col("low2")))
    sides = pairs.select(
        "component", F.struct("band", "band2").alias("tile"),
        F.explode(F.array_distinct(F.array("band", "band2"))).alias("band"),
    )
    # Light rows first: where each set has to go; then the sets themselves, in one join.
    going = banded.select("cls", "component", "band").join(sides, ["component", "band"])
    sent = going.join(classes.select("cls", "grams"), "cls").select("component", "tile", "band", "cls", "grams")

    def work(table: pa.Table) -> pa.Table:
        tile = table.column("tile")[0].as_py()
        band = table.column("band").to_numpy()
        sets = [np.frombuffer(g, np.uint64) for g in table.column("grams").to_pylist()]
        links = tile_links(table.column("cls").to_pylist(), sets, band == tile["band"], band == tile["band2"], percent)
        return pa.table({
            "u": pa.array([a for a, _ in links], pa.int64()), "v": pa.array([b for _, b in links], pa.int64())
        })

    return sent.groupBy("component", "tile").applyInArrow(work, "u long, v long")


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id): a row per row of ``docs``.

    Texts are lower-cased (A-Z) and cut into words; a document's set are its distinct ``n``-word
    shingles, or all its words as one where it has fewer. Two documents link when the overlap is at
    least ``percent`` hundredths of the union. ``component_id`` is the smallest id reachable.

    Equal sets are one class from the start, so copies are never compared. A sharded count-min
    sketch (blocks.py) tells which shingles only one class has; a class with too many of those has
    no partner and is done. The rest meet in tiles (see :func:`_tiles`); all their links are found,
    up to those between classes that are connected already. Shingles are told apart by 64 bits of
    hash.

    Null and empty texts have an empty set and are alone; a null id stays null and counts as the
    smallest; rows with one id are told apart by their texts; an empty table gives none. Other
    columns are ignored.
    """
    null = lambda c: F.when(F.col(c) != FAR_FIRST, F.col(c)).alias(c)
    return _components(docs, doc_id, text, n, percent).select(null("doc_id"), "n_shingles", null("component_id"))


def _components(docs: DataFrame, doc_id: str, text: str, n: int, percent: int) -> DataFrame:
    """What :func:`jaccard_components` gives, with FAR_FIRST in place of null ids."""
    slim = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    sketch = Sketch(estimated_words(slim, "text"))
    blocks = settle_table(blocks_of(slim, "text"), "blocks")
    sent = sketches(blocks, "text", lambda t: Words(t, n, lower=True, short=True), sketch)
    answered = with_answers(blocks, repeated_counters(sent, sketch))
    sets = settle_table(_sets(answered, "doc_id", "text", n, percent, sketch), "sets")
    members = settle_table(
        sets.filter("size > 0").groupBy("key").agg(F.min("doc_id").alias("cls")), "classes"
    )
    held = sets.filter(F.col("grams").isNotNull()).groupBy("key").agg(
        F.max(F.struct("size", "grams", "prefix")).alias("s")
    )
    classes = settle_table(held.join(members, "key").select("cls", "s.size", "s.grams", "s.prefix"), "alike")
    linked = components(_tiles(classes, percent))
    named = settle_table(
        members.join(linked.withColumnRenamed("node", "cls"), "cls", "left")
        .select("key", F.coalesce("component", "cls").alias("component")), "named",
    )
    light = sets.select("doc_id", "size", "key")
    alone = light.filter("size = 0").select("doc_id", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    rest = light.filter("size > 0").join(named, "key").select("doc_id", F.col("size").alias("n_shingles"), F.col("component").alias("component_id"))
    return alone.unionByName(rest)


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 3, percent: int = 90) -> DataFrame:
    """``docs`` without those that have a near copy of smaller id (documents of empty text all stay).

    A null id is the smallest: its rows stay, and their copies go. Of an id with several texts all rows
    stay unless each has such a copy; repeated rows stay or go together; an empty table gives none.
    Columns of ``docs`` are kept as they are.
    """
    found = _components(docs, doc_id, text, n, percent)
    gone = found.groupBy(F.col("doc_id").alias("_gone")).agg(F.bool_and(F.col("doc_id") != F.col("component_id")).alias("_all"))
    return docs.join(gone.filter("_all").select("_gone"), docs[doc_id].cast("long") == gone["_gone"], "left_anti")
