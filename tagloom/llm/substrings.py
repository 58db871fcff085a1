"""Substring deduplication: words of passages that a document with a smaller id has too are removed."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tagloom.llm.blocks import (
    FAR_FIRST, Sketch, Words, ascending, blocks_of, by_row, estimated_words, extended, from_blob, planes,
    repeated_counters, repeated_elsewhere, sketches, unascending, unique_keys, unplanes, whole_mask, with_answers,
)
from tagloom.llm.common import settle_table

RANGE_WINDOWS = 1 << 20  # windows that meet in one range of keys, at most, on average


class Block:
    """A block's windows, its distinct ones, and the smallest document of the block that has each."""

    def __init__(self, blob: bytes, doc_id: str, text: str, n: int):
        self.table = from_blob(blob)
        self.texts = self.table.column(text).to_pylist()
        self.words = Words(self.table.column(text), n)
        ids = self.table.column(doc_id).to_pylist()
        self.ids = np.array([FAR_FIRST if x is None else x for x in ids], np.int64)
        order, group = unique_keys(*self.words.keys)
        self.distinct = int(group[-1]) + 1 if len(group) else 0
        self.of = np.empty(len(order), np.int64)
        self.of[order] = group
        self.first = np.full(self.distinct, np.iinfo(np.int64).max)
        np.minimum.at(self.first, self.of, self.ids[self.words.doc])
        self.sample = np.empty(self.distinct, np.int64)
        self.sample[group] = order  # a window of each distinct key

    def asked(self, told, sketch: Sketch, range_bits: int):
        """Positions (among the distinct) of windows that may be in another block, and the ranges they fall into."""
        may = repeated_elsewhere(self.words, told, sketch)
        asked = np.flatnonzero(may[self.sample]) if self.distinct else np.zeros(0, np.int64)
        k1 = self.words.keys[0][self.sample[asked]]
        place = (k1 >> np.uint64(64 - range_bits)).astype(np.int64) if range_bits else np.zeros(len(k1), np.int64)
        at = np.flatnonzero(np.diff(place, prepend=-1))
        return asked, [(int(place[a]), slice(a, b)) for a, b in zip(at, [*at[1:], len(place)])]


def _ask(rows: DataFrame, doc_id: str, text: str, n: int, sketch: Sketch, range_bits: int) -> DataFrame:
    def work(r: dict) -> pa.RecordBatch:
        own = Block(r["payload"], doc_id, text, n)
        asked, ranges = own.asked(r["told0"], sketch, range_bits)
        k1, k2 = (k[own.sample[asked]] for k in own.words.keys)
        first = own.first[asked]
        return pa.RecordBatch.from_pydict({
            "block": pa.array([r["block"]] * len(ranges), pa.int64()),
            "shard": pa.array([s for s, _ in ranges], pa.int64()),
            "k1": pa.array([ascending(k1[s]) for _, s in ranges], pa.binary()),
            "k2": pa.array([planes((k2[s] >> np.uint64(32)).astype(np.uint32)) for _, s in ranges], pa.binary()),
            "first": pa.array([planes(first[s]) for _, s in ranges], pa.binary()),
        })

    return rows.mapInArrow(by_row(work), "block long, shard long, k1 binary, k2 binary, first binary")


def _answer(table: pa.Table) -> pa.Table:
    """Exact: for each key of each block in this range, whether another block has it in a smaller document."""
    k1 = [unascending(x, np.uint64) for x in table.column("k1").to_pylist()]
    sizes = [len(x) for x in k1]
    k1 = np.concatenate(k1)
    k2 = np.concatenate([unplanes(x, np.uint32) for x in table.column("k2").to_pylist()])
    first = np.concatenate([unplanes(x, np.int64) for x in table.column("first").to_pylist()])
    order, group = unique_keys(k1, k2)
    smallest = np.full(int(group[-1]) + 1 if len(group) else 0, np.iinfo(np.int64).max)
    np.minimum.at(smallest, group, first[order])
    gone = np.empty(len(order), bool)
    gone[order] = smallest[group] < first[order]
    ends = np.cumsum(sizes)
    return pa.table({
        "block": table.column("block"), "kind": pa.array(np.zeros(len(sizes), np.int32)), "shard": table.column("shard"),
        "mask": pa.array([np.packbits(gone[e - n : e]).tobytes() for e, n in zip(ends, sizes)], pa.binary()),
    })


def _remove(text: str, gone: np.ndarray) -> str:
    """``text`` without these words and the white space after each."""
    parts = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", text)
    return "".join(p for p, out in zip(parts, gone) if not out)


def dedup_substrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 13) -> DataFrame:
    """``docs`` with _n_words, _n_removed, _kept (kept words joined by a space) and _text (kept words with
    the white space after them; the text itself if no word goes).

    A word goes if it is covered by a window of ``n`` words that also starts in a document with a
    smaller id; windows are judged on the input. First pass: blocks of documents count their
    distinct windows into a count-min sketch whose partial sketches are merged range by range; it
    overestimates, so a window it has once is in one block only. Second pass: the others, and only
    they, are grouped by 96 bits of hash, exactly, with the smallest document of each block. Within
    a block windows are compared directly, so a window reaches the exchange once per block, however
    many documents of the block have it.

    Null and empty texts have no words; fewer than ``n`` words have no window; a null id counts as
    smaller than any other; documents with equal ids do not remove each other's words; an empty
    table gives none. All columns come back; names beginning with _ are this function's.
    """
    size = estimated_words(docs, text)
    sketch = Sketch(size)
    range_bits = max(0, int(np.ceil(np.log2(size / RANGE_WINDOWS))))
    blocks = settle_table(blocks_of(docs, text), "blocks")
    repeated = settle_table(repeated_counters(sketches(blocks, text, lambda t: Words(t, n), sketch), sketch), "repeated")
    asked = _ask(with_answers(blocks, repeated), doc_id, text, n, sketch, range_bits)
    answered = asked.groupBy("shard").applyInArrow(_answer, "block long, kind int, shard long, mask binary")

    def work(r: dict) -> pa.Table:
        own = Block(r["payload"], doc_id, text, n)
        ask, ranges = own.asked(r["told0"], sketch, range_bits)
        earlier = np.zeros(own.distinct, bool)
        earlier[ask] = whole_mask(r["told1"], 0, [(s, x.stop - x.start) for s, x in ranges])
        words, sizes = own.words, own.words.sizes
        found = earlier[own.of] | (own.first[own.of] < own.ids[words.doc])
        starts = np.cumsum(sizes) - sizes
        hits = starts[words.doc[found]] + words.at[found]
        # +1 where a removed window starts, -1 after its end: above zero is covered.
        steps = np.zeros(int(sizes.sum()) + 1, np.int64)
        np.add.at(steps, hits, 1)
        np.add.at(steps, hits + n, -1)
        gone = np.cumsum(steps[:-1]) > 0
        removed = np.add.reduceat(np.append(gone, False), starts) * (sizes > 0) if len(sizes) else sizes
        kept, left = [], []
        for t, a, k, out in zip(own.texts, starts, sizes, removed):
            mine = gone[a : a + k]
            split = (t or "").encode().split()
            kept.append(b" ".join([w for w, x in zip(split, mine) if not x] if out else split).decode())
            left.append(_remove(t, mine) if out else t)
        extra = {"_n_words": pa.array(sizes, pa.int64()), "_n_removed": pa.array(removed, pa.int64()),
                 "_kept": pa.array(kept, pa.string()), "_text": pa.array(left, pa.string())}
        table = own.table
        for name, column in extra.items():
            table = table.append_column(name, column)
        return table

    rows = with_answers(blocks, repeated, answered)
    return rows.mapInArrow(by_row(work), extended(docs.schema, "_n_words long, _n_removed long, _kept string, _text string"))
