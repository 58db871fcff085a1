"""Blocks of documents, and questions that blocks ask about their hashes of all other blocks.

A block is a bounded number of whole documents in one row. Blocks send what they have, cut by
ranges of hashes ("shards"), to where all blocks' hashes of a range meet; each gets an answer of
one bit per hash back. Nothing but these bits, and compressed hashes, moves between them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_BYTES = 1 << 20  # of text in a block; a longer document is a block of its own
SHARD_BITS = 24  # counters of a shard of the sketch, as a power of two
ROWS = 2  # of the sketch
FAR_FIRST = -(1 << 63)  # stands for a null id

_MULTIPLIERS = [np.array([xxhash.xxh64_intdigest(f"{row} {j}") | 1 for j in range(64)], np.uint64) for row in range(ROWS)]


def planes(values: np.ndarray) -> bytes:
    """Whole numbers as bytes by place, compressed: the high places of small numbers take next to nothing."""
    raw = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()
    return len(values).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unplanes(data: bytes, kind) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    raw = pa.decompress(data[8:], n * width, "zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).view(kind).ravel()


def ascending(values: np.ndarray) -> bytes:
    return planes(np.diff(values, prepend=values.dtype.type(0)))


def unascending(data: bytes, kind) -> np.ndarray:
    return np.cumsum(unplanes(data, kind), dtype=kind)


def _strings(column: pa.LargeStringArray) -> list[bytes]:
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1].tolist() if ends else []
    raw = data.to_pybytes() if data else b""
    return [raw[a:b] for a, b in zip(at, at[1:])]


class Words:
    """Windows of ``n`` words of a block's documents, hashed to two times 64 bits.

    ``doc`` and ``at`` say in which document, and at which of its words, each window starts.
    """

    def __init__(self, texts: pa.ChunkedArray | pa.Array, n: int, lower: bool = False, short: bool = False):
        column = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        column = pc.fill_null(column.cast(pa.large_string()), "")
        split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(column) if lower else column))
        blank = pc.equal(pc.binary_length(split.flatten()), 0)  # what an empty text is split into
        self.sizes = pc.list_value_length(split).to_numpy().astype(np.int64)
        if pc.any(blank).as_py():
            whose = np.repeat(np.arange(len(self.sizes)), self.sizes)
            self.sizes = np.bincount(whose[~blank.to_numpy(zero_copy_only=False)], minlength=len(self.sizes))
        flat = split.flatten().filter(pc.invert(blank)).dictionary_encode()
        ids, total = flat.indices.to_numpy(), len(flat)
        digests = b"".join(map(xxhash.xxh3_128_digest, _strings(flat.dictionary)))
        hashes = np.frombuffer(digests, np.uint64).reshape(-1, ROWS)
        ends = np.cumsum(self.sizes)
        starts = ends - self.sizes
        # With ``short``, documents of fewer than n words have one window of what they have.
        kept = np.maximum(self.sizes - n + 1, (self.sizes > 0) & short)
        self.doc = np.repeat(np.arange(len(self.sizes)), kept)
        self.at = np.arange(int(kept.sum())) - np.repeat(np.cumsum(kept) - kept, kept)
        begin = starts[self.doc] + self.at
        cut_off = np.flatnonzero(begin + n > ends[self.doc]) if short else begin[:0]
        self.keys = []
        for row in range(ROWS):
            of = np.append(hashes[ids, row], np.zeros(n, np.uint64))
            sums = np.zeros(total, np.uint64)
            for j in range(n):
                sums += of[j : j + total] * _MULTIPLIERS[row][j]
            key = sums[begin]
            if len(cut_off):
                key[cut_off] = 0
                for j in range(n):
                    inside = begin[cut_off] + j < ends[self.doc[cut_off]]
                    key[cut_off] += np.where(inside, of[begin[cut_off] + j], np.uint64(j + 1)) * _MULTIPLIERS[row][j]
            # Spread the last word's influence to the high bits, which choose shard and counter.
            key ^= key >> np.uint64(29)
            self.keys.append(key * np.uint64(0xBF58476D1CE4E5B9))


def unique_keys(k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): positions sorted by key, and the number of its key among the distinct ones for each."""
    order = np.argsort(k1)
    a, b = k1[order], k2[order]
    same = a[1:] == a[:-1]
    if (same & (b[1:] != b[:-1])).any():
        order = np.lexsort((k2, k1))
        a, b = k1[order], k2[order]
        same = a[1:] == a[:-1]
    new = np.ones(len(a), bool)
    new[1:] = ~(same & (b[1:] == b[:-1]))
    return order, np.cumsum(new) - 1


class Sketch:
    """How wide the count-min sketch is: about eight counters for each window of the corpus.

    It is never held in one place: a shard is a range of counters, and there are as many shards as
    the corpus needs.
    """

    def __init__(self, windows: int):
        self.bits = min(max(int(np.ceil(np.log2(max(windows, 1) * 4))), 12), 60)
        self.shard_bits = min(self.bits, SHARD_BITS)

    def counters(self, words: Words, row: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct counters of a block's windows in a row of the sketch, ascending, and which is each window's."""
        own = words.keys[row] >> np.uint64(64 - self.bits)
        order = np.argsort(own)
        sorted_ = own[order]
        new = np.ones(len(own), bool)
        new[1:] = sorted_[1:] != sorted_[:-1]
        which = np.empty(len(own), np.int64)
        which[order] = np.cumsum(new) - 1
        return sorted_[new], which

    def cut(self, counters: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        shard = (counters >> np.uint64(self.shard_bits)).astype(np.int64)
        at = np.flatnonzero(np.diff(shard, prepend=-1))
        for a, b in zip(at, [*at[1:], len(shard)]):
            yield int(shard[a]), (counters[a:b] & np.uint64((1 << self.shard_bits) - 1)).astype(np.uint32)


def to_blob(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def from_blob(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def by_row(work: Callable[[dict], pa.RecordBatch | pa.Table]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that works on one row (a block and its answers) at a time.

    What a block took is given back before the next one, also by the allocator.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                out = work(batch.slice(row, 1).to_pylist()[0])
                yield from out.combine_chunks().to_batches() if isinstance(out, pa.Table) else [out]
                del out
                pa.default_memory_pool().release_unused()

    return task


def blocks_of(docs: DataFrame, text: str) -> DataFrame:
    """(block, payload): all columns of the documents of a block, compressed; a row per block."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def block() -> pa.RecordBatch:
            blob = to_blob(pa.Table.from_batches(held).combine_chunks())
            return pa.RecordBatch.from_pydict({"block": pa.array([(part << 24) + number], pa.int64()), "payload": pa.array([blob], pa.binary())})

        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
            start = 0
            for i, n in enumerate(sizes):
                size += int(n)
                if size >= BLOCK_BYTES:
                    held.append(batch.slice(start, i + 1 - start))
                    yield block()
                    number, held, size, start = number + 1, [], 0, i + 1
            if start < len(sizes):
                held.append(batch.slice(start))
        if held:
            yield block()

    return docs.mapInArrow(task, "block long, payload binary")


def sketches(blocks: DataFrame, text: str, words_of: Callable[[pa.ChunkedArray], Words], sketch: Sketch) -> DataFrame:
    """(block, kind, shard, counters): the distinct counters of a block in row ``kind`` of the sketch that lie in a shard."""

    def work(r: dict) -> pa.RecordBatch:
        words = words_of(from_blob(r["payload"]).column(text))
        out = [
            (row, shard, ascending(own))
            for row in range(ROWS)
            for shard, own in sketch.cut(sketch.counters(words, row)[0])
        ]
        return pa.RecordBatch.from_pydict({
            "block": pa.array([r["block"]] * len(out), pa.int64()), "kind": pa.array([k for k, _, _ in out], pa.int32()),
            "shard": pa.array([s for _, s, _ in out], pa.int64()), "counters": pa.array([c for _, _, c in out], pa.binary()),
        })

    return blocks.mapInArrow(by_row(work), "block long, kind int, shard long, counters binary")


def repeated_counters(sent: DataFrame, sketch: Sketch) -> DataFrame:
    """(block, kind, shard, mask): for each counter a block has in a shard, whether the merged sketch has it twice."""

    def merge(table: pa.Table) -> pa.Table:
        counts = np.zeros(1 << sketch.shard_bits, np.uint8)
        sent = [unascending(p, np.uint32) for p in table.column("counters").to_pylist()]
        for own in sent:
            counts[own] = np.minimum(counts[own], 1) + 1
        masks = [np.packbits(counts[own] >= 2).tobytes() for own in sent]
        return pa.table({
            "block": table.column("block"), "kind": table.column("kind"), "shard": table.column("shard"),
            "mask": pa.array(masks, pa.binary()),
        })

    # A shard's group holds its counters from all blocks, of which there are a bounded number on average.
    return sent.groupBy("kind", "shard").applyInArrow(merge, "block long, kind int, shard long, mask binary")


def with_answers(blocks: DataFrame, *answers: DataFrame) -> DataFrame:
    """(block, payload, answers...): each block with what it was told, as lists of (kind, shard, mask)."""
    out = blocks
    for i, answer in enumerate(answers):
        told = answer.groupBy("block").agg(F.collect_list(F.struct("kind", "shard", "mask")).alias(f"told{i}"))
        out = out.join(told, "block", "left")
    return out


def whole_mask(told: list[dict] | None, kind: int, cut: list[tuple[int, int]]) -> np.ndarray:
    """The bits of a block's hashes in their order; ``cut`` has the (shard, how many) it asked with."""
    masks = {t["shard"]: t["mask"] for t in told or () if t["kind"] == kind}
    bits = [np.unpackbits(np.frombuffer(masks[s], np.uint8), count=n) if s in masks else np.zeros(n, np.uint8) for s, n in cut]
    return np.concatenate(bits).astype(bool) if bits else np.zeros(0, bool)


def repeated_elsewhere(words: Words, told: list[dict] | None, sketch: Sketch) -> np.ndarray:
    """For each window of a block, whether the sketch estimates it in two blocks or more (never too few)."""
    out = np.ones(len(words.doc), bool)
    for row in range(ROWS):
        counters, which = sketch.counters(words, row)
        mask = whole_mask(told, row, [(s, len(own)) for s, own in sketch.cut(counters)])
        if len(out):
            out &= mask[which]
    return out


def estimated_words(docs: DataFrame, text: str) -> int:
    """An upper estimate of the number of words, from the number of bytes; it only sizes the sketch."""
    return int((docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0) // 5) + 1


def extended(schema: T.StructType, extra: str) -> T.StructType:
    return T.StructType([*schema.fields, *T._parse_datatype_string(extra).fields])
