"""Packing: all documents as one stream of token ids, cut into sequences of one length."""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.common import map_columns, settle_table, texts

CACHED_WORDS = 600_000  # words whose ids a worker remembers; others are looked up again
JOINED = 32  # words given to the encoder in one string
POINTS = frozenset(b".,;:!?")
# Steps before the merges that leave a word of small Latin letters as it is, and whole.
LETTERS_KEPT = {"NFC", "Lowercase"}
LETTERS_WHOLE = [
    {
        "type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
        "behavior": "Removed", "invert": True,
    },
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


def _merges_alone(tokenizer):
    """The merges of ``tokenizer`` without the steps before them, and which ids end a word.

    None where these steps are not known to leave a word of small Latin letters as it is.
    """
    from tokenizers import Tokenizer, pre_tokenizers

    made = json.loads(tokenizer.to_str())
    before, cut, model = ((made[k] or {}) for k in ("normalizer", "pre_tokenizer", "model"))
    spaces = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    kept = all(n["type"] in LETTERS_KEPT or n == spaces for n in before.get("normalizers", [before]))
    suffix = model.get("end_of_word_suffix")
    if not (before and kept and suffix and cut.get("pretokenizers") == LETTERS_WHOLE) or model.get("dropout"):
        return None
    if any(t["content"].isalpha() for t in made["added_tokens"]) or made["truncation"] or made["padding"]:
        return None
    ends = np.zeros(tokenizer.get_vocab_size(), bool)
    ends[[i for token, i in model["vocab"].items() if token.endswith(suffix)]] = True
    alone = Tokenizer(tokenizer.model)
    alone.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    return alone, ends


class WordIds:
    """Ids of texts, from the ids of their words.

    The vocabularies meant here drop white space and case before anything else, so a text's ids are
    those of its words one after another, and a word's ids can be kept. A mark after a letter or a
    digit is a token of its own, so a word and the same word before a comma are looked up once.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.alone = _merges_alone(self.tokenizer)
        # NUL between words is a token of its own where it has one id and leaves its neighbours' as they are.
        word, nul, both = (self.tokenizer.encode(t, add_special_tokens=False).ids for t in ("a", "\0", "a \0 a"))
        self.between = nul[0] if len(nul) == 1 and both == [*word, *nul, *word] else None

    def _singly(self, words: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        return [np.array(e.ids, self.kind).tobytes() for e in found]

    def _together(self, words: list[bytes], tokenizer, joint: bytes, last) -> list[bytes]:
        """Ids of every word. Most of a word's cost is that of a string of its own, so some share one.

        ``last`` marks the ids that end a word; a joint's own id ends the word before it and is dropped.
        """
        groups = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        found = tokenizer.encode_batch_fast([joint.join(g).decode() for g in groups], add_special_tokens=False)
        width, dropped, out = int(self.kind[-1]), len(joint.split()), []
        for group, e in zip(groups, found):
            ids = np.array(e.ids, self.kind)
            ends = np.flatnonzero(last(ids)) + 1
            starts = [0, *(ends * width).tolist()]
            stops = ((ends - dropped) * width).tolist()
            raw = ids.tobytes()
            if dropped:
                stops.append(len(raw))
            else:
                starts.pop()
            # Where another text has an id of the joint, a word is not told from the next.
            same = len(stops) == len(group)
            out += [raw[a:b] for a, b in zip(starts, stops)] if same else self._singly(group)
        return out

    def _encode(self, words: list[bytes]) -> list[tuple[bytes, bytes]]:
        """Pairs of words and their ids."""
        letters = [w for w in words if w.isalpha() and w.islower()] if self.alone else []
        rest = [w for w in words if not (w.isalpha() and w.islower())] if self.alone else words
        found = []
        if letters:
            tokenizer, ends = self.alone
            found += zip(letters, self._together(letters, tokenizer, b" ", ends.__getitem__))
        odd = [w for w in rest if self.between is None or b"\0" in w]
        found += zip(odd, self._singly(odd))
        if self.between is not None:
            rest = [w for w in rest if b"\0" not in w]
            found += zip(rest, self._together(rest, self.tokenizer, b" \0 ", lambda ids: ids == self.between))
        return found

    def _look_up(self, words: list[bytes]) -> None:
        pointed = {w: (w[:-1], w[-1:]) for w in words if len(w) > 1 and w[-1] in POINTS and w[-2:-1].isalnum()}
        parts = {x for two in pointed.values() for x in two}
        plain = list(parts.union(w for w in words if w not in pointed).difference(self.known))
        self.known.update(self._encode(plain))
        self.known.update((w, self.known[a] + self.known[b]) for w, (a, b) in pointed.items())

    def __call__(self, texts: list[str]) -> list[bytes]:
        raw = [t.encode() for t in texts]
        # Control strings are told from text before case is dropped.
        words = [(t if b"<|" in t else t.lower()).split() for t in raw]
        new = list(set().union(*words).difference(self.known))
        if len(self.known) + len(new) > CACHED_WORDS:
            self.known.clear()
            new = list(set().union(*words))
        self._look_up(new)
        return [b"".join(map(self.known.__getitem__, w)) for w in words]


@lru_cache(maxsize=1)
def _word_ids(path: str) -> WordIds:
    return WordIds(path)


def tokenise(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """(part, at, doc_id, n, ids, width): ids end in ``end_id``; ``at`` counts the partition's ids before them."""

    def make():
        ids = _word_ids(tokenizer_path)  # a worker's next tasks find it again
        end, width = np.array([end_id], ids.kind).tobytes(), int(ids.kind[-1])
        part, before = TaskContext.get().partitionId(), [0]

        def apply(rows):
            found = [x + end for x in ids(rows["text"])]
            n = np.array([len(x) // width for x in found], np.int64)
            at = before[0] + np.cumsum(n) - n
            before[0] += int(n.sum())
            size = len(found)
            return {
                "part": np.full(size, part, np.int64), "at": at, "doc_id": pa.array(rows["doc_id"], pa.int64()), "n": n,
                "ids": pa.array(found, pa.binary()), "width": np.full(size, width, np.int32),
            }

        return apply

    return map_columns(texts(docs), make, "part long, at long, doc_id long, n long, ids binary, width int", rows=512)


def pack(docs: DataFrame, tokenizer_path: str, length: int = 4096, end_id: int = 2) -> DataFrame:
    """Pieces (doc_id, start, n, doc_tokens, sequence_id, offset, boundary, ids) of sequences of ``length`` ids.

    First pass: every partition of ``docs`` is tokenised once and written, each row with the count
    of ids before it in its partition. Running sums over the partition totals (a row per partition)
    then give every document its place in the whole stream. Second pass: documents are cut where a
    multiple of ``length`` falls, with no shuffle of ids. All sequences but the last are full.

    ``boundary`` marks pieces of a sequence that reaches over an end of its partition: only those
    have to meet pieces of other partitions, the rest of a sequence lies side by side.
    Null and empty texts are the end id alone; repeated rows are packed as often as they occur; an
    empty table gives no piece; null ids stay null; other columns are ignored. ``ids`` are unsigned
    little-endian 32-bit numbers.
    """
    stored = settle_table(tokenise(docs, tokenizer_path, end_id), "tokens")
    totals = stored.groupBy("part").agg(F.sum("n").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("first", F.coalesce(F.sum("total").over(before), F.lit(0)))
    # One row per partition of the first pass: as small as Spark's own list of tasks.
    placed = stored.join(F.broadcast(starts), "part")

    def make():
        def apply(rows):
            out = {k: [] for k in ("doc_id", "start", "n", "doc_tokens", "sequence_id", "offset", "boundary", "ids")}
            for doc_id, at, n, ids, width, first, total in zip(
                *(rows[k] for k in ("doc_id", "at", "n", "ids", "width", "first", "total"))
            ):
                wide, begin = np.frombuffer(ids, f"<u{width}").astype("<u4"), first + at
                start = 0
                while start < n:
                    sequence, offset = divmod(begin + start, length)
                    size = min(n - start, length - offset)
                    for k, v in zip(out, (
                        doc_id, start, size, n, sequence, offset,
                        sequence * length < first or (sequence + 1) * length > first + total,
                        wide[start : start + size].tobytes(),
                    )):
                        out[k].append(v)
                    start += size
            return out | {"doc_id": pa.array(out["doc_id"], pa.int64())}

        return apply

    return map_columns(
        placed, make,
        "doc_id long, start long, n long, doc_tokens long, sequence_id long, offset long, boundary boolean, ids binary",
    )


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids, starts): the pieces of a sequence, at most ``length`` ids, put together."""
    listed = pieces.groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("parts")
    )
    return listed.select(
        "sequence_id", F.aggregate("parts", F.unhex(F.lit("")), lambda a, p: F.concat(a, p["ids"])).alias("ids"),
        F.col("parts.doc_id").alias("doc_ids"), F.col("parts.offset").alias("starts"),
    )


def piece_rows(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.select(
        "doc_id", "start", F.col("n").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
        "offset", "boundary",
    )
