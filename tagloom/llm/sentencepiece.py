"""Segmenting texts into the pieces of a vocabulary by their scores, and putting them together again."""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tagloom.llm.common import map_columns, texts

SPACE_MARK = "▁"
CHUNK = re.compile(r"▁*[^▁\n]+|▁+|\n")
CACHED_CHUNKS = 500_000  # chunks whose pieces a worker remembers


class Pieces:
    """An automaton over the pieces of a model file, and the best segmentation by their scores."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(len(self.pieces)) if model.is_byte(i)}
        self.of_byte = {i: b for b, i in self.bytes.items()}
        self.unknown, self.silent = model.unk_id(), {i for i in range(len(self.pieces)) if model.is_control(i)}
        self.automaton, low = ahocorasick.Automaton(), 0.0
        self.splits = True  # no piece has a line end, or goes on past a character that a space mark follows
        for i, piece in enumerate(self.pieces):
            if i != self.unknown and i not in self.silent and i not in self.of_byte:
                score = model.get_score(i)
                low = min(low, score)
                self.automaton.add_word(piece, (i, len(piece), score))
                self.splits &= SPACE_MARK not in piece.lstrip(SPACE_MARK) and "\n" not in piece
        self.automaton.make_automaton()
        self.unknown_score = low - 10.0
        self.known: dict[str, bytes] = {}

    def segment(self, chunk: str) -> list[int]:
        """Ids of the best segmentation, in one pass: the automaton gives, for each end, every piece
        that ends there (it follows its output links, longest first) and each relaxes the score of that end.
        A character that no piece covers is written as its bytes. Among equal scores the longest last
        piece wins."""
        n = len(chunk)
        score, back = [-math.inf] * (n + 1), [(0, -1)] * (n + 1)
        score[0], done = 0.0, 0

        def single(end: int) -> None:  # one character outside the vocabulary
            reached = score[end - 1] + self.unknown_score
            if reached > score[end] and chunk[end - 1] not in self.automaton:
                score[end], back[end] = reached, (end - 1, -1)

        for last, (i, size, value) in self.automaton.iter(chunk):
            end = last + 1
            while done < end - 1:
                done += 1
                single(done)
            reached = score[end - size] + value
            if reached > score[end]:
                score[end], back[end] = reached, (end - size, i)
        while done < n:
            done += 1
            single(done)
        ids, end = [], n
        while end:
            start, i = back[end]
            if i >= 0:
                ids.append(i)
            else:
                ids += [self.bytes.get(b, self.unknown) for b in reversed(chunk[start:end].encode())]
            end = start
        return ids[::-1]

    def chunks(self, text: str) -> list[str]:
        """Parts between which no piece can reach, in the model's writing of spaces."""
        if not text:
            return []
        written = SPACE_MARK + text.replace(" ", SPACE_MARK)
        return CHUNK.findall(written) if self.splits else [written]


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    return Pieces(path)


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids): the best segmentation of every whole text under the model's scores.

    Texts are written as the model writes them: a space mark first and for every space. Chunks whose
    segmentation a task has seen are not worked out again; the memory for them is bounded. An empty
    or null text has no ids; repeated rows give repeated rows. A space mark inside a text is read
    back as a space.
    """

    def make():
        pieces = load(model_path)  # a worker's next tasks find it, and what it knows, again
        known = pieces.known

        def ids(text: str) -> bytes:
            chunks = pieces.chunks(text)
            try:
                return b"".join(map(known.__getitem__, chunks))
            except KeyError:
                pass
            out = []
            for chunk in chunks:
                got = known.get(chunk)
                if got is None:
                    got = np.array(pieces.segment(chunk), np.int32).tobytes()
                    if len(known) >= CACHED_CHUNKS:
                        known.clear()
                    if len(chunk) <= 64:
                        known[chunk] = got
                out.append(got)
            return b"".join(out)

        def apply(rows):
            found = [np.frombuffer(ids(t), np.int32) for t in rows["text"]]
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            values = pa.array(np.concatenate(found) if found else np.zeros(0, np.int32))
            return {"doc_id": pa.array(rows["doc_id"], pa.int64()), "ids": pa.ListArray.from_arrays(pa.array(ends), values)}

        return apply

    return map_columns(texts(docs), make, "doc_id long, ids array<int>", rows=256)


def _joiner(model_path: str):
    pieces = load(model_path)
    whole = [p.encode() for p in pieces.pieces]
    for i in pieces.silent:
        whole[i] = b""
    for i, b in pieces.of_byte.items():
        whole[i] = bytes([b])
    table = pa.array(whole, pa.large_binary())

    def texts_of(ids: pa.ListArray) -> list[str]:
        joined = table.take(ids.flatten())  # the bytes of all lists, one after another
        sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        at = np.concatenate([[0], np.cumsum(pc.binary_length(joined).to_numpy(zero_copy_only=False), dtype=np.int64)])[ends]
        raw = memoryview(joined.buffers()[2] or b"")
        return [str(raw[a:b], "utf-8", "replace").replace(SPACE_MARK, " ")[1:] for a, b in zip(at.tolist(), at[1:].tolist())]

    return texts_of


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids, text): the inverse of :func:`encode` for texts without space marks of their own.

    Bytes of byte pieces are put together before they are read as UTF-8; control pieces say nothing;
    null ids give an empty text.
    """

    def make():
        texts_of, kind = _joiner(model_path), pa.list_(pa.int32())

        def apply(rows: pa.RecordBatch):
            ids = rows["ids"].cast(kind)
            return {"doc_id": rows["doc_id"].cast(pa.int64()), "ids": ids, "text": pa.array(texts_of(ids), pa.string())}

        return apply

    return map_columns(
        encoded.select("doc_id", "ids"), make, "doc_id long, ids array<int>, text string", rows=256, arrow=True
    )
