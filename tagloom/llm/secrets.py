"""Secret scans: fixed formats, and values in a credential's place that would be hard to guess."""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import map_columns, settle_table, texts

KINDS = ["assign", "access", "hex", "guess"]

# The formats searched for.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run is maximal, so shorter ones cannot hide a longer one
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

# Wider places where a credential is told: more names, "is" and arrows, any printable value.
CONTEXT = re.compile(
    r"""(?<![a-z0-9])(?:pass(?:word|wd|phrase|code)?|pwd|pin|secret|token|credentials?|(?:api|access|private|client|auth)[_\x20-]?(?:key|secret|token))"""
    r"""["']?\x20*(?::=|=>|->|[:=]|\x20is\x20)\x20*["'`]?([^\x00-\x20"'`<>,;]+)""",
    re.IGNORECASE | re.ASCII,
)
PLACES = (":", "=", "->", " is ")  # one of them is in every match of ASSIGN and CONTEXT, in lower case
CONTEXT_HINTS = ("pass", "pwd", "pin", "secret", "token", "credential", "key")

KEYBOARD = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("4301578@$!", "aeoistbasi")
DATE = re.compile(r"(?:19|20)\d\d|(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)?\d\d")
_PLACE = {c: (r, k) for r, row in enumerate(KEYBOARD) for k, c in enumerate(row)}

MAX_WORD, MAX_BLOCK, MAX_DATE = 16, 8, 10


def _adjacent(a: str, b: str) -> bool:
    p, q = _PLACE.get(a), _PLACE.get(b)
    return bool(p and q and p != q and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1)


def _char_cost(c: str) -> float:
    return math.log10(10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 33)


def guess_cost(value: str, ranks: dict[str, int]) -> float:
    """log10 of the guesses an attacker needs, by the cheapest way of cutting ``value`` into parts.

    A part is a word (its rank, more for capitals and digits used as letters), a date, a block said
    again, a walk over neighbouring keys or neighbouring character codes, or a span tried out
    character by character. Every part but the first costs a factor of two for where it starts. The
    longest part looked at is bounded, except for runs and repeats, which grow one step at a time, so
    the work grows with the length of ``value``.
    """
    n, low = len(value), value.lower()
    plain = low.translate(LEET)
    best = [0.0] + [math.inf] * n  # best[i]: the first i characters, ending in any part
    brute = [math.inf] * (n + 1)  # ending inside a tried-out span
    runs = {"key": 1, "code": 1}
    step = math.log10(2)

    def relax(end: int, start: int, cost: float) -> None:
        best[end] = min(best[end], best[start] + cost + (step if start else 0.0))

    for i in range(1, n + 1):
        c = _char_cost(value[i - 1])
        brute[i] = min(brute[i - 1], best[i - 1] + (step if i > 1 else 0.0)) + c
        best[i] = min(best[i], brute[i])
        for size in range(3, min(MAX_WORD, i) + 1):
            form = low[i - size : i]
            rank = ranks.get(form)
            swapped = 0.0
            if rank is None:
                rank, swapped = ranks.get(plain[i - size : i]), 1.0
            if rank is not None:
                upper = sum(x.isupper() for x in value[i - size : i])
                capitals = 0.0 if not upper else 1.0 if upper in (1, size) else math.log2(math.comb(size, upper))
                relax(i, i - size, math.log10(rank + 1) + step * (swapped + capitals))
        for size in range(4, min(MAX_DATE, i) + 1):
            if DATE.fullmatch(value, i - size, i):
                relax(i, i - size, math.log10(200 if size == 4 else 365 * 100) + (0.6 if not value[i - size : i].isdigit() else 0))
        for block in range(1, min(MAX_BLOCK, i // 2) + 1):
            if value[i - block : i] == value[i - 2 * block : i - block]:
                # One more copy of the block before: twice the guesses, whatever the block took.
                best[i] = min(best[i], best[i - block] + step)
        if i > 1:
            near, gap = _adjacent(low[i - 2], low[i - 1]), ord(value[i - 1]) - ord(value[i - 2])
            runs["key"] = runs["key"] + 1 if near else 1
            same = i > 2 and gap == ord(value[i - 2]) - ord(value[i - 3])
            runs["code"] = runs["code"] + 1 if abs(gap) == 1 and (same or runs["code"] == 1) else 2 if abs(gap) == 1 else 1
            for kind, start_cost, turn in (("key", math.log10(47), math.log10(1.5)), ("code", math.log10(20), 0.05)):
                if runs[kind] >= 3:
                    relax(i, i - runs[kind], start_cost + turn * runs[kind])
    return best[n]


def scan(text: str, ranks: dict[str, int], least: float) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, end exclusive."""
    found = [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20] if "AKIA" in text else []
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    low = text.lower()
    if any(x in low for x in PLACES):
        if any(x in low for x in NAMES):
            found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
        if any(x in low for x in CONTEXT_HINTS):
            for m in CONTEXT.finditer(text):
                start, end = m.start(1), m.start(1) + len(m[1].rstrip(".:!?)]}"))
                if guess_cost(text[start:end], ranks) >= least:
                    found.append(("guess", start, end))
    return found


STEPS = 8  # of a histogram of counts, for each factor of two


def common_words(docs: DataFrame, top: int) -> dict[str, int]:
    """Ranks, from 1, of the ``top`` most frequent words of a-z over all documents (ties by the word).

    A histogram of the counts, of a few hundred rows at any size, says from which count on the
    top words are; only words with such a count are sorted, so what reaches the driver is not
    ``top`` words of every partition.
    """
    words = texts(docs).select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word"))
    counts = words.filter(F.length("word").between(3, MAX_WORD)).groupBy("word").count()
    place = F.floor(F.log2("count") * STEPS).cast("int")
    counts = settle_table(counts.withColumn("place", place), "words")
    held = {r["place"]: r["n"] for r in counts.groupBy("place").agg(F.count("*").alias("n")).collect()}
    seen, least = 0, 0
    for least in sorted(held, reverse=True):
        seen += held[least]
        if seen >= top:
            break
    ranked = counts.filter(F.col("place") >= least).orderBy(F.desc("count"), "word").limit(top).collect()
    return {r["word"]: i for i, r in enumerate(ranked, 1)}


def find_secrets(docs: DataFrame, top_words: int = 20_000, least_log10_guesses: float = 9.0) -> DataFrame:
    """(doc_id, spans): a row per row of ``docs``; spans are (kind, start, end), in no fixed order.

    Kinds assign, access and hex are the fixed formats; guess is a value in a credential's place
    whose cheapest guess cost reaches ``least_log10_guesses``. Word ranks for the guesses come from
    all of ``docs``; the list has ``top_words`` entries at any size of input. Null and empty texts
    have no spans; repeated rows give repeated rows; null ids stay null; an empty table gives none.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(common_words(docs, top_words))

    def make():
        known = ranks.value

        def apply(rows):
            spans = [
                [{"kind": k, "start": a, "end": b} for k, a, b in scan(t, known, least_log10_guesses)] for t in rows["text"]
            ]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            return {"doc_id": pa.array(rows["doc_id"], pa.int64()), "spans": pa.array(spans, kind)}

        return apply

    return map_columns(texts(docs), make, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def redact(docs: DataFrame, top_words: int = 20_000, least_log10_guesses: float = 9.0, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span (overlapping ones as one) replaced by ``mark``; a null text stays null."""
    ranks = docs.sparkSession.sparkContext.broadcast(common_words(docs, top_words))

    @F.pandas_udf("string")
    def clean(column):
        return column.map(lambda t: t if t is None else _covered(t, scan(t, ranks.value, least_log10_guesses), mark))

    return docs.withColumn("text", clean("text"))


def _covered(text: str, spans: list[tuple[str, int, int]], mark: str) -> str:
    out, at = [], 0
    for _, start, end in sorted(spans, key=lambda s: (s[1], s[2])):
        if end > at:
            out += [text[at:start], mark] if start >= at or not out else []
            at = end
    return "".join(out) + text[at:]
