"""SimHash fingerprints and components against plain Python and all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from tagloom.llm import queries, simhash
from tests.conftest import SF_DIR

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_fingerprint(text):
    words = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """[(doc_id, fingerprint)] -> a component_id each, over all pairs."""
    prints = sorted({f for _, f in rows})
    root = {f: f for f in prints}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, f in enumerate(prints):
        for g in prints[i + 1 :]:
            if (f ^ g).bit_count() <= 3:
                root[find(f)] = find(g)
    least = {}
    for d, f in rows:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return [least.get(find(f)) for _, f in rows]


def test_whole_table(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    prints = [(r.doc_id, plain_fingerprint(r.text)) for r in rows]
    want = {d: (f"{f:016x}", c) for (d, f), c in zip(prints, plain_components(prints))}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.QUERIES["op12_simhash"](spark, SF_DIR).collect()}
    assert got == want


@pytest.mark.parametrize("shard", [1 << 20, 1 << 8])
def test_every_distance_is_found(spark, monkeypatch, shard):
    """Chains and balls of fingerprints 1 to 5 bits apart, of either parity, over many ranges."""
    monkeypatch.setattr(simhash, "SHARD", shard)
    monkeypatch.setattr(simhash, "PRINTS", 16)
    rng, prints = random.Random(shard), set()
    for _ in range(60):
        at = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 6)):
            prints.add(at)
            for bit in rng.sample(range(64), rng.randrange(1, 6)):
                at ^= 1 << bit
    ball = rng.getrandbits(64)
    prints |= {ball ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for _ in range(80)} | {0, 7, (1 << 64) - 1}
    prints = sorted(prints)
    signed = [(int(np.uint64(f).astype(np.int64)),) for f in prints]
    frame = spark.createDataFrame(signed, "fingerprint long").repartition(5)
    found = [(r.u % (1 << 64), r.v % (1 << 64)) for r in simhash.links(frame, len(prints)).collect()]
    assert all(0 < (u ^ v).bit_count() <= 3 for u, v in found)
    root = {f: f for f in prints}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for u, v in found:
        root[find(u)] = find(v)
    want = plain_components([(f, f) for f in prints])
    classes = lambda of: {frozenset(f for f, c in zip(prints, of) if c == x) for x in of}
    assert classes([find(f) for f in prints]) == classes(want)


def test_odd_rows(spark):
    long = "Ein Wort " * 40_000
    docs = [
        (5, None), (3, ""), (4, " \n"), (None, long), (8, long), (8, long), (9, "a"), (9, "A b"), (7, "Ä ä x"),
        (None, "alone in the world of nulls"), (6, long.upper()),
    ]
    frame = spark.createDataFrame([(*d, 0, 0, "x") for d in docs], "doc_id long, text string, n int, root int, fingerprint string")
    got = sorted((tuple(r) for r in simhash.simhash_components(frame).collect()), key=repr)
    prints = [plain_fingerprint(t) for _, t in docs]
    want = [(d, int(np.uint64(f).astype(np.int64)), c) for (d, _), f, c in zip(docs, prints, plain_components([(d, f) for (d, _), f in zip(docs, prints)]))]
    assert got == sorted(want, key=repr)
    assert simhash.simhash_components(frame.limit(0)).collect() == []


def test_frequent_fingerprints_are_spread(spark):
    docs = [(i, "one text that very many rows have in common") for i in range(900)] + [(i, f"number {i} stands alone here") for i in range(900, 2100)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in simhash.simhash_components(frame).collect()}
    assert len(found) == 2100 and {found[i] for i in range(900)} == {0}
