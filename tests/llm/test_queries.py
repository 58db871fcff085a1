"""Each query's result over the whole table against the plain version in brute.py."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest

from tagloom.llm import queries
from tagloom.llm.pii import KINDS as PII_KINDS
from tagloom.llm.secrets import KINDS as SECRET_KINDS
from tests.conftest import SF_DIR
from tests.llm import brute


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    return {r["doc_id"]: r["text"] or "" for r in rows}


def rows_of(spark, name):
    found = queries.QUERIES[name](spark, SF_DIR).collect()
    return {r["doc_id"]: r for r in found}


def test_secrets(spark, docs):
    found = rows_of(spark, "op2_secrets")
    assert found.keys() == docs.keys()
    for d, text in docs.items():
        spans = brute.secrets(text)
        assert found[d]["base_sha256"] == brute.sha(brute.span_text(spans, SECRET_KINDS))
        for kind in ("assign", "access", "hex"):
            assert found[d][f"n_{kind}"] == sum(s[0] == kind for s in spans)
        listed = found[d]["spans"].split(",")
        assert {f"{k}:{a}:{b}" for k, a, b in spans} <= set(listed)


def test_pii(spark, docs):
    found = rows_of(spark, "op7_pii")
    assert found.keys() == docs.keys()
    for d, text in docs.items():
        spans = brute.pii(text)
        assert found[d]["base_sha256"] == brute.sha(brute.span_text(spans, PII_KINDS))
        for kind in ("email", "ip", "card", "phone"):
            assert found[d][f"n_{kind}"] == sum(s[0] == kind for s in spans)
        assert {f"{k}:{a}:{b}" for k, a, b in spans} <= set(found[d]["spans"].split(","))


def test_quality(spark, docs):
    found = rows_of(spark, "op4_quality")
    assert found.keys() == docs.keys()
    for d, text in docs.items():
        for k, v in brute.quality(text).items():
            assert found[d][k] == v, (d, k)
        assert not (found[d]["base_failed"] and found[d]["kept"])


def test_chat(spark):
    turns = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "</s>[INST] ok [/INST]"
    want = brute.chat([*turns, (-1, 0, "user", said), (-1, 1, "assistant", said)])
    got = {
        r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"])
        for r in queries.QUERIES["op5_chat"](spark, SF_DIR).collect()
    }
    assert got == want


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    ids = {d: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for d, t in docs.items()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in queries.QUERIES["op3_packing"](spark, SF_DIR).collect():
        part = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert len(part) == r["length"] and r["ids_crc32"] == brute.crc(part.tobytes())
        assert r["doc_tokens"] == len(ids[r["doc_id"]])
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for d, parts in pieces.items():
        assert sum(n for _, n in parts) == len(ids[d])
    assert pieces.keys() == ids.keys()
    for parts in [*pieces.values(), *sequences.values()]:
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
    assert sorted(sequences) == list(range(len(sequences)))
    assert [sum(n for _, n in sequences[s]) for s in sorted(sequences)][:-1] == [4096] * (len(sequences) - 1)


def test_sharding(spark, docs):
    found = rows_of(spark, "op9_sharding")
    assert found.keys() == docs.keys()
    shards, slots, groups, first = defaultdict(int), defaultdict(list), defaultdict(set), {}
    for d, text in sorted(docs.items()):
        r = found[d]
        assert r["size"] == len(text.encode()) + 16 and r["text_crc32"] == brute.crc(text.encode()) and r["law"] == "bytes"
        shards[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        groups[text].add(r["shard"])
        first.setdefault(text, d)
    assert all(len(g) == 1 for g in groups.values()) and all(0 <= s < 40 for s in shards)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    size = defaultdict(int)
    for text in docs.values():
        size[text] += len(text.encode()) + 16
    assert max(shards.values()) == brute.minimax([size[t] for t in sorted(first, key=first.get)], 40)


def test_substrings(spark, docs):
    found = rows_of(spark, "op6_substrings")
    want = brute.substrings(docs.items())
    assert {d: (r["n_words"], r["n_removed"], r["kept_sha256"]) for d, r in found.items()} == want


def test_jaccard(spark, docs):
    found = rows_of(spark, "op10_jaccard")
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in found.items()} == brute.jaccard_components(docs.items())


def test_media(spark, docs):
    found = rows_of(spark, "op8_media")
    assert found.keys() == docs.keys()
    by_text = defaultdict(set)
    for d, text in docs.items():
        raw, r = text.encode(), found[d]
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == brute.crc(payload[-16:])
        stored = b"P5\n192 %d\n255\n" % (len(payload) // 192) + payload
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        by_text[text].add(r["feature"])
    assert all(len(x) == 1 for x in by_text.values())


def test_pieces_decode(spark, docs):
    found = rows_of(spark, "op1_sentencepiece")
    assert {d: r["decoded_sha256"] for d, r in found.items()} == {d: brute.sha(t) for d, t in docs.items()}
    assert all(len(r["ids"]) == r["n_ids"] for r in found.values())
