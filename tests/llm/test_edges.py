"""Nulls, empty and odd texts, repeated rows, clashing columns and empty tables."""

import numpy as np
import pyarrow as pa
import pytest

from tagloom.llm import jaccard, media, packing, pii, quality, secrets, sentencepiece, sharding, substrings
from tagloom.llm.queries import vocabulary
from tests.llm import brute

LONG = "word " * 30_000 + "x" * 50_000
PROSE = " ".join(f"w{i}" for i in range(60))
TEXTS = [
    (1, None), (2, ""), (3, " \n\t "), (4, PROSE), (4, PROSE), (None, PROSE), (5, "é ü \U0001f600 a@b.co 1.2.3.4"),
    (6, LONG), (7, PROSE + " tail"), (8, "password: Tr0ub4dour&3x9!Qz and pin is 1234"), (9, "a"), (10, "9" * 30_000),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None, None, "c", 1) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, key string, part int")


RUNS = {
    "pack": lambda d: packing.pack(d, vocabulary("word_bpe_49k.json")),
    "secrets": secrets.find_secrets, "pii": pii.find_pii, "quality": quality.quality_verdicts,
    "substrings": substrings.dedup_substrings, "jaccard": jaccard.jaccard_components, "media": media.media_columns,
    "shard": sharding.shard, "encode": lambda d: sentencepiece.encode(d, vocabulary("piece_bpe_32k.model")),
    "redact": secrets.redact, "keep_good": quality.keep_good, "keep_one": jaccard.keep_one,
}
FEWER = {"pack", "keep_good", "keep_one"}


@pytest.mark.parametrize("name", sorted(RUNS))
def test_odd_and_empty_tables(odd, name):
    rows = RUNS[name](odd).collect()
    assert name in FEWER or len(rows) == len(TEXTS)
    assert RUNS[name](odd.limit(0)).collect() == []


def test_odd_values(odd):
    alike = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(odd).collect()}
    assert alike[1] == (0, 1) and alike[2] == (0, 2) and alike[9] == (1, 9) and alike[7][1] is None and alike[4][1] is None
    assert {r.doc_id: r._n_removed for r in substrings.dedup_substrings(odd).collect()}[4] == 60
    spans = {r.doc_id: [s for s in r.spans] for r in secrets.find_secrets(odd).collect()}
    assert any(s.kind == "guess" for s in spans[8])
    base = {r.doc_id: sorted((s.kind, s.start, s.end) for s in r.base) for r in pii.find_pii(odd).collect()}
    assert base == {i: sorted(brute.pii(t or "")) for i, t in TEXTS}


def test_guess_costs():
    ranks = {"password": 1, "horse": 50}
    cost = lambda v: secrets.guess_cost(v, ranks)
    assert cost("password") < cost("p4ssword") < cost("pxqzword") and cost("2024-01-31") < cost("7038-91-64")
    assert cost("qwertyui") < cost("qhzruxvi") and cost("abababab") < cost("abqjrkzw") and cost("") == 0


def test_pieces_are_joined_from_slices_of_lists():
    model = vocabulary("piece_bpe_32k.model")
    pieces = sentencepiece.load(model)
    written = ["", "a  b", "ⵣé\n x", "end"]
    ids = [[i for c in pieces.chunks(t) for i in pieces.segment(c)] for t in written] + [None]
    lists = pa.array([[5], *ids], pa.list_(pa.int32())).slice(1)
    assert sentencepiece._joiner(model)(lists) == [*written, ""]


def test_words_share_strings_and_keep_their_ids():
    path = vocabulary("word_bpe_49k.json")
    ids = packing.WordIds(path)
    given, encoder = [], ids.tokenizer

    class Counted:
        def encode_batch_fast(self, texts, **options):
            given.extend(texts)
            return encoder.encode_batch_fast(texts, **options)

    ids.tokenizer = Counted()
    some = [f"word{'abcdefghij'[n % 10]}{n:03d}" for n in range(640)]
    odd = [
        "plain", "letters", "it's", "'ll", "don't!!", "\0", "a\0b", "\0\0", "é", "é", "́x", "Σς", "İ", "İstanbul", "ǅ", "中文", "🙂🙂",
        "x y", " ", "a‍b", "</w>", "Ā", "Ā</w>", "<|endoftext|>", "x<|startoftext|>y", "<|", "4096", "a1b2", "l'été", "ﬁn", "ſ", "x", "\x1c", "a\x85b", "q" * 300,
    ]
    texts = [*some, *odd, " ".join(odd), "\0 ".join(odd), "PLAIN <|endoftext|> Letters", "", " ", "a,b. c, é."]
    found = ids(texts)
    alone = [encoder.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, ids.kind).tolist() for x in found] == alone
    assert len(given) < 200


def test_other_vocabularies_are_encoded_as_they_are(tmp_path):
    import json

    made = json.loads(open(vocabulary("word_bpe_49k.json")).read())
    made["pre_tokenizer"]["pretokenizers"][0]["pattern"] = {"Regex": r"\p{L}{1,3}|\p{N}|[^\s\p{L}\p{N}]+"}
    path = tmp_path / "other.json"
    path.write_text(json.dumps(made))
    ids = packing.WordIds(str(path))
    texts = ["letters in threes", "it's 42 \0 x"]
    assert ids.alone is None
    assert [np.frombuffer(x, ids.kind).tolist() for x in ids(texts)] == [ids.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
