"""Only the guess cost decides about a value in a credential's place, whatever it is made of and however it is told."""

import pytest

from tagloom.llm import secrets

WORDS = {w: i for i, w in enumerate(["the", "password", "for", "you", "required", "correct", "horse", "changed", "please", "reset"], 1)}
VALUES = [
    ("pwd: ", "xkqjzvwpmtrhgbn", ""), ("pin: ", "8402957716358824", ""), ("passphrase=", "qhzvkxwjpfmt", " ok"),
    ("credentials: ", "XKQJZVWPMTRHGBN", ""), ("the db password -> ", "Tr0ub4dour&3x9!Qz", ""),
    ("THE PASSWORD IS ", "Tr0ub4dour&3x9!Qz", " TODAY"), ("Password Is ", "xkqjzvwpmtrhgbn", "."),
]
CHEAP = ["pwd: password", "the password is required", "pin: 1234", "passphrase: correcthorse", "pin: 000000000000", "pwd -> qwertyuiop"]


@pytest.mark.parametrize("before, value, after", VALUES)
def test_costly_values_are_found_and_covered(before, value, after):
    text = before + value + after
    spans = secrets.scan(text, WORDS, 9.0)
    assert ("guess", len(before), len(before) + len(value)) in spans
    assert value not in secrets._covered(text, spans, "[SECRET]")


@pytest.mark.parametrize("text", CHEAP)
def test_cheap_values_are_not_guesses(text):
    assert "guess" not in [k for k, _, _ in secrets.scan(text, WORDS, 9.0)]


def test_values_in_a_table(spark):
    rows = [(i, a + b + c) for i, (a, b, c) in enumerate(VALUES)]
    docs = spark.createDataFrame(rows * 3, "doc_id long, text string")
    assert all(any(s.kind == "guess" for s in r.spans) for r in secrets.find_secrets(docs, top_words=1).collect())
    assert all(VALUES[r.doc_id][1] not in r.text for r in secrets.redact(docs, top_words=1).collect())
