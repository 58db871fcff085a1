"""Formats beyond the fixed ones, which only the trees of op7 can find."""

from pyspark.sql import functions as F

from tagloom.llm import pii
from tests.llm import brute

FOUND = [
    ("reach me: ", "john [at] example.com", ""), ("write to ", "mary.smith (at) acme [dot] org", " please"), ("", "jo {AT} mail.de", "."),
    ("mail ", "jörg@bücher.de", ""), ("office ", "(555) 123-4567", " today"), ("", "(555) 123-4567", ""), ("so ", "555-234-4567", " ok"),
    ("tel ", "030 1234567", ""), ("au ", "01 23 45 67 89", " merci"), ("fax ", "5552344567", ""),
    # forms that the fitted examples do not have
    ("Telefon ", "0151 23456789", ""), ("", "john at example dot com", ""), ("", "DE89 3704 0044 0532 0130 00", " is ours"), ("to ", "DE89370400440532013000", ""),
    ("ssn ", "123-45-6789", ""), ("from ", "2001:db8::1", " on"), ("ni ", "AB 12 34 56 C", ""), ("call ", "020 7946 0958", ""),
    ("card 4111 1111 1111 1112 or ", "555-234-4567", ""),
]
PASSED = [
    "order 1234-567-890", "on 2024-01-31 12:30", "version 10.0.19041.1234", "look (at) this", "meet [at] noon.", "@app.route x",
    "id 5552344567", "SKU-555-234-4567", "host 300.1.2.3", "isbn 978-3-16-148410-0", "population 1 234 567", "from 01.02.2024",
    "at 12:30:45 ok", "00:1B:44:11:3A:B7", "DE89 3704 0044 0532 0130 01", "look at the dot com", "std::vector a::b", "x 3.14 2.71 1.41",
    "a 100-200 300-400 500-600", "12 345 678 9012 33", "ssn 000-12-3456", "2024-01-31 2024-02-28",
]


def test_variants_are_found_and_numbers_passed(spark):
    texts = [a + b + c for a, b, c in FOUND] + PASSED
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.find_pii(docs).collect()}
    for i, (before, value, _) in enumerate(FOUND):
        assert spans[i] == [("likely", len(before), len(before) + len(value))], texts[i]
    for i in range(len(FOUND), len(texts)):
        assert spans[i] == [], texts[i]


def covered(text, spans, mark="[PII]"):
    out, at = "", 0
    for start, end in sorted(spans):
        if start >= at:
            out += text[at:start] + mark
        at = max(at, end)
    return out + text[at:]


def test_numbers_in_a_row_are_told_apart_and_fixed_formats_stay(spark):
    rows = [
        ("555-234-4567 / 555-987-6543", ["555-234-4567", "555-987-6543"]), ("+49 30 1234567 (555) 234-4567", ["+49 30 1234567", "(555) 234-4567"]),
        ("2024-01-31 555-234-4567 99", ["555-234-4567"]), ("card 4111 1111 1111 1111  555-234-4567", ["555-234-4567"]), ("a@b.co, 10.1.2.3 and +1 555 123 4567", []),
        ("9 " * 5_000 + "- 555-234-4567 " + "8.1 " * 5_000, ["555-234-4567"]),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    for r in pii.find_pii(docs).collect():
        text, want = rows[r.doc_id]
        base = [(s.kind, s.start, s.end) for s in r.base]
        assert sorted(base) == sorted(brute.pii(text))
        assert [text[s.start : s.end] for s in r.spans if s.kind == "likely"] == want, text[:60]
        assert {tuple(s) for s in r.base} <= {tuple(s) for s in r.spans}


def test_overlapping_candidates_leave_the_likeliest(spark):
    cases = [
        [], [(0, 5, 1.0)], [(0, 5, 1.0), (3, 9, 2.0)], [(0, 9, 1.0), (0, 12, 1.0), (12, 15, 0.5)],
        [(0, 5, 3.0), (4, 9, 2.0), (9, 12, 0.1), (10, 14, 0.2)], [(i * 3, i * 3 + 3, 1.0) for i in range(700)],
    ]
    wants = [[], [(0, 5)], [(3, 9)], [(0, 12), (12, 15)], [(0, 5), (10, 14)], [(i * 3, i * 3 + 3) for i in range(700)]]
    docs = spark.createDataFrame(list(enumerate(cases)), "i int, c array<struct<start:bigint,end:bigint,margin:double>>")
    for r in docs.select("i", pii.best_apart(F.col("c")).alias("o")).collect():
        assert [(x.start, x.end) for x in r.o] == wants[r.i]


def test_redaction_covers_every_span_and_nothing_else(spark):
    texts = [
        None, "", "nothing here", "a@b.co", "\U0001f600 a@b.co \u00e9 call 555-234-4567 end", "x" * 4_090 + " a@b.co " + "\u00e9" * 9_000 + " 10.1.2.3",
        "+4111111111111111 z", "a@b.co" * 3, "9 " * 3_000 + "a@b.co\n" * 600,
    ]
    rows = [(i % 7 or None, t, "k", 1) for i, t in enumerate(texts)] + [(1, "a@b.co", "k", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, _bare int")
    out = pii.redact(docs)
    assert out.columns == docs.columns and pii.redact(docs.limit(0)).collect() == []
    want = []
    for i, t, *rest in rows:
        want.append((i, t if t is None else covered(t, [(a, b) for _, a, b in brute.pii(t)] + [(t.index(x), t.index(x) + len(x)) for x in ["555-234-4567"] if x in t]), *rest))
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))


def test_sample_is_labelled_without_the_fixed_formats():
    planted = pii.sample()
    assert len(planted) == pii.SAMPLE and planted == pii.sample()
    assert 0.2 < sum(bool(spans) for _, spans in planted) / len(planted) < 0.5
