"""The filter audit against its SQL and against counting one document after another."""

import re
from collections import defaultdict
from itertools import permutations

from tagloom.llm import audit
from tests.conftest import SF_DIR

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def failing(docs):
    """The filters each (doc_id, text, lang) fails, straight from their definition."""
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    out = []
    for i, text, _ in docs:
        text = text or ""
        words = WORD.findall(text)
        out.append({
            f for f, hit in {
                "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words),
                "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search("[#$%&*|]", text)),
                "E": i is not None and first[text] < i,
            }.items() if hit
        })
    return out


def brute(docs, labels):
    good = {i for i, quality, _ in labels if quality == 1 and i is not None}
    toxic = {i for i, _, toxic in labels if toxic == 1 and i is not None}
    fails, out, shapley = failing(docs), defaultdict(lambda: [0] * 6), defaultdict(int)
    for (i, _, lang), failed in zip(docs, fails):
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for step, f in enumerate(order, 1):
                c = out[lang or "", order, step]
                removed, was = f in failed and not gone, gone
                gone = gone or f in failed
                for k, hit in enumerate((not gone, removed, f in failed and was, failed == {f}, removed and i in good, removed and i in toxic)):
                    c[k] += hit
                shapley[lang or "", f] += removed
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def found(df):
    return {(r[0], r[1], r[2]): tuple(r[3:]) for r in df.collect()}


def test_whole_table(spark):
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    got = found(audit.filter_audit(docs, labels))
    plain = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]
    assert got == brute(plain, [tuple(r) for r in labels.collect()])
    assert len(got) == 600 * len({x[2] or "" for x in plain})


def test_odd_rows_in_many_groups(spark, monkeypatch):
    monkeypatch.setattr(audit, "PARTS_HELD", 2)
    long = "Word " * 120 + "x" * 40_000
    docs = [
        (1, None, None), (2, "", "en"), (None, "", "en"), (None, long, "de"), (3, long, "de"), (3, long, "de"), (4, long, None),
        (5, "A#", "fr"), (6, "ÀÉ é b", "fr"), (7, " ".join(map(str, range(100))), ""), (7, "other", "en"),
    ]
    labels = [(3, 1, 0), (3, None, 1), (4, 1, None), (None, 1, 1), (9, 1, 1)]
    rows = [(*d, "p", "m", 1) for d in docs]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, part string, mask string, n int").repartition(7)
    named = spark.createDataFrame([(*x, 5) for x in labels], "doc_id long, quality int, toxic int, flags int")
    assert found(audit.filter_audit(frame, named)) == brute(docs, labels)
    assert found(audit.filter_audit(frame, named.limit(0))) == brute(docs, [])
    assert found(audit.filter_audit(frame.limit(0), named)) == {}


def test_fields_do_not_run_into_each_other():
    counts = audit.unpacked((1 << 61) * audit.packed(0b11111) + ((1 << 61) - 1) * audit.packed(0b00001))
    first, (kept, removed, redundant) = audit.ORDERS.index("ABCDE"), range(3)
    assert counts[first, 0, removed] == (1 << 62) - 1 and counts[first, 0, kept] == 0
    assert counts[first, 1, redundant] == 1 << 61 and counts[first, 1, removed] == 0
