"""Chunks of media: where they are cut, each stored once, and files read back from the stored table."""

import hashlib
import random

from pyspark.sql import functions as F

from tagloom.llm import media


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(r.randrange(500)) for _ in range(n))


def test_cuts_follow_content():
    text = prose(1, 40_000)
    for t in (text, "", "x", "y" * 300_000):
        m = media.to_media(t)
        ends = media.cuts([m])[0]
        assert ends[-1] == len(m) and media.from_media(m).decode().rstrip(" ") == t
        sizes = [b - a for a, b in zip([0, *ends], ends)]
        assert all(media.MIN_CHUNK <= s <= media.MAX_CHUNK for s in sizes[:-1]) and 0 < sizes[-1] <= media.MAX_CHUNK
    kept = [{hashlib.sha256(c).digest() for c in cs} for _, cs in media.chunked([text, "a few new words " + text])]
    assert len(kept[0]) > 20 and len(kept[0] - kept[1]) <= 3


def test_each_chunk_is_stored_once_and_read_back_without_moving(spark):
    long = prose(2, 20_000)
    rows = [(1, long), (2, long), (3, "new start " + long), (4, None), (None, "x"), *((10 + i, prose(i, 40)) for i in range(60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    words = media.dictionary(docs)
    want = {hashlib.sha256(c).digest(): c for _, cs in media.chunked([t or "" for _, t in rows]) for c in cs}
    name = media.write_store(media.chunk_store(docs, words))
    stored = spark.table(name).collect()
    assert len(stored) == len(want) and {bytes(r.digest) for r in stored} == set(want)
    codec = media.zstandard.ZstdDecompressor(**media._known(words))
    assert all(codec.decompress(bytes(r.chunk)) == want[bytes(r.digest)] for r in stored)
    joined = spark.createDataFrame([(d,) for d in want], "digest binary").join(spark.table(name).hint("merge"), "digest")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == len(want) and plan.count("Exchange hashpartitioning") == 1
    spark.sql(f"DROP TABLE {name}")
    out = {r.doc_id: r for r in media.media_columns(docs).withColumn("k", F.lit(1)).collect()}
    assert len(out) == len(rows) and out[1].media_sha256 == out[2].media_sha256 == hashlib.sha256(media.to_media(long)).hexdigest()


def test_a_damaged_chunk_fails(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    manifest = media.manifests(docs)
    bad = spark.createDataFrame([(media.hashlib.sha256(media.to_media("some text")).digest(), media.zstandard.compress(b"other"))], "digest binary, chunk binary")
    try:
        media.features(media.restored(manifest, bad)).collect()
    except Exception as e:
        assert "damaged" in str(e)
    else:
        raise AssertionError("read a damaged chunk")
