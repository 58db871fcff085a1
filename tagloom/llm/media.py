"""Media columns: texts as grey images, stored as content-defined chunks, each chunk once."""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import map_columns, settle_table, texts
from tagloom.session import ensure_checkpoint_dir

WIDTH = 192  # samples in a row of an image
MIN_CHUNK, MAX_CHUNK, CUT_BITS = 2 << 10, 64 << 10, 13  # a cut every 8 KB beyond the least, on average
REMEMBERED = 50_000  # digests of chunks a task has sent already
DICTIONARY, SAMPLED = 64 << 10, 2_000  # bytes of the compressor's dictionary, texts it is made from

# The gear table: a fixed pseudo-random number for each byte.
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b])) for b in range(256)], np.uint32)


def to_media(text: str) -> bytes:
    """A binary grey map (P5) with a sample per byte: the text as UTF-8, filled with spaces to whole rows."""
    raw = text.encode()
    rows = max(1, -(-len(raw) // WIDTH))
    return b"P5\n%d %d\n255\n" % (WIDTH, rows) + raw.ljust(rows * WIDTH)


def from_media(media: bytes) -> bytes:
    """The samples of a binary grey map."""
    kind, size, depth, samples = media.split(b"\n", 3)
    width, rows = map(int, size.split())
    if kind != b"P5" or depth != b"255" or len(samples) != width * rows:
        raise ValueError("not a grey map of 8-bit samples")
    return samples


def cuts(payloads: list[bytes]) -> list[list[int]]:
    """The ends of each payload's chunks. The rolling gear hash of 32 bytes is worked out for all at once.

    h = 2 h + gear[byte], to 32 bits, so a byte leaves after 32 steps: five doublings of what the
    sums reach. The first bytes of a payload see the one before it, but no cut can be there.
    """
    h = GEAR[np.frombuffer(b"".join(payloads), np.uint8)]
    for step in (1, 2, 4, 8, 16):
        h[step:] += h[:-step] << np.uint32(step)
    at = np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1
    out, base = [], 0
    for payload in payloads:
        n, start, ends = len(payload), 0, []
        while n - start > MIN_CHUNK:
            i = np.searchsorted(at, base + start + MIN_CHUNK)
            end = min(int(at[i]) - base if i < len(at) else n, start + MAX_CHUNK, n)
            ends.append(end)
            start = end
        if start < n:
            ends.append(n)
        out.append(ends)
        base += n
    return out


def chunked(text: list[str]):
    """(media, its chunks) of each text."""
    media = [to_media(t) for t in text]
    for m, ends in zip(media, cuts(media)):
        yield m, [m[a:b] for a, b in zip([0, *ends], ends)]


def manifests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media_key, digests): the ordered chunk list of each document's media, by digest."""

    def make():
        def apply(rows):
            parts = list(chunked(rows["text"]))
            return {
                "doc_id": pa.array(rows["doc_id"], pa.int64()),
                "n_bytes": pa.array([len(t.encode()) for t in rows["text"]], pa.int64()),
                "media_key": pa.array([hashlib.sha256(m).digest() for m, _ in parts], pa.binary()),
                "digests": pa.array([[hashlib.sha256(c).digest() for c in cs] for _, cs in parts], pa.list_(pa.binary())),
            }

        return apply

    return map_columns(texts(docs), make, "doc_id long, n_bytes long, media_key binary, digests array<binary>", rows=256)


def dictionary(docs: DataFrame) -> bytes:
    """What the compressor knows before it sees a chunk, from at most ``SAMPLED`` texts; empty if they are too few.

    Which texts these are changes how small chunks get and nothing else. It belongs to the store: chunks
    cannot be read without it.
    """
    sample = [c for r in texts(docs).select(F.left("text", F.lit(MIN_CHUNK)).alias("text")).limit(SAMPLED).collect() for c in next(chunked([r["text"]]))[1]]
    try:
        return zstandard.train_dictionary(DICTIONARY, sample).as_bytes()
    except zstandard.ZstdError:
        return b""


def _known(words: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(words)} if words else {}


def chunk_store(docs: DataFrame, words: bytes = b"") -> DataFrame:
    """(digest, chunk): every distinct chunk of all media once, compressed with the dictionary ``words``."""

    def make():
        sent, codec = set(), zstandard.ZstdCompressor(level=6, **_known(words))

        def apply(rows):
            new = {}
            for _, chunks in chunked(rows["text"]):
                for c in chunks:
                    digest = hashlib.sha256(c).digest()
                    if digest not in sent:
                        if len(sent) >= REMEMBERED:
                            sent.clear()
                        sent.add(digest)
                        new[digest] = codec.compress(c)
            return {"digest": pa.array(list(new), pa.binary()), "chunk": pa.array(list(new.values()), pa.binary())}

        return apply

    sent = map_columns(texts(docs), make, "digest binary, chunk binary", rows=256)
    return sent.groupBy("digest").agg(F.first("chunk").alias("chunk"))


def write_store(store: DataFrame) -> str:
    """The name of a table with the chunks, in a bucket per shuffle partition by their digest, so that joins on it move no chunk."""
    spark = store.sparkSession
    ensure_checkpoint_dir(spark)
    name = f"chunks_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}"
    store.write.format("parquet").bucketBy(buckets, "digest").option("path", path).option("compression", "uncompressed").saveAsTable(name)
    return name


def restored(manifest: DataFrame, store: DataFrame) -> DataFrame:
    """(media_key, parts): the stored chunks of each distinct media, in order.

    Chunk lists meet the store on the digest. Media of one chunk, which most are, are whole then and
    move no more; the others are gathered by their key, at most a media file's chunks in a group.
    """
    distinct = manifest.groupBy("media_key").agg(F.first("digests").alias("digests"))
    part = F.struct("at", "digest", "chunk")
    one = distinct.filter(F.size("digests") == 1).select("media_key", F.lit(0).alias("at"), F.col("digests")[0].alias("digest"))
    many = distinct.filter(F.size("digests") > 1).select("media_key", F.posexplode("digests").alias("at", "digest"))
    return (
        one.join(store, "digest").select("media_key", F.array(part).alias("parts"))
        .unionByName(many.join(store, "digest").groupBy("media_key").agg(F.array_sort(F.collect_list(part)).alias("parts")))
    )


def feature(samples: bytes) -> str:
    """Shares of 16 bands of brightness in 255ths, as hex, and the mean brightness in thousandths."""
    x = np.frombuffer(samples, np.uint8)
    bands = np.bincount(x >> 4, minlength=16) * 255 // len(x)
    return "".join(f"{b:02x}" for b in bands) + f":{int(x.sum(dtype=np.int64)) * 1000 // len(x)}"


def features(media: DataFrame, words: bytes = b"") -> DataFrame:
    """What is read back from stored media: (media_key, payload_bytes, payload_sha256, tail, media_bytes, media_sha256, feature).

    A chunk that does not have its digest, or a file that does not have its key, fails the job.
    """

    def make():
        codec = zstandard.ZstdDecompressor(**_known(words))

        def read(key: bytes, parts) -> bytes:
            out = []
            for p in parts:
                out.append(codec.decompress(p["chunk"]))
                if hashlib.sha256(out[-1]).digest() != p["digest"]:
                    raise ValueError(f"chunk {p['at']} of media {key.hex()} is damaged")
            whole = b"".join(out)
            if hashlib.sha256(whole).digest() != key:
                raise ValueError(f"media {key.hex()} is damaged")
            return whole

        def apply(rows):
            media = [read(k, p) for k, p in zip(rows["media_key"], rows["parts"])]
            samples = [from_media(m) for m in media]
            return {
                "media_key": pa.array(rows["media_key"], pa.binary()),
                "payload_bytes": pa.array(map(len, samples), pa.int64()),
                "payload_sha256": pa.array([hashlib.sha256(s).hexdigest() for s in samples]),
                "tail": pa.array([s[-16:] for s in samples], pa.binary()),
                "media_bytes": pa.array(map(len, media), pa.int64()),
                "media_sha256": pa.array([hashlib.sha256(m).hexdigest() for m in media]),
                "feature": pa.array(map(feature, samples), pa.string()),
            }

        return apply

    return map_columns(
        media, make,
        "media_key binary, payload_bytes long, payload_sha256 string, tail binary, media_bytes long, media_sha256 string, feature string",
        rows=128,
    )


def media_columns(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail, media_bytes, media_sha256, feature): a row per row of ``docs``.

    Each text becomes a media file, which is cut where its content says (:func:`cuts`); equal chunks
    of different documents are written once, to a table of their own (:func:`write_store`); files are
    put together from what is read back of it, verified and read. The table's name is given up then,
    its files stay. Texts are read twice, so that only distinct compressed chunks move. Equal texts have equal
    values. Null and empty texts are a row of spaces; null ids stay null; repeated rows come back
    as often; an empty table gives none; other columns are ignored.
    """
    manifest = settle_table(manifests(docs), "manifests")
    words, spark = dictionary(docs), docs.sparkSession
    name = write_store(chunk_store(docs, words))
    seen = settle_table(features(restored(manifest, spark.table(name)), words), "features")
    spark.sql(f"DROP TABLE {name}")
    return manifest.select("doc_id", "n_bytes", "media_key").join(seen, "media_key").drop("media_key")
