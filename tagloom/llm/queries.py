"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import audit, centroids, chat, jaccard, media, packing, pii, quality, secrets, sentencepiece, sharding, simhash, substrings
from tagloom.llm.common import joined, read

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql:
            ORACLE_SQL[name] = sql
        return build

    return register


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def kind_is(kind: str):
    return lambda span: span["kind"] == kind


@query("op1_sentencepiece")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = vocabulary("piece_bpe_32k.model")
    decoded = sentencepiece.decode(sentencepiece.encode(read(spark, sf_dir, "documents"), model), model)
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", F.sha2("text", 256).alias("decoded_sha256")
    )


@query("op2_secrets")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "guess")
    return found.select(
        "doc_id",
        *[F.size(F.filter("spans", kind_is(kind))).cast("long").alias(f"n_{kind}") for kind in secrets.KINDS],
        F.sha2(joined(base, secrets.KINDS), 256).alias("base_sha256"),
        joined(F.col("spans"), secrets.KINDS).alias("spans"),
    )


@query("op3_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.piece_rows(packing.pack(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")))


@query("op4_quality")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("_rules")
    return quality.quality_verdicts(read(spark, sf_dir, "documents")).select(
        "doc_id", *[r[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        "base_failed", "kept", F.col("verdict").alias("host_verdict"),
    )


@query("op5_chat")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    added = spark.sql(f"select * from values (-1L, 0L, 'user', '{said}'), (-1L, 1L, 'assistant', '{said}') as t(conv_id, turn, role, text)")
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    return chat.conversation_digests(chat.windows(turns))


@query("op7_pii")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(read(spark, sf_dir, "documents"))
    counts = [
        F.size(F.filter("base", kind_is(kind))).cast("long").alias(f"n_{kind}") for kind in pii.KINDS if kind != "likely"
    ]
    return found.select(
        "doc_id", *counts, F.sha2(joined(F.col("base"), pii.KINDS), 256).alias("base_sha256"),
        joined(F.col("spans"), pii.KINDS).alias("spans"),
    )


@query("op9_sharding")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query("op6_substrings")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.dedup_substrings(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"), F.sha2("_kept", 256).alias("kept_sha256")
    )


@query("op10_jaccard")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(read(spark, sf_dir, "documents"))


@query("op8_media")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", F.crc32("tail").alias("tail_crc32"), "media_bytes",
        "media_sha256", "feature",
    )


@query("op11_filter_audit", audit.SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op12_simhash")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(read(spark, sf_dir, "documents")).withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))


@query("op13_centroids", centroids.SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(read(spark, sf_dir, "embeddings"), "vec_id", "embedding")
