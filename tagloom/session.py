"""Session settings and the shared place for intermediate results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


# HotSpot never compiles methods over 8 KB; beyond that, split expressions run faster.
METHOD_LIMIT = ("spark.sql.codegen.hugeMethodLimit", "8000")


def build_session(app: str = "tagloom", **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    Master, memory and shuffle width are left to the cluster (or to ``conf``);
    what is fixed here is what results depend on (UTC) and what skew handling
    relies on (adaptive execution).
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config(*METHOD_LIMIT)
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def compile_methods(spark: SparkSession) -> None:
    """Keep long expressions compiled in a session that ``build_session`` did not make and that names no limit."""
    name, limit = METHOD_LIMIT
    if spark.conf.get(name) == "65535":  # Spark's default
        spark.conf.set(name, limit)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in ``spark.checkpoint.dir``.

    Where it names none, a folder below the warehouse, which a cluster shares as well.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/.checkpoints")


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage with a reliable checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settle_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the folder the cluster shares, and read it back.

    Its lineage ends there, so a lost executor costs the tasks it was running and no more.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
