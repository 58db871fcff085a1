"""Catalog tables that batches add to and change row by row.

A table is a folder of Parquet files by ``bucket`` (a hash of the columns it is looked up by) and
``batch_id``. A batch writes only the rows it adds or changes, into its own folders of the buckets
they belong to, and reads only buckets that hold keys it asks for; of rows with one name those of
the latest batch count. Work follows the batch, not the catalog.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.schema import CATALOG
from tagloom.session import settle


@dataclass(frozen=True)
class Stored:
    schema: T.StructType
    bucket: tuple[str, ...]  # rows are looked up by these columns
    name: tuple[str, ...]  # columns that tell rows apart; where there are none, rows are only added


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in columns.items()])


_L, _S = T.LongType(), T.StringType()
TABLES: dict[str, Stored] = {
    "content": Stored(CATALOG["content"], ("source_hash",), ("content_id",)),
    "content_redirect": Stored(CATALOG["content_redirect"], ("source_hash",), ("old_slug",)),
    "content_origin": Stored(CATALOG["content_origin"], ("content_id",), ("content_id", "name", "origin_id")),
    # Which item has a site's id: the origins once more, by what uploads ask for.
    "origin_owner": Stored(_schema(name=_S, origin_id=_S, content_id=_L), ("name", "origin_id"), ("name", "origin_id")),
    "content_tag": Stored(CATALOG["content_tag"], ("content_id",), ("content_id", "tag_id")),
    "image_hash": Stored(CATALOG["image_hash"], ("content_id",), ("content_id",)),
    "representation": Stored(CATALOG["representation"], ("content_id",), ("content_id",)),
    "tag": Stored(CATALOG["tag"], ("tag_id",), ("tag_id",)),
    "tag_alias": Stored(CATALOG["tag_alias"], ("title",), ("title",)),
    "tag_implication": Stored(CATALOG["tag_implication"], ("target",), ("target", "implicate")),
    "task": Stored(CATALOG["task"], ("source_hash",), ("task_id",)),
    "task_status": Stored(_schema(task_id=_L, status=T.IntegerType()), ("task_id",), ("task_id",)),
    "task_result": Stored(CATALOG["task_result"], ("task_id",), ("task_id",)),
    "execution_error": Stored(CATALOG["execution_error"], ("task_id",), ()),
    "highest_id": Stored(_schema(name=_S, value=_L), ("name",), ("name",)),
}
SEED = -1  # the batch of the rows a store starts with
_PLACE = _schema(_gone=T.BooleanType(), bucket=T.IntegerType(), batch_id=_L, kind=_S)
_FOLDER = re.compile(r"(.*/bucket=(\d+)/batch_id=(-?\d+)/kind=(batch|whole))/[^/]*$")


class Store:
    """The tables below ``path``. ``buckets`` is fixed when a store is made and must not change."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 256):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def bucket(self, table: str):
        """The bucket of a row of ``table``; of a frame that has the columns it is looked up by."""
        return F.pmod(F.xxhash64(*TABLES[table].bucket), F.lit(self.buckets)).cast("int")

    def asked(self, table: str, keys: DataFrame) -> list[int]:
        """The buckets that hold ``keys``: numbers below ``buckets``, so few whatever the keys are."""
        return sorted(r[0] for r in keys.select(self.bucket(table).alias("b")).distinct().collect())

    def write(self, table: str, rows: DataFrame, batch_id: int, kind: str = "batch") -> None:
        """Write rows as they are after a batch; what the same batch wrote before in their buckets goes.

        A true ``_gone`` says that there are no more rows of this name.
        """
        stored, has = TABLES[table], set(rows.columns)
        columns = [F.col(f.name) if f.name in has else F.lit(None).cast(f.dataType).alias(f.name) for f in stored.schema]
        gone = F.col("_gone") if "_gone" in has else F.lit(False)
        placed = rows.select(
            *columns, gone.alias("_gone"), self.bucket(table).alias("bucket"), F.lit(batch_id).cast("long").alias("batch_id"),
            F.lit(kind).alias("kind"),
        )
        (
            placed.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("bucket", "batch_id", "kind").parquet(f"{self.path}/{table}")
        )

    def _rows(self, table: str, before: int | None, buckets: list[int] | None) -> DataFrame | None:
        root = f"{self.path}/{table}"
        folder = root if buckets is None else f"{root}/bucket={{{','.join(map(str, buckets))}}}"
        schema = T.StructType([*TABLES[table].schema, *_PLACE])
        try:
            found = self.spark.read.schema(schema).option("basePath", root).parquet(folder)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return found if before is None else found.filter(F.col("batch_id") < before)

    def _latest(self, table: str, rows: DataFrame) -> DataFrame:
        if not (name := TABLES[table].name):
            return rows
        # Of one batch, the rows that a compaction wrote stand for its own.
        at = F.struct("batch_id", "kind")
        return rows.withColumn("_last", F.max(at).over(Window.partitionBy(*name))).filter(at == F.col("_last")).drop("_last")

    def read(self, table: str, before: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of ``table`` after all batches, or those numbered below ``before``; of some buckets, or all."""
        columns = TABLES[table].schema.names
        rows = None if buckets == [] else self._rows(table, before, buckets)
        if rows is None:
            return self.spark.createDataFrame([], TABLES[table].schema)
        return self._latest(table, rows).filter(~F.col("_gone")).select(*columns)

    def look_up(self, table: str, keys: DataFrame, before: int | None = None) -> DataFrame:
        """The rows of ``table`` that have ``keys`` (its columns to be looked up by), settled: as many as the batch asks for."""
        columns = list(TABLES[table].bucket)
        keys = keys.select(*columns).distinct()
        rows = self.read(table, before, self.asked(table, keys))
        return settle(rows.join(keys, columns, "left_semi"))

    def folders(self, table: str) -> dict[int, list[tuple[int, str, str]]]:
        """bucket -> [(batch_id, kind, folder)] of what is written."""
        rows, found = self._rows(table, None, None), {}
        for file in rows.inputFiles() if rows is not None else []:
            if m := _FOLDER.match(file):
                found.setdefault(int(m[2]), set()).add((int(m[3]), m[4], m[1]))
        return {b: sorted(x) for b, x in found.items()}

    def compact(self, table: str, batch_id: int, most: int = 8) -> list[int]:
        """Put together buckets that more than ``most`` batches below ``batch_id`` wrote to; returns them.

        The rows that count are written beside the others before these are removed, so a run
        that ends in between leaves a table that reads the same. Rows marked as gone stay marked.
        """
        if not TABLES[table].name:
            return []
        old = {b: [x for x in at if x[0] < batch_id] for b, at in self.folders(table).items()}
        old = {b: at for b, at in old.items() if len(at) > most}
        if not old:
            return []
        rows = self._latest(table, self._rows(table, batch_id, sorted(old)))
        self.write(table, rows.drop("bucket", "batch_id", "kind"), batch_id - 1, "whole")
        for at in old.values():
            for n, kind, folder in at:
                if (n, kind) != (batch_id - 1, "whole"):
                    self._remove(folder)
        return sorted(old)

    def _remove(self, folder: str) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)

    def seed(self, base: dict[str, DataFrame]) -> None:
        """Start with the rows of ``base``, unless the store has begun already."""
        if self.folders("highest_id"):
            return
        for table, rows in base.items():
            self.write(table, rows, SEED, "whole")
        if "content_origin" in base:
            owned = base["content_origin"].filter(F.col("origin_id") != "").groupBy("name", "origin_id")
            self.write("origin_owner", owned.agg(F.min("content_id").alias("content_id")), SEED, "whole")
        top = base["content"].agg(F.coalesce(F.max("content_id"), F.lit(0)).alias("value"))
        self.write("highest_id", top.withColumn("name", F.lit("content")), SEED, "whole")  # last: says that all is there
