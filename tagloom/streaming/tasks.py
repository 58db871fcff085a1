"""The task queue as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tagloom import rules
from tagloom.functions.origins import normalise_origin_id
from tagloom.operators.ingest import has_origin, ingest_batch, task_results
from tagloom.operators.tags import attach_tags, tags_from_metadata
from tagloom.session import settle
from tagloom.streaming.store import Store

COMPACT_EVERY = 16  # batches


def dedupe(stream: DataFrame, delay: str) -> DataFrame:
    """One task per source hash and one per (site, id), among tasks ``delay`` apart.

    State older than the delay is dropped; repeats that come later still are turned
    away by the catalog itself when they are ingested.
    """
    by_hash = stream.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["source_hash"])
    origin = F.when(has_origin(), F.to_json(F.struct("origin_name", "origin_id"))).otherwise(
        F.concat(F.lit("task "), F.col("task_id").cast("string"))
    )
    return by_hash.withColumn("_origin", origin).dropDuplicatesWithinWatermark(["_origin"]).drop("_origin")


def status_log(events: DataFrame) -> DataFrame:
    """Latest status per task from transitions (task_id, status, changed_at, seq)."""
    latest = F.max_by("status", F.struct("changed_at", "seq"))
    return events.groupBy("task_id").agg(latest.alias("status"))


def live_statuses(events: DataFrame, delay: str) -> DataFrame:
    """Changes of the latest status per task from a stream of transitions (task_id, status, changed_at, seq).

    What is kept of a task is one row; that of a finished task (done or discarded) goes once the
    watermark is past its last change, so state follows the tasks under way and not all there
    ever were. For update mode; the last row of a task holds what :func:`status_log` gives.
    """
    finished = (rules.DONE, rules.DISCARDED)

    def advance(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        had = state.get if state.exists else None  # (changed_at in microseconds, seq, status)
        best = had
        for batch in batches:
            at = batch["changed_at"].astype("datetime64[us]").astype("int64")
            best = max([*zip(at.tolist(), batch["seq"].tolist(), batch["status"].tolist()), *([best] if best else [])])
        state.update(best)
        if best[2] in finished:
            state.setTimeoutTimestamp(max(best[0] // 1000, state.getCurrentWatermarkMs()) + 1)
        if best != had:
            yield pd.DataFrame({"task_id": [key[0]], "status": [best[2]]})

    slim = events.select("task_id", "status", F.col("changed_at").cast("timestamp").alias("changed_at"), "seq")
    return slim.withWatermark("changed_at", delay).groupBy("task_id").applyInPandasWithState(
        advance, "task_id long, status int", "at long, seq long, status int", "update", GroupStateTimeout.EventTimeTimeout
    )


def process_batch(
    tasks: DataFrame, batch_id: int, store: Store, date: str, renditions: DataFrame | None = None
) -> dict[str, DataFrame]:
    """What a batch of tasks adds to and changes in the tables of ``store``, by table.

    ``tasks`` has the columns of :func:`ingest_batch` and may have tags (category -> names) and
    created_at; ``renditions`` (source_hash, file_size) what was made of the files. Of the catalog only
    rows are read that share a hash, an item or a site id with the batch, and the vocabulary.
    """
    before, when = batch_id, F.lit(date).cast("timestamp_ntz")
    hashes = tasks.select("source_hash").filter(F.col("source_hash").isNotNull())
    content, redirect, earlier = (store.look_up(t, hashes, before) for t in ("content", "content_redirect", "task"))
    here = content.select("content_id").unionByName(redirect.select(F.col("new_content_id").alias("content_id")))
    asked = tasks.select(
        F.col("origin_name").alias("name"), normalise_origin_id("origin_name", "origin_id").alias("origin_id")
    ).filter("name <> '' and origin_id <> ''")
    owned = store.look_up("origin_owner", asked, before)
    origin = store.look_up("content_origin", here, before)
    known = origin.select("content_id", "name", "origin_id").unionByName(owned.select("content_id", "name", "origin_id")).distinct()
    top = store.read("highest_id", before).filter("name = 'content'").agg(F.max("value")).first()[0] or 0
    catalog = {"content": content, "content_redirect": redirect, "content_origin": known}
    made = ingest_batch(tasks, catalog, when, earlier, top)
    landed = settle(made["landed"])

    new_origin = made["content_origin"]
    out = {
        "content": made["content"].unionByName(made["rewritten"], allowMissingColumns=True).withColumn("last_edit", when),
        "content_origin": new_origin.unionByName(made["origin_marks"]),
        "origin_owner": new_origin.filter("origin_id <> ''").select("name", "origin_id", "content_id"),
        "highest_id": made["content"].agg(F.greatest(F.max("content_id"), F.lit(top)).alias("value")).withColumn("name", F.lit("content")),
    }
    stale = made["rewritten"].select("content_id", F.lit(True).alias("_gone"))
    out |= {"image_hash": stale, "representation": stale}
    if "tags" in tasks.columns:
        out |= _tags(tasks, landed, store, before)
    done = landed.join(tasks.select("task_id", "source_hash", F.col("size").alias("source_file_size")), "task_id")
    if renditions is None:
        sizes = landed.select("content_id", F.lit(None).cast("long").alias("file_size")).limit(0)
    else:
        sizes = renditions.join(done.select("source_hash", "content_id").distinct(), "source_hash").select("content_id", "file_size")
    out["task_result"] = task_results(done, sizes)["task_result"]
    status = settle(made["task_status"])
    stand = status.join(made["refused"], "task_id", "left_anti")
    finished = F.col("status").isin(rules.DONE, rules.DISCARDED)
    out["task"] = tasks.drop("status", "uploaded_file").join(stand, "task_id").withColumn(
        "uploaded_file", F.when(~finished, F.col("file_name"))
    )
    return out | {"execution_error": made["execution_error"], "task_status": status}


def _tags(tasks: DataFrame, landed: DataFrame, store: Store, before: int) -> dict[str, DataFrame]:
    """New rows of the vocabulary and of the bridge. The vocabulary is read whole: it grows with tags, not items."""
    given = tasks.select("task_id", "tags").join(landed, "task_id")
    first = given.groupBy("content_id").agg(F.min("task_id").alias("task_id"))
    wanted = tags_from_metadata(given).join(first, "content_id").withColumn("seq", F.struct("task_id", "category", "name"))
    tag, alias, implication = (store.read(t, before) for t in ("tag", "tag_alias", "tag_implication"))
    has = store.look_up("content_tag", landed.select("content_id"), before)
    now = attach_tags(wanted.select("content_id", "name", "category", "seq"), has, tag, alias, implication)
    return {
        "tag": now["tag_rows"], "tag_alias": now["alias_rows"], "tag_implication": now["implication_rows"],
        "content_tag": now["added"],
    }


def write_batch(batch: DataFrame, batch_id: int, store: Store, date: str, renditions: DataFrame | None = None) -> None:
    """Run one micro-batch and write what it adds and changes, the tasks' statuses last.

    A batch that is run again after a failure reads only what earlier ones wrote and
    replaces its own folders, so it ends with the same catalog.
    """
    tasks = settle(batch)
    out = process_batch(tasks, batch_id, store, date, renditions)
    for table, rows in out.items():
        store.write(table, rows, batch_id)
    if batch_id % COMPACT_EVERY == COMPACT_EVERY - 1:
        for table in out:
            store.compact(table, batch_id)


def ingest(
    stream: DataFrame, store: Store, base: dict[str, DataFrame], checkpoint: str, date: str, renditions: DataFrame | None = None
) -> StreamingQuery:
    """Run the waiting tasks of ``stream`` through ingest, batch by batch.

    ``base`` holds what a new store starts with: content, content_redirect and content_origin
    at least. Read the catalog with ``store.read``.
    """
    store.seed(base)
    return (
        stream.writeStream.foreachBatch(lambda df, n: write_batch(df, n, store, date, renditions))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
