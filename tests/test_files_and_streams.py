"""Files on disk and the task stream."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tagloom.operators import browse, reports
from tagloom.operators.ingest import ingest_batch
from tagloom.operators.tags import attach_tags, tags_from_metadata
from tagloom.schema import CATALOG
from tagloom.session import settle
from tagloom.sources import catalog, files
from tagloom.streaming import tasks as streams
from tagloom.streaming.store import Store

SAMPLES = {
    "a.png": (b"\x89PNG\r\n\x1a\n....", "image/png"), "b.bin": (b"\xff\xd8\xff\xe0", "image/jpeg"),
    "c.gif": (b"GIF89a", "image/gif"), "d": (b"RIFF\x00\x00\x00\x00WEBPVP8 ", "image/webp"),
    "e.avif": (b"\x00\x00\x00\x1cftypavif", "image/avif"), "f.mp4": (b"\x00\x00\x00\x1cftypisom", "video/mp4"),
    "g.mov": (b"\x00\x00\x00\x14ftypqt  ", "video/quicktime"), "h.webm": (b"\x1a\x45\xdf\xa3....webm", "video/webm"),
    "deep/i.svg": (b"<?xml?>\n<svg width='1'>", "image/svg+xml"), "deep/j.txt": (b"just text", None),
}


def write_samples(tmp_path):
    for name, (body, _) in SAMPLES.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(body)


def test_scan_and_hash(spark, tmp_path):
    write_samples(tmp_path)
    found = {r.path.split(f"{tmp_path.name}/")[1]: r for r in files.scan_files(spark, str(tmp_path)).collect()}
    assert {n: r.mime_type for n, r in found.items()} == {n: m for n, (_, m) in SAMPLES.items()}
    assert found["deep/j.txt"].error == "undetected content type" and found["a.png"].media_type == "image"
    assert found["c.gif"].size == 6
    listed = files.list_files(spark, str(tmp_path))
    digests = {r.path.split(f"{tmp_path.name}/")[1]: bytes(r.source_hash) for r in files.hash_files(listed).collect()}
    assert digests == {n: hashlib.sha256(b).digest() for n, (b, _) in SAMPLES.items()}
    claimed = listed.filter(F.col("path").endswith("g.mov")).select("path", F.lit("video/mp4").alias("mime_type"))
    again = files.scan_files(spark, str(tmp_path), claimed).filter(F.col("path").endswith("g.mov")).first()
    assert again.mime_type == "video/mp4"


def test_orphans_by_name(spark, rows):
    listing = rows("filepath string", ("queue/a.png",), ("queue/b.png",))
    known = rows("filepath string", ("other/a.png",), (None,))
    assert [r.filepath for r in reports.orphan_files(listing, known, by_name=True).collect()] == ["queue/b.png"]


def test_catalog_round_trip(spark, inputs, tmp_path):
    content = inputs.f_content.withColumn("last_edit", F.col("addition_date")).select(*CATALOG["content"].names)
    catalog.write_catalog(content, str(tmp_path / "content"))
    back = catalog.load_catalog(spark, str(tmp_path), ["content"])["content"]
    assert back.schema == CATALOG["content"] and back.count() == content.count()
    assert back.exceptAll(content).count() == 0
    catalog.write_catalog(content, str(tmp_path / "by_day"), "addition_date")
    days = spark.read.parquet(str(tmp_path / "by_day"))
    assert days.count() == content.count() and "day" in days.columns


def test_item_pages_of_bucketed_tables_exchange_nothing(spark, inputs, tmp_path):
    tables = {n: getattr(inputs, f"f_{n}") for n in ("content", "content_tag", "representation")}
    for name, df in tables.items():
        catalog.write_bucketed(df, f"bucketed_{name}", str(tmp_path / name), buckets=4)
    stored = {n: spark.table(f"bucketed_{n}") for n in tables}
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        detail = lambda t: browse.content_detail(t["content"], t["content_tag"], inputs.f_tag, t["representation"])
        made = detail(stored)
        joins = made._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]
        assert "SortMergeJoin" in joins and "Exchange" not in joins
        assert sorted(map(repr, made.collect())) == sorted(map(repr, detail(tables).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        for name in tables:
            spark.sql(f"drop table bucketed_{name}")


def test_backfill_of_checksums(rows):
    content = rows("content_id long, slug string, addition_date timestamp_ntz, source_hash binary")
    hashes = rows("imagehash_id long, l_hash binary, a_hash binary, b_hash binary")
    reps = rows("filepath string, hash long", ("a", None), ("b", 5))
    sums = rows("filepath string, checksum long", ("a", 7), ("b", 9))
    made = catalog.backfill_derived(content, hashes, reps, sums)["representation"]
    assert {r.filepath: r.hash for r in made.collect()} == {"a": 7, "b": 5}


TASK = (
    "task_id", "source_hash", "mime_type", "size", "file_name", "content_type", "title", "description",
    "origin_name", "origin_id", "rewrite", "created_at",
)


def uploads(inputs):
    return inputs.f_file.select(
        F.col("file_id").alias("task_id"), "source_hash", "mime_type", "size", F.col("name").alias("file_name"),
        F.lit("image").alias("content_type"), F.lit("").alias("title"), F.lit("").alias("description"),
        "origin_name", "origin_id", F.lit(False).alias("rewrite"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("file_id").cast("int"))).alias("created_at"),
    ).select(*TASK)


def empty_base(inputs):
    content = inputs.f_content.limit(0).select(
        "content_id", "title", "content_type", "description", "addition_date", "is_hidden", "source_hash", "slug"
    )
    return {
        "content": content, "content_redirect": inputs.f_redirect.limit(0),
        "content_origin": inputs.f_origin.limit(0).select("content_id", "name", "origin_id", "alternate"),
    }


def file_stream(spark, inputs, folder):
    """Uploads in task order, written as several files read one per batch."""
    made = uploads(inputs)
    schema = made.schema
    for part in range(4):
        rows = made.filter(F.floor(F.col("task_id") / 50) == part)
        rows.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


DATE = "2026-03-04"
when = lambda: F.lit(DATE).cast("timestamp_ntz")


def tagged(inputs):
    """Uploads of which some repeat a hash, a site id or both, some rewrite, and all name tags."""
    n = F.col("task_id")
    made = uploads(inputs).withColumns(
        {
            "source_hash": F.when(n % 9 == 8, F.unhex(F.sha2((n - 60).cast("string"), 256))).otherwise(F.unhex(F.sha2(n.cast("string"), 256))),
            "size": F.when(n % 41 == 7, 0).otherwise(n + 5), "mime_type": F.when(n % 37 == 5, "video/quicktime").otherwise("image/png"),
            "rewrite": (n % 9 == 8) & (n % 2 == 0), "origin_name": F.when(n % 4 == 0, "").otherwise("derpibooru"),
            "origin_id": F.when(n % 5 == 0, "").when(n % 5 == 1, (n % 7).cast("string")).otherwise(n.cast("string")),
            "content_type": F.when(n % 2 == 0, "video").otherwise("image"),
        }
    )
    tags = F.create_map(
        F.lit("artist"), F.array(F.concat(F.lit("name "), (n % 3).cast("string"))), F.lit("style"), F.array(F.lit("Soft_Glow"), F.lit("red")),
        F.lit("odd"), F.array(F.lit("prompter:someone"), F.concat(F.lit("t"), (n % 11).cast("string"))),
    )
    return made.withColumn("tags", F.when(n % 6 != 0, tags))


def vocabulary(rows):
    return {
        "tag": rows("tag_id long, title string, category string", (1, "red", "style"), (2, "colour", "content"), (3, "t4", "content")),
        "tag_alias": rows("tag_id long, title string", (1, "red"), (2, "colour"), (3, "t4"), (1, "scarlet")),
        "tag_implication": rows("target long, implicate long", (1, 2), (3, 1)),
        "content_tag": rows("content_id long, tag_id long"),
    }


def by_hand(parts, base):
    """The batches one after another, each over whole tables kept in plain frames."""
    now, task, results, errors = dict(base), None, [], []
    for part in parts:
        earlier = task if task is not None else part.select("task_id", "source_hash", F.lit(0).alias("status"), "rewrite").limit(0)
        made = {k: settle(v) for k, v in ingest_batch(part, now, when(), earlier).items()}
        kept = now["content"].join(made["rewritten"], "content_id", "left_anti")
        now["content"] = settle(kept.unionByName(made["rewritten"]).unionByName(made["content"]))
        keys = ["content_id", "name", "origin_id"]
        origins = now["content_origin"].join(made["origin_marks"], keys, "left_anti")
        now["content_origin"] = settle(origins.unionByName(made["origin_marks"]).unionByName(made["content_origin"]))
        given = part.select("task_id", "tags").join(made["landed"], "task_id")
        first = given.groupBy("content_id").agg(F.min("task_id").alias("task_id"))
        wanted = tags_from_metadata(given).join(first, "content_id").withColumn("seq", F.struct("task_id", "category", "name"))
        added = attach_tags(wanted.drop("task_id"), now["content_tag"], now["tag"], now["tag_alias"], now["tag_implication"])
        now["content_tag"] = settle(now["content_tag"].unionByName(added["added"]))
        now |= {t: settle(added[t]) for t in ("tag", "tag_alias", "tag_implication")}
        results.append(made["landed"].join(part.select("task_id", "size"), "task_id").collect())
        errors.append(made["execution_error"].collect())
        stand = part.join(made["task_status"], "task_id").join(made["refused"], "task_id", "left_anti")
        stand = stand.select("task_id", "source_hash", "status", "rewrite")
        task = settle(stand if task is None else task.unionByName(stand))
    return now, task, [r for x in results for r in x], [r for x in errors for r in x]


def plain(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.fixture
def narrow(spark):
    """Many small jobs: two partitions are enough, and compiling takes longer than running."""
    quick = {"spark.sql.shuffle.partitions": "2", "spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in quick}
    for k, v in quick.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_stream_equals_batches_by_hand_through_replays_and_compaction(spark, inputs, rows, tmp_path, monkeypatch, narrow):
    monkeypatch.setattr(streams, "COMPACT_EVERY", 2)
    uploaded = settle(tagged(inputs))
    cut = lambda n: uploaded.filter(F.floor(F.col("task_id") / 100) == n)
    base = empty_base(inputs) | vocabulary(rows)
    now, task, results, errors = by_hand([cut(n) for n in range(2)], base)
    assert len(errors) > 10 and task.filter("status = 4").count() > 3 and now["content_tag"].count() > 300

    store = Store(spark, str(tmp_path / "out"), 4)
    for n in range(2):
        cut(n).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(uploaded.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = streams.ingest(stream, store, base, str(tmp_path / "chk"), DATE)
    run.awaitTermination(600)
    run.stop()
    assert run.exception() is None

    def check():
        item = ("content_id", "title", "content_type", "description", "addition_date", "is_hidden", "source_hash", "slug")
        assert plain(store.read("content"), *item) == plain(now["content"], *item)
        for table, columns in {
            "content_origin": ("content_id", "name", "origin_id", "alternate"), "tag": ("tag_id", "title", "category"),
            "tag_alias": ("tag_id", "title"), "tag_implication": ("target", "implicate"), "content_tag": ("content_id", "tag_id"),
        }.items():
            assert plain(store.read(table), *columns) == plain(now[table], *columns), table
        columns = ("task_id", "source_hash", "status", "rewrite")
        assert plain(store.read("task"), *columns) == plain(task, *columns)
        found = plain(store.read("task_result"), "task_id", "content_id", "source_file_size", "result_file_size")
        assert found == sorted(((r.task_id, r.content_id, r["size"], 0) for r in results), key=repr)
        assert plain(store.read("execution_error"), "task_id", "title") == sorted(((r.task_id, r.title) for r in errors), key=repr)
        assert store.read("task_status").count() == uploaded.count()

    check()
    streams.write_batch(cut(1), 1, store, DATE)  # as after a failure
    check()
    assert store.compact("content", 2, most=1) and store.compact("content_tag", 2, most=1)
    assert all(len(at) <= 2 for at in store.folders("content").values())
    check()


def test_a_batch_reads_only_buckets_it_asks_for(spark, inputs, tmp_path):
    store = Store(spark, str(tmp_path / "out"), 64)
    content = inputs.f_content.withColumn("slug", F.col("title"))
    store.seed({"content": content})
    assert plain(store.read("content"), "content_id") == plain(content, "content_id")
    few = content.filter("content_id < 3").select("source_hash")
    found = store.look_up("content", few)
    assert plain(found, "source_hash") == plain(few, "source_hash") and 0 < found.count() <= 3
    buckets = store.asked("content", few)
    read = store.read("content", None, buckets)
    assert {f"bucket={b}" for b in buckets} == {p for f in read.inputFiles() for p in f.split("/") if p.startswith("bucket=")}
    assert len(read.inputFiles()) <= 3 < len(store.read("content").inputFiles())
    # A batch writes what it changes, and nothing else of the buckets it touches.
    store.write("content", content.filter("content_id < 3").withColumn("title", F.lit("new")), 0)
    assert spark.read.parquet(str(tmp_path / "out/content")).filter("batch_id = 0").count() == few.count()
    assert store.read("content").filter("title = 'new'").count() == few.count()
    assert store.read("content", before=0).filter("title = 'new'").count() == 0
    store.write("content", few.join(content, "source_hash").select("source_hash", "content_id", F.lit(True).alias("_gone")), 1)
    for most in (99, 1):
        assert bool(store.compact("content", 2, most)) == (most == 1)
        assert store.read("content").count() == content.count() - few.count()


def test_stream_applies_rewrites(spark, inputs, tmp_path, narrow):
    pick = (F.col("task_id") % 30 == 5) & (F.col("mime_type") != "video/quicktime") & (F.col("size") > 0)
    first = uploads(inputs).filter(pick).withColumns({"origin_name": F.lit("derpibooru"), "origin_id": F.lit("")})
    again = first.withColumns(
        {
            "task_id": F.col("task_id") + 100000, "rewrite": F.lit(True), "content_type": F.lit("video"),
            "origin_name": F.lit("twitter"), "origin_id": F.concat(F.lit("t"), F.col("task_id").cast("string")),
        }
    )
    store = Store(spark, str(tmp_path / "out"), 8)
    store.seed(empty_base(inputs))
    streams.write_batch(first, 0, store, DATE)
    made = store.read("content")
    shapes = made.select("content_id", F.lit("a/b.webp").alias("filepath"), F.lit("webp").alias("format"))
    store.write("representation", shapes, 0)
    for _ in range(2):  # the second time as a replay
        streams.write_batch(again, 1, store, DATE, first.select("source_hash", F.lit(7).cast("long").alias("file_size")))
    n = made.count()
    assert n > 0 and store.read("representation").count() == 0 and store.read("representation", before=1).count() == n
    assert {r.content_type for r in store.read("content").collect()} == {"video"}
    found = {(r.name, r.alternate): r["count"] for r in store.read("content_origin").groupBy("name", "alternate").count().collect()}
    assert found == {("derpibooru", True): n, ("twitter", False): n}
    assert {r.content_type for r in store.read("content", before=1).collect()} == {"image"}
    assert {r.status for r in store.read("task_status").filter("task_id >= 100000").collect()} == {1}
    sizes = {r.result_file_size for r in store.read("task_result").filter("task_id >= 100000").collect()}
    assert sizes == {7} and store.read("task_result").count() == 2 * n


def test_stream_dedupe(spark, inputs, tmp_path):
    stream = file_stream(spark, inputs, str(tmp_path / "in"))
    run = (
        streams.dedupe(stream, "30 days").writeStream.format("memory").queryName("deduped")
        .option("checkpointLocation", str(tmp_path / "chk")).outputMode("append").trigger(availableNow=True).start()
    )
    run.awaitTermination(300)
    run.stop()
    kept = spark.table("deduped")
    assert kept.count() == uploads(inputs).select("source_hash").distinct().count()


def test_stream_dedupe_of_site_ids(spark, rows, tmp_path):
    """Different files of one (site, id) are one task; files without an id, or of another site, are not."""
    made = rows(
        "task_id long, source_hash string, origin_name string, origin_id string", (1, "a", "s", "7"), (2, "b", "s", "7"), (3, "c", "t", "7"),
        (4, "d", "s", ""), (5, "e", "s", ""), (6, "f", "", "7"), (7, "g", None, None), (8, "a", "u", "9"),
    ).withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    for n in range(2):
        made.filter(F.col("task_id") % 2 == 1 - n).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(made.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = (
        streams.dedupe(stream, "1 day").writeStream.format("memory").queryName("sites").trigger(availableNow=True)
        .option("checkpointLocation", str(tmp_path / "chk")).start()
    )
    run.awaitTermination(300)
    run.stop()
    assert sorted(r.task_id for r in spark.table("sites").collect()) == [1, 3, 4, 5, 6, 7]


def test_live_statuses_let_finished_tasks_go(spark, rows, tmp_path):
    day = lambda d: F.lit(f"2024-01-{d:02}").cast("timestamp")
    schema = "task_id long, status int, seq long"
    parts = [
        (1, [(t, 0, 1) for t in range(20)]), (2, [(t, 3, 2) for t in range(20)] + [(5, 0, 1)]), (3, [(t, 1 if t % 2 else 4, 3) for t in range(14)]),
        (20, [(99, 0, 1)]), (21, [(98, 0, 1)]), (22, [(15, 2, 9)]),
    ]
    events = [rows(schema, *data).withColumn("changed_at", day(d)) for d, data in parts]
    for e in events:
        e.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events[0].schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = []
    run = (
        streams.live_statuses(stream, "2 days").writeStream.outputMode("update").trigger(availableNow=True)
        .option("checkpointLocation", str(tmp_path / "chk"))
        .foreachBatch(lambda df, n: out.append((n, [tuple(r) for r in df.collect()]))).start()
    )
    run.awaitTermination(300)
    run.stop()
    assert run.exception() is None
    last = {t: s for _, changed in sorted(out, key=lambda x: x[0]) for t, s in changed}
    whole = events[0]
    for e in events[1:]:
        whole = whole.unionByName(e)
    assert last == {r.task_id: r.status for r in streams.status_log(whole).collect()}
    kept = [p.stateOperators[0].numRowsTotal for p in run.recentProgress if p.stateOperators]
    assert max(kept) >= 20 and kept[-1] == 20 - 14 + 2


def test_status_log(spark, inputs, tmp_path):
    log = inputs.events.select(
        (F.col("event_id") % 100).alias("task_id"), (F.col("event_id") % 5).alias("status"),
        F.col("ts").alias("changed_at"), F.col("event_id").alias("seq"),
    )
    folder = str(tmp_path / "log")
    log.repartition(3).write.parquet(folder)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    run = (
        streams.status_log(stream).writeStream.format("memory").queryName("statuses").outputMode("complete")
        .option("checkpointLocation", str(tmp_path / "chk")).trigger(availableNow=True).start()
    )
    run.awaitTermination(300)
    run.stop()
    expected = sorted(map(tuple, streams.status_log(log).collect()))
    assert sorted(map(tuple, spark.table("statuses").collect())) == expected
