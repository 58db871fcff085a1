"""Batch ingest: from uploaded files to catalog rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom import rules
from tagloom.functions import names
from tagloom.functions.levels import media_format_of_mime
from tagloom.functions.origins import normalise_origin_id
from tagloom.plans.positions import first_by, number_rows
from tagloom.session import settle


def has_origin() -> Column:
    return (F.coalesce("origin_name", F.lit("")) != "") & (F.coalesce("origin_id", F.lit("")) != "")


def validate_files(files: DataFrame) -> DataFrame:
    """Add ``reason``: null for a file that may be ingested."""
    fmt = media_format_of_mime("mime_type")
    refused = fmt.isNull() | fmt.isin(*rules.NOT_ACCEPTED_FORMATS)
    reason = F.when(F.coalesce("size", F.lit(0)) == 0, "The file cannot be empty").when(
        refused, F.concat(F.lit("File type "), F.coalesce("mime_type", F.lit("unknown")), F.lit(" not allowed"))
    )
    return files.withColumn("reason", reason)


def judge_files(files: DataFrame, content: DataFrame, redirect: DataFrame) -> DataFrame:
    """Add duplicate_of and status (admitted or duplicate) to files (source_hash, rewrite)."""
    here = content.select("source_hash", F.col("content_id").alias("_here"))
    merged = redirect.select("source_hash", F.col("new_content_id").alias("_merged"))
    target = F.when(~F.col("rewrite"), F.coalesce("_here", "_merged"))
    return files.join(here, "source_hash", "left").join(merged, "source_hash", "left").select(
        *files.columns, target.alias("duplicate_of"),
        F.when(target.isNull(), "admitted").otherwise("duplicate").alias("status"),
    )


def origins_of_duplicates(judged: DataFrame, origin: DataFrame) -> DataFrame:
    """(content_id, name, origin_id, alternate) given with duplicates, unless a site id is taken already."""
    given = judged.filter((F.col("status") == "duplicate") & has_origin())
    first = given.groupBy(F.col("origin_name").alias("name"), "origin_id").agg(
        F.min_by("duplicate_of", "file_id").alias("content_id")
    )
    return first.join(origin.select("name", "origin_id"), ["name", "origin_id"], "left_anti").select(
        "content_id", "name", "origin_id", F.lit(True).alias("alternate")
    )


def admit_files(
    files: DataFrame, content: DataFrame, redirect: DataFrame, origin: DataFrame
) -> dict[str, DataFrame]:
    """Turn away files the catalog has, under their own hash or a merged item's.

    ``files``: status admitted or duplicate, with the item a duplicate belongs to; a
    rewrite is always admitted. ``new_origin``: origins given with duplicates, as
    alternates of that item, unless a site id is taken already.
    """
    judged = judge_files(files, content, redirect)
    return {"files": judged, "new_origin": origins_of_duplicates(judged, origin)}


def validate_tasks(tasks: DataFrame) -> DataFrame:
    """Add ``reason``: null for a task that may stand.

    Of tasks with one hash the lower id counts as existing. A rewrite is only stopped
    by one that is not finished.
    """
    active = ~F.col("status").isin(rules.DONE, rules.DISCARDED)
    firsts = tasks.filter(F.col("source_hash").isNotNull()).groupBy("source_hash").agg(
        F.min("task_id").alias("_first"), F.min(F.when(active, F.col("task_id"))).alias("_active")
    )
    no_file = (F.col("status") != rules.DONE) & F.col("uploaded_file").isNull()
    reason = (
        F.when(no_file, "Temporary file can not be None until process is done")
        .when(~F.col("rewrite") & (F.col("_first") < F.col("task_id")), "Found task with same source_hash.")
        .when(
            F.col("rewrite") & (F.col("_active") < F.col("task_id")),
            "Cannot rewrite: active task with same source_hash exists.",
        )
    )
    return tasks.join(firsts, "source_hash", "left").select(*tasks.columns, reason.alias("reason"))


def normalise_metadata(tasks: DataFrame) -> DataFrame:
    """Origin ids given as addresses become ids of the site."""
    return tasks.withColumn("origin_id", normalise_origin_id("origin_name", "origin_id"))


def select_launch(tasks: DataFrame) -> DataFrame:
    """(task_id, decision) of waiting and failed tasks: launch or discard.

    One task per (site, id) is launched, the lowest; tasks without an origin always
    are. The first of each origin is found by an aggregate and joined back on the
    task id, so an origin that most tasks name does not end up in one partition.
    """
    pending = tasks.filter(F.col("status").isin(rules.AWAITING, rules.ERROR))
    first = pending.filter(has_origin()).groupBy("origin_name", "origin_id").agg(F.min("task_id").alias("task_id"))
    runs = first.select("task_id", F.lit(True).alias("_first"))
    launched = ~has_origin() | F.col("_first").isNotNull()
    return pending.join(runs, "task_id", "left").select(
        "task_id", F.when(launched, "launch").otherwise("discard").alias("decision")
    )


def route_tasks(tasks: DataFrame, content: DataFrame) -> DataFrame:
    """Add ``route`` and ``content_id``: rewriting where asked and the item exists."""
    here = content.select("source_hash", "content_id")
    rewriting = F.col("rewrite") & F.col("content_id").isNotNull()
    return tasks.join(here, "source_hash", "left").select(
        *tasks.columns, F.when(rewriting, F.col("content_id")).alias("content_id"),
        F.when(rewriting, "rewriting").otherwise("initial").alias("route"),
    )


def create_content(
    tasks: DataFrame, content: DataFrame, redirect: DataFrame, date: Column, top: int | None = None
) -> dict[str, DataFrame]:
    """New items of initial tasks (task_id, source_hash, content_type, title, description, file_name).

    A hash the catalog has, or an earlier task of the batch has, discards the task.
    Ids follow the highest one in task order; ``top`` names it where ``content`` is not the
    whole table. Returns ``content`` (with task_id) and ``discarded`` (task_id).
    """
    known = content.select("source_hash").unionByName(redirect.select("source_hash"))
    first = tasks.groupBy("source_hash").agg(F.min("task_id").alias("task_id")).join(
        known, "source_hash", "left_anti"
    )
    made = tasks.join(first.select("task_id"), "task_id", "left_semi").select(
        "task_id", "source_hash", "content_type",
        F.coalesce(F.nullif("title", F.lit("")), names.path_stem("file_name")).alias("title"),
        F.coalesce("description", F.lit("")).alias("description"),
    )
    numbered = number_rows(made, "_n", ["task_id"])
    highest = content.agg(F.coalesce(F.max("content_id"), F.lit(0)).alias("m")).scalar() if top is None else F.lit(top)
    created = numbered.select(
        (F.col("_n") + highest).alias("content_id"), "task_id", "title", "content_type", "description",
        date.alias("addition_date"), F.lit(False).alias("is_hidden"), "source_hash",
        names.content_slug(date, F.col("source_hash")).alias("slug"),
    )
    discarded = tasks.select("task_id").join(made.select("task_id"), "task_id", "left_anti")
    return {"content": created, "discarded": discarded}


def _last_rewrites(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("content_id").agg(
        first_by([F.col("task_id")], "content_type", "source_hash", last=True).alias("_t")
    )


def rewrite_content(
    tasks: DataFrame, content: DataFrame, image_hash: DataFrame, representation: DataFrame
) -> dict[str, DataFrame]:
    """Items after rewrites (task_id, content_id, content_type, source_hash).

    A rewrite sets the type and drops the signature and old renditions; a new hash also
    gives the item a new slug, and its old slug and hash become a redirect. Of several
    rewrites of an item the latest task counts.
    """
    last = _last_rewrites(tasks)
    joined = content.join(last, "content_id", "left")
    changed = F.col("_t").isNotNull() & (F.col("_t.source_hash") != F.col("source_hash"))
    slug = F.when(changed, names.content_slug("addition_date", "_t.source_hash")).otherwise(F.col("slug"))
    updated = joined.withColumns(
        {
            "slug": slug, "content_type": F.coalesce("_t.content_type", "content_type"),
            "source_hash": F.coalesce("_t.source_hash", "source_hash"),
        }
    ).select(*content.columns)
    redirects = joined.filter(changed).select(
        F.col("slug").alias("old_slug"), F.col("content_id").alias("new_content_id"),
        F.col("addition_date").alias("created_at"), "source_hash",
    )
    ids = last.select("content_id")
    return {
        "content": updated,
        "new_redirect": redirects,
        "image_hash": image_hash.join(ids, "content_id", "left_anti"),
        "representation": representation.join(ids, "content_id", "left_anti"),
    }


def _mains(tasks: DataFrame) -> DataFrame:
    """(content_id, _main): the origin that the latest rewrite of an item names."""
    rewrites = tasks.filter((F.col("route") == "rewriting") & (F.coalesce("origin_name", F.lit("")) != ""))
    return rewrites.select(
        "task_id", "content_id", F.col("origin_name").alias("name"), F.coalesce("origin_id", F.lit("")).alias("origin_id")
    ).groupBy("content_id").agg(first_by([F.col("task_id")], "name", "origin_id", last=True).alias("_main"))


def _is_main() -> Column:
    return (F.col("_main.name") == F.col("name")) & (F.col("_main.origin_id") == F.col("origin_id"))


def origin_changes(tasks: DataFrame, origin: DataFrame) -> dict[str, DataFrame]:
    """What tasks (task_id, content_id, origin_name, origin_id, route) change in the origins.

    ``added``: new rows; any origin with a name counts, with or without an id. An id of a
    site belongs to one item: to the one that has it, else to the first task that names it.
    ``marked``: rows there are of rewritten items, with ``alternate`` as it is now.
    """
    mains = _mains(tasks)
    initial = tasks.filter((F.col("route") != "rewriting") & (F.coalesce("origin_name", F.lit("")) != ""))
    wanted = initial.select(
        "task_id", "content_id", F.col("origin_name").alias("name"), F.coalesce("origin_id", F.lit("")).alias("origin_id")
    ).unionByName(mains.select(F.lit(0).cast("long").alias("task_id"), "content_id", "_main.name", "_main.origin_id"))
    with_id = wanted.filter(F.col("origin_id") != "").groupBy("name", "origin_id").agg(
        F.min_by("content_id", F.struct("task_id", "content_id")).alias("content_id")
    ).join(origin.select("name", "origin_id"), ["name", "origin_id"], "left_anti")
    without_id = wanted.filter(F.col("origin_id") == "").select("content_id", "name", "origin_id").distinct().join(
        origin.select("content_id", "name", "origin_id"), ["content_id", "name", "origin_id"], "left_anti"
    )
    added = with_id.select("content_id", "name", "origin_id").unionByName(without_id)
    marked = origin.select("content_id", "name", "origin_id").join(mains, "content_id").select(
        "content_id", "name", "origin_id", (~_is_main()).alias("alternate")
    )
    return {"added": added.withColumn("alternate", F.lit(False)), "marked": marked}


def manage_origins(tasks: DataFrame, origin: DataFrame) -> DataFrame:
    """Origins after tasks (task_id, content_id, origin_name, origin_id, route).

    An initial task adds its origin. A rewrite makes its origin the main one and all
    others of the item alternates. A site id belongs to one item: one that is taken by
    another item is not added.
    """
    columns = ["content_id", "name", "origin_id", "alternate"]
    kept = origin.select(*columns).join(_mains(tasks), "content_id", "left").withColumn(
        "alternate", F.when(F.col("_main").isNull(), F.col("alternate")).otherwise(~_is_main())
    )
    return kept.select(*columns).unionByName(origin_changes(tasks, origin)["added"])


def task_results(tasks: DataFrame, renditions: DataFrame) -> dict[str, DataFrame]:
    """Results of finished tasks (task_id, content_id, source_file_size) and their task rows.

    ``renditions``: content_id, file_size.
    """
    sizes = renditions.groupBy("content_id").agg(F.sum("file_size").alias("result_file_size"))
    results = tasks.join(sizes, "content_id", "left").select(
        "task_id", "content_id", "source_file_size",
        F.coalesce("result_file_size", F.lit(0)).cast("long").alias("result_file_size"),
    )
    done = tasks.select(
        "task_id", F.lit(rules.DONE).alias("status"), F.lit(None).cast("string").alias("uploaded_file")
    )
    return {"task_result": results, "task": done}


def task_errors(outcomes: DataFrame) -> dict[str, DataFrame]:
    """Error rows and statuses of tasks (task_id, outcome, error_type, message, details).

    Outcome failed leaves the task in error with its file; discarded clears file and
    metadata.
    """
    failed = outcomes.filter(F.col("outcome") == "failed")
    errors = failed.select(
        "task_id", F.concat_ws(": ", "error_type", F.coalesce("message", F.lit(""))).alias("title"),
        F.coalesce("details", F.lit("")).alias("details"),
    )
    statuses = outcomes.select(
        "task_id",
        F.when(F.col("outcome") == "failed", rules.ERROR)
        .when(F.col("outcome") == "discarded", rules.DISCARDED).otherwise(rules.DONE).alias("status"),
        (F.col("outcome") == "failed").alias("keeps_file"), (F.col("outcome") == "failed").alias("keeps_metadata"),
    )
    return {"execution_error": errors, "task": statuses}


def origin_lookup(requests: DataFrame, origin: DataFrame, content: DataFrame) -> DataFrame:
    """Add status, content_id and slug to requests (name, origin_id)."""
    missing = (F.coalesce("name", F.lit("")) == "") | (F.coalesce("origin_id", F.lit("")) == "")
    known = origin.groupBy("name", "origin_id").agg(F.min("content_id").alias("content_id"))
    found = requests.join(known, ["name", "origin_id"], "left").join(
        content.select("content_id", "slug"), "content_id", "left"
    )
    status = F.when(missing, "error").when(F.col("content_id").isNull(), "not found").otherwise("found")
    hit = status == "found"
    return found.select(
        *requests.columns, status.alias("status"), F.when(hit, F.col("content_id")).alias("content_id"),
        F.when(hit, F.col("slug")).alias("slug"),
    )


def ingest_batch(
    tasks: DataFrame, catalog: dict[str, DataFrame], date: Column, earlier: DataFrame | None = None, top: int | None = None
) -> dict[str, DataFrame]:
    """What one batch of uploads changes in the catalog.

    ``tasks``: task_id, source_hash, mime_type, size, file_name, content_type, title,
    description, origin_name, origin_id, rewrite. ``catalog``: content, content_redirect,
    content_origin; rows that share no hash, item or site id with the batch may be left out
    if ``top`` is the highest content_id. With ``earlier`` (task_id, source_hash, status,
    rewrite), tasks also have to stand beside those of their hash, and one per (site, id)
    is launched. Returns

    - ``content`` and ``content_origin``: new rows;
    - ``rewritten``: items that a task rewrote, as they are now. Rewrites are found by hash, so
      slug and hash stay; signatures and renditions of these items are out of date;
    - ``origin_marks``: origins of those items with their new ``alternate``;
    - ``landed``: (task_id, content_id) of the tasks that are done;
    - ``execution_error`` rows, and the ``task_status`` every task ends with;
    - ``refused``: (task_id) of uploads that never became tasks.
    """
    checked = validate_files(normalise_metadata(tasks))
    bad = checked.filter(F.col("reason").isNotNull()).select("task_id", "reason")
    good = checked.filter(F.col("reason").isNull()).drop("reason").withColumn("file_id", F.col("task_id"))
    # Everything below starts from the judged files: looked up in the catalog once.
    files = settle(judge_files(good, catalog["content"], catalog["content_redirect"]))
    admitted = files.filter(F.col("status") == "admitted").drop("status")
    put_off = None
    if earlier is not None:
        admitted, wrong, put_off = _launched(admitted, earlier)
        bad = bad.unionByName(wrong)
    routed = settle(route_tasks(admitted, catalog["content"]))
    initial, rewrites = (routed.filter(F.col("route") == r) for r in ("initial", "rewriting"))
    made = create_content(initial.drop("content_id"), catalog["content"], catalog["content_redirect"], date, top)
    created = made["content"]
    rewritten = catalog["content"].join(_last_rewrites(rewrites), "content_id").withColumn(
        "content_type", F.coalesce("_t.content_type", "content_type")
    )
    landed = initial.drop("content_id").join(created.select("task_id", "content_id"), "task_id").unionByName(rewrites)
    origins = origin_changes(landed, catalog["content_origin"])
    from_duplicates = origins_of_duplicates(files, catalog["content_origin"]).join(
        origins["added"].select("name", "origin_id"), ["name", "origin_id"], "left_anti"
    )

    def outcome(rows: DataFrame, name: str, message: Column | None = None) -> DataFrame:
        failed = message is not None
        return rows.select(
            "task_id", F.lit(name).alias("outcome"),
            F.lit("ValidationError" if failed else None).cast("string").alias("error_type"),
            (message if failed else F.lit(None).cast("string")).alias("message"), F.lit("").alias("details"),
        )

    duplicates = files.filter(F.col("status") == "duplicate")
    discarded = made["discarded"] if put_off is None else made["discarded"].unionByName(put_off)
    ended = task_errors(
        outcome(bad, "failed", F.col("reason"))
        .unionByName(outcome(duplicates, "failed", F.lit("Duplicate file found (original or merged)")))
        .unionByName(outcome(discarded, "discarded"))
        .unionByName(outcome(created, "done"))
        .unionByName(outcome(rewrites, "done"))
    )
    return {
        "content": created.drop("task_id"),
        "rewritten": rewritten.select(*catalog["content"].columns),
        "content_origin": origins["added"].select("content_id", "name", "origin_id", "alternate").unionByName(
            from_duplicates.select("content_id", "name", "origin_id", "alternate")
        ),
        "origin_marks": origins["marked"],
        "landed": landed.select("task_id", "content_id"),
        "execution_error": ended["execution_error"],
        "task_status": ended["task"].select("task_id", "status"),
        "refused": bad.select("task_id").unionByName(duplicates.select("task_id")),
    }


def _launched(files: DataFrame, earlier: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(launched files, (task_id, reason) of tasks that may not stand, (task_id) of tasks set aside)."""
    columns = ["task_id", "source_hash", "status", "rewrite", "uploaded_file"]
    new = files.select(
        "task_id", "source_hash", F.lit(rules.AWAITING).alias("status"), "rewrite", F.col("file_name").alias("uploaded_file")
    )
    before = earlier.join(new.select("task_id"), "task_id", "left_anti").select(
        "task_id", "source_hash", "status", "rewrite", F.lit("").alias("uploaded_file")
    )
    judged = validate_tasks(new.unionByName(before).select(*columns)).join(new.select("task_id"), "task_id", "left_semi")
    judged = settle(judged.select("task_id", "reason"))
    standing = files.join(judged.filter(F.col("reason").isNull()).select("task_id"), "task_id", "left_semi")
    decided = settle(select_launch(standing.withColumn("status", F.lit(rules.AWAITING))))
    chosen = lambda d: decided.filter(F.col("decision") == d).select("task_id")
    return standing.join(chosen("launch"), "task_id", "left_semi"), judged.filter(F.col("reason").isNotNull()), chosen("discard")
