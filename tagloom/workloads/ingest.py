"""Ingest and reports over the views."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom import rules
from tagloom.fixtures import Inputs
from tagloom.functions import hashing
from tagloom.operators import ingest, reports, tags
from tagloom.session import settle
from tagloom.workloads.registry import query
from tagloom.workloads.scalars import case, size_sql
from tagloom.workloads.tags import closure_cte


@query(
    "validate_files",
    """select file_id, case when size = 0 then 'The file cannot be empty' when mime_type = 'video/quicktime' then 'File type video/quicktime not allowed' end as reason
       from (select file_id, mime_type, case when file_id % 29 = 0 then 0 else size end as size from f_file)""",
)
def validate_files(i: Inputs):
    files = i.f_file.withColumn("size", F.when(F.col("file_id") % 29 == 0, 0).otherwise(F.col("size")))
    return ingest.validate_files(files).select("file_id", "reason")


def known_content(i: Inputs):
    """A catalog that already holds every third document."""
    return i.f_file.filter("file_id % 3 = 0").groupBy("source_hash").agg(F.min("file_id").alias("content_id"))


def known_redirect(i: Inputs):
    return i.f_file.filter("file_id % 3 = 1 and file_id % 4 = 1").groupBy("source_hash").agg(
        (F.min("file_id") + 5000000).alias("new_content_id")
    )


KNOWN = """kc as (select source_hash, min(file_id) as content_id from f_file where file_id % 3 = 0 group by source_hash),
    kr as (select source_hash, min(file_id) + 5000000 as new_content_id from f_file where file_id % 3 = 1 and file_id % 4 = 1 group by source_hash),
    j as (select f.*, case when not rewrite then coalesce(kc.content_id, kr.new_content_id) end as duplicate_of from f_file f
      left join kc on kc.source_hash = f.source_hash left join kr on kr.source_hash = f.source_hash)"""


@query(
    "admit_files",
    f"with {KNOWN} select file_id, duplicate_of, case when duplicate_of is null then 'admitted' else 'duplicate' end as status from j",
)
def admit_files(i: Inputs):
    made = ingest.admit_files(i.f_file, known_content(i), known_redirect(i), i.f_origin)
    return made["files"].select("file_id", "duplicate_of", "status")


@query(
    "admit_origins",
    f"""with {KNOWN} select arg_min(duplicate_of, file_id) as content_id, origin_name as name, origin_id, true as alternate from j
        where duplicate_of is not null and origin_name <> '' and origin_id not in ('d0', 'd9', 'd33') group by origin_name, origin_id""",
)
def admit_origins(i: Inputs):
    taken = i.f_file.filter("origin_id in ('d0', 'd9', 'd33')").select(
        F.col("file_id").alias("content_id"), F.lit("derpibooru").alias("name"), "origin_id", F.lit(False).alias("alternate")
    )
    return ingest.admit_files(i.f_file, known_content(i), known_redirect(i), taken)["new_origin"]


@query(
    "validate_tasks",
    """with t as (select *, case when task_id % 31 = 0 then null else uploaded_file end as file from (select * replace (
                    case when task_id % 3 = 0 then unhex(sha256('shared')) else source_hash end as source_hash) from f_task)),
         f as (select source_hash, min(task_id) as a, min(task_id) filter (where status not in (1, 4)) as b from t group by source_hash)
       select task_id, case when status <> 1 and file is null then 'Temporary file can not be None until process is done'
         when not rewrite and a < task_id then 'Found task with same source_hash.'
         when rewrite and b < task_id then 'Cannot rewrite: active task with same source_hash exists.' end as reason
       from t join f on f.source_hash = t.source_hash""",
)
def validate_tasks(i: Inputs):
    tasks = i.f_task.withColumns(
        {
            "uploaded_file": F.when(F.col("task_id") % 31 != 0, F.col("uploaded_file")),
            # A third of all tasks share one hash.
            "source_hash": F.when(F.col("task_id") % 3 == 0, F.unhex(F.sha2(F.lit("shared"), 256)))
            .otherwise(F.col("source_hash")),
        }
    )
    return ingest.validate_tasks(tasks).select("task_id", "reason")


@query(
    "validate_tasks_wide",
    """with f as (select source_hash, min(task_id) as a, min(task_id) filter (where status not in (1, 4)) as b from f_task_wide group by source_hash)
       select task_id, case when not rewrite and a < task_id then 'Found task with same source_hash.'
         when rewrite and b < task_id then 'Cannot rewrite: active task with same source_hash exists.' end as reason
       from f_task_wide t join f on f.source_hash = t.source_hash""",
)
def validate_tasks_wide(i: Inputs):
    """Hashes in proportion to the tasks: five of each."""
    return ingest.validate_tasks(i.f_task_wide).select("task_id", "reason")


@query(
    "select_launch",
    """with p as (select * from f_task where status in (0, 2)),
         f as (select min(task_id) as task_id from p where origin_id <> '' group by origin_name, origin_id)
       select task_id, case when origin_id = '' or task_id in (select task_id from f) then 'launch' else 'discard' end as decision from p""",
)
def select_launch(i: Inputs):
    return ingest.select_launch(i.f_task)


@query(
    "route_tasks",
    """with t as (select event_id as task_id, value > 20 as rewrite, unhex(sha256(cast(case when event_id % 3 = 0 then -event_id else event_id end as varchar))) as source_hash from events)
       select task_id, case when rewrite then c.content_id end as content_id, case when rewrite and c.content_id is not null then 'rewriting' else 'initial' end as route
       from t left join f_content c on c.source_hash = t.source_hash""",
)
def route_tasks(i: Inputs):
    return ingest.route_tasks(upload_tasks(i), i.f_content).select("task_id", "content_id", "route")


def upload_tasks(i: Inputs):
    number = F.when(F.col("event_id") % 3 == 0, -F.col("event_id")).otherwise(F.col("event_id"))
    return i.events.select(
        F.col("event_id").alias("task_id"), (F.col("value") > 20).alias("rewrite"),
        F.unhex(F.sha2(number.cast("string"), 256)).alias("source_hash"),
    )


NEW_TASKS = """select event_id as task_id, unhex(sha256('n' || cast(event_id // 7 as varchar))) as source_hash, event_type as content_type,
    case when event_id % 2 = 0 then 'Titled ' || event_id else '' end as title, 'dir/name.' || event_id || '.png' as file_name from events"""


@query(
    "create_content",
    f"""with t as ({NEW_TASKS}), known as (select unhex(sha256('n' || cast(p_partkey * 5 as varchar))) as h from part),
        f as (select source_hash, min(task_id) as task_id from t where source_hash not in (select h from known) group by source_hash)
        select (select max(o_orderkey) from orders) + row_number() over (order by t.task_id) as content_id, t.task_id,
          case when title = '' then 'name.' || t.task_id else title end as title, content_type, lower(hex(t.source_hash)) as source_hash,
          '2026-03-04-' || lower(hex(t.source_hash)) as slug from t join f on f.task_id = t.task_id""",
)
def create_content(i: Inputs):
    made = ingest.create_content(new_tasks(i), i.f_content, known_parts(i), F.lit("2026-03-04").cast("timestamp_ntz"))
    rows = made["content"]
    return rows.select("content_id", "task_id", "title", "content_type", hashing.hex_text("source_hash").alias("source_hash"), "slug")


def new_tasks(i: Inputs):
    key = F.col("event_id")
    return i.events.select(
        key.alias("task_id"),
        F.unhex(F.sha2(F.concat(F.lit("n"), F.floor(key / 7).cast("string")), 256)).alias("source_hash"),
        F.col("event_type").alias("content_type"), F.lit("").alias("description"),
        F.when(key % 2 == 0, F.concat(F.lit("Titled "), key.cast("string"))).otherwise("").alias("title"),
        F.concat(F.lit("dir/name."), key.cast("string"), F.lit(".png")).alias("file_name"),
    )


def known_parts(i: Inputs):
    return i.part.select(
        F.unhex(F.sha2(F.concat(F.lit("n"), (F.col("p_partkey") * 5).cast("string")), 256)).alias("source_hash")
    )


@query(
    "create_discards",
    f"""with t as ({NEW_TASKS}), known as (select unhex(sha256('n' || cast(p_partkey * 5 as varchar))) as h from part),
        f as (select source_hash, min(task_id) as task_id from t where source_hash not in (select h from known) group by source_hash)
        select task_id from t where task_id not in (select task_id from f)""",
)
def create_discards(i: Inputs):
    return ingest.create_content(new_tasks(i), i.f_content, known_parts(i), F.lit("2026-03-04").cast("timestamp_ntz"))["discarded"]


REWRITES = """select event_id as task_id, event_id // 4 as content_id, 'audio' as content_type,
    unhex(sha256(cast((event_id // 4) + case when (event_id // 4) % 2 = 0 then 0 else 7000000000 end as varchar))) as source_hash from events"""


def rewrites(i: Inputs):
    item = F.floor(F.col("event_id") / 4)
    return i.events.select(
        F.col("event_id").alias("task_id"), item.alias("content_id"), F.lit("audio").alias("content_type"),
        F.unhex(F.sha2((item + F.when(item % 2 == 0, 0).otherwise(7000000000)).cast("string"), 256)).alias("source_hash"),
    )


@query(
    "rewrite_content",
    f"""with r as (select content_id, any_value(content_type) as content_type, any_value(source_hash) as h from ({REWRITES}) group by content_id)
        select c.content_id, coalesce(r.content_type, c.content_type) as content_type, case when r.h <> c.source_hash then strftime(addition_date, '%Y-%m-%d') || '-' || lower(hex(r.h)) else slug end as slug,
          lower(hex(coalesce(r.h, c.source_hash))) as source_hash from f_content c left join r on r.content_id = c.content_id""",
)
def rewrite_content(i: Inputs):
    made = ingest.rewrite_content(rewrites(i), i.f_content, i.f_imagehash, i.f_representation)["content"]
    return made.select("content_id", "content_type", "slug", hashing.hex_text("source_hash").alias("source_hash"))


@query(
    "rewrite_redirects",
    f"""with r as (select content_id, any_value(source_hash) as h from ({REWRITES}) group by content_id)
        select slug as old_slug, c.content_id as new_content_id, addition_date as created_at, lower(hex(c.source_hash)) as source_hash
        from f_content c join r on r.content_id = c.content_id where r.h <> c.source_hash""",
)
def rewrite_redirects(i: Inputs):
    made = ingest.rewrite_content(rewrites(i), i.f_content, i.f_imagehash, i.f_representation)["new_redirect"]
    return made.withColumn("source_hash", hashing.hex_text("source_hash"))


@query(
    "manage_origins",
    """with t as (select event_id as task_id, (event_id // 4) + case when event_id % 2 = 0 then 0 else 8000000000 end as content_id,
                    case when event_id % 10 < 2 then 'derpibooru' when event_id % 7 = 3 then '' else 'e621' end as name,
                    case when event_id % 10 < 2 then cast((event_id // 4) * 7 as varchar) when event_id % 11 = 0 then '' else 'e' || (event_id // 30) end as origin_id,
                    event_id % 2 = 0 as rewriting from events),
         n as (select * from t where name <> ''),
         r as (select content_id, arg_max(name, task_id) as name, arg_max(origin_id, task_id) as origin_id from n where rewriting group by content_id),
         kept as (select o.content_id, o.name, o.origin_id, case when r.content_id is null then alternate else not (o.name = r.name and o.origin_id = r.origin_id) end as alternate
                  from f_origin o left join r on r.content_id = o.content_id),
         w as (select task_id, content_id, name, origin_id from n where not rewriting union all select 0, content_id, name, origin_id from r),
         a as (select arg_min(content_id, (task_id, content_id)) as content_id, name, origin_id from w where origin_id <> '' group by name, origin_id),
         b as (select distinct content_id, name, origin_id from w where origin_id = '')
       select * from kept
       union all select content_id, name, origin_id, false from a where not exists (select 1 from f_origin o where o.name = a.name and o.origin_id = a.origin_id)
       union all select content_id, name, origin_id, false from b where not exists (select 1 from f_origin o where o.content_id = b.content_id and o.name = b.name and o.origin_id = '')""",
)
def manage_origins(i: Inputs):
    key = F.col("event_id")
    rewriting = key % 2 == 0
    tasks = i.events.select(
        key.alias("task_id"), (F.floor(key / 4) + F.when(rewriting, 0).otherwise(8000000000)).alias("content_id"),
        F.when(key % 10 < 2, "derpibooru").when(key % 7 == 3, "").otherwise("e621").alias("origin_name"),
        F.when(key % 10 < 2, (F.floor(key / 4) * 7).cast("string")).when(key % 11 == 0, "")
        .otherwise(F.concat(F.lit("e"), F.floor(key / 30).cast("string"))).alias("origin_id"),
        F.when(rewriting, "rewriting").otherwise("initial").alias("route"),
    )
    return ingest.manage_origins(tasks, i.f_origin)


@query(
    "task_results",
    """select c.content_id + 1 as task_id, c.content_id, c.content_id * 3 as source_file_size, coalesce(s.n, 0)::bigint as result_file_size from f_content c
       left join (select content_id, sum(width::bigint * height) as n from f_representation group by content_id) s on s.content_id = c.content_id""",
)
def task_results(i: Inputs):
    tasks = i.f_content.select(
        (F.col("content_id") + 1).alias("task_id"), "content_id", (F.col("content_id") * 3).alias("source_file_size")
    )
    sizes = i.f_representation.select("content_id", (F.col("width").cast("long") * F.col("height")).alias("file_size"))
    return ingest.task_results(tasks, sizes)["task_result"]


OUTCOME = "case when event_id % 5 = 0 then 'failed' when event_id % 5 = 1 then 'discarded' else 'done' end"


def outcomes(i: Inputs):
    fifth = F.col("event_id") % 5
    return i.events.select(
        F.col("event_id").alias("task_id"),
        F.when(fifth == 0, "failed").when(fifth == 1, "discarded").otherwise("done").alias("outcome"),
        F.lit("ValueError").alias("error_type"), F.col("event_type").alias("message"), F.col("props").alias("details"),
    )


@query(
    "task_errors",
    f"select event_id as task_id, 'ValueError: ' || event_type as title, props as details from events where {OUTCOME} = 'failed'",
)
def task_errors(i: Inputs):
    return ingest.task_errors(outcomes(i))["execution_error"]


@query(
    "task_outcomes",
    f"""select event_id as task_id, case {OUTCOME} when 'failed' then 2 when 'discarded' then 4 else 1 end as status, {OUTCOME} = 'failed' as keeps_file,
          {OUTCOME} = 'failed' as keeps_metadata from events""",
)
def task_outcomes(i: Inputs):
    return ingest.task_errors(outcomes(i))["task"]


@query(
    "origin_lookup",
    """with r as (select event_id, case when event_id % 7 = 0 then '' else 'derpibooru' end as name, cast(event_id * 7 as varchar) as origin_id from events)
       select event_id, r.name, r.origin_id, case when r.name = '' then 'error' when o.content_id is null then 'not found' else 'found' end as status,
         case when r.name <> '' then o.content_id end as content_id, case when r.name <> '' then c.slug end as slug
       from r left join f_origin o on o.name = r.name and o.origin_id = r.origin_id left join f_content c on c.content_id = o.content_id""",
)
def origin_lookup(i: Inputs):
    asked = i.events.select(
        "event_id", F.when(F.col("event_id") % 7 == 0, "").otherwise("derpibooru").alias("name"),
        (F.col("event_id") * 7).cast("string").alias("origin_id"),
    )
    return ingest.origin_lookup(asked, i.f_origin, i.f_content)


def batch_tasks(i: Inputs):
    return i.f_file.select(
        F.col("file_id").alias("task_id"), "source_hash", "mime_type", "size", F.col("name").alias("file_name"),
        F.lit("image").alias("content_type"), F.lit("").alias("title"), F.lit("").alias("description"),
        F.when(F.col("file_id") % 4 < 2, "derpibooru").otherwise("").alias("origin_name"),
        F.when(F.col("file_id") % 5 == 0, "").otherwise(F.col("origin_id")).alias("origin_id"), "rewrite",
    )


BATCH = f"""with {KNOWN}, g as (select * from j where mime_type <> 'video/quicktime' and size > 0),
    rt as (select g.*, case when g.rewrite and kc.content_id is not null then true else false end as rewriting from g left join kc on kc.source_hash = g.source_hash
           where duplicate_of is null),
    f as (select source_hash, min(file_id) as file_id from rt where not rewriting and source_hash not in (select source_hash from kc) and source_hash not in (select source_hash from kr) group by source_hash)"""


@query(
    "ingest_batch",
    f"""{BATCH} select file_id as task_id, case when mime_type = 'video/quicktime' or size = 0 or duplicate_of is not null then 2
          when file_id in (select file_id from rt where rewriting) or file_id in (select file_id from f) then 1 else 4 end as status from j""",
)
def ingest_batch(i: Inputs):
    return whole_batch(i)["task_status"]


def batch_catalog(i: Inputs):
    known = known_content(i)
    content = known.select(
        "content_id", "source_hash", F.lit("video").alias("content_type"),
        F.concat(F.lit("item-"), F.col("content_id").cast("string")).alias("slug"),
    )
    origins = [
        F.struct(F.lit(name).alias("name"), F.concat(F.lit(mark), F.col("content_id").cast("string")).alias("origin_id"))
        for name, mark in (("derpibooru", "d"), ("twitter", "t"))
    ]
    origin = known.select("content_id", F.inline(F.array(*origins))).withColumn("alternate", F.col("name") == "derpibooru")
    return {"content": content, "content_redirect": known_redirect(i), "content_origin": origin}


def whole_batch(i: Inputs):
    return ingest.ingest_batch(batch_tasks(i), batch_catalog(i), F.lit("2026-03-04").cast("timestamp_ntz"))


ORIGINS = f"""{BATCH}, b as (select file_id, case when file_id % 4 < 2 then 'derpibooru' else '' end as site,
      case when file_id % 5 = 0 then '' else origin_id end as oid from f_file),
    made as (select (select max(content_id) from kc) + row_number() over (order by file_id) as content_id, file_id from rt where file_id in (select file_id from f)),
    rw as (select kc.content_id, max(rt.file_id) as file_id from rt join kc on kc.source_hash = rt.source_hash join b on b.file_id = rt.file_id
           where rewriting and site <> '' group by kc.content_id),
    ko as (select content_id, 'derpibooru' as name, 'd' || content_id as origin_id from kc union all select content_id, 'twitter', 't' || content_id from kc),
    added as (select content_id, site as name, oid as origin_id, false as alternate from (select * from made union all select content_id, file_id from rw) join b using (file_id) where site <> ''
      union all select duplicate_of, site, oid, true from g join b on b.file_id = g.file_id where duplicate_of is not null and site <> '' and oid <> '')"""


@query("ingest_origins", f"{ORIGINS} select * from added where not exists (select 1 from ko where ko.name = added.name and ko.origin_id = added.origin_id)")
def ingest_origins(i: Inputs):
    return whole_batch(i)["content_origin"]


@query(
    "ingest_marks",
    f"""{ORIGINS} select ko.content_id, ko.name, ko.origin_id, not (ko.name = site and ko.origin_id = oid) as alternate
        from ko join rw on rw.content_id = ko.content_id join b on b.file_id = rw.file_id""",
)
def ingest_marks(i: Inputs):
    return whole_batch(i)["origin_marks"]


@query(
    "ingest_rewritten",
    f"""{BATCH} select content_id, lower(hex(source_hash)) as source_hash, 'image' as content_type, 'item-' || content_id as slug
        from kc where source_hash in (select source_hash from rt where rewriting)""",
)
def ingest_rewritten(i: Inputs):
    return whole_batch(i)["rewritten"].withColumn("source_hash", hashing.hex_text("source_hash"))


@query(
    "ingest_errors",
    f"""{BATCH} select file_id as task_id, 'ValidationError: ' || case when size = 0 then 'The file cannot be empty'
          when mime_type = 'video/quicktime' then 'File type video/quicktime not allowed' else 'Duplicate file found (original or merged)' end as title, '' as details
        from j where size = 0 or mime_type = 'video/quicktime' or duplicate_of is not null""",
)
def ingest_errors(i: Inputs):
    return whole_batch(i)["execution_error"]


@query(
    "ingest_content",
    f"""{BATCH} select (select max(content_id) from kc) + row_number() over (order by file_id) as content_id, regexp_replace(split_part(name, '/', 2), '\\.dat$', '') as title,
          lower(hex(source_hash)) as source_hash from rt where file_id in (select file_id from f)""",
)
def ingest_content(i: Inputs):
    return whole_batch(i)["content"].select("content_id", "title", hashing.hex_text("source_hash").alias("source_hash"))


def landed(i: Inputs):
    """The tasks of the batch that are done, with the sizes of their files."""
    files = i.f_file.select(F.col("file_id").alias("task_id"), "size", "source_hash", "name")
    return whole_batch(i)["landed"].join(files, "task_id")


LANDED = "l as (select file_id, source_hash, size, name from rt where rewriting or file_id in (select file_id from f))"


@query(
    "ingest_results",
    f"""{BATCH}, {LANDED} select file_id as task_id, size as source_file_size, 2 * size + size % 97 as result_file_size from l""",
)
def ingest_results(i: Inputs):
    """Two renditions of every file that became an item."""
    done = landed(i)
    two = F.explode(F.array(F.col("size") * 2, F.col("size") % 97)).alias("file_size")
    renditions = done.dropDuplicates(["content_id"]).select("content_id", two)
    results = ingest.task_results(done.withColumnRenamed("size", "source_file_size"), renditions)["task_result"]
    return results.drop("content_id")


FILE_STYLES = "case file_id % 4 when 0 then 'red' when 1 then 'Soft_Glow' when 2 then 'BLUE' else 'soft glow' end"


@query(
    "ingest_tags",
    # Artists bring a creator of the same title; known styles bring what they imply.
    f"""{BATCH.replace("with ", "with recursive ", 1)}, {LANDED}, {closure_cte('f_tag_edge')},
        w as (select file_id, trim(replace(lower({FILE_STYLES}), '_', ' ')) as style, split_part(name, '/', 1) as maker from l),
        s as (select file_id, t.tag_id, w.style from w left join f_tag t on t.title = w.style and t.category = 'style'),
        x as (select file_id, style as title, 'style' as category from s
          union select file_id, title, category from s join closure on target = tag_id join f_tag t on t.tag_id = implicate
          union select file_id, trim(replace(lower(maker), '_', ' ')), unnest(['artist', 'creator']) from w)
        select distinct coalesce(kc.content_id, 0) as content_id, case when kc.content_id is null then l.file_id else 0 end as task_id, title, category
        from x join l on l.file_id = x.file_id left join kc on kc.source_hash = l.source_hash""",
)
def ingest_tags(i: Inputs):
    """New tags of items by item where they were rewritten, by task where they are new."""
    done = settle(landed(i))
    style = F.expr(FILE_STYLES.replace("file_id", "task_id"))
    given = done.select(
        "content_id", F.create_map(F.lit("style"), F.array(style), F.lit("artist"), F.array(F.split_part("name", F.lit("/"), F.lit(1)))).alias("tags")
    )
    seq = F.struct("content_id", "category", "name")
    wanted = tags.tags_from_metadata(given).withColumn("seq", seq)
    now = tags.attach_tags(wanted, i.f_content_tag.limit(0), i.f_tag, i.f_alias, i.f_tag_edge)
    new = known_content(i).select("content_id", F.lit(True).alias("old"))
    return (
        now["added"].join(now["tag"], "tag_id").join(done.groupBy("content_id").agg(F.min("task_id").alias("task_id")), "content_id")
        .join(new, "content_id", "left").select(
            F.when(F.col("old"), F.col("content_id")).otherwise(0).alias("content_id"),
            F.when(F.col("old"), 0).otherwise(F.col("task_id")).alias("task_id"), "title", "category",
        )
    )


@query(
    "ingest_launched",
    f"""{BATCH}, adm as (select j.*, case when file_id % 4 < 2 then 'derpibooru' else '' end as site,
            case when file_id % 5 = 0 then '' else 'd' || cast(file_id % 50 as varchar) end as oid, kc.content_id as here
          from j left join kc on kc.source_hash = j.source_hash where mime_type <> 'video/quicktime' and size > 0 and duplicate_of is null),
        al as (select file_id as id, source_hash, true as active from adm
          union all select -file_id, source_hash, file_id % 2 = 1 from f_file where file_id % 13 = 0),
        mn as (select source_hash, min(id) as a, min(id) filter (where active) as b from al group by source_hash),
        st as (select adm.*, (not rewrite and a < file_id) or (rewrite and coalesce(b < file_id, false)) as refused from adm join mn using (source_hash)),
        la as (select *, site <> '' and oid <> '' and min(file_id) over (partition by site, oid) < file_id as later from st where not refused)
        select j.file_id as task_id, case when la.file_id is null then 2 when later then 4
            when (la.rewrite and here is not null) or (la.source_hash not in (select source_hash from kc) and la.source_hash not in (select source_hash from kr)) then 1 else 4 end as status
        from j left join la on la.file_id = j.file_id""",
)
def ingest_launched(i: Inputs):
    """The batch beside tasks there are already, with several tasks for one site id."""
    n = F.col("task_id")
    tasks = batch_tasks(i).withColumn("origin_id", F.when(n % 5 == 0, "").otherwise(F.concat(F.lit("d"), (n % 50).cast("string"))))
    earlier = i.f_file.filter("file_id % 13 = 0").select(
        (-F.col("file_id")).alias("task_id"), "source_hash", F.when(F.col("file_id") % 2 == 0, 1).otherwise(0).alias("status"),
        F.lit(False).alias("rewrite"),
    )
    return ingest.ingest_batch(tasks, batch_catalog(i), F.lit("2026-03-04").cast("timestamp_ntz"), earlier)["task_status"]


@query(
    "backfill",
    """select content_id, strftime(addition_date, '%Y-%m-%d') || '-' || lower(hex(source_hash)) as slug from f_content""",
)
def backfill(i: Inputs):
    from tagloom.sources.catalog import backfill_derived

    blank = i.f_content.withColumn("slug", F.when(F.col("content_id") % 2 == 0, F.col("slug")))
    return backfill_derived(blank, i.f_imagehash, i.f_representation)["content"].select("content_id", "slug")


@query(
    "backfill_prefixes",
    """select imagehash_id, lower(substr(hex(l_hash), 1, 8) || substr(hex(a_hash), 1, 4) || substr(hex(b_hash), 1, 4)) as search_similar,
         lower(substr(hex(l_hash), 1, 4) || substr(hex(a_hash), 1, 2) || substr(hex(b_hash), 1, 2)) as far_similarity from f_imagehash""",
)
def backfill_prefixes(i: Inputs):
    from tagloom.sources.catalog import backfill_derived

    made = backfill_derived(i.f_content, i.f_imagehash, i.f_representation)["image_hash"]
    return made.select(
        "imagehash_id", hashing.hex_text("search_similar").alias("search_similar"),
        hashing.hex_text("far_similarity").alias("far_similarity"),
    )


def saved_sql(x: str) -> str:
    return f"case when {x} > 0 then '' else '-' end || {size_sql(f'abs({x})')}"


@query(
    "summary_mime",
    f"""with s as (select media_type, mime_type, count(*) as n, sum(source_file_size)::bigint as src, sum(result_file_size)::bigint as res from f_result group by all),
        r as (select *, src / n::double as ma, res / n::double as mr, case when src = 0 then 0 else res / src::double * 100 end as ratio from s)
        select coalesce(mime_type, 'Unknown') as mime, media_type as type, n as count, {size_sql('ma')} as avg_source, {size_sql('mr')} as avg_result,
          {saved_sql('(src - res)')} as total_saved, format('{{:.1f}}', ratio) || '%' as ratio, ratio > 100 as is_growth from r""",
)
def summary_mime(i: Inputs):
    return reports.processing_by_mime(i.f_result)


def shown_sql(source: str, lead: str) -> str:
    return f"""select {lead} {size_sql('src')} as source, {size_sql('res')} as result, n as count, round_even(case when src = 0 then 0 else res / src::double * 100 end, 1)::double as ratio,
      {size_sql('ma')} as avg_source, {size_sql('mr')} as avg_result, {saved_sql('(src - res)')} as total_saved from
      (select *, case when n = 0 then 0 else round_even(src / n::double, 0)::bigint end as ma, case when n = 0 then 0 else round_even(res / n::double, 0)::bigint end as mr from ({source}))"""


@query(
    "summary_type",
    shown_sql(
        """select k.media_type, coalesce(n, 0) as n, coalesce(src, 0) as src, coalesce(res, 0) as res from (select unnest(['image', 'audio', 'video']) as media_type) k
           left join (select media_type, count(*) as n, sum(source_file_size)::bigint as src, sum(result_file_size)::bigint as res from f_result group by all) s on s.media_type = k.media_type""",
        "media_type,",
    ),
)
def summary_type(i: Inputs):
    return reports.processing_by_type(i.f_result)


@query(
    "summary_overall",
    shown_sql("select count(*) as n, sum(source_file_size)::bigint as src, sum(result_file_size)::bigint as res from f_result", ""),
)
def summary_overall(i: Inputs):
    return reports.processing_overall(i.f_result)


@query(
    "summary_rollup",
    """select media_type, mime_type, cast(grouping(media_type) * 2 + grouping(mime_type) as int) as depth, count(*) as count,
         sum(source_file_size)::bigint as source, sum(result_file_size)::bigint as result
       from (select * replace (coalesce(mime_type, 'Unknown') as mime_type) from f_result) group by rollup (media_type, mime_type)""",
)
def summary_rollup(i: Inputs):
    return reports.processing_rollup(i.f_result)


@query(
    "result_change",
    f"""with r as (select task_id, case when content_id % 50 = 0 then 0 else source_file_size end as s, result_file_size as t from f_result),
        q as (select *, t - s as d, t / nullif(s, 0)::double * 100 as ratio from r)
        select task_id, s as source_file_size, t as result_file_size, case when s = 0 then '-' else format('{{:.1f}}', ratio) || '%' end as percent,
          case when s = 0 then '-' when d > 0 then 'Increased' when d < 0 then 'Reduced' else 'No change' end as direction,
          case when s <> 0 then case when d > 0 then '+' when d < 0 then '-' else '' end || {size_sql('abs(d)')} end as difference,
          case when s = 0 then 'none' when ratio > 105 then 'growth' when ratio >= 95 then 'neutral' else 'saving' end as band from q""",
)
def result_change(i: Inputs):
    results = i.f_result.withColumn(
        "source_file_size", F.when(F.col("content_id") % 50 == 0, 0).otherwise(F.col("source_file_size"))
    )
    return reports.result_change(results)


@query("orphan_files", "select filepath from f_listing where filepath not in (select filepath from f_referenced)")
def orphan_files(i: Inputs):
    return reports.orphan_files(i.f_listing, i.f_referenced)


@query(
    "task_status",
    f"select status, {case('status', rules.STATUS_LABELS)} as label, count(*) as tasks from f_task group by status",
)
def task_status(i: Inputs):
    return reports.task_status_counts(i.f_task)


@query(
    "result_list",
    "select task_id, source_file_size from f_result where task_id in (select task_id from f_task where media_type = 'video' and status = 3)",
)
def result_list(i: Inputs):
    return reports.result_list(i.f_result, i.f_task, "video", rules.PROCESSING).select("task_id", "source_file_size")
