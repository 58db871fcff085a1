"""Listings, pages, details and rendition choices over the views."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.fixtures import Inputs
from tagloom.operators import browse
from tagloom.operators import representations as reps
from tagloom.plans.tagexpr import T
from tagloom.workloads.registry import query
from tagloom.workloads.search import having

QUOTED = "replace(url_encode(filepath), '%2F', '/')"


def base_sql(tw: int, th: int, source: str = "f_representation") -> str:
    """CTE body: srcset_n and base_src per item, from ``source``."""
    reach = f"(width >= {tw} or height >= {th})"
    return f"""select content_id, count(*) filter (where {reach}) as srcset_n,
        coalesce(arg_min(filepath, (width, filepath)) filter (where {reach}),
          arg_min(filepath, (-width::bigint * height, width, filepath))) as base_src
      from {source} where repr_type = 10 group by content_id"""


def entries_sql(tw: int, th: int, media: str = "/media/", places: int | None = None) -> str:
    """Address and printed pixel ratio of every image that reaches the target."""
    ratio = f"case when width::bigint * {th} >= {tw}::bigint * height then width / {tw}::double else height / {th}::double end"
    shown = f"cast({ratio} as varchar)" if places is None else f"format('{{:.{places}f}}', round({ratio}, {places}))"
    return f"""select content_id, width, filepath, '{media}' || {QUOTED} as url, {shown} as ratio_text
      from f_representation where repr_type = 10 and (width >= {tw} or height >= {th})"""


@query("image_srcset", entries_sql(256, 256))
def image_srcset(i: Inputs):
    return reps.srcset_entries(i.f_representation, 256, 256).drop("ratio")


@query("image_base", base_sql(256, 256))
def image_base(i: Inputs):
    return reps.image_base(i.f_representation, 256, 256)


@query("detail_srcset", entries_sql(1024, 1024))
def detail_srcset(i: Inputs):
    return reps.srcset_entries(i.f_representation, 1024, 1024).drop("ratio")


@query("cover_srcset", entries_sql(192, 256, places=3))
def cover_srcset(i: Inputs):
    return reps.srcset_entries(i.f_representation, 192, 256, places=3).drop("ratio")


@query(
    "content_listing",
    f"""with page as (select content_id, title, content_type, slug, addition_date from f_content
          where not is_hidden and content_id in ({having('safe')}) and content_id not in ({having('cold', 'red')})
          order by addition_date desc, content_id limit 24),
        n as (select count(*) as n from f_content where not is_hidden and content_id in ({having('safe')})
          and content_id not in ({having('cold', 'red')})),
        s as ({base_sql(256, 256)})
        select page.*, 1 as page, cast(greatest(ceil(n.n / 24.0), 1) as int) as pages, false as has_previous,
          1 < greatest(ceil(n.n / 24.0), 1) as has_next,
          coalesce(s.srcset_n, 0) as srcset_n, s.base_src
        from page left join s on s.content_id = page.content_id cross join n""",
)
def content_listing(i: Inputs):
    return browse.content_listing(
        i.f_content, i.f_content_tag, i.f_alias, i.f_representation, ~T("cold") & ~T("red"), "safe"
    )


@query("sort_date", "select content_id, addition_date, row_number() over (order by addition_date, content_id) as position from f_content")
def sort_date(i: Inputs):
    return browse.sorted_positions(i.f_content.select("content_id", "addition_date"), "date")


@query(
    "sort_date_desc",
    "select content_id, title, row_number() over (order by addition_date desc, content_id) as position from f_content",
)
def sort_date_desc(i: Inputs):
    rows = i.f_content.select("content_id", "title", "addition_date")
    return browse.sorted_positions(rows, "no such mode").drop("addition_date")


@query("sort_random", "select content_id, title from f_content")
def sort_random(i: Inputs):
    return browse.sort_content(i.f_content, "random", 7).select("content_id", "title")


@query(
    "paginate",
    """select content_id, position, cast((position - 1) // 24 + 1 as int) as page from
         (select content_id, row_number() over (order by addition_date desc, content_id) as position from f_content)""",
)
def paginate(i: Inputs):
    return browse.number_pages(
        i.f_content.select("content_id", "addition_date"), browse.sort_order("date decreasing")
    ).drop("addition_date")


@query(
    "page_beyond_end",
    """with n as (select count(*) as n from f_content)
       select content_id, cast(ceil(n / 100.0) as int) as page, cast(ceil(n / 100.0) as int) as pages, true as has_previous, false as has_next
       from (select content_id, row_number() over (order by addition_date, content_id) as p from f_content) cross join n
       where p > (ceil(n / 100.0) - 1) * 100""",
)
def page_beyond_end(i: Inputs):
    rows = i.f_content.select("content_id", "addition_date")
    return browse.paginate(rows, browse.sort_order("date"), 10**9, 100).drop("addition_date")


PAGES = """p as (select content_id, addition_date, row_number() over (order by addition_date desc, content_id) as p from f_content),
    g as (select *, cast((p - 1) // 24 + 1 as int) as page from p)"""


def dated(i: Inputs):
    return i.f_content.select("content_id", "addition_date")


@query(
    "page_index",
    f"""with {PAGES} select page, count(*) as rows, arg_min(content_id, p) as first_id, arg_max(content_id, p) as last_id,
          arg_min(addition_date, p) as first_date, arg_max(addition_date, p) as last_date from g group by page""",
)
def page_index(i: Inputs):
    return browse.page_index(dated(i)).select(
        "page", "rows", F.col("first.content_id").alias("first_id"), F.col("last.content_id").alias("last_id"),
        F.col("first.addition_date").alias("first_date"), F.col("last.addition_date").alias("last_date"),
    )


@query(
    "page_from_index",
    f"""with {PAGES}, n as (select max(page) as n from g)
        select content_id, page, n as pages, page > 1 as has_previous, page < n as has_next from g cross join n where page = least(500, n)""",
)
def page_from_index(i: Inputs):
    rows = dated(i)
    return browse.indexed_page(rows, browse.page_index(rows), page=500).drop("addition_date")


@query(
    "item_albums",
    """select o.content_id, o.album_id, o.ord, coalesce(nullif(album_name, ''), t.title, 'untitled') as name
       from f_album_order o join f_album a on a.album_id = o.album_id left join f_tag t on t.tag_id = a.set_tag_id""",
)
def item_albums(i: Inputs):
    return browse.item_albums(i.f_album_order, i.f_album, i.f_tag)


PAGE_URL = """case when origin_id is null then '' when name = 'derpibooru' then 'https://derpibooru.org/images/' || origin_id
    when origin_id = '' then null when name = 'twitter' then 'https://x.com/' || replace(origin_id, '#', '/status/')
    else 'https://t.me/' || replace(origin_id, '#', '/') end"""


@query(
    "content_detail",
    # Lists are compared as JSON.
    f"""with h as (select content_id, category, tag_id, title from f_content_tag join f_tag using (tag_id)),
        g as (select content_id, category, list({{'tag_id': tag_id, 'title': title}} order by title nulls first, tag_id) as tags
          from h group by content_id, category),
        gs as (select content_id, to_json(list({{'category': category, 'tags': tags}} order by category nulls first)) as tags
          from g group by content_id),
        t as (select content_id, count(*) as tag_count,
            string_agg(title, ', ' order by category nulls first, title nulls first, tag_id) as plain_tags from h group by content_id),
        k as (select content_id, bool_or(repr_type = 10) as has_image, count(*) filter (where repr_type = 20) as videos
          from f_representation group by content_id),
        v as (select content_id, to_json(list({{'compatibility_level': compatibility_level, 'filepath': filepath, 'playable': compatibility_level <= 2}}
            order by -compatibility_level nulls first, filepath nulls first)) as video_list
          from f_representation where repr_type = 20 group by content_id),
        x as (select content_id, string_agg(url || ' ' || ratio_text || 'x', ', ' order by width nulls first, filepath nulls first, ratio_text || 'x') as srcset
          from ({entries_sql(1024, 1024)}) group by content_id),
        s as ({base_sql(1024, 1024)}),
        o as (select content_id, to_json(list({{'alternate': alternate, 'name': name, 'origin_id': origin_id, 'url': {PAGE_URL}}}
            order by alternate nulls first, name nulls first, origin_id nulls first)) as origins from f_origin group by content_id),
        n as (select o.content_id, o.album_id, o.ord, coalesce(nullif(album_name, ''), f_tag.title, 'untitled') as name
          from f_album_order o join f_album on f_album.album_id = o.album_id left join f_tag on f_tag.tag_id = f_album.set_tag_id),
        a as (select content_id, to_json(list({{'album_id': album_id, 'ord': ord, 'name': name}} order by album_id, ord nulls first, name)) as albums
          from n group by content_id)
        select c.content_id, slug, title, content_type, coalesce(tag_count, 0) as tag_count,
          coalesce(has_image, false) as has_image, coalesce(videos, 0) as videos, coalesce(srcset_n, 0) as srcset_n, base_src,
          coalesce(plain_tags, '') as plain_tags, coalesce(srcset, '') as srcset,
          coalesce(cast(gs.tags as varchar), '[]') as tags, coalesce(cast(video_list as varchar), '[]') as video_list,
          coalesce(cast(origins as varchar), '[]') as origins, coalesce(cast(albums as varchar), '[]') as albums
        from f_content c left join t on t.content_id = c.content_id left join gs on gs.content_id = c.content_id
          left join k on k.content_id = c.content_id left join v on v.content_id = c.content_id left join x on x.content_id = c.content_id
          left join s on s.content_id = c.content_id left join o on o.content_id = c.content_id left join a on a.content_id = c.content_id""",
)
def content_detail(i: Inputs):
    shown = browse.content_detail(
        i.f_content, i.f_content_tag, i.f_tag, i.f_representation, i.f_origin, i.f_album_order, i.f_album, 2
    )
    return shown.withColumns({c: F.to_json(c, {"ignoreNullFields": "false"}) for c in ("tags", "video_list", "origins", "albums")})


@query(
    "detail_videos",
    "select content_id, filepath, compatibility_level, compatibility_level <= 2 as playable from f_representation where repr_type = 20",
)
def detail_videos(i: Inputs):
    return browse.video_choices(i.f_representation, 2)


@query(
    "detail_origins",
    """select content_id, name, origin_id, alternate, case name when 'derpibooru' then 'https://derpibooru.org/images/' || origin_id
         when 'twitter' then case when origin_id <> '' then 'https://x.com/' || replace(origin_id, '#', '/status/') end
         else case when origin_id <> '' then 'https://t.me/' || replace(origin_id, '#', '/') end end as url from f_origin""",
)
def detail_origins(i: Inputs):
    return browse.origin_links(i.f_origin)


@query(
    "resolve_slugs",
    """with r as (select case when event_id % 3 = 0 then 'old-' || cast(event_id // 2 as varchar)
                   when event_id % 3 = 1 then (c.slug) else 'nothing' end as slug, event_id
                 from events left join f_content c on c.content_id = event_id // 2),
        f as (select r.event_id, r.slug, case when c.content_id is not null then 'found' when d.old_slug is not null then 'moved'
               else 'not found' end as status, coalesce(c.content_id, d.new_content_id) as content_id
             from r left join f_content c on c.slug = r.slug left join f_redirect d on d.old_slug = r.slug)
        select f.*, t.slug as current_slug from f left join f_content t on t.content_id = f.content_id""",
)
def resolve_slugs(i: Inputs):
    known = i.f_content.select((F.col("content_id")).alias("_k"), F.col("slug").alias("_slug"))
    asked = i.events.withColumn("_k", F.floor(F.col("event_id") / 2)).join(known, "_k", "left")
    third = F.col("event_id") % 3
    slug = (
        F.when(third == 0, F.concat(F.lit("old-"), F.floor(F.col("event_id") / 2).cast("string")))
        .when(third == 1, F.col("_slug")).otherwise("nothing")
    )
    return browse.resolve_slugs(asked.select("event_id", slug.alias("slug")), i.f_content, i.f_redirect)


FAR = "substr(hex(l_hash), 1, 4) || substr(hex(a_hash), 1, 2) || substr(hex(b_hash), 1, 2)"


@query(
    "similar_content",
    f"""with h as (select content_id, {FAR} as far from f_imagehash),
        p as (select a.content_id, b.content_id as similar_id,
                row_number() over (partition by a.content_id order by b.content_id) as rank
              from h a join h b on a.far = b.far and a.content_id <> b.content_id)
        select p.content_id, cast(rank as int) as rank, similar_id, c.slug as similar_slug, c.title as similar_title
        from p join f_content c on c.content_id = similar_id where rank <= 50""",
)
def similar_content(i: Inputs):
    return browse.similar_content(i.f_imagehash, i.f_content)


@query("tags_by_category", "select content_id, category, tag_id, title from f_content_tag join f_tag using (tag_id)")
def tags_by_category(i: Inputs):
    return browse.tags_by_category(i.f_content_tag, i.f_tag)


@query(
    "collections_without",
    """with r as (select user_id, min(content_id) as content_id from f_collection join f_collection_item using (collection_id) group by user_id)
       select r.user_id, r.content_id, c.collection_id, c.title from r join f_collection c on c.user_id = r.user_id
       where not exists (select 1 from f_collection_item x where x.collection_id = c.collection_id and x.content_id = r.content_id)""",
)
def collections_without(i: Inputs):
    asked = i.f_collection.join(i.f_collection_item, "collection_id").groupBy("user_id").agg(
        F.min("content_id").alias("content_id")
    )
    return browse.collections_without(asked, i.f_collection, i.f_collection_item)


@query(
    "catalog_rows",
    """with t as (select content_id, (list(filepath order by -width, filepath))[1] as thumbnail from f_representation
          where repr_type = 10 and width <= 128 and height <= 128 group by content_id)
       select c.content_id, thumbnail, case when length(title) > 16 then left(title, 16) || '…' else title end as title_short,
         content_type, not is_hidden as is_visible, addition_date
       from (select content_id, title || ' of order' as title, content_type, is_hidden, addition_date from f_content) c
         left join t on t.content_id = c.content_id""",
)
def catalog_rows(i: Inputs):
    named = i.f_content.withColumn("title", F.concat("title", F.lit(" of order")))
    return browse.catalog_rows(named, i.f_representation)


@query(
    "pick_representation",
    # Some ask for a width and no height.
    """with c as (select q.* replace (case when q.content_id % 8 <> 5 then target_height end as target_height), c.content_type,
            case when content_type = 'image' then 10 else 20 end as kind from f_request q join f_content c on c.content_id = q.content_id),
        m as (select c.content_id as request_id, c.*, r.filepath, r.width, r.height, r.compatibility_level,
                coalesce(kind = 10 and (r.width >= c.target_width or r.height >= c.target_height), false) as reach
              from c join f_representation r on r.content_id = c.content_id and r.repr_type = kind and r.compatibility_level <= clevel
                and not (kind = 10 and (target_width is null) <> (target_height is null))),
        b as (select *, row_number() over (partition by request_id order by case when reach then 0 else 1 end,
                case when reach then width when kind = 10 then -width else 0 end,
                case when reach then 0 else -compatibility_level end, filepath) as rn from m)
        select c.content_id as request_id, c.content_id, c.content_type, c.clevel, c.target_width, c.target_height,
          case when c.kind = 10 and (c.target_width is null) <> (c.target_height is null) then 'error' when b.filepath is null then 'missing' else 'found' end as status,
          b.filepath, b.width, b.height, b.compatibility_level
        from c left join b on b.request_id = c.content_id and rn = 1""",
)
def pick_representation(i: Inputs):
    asked = i.f_request.join(i.f_content.select("content_id", "content_type"), "content_id").select(
        F.col("content_id").alias("request_id"), "content_id", "content_type", "clevel", "target_width",
        F.when(F.col("content_id") % 8 != 5, F.col("target_height")).alias("target_height"),
    )
    return reps.pick_representation(asked, i.f_representation)


@query(
    "preview_pick",
    """select content_id, (list(filepath order by -width, filepath))[1] as preview from f_representation
       where repr_type = 10 and width <= 512 and height <= 512 group by content_id""",
)
def preview_pick(i: Inputs):
    return reps.preview_pick(i.f_representation, 512)


@query(
    "best_raster",
    """select content_id, filepath, width, height from (select *, row_number() over (partition by content_id order by -width, filepath) as rn
         from f_representation where repr_type = 10 and format <> 'svg') where rn = 1""",
)
def best_raster(i: Inputs):
    return reps.best_raster(i.f_representation)


@query(
    "tagger_input",
    """select content_id, (list(filepath order by -width, filepath))[1] as filepath from f_representation
       where repr_type = 10 and compatibility_level = 1 group by content_id""",
)
def tagger_input(i: Inputs):
    return reps.tagger_input(i.f_representation)


TITLED = "select *, 'a/b (' || title || ')~*.png.jpg' as long_title from f_content"


@query(
    "download_names",
    f"""select r.content_id, r.filepath, replace(url_encode(case when o.content_id is not null
            then case o.name when 'derpibooru' then 'db' when 'twitter' then 'tx-' else 'te-' end || o.origin_id
            else 'mlid' || r.content_id end || ' ' || 'a_b (' || c.title || ')~*.png' || '.' || r.format), '%2F', '/') as file_name
        from f_representation r join f_content c on c.content_id = r.content_id
          left join (select * from f_origin where origin_id <> '' and not alternate) o on o.content_id = r.content_id""",
)
def download_names(i: Inputs):
    # .png is before .jpg in the suffix table, so only the last one is cut.
    titled = i.f_content.withColumn("title", F.concat(F.lit("a/b ("), "title", F.lit(")~*.png.jpg")))
    return reps.download_names(titled, i.f_origin, i.f_representation, "title_slug")


@query(
    "download_origin_names",
    """select r.content_id, r.filepath, coalesce(o.origin_id, 'mlid' || r.content_id) || '.' || r.format as file_name
        from f_representation r join f_content c on c.content_id = r.content_id
          left join (select * from f_origin where origin_id <> '') o on o.content_id = r.content_id""",
)
def download_origin_names(i: Inputs):
    return reps.download_names(i.f_content, i.f_origin, i.f_representation, "origin_id")


@query(
    "storage_paths",
    """select r.content_id, r.filepath, '2026/03/04/mlid' || r.content_id || ' ' || left(replace(replace(to_base64(c.source_hash), '+', '-'), '/', '_'), 12)
          || case when o.origin_id <> '' then ' ' || case o.name when 'derpibooru' then 'db' when 'twitter' then 'tx-' else 'te-' end
               || replace(o.origin_id, '#', '_') else '' end
          || '_cl' || r.compatibility_level || '_' || r.width || 'x' || r.height || '.' || r.format as stored_path
        from f_representation r join f_content c on c.content_id = r.content_id join f_origin o on o.content_id = r.content_id""",
)
def storage_paths(i: Inputs):
    date = F.lit("2026-03-04").cast("date")
    return reps.storage_paths(i.f_content, i.f_origin, i.f_representation, date)


LADDER_ARMS = """values (128, 0, 'WEBP', 80, null), (256, 128, 'WEBP', 85, null), (512, 256, 'WEBP', 90, null),
    (1024, 512, 'WEBP', 95, 5), (2048, 1024, 'AVIF', 90, 3), (4096, 2048, 'AVIF', 85, null)"""


@query(
    "image_ladder",
    f"""with f as (select distinct filepath as file_id, width * 2 as width, height, case format when 'svg' then 'SVG' when 'avif' then 'JPEG'
              else 'WEBP' end as format, width % 3 = 0 as lossless from f_representation),
        l as (select * from ({LADDER_ARMS}) l(rung, prev, fmt, q, e)),
        x as (select f.*, l.*, greatest(width, height) as side from f cross join l where not (format = 'SVG' and rung > 2048)),
        y as (select *, side > rung as larger, side <= rung and side > prev as alike from x),
        z as (select *, alike and (format = 'JPEG' or (format = 'WEBP' and not lossless)) as keeps,
               case when larger then rung / side::double else 1.0::double end as scale from y where larger or alike),
        w as (select file_id, rung, case when larger then 'LARGER' else 'SIMILAR' end as fit, case when keeps then format else fmt end as out_format,
               case when not keeps then q end as quality, case when not keeps then e end as effort,
               cast(greatest(floor(width * scale + 0.5::double), 1) as int) as out_width, cast(greatest(floor(height * scale + 0.5::double), 1) as int) as out_height,
               keeps as keeps_source from z
             union all select file_id, null, 'ORIGINAL', 'SVG', null, null, width, height, true from f where format = 'SVG'),
        s as (select *, greatest(out_width, out_height) as side from w),
        v as (select *, case when side <= 1024 then 0 when side <= 2048 then 1 when side <= 4096 then 2 when side <= 8192 then 3 else 4 end as sl from s)
        select file_id, rung, fit, out_format, quality, effort, out_width, out_height, keeps_source,
          case when rung is null then 3 when out_format = 'AVIF' then greatest(sl + 1, 2) when out_format = 'WEBP' then greatest(sl, 1) else sl end as level
        from v""",
)
def image_ladder(i: Inputs):
    fmt = F.when(F.col("format") == "svg", "SVG").when(F.col("format") == "avif", "JPEG").otherwise("WEBP")
    files = i.f_representation.select(
        F.col("filepath").alias("file_id"), (F.col("width") * 2).alias("width"), "height",
        fmt.alias("format"), (F.col("width") % 3 == 0).alias("is_lossless"),
    )
    return reps.image_ladder(files)


@query(
    "validate_reprs",
    """with r as (select content_id as filepath, case when height % 7 = 0 then 0 else width end as width, height, repr_type,
                    compatibility_level + case when width % 11 = 0 then 1 else 0 end as lv from f_representation)
       select 'width' as problem, cast(filepath as varchar) as filepath, 1::bigint as n from r where width <= 0
       union all select 'level', cast(filepath as varchar), 1 from r where lv > 4
       union all select 'path', cast(filepath as varchar), count(*) from r group by filepath having count(*) > 1""",
)
def validate_reprs(i: Inputs):
    r = i.f_representation
    broken = r.select(
        F.col("content_id").cast("string").alias("filepath"), "height", "repr_type",
        (F.col("compatibility_level") + F.when(F.col("width") % 11 == 0, 1).otherwise(0)).alias("compatibility_level"),
        F.when(F.col("height") % 7 == 0, 0).otherwise(F.col("width")).alias("width"),
    )
    return reps.validate_representations(broken)


@query(
    "level_coverage",
    """select compatibility_level as level, case compatibility_level when 4 then 'CL4 Supercomputer' when 3 then 'CL3 Personal Computer'
         when 2 then 'CL2 Mobile device' when 1 then 'CL1 Old hardware' else 'CL0 Very old hardware' end as label,
         count(*) as renditions, count(distinct content_id) as items, compatibility_level > 0 as offered, compatibility_level = 2 as is_default
       from f_representation group by compatibility_level""",
)
def level_coverage(i: Inputs):
    return reps.level_coverage(i.f_representation)
