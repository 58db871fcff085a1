"""Albums and collections over the views."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.fixtures import Inputs
from tagloom.operators import sets
from tagloom.workloads.browse import base_sql
from tagloom.workloads.registry import query

MEMBERS = """select a.album_id, ct.content_id, case when regexp_matches(o.origin_id, '^-?[0-9]+$') then cast(o.origin_id as hugeint)
      else 18446744073709551615::hugeint end as number
    from f_album a join f_content_tag ct on ct.tag_id = a.set_tag_id left join f_origin o on o.content_id = ct.content_id"""


@query(
    "sync_albums",
    f"select album_id, content_id, row_number() over (partition by album_id order by number, content_id) as ord from ({MEMBERS})",
)
def sync_albums(i: Inputs):
    return sets.sync_albums(i.f_album, i.f_content_tag, i.f_origin)


@query(
    "album_creators",
    """with found as (select distinct album_id, t.tag_id from f_album_order o join f_content_tag c on c.content_id = o.content_id
          join f_tag t on t.tag_id = c.tag_id where category = 'creator')
       select album_id, tag_id from found union all
       select album_id, tag_id from f_album_creator where album_id not in (select album_id from found)""",
)
def album_creators(i: Inputs):
    return sets.album_creators(i.f_album_order, i.f_content_tag, i.f_tag, i.f_album_creator)


@query(
    "register_albums",
    """with r as (select c_custkey, case when c_custkey % 4 = 1 then c_name when c_custkey % 3 = 0 then 'set ' || c_custkey
                    else 'request ' || c_custkey end as album_title from customer),
         r1 as (select album_title, min(c_custkey) as c_custkey from r group by album_title),
         ids as (select r1.album_title, r1.c_custkey, o_orderkey, origin_id,
                   row_number() over (partition by r1.album_title order by o_orderkey) * case when r1.c_custkey % 2 = 0 then 10 else 1 end as ord
                 from r1 join orders on o_custkey = r1.c_custkey join f_origin on content_id = o_orderkey),
         kn as (select name, origin_id, max(content_id) as content_id from f_origin group by all),
         it as (select ids.album_title, o.content_id, ord from ids join kn o on o.name = 'derpibooru' and o.origin_id = ids.origin_id
                where ids.c_custkey % 7 <> 0),
         cr as (select album_title, count(distinct t.tag_id) as n from it join f_content_tag c on c.content_id = it.content_id
                join f_tag t on t.tag_id = c.tag_id and t.category = 'creator' group by album_title),
         pr as (select album_name, min(album_id) as album_id, max(set_tag_id) as s from f_album where album_name <> '' group by album_name)
       select r1.album_title, 'derpibooru' as origin_name, case when c_custkey % 7 = 0 then 'both forms given' when not exists (select 1 from ids where ids.album_title = r1.album_title) then 'no content given' else 'success' end as status,
         pr.album_id, pr.album_id is null as created,
         (select count(*) from it where it.album_title = r1.album_title) as items_registered,
         case when c_custkey % 7 = 0 then 0 else (select count(*) from ids where ids.album_title = r1.album_title) end as items_total,
         coalesce(cr.n, 0) as creators_found, coalesce(pr.s, t.tag_id) as set_tag_id
       from r1 left join cr using (album_title) left join pr on pr.album_name = r1.album_title
         left join f_tag t on t.title = r1.album_title and t.category = 'set'""",
)
def register_albums(i: Inputs):
    key = F.col("c_custkey")
    title = (
        F.when(key % 4 == 1, F.col("c_name")).when(key % 3 == 0, F.concat(F.lit("set "), key.cast("string")))
        .otherwise(F.concat(F.lit("request "), key.cast("string")))
    )
    wanted = i.customer.groupBy(title.alias("album_title")).agg(
        F.min("c_custkey").alias("c_custkey")
    )
    held = i.orders.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("content_id")).join(
        i.f_origin, "content_id"
    ).groupBy("c_custkey").agg(F.sort_array(F.collect_list(F.struct("content_id", "origin_id"))).alias("held"))
    ids = F.col("held.origin_id")
    ordered = F.map_from_entries(
        F.transform(ids, lambda x, n: F.struct(((n + 1) * 10).cast("string").alias("k"), x.alias("v")))
    )
    requests = wanted.join(held, "c_custkey", "left").select(
        "album_title", F.lit("derpibooru").alias("origin_name"),
        F.when((key % 2 != 0) | (key % 7 == 0), ids).alias("content_sequence"),
        F.when((key % 2 == 0) | (key % 7 == 0), ordered).alias("ordered_content"),
    )
    return sets.register_albums(requests, i.f_origin, i.f_content_tag, i.f_tag, i.f_album)["summary"]


# Each customer's orders, as an album of the customer's name, of the title of a set tag, or of a title of its own.
ASKED = """select 'derpibooru' as origin_name, case when o_custkey % 4 = 1 then c_name when o_custkey % 3 = 0 then 'set ' || cast(o_custkey as string)
      else 'request ' || cast(o_custkey as string) end as album_title, o_orderkey as ord, origin_id
    from orders join customer on c_custkey = o_custkey join f_origin on content_id = o_orderkey"""

APPLIED = f"""asked as materialized ({ASKED}),
    pr as (select album_name as album_title, min(album_id) as album_id from f_album where album_name <> '' group by album_name),
    ti as (select distinct album_title from asked),
    gi as materialized (select album_title, album_id, false as made from ti join pr using (album_title)
      union all select album_title, (select max(album_id) from f_album) + row_number() over (order by album_title), true from ti
        where album_title not in (select album_title from pr)),
    kn as (select name, origin_id, max(content_id) as content_id from f_origin group by all),
    it as materialized (select album_id, kn.content_id, ord from asked join kn on kn.name = origin_name and kn.origin_id = asked.origin_id join gi using (album_title))"""


def applied(i: Inputs):
    asked = ASKED
    for name in ("orders", "customer", "f_origin"):
        asked = asked.replace(f"from {name}", f"from {{{name}}}").replace(f"join {name}", f"join {{{name}}}")
    asked = i.spark.sql(asked, orders=i.orders, customer=i.customer, f_origin=i.f_origin)
    return sets.apply_albums(asked, i.f_origin, i.f_content_tag, i.f_tag, i.f_album, i.f_album_order, i.f_album_creator)


@query(
    "applied_albums",
    f"""with {APPLIED}, sm as (select title, min(tag_id) as tag_id from f_tag where category in ('set', 'comic') group by title)
        select a.album_id, coalesce(set_tag_id, tag_id) as set_tag_id, album_name, is_nsfw from f_album a
          left join gi on gi.album_id = a.album_id and not made left join sm on sm.title = gi.album_title
        union all select album_id, tag_id, album_title, false from gi left join sm on sm.title = album_title where made""",
)
def applied_albums(i: Inputs):
    return applied(i)["album"]


@query(
    "applied_order",
    f"""with {APPLIED} select album_id, content_id, ord from f_album_order where album_id not in (select album_id from gi)
        union all select album_id, content_id, ord from it""",
)
def applied_order(i: Inputs):
    return applied(i)["album_order"]


@query(
    "applied_creators",
    f"""with {APPLIED}, cr as materialized (select distinct album_id, tag_id from it join f_content_tag using (content_id) join f_tag using (tag_id) where category = 'creator')
        select album_id, tag_id from f_album_creator where album_id not in (select album_id from cr) union all select album_id, tag_id from cr""",
)
def applied_creators(i: Inputs):
    return applied(i)["album_creator"]


@query(
    "album_names",
    """select a.album_id, coalesce(nullif(album_name, ''), t.title, 'untitled') as name
       from f_album a left join f_tag t on t.tag_id = a.set_tag_id""",
)
def album_names(i: Inputs):
    return sets.album_names(i.f_album, i.f_tag)


@query(
    "album_makers",
    """select a.album_id, coalesce(c.title, 'Unknown Creators') as creator
       from f_album a left join (select album_id, title from f_album_creator join f_tag using (tag_id)) c on c.album_id = a.album_id""",
)
def album_makers(i: Inputs):
    return sets.album_makers(i.f_album, i.f_album_creator, i.f_tag)


@query(
    "album_listing",
    f"""with n as (select count(*) as n from f_album where not is_nsfw),
        p as (select * from f_album where not is_nsfw order by album_id limit 20),
        c as (select album_id, arg_min(content_id, ord) as content_id from f_album_order group by album_id),
        s as ({base_sql(192, 256)})
        select p.album_id, coalesce(nullif(album_name, ''), t.title, 'untitled') as name, is_nsfw, c.content_id, 1 as page,
          cast(ceil(n.n / 20.0) as int) as pages, coalesce(s.srcset_n, 0) as srcset_n, s.base_src
        from p cross join n left join f_tag t on t.tag_id = p.set_tag_id left join c on c.album_id = p.album_id
          left join s on s.content_id = c.content_id""",
)
def album_listing(i: Inputs):
    return sets.album_listing(i.f_album, i.f_album_order, i.f_tag, i.f_representation)


@query(
    "album_covers",
    f"""with c as (select album_id, arg_min(content_id, ord) as content_id from f_album_order group by album_id), s as ({base_sql(192, 256)})
        select a.album_id, c.content_id, coalesce(s.srcset_n, 0) as srcset_n, s.base_src from f_album a left join c on c.album_id = a.album_id
          left join s on s.content_id = c.content_id""",
)
def album_covers(i: Inputs):
    return sets.all_album_covers(i.f_album, i.f_album_order, i.f_representation)


@query(
    "album_detail",
    f"""with n as (select count(*) as n from f_album_order where album_id = 11), s as ({base_sql(256, 256)})
        select o.ord, c.content_id, c.slug, c.title, c.content_type, 1 as page, cast(greatest(ceil(n / 24.0), 1) as int) as pages,
          false as has_previous, n > 24 as has_next, coalesce(srcset_n, 0) as srcset_n, base_src
        from f_album_order o join f_content c on c.content_id = o.content_id cross join n left join s on s.content_id = c.content_id
        where o.album_id = 11 order by ord limit 24""",
)
def album_detail(i: Inputs):
    return sets.album_detail(11, i.f_album_order, i.f_content, i.f_representation)


@query(
    "album_pages",
    """select album_id, ord, content_id, position, cast((position - 1) // 5 + 1 as int) as page from
         (select *, row_number() over (partition by album_id order by ord) as position from f_album_order)""",
)
def album_pages(i: Inputs):
    return sets.album_pages(i.f_album_order, 5)


@query(
    "collection_listing",
    f"""with f as (select collection_id, count(*) as items, min(content_id) as content_id from f_collection_item group by collection_id),
        s as ({base_sql(128, 128)})
        select user_id, c.collection_id, title, is_nsfw, created_at, coalesce(items, 0) as items, f.content_id as cover_id, coalesce(srcset_n, 0) as srcset_n, s.base_src
        from f_collection c left join f on f.collection_id = c.collection_id left join s on s.content_id = f.content_id where not is_nsfw""",
)
def collection_listing(i: Inputs):
    return sets.collection_listing(i.f_collection, i.f_collection_item, i.f_representation)


@query(
    "collection_detail",
    f"""with m as (select content_id from f_collection_item where collection_id = 7
          and collection_id in (select collection_id from f_collection where user_id = (select c_nationkey from customer where c_custkey = 7))),
        n as (select count(*) as n from m), s as ({base_sql(256, 256)})
        select c.content_id, c.slug, c.title, c.content_type, 1 as page, cast(greatest(ceil(n / 3.0), 1) as int) as pages, false as has_previous,
          n > 3 as has_next, coalesce(srcset_n, 0) as srcset_n, base_src
        from m join f_content c on c.content_id = m.content_id cross join n left join s on s.content_id = c.content_id
        order by c.content_id limit 3""",
)
def collection_detail(i: Inputs):
    owner = i.customer.filter("c_custkey = 7").select(F.col("c_nationkey").cast("long").alias("user_id"))
    mine = i.f_collection.join(owner, "user_id", "left_semi").withColumn("user_id", F.lit(1).cast("long"))
    return sets.collection_detail(1, 7, mine, i.f_collection_item, i.f_content, i.f_representation, per_page=1)


OWN = "select e.*, c.user_id as owner from f_edit e left join f_collection c on c.collection_id = e.collection_id"


@query(
    "collection_edits",
    f"""with own as (select * from ({OWN}) where owner = user_id),
        last as (select collection_id, content_id, arg_max(action, (edited_at, edit_id)) as action from own where action <> 'toggle_nsfw' group by all)
        select collection_id, content_id from f_collection_item i where not exists (select 1 from last l where l.collection_id = i.collection_id and l.content_id = i.content_id)
        union all select collection_id, content_id from last where action = 'add' and content_id in (select content_id from f_content)""",
)
def collection_edits(i: Inputs):
    return sets.apply_collection_edits(i.f_collection, i.f_collection_item, i.f_edit, i.f_content)["items"]


OWN_WIDE = "select e.*, c.user_id as owner from f_edit_wide e left join f_collection c on c.collection_id = e.collection_id"


@query(
    "collection_edits_wide",
    f"""with own as (select * from ({OWN_WIDE}) where owner = user_id),
        last as (select collection_id, content_id, arg_max(action, (edited_at, edit_id)) as action from own where action <> 'toggle_nsfw' group by all)
        select collection_id, content_id from f_collection_item i where not exists (select 1 from last l where l.collection_id = i.collection_id and l.content_id = i.content_id)
        union all select collection_id, content_id from last where action = 'add' and content_id in (select content_id from f_content)""",
)
def collection_edits_wide(i: Inputs):
    """Edits of as many items as there are collections, times five."""
    return sets.apply_collection_edits(i.f_collection, i.f_collection_item, i.f_edit_wide, i.f_content)["items"]


@query(
    "collection_flags",
    f"""with t as (select collection_id, count(*) % 2 = 1 as flip from ({OWN}) where owner = user_id and action = 'toggle_nsfw' group by collection_id)
        select c.collection_id, title, c.is_nsfw <> coalesce(flip, false) as is_nsfw from f_collection c left join t on t.collection_id = c.collection_id""",
)
def collection_flags(i: Inputs):
    edited = sets.apply_collection_edits(i.f_collection, i.f_collection_item, i.f_edit, i.f_content)
    return edited["collection"].select("collection_id", "title", "is_nsfw")


@query(
    "collection_rejects",
    f"""select edit_id, collection_id, user_id, case when owner is null then 'no such collection' else 'not the owner' end as reason
        from ({OWN}) where owner is null or owner <> user_id""",
)
def collection_rejects(i: Inputs):
    return sets.apply_collection_edits(i.f_collection, i.f_collection_item, i.f_edit, i.f_content)["rejected"]


@query(
    "collection_create",
    """with a as (select user_id % 25 as user_id, case when event_id % 3 = 0 then 'Customer#00000' || lpad(cast(user_id as varchar), 4, '0')
                   when event_id % 3 = 1 then event_type else '' end as title, ts, value > 50 as is_nsfw from events),
         f as (select user_id, title, arg_min(is_nsfw, (ts, is_nsfw)) as is_nsfw, min(ts) as created_at from a where title <> '' group by user_id, title),
         m as (select f.* from f where not exists (select 1 from f_collection c where c.user_id = f.user_id and c.title = f.title))
       select collection_id, user_id, title, is_nsfw from f_collection
       union all select (select max(collection_id) from f_collection) + row_number() over (order by created_at, user_id, title), user_id, title, is_nsfw from m""",
)
def collection_create(i: Inputs):
    title = (
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Customer#00000"), F.lpad(F.col("user_id").cast("string"), 4, "0")))
        .when(F.col("event_id") % 3 == 1, F.col("event_type")).otherwise("")
    )
    asked = i.events.select(
        (F.col("user_id") % 25).alias("user_id"), title.alias("title"), F.col("ts").alias("created_at"),
        (F.col("value") > 50).alias("is_nsfw"),
    )
    return sets.create_collections(i.f_collection, asked).drop("created_at")


@query(
    "validate_albums",
    """with a as (select album_id, case when album_id % 5 = 0 then (select max(tag_id) from f_tag where category = 'style') else set_tag_id end as set_tag_id from f_album),
         c as (select album_id, tag_id from f_album_creator union all select album_id, set_tag_id from f_album where set_tag_id is not null)
       select album_id, 'set tag' as problem, tag_id from a join f_tag t on t.tag_id = set_tag_id where category not in ('set', 'comic')
       union all select album_id, 'creator tag', tag_id from c join f_tag using (tag_id) where category not in ('creator', 'artist', 'prompter')""",
)
def validate_albums(i: Inputs):
    style = i.f_tag.filter(F.col("category") == "style").agg(F.max("tag_id").alias("m")).scalar()
    a = i.f_album.withColumn("set_tag_id", F.when(F.col("album_id") % 5 == 0, style).otherwise(F.col("set_tag_id")))
    extra = i.f_album.filter("set_tag_id is not null").select("album_id", F.col("set_tag_id").alias("tag_id"))
    return sets.validate_albums(a, i.f_album_creator.unionByName(extra), i.f_tag)


@query(
    "validate_order",
    # Some items are listed again at the end, and some places are given to another item as well.
    """with o as (select album_id, content_id, ord from f_album_order
         union all select album_id, content_id, ord + 100000000000 from f_album_order where content_id % 9 = 0
         union all select album_id, content_id + 100000000000, ord from f_album_order where content_id % 7 = 0)
       select album_id, 'content' as problem, content_id as value, count(*) as n from o group by album_id, content_id having count(*) > 1
       union all select album_id, 'position', ord, count(*) from o group by album_id, ord having count(*) > 1""",
)
def validate_order(i: Inputs):
    o, far = i.f_album_order.select("album_id", "content_id", F.col("ord").cast("long").alias("ord")), 100000000000
    again = o.filter("content_id % 9 = 0").withColumn("ord", F.col("ord") + far)
    shared = o.filter("content_id % 7 = 0").withColumn("content_id", F.col("content_id") + far)
    return sets.validate_order(o.unionByName(again).unionByName(shared))


def pages_sql(items: str, owner: str, order: str) -> str:
    return f"""with n as (select {owner}, content_id, row_number() over (partition by {owner} order by {order}) as position from {items}),
        s as ({base_sql(256, 256)})
        select n.{owner}, position, cast((position - 1) // 24 + 1 as int) as page, c.content_id, c.slug, c.title, c.content_type,
          coalesce(srcset_n, 0) as srcset_n, base_src
        from n join f_content c on c.content_id = n.content_id left join s on s.content_id = n.content_id"""


@query("album_detail_all", pages_sql("f_album_order", "album_id", "ord"))
def album_detail_all(i: Inputs):
    return sets.all_album_details(i.f_album_order, i.f_content, i.f_representation)


@query("collection_detail_all", pages_sql("f_collection_item", "collection_id", "content_id"))
def collection_detail_all(i: Inputs):
    return sets.all_collection_details(i.f_collection_item, i.f_content, i.f_representation)
