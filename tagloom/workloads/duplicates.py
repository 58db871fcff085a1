"""Signatures, duplicate review and merging over the views."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.fixtures import Inputs
from tagloom.functions import hashing
from tagloom.operators import duplicates, merge, signatures
from tagloom.workloads.registry import query


def bands(i: Inputs):
    flipped = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.get(F.col("band"), (k % 8) * 8 + (k / 8).cast("int")))
    return i.f_band.select(
        "imagehash_id", F.col("band").alias("l_band"), F.col("band").alias("a_band"), flipped.alias("b_band")
    )


def low_sql(k: int, turned: bool) -> str:
    """Hash of side k as hex, from unnested cells."""
    r, c = ("j", "i") if turned else ("i", "j")
    return f"""select imagehash_id, lower(string_agg(lpad(to_hex(v), 2, '0'), '' order by byte)) as h from (
        select imagehash_id, pos // 8 as byte, cast(sum(case when coef > med then pow(2, 7 - pos % 8) else 0 end) as bigint) as v from (
          select imagehash_id, coef, median(coef) over (partition by imagehash_id) as med,
            row_number() over (partition by imagehash_id order by u + w, case when (u + w) % 2 = 0 then w else u end) - 1 as pos from (
            select imagehash_id, u, w, sum(x * cos(pi() * u * (2 * {r} + 1) / 16) * cos(pi() * w * (2 * {c} + 1) / 16)) as coef
            from cells, (select unnest(range({k})) as u), (select unnest(range({k})) as w) group by imagehash_id, u, w))
        group by imagehash_id, pos // 8) group by imagehash_id"""


@query(
    "visual_signature",
    f"""with b as (select imagehash_id, unnest(band) as x, unnest(range(64)) as p from f_band),
        cells as (select imagehash_id, x, p // 8 as i, p % 8 as j from b),
        l as ({low_sql(8, False)}), a as ({low_sql(4, False)}), t as ({low_sql(4, True)})
        select l.imagehash_id, l.h as l_hash, a.h as a_hash, t.h as b_hash, substr(l.h, 1, 8) || a.h || t.h as search_similar,
          substr(l.h, 1, 4) || substr(a.h, 1, 2) || substr(t.h, 1, 2) as far_similarity, null::varchar as error
        from l join a using (imagehash_id) join t using (imagehash_id)""",
)
def visual_signature(i: Inputs):
    found = signatures.visual_signature(bands(i), 8, 4)
    shown = [hashing.hex_text(c).alias(c) for c in ("l_hash", "a_hash", "b_hash", "search_similar", "far_similarity")]
    return found.select("imagehash_id", *shown, "error")


@query(
    "zigzag",
    """select imagehash_id, cast(rank as int) as rank, x from (select imagehash_id, x,
         row_number() over (partition by imagehash_id order by r + c, case when (r + c) % 2 = 0 then c else r end) - 1 as rank
       from (select imagehash_id, unnest(band) as x, unnest(range(64)) // 8 as r, unnest(range(64)) % 8 as c from f_band))""",
)
def zigzag(i: Inputs):
    return i.f_band.select("imagehash_id", F.posexplode(signatures.zigzag("band", 8)).alias("rank", "x"))


LINEAR = "case when {c} / 255.0::double <= 0.04045 then {c} / 255.0::double / 12.92 else pow(({c} / 255.0::double + 0.055) / 1.055::double, 2.4) end"


@query(
    "lab_bands",
    f"""with px as (select vec_id as image_id, unnest(range(64)) as p, unnest(list_transform(range(64), lambda k: cast(floor(abs(embedding[k + 1]) * 1000) as int) % 256)) as r,
            unnest(list_transform(range(64), lambda k: cast(floor(abs(embedding[(k + 1) % 64 + 1]) * 1000) as int) % 256)) as g,
            unnest(list_transform(range(64), lambda k: cast(floor(abs(embedding[(k + 2) % 64 + 1]) * 1000) as int) % 256)) as b from embeddings),
        li as (select image_id, p, {LINEAR.format(c='r')} as r, {LINEAR.format(c='g')} as g, {LINEAR.format(c='b')} as b from px),
        xyz as (select image_id, p, (r * 0.4124564::double + g * 0.3575761::double + b * 0.1804375::double) / 0.95047::double as x,
            r * 0.2126729::double + g * 0.7151522::double + b * 0.0721750::double as y, (r * 0.0193339::double + g * 0.1191920::double + b * 0.9503041::double) / 1.08883::double as z from li),
        f as (select image_id, p, case when x > 216 / 24389.0::double then cbrt(x) else (x * (24389 / 27.0::double) + 16) / 116.0::double end as x,
            case when y > 216 / 24389.0::double then cbrt(y) else (y * (24389 / 27.0::double) + 16) / 116.0::double end as y,
            case when z > 216 / 24389.0::double then cbrt(z) else (z * (24389 / 27.0::double) + 16) / 116.0::double end as z from xyz)
        select image_id, cast(p as int) as p, cast(trunc((116 * y - 16) / 100.0::double * 255) as int) as l, cast(trunc(500 * (x - y) + 128) as int) as a,
          cast(trunc(200 * (y - z) + 128) as int) as b from f""",
)
def lab_bands(i: Inputs):
    channel = lambda n: F.transform(
        F.sequence(F.lit(0), F.lit(63)), lambda k: F.floor(F.abs(F.get("embedding", (k + n) % 64)) * 1000).cast("int") % 256
    )
    pixels = i.embeddings.select(
        F.col("vec_id").alias("image_id"), channel(0).alias("r"), channel(1).alias("g"), channel(2).alias("b")
    )
    made = signatures.lab_bands(pixels)
    rows = made.select("image_id", F.posexplode(F.arrays_zip("l_band", "a_band", "b_band")).alias("p", "v"))
    return rows.select("image_id", "p", F.col("v.l_band").alias("l"), F.col("v.a_band").alias("a"), F.col("v.b_band").alias("b"))


SIMILAR = "lower(substr(hex(l_hash), 1, 8) || substr(hex(a_hash), 1, 4) || substr(hex(b_hash), 1, 4))"
FAR = "lower(substr(hex(l_hash), 1, 4) || substr(hex(a_hash), 1, 2) || substr(hex(b_hash), 1, 2))"


def groups_sql(key: str, keys: str) -> str:
    return f"""select {key} as key_hex, count(*) as items, count(*) filter (where alternate_version) as alternates, min(imagehash_id) as first_id
        from f_imagehash group by {keys} having count(*) > 1 and bool_or(not alternate_version)"""


@query("dup_exact", groups_sql(f"min({SIMILAR})", "l_hash, a_hash, b_hash"))
def dup_exact(i: Inputs):
    return duplicates.duplicate_groups(i.f_imagehash, "exact").select("key_hex", "items", "alternates", "first_id")


@query("dup_medium", groups_sql(SIMILAR, SIMILAR))
def dup_medium(i: Inputs):
    return duplicates.duplicate_groups(i.f_imagehash, "medium").drop("group_key")


@query("dup_low", groups_sql(FAR, FAR))
def dup_low(i: Inputs):
    return duplicates.duplicate_groups(i.f_imagehash, "low").drop("group_key")


def members_sql(key: str) -> str:
    return f"""select {key} as key_hex, g.first_id, g.items, imagehash_id, content_id, aspect_ratio, alternate_version
        from f_imagehash h join ({groups_sql(key, key)}) g on g.key_hex = {key}"""


@query("dup_members", members_sql(SIMILAR))
def dup_members(i: Inputs):
    return duplicates.duplicate_members(i.f_imagehash, "medium")


@query(
    "compare_pairs",
    f"""with m as ({members_sql(FAR)}), b as (select content_id, width, height from (select *, row_number() over (partition by content_id order by -width, filepath) as rn
          from f_representation where repr_type = 10 and format <> 'svg') where rn = 1)
        select m.key_hex, m.first_id as first_hash, m.imagehash_id as second_hash, m.first_id as first_content, m.content_id as second_content,
          case when b1.content_id is not null and b2.content_id is not null then b1.width = b2.width and b1.height = b2.height end as same_size,
          o1.name = o2.name as same_origin, m.first_id % 3 = 0 and m.alternate_version as both_alternate,
          case when b1.content_id is null or b2.content_id is null then 'no raster image' end as error
        from m left join b b1 on b1.content_id = m.first_id left join b b2 on b2.content_id = m.content_id
          join f_origin o1 on o1.content_id = m.first_id join f_origin o2 on o2.content_id = m.content_id where m.imagehash_id <> m.first_id""",
)
def compare_pairs(i: Inputs):
    pairs = duplicates.review_pairs(duplicates.duplicate_members(i.f_imagehash, "low"))
    return duplicates.compare_pairs(pairs, i.f_imagehash, i.f_representation, i.f_origin)


@query(
    "mark_alternates",
    """with m as (select event_id // 25 as imagehash_id, arg_max(event_type = 'view', (ts, event_type = 'view')) as alternate from events group by event_id // 25)
       select h.imagehash_id, h.content_id, coalesce(m.alternate, h.alternate_version) as alternate_version
       from f_imagehash h left join m on m.imagehash_id = h.imagehash_id""",
)
def mark_alternates(i: Inputs):
    marks = i.events.select(
        F.floor(F.col("event_id") / 25).alias("imagehash_id"), F.col("ts").alias("decided_at"),
        (F.col("event_type") == "view").alias("alternate"),
    )
    marked = duplicates.mark_alternates(i.f_imagehash, marks)
    return marked.select("imagehash_id", "content_id", "alternate_version")


@query(
    "hash_list",
    """select imagehash_id, h.content_id, aspect_ratio, lower(hex(l_hash)) as l_hash, lower(hex(a_hash)) as a_hash, lower(hex(b_hash)) as b_hash, alternate_version
       from f_imagehash h join f_content c on c.content_id = h.content_id where not alternate_version and (lower(title) like '%urgent%' or lower(slug) like '%urgent%')""",
)
def hash_list(i: Inputs):
    return duplicates.hash_list(i.f_imagehash, i.f_content, False, "URGENT")


# Chains of up to twenty merges, and pairs that merge into each other with a chain leading into them.
CHAINS = "select o_orderkey as source_id, case when o_orderkey % 32 = 31 then o_orderkey - 1 else o_orderkey + 1 end as target_id from orders where o_orderkey % 32 <> 20"


@query(
    "merge_chains",
    f"""with recursive p as materialized ({CHAINS}),
          w as (select source_id, target_id, 1 as steps from p
            union all select w.source_id, p.target_id, steps + 1 from w join p on p.source_id = w.target_id where steps < 40),
          e as (select source_id, target_id from w where target_id not in (select source_id from p))
        select p.source_id, e.target_id, case when e.source_id is null then 'cycle' else 'ok' end as status from p left join e on e.source_id = p.source_id""",
)
def merge_chains(i: Inputs):
    pairs = i.spark.sql(CHAINS.replace("from orders", "from {orders}"), orders=i.orders)
    found = merge.resolve_merge_chains(pairs)
    return found.withColumn("target_id", F.when(F.col("status") == "ok", F.col("target_id")))


MAP = "m as (select source_id, case when source_id % 10 = 1 then source_id + 2 else target_id end as target_id from f_merge)"


def resolved(i: Inputs):
    return merge.resolve_merge_chains(i.f_merge)


@query(
    "merge_tags",
    f"with {MAP} select distinct coalesce(m.target_id, content_id) as content_id, tag_id from f_content_tag left join m on m.source_id = content_id",
)
def merge_tags(i: Inputs):
    return merge.merge_tags(i.f_content_tag, resolved(i))


def wide_origin(i: Inputs):
    """Origins plus a second one per item that neighbours share."""
    extra = i.f_content.select(
        "content_id", F.lit("e621").alias("name"), F.floor(F.col("content_id") / 10).cast("string").alias("origin_id"),
        F.lit(False).alias("alternate"),
    ).filter("content_id % 10 in (1, 3)")
    return i.f_origin.unionByName(extra)


@query(
    "merge_origins",
    f"""with {MAP}, o as (select content_id, name, origin_id, alternate from f_origin union all
          select content_id, 'e621', cast(content_id // 10 as varchar), false from f_content where content_id % 10 in (1, 3)),
        own as (select * from o where content_id not in (select source_id from m)),
        moved as (select distinct m.target_id as content_id, name, origin_id from o join m on m.source_id = content_id)
        select * from own union all select content_id, name, origin_id, true from moved
        where not exists (select 1 from own where own.content_id = moved.content_id and own.name = moved.name and own.origin_id = moved.origin_id)""",
)
def merge_origins(i: Inputs):
    return merge.merge_origins(wide_origin(i), resolved(i))


@query(
    "merge_albums",
    f"""with {MAP}, a as (select content_id // 40 as album_id, content_id, ord from f_album_order),
        own as (select * from a where content_id not in (select source_id from m)),
        moved as (select album_id, m.target_id as content_id, min(ord) as ord from a join m on m.source_id = content_id group by all)
        select * from own union all select * from moved where not exists (select 1 from own where own.album_id = moved.album_id and own.content_id = moved.content_id)""",
)
def merge_albums(i: Inputs):
    items = i.f_album_order.withColumn("album_id", F.floor(F.col("content_id") / 40))
    return merge.merge_albums(items, resolved(i))


@query(
    "merge_albums_all",
    f"""with {MAP}, a as (select album_id, content_id, ord from f_album_order
          union all select -1 - content_id // 40, content_id, ord from f_album_order),
        own as (select * from a where content_id not in (select source_id from m)),
        moved as (select album_id, m.target_id as content_id, min(ord) as ord from a join m on m.source_id = content_id group by all)
        select * from own union all select * from moved where not exists (select 1 from own where own.album_id = moved.album_id and own.content_id = moved.content_id)""",
)
def merge_albums_all(i: Inputs):
    """Every row in its own album, where targets are mostly absent, and in one of neighbours, where they are there."""
    items = i.f_album_order.select("album_id", "content_id", "ord")
    near = items.withColumn("album_id", -1 - F.floor(F.col("content_id") / 40))
    return merge.merge_albums(items.unionByName(near), resolved(i))


@query(
    "merge_redirects",
    f"""with {MAP} select old_slug, coalesce(m.target_id, new_content_id) as new_content_id, created_at, lower(hex(source_hash)) as source_hash
          from f_redirect left join m on m.source_id = new_content_id
        union all select slug, m.target_id, addition_date, lower(hex(source_hash)) from f_content join m on m.source_id = content_id""",
)
def merge_redirects(i: Inputs):
    made = merge.merge_redirects(i.f_redirect, i.f_content, resolved(i))
    return made.withColumn("source_hash", hashing.hex_text("source_hash"))


@query(
    "merge_collections",
    f"with {MAP} select distinct collection_id, coalesce(m.target_id, content_id) as content_id from f_collection_item left join m on m.source_id = content_id",
)
def merge_collections(i: Inputs):
    return merge.merge_content(i.f_merge, {"collection_item": i.f_collection_item})["collection_item"]


@query("merge_content", f"with {MAP} select content_id, title, slug from f_content where content_id not in (select source_id from m)")
def merge_content(i: Inputs):
    return merge.merge_content(i.f_merge, {"content": i.f_content})["content"].select("content_id", "title", "slug")


@query(
    "merge_task_results",
    f"with {MAP} select task_id, case when m.source_id is null then content_id end as content_id, source_file_size from f_result left join m on m.source_id = content_id",
)
def merge_task_results(i: Inputs):
    results = i.f_result.select("task_id", "content_id", "source_file_size")
    return merge.merge_content(i.f_merge, {"task_result": results})["task_result"]


def array_pairs(i: Inputs):
    """Each band with the one it was derived from."""
    base = i.f_band.filter("imagehash_id < 1000000").select(F.col("imagehash_id").alias("k"), F.col("band").alias("first"))
    derived = i.f_band.filter("imagehash_id >= 1000000").select(
        F.col("imagehash_id").alias("pair_id"), (F.col("imagehash_id") % 1000000).alias("k"), F.col("band").alias("second")
    )
    return derived.unionByName(base.select(F.col("k").alias("pair_id"), "k", F.col("first").alias("second"))).join(base, "k").drop("k")


PAIRS = """select b.imagehash_id as pair_id, a.band as first_, b.band as second_ from f_band a join f_band b
    on a.imagehash_id = b.imagehash_id % 1000000 where a.imagehash_id < 1000000"""


@query(
    "image_error",
    f"""with c as (select pair_id, unnest(first_) as x, unnest(second_) as y from ({PAIRS})),
        e as (select pair_id, avg((x - y) * (x - y)) as mse from c group by pair_id)
        select pair_id, case when pair_id % 9 <> 8 then round(sqrt(mse), 9) end as rmse,
          case when pair_id % 9 <> 8 then case when mse = 0 then 'inf' else format('{{:.6f}}', round(-10 * log10(mse), 6)) end end as psnr,
          case when pair_id % 9 = 8 then 'types differ' end as error from e""",
)
def image_error(i: Inputs):
    second_type = F.when(F.col("pair_id") % 9 == 8, "uint8").otherwise("float64")
    pairs = array_pairs(i).withColumns({"first_type": F.lit("float64"), "second_type": second_type})
    found = signatures.image_error(pairs)
    shown = F.when(F.col("psnr") == float("inf"), "inf").otherwise(F.format_string("%.6f", F.round("psnr", 6)))
    return found.select(
        "pair_id", F.round("rmse", 9).alias("rmse"), F.when(F.col("psnr").isNotNull(), shown).alias("psnr"), "error"
    )


@query(
    "diff_heatmap",
    f"""with c as (select pair_id, unnest(range(66)) as p, unnest(list_transform(list_concat(first_, list_slice(first_, 1, 2)), lambda v: floor(abs(v) * 200))) as x,
            unnest(list_transform(list_concat(second_, list_slice(second_, 1, 2)), lambda v: floor(abs(v) * 200))) as y from ({PAIRS})),
        s as (select pair_id, p // 3 as cell, cast(sum(abs(x - y)) as bigint) as heat from c group by pair_id, p // 3)
        select pair_id, cast(cell as int) as cell, cast(heat as int) as heat, cast(least(heat, 255) as int) as clipped from s""",
)
def diff_heatmap(i: Inputs):
    pixels = lambda c: F.transform(F.concat(F.col(c), F.slice(c, 1, 2)), lambda v: F.floor(F.abs(v) * 200).cast("double"))
    # The second image of every pair also gets an opaque alpha, which must not change anything.
    opaque = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.lit(21)),
            lambda n: F.concat(F.slice(pixels("second"), n * 3 + 1, 3), F.array(F.lit(255.0))),
        )
    )
    pairs = array_pairs(i).select(
        "pair_id", pixels("first").alias("first"), opaque.alias("second"),
        F.lit(11).alias("first_width"), F.lit(11).alias("second_width"), F.lit(2).alias("first_height"),
        F.lit(2).alias("second_height"), F.lit(3).alias("first_channels"), F.lit(4).alias("second_channels"),
    )
    found = signatures.diff_heatmap(pairs)
    cells = found.select("pair_id", F.posexplode(F.arrays_zip("heatmap", "clipped")).alias("cell", "v"))
    return cells.select("pair_id", "cell", F.col("v.heatmap").alias("heat"), F.col("v.clipped").alias("clipped"))
