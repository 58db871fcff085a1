"""Catalog-shaped views over the given tables, as SQL both engines can run."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_L, _S, _I, _D, _TS = T.LongType(), T.StringType(), T.IntegerType(), T.DoubleType(), T.TimestampNTZType()


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in columns.items()])


TABLES: dict[str, T.StructType] = {
    "region": _schema(r_regionkey=_I, r_name=_S),
    "nation": _schema(n_nationkey=_I, n_name=_S, n_regionkey=_I),
    "customer": _schema(c_custkey=_L, c_name=_S, c_nationkey=_I, c_acctbal=_D, c_mktsegment=_S),
    "supplier": _schema(s_suppkey=_L, s_name=_S, s_nationkey=_I, s_acctbal=_D),
    "part": _schema(p_partkey=_L, p_name=_S, p_brand=_S, p_type=_S, p_size=_I, p_retailprice=_D),
    "orders": _schema(
        o_orderkey=_L, o_custkey=_L, o_orderstatus=_S, o_totalprice=_D, o_orderdate=_TS,
        o_orderpriority=_S,
    ),
    "lineitem": _schema(
        l_orderkey=_L, l_partkey=_L, l_suppkey=_L, l_linenumber=_I, l_quantity=_D,
        l_extendedprice=_D, l_discount=_D, l_tax=_D, l_returnflag=_S, l_linestatus=_S,
        l_shipdate=_TS,
    ),
    "events": _schema(event_id=_L, ts=_TS, user_id=_L, event_type=_S, value=_D, props=_S),
    "documents": _schema(doc_id=_L, text=_S, lang=_S, source=_S, n_chars=_L),
    "embeddings": _schema(vec_id=_L, embedding=T.ArrayType(T.FloatType()), label=_I),
}


@dataclass(frozen=True)
class Dialect:
    """The few spots where the two engines spell things differently."""

    duck: bool

    def sha(self, x: str) -> str:
        return f"unhex(sha256({x}))" if self.duck else f"unhex(sha2({x}, 256))"

    def sha_hex(self, x: str) -> str:
        return f"sha256({x})" if self.duck else f"sha2({x}, 256)"

    def number(self, x: str) -> str:
        """A 60-bit number from the digest of a string."""
        digits = f"substr(md5({x}), 1, 15)"
        return f"cast('0x' || {digits} as bigint)" if self.duck else f"cast(conv({digits}, 16, 10) as bigint)"

    def each(self, *pairs: tuple[str, str]) -> str:
        """One row per (title, category), as a struct."""
        if self.duck:
            return "unnest([" + ", ".join(f"{{'title': {t}, 'category': {c}}}" for t, c in pairs) + "])"
        return "explode(array(" + ", ".join(f"named_struct('title', {t}, 'category', {c})" for t, c in pairs) + "))"

    def day(self, x: str) -> str:
        return f"strftime({x}, '%Y-%m-%d')" if self.duck else f"date_format({x}, 'yyyy-MM-dd')"

    def doubles(self, x: str) -> str:
        return f"cast({x} as double[])" if self.duck else f"cast({x} as array<double>)"

    def scaled(self, x: str, k: int) -> str:
        if self.duck:
            return f"list_transform({self.doubles(x)}, lambda x: x * {k})"
        return f"transform({self.doubles(x)}, x -> x * {k})"

    def raised(self, x: str) -> str:
        """The array with its last entry changed."""
        if self.duck:
            return f"list_concat(list_slice({self.doubles(x)}, 1, 63), [9.5::double])"
        return f"concat(slice({self.doubles(x)}, 1, 63), array(9.5D))"


def views(d: Dialect) -> dict[str, str]:
    """View name -> select text, each using only tables and views above it."""
    tag_id = d.number("category || ':' || title")
    return {
        "f_content": f"""
            select o_orderkey as content_id, o_orderpriority as title,
              case when o_orderkey % 4 = 0 then 'video' when o_orderkey % 4 = 1 then 'video-loop'
                   else 'image' end as content_type,
              '' as description, o_orderdate as addition_date, o_orderstatus = 'P' as is_hidden,
              {d.sha("cast(o_orderkey as string)")} as source_hash,
              {d.day("o_orderdate")} || '-' || {d.sha_hex("cast(o_orderkey as string)")} as slug
            from orders""",
        "f_tag_name": f"""
            select content_id, t.title as title, t.category as category from (
              select l_orderkey as content_id, {d.each(
                  ("lower(p_type)", "'content'"), ("lower(p_brand)", "'creator'"),
                  ("split_part(p_name, ' ', 1)", "'style'"))} as t
              from lineitem join part on l_partkey = p_partkey) x
            union select o_orderkey, case when o_totalprice < 200000 then 'safe' else o_orderstatus end, 'rating'
              from orders where o_totalprice < 200000
            union select o_orderkey, 'set ' || cast(o_custkey as string), 'set' from orders
              where o_orderkey % 5 < 3 and o_custkey % 3 = 0""",
        # Numbers are worked out once per part; with the category they tell rows apart as names do.
        "f_content_tag": f"select content_id, {tag_id} as tag_id from f_tag_name" if d.duck else f"""
            select content_id, tag_id from (
              select content_id, n.category, n.tag_id from (
                select l_orderkey as content_id, named from lineitem join (
                  select p_partkey, array(
                    named_struct('category', 1, 'tag_id', {d.number("'content:' || lower(p_type)")}),
                    named_struct('category', 2, 'tag_id', {d.number("'creator:' || lower(p_brand)")}),
                    named_struct('category', 3, 'tag_id', {d.number("'style:' || split_part(p_name, ' ', 1)")})) as named
                  from part) on l_partkey = p_partkey) lateral view explode(named) as n
              union select o_orderkey, 4, {d.number("'rating:' || case when o_totalprice < 200000 then 'safe' else o_orderstatus end")}
                from orders where o_totalprice < 200000
              union select o_orderkey, 5, {d.number("'set:set ' || cast(o_custkey as string)")} from orders
                where o_orderkey % 5 < 3 and o_custkey % 3 = 0) x""",
        "f_tag": f"""
            select {tag_id} as tag_id, title, category from (
              select lower(p_type) as title, 'content' as category from part
              union select lower(p_brand), 'creator' from part
              union select split_part(p_name, ' ', 1), 'style' from part
              union select case when r_regionkey >= 0 then 'safe' else r_name end, 'rating' from region
              union select 'set ' || cast(c_custkey as string), 'set' from customer where c_custkey % 3 = 0) t""",
        "f_alias": """
            select min(tag_id) as tag_id, title from (
              select tag_id, case when category in ('creator', 'set') then category || ': ' || title
                                  else title end as title from f_tag
              union select tag_id, case when category in ('creator', 'set')
                     then category || ':' || replace(title, ' ', '_') else replace(title, ' ', '_') end
                from f_tag) a
            group by title""",
        "f_implication": """
            select lower(c_name) as target, lower(n_name) as implicate from customer join nation on c_nationkey = n_nationkey
            union all select lower(s_name), lower(n_name) from supplier join nation on s_nationkey = n_nationkey
            union all select lower(n_name), lower(r_name) from nation join region on n_regionkey = r_regionkey
            union all select lower(r_name), 'world' from region
            union all select distinct 'loop a', 'loop b' from region
            union all select distinct 'loop b', 'loop a' from region""",
        "f_tag_edge": f"""
            select distinct {d.number("'style:' || split_part(p_name, ' ', 1)")} as target,
              {d.number("'content:' || lower(p_type)")} as implicate from part where p_partkey % 7 = 0
            union select distinct {d.number("'content:' || lower(p_type)")}, {d.number("'rating:safe'")} from part
              where p_size > 45""",
        "f_origin": """
            select o_orderkey as content_id,
              case o_custkey % 3 when 0 then 'derpibooru' when 1 then 'twitter' else 'telegram' end as name,
              case when o_orderkey % 10 = 0 then ''
                   when o_custkey % 3 = 0 then cast(o_orderkey * 7 as string)
                   else 'user' || cast(o_custkey as string) || '#' || cast(o_orderkey as string) end as origin_id,
              o_orderkey % 3 = 0 as alternate
            from orders""",
        "f_url": """
            select content_id, name,
              case name when 'derpibooru' then 'https://derpibooru.org/images/' || origin_id || '?q=1'
                when 'twitter' then 'https://x.com/' || replace(origin_id, '#', '/status/') || '/photo/2'
                else 'https://t.me/' || replace(origin_id, '#', '/') end as url
            from f_origin""",
        "f_redirect": f"""
            select 'old-' || cast(o_orderkey as string) as old_slug, o_orderkey as new_content_id,
              o_orderdate as created_at, {d.sha("'old-' || cast(o_orderkey as string)")} as source_hash
            from orders where o_orderkey % 11 = 0""",
        "f_representation": """
            select distinct l_orderkey as content_id,
              cast(l_orderkey as string) || '/' || cast(l_linenumber as string) || '_' || cast(l_partkey as string)
                || ' ' || cast(cast(l_quantity as int) as string) || lower(l_linestatus || l_returnflag) as filepath,
              case l_returnflag when 'N' then 'webp' when 'A' then 'avif' else 'svg' end as format,
              l_linenumber % 5 as compatibility_level,
              cast(l_quantity * 80 as int) as width,
              cast(l_quantity * (40 + 20 * l_linenumber) as int) as height,
              case when l_linestatus = 'F' then 10 else 20 end as repr_type
            from lineitem""",
        "f_request": """
            select o_orderkey as content_id, cast(o_orderkey % 5 as int) as clevel,
              case when o_orderkey % 3 = 0 then null else cast(128 * (1 + o_orderkey % 7) as int) end as target_width,
              case when o_orderkey % 3 = 0 then null else cast(256 * (1 + o_orderkey % 4) as int) end as target_height
            from orders""",
        "f_album": f"""
            select c_custkey as album_id, case when c_custkey % 4 = 0 then '' else c_name end as album_name,
              case when c_custkey % 3 = 0
                   then {d.number("'set:set ' || cast(c_custkey as string)")} end as set_tag_id,
              c_acctbal < 0 as is_nsfw from customer where c_custkey % 50 < 48""",
        "f_album_order": """
            select o_custkey as album_id, o_orderkey as content_id,
              (o_orderkey * 7919) % 1000003 + 1000003 * cast(floor(o_orderkey / 1000003) as bigint) as ord
            from orders""",
        "f_album_creator": f"""
            select distinct o_custkey as album_id, {d.number("'creator:' || lower(p_brand)")} as tag_id
            from orders join lineitem on o_orderkey = l_orderkey join part on l_partkey = p_partkey
            where o_custkey % 3 = 0 and l_linenumber = 1""",
        "f_collection": """
            select c_custkey as collection_id, cast(c_nationkey as bigint) as user_id, c_name as title,
              o.created_at, c_acctbal < 0 as is_nsfw
            from customer join (select o_custkey, min(o_orderdate) as created_at from orders group by o_custkey) o
              on o.o_custkey = c_custkey""",
        "f_collection_item": """
            select o_custkey as collection_id, o_orderkey as content_id from orders where o_orderstatus <> 'F'""",
        "f_edit": """
            select event_id as edit_id, user_id as collection_id, user_id * 10 + event_id % 5 as content_id,
              case when event_id % 6 = 0 then 99 else coalesce(cast(c_nationkey as bigint), 0) end as user_id, ts as edited_at,
              case event_type when 'view' then 'add' when 'click' then 'add' when 'error' then 'remove'
                when 'purchase' then 'toggle_nsfw' else 'add' end as action
            from events left join customer on c_custkey = user_id""",
        "f_edit_wide": "select * from f_edit",
        "f_merge": """
            select o_orderkey as source_id, o_orderkey + 1 as target_id from orders where o_orderkey % 10 in (1, 2)""",
        "f_prediction": """
            select l_orderkey as content_id, lower(p_type) as tag, l_discount * 4 as score
            from lineitem join part on l_partkey = p_partkey
            union all select l_orderkey, 'glow ' || lower(p_brand), l_tax * 8
            from lineitem join part on l_partkey = p_partkey where l_linenumber = 2""",
        "f_task": f"""
            select event_id as task_id, ts as created_at, 'file_' || cast(event_id as string) || '.png' as uploaded_file,
              case when event_id % 4 = 0 then 'video' else 'image' end as media_type,
              case when event_id % 4 = 0 then 'video/webm' else 'image/png' end as mime_type,
              {d.sha("cast(cast(floor(event_id / 5) as bigint) as string)")} as source_hash,
              cast(event_id % 5 as int) as status, value > 20 as rewrite,
              event_type as origin_name, case when event_id % 9 = 0 then '' else cast(user_id as string) end as origin_id
            from events""",
        "f_task_wide": f"""
            select event_id as task_id, 'file_' || cast(event_id as string) || '.png' as uploaded_file,
              {d.sha("cast(cast(floor(event_id / 5) as bigint) as string)")} as source_hash,
              cast(event_id % 7 % 5 as int) as status, value > 20 as rewrite
            from events""",
        "f_task_json": """
            select event_id as task_id,
              case when event_id % 50 = 7 then '{"title": '
                else '{"title": "Piece ' || cast(event_id as string) || '", "origin_name": "derpibooru", "origin_id": "'
                  || cast(user_id as string) || '", "tags": {"artist": ["name_' || cast(event_id % 37 as string)
                  || '"], "unknown cat": ["Some_Tag", "some tag"], "style": ["' || event_type || '"]}'
                  || case when event_id % 4 = 0 then ', "rewrite": true' else '' end || '}' end as body
            from events""",
        "f_file": f"""
            select doc_id as file_id, {d.sha("text")} as source_hash, n_chars as size,
              case lang when 'en' then 'image/png' when 'de' then 'image/jpeg' when 'fr' then 'video/webm'
                else 'video/quicktime' end as mime_type,
              source || '/' || lang || ' file.' || cast(doc_id as string) || '.dat' as name,
              case when doc_id % 3 = 0 then 'derpibooru' else '' end as origin_name,
              'd' || cast(doc_id as string) as origin_id, doc_id % 17 = 0 as rewrite
            from documents""",
        "f_result": """
            select l_orderkey * 8 + l_linenumber as task_id, l_orderkey as content_id,
              case l_linestatus when 'O' then 'image' else 'video' end as media_type,
              case l_returnflag when 'N' then null else l_returnflag end as mime_type,
              cast(floor(l_extendedprice * 100) as bigint) as source_file_size,
              cast(floor(l_extendedprice * (100 - 20 * l_discount + 100 * l_tax)) as bigint) as result_file_size
            from lineitem""",
        "f_media": """
            select cast(l_orderkey as string) || '-' || cast(l_linenumber as string) || '-' || cast(l_partkey as string)
                || '-' || cast(l_suppkey as string) || '-' || cast(cast(l_quantity as int) as string) as file_id,
              l_linenumber * 100000 + cast(l_partkey % 100000 as int) as stream_no,
              cast(l_quantity * 80 as int) as width,
              cast(l_quantity * case when l_partkey % 5 = 0 then 120 else 45 end as int) as height,
              case when l_linenumber = 7 then '0/0'
                   when l_linenumber % 2 = 0 then cast(l_linenumber * 12000 as string) || '/1001'
                   else cast(l_linenumber * 12 as string) end as avg_frame_rate,
              '30/1' as r_frame_rate,
              case when l_suppkey % 11 = 0 then 'VP8' when l_returnflag = 'N' then 'h264'
                   when l_returnflag = 'A' then 'vp9' else 'av1' end as codec_name,
              case when l_suppkey % 7 = 0 then 'yuva420p' when l_linestatus = 'O' then 'yuv420p'
                   else 'yuv420p10le' end as pix_fmt,
              case l_linenumber % 3 when 0 then null when 1 then 'aac' else 'opus' end as audio_codec,
              case when l_suppkey % 13 = 0 then null else cast(cast(l_tax * 1000 as int) as double) end as duration,
              case when l_linenumber = 5 then null when l_suppkey % 2 = 0 then 'High' else 'Profile 1' end as profile,
              case when l_linenumber = 6 then -99 when l_linenumber = 4 then null else 31 + l_linenumber end as level,
              case when l_partkey % 9 = 0 then 'image/gif' when l_partkey % 9 = 1 then 'image/png'
                   when l_returnflag = 'N' then 'video/mp4' when l_returnflag = 'A' then 'video/webm'
                   else 'video/quicktime' end as mime_type,
              case when l_suppkey % 4 = 0 then 'cover.jpg' when l_suppkey % 4 = 1 then 'other.png' end as picture
            from lineitem""",
        # Two frames for some animated images; durations that differ for every third part.
        "f_media_frame": """
            select cast(l_orderkey as string) || '-' || cast(l_linenumber as string) || '-' || cast(l_partkey as string)
                || '-' || cast(l_suppkey as string) || '-' || cast(cast(l_quantity as int) as string) as file_id, 0 as frame_no, 0.04 as duration_time
              from lineitem where l_partkey % 9 < 2
            union all
            select cast(l_orderkey as string) || '-' || cast(l_linenumber as string) || '-' || cast(l_partkey as string)
                || '-' || cast(l_suppkey as string) || '-' || cast(cast(l_quantity as int) as string), 1, case when l_partkey % 3 = 0 then 0.08 else 0.04 end
              from lineitem where l_partkey % 9 < 2 and l_quantity > 10""",
        "f_frame": """
            select user_id as file_id, event_id as frame_no, value as duration_time from events
            union all select user_id + 1000000, event_id, 0.04 from events""",
        "f_listing": "select distinct filepath from f_representation",
        "f_referenced": "select distinct filepath from f_representation where compatibility_level <> 4",
        "f_band": f"""
            select vec_id as imagehash_id, {d.doubles("embedding")} as band, vec_id % 7 = 0 as alternate_version from embeddings
            union all select vec_id + 1000000, {d.scaled("embedding", 2)}, vec_id % 14 = 0 from embeddings where vec_id % 5 = 0
            union all select vec_id + 2000000, {d.raised("embedding")}, vec_id % 21 = 0 from embeddings where vec_id % 5 = 1""",
        # Hashes shaped like signatures: exact copies agree everywhere, documents alike in
        # language, source and length agree in the leading bytes only.
        "f_imagehash": f"""
            select doc_id as imagehash_id, doc_id as content_id,
              cast(n_chars as double) / 256 as aspect_ratio,
              unhex(substr({d.sha_hex("lang || cast(cast(floor(n_chars / 200) as bigint) as string)")}, 1, 4)
                || substr({d.sha_hex("lang || cast(cast(floor(n_chars / 50) as bigint) as string)")}, 1, 4)
                || substr({d.sha_hex("text")}, 1, 56)) as l_hash,
              unhex(substr({d.sha_hex("lang")}, 1, 2) || substr({d.sha_hex("source || lang")}, 1, 2)
                || substr({d.sha_hex("text")}, 1, 12)) as a_hash,
              unhex(substr({d.sha_hex("lang || 'b'")}, 1, 4) || substr({d.sha_hex("text")}, 13, 12)) as b_hash,
              doc_id % 3 = 0 as alternate_version
            from documents""",
        "f_user": "select cast(n_nationkey as bigint) as user_id, n_regionkey = 1 as is_member from nation",
    }


_NAMES = re.compile(r"\b(?:f_[a-z_]+|" + "|".join(TABLES) + r")\b")


def _needs(text: str, known: dict[str, str]) -> list[str]:
    return [n for n in dict.fromkeys(_NAMES.findall(text)) if n in known]


def duck_sql(select: str) -> str:
    """A select over ``f_*`` views as one statement over the given tables."""
    text = views(Dialect(duck=True))
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in _needs(text[name], text):
            visit(dep)
        order.append(name)

    for name in _needs(select, text):
        visit(name)
    if not order:
        return select
    ctes = ",\n".join(f"{n} as materialized ({text[n]})" for n in order)
    body = select.strip()
    if body.lower().startswith("with recursive "):
        return f"with recursive {ctes},\n{body[len('with recursive '):]}"
    if body.lower().startswith("with "):
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{body}"


class Inputs:
    """The given tables and the views over them, for one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._views = views(Dialect(duck=False))
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            self._made[name] = self._make(name)
        return self._made[name]

    def _make(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.schema(TABLES[name]).parquet(f"{self.sf_dir}/{name}.parquet")
        if name not in self._views:
            raise AttributeError(name)
        text = self._views[name].replace("{", "{{").replace("}", "}}")
        frames: dict[str, DataFrame] = {}

        def slot(match: re.Match[str]) -> str:
            dep = match.group(0)
            if dep not in self._views and dep not in TABLES:
                return dep
            frames[dep] = getattr(self, dep)
            return "{" + dep + "}"

        return self.spark.sql(_NAMES.sub(slot, text), **frames)
