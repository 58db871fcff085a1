"""Queries for the Column functions, each over whole views."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom import rules
from tagloom.fixtures import Inputs
from tagloom.functions import codecs, hashing, levels, names, origins, sizes, tags, text
from tagloom.workloads.registry import query


def case(key: str, table: dict, default: str = "null") -> str:
    """SQL for a fixed lookup table."""
    show = lambda x: f"'{x}'" if isinstance(x, str) else str(x)
    arms = " ".join(f"when {show(k)} then {show(v)}" for k, v in table.items())
    return f"case {key} {arms} else {default} end"


def in_list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


BARE = "trim(replace(lower(name), '_', ' '))"


@query(
    "tag_names",
    f"select distinct {BARE} as tag_name from (select '  ' || p_name || '_' || p_brand || ' ' as name from part)",
)
def tag_names(i: Inputs):
    raw = i.part.select(F.concat(F.lit("  "), "p_name", F.lit("_"), "p_brand", F.lit(" ")).alias("name"))
    return raw.select(tags.prepare_tag_name("name").alias("tag_name")).distinct()


@query(
    "tag_aliases",
    f"""with t as (select tag_id, case when category = 'style' then 'character' else category end as category,
          title || ' x' as title from f_tag),
        a as (select tag_id, case when category in {in_list(rules.PREFIXED_CATEGORIES)}
                then category || ': ' || title else title end as alias from t
              union select tag_id, case when category in {in_list(rules.PREFIXED_CATEGORIES)}
                then replace(category, '-', '_') || ':' || replace(title, ' ', '_')
                else replace(title, ' ', '_') end from t)
        select tag_id, alias from a""",
)
def tag_aliases(i: Inputs):
    t = i.f_tag.select(
        "tag_id",
        F.when(F.col("category") == "style", "character").otherwise(F.col("category")).alias("category"),
        F.concat("title", F.lit(" x")).alias("title"),
    )
    return t.select("tag_id", F.explode(tags.generate_aliases("title", "category")).alias("alias"))


@query(
    "size_relation",
    """select filepath, round(case when width::bigint * 256 >= 192 * height::bigint then width / 192.0::double
         else height / 256.0::double end, 9) as relation from f_representation""",
)
def size_relation(i: Inputs):
    relation = sizes.size_relation("width", "height", 192, 256)
    return i.f_representation.select("filepath", F.round(relation, 9).alias("relation"))


FORMAT_CASE = "case when width % 3 = 0 then 'JPEG' when width % 3 = 1 then 'WEBP' else 'AVIF' end"


@query(
    "image_level",
    f"""with x as (select filepath, width, height, {FORMAT_CASE} as fmt from f_representation),
        s as (select *, case when greatest(width, height) <= 1024 then 0 when greatest(width, height) <= 2048 then 1
                 when greatest(width, height) <= 4096 then 2 when greatest(width, height) <= 8192 then 3 else 4 end as sl from x)
        select filepath, case fmt when 'JPEG' then sl when 'WEBP' then greatest(sl, 1) else greatest(sl + 1, 2) end as level
        from s""",
)
def image_level(i: Inputs):
    fmt = F.when(F.col("width") % 3 == 0, "JPEG").when(F.col("width") % 3 == 1, "WEBP").otherwise("AVIF")
    return i.f_representation.select("filepath", levels.image_level("width", "height", fmt).alias("level"))


RATE = "case when avg_frame_rate = '0/0' then r_frame_rate else avg_frame_rate end"
FPS_PARTS = f"""select *, cast(split_part({RATE}, '/', 1) as bigint) as num,
    case when contains({RATE}, '/') then cast(split_part({RATE}, '/', 2) as bigint) else 1 end as den from f_media"""


@query(
    "fps",
    f"""with x as ({FPS_PARTS}), y as (select *, den * 2 as lower from x)
        select file_id, stream_no, num, den, round(num / den::double, 9) as fps,
          case when contains(avg_frame_rate, '/') then
            case when lower // gcd(num, lower) = 1 then cast(num // gcd(num, lower) as varchar)
              else cast(num // gcd(num, lower) as varchar) || '/' || cast(lower // gcd(num, lower) as varchar) end
            else format('{{:.3f}}', num / 2.0::double) end as halved
        from y""",
)
def fps(i: Inputs):
    rate = i.f_media.withColumn("r", codecs.stream_fps("avg_frame_rate", "r_frame_rate"))
    return rate.select(
        "file_id", "stream_no", F.col("r.num").alias("num"), F.col("r.den").alias("den"),
        F.round("r.value", 9).alias("fps"),
        codecs.format_fps("r.num", "r.den", F.lit(1), F.col("avg_frame_rate").contains("/")).alias("halved"),
    )


@query(
    "video_loop",
    """with x as (select *, case when stream_no % 3 = 0 then null else duration end as known,
                    case when stream_no % 6 = 0 then null else duration + 1 end as guess,
                    case when audio_codec is null then 0 else 1 end as sounds from f_media)
       select file_id, stream_no,
         case when sounds > 0 then false else coalesce(known, guess) <= 30 end as is_loop,
         case when sounds = 0 and known is null and guess is null then 'no duration' end as error from x""",
)
def video_loop(i: Inputs):
    known = F.when(F.col("stream_no") % 3 != 0, F.col("duration"))
    guess = F.when(F.col("stream_no") % 6 != 0, F.col("duration") + 1)
    loop = codecs.is_loop(F.col("audio_codec").isNotNull().cast("int"), known, guess)
    return i.f_media.select("file_id", "stream_no", loop.value.alias("is_loop"), loop.error.alias("error"))


CODECS = f"""select *, {case("lower(codec_name)", rules.VIDEO_CODECS, "'UNDEFINED'")} as v,
    case when audio_codec is null then null else {case("lower(audio_codec)", rules.AUDIO_CODECS, "'UNDEFINED'")} end as a
    from f_media"""


def with_codecs(df):
    return df.withColumns({"v": codecs.video_codec("codec_name"), "a": codecs.audio_codec("audio_codec")})


@query(
    "container_fit",
    f"""with x as ({CODECS}) select file_id, stream_no, v as video, a as audio,
          v = 'H264' and (a is null or a in ('AAC', 'Opus')) as mp4,
          v in ('VP8', 'VP9', 'AV1') and (a is null or a in ('Vorbis', 'Opus')) as webm from x""",
)
def container_fit(i: Inputs):
    return with_codecs(i.f_media).select(
        "file_id", "stream_no", F.col("v").alias("video"), F.col("a").alias("audio"),
        codecs.container_fit("MP4", "v", "a").alias("mp4"), codecs.container_fit("WEBM", "v", "a").alias("webm"),
    )


BITS = case("pix_fmt", rules.BITS_BY_PIXEL_FORMAT)


@query(
    "pixel_format",
    f"""select file_id, stream_no, pix_fmt like '%yuva%' as has_alpha, {BITS} as bit_depth from f_media""",
)
def pixel_format(i: Inputs):
    return i.f_media.select(
        "file_id", "stream_no", codecs.has_alpha("pix_fmt").alias("has_alpha"),
        codecs.bit_depth("pix_fmt").alias("bit_depth"),
    )


LEVEL_ARMS = " ".join(
    f"when v = '{c}' and greatest(width, height) <= {longest} and fps <= {rate * 1.0125}::double and bits <= {bits} then {lv}"
    for c, lv, longest, _, rate, bits, _ in sorted(rules.VIDEO_LEVELS, key=lambda r: r[1])
)
LEVELS_SQL = f"""select *, case when bits is null then 100 else greatest(
      case when v = 'VP9' then greatest(vl, 2) else vl end,
      case when a is null then 0 when a = 'AAC' then 0 when a in ('Vorbis', 'Opus') then 1 else 100 end) end as level_
    from (select *, case {LEVEL_ARMS} else 4 end as vl from
      (select c.*, {BITS} as bits, p.num / p.den::double as fps from ({CODECS}) c
         join (select file_id, num, den from ({FPS_PARTS})) p on c.file_id = p.file_id) q) r"""


@query("video_level", f"with z as ({LEVELS_SQL}) select file_id, stream_no, width, level_ as level from z")
def video_level(i: Inputs):
    rate = codecs.stream_fps("avg_frame_rate", "r_frame_rate").value
    level = codecs.media_level("v", "a", "width", "height", rate, codecs.bit_depth("pix_fmt"))
    return with_codecs(i.f_media).select("file_id", "stream_no", "width", level.alias("level"))


@query(
    "codec_string",
    f"""with x as (select *, {BITS} as bits, case when stream_no % 2 = 0 then 'HE-AAC' end as ap,
            case when level is null then null when length(cast(level as varchar)) < 2 then '0' || level else cast(level as varchar) end as lt
          from ({CODECS})),
        y as (select *, case v
            when 'H264' then case when profile is null or level is null then 'avc1'
              else 'avc1.6400' || case when level < 0 then '-' || lower(to_hex(-level)) else lpad(lower(to_hex(level)), 2, '0') end end
            when 'VP9' then case when profile is null or level is null or bits is null or level = -99 then 'vp09'
              else 'vp09.' || case when profile = 'Profile 1' then '01' else '00' end || '.' || lt || '.' || lpad(cast(bits as varchar), 2, '0') end
            when 'AV1' then case when profile is null or level is null or bits is null or level = -99 then 'av01'
              else 'av01.' || case when profile = 'High' then '1' else '0' end || '.' || lt || 'M.' || lpad(cast(bits as varchar), 2, '0') end
            when 'VP8' then 'vp8' end as vs,
          case a when 'AAC' then case when ap is not null then 'mp4a.40.5' end when 'Opus' then 'opus' when 'Vorbis' then 'vorbis' end as s from x)
        select file_id, stream_no, concat_ws(',', vs, s) as codec_string from y""",
)
def codec_string(i: Inputs):
    sound = F.when(F.col("stream_no") % 2 == 0, "HE-AAC")
    return with_codecs(i.f_media).select(
        "file_id", "stream_no",
        codecs.codec_string("v", "profile", "level", codecs.bit_depth("pix_fmt"), "a", sound).alias("codec_string"),
    )


@query(
    "bit_round",
    """select l_orderkey, l_linenumber, l_partkey, round_even(l_discount * 32, 0)::double / 32 as fine,
         round_even(l_quantity, 0)::double as whole,
         round_even(l_quantity / 2, 0)::double * 2 as even, round_even(l_extendedprice / 4, 0)::double * 4 as quads
       from lineitem""",
)
def bit_round(i: Inputs):
    return i.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", sizes.bit_round("l_discount", 5).alias("fine"),
        sizes.bit_round("l_quantity", 0).alias("whole"), sizes.bit_round("l_quantity", -1).alias("even"),
        sizes.bit_round("l_extendedprice", -2).alias("quads"),
    )


def even(x: str) -> str:
    return f"cast(round_even(({x}) / 2.0::double, 0) * 2 as int)"


SCALE_SQL = f"""
    with s as (select filepath, width, height, height <= width as wide, greatest(width, height)::double as l,
                 least(width, height)::double as m from f_representation),
      f as (select *, case when m <= 480 then {even("l")} else {even("l / (m / 480)")} end as fl,
              case when m <= 480 then {even("m")} else 480 end as fm,
              case when l <= 1080 then {even("l")} else 1080 end as il,
              case when l <= 1080 then {even("m")} else {even("m / (l / 1080)")} end as im from s),
      g as (select *, fl <= 1080 and fm <= 480 as ok from f)
    select filepath, case when wide then case when ok then fl else il end else case when ok then fm else im end end as w,
      case when wide then case when ok then fm else im end else case when ok then fl else il end end as h from g"""


@query("scale_down", SCALE_SQL)
def scale_down(i: Inputs):
    size = sizes.scale_down("width", "height", 480, 1080)
    return i.f_representation.select("filepath", size.w.alias("w"), size.h.alias("h"))


@query(
    "fit_in_rect",
    """with s as (select filepath, width, height, case when width > 1024 or height > 512 then
           case when width / height::double > 1 then width / 1024.0::double else height / 512.0::double end else 1.0::double end as scale
         from f_representation)
       select filepath, round(scale, 9) as scale, cast(round_even(width / scale, 0) as int) as w,
         cast(round_even(height / scale, 0) as int) as h from s""",
)
def fit_in_rect(i: Inputs):
    fit = sizes.fit_in_rect("width", "height", 1024, 512)
    return i.f_representation.select(
        "filepath", F.round(fit.scale, 9).alias("scale"), fit.w.alias("w"), fit.h.alias("h")
    )


@query(
    "source_hash",
    "select doc_id, sha256(text) as source_hash from documents",
)
def source_hash(i: Inputs):
    return i.documents.select("doc_id", hashing.hex_text(hashing.source_hash("text")).alias("source_hash"))


@query(
    "hash_prefix",
    """select imagehash_id, lower(substr(hex(l_hash), 1, 8) || substr(hex(a_hash), 1, 4) || substr(hex(b_hash), 1, 4)) as search_similar,
         lower(substr(hex(l_hash), 1, 4) || substr(hex(a_hash), 1, 2) || substr(hex(b_hash), 1, 2)) as far_similarity
       from f_imagehash""",
)
def hash_prefix(i: Inputs):
    keys = ("l_hash", "a_hash", "b_hash")
    return i.f_imagehash.select(
        "imagehash_id", hashing.hex_text(hashing.search_similar(*keys)).alias("search_similar"),
        hashing.hex_text(hashing.far_similarity(*keys)).alias("far_similarity"),
    )


@query(
    "luma",
    """select vec_id, cast(p as int) as p, round(0.2126::double * embedding[p + 1]::double + 0.7152::double * embedding[(p + 1) % 64 + 1]::double
         + 0.0722::double * embedding[(p + 2) % 64 + 1]::double, 9) as luma from (select vec_id, embedding, unnest(range(64)) as p from embeddings)""",
)
def luma(i: Inputs):
    e = F.col("embedding").cast("array<double>")
    at = lambda p, n: F.get(e, (p + n) % 64)
    pixels = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda p: F.round(hashing.luma(e[p], at(p, 1), at(p, 2)), 9))
    return i.embeddings.select("vec_id", F.posexplode(pixels).alias("p", "luma"))


@query(
    "origin_parse",
    r"""select content_id, case name
          when 'derpibooru' then regexp_extract(url, '/images/([^?]*)', 1)
          when 'twitter' then case when regexp_matches(url, '^https://x\.com/[^/]+/status/[0-9]+')
             then regexp_replace(regexp_extract(url, 'x\.com/(.*)$', 1), '^(.*)/status/([0-9]+)/photo/([0-9]+)$', '\1#\2#\3') end
          else case when regexp_matches(url, '/[^/]+/[0-9]+$')
             then regexp_replace(regexp_extract(url, 't\.me/(.*)$', 1), '^([^/]+)/([0-9]+)$', '\1#\2') end end as origin_id
        from f_url""",
)
def origin_parse(i: Inputs):
    return i.f_url.select("content_id", origins.parse_origin_url("name", "url").alias("origin_id"))


@query(
    "origin_url",
    """select content_id, case name when 'derpibooru' then 'https://derpibooru.org/images/' || origin_id
         when 'twitter' then case when origin_id <> '' then 'https://x.com/' || replace(origin_id, '#', '/status/') end
         else case when origin_id <> '' then 'https://t.me/' || replace(origin_id, '#', '/') end end as url
       from f_origin""",
)
def origin_url(i: Inputs):
    return i.f_origin.select("content_id", origins.origin_url("name", "origin_id").alias("url"))


@query(
    "filenames",
    f"""select file_id, lang_part || ' file.' || file_id || {case("mime_type", rules.SUFFIX_BY_MIME)} as file_name
        from (select *, split_part(split_part(name, '/', 2), ' ', 1) as lang_part from f_file)""",
)
def filenames(i: Inputs):
    return i.f_file.select("file_id", names.normalise_filename("name", "mime_type", "file_id").alias("file_name"))


@query(
    "media_format",
    f"""select file_id, {case("mime_type", rules.FORMAT_BY_MIME)} as format, {case("mime_type", rules.SUFFIX_BY_MIME)} as suffix
        from f_file""",
)
def media_format(i: Inputs):
    fmt = levels.media_format_of_mime("mime_type")
    return i.f_file.select(
        "file_id", fmt.alias("format"), names.lookup(fmt, rules.SUFFIX_BY_FORMAT).alias("suffix")
    )


def size_sql(x: str) -> str:
    return f"""case when {x} >= 1073741824 then format('{{:.2f}} GiB', ({x}) / 1073741824.0::double)
      when {x} >= 1048576 then format('{{:.2f}} MiB', ({x}) / 1048576.0::double)
      when {x} >= 1024 then format('{{:.2f}} KiB', ({x}) / 1024.0::double) else cast({x} as varchar) || ' bytes' end"""


@query(
    "format_size",
    f"select distinct n, {size_sql('n')} as shown from (select source_file_size // 64 * (content_id % 40) as n from f_result)",
)
def format_size(i: Inputs):
    n = i.f_result.select(
        (F.floor(F.col("source_file_size") / 64) * (F.col("content_id") % 40)).alias("n")
    ).distinct()
    return n.select("n", text.format_size("n").alias("shown"))
