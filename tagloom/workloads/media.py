"""Probe analysis over the views."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom import rules
from tagloom.fixtures import Inputs
from tagloom.operators import media
from tagloom.sources.json_inputs import parse_probe, parse_task_metadata, probe_streams
from tagloom.workloads.registry import query
from tagloom.workloads.scalars import LEVELS_SQL, case


def stored_probes(i: Inputs):
    """f_media as stored probe JSON: a video stream, maybe audio, maybe attached pictures."""
    no = lambda kind: F.lit(None).cast(kind)
    video = F.struct(
        F.lit(0).alias("index"), F.lit("video").alias("codec_type"), "codec_name", "profile", "level",
        "width", "height", "pix_fmt", "avg_frame_rate", "r_frame_rate",
        F.struct(F.lit(0).alias("attached_pic")).alias("disposition"),
        F.struct(no("string").alias("filename")).alias("tags"),
    )
    other = lambda index, kind, codec, attached, name: F.struct(
        F.lit(index).alias("index"), F.lit(kind).alias("codec_type"), codec.alias("codec_name"),
        no("string").alias("profile"), no("int").alias("level"), no("int").alias("width"), no("int").alias("height"),
        no("string").alias("pix_fmt"), no("string").alias("avg_frame_rate"), no("string").alias("r_frame_rate"),
        F.struct(F.lit(attached).alias("attached_pic")).alias("disposition"), F.struct(name.alias("filename")).alias("tags"),
    )
    streams = F.array_compact(
        F.array(
            video,
            F.when(F.col("audio_codec").isNotNull(), other(1, "audio", F.col("audio_codec"), 0, no("string"))),
            F.when(F.col("picture").isNotNull(), other(2, "video", F.lit("png"), 1, F.col("picture"))),
            F.when(F.col("picture").isNotNull(), other(3, "video", F.lit("png"), 1, F.lit("last.png"))),
        )
    )
    duration = F.col("duration").cast("string")
    return i.f_media.select(
        "file_id", "mime_type", F.split_part("mime_type", F.lit("/"), F.lit(1)).alias("media_type"),
        F.to_json(F.struct(F.struct(duration.alias("duration"), F.lit("128000").alias("bit_rate")).alias("format"), streams.alias("streams"))).alias("body"),
    )


def parsed(i: Inputs, fields=None):
    return parse_probe(stored_probes(i), "body", fields).drop("error")


def passport(i: Inputs):
    return media.media_passport(parsed(i, media.PASSPORT_FIELDS), media.frame_stats(i.f_media_frame))


@query(
    "probe_parse",
    """select file_id, 0 as index, 'video' as codec_type, codec_name, width, pix_fmt, duration as file_duration, 128000::bigint as bit_rate from f_media
       union all select file_id, 1, 'audio', audio_codec, null, null, duration, 128000 from f_media where audio_codec is not null
       union all select file_id, 2, 'video', 'png', null, null, duration, 128000 from f_media where picture is not null
       union all select file_id, 3, 'video', 'png', null, null, duration, 128000 from f_media where picture is not null""",
)
def probe_parse(i: Inputs):
    return probe_streams(parsed(i)).select(
        "file_id", "index", "codec_type", "codec_name", "width", "pix_fmt", "file_duration", "bit_rate"
    )


@query(
    "task_metadata",
    """select event_id as task_id, case when event_id % 50 = 7 then '' else 'Piece ' || event_id end as title, '' as description,
         case when event_id % 50 = 7 then '' else 'derpibooru' end as origin_name, case when event_id % 50 = 7 then '' else cast(user_id as varchar) end as origin_id,
         case when event_id % 50 = 7 then 0 else 3 end as categories, event_id % 50 <> 7 and event_id % 4 = 0 as rewrite,
         case when event_id % 50 = 7 then 'Invalid JSON in metadata field' end as error from events""",
)
def task_metadata(i: Inputs):
    tasks = parse_task_metadata(i.f_task_json, "body")
    return tasks.withColumn("categories", F.size("tags")).drop("tags")


@query(
    "frame_stats",
    """select file_id, cast(sum(cast(duration_time as decimal(18,6))) as double) as estimated_duration, min(duration_time) <> max(duration_time) as is_vfr,
         count(*) as frames from f_frame group by file_id""",
)
def frame_stats(i: Inputs):
    return media.frame_stats(i.f_frame)


FACTS = f"""
    z as ({LEVELS_SQL}),
    fr as (select file_id, cast(sum(cast(duration_time as decimal(18,6))) as double) as est, min(duration_time) <> max(duration_time) as vfr, count(*) as frames
           from f_media_frame group by file_id),
    y as (select z.*, fr.est, fr.vfr, fr.frames, {case("mime_type", rules.FORMAT_BY_MIME)} as format,
            split_part(mime_type, '/', 1) = 'video' or coalesce(frames, 0) > 1 as is_video,
            case when a is not null then false else coalesce(duration, est) <= 30 end as loop_,
            case when a is null and duration is null and est is null then 'no duration' end as err
          from z left join fr on fr.file_id = z.file_id),
    p as (select *, case when is_video and loop_ then 'video-loop' when is_video then 'video' else 'image' end as content_type,
            least(width, height) as min_size, greatest(width, height) as max_size,
            case when greatest(width, height) <= 1024 then 0 when greatest(width, height) <= 2048 then 1 when greatest(width, height) <= 4096 then 2
              when greatest(width, height) <= 8192 then 3 else 4 end as image_level from y),
    ps as (select file_id, mime_type, format, is_video, content_type, width, height, min_size, max_size, case when is_video then fps end as fps,
            case when is_video then v end as video_codec, case when is_video then a end as audio_codec,
            case when is_video then v = 'H264' and (a is null or a in ('AAC', 'Opus')) end as mp4,
            case when is_video then vfr end as is_vfr, case when is_video then bits end as bit_depth,
            case when is_video then level_ else image_level end as level, case when is_video then err end as error from p)"""

SHOWN = (
    "file_id", "format", "is_video", "content_type", "min_size", "max_size", "video_codec", "audio_codec", "mp4",
    "is_vfr", "bit_depth", "level", "error",
)


@query("media_passport", f"with {FACTS} select {', '.join(SHOWN)}, round(fps, 9) as fps from ps")
def media_passport(i: Inputs):
    return passport(i).select(*SHOWN, F.round("fps", 9).alias("fps"))


@query(
    "container_formats",
    f"""with {FACTS} select file_id, video_codec, audio_codec, case video_codec when 'H264' then 'MP4' when 'VP8' then 'WEBM' when 'VP9' then 'WEBM' when 'AV1' then 'WEBM' end as container,
          case video_codec when 'H264' then '.mp4' when 'VP8' then '.webm' when 'VP9' then '.webm' when 'AV1' then '.webm' end as suffix,
          case video_codec when 'H264' then 'video/mp4' when 'VP8' then 'video/webm' when 'VP9' then 'video/webm' when 'AV1' then 'video/webm' end as mime_type,
          case video_codec when 'H264' then 'AAC' when 'VP8' then 'Opus' when 'VP9' then 'Opus' when 'AV1' then 'Opus' end as container_audio,
          case audio_codec when 'AAC' then 'm4a' when 'Vorbis' then 'ogg' when 'Opus' then 'opus' end as audio_container,
          case audio_codec when 'AAC' then '.m4a' when 'Vorbis' then '.oga' when 'Opus' then '.opus' end as audio_suffix from ps""",
)
def container_formats(i: Inputs):
    return media.container_formats(passport(i))


BIG1 = "(min_size > 720 or max_size > 1280 or fps > 30)"
BIG2 = "(min_size > 1080 or max_size > 1920 or fps > 60)"
PLAN = f"""{FACTS},
    vid as (select *, case when content_type = 'video-loop' then case when video_codec = 'H264' and level <= 1 then 'copy' else 'loop' end
        when format = 'WEBM' then 'webm' when format = 'MPEG 4' and mp4 and level <= 1 then 'copy' else 'default' end as branch from ps where is_video),
    pl as (
      select file_id, 1 as k, level as target_level, 'MP4' as container, 'H264' as codec, 'copy' as action, null::int as max_kbps, null::int as quality from vid where branch = 'copy'
      union all select file_id, 2, 1, 'MP4', 'H264', 'encode', null, case when format = 'PNG' then 18 else 24 end from vid where branch = 'loop'
      union all select file_id, 3, 1, 'WEBM', 'VP9', 'encode', 5000, 32 from vid where branch in ('webm', 'default')
      union all select file_id, 4, 2, 'WEBM', video_codec, 'keep', null, null from vid where branch = 'webm' and level = 2
      union all select file_id, 5, 2, 'WEBM', 'VP9', 'encode', null, 24 from vid where ((branch = 'webm' and level <> 2) or branch = 'default') and {BIG1}
      union all select file_id, 6, 3, 'WEBM', video_codec, 'keep', null, null from vid where branch = 'webm' and level = 3
      union all select file_id, 7, 3, 'MP4', 'AV1', 'encode', 20000, 24 from vid where (branch = 'webm' and level not in (2, 3) and {BIG2}) or (branch = 'default' and (min_size > 720 or max_size > 1280))
      union all select file_id, 8, 4, 'MP4', 'AV1', 'encode', null, 24 from vid where (branch = 'webm' and level not in (2, 3) and {BIG2}) or (branch = 'default' and (min_size > 1080 or max_size > 1920))),
    plan as (select *, cast(row_number() over (partition by file_id order by k) - 1 as int) as step from pl)"""


@query("transcode_plan", f"with {PLAN} select file_id, step, target_level, container, codec, action, max_kbps, quality from plan")
def transcode_plan(i: Inputs):
    return media.transcode_plan(passport(i).filter("is_video"))


def _even(x: str) -> str:
    return f"cast(round_even(({x}) / 2.0::double, 0) * 2 as int)"


@query(
    "encode_settings",
    f"""with {PLAN},
        e as (select pl.*, s.width, s.height, s.min_size, s.max_size, s.fps, s.is_vfr,
            case when codec = 'H264' then 1920 when codec = 'VP9' and target_level = 1 then 1280 when codec = 'VP9' then 1920 when target_level = 3 then 1920 else 3840 end as lo,
            case when codec = 'H264' then 1080 when codec = 'VP9' and target_level = 1 then 720 when codec = 'VP9' then 1080 when target_level = 3 then 1080 else 2160 end as sh,
            case when codec = 'VP9' and target_level = 1 then 30 else 60 end as lim
          from plan pl join ps s on s.file_id = pl.file_id where action = 'encode'),
        f as (select *, max_size::double as l, min_size::double as m, height <= width as wide, least(6, case when max_size // 256 <= 1 then 0 else cast(floor(log2(max_size // 256)) as int) end) as t,
            case when fps <= lim * 1.05 then 0 when fps / 2 <= lim * 1.05 then 1 when fps / 4 <= lim * 1.05 then 2 else 3 end as halv from e),
        g as (select *, case when m <= sh then {_even('l')} else {_even('l / (m / sh)')} end as fl, case when m <= sh then {_even('m')} else sh end as fm,
            case when l <= lo then {_even('l')} else lo end as il, case when l <= lo then {_even('m')} else {_even('m / (l / lo)')} end as im from f),
        h as (select *, case when fl <= lo and fm <= sh then fl else il end as ol, case when fl <= lo and fm <= sh then fm else im end as om from g)
        select file_id, step, target_level, codec, quality, {_even('case when wide then ol else om end')} as out_width, {_even('case when wide then om else ol end')} as out_height,
          round(case when codec = 'H264' and is_vfr then 60 when codec = 'H264' then fps else fps / pow(2, halv) end, 9) as out_fps,
          cast(case when codec = 'H264' then case when is_vfr then 120 else round_even(fps, 0) * 2 end else round_even(fps * 10, 0) end as int) as gop,
          case when codec <> 'H264' then case when height > width then 0 else t end end as tile_columns,
          case when codec = 'VP9' then least(case when height > width then t else 0 end, 2) when codec = 'AV1' then case when height > width then t else 0 end end as tile_rows,
          case when codec = 'VP9' and target_level = 1 then 4000 when codec = 'AV1' and target_level = 3 then 19621 end as video_kbps_cap,
          case when codec = 'AV1' then case when min_size > 1080 then 5 else 4 end end as preset from h""",
)
def encode_settings(i: Inputs):
    settings = media.encode_settings(passport(i).filter("is_video"))
    return settings.withColumn("out_fps", F.round("out_fps", 9))


@query(
    "thumbnail_stream",
    """select file_id, case when picture is null then 0 when picture = 'cover.jpg' then 2 else 3 end as stream_index, picture is not null as is_attached,
         case when picture is null then duration * 0.1::double end as seek_from, case when picture is null then duration * 0.9::double end as seek_to,
         null::varchar as error from f_media""",
)
def thumbnail_stream(i: Inputs):
    return media.thumbnail_stream(parsed(i))
