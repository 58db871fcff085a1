"""Analysis of media files from stored probe results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom import rules
from tagloom.functions import codecs, sizes
from tagloom.functions.common import lookup
from tagloom.functions.levels import image_level, media_format_of_mime

# What ``media_passport`` reads of a probe.
PASSPORT_FIELDS = ("format.duration",) + tuple(
    f"streams.{name}"
    for name in (
        "codec_type", "codec_name", "profile", "level", "width", "height", "pix_fmt", "avg_frame_rate", "r_frame_rate",
    )
)
AIMED_KBPS = 2000  # target rate of the lowest VP9 rendition (fixed value)
_LEVEL = {(codec, level): (longest, shortest, fps, kbps) for codec, level, longest, shortest, fps, _, kbps in rules.VIDEO_LEVELS}


def frame_stats(frames: DataFrame) -> DataFrame:
    """Per file: estimated duration, frame count, and whether frame durations vary."""
    d = F.col("duration_time")
    exact = F.sum(d.cast("decimal(18,6)")).cast("double")
    return frames.groupBy("file_id").agg(
        exact.alias("estimated_duration"),
        (F.min(d) != F.max(d)).alias("is_vfr"),
        F.count(F.lit(1)).alias("frames"),
    )


def _streams(kind: str) -> Column:
    return F.filter("probe.streams", lambda s: s.codec_type == kind)


def media_passport(probes: DataFrame, frames: DataFrame) -> DataFrame:
    """One row of facts per probed file (file_id, mime_type, media_type, probe with ``PASSPORT_FIELDS`` at least).

    Animated image formats count as video when they have more than one frame. A video
    without a known or estimated duration, or without a usable frame rate, carries the
    reason in ``error``.
    """
    # Only the few facts of the first streams travel to the join, not whole probes.
    picked = probes.select(
        "file_id", "mime_type", "media_type",
        F.get(_streams("video"), F.lit(0)).alias("v"), F.get(_streams("audio"), F.lit(0)).alias("a"),
        F.size(_streams("audio")).alias("sounds"),
        F.col("probe.format.duration").try_cast("double").alias("duration"),
    ).withColumn("raw_rate", codecs.known_rate("v.avg_frame_rate", "v.r_frame_rate"))
    rate = codecs.parse_fps("raw_rate")
    base = picked.select(
        "file_id", "mime_type", "media_type", "sounds", "duration", "v.width", "v.height", "v.pix_fmt", "v.profile",
        F.col("v.level").alias("codec_level"), F.col("a.profile").alias("audio_profile"),
        media_format_of_mime("mime_type").alias("format"),
        rate["value"].alias("rate"), rate["error"].alias("rate_error"),
        codecs.video_codec("v.codec_name").alias("video_codec"),
        codecs.audio_codec("a.codec_name").alias("audio_codec"),
        codecs.bit_depth("v.pix_fmt").alias("bit_depth"),
    ).join(frames, "file_id", "left")
    animated = F.col("format").isin(*rules.ANIMATED_IMAGE_FORMATS) & (F.coalesce("frames", F.lit(0)) > 1)
    is_video = (F.col("media_type") == "video") | animated
    rows = base.withColumns(
        {"is_video": is_video, "loop": codecs.is_loop("sounds", "duration", "estimated_duration")}
    )
    level = F.when(
        F.col("is_video"),
        codecs.media_level("video_codec", "audio_codec", "width", "height", "rate", "bit_depth"),
    ).otherwise(image_level("width", "height", "format"))
    video_only = lambda c: F.when(F.col("is_video"), c)
    return rows.select(
        "file_id", "mime_type", "format", "is_video",
        F.when(F.col("loop.value") & F.col("is_video"), "video-loop")
        .when(F.col("is_video"), "video").otherwise("image").alias("content_type"),
        "width", "height",
        F.least("width", "height").alias("min_size"), F.greatest("width", "height").alias("max_size"),
        video_only(F.col("rate")).alias("fps"),
        video_only(F.col("video_codec")).alias("video_codec"),
        video_only(F.col("audio_codec")).alias("audio_codec"),
        video_only(codecs.container_fit("MP4", "video_codec", "audio_codec")).alias("mp4"),
        video_only(codecs.container_fit("WEBM", "video_codec", "audio_codec")).alias("webm"),
        video_only(F.col("duration")).alias("duration"),
        video_only(F.col("estimated_duration")).alias("estimated_duration"),
        video_only(F.col("is_vfr")).alias("is_vfr"),
        video_only(F.col("frames")).alias("frames"),
        video_only(codecs.has_alpha("pix_fmt")).alias("has_alpha"),
        video_only(F.col("bit_depth")).alias("bit_depth"),
        video_only(F.col("profile")).alias("profile"), video_only(F.col("codec_level")).alias("codec_level"),
        video_only(
            codecs.codec_string("video_codec", "profile", "codec_level", "bit_depth", "audio_codec", "audio_profile")
        ).alias("codec_string"),
        level.alias("level"),
        video_only(F.coalesce("loop.error", "rate_error")).alias("error"),
    )


def container_formats(passport: DataFrame) -> DataFrame:
    """(file_id, video_codec, ...) containers, suffixes and types that suit the codecs."""
    video, audio = F.col("video_codec"), F.col("audio_codec")
    pick = lambda i: {codec: home[i] for codec, home in rules.VIDEO_HOME.items()}
    sound = lambda i: {codec: home[i] for codec, home in rules.AUDIO_HOME.items()}
    return passport.select(
        "file_id", "video_codec", "audio_codec",
        lookup(video, pick(0)).alias("container"), lookup(video, pick(1)).alias("suffix"),
        lookup(video, pick(2)).alias("mime_type"), lookup(video, pick(3)).alias("container_audio"),
        lookup(audio, sound(0)).alias("audio_container"), lookup(audio, sound(1)).alias("audio_suffix"),
    )


def _action(level, container: str, codec, action: str, max_kbps: int | None = None, quality=None) -> Column:
    number = lambda x: x.cast("int") if isinstance(x, Column) else F.lit(x).cast("int")
    return F.struct(
        number(level).alias("target_level"), F.lit(container).alias("container"),
        (codec if isinstance(codec, Column) else F.lit(codec)).alias("codec"), F.lit(action).alias("action"),
        F.lit(max_kbps).cast("int").alias("max_kbps"), number(quality).alias("quality"),
    )


def _exceeds(codec: str, level: int, with_fps: bool) -> Column:
    longest, shortest, fps, _ = _LEVEL[(codec, level)]
    bigger = (F.col("min_size") > shortest) | (F.col("max_size") > longest)
    return bigger | (F.col("fps") > fps) if with_fps else bigger


def transcode_plan(passport: DataFrame, *facts: str) -> DataFrame:
    """Rows (file_id, step, target_level, container, codec, action, max_kbps, quality).

    ``passport`` rows are videos; columns named in ``facts`` stay with every step.
    Actions: copy the streams, keep the file, encode.
    """
    level = F.col("level")
    loop = F.col("content_type") == "video-loop"
    webm = ~loop & (F.col("format") == "WEBM")
    mp4 = ~loop & (F.col("format") == "MPEG 4")
    h264 = F.col("video_codec") == "H264"
    fits_mp4 = codecs.container_fit("MP4", "video_codec", "audio_codec")
    copied = (level <= 1) & ((loop & h264) | (mp4 & fits_mp4))
    looped = loop & ~copied
    default = ~loop & ~webm & ~copied
    steps = [
        (copied, _action(level, "MP4", "H264", "copy")),
        (
            looped,
            _action(1, "MP4", "H264", "encode", None, F.when(F.col("format") == "PNG", 18).otherwise(24)),
        ),
        (webm | default, _action(1, "WEBM", "VP9", "encode", _LEVEL[("VP9", 1)][3], 32)),
        (webm & (level == 2), _action(2, "WEBM", F.col("video_codec"), "keep")),
        (
            ((webm & (level != 2)) | default) & _exceeds("VP9", 1, True),
            _action(2, "WEBM", "VP9", "encode", None, 24),
        ),
        (webm & (level == 3), _action(3, "WEBM", F.col("video_codec"), "keep")),
        (
            (webm & ~level.isin(2, 3) & _exceeds("VP9", 2, True)) | (default & _exceeds("AV1", 2, False)),
            _action(3, "MP4", "AV1", "encode", 20_000, 24),
        ),
        (
            (webm & ~level.isin(2, 3) & _exceeds("VP9", 2, True)) | (default & _exceeds("AV1", 3, False)),
            _action(4, "MP4", "AV1", "encode", None, 24),
        ),
    ]
    planned = F.array_compact(F.array(*[F.when(c, a) for c, a in steps]))
    return passport.select(
        "file_id", *facts, F.posexplode(planned).alias("step", "p")
    ).select("file_id", "step", "p.*", *facts)


def _by_target(codec: str, position: int) -> Column:
    table = {level: limits[position] for (name, level), limits in _LEVEL.items() if name == codec}
    return lookup(F.col("target_level"), table)


def encode_settings(passport: DataFrame) -> DataFrame:
    """Encoder settings of every encode step of the plan of each video."""
    plan = transcode_plan(passport, "width", "height", "min_size", "max_size", "fps", "is_vfr")
    rows = plan.filter(F.col("action") == "encode")
    codec = F.col("codec")
    h264 = codec == "H264"
    limit = lambda i: F.when(codec == "VP9", _by_target("VP9", i)).when(codec == "AV1", _by_target("AV1", i)).otherwise(
        F.lit(_LEVEL[("H264", 1)][i])
    )
    # Limits become columns first, so the size arithmetic refers to them by name.
    rows = rows.withColumns(
        {
            "_longest": limit(0).cast("int"), "_shortest": limit(1).cast("int"), "_fps_limit": limit(2).cast("int"),
            "_tiles": sizes.tile_exponent("max_size"),
        }
    ).withColumn("size", sizes.scale_down("width", "height", "_shortest", "_longest"))
    cap = F.col("_fps_limit") * rules.FPS_LIMIT_TOLERANCE
    # Halvings until the rate is within the cap; the logarithm is checked, for it may be off by one at powers of two.
    guess = F.greatest(F.ceil(F.log2(F.col("fps") / cap)), F.lit(0))
    over = lambda k: F.col("fps") / F.pow(F.lit(2.0), k) > cap
    halvings = F.when(over(guess), guess + 1).when((guess > 0) & ~over(guess - 1), guess - 1).otherwise(guess)
    halved = F.when(~h264, F.col("fps") / F.pow(F.lit(2.0), halvings))
    tiles = F.col("_tiles")
    portrait = F.col("height") > F.col("width")
    columns = F.when(portrait, 0).otherwise(tiles)
    rows_log2 = F.when(portrait, tiles).otherwise(0)
    reserve = {c: int(k * rules.AUDIO_RESERVE_FACTOR) + rules.CONTAINER_RESERVE_KBPS[c] for c, k in rules.AUDIO_KBPS.items()}
    capped = F.when(
        F.col("max_kbps").isNotNull(),
        F.greatest(F.col("max_kbps") - lookup(codec, reserve), F.lit(rules.MIN_VIDEO_KBPS)),
    )
    # The lowest VP9 rendition aims at a rate and may peak at twice that.
    aimed = (codec == "VP9") & (F.col("target_level") == 1)
    gop = F.when(h264, F.when(F.col("is_vfr"), 120).otherwise(F.rint("fps") * 2)).otherwise(
        F.rint(F.col("fps") * 10)
    )
    even = lambda c: sizes.bit_round(c, -1).cast("int")
    return rows.select(
        "file_id", "step", "target_level", "codec", "quality",
        even(F.col("size.w")).alias("out_width"), even(F.col("size.h")).alias("out_height"),
        F.when(h264 & F.col("is_vfr"), F.lit(60.0)).otherwise(F.coalesce(halved, F.col("fps"))).alias("out_fps"),
        gop.cast("int").alias("gop"),
        F.when(~h264, columns).cast("int").alias("tile_columns"),
        F.when(codec == "VP9", F.least(rows_log2, F.lit(2))).when(codec == "AV1", rows_log2).cast("int").alias("tile_rows"),
        F.when(aimed, F.least(F.lit(2 * AIMED_KBPS), capped)).otherwise(capped).cast("int").alias("video_kbps_cap"),
        F.when(codec == "AV1", F.when(F.col("min_size") > 1080, 5).otherwise(4)).cast("int").alias("preset"),
    )


def thumbnail_stream(probes: DataFrame) -> DataFrame:
    """(file_id, stream_index, is_attached, seek_from, seek_to): where a preview comes from.

    An attached front cover, else the last attached picture, else the first video
    stream, which itself never counts as attached. Frames are sought between a tenth
    and nine tenths of the duration.
    """
    videos = _streams("video")
    later = F.slice(videos, F.lit(2), F.greatest(F.size(videos), F.lit(1)))
    attached = F.filter(later, lambda s: s.disposition.attached_pic == 1)
    covers = F.filter(attached, lambda s: s.tags.filename.isin(*rules.FRONT_COVERS))
    picture = F.coalesce(F.try_element_at(covers, F.lit(-1)), F.try_element_at(attached, F.lit(-1)))
    rows = probes.select(
        "file_id", picture.alias("p"), F.get(videos, F.lit(0)).alias("v"),
        F.col("probe.format.duration").try_cast("double").alias("d"),
    )
    seeks = F.col("p").isNull()
    return rows.select(
        "file_id", F.coalesce("p.index", "v.index").alias("stream_index"), (~seeks).alias("is_attached"),
        F.when(seeks, F.col("d") * 0.1).alias("seek_from"), F.when(seeks, F.col("d") * 0.9).alias("seek_to"),
        F.when(F.col("p").isNull() & F.col("v").isNull(), "no video stream").alias("error"),
    )
