"""Codec, container and pixel format rules over probe columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagloom import rules
from tagloom.functions.common import ColumnOrName, any_true, at_least, col, first_match, lookup

UNDEFINED = "UNDEFINED"


def video_codec(name: ColumnOrName) -> Column:
    return lookup(F.lower(col(name)), rules.VIDEO_CODECS, UNDEFINED)


def audio_codec(name: ColumnOrName) -> Column:
    """Null where the file has no audio."""
    name = col(name)
    return F.when(name.isNotNull(), lookup(F.lower(name), rules.AUDIO_CODECS, UNDEFINED))


def container_fit(container: str, video: ColumnOrName, audio: ColumnOrName) -> Column:
    """May these codecs live in the container? Without audio only the video counts."""
    video, audio = col(video), col(audio)
    return video.isin(*rules.CONTAINER_VIDEO[container]) & (
        audio.isNull() | audio.isin(*rules.CONTAINER_AUDIO[container])
    )


def bit_depth(pix_fmt: ColumnOrName) -> Column:
    return lookup(col(pix_fmt), rules.BITS_BY_PIXEL_FORMAT)


def has_alpha(pix_fmt: ColumnOrName) -> Column:
    pix_fmt = F.coalesce(col(pix_fmt), F.lit(""))
    hardware = any_true([pix_fmt.contains(x) for x in rules.HARDWARE_PIXEL_FORMATS])
    alpha = any_true([pix_fmt.contains(x) for x in rules.ALPHA_PIXEL_FORMATS])
    return alpha & ~hardware


def parse_fps(raw: ColumnOrName) -> Column:
    """Struct (num, den, value, error) of a frame rate written ``n`` or ``n/d``."""
    raw = col(raw)
    upper = F.when(
        F.substring_index(raw, "/", 2) == raw, F.substring_index(raw, "/", 1).try_cast("long")
    )
    lower = F.when(F.contains(raw, F.lit("/")), F.substring_index(raw, "/", -1).try_cast("long")).otherwise(
        F.lit(1).cast("long")
    )
    usable = upper.isNotNull() & (lower != 0)
    return F.struct(
        F.when(usable, upper).alias("num"),
        F.when(usable, lower).alias("den"),
        F.try_divide(upper.cast("double"), lower.cast("double")).alias("value"),
        F.when(upper.isNull() | lower.isNull(), "malformed").when(lower == 0, "undefined").alias("error"),
    )


def known_rate(average: ColumnOrName, real: ColumnOrName) -> Column:
    """The average rate as written, or the stream's base rate where no average is known."""
    average = col(average)
    return F.when(average == "0/0", col(real)).otherwise(average)


def stream_fps(average: ColumnOrName, real: ColumnOrName) -> Column:
    return parse_fps(known_rate(average, real))


def common_divisor(a: Column, b: Column) -> Column:
    """Euclid's steps as a fold; 92 of them cover every pair of 64-bit numbers."""
    start = F.struct(F.abs(a).alias("a"), F.abs(b).alias("b"))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(92)),
        start,
        lambda s, _: F.when(s.b == 0, s).otherwise(
            F.struct(s.b.alias("a"), F.try_mod(s.a, s.b).alias("b"))
        ),
        lambda s: s.a,
    )


def format_fps(num: ColumnOrName, den: ColumnOrName, halvings: Column, is_fraction: ColumnOrName) -> Column:
    """A rate halved ``halvings`` times: a lowest-terms fraction, or three decimals."""
    num, den = col(num), col(den)
    lower = den * F.call_function("shiftleft", F.lit(1).cast("long"), halvings)
    shared = F.greatest(common_divisor(num, lower), F.lit(1))
    n = (num / shared).cast("long")
    d = (lower / shared).cast("long")
    fraction = F.when(d == 1, n.cast("string")).otherwise(F.concat_ws("/", n, d))
    decimal = F.format_string("%.3f", num.cast("double") / lower)
    return F.when(col(is_fraction), fraction).otherwise(decimal)


def is_loop(audio_streams: ColumnOrName, duration: ColumnOrName, estimated: ColumnOrName) -> Column:
    """Struct (value, error): silent and at most half a minute long."""
    silent = F.coalesce(col(audio_streams), F.lit(0)) == 0
    seconds = F.coalesce(col(duration), col(estimated))
    return F.struct(
        F.when(~silent, F.lit(False)).otherwise(seconds <= rules.LOOP_SECONDS).alias("value"),
        F.when(silent & seconds.isNull(), "no duration").alias("error"),
    )


def video_stream_level(
    codec: ColumnOrName, width: ColumnOrName, height: ColumnOrName, fps: ColumnOrName,
    bits: ColumnOrName, levels=rules.VIDEO_LEVELS, strict_short_side: bool = False,
) -> Column:
    """Lowest level of the codec whose limits hold; the top level if none does."""
    codec, fps, bits = col(codec), col(fps), col(bits)
    long_side = F.greatest(col(width), col(height))
    short_side = F.least(col(width), col(height))
    steps = []
    for name, level, longest, shortest, rate, depth, _ in sorted(levels, key=lambda x: x[1]):
        fits = (
            (codec == name)
            & (long_side <= longest)
            & (short_side <= (shortest if strict_short_side else longest))
            & (fps <= rate * rules.FPS_TOLERANCE)
            & (bits <= depth)
        )
        steps.append((fits, F.lit(level)))
    return first_match(steps, F.lit(rules.TOP_VIDEO_LEVEL))


def media_level(
    codec: ColumnOrName, audio: ColumnOrName, width: ColumnOrName, height: ColumnOrName,
    fps: ColumnOrName, bits: ColumnOrName, levels=rules.VIDEO_LEVELS,
    strict_short_side: bool = False,
) -> Column:
    """Level of the whole file: the worse of its video and its audio."""
    codec, audio, bits = col(codec), col(audio), col(bits)
    video = video_stream_level(codec, width, height, fps, bits, levels, strict_short_side)
    # Bit rates of VP9 files are too high for the lowest VP9 level, whatever their size.
    video = F.when(codec == "VP9", F.greatest(video, F.lit(2))).otherwise(video)
    sound = F.when(audio.isNull(), 0).otherwise(lookup(audio, rules.AUDIO_LEVEL, rules.UNFIT_LEVEL))
    return F.when(bits.isNull(), rules.UNFIT_LEVEL).otherwise(F.greatest(video, sound)).cast("int")


def _h264_string(profile: Column, level: Column) -> Column:
    codes = {name: f"{code:02x}" for name, code in rules.H264_PROFILES.items()}
    digits = F.lower(F.hex(F.abs(level)))
    shown = F.when(level < 0, F.concat(F.lit("-"), digits)).otherwise(at_least(digits, 2))
    full = F.concat(F.lit("avc1."), lookup(profile, codes, codes["High"]), F.lit("00"), shown)
    return F.when(profile.isNull() | level.isNull(), "avc1").otherwise(full)


def _short_unless_known(profile: Column, level: Column, bits: Column, short: str, full: Column) -> Column:
    unknown = profile.isNull() | level.isNull() | bits.isNull() | (level == rules.NO_LEVEL)
    return F.when(unknown, short).otherwise(full)


def video_codec_string(codec, profile, level, bits) -> Column:
    codec, profile, level, bits = col(codec), col(profile), col(level), col(bits)
    level_text = at_least(level.cast("string"), 2)
    bits_text = at_least(bits.cast("string"), 2)
    number = F.regexp_extract(profile, r"\d+", 0)
    vp9_profile = F.when(number == "", "00").otherwise(at_least(number, 2))
    vp9 = F.concat_ws(".", F.lit("vp09"), vp9_profile, level_text, bits_text)
    av1 = F.concat_ws(
        ".", F.lit("av01"), lookup(profile, rules.AV1_PROFILES, "0"),
        F.concat(level_text, F.lit("M")), bits_text,
    )
    return (
        F.when(codec == "H264", _h264_string(profile, level))
        .when(codec == "VP9", _short_unless_known(profile, level, bits, "vp09", vp9))
        .when(codec == "AV1", _short_unless_known(profile, level, bits, "av01", av1))
        .when(codec == "VP8", "vp8")
    )


def audio_codec_string(codec, profile) -> Column:
    codec, profile = col(codec), col(profile)
    aac = F.concat(F.lit("mp4a.40."), lookup(profile, rules.AAC_PROFILES, "2"))
    return (
        F.when((codec == "AAC") & (F.coalesce(profile, F.lit("")) != ""), aac)
        .when(codec == "Opus", "opus")
        .when(codec == "Vorbis", "vorbis")
    )


def codec_string(codec, profile, level, bits, audio, audio_profile) -> Column:
    """Comma-joined codec names for a media player; parts that are unknown are left out."""
    return F.concat_ws(
        ",", video_codec_string(codec, profile, level, bits), audio_codec_string(audio, audio_profile)
    )
