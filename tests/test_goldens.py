"""Exact values of the sizing, level and scan rules."""

import pytest
from pyspark.sql import functions as F

from tagloom.functions import codecs, levels, sizes
from tagloom.operators.signatures import zigzag_order


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "precision, value, expected",
    [
        (0, 2.05, 2), (0, 2.99, 3), (-1, 0.5, 0), (-1, 1, 0), (-1, 1.5, 2), (-1, 2.5, 2), (-1, 3, 4),
        (-2, 7, 8), (-2, 5, 4), (-2, 1, 0), (1, 1.5, 1.5), (1, 1.25, 1.0), (1, 1.75, 2.0), (1, 2.1, 2.0),
    ],
)
def test_bit_round(spark, precision, value, expected):
    assert one(spark, sizes.bit_round(F.lit(value), precision)) == expected


def test_fit_in_rect(spark):
    fit = lambda w, h, p: tuple(one(spark, sizes.fit_in_rect(F.lit(w), F.lit(h), 2048, 2048, p)))
    assert fit(15457, 44121, 0) == (21.54345703125, 717, 2048)
    assert fit(15457, 44121, -1) == (21.54345703125, 718, 2048)
    assert fit(701, 555, 0) == (1.0, 701, 555)


@pytest.mark.parametrize(
    "size, limit, expected",
    [
        ((720, 480), (480, 1080), (720, 480)), ((320, 240), (480, 1280), (320, 240)),
        ((3840, 2160), (1080, 1920), (1920, 1080)), ((1080, 1920), (720, 1280), (720, 1280)),
        ((1001, 501), (480, 1080), (960, 480)),
    ],
)
def test_scale_down(spark, size, limit, expected):
    got = one(spark, sizes.scale_down(F.lit(size[0]), F.lit(size[1]), *limit))
    assert (got.w, got.h) == expected


@pytest.mark.parametrize("width, exponent", [(640, 1), (1280, 2), (1920, 2), (3840, 3), (256, 0), (10**6, 6)])
def test_tile_exponent(spark, width, exponent):
    assert one(spark, sizes.tile_exponent(F.lit(width))) == exponent


@pytest.mark.parametrize(
    "size, expected",
    [
        ((894, 458), (0, 1, 2)), ((742, 1685), (1, 1, 2)), ((3275, 2087), (2, 2, 3)),
        ((7593, 1246), (3, 3, 4)), ((19321, 29301), (4, 4, 5)),
    ],
)
def test_image_level(spark, size, expected):
    got = tuple(
        one(spark, levels.image_level(F.lit(size[0]), F.lit(size[1]), F.lit(fmt))) for fmt in ("JPEG", "WEBP", "AVIF")
    )
    assert got == expected


def test_zigzag():
    cells = [(k // 3, k % 3) for k in zigzag_order(3)]
    assert cells == [(0, 0), (0, 1), (1, 0), (2, 0), (1, 1), (0, 2), (1, 2), (2, 1), (2, 2)]


@pytest.mark.parametrize(
    "raw, value, error",
    [
        ("30", 30.0, None), ("30000/1001", 30000 / 1001, None), ("0/0", None, "undefined"),
        ("x/y", None, "malformed"), ("1/2/3", None, "malformed"), (None, None, "malformed"),
    ],
)
def test_parse_fps(spark, raw, value, error):
    got = one(spark, codecs.parse_fps(F.lit(raw).cast("string")))
    assert (got.value, got.error) == (value, error)


def test_codec_strings(spark):
    h264 = codecs.video_codec_string(F.lit("H264"), F.lit("Main"), F.lit(9), F.lit(8))
    vp9 = codecs.video_codec_string(F.lit("VP9"), F.lit("Profile 2"), F.lit(41), F.lit(10))
    av1 = codecs.video_codec_string(F.lit("AV1"), F.lit("Professional"), F.lit(5), F.lit(8))
    short = codecs.video_codec_string(F.lit("AV1"), F.lit("Main"), F.lit(-99), F.lit(8))
    assert [one(spark, c) for c in (h264, vp9, av1, short)] == ["avc1.4d0009", "vp09.02.41.10", "av01.2.05M.08", "av01"]
