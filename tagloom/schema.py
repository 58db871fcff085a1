"""Explicit schemas of the catalog tables; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_L, _S, _I, _B = T.LongType(), T.StringType(), T.IntegerType(), T.BooleanType()
_TS, _BIN, _D = T.TimestampNTZType(), T.BinaryType(), T.DoubleType()


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in columns.items()])


CATALOG: dict[str, T.StructType] = {
    "content": _schema(
        content_id=_L, title=_S, content_type=_S, description=_S, addition_date=_TS,
        is_hidden=_B, last_edit=_TS, source_hash=_BIN, slug=_S,
    ),
    "content_tag": _schema(content_id=_L, tag_id=_L),
    "content_redirect": _schema(old_slug=_S, new_content_id=_L, created_at=_TS, source_hash=_BIN),
    "tag": _schema(tag_id=_L, title=_S, category=_S),
    "tag_alias": _schema(tag_id=_L, title=_S),
    "tag_implication": _schema(target=_L, implicate=_L),
    "content_origin": _schema(content_id=_L, name=_S, origin_id=_S, alternate=_B),
    "representation": _schema(
        content_id=_L, filepath=_S, format=_S, compatibility_level=_I, generation_date=_TS,
        width=_I, height=_I, repr_type=_I, codec_string=_S, hash=_L,
    ),
    "image_hash": _schema(
        imagehash_id=_L, content_id=_L, aspect_ratio=_D, l_hash=_BIN, a_hash=_BIN, b_hash=_BIN,
        search_similar=_BIN, far_similarity=_BIN, alternate_version=_B,
    ),
    "attachment": _schema(content_id=_L, filepath=_S, title=_S, format=_S),
    "album": _schema(album_id=_L, set_tag_id=_L, album_name=_S, is_nsfw=_B),
    "album_creator": _schema(album_id=_L, tag_id=_L),
    "album_order": _schema(album_id=_L, content_id=_L, ord=_L),
    "collection": _schema(collection_id=_L, user_id=_L, title=_S, created_at=_TS, is_nsfw=_B),
    "collection_item": _schema(collection_id=_L, content_id=_L),
    "task": _schema(
        task_id=_L, created_at=_TS, uploaded_file=_S, media_type=_S, mime_type=_S,
        source_hash=_BIN, status=_I, rewrite=_B,
    ),
    "task_metadata": T.StructType(
        [T.StructField("task_id", _L, True)]
        + [T.StructField(n, _S, True) for n in ("title", "description", "origin_name", "origin_id")]
        + [T.StructField("tags", T.MapType(_S, T.ArrayType(_S)), True)]
    ),
    "task_result": _schema(task_id=_L, content_id=_L, source_file_size=_L, result_file_size=_L),
    "execution_error": _schema(task_id=_L, title=_S, details=_S),
}

# The JSON body that accompanies an upload.
TASK_METADATA_JSON = T.StructType(
    [T.StructField(n, _S, True) for n in ("title", "description", "origin_name", "origin_id")]
    + [
        T.StructField("tags", T.MapType(_S, T.ArrayType(_S)), True),
        T.StructField("rewrite", _B, True),
    ]
)

# Stored probe output: container facts plus one entry per stream.
PROBE_JSON = T.StructType(
    [
        T.StructField("format", _schema(duration=_S, bit_rate=_S), True),
        T.StructField(
            "streams",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("index", _I, True),
                        T.StructField("codec_type", _S, True),
                        T.StructField("codec_name", _S, True),
                        T.StructField("profile", _S, True),
                        T.StructField("level", _I, True),
                        T.StructField("width", _I, True),
                        T.StructField("height", _I, True),
                        T.StructField("pix_fmt", _S, True),
                        T.StructField("avg_frame_rate", _S, True),
                        T.StructField("r_frame_rate", _S, True),
                        T.StructField("disposition", _schema(attached_pic=_I), True),
                        T.StructField("tags", _schema(filename=_S), True),
                    ]
                )
            ),
            True,
        ),
    ]
)
