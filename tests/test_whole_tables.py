"""Queries over whole tables: no row is left out before the operator, and keys grow with the rows."""

import json

from tagloom.workloads import catalog, duplicates
from tagloom.workloads.registry import QUERIES


def test_merge_albums_all_reads_every_row(inputs, monkeypatch):
    seen = {}
    monkeypatch.setattr(duplicates.merge, "merge_albums", lambda items, pairs: seen.setdefault("items", items))
    QUERIES["merge_albums_all"].build(inputs)
    assert seen["items"].count() == 2 * inputs.f_album_order.count()
    pairs = inputs.f_merge.join(inputs.f_album_order.select("content_id"), inputs.f_merge.source_id == inputs.f_album_order.content_id)
    found = seen["items"].select("album_id", "content_id").distinct()
    targets = pairs.select("source_id", "target_id").join(found, found.content_id == pairs.source_id).select("album_id", "target_id").distinct()
    there = targets.join(found.withColumnRenamed("content_id", "target_id"), ["album_id", "target_id"], "left_semi").count()
    assert 0 < there < targets.count()


def test_keys_grow_with_rows(inputs):
    edits, tasks = inputs.f_edit_wide, inputs.f_task_wide
    assert edits.select("content_id").distinct().count() > edits.select("collection_id").distinct().count()
    assert tasks.select("source_hash").distinct().count() >= tasks.count() // 5
    assert "merge_albums_all" in catalog.QUERIES


def test_item_details_hold_every_entry(inputs):
    """What the queries of the lists have as rows is all in the details, and nothing else."""
    pages = [r.asDict() for r in QUERIES["content_detail"].build(inputs).collect()]
    assert len(pages) == inputs.f_content.count()

    def rows(name, *columns):
        return sorted(map(repr, map(tuple, QUERIES[name].build(inputs).select("content_id", *columns).collect())))

    def listed(column, *columns):
        return sorted(repr((p["content_id"], *(e[c] for c in columns))) for p in pages for e in json.loads(p[column]))

    tags = [(p["content_id"], g["category"], t["tag_id"], t["title"]) for p in pages for g in json.loads(p["tags"]) for t in g["tags"]]
    assert sorted(map(repr, tags)) == rows("tags_by_category", "category", "tag_id", "title")
    assert sum(len(p["plain_tags"].split(", ")) for p in pages if p["plain_tags"]) == len(tags) == sum(p["tag_count"] for p in pages)
    videos = ("filepath", "compatibility_level", "playable")
    assert listed("video_list", *videos) == rows("detail_videos", *videos)
    origins = ("name", "origin_id", "url", "alternate")
    assert listed("origins", *origins) == rows("detail_origins", *origins)
    assert listed("albums", "album_id", "ord", "name") == rows("item_albums", "album_id", "ord", "name")
    sources = [(p["content_id"], *s.removesuffix("x").split(" ")) for p in pages for s in p["srcset"].split(", ") if s]
    assert sorted(map(repr, sources)) == rows("detail_srcset", "url", "ratio_text")
