"""Cases the views do not contain."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom import rules
from tagloom.functions import names, origins, tags as tag_fn, text
from tagloom.operators import browse, duplicates, ingest, media, merge, reports, representations, search, sets, signatures, tags
from tagloom.plans.positions import number_rows
from tagloom.plans.tagexpr import ANYTHING, T, all_of, any_of
from tagloom.sources.json_inputs import parse_probe


def got(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.fixture
def library(rows):
    content = rows("content_id long, is_hidden boolean", (1, False), (2, False), (3, True), (4, False))
    tag = rows("tag_id long, title string, category string", (10, "safe", "rating"), (20, "red", "style"), (30, "old", "style"))
    alias = rows("tag_id long, title string", (10, "safe"), (20, "red"), (20, "crimson"), (30, "old"))
    bridge = rows("content_id long, tag_id long", (1, 10), (1, 20), (2, 20), (3, 10))
    return content, bridge, alias, tag


def test_search_groups_and_negation(library):
    content, bridge, alias, _ = library
    find = lambda e, **kw: [r[0] for r in got(search.tag_search(content, bridge, alias, e, **kw), "content_id")]
    assert find(T("safe") & T("crimson")) == [1]
    assert find(~T("red")) == [3, 4]
    assert find(any_of() & T("red")) == [1, 2]
    assert find(any_of() | T("red")) == [1, 2]
    assert find(~all_of()) == [1, 2, 3, 4]
    assert find(T("nobody")) == []
    assert find(~T("nobody")) == []
    assert find(T("Red")) == []
    with pytest.raises(Exception, match="unknown tag"):
        find(T("nobody"), on_unknown="error")
    assert all_of(ANYTHING, any_of()) is ANYTHING


def test_preset_without_its_tag_raises(library):
    content, bridge, alias, _ = library
    with pytest.raises(Exception, match="unknown tag"):
        search.preset_filter(content, bridge, alias.filter("title <> 'safe'"), "safe").collect()
    assert len(search.preset_filter(content, bridge, alias, "bypass").collect()) == 4


def test_seeding_twice_changes_nothing(rows, library):
    _, _, alias, tag = library
    edges = rows("target long, implicate long", (10, 20))
    once = tags.seed_default_tags(tag, alias, edges)
    twice = tags.seed_default_tags(once["tag"], once["tag_alias"], once["tag_implication"])
    for name in ("tag", "tag_alias", "tag_implication"):
        assert got(once[name], *once[name].columns) == got(twice[name], *once[name].columns)
    assert once["tag"].count() == 3 + len(rules.DEFAULT_TAGS) - 1


def test_closure_of_cycles_diamonds_and_self_edges(rows):
    edges = rows("target string, implicate string", ("a", "b"), ("b", "c"), ("c", "a"), ("d", "d"), ("p", "q"), ("p", "r"), ("q", "s"), ("r", "s"))
    closure = set(got(tags.implication_closure(edges), "target", "implicate"))
    assert {(x, y) for x in "abc" for y in "abc"} <= closure
    assert ("d", "d") in closure and ("p", "s") in closure
    assert len(closure) == 9 + 1 + 5
    some = tags.implication_closure(edges, rows("target string", ("q",)))
    assert got(some, "target", "implicate") == [("q", "s")]
    chain = rows("target long, implicate long", *[(i, i + 1) for i in range(9)])
    assert tags.implication_closure(chain).count() == 45


def test_resolution_of_names(rows):
    tag = rows("tag_id long, title string, category string", (1, "fox", "content"), (2, "bob", "creator"), (3, "lone", "meta"))
    alias = rows("tag_id long, title string", (1, "fox"), (2, "creator: bob"), (2, "creator:bob"))
    asked = rows(
        "name string, category string, seq long",
        ("Fox", "species", 1), ("fox", "meta", 2), ("artist:Bob", "content", 3), ("prompter:New_One", "content", 4),
        ("brand new", "content", 5), ("Brand_New", "lore", 6), ("brand new", "style", 7), ("lone", "meta", 8),
    )
    r = tags.resolve_tags(asked, tag, alias)
    resolved = {(a, c): rest for a, c, *rest in got(r["resolved"], "asked", "asked_category", "tag_id", "title", "category", "via")}
    assert resolved[("Fox", "species")] == [1, "fox", "species", "alias"]
    assert resolved[("fox", "meta")] == [1, "fox", "species", "alias"]
    assert resolved[("artist:Bob", "content")] == [None, "bob", "artist", "new"]
    assert resolved[("brand new", "style")] == [None, "brand new", "lore", "new"]
    assert resolved[("lone", "meta")] == [3, "lone", "meta", "title"]
    assert got(r["category_change"], "tag_id", "category") == [(1, "species")]
    assert got(r["new_tag"], "title", "category") == [
        ("bob", "artist"), ("brand new", "lore"), ("new one", "creator"), ("new one", "prompter"),
    ]
    assert {("bob", "artist", 2), ("new one", "prompter", None)} == set(got(r["new_implication"], "title", "category", "creator_id"))
    now = tags.apply_resolution(r, tag, alias, rows("target long, implicate long", (1, 3)))
    assert now["tag"].count() == 7 and now["tag_implication"].count() == 3
    again = tags.resolve_tags(asked, now["tag"], now["tag_alias"])
    assert again["new_tag"].count() == 0


def test_tag_names_strip_python_white_space(spark):
    raw = "\t  Two_Words \n"
    assert one(spark, tag_fn.prepare_tag_name(F.lit(raw))) == raw.lower().replace("_", " ").strip()
    assert one(spark, tag_fn.generate_aliases(F.lit("a b"), F.lit("character"))) == ["character: a b", "character:a_b"]
    assert one(spark, tag_fn.generate_aliases(F.lit("ab"), F.lit("meta"))) == ["ab"]


SITES = [
    ("derpibooru", "https://derpibooru.org/images/12?q=1", "12"), ("ponybooru", "https://ponybooru.org/images/7", "7"),
    ("twibooru", "https://twibooru.org/55?x", "55"), ("twibooru", "https://twibooru.org/tags/55", None),
    ("e621", "https://e621.net/posts/9", "9"), ("e6ai", "https://e6ai.net/posts/9", "9"),
    ("furbooru", "https://furbooru.org/images/3", "3"), ("tantabus", "https://tantabus.ai/images/4", "4"),
    ("furaffinity", "https://www.furaffinity.net/view/8/", ""), ("civit-ai", "https://civitai.com/images/5", "5"),
    ("twitter", "https://x.com/me/status/1/photo/2", "me#1#2"), ("twitter", "http://twitter.com/me/status/1", "me#1"),
    ("deviantart", "https://www.deviantart.com/me/art/Some-Title-77?x=1", "me#77"),
    ("deviant-art", "https://deviantart.com/me/art/T-77/", "me#77"), ("telegram", "https://t.me/chan/6", "chan#6"),
    ("telegram", "https://t.me/chan/6/7", None), ("e621", "https://example.org/posts/9", None), ("nosite", "https://x.y/1", None),
]


@pytest.mark.parametrize("site, url, expected", SITES)
def test_origin_addresses(spark, site, url, expected):
    assert one(spark, origins.parse_origin_url(F.lit(site), F.lit(url))) == expected


def test_origin_urls(spark):
    url = lambda site, i: one(spark, origins.origin_url(F.lit(site), F.lit(i)))
    assert url("twitter", "me#1#2") == "https://x.com/me/status/1/photo/2"
    assert url("twitter", "me") is None and url("nosite", "1") == ""
    assert url("furaffinity", "8") == "https://www.furaffinity.net/view/8/"
    assert one(spark, origins.normalise_origin_id(F.lit("e621"), F.lit("https://other.site/1"))) == ""
    assert one(spark, origins.normalise_origin_id(F.lit("nosite"), F.lit("https://a.b/1"))) == "https://a.b/1"


def test_file_names(spark):
    stem = lambda x: one(spark, names.path_stem(F.lit(x)))
    assert [stem(x) for x in ("a/b.tar.gz", ".hidden", "plain", "dir/x.png")] == ["b.tar", ".hidden", "plain", "x"]
    title = lambda x: one(spark, names.clean_title(F.lit(x)))
    assert [title(x) for x in ("a/b.png", "", "x.mp4.png", "x.png.mp4")] == ["a_b", "Untitled", "x", "x.png"]
    long_name = one(spark, names.normalise_filename(F.lit("n" * 600 + ".gif"), F.lit("image/png"), F.lit(1)))
    assert len(long_name) + len("queue/") + 8 == 512 and long_name.endswith(".png")
    assert len(one(spark, names.normalise_filename(F.lit(""), F.lit("image/png"), F.lit(1)))) == 20
    assert one(spark, names.normalise_filename(F.lit("a"), F.lit("text/plain"), F.lit(1))) is None


def test_size_text(spark):
    size = lambda n: one(spark, text.format_size(F.lit(n).cast("long")))
    for n in (0, 1023, 1024, 1024 + 128, 1024 * 3 + 384, 2**20, 5 * 2**20 + 12345, 2**30, 7 * 2**30 + 1):
        unit = next(((p, u) for p, u in ((30, "GiB"), (20, "MiB"), (10, "KiB")) if n >= 2**p), None)
        assert size(n) == (f"{n} bytes" if unit is None else f"{n / 2 ** unit[0]:.2f} {unit[1]}")


def test_reports_with_zero_source(rows):
    results = rows(
        "task_id long, media_type string, mime_type string, source_file_size long, result_file_size long",
        (1, "image", None, 0, 10), (2, "image", None, 0, 5),
    )
    assert got(reports.processing_by_mime(results), "mime", "ratio", "is_growth", "total_saved") == [("Unknown", "0.0%", False, "-15 bytes")]
    kinds = {r.media_type: r for r in reports.processing_by_type(results).collect()}
    assert kinds["audio"]["count"] == 0 and kinds["audio"].avg_source == "0 bytes"
    change = reports.result_change(results).collect()
    assert all(r.percent == "-" and r.difference is None for r in change)


def test_album_order_of_odd_ids(rows):
    album = rows("album_id long, set_tag_id long", (1, 5), (2, None))
    bridge = rows("content_id long, tag_id long", *[(n, 5) for n in range(1, 9)])
    ids = {1: "", 2: "abc", 3: "9" * 30, 4: "007", 5: "-3", 6: "12", 7: "9" * 50}
    origin = rows(
        "content_id long, name string, origin_id string, alternate boolean",
        *[(n, "s", i, False) for n, i in ids.items()], (6, "a", "1", True),
    )
    order = [r.content_id for r in sets.sync_albums(album, bridge, origin).orderBy("ord").collect()]
    # -3, 7, 12, then everything without a number by item id; a 30-digit id is larger than the sentinel.
    assert order == [5, 4, 6, 1, 2, 7, 8, 3]


def test_pages(rows):
    df = rows("content_id long", *[(n,) for n in range(1, 51)])
    page = lambda p, size: browse.paginate(df, [F.col("content_id")], p, size).collect()
    assert sorted(r.content_id for r in page(2, 24)) == list(range(25, 49))
    assert [r.page for r in page(0, 24)][:1] == [3] and [r.page for r in page(-1, 24)][:1] == [3]
    last = page(99, 24)
    assert sorted(r.content_id for r in last) == [49, 50] and last[0].has_previous and not last[0].has_next
    assert len(page(1, 1)) == 3 and len(page(1, 5000)) == 50 and len(page(1, "x")) == 24
    assert page(4, 24)[0].pages == 3
    assert browse.paginate(df.limit(0), [F.col("content_id")], 7).collect() == []


def test_numbering_of_a_hot_group(spark):
    df = spark.range(0, 3000).select(
        F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1).alias("g"), (F.col("id") * 7919 % 3001).alias("v"), "id"
    )
    numbered = number_rows(df, "n", ["v", "id"], by=["g"]).toPandas()
    hot = numbered[numbered.g == -1].sort_values(["v", "id"])
    assert hot["n"].tolist() == list(range(1, len(hot) + 1))
    assert (numbered[numbered.g != -1]["n"] == 1).all()


def test_srcset_shapes(rows):
    reps = rows(
        "content_id long, repr_type int, width int, height int, filepath string, compatibility_level int, format string",
        (1, 10, 300, 200, "a b.webp", 1, "webp"), (1, 10, 600, 400, "c.webp", 1, "webp"), (1, 20, 900, 900, "v.mp4", 1, "mp4"),
        (2, 10, 10, 10, "tiny.webp", 0, "webp"), (2, 10, 20, 10, "small.webp", 0, "webp"), (3, 20, 10, 10, "v2.mp4", 0, "mp4"),
    )
    shown = {r.content_id: r for r in representations.image_base(reps, 256, 256).collect()}
    assert (shown[1].srcset_n, shown[1].base_src) == (2, "a b.webp")
    assert (shown[2].srcset_n, shown[2].base_src) == (0, "small.webp") and 3 not in shown
    assert got(representations.srcset_entries(reps, 256, 256), "url", "ratio_text") == [
        ("/media/a%20b.webp", "1.171875"), ("/media/c.webp", "2.34375"),
    ]
    asked = rows(
        "request_id long, content_id long, content_type string, clevel int, target_width int, target_height int",
        (1, 1, "image", 4, 250, None), (2, 3, "image", 4, None, None), (3, 3, "video", 0, 5, None), (4, 1, "video", 0, None, None),
    )
    statuses = got(representations.pick_representation(asked, reps), "request_id", "status")
    assert statuses == [(1, "error"), (2, "missing"), (3, "found"), (4, "missing")]


def test_items_of_many_images_and_tags(spark):
    many = spark.range(1, 5001)
    reps = many.select(
        F.lit(1).cast("long").alias("content_id"), F.lit(10).alias("repr_type"), (F.col("id") + 1024).cast("int").alias("width"),
        F.lit(9).alias("height"), F.concat(F.col("id"), F.lit(".webp")).alias("filepath"), F.lit("webp").alias("format"),
    )
    tag = many.select(F.col("id").alias("tag_id"), F.col("id").cast("string").alias("title"), F.lit("content").alias("category"))
    held = tag.select(F.lit(1).cast("long").alias("content_id"), "tag_id")
    item = spark.sql("select 1L as content_id, 's' as slug, 't' as title, 'image' as content_type")
    shown = browse.content_detail(item, held, tag, reps).first()
    assert (shown.tag_count, shown.srcset_n, shown.base_src) == (5000, 5000, "1.webp")
    assert browse.tags_by_category(held, tag).count() == 5000
    assert representations.srcset_entries(reps, 1024, 1024).count() == 5000
    assert browse.page_srcset(item, reps, 1024, 1024).count() == 5000


def test_item_page_has_every_list(spark, rows):
    content = rows("content_id long, slug string, title string, content_type string", (1, "s", "t", "video"), (2, "s2", None, "image"))
    tag = rows(
        "tag_id long, title string, category string",
        (10, "safe", "rating"), (11, "Zed", "content"), (12, "apple", "content"), (13, "apple", "artist"), (14, "x", None), (15, None, "meta"),
    )
    held = rows("content_id long, tag_id long", *[(1, n) for n in (10, 11, 12, 13, 14, 15, 99)], (None, 10), (3, 10))
    reps = rows(
        "content_id long, repr_type int, width int, height int, filepath string, compatibility_level int, format string",
        (1, 20, 640, 480, "b.mp4", 1, "mp4"), (1, 20, 640, 480, "a.mp4", 1, "mp4"), (1, 20, 1920, 1080, "c.mp4", 4, "mp4"),
        (1, 20, 1280, 720, "d.mp4", 3, "mp4"), (1, 10, 2048, 1024, "two x.webp", 2, "webp"), (1, 10, 512, 1536, "tall.webp", 1, "webp"),
        (1, 10, 100, 100, "small.webp", 0, "webp"), (2, 10, 100, 50, "only.webp", 0, "webp"),
    )
    origin = rows(
        "content_id long, name string, origin_id string, alternate boolean",
        (1, "twitter", "u#5", True), (1, "telegram", "chan#9", False), (1, "derpibooru", "7", False), (1, "twitter", "", False),
        (1, "telegram", None, False),
    )
    album = rows("album_id long, album_name string, set_tag_id long", (1, "Named", 12), (2, "", 12), (3, None, None), (4, "not held", None))
    order = rows("album_id long, content_id long, ord long", (3, 1, 1), (2, 1, 7), (1, 1, 4), (9, 1, 1), (4, 3, 1))
    shown = browse.content_detail(content, held, tag, reps, origin, order, album, level=3)
    page, bare = sorted((r.asDict(recursive=True) for r in shown.collect()), key=lambda r: r["content_id"])
    entry = lambda n, title: {"tag_id": n, "title": title}
    assert page["tags"] == [
        {"category": None, "tags": [entry(14, "x")]}, {"category": "artist", "tags": [entry(13, "apple")]},
        {"category": "content", "tags": [entry(11, "Zed"), entry(12, "apple")]}, {"category": "meta", "tags": [entry(15, None)]},
        {"category": "rating", "tags": [entry(10, "safe")]},
    ]
    assert (page["tag_count"], page["plain_tags"]) == (6, "x, apple, Zed, apple, safe")
    assert [(v["filepath"], v["compatibility_level"], v["playable"]) for v in page["video_list"]] == [
        ("c.mp4", 4, False), ("d.mp4", 3, True), ("a.mp4", 1, True), ("b.mp4", 1, True),
    ]
    assert (page["videos"], page["has_image"], page["srcset_n"], page["base_src"]) == (4, True, 2, "tall.webp")
    assert page["srcset"] == "/media/tall.webp 1.5x, /media/two%20x.webp 2.0x"
    assert [(o["name"], o["alternate"], o["url"]) for o in page["origins"]] == [
        ("derpibooru", False, "https://derpibooru.org/images/7"), ("telegram", False, ""), ("telegram", False, "https://t.me/chan/9"),
        ("twitter", False, None), ("twitter", True, "https://x.com/u/status/5"),
    ]
    assert [(a["album_id"], a["ord"], a["name"]) for a in page["albums"]] == [(1, 4, "Named"), (2, 7, "apple"), (3, 1, "untitled")]
    assert all(bare[c] == [] for c in ("tags", "video_list", "origins", "albums"))
    assert (bare["plain_tags"], bare["srcset"], bare["base_src"], bare["tag_count"]) == ("", "", "only.webp", 0)


def test_item_page_lists_are_whole(spark):
    many = spark.range(1, 5001)
    one = F.lit(1).cast("long").alias("content_id")
    name = F.concat(F.col("id"), F.lit(".x"))
    reps = many.select(
        one, F.when(F.col("id") % 2 == 0, 10).otherwise(20).alias("repr_type"), (F.col("id") + 1024).cast("int").alias("width"),
        F.lit(9).alias("height"), name.alias("filepath"), (F.col("id") % 5).cast("int").alias("compatibility_level"),
    )
    tag = many.select(F.col("id").alias("tag_id"), F.col("id").cast("string").alias("title"), F.concat(F.lit("c"), F.col("id") % 3).alias("category"))
    origin = many.select(one, F.lit("derpibooru").alias("name"), F.col("id").cast("string").alias("origin_id"), F.lit(False).alias("alternate"))
    album = many.select(F.col("id").alias("album_id"), name.alias("album_name"), F.lit(None).cast("long").alias("set_tag_id"))
    order = album.select("album_id", one, F.lit(1).cast("long").alias("ord"))
    item = spark.sql("select 1L as content_id, 's' as slug, 't' as title, 'image' as content_type")
    shown = browse.content_detail(item, tag.select(one, "tag_id"), tag, reps, origin, order, album).first()
    assert sorted(t.tag_id for group in shown.tags for t in group.tags) == list(range(1, 5001)) and len(shown.tags) == 3
    assert len(shown.plain_tags.split(", ")) == shown.tag_count == 5000
    assert len(shown.video_list) == len(shown.srcset.split(", ")) == shown.videos == shown.srcset_n == 2500
    assert len({o.url for o in shown.origins}) == len({a.name for a in shown.albums}) == 5000


def test_merge_cases(rows):
    pairs = rows("source_id long, target_id long", (1, 2), (2, 3), (4, 4), (5, 6), (6, 5), (7, 5), (8, 3), (9, 9), *[(100 + n, 101 + n) for n in range(40)])
    r = {a: (b, s) for a, b, s in got(merge.resolve_merge_chains(pairs), "source_id", "target_id", "status")}
    assert r[1] == (3, "ok") and r[2] == (3, "ok") and r[8] == (3, "ok")
    assert {k for k, v in r.items() if v[1] == "cycle"} == {5, 6, 7} and 4 not in r
    assert all(r[100 + n] == (140, "ok") for n in range(40))
    origin = rows("content_id long, name string, origin_id string, alternate boolean", (1, "a", "1", False), (3, "a", "1", False), (2, "b", "", False), (8, "c", "5", False))
    assert got(merge.merge_origins(origin, merge.resolve_merge_chains(pairs)), "content_id", "name", "alternate") == [
        (3, "a", False), (3, "b", True), (3, "c", True),
    ]
    items = rows("album_id long, content_id long, ord long", (1, 1, 1), (1, 3, 2), (2, 1, 5), (2, 8, 4))
    assert got(merge.merge_albums(items, merge.resolve_merge_chains(pairs)), "album_id", "content_id", "ord") == [(1, 3, 2), (2, 3, 4)]


def test_duplicate_groups_need_a_member_to_review(rows):
    h = lambda *b: bytearray(b)
    hashes = rows(
        "imagehash_id long, content_id long, aspect_ratio double, l_hash binary, a_hash binary, b_hash binary, alternate_version boolean",
        (1, 1, 1.0, h(1, 2, 3, 4, 5), h(1, 1), h(2, 2), True), (2, 2, 1.0, h(1, 2, 3, 4, 5), h(1, 1), h(2, 2), True),
        (3, 3, 1.0, h(9, 9, 9, 9), h(1), h(1), False), (4, 4, 1.0, h(7, 7, 1, 1), h(1), h(1), True), (5, 5, 1.0, h(7, 7, 2, 2), h(1), h(1), False),
    )
    assert duplicates.duplicate_groups(hashes, "exact").count() == 0
    assert got(duplicates.duplicate_groups(hashes, "low"), "key_hex", "items", "alternates") == [("07070101", 2, 1)]
    members = duplicates.duplicate_members(hashes, "low")
    assert got(duplicates.review_pairs(members), "first_hash", "second_hash") == [(4, 5)]


def test_similar_items_in_a_hot_group(spark, rows):
    n = 200
    hashes = spark.range(n).select(
        F.col("id").alias("content_id"), *[F.lit(bytearray(b"same")).alias(c) for c in ("l_hash", "a_hash", "b_hash")]
    )
    content = spark.range(n).select(F.col("id").alias("content_id"), F.lit("s").alias("slug"), F.lit("t").alias("title"))
    found = browse.similar_content(hashes, content, 5).toPandas()
    assert len(found) == n * 5
    assert found[found.content_id == 2].sort_values("rank").similar_id.tolist() == [0, 1, 3, 4, 5]
    assert found[found.content_id == 150].sort_values("rank").similar_id.tolist() == [0, 1, 2, 3, 4]


def test_signature_against_numpy(rows):
    rng = np.random.default_rng(3)
    band = rng.random((32, 32))
    steps = np.arange(32)
    basis = np.cos(np.pi * np.outer(steps, 2 * steps + 1) / 64)
    low = (basis @ band @ basis.T)[:16, :16]
    bits = low > np.median(low)
    cells = sorted(((i, j) for i in range(16) for j in range(16)), key=lambda c: (sum(c), c[1] if sum(c) % 2 == 0 else c[0]))
    expected = np.packbits([bits[c] for c in cells]).tobytes()
    flat = band.ravel().tolist()
    df = rows("imagehash_id long, l_band array<double>, a_band array<double>, b_band array<double>", (1, flat, flat, flat), (2, [1.0] * 5, flat, flat), (3, None, flat, flat))
    out = {r.imagehash_id: r for r in signatures.visual_signature(df).collect()}
    assert bytes(out[1].l_hash) == expected and len(out[1].a_hash) == 8 and len(out[1].search_similar) == 8
    assert out[2].error == "empty hash" and out[3].error == "empty hash" and out[2].search_similar is None


def test_image_error_and_heatmap_errors(rows):
    pairs = rows(
        "pair_id long, first array<double>, second array<double>, first_type string, second_type string",
        (1, [1.0, 2.0], [1.0, 2.0], "uint8", "uint8"), (2, [0.0, 0.0], [255.0, 255.0], "uint8", "uint8"),
        (3, [0.0], [0.0, 1.0], "uint8", "uint8"), (4, [0.0], [0.0], "uint8", "uint16"),
    )
    out = {r.pair_id: r for r in signatures.image_error(pairs).collect()}
    assert out[1].psnr == float("inf") and out[2].psnr == 0.0 and out[2].rmse == 255.0
    assert out[3].error == "sizes differ" and out[4].error == "types differ" and out[4].psnr is None
    heat = rows(
        "pair_id long, first array<double>, second array<double>, first_width int, second_width int, first_height int, second_height int, first_channels int, second_channels int",
        (1, [0.0] * 6, [200.0] * 6, 2, 2, 1, 1, 3, 3), (2, [0.0] * 3, [0.0] * 6, 1, 2, 1, 1, 3, 3),
    )
    rows_out = {r.pair_id: r for r in signatures.diff_heatmap(heat).collect()}
    assert rows_out[1].heatmap == [600, 600] and rows_out[1].clipped == [255, 255]
    assert rows_out[2].error == "different sizes" and rows_out[2].heatmap is None


def test_metadata_defaults(rows):
    from tagloom.sources.json_inputs import parse_task_metadata

    df = rows("task_id long, body string", (1, '{"tags": {"a": ["x"]}}'), (2, "{broken"), (3, None), (4, '{"title": "t", "rewrite": true}'))
    out = {r.task_id: r for r in parse_task_metadata(df, "body").collect()}
    assert out[1].tags == {"a": ["x"]} and out[1].title == "" and out[1].rewrite is False and out[1].error is None
    assert out[2].error and out[3].error and out[2].tags == {}
    assert out[4].title == "t" and out[4].rewrite is True


def test_one_file_may_hold_a_third_of_tasks(spark):
    tasks = spark.range(900).select(
        F.col("id").alias("task_id"), F.lit(0).alias("status"), F.lit("site").alias("origin_name"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("origin_id"),
    )
    counts = dict(got(ingest.select_launch(tasks).groupBy("decision").count(), "decision", "count"))
    assert counts == {"launch": 601, "discard": 299}


def test_ordinals_that_are_no_numbers(rows):
    requests = rows(
        "album_title string, origin_name string, content_sequence array<string>, ordered_content map<string,string>",
        ("good", "s", None, {"10": "a", "30": "b"}), ("bad", "s", None, {"10": "a", "x": "b"}), ("none", "s", None, None),
    )
    made = sets.register_albums(
        requests, rows("content_id long, name string, origin_id string", (1, "s", "a"), (2, "s", "b")),
        rows("content_id long, tag_id long"), rows("tag_id long, title string, category string"),
        rows("album_id long, album_name string, set_tag_id long"),
    )
    assert got(made["items"], "album_title", "content_id", "ord") == [("good", 1, 10), ("good", 2, 30)]
    assert got(made["summary"], "album_title", "status") == [
        ("bad", "ordinal is no number"), ("good", "success"), ("none", "no content given"),
    ]


def test_passport_of_odd_probes_parsed_whole_or_in_part(rows):
    stream = '{"index": %s, "codec_type": "%s", "codec_name": "h264", "width": 8, "height": 6, "pix_fmt": "yuv420p", "avg_frame_rate": "%s", "r_frame_rate": "30/1", "disposition": %s, "tags": %s}'
    probe = lambda *streams, form='{"duration": "9", "bit_rate": "1"}': '{"format": %s, "streams": [%s]}' % (form, ", ".join(streams))
    plain = stream % (0, "video", "25/1", "{}", "{}")
    bodies = [
        probe(plain), probe(plain, stream % (1, "audio", "0/0", "{}", "{}")), probe(),
        probe(stream % ('"x"', "video", "25/1", "{}", "{}")), probe(stream % (0, "video", "0/0", "5", "[1, 2]")),
        probe(stream % (0, "video", "a/b", '{"attached_pic": "no"}', '{"filename": {"a": 1}}')),
        probe(stream % ("1e999", "video", "24", "null", '"t"')), probe(plain, form='{"duration": "9", "bit_rate": {"a": [1]}}'),
        probe(plain, form="7"), probe("3", plain), probe("null", plain), probe(plain)[:-20], probe(plain) + "}", "[]", "", "null", "text", None,
        '{"streams": {"codec_type": "video"}}', '{"other": 1}',
    ]
    files = rows("file_id long, mime_type string, media_type string, body string", *[(n, "video/mp4", "video", b) for n, b in enumerate(bodies)])
    frames = media.frame_stats(rows("file_id long, frame_no int, duration_time double", (0, 0, 0.5), (0, 1, 0.25), (4, 0, 0.5)))
    whole, part = (
        media.media_passport(parse_probe(files, "body", fields), frames).orderBy("file_id").collect()
        for fields in (None, media.PASSPORT_FIELDS)
    )
    assert part == whole and len(part) == len(bodies)
    assert [r.fps for r in part[:5]] == [25.0, 25.0, None, 25.0, 30.0] and part[4].is_vfr is False and part[0].is_vfr is True
