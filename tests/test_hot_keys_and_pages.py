"""Joins on hot keys, closures by doubling, saved searches as a table, page indexes, numbers of any length."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tagloom.operators import browse, search, sets, tags
from tagloom.plans import hotkeys


@pytest.fixture
def still(spark):
    """Partitions as they are dealt, without adaptive changes."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def hot_rows(spark, n=40_000):
    """Nine of ten rows have key 7."""
    return spark.range(n).select(
        F.col("id").alias("item"), F.when(F.col("id") % 10 < 9, 7).otherwise(F.col("id") % 5000).cast("long").alias("key")
    )


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
@pytest.mark.parametrize("most", [0, 10**6])
def test_split_join_is_a_join(spark, how, most):
    rows, small = hot_rows(spark, 6000), spark.range(0, 4000, 2).select(F.col("id").alias("key"), (F.col("id") * 3).alias("x"))
    small = small.unionByName(spark.sql("select 7L as key, -1L as x union all select 7L, -2L"))
    got = hotkeys.split_join(rows, small, "key", ["item"], how, most)
    want = rows.join(small, "key", how)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect()))


def test_frequent_keys_are_found_and_only_they(spark):
    assert hotkeys.frequent_keys(hot_rows(spark), F.col("key")) == [spark.sql("select xxhash64(7L)").first()[0]]
    assert hotkeys.frequent_keys(spark.range(50_000), F.col("id")) == []
    assert hotkeys.frequent_keys(spark.range(0), F.col("id")) == []


def test_no_task_gets_a_hot_key_whole(spark, still):
    rows, small = hot_rows(spark), spark.range(5000).select(F.col("id").alias("key"), F.lit(1).alias("x"))
    spread = lambda df: [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    dealt = spread(hotkeys.split_join(rows, small.hint("merge"), "key", ["item"], most=0))
    assert sum(dealt) == rows.count() and max(dealt) <= 3 * rows.count() / 8
    assert max(spread(rows.join(small.hint("merge"), "key"))) > 7 * rows.count() / 8


def test_chain_of_a_thousand_tags_in_few_rounds(spark, monkeypatch):
    calls = []
    settle = tags.settle
    monkeypatch.setattr(tags, "settle", lambda df: calls.append(1) or settle(df))
    chain = spark.range(1000).select(F.col("id").alias("target"), (F.col("id") + 1).alias("implicate"))
    closure = tags.implication_closure(chain, spark.sql("select 0L as target union all select 990L"))
    assert len(calls) <= 2 + 2 * 11
    found = {(r.target, r.implicate) for r in closure.collect()}
    assert found == {(0, i) for i in range(1, 1001)} | {(990, i) for i in range(991, 1001)}


@pytest.mark.parametrize("seed", range(2))
def test_closure_of_graphs_with_cycles(rows, seed):
    rng = random.Random(seed)
    edges = {(rng.randrange(14), rng.randrange(14)) for _ in range(16)} | {(20, 21), (21, 22), (22, 20)}
    want, grown = set(edges), True
    while grown:
        more = want | {(a, d) for a, b in want for c, d in edges if b == c}
        grown, want = more != want, more
    got = [(r.target, r.implicate) for r in tags.implication_closure(rows("target long, implicate long", *edges)).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_saved_searches_against_each_item(spark, rows):
    rng = random.Random(5)
    aliases = {f"a{t}": t for t in range(12)} | {"again 3": 3}
    items = {c: {t for t in range(12) if rng.random() < 0.3} for c in range(60)} | {99: set()}
    clauses = [
        (s, c, rng.choice([*aliases, *(["nothing"] if s % 9 == 4 else [])]), rng.random() < 0.5)
        for s in range(80) for c in range(rng.randrange(1, 4)) for _ in range(rng.randrange(1, 4))
    ] + [(200, 1, "a1", True), (200, 1, "a1", False), (201, 1, "a1", True), (201, 1, "a2", True), (201, 1, "a1", True)]
    content = rows("content_id long, title string", *[(c, "x") for c in items])
    bridge = rows("content_id long, tag_id long", *[(c, t) for c, has in items.items() for t in has], (1000, 1))
    alias = rows("title string, tag_id long", *aliases.items())
    frame = rows("search_id long, clause_no int, alias string, negated boolean", *clauses)
    searches = {}
    for s, c, a, n in clauses:
        searches.setdefault(s, {}).setdefault(c, []).append((aliases.get(a), n))
    want = {
        (i, s) for i, has in items.items() for s, parts in searches.items()
        if all(t is not None for p in parts.values() for t, _ in p) and all(any((t in has) != n for t, n in p) for p in parts.values())
    }
    got = [(r.content_id, r.search_id) for r in search.match_saved_searches(content, bridge, alias, frame).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert search.match_saved_searches(content, bridge, alias, frame.limit(0)).collect() == []
    assert search.match_saved_searches(content.limit(0), bridge, alias, frame).collect() == []


def test_ten_thousand_searches_look_aliases_up_once(spark, inputs, tmp_path, monkeypatch):
    seen = []
    settle = search.settle
    monkeypatch.setattr(search, "settle", lambda df: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or settle(df))
    path = str(tmp_path / "named")
    inputs.f_alias.write.parquet(path)
    alias = spark.read.parquet(path)
    titles = [r.title for r in alias.orderBy("title").collect()]
    clauses = spark.range(30_000).select(
        (F.col("id") % 10_000).alias("search_id"), (F.col("id") % 3).cast("int").alias("clause_no"),
        F.array(*map(F.lit, titles))[(F.col("id") % len(titles)).cast("int")].alias("alias"), (F.col("id") % 3 != 0).alias("negated"),
    )
    found = search.match_saved_searches(inputs.f_content, inputs.f_content_tag, alias, clauses)
    last = found._jdf.queryExecution().optimizedPlan().toString()
    assert sum(len(re.findall(r"Relation \[.*?title.*?\] parquet", p)) for p in seen) == 1 and "parquet" not in "".join(re.findall(r"Relation \[[^\]]*title[^\]]*tag_id.*", last))
    assert found.count() > 0


def test_every_page_from_its_index(spark, rows):
    dates = [None, "2024-01-01", "2024-01-01", "2024-01-02", None, "2023-05-05"]
    frame = rows("content_id long, day string", *[(i, dates[i % 6]) for i in range(57)])
    frame = frame.select("content_id", F.col("day").cast("timestamp_ntz").alias("addition_date"))
    for mode in browse.SORT_KEYS:
        index = browse.page_index(frame, mode, 10).cache()
        order = browse.sort_order(mode)
        for page in (1, 2, 3, 4, 5, 6, 0, 99):
            got = browse.indexed_page(frame, index, mode, page).collect()
            want = browse.paginate(frame, order, page, 10)
            assert sorted(map(repr, got)) == sorted(map(repr, want.select(*got[0].asDict()).collect())), (mode, page)
        assert [r.rows for r in index.orderBy("page").collect()] == [10, 10, 10, 10, 10, 7]
    assert browse.indexed_page(frame.limit(0), browse.page_index(frame.limit(0)), page=3).collect() == []


def test_a_page_is_a_range_of_the_scan(spark, inputs, tmp_path):
    rows = inputs.f_content.select("content_id", "addition_date")
    index = browse.page_index(rows)
    rows.write.parquet(str(tmp_path / "content"))
    page = browse.indexed_page(spark.read.parquet(str(tmp_path / "content")), index, page=9)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(addition_date.*LessThanOrEqual\(ad", plan)
    assert "rangepartitioning(_pos" not in plan and page.count() == 24


def test_numbers_of_any_length_in_place(rows):
    texts = ["-" + "9" * 40, "-10", "-9", "-1", "0", "1", "007", "9", "10", str(2**64 - 1), "1" + "0" * 38, "1" + "0" * 39, "9" * 60]
    odd = ["", "x", "1.5", "1e3", "--1", None]
    frame = rows("at int, t string", *enumerate([*texts, *odd]), (100, "-0"), (101, " +7 "))
    found = {r.at: r.k for r in frame.select("at", sets.number_key(F.col("t")).alias("k")).collect()}
    keys = [found[i] for i in range(len(texts))]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)
    assert all(found[len(texts) + i] is None for i in range(len(odd))) and found[100] == found[4] and found[101] == found[6]


def test_albums_follow_ids_beyond_38_digits(rows):
    album = rows("album_id long, set_tag_id long", (1, 5))
    bridge = rows("content_id long, tag_id long", *[(c, 5) for c in range(1, 6)])
    ids = {1: "2" + "0" * 40, 2: "1" + "9" * 40, 3: "-3", 4: "none", 5: "8"}
    origin = rows("content_id long, name string, origin_id string, alternate boolean", *[(c, "x", o, False) for c, o in ids.items()])
    made = sets.sync_albums(album, bridge, origin).orderBy("ord").collect()
    assert [r.content_id for r in made] == [3, 5, 4, 2, 1]


def test_applied_albums(rows):
    asked = rows(
        "origin_name string, album_title string, ord long, origin_id string",
        ("s", "old", 1, "a"), ("s", "old", 3, "b"), ("s", "old", 4, "zz"), ("s", "new", 2, "a"), ("s", "empty", 1, "zz"), ("s", None, 1, "a"),
    )
    origin = rows("content_id long, name string, origin_id string", (1, "s", "a"), (2, "s", "b"), (3, "t", "a"))
    bridge = rows("content_id long, tag_id long", (1, 7), (2, 8), (1, 9))
    tag = rows("tag_id long, title string, category string", (7, "c1", "creator"), (8, "c2", "creator"), (9, "new", "content"), (10, "new", "comic"))
    album = rows("album_id long, set_tag_id long, album_name string, is_nsfw boolean", (4, None, "old", True), (5, 1, "kept", False), (6, 1, "", False))
    order = rows("album_id long, content_id long, ord long", (4, 9, 1), (5, 9, 1))
    creator = rows("album_id long, tag_id long", (4, 1), (5, 2))
    now = {k: sorted(map(tuple, v.collect()), key=repr) for k, v in sets.apply_albums(asked, origin, bridge, tag, album, order, creator).items()}
    assert now["album"] == [(4, None, "old", True), (5, 1, "kept", False), (6, 1, "", False), (7, None, "empty", False), (8, 10, "new", False)]
    assert now["album_order"] == [(4, 1, 1), (4, 2, 3), (5, 9, 1), (8, 1, 2)]
    assert now["album_creator"] == [(4, 7), (4, 8), (5, 2), (8, 7)]


def test_callers_add_presets_sites_and_rungs(rows, monkeypatch):
    from tagloom.functions import origins
    from tagloom.operators import representations
    from tagloom.plans.tagexpr import T

    monkeypatch.setitem(search.PRESETS, "calm", T("calm") & ~T("loud"))
    monkeypatch.setattr(search, "OPEN_PRESETS", {*search.OPEN_PRESETS, "calm"})
    content = rows("content_id long, is_hidden boolean", (1, False), (2, False), (3, True), (4, False))
    bridge = rows("content_id long, tag_id long", (1, 1), (2, 1), (2, 2), (3, 1))
    alias = rows("title string, tag_id long", ("calm", 1), ("loud", 2))
    assert [r.content_id for r in search.preset_filter(content, bridge, alias, "calm").collect()] == [1]
    asked = rows("preset string, is_member boolean", ("calm", False), ("basic", False))
    assert [r.p for r in asked.select(search.allowed_filter("preset", "is_member").alias("p")).collect()] == ["calm", "safe"]

    monkeypatch.setitem(origins.SITES, "newsite", ("ns-", "https://new.example/art/{}"))
    site = rows("site string, id string", ("newsite", "42"))
    url = origins.origin_url("site", "id")
    r = site.select(url.alias("u"), origins.parse_origin_url("site", url).alias("i"), origins.site_prefix("site").alias("p")).first()
    assert (r.u, r.i, r.p) == ("https://new.example/art/42", "42", "ns-")
    assert site.select(origins.normalise_origin_id("site", url).alias("i")).first().i == "42"

    file = rows("file_id long, width int, height int, format string, is_lossless boolean", (1, 9000, 9000, "PNG", True))
    before = {r.rung for r in representations.image_ladder(file).collect()}
    monkeypatch.setitem(representations.LADDER, 8192, ("AVIF", 70, 4))
    assert {r.rung for r in representations.image_ladder(file).collect()} == before | {8192}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_rows_of_hot_keys_are_not_shuffled(spark, how):
    rows = hot_rows(spark, 6000).unionByName(spark.sql("select -1L as item, cast(null as bigint) as key"))
    small = spark.range(0, 5000, 3).select((F.col("id") + 1).alias("key"), F.lit(1).alias("x"))
    got, want = hotkeys.split_join(rows, small.hint("merge"), "key", ["item"], how, most=100), rows.join(small, "key", how)
    assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect()))
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "_salt" not in text


def test_expansion_reads_the_bridge_once(spark, rows, tmp_path):
    rows("content_id long, tag_id long", (1, 5), (1, 5), (1, None), (2, 6), (3, 9)).write.parquet(str(tmp_path / "bridge"))
    bridge = spark.read.parquet(str(tmp_path / "bridge"))
    closure = tags.implication_closure(rows("target long, implicate long", (5, 6), (6, 7), (8, 8)))
    found = tags.expand_content_tags(bridge, closure)
    text = found._jdf.queryExecution().executedPlan().toString()
    assert text.count("ReadSchema: struct<content_id:bigint,tag_id:bigint>") == 1
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(
        map(repr, [(1, 5), (1, 6), (1, 7), (1, None), (2, 6), (2, 7), (3, 9)])
    )


def test_predictions_read_the_bridge_once(spark, rows, tmp_path):
    rows("content_id long, tag_id long", (1, 5), (1, 5), (1, None), (None, 6), (2, 6)).write.parquet(str(tmp_path / "bridge"))
    bridge = spark.read.parquet(str(tmp_path / "bridge"))
    found = tags.apply_predictions(
        rows("content_id long, tag string, score double", (1, "a", 0.9), (1, "a", 0.8), (3, "a", 0.2), (None, "a", 0.5), (2, "b", 0.1), (4, "new", 0.5)),
        bridge, rows("tag_id long, title string, category string", (5, "a", "content"), (6, "b", "content")),
        rows("tag_id long, title string", (5, "a"), (6, "b")), rows("target long, implicate long", (5, 6)),
    )["content_tag"]
    text = found._jdf.queryExecution().executedPlan().toString()
    assert text.count("ReadSchema: struct<content_id:bigint,tag_id:bigint>") == 1
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, [
        (1, 5), (1, 5), (1, None), (None, 6), (2, 6), (1, 6), (3, 5), (3, 6), (None, 5), (None, 6), (4, 7),
    ]))
