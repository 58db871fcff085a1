"""Plans keep the shape they need at scale."""

import re

import pytest
from pyspark.sql import functions as F

from tagloom.operators import browse, search
from tagloom.plans.positions import first_k
from tagloom.plans.tagexpr import T
from tagloom.workloads.catalog import QUERIES
from tests.conftest import SF_DIR


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_products_and_no_single_partition_windows(spark, name):
    text = plan(QUERIES[name].run(spark, SF_DIR))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    # The one ordering over all rows runs over a row per partition of a numbering.
    for single in re.findall(r"Exchange SinglePartition.*?\n(.*?)\n(.*?)\n", text):
        below = " ".join(single)
        assert "partial_" in below or "_part" in below, below


def test_search_reads_the_bridge_once(spark, inputs, tmp_path):
    bridge = str(tmp_path / "bridge")
    inputs.f_content_tag.write.parquet(bridge)
    stored = spark.read.parquet(bridge)
    expr = (T("safe") & ~T("cold")) | (T("red") & ~T("economy"))
    text = plan(search.tag_search(inputs.f_content, stored, inputs.f_alias, expr))
    assert text.count("ReadSchema: struct<content_id:bigint,tag_id:bigint>") == 1
    assert "BroadcastHashJoin" in text


def test_group_limit_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    text = plan(first_k(df, ["g"], [F.col("id")], 51))
    limit, shuffle = text.index("WindowGroupLimit"), text.index("Exchange")
    assert text.count("WindowGroupLimit") == 2 and text.rindex("WindowGroupLimit") > shuffle > limit


def test_first_page_is_a_top_k(inputs):
    text = plan(browse.paginate(inputs.f_content, browse.sort_order("date decreasing")))
    assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text


def test_filters_and_columns_reach_the_scan(spark, inputs, tmp_path):
    path = str(tmp_path / "content")
    inputs.f_content.write.parquet(path)
    rows = search.preset_filter(spark.read.parquet(path), inputs.f_content_tag, inputs.f_alias, "basic")
    text = plan(rows.select("content_id"))
    scan = next(line for line in text.splitlines() if "ReadSchema: struct<content_id:bigint,is_hidden:boolean>" in line)
    assert re.search(r"PushedFilters: \[[^\]]*is_hidden", scan), scan
    assert re.search(r"ReadSchema: struct<content_id:bigint,is_hidden:boolean>", text)


def test_saved_searches_shuffle_pairs_by_item_only(rows):
    content = rows("content_id long", (1,), (2,), (3,))
    bridge = rows("content_id long, tag_id long", (1, 5), (1, 6), (2, 6), (4, 5))
    alias = rows("title string, tag_id long", ("a", 5), ("b", 6))
    clauses = rows(
        "search_id long, clause_no int, alias string, negated boolean",
        (1, 1, "a", False), (1, 2, "b", False), (2, 1, "a", True), (3, 1, "a", True), (3, 2, "b", True), (4, 1, "no", True),
    )
    found = search.match_saved_searches(content, bridge, alias, clauses)
    assert sorted(map(tuple, found.collect())) == [(1, 1), (2, 2), (3, 2), (3, 3)]
    assert not re.findall(r"hashpartitioning\(content_id#\d+L, search_id", plan(found))


def test_similar_items_leave_the_catalog_off_the_driver(inputs):
    text = plan(browse.similar_content(inputs.f_imagehash, inputs.f_content))
    assert "SortMergeJoin [similar_id" in text and "BroadcastHashJoin [similar_id" not in text


def test_queries_keep_long_methods_compiled(spark):
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    try:
        for own, then in (("65535", "8000"), ("4000", "4000")):
            spark.conf.set(name, own)
            QUERIES["origin_url"].run(spark, SF_DIR)
            assert spark.conf.get(name) == then
    finally:
        spark.conf.set(name, before)


def test_item_detail_reads_renditions_once(spark, inputs, tmp_path):
    inputs.f_representation.write.parquet(str(tmp_path / "r"))
    stored = spark.read.parquet(str(tmp_path / "r"))
    text = plan(browse.content_detail(inputs.f_content, inputs.f_content_tag, inputs.f_tag, stored))
    assert len(re.findall(r"Location: InMemoryFileIndex[^\n]*/r\]", text)) == 1


def test_tags_of_items_are_told_apart_by_number(inputs):
    keys = re.findall(r"HashAggregate\(keys=\[([^\]]*)\]", plan(inputs.f_content_tag))
    assert keys and all("title" not in k for k in keys)
    named = inputs.f_tag_name.selectExpr("content_id", "cast(conv(substr(md5(category || ':' || title), 1, 15), 16, 10) as bigint)")
    assert named.exceptAll(inputs.f_content_tag).isEmpty() and inputs.f_content_tag.exceptAll(named).isEmpty()


def test_passports_parse_only_what_they_read(spark):
    parsed = lambda name: re.findall(r"from_json\((.*?)columnNameOfCorruptRecord", plan(QUERIES[name].run(spark, SF_DIR)))
    passport = parsed("media_passport")
    assert passport and all("r_frame_rate" in p and "attached_pic" not in p and "bit_rate" not in p for p in passport)
    assert any("attached_pic" in p for p in parsed("thumbnail_stream"))
