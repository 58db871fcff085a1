"""Listings, pages and item details."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom import rules
from tagloom.functions import origins
from tagloom.functions.hashing import far_similarity
from tagloom.operators.representations import base_columns, image_base, preview_pick, srcset_entries, srcset_text
from tagloom.operators.search import PRESETS, preset_expr, preset_filter, require_known, tag_search
from tagloom.plans.hotkeys import split_join
from tagloom.plans.positions import first_k, number_rows
from tagloom.plans.tagexpr import ANYTHING, TagExpr
from tagloom.session import settle

# Sort name -> order; the item id makes every order complete. Callers may add modes.
SORTS = {
    "unsorted": lambda seed: [F.col("content_id")],
    "date": lambda seed: [F.col("addition_date"), F.col("content_id")],
    "date decreasing": lambda seed: [F.col("addition_date").desc(), F.col("content_id")],
    "random": lambda seed: [F.xxhash64(F.lit(seed), "content_id"), F.col("content_id")],
}


# Sort name -> (column, is it decreasing): the orders that a page index can be kept for.
SORT_KEYS = {
    "unsorted": (("content_id", False),),
    "date": (("addition_date", False), ("content_id", False)),
    "date decreasing": (("addition_date", True), ("content_id", False)),
}


def sort_order(mode: str, seed: int = 0) -> list[Column]:
    return SORTS.get(mode, SORTS["date decreasing"])(seed)


def sort_content(df: DataFrame, mode: str, seed: int = 0) -> DataFrame:
    return df.orderBy(*sort_order(mode, seed))


def sorted_positions(df: DataFrame, mode: str, seed: int = 0) -> DataFrame:
    """Every row with its position in the order of a sort mode, numbered without one task for all."""
    return number_rows(df, "position", sort_order(mode, seed))


def page_size(asked) -> int:
    try:
        size = int(asked)
    except (TypeError, ValueError):
        size = rules.PAGE_SIZE
    return max(min(size, rules.PAGE_MAX), rules.PAGE_MIN)


def paginate(df: DataFrame, order: Sequence[Column], page: int = 1, per_page=rules.PAGE_SIZE) -> DataFrame:
    """One page with page, pages, has_previous and has_next.

    A page below 1 or beyond the end is the last page. The first page is a plain
    top-k; every other page is read off a distributed numbering, which also tells the
    number of rows.
    """
    size = page_size(per_page)
    if page == 1:
        total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
        shown = df.orderBy(*order).limit(size)
    else:
        numbered = number_rows(df, "_pos", order)
        rows = numbered.agg(F.max("_pos")).first()[0] or 0
        last = max(1, -(-rows // size))
        page = page if 1 <= page <= last else last
        total = F.lit(rows)
        shown = numbered.filter(F.col("_pos").between((page - 1) * size + 1, page * size)).drop("_pos")
    pages = F.greatest(F.ceil(total / size), F.lit(1)).cast("int")
    return shown.select(
        "*", F.lit(page).alias("page"), pages.alias("pages"), F.lit(page > 1).alias("has_previous"),
        (F.lit(page) < pages).alias("has_next"),
    )


def number_pages(df: DataFrame, order: Sequence[Column], per_page=rules.PAGE_SIZE) -> DataFrame:
    """Every row with its position and page, for a whole sorted listing."""
    size = page_size(per_page)
    numbered = number_rows(df, "position", order)
    return numbered.withColumn("page", (F.floor((F.col("position") - 1) / size) + 1).cast("int"))


def page_index(df: DataFrame, mode: str = "date decreasing", per_page=rules.PAGE_SIZE) -> DataFrame:
    """(page, rows, first, last): the sort keys of the first and last row of every page of a listing.

    Made once per state of the listing; a row per page, so it is a per_page-th of the listing.
    """
    keys = F.struct(*[F.col(c) for c, _ in SORT_KEYS[mode]])
    paged = number_pages(df.select(*[c for c, _ in SORT_KEYS[mode]]), sort_order(mode), per_page)
    return paged.groupBy("page").agg(
        F.count(F.lit(1)).alias("rows"), F.min_by(keys, "position").alias("first"), F.max_by(keys, "position").alias("last")
    )


def _before(key: tuple[str, bool], value) -> Column:
    """Does a row's column come before ``value``? Nulls are first in increasing order, last in decreasing."""
    name, decreasing = key
    here = F.col(name)
    if value is None:
        return here.isNotNull() if decreasing else F.lit(False)
    return F.coalesce(here > F.lit(value), F.lit(False)) if decreasing else here.isNull() | (here < F.lit(value))


def _not_after(key: tuple[str, bool], value) -> Column:
    return _before(key, value) | _is(key[0], value)


def _is(name: str, value) -> Column:
    return F.col(name).isNull() if value is None else F.coalesce(F.col(name) == F.lit(value), F.lit(False))


def _up_to(keys: Sequence[tuple[str, bool]], values: Sequence) -> Column:
    """Does a row come no later in the order than one with these values?"""
    first, rest = _not_after(keys[0], values[0]), keys[1:]
    if not rest:
        return first
    return _before(keys[0], values[0]) | (_is(keys[0][0], values[0]) & _up_to(rest, values[1:]))


def _from(keys: Sequence[tuple[str, bool]], values: Sequence) -> Column:
    """Does a row come no earlier in the order than one with these values?"""
    if len(keys) == 1:
        return ~_before(keys[0], values[0])
    later = ~_before(keys[0], values[0]) & ~_is(keys[0][0], values[0])
    return later | (_is(keys[0][0], values[0]) & _from(keys[1:], values[1:]))


def indexed_page(df: DataFrame, index: DataFrame, mode: str = "date decreasing", page: int = 1) -> DataFrame:
    """A page of a listing whose :func:`page_index` is at hand, at any depth, without numbering it.

    Two rows of the index are fetched, the page asked for and the last one; the page's rows are those
    between its first and last key, a range that reaches the scan as a filter on the leading sort
    column. A page below 1 or beyond the end is the last page.
    """
    keys = SORT_KEYS[mode]
    found = {r["page"]: r for r in index.filter(F.col("page") == page).unionByName(index.orderBy(F.col("page").desc()).limit(1)).collect()}
    last = max(found, default=1)
    page = page if page in found else last
    if not found:
        shown = df.limit(0)
    else:
        first, end = found[page]["first"], found[page]["last"]
        lead, between = keys[0][0], None
        bounds = sorted(x for x in (first[0], end[0]) if x is not None)
        if len(bounds) == 2:
            between = F.col(lead).between(F.lit(bounds[0]), F.lit(bounds[1]))
        within = _from(keys, tuple(first)) & _up_to(keys, tuple(end))
        shown = df.filter(within if between is None else between & within)
    return shown.orderBy(*sort_order(mode)).select(
        "*", F.lit(page).alias("page"), F.lit(last).alias("pages"), F.lit(page > 1).alias("has_previous"),
        F.lit(page < last).alias("has_next"),
    )


def with_base_image(shown: DataFrame, representation: DataFrame, width: int, height: int) -> DataFrame:
    """Add base_src and srcset_n to the rows of one page; ``srcset_entries`` has the addresses as rows.

    The page is settled first: it is at most ``PAGE_MAX`` rows, used twice here, and
    small enough to be sent to every scan task of the renditions.
    """
    shown = settle(shown)
    ids = F.broadcast(shown.select("content_id").distinct())
    bases = image_base(representation.join(ids, "content_id", "left_semi"), width, height)
    return with_image_count(shown.join(bases, "content_id", "left"))


def with_image_count(df: DataFrame) -> DataFrame:
    return df.withColumn("srcset_n", F.coalesce("srcset_n", F.lit(0)).cast("long"))


def page_srcset(shown: DataFrame, representation: DataFrame, width: int, height: int, places: int | None = None) -> DataFrame:
    """(content_id, width, filepath, url, ratio_text) of the images of a page's items, a row per image."""
    ids = F.broadcast(settle(shown.select("content_id").distinct()))
    return srcset_entries(representation.join(ids, "content_id", "left_semi"), width, height, places=places).drop("ratio")


def content_listing(
    content: DataFrame,
    content_tag: DataFrame,
    alias: DataFrame,
    representation: DataFrame,
    expr: TagExpr = ANYTHING,
    preset: str = "safe",
    sort: str = "date decreasing",
    page: int = 1,
    per_page=rules.PAGE_SIZE,
    seed: int = 0,
) -> DataFrame:
    """Search, preset, sort, page and base images of a catalog listing; ``page_srcset`` has the addresses.

    Search and preset are one expression, so the bridge is read once for both.
    """
    if preset not in PRESETS:
        preset = "safe"
    columns = ["content_id", "title", "content_type", "slug", "addition_date", "is_hidden"]
    rows = content.select(*columns)
    if preset_expr(preset).names() and expr.names():
        # The preset's tags must exist; a name of the caller's that does not empties the list.
        visible = rows.filter(~F.col("is_hidden"))
        require_known(alias, sorted(preset_expr(preset).names()))
        found = tag_search(visible, content_tag, alias, preset_expr(preset) & expr)
    else:
        found = tag_search(preset_filter(rows, content_tag, alias, preset), content_tag, alias, expr)
    shown = paginate(found, sort_order(sort, seed), page, per_page)
    return with_base_image(shown, representation, 256, 256).drop("is_hidden")


def item_albums(album_order: DataFrame, album: DataFrame, tag: DataFrame) -> DataFrame:
    """(content_id, album_id, ord, name): the albums that hold an item, as its page names them."""
    set_title = tag.select(F.col("tag_id").alias("set_tag_id"), F.col("title").alias("_set"))
    name = F.coalesce(F.nullif(F.col("album_name"), F.lit("")), F.col("_set"), F.lit("untitled"))
    named = album.join(set_title, "set_tag_id", "left").select("album_id", name.alias("name"))
    return split_join(album_order.select("content_id", "album_id", "ord"), named, "album_id", ["content_id"])


def tags_by_category(content_tag: DataFrame, tag: DataFrame) -> DataFrame:
    """(content_id, category, tag_id, title): tags of items under their categories."""
    return content_tag.join(tag, "tag_id").select("content_id", "category", "tag_id", "title")


def video_choices(representation: DataFrame, level: int = rules.DEFAULT_LEVEL) -> DataFrame:
    """Video renditions, each marked playable when it is at or below the viewer's level."""
    videos = representation.filter(F.col("repr_type") == rules.VIDEO)
    return videos.select(
        "content_id", "filepath", "compatibility_level",
        (F.col("compatibility_level") <= level).alias("playable"),
    )


def origin_links(origin: DataFrame) -> DataFrame:
    return origin.select(
        "content_id", "name", "origin_id", origins.origin_url("name", "origin_id").alias("url"), "alternate"
    )


def _of_items(rows: DataFrame, content: DataFrame) -> DataFrame:
    """Rows of items that are there, so that no others are gathered; the ids of a task's share are all it holds."""
    return rows.join(content.select("content_id").hint("shuffle_hash"), "content_id", "left_semi")


def item_tags(content: DataFrame, content_tag: DataFrame, tag: DataFrame) -> DataFrame:
    """(content_id, tag_count, tags, plain_tags) of items with known tags, in order of category and title.

    ``tags`` has an entry per category with its (tag_id, title); ``plain_tags`` is all titles in one text.
    """
    named = tag.groupBy("tag_id").agg(F.min(F.struct("category", "title")).alias("t")).select("tag_id", "t.category", "t.title")
    known = split_join(content_tag.select("content_id", "tag_id"), named, "tag_id", ["content_id"])
    held = _of_items(known, content).groupBy("content_id").agg(
        F.sort_array(F.collect_list(F.struct("category", "title", "tag_id"))).alias("_held")
    )

    def under(category: Column) -> Column:
        same = F.filter("_held", lambda t: t["category"].eqNullSafe(category))
        return F.struct(category.alias("category"), F.transform(same, lambda t: F.struct(t["tag_id"], t["title"])).alias("tags"))

    return held.select(
        "content_id", F.size("_held").cast("long").alias("tag_count"),
        F.transform(F.array_distinct(F.col("_held")["category"]), under).alias("tags"),
        F.array_join(F.col("_held")["title"], ", ").alias("plain_tags"),
    )


def _listed(rows: DataFrame, name: str, *columns: str) -> DataFrame:
    """(content_id, name): the rows of an item as one sorted list."""
    return rows.groupBy("content_id").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))


def content_detail(
    content: DataFrame, content_tag: DataFrame, tag: DataFrame, representation: DataFrame,
    origin: DataFrame | None = None, album_order: DataFrame | None = None, album: DataFrame | None = None,
    level: int = rules.DEFAULT_LEVEL,
) -> DataFrame:
    """One row per item with all that its page shows.

    Tags under their categories (``tags``) and as one text (``plain_tags``), has_image, videos from the
    highest level down with their playable flag (``video_list``), image addresses at 1024 (``srcset``,
    ``base_src``) and the number of tags, videos and addresses. ``origins`` has the links to where the item
    is from, main ones first, where ``origin`` is given; ``albums`` those that hold it, where ``album_order``
    and ``album`` are. Lists are whole, however long; an item without entries has an empty one.

    The same lists as rows are ``tags_by_category``, ``video_choices``, ``origin_links``, ``srcset_entries``
    and ``item_albums``. Renditions are read once; over tables of ``write_bucketed`` nothing is exchanged.
    """
    # Renditions of a table without levels are all listed; whether they play is unknown.
    at = F.col("compatibility_level") if "compatibility_level" in representation.columns else F.lit(None).cast("int")
    video = F.when(
        F.col("repr_type") == rules.VIDEO,
        F.struct((-at.cast("long")).alias("down"), F.col("filepath"), at.alias("compatibility_level")),
    )
    kinds = _of_items(representation, content).groupBy("content_id").agg(
        F.bool_or(F.col("repr_type") == rules.IMAGE).alias("has_image"),
        F.sum((F.col("repr_type") == rules.VIDEO).cast("long")).alias("videos"),
        F.sort_array(F.collect_list(video)).alias("_videos"),
        srcset_text(1024, 1024).alias("srcset"),
        *base_columns(1024, 1024),
    )
    shown = F.transform("_videos", lambda v: F.struct(
        v["compatibility_level"], v["filepath"], (v["compatibility_level"] <= level).alias("playable")
    ))
    kinds = kinds.withColumn("video_list", shown).drop("_videos")
    detail = content.select("content_id", "slug", "title", "content_type")
    detail = detail.join(item_tags(content, content_tag, tag), "content_id", "left").join(kinds, "content_id", "left")
    lists = ["tags", "video_list"]
    if origin is not None:
        links = _listed(_of_items(origin_links(origin), content), "origins", "alternate", "name", "origin_id", "url")
        detail, lists = detail.join(links, "content_id", "left"), [*lists, "origins"]
    if album_order is not None and album is not None:
        held = _listed(_of_items(item_albums(album_order, album, tag), content), "albums", "album_id", "ord", "name")
        detail, lists = detail.join(held, "content_id", "left"), [*lists, "albums"]
    return detail.select(
        "content_id", "slug", "title", "content_type",
        F.coalesce("tag_count", F.lit(0)).cast("long").alias("tag_count"),
        F.coalesce("has_image", F.lit(False)).alias("has_image"),
        F.coalesce("videos", F.lit(0)).cast("long").alias("videos"),
        F.coalesce("srcset_n", F.lit(0)).cast("long").alias("srcset_n"), "base_src",
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("plain_tags", "srcset")],
        *[F.coalesce(c, F.array()).alias(c) for c in lists],
    )


def resolve_slugs(requests: DataFrame, content: DataFrame, redirect: DataFrame) -> DataFrame:
    """(slug, status, content_id, current_slug): direct, through a redirect, or not found."""
    here = content.select(F.col("slug"), F.col("content_id").alias("_direct"))
    moved = redirect.select(F.col("old_slug").alias("slug"), F.col("new_content_id").alias("_moved"))
    target = content.select(F.col("content_id"), F.col("slug").alias("current_slug"))
    status = (
        F.when(F.col("_direct").isNotNull(), "found").when(F.col("_moved").isNotNull(), "moved")
        .otherwise("not found")
    )
    found = requests.join(here, "slug", "left").join(moved, "slug", "left").select(
        *requests.columns, status.alias("status"), F.coalesce("_direct", "_moved").alias("content_id")
    )
    return found.join(target, "content_id", "left")


def similar_content(image_hash: DataFrame, content: DataFrame, limit: int = rules.SIMILAR_LIMIT) -> DataFrame:
    """(content_id, rank, similar_id): items with the same far-similarity key.

    Every item of a group is shown the same first ``limit + 1`` members, less itself,
    so those are found once per group and joined back: the members of a group are
    never paired with each other. ``content`` is not broadcast: slugs are made from its
    columns, so its files say little about how large they are.
    """
    keyed = image_hash.select(
        "content_id", far_similarity("l_hash", "a_hash", "b_hash").alias("far")
    )
    shown = first_k(keyed, ["far"], [F.col("content_id")], limit + 1).groupBy("far").agg(
        F.sort_array(F.collect_list("content_id")).alias("_members")
    )
    others = F.slice(F.array_remove(F.col("_members"), F.col("content_id")), 1, limit)
    listed = keyed.join(shown, "far").select("content_id", F.posexplode(others).alias("_at", "similar_id"))
    details = content.select(
        F.col("content_id").alias("similar_id"), F.col("slug").alias("similar_slug"),
        F.col("title").alias("similar_title"),
    )
    return listed.join(details.hint("merge"), "similar_id").select(
        "content_id", (F.col("_at") + 1).alias("rank"), "similar_id", "similar_slug", "similar_title"
    )


def collections_without(requests: DataFrame, collection: DataFrame, items: DataFrame) -> DataFrame:
    """For each (user_id, content_id): the user's collections that do not hold the item."""
    own = requests.join(collection.select("user_id", "collection_id", "title"), "user_id")
    return own.join(
        items.select("collection_id", "content_id"), ["collection_id", "content_id"], "left_anti"
    ).select("user_id", "content_id", "collection_id", "title")


def catalog_rows(content: DataFrame, representation: DataFrame) -> DataFrame:
    """Back-office list: thumbnail path, shortened title, type, visibility, date."""
    title = F.col("title")
    short = F.when(F.length(title) > 16, F.concat(F.left(title, F.lit(16)), F.lit("…"))).otherwise(title)
    return content.join(preview_pick(representation, 128), "content_id", "left").select(
        "content_id", F.col("preview").alias("thumbnail"), short.alias("title_short"), "content_type",
        (~F.col("is_hidden")).alias("is_visible"), "addition_date",
    )
