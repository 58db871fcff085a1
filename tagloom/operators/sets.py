"""Albums and collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom import rules
from tagloom.operators.browse import paginate, with_base_image, with_image_count
from tagloom.operators.representations import image_base
from tagloom.operators.search import nsfw_visible
from tagloom.plans.hotkeys import split_join
from tagloom.plans.positions import first_by, number_rows
from tagloom.session import settle

# Sort position of an item without a numeric origin id (fixed value).
NO_NUMBER = 2**64 - 1
_PLACES = 10  # digits of a digit count; no text is longer than 2^31


def number_key(text: Column) -> Column:
    """A text that sorts as the whole number ``text`` says, of any length; null where it says none.

    Sign, count of digits, digits; of negative numbers the last two are complemented, so that
    more digits, and greater ones, come first.
    """
    bare = F.regexp_extract(F.trim(text), "^[+-]?0*([0-9]+)$", 1)
    negative = F.startswith(F.trim(text), F.lit("-")) & (bare != "0")
    count = F.length(bare)
    flipped = F.translate(bare, "0123456789", "9876543210")
    sized = lambda n: F.lpad(n.cast("string"), _PLACES, "0")
    return F.when(bare == "", None).when(
        negative, F.concat(F.lit("0"), sized(10**_PLACES - 1 - count), flipped)
    ).otherwise(F.concat(F.lit("1"), sized(count), bare))


def _origin_number(origin: DataFrame) -> DataFrame:
    """(content_id, number): the key of the id of the first main origin, else of the first one.

    Null where there is no id or it is not a number.
    """
    order = [F.col("alternate"), F.col("name"), F.col("origin_id")]
    first = origin.groupBy("content_id").agg(first_by(order, "origin_id").alias("o"))
    return first.select("content_id", number_key(F.col("o.origin_id")).alias("number"))


def sync_albums(album: DataFrame, content_tag: DataFrame, origin: DataFrame) -> DataFrame:
    """(album_id, content_id, ord): albums rebuilt from the items of their set tag.

    Order: numeric origin id, items without one last, then item id. An album may hold
    most of the catalog, so positions come from a distributed numbering.
    """
    sets = album.filter(F.col("set_tag_id").isNotNull()).select("album_id", F.col("set_tag_id").alias("tag_id"))
    members = split_join(content_tag.select("content_id", "tag_id"), sets, "tag_id", ["content_id"]).select("album_id", "content_id")
    number = F.coalesce("number", number_key(F.lit(str(NO_NUMBER))))
    keyed = members.join(_origin_number(origin), "content_id", "left").select(
        "album_id", "content_id", number.alias("number")
    )
    return number_rows(keyed, "ord", ["number", "content_id"], by=["album_id"]).drop("number")


def album_creators(
    items: DataFrame, content_tag: DataFrame, tag: DataFrame, before: DataFrame
) -> DataFrame:
    """(album_id, tag_id): creators of the members; albums without any keep ``before``."""
    creators = tag.filter(F.col("category") == "creator").select("tag_id")
    by_item = content_tag.join(creators, "tag_id", "left_semi")
    found = items.select("album_id", "content_id").join(by_item, "content_id").select("album_id", "tag_id").distinct()
    kept = before.select("album_id", "tag_id").join(
        found.select("album_id").distinct(), "album_id", "left_anti"
    )
    return found.unionByName(kept)


def register_albums(
    requests: DataFrame, origin: DataFrame, content_tag: DataFrame, tag: DataFrame, album: DataFrame
) -> dict[str, DataFrame]:
    """Albums given by sites as ordered origin ids.

    ``requests``: origin_name, album_title, content_sequence (array) or
    ordered_content (map ordinal -> id); one request per title. Ids that are not in
    the catalog are skipped, their ordinals stay used; a request with an ordinal that is no
    number is an error. Returns ``items``
    (album_title, content_id, ord) and ``summary`` with counts, status and set tag.
    """
    both = F.col("content_sequence").isNotNull() & F.col("ordered_content").isNotNull()
    neither = F.col("content_sequence").isNull() & F.col("ordered_content").isNull()
    unread = F.exists(F.map_keys("ordered_content"), lambda k: k.try_cast("long").isNull())
    error = F.when(both, "both forms given").when(neither, "no content given").when(unread, "ordinal is no number")
    valid = requests.filter(error.isNull())
    as_list = valid.filter(F.col("content_sequence").isNotNull()).select(
        "album_title", "origin_name", F.posexplode("content_sequence").alias("at", "origin_id")
    ).select("album_title", "origin_name", (F.col("at") + 1).cast("long").alias("ord"), "origin_id")
    as_map = valid.filter(F.col("ordered_content").isNotNull()).select(
        "album_title", "origin_name", F.explode("ordered_content").alias("ord", "origin_id")
    ).select("album_title", "origin_name", F.col("ord").try_cast("long").alias("ord"), "origin_id")
    asked = as_list.unionByName(as_map)
    # Empty ids repeat; like any other id they stand for one item.
    known = origin.groupBy(F.col("name").alias("origin_name"), "origin_id").agg(F.max("content_id").alias("content_id"))
    placed = asked.join(known, ["origin_name", "origin_id"], "left").select("album_title", "content_id", "ord")
    items = placed.filter(F.col("content_id").isNotNull())
    creators = album_creators(
        items.withColumnRenamed("album_title", "album_id"), content_tag, tag,
        items.limit(0).select(F.col("album_title").alias("album_id"), F.lit(0).cast("long").alias("tag_id")),
    ).groupBy(F.col("album_id").alias("album_title")).agg(F.count(F.lit(1)).alias("creators_found"))
    counts = placed.groupBy("album_title").agg(
        F.count(F.lit(1)).alias("items_total"), F.count("content_id").alias("items_registered")
    )
    present = album.filter(F.col("album_name") != "").groupBy(F.col("album_name").alias("album_title")).agg(
        F.min("album_id").alias("album_id"), F.max("set_tag_id").alias("_set")
    )
    set_tag = tag.filter(F.col("category").isin(*rules.ALBUM_CATEGORIES)).groupBy(
        F.col("title").alias("album_title")
    ).agg(F.min("tag_id").alias("_same_title"))
    summary = (
        requests.select("album_title", "origin_name", error.alias("error"))
        .join(counts, "album_title", "left")
        .join(creators, "album_title", "left").join(present, "album_title", "left")
        .join(set_tag, "album_title", "left")
        .select(
            "album_title", "origin_name", F.coalesce("error", F.lit("success")).alias("status"),
            "album_id", F.col("album_id").isNull().alias("created"),
            *[
                F.coalesce(c, F.lit(0)).cast("long").alias(c)
                for c in ("items_registered", "items_total", "creators_found")
            ],
            F.coalesce("_set", "_same_title").alias("set_tag_id"),
        )
    )
    return {"items": items, "summary": summary}


def apply_albums(
    asked: DataFrame, origin: DataFrame, content_tag: DataFrame, tag: DataFrame, album: DataFrame,
    album_order: DataFrame, album_creator: DataFrame,
) -> dict[str, DataFrame]:
    """The album tables after sites have given albums as rows (origin_name, album_title, ord, origin_id).

    An album of the title is found (of several the lowest id) or made, with ids after the highest
    in order of title. All members it had go, and the items found take their place at the ordinals
    given; creators are replaced where the items have any; an album without a set tag gets the tag of
    its title. Albums nobody gave stay as they are. Returns ``album``, ``album_order`` and ``album_creator``.

    Members and creators that go are anti-joined away by album, so nothing of an album is ever in one
    place. Rows without a title are left out. A title is given once, by one site.
    """
    asked = asked.filter(F.coalesce("album_title", F.lit("")) != "")
    present = album.filter(F.coalesce("album_name", F.lit("")) != "").groupBy(F.col("album_name").alias("album_title")).agg(
        F.min("album_id").alias("album_id")
    )
    titles = settle(asked.select("album_title").distinct().join(present, "album_title", "left"))
    numbered = number_rows(titles.filter("album_id is null").select("album_title"), "_n", ["album_title"])
    top = album.agg(F.coalesce(F.max("album_id"), F.lit(0)).alias("m")).scalar()
    made = numbered.select("album_title", (F.col("_n") + top).alias("album_id"))
    given = settle(titles.filter("album_id is not null").select("album_title", "album_id").unionByName(made))

    known = origin.groupBy(F.col("name").alias("origin_name"), "origin_id").agg(F.max("content_id").alias("content_id"))
    items = settle(
        asked.join(known, ["origin_name", "origin_id"]).join(given, "album_title").select("album_id", "content_id", "ord")
    )
    touched = given.select("album_id")
    orders = album_order.join(touched, "album_id", "left_anti").select("album_id", "content_id", "ord").unionByName(items)

    creators = tag.filter(F.col("category") == "creator").select("tag_id")
    by_item = content_tag.join(creators, "tag_id", "left_semi").select("content_id", "tag_id")
    found = settle(items.select("album_id", "content_id").join(by_item, "content_id").select("album_id", "tag_id").distinct())
    kept = album_creator.join(found.select("album_id").distinct(), "album_id", "left_anti")

    same = tag.filter(F.col("category").isin(*rules.ALBUM_CATEGORIES)).groupBy(F.col("title").alias("album_title")).agg(
        F.min("tag_id").alias("_same")
    )
    sets = given.join(same, "album_title", "left")
    old = album.join(sets.select("album_id", "_same"), "album_id", "left").select(
        "album_id", F.coalesce("set_tag_id", "_same").alias("set_tag_id"), "album_name", "is_nsfw"
    )
    new = sets.join(made.select("album_id"), "album_id", "left_semi").select(
        "album_id", F.col("_same").alias("set_tag_id"), F.col("album_title").alias("album_name"), F.lit(False).alias("is_nsfw")
    )
    return {
        "album": old.unionByName(new), "album_order": orders,
        "album_creator": kept.select("album_id", "tag_id").unionByName(found),
    }


def album_names(album: DataFrame, tag: DataFrame) -> DataFrame:
    """(album_id, name) as an album is shown; its creators are the rows of ``album_makers``."""
    set_title = tag.select(F.col("tag_id").alias("set_tag_id"), F.col("title").alias("_set"))
    name = F.coalesce(F.nullif(F.col("album_name"), F.lit("")), F.col("_set"), F.lit("untitled"))
    return album.join(set_title, "set_tag_id", "left").select("album_id", name.alias("name"))


def album_makers(album: DataFrame, creators: DataFrame, tag: DataFrame) -> DataFrame:
    """(album_id, creator): a row per creator shown with an album; "Unknown Creators" where there is none."""
    titles = creators.join(tag.select("tag_id", F.col("title").alias("creator")), "tag_id").select("album_id", "creator")
    return album.select("album_id").join(titles, "album_id", "left").withColumn(
        "creator", F.coalesce("creator", F.lit("Unknown Creators"))
    )


def album_covers(items: DataFrame) -> DataFrame:
    """(album_id, content_id) of the item with the lowest position."""
    return items.groupBy("album_id").agg(F.min_by("content_id", "ord").alias("content_id"))


def album_listing(
    album: DataFrame, items: DataFrame, tag: DataFrame, representation: DataFrame,
    is_member: bool = False, show_nsfw: bool = False, page: int = 1,
) -> DataFrame:
    """One page of albums with name, cover and its base image at 192x256."""
    visible = album.filter(nsfw_visible("is_nsfw", F.lit(is_member), F.lit(show_nsfw)))
    set_title = tag.select(F.col("tag_id").alias("set_tag_id"), F.col("title").alias("_set"))
    name = F.coalesce(F.nullif(F.col("album_name"), F.lit("")), F.col("_set"), F.lit("untitled"))
    shown = settle(paginate(visible, [F.col("album_id")], page, rules.ALBUM_PAGE_SIZE))
    covers = album_covers(items.join(F.broadcast(shown.select("album_id")), "album_id", "left_semi"))
    rows = shown.join(set_title, "set_tag_id", "left").join(covers, "album_id", "left").select(
        "album_id", name.alias("name"), "is_nsfw", "content_id", "page", "pages"
    )
    return with_base_image(rows, representation, 192, 256)


def all_album_covers(album: DataFrame, items: DataFrame, representation: DataFrame) -> DataFrame:
    """Every album with its cover item and the cover's base image at 192x256."""
    covers = album_covers(items)
    bases = image_base(representation, 192, 256)
    return with_image_count(
        album.select("album_id").join(covers, "album_id", "left").join(bases, "content_id", "left")
        .select("album_id", "content_id", "srcset_n", "base_src")
    )


def album_detail(
    album_id: int, items: DataFrame, content: DataFrame, representation: DataFrame,
    page: int = 1, per_page=rules.PAGE_SIZE,
) -> DataFrame:
    """One page of an album's items in order, with base images at 256."""
    rows = items.filter(F.col("album_id") == album_id).join(
        content.select("content_id", "slug", "title", "content_type"), "content_id"
    ).select("ord", "content_id", "slug", "title", "content_type")
    return with_base_image(paginate(rows, [F.col("ord")], page, per_page), representation, 256, 256)


def album_pages(items: DataFrame, per_page: int = rules.PAGE_SIZE) -> DataFrame:
    """Every album item with its position and page inside the album."""
    numbered = number_rows(items.select("album_id", "ord", "content_id"), "position", ["ord"], by=["album_id"])
    return numbered.withColumn("page", (F.floor((F.col("position") - 1) / per_page) + 1).cast("int"))


def _pages_with_base(
    items: DataFrame, owner: str, order: str, content: DataFrame, representation: DataFrame, per_page: int
) -> DataFrame:
    numbered = number_rows(items, "position", [order], by=[owner])
    page = (F.floor((F.col("position") - 1) / per_page) + 1).cast("int")
    bases = image_base(representation, 256, 256)
    return (
        numbered.join(content.select("content_id", "slug", "title", "content_type"), "content_id")
        .join(bases, "content_id", "left")
        .select(
            owner, "position", page.alias("page"), "content_id", "slug", "title", "content_type",
            F.coalesce("srcset_n", F.lit(0)).cast("long").alias("srcset_n"), "base_src",
        )
    )


def all_album_details(
    items: DataFrame, content: DataFrame, representation: DataFrame, per_page: int = rules.PAGE_SIZE
) -> DataFrame:
    """Every page of every album: items in order with base images at 256."""
    rows = items.select("album_id", "ord", "content_id")
    return _pages_with_base(rows, "album_id", "ord", content, representation, per_page)


def all_collection_details(
    items: DataFrame, content: DataFrame, representation: DataFrame, per_page: int = rules.PAGE_SIZE
) -> DataFrame:
    """Every page of every collection: items by id with base images at 256."""
    rows = items.select("collection_id", "content_id")
    return _pages_with_base(rows, "collection_id", "content_id", content, representation, per_page)


def collection_listing(
    collection: DataFrame, items: DataFrame, representation: DataFrame, show_nsfw: bool = False
) -> DataFrame:
    """Collections of all users, with item count and the cover's base image at 128."""
    visible = collection if show_nsfw else collection.filter(~F.col("is_nsfw"))
    facts = items.groupBy("collection_id").agg(
        F.count(F.lit(1)).alias("items"), F.min("content_id").alias("content_id")
    )
    bases = image_base(representation, 128, 128)
    return (
        visible.join(facts, "collection_id", "left").join(bases, "content_id", "left")
        .select(
            "user_id", "collection_id", "title", "is_nsfw", "created_at",
            F.coalesce("items", F.lit(0)).cast("long").alias("items"), F.col("content_id").alias("cover_id"),
            F.coalesce("srcset_n", F.lit(0)).cast("long").alias("srcset_n"), "base_src",
        )
    )


def collection_detail(
    user_id: int, collection_id: int, collection: DataFrame, items: DataFrame, content: DataFrame,
    representation: DataFrame, page: int = 1, per_page=rules.PAGE_SIZE,
) -> DataFrame:
    """One page of a user's own collection, with base images at 256."""
    own = collection.filter((F.col("user_id") == user_id) & (F.col("collection_id") == collection_id))
    rows = items.join(own.select("collection_id"), "collection_id", "left_semi").join(
        content.select("content_id", "slug", "title", "content_type"), "content_id"
    ).select("content_id", "slug", "title", "content_type")
    return with_base_image(paginate(rows, [F.col("content_id")], page, per_page), representation, 256, 256)


def create_collections(collection: DataFrame, requests: DataFrame) -> DataFrame:
    """Collections after a batch of (user_id, title, is_nsfw, created_at) requests.

    An existing (user, title) is left as it is; empty titles are ignored; of several
    requests for one title the earliest counts.
    """
    asked = requests.filter(F.coalesce("title", F.lit("")) != "").groupBy("user_id", "title").agg(
        first_by([F.col("created_at"), F.col("is_nsfw")], "created_at", "is_nsfw").alias("r")
    )
    missing = asked.join(collection.select("user_id", "title"), ["user_id", "title"], "left_anti")
    numbered = number_rows(
        missing.select("user_id", "title", "r.created_at", "r.is_nsfw"), "_n", ["created_at", "user_id", "title"]
    )
    top = collection.agg(F.coalesce(F.max("collection_id"), F.lit(0)).alias("m")).scalar()
    made = numbered.select(
        (F.col("_n") + top).alias("collection_id"), "user_id", "title", "created_at", "is_nsfw"
    )
    return collection.select(*made.columns).unionByName(made)


def apply_collection_edits(
    collection: DataFrame, items: DataFrame, edits: DataFrame, content: DataFrame
) -> dict[str, DataFrame]:
    """Collections after an edit log (edit_id, collection_id, user_id, content_id, edited_at, action).

    Actions add, remove and toggle_nsfw; the last add or remove of an item decides,
    toggles count by parity, and edits by someone else are ``rejected``. Adding an item
    the catalog lacks does nothing.
    """
    owners = collection.select("collection_id", F.col("user_id").alias("_owner"))
    judged = edits.join(owners, "collection_id", "left")
    own = judged.filter(F.col("_owner") == F.col("user_id"))
    rejected = judged.filter(~F.coalesce(F.col("_owner") == F.col("user_id"), F.lit(False))).select(
        "edit_id", "collection_id", "user_id",
        F.when(F.col("_owner").isNull(), "no such collection").otherwise("not the owner").alias("reason"),
    )
    last = own.filter(F.col("action").isin("add", "remove")).groupBy("collection_id", "content_id").agg(
        F.max_by("action", F.struct("edited_at", "edit_id")).alias("action")
    )
    untouched = items.select("collection_id", "content_id").join(
        last, ["collection_id", "content_id"], "left_anti"
    )
    added = last.filter(F.col("action") == "add").join(
        content.select("content_id"), "content_id", "left_semi"
    ).select("collection_id", "content_id")
    toggles = own.filter(F.col("action") == "toggle_nsfw").groupBy("collection_id").agg(
        (F.count(F.lit(1)) % 2 == 1).alias("_flip")
    )
    flagged = collection.join(toggles, "collection_id", "left").withColumn(
        "is_nsfw", F.col("is_nsfw") != F.coalesce("_flip", F.lit(False))
    ).drop("_flip")
    return {"collection": flagged, "items": untouched.unionByName(added), "rejected": rejected}


def validate_albums(album: DataFrame, creators: DataFrame, tag: DataFrame) -> DataFrame:
    """Violations (album_id, problem, tag_id): categories of set and creator tags."""
    category = tag.select("tag_id", "category")
    sets = album.select("album_id", F.col("set_tag_id").alias("tag_id")).join(category, "tag_id").filter(
        ~F.col("category").isin(*rules.ALBUM_CATEGORIES)
    ).select("album_id", F.lit("set tag").alias("problem"), "tag_id")
    makers = creators.join(category, "tag_id").filter(
        ~F.col("category").isin(*rules.CREATOR_CATEGORIES)
    ).select("album_id", F.lit("creator tag").alias("problem"), "tag_id")
    return sets.unionByName(makers)


def validate_order(items: DataFrame) -> DataFrame:
    """Violations (album_id, problem, value, n): repeated items or positions in an album."""
    def repeated(column: str, problem: str) -> DataFrame:
        return items.groupBy("album_id", column).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
            "album_id", F.lit(problem).alias("problem"), F.col(column).cast("long").alias("value"), "n"
        )

    return repeated("content_id", "content").unionByName(repeated("ord", "position"))
