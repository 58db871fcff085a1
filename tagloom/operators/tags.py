"""Tag vocabulary: resolution, aliases, implications, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom import rules
from tagloom.functions import tags as fn
from tagloom.functions.common import any_true
from tagloom.plans.hotkeys import split_join
from tagloom.plans.literals import literal_rows
from tagloom.plans.positions import first_by, number_rows
from tagloom.session import settle


def smart_tag_search(tag: DataFrame, alias: DataFrame, *terms: str, best_only: bool = False) -> DataFrame:
    """(term, tag_id, title, category, relevance) of tags a typed term may mean.

    Relevance: 1 the title, 2 an alias, 3 part of an alias, 4 part of the title. A tag
    is listed once per relevance it reaches through its aliases. Each row is tested
    against the given terms in place; terms and tags are not joined.
    """
    wanted = F.transform(
        F.array(*[F.lit(t) for t in terms]), lambda t: fn.prepare_tag_name(t)
    )
    names = alias.select("tag_id", F.col("title").alias("alias"))
    rows = tag.join(names, "tag_id", "left")
    alias_text = F.coalesce("alias", F.lit(""))
    hits = F.filter(wanted, lambda t: F.contains(F.col("title"), t) | F.contains(alias_text, t))
    rows = rows.select("tag_id", "title", "category", "alias", F.explode(hits).alias("term"))
    relevance = (
        F.when(F.col("title") == F.col("term"), 1).when(F.col("alias") == F.col("term"), 2)
        .when(F.contains(F.col("alias"), F.col("term")), 3).otherwise(4)
    )
    keys = ["term", "tag_id", "title", "category"]
    ranked = rows.select(*keys, relevance.alias("relevance"))
    if best_only:
        found = ranked.groupBy(*keys).agg(F.min("relevance").alias("relevance"))
    else:
        found = ranked.distinct()
    return found.orderBy("term", "relevance", "title", "tag_id")


def implication_closure(edges: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """(target, implicate) for every tag reachable over one or more edges.

    Walks are doubled: a round adds to the pairs known so far, which are those of 1 to 2^k edges,
    the pairs that walks of exactly 2^k edges lead on to. So there are as many rounds as the longest
    chain has binary digits; each is settled, so a lost executor costs one round. A tag on a cycle
    reaches itself. ``starts`` (target) limits the work to tags in use.
    """
    walk = settle(edges.select("target", "implicate").distinct())
    known = walk
    if starts is not None:
        known = settle(walk.join(starts.select("target").distinct(), "target", "left_semi"))
    while True:  # ends: pairs are finite, and a round that adds none is the last
        step = walk.select(F.col("target").alias("implicate"), F.col("implicate").alias("next"))
        on = lambda pairs: pairs.join(step, "implicate").select("target", F.col("next").alias("implicate")).distinct()
        new = settle(on(known).join(known, ["target", "implicate"], "left_anti"))
        if new.isEmpty():
            return known
        known = known.unionByName(new)
        walk = settle(on(walk))


def expand_content_tags(content_tag: DataFrame, closure: DataFrame) -> DataFrame:
    """Add to every item the tags its tags imply, also where most items have one tag."""
    implies = closure.select(F.col("target").alias("tag_id"), "implicate")
    # Tags that imply others imply themselves here, so the pairs are read once and need no union with what they imply.
    itself = implies.select("tag_id").distinct().select("tag_id", F.col("tag_id").alias("implicate"))
    met = split_join(
        content_tag.select("content_id", "tag_id"), implies.unionByName(itself).withColumn("_met", F.lit(True)), "tag_id",
        ["content_id"], "left",
    )
    return met.select("content_id", F.when(F.col("_met"), F.col("implicate")).otherwise(F.col("tag_id")).alias("tag_id")).distinct()


def tags_from_metadata(tasks: DataFrame) -> DataFrame:
    """(content_id, name, category) from the category -> names map ``tags``."""
    lists = tasks.select("content_id", F.explode("tags").alias("category", "names"))
    category = F.when(F.col("category").isin(*rules.CATEGORIES), F.col("category")).otherwise("content")
    return lists.select(
        "content_id", F.explode("names").alias("name"), category.alias("category")
    ).distinct()


def _wanted(names: DataFrame) -> DataFrame:
    """Distinct (name, category) with the first ``seq`` they are asked at, ready to look up."""
    bare = names.select(
        F.col("name").alias("asked"), F.col("category").alias("asked_category"), "seq",
        fn.prepare_tag_name("name").alias("n"),
    )
    is_content = F.col("asked_category") == "content"
    rows = bare.select(
        "asked", "asked_category", "seq",
        F.when(is_content & F.startswith("n", F.lit("prompter:")), F.expr("substr(n, 10)"))
        .when(is_content & F.startswith("n", F.lit("artist:")), F.expr("substr(n, 8)"))
        .otherwise(F.col("n")).alias("name"),
        F.when(is_content & F.startswith("n", F.lit("prompter:")), "prompter")
        .when(is_content & F.startswith("n", F.lit("artist:")), "artist")
        .otherwise(F.col("asked_category")).alias("category"),
    )
    return rows.groupBy("asked", "asked_category", "name", "category").agg(F.min("seq").alias("seq"))


def _match(wanted: DataFrame, tag: DataFrame, alias: DataFrame) -> DataFrame:
    """Add tag_id, tag_title, tag_category by alias, else by (title, category)."""
    keys = wanted.groupBy("name", "category").agg(F.min("seq").alias("seq"))
    looked_up = F.when(fn.is_prefixed("category"), fn.generate_aliases("name", "category")).otherwise(
        F.array("name")
    )
    tries = keys.select("name", "category", F.posexplode(looked_up).alias("at", "alias"))
    named = alias.select(F.col("title").alias("alias"), "tag_id")
    by_alias = tries.join(named, "alias").groupBy("name", "category").agg(
        F.min_by("tag_id", "at").alias("alias_tag_id")
    )
    by_title = tag.select(
        F.col("title").alias("name"), "category", F.col("tag_id").alias("title_tag_id")
    )
    found = keys.join(by_alias, ["name", "category"], "left").join(by_title, ["name", "category"], "left")
    found = found.withColumn("tag_id", F.coalesce("alias_tag_id", "title_tag_id"))
    facts = tag.select("tag_id", F.col("title").alias("tag_title"), F.col("category").alias("tag_category"))
    return found.join(facts, "tag_id", "left").withColumn(
        "via", F.when(F.col("alias_tag_id").isNotNull(), "alias")
        .when(F.col("title_tag_id").isNotNull(), "title").otherwise("new"),
    )


def resolve_tags(names: DataFrame, tag: DataFrame, alias: DataFrame) -> dict[str, DataFrame]:
    """Find or create the tags of a batch of (name, category, seq).

    All distinct names are looked up against the vocabulary as it stands; what is not
    there is created in one pass, the lowest ``seq`` deciding where names compete.

    - ``resolved``: asked, asked_category, tag_id (null if new), title, category, via
    - ``new_tag``: title, category
    - ``new_alias``: alias, title, category
    - ``category_change``: tag_id, category
    - ``new_implication``: title, category -> creator of the same title
    """
    wanted = _wanted(names)
    found = settle(_match(wanted, tag, alias))
    plain = ~fn.is_prefixed("category")

    # A content tag named under another category moves there; the first one asked wins.
    upgrades = found.filter(
        plain & (F.col("via") == "alias") & (F.col("category") != "content")
        & (F.col("tag_category") == "content")
    ).groupBy("tag_id").agg(F.min_by("category", "seq").alias("new_category"))

    # New plain names share their alias, so one tag per name; prefixed ones per category.
    fresh = found.filter(F.col("via") == "new")
    first_other = F.min_by(
        F.when(F.col("category") != "content", F.col("category")),
        F.when(F.col("category") != "content", F.col("seq")),
    )
    plain_new = fresh.filter(plain).groupBy(F.col("name").alias("title")).agg(
        F.min_by("category", "seq").alias("_first"), first_other.alias("_other")
    ).select(
        "title",
        F.when(F.col("_first") == "content", F.coalesce("_other", "_first"))
        .otherwise(F.col("_first")).alias("category"),
    )
    prefixed_new = fresh.filter(~plain).select(F.col("name").alias("title"), "category").distinct()
    made = plain_new.select(F.col("title").alias("name"), F.col("category").alias("_made"))

    settled = (
        found.join(upgrades, "tag_id", "left")
        .join(made, "name", "left")
        .select(
            "name", "category", "tag_id", "via",
            F.coalesce("tag_title", "name").alias("title"),
            F.when(F.col("via") == "new", F.when(plain, F.col("_made")).otherwise(F.col("category")))
            .otherwise(F.coalesce("new_category", "tag_category")).alias("final_category"),
        )
    )
    resolved = wanted.join(settled, ["name", "category"]).select(
        "asked", "asked_category", "tag_id", "title", F.col("final_category").alias("category"), "via"
    )

    # Artists and prompters also are creators of the same title.
    makers = settled.filter(F.col("final_category").isin("artist", "prompter")).select(
        "title", F.col("final_category").alias("category")
    ).distinct()
    creators = makers.select(
        F.col("title").alias("name"), F.lit("creator").alias("category"), F.lit(0).cast("long").alias("seq")
    ).distinct()
    creator_found = _match(creators, tag, alias)
    creator_new = creator_found.filter(F.col("via") == "new").select(F.col("name").alias("title"), "category")
    new_tag = plain_new.unionByName(prefixed_new).unionByName(creator_new).distinct()
    new_alias = new_tag_aliases(new_tag, alias)
    links = makers.join(
        creator_found.select(F.col("name").alias("title"), F.col("tag_id").alias("creator_id")), "title", "left"
    )
    return {
        "resolved": resolved,
        "new_tag": new_tag,
        "new_alias": new_alias,
        "category_change": upgrades.withColumnRenamed("new_category", "category"),
        "new_implication": links.select("title", "category", "creator_id"),
    }


def new_tag_aliases(new_tag: DataFrame, alias: DataFrame) -> DataFrame:
    """(alias, title, category) for new tags, less aliases that are taken already."""
    made = new_tag.select(
        "title", "category", F.explode(fn.generate_aliases("title", "category")).alias("alias")
    )
    # An alias belongs to one tag: two new tags with the same one, the first by name keeps it.
    owned = made.groupBy("alias").agg(first_by([F.col("category"), F.col("title")], "title", "category").alias("t"))
    taken = alias.select(F.col("title").alias("alias"))
    return owned.join(taken, "alias", "left_anti").select("alias", "t.title", "t.category")


def apply_resolution(
    result: dict[str, DataFrame], tag: DataFrame, alias: DataFrame, implication: DataFrame
) -> dict[str, DataFrame]:
    """The vocabulary after a resolution: new rows get the ids after the highest one.

    ``tag_rows``, ``alias_rows`` and ``implication_rows`` are those that are new or changed.
    """
    numbered = number_rows(result["new_tag"], "_n", ["category", "title"])
    top = tag.agg(F.coalesce(F.max("tag_id"), F.lit(0)).alias("m")).scalar()
    created = numbered.select((F.col("_n") + top).alias("tag_id"), "title", "category")
    created = settle(created)
    change = result["category_change"].withColumnRenamed("category", "_category")
    tags_now = tag.join(change, "tag_id", "left").select(
        "tag_id", "title", F.coalesce("_category", "category").alias("category")
    ).unionByName(created)
    changed = tag.join(change, "tag_id").select("tag_id", "title", F.col("_category").alias("category"))
    new_alias = result["new_alias"].join(created, ["title", "category"]).select("tag_id", F.col("alias").alias("title"))
    aliases_now = alias.select("tag_id", "title").unionByName(new_alias)
    makers = tags_now.select(F.col("tag_id").alias("target"), "title", "category")
    creators = created.filter(F.col("category") == "creator").select("title", F.col("tag_id").alias("_new"))
    links = result["new_implication"].join(makers, ["title", "category"]).join(creators, "title", "left").select(
        "target", F.coalesce("creator_id", "_new").alias("implicate")
    )
    new_edge = links.distinct().join(implication.select("target", "implicate"), ["target", "implicate"], "left_anti")
    edges_now = implication.select("target", "implicate").unionByName(new_edge)
    return {
        "tag": tags_now, "tag_alias": aliases_now, "tag_implication": edges_now,
        "tag_rows": created.unionByName(changed), "alias_rows": new_alias, "implication_rows": new_edge,
    }


def tag_ids(resolved: DataFrame, tag: DataFrame) -> DataFrame:
    """(asked, asked_category, tag_id) once the new tags are part of ``tag``."""
    made = tag.select("title", "category", F.col("tag_id").alias("_new"))
    return resolved.join(made, ["title", "category"], "left").select(
        "asked", "asked_category", F.coalesce("tag_id", "_new").alias("tag_id")
    )


def tag_info(tag: DataFrame, alias: DataFrame, edges: DataFrame) -> DataFrame:
    """(tag_id, title, category, kind, other): aliases, implied and implying tags as rows."""
    facts = tag.select("tag_id", "title", "category")
    title = tag.select(F.col("tag_id").alias("_other"), F.col("title").alias("other"))
    implied = edges.select(F.col("target").alias("tag_id"), F.col("implicate").alias("_other"), F.lit("implies").alias("kind"))
    implying = edges.select(F.col("implicate").alias("tag_id"), F.col("target").alias("_other"), F.lit("implied by").alias("kind"))
    linked = implied.unionByName(implying).join(title, "_other").select("tag_id", "kind", "other")
    named = alias.select("tag_id", F.lit("alias").alias("kind"), F.col("title").alias("other"))
    return facts.join(named.unionByName(linked), "tag_id")


def valid_alias(alias: DataFrame) -> DataFrame:
    """(tag_id, valid_alias): the first alias that can be typed in a search."""
    reserved = any_true([F.contains("title", F.lit(c)) for c in rules.RESERVED_ALIAS_CHARACTERS])
    return alias.filter(~reserved).groupBy("tag_id").agg(F.min("title").alias("valid_alias"))


def tag_stats(tag: DataFrame, alias: DataFrame, content_tag: DataFrame) -> DataFrame:
    """Aliases and items per tag, zero included."""
    aliases = alias.groupBy("tag_id").agg(F.count(F.lit(1)).alias("aliases"))
    items = content_tag.groupBy("tag_id").agg(F.count(F.lit(1)).alias("items"))
    return tag.join(aliases, "tag_id", "left").join(items, "tag_id", "left").select(
        "tag_id", "title", "category", F.coalesce("aliases", F.lit(0)).cast("long").alias("aliases"),
        F.coalesce("items", F.lit(0)).cast("long").alias("items"),
    )


def attach_tags(
    wanted: DataFrame, content_tag: DataFrame, tag: DataFrame, alias: DataFrame, implication: DataFrame
) -> dict[str, DataFrame]:
    """Give items the tags named for them, and what these imply.

    ``wanted``: content_id, name, category, seq (any type that can be ordered; the lowest
    decides where names compete). Returns the vocabulary after resolution, its new rows
    (see :func:`apply_resolution`) and ``added``: the (content_id, tag_id) that
    ``content_tag`` lacks. Only the bridge rows of the items named are looked at.
    """
    now, found = _found_tags(wanted, tag, alias, implication)
    added = found.join(content_tag.select("content_id", "tag_id"), ["content_id", "tag_id"], "left_anti")
    return now | {"added": added}


def _found_tags(
    wanted: DataFrame, tag: DataFrame, alias: DataFrame, implication: DataFrame
) -> tuple[dict[str, DataFrame], DataFrame]:
    """The vocabulary after resolution, and the distinct (content_id, tag_id) wanted and implied."""
    # As many rows as names; settled, as the lookups below read them several times.
    asked = settle(wanted.groupBy("name", "category").agg(F.min("seq").alias("seq")))
    result = resolve_tags(asked, tag, alias)
    now = apply_resolution(result, tag, alias, implication)
    ids = settle(tag_ids(result["resolved"], now["tag"]))
    named = ids.select(F.col("asked").alias("name"), F.col("asked_category").alias("category"), "tag_id")
    picked = wanted.join(named, ["name", "category"]).select("content_id", "tag_id")
    closure = implication_closure(now["tag_implication"], ids.select(F.col("tag_id").alias("target")).distinct())
    return now, expand_content_tags(picked, closure)


def apply_predictions(
    predictions: DataFrame, content_tag: DataFrame, tag: DataFrame, alias: DataFrame,
    implication: DataFrame, threshold: float = 0.2,
) -> dict[str, DataFrame]:
    """Attach predicted tags at or above the threshold, with what they imply.

    Returns the vocabulary after resolution, ``added`` (see :func:`attach_tags`) and the new ``content_tag``.
    """
    kept = predictions.filter(F.col("score") >= threshold).select(
        "content_id", F.col("tag").alias("name"), F.lit("content").alias("category"), F.col("content_id").alias("seq")
    )
    now, found = _found_tags(kept, tag, alias, implication)
    bridge, on = content_tag.select("content_id", "tag_id"), ["content_id", "tag_id"]
    # Found pairs are distinct, so a full join keeps each bridge row once and adds what it lacks.
    return now | {"added": found.join(bridge, on, "left_anti"), "content_tag": bridge.join(found, on, "full")}


def validate_tags(tag: DataFrame, alias: DataFrame, edges: DataFrame) -> DataFrame:
    """Violations (problem, subject, n) of the rules of the vocabulary."""
    def repeated(df: DataFrame, problem: str, *columns: str) -> DataFrame:
        counts = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        subject = F.concat_ws(" / ", *[F.col(c).cast("string") for c in columns])
        return counts.select(F.lit(problem).alias("problem"), subject.alias("subject"), "n")

    loops = edges.filter(F.col("target") == F.col("implicate")).select(
        F.lit("self implication").alias("problem"), F.col("target").cast("string").alias("subject"),
        F.lit(1).cast("long").alias("n"),
    )
    return (
        repeated(tag, "tag", "title", "category")
        .unionByName(repeated(alias, "alias", "title"))
        .unionByName(repeated(edges, "implication", "target", "implicate"))
        .unionByName(loops)
    )


def seed_default_tags(tag: DataFrame, alias: DataFrame, implication: DataFrame) -> dict[str, DataFrame]:
    """The vocabulary with the built-in tags, their aliases and implication present."""
    spark = tag.sparkSession
    rows = [(n, title, category) for n, (title, category, _) in enumerate(rules.DEFAULT_TAGS, 1)]
    builtin = literal_rows(spark, ["n", "title", "category"], rows)
    present = tag.join(F.broadcast(builtin), ["title", "category"]).groupBy("n").agg(F.min("tag_id").alias("tag_id"))
    top = tag.agg(F.coalesce(F.max("tag_id"), F.lit(0)).alias("m")).scalar()
    ids = builtin.join(present, "n", "left").select(
        "n", "title", "category", F.coalesce("tag_id", F.col("n") + top).alias("tag_id"),
        F.col("tag_id").isNull().alias("_new"),
    )
    tags_now = tag.select("tag_id", "title", "category").unionByName(
        ids.filter("_new").select("tag_id", "title", "category")
    )
    alias_rows = [(n, a) for n, (_, _, names) in enumerate(rules.DEFAULT_TAGS, 1) for a in names]
    wanted = literal_rows(spark, ["n", "title"], alias_rows)
    missing = wanted.join(alias.select("title"), "title", "left_anti").join(ids.select("n", "tag_id"), "n")
    aliases_now = alias.select("tag_id", "title").unionByName(missing.select("tag_id", "title"))
    ends = [
        F.max(F.when((F.col("title") == title) & (F.col("category") == category), F.col("tag_id"))).alias(side)
        for side, (title, category) in zip(("target", "implicate"), rules.DEFAULT_IMPLICATION)
    ]
    edge = ids.agg(*ends).filter("target is not null and implicate is not null")
    edges_now = implication.select("target", "implicate").unionByName(edge).distinct()
    return {"tag": tags_now, "tag_alias": aliases_now, "tag_implication": edges_now}
