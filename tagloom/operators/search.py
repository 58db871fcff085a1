"""Tag search, presets and catalog filters."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom import rules
from tagloom.functions.common import ColumnOrName, col
from tagloom.plans.hotkeys import split_join
from tagloom.plans.tagexpr import ANYTHING, T, TagExpr, all_of, any_of
from tagloom.session import settle


def named_tags(alias: DataFrame, names: set[str]) -> DataFrame:
    """(title, tag_id) of the given aliases: at most one row per name."""
    wanted = alias.filter(F.col("title").isin(*sorted(names)))
    return wanted.groupBy("title").agg(F.min("tag_id").alias("tag_id"))


def _marked(content_tag: DataFrame, alias: DataFrame, names: list[str]) -> DataFrame:
    """One row per item that carries a named tag, with a flag per name.

    The bridge is read once however many tags are named, and flags combine on the
    map side. The lookup is broadcast: it has at most ``len(names)`` rows.
    """
    named = F.broadcast(named_tags(alias, set(names)))
    flags = [F.bool_or(F.col("title") == n).alias(f"_t{i}") for i, n in enumerate(names)]
    return content_tag.join(named, "tag_id").groupBy("content_id").agg(*flags)


def _known(alias: DataFrame, names: list[str]) -> Column:
    """Do all names belong to a tag? A scalar subquery, so nothing is joined for it."""
    found = named_tags(alias, set(names)).agg(F.count(F.lit(1)).alias("n"))
    return found.scalar() == len(names)


class UnknownTag(ValueError):
    """A search names something that is no alias."""


def require_known(alias: DataFrame, names: list[str]) -> None:
    """Raise unless every name is an alias. Fetches at most ``len(names)`` rows."""
    found = {row.title for row in named_tags(alias, set(names)).select("title").collect()}
    if missing := sorted(set(names) - found):
        raise UnknownTag(f"unknown tag: {', '.join(missing)}")


def tag_search(
    content: DataFrame,
    content_tag: DataFrame,
    alias: DataFrame,
    expr: TagExpr,
    on_unknown: str = "empty",
) -> DataFrame:
    """Rows of ``content`` that satisfy ``expr``.

    A name that is no alias makes the whole search empty, or raises with
    ``on_unknown="error"``.
    """
    names = sorted(expr.names())
    if not names:
        return content
    if on_unknown not in ("empty", "error"):
        raise ValueError("on_unknown is 'empty' or 'error'")
    if on_unknown == "error":
        require_known(alias, names)
    flag = {n: F.coalesce(F.col(f"_t{i}"), F.lit(False)) for i, n in enumerate(names)}
    condition = expr.column(flag.__getitem__)
    marked = _marked(content_tag, alias, names)
    if expr.admits_untagged():
        joined = content.join(marked, "content_id", "left").filter(condition)
        result = joined.select(*[content[c] for c in content.columns])
    else:
        result = content.join(marked.filter(condition).select("content_id"), "content_id", "left_semi")
    return result if on_unknown == "error" else result.filter(_known(alias, names))


def has_tag(content: DataFrame, content_tag: DataFrame, alias: DataFrame, name: str) -> DataFrame:
    """Items carrying the tag whose alias is exactly ``name`` (not normalised)."""
    named = F.broadcast(named_tags(alias, {name}))
    return content.join(content_tag.join(named, "tag_id", "left_semi"), "content_id", "left_semi")


def tags_all(content, content_tag, alias, *names: str, **kw) -> DataFrame:
    return tag_search(content, content_tag, alias, all_of(*map(T, names)), **kw)


def tags_any(content, content_tag, alias, *names: str, **kw) -> DataFrame:
    return tag_search(content, content_tag, alias, any_of(*map(T, names)), **kw)


def tags_not(content, content_tag, alias, *names: str, **kw) -> DataFrame:
    return tag_search(content, content_tag, alias, all_of(*[~T(n) for n in names]), **kw)


# Preset -> what it asks for besides not being hidden; "bypass" shows hidden items too. Callers may add presets.
PRESETS = {
    "bypass": ANYTHING,
    "basic": ANYTHING,
    "safe": T("safe"),
    "aesthetic": T("safe") & ~any_of(*map(T, rules.UNAESTHETIC)),
}
OPEN_PRESETS = set(rules.OPEN_PRESETS)  # those that anybody may choose


def preset_expr(name: str) -> TagExpr:
    return PRESETS.get(name, ANYTHING)


def preset_filter(content: DataFrame, content_tag: DataFrame, alias: DataFrame, name: str) -> DataFrame:
    """Apply a preset; one that names a tag the catalog lacks raises."""
    if name not in PRESETS:
        name = "safe"
    visible = content if name == "bypass" else content.filter(~F.col("is_hidden"))
    return tag_search(visible, content_tag, alias, preset_expr(name), on_unknown="error")


def match_expressions(
    content: DataFrame, content_tag: DataFrame, alias: DataFrame, searches: Mapping[int, TagExpr]
) -> DataFrame:
    """(content_id, search_id) of every search, given as an expression, that an item satisfies.

    All searches are decided in one pass over the bridge: each becomes a Column over
    the flags of one row, so items and searches are never multiplied out. A search
    naming an unknown tag matches nothing.
    """
    names = sorted(set().union(*(e.names() for e in searches.values())))
    if names:
        rows = content.select("content_id").join(_marked(content_tag, alias, names), "content_id", "left")
    else:
        rows = content.select("content_id")
    known = named_tags(alias, set(names)).agg(F.collect_set("title").alias("t")).scalar() if names else None
    flag = {n: F.coalesce(F.col(f"_t{i}"), F.lit(False)) for i, n in enumerate(names)}
    hits = []
    for search_id, expr in searches.items():
        condition = expr.column(flag.__getitem__) if expr.names() else F.lit(True)
        if expr.names():
            condition = condition & (F.size(F.array_except(F.array(*map(F.lit, sorted(expr.names()))), known)) == 0)
        hits.append(F.when(condition, F.lit(search_id).cast("long")))
    return rows.select("content_id", F.explode(F.array_compact(F.array(*hits))).alias("search_id"))


def match_saved_searches(content: DataFrame, content_tag: DataFrame, alias: DataFrame, clauses: DataFrame) -> DataFrame:
    """(content_id, search_id) of every saved search every item satisfies.

    ``clauses`` (search_id, clause_no, alias, negated): a search is the conjunction of its clauses,
    a clause the disjunction of its literals. A search naming an unknown alias matches nothing. However
    many searches there are, aliases are looked up once and the bridge is read once.

    The clauses are an inverted index: the bridge joined with the literals of its tags says which clauses
    an item touches. A clause without negations holds for the items that have one of its tags. One with
    negations holds for all items but those that have all of its negated tags and none of the others;
    so a search that has only such clauses starts with every item and loses those it fails for, and
    any other is decided by the items it touches.
    """
    named = alias.groupBy(F.col("title").alias("alias")).agg(F.min("tag_id").alias("tag_id"))
    looked_up = settle(
        clauses.join(named, "alias", "left").select("search_id", "clause_no", "tag_id", "negated").distinct()
    )
    unknown = looked_up.filter("tag_id is null").select("search_id").distinct()
    literals = looked_up.join(unknown, "search_id", "left_anti")
    clause = literals.groupBy("search_id", "clause_no").agg(F.count_if("negated").alias("n_negated"))
    search = clause.groupBy("search_id").agg(
        F.count(F.lit(1)).alias("n_clauses"), F.count_if(F.col("n_negated") > 0).alias("n_open")
    )
    facts = settle(literals.join(clause, ["search_id", "clause_no"]).join(search, "search_id"))

    # Pairs are dealt by item before literals multiply them; what is grouped below by more columns stays where it is.
    pairs = split_join(content_tag.select("content_id", "tag_id"), facts.select("tag_id").distinct(), "tag_id", ["content_id"], "left_semi")
    touched = split_join(pairs.repartition("content_id"), facts, "tag_id", ["content_id"], write=False)
    each = touched.groupBy("content_id", "search_id", "clause_no").agg(
        F.bool_or(~F.col("negated")).alias("has"), F.count_if("negated").alias("negated"),
        *[F.max(c).alias(c) for c in ("n_negated", "n_clauses", "n_open")],
    )
    # An open clause is held until it fails, any other is not held until one of its tags is met.
    held = F.when(F.col("n_negated") == 0, 1).when(~F.col("has") & (F.col("negated") == F.col("n_negated")), -1).otherwise(0)
    decided = each.groupBy("content_id", "search_id").agg(
        (F.sum(held) + F.max("n_open") == F.max("n_clauses")).alias("hit"),
        (F.max("n_open") == F.max("n_clauses")).alias("open"),
    )
    items = content.select("content_id")
    met = decided.filter("hit and not open").select("content_id", "search_id").join(items, "content_id", "left_semi")
    # Of open searches the result has nearly every item: one row each, from a list of the searches.
    every = search.filter("n_open = n_clauses").agg(F.collect_list("search_id").alias("s")).scalar()
    failed = decided.filter("open and not hit").groupBy("content_id").agg(F.collect_list("search_id").alias("_failed"))
    kept = F.when(F.col("_failed").isNull(), every).otherwise(F.array_except(every, "_failed"))
    open_ = items.join(failed, "content_id", "left").select("content_id", F.explode(kept).alias("search_id"))
    return met.unionByName(open_)


def allowed_filter(preset: ColumnOrName, is_member: ColumnOrName) -> Column:
    """The preset a viewer gets: members any, others the open ones, ``safe`` otherwise."""
    preset, is_member = col(preset), col(is_member)
    allowed = (is_member & preset.isin(*PRESETS)) | preset.isin(*sorted(OPEN_PRESETS))
    return F.when(allowed, preset).otherwise("safe")


def nsfw_visible(is_nsfw: ColumnOrName, is_member: ColumnOrName, show: ColumnOrName) -> Column:
    return ~col(is_nsfw) | (col(is_member) & col(show))


def catalog_filter(
    content: DataFrame,
    content_tag: DataFrame,
    tag: DataFrame,
    content_type: str | None = None,
    is_hidden: bool | None = None,
    date_from=None,
    date_to=None,
    text: str | None = None,
) -> DataFrame:
    """Back-office list filters; ``text`` looks into the item title and its tag titles."""
    rows = content
    if content_type is not None:
        rows = rows.filter(F.col("content_type") == content_type)
    if is_hidden is not None:
        rows = rows.filter(F.col("is_hidden") == is_hidden)
    if date_from is not None:
        rows = rows.filter(F.col("addition_date") >= F.lit(date_from))
    if date_to is not None:
        rows = rows.filter(F.col("addition_date") < F.lit(date_to))
    if text:
        needle = F.lower(F.lit(text))
        hit_tags = tag.filter(F.lower("title").contains(needle)).select("tag_id")
        by_tag = (
            content_tag.join(hit_tags, "tag_id", "left_semi")
            .groupBy("content_id").agg(F.lit(True).alias("_by_tag"))
        )
        rows = (
            rows.join(by_tag, "content_id", "left")
            .filter(F.lower("title").contains(needle) | F.col("_by_tag"))
            .select(*content.columns)
        )
    return rows


def tag_list_filter(tag: DataFrame, category: str | None = None) -> DataFrame:
    rows = tag if category is None else tag.filter(F.col("category") == category)
    return rows.orderBy("category", "title", "tag_id")


def access_check(requests: DataFrame, content_tag: DataFrame, tag: DataFrame) -> DataFrame:
    """Add ``status``: members may open anything, others only items tagged ``safe``."""
    safe = tag.filter(F.col("title") == "safe").select("tag_id")
    open_items = (
        content_tag.join(safe, "tag_id", "left_semi")
        .groupBy("content_id").agg(F.lit(True).alias("_open"))
    )
    allowed = F.col("is_member") | F.coalesce(F.col("_open"), F.lit(False))
    return (
        requests.join(open_items, "content_id", "left")
        .withColumn("status", F.when(allowed, "allowed").otherwise("denied"))
        .drop("_open")
    )
