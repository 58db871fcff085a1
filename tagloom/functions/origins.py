"""Addresses of items on the sites they come from."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagloom import rules
from tagloom.functions.common import ColumnOrName, col, first_match, lookup


# Site -> (prefix of file names, address with {} for the id). Callers may add sites of this form.
SITES = dict(rules.SIMPLE_SITES)


def _site_prefixes() -> dict[str, str]:
    return {name: prefix for name, (prefix, _) in SITES.items()} | rules.COMPOSITE_SITES


def _pattern_id(url: Column, pattern: str, groups: int) -> Column:
    """``user#post[#photo]`` from the groups of a pattern, null where it is not found."""
    parts = [F.regexp_extract(url, pattern, n) for n in range(1, groups + 1)]
    found = F.concat_ws("#", *[F.nullif(p, F.lit("")) for p in parts])
    return F.nullif(found, F.lit(""))


def parse_origin_url(site: ColumnOrName, url: ColumnOrName) -> Column:
    """Id of the item on its site, null where the address is not one of the site's."""
    site, url = col(site), col(url)
    bare = F.split_part(url, F.lit("?"), F.lit(1))
    steps = []
    for name, (_, template) in SITES.items():
        base = template.split("{}")[0]
        if name == "twibooru":
            rest = F.substr(bare, F.lit(len(base) + 1))
            value = F.when(rest.rlike(r"^\d+$"), rest)
        else:
            value = F.element_at(F.split(bare, "/"), -1)
        steps.append(((site == name), F.when(url.startswith(base), value)))
    steps.append((site == "twitter", _pattern_id(url, rules.TWITTER_PATTERN, 3)))
    steps.append(
        (site.isin("deviantart", "deviant-art"), _pattern_id(bare, rules.DEVIANTART_PATTERN, 2))
    )
    steps.append((site == "telegram", _pattern_id(bare, rules.TELEGRAM_PATTERN, 2)))
    return first_match(steps)


def normalise_origin_id(site: ColumnOrName, value: ColumnOrName) -> Column:
    """An id as given, or the id in an https address of a known site; '' if it has none."""
    site, value = col(site), col(value)
    is_address = value.startswith("https://") & site.isin(*_site_prefixes())
    return F.when(is_address, F.coalesce(parse_origin_url(site, value), F.lit(""))).otherwise(value)


def origin_url(site: ColumnOrName, origin_id: ColumnOrName) -> Column:
    """Address of an item; '' for an unknown site, null for an id the site cannot have."""
    site, origin_id = col(site), col(origin_id)
    parts = F.split(origin_id, "#")
    count = F.size(parts)
    first, second, third = (F.get(parts, F.lit(i)) for i in range(3))
    steps = [
        (site == name, F.concat(F.lit(before), origin_id, F.lit(after)))
        for name, (_, template) in SITES.items()
        for before, after in [template.split("{}")]
    ]
    post = F.concat(F.lit("https://x.com/"), first, F.lit("/status/"), second)
    steps.append(
        (
            site == "twitter",
            F.when(count == 3, F.concat(post, F.lit("/photo/"), third)).when(count == 2, post),
        )
    )
    steps.append(
        (
            site.isin("deviantart", "deviant-art"),
            F.when(count == 2, F.concat(F.lit("https://www.deviantart.com/"), first, F.lit("/art/"), second)),
        )
    )
    steps.append(
        (site == "telegram", F.when(count == 2, F.concat_ws("/", F.lit("https://t.me"), first, second)))
    )
    return F.when(origin_id.isNull(), "").otherwise(first_match(steps, F.lit("")))


def site_prefix(site: ColumnOrName) -> Column:
    return lookup(col(site), _site_prefixes())


def file_safe_id(origin_id: ColumnOrName) -> Column:
    return F.translate(col(origin_id), "#", "_")
