"""Tag search, presets and catalog filters over the views."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom import rules
from tagloom.fixtures import Inputs
from tagloom.operators import search
from tagloom.operators.tags import seed_default_tags
from tagloom.plans.tagexpr import T, all_of, any_of
from tagloom.workloads.registry import query
from tagloom.workloads.scalars import in_list

ITEM = "content_id, title, content_type"


def having(*names: str) -> str:
    """Select of the items carrying any of the aliases."""
    return f"select ct.content_id from f_content_tag ct join f_alias a on a.tag_id = ct.tag_id where a.title in {in_list(names)}"


def carry(*names: str) -> str:
    """Aggregate: whether an item carries any of the aliases."""
    return f"bool_or(a.title in {in_list(names)})"


def carrying(condition: str) -> str:
    """Select of the tagged items that meet a condition on what they carry, by one pass over the bridge."""
    return f"select ct.content_id from f_content_tag ct join f_alias a on a.tag_id = ct.tag_id group by ct.content_id having {condition}"


def parts(i: Inputs):
    return i.f_content.select("content_id", "title", "content_type", "is_hidden"), i.f_content_tag, i.f_alias


def item(df):
    return df.select("content_id", "title", "content_type")


@query("tag_term", f"select {ITEM} from f_content where content_id in ({having('cold')})")
def tag_term(i):
    return item(search.has_tag(*parts(i), "cold"))


@query("tag_and", f"select {ITEM} from f_content where content_id in ({carrying(carry('safe') + ' and ' + carry('red'))})")
def tag_and(i):
    return item(search.tags_all(*parts(i), "safe", "red"))


@query("tag_or", f"select {ITEM} from f_content where content_id in ({having('cold', 'creator:brand#7')})")
def tag_or(i):
    return item(search.tags_any(*parts(i), "cold", "creator:brand#7"))


@query("tag_not", f"select {ITEM} from f_content where content_id not in ({having('cold')}) and content_id not in ({having('safe')})")
def tag_not(i):
    return item(search.tags_not(*parts(i), "cold", "safe"))


@query(
    "tag_expr",
    f"""select {ITEM} from f_content where content_id in ({carrying(f"""{carry('safe')} and not ({carry('cold')} and {carry('economy')})
          and ({carry('red', 'blue')} or not {carry('standard')})""")})""",
)
def tag_expr(i):
    expr = T("safe") & ~all_of(T("cold"), T("economy")) & (any_of(T("red"), T("blue")) | ~T("standard")) & any_of()
    return item(search.tag_search(*parts(i), expr))


@query(
    "tag_unknown",
    f"""select 'known' as asked, {ITEM} from f_content where content_id in ({having('safe', 'red')})
        union all select 'not an unknown one', {ITEM} from f_content where content_id in ({having('safe', 'red')}) and 1 = 0""",
)
def tag_unknown(i):
    """One name that is no tag empties a search, also where it is one of several or is not wanted."""
    known = T("safe") | T("red")
    searches = {"known": known, "or an unknown one": known | T("no such tag"), "not an unknown one": known & ~T("no such tag")}
    found = [item(search.tag_search(*parts(i), e)).select(F.lit(n).alias("asked"), "content_id", "title", "content_type") for n, e in searches.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("preset_basic", f"select {ITEM} from f_content where not is_hidden")
def preset_basic(i):
    return item(search.preset_filter(*parts(i), "basic"))


@query("preset_safe", f"select {ITEM} from f_content where not is_hidden and content_id in ({having('safe')})")
def preset_safe(i):
    return item(search.preset_filter(*parts(i), "safe"))


@query(
    "preset_aesthetic",
    # Each excluded tag is put on a twelfth of the items.
    f"""select {ITEM} from f_content where not is_hidden and content_id % 12 >= 6
        and content_id in ({carrying(carry('safe') + ' and not ' + carry(*rules.UNAESTHETIC))})""",
)
def preset_aesthetic(i):
    seeded = seed_default_tags(i.f_tag, i.f_alias, i.f_tag_edge)
    content, content_tag, _ = parts(i)
    place = F.array_position(F.array(*map(F.lit, rules.UNAESTHETIC)), F.col("title")) - 1
    marks = seeded["tag_alias"].filter(F.col("title").isin(*rules.UNAESTHETIC)).select("tag_id", place.alias("_at"))
    marked = content.select("content_id", (F.col("content_id") % 12).alias("_at")).join(marks, "_at").select("content_id", "tag_id")
    content_tag = content_tag.select("content_id", "tag_id").unionByName(marked)
    return item(search.preset_filter(content, content_tag, seeded["tag_alias"], "aesthetic"))


@query(
    "saved_searches",
    f"""select content_id, 1::bigint as search_id from f_content where content_id in ({having('safe')}) and content_id not in ({having('cold')})
        union all select content_id, 2 from f_content where content_id in ({having('red', 'blue')})
        union all select content_id, 3 from f_content where content_id not in ({having('economy', 'standard')})""",
)
def saved_searches(i):
    searches = {
        1: T("safe") & ~T("cold"),
        2: any_of(T("red"), T("blue")),
        3: ~any_of(T("economy"), T("standard")),
        4: T("red") & T("no such tag"),
    }
    return search.match_expressions(*parts(i), searches)


# A search per nation: one of two types, and not a third; some name no tag, some only say what is not wanted.
CLAUSES = """
    with p as (select cast(n_nationkey as bigint) as search_id, n_nationkey % 12 = 5 as open, n_nationkey % 10 = 3 as odd,
        lower(a.p_type) as a, lower(b.p_type) as b, replace(lower(c.p_type), ' ', '_') as c
      from nation join part a on a.p_partkey = n_nationkey + 1 join part b on b.p_partkey = n_nationkey * 2 + 1 join part c on c.p_partkey = n_nationkey + 2)
    select search_id, 1 as clause_no, a as alias, open as negated from p
    union all select search_id, 1, case when odd then 'no such tag' else b end, false from p where not open
    union all select search_id, 2, c, true from p
    union all select search_id, 2, 'safe', search_id % 2 = 0 from p"""


@query(
    "saved_search_table",
    f"""with l as materialized (select l.*, tag_id from ({CLAUSES}) l left join f_alias on title = alias),
          known as (select search_id from l group by search_id having count(*) = count(tag_id)),
          c as (select content_id, search_id, clause_no, bool_or((ct.tag_id is not null) <> negated) as met
            from f_content cross join (select * from l where search_id in (select search_id from known)) l
            left join f_content_tag ct using (content_id, tag_id) group by all)
        select content_id, search_id from c group by all having bool_and(met)""",
)
def saved_search_table(i):
    clauses = i.spark.sql(CLAUSES.replace("nation join", "{nation} join").replace("join part", "join {part}"), nation=i.nation, part=i.part)
    content, content_tag, alias = parts(i)
    return search.match_saved_searches(content, content_tag, alias, clauses)


WISH = "case event_id % 5 when 0 then 'bypass' when 1 then 'basic' when 2 then 'safe' when 3 then 'aesthetic' else 'bogus' end"


@query(
    "filter_policy",
    f"""with r as (select event_id, {WISH} as wish, user_id % 2 = 0 as is_member from events)
        select event_id, case when wish in ('safe', 'aesthetic') or (is_member and wish in ('bypass', 'basic')) then wish
          else 'safe' end as preset from r""",
)
def filter_policy(i):
    wishes = F.array(*[F.lit(p) for p in (*rules.PRESETS, "bogus")])
    wish = F.get(wishes, (F.col("event_id") % 5).cast("int"))
    return i.events.select("event_id", search.allowed_filter(wish, F.col("user_id") % 2 == 0).alias("preset"))


@query(
    "catalog_filter",
    f"""select {ITEM} from f_content where content_type = 'image' and not is_hidden
          and addition_date >= timestamp '1996-01-01' and addition_date < timestamp '1999-01-01'
          and (lower(title) like '%urgent%' or content_id in (select content_id from f_content_tag
               where tag_id in (select tag_id from f_tag where title like '%red%')))""",
)
def catalog_filter(i):
    return item(
        search.catalog_filter(
            i.f_content, i.f_content_tag, i.f_tag, "image", False,
            "1996-01-01 00:00:00", "1999-01-01 00:00:00", "uRgEnT",
        ).unionByName(
            search.catalog_filter(
                i.f_content, i.f_content_tag, i.f_tag, "image", False,
                "1996-01-01 00:00:00", "1999-01-01 00:00:00", "red",
            )
        ).distinct()
    )


@query("tag_list", "select tag_id, title, category from f_tag where category = 'style'")
def tag_list(i):
    return search.tag_list_filter(i.f_tag, "style")


@query(
    "access_check",
    f"""select event_id, content_id, case when event_id % 4 = 0 or content_id in ({having('safe')}) then 'allowed' else 'denied' end as status
        from (select event_id, event_id // 2 as content_id from events)""",
)
def access_check(i):
    requests = i.events.select(
        "event_id", F.floor(F.col("event_id") / 2).alias("content_id"), (F.col("event_id") % 4 == 0).alias("is_member")
    )
    return search.access_check(requests, i.f_content_tag, i.f_tag).drop("is_member")
