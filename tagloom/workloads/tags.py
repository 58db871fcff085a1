"""Vocabulary operators over the views."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom import rules
from tagloom.fixtures import Inputs
from tagloom.operators import tags
from tagloom.sources.json_inputs import parse_task_metadata
from tagloom.workloads.registry import query
from tagloom.workloads.scalars import in_list

PREFIXED = in_list(rules.PREFIXED_CATEGORIES)


def closure_cte(edges: str) -> str:
    return f"""closure as (select target, implicate from {edges} union
        select c.target, e.implicate from closure c join {edges} e on e.target = c.implicate)"""


@query("implication_closure", f"with recursive {closure_cte('f_implication')} select target, implicate from closure")
def implication_closure(i: Inputs):
    return tags.implication_closure(i.f_implication)


@query(
    "expand_tags",
    f"""with recursive {closure_cte('f_tag_edge')} select content_id, tag_id from f_content_tag
        union select content_id, implicate from f_content_tag join closure on tag_id = target""",
)
def expand_tags(i: Inputs):
    return tags.expand_content_tags(i.f_content_tag, tags.implication_closure(i.f_tag_edge))


METADATA = """select distinct user_id as content_id, unnest([
      struct_pack(name := 'name_' || cast(event_id % 37 as varchar), category := 'artist'),
      struct_pack(name := 'Some_Tag', category := 'content'), struct_pack(name := 'some tag', category := 'content'),
      struct_pack(name := event_type, category := 'style')]) as t from events where event_id % 50 <> 7"""


@query("metadata_tags", f"select distinct content_id, t.name, t.category from ({METADATA})")
def metadata_tags(i: Inputs):
    tasks = parse_task_metadata(i.f_task_json.select("task_id", "body"), "body").join(
        i.events.select(F.col("event_id").alias("task_id"), F.col("user_id").alias("content_id")), "task_id"
    )
    return tags.tags_from_metadata(tasks.select("content_id", "tags"))


@query(
    "smart_tag_search",
    """with q as (select unnest(['re', 'brand#1', 'red', 'safe']) as term),
        r as (select distinct term, t.tag_id, t.title, t.category, case when t.title = term then 1 when a.title = term then 2
               when contains(a.title, term) then 3 else 4 end as relevance
             from f_tag t left join f_alias a on a.tag_id = t.tag_id join q on contains(t.title, term) or contains(a.title, term))
        select * from r""",
)
def smart_tag_search(i: Inputs):
    return tags.smart_tag_search(i.f_tag, i.f_alias, "re", "BRAND#1", " red_", "safe")


NAMES_SQL = """select p_partkey as seq, case p_partkey % 7 when 0 then p_brand when 1 then upper(p_type) when 2 then 'artist:' || p_name
      when 3 then replace(p_name, ' ', '_') when 4 then p_name when 5 then ' ' || p_type when 6 then p_name end as name,
    case p_partkey % 7 when 0 then 'creator' when 1 then 'content' when 2 then 'content' when 3 then 'species' when 4 then 'prompter'
      when 5 then 'lore' else case when p_size % 2 = 0 then 'content' else 'meta' end end as category from part"""


def asked_names(i: Inputs):
    return i.spark.sql(NAMES_SQL.replace("from part", "from {part}"), part=i.part)


RESOLVE = f"""
    raw as (select *, trim(replace(lower(name), '_', ' ')) as n from ({NAMES_SQL})),
    w as (select name as asked, category as asked_category, min(seq) as seq,
        case when category = 'content' and n like 'artist:%' then substr(n, 8) else n end as n,
        case when category = 'content' and n like 'artist:%' then 'artist' else category end as c
      from raw group by name, category, n),
    k as (select n, c, min(seq) as seq from w group by n, c),
    tries as (select n, c, seq, 0 as pos, case when c in {PREFIXED} then c || ': ' || n else n end as al from k
      union all select n, c, seq, 1, replace(c, '-', '_') || ':' || replace(n, ' ', '_') from k where c in {PREFIXED}),
    ba as (select n, c, arg_min(a.tag_id, pos) as aid from tries join f_alias a on a.title = al group by n, c),
    fnd as (select k.*, aid, coalesce(aid, t2.tag_id) as tag_id, case when aid is not null then 'alias' when t2.tag_id is not null then 'title' else 'new' end as via
      from k left join ba on ba.n = k.n and ba.c = k.c left join f_tag t2 on t2.title = k.n and t2.category = k.c),
    fx as (select fnd.*, t.title as tt, t.category as tc from fnd left join f_tag t on t.tag_id = fnd.tag_id),
    up as (select tag_id, arg_min(c, seq) as nc from fx where via = 'alias' and c not in {PREFIXED} and c <> 'content' and tc = 'content' group by tag_id),
    pn as (select n, arg_min(c, seq) as c1, arg_min(c, seq) filter (where c <> 'content') as c2 from fx
      where via = 'new' and c not in {PREFIXED} group by n),
    pm as (select n, case when c1 = 'content' then coalesce(c2, c1) else c1 end as made from pn),
    st as (select fx.n, fx.c, fx.tag_id, via, coalesce(tt, fx.n) as title,
        case when via = 'new' then case when fx.c in {PREFIXED} then fx.c else made end else coalesce(nc, tc) end as fc
      from fx left join up on up.tag_id = fx.tag_id left join pm on pm.n = fx.n)"""


@query("resolve_tags", f"with {RESOLVE} select asked, asked_category, tag_id, title, fc as category, via from w join st on st.n = w.n and st.c = w.c")
def resolve_tags(i: Inputs):
    return tags.resolve_tags(asked_names(i), i.f_tag, i.f_alias)["resolved"]


NEW_TAGS = f"""{RESOLVE},
    mk as (select distinct title, fc from st where fc in ('artist', 'prompter')),
    cr as (select distinct title from mk),
    cm as (select cr.title, coalesce(a1.tag_id, a2.tag_id, t.tag_id) as tag_id from cr
      left join f_alias a1 on a1.title = 'creator: ' || cr.title left join f_alias a2 on a2.title = 'creator:' || replace(cr.title, ' ', '_')
      left join f_tag t on t.title = cr.title and t.category = 'creator'),
    nt as (select n as title, made as category from pm union select n, c from fx where via = 'new' and c in {PREFIXED}
      union select title, 'creator' from cm where tag_id is null)"""


@query("resolve_new_tags", f"with {NEW_TAGS} select title, category from nt")
def resolve_new_tags(i: Inputs):
    return tags.resolve_tags(asked_names(i), i.f_tag, i.f_alias)["new_tag"]


@query(
    "resolve_new_aliases",
    f"""with {NEW_TAGS}, am as (select title, category, case when category in {PREFIXED} then category || ': ' || title else title end as alias from nt
          union select title, category, case when category in {PREFIXED} then replace(category, '-', '_') || ':' || replace(title, ' ', '_')
            else replace(title, ' ', '_') end from nt)
        select alias, title, category from am where alias not in (select title from f_alias)""",
)
def resolve_new_aliases(i: Inputs):
    return tags.resolve_tags(asked_names(i), i.f_tag, i.f_alias)["new_alias"]


@query("resolve_category_changes", f"with {RESOLVE} select tag_id, nc as category from up")
def resolve_category_changes(i: Inputs):
    return tags.resolve_tags(asked_names(i), i.f_tag, i.f_alias)["category_change"]


@query(
    "resolve_implications",
    f"with {NEW_TAGS} select mk.title, mk.fc as category, cm.tag_id as creator_id from mk join cm on cm.title = mk.title",
)
def resolve_implications(i: Inputs):
    return tags.resolve_tags(asked_names(i), i.f_tag, i.f_alias)["new_implication"]


@query(
    "tag_info",
    """select t.tag_id, t.title, t.category, k.kind, k.other from f_tag t join (
         select tag_id, 'alias' as kind, title as other from f_alias
         union all select e.target, 'implies', o.title from f_tag_edge e join f_tag o on o.tag_id = e.implicate
         union all select e.implicate, 'implied by', o.title from f_tag_edge e join f_tag o on o.tag_id = e.target) k on k.tag_id = t.tag_id""",
)
def tag_info(i: Inputs):
    return tags.tag_info(i.f_tag, i.f_alias, i.f_tag_edge)


@query(
    "valid_alias",
    "select tag_id, min(title) as valid_alias from (select tag_id, title || case when title like 'creator:%' then '' else ' (x)' end as title from f_alias union all select tag_id, title || '!' from f_alias) where not regexp_matches(title, '[(){}\\[\\]!&|]') group by tag_id",
)
def valid_alias(i: Inputs):
    a = i.f_alias
    marked = a.select(
        "tag_id", F.concat("title", F.when(F.startswith("title", F.lit("creator:")), "").otherwise(" (x)")).alias("title")
    ).unionByName(a.select("tag_id", F.concat("title", F.lit("!")).alias("title")))
    return tags.valid_alias(marked)


@query(
    "tag_stats",
    """select t.tag_id, title, category, coalesce(a.n, 0) as aliases, coalesce(c.n, 0) as items from f_tag t
         left join (select tag_id, count(*) as n from f_alias group by tag_id) a on a.tag_id = t.tag_id
         left join (select tag_id, count(*) as n from f_content_tag group by tag_id) c on c.tag_id = t.tag_id""",
)
def tag_stats(i: Inputs):
    return tags.tag_stats(i.f_tag, i.f_alias, i.f_content_tag)


@query(
    "apply_predictions",
    f"""with recursive closure as (select target, implicate from f_tag_edge union
          select c.target, e.implicate from closure c join f_tag_edge e on e.target = c.implicate),
        kept as (select distinct content_id, tag from f_prediction where score >= 0.2),
        new_tag as (select tag, (select max(tag_id) from f_tag) + row_number() over (order by tag) as tag_id
          from (select distinct tag from kept where tag not in (select title from f_alias)
            and tag not in (select title from f_tag where category = 'content'))),
        ids as (select k.tag, coalesce(a.tag_id, t.tag_id, n.tag_id) as tag_id from (select distinct tag from kept) k
          left join f_alias a on a.title = k.tag left join f_tag t on t.title = k.tag and t.category = 'content'
          left join new_tag n on n.tag = k.tag),
        picked as (select content_id, tag_id from kept join ids using (tag)),
        added as (select content_id, tag_id from picked union select content_id, implicate from picked join closure on target = tag_id)
        select content_id, tag_id from f_content_tag union select content_id, tag_id from added""",
)
def apply_predictions(i: Inputs):
    return tags.apply_predictions(i.f_prediction, i.f_content_tag, i.f_tag, i.f_alias, i.f_tag_edge)["content_tag"]


@query(
    "validate_tags",
    """with t as (select tag_id, case when category = 'style' then substr(title, 1, 1) else title end as title, category from f_tag),
         a as (select tag_id, replace(title, ' ', '_') as title from f_alias),
         e as (select target, implicate from f_implication union all select implicate, target from f_implication where target like 'loop%'
           union all select implicate, implicate from f_implication where implicate = 'world')
       select 'tag' as problem, title || ' / ' || category as subject, count(*) as n from t group by title, category having count(*) > 1
       union all select 'alias', title, count(*) from a group by title having count(*) > 1
       union all select 'implication', target || ' / ' || implicate, count(*) from e group by target, implicate having count(*) > 1
       union all select 'self implication', target, 1 from e where target = implicate""",
)
def validate_tags(i: Inputs):
    t = i.f_tag.withColumn(
        "title", F.when(F.col("category") == "style", F.left("title", F.lit(1))).otherwise(F.col("title"))
    )
    a = i.f_alias.withColumn("title", F.translate("title", " ", "_"))
    e = i.f_implication
    swapped = e.filter(F.startswith("target", F.lit("loop"))).select(
        F.col("implicate").alias("target"), F.col("target").alias("implicate")
    )
    selfish = e.filter(F.col("implicate") == "world").select(F.col("implicate").alias("target"), "implicate")
    return tags.validate_tags(t, a, e.unionByName(swapped).unionByName(selfish))


@query(
    "seed_tags",
    f"""with d(n, title, category) as (values {", ".join(f"({n}, '{t}', '{c}')" for n, (t, c, _) in enumerate(rules.DEFAULT_TAGS, 1))}),
        da(n, title) as (values {", ".join(f"({n}, '{a}')" for n, (_, _, x) in enumerate(rules.DEFAULT_TAGS, 1) for a in x)}),
        ids as (select d.*, coalesce(t.tag_id, d.n + (select max(tag_id) from f_tag)) as tag_id from d left join f_tag t using (title, category)),
        al as (select tag_id, title from f_alias union all select ids.tag_id, da.title from da join ids using (n)
               where da.title not in (select title from f_alias))
        select tag_id, title from al""",
)
def seed_tags(i: Inputs):
    return tags.seed_default_tags(i.f_tag, i.f_alias, i.f_tag_edge)["tag_alias"]
