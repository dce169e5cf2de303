"""Equivalent SQL for those of the queries p7 to p10 that SQL can express over whole tables."""

ORACLE = {
    "p7_found": """
        select id, idx from (
          select id, idx, row_number() over (partition by id order by updated_at desc nulls last, deleted_at desc nulls last, idx) as nr
          from (select distinct id, idx, updated_at, deleted_at from test_newest_by_group)) where nr <= 3""",
    "p9_found": r"""
        with i as (select distinct item_id, regexp_replace(lower(item_text), '[^\p{L}\p{Nd}]', '', 'g') as t from eval_items),
             g as (select distinct item_id, t[p:p + 59] as g from i, lateral (select unnest(range(1, length(t) - 58)) as p)),
             d as (select doc_id, regexp_replace(lower(text), '[^\p{L}\p{Nd}]', '', 'g') as t from documents),
             w as (select doc_id, t[p:p + 59] as g from d, lateral (select unnest(range(1, length(t) - 58)) as p))
        select distinct doc_id, item_id from w join g using (g)""",
}
ORACLE["p7_split"] = ORACLE["p7_found"]
ORACLE["p8_invariants"] = """
        select c as capacity, count(distinct doc_id) as posts, cast(0 as bigint) as incomplete, cast(0 as bigint) as split, cast(0 as bigint) as overfull, true as tight
        from documents, unnest([1024, 4096]) t(c) group by c"""
ORACLE["p9_cleaned"] = r"""
        with i as (select distinct item_id, regexp_replace(lower(item_text), '[^\p{L}\p{Nd}]', '', 'g') as t from eval_items),
             g as (select distinct t[p:p + 59] as g, item_id from i, lateral (select unnest(range(1, length(t) - 58)) as p)),
             d as (select doc_id, text, regexp_replace(lower(text), '[^\p{L}\p{Nd}]', '', 'g') as t from documents),
             w as (select doc_id, p, t[p:p + 59] as g from d, lateral (select unnest(range(1, length(t) - 58)) as p)),
             h as (select distinct doc_id, p from w join g using (g)),
             bad as (select distinct doc_id, unnest(range(p, p + 60)) as k from h),
             c as (select doc_id, n, text[n] as c, regexp_matches(lower(text[n]), '[\p{L}\p{Nd}]') as l from d semi join h using (doc_id), lateral (select unnest(range(1, length(text) + 1)) as n)),
             s as (select *, sum(case when l then length(regexp_replace(lower(c), '[^\p{L}\p{Nd}]', '', 'g')) else 0 end) over (partition by doc_id order by n) as k from c),
             m as (select s.doc_id, n, c, x.k is not null and (l or y.k is not null) as gone from s left join bad x on x.doc_id = s.doc_id and x.k = s.k left join bad y on y.doc_id = s.doc_id and y.k = s.k + 1)
        select doc_id, coalesce(string_agg(c, '' order by n) filter (not gone), '') as cleaned, count(*) filter (gone) as removed from m group by doc_id"""
