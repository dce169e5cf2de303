"""Equivalent SQL for those of the queries p1 to p6 that SQL can express over whole tables."""

ORACLE = {
    "p1_found": """
        with f as (select id, i, f from (select distinct id, attributes.friends as fs from test_mapper where attributes.friends is not null),
                   unnest(range(len(fs))) t(i), lateral (select fs[i + 1] as f)),
             c as (select id, i, j, cs[j + 1] as c from (select id, i, f.contacts as cs from f where f.contacts is not null), unnest(range(len(cs))) t(j))
        select 'status_records' as parent_table, rec_nr as parent_id, 'a' as child_name, -1 as pos, -1 as sub_pos from (select distinct rec_nr from status_records where a is not null)
        union all select 'status_records', rec_nr, 'b', -1, -1 from (select distinct rec_nr from status_records where b is not null)
        union all select 'status_records', rec_nr, 'c', -1, -1 from (select distinct rec_nr from status_records where c is not null)
        union all select 'test_mapper', id, 'friends', cast(i as integer), -1 from f where f is not null
        union all select 'test_mapper', id, 'contacts', cast(i as integer), cast(j as integer) from c where c is not null""",
    "p1_contacts": """
        with f as (select id, fs[i + 1] as f, i from (select distinct id, attributes.friends as fs from test_mapper), unnest(range(len(fs))) t(i)),
             c as (select f.contacts[j + 1] as c from f, unnest(range(len(f.contacts))) t(j))
        select c.kind as kind, c.value as value, count(*) as occurrences from c where c is not null group by c.kind, c.value""",
    "p1_friends": """
        with f as (select id, i, fs[i + 1] as x from (select distinct id, attributes.friends as fs from test_mapper where attributes.friends is not null), unnest(range(len(fs))) t(i))
        select id as parent_id, cast(i as integer) as pos, x.id as friend_id, x.first_name as first_name, x.last_name as last_name, x.contacts is not null as has_contacts
        from f where x is not null""",
    "p2_alternatives": """
        with recursive r as (select feed_nr, file_nr, try_cast(payload as json) as j from raw_records),
             n as (select feed_nr, file_nr, 'attributes' as path, j->'attributes' as v from r where json_type(j) = 'OBJECT' and json_type(j->'attributes') in ('OBJECT', 'ARRAY')
                   union all
                   select feed_nr, file_nr, case when json_type(v) = 'ARRAY' then path || '[]' else path || '.' || k end,
                     case when json_type(v) = 'ARRAY' then json_extract(v, '$[' || k || ']') else json_extract(v, '$."' || k || '"') end
                   from (select feed_nr, file_nr, path, v, unnest(case when json_type(v) = 'ARRAY' then list_transform(range(cast(json_array_length(v) as bigint)), lambda x: cast(x as varchar)) else json_keys(v) end) as k
                         from n where json_type(v) in ('OBJECT', 'ARRAY'))),
             t as (select feed_nr, file_nr, path, case json_type(v) when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'OBJECT' then 'object' when 'ARRAY' then 'array'
                     when 'NULL' then null else 'number' end as json_type from n where path <> 'attributes' and path not like '%[]')
        select cast(feed_nr as bigint) as feed_nr, path as field_path, json_type, cast(min(file_nr) as bigint) as file_nr from t where json_type is not null group by feed_nr, path, json_type""",
    "p3_found": r"""
        with m as (select dt, row_nr, email, gender, latitude, version,
                     case when regexp_full_match(latitude, '-?[0-9]+(\.[0-9]+)?') then cast(latitude as double) end as lat from mock_data),
             r as (select dt, 'email' as column_name, 'pattern' as finding, row_nr from m where not regexp_full_match(email, '[A-Za-z0-9._+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')
                   union all select dt, 'gender', 'pattern', row_nr from m where gender not in ('F', 'M')
                   union all select dt, 'latitude', 'pattern', row_nr from m where latitude is not null and lat is null
                   union all select dt, 'latitude', 'range', row_nr from m where lat not between -90 and 90
                   union all select dt, 'version', 'range', row_nr from m where version not between 1 and 99),
             u as (select dt, n, count(*) filter (v is null) as nulls, name from (
                     select dt, count(*) over (partition by dt, name) as n, name, v from (
                       select dt, unnest(['email', 'gender', 'latitude', 'version']) as name, unnest([email, gender, latitude, cast(version as varchar)]) as v from m)) group by dt, n, name),
             q as (select dt, name, n, nulls, lag(n) over w as n0, lag(nulls) over w as nulls0 from u window w as (partition by name order by dt)),
             s as (select dt, 'gender' as name, cast(case gender when 'F' then 1 else 2 end as double) as v from m where gender in ('F', 'M')
                   union all select dt, 'latitude', lat from m where lat between -90 and 90
                   union all select dt, 'version', cast(version as double) from m where version between 1 and 99),
             l as (select dt, lead(dt) over (order by dt) as nxt from (select distinct dt from m)),
             d as (select name, dt as pair, v, 1 as cur, 0 as old from s union all select name, nxt, v, 0, 1 from s join l using (dt) where nxt is not null),
             e as (select name, pair, v, sum(cur) as cur, sum(old) as old from d group by all),
             g as (select name, pair, sum(cur) over w as cc, sum(old) over w as co, sum(cur) over (partition by name, pair) as n, sum(old) over (partition by name, pair) as n0
                   from e window w as (partition by name, pair order by v))
        select dt, column_name, finding, row_nr from r
        union all select dt, name, 'null_rate', 0 from q where abs(nulls * n0 - nulls0 * n) * 5 > n * n0
        union all select distinct pair, name, 'distribution', 0 from g where n > 0 and n0 > 0 and abs(cc * n0 - co * n) * 4 > n * n0""",
    "p3_aggregates": """
        with v as (select dt, unnest(['email', 'gender', 'latitude', 'version']) as column_name, unnest([email, gender, latitude, cast(version as varchar)]) as value from mock_data)
        select dt, column_name, count(*) as n_rows, count(*) - count(value) as n_null, count(distinct value) as n_distinct, min(value) as lowest, max(value) as highest
        from v group by dt, column_name""",
    "p4_found": """
        with s as (select id, updated_at_sec, dt, case
                     when updated_at_sec >= 978307200 and updated_at_sec < 4133980800 then updated_at_sec
                     when updated_at_sec >= 978307200000 and updated_at_sec < 4133980800000 then updated_at_sec // 1000
                     when updated_at_sec >= 978307200000000 and updated_at_sec < 4133980800000000 then updated_at_sec // 1000000
                     when updated_at_sec >= 978307200000000000 and updated_at_sec < 4133980800000000000 then updated_at_sec // 1000000000 end as t from mock_data),
             g as (select distinct dt, coalesce(try_cast(first_value as bigint), epoch(try_cast(first_value as timestamp))) as lo,
                     coalesce(try_cast(last_value as bigint), epoch(try_cast(last_value as timestamp))) as hi
                   from load_log where partition_column = 'updated_at_sec' and run_state = 'succeeded'),
             x as (select id, updated_at_sec, exists (select 1 from g where g.dt >= s.dt and s.t between g.lo and g.hi) as seen from s where t is not null)
        select id, updated_at_sec from x group by id, updated_at_sec having not bool_or(seen)""",
    "p4_runs": "select row_nr, dt, id from mock_data",
    "p5_found": r"""
        with c as (select distinct rec_nr, trim(b.itms, ' ') as t from status_records where b.itms is not null),
             d as (select rec_nr, case when length(t) >= 2 and (t[1] || t[-1]) in ('[]', '{}', '()') then t[2:-2] else t end as t from c where t <> ''),
             e as (select rec_nr, regexp_extract_all(t || chr(1), '(?s) *("(?:[^"\\]|""|\\"|\\)*"|''(?:[^''\\]|''''|\\''|\\)*''|[\p{L}\p{M}\p{N}_. -]*) *[^\p{L}\p{M}\p{N}_. -]', 1) as l from d),
             f as (select rec_nr, trim(unnest(l), ' ') as x, unnest(range(len(l))) as pos from e)
        select rec_nr, cast(pos as integer) as pos, y as item_text from (select rec_nr, pos, case
            when length(x) >= 2 and x[1] = '"' and x[-1] = '"' then replace(replace(x[2:-2], '""', '"'), chr(92) || '"', '"')
            when length(x) >= 2 and x[1] = chr(39) and x[-1] = chr(39) then replace(replace(x[2:-2], chr(39) || chr(39), chr(39)), chr(92) || chr(39), chr(39))
            else x end as y from f) where y <> ''""",
    "p5_inferred": """
        with r as (select distinct rec_nr from status_records)
        select rec_nr, 0 as pos, cast(rec_nr as varchar) as item_text from r
        union all select rec_nr, 1, case when rec_nr % 6 = 0 then 'Pump & Valve #9 (old)' else 'net' end from r
        union all select rec_nr, 2, 'x' || (rec_nr % 7) from r""",
    "p6_found": r"""
        with raw as (
               select 'status_records' as table_name, rec_nr as row_key, 'a.ts' as field_name, trim(a.ts, ' ') as x, tz_name as tz, day_order as o from (select distinct rec_nr, src, a from status_records) left join source_zones using (src)
               union all select 'status_records', rec_nr, 'b.ts', trim(b.ts, ' '), tz_name, day_order from (select distinct rec_nr, src, b from status_records) left join source_zones using (src)
               union all select 'mock_data', row_nr, 'updated_at_sec', cast(updated_at_sec as varchar), null, null from mock_data
               union all select 'mock_data', row_nr, 'updated_at_ms', cast(updated_at_ms as varchar), null, null from mock_data),
             num as (select *, try_cast(split_part(x, '.', 1) as hugeint) as i, rpad(split_part(x, '.', 2), 6, '0')[:6] as fr from raw where regexp_full_match(x, '[0-9]{1,19}(\.[0-9]*)?')),
             unit as (select *, case when i >= 978307200 and i < 4133980800 then 's' when i >= 978307200000 and i < 4133980800000 then 'ms'
                        when i >= 978307200000000 and i < 4133980800000000 then 'us' when i >= 978307200000000000 and i < 4133980800000000000 then 'ns' end as u from num),
             n as (select table_name, row_key, field_name, cast(case u when 's' then i * 1000000 + cast(fr as integer) when 'ms' then i * 1000 + cast(fr[:3] as integer) when 'us' then i when 'ns' then i // 1000 end as bigint) as us
                   from unit where u is not null and (table_name = 'status_records' or u <> case field_name when 'updated_at_sec' then 's' else 'ms' end)),
             parts as (select *, string_split(case
                 when regexp_matches(x, '^\d{4}-') then regexp_replace(x, '^(\d{4})-(\d\d)-(\d\d)[T ](\d\d):(\d\d):(\d\d)(?:\.(\d+))? ?()(.*)$', '\1|\2|\3|\4|\5|\6|\7|\8|\9')
                 when regexp_matches(x, '^\d{8}T') then regexp_replace(x, '^(\d{4})(\d\d)(\d\d)T(\d\d)(\d\d)(\d\d)()()(.*)$', '\1|\2|\3|\4|\5|\6|\7|\8|\9')
                 when regexp_matches(x, '^[A-Z][a-z]{2}, ') then regexp_replace(x, '^[A-Za-z]+, (\d\d) ([A-Za-z]+) (\d{4}) (\d\d):(\d\d):(\d\d)()() ?(.*)$', '\3|\2|\1|\4|\5|\6|\7|\8|\9')
                 when regexp_matches(x, '^[A-Z][a-z]{2} ') then regexp_replace(x, '^([A-Za-z]+) (\d+), (\d{4}) (\d+):(\d\d):(\d\d)() ([AP])M()$', '\3|\1|\2|\4|\5|\6|\7|\8|\9')
                 when regexp_matches(x, '^\d\d\.\d\d\.\d{4} ') then regexp_replace(x, '^(\d\d)\.(\d\d)\.(\d{4}) (\d\d):(\d\d)()()()()$', '\3|\2|\1|\4|\5|00|||')
                 when regexp_matches(x, '^\d\d/\d\d/\d{4} ') and o = 'mdy' then regexp_replace(x, '^(\d\d)/(\d\d)/(\d{4}) (\d\d):(\d\d):(\d\d)()()()$', '\3|\1|\2|\4|\5|\6|||')
                 when regexp_matches(x, '^\d\d/\d\d/\d{4} ') then regexp_replace(x, '^(\d\d)/(\d\d)/(\d{4}) (\d\d):(\d\d):(\d\d)()()()$', '\3|\2|\1|\4|\5|\6|||') end, '|') as p from raw where not regexp_full_match(x, '[0-9]{1,19}(\.[0-9]*)?')),
             f as (select table_name, row_key, field_name, tz, p[9] as z, rpad(p[7], 6, '0')[:6] as fr, try_cast(p[1] || '-' || lpad(coalesce(nullif(cast(list_position(['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec'], lower(p[2])) as varchar), '0'), p[2]), 2, '0')
                     || '-' || lpad(p[3], 2, '0') || ' ' || lpad(case p[8] when 'P' then cast(cast(p[4] as integer) % 12 + 12 as varchar) when 'A' then cast(cast(p[4] as integer) % 12 as varchar) else p[4] end, 2, '0') || ':' || p[5] || ':' || p[6] as timestamp) as t
                   from parts where len(p) = 9),
             g as (select *, case when z = 'Z' or z = 'UTC' or z = 'GMT' then 0 when z in ('CET') then 60 when z = 'CEST' then 120 when z = 'EST' then -300 when z = 'EDT' then -240 when z = 'CST' then -360 when z = 'CDT' then -300
                     when regexp_full_match(z, '[+-]\d\d(:?\d\d)?') then (case z[1] when '-' then -1 else 1 end) * (cast(z[2:3] as integer) * 60 + coalesce(try_cast(right(replace(z, ':', ''), 2) as integer) * (case when length(z) > 3 then 1 else 0 end), 0)) end as off,
                     case when z = '' then tz else z end as name from f where t is not null),
             h as (select *, case when off is null then timezone(name, t) end as later from g),
             k as (select table_name, row_key, field_name, case when off is not null then epoch_us(t) - off * 60000000::bigint when timezone(name, later - interval 1 hour) = t then epoch_us(later) - 3600000000 else epoch_us(later) end + cast(fr as integer) as us from h)
        select table_name, row_key, field_name, us as epoch_us from n union all select table_name, row_key, field_name, cast(us as bigint) from k""",
    "p2_found": r"""
        with recursive r as (select feed_nr, file_nr, row_number() over () as rec, try_cast(payload as json) as j from (select distinct feed_nr, file_nr, payload from raw_records)),
             n as (select feed_nr, file_nr, rec, 'attributes' as path, cast([] as bigint[]) as ix, j->'attributes' as v from r where json_type(j) = 'OBJECT' and json_type(j->'attributes') in ('OBJECT', 'ARRAY')
                   union all
                   select feed_nr, file_nr, rec, case when json_type(v) = 'ARRAY' then path || '[]' else path || '.' || k end,
                     case when json_type(v) = 'ARRAY' then list_append(ix, cast(k as bigint)) else ix end,
                     case when json_type(v) = 'ARRAY' then json_extract(v, '$[' || k || ']') else json_extract(v, '$."' || k || '"') end
                   from (select *, unnest(case when json_type(v) = 'ARRAY' then list_transform(range(cast(json_array_length(v) as bigint)), lambda x: cast(x as varchar)) else json_keys(v) end) as k
                         from n where json_type(v) in ('OBJECT', 'ARRAY'))),
             keys as (select * from n where path <> 'attributes' and path not like '%[]'),
             t as (select feed_nr, file_nr, path, list_sort(list_distinct(list(case json_type(v) when 'VARCHAR' then 's' when 'BOOLEAN' then 'b' when 'OBJECT' then 'o' when 'ARRAY' then 'a' when 'NULL' then null else 'n' end))) as kinds
                   from keys group by all),
             f as (select feed_nr, file_nr, lag(file_nr) over (partition by feed_nr order by file_nr) as prev from (select distinct feed_nr, file_nr from raw_records)),
             p as (select f.feed_nr, f.file_nr, f.prev, c.path, c.kinds from f join t c using (feed_nr, file_nr) where prev is not null),
             o as (select f.feed_nr, f.file_nr, f.prev, c.path, c.kinds from f join t c on c.feed_nr = f.feed_nr and c.file_nr = f.prev),
             added as (select *, regexp_replace(path, '\.[^.]*$', '') as parent from p anti join o using (feed_nr, file_nr, path)),
             ceased as (select *, regexp_replace(path, '\.[^.]*$', '') as parent from o anti join p using (feed_nr, file_nr, path)),
             sizes as (select feed_nr, file_nr, rec, path, count(*) as k from n where path like '%[]' group by all),
             cells as (select c.feed_nr, c.file_nr, c.path, r.j->'id' as id, list({'ix': c.ix, 'v': cast(c.v as varchar)} order by c.ix) as cell, coalesce(any_value(z.k), -1) as k
                       from keys c join r using (rec) left join sizes z on z.rec = c.rec and z.path = case when contains(c.path, '[]') then regexp_extract(c.path, '^.*\[\]') end
                       where json_type(c.v) <> 'NULL' group by c.feed_nr, c.file_nr, c.rec, c.path, r.j->'id'),
             renamed as (select a.feed_nr, a.file_nr, a.path as field_path, e.path as old_path from added a join ceased e using (feed_nr, file_nr, parent)
                         join cells x on x.feed_nr = a.feed_nr and x.file_nr = a.file_nr and x.path = a.path
                         join cells y on y.feed_nr = e.feed_nr and y.file_nr = e.prev and y.path = e.path and cast(y.id as varchar) = cast(x.id as varchar)
                         group by all having bool_and(x.cell = y.cell and x.k = y.k))
        select feed_nr, file_nr, 'renamed' as change_kind, field_path, old_path from renamed
        union all select feed_nr, file_nr, 'added', path, '' from added anti join renamed on renamed.feed_nr = added.feed_nr and renamed.file_nr = added.file_nr and renamed.field_path = added.path
        union all select feed_nr, file_nr, 'removed', path, '' from ceased anti join renamed on renamed.feed_nr = ceased.feed_nr and renamed.file_nr = ceased.file_nr and renamed.old_path = ceased.path
        union all select feed_nr, file_nr, 'type_changed', path, '' from p join o using (feed_nr, file_nr, path) where p.kinds <> o.kinds and len(p.kinds) > 0 and len(o.kinds) > 0""",
}
ORACLE["p6_later"] = ORACLE["p6_found"].replace("select table_name, row_key, field_name, us as epoch_us from n union all select table_name, row_key, field_name, cast(us as bigint) from k", """select row_key, cast(us as bigint) as epoch_us
            from (select table_name, row_key, field_name, us from n union all select table_name, row_key, field_name, us from k) where field_name = 'b.ts'""")
ORACLE["p4_intervals"] = """
        with s as (select case
                     when updated_at_sec >= 978307200 and updated_at_sec < 4133980800 then updated_at_sec
                     when updated_at_sec >= 978307200000 and updated_at_sec < 4133980800000 then updated_at_sec // 1000
                     when updated_at_sec >= 978307200000000 and updated_at_sec < 4133980800000000 then updated_at_sec // 1000000
                     when updated_at_sec >= 978307200000000000 and updated_at_sec < 4133980800000000000 then updated_at_sec // 1000000000 end as t from mock_data),
             r as (select coalesce(try_cast(first_value as bigint), cast(epoch(try_cast(first_value as timestamp)) as bigint)) as lo,
                     coalesce(try_cast(last_value as bigint), cast(epoch(try_cast(last_value as timestamp)) as bigint)) as hi
                   from load_log where partition_column = 'updated_at_sec' and run_state = 'succeeded'
                   union all select min(t), max(t) from s),
             g as (select * from r where lo <= hi),
             n as (select *, case when lo <= max(hi) over (order by lo, hi rows between unbounded preceding and 1 preceding) + 1 then 0 else 1 end as fresh from g),
             p as (select *, sum(fresh) over (order by lo, hi) as part from n)
        select min(lo) as lo, max(hi) as hi, cast(0 as bigint) as due_again from p group by part"""
ORACLE["p2_cells"] = """
        with recursive r as (select feed_nr, file_nr, line_nr, row_number() over () as rec, try_cast(payload as json) as j from raw_records),
             n as (select rec, 'o' as kind, j->'attributes' as v from r where json_type(j) = 'OBJECT' and json_type(j->'attributes') in ('OBJECT', 'ARRAY')
                   union all
                   select rec, case when json_type(v) = 'ARRAY' then 'e' else 'k' end, case when json_type(v) = 'ARRAY' then json_extract(v, '$[' || k || ']') else json_extract(v, '$."' || k || '"') end
                   from (select rec, v, unnest(case when json_type(v) = 'ARRAY' then list_transform(range(cast(json_array_length(v) as bigint)), lambda x: cast(x as varchar)) else json_keys(v) end) as k
                         from n where json_type(v) in ('OBJECT', 'ARRAY')))
        select feed_nr, file_nr, line_nr, cast(count(*) filter (kind = 'k' and json_type(v) <> 'NULL') as bigint) as n_cells from r left join n using (rec) where json_type(j) = 'OBJECT' group by feed_nr, file_nr, line_nr"""
ORACLE["p5_delimiters"] = r"""
        with c as (select src, trim(b.itms, ' ') as t from status_records where b.itms is not null),
             d as (select src, case when length(t) >= 2 and (t[1] || t[-1]) in ('[]', '{}', '()') then t[2:-2] else t end as t from c),
             e as (select src, list_distinct(regexp_extract_all(t || chr(1), '(?s) *(?:"(?:[^"\\]|""|\\"|\\)*"|''(?:[^''\\]|''''|\\''|\\)*''|[\p{L}\p{M}\p{N}_. -]*) *([^\p{L}\p{M}\p{N}_. -])', 1)) as m,
                     regexp_replace(regexp_replace(regexp_replace(t, '(?s)"(?:[^"\\]|""|\\"|\\)*"|''(?:[^''\\]|''''|\\''|\\)*''', 'q', 'g'), '\p{N}[\p{N}_.]*', '9', 'g'), '[\p{L}\p{M}]+', 'w', 'g') as k from d),
             f as (select src, k, unnest(list_filter(m, lambda x: x <> chr(1))) as delimiter, len(m) - 1 as n from e),
             g as (select src, delimiter, n, string_split(k, delimiter) as ps from f),
             h as (select src, delimiter, case when n <= 1 then 1.0::double else 0.0::double end as sole, cast(len(ps) as double) as size, len(list_filter(ps, lambda x: regexp_full_match(trim(x, ' '), '|q|9|w|w-9|w(?: +(?:w|9))*'))) as good from g),
             s as (select src, delimiter, count(*) as cells, avg(sole) * sqrt(avg(size) * avg(size) / avg(size * size)) as consistency, avg(good / size) as regularity from h group by src, delimiter)
        select src, delimiter, cells, round(consistency, 8) as consistency, round(regularity, 8) as regularity, round(consistency * regularity, 8) as score, consistency * regularity >= 0.25 as chosen from s"""
ORACLE["p3_ranges"] = r"""
        with l as (select dt, first(latitude order by cast(latitude as double), latitude) as lo, last(latitude order by cast(latitude as double), latitude) as hi
                   from mock_data where regexp_full_match(latitude, '-?[0-9]+(\.[0-9]+)?') group by dt)
        select dt, 'email' as column_name, min(email) as lowest, max(email) as highest from mock_data group by dt
        union all select dt, 'gender', min(gender), max(gender) from mock_data group by dt
        union all select dt, 'version', cast(min(version) as varchar), cast(max(version) as varchar) from mock_data group by dt
        union all select d.dt, 'latitude', lo, hi from (select distinct dt from mock_data) d left join l using (dt)"""
