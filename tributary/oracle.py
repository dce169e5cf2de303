"""Equivalent SQL for the queries of ``tributary.queries``."""

NUMBERS = (
    "case o_orderkey % 5 when 0 then '  ' || o_orderkey || ' ' when 1 then o_orderkey || '_000' "
    "when 2 then o_orderkey || '.56' when 3 then 'n/a' else o_orderkey || ',5' end"
)
DIGITS = "replace(trim(x), '_', '')"
FLAGS = (
    "case o_orderkey % 9 when 0 then ' On ' when 1 then 'DISABLED' when 2 then '1.0' when 3 then 'maybe' when 4 then 'y' "
    "when 5 then ' false ' when 6 then 'enabled' when 7 then '0' end"
)
PARTS = "cast(o_orderkey as bigint) as key, cast(o_custkey as varchar) as customer, cast(trunc(o_totalprice) as integer) as price"
STATUS = "case lower(o_orderstatus) when 'f' then 'filled' else o_orderstatus end"


def _number(kind: str, whole: bool) -> str:
    value = f"round(try_cast({DIGITS} as double))" if whole else f"try_cast({DIGITS} as double)"
    return f"select o_orderkey, try_cast({value} as {kind}) as value from (select o_orderkey, {NUMBERS} as x from orders)"


ORACLE = {
    "to_num_int": _number("integer", True),
    "to_num_long": _number("bigint", True),
    "to_num_double": _number("double", False),
    "to_num_float": _number("float", False),
    "to_num_smallint": _number("smallint", True),
    "to_bool": f"""select o_orderkey, case when lower(trim(x)) in ('on', 'enabled') then true when lower(trim(x)) in ('off', 'disabled') then false
        when lower(trim(x)) in ('t', 'true', 'y', 'yes', '1') then true when lower(trim(x)) in ('f', 'false', 'n', 'no', '0') then false end as flag
        from (select o_orderkey, {FLAGS} as x from orders)""",
    "to_bool_words": "select o_orderkey, case o_orderstatus when 'F' then true when 'O' then false end as flag from orders",
    "to_timestamp": """select o_orderkey, case o_orderkey % 4 when 0 then date_trunc('second', o_orderdate) when 1 then date_trunc('millisecond', o_orderdate) + interval 7 milliseconds
        when 2 then timestamp '2020-08-12 12:43:14' end as at from orders""",
    "to_timestamp_fmt_out": "select o_orderkey, strftime(o_orderdate, '%Y/%m/%d %H:%M') as day from orders",
    "to_timestamp_fmt_in": "select o_orderkey, case when o_orderkey % 3 <> 0 then date_trunc('day', o_orderdate) end::timestamp as at from orders",
    "str_to_array_int": "select p_partkey, [p_size, cast(p_partkey + 1 as integer), null] as items from part",
    "str_to_array_sep": r"select o_orderkey, regexp_split_to_array(o_orderpriority, '\s*-\s*') as items from orders",
    "map_values_equals": "select o_orderkey, case lower(o_orderstatus) when 'f' then 'filled' when 'o' then 'open' else o_orderstatus end as status from orders",
    "map_values_like": "select p_partkey, case when lower(p_name) like '%ring%' then 'ring' when lower(p_name) like 'small%' then p_brand else 'other' end as kind from part",
    "map_values_regex": "select p_partkey, case when regexp_matches(p_name, '(?i)^s.*g$') then 1 when p_name like '%a%' then 2 else 0 end as kind from part",
    "meters_to_cm": "select p_partkey, try_cast(round(p_retailprice * 100) as integer) as cm from part",
    "has_value": "select p_partkey, p_partkey % 4 in (1, 2) as filled from part",
    "as_is_coalesce": "select o_orderkey, coalesce(nullif(o_orderstatus, 'P'), o_orderpriority) as status from orders",
    "to_str": "select o_orderkey, cast(o_custkey as varchar) as customer, case when o_custkey % 2 = 0 then 'true' else 'false' end as even from orders",
    "apply_lower": "select o_orderkey, lower(o_orderpriority) as priority from orders",
    "to_json_string": "select event_id, cast(to_json({'u': user_id, 't': event_type, 'n': nullif(event_type, 'click')}) as varchar) as json from events",
    "mapper_replace": f"select {PARTS}, {STATUS} as o_orderstatus, cast(o_orderdate as date) as day from orders",
    "mapper_append": f"""select o_orderkey, o_custkey, {STATUS} as o_orderstatus, o_totalprice, o_orderpriority, '2020-01-01' as o_orderdate, {PARTS},
        date '2020-01-01' as day from orders""",
    "mapper_prepend": f"select {PARTS}, o_orderkey, o_custkey, {STATUS} as o_orderstatus, o_totalprice, o_orderpriority from orders",
    "mapper_nullify": "select o_orderkey as key, cast(null as integer) as gone, false as flag from orders",
    "mapper_skip": "select o_orderkey as key, o_orderstatus as status from orders",
    "mapper_validate": "select o_orderkey as key, o_orderstatus as status, o_totalprice as price from orders",
    "mapper_nested": "select id, attributes.first_name as first, list_transform(attributes.friends, lambda f: f.id) as friends, try_cast(location.latitude as double) as lat from test_mapper",
    "mapper_comments": "select * from (values ('key', 'the order'), ('status', 'its state')) t(column_name, comment)",
    "sieve": "select l_orderkey, l_linenumber, l_quantity, l_returnflag from lineitem where l_quantity > 30 and l_returnflag in ('A', 'R')",
    "no_id_dropper": "select row_nr, email, gender from mock_data where email is not null or gender is not null",
    "enum_allow_struct": """select c_custkey, case when c_mktsegment in ('BUILDING', 'MACHINERY') then c_mktsegment else 'OTHER' end as c_mktsegment,
        case when c_mktsegment not in ('BUILDING', 'MACHINERY') then c_mktsegment end as was from customer""",
    "enum_disallow_map": """select o_orderkey, case when o_orderpriority in ('1-URGENT', '5-LOW') then o_orderstatus else o_orderpriority end as o_orderpriority,
        case when o_orderpriority in ('1-URGENT', '5-LOW') then o_orderpriority end as was,
        case when o_orderpriority in ('1-URGENT', '5-LOW') then 1 end as n_changed from orders""",
    "threshold_map": """select l_orderkey, l_partkey, l_suppkey, l_linenumber, case when l_quantity between 5 and 45 then l_quantity else -1 end as l_quantity,
        case when l_discount between 0.02::double and 0.08::double then l_discount end as l_discount, l_extendedprice,
        case when l_quantity not between 5 and 45 then cast(l_quantity as varchar) end as was_l_quantity,
        case when l_discount not between 0.02::double and 0.08::double then cast(l_discount as varchar) end as was_l_discount from lineitem""",
    "threshold_date_dynamic": """select l_orderkey, l_linenumber, l_extendedprice, case when l_shipdate between f and timestamp '1998-01-01' then l_shipdate else f end as l_shipdate
        from (select *, l_shipdate - interval 1 day * (l_orderkey % 2) + interval 1 day as f from lineitem)""",
    "null_clean_map": "select o_orderkey, coalesce(nullif(o_orderstatus, 'P'), 'none') as x, case when o_orderstatus = 'P' then 'null' end as was from orders",
    "clean_sequential": """select o_orderkey, s as o_orderstatus, case when o_orderpriority = '5-LOW' then s else o_orderpriority end as o_orderpriority
        from (select *, case when o_orderstatus in ('F', 'O') then o_orderstatus else 'X' end as s from orders)""",
    "explode": "select p_partkey, unnest(string_split(p_type, ' ')) as word from part",
    "explode_outer": """select p_partkey, unnest(string_split(p_type, ' ')) as word from part where p_partkey % 3 <> 0
        union all select p_partkey, null from part where p_partkey % 3 = 0""",
    "explode_nested": "select id, f.id as friend_id, g as gender from (select id, unnest(attributes.friends) as f, attributes.gender as g from test_mapper)",
    "newest_by_group": """select o_custkey, o_orderkey, o_totalprice from (
        select *, row_number() over (partition by o_custkey order by o_orderdate desc nulls last, o_orderkey) as nr from orders) where nr = 1""",
    "newest_by_pair": """select id, secondary_id, idx, attr_1, attr_2, updated_at, deleted_at from (select *, row_number() over (
        partition by id, secondary_id order by updated_at desc nulls last, deleted_at desc nulls last, idx) as nr from test_newest_by_group) where nr = 1""",
    "jdbc_full": "select event_type, count(*) as n from events group by event_type",
    "incremental_bounds": """with h as (select max(event_id) // 2 as h from events)
        select 20200101 as dt, cast(min(event_id) as varchar) as first_value, cast(max(event_id) as varchar) as last_value from events, h where event_id <= h
        union all select 20200102, cast(min(event_id) as varchar), cast(max(event_id) as varchar) from events, h where event_id > h""",
    "partition_roundtrip": """select 1 as dt, n_regionkey, count(*) as n from nation group by n_regionkey
        union all select 2, n_regionkey, count(*) from nation where n_regionkey = 1 group by n_regionkey""",
    "json_roundtrip": "select id, attributes.last_name as last_name, cast(coalesce(len(attributes.friends), 0) as integer) as n_friends from test_mapper",
    "parquet_roundtrip": "select r_regionkey, r_name, 20200101 as dt from region",
    "stream_clean": """select event_id, case when event_type in ('click', 'purchase') then event_type else 'other' end as event_type,
        cast(round(value) as integer) as amount from events where event_type <> 'view'""",
    "flagship_pipeline": """select customer, "order", case when price between 1000 and 300000 then price else 0 end as price, status,
        coalesce(price not between 1000 and 300000, true) as replaced from (
          select o_custkey as customer, o_orderkey as "order", case when o_orderkey % 11 <> 0 then cast(cast(o_totalprice as decimal(12, 2)) as double) end as price,
            case o_orderstatus when 'F' then 'filled' else 'open' end as status,
            row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as nr from orders where o_orderstatus in ('F', 'O')) where nr = 1""",
    "pipeline_spec": """select row_nr as id, case when regexp_full_match(trim(latitude, ' '), '-?[0-9]+([.][0-9]+)?') and try_cast(latitude as double) between -90 and 90 then try_cast(latitude as double) end as lat,
        case lower(gender) when 'm' then 'M' when 'f' then 'F' else '?' end as sex from mock_data""",
}
