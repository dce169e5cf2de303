"""Equivalent SQL for the queries of ``tributary.component_queries``."""

ORACLE = {
    "json_inferred": """select case when p_partkey % 10 <> 0 then p_partkey end as id, case when p_partkey % 10 <> 0 then p_name || ' ' || p_brand end as text,
        case when p_partkey % 10 <> 0 then 'a b' || p_size end as x, p_partkey % 10 = 0 as corrupt from part""",
    "json_sequence": "select n_nationkey as key, n_name as name from nation",
    "csv_inferred": "select n_nationkey, n_name from nation",
    "input_paths": """select * from (values ('hdfs://nameservice-ha:8020/a/b', '/a/b', 'hdfs://nameservice-ha:8020/a/b/*', '/a/b/20/01/31/*'), ('/a/b', '/a/b', '/a/b/*', '/a/b/20/01/31/*'),
        ('/a/b/*', '/a/b/*', '/a/b/*', '/a/b/20/01/31/*'), ('/a/b/', '/a/b/', '/a/b/*', '/a/b/20/01/31/*')) t("given", bare, "whole", "day")""",
    "jdbc_parallel": "select event_id, case when event_id % 10 > 0 then user_id end as user_id, event_type from events where event_id > 5",
    "jdbc_incremental": """with a as (select event_id from events where event_id % 2 = 0 and event_id <= 400), b as (select event_id from events where event_id <= 700 and event_id > (select max(event_id) from a)),
            c as (select event_id from events where event_id > (select max(event_id) from b))
        select 20200101 as dt, count(*) as n, min(event_id) as first_id, max(event_id) as last_id from a
        union all select 20200102, count(*), min(event_id), max(event_id) from b union all select 20200103, count(*), min(event_id), max(event_id) from c""",
    "bounds_of_log": """select * from (values (20180510, null, '2018-05-15 03:30:00'), (20180515, '2018-05-15 03:30:00', '2018-05-16 03:29:59'),
        (20180517, '2018-05-17 03:30:00', '2018-05-18 03:29:59'), (20180520, '2018-05-18 03:29:59', null)) t(dt, "lower", "upper")""",
    "jdbc_sink": "select n_nationkey, n_name from nation",
    "table_append": "select n_nationkey, cast(case when n_nationkey < 5 then 2 else 1 end as bigint) as n, 3 as refused from nation",
    "comments_inserted": """select * from (values ('insert', 'n_nationkey', 'the key'), ('insert', 'n_name', 'a name'), ('insert', 'n_regionkey', 'own'),
        ('upsert', 'n_nationkey', 'mapped'), ('upsert', 'n_name', 'a name'), ('upsert', 'n_regionkey', 'its region'),
        ('stored', 'n_nationkey', 'the key'), ('stored', 'n_regionkey', 'its region')) t(origin, column_name, comment)""",
    "refusals": """select * from (values ('missing column', 'AnalysisException'), ('ambiguous column', 'AnalysisException'), ('ambiguous column skipped', 'none'), ('short line', 'ColumnMappingNotSupported'),
        ('no such mode', 'MapperParameterNotSupported'), ('wrong type', 'DataTypeValidationFailed'), ('no elements', 'ValueError'), ('no mode', 'RuntimeError'), ('no password', 'AssertionError'),
        ('password no text', 'AssertionError'), ('no path', 'AttributeError'), ('no partition column', 'AssertionError'), ('no expression', 'ValueError')) t("case", error)""",
    "pipeline_by_http": "select cast(n_nationkey as bigint) as key, n_name as name, 1 as dt from nation where n_regionkey = 1",
    "own_component": "select r_regionkey, r_regionkey * 3 as tripled from region where r_regionkey > 0",
    "json_python_style": r"""select r_regionkey, '{"k": ' || r_regionkey || ', "n": "\u00e9"}' as o, '[{"k": ' || r_regionkey || ', "n": "\u00e9"}]' as l, '{''a'': ' || r_regionkey || '}' as m,
        '[''' || r_name || ''']' as t, '2020-01-02 03:04:05' as "at" from region""",
    "log_levels": """select * from (values ('dev', 'DEBUG'), ('development', 'DEBUG'), ('test', 'ERROR'), ('prod', 'WARNING'), ('', 'INFO'), (null, 'INFO')) t(environment, level)""",
}
