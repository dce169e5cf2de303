"""The registered queries against their SQL, on the smallest tables."""

import json
import math
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pyspark
import pytest

from tributary import component_oracle, component_queries, oracle, preparation_oracle, preparation_queries, queries

SQL = oracle.ORACLE | component_oracle.ORACLE | preparation_oracle.ORACLE
QUERIES = queries.QUERIES | component_queries.QUERIES | preparation_queries.QUERIES


@pytest.fixture(scope="module")
def duck(small):
    connection = duckdb.connect()
    for path in Path(small).glob("*.parquet"):
        connection.execute(f"create view {path.stem} as select * from '{path}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(repr(tuple(plain(r[i]) for i in order)) for r in rows)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_what_its_sql_gives(spark, duck, small, name):
    df = QUERIES[name](spark, small)
    found = duck.execute(SQL[name])
    assert table(df.columns, df.collect()) == table([c[0] for c in found.description], found.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_other_queries_run(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


ON_EXECUTORS = """
import json, sys
from pyspark.sql import SparkSession
from tributary import component_queries

name, data, base = sys.argv[1:]
conf = {"spark.master": "local-cluster[2,1,1024]", "spark.executor.memory": "512m", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4", "spark.driver.host": "127.0.0.1",
        "spark.sql.session.timeZone": "UTC", "spark.sql.warehouse.dir": base + "/warehouse", "spark.checkpoint.dir": base + "/shared"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
df = component_queries.QUERIES[name](spark, data)
print(json.dumps([df.columns, [list(r) for r in df.collect()]]))
spark.stop()
"""


@pytest.mark.parametrize("name", ["jdbc_incremental", "jdbc_parallel", "jdbc_sink"])
def test_databases_are_reached_from_executors_in_other_processes(duck, small, tmp_path, name):
    home = tmp_path / "home"  # executors write below it
    (home / "work").mkdir(parents=True)
    for path in Path(pyspark.__file__).parent.iterdir():
        if path.name != "work":
            (home / path.name).symlink_to(path)
    env = os.environ | {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_PYTHON": sys.executable, "TMPDIR": str(tmp_path)}
    env.pop("PYSPARK_GATEWAY_PORT", None)
    run = subprocess.run([sys.executable, "-c", ON_EXECUTORS, name, small, str(tmp_path)], env=env, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-3000:]
    columns, rows = json.loads(run.stdout.splitlines()[-1])
    found = duck.execute(SQL[name])
    assert table(columns, rows) == table([c[0] for c in found.description], found.fetchall())
    assert not list(tmp_path.glob("tributary-*"))
