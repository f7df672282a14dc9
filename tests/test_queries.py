"""Every registered query against DuckDB over the same files, but for those of the optional corpus part."""

import math

import duckdb
import pytest

from tallyforge.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(data):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return float(v) if hasattr(v, "as_tuple") else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_oracle(name, spark, duck, data):
    df = catalog.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=str)
    if name not in catalog.ORACLES:
        assert got
        return
    result = duck.execute(catalog.ORACLES[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(row[names.index(c)]) for c in columns) for row in result.fetchall()), key=str)
    assert got == want


@pytest.mark.parametrize("name", ["udf01_02_transforms", "udf03_single_transform"])
def test_programs_are_rewritten_in_many_tasks(name, spark, data):
    df = catalog.QUERIES[name](spark, data)
    assert spark.read.parquet(f"{data}/part.parquet").rdd.getNumPartitions() == 1
    assert sum(n > 0 for n in df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_programs_of_the_report_are_dealt_before_they_are_rewritten(spark, data):
    plan = catalog.QUERIES["udf03_validation_report"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in plan[plan.index("ArrowEvalPython") :]
