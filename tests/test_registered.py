"""Every registered query against its SQL on whole tables; the others must return rows."""

import pytest

import __spark_entry__ as entry_point

duckdb = pytest.importorskip("duckdb")

QUERIES, CHECKS = entry_point.queries(), entry_point.oracle_sql()
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


@pytest.fixture(scope="module")
def check(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def test_checks_belong_to_queries():
    assert set(CHECKS) <= set(QUERIES)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in CHECKS])
def test_matches_sql(spark, check, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    got = sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)
    res = check.execute(CHECKS[name])
    names = [d[0] for d in res.description]
    order = [names.index(c) for c in sorted(names)]
    want = sorted((tuple(r[i] for i in order) for r in res.fetchall()), key=repr)
    assert sorted(df.columns) == sorted(names)
    assert got == want


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in CHECKS])
def test_runs(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    rows = df.limit(5).collect()
    assert rows and any(v is not None for v in rows[0])


def test_only_optional_operators_lack_sql():
    assert all(n == "pipeline" or n.startswith("op") for n in QUERIES if n not in CHECKS)


def test_entry(spark):
    df = entry_point.entry(spark)
    assert "mean" in df.columns and df.count() > 0
