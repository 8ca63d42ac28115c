"""Every registered query of the engine against its SQL, on the smallest tables."""

import duckdb
import pytest

from cartoflow.plans.registry import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{FOLDER}/{name}.parquet')")
    return con


def plain(v):
    if v is None or v != v:
        return ""
    if isinstance(v, float):
        return f"{v:.7g}"
    return str(v).removesuffix(".0")


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    out = QUERIES[name](spark, FOLDER)
    got = rows(out.columns, [tuple(r) for r in out.collect()])
    if name not in ORACLE_SQL:
        assert got[0]
        return
    done = duck.execute(ORACLE_SQL[name])
    want = rows([d[0] for d in done.description], done.fetchall())
    assert got == want


def test_names_agree():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
