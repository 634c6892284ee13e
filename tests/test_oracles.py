"""Every query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from tessera.oracles import ORACLES
from tessera.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(rows):
    cell = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(cell, r)) for r in rows)


def compare(spark, data, name, run, sql):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    df = run(spark, data)
    names = sorted(df.columns)
    own = normal(df.select(*[f"`{n}`" for n in names]).collect())
    found = db.execute(sql)
    heads = [d[0] for d in found.description]
    assert sorted(heads) == names
    other = normal([[r[heads.index(n)] for n in names] for r in found.fetchall()])
    assert own == other, name


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, data, name):
    compare(spark, data, name, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry_lists_all(spark):
    import __spark_entry__ as entry

    assert set(ORACLES) <= set(entry.oracle_sql()) and set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark, data):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns[0] == "feature"
