import duckdb
import pytest

from tests.conftest import DATA
from turnweave.plans import registry

TABLES = "conversations documents labels".split()


@pytest.mark.parametrize("name", registry.QUERIES)
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    wanted = con.sql(registry.ORACLE_SQL[name])
    found = registry.QUERIES[name](spark, DATA)
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns)
    rows = lambda it: sorted(map(str, it))
    assert rows(tuple(r[c] for c in columns) for r in found.collect()) == rows(wanted.select(*columns).fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
