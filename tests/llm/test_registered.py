import duckdb
import pytest

from tests.conftest import DATA
from turnweave.llm import registry


@pytest.mark.parametrize("name", registry.ORACLE_SQL)
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    wanted = con.sql(registry.ORACLE_SQL[name])
    found = registry.QUERIES[name](spark, DATA)
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns)
    rows = lambda it: sorted(map(str, it))
    assert rows(tuple(r[c] for c in columns) for r in found.collect()) == rows(wanted.select(*columns).fetchall())


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n not in registry.ORACLE_SQL and n != "pipeline"])
def test_one_row_per_document_at_least(spark, name):
    documents = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id")
    found = registry.QUERIES[name](spark, DATA).select("doc_id").distinct()
    assert found.count() == documents.count()


def test_native_plans(spark):
    from turnweave.llm import license_scan, pii, quality

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for frame in (quality.ledger(docs), license_scan.scan(docs), pii.find(docs)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
