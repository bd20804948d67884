"""Queries over derived inputs against their SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from threadlens.plans import decision_queries, index_queries, session_queries, store_queries

TABLES = "/root/testdata/sf0.001"
MODULES = {m.__name__ for m in (decision_queries, index_queries, session_queries, store_queries)}


def plain(value):
    number = float(value) if type(value).__name__ == "Decimal" else value
    return round(number, 6) if isinstance(number, float) and not math.isnan(number) else number


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="needs the tables")
def test_queries_equal_their_sql(spark):
    db = duckdb.connect()
    for name in os.listdir(TABLES):
        db.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{TABLES}/{name}'")
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    names = [n for n, f in queries.items() if f.__module__ in MODULES and n in oracles]
    assert len(names) >= 39
    for name in names:
        df = queries[name](spark, TABLES)
        columns = sorted(df.columns)
        found = db.execute(oracles[name])
        at = [[d[0] for d in found.description].index(c) for c in columns]
        want = sorted((tuple(plain(row[i]) for i in at) for row in found.fetchall()), key=repr)
        assert sorted((tuple(plain(row[c]) for c in columns) for row in df.collect()), key=repr) == want, name


def test_accepted_decisions_end_where_their_sql_ends(spark, tmp_path):
    """1,200 candidates are approved decisions, of which the SQL lists the first 1,000."""
    spark.range(1200).selectExpr("id * 9 + 3 AS event_id", "id * 6 + 3 AS user_id").write.parquet(f"{tmp_path}/events.parquet")
    found = [tuple(r) for r in store_queries.decision_list_accepted(spark, str(tmp_path)).select("id", "status", "state").collect()]
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert len(found) == 1000 and found == db.execute(__spark_entry__.oracle_sql()["decision_list_accepted"]).fetchall()
