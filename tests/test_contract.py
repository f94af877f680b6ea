"""The registered queries: names, SQL twins, and a sample of them against DuckDB."""

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries
from tools.check_queries import rows_of

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()
SAMPLE = ["flagship_order_status", "e8_drop_duplicates", "q6_duplicate_rows", "q9_value_counts", "v1_histogram", "p4_target_encode",
          "m13_folds", "l11_knn_regressor", "x3_score_stream"]


def test_every_sql_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, sf, db, name):
    df = queries()[name](spark, sf)
    rel = db.execute(oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(names, rel.fetchall())
