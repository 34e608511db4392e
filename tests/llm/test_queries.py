"""Registered queries on the smallest data: those with SQL against it, the others as a whole."""

from pathlib import Path

import duckdb
import pytest

from loomgraph.llm.queries import oracle_sql, queries

DATA = Path("/root/testdata/sf0.001")


def test_queries_equal_their_sql(spark):
    if not DATA.exists():
        pytest.skip("no test data")
    c = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    for name, sql in oracle_sql().items():
        df, want = queries()[name](spark, str(DATA)), c.sql(sql)
        assert df.columns == want.columns
        assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want.fetchall())), name


COLUMNS = {
    "p1_found": ["origin", "row_id", "term_id"], "p2_found": ["vec_id_1", "vec_id_2"], "p3_found": ["source_id", "target_id"], "p4_found": ["subject", "predicate", "triplet_id"],
    "p5_found": ["record_id", "group_id"], "p7_found": ["doc_id", "item_id"], "p8_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_distinct_rows(spark, name):
    if not DATA.exists():
        pytest.skip("no test data")
    df = queries()[name](spark, str(DATA))
    rows = df.collect()
    assert df.columns == COLUMNS[name] and len(rows) == len(set(map(tuple, rows))) > 0
