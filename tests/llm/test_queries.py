import os
from pathlib import Path

import pytest

from spanloom.llm.queries import QUERIES, SQL

TABLES = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="the driver's tables are not here")
def test_queries_equal_their_sql_on_the_smallest_tables(spark):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    db.execute("SET timezone = 'UTC'")
    for p in Path(TABLES).glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")

    def rows(columns, data):
        order = sorted(range(len(columns)), key=lambda i: columns[i])
        value = lambda x: round(x, 5) + 0.0 if isinstance(x, float) else x
        return sorted(columns), sorted([tuple(value(r[i]) for i in order) for r in data], key=repr)

    assert set(SQL) <= set(QUERIES)
    for name, sql in SQL.items():
        df = QUERIES[name](spark, TABLES)
        mine = rows(df.columns, [tuple(r) for r in df.collect()])
        found = db.execute(sql)
        assert mine == rows([c[0] for c in found.description], found.fetchall()), name


def test_found_queries_have_their_columns(spark):
    if not os.path.isdir(TABLES):
        pytest.skip("the driver's tables are not here")
    expected = {
        "p1_found": ["steps string"],
        "p3_found": ["trace_id string", "first_span_id string", "last_span_id string"],
        "p4_found": ["span_id_a string", "span_id_b string"],
        "p6_ids": ["doc_id bigint", "ids array<int>"],
        "p7_found": ["doc_id bigint", "item_id bigint"],
        "p8_found": ["doc_id bigint", "fault string"],
    }
    for name, columns in expected.items():
        assert [f"{c} {t}" for c, t in QUERIES[name](spark, TABLES).dtypes] == columns
