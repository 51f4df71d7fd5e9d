import os
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]
TABLES = "/root/testdata/sf0.001"


def test_registry():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert {"p2_found", "p5_found", "candidates", "trace_verdicts"} <= set(queries)


def test_everything_imports_without_a_session_and_without_the_subpackage():
    code = (
        "import sys; sys.modules['spanloom.llm'] = None; import __spark_entry__ as e, pkgutil, importlib, spanloom\n"
        "names = [m.name for m in pkgutil.walk_packages(spanloom.__path__, 'spanloom.') if '.llm' not in m.name and '__main__' not in m.name]\n"
        "[importlib.import_module(n) for n in names]\n"
        "q = e.queries(); assert 'p5_found' in q and 'p4_found' not in q; assert set(e.oracle_sql()) <= set(q)"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


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

    queries = entry.queries()
    from spanloom.plans import core_queries, problems

    for name, sql in {**core_queries.SQL, **problems.SQL}.items():
        df = queries[name](spark, TABLES)
        mine = rows(df.columns, [tuple(r) for r in df.collect()])
        found = db.execute(sql)
        assert mine == rows([c[0] for c in found.description], found.fetchall()), name
    assert entry.entry(spark).count() > 0
