import random

import pytest
from pyspark.sql import types as T

from spanloom.operators.hierarchy import descendants, linked_cases, resolve_hierarchy

SCHEMA = "trace_id string, span_id string, parent_span_id string, start_time timestamp, top string, kind int"


def brute(rows):
    """(trace, span) -> (top, links, state, path) by following parents one by one."""
    norm = lambda x: x.lower().removeprefix("0x")
    parent = {}
    for trace, span, up, *_ in rows:
        parent[trace, norm(span)] = None if up in (None, "") else norm(up)
    out = {}
    for trace, span, *_ in rows:
        seen, at = [], norm(span)
        while True:
            if at in seen:
                circle = seen[seen.index(at) :]
                links = seen.index(at)
                out[trace, span] = (min(circle), links, "under_cycle" if links else "cycle", seen[links::-1])
                break
            seen.append(at)
            up = parent[trace, at]
            if up is None or (trace, up) not in parent:
                kind = "root" if up is None else "orphan"
                links = len(seen) - 1
                out[trace, span] = (at, links, f"under_{kind}" if links else kind, seen[::-1])
                break
            at = up
    return out


def forest(seed, n=300, traces=4):
    rng, rows = random.Random(seed), []
    for t in range(traces):
        size = n if t == 0 else rng.randint(1, 30)  # one trace holds most rows
        ids = [f"{t:02x}{i:06x}" for i in range(size)]
        rng.shuffle(ids)
        for i, s in enumerate(ids):
            r = rng.random()
            up = ids[i - 1] if i and r < 0.6 else ids[rng.randrange(i)] if i and r < 0.8 else None
            if r > 0.97:
                up = "ffffffff"
            elif 0.9 < r < 0.94:
                up = ids[rng.randrange(size)]  # now and then a circle
            elif r > 0.95:
                up = ""
            if up and rng.random() < 0.3:
                up = "0x" + up.upper()
            rows.append((f"t{t}", s, up, None if rng.random() < 0.1 else rng.randrange(10**6), "x", 1))
    return rows


def frame(spark, rows):
    import datetime as dt

    rows = [(t, s, p, None if o is None else dt.datetime(2026, 1, 1) + dt.timedelta(seconds=o), a, b) for t, s, p, o, a, b in rows]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("seed,limit,cut,parts", [(1, 10**6, 64, None), (2, 40, 3, 5), (3, 100, 64, 3), (4, 20, 2, 4), (5, 60, 5, 6)])
def test_against_brute_force(spark, seed, limit, cut, parts):
    rows = forest(seed)
    got = resolve_hierarchy(frame(spark, rows), row_limit=limit, depth_cut=cut, partitions=parts, with_path=True)
    found = {(r.trace_id, r.span_id): (r.top_span_id, r.n_links, r.link_state, r.path) for r in got.collect()}
    assert found == brute(rows)


def test_long_circle_and_deep_chain(spark):
    rows = [("a", f"{i:04x}", f"{(i + 1) % 120:04x}", i, "x", 1) for i in range(120)]
    rows += [("a", f"{1000 + i:04x}", f"{999 + i:04x}" if i else f"{7:04x}", 500 + i, "x", 1) for i in range(90)]
    rows += [("b", f"{i:04x}", f"{i - 1:04x}" if i else None, i, "x", 1) for i in range(200)]
    got = resolve_hierarchy(frame(spark, rows), row_limit=30, depth_cut=4, partitions=5, with_path=True)
    found = {(r.trace_id, r.span_id): (r.top_span_id, r.n_links, r.link_state) for r in got.collect()}
    assert found == {k: v[:3] for k, v in brute(rows).items()}


def test_descendants_and_cases(spark):
    rows = [("a", f"{i:02x}", f"{i - 1:02x}" if i else None, i, "x", 1) for i in range(10)]
    got = resolve_hierarchy(frame(spark, rows), with_path=True)
    below = {(r.span_id, r.descendant_id, r.n_links) for r in descendants(got).collect()}
    assert below == {(f"{i:02x}", f"{j:02x}", j - i) for i in range(10) for j in range(i + 1, 10)}
    assert {(r.span_id, r.n_links, r.link_state) for r in linked_cases(got).collect()} == {("08", 8, "deep"), ("09", 9, "deep")}


def test_nulls_empty_table_and_repeated_rows(spark):
    assert resolve_hierarchy(frame(spark, [])).count() == 0
    rows = [(None, "aa", None, None, None, None), ("t", None, "AA", None, None, None), ("t", "bb", "bb", 1, None, None), ("t", "bb", "bb", 1, None, None)]
    got = sorted((r.trace_id or "", r.span_id, r.n_links, r.link_state) for r in resolve_hierarchy(frame(spark, rows)).collect())
    assert got == [("", "aa", 0, "root"), ("t", "", 0, "orphan"), ("t", "bb", 0, "cycle"), ("t", "bb", 1, "under_cycle")]
    assert isinstance(resolve_hierarchy(frame(spark, rows)).schema["n_links"].dataType, T.LongType)


def test_edges_and_topology(spark):
    import datetime as dt

    from spanloom.operators.hierarchy import topology, tree_edges

    t0 = dt.datetime(2026, 1, 1)
    rows = [("t", "r", None, "run", "chain", t0, 0), ("t", "a", "r", "n", "llm", t0, 2), ("t", "b", "r", "n", "tool", t0, 1), ("t", "c", "gone", None, "llm", t0, 3), ("t", "d", "a", "n", "llm", None, 4)]
    df = spark.createDataFrame(rows, "trace_id string, span_id string, parent_span_id string, agent_or_node_id string, span_kind string, start_time timestamp, pos int")
    assert sorted(tuple(r) for r in tree_edges(df).collect() if r.parent_span_id == "r") == [("t", "r", "a", 2), ("t", "r", "b", 1)]
    assert [tuple(r)[1:] for r in topology(df).orderBy("seq").collect()] == [(1, "run", "chain", "<root>"), (2, "n", "tool", "run"), (3, "n", "llm", "run"), (4, None, "llm", "<root>")]
