import datetime as dt
import random

import pytest

from spanloom.operators.preprocess import collapse_llm, filter_routers, preprocess, worker_spans
from spanloom.operators.validate import InvalidTraces, row_errors, trace_errors, validated
from spanloom.schema import SPAN_DDL

T0 = dt.datetime(2026, 1, 1)


def frame(spark, rows):
    """rows: trace, span, parent, kind, tokens."""
    data = [(t, s, p, s, k, T0, T0, "", "out", n, None, None, i, "x", True) for i, (t, s, p, k, n) in enumerate(rows)]
    return spark.createDataFrame(data, SPAN_DDL + ", up string, gone boolean")


def brute(rows):
    """Workers, collapsed rows and kept ids by plain walks."""
    parent = {(t, s): p for t, s, p, *_ in rows}
    kind = {(t, s): k for t, s, _, k, _ in rows}
    workers = set()
    for t, s, *_ in rows:
        if kind[t, s] in ("llm", "tool"):
            at, seen = parent[t, s], set()
            while at is not None and (t, at) in parent and at not in seen:
                seen.add(at)
                workers.add((t, at))
                at = parent[t, at]
    kept = []
    for t, s, p, k, n in rows:
        if k == "llm":
            continue
        extra = [m for u, _, q, j, m in rows if u == t and j == "llm" and q == s and m is not None]
        up = parent[t, p] if p is not None and kind.get((t, p)) == "llm" else p
        kept.append((t, s, up, k, (n or 0) + sum(extra) if extra else n))
    left = {(t, s) for t, s, p, k, _ in kept if not (k in ("chain", "agent") and p is not None and (t, s) not in workers)}
    return workers, kept, left


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_plain_walks(spark, seed):
    rng, rows = random.Random(seed), []
    for t in "ab":
        for i in range(40):
            p = None if i == 0 else rng.choice([f"{t}{rng.randrange(i)}", f"{t}{i - 1}", "gone", f"{t}{rng.randrange(40)}"] if rng.random() < 0.2 else [f"{t}{i - 1}", f"{t}{rng.randrange(i)}"])
            rows.append((t, f"{t}{i}", p, rng.choice(["llm", "tool", "chain", "chain", "chain", "agent"]), rng.choice([None, 5, 7])))
    workers, kept, left = brute(rows)
    df = frame(spark, rows)
    assert {(r.trace_id, r.span_id) for r in worker_spans(df).collect()} == workers
    got = collapse_llm(df)
    assert sorted((r.trace_id, r.span_id, r.parent_span_id or "", r.span_kind, r.token_count or -1) for r in got.collect()) == sorted((t, s, p or "", k, n or -1) for t, s, p, k, n in kept)
    assert {(r.trace_id, r.span_id) for r in filter_routers(got, worker_spans(df)).collect()} == left
    done, counts = preprocess(df)
    assert {(r.trace_id, r.span_id) for r in done.collect()} == left
    n_llm = {t: sum(r[0] == t and r[3] == "llm" for r in rows) for t in "ab"}
    assert {r.trace_id: (r.collapsed_llm_spans, r.filtered_router_spans) for r in counts.collect()} == {
        t: (n_llm[t], sum(r[0] == t for r in kept) - sum(x[0] == t for x in left)) for t in "ab"
    }


def test_deep_chain_and_empty_table(spark):
    rows = [("t", f"{i}", str(i - 1) if i else None, "chain", None) for i in range(70)] + [("t", "end", "69", "tool", 1)]
    assert worker_spans(frame(spark, rows)).count() == 70
    done, counts = preprocess(frame(spark, []))
    assert done.count() == 0 and counts.count() == 0


def test_tool_under_model_call_moves_up(spark):
    rows = [("t", "root", None, "chain", None), ("t", "w", "root", "chain", 1), ("t", "m", "w", "llm", 20), ("t", "tool", "m", "tool", None), ("t", "route", "root", "chain", None)]
    done, counts = preprocess(frame(spark, rows))
    assert sorted((r.span_id, r.parent_span_id, r.token_count) for r in done.collect()) == [("root", None, None), ("tool", "w", None), ("w", "root", 21)]
    assert [tuple(r) for r in counts.collect()] == [("t", 1, 1)]


def test_validation(spark):
    good = [("g", "1", None, "chain", 1), ("g", "2", "1", "tool", None)]
    bad = [("two", "1", None, "chain", 1), ("two", "2", None, "chain", 1), ("orphan", "1", None, "chain", 1), ("orphan", "2", "9", "chain", 1)]
    bad += [("circle", "1", None, "chain", 1), ("circle", "2", "3", "llm", 1), ("circle", "3", "2", "llm", 1), ("none", "1", "1", "llm", 1), ("twice", "1", None, "chain", 1), ("twice", "2", "1", "llm", 1), ("twice", "2", "1", "llm", 1)]
    df = frame(spark, good + bad)
    errors = {(r.trace_id, r.error, r.n) for r in trace_errors(df).collect()}
    assert errors == {("two", "several roots", 2), ("orphan", "orphan", 1), ("circle", "circle", 2), ("none", "no root", 0), ("none", "circle", 1), ("twice", "repeated span id", 1)}
    left, set_aside = validated(df)
    assert {r.trace_id for r in left.collect()} == {"g"} and {r.trace_id for r in set_aside.collect()} == {"two", "orphan", "circle", "none", "twice"}
    with pytest.raises(InvalidTraces):
        validated(df, strict=True)
    row = ("t", "s", None, None, "odd", T0, T0 - dt.timedelta(1), None, " 　", -1, None, -0.5, 0)
    found = {r.error for r in row_errors(spark.createDataFrame([row], SPAN_DDL)).collect()}
    assert found == {"no node", "unknown kind", "end before start", "no input", "blank output", "negative tokens", "negative rate"}
