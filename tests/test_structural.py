import datetime as dt
import random

import pytest

from spanloom.operators import detect as det
from spanloom.operators.events import numbered
from spanloom.operators.structural import candidate_pairs, pingpong_pairs, repeat_pairs, shown
from spanloom.schema import SPAN_DDL

T0 = dt.datetime(2026, 1, 1)


def frame(spark, rows):
    """rows: trace, span, node, kind, second, input, output, tokens, rate."""
    data = [
        (t, s, None, n, k, None if o is None else T0 + dt.timedelta(seconds=o), None, i, x, tok, "m", rate, p)
        for p, (t, s, n, k, o, i, x, tok, rate) in enumerate(rows)
    ]
    return spark.createDataFrame([(*r, "clash", 1) for r in data], SPAN_DDL + ", o string, n int")


def trace(nodes, kind="llm", inputs=None):
    return [("t", f"s{i + 1}", n, kind, i, inputs[i] if inputs else "in", "out", None, None) for i, n in enumerate(nodes)]


def ids(df):
    return sorted((r.origin_id, r.candidate_id) for r in shown(df).collect())


def brute(rows, n):
    """Ordered candidate pairs of each trace, by plain loops over its sorted spans."""
    out = {}
    numbered_rows = [(*r, p) for p, r in enumerate(rows)]
    for t in {r[0] for r in rows}:
        spans = sorted((r for r in numbered_rows if r[0] == t and r[4] is not None and r[2] is not None), key=lambda r: (r[4], r[9]))
        groups = {}
        for s in spans:
            groups.setdefault(s[2], []).append(s)
        norm = lambda x: None if x is None else x.strip().casefold()
        pairs = [
            (g[0][1], c[1]) for g in groups.values() if len(g) >= n for c in g[1:] if g[0][3] != "tool" or norm(g[0][5]) == norm(c[5])
        ]
        for a, b, c, d in zip(spans, spans[1:], spans[2:], spans[3:]):
            if a[2] == c[2] and b[2] == d[2] and a[2] != b[2]:
                pairs += [(a[1], c[1]), (b[1], d[1])]
        out[t] = list(dict.fromkeys(pairs))
    return out


def test_rules_on_small_traces(spark):
    assert ids(repeat_pairs(frame(spark, trace("AAA")))) == [("s1", "s2"), ("s1", "s3")]
    assert ids(repeat_pairs(frame(spark, trace("AA")), 3)) == []
    assert ids(pingpong_pairs(frame(spark, trace("ABAB")))) == [("s1", "s3"), ("s2", "s4")]
    assert ids(pingpong_pairs(frame(spark, trace("AAAA")))) == []
    assert ids(candidate_pairs(frame(spark, trace("ABABA")))) == [("s1", "s3"), ("s1", "s5"), ("s2", "s4"), ("s3", "s5")]
    assert ids(repeat_pairs(frame(spark, trace("AAA", "tool", ["Key=1", " key=1 \n", "key=2"])))) == [("s1", "s2")]
    assert ids(repeat_pairs(frame(spark, trace("AA", "tool", ["Straße", "STRASSE"])))) == [("s1", "s2")]
    assert ids(repeat_pairs(frame(spark, trace("AAA", "tool", [None, None, "x"])))) == [("s1", "s2")]
    with pytest.raises(ValueError):
        repeat_pairs(frame(spark, []), 1)


@pytest.mark.parametrize("seed,partitions", [(1, "1"), (2, "7"), (3, "23")])
def test_against_plain_loops(spark, seed, partitions):
    rng = random.Random(seed)
    rows = []
    for t, size in (("big", 120), ("a", 9), ("b", 2), ("c", 14)):
        for i in range(size):
            node = rng.choice("ABC") if rng.random() < 0.7 else rng.choice(["D", None])
            second = None if rng.random() < 0.05 else rng.randrange(size) // 2
            rows.append((t, f"{t}{i:03d}", node, rng.choice(["llm", "tool", None]), second, rng.choice(["x", " X ", "y", None]), rng.choice(["p", "q", None]), rng.choice([None, 3, 10]), rng.choice([None, 0.5])))
    keys = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = [spark.conf.get(k) for k in keys]
    for k, v in zip(keys, (partitions, "false")):
        spark.conf.set(k, v)
    try:
        df = frame(spark, rows)
        pairs = candidate_pairs(df).collect()
        details = det.waste_details(det.scored_pairs(candidate_pairs(df)), 0.99)
        waste = {(r.trace_id, r.seq): r.candidate_id for r in det.waste_spans(details).collect()}
        chosen = {(r.trace_id, r.candidate_id): r.origin_id for r in details.collect()}
        verdicts = {r.trace_id: r for r in det.verdicts(df, details).collect()}
        seqs = {(r.trace_id, r.seq): r.span_id for r in numbered(df.select("trace_id", "span_id", "start_time", "pos")).collect()}
    finally:
        for k, v in zip(keys, before):
            spark.conf.set(k, v)
    expected = brute(rows, 2)
    out = {r[1]: r[6] or "" for r in rows}
    cost = {r[1]: (r[7] or 0, (r[7] or 0) * (r[8] or 0.0)) for r in rows}
    for t, want in expected.items():
        got = [(p.o.span_id, p.c.span_id) for p in sorted((p for p in pairs if p.trace_id == t), key=lambda p: _key(p.ord))]
        assert got == want
        hits = [(o, c) for o, c in want if out[o] == out[c]]
        wasted = list(dict.fromkeys(c for _, c in hits))
        assert [waste[k] for k in sorted(waste) if k[0] == t] == wasted
        assert {c: chosen[t, c] for c in wasted} == {c: next(o for o, x in hits if x == c) for c in wasted}
        v = verdicts[t]
        assert (v.wasteful, v.waste_spans, v.waste_tokens) == (bool(wasted), len(wasted), sum(cost[c][0] for c in wasted))
        assert v.waste_cost == pytest.approx(sum(cost[c][1] for c in wasted))
        ordered = sorted((r for p, r in enumerate(rows) if r[0] == t and r[4] is not None), key=lambda r: (r[4], rows.index(r)))
        assert [seqs[k] for k in sorted(seqs) if k[0] == t] == [r[1] for r in ordered]


def _key(ord_):
    none = lambda x: (x is not None, x if x is not None else 0)
    return (ord_.r, *(none(v) for v in (*ord_.x, *ord_.y)))


def test_empty_table_and_nulls(spark):
    empty = frame(spark, [])
    assert candidate_pairs(empty).count() == 0
    v, d = det.detect(empty)
    assert v.count() == 0 and d.count() == 0
    rows = [(None, "a", "n", "llm", 1, None, None, None, None), ("t", "b", None, None, None, None, None, None, None)]
    v, d = det.detect(frame(spark, rows))
    assert [tuple(r) for r in v.collect()] == [("t", False, 0, 0, 0.0)] and d.count() == 0
