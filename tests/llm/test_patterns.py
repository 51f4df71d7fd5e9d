import datetime as dt
import random
from itertools import combinations

import pytest

from spanloom.llm import patterns
from spanloom.llm.patterns import frequent_subsequences, shorten

SCHEMA = "trace_id string, span_id string, name string, start_time timestamp, pos int, items string, n int"
T0 = dt.datetime(2026, 1, 1)


def events(spark, sequences, clash=True):
    rows = [
        (f"t{t}", f"{t}-{i}", x, T0 + dt.timedelta(seconds=i // 2), i, "clash", 1)  # ties in time
        for t, s in enumerate(sequences)
        for i, x in enumerate(s)
    ]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


def contains(sequence, pattern):
    it = iter(sequence)
    return all(x in it for x in pattern)


def brute(sequences, least, lengths):
    found = {}
    for s in sequences:
        for n in lengths:
            for p in set(combinations(s, n)):
                found[p] = found.get(p, 0) + 1
    return {">".join(p): n for p, n in found.items() if n >= least}


@pytest.mark.parametrize("seed,alphabet,top", [(1, "abcd", 9), (2, "abc", 12), (3, "abcdefgh", 10)])
def test_all_patterns_with_their_supports(spark, seed, alphabet, top):
    rng = random.Random(seed)
    sequences = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, top))) for _ in range(40)]
    sequences += [sequences[0]] * 5
    every, closed = frequent_subsequences(events(spark, sequences), n_sequences=45, min_support=6, min_share="0.2", max_live=3)
    assert {r.steps: r.support for r in every.collect()} == brute(sequences, 9, (3, 4, 5))
    got = {r.steps: r.support for r in closed.collect()}
    for steps, n in got.items():
        p = steps.split(">")
        assert n == sum(contains(s, p) for s in sequences)
        if len(p) <= 5:  # closed: no insertion of one item keeps the support
            assert all(
                sum(contains(s, p[:i] + [x] + p[i:]) for s in sequences) < n for i in range(len(p) + 1) for x in alphabet
            ), steps


def test_one_trace_with_most_events(spark):
    rng = random.Random(5)
    sequences = ["".join(rng.choice("abcde") for _ in range(6)) for _ in range(20)]
    sequences.append("".join(rng.choice("abcde") for _ in range(3000)))
    every, _ = frequent_subsequences(events(spark, sequences), n_sequences=21, min_support=3, min_share="0", min_len=2, max_len=3)
    expected = {
        ">".join(p): n
        for k in (2, 3)
        for p in __import__("itertools").product("abcde", repeat=k)
        if (n := sum(contains(s, p) for s in sequences)) >= 3
    }
    assert {r.steps: r.support for r in every.collect()} == expected


@pytest.mark.parametrize("k", [1, 2, 3, 4])
def test_shortened_sequences_contain_the_same(k):
    rng = random.Random(k)
    for _ in range(60):
        s = [rng.randrange(3) for _ in range(rng.randint(0, 14))]
        short = shorten(s, k)
        for n in range(1, k + 1):
            assert set(combinations(s, n)) == set(combinations(short, n))
        cut = rng.randint(0, len(s))
        joined = shorten(shorten(s[:cut], k) + shorten(s[cut:], k), k)
        assert set(combinations(s, k)) == set(combinations(joined, k))
    assert len(shorten([0, 1] * 5000, 5)) < 30


def test_closed_patterns_of_long_traces(spark):
    sequences = ["a" * 36 + "b"] * 4 + ["c" + "a" * 40] * 2 + ["abc"]
    every, closed = frequent_subsequences(events(spark, sequences), n_sequences=7, min_support=4, min_share="0")
    assert {r.steps.replace(">", ""): r.support for r in closed.collect()} == {"a": 7, "ab": 5, "a" * 36: 6, "a" * 36 + "b": 4}
    assert {r.steps.replace(">", ""): r.support for r in every.collect()} == {"aaa": 6, "aaaa": 6, "aaaaa": 6, "aab": 4, "aaab": 4, "aaaab": 4}


def test_closed_patterns_at_borders(spark):
    rng = random.Random(9)
    core = "abcdeabc"
    sequences = ["".join(x + rng.choice("xyz") * rng.randint(0, 4) for x in core) for _ in range(30)]
    closed = frequent_subsequences(events(spark, sequences).repartition(7), n_sequences=30, min_support=20, min_share="0")[1]
    got = {r.steps.replace(">", ""): r.support for r in closed.collect()}
    assert any(core in (p.replace("x", "").replace("y", "").replace("z", "")) for p in got)
    for p, n in got.items():
        assert n == sum(contains(s, p) for s in sequences)
        assert all(sum(contains(s, p[:i] + x + p[i:]) for s in sequences) < n for i in range(len(p) + 1) for x in "abcdexyz"), p


def test_supports_of_closed_patterns_of_long_sequences(spark, monkeypatch):
    """Sequences of more than forty items, every closed pattern against brute force; written in small lots."""
    monkeypatch.setattr(patterns, "_WRITE", 5)
    rng = random.Random(11)
    sequences = ["".join(rng.choice("abcd") if rng.random() < 0.3 else "abcd"[i // 6 % 4] for i in range(44)) for _ in range(12)]
    closed = frequent_subsequences(events(spark, sequences), n_sequences=12, min_support=12, min_share="0", max_live=200)[1]
    got = {r.steps.replace(">", ""): r.support for r in closed.collect()}
    level, frequent = {""}, set()
    while level:
        level = {p + x for p in level for x in "abcd" if all(contains(s, p + x) for s in sequences)}
        frequent |= level
    want = {p for p in frequent if not any(p[:i] + x + p[i:] in frequent for i in range(len(p) + 1) for x in "abcd")}
    assert got == dict.fromkeys(want, 12) and max(map(len, got)) >= 12


def test_nulls_and_empty_tables(spark):
    every, closed = frequent_subsequences(events(spark, []), n_sequences=0)
    assert every.count() == 0 and closed.count() == 0
    rows = [("t", "a", None, T0, 1, None, None), (None, "b", "x", T0, 1, None, None), ("t", "c", "x", None, None, None, None)]
    every, closed = frequent_subsequences(spark.createDataFrame(rows, SCHEMA), n_sequences=1, min_support=1)
    assert every.count() == 0 and closed.count() == 0
