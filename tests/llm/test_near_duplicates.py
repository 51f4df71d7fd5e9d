import datetime as dt
import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from spanloom.functions.hashing import distinct_by_text
from spanloom.llm import near_duplicates as nd
from spanloom.llm.near_duplicates import Options, near_duplicates
from spanloom.llm.superminhash import band_keys, signatures, similarity

SCHEMA = "trace_id string, span_id string, ingested_at timestamp, input_text string, output_text string, fp long, key long, n int, at string"
T0 = dt.datetime(2026, 1, 1)


def spans(spark, rows):
    return spark.createDataFrame([(t, s, None if o is None else T0 + dt.timedelta(seconds=o), i, x, 1, 1, 1, "x") for t, s, o, i, x in rows], SCHEMA)


def shingle_set(i, o, k=3, least=30):
    w = [x.lower() for x in re.findall(r"[^\W_]+", f"{i or ''}\n{o or ''}")]
    return frozenset(zip(*(w[j:] for j in range(k)))) if len(w) >= least else None


def brute(rows):
    current = {}
    for t, s, o, i, x in rows:
        if (t, s) not in current or o > current[t, s][0]:
            current[t, s] = (o, i, x)
    sets = {s: c for (t, s), (o, i, x) in current.items() if (c := shingle_set(i, x))}
    return {(a, b) for a, b in combinations(sorted(sets), 2) if 10 * len(sets[a] & sets[b]) >= 6 * len(sets[a] | sets[b])}


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("ABCDEFGHΣİé漢") + str(rng.randrange(400))
    rows, n = [], 0

    def add(words, stale=False):
        nonlocal n
        cut = rng.randrange(len(words) + 1)
        one, two = " ".join(words[:cut]), " ".join(words[cut:])
        rows.append((f"t{n % 7}", f"{n:06d}", 5, one or None, two or None))
        if stale:  # an older version with another text
            rows.append((f"t{n % 7}", f"{n:06d}", 1, "old", " ".join(word() for _ in range(40))))
        n += 1

    for _ in range(40):
        base = [word() for _ in range(rng.randint(28, 90))]
        add(base, rng.random() < 0.3)
        for _ in range(rng.randint(0, 4)):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 5])):
                w[rng.randrange(len(w))] = word()
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w = w[at:] + w[:at]
            add(w, rng.random() < 0.1)
    hot = [word() for _ in range(50)]
    for _ in range(60):  # a third of the rows are copies
        add([x.lower() if rng.random() < 0.5 else x for x in hot])
    rows += rows[:5]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,block,exact", [(1, 256, False), (2, 3, False), (3, 256, True), (4, 2, True)])
def test_pairs_and_groups(spark, seed, block, exact):
    rows = corpus(seed)
    found = near_duplicates(spans(spark, rows).repartition(4), Options(block=block, exact=exact))
    pairs = [(r.span_id_a, r.span_id_b) for r in found.span_pairs().collect()]
    expected = brute(rows)
    assert len(pairs) == len(set(pairs)) and set(pairs) <= expected
    assert len(pairs) >= (1 if exact else 0.99) * len(expected)
    up, links = {}, {}
    for a, b in pairs:
        links[a], links[b] = links.get(a, 0) + 1, links.get(b, 0) + 1
        for x in (a, b):
            up.setdefault(x, x)
        find = lambda x: x if up[x] == x else find(up[x])
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {r.span_id: (r.group_id, r.n_links) for r in found.groups().collect()}
    assert got == {x: (find(x), links[x]) for x in up}


def test_what_a_task_holds_does_not_change_pairs(spark, monkeypatch):
    """Buckets gathered in many parts, with keys found frequent before and after others arrived."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):  # many different sets that share most bands
        w = list(base)
        w[rng.randrange(60)] = f"x{i}"
        rows.append(("t", f"{i:04d}", 1, " ".join(w), None))
    batches = lambda parts, columns: iter([pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*part)], columns) for part in parts])
    met = {}
    for flush, gather in ((1_000_000, 4_000_000), (300, 500)):
        monkeypatch.setattr(nd, "_FLUSH", flush)
        monkeypatch.setattr(nd, "_GATHER", gather)
        blocks = []
        for k in range(3):
            texts = [(r[3].encode(), i) for i, r in enumerate(rows[k::3])]
            for b in nd._emit_keys(Options(block=20), 8)(batches([texts[:7], texts[7:]], ["text", "h"])):
                blocks += b.to_pylist()
        blocks.sort(key=lambda r: r["bucket"])
        table = pa.RecordBatch.from_pylist(blocks, pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("sets", pa.binary()), ("x", pa.list_(pa.int64())), ("y", pa.list_(pa.int64()))]))
        pairs, often = set(), {}
        for b in nd._meet(20)(iter([table])):
            for kind, x, y in zip(*(c.to_pylist() for c in b.columns)):
                if kind == "pair":
                    pairs.add((x, y))
                elif kind == "often":
                    often.setdefault(x, set()).add(y)
        for sets in often.values():
            pairs |= {(min(a, b), max(a, b)) for a, b in combinations(sorted(sets), 2)}
        met[flush] = pairs, set(often)
    assert met[300][0] == met[1_000_000][0] and len(met[300][0]) == 150 * 149 // 2 and met[300][1] == met[1_000_000][1]
    assert near_duplicates(spans(spark, rows), Options(block=20)).span_pairs().count() == 150 * 149 // 2


def test_nulls_short_and_very_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(120_000))
    rows = [("t", "a", 1, long, None), ("t", "b", 1, None, long + " end"), ("t", "c", 1, None, None), ("t", "d", None, "", "x")]
    rows += [(None, "e", 1, " ".join("abcdefghijklmnopqrstuvwxyz"), " 1 2 3"), ("t", None, 1, None, None)]
    assert [tuple(r) for r in near_duplicates(spans(spark, rows)).span_pairs().collect()] == [("a", "b")]
    empty = near_duplicates(spans(spark, []))
    assert empty.span_pairs().count() == 0 and empty.groups().count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    errors = []
    for share in (0.2, 0.5, 0.8):
        for _ in range(30):
            n = 60
            common = int(round(2 * n * share / (1 + share)))
            pool = rng.integers(0, 2**63, 2 * n - common, dtype=np.int64).astype(np.uint64)
            a, b = pool[:n], pool[n - common :]
            elements, owner = distinct_by_text(np.concatenate([a, b]), np.repeat([0, 1], n))
            s = signatures(elements, owner, 2, 128)
            assert np.isfinite(s).all()
            errors.append(similarity(s[0], s[1]) - common / (2 * n - common))
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.045  # independent slots: 0.04 at a half
    one = signatures(np.array([7], np.uint64), np.array([0]), 2, 16)
    assert sorted(np.floor(one[0])) == list(range(16)) and np.isinf(one[1]).all()
    assert (band_keys(s, 4)[0] == band_keys(s, 4)[1]).sum() == (s.reshape(2, 32, 4)[0] == s.reshape(2, 32, 4)[1]).all(axis=1).sum()
