import random

from spanloom.functions.bloom import build_bloom
from spanloom.operators.components import components


def brute(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(up)}


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(-60, 60)]  # a long chain
    edges += [(1000, 1001 + i) for i in range(300)]  # a star
    edges += [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(250)]
    edges = [(a, b) for a, b in edges if a != b]
    rng.shuffle(edges)
    df = spark.createDataFrame([(b, a, "clash") if rng.random() < 0.5 else (a, b, "clash") for a, b in edges], "a long, b long, component string")
    got = components(df.repartition(5)).collect()
    assert len(got) == len({r.node for r in got})
    assert {r.node: r.component for r in got} == brute(edges)
    assert components(df.where("false")).count() == 0
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_bloom_misses_no_member(spark):
    df = spark.range(1000).selectExpr("xxhash64(id) AS k")
    bloom = build_bloom(df, 1000)
    import numpy as np

    members = np.array([r.k for r in df.collect()], np.int64).view(np.uint64)
    assert bloom.might_hold(members).all()
    others = np.arange(100_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert bloom.might_hold(others).mean() < 0.05
    assert not build_bloom(df.where("false"), 0).might_hold(members).any()
