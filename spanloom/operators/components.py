"""Connected components of an edge table, without holding any of them in one task."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.arrow import arrow_schema, batch_of, rows_of
from spanloom.storage import store


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over a partition's edges: each node with the least node it is joined to."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (above := up.setdefault(root, root)) != root:
            root = above
        while x != root:
            up[x], x = root, up[x]
        return root

    for batch in batches:
        for a, b in rows_of(batch):
            a, b = find(a), find(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    schema = arrow_schema("a long, b long")
    nodes = list(up)
    for i in range(0, len(nodes), 50_000):
        yield batch_of([(x, r) for x in nodes[i : i + 50_000] if (r := find(x)) != x], schema)


def components(edges: DataFrame) -> DataFrame:
    """(``node``, ``component``): the least node of the component of each node of some edge.

    Input: ``a`` and ``b``, longs without nulls; loops and repeated edges do no harm. Union-find
    within partitions reduces the edges to forests; stars are then hooked to ever smaller nodes
    (alternately for larger and smaller neighbours) until nothing changes, which takes about as many
    rounds as the logarithm of the number of nodes. Minima are aggregated before they are shuffled.
    """
    now = store(edges.select("a", "b").where("a <> b").mapInArrow(_local_forest, "a long, b long").distinct(), "forest")
    while True:
        both = now.df.unionByName(now.df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = store(large, "large-star")
        smaller = large.df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = smaller.groupBy("a").agg(F.min("b").alias("m"))
        small = smaller.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        small = store(small.where("a <> b").distinct(), "small-star")
        same = now.df.count() == small.df.count() and now.df.exceptAll(small.df).isEmpty()
        now.drop()
        large.drop()
        now = small
        if same:
            break
    roots = now.df.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.df.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
