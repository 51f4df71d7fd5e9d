"""Frequent subsequences across many sequences, with gaps, by closed pattern mining.

Method: bidirectional extension checks and backscan pruning over pseudo-projections, partitioned by
first item. The sequences that hold an item form its class; classes are written once, range
partitioned by (first item, sequence), so that a class of any size spreads over many tasks and a
pass reads the classes it works on only. Patterns grow from their first item. In each pass a task
walks its part of a class through the trie of the class's live prefixes, where a projection is but
the end positions of the leftmost embedding, and emits partial counts: the support of each forward
extension, and the items common to all its sequences in each maximum and semi-maximum period of a
prefix. Their sums tell which prefixes are closed (no extension of equal support in any place) and
which can't lead to closed patterns any more. A pass carries at most ``max_live`` prefixes, those
grown last come first, and closed patterns are written as they are found; so what the driver holds
is bounded by ``max_live`` times the length and the number of frequent items, however many patterns
there are.

The patterns that aren't closed are recovered with their exact supports: each is a subsequence of
a closed one, and its support is the greatest of theirs.

No sequence is ever held whole. A trace is cut at partition borders, and each piece is reduced to a
short sequence with the same subsequences up to the wanted length (plus one for the closure check);
reductions of pieces can be joined and reduced again. Equal sequences are counted once, with weight.
If a frequent pattern turns out as long as the reductions go, they are made anew for longer patterns,
so that the closed patterns are exact at any length.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.arrow import arrow_schema, batch_of, rows_of
from spanloom.operators.events import in_event_order
from spanloom.storage import store

_PIECE = "trace_id string, us long, pos long, span_id string, items array<int>, border boolean"
_COUNT = "kind string, prefix int, place int, item int, n long"


def shorten(items: list[int], k: int) -> list[int]:
    """A subsequence that contains the same sequences of up to ``k`` items.

    An item is kept if the fewest jumps to it from the left and from the right, each to the next
    occurrence of some item, sum to at most ``k + 1``.
    """

    def jumps(order: Iterator[int], left: list[int] | None) -> list[int]:
        least: dict[int, int] = {}  # by item: fewest jumps to any place since its last occurrence
        out = [0] * len(items)
        for p in order:
            a = items[p]
            x = 1 + least.get(a, 0)
            if left is not None and left[p] + x > k + 1:
                continue
            out[p] = x
            for b, m in least.items():
                if x < m:
                    least[b] = x
            least[a] = x
        return out

    n = len(items)
    left = jumps(iter(range(n)), None)
    right = jumps(iter(range(n - 1, -1, -1)), left)
    return [items[p] for p in range(n) if right[p]]


def _sequences(codes: dict[str, int], k: int):
    """Streams ordered events into pieces of traces; only border pieces need joining."""
    schema = arrow_schema(_PIECE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, items, first, ready, most = None, [], True, [], 8192
        for batch in batches:
            for trace, span, name, us, pos in rows_of(batch):
                if head is None or trace != head[0]:
                    if head is not None:
                        if items or first:
                            ready.append((*head, shorten(items, k) if len(items) > 32 else items, first))
                        first = False
                    head, items, most = (trace, us, pos, span), [], 8192
                items.append(codes[name])
                if len(items) >= most:
                    items = shorten(items, k)
                    most = max(8192, 2 * len(items))
            if len(ready) >= 10_000:
                yield batch_of(ready, schema)
                ready = []
        if head is not None:
            ready.append((*head, shorten(items, k) if len(items) > 32 else items, True))
        if ready:
            yield batch_of(ready, schema)

    return run


def _shorten_column(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema("items array<int>")
        for batch in batches:
            yield batch_of([(shorten(x, k),) for (x,) in rows_of(batch)], schema)

    return run


def _trie(prefixes: list[tuple[int, ...]]) -> dict:
    root: dict = {}
    for pid, p in enumerate(prefixes):
        node = root
        for x in p:
            node = node.setdefault(x, {})
        node[-1] = pid
    return root


def _count(prefixes: list[tuple[int, ...]]):
    """Partial counts of a part of the classes for the prefixes, all of one length."""
    schema = arrow_schema(_COUNT)
    length = len(prefixes[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = _trie(prefixes)
        forward: dict[tuple[int, int], int] = defaultdict(int)
        weight: dict[int, int] = defaultdict(int)
        common: dict[tuple[str, int, int], set[int]] = {}

        def periods(kind: str, pid: int, ends: list[int], limits: list[int], items: list[int]) -> None:
            for i in range(length):
                key = (kind, pid, i)
                now = common.get(key)
                if now is not None and not now:
                    continue
                here = items[(ends[i - 1] + 1 if i else 0) : limits[i]]
                common[key] = set(here) if now is None else now.intersection(here)

        for batch in batches:
            for first, items, w in rows_of(batch):
                if first not in root:
                    continue
                where: dict[int, list[int]] = defaultdict(list)
                for p, x in enumerate(items):
                    where[x].append(p)

                def leaf(pid: int, prefix_ends: list[int]) -> None:
                    prefix, end = prefixes[pid], prefix_ends[-1]
                    weight[pid] += w
                    for x, places in where.items():
                        if places[-1] > end:
                            forward[pid, x] += w
                    # the latest places: in the whole sequence, and up to the first embedding's end
                    for kind, last in (("m", where[prefix[-1]][-1]), ("s", end)):
                        limits = [0] * length
                        limits[-1] = at = last
                        for i in range(length - 2, -1, -1):
                            places = where[prefix[i]]
                            limits[i] = at = places[bisect_left(places, at) - 1]
                        periods(kind, pid, prefix_ends, limits, items)

                stack = [(root[first], [where[first][0]])]
                while stack:
                    node, ends = stack.pop()
                    after = ends[-1]
                    for x, below in node.items():
                        if x == -1:
                            leaf(below, ends)
                        elif x in where:
                            places = where[x]
                            i = bisect_right(places, after)
                            if i < len(places):
                                stack.append((below, [*ends, places[i]]))
        out = [("f", pid, 0, x, n) for (pid, x), n in forward.items()]
        out += [(kind, pid, i, x, weight[pid]) for (kind, pid, i), xs in common.items() for x in xs]
        yield batch_of(out, schema)

    return run


_FOUND = "items array<int>, support long"
_WRITE = 50_000  # closed patterns that the driver holds before it writes them


def mine_closed(sequences: DataFrame, items: list[tuple[int, int]], min_support: int, max_live: int = 20_000, below: int | None = None) -> DataFrame | None:
    """All closed patterns: ``items`` and ``support``; None as soon as a frequent one has ``below`` items.

    ``sequences``: ``items`` (array of int) and ``n`` (weight), written. ``items``: the frequent
    items with their supports.
    """
    spark = sequences.sparkSession
    firsts = F.explode(F.array_distinct("items")).alias("first")
    classes = store(sequences.select(firsts, "items", "n").repartitionByRange("first", "items").sortWithinPartitions("first"), "classes")
    slices = lambda live: [live[at : at + max_live] for at in range(0, len(live), max_live)][::-1]
    todo = slices([((x,), n) for x, n in sorted(items)])  # the last is worked off first
    closed: list[tuple[list[int], int]] = []
    written: list[DataFrame] = []

    def write() -> None:
        written.append(store(spark.createDataFrame(closed, _FOUND), "closed").df)
        closed.clear()

    while todo:
        part = todo.pop()
        if below is not None and len(part[0][0]) >= below:
            classes.drop()
            return None
        prefixes = [p for p, _ in part]
        sums = (
            classes.df.where(F.col("first").isin(sorted({p[0] for p in prefixes})))
            .select("first", "items", "n")
            .mapInArrow(_count(prefixes), _COUNT)
            .groupBy("kind", "prefix", "place", "item")
            .agg(F.sum("n").alias("n"))
            .where(F.col("n") >= min_support)
            .collect()
        )
        extended, doomed, forward = set(), set(), defaultdict(list)
        for kind, pid, _, item, n in sums:
            if kind == "f":
                forward[pid].append((item, n))
            if n == part[pid][1]:
                (doomed if kind == "s" else extended).add(pid)
        grown: list[tuple[tuple[int, ...], int]] = []
        for pid, (p, n) in enumerate(part):
            if pid not in extended:
                closed.append((list(p), n))
            if pid not in doomed:
                grown += [((*p, x), m) for x, m in sorted(forward[pid])]
        todo += slices(grown)
        if len(closed) >= _WRITE:
            write()
    write()
    classes.drop()
    found = written[0]
    for df in written[1:]:
        found = found.unionByName(df)
    return found


def _distinct_subsequences(items: list[int], max_len: int) -> Iterator[list[tuple[int, ...]]]:
    """The distinct subsequences of 1, 2, ... items."""
    level: dict[tuple[int, ...], int] = {(): 0}  # with the place after the first embedding
    for _ in range(min(max_len, len(items))):
        grown: dict[tuple[int, ...], int] = {}
        for p, at in level.items():
            for i in range(at, len(items)):
                grown.setdefault((*p, items[i]), i + 1)
        yield list(grown)
        level = grown


def _recover(min_len: int, max_len: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema("items array<int>, support long")
        for batch in batches:
            for items, support in rows_of(batch):
                for length, found in enumerate(_distinct_subsequences(items, max_len), 1):
                    if length >= min_len:
                        yield batch_of([(list(c), support) for c in found], schema)

    return run


def frequent_subsequences(
    events: DataFrame,
    *,
    n_sequences: int,
    min_support: int = 6,
    min_share: str = "0.06",
    min_len: int = 3,
    max_len: int = 5,
    longer: bool = True,
    max_live: int = 20_000,
) -> tuple[DataFrame, DataFrame]:
    """All patterns of ``min_len`` to ``max_len`` names, and the closed ones, with their supports.

    Input: ``trace_id``, ``span_id``, ``name``, ``start_time``, ``pos``; other columns are ignored.
    Events with a null trace, name or start are left out. Ties go by ``pos``, then ``span_id``.
    Support is counted once a trace, and must reach ``min_support`` and ``min_share`` of
    ``n_sequences``. Both results have ``steps`` (names joined by ``>``), ``length`` and
    ``support``; they are empty where nothing is frequent. The closed ones are of any length; without
    ``longer`` those of up to ``max_len`` names, which saves mining the rest.
    """
    least = max(min_support, 1, -(-Fraction(min_share) * n_sequences // 1))
    named = events.select("trace_id", "span_id", "name", "start_time", "pos").where("trace_id IS NOT NULL AND name IS NOT NULL AND start_time IS NOT NULL")
    frequent = named.select("trace_id", "name").distinct().groupBy("name").count().where(F.col("count") >= int(least)).collect()
    names = sorted(r["name"] for r in frequent)
    codes = {x: i for i, x in enumerate(names)}
    supports = [(codes[r["name"]], r["count"]) for r in frequent]

    kept = named.where(F.col("name").isin(names)) if names else named.where("false")
    ordered = in_event_order(kept).select("trace_id", "span_id", "name", F.unix_micros("start_time").alias("us"), F.col("pos").cast("long"))

    def mined(k: int, below: int | None) -> DataFrame | None:
        """Exact for closed patterns of fewer than ``k`` items."""
        pieces = store(ordered.mapInArrow(_sequences(codes, k), _PIECE), "pieces")
        joined = (
            pieces.df.where("border")
            .groupBy("trace_id")
            .agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("us", "pos", "span_id", "items"))), lambda p: p["items"])).alias("items"))
            .select("items")
            .mapInArrow(_shorten_column(k), "items array<int>")
        )
        sequences = store(pieces.df.where("NOT border").select("items").unionByName(joined).groupBy("items").agg(F.count("*").alias("n")), "sequences")
        closed = mine_closed(sequences.df, supports, int(least), max_live, below)
        sequences.drop()
        pieces.drop()
        return closed

    k = max_len + 1
    closed = None if longer else mined(k, None)
    while closed is None:
        k *= 2
        closed = mined(k, k)

    exact = closed if longer else closed.where(F.size("items") <= max_len)
    table = F.array(*(F.lit(x) for x in names)) if names else F.array().cast("array<string>")
    shown = lambda df: df.select(
        F.array_join(F.transform("items", lambda i: F.element_at(table, i + 1)), ">").alias("steps"), F.size("items").alias("length"), "support"
    )
    every = closed.mapInArrow(_recover(min_len, max_len), "items array<int>, support long").groupBy("items").agg(F.max("support").alias("support"))
    return shown(every), shown(exact)
