"""Parent-child rows to full hierarchies: top, path, depth, descendants, cycles.

Method: contraction of partition-local parent chains. Rows are range-partitioned by trace and start
time; each task follows every parent chain as far as its partition goes and contracts it to the
chain's exit. Only traces that straddle a partition border leave open exits. These form a quotient
forest, much smaller than the input, which is solved the same way, recursively, until it fits one
task; its solution is then expanded over the fragments. Chains inside border traces are cut every
``depth_cut`` links, which bounds the arrays that a row carries and makes long chains shrink by that
factor per level. A quotient that doesn't shrink (parents far from their children in time) is solved
by pointer doubling.

Circles inside a partition are found by the local walk. A circle through several partitions shows up
as a circle of the quotient; its members are then made terminals and their traces solved once more.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.arrow import arrow_schema, batch_of, rows_of
from spanloom.operators.events import numbered
from spanloom.storage import store

_NODE = (
    "trace_id string, key string, id string, ord long, parent string, w long, low string, "
    "t_top string, t_links long, t_kind string, seg array<string>"
)
_LOCAL = (
    _NODE + ", border boolean, first boolean, exit string, dist long, lpath array<string>, plow string, "
    "top string, links long, kind string, path array<string>"
)
_ANSWER = ("trace_id", "key", "id", "top", "links", "kind", "path")


def normal_id(col: str) -> Column:
    """Ids compare without case and without a leading ``0x``."""
    return F.regexp_replace(F.lower(F.col(col)), "^0x", "")


def _walk(rows: list[tuple], border: bool, cut: int, with_path: bool) -> Iterator[tuple]:
    """Contracts the chains of one trace, as far as it lies in this partition.

    For each node: its exit, the links to it, the keys and the least id on the way, or, where the
    chain ends here, top, links and kind. ``border``: the trace may go on in another partition.
    """
    place: dict[str, int] = {}
    for i, r in enumerate(rows):
        place.setdefault(r[1], i)
    got: list[tuple | None] = [None] * len(rows)
    on_stack = [False] * len(rows)
    for start in range(len(rows)):
        if got[start] is not None:
            continue
        stack, at = [], start
        while True:
            on_stack[at] = True
            stack.append(at)
            _, key, own, _, parent, _, low, t_top, t_links, t_kind, seg = rows[at]
            if t_kind is not None:
                got[at] = (key, 0, (), low, t_top, t_links, t_kind, seg)
                break
            up = place.get(parent)
            if up is None:
                if border:
                    got[at] = (key, 0, (key,), low, None, None, None, [])
                else:
                    got[at] = (key, 0, (), low, own, 0, "orphan", [own])
                break
            if got[up] is not None:
                break
            if on_stack[up]:
                circle = stack[stack.index(up) :]
                least = min(rows[i][6] for i in circle)
                for i in circle:
                    got[i] = (rows[i][1], 0, (), least, least, 0, "cycle", [rows[i][2]])
                break
            at = up
        for i in reversed(stack):
            on_stack[i] = False
            if got[i] is not None:
                continue
            _, key, own, _, parent, w, low, *_, seg = rows[i]
            ex, dist, lpath, plow, top, links, kind, path = got[place[parent]]
            down = path + seg if with_path else None
            if kind is not None:
                got[i] = (key, 0, (), low, top, links + w, kind, down)
            elif len(lpath) > cut:
                got[i] = (key, 0, (key,), low, None, None, None, [])
            else:
                got[i] = (ex, dist + w, (key, *lpath), min(low, plow), None, None, None, down)
    for i, r in enumerate(rows):
        ex, dist, lpath, plow, top, links, kind, path = got[i]
        yield (*r, border, place[r[1]] == i, ex, dist, list(lpath), plow, top, links, kind, path if with_path else None)


def _contract(whole: bool, cut: int, with_path: bool):
    schema = arrow_schema(_LOCAL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trace, rows, seen, ready = None, [], 0, []
        for batch in batches:
            for r in rows_of(batch):
                if rows and r[0] != trace:
                    ready.extend(_walk(rows, not whole and seen == 0, cut, with_path))
                    seen, rows = seen + 1, []
                    if len(ready) >= 20_000:
                        yield batch_of(ready, schema)
                        ready = []
                trace = r[0]
                rows.append(r)
        if rows:
            ready.extend(_walk(rows, not whole, cut, with_path))
        if ready:
            yield batch_of(ready, schema)

    return run


def _double(nodes: DataFrame, count: int, with_path: bool) -> DataFrame:
    """Pointer doubling: after as many rounds as the depth has bits, every node knows its terminal.

    What then still points on is on a circle or below one. The nodes pointed at are the circles,
    and the least id seen on the way is that of the whole circle.
    """
    state = nodes
    for _ in range(math.ceil(math.log2(max(2, count))) + 1):
        if state.where("t_kind IS NULL").isEmpty():
            break
        up = state.select(
            "trace_id",
            F.col("key").alias("parent"),
            F.col("parent").alias("p2"),
            F.col("w").alias("w2"),
            F.col("low").alias("low2"),
            F.col("t_top").alias("t_top2"),
            F.col("t_links").alias("t_links2"),
            F.col("t_kind").alias("t_kind2"),
            F.col("seg").alias("seg2"),
        )
        open_ = F.col("t_kind").isNull()
        # circles make the arrays of a path meaningless; it is settled by the second pass
        grown = F.when(open_ & (F.size("seg") <= count), F.concat("seg2", "seg")).otherwise(F.col("seg"))
        state = store(
            state.join(up, ["trace_id", "parent"], "left").select(
                "trace_id",
                "key",
                "id",
                "ord",
                F.when(open_, F.col("p2")).alias("parent"),
                F.when(open_, F.col("w") + F.col("w2")).otherwise(F.col("w")).alias("w"),
                F.least("low", "low2").alias("low"),
                F.coalesce("t_top", "t_top2").alias("t_top"),
                F.coalesce("t_links", F.col("t_links2") + F.col("w")).alias("t_links"),
                F.coalesce("t_kind", "t_kind2").alias("t_kind"),
                (grown if with_path else F.col("seg")).alias("seg"),
            ),
            "doubling",
        ).df
    turning = state.where("t_kind IS NULL").select("trace_id", F.col("parent").alias("key")).distinct()
    on_circle = F.col("circular") & F.col("t_kind").isNull()
    return state.join(turning.withColumn("circular", F.lit(True)), ["trace_id", "key"], "left").select(
        "trace_id",
        "key",
        "id",
        F.coalesce("t_top", "low").alias("top"),
        F.when(on_circle, F.lit(0)).otherwise(F.coalesce("t_links", F.lit(1))).cast("long").alias("links"),
        F.coalesce("t_kind", F.lit("cycle")).alias("kind"),
        F.when(F.col("t_kind").isNotNull(), F.col("seg")).alias("path"),
    )


def _solve(nodes: DataFrame, count: int | None, opts: tuple[int, int, bool], partitions: int | None) -> DataFrame:
    """Top, links, kind and path of every node; ``count`` where it is known."""
    row_limit, cut, with_path = opts
    keys = ("trace_id", "ord", "key")
    whole = count is not None and count <= row_limit
    if whole:
        placed = nodes.coalesce(1)
    else:
        placed = nodes.repartitionByRange(*([partitions] if partitions else []), *keys)
    local = placed.sortWithinPartitions(*keys).mapInArrow(_contract(whole, cut, with_path), _LOCAL)
    if whole:
        return local.select(*_ANSWER)

    kept = store(local, "fragments").df
    done = kept.where("kind IS NOT NULL").select(*_ANSWER)
    exits = kept.where("kind IS NULL AND key = exit")
    open_count = exits.count()
    if not open_count:
        return done

    up = kept.where("border AND first").select(
        "trace_id",
        F.col("key").alias("parent"),
        F.col("exit").alias("x"),
        F.col("dist").alias("x_dist"),
        F.col("lpath").alias("between"),
        F.col("plow").alias("x_low"),
        F.col("top").alias("x_top"),
        F.col("links").alias("x_links"),
        F.col("kind").alias("x_kind"),
        F.col("path").alias("x_path"),
    )
    lost, settled = F.col("x").isNull(), F.col("x_kind").isNotNull()
    ends = lost | settled
    quotient = store(
        exits.drop("exit", "dist", "lpath", "plow", "top", "links", "kind", "path", "border", "first")
        .join(up, ["trace_id", "parent"], "left")
        .select(
            "trace_id",
            "key",
            "id",
            "ord",
            F.when(~ends, F.col("x")).alias("parent"),
            (F.col("w") + F.coalesce("x_dist", F.lit(0))).alias("w"),
            F.when(ends, F.col("low")).otherwise(F.least("low", "x_low")).alias("low"),
            F.when(lost, F.col("id")).when(settled, F.col("x_top")).alias("t_top"),
            F.when(lost, F.lit(0)).when(settled, F.col("x_links") + F.col("w")).cast("long").alias("t_links"),
            F.when(lost, F.lit("orphan")).when(settled, F.col("x_kind")).alias("t_kind"),
            F.when(lost, F.col("seg")).otherwise(F.concat("x_path", "seg")).alias("seg"),
            F.coalesce("between", F.array().cast("array<string>")).alias("between"),
        ),
        "quotient",
    ).df
    inner = quotient.drop("between")
    if open_count > row_limit and open_count > 0.7 * kept.where("border").count():
        solved = _double(inner, open_count, with_path)
    else:
        solved = _solve(inner, open_count, opts, max(2, math.ceil(open_count / row_limit)))
    solved = store(solved, "solved").df

    circle = (
        solved.where("kind = 'cycle' AND links = 0")
        .join(quotient.select("trace_id", "key", "between"), ["trace_id", "key"])
        .select("trace_id", F.explode(F.concat(F.array("key"), "between")).alias("key"), F.col("top").alias("c_top"))
        .distinct()
    )
    expanded = (
        kept.where("kind IS NULL")
        .select("trace_id", "key", "id", "exit", "dist", F.col("path").alias("tail"))
        .join(
            solved.select("trace_id", F.col("key").alias("exit"), "top", "links", "kind", F.col("path").alias("head")),
            ["trace_id", "exit"],
        )
        .select(
            "trace_id",
            "key",
            "id",
            "top",
            (F.col("links") + F.col("dist")).alias("links"),
            "kind",
            F.concat("head", "tail").alias("path"),
        )
    )
    circle = store(circle, "circles").df
    if circle.isEmpty():
        return done.unionByName(expanded)
    hit = circle.select("trace_id").distinct()
    turns = F.col("c_top").isNotNull()
    marked = (
        kept.join(hit, "trace_id", "left_semi")
        .join(circle, ["trace_id", "key"], "left")
        .select(
            "trace_id",
            "key",
            "id",
            "ord",
            F.when(~turns, F.col("parent")).alias("parent"),
            "w",
            "low",
            F.coalesce("c_top", "t_top").alias("t_top"),
            F.when(turns, F.lit(0).cast("long")).otherwise(F.col("t_links")).alias("t_links"),
            F.when(turns, F.lit("cycle")).otherwise(F.col("t_kind")).alias("t_kind"),
            F.when(turns, F.array("id")).otherwise(F.col("seg")).alias("seg"),
        )
    )
    again = _solve(store(marked, "marked").df, None, opts, partitions)
    return done.unionByName(expanded).join(hit, "trace_id", "left_anti").unionByName(again)


def resolve_hierarchy(
    rows: DataFrame,
    *,
    group: str = "trace_id",
    node: str = "span_id",
    parent: str = "parent_span_id",
    order: str = "start_time",
    with_path: bool = False,
    row_limit: int = 200_000,
    depth_cut: int = 64,
    partitions: int | None = None,
) -> DataFrame:
    """Each node's top, links to it, the state of its chain and, ``with_path``, the ids on it.

    Input: one row per (group, node); ``order`` (a timestamp) only serves locality. Output:
    ``trace_id``, ``span_id``, ``top_span_id``, ``n_links``, ``link_state`` (``root``,
    ``under_root``, ``orphan``, ``under_orphan``, ``cycle``, ``under_cycle``), ``path`` (from the
    top, or the first node on the circle, to the node; null unless asked for).

    Null or empty parents mean no parent; a null group is a group of its own. A node with a null
    id has a chain, but is nobody's parent. Of ids repeated in a group (or equal but for case and
    ``0x``) each row is resolved and the first in order is the parent. ``row_limit``: rows that one
    task may solve alone; larger quotients are solved by recursion. Empty tables give no rows; other
    columns are ignored.
    """
    own = F.coalesce(F.col(node), F.lit(""))
    has = F.col(parent).isNotNull() & (F.col(parent) != "")
    nodes = rows.select(
        F.coalesce(F.col(group), F.lit("\0")).alias("trace_id"),
        # a null id gets a key that no parent id can be
        F.when(F.col(node).isNull(), F.lit("\0")).otherwise(normal_id(node)).alias("key"),
        own.alias("id"),
        F.coalesce(F.unix_micros(F.col(order).cast("timestamp")), F.lit(0)).alias("ord"),
        F.when(has, normal_id(parent)).alias("parent"),
        F.lit(1).cast("long").alias("w"),
        own.alias("low"),
        F.when(~has, own).alias("t_top"),
        F.when(~has, F.lit(0)).cast("long").alias("t_links"),
        F.when(~has, F.lit("root")).alias("t_kind"),
        (F.array(own) if with_path else F.lit(None).cast("array<string>")).alias("seg"),
    )
    solved = _solve(nodes, None, (row_limit, depth_cut, with_path), partitions)
    return solved.select(
        F.nullif("trace_id", F.lit("\0")).alias("trace_id"),
        F.col("id").alias("span_id"),
        F.col("top").alias("top_span_id"),
        F.col("links").alias("n_links"),
        F.when(F.col("links") == 0, F.col("kind")).otherwise(F.concat(F.lit("under_"), "kind")).alias("link_state"),
        "path",
    )


def descendants(resolved: DataFrame) -> DataFrame:
    """(``trace_id``, ``span_id``, ``descendant_id``, ``n_links``) of every pair on a path."""
    steps = resolved.select("trace_id", F.col("span_id").alias("descendant_id"), F.size("path").alias("n"), F.posexplode("path"))
    return steps.where("pos < n - 1").select(
        "trace_id", F.col("col").alias("span_id"), "descendant_id", (F.col("n") - 1 - F.col("pos")).cast("long").alias("n_links")
    )


def linked_cases(resolved: DataFrame, deep: int = 8) -> DataFrame:
    """The chains worth a look: deep ones, and all that don't end at a root."""
    state = F.when(F.col("link_state") == "under_root", F.lit("deep")).otherwise(F.col("link_state"))
    return resolved.where((F.col("link_state") != "root") & ((F.col("link_state") != "under_root") | (F.col("n_links") >= deep))).select(
        "trace_id", "span_id", "top_span_id", "n_links", state.alias("link_state")
    )


def tree_edges(spans: DataFrame) -> DataFrame:
    """(``trace_id``, ``parent_span_id``, ``span_id``, ``sibling_rank``): children in order of time.

    Roots are ranked among themselves. Spans without a start come nowhere in that order and are left
    out. A parent with any number of children is numbered in pieces, like a trace.
    """
    family = F.concat_ws("\0", "trace_id", F.coalesce("parent_span_id", F.lit("")))
    rows = spans.select(family.alias("trace_id"), "span_id", "start_time", "pos", F.col("trace_id").alias("__trace"), "parent_span_id")
    return numbered(rows).select(F.col("__trace").alias("trace_id"), "parent_span_id", "span_id", F.col("seq").alias("sibling_rank"))


def topology(spans: DataFrame) -> DataFrame:
    """(``trace_id``, ``seq``, ``node``, ``kind``, ``parent_node``): a trace's shape, step by step.

    Two traces have the same shape if these rows are the same. Without a parent in the trace
    ``parent_node`` is ``<root>``.
    """
    parents = spans.select("trace_id", F.col("span_id").alias("parent_span_id"), F.col("agent_or_node_id").alias("parent_node"))
    placed = numbered(spans.select("trace_id", "span_id", "parent_span_id", "agent_or_node_id", "span_kind", "start_time", "pos"))
    return placed.join(parents, ["trace_id", "parent_span_id"], "left").select(
        "trace_id",
        "seq",
        F.col("agent_or_node_id").alias("node"),
        F.col("span_kind").alias("kind"),
        F.coalesce("parent_node", F.lit("<root>")).alias("parent_node"),
    )
