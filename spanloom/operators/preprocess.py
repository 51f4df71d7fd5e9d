"""Folding of model calls into their nodes, and removal of mere routers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.arrow import arrow_schema, batch_of, rows_of
from spanloom.functions.scalars import longest_leaf
from spanloom.storage import store


_EDGE = "trace_id string, span_id string, parent_span_id string, span_kind string"
_LOCAL = f"open boolean, {_EDGE}"
ROW_LIMIT = 200_000  # spans of traces over partition borders that one task may settle


def _local_workers(whole: bool):
    """Workers of the traces that lie in one partition; all spans of those that may not."""
    schema = arrow_schema(_LOCAL)

    def of_trace(rows: list[tuple]) -> Iterator[tuple]:
        parents: dict[str, list[str]] = {}
        for _, span, parent, _ in rows:
            if span is not None:
                parents.setdefault(span, [])
                if parent is not None:
                    parents[span].append(parent)
        todo = [p for _, _, p, kind in rows if kind in ("llm", "tool") and p is not None]
        seen: set[str] = set()
        while todo:
            p = todo.pop()
            if p in parents and p not in seen:
                seen.add(p)
                todo += parents[p]
        return ((False, rows[0][0], x, None, None) for x in seen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        first, ready = True, []

        def close(last: bool) -> None:
            nonlocal first
            if rows:
                ready.extend([(True, *r) for r in rows] if not whole and (first or last) else of_trace(rows))
                rows.clear()
                first = False

        for batch in batches:
            for r in rows_of(batch):
                if rows and r[0] != rows[0][0]:
                    close(False)
                rows.append(r)
            if len(ready) >= 20_000:
                yield batch_of(ready, schema)
                ready.clear()
        close(True)
        if ready:
            yield batch_of(ready, schema)

    return run


def _climbed(spans: DataFrame) -> DataFrame:
    """The same for traces of any size: each round adds what lies above the workers that were new in
    the last one, twice as far as the round before, so it ends after about the logarithm of the depth."""
    key = ["trace_id", "span_id"]
    ids = spans.select(*key).where("span_id IS NOT NULL").distinct()
    parents = spans.where("parent_span_id IS NOT NULL").select("trace_id", F.col("span_id").alias("from"), F.col("parent_span_id").alias("span_id"), "span_kind")
    edges = store(parents.join(ids, key, "left_semi"), "edges").df
    jumps = edges.select("trace_id", "from", F.col("span_id").alias("to"))
    seen = store(edges.where("span_kind IN ('llm', 'tool')").select(*key).distinct(), "workers")
    while True:
        above = jumps.join(seen.df.withColumnRenamed("span_id", "from"), ["trace_id", "from"]).select("trace_id", F.col("to").alias("span_id")).distinct()
        fresh = store(above.join(seen.df, key, "left_anti"), "workers-new")
        if fresh.df.isEmpty():
            return seen.df
        grown = store(seen.df.unionByName(fresh.df), "workers")
        fresh.drop()
        seen.drop()
        seen = grown
        onward = jumps.select("trace_id", F.col("from").alias("to"), F.col("to").alias("further"))
        jumps = store(jumps.join(onward, ["trace_id", "to"]).select("trace_id", "from", F.col("further").alias("to")), "jumps").df


def worker_spans(spans: DataFrame) -> DataFrame:
    """(``trace_id``, ``span_id``) of the spans with an llm or tool span below them, at any depth.

    Spans are range-partitioned by trace, and traces that lie in one partition are settled there by
    climbing from the parents of llm and tool spans. What is left are at most two traces for each
    border; one task settles them if they are few, else they are climbed by joins. Parents are taken
    literally, circles do no harm. Rows without a trace don't count.
    """
    rows = spans.where("trace_id IS NOT NULL").select("trace_id", "span_id", "parent_span_id", "span_kind")
    placed = rows.repartitionByRange("trace_id", "span_id").sortWithinPartitions("trace_id")
    local = store(placed.mapInArrow(_local_workers(False), _LOCAL), "local-workers").df
    done = local.where("NOT open").select("trace_id", "span_id")
    rest = local.where("open").drop("open")
    if rest.count() <= ROW_LIMIT:
        more = rest.coalesce(1).sortWithinPartitions("trace_id").mapInArrow(_local_workers(True), _LOCAL).select("trace_id", "span_id")
    else:
        more = _climbed(rest)
    return done.unionByName(more)


def collapse_llm(spans: DataFrame) -> DataFrame:
    """Without llm spans: their tokens go to their parents, their children one step up.

    Only tokens move, not rates. A parent that is itself an llm span vanishes with what it got, and
    children two steps below the last kept span point to a span that is gone.
    """
    llm = spans.where("span_kind = 'llm'")
    extra = llm.where("parent_span_id IS NOT NULL AND token_count IS NOT NULL").groupBy("trace_id", F.col("parent_span_id").alias("span_id")).agg(F.sum("token_count").alias("__extra"))
    gone = llm.select("trace_id", F.col("span_id").alias("parent_span_id"), F.col("parent_span_id").alias("__grand"), F.lit(True).alias("__gone"))
    kept = spans.where("span_kind IS NULL OR span_kind <> 'llm'").join(extra, ["trace_id", "span_id"], "left").join(gone, ["trace_id", "parent_span_id"], "left")
    new = {
        "token_count": F.when(F.col("__extra").isNotNull(), F.coalesce("token_count", F.lit(0)) + F.col("__extra")).otherwise(F.col("token_count")),
        "parent_span_id": F.when(F.col("__gone"), F.col("__grand")).otherwise(F.col("parent_span_id")),
    }
    return kept.withColumns(new).select(*spans.columns)


def filter_routers(spans: DataFrame, workers: DataFrame) -> DataFrame:
    """Without chain and agent spans, roots excepted, that have no llm or tool span below them."""
    marked = spans.join(workers.select("trace_id", "span_id").withColumn("__worker", F.lit(True)), ["trace_id", "span_id"], "left")
    router = F.col("span_kind").isin("chain", "agent") & F.col("parent_span_id").isNotNull() & F.col("__worker").isNull()
    return marked.where(~F.coalesce(router, F.lit(False))).select(*spans.columns)


def preprocess(spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The four stages in order, and per trace the number of spans each of the last two removed.

    Expects one row per span (see ``current_spans``).
    """
    plain = spans.withColumn("output_text", longest_leaf(F.col("output_text")))
    workers = worker_spans(plain)  # of the tree before any span is gone
    collapsed = collapse_llm(plain)
    kept = filter_routers(collapsed, workers)
    counts = (
        plain.groupBy("trace_id")
        .agg(F.count_if(F.col("span_kind") == "llm").alias("collapsed_llm_spans"), F.count("*").alias("n"))
        .join(kept.groupBy("trace_id").agg(F.count("*").alias("left")), "trace_id", "left")
        .select("trace_id", "collapsed_llm_spans", (F.col("n") - F.col("collapsed_llm_spans") - F.coalesce("left", F.lit(0))).alias("filtered_router_spans"))
    )
    return kept, counts
