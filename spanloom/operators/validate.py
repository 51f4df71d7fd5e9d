"""Checks of spans and traces; bad traces are set aside with the reason, or refused."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.scalars import is_blank
from spanloom.operators.hierarchy import resolve_hierarchy
from spanloom.schema import KINDS
from spanloom.storage import store


def row_errors(spans: DataFrame) -> DataFrame:
    """(``trace_id``, ``span_id``, ``error``): each rule that a span breaks on its own."""
    checks = {
        "no node": F.col("agent_or_node_id").isNull(),
        "unknown kind": F.col("span_kind").isNull() | ~F.col("span_kind").isin(*KINDS),
        "no start": F.col("start_time").isNull(),
        "no end": F.col("end_time").isNull(),
        "end before start": F.col("end_time") < F.col("start_time"),
        "no input": F.col("input_text").isNull(),
        "blank output": is_blank(F.col("output_text")),
        "negative tokens": F.col("token_count") < 0,
        "negative rate": F.col("cost_rate") < 0,
    }
    found = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in checks.items())))
    return spans.select("trace_id", "span_id", F.explode(found).alias("error"))


def trace_errors(spans: DataFrame) -> DataFrame:
    """(``trace_id``, ``error``, ``n``): repeated span ids, roots other than one, orphans, circles.

    Parents are taken literally, as the record format does.
    """
    spans = store(spans.select("trace_id", "span_id", "parent_span_id", "start_time"), "parents").df
    sizes = spans.groupBy("trace_id").agg(F.count("*").alias("rows"), F.count_if(F.col("parent_span_id").isNull()).alias("roots"))
    repeated = spans.groupBy("trace_id", "span_id").count().where("count > 1").groupBy("trace_id").agg(F.count("*").cast("long").alias("n"))
    ids = spans.select("trace_id", F.col("span_id").alias("parent_span_id")).distinct()
    orphans = spans.where("parent_span_id IS NOT NULL").join(ids, ["trace_id", "parent_span_id"], "left_anti").groupBy("trace_id").agg(F.count("*").alias("n"))
    circles = resolve_hierarchy(spans).where("link_state LIKE '%cycle'").groupBy("trace_id").agg(F.count("*").alias("n"))
    parts = [
        repeated.select("trace_id", F.lit("repeated span id").alias("error"), "n"),
        sizes.where("roots <> 1").select("trace_id", F.when(F.col("roots") == 0, "no root").otherwise("several roots").alias("error"), F.col("roots").alias("n")),
        orphans.select("trace_id", F.lit("orphan").alias("error"), "n"),
        circles.select("trace_id", F.lit("circle").alias("error"), "n"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def document_errors(spans: DataFrame) -> DataFrame:
    """(``file``, ``error``, ``span_id``) of telemetry documents: several traces in one, roots other
    than one, and each span with a blank output. Spans of documents are given with their ``file``;
    one sent twice counts once."""
    sums = spans.groupBy("file").agg(F.countDistinct("trace_id").alias("traces"), F.countDistinct(F.when(F.col("parent_span_id").isNull(), F.coalesce("span_id", F.lit("")))).alias("roots"))
    roots = F.when(F.col("roots") == 0, F.lit("no root")).when(F.col("roots") > 1, F.lit("several roots"))
    whole = F.explode(F.array_compact(F.array(F.when(F.col("traces") > 1, F.lit("several traces")), roots)))
    blank = spans.where(is_blank(F.col("output_text"))).select("file", F.lit("blank output").alias("error"), "span_id").distinct()
    return sums.select("file", whole.alias("error"), F.lit(None).cast("string").alias("span_id")).unionByName(blank)


class InvalidTraces(ValueError):
    """Raised in strict mode, with some of the reasons."""


def validated(spans: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Spans of the traces without any error, and the others' ``trace_id``, ``span_id``, ``error``."""
    bad = row_errors(spans).unionByName(trace_errors(spans).select("trace_id", F.lit(None).cast("string").alias("span_id"), "error"))
    if strict:
        some = bad.limit(5).collect()
        if some:
            raise InvalidTraces("; ".join(f"{r.trace_id}: {r.error}" for r in some))
    return spans.join(bad.select("trace_id").distinct(), "trace_id", "left_anti"), bad
