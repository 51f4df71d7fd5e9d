"""From candidates to waste: similarity of outputs, wasted spans, verdicts, details."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.vectors import Embedder, HashEmbedder, cosine
from spanloom.operators.events import numbered
from spanloom.operators.structural import candidate_pairs
from spanloom.schema import PHI, N


def scored_pairs(pairs: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    """Adds ``cosine`` of the two outputs. Structure comes first, so only candidates are embedded.

    The embedder must be the one that the pairs were found for.
    """
    embedder = embedder or HashEmbedder()
    texts = pairs.withColumns({"__a": F.col("o.out"), "__b": F.col("c.out")})
    both = embedder.vectors_of_carried(embedder.vectors_of_carried(texts, "__a", "__va"), "__b", "__vb")
    return both.withColumn("cosine", cosine(F.col("__va"), F.col("__vb"))).drop("__a", "__b", "__va", "__vb")


def waste_details(scored: DataFrame, phi: float = PHI) -> DataFrame:
    """One row per wasted span, with its most similar origin, of equals the earliest.

    ``ord`` is that of the first accepted pair of the span, which orders the report.
    """
    hit = scored.where(F.col("cosine") >= phi)
    by = hit.groupBy("trace_id", F.col("c.span_id").alias("candidate_id")).agg(
        F.min_by(F.struct("o", "c", "cosine", "rule"), F.struct((-F.col("cosine")).alias("s"), "ord")).alias("b"), F.min("ord").alias("ord")
    )
    return by.select(
        "trace_id",
        "candidate_id",
        F.col("b.o.span_id").alias("origin_id"),
        F.col("b.o.agent_or_node_id").alias("origin_node"),
        F.col("b.c.agent_or_node_id").alias("repeat_node"),
        F.col("b.rule").alias("rule"),
        F.col("b.cosine").alias("cosine"),
        F.col("b.c.token_count").alias("waste_tokens"),
        (F.col("b.c.token_count") * F.col("b.c.cost_rate")).alias("waste_cost"),
        F.col("b.c.snippet").alias("snippet"),
        F.col("b.c.cost_rate").alias("cost_rate"),
        "ord",
    )


def verdicts(spans: DataFrame, details: DataFrame) -> DataFrame:
    """A row for every trace: wasteful or not, number of wasted spans, their tokens and cost.

    Unknown counts and rates add nothing to the totals.
    """
    cost = F.coalesce("waste_tokens", F.lit(0)) * F.coalesce("cost_rate", F.lit(0.0))
    sums = details.groupBy("trace_id").agg(
        F.count("*").alias("n"), F.sum(F.coalesce("waste_tokens", F.lit(0))).alias("t"), F.sum(cost).alias("c")
    )
    return (
        spans.select("trace_id")
        .where("trace_id IS NOT NULL")
        .distinct()
        .join(sums, "trace_id", "left")
        .select(
            "trace_id",
            F.col("n").isNotNull().alias("wasteful"),
            F.coalesce("n", F.lit(0)).alias("waste_spans"),
            F.coalesce("t", F.lit(0)).alias("waste_tokens"),
            F.coalesce("c", F.lit(0.0)).alias("waste_cost"),
        )
    )


def waste_spans(details: DataFrame) -> DataFrame:
    """(``trace_id``, ``candidate_id``, ``seq``): the wasted spans of a trace in report order.

    A trace with any number of wasted spans is numbered in pieces.
    """
    rank, x, y = F.col("ord.r"), F.col("ord.x"), F.col("ord.y")
    rows = details.select("trace_id", F.struct(rank, x, y).alias("start_time"), F.lit(0).alias("pos"), F.col("candidate_id").alias("span_id"))
    return numbered(rows).select("trace_id", F.col("span_id").alias("candidate_id"), "seq")


def detect(spans: DataFrame, embedder: Embedder | None = None, n: int = N, phi: float = PHI) -> tuple[DataFrame, DataFrame]:
    """Verdicts and details of all traces."""
    details = waste_details(scored_pairs(candidate_pairs(spans, n, embedder), embedder), phi)
    return verdicts(spans, details), details
