"""Current spans of a delivery log, and their order within a trace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.storage import store

#: Order of a trace's events; the id makes ties between equal rows definite.
EVENT_ORDER = ("start_time", "pos", "span_id")


def current_spans(spans: DataFrame, *keep: str, **computed: Column) -> DataFrame:
    """One row per (``trace_id``, ``span_id``): the one with the latest ``ingested_at``.

    ``keep`` names the columns wanted besides the two ids (all others of the input, clashing names
    included, are dropped before the shuffle); ``computed`` adds columns calculated before it.
    A null ``ingested_at`` counts as the earliest. Rows with a null id are kept and grouped like any
    value. Among rows equal in ``ingested_at`` the greatest ``pos`` wins, then any of them.
    The shuffle is on both ids, so a trace with a third of all rows spreads over all tasks.
    """
    narrow = spans.select(
        F.col("trace_id"),
        F.col("span_id"),
        *(F.col(c) for c in dict.fromkeys(keep)),
        *(c.alias(n) for n, c in computed.items()),
        F.col("ingested_at").alias("__at"),
        F.col("pos").alias("__pos"),
    )
    latest = Window.partitionBy("trace_id", "span_id").orderBy(
        F.col("__at").desc_nulls_last(), F.col("__pos").desc_nulls_last()
    )
    return narrow.withColumn("__rn", F.row_number().over(latest)).where("__rn = 1").drop("__rn", "__at", "__pos")


def in_event_order(events: DataFrame) -> DataFrame:
    """Events sorted by trace and time over range partitions.

    A short trace lies in one partition or straddles a border; a trace of any length is cut into
    pieces as large as a partition. The order of partitions is the order of events.
    """
    return events.where(F.col("start_time").isNotNull()).repartitionByRange("trace_id", *EVENT_ORDER).sortWithinPartitions(
        "trace_id", *EVENT_ORDER
    )


def in_pieces(events: DataFrame) -> DataFrame:
    """Adds ``piece``: events with the same trace and piece are consecutive and fit one task.

    Windows over (``trace_id``, ``piece``) are bounded, where those over ``trace_id`` alone would put
    a trace with a third of all rows into one task. The result is written, because the borders
    between range partitions are found by sampling: computed twice, they could differ. So keep the
    columns few.
    """
    return store(in_event_order(events).withColumn("piece", F.spark_partition_id()), "pieces").df


def _piece_ranks(pieces: DataFrame) -> DataFrame:
    """(trace_id, piece, rank, before): the place of a piece in its trace, and the events before it.

    There is a row for each trace and one more for each border it crosses.
    """
    order = Window.partitionBy("trace_id").orderBy("piece")
    counts = pieces.groupBy("trace_id", "piece").agg(F.count("*").alias("n"))
    return counts.select(
        "trace_id",
        "piece",
        F.row_number().over(order).alias("rank"),
        (F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1))).alias("before"),
    )


def numbered(events: DataFrame) -> DataFrame:
    """Adds ``seq``, the place of an event in its trace, from 1."""
    pieces = in_pieces(events)
    crossing = _piece_ranks(pieces).where("rank > 1").select("trace_id", "piece", "before")
    local = Window.partitionBy("trace_id", "piece").orderBy(*EVENT_ORDER)
    return (
        pieces.withColumn("__local", F.row_number().over(local))
        .join(crossing, ["trace_id", "piece"], "left")
        .withColumn("seq", F.col("__local") + F.coalesce("before", F.lit(0)))
        .drop("__local", "before", "piece")
    )


def with_followers(events: DataFrame, k: int, *columns: str) -> DataFrame:
    """Adds ``next1`` to ``nextk``: structs of ``columns`` of the events that follow in the trace.

    Each piece also sees the first ``k`` events of the pieces after it, so windows cross borders.
    """
    pieces = in_pieces(events)
    local = Window.partitionBy("trace_id", "piece").orderBy(*EVENT_ORDER)
    ranks = _piece_ranks(pieces)
    crossing = ranks.join(ranks.where("rank > 1").select("trace_id").distinct(), "trace_id", "left_semi")
    heads = (
        pieces.join(crossing.select("trace_id", "piece", "rank").where("rank > 1"), ["trace_id", "piece"])
        .withColumn("__local", F.row_number().over(local))
        .where(F.col("__local") <= k)
        .drop("__local", "piece")
        .withColumn("__to", F.explode(F.sequence(F.greatest(F.col("rank") - k, F.lit(1)), F.col("rank") - 1)))
        .drop("rank")
        .join(crossing.select("trace_id", F.col("rank").alias("__to"), "piece"), ["trace_id", "__to"])
        .drop("__to")
        .withColumn("__halo", F.lit(True))
    )
    seen = pieces.withColumn("__halo", F.lit(False)).unionByName(heads)
    for i in range(1, k + 1):
        seen = seen.withColumn(f"next{i}", F.lead(F.struct(*columns), i).over(local))
    return seen.where("NOT __halo").drop("__halo", "piece")
