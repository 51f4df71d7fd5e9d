"""The same operators over arriving spans, with Structured Streaming.

Detection needs a trace's spans to be final. So the stream keeps each open trace in state, with the
latest version of every span, and hands it on once nothing of it has arrived for a while.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spanloom.operators.detect import detect
from spanloom.schema import SPAN_COLUMNS, SPAN_DDL


def read_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of Parquet files as they arrive in a folder."""
    return spark.readStream.schema(SPAN_DDL + ", ingested_at timestamp").parquet(folder)


def complete_traces(spans: DataFrame, quiet: str = "10 minutes") -> DataFrame:
    """Each trace's current spans, once ``quiet`` has passed since the last delivery of one of them.

    Of a span's versions the latest by ``ingested_at`` counts, then the one with the greater ``pos``,
    as in a batch. What arrives for a trace after it was handed on is a trace of its own; rows
    further behind the latest ``ingested_at`` than ``quiet`` are dropped, as are those without a
    trace or an ``ingested_at``. State holds the open traces.
    """
    wait = int(pd.Timedelta(quiet).total_seconds() * 1000)

    def keep(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (held,) = state.get
            state.remove()
            yield pickle.loads(held)[list(SPAN_COLUMNS)]
            return
        parts = [pickle.loads(state.get[0])] if state.exists else []
        rows = pd.concat([*parts, *frames], ignore_index=True)
        rows = rows.sort_values(["ingested_at", "pos"], kind="stable", na_position="first").drop_duplicates(["span_id"], keep="last")
        state.update((pickle.dumps(rows),))
        last = int(rows["ingested_at"].max().timestamp() * 1000)
        state.setTimeoutTimestamp(max(last + wait, state.getCurrentWatermarkMs() + 1))

    timed = spans.where("trace_id IS NOT NULL AND ingested_at IS NOT NULL").withWatermark("ingested_at", quiet)
    return timed.groupBy("trace_id").applyInPandasWithState(keep, SPAN_DDL, "held binary", "append", GroupStateTimeout.EventTimeTimeout)


def without_redeliveries(spans: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """The first delivery of each span, at once; ``complete_traces`` has the latest, later.

    State is kept for ``delay`` behind the latest arrival.
    """
    return spans.withWatermark("ingested_at", delay).dropDuplicatesWithinWatermark(["trace_id", "span_id"])


def node_activity(spans: DataFrame, window: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Spans and tokens of each node by window of start time; late spans beyond ``delay`` are left out."""
    timed = spans.where("start_time IS NOT NULL").withWatermark("start_time", delay)
    return timed.groupBy(F.window("start_time", window).alias("w"), "agent_or_node_id").agg(F.count("*").alias("spans"), F.sum("token_count").alias("tokens")).select(
        F.col("w.start").alias("from"), "agent_or_node_id", "spans", "tokens"
    )


def detect_batches(spans: DataFrame, sink: Callable[[DataFrame, DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs detection on each micro-batch; ``sink`` gets verdicts, details and the batch's number.

    A batch must hold whole traces, as those of ``complete_traces`` do. Repeated batches have the same
    number, by which the sink can make its writes idempotent.
    """

    def run(batch: DataFrame, number: int) -> None:
        sink(*detect(batch), number)

    return spans.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
