import datetime as dt
import os

from spanloom.plans.generate import build_set
from spanloom.schema import SPAN_DDL
from spanloom.streaming.live import complete_traces, detect_batches, node_activity, read_spans, without_redeliveries

T0 = dt.datetime(2026, 1, 1)


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    spans, labels, _ = build_set(spark, 3, 1)
    from pyspark.sql import functions as F

    delivered = spans.withColumn("ingested_at", F.lit(T0))
    delivered.unionByName(delivered.limit(4)).coalesce(1).write.parquet(str(tmp_path / "in"))
    once = without_redeliveries(read_spans(spark, str(tmp_path / "in")))
    q = once.writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == spans.count()

    q = node_activity(read_spans(spark, str(tmp_path / "in")), "1 hour").writeStream.outputMode("complete").format("memory").queryName("activity")
    q = q.option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    by = {r.agent_or_node_id: r.spans for r in spark.table("activity").collect()}
    assert by["lookup"] >= 4 and sum(by.values()) == spans.count() + 4

    seen = {}
    spans.withColumn("ingested_at", F.lit(T0)).coalesce(1).write.parquet(str(tmp_path / "whole"))
    q = detect_batches(read_spans(spark, str(tmp_path / "whole")), lambda v, d, n: seen.update({n: (v.count(), d.count())}), str(tmp_path / "c3"))
    q.awaitTermination()
    from spanloom.operators.detect import detect

    v, d = detect(spans)
    assert seen == {0: (v.count(), d.count())}


def test_traces_are_handed_on_whole_with_the_latest_versions(spark, tmp_path):
    from pyspark.sql import functions as F

    spans, _, _ = build_set(spark, 3, 1)
    at = lambda s: F.lit(T0 + dt.timedelta(seconds=s))
    one = spans.where("trace_id <= 't-0002'")
    deliveries = [
        one.where("pos % 2 = 0").withColumn("output_text", F.lit("old")).withColumn("ingested_at", at(1)),
        one.withColumn("ingested_at", at(60)).unionByName(one.where("pos = 1").withColumn("output_text", F.lit("older")).withColumn("ingested_at", at(30))),
        spans.where("trace_id = 't-0003'").withColumn("ingested_at", at(3600)),
        spans.where("trace_id = 't-0004'").withColumn("ingested_at", at(7200)),
    ]
    (tmp_path / "in").mkdir()
    for i, df in enumerate(deliveries):  # one file after the other
        df.coalesce(1).write.parquet(str(tmp_path / f"d{i}"))
        part = next((tmp_path / f"d{i}").glob("part-*.parquet"))
        part.rename(tmp_path / "in" / f"{i}.parquet")
        os.utime(tmp_path / "in" / f"{i}.parquet", (1_700_000_000 + 60 * i,) * 2)
    schema = SPAN_DDL + ", ingested_at timestamp"
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = complete_traces(arriving).writeStream.format("memory").queryName("whole").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("whole")
    done = spans.where("trace_id <= 't-0003'")
    assert {r.trace_id for r in got.collect()} >= {"t-0001", "t-0002"}
    done = done.join(got.select("trace_id").distinct(), "trace_id", "left_semi").select(*got.columns)
    assert got.exceptAll(done).count() == 0 and got.count() == done.count()
