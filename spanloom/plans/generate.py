"""Labelled synthetic traces: pairs of equal shape, one with repeated work and one without.

Every pattern is a table of steps; the rows of a set come from ``spark.range`` and an explode, so a
set of any size is made in parallel, and the same seed gives the same set.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.scalars import stable_seed
from spanloom.sinks import trace_texts

#: (node, kind, second, input, output of the positive, output of its twin, repeated work?)
PATTERNS: dict[str, list[tuple[str, str, int, str, str, str, bool]]] = {
    "repeat_node": [
        ("run", "chain", 0, "", "run finished", "run finished", False),
        ("start", "chain", 1, "", "ready", "ready", False),
        ("analyze", "llm", 2, "look at the sources", "the main causes are price, weather and staff", "five sources were read in full", False),
        ("analyze", "llm", 4, "look at the sources", "the main causes are price, weather and staff", "prices rise since spring, spread 0.18", True),
        ("analyze", "llm", 6, "look at the sources", "the main causes are price, weather and staff", "a change of one unit moves demand by 0.7", True),
        ("finalize", "chain", 8, "", "report written", "report written", False),
    ],
    "pingpong_aba": [
        ("run", "chain", 0, "", "run finished", "run finished", False),
        ("start", "chain", 1, "", "ready", "ready", False),
        ("writer", "llm", 2, "draft", "draft: three pages on rivers", "draft: three pages on rivers", False),
        ("critic", "llm", 5, "review", "the second page needs a source", "the second page needs a source", False),
        ("writer", "llm", 8, "draft", "draft: three pages on rivers", "new draft with the survey of 1998 as a source", True),
        ("critic", "llm", 11, "review", "the second page needs a source", "accepted, shorten the title", True),
        ("finalize", "chain", 14, "", "report written", "report written", False),
    ],
    "requery_known": [
        ("run", "chain", 0, "", "run finished", "run finished", False),
        ("start", "chain", 1, "", "ready", "ready", False),
        ("lookup", "tool", 2, "account={a}", "name=Kim, plan=basic", "name=Kim, plan=basic", False),
        ("process", "chain", 5, "", "first result noted", "first result noted", False),
        ("lookup", "tool", 8, "account={b}", "name=Kim, plan=basic", "name=Ode, plan=team", True),
        ("finalize", "chain", 12, "", "report written", "report written", False),
    ],
    "regen_handoff": [
        ("run", "chain", 0, "", "run finished", "run finished", False),
        ("start", "chain", 1, "", "ready", "ready", False),
        ("collector", "llm", 2, "collect", "notes on four markets", "notes on four markets", False),
        ("composer", "llm", 5, "compose", "notes on four markets", "a summary in two sentences", True),
        ("finalize", "chain", 9, "", "report written", "report written", False),
    ],
}
#: What a clean lookup may return: records of the same shape for another key, and facts of other subjects.
SAME_SHAPE = ["name=Ode, plan=team", "name=Ira, plan=basic", "name=Lin, plan=trial", "name=Kim, plan=team", "name=Bo, plan=closed"]
SUBJECTS = ["harbour", "orchard", "railway", "library", "glacier", "bakery", "theatre"]
FACTS = ["opens at nine", "was built in 1904", "has four gates", "closes for repairs in May", "lies north of the river", "employs sixty people", "lost its roof in a storm", "sells tickets by post"]
TOKENS, RATE, FAKE_MODEL = 10, 1e-6, "fake-model"


def build_set(spark: SparkSession, seed: int, pairs: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Spans, labels and manifest rows of ``pairs`` twins for each pattern.

    A repeated lookup has the same key; its twin asks for another one and gets, as the seed decides,
    a record of the same shape or a fact of another subject.
    """
    step = "struct<node:string,kind:string,second:int,input:string,pos_out:string,neg_out:string,waste:boolean>"
    literal = lambda rows: F.array(*(F.struct(*(F.lit(v) for v in r)) for r in rows)).cast(f"array<{step}>")
    table = [(i, name) for i, name in enumerate(PATTERNS)]
    steps = F.create_map(*(x for name, rows in PATTERNS.items() for x in (F.lit(name), literal(rows))))
    names = F.create_map(*(F.lit(x) for pair in table for x in pair))
    base = spark.range(len(PATTERNS) * pairs * 2).select(
        (F.col("id") + 1).alias("number"),
        names[(F.col("id") / (2 * pairs)).cast("int")].alias("pattern"),
        (F.col("id") % 2 == 0).alias("positive"),
        F.pmod(F.xxhash64(F.lit(stable_seed(seed) >> 1), F.col("id")), F.lit(90_000)).alias("draw"),
    )
    traces = base.withColumn("trace_id", F.concat(F.lit("t-"), F.lpad(F.col("number").cast("string"), 4, "0")))
    rows = traces.select("trace_id", "positive", "draw", F.posexplode(steps[F.col("pattern")]).alias("pos", "s"))
    span_id = lambda c: F.concat(F.lit("s-"), F.lpad((c + 1).cast("string"), 4, "0"))
    key = F.replace(F.col("s.input"), F.lit("{a}"), (F.col("draw") + 10_000).cast("string"))
    key = F.replace(key, F.lit("{b}"), (F.col("draw") + F.when(F.col("positive"), 10_000).otherwise(10_001)).cast("string"))
    draw, pick = F.col("draw"), lambda xs, k: F.element_at(F.array(*map(F.lit, xs)), (k % len(xs) + 1).cast("int"))
    fact = F.concat(F.lit("the "), pick(SUBJECTS, F.floor(draw / 2)), F.lit(" "), pick(FACTS, F.floor(draw / 14)))
    other_record = F.when(draw % 2 == 0, pick(SAME_SHAPE, F.floor(draw / 2))).otherwise(fact)
    clean = F.when(F.col("s.input") == "account={b}", other_record).otherwise(F.col("s.neg_out"))
    start = F.timestamp_seconds(F.lit(1_767_225_600) + F.col("s.second"))
    spans = rows.select(
        "trace_id",
        span_id(F.col("pos")).alias("span_id"),
        F.when(F.col("pos") > 0, span_id(F.lit(0))).alias("parent_span_id"),
        F.col("s.node").alias("agent_or_node_id"),
        F.col("s.kind").alias("span_kind"),
        start.alias("start_time"),
        (start + F.expr("INTERVAL 1 SECOND")).alias("end_time"),
        key.alias("input_text"),
        F.when(F.col("positive"), F.col("s.pos_out")).otherwise(clean).alias("output_text"),
        F.lit(TOKENS).cast("bigint").alias("token_count"),
        F.lit(FAKE_MODEL).alias("model"),
        F.lit(RATE).alias("cost_rate"),
        "pos",
    )
    waste = F.transform(F.filter(F.transform(steps[F.col("pattern")], lambda s, i: F.struct(i.alias("i"), s["waste"].alias("w"))), lambda x: x["w"]), lambda x: span_id(x["i"]))
    none = F.array().cast("array<string>")
    labels = traces.select(
        "trace_id",
        F.when(F.col("positive"), "positive").otherwise("negative").alias("label_class"),
        F.when(F.col("positive"), F.col("pattern")).alias("waste_pattern"),
        F.when(F.col("positive"), waste).otherwise(none).alias("waste_span_ids"),
    )
    other = F.concat(F.lit("t-"), F.lpad((F.col("number") + 1).cast("string"), 4, "0"))
    manifest = traces.where("positive").select(F.col("trace_id").alias("positive_trace_id"), other.alias("negative_trace_id"), "pattern", F.size(steps[F.col("pattern")]).alias("length"))
    return spans, labels, manifest


def set_digest(texts: DataFrame) -> str:
    """A digest of a set of texts (``trace_id``, ``text``), whatever their order.

    Each text's hash is cut into four numbers, which are added up over all texts; so nothing but
    four sums leaves a task, however large the set.
    """
    h = F.sha2(F.concat_ws("\0", "trace_id", F.sha2("text", 256)), 256)
    part = lambda i: F.sum(F.conv(F.substring("h", 1 + 16 * i, 16), 16, 10).cast("decimal(38,0)")).alias(f"s{i}")
    sums = texts.select(h.alias("h")).groupBy().agg(*(part(i) for i in range(4)))
    return sums.select(F.sha2(F.concat_ws(",", *(F.coalesce(F.col(f"s{i}").cast("string"), F.lit("0")) for i in range(4))), 256).alias("d")).first().d


def write_set(spark: SparkSession, folder: str, seed: int, pairs: int) -> dict:
    """Writes a set below ``folder`` (``traces``, ``labels``, ``manifest``, ``figures``) and returns its figures.

    Traces are one JSON record a line; labels and manifest are JSON lines. Sets made with the same
    seed have the same digests.
    """
    spans, labels, manifest = build_set(spark, seed, pairs)
    texts = trace_texts(spans)
    texts.select("text").write.mode("overwrite").text(f"{folder}/traces")
    shown = labels.select("trace_id", F.col("label_class").alias("class"), F.col("waste_pattern").alias("pattern"), "waste_span_ids")
    lines = shown.select("trace_id", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("text"))
    lines.select("text").write.mode("overwrite").text(f"{folder}/labels")
    manifest.write.mode("overwrite").json(f"{folder}/manifest")
    lengths = spans.groupBy("trace_id").count().groupBy().agg(F.min("count").alias("min"), F.max("count").alias("max"), F.avg("count").alias("mean")).first()
    figures = {
        "seed": seed,
        "pairs_per_pattern": pairs,
        "counts": {r.label_class: r["count"] for r in labels.groupBy("label_class").count().collect()},
        "pattern_distribution": {r.pattern: r["count"] for r in manifest.groupBy("pattern").count().collect()},
        "length_distribution": lengths.asDict(),
        "digests": {"labels": set_digest(lines), "traces": set_digest(texts)},
    }
    spark.createDataFrame([(json.dumps(figures, sort_keys=True),)], "text string").coalesce(1).write.mode("overwrite").text(f"{folder}/figures")
    return figures
