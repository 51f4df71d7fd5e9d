"""Raw telemetry texts to span records: SDK span arrays, JVM-side; OTLP documents in Python."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.arrow import arrow_schema, batch_of, rows_of
from spanloom.functions.scalars import from_nanos, hex_digits, or_else, span_kind, token_count
from spanloom.functions.strict_json import loads
from spanloom.functions.text import decode
from spanloom.sources.payloads import attributes, either, hex_id, spans_of

_SDK = (
    "array<struct<name string, context struct<trace_id string, span_id string>, parent_id string, "
    "start_time string, end_time string, attributes map<string,string>>>"
)
_OTLP = (
    "file string, pos int, trace_id string, span_id string, parent_span_id string, name string, "
    "start_nanos long, end_nanos long, kind string, input string, output string, tokens string, llm string, provider string"
)
_OFFSET = r"(Z|[+-]\d{2}:?\d{2})$"


def text_format(text: F.Column) -> F.Column:
    """``sdk``, ``trace``, ``otlp``, or why a text is none of them."""
    keys = F.json_object_keys(text)
    length = F.json_array_length(text)
    return (
        F.when(text.isNull() | ~text.rlike(r"\S"), F.lit("empty"))
        .when(text.rlike(r"^\s*\[") & length.isNull(), F.lit("not JSON"))
        .when((length > 0) & F.get_json_object(text, "$[0].context").isNotNull(), F.lit("sdk"))
        .when(length.isNotNull(), F.lit("array of something else"))
        .when(keys.isNull(), F.when(F.try_parse_json(text).isNull(), F.lit("not JSON")).otherwise(F.lit("not an object or array")))
        .when(F.array_contains(keys, "trace_id"), F.lit("trace"))
        .when(F.array_contains(keys, "resource_spans") | F.array_contains(keys, "resourceSpans"), F.lit("otlp"))
        .otherwise(F.lit("unknown object"))
    )


def _shape(df: DataFrame) -> DataFrame:
    return df.withColumn("model", or_else(F.col("llm"), F.col("provider"))).select(
        "file",
        "trace_id",
        "span_id",
        "parent_span_id",
        or_else(F.col("name"), F.lit("anonymous")).alias("agent_or_node_id"),
        span_kind(F.col("kind")).alias("span_kind"),
        "start_time",
        "end_time",
        F.coalesce("input", F.lit("")).alias("input_text"),
        F.coalesce("output", F.lit("")).alias("output_text"),
        token_count(F.col("tokens")).alias("token_count"),
        "model",
        "pos",
    )


def _sdk(texts: DataFrame) -> DataFrame:
    at = lambda c: F.when(F.col(c).rlike(_OFFSET), F.try_to_timestamp(c))
    key = lambda k: F.try_element_at("a", F.lit(k))
    flat = texts.select("file", F.posexplode(F.from_json("text", _SDK)).alias("pos", "s")).select(
        "file", "pos", "s.name", "s.context.*", "s.parent_id", "s.start_time", "s.end_time", F.col("s.attributes").alias("a")
    )
    return _shape(
        flat.select(
            "file",
            "pos",
            hex_digits(F.col("trace_id"), 32).alias("trace_id"),
            hex_digits(F.col("span_id"), 16).alias("span_id"),
            hex_digits(F.nullif("parent_id", F.lit("")), 16).alias("parent_span_id"),
            "name",
            at("start_time").alias("start_time"),
            at("end_time").alias("end_time"),
            key("openinference.span.kind").alias("kind"),
            key("input.value").alias("input"),
            key("output.value").alias("output"),
            key("llm.token_count.total").alias("tokens"),
            key("llm.model_name").alias("llm"),
            key("llm.provider").alias("provider"),
        )
    )


def _text(value: object) -> str | None:
    import json

    return value if isinstance(value, str) or value is None else json.dumps(value, ensure_ascii=False, default=str)


def _otlp(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = arrow_schema(_OTLP)
    nanos = lambda x: int(x) if isinstance(x, (int, str)) and str(x).isdigit() else None
    for batch in batches:
        rows = []
        for file, raw in rows_of(batch):
            for pos, (span, raw_id) in enumerate(spans_of(loads(decode(raw)))):
                known = attributes(span)
                wanted = ("openinference.span.kind", "input.value", "output.value", "llm.token_count.total", "llm.model_name", "llm.provider")
                name = span.get("name")
                rows.append(
                    (
                        file, pos, hex_id(either(span, "trace_id"), 32), hex_id(raw_id), hex_id(either(span, "parent_span_id")), name if isinstance(name, str) else None,
                        nanos(either(span, "start_time_unix_nano")), nanos(either(span, "end_time_unix_nano")), *(_text(known.get(k)) for k in wanted),
                    )
                )
        yield batch_of(rows, schema)


def otel_spans(texts: DataFrame, otlp: bool = False) -> tuple[DataFrame, DataFrame]:
    """Span records of telemetry texts, and the files that hold none, with the reason.

    Input: ``file``, ``text``. OTLP documents are refused unless ``otlp``. Times without an offset
    are null, as their zone is unknown. Attributes that are lists or objects come as JSON text.
    """
    known = texts.select("file", "text", text_format(F.col("text")).alias("format"))
    found = _sdk(known.where("format = 'sdk'"))
    if otlp:
        raw = known.where("format = 'otlp'").select("file", F.col("text").cast("binary")).mapInArrow(_otlp, _OTLP)
        times = {"start_time": from_nanos(F.col("start_nanos")), "end_time": from_nanos(F.col("end_nanos"))}
        found = found.unionByName(_shape(raw.withColumns(times)))
    accepted = ["sdk", "otlp"] if otlp else ["sdk"]
    return found, known.where(~F.col("format").isin(accepted)).select("file", F.col("format").alias("reason"))
