"""Trace files, labels, manifests and frozen parameters.

A path may name a file, a folder or a glob. Files hold one document, or one on each line.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators.preprocess import preprocess
from spanloom.schema import SPAN_COLUMNS
from spanloom.sources.otel import otel_spans, text_format

_OFFSET = r"(Z|[+-]\d{2}:?\d{2})$"
_DOCUMENT = "struct<trace_id string, spans array<string>>"
_RECORD_KEYS, _SPAN_KEYS = ("trace_id", "spans", "metadata"), tuple(c for c in SPAN_COLUMNS if c != "pos")
_OPTIONAL = ("token_count", "model", "cost_rate")  # may be missing; these and the parent may be null
LABEL_DDL = "trace_id string, class string, pattern string, waste_span_ids array<string>"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``text`` of each document. Files without a single byte are passed over by Spark.

    A file is one document, or has one on each line, where its first line is a whole one and isn't
    the only one; ``file`` then ends in ``#`` and the number of the line.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("content").cast("string").alias("text"))
    lines = F.filter(F.transform(F.split("text", "\n"), lambda t, i: F.struct(t.alias("t"), (i + 1).alias("i"))), lambda x: x["t"].rlike(r"\S"))
    first = F.get("lines", F.lit(0))["t"]
    many = (F.size("lines") > 1) & (F.json_object_keys(first).isNotNull() | F.json_array_length(first).isNotNull())
    whole = F.array(F.struct(F.col("text").alias("t"), F.lit(None).cast("int").alias("i")))
    each = files.withColumn("lines", lines).select("file", F.explode(F.when(many, F.col("lines")).otherwise(whole)).alias("d"))
    return each.select(F.concat_ws("#", "file", F.col("d.i").cast("string")).alias("file"), F.col("d.t").alias("text"))


def _problem() -> Column:
    """Why a span's JSON text ``e`` can't be taken, from its parsed form ``v``; null where it can.

    Whole numbers and decimals may be given as text, as long as that is one.
    """
    kind = lambda c: F.schema_of_variant(F.try_variant_get("v", F.lit(f"$.{c}"), "variant"))
    text = lambda c: F.try_variant_get("v", F.lit(f"$.{c}"), "string")
    number = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*|STRING)$"
    fits = {c: kind(c) == "STRING" for c in _SPAN_KEYS}
    fits["token_count"] = kind("token_count").rlike(number) & (text("token_count").try_cast("double") == text("token_count").try_cast("decimal(38,0)").cast("double"))
    fits["cost_rate"] = kind("cost_rate").rlike(number) & text("cost_rate").try_cast("double").isNotNull()
    known = F.array(*(F.lit(c) for c in _SPAN_KEYS))
    strange = F.array_except(F.json_object_keys("e"), known)
    checks = [
        F.when(F.col("e").isNull(), "no spans"),
        F.when(F.json_object_keys("e").isNull() | F.col("v").isNull(), "a span that isn't an object"),
        F.when(F.size(strange) > 0, F.concat(F.lit("unknown field: "), F.get(strange, F.lit(0)))),
    ]
    for c in _SPAN_KEYS:
        nullable = c in _OPTIONAL or c == "parent_span_id"
        if c not in _OPTIONAL:
            checks.append(F.when(~F.array_contains(F.json_object_keys("e"), c), f"missing field: {c}"))
        given = kind(c).isNotNull() & (kind(c) != "VOID")
        checks.append(F.when(~F.coalesce(fits[c], F.lit(False)) & (given if nullable else F.lit(True)), f"wrong type: {c}"))
    return F.coalesce(*checks)


def trace_records(texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Spans of saved trace records; ``trace_id``, ``metadata`` (JSON text) of each; refused ones.

    ``pos`` is the place in the record. A record is refused as a whole, with the reason of its first
    bad span, where it has no spans, lacks a field, has an unknown one, or a value that isn't of the
    field's type, or where a span is of another trace. Times without an offset are null: such
    records don't pass validation.
    """
    at = lambda c: F.when(F.col(c).rlike(_OFFSET), F.try_to_timestamp(c)).alias(c)
    value = lambda c, kind: F.try_variant_get("v", F.lit(f"$.{c}"), kind).alias(c)
    parsed = texts.select("file", "text", F.from_json("text", _DOCUMENT).alias("r"))
    strange = F.array_except(F.json_object_keys("text"), F.array(*(F.lit(c) for c in _RECORD_KEYS)))
    outside = F.when(F.size(strange) > 0, F.concat(F.lit("unknown field: "), F.get(strange, F.lit(0)))).when(F.col("r.trace_id").isNull(), "no trace_id")
    flat = parsed.select("file", outside.alias("outside"), F.col("r.trace_id").alias("record_trace"), F.posexplode_outer("r.spans").alias("pos", "e")).withColumn("v", F.try_parse_json("e"))
    wide = flat.select("file", "record_trace", "pos", F.coalesce("outside", _problem()).alias("reason"), *(value(c, "double" if c == "cost_rate" else "string") for c in _SPAN_KEYS))
    wide = wide.withColumn("reason", F.coalesce("reason", F.when(F.col("trace_id") != F.col("record_trace"), "span of another trace")))
    refused = wide.where("reason IS NOT NULL").groupBy("file").agg(F.min_by("reason", F.coalesce("pos", F.lit(-1))).alias("reason"))
    whole = F.col("token_count").try_cast("decimal(38,0)").cast("bigint").alias("token_count")
    columns = [at(c) if c in ("start_time", "end_time") else whole if c == "token_count" else F.col(c) for c in SPAN_COLUMNS]
    spans = wide.select("file", "record_trace", *columns).join(refused.select("file"), "file", "left_anti")
    metadata = parsed.select(F.col("r.trace_id").alias("trace_id"), F.get_json_object("text", "$.metadata").alias("metadata"))
    return spans, metadata, refused


def load(spark: SparkSession, path: str, *, strict: bool = False, costs: DataFrame | None = None, otlp: bool = False) -> tuple[DataFrame, DataFrame]:
    """Spans of all files ready for detection, and the files set aside with the reason.

    Saved records are taken as they are, telemetry is preprocessed once. ``costs`` (``model``,
    ``cost_per_token``) sets the rates of telemetry. ``strict`` raises where a file is set aside.
    """
    texts = read_texts(spark, path)
    saved, _, wrong = trace_records(texts.where(text_format(F.col("text")) == "trace"))
    raw, refused = otel_spans(texts, otlp)
    rates = raw.withColumn("cost_rate", F.lit(None).cast("double"))
    if costs is not None:
        table = costs.groupBy(F.col("model").alias("__m")).agg(F.min("cost_per_token").alias("cost_rate"))
        rates = raw.join(table, raw["model"] == table["__m"], "left").drop("__m")
    ready, _ = preprocess(rates.select(*SPAN_COLUMNS))
    refused = refused.where("reason <> 'trace'").unionByName(wrong)
    if strict:
        some = refused.limit(5).collect()
        if some:
            raise ValueError("; ".join(f"{r.file}: {r.reason}" for r in some))
    return saved.select(*SPAN_COLUMNS).unionByName(ready.select(*SPAN_COLUMNS)), refused


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels of JSON lines, in the columns of the label table."""
    raw = spark.read.schema(LABEL_DDL).json(path).where("trace_id IS NOT NULL")
    return raw.select("trace_id", F.col("class").alias("label_class"), F.col("pattern").alias("waste_pattern"), "waste_span_ids")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``positive_trace_id``, ``negative_trace_id``, ``pattern``, ``length`` of a set's pairs.

    Of documents with a list of ``pairs``, or with one pair on each line.
    """
    pair = "positive_trace_id string, negative_trace_id string, pattern string, length int"
    parsed = read_texts(spark, path).select(F.from_json("text", f"struct<pairs array<struct<{pair}>>, {pair}>".replace(" string", ":string").replace(" int", ":int").replace("pairs array", "pairs:array")).alias("m"))
    one = F.struct(*(F.col(f"m.{c.split()[0]}") for c in pair.split(", ")))
    return parsed.select(F.explode(F.coalesce("m.pairs", F.array(one))).alias("p")).select("p.*").where("positive_trace_id IS NOT NULL")


@dataclass(frozen=True)
class Frozen:
    phi: float
    n: int
    model: str
    revision: str


# How a parameter document names its parameters, and what it says before they are set.
_NOT_YET = "<2단계 동결 시점 채움>"
_PHI, _OCCURRENCES, _MODEL = "φ", "반복 임계 N", "임베딩 모델"


def frozen_parameters(text: str) -> Frozen:
    """The parameters that a document fixes on lines of label, colon and value; an error where it doesn't (yet)."""
    if _NOT_YET in text:
        raise ValueError("the parameters are not frozen yet")
    values: dict[str, str] = {}
    for line in text.splitlines():
        label, colon, value = line.partition(":")
        label = " ".join(label.strip(" \t-*#").split())
        for name in (_PHI, _OCCURRENCES, _MODEL):
            if colon and label.startswith(name):
                values.setdefault(name, value.strip(" \t*`"))
    try:
        model, _, revision = values[_MODEL].partition("@")
        revision = revision.split()[1] if revision.split()[0] == "revision" else ""
        frozen = Frozen(float(values[_PHI].split()[0]), int(values[_OCCURRENCES].split()[0]), model.strip(), revision)
    except (KeyError, IndexError, ValueError) as e:
        raise ValueError("the document lacks a parameter") from e
    if len(revision) != 40 or not set(revision) <= set("0123456789abcdef") or not frozen.model:
        raise ValueError("the document lacks a parameter")
    return frozen
