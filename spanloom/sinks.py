"""Trace files, reports and the ledger of evaluations, as DataFrames that are written once."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.schema import MODEL, PHI, SPAN_COLUMNS, N

NOTE = "Thresholds come from synthetic traces; pairs whose similarity is near the threshold deserve a look by a person."


# Headings and table head of the Markdown report, which other programs read.
_WASTE, _NO_WASTE = "## Result: WASTE DETECTED", "## Result: no waste detected"
_TABLE = (
    "## Wasted Span Details\n\n| origin_node | repeat_node | cosine | tokens (wasted) | cost (wasted) |\n"
    "|-------------|-------------|--------|-----------------|---------------|"
)


def trace_texts(spans: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """``trace_id``, ``text``: one saved record per trace, its spans in file order.

    A record is one text by nature, so a trace is gathered here and nowhere else.
    """
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias(c)
    fields = [iso(c) if c in ("start_time", "end_time") else F.col(c) for c in SPAN_COLUMNS if c != "pos"]
    rows = spans.groupBy("trace_id").agg(F.sort_array(F.collect_list(F.struct("pos", F.struct(*fields).alias("s")))).alias("all"))
    body = F.to_json(F.transform("all", lambda x: x["s"]), {"ignoreNullFields": "false"})
    meta = F.lit("{}")
    if metadata is not None:
        known = metadata.groupBy("trace_id").agg(F.max("metadata").alias("__meta"))
        rows, meta = rows.join(known, "trace_id", "left"), F.coalesce("__meta", F.lit("{}"))
    text = F.concat(F.lit('{"trace_id":'), _quoted(F.col("trace_id")), F.lit(',"spans":'), body, F.lit(',"metadata":'), meta, F.lit("}"))
    return rows.select("trace_id", text.alias("text"))


def _quoted(text: Column) -> Column:
    whole = F.to_json(F.array(text), {"ignoreNullFields": "false"})
    return whole.substr(F.lit(2), F.length(whole) - 2)


def _number(value: Column, places: int | None = None) -> Column:
    """A number as JSON; of small ones the places, as exponents are spelt in many ways."""
    shown = (value.cast(f"decimal(38,{places})") if places is not None else value).cast("string")
    return F.when(value.isNull(), F.lit('"unknown"')).otherwise(shown)


def _known(value: Column) -> Column:
    return F.when(value > 0, value)


def json_reports(verdicts: DataFrame, details: DataFrame, *, snippets: bool = True, phi: float = PHI, n: int = N, model: str = MODEL, now: str | None = None) -> DataFrame:
    """``trace_id``, ``report`` (JSON) for every trace; unknown numbers are the string ``unknown``."""
    entry = [
        F.lit('{"origin_node":'), _quoted(F.col("origin_node")), F.lit(',"repeat_node":'), _quoted(F.col("repeat_node")),
        F.lit(',"cosine":'), _number(F.col("cosine"), 6), F.lit(',"tokens_wasted":'), _number(F.col("waste_tokens")), F.lit(',"cost_wasted":'), _number(F.col("waste_cost"), 8),
    ]
    if snippets:
        entry += [F.lit(',"snippet":'), _quoted(F.col("snippet"))]
    rows = _by_trace(verdicts, details, F.concat(*entry, F.lit("}")))
    stamp = now or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    report = F.concat(
        F.lit('{"trace_id":'), _quoted(F.col("trace_id")), F.lit(f',"analyzed":"{stamp}","detector_params":{{"phi":{phi},"n":{n},"model":"{model}"}},"wasteful":'),
        F.col("wasteful").cast("string"), F.lit(',"waste_span_count":'), F.col("waste_spans").cast("string"),
        F.lit(',"total_tokens_wasted":'), _number(_known(F.col("waste_tokens"))), F.lit(',"total_cost_wasted":'), _number(_known(F.col("waste_cost")), 8),
        F.lit(',"waste_details":['), F.array_join("lines", ","), F.lit(f'],"note":"{NOTE}"}}'),
    )
    return rows.select("trace_id", report.alias("report"))


def _by_trace(verdicts: DataFrame, details: DataFrame, line: Column) -> DataFrame:
    lines = details.select("trace_id", F.struct("ord", line.alias("line")).alias("e")).groupBy("trace_id").agg(F.transform(F.sort_array(F.collect_list("e")), lambda e: e["line"]).alias("lines"))
    return verdicts.join(lines, "trace_id", "left").withColumn("lines", F.coalesce("lines", F.array().cast("array<string>")))


def markdown_reports(verdicts: DataFrame, details: DataFrame, *, snippets: bool = True, phi: float = PHI, n: int = N, model: str = MODEL, now: str | None = None) -> DataFrame:
    """``trace_id``, ``report`` (Markdown) for every trace."""
    unknown = lambda c: F.coalesce(c, F.lit("unknown"))
    cost = F.when(F.col("waste_cost").isNotNull(), F.col("waste_cost").cast("decimal(38,6)").cast("string"))
    cells = F.concat_ws(" | ", "origin_node", "repeat_node", F.col("cosine").cast("decimal(38,4)").cast("string"), unknown(F.col("waste_tokens").cast("string")), unknown(cost))
    row = F.concat(F.lit("| "), cells, F.lit(" |"))
    shown = F.concat(F.lit(". "), "repeat_node", F.lit("** (repeat)\n> "), F.col("snippet"))
    rows = _by_trace(verdicts, details, F.concat_ws("\x00", row, shown))
    part = lambda i: F.transform("lines", lambda x: F.element_at(F.split(x, "\x00"), i))
    snippets_of = F.transform(part(2), lambda x, k: F.concat(F.lit("**"), (k + 1).cast("string"), x, F.lit("\n\n")))
    stamp = now or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    head = F.concat(F.lit("# Waste report\n\n- **trace_id**: `"), "trace_id", F.lit(f"`\n- **analyzed**: {stamp}\n- **detector params**: φ={phi}, N={n}, model={model}\n\n"))
    totals = F.concat(
        F.lit(f"{_WASTE}\n\n- **wasted spans**: "), F.col("waste_spans").cast("string"),
        F.lit("\n- **estimated wasted tokens**: "), F.coalesce(_known(F.col("waste_tokens")).cast("string"), F.lit("unknown")),
        F.lit("\n- **estimated wasted cost**: "), F.when(F.col("waste_cost") > 0, F.col("waste_cost").cast("decimal(38,6)").cast("string")).otherwise("unknown"),
        F.lit(f"\n\n{_TABLE}\n"), F.array_join(part(1), "\n"),
        F.concat(F.lit("\n\n## Snippets\n\n"), F.array_join(snippets_of, "")) if snippets else F.lit("\n"),
    )
    body = F.when(F.col("wasteful"), totals).otherwise(F.lit(f"{_NO_WASTE}\n\n"))
    return rows.select("trace_id", F.concat(head, body, F.lit(f"---\n_{NOTE}_")).alias("report"))


def append_run(spark: SparkSession, ledger: str, phi: float, n: int, model: str, f1: float, fpr: float, verdict: str) -> int:
    """Adds an evaluation to the ledger (JSON lines) and returns its number."""
    number = read_runs(spark, ledger).count() + 1
    day = datetime.now(timezone.utc).strftime("%Y-%m-%d")
    spark.createDataFrame([(number, day, phi, n, model, f1, fpr, verdict)], RUN_DDL).coalesce(1).write.mode("append").json(ledger)
    return number


RUN_DDL = "run long, date string, phi double, n int, model string, f1 double, fpr double, verdict string"


def read_runs(spark: SparkSession, ledger: str) -> DataFrame:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], RUN_DDL)
    return spark.read.schema(RUN_DDL).json(ledger)


def runs_markdown(runs: DataFrame) -> str:
    """The ledger as a Markdown table; it has a row for each evaluation ever run."""
    head = "| run | date | phi | N | model | f1 | fpr | verdict |\n|---|---|---|---|---|---|---|---|\n"
    rows = runs.orderBy("run").toLocalIterator()
    return head + "".join(f"| {r.run} | {r.date} | {r.phi} | {r.n} | {r.model} | {r.f1:.4f} | {r.fpr:.4f} | {r.verdict} |\n" for r in rows)


def calibration_markdown(result: dict, summary: DataFrame) -> str:
    """A calibration's figures (see ``plans.flows.calibrate``) and both distributions (see ``metrics.summary``)."""
    lines = ["# Calibration", ""]
    lines += [f"- **{k}**: {result[k]}" for k in ("phi", "n", "gap", "cohens_d", "pair_fpr", "trace_fpr", "guards_passed", "failures")]
    lines += ["", "| pairs | count | p10 | median | p90 | mean |", "|---|---|---|---|---|---|"]
    lines += [f"| {'duplicate' if r.dup else 'other'} | {r.n} | {r.p10} | {r.median} | {r.p90} | {r.mean} |" for r in summary.orderBy("dup").collect()]
    return "\n".join(lines) + "\n"
