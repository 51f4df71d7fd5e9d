"""Whole runs: calibration on labelled traces, evaluation with frozen parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame

from spanloom.functions.vectors import Embedder
from spanloom.operators import metrics as m
from spanloom.operators.detect import detect, scored_pairs
from spanloom.operators.structural import candidate_pairs
from spanloom.sinks import append_run, read_runs
from spanloom.sources.files import Frozen

GREY_BUDGET = 3


def calibrate(spans: DataFrame, labels: DataFrame, embedder: Embedder | None = None) -> dict:
    """Threshold, occurrence count, separation and failed guards of labelled traces.

    The similarities are computed once for all figures but the trace-level rate. Raises where the
    labels hold no duplicate or no other pair.
    """
    known = m.clean_labels(labels)
    pairs = m.split_pairs(scored_pairs(candidate_pairs(spans, embedder=embedder), embedder), known)
    row = m.separation(pairs).first()
    if row.phi is None:
        raise ValueError("the labelled traces lack duplicate pairs or other pairs")
    number = m.choose_n(spans, known).first()
    if number is None:
        raise ValueError("no labelled waste among positive traces")
    verdicts, _ = detect(spans, embedder, max(2, number.n), row.phi)
    rate = m.trace_fpr(verdicts, known).first().trace_fpr
    return {**row.asDict(), "n": number.n, "trace_fpr": rate, "guards_passed": not row.failures}


def evaluate(spans: DataFrame, labels: DataFrame, params: Frozen, embedder: Embedder | None = None, ledger: str | None = None) -> dict:
    """Confusion matrix and verdict with frozen parameters; refused once the grey budget is spent."""
    spark = spans.sparkSession
    if ledger and read_runs(spark, ledger).where("verdict = 'GREY'").count() >= GREY_BUDGET:
        raise ValueError("the budget of grey evaluations is spent")
    known = m.clean_labels(labels)
    verdicts, _ = detect(spans, embedder, params.n, params.phi)
    if not m.unlabelled(verdicts, known).isEmpty():
        raise ValueError("a trace has no label")
    row = m.confusion(verdicts, known).first().asDict()
    row["patterns"] = {r.pattern: r.asDict() for r in m.confusion_by_pattern(verdicts, known).collect()}
    if ledger:
        row["run"] = append_run(spark, ledger, params.phi, params.n, f"{params.model}@{params.revision}", row["f1"], row["fpr"], row["verdict"])
    return row
