"""Span records and the fixed values of the detector."""

from __future__ import annotations

SPAN_DDL = (
    "trace_id string, span_id string, parent_span_id string, agent_or_node_id string, span_kind string, "
    "start_time timestamp, end_time timestamp, input_text string, output_text string, token_count bigint, "
    "model string, cost_rate double, pos int"
)
SPAN_COLUMNS = tuple(c.split()[0] for c in SPAN_DDL.split(", "))

# Fixed values of the data format.
KINDS = ("llm", "tool", "chain", "agent")
RAW_KINDS = {"LLM": "llm", "TOOL": "tool", "CHAIN": "chain", "AGENT": "agent"}

# The calibrated threshold and occurrence count, and the model they were calibrated with.
PHI = 0.514345
N = 2
MODEL = "paraphrase-multilingual-MiniLM-L12-v2"
REVISION = "e8f8c211226b894fcb81acc59f3b34ba3efd5f42"

# Bounds of the verdict on an evaluation and of a calibration's guards.
GO_F1, GO_FPR, KILL_F1, KILL_FPR = 0.80, 0.10, 0.60, 0.25
GUARD_D, GUARD_PAIR_FPR = 0.5, 0.15

SNIPPET = 80
