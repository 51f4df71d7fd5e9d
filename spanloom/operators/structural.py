"""Structural candidates: pairs of spans of which the later may redo the earlier.

Pairs are found on narrow rows: ids, node, kind, time, a digest of the input as it is compared, the
first characters of the output, and what an embedder needs of it. Texts never travel with pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.scalars import normal_input, snippet
from spanloom.functions.vectors import Embedder, HashEmbedder
from spanloom.operators.events import EVENT_ORDER, current_spans, with_followers
from spanloom.storage import store

_PLAIN = ("span_id", "agent_or_node_id", "span_kind", "token_count", "cost_rate", "start_time", "pos")
_CARRIED = (*_PLAIN, "input_key", "snippet", "out")
_USABLE = "trace_id IS NOT NULL AND agent_or_node_id IS NOT NULL AND start_time IS NOT NULL"


def _place() -> Column:
    return F.struct(*EVENT_ORDER)


def _pairs(df: DataFrame, rule: Column, rank: int, order: tuple[Column, Column]) -> DataFrame:
    """``o``, ``c``: origin and candidate; ``ord`` sorts all pairs of a trace."""
    return df.select("trace_id", rule.alias("rule"), F.struct(F.lit(rank).alias("r"), order[0].alias("x"), order[1].alias("y")).alias("ord"), "o", "c")


def _point(start: Column, pos: Column, span: Column, last: Column) -> Column:
    return F.struct(start.alias("start_time"), pos.alias("pos"), span.alias("span_id"), last.alias("part"))


def _of(s: str) -> Column:
    return _point(F.col(f"{s}.start_time"), F.col(f"{s}.pos"), F.col(f"{s}.span_id"), F.lit(0))


def _digests(embedder: Embedder | None) -> dict[str, Column]:
    output = F.coalesce("output_text", F.lit(""))
    return {"input_key": F.md5(normal_input(F.col("input_text"))), "snippet": snippet(output), "out": (embedder or HashEmbedder()).carried(output)}


def narrow(spans: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    """The rows and columns that detection works on: spans with a trace, a node and a start."""
    return spans.where(_USABLE).select("trace_id", *_PLAIN, *(c.alias(n) for n, c in _digests(embedder).items()))


def current_narrow(deliveries: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    """The same of the current spans of a delivery log; texts are cut down before they would be shuffled."""
    return current_spans(deliveries, *_PLAIN[1:], **_digests(embedder)).where(_USABLE)


def _rows(spans: DataFrame) -> DataFrame:
    return spans if "input_key" in spans.columns else narrow(spans)


def repeat_pairs(spans: DataFrame, n: int = 2) -> DataFrame:
    """(origin, later) for each later span of a node with at least ``n`` spans in its trace.

    The origin is the node's first span. Where it is a tool, later spans only count with the same
    input but for surrounding white space and case; two null inputs are the same. Ties in time go by
    ``pos``, then ``span_id``. Spans may be given as narrow rows. The origin and the count of a node are aggregated before the shuffle
    and joined back, so that a node with most rows of a trace can be split.
    """
    if n < 2:
        raise ValueError("n must be at least 2: one occurrence is no repetition")
    rows = _rows(spans)
    node = ["trace_id", "agent_or_node_id"]
    first = rows.groupBy(*node).agg(F.min_by(F.struct(*_CARRIED), _place()).alias("o"), F.count("*").alias("n")).where(F.col("n") >= n)
    later = rows.withColumn("c", F.struct(*_CARRIED)).select(*node, "c").join(first, node).where("c.span_id <> o.span_id")
    tool = F.col("o.span_kind").eqNullSafe("tool")
    same = F.col("o.input_key").eqNullSafe(F.col("c.input_key"))
    kept = later.where(~tool | same)
    return _pairs(kept, F.when(tool, "requery").otherwise("repeat"), 0, (_of("o"), _of("c")))


def pingpong_pairs(spans: DataFrame) -> DataFrame:
    """Of every four consecutive spans of nodes A, B, A, B: both later spans with their earlier ones."""
    rows = _rows(spans)
    seen = with_followers(rows, 3, *_CARRIED)
    node = lambda i: F.col(f"next{i}.agent_or_node_id") if i else F.col("agent_or_node_id")
    span = lambda i: F.col(f"next{i}") if i else F.struct(*_CARRIED)
    found = seen.where((node(0) == node(2)) & (node(1) == node(3)) & (node(0) != node(1)))
    both = F.array(*(F.struct(span(i).alias("o"), span(i + 2).alias("c")) for i in (0, 1)))
    at = _point(F.col("start_time"), F.col("pos"), F.col("span_id"), F.lit(0))
    full = found.select("trace_id", at.alias("at"), F.posexplode(both).alias("part", "p")).select("trace_id", "at", "part", "p.*")
    none = _point(F.lit(None).cast("timestamp"), F.lit(None).cast("int"), F.lit(None).cast("string"), F.col("part"))
    return _pairs(full, F.lit("pingpong"), 1, (F.col("at"), none))


def candidate_pairs(spans: DataFrame, n: int = 2, embedder: Embedder | None = None) -> DataFrame:
    """Both kinds of pairs; of equal ones the first.

    ``spans``: one row per span, or narrow rows. ``embedder``: the one that will score the pairs.
    The narrow rows are written once, and both kinds of pairs are found in them.
    """
    rows = store(spans if "input_key" in spans.columns else narrow(spans, embedder), "narrow").df
    both = repeat_pairs(rows, n).unionByName(pingpong_pairs(rows))
    key = ["trace_id", "oid", "cid"]
    keyed = both.withColumns({"oid": F.col("o.span_id"), "cid": F.col("c.span_id")})
    return keyed.groupBy(*key).agg(F.min_by(F.struct("rule", "ord", "o", "c"), "ord").alias("p")).select("trace_id", "p.*")


def shown(pairs: DataFrame, *more: str) -> DataFrame:
    return pairs.select("trace_id", F.col("o.span_id").alias("origin_id"), F.col("c.span_id").alias("candidate_id"), *more)
