"""Queries of the general problems: nested records and hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.operators.events import current_spans
from spanloom.operators.hierarchy import descendants, linked_cases, resolve_hierarchy
from spanloom.operators.nested import bridge, explode_records, objects
from spanloom.sources.tables import table


def _dumps(spark: SparkSession, d: str) -> list[DataFrame]:
    return [table(spark, d, "dump_sdk_json"), table(spark, d, "dump_otlp")]


def _forest(spark: SparkSession, d: str, **options) -> DataFrame:
    return resolve_hierarchy(current_spans(table(spark, d, "spans"), "parent_span_id", "start_time"), **options)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Each object in an array of a span's input or output, with its path and that of the one around it."""
    found = bridge(explode_records(*_dumps(spark, d), with_content=False).where("span_id IS NOT NULL"))
    return found.select("dump_id", "span_id", "slot", "obj_path", "parent_path").distinct()


def p2_objects(spark: SparkSession, d: str) -> DataFrame:
    """The distinct objects, stored once."""
    return objects(explode_records(*_dumps(spark, d)))


def p2_bridge(spark: SparkSession, d: str) -> DataFrame:
    """The occurrences of the objects, with ordinals and parents."""
    return bridge(explode_records(*_dumps(spark, d), with_content=False))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Spans far below their top, and those whose chain ends nowhere or in a circle."""
    return linked_cases(_forest(spark, d))


def p5_paths(spark: SparkSession, d: str) -> DataFrame:
    """Each span's path from the top, joined by ``/``."""
    from pyspark.sql import functions as F

    return _forest(spark, d, with_path=True).withColumn("path", F.concat_ws("/", "path"))


def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every span with each span below it."""
    return descendants(_forest(spark, d, with_path=True))


QUERIES = {f.__name__: f for f in (p2_found, p2_objects, p2_bridge, p5_found, p5_paths, p5_descendants)}

_CHAINS = """WITH RECURSIVE cs AS (
  SELECT trace_id, span_id, lower(span_id) AS k, CASE WHEN parent_span_id IS NULL OR parent_span_id = '' THEN NULL ELSE regexp_replace(lower(parent_span_id), '^0x', '') END AS p
  FROM (SELECT * FROM spans QUALIFY row_number() OVER (PARTITION BY trace_id, span_id ORDER BY ingested_at DESC, pos DESC) = 1)
), reached AS (
  SELECT trace_id, span_id, k, span_id AS top, 0 AS links, CASE WHEN p IS NULL THEN 'root' ELSE 'orphan' END AS kind, span_id AS path
  FROM cs c WHERE p IS NULL OR NOT EXISTS (SELECT 1 FROM cs u WHERE u.trace_id = c.trace_id AND u.k = c.p)
  UNION ALL
  SELECT c.trace_id, c.span_id, c.k, r.top, r.links + 1, r.kind, r.path || '/' || c.span_id FROM reached r JOIN cs c ON c.trace_id = r.trace_id AND c.p = r.k
), climb AS (
  SELECT trace_id, span_id, p, [k] AS seen FROM cs c WHERE NOT EXISTS (SELECT 1 FROM reached r WHERE r.trace_id = c.trace_id AND r.k = c.k)
  UNION ALL
  SELECT b.trace_id, b.span_id, c.p, list_append(b.seen, c.k) FROM climb b JOIN cs c ON c.trace_id = b.trace_id AND c.k = b.p AND NOT list_contains(b.seen, c.k)
), chains AS (
  SELECT trace_id, span_id, top AS top_span_id, links::BIGINT AS n_links, CASE links WHEN 0 THEN kind ELSE 'under_' || kind END AS link_state, path FROM reached
  UNION ALL
  SELECT trace_id, span_id, list_min(seen[list_position(seen, p):]), list_position(seen, p) - 1, CASE list_position(seen, p) WHEN 1 THEN 'cycle' ELSE 'under_cycle' END,
         array_to_string(list_reverse(seen[:list_position(seen, p)]), '/') FROM climb WHERE list_contains(seen, p)
)"""

SQL = {
    "p5_found": f"""{_CHAINS} SELECT trace_id, span_id, top_span_id, n_links, CASE link_state WHEN 'under_root' THEN 'deep' ELSE link_state END AS link_state
FROM chains WHERE link_state <> 'root' AND (link_state <> 'under_root' OR n_links >= 8)""",
    "p5_paths": f"{_CHAINS} SELECT * FROM chains",
    "p5_descendants": f"""{_CHAINS} SELECT trace_id, p[i] AS span_id, span_id AS descendant_id, len(p) - i AS n_links
FROM (SELECT trace_id, span_id, string_split(path, '/') AS p FROM chains), unnest(range(1, len(p))) AS t(i)""",
}
