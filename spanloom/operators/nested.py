"""Nested records to related flat tables, by Merkle subtree identities.

Each payload is parsed once. Bottom-up, every object gets the hash of its canonical form (sorted
keys; objects inside arrays stand in it by their own hash), so equal objects have equal ids wherever
they occur. ``objects`` stores each of them once; ``bridge`` keeps every occurrence with its link to
the span, to the enclosing occurrence and its ordinal there. Objects that aren't elements of an
array belong to the content of the object around them.

Both tables are one scan without a shuffle but for the final duplicate removal, whose key is
well spread; a payload is the unit of work.
"""

from __future__ import annotations

import hashlib
import json
import sys
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.arrow import arrow_schema, batch_of, rows_of
from spanloom.functions.strict_json import loads
from spanloom.functions.text import decode
from spanloom.operators.parallel import spread
from spanloom.sources.payloads import attributes, hex_id, spans_of

SLOTS = {"input": "input.value", "output": "output.value"}
_OCCURRENCE = (
    "dump_id long, span_id string, span_at int, slot string, obj_path string, parent_path string, "
    "ordinal int, object_id string, parent_object_id string, content string"
)


def slot_value(raw: Any) -> Any:
    """Text is parsed as strict JSON, twice if that gives a string; null where it doesn't parse."""
    for _ in range(2):
        if isinstance(raw, str):
            try:
                raw = loads(raw)
            except ValueError:
                return None
    return raw


def _valid(text: str) -> str:
    """Without lone surrogates, which escapes can make and UTF-8 can't hold."""
    return text if text.isascii() else text.encode("utf-8", "replace").decode()


def occurrences(root: Any, with_content: bool = True) -> list[tuple]:
    """(obj_path, parent_path, ordinal, object_id, parent_object_id, content) of each object in an array.

    ``ordinal`` counts the occurrences with the same parent, in the order of the text.
    """
    # containers in text order: value, step from its container, place of that, enclosing case, is a case
    nodes: list[tuple] = []
    stack: list[tuple] = [(root, "", -1, -1, False)]
    while stack:
        value, step, holder, case, element = stack.pop()
        here = len(nodes)
        is_case = element and isinstance(value, dict)
        nodes.append((value, step, holder, case, is_case))
        inner = here if is_case else case
        if isinstance(value, dict):
            children = [(v, k, here, inner, False) for k, v in value.items() if isinstance(v, (dict, list))]
        else:
            children = [(v, i, here, inner, True) for i, v in enumerate(value) if isinstance(v, (dict, list))]
        stack.extend(reversed(children))
    if not any(n[4] for n in nodes):
        return []

    kids: list[list[int]] = [[] for _ in nodes]
    for i, n in enumerate(nodes[1:], 1):
        kids[n[2]].append(i)
    forms: list[str | None] = [None] * len(nodes)
    ids: list[str | None] = [None] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        value, is_case = nodes[i][0], nodes[i][4]
        below = iter(kids[i])
        parts = []
        for k, v in value.items() if isinstance(value, dict) else enumerate(value):
            if not isinstance(v, (dict, list)):
                parts.append((k, json.dumps(v, default=str)))
                continue
            j = next(below)
            if nodes[j][4]:
                parts.append((k, '{"$object":"' + ids[j] + '"}'))
            else:
                parts.append((k, forms[j]))
                forms[j] = None
        if isinstance(value, dict):
            forms[i] = "{" + ",".join(json.dumps(k) + ":" + f for k, f in sorted(parts, key=lambda p: p[0])) + "}"
        else:
            forms[i] = "[" + ",".join(f for _, f in parts) + "]"
        if is_case:
            ids[i] = hashlib.blake2b(forms[i].encode(), digest_size=16).hexdigest()

    out: list[tuple] = []
    paths: dict[int, str] = {-1: "$"}
    counts: dict[int, int] = {}
    for i, (_, _, _, case, is_case) in enumerate(nodes):
        if not is_case:
            continue
        steps, at = [], i
        while at != case and nodes[at][2] >= 0:
            step = nodes[at][1]
            steps.append(f"[{step}]" if isinstance(step, int) else f".{step}")
            at = nodes[at][2]
        paths[i] = paths[case] + _valid("".join(reversed(steps)))
        ordinal = counts[case] = counts.get(case, -1) + 1
        out.append((paths[i], paths[case], ordinal, ids[i], ids[case] if case >= 0 else None, forms[i] if with_content else None))
    return out


def _parse(with_content: bool):
    schema = arrow_schema(_OCCURRENCE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(1_000_000)  # typed values nest as deep as the text does
        ready: list[tuple] = []
        for batch in batches:
            for dump_id, raw in rows_of(batch):
                if raw is None:
                    continue
                try:
                    payload = loads(decode(raw))
                except ValueError:
                    continue
                seen = set()
                for place, (span, raw_id) in enumerate(spans_of(payload)):
                    span_id, known = hex_id(raw_id), attributes(span)
                    at = place if span_id is None else None
                    for slot, key in SLOTS.items():
                        root = slot_value(known.get(key))
                        if isinstance(root, (dict, list)):
                            for o in occurrences(root, with_content):
                                # a span sent twice adds nothing new
                                if (mark := (span_id, at, slot, o[0], o[3])) not in seen:
                                    seen.add(mark)
                                    ready.append((dump_id, span_id, at, slot, *o))
                if len(ready) >= 5_000:
                    yield batch_of(ready, schema)
                    ready = []
        if ready:
            yield batch_of(ready, schema)

    return run


def explode_records(*dumps: DataFrame, with_content: bool = True) -> DataFrame:
    """Every occurrence of an object in an array, in either slot of each span of the payloads.

    Input: tables with ``dump_id`` and ``payload`` (others are ignored). Null, cut-off and other
    payloads that aren't JSON give no rows, nor do values that don't parse or hold no such object.
    An undecodable span id is null; ``span_at`` then tells such spans of a payload apart by their
    place in it, and is null for all others. Repeated rows repeat occurrences; see ``bridge``.
    """
    both = None
    for d in dumps:
        narrow = d.select(F.col("dump_id").cast("long").alias("dump_id"), F.col("payload").cast("binary").alias("payload"))
        narrow = spread(narrow)
        both = narrow if both is None else both.unionByName(narrow)
    return both.mapInArrow(_parse(with_content), _OCCURRENCE)


def bridge(found: DataFrame) -> DataFrame:
    """Each occurrence once, linked to its span and to the occurrence around it."""
    return found.drop("content").distinct()


def objects(found: DataFrame) -> DataFrame:
    """Each distinct object once: ``object_id``, ``content`` and the number of its occurrences."""
    return found.groupBy("object_id").agg(F.first("content").alias("content"), F.count("*").alias("n_occurrences"))
