"""Spans inside raw dump payloads: SDK arrays and OTLP documents in either spelling."""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator
from typing import Any

_HEX = re.compile(r"[0-9a-f]+")


def hex_id(raw: Any, digits: int = 16) -> str | None:
    """An id as lower hex digits, from hex with or without ``0x``, or from base64; else null."""
    if not isinstance(raw, str):
        return None
    text = raw.strip()
    low = text.lower()
    if low.startswith("0x") and len(low) <= digits + 2 and _HEX.fullmatch(low[2:]):
        return low[2:].zfill(digits)  # base64 may start with 0x too, and is read as such below
    if len(low) == digits and _HEX.fullmatch(low):
        return low
    try:
        data = base64.b64decode(text.replace("-", "+").replace("_", "/") + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None
    return data.hex() if len(data) * 2 == digits else None


def either(record: Any, snake: str) -> Any:
    """A field in snake or camel case."""
    if not isinstance(record, dict):
        return None
    if snake in record:
        return record[snake]
    head, *rest = snake.split("_")
    return record.get(head + "".join(x.capitalize() for x in rest))


def plain(typed: Any) -> Any:
    """A typed OTLP value without its wrapper; an empty value is null."""
    if not isinstance(typed, dict):
        return typed
    for kind in ("string_value", "bool_value", "double_value", "bytes_value"):
        if (value := either(typed, kind)) is not None:
            return value
    if (value := either(typed, "int_value")) is not None:
        try:
            return int(value)
        except (TypeError, ValueError):
            return value
    if (value := either(typed, "array_value")) is not None:
        return [plain(x) for x in _items(either(value, "values"))]
    if (value := either(typed, "kvlist_value")) is not None:
        return {x["key"]: plain(x.get("value")) for x in _items(either(value, "values")) if isinstance(x, dict) and isinstance(x.get("key"), str)}
    return None


def _items(value: Any) -> list:
    return value if isinstance(value, list) else []


def attributes(span: dict) -> dict[str, Any]:
    """Attributes by key; typed lists are undone, of a repeated key the last counts."""
    raw = span.get("attributes")
    if isinstance(raw, dict):
        return raw
    return {x["key"]: plain(x.get("value")) for x in _items(raw) if isinstance(x, dict) and isinstance(x.get("key"), str)}


def spans_of(payload: Any) -> Iterator[tuple[dict, Any]]:
    """Each span object of a parsed payload, with its raw span id."""
    if isinstance(payload, list):
        for span in payload:
            if isinstance(span, dict):
                context = span.get("context")
                yield span, either(context, "span_id") if isinstance(context, dict) else either(span, "span_id")
        return
    for resource in _items(either(payload, "resource_spans")):
        for scope in _items(either(resource, "scope_spans")):
            for span in _items(either(scope, "spans")):
                if isinstance(span, dict):
                    yield span, either(span, "span_id")
