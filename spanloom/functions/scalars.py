"""Scalar expressions over span attributes and texts, all JVM-side but for JSON traversal."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from spanloom.schema import GO_F1, GO_FPR, KILL_F1, KILL_FPR, RAW_KINDS, SNIPPET

#: White space as text stripping in the source format understands it (fixed values).
_BLANK_RANGES = ((0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
_BLANK = "".join(chr(c) for first, last in _BLANK_RANGES for c in range(first, last + 1))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANK))


def is_blank(text: Column) -> Column:
    return F.coalesce(F.length(strip(text)) == 0, F.lit(True))


def fold(text: Column) -> Column:
    """Case folding: letters that differ by case only become equal, ``ß`` equals ``ss``.

    Upper and lower case together fold all letters but the dotless i, which upper case would merge
    with i, and the sigma, which lower case would set by context. (Lower case applied to upper case
    directly would be simplified to lower case alone.)
    """
    upper = F.upper(F.translate(text, "ı", "\ue000"))
    every = F.translate(F.lower(F.translate(upper, "Σ", "σ")), "\ue000", "ı")
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(every)


def normal_input(text: Column) -> Column:
    """Inputs are the same if they differ in surrounding white space and case only."""
    return fold(strip(text))


def span_kind(raw: Column) -> Column:
    """The kind by exact upper-case name; anything else is a chain."""
    kinds = F.create_map(*(F.lit(x) for pair in RAW_KINDS.items() for x in pair))
    return F.coalesce(F.try_element_at(kinds, raw), F.lit("chain"))


def hex_digits(raw: Column, digits: int) -> Column:
    """An id filled up with zeros; null if it is longer than that."""
    plain = F.regexp_replace(F.lower(raw), "^0x", "")
    return F.when(F.length(plain) <= digits, F.lpad(plain, digits, "0"))


def from_nanos(nanos: Column) -> Column:
    """Nanoseconds since 1970, cut to microseconds."""
    return F.timestamp_micros(((nanos - F.pmod(nanos, F.lit(1000))) / 1000).cast("long"))


def token_count(raw: Column) -> Column:
    """A whole number, or the whole part of a decimal one; null where it is neither."""
    return F.coalesce(raw.try_cast("bigint"), raw.try_cast("double").try_cast("bigint"))


def or_else(first: Column, second: Column) -> Column:
    """The first, or the second where the first is null or empty."""
    return F.coalesce(F.nullif(first, F.lit("")), second)


def snippet(text: Column) -> Column:
    return F.substring(text, 1, SNIPPET)


def after_prefix(text: Column) -> Column:
    """What follows the first colon and space; the whole text where there is none."""
    at = F.instr(text, ": ")
    return F.when(at == 0, text).otherwise(text.substr(at + 2, F.length(text)))


def verdict(f1: Column, fpr: Column) -> Column:
    return F.when((f1 >= GO_F1) & (fpr <= GO_FPR), "GO").when((f1 < KILL_F1) | (fpr > KILL_FPR), "KILL").otherwise("GREY")


def holds_any(text: Column, hints: list[str]) -> Column:
    low = F.lower(text)
    found = F.lit(False)
    for h in hints:
        found = found | low.contains(h.lower())
    return found


def stable_seed(*parts: object) -> int:
    """A number that depends on the parts only: the first eight bytes of a hash of them."""
    return int.from_bytes(hashlib.sha256("\0".join(map(str, parts)).encode()).digest()[:8], "big")


def _longest_leaf(raw: str | None) -> str | None:
    if raw is None:
        return None
    try:
        todo = [json.loads(raw)]
    except (ValueError, RecursionError):
        return raw
    best = ""
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            if len(x) > len(best) and x.strip():
                best = x
        elif isinstance(x, dict):
            todo.extend(reversed(x.values()))
        elif isinstance(x, list):
            todo.extend(reversed(x))
    return best or raw


@F.pandas_udf(StringType())
def _leaves(texts: pd.Series) -> pd.Series:
    return texts.map(_longest_leaf)


def longest_leaf(text: Column) -> Column:
    """The longest string inside a JSON text, the first of equals; other texts as they are.

    Only texts that can be JSON containers or strings go to Python; the others cross as nulls.
    """
    json_like = text.rlike(r'^[ \t\r\n]*[\[{"]')
    return F.when(json_like, _leaves(F.when(json_like, text))).otherwise(text)
