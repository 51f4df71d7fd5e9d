"""Words and names, for Python workers and as JVM expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A maximal run of letters or digits (Unicode categories L and N): ``\w`` without the underscore.
WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """The lower-cased words of a text, in order.

    Lower-casing the text first is faster, and equal unless a letter lower-cases by its
    neighbours (capital sigma) or to more than one character (dotted capital I).
    """
    if "Σ" in text or "İ" in text:
        return [w.lower() for w in WORD.findall(text)]
    return WORD.findall(text.lower())


def decode(raw: bytes | None) -> str:
    """Text columns reach Python as bytes, so that broken encodings can't stop a job."""
    return "" if raw is None else raw.decode("utf-8", "replace")


def span_name(node: Column | str) -> Column:
    """Letters of a node's name, lower-cased; null where there are none."""
    letters = F.lower(F.regexp_replace(node, r"[^\p{L}]", ""))
    return F.when(F.length(letters) > 0, letters)
