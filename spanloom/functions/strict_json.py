"""Strict JSON: no NaN or Infinity, any depth, numbers of any length."""

from __future__ import annotations

import json
import re
from decimal import Decimal
from json.decoder import scanstring
from typing import Any

_SPACE = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"(-?(?:0|[1-9][0-9]*))(\.[0-9]+)?([eE][+-]?[0-9]+)?")
_LITERALS = {"null": None, "true": True, "false": False}


def _int(digits: str) -> int | Decimal:
    return int(digits) if len(digits) < 4000 else Decimal(digits)


def _refuse(name: str) -> Any:
    raise ValueError(f"not JSON: {name}")


_DECODER = json.JSONDecoder(parse_constant=_refuse, parse_int=_int)


def loads(text: str) -> Any:
    """The value of a JSON text; ValueError where it isn't one."""
    try:
        return _DECODER.decode(text)
    except RecursionError:
        return _loads_deep(text)


def _loads_deep(text: str) -> Any:
    """The same with a stack of its own, for texts nested deeper than the built-in parser goes."""
    open_: list[tuple[Any, str | None]] = []
    root: list[Any] = []
    into: Any = root
    key: str | None = None
    at, n = 0, len(text)

    def skip(i: int) -> int:
        return _SPACE.match(text, i).end()

    def read_key(i: int) -> tuple[str, int]:
        if text[i : i + 1] != '"':
            raise ValueError("key expected")
        name, i = scanstring(text, i + 1, True)
        i = skip(i)
        if text[i : i + 1] != ":":
            raise ValueError("colon expected")
        return name, skip(i + 1)

    at = skip(at)
    while True:
        c = text[at : at + 1]
        closed = False
        if c == "{" or c == "[":
            new: Any = {} if c == "{" else []
            _put(into, key, new)
            open_.append((into, key))
            into = new
            at = skip(at + 1)
            if text[at : at + 1] == ("}" if c == "{" else "]"):
                into, key = open_.pop()
                at, closed = at + 1, True
            elif c == "{":
                key, at = read_key(at)
                continue
            else:
                continue
        if not closed:
            if c == '"':
                value, at = scanstring(text, at + 1, True)
            elif m := _NUMBER.match(text, at):
                value = float(m[0]) if m[2] or m[3] else _int(m[1])
                at = m.end()
            else:
                for name, value in _LITERALS.items():
                    if text.startswith(name, at):
                        at += len(name)
                        break
                else:
                    raise ValueError("value expected")
            _put(into, key, value)
        while True:
            at = skip(at)
            if into is root:
                if at != n:
                    raise ValueError("more after the value")
                return root[0]
            c = text[at : at + 1]
            if c == ",":
                at = skip(at + 1)
                if isinstance(into, dict):
                    key, at = read_key(at)
                break
            if c != ("}" if isinstance(into, dict) else "]"):
                raise ValueError("comma or end expected")
            into, key = open_.pop()
            at += 1


def _put(into: Any, key: str | None, value: Any) -> None:
    if isinstance(into, dict):
        into[key] = value
    else:
        into.append(value)
