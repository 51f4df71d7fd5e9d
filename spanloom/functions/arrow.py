"""Rows in and out of Arrow batches, for operators that run in Python workers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

_TYPES = {
    "string": pa.string(),
    "long": pa.int64(),
    "int": pa.int32(),
    "boolean": pa.bool_(),
    "double": pa.float64(),
    "binary": pa.binary(),
    "array<string>": pa.list_(pa.string()),
    "array<int>": pa.list_(pa.int32()),
    "array<double>": pa.list_(pa.float64()),
}


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a DDL string of the simple types that operators exchange."""
    return pa.schema([(name, _TYPES[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in batch.columns))


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns: Iterable = zip(*rows) if rows else [() for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
