"""Strings of JSON values with their pointers."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def escape_token(token: Column) -> Column:
    """A member name within a pointer."""
    return F.replace(F.replace(token, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def strings_of(value: object) -> Iterator[tuple[str, str]]:
    """(pointer, string) of every string in a decoded value, in reading order; nesting is no recursion."""
    stack = [("", value)]
    while stack:
        pointer, item = stack.pop()
        if isinstance(item, str):
            yield pointer or "/", item
        elif isinstance(item, dict):
            stack += [(f"{pointer}/{str(k).replace('~', '~0').replace('/', '~1')}", v) for k, v in reversed(item.items())]
        elif isinstance(item, list):
            stack += [(f"{pointer}/{i}", v) for i, v in reversed(list(enumerate(item)))]


def json_strings(rows: DataFrame, key: str, column: str) -> DataFrame:
    """key, pointer, value of every string of a JSON column. Texts that are no JSON have none."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = []
            for k, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                try:
                    value = json.loads(text) if text else None
                except ValueError:
                    continue
                found += [(k, pointer, string) for pointer, string in strings_of(value)]
            names = [key, "pointer", "value"]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((part.column(0).type, pa.string(), pa.string()))], names=names)

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, F.col(column).cast("string")).mapInArrow(run, f"`{key}` {kind}, pointer string, value string")
