"""Canonical JSON: keys sorted, nulls kept, numbers in their shortest form; and hashes of it."""

from __future__ import annotations

import hashlib
import json
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical(value) -> str:
    """The one text of a JSON value. Whole doubles print without a fraction; NaN and infinities are refused."""

    def plain(v):
        if isinstance(v, float):
            if not math.isfinite(v):
                raise ValueError("JSON has no such number")
            return int(v) if v.is_integer() and abs(v) < 2**53 else v
        if isinstance(v, dict):
            return {str(k): plain(x) for k, x in v.items()}
        return [plain(x) for x in v] if isinstance(v, list | tuple) else v

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def fingerprint(value) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def array_hash(*columns: str) -> Column:
    """SHA-256 of a JSON array of scalar columns, nulls kept; stays in the JVM: a null becomes the word itself."""
    parts = [F.coalesce(F.regexp_replace(F.to_json(F.array(F.col(c))), r"^\[(.*)\]$", "$1"), F.lit("null")) for c in columns]
    return F.sha2(F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]")), 256)


def identity(prefix: str, *parts: str | Column) -> Column:
    """A stable identity: the prefix and the SHA-256 of the parts as a JSON array of strings."""
    own = [(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]
    return F.concat(F.lit(prefix + ":"), F.sha2(F.to_json(F.array(*own)), 256))


def with_fingerprint(df: DataFrame, column: str, name: str = "content_fingerprint") -> DataFrame:
    """df with the fingerprint of a column of JSON text, by Arrow batches; null for null or invalid JSON."""
    return _with(df, column, name, fingerprint)


def with_canonical(df: DataFrame, column: str, name: str = "canonical") -> DataFrame:
    """df with the canonical form of a column of JSON text, by Arrow batches; null for null or invalid JSON."""
    return _with(df, column, name, canonical)


def _with(df: DataFrame, column: str, name: str, fn) -> DataFrame:
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{name}` string"

    def run(parts):
        for part in parts:
            out = []
            for text in part.column(part.schema.get_field_index(column)).to_pylist():
                try:
                    out.append(None if text is None else fn(json.loads(text)))
                except ValueError:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, type=pa.string())], names=[*part.schema.names, name])

    return df.mapInArrow(run, schema)


def property_terms(text: str | None, depth: int = 5, most: int = 1000) -> list[str]:
    """Keys and scalars of a JSON value, depth first, keys in sorted order: at most `most`, at most `depth` levels."""
    out: list[str] = []

    def walk(v, level: int) -> None:
        if len(out) >= most or level > depth:
            return
        if isinstance(v, dict):
            for k in sorted(v):
                if len(out) < most:
                    out.append(k)
                    walk(v[k], level + 1)
        elif isinstance(v, list):
            for x in v:
                walk(x, level + 1)
        elif v is not None:
            out.append(str(v).lower() if isinstance(v, bool) else str(v))

    try:
        walk(json.loads(text) if text else None, 0)
    except ValueError:
        return []
    return out[:most]


def truncated_utf8(text: str | None, size: int) -> str | None:
    """At most size bytes, no code point cut."""
    return None if text is None else text.encode("utf-8", "replace")[:size].decode("utf-8", "ignore")
