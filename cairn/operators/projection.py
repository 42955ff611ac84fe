"""Search projection: documents of files, symbols and knowledge nodes."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.canonical import property_terms, truncated_utf8
from cairn.functions.text import extension, joined, normalized, sanitized

# Sizes that a search document keeps.
TITLE_CHARS, CONTENT_BYTES = 512, 131_072


def file_documents(files: DataFrame, source: Column) -> DataFrame:
    """Title is the path; content the path and the normalised source; metadata has extension, size and hash."""
    meta = F.to_json(F.struct(extension(F.col("path")).alias("extension"), F.col("size_bytes").alias("size_bytes"), F.sha2(source, 256).alias("sha")))
    return files.withColumns({"title": F.left("path", F.lit(TITLE_CHARS)), "content": joined([F.col("path"), normalized(sanitized(source))]), "metadata": meta, "source_type": F.lit("file")})


def symbol_documents(symbols: DataFrame) -> DataFrame:
    return symbols.withColumns({"title": F.left("name", F.lit(TITLE_CHARS)), "content": joined([F.col("name"), normalized(F.col("qualified_name")), F.col("kind")]), "source_type": F.lit("symbol")})


def node_documents(nodes: DataFrame) -> DataFrame:
    return nodes.withColumns({"title": F.left("name", F.lit(TITLE_CHARS)), "content": joined([normalized(F.col("name")), F.col("kind"), F.col("brand")]), "source_type": F.lit("knowledge_node")})


def by_type(documents: DataFrame) -> DataFrame:
    return documents.groupBy("source_type").agg(F.count(F.lit(1)).alias("documents"))


def _mapped(df: DataFrame, column: str, name: str, kind: str, arrow: pa.DataType, fn) -> DataFrame:
    kept = [c for c in df.columns if c != name]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in kept) + f", `{name}` {kind}"

    def run(parts):
        for part in parts:
            own = pa.array([fn(x) for x in part.column(part.schema.get_field_index(column)).to_pylist()], type=arrow)
            yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(c)) for c in kept], own], names=[*kept, name])

    return df.mapInArrow(run, schema)


def with_property_terms(df: DataFrame, column: str) -> DataFrame:
    """df with terms, the keys and scalars of a JSON column: recursion over unknown depth has no column expression."""
    return _mapped(df, column, "terms", "array<string>", pa.list_(pa.string()), property_terms)


def with_truncated(df: DataFrame, column: str, size: int = CONTENT_BYTES) -> DataFrame:
    """df with column cut to size bytes between code points."""
    return _mapped(df, column, column, "string", pa.string(), lambda x: truncated_utf8(x, size))
