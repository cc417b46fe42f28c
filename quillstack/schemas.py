"""Schemas of the canonical tables: docs, nodes, sections, refs."""

from __future__ import annotations

from pyspark.sql import types as T

from .sources.markdown import DERIVED, FLAGS, LISTS, NUMBERS, TEXTS

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("filename", T.StringType()), T.StructField("format", T.StringType()), T.StructField("content", T.StringType())])

#: 0 and "" stand for unknown, as ranges do in the views; attributes are null where they don't apply.
NODES = T.StructType(
    [T.StructField("doc_id", T.LongType())]
    + [T.StructField(n, T.IntegerType()) for n in ("node_id", "parent_id", "top_ord", "depth")]
    + [T.StructField("kind", T.StringType())]
    + [T.StructField(n, T.IntegerType()) for n in ("line_start", "line_end", "tokens")]
    + [T.StructField("under_atomic", T.BooleanType()), T.StructField("top_kind", T.StringType()), T.StructField("raw_text", T.StringType())]
    + [T.StructField(n, T.StringType()) for n in TEXTS]
    + [T.StructField(n, T.LongType()) for n in NUMBERS]
    + [T.StructField(n, T.BooleanType()) for n in FLAGS]
    + [T.StructField(n, T.ArrayType(T.StringType())) for n in LISTS]
    + [T.StructField(n, T.IntegerType()) for n in ("sec_id", "last_line")]
)

#: Columns that the Markdown parser adds where they are named.
NAMED = [T.StructField(n, T.StringType()) for n in DERIVED]

#: Sections as the YAML and PDF parsers give them.
SECTIONS = T.StructType(
    [T.StructField("doc_id", T.LongType())]
    + [T.StructField(n, T.IntegerType()) for n in ("sec_id", "parent_id", "level")]
    + [T.StructField(n, T.StringType()) for n in ("title", "content")]
    + [T.StructField(n, T.LongType()) for n in ("own_tokens", "tokens")]
    + [T.StructField("key_terms", T.ArrayType(T.StringType()))]
    + [T.StructField(n, T.IntegerType()) for n in ("line_start", "line_end")]
)
