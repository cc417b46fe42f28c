"""Documents in, parsed tables out.

A corpus is any DataFrame of (doc_id, filename, format, content). Parsers run by document
in Arrow batches; Catalyst doesn't move filters below them, so narrow a corpus first.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .. import schemas
from . import markdown, yaml_tree

#: Rows that a parser holds before it hands them on.
BATCH_ROWS = 20_000


def _emit(rows, schema):
    arrow = to_arrow_schema(schema)
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in arrow]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)


def _parsed(docs: DataFrame, schema, rows_of, kept: tuple = ()) -> DataFrame:
    """Rows of each document: its id, what rows_of makes of its content, and its columns kept."""
    whole = T.StructType([*schema, *(docs.schema[c] for c in kept)])

    def run(batches):
        held = []
        for batch in batches:
            ids, contents, *rest = (batch.column(k) for k in range(2 + len(kept)))
            for doc, content, *more in zip(ids.to_pylist(), contents, *(c.to_pylist() for c in rest), strict=True):
                held += [(doc, *row, *more) for row in rows_of(content.as_py())]
                if len(held) >= BATCH_ROWS:
                    yield _emit(held, whole)
                    held = []
        yield _emit(held, whole)

    return docs.select("doc_id", "content", *kept).mapInArrow(run, whole)


def markdown_nodes(docs: DataFrame, compat: bool = False, columns: tuple | None = None, kinds: frozenset | None = None, kept: tuple = ()) -> DataFrame:
    """The nodes table: a row for each construct, in pre-order by node_id.

    columns, kinds: what is needed of it, which spares the rest from being made: columns
    beside doc_id, and nodes of these kinds or, with top, at the top of their document.
    kept: columns of docs that their nodes carry along, so that they needn't be joined again.
    """
    names = markdown.NAMES if columns is None else tuple(n for n in (*markdown.NAMES, *markdown.DERIVED) if n in columns)
    schema = T.StructType([f for f in [*schemas.NODES, *schemas.NAMED] if f.name in ("doc_id", *names)])
    return _parsed(docs, schema, lambda text: markdown.rows(text, compat, names, kinds), kept)


def _yaml_rows(text):
    import yaml

    try:
        return list(yaml_tree.rows(text))
    except yaml.YAMLError:
        return []


def yaml_sections(docs: DataFrame) -> DataFrame:
    """Sections of YAML documents; a document that can't be parsed has none."""
    return _parsed(docs, schemas.SECTIONS, _yaml_rows)


def _format(name):
    return F.when(F.lower(name).rlike(r"\.ya?ml$"), "yaml").when(F.lower(name).rlike(r"\.pdf$"), "pdf").otherwise("md")


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    """Documents below path: Markdown, YAML and PDF files that aren't hidden, named by their
    path from there; doc_id follows the order of names. content is null for PDF files,
    whose bytes are in raw."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    base = path.rstrip("/").removeprefix("file://")
    name = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/+", "/"), "^" + _quoted("/" + base.lstrip("/")) + "/?", "")
    rows = files.withColumn("filename", name).where(F.lower("filename").rlike(r"\.(md|pdf|ya?ml)$") & ~F.element_at(F.split("filename", "/"), -1).startswith("."))
    return _numbered(rows)


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """One file, read as Markdown unless its name says otherwise."""
    rows = spark.read.format("binaryFile").load(path).withColumn("filename", F.element_at(F.split("path", "/"), -1))
    return _numbered(rows)


def _quoted(s: str) -> str:
    import re

    return re.sub(r"([^A-Za-z0-9/_-])", r"\\\1", s)


def _numbered(files: DataFrame) -> DataFrame:
    """doc_id: a hash of the name, so that no global order has to be made; names are the order of views."""
    rows = files.withColumn("format", _format(F.col("filename")))
    text = F.when(F.col("format") != "pdf", F.decode("content", "UTF-8"))
    return rows.select(F.xxhash64("filename").alias("doc_id"), "filename", "format", text.alias("content"), F.when(F.col("format") == "pdf", F.col("content")).alias("raw"))


def from_manifest(manifests: DataFrame, column: str = "manifest") -> DataFrame:
    """Documents of JSON manifests {root, files: [{path, content}]}. Of equal paths the last
    stays; hidden files, other suffixes, paths with .. and manifests without a root go."""
    schema = "root string, files array<struct<path string, content string>>"
    rows = manifests.select(F.from_json(column, schema).alias("m")).where("m.root <> ''")
    files = rows.select(F.col("m.root").alias("root"), F.posexplode("m.files").alias("pos", "f")).select("root", "pos", F.col("f.path").alias("filename"), F.col("f.content").alias("content"))
    fine = F.lower("filename").rlike(r"\.(md|pdf|ya?ml)$") & ~F.element_at(F.split("filename", "/"), -1).startswith(".") & ~F.array_contains(F.split("filename", "/"), "..")
    last = files.where(fine).groupBy("root", "filename").agg(F.max_by("content", "pos").alias("content"))
    return last.select(F.xxhash64("root", "filename").alias("doc_id"), "root", "filename", _format(F.col("filename")).alias("format"), "content")
