"""The parsers over streams.

Parsing needs one document at a time, so that a stream of documents becomes a stream of
nodes without state or watermark; only sums over all documents keep any.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import constructs
from ..sources import corpus


def documents(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of documents from Parquet files of schemas.DOCS that arrive in path."""
    return spark.readStream.schema(schemas.DOCS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def nodes(docs: DataFrame, compat: bool = False) -> DataFrame:
    """The nodes of each document as it arrives; to be appended."""
    return corpus.markdown_nodes(docs, compat)


def totals(nodes_: DataFrame) -> DataFrame:
    """The counters over all documents so far; for the complete mode."""
    seen = nodes_.where(~F.col("under_atomic"))
    return seen.agg(*constructs._counters(~F.col("raw").startswith("<!--")))
