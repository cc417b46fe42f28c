"""Links between documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import markdown_target


#: Columns of nodes that references are made of.
NEEDS = ("node_id", "kind", "url", "text", "line_start")


def references(nodes: DataFrame) -> DataFrame:
    """(doc_id, ord, text, target, line): links to Markdown files, anchors taken off."""
    links = nodes.where("kind = 'link'").withColumn("target", markdown_target(F.col("url"))).where("target IS NOT NULL")
    return links.select("doc_id", F.col("node_id").alias("ord"), "text", "target", F.col("line_start").alias("line"), *["filename"] * ("filename" in nodes.columns))


def hubs(refs: DataFrame, least: int = 2, most: int = 5) -> DataFrame:
    """The targets with most links, ties by name."""
    return refs.groupBy("target").agg(F.count("*").alias("links")).where(F.col("links") >= least).orderBy(F.desc("links"), "target").limit(most)


def edges(refs: DataFrame, docs: DataFrame) -> DataFrame:
    """(filename, target, ord): each target of a file once, at its first place. docs aren't read where refs carry the filename."""
    named = refs if "filename" in refs.columns else refs.join(docs.select("doc_id", "filename"), "doc_id")
    return named.groupBy("filename", "target").agg(F.min("ord").alias("ord"))


def back_edges(refs: DataFrame, docs: DataFrame) -> DataFrame:
    """(target, filename): which files refer to a target."""
    return edges(refs, docs).select("target", "filename")


def resolved(refs: DataFrame, docs: DataFrame) -> DataFrame:
    """References whose target is a file of the corpus, with its doc_id."""
    return refs.join(docs.select(F.col("doc_id").alias("target_id"), F.col("filename").alias("target")), "target")
