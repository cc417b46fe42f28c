"""Search in titles, content and constructs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import trimmed
from .constructs import LISTED, PLACED, notables


#: Columns of nodes that hold what of a construct can be searched.
FIELDS = ("language", "code", "variant", "headers", "tex", "ref_id", "label", "url", "raw", "paragraphs")


#: Columns of nodes that can be searched without sections: each says what section it is of, and headings hold its content.
PASSED = ("depth", "title", "content", "sec_title", *PLACED, *FIELDS)


def search(secs: DataFrame | None, nodes: DataFrame, query: str) -> DataFrame:
    """Sections that contain query, whatever the case: (doc_id, sec_id, title, in_title, in_content, in_constructs).
    Nodes with the columns PASSED are searched in one pass, and only hits are moved; secs isn't read then."""
    has = lambda c: F.contains(F.lower(c), F.lower(F.lit(query)))
    kind = F.col("kind")
    field = (
        F.when(kind == "code_block", F.concat_ws("\n", "language", "code"))
        .when(kind == "callout", F.col("variant"))
        .when(kind == "table", F.array_join("headers", "\n"))
        .when(kind == "math_block", F.col("tex"))
        .when(kind == "footnote_def", F.col("ref_id"))
        .when(kind == "link_ref_def", F.concat_ws("\n", "label", "url"))
        .when(kind == "html_block", F.col("raw"))
    )
    below = F.when(kind == "callout", F.exists("paragraphs", has))  # paragraphs right below a callout
    holds = F.coalesce(has(field), F.lit(False)) | F.coalesce(below, F.lit(False))
    if "content" in nodes.columns:
        head = (F.col("depth") == 1) & (kind == "heading")
        listed = (F.col("sec_id") > 0) & (F.col("top_kind") != "heading") & ~F.col("under_atomic") & kind.isin(*LISTED)  # as notables()
        flags = {"in_title": head & has("title"), "in_content": head & has(trimmed(F.col("content"))), "in_constructs": listed & holds}
        hits = nodes.select("doc_id", "sec_id", F.col("sec_title").alias("title"), *[F.coalesce(c, F.lit(False)).alias(n) for n, c in flags.items()]).where("in_title OR in_content OR in_constructs")
        return hits.groupBy("doc_id", "sec_id").agg(F.first("title").alias("title"), *[F.max(n).alias(n) for n in flags])
    found = notables(nodes).where(holds).select("doc_id", "sec_id").distinct().withColumn("in_constructs", F.lit(True))
    rows = secs.select("doc_id", "sec_id", "title", has("title").alias("in_title"), has("content").alias("in_content")).join(found, ["doc_id", "sec_id"], "left").na.fill(False, ["in_constructs"])
    return rows.where("in_title OR in_content OR in_constructs")


def with_children(hits: DataFrame, secs: DataFrame, most: int = 5) -> DataFrame:
    """Hits with the titles of their first child sections, and how many more there are."""
    kids = secs.where("parent_id IS NOT NULL").select("doc_id", F.col("parent_id").alias("sec_id"), F.col("sec_id").alias("child"), F.col("title").alias("child_title"))
    kids = kids.join(hits.select("doc_id", "sec_id"), ["doc_id", "sec_id"], "left_semi").withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "sec_id").orderBy("child")))
    per = kids.groupBy("doc_id", "sec_id").agg(F.array_sort(F.collect_list(F.when(F.col("n") <= most, F.struct("child", "child_title")))).alias("c"), F.greatest(F.count("*") - most, F.lit(0)).alias("more"))
    per = per.select("doc_id", "sec_id", F.transform("c", lambda x: x["child_title"]).alias("children"), "more")
    return hits.join(per, ["doc_id", "sec_id"], "left").na.fill(0, ["more"])
