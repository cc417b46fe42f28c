"""What is at a line, and what has changed.

Ranges are joined by document; where a document may have very many of both, long ones are
cut into bins first, so that the join has an equality to shuffle by and no document's
rows all meet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Lines of a bin.
BIN = 64


def covering(ranges: DataFrame, points: DataFrame, start: str = "line_start", end: str = "line_end", line: str = "line") -> DataFrame:
    """Rows of ranges joined with the points (doc_id, line) that they cover, by document and bin.

    Never by broadcast: points are often exploded from a few columns, and many more than the plan takes them for.
    The rows keep the bin, _bin: grouped by it beside document and line, they needn't be moved again.
    """
    binned = ranges.where(F.col(end) >= F.col(start)).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / BIN), F.floor(F.col(end) / BIN))))
    dots = points.withColumn("_bin", F.floor(F.col(line) / BIN))
    return binned.join(dots.hint("merge"), ["doc_id", "_bin"]).where(F.col(line).between(F.col(start), F.col(end)))


def node_at(nodes: DataFrame, points: DataFrame, open_ended: bool = False) -> DataFrame:
    """(doc_id, line, node_id, kind): the last node in pre-order that covers each line.
    open_ended: nodes without a range cover every line, as with compat."""
    rows = nodes.select("doc_id", "node_id", "kind", "line_start", "line_end")
    hits = covering(rows.where("line_start > 0"), points).select("doc_id", "_bin", "line", "node_id", "kind")
    if open_ended:
        hits = hits.unionByName(rows.where("line_end = 0").join(points.hint("merge"), "doc_id").where("line_start <= line").select("doc_id", F.floor(F.col("line") / BIN).alias("_bin"), "line", "node_id", "kind"))
    return hits.groupBy("doc_id", "_bin", "line").agg(F.max(F.struct("node_id", "kind")).alias("n")).select("doc_id", "line", "n.node_id", "n.kind")


def section_at(secs: DataFrame, points: DataFrame) -> DataFrame:
    """(doc_id, line, sec_id, title): the innermost section that covers each line; a
    section without an end, of which a document has one at most (its last heading, with nothing below), is open."""
    rows = secs.select("doc_id", "sec_id", "title", "line_start", "line_end")
    hits = covering(rows, points).select("doc_id", "line", "sec_id", "title")
    open_ = rows.where("line_end = 0").join(points.hint("merge"), "doc_id").where("line_start <= line").select("doc_id", "line", "sec_id", "title")
    return hits.unionByName(open_).groupBy("doc_id", "line").agg(F.max(F.struct("sec_id", "title")).alias("s")).select("doc_id", "line", "s.sec_id", "s.title")


def changed_sections(secs: DataFrame, notable: DataFrame, changed: DataFrame) -> DataFrame:
    """Sections with changed lines of their own, or constructs that start on one:
    (doc_id, sec_id, title, own_lines, constructs).

    A line is a section's own if no child of it covers the line, too: of the sections that
    cover a line, six at most, those that are no other's parent.
    """
    touched = covering(secs.select("doc_id", "sec_id", "parent_id", "title", "line_start", "line_end"), changed)
    above = F.collect_set("parent_id").over(Window.partitionBy("doc_id", "_bin", "line"))
    per = touched.withColumn("above", above).groupBy("doc_id", "sec_id").agg(F.first("title").alias("title"), F.count_if(~F.array_contains("above", F.col("sec_id"))).alias("own_lines"))
    hit = notable.select("doc_id", "sec_id", F.col("line_start").alias("line")).join(changed.hint("merge"), ["doc_id", "line"], "left_semi").groupBy("doc_id", "sec_id").agg(F.count("*").alias("constructs"))
    return per.join(hit, ["doc_id", "sec_id"], "left").na.fill(0, ["constructs"]).where("own_lines > 0 OR constructs > 0").select("doc_id", "sec_id", "title", "own_lines", "constructs")
