"""Sections from nodes, by windows over each document.

A section's parent is the nearest one before it with a lower level. With six levels that
is a matter of running maxima: the last section of each level so far, of which those are
still open that come after every section of a lower level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import key_terms, trimmed

LEVELS = range(1, 7)
#: Columns of nodes that sections are made of; with tokens or raw_text they have tokens or content.
NEEDS = ("node_id", "depth", "kind", "line_start", "line_end", "title", "level", "sec_id")

#: Columns that make sections without tokens and content from headings alone.
OUTLINED = ("depth", "kind", "line_start", "title", "level", "sec_id", "last_line")

#: Columns that make sections with their own content, outside of their tree, from headings alone.
OWN = ("depth", "kind", "title", "sec_id", "content")


def assigned(nodes: DataFrame) -> DataFrame:
    """Nodes with sec_id: the number of the heading that they are under, 0 before the first. The parser numbers them itself."""
    if "sec_id" in nodes.columns:
        return nodes
    so_far = Window.partitionBy("doc_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
    return nodes.withColumn("sec_id", F.sum(F.when((F.col("depth") == 1) & (F.col("kind") == "heading"), 1).otherwise(0)).over(so_far).cast("int"))


def outline(heads: DataFrame) -> DataFrame:
    """heads (doc_id, sec_id, level, ...): adds parent_id, path (of sec_ids from the root
    to the section) and depth. Any forest in pre-order whose levels are 1 to 6."""
    before = Window.partitionBy("doc_id").orderBy("sec_id").rowsBetween(Window.unboundedPreceding, -1)
    for k in LEVELS:
        heads = heads.withColumn(f"_l{k}", F.max(F.when(F.col("level") == k, F.col("sec_id"))).over(before))
    none = F.lit(None).cast("int")
    above = []
    for k in LEVELS:
        lower = F.greatest(*[F.coalesce(F.col(f"_l{j}"), F.lit(0)) for j in range(1, k)], F.lit(0), F.lit(0))
        above.append(F.when((F.col("level") > k) & (F.col(f"_l{k}") > lower), F.col(f"_l{k}")).otherwise(none))
    path = F.filter(F.array(*above), lambda x: x.isNotNull())
    heads = heads.withColumn("parent_id", F.try_element_at(path, F.lit(-1))).withColumn("path", F.concat(path, F.array("sec_id")))
    return heads.withColumn("depth", F.size("path")).drop(*[f"_l{k}" for k in LEVELS])


def sections(nodes: DataFrame) -> DataFrame:
    """The sections table of Markdown documents. tokens are those of the subtree,
    own_tokens those of the section itself; line_end is the subtree's last line.
    Nodes without tokens or raw_text: sections without tokens, or without content and key_terms."""
    counted, read = "tokens" in nodes.columns, "raw_text" in nodes.columns
    per = _headings(nodes) if "last_line" in nodes.columns and not counted and not read else _gathered(nodes, counted, read)
    ahead = F.lead("line_start").over(Window.partitionBy("doc_id").orderBy("sec_id"))
    per = per.withColumn("own_end", F.when(F.col("last_line") > 0, F.col("last_line")).otherwise(F.coalesce(ahead - 1, F.lit(0)))).drop("last_line")
    if read:
        per = per.withColumn("content", trimmed(F.array_join(F.transform("raws", lambda x: x["raw_text"]), "\n"))).drop("raws")
    per = outline(per)
    # A subtree's sums, from each section to all that it is under: at most six rows a section,
    # of which one carries its columns along. All of it stays where the windows put a document.
    carried = [c for c in per.columns if c not in ("doc_id", "own_end")]
    itself = F.col("step") == F.col("sec_id")
    steps = per.withColumn("step", F.explode("path")).select("doc_id", "step", "own_end", *["own_tokens"] * counted, *[F.when(itself, F.col(c)).alias(f"_{c}") for c in carried])
    sums = steps.groupBy("doc_id", "step").agg(*[F.first(f"_{c}", ignorenulls=True).alias(c) for c in carried], *[F.sum("own_tokens").alias("tokens")] * counted, F.max("own_end").alias("line_end")).drop("step")
    return sums.withColumn("key_terms", key_terms(F.col("content"))) if read else sums


def _headings(nodes: DataFrame) -> DataFrame:
    """Sections' rows where the parser has told each heading its last line: nothing else has to be moved."""
    heads = nodes.where("depth = 1 AND kind = 'heading'")
    return heads.select("doc_id", "sec_id", F.col("level").cast("int").alias("level"), "title", "line_start", "last_line").repartition("doc_id")


def _gathered(nodes: DataFrame, counted: bool, read: bool) -> DataFrame:
    """Sections' rows from all nodes at the top of their documents."""
    top = assigned(nodes).where("depth = 1 AND sec_id > 0").select("doc_id", *NEEDS, *["tokens"] * counted, *["raw_text"] * read).repartition("doc_id")
    own = F.col("kind") == "heading"
    return top.groupBy("doc_id", "sec_id").agg(
        F.max(F.when(own, F.col("level"))).cast("int").alias("level"),
        F.max(F.when(own, F.col("title"))).alias("title"),
        F.max(F.when(own, F.col("line_start"))).alias("line_start"),
        *[F.sum("tokens").alias("own_tokens")] * counted,
        F.coalesce(F.max_by(F.when(~own, F.col("line_end")), F.when(~own, F.col("node_id"))), F.lit(0)).alias("last_line"),
        *[F.array_sort(F.collect_list(F.when(~own, F.struct("node_id", "raw_text")))).alias("raws")] * read,
    )


def own(nodes: DataFrame) -> DataFrame:
    """(doc_id, sec_id, title, content, key_terms) of all sections. Where the parser has given headings their content nothing is moved."""
    if "content" not in nodes.columns:
        return sections(nodes).select("doc_id", "sec_id", "title", "content", "key_terms")
    heads = nodes.where("depth = 1 AND kind = 'heading'").select("doc_id", "sec_id", "title", trimmed(F.col("content")).alias("content"))
    return heads.withColumn("key_terms", key_terms(F.col("content")))


def breadcrumbs(secs: DataFrame) -> DataFrame:
    """(doc_id, sec_id, breadcrumb): titles from the root, joined by >."""
    steps = secs.select("doc_id", "sec_id", F.posexplode("path").alias("pos", "step"))
    titles = secs.select("doc_id", F.col("sec_id").alias("step"), "title")
    return steps.join(titles, ["doc_id", "step"]).groupBy("doc_id", "sec_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "title"))), lambda x: x["title"]), " > ").alias("breadcrumb"))


def find(secs: DataFrame, name: str) -> DataFrame:
    """The first section of each document whose title contains name, whatever the case."""
    hits = secs.where(F.contains(F.lower("title"), F.lower(F.lit(name))))
    rest = [c for c in secs.columns if c not in ("doc_id", "sec_id")]
    first = hits.groupBy("doc_id").agg(F.min_by(F.struct("sec_id", *rest), "sec_id").alias("s"))  # secs are made once
    return first.select(*[F.col(c) if c == "doc_id" else F.col("s")[c].alias(c) for c in secs.columns])


def subtree(secs: DataFrame, name: str) -> DataFrame:
    """The found section of each document with all below it."""
    root = find(secs, name).select("doc_id", F.col("sec_id").alias("root"))
    return secs.join(root, "doc_id").where(F.array_contains("path", F.col("root")))


def expand(secs: DataFrame, name: str, most: int = 50) -> DataFrame:
    """(doc_id, sec_id, title, lines, more): the first lines of the found section's own content."""
    lines = F.split("content", "\n")
    return find(secs, name).select("doc_id", "sec_id", "title", F.slice(lines, 1, most).alias("lines"), F.greatest(F.size(lines) - most, F.lit(0)).alias("more"))


def tree(secs: DataFrame) -> DataFrame:
    """Sections to show, with the flag of a last sibling: those below a blank title go."""
    blank = secs.where(F.trim("title") == "").select("doc_id", F.col("sec_id").alias("gone"))
    steps = secs.select("doc_id", "sec_id", F.explode("path").alias("gone")).join(blank, ["doc_id", "gone"], "left_semi").select("doc_id", "sec_id").distinct()
    shown = secs.join(steps, ["doc_id", "sec_id"], "left_anti")
    siblings = Window.partitionBy("doc_id", F.coalesce("parent_id", F.lit(0))).orderBy("sec_id")
    return shown.withColumn("last", F.lead("sec_id").over(siblings).isNull())


def document_totals(secs: DataFrame) -> DataFrame:
    """(doc_id, sections, total_tokens): tokens of a document of any kind are the sum over all its sections."""
    return secs.groupBy("doc_id").agg(F.count("*").alias("sections"), F.sum("tokens").alias("total_tokens"))
