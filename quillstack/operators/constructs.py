"""Notable constructs: lists and counts by section and document, and drill-down by kind.

Atomic constructs hide what is inside them, so that nothing counts twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import shown_html
from .sections import assigned

#: Kinds that are listed one by one, and those that are only counted.
LISTED = {"callout": "callouts", "table": "tables", "code_block": "code_blocks", "math_block": "math_blocks", "html_block": "html_blocks", "footnote_def": "footnotes", "definition_list": "definition_lists", "link_ref_def": "link_ref_defs"}
COUNTED = {"task_item": "tasks", "wiki_link": "wiki_links", "wiki_embed": "wiki_embeds", "mention": "mentions", "issue_ref": "issue_refs", "commit_ref": "commit_refs", "emoji": "emojis"}
COUNTERS = [*LISTED.values(), "tasks", "tasks_checked", *list(COUNTED.values())[1:]]
STATS = COUNTERS[8:]

# The names that a kind goes by.
ALIASES = {
    "code_block": "code codeblock code-block", "callout": "callout alert admonition", "table": "table", "math_block": "math", "footnote_def": "footnote footnotes", "definition_list": "deflist definition definitions",
    "link_ref_def": "linkref linkrefs ref refs", "html_block": "html", "task_item": "task tasks", "wiki_link": "wiki wikilink", "wiki_embed": "embed", "mention": "mention mentions", "issue_ref": "issue issues", "commit_ref": "sha commit", "emoji": "emoji",
}
#: Columns of nodes that say whether one counts for a section, and those that the counters read.
PLACED = ("kind", "under_atomic", "top_kind", "sec_id")
COUNTING = ("kind", "checked", "under_atomic", "raw")
#: Kinds that the counters read; every document has nodes at its top, so that those without constructs have a row of zeros.
SEEN = ("top", *LISTED, *COUNTED)
_KIND_OF = {name: kind for kind, names in ALIASES.items() for name in names.split()}


def kind_of(name: str) -> str | None:
    """The kind that a name means, whatever its case."""
    return _KIND_OF.get(name.lower())


def _counters(html):
    rows = [F.count_if((F.col("kind") == kind) & (html if kind == "html_block" else F.lit(True))).alias(name) for kind, name in LISTED.items()]
    rows.append(F.count_if(F.col("kind") == "task_item").alias("tasks"))
    rows.append(F.count_if((F.col("kind") == "task_item") & F.col("checked")).alias("tasks_checked"))
    return rows + [F.count_if(F.col("kind") == kind).alias(name) for kind, name in list(COUNTED.items())[1:]]


def summary(nodes: DataFrame) -> DataFrame:
    """Sixteen counters for each document, over all of it."""
    seen = nodes.where(~F.col("under_atomic")).select("doc_id", "kind", "checked", F.when(F.col("kind") == "html_block", F.col("raw")).alias("raw"))
    return seen.groupBy("doc_id").agg(*_counters(shown_html(F.col("raw"))))


def in_sections(nodes: DataFrame) -> DataFrame:
    """Nodes that count for a section: under a heading, but not in it, and not in an atomic construct."""
    return assigned(nodes).where((F.col("sec_id") > 0) & (F.col("top_kind") != "heading") & ~F.col("under_atomic"))


def section_stats(nodes: DataFrame) -> DataFrame:
    """(doc_id, sec_id) with the eight counters of constructs that are only counted."""
    return in_sections(nodes).groupBy("doc_id", "sec_id").agg(*[c for c, name in zip(_counters(F.lit(True)), COUNTERS, strict=True) if name in STATS])


def notables(nodes: DataFrame) -> DataFrame:
    """The constructs that are listed, by section."""
    return in_sections(nodes).where(F.col("kind").isin(*LISTED))


def drill_down(nodes: DataFrame, kind: str, language: str = "", variant: str = "") -> DataFrame:
    """Hits of a kind by section: listed kinds as a row each, counted kinds as a count.
    language narrows code blocks only, variant callouts only. Unknown kinds: no rows."""
    kind = kind_of(kind) or kind
    if kind in COUNTED:
        counts = section_stats(nodes).select("doc_id", "sec_id", F.col(COUNTED[kind]).alias("n")).where("n > 0")
        return counts.select("doc_id", "sec_id", F.lit(kind).alias("kind"), F.lit(None).cast("int").alias("line_start"), F.lit(None).cast("int").alias("line_end"), F.lit(None).cast("string").alias("detail"), F.col("n").cast("long"))
    hits = notables(nodes).where(F.col("kind") == kind)
    if language:
        hits = hits.where((F.col("kind") != "code_block") | (F.lower("language") == language.lower()))
    if variant:
        hits = hits.where((F.col("kind") != "callout") | (F.lower("variant") == variant.lower()))
    detail = F.coalesce("language", "variant", F.array_join("headers", ", "), "tex", "label", "ref_id", "raw", F.lit(""))
    return hits.select("doc_id", "sec_id", "kind", "line_start", "line_end", detail.alias("detail"), F.lit(1).cast("long").alias("n"))


def inventory(docs: DataFrame, nodes: DataFrame, secs: DataFrame) -> DataFrame:
    """A line for each document: sections, tokens (a section's counted under each that it
    is in, as total_tokens, and once, as total_tokens_exact) and the counters."""
    per = secs.groupBy("doc_id").agg(F.count("*").alias("sections"), F.sum("tokens").alias("total_tokens"), F.sum("own_tokens").alias("total_tokens_exact"))
    out = docs.select("doc_id", "filename").join(per, "doc_id", "left").join(summary(nodes), "doc_id", "left")
    return out.na.fill(0, ["sections", "total_tokens", "total_tokens_exact", *COUNTERS])


def totals(lines: DataFrame) -> DataFrame:
    """The sum of an inventory's lines, and the number of files."""
    return lines.agg(F.count("*").alias("files"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("sections", "total_tokens", "total_tokens_exact", *COUNTERS)])
