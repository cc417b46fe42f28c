"""Lines of the views as tables: hits of a kind, what is at a line, sections' notes and documents' digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import display
from ..functions.display import counted, padded, preview
from ..functions.text import html_tag, plural, snippet
from . import lines
from .constructs import COUNTED, STATS, kind_of, notables, section_stats

_c = F.col
_s = lambda c: c.cast("string")


def with_snippets(nodes: DataFrame) -> DataFrame:
    """Nodes with snippet: the first line of a callout's body, which begins with a paragraph."""
    first = F.when(_c("kind") == "callout", snippet(F.try_element_at("paragraphs", F.lit(1))))
    return nodes.withColumn("snippet", F.coalesce(first, F.lit("")))


#: Columns of nodes that the lines of the views show.
SHOWN = ("node_id", "line_start", "line_end", "language", "fenced", "variant", "headers", "tex", "ref_id", "number", "label", "url", "link_title", "raw", "paragraphs")
DETAILED = (*SHOWN, "level", "title", "text", "ordered", "format")


def _hit(line: Column) -> Column:
    """A construct in the view of its kind."""
    kind, start, end = _c("kind"), _c("line_start"), _c("line_end")
    at = F.concat(F.lit(":"), padded(_s(start), 4), F.lit("  "))
    language = padded(display.code_language(_c("language"), _c("fenced")), 10)
    title = F.when(F.coalesce("link_title", F.lit("")) != "", F.concat(F.lit(' "'), _c("link_title"), F.lit('"'))).otherwise("")
    return (
        F.when((kind == "code_block") & (end > start), F.concat(F.lit(":"), _s(start), F.lit("-"), _s(end), F.lit("  "), language))
        .when(kind == "code_block", F.concat(F.lit(":"), _s(start), F.lit("     "), language))
        .when(kind == "callout", F.concat(at, padded(_c("variant"), 10), F.lit("  "), _c("snippet")))
        .when(kind == "table", F.concat(at, _s(F.size("headers")), F.lit("col  "), F.array_join("headers", " | ")))
        .when(kind == "math_block", F.concat(at, preview(_c("tex"), 60)))
        .when(kind == "footnote_def", F.concat(at, F.lit("^"), _c("ref_id")))
        .when(kind == "definition_list", F.concat(at, _s(_c("number")), F.lit(" terms")))
        .when(kind == "link_ref_def", F.concat(at, F.lit("["), _c("label"), F.lit("] → "), _c("url"), title))
        .when(kind == "html_block", F.concat(at, F.lit("<"), html_tag(_c("raw")), F.lit(">")))
        .otherwise(line)
    )


def type_hits(nodes: DataFrame, kind: str, language: str = "", variant: str = "") -> DataFrame:
    """(doc_id, sec_id, name, ord, line): the lines that the view of a kind has below each
    section, with the kind's name. Counted kinds: one line with their number. Unknown
    kinds: no rows. language narrows code blocks only, variant callouts only."""
    kind = kind_of(kind) or kind
    if kind in COUNTED:
        return _count_lines(nodes, [kind])
    hits = notables(nodes).where(_c("kind") == kind)
    if language:
        hits = hits.where((_c("kind") != "code_block") | (F.lower("language") == language.lower()))
    if variant:
        hits = hits.where((_c("kind") != "callout") | (F.lower("variant") == variant.lower()))
    return _hit_lines(hits)


def all_hits(nodes: DataFrame) -> DataFrame:
    """The lines of type_hits() for every kind that has a name, in one pass for those that are listed and one for those that are counted.
    Of nodes without node_id, for which the parser reads no inline content, ord is null."""
    return _hit_lines(notables(nodes)).unionByName(_count_lines(nodes, list(COUNTED)))


def _hit_lines(hits: DataFrame) -> DataFrame:
    order = _c("node_id") if "node_id" in hits.columns else F.lit(None).cast("int")
    return with_snippets(hits).select("doc_id", "sec_id", display.kind_name(_c("kind")).alias("name"), order.alias("ord"), _hit(F.concat(F.lit(":"), _s(_c("line_start")))).alias("line"))


def _count_lines(nodes: DataFrame, kinds: list[str]) -> DataFrame:
    def line(kind):
        n, name = _c(COUNTED[kind]), display.kind_name(F.lit(kind))
        done = F.concat(F.lit(" ("), _s(_c("tasks_checked")), F.lit(" done)")) if kind == "task_item" else F.lit("")
        return F.when(n > 0, F.struct(name.alias("name"), F.concat(_s(n), F.lit(" "), name, done).alias("line")))

    counts = section_stats(nodes).select("doc_id", "sec_id", F.explode(F.array(*[line(k) for k in kinds])).alias("hit")).where("hit IS NOT NULL")
    return counts.select("doc_id", "sec_id", "hit.name", F.lit(0).alias("ord"), "hit.line")


def node_details(nodes: DataFrame) -> DataFrame:
    """Nodes with detail: the line that says what a node is."""
    kind, start, end = _c("kind"), _s(_c("line_start")), _s(_c("line_end"))
    at = lambda name: F.concat(F.lit(name + " L"), start, F.lit("  "))
    span = lambda name: F.concat(F.lit(name + " L"), start, F.lit("-"), end)
    detail = (
        F.when(kind == "heading", F.concat(at("heading"), F.lit("level="), _s(_c("level")), F.lit("  "), display.quoted(_c("title"))))
        .when(kind == "paragraph", F.concat(span("paragraph"), F.lit("  "), preview(_c("text"), 80)))
        .when(kind == "code_block", F.concat(span("code"), F.lit("  lang="), display.code_language(_c("language"), _c("fenced"))))
        .when(kind == "callout", F.concat(at("callout"), F.lit("kind="), _c("variant"), F.lit("  "), _c("snippet")))
        .when(kind == "table", F.concat(at("table"), _s(F.size("headers")), F.lit("col  "), F.array_join("headers", " | ")))
        .when(kind == "list", F.concat(span("list"), F.lit("  "), F.when(_c("ordered"), "ordered").otherwise("unordered")))
        .when(kind == "blockquote", span("blockquote"))
        .when(kind == "math_block", F.concat(at("math"), _c("tex")))
        .when(kind == "html_block", F.concat(at("html"), html_tag(_c("raw"))))
        .when(kind == "footnote_def", F.concat(at("footnote"), F.lit("^"), _c("ref_id")))
        .when(kind == "link_ref_def", F.concat(at("link ref"), F.lit("["), _c("label"), F.lit("] → "), _c("url")))
        .when(kind == "definition_list", span("deflist"))
        .when(kind == "frontmatter", F.concat(span("frontmatter"), F.lit("  format="), _c("format")))
        .when(kind == "thematic_break", F.concat(F.lit("thematic break L"), start))
        .otherwise(F.concat(kind, F.lit(" L"), start, F.lit("-"), end))
    )
    return with_snippets(nodes).withColumn("detail", detail)


def line_view(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """found (doc_id, line, node_id) with the kind and detail of the node."""
    found = found.select("doc_id", "line", "node_id").hint("merge")  # many lines of a document may be asked for
    return node_details(nodes).select("doc_id", "node_id", "kind", "detail").join(found, ["doc_id", "node_id"]).select("doc_id", "line", "kind", "detail")


def details_at(nodes: DataFrame, points: DataFrame) -> DataFrame:
    """(doc_id, line, kind, detail): line_view() of lines.node_at() in one pass. A node is
    moved once, with its detail, and found where the join by document and bin has put it."""
    rows = node_details(nodes.where("line_start > 0")).select("doc_id", "node_id", "kind", "detail", "line_start", "line_end")
    hits = lines.covering(rows, points).groupBy("doc_id", "_bin", "line").agg(F.max(F.struct("node_id", "kind", "detail")).alias("n"))
    return hits.select("doc_id", "line", "n.kind", "n.detail")


def _piece() -> Column:
    """A construct in its section's note."""
    kind, at = _c("kind"), F.concat(F.lit(":"), _s(_c("line_start")))
    head = F.coalesce(F.try_element_at("headers", F.lit(1)), F.lit(""))
    head = F.when(F.octet_length(head) > 16, F.concat(display.clipped(head, 13), F.lit("..."))).otherwise(head)
    upto = F.when(_c("line_end") > _c("line_start"), F.concat(F.lit("-"), _s(_c("line_end")))).otherwise("")
    return (
        F.when(kind == "callout", F.concat(_c("variant"), F.lit(" "), at))
        .when(kind == "table", F.rtrim(F.concat(at, F.lit(" "), head)))
        .when(kind == "code_block", F.concat(display.code_language(_c("language"), _c("fenced")), F.lit(" "), at, upto))
        .when(kind == "html_block", F.concat(F.lit("<"), html_tag(_c("raw")), F.lit("> "), at))
        .when(kind == "footnote_def", F.concat(F.lit("^"), _c("ref_id"), F.lit(" "), at))
        .when(kind == "link_ref_def", F.concat(F.lit("["), _c("label"), F.lit("] "), at))
        .otherwise(at)
    )


#: Kinds whose group in a note begins with a number and a name; math has no plural.
_LABELLED = {"table": "table", "math_block": "math", "definition_list": "term", "link_ref_def": "ref"}
#: Counters in a note, in order: name, and whether it has a plural.
_STATS = (("wiki_links", "wiki", False), ("wiki_embeds", "embed", True), ("mentions", "mention", True), ("issue_refs", "issue", True), ("commit_refs", "commit", True), ("emojis", "emoji", False))


def notes(nodes: DataFrame, secs: DataFrame) -> DataFrame:
    """(doc_id, sec_id, note): what stands behind a section's title: its constructs by kind,
    kinds in the order of their first, then counters; without either its key terms."""
    shown = notables(nodes).where((_c("kind") != "html_block") | ~(html_tag(_c("raw")).startswith("/") | (html_tag(_c("raw")) == "comment")))
    one = F.struct("node_id", _piece().alias("piece"))
    groups = shown.groupBy("doc_id", "sec_id", "kind").agg(F.min("node_id").alias("first"), F.count("*").alias("n"), F.sum("number").alias("terms"), F.array_sort(F.collect_list(one)).alias("pieces"))
    n = F.when(_c("kind") == "definition_list", _c("terms")).otherwise(_c("n"))
    label = F.try_element_at(F.create_map(*[F.lit(x) for p in _LABELLED.items() for x in p]), _c("kind"))
    lead = F.coalesce(F.concat(_s(n), F.lit(" "), label, F.when(_c("kind") == "math_block", "").otherwise(plural(n)), F.lit(" ")), F.lit(""))
    group = F.concat(lead, F.array_join(F.transform("pieces", lambda x: x["piece"]), ", "))
    per = groups.select("doc_id", "sec_id", "first", group.alias("group")).groupBy("doc_id", "sec_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "group"))), lambda x: x["group"]), " · ").alias("groups"))
    tasks = F.concat(counted(_c("tasks"), "task"), F.lit(" ("), _s(_c("tasks_checked")), F.lit(" done)"))
    rest = [counted(_c(c), one, None if several else one) for c, one, several in _STATS]
    out = secs.select("doc_id", "sec_id", "key_terms").join(per, ["doc_id", "sec_id"], "left").join(section_stats(nodes), ["doc_id", "sec_id"], "left").na.fill(0, STATS)
    note = F.concat_ws(" · ", "groups", tasks, *rest)
    return out.select("doc_id", "sec_id", F.when(note != "", note).otherwise(F.array_join("key_terms", ", ")).alias("note"))


def summary_rows() -> Column:
    """Of the sixteen counters: up to three rows of text, without those that are 0."""
    tasks = F.concat(counted(_c("tasks"), "task"), F.lit(" ("), _s(_c("tasks_checked")), F.lit(" done)"))
    rows = (
        (counted(_c("callouts"), "callout"), counted(_c("tables"), "table"), counted(_c("code_blocks"), "code block"), counted(_c("math_blocks"), "math", "math"), counted(_c("footnotes"), "footnote"), counted(_c("definition_lists"), "deflist"), counted(_c("html_blocks"), "HTML", "HTML")),
        (tasks, counted(_c("wiki_links"), "wiki", "wiki"), counted(_c("wiki_embeds"), "embed")),
        (counted(_c("mentions"), "@mention"), counted(_c("issue_refs"), "#issue"), counted(_c("commit_refs"), "sha", "sha"), counted(_c("emojis"), "emoji", "emoji")),
    )
    return F.filter(F.array(*[F.concat_ws(" · ", *r) for r in rows]), lambda x: x != "")


def digest() -> Column:
    """A document's line in the list of its folder, from its inventory."""
    several = lambda c, name: F.when(_c(c) > 0, F.concat(_s(_c(c)), F.lit(" " + name)))
    tasks = F.when(_c("tasks") > 0, F.concat(_s(_c("tasks")), F.lit(" tasks ("), _s(_c("tasks_checked")), F.lit(" done)")))
    head = F.concat(_c("filename"), F.lit(" ("), display.short_number(_c("total_tokens")), F.lit(", "), _s(_c("sections")), F.lit(" §)"))
    return F.concat_ws(" · ", head, several("code_blocks", "code"), several("callouts", "callouts"), several("tables", "tables"), tasks, several("math_blocks", "math"), several("footnotes", "footnotes"), several("wiki_links", "wiki"), several("wiki_embeds", "embeds"))


def changed_constructs(nodes: DataFrame, changed: DataFrame) -> DataFrame:
    """(doc_id, sec_id, line, detail): constructs that are listed and start on a changed line."""
    hit = notables(nodes).join(changed.select("doc_id", _c("line").alias("line_start")).hint("merge"), ["doc_id", "line_start"], "left_semi")
    return node_details(hit).select("doc_id", "sec_id", _c("line_start").alias("line"), "detail")


def indents(tree: DataFrame) -> DataFrame:
    """tree (from sections.tree) with indent: the lines that lead to a section, from the
    last-sibling flags of the sections above it. Roots have none."""
    steps = tree.select("doc_id", "sec_id", F.posexplode("path").alias("pos", "step"))
    flags = tree.select("doc_id", _c("sec_id").alias("step"), "last")
    per = steps.join(flags, ["doc_id", "step"]).groupBy("doc_id", "sec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "last"))), lambda x: x["last"]).alias("flags"))
    above = F.transform(F.slice("flags", F.lit(2), F.greatest(F.size("flags") - 2, F.lit(0))), lambda x: F.when(x, "    ").otherwise("│   "))
    own = F.when(F.size("flags") == 1, "").when(F.element_at("flags", -1), "└── ").otherwise("├── ")
    return tree.join(per.select("doc_id", "sec_id", F.concat(F.array_join(above, ""), own).alias("indent")), ["doc_id", "sec_id"])
