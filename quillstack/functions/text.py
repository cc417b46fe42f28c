"""Column expressions on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rx


def tokens(text: Column) -> Column:
    """A fourth of the bytes, rounded down."""
    return F.floor(F.octet_length(text) / 4).cast("long")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def key_terms(content: Column) -> Column:
    """Bold stretches, then code spans, each once, five at most."""
    bold = F.transform(F.regexp_extract_all(content, F.lit(rx.BOLD), F.lit(0)), lambda x: trimmed(F.substring(x, F.lit(3), F.length(x) - 4)))
    code = F.transform(F.slice(F.regexp_extract_all(content, F.lit(rx.CODE), F.lit(1)), 1, 10), trimmed)
    short = lambda n: lambda x: (x != "") & (F.octet_length(x) < n)
    return F.slice(F.array_distinct(F.concat(F.filter(bold, short(50)), F.filter(code, short(40)))), 1, 5)


def plural(n: Column) -> Column:
    return F.when(n == 1, "").otherwise("s")


def html_tag(raw: Column) -> Column:
    """Name of the tag that raw starts with; comment for comments."""
    t = trimmed(raw)
    return F.when(t.startswith("<!--"), "comment").otherwise(F.regexp_extract(t, r"^<([^ >\n]*)", 1))


def shown_html(raw: Column) -> Column:
    """Whether an HTML block counts: neither a comment nor a closing tag."""
    return ~trimmed(raw).startswith("<!--") & ~trimmed(raw).startswith("</")


def markdown_target(url: Column) -> Column:
    """The target of a link to a Markdown file, without its anchor; null for other links."""
    target = F.substring_index(url, "#", 1)
    return F.when(target.endswith(".md"), target)


def snippet(text: Column) -> Column:
    """First line of a callout's text, behind its marker."""
    return F.trim(F.split(trimmed(F.regexp_replace(text, r"^\[![^\]]*\]", "")), "\n").getItem(0))
