"""What the views show, as column expressions: numbers, names and previews."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import plural

# How the kinds are called in the views.
NAMES = {
    "code_block": "code blocks", "callout": "callouts", "table": "tables", "math_block": "math blocks", "footnote_def": "footnotes", "definition_list": "definition lists", "link_ref_def": "link refs", "html_block": "HTML blocks",
    "task_item": "tasks", "wiki_link": "wiki links", "wiki_embed": "embeds", "mention": "mentions", "issue_ref": "issue refs", "commit_ref": "commit refs", "emoji": "emoji",
}


def kind_name(kind: Column) -> Column:
    """Plural name of a kind; other kinds go by their own."""
    names = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, kind), kind)


def short_number(n: Column) -> Column:
    """Thousands with one decimal and a k, rounded as the binary value of n / 1000 lies; below 1000 as it is.

    Of ties in decimal (n ends in 50), most lie a little off in binary. Where is told by
    what is left of n after 1000 times the quotient, taken exactly in two parts.
    """
    whole = n.cast("double")
    q = whole / 1000
    split = q * 134217729.0
    high = split - (split - q)
    low = q - high
    product = q * 1000
    left = (whole - product) - ((high * 1000 - product) + low * 1000)  # above 0: q is below n / 1000
    tenths = F.floor(n / 100).cast("long")
    up = F.when(n % 100 != 50, n % 100 > 50).when(left != 0, left < 0).otherwise(tenths % 2 == 1)
    tenths = tenths + up.cast("long")
    shown = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("k"))
    return F.when(n >= 1000, shown).otherwise(n.cast("string"))


def counted(n: Column, one: str, many: str | None = None) -> Column:
    """Number and name; null for 0. many: the name of several, where it isn't one with an s."""
    name = F.concat(F.lit(one), plural(n)) if many is None else F.when(n == 1, one).otherwise(many)
    return F.when(n > 0, F.concat(n.cast("string"), F.lit(" "), name))


def padded(text: Column, width: int) -> Column:
    """Filled with spaces to a width, never cut."""
    return F.when(F.length(text) < width, F.rpad(text, F.lit(width), F.lit(" "))).otherwise(text)


def clipped(text: Column, n: int) -> Column:
    """At most n bytes, cut between characters."""
    part = F.make_valid_utf8(F.substring(text.cast("binary"), 1, n).cast("string"))
    return F.when(F.octet_length(text) <= n, text).otherwise(F.regexp_replace(part, "�+$", ""))


def preview(text: Column, n: int) -> Column:
    """Texts over n bytes end in three dots, within n."""
    return F.when(F.octet_length(text) > n, F.concat(clipped(text, n - 3), F.lit("..."))).otherwise(text)


def centred(text: Column, width: int) -> Column:
    """Spaces in front that centre the text in a width of bytes; longer ones are cut to it."""
    n = F.octet_length(text)
    return F.when(n >= width, clipped(text, width)).otherwise(F.concat(F.repeat(F.lit(" "), F.floor((width - n) / 2).cast("int")), text))


def file_title(name: Column) -> Column:
    """Names over 50 bytes: three dots and the last 47."""
    tail = F.make_valid_utf8(F.substring(name.cast("binary"), -47, 47).cast("string"))
    return F.when(F.octet_length(name) > 50, F.concat(F.lit("..."), F.regexp_replace(tail, "^�+", ""))).otherwise(name)


def quoted(text: Column) -> Column:
    """In double quotes, with backslashes before quotes, backslashes, line ends and tabs."""
    for old, new in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return F.concat(F.lit('"'), text, F.lit('"'))


def code_language(language: Column, fenced: Column) -> Column:
    return F.when(F.coalesce(language, F.lit("")) != "", language).when(fenced, "(none)").otherwise("(indent)")
