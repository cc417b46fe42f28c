"""The inline scan as column expressions: the same constructs over any text column, all in the JVM."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rx

#: Construct -> (pattern, group that is its value; 0 is all of it).
FAMILIES = {
    "wiki_embed": (rx.EMBED, 1),
    "wiki_link": (rx.WIKI, 2),
    "entity": (rx.ENTITY, 0),
    "mention": (rx.MENTION, 2),
    "issue_ref": (rx.ISSUE, 0),
    "commit_ref": (rx.COMMIT, 1),
    "emoji": (rx.EMOJI, 1),
    "inline_math": (rx.MATH, 1),
    "url": (rx.URL, 0),
}


#: What a text must hold for a family's pattern to match at all: looking for it is far cheaper than the pattern.
NEEDS = {"wiki_embed": ("![[",), "wiki_link": ("[[",), "entity": ("&",), "mention": ("@",), "issue_ref": ("#", "GH-"), "emoji": (":",), "inline_math": ("$",), "url": ("http",)}


def values(text: Column, family: str) -> Column:
    """An array of the values of a family in text, in order."""
    pattern, group = FAMILIES[family]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    if family in NEEDS:
        held = [F.contains(text, F.lit(x)) for x in NEEDS[family]]
        found = F.when(functools.reduce(lambda a, b: a | b, held), found).otherwise(F.array().cast("array<string>"))
    if family == "url":
        return F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:!?)]+$", ""))
    if family == "issue_ref":
        return F.transform(found, lambda x: F.regexp_extract(x, r"([0-9]+)$", 1))
    if family in ("wiki_embed", "wiki_link", "inline_math"):
        return F.transform(found, lambda x: F.trim(x))
    return found


def counts(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """How often each family occurs in each row."""
    return df.select(id_col, *[F.size(values(F.coalesce(F.col(text_col), F.lit("")), f)).alias(f) for f in FAMILIES])
