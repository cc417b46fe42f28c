"""The Markdown parser on small documents with every construct."""

from hypothesis import given, settings
from hypothesis import strategies as st

from quillstack.sources import inline, markdown

DOC = """---
title: x
---

Setext one
==========

Para with **bold**, `code`, a [link](guide.md#top "T") and <https://a.example>.  
hard break, \\
again; bare https://b.example/x, and <me@c.example>.

Setext two
---

# One

- [ ] open
- [x] done
  - [X] nested

1. a
2. b

5) five

> [!NOTE]
> body
lazy

> plain
> > inner

| A | B |
|:--|--:|
| 1 | x \\| y |
| 2 |

```python title=x
print(1)

```

~~~
~~~

    indented

$$
x^2
$$

<div>
text
</div>

<!-- note -->

Term
: first
: second

[ref]: http://r.example "Ref"

See [ref], [text][ref], ![img](p.png), [^n] and [[Page#Head|alias]], ![[pic.png|20x10]].
@user #12 org/repo#3 GH-4 abcdef0 :smile: $a$ &amp;

[^n]: The note
    goes on.

[^unused]: gone

***

##
"""


def kinds(nodes):
    return [n.kind for n in markdown._all(nodes)]


def one(kind, nodes):
    return [n for n in markdown._all(nodes) if n.kind == kind]


def test_constructs():
    nodes = markdown.parse(DOC)
    heads = [(n.attributes["level"], n.attributes["title"], n.attributes["is_setext"]) for n in one("heading", nodes)]
    assert heads == [(1, "Setext one", True), (2, "Setext two", True), (1, "One", False), (2, "", False)]
    assert [n.attributes["checked"] for n in one("task_item", nodes)] == [False, True, True]
    assert [n.attributes["variant"] for n in one("callout", nodes)] == ["note"] and len(one("blockquote", nodes)) == 2
    assert [(n.attributes["headers"], n.attributes["aligns"]) for n in one("table", nodes)] == [(["A", "B"], ["left", "right"])]
    assert [[c.attributes["_text"] for c in r.kids] for r in one("table_row", nodes)] == [["A", "B"], ["1", "x \\| y"], ["2", ""]]
    assert [(n.attributes["language"], n.attributes["fenced"], n.attributes["code"]) for n in one("code_block", nodes)] == [("python", True, "print(1)\n\n"), ("", True, ""), ("", False, "indented\n")]
    assert [n.attributes["tex"] for n in one("math_block", nodes)] == ["x^2"]
    assert [(n.attributes["ordered"], n.attributes["list_start"]) for n in one("list", nodes)] == [(False, 0), (False, 0), (True, 1), (True, 5)]
    assert [n.attributes["term"] for n in one("definition_term", nodes)] == ["Term"] and len(one("definition", nodes)) == 2
    assert [(n.attributes["label"], n.attributes["url"], n.attributes["link_title"]) for n in one("link_ref_def", nodes)] == [("ref", "http://r.example", "Ref"), ("^unused", "gone", "")]
    assert [n.attributes["ref_id"] for n in one("footnote_def", nodes)] == ["n"] and [n.attributes["ref_id"] for n in one("footnote_ref", nodes)] == ["1"]
    assert [(n.attributes["url"], n.attributes["text"]) for n in one("link", nodes)] == [("guide.md#top", "link"), ("http://r.example", "ref"), ("http://r.example", "text")]
    assert [(n.attributes["target"], n.attributes["anchor"], n.attributes["alias"]) for n in one("wiki_link", nodes)] == [("Page", "Head", "alias")]
    assert [(n.attributes["target"], n.attributes["width"], n.attributes["height"]) for n in one("wiki_embed", nodes)] == [("pic.png", 20, 10)]
    assert [(n.attributes["repo"], n.attributes["number"]) for n in one("issue_ref", nodes)] == [("", 12), ("org/repo", 3), ("", 4)]
    assert [(n.attributes["url"], n.attributes["is_bare"], n.attributes["is_mail"]) for n in one("autolink", nodes)] == [("https://a.example", False, False), ("https://b.example/x", True, False), ("me@c.example", False, True)]
    assert len(one("line_break", nodes)) == 2 and len(one("thematic_break", nodes)) == 1 and len(one("html_block", nodes)) == 2
    for kind in ("mention", "commit_ref", "emoji", "inline_math", "entity", "image", "frontmatter"):
        assert len(one(kind, nodes)) == 1, kind


def test_ranges():
    nodes = markdown.parse(DOC)
    assert (one("frontmatter", nodes)[0].start, one("frontmatter", nodes)[0].end) == (1, 3)
    assert (one("callout", nodes)[0].start, one("callout", nodes)[0].end) == (26, 28)
    assert [(n.start, n.end) for n in one("code_block", nodes)][0] == (39, 41)
    compat = markdown.parse(DOC, compat=True)
    assert compat[1].start == compat[1].end == 0 and {n.kind for n in compat if n.start == 0} == {"code_block", "thematic_break", "heading"}


def test_limits_of_syntax():
    assert kinds(markdown.parse("####### seven")) == ["paragraph"]
    assert kinds(markdown.parse("- - -")) == ["thematic_break"]
    assert kinds(markdown.parse("a\n---")) == ["heading"]
    assert kinds(markdown.parse("---\nnever closed")) == ["thematic_break", "paragraph"]
    assert kinds(markdown.parse("```\nopen")) == ["code_block"]
    assert markdown.parse("")  == []
    text = inline.plain_text(inline.parse("un**believ**able ***x*** **a *b* c** ~~s~~ *open `*`", {}, set()))
    assert text == "unbelievable x a b c s *open *"
    assert inline.embed_size("200") == (200, 0) and inline.embed_size("alias") == (0, 0)


def test_tokens():
    assert [markdown.tokens(x) for x in ("", "test", "hello world", "éé")] == [0, 1, 2, 1]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="#>-*+`~|:[]()!_<$\\ \n\tab1.=^&", max_size=80))
def test_any_text_parses(text):
    rows = list(markdown.rows(text))
    lines = text.count("\n") + 1
    seen = {None}
    for r in rows:
        number, parent, _, depth, _, start, end = r[:7]
        assert parent in seen and depth >= 1 and 0 <= start <= lines and 0 <= end <= lines + 1
        seen.add(number)
    assert [r[0] for r in rows] == list(range(len(rows)))
