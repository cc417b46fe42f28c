"""YAML to sections, from the parser's events, so that scalars keep their source text and aliases their place.

tokens are added up again at every level, over sums that hold lower ones already, as the
tool's totals do; own_tokens are those of a section's own scalar.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import yaml

TERM_MARKS = "./:@"
STRIPPED = "\"',;()[]{}"
#: libyaml's parser, where PyYAML has it, makes events in a third of the time. On texts with any of these the two aren't
#: always of one mind (tabs, explicit keys, tags, directives, block scalars, document marks, odd line ends): PyYAML's own reads those.
_ODD = re.compile(r"[\t?%!|>]|[^\n -~\xa0-\u2027\u202a-\ud7ff]|^(?:---|\.\.\.)", re.M)
_FAST = getattr(yaml, "CSafeLoader", None)


@dataclass
class Value:
    """A node of the document: kind is map, seq, scalar or alias."""

    kind: str
    line: int
    text: str = ""
    items: list = field(default_factory=list)
    anchor: Value | None = None


def _compose(text: str) -> Value | None:
    """The first document's tree."""
    if _FAST and not _ODD.search(text):
        try:
            return _tree(yaml.parse(text, Loader=_FAST))
        except yaml.YAMLError:
            pass  # whether it is one, and which, is for the other to say
    return _tree(yaml.parse(text, Loader=yaml.SafeLoader))


def _tree(events) -> Value | None:
    anchors: dict[str, Value] = {}
    stack: list[Value] = []
    root = None
    for e in events:
        line = e.start_mark.line + 1 if e.start_mark else 0
        if isinstance(e, yaml.MappingStartEvent | yaml.SequenceStartEvent):
            v = Value("map" if isinstance(e, yaml.MappingStartEvent) else "seq", line)
        elif isinstance(e, yaml.ScalarEvent):
            v = Value("scalar", line, e.value)
        elif isinstance(e, yaml.AliasEvent):
            if e.anchor not in anchors:
                raise yaml.YAMLError(f"unknown anchor {e.anchor}")
            v = Value("alias", line, anchor=anchors[e.anchor])
        elif isinstance(e, yaml.MappingEndEvent | yaml.SequenceEndEvent):
            stack.pop()
            continue
        elif isinstance(e, yaml.DocumentEndEvent):
            return root
        else:
            continue
        if getattr(e, "anchor", None) and v.kind != "alias":
            anchors[e.anchor] = v
        if stack:
            stack[-1].items.append(v)
        else:
            root = v
        if v.kind in ("map", "seq"):
            stack.append(v)
    return root


def short_title(text: str) -> str:
    """At most 60 bytes; longer ones end in dots, cut between characters."""
    text = text.strip()
    raw = text.encode()
    return text if len(raw) <= 60 else raw[:57].decode(errors="ignore") + "..."


def key_terms(text: str) -> list[str]:
    terms = (w.strip(STRIPPED) for w in text.split())
    return list(dict.fromkeys(t for t in terms if t and len(t.encode()) < 80 and any(m in t for m in TERM_MARKS)))[:5]


def last_line(v: Value, seen: frozenset = frozenset()) -> int:
    if id(v) in seen:
        return v.line
    seen = seen | {id(v)}
    return max([v.line, *(last_line(x, seen) for x in v.items), *([last_line(v.anchor, seen)] if v.anchor else [])])


@dataclass
class Section:
    level: int
    title: str
    start: int
    end: int
    content: str = ""
    tokens: int = 0
    own: int = 0
    terms: list = field(default_factory=list)
    kids: list = field(default_factory=list)


def _leaf(level: int, title: str, start: int, end: int, text: str) -> Section:
    n = len(text.encode()) // 4
    return Section(level, title, start, end, text, n, n, key_terms(text))


def _add_up(s: Section) -> int:
    s.tokens += sum(_add_up(k) for k in s.kids)
    return s.tokens


def _map_title(v: Value, index: int) -> str:
    pairs = list(zip(v.items[::2], v.items[1::2], strict=False))
    for k, x in pairs:
        if k.text.lower() in ("name", "id", "title") and x.kind == "scalar" and x.text:
            return x.text
    if pairs and pairs[0][0].kind == pairs[0][1].kind == "scalar" and pairs[0][1].text:
        return short_title(f"{pairs[0][0].text}: {pairs[0][1].text}")
    return f"[{index}]"


def _sections(v: Value | None, level: int, open_: frozenset = frozenset()) -> list[Section]:
    if v is None:
        return []
    if v.kind == "alias":
        return [] if id(v.anchor) in open_ else _sections(v.anchor, level, open_)
    open_ = open_ | {id(v)}
    if v.kind == "scalar":
        return [_leaf(level, short_title(v.text), v.line, v.line, v.text)]
    out: list[Section] = []
    if v.kind == "map":
        for key, x in zip(v.items[::2], v.items[1::2], strict=False):
            if x.kind == "scalar":
                s = _leaf(level, key.text, key.line, last_line(x), x.text)
            else:
                s = Section(level, key.text, key.line, last_line(x), kids=_sections(x, level + 1, open_))
                if s.kids:
                    _add_up(s)
            out.append(s)
        return out
    for index, x in enumerate(v.items):
        if x.kind in ("scalar", "alias"):
            out += _sections(x, level, open_)
        else:
            s = Section(level, _map_title(x, index) if x.kind == "map" else f"[{index}]", x.line, last_line(x), kids=_sections(x, level + 1, open_))
            _add_up(s)
            out.append(s)
    return out


def rows(text: str | None):
    """Section rows in pre-order, in the order of schemas.SECTIONS without doc_id. Raises yaml.YAMLError."""
    if not text or not text.strip():
        return
    number = 0

    def walk(s: Section, parent):
        nonlocal number
        number += 1
        own = number
        yield own, parent, s.level, s.title, s.content, s.own, s.tokens, s.terms, s.start, s.end
        for k in s.kids:
            yield from walk(k, own)

    for s in _sections(_compose(text), 1):
        yield from walk(s, None)
