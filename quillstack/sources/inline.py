"""Inline Markdown: the plain text of a run of source and the flat list of its constructs.

Emphasis leaves no node; its markers only have to go from the text, so delimiter runs are
matched but not nested. Escapes and entities stay as they are written.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Collection
from dataclasses import dataclass, field

from ..functions import rx

_AUTO_URL = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*)>")
_AUTO_MAIL = re.compile(r"<([A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*)>")
_HTML = re.compile(r"<(?:[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?|/[A-Za-z][A-Za-z0-9-]*\s*|!--.*?--|\?.*?\?|![A-Z]+\s[^>]*|!\[CDATA\[.*?\]\])>", re.S)
_BARE = re.compile(r"(?:https?://|ftp://|www\.)[^\s<]+|[A-Za-z0-9._+-]+@[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)+")
_DESTINATION = re.compile(r"<((?:[^<>\n\\]|\\.)*)>|((?:\\.|[^\s\\()]|\((?:\\.|[^\s\\()]|\([^\s()]*\))*\))*)")
_TITLE = re.compile(r"\"((?:\\.|[^\"\\])*)\"|'((?:\\.|[^'\\])*)'|\(((?:\\.|[^()\\])*)\)", re.S)
#: Without any of these, text is plain.
_SPECIAL = re.compile(r"[\\\n`<*_~\[\]@]|://|www\.")
#: The same but for line ends; what only bare links need; a stretch that is plain where there are none of those.
_MARKUP = re.compile(r"[\\`<*_~\[\]@]|://|www\.")
_LINKED = re.compile(r"@|://|www\.")
_PLAIN = re.compile(r"[^\\\n`<*_~\[\]!]+")
#: Words with a blank behind each: no bare link begins with one.
_WORDS = re.compile(r"(?:[A-Za-z0-9]+ )+")
_TICKS, _WORD, _NOTE_REF, _LABEL, _SPACE = (re.compile(x) for x in ("`+", r"[^\W_]+", r"\[\^([^\]\s]+)\]", r"\[((?:\\.|[^\[\]\\])*)\]", r"\s*"))
_RUNS = {c: re.compile(re.escape(c) + "+") for c in "*_~"}
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


@dataclass(slots=True)
class Piece:
    """A stretch of inline content; `inner` are the pieces of a link or image."""

    kind: str
    text: str = ""
    url: str = ""
    title: str = ""
    mail: bool = False
    inner: list[Piece] = field(default_factory=list)
    opens: bool = False
    closes: bool = False
    active: bool = True


def normal_label(label: str) -> str:
    return " ".join(label.split()).casefold()


def _is_space(c: str) -> bool:
    return not c or c.isspace()


def _is_punctuation(c: str) -> bool:
    return bool(c) and (c in PUNCTUATION or unicodedata.category(c)[0] in "PS")


def _flanks(text: str, a: int, b: int) -> tuple[bool, bool]:
    """Whether the delimiter run text[a:b] can open, and can close."""
    before, after = text[a - 1 : a], text[b : b + 1]
    left = not _is_space(after) and (not _is_punctuation(after) or _is_space(before) or _is_punctuation(before))
    right = not _is_space(before) and (not _is_punctuation(before) or _is_space(after) or _is_punctuation(after))
    if text[a] == "_":
        return left and (not right or _is_punctuation(before)), right and (not left or _is_punctuation(after))
    return left, right


def _strip_emphasis(pieces: list[Piece]) -> None:
    """Takes the matched markers out of the delimiter runs among the pieces."""
    k = 0
    while k < len(pieces):
        p = pieces[k]
        if p.kind != "run" or not p.closes or not p.text:
            k += 1
            continue
        for j in range(k - 1, -1, -1):
            o = pieces[j]
            if o.kind != "run" or not o.text or not o.opens or o.text[0] != p.text[0]:
                continue
            both = p.opens or o.closes
            if p.text[0] != "~" and both and (len(o.text) + len(p.text)) % 3 == 0 and (len(o.text) % 3 or len(p.text) % 3):
                continue
            if p.text[0] == "~" and len(o.text) != len(p.text):
                continue
            n = len(p.text) if p.text[0] == "~" else 2 if min(len(o.text), len(p.text)) >= 2 else 1
            o.text, p.text = o.text[n:], p.text[n:]
            for between in pieces[j + 1 : k]:
                if between.kind == "run":
                    between.opens = between.closes = False
            break
        else:
            p.closes = False
            k += 1
            continue
        if not p.text:
            k += 1


@functools.cache
def _ticks(n: int) -> re.Pattern:
    return re.compile(rf"(?<!`)`{{{n}}}(?!`)")


def _tail(text: str, at: int) -> tuple[str, str, int] | None:
    """Destination, title and end of an inline link's `(...)` at `at`."""
    k = _SPACE.match(text, at + 1).end()
    m = _DESTINATION.match(text, k)
    url = m[1] if m[1] is not None else m[2] or ""
    end = m.end()
    k = _SPACE.match(text, end).end()
    title = ""
    if k > end:
        t = _TITLE.match(text, k)
        if t:
            title = next(x for x in t.groups() if x is not None)
            k = _SPACE.match(text, t.end()).end()
    return (url, title, k + 1) if text[k : k + 1] == ")" else None


def _plain_lines(text: str) -> list[Piece]:
    """The pieces of text without any markup."""
    out: list[Piece] = []
    *lines, last = text.split("\n")
    for line in lines:
        stripped = line.rstrip(" ")
        if stripped:
            out.append(Piece("text", stripped))
        out.append(Piece("hard" if len(line) - len(stripped) >= 2 else "soft"))
    return [*out, Piece("text", last)] if last else out


def parse(text: str, links: dict[str, tuple[str, str]], notes: Collection[str]) -> list[Piece]:
    """The pieces of text. links: definitions by normal label; notes: footnote labels."""
    if not _SPECIAL.search(text):
        return [Piece("text", text)] if text else []
    if not _MARKUP.search(text):
        return _plain_lines(text)
    bare = _LINKED.search(text) is not None
    out: list[Piece] = []
    openers: list[tuple[int, int, bool]] = []  # (index in out, place behind the bracket, image)
    plain: list[str] = []

    def flush() -> None:
        if plain:
            out.append(Piece("text", "".join(plain)))
            plain.clear()

    at, n = 0, len(text)
    while at < n:
        if not bare and (m := _PLAIN.match(text, at)):
            plain.append(m.group())
            at = m.end()
            continue
        if bare and (m := _WORDS.match(text, at)):
            plain.append(m.group())
            at = m.end()
            continue
        c = text[at]
        if c == "\\" and at + 1 < n and text[at + 1] in PUNCTUATION:
            plain.append(text[at : at + 2])
            at += 2
        elif c == "\\" and text[at + 1 : at + 2] == "\n":
            flush()
            out.append(Piece("hard"))
            at += 2
        elif c == "\n":
            soft = "".join(plain)
            stripped = soft.rstrip(" ")
            plain[:] = [stripped] if stripped else []
            flush()
            out.append(Piece("hard" if len(soft) - len(stripped) >= 2 else "soft"))
            at += 1
        elif c == "`":
            run = _TICKS.match(text, at).group()
            m = _ticks(len(run)).search(text, at + len(run))
            if m is None:
                plain.append(run)
                at += len(run)
            else:
                flush()
                code = text[at + len(run) : m.start()].replace("\n", " ")
                if len(code) > 1 and code[0] == code[-1] == " " and code.strip():
                    code = code[1:-1]
                out.append(Piece("code", code))
                at = m.end()
        elif c == "<" and (m := _AUTO_URL.match(text, at) or _AUTO_MAIL.match(text, at)):
            flush()
            out.append(Piece("auto", url=m[1], mail=m.re is _AUTO_MAIL))
            at = m.end()
        elif c == "<" and (m := _HTML.match(text, at)):
            flush()
            out.append(Piece("html", m.group()))
            at = m.end()
        elif c in "*_~":
            run = _RUNS[c].match(text, at).group()
            opens, closes = _flanks(text, at, at + len(run))
            flush()
            ok = c != "~" or len(run) <= 2
            out.append(Piece("run", run, opens=opens and ok, closes=closes and ok))
            at += len(run)
        elif c == "[" and (m := _NOTE_REF.match(text, at)) and m[1] in notes:
            flush()
            out.append(Piece("note", m[1]))
            at = m.end()
        elif c == "[" or c == "!" and text[at + 1 : at + 2] == "[":
            flush()
            image = c == "!"
            at += 2 if image else 1
            openers.append((len(out), at, image))
            out.append(Piece("text", "![" if image else "["))
        elif c == "]":
            flush()
            at += 1
            if not openers:
                plain.append("]")
                continue
            index, start, image = openers.pop()
            if not out[index].active:
                plain.append("]")
                continue
            label, found = text[start : at - 1], None
            if text[at : at + 1] == "(":
                found = _tail(text, at)
            if found is None:
                m = _LABEL.match(text, at)
                name = m[1] if m and m[1].strip() else label
                if normal_label(name) in links:
                    found = (*links[normal_label(name)], m.end() if m else at)
            if found is None:
                plain.append("]")
                continue
            inner = out[index + 1 :]
            _strip_emphasis(inner)
            out[index:] = [Piece("image" if image else "link", url=found[0], title=found[1], inner=inner)]
            at = found[2]
            if not image:  # links don't hold links
                for k, _, other in openers:
                    if not other:
                        out[k].active = False
        elif c in "hwfHWF" or c.isalnum():
            before = text[at - 1 : at]
            m = _BARE.match(text, at) if not before or before.isspace() or before in "*_~(" else None
            if m is None:
                word = _WORD.match(text, at)
                end = word.end() if word else at + 1
                plain.append(text[at:end])
                at = end
                continue
            url = m.group()
            if "@" in url and not url.lower().startswith(("http", "ftp", "www")):
                url = url.rstrip("._-+")
                mail = True
            else:
                mail = False
                while url and (url[-1] in "?!.,:*_~'\"" or url[-1] == ")" and url.count(")") > url.count("(")):
                    url = url[:-1]
            flush()
            out.append(Piece("auto", url=url, mail=mail))
            at += len(url)
        else:
            plain.append(c)
            at += 1
    flush()
    _strip_emphasis(out)
    return out


def plain_text(pieces: list[Piece]) -> str:
    """Text without markers; line breaks, autolinks, HTML and notes add nothing."""
    return "".join(p.text if p.kind in ("text", "code", "run") else plain_text(p.inner) if p.inner else "" for p in pieces)


def constructs(pieces: list[Piece]):
    """Links, images, autolinks, code spans, hard breaks and notes, a link before what is in it."""
    for p in pieces:
        if p.kind in ("link", "image", "auto", "code", "hard", "note"):
            yield p
        if p.inner:
            yield from constructs(p.inner)


# --- constructs beyond Markdown, found by pattern in the source of a block ---

_SCAN = {name: re.compile(getattr(rx, name)) for name in ("EMBED", "WIKI", "ENTITY", "MENTION", "ISSUE", "COMMIT", "EMOJI", "MATH", "URL")}


def _int(s: str | None) -> int:
    return min(int(s), 2**63 - 1) if s and s.isascii() and s.isdigit() else 0


def embed_size(size: str | None) -> tuple[int, int]:
    """`W` or `WxH`; anything else counts as 0."""
    w, _, h = (size or "").partition("x")
    return _int(w), _int(h)


def scan(text: str, known_urls: set[str]):
    """(kind, attributes) of the constructs in text, family by family. known_urls: already links."""
    linked = "[[" in text  # what a pattern can't do without is looked for first
    for m in _SCAN["EMBED"].finditer(text) if linked else ():
        w, h = embed_size(m[4])
        yield "wiki_embed", {"target": m[1].strip(), "width": w, "height": h}
    for m in _SCAN["WIKI"].finditer(text) if linked else ():
        yield "wiki_link", {"target": m[2].strip(), "anchor": m[3] or "", "block": m[4] or "", "alias": m[5] or ""}
    for m in _SCAN["ENTITY"].finditer(text) if "&" in text else ():
        yield "entity", {"raw": m.group()}
    for m in _SCAN["MENTION"].finditer(text) if "@" in text else ():
        yield "mention", {"user": m[2]}
    for m in _SCAN["ISSUE"].finditer(text) if "#" in text or "GH-" in text else ():
        yield "issue_ref", {"repo": m[3] or "", "number": _int(m[2] or m[4] or m[5] or m[6])}
    for m in _SCAN["COMMIT"].finditer(text):
        yield "commit_ref", {"sha": m[1]}
    for m in _SCAN["EMOJI"].finditer(text) if ":" in text else ():
        yield "emoji", {"emoji": m[1]}
    for m in _SCAN["MATH"].finditer(text) if "$" in text else ():
        yield "inline_math", {"tex": m[1].strip()}
    seen = set(known_urls)
    for m in _SCAN["URL"].finditer(text) if "http" in text else ():
        url = m.group().rstrip(rx.URL_TAIL)
        if url not in seen:
            seen.add(url)
            yield "autolink", {"url": url, "is_bare": True}
