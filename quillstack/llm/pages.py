"""HTML extraction by consensus host paths.

First pass: every page's containers are scored by the running text right below them, and
the page votes with its best few. A vote is for a generalised path: the tags from the
body down with their classes, digits taken out. Spark adds the votes up per host, path and
hash of the container's text, then per host and path; a path's votes count by the share of
its texts that differ, so that a long notice that every page repeats loses to articles.
All sums are combined before their shuffle. The path with most votes wins; paths whose
texts repeat several times as much as its own are the host's furniture. Second pass: every page's text is taken from
the containers at its host's winning path, or, where it has none, from its own best one.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

# Fixed lists of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - frozenset("body html caption tbody td tfoot th thead tr legend optgroup option".split())
# What a start tag ends, and where the search for it stops.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"})}
P_SCOPE = frozenset("td th table caption button object html body li dd dt blockquote div section article main".split())
# Never part of an article.
SKIPPED = frozenset("head nav footer aside form script style noscript template iframe svg math canvas select button input textarea object embed audio video menu dialog title xmp noembed noframes".split())
CONTAINERS = frozenset("article main section div td body blockquote".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

# Words in class, id and role that mark what isn't the article: whole words, and beginnings.
HINTS = frozenset("ad ads adv advert adverts advertisement advertising adslot sponsor sponsored promo promoted promotion sidebar side rail menu nav navbar navigation breadcrumb breadcrumbs pager pagination footer foot copyright masthead topbar cookie cookies consent gdpr notice notices banner alert popup modal overlay paywall subscribe subscription newsletter signup login share sharing social related recommended recommendations trending popular widget comment comments commentlist discussion disqus respond reply replies tags toolbar skip complementary contentinfo search hidden".split())
STARTS = ("advert", "sidebar", "comment", "cookie", "breadcrumb", "newsletter", "sponsor", "pagination", "navbar", "navigation")
# Parts of articles, whatever they are called.
UNHINTED = frozenset("body html main article figure figcaption picture pre code blockquote h1 h2 h3 h4 h5 h6 em strong b i".split())
# What follows these in a class is about the page or its subject, not what the element is (has-sidebar, tag-search).
ABOUT = frozenset("has have with without no category tag".split())
# Of hinted elements, those that are often longer than the article.
LONG = ("comment", "discussion", "disqus", "respond", "repl", "cookie", "consent", "gdpr", "popup", "modal", "overlay", "newsletter", "paywall")
#: How many times as often as the winner's texts those of a host's furniture repeat.
REPEATS = 3
SITE_HEADERS = frozenset("header siteheader pageheader".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>?", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\bhidden\b")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    __slots__ = ("children", "classes", "hint", "parent", "score", "skipped", "tag")

    def __init__(self, tag: str, parent: Node | None, classes: str = "", skipped: bool = False, hint: str = ""):
        self.tag, self.parent, self.classes, self.skipped, self.hint = tag, parent, classes, skipped or bool(hint), hint
        self.children: list = []
        self.score = 0.0


def _words(name: str) -> list[str]:
    """Words of a class, id or role that say what the element is."""
    words = [w.lower() for w in _WORD.findall(name)]
    return words[: next((k for k, w in enumerate(words[:-1]) if w in ABOUT), len(words))]


def _describe(tag: str, attributes: str) -> tuple[str, bool, str]:
    """Generalised classes, whether the element is skipped, and the words that hint at its not being of the article."""
    skipped = tag in SKIPPED
    if not attributes or attributes.isspace():
        return "", skipped, ""
    classes, named, hint = "", "", ""
    for m in _ATTRIBUTE.finditer(attributes):
        name = (m[1] or "hidden").lower()
        value = m[2] or m[3] or m[4] or ""
        if name == "class":
            classes = value
            named += " " + value
        elif name in ("id", "role"):
            named += " " + value
        elif name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            skipped = True
    if named and tag not in UNHINTED:
        words = [w for n in named.split() for w in _words(n)]
        found = {w for w in words if w in HINTS or w.startswith(STARTS)}
        if tag != "header" and not any(w in ("article", "entry", "post", "story") for w in words):
            found |= SITE_HEADERS.intersection(words)
        hint = " ".join(sorted(found))
    elif named and tag == "article":
        skipped = skipped or any(w.startswith("comment") for w in (x.lower() for x in _WORD.findall(named)))
    return ".".join(sorted({re.sub(r"\d+", "#", c.lower()) for c in classes.split()})), skipped, hint


def _judge(root: Node) -> None:
    """Hinted elements stay skipped only where the page has other running text to be its article.

    Elements with the same hints, within elements with the same hints, are judged together,
    those with most text first: they count as part of the page where they hold over four
    times the running text of what does so far (those in LONG: twenty times).
    """
    kinds: dict[tuple[int, str], int] = {}
    above, hints, held = [-1], [""], [0]
    nodes: list[tuple[Node, int]] = []
    todo: list[tuple[Node, int, bool]] = [(root, 0, False)]
    while todo:
        node, kind, header = todo.pop()
        for c in node.children:
            if isinstance(c, str):
                held[kind] += 0 if header else len("".join(c.split()))
            elif c.hint:
                if (kind, c.hint) not in kinds:
                    kinds[kind, c.hint] = len(held)
                    above.append(kind)
                    hints.append(c.hint)
                    held.append(0)
                own = kinds[kind, c.hint]
                nodes.append((c, own))
                todo.append((c, own, header))
            elif not c.skipped and c.tag != "a":
                todo.append((c, kind, c.tag not in HEADINGS and (header or c.tag == "header")))
    kept = {0}
    long = [any(w.startswith(LONG) for w in h.split()) for h in hints]
    for k in sorted(range(1, len(held)), key=lambda k: (long[k], -held[k], k)):
        if k not in kept and held[k] > (20 if long[k] else 4) * sum(held[x] for x in kept):
            while k not in kept:
                kept.add(k)
                k = above[k]
    for node, k in nodes:
        node.skipped = k not in kept


def parse(html: str) -> Node:
    """The element tree; text is in children as strings. Whatever the markup, no text is lost."""
    root = Node("html", None)
    now, at, hinted = root, 0, False
    while True:
        m = _TAG.search(html, at)
        if m is None:
            rest = html[at:]
            if rest:
                now.children.append(rest)
            if hinted:
                _judge(root)
            return root
        if m.start() > at:
            now.children.append(html[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            up = now
            while up is not None and up.tag != tag:
                up = up.parent
            if up is not None and up.parent is not None:
                now = up.parent
            elif tag == "p":
                now.children.append(Node("p", now))
            continue
        if tag in ("html", "body") and (tag == "html" or any(isinstance(c, Node) and c.tag == "body" for c in root.children)):
            continue
        if tag == "body":
            now = root
        if tag in CLOSES_P or tag == "p":
            up = now
            while up is not None and up.tag != "p" and up.tag not in P_SCOPE:
                up = up.parent
            if up is not None and up.tag == "p":
                now = up.parent
        if tag in ENDS:
            ends, stops = ENDS[tag]
            up = now
            while up is not None and up.tag not in ends and up.tag not in stops:
                up = up.parent
            if up is not None and up.tag in ends:
                now = up.parent
        classes, skipped, hint = _describe(tag, m[3])
        hint = "" if skipped else hint
        hinted = hinted or hint != ""
        node = Node(tag, now, classes, skipped, hint)
        now.children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>|</{tag}\Z", re.I).search(html, at)
            at = end.end() if end else len(html)
        elif tag not in VOID and not m[3].endswith("/"):
            now = node
        elif tag not in VOID and m[3].endswith("/") and tag in BLOCKS:
            now = node  # a slash means nothing on elements that aren't void


def path_of(node: Node) -> str:
    parts = []
    up: Node | None = node
    while up is not None and up.tag != "html":
        parts.append(f"{up.tag}.{up.classes}" if up.classes else up.tag)
        up = up.parent
    return "/".join(reversed(parts))


def blocks_of(container: Node) -> list[tuple[Node, str, int]]:
    """Blocks of text under a container in page order: (innermost block element, text,
    characters of links). Of a header element only headings stay."""
    out: list[tuple[Node, str, int]] = []
    parts: list[str] = []
    owner, linked = container, 0

    def flush():
        nonlocal linked
        text = " ".join(unescape("".join(parts)).split()) if parts else ""
        if text:
            out.append((owner, text, linked))
        parts.clear()
        linked = 0

    # Each entry: a child to visit, or the end of an element.
    todo: list = [(c, container, 0, False) for c in reversed(container.children)]
    while todo:
        child, block, links, header = todo.pop()
        if child is None:
            flush()
            owner = block
            continue
        if isinstance(child, str):
            if header:
                continue
            if not parts:
                owner = block
            parts.append(child)
            if links:
                linked += len(child)
            continue
        if child.skipped:
            if child.tag in BLOCKS or child.tag in SKIPPED:
                flush()
            continue
        if child.tag == "br" or child.tag == "hr":
            parts.append(" ")
            if child.tag == "hr":
                flush()
            continue
        inner = header
        if child.tag == "header":
            inner = True
        elif child.tag in HEADINGS:
            inner = False
        is_block = child.tag in BLOCKS
        if is_block:
            flush()
            owner = child
            todo.append((None, block, links, header))
        todo += [(c, child if is_block else block, links + (child.tag == "a"), inner) for c in reversed(child.children)]
    flush()
    return out


def candidates(root: Node, most: int = 3) -> list[tuple[float, Node]]:
    """The best containers of a page, with their scores."""
    scored: dict[int, Node] = {}
    for block, text, linked in blocks_of(root):
        points = (1 + text.count(",") * 0.2 + min(len(text), 600) / 60) * max(0.0, 1 - linked / max(1, len(text)))
        if len(text) < 20:
            points *= 0.3
        up, share = block if block.tag in CONTAINERS else block.parent, 1.0
        while up is not None and share > 0.1:
            if up.tag in CONTAINERS:
                up.score += points * share
                scored[id(up)] = up
                share /= 2
            up = up.parent
    rank = lambda n: n.score * (3.0 if n.tag in ("article", "main") else 0.6 if n.tag == "body" else 0.4 if n.tag in ("td", "blockquote") else 1.0)
    best = sorted(((rank(n), n) for n in scored.values()), key=lambda x: -x[0])
    return best[:most]


def at_path(root: Node, path: str) -> list[Node]:
    """Elements at a generalised path, outermost and in page order, outside of skipped ones."""
    now = [root]
    for part in path.split("/"):
        now = [c for n in now for c in n.children if isinstance(c, Node) and not c.skipped and (f"{c.tag}.{c.classes}" if c.classes else c.tag) == part]
    return now


def main_text(html: str | None, path: str | None, furniture: list[str] | None = None) -> tuple[str, str | None]:
    """Text of a page, and the path that it was taken from; elements at the furniture's paths
    are left out where the page has other text."""
    if not html:
        return "", None
    root = parse(html)
    left_out = [n for f in furniture or () for n in at_path(root, f)]
    for n in left_out:
        n.skipped = True
    if left_out and not blocks_of(root):
        for n in left_out:
            n.skipped = False
    found = at_path(root, path) if path else []
    text = "\n".join(t for n in found for _, t, _ in blocks_of(n))
    if text:
        return text, path
    best = candidates(root, 1)
    if best:
        node = best[0][1]
        return "\n".join(t for _, t, _ in blocks_of(node)), path_of(node)
    return "\n".join(t for _, t, _ in blocks_of(root)), None


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page. Returns page_id, url, text, n_chars and path (where the text was taken from).

    Null or empty html: empty text. A null url or one without a host: the host "". Broken
    or cut-off markup: read as far as it goes. Repeated rows: rows of their own. Empty
    table: no rows. Very long pages: whole. Other columns are ignored.
    """
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))

    def vote(batches):
        for batch in batches:
            totals: dict[tuple[str, str, int], tuple[int, int]] = {}
            for h, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                html = html.as_py()
                best = candidates(parse(html)) if html else []
                everything = sum(s for s, _ in best)
                for s, n in best:
                    if s > 0:
                        key = h, path_of(n), xxhash.xxh3_64_intdigest("\n".join(t for _, t, _ in blocks_of(n)).encode("utf-8", "surrogatepass")) >> 1
                        pages_, votes = totals.get(key, (0, 0))
                        totals[key] = pages_ + 1, votes + round(s / everything * 1e6)
            hosts, paths, texts = zip(*totals, strict=True) if totals else ((), (), ())
            counts = [list(x) for x in zip(*totals.values(), strict=True)] or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(texts, pa.int64()), pa.array(counts[0], pa.int64()), pa.array(counts[1], pa.int64())], ["host", "path", "text", "pages", "votes"])

    votes = rows.select("host", "html").mapInArrow(vote, "host string, path string, text long, pages long, votes long")
    texts = votes.groupBy("host", "path", "text").agg(F.sum("pages").alias("pages"), F.sum("votes").alias("votes"))
    paths = written(texts.groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("pages").alias("pages"), (F.count("*") / F.sum("pages")).alias("differ")), "pages-paths")
    best = paths.groupBy("host").agg(F.max(F.struct(F.floor(F.col("votes") * F.col("differ")).alias("votes"), "path", "differ")).alias("w")).select("host", F.col("w.path").alias("winning"), F.col("w.differ").alias("own"))
    repeated = (F.col("pages") >= 3) & (F.col("differ") * REPEATS <= F.col("own")) & ~F.startswith("winning", "path")
    winners = paths.join(best, "host").groupBy("host").agg(F.first("winning").alias("winning"), F.collect_list(F.when(repeated, F.col("path"))).alias("furniture"))
    winners = written(winners, "pages-winners")

    def again(batches):
        for batch in batches:
            done = [main_text(h.as_py(), p, f) for h, p, f in zip(batch.column(2), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            texts = [t for t, _ in done]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([p for _, p in done], pa.string())], ["page_id", "url", "text", "n_chars", "path"])

    kind = pages.schema[id_col].dataType.simpleString()
    return rows.join(winners, "host", "left").select("page_id", "url", "html", "winning", "furniture").mapInArrow(again, f"page_id {kind}, url string, text string, n_chars long, path string")
