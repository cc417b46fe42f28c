"""PDF to sections: by outline if there is one, else by page.

Reading uses pypdf where it is installed; without it, a small reader that knows plain and
Flate streams and the common text operators.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame

from .. import schemas


def spread(outline: list, total: int) -> list[dict]:
    """outline: (title, children) trees. Sections in pre-order with tokens dealt evenly:
    among the roots, then by each section between itself and its children, then added up
    again at every level, over sums that hold lower ones already."""

    def make(item, level):
        return {"level": level, "title": item[0].strip(), "own": 0, "tokens": 0, "kids": [make(k, level + 1) for k in item[1]]}

    def deal(s, n):
        if not s["kids"]:
            s["own"] = s["tokens"] = n
            return
        each = n // (len(s["kids"]) + 1)
        s["own"] = s["tokens"] = each
        for k in s["kids"]:
            deal(k, each)
        add_up(s)

    def add_up(s):
        for k in s["kids"]:
            s["tokens"] += add_up(k)
        return s["tokens"]

    roots = [make(x, 1) for x in outline]
    for r in roots:
        deal(r, total // len(roots))
    return roots


def by_page(pages: list[str]) -> list[dict]:
    """A section for each page with text; one that says so if none has."""
    out = [{"level": 1, "title": f"Page {k}", "content": t, "own": len(t.encode()) // 4, "tokens": len(t.encode()) // 4, "kids": [], "page": k} for k, t in enumerate(pages, 1) if t.strip()]
    if pages and not out:
        return [{"level": 1, "title": f"({len(pages)} pages - no extractable text)", "own": 0, "tokens": 0, "kids": [], "page": 1, "last": len(pages)}]
    return out


def rows(data: bytes | None):
    """Section rows in pre-order; line ranges are page numbers, 0 for outline sections."""
    outline, pages = read(data) if data else ([], [])
    forest = spread(outline, sum(len(p.encode()) for p in pages) // 4) if outline else by_page(pages)
    number = 0

    def walk(s, parent):
        nonlocal number
        number += 1
        own = number
        page = s.get("page", 0)
        yield own, parent, s["level"], s["title"], s.get("content", ""), s["own"], s["tokens"], [], page, s.get("last", page)
        for k in s["kids"]:
            yield from walk(k, own)

    for s in forest:
        yield from walk(s, None)


def read(data: bytes) -> tuple[list, list[str]]:
    """Outline trees and page texts of a file. Raises ValueError if it isn't a PDF."""
    if not data.lstrip().startswith(b"%PDF"):
        raise ValueError("not a PDF file")
    try:
        import pypdf
    except ImportError:
        return _Reader(data).outline(), _Reader(data).pages()
    import io

    reader = pypdf.PdfReader(io.BytesIO(data))

    def tree(items):
        out: list = []
        for x in items:
            if isinstance(x, list):
                out[-1][1].extend(tree(x))
            else:
                out.append((str(x.title), []))
        return out

    return tree(reader.outline), [p.extract_text() or "" for p in reader.pages]


_OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_REFERENCE = re.compile(rb"(\d+)\s+\d+\s+R")
_STRING = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>", re.S)
_SHOW = re.compile(rb"(\[(?:\\.|[^\]\\])*\]|\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>)\s*(TJ|Tj|'|\")|(?<!\w)(T\*|Td|TD|ET)(?!\w)", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _text(raw: bytes) -> str:
    if raw[:1] == b"<":
        data = bytes.fromhex(re.sub(rb"\s", b"", raw[1:-1]).decode() + "0" * (len(re.sub(rb"\s", b"", raw[1:-1])) % 2))
    else:
        data = re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else b"" if m[1].strip(b"\r\n") == b"" else _ESCAPES.get(m[1], m[1]), raw[1:-1], flags=re.S)
    return data[2:].decode("utf-16-be", "replace") if data[:2] == b"\xfe\xff" else data.decode("latin-1")


class _Reader:
    def __init__(self, data: bytes):
        self.objects = {int(m[1]): m[3] for m in _OBJECT.finditer(data)}

    def _ref(self, body: bytes, key: bytes) -> int | None:
        m = re.search(rb"/" + key + rb"\s+(\d+)\s+\d+\s+R", body)
        return int(m[1]) if m else None

    def outline(self) -> list:
        root = next((b for b in self.objects.values() if re.search(rb"/Type\s*/Catalog", b)), b"")
        top = self._ref(root, rb"Outlines")

        def level(first, seen):
            out = []
            while first is not None and first not in seen:
                seen.add(first)
                body = self.objects.get(first, b"")
                m = re.search(rb"/Title\s*(" + _STRING.pattern + rb")", body, re.S)
                out.append((_text(m[1]) if m else "", level(self._ref(body, rb"First"), seen)))
                first = self._ref(body, rb"Next")
            return out

        return level(self._ref(self.objects.get(top, b""), rb"First"), set()) if top is not None else []

    def pages(self) -> list[str]:
        root = next((b for b in self.objects.values() if re.search(rb"/Type\s*/Catalog", b)), b"")
        order: list[bytes] = []

        def visit(n, seen):
            body = self.objects.get(n, b"")
            if n in seen:
                return
            seen.add(n)
            kids = re.search(rb"/Kids\s*\[(.*?)\]", body, re.S)
            if kids:
                for k in _REFERENCE.finditer(kids[1]):
                    visit(int(k[1]), seen)
            elif re.search(rb"/Type\s*/Page\b", body):
                order.append(body)

        top = self._ref(root, rb"Pages")
        if top is not None:
            visit(top, set())
        return [self._page(b) for b in order]

    def _page(self, body: bytes) -> str:
        m = re.search(rb"/Contents\s*(\[.*?\]|\d+\s+\d+\s+R)", body, re.S)
        parts = []
        for k in _REFERENCE.finditer(m[1] if m else b""):
            content = self.objects.get(int(k[1]), b"")
            s = _STREAM.search(content)
            data = s[1] if s else b""
            if b"/FlateDecode" in content[: s.start() if s else 0]:
                try:
                    data = zlib.decompressobj().decompress(data)
                except zlib.error:
                    data = b""
            for show in _SHOW.finditer(data):
                if show[3]:
                    parts.append("\n")
                else:
                    parts.append("".join(_text(x.group()) for x in _STRING.finditer(show[1])))
        return re.sub(r"\n+", "\n", "".join(parts)).strip()


def pdf_sections(docs: DataFrame) -> DataFrame:
    """Sections of PDF documents (doc_id, raw bytes); a file that can't be read has none."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    def run(batches):
        arrow = to_arrow_schema(schemas.SECTIONS)
        for batch in batches:
            held = []
            for doc, data in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
                try:
                    held += [(doc, *r) for r in rows(data)]
                except (ValueError, IndexError, KeyError):
                    continue
            columns = list(zip(*held, strict=True)) if held else [[] for _ in arrow]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return docs.select("doc_id", "raw").mapInArrow(run, schemas.SECTIONS)
