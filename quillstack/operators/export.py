"""JSON documents: the node and section trees of each document, nested.

Trees can't be typed in Spark, so that each document's rows meet in one call, grouped by
document; everything before that stays in tables. A task holds one document's nodes at a
time: the bound is that of a single text, which the parser holds as well. Where the tables
are wanted for nothing else, Markdown becomes JSON in the call that parses it.
"""

from __future__ import annotations

import itertools
import json
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import rx
from ..sources import markdown
from .constructs import COUNTED, COUNTERS, LISTED, inventory
from .sections import assigned

#: Which attribute is which field, by kind.
FIELDS = {
    "heading": {"title": "title", "level": "level"},
    "code_block": {"language": "language", "code": "code"},
    "callout": {"variant": "variant"},
    "table": {"headers": "headers", "aligns": "aligns"},
    "math_block": {"tex": "tex"},
    "inline_math": {"tex": "tex"},
    "footnote_def": {"id": "ref_id"},
    "link_ref_def": {"label": "label", "url": "url"},
    "link": {"url": "url", "title": "text"},
    "html_block": {"raw": "raw"},
    "frontmatter": {"raw": "raw", "format": "format"},
    "wiki_link": {"target": "target"},
    "wiki_embed": {"target": "target"},
}
#: Columns of nodes that are exported.
USED = ("node_id", "parent_id", "kind", "line_start", "line_end", "tokens", "checked", *sorted({c for f in FIELDS.values() for c in f.values()}))


def _full(d: dict) -> dict:
    """Without empty values, but for flags."""
    return {k: v for k, v in d.items() if v is True or v is False or v not in (None, "", 0, [])}


def _node(kind: str, start: int, end: int, tokens: int, values, children: list[dict]) -> dict:
    """values: gives a node's column by name."""
    out = {"kind": kind, "line_start": start, "line_end": end, "tokens": tokens}
    for name, column in FIELDS.get(kind, {}).items():
        value = values(column)
        out[name] = list(value) if name in ("headers", "aligns") and value is not None else int(value) if name == "level" and value is not None else value
    if kind == "task_item":
        out["checked"] = bool(values("checked"))
    out["children"] = children
    return {"kind": kind} | _full(out)


def node_json(row: dict, kids: dict) -> dict:
    return _node(row["kind"], row["line_start"], row["line_end"], row["tokens"], row.get, [node_json(k, kids) for k in kids.get(row["node_id"], [])])


def _dumped(doc: dict) -> str:
    text = json.dumps(doc, ensure_ascii=False, default=lambda v: v.item() if hasattr(v, "item") else list(v))
    return text.replace("<", "\\u003c").replace(">", "\\u003e").replace("&", "\\u0026")


def _clean(pdf: pd.DataFrame) -> list[dict]:
    return [{k: None if v is None or isinstance(v, float) and v != v else v for k, v in r.items()} for r in pdf.astype(object).to_dict("records")]


def documents_json(docs: DataFrame, nodes: DataFrame, secs: DataFrame, refs: DataFrame) -> DataFrame:
    """(doc_id, filename, json): each document with its summary, sections, nodes and references."""
    used = list(USED)
    listed = (F.col("sec_id") > 0) & (F.col("top_kind") != "heading") & ~F.col("under_atomic") & F.col("kind").isin(*LISTED)  # as notables()
    node_rows = assigned(nodes).select("doc_id", *used, F.when(listed, F.col("sec_id")).alias("sec_id"))
    lines = inventory(docs, nodes, secs)
    grouped_nodes = node_rows.groupBy("doc_id").agg(F.collect_list(F.struct(*used, "sec_id")).alias("nodes"))
    grouped_secs = secs.groupBy("doc_id").agg(F.collect_list(F.struct("sec_id", "parent_id", "level", "title", "tokens", "line_start", "line_end", "key_terms")).alias("secs"))
    grouped_refs = refs.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "text", "target", "line"))).alias("refs"))
    rows = lines.join(grouped_nodes, "doc_id", "left").join(grouped_secs, "doc_id", "left").join(grouped_refs, "doc_id", "left")

    def build(batches):
        for pdf in batches:
            out = []
            for r in _clean(pdf):
                plain = lambda xs: [dict(x) for x in (xs if xs is not None else [])]
                kids: dict = {}
                nodes_ = sorted(plain(r["nodes"]), key=lambda x: x["node_id"])
                by_section: dict = {}
                for n in nodes_:
                    n.update({k: None for k, v in n.items() if isinstance(v, float) and v != v})
                    kids.setdefault(n["parent_id"], []).append(n)
                    if n["sec_id"] is not None:
                        by_section.setdefault(n["sec_id"], []).append(n)
                below: dict = {}
                for s in sorted(plain(r["secs"]), key=lambda x: x["sec_id"]):
                    below.setdefault(s["parent_id"], []).append(s)

                def section(s, below=below, kids=kids, by_section=by_section):
                    rest = {"line_start": s["line_start"], "line_end": s["line_end"], "key_terms": list(s["key_terms"]), "notables": [node_json(n, kids) for n in by_section.get(s["sec_id"], [])], "children": [section(k) for k in below.get(s["sec_id"], [])]}
                    return {"level": s["level"], "title": s["title"], "tokens": s["tokens"]} | _full(rest)

                doc = {"filename": r["filename"], "tokens": int(r["total_tokens"]), "summary": _full({c: int(r[c]) for c in COUNTERS}), "sections": [section(s) for s in below.get(None, [])] or None}
                doc |= _full({"nodes": [node_json(n, kids) for n in kids.get(None, [])], "references": [{"text": x["text"], "target": x["target"], "line": x["line"]} for x in plain(r["refs"])]})
                out.append((r["doc_id"], r["filename"], _dumped(doc)))
            yield pd.DataFrame(out, columns=["doc_id", "filename", "json"])

    return rows.mapInPandas(build, "doc_id long, filename string, json string")


# --- from the text alone ---

#: Characters of JSON that a task holds before it hands them on.
BATCH_CHARS = 4_000_000
_BOLD, _CODE = re.compile(rx.BOLD), re.compile(rx.CODE)
#: As functions.text.trimmed(): Java's blanks, and its end of text, which may stand before a last line end.
_ENDS = re.compile(r"\A[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+(?=[\x85\u2028\u2029]?\Z)")


def _trimmed(text: str) -> str:
    return _ENDS.sub("", text) if text[:1].isspace() or text[-1:].isspace() else text


def _key_terms(content: str) -> list[str]:
    """As functions.text.key_terms()."""
    bold = [_trimmed(m[0][2:-2]) for m in _BOLD.finditer(content)] if "**" in content or "__" in content else []
    code = [_trimmed(x) for x in _CODE.findall(content)[:10]] if "`" in content else []
    terms = [x for x in bold if x and len(x.encode()) < 50] + [x for x in code if x and len(x.encode()) < 40]
    return list(dict.fromkeys(terms))[:5]


def _shown(raw: str) -> bool:
    """As functions.text.shown_html()."""
    return not _trimmed(raw).startswith(("<!--", "</"))


def text_json(filename: str | None, text: str | None, compat: bool = False) -> str:
    """A Markdown document's JSON: what documents_json() makes of its tables."""
    counts, refs, heads = dict.fromkeys(COUNTERS, 0), [], []

    def made(node, top_kind, atomic) -> dict:
        kind, values = node.kind, node.attributes.get
        if not atomic:
            if kind in LISTED:
                counts[LISTED[kind]] += kind != "html_block" or _shown(values("raw"))
            elif kind in COUNTED:
                counts[COUNTED[kind]] += 1
                counts["tasks_checked"] += kind == "task_item" and bool(values("checked"))
        if kind == "link" and (target := values("url").split("#", 1)[0]).endswith(".md"):
            refs.append({"text": values("text"), "target": target, "line": node.start})
        inside = atomic or kind in markdown.ATOMIC
        out = _node(kind, node.start, node.end, node.tokens, values, [made(k, top_kind, inside) for k in node.kids])
        if heads and kind in LISTED and not atomic and top_kind != "heading":
            heads[-1]["notables"].append(out)
        return out

    nodes = []
    for node in markdown.parse(text or "", compat):
        if node.kind == "heading":
            heads.append({"level": node.attributes["level"], "title": node.attributes["title"], "tokens": node.tokens, "line_start": node.start, "line_end": 0, "raws": [], "notables": [], "children": []})
        elif heads:
            heads[-1]["tokens"] += node.tokens
            heads[-1]["line_end"] = node.end
            heads[-1]["raws"].append(node.raw_text())
        nodes.append(made(node, node.kind, False))
    roots, open_ = [], []
    for head, following in itertools.zip_longest(heads, heads[1:]):
        if head["line_end"] <= 0:
            head["line_end"] = following["line_start"] - 1 if following else 0
        while open_ and open_[-1]["level"] >= head["level"]:
            open_.pop()
        for above in open_:
            above["tokens"] += head["tokens"]
            above["line_end"] = max(above["line_end"], head["line_end"])
        (open_[-1]["children"] if open_ else roots).append(head)
        open_.append(head)

    def section(s) -> dict:
        rest = {"line_start": s["line_start"], "line_end": s["line_end"], "key_terms": _key_terms(_trimmed("\n".join(s["raws"]))), "notables": s["notables"], "children": [section(k) for k in s["children"]]}
        return {"level": s["level"], "title": s["title"], "tokens": s["tokens"]} | _full(rest)

    doc = {"filename": filename, "tokens": sum(h["tokens"] for h in heads), "summary": _full(counts), "sections": [section(s) for s in roots] or None}
    return _dumped(doc | _full({"nodes": nodes, "references": refs}))


def markdown_json(docs: DataFrame, compat: bool = False) -> DataFrame:
    """(doc_id, filename, json) as documents_json(), of Markdown documents whose tables are
    wanted for nothing else: no node is written or moved."""
    schema = T.StructType([docs.schema["doc_id"], docs.schema["filename"], T.StructField("json", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            begun, size, held = 0, 0, []
            for at, (name, content) in enumerate(zip(batch.column(1), batch.column(2), strict=True)):
                held.append(text_json(name.as_py(), content.as_py(), compat))
                size += len(held[-1])
                if size >= BATCH_CHARS or at + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0)[begun : at + 1], batch.column(1)[begun : at + 1], pa.array(held, pa.string())], schema=arrow)
                    begun, size, held = at + 1, 0, []

    return docs.select("doc_id", "filename", "content").mapInArrow(run, schema)
