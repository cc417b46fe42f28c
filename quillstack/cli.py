"""Command line: the views of a file or folder, printed."""

from __future__ import annotations

import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attach, render
from .functions.display import NAMES
from .operators import constructs, export, lines, references, search, sections, views
from .sources import corpus, diffs, pdf

USAGE = """usage: python -m quillstack.cli [TARGET] [options]
  -s, --section NAME   one section and what is below it
  -e, --expand NAME    a section's own content
  --search TEXT        sections that contain TEXT
  -t, --type KIND      constructs of a kind; --lang and --kind narrow code blocks and callouts
  --at LINE            what is at a line
  --since REF          sections changed since a git revision
  -r, --refs           links between files
  -j, --json           everything as JSON
  --color              titles and notes in colours
  --stdin              a JSON manifest {root, files: [{path, content}]} on standard input"""

_VALUES = {"-s": "section", "--section": "section", "-e": "expand", "--expand": "expand", "--search": "search", "-t": "type", "--type": "type", "--lang": "lang", "--kind": "kind", "--at": "at", "--since": "since"}
_FLAGS = {"-r": "refs", "--refs": "refs", "-j": "json", "--json": "json", "--stdin": "stdin", "--color": "color"}


def options(args: list[str]) -> dict:
    """Options by name; the first other argument is the target, a value option at the end is ignored."""
    out: dict = {}
    rest = iter(args)
    for a in rest:
        if a in ("--help", "-h", "--version", "-v"):
            return {"help" if a in ("--help", "-h") else "version": True}
        if a in _VALUES:
            value = next(rest, None)
            if value is not None:
                out[_VALUES[a]] = value
        elif a in _FLAGS:
            out[_FLAGS[a]] = True
        else:
            out.setdefault("target", a)
    if not str(out.get("at", "0")).lstrip("-").isdigit():
        del out["at"]
    return out


class Views:
    def __init__(self, docs: DataFrame, colours: bool = False):
        self.colours = colours
        self.docs = docs.cache()
        plain = self.docs.where("format = 'md'")
        self.nodes = corpus.markdown_nodes(plain).cache()
        found = sections.sections(self.nodes)
        keep = ["doc_id", "sec_id", "parent_id", "path", "depth", "level", "title", "content", "own_tokens", "tokens", "key_terms", "line_start", "line_end"]
        others = [corpus.yaml_sections(self.docs.where("format = 'yaml'"))]
        if "raw" in docs.columns:
            others.append(pdf.pdf_sections(self.docs.where("format = 'pdf'")))
        for rows in others:
            found = found.select(keep).unionByName(_with_paths(rows).select(keep))
        self.sections = found.select(keep).cache()

    def rows(self, df: DataFrame, *order: str) -> list[dict]:
        return [r.asDict() for r in df.join(self.docs.select("doc_id", "filename"), "doc_id").orderBy("filename", *order).collect()]

    def tree(self, secs: DataFrame | None = None) -> str:
        shown = views.indents(sections.tree(self.sections if secs is None else secs))
        return render.tree(self.rows(shown.join(views.notes(self.nodes, self.sections), ["doc_id", "sec_id"], "left"), "sec_id"), self.colours)

    def document(self) -> str:
        """The tree below a box with the document's name, sections, tokens and counters."""
        r = constructs.inventory(self.docs, self.nodes, self.sections).withColumn("rows", views.summary_rows()).first()
        head = [f"Sections: {r['sections']} │ ~{render.tokens(r['total_tokens'])} tokens", *r["rows"]]
        return "\n".join([render.box(r["filename"], head), "", self.tree()])

    def inventory(self, name: str) -> str:
        per = constructs.inventory(self.docs, self.nodes, self.sections)
        total = constructs.totals(per).withColumn("rows", views.summary_rows()).first().asDict()
        head = [f"{total['files']} files · {total['sections']} sections · ~{render.tokens(total['total_tokens'])} tokens", *total["rows"]]
        body = [r["line"] for r in per.select("filename", views.digest().alias("line")).orderBy("filename").collect()]
        return "\n".join([render.box(name + "/", head), "", *body])

    def search(self, query: str) -> str:
        hits = search.with_children(search.search(self.sections, self.nodes, query), self.sections).join(sections.breadcrumbs(self.sections), ["doc_id", "sec_id"])
        rows = self.rows(hits, "sec_id")
        return "\n".join(f"{r['filename']}: {r['breadcrumb']}" + "".join(f"\n    {c}" for c in r["children"] or []) + (f"\n    ({r['more']} more)" if r["more"] else "") for r in rows) or f"no match for {query}"

    def references(self) -> str:
        refs = references.references(self.nodes)
        top = ", ".join(f"{r['target']} ({r['links']}←)" for r in references.hubs(refs).collect())
        out: dict[str, list[str]] = {}
        for r in references.edges(refs, self.docs).orderBy("filename", "ord").collect():
            out.setdefault(r["filename"], []).append(r["target"])
        if not out:
            return "No markdown cross-references found"
        return "\n".join(([f"HUBS: {top}", ""] if top else []) + [f"{f} → {', '.join(t)}" for f, t in out.items()])

    def json(self, root: str) -> str:
        rows = export.documents_json(self.docs.select("doc_id", "filename"), self.nodes, self.sections, references.references(self.nodes)).orderBy("filename").collect()
        docs = [json.loads(r["json"]) for r in rows]
        return json.dumps({"root": root, "total_tokens": sum(d["tokens"] for d in docs), "total_docs": len(docs), "documents": docs}, ensure_ascii=False)

    def types(self, name: str, lang: str, kind: str) -> str:
        known = constructs.kind_of(name)
        if known is None:
            return f"unknown type {name}"
        label = NAMES[known]
        rows = self.rows(views.type_hits(self.nodes, name, lang, kind).join(self._crumbs(), ["doc_id", "sec_id"]), "sec_id", "ord")
        if not rows:
            return f"No {label} found."
        out = []
        for r in rows:
            head = self._head(r)
            out += [head] * (head not in out) + ["  " + render.paint(r["line"], "dim", self.colours)]
        return "\n".join(out)

    def _head(self, r: dict) -> str:
        return f"{render.paint(r['breadcrumb'], 'bold cyan', self.colours)} {render.paint('(' + render.tokens(r['tokens']) + ')', 'dim', self.colours)}"

    def _crumbs(self) -> DataFrame:
        return sections.breadcrumbs(self.sections).join(self.sections.select("doc_id", "sec_id", "tokens"), ["doc_id", "sec_id"])

    def at(self, line: int) -> str:
        points = self.docs.select("doc_id", F.lit(line).alias("line"))
        node = views.line_view(lines.node_at(self.nodes, points), self.nodes).first()
        section = lines.section_at(self.sections, points).join(self._crumbs(), ["doc_id", "sec_id"]).first()
        own = [f"Section: {section['breadcrumb']}"] if section else []
        return "\n".join([f"line {line}", *own, f"Node:    {node['detail']}" if node else "No matching node."])

    def since(self, path: str, ref: str) -> str:
        spark = self.docs.sparkSession
        diff = spark.createDataFrame([(diffs.git_diff(path, ref),)], "diff string").crossJoin(self.docs.select("doc_id"))  # one row
        changed = diffs.changed_lines(diff)
        if changed.isEmpty():
            return f"no changes since {ref}"
        details: dict[int, list[str]] = {}
        for r in views.changed_constructs(self.nodes, changed).orderBy("line").collect():
            details.setdefault(r["sec_id"], []).append("  " + r["detail"])
        rows = self.rows(lines.changed_sections(self.sections, constructs.notables(self.nodes), changed).join(self._crumbs(), ["doc_id", "sec_id"]), "sec_id")
        out = []
        for r in rows:
            n = r["own_lines"]
            out += [self._head(r), *details.get(r["sec_id"], [f"  {n} line{render.plural(n)} changed"])]
        return "\n".join(out) or "Changes are outside any heading (frontmatter, intro, etc)."

    def expand(self, name: str) -> str:
        r = sections.expand(self.sections, name).first()
        if r is None:
            return f"no section {name}"
        return "\n".join([r["title"], *r["lines"], *([f"... ({r['more']} more lines)"] if r["more"] else [])])


def _with_paths(rows: DataFrame) -> DataFrame:
    """Paths and depths of parsed forests of any depth, level by level."""
    done = rows.where("parent_id IS NULL").withColumn("path", F.array("sec_id")).withColumn("depth", F.lit(1))
    now, rest = done, rows.where("parent_id IS NOT NULL")
    while not now.isEmpty():
        up = now.select("doc_id", F.col("sec_id").alias("parent_id"), F.col("path").alias("above"), F.col("depth").alias("d"))
        now = rest.join(up, ["doc_id", "parent_id"]).withColumn("path", F.concat("above", F.array("sec_id"))).withColumn("depth", F.col("d") + 1).drop("above", "d").select(done.columns).cache()
        done = done.unionByName(now)
    return done


def run(spark: SparkSession, args: list[str], stdin=None) -> str:
    o = options(args)
    if "help" in o or "version" in o:
        from . import __version__

        return USAGE if "help" in o else __version__
    attach(spark)
    target = o.get("target", ".")
    if o.get("stdin"):
        docs = corpus.from_manifest(spark.createDataFrame([((stdin or sys.stdin).read(),)], "manifest string"))
        first = docs.first()
        if first is None:
            return "empty manifest, or one without a root"
        name, many = first["root"], True
    else:
        many = os.path.isdir(target)
        docs = corpus.read_directory(spark, target) if many else corpus.read_file(spark, target)
        name = os.path.basename(os.path.abspath(target))
    v = Views(docs, "color" in o)
    if "json" in o:
        return v.json(target)
    if "search" in o:
        return v.search(o["search"])
    if many:
        return v.references() if "refs" in o else v.inventory(name)
    if "since" in o:
        return v.since(target, o["since"])
    if "at" in o:
        return v.at(int(o["at"]))
    if "type" in o:
        return v.types(o["type"], o.get("lang", ""), o.get("kind", ""))
    if "expand" in o:
        return v.expand(o["expand"])
    if "section" in o:
        return v.tree(sections.subtree(v.sections, o["section"]).drop("root"))
    return v.document()


if __name__ == "__main__":
    session = SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    print(run(session, sys.argv[1:]))
