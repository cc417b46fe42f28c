"""Operators over parsed documents, the views, streams, and every query against its SQL."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from quillstack import cli, render, streaming
from quillstack.functions import display, text
from quillstack.operators import constructs, export, lines, references, search, sections, views
from quillstack.plans import registry
from quillstack.sources import corpus
from tests.test_markdown import DOC

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "a.md", "md", DOC), (2, "b.md", "md", "intro [x](a.md)\n\n# B\n\n## C\n\ntext [a](a.md#s) [z](https://z.example/q.md)\n\n# D\n"), (3, "empty.md", "md", ""), (4, "null.md", "md", None)]
    return spark.createDataFrame(rows, "doc_id long, filename string, format string, content string")


@pytest.fixture(scope="module")
def nodes(docs):
    return corpus.markdown_nodes(docs).cache()


def test_sections(nodes):
    got = {(r.doc_id, r.title): r for r in sections.sections(nodes).collect()}
    b, c, d = got[2, "B"], got[2, "C"], got[2, "D"]
    assert (b.parent_id, c.parent_id, d.parent_id) == (None, b.sec_id, None)
    assert b.tokens == b.own_tokens + c.own_tokens and c.content == "text [a](a.md#s) [z](https://z.example/q.md)"
    assert (b.line_start, b.line_end, c.line_end, d.line_end) == (3, 7, 7, 0)
    crumbs = {(r.doc_id, r.sec_id): r.breadcrumb for r in sections.breadcrumbs(sections.sections(nodes)).collect()}
    assert crumbs[2, c.sec_id] == "B > C"


def test_outline_is_the_stack(spark):
    rnd, rows = random.Random(1), []
    for doc in range(60):
        for k in range(1, rnd.randint(2, 40)):
            rows.append((doc, k, rnd.randint(1, 6)))
    got = {(r.doc_id, r.sec_id): (r.parent_id, r.path) for r in sections.outline(spark.createDataFrame(rows, "doc_id long, sec_id int, level int")).collect()}
    stack, last = [], None
    for doc, k, level in rows:
        if doc != last:
            stack, last = [], doc
        while stack and stack[-1][1] >= level:
            stack.pop()
        assert got[doc, k] == (stack[-1][0] if stack else None, [s for s, _ in stack] + [k])
        stack.append((k, level))


def test_tokens_add_up(nodes):
    top = nodes.where("depth = 1").groupBy("doc_id").agg(F.sum("tokens").alias("t"))
    kept = sections.assigned(nodes).where("depth = 1 AND sec_id = 0").groupBy("doc_id").agg(F.sum("tokens").alias("p"))
    secs = sections.sections(nodes).groupBy("doc_id").agg(F.sum("own_tokens").alias("s"))
    for r in top.join(kept, "doc_id", "left").join(secs, "doc_id", "left").na.fill(0).collect():
        assert r.t == r.p + r.s


def test_constructs(nodes, docs):
    s = {r.doc_id: r for r in constructs.summary(nodes).collect()}[1]
    assert (s.callouts, s.tables, s.code_blocks, s.math_blocks, s.html_blocks, s.footnotes, s.definition_lists, s.link_ref_defs, s.tasks, s.tasks_checked) == (1, 1, 3, 1, 1, 1, 1, 2, 3, 2)
    assert constructs.drill_down(nodes, "alert", variant="TIP").count() == 0 and constructs.drill_down(nodes, "codeblock", language="PYTHON").count() == 1
    assert constructs.drill_down(nodes, "task").first().n == 3 and constructs.drill_down(nodes, "nonsense").count() == 0
    assert [constructs.kind_of(x) for x in ("Alert", "sha", "DEFLIST", "x")] == ["callout", "commit_ref", "definition_list", None]
    lines_ = {r.filename: r for r in constructs.inventory(docs, nodes, sections.sections(nodes)).collect()}
    assert lines_["empty.md"].sections == lines_["null.md"].callouts == 0 and constructs.totals(constructs.inventory(docs, nodes, sections.sections(nodes))).first().files == 4


def test_references(nodes, docs):
    refs = references.references(nodes)
    assert {(r.doc_id, r.target) for r in refs.collect()} == {(1, "guide.md"), (2, "a.md"), (2, "https://z.example/q.md")}
    assert [(r.target, r.links) for r in references.hubs(refs).collect()] == [("a.md", 2)]
    assert references.edges(refs, docs).count() == 3 and references.resolved(refs, docs).count() == 2 and references.back_edges(refs, docs).count() == 3


def test_lines(spark, nodes):
    points = spark.createDataFrame([(1, 26), (1, 39), (2, 1), (2, 7), (2, 9)], "doc_id long, line int")
    assert {(r.doc_id, r.line): r.kind for r in lines.node_at(nodes, points).collect()} == {(1, 26): "paragraph", (1, 39): "code_block", (2, 1): "link", (2, 7): "link", (2, 9): "heading"}
    secs = sections.sections(nodes)
    assert {(r.doc_id, r.line): r.title for r in lines.section_at(secs, points.where("doc_id = 2")).collect()} == {(2, 7): "C", (2, 9): "D"}
    hit = lines.changed_sections(secs, constructs.notables(nodes), spark.createDataFrame([(1, 39), (2, 7)], "doc_id long, line int")).collect()
    assert {(r.doc_id, r.title, r.own_lines) for r in hit} == {(1, "One", 1), (2, "C", 1)}


def test_bins(spark):
    ranges = spark.createDataFrame([(1, k, 1 + 37 * k, 1 + 37 * k + 200) for k in range(50)], "doc_id long, k int, line_start int, line_end int")
    points = spark.createDataFrame([(1, x) for x in range(0, 2000, 13)], "doc_id long, line int")
    got = {(r.k, r.line) for r in lines.covering(ranges, points).collect()}
    assert got == {(k, x) for k in range(50) for x in range(0, 2000, 13) if 1 + 37 * k <= x <= 201 + 37 * k}


def test_search(nodes):
    secs = sections.sections(nodes)
    assert {r.title for r in search.search(secs, nodes, "PYTHON").collect()} == {"One"}
    assert {r.title for r in search.search(secs, nodes, "text [A]").collect()} == {"C"}
    assert search.with_children(search.search(secs, nodes, "b"), secs).count() > 0
    assert search.search(secs, nodes, "no such thing").count() == 0


def test_views(nodes):
    secs = sections.sections(nodes)
    assert {r.title for r in sections.tree(secs).where("doc_id = 1").collect()} == {"Setext one", "Setext two", "One"}
    assert [r.title for r in sections.subtree(secs.where("doc_id = 2"), "b").orderBy("sec_id").collect()] == ["B", "C"]
    assert sections.expand(secs.where("doc_id = 2"), "c", 1).first().more == 0


def test_json(docs, nodes):
    rows = {r.filename: json.loads(r.json) for r in export.documents_json(docs, nodes, sections.sections(nodes), references.references(nodes)).collect()}
    assert rows["empty.md"]["sections"] is None and rows["b.md"]["sections"][0]["children"][0]["title"] == "C"
    assert rows["b.md"]["references"][0] == {"text": "x", "target": "a.md", "line": 1}
    flat, todo = [], list(rows["a.md"]["nodes"])
    while todo:
        n = todo.pop()
        flat.append(n)
        todo += n.get("children", [])
    assert sum("checked" in n for n in flat) == 3 and any(n.get("headers") == ["A", "B"] for n in flat)


def test_render():
    assert [render.tokens(n) for n in (0, 500, 999, 1000, 1500, 10000, 1250)] == ["0", "500", "999", "1.0k", "1.5k", "10.0k", "1.2k"]
    assert [render.centred("test", 10), render.centred("hello", 5), render.centred("hi", 6), render.centred("abcdef", 3)] == ["   test", "hello", "  hi", "abc"]


def test_display_columns(spark):
    numbers = [0, 500, 999, 1000, 1050, 1150, 1250, 1350, 1500, 1750, 2450, 9950, 10000, 99950, 1234567]
    got = spark.createDataFrame([(n,) for n in numbers], "n long").select(display.short_number(F.col("n")).alias("s")).collect()
    assert [r.s for r in got] == [render.tokens(n) for n in numbers]
    df = spark.createDataFrame([("test", "é" * 40, 'a"b\\c')], "t string, l string, q string")
    r = df.select(*[display.centred(F.col("t"), n).alias(f"c{n}") for n in (10, 4, 3)], display.preview(F.col("l"), 60).alias("p"), display.file_title(F.concat("l", "t")).alias("f"), display.quoted(F.col("q")).alias("q"), display.padded(F.col("t"), 6).alias("w"), display.padded(F.col("t"), 2).alias("n")).first()
    assert (r.c10, r.c4, r.c3, r.w, r.n, r.q) == ("   test", "test", "tes", "test  ", "test", '"a\\"b\\\\c"')
    assert r.p == "é" * 28 + "..." and r.f.startswith("...é") and len(r.f.encode()) <= 50
    counters = [[1] + [0] * 15, [0] * 16, [5, 0, 0, 0, 0, 0, 0, 0, 1, 1, 0, 0, 2, 0, 0, 0]]
    rows = spark.createDataFrame(counters, ", ".join(f"{c} long" for c in constructs.COUNTERS)).select(views.summary_rows().alias("r")).collect()
    assert [x.r for x in rows] == [["1 callout"], [], ["5 callouts", "1 task (1 done)", "2 @mentions"]]


def test_notes(nodes):
    got = {r.sec_id: r.note for r in views.notes(nodes, sections.sections(nodes)).where("doc_id = 1").collect()}
    assert got[3].startswith("note :26 · 1 table :33 A · python :39-41, (none) :43, (indent) :") and " · 1 math :" in got[3] and " · <div> :" in got[3] and "3 tasks (2 done)" in got[3] and got[2] == ""


def test_text_columns(spark):
    df = spark.createDataFrame([("x **bold text** `inline` __under__ `inline` `" + "c" * 50 + "`", "<!-- c -->", "[!NOTE]body\nmore"), ("", "</div>", "x"), (None, "<br/>", None)], "t string, h string, c string")
    got = df.select(text.key_terms(F.col("t")).alias("k"), text.html_tag(F.col("h")).alias("h"), text.shown_html(F.col("h")).alias("s"), text.snippet(F.col("c")).alias("c")).collect()
    assert got[0].k == ["bold text", "under", "inline"] and [r.h for r in got] == ["comment", "/div", "br/"] and [r.s for r in got] == [False, False, True] and got[0].c == "body"


def test_command_line(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A\n\n[b](b.md) [b](b.md)\n\n## Code\n\n```sh\nls\n```\n")
    (tmp_path / "c.yaml").write_text("server:\n  host: h.example\n")
    a = str(tmp_path / "a.md")
    tree = cli.run(spark, [a]).splitlines()
    assert tree[0].startswith("╭") and " a.md " in tree[0] and "Sections: 2 │ ~" in tree[1] and "1 code block" in tree[2]
    assert tree[5].startswith("A (") and tree[6].startswith("└── Code (") and tree[6].endswith("sh :8-9")
    assert "\033[1m\033[36mCode\033[0m" in cli.run(spark, [a, "--color"])
    assert cli.run(spark, [a, "--at", "8"]) == "line 8\nSection: A > Code\nNode:    code L8-9  lang=sh" and cli.run(spark, [a, "-t", "code"]).endswith("\n  :8-9  sh        ")
    assert cli.run(spark, [a, "-t", "callout"]) == "No callouts found."
    assert "b.md (2←)" in cli.run(spark, [str(tmp_path), "--refs"]) and "2 files" in cli.run(spark, [str(tmp_path)])
    assert json.loads(cli.run(spark, [str(tmp_path), "-j"]))["total_docs"] == 2
    assert "host" in cli.run(spark, [str(tmp_path / "c.yaml")])
    assert cli.options(["x", "y", "--at", "z", "--search"]) == {"target": "x"} and "usage" in cli.run(spark, ["--help"])


def test_stream_is_the_batch(spark, docs, tmp_path):
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    q = streaming.nodes(streaming.documents(spark, str(tmp_path / "in"), 1)).writeStream.format("memory").queryName("stream_nodes").start()
    q.processAllAvailable()
    q.stop()
    pick = lambda df: sorted((r.doc_id, r.node_id, r.kind) for r in df.collect())
    assert pick(spark.table("stream_nodes")) == pick(corpus.markdown_nodes(docs))


def test_partitions_dont_matter(docs):
    pick = lambda n: sorted(map(str, sections.sections(corpus.markdown_nodes(docs.repartition(n))).collect()))
    assert pick(1) == pick(8)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    df = registry.queries()[name](spark, DATA)
    want = con.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in sorted(want.columns)]
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()), key=key) == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=key)
