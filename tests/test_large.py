"""Queries over corpora that are too large to keep: parsed for each query, with what it names only, against their SQL."""

import os
import re

import pytest

from quillstack.plans import registry
from quillstack.sources import markdown
from tests.test_markdown import DOC

DATA = "/root/testdata/sf0.001"
ORDERS = "node_kinds changed_since hubs search_constructs section_stats summary type_callout type_code type_table type_task node_at ref_back_edges notables ref_edges section_at references".split()
PARTS = "changed_constructs expand_long footnotes key_terms_capped json_nodes line_details link_definitions type_hits all_kinds scan_attributes section_notes summary_all summary_rows folder_totals frontmatter math_blocks inline_attributes html_blocks document_order section_ranges".split()


@pytest.fixture
def large(spark, monkeypatch):
    registry.forget()
    monkeypatch.setattr(registry, "KEPT_DOCUMENTS", 0)
    yield
    registry.forget()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", [*ORDERS, *PARTS])
def test_nothing_is_kept(spark, large, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    before = set(spark.sparkContext._jsc.getPersistentRDDs().keySet())
    got = registry.queries()[name](spark, DATA)
    want = con.sql(registry.oracle_sql()[name])
    key = lambda r: tuple(map(str, r))
    order = [want.columns.index(c) for c in got.columns]
    assert sorted(map(tuple, got.collect()), key=key) == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=key)
    assert set(spark.sparkContext._jsc.getPersistentRDDs().keySet()) <= before and not registry._PARSED


@pytest.mark.parametrize("name", ["line_details", "changed_constructs", "node_at"])
def test_points_are_not_broadcast(spark, large, name):
    """They are exploded from a column or two, so that the plan takes them for a hundredth of what they are."""
    plan = registry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [doc_id" in plan and "BroadcastHashJoin [doc_id" not in plan


def test_columns_and_kinds_are_those_of_all_rows():
    whole = [dict(zip(markdown.NAMES, r, strict=True)) for r in markdown.rows(DOC)]
    names = ("kind", "line_start", "raw_text", "sec_id", "url", "paragraphs")
    assert [tuple(r[n] for n in names) for r in whole] == markdown.rows(DOC, False, names)
    assert [r["node_id"] for r in whole if r["depth"] == 1 or r["kind"] == "emoji"] == [r[0] for r in markdown.rows(DOC, False, ("node_id",), frozenset(["top", "emoji"]))]
    assert [r["paragraphs"] for r in whole if r["kind"] == "callout"] == [["[!NOTE]bodylazy"]]


def test_paragraphs_without_brackets_are_passed_over():
    """Where no column or kind needs them; the rows are those of the whole parse, in its order."""
    names, kinds = tuple(n for n in markdown.NAMES if n not in ("node_id", "parent_id", "tokens", "text", "paragraphs")), frozenset(["top", "link", "image", "footnote_ref", "list_item", "table_row", *markdown.ATOMIC])
    text = DOC + "\n> [**!TIP]**\n> more\n\n> plain\n\n- a [^n]\n\n| [^z] |\n|---|\n\n[^z]: `x`\n\nword [^z] @user\n"
    whole = [dict(zip(markdown.NAMES, r, strict=True)) for r in markdown.rows(text)]
    want = [tuple(r[n] for n in names) for r in whole if r["depth"] == 1 or r["kind"] in kinds]
    assert want == markdown.rows(text, False, names, kinds) and not markdown._inlined(names, kinds)


def test_plain_blocks_are_read_at_once(monkeypatch):
    """An order's document never goes line by line; any document gives the rows that it gives line by line."""
    order = "# Order 1\n\n> [!TIP]\n> Priority **1**\n\n## Lines\n\n| Line | Part |\n|---|:-:|\n| 1 | 2 |\n| 2 | 3 |\n\n## Tasks\n\n- [x] line 1\n- [ ] line deadbeef\n\n```sql\nSELECT 1\n\n```\n\nSee [c](c.md#t) and #1.\n"
    pieces = ["word #1", "- a", "- [x] b", "- deadbee", "+ c", "", "", "> q", "> [!TIP]", "| a | b |", "|---|---|", "```", "x", "    y", ": d", "===", "[r]: u", "see [r] [^n]", "[^n]: note", "# H #", "#"]
    docs = [order, order[:-1], DOC, DOC.replace("\n", "\r\n"), *("\n".join(pieces[(k * j + k) % len(pieces)] for j in range(9)) + "\n" * (k % 2) for k in range(1, 400))]
    asked = [(markdown.NAMES, None), (("kind", "line_start", "line_end", "title", "sec_id", "raw_text", "raw"), frozenset(["top", *markdown.ATOMIC])), (("kind", "checked", "number"), frozenset(["task_item", "issue_ref", "commit_ref"])), (("kind", "url", "text"), frozenset(["link"]))]
    at_once = [markdown.rows(d, compat, *a) for d in docs for compat in (False, True) for a in asked]
    with monkeypatch.context() as m:
        m.setattr(markdown.Parser, "plain", lambda self, c, text, at, number, out: at)
        assert at_once == [markdown.rows(d, compat, *a) for d in docs for compat in (False, True) for a in asked]
    monkeypatch.setattr(markdown.Parser, "block", None)
    assert len(markdown.rows(order)) == 25


def test_sections_from_headings_alone(spark):
    """The parser tells headings their last line, so that no other node has to be moved; the sections are those of all nodes."""
    from quillstack.operators import sections
    from quillstack.sources import corpus

    texts = [DOC, "# A\n", "x\n\n# A\n\n## B\n\ny\n\n***\n\n# C\n## D\n\n> # in\n\nz\n", "", "[^n]\n\n# A\n\n[^n]: note\n\n## B\n"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, content string")
    for compat in (False, True):
        want = sections.sections(corpus.markdown_nodes(docs, compat)).select("doc_id", "sec_id", "parent_id", "level", "title", "line_start", "line_end", "path", "depth")
        got = sections.sections(corpus.markdown_nodes(docs, compat, sections.OUTLINED, frozenset(["heading"])))
        assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect())) and got.count() > 10


def test_counters_read_no_other_nodes(spark, large):
    """Of an order, summary is handed its nodes at the top and its constructs, not rows and cells."""
    from quillstack.operators import constructs

    kinds = {r[0] for r in registry._order_nodes(spark, DATA, constructs.COUNTING, constructs.SEEN).select("kind").distinct().collect()}
    assert "task_item" in kinds and "issue_ref" in kinds and not kinds & {"table_cell", "table_row", "link"}
    docs = spark.createDataFrame([(1, "word\n"), (2, "- [x] a\n")], "doc_id long, content string")
    from quillstack.sources import corpus

    rows = constructs.summary(corpus.markdown_nodes(docs, columns=constructs.COUNTING, kinds=frozenset(constructs.SEEN))).select("doc_id", "tasks_checked")
    assert sorted(map(tuple, rows.collect())) == [(1, 0), (2, 1)]


@pytest.mark.parametrize(("name", "after"), [("node_at", "node_id"), ("changed_since", "collect_set")])
def test_lines_are_not_moved_after_the_join(spark, large, name, after):
    """What is at a line is found where the join by document and bin has put it: no exchange by document and line."""
    plan = registry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    moved = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
    joined = [m for m in moved if "_bin#" in m]
    assert after in plan and len(joined) == 2 and not [m for m in joined if "line#" in m]
    assert name == "changed_since" or not [m for m in moved if "line#" in m]


def test_an_orders_lines_are_moved_as_values(spark, large):
    plan = registry.queries()["type_callout"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list(struct(l_linenumber" in plan


def test_definitions_of_links_need_no_blocks(monkeypatch):
    texts = [DOC, "---\na: 1\n---\n[x]: y\n\n- [z]: w 'no'\n\n```\n[c]: d\n```\n"]
    asked = [(("kind", "label", "url", "link_title", "line_start", "depth"), frozenset(["link_ref_def"])), (("kind", "format", "raw", "line_end"), frozenset(["frontmatter"]))]
    want = [[tuple(dict(zip(markdown.NAMES, r, strict=True))[n] for n in sorted(names, key=markdown.NAMES.index)) for r in markdown.rows(t, compat) if r[markdown.NAMES.index("kind")] in kinds] for t in texts for compat in (False, True) for names, kinds in asked]
    among = markdown.rows(DOC, False, ("sec_id",), frozenset(["link_ref_def"]))
    assert among == [(r[markdown.NAMES.index("sec_id")],) for r in markdown.rows(DOC) if r[4] == "link_ref_def"] and (3,) in among
    monkeypatch.setattr(markdown.Parser, "document", None)
    assert any(want) and want == [markdown.rows(t, compat, tuple(sorted(names, key=markdown.NAMES.index)), kinds) for t in texts for compat in (False, True) for names, kinds in asked]


def test_counted_constructs_need_no_links_and_listed_ones_no_titles(monkeypatch):
    from quillstack.operators import constructs

    order = "# Order *1*\n\n> [!TIP]\n> Priority **1**\n\n## T #4\n\n- [x] line 1\n\nSee [c](c.md#t), @u and `deadbee` #1.\n"
    texts = [DOC, order, "> [!NOTE]\n> x\n\n[!note]: u\n\n> [!TIP] y\n\n> [!WARNING]\n> see [a](b)\n\n> [^n]\n> # H\n\n[^n]: # in\n\n- a\n\n5. b\n"]
    for kinds, names in ((constructs.COUNTED, (*constructs.PLACED, "checked", "number", "sha")), (constructs.LISTED, (*constructs.PLACED, "line_start", "variant", "headers")), (["callout"], ("kind", "variant", "paragraphs"))):
        names = tuple(n for n in markdown.NAMES if n in names)
        want = [[tuple(dict(zip(markdown.NAMES, r, strict=True))[n] for n in names) for r in markdown.rows(t) if r[4] in kinds] for t in texts]
        assert want == [markdown.rows(t, False, names, frozenset(kinds)) for t in texts] and not markdown._inlined(names, frozenset(kinds))
    parsed = []
    monkeypatch.setattr(markdown.inline, "parse", lambda text, *a: parsed.append(text) or [])
    markdown.rows(order, False, constructs.PLACED, frozenset(constructs.LISTED))
    assert parsed == []


@pytest.mark.parametrize(("name", "table"), [("search_constructs", "orders"), ("ref_edges", "orders"), ("ref_back_edges", "orders"), ("expand_long", "part"), ("key_terms_capped", "part")])
def test_documents_are_made_and_parsed_once(spark, large, monkeypatch, name, table):
    """And no nodes are written on the way."""
    monkeypatch.setattr(registry.corpora, "shared_folder", None)
    plan = registry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and len(re.findall(rf"FileScan parquet .*/{table}\.parquet", plan)) == 1


def test_search_in_one_pass_finds_what_sections_hold(spark):
    from quillstack.operators import constructs, search, sections
    from quillstack.sources import corpus

    docs = spark.createDataFrame([(0, DOC), (1, "# A b\n\n> [!TIP]\n> a\n\n## C\n\n```sql\nB\n```\n\nb\n"), (2, "b\n"), (3, "# x\n\n> # b\n\n## y\n  b  \n")], "doc_id long, content string")
    nodes = corpus.markdown_nodes(docs)
    passed = corpus.markdown_nodes(docs, columns=search.PASSED, kinds=frozenset(["heading", *constructs.LISTED]))
    for query in ("b", "tip", "note", "B\n", " "):
        want = search.search(sections.sections(nodes), nodes, query)
        assert sorted(map(str, search.search(None, passed, query).select(want.columns).collect())) == sorted(map(str, want.collect()))
    want = sections.sections(nodes).select("doc_id", "sec_id", "title", "content", "key_terms")
    assert sorted(map(str, sections.own(corpus.markdown_nodes(docs, columns=sections.OWN, kinds=frozenset(["heading"]))).collect())) == sorted(map(str, want.collect()))


def test_json_of_a_text_is_that_of_its_tables(spark):
    from quillstack.operators import export, references, sections
    from quillstack.sources import corpus

    odd = [DOC, None, "", "word\n", "x\n\n# A & <b>\n\n### C\n\n[y](b.md#c) **two  ** `` ` `` `c` __e__\u2028\n\n## B\n\n- [x] a\n\n  ```sql\n  1\n  ```\n", "> # q\n> [z](z.md)\n\n# H [in](h.md) `c`\n\n<!-- n -->\n\n</div>\n\n<p>\n", "# A\n## B\n# C\n\n***\n"]
    pieces = ["# H `c`", "### K", "- [x] a [l](l.md)", "> [!TIP]", "> **b**", "", "", "| a | [b](b.md) |", "|---|---|", "```", "    y ", ": d", "see [r] [^n] #1", "[^n]: note `z`", "[r]: u.md", "$$", "<div>", "\u0085"]
    texts = [*odd, *("\n".join(pieces[(k * j + k) % len(pieces)] for j in range(11)) for k in range(1, 150))]
    docs = spark.createDataFrame([(k, f"{k}.md", t) for k, t in enumerate(texts)], "doc_id long, filename string, content string").repartition(4)
    for compat in (False, True):
        nodes = corpus.markdown_nodes(docs, compat).persist()
        want = export.documents_json(docs, nodes, sections.sections(nodes), references.references(nodes))
        assert dict(export.markdown_json(docs, compat).select("filename", "json").collect()) == dict(want.select("filename", "json").collect())
        nodes.unpersist()


def test_json_is_made_where_documents_are_parsed(spark, large, monkeypatch):
    """Documents are dealt out once; no node is written, moved or grouped, and what a task holds is bounded by its bytes."""
    from quillstack.operators import export

    monkeypatch.setattr(registry.corpora, "shared_folder", None)
    plan = registry.queries()["json_nodes"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange") == 1 and "Join" not in plan and "Aggregate" not in plan
    monkeypatch.setattr(export, "BATCH_CHARS", 1)
    docs = spark.createDataFrame([(k, f"{k}.md", f"# {k}\n") for k in range(7)], "doc_id long, filename string, content string")
    assert sorted(r.filename for r in export.markdown_json(docs).collect()) == [f"{k}.md" for k in range(7)]


def test_notes_pass_over_what_refers_to_none(monkeypatch):
    """A part's blocks of usual form are read by one pattern each, and those without a note make no node where notes alone are asked for."""
    blocks = ["***", "[[Page 1]] @u", "**bold** and [^n]", "`c` z", "$$\nx\n$$", "\\[\ny\n\\]", "[^n]: Note with[^m] in it.", "[^m]: Other.", "[r]: https://r.example 'R'", "    code [^n]", "<div>\n[^n]\n</div>", "<!-- [^n] -->", "Term\n: first[^m]\n: second", "See [^m] and [r].", "# H [^n]", "- a", "> q [^m]"]
    texts = [DOC, "\n\n".join(blocks), *("\n\n".join(blocks[(k * j + k) % len(blocks)] for j in range(9)) + "\n" * (k % 3) for k in range(1, 200)), *("\n".join(blocks[(k * j + k) % len(blocks)] for j in range(9)) for k in range(1, 200))]
    names = tuple(n for n in markdown.NAMES if n in ("kind", "ref_id", "label", "line_start"))
    whole = [markdown.rows(t, compat) for t in texts for compat in (False, True)]
    alone = [markdown.rows(t, compat, names, frozenset(["footnote_def", "footnote_ref"])) for t in texts for compat in (False, True)]
    at = [markdown.NAMES.index(n) for n in names]
    assert alone == [[tuple(r[k] for k in at) for r in rows if r[4] in ("footnote_def", "footnote_ref")] for rows in whole] and sum(map(len, alone)) > 1000
    with monkeypatch.context() as m:
        m.setattr(markdown.Parser, "plain", lambda self, c, text, at, number, out: at)
        assert whole == [markdown.rows(t, compat) for t in texts for compat in (False, True)]
    made = []
    monkeypatch.setattr(markdown.Parser, "block", None)
    monkeypatch.setattr(markdown.Parser, "finish", lambda self, nodes, *a, f=markdown.Parser.finish: made.append([n.kind for n in nodes]) or f(self, nodes, *a))
    markdown.rows("# H\n\nSee [^n].\n\n***\n\n- [x] a\n\n<div>\n\n    c\n\n**b**\n\n[[P]]\n\nT\n: d\n\n[^n]: Note.\n\n[r]: u\n", False, names, frozenset(["footnote_def", "footnote_ref"]))
    assert made == [["paragraph"], ["paragraph"]]


def test_what_is_at_a_line_takes_one_pass(spark, large, monkeypatch):
    """Parts are parsed once and written nowhere; a node is moved once, by document and bin. The lines are those of both steps."""
    from quillstack.operators import lines, views
    from quillstack.sources import corpus

    with monkeypatch.context() as m:
        m.setattr(registry.corpora, "shared_folder", None)
        m.setattr(registry.corpora, "TASK_DOCUMENTS", 50)
        plan = registry.queries()["line_details"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    moved = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
    assert plan.count("MapInArrow") == 1 and sum("_bin#" in x for x in moved) == 2 and not [x for x in moved if "line#" in x or "node_id#" in x]
    docs = spark.createDataFrame([(0, DOC), (1, "word\n"), (2, "# A\n" + "x y\n" * 200 + "\n" * 90 + "- [x] `b`\n")], "doc_id long, content string")
    for compat in (False, True):
        nodes = corpus.markdown_nodes(docs, compat).persist()
        points = spark.range(0, 330).selectExpr("id % 3 AS doc_id", "CAST(id AS INT) AS line").unionByName(spark.range(1, 90).selectExpr("0L AS doc_id", "CAST(id AS INT) AS line"))
        want = views.line_view(lines.node_at(nodes, points), nodes)
        got = views.details_at(nodes, points)
        assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect())) and got.count() > 100
        nodes.unpersist()


def test_hits_need_no_inline_content(spark, large, monkeypatch):
    """Without the numbers of nodes, of which hits show none, the parser reads paragraphs for their constructs only; the lines stay the same."""
    from quillstack.operators import constructs, views
    from quillstack.sources import corpus

    asked = []
    with monkeypatch.context() as m:
        m.setattr(registry.corpus, "markdown_nodes", lambda docs, compat=False, columns=None, kinds=None, kept=(), f=corpus.markdown_nodes: asked.append((columns, kinds)) or f(docs, compat, columns, kinds, kept))
        assert registry.queries()["type_hits"](spark, DATA).columns == ["doc_id", "sec_id", "name", "line"]
    assert len(asked) == 1 and not markdown._inlined(*asked[0])
    docs = spark.createDataFrame([(0, DOC), (1, "# A\n\n> [!TIP] `c` <b> #1\n> [x](y)\n\n- [x] [a #2](b.md) `#3` :smile:\n\nx <https://a.example/#4> @u\n"), (2, "")], "doc_id long, content string")
    for compat in (False, True):
        all_, few = corpus.markdown_nodes(docs, compat), corpus.markdown_nodes(docs, compat, *asked[0])
        want, got = views.all_hits(all_).drop("ord"), views.all_hits(few).drop("ord")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 15
    assert constructs.COUNTED.keys() <= asked[0][1]
