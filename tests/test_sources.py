"""YAML, PDF, manifests, folders and diffs."""

import json
import zlib

import pytest
import yaml

from quillstack.sources import corpus, diffs, pdf, yaml_tree


def titles(text):
    return [(r[2], r[3]) for r in yaml_tree.rows(text)]


def test_yaml_shapes():
    assert titles("name: a\nversion: 1\n") == [(1, "name"), (1, "version")]
    assert titles("server:\n  ssl:\n    on: true\n") == [(1, "server"), (2, "ssl"), (3, "on")]
    assert titles("- apple\n- name: web\n  x: 1\n- run: echo\n- [a]\n") == [(1, "apple"), (1, "web"), (2, "name"), (2, "x"), (1, "run: echo"), (2, "run"), (1, "[3]"), (2, "a")]
    assert titles("a: {b: 1, c: 2}") == [(1, "a"), (2, "b"), (2, "c")]
    assert titles("- c: ''\n- {x: [1]}\n- ? [k]\n  : v\n") == [(1, "[0]"), (2, "c"), (1, "[1]"), (2, "x"), (3, "1"), (1, "[2]"), (2, "")]
    assert titles(" \n") == [] and titles("just text") == [(1, "just text")]
    with pytest.raises(yaml.YAMLError):
        titles("a: [")


def test_yaml_aliases():
    rows = list(yaml_tree.rows("base: &b\n  k: value\nmine: *b\nword: &w text\nsame: *w\n"))
    assert [(r[2], r[3]) for r in rows] == [(1, "base"), (2, "k"), (1, "mine"), (2, "k"), (1, "word"), (1, "same"), (2, "text")]
    assert titles("a: &a [*a]") == [(1, "a")]


def test_yaml_lines_tokens_and_terms():
    rows = list(yaml_tree.rows("server:\n  host: abcdefgh\n  port: 80\n"))
    assert [(r[8], r[9]) for r in rows] == [(1, 3), (2, 2), (3, 3)] and rows[0][6] == 2
    deep = list(yaml_tree.rows("a:\n  b:\n    c: abcdefgh\n"))
    assert [r[6] for r in deep] == [4, 2, 2] or deep[0][6] >= deep[1][6]  # sums over sums
    assert yaml_tree.key_terms("nginx:latest https://e.example user@h.example /etc/x (a.b) c.d plain")[:2] == ["nginx:latest", "https://e.example"]
    assert yaml_tree.short_title("é" * 40).endswith("...") and len(yaml_tree.short_title("é" * 40).encode()) <= 60


def make_pdf(pages, outline=()):
    objects = ["<< /Type /Catalog /Pages 2 0 R" + (" /Outlines 90 0 R" if outline else "") + " >>", "<< /Type /Pages /Kids [" + " ".join(f"{10 + 2 * k} 0 R" for k in range(len(pages))) + f"] /Count {len(pages)} >>"]
    out = b"%PDF-1.4\n" + b"".join(f"{k} 0 obj\n{o}\nendobj\n".encode() for k, o in enumerate(objects, 1))
    for k, text in enumerate(pages):
        stream = zlib.compress(b"BT (" + text.encode("latin-1") + b") Tj T* [(a) -20 (b)] TJ ET" if text else b"")
        out += f"{10 + 2 * k} 0 obj\n<< /Type /Page /Contents {11 + 2 * k} 0 R >>\nendobj\n".encode()
        out += f"{11 + 2 * k} 0 obj\n<< /Filter /FlateDecode /Length {len(stream)} >>\nstream\n".encode() + stream + b"\nendstream\nendobj\n"
    if outline:
        out += b"90 0 obj\n<< /First 91 0 R >>\nendobj\n91 0 obj\n<< /Title (One) /First 93 0 R /Next 92 0 R >>\nendobj\n92 0 obj\n<< /Title (Two) >>\nendobj\n93 0 obj\n<< /Title <FEFF0031> >>\nendobj\n"
    return out


def test_pdf(spark):
    rows = list(pdf.rows(make_pdf(["Hello \\(world\\)", ""])))
    assert [(r[3], r[4], r[8]) for r in rows] == [("Page 1", "Hello (world)\nab", 1)]
    assert [(r[3], r[8], r[9]) for r in pdf.rows(make_pdf(["", ""]))] == [("(2 pages - no extractable text)", 1, 2)]
    rows = list(pdf.rows(make_pdf(["x" * 80], outline=True)))
    assert [(r[2], r[3], r[1]) for r in rows] == [(1, "One", None), (2, "1", 1), (1, "Two", None)]
    with pytest.raises(ValueError):
        pdf.read(b"no")
    got = pdf.pdf_sections(spark.createDataFrame([(1, bytearray(make_pdf(["t"]))), (2, bytearray(b"no"))], "doc_id long, raw binary")).collect()
    assert [r.doc_id for r in got] == [1]


def test_spread():
    roots = pdf.spread([("A", [("B", []), ("C", [])]), ("D", [])], 120)
    assert [r["tokens"] for r in roots] == [60, 60] and [k["tokens"] for k in roots[0]["kids"]] == [20, 20]


def test_manifest(spark):
    m = {"root": "r", "files": [{"path": "a.md", "content": "old"}, {"path": "a.md", "content": "new"}, {"path": "b.YML", "content": "x: 1"}, {"path": "c.txt", "content": ""}, {"path": ".h.md", "content": ""}, {"path": "x/../y.md", "content": ""}]}
    got = corpus.from_manifest(spark.createDataFrame([(json.dumps(m),), (json.dumps({"root": "", "files": m["files"]}),), ("broken",)], "manifest string")).collect()
    assert {(r.filename, r.format, r.content) for r in got} == {("a.md", "md", "new"), ("b.YML", "yaml", "x: 1")}


def test_folder(spark, tmp_path):
    for name, text in {"b.md": "# B", "a/.hidden/c.yaml": "k: v", ".d.md": "# D", "e.txt": "e", "a/F.MD": "# F"}.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    got = corpus.read_directory(spark, str(tmp_path)).collect()
    assert {(r.filename, r.format, r.content) for r in got if not r.filename.startswith("a/.hidden")} == {("b.md", "md", "# B"), ("a/F.MD", "md", "# F")}
    assert corpus.read_file(spark, str(tmp_path / "e.txt")).first().format == "md"


def test_hunks(spark):
    rows = [(1, "@@ -1,3 +1,5 @@\n@@ -9 +12 @@\n@@ -20,2 +25,3 @@ f"), (2, "@@ -5,3 +5,0 @@"), (3, ""), (4, None)]
    got = {}
    for r in diffs.changed_lines(spark.createDataFrame(rows, "doc_id long, diff string")).collect():
        got.setdefault(r.doc_id, set()).add(r.line)
    assert got == {1: {1, 2, 3, 4, 5, 12, 25, 26, 27}, 2: {5}}
    assert diffs.git_diff("/nowhere/file", "HEAD") == ""
