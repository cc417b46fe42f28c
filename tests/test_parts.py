"""The parts corpora: YAML in both parsers, and documents dealt out to tasks."""

import yaml

from quillstack.plans import corpora
from quillstack.sources import yaml_tree

DATA = "/root/testdata/sf0.001"


def test_both_yaml_parsers_agree(monkeypatch):
    texts = ["a: &x {b: [1, 2]}\nc: *x\n'd': \"e\"\n- x", "? k\n: v\n", "k:\n\t- x\n", "--- \n #", "a: |\n  x\n", "é: ü\n", "a:\n- b: 1\n  c:\n", "a: [", "x: \x85y\n"]

    def read(text):
        try:
            return list(yaml_tree.rows(text))
        except yaml.YAMLError:
            return "not YAML"

    fast = [read(t) for t in texts]
    monkeypatch.setattr(yaml_tree, "_FAST", None)
    assert fast == [read(t) for t in texts]


def test_documents_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(corpora, "TASK_DOCUMENTS", 50)
    assert all(build(spark, DATA).rdd.getNumPartitions() == 4 for build in (corpora.parts, corpora.parts_yaml))
